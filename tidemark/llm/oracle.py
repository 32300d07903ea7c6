ORACLE: dict[str, str] = {}
