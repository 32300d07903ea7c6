"""Nested records against the json module."""

import json
import random

from tidemark.operators import nested

SCHEMA = "k long, text string, row int, path string, canonical string, value int"
GONE = {"at", "index"}


def stripped(v):
    if isinstance(v, dict):
        return {k: stripped(x) for k, x in v.items() if k not in GONE}
    if isinstance(v, list):
        return [stripped(x) for x in v]
    return int(v) if isinstance(v, float) and v == int(v) else v


def made(rnd, depth=0):
    kind = rnd.choice(["{", "{", "[", "x"]) if depth < 5 else "x"
    if kind == "{":
        return {rnd.choice(["a", "b", "é", "at", "index", 'q"\\', "z.y", "\U0001f600", "￿", "A"]): made(rnd, depth + 1) for _ in range(rnd.randint(0, 4))}
    if kind == "[":
        return [made(rnd, depth + 1) for _ in range(rnd.randint(0, 12))]
    return rnd.choice([None, True, False, 0, 7, -12, 1.5, 2.0, 0.25, "", "text", 'a"b\\c\n/é', "1"])


def canonical(v):
    return json.dumps(stripped(v), ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def shuffled(rnd, v):
    if isinstance(v, dict):
        items = list(v.items())
        rnd.shuffle(items)
        return {k: shuffled(rnd, x) for k, x in items} | {"at": rnd.random()}
    return [shuffled(rnd, x) for x in v] if isinstance(v, list) else v


def test_canonical_equals_sorted_json(spark):
    rnd = random.Random(4)
    values = [made(rnd) for _ in range(150)] + [[], {}, {"at": 1}, [{"at": 1}], [[[]]], 5, "x", None, list(range(30))]
    rows = [(i, json.dumps(v, indent=rnd.choice([None, 2])), 1, "p", "c", 2) for i, v in enumerate(values)]
    odd = [(-1, None), (-2, ""), (-3, '{"a":'), (-4, '{"a":1,"a":2}')]
    got = nested.with_canonical(spark.createDataFrame(rows + [(i, t, 1, "p", "c", 2) for i, t in odd], SCHEMA), "text", tuple(GONE), "form")
    assert got.columns == ["k", "text", "row", "path", "canonical", "value", "form"]
    got = {r.k: r.form for r in got.collect()}
    assert {k: got[k] for k, *_ in rows} == {i: canonical(v) for i, v in enumerate(values)}
    assert all(got[k] is None for k, _ in odd)


def test_only_volatile_keys_and_order_are_free(spark):
    rnd = random.Random(9)
    values = [v for v in (made(rnd) for _ in range(60)) if isinstance(v, dict)]
    rows = [(i, json.dumps(v), 1, "p", "c", 2) for i, v in enumerate(values)] + [(i, json.dumps(shuffled(rnd, v)), 1, "p", "c", 2) for i, v in enumerate(values)]
    seen = {}
    for r in nested.with_canonical(spark.createDataFrame(rows, SCHEMA), "text", tuple(GONE), "form").collect():
        seen.setdefault(r.k, set()).add(r.form)
    assert all(len(x) == 1 for x in seen.values())
    other = {canonical(v | {"more": 1}) for v in values} & {canonical(v) for v in values}
    assert not other


def brute_nodes(v, lists):
    found = {}

    def walk(x, parts):
        items = list(x.items()) if isinstance(x, dict) else [(str(i), y) for i, y in enumerate(x)] if isinstance(x, list) and lists else []
        for k, y in items:
            found[(*parts, k)] = 1
            walk(y, (*parts, k))

    walk(v, ())
    kids = lambda p: sum(len(q) == len(p) + 1 and q[: len(p)] == p for q in found)
    return {(".".join(p), len(p), ".".join(p[:-1]) or None, kids(p), kids(p[:-1]) - 1) for p in found}


def test_taxonomy(spark):
    values = [{"a": {"b": {"c": {}, "d": [1, {"e": 2}]}, "f": 3}, "g": []}, {"x": {}}, {}, [1, [2, 3]], 7, {"l": [[], {}]}]
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)] + [(99, None)], "row long, json string")
    for lists in (True, False):
        nodes = nested.taxonomy(nested.leaves(rows, lists=lists))
        got = {(r.row, r.node, r.depth, r.parent, r.children, r.siblings) for r in nodes.collect()}
        assert got == {(i, *n) for i, v in enumerate(values) for n in brute_nodes(v, lists)}
    asked = spark.createDataFrame([(0, "a.b"), (0, "g"), (0, "none"), (1, "x")], "row long, node string")
    assert {tuple(r) for r in nested.siblings(nodes, asked).collect()} == {(0, "a.b", "a.f"), (0, "g", "a")}


def test_empty(spark):
    assert nested.with_canonical(spark.createDataFrame([], SCHEMA), "text").count() == 0


def test_profile_quality(spark):
    good = {"Summary": "word " * 80, "Generated At": "x", "Base": {"a": 1, "b": ["x", "y"], "c": None}, "D": {"e": " ", "f": {}, "g": False}}
    rows = [(1, json.dumps(good)), (2, json.dumps(good | {"Summary": "short"})), (3, None), (4, "[1, 2]"), (5, json.dumps({"Summary": 5, "A": {"Summary": "inner"}})), (6, "{}")]
    got = {r.row: (r.leaves, r.words, r.valid) for r in nested.profile_quality(spark.createDataFrame(rows, "row long, json string"), 4).collect()}
    assert got == {1: (4, 80, True), 2: (4, 1, False), 3: (0, 0, False), 4: (2, 0, False), 5: (1, got[5][1], False), 6: (0, 0, False)}
