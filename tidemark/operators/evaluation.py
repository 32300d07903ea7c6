"""Evaluation measures as aggregates: classification, calibration, correlation, variance ratios."""

from __future__ import annotations

from itertools import combinations, combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """tp, fp, fn, tn and the rates made of them, null where a rate has no cases; y is 0 or 1, p the score."""
    hit, y = F.col("p") >= threshold, F.col("y") == 1
    c = df.agg(F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn"), F.count_if(~hit & ~y).alias("tn"))
    rate = lambda a, b: F.try_divide(a, b)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select("*", rate(tp, tp + fp).alias("precision"), rate(tp, tp + fn).alias("recall"), rate(2 * tp, 2 * tp + fp + fn).alias("f1"), rate(tp + tn, tp + tn + fp + fn).alias("accuracy"), rate(fn, tp + fn).alias("escape_rate"))


def auc_ap(df: DataFrame) -> DataFrame:
    """ROC-AUC by ranks, ties averaged, and average precision; null if one class is missing.

    Rows are counted by distinct score first; running sums go over those counts in two levels, by score slice and then
    in slices, so no task orders all scores.
    """
    g = df.groupBy("p").agg(F.sum(F.col("y").cast("long")).alias("pos"), F.sum(1 - F.col("y").cast("long")).alias("neg")).withColumn("slice", F.floor(F.col("p") * 1024))
    s = g.groupBy("slice").agg(F.sum("pos").alias("sp"), F.sum("neg").alias("sn"))  # at most 1025 rows for scores in 0..1
    over = Window.orderBy("slice")
    s = s.select("slice", (F.sum("sn").over(over) - F.col("sn")).alias("neg_before"), (F.sum("sp").over(over) - F.col("sp")).alias("pos_before"), F.sum("sp").over(Window.partitionBy()).alias("tp_all"), F.sum("sn").over(Window.partitionBy()).alias("tn_all"))
    w = Window.partitionBy("slice").orderBy("p")
    c = g.join(F.broadcast(s), "slice").withColumn("below", F.col("neg_before") + F.sum("neg").over(w) - F.col("neg")).withColumn("under", F.col("pos_before") + F.sum("pos").over(w) - F.col("pos"))
    tp = F.col("tp_all") - F.col("under")
    seen = tp + F.col("tn_all") - F.col("below")
    return c.agg(F.try_divide(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0)), F.sum("pos") * F.sum("neg")).alias("auc"), F.try_divide(F.sum(F.col("pos") * tp / seen), F.sum("pos")).alias("ap"))


def calibration(df: DataFrame, bins: int = 10) -> DataFrame:
    """Brier score and expected calibration error over equal bins, the last one closed."""
    b = df.groupBy(F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.sum("p").alias("sp"), F.sum("y").alias("sy"), F.sum(F.pow(F.col("p") - F.col("y"), 2)).alias("sq"))
    return b.agg((F.sum("sq") / F.sum("n")).alias("brier"), (F.sum(F.abs(F.col("sp") - F.col("sy"))) / F.sum("n")).alias("ece"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r: Pearson's r of each pair, in one pass."""
    pairs = list(combinations(columns, 2))
    one = df.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


def vif(df: DataFrame, columns: list[str]) -> DataFrame:
    """name, vif: the diagonal of the inverse correlation matrix, which has one row a column and is inverted on the driver."""
    import numpy as np

    m, at = np.eye(len(columns)), {c: i for i, c in enumerate(columns)}
    for r in correlations(df, columns).collect():
        m[at[r["a"]], at[r["b"]]] = m[at[r["b"]], at[r["a"]]] = r["r"] or 0.0
    inverse = np.diag(np.linalg.pinv(m))
    return df.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(columns, inverse, strict=True)], "name string, vif double")


def paired_gate(rows: DataFrame, base: str, other: str, tolerance: float = 0.02, least: int = 5, share: float = 0.8) -> DataFrame:
    """One row on the seeds of ``rows`` (seed, method, distortion, agreement, loss) that have both methods: pairs, mean reduction of distortion, mean gain of agreement and mean change of loss
    from ``base`` to ``other``, better (pairs with less distortion), kept (pairs with no less agreement), tolerable (no loss grew by over ``tolerance``) and ready.

    ready asks for ``least`` pairs, ``share`` of them better and ``share`` kept, rounded up, and tolerable. It is a gate for going on, no proof. Of several rows of a seed
    and method the smallest values count; without pairs the means are null and nothing is ready.
    """
    value = lambda c, m: F.min(F.when(F.col("method") == m, F.col(c)))
    sides = rows.groupBy("seed").agg(*[value(c, m).alias(f"{c}_{k}") for c in ("distortion", "agreement", "loss") for k, m in (("a", base), ("b", other))], F.count_if(F.col("method") == base).alias("n_a"), F.count_if(F.col("method") == other).alias("n_b"))
    gain = {"reduction": F.col("distortion_a") - F.col("distortion_b"), "gain": F.col("agreement_b") - F.col("agreement_a"), "change": F.col("loss_b") - F.col("loss_a")}
    pairs = sides.where("n_a > 0 and n_b > 0").select(*[c.alias(n) for n, c in gain.items()])
    one = pairs.agg(F.count("*").alias("pairs"), *[F.avg(n).alias(f"mean_{n}") for n in gain], F.count_if(F.col("reduction") > 0).alias("better"), F.count_if(F.col("gain") >= 0).alias("kept"), F.coalesce(F.max("change") <= tolerance, F.lit(False)).alias("tolerable"))
    need = F.ceil(F.col("pairs") * share)
    return one.withColumn("ready", (F.col("pairs") >= least) & (F.col("better") >= need) & (F.col("kept") >= need) & F.col("tolerable"))


def covariances(df: DataFrame, columns: list[str]):
    """The covariance matrix of the rows without a null in ``columns``, from one aggregate; it has one row a column and comes to the driver."""
    import numpy as np

    at = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    full = df.dropna(subset=columns)
    row = full.agg(*[F.covar_pop(columns[i], columns[j]).alias(f"c{k}") for k, (i, j) in enumerate(at)]).first()
    m = np.zeros((len(columns), len(columns)))
    for k, (i, j) in enumerate(at):
        m[i, j] = m[j, i] = row[k] or 0.0
    return m


#: Greatest R2 of a column: an exact fit still has a finite variance inflation.
MOST_R2 = 0.9999


def module_independence(df: DataFrame, modules: dict[str, list[str]]) -> DataFrame:
    """module, r2, vif, independent: how well the columns of all other modules tell those of each, by least squares with an intercept. r2 is the mean over the module's
    columns, each between 0 and MOST_R2 (a constant column: 1); vif is 1 / (1 - r2), null for 1; independent below one half.

    All regressions come from the blocks of one covariance matrix, so the rows are read once.
    """
    import numpy as np

    columns = [c for own in modules.values() for c in own]
    m, at, out = covariances(df, columns), {c: i for i, c in enumerate(columns)}, []
    for name, own in modules.items():
        y, x = [at[c] for c in own], [at[c] for c in columns if c not in own]
        told = np.einsum("ij,jk,ik->i", m[np.ix_(y, x)], np.linalg.pinv(m[np.ix_(x, x)], rcond=1e-12, hermitian=True), m[np.ix_(y, x)])
        total = np.diag(m)[y]
        r2 = float(np.mean([min(max(t / v, 0.0), MOST_R2) if v > 1e-12 else 1.0 for t, v in zip(told, total, strict=True)]))
        out.append((name, r2, 1 / (1 - r2) if r2 < 1 else None, r2 < 0.5))
    return df.sparkSession.createDataFrame(out, "module string, r2 double, vif double, independent boolean")


def module_correlations(df: DataFrame, modules: dict[str, list[str]]) -> DataFrame:
    """a, b, mean_r: mean absolute correlation of the columns of each two modules, a module with itself over its different columns; null where there are none."""
    import numpy as np

    columns = [c for own in modules.values() for c in own]
    m, at = covariances(df, columns), {c: i for i, c in enumerate(columns)}
    s = np.sqrt(np.diag(m))
    r = np.abs(np.divide(m, np.outer(s, s), out=np.zeros_like(m), where=np.outer(s, s) > 0))
    out = []
    for a, b in combinations_with_replacement(modules, 2):
        cells = [r[at[x], at[y]] for x in modules[a] for y in modules[b] if x != y]
        out.append((a, b, float(np.mean(cells)) if cells else None))
    return df.sparkSession.createDataFrame(out, "a string, b string, mean_r double")


def anova_f(df: DataFrame, group: str, value: str) -> DataFrame:
    """Between-group over within-group mean squares."""
    g = df.groupBy(group).agg(F.count(value).alias("n"), F.sum(value).alias("s"), (F.var_pop(value) * F.count(value)).alias("ss"))
    t = g.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("within"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("q"))
    return t.select(F.try_divide((F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("k") - 1), F.col("within") / (F.col("n") - F.col("k"))).alias("f"))


#: Two-sided 95 % quantiles of Student's t for 1 to 30 degrees of freedom.
T95 = [12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042]


#: The normal's 97.5 % quantile; beyond 30 degrees of freedom t follows from it by an expansion in their inverse.
Z = 1.959963984540054


def t_quantile(df: Column) -> Column:
    """Two-sided 95 % quantile of Student's t for a number of degrees of freedom; null below 1."""
    tails = [(Z**3 + Z) / 4, (5 * Z**5 + 16 * Z**3 + 3 * Z) / 96, (3 * Z**7 + 19 * Z**5 + 17 * Z**3 - 15 * Z) / 384]
    far = F.lit(Z) + sum((F.lit(c) / F.pow(df, F.lit(k + 1)) for k, c in enumerate(tails)), F.lit(0.0))
    return F.when(df > 30, far).when(df >= 1, F.element_at(F.array(*map(F.lit, T95)), F.greatest(F.least(df, F.lit(30)), F.lit(1)).cast("int")))


def mean_interval(df: DataFrame, group: str, value: str) -> DataFrame:
    """group, n, mean, half: mean and half width of its 95 % interval; null for one row."""
    g = df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("s"))
    return g.select(group, "n", "mean", F.when(F.col("n") > 1, t_quantile(F.col("n") - 1) * F.col("s") / F.sqrt("n")).alias("half"))


def distribution(df: DataFrame, column: str) -> DataFrame:
    """value, n, rate."""
    g = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return g.join(F.broadcast(g.agg(F.sum("n").alias("total"))), F.lit(True)).select("value", "n", (F.col("n") / F.col("total")).alias("rate"))
