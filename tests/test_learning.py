"""Learning operators against numpy on small rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluation, learning, models

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows():
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(120, 3)) * [3.0, 1.0, 0.3]
    x[:, 1] += 0.5 * x[:, 0]
    y = (x[:, 0] + rnd.normal(size=120) > 0.5).astype(int)
    return x, y


@pytest.fixture(scope="module")
def frame(spark, rows):
    x, y = rows
    data = [(i, *map(float, r), list(map(float, r)), int(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(data, "id long, a double, b double, c double, v array<double>, y int")


def test_pca(rows, frame):
    x, _ = rows
    centred = x - x.mean(0)
    _, s, axes = np.linalg.svd(centred, full_matrices=False)
    axes *= np.sign(axes[np.arange(3), abs(axes).argmax(1)])[:, None]
    projected, shares = learning.pca(frame, "v", 2)
    got = np.array([r.projected for r in projected.orderBy("id").select("projected").collect()])
    assert np.allclose(got, centred @ axes[:2].T, atol=1e-8) and np.allclose(shares, (s**2 / (s**2).sum())[:2])


def test_vif(rows, frame):
    x, _ = rows
    got = {r.name: r.vif for r in evaluation.vif(frame, COLUMNS).collect()}
    for k, name in enumerate(COLUMNS):
        rest = np.c_[np.ones(len(x)), np.delete(x, k, 1)]
        off = x[:, k] - rest @ np.linalg.lstsq(rest, x[:, k], rcond=None)[0]
        assert got[name] == pytest.approx(x[:, k].var() / off.var(), rel=1e-6)


def test_contributions_add_up_to_the_logit(rows, frame):
    x, _ = rows
    model = learning.logistic(learning.vectors(frame, COLUMNS), "y")
    w = model.coefficients.toArray()
    got = {r.id: r.total for r in learning.contributions(frame, "id", "y", COLUMNS).groupBy("id").agg(F.sum("contribution").alias("total")).collect()}
    want = x @ w - x.mean(0) @ w
    assert len(got) == 120 and np.allclose([got[i] for i in range(120)], want, atol=1e-6)


def test_out_of_fold_scores_each_row_once(rows, frame):
    _, y = rows
    got = learning.out_of_fold(learning.vectors(frame, COLUMNS), "id", "y", 4, fit=learning.logistic).collect()
    assert sorted(r.id for r in got) == list(range(120)) and {r.fold for r in got} == {0, 1, 2, 3}
    for label in (0, 1):
        sizes = np.bincount([r.fold for r in got if y[r.id] == label], minlength=4)
        assert sizes.max() - sizes.min() <= 1
    assert np.mean([(r.p > 0.5) == bool(y[r.id]) for r in got]) > 0.8


def test_boosted_separates(rows, frame):
    _, y = rows
    data = learning.vectors(frame, COLUMNS)
    got = {r.id: r.p for r in learning.scored(learning.boosted(data, "y", 5), data, "id").collect()}
    assert np.mean([(got[i] > 0.5) == bool(y[i]) for i in range(120)]) > 0.85


def test_clusters_of_two_clouds(spark):
    rnd = np.random.default_rng(6)
    x = np.r_[rnd.normal(0, 0.5, (60, 2)), rnd.normal(8, 0.5, (60, 2))]
    df = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)], "id long, v array<double>")
    for found in (learning.kmeans(df, "id", "v", 2), learning.mixture(df, "id", "v", 3)):
        cluster = {r.id: r.cluster for r in found.collect()}
        assert not {cluster[i] for i in range(60)} & {cluster[i] for i in range(60, 120)}


def test_coral(spark, rows, frame):
    x, _ = rows
    split = frame.withColumn("domain", (F.col("id") % 2).cast("int"))
    one, two = x[1::2], x[::2]
    want = ((one.mean(0) - two.mean(0)) ** 2).sum() + ((np.cov(one.T) - np.cov(two.T)) ** 2).sum() / 36
    assert learning.coral(split, "domain", COLUMNS).first().distance == pytest.approx(want)


def test_standardize(rows, frame):
    x, _ = rows
    got = learning.standardize(frame.withColumn("c", F.lit(2.0)), ["a", "c"]).orderBy("id").collect()
    assert np.allclose([r.a for r in got], (x[:, 0] - x[:, 0].mean()) / x[:, 0].std()) and {r.c for r in got} == {0.0}


def test_leave_one_out_of_few_rows(rows, frame):
    data = learning.vectors(frame.where("id < 12"), COLUMNS)
    got = learning.out_of_fold(data, "id", "y", fit=learning.logistic).collect()
    assert sorted(r.id for r in got) == list(range(12)) and len({r.fold for r in got}) == 12
    one = frame.where("y = 1").limit(5).union(frame.where("y = 0").limit(1))
    alone = {r.id: r.p for r in learning.out_of_fold(learning.vectors(one, COLUMNS), "id", "y", fit=learning.logistic).collect()}
    assert len(alone) == 6 and 1.0 in alone.values()  # the only row of its class is scored by rows of the other
    with pytest.raises(ValueError):
        learning.out_of_fold(learning.vectors(frame.where("y = 1"), COLUMNS), "id", "y")


def test_boosted_out_of_fold(rows, frame):
    _, y = rows
    got = learning.out_of_fold(learning.vectors(frame, COLUMNS), "id", "y", 3, fit=lambda r, label: learning.boosted(r, label, 4)).collect()
    assert len(got) == 120 and np.mean([(r.p > 0.5) == bool(y[r.id]) for r in got]) > 0.75


def test_contributions_reconstruct_the_score(frame):
    assert learning.contributions(frame, "id", "y", COLUMNS).agg(F.max("error")).first()[0] < 1e-9


def test_detector_comes_back_the_same(spark, rows, frame, tmp_path):
    _, y = rows
    train, test = frame.where("id % 3 != 0"), frame.where("id % 3 = 0")
    model = models.fit(train, ["a", "b"], "y", text="v", components=2, iterations=5)
    path = str(tmp_path / "detector")
    models.save(model, path)
    own = {r.id: r.p for r in models.score(model, test, "v").collect()}
    again = {r.id: r.p for r in models.score(models.load(path), test.repartition(5), "v").collect()}
    assert own == again and len(own) == 40
    assert models.score(model, test, "v").columns == [*test.columns, "p"]
    row = models.metric_row(models.load(path), test, "y", "v").first()
    assert row.tp + row.fp + row.fn + row.tn == 40 and row.accuracy == pytest.approx(np.mean([(own[i] >= 0.5) == bool(y[i]) for i in own]))
    # the loaded model in a session of its own
    other = spark.newSession()
    assert {r.id: r.p for r in models.score(models.load(path), other.createDataFrame(test.collect(), test.schema), "v").collect()} == own


def test_rows_outside_the_training_set_do_not_move_the_fit(frame):
    train, far = frame.where("id % 3 != 0"), frame.where("id % 3 = 0").withColumn("a", F.col("a") * 1000).withColumn("v", F.transform("v", lambda x: x * 1000))
    model = models.fit(train, ["a", "b"], "y", text="v", components=2, iterations=3)
    together = {r.id: r.p for r in models.score(model, train.union(far), "v").collect()}
    assert all(together[r.id] == r.p for r in models.score(model, train, "v").collect())
    x = np.array([r.v for r in train.collect()])
    centred = x - x.mean(0)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    reduced = np.array([r.detector_reduced.toArray() for r in model.transform(models.prepared(train, "v")).orderBy("id").select("detector_reduced").collect()])
    order = np.argsort([r.id for r in train.collect()])
    assert np.allclose(abs(reduced), abs(centred[order] @ axes[:2].T), atol=1e-8)
    with pytest.raises(ValueError):
        models.fit(train.where("y = 1"), ["a"], "y")


def test_modules_equal_least_squares(spark):
    rnd = np.random.default_rng(8)
    x = rnd.normal(size=(300, 6))
    x[:, 1] = x[:, 0] + 0.3 * x[:, 1]
    x[:, 3] = 0.8 * x[:, 0] - x[:, 4] + 0.2 * x[:, 3]
    x[:, 5] = 2.0
    names = [f"f{i}" for i in range(6)]
    modules = {"one": ["f0", "f1"], "two": ["f2", "f3"], "three": ["f4", "f5"]}
    df = spark.createDataFrame([*[tuple(map(float, r)) for r in x], (None, 1.0, 1.0, 1.0, 1.0, 1.0)], ", ".join(f"{n} double" for n in names))
    got = {r.module: r for r in evaluation.module_independence(df, modules).collect()}
    at = {n: i for i, n in enumerate(names)}
    for name, own in modules.items():
        rest = np.c_[np.ones(300), x[:, [at[c] for c in names if c not in own]]]
        r2 = []
        for c in own:
            y = x[:, at[c]]
            off = y - rest @ np.linalg.lstsq(rest, y, rcond=None)[0]
            r2.append(min(max(1 - (off**2).sum() / ((y - y.mean()) ** 2).sum(), 0), 0.9999) if y.var() > 1e-12 else 1.0)
        assert got[name].r2 == pytest.approx(np.mean(r2), abs=1e-9) and got[name].vif == pytest.approx(1 / (1 - np.mean(r2)), rel=1e-6) and got[name].independent == (np.mean(r2) < 0.5)
    means = {(r.a, r.b): r.mean_r for r in evaluation.module_correlations(df, modules).collect()}
    c = abs(np.corrcoef(x[:, :5].T))
    assert means["one", "two"] == pytest.approx(c[:2, 2:4].mean()) and means["one", "one"] == pytest.approx(c[0, 1])
    assert means["one", "three"] == pytest.approx(c[:2, 4].mean() / 2)  # the constant column is like nothing


def test_paired_gate(spark):
    def gate(rows):
        return evaluation.paired_gate(spark.createDataFrame(rows, "seed int, method string, distortion double, agreement double, loss double"), "a", "b").first()

    good = [(s, m, 1.0 - 0.5 * (m == "b"), 0.5, 0.1 + 0.01 * (m == "b")) for s in range(6) for m in "ab"]
    one = gate(good)
    assert (one.pairs, one.better, one.kept, one.tolerable, one.ready) == (6, 6, 6, True, True) and one.mean_reduction == pytest.approx(0.5)
    assert not gate(good[:8]).ready and gate(good[:8]).pairs == 4
    assert not gate([*good[:-1], (5, "b", 0.5, 0.5, 0.2)]).ready and gate([*good[:-1], (5, "b", 2.0, 0.5, 0.1)]).ready
    none = gate(good[:1])
    assert none.pairs == 0 and none.mean_gain is None and not none.ready
