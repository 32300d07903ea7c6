"""Joins, similarity, sources and streams on hand-made rows."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import simjoin
from tidemark.operators import tables as ops
from tidemark.plans import shared
from tidemark.sources import social
from tidemark.streaming import jobs


def test_one_to_one_refuses_repeats(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    b = spark.createDataFrame([(1, 5), (1, 6)], "k long, w long")
    assert ops.join_one_to_one(a, b.limit(1), "k").count() == 2
    with pytest.raises(Exception, match="repeats"):
        ops.join_one_to_one(a, b, "k").collect()


def test_blocks_do_not_change_similarity(spark, monkeypatch):
    rnd = np.random.default_rng(1)
    v = rnd.normal(size=(40, 6))
    df = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(40)] + [(40, [0.0] * 6), (41, None)], "id long, v array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = unit @ unit.T
    want = {(i, j) for i in range(40) for j in range(i + 1, 40) if s[i, j] > 0.5}
    for block in (4096, 7):
        monkeypatch.setattr(simjoin, "BLOCK", block)
        assert {(r.a, r.b) for r in simjoin.cosine_pairs(df, "id", "v", 0.5).collect()} == want
        top = {(r.query, r.item) for r in simjoin.top_k(df.where("id < 40"), df.where("id < 40"), "id", "id", "v", 3, skip_same=True).collect()}
        assert top == {(i, j) for i in range(40) for j in sorted((j for j in range(40) if j != i), key=lambda j: (-round(s[i, j], 9), j))[:3]}


def test_greedy_keep(spark):
    rnd = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rnd.integers(0, 30, (40, 2)) if a != b]
    kept = []
    for i in range(30):
        if not any((i, k) in edges or (k, i) in edges for k in kept):
            kept.append(i)
    got = simjoin.greedy_keep(spark.range(30).toDF("id"), spark.createDataFrame(edges, "a long, b long"))
    assert sorted(r.id for r in got.collect()) == kept


def test_random_per_query_is_stable(spark):
    q, i = spark.range(20).toDF("u"), spark.range(500).toDF("p")
    one = sorted(map(tuple, simjoin.random_per_query(q, i, "u", "p", 5).collect()))
    assert one == sorted(map(tuple, simjoin.random_per_query(q.repartition(7), i.repartition(3), "u", "p", 5).collect()))
    assert all(sum(u == x for x, _ in one) == 5 for u in range(20))


def test_raw_files(spark, tmp_path):
    (tmp_path / "e.csv").write_text("source_id,relation,target_id\nu1,following,u3\n")
    (tmp_path / "bad.csv").write_text("source_id,target_id\nu1,u3\n")
    (tmp_path / "u.json").write_text(json.dumps([{"id": "12345678901234567890", "username": "a", "public_metrics": {"followers_count": 3}}]))
    (tmp_path / "log.txt").write_text("INFO Agent 1 acts INFO Agent 12 acts INFO idle")
    assert social.read_edges(spark, str(tmp_path / "e.csv")).collect()[0].target_id == "u3"
    with pytest.raises(ValueError):
        social.read_edges(spark, str(tmp_path / "bad.csv"))
    assert social.read_users(spark, str(tmp_path / "u.json")).first().id == "12345678901234567890"
    assert sorted((r.agent_id or 0) for r in social.read_agent_log(spark, str(tmp_path / "log.txt")).collect()) == [0, 1, 12]
    out = str(tmp_path / "bundle")
    social.write_bundle({"t": spark.range(5)}, out)
    assert [r.ok for r in social.check_bundle(spark, out).collect()] == [True]
    spark.range(4).write.mode("overwrite").parquet(f"{out}/t")
    assert [r.ok for r in social.check_bundle(spark, out).collect()] == [False]


def streamed(spark, tmp_path, parts, schema, job, name, mode):
    """Feeds row lists as files, one batch each, and returns what the sink has."""
    src = str(tmp_path / name)
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    df = spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = job(df).writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_stream_reaction_state_is_the_batch_state(spark, tmp_path):
    rows = [(1, 7, f"2024-01-0{1 + k % 3} 00:00:00", k, "like" if k % 3 else "dislike") for k in range(9)]
    schema = "user_id long, post_id long, ts string, event_id long, action string"
    job = lambda df: jobs.reaction_state(df.withColumn("ts", F.col("ts").cast("timestamp")))
    got = streamed(spark, tmp_path, [rows[:4], rows[4:]], schema, job, "reactions_out", "update")
    last = max(rows, key=lambda r: (r[2], r[3]))
    assert got.collect()[-1].state == last[4]


def test_stream_lifecycle_refuses_bad_steps(spark, tmp_path):
    rows = [(1, 0, "opened"), (1, 1, "escalated"), (1, 2, "closed"), (1, 3, "opened"), (1, 1, "closed")]
    got = streamed(spark, tmp_path, [rows[:3], rows[3:]], "case_id long, sequence long, state string", jobs.lifecycle, "cases_out", "append")
    assert sum(r.accepted for r in got.collect()) == 2 and got.count() == 5


def test_stream_step_counters(spark, tmp_path):
    rows = [("2024-01-01 01:00:00", "like"), ("2024-01-01 05:00:00", "like"), ("2024-01-09 00:00:00", "like")]
    job = lambda df: jobs.step_counters(df.withColumn("ts", F.col("ts").cast("timestamp")))
    got = streamed(spark, tmp_path, [rows], "ts string, action string", job, "steps_out", "complete")
    assert sorted(r.n for r in got.collect()) == [1, 2]


def test_id_list_is_refused_with_repeats_or_without_ids(spark, tmp_path):
    for name, text in (("good", "b\n\n a \nc\n"), ("twice", "a\nb\na\n"), ("none", "\n \n")):
        (tmp_path / name).write_text(text)
    assert [r.id for r in social.read_ids(spark, str(tmp_path / "good")).orderBy("position").collect()] == ["b", "a", "c"]
    for name in ("twice", "none"):
        with pytest.raises(ValueError):
            social.read_ids(spark, str(tmp_path / name))


def test_contribution_sinks(spark, tmp_path):
    rows = [(1, "a", -2.0, "lowers", 1), (1, "b", 1.0, "raises", 2), (2, "a", 0.5, "raises", 1), (None, "é,\n", 0.0, "neutral", 1)]
    df = spark.createDataFrame(rows, "user_id long, action string, contribution double, direction string, rank int")
    social.write_contributions(df, f"{tmp_path}/out")
    packets = {r.user_id: [(c["rank"], c["action"], c["contribution"]) for c in r.contributions] for r in spark.read.json(f"{tmp_path}/out/packets").collect()}
    assert packets == {1: [(1, "a", -2.0), (2, "b", 1.0)], 2: [(1, "a", 0.5)], None: [(1, "é,\n", 0.0)]}
    back = spark.read.options(header=True, multiLine=True, escape="\"").schema(df.schema).csv(f"{tmp_path}/out/long")
    assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))


def test_file_digests(spark, tmp_path):
    names = {"b.txt": b"two", "a.txt": b"one", "c.bin": bytes(range(256))}
    for folder in ("x", "y"):
        (tmp_path / folder).mkdir()
        for name in sorted(names, reverse=folder == "y"):
            (tmp_path / folder / name).write_bytes(names[name])
    got = {r.path.rsplit("/", 1)[1]: (r.bytes, r.sha256) for r in social.file_digests(spark, str(tmp_path / "x")).collect()}
    sha = {n: hashlib.sha256(c).hexdigest() for n, c in names.items()}
    assert got == {n: (len(c), sha[n]) for n, c in names.items()}
    want = hashlib.sha256("\n".join(f"{n} {sha[n]}" for n in sorted(names)).encode()).hexdigest()
    assert social.multi_digest(spark, str(tmp_path / "x")) == social.multi_digest(spark, str(tmp_path / "y")) == want
    (tmp_path / "y" / "a.txt").write_bytes(b"changed")
    assert social.multi_digest(spark, str(tmp_path / "y")) != want


def test_suppression_stays_in_groups(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (5, 6)], "a long, b long")
    groups = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "y"), (5, None), (6, None)], "id long, label string")
    inside = simjoin.within_groups(pairs, groups, "label")
    assert sorted(map(tuple, inside.collect())) == [(1, 2), (3, 4)]
    assert sorted(r.id for r in simjoin.greedy_keep(groups.select("id"), inside).collect()) == [1, 3, 5, 6]


def test_scratch_is_refused_on_a_cluster():
    assert shared.one_machine("local[8]") and shared.one_machine("local") and not shared.one_machine("local-cluster[2,1,1024]") and not shared.one_machine("spark://host:7077") and not shared.one_machine("yarn")
