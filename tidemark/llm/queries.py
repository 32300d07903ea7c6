"""The registered query of each operator, with production parameters."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontam, fingerprint, langid, licenses, linededup, manifest, minhash, pages, periodic, secrets, simhash, toxicity
from tidemark.plans.shared import bounded, table


def crc_fold(n: int):
    """crc32 of doc_id as text, modulo ``n``; 0, which is never held out, for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % n, F.lit(0))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def digests(ids, decoded: bytes) -> tuple[int, str, str]:
    return len(ids), hashlib.sha256(" ".join(map(str, ids.tolist())).encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()


def encoded_digests(docs: DataFrame) -> DataFrame:
    return bpe.encode_decode(docs, tokenizer_path(), digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_digests(table(spark, sf_dir, "documents"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(crc_fold(3) != 1))
    held = docs.select("doc_id", "text", (crc_fold(3) == 1).alias("held_out"))
    # held_out is a function of doc_id alone, so it is added to what the operator returns
    return langid.predict(held, model).withColumn("held_out", crc_fold(3) == 1).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op3_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "text", "lines_removed")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # labels are broadcast while their number is bounded, so the texts need not move
    labels = bounded(table(spark, sf_dir, "labels").where("toxic is not null").select("doc_id", "toxic"))
    known = docs.select("doc_id", "text").where(crc_fold(4) != 2).join(labels, "doc_id")
    scored = toxicity.score(docs, toxicity.train(known))
    return scored.select("doc_id", (crc_fold(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s.kind < 3)
    count = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = fingerprint.fingerprint_edits(table(spark, sf_dir, "documents"))
    return both.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next", "group_doc", "group_size")


def op7_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "blocks_shared")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3)


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic.find_runs(docs.withColumn("text", periodic.looped(F.col("text"), F.col("doc_id"))))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), F.concat(r.period.cast("string"), F.lit("\n")))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    whole = (-F.col("b.start")).alias("start"), F.col("b.length").alias("length"), (-F.col("b.period")).alias("period"), F.floor(1000 * F.col("b.length") / -F.col("b.period")).alias("exponent_milli")
    return rows.select("doc_id", "n_runs", *whole, "runs_sha256", "collapsed_sha256")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    changed = {"text": F.translate("text", capitals, capitals.lower())}
    found = manifest.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], changed, lambda doc_id: F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0)
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


QUERIES = {"op1_bpe": op1_bpe, "op2_minhash": op2_minhash, "op3_linededup": op3_linededup, "op4_toxicity": op4_toxicity, "op5_secrets": op5_secrets, "op6_fingerprint": op6_fingerprint, "op7_pages": op7_pages, "op8_langid": op8_langid, "op9_licenses": op9_licenses, "op10_decontam": op10_decontam, "op11_simhash": op11_simhash, "op12_periodic": op12_periodic, "op13_merkle": op13_merkle}
