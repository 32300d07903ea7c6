"""Language identification by error-correcting output codes.

Each language has a codeword of bits; for each bit one logistic classifier over hashed byte n-grams is
trained to tell the languages with a one from those with a zero. A text gets the language whose codeword
has the least loss under the classifiers' margins, each bit weighted by how well it was learned, so that a
few wrong bits are corrected. The share of the best codeword is the score; a small lead flags ambiguity.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Hashed n-gram features; labelled rows taken of each language, the fit's bound; the least lead in score that isn't ambiguous.
FEATURES, ROWS_PER_LANGUAGE, LEAD = 4096, 600, 0.1
#: Share of the nearest codeword under which an ambiguous text is rejected.
WEAK = 0.4
UNKNOWN = "und"

LETTER = regex.compile(r"\p{L}")
#: Bytes as the n-grams see them: ASCII that isn't a letter is a space.
SEEN = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint32)


def features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed byte pairs and triples of the whole lower-cased text."""
    b = SEEN[np.frombuffer((" " + text.lower() + " ").encode(), np.uint8)]
    b = b[(b != 32) | np.r_[True, b[:-1] != 32]]
    pairs = (b[:-1] << 8 | b[1:]) + np.uint32(1 << 24)
    triples = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
    h = np.r_[pairs, triples] * np.uint32(2654435761) >> np.uint32(20)
    n = np.bincount(h, minlength=FEATURES).astype(np.float32)
    return np.sqrt(n / max(1.0, n.sum()))


def codewords(k: int) -> np.ndarray:
    """A row of +1 and -1 for each of ``k`` classes: every split of them for few, else the widest of seeded random codes."""
    if k <= 1:
        return np.ones((k, 0), np.float32)
    if k <= 5:
        splits = [(1, *s) for s in itertools.product((1, -1), repeat=k - 1)][1:]
        return np.array(splits, np.float32).T
    bits, rnd, best = 10 * int(np.ceil(np.log2(k))), np.random.default_rng(7), (-1, None)
    for _ in range(50):
        m = rnd.choice([1.0, -1.0], (k, bits)).astype(np.float32)
        apart = (bits - m @ m.T) / 2 + bits * np.eye(k)
        if np.abs(m.sum(0)).max() < k and apart.min() > best[0]:
            best = apart.min(), m
    return best[1]


def fit(x: np.ndarray, y: np.ndarray, languages: list[str], rounds: int = 300) -> dict:
    """Bit classifiers by full-batch logistic regression with momentum; rows of each language count alike."""
    code = codewords(len(languages))
    target = code[y]
    weight = (1 / np.bincount(y, minlength=len(languages)))[y][:, None] / len(languages)
    mean = x.mean(0)
    scale = 1 / (x.std(0) + 0.002)
    z = (x - mean) * scale / np.sqrt(x.shape[1])
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(rounds):
        g = -target * weight / (1 + np.exp(np.clip(target * (z @ w + b), -30, 30)))
        vw = 0.9 * vw - 5.0 * (z.T @ g + 1e-4 * w)
        vb = 0.9 * vb - 5.0 * g.sum(0)
        w, b = w + vw, b + vb
    right = (((z @ w + b) * target > 0) * weight).sum(0) if len(x) else np.ones(code.shape[1])
    trust = np.log(np.clip(right, 0.5 + 1e-3, 1 - 1e-3) / (1 - np.clip(right, 0.5 + 1e-3, 1 - 1e-3)))
    w = w * (scale / np.sqrt(x.shape[1]))[:, None]
    return {"languages": languages, "code": code, "w": w.astype(np.float32), "b": (b - mean @ w).astype(np.float32), "trust": (trust / max(trust.sum(), 1e-9)).astype(np.float32)}


def decode(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best class, its share and its lead over the next, by loss-weighted distance to the codewords."""
    code = model["code"]
    margin = np.clip(x @ model["w"] + model["b"], -20, 20)
    loss = (np.log1p(np.exp(-margin[:, None, :] * code[None])) * model["trust"]).sum(2)
    p = np.exp(-loss * max(1, code.shape[1]) * 0.5)
    p /= p.sum(1, keepdims=True)
    if p.shape[1] == 1:
        return np.zeros(len(x), int), p[:, 0], p[:, 0]
    two = np.sort(p, 1)[:, -2:]
    return p.argmax(1), two[:, 1], two[:, 1] - two[:, 0]


def train(labelled: DataFrame) -> dict | None:
    """Model from the ``text`` and non-null ``lang`` of the given rows: of each language the ROWS_PER_LANGUAGE
    different texts with the smallest hash, whole. Texts without a letter teach nothing; repeated ones teach once. None if no row is left.

    The threshold of each language's hash follows from its number of different texts and lets about twice as many pass, so that
    only those are ordered, however many rows a language has."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text", F.xxhash64("text").alias("h"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    if not sizes:
        return None
    most = F.create_map(*[F.lit(v) for k, n in sizes.items() for v in (k, int(min(2.0**63 - 1025, -(2.0**63) + 2.0**64 * min(1, 2 * ROWS_PER_LANGUAGE / n))))])

    def run(batches):
        for batch in batches:
            vectors = [features(t.as_py()).astype(np.float16).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.binary()), batch.column(2)], ["lang", "x", "h"])

    few = rows.where(F.col("h") <= most[F.col("lang")]).mapInArrow(run, "lang string, x binary, h long").groupBy("lang", "h").agg(F.first("x").alias("x"))
    chosen = few.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("n") <= ROWS_PER_LANGUAGE)
    got = chosen.select("lang", "x").collect()
    languages = sorted({r["lang"] for r in got})
    at = {v: i for i, v in enumerate(languages)}
    got.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in got]).astype(np.float32)
    return fit(x, np.array([at[r["lang"]] for r in got]), languages)


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous for every row, from its whole text alone.

    Null texts and texts without a letter are ``und`` with score 0, not ambiguous; so is every text when
    there was nothing to learn from. Repeated rows get equal results; other columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [t.as_py() for t in part.column(1)]
                known = [i for i, t in enumerate(texts) if model and t and LETTER.search(t)]
                pred, score, unsure = [UNKNOWN] * len(texts), [0.0] * len(texts), [False] * len(texts)
                if known:
                    best, share, lead = decode(model, np.stack([features(texts[i]) for i in known]))
                    for i, k, s, gap in zip(known, best, share, lead, strict=True):
                        pred[i], score[i], unsure[i] = model["languages"][k], float(s), bool(gap < LEAD)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())], ["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def with_language(docs: DataFrame, model: dict | None) -> DataFrame:
    """The rows of ``docs``, all columns, whose own text the decoder gives a language. It rejects texts that are null or have no
    letter, and texts of which it is unsure and finds no codeword near: lead under LEAD and share under WEAK.

    Each row is decided alone, whatever its doc_id. Without a model nothing can be told, and all rows stay."""
    if model is None:
        return docs
    at, shared = docs.columns.index("text"), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for start in range(0, batch.num_rows, 512):
                texts = [t.as_py() for t in batch.column(at).slice(start, 512)]
                known = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
                if known:
                    _, share, lead = decode(shared.value, np.stack([features(texts[i]) for i in known]))
                    keep[np.array(known) + start] = (lead >= LEAD) | (share >= WEAK)
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
