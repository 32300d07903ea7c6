"""Near-duplicate documents by SetSketch registers.

Register i of a set keeps the exponent, in base B, of the least of its elements' exponential values under
hash i. Registers of a union are the maxima of the parts' registers; equal registers tell of likeness. Bands of
registers make candidates; the joint likelihood of all registers drops the unlike; what is left is
compared on the full shingle sets. Buckets over LARGE members are cut into blocks whose pairs are compared
exactly by one matrix product, which gives a spanning forest and never a list of all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.components import connected_components
from tidemark.llm.rows import keyed, opened, without
from tidemark.plans.shared import bounded, stored

#: Registers, registers to a band, base and rate of the exponential spacing, largest register value.
REGISTERS, BAND, BASE, RATE, TOP = 128, 4, 1.001, 20.0, 65534
#: Buckets over LARGE members are compared by blocks of about BLOCK members, on full sets.
LARGE, BLOCK = 64, 512
#: Likelihood ratio (natural log) against the least similarity at which a candidate is dropped.
DROP = 10.0
#: Word hashes kept in a worker; a full table is emptied.
CACHE_WORDS = 300_000
#: Candidate ids are broadcast up to this many (8 bytes each); more are joined by shuffle.
IDS_BROADCAST = 2_000_000

_rnd = np.random.default_rng(20240229)
_XOR, _MUL = _rnd.integers(0, 2**32, (REGISTERS, 1), np.uint32), _rnd.integers(0, 2**31, (REGISTERS, 1), np.uint32) * 2 + 1
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, width: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; of fewer words than ``width`` the one whole sequence."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    span = min(width, len(h))
    n = len(h) - span + 1
    s = np.full(n, span, np.uint64)
    for k in range(span):
        s = (s ^ h[k : k + n]) * _C[0]
        s ^= s >> np.uint64(29)
    s = (s ^ (s >> np.uint64(30))) * _C[1]
    return np.unique((s ^ (s >> np.uint64(27))) * _C[2])


def sketch(s: np.ndarray) -> np.ndarray:
    """Registers of a set of hashes: exponents of exponentially spaced, truncated minima."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    low = np.full((REGISTERS, 1), 2**32 - 1, np.uint32)
    for at in range(0, len(x), 512):
        low = np.minimum(low, ((x[None, at : at + 512] ^ _XOR) * _MUL).min(1, keepdims=True))
    least = -np.log1p(-(low[:, 0].astype(np.float64) + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(least) / np.log(BASE)), 0, TOP).astype(np.uint16)


def loglik(j, above, below, same, u, v):
    """Log-likelihood of similarity ``j`` given how many registers of two sketches are above, below, equal;
    u and v are the sets' shares of the summed sizes."""
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)
    a, b = p(u - v * j), p(v - u * j)
    return above * np.log(a) + below * np.log(b) + same * np.log(np.clip(1 - a - b, 1e-12, 1))


def plausible(k1: np.ndarray, k2: np.ndarray, n1: np.ndarray, n2: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of sketches may well have similarity ``least`` or more: the best similarity on a grid does not
    beat ``least`` by DROP, and the sizes allow it."""
    n1, n2 = n1.astype(float), n2.astype(float)
    above, same = (k1 > k2).sum(1), (k1 == k2).sum(1)
    below = REGISTERS - above - same
    u, v = n1 / (n1 + n2), n2 / (n1 + n2)
    top = np.minimum(u / v, v / u)
    sized = np.minimum(n1, n2) >= least * np.maximum(n1, n2) - 1e-9
    at = loglik(np.minimum(least, top), above, below, same, u, v)
    best = np.max([loglik(f * np.minimum(least, top), above, below, same, u, v) for f in np.linspace(0, 1, 33)], axis=0)
    return sized & (best - at <= DROP)


def sketched(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, k1, k2 (128-bit key of the set), registers of every row."""

    def run(batches):
        known = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, k1, k2, regs = [], [], [], []
                for text in part.column(1):
                    s = shingles(text.as_py(), width, known)
                    key = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                    n.append(len(s))
                    k1.append(key[0])
                    k2.append(key[1])
                    regs.append(sketch(s).tobytes() if len(s) else b"")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(regs, pa.binary())], ["doc_id", "n_shingles", "k1", "k2", "registers"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, registers binary")


def shingle_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """doc_id, k1, hashes (little-endian) of the documents whose (doc_id, k1) is in ``ids``, from their whole texts."""
    few = F.broadcast(ids.select("doc_id").distinct()) if ids.count() <= IDS_BROADCAST else ids.select("doc_id").distinct()

    def run(batches):
        known = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingles(t.as_py(), width, known) for t in part.column(1)]
                keys = [np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)[0] for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "k1", "hashes"])

    made = docs.select("doc_id", "text").join(few, "doc_id", "left_semi").mapInArrow(run, "doc_id long, k1 long, hashes binary")
    return made.join(ids, ["doc_id", "k1"], "left_semi").dropDuplicates(["doc_id", "k1"])


def groups(batches, key_columns: int):
    """Runs of equal key of a sorted partition, as lists of columns; a run may cross batches."""
    held, held_key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(key_columns)], 1)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(keys)], strict=True):
            key = tuple(keys[a])
            if key != held_key and held:
                yield held_key, pa.Table.from_batches(held)
                held = []
            held_key = key
            held.append(batch.slice(a, b - a))
    if held:
        yield held_key, pa.Table.from_batches(held)


def stacked(column, dtype=np.uint16) -> np.ndarray:
    return np.stack([np.frombuffer(x.as_py(), dtype) for x in column])


def forest(n: int, edges) -> list[tuple[int, int]]:
    """The edges that join two trees, taken in order."""
    up = list(range(n))

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for a, b in edges:
        ra, rb = top(a), top(b)
        if ra != rb:
            up[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
    return out


def similar_pairs(sets: list[np.ndarray], split: int, percent: int) -> np.ndarray:
    """Index pairs with 100 * intersection >= percent * union, from one product of incidence matrices; with
    ``split`` over 0, only pairs of one below and one at or above it."""
    n = np.array([len(s) for s in sets])
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), n)
    left = np.arange(split) if split else np.arange(len(sets))
    right = np.arange(split, len(sets)) if split else left
    both = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(values), 4096):
        x = np.zeros((len(sets), min(4096, len(values) - at)), np.float32)
        here = (column >= at) & (column < at + 4096)
        x[row[here], column[here] - at] = 1
        both += x[left] @ x[right].T
    union = n[left][:, None] + n[right][None, :] - both
    a, b = np.nonzero(100 * both >= percent * union)
    pairs = np.stack([left[a], right[b]], 1)
    return pairs[pairs[:, 0] < pairs[:, 1]]


def candidates(classes: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, ka, b, kb) from buckets of up to LARGE members that the likelihood keeps, each from the first band
    they share; and the members (bucket, left, right, part, doc_id, k1) of the blocks of larger buckets."""
    bands = REGISTERS // BAND

    def banded(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = stacked(batch.column("registers"))
            keys = [xxhash.xxh3_64_intdigest(regs[i, k * BAND : (k + 1) * BAND].tobytes(), k) for i in range(len(regs)) for k in range(bands)]
            at = np.repeat(np.arange(len(regs)), bands)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(np.tile(np.arange(bands, dtype=np.int32), len(regs))), batch.column("doc_id").take(pa.array(at)), batch.column("k1").take(pa.array(at))], ["bucket", "band", "doc_id", "k1"])

    rows = stored(classes.select("doc_id", "k1", "registers").mapInArrow(banded, "bucket long, band int, doc_id long, k1 long"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("members"), F.min("band").alias("band"), F.sum(F.xxhash64("doc_id", "k1").cast("decimal(38,0)")).alias("who")).where("members > 1")
    # near copies meet in many bands; of buckets with the same members the first band's is enough
    sizes = sizes.groupBy("members", "who").agg(F.min_by("bucket", "band").alias("bucket")).select("bucket", "members")
    rows = stored(rows.join(sizes, "bucket"))
    sketches = classes.select(F.col("doc_id").alias("of"), F.col("k1").alias("of_k1"), "n_shingles", "registers")
    few = rows.where(F.col("members") <= LARGE).join(sketches, (F.col("doc_id") == F.col("of")) & (F.col("k1") == F.col("of_k1")))

    def compared(batches):
        for _, t in groups(batches, 1):
            if t.num_rows < 2:
                continue
            band = t.column("band")[0].as_py()
            regs, n = stacked(t.column("registers")), t.column("n_shingles").to_numpy()
            a, b = np.triu_indices(t.num_rows, 1)
            earlier = (regs[a, : band * BAND] == regs[b, : band * BAND]).reshape(len(a), band, BAND).all(2).any(1) if band else np.zeros(len(a), bool)
            a, b = a[~earlier], b[~earlier]
            if not len(a):
                continue
            ok = plausible(regs[a], regs[b], n[a], n[b], least)
            a, b = a[ok], b[ok]
            doc, k1 = t.column("doc_id").to_numpy(), t.column("k1").to_numpy()
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[a], k1[a], doc[b], k1[b])], ["a", "ka", "b", "kb"])

    pairs = few.select("bucket", "band", "doc_id", "k1", "n_shingles", "registers").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(compared, "a long, ka long, b long, kb long")

    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    part = F.pmod(F.xxhash64("doc_id", "k1"), blocks).cast("int")
    large = rows.where(F.col("members") > LARGE).withColumn("part", part).select("bucket", "part", "doc_id", "k1", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    large = large.select("bucket", F.least("part", "other").alias("left"), F.greatest("part", "other").alias("right"), "part", "doc_id", "k1")
    return pairs, large


def links(docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """src, dst: verified links that connect whatever is linked."""
    pairs, large = candidates(classes, percent / 100)
    pairs, large = stored(pairs.distinct()), stored(large)
    ids = pairs.select(F.col("a").alias("doc_id"), F.col("ka").alias("k1")).union(pairs.select("b", "kb")).union(large.select("doc_id", "k1")).distinct()
    sets = stored(shingle_sets(docs, stored(ids), width))
    left, right = (sets.select(F.col("doc_id").alias(x), F.col("k1").alias(f"k{x}"), F.col("hashes").alias(f"h{x}")) for x in "ab")

    def verified(batches):
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_py(), np.uint64) for c in ("ha", "hb"))
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in "ab"], ["src", "dst"])

    small = pairs.join(left, ["a", "ka"]).join(right, ["b", "kb"]).select("a", "b", "ha", "hb").mapInArrow(verified, "src long, dst long")

    def in_blocks(batches):
        for (_, lo, hi), t in groups(batches, 3):
            order = np.lexsort((t.column("doc_id").to_numpy(), t.column("part").to_numpy()))  # small ids first: blocks agree on their hubs
            sets = [np.frombuffer(t.column("hashes")[int(i)].as_py(), np.uint64) for i in order]
            doc = t.column("doc_id").to_numpy()[order]
            split = 0 if lo == hi else int((t.column("part").to_numpy() == lo).sum())
            if len(sets) < 2 or (lo != hi and not 0 < split < len(sets)):
                continue
            tree = forest(len(sets), similar_pairs(sets, split, percent).tolist())
            if tree:
                a, b = zip(*tree, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(doc[list(a)]), pa.array(doc[list(b)])], ["src", "dst"])

    hot = large.join(sets, ["doc_id", "k1"]).select("bucket", "left", "right", "part", "doc_id", "hashes").repartition("bucket", "left", "right").sortWithinPartitions("bucket", "left", "right").mapInArrow(in_blocks, "src long, dst long")
    return small.union(hot).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row: documents are linked when their sets of ``width``-word
    shingles have 100 * intersection >= percent * union, and a component is named by its smallest doc_id.

    Equal sets are one class from the start, so copies cost a partial minimum each. Texts that are null or have no word
    have the empty set and stand alone. Repeated rows, and rows that share a doc_id, count as one document. A row with
    null doc_id is kept unless its class has a document with an id. Other columns are left out; an empty table gives
    no rows. Words are runs of anything but space and \\t to \\r; only A-Z are lower-cased.
    """
    rows = stored(sketched(docs, width))
    classes = stored(rows.where("n_shingles > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers")))
    found = links(docs, classes.where("doc_id is not null"), width, percent)
    same = rows.where("n_shingles > 0").select("k1", "k2", "doc_id").distinct().join(classes.select("k1", "k2", F.col("doc_id").alias("rep")), ["k1", "k2"])
    # one id in two classes ties them
    tied = same.where("doc_id != rep").join(classes.select("doc_id").distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("src"), F.col("rep").alias("dst"))
    components = connected_components(found.union(tied))
    named = classes.select("k1", "k2", F.col("doc_id").alias("rep")).join(components, F.col("rep") == F.col("node"), "left").select("k1", "k2", F.coalesce("component", "rep").alias("component_id"))
    full = rows.select("doc_id", "n_shingles", "k1", "k2").join(named, ["k1", "k2"], "left")
    component = F.coalesce("component_id", "doc_id")
    return full.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, less all but one of each component of near-duplicate texts (see ``near_duplicates``).

    The row with the smallest doc_id stays; rows whose doc_id is null or shared come after all others, each decided by its
    own text. Of rows equal in doc_id and text one stays. Texts that are null or have no word all stay.
    """
    rows = keyed(docs)
    named = stored(near_duplicates(rows.select("doc_id", "text"), width, percent).where("n_shingles > 0").select("doc_id", "kept"))
    left = without(rows, stored(named.where("not kept").select("doc_id").distinct()))
    repeated = stored(named.where("kept").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    if repeated.limit(1).count():
        single = left.join(bounded(repeated), "doc_id", "left_semi").groupBy("doc_id").agg(F.first("row").alias("row"))
        left = without(left, repeated).select("doc_id", "row").unionByName(single)
    return opened(left, docs.columns)
