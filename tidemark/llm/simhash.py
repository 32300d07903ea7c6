"""SimHash near-duplicates: fingerprint segments decoded to Golay codewords, whose numbers are join keys that tolerate flipped bits."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.components import connected_components
from tidemark.plans.shared import bounded, stored

#: Generator polynomial of the binary Golay code of length 23, and its dimensions.
GENERATOR, LENGTH, CHECKS = 0xC75, 23, 11
#: Bits of the three segments of a fingerprint, from the lowest; a codeword has room for each.
SEGMENTS = (22, 21, 21)
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Differing bits up to which fingerprints are linked. The keys are made for just this number.
DISTANCE = 3
#: Members of a key that one task compares with as many others.
BLOCK = 1024
SEED = 42


def remainder(v: np.ndarray) -> np.ndarray:
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        v = np.where(v >> bit & 1, v ^ (GENERATOR << (bit - CHECKS)), v)
    return v


def error_table() -> np.ndarray:
    """The error of up to three bits behind each remainder: the code is perfect, so each has exactly one."""
    errors = np.array([sum(1 << b for b in bits) for n in range(4) for bits in itertools.combinations(range(LENGTH), n)])
    table = np.zeros(1 << CHECKS, np.int64)
    table[remainder(errors)] = errors
    return table


def codeword(v: np.ndarray, errors: np.ndarray) -> np.ndarray:
    """Number, 0 to 4095, of the codeword nearest to each word of 23 bits."""
    return (v ^ errors[remainder(v)]) >> CHECKS


def segments(prints: np.ndarray) -> list[np.ndarray]:
    at = np.cumsum((0, *SEGMENTS))
    return [(prints.view(np.uint64) >> np.uint64(a)).astype(np.int64) & (1 << w) - 1 for a, w in zip(at, SEGMENTS, strict=False)]


def own_keys(prints: np.ndarray, errors: np.ndarray) -> np.ndarray:
    """One key for each pair of segments: the two codewords' numbers."""
    own = [codeword(s, errors) for s in segments(prints)]
    return np.stack([n << 24 | own[i] << 12 | own[j] for n, (i, j) in enumerate(PAIRS)], 1)


def near_codewords(segment: np.ndarray, width: int, errors: np.ndarray) -> np.ndarray:
    """Codewords of the segment itself (first) and of all words one flipped bit away: six different ones at most; the rest repeat the first."""
    every = codeword(segment[:, None] ^ np.append(0, 1 << np.arange(width)), errors)
    own, ordered = every[:, :1], np.sort(every, 1)
    fresh = np.ones(ordered.shape, bool)
    fresh[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    fresh &= ordered != own
    out = np.repeat(own, 7, 1)
    row, col = np.nonzero(fresh)
    out[row, np.cumsum(fresh, 1)[row, col]] = ordered[row, col]
    return out


def sought_keys(prints: np.ndarray, errors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and keys under which any print within DISTANCE has one of its own keys.

    Of three flipped bits, either some pair of segments has at most one, or each segment has exactly one. So each pair is
    asked for with one bit flipped in either segment, and the first pair with one flipped in both.
    """
    near = [near_codewords(s, w, errors) for s, w in zip(segments(prints), SEGMENTS, strict=True)]
    found = []
    for n, (i, j) in enumerate(PAIRS):
        both = [near[i][:, :, None] << 12 | near[j][:, None, :]] if n == 0 else [near[i] << 12 | near[j][:, :1], near[i][:, :1] << 12 | near[j]]
        found += [n << 24 | b.reshape(len(prints), -1) for b in both]
    keys = np.concatenate(found, 1) | np.arange(len(prints))[:, None] << 26
    keys = np.unique(keys)
    return keys >> 26, keys & (1 << 26) - 1


def fingerprint(text: bytes | None, width: int) -> int:
    """Bitwise majority of the XXH64 of all shingles of ``width`` words, A-Z lower-cased; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    begin = np.append(0, np.cumsum([len(w) + 1 for w in words]))
    width = min(width, len(words))
    starts, ends = begin[: len(words) - width + 1].tolist(), (begin[width:] - 1).tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), 1 << 16):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)], strict=True)], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, print (long) of every row."""

    def made(batches):
        for batch in batches:
            texts = batch.column("text")
            prints = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else None, width) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.int64())], ["doc_id", "print"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(made, "doc_id long, print long")


def keyed(prints: DataFrame, keys) -> DataFrame:
    """key, print for all the keys that ``keys`` gives for the column print."""

    def made(batches):
        errors = error_table()
        for batch in batches:
            own = batch.column("print").to_numpy(zero_copy_only=False)
            rows, found = keys(own, errors)
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(own[rows])], ["key", "print"])

    return prints.select("print").mapInArrow(made, "key int, print long")


def spanning(close: np.ndarray) -> list[tuple[int, int]]:
    """Links (row, column) that connect whatever the matrix connects: a walk that enters each row and column once."""
    rows, cols = close.any(1), close.any(0)
    out = []
    while rows.any():
        todo = [(0, int(rows.argmax()))]
        rows[todo[0][1]] = False
        while todo:
            side, at = todo.pop()
            new = np.flatnonzero(close[:, at] & rows if side else close[at] & cols)
            (rows if side else cols)[new] = False
            out += [(int(x), at) if side else (at, int(x)) for x in new]
            todo += [(1 - side, int(x)) for x in new]
    return out


def links(prints: DataFrame) -> DataFrame:
    """src, dst: links between different ``prints`` (stored, distinct) with DISTANCE differing bits or fewer, enough to connect whatever is linked.

    Each print lies under three own keys and looks under all keys where a near one may lie. Looks that meet nothing but
    themselves or larger prints end before they are shuffled, as each pair is met from both sides. A key's prints are compared in blocks of
    about BLOCK by BLOCK, whose close pairs leave as a forest: no group of prints emits all its pairs.
    """
    index = stored(keyed(prints, lambda own, errors: (np.repeat(np.arange(len(own)), 3), own_keys(own, errors).reshape(-1))))
    held = stored(index.groupBy("key").agg(F.count("*").alias("members"), F.min("print").alias("lowest")))
    looks = keyed(prints, sought_keys).join(bounded(held), "key").where("lowest < print")
    looks = stored(looks.select("key", "print"))
    parts = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    sizes = looks.groupBy("key").agg(F.count("*").alias("looks")).join(held, "key")
    sizes = bounded(stored(sizes.select("key", parts(F.col("members")).alias("lefts"), parts(F.col("looks")).alias("rights"))))
    part = lambda n: F.pmod(F.xxhash64("print"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = index.join(sizes, "key").select("key", part("lefts").alias("left"), every("rights").alias("right"), F.lit(0).alias("side"), "print")
    right = looks.join(sizes, "key").select("key", every("lefts").alias("left"), part("rights").alias("right"), F.lit(1).alias("side"), "print")

    def compared(batches):
        rest = None
        for batch in itertools.chain(batches, [None]):
            rows = rest
            if batch is not None:
                rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], 1)
                rows = rows if rest is None else np.concatenate([rest, rows])
            if rows is None or not len(rows):
                continue
            cuts = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(1)) + 1
            bounds = np.append(0, cuts) if batch is not None else np.r_[0, cuts, len(rows)]  # a block may go on in the next batch
            rest = rows[bounds[-1] :]
            src, dst = [], []
            for a, b in itertools.pairwise(bounds.tolist()):
                split = a + int(np.searchsorted(rows[a:b, 3], 1))
                x, y = rows[a:split, 4], rows[split:b, 4]
                if not len(x) or not len(y):
                    continue
                close = (np.bitwise_count((x[:, None] ^ y).view(np.uint64)) <= DISTANCE) & (x[:, None] < y)
                if close.any():
                    i, j = zip(*spanning(close), strict=True)
                    src.append(x[list(i)])
                    dst.append(y[list(j)])
            if src:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], ["src", "dst"])

    blocks = left.unionAll(right).repartition("key", "left", "right").sortWithinPartitions("key", "left", "right", "side")
    return blocks.mapInArrow(compared, "src long, dst long").distinct()


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row: fingerprints of DISTANCE differing bits or fewer are linked, and a
    component is named by its smallest doc_id.

    Shingles count as often as they occur; a text of fewer words is one shingle; null texts and texts without words have
    fingerprint zero, which is linked like any other. Equal fingerprints are one class from the start, so copies cost a partial minimum
    each. Each row is judged by its own text: rows that share a doc_id may lie in different components. Rows with null doc_id get their
    component's smallest id, or null if it has none. Other columns are left out; an empty table gives no rows.
    """
    rows = stored(fingerprints(docs, width))
    classes = stored(rows.groupBy("print").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    parts = stored(connected_components(links(classes.select("print"))))
    linked = parts.select(F.col("node").alias("print"), "component").join(classes, "print")
    smallest = stored(linked.groupBy("component").agg(F.min("least").alias("component_id")))
    named = parts.join(bounded(smallest), "component").select(F.col("node").alias("print"), "component_id")
    copies = classes.where("n > 1").join(parts.select(F.col("node").alias("print")), "print", "left_anti").select("print", F.col("least").alias("component_id"))
    known = stored(named.unionByName(copies))
    found = rows.join(bounded(known), "print", "left")
    alone = F.when(F.col("component_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), alone.alias("component_id"))
