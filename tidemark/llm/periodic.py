"""Periodic runs of words: grams of the least guaranteed overlap seed diagonals of equal lag, which are extended once each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A run has at least so many words, and its period at least twice.
LEAST = 12
#: Words of documents that a task works on together; a longer document is worked on alone.
TOGETHER = 1 << 19

SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def paired(left: np.ndarray, right: np.ndarray, step: int) -> np.ndarray:
    """Class number of the gram made of the ``left`` gram at i and the ``right`` gram at i + step; -1 where it occurs once only."""
    out = np.full(len(left), -1, np.int32)
    at = np.flatnonzero((left[: len(left) - step] >= 0) & (right[step:] >= 0)) if step < len(left) else np.zeros(0, np.int64)
    if len(at):
        _, number, count = np.unique(left[at].astype(np.int64) * (int(right.max()) + 1) + right[at + step], return_inverse=True, return_counts=True)
        many = count[number] > 1
        out[at[many]] = number[many]
    return out


def seeds(gram: np.ndarray, words: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Places i and lags q, low <= q < high, where the gram at i stands at i + q too and the words before them differ.

    A pair whose words before agree lies on a diagonal that an earlier pair covers, so each diagonal is met once, at its
    start. Members of a class with equal words before are passed over in one step, so a stretch of one period costs
    a step a word, however often its grams occur.
    """
    at = np.flatnonzero(gram >= 0)
    order = at[np.argsort(gram[at], kind="stable")]
    kind, before, n = gram[order].astype(np.int64), words[order - 1], len(order)
    fresh = np.append(np.flatnonzero((kind[1:] != kind[:-1]) | (before[1:] != before[:-1])) + 1, n)
    following = fresh[np.searchsorted(fresh, np.arange(n), side="right")]
    place = kind * (len(gram) + high) + order
    i, j = np.arange(n), np.searchsorted(place, place + low)
    starts, lags = [], []
    while len(i):
        inside = j < n
        i, j = i[inside], j[inside]
        inside = (kind[j] == kind[i]) & (order[j] - order[i] < high)
        i, j = i[inside], j[inside]
        same = before[i] == before[j]
        starts.append(order[i[~same]])
        lags.append(order[j[~same]] - order[i[~same]])
        j = np.where(same, following[j], j + 1)
    return (np.concatenate(starts), np.concatenate(lags)) if starts else (np.zeros(0, np.int64),) * 2


def runs_of(words: np.ndarray, document: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period) of all runs in ``words``, by start and then period. Each document begins behind a word of
    its own that occurs nowhere else, and such a word ends the array. Work grows with n log n.

    Between lags k and 2k a run guarantees an overlap of k words, below that of half of ``least``; so the lags of each octave are
    seeded by its own grams, whose classes come from those of half the length.
    """
    k = least // 2
    levels = [(1, paired(document, words, 0))]
    while 2 * levels[-1][0] <= k:
        size, gram = levels[-1]
        levels.append((2 * size, paired(gram, gram, size)))
    size, gram = levels[-1]
    for smaller, other in [x for x in reversed(levels[:-1]) if k - size]:
        if smaller <= k - size:
            gram, size = paired(gram, other, size), size + smaller
    if size > levels[-1][0]:
        levels.append((size, gram))
    found, low = [], 1
    while (gram >= 0).any():
        found.append(seeds(gram, words, low, 2 * size))
        gram, low, size = paired(gram, gram, size), 2 * size, 2 * size
        levels.append((size, gram))
    if not found:
        return np.zeros((0, 3), np.int64)
    start, lag = (np.concatenate(x) for x in zip(*found, strict=True))
    end = start.copy()
    for size, gram in reversed(levels):  # what is left to extend is shorter than twice each level's grams
        end += size * ((gram[end] >= 0) & (gram[end] == gram[end + lag]))
    length = end - start + lag
    keep = length >= np.maximum(least, 2 * lag)
    start, length, lag = start[keep], length[keep], lag[keep]
    order = np.lexsort((lag, length, start))
    start, length, lag = start[order], length[order], lag[order]
    # one stretch under several periods: the smallest is its own
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    rows = np.stack([start, length, lag], 1)[first]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def found_in(texts: list[bytes], least: int) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """Of each text its number of words, its runs, and its words joined without the repeats."""
    split = [t.split() for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    flat = pa.array([w for one in split for w in one], pa.binary()).dictionary_encode()
    heads = np.append(0, np.cumsum(sizes + 1))  # place of the word before each document, and of the last word of all
    words = np.empty(heads[-1] + 1, np.int64)
    words[heads] = len(flat.dictionary) + np.arange(len(heads))
    inner = np.ones(len(words), bool)
    inner[heads] = False
    words[inner] = flat.indices.to_numpy(zero_copy_only=False)
    document = np.repeat(np.arange(len(heads), dtype=np.int64), np.append(sizes + 1, 1))
    rows = runs_of(words, document, least)
    at = np.searchsorted(rows[:, 0], heads)
    for d, own in enumerate(split):
        mine = rows[at[d] : at[d + 1]] - (heads[d] + 1, 0, 0)
        change = np.zeros(len(own) + 1, np.int64)
        np.add.at(change, mine[:, 0] + mine[:, 2], 1)
        np.add.at(change, mine[:, 0] + mine[:, 1], -1)
        gone = np.cumsum(change[:-1]) > 0
        yield len(own), mine, b" ".join([own[i] for i in np.flatnonzero(~gone)] if gone.any() else own)


def find_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (start, length, period, by start and then period) and collapsed for every row of ``docs``.

    Words are runs of anything but space and \\t to \\r, numbered from 0. A run is a stretch with smallest period q and at
    least max(least, 2 * q) words that can't be made longer on either side. collapsed is the words joined by one space, less
    those that some run holds behind its first q words. Null and empty texts have no words, no runs and collapsed ''. Rows are
    judged one by one: repeated rows and null ids stay as they are, other columns are left out, an empty table gives no rows.
    """

    def judged(batches):
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            begin, bulk = 0, 0
            size = [0 if x is None else x for x in pc.binary_length(texts).to_pylist()]
            for i in range(batch.num_rows + 1):
                if i < batch.num_rows and (i == begin or bulk + size[i] <= 6 * TOGETHER):
                    bulk += size[i]
                    continue
                if i == begin:
                    break
                part = [t or b"" for t in texts.slice(begin, i - begin).cast(pa.binary()).to_pylist()]
                n, runs, text = zip(*found_in(part, least), strict=True)
                every = np.concatenate(runs)
                entries = pa.StructArray.from_arrays([pa.array(every[:, c]) for c in range(3)], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(r) for r in runs])), pa.int32()), entries)
                yield pa.RecordBatch.from_arrays([ids.slice(begin, i - begin), pa.array(n, pa.int64()), lists, pa.array(text, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])
                begin, bulk = i, size[i] if i < batch.num_rows else 0

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(judged, SCHEMA)


def looped(text: Column, doc_id: Column) -> Column:
    """``text``, in one of ten documents with all words from one place on replaced by repeats of the words there, so that it
    has a run: with h the unsigned crc32 of the decimal doc_id and g = h div 10, place a = g mod n and period
    1 + (n - a) div (3 + g mod 8), where 10 divides h. Null ids, and texts without words, stay as they are."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    parts = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def again(words: Column) -> Column:
        n, g = F.size(words).cast("long"), F.floor(h / 10)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        one = F.struct(words.alias("words"), a.cast("int").alias("a"), p.cast("int").alias("p"), n.cast("int").alias("n"))
        return F.transform(F.array(one), lambda s: F.array_join(F.concat(F.slice(s["words"], 1, s["a"]), F.transform(F.sequence(s["a"], s["n"] - 1), lambda i: F.get(s["words"], s["a"] + (i - s["a"]) % s["p"]))), " "))[0]

    made = F.transform(F.array(parts), lambda words: F.when(F.size(words) > 0, again(words)))[0]
    return F.when((h % 10 == 0) & text.isNotNull(), F.coalesce(made, text)).otherwise(text)
