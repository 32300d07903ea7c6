"""Toxicity scores from a learned lexicon, matched in spite of misspelling.

Terms that mark toxic texts (whole words, and stems of long words) are counted over all labelled rows. A
trie of the terms is intersected with Levenshtein automata; the product is made deterministic state by state
as words are read, so a word costs one table look-up per character and most words die after a few. Hits are
kept apart by context: plain, and quoted or reported ones. A logistic model weighs the hits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lexicon size; letters of stems; least toxic rows with a term; least lowered log odds; labelled rows for the fit of the weights.
TERMS, STEMS, LEAST, ODDS, FIT_ROWS = 4000, (5, 7), 3, 1.5, 20_000
#: Letters from which one edit is allowed.
FUZZY_FROM = 5
#: Words on either side that are looked through for signs of quotation.
CONTEXT = 4
#: Words by which a text reports what others say.
REPORTING = frozenset("said says wrote called quote quoted quoting reported dit disait cite sagte schrieb zitat dijo escribió cita".split())
CACHE_WORDS, CACHE_STATES = 300_000, 200_000

WORD = regex.compile(r"[^\W_]+")
FEATURES = 8


def lexicon(labelled: DataFrame) -> DataFrame:
    """term, weight: the TERMS terms with the highest log odds of toxic against other rows, each odds lowered by 1.64
    of its standard errors so that rare terms don't lead by chance. A stem (first letters of
    a longer word) ends in ``*``. Counts are of all labelled rows (``text``, ``toxic``) that have a term; a row given twice counts twice. Ties go by term. Without labelled
    rows, or without toxic ones, there are no terms."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    stems = [F.array_distinct(F.transform(F.filter(words, lambda w, n=n: F.length(w) > n), lambda w, n=n: F.concat(F.substring(w, F.lit(1), F.lit(n)), F.lit("*")))) for n in STEMS]
    rows = labelled.where("text is not null and toxic is not null").select(F.explode(F.concat(words, *stems)).alias("term"), "toxic")
    counts = rows.groupBy("term").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n")).where(F.col("p") >= LEAST)
    totals = labelled.where("text is not null and toxic is not null").agg(F.sum("toxic").alias("tp"), F.sum(1 - F.col("toxic")).alias("tn")).first()
    tp, tn = float(totals["tp"] or 0), float(totals["tn"] or 0)
    odds = F.ln((F.col("p") + 0.5) / (tp + 1)) - F.ln((F.col("n") + 0.5) / (tn + 1))
    odds = odds - 1.64 * F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("n") + 0.5))
    return counts.select("term", odds.alias("weight"), "p").where(F.col("weight") >= ODDS).orderBy((F.col("weight") * F.ln("p")).desc(), "term").limit(TERMS).select("term", "weight")


class Known(dict):
    """What has been found for each word; a full table is emptied."""

    def __init__(self, find):
        self.find = find

    def __missing__(self, word: str):
        if len(self) >= CACHE_WORDS:
            self.clear()
        out = self[word] = self.find(word)
        return out


class Matcher:
    """Deterministic product of a lexicon trie with Levenshtein automata of one edit."""

    def __init__(self, terms: list[tuple[str, float]]):
        self.next: list[dict[str, int]] = [{}]
        self.term: list[int] = [-1]
        self.stem: list[int] = [-1]
        self.weights = np.array([w for _, w in terms], np.float32)
        for i, (t, _) in enumerate(terms):
            at = 0
            for c in t.rstrip("*"):
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.term.append(-1)
                    self.stem.append(-1)
                at = self.next[at][c]
            (self.stem if t.endswith("*") else self.term)[at] = i
        self.known = Known(self.find)
        self.clear()

    def clear(self):
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.move: dict[tuple[int, str], int] = {}
        self.start = self.state(self.closed({(0, 0)}))

    def closed(self, items: set) -> frozenset:
        """Adds what one skipped term character leads to, and drops what a state with fewer edits covers."""
        out = dict()
        for node, edits in items:
            out[node] = min(edits, out.get(node, 9))
        for node, edits in list(out.items()):
            if edits == 0:
                for child in self.next[node].values():
                    out[child] = min(1, out.get(child, 9))
        return frozenset(out.items())

    def state(self, s: frozenset) -> int:
        if s not in self.ids:
            self.ids[s] = len(self.sets)
            self.sets.append(s)
        return self.ids[s]

    def step(self, state: int, c: str) -> int:
        to = self.move.get((state, c))
        if to is None:
            new = set()
            for node, edits in self.sets[state]:
                if c in self.next[node]:
                    new.add((self.next[node][c], edits))
                if edits == 0:
                    new.add((node, 1))
                    new.update((child, 1) for child in self.next[node].values())
            to = self.move[state, c] = self.state(self.closed(new)) if new else -1
        return to

    def find(self, word: str) -> tuple[int, bool] | None:
        """(term, exact) of a lower-case word, or None: the heaviest of the whole word and its stems, else a word one edit away."""
        at, best = 0, -1
        for k, c in enumerate(word):
            at = self.next[at].get(c, -1)
            if at < 0:
                break
            for i in (self.stem[at] if k + 1 < len(word) else -1, self.term[at] if k + 1 == len(word) else -1):
                if i >= 0 and (best < 0 or self.weights[i] > self.weights[best]):
                    best = i
        if best >= 0:
            return best, True
        if len(word) < FUZZY_FROM:
            return None
        if len(self.move) >= CACHE_STATES:
            self.clear()
        s = self.start
        for c in word:
            s = self.step(s, c)
            if s < 0:
                return None
        hits = [self.term[node] for node, edits in self.sets[s] if edits <= 1 and self.term[node] >= 0]
        return (max(hits, key=lambda i: self.weights[i]), False) if hits else None


def hits_of(text: str | None, matcher: Matcher) -> list[tuple[int, int, int, bool, bool]]:
    """(start, stop, term, exact, quoted) of each hit in a whole text. Quoted: between quotation marks on one
    line, or within CONTEXT words of a reporting word."""
    if not text:
        return []
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    words, known, out = WORD.findall(low), matcher.known, []
    found = [k for k, w in enumerate(words) if known[w]]
    if not found:
        return []
    spans = [m.span() for m in WORD.finditer(low)]
    for k in found:
        a, b = spans[k]
        line = low.rfind("\n", 0, a) + 1
        marks = sum(low.count(q, line, a) for q in '"“”«»„')
        quoted = marks % 2 == 1 or any(w in REPORTING for w in words[max(0, k - CONTEXT) : k + CONTEXT + 1])
        term, exact = known[words[k]]
        out.append((a, b, term, exact, quoted))
    return out


def features(hits: list, size: int, matcher: Matcher) -> np.ndarray:
    """Of the hits of a text of ``size`` characters: summed and largest weights of plain exact, plain inexact and quoted hits, their density, and a constant."""
    x = np.zeros(FEATURES, np.float32)
    x[7] = 1
    for _, _, term, exact, quoted in hits:
        w, k = matcher.weights[term], 4 if quoted else 0 if exact else 2
        x[k] += w
        x[k + 1] = max(x[k + 1], w)
    x[6] = min(1.0, 200 * (x[0] + x[2] + x[4]) / max(200, size) / 10)
    x[[0, 2, 4]] = np.log1p(x[[0, 2, 4]])
    return x


def train(labelled: DataFrame) -> dict:
    """Lexicon and weights from rows with doc_id, text, toxic (0/1). Counts use all rows; the eight weights are fitted
    on the rows of the FIT_ROWS smallest hashes of doc_id; rows that share one of these ids all count. Without rows of both kinds every text scores the share of label 1, or 0."""
    rows = labelled.where("toxic is not null").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    terms = [(r["term"], float(r["weight"])) for r in lexicon(rows).collect()]
    shared = rows.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        matcher = Matcher(shared.value)
        for batch in batches:
            x = [features(hits_of(t, matcher), len(t or ""), matcher).tobytes() for t in (c.as_py() for c in batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), batch.column(1)], ["x", "toxic"])

    ids = rows.select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(FIT_ROWS).select("doc_id").distinct()
    got = rows.join(F.broadcast(ids), "doc_id", "left_semi").select("text", "toxic").mapInArrow(run, "x binary, toxic int").collect()
    w = np.zeros(FEATURES, np.float32)
    if got:
        x = np.stack([np.frombuffer(r["x"], np.float32) for r in got])
        y = np.array([float(r["toxic"] > 0) for r in got])
        order = np.lexsort(np.c_[x, y].T)
        x, y = x[order], y[order]
        share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        w[7] = np.log(share / (1 - share))
        # Newton steps with a little ridge: few weights, so a handful of rounds settles it
        for _ in range(25 if 0 < y.mean() < 1 else 0):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (p - y) + 0.1 * w
            h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(FEATURES)
            w = w - np.clip(np.linalg.solve(h, g), -3, 3).astype(np.float32)
    else:
        w[7] = -9
    return {"terms": terms, "w": w}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score, spans (start, stop, term, exact, quoted) for every row, from its whole text.

    Null and empty texts score as texts without a hit; repeated rows score alike; an empty table gives no rows; other
    columns are left out. No shuffle: the model, bounded by TERMS terms, goes to every worker.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("term", pa.string()), ("exact", pa.bool_()), ("quoted", pa.bool_())]))

    def run(batches):
        model = shared.value
        matcher = Matcher(model["terms"])
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [t.as_py() for t in part.column(1)]
                hits = [hits_of(t, matcher) for t in texts]
                x = np.stack([features(h, len(t or ""), matcher) for h, t in zip(hits, texts, strict=True)])
                p = 1 / (1 + np.exp(-np.clip(x @ model["w"], -30, 30)))
                spans = [[{"start": a, "stop": b, "term": model["terms"][k][0], "exact": e, "quoted": q} for a, b, k, e, q in h] for h in hits]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p.astype(np.float64)), pa.array(spans, span)], ["doc_id", "score", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, spans array<struct<start int, stop int, term string, exact boolean, quoted boolean>>")
