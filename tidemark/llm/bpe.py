"""Byte-pair encoding and decoding.

The encoder never replays merges. An Aho-Corasick automaton over the vocabulary gives the longest token
at each position of a piece; a greedy walk takes it when the pair with the token before is compatible
(the two tokens side by side would not have been merged differently), else tries the next shorter prefix
token, else steps back. Positions found dead are marked, so each is left once and time is linear.
Decoding slices one text blob by an offset table.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Words, and token pairs, kept in a worker's tables of what is known. A full table of pairs is emptied; of words, those not met since the last time
#: it was half full go, so memory stays bounded and frequent words stay.
CACHE_PIECES = 200_000

OUT = "doc_id long, n_tokens int, ids array<int>, decoded string"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself if it shows, else one above U+00FF."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Bpe:
    """A word-level BPE with an end-of-word mark, from a tokenizers-library JSON text.

    A word is a string over 512 symbols: 0-255 are bytes, 256-511 bytes that end a word. Token ids follow
    merge order, as the file must: base symbols first, then one token per merge.
    """

    def __init__(self, spec: str):
        spec = json.loads(spec)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids = model["vocab"]
        self.names = [""] * (1 + max([*ids.values(), *self.added.values()]))
        for name, i in [*ids.items(), *self.added.items()]:
            self.names[i] = name
        symbol = {c: chr(b) for b, c in enumerate(byte_alphabet())}

        def coded(name: str) -> str:
            if self.end and name.endswith(self.end) and name != self.end:
                body = name[: -len(self.end)]
                return "".join(symbol[c] for c in body[:-1]) + chr(256 + ord(symbol[body[-1]]))
            return "".join(symbol[c] for c in name)

        self.of = {coded(n): i for n, i in ids.items()}
        self.text = {i: s for s, i in self.of.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for n, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            merged = ids[a + b]
            self.rank[ids[a], ids[b]] = n
            if merged in self.parts:
                raise ValueError(f"two merges make token {merged}; the pair check needs one")
            self.parts[merged] = (ids[a], ids[b])
        self.order = {t: self.rank[p] for t, p in self.parts.items()}
        self.automaton = ahocorasick.Automaton()
        for s, i in self.of.items():
            self.automaton.add_word(s, (len(s), i))
        self.automaton.make_automaton()
        self.shorter: dict[int, int | None] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        pieces = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.piece = regex.compile(pieces["pattern"]["Regex"])
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.space = regex.compile(r"\s+")
        blob = [n.encode() + b" " for n in self.names]
        self.offsets = np.concatenate([[0], np.cumsum([len(b) for b in blob])]).astype(np.int64)
        self.blob = np.frombuffer(b"".join(blob), np.uint8)
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE of the joined texts is exactly (left, right), from the merge trees along the seam.

        Walks both seams from the last merge to the first: undo the later of the two merges; if the two
        tokens now at the seam have a merge that comes before the undone one, BPE would have crossed it.
        """
        if (known := self.fits.get((left, right))) is not None:
            return known
        a, b, limit, good = left, right, float("inf"), True
        while True:
            n = self.rank.get((a, b))
            if n is not None and n < limit:
                good = False
                break
            ra, rb = self.order.get(a, -1), self.order.get(b, -1)
            if ra < 0 and rb < 0:
                break
            if ra > rb:  # of equal ranks the left merge happens first, so the right one is undone first
                limit, a = ra, self.parts[a][1]
            else:
                limit, b = rb + 0.5, self.parts[b][0]
        if len(self.fits) >= CACHE_PIECES:
            self.fits.clear()
        self.fits[left, right] = good
        return good

    def prefix(self, token: int) -> int | None:
        """The longest token that is a proper prefix of ``token``."""
        if token not in self.shorter:
            s = self.text[token]
            self.shorter[token] = next((self.of[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in self.of), None)
        return self.shorter[token]

    def word(self, word: str) -> list[int]:
        """Token ids of one coded word."""
        longest = [-1] * len(word)
        size = [0] * len(word)
        for end, (n, i) in self.automaton.iter(word):
            if n > size[end - n + 1]:
                size[end - n + 1], longest[end - n + 1] = n, i
        dead = bytearray(len(word) + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            while token is not None:
                end = at + len(self.text[token])
                if not dead[end] and (not out or self.compatible(out[-1], token)):
                    break
                token = self.prefix(token)
            if token is None:
                dead[at] = 1
                token = out.pop()
                at -= len(self.text[token])
                token = self.prefix(token)
                continue
            out.append(token)
            at = end
            if at == len(word):
                return out
            token = longest[at]

    def ids_of(self, piece: str) -> bytes:
        raw = piece.encode().decode("latin-1")
        if self.end:
            raw = raw[:-1] + chr(256 + ord(raw[-1]))
        return np.array(self.word(raw), np.int32).tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text; null counts as empty."""
        if not text:
            return np.empty(0, np.int32)
        out: list[bytes] = []
        parts = self.special.split(text) if self.special and self.special.search(text) else [text]
        for part in parts:
            if part in self.added:
                out.append(np.int32(self.added[part]).tobytes())
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part)
            part = self.space.sub(" ", part).replace("Σ", "σ").lower()
            for p in self.piece.findall(part):
                ids = self.known.get(p)
                if ids is None:
                    if 2 * len(self.known) >= CACHE_PIECES:
                        self.known, self.before = {}, self.known
                    ids = self.known[p] = self.before.get(p) or self.ids_of(p)
                out.append(ids)
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """Token texts joined by single spaces, in UTF-8: one gather over the blob by the offset table."""
        if not len(ids):
            return b""
        start, n = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        total = np.cumsum(n)
        where = np.arange(total[-1], dtype=np.int64) + np.repeat(start - (total - n), n)
        return self.blob[where].tobytes()[:-1]


@lru_cache(maxsize=1)
def built(spec: str) -> Bpe:
    """The tables of ``spec``, made once in a worker and used by all its tasks."""
    return Bpe(spec)


def encode_decode(docs: DataFrame, spec_path: str, finish=None, schema: str = OUT) -> DataFrame:
    """Encodes the whole ``text`` of every row and decodes the ids again.

    Returns doc_id, n_tokens, ids, decoded; or what ``finish(ids, decoded_utf8)`` gives for ``schema``, so a
    caller that only needs digests doesn't ship the ids. Null and empty texts have no ids and decode to "".
    Rows are kept one for one, repeated or not; other columns are left out. No shuffle: one pass of Arrow batches.
    """
    with open(spec_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    give = finish or (lambda ids, decoded: (len(ids), ids.tolist(), decoded.decode()))

    def run(batches):
        bpe = built(spec.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for text in part.column(1):
                    ids = bpe.encode(text.as_py())
                    rows.append(give(ids, bpe.decode(ids)))
                cols = [part.column(0), *(list(c) for c in zip(*rows, strict=True))]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema).fields
    names, types = [f.name for f in fields], [to_arrow_type(f.dataType) for f in fields]
    return docs.select("doc_id", "text").mapInArrow(run, schema)
