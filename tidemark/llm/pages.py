"""Main text of web pages: roles from the markup, repeated runs from suffix arrays over hosts.

A page becomes blocks of text, each inside or outside an article and with a boilerplate role, a hint of one, or none. The blocks
outside articles of one host, and those inside with a hint, are put one behind another as a token stream; a suffix array finds the long token
runs that distinct pages share. A page with an article keeps the blocks of its largest one that have no role, and of those with a hint the ones that shared
runs don't cover; a page without article text keeps the blocks that neither have a role or hint nor are covered by shared runs.
"""

from __future__ import annotations

import html as entities

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.minhash import groups
from tidemark.plans.shared import bounded, stored

#: Tokens of a shared run, distinct pages that share it, share of a block that makes it boilerplate, pages of a host block.
RUN, PAGES, COVERED, HOST_BLOCK = 5, 2, 0.6, 512
#: Most pages whose block numbers (about 150 bytes a page) are broadcast.
BROADCAST_PAGES = 200_000

#: Elements by their part in a page.
RAW = frozenset("script style noscript template iframe svg math object textarea title head".split())
ASIDE = frozenset("nav header footer aside form button select dialog menu label fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
#: Words of class and id attributes that mark boilerplate.
MARKS = regex.compile(
    r"(?i)(?<![a-z])(?:nav|navbar|navigation|menu|breadcrumbs?|header|masthead|topbar|footer|colophon|sidebar|aside|widgets?|ads?|adverts?|advertisement|advertisements|sponsor|sponsored|promo|promotion|banner|cookies?|consent|gdpr|notice|notices|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|search|share|sharing|social|related|recommended|trending|comments?|replies|reply|respond|disqus|pagination|pager|toolbar|skip)(?![a-z])"
)
#: Words that, beside a mark, name a part of a page and not a subject.
PARTS = frozenset("area bar block body bottom box btn button buttons cell col column container content control controls count field footer form frame global group header heading holder icon icons inner input item items label left link links list main mobile outer page panel placeholder post posts primary region right row secondary section site slot small text title top unit view wrap wrapper zone".split())
TAG = regex.compile(r"""<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:"[^"]*"|'[^']*'|[^'">])*)>""", regex.S)
ATTRIBUTE = regex.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")


def marked(value: str) -> int:
    """2 if some name in a class or id value is a mark, alone or with words for parts of a page or other marks; 1 if a name has a mark among other words, as ``share-price``; else 0."""
    found = 0
    for name in value.split():
        words = [w for w in regex.split(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])", name) if w]
        marks = [w for w in words if MARKS.fullmatch(w)]
        if marks:
            found = max(found, 2 if all(w in marks or w.lower() in PARTS for w in words) else 1)
    return found


def boilerplate(tag: str, attributes: str, in_article: bool) -> int:
    """2 if an element's name, role or names make it a part that isn't article text, 1 if its class or id only hints at that, else 0."""
    if tag in ASIDE and not (tag == "header" and in_article):
        return 2
    if not attributes:
        return 0
    hint = 0
    for m in ATTRIBUTE.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        name = m[1].lower()
        if name == "role" and value.lower() in ROLES or name in ("class", "id") and tag == "article" and regex.search(r"(?i)(?<![a-z])(comments?|reply|teaser|related|promo|ad)(?![a-z])", value):
            return 2
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and regex.search(r"display\s*:\s*none", value):
            return 2
        if name in ("class", "id") and tag not in ("article", "main", "body", "html"):
            hint = max(hint, marked(value))
    return 2 if hint == 2 or regex.search(r"(?<![\w-])hidden(?![\w-=])", ATTRIBUTE.sub("", attributes)) else hint


def blocks(html: str | None) -> list[tuple[str, int, int]]:
    """(text, article, role) of every non-empty block in page order. Articles (outermost article and main elements) are numbered from 1, 0 is outside; role is that of ``boilerplate``, the
    strongest around the block. References are decoded and white space is folded; a ``br`` is white space; inline markup adds none."""
    if not html:
        return []
    out: list[tuple[str, int, int]] = []
    open_tags: list[tuple[str, int, int]] = []
    state = (0, 0)
    held: list[str] = []
    articles = 0

    def close():
        text = " ".join(entities.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append((text, *state))

    at = 0
    while (m := TAG.search(html, at)) is not None:
        held.append(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, ends = m[2].lower(), bool(m[1])
        if tag == "br":
            held.append(" ")
            continue
        if tag not in INLINE:
            close()
        if tag in RAW and not ends:
            if m[3].endswith("/") and tag not in ("script", "style", "title", "textarea"):
                continue
            stop = regex.compile(rf"</{tag}\s*>", regex.I).search(html, at)
            at = stop.end() if stop else (len(html) if tag != "head" else at)
            continue
        if ends:
            where = next((k for k in range(len(open_tags) - 1, -1, -1) if open_tags[k][0] == tag), None)
            if where is not None:
                del open_tags[where:]
        elif tag not in VOID and not m[3].endswith("/"):
            if tag == "p" and open_tags and open_tags[-1][0] == "p":
                open_tags.pop()
            inside, role = (open_tags[-1][1:]) if open_tags else (0, 0)
            role = max(role, boilerplate(tag, m[3], bool(inside)))
            if not inside and (tag in ("article", "main") or 'role="main"' in m[3] or "articleBody" in m[3]):
                articles += 1
                inside = articles
            if tag in INLINE and role and not (open_tags and open_tags[-1][2]):
                close()
            open_tags.append((tag, inside, role))
        now = open_tags[-1][1:] if open_tags else (0, 0)
        if now != state:
            close()
            state = now
    held.append(html[at:])
    close()
    return out


def main_article(found: list[tuple[str, int, int]]) -> int:
    """The article with the most text of its own; 0 if no article has any."""
    size: dict[int, int] = {}
    for text, article, role in found:
        if article and role < 2:
            size[article] = size.get(article, 0) + len(text)
    return max(size, key=lambda a: (size[a], -a)) if size else 0


def suffix_array(x: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of an integer array in order, by prefix doubling; ranks are of RUN tokens or more."""
    rank = np.unique(x, return_inverse=True)[1].astype(np.int64)
    n, k = len(x), 1
    order = np.argsort(rank, kind="stable")
    while k < n and k < 2 * RUN:
        second = np.full(n, -1, np.int64)
        second[: n - k] = rank[k:]
        order = np.lexsort((second, rank))
        new = np.r_[0, np.cumsum((np.diff(rank[order]) != 0) | (np.diff(second[order]) != 0))]
        rank = np.empty(n, np.int64)
        rank[order] = new
        k *= 2
        if new[-1] == n - 1:
            break
    return order


def runs(tokens: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the runs of RUN tokens that stay in one page, the group of each start, and the distinct pages of each group.
    Neighbours in the suffix array with a common prefix of RUN tokens or more are a group."""
    if len(tokens) < RUN:
        return np.empty(0, int), np.empty(0, int), np.empty(0, int)
    order = suffix_array(tokens)
    padded = np.r_[tokens, np.full(RUN, -1, np.int64)]
    pages = np.r_[page, np.full(RUN, -1, np.int64)]
    same = np.ones(len(order) - 1, bool)
    whole = np.ones(len(order), bool)  # the run stays in one page
    for k in range(RUN):
        same &= padded[order[1:] + k] == padded[order[:-1] + k]
        whole &= pages[order + k] == page[order]
    group = np.r_[0, np.cumsum(~same)]
    ok = np.flatnonzero(whole)
    pairs = np.unique(np.stack([group[ok], page[order[ok]]], 1), axis=0)
    return order[ok], group[ok], np.bincount(pairs[:, 0], minlength=group[-1] + 1)


def shared_runs(tokens: np.ndarray, page: np.ndarray, elsewhere: np.ndarray | None = None, seed: int = 0) -> np.ndarray:
    """Which tokens lie in a run of RUN tokens that PAGES distinct pages share, or whose hash is among ``elsewhere``."""
    covered = np.zeros(len(tokens), bool)
    starts, group, n = runs(tokens, page)
    if not len(starts):
        return covered
    hit = n[group] >= PAGES
    if elsewhere is not None and len(elsewhere):
        hit |= np.isin(run_hashes(tokens, starts, seed), elsewhere)
    for k in range(RUN):
        covered[starts[hit] + k] = True
    return covered


def run_hashes(tokens: np.ndarray, starts: np.ndarray, seed: int) -> np.ndarray:
    """A hash of the run at each start and of its host, the same in every task."""
    out = np.full(len(starts), seed, np.int64).view(np.uint64)
    for k in range(RUN):
        out = (out ^ tokens[starts + k].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def streams(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """The token stream of the pages of a host block: word hashes, page and block of each word, and (row, block number) of each block."""
    words = [(k, b["n"], b["text"].split()) for k, row in enumerate(t.column("outer")) for b in row.as_py() or []]
    known: dict[str, int] = {}
    for w in {w for _, _, ws in words for w in ws}:
        known[w] = xxhash.xxh3_64_intdigest(w) >> 1
    size = np.array([len(ws) for _, _, ws in words], int)
    tokens = np.fromiter((known[w] for _, _, ws in words for w in ws), np.int64, int(size.sum()))
    page = np.repeat(np.array([k for k, _, _ in words], np.int64), size)
    return tokens, page, np.repeat(np.arange(len(words)), size), [(k, n) for k, n, _ in words]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, dropped (blocks of the page without a place in its article text), blocks_shared (of those outside an
    article, how many are covered by shared runs) for every row, from the whole html.

    Null or empty html gives an empty text, as does a page with nothing but boilerplate. Repeated rows are extracted alike
    and count as one page; a null url is a host of its own; an empty table gives no rows; other columns are left out.
    Hosts are cut into blocks of about HOST_BLOCK pages by hash, so a host of any size stays in bounded tasks. Runs are counted
    over all blocks of their host, so the cut changes no result: two pages that share a run are found on a host of any size.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/?#:]*)", 1))
    keyed = pages.select("page_id", "url", F.xxhash64("page_id", "url", "html").alias("key"), host.alias("host"), "html")

    def parse(batches):
        kind = pa.list_(pa.struct([("n", pa.int32()), ("text", pa.string()), ("role", pa.bool_())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                inner, own, outer, dropped = [], [], [], []
                for h in part.column("html"):
                    found = list(enumerate(blocks(h.as_py())))
                    article = main_article([b for _, b in found])
                    mine = [(k, t, role) for k, (t, a, role) in found if article and a == article and role < 2]
                    hinted = {k for k, _, role in mine if role}
                    inner.append(" ".join(t for _, t, _ in mine) if article and not hinted else None)
                    own.append([{"n": k, "text": t, "role": bool(role)} for k, t, role in mine] if hinted else None)
                    # outside an article a hint is a role; inside, shared runs decide on it
                    outer.append([{"n": k, "text": t, "role": role > 0 and k not in hinted} for k, (t, a, role) in found if not a or k in hinted])
                    dropped.append(len(found) - len(mine))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("page_id", "url", "key", "host")), pa.array(inner, pa.string()), pa.array(own, kind), pa.array(outer, kind), pa.array(dropped, pa.int32())], ["page_id", "url", "key", "host", "inner", "own", "outer", "dropped"])

    piece = "array<struct<n int, text string, role boolean>>"
    parsed = stored(keyed.mapInArrow(parse, f"page_id long, url string, key long, host string, inner string, own {piece}, outer {piece}, dropped int"))
    once = parsed.where(F.size("outer") > 0).select("host", "key", "outer").dropDuplicates(["host", "key"])
    parts = once.groupBy("host").agg(F.ceil(F.count("*") / HOST_BLOCK).alias("parts"))
    salted = once.join(parts, "host").select(F.xxhash64("host").alias("h"), F.pmod("key", "parts").alias("salt"), "parts", "key", "outer")

    def counted(batches):
        for (h, salt), t in groups(batches, 2):
            tokens, page, _, _ = streams(t)
            starts, group, n = runs(tokens, page)
            each, first = np.unique(group, return_index=True)  # one row a run, with the pages of this block
            yield pa.RecordBatch.from_arrays([pa.array(run_hashes(tokens, starts[first], h)), pa.array(n[each].astype(np.int32)), pa.array(np.full(len(each), h)), pa.array(np.full(len(each), salt))], ["run", "n", "h", "salt"])

    # a host in several blocks: its runs are counted over all of them, and those that several blocks share go back to each
    cut = salted.where("parts > 1").select("h", "salt", "key", "outer").repartition("h", "salt").sortWithinPartitions("h", "salt", "key")
    local = stored(cut.mapInArrow(counted, "run long, n int, h long, salt long"))
    across = stored(local.groupBy("run").agg(F.sum("n").alias("n"), F.count("*").alias("blocks")).where((F.col("n") >= PAGES) & (F.col("blocks") > 1)).select("run"))
    known = local.join(bounded(across), "run", "left_semi").groupBy("h", "salt").agg(F.collect_list("run").alias("runs"))
    with_runs = salted.select("h", "salt", "key", "outer").unionByName(known, allowMissingColumns=True)
    ready = with_runs.repartition("h", "salt").sortWithinPartitions("h", "salt", "key")

    def repeated(batches):
        for (h, _), t in groups(batches, 2):
            tokens, page, block, listed = streams(t)
            elsewhere = [r.values.to_numpy() for r in t.column("runs") if r.is_valid]
            covered = shared_runs(tokens, page, np.concatenate(elsewhere) if elsewhere else None, h)
            size = np.bincount(block, minlength=len(listed))
            hit = np.flatnonzero(np.bincount(block, covered, minlength=len(listed)) >= COVERED * np.maximum(size, 1))
            keys = t.column("key")
            yield pa.RecordBatch.from_arrays([pa.array([keys[listed[i][0]].as_py() for i in hit], pa.int64()), pa.array([listed[i][1] for i in hit], pa.int32())], ["key", "n"])

    shared = ready.mapInArrow(repeated, "key long, n int").groupBy("key").agg(F.collect_set("n").alias("shared"))
    # few columns of a bounded number of pages are broadcast, so that the texts needn't move
    joined = parsed.join(bounded(stored(shared.withColumnRenamed("key", "shared_key")), BROADCAST_PAGES), F.col("key") == F.col("shared_key"), "left")
    marks = F.coalesce("shared", F.array().cast("array<int>"))
    rest = F.filter("outer", lambda b: ~b["role"] & ~F.array_contains(marks, b["n"]))
    own = F.filter("own", lambda b: ~b["role"] | ~F.array_contains(marks, b["n"]))
    told = lambda kept: F.array_join(F.transform(kept, lambda b: b["text"]), " ")
    return joined.select("page_id", "url", F.coalesce("inner", told(own), told(rest), F.lit("")).alias("text"), "dropped", F.size(marks).alias("blocks_shared"))
