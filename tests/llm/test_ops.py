"""Each operator on small rows against brute force, with nulls, empties, repeats and clashing columns."""

import collections
import hashlib
import html as entities
import random
import re
import unicodedata

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontam, fingerprint, langid, licenses, linededup, minhash, pages, secrets, toxicity
from tidemark.llm.queries import QUERIES, digests, tokenizer_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, key string, n int, line int, score double"


def docs(spark, rows):
    """Documents with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "k", 1, 2, 0.5) for i, t in rows], DOCS)


def table(spark, name="documents"):
    return spark.read.parquet(f"{SF}/{name}.parquet")


ODD = [(1, None), (2, ""), (3, "  \n\t "), (None, "one two three four five six"), (4, "one two three four five six"), (4, "one two three four five six"), (5, "word " * 30000), (6, "Ünï çødé 漢字 \U0001f600 end")]


@pytest.mark.parametrize("op", [
    lambda d: bpe.encode_decode(d, tokenizer_path()), lambda d: minhash.near_duplicates(d), linededup.dedup_lines, secrets.scan, fingerprint.fingerprint_edits, fingerprint.duplicate_groups,
    lambda d: langid.predict(d, None), lambda d: toxicity.score(d, {"terms": [("bad", 1.0)], "w": np.zeros(8, np.float32)}),
])
def test_one_row_per_row(spark, op):
    assert op(docs(spark, ODD)).count() == len(ODD)
    assert op(docs(spark, [])).count() == 0


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    t, own = Tokenizer.from_file(tokenizer_path()), bpe.Bpe(open(tokenizer_path(), encoding="utf-8").read())
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("aabbceehhtthinrré ñßΣσ'sİ1٣½ \u0085\t\n.,!?–\U0001f916Ωá中한ǅ<|") for _ in range(rnd.randint(0, 60))) for _ in range(2000)]
    for x in [*texts, "a<|endoftext|>b <|startoftext|>", "A" * 3000, "thethethe" * 300]:
        want = t.encode(x, add_special_tokens=False).ids
        ids = own.encode(x)
        assert ids.tolist() == want and own.decode(ids).decode() == t.decode(want, skip_special_tokens=False)
    got = {r.doc_id: r for r in QUERIES["op1_bpe"](spark, SF).collect()}
    for r in table(spark).collect():
        e = t.encode(r.text or "", add_special_tokens=False).ids
        assert tuple(got[r.doc_id])[1:] == digests(np.array(e, np.int32), t.decode(e, skip_special_tokens=False).encode())


def brute_components(rows, width, percent=80):
    sets = collections.defaultdict(set)
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), top(d)) for d in ids}


def test_minhash_equals_all_pairs(spark, monkeypatch):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    base = [rnd.choice(words) for _ in range(120)]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 40)))) for i in range(40)]
    for i in range(40, 160):  # a group of edited copies, some too far
        t = list(base)
        for _ in range(rnd.choice([0, 1, 2, 3, 5, 8])):
            t[rnd.randrange(len(t))] = rnd.choice(words)
        rows.append((i, " ".join(t)))
    want = brute_components(rows, 4)
    for large, block in ((64, 512), (8, 16)):
        monkeypatch.setattr(minhash, "LARGE", large)
        monkeypatch.setattr(minhash, "BLOCK", block)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs(spark, rows), 4).collect()}
        assert got == want


def test_minhash_registers():
    rnd = np.random.default_rng(2)
    a, b = np.unique(rnd.integers(0, 2**63, 900).astype(np.uint64)), np.unique(rnd.integers(0, 2**63, 900).astype(np.uint64))
    both = np.unique(np.r_[a, b])
    assert (np.maximum(minhash.sketch(a), minhash.sketch(b)) == minhash.sketch(both)).all()
    n = lambda x: np.array([len(x)])
    assert minhash.plausible(minhash.sketch(a)[None], minhash.sketch(a)[None], n(a), n(a), 0.8)[0]
    assert not minhash.plausible(minhash.sketch(a)[None], minhash.sketch(b)[None], n(a), n(b), 0.8)[0]


def brute_lines(rows):
    items = [((d, i), set(x.lower().split())) for d, t in rows for i, x in enumerate(t.split("\n"))]
    items = sorted([x for x in items if x[1]], key=lambda x: x[0])
    gone = set()
    for k, (pos, w) in enumerate(items):
        if any(180 * len(v & w) >= 80 * (len(v) + len(w)) for _, v in items[:k]):
            gone.add(pos)
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in rows}


def test_lines_equal_all_pairs(spark):
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    lines = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 30))) for _ in range(60)]
    rows = []
    for d in range(60):
        own = [rnd.choice(lines).split(" ") for _ in range(rnd.randint(0, 6))]
        for w in own:
            for _ in range(rnd.choice([0, 0, 1, 3])):
                w[rnd.randrange(len(w))] = rnd.choice(words)
        rows.append((d, "\n".join(" ".join(w) for w in own)))
    assert {r.doc_id: r.text for r in linededup.dedup_lines(docs(spark, rows)).collect()} == brute_lines(rows)
    small = [(r.doc_id, r.text) for r in table(spark).collect()]
    assert {r.doc_id: r.text for r in QUERIES["op3_linededup"](spark, SF).collect()} == brute_lines(small)


def test_lines_keep_columns_and_odd_rows(spark):
    rows = [(1, "a b c d e f"), (2, None), (3, "A  b c\td e F\nshort"), (3, "A  b c\td e F\nshort"), (4, "Short \n\n  "), (5, "")]
    out = linededup.dedup_lines(docs(spark, rows))
    assert out.columns == [*DOCS.replace(",", " ").split()[::2], "lines_removed"]
    assert sorted((r.doc_id, r.text, r.lines_removed) for r in out.collect()) == [(1, "a b c d e f", 0), (2, None, 0), (3, "short", 1), (3, "short", 1), (4, "\n  ", 1), (5, "", 0)]


def test_lines_of_texts_that_share_an_id(spark):
    """Texts with one doc_id, or none, lose only their own lines; names used inside don't clash with the caller's."""
    schema = "doc_id long, text string, doc long, text_hash long, listed string, lines_removed string, row string, `a.b` int, line int"
    texts = [(7, "x y z one\nsame line here"), (7, "same line here\nx y z two"), (None, "same line here\nnull one"), (None, "null one\nnull two"), (8, "x y z one\nnull two\nlast")]
    df = spark.createDataFrame([(i, t, -1, -2, "l", "r", "w", 3, 4) for i, t in texts], schema)
    out = linededup.dedup_lines(df)
    assert out.columns == df.columns
    rows = out.collect()
    assert all((r.doc, r.text_hash, r.listed, r.row, r["a.b"], r.line) == (-1, -2, "l", "w", 3, 4) for r in rows)
    kept = sorted(x for r in rows for x in r.text.split("\n") if x)
    assert kept == sorted(["x y z one", "same line here", "x y z two", "null one", "null two", "last"])
    assert sum(r.lines_removed for r in rows) == 5
    assert sorted(x for r in linededup.dedup_lines(df, count_as=None).collect() for x in [r.lines_removed]) == ["r"] * 5


def test_lines_of_a_hot_group(spark):
    """Hundreds of lines alike, every pair near the threshold, and words that nearly every line holds."""
    rnd = random.Random(3)
    base = [f"b{i}" for i in range(24)]
    rows = []
    for d in range(250):
        w = list(base)
        for _ in range(rnd.choice([0, 1, 1, 2, 2, 3])):
            w[rnd.randrange(24)] = f"e{rnd.randrange(10**6)}"
        rows.append((d, " ".join(w) + "\n" + " ".join(rnd.choice("the of and in to".split()) for _ in range(rnd.randint(1, 4)))))
    assert {r.doc_id: r.text for r in linededup.dedup_lines(docs(spark, rows)).collect()} == brute_lines(rows)


@pytest.mark.parametrize("percent", [80, 65])
def test_lines_filters_in_whole_numbers(spark, percent):
    """The filters of the joins let pass what the bounds of the similarity let pass, without a division or rounding for each pair."""
    cases, top = [], 24
    for n in range(1, top + 1):
        for at in range(n - -(-n * percent // 100) + 1):
            cases.append((n, at, (1 << n) - 1))
    rows = spark.createDataFrame(cases, "n int, at int, bits long").select("*", F.lit(1).alias("key"), linededup.room(percent).alias("room"))
    pairs = rows.alias("a").join(rows.alias("b"), linededup.plausible(percent, ("bits",)))
    said = pairs._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[1].split("\n", 1)[0]
    assert "FLOOR" not in said and " / " not in said and " div " not in said
    want = set()
    for n, at, _ in cases:
        for m, by, _ in cases:
            least = -(-percent * (n + m) // (100 + percent))
            if abs(n - m) <= n + m - 2 * least and min(n - at, m - by) >= least and at + by <= n + m - 2 * least and 100 * min(n, m) >= percent * max(n, m):
                want.add((n, at, m, by))
    assert {tuple(r) for r in pairs.select("a.n", "a.at", "b.n", "b.at").collect()} == want


def test_toxicity_matches_misspellings_and_quotes(spark):
    m = toxicity.Matcher([("idiot", 3.0), ("worthless", 2.0), ("scum", 2.0), ("lowei*", 1.0)])
    found = lambda t: [(m_[2], m_[3], m_[4]) for m_ in toxicity.hits_of(t, m)]
    assert found("You IDIOT, idiott and idi0t") == [(0, True, False), (0, False, False), (0, False, False)]
    assert found("scam") == [] and found("loweischaft") == [(3, True, False)]
    assert found('he "idiot" there') == [(0, True, True)] and found("she called me worthless") == [(1, True, True)]
    words = ["".join(random.Random(k).choices("idotwrhles", k=random.Random(k).randint(5, 9))) for k in range(3000)]

    def near(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1] <= 1

    for w in words:
        assert (m.find(w) is not None) == (near(w, "idiot") or near(w, "worthless") or near(w, "scum") or (w.startswith("lowei") and len(w) > 5))


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    got = QUERIES["op4_toxicity"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out")
    n = {(r.toxic, r.predicted): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.8 and n.get((0, 1), 0) / n[0, 0] < 0.02


def test_secrets_equal_plain_patterns(spark):
    assign = re.compile(r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    rows = [(1, None), (2, "secret: token: abcdef password=12345"), (3, "é\U0001f600 API_KEY = 'abc/def+12' AKIA" + "A1" * 9 + " x" + "0f" * 15), (4, "\u0001\u0002token=aaaaaaa\u0001"), (5, "key Zk3" + "Qx9fT7LmW2pR8sVbN4" + " here"), (6, "ordinary_identifier_name_without_digits and configuration_of_international_conversation2"), (7, "administration international conversation communication understanding responsibilities transformation configuration " * 30)]
    got = {r.doc_id: r.spans for r in secrets.scan(docs(spark, rows)).collect()}
    for d, t in rows:
        t = t or ""
        want = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert [(s.start, s.kind, s.stop) for s in got[d] if s.kind < 3] == sorted(want)
        assert all(t[s.start : s.stop].replace("\u0001", "\u0003").replace("\u0002", "\u0003") == s.value for s in got[d])
    assert [s.kind for s in got[5]] == [3] and got[6] == []


def test_secrets_of_the_models(spark):
    """Held-out recall and false alarms of the labelled samples; identifiers that look odd stay, random strings without a pattern go."""
    rows = table(spark).select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    base = F.concat(*[secrets.spans_of(F.col("t"), secrets.PATTERNS[k], i, secrets.long_value if k == "assign" else None) for i, k in enumerate(secrets.KINDS[:3])])
    model, threshold, held = secrets.trained(*secrets.samples(rows, rows.select(F.explode(base).alias("s"))))
    assert held["recall"] >= 0.95 and held["false_alarms"] <= 0.002
    ordinary = "sha256_digest_of_block_0001 aws_s3_bucket_name_prefix_01 utf8mb4_unicode_520_ci_index path/to/articles/item1234567 2024-01-15T10-30-00 ISBN-978-3-16-148410-0 550e8400-e29b-41d4-a716-446655440000 international_conversation2 INTERNATIONAL_CONVERSATIONS getUserProfileByAccountId2".split()
    odd = "Zk3Qx9fT7LmW2pR8sVbN4 qwKzXvBnMpLrTyHs kq7xw2m9vzt4pjs8 aB3dE5fG7hJ9kL1mN2pQ wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY".split()
    lead = {r.token: r.lead for r in secrets.leads(spark.createDataFrame([(t,) for t in ordinary + odd], "token string"), model).collect()}
    assert all(lead[t] < threshold for t in ordinary) and all(lead[t] >= threshold for t in odd)


def test_fingerprints(spark):
    canon = lambda t: re.sub(r"\s+", " ", unicodedata.normalize("NFC", t).lower()).strip(" ")
    fp = lambda t: f"{xxhash.xxh64_intdigest(canon(t).encode(), 42):016x}{xxhash.xxh64_intdigest(canon(t).encode(), xxhash.xxh64_intdigest(b'wide', 42)):016x}"
    rows = [(5, "Café  X"), (4100, "café x"), (2050, "CAFÉ X "), (7, None), (9000, "abc" * 100), (1, "")]
    order = sorted(((d, t or "") for d, t in rows), reverse=True)
    got = {r.doc_id: r for r in fingerprint.fingerprint_edits(docs(spark, rows)).collect()}
    for i, (d, t) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1]
        k = len(t) // 3
        e = t[: len(t) - k] + nxt[:k]
        assert tuple(got[d])[1:7] == (len(t), e, fp(t), fp(e), float(fp(t) == fp(e)), float(fp(t) == fp(nxt)))
    groups = {r.doc_id: (r.group_doc, r.group_size) for r in fingerprint.duplicate_groups(docs(spark, rows)).collect()}
    assert groups[4100] == groups[5] == groups[2050] == (5, 3) and groups[7] == (1, 2)
    assert groups == {d: (r.group_doc, r.group_size) for d, r in got.items()}


def test_fingerprints_that_collide(spark, monkeypatch):
    """Where digests agree the bytes decide, also beside buckets without a collision."""
    monkeypatch.setattr(fingerprint, "digest", lambda c: F.substring(c, 1, 1))
    rows = [(1, "ab"), (2, "ac"), (3, "AB"), (4, "x"), (5, "X "), (6, "ad"), (7, "q"), (None, "ac")]
    got = {r.doc_id: (r.group_doc, r.group_size) for r in fingerprint.duplicate_groups(docs(spark, rows)).collect()}
    assert got == {1: (1, 2), 3: (1, 2), 2: (2, 2), None: (2, 2), 4: (4, 2), 5: (4, 2), 6: (6, 1), 7: (7, 1)}
    assert fingerprint.duplicate_groups(docs(spark, [])).count() == 0


def test_pages(spark):
    got = {r.page_id: r.text for r in QUERIES["op7_pages"](spark, SF).collect()}
    for r in table(spark, "pages").collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        assert got[r.page_id] == " ".join(entities.unescape(re.sub(r"</?b>", "", re.sub(r"</?(h1|p|br)>", " ", inner))).split())
    plain = "<body><div>Home About Contact us now please</div><p>Story {0} has words {0} of its own number {0}</p></body>"
    rows = [(i, f"http://a.example/{i}", plain.format(i)) for i in range(4)] + [(8, None, None), (9, "x", ""), (10, "http://b.example", "<main><h1>T</h1>x &lt; y<p>a<b>b</b><div class='comments'>no</div><aside>no</aside><script>no</script></main><p>no</p>")]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, url string, html string, key string, n int")
    got = {r.page_id: r.text for r in pages.extract(df).collect()}
    assert got[2] == "Story 2 has words 2 of its own number 2" and got[8] == got[9] == "" and got[10] == "T x < y ab"
    assert pages.extract(df.limit(0)).count() == 0


def test_pages_of_a_cut_host(spark, monkeypatch):
    """Two pages that share a run lose it wherever the cut puts them; repeated rows are one page."""
    line = "<div>shared line {0} that two pages of this host hold {0}</div>"
    own = "<p>words{0} of{0} page{0} only{0} and{0} no{0} other{0} one{0}</p>"
    rows = [(i, f"http://a.example/{i}", "<body>" + line.format(i % 30) + own.format(i) + "</body>") for i in range(60)]
    rows += [(70, "http://a.example/70", "<body>" + own.format(70) + "</body>")] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted((i, u, " ".join(f"{w}{i}" for w in "words of page only and no other one".split())) for i, u, _ in rows)
    whole = sorted((r.page_id, r.url, r.text) for r in pages.extract(df).collect())
    monkeypatch.setattr(pages, "HOST_BLOCK", 4)
    assert whole == want == sorted((r.page_id, r.url, r.text) for r in pages.extract(df).collect())


def test_suffix_array_runs():
    rnd = np.random.default_rng(3)
    tokens, page = rnd.integers(0, 3, 300), np.sort(rnd.integers(0, 6, 300))
    want = np.zeros(300, bool)
    seen = collections.defaultdict(set)
    runs = [tuple(tokens[i : i + pages.RUN]) if i + pages.RUN <= 300 and page[i] == page[i + pages.RUN - 1] else None for i in range(300)]
    for i, g in enumerate(runs):
        if g:
            seen[g].add(page[i])
    for i, g in enumerate(runs):
        if g and len(seen[g]) >= pages.PAGES:
            want[i : i + pages.RUN] = True
    assert (pages.shared_runs(tokens, page) == want).all()


def test_language_held_out_and_unknown(spark):
    got = QUERIES["op8_langid"](spark, "/root/testdata/sf0.01").join(table(spark).sparkSession.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() / got.count() > 0.97
    model = langid.train(spark.createDataFrame([(i, "the cat sat on the mat", "en", "x") if i % 2 else (i, "der Hund und die Katze", "de", "x") for i in range(40)], "doc_id long, text string, lang string, score string"))
    out = {r.doc_id: r for r in langid.predict(docs(spark, [(1, None), (2, "123 !!"), (3, "und die Katze"), (4, "")]), model).collect()}
    assert [out[i].lang_pred for i in (1, 2, 3, 4)] == ["und", "und", "de", "und"] and out[1].score == 0
    assert langid.train(docs(spark, []).withColumn("lang", F.lit("x"))) is None
    for k in (2, 3, 5, 9, 40):
        code = langid.codewords(k)
        assert len({tuple(r) for r in code}) == k


def test_licenses(spark):
    t = licenses.TEMPLATES
    long = t["BSD-3-Clause"].replace("source and binary", "source or binary")
    half = t["MIT-text"].split("\n")[-1]
    rows = [(1, None), (2, ""), (3, "x y. " + t["MIT"] + " and " + t["Apache-2.0"]), (4, "Pre " + long + " post"), (5, "Nothing to see in this text at all"), (None, t["MIT"]), (6, "some code. " + half)]
    rows += [(7, " ".join([t["CC-BY-4.0"]] * 3)), (8, ("filler words here " * 20000) + t["ISC-text"].lower()), (9, t["MIT-text"]), (9, t["MIT-text"])]
    got = collections.defaultdict(list)
    for r in licenses.scan(docs(spark, rows)).collect():
        got[r.doc_id].append((r.license, round(r.coverage, 2), r.start, r.stop))
    assert {g[0] for g in got[3]} == {"MIT", "Apache-2.0"} and [(g[0], g[1]) for g in got[4]] == [("BSD-3-Clause", 1.0)]
    assert rows[3][1][got[4][0][2] : got[4][0][3]].startswith("Redistribution") and set(got) == {3, 4, None, 6, 7, 8, 9}
    assert [g[0] for g in got[6]] == ["MIT-text"] and 0.3 < got[6][0][1] < 0.7 and rows[6][1][got[6][0][2] :].startswith("THE SOFTWARE")
    assert [g[0] for g in got[7]] == ["CC-BY-4.0"] * 3 and [g[0] for g in got[8]] == ["ISC-text"] and [g[:2] for g in got[9]] == [("MIT-text", 1.0)] * 2
    assert licenses.scan(docs(spark, [])).count() == 0


def test_licenses_equal_alignment_everywhere():
    """Paragraphs with an edit in each fifteen words, though not of a word that tells licenses apart, are found where an alignment along every diagonal finds them, and nowhere else."""
    rnd = random.Random(5)
    index = licenses.Index(licenses.alternatives(licenses.TEMPLATES))
    filler = "lorem ipsum of the software in this work any use without dolor".split()
    for _ in range(40):
        p = rnd.randrange(len(index.words))
        name = index.names[index.of[p]]
        part = [w for w in licenses.TEMPLATES[name].split("\n") if len(licenses.WORD.findall(w)) == len(index.words[p])]
        if not part:
            continue
        words = licenses.WORD.findall(part[0].lower())
        for at in [at for at in range(7, len(words), 15) if not licenses.telling([words[at]])]:
            words[at] = rnd.choice(["changed", "changed twice", ""])
        text = " ".join(rnd.choices(filler, k=30) + words + rnd.choices(filler, k=30))
        h = index.hashes(licenses.WORD.findall(text))
        best = max(licenses.align(h, index.words[p], d)[0] for d in range(-8, len(h)))
        said = licenses.scan_text(text, index)
        if best / len(index.words[p]) >= licenses.COVERAGE:
            assert any(n >= best - 1 for *_, n in said), (name, text, said)
    assert licenses.scan_text(" ".join(rnd.choices(filler, k=3000)), index) == []


def test_decontamination(spark):
    b = spark.createDataFrame([(1, "Anna Bell bought 12 apples for 3 dollars and then sold the 12 apples to her friend Carl for 5 dollars", "k"), (2, None, "k"), (3, "", "k")], "item_id long, text string, doc string")
    asked = "Maria bought {} apples for 7 dollars and then sold the {} apples to her friend Paul for 9 dollars."
    rows = [(1, "Intro text. " + asked.format(40, 40)), (2, "Intro text. " + asked.format(40, 41)), (3, None), (4, ""), (5, "clean words only and nothing else at all"), (1, "Intro text. " + asked.format(40, 40)), (None, asked.format(8, 8))]
    got = {(r.doc_id, r.item_id) for r in decontam.matches(docs(spark, rows), b).collect()}
    assert got == {(1, 1), (None, 1)}
    assert sorted(r.doc_id for r in decontam.clean(docs(spark, rows), b).collect()) == [2, 3, 4, 5]
    assert decontam.clean(docs(spark, rows), b.limit(0)).count() == 7
    found = {(r.doc_id, r.item_id) for r in QUERIES["op10_decontam"](spark, SF).collect()}
    words = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    items = {r.item_id: " ".join(words(r.text)) for r in table(spark, "benchmark").collect()}
    assert found == {(r.doc_id, i) for r in table(spark).collect() for i, t in items.items() if t in " ".join(words(r.text))}


def test_decontamination_of_edited_copies(spark):
    """Copies with 5 to 15 % of the words replaced, words put in or left out, and the first two thirds of an item."""
    rnd = random.Random(5)
    b = table(spark, "benchmark")
    items = [(r.item_id, r.text.split()) for r in b.collect()]
    fill = lambda n: [f"quux{rnd.randrange(10**6)}" for _ in range(n)]
    rows, want = [], set()

    def plant(item, words):
        want.add((len(rows), item))
        rows.append((len(rows), " ".join([*fill(30), *words, *fill(30)])))

    for item, words in items:
        for part in (0, 0.05, 0.1, 0.15):
            new = list(words)
            for at in rnd.sample(range(len(words)), round(part * len(words))):
                new[at] = fill(1)[0]
            plant(item, new)
        at = len(words) // 2
        plant(item, words[:at] + fill(2) + words[at:])
        plant(item, words[:at] + words[at + 1 :])
        plant(item, words[: -(-3 * len(words) // 4)])
    rows += [(len(rows) + k, " ".join(rnd.sample(words, len(words)))) for k, (_, words) in enumerate(items)]
    found = {(r.doc_id, r.item_id) for r in decontam.matches(docs(spark, rows), b).collect()}
    assert found == want
    # one of two equal numbers edited in an otherwise whole copy
    text = "Anna Bell bought 12 apples for 3 dollars and then sold the {} apples to her friend Carl for 5 dollars"
    one = spark.createDataFrame([(1, text.format(12))], "item_id long, text string")
    assert decontam.matches(docs(spark, [(1, text.format(13))]), one).count() == 1


def test_edited_digest(spark):
    got = {r.doc_id: r for r in QUERIES["op6_fingerprint"](spark, SF).collect()}
    rows = sorted(((r.doc_id, r.text) for r in table(spark).collect()), reverse=True)
    d, t = rows[10]
    k = len(t) // 3
    assert got[d].edited_sha256 == hashlib.sha256((t[: len(t) - k] + rows[11][1][:k]).encode()).hexdigest()
