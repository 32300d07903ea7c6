"""Which blocks of a page are its article: cases with several articles, names of classes, and hints that shared runs decide."""

import pytest

from tidemark.llm import pages

SCHEMA = "page_id long, url string, html string, key string, n int"


@pytest.mark.parametrize("html, text", [
    ("<div><p>The story itself stands here.</p></div><article class='comment'>I disagree</article>", "The story itself stands here."),
    ("<article class='teaser'>More to read</article><main><h1>Title</h1><p>The long main story.</p></main>", "Title The long main story."),
    ("<article><p>Short teaser</p></article><article><p>The long story of the day with many words</p></article><article>End</article>", "The long story of the day with many words"),
    ("<article><div class='share-price'>Shares rose by ten.</div><p id='related-work'>Earlier papers say so.</p><p>End.</p></article>", "Shares rose by ten. Earlier papers say so. End."),
    ("<article><p>Text.</p><div class='comment-list'><p>First!</p></div><div id='adSlot'>Buy</div><div class='cookie_banner'>Accept</div><div class='share buttons'>Tweet</div></article>", "Text."),
    ("<main><article><p>Inner</p></article><p>beside</p></main><article>x</article>", "Inner beside"),
    ("<article class='promo'>Buy now</article>", ""),
    ("<article></article><p>Only this</p>", "Only this"),
    ("<div class='share-price'>Outside a hint is a role</div><p>Kept</p>", "Kept"),
])
def test_articles(spark, html, text):
    df = spark.createDataFrame([(1, "http://a.example/1", f"<html><body>{html}</body></html>", "k", 1)], SCHEMA)
    assert [r.text for r in pages.extract(df).collect()] == [text]


def test_shared_runs_decide_on_hints(spark):
    one = "<article><p>Story number {0} about thing {0}.</p><div class='related-work'>{1}</div></article>"
    same = "read these other stories of our newspaper today"
    rows = [(i, f"http://a.example/{i}", one.format(i, same if i < 3 else f"own work {i} cited in this text {i} alone"), "k", 1) for i in range(5)]
    rows += [rows[0], (7, None, None, "k", 1), (8, "http://b.example", one.format(8, same), "k", 1)]
    got = {r.page_id: (r.text, r.blocks_shared) for r in pages.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1] == ("Story number 1 about thing 1.", 1)
    assert got[3] == ("Story number 3 about thing 3. own work 3 cited in this text 3 alone", 0)
    assert got[8] == (f"Story number 8 about thing 8. {same}", 0) and got[7] == ("", 0)


def test_long_and_repeated_pages(spark):
    long = "<article>" + "".join(f"<p>Paragraph {i} of a very long page.</p>" for i in range(30000)) + "</article><nav>x</nav>"
    rows = [(1, "http://a.example/1", long, "k", 1)] * 2 + [(2, "http://a.example/2", "<p>" * 20000 + "deep", "k", 1)]
    got = pages.extract(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(len(r.text) for r in got)[1:] == [len(" ".join(f"Paragraph {i} of a very long page." for i in range(30000)))] * 2
