"""Items of numbers and names, and values that must map one to one."""

from pyspark.sql import functions as F

from tidemark.llm import decontam
from tests.llm.test_ops import docs

ITEMS = [
    ("sum", "Compute 12 + 34 + 56 + 78 + 90 + 11 + 13"),
    ("names", "Then Anna, Berta, Carla, Dora, Emma, Frida and Greta"),
    ("train", "A train leaves the station and travels 120 miles, then the driver rests 80 minutes before reaching the old town by the river"),
    ("two", "12 34"),
    ("arabic", "the price of the old house was ٣٤٥ dinars and the garden cost ٦٧ dinars in that year"),
    ("empty", None),
]


def found(spark, texts):
    b = spark.createDataFrame(ITEMS, "item_id string, text string")
    got = decontam.matches(docs(spark, list(enumerate(texts))), b).collect()
    return {(r.doc_id, r.item_id): r.coverage for r in got}


def test_items_without_words(spark):
    got = found(spark, [
        "Homework: Compute 12 + 34 + 56 + 78 + 90 + 11 + 13 by tomorrow.",
        "We met, and Then Anna, Berta, Carla, Dora, Emma, Frida and Greta left.",
        "Compute 99 + 98 + 97 + 96 + 95 + 94 + 93",
        "12 34 are two numbers",
        None, "", "Anna and Berta",
        "filler 7 " * 40000 + "Compute 12 + 34 + 56 + 78 + 90 + 11 + 13",
    ])
    assert set(got) == {(0, "sum"), (1, "names"), (7, "sum")}


def test_values_map_one_to_one(spark):
    train = ITEMS[2][1]
    got = found(spark, [train, train.replace("120", "77").replace("80", "66"), train.replace("120", "77").replace("80", "77"), train.replace("120 miles", "{} miles").format(77)])
    assert got[0, "train"] == got[1, "train"] == 1.0 and got[2, "train"] < 1.0 and got[3, "train"] == 1.0


def test_units_and_digits(spark):
    t = decontam.template(decontam.raw_tokens(F.col("text")))
    rows = docs(spark, [(1, "in 3 m he ran 5 km in t s; ٣ hours ½ mg l"), (2, None), (3, "")]).select("doc_id", t.alias("t")).collect()
    assert {r.doc_id: r.t for r in rows}[1] == ["in", "<n>", "<u>", "he", "ran", "<n>", "<u>", "in", "t", "s", "<n>", "<u>", "<n>", "<u>", "l"]
    text = ITEMS[4][1]
    assert set(found(spark, [text, text.replace("٣٤٥", "999")])) == {(0, "arabic"), (1, "arabic")}
