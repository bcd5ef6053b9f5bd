import re

from inkweave.llm import leakage
from inkweave.llm.leakage import leaked_items
from inkweave.llm.queries import p7_found

WORD = re.compile(r"[^\W_]+")


def windows(text, width=10):
    words = WORD.findall((text or "").lower())
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(docs, items, width=10):
    of = {}
    for i, t in items:
        for w in windows(t, width):
            of.setdefault(w, set()).add(i)
    return {(d, i) for d, t in docs for w in windows(t, width) for i in of.get(w, ())}


DOCS = [
    (1, "Start one two three four five six seven eight nine ten end"),
    (2, "ONE, two; three_four-five (six) seven\neight NINE ten"),
    (3, "one two three four five six seven eight nine"),
    (4, None),
    (5, ""),
    (6, "ten nine eight seven six five four three two one"),
    (7, "eleven zwölf ÄÖÜ 14 15 16 17 18 19 20 21"),
    (7, "eleven zwölf ÄÖÜ 14 15 16 17 18 19 20 21"),
    (8, "a a a a a a a a a a a a a"),
    (9, "ten" + " eight" * 3),
]
ITEMS = [(1, "one two three four five six seven eight nine ten"), (2, "one two three four five six seven eight nine ten eleven"), (3, None), (4, ""), (5, "zwölf äöü 14 15 16 17 18 19 20 21 22"), (6, "a a a a a a a a a a"), (1, "one two three four five six seven eight nine ten")]


def test_small_against_brute_force(spark, monkeypatch):
    docs = spark.createDataFrame([(*d, 3, "t") for d in DOCS], "doc_id long, text string, item_id int, t string")
    items = spark.createDataFrame([(*i, 5) for i in ITEMS], "item_id long, text string, doc_id int")
    want = brute(DOCS, ITEMS)
    assert want
    for slots, bits in ((1 << 20, 1 << 22), (64, 128), (1, 64)):  # filters that are full lose nothing
        monkeypatch.setattr(leakage, "SLOTS", slots)
        monkeypatch.setattr(leakage, "BITS", bits)
        got = leaked_items(docs, items)
        assert got.columns == ["doc_id", "item_id"]
        rows = [tuple(r) for r in got.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want
    assert {tuple(r) for r in leaked_items(docs, items, width=3).collect()} == brute(DOCS, ITEMS, 3)
    assert leaked_items(docs.limit(0), items).count() == 0
    assert leaked_items(docs, items.limit(0)).count() == 0


def test_query_against_brute_force(spark, data):
    docs = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{data}/eval_items.parquet").collect()]
    got = [tuple(r) for r in p7_found(spark, data).collect()]
    assert got and len(got) == len(set(got))
    assert set(got) == brute(docs, items)


def test_many_items_read_the_corpus_twice(spark):
    """20,000 items: the corpus is scanned as often as for one, and every planted window is found."""
    items = spark.range(20_000).selectExpr("id as item_id", "concat_ws(' ', transform(sequence(0, 11), x -> concat('w', id * 7 + x * x))) as text")
    docs = spark.range(300).selectExpr("id as doc_id", "concat('Before, ', concat_ws(' ', transform(sequence(1, 10), x -> concat('W', (id * 66) * 7 + x * x))), ' after.') as text")
    got = {tuple(r) for r in leaked_items(docs, items).collect()}
    assert got == {(i, i * 66) for i in range(300)}
    scans = lambda n: leaked_items(docs, items.limit(n))._jdf.queryExecution().executedPlan().toString().count("Range (0, 300")
    assert scans(1) == scans(20_000)
