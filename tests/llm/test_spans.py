import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from inkweave.llm import spans
from inkweave.llm.queries import p8_found
from inkweave.llm.spans import SpanIndex, arrivals, shared_spans

SCHEMA = "doc_id long, text string, fp string, around int, doc int"


def brute(rows, length):
    owners = defaultdict(set)
    for k, t, *_ in rows:
        for i in range(len(t or "") - length + 1):
            owners[t[i : i + length]].add(k)
    out = {}
    for k, t, *_ in rows:
        covered = set()
        for i in range(len(t or "") - length + 1):
            if len(owners[t[i : i + length]]) > 1:
                covered.update(range(i, i + length))
        if covered:
            out[k] = len(covered)
    return out


def made(seed, n=60):
    rng = random.Random(seed)
    word = lambda: rng.choice(["alpha", "beta", "γάμμα", "délta", "eps\n", "zeta🙂", "a", "a a a"]) + str(rng.randrange(400))
    passages = ["".join(word() + " " for _ in range(rng.randrange(5, 40))) for _ in range(6)] + ["x" * 90, "ab" * 60]
    rows = [(1000, None), (1001, ""), (1002, "short")]
    for i in range(n):
        text = ""
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(passages)
            cut = rng.randrange(0, 30)
            text += rng.choice([p, p[cut:], p[: len(p) - cut], "".join(word() for _ in range(20))])
        rows.append((i, text))
    rows.append((5000, rows[5][1]))
    return [(*r, "x", 1, 2) for r in rows]


def found(df):
    return {r[0]: r[1] for r in df.collect()}


def test_against_brute_force(spark):
    for seed, length in ((1, 40), (2, 60), (3, 25)):
        rows = made(seed)
        df = spark.createDataFrame(rows, SCHEMA)
        assert found(shared_spans(df, length=length)) == brute(rows, length)


def test_batches_and_compaction_give_the_same(spark):
    rows = made(7)
    df = spark.createDataFrame(rows, SCHEMA)
    index = SpanIndex(spark, 40, fan=2)
    for i in range(5):
        index.append(df.where(f"doc_id % 5 = {i}"))
    assert sorted(level for level, _ in index.runs) == [0, 2]  # 5 = 4 + 1
    assert found(index.report(df)) == brute(rows, 40)
    assert found(index.compact().report(df)) == brute(rows, 40)
    assert len(index.runs) == 1
    index.drop()


def test_runs_are_joined_without_a_shuffle(spark):
    df = spark.createDataFrame(made(3), SCHEMA)
    index = SpanIndex(spark, 40, fan=8)
    for i in range(3):
        index.append(df.where(f"doc_id % 3 = {i}"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = spark.table(index.runs[0][1]).join(spark.table(index.runs[1][1]), "fp")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort " not in plan
    index.drop()


def test_equal_hashes_are_told_apart(spark, monkeypatch):
    """All surroundings under one hash: only their characters tell them apart."""
    plain = spans.fingerprints
    monkeypatch.setattr(spans, "fingerprints", lambda *a: plain(*a).withColumn("around", F.lit(7).cast("long")))
    rows = made(5)
    assert found(shared_spans(spark.createDataFrame(rows, SCHEMA), length=40)) == brute(rows, 40)


def test_lengths(spark):
    for length in (0, 65_536):
        with pytest.raises(ValueError):
            SpanIndex(spark, length)


def test_arrivals_hold_each_row_once(spark):
    df = spark.sql("SELECT id, IF(id % 5 = 0, NULL, timestamp_micros(id * 1000000)) AS at FROM range(50)")
    for n in (1, 2, 3, 7):
        parts = [sorted(r.id for r in p.collect()) for p in arrivals(df, "at", n)]
        assert len(parts) == n and sorted(x for p in parts for x in p) == list(range(50)) and all(parts)
    assert len(arrivals(df.where("at is null"), "at", 3)) == 1
    rows = made(11)
    timed = spark.createDataFrame([(*r[:2], i) for i, r in enumerate(rows)], "doc_id long, text string, n long").selectExpr("*", "timestamp_micros(n) AS at")
    assert found(shared_spans(timed, length=40, at="at", batches=3)) == brute(rows, 40)


def test_large_groups_go_through_the_shuffle(spark, monkeypatch):
    monkeypatch.setattr(spans, "LOCAL", 1)
    rows = made(9)
    assert found(shared_spans(spark.createDataFrame(rows, SCHEMA), length=40)) == brute(rows, 40)


def test_repeated_rows_nulls_and_empty(spark):
    text = "".join(chr(97 + i * i % 26) + str(i) for i in range(100))
    rows = [(1, text), (1, text), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(shared_spans(df)) == {}
    assert found(shared_spans(df.unionByName(spark.createDataFrame([(9, text)], "doc_id long, text string")))) == {1: len(text), 9: len(text)}
    assert found(shared_spans(df.limit(0))) == {}
    assert shared_spans(df).columns == ["doc_id", "shared_chars"]


def test_query_against_brute_force(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    assert found(p8_found(spark, data)) == brute(rows, 200)
