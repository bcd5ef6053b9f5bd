import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from inkweave.functions.text import edit_ratio
from inkweave.operators import detections, forest, keyed, records, sequences, transcripts
from inkweave.plans import events, intents
from inkweave.plans.turn import Registry, Turn, TurnEngine, turn_diff
from inkweave.sources import files, stores
from inkweave.streaming import events as streaming


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_keyed(spark):
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None), (None, 5, "n"), ("a", 2, "y")], "k string, ord long, v string")
    assert rows(keyed.keep_first(df, ["k"], "ord")) == rows(spark.createDataFrame([("a", 1, "x"), ("b", 1, None), (None, 5, "n")], df.schema))
    assert rows(keyed.keep_last(df, ["k"], "ord", "v")) == rows(spark.createDataFrame([("a", 2, "y"), ("b", 1, None), (None, 5, "n")], df.schema))
    assert rows(keyed.not_in(df.select("k").distinct(), spark.createDataFrame([("a",), (None,)], "k string"), "k")) == [("b",), (None,)]
    other = df.where("k = 'a'").select("k").distinct().unionByName(spark.createDataFrame([("z",)], "k string"))
    assert rows(keyed.key_changes(df.where("k is not null"), other, "k")) == [("b", "removed"), ("z", "added")]
    a, b = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k int, v string"), spark.createDataFrame([(1, "y"), (2, None), (4, None)], "k int, v string")
    assert rows(keyed.value_changes(a, b, "k", "v")) == [(1, "x", "y"), (3, "z", None)]
    assert rows(keyed.rows_not_in(b.unionByName(b), a)) == [(1, "y"), (1, "y"), (4, None), (4, None)]
    old = spark.createDataFrame([("a", {"x": "1", "y": "2"}, 0), ("b", {"x": "3"}, 1)], "k string, f map<string,string>, ord long")
    new = spark.createDataFrame([("c", {"x": "9"}, 0), ("a", {"x": "8"}, 1), ("a", {"y": None}, 2)], "k string, f map<string,string>, ord long")
    assert [(r.k, r.f, r.is_new) for r in keyed.upsert(old, new, "k", "f", "ord").orderBy("is_new", "ord").collect()] == [("a", {"x": "1", "y": None}, 0), ("b", {"x": "3"}, 0), ("c", {"x": "9"}, 1)]
    assert keyed.upsert(old.limit(0), new.limit(0), "k", "f", "ord").count() == 0


def test_sequences(spark):
    one = spark.sql("SELECT array(named_struct('text','a','start',0D,'end',2D), named_struct('text','b','start',1D,'end',1.5D), named_struct('text','c','start',5D,'end',4D)) AS r")
    got = one.select(sequences.clamped(F.col("r"))).first()[0]
    assert [(r.text, round(r.start, 3), round(r.end, 3)) for r in got] == [("a", 0, 2), ("b", 2.01, 2.02), ("c", 5, 5.01)]
    chunk = lambda n: [tuple(c) for c in spark.range(1).select(sequences.chunks(F.lit(n), 10, 3)).first()[0]]
    assert chunk(0) == [] and chunk(10) == [(0, 10)] and chunk(12) == [(0, 12), (10, 12)] and chunk(25) == [(0, 13), (10, 23), (20, 25)]
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(["a", "a", "", "a", "b", None, "b"])], "g int, i int, s string")
    assert [r.i for r in sequences.drop_repeats(df, ["g"], ["i"], "s").orderBy("i").collect()] == [0, 4]
    assert rows(sequences.transitions(df.where("s <> ''"), ["g"], ["i"], "s").select("i", "was", "s")) == [(0, None, "a"), (4, "a", "b")]
    assert [r.island for r in sequences.islands(spark.createDataFrame([(1, p) for p in (1, 2, 4, 5, 9)], "g int, p int"), ["g"], "p").orderBy("p").collect()] == [0, 0, 1, 1, 2]
    runs = spark.createDataFrame([("a", 1, "x", {"k": "1", "l": "1"}), ("a", 2, "x", {"k": "2"}), ("a", 3, "y", {}), ("a", 4, "x", {"k": None})], "g string, o int, s string, f map<string,string>")
    assert [(r.run, r.s, r.rows, r.f) for r in sequences.merged_runs(runs, ["g"], "o", ["s"], "f").orderBy("run").collect()] == [(1, "x", 2, {"k": "2", "l": "1"}), (2, "y", 1, None), (3, "x", 1, {"k": None})]
    lines = lambda t, w: spark.range(1).select(sequences.wrapped(F.split(F.lit(t), " "), w)).first()[0]
    assert lines("aa bb ccc d", 5) == ["aa bb", "ccc d"] and lines("longword x", 4) == ["longword", "x"]


def test_forest(spark):
    rng = random.Random(2)
    parent = {i: rng.choice([None, rng.randrange(i)]) if i else None for i in range(60)} | {i: i - 1 for i in range(100, 140)} | {100: None, 200: 999, 300: 301, 301: 300}
    df = spark.createDataFrame([(str(k), None if p is None else str(p), k % 7 == 3) for k, p in parent.items()] + [(None, "1", True)], "id string, parent_id string, bad boolean")
    want = set()
    for k in parent:
        p, level = parent[k], 1
        while p in parent and level < 300 and k < 300:
            want.add((str(k), str(p), level))
            p, level = parent[p], level + 1
    got = {tuple(r) for r in forest.ancestors(df).where("id not in ('300', '301')").collect()}
    assert got == want
    tree = spark.createDataFrame([("r", None, True), ("a", "r", False), ("b", "r", True), ("ba", "b", True), ("q", None, False)], "id string, parent_id string, bad boolean")
    assert rows(forest.first_matching(tree, F.col("bad"))) == [("r", "ba", 3)]
    assert rows(forest.placed(tree)) == [("a", "r", 1, "r/a"), ("b", "r", 1, "r/b"), ("ba", "r", 2, "r/b/ba"), ("q", "q", 0, "q"), ("r", "r", 0, "r")]
    assert forest.placed(tree.limit(0)).count() == 0
    clips = spark.createDataFrame([(0, 0, "x"), (0, 1, "Rebuttal - y"), (0, 2, "z"), (1, 0, "Rebuttal - w")], "segment int, position int, title string")
    nodes = forest.flatten_nodes(clips)
    assert rows(nodes) == [(0, "x", "square", 0), (0, "z", "dot", 1), (1, "Rebuttal - w", "square", 2)]
    ended = forest.flatten_nodes(clips.unionByName(spark.createDataFrame([(0, 3, "Rebuttal - end")], clips.schema)))
    assert rows(ended.where("kind = 'rebuttal'")) == [(0, "Rebuttal - end", "rebuttal", 3)]
    arc = forest.arcs(ended, gap=0.1).collect()
    assert [(r.segment, r.idx, round(r.end_theta - r.begin_theta, 6), r.large) for r in arc] == [(0, 0, round(math.pi / 2 - 0.2, 6), 0)]
    assert rows(forest.segment_ranges(nodes)) == [(0, 0, 1), (1, 2, 2)]


def test_detections(spark):
    window = lambda n: spark.range(1).select(detections.sample_windows(F.sequence(F.lit(1), F.lit(n)), 2, 2.0, 1.0)).first()[0]
    assert [(w.start, w.end, len(w.part)) for w in window(8)] == [(0, 2, 4), (1, 3, 4)] and window(4) == [] and len(window(5)) == 1
    cut = detections.clip_samples(F.sequence(F.lit(1), F.lit(10)), 2, F.lit(1000), F.lit(2500))
    assert tuple(spark.range(1).select(cut, detections.clip_name("clip", F.lit(1000), F.lit(2500))).first()) == ([3, 4, 5], "clip_1000_2500.wav")
    frames = spark.createDataFrame([(2, 10, 5.0, {"Laughter": 0.5, "Giggle": 0.01, "Speech": 0.9})], "idx int, frames int, seconds double, scores map<string,double>")
    assert rows(detections.strongest_frames(frames, "laugh|giggle|snicker", 0.01)) == [(2, "Laughter", 0.5, 1.0, 1.975)]


def test_records(spark):
    df = spark.createDataFrame([("a", "x", None), ("b", "x", "now"), ("c", "y", None)], "id string, branch string, exported_at string")
    assert [r.id for r in records.matching(df, {"branch": "x", "exported": False, "unknown": 1}).collect()] == ["a"]
    assert [r.id for r in records.matching(df, {"exported": True}).collect()] == ["b"] and records.matching(df, {}).count() == 3
    assert records.projected(df, ["id", "none"]).columns == ["id", "none"]
    with pytest.raises(ValueError, match="unknown field"):
        records.field_rules(df.schema, {"zz": {}})
    blocks = spark.createDataFrame([(1, 1, 10.0, 4.0), (1, 2, 10.0, 4.0), (1, 3, 10.0, 2.0)], "g int, o int, h double, gap double")
    tops = lambda frame: [round(r.top, 3) for r in sequences.laid_out(blocks, ["g"], "o", "h", "gap", frame).orderBy("o").collect()]
    assert tops(None) == tops(100.0) == [0, 14, 28] and tops(35.0) == [0, 12, 24] and tops(5.0) == [0, 10, 20]
    items, status = spark.createDataFrame([("a", "old"), ("b", "old")], "id string, status string"), spark.createDataFrame([("a", "new")], "id string, status string")
    assert rows(records.with_status(items, status, "id")) == [("a", "new")]
    files_ = spark.createDataFrame([("s_raw.json",), ("s_current.json",), ("s_edit_2.json",), ("s_edit_10.json",), ("x.txt",)], "name string")
    assert rows(records.step_files(files_, "name")) == [("s", True, True, 2, 10)]


def test_transcripts(spark):
    words = [(w, i * 1.0, i + 0.9) for i, w in enumerate("so we the quick brown fox jumps over a dog today".split())]
    assert transcripts.best_span(words, "The quick, brown fox!") == (2.0, 5.9, 100.0)
    assert transcripts.best_span(words, "zzz") is None and transcripts.best_span([], "x") is None and transcripts.best_span(words, "") is None
    rng = random.Random(3)
    for _ in range(20):
        said = [("".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))), i * 1.0, i + 1.0) for i in range(12)]
        target = " ".join(w for w, _, _ in said[3:6])
        best = (None, 0)
        for i in range(12):
            for j in range(i, 12):
                score = edit_ratio(" ".join(w for w, _, _ in said[i : j + 1]), target)
                if score >= 70 and score > best[1]:
                    best = ((said[i][1], said[j][2], score), score)
        assert transcripts.best_span(said, target) == best[0]
    assert transcripts.guess_time([], "x")[2] == "none"
    long = "elephant carries towering boxes through crowded markets while watching several lanterns flicker brightly overhead tonight"
    lines = [("nothing here", 0.0, 1.0), (long, 1.0, 2.0), (long + " again", 2.0, 3.0), ("Zygomatic marker-lines appear", 3.0, 4.0)]
    assert transcripts.guess_time(lines, long) == (1.0, 3.0, "strong") and transcripts.guess_time(lines, "see Zygomatic appear-or marker-lines appear")[2] == "rare-anchor"
    assert transcripts.guess_time(lines, "qqq")[2] == "very weak"
    timed = [(w, int(s * 1000), int(e * 1000)) for w, s, e in words]
    assert transcripts.aligned(timed, " ".join(w for w, _, _ in words), 0, 12_000)[2] == 1.0
    assert transcripts.edge_action(0.2, 0.9) == "contract" and transcripts.edge_action(0.9, 0.2) == "extend" and transcripts.edge_action(0.5, 0.5) == "ok"


def test_turns(spark):
    corpus = spark.createDataFrame([("a", 1), ("b", 5), ("c", 9), (None, 3)], "key string, n int")
    registry = Registry()
    registry.register(lambda c: c.where("n > 4"), "big")
    engine = TurnEngine({**registry, "all": lambda c: c}, {"odd": lambda: F.col("n") % 2 == 1, "large": lambda: F.col("n") > 8})
    past = spark.createDataFrame([("a", "rejected"), ("b", "accepted"), (None, "accepted")], "key string, status string")
    turn = engine.run(corpus, past)
    assert rows(turn.decisions.select("key", "strategy", "status")) == [("a", "all", "deferred"), ("c", "big", "accepted")]
    assert rows(turn.criteria) == [("a", "large", False), ("a", "odd", True), ("c", "large", True), ("c", "odd", True)]
    diff = turn_diff(turn, engine.run(corpus, None))
    assert rows(diff["ideas"]) == [("b", "added")] and rows(diff["decisions_added"]) == [("b", "deferred")] and rows(diff["criteria"])[0][0] == "b"
    assert isinstance(turn, Turn) and engine.run(corpus.limit(0), past).decisions.count() == 0
    with pytest.raises(ValueError, match="gives no key"):
        TurnEngine({"x": lambda c: c.drop("key")}, {}).run(corpus)


def test_intents_and_events(spark):
    said = ["Show step ingest", "please list the step outputs", "edit step x: new", "list my items", "describe the workflow", "load_recent now", "hello", None]
    got = [r[0] for r in spark.createDataFrame([(i, m) for i, m in enumerate(said)], "i int, m string").orderBy("i").select(intents.rule_intent("m")).collect()]
    assert got == ["show_step_output", "list_step_outputs", "edit_step_output", "query_workflow", "describe_workflow", "load_recent", "idle", "idle"]
    kind = lambda k, m: spark.range(1).select(intents.edit_kind(F.lit(k), F.lit(m))).first()[0]
    assert [kind(*x) for x in (("string", "Replace it"), ("boolean", "toggle it"), ("object", "delete key"), ("object", "rename a"), ("object", "fix a"), ("string", "hm"))] == ["replace", "toggle", "remove_key", "rename_key", "edit_value", None]
    score = lambda *x: spark.range(1).select(events.case_score(*map(F.lit, x))).first()[0]
    assert score(False, 0, 0) == 1 and abs(score(True, 1, 1) - 0.2) < 1e-9 and score(True, 4, 4) == 0
    items = spark.createDataFrame([("i1", "Blue Paper Fox"), ("i2", "Fox"), ("i3", None)], "id string, label string")
    refs = spark.createDataFrame([("i3",), ("FOX",), ("paper fox",), ("blue",), ("nothing",), (None,)], "ref string")
    assert rows(events.resolved(items, refs)) == [("FOX", "i2", 2), ("blue", "i1", 4), ("i3", "i3", 1), ("paper fox", "i1", 3)]


def test_files_and_stores(spark, tmp_path):
    root = str(tmp_path)
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.json").write_text('{"x": 1,\n "y": [2]}')
    (tmp_path / "a" / "lines.jsonl").write_text('{"k": "a"}\n\n{"k": "b"}\n')
    assert files.read_json(spark, f"{root}/a/one.json", "x int, y array<int>").first().asDict() == {"x": 1, "y": [2]}
    assert files.read_json(spark, f"{root}/a/one.json").select(F.try_variant_get("value", "$.x", "int")).first()[0] == 1
    assert rows(files.read_jsonl(spark, f"{root}/a/lines.jsonl", "k string")) == [("a",), ("b",)]
    (tmp_path / "bad.jsonl").write_text('{"k": "a"}\n{"k": ')
    with pytest.raises(Exception):
        files.read_jsonl(spark, f"{root}/bad.jsonl", "k string").collect()
    assert rows(files.read_jsonl(spark, f"{root}/bad.jsonl", "k string", "DROPMALFORMED")) == [("a",)]
    out = files.update_json(spark, f"{root}/t", lambda d: d.unionByName(spark.createDataFrame([(2,)], "x int")), "x int", spark.createDataFrame([(1,)], "x int"))
    assert rows(out) == [(1,), (2,)]
    assert files.update_json(spark, f"{root}/t", lambda d: d.where("x > 1"), "x int").count() == 1
    with pytest.raises(FileNotFoundError):
        files.update_json(spark, f"{root}/none", lambda d: d, "x int")
    files.append_jsonl(spark.createDataFrame([(3,)], "x int"), f"{root}/t")
    assert rows(spark.read.schema("x int").json(f"{root}/t")) == [(2,), (3,)]
    fs = files.Files(spark)
    fs.copy(f"{root}/a/one.json", f"{root}/b/two.json")
    fs.move(f"{root}/b/two.json", f"{root}/b/three.json")
    assert [n for n, _, _ in fs.listed(f"{root}/b")] == ["three.json"] and fs.listed(f"{root}/zz") == []
    fs.delete(f"{root}/b")
    fs.delete(f"{root}/b")
    with pytest.raises(FileNotFoundError):
        fs.delete(f"{root}/b", missing_ok=False)
    log = spark.createDataFrame([(1, "x\n2026-05-02 10:00:01,123 [INFO] llm: a: b\n2026-05-02 10:00:02 [ERROR] engine.x: c")], "id int, t string")
    assert rows(files.read_log(log, "t").select("level", "logger", "message")) == [("ERROR", "engine.x", "c"), ("INFO", "llm", "a: b")]
    store = stores.DecisionStore(spark, f"{root}/d")
    make = lambda *r: spark.createDataFrame([(f"d{i}", "t", None, (k, None), None, s, i) for i, (k, s) in enumerate(r)], stores.DECISION)
    assert store.load().count() == 0
    store.add(make(("a", "accepted"), ("b", "rejected"), ("a", "accepted")))
    store.add(make(("a", "rejected"), ("b", "rejected")))
    store.add(make(("c", "deferred")))
    assert rows(store.counts()) == [("accepted", 1), ("deferred", 1), ("rejected", 2)]
    with pytest.raises(ValueError, match="unknown status"):
        store.add(make(("x", "maybe")))
    log = stores.EventLog(spark, f"{root}/log")
    log.append(spark.sql("SELECT 1 AS id, timestamp'2031-01-01 10:00:00' AS ts"))
    log.append(spark.sql("SELECT 2 AS id, timestamp'2031-01-01 11:00:00' AS ts"))
    log.compact("2031-01-01")
    spark.catalog.clearCache()
    assert rows(stores.EventLog(spark, f"{root}/log").read().select("id")) == [(1,), (2,)]


def test_streams(spark, tmp_path):
    path = f"{tmp_path}/e"
    spark.sql("SELECT * FROM VALUES (1, timestamp_ntz'2031-01-01 10:00:00', 'a', 'x'), (2, timestamp_ntz'2031-01-01 10:50:00', 'a', 'y'), (3, timestamp_ntz'2031-01-01 10:10:00', 'a', 'x'), (4, CAST(NULL AS timestamp_ntz), 'b', 'x') AS t(id, ts, k, s)").coalesce(1).write.parquet(path)
    counted = streaming.run_once(streaming.window_counts(streaming.event_stream(spark, path), ["k"]), "complete")
    assert [(r.k, r.n) for r in counted.collect()] == [("a", 3)]
    changes = streaming.run_once(streaming.state_changes(streaming.event_stream(spark, path).where("ts is not null"), "k", "s"))
    assert [(r.k, r.was, r.now) for r in changes.orderBy("at").collect()] == [("a", None, "x"), ("a", "x", "y")]
    session = streaming.sessions(streaming.event_stream(spark, path), "k", "20 minutes")
    assert session.isStreaming and "session_start" in session.columns


def test_every_segment_is_searched(spark, data):
    from inkweave.plans import text_queries

    segments = {(r.rec_id, r.idx) for r in text_queries._recordings(spark, data).collect()}
    assert len(segments) > 1_000
    for query, name in ((text_queries.span_search, "quote_id"), (text_queries.tiered_match, "context_id"), (text_queries.clip_alignment, "clip_id")):
        got = [(r.rec_id, r[name]) for r in query(spark, data).collect()]
        assert len(got) == len(segments) and set(got) == segments


def test_references_within_words(spark):
    items = spark.createDataFrame([("i1", "accordion"), ("i2", "Draft review"), ("i3", "zz"), ("i4", None)], "id string, label string")
    refs = spark.createDataFrame([("accord",), ("CORDIO",), ("raft rev",), ("z",), ("raft review",), ("nowhere",), ("",), ("review",)], "ref string")
    got = sorted(tuple(r) for r in events.resolved(items, refs).collect())
    assert got == [("", "i1", 4), ("CORDIO", "i1", 4), ("accord", "i1", 4), ("raft rev", "i2", 4), ("raft review", "i2", 4), ("review", "i2", 3), ("z", "i3", 4)]


def test_alignment_by_hand():
    """Which end moves: too short, the end of the smaller difference grows; too long, that of the larger shrinks; the start goes first of equals."""
    words = [(f"w{i}", 1_000 * i, 1_000 * i + 900) for i in range(40)]
    text = lambda a, b: " ".join(w for w, _, _ in words[a:b])
    # Too short: both ends fit as they are (their differences are 0), so the start grows, by a step of 1,500 ms.
    assert transcripts.aligned(words, text(10, 30), 12_000, 19_000, rounds=1)[:2] == (10_500, 19_000)
    # Too long: the differences are equal, so the start shrinks.
    assert transcripts.aligned(words, f"{text(10, 14)} {text(26, 30)}", 10_000, 30_000, rounds=1, window=8)[:2] == (11_500, 30_000)
    # The start is the target's, the end isn't: the end's difference is larger, so it shrinks.
    short = transcripts.judged(text(10, 30), text(10, 20), 20)
    assert abs(short["start_score"] - short["start_best"]) < abs(short["end_score"] - short["end_best"])
    assert transcripts.aligned(words, text(10, 20), 10_000, 30_000, rounds=1, window=20)[:2] == (10_000, 28_500)
    # The end is the target's, the start isn't: the start shrinks.
    assert transcripts.aligned(words, text(20, 30), 10_000, 30_000, rounds=1, window=20)[:2] == (11_500, 30_000)
    # Steps shrink: of three rounds the second takes two thirds of 1,500 ms.
    assert transcripts.aligned(words, text(20, 30), 10_000, 30_000, rounds=3, window=20)[0] == 10_000 + 1_500 + 1_000 + 500
    assert transcripts.anchor_match("." * 30, "..", 20) == (1.0, 0) and transcripts.anchor_match("a" * 30, "zz", 20) == (0.0, -1)
    # Starts don't go below 0; what fits is left alone, in one round.
    assert transcripts.aligned(words, text(0, 30), 500, 9_000, rounds=1)[0] == 0
    assert transcripts.aligned(words, text(10, 20), 10_000, 20_000)[:2] == (10_000, 20_000) and transcripts.aligned(words, text(10, 20), 10_000, 20_000)[3] == 1


def test_long_segments_keep_their_words_in_order(spark):
    segments = spark.createDataFrame([(1, 0, "a " * 12_000, 0.0, 1.0), (1, 1, " b\x1cc -- ", 1.0, 2.0), (1, 2, None, 2.0, 3.0)], "rec_id long, idx int, text string, start double, end double")
    words = transcripts.words_of(segments).orderBy("idx").collect()
    assert [w.text for w in words[-2:]] == ["b", "c"] and len({w.idx for w in words}) == 12_002 and (words[-1].start, words[-1].end) == (1 + 1 / 3, 1 + 2 / 3)


def test_circles_and_deep_chains(spark):
    chain = spark.range(1_500).selectExpr("cast(id as string) as id", "if(id = 0, null, cast(id - 1 as string)) as parent_id")
    assert forest.placed(chain).where("id = '1499'").select("root", "depth").first()[:] == ("0", 1_499)
    circle = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "a")], "id string, parent_id string")
    got = {tuple(r) for r in forest.ancestors(circle).collect()}
    assert got == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1), ("b", "a", 2), ("c", "a", 1), ("c", "b", 2), ("x", "a", 1), ("x", "b", 2), ("x", "c", 3)}


def test_ranks_without_one_task(spark):
    df = spark.sql("SELECT id % 700 AS k, IF(id % 9 = 0, NULL, timestamp_seconds(id % 700 % 50)) AS at FROM range(1500)").unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS k, CAST(NULL AS TIMESTAMP) AS at"))
    got = [tuple(r) for r in records.by_time_text(df, "k", "at").collect()]
    keys = sorted({(t, -1 if k is None else k) for k, t, _ in got})
    assert len(got) == 1501 and all(p == keys.index((t, -1 if k is None else k)) + 1 for k, t, p in got)
    assert records.by_time_text(df.limit(0), "k", "at").count() == 0


def test_thresholds_per_group(spark):
    at = lambda s: f"timestamp_seconds({s})"
    found = spark.sql(f"SELECT {at(0)} AS start, 'a' AS label, 0.5D AS score UNION ALL SELECT {at(70)}, 'b', 0.5D UNION ALL SELECT {at(130)}, 'c', 0.9D")
    groups = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "label string, group_name string")
    limits = spark.createDataFrame([("x", 0.4), ("y", 0.6)], "group_name string, threshold double")
    assert [r.window_start for r in detections.coarse_to_fine(found, groups, 60, 10, limits).collect()] == [0]
    assert sorted(r.window_start for r in detections.coarse_to_fine(found, groups, 60, 10, 0.5).collect()) == [0, 70, 130]


def test_broken_off_replacements(spark, tmp_path):
    root, fs = str(tmp_path), files.Files(spark)
    files.write_document(spark, f"{root}/x.json", {"b": 1, "a": [None, "ü"]}, sort_keys=True)
    assert (tmp_path / "x.json").read_text() == '{\n  "a": [\n    null,\n    "ü"\n  ],\n  "b": 1\n}\n'
    fs.move(f"{root}/x.json", f"{root}/.old-x.json")  # the old one had stepped aside, then the process ended
    assert fs.exists(fs.settled(f"{root}/x.json"))
    files.write_yaml(spark, f"{root}/x.yaml", {"k": [1, {"n": None}], "t": "a: b"})
    assert '"k": [1, {"n": null}]' in files.read_yaml(spark, f"{root}/x.yaml").first().value
    with pytest.raises(Exception):
        fs.delete(root, recursive=False)


def test_stores_keep_batches(spark, tmp_path):
    root = str(tmp_path)
    rows = lambda *r: spark.createDataFrame(r, "k string, v long")
    store = stores.Appended(spark, f"{root}/a", "k string, v long")
    assert store.read().count() == 0
    for i in range(3):
        store.append(rows(("a", i), ("b", i)))
    (tmp_path / "a" / "batch=9").mkdir()  # not complete
    assert {tuple(r) for r in store.read().collect()} == {(k, i, i) for k in "ab" for i in range(3)}
    store.compact(lambda d: d.where("v > 0"))
    store.append(rows(("c", 7)))
    assert {tuple(r) for r in store.read().collect()} == {(k, i, i) for k in "ab" for i in (1, 2)} | {("c", 7, 3)}
    items = stores.ItemStore(spark, f"{root}/i", "k", "k string, v long", "v")
    items.put(rows(("a", 1), ("b", 5)))
    items.put(rows(("a", 2), ("b", 4)))
    assert {tuple(r) for r in items.get().collect()} == {("a", 2), ("b", 5)} and items.get("a").count() == 1
    turns = stores.TurnStore(spark, f"{root}/t")
    for turn in ("t2", "t1", "t2"):
        turns.save(turn, ideas=rows(("i", 1)), criteria=rows(("c", 2)), decisions=rows((turn, 3)))
    assert turns.turns() == ["t1", "t2"] and turns.load("t2")["decisions"].first().k == "t2"
    log = stores.EventLog(spark, f"{root}/log")
    for day in (1, 1, 2):
        log.append(spark.sql(f"SELECT {day} AS id, timestamp'2031-01-0{day} 10:00:00' AS ts"))
    assert log.rotate() == ["2031-01-01"] and log.read().count() == 3 and log.drop("2031-01-02") == ["2031-01-01"] and stores.EventLog(spark, f"{root}/log").read().count() == 1


def test_instances(spark, tmp_path):
    made = stores.Instance(spark, f"{tmp_path}/one")
    with pytest.raises(FileNotFoundError):
        made.config()
    made.create({"name": "ü", "n": [1]}).create({"name": "w"})
    assert made.config() == {"name": "w"} and made.decisions.load().count() == 0 and made.turns.turns() == []
