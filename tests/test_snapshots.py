import json

from inkweave.operators.snapshots import snapshot_changes
from inkweave.plans.problems import p4_found, p4_intervals


def plain(value):
    if isinstance(value, dict):
        return ("o", tuple(sorted((k, plain(v)) for k, v in value.items() if v is not None)))
    if isinstance(value, list):
        return ("a", tuple(sorted(map(plain, value), key=repr)))
    return ("b", value) if isinstance(value, bool) else ("v", value if value is None or isinstance(value, str) else float(value))


def brute(rows):
    """From (snapshot, key, loaded, texts)."""
    state = {}
    for snapshot, key, _loaded, texts in sorted(rows, key=lambda r: r[2]):
        state.setdefault(snapshot, {})[key.strip().lower()] = [plain(json.loads(t)) if t and t.strip() else plain(None) for t in texts]
    out, numbers = set(), sorted(state)
    for a, b in zip(numbers, numbers[1:]):
        for k in state[a].keys() | state[b].keys():
            if k not in state[a]:
                out.add((b, k, "added"))
            elif k not in state[b]:
                out.add((b, k, "removed"))
            elif state[a][k] != state[b][k]:
                out.add((b, k, "changed"))
    return out


def test_small(spark):
    v, w = '{"a": [1, {"x": null, "y": "é"}], "b": 2}', '{"b":2.0,"a":[{"y":"\\u00e9"},1.0]}'
    rows = [
        (1, "T1", 1, v), (2, " t1", 1, w), (4, "t1 ", 1, v), (4, "t1", 2, '{"a": []}'), (5, "t1", 1, '{"a": []}'), (7, "t1", 9, "not json"), (9, "t1", 1, " not json"),
        (1, "t2", 1, None), (2, "t2", 1, ""), (5, "t2", 1, "null"), (7, "t2", 1, "null"), (9, "t2", 1, "{}"),
        (2, "t3", 1, v), (2, "t3", 1, v), (None, "t3", 1, v), (4, None, 1, v), (4, " ", 1, v),
    ]
    df = spark.createDataFrame([(a, b, c * 1000, d, "x") for a, b, c, d in rows], "n long, k string, at long, body string, snapshot string").selectExpr("n", "k", "timestamp_micros(at) AS loaded", "body", "snapshot", "1 AS value")
    got = [tuple(r) for r in snapshot_changes(df, "n", "k", ["body"], "loaded").collect()]
    want = {(4, "t1", "changed"), (7, "t1", "changed"), (4, "t2", "removed"), (5, "t2", "added"), (9, "t2", "changed"), (2, "t3", "added"), (4, "t3", "removed")}
    assert len(got) == len(want) and set(got) == want
    assert snapshot_changes(df.where("n = 1"), "n", "k", ["body"]).count() == 0
    assert snapshot_changes(df.limit(0), "n", "k", ["body"]).count() == 0


def test_query_against_brute_force(spark, data):
    rows = spark.read.parquet(f"{data}/turn_snapshots.parquet").collect()
    got = [tuple(r) for r in p4_found(spark, data).collect()]
    want = brute([(r.snapshot_no, r.turn_id, r.loaded_at, (r.decisions, r.strategy_outputs, r.criteria_results)) for r in rows])
    assert want and len(got) == len(set(got)) and set(got) == want
    assert p4_intervals(spark, data).where("first > last").count() == 0
