import json
import random

from inkweave.operators.nested import LONE, braced_member, flattened, nodes, step_members, valid, whole
from inkweave.plans.problems import p5_found, p5_tables


def walk(value, path, around, name=None):
    """All nodes of a value by plain recursion."""
    if isinstance(value, dict):
        if name in LONE:
            path, around = f"{path}[0]", (f"{path}[0]", around)
            yield around
            around = around[0]
        for k, v in value.items():
            yield from walk(v, f"{path}.{k}", around, k)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            if isinstance(v, dict):
                yield f"{path}[{i}]", around
                yield from walk(v, f"{path}[{i}]", f"{path}[{i}]")
            else:
                yield from walk(v, f"{path}[{i}]", around)


def made(rng, depth=0):
    kind = rng.random()
    if depth > 4 or kind < 0.35:
        return rng.choice([None, True, 1.5, -2, "x", 'quo"te', "back\\slash", "{[,:]}", "\\\"", "ü ", "", "\\"])
    if kind < 0.65:
        return [made(rng, depth + 1) for _ in range(rng.randrange(4))]
    names = ["a", "clips", "spans", 'k"ey', "x.y", "k:{", "é", "marks"]
    return {rng.choice(names): made(rng, depth + 1) for _ in range(rng.randrange(4))}


def test_index_against_recursion():
    rng = random.Random(5)
    values = [v for v in (made(rng) for _ in range(800)) if isinstance(v, (dict, list))]
    texts = [json.dumps(v, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])) for v in values]
    got = [[] for _ in values]
    for i, path, around, node in nodes([("r", (), t) for t in texts]):
        got[i].append((path, around))
        assert isinstance(json.loads(node), dict)
    for v, g in zip(values, got):
        assert sorted(g) == sorted(walk(v, "r", ""))


def test_repeated_keys_the_last_counts():
    text = '{"a": [{"x": 1}, {"y": 2}], "a": [{"z": [{}]}], "b": {"c": [{}], "c": 1}}'
    assert [n[1:3] for n in nodes([("r", (), text)])] == [("r.a[0]", ""), ("r.a[0].z[0]", "r.a[0]")]


def test_parts():
    text = 'so: {"parameters": {"filters": {"a": [{}, 3, [{}]]}}, "clips": [{}]} end'
    assert [n[1:3] for n in nodes(list(braced_member("i", "parameters")(text)))] == [
        ("i.parameters.filters[0]", ""), ("i.parameters.filters[0].a[0]", "i.parameters.filters[0]"), ("i.parameters.filters[0].a[2][0]", "i.parameters.filters[0]"),
    ]
    steps = json.dumps({"s": {"raw": [{}], "current": [[{"at": 1}]]}, "clips": {"current": '{"segments": [null, {"clips": {}}]}'}, "t": {"current": "plain"}, "u": 3})
    assert [n[1:3] for n in nodes(list(step_members("o", "current")(steps)))] == [
        ("o.s.current[0][0]", ""), ("o.clips.current.segments[1]", ""), ("o.clips.current.segments[1].clips[0]", "o.clips.current.segments[1]"),
    ]
    assert not list(whole("r")('{"a": [1')) and not list(braced_member("i", "p")("} {")) and not valid("3")


def test_nulls_empty_and_clashing_names(spark):
    rows = [("1", '{"a": [{}]}', "x"), ("2", None, "x"), (None, '{"a": [{}]}', "x"), ("3", "", "x"), ("4", "{", "x"), ("5", "[]", None), ("6", '{"a": {"clips": []}}', "y")]
    df = spark.createDataFrame(rows, "id string, text string, node_path string")
    assert [tuple(r) for r in flattened(df, "id", "text", whole("v"), "t").collect()] == [("t", "1", "v.a[0]", "")]
    assert flattened(df.limit(0), "id", "text", whole("v"), "t").count() == 0


def test_query_against_recursion(spark, data):
    want = set()
    for r in spark.read.parquet(f"{data}/eval_traces.parquet").select("trace_id", "intent_llm").collect():
        text = r.intent_llm or ""
        try:
            value = json.loads(text[text.find("{") : text.rfind("}") + 1])
        except ValueError:
            continue
        if isinstance(value, dict) and "parameters" in value:
            want |= {("eval_traces", str(r.trace_id), *n) for n in walk(value["parameters"], "intent_llm.parameters", "")}
    for r in spark.read.parquet(f"{data}/turn_snapshots.parquet").where("snapshot_no = 9").collect():
        want |= {("turn_snapshots", r.turn_id.strip().lower(), *n) for n in walk(json.loads(r.criteria_results or "{}"), "criteria_results", "")}
    items = {}
    for r in spark.read.parquet(f"{data}/workflow_items.parquet").collect():
        if r.id not in items or items[r.id].updated_at <= r.updated_at:
            items[r.id] = r
    for r in items.values():
        for name, step in json.loads(r.step_outputs or "{}").items():
            value = step.get("current")
            if isinstance(value, str):
                try:
                    value = json.loads(value)
                except ValueError:
                    continue
            want |= {("workflow_items", r.id, *n) for n in walk(value, f"step_outputs.{name}.current", "")}
    got = [tuple(r) for r in p5_found(spark, data).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    tables = p5_tables(spark, data).collect()
    assert len(tables) == len(got) and all(isinstance(json.loads(r.node), dict) for r in tables)
