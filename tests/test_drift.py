import json

from inkweave.operators import drift
from inkweave.operators.drift import Parents, cast_value
from inkweave.operators.flooding import flood, selected
from inkweave.plans.problems import PARENTS, p2_found, p2_table

OPEN = {"parameters", "flags", "raw", "current"}


def kind(v):
    return "boolean" if isinstance(v, bool) else {str: "string", int: "number", float: "number", list: "array", dict: "object"}[type(v)]


def same(a, b):
    return json.dumps(a, sort_keys=True) == json.dumps(b, sort_keys=True)


def schema_changes(df):
    return drift.schema_changes(df, parents=PARENTS)


def consistent_table(df):
    return drift.consistent_table(df, parents=PARENTS, kinds={"intent_llm": "trace", "status": "status"}, otherwise="step")


USUAL = {"intent_llm": {"intent", "item_id", "step_name", "edit_text", "parameters", "reasoning"}, "status": {"branch", "substate", "approved", "requires_approval", "flags"}}


def parent_names(records):
    """By all of a file's objects of a name: it is called so, or two of the usual keys are among theirs."""
    inner = {}
    for r in records:
        for k, v in r.items():
            if isinstance(v, str) and v.strip().startswith("{"):
                try:
                    v = json.loads(v)
                except ValueError:
                    pass
            if isinstance(v, dict):
                inner.setdefault(k, []).append(set(v))
    out = {}
    for parent, keys in USUAL.items():
        found = [k for k, sets in inner.items() if len(set().union(*sets) & keys) >= 2 and 2 * sum(bool(s & keys) for s in sets) >= sum(map(bool, sets))]
        if parent in inner or found:
            out[parent] = parent if parent in inner else max(found, key=lambda k: len(inner[k]))
    return out


def level(old, new, prefix_old, prefix_new, roles_old, roles_new):
    """The changes of one level; old and new are {rec: [object, ...]}."""
    def fields(recs):
        out = {}
        for objects in recs.values():
            for o in objects:
                for k, v in o.items():
                    out.setdefault(k, set()).update([kind(v)] if v is not None else [])
        return out

    a, b = fields(old), fields(new)
    gone, come = sorted(set(a) - set(b)), sorted(set(b) - set(a))
    pairs = {(roles_old[r], roles_new[r]) for r in set(roles_old) & set(roles_new) if roles_old[r] in gone and roles_new[r] in come}
    common = set(old) & set(new)
    for g in gone:
        for c in come:
            if all((g in x) == (c in y) and same(x.get(g), y.get(c)) for r in common for x in old[r][:1] for y in new[r][:1]):
                pairs.add((g, c))
    for k in sorted(set(a) & set(b)):
        if a[k] and b[k] and a[k] != b[k] and k not in OPEN:
            yield "retyped", prefix_new + k, prefix_old + k
    used = {}
    for g, c in sorted(pairs):
        if g not in used and c not in used.values():
            used[g] = c
            yield "renamed", prefix_new + c, prefix_old + g
    for g in gone:
        if g not in used:
            yield "removed", prefix_old + g, prefix_old + g
    for c in come:
        if c not in used.values():
            yield "added", prefix_new + c, ""


def brute(rows):
    files = {}
    for feed, no, body in rows:
        records = files.setdefault(feed, {}).setdefault(no, {})
        try:
            value = json.loads(body)
        except (ValueError, TypeError):
            continue
        if isinstance(value, dict):
            records.setdefault(value.get("rec_id"), []).append(value)
    out = set()
    for feed, by_no in files.items():
        numbers = sorted(by_no)
        for was, no in zip(numbers, numbers[1:]):
            old, new = by_no[was], by_no[no]
            ro, rn = (parent_names([o for x in f.values() for o in x]) for f in (old, new))
            out |= {(feed, no, *c) for c in level(old, new, "", "", ro, rn)}
            for r in set(ro) & set(rn):
                inner = [{rec: [o[p] for o in x if isinstance(o.get(p), dict)] for rec, x in f.items() if any(isinstance(o.get(p), dict) for o in x)} for f, p in ((old, ro[r]), (new, rn[r]))]
                if inner[0] and inner[1]:
                    out |= {(feed, no, *c) for c in level(*inner, ro[r] + ".", rn[r] + ".", {}, {})}
    return out


def lines(feed, files):
    return [(feed, no, json.dumps(r) if isinstance(r, dict) else r, "x") for no, records in files.items() for r in records]


S = {"branch": "b", "substate": "s", "approved": True}
FILES = {
    1: [{"rec_id": "1", "a": 1, "b": "x", "status": S}, {"rec_id": "2", "a": 2, "b": None, "status": S}, "broken{", "", None, "[1]"],
    2: [{"rec_id": "1", "a": "1", "c": "x", "state": {**S, "flags": {}}}, {"rec_id": "2", "a": "2", "c": None, "state": S}, {"rec_id": "9", "d": [1]}],
    5: [{"rec_id": "1", "a": "1", "c": "x", "state": {"branch": "b", "sub": "s", "approved": True}, "d": None}, {"rec_id": "1", "a": "1", "c": "x", "state": {"branch": "b", "sub": "s", "approved": True}, "d": None}],
    6: [{"rec_id": "1", "a": "1", "state": json.dumps(S)}],
}
WANT = {
    ("f", 2, "retyped", "a", "a"), ("f", 2, "renamed", "c", "b"), ("f", 2, "renamed", "state", "status"), ("f", 2, "added", "state.flags", ""), ("f", 2, "added", "d", ""),
    ("f", 5, "renamed", "state.sub", "state.substate"), ("f", 5, "removed", "state.flags", "state.flags"),
    ("f", 6, "removed", "c", "c"), ("f", 6, "removed", "d", "d"), ("f", 6, "retyped", "state", "state"),
}


def test_small(spark):
    rows = lines("f", FILES) + lines("lone", {3: FILES[1]}) + [(None, 1, "{}", "x"), ("f", None, "{}", "x")]
    df = spark.createDataFrame(rows, "feed string, file_no long, body string, owner string")
    got = [tuple(r) for r in schema_changes(df).collect()]
    assert len(got) == len(set(got)) and set(got) == WANT == brute([r[:3] for r in rows if None not in r[:2]])
    assert schema_changes(df.limit(0)).count() == 0


def test_consistent_table(spark):
    df = spark.createDataFrame(lines("f", FILES), "feed string, file_no long, body string, owner string")
    got = {(r.file_no, r.rec_id): r for r in consistent_table(df).collect()}
    assert len(got) == 7 and {r.kind for r in got.values()} == {"status", "step"}
    assert got[2, "1"].fields == {"rec_id": "1", "a": "1", "b": "x", "status.branch": "b", "status.substate": "s", "status.approved": "true", "status.flags": "{}"}
    assert got[5, "1"].fields["status.substate"] == "s" and got[6, "1"].fields["status.branch"] == "b"


def test_cast():
    assert [cast_value(*x) for x in (([3], 2), ({"value": "v"}, 1), ("7", 2), ("x", 2), ('{"a": 1}', 16), ([1, 2], 1), (None, 1), (1.0, 2))] == ["3", "v", "7", "x", '{"a":1}', "[1,2]", None, "1"]


def test_flooding_prefers_like_names_and_types():
    old = [("", "step_name", 1), ("", "elapsed", 2), ("", "rec_id", 1)]
    new = [("", "stepName", 1), ("", "elapsed_s", 2), ("", "rec_id", 1)]
    assert {(a[1], b[1]) for a, b in selected(flood(old, new), lambda p: True)} == {("step_name", "stepName"), ("elapsed", "elapsed_s"), ("rec_id", "rec_id")}
    # Values that agree outweigh a name that is somewhat like; what isn't borne out is left to the next best.
    old, new = [("", "title", 1), ("", "note", 1)], [("", "titles", 1), ("", "remark", 1)]
    scores = flood(old, new, {(old[0], new[1]): 1.0, (old[0], new[0]): 0.0})
    assert scores[old[0], new[1]] > scores[old[1], new[1]]
    assert selected(scores, lambda p: p == (old[0], new[1])) == [(old[0], new[1])] and selected({}, lambda p: True) == []


CONTESTED = {1: [{"rec_id": str(i), "step_name": "x", "elapsed": "x"} for i in range(3)], 2: [{"rec_id": str(i), "elapsed_s": "x", "stepName": "x"} for i in range(3)]}


def test_flooding_decides_contested_fields(spark, monkeypatch):
    """Two gone and two new fields of the same values: only the flooded names tell which is which; without scores none is renamed."""
    df = spark.createDataFrame(lines("f", CONTESTED), "feed string, file_no long, body string, owner string")
    want = {("f", 2, "renamed", "stepName", "step_name"), ("f", 2, "renamed", "elapsed_s", "elapsed")}
    assert {tuple(r) for r in schema_changes(df).collect()} == want
    monkeypatch.setattr(drift, "BROADCAST", 0)  # joined in parts
    assert {tuple(r) for r in schema_changes(df).collect()} == want
    monkeypatch.setattr(drift, "flood", lambda *a: {})
    assert {r.change_kind for r in schema_changes(df).collect()} == {"added", "removed"}


def test_parents_are_arguments(spark):
    files = {1: [{"rec_id": "1", "box": {"w": 1, "h": 2}}], 2: [{"rec_id": "1", "case": {"w": 1, "height": 2}}]}
    df = spark.createDataFrame(lines("f", files), "feed string, file_no long, body string, owner string")
    got = {tuple(r)[2:] for r in drift.schema_changes(df, parents=Parents({"box": ("w", "h", "height")})).collect()}
    assert got == {("renamed", "case", "box"), ("renamed", "case.height", "box.h")}
    assert {tuple(r)[2:] for r in drift.schema_changes(df).collect()} == {("removed", "box", "box"), ("added", "case", "")}


def test_query_against_brute_force(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/raw_deliveries.parquet").select("feed", "file_no", "body").collect()]
    got = [tuple(r) for r in p2_found(spark, data).collect()]
    assert got and len(got) == len(set(got)) and set(got) == brute(rows)
    whole = p2_table(spark, data).collect()
    assert {r.kind for r in whole} == {"trace", "status", "step"}


def test_sparse_parents(spark):
    """Parents are known by all of a file's records, or by name, however few usual keys a record has."""
    files = {
        1: [{"rec_id": "1", "intent_llm": {"intent": "a", "parameters": {}}}, {"rec_id": "2", "intent_llm": {"intent": "b"}}, {"rec_id": "3", "intent_llm": {"item_id": "i", "intent": "c"}}],
        2: [{"rec_id": "1", "intent_llm": {"label": "a", "parameters": {}}}, {"rec_id": "2", "intent_llm": {"label": "b"}}, {"rec_id": "3", "intent_llm": {"item_id": "i", "label": "c"}}],
        3: [{"rec_id": "1", "parsed": {"name": "a", "parameters": {}}}, {"rec_id": "3", "parsed": {"item_id": "i", "name": "c"}}],
        4: [{"rec_id": "3", "parsed": {"item": "i", "name": "c"}}],
    }
    # Content in which usual keys are rare is no parent.
    files[1] += [{"rec_id": str(n), "current": {"x": n, **({"branch": 1} if n == 10 else {"flags": 1} if n == 11 else {})}} for n in range(10, 20)]
    df = spark.createDataFrame(lines("f", files), "feed string, file_no long, body string, owner string")
    want = {
        ("f", 2, "renamed", "intent_llm.label", "intent_llm.intent"), ("f", 2, "removed", "current", "current"),
        ("f", 3, "renamed", "parsed", "intent_llm"), ("f", 3, "renamed", "parsed.name", "intent_llm.label"),
        ("f", 4, "renamed", "parsed.item", "parsed.item_id"), ("f", 4, "removed", "parsed.parameters", "parsed.parameters"),
    }
    got = [tuple(r) for r in schema_changes(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    whole = {(r.file_no, r.rec_id): r for r in consistent_table(df).collect()}
    assert whole[4, "3"].fields == {"rec_id": "3", "intent_llm.item_id": "i", "intent_llm.intent": "c"} and whole[2, "2"].kind == "trace"
