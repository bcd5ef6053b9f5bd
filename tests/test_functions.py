import json
import math
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from inkweave.functions import geometry, merging, model, text
from inkweave.functions.jsonvalue import canonical_text, embedded_object
from inkweave.functions.merging import deep_merged


def one(spark, *columns, rows="1 AS x"):
    return tuple(spark.sql(f"SELECT {rows}").select(*columns).first())


def test_texts(spark):
    lit = F.lit
    assert one(spark, text.clean_phrases(lit(" A-b, c!  d\té\n")), text.spoken(lit("It's Ä_b!")), text.stripped(lit("　 a \n"))) == ("A-b c d", "its ä_b", "a")
    assert one(spark, text.non_filler_words(lit("a sixsix seven77 eight888")), F.size(text.tokens(lit(" ,, ")))) == (3, 0)
    assert one(spark, text.without_thinking(lit("<think>a\nb</think> {x} <think>c</think>")), text.braced(lit("a {b} c} d")), text.braced(lit("none")), text.braced(lit("none"), True)) == ("{x}", "{b} c}", None, "none")
    assert one(spark, text.title(lit('"One" two')), text.title(lit("\nFirst.\nsecond")), text.title(lit("Whole."))) == ("One", "First", "Whole")
    assert one(spark, text.last_word(lit("a b c")), text.last_word(lit("a b")), text.after_colon(lit("x: y: z ")), text.after_colon(lit("x"))) == ("c", None, "y: z", None)
    assert one(spark, text.case_aliases(lit("A, B v. C"), lit("12-3"))) == (["A, B v. C", "A B v. C", "A, B v C", "A, B v.. C", "12-3"],)
    assert one(spark, text.joined_messages(F.array(lit(" a "), lit(""), lit(None), lit("b")))) == ("a\n\nb",)
    assert one(spark, text.rendered(lit("!"), lit("T"), lit("body"), F.array(lit("x"), lit("y")), lit(None).cast("string"))) == ("! **T**\n\nbody\n\n- x\n- y",)
    assert one(spark, text.size_tier([lit("abcdef"), lit("abc"), lit("a")], 3), text.size_tier([lit("abcdef"), lit("abc")], 1), text.size_tier([lit("abcdef")], None)) == ("abc", "abc", "abcdef")


def test_answers(spark):
    raw = '<think>{"no": 1}</think>Sure: {"n": 3, "t": "x", "b": true, "d": 1.5} end'
    v = text.parsed_answer(F.lit(raw))
    assert one(spark, text.answer_key(v, "n", "bigint"), text.answer_key(v, "t"), text.answer_key(v, "b", "boolean"), text.answer_key(v, "b", "bigint"), text.answer_key(v, "d", "double"), text.answer_key(v, "n")) == (3, "x", True, None, 1.5, None)
    assert one(spark, text.answer_key(text.parsed_answer(F.lit("no braces")), "error"), text.answer_key(text.parsed_answer(F.lit("{bad}")), "raw")) == ("invalid_json", "{bad}")
    assert model.parse(raw, ("t", "u")) == {"u": None, "n": 3, "t": "x", "b": True, "d": 1.5} and model.parse("x", ("k",)) == {"error": "invalid_json", "raw": "x"}
    assert embedded_object('a {"x": [1]} b') == {"x": [1]} and embedded_object("[1]") is None and embedded_object(None) is None


def test_ratios():
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
        return row[-1]

    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("abcd ") for _ in range(rng.randrange(0, 90))) for _ in range(2))
        assert text.common_subsequence(a, b) == lcs(a, b)
    assert text.edit_ratio("", "") == 100 and text.edit_ratio("abcd", "abed") == 75
    assert text.sequence_ratio("TIDE!", "diet") == 0.25 and text.sequence_ratio("diet", "tide") == 0.5
    assert text.sequence_ratio("a" * 250, "a" * 249 + "b") == SequenceMatcher(None, "a" * 250, "a" * 249 + "b").ratio()


def test_ratio_columns(spark):
    df = spark.createDataFrame([("tide", "diet"), (None, "x"), ("", "")], "a string, b string")
    assert [tuple(r) for r in df.select(text.fuzzy_ratio("a", "b"), text.subsequence_ratio("a", "b")).collect()] == [(0.25, 50.0), (None, None), (1.0, 100.0)]


def test_geometry(spark):
    nice = lambda v, near=True: one(spark, geometry.nice_number(F.lit(v), near))[0]
    assert [nice(v) for v in (1.4, 2.9, 3.0, 69.0, 71.0, 0.012)] == [1, 2, 5, 50, 100, 0.01] and nice(0.0) is None and nice(-3.0) is None
    assert [nice(v, False) for v in (1.0, 1.1, 2.1, 5.1)] == [1, 2, 5, 10]
    assert one(spark, *geometry.axis(F.lit(87.0))) == (20.0, 100.0) and one(spark, *geometry.axis(F.lit(0.0))) == (0.2, 0.0)
    assert one(spark, geometry.css_color(F.array(*map(F.lit, (1, 2, 3)))), geometry.css_color(F.array(*map(F.lit, (1, 2, 3, 51)))), geometry.css_color(F.array(F.lit(1)))) == ("rgb(1,2,3)", "rgba(1,2,3,0.200)", None)
    angle, x, y = one(spark, *geometry.on_circle(F.lit(0), F.lit(4), 10.0, 20.0, 5.0))
    assert math.isclose(angle, -math.pi / 2) and math.isclose(x, 10) and math.isclose(y, 15)
    assert one(spark, geometry.large_arc(F.lit(0.0), F.lit(4.0)), geometry.large_arc(F.lit(6.0), F.lit(7.0)), geometry.on_line(F.lit(2), 1.0, 3.0)) == (1, 0, 7.0)


def test_merging(spark):
    assert deep_merged({"a": {"x": 1, "y": [1]}, "b": 2}, {"a": {"y": [2], "z": None}, "c": {}}) == {"a": {"x": 1, "y": [2], "z": None}, "b": 2, "c": {}}
    assert deep_merged({"a": 1}, {}) == {"a": 1} and deep_merged([1], {"a": 1}) == {"a": 1}
    rows = spark.createDataFrame([('{"a": {"b": 1}}', '{"a": {"c": 2}}'), (None, '{"x": 1}'), ('{"x": 1}', None), ("bad", '{"y": 1}'), ('{"x": 1}', "bad")], "b string, u string")
    assert [json.loads(r[0]) for r in rows.select(merging.deep_merge("b", "u")).collect()] == [{"a": {"b": 1, "c": 2}}, {"x": 1}, {"x": 1}, {"y": 1}, {"x": 1}]
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    m = F.create_map(*map(F.lit, ("a", "1", "b", "2")))
    assert one(spark, merging.shallow_merge(m, F.create_map(F.lit("a"), F.lit(None).cast("string"))), merging.without_keys(m, "a"), merging.renamed_key(m, "a", "c"), merging.renamed_key(m, "z", "c")) == ({"a": None, "b": "2"}, {"b": "2"}, {"b": "2", "c": "1"}, {"a": "1", "b": "2"})
    outputs, positions = F.create_map(*map(F.lit, ("s1", "x", "s2", "y", "s3", "z"))), F.create_map(*map(F.lit, ("s1", 0, "s2", 1, "s3", 2)))
    assert one(spark, merging.upto(outputs, positions, F.lit("s2"))) == ({"s1": "x"},)


def test_canonical_json():
    same = ['{"a": [1, 2.0, "é"], "b": null}', ' {"a":["\\u00e9",2,1e0]} ']
    assert canonical_text(same[0]) == canonical_text(same[1]) != canonical_text('{"a": [1, 2]}')
    assert canonical_text(None) == canonical_text("") == canonical_text("null") != canonical_text("{}")
    assert canonical_text("true") != canonical_text("1") and canonical_text(" x ") == canonical_text("x")


def test_model_rows(spark):
    df = spark.createDataFrame([(1, "hi"), (2, None), (3, "boom")], "id long, question string")

    class Failing(model.EchoBackend):
        def generate(self, prompt):
            if "boom" in prompt:
                raise TimeoutError
            return super().generate(prompt)

    got = {r.id: r.answer for r in model.general_answer(df, "question", lambda: Failing(lambda p: "<think>x</think>plain")).collect()}
    assert got[1].answer == "<think>x</think>plain" and got[1].error == "invalid_json" and got[2].answer is None and got[3].error == "timeout"
    got = {r.id: r.answer for r in model.extracted(df, "question", ["a", "b"], lambda: model.EchoBackend(lambda p: '{"a": [1], "c": 2}')).collect()}
    assert got[1].a == "[1]" and got[1].b is None and got[1].error is None
    groups = model.summarized_groups(df.withColumn("g", F.lit(1)), ["g"], "question", "id", lambda: model.EchoBackend(lambda p: p.split("Texts:\n")[1]))
    assert groups.first().answer.summary == "hi\nboom"
    for found in (model.edited(df, "question", "question", model.EchoBackend), model.described(df, "question", model.EchoBackend), model.graded(df, "question", "Is it so?", "is_true", model.EchoBackend), model.rewritten(df, "question", "Shorten.", "title", model.EchoBackend), model.classified(df, "question", ["x"], model.EchoBackend)):
        assert found.count() == 3


def test_no_group_is_lost(spark):
    """Texts beyond what a call reads are cut into pieces, and groups summarised in parts."""
    rows = [("g", i, "ab" * (30 if i == 0 else 4)) for i in range(40)] + [("h", 0, "x"), ("n", 0, None)]
    df = spark.createDataFrame(rows, "g string, i int, t string")
    sizes = lambda p: '{"summary": "%s"}' % ("+" * p.split("Texts:\n")[1].replace("+", "").replace("\n", "").count("ab") or p.split("Texts:\n")[1].replace("\n", ""))
    got = {r.g: r.answer.summary for r in model.summarized_groups(df, ["g"], "t", "i", lambda: model.EchoBackend(sizes), most_chars=20, fan=3).collect()}
    assert set(got) == {"g", "h", "n"} and got["g"] == "+" * (30 + 39 * 4) and got["h"] == "x"


def test_backends_in_time():
    import time

    class Slow(model.EchoBackend):
        def generate(self, prompt):
            time.sleep(3)
            return "late"

    began = time.time()
    with pytest.raises(TimeoutError):
        model.TimedBackend(Slow(), 0.1).generate("x")
    assert time.time() - began < 2 and model.TimedBackend(model.EchoBackend(lambda p: p), 5).generate("x") == "x"
    broken = model.EchoBackend(lambda p: 1 / 0)
    good = model.EchoBackend(lambda p: "ok")
    assert model.first_serving(broken, good) is good and model.first_serving(broken) is None
    with pytest.raises(ZeroDivisionError):
        model.TimedBackend(broken, 5).generate("x")
