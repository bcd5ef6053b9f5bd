"""Queries on texts, transcripts, model answers and merges, each with its SQL where SQL has a way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkweave.functions.merging import deep_merge, renamed_key, without_keys
from inkweave.functions.model import EchoBackend, classified
from inkweave.functions.text import (
    after_colon, answer_key, braced, case_aliases, clean_phrases, fuzzy_ratio, joined_messages, last_word, non_filler_words, parsed_answer, size_tier, spoken, stripped, subsequence_ratio, title, without_thinking,
)
from inkweave.operators.sequences import clamped, laid_out, wrapped
from inkweave.operators.transcripts import align_clips, locate_contexts, locate_quotes, rare_tokens, token_frequency, words_of
from inkweave.session import table
from inkweave.sources.files import read_log


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each token of the documents occurs."""
    return token_frequency(table(spark, sf_dir, "documents"), "text")


def rare_item_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of evaluation items that the documents have at most twice."""
    documents = table(spark, sf_dir, "documents")
    return rare_tokens(table(spark, sf_dir, "eval_items"), "item_id", "text", token_frequency(documents, "text")).select("item_id", "token", "n", F.col("position").cast("long").alias("position"))


def long_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by kind: words of more than five characters."""
    return table(spark, sf_dir, "documents").where("text is not null").groupBy("doc_kind").agg(F.sum(non_filler_words("text")).alias("n"))


def log_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log lines in documents by level and logger."""
    lines = read_log(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return lines.groupBy("level", "logger").agg(F.count("*").alias("n"), F.min("logged_at").alias("first_at"), F.sum(F.char_length("message")).alias("chars"))


def parse_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intents of the model's answers: valid ones, and the keys they have."""
    rows = table(spark, sf_dir, "eval_traces").select("trace_id", "intent_llm").where("intent_llm is not null").distinct()
    parsed = rows.withColumn("v", parsed_answer("intent_llm"))
    keys = parsed.select(F.coalesce(answer_key(F.col("v"), "intent"), answer_key(F.col("v"), "error")).alias("intent"), answer_key(F.col("v"), "item_id").alias("item_id"), answer_key(F.col("v"), "reasoning").alias("reasoning"))
    return keys.groupBy("intent").agg(F.count("*").alias("n"), F.count("item_id").alias("with_item"), F.count("reasoning").alias("with_reasoning"))


def message_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts that commands have: last word, what follows a colon, a title, plain spoken text, without thinking, in braces."""
    rows = table(spark, sf_dir, "eval_traces").select("trace_id", "prompt", "intent_llm").distinct()
    return rows.select(
        "trace_id", last_word("prompt").alias("last_word"), after_colon("prompt").alias("edit_text"), title(F.coalesce("prompt", F.lit(""))).alias("title"), clean_phrases("prompt").alias("cleaned"),
        F.char_length(without_thinking("intent_llm")).cast("long").alias("said_chars"), F.char_length(braced("intent_llm")).cast("long").alias("braced_chars"),
    )


def merged_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt, answer and message of each trace as one text's length, and other spellings of the case's name."""
    rows = table(spark, sf_dir, "eval_traces").select("trace_id", F.array("prompt", "agent_response", "item_resolution.resolution_msg").alias("messages"), "case_name", "final_intent").distinct()
    aliases = case_aliases(F.coalesce("case_name", F.lit("")), "final_intent")
    return rows.select("trace_id", F.char_length(joined_messages("messages")).cast("long").alias("chars"), F.array_join(F.array_sort(aliases), "|").alias("aliases"))


def snapshot_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the tier of their snapshot that fits 400 characters: all, one record, the id."""
    full = F.concat_ws("|", F.col("doc_id").cast("string"), "text", "source")
    small = F.concat_ws("|", F.col("doc_id").cast("string"), F.col("source"), F.col("doc_kind"))
    chosen = size_tier([full, small, F.col("doc_id").cast("string")], 400)
    rows = table(spark, sf_dir, "documents").select(F.when(chosen == full, "full").when(chosen == small, "small").otherwise("minimal").alias("tier"), F.char_length(chosen).alias("c"))
    return rows.groupBy("tier").agg(F.count("*").alias("n"), F.sum("c").alias("chars"))


def map_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of ideas with a key removed and one renamed."""
    meta = F.from_json("metadata", "map<string,string>")
    rows = table(spark, sf_dir, "base_ideas").select("id", "metadata").where("id is not null").distinct().select("id", meta.alias("m")).where("m is not null")
    done = renamed_key(without_keys(F.col("m"), "turn"), "topic", "subject")
    return rows.select("id", done["origin"].alias("origin"), done["subject"].alias("subject"), done["turn"].alias("turn"), F.size(done).cast("long").alias("n"))


def deep_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step outputs with edits merged into them, which has nulls and objects in objects: each step's members after it."""
    rows = table(spark, sf_dir, "workflow_items").where("step_outputs is not null").select("id", "step_outputs").distinct()
    edits = '{"edited": {"by": "desk", "note": null}, "align_words": {"raw": {"by": "desk"}, "edits": ["e"], "schema_name": null}}'
    merged = rows.select("id", F.try_parse_json(deep_merge("step_outputs", F.lit(edits))).alias("m")).where("m is not null")
    steps = merged.select("id", F.explode(F.try_variant_get("m", "$", "map<string,variant>")).alias("step", "v"))
    get = lambda path: F.try_variant_get("v", path, "string")
    return steps.select("id", "step", get("$.by").alias("by"), get("$.raw.by").alias("raw_by"), get("$.raw.text").alias("raw_text"), get("$.edits[0]").alias("first_edit"), get("$.schema_name").alias("schema_name"), get("$.current.title").alias("title"))


def fuzzy_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How like each decision's idea is to the idea it is about, in both measures."""
    ideas = table(spark, sf_dir, "base_ideas").groupBy(F.col("id").alias("key")).agg(F.max("description").alias("description"))
    decided = table(spark, sf_dir, "decisions").select("decision_id", F.col("idea.key").alias("key"), F.col("idea.idea").alias("idea")).where("idea is not null").distinct()
    pairs = decided.join(ideas, "key")
    return pairs.select("decision_id", F.round(fuzzy_ratio("idea", "description"), 6).alias("ratio"), F.round(subsequence_ratio(spoken("idea"), spoken("description")), 6).alias("subsequence"))


def _recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transcripts among the documents as segments with times."""
    line = r"^\[(\d\d):(\d\d):(\d\d)\] ([^:]+): (.*)$"
    rows = table(spark, sf_dir, "documents").where((F.col("doc_kind") == "transcript") & F.col("text").isNotNull()).select(F.col("doc_id").alias("rec_id"), F.posexplode(F.split("text", "\n")).alias("idx", "line")).where(F.col("line").rlike(line))
    part = lambda i: F.regexp_extract("line", line, i)
    start = (part(1).cast("int") * 3600 + part(2).cast("int") * 60 + part(3).cast("int")).cast("double")
    text = part(5)
    return rows.select("rec_id", "idx", text.alias("text"), start.alias("start"), (start + F.size(F.split(text, " ")) * 0.4).alias("end"))


def clamped_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings' segments so that they don't go back in time: the last end and the total length."""
    rows = _recordings(spark, sf_dir).groupBy("rec_id").agg(F.array_sort(F.collect_list(F.struct("idx", "text", "start", "end"))).alias("rows"))
    done = rows.select("rec_id", clamped(F.col("rows")).alias("rows"))
    return done.select("rec_id", F.size("rows").cast("long").alias("segments"), F.round(F.element_at("rows", -1)["end"], 3).alias("last_end"))


def _quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences to look for: every segment of every recording."""
    return _recordings(spark, sf_dir).select("rec_id", F.col("idx").alias("quote_id"), F.col("text").alias("quote"))


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words_of(_recordings(spark, sf_dir))


def span_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each sentence of each recording is said."""
    return locate_quotes(_words(spark, sf_dir), _quotes(spark, sf_dir))


def tiered_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time that each sentence of each recording is about, and how it was found."""
    contexts = _quotes(spark, sf_dir).select("rec_id", F.col("quote_id").alias("context_id"), F.col("quote").alias("context"))
    return locate_contexts(_recordings(spark, sf_dir), contexts)


def clip_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clip a little off for each sentence, moved until its words fit the sentence."""
    words = _words(spark, sf_dir).select("rec_id", "idx", "text", (F.col("start") * 1000).cast("long").alias("start_ms"), (F.col("end") * 1000).cast("long").alias("end_ms"))
    clips = _recordings(spark, sf_dir).select("rec_id", F.col("idx").alias("clip_id"), F.col("text").alias("target"), (F.col("start") * 1000 - 700).cast("long").alias("start_ms"), (F.col("end") * 1000 + 900).cast("long").alias("end_ms"))
    return align_clips(words, clips)


def model_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label for each distinct document kind and language by a backend that answers by the prompt's length."""
    rows = table(spark, sf_dir, "documents").select("doc_kind", "lang").distinct()
    found = classified(rows, "doc_kind", ["short", "long"], lambda: EchoBackend(lambda p: '<think>x</think>so: {"label": "%s"}' % ("short" if len(p) < 100 else "long")), name="answer")
    return found.select("doc_kind", "lang", F.col("answer.label").alias("label"))


def wrapped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation items as lines of at most 40 characters."""
    rows = table(spark, sf_dir, "eval_items").where(F.trim("text") != "")
    lines = wrapped(F.split(stripped("text"), r"(?U)\s+"), 40)
    return rows.select("item_id", F.size(lines).cast("long").alias("lines"), F.array_join(lines, "\n").alias("wrapped"))


def block_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of an order's items as blocks below each other."""
    blocks = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("height"), F.lit(2.0).alias("gap"))
    return laid_out(blocks, ["l_orderkey"], "l_linenumber", "height", "gap").select("l_orderkey", "l_linenumber", "top", "total_height")


_TOKENS = r"regexp_split_to_array(trim(regexp_replace(regexp_replace(text, '[^A-Za-z0-9\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B-]', ' ', 'g'), '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B]+', ' ', 'g')), ' ')"
_SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B]"
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"

QUERIES = {
    "token_frequency": (token_counts, f"SELECT token, count(*) AS n FROM (SELECT unnest({_TOKENS}) AS token FROM documents) WHERE token <> '' GROUP BY ALL"),
    "rare_tokens": (rare_item_tokens, f"""
WITH f AS (SELECT token, count(*) AS n FROM (SELECT unnest({_TOKENS}) AS token FROM documents) GROUP BY ALL),
c AS (SELECT item_id, list_filter({_TOKENS}, lambda w: w <> '') AS ts FROM eval_items WHERE text IS NOT NULL),
e AS (SELECT item_id, unnest(ts) AS token, generate_subscripts(ts, 1) - 1 AS position FROM c)
SELECT item_id, token, coalesce(n, 0) AS n, position FROM e LEFT JOIN f USING (token) WHERE length(token) >= 4 AND coalesce(n, 0) <= 2"""),
    "non_filler_words": (long_words, r"SELECT doc_kind, sum(len(list_filter(regexp_split_to_array(text, '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B]+'), lambda w: length(w) > 5)))::BIGINT AS n FROM documents WHERE text IS NOT NULL GROUP BY ALL"),
    "log_levels": (log_levels, r"""
WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents),
m AS (SELECT regexp_extract(line, '^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})(?:,\d+)? \[([A-Z]+)\] ([^:\s]+): ([^\n]*)$', ['at', 'level', 'logger', 'message']) AS p FROM l WHERE regexp_matches(line, '^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})(?:,\d+)? \[([A-Z]+)\] ([^:\s]+): ([^\n]*)$'))
SELECT p.level AS level, p.logger AS logger, count(*) AS n, min(p.at) AS first_at, sum(length(p.message))::BIGINT AS chars FROM m GROUP BY ALL"""),
    "parse_llm_json": (parse_answers, r"""
WITH r AS (SELECT DISTINCT trace_id, intent_llm FROM eval_traces WHERE intent_llm IS NOT NULL),
b AS (SELECT regexp_extract(regexp_replace(intent_llm, '<think>.*?</think>', '', 'gs'), '\{.*\}', 0, 's') AS j FROM r),
v AS (SELECT CASE WHEN j <> '' AND json_valid(j) THEN j END AS j FROM b),
s AS (SELECT coalesce(json_extract_string(j, '$.intent'), 'invalid_json') AS intent, json_extract_string(j, '$.item_id') AS item_id, json_extract_string(j, '$.reasoning') AS reasoning FROM v)
SELECT intent, count(*) AS n, count(item_id) AS with_item, count(reasoning) AS with_reasoning FROM s GROUP BY ALL"""),
    "message_parts": (message_parts, rf"""
WITH r AS (SELECT DISTINCT trace_id, prompt, intent_llm FROM eval_traces), s AS (SELECT *, regexp_split_to_array({_STRIP.format('prompt')}, '\s+') AS w, {_STRIP.format("regexp_replace(intent_llm, '<think>.*?</think>', '', 'gs')")} AS said FROM r)
SELECT trace_id, CASE WHEN len(w) >= 3 THEN w[-1] END AS last_word, CASE WHEN contains(prompt, ':') THEN {_STRIP.format("substring(prompt, instr(prompt, ':') + 1)")} END AS edit_text,
  regexp_replace(CASE WHEN prompt LIKE '"%' THEN list_filter(string_split(prompt, '"'), lambda p: p <> '')[1] WHEN contains(prompt, chr(10)) THEN list_filter(string_split(prompt, chr(10)), lambda p: p <> '')[1] ELSE coalesce(prompt, '') END, '\.$', '') AS title,
  trim(regexp_replace(regexp_replace(prompt, '[^A-Za-z0-9\s-]', ' ', 'g'), '\s+', ' ', 'g')) AS cleaned, length(said) AS said_chars, length(nullif(regexp_extract(intent_llm, '\{{.*\}}', 0, 's'), '')) AS braced_chars FROM s"""),
    "merge_messages": (merged_messages, r"""
WITH r AS (SELECT DISTINCT trace_id, prompt, agent_response, item_resolution.resolution_msg AS msg, coalesce(case_name, '') AS c, final_intent FROM eval_traces),
m AS (SELECT *, list_filter(list_transform([prompt, agent_response, msg], lambda x: regexp_replace(x, '^[\s\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\s\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$', '', 'g')), lambda x: x IS NOT NULL AND x <> '') AS ms,
  list_filter([c, replace(c, ',', ''), replace(c, 'v.', 'v'), replace(c, 'v', 'v.'), final_intent], lambda x: x IS NOT NULL AND x <> '') AS al FROM r)
SELECT trace_id, coalesce(length(array_to_string(ms, chr(10) || chr(10))), 0) AS chars, array_to_string(list_sort(list_distinct(al)), '|') AS aliases FROM m"""),
    "snapshot_tier": (snapshot_tier, """
WITH t AS (SELECT concat_ws('|', doc_id::VARCHAR, text, source) AS f, concat_ws('|', doc_id::VARCHAR, source, doc_kind) AS s FROM documents)
SELECT CASE WHEN length(f) <= 400 THEN 'full' WHEN length(s) <= 400 THEN 'small' ELSE 'minimal' END AS tier, count(*) AS n, sum(CASE WHEN length(f) <= 400 THEN length(f) ELSE length(s) END)::BIGINT AS chars FROM t GROUP BY ALL"""),
    "map_edits": (map_edits, """
SELECT DISTINCT id, json_extract_string(metadata, '$.origin') AS origin, json_extract_string(metadata, '$.topic') AS subject, NULL::VARCHAR AS turn,
  (json_exists(metadata, '$.origin')::int + json_exists(metadata, '$.topic')::int)::BIGINT AS n FROM base_ideas WHERE id IS NOT NULL AND json_valid(metadata)"""),
    "deep_merge": (deep_merges, """
WITH d AS (SELECT DISTINCT id, step_outputs AS j FROM workflow_items WHERE step_outputs IS NOT NULL), v AS (SELECT id, CASE WHEN json_valid(j) THEN j ELSE '{}' END AS j FROM d),
k AS (SELECT DISTINCT id, j, unnest(list_concat(json_keys(j), ['edited', 'align_words'])) AS step FROM v), s AS (SELECT id, step, json_extract(j, '$."' || step || '"') AS o FROM k)
SELECT id, step, CASE step WHEN 'edited' THEN 'desk' ELSE json_extract_string(o, '$.by') END AS by, CASE step WHEN 'align_words' THEN 'desk' ELSE json_extract_string(o, '$.raw.by') END AS raw_by, json_extract_string(o, '$.raw.text') AS raw_text,
  CASE step WHEN 'align_words' THEN 'e' ELSE json_extract_string(o, '$.edits[0]') END AS first_edit, CASE WHEN step <> 'align_words' THEN json_extract_string(o, '$.schema_name') END AS schema_name, json_extract_string(o, '$.current.title') AS title FROM s"""),
    "fuzzy_ratio": (fuzzy_versions, None),
    "monotone_clamp": (clamped_recordings, r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS idx FROM documents WHERE doc_kind = 'transcript' AND text IS NOT NULL),
p AS (SELECT doc_id, idx, regexp_extract(line, '^\[(\d\d):(\d\d):(\d\d)\] ([^:]+): (.*)$', ['h', 'm', 's', 'who', 'said']) AS t FROM l WHERE regexp_matches(line, '^\[\d\d:\d\d:\d\d\] [^:]+: .*$')),
s AS (SELECT doc_id, idx, (t.h::INT * 3600 + t.m::INT * 60 + t.s::INT)::DOUBLE AS s, t.said AS said FROM p),
r AS (SELECT doc_id, count(*) AS segments, list_reduce(list_prepend({'s': -1e9::DOUBLE, 'e': -1e9::DOUBLE}, list({'s': s, 'e': s + len(string_split(said, ' ')) * 0.4::DOUBLE} ORDER BY idx)),
  lambda a, x: CASE WHEN x.s < a.e THEN {'s': a.e + 0.01::DOUBLE, 'e': CASE WHEN x.e < a.e + 0.01::DOUBLE THEN a.e + 0.02::DOUBLE ELSE x.e END} ELSE {'s': x.s, 'e': CASE WHEN x.e < x.s THEN x.s + 0.01::DOUBLE ELSE x.e END} END) AS last FROM s GROUP BY doc_id)
SELECT doc_id AS rec_id, segments, round(last.e, 3) AS last_end FROM r"""),
    "span_search": (span_search, None),
    "tiered_match": (tiered_match, None),
    "clip_alignment": (clip_alignment, None),
    "model_labels": (model_labels, """SELECT DISTINCT doc_kind, lang, CASE WHEN doc_kind IS NULL THEN NULL WHEN length('Choose one label of ["short", "long"]. Return JSON {"label": ...}.' || chr(10) || 'Text: ' || doc_kind) < 100 THEN 'short' ELSE 'long' END AS label FROM documents"""),
    "wrapped_lines": (wrapped_lines, rf"""
WITH w AS (SELECT item_id, regexp_split_to_array(regexp_replace(text, '^{_SPACE}+|{_SPACE}+$', '', 'g'), '{_SPACE}+') AS ws FROM eval_items WHERE trim(text) <> ''),
r AS (SELECT item_id, list_reduce(ws, lambda a, x: CASE WHEN length(regexp_extract(a, '[^\n]*$')) + 1 + length(x) <= 40 THEN a || ' ' || x ELSE a || chr(10) || x END) AS wrapped FROM w)
SELECT item_id, len(string_split(wrapped, chr(10))) AS lines, wrapped FROM r"""),
    "block_layout": (block_layout, "SELECT l_orderkey, l_linenumber, sum(l_quantity + 2) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - (l_quantity + 2) AS top, sum(l_quantity + 2) OVER (PARTITION BY l_orderkey) AS total_height FROM lineitem"),
}
