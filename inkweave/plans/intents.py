"""Intents of messages by rules, their validation, and edits said in words."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkweave.functions.model import Backend, ask, prompted
from inkweave.functions.text import after_colon, last_word, stripped

#: The first rule that holds names the intent. A prefix of the message, or words all of which are in it.
RULES = [
    ("show step", (), "show_step_output"),
    ("", ("list", "step", "output"), "list_step_outputs"),
    ("edit step", (), "edit_step_output"),
    ("show schema", (), "show_schema"),
    ("explain schema", (), "explain_schema"),
    ("", ("list", "items"), "query_workflow"),
    ("", ("describe", "workflow"), "describe_workflow"),
]
#: The intents that a message may name itself, in this order.
CONTRACT = ("list_workflow_items", "describe_workflow", "load_recent", "show_current_item", "rewind_substate", "create_item", "idle")


def rule_intent(message: Column | str, contract: tuple[str, ...] = CONTRACT) -> Column:
    """The intent of a message by the rules, else the first that it names, else ``idle``; null messages are idle."""
    text = F.lower(stripped(message))
    chosen = F.lit("idle")
    for prefix, words, intent in reversed([*RULES, *(("", (name,), name) for name in contract)]):
        holds = text.startswith(prefix) if prefix else F.lit(True)
        for word in words:
            holds = holds & text.contains(word)
        chosen = F.when(holds, intent).otherwise(chosen)
    return chosen


def parsed(messages: DataFrame, message: str) -> DataFrame:
    """Messages with ``intent``, ``step_name`` and ``edit_text``."""
    return messages.withColumns({"intent": rule_intent(message), "step_name": last_word(message), "edit_text": after_colon(message)})


def missing_parameters(intents: DataFrame, contract: DataFrame) -> DataFrame:
    """For each ``id`` the required parameters its ``parameters`` (a map) lack or have empty: ``contract`` has ``intent, parameter, required``."""
    required = contract.where("required").groupBy("intent").agg(F.sort_array(F.collect_set("parameter")).alias("wanted"))
    lacking = F.filter("wanted", lambda p: F.coalesce(F.col("parameters")[p], F.lit("")) == "")
    return intents.join(required, "intent").select("id", lacking.alias("missing")).where(F.size("missing") > 0)


def edit_kind(kind: Column, message: Column | str) -> Column:
    """What an edit does to a field of a JSON type, by the words of the message; null where they don't tell and a model must."""
    text = F.lower(message)
    asks = text.rlike("replace|rewrite|shorten|fix|edit")
    of_object = F.when(text.rlike("remove|delete"), "remove_key").when(text.contains("rename"), "rename_key").when(asks, "edit_value")
    return F.when((kind == "string") & asks, "replace").when((kind == "boolean") & text.contains("toggle"), "toggle").when(kind == "object", of_object)


def local_edit(fields: Column, kinds: dict[str, str], message: Column | str) -> Column:
    """An edit said in words, on a map of a record's fields: a struct of ``field, kind, value, error`` and the map after it.

    ``kinds`` has the editable fields with their JSON types. The steps, of which the first that fails
    gives the ``error`` and leaves the record as it was: the field that the message names first (``no field``,
    ``missing field``); what is done to it (:func:`edit_kind`; ``no transformation``); the value after the
    colon (``no value``; removals and toggles need none).
    """
    text = F.lower(message)
    place = lambda name: F.instr(text, name.lower())
    named = F.array_sort(F.filter(F.array(*(F.struct(place(n).alias("at"), F.lit(n).alias("name"), F.lit(k).alias("kind")) for n, k in sorted(kinds.items()))), lambda f: f["at"] > 0))
    field = F.try_element_at(named, F.lit(1))
    name, kind = field["name"], field["kind"]
    action, said = edit_kind(kind, message), after_colon(message)
    value = F.when(action == "toggle", F.when(F.lower(fields[name]) == "true", "false").otherwise("true")).when(action.isin("replace", "edit_value", "rename_key"), F.when(said != "", said))
    error = (
        F.when(name.isNull(), "no field").when(~F.map_contains_key(fields, F.coalesce(name, F.lit(""))), "missing field").when(action.isNull(), "no transformation")
        .when((action != "remove_key") & value.isNull(), "no value")
    )
    others = F.map_filter(fields, lambda k, _: k != name)
    after = (
        F.when(error.isNotNull(), fields).when(action == "remove_key", others).when(action == "rename_key", F.map_concat(F.map_filter(others, lambda k, _: k != value), F.map_from_arrays(F.array(value), F.array(fields[name]))))
        .otherwise(F.map_concat(others, F.map_from_arrays(F.array(name), F.array(value))))
    )
    return F.struct(name.alias("field"), action.alias("kind"), value.alias("value"), error.alias("error"), after.alias("fields"))


def model_field(df: DataFrame, message: str, fields: dict[str, str], make_backend: Callable[[], Backend], **options) -> DataFrame:
    """The editable field that a model picks for a message: ``field``, or null and why not in ``reason`` (``no field``, ``unknown field``)."""
    prompt = prompted(f'Which of the fields {json.dumps(sorted(fields))} is meant? Return JSON {{"field": name or null}}.\nMessage: {{m}}', m=F.col(message))
    asked = ask(df, prompt, ("field",), make_backend, "__answer", **options)
    said = F.col("__answer.field")
    known = said.isin(sorted(fields))
    return asked.withColumns({"field": F.when(known, said), "reason": F.when(F.coalesce(said, F.lit("")) == "", "no field").when(~known, "unknown field")}).drop("__answer")


def model_valid(df: DataFrame, field: str, value: str, kind: str, make_backend: Callable[[], Backend], **options) -> DataFrame:
    """Whether a new value makes sense for a field, ``valid``: a model says so, but isn't asked about removals, renames and toggles."""
    prompt = prompted('Does the value make sense for the field? Return JSON {"ok": true or false}.\nField: {f}\nValue: {v}', f=F.col(field), v=F.coalesce(value, F.lit("")))
    plain = F.coalesce(F.col(kind).isin("remove_key", "rename_key", "toggle"), F.lit(False))
    asked = ask(df, F.when(~plain, prompt), ("ok",), make_backend, "__answer", **options)
    return asked.withColumn("valid", plain | (F.coalesce("__answer.ok", F.lit("")) == "true")).drop("__answer")


def model_intent(df: DataFrame, message: str, contract: dict[str, str], make_backend: Callable[[], Backend], **options) -> DataFrame:
    """The intent of the contract (names with descriptions) that a model picks for a message, ``intent``; ``idle`` for any other answer and where the model fails."""
    prompt = prompted(f'Pick one intent of {json.dumps(contract, sort_keys=True)}. Return JSON {{"intent": name}}.\nMessage: {{m}}', m=F.col(message))
    asked = ask(df, prompt, ("intent",), make_backend, "__answer", **options)
    said = F.col("__answer.intent")
    return asked.withColumn("intent", F.when(said.isin(sorted(contract)), said).otherwise("idle")).drop("__answer")


def model_parameters(df: DataFrame, message: str, parameters: list[str], make_backend: Callable[[], Backend], **options) -> DataFrame:
    """The parameters that a model finds in a message, ``parameters`` (a map of those it gives a value); an empty one if none are asked for."""
    empty = F.create_map().cast("map<string,string>")
    if not parameters:
        return df.withColumn("parameters", empty)
    prompt = prompted(f"Find the parameters {json.dumps(parameters)} in the message, as JSON, null where missing.\nMessage: {{m}}", m=F.col(message))
    asked = ask(df, prompt, tuple(parameters), make_backend, "__answer", **options)
    pairs = F.map_from_arrays(F.array(*map(F.lit, parameters)), F.array(*(F.col(f"__answer.{p}") for p in parameters)))
    return asked.withColumn("parameters", F.map_filter(pairs, lambda _, v: v.isNotNull())).drop("__answer")
