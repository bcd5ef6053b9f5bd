"""Language-model functions on rows: prompt, backend, clean-up, typed result. The backend is injected."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkweave.functions.jsonvalue import embedded_object
from inkweave.session import cut


class Backend(Protocol):
    """Anything that turns a prompt into text."""

    def generate(self, prompt: str) -> str: ...


class EchoBackend:
    """A deterministic backend for tests and offline runs: answers by a function of the prompt."""

    def __init__(self, answer: Callable[[str], str] = lambda prompt: json.dumps({"answer": prompt})) -> None:
        self.answer = answer

    def generate(self, prompt: str) -> str:
        return self.answer(prompt)


class HttpBackend:
    """A local model server with the common chat-completion interface."""

    def __init__(self, url: str, model: str, timeout: float = 30.0, temperature: float = 0.1) -> None:
        self.url, self.model, self.timeout, self.temperature = url, model, timeout, temperature

    def generate(self, prompt: str) -> str:
        from urllib.request import Request, urlopen

        body = {"model": self.model, "temperature": self.temperature, "messages": [{"role": "user", "content": prompt}]}
        request = Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urlopen(request, timeout=self.timeout) as answer:
            return json.load(answer)["choices"][0]["message"]["content"]


class TimedBackend:
    """A backend whose calls are given up after some seconds, whether they end or not; the row gets ``timeout``."""

    def __init__(self, backend: Backend, seconds: float) -> None:
        self.backend, self.seconds = backend, seconds

    def generate(self, prompt: str) -> str:
        from queue import Empty, SimpleQueue
        from threading import Thread

        done: SimpleQueue = SimpleQueue()

        def call() -> None:
            try:
                done.put((self.backend.generate(prompt), None))
            except Exception as e:  # noqa: BLE001
                done.put((None, e))

        Thread(target=call, daemon=True).start()  # nobody waits for it
        try:
            answer, error = done.get(timeout=self.seconds)
        except Empty:
            raise TimeoutError from None
        if error is not None:
            raise error
        return answer


def first_serving(*backends: Backend, seconds: float = 5.0) -> Backend | None:
    """The first backend that answers a short prompt in time, None if none does."""
    for backend in backends:
        try:
            TimedBackend(backend, seconds).generate("ping")
        except Exception:  # noqa: BLE001
            continue
        return backend
    return None


class JsonBackend:
    """A local model server with the plain generate interface, asked for JSON at temperature 0."""

    def __init__(self, url: str, model: str, timeout: float = 10.0, tokens: int = 3_000) -> None:
        self.url, self.model, self.timeout, self.tokens = url, model, timeout, tokens

    def generate(self, prompt: str) -> str:
        from urllib.request import Request, urlopen

        body = {"model": self.model, "prompt": prompt, "format": "json", "stream": False, "options": {"temperature": 0, "num_predict": self.tokens}}
        request = Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urlopen(request, timeout=self.timeout) as answer:
            return json.load(answer)["response"]


def parse(raw: str | None, expected: tuple[str, ...] = ()) -> dict:
    """An answer's JSON object without thinking and text around it, with null for expected keys it lacks;
    ``{"error": "invalid_json", "raw": ...}`` if there is none."""
    cleaned = re.sub(r"(?s)<think>.*?</think>", "", raw or "").strip()
    value = embedded_object(cleaned)
    if value is None:
        return {"error": "invalid_json", "raw": cleaned}
    return {**dict.fromkeys(k for k in expected if k not in value), **value}


def _text(value: object) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value)


def ask(
    df: DataFrame, prompt: Column, keys: tuple[str, ...], make_backend: Callable[[], Backend], name: str = "answer", delay: float = 0.0, raw_fallback: str | None = None
) -> DataFrame:
    """Every row with ``name``: a struct of the wanted keys (as text) and ``error``.

    One backend per partition; ``delay`` seconds between calls limit its rate. A failing call is the
    row's ``error``, not the job's. ``raw_fallback`` is the key that takes the whole answer where it
    has no JSON. A null prompt isn't asked. Other columns pass through.
    """
    kind = T.StructType([T.StructField(k, T.StringType()) for k in (*keys, "error")])
    schema = T.StructType([*df.schema.fields, T.StructField(name, kind)])

    def one(backend: Backend, text: str | None) -> dict:
        if text is None:
            return dict.fromkeys((*keys, "error"))
        try:
            raw = backend.generate(text)
        except Exception as e:  # noqa: BLE001
            return {**dict.fromkeys(keys), "error": "timeout" if isinstance(e, TimeoutError) else f"{type(e).__name__}: {e}"}
        value = parse(raw, keys)
        out = {k: _text(value.get(k)) for k in keys} | {"error": value.get("error") if "raw" in value else None}
        if raw_fallback and not out[raw_fallback]:
            out[raw_fallback] = (raw or "").strip() or None
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = make_backend()
        for batch in batches:
            found = []
            for text in batch.pop("__prompt"):
                found.append(one(backend, None if text is None or text != text else text))
                if delay:
                    time.sleep(delay)
            batch[name] = found
            yield batch

    return df.withColumn("__prompt", prompt).mapInPandas(run, schema)


def prompted(template: str, **columns: Column) -> Column:
    """A prompt with columns in the places named in braces; null where one of them is."""
    parts, rest = [], template
    for piece in re.split(r"(\{\w+\})", rest):
        parts.append(columns[piece[1:-1]] if piece[:1] == "{" and piece[1:-1] in columns else F.lit(piece))
    return F.concat(*parts)


def general_answer(df: DataFrame, question: str, make_backend: Callable[[], Backend], **options) -> DataFrame:
    """A question's ``answer``; the whole text where the model gives no JSON."""
    prompt = prompted('Answer the question. Return JSON {"answer": ...}.\nQuestion: {q}', q=F.col(question))
    return ask(df, prompt, ("answer",), make_backend, raw_fallback="answer", **options)


def edited(df: DataFrame, artifact: str, instructions: str, make_backend: Callable[[], Backend], **options) -> DataFrame:
    """An artifact after instructions, ``edited``."""
    prompt = prompted('Apply the instructions to the text. Return JSON {"edited": ...}.\nInstructions: {i}\nText: {a}', i=F.col(instructions), a=F.col(artifact))
    return ask(df, prompt, ("edited",), make_backend, raw_fallback="edited", **options)


def classified(df: DataFrame, text: str, labels: list[str], make_backend: Callable[[], Backend], **options) -> DataFrame:
    """One of the labels as ``label``, null if the model names none."""
    prompt = prompted(f'Choose one label of {json.dumps(labels)}. Return JSON {{"label": ...}}.\nText: {{t}}', t=F.col(text))
    return ask(df, prompt, ("label",), make_backend, **options)


def extracted(df: DataFrame, text: str, fields: list[str], make_backend: Callable[[], Backend], **options) -> DataFrame:
    """The wanted fields of a text, null where missing."""
    prompt = prompted(f"Extract the fields {json.dumps(fields)} as JSON, null where missing.\nText: {{t}}", t=F.col(text))
    return ask(df, prompt, tuple(fields), make_backend, **options)


def described(df: DataFrame, text: str, make_backend: Callable[[], Backend], **options) -> DataFrame:
    """Title, short and long summary and source of a text."""
    keys = ("title", "summary_short", "summary_long", "source_url")
    return ask(df, prompted(f"Give {json.dumps(keys)} of the text as JSON.\nText: {{t}}", t=F.col(text)), keys, make_backend, **options)


def graded(df: DataFrame, text: str, question: str, key: str, make_backend: Callable[[], Backend], **options) -> DataFrame:
    """Whether a statement holds of a text, as the JSON key ``key``; filter on it to keep the rows that pass."""
    return ask(df, prompted(f"{question} Return JSON {{{json.dumps(key)}: true or false}}.\nText: {{t}}", t=F.col(text)), (key,), make_backend, **options)


def rewritten(df: DataFrame, text: str, task: str, key: str, make_backend: Callable[[], Backend], **options) -> DataFrame:
    """A text rewritten for a task, as the JSON key ``key``."""
    return ask(df, prompted(f"{task} Return JSON {{{json.dumps(key)}: ...}}.\nText: {{t}}", t=F.col(text)), (key,), make_backend, raw_fallback=key, **options)


def listed(df: DataFrame, text: str, task: str, key: str, make_backend: Callable[[], Backend], most: int = 5, **options) -> DataFrame:
    """The values that a model lists for a text, one a row: the other columns, ``place`` from 1 and ``value``; at most ``most``, as the task asks."""
    prompt = prompted(f"{task} Return JSON {{{json.dumps(key)}: [...]}} with at most {most} values.\nText: {{t}}", t=F.col(text))
    found = ask(df, prompt, (key,), make_backend, **options)
    values = F.slice(F.coalesce(F.from_json(F.col(f"answer.{key}"), "array<string>"), F.array().cast("array<string>")), 1, most)
    rows = found.select(*df.columns, F.posexplode(values).alias("__at", "value"))
    return rows.select(*df.columns, (F.col("__at") + 1).alias("place"), "value").where("value is not null")


def compared(df: DataFrame, a: str, b: str, context: str, kind: str, make_backend: Callable[[], Backend], **options) -> DataFrame:
    """Whether two names of candidates from a join are one thing of a kind, and whether one is broader: ``answer.is_same``, ``answer.is_broad``."""
    task = f"Do both names mean the same {kind}, and is one of them broader? Return JSON {{\"is_same\": true or false, \"is_broad\": true or false}}.\nNames: {{a}} | {{b}}\nContext: {{c}}"
    return ask(df, prompted(task, a=F.col(a), b=F.col(b), c=F.coalesce(F.col(context), F.lit(""))), ("is_same", "is_broad"), make_backend, **options)


def metadata(df: DataFrame, text: str, task: str, make_backend: Callable[[], Backend], **options) -> DataFrame:
    """Whatever JSON object a model gives for a task, as the variant ``answer``; ``{"error": "invalid_json", "raw": ...}`` if it is none."""
    prompt = prompted(f"{task} Return a JSON object.\nText: {{t}}", t=F.col(text))
    kind = T.StructType([*df.schema.fields, T.StructField("answer", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = make_backend()
        for batch in batches:
            found = []
            for p in batch.pop("__prompt"):
                try:
                    found.append(None if p is None or p != p else json.dumps(parse(backend.generate(p))))
                except Exception as e:  # noqa: BLE001
                    found.append(json.dumps({"error": "timeout" if isinstance(e, TimeoutError) else f"{type(e).__name__}: {e}"}))
            batch["answer"] = found
            yield batch

    return df.withColumn("__prompt", prompt).mapInPandas(run, kind).withColumn("answer", F.try_parse_json("answer"))


def summarized_groups(df: DataFrame, by: list[str], text: str, order: str, make_backend: Callable[[], Backend], most_chars: int = 20_000, fan: int = 8, **options) -> DataFrame:
    """A summary of each group's texts: the group, its ``context`` (what the last call read) and ``answer``.

    A call reads at most about ``most_chars`` characters: longer texts are cut into pieces and a group's pieces
    summarised in parts; then ``fan`` summaries at a time, until each group has one. No text and no group is
    left out; a part is gathered in one place, a group never. Null texts add nothing.
    """
    from pyspark.sql import Window

    size = F.coalesce(F.char_length("__text"), F.lit(0))
    pieces = df.select(*by, F.col(order).alias("__order"), F.col(text).alias("__text"))
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(size / most_chars) - 1, F.lit(0)).cast("int"))
    pieces = pieces.select(*by, "__order", F.posexplode(F.transform(starts, lambda i: F.substring(F.col("__text"), i * most_chars + 1, F.lit(most_chars)))).alias("__piece", "__text"))
    so_far = F.sum(size).over(Window.partitionBy(*by).orderBy("__order", "__piece").rowsBetween(Window.unboundedPreceding, -1))
    parts = pieces.withColumn("__part", F.floor(F.coalesce(so_far, F.lit(0)) / most_chars).cast("long"))
    prompt = prompted('Summarize the texts. Return JSON {"summary": ...}.\nTexts:\n{t}', t=F.col("context"))
    while True:
        lined = parts.groupBy(*by, "__part").agg(F.array_sort(F.collect_list(F.struct("__order", "__piece", "__text"))).alias("__rows"))
        context = lined.select(*by, "__part", F.array_join(F.col("__rows.__text"), "\n").alias("context"))
        done = cut(ask(context, prompt, ("summary",), make_backend, raw_fallback="summary", **options))
        if done.groupBy(*by).count().where("count > 1").isEmpty():
            return done.drop("__part")
        place = F.row_number().over(Window.partitionBy(*by).orderBy("__part")) - 1
        parts = done.select(*by, F.col("__part").alias("__order"), F.lit(0).alias("__piece"), F.coalesce("answer.summary", F.lit("")).alias("__text"), F.floor(place / fan).cast("long").alias("__next"))
        parts = parts.withColumnRenamed("__next", "__part")
