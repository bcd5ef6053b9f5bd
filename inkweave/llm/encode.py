"""Encoding of a whole corpus with a byte-level BPE vocabulary."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkweave.llm.bpe import ByteBPE

#: Where the public vocabularies lie; a parameter of every function here.
TOKENIZERS = os.environ.get("INKWEAVE_TOKENIZERS", "/opt/tokenizers")
#: Characters whose ids are held at once in a task, besides those of one text.
CHUNK = 1 << 20

_LOADED: dict[str, ByteBPE] = {}


def tokenizer(path: str) -> ByteBPE:
    """The vocabulary, read once in each worker process."""
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(path)
    return _LOADED[path]


def _encoded(bpe: ByteBPE, texts: list[str | None]) -> pa.ListArray:
    values, ends = [np.empty(0, np.int32)], [0]
    for text in texts:
        if text:
            values.append(np.fromiter(bpe.encode(text), np.int32))
        ends.append(ends[-1] + (len(values[-1]) if text else 0))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values), pa.int32()))


def token_ids(
    df: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS
) -> DataFrame:
    """The key and ``ids`` (array of int) of every row, in one pass without a shuffle.

    The vocabulary is sent to the executors; only byte-level ones with the usual pattern are known, others raise ValueError.

    Method: the text is split by the vocabulary's pattern; each distinct piece of a task is merged by
    the hierarchical-bitmap rank queue of :mod:`inkweave.llm.bpe`, in time nearly linear in its length.
    Null and empty texts: an empty list. Repeated rows: one result each. Special tokens: none; their
    spellings are ordinary text. Other columns are not read, so their names can't clash.
    """
    path = f"{folder}/{name}.json"
    tokenizer(path)  # refuses other kinds before any task runs
    df.sparkSession.sparkContext.addFile(path)
    file = os.path.basename(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(SparkFiles.get(file))
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            start, chars = 0, 0
            for i, value in enumerate(texts):
                chars += len(value or "")
                if chars >= CHUNK or i + 1 == len(texts):
                    ids = _encoded(bpe, texts[start : i + 1])
                    yield pa.RecordBatch.from_arrays([keys.slice(start, i + 1 - start), ids], [key, "ids"])
                    start, chars = i + 1, 0

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])
    return df.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, schema)
