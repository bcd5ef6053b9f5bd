"""Merging of records and edits to them."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def deep_merged(base: object, updates: object) -> object:
    """Objects are merged key by key, updates win; anything else, lists too, is replaced."""
    if not isinstance(base, dict) or not isinstance(updates, dict):
        return updates
    out = dict(base)
    for key, value in updates.items():
        out[key] = deep_merged(out[key], value) if key in out else value
    return out


@F.pandas_udf(T.StringType())
def deep_merge(base: pd.Series, updates: pd.Series) -> pd.Series:
    """:func:`deep_merged` of two JSON columns; null or broken updates change nothing, a null or broken base is replaced.

    Open objects have no fixed schema, and Spark has no merge of variants, hence an Arrow UDF.
    """

    def merged(b: str | None, u: str | None) -> str | None:
        try:
            change = json.loads(u) if u else None
        except ValueError:
            change = None
        if change is None:
            return b
        try:
            old = json.loads(b) if b else None
        except ValueError:
            old = None
        return json.dumps(deep_merged(old, change), ensure_ascii=False)

    return pd.Series([merged(b, u) for b, u in zip(base, updates)], dtype="object")


def shallow_merge(base: Column, updates: Column) -> Column:
    """Two maps as one, updates win (with ``spark.sql.mapKeyDedupPolicy=LAST_WIN``); a null update changes nothing."""
    return F.when(updates.isNull(), base).when(base.isNull(), updates).otherwise(F.map_concat(base, updates))


def without_keys(fields: Column, *keys: str) -> Column:
    """A map without some keys."""
    return F.map_filter(fields, lambda k, _: ~k.isin(*keys))


def renamed_key(fields: Column, old: str, new: str) -> Column:
    """A map with one key under another name; a key that already had it gives way."""
    kept = F.map_filter(fields, lambda k, _: ~k.isin(old, new))
    return F.when(F.map_contains_key(fields, old), F.map_concat(kept, F.map_from_arrays(F.array(F.lit(new)), F.array(fields[old])))).otherwise(fields)


def upto(outputs: Column, positions: Column, target: Column) -> Column:
    """A map of step outputs without those of a step and all after it, by the steps' positions."""
    return F.map_filter(outputs, lambda step, _: positions[step] < positions[target])
