"""A turn over ideas: strategies, keep-first, anti-filter, criteria, policy, buckets."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkweave.operators.keyed import keep_first, keep_last, key_changes, not_in, rows_not_in, value_changes

Strategy = Callable[[DataFrame], DataFrame]
Criterion = Callable[[], Column]
Policy = Callable[[dict[str, Column]], Column]
STATUSES = ("accepted", "rejected", "deferred")


class Registry(dict):
    """Named functions; a later one of the same name takes the earlier one's place."""

    def register(self, function: Callable, name: str | None = None) -> Callable:
        self[name or function.__name__] = function
        return function


def default_policy(results: dict[str, Column]) -> Column:
    """All criteria met: accepted; none: rejected; else deferred."""
    met = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(False)).cast("int") for c in results.values()], F.lit(0))
    return F.when(met == len(results), "accepted").when(met == 0, "rejected").otherwise("deferred")


@dataclass
class Turn:
    """One run's frames. ``ideas`` is what was decided on, ``criteria`` the long form, ``decisions`` with status."""

    ideas: DataFrame
    criteria: DataFrame
    decisions: DataFrame


@dataclass
class TurnEngine:
    """Declares a turn as one plan. Strategies give ``key`` and other columns, and are kept in order:
    of several ideas for a key the first strategy's first one stays."""

    strategies: dict[str, Strategy]
    criteria: dict[str, Criterion]
    policy: Policy = default_policy
    order: tuple[str, ...] = ("key",)
    columns: list[str] = field(default_factory=list)

    def ideas(self, corpus: DataFrame) -> DataFrame:
        parts = []
        for i, (name, strategy) in enumerate(self.strategies.items()):
            part = strategy(corpus)
            if "key" not in part.columns:
                raise ValueError(f"strategy {name} gives no key")
            parts.append(part.withColumns({"strategy": F.lit(name), "strategy_ord": F.lit(i)}))
        return keep_first(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).where("key is not null"), ["key"], "strategy_ord", *self.order)

    def run(self, corpus: DataFrame, past: DataFrame | None = None) -> Turn:
        """``past`` has ``key, status``: only accepted decisions suppress an idea."""
        ideas = self.ideas(corpus)
        if past is not None:
            ideas = not_in(ideas, past.where(F.col("status") == "accepted"), "key")
        results = {name: criterion() for name, criterion in self.criteria.items()}
        judged = ideas.withColumns({f"criterion_{n}": c for n, c in results.items()})
        long = judged.select("key", F.explode(F.create_map(*[x for n in results for x in (F.lit(n), F.col(f"criterion_{n}"))])).alias("criterion", "passed"))
        status = self.policy({n: F.col(f"criterion_{n}") for n in results})
        return Turn(ideas, long, judged.withColumn("status", status))


def accumulate(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored decisions with a turn's: of several for one key in one bucket (``status``) the last by ``ord`` counts; a key may stay in several buckets."""
    return keep_last(stored.unionByName(new), ["status", "key"], "ord")


def turn_diff(old: Turn, new: Turn) -> dict[str, DataFrame]:
    """What two turns differ in: ideas and strategies by name, criteria by result, decisions by whole rows in each bucket."""
    cast = lambda t: t.criteria.groupBy("key").agg(F.to_json(F.sort_array(F.collect_list(F.struct("criterion", "passed")))).alias("results"))
    both = ["key", "status"]
    return {
        "ideas": key_changes(old.decisions, new.decisions, "key"),
        "strategies": key_changes(old.ideas, new.ideas, "strategy"),
        "criteria": value_changes(cast(old), cast(new), "key", "results"),
        "decisions_added": rows_not_in(new.decisions.select(both), old.decisions.select(both)),
        "decisions_removed": rows_not_in(old.decisions.select(both), new.decisions.select(both)),
    }


def traced(decisions: DataFrame, turns: DataFrame) -> DataFrame:
    """Each decision with its turn; one without a turn is left out."""
    return decisions.join(turns, "turn_id")
