"""Record files whose fields drift: every change between files, and one consistent table."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkweave.functions.jsonvalue import digest, ordered
from inkweave.operators.flooding import flood, plain, selected
from inkweave.session import cut

#: So many of a parent's usual inner keys, in all of a file's objects of a name together, tell that the name is it.
ENOUGH = 2
#: What is asked of a pair of files is broadcast up to so many bytes in all; beyond, it is joined, with each file cut into so many parts.
BROADCAST, PARTS = 8 << 20, 32

TYPES = {str: 1, int: 2, float: 2, bool: 4, list: 8, dict: 16}


class Parents:
    """The objects whose inner keys are fields, under whatever name they go, with their usual keys, and the
    names of fields whose content is open, so that their type says nothing."""

    def __init__(self, keys: dict[str, Iterable[str]] | None = None, open_fields: Iterable[str] = ()) -> None:
        self.names, self.open = [*(keys or {})], [*open_fields]
        self._bits = {(role, plain(k)): 1 << i for i, (role, k) in enumerate((role, k) for role, usual in (keys or {}).items() for k in usual)}
        self.masks = {role: sum(b for (r, _), b in self._bits.items() if r == role) for role in self.names}
        self._seen: dict[str, int] = {}

    def bits(self, key: str) -> int:
        """The bits of the usual keys that a name is."""
        found = self._seen.get(key)
        if found is None:
            found = sum(self._bits.get((r, plain(key)), 0) for r in self.names)
            if len(self._seen) < 1 << 16:
                self._seen[key] = found
        return found

    def known(self, inner: dict) -> int:
        """The bits of the usual keys that an object has."""
        bits = 0
        for k in inner:
            bits |= self.bits(k)
        return bits


def record(body: str | None) -> dict | None:
    """The JSON object of a line, or None."""
    try:
        value = json.loads(body) if body else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def content(value: object) -> dict | None:
    """An object, also one that is written as a string."""
    if isinstance(value, str) and "{" in value:
        value = record(value.strip())
    return value if isinstance(value, dict) else None


def _parents(tops: DataFrame, parents: Parents) -> DataFrame:
    """``feed, file_no, parent, owner``: the name that each parent has in each file, from all objects of the file under each name.

    A name is a parent if it is called so, or if its objects together have :data:`ENOUGH` of the parent's
    usual keys and most of them at least one (in open content such keys are rare). A name that tells
    nothing in a file is what it is in most of the feed's others. A file has a parent under one name only.
    """
    if not parents.names:
        return tops.where("false").select("feed", "file_no", F.col("name").alias("parent"), F.lit("").alias("owner"))
    count = {r: F.bit_count(F.col("known").bitwiseAND(F.lit(parents.masks[r]))) for r in parents.names}
    exact = {r: F.regexp_replace(F.lower("name"), "[^a-z0-9]", "") == plain(r) for r in parents.names}
    told = {r: F.when((count[r] >= ENOUGH) & (F.col(f"with_{r}") * 2 >= F.col("filled")), count[r]).otherwise(0) for r in parents.names}
    scores = F.array(*(F.struct(told[r].alias("told"), exact[r].alias("exact"), F.lit(-i).alias("n"), F.lit(r).alias("role")) for i, r in enumerate(parents.names)))
    best = F.array_max(scores)
    own = F.when(best["told"] > 0, best["role"])
    for r in parents.names:
        own = F.coalesce(own, F.when(exact[r], F.lit(r)))
    found = tops.where("objects > 0").withColumn("own", own)
    in_feed = found.where("own is not null").groupBy("feed", "name", "own").agg(F.count("*").alias("n")).groupBy("feed", "name").agg(F.max_by("own", F.struct("n", "own")).alias("usual"))
    found = found.join(in_feed, ["feed", "name"], "left").withColumn("owner", F.coalesce("own", "usual")).where("owner is not null")
    is_exact = F.coalesce(*(F.when(F.col("owner") == r, exact[r]) for r in parents.names))
    keys = F.coalesce(*(F.when(F.col("owner") == r, count[r]) for r in parents.names))
    order = Window.partitionBy("feed", "file_no", "owner").orderBy(F.col("own").isNull(), F.desc(is_exact), F.desc(keys), F.desc("objects"), "name")
    return found.withColumn("place", F.row_number().over(order)).where("place = 1").select("feed", "file_no", F.col("name").alias("parent"), "owner")


def file_schemas(lines: DataFrame, parents: Parents) -> DataFrame:
    """``feed, file_no, owner, parent, name, role, types``: the fields of each file, from ``feed, file_no, body``.

    ``owner`` is the parent that a field is in ('' at the top), ``parent`` that one's name in the file,
    ``role`` the parent that the field is. Pre-aggregated where the lines are read: what is shuffled is
    one row for each field or key of an object, file and task.
    """
    sums = ["objects", "filled", *(f"with_{r}" for r in parents.names)]
    # Here a field at the top has the parent null, for '' may be a field's name.

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # By file, field and key of an object: a row of the types, the usual keys and the sums.
        files: dict[tuple, dict[str, tuple[list[int], dict[str, int]]]] = {}
        size, types_of, masks = 0, TYPES.get, [*parents.masks.values()]
        for batch in batches:
            for feed, file_no, body in zip(*(c.to_pylist() for c in batch.columns)):
                value = record(body)
                if not value:
                    continue
                fields = files.setdefault((feed, file_no), {})
                for name, v in value.items():
                    one = fields.get(name)
                    if one is None:
                        one = fields[name] = [0] * (2 + len(sums)), {}
                        size += 1
                    row, inside = one
                    row[0] |= types_of(type(v), 0)
                    inner = v if isinstance(v, dict) else content(v) if isinstance(v, str) else None
                    if inner is None:
                        continue
                    bits = parents.known(inner)
                    row[1] |= bits
                    row[2] += 1
                    row[3] += bool(inner)
                    for i, mask in enumerate(masks, 4):
                        row[i] += bool(bits & mask)
                    if inner is v:
                        for k, w in inner.items():
                            inside[k] = inside.get(k, 0) | types_of(type(w), 0)
            if size > 50_000:
                yield rows(files)
                files, size = {}, 0
        if files:
            yield rows(files)

    def rows(files: dict) -> pa.RecordBatch:
        none = [0] * (1 + len(sums))
        flat = [(*file, None, name, *row) for file, fields in files.items() for name, (row, _) in fields.items()]
        flat += [(*file, name, k, types, *none) for file, fields in files.items() for name, (_, inside) in fields.items() for k, types in inside.items()]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), *[pa.int64()] * len(sums)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat), kinds)], ["feed", "file_no", "parent", "name", "types", "known", *sums])

    found = lines.mapInArrow(run, "feed string, file_no long, parent string, name string, types int, known long, " + ", ".join(f"{c} long" for c in sums))
    found = cut(found.groupBy("feed", "file_no", "parent", "name").agg(F.bit_or("types").alias("types"), F.bit_or("known").alias("known"), *(F.sum(c).alias(c) for c in sums)))
    owners = cut(_parents(found.where("parent is null"), parents))
    columns = ["feed", "file_no", "owner", "parent", "name", "role", "types"]
    roles = owners.select("feed", "file_no", F.col("parent").alias("name"), F.col("owner").alias("role"))
    tops = found.where("parent is null").join(roles, ["feed", "file_no", "name"], "left").withColumns({"owner": F.lit(""), "parent": F.lit(""), "role": F.coalesce("role", F.lit(""))})
    inner = found.where("parent is not null").join(owners, ["feed", "file_no", "parent"]).withColumn("role", F.lit(""))
    return tops.select(*columns).unionByName(inner.select(*columns))


def file_pairs(lines: DataFrame) -> DataFrame:
    """``feed, file_no, was_no``: each file with the feed's next lower existing one."""
    files = lines.select("feed", "file_no").distinct()
    return files.withColumn("was_no", F.lag("file_no").over(Window.partitionBy("feed").orderBy("file_no"))).where("was_no is not null")


def compared(schemas: DataFrame, pairs: DataFrame) -> DataFrame:
    """The fields of both files of each pair, side by side: ``n_*`` of the file, ``o_*`` of the lower one, null where a side lacks it.

    Inner fields are left out where one of the files doesn't hold their parent as an object.
    """
    columns = ["parent", "role", "types"]
    new = pairs.join(schemas, ["feed", "file_no"]).select("feed", "file_no", "was_no", "owner", "name", *(F.col(c).alias(f"n_{c}") for c in columns))
    old = pairs.join(schemas.withColumnRenamed("file_no", "was_no"), ["feed", "was_no"]).select("feed", "file_no", "was_no", "owner", "name", *(F.col(c).alias(f"o_{c}") for c in columns))
    both = new.join(old, ["feed", "file_no", "was_no", "owner", "name"], "full_outer")
    held = Window.partitionBy("feed", "file_no", "owner")  # the fields of one file: as many as a schema has
    both = both.withColumns({"n_held": F.max("n_parent").over(held), "o_held": F.max("o_parent").over(held)})
    return both.where("owner = '' or (n_held is not null and o_held is not null)")


def _with_file(lines: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """Lines with the row of their file: broadcast if all files' rows are small, else joined with each file cut into parts, so that one may have most lines."""
    files = cut(files)
    others = [c for c in files.columns if c not in keys]
    size = files.agg(F.sum(F.length(F.to_json(F.struct(*others))) + F.length(keys[0]) + 16)).first()[0] or 0
    if size <= BROADCAST:
        return lines.join(F.broadcast(files), keys)
    files = files.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return lines.withColumn("part", F.pmod(F.xxhash64("body"), F.lit(PARTS)).cast("int")).join(files, [*keys, "part"]).drop("part")


def _evidence(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """How many of the records of both files agree on a gone and a new field: ``feed, file_no, owner, gone, new, agree, records``.

    ``wanted`` has ``feed, file_no, was_no, owner, parent, name, is_new``. Only the values of these fields are
    compared, by hash, and only within a record; a file may be as large as it likes. Lines aren't shuffled
    as long as what is wanted of all files is small; else each file is cut into parts.
    """
    asked = wanted.groupBy("feed", "file_no", "was_no", "owner", "parent", "is_new").agg(F.collect_set("name").alias("names"))
    asked = asked.select("feed", F.when(F.col("is_new"), F.col("file_no")).otherwise(F.col("was_no")).alias("at"), F.struct("file_no", "owner", "parent", "is_new", "names").alias("w"))
    asked = asked.groupBy("feed", "at").agg(F.collect_list("w").alias("wants"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for feed, body, wants in zip(*(c.to_pylist() for c in batch.columns)):
                value = record(body)
                if value is None or value.get("rec_id") is None:
                    continue
                rec = ordered(value["rec_id"])
                for w in wants:
                    at = value.get(w["parent"]) if w["owner"] else value
                    at = at if isinstance(at, dict) else {}
                    hashes = [digest([ordered(at[n])]) if n in at else "missing" for n in w["names"]]
                    out.append((feed, w["file_no"], w["owner"], w["is_new"], rec, w["names"], hashes))
            if out:
                kinds = [pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["feed", "file_no", "owner", "is_new", "rec", "names", "hashes"])

    rows = _with_file(lines.withColumnRenamed("file_no", "at"), asked, ["feed", "at"])
    values = rows.select("feed", "body", "wants").mapInArrow(run, "feed string, file_no long, owner string, is_new boolean, rec string, names array<string>, hashes array<string>")
    # One row for each record of both files; of repeated records that differ the greatest counts.
    pair = F.struct("hashes", "names")
    both = values.groupBy("feed", "file_no", "owner", "rec").agg(F.max(F.when(~F.col("is_new"), pair)).alias("was"), F.max(F.when(F.col("is_new"), pair)).alias("now")).where("was is not null and now is not null")
    each = both.select("feed", "file_no", "owner", "now", F.explode(F.arrays_zip("was.names", "was.hashes")).alias("o"))
    each = each.select("feed", "file_no", "owner", "o", F.explode(F.arrays_zip("now.names", "now.hashes")).alias("n"))
    agree = F.sum((F.col("o.hashes") == F.col("n.hashes")).cast("long")).alias("agree")
    return each.groupBy("feed", "file_no", "owner", F.col("o.names").alias("gone"), F.col("n.names").alias("new")).agg(agree, F.count("*").alias("records"))


def renames(lines: DataFrame, both: DataFrame) -> DataFrame:
    """``feed, file_no, owner, gone, new``: the fields that go under a new name.

    Similarity flooding scores all correspondences of two files' schema graphs, by names, types,
    nesting and the share of records that agree. The best consistent ones are proposed; those that
    any record contradicts are withdrawn, and the next best take their place.
    """
    ids = ["feed", "file_no", "was_no", "owner"]
    lost, won = both.where("n_types is null"), both.where("o_types is null")
    sides = lost.select(*ids).distinct().join(won.select(*ids).distinct(), ids)  # both a gone and a new field
    wanted = lost.select(*ids, F.col("o_parent").alias("parent"), "name", F.lit(False).alias("is_new")).unionByName(won.select(*ids, F.col("n_parent").alias("parent"), "name", F.lit(True).alias("is_new"))).join(sides, ids)
    shares = _evidence(lines, wanted).groupBy("feed", "file_no").agg(F.collect_list(F.struct("owner", "gone", "new", "agree", "records")).alias("shares"))
    field = lambda side: F.struct("owner", "name", F.col(f"{side}_types").alias("types"), F.col(f"{side}_role").alias("role"))
    fields = both.groupBy("feed", "file_no").agg(
        F.collect_list(F.when(F.col("o_types").isNotNull(), field("o"))).alias("olds"),
        F.collect_list(F.when(F.col("n_types").isNotNull(), field("n"))).alias("news"),
    )
    # A file without a gone and a new field of one parent has nothing that could be renamed.
    fields = fields.join(sides.select("feed", "file_no").distinct(), ["feed", "file_no"], "left_semi")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for r in batch.itertuples(index=False):
                olds, news = ({(f["owner"], f["name"]): (f["owner"], f["name"], f["types"]) for f in side} for side in (r.olds, r.news))
                roles_old, roles_new = ({(f["owner"], f["role"]): (f["owner"], f["name"]) for f in side if f["role"]} for side in (r.olds, r.news))
                agreeing = {((s["owner"], s["gone"]), (s["owner"], s["new"])): s["agree"] / s["records"] for s in ([] if r.shares is None else r.shares)}
                # The parents are known by what is in them, whatever else changes there.
                agreeing |= {(old, roles_new[at]): 1.0 for at, old in roles_old.items() if roles_new.get(at, old) != old}
                pairs = {(olds[o], news[n]): share for (o, n), share in agreeing.items() if o in olds and n in news and o not in news and n not in olds}
                for a, b in selected(flood(olds.values(), news.values(), pairs), lambda p, pairs=pairs: pairs.get(p) == 1.0):
                    out.append((r.feed, r.file_no, a[0], a[1], b[1]))
            yield pd.DataFrame(out, columns=["feed", "file_no", "owner", "gone", "new"])

    return fields.join(shares, ["feed", "file_no"], "left").select("feed", "file_no", "olds", "news", "shares").mapInPandas(run, "feed string, file_no long, owner string, gone string, new string")


def _lines(df: DataFrame, feed: str, file_no: str, body: str) -> DataFrame:
    rows = df.select(F.col(feed).cast("string").alias("feed"), F.col(file_no).cast("long").alias("file_no"), F.col(body).cast("string").alias("body"))
    return rows.where("feed is not null and file_no is not null")


def schema_changes(df: DataFrame, feed: str = "feed", file_no: str = "file_no", body: str = "body", parents: Parents | None = None) -> DataFrame:
    """``feed, file_no, change_kind, field_path, was_path``: each file against the feed's next lower existing one.

    Method: similarity flooding between the schema graphs of the two files, with correspondences
    verified on the records of both; fields without one are removed or added. ``parents`` names the
    objects whose inner keys are fields too; without it only top-level keys are.
    Lines that are no JSON object, null feeds and file numbers: ignored. Repeated lines: count once.
    A feed of one file and an empty table: no rows. Fields that are always null have no type.
    """
    lines, parents = _lines(df, feed, file_no, body), parents or Parents()
    both = cut(compared(cut(file_schemas(lines, parents)), file_pairs(lines)))
    named = cut(renames(lines, both))
    path = lambda side, name: F.when(F.col("owner") == "", F.col(name)).otherwise(F.concat(F.col(f"{side}_held"), F.lit("."), F.col(name)))
    keys = ["feed", "file_no", "owner"]
    new, old = path("n", "name"), path("o", "name")
    retyped = both.where((F.col("n_types") > 0) & (F.col("o_types") > 0) & (F.col("n_types") != F.col("o_types")) & ~F.col("name").isin(parents.open))
    added = both.where("o_types is null").join(named.select(*keys, F.col("new").alias("name"), "gone"), [*keys, "name"], "left")
    removed = both.where("n_types is null").join(named.select(*keys, F.col("gone").alias("name")), [*keys, "name"], "left_anti")
    row = lambda df, kind, now, was: df.select("feed", "file_no", kind.alias("change_kind"), now.alias("field_path"), was.alias("was_path"))
    return (
        row(retyped, F.lit("retyped"), new, old)
        .unionByName(row(added, F.when(F.col("gone").isNull(), "added").otherwise("renamed"), new, F.coalesce(path("o", "gone"), F.lit(""))))
        .unionByName(row(removed, F.lit("removed"), old, old))
    )


def lineage(lines: DataFrame, parents: Parents) -> DataFrame:
    """``feed, file_no, names, parents``: for each file a map from a field's path there to the bit of the first
    type and the path that it had when it first came, as ``bit:path``, and one from the parents' names to the parents.

    A field is followed back from rename to rename. Renames point to the rename before them; pointers
    are doubled until all have reached a first name, so the rounds grow with the logarithm of the chain.
    """
    schemas = cut(file_schemas(lines, parents))
    pairs = file_pairs(lines)
    moves = cut(renames(lines, cut(compared(schemas, pairs))).join(pairs, ["feed", "file_no"]))
    keys = ["feed", "owner", "name"]
    so_far = Window.partitionBy(*keys).orderBy("file_no")
    moved = moves.select("feed", "owner", F.col("new").alias("name"), "file_no", F.col("file_no").alias("moved_at"))
    at = cut(schemas.join(moved, [*keys, "file_no"], "left").withColumn("moved_at", F.last("moved_at", ignorenulls=True).over(so_far)))
    # Of each rename: the name before, and the rename that gave that name, if any.
    before = at.select("feed", "owner", F.col("name").alias("gone"), F.col("file_no").alias("was_no"), F.col("moved_at").alias("pred"))
    chain = cut(moves.join(before, ["feed", "owner", "gone", "was_no"], "left").select("feed", "owner", F.col("new").alias("name"), F.col("file_no").alias("moved_at"), F.col("gone").alias("first"), "pred"))
    while not chain.where("pred is not null").isEmpty():
        further = chain.select("feed", "owner", F.col("name").alias("first"), F.col("moved_at").alias("pred"), F.col("first").alias("f"), F.col("pred").alias("p"))
        chain = cut(chain.join(further, ["feed", "owner", "first", "pred"], "left").select("feed", "owner", "name", "moved_at", F.coalesce("f", "first").alias("first"), F.col("p").alias("pred")))
    rooted = at.join(chain.select(*keys, "moved_at", "first"), [*keys, "moved_at"], "left")
    inner = F.concat(F.col("owner"), F.lit("."), F.coalesce("first", "name"))
    path = F.when(F.col("role") != "", F.col("role")).when(F.col("owner") != "", inner).otherwise(F.coalesce("first", "name"))
    rooted = rooted.withColumn("path", path)
    kinds = rooted.where("types > 0").groupBy("feed", "path").agg(F.min_by("types", "file_no").alias("kind"))
    here = F.when(F.col("owner") == "", F.col("name")).otherwise(F.concat("owner", F.lit("."), "name"))
    entry = F.struct(here.alias("k"), F.concat(F.coalesce("kind", F.lit(0)).cast("string"), F.lit(":"), F.col("path")).alias("v"))
    listed = rooted.join(kinds, ["feed", "path"], "left").groupBy("feed", "file_no").agg(F.collect_list(entry).alias("e"), F.collect_list(F.when(F.col("role") != "", F.struct("name", "role"))).alias("p"))
    return listed.select("feed", "file_no", F.map_from_entries("e").alias("names"), F.map_from_entries("p").alias("parents"))


def cast_value(value: object, kind: int) -> str | None:
    """A value as text, in the JSON type with the given bit if there is a plain way there.

    A list of one and an object with the only key ``value`` are taken out of it, an object in a
    string is read, numbers and booleans are read from strings.
    """
    if value is None:
        return None
    if isinstance(value, list) and len(value) == 1 and not kind & 8:
        value = value[0]
    if isinstance(value, dict) and [*value] == ["value"] and not kind & 16:
        value = value["value"]
    if isinstance(value, str) and kind & (2 | 4 | 8 | 16) and not kind & 1:
        try:
            read = json.loads(value)
        except (ValueError, RecursionError):
            read = value
        if TYPES.get(type(read), 0) & kind:
            value = read
    return value if isinstance(value, str) else None if value is None else ordered(value)


def consistent_table(df: DataFrame, feed: str = "feed", file_no: str = "file_no", body: str = "body", parents: Parents | None = None, kinds: dict[str, str] | None = None, otherwise: str = "record") -> DataFrame:
    """``kind, feed, file_no, rec_id, fields``: the records of all files with every field under the name
    and in the type it first had in its feed; inner fields of the parents as ``parent.name``.

    ``kinds`` gives the kind of a record that has a parent; records without one are ``otherwise``.

    Lines that are no JSON object are left out and repeated records kept once.
    """
    lines, parents, kinds = _lines(df, feed, file_no, body), parents or Parents(), kinds or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for name, no, body_, names, owners in zip(*(c.to_pylist() for c in batch.columns)):
                value = record(body_)
                if value is None:
                    continue
                names, owners, fields, kind = dict(names), dict(owners), {}, otherwise
                for top, v in value.items():
                    is_parent = owners.get(top, "") if content(v) is not None else ""
                    kind = kinds.get(is_parent, kind)
                    inner = {f"{is_parent}.{k}": w for k, w in content(v).items()} if is_parent else {top: v}
                    for k, w in inner.items():
                        bit, _, first = names.get(k, f"{TYPES.get(type(w), 0)}:{k}").partition(":")
                        fields[first] = cast_value(w, int(bit))
                rec = value.get("rec_id")
                out.append((kind, name, no, rec if rec is None or isinstance(rec, str) else ordered(rec), sorted(fields.items())))
            if out:
                arrow = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow)], ["kind", "feed", "file_no", "rec_id", "fields"])

    joined = _with_file(lines, lineage(lines, parents), ["feed", "file_no"]).select("feed", "file_no", "body", "names", "parents")
    rows = joined.mapInArrow(run, "kind string, feed string, file_no long, rec_id string, fields map<string,string>")
    once = ["kind", "feed", "file_no", "rec_id"]
    same = F.md5(F.to_json(F.array_sort(F.map_entries("fields"))).cast("binary")).alias("__sum")
    return rows.groupBy(*once, same).agg(F.first("fields").alias("fields")).select(*once, "fields")
