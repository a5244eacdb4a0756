"""Schemas that drift between the shards of a unit, by similarity flooding.

Every complete shard has a schema graph: fields with their names, value types and inner names. The
graphs of a shard and its predecessor are matched by similarity flooding: name similarities spread
over the pairs of fields, types and inner names until they settle. A vanished and a new field
correspond if their settled score reaches a share of the best score that either has among the
vanished and new fields. Only correspondences are compared by value; they are renames if the values
agree on every record of both shards, the best scores that fit together if several do.

Every record is opened once, into one row of its field names, types and value marks; no text is
shuffled, and values meet only between the two shards of a pair that has a correspondence.

Defined cases: repeated records count once; of several records of an id in one shard the last one
(by record number) is compared; records without an id count for the fields only; null or malformed
properties have no fields; a field that is always null has no type and is never retyped; a shard
without records has no fields; the first shard of a unit has no changes; only ``complete`` shards
count. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions import wirejson
from weftgraph.operators.flatten import versioned_records
from weftgraph.plans.durable import durable
from weftgraph.plans.spread import spread

FIELDS = "shard_id string, record_no long, id string, field string, type string, value string"
OPENED = "shard_id string, record_no long, id string, fields array<string>, types array<string>, inner array<array<string>>, marks array<string>"
#: Rounds of flooding and the change of the scores at which it has settled.
ROUNDS, SETTLED = 60, 1e-4
#: Share of the best score of either field from which two fields correspond.
RELATIVE = 0.2
#: Candidates up to which they are broadcast to the records.
BROADCAST_PAIRS = 20_000
#: Canonical names up to which the mapping is broadcast.
BROADCAST_NAMES = 50_000


def _plain(v) -> str | None:
    return None if v is None else json.dumps(wirejson.canonical(v), sort_keys=True) if isinstance(v, (list, dict)) else wirejson.scalar_text(v)


def _open(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for shard, no, i, text, version in zip(b["shard_id"], b["record_no"], b["id"], b["properties"], b["format_version"]):
            for k, v in (wirejson.decode(text, None if pd.isna(version) else int(version)) or {}).items():
                out.append((shard, no, i, k, wirejson.type_name(v), _plain(v)))
        yield pd.DataFrame(out, columns=["shard_id", "record_no", "id", "field", "type", "value"])


def _form(v) -> str:
    """A text that is equal exactly for values of equal type and content."""
    kind = type(v)
    if kind is str:
        return repr(v)
    if kind is dict:
        return "{" + ",".join([f"{k!r}:{_form(v[k])}" for k in sorted(v)]) + "}"
    if kind is list:
        return "[" + ",".join([_form(x) for x in v]) + "]"
    return f"{kind.__name__}{v!r}"


def _mark(v) -> str | None:
    """The form of a value, digested if it is long."""
    if v is None:
        return None
    form = _form(v)
    return form if len(form) <= 40 else hashlib.md5(form.encode()).hexdigest()


def _inner(v) -> list[str]:
    if isinstance(v, dict):
        return list(v)
    return sorted({n for x in v if isinstance(x, dict) for n in x}) if isinstance(v, list) else []


def _open_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = pa.list_(pa.string())
    for b in batches:
        fields, types, inner, marks = [], [], [], []
        for text, version in zip(b.column(3).to_pylist(), b.column(4).to_pylist()):
            props = wirejson.decode(text, version) or {}
            kinds = [wirejson.type_name(v) for v in props.values()]
            fields.append(list(props))
            types.append(kinds)
            inner.append([_inner(v) for v in props.values()])
            marks.append([_mark(v) for v in props.values()])
        columns = [pa.array(fields, names), pa.array(types, names), pa.array(inner, pa.list_(names)), pa.array(marks, names)]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], *columns], names=["shard_id", "record_no", "id", "fields", "types", "inner", "marks"])


def shard_order(shards: DataFrame) -> DataFrame:
    """(shard_id, unit, shard_seq, format_version, before): complete shards with the complete one before."""
    done = shards.filter((F.col("status") == "complete") & F.col("shard_id").isNotNull()).select("shard_id", "unit", "shard_seq", "format_version").dropDuplicates(["shard_id"])
    w = Window.partitionBy("unit").orderBy("shard_seq", "shard_id")
    return done.withColumn("before", F.lag("shard_id").over(w))


def record_fields(wire: DataFrame, shards: DataFrame) -> DataFrame:
    """One row per complete shard, record and top-level field, nulls included."""
    kept = versioned_records(wire, shards).join(shard_order(shards).select("shard_id"), "shard_id", "left_semi")
    return kept.select("shard_id", "record_no", "id", "properties", "format_version").mapInPandas(_open, FIELDS)


def opened_records(wire: DataFrame, shards: DataFrame) -> DataFrame:
    """One row per record of a complete shard: its top-level fields, their types, inner names and value marks. Repeated records stay."""
    order = shard_order(shards).select("shard_id", "format_version")
    rows = wire.select("shard_id", "record_no", "id", "properties").join(order, "shard_id")
    return spread(rows.select("shard_id", "record_no", "id", "properties", "format_version"), "record_no").mapInArrow(_open_rows, OPENED)


def name_parts(name: str) -> list[str]:
    return re.findall(r"[a-z]+|[0-9]+", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", name).lower())


def name_similarity(a: str, b: str) -> float:
    """Dice similarity of letter pairs, at least that of the whole name parts."""
    pa, pb = set(name_parts(a)), set(name_parts(b))
    words = 2 * len(pa & pb) / max(1, len(pa) + len(pb))
    ga, gb = ({s[i : i + 2] for s in ["".join(name_parts(x))] for i in range(max(1, len(s) - 1))} for x in (a, b))
    return max(words, 2 * len(ga & gb) / max(1, len(ga) + len(gb)))


def flood(old: list[tuple[str, list[str], list[str]]], new: list[tuple[str, list[str], list[str]]]) -> np.ndarray:
    """Scores (old x new, at most 1) of fields (name, types, inner names) after flooding."""

    def side(fields, at):
        values = sorted({v for f in fields for v in f[at]})
        return values, np.array([[v in f[at] for v in values] for f in fields], float).reshape(len(fields), len(values))

    start = np.array([[name_similarity(a[0], b[0]) for b in new] for a in old]).reshape(len(old), len(new)) + 0.01
    layers = []
    for at in (1, 2):
        (va, ma), (vb, mb) = side(old, at), side(new, at)
        if va and vb:
            same = np.array([[1.0 if x == y else 0.3 * name_similarity(x, y) for y in vb] for x in va])
            # a pair passes its score on in equal parts to the pairs it is linked with
            fan_in = np.maximum(1, np.outer(ma.sum(0), mb.sum(0)))
            fan_out = np.maximum(1, np.outer(ma.sum(1), mb.sum(1)))
            layers.append([same, same.copy(), ma, mb, fan_in, fan_out])
    score = start.copy()
    for _ in range(ROUNDS):
        up, tops = start + score, []
        for first, now, ma, mb, fan_in, fan_out in layers:
            up = up + ma @ ((first + now) / fan_in) @ mb.T
            tops.append(first + now + ma.T @ ((start + score) / fan_out) @ mb)
        up /= up.max()
        for layer, top in zip(layers, tops):
            layer[1] = top / top.max()
        moved, score = np.abs(up - score).max(), up
        if moved < SETTLED:
            break
    return score


def _match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for shard, before, old, new in zip(b["shard_id"], b["before"], b["old_fields"], b["new_fields"]):
            o, n = ({f["field"]: (f["field"], sorted(f["types"]), sorted(f["inner"])) for f in (x if x is not None else [])} for x in (old, new))
            for name in sorted(set(o) & set(n)):
                if o[name][1] and n[name][1] and o[name][1] != n[name][1]:
                    out.append((shard, before, name, name, "retyped", 1.0))
            gone, came = [o[x] for x in sorted(set(o) - set(n))], [n[x] for x in sorted(set(n) - set(o))]
            out += [(shard, before, x[0], "", "removed", 0.0) for x in gone] + [(shard, before, "", x[0], "added", 0.0) for x in came]
            if gone and came:
                score = flood(list(o.values()), list(n.values()))
                at_old, at_new = {x: i for i, x in enumerate(o)}, {x: i for i, x in enumerate(n)}
                among = score[np.ix_([at_old[x[0]] for x in gone], [at_new[y[0]] for y in came])]
                best = np.maximum(among.max(1)[:, None], among.max(0)[None, :])
                for i, k in zip(*np.nonzero(among >= RELATIVE * best)):
                    out.append((shard, before, gone[i][0], came[k][0], "candidate", float(among[i, k])))
        yield pd.DataFrame(out, columns=["shard_id", "before", "old_field", "new_field", "change", "score"])


def _settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The changes of a shard: of the correspondences that the values bear out the best ones that fit together, and what is left."""
    for b in batches:
        out = []
        for shard, changes, pairs in zip(b["shard_id"], b["changes"], b["pairs"]):
            left, right = set(), set()
            for p in sorted(pairs if pairs is not None else [], key=lambda p: (-p["score"], p["old_field"], p["new_field"])):
                if p["old_field"] not in left and p["new_field"] not in right:
                    left.add(p["old_field"])
                    right.add(p["new_field"])
                    out.append((shard, p["old_field"], p["new_field"], "renamed"))
            for c in changes:
                if not (c["change"] == "removed" and c["old_field"] in left or c["change"] == "added" and c["new_field"] in right):
                    out.append((shard, c["old_field"], c["new_field"], c["change"]))
        yield pd.DataFrame(out, columns=["shard_id", "old_field", "new_field", "change"])


def matches(opened: DataFrame, shards: DataFrame) -> DataFrame:
    """(shard_id, before, old_field, new_field, change, score): what the schema graphs of every pair of shards say.

    ``change`` is removed, added, retyped, or candidate for two fields that correspond.
    """
    pairs = shard_order(shards).filter(F.col("before").isNotNull()).select("shard_id", "before")
    each = opened.select("shard_id", F.explode(F.arrays_zip("fields", "types", "inner")).alias("f")).select("shard_id", F.col("f.fields").alias("field"), F.col("f.types").alias("type"), F.col("f.inner").alias("inner"))
    per = each.groupBy("shard_id", "field").agg(F.collect_set("type").alias("types"), F.array_distinct(F.flatten(F.collect_set("inner"))).alias("inner"))
    schemas = per.groupBy("shard_id").agg(F.collect_list(F.struct("field", "types", "inner")).alias("fields"))
    both = pairs.join(schemas.select("shard_id", F.col("fields").alias("new_fields")), "shard_id", "left").join(
        schemas.select(F.col("shard_id").alias("before"), F.col("fields").alias("old_fields")), "before", "left"
    )
    found = spread(both.select("shard_id", "before", "old_fields", "new_fields"), "shard_id").mapInPandas(_match, "shard_id string, before string, old_field string, new_field string, change string, score double")
    return found


def _value(fields: Column, marks: Column, field: Column) -> Column:
    at = F.array_position(fields, field)
    return F.when(at > 0, F.get(marks, (at - 1).cast("int")))


def borne_out(opened: DataFrame, matched: DataFrame) -> DataFrame:
    """(shard_id, old_field, new_field, score): candidates whose values agree on every id of both shards and are not all null."""
    grouped = matched.filter("change = 'candidate'").groupBy("shard_id", "before").agg(F.collect_list(F.struct("old_field", "new_field", "score")).alias("pairs"))
    grouped = durable(grouped, "candidates")
    near = F.broadcast if grouped.count() <= BROADCAST_PAIRS else (lambda df: df)
    wanted = grouped.select("shard_id").unionByName(grouped.select(F.col("before").alias("shard_id"))).distinct()
    known = opened.filter(F.col("id").isNotNull()).join(near(wanted), "shard_id", "left_semi")
    last = known.groupBy("shard_id", "id").agg(F.max(F.struct("record_no", "fields", "marks")).alias("x")).select("shard_id", "id", "x.fields", "x.marks")
    new = last.join(near(grouped), "shard_id").select("shard_id", "before", "id", "pairs", F.col("fields").alias("new_fields"), F.col("marks").alias("new_marks"))
    old = last.select(F.col("shard_id").alias("before"), "id", "fields", "marks")
    valued = new.join(old, ["before", "id"]).select(
        "shard_id",
        F.explode(F.transform("pairs", lambda p: F.struct(p["old_field"].alias("old_field"), p["new_field"].alias("new_field"), p["score"].alias("score"), _value(F.col("fields"), F.col("marks"), p["old_field"]).alias("a"), _value(F.col("new_fields"), F.col("new_marks"), p["new_field"]).alias("b")))).alias("p"),
    ).select("shard_id", "p.*")
    judged = valued.groupBy("shard_id", "old_field", "new_field", "score").agg(F.bool_and(F.col("a").eqNullSafe(F.col("b"))).alias("equal"), F.bool_or(F.col("a").isNotNull()).alias("known"))
    return judged.filter("equal and known").select("shard_id", "old_field", "new_field", "score")


def schema_changes(wire: DataFrame, shards: DataFrame) -> DataFrame:
    """(shard_id, old_field, new_field, change): added, removed, renamed and retyped fields per shard."""
    opened = durable(opened_records(wire, shards), "opened")
    matched = durable(matches(opened, shards), "matched")
    pairs = borne_out(opened, matched).groupBy("shard_id").agg(F.collect_list(F.struct("old_field", "new_field", "score")).alias("pairs"))
    changes = matched.filter("change <> 'candidate'").groupBy("shard_id").agg(F.collect_list(F.struct("old_field", "new_field", "change")).alias("changes"))
    return changes.join(pairs, "shard_id", "left").select("shard_id", "changes", "pairs").mapInPandas(_settle, "shard_id string, old_field string, new_field string, change string")


def correspondences(wire: DataFrame, shards: DataFrame) -> DataFrame:
    """(shard_id, old_field, new_field, score, borne_out): the pairs of fields that the flooding finds, and whether the values agree."""
    opened = durable(opened_records(wire, shards), "opened")
    matched = durable(matches(opened, shards), "matched")
    found = borne_out(opened, matched).select("shard_id", "old_field", "new_field", F.lit(True).alias("borne_out"))
    pairs = matched.filter("change = 'candidate'").select("shard_id", "old_field", "new_field", F.round("score", 6).alias("score"))
    return pairs.join(found, ["shard_id", "old_field", "new_field"], "left").withColumn("borne_out", F.coalesce("borne_out", F.lit(False)))


def _common_names(renames: list[tuple[str, str, int]], uses: dict[str, int]) -> dict[str, str]:
    """The most used name of each set of names linked by renames."""
    of = {n: n for n in uses}

    def find(n: str) -> str:
        while of[n] != n:
            of[n] = of[of[n]]
            n = of[n]
        return n

    for a, b, _ in renames:
        of.setdefault(a, a)
        of.setdefault(b, b)
        of[find(a)] = find(b)
    sets: dict[str, list[str]] = {}
    for n in of:
        sets.setdefault(find(n), []).append(n)
    return {n: min(s, key=lambda x: (-uses.get(x, 0), x)) for s in sets.values() for n in s}


def consistent_table(wire: DataFrame, shards: DataFrame) -> DataFrame:
    """(record_no, shard_id, id, field, type, value): all records of complete shards under one name and type per field.

    Fields linked by renames take the most used of their names. A field of integers and reals is
    real, one of several other types is text; lists and objects keep their canonical JSON. The
    names go to the driver: they are the schema's size.
    """
    fields = durable(record_fields(wire, shards), "fields")
    changes = schema_changes(wire, shards)
    renames = [tuple(r) for r in changes.filter("change = 'renamed'").groupBy("old_field", "new_field").count().collect()]
    uses = {r[0]: r[1] for r in fields.groupBy("field").count().collect()}
    names = fields.sparkSession.createDataFrame(list(_common_names(renames, uses).items()) or [("", "")], "field string, name string")
    if len(uses) <= BROADCAST_NAMES:
        names = F.broadcast(names)
    named = fields.filter(F.col("type").isNotNull()).join(names, "field").select("record_no", "shard_id", "id", F.col("name").alias("field"), "type", "value")
    kinds = named.groupBy("field").agg(F.collect_set("type").alias("kinds"))
    kind = F.when(F.size("kinds") == 1, F.element_at("kinds", 1)).when(F.size(F.array_except("kinds", F.array(F.lit("integer"), F.lit("real")))) == 0, "real").otherwise("text")
    kinds = kinds.select("field", kind.alias("to"))
    if len(uses) <= BROADCAST_NAMES:
        kinds = F.broadcast(kinds)
    value = F.when(F.col("to") == "real", F.col("value").cast("double").cast("string")).otherwise(F.col("value"))
    return named.join(kinds, "field").select("record_no", "shard_id", "id", "field", F.col("to").alias("type"), value.alias("value"))
