"""Run, plan and source state as a log of patches: nothing is overwritten, states are folded when they are read.

A patch has a key, a time, an id, and some of: ``sets`` (a field's new value; null takes the field away), ``adds`` (amounts added
to counters), ``phases`` (fields of nested phases, merged into what the phase has), and ``base``, the version that its writer had
read. A patch without a base always counts. Of patches with the same base only the first (by time, then id) counts, and only where all
versions up to that base exist: the others are lost updates, which ``conflicts`` lists, for their writers to read again.

Folding takes the latest value of each field by (time, id) and sums the counters: aggregations that begin in the tasks, without a list of a
key's patches anywhere, so a key may have any number of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PATCH = "key string, at timestamp, patch_id bigint, base bigint, sets map<string,string>, adds map<string,bigint>, phases map<string,map<string,string>>"
COUNTER, PHASE = "+", "/"


def append(patches: DataFrame, path: str) -> None:
    """Add patches to the log; many writers may do so at once."""
    patches.select(*[c.split()[0] for c in PATCH.split(", ")]).write.mode("append").parquet(f"{path}/patches")


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PATCH).parquet(f"{path}/patches")


def judged(patches: DataFrame) -> DataFrame:
    """The patches with ``counts`` and, for those with a base that count, the ``version`` that they made."""
    guarded = patches.filter("base IS NOT NULL").select("key", "base", F.struct("at", "patch_id").alias("turn"))
    # A row for each version of a key: the first patch with each base, without a gap from 0.
    firsts = guarded.groupBy("key", "base").agg(F.min("turn").alias("turn"))
    held = firsts.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy("base"))).filter("base = _n - 1").select("key", "base", F.col("turn").alias("_turn"))
    joined = patches.join(held, ["key", "base"], "left")
    counts = F.col("base").isNull() | F.coalesce(F.col("_turn") == F.struct("at", "patch_id"), F.lit(False))
    return joined.withColumns({"counts": counts, "version": F.when(counts, F.col("base") + 1)}).drop("_turn")


def conflicts(patches: DataFrame) -> DataFrame:
    """key, patch_id, base of the patches that don't count, and the version that the key has now."""
    all_of = judged(patches)
    now = all_of.groupBy("key").agg(F.coalesce(F.max("version"), F.lit(0)).alias("version"))
    return all_of.filter("NOT counts").select("key", "patch_id", "base").join(now, "key")


def _entries() -> Column:
    """Each field of a patch as (field, value, added); counters and phases have marks before their names."""
    empty = F.array().cast("array<struct<field:string,value:string,added:bigint>>")
    row = lambda field, value, added: F.struct(field.alias("field"), value.cast("string").alias("value"), added.cast("bigint").alias("added"))
    none = F.lit(None)
    sets = F.transform(F.map_entries("sets"), lambda e: row(e.key, e.value, none))
    adds = F.transform(F.map_entries("adds"), lambda e: row(F.concat(F.lit(COUNTER), e.key), none, e.value))
    phases = F.flatten(F.transform(F.map_entries("phases"), lambda p: F.transform(F.map_entries(p.value), lambda e: row(F.concat(p.key, F.lit(PHASE), e.key), e.value, none))))
    return F.concat(*[F.coalesce(part, empty) for part in (sets, adds, phases)])


def folded_fields(patches: DataFrame) -> DataFrame:
    """key, field, value: the latest value of each field (fields taken away are gone), counters summed up; phases as phase/field, counters as +name."""
    rows = judged(patches).filter("counts").select("key", F.struct("at", "patch_id").alias("turn"), F.explode(_entries()).alias("e")).select("key", "turn", "e.*")
    last = rows.groupBy("key", "field").agg(F.max_by(F.struct("value"), "turn").alias("last"), F.sum("added").alias("added"))
    return last.select("key", "field", F.when(F.col("field").startswith(COUNTER), F.col("added").cast("string")).otherwise(F.col("last.value")).alias("value")).filter("value IS NOT NULL")


def states(patches: DataFrame) -> DataFrame:
    """key, version, updated_at, fields, counters, phases: the state of each key. A key's fields are few."""
    head = judged(patches).filter("counts").groupBy("key").agg(F.coalesce(F.max("version"), F.lit(0)).alias("version"), F.max("at").alias("updated_at"))
    fields = folded_fields(patches).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("field", "value"))).alias("all"))
    joined = head.join(fields, "key", "left").withColumn("all", F.coalesce("all", F.array().cast("array<struct<field:string,value:string>>")))
    counter, phase = lambda e: e.field.startswith(COUNTER), lambda e: e.field.contains(PHASE)
    plain = F.map_from_entries(F.filter("all", lambda e: ~counter(e) & ~phase(e)))
    counters = F.map_from_entries(F.transform(F.filter("all", counter), lambda e: F.struct(F.substring(e.field, 2, 10_000), e.value.cast("bigint"))))
    nested = F.filter("all", phase)
    of = lambda e: F.substring_index(e.field, PHASE, 1)
    names = F.array_distinct(F.transform(nested, of))
    phases = F.map_from_entries(F.transform(names, lambda p: F.struct(p, F.map_from_entries(F.transform(F.filter(nested, lambda e: of(e) == p), lambda e: F.struct(F.substring(e.field, F.length(p) + 2, F.lit(10_000)), e.value))))))
    return joined.select("key", "version", "updated_at", plain.alias("fields"), counters.alias("counters"), phases.alias("phases"))


def compacted(patches: DataFrame) -> DataFrame:
    """Patches that fold to the same states, one for each key and at most as many as its versions: what a log can be replaced by."""
    now = states(patches)
    whole = now.select("key", F.col("updated_at").alias("at"), F.lit(-1).cast("bigint").alias("patch_id"), F.lit(None).cast("bigint").alias("base"), F.col("fields").alias("sets"), F.col("counters").alias("adds"), "phases")
    versions = judged(patches).filter("counts AND base IS NOT NULL").select("key", "at", "patch_id", "base", *[F.lit(None).cast(t).alias(n) for n, t in (("sets", "map<string,string>"), ("adds", "map<string,bigint>"), ("phases", "map<string,map<string,string>>"))])
    return whole.unionByName(versions)


# The writes of the run header, its sources, plan and progress, as patches.


def _patch(keys: DataFrame, at: Column, patch_id: Column, base: Column | None = None, sets: dict[str, Column] | None = None, adds: dict[str, Column] | None = None, phases: Column | None = None) -> DataFrame:
    mapped = lambda values, kind: F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast(kind))]) if values else F.lit(None)
    return keys.select(
        "key", at.cast("timestamp").alias("at"), patch_id.cast("bigint").alias("patch_id"), (F.lit(None) if base is None else base).cast("bigint").alias("base"), mapped(sets, "string").cast("map<string,string>").alias("sets"),
        mapped(adds, "bigint").cast("map<string,bigint>").alias("adds"), (F.lit(None) if phases is None else phases).cast("map<string,map<string,string>>").alias("phases"),
    )


def create_run(keys: DataFrame, at: Column, patch_id: Column, label: Column, source: Column) -> DataFrame:
    return _patch(keys, at, patch_id, F.lit(0), {"status": F.lit("DRAFT"), "label": label, "source": source, "total_records": F.lit(0)})


def set_total(keys: DataFrame, at: Column, patch_id: Column, total: Column, base: Column | None = None) -> DataFrame:
    return _patch(keys, at, patch_id, base, {"total_records": total, "status": F.lit("RUNNING")})


def add_progress(keys: DataFrame, at: Column, patch_id: Column, done: Column) -> DataFrame:
    return _patch(keys, at, patch_id, None, None, {"processed": done})


def complete(keys: DataFrame, at: Column, patch_id: Column, base: Column | None = None) -> DataFrame:
    return _patch(keys, at, patch_id, base, {"status": F.lit("COMPLETED")})


def save_source(files: DataFrame, at: Column, patch_id: Column) -> DataFrame:
    """A patch for each described file (``source`` is the key's last part); to save again replaces the fields."""
    keyed = files.withColumn("key", F.concat(F.lit("source:"), "source"))
    return _patch(keyed, at, patch_id, None, {"filename": F.col("source"), "source_type": F.col("source_type"), "role": F.col("role"), "rows": F.col("n_rows"), "mapping": F.to_json("places"), "content_hash": F.col("content_key")})


def delete(keys: DataFrame, at: Column, patch_id: Column) -> DataFrame:
    """Marks a key as gone; ``present`` leaves it out."""
    return _patch(keys, at, patch_id, None, {"deleted": F.lit("true")})


def present(folded: DataFrame) -> DataFrame:
    return folded.filter(F.try_element_at("fields", F.lit("deleted")).isNull())
