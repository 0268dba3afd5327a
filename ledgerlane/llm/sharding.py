"""Sharding by balanced label propagation: linked documents move towards their neighbours' shards under quotas.

Documents with equal texts are linked, and a group's documents start dealt over the shards by a hash. A group too large
for any shard first gets whole shards (there are fewer such groups than shards), and what is left of it goes to one
shard where one has the room: split, it would cut more than small groups do. In each round every other open group asks for the shard where most of its documents are, of those that still have room for all of it; groups move there as
a whole, in a fixed order, as long as the room lasts. Rounds go on until no open group has a shard with room for it;
only whole moves are made, so that each lowers the cut. Groups that fit nowhere, and then documents without a link, which have no edge to cut, fill up
the shards one after the other, so that counts are at most one apart (the law ``rows``) and fewer of these groups
than there are shards are cut. Groups, not documents, are the rows of the rounds. Only per-shard totals and the
oversize groups reach the driver.

Cases: null text counts as empty, with size 1; empty tables give empty results; repeated rows and repeated or null
ids are documents of their own, told apart only by their position; long texts are only hashed; with fewer documents
than shards some shards stay empty; other columns are passed by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import materialize, slots

GROUP = ["text_hash", "text_crc32", "size"]


def _lookup(values: dict[int, int], key: Column) -> Column:
    """A per-shard number (there are as many as shards) as an expression."""
    return F.coalesce(F.element_at(F.array(*[F.lit(values.get(s, 0)).cast("long") for s in range(max(values) + 1)]), (key + 1).cast("int")), F.lit(0))


def propagate(groups: DataFrame, shards: int, free: dict[int, int]) -> tuple[list[DataFrame], list[DataFrame], dict[int, int]]:
    """Rounds of label propagation over groups (with n): those placed whole (with shard and c), those with no shard that has room (with c), and the room left."""
    placed, left = [], []
    while True:
        # Document k of a group starts on shard (hash + k) mod shards.
        dealt = lambda s: F.floor(F.col("n") / shards) + (F.pmod(F.lit(s) - F.pmod("text_hash", F.lit(shards)), F.lit(shards)) < F.col("n") % shards).cast("long")
        turn = lambda s: F.pmod(F.pmod("text_hash", F.lit(shards)) + s, F.lit(shards))
        choices = F.array(*[F.when(F.col("n") <= free[s], F.struct(dealt(s).alias("c"), turn(s).alias("turn"), F.lit(s).alias("shard"))) for s in range(shards)])
        asked = materialize(groups.withColumn("goal", F.array_max(choices).shard), "asked")
        left.append(asked.filter("goal IS NULL").select(*GROUP, F.col("n").alias("c")))
        ranked = slots(asked.filter("goal IS NOT NULL"), ["goal"], [F.col(k) for k in GROUP], "at", weight=F.col("n"))
        ranked = materialize(ranked.withColumn("fits", F.col("at") + F.col("n") <= _lookup(free, F.col("goal"))), "moves")
        moved = {r.goal: r.n for r in ranked.filter("fits").groupBy("goal").agg(F.sum("n").alias("n")).collect()}
        if not moved:
            return placed, left, free
        placed.append(ranked.filter("fits").select(*GROUP, F.col("goal").alias("shard"), F.col("n").alias("c")))
        free = {s: free[s] - moved.get(s, 0) for s in range(shards)}
        groups = ranked.filter("NOT fits").select(*GROUP, "n")


def place_oversize(sizes: list[int], free: dict[int, int]) -> tuple[list[list[tuple[int, int]]], list[int], dict[int, int]]:
    """Whole shards (shard, c) for each oversize group, largest first; what is left of each; and the room left."""
    free, whole, rest = dict(free), [[] for _ in sizes], list(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        for s in sorted(free, key=lambda s: (-free[s], s)):
            if 0 < free[s] <= rest[k]:
                whole[k].append((s, free[s]))
                rest[k] -= free[s]
                free[s] = 0
    return whole, rest, free


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: size, checksum, law, shard, slot (gapless from 0 in its shard) and grown_shard (null)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"))
    rows = materialize(rows, "sized")
    groups = materialize(rows.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n")), "groups")
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    quota = {s: total // shards + (s < total % shards) for s in range(shards)}
    most = max(quota.values())

    # Groups over a shard's quota are fewer than shards, unless no two documents share a shard: then nothing can be kept together.
    large = groups.filter(F.col("n") > most).orderBy("n", *GROUP).collect()
    whole, rest, free = place_oversize([g.n for g in large], quota)
    fixed = [(g.text_hash, g.text_crc32, g.size, s, c) for g, own in zip(large, whole, strict=True) for s, c in own]
    ends = []
    for g, n in zip(large, rest, strict=True):
        room = min(((f, s) for s, f in free.items() if f >= n > 0), default=None)
        if room:
            fixed.append((g.text_hash, g.text_crc32, g.size, room[1], n))
            free[room[1]] -= n
        elif n:
            ends.append((g.text_hash, g.text_crc32, g.size, n))
    placed, left, free = propagate(groups.filter((F.col("n") > 1) & (F.col("n") <= most)), shards, free)
    key = "text_hash long, text_crc32 long, size long"
    spark = docs.sparkSession
    kept = spark.createDataFrame(fixed, f"{key}, shard int, c long")
    for part in placed:
        kept = kept.unionByName(part)

    # What fits in no shard, and then all documents without a link, fill the room that is left, the largest room first.
    cut = spark.createDataFrame(ends, f"{key}, c long")
    for part in left:
        cut = cut.unionByName(part)
    cut = materialize(cut, "cut")
    before = cut.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    order = [F.col(k) for k in [*GROUP, "c"]]
    loose = slots(cut, [], order, "at", weight=F.col("c"))
    single = slots(groups.filter("n = 1").select(*GROUP, F.col("n").alias("c")), [], order, "at", weight=F.col("c"))
    loose = loose.unionByName(single.withColumn("at", F.col("at") + before))
    room, start = [], 0
    for s in sorted(free, key=lambda s: (-free[s], s)):
        end = start + free[s]
        room.append(F.struct(F.lit(s).alias("shard"), F.greatest(F.col("at"), F.lit(start)).alias("a"), F.least(F.col("at") + F.col("c"), F.lit(end)).alias("b")))
        start = end
    filled = loose.select(*GROUP, F.explode(F.filter(F.array(*room), lambda x: x.a < x.b)).alias("p")).select(*GROUP, "p.shard", (F.col("p.b") - F.col("p.a")).alias("c"))
    shares = kept.unionByName(filled).groupBy(*GROUP, "shard").agg(F.sum("c").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*GROUP).orderBy("shard"))
    shares = shares.withColumn("upto", upto).groupBy(*GROUP).agg(F.sort_array(F.collect_list(F.struct("upto", "shard"))).alias("shares"))

    # A document's position in its group decides which of the group's shares it is in.
    ranked = slots(rows, GROUP, [F.col("doc_id")], "rank")
    placed = ranked.join(shares, GROUP).select("doc_id", *GROUP, F.element_at(F.filter("shares", lambda x: x.upto > F.col("rank")), 1).shard.alias("shard"))
    placed = slots(materialize(placed, "placed"), ["shard"], [F.col("doc_id"), F.col("text_hash")], "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
