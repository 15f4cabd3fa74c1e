"""Sharding by balanced label propagation, in DataFrame operations only.

Documents with equal texts are linked. Each (group of links, first shard) is a vertex
with a weight; every round a vertex wants the shard where most of its group already is.
Moves are admitted under quotas: from shard a to shard b about as many documents move as
move back or as b has room for, strongest wishes first (a hash decides who of a class of
wishes goes, so a quota holds on average, and one heavy vertex can overshoot it). The law
doesn't hang on that: exact positions are then
handed out along the propagated order, so shard counts differ by one at most, groups
stay together, and at most ``shards - 1`` groups (beside those larger than a shard) are
cut by a shard's end.

No step needs a group, a shard or a wish class in one task: documents of a group are
dealt over salted cells, quotas are filled from histograms, and positions come from
running sums over blocks of cells.

Law "rows": counts of documents at most one apart. Null texts are one group of equal
(absent) texts; repeated rows are separate documents with the same text. An empty table
gives no rows. Only id and text are read, so further columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from canopy.llm.stage import written

#: Documents of a group in one cell, about.
CELL = 512
#: Cells in one block of running sums, about, and the most blocks of a shard (whose sums meet in one task).
BLOCK, BLOCKS = 2_048, 8_192
ROUNDS = 4


def text_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def text_crc(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def running_start(cells: DataFrame, order: list[str], weight: str, blocks: int, name: str) -> DataFrame:
    """``cells`` plus ``name``: the sum of ``weight`` over all earlier cells in ``order``.

    The first entry of ``order`` is a leading key of few values, the second a hash; blocks are
    ranges of the hash, so they are even, and only their sums meet in one place.
    """
    lead, code = order[0], order[1]
    placed = cells.withColumn("__block", F.floor((F.col(code) / F.lit(2.0**64) + 0.5) * blocks))
    sums = placed.groupBy(lead, "__block").agg(F.sum(weight).alias("__sum"))
    before = sums.withColumn("__before", F.sum("__sum").over(Window.orderBy(lead, "__block").rowsBetween(Window.unboundedPreceding, -1)))
    inner = Window.partitionBy(lead, "__block").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, -1)
    joined = placed.join(before.drop("__sum"), [lead, "__block"])
    return joined.withColumn(name, F.coalesce("__before", F.lit(0)) + F.coalesce(F.sum(weight).over(inner), F.lit(0))).drop("__block", "__before")


def propagate(state: DataFrame, shards: int, total: int, rounds: int = ROUNDS) -> DataFrame:
    """Move (group, first) vertices of weight n between shards; columns group, first, n, shard."""
    capacity = -(-total // shards)
    for _ in range(rounds):
        here = state.groupBy("group", "shard").agg(F.sum("n").alias("here"))
        wish = here.groupBy("group").agg(F.max(F.struct("here", (-F.col("shard")).alias("s"))).alias("m"))
        wish = wish.select("group", (-F.col("m.s")).cast("int").alias("to"), F.col("m.here").alias("pull"))
        asked = state.join(wish, "group").withColumn("level", F.when(F.col("to") != F.col("shard"), F.floor(2 * F.log2("pull"))).cast("int"))
        demand = asked.filter("level is not null").groupBy("shard", "to", "level").agg(F.sum("n").alias("want"))
        flow = demand.groupBy("shard", "to").agg(F.sum("want").alias("flow"))
        back = flow.select(F.col("to").alias("shard"), F.col("shard").alias("to"), F.col("flow").alias("back"))
        used = state.groupBy("shard").agg(F.sum("n").alias("used"))
        quota = flow.join(back, ["shard", "to"], "left").join(used.select(F.col("shard").alias("to"), "used"), "to", "left")
        room = F.greatest(F.lit(0), F.lit(capacity) - F.coalesce("used", F.lit(0))) / F.lit(shards - 1)
        quota = quota.select("shard", "to", F.floor(F.coalesce("back", F.lit(0)) + room).alias("quota"))
        above = Window.partitionBy("shard", "to").orderBy(F.col("level").desc()).rowsBetween(Window.unboundedPreceding, -1)
        ladder = demand.join(quota, ["shard", "to"]).withColumn("left", F.col("quota") - F.coalesce(F.sum("want").over(above), F.lit(0)))
        ladder = ladder.select("shard", "to", "level", (F.greatest(F.lit(0), F.col("left")) / F.col("want")).alias("share"))
        moved = asked.join(F.broadcast(ladder), ["shard", "to", "level"], "left")
        luck = F.pmod(F.xxhash64("group", "first"), F.lit(1 << 20)) / F.lit(float(1 << 20))
        go = F.coalesce(luck < F.col("share"), F.lit(False))
        state = written(moved.select("group", "first", "n", F.when(go, F.col("to")).otherwise(F.col("shard")).alias("shard")), "shards")
    return state


def shard_rows(docs: DataFrame, shards: int = 8, *, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Columns id, size, text_crc32, law, shard, slot, grown_shard, and group (hash of the text).

    ``slot`` counts from 0 within each shard without gaps. Under law "rows" a grown shard
    isn't defined, so ``grown_shard`` is null.
    """
    text = F.col(text_col)
    base = docs.select(F.col(id_col).alias("id"), text_size(text).alias("size"), text_crc(text).alias("crc"), F.xxhash64(text, F.md5(F.coalesce(text, F.lit("")).cast("binary"))).alias("group"))
    base = written(base.withColumn("first", F.pmod(F.xxhash64("id", "group"), F.lit(shards)).cast("int")).withColumn("deal", F.xxhash64("id", F.lit(7))), "shard-base")
    vertices = base.groupBy("group", "first").agg(F.count("*").alias("n"))
    linked = vertices.withColumn("all", F.lit(1)).groupBy("group").agg(F.sum("n").alias("links")).filter("links > 1")
    total = base.count()
    state = vertices.join(linked, "group").select("group", "first", "n", F.col("first").alias("shard"))
    state = propagate(written(state, "shards"), shards, total, rounds).join(linked, "group")
    state = written(state.select("group", "first", F.col("shard").alias("to"), F.ceil(F.col("links") / CELL).alias("parts")), "shards")
    placed = base.join(state, ["group", "first"], "left")
    placed = placed.select("id", "size", "crc", "group", F.coalesce("to", "first").alias("wish"), F.pmod("deal", F.coalesce("parts", F.lit(1))).alias("part"), "deal")
    cells = placed.groupBy("wish", "group", "part").agg(F.count("*").alias("n"))
    cells = running_start(cells, ["wish", "group", "part"], "n", max(1, min(total // BLOCK, BLOCKS)), "start")
    seat = Window.partitionBy("wish", "group", "part").orderBy("deal", "id", "size", "crc")
    ranked = placed.withColumn("__seat", F.row_number().over(seat) - 1).join(cells.drop("n"), ["wish", "group", "part"])
    rank = F.col("start") + F.col("__seat")
    small, extra = total // shards, total % shards
    edge = extra * (small + 1)
    shard = F.when(rank < edge, F.floor(rank / (small + 1))).otherwise(extra + F.floor((rank - edge) / max(1, small)))
    slot = F.when(rank < edge, F.pmod(rank, F.lit(small + 1))).otherwise(F.pmod(rank - edge, F.lit(max(1, small))))
    return ranked.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), shard.cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "group",
    )
