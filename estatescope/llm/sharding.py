"""Sharding (9): balanced label propagation, in DataFrame operations only.

Documents that are linked (here: by equal texts) should meet in one shard, and all shards should
hold the same number of bytes.  Linked documents start with scattered labels and then move, round by
round, towards the shard in which most of their group's bytes are, as far as that shard's quota allows.
A group that has not met in one shard is then laid, whole, where there is room for it; only groups that
fit nowhere (fewer than the shards) and groups larger than a shard are cut, in an order that keeps
them together.  What has no links fills the room that is left, so that sizes come out even to within a document.

What moves is a unit: the documents of one group that fall into one of ``PARTS`` parts by their id.
A group with a third of all documents is many units, which can go to several shards, and is summed per
unit before anything is shuffled.  Running sums over all documents are taken in two steps, over buckets and
within them, so that no window sees a whole shard.

Null texts have size 1 and no links.  Repeated rows are documents of their own; an empty table gives an
empty table; null ids are as good as others; only the two named columns are read, so others may have
any name.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from estatescope.llm.registry import query, read
from estatescope.workspace import removed, stored, work_folder

SHARDS = 16
#: Units of a group, rounds of moves, and buckets of the running sums.
PARTS, ROUNDS, BUCKETS = 64, 6, 4096


def described(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, key, part): sizes in bytes and the group of equal texts."""
    t = F.col(text).cast("string")
    rows = docs.select(F.col(doc_id).alias("doc_id"), t.alias("t"))
    return rows.select(
        "doc_id", (F.coalesce(F.octet_length("t"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("t").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.md5(F.col("t").cast("binary")), F.concat(
            F.lit("null "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("key"),
        F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(PARTS)).cast("int").alias("part"))


def _running(value: Column, within: list[str], bucket: str, order: list[str | Column],
             rows: DataFrame, out: str) -> DataFrame:
    """``out``: the sum of ``value`` over all rows before each one, per ``within``, ordered by bucket and order."""
    sums = rows.groupBy(*within, bucket).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*within).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*within, bucket, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*within, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    step = rows.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return step.join(sums, [*within, bucket]).withColumn(out, F.col("_before") + F.col("_inside")) \
        .drop("_before", "_inside")


def _bucket(*columns: str | Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*columns), 64 - BUCKETS.bit_length() + 1)


def _at(numbers: list[float], shard: str) -> Column:
    """The number of a shard."""
    return F.element_at(F.array(*[F.lit(float(x)) for x in numbers]), F.col(shard) + 1)


def propagated(units: DataFrame, room: list[float], folder: str, shards: int = SHARDS,
               rounds: int = ROUNDS) -> DataFrame:
    """(key, part, bytes, shard): units after their moves.

    A round: bytes per (group, shard), the best shard of each group (ties: by a hash), and the moves
    towards it, those of the largest groups first, while the shard's quota lasts.  ``room``: the bytes
    that each shard may hold.  Groups that have not met after the last round are laid by ``_whole_groups``."""
    spark = units.sparkSession
    state = stored(units.withColumn("shard", F.pmod(F.xxhash64("key", "part"), F.lit(shards)).cast("int")),
                   f"{folder}/labels-0")
    for turn in range(1, rounds + 1):
        held = state.groupBy("key", "shard").agg(F.sum("bytes").alias("here"))
        best = held.groupBy("key").agg(
            F.min_by("shard", F.struct(-F.col("here"), F.xxhash64("key", "shard"))).alias("goal"),
            F.sum("here").alias("group_bytes"))
        loads = state.groupBy("shard").agg(F.sum("bytes").alias("load"))
        wishes = state.join(best, "key").withColumn("moves", F.col("shard") != F.col("goal"))
        # Larger groups first: by the power of two of their bytes, then by an arbitrary fixed order.
        moving = _running(F.col("bytes"), ["goal"], "rank", ["key", "part"],
                          wishes.where("moves").withColumn("rank", _by_size("group_bytes")), "ahead")
        fits = F.col("ahead") + F.col("bytes") + F.coalesce("load", F.lit(0)) <= _at(room, "goal")
        moved = moving.join(loads.select(F.col("shard").alias("goal"), "load"), "goal", "left") \
            .withColumn("moved", fits)
        columns = ["key", "part", "bytes"]
        after = wishes.where(~F.col("moves")).select(*columns, "shard", F.lit(False).alias("moved")).union(
            moved.select(*columns, F.when(F.col("moved"), F.col("goal")).otherwise(F.col("shard")).alias("shard"), "moved"))
        after = stored(after, f"{folder}/labels-{turn}")
        removed(spark, f"{folder}/labels-{turn - 1}")
        state = after.drop("moved")
        if after.where("moved").isEmpty():
            break
    return state


def _by_size(size: str) -> Column:
    """A bucket: the larger power of two first, then by key."""
    return ((F.lit(63) - F.floor(F.log2(size))) * F.lit(BUCKETS) + _bucket("key")).cast("long")


def _whole_groups(groups: DataFrame, room: list[float], folder: str) -> DataFrame:
    """(key, bytes, shard) of those of ``groups`` (key, bytes) that fit whole into the room of a shard.

    They are laid one after the other over the room of all shards, the largest first.  Only those on
    a border, fewer than the shards, do not lie in one shard; they go where most room is left."""
    order = sorted(range(len(room)), key=lambda s: -room[s])
    ends = list(accumulate(room[s] for s in order))
    rows = _running(F.col("bytes"), [], "rank", ["key"], groups.withColumn("rank", _by_size("bytes")), "ahead")
    # The place among the borders where a group begins and where it ends.
    first = sum((F.when(F.col("ahead") >= F.lit(end), 1).otherwise(0) for end in ends), F.lit(0))
    last = sum((F.when(F.col("ahead") + F.col("bytes") > F.lit(end), 1).otherwise(0) for end in ends), F.lit(0))
    shards = F.array(*map(F.lit, order))
    laid = stored(rows.select("key", "bytes", F.get(shards, first).alias("shard"), F.get(shards, last).alias("last")),
                  f"{folder}/groups")
    within = laid.where("shard = last").select("key", "bytes", "shard")
    left = _room_left(within, room)
    later, chosen = [], {}
    # Fewer than the shards.
    for r in laid.where("NOT shard <=> last").orderBy(F.desc("bytes"), "key").limit(len(room)).collect():
        s = max(range(len(left)), key=lambda s: left[s])
        if r.bytes <= left[s]:
            left[s] -= r.bytes
            chosen[r.key] = s
            later.append(r.key)
    if not later:
        return within
    shard = F.element_at(F.array(*[F.lit(chosen[k]) for k in later]), F.array_position(
        F.array(*map(F.lit, later)), F.col("key")).cast("int"))
    return within.union(laid.where(F.col("key").isin(later)).select("key", "bytes", shard.alias("shard")))


def _room_left(taken: DataFrame, room: list[float]) -> list[float]:
    """The room without the bytes in ``taken`` (bytes, shard): as many numbers as shards."""
    held = {r.shard: r.held for r in taken.groupBy("shard").agg(F.sum("bytes").alias("held")).collect()}
    return [max(0.0, free - held.get(s, 0)) for s, free in enumerate(room)]


def sharded(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text",
            rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): sizes of shards near equal, equal texts together."""
    folder = work_folder(docs.sparkSession, "sharding")
    rows = stored(described(docs, doc_id, text), f"{folder}/documents")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total")).first()["total"]
    capacity = total / shards
    room = [capacity] * shards

    units = rows.groupBy("key", "part").agg(
        F.sum("size").alias("bytes"), F.count("*").alias("n"))
    linked = units.groupBy("key").agg(F.sum("n").alias("copies"), F.sum("bytes").alias("group_bytes")) \
        .where("copies > 1").select("key", (F.col("group_bytes") > capacity).alias("too_large"))
    units = stored(units.join(linked, "key").select("key", "part", "bytes", "too_large"), f"{folder}/units")
    columns = ["doc_id", "size", "text_crc32", "key", "part"]

    # Groups that no shard can hold fill whole shards; there are fewer of them than shards.
    large = rows.join(units.where("too_large").select("key", "part"), ["key", "part"], "left_semi")
    large = stored(_laid(large.select(*columns, _contiguous()), room), f"{folder}/large")
    room = _room_left(large.select("shard", F.col("size").alias("bytes")), room)

    # Groups that met in a shard and fit there stay; the others are laid whole into the room that is left.
    labels = propagated(units.where("NOT too_large").drop("too_large"), room, folder, shards, rounds)
    groups = stored(labels.groupBy("key").agg(
        F.sum("bytes").alias("bytes"), F.min("shard").alias("shard"), F.max("shard").alias("last")), f"{folder}/met")
    met = _running(F.col("bytes"), ["shard"], "rank", ["key"], groups.where("shard = last").withColumn(
        "rank", _by_size("bytes")), "ahead")
    met = stored(met.where(F.col("ahead") + F.col("bytes") <= _at(room, "shard")).select("key", "bytes", "shard"),
                 f"{folder}/stay")
    room = _room_left(met, room)
    others = groups.join(met, "key", "left_anti").select("key", "bytes")
    placed = met.union(_whole_groups(others, room, folder))
    placed = stored(units.where("NOT too_large").join(placed.select("key", "shard"), "key")
                    .select("key", "part", "bytes", "shard"), f"{folder}/placed")
    room = _room_left(placed.union(large.select("key", "part", F.col("size").alias("bytes"), "shard")),
                      [capacity] * shards)

    # Groups that fit nowhere (fewer than the shards) are cut where a shard ends.
    both = rows.join(placed.select("key", "part", "shard"), ["key", "part"], "left")
    free = both.where("shard IS NULL").join(
        units.select("key", "part", "too_large"), ["key", "part"], "left")
    free = stored(free.where("too_large IS NULL OR NOT too_large").select(
        *columns, F.col("too_large").isNotNull().alias("cut")), f"{folder}/free")
    cut = stored(_laid(free.where("cut").select(*columns, _contiguous()), room), f"{folder}/cut")
    room = _room_left(cut.select("shard", F.col("size").alias("bytes")), room)
    loose = free.where("NOT cut").select(*columns, _bucket("key", "part").alias("spot"))

    # Larger documents first, so that the last ones even the sizes out.
    mean, mass = loose.agg(F.avg("size"), F.sum("size")).first()
    small = F.col("size") <= F.lit(mean or 0)
    big_mass = loose.where(~small).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    share = big_mass / (mass or 1)
    first = stored(_laid(loose.where(~small), [x * share for x in room]), f"{folder}/laid")
    last = _laid(loose.where(small), _room_left(first.select("shard", F.col("size").alias("bytes")), room))
    columns = ["doc_id", "size", "text_crc32", "key", "shard"]
    whole = both.where("shard IS NOT NULL").select(*columns)
    for part in (large, cut, first, last):
        whole = whole.union(part.select(*columns))
    whole = stored(whole, f"{folder}/sharded")
    order = ["key", "doc_id", "text_crc32"]
    return _running(F.lit(1), ["shard"], "spot", order, whole.withColumn("spot", _bucket(
        F.col("doc_id").cast("string"), "key")), "slot").select(
            "doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))


def _contiguous() -> Column:
    """A spot by key, then part: for few groups of many documents."""
    return (_bucket("key") * PARTS + F.col("part")).alias("spot")


def _laid(loose: DataFrame, room: list[float]) -> DataFrame:
    """``loose`` with a shard: cut, in the order of spot, where the room of the shards ends."""
    order = sorted(range(len(room)), key=lambda s: -room[s])
    ends = list(accumulate(room[s] for s in order))
    rows = _running(F.col("size"), [], "spot", ["key", "part", "doc_id"], loose, "ahead")
    middle = F.col("ahead") + F.col("size") / 2
    place = sum((F.when(middle >= F.lit(end), 1).otherwise(0) for end in ends[:-1]), F.lit(0))
    return rows.withColumn("shard", F.get(F.array(*map(F.lit, order)), place))


@query("op9_sharding")
def op9_sharding(spark: SparkSession, path: str) -> DataFrame:
    return laws(sharded(read(spark, path, "documents")))


def laws(found: DataFrame) -> DataFrame:
    """The columns of the query: sizes near equal is the law that holds."""
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))
