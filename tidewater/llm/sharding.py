"""Operator 7: balanced shards by label propagation over linked documents.

Documents are linked through groups (equal texts).  Every row starts with a label
drawn from its row number.  Groups larger than a shard are first split into blocks
of a shard's capacity, by exact row numbers, so none need be torn further.  Then each
round every unsettled block moves to the shard that most of its rows carry among
those with room for it, the largest blocks first under the shard's remaining quota
(running sums over hash buckets, so no shard's applicants meet in one task); a block
without such a neighbour moves to a shard with room for it, drawn in proportion to
the room.  Rounds go on until no block fits whole.  A block that fits nowhere is cut
into as few pieces as the room left allows; rows without a partner fill the
remaining quota by exact row number.  Groups are cliques, so a block's neighbours
are its own rows and move with it: votes settle without being propagated further.

Law ``rows``: shard row counts differ by at most one.

Bounded work on the driver: room per shard, the blocks larger than a sixteenth
of a shard (at most 16 per shard), which are placed one by one, largest first, and
the smaller blocks that fit nowhere (fewer than shards, since each exceeds any room
left and all rows left fill the room exactly).

Results: null text counts as empty for size, checksum and group.  Null ids and
repeated rows are rows like any other.  Only the id and text columns are read.  An
empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from itertools import accumulate, count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.llm.common import cut_lineage, number_rows, row_buckets

ROW_OVERHEAD = 16
LARGE_PARTS = 16


def _label(row: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(row, F.lit(7)), F.lit(shards)).cast("int")


def _blocks(rows: DataFrame, sizes: DataFrame, capacity: int) -> DataFrame:
    """(_row, block): groups of two rows and more as blocks of at most ``capacity`` rows."""
    linked = rows.join(sizes, "grp")
    small = linked.where(F.col("n") <= capacity).select("_row", F.struct("grp", F.lit(0).cast("long").alias("part")).alias("block"))
    # written first: the join has dealt rows by group, and numbering in that deal would keep a hot group in one task
    large = cut_lineage(linked.where(F.col("n") > capacity).select("_row", "grp"))
    n = large.count()
    if not n:
        return small
    numbered = number_rows(large, n, F.col("grp"), F.col("_row"), "at")
    return small.union(numbered.select("_row", F.struct("grp", F.floor(F.col("at") / capacity).cast("long").alias("part")).alias("block")))


def _place_large(votes: list, room: list[int]) -> list[tuple]:
    """Blocks of known votes one by one, largest first: to the shard with most of their rows that has room, else most room."""
    out = []
    by_block: dict[tuple, dict[int, int]] = {}
    for v in votes:
        by_block.setdefault((v.grp, v.part), {})[v.label] = v.votes
    for block, got in sorted(by_block.items(), key=lambda x: (-sum(x[1].values()), x[0])):
        size = sum(got.values())
        fits = [s for s in range(len(room)) if room[s] >= size]
        if fits:
            to = min(fits, key=lambda s: (-got.get(s, 0), -room[s], s))
            room[to] -= size
            out.append((*block, to))
    return out


def _cut(sizes: dict[tuple, int], room: list[int]) -> dict[tuple, list[tuple[int, int]]]:
    """Per block its pieces (shard, rows), largest block first, each in as few pieces as the room allows."""
    out: dict[tuple, list[tuple[int, int]]] = {}
    for block, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        while size and max(room) > 0:
            fits = [s for s in range(len(room)) if room[s] >= size]
            to = min(fits, key=lambda s: (room[s], s)) if fits else max(range(len(room)), key=lambda s: (room[s], -s))
            rows = min(size, room[to])
            out.setdefault(block, []).append((to, rows))
            room[to] -= rows
            size -= rows
    return out


def _by_room(room: list[int], turn: int) -> Column:
    """A shard with room for ``size``, drawn in proportion to the room by a hash of block and turn; null if none."""
    fitting = F.transform(F.array(*[F.lit(int(x)).cast("long") for x in room]), lambda r: F.when(r >= F.col("size"), r).otherwise(F.lit(0).cast("long")))
    ends = F.aggregate(fitting, F.array().cast("array<long>"), lambda a, r: F.concat(a, F.array(r + F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)))))
    total = F.get(ends, F.lit(len(room) - 1))
    at = F.pmod(F.xxhash64("block", F.lit(turn)), total)
    return F.when(total > 0, F.size(F.filter(ends, lambda e: e <= at)))


def _accept(wishes: DataFrame, room: list[int], n_blocks: int) -> DataFrame:
    """Of (block, size, to): those that fit their shard's room when taken largest first."""
    room_of = F.element_at(F.array(*[F.lit(int(x)).cast("long") for x in room]), F.col("to") + 1)
    w = (wishes.withColumn("class", -F.floor(F.log2("size")).cast("int"))
         .withColumn("h", F.xxhash64("block")).withColumn("b", F.pmod("h", F.lit(row_buckets(n_blocks)))))
    sums = w.groupBy("to", "class", "b").agg(F.sum("size").alias("s"))
    ahead = Window.partitionBy("to").orderBy("class", "b").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("to", "class", "b", F.coalesce(F.sum("s").over(ahead), F.lit(0)).alias("base"))
    inside = Window.partitionBy("to", "class", "b").orderBy("h", "block").rowsBetween(Window.unboundedPreceding, 0)
    return (w.withColumn("run", F.sum("size").over(inside)).join(base, ["to", "class", "b"])
            .where(F.col("base") + F.col("run") <= room_of).select("block", "size", "to"))


def assign(rows: DataFrame, shards: int) -> DataFrame:
    """``rows`` (checkpointed; _row unique, grp) plus shard; counts differ by at most one."""
    spark = rows.sparkSession
    n = rows.count()
    capacity = n // shards
    quota = [capacity + (s < n % shards) for s in range(shards)]
    room = list(quota)
    # written before it is joined back, so that the join is dealt out anew and a large group can be split
    sizes = cut_lineage(rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1))
    settled: list[DataFrame] = []
    members = None
    pieces: dict[tuple, list[tuple[int, int]]] = {}
    if capacity > 1:
        members = cut_lineage(_blocks(rows.select("_row", "grp"), sizes, capacity))
        votes = cut_lineage(members.groupBy("block", _label(F.col("_row"), shards).alias("label")).agg(F.count(F.lit(1)).alias("votes")))
        size = votes.groupBy("block").agg(F.sum("votes").alias("size"))
        limit = max(1, capacity // LARGE_PARTS)
        large = size.where(F.col("size") > limit).select("block")
        large_votes = votes.join(large, "block").select("block.grp", "block.part", "label", "votes").collect()
        taken = _place_large(large_votes, room)
        uncut: dict[tuple, int] = {}
        for v in large_votes:
            uncut[(v.grp, v.part)] = uncut.get((v.grp, v.part), 0) + v.votes
        for grp, part, _ in taken:
            del uncut[(grp, part)]
        pieces = _cut(uncut, room)  # now, while there is room for large pieces
        if taken:
            schema = f"grp {rows.schema['grp'].dataType.simpleString()}, part long, to int"
            settled.append(spark.createDataFrame(taken, schema).select(F.struct("grp", "part").alias("block"), "to"))
        open_ = cut_lineage(votes.join(size.where(F.col("size") <= limit), "block"))
        for turn in count():  # every round settles a block or is the last
            left = open_.agg(F.countDistinct("block")).first()[0]
            if not left or max(room) < 2:
                break
            room_of = F.element_at(F.array(*[F.lit(int(x)).cast("long") for x in room]), F.col("label") + 1)
            fits = F.when(room_of >= F.col("size"), F.struct("votes", F.xxhash64("block", "label").alias("tie"), "label"))
            wishes = open_.groupBy("block").agg(F.first("size").alias("size"), F.max(fits).alias("best")).select(
                "block", "size", F.coalesce(F.col("best.label"), _by_room(room, turn)).alias("to")).where(F.col("to").isNotNull())
            accepted = cut_lineage(_accept(wishes, room, left))
            used = {r.to: r.s for r in accepted.groupBy("to").agg(F.sum("size").alias("s")).collect()}  # a row a shard
            if not used:
                break
            room = [x - used.get(s, 0) for s, x in enumerate(room)]
            settled.append(accepted.select("block", "to"))
            open_ = cut_lineage(open_.join(accepted.select("block"), "block", "left_anti"))
        if left:
            small = open_.groupBy("block").agg(F.first("size").alias("size")).select("block.grp", "block.part", "size").collect()
            pieces |= _cut({(r.grp, r.part): r.size for r in small}, room)
    homes = [members.join(reduce(DataFrame.union, settled), "block").select("_row", F.col("to").alias("shard"))] if settled else []
    if pieces:
        schema = f"grp {rows.schema['grp'].dataType.simpleString()}, part long, ends array<long>, shards array<int>"
        cuts = spark.createDataFrame([(*b, list(accumulate(k for _, k in p)), [s for s, _ in p]) for b, p in pieces.items()], schema)
        torn = cut_lineage(members.join(F.broadcast(cuts.select(F.struct("grp", "part").alias("block"), "ends", "shards")), "block"))
        numbered = number_rows(torn, torn.count(), F.col("block"), F.col("_row"), "at")
        to = F.get("shards", F.size(F.filter("ends", lambda e: e <= F.col("at"))))  # null beyond the last piece
        homes.append(numbered.select("_row", to.alias("shard")))
    if homes:
        placed = rows.join(reduce(DataFrame.union, homes), "_row", "left")
    else:
        placed = rows.withColumn("shard", F.lit(None).cast("int"))
    placed = cut_lineage(placed)
    used = {r.shard: r.c for r in placed.where(F.col("shard").isNotNull()).groupBy("shard").agg(F.count(F.lit(1)).alias("c")).collect()}
    free = placed.where(F.col("shard").isNull()).drop("shard")
    need = [quota[s] - used.get(s, 0) for s in range(shards)]
    ends = [sum(need[:s + 1]) for s in range(shards)]
    filled = number_rows(free, n - sum(used.values()), None, F.col("_row"), "_n")
    # the first shard whose quota the row's number falls into
    shard = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= F.col("_n")))
    return placed.where(F.col("shard").isNotNull()).unionByName(filled.withColumn("shard", shard.cast("int")).drop("_n"))


def balanced_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, size, text_crc32, law, shard, slot (gapless from 0 in its shard), grown_shard (null under this law)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut_lineage(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text, 256).alias("grp"),
        F.monotonically_increasing_id().alias("_row")))
    n = rows.count()
    done = cut_lineage(assign(rows.select("_row", "grp"), shards)) if n else rows.withColumn("shard", F.lit(0))
    out = number_rows(rows.drop("grp").join(done.select("_row", "shard"), "_row"), n, F.col("shard"), F.col("_row"), "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
