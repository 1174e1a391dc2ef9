"""Sharding by balanced label propagation, as joins and aggregates of a table of group fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparklines.llm.common import cut, drop, small, unit_draw


def _number(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Add name, a gapless number from 0 in order of keys: range partitions, counted, then offset by the counts before."""
    spark = rows.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    ordered = cut(ordered.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ordered")
    before = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    offsets = ordered.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return ordered.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_i") + F.col("_before")).drop("_p", "_i", "_before")  # a row for each partition


def _place(r: Column, room: list[int]) -> Column:
    """The shard of the r-th row, if shard k takes the next room[k] rows."""
    ends, total = [], 0
    for n in room:
        total += n
        ends.append(total)
    return F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= r)).cast("int")


def _of(values: list, label: Column) -> Column:
    """values[label]."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), label + 1)


def _spread(frags: DataFrame, room: list[int], rounds: int, seed: str) -> DataFrame:
    """Labels of frags(g, start, n, members, label) after the rounds of propagation.

    In a round a group is called to the shard that holds most of it, among those that could take all of it if there are such. A shard admits groups, each whole
    or not at all, by a draw under the share of its callers that there is room for. Every other round the callers' leaving is counted as room.
    """
    for k in range(rounds):
        load = {r["label"]: r["n"] for r in frags.groupBy("label").agg(F.sum("n").alias("n")).collect()}  # a row for each shard
        space = [r - load.get(i, 0) for i, r in enumerate(room)]
        held = frags.withColumn("_w", F.sum("n").over(W.partitionBy("g", "label")))
        fits = F.col("members") - F.col("_w") <= _of(space, F.col("label"))
        best = F.max(F.struct(fits.alias("fits"), F.col("_w").alias("w"), F.xxhash64(F.lit(k), "g", "label").alias("h"), F.col("label").alias("to"))).over(W.partitionBy("g"))
        called = cut(held.withColumn("to", best["to"]).drop("_w"), "calls")
        flows = called.filter("label <> to").groupBy("label", "to").agg(F.sum("n").alias("n")).collect()  # shards x shards rows at most
        if not flows:
            return called.drop("to")
        asked, leaving = [0] * len(room), [0] * len(room)
        for f in flows:
            asked[f["to"]] += f["n"]
            leaving[f["label"]] += f["n"]
        share = [max(0.0, min(1.0, (s + (k % 2 == 0) * y) / a)) if a else 1.0 for s, y, a in zip(space, leaving, asked, strict=True)]
        go = unit_draw(f"{seed}{k}", F.col("g"), F.col("to")) < _of(share, F.col("to"))
        moved = cut(called.withColumn("label", F.when(go, F.col("to")).otherwise(F.col("label"))).drop("to"), "frags")
        drop(called)
        drop(frags)
        frags = moved
    return frags


def shard_documents(docs: DataFrame, shards: int = 40, rounds: int = 6, seed: str = "shard") -> DataFrame:
    """Deal docs(doc_id, text) over shards: doc_id, size, text_crc32, law, shard, slot, grown_shard, cut_group.

    Documents of equal text are linked. Every row starts in a shard drawn by its id; rows of a group that start in the same
    shard are a fragment, counted and moved as one, so a group of any size is at most `shards` rows of the propagation. In each round
    a group's fragments are called to the shard that holds most of it, and a shard admits the share of its callers,
    drawn by group, that its quota has room for. The quota is the shard's exact number of rows; a group larger than
    that is laid over consecutive shards first, and what it leaves is the others' quota. At the end fragments beyond a quota lose their
    last rows, and those, with the rows that have no equal, fill the places left: counts differ by one at most (law `rows`), and a group within the quota is
    cut only if its call found no room. slot: number within the shard. cut_group: the group lies in several shards, so its
    edges are cut. grown_shard is null: this law gives no promise about more shards. rounds=0 leaves every row of a group where it started.

    Null text: size 16, checksum 0, and one group with the empty text. Null ids and repeated rows are rows
    like others. Fewer rows than shards: shards of one row and none.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("g"),
    )
    rows = cut(rows.withColumn("g", F.xxhash64("g", "text_crc32", "size")), "rows")
    n = rows.count()
    quota = [n // shards + (k < n % shards) for k in range(shards)]
    most = max(1, n // shards)
    start = F.floor(unit_draw(seed, F.col("doc_id"), F.col("g")) * shards).cast("int")
    rows = rows.withColumn("start", start)
    frags = rows.groupBy("g", "start").agg(F.count(F.lit(1)).alias("n"))
    frags = cut(frags.withColumn("members", F.sum("n").over(W.partitionBy("g"))).filter("members > 1"), "frags")
    # groups over a quota: consecutive rows of consecutive shards
    huge = cut(frags.filter(F.col("members") > most).groupBy("g").agg(F.sum("n").alias("members")), "huge")
    held = huge.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]  # such groups are at most as many as shards
    room, left = [], held
    for q in quota:
        room.append(q - min(q, left))
        left -= min(q, left)
    free = [k for k in range(shards) if room[k]]
    normal = frags.filter(F.col("members") <= most)
    first = F.element_at(F.array(*[F.lit(free[int(k * len(free) / shards)]) for k in range(shards)]), F.col("start") + 1) if free else F.lit(0)
    moved = _spread(cut(normal.withColumn("label", first), "frags"), room, rounds, seed)
    # rows of groups within the quota, numbered in their shard; those beyond its room go on with the single rows
    grouped = rows.join(small(moved.select("g", "start", "label"), moved.count(), 40), ["g", "start"], "left")
    big = F.broadcast(huge.select("g", F.lit(True).alias("huge")))  # at most `shards` rows
    kinds = grouped.join(big, "g", "left").select("doc_id", "size", "text_crc32", "g", F.when(F.col("huge"), F.lit(-1)).otherwise(F.coalesce("label", F.lit(shards))).alias("label"))
    one = _number(kinds, ["label", "g", "doc_id"], "r")
    counts = {r["label"]: r["n"] for r in one.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # shards + 2 rows at most
    begin, at = {}, 0
    for label in range(-1, shards + 1):
        begin[label], at = at, at + counts.get(label, 0)
    inside = [min(counts.get(k, 0), room[k]) for k in range(shards)]
    local = F.col("r") - F.element_at(F.array(*[F.lit(begin[k]) for k in range(-1, shards + 1)]), F.col("label") + 2)
    fits = F.col("label").between(0, shards - 1) & (local < F.element_at(F.array(*[F.lit(x) for x in inside], F.lit(0)), F.greatest("label", F.lit(0)) + 1))
    # of the rows that fill up: the number among them is the row's own less all that stand elsewhere before it
    over, skipped = [0], counts.get(-1, 0)
    for k in range(shards):
        skipped += inside[k]
        over.append(skipped)
    rest = F.col("r") - F.element_at(F.array(*[F.lit(x) for x in [0, *over[1:], over[-1]]]), F.col("label") + 2)
    filling = _place(rest, [r - i for r, i in zip(room, inside, strict=True)])
    shard = F.when(F.col("label") == -1, _place(F.col("r"), quota)).when(fits, F.col("label")).otherwise(filling).cast("int")
    placed = cut(one.withColumn("shard", shard), "placed")
    spread = cut(placed.groupBy("g").agg((F.min("shard") < F.max("shard")).alias("cut_group")).filter("cut_group"), "cut")
    numbered = _number(placed, ["shard", "g", "doc_id"], "q")
    base = [sum(quota[:k]) for k in range(shards)]
    out = numbered.join(small(spread, spread.count(), 32), "g", "left")
    slot = F.col("q") - F.element_at(F.array(*[F.lit(b) for b in base]), F.col("shard") + 1)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot.cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), F.coalesce("cut_group", F.lit(False)).alias("cut_group"),
    )
