"""Filling fixed-capacity containers with documents (problem 6): refined Harmonic packing.

Lengths are partitioned into the reciprocal classes of the capacity: class k holds the lengths
over capacity / (k + 1) and up to capacity / k, and a container of class k holds k of them. Plain
Harmonic packing (``grain=None``) stops there and leaves a fifth of the space empty on mixed
lengths. Refined (the default), each reciprocal class is parted in steps of ``grain`` tokens: a
container is led by the k documents of one part of class k, and the space they are sure to leave
is given to fixed numbers of companions from smaller parts.

Only the number of documents of each part (at most capacity / grain + 2 sqrt(capacity) rows,
whatever the data) reaches the driver, which lays down how many containers of each kind there are.
Workers then number the documents of a part independently, shard by shard, from offsets, and
each document finds its container by arithmetic: no task sees a whole class.

Edge cases: documents without tokens take no space but get a container (as if of one token);
documents over the capacity are cut into full parts, a container each, and a rest that is packed
like any other document; nothing else is split; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def class_of(tokens: Column, capacity: int, grain: int | None) -> Column:
    """The part of a reciprocal class in which a length is: the largest length it may hold."""
    tokens = F.greatest(tokens, F.lit(1))
    top = F.floor(F.lit(capacity) / F.floor(F.lit(capacity) / tokens)).cast("long")
    return top if grain is None else F.least(F.ceil(tokens / grain).cast("long") * grain, top)


def patterns(counts: dict[int, int], capacity: int, companions: bool = True) -> list[tuple[int, int, int, int, int]]:
    """(part, first rank, end rank, documents a container, first container) rows that place every
    document of every part. The largest part left leads with the number of its reciprocal class,
    the whole part of capacity / length; ``companions`` fill what that leaves, the largest first."""
    left = {size: n for size, n in counts.items() if n}
    given = dict.fromkeys(left, 0)
    out, container = [], 0
    while left:
        space, chosen = capacity, []
        for size in sorted(left, reverse=True):
            n = min(space // size, left[size])
            if n:
                chosen.append((size, n))
                space -= n * size
                if not companions:
                    break
        times = min(left[size] // n for size, n in chosen)
        for size, n in chosen:
            out.append((size, given[size], given[size] + n * times, n, container))
            given[size] += n * times
            left[size] -= n * times
            if not left[size]:
                del left[size]
        container += times
    return out


def packed(sizes: DataFrame, capacity: int = 2048, grain: int | None = 8) -> DataFrame:
    """(key, part, token_start, n_tokens, container) for rows (key, n_tokens)."""
    spark = sizes.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = sizes.select("key", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n"))
    full = sizes.where(F.col("n") > capacity).select("key", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / capacity) - 1)).alias("part"))
    whole = full.select("key", F.col("part").cast("int").alias("part"), (F.col("part") * capacity).alias("token_start"), F.lit(capacity).cast("long").alias("n_tokens"),
                        F.concat(F.lit("full-"), F.col("key").cast("string"), F.lit("-"), F.col("part").cast("string")).alias("container"))
    over = F.col("n") > capacity
    items = sizes.where(~over | (F.col("n") % capacity > 0)).select(
        "key", F.when(over, F.floor(F.col("n") / capacity)).otherwise(0).cast("int").alias("part"),
        F.when(over, F.floor(F.col("n") / capacity) * capacity).otherwise(0).cast("long").alias("token_start"),
        F.when(over, F.col("n") % capacity).otherwise(F.col("n")).alias("n_tokens"),
    )
    items = items.withColumn("class", class_of(F.col("n_tokens"), capacity, grain)).withColumn("shard", F.pmod(F.xxhash64("key", "part"), F.lit(shards)).cast("int"))
    counts = items.groupBy("class", "shard").agg(F.count(F.lit(1)).alias("n"))
    totals = {r["class"]: r["n"] for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect()}  # at most capacity / grain + 2 sqrt(capacity) rows
    plan = spark.createDataFrame(patterns(totals, capacity, grain is not None), "class long, first long, until long, each long, container0 long")
    before = Window.partitionBy("class").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("class", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("class", "shard").orderBy("key", "part")
    ranked = items.withColumn("at", F.row_number().over(inside) - 1).join(offsets, ["class", "shard"]).withColumn("rank", F.col("at") + F.col("offset"))
    placed = ranked.join(F.broadcast(plan), (ranked["class"] == plan["class"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("until")))
    number = F.col("container0") + F.floor((F.col("rank") - F.col("first")) / F.col("each"))
    return placed.select("key", "part", "token_start", "n_tokens", F.concat(F.lit("bin-"), number.cast("string")).alias("container")).unionByName(whole)


def fill_report(rows: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: containers, tokens, the least possible number of containers, and the share of
    their space that is used."""
    return rows.groupBy("container").agg(F.sum("n_tokens").alias("n")).agg(
        F.count(F.lit(1)).alias("containers"), F.sum("n").alias("tokens"), F.max("n").alias("fullest"), F.ceil(F.sum("n") / capacity).alias("least_possible"),
        F.round(F.sum("n") / (F.count(F.lit(1)) * capacity), 6).alias("used_share"),
    )
