"""Reproducible shuffle into shards by a Feistel permutation of global row numbers.

Rows are numbered 0 to N-1 without gaps, the number is sent through a keyed permutation of
0 to N-1, and the result gives shard (remainder by the number of shards) and slot (quotient).
Shards thus hold row counts at most one apart, and where a row goes can be computed, or
undone, from its number alone.

The permutation works on pairs (left, right) from a grid of a x b >= N positions: each round
adds a keyed hash of one half to the other, modulo its side. Positions of N or more are sent
through again (cycle walking) until they fall below N; fewer than a positions exceed N.

Row numbers. A row's order is the MD5 of (doc_id, size, CRC-32 of the text), then those
values: a fixed order that does not depend on files or partitions. The leading hash bits
deal the rows into even buckets; counts of the buckets are summed up before, and rows
numbered within, so no task sees more than a bucket. Equal texts with different ids fall
into different buckets. Only whole repeated rows share one; they are interchangeable, and
get consecutive numbers.

Defined results. A null text has size 8 and CRC 0. A null doc_id is a value like any other.
An empty table gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from termforge.llm.common import materialize

ROUNDS = 6
KEY = "termforge"
#: Rows aimed at in a bucket of the numbering, and the most buckets there are.
BUCKET_ROWS, MAX_BITS = 20_000, 20
WALK = 64


def permutation_sides(n: int) -> tuple[int, int]:
    """The grid a x b that holds n positions: a the least with a * a >= n, b the least with a * b >= n."""
    a = max(1, int(n**0.5))
    while a * a < n:
        a += 1
    while a > 1 and (a - 1) * (a - 1) >= n:
        a -= 1
    return a, max(1, -(-n // a))


def _round_hash(half: Column, key: str, round_no: int, side: int) -> Column:
    text = F.concat(F.lit(f"{key}:{round_no}:"), half.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long") % F.lit(side)


def _permute_once(pos: Column, n: int, key: str, rounds: int) -> Column:
    a, b = permutation_sides(n)
    pair = F.struct((pos % a).alias("l"), F.floor(pos / a).cast("long").alias("r"))

    def turn(i: int):
        def left(p: Column) -> Column:
            moved = (p["l"] + _round_hash(p["r"], key, i, a)) % a
            return F.struct(moved.alias("l"), p["r"].alias("r"))

        def right(p: Column) -> Column:
            moved = (p["r"] + _round_hash(p["l"], key, i, b)) % b
            return F.struct(p["l"].alias("l"), moved.alias("r"))

        return right if i % 2 else left

    # transform() over a one-element array binds a round's halves to a name, so that the
    # expression grows in proportion to the rounds.
    for i in range(rounds):
        pair = F.transform(F.array(pair), turn(i))[0]
    return F.transform(F.array(pair), lambda p: p["l"] + p["r"] * F.lit(a).cast("long"))[0]


def feistel(pos: Column, n: int, key: str = KEY, rounds: int = ROUNDS) -> Column:
    """The place of position pos (0 to n-1) in a keyed permutation of 0 to n-1.

    Walks on while the place is n or more: at most a*b-n+1 steps, which small n take in full;
    for large n a walk of over WALK steps has a chance below (1/60)^64, and raises an error.
    """
    a, b = permutation_sides(n)
    once = _permute_once(pos, n, key, rounds)
    if a * b == n:
        return once
    steps = min(a * b - n + 1, WALK)
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)),
        once,
        lambda x, _: F.when(x < n, x).otherwise(_permute_once(x, n, key, rounds)),
    )
    return F.transform(F.array(walked), lambda x: F.when(x < n, x).otherwise(F.raise_error(F.lit("feistel: cycle too long")).cast("long")))[0]


def row_numbers(rows: DataFrame, order: Column, n: int) -> DataFrame:
    """rows (materialised, n of them) with __row, 0 to n-1 in the order of (order, all columns); order: MD5 hex."""
    bits = min(MAX_BITS, max(0, (n // BUCKET_ROWS).bit_length()))
    bucket = F.shiftright(F.conv(F.substring(order, 1, 8), 16, 10).cast("long"), 32 - bits)
    keyed = rows.withColumn("__order", order).withColumn("__bucket", bucket)
    # At most 2^MAX_BITS buckets, so their running count fits one task and one broadcast.
    before = (
        keyed.groupBy("__bucket")
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__before", F.sum("__n").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)))
        .select(F.col("__bucket").alias("__b"), F.coalesce("__before", F.lit(0)).alias("__before"))
    )
    within = Window.partitionBy("__bucket").orderBy("__order", *rows.columns)
    numbered = keyed.withColumn("__within", F.row_number().over(within).cast("long"))
    return (
        numbered.join(F.broadcast(before), numbered["__bucket"] == before["__b"])
        .withColumn("__row", F.col("__before") + F.col("__within") - 1)
        .select(*rows.columns, "__row")
    )


def shard_documents(docs: DataFrame, n_shards: int = 24, key: str = KEY) -> DataFrame:
    """doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null) of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
        ),
        "shard-rows",
    )
    n = slim.count()
    order = F.md5(F.concat_ws(":", F.lit(key), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "size", "text_crc32"))
    placed = row_numbers(slim, order, n).withColumn("__place", feistel(F.col("__row"), n, key))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("__place") % n_shards).cast("int").alias("shard"),
        F.floor(F.col("__place") / n_shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
