"""Samples, batches and shards of training rows."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .assets import numbered


def by_size(df: DataFrame, shard: Sequence[str], key: str, size: str, max_tokens: int, max_rows: int, multiple: int = 1) -> DataFrame:
    """Batches of rows in descending size order: a batch ends before (rows + 1) * largest size passes ``max_tokens``,
    or at ``max_rows``; a batch that is cut short gives rows back until its count is a multiple.

    Adds ``batch`` (from 0) in each shard; the walk is sequential, so a shard is one task.  Rows without a size are left out.
    """
    schema = df.select(*shard, key, size).withColumn("batch", F.lit(0)).schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([size, key], ascending=[False, True])
        numbers, held, number, top = [], 0, 0, 0
        for s in pdf[size].tolist():
            longest = max(top, s)
            if held and ((held + 1) * longest > max_tokens or held >= max_rows):
                stay = held - held % multiple if held > multiple else held
                over = held - stay
                for i in range(1, over + 1):
                    numbers[-i] = number + 1
                number, held = number + 1, over
                top = max([s, *pdf[size].iloc[len(numbers) - over : len(numbers)].tolist()])
            else:
                top = longest
            numbers.append(number)
            held += 1
        return pdf.assign(batch=pd.Series(numbers, index=pdf.index, dtype="int32"))[[f.name for f in schema.fields]]

    return df.where(F.col(size).isNotNull()).select(*shard, key, size).groupBy(*shard).applyInPandas(run, schema)


def keyed_order(size: Column, key: Column, seed: int, epoch: int) -> list[Column]:
    """Longest first, rows of one size in an order that changes with seed and epoch."""
    return [size.desc(), F.xxhash64(F.lit(seed), F.lit(epoch), key)]


def replica(order: Sequence[Column], total: int) -> Column:
    """The replica that gets a row: in turn."""
    return F.pmod(F.row_number().over(Window.orderBy(*order)) - 1, F.lit(total))


def sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows without replacement, the same for the same seed."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def tuples(df: DataFrame, key: str, size: str, n: int, k: int, most: int, seed: int, tries: int = 8) -> DataFrame:
    """Up to ``n`` tuples of ``k`` distinct rows whose sizes sum to at most ``most``: ``tuple, members, total``.

    Candidates are drawn by hashes of (seed, draw, place); rows are numbered once, by ranges, so a draw is a join on the number.
    """
    rows = df.select(F.col(key).alias("member"), F.col(size).alias("size"))
    rows = numbered(rows, ["member"], "number").withColumn("number", F.col("number") - 1)
    total = rows.count()
    draws = df.sparkSession.range(n * tries).withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    draws = draws.withColumn("number", F.pmod(F.xxhash64(F.lit(seed), "id", "place"), F.lit(max(1, total))).cast("int"))
    made = draws.join(rows, "number").groupBy("id").agg(F.array_sort(F.collect_set("member")).alias("members"), F.sum("size").alias("total"), F.count("*").alias("n"))
    good = made.where((F.size("members") == k) & (F.col("n") == k) & (F.col("total") <= most)).select("id", "members", "total")
    order = Window.orderBy("id")  # at most n * tries tuples
    return good.withColumn("tuple", F.format_string("fs_%03d", F.row_number().over(order) - 1)).orderBy("id").limit(n).select("tuple", "members", "total")


def padded(df: DataFrame, batch: Sequence[str], values: str) -> DataFrame:
    """Arrays padded to the longest of their batch, with their lengths; rows without an array are dropped."""
    rows = df.where(F.col(values).isNotNull()).withColumn("length", F.size(values))
    longest = F.max("length").over(Window.partitionBy(*batch))
    filled = F.slice(F.concat(values, F.transform(F.sequence(F.lit(1), longest), lambda _: F.lit(0).cast("bigint"))), F.lit(1), longest)
    return rows.withColumn("padded", F.when(longest > 0, filled).otherwise(F.col(values)))


def offsets(df: DataFrame, keys: Sequence[str], order: str, frames: str, seam: int) -> DataFrame:
    """Where each clip begins when clips are put one after another with ``seam`` frames in between."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("offset", F.coalesce(F.sum(F.col(frames) + seam).over(before), F.lit(0).cast("bigint")))


def by_shapes(df: DataFrame, shard: Sequence[str], key: str, size: str, shapes: Sequence[tuple[int, int]]) -> DataFrame:
    """Batches of fixed shapes ``(rows, longest)``: each row goes to the first shape that is long enough, which is filled in key order.

    Adds ``shape`` (its number) and ``batch`` (from 0 within shard and shape); rows longer than every shape, or without a size, are left out.
    """
    fits = F.lit(None).cast("int")
    for i, (_, longest) in reversed(list(enumerate(shapes))):
        fits = F.when(F.col(size) <= longest, F.lit(i)).otherwise(fits)
    rows = F.get(F.array(*(F.lit(n) for n, _ in shapes)), F.col("shape"))
    number = F.row_number().over(Window.partitionBy(*shard, "shape").orderBy(key)) - 1
    return df.withColumn("shape", fits).where("shape IS NOT NULL").withColumn("batch", F.floor(number / rows).cast("int"))


def dealt_batches(batches: DataFrame, batch: str, replicas: int, seed: int, epoch: int) -> DataFrame:
    """``batches`` (a row each) with the ``replica`` that gets one and its ``turn`` there, in an order that changes with seed and epoch."""
    order = numbered(batches, [F.xxhash64(F.col(batch), F.lit(seed), F.lit(epoch)), F.col(batch)], "__n")
    return order.withColumns({"replica": ((F.col("__n") - 1) % replicas).cast("int"), "turn": F.floor((F.col("__n") - 1) / replicas)}).drop("__n")


def stitched(df: DataFrame, keys: Sequence[str], order: str, rows: str, seam: int, total: Column, width: int) -> DataFrame:
    """``keys, rows``: the feature rows of a key's clips one after another with ``seam`` rows of zeros between, cut or padded to ``total`` rows."""
    zeros = F.array_repeat(F.array_repeat(F.lit(0.0), width), seam)
    held = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(rows).alias("r")))).alias("x"), F.max(total).cast("int").alias("n"))
    parts = F.flatten(F.transform("x", lambda x, i: F.when(i > 0, F.concat(zeros, x["r"])).otherwise(x["r"])))
    whole = held.select(*keys, "n", parts.alias("p"))
    pad = F.array_repeat(F.array_repeat(F.lit(0.0), width), F.greatest(F.lit(0), F.col("n") - F.size("p")))
    return whole.select(*keys, F.concat(F.slice("p", F.lit(1), F.col("n")), pad).alias(rows))
