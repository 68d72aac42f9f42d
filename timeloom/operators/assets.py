"""Bookkeeping of dataset files: manifests, shards, checks of what a sample needs before it is used."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeloom.storage import materialise


def numbered(df: DataFrame, order: Sequence[Column | str], name: str = "n") -> DataFrame:
    """``df`` with the number (from 1) of each row in the order of ``order``.

    Rows are dealt out by ranges and counted by range, so no task sees more than its range; only one number
    a range is summed up in one place.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()).sortWithinPartitions("__part", *order)
    ranged = materialise(ranged.withColumn("__at", F.monotonically_increasing_id()), "ranged")
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__size"), F.min("__at").alias("__low"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__part", "__low", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"))  # a row a range
    number = F.col("__at") - F.col("__low") + F.col("__before") + 1
    return ranged.join(F.broadcast(sizes), "__part").withColumn(name, number).drop("__part", "__at", "__size", "__low", "__before")


def tag_parts(tag: Column) -> tuple[Column, Column]:
    """Base and two-digit shard of a tag such as ``train_07``; a tag without a shard is its own base."""
    shard = F.regexp_extract(tag, r"^.+?_(\d{2})$", 1)
    return F.when(shard != "", F.left(tag, F.length(tag) - 3)).otherwise(tag), F.when(shard != "", shard)


def repository(tag: Column, rules: Sequence[tuple[str, str]], fallback: str) -> Column:
    """The repository of the first rule whose prefix the tag starts with."""
    found = F.lit(fallback)
    for prefix, name in reversed(rules):
        found = F.when(F.startswith(tag, F.lit(prefix)), name).otherwise(found)
    return found


def paired(files: DataFrame, first: str, second: str) -> DataFrame:
    """``stem`` of the files (``stem, ext``) that stand there with both extensions."""
    kinds = files.where(F.col("ext").isin(first, second)).groupBy("stem").agg(F.count_distinct("ext").alias("n"))
    return kinds.where("n = 2").select("stem")


def in_shards(stems: DataFrame, listing: DataFrame) -> DataFrame:
    """``stem, shard`` by a listing of the same columns; the smallest shard of several, null where none lists the stem."""
    known = listing.groupBy("stem").agg(F.min("shard").alias("shard"))
    return stems.select("stem").join(known, "stem", "left")


def usable(values: Column) -> Column:
    """Whether some value of an array is a finite number other than 0; not of a null or empty one."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) > 0) & (F.abs(x) < float("inf"))
    return F.coalesce(F.exists(values, finite), F.lit(False))


def array_problems(found: Column, required: Sequence[str]) -> dict[str, Column]:
    """What is wrong with named arrays (a map): missing and extra names, whether lengths are equal and values finite."""
    names, wanted = F.map_keys(found), F.array(*(F.lit(x) for x in sorted(required)))
    values = F.map_values(found)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return {
        "missing": F.array_join(F.array_except(wanted, names), ","),
        "extra": F.array_join(F.array_sort(F.array_except(names, wanted)), ","),
        "equal_lengths": F.size(F.array_distinct(F.transform(values, F.size))) <= 1,
        "finite": F.forall(values, lambda v: F.forall(v, finite)),
    }


def first_failure(checks: Sequence[tuple[str, Column]], good: str = "ok") -> Column:
    """The name of the first check whose condition does not hold (a null one does not)."""
    out = F.lit(good)
    for name, holds in reversed(checks):
        out = F.when(F.coalesce(holds, F.lit(False)), out).otherwise(F.lit(name))
    return out


def crop_checks(width: int, height: int, fps: float, tolerance: float = 0.5, drift: int = 2) -> list[tuple[str, Column]]:
    """The checks of a mouth crop in their order: it is there, has frames, their size, the rate, and as many as its source."""
    return [
        ("missing", F.col("there")),
        ("empty", F.col("frames") > 0),
        ("shape", (F.col("width") == width) & (F.col("height") == height)),
        ("fps", F.abs(F.col("fps") - fps) <= tolerance),
        ("drift", F.abs(F.col("frames") - F.col("source_frames")) <= drift),
    ]


def reason_counts(df: DataFrame, reason: str) -> DataFrame:
    """``reason, n`` and the place of each reason: the commonest first, then by name."""
    counts = df.groupBy(F.col(reason).alias("reason")).agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "reason")))  # a row a reason


def centre_and_size(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column, Column]:
    """Centre of a box and half of its longer side."""
    return (x1 + x2) / 2, (y1 + y2) / 2, F.greatest(x2 - x1, y2 - y1) / 2


def clamped_box(xs: Column, ys: Column, margin: Column, width: int, height: int) -> Column:
    """The box around points, widened by ``margin`` and kept inside the image: ``x1, y1, x2, y2`` as whole pixels."""
    low = lambda v: F.greatest(F.lit(0), F.floor(F.array_min(v) - margin).cast("int"))
    high = lambda v, most: F.least(F.lit(most), F.ceil(F.array_max(v) + margin).cast("int"))
    return F.struct(low(xs).alias("x1"), low(ys).alias("y1"), high(xs, width).alias("x2"), high(ys, height).alias("y2"))


def feature_index(t: Column, count: Column, rate: int = 5, lag: int = 5) -> Column:
    """The feature row for a time in microseconds: ``rate`` rows a second, ``lag`` rows behind, inside ``[0, count)``."""
    return F.least(F.greatest(F.floor(t * rate / 1_000_000) - lag, F.lit(0)), count - 1).cast("bigint")


def as_of(points: DataFrame, features: DataFrame, keys: Sequence[str], time: str, rate: int = 5, lag: int = 5) -> DataFrame:
    """``points`` with the feature row (``row, v``) of their time; a computed key, so an equi-join."""
    counts = features.groupBy(*keys).agg((F.max("row") + 1).alias("__count"))
    placed = points.join(counts, list(keys)).withColumn("row", feature_index(F.col(time), F.col("__count"), rate, lag)).drop("__count")
    return placed.join(features, [*keys, "row"])


def zipped(left: DataFrame, right: DataFrame, keys: Sequence[str], place: str, value: str, fallback: int = -1) -> DataFrame:
    """``left`` with the value of ``right`` at the same place (from 0) of its key; ``fallback`` beyond its end."""
    return left.join(right.select(*keys, place, value), [*keys, place], "left").withColumn(value, F.coalesce(value, F.lit(fallback)))


def accuracy(predicted: Column, target: Column, ignored: int) -> Column:
    """Share of labels that are right, of those whose target is not ``ignored``; null without any."""
    counts = target != ignored
    return F.sum(F.when(counts & (predicted == target), 1).otherwise(0)) / F.nullif(F.count_if(counts), F.lit(0))


def mismatch_rate(df: DataFrame, batch: str, order: str, mismatch: Column, batches: int = 5, rows: int = 5, warn: float = 0.3) -> DataFrame:
    """Share of mismatches among the first ``rows`` rows of the first ``batches`` batches, and whether it passes ``warn``.

    Looking at few rows is what the check is: it runs before training starts.
    """
    first = df.where(F.col(batch) < batches).withColumn("__n", F.row_number().over(Window.partitionBy(batch).orderBy(order))).where(F.col("__n") <= rows)
    rate = F.avg(mismatch.cast("int"))
    return first.agg(F.count("*").alias("checked"), F.round(rate, 6).alias("rate"), (rate > warn).alias("warning"))


def fingerprint(df: DataFrame, key: str, content: Column) -> DataFrame:
    """``key`` and the SHA-256 of a file's content."""
    return df.select(key, F.sha2(content, 256).alias("sha256"))


def manifest_fingerprint(lines: DataFrame, key: str, content: Column) -> DataFrame:
    """One digest for a whole manifest, whatever the order of its rows: their digests, summed modulo 2**64 in two halves."""
    half = lambda at: F.conv(F.substring(F.sha2(F.concat_ws("\t", F.col(key).cast("string"), content), 256), at, 15), 16, 10).cast("decimal(38,0)")
    return lines.agg(F.count("*").alias("rows"), *(F.pmod(F.sum(half(at)), F.lit(1 << 60).cast("decimal(38,0)")).cast("bigint").alias(c) for at, c in ((1, "low"), (16, "high"))))


def concatenated(parts: dict[str, DataFrame]) -> DataFrame:
    """Manifests one after another, each row with the name of its part."""
    return reduce(DataFrame.unionByName, (df.withColumn("part", F.lit(name)) for name, df in parts.items()))


def early_stop(df: DataFrame, keys: Sequence[str], step: str, score: str, patience: int) -> DataFrame:
    """``keys, stop``: the step at which no better (smaller) score was seen for ``patience`` steps in a row, else null; and the best score till then."""
    order = Window.partitionBy(*keys).orderBy(step)
    before = F.min(score).over(order.rowsBetween(Window.unboundedPreceding, -1))
    better = before.isNull() | (F.col(score) < before)
    at = df.withColumns({"__i": F.row_number().over(order), "__better": better})
    since = F.max(F.when(F.col("__better"), F.col("__i"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = at.withColumn("__waited", F.col("__i") - since)
    return marked.groupBy(*keys).agg(F.min(F.when(F.col("__waited") >= patience, F.col(step))).alias("stop"), F.min(score).alias("best"))


def replaced_uri(line: Column, uri: Column) -> Column:
    """An RTTM line with another file id; null for lines of fewer than eight fields or of another type."""
    f = F.split(F.trim(line), r"\s+")
    good = (F.size(f) >= 8) & (F.get(f, F.lit(0)) == "SPEAKER")
    return F.when(good, F.concat_ws(" ", F.get(f, F.lit(0)), uri, F.array_join(F.slice(f, F.lit(3), F.size(f)), " ")))


def isolated(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """All of ``work`` with what its stage gave: a failed or absent result leaves its row, with the reason and no output.

    ``done``: key, ``output``, ``error``.  Downstream an empty output is scored as such, instead of losing the clip.
    """
    held = work.join(done, key, "left")
    state = F.when(F.col("error").isNotNull() & F.col("output").isNotNull(), "salvaged").when(F.col("error").isNotNull(), "failed").when(F.col("output").isNull(), "empty").otherwise("ok")
    return held.withColumn("state", state).withColumn("output", F.coalesce("output", F.lit("")))


def suite(checks: dict[str, DataFrame]) -> DataFrame:
    """``check, failures, passed`` of relations that hold a row for each failure."""
    return reduce(DataFrame.unionByName, (df.agg(F.lit(name).alias("check"), F.count("*").alias("failures")) for name, df in checks.items())).withColumn("passed", F.col("failures") == 0)
