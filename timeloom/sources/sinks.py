"""Text forms of relations, made of integer microseconds so that no digit depends on floating point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeloom.functions import text as X
from timeloom.operators.assets import numbered


def rttm_line(clip: Column, t0: Column, t1: Column, speaker: Column, decimals: int = 3) -> Column:
    show = X.thousandths if decimals == 3 else X.hundredths
    return F.concat(F.lit("SPEAKER "), clip, F.lit(" 1 "), show(t0), F.lit(" "), show(t1 - t0), F.lit(" <NA> <NA> "), speaker, F.lit(" <NA> <NA>"))


def write_rttm(segments: DataFrame, path: str, decimals: int = 3) -> None:
    """A folder of lines for each clip, in the order of time."""
    line = rttm_line(F.col("clip"), F.col("t0"), F.col("t1"), F.col("speaker"), decimals).alias("value")
    rows = segments.repartition("clip").sortWithinPartitions("clip", "t0", "speaker").select("clip", line)
    rows.write.partitionBy("clip").text(path)


def transcript_lines(rows: DataFrame) -> DataFrame:
    """``[start - end] speaker: text`` of each entry."""
    line = F.concat(F.lit("["), X.hundredths(F.col("t0")), F.lit(" - "), X.hundredths(F.col("t1")), F.lit("] "), F.col("speaker"), F.lit(": "), F.col("text"))
    return rows.withColumn("line", line)


def srt_blocks(rows: DataFrame, keys: list[str], until: int | None = None) -> DataFrame:
    """Numbered SRT blocks by key; with ``until`` captions are cut there and milliseconds rounded."""
    if until is not None:
        rows = rows.where(F.col("t0") < until).withColumn("t1", F.least("t1", F.lit(until).cast("bigint")))
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("t0", "t1", "speaker", "text"))
    time = lambda c: X.timecode(F.col(c), rounded=until is not None)
    return rows.withColumn("n", n).withColumn("block", F.concat(F.col("n").cast("string"), F.lit("\n"), time("t0"), F.lit(" --> "), time("t1"), F.lit("\n"), F.col("speaker"), F.lit(": "), F.col("text"), F.lit("\n")))


def manifest_line(tag: Column, rel: Column, frames: Column, ids: Column) -> Column:
    return F.concat_ws(",", tag, rel, frames.cast("string"), F.array_join(ids.cast("array<string>"), " "))


def fail_line(rel: Column, reason: Column, detail: Column) -> Column:
    """A row of the failure log; commas in the detail become semicolons."""
    return F.concat_ws(",", rel, reason, F.replace(detail, F.lit(","), F.lit(";")))


def chunked(df: DataFrame, order: list[str], size: int, name: str = "chunk") -> DataFrame:
    """``df`` with the number (from 0) of each row's chunk of ``size`` rows in the given order; rows are numbered by ranges."""
    return numbered(df, order, "__i").withColumn(name, F.floor((F.col("__i") - 1) / size)).drop("__i")


def to_json_array(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """``keys, value``: a key's rows, in order, as one JSON array of objects; null values are left out of an object.

    For files that are small by nature, such as a clip's segments: a key's rows stand in one value.
    """
    held = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("at"), F.struct(*columns).alias("row")))).alias("x"))
    return held.select(*keys, F.to_json(F.transform("x", lambda x: x["row"])).alias("value"))


def write_json_arrays(df: DataFrame, path: str, keys: list[str], order: list[str], columns: list[str]) -> None:
    """The arrays of :func:`to_json_array` as files, a folder for each key."""
    to_json_array(df, keys, order, columns).write.partitionBy(*keys).text(path)


def to_json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def project_json(segments: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, value``: an annotation project as JSON, with bounds in seconds and the speaker of each segment by its number.

    It holds a clip's segments in one row.
    """
    entry = F.struct("t0", "t1", "speaker")
    seconds = lambda c: (c / 1_000_000).cast("double")
    one = lambda x, i: F.struct(i.cast("string").alias("key"), F.struct(F.lit("1").alias("vid"), F.array(seconds(x["t0"]), seconds(x["t1"])).alias("z"), F.create_map(F.lit("1"), x["speaker"]).alias("av")).alias("value"))
    rows = segments.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("s"))
    return rows.select(*keys, F.to_json(F.struct(F.map_from_entries(F.transform("s", one)).alias("metadata"))).alias("value"))


def write_split(segments: DataFrame, path: str) -> None:
    """On-screen and off-screen segments as sibling folders of RTTM lines."""
    line = rttm_line(F.col("clip"), F.col("t0"), F.col("t1"), F.col("speaker")).alias("value")
    kind = F.when(F.col("on_screen"), "on").otherwise("off").alias("screen")
    segments.repartition("clip").sortWithinPartitions("clip", "t0", "speaker").select(kind, line).write.partitionBy("screen").text(path)


def with_header(rows: DataFrame, meta: dict[str, str]) -> DataFrame:
    """``part, value``: a header object ``_meta`` (part 0), then a JSON line for each row (part 1)."""
    head = rows.sparkSession.createDataFrame([(0, dict(meta))], "part int, _meta map<string,string>").select("part", F.to_json(F.struct("_meta")).alias("value"))
    return head.unionByName(to_json_lines(rows).select(F.lit(1).alias("part"), "value"))


def append_results(rows: DataFrame, path: str, key: str) -> None:
    """Append the rows whose key the folder does not hold yet, as JSON lines; Spark commits all of them or none."""
    spark = rows.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    if there:
        kind = rows.schema[key].dataType.simpleString()
        rows = rows.join(spark.read.schema(f"`{key}` {kind}").json(path), key, "left_anti")
    rows.write.mode("append").json(path)


def run_summary(values: DataFrame, meta: dict[str, str]) -> DataFrame:
    """``value``: one row of aggregates and what the run was made with, as JSON."""
    fixed = [F.lit(v).alias(k) for k, v in sorted(meta.items())]
    return values.select(F.to_json(F.struct(F.struct(*fixed).alias("run"), F.struct(*values.columns).alias("summary"))).alias("value"))


def regression_debug(rows: DataFrame, tracks: DataFrame, key: str, least_delta: float, most_clip: float, preview: int = 1200) -> DataFrame:
    """``key, delta, rows, tracks, repeated, clip_preview, pipe_preview`` of samples that got much worse in the pipeline.

    ``tracks`` holds a row (key, track) for each attributed segment; ``tracks`` of the result counts them by track and ``repeated``
    says that some track has several, so that its text may come twice.
    """
    bad = rows.where((F.col("clip_wer") <= most_clip) & (F.col("pipe_wer") - F.col("clip_wer") >= least_delta))
    each = tracks.groupBy(key, "track").agg(F.count("*").alias("n"))
    counts = each.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("track", "n"))), lambda x: F.concat_ws(":", x["track"].cast("string"), x["n"].cast("string"))), ",").alias("tracks"), F.sum("n").alias("rows"), (F.max("n") > 1).alias("repeated"))  # a clip's tracks
    out = bad.join(counts, key, "left")
    show = lambda c: F.substring(F.coalesce(F.col(c), F.lit("")), 1, preview)
    return out.select(key, F.round(F.col("pipe_wer") - F.col("clip_wer"), 6).alias("delta"), F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("tracks", F.lit("")).alias("tracks"), F.coalesce("repeated", F.lit(False)).alias("repeated"), show("clip_text").alias("clip_preview"), show("pipe_text").alias("pipe_preview"))


def joined_text(rows: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """``keys, value``: a key's texts in order, one a line."""
    held = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(text), F.lit("")).alias("t")))).alias("x"))
    return held.select(*keys, F.array_join(F.transform("x", lambda x: x["t"]), "\n").alias("value"))
