"""Text sources.  Malformed rows are dropped, never raised; filters stay next to the parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timeloom.functions import text as X
from timeloom.operators.assets import numbered

MICRO = 1_000_000
#: Schema of what is known about a fusion sample.
SAMPLE = "sample_id string, total_frames int, total_duration_s double, clips array<struct<tag:string,rel:string,frames:int,duration_s:double,ids:array<int>>>, _meta string"


def micros(seconds: Column) -> Column:
    """Seconds in text as whole microseconds, null if that is no number."""
    return (seconds.try_cast("decimal(38,9)") * MICRO).cast("bigint")


def name_of(path: Column) -> Column:
    """File name without folder and extension."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def lines(spark: SparkSession, path: str, numbered: bool = False) -> DataFrame:
    """``value, path`` of each line, with its number from 1 if ``numbered``."""
    if not numbered:
        return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"))
    whole = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    rows = whole.select("path", F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")).alias("at", "value"))
    return rows.select("value", "path", (F.col("at") + 1).alias("line"))


def parse_rttm(raw: DataFrame, min_fields: int = 8, positive: bool = True) -> DataFrame:
    """Segments of RTTM lines: ``file_id, speaker, t0, t1, raw, path``; rows without positive length only if wanted."""
    f = F.split(F.trim("value"), r"\s+")
    rows = raw.where(F.get(f, F.lit(0)) == "SPEAKER").where(F.size(f) >= min_fields)
    out = rows.select(F.get(f, F.lit(1)).alias("file_id"), F.get(f, F.lit(7)).alias("speaker"), micros(F.get(f, F.lit(3))).alias("t0"), micros(F.get(f, F.lit(4))).alias("dur"), F.col("value").alias("raw"), "path")
    out = out.where("t0 IS NOT NULL AND dur IS NOT NULL").withColumn("t1", F.col("t0") + F.col("dur"))
    return out.where("dur > 0").drop("dur") if positive else out.drop("dur")


def rttm(spark: SparkSession, path: str, min_fields: int = 8, positive: bool = True) -> DataFrame:
    return parse_rttm(lines(spark, path), min_fields, positive)


def annotation(segments: DataFrame, clips: DataFrame) -> DataFrame:
    """Segments by clip: those whose file id is the clip's, else those of the clip file's first other id.

    ``segments`` has the clip it was read for in ``clip``; clips without any keep no rows here.
    """
    ranked = segments.join(clips.select("clip").distinct(), "clip", "left_semi")
    best = ranked.groupBy("clip").agg(F.min_by("file_id", F.struct((F.col("file_id") != F.col("clip")).alias("other"), "file_id")).alias("file_id"))
    return ranked.join(best, ["clip", "file_id"], "left_semi")


def sightings(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """``speaker, t`` of headerless rows of at least nine columns whose ninth is clip suffix and speaker."""
    f = F.split("value", ",")
    rows = lines(spark, path).where(F.size(f) >= 9).select(micros(F.trim(F.get(f, F.lit(1)))).alias("t"), F.trim(F.get(f, F.lit(8))).alias("who"))
    rows = rows.where(F.rlike("who", F.lit(rf"^{suffix}spk\d+$")) & F.col("t").isNotNull())
    return rows.select(F.regexp_extract("who", r"(spk\d+)$", 1).alias("speaker"), "t")


def split_list(spark: SparkSession, path: str) -> DataFrame:
    """``clip`` of each line, without blanks around it; blank lines are left out."""
    return lines(spark, path).select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("clip")).where("clip <> ''")


def srt(spark: SparkSession, path: str) -> DataFrame:
    """Captions ``n, t0, t1, speaker, text`` of blank-line separated blocks; the speaker stands before the first colon."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.split(F.regexp_replace("value", r"\r", ""), r"\n\s*\n")).alias("block"))
    time = r"(\d+):(\d+):(\d+)[,.](\d{1,3})"
    g = lambda i: F.regexp_extract("block", rf"(?s){time}\s*-->\s*{time}\s*\n(.*)", i)
    us = lambda k: ((g(k).cast("bigint") * 60 + g(k + 1).cast("bigint")) * 60 + g(k + 2).cast("bigint")) * MICRO + F.rpad(g(k + 3), 3, "0").cast("bigint") * 1000
    rows = whole.where(F.rlike("block", F.lit(rf"{time}\s*-->\s*{time}"))).select(us(1).alias("t0"), us(5).alias("t1"), F.trim(F.regexp_replace(g(9), r"\s+", " ")).alias("body"))
    at = F.instr("body", ":")
    return rows.select("t0", "t1", F.when(at > 0, F.trim(F.expr("substring(body, 1, instr(body, ':') - 1)"))).otherwise("").alias("speaker"), F.trim(F.expr("substring(body, instr(body, ':') + 1)")).alias("text"))


def parse_manifest(raw: DataFrame, min_frames: int = 1, cap: int | None = None, drop_above: int | None = None) -> DataFrame:
    """``tag, rel, frames, ids`` of four-column rows, the last column unquoted; long clips are cut to ``cap`` or dropped."""
    f = F.split("value", ",", 4)
    ids = F.transform(F.filter(F.split(F.trim(F.get(f, F.lit(3))), r"\s+"), lambda x: x != ""), lambda x: x.try_cast("int"))
    rows = raw.where(F.size(f) == 4).select(*[c for c in raw.columns if c != "value"], F.trim(F.get(f, F.lit(0))).alias("tag"), F.replace(F.trim(F.get(f, F.lit(1))), F.lit("\\"), F.lit("/")).alias("rel"), F.trim(F.get(f, F.lit(2))).try_cast("int").alias("frames"), ids.alias("ids"))
    rows = rows.where((F.col("frames") >= min_frames) & F.forall("ids", lambda x: x.isNotNull()))
    if drop_above is not None:
        rows = rows.where(F.col("frames") <= drop_above)
    return rows.withColumn("frames", F.least("frames", F.lit(cap))) if cap is not None else rows


def manifest_paths(raw: DataFrame, least: int = 2) -> DataFrame:
    """``tag, rel`` of rows of at least ``least`` fields, whatever the others hold; separators are slashes."""
    f = F.split("value", ",")
    rows = raw.where((F.size(f) >= least) & (F.trim("value") != ""))
    return rows.select(*[c for c in raw.columns if c != "value"], F.trim(F.get(f, F.lit(0))).alias("tag"), F.replace(F.trim(F.get(f, F.lit(1))), F.lit("\\"), F.lit("/")).alias("rel"))


def numbered_manifest(raw: DataFrame) -> DataFrame:
    """``line, tag, rel, frames`` of numbered lines of at least three fields; frames that are no whole number are -1."""
    f = F.split("value", ",")
    frames = F.coalesce(F.trim(F.get(f, F.lit(2))).try_cast("int"), F.lit(-1))
    keep = [c for c in raw.columns if c != "value"]
    return raw.where(F.size(f) >= 3).select(*keep, F.trim(F.get(f, F.lit(0))).alias("tag"), F.replace(F.trim(F.get(f, F.lit(1))), F.lit("\\"), F.lit("/")).alias("rel"), frames.alias("frames"))


def manifest(spark: SparkSession, path: str, numbered: bool = False, **how) -> DataFrame:
    return parse_manifest(lines(spark, path, numbered), **how)


def id_sequences(rows: DataFrame, eos: int) -> DataFrame:
    """Rows' ids with an end id, which is put where it lacks; sequences of at least two."""
    ended = F.when(F.element_at("ids", -1) == eos, F.col("ids")).otherwise(F.array_append("ids", F.lit(eos)))
    return rows.where(F.size("ids") > 0).withColumn("ids", ended).where(F.size("ids") >= 2)


def transcript(spark: SparkSession, path: str) -> DataFrame:
    whole = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    return whole.select(name_of(F.col("path")).alias("stem"), X.transcript_line(F.col("value")).alias("text"))


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """``token, id``: the id stands after the last blank."""
    rows = lines(spark, path).where(F.rlike("value", F.lit(r"^.+\s+\d+$")))
    return rows.select(F.regexp_extract("value", r"^(.*\S)\s+(\d+)$", 1).alias("token"), F.regexp_extract("value", r"(\d+)$", 1).cast("int").alias("id"))


def unit_list(units: DataFrame) -> DataFrame:
    """All units by id: a blank before them and an end after them."""
    spark = units.sparkSession
    last = units.agg((F.max("id") + 1).alias("id")).select(F.lit("<eos>").alias("token"), "id")
    return spark.createDataFrame([("<blank>", 0)], "token string, id int").unionByName(units.select("token", "id")).unionByName(last)


def stems(spark: SparkSession, path: str) -> DataFrame:
    """``suffix, stem``; old lists have bare stems, whose suffix is unknown (``??``)."""
    f = F.split("value", "\t")
    rows = lines(spark, path).where(F.trim("value") != "")
    two = F.size(f) >= 2
    return rows.select(F.when(two, F.lpad(F.trim(F.get(f, F.lit(0))), 2, "0")).otherwise("??").alias("suffix"), F.trim(F.when(two, F.get(f, F.lit(1))).otherwise(F.get(f, F.lit(0)))).alias("stem"))


def samples(spark: SparkSession, path: str, schema: str = SAMPLE) -> DataFrame:
    """JSON lines without their header object."""
    rows = spark.read.schema(schema).json(path)
    return rows.where("_meta IS NULL").drop("_meta")


def segment_tracks(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("track_idx int, start double, end double, speaker string").json(path, multiLine=True)
    us = lambda c: F.round(F.col(c) * MICRO).cast("bigint")
    return rows.select("track_idx", us("start").alias("t0"), us("end").alias("t1"), "speaker")


def done_keys(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark, path).select(F.trim("value").alias("key")).where("key <> ''").distinct()


def not_done(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return work.join(done.select(F.col("key").alias(key)), key, "left_anti")


def files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """``path, stem`` of the files below a folder, contents unread."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path")
    return found.withColumn("stem", name_of(F.col("path")))


def preferred(found: DataFrame, extensions: list[str]) -> DataFrame:
    """One file a stem: by the order of extensions, then by path."""
    rank = F.array_position(F.array(*(F.lit(e) for e in extensions)), F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)))
    ranked = found.withColumn("__r", F.when(rank > 0, rank).otherwise(len(extensions) + 1))
    return ranked.groupBy("stem").agg(F.min_by("path", F.struct("__r", "path")).alias("path"))


def pcm_frames(audio: DataFrame, rate: int, milliseconds: int) -> DataFrame:
    """Offsets of whole frames of 16-bit audio (``key, content``); a frame that ends at the last byte is left out."""
    size = rate * milliseconds // 1000 * 2
    n = F.ceil(F.octet_length("content") / size).cast("int") - 1
    rows = audio.select("key", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1))).alias("frame"), "content")
    return rows.select("key", "frame", (F.col("frame") * milliseconds * 1000).cast("bigint").alias("t0"), F.expr(f"substring(content, frame * {size} + 1, {size})").alias("bytes"))


def every_nth(rows: DataFrame, order: str, n: int, last: int | None = None) -> DataFrame:
    """Every ``n``-th row, or of those the last ones; rows are numbered by ranges."""
    kept = numbered(rows, [order], "__i").where((F.col("__i") - 1) % n == 0).drop("__i")
    return kept.orderBy(F.desc(order)).limit(last) if last is not None else kept
