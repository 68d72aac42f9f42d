"""Training manifests from clips, transcripts and listings of files, in one pass that counts what it skips.

Every clip gets the first reason that holds against it, in a fixed order; the others become manifest rows.  The counts are observed
while the rows are written, and rows, keys and counts of a run are committed together (:class:`timeloom.sources.runs.RunLog`), so a
killed run leaves nothing behind and the next one repeats nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from timeloom.functions import text as X
from timeloom.sources import sinks
from timeloom.sources.runs import RunLog

from .assets import first_failure

#: Reasons in the order in which they are asked.
REASONS = ("already", "missing_transcript", "empty_text", "empty_ids", "missing_wav", "missing_avi", "missing_frames", "landmarks")
SCHEMA = "key string, split string, line string"


@dataclass(frozen=True)
class Rules:
    """Tag of the rows; share of validation rows and its seed; extension of video paths (``auto``: that of ``frame_ext`` if local, or ``.avi``
    if listed); whether clips without a frame count are skipped or get 0; whether landmarks are asked for."""

    tag: str = "set"
    validation: float = 0.01
    seed: int = 42
    video_ext: str = "auto"
    frame_ext: str = ".avi"
    need_frames: bool = True
    landmarks: bool = False


def with_suffix(path: Column, suffix: str) -> Column:
    """``path`` with slashes, and with another extension; a name without an extension, or one that is all extension, gets it."""
    clean = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.concat(F.regexp_replace(clean, r"(?<=[^/])\.[^./]*$", ""), F.lit(suffix))


def resolved(media: DataFrame, listing: DataFrame, places: Sequence[tuple[str, str]], suffixes: Sequence[str], key: str = "key", path: str = "path") -> DataFrame:
    """``media`` with ``place`` and ``found``: the first file that is there, by place, then by extension.

    ``listing`` has ``place, path``; ``places`` are names of places and the prefix that paths have there, in the order in which they are tried.  A path is
    tried with each of ``suffixes`` (``""``: as it is).  Media without a file anywhere have nulls; so has a null path.  Equal to a
    loop over places and suffixes, as one join on the paths that could be there; repeated rows of the listing change nothing.
    """
    tries = [(i * len(suffixes) + j, name, prefix, suffix) for i, (name, prefix) in enumerate(places) for j, suffix in enumerate(suffixes)]
    own = F.replace(F.col(path), F.lit("\\"), F.lit("/"))
    target = lambda prefix, suffix: F.concat(F.lit(prefix), with_suffix(F.col(path), suffix) if suffix else own)
    options = F.array(*(F.struct(F.lit(n).alias("rank"), F.lit(name).alias("place"), target(prefix, suffix).alias("found")) for n, name, prefix, suffix in tries))
    each = media.select(F.col(key).alias("__key"), F.explode(options).alias("o")).select("__key", "o.*")
    there = listing.select("place", F.col("path").alias("found")).distinct()
    best = each.join(there, ["place", "found"]).groupBy("__key").agg(F.min(F.struct("rank", "place", "found")).alias("b"))
    best = best.select("__key", "b.place", "b.found")
    return media.join(best, media[key].eqNullSafe(best["__key"]), "left").drop("__key")


def rated(clips: DataFrame, transcripts: DataFrame, listing: DataFrame, frames: DataFrame, done: DataFrame, encode: Callable[[Column], Column], rules: Rules = Rules(), landmarks: DataFrame | None = None) -> DataFrame:
    """``key, reason, split, line`` of every clip (``shard, stem``): why it is skipped, or ``ok``.

    ``transcripts`` are ``shard, stem, text``, ``listing`` ``shard, path`` of the files in a shard (``stem/stem.ext``), ``frames``
    ``shard, stem, frames``, ``done`` the ``key`` (``stem/stem.mp4``) of rows made before, ``landmarks`` ``shard, stem, good``; ``encode`` makes ids of a text.  Where several
    shards hold a stem, the first whose clip passes is taken and those after it are ``already`` there.  Clips without shard or stem are left out; of
    repeated transcripts, counts and landmarks of a clip the smallest text, the largest count and any good ones are taken.
    """
    on = ["shard", "stem"]
    one = lambda df, *aggregates: df.groupBy(*on).agg(*aggregates)
    rows = clips.dropna(subset=on).select(*on).distinct()
    rows = rows.join(one(transcripts, F.min("text").alias("text"), F.lit(True).alias("told")), on, "left")
    name = F.regexp_extract(F.col("path"), r"^([^/]+)/[^/]*$", 1)
    files = listing.select("shard", name.alias("stem"), F.substring(F.col("path"), 2 * F.length(name) + 2, F.length("path")).alias("ext"), "path")
    files = files.where(F.col("path") == F.concat(name, F.lit("/"), name, F.col("ext")))
    has = lambda ext: F.max(F.col("ext") == ext)
    rows = rows.join(one(files, has(".wav").alias("wav"), has(".avi").alias("avi"), has(rules.frame_ext).alias("local")), on, "left")
    rows = rows.join(one(frames, F.max("frames").alias("frames")), on, "left")
    if landmarks is not None:
        rows = rows.join(one(landmarks, F.max("good").alias("good")), on, "left")
    rows = rows.withColumn("key", F.concat("stem", F.lit("/"), "stem", F.lit(".mp4")))
    rows = rows.join(done.select("key").distinct().withColumn("seen", F.lit(True)), "key", "left")
    rows = rows.withColumn("ids", encode(F.coalesce("text", F.lit(""))))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    checks = {
        "already": F.col("seen").isNull(), "missing_transcript": yes("told"), "empty_text": F.coalesce("text", F.lit("")) != "", "empty_ids": F.size("ids") > 0, "missing_wav": yes("wav"), "missing_avi": yes("avi"),
        "missing_frames": (F.coalesce("frames", F.lit(0)) > 0) if rules.need_frames else F.lit(True), "landmarks": yes("good") if rules.landmarks and landmarks is not None else F.lit(not rules.landmarks),
    }
    reason = first_failure([(r, checks[r]) for r in REASONS])
    before = Window.partitionBy("key").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a stem's few shards
    rows = rows.withColumn("reason", reason)
    rows = rows.withColumn("reason", F.when(F.max(F.col("reason") == "ok").over(before), "already").otherwise(F.col("reason")))
    ext = F.lit(rules.video_ext) if rules.video_ext != "auto" else F.when(yes("local"), rules.frame_ext).when(yes("avi"), ".avi").otherwise(rules.frame_ext)
    path = F.concat("stem", F.lit("/"), "stem", ext)
    line = sinks.manifest_line(F.concat(F.lit(f"{rules.tag}_"), "shard"), path, F.greatest(F.coalesce("frames", F.lit(0)), F.lit(0)), F.col("ids"))
    split = F.when(X.in_share(F.col("key"), rules.validation, rules.seed) if rules.validation > 0 else F.lit(False), "val").otherwise("train")
    return rows.select("key", "reason", split.alias("split"), line.alias("line"))


def log(spark, folder: str) -> RunLog:
    """The runs of a manifest folder."""
    return RunLog(spark, folder, SCHEMA)


def build(folder: str, clips: DataFrame, transcripts: DataFrame, listing: DataFrame, frames: DataFrame, encode: Callable[[Column], Column], rules: Rules = Rules(), landmarks: DataFrame | None = None, fresh: bool = False) -> dict[str, int]:
    """Add the clips that the folder's committed runs do not hold; the run's counters: every reason, ``train`` and ``val``.

    Rows, keys and counters are committed by one marker.  ``fresh`` deletes earlier runs first.
    """
    runs = log(clips.sparkSession, folder)
    if fresh:
        runs.clear()
    found = Observation(f"manifest-{uuid.uuid4().hex}")
    rows = rated(clips, transcripts, listing, frames, runs.read(), encode, rules, landmarks)
    is_ = lambda r: F.coalesce(F.count_if(F.col("reason") == r), F.lit(0))
    new = lambda s: F.coalesce(F.count_if((F.col("reason") == "ok") & (F.col("split") == s)), F.lit(0))
    rows = rows.observe(found, *(is_(r).alias(r) for r in REASONS), *(new(s).alias(s) for s in ("train", "val")))
    run = runs.append(rows.where("reason = 'ok'").select("key", "split", "line"), lambda: {k: int(v) for k, v in found.get.items()})
    return runs.counters(run)


def export(folder: str, to: str, spark) -> None:
    """Write the committed rows as text, a folder for each split (``split=train``, ``split=val``)."""
    log(spark, folder).read().select("split", F.col("line").alias("value")).write.mode("overwrite").partitionBy("split").text(to)
