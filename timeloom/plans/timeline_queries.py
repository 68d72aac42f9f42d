"""Queries of the interval algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timeloom.operators import frames, intervals

from . import projections as P
from .registry import registry

QUERIES, SQL, query = registry()
WIDTH = 600 * P.SECOND
GAP = 2 * P.HOUR


@query(f"WITH {P.REFERENCE} SELECT clip, speaker, t0, t1, event_id FROM ref WHERE t1 > t0 AND lower(speaker) NOT IN ('error')")
def segments_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of positive length, without some speakers (in any case)."""
    return P.reference(spark, sf_dir).where("t1 > t0").where(~F.lower("speaker").isin("error"))


@query(f"WITH {P.REFERENCE}, {P.merged('ref', 'm', 'clip, speaker')} SELECT * FROM m")
def merge_same_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.merge(P.reference(spark, sf_dir), ["clip", "speaker"], count=True)


@query(f"WITH {P.REFERENCE}, {P.merged('ref', 'm', 'clip')} SELECT clip, t0, t1 FROM m")
def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.merge(P.reference(spark, sf_dir), ["clip"])


@query(f"WITH {P.REFERENCE}, padded AS (SELECT clip, greatest(0, t0 - 250000) AS t0, t1 + 250000 AS t1 FROM ref), {P.merged('padded', 'm', 'clip')} SELECT clip, t0, t1 FROM m")
def uem_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is scored of each clip: reference speech widened by a quarter of a second."""
    return intervals.merge(intervals.pad(P.reference(spark, sf_dir), 250_000), ["clip"])


@query("""WITH e AS (SELECT user_id, epoch_us(ts) AS t, event_id FROM events), m AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 7200000000 THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT user_id, min(t) AS t0, max(t) AS t1, count(*) AS n FROM g GROUP BY user_id, g""")
def point_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sightings of a user at most two hours apart."""
    return intervals.islands(P.events(spark, sf_dir), ["user_id"], "t", GAP, ["event_id"])


@query(f"WITH {P.REFERENCE} SELECT clip, min(t0) AS t0, max(t1) AS t1, greatest(0, max(t1) - min(t0)) AS dur FROM ref GROUP BY clip")
def clip_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.reference(spark, sf_dir).groupBy("clip").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"))
    return out.withColumn("dur", F.greatest(F.lit(0).cast("bigint"), F.col("t1") - F.col("t0")))


@query(f"""WITH {P.REFERENCE}, b AS (SELECT clip, min(t0) + 3600000000 AS start FROM ref GROUP BY clip)
SELECT event_id, 'clip_' || ref.clip AS clip, speaker, greatest(0, t0 - start) AS t0, t1 - t0 AS dur FROM ref JOIN b ON b.clip = ref.clip""")
def shift_to_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments in the clock of their clip, which starts an hour into the day's speech; earlier ones at 0."""
    ref = P.reference(spark, sf_dir)
    starts = ref.groupBy("clip").agg((F.min("t0") + P.HOUR).alias("start"))
    shifted = ref.join(starts, "clip")
    return shifted.select("event_id", F.concat(F.lit("clip_"), "clip").alias("clip"), "speaker", F.greatest(F.lit(0).cast("bigint"), F.col("t0") - F.col("start")).alias("t0"), (F.col("t1") - F.col("t0")).alias("dur"))


@query(f"""WITH {P.REFERENCE}, {P.HYPOTHESIS}, f AS (SELECT clip, 'x_' || speaker AS speaker, t1 - t0 AS dur, t0, event_id, row_number() OVER (PARTITION BY clip ORDER BY t0, event_id) AS n FROM ref WHERE event_id % 11 <> 0),
o AS (SELECT f.clip, hyp.t0 - f.t0 AS shift, row_number() OVER (PARTITION BY f.clip ORDER BY f.n, hyp.t0, hyp.event_id) AS k FROM f JOIN hyp ON hyp.clip = f.clip AND hyp.speaker = f.speaker AND abs((hyp.t1 - hyp.t0) - f.dur) < 1000)
SELECT clip, shift FROM o WHERE k = 1 UNION ALL SELECT clip, 0 FROM (SELECT DISTINCT clip FROM ref) c WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.clip = c.clip)""")
def clip_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offset of the first local row that some absolute row matches in speaker and, to a millisecond, in length; else 0.

    Lengths are joined by the millisecond and its neighbours, so this is an equi-join.
    """
    ref = P.reference(spark, sf_dir)
    local = ref.where("event_id % 11 <> 0").select("clip", F.concat(F.lit("x_"), "speaker").alias("speaker"), (F.col("t1") - F.col("t0")).alias("dur"), "t0", "event_id")
    absolute = P.hypothesis(spark, sf_dir).select("clip", "speaker", (F.col("t1") - F.col("t0")).alias("b_dur"), F.col("t0").alias("b_t0"), F.col("event_id").alias("b_id"))
    cell = F.floor(F.col("dur") / 1000)
    near = local.withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    met = near.join(absolute.withColumn("cell", F.floor(F.col("b_dur") / 1000)), ["clip", "speaker", "cell"]).where(F.abs(F.col("b_dur") - F.col("dur")) < 1000)
    first = met.groupBy("clip").agg(F.min_by(F.col("b_t0") - F.col("t0"), F.struct("t0", "event_id", "b_t0", "b_id")).alias("shift"))
    return ref.select("clip").distinct().join(first, "clip", "left").select("clip", F.coalesce("shift", F.lit(0).cast("bigint")).alias("shift"))


@query(f"""WITH {P.REFERENCE}, {P.TRACKS} SELECT event_id, ref.clip, speaker, track, least(ref.t1, track.t1) - greatest(ref.t0, track.t0) AS overlap_us
FROM ref JOIN track ON ref.clip = track.clip AND ref.t0 < track.t1 AND track.t0 < ref.t1""")
def interval_join_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = P.reference(spark, sf_dir).select("clip", "event_id", "t0", "t1", "speaker")  # text last, so that rows take less room in a shuffle
    met = intervals.join(ref, P.tracks(spark, sf_dir), ["clip"], 6 * P.HOUR, longest=24 * P.HOUR)  # a track lies in one day
    return met.select("event_id", "clip", "speaker", F.col("b_track").alias("track"), (F.least("t1", "b_t1") - F.greatest("t0", "b_t0")).alias("overlap_us"))


@query(f"""WITH {P.REFERENCE}, {P.TRACKS}, o AS (SELECT event_id, ref.clip, speaker, track, least(ref.t1, track.t1) - greatest(ref.t0, track.t0) AS overlap_us
FROM ref JOIN track ON ref.clip = track.clip AND ref.t0 < track.t1 AND track.t0 < ref.t1)
SELECT event_id, clip, speaker, track, overlap_us FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY overlap_us DESC, track) AS n FROM o) WHERE n = 1""")
def best_overlap_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = intervals.best_match(P.reference(spark, sf_dir), P.tracks(spark, sf_dir), ["clip"], ["event_id"], ["b_track"], 1200 * P.SECOND)
    return best.select("event_id", "clip", "speaker", F.col("b_track").alias("track"), "overlap_us")


def on_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with the share of their time in which some face is on screen; half of it counts as on screen."""
    ref = P.reference(spark, sf_dir).where("t1 > t0")
    faces = intervals.merge(P.tracks(spark, sf_dir), ["clip"])
    shared = intervals.intersect(ref, faces, ["clip"], P.HOUR).groupBy("event_id").agg(F.sum(F.col("t1") - F.col("t0")).alias("shared"))
    rows = ref.join(shared, "event_id", "left").withColumn("shared", F.coalesce("shared", F.lit(0).cast("bigint")))
    return rows.withColumn("on_screen", F.col("shared") * 2 >= F.col("t1") - F.col("t0"))


ON_SCREEN = f"""{P.REFERENCE}, {P.TRACKS}, {P.merged('track', 'face', 'clip')},
s AS (SELECT r.event_id, r.clip, r.speaker, r.t0, r.t1, CAST(coalesce(sum(CASE WHEN f.t0 IS NOT NULL THEN least(r.t1, f.t1) - greatest(r.t0, f.t0) END), 0) AS BIGINT) AS shared
  FROM ref r LEFT JOIN face f ON r.clip = f.clip AND r.t0 < f.t1 AND f.t0 < r.t1 WHERE r.t1 > r.t0 GROUP BY ALL), o AS (SELECT *, shared * 2 >= t1 - t0 AS on_screen FROM s)"""


@query(f"WITH {ON_SCREEN} SELECT event_id, clip, speaker, shared, on_screen FROM o")
def onscreen_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on_screen(spark, sf_dir).select("event_id", "clip", "speaker", "shared", "on_screen")


@query(f"""WITH {ON_SCREEN} SELECT coalesce(clip, 'all') AS clip, CAST(sum(CASE WHEN on_screen THEN t1 - t0 ELSE 0 END) AS BIGINT) AS on_us, CAST(sum(CASE WHEN on_screen THEN 0 ELSE t1 - t0 END) AS BIGINT) AS off_us,
count(*) AS segments FROM o GROUP BY ROLLUP (clip)""")
def onscreen_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = F.col("t1") - F.col("t0")
    rows = on_screen(spark, sf_dir).rollup("clip").agg(F.sum(F.when(F.col("on_screen"), long).otherwise(0)).alias("on_us"), F.sum(F.when(F.col("on_screen"), 0).otherwise(long)).alias("off_us"), F.count("*").alias("segments"))
    return rows.withColumn("clip", F.coalesce("clip", F.lit("all")))


@query(f"WITH {ON_SCREEN} SELECT clip, string_agg(speaker, ',' ORDER BY speaker) AS speakers FROM (SELECT clip, speaker FROM o GROUP BY 1, 2 HAVING NOT bool_or(on_screen)) GROUP BY clip")
def never_on_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    never = on_screen(spark, sf_dir).groupBy("clip", "speaker").agg(F.bool_or("on_screen").alias("seen")).where("NOT seen")
    return never.groupBy("clip").agg(F.array_join(F.array_sort(F.collect_list("speaker")), ",").alias("speakers"))


def shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When a speaker's own face is seen: around two of three of its events; errors are seen on even days only."""
    e = P.reference(spark, sf_dir).where("event_id % 3 <> 0 AND (speaker <> 'error' OR substring(clip, 10, 1) % 2 = 0)")
    return e.select("clip", "speaker", (F.col("t0") - 20 * P.SECOND).alias("t0"), (F.col("t0") + (F.col("event_id") % 90 + 10) * P.SECOND).alias("t1"))


SHOWN = f"""{P.REFERENCE}, shown AS (SELECT clip, speaker, t0 - 20000000 AS t0, t0 + (event_id % 90 + 10) * 1000000 AS t1 FROM ref WHERE event_id % 3 <> 0 AND (speaker <> 'error' OR CAST(clip[10] AS INTEGER) % 2 = 0)),
s AS (SELECT r.event_id, r.clip, r.speaker, r.t0, r.t1, CAST(coalesce(sum(CASE WHEN f.t0 IS NOT NULL THEN least(r.t1, f.t1) - greatest(r.t0, f.t0) END), 0) AS BIGINT) AS shared FROM ref r LEFT JOIN shown f ON r.clip = f.clip AND r.speaker = f.speaker AND r.t0 < f.t1 AND f.t0 < r.t1 WHERE r.t1 > r.t0 GROUP BY ALL),
o AS (SELECT *, shared * 2 >= t1 - t0 AS on_screen FROM s)"""


def own_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with the time in which their speaker is seen, each sighting counted for itself; half of the segment is on screen."""
    rows = intervals.covered(P.reference(spark, sf_dir).where("t1 > t0"), shown(spark, sf_dir), ["clip", "speaker"], ["event_id"], 600 * P.SECOND)
    return rows.withColumn("on_screen", F.col("shared") * 2 >= F.col("t1") - F.col("t0"))


@query(f"WITH {SHOWN} SELECT event_id, clip, speaker, shared, on_screen FROM o")
def speaker_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return own_screen(spark, sf_dir).select("event_id", "clip", "speaker", "shared", "on_screen")


@query(f"WITH {SHOWN} SELECT clip, speaker, CAST(sum(CASE WHEN on_screen THEN t1 - t0 ELSE 0 END) AS BIGINT) AS on_us, CAST(sum(CASE WHEN on_screen THEN 0 ELSE t1 - t0 END) AS BIGINT) AS off_us, count(*) AS segments FROM o GROUP BY 1, 2")
def screen_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time on and off screen by speaker."""
    long = F.col("t1") - F.col("t0")
    return own_screen(spark, sf_dir).groupBy("clip", "speaker").agg(F.sum(F.when(F.col("on_screen"), long).otherwise(0)).alias("on_us"), F.sum(F.when(F.col("on_screen"), 0).otherwise(long)).alias("off_us"), F.count("*").alias("segments"))


@query(f"WITH {SHOWN} SELECT clip, string_agg(speaker, ',' ORDER BY speaker) AS speakers FROM (SELECT clip, speaker FROM o GROUP BY 1, 2 HAVING NOT bool_or(on_screen)) GROUP BY clip")
def never_seen_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The speakers of each clip that are never on screen while they speak."""
    never = screen_seconds(spark, sf_dir).where("on_us = 0 AND off_us > 0")
    return never.groupBy("clip").agg(F.array_join(F.array_sort(F.collect_list("speaker")), ",").alias("speakers"))


@query(f"""WITH {P.FRAMES}, b AS (SELECT user_id % 10 AS clip, user_id AS track, frame - user_id % 6 AS frame FROM frames), n AS (SELECT clip, 60 + clip * 11 AS n FROM b WHERE clip <> 7 GROUP BY clip)
SELECT b.clip, b.frame, count(*) AS boxes, string_agg(CAST(track AS VARCHAR), ' ' ORDER BY track) AS tracks FROM b JOIN n ON n.clip = b.clip AND b.frame >= 0 AND b.frame < n GROUP BY 1, 2""")
def draw_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tracks to draw on each frame that a clip has; clips of unknown length have none."""
    u = F.col("user_id")
    boxes = P.frames(spark, sf_dir).select((u % 10).alias("clip"), u.alias("track"), (F.col("frame") - u % 6).alias("f0"), (F.col("frame") - u % 6 + 1).alias("f1"))
    sizes = boxes.where("clip <> 7").select("clip").distinct().withColumn("n", 60 + F.col("clip") * 11)
    inside = intervals.within(boxes, sizes, ["clip"])
    held = inside.groupBy("clip", F.col("f0").alias("frame")).agg(F.count("*").alias("boxes"), F.array_sort(F.collect_list("track")).alias("t"))  # a frame's faces
    return held.select("clip", "frame", "boxes", F.array_join(F.col("t").cast("array<string>"), " ").alias("tracks"))


#: One speaker at a time: slices between all bounds, each given to the speaker with most speech, joined where they touch.
SINGLE = """total AS (SELECT clip, speaker, sum(t1 - t0) AS spoken FROM ref GROUP BY 1, 2), p AS (SELECT DISTINCT clip, unnest([t0, t1]) AS t FROM ref WHERE t1 > t0),
s AS (SELECT clip, t AS t0, lead(t) OVER (PARTITION BY clip ORDER BY t) AS t1 FROM p),
w AS (SELECT s.clip, s.t0, s.t1, r.speaker FROM s JOIN ref r ON r.clip = s.clip AND r.t0 <= s.t0 AND r.t1 >= s.t1 JOIN total ON total.clip = r.clip AND total.speaker = r.speaker WHERE s.t1 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY s.clip, s.t0 ORDER BY spoken DESC, r.speaker) = 1),
f AS (SELECT *, CASE WHEN lag(t1) OVER v = t0 AND lag(speaker) OVER v = speaker THEN 0 ELSE 1 END AS fresh FROM w WINDOW v AS (PARTITION BY clip ORDER BY t0)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY clip ORDER BY t0 ROWS UNBOUNDED PRECEDING) AS g FROM f) SELECT clip, speaker, min(t0) AS t0, max(t1) AS t1 FROM g GROUP BY clip, speaker, g"""


@query(f"WITH {P.REFERENCE}, {SINGLE}")
def single_speaker_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.single_winner(P.reference(spark, sf_dir).select("clip", "speaker", "t0", "t1"), ["clip"], "speaker", WIDTH)


@query(f"WITH {P.CAPTIONS} SELECT a.clip, a.t0 AS t, b.turn, b.speaker FROM captions a JOIN captions b ON a.clip = b.clip AND a.t0 BETWEEN b.t0 AND b.t1")
def stabbing_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions active at each caption's start, both ends included."""
    c = P.captions(spark, sf_dir)
    return intervals.stab(c.select("clip", F.col("t0").alias("t")), c.select("clip", "turn", "speaker", "t0", "t1"), ["clip"], 10 * P.SECOND).select("clip", "t", "turn", "speaker")


@query(f"""WITH {P.TRACKS}, p AS (SELECT clip, t0 // 40000 AS f, 1 AS d FROM track WHERE t1 // 40000 > t0 // 40000 UNION ALL SELECT clip, t1 // 40000, -1 FROM track WHERE t1 // 40000 > t0 // 40000),
s AS (SELECT clip, f, sum(d) AS d FROM p GROUP BY 1, 2), r AS (SELECT clip, f AS f0, lead(f) OVER w AS f1, CAST(sum(d) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS active FROM s WINDOW w AS (PARTITION BY clip ORDER BY f))
SELECT clip, f0, f1, active FROM r WHERE active > 0 AND f1 IS NOT NULL""")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tracks cover each stretch of frames, at 25 frames a second."""
    return frames.coverage(P.tracks(spark, sf_dir), ["clip"], 25)


@query(f"""WITH {P.REFERENCE}, {P.HYPOTHESIS}, u AS (SELECT clip, t0, t1, 1 AS r, 0 AS h FROM ref UNION ALL SELECT clip, t0, t1, 0, 1 FROM hyp), p AS (SELECT clip, t0 AS t, r, h FROM u WHERE t1 > t0 UNION ALL SELECT clip, t1, -r, -h FROM u WHERE t1 > t0),
s AS (SELECT clip, t, sum(r) AS r, sum(h) AS h FROM p GROUP BY 1, 2), c AS (SELECT clip, t AS t0, lead(t) OVER w AS t1, sum(r) OVER (w ROWS UNBOUNDED PRECEDING) AS r, sum(h) OVER (w ROWS UNBOUNDED PRECEDING) AS h FROM s WINDOW w AS (PARTITION BY clip ORDER BY t))
SELECT clip, CAST(sum((t1 - t0) * greatest(0, r - h)) AS BIGINT) AS residual_us FROM c WHERE t1 IS NOT NULL GROUP BY clip""")
def residual_vad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speech beyond what the hypothesis accounts for, floored at none."""
    r, h = P.reference(spark, sf_dir), P.hypothesis(spark, sf_dir)
    both = r.select("clip", "t0", "t1", F.lit(1).alias("r"), F.lit(0).alias("h")).unionByName(h.select("clip", "t0", "t1", F.lit(0).alias("r"), F.lit(1).alias("h")))
    slices = intervals.sweep(both, ["clip"], {"r": F.col("r"), "h": F.col("h")})
    left = (F.col("t1") - F.col("t0")) * F.greatest(F.lit(0).cast("bigint"), F.col("r") - F.col("h"))
    return slices.groupBy("clip").agg(F.sum(left).alias("residual_us"))


@query(f"""WITH {P.REFERENCE} SELECT clip, event_id, CAST(row_number() OVER (PARTITION BY clip ORDER BY t0, event_id) AS INTEGER) AS n FROM ref QUALIFY n <= 3""")
def first_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three segments of each clip (top n by key)."""
    order = Window.partitionBy("clip").orderBy("t0", "event_id")
    return P.reference(spark, sf_dir).select("clip", "event_id", F.row_number().over(order).alias("n")).where("n <= 3")
