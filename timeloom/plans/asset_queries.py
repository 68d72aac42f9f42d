"""Queries of dataset bookkeeping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timeloom.operators import assets as A

from . import projections as P
from .registry import registry

QUERIES, SQL, query = registry()
REQUIRED = ("gaze", "jaw", "lips", "pose")
RULES = (("pre_1", "hub/pretrain-b"), ("pre", "hub/pretrain-a"))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.table(spark, sf_dir, "documents")


@query("SELECT row_number() OVER (ORDER BY doc_id) AS n, doc_id, source FROM documents QUALIFY n <= 50")
def manifest_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty rows of a manifest (a limit that is the feature)."""
    first = docs(spark, sf_dir).select("doc_id", "source").orderBy("doc_id").limit(50)
    return A.numbered(first, ["doc_id"]).select("n", "doc_id", "source")


@query("SELECT n, doc_id, source FROM (SELECT row_number() OVER (ORDER BY doc_id) AS n, doc_id, source FROM documents) WHERE n = 137")
def manifest_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 137th row, counted from 1."""
    return A.numbered(docs(spark, sf_dir).select("doc_id", "source"), ["doc_id"]).where("n = 137").select("n", "doc_id", "source")


TAG = "CASE WHEN doc_id % 7 = 0 THEN 'val' WHEN doc_id % 7 < 3 THEN 'pre_' || lpad(CAST(doc_id % 30 AS VARCHAR), 2, '0') ELSE 'main_' || CAST(doc_id % 3 AS VARCHAR) END"


@query(f"""WITH t AS (SELECT doc_id, {TAG} AS tag FROM documents) SELECT doc_id, regexp_replace(tag, '_[0-9][0-9]$', '') AS base, nullif(regexp_extract(tag, '_([0-9][0-9])$', 1), '') AS shard,
CASE WHEN starts_with(tag, 'pre_1') THEN 'hub/pretrain-b' WHEN starts_with(tag, 'pre') THEN 'hub/pretrain-a' ELSE 'hub/main' END AS repo FROM t""")
def tag_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base, shard and repository of each row's tag."""
    i = F.col("doc_id")
    tag = F.when(i % 7 == 0, "val").when(i % 7 < 3, F.concat(F.lit("pre_"), F.lpad((i % 30).cast("string"), 2, "0"))).otherwise(F.concat(F.lit("main_"), (i % 3).cast("string")))
    base, shard = A.tag_parts(tag)
    return docs(spark, sf_dir).select("doc_id", base.alias("base"), shard.alias("shard"), A.repository(tag, RULES, "hub/main").alias("repo"))


def file_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text for each document, a video for two in three, an archive for some."""
    exts = F.array(F.lit("txt"), F.when(F.col("doc_id") % 3 != 0, "mp4"), F.when(F.col("doc_id") % 5 == 0, "npz"))
    return docs(spark, sf_dir).select(F.col("doc_id").alias("stem"), F.explode(F.array_compact(exts)).alias("ext"))


@query("SELECT doc_id AS stem FROM documents WHERE doc_id % 3 <> 0")
def paired_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts with a video of the same name."""
    return A.paired(file_list(spark, sf_dir), "txt", "mp4")


@query("""WITH l AS (SELECT doc_id AS stem, lpad(CAST(doc_id % 8 AS VARCHAR), 2, '0') AS shard FROM documents WHERE doc_id % 4 <> 0 UNION ALL SELECT doc_id, '99' FROM documents WHERE doc_id % 10 = 0)
SELECT d.doc_id AS stem, min(l.shard) AS shard FROM documents d LEFT JOIN l ON l.stem = d.doc_id GROUP BY 1""")
def shard_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard that lists each stem; null for those that none lists."""
    d = docs(spark, sf_dir)
    listing = d.where("doc_id % 4 <> 0").select(F.col("doc_id").alias("stem"), F.lpad((F.col("doc_id") % 8).cast("string"), 2, "0").alias("shard"))
    more = d.where("doc_id % 10 = 0").select(F.col("doc_id").alias("stem"), F.lit("99").alias("shard"))
    return A.in_shards(d.select(F.col("doc_id").alias("stem")), listing.unionByName(more))


@query("""SELECT vec_id, CASE vec_id % 4 WHEN 0 THEN FALSE WHEN 1 THEN FALSE ELSE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x) AND x <> 0)) > 0 END AS usable FROM embeddings""")
def landmarks_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which landmark arrays hold anything; every fourth is all zeros, every fourth empty."""
    e = P.table(spark, sf_dir, "embeddings")
    v = F.col("embedding").cast("array<double>")
    values = F.when(F.col("vec_id") % 4 == 0, F.transform(v, lambda x: x * 0)).when(F.col("vec_id") % 4 == 1, F.array().cast("array<double>")).otherwise(v)
    return e.select("vec_id", A.usable(values).alias("usable"))


@query("""WITH f AS (SELECT vec_id, list_filter(['gaze', 'jaw', 'lips', 'pose', 'wink'], lambda n: (vec_id + len(n)) % 6 <> 0) AS names, embedding FROM embeddings)
SELECT vec_id, array_to_string(list_filter(['gaze', 'jaw', 'lips', 'pose'], lambda n: NOT list_contains(names, n)), ',') AS missing, array_to_string(list_filter(names, lambda n: n = 'wink'), ',') AS extra,
len(list_distinct(list_transform(names, lambda n: CASE WHEN n = 'jaw' AND vec_id % 5 = 0 THEN 1 ELSE len(embedding) END))) <= 1 AS equal_lengths,
len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AS finite FROM f""")
def feature_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with each file of named feature arrays."""
    e = P.table(spark, sf_dir, "embeddings")
    v = F.col("embedding").cast("array<double>")
    names = F.filter(F.array(*(F.lit(n) for n in (*REQUIRED, "wink"))), lambda n: (F.col("vec_id") + F.length(n)) % 6 != 0)
    found = F.map_from_arrays(names, F.transform(names, lambda n: F.when((n == "jaw") & (F.col("vec_id") % 5 == 0), F.slice(v, 1, 1)).otherwise(v)))
    return e.select("vec_id", found.alias("found")).select("vec_id", *(c.alias(name) for name, c in A.array_problems(F.col("found"), REQUIRED).items()))


CROPS = """c AS (SELECT doc_id, n_chars % 90 AS source_frames, doc_id % 11 <> 0 AS there, (n_chars + doc_id % 4) % 90 AS frames, CASE WHEN doc_id % 13 = 0 THEN 64 ELSE 96 END AS width, 96 AS height,
CASE WHEN doc_id % 17 = 0 THEN 30.0 ELSE 25.0 + (doc_id % 3) * 0.2 END AS fps FROM documents),
f AS (SELECT doc_id, CASE WHEN NOT there THEN 'missing' WHEN frames <= 0 THEN 'empty' WHEN width <> 96 OR height <> 96 THEN 'shape' WHEN abs(fps - 25) > 0.5 THEN 'fps' WHEN abs(frames - source_frames) > 2 THEN 'drift' ELSE 'ok' END AS state FROM c)"""


def crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    found = docs(spark, sf_dir).select(
        "doc_id", (F.col("n_chars") % 90).alias("source_frames"), (i % 11 != 0).alias("there"), ((F.col("n_chars") + i % 4) % 90).alias("frames"),
        F.when(i % 13 == 0, 64).otherwise(96).alias("width"), F.lit(96).alias("height"), F.when(i % 17 == 0, 30.0).otherwise(25.0 + (i % 3) * 0.2).alias("fps"),
    )
    return found.withColumn("state", A.first_failure(A.crop_checks(96, 96, 25.0)))


@query(f"WITH {CROPS} SELECT doc_id, state FROM f")
def crop_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first check that each mouth crop fails."""
    return crops(spark, sf_dir).select("doc_id", "state")


@query(f"WITH {CROPS} SELECT state AS reason, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, state) AS INTEGER) AS place FROM f GROUP BY state")
def reason_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons by how often they occur."""
    return A.reason_counts(crops(spark, sf_dir), "state")


@query(f"""WITH {CROPS}, s AS (SELECT 'crops' AS "check", count(*) FILTER (state <> 'ok') AS failures FROM f UNION ALL SELECT 'texts', count(*) FILTER (coalesce(text, '') = '') FROM documents
UNION ALL SELECT 'ids', count(*) - count(DISTINCT doc_id) FROM documents) SELECT *, failures = 0 AS passed FROM s""")
def check_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three checks before an evaluation, with their failures."""
    d = docs(spark, sf_dir)
    again = d.groupBy("doc_id").agg(F.count("*").alias("n")).select(F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("i")).where("i > 1")
    return A.suite({"crops": crops(spark, sf_dir).where("state <> 'ok'"), "texts": d.where("coalesce(text, '') = ''"), "ids": again})


@query(f"""WITH {P.REFERENCE} SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN 'SPEAKER other 1 ' || CAST(t0 // 1000000 AS VARCHAR) || ' 2 <NA> <NA> ' || speaker || ' <NA> <NA>' END AS line FROM ref""")
def uri_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with another file id; malformed ones (every fifth) are null."""
    second = F.floor(F.col("t0") / P.SECOND).cast("string")
    line = F.concat(F.when(F.col("event_id") % 5 != 0, "SPEAKER").otherwise("LEXEME"), F.lit(" own 1 "), second, F.lit("  2 <NA> <NA> "), F.col("speaker"), F.lit(" <NA> <NA>"))
    return P.reference(spark, sf_dir).select("event_id", A.replaced_uri(line, F.lit("other")).alias("line"))


@query("""WITH b AS (SELECT event_id, event_id % 50 * 1.0 AS x, event_id % 70 * 0.5 AS y, value AS w, value / 2 AS h FROM events)
SELECT event_id, x + w / 2 AS cx, y + h / 2 AS cy, w / 2 AS half, CAST(greatest(0, floor(x - 4)) AS INTEGER) AS x1, CAST(greatest(0, floor(y - 4)) AS INTEGER) AS y1,
CAST(least(96, ceil(x + w + 4)) AS INTEGER) AS x2, CAST(least(80, ceil(y + h + 4)) AS INTEGER) AS y2 FROM b""")
def crop_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centre and size of each box, and the box around its corners inside the image."""
    e = P.table(spark, sf_dir, "events")
    x, y, w, h = (F.col("event_id") % 50) * 1.0, (F.col("event_id") % 70) * 0.5, F.col("value"), F.col("value") / 2
    cx, cy, half = A.centre_and_size(x, y, x + w, y + h)
    box = A.clamped_box(F.array(x, x + w), F.array(y, y + h), F.lit(4.0), 96, 80)
    return e.select("event_id", cx.alias("cx"), cy.alias("cy"), half.alias("half"), box.alias("b")).select("event_id", "cx", "cy", "half", "b.*")


@query("""WITH p AS (SELECT event_id, user_id % 10 AS clip, epoch_us(ts) % 60000000 AS t FROM events), f AS (SELECT vec_id % 10 AS clip, row_number() OVER (PARTITION BY vec_id % 10 ORDER BY vec_id) - 1 AS r, vec_id FROM embeddings),
c AS (SELECT clip, count(*) AS n FROM f GROUP BY clip) SELECT p.event_id, p.clip, f.r AS row, f.vec_id FROM p JOIN c ON c.clip = p.clip JOIN f ON f.clip = p.clip AND f.r = least(greatest(p.t * 5 // 1000000 - 5, 0), c.n - 1)""")
def nearest_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature row that stands for each point of time."""
    points = P.events(spark, sf_dir).select("event_id", (F.col("user_id") % 10).alias("clip"), (F.col("t") % (60 * P.SECOND)).alias("t"))
    rows = F.row_number().over(Window.partitionBy((F.col("vec_id") % 10).alias("clip")).orderBy("vec_id")) - 1
    features = P.table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 10).alias("clip"), rows.cast("bigint").alias("row"), "vec_id")
    return A.as_of(points, features, ["clip"], "t").select("event_id", "clip", "row", "vec_id")


@query("""WITH t AS (SELECT user_id % 10 AS clip, user_id, row_number() OVER (PARTITION BY user_id % 10 ORDER BY user_id) - 1 AS place FROM (SELECT DISTINCT user_id FROM events))
SELECT clip, user_id, place, CASE WHEN place < 4 THEN place * 3 + clip ELSE -1 END AS face FROM t""")
def positional_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks and face ids by their place; tracks beyond the list of faces have face -1."""
    users = P.table(spark, sf_dir, "events").select("user_id").distinct().withColumn("clip", F.col("user_id") % 10)
    tracks = users.withColumn("place", (F.row_number().over(Window.partitionBy("clip").orderBy("user_id")) - 1).cast("bigint"))
    clips = users.select("clip").distinct().select("clip", F.posexplode(F.array(*(F.col("clip") + 3 * i for i in range(4)))).alias("place", "face"))
    return A.zipped(tracks, clips.withColumn("place", F.col("place").cast("bigint")), ["clip"], "place", "face").select("clip", "user_id", "place", "face")


@query("""SELECT lang, round(sum(CASE WHEN n_chars % 5 <> 0 AND n_chars % 5 = doc_id % 4 THEN 1 ELSE 0 END) / nullif(count(*) FILTER (n_chars % 5 <> 0), 0), 6) AS accuracy FROM documents GROUP BY lang""")
def label_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right labels among those that count (label 0 does not)."""
    return docs(spark, sf_dir).groupBy("lang").agg(F.round(A.accuracy(F.col("doc_id") % 4, F.col("n_chars") % 5, 0), 6).alias("accuracy"))


@query("""WITH f AS (SELECT *, row_number() OVER (PARTITION BY doc_id // 8 ORDER BY doc_id) AS n FROM documents WHERE doc_id // 8 < 5)
SELECT count(*) AS checked, round(avg(CASE WHEN length(text) <> n_chars OR doc_id % 3 = 0 THEN 1 ELSE 0 END), 6) AS rate, avg(CASE WHEN length(text) <> n_chars OR doc_id % 3 = 0 THEN 1 ELSE 0 END) > 0.3 AS warning FROM f WHERE n <= 5""")
def label_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that do not fit their text, among the first rows of the first batches (a check that is meant to look at few)."""
    rows = docs(spark, sf_dir).withColumn("batch", F.floor(F.col("doc_id") / 8))
    return A.mismatch_rate(rows, "batch", "doc_id", (F.length("text") != F.col("n_chars")) | (F.col("doc_id") % 3 == 0))


@query("SELECT page_id, sha256(html) AS sha256 FROM pages")
def file_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.fingerprint(P.table(spark, sf_dir, "pages"), "page_id", F.col("html"))


@query("SELECT doc_id, source, CASE WHEN doc_id % 9 = 0 THEN 'val' ELSE 'train' END AS part FROM documents")
def manifests_concatenated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training and validation manifests in one."""
    d = docs(spark, sf_dir).select("doc_id", "source")
    return A.concatenated({"train": d.where("doc_id % 9 <> 0"), "val": d.where("doc_id % 9 = 0")})


@query("""WITH e AS (SELECT user_id, event_id, value, row_number() OVER w AS i, coalesce(value < min(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS better FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
s AS (SELECT *, i - max(CASE WHEN better THEN i END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS waited FROM e)
SELECT user_id, min(CASE WHEN waited >= 5 THEN event_id END) AS stop, min(value) AS best FROM s GROUP BY user_id""")
def early_stopping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each user's scores have not improved for five steps."""
    return A.early_stop(P.table(spark, sf_dir, "events"), ["user_id"], "event_id", "value", 5)


@query("""SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN CASE WHEN doc_id % 4 = 0 THEN 'salvaged' ELSE 'failed' END WHEN doc_id % 5 = 0 AND doc_id % 4 <> 0 THEN 'empty' ELSE 'ok' END AS state,
CASE WHEN (doc_id % 6 = 0 AND doc_id % 4 <> 0) OR (doc_id % 6 <> 0 AND doc_id % 5 = 0 AND doc_id % 4 <> 0) THEN '' ELSE coalesce(source, '') END AS output FROM documents""")
def failures_isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every clip stays, with what its stage gave."""
    d, i = docs(spark, sf_dir), F.col("doc_id")
    lost = ((i % 6 == 0) | (i % 5 == 0)) & (i % 4 != 0)
    done = d.select("doc_id", F.when(~lost, F.col("source")).alias("output"), F.when(i % 6 == 0, "stage 2").alias("error"))
    return A.isolated(d.select("doc_id"), done, "doc_id").select("doc_id", "state", "output")
