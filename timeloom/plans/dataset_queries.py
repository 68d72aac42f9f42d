"""Queries that prepare and check training data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timeloom import storage
from timeloom.functions import text as X
from timeloom.operators import batching, manifest
from timeloom.sources import files, sinks

from . import projections as P
from .registry import registry

QUERIES, SQL, query = registry()


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as manifest rows: some without frames, some with bad ids."""
    d = P.table(spark, sf_dir, "documents")
    number = F.lpad((F.col("doc_id") % 15).cast("string"), 2, "0")
    ids = F.transform(F.sequence(F.lit(1), (F.col("doc_id") % 7 + 1).cast("int")), lambda i: F.when(F.col("doc_id") % 50 == 0, F.lit(1)).otherwise((F.col("doc_id") * 31 + i * 17) % 1047 + 1).cast("int"))
    return d.select("doc_id", F.concat(F.lit("set_"), number).alias("tag"), F.concat("source", F.lit("\\"), F.col("doc_id").cast("string"), F.lit(".avi")).alias("rel"), F.when(F.col("doc_id") % 40 == 3, 0).otherwise(F.col("n_chars")).cast("int").alias("frames"), ids.alias("ids"))


ROWS = """m AS (SELECT doc_id, 'set_' || lpad(CAST(doc_id % 15 AS VARCHAR), 2, '0') AS tag, source || '\\' || doc_id || '.avi' AS rel, CAST(CASE WHEN doc_id % 40 = 3 THEN 0 ELSE n_chars END AS INTEGER) AS frames,
list_transform(range(1, doc_id % 7 + 2), lambda i: CAST(CASE WHEN doc_id % 50 = 0 THEN 1 ELSE (doc_id * 31 + i * 17) % 1047 + 1 END AS INTEGER)) AS ids FROM documents)""".replace("\\\\", "\\")


@query(f"WITH {ROWS} SELECT doc_id, tag || ',' || rel || ',' || frames || ',' || array_to_string(ids, ' ') AS line FROM m")
def manifest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = sinks.manifest_line(F.col("tag"), F.col("rel"), F.col("frames"), F.col("ids"))
    return rows(spark, sf_dir).select("doc_id", line.alias("line"))


@query(f"WITH {ROWS} SELECT tag, replace(rel, '\\', '/') AS rel, least(frames, 3000) AS frames, ids FROM m WHERE frames >= 1".replace("\\\\", "\\"))
def manifest_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest lines parsed again: rows without frames dropped, long ones cut."""
    return files.parse_manifest(manifest_lines(spark, sf_dir).select(F.col("line").alias("value")), cap=3000)


@query(f"WITH {ROWS} SELECT tag, replace(rel, '\\', '/') AS rel, frames, ids FROM m WHERE frames BETWEEN 1 AND 3000".replace("\\\\", "\\"))
def manifest_drop_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.parse_manifest(manifest_lines(spark, sf_dir).select(F.col("line").alias("value")), drop_above=3000)


@query(f"WITH {ROWS} SELECT doc_id, CASE WHEN ids[len(ids)] = 1048 THEN ids ELSE list_append(ids, 1048) END AS ids FROM m")
def id_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.id_sequences(rows(spark, sf_dir), 1048).select("doc_id", "ids")


@query(f"""WITH {ROWS} SELECT tag, count(*) AS n, count(*) FILTER (frames <= 0) AS no_frames, count(*) FILTER (rel NOT LIKE '%.avi') AS bad_path, count(*) FILTER (len(ids) = 0) AS no_ids,
count(*) FILTER (len(list_filter(ids, lambda i: i < 1 OR i > 1047)) > 0) AS bad_ids, count(*) FILTER (len(list_filter(ids, lambda i: i <> 1)) = 0) AS all_unknown, CAST(sum(len(ids)) AS BIGINT) AS ids, CAST(sum(len(list_filter(ids, lambda i: i = 1))) AS BIGINT) AS unknown FROM m GROUP BY tag""")
def manifest_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations by class and statistics of ids, by tag."""
    unknown = F.size(F.filter("ids", lambda i: i == 1))
    return rows(spark, sf_dir).groupBy("tag").agg(
        F.count("*").alias("n"), F.count_if(F.col("frames") <= 0).alias("no_frames"), F.count_if(~F.endswith("rel", F.lit(".avi"))).alias("bad_path"), F.count_if(F.size("ids") == 0).alias("no_ids"),
        F.count_if(F.exists("ids", lambda i: (i < 1) | (i > 1047))).alias("bad_ids"), F.count_if(F.forall("ids", lambda i: i == 1)).alias("all_unknown"), F.sum(F.size("ids")).alias("ids"), F.sum(unknown).alias("unknown"),
    )


REASON = "CASE WHEN frames <= 0 THEN 'no_frames' WHEN doc_id NOT IN (SELECT doc_id FROM labels) THEN 'no_asset' WHEN len(list_filter(ids, lambda i: i <> 1)) = 0 THEN 'all_unknown' WHEN frames > 6000 THEN 'too_long' ELSE 'kept' END"


@query(f"WITH {ROWS} SELECT {REASON} AS reason, count(*) AS n FROM m GROUP BY 1")
def skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why rows are skipped: the first check that fails, in a fixed order."""
    assets = P.table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("there")).distinct()
    reason = F.when(F.col("frames") <= 0, "no_frames").when(F.col("there").isNull(), "no_asset").when(F.forall("ids", lambda i: i == 1), "all_unknown").when(F.col("frames") > 6000, "too_long").otherwise("kept")
    return rows(spark, sf_dir).join(assets, "doc_id", "left").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("""WITH need AS (SELECT doc_id, unnest(['.avi', '.wav']) AS ext FROM documents), there AS (SELECT doc_id, '.avi' AS ext FROM labels UNION SELECT doc_id, '.wav' FROM labels WHERE quality = 1)
SELECT ext, count(*) AS missing FROM need WHERE NOT EXISTS (SELECT 1 FROM there WHERE there.doc_id = need.doc_id AND there.ext = need.ext) GROUP BY ext""")
def asset_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required files of each document that the listing lacks, by extension."""
    need = P.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(F.lit(".avi"), F.lit(".wav"))).alias("ext"))
    labels = P.table(spark, sf_dir, "labels")
    there = labels.select("doc_id", F.lit(".avi").alias("ext")).unionByName(labels.where("quality = 1").select("doc_id", F.lit(".wav").alias("ext")))
    return need.join(there, ["doc_id", "ext"], "left_anti").groupBy("ext").agg(F.count("*").alias("missing"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are not done yet."""
    done = P.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key")).distinct()
    return files.not_done(P.table(spark, sf_dir, "documents").select("doc_id"), done, "doc_id")


@query("SELECT source, lang, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), ' ' ORDER BY doc_id) AS docs FROM documents GROUP BY 1, 2")
def grouped_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = P.table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("doc_id")).alias("d"))
    return g.select("source", "lang", "n", F.array_join(F.col("d").cast("array<string>"), " ").alias("docs"))


@query("SELECT doc_id, source, n_chars, (row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) - 1) % 4 AS replica FROM documents")
def replica_stripes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows dealt to four replicas in turn, by source."""
    order = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return P.table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.pmod(F.row_number().over(order).cast("bigint") - 1, F.lit(4)).alias("replica"))


@query("""WITH RECURSIVE o AS (SELECT source, doc_id, CAST(n_chars AS BIGINT) AS n, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS i FROM documents),
r AS (SELECT source, doc_id, i, 0 AS batch, 1 AS held, n AS top FROM o WHERE i = 1 UNION ALL SELECT o.source, o.doc_id, o.i, CASE WHEN (held + 1) * top > 20000 OR held >= 16 THEN batch + 1 ELSE batch END, CASE WHEN (held + 1) * top > 20000 OR held >= 16 THEN 1 ELSE held + 1 END,
CASE WHEN (held + 1) * top > 20000 OR held >= 16 THEN o.n ELSE top END FROM r JOIN o ON o.source = r.source AND o.i = r.i + 1) SELECT source, doc_id, CAST(batch AS INTEGER) AS batch FROM r""")
def batch_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = P.table(spark, sf_dir, "documents")
    return batching.by_size(d, ["source"], "doc_id", "n_chars", 20_000, 16).select("source", "doc_id", "batch")


@query()
def sample_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.tuples(P.table(spark, sf_dir, "documents"), "doc_id", "n_chars", 50, 3, 6000, 42)


@query("SELECT doc_id, doc_id % 20 AS batch, doc_id % 7 + 1 AS length, list_concat(range(0, doc_id % 7 + 1), list_transform(range(0, max(doc_id % 7 + 1) OVER (PARTITION BY doc_id % 20) - doc_id % 7 - 1), lambda x: CAST(0 AS BIGINT))) AS padded FROM documents")
def pad_collate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = P.table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 20).alias("batch"), F.sequence(F.lit(0).cast("bigint"), F.col("doc_id") % 7).alias("v"))
    out = batching.padded(d, ["batch"], "v")
    return out.select("doc_id", "batch", F.col("length").cast("bigint").alias("length"), "padded")


@query("SELECT conv_id, turn, CAST(coalesce(sum(length(text) + 5) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM conversations")
def stitch_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = P.table(spark, sf_dir, "conversations").withColumn("frames", F.length("text").cast("bigint"))
    return batching.offsets(c, ["conv_id"], "turn", "frames", 5).select("conv_id", "turn", F.col("offset").alias("start"))


def manifest_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """Documents as clips of fifteen shards: transcripts, listed files, frame counts, and keys that are done."""
    d = P.table(spark, sf_dir, "documents").join(P.table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    i = F.col("doc_id")
    d = d.select("doc_id", "quality", "n_chars", F.lpad((i % 15).cast("string"), 2, "0").alias("shard"), F.concat(F.lit("d"), i.cast("string")).alias("stem"), F.when(i % 19 == 2, "").when(i % 23 == 3, "...").otherwise(F.col("text")).alias("text"))
    exts = F.explode(F.concat(F.when(i % 13 == 4, F.array().cast("array<string>")).otherwise(F.array(F.lit(".wav"))), F.when(F.col("quality") == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit(".avi"))), F.array(F.lit(".txt"))))
    listing = d.select("shard", "stem", exts.alias("ext")).select("shard", F.concat("stem", F.lit("/"), "stem", "ext").alias("path"))
    done = d.where(i % 21 == 5).select(F.concat("stem", F.lit("/"), "stem", F.lit(".mp4")).alias("key"))
    return d.select("shard", "stem"), d.where(i % 11 != 1).select("shard", "stem", "text"), listing, d.where(i % 40 != 3).select("shard", "stem", F.col("n_chars").cast("int").alias("frames")), done


def word_numbers(text: Column) -> Column:
    return X.word_ids(X.whole_words(text), F.create_map(F.lit("THE"), F.lit(2), F.lit("OF"), F.lit(3)), 1)


MANIFEST = """q AS (SELECT doc_id, any_value(quality) AS quality FROM labels GROUP BY doc_id),
d AS (SELECT d.doc_id, lpad(CAST(d.doc_id % 15 AS VARCHAR), 2, '0') AS shard, 'd' || d.doc_id AS stem, CASE WHEN d.doc_id % 19 = 2 THEN '' WHEN d.doc_id % 23 = 3 THEN '...' ELSE text END AS text, n_chars, quality FROM documents d LEFT JOIN q ON q.doc_id = d.doc_id),
i AS (SELECT *, list_transform(regexp_extract_all(upper(replace(coalesce(text, ''), 'ß', 'SS')), '[A-Z0-9'']+'), lambda w: CASE w WHEN 'THE' THEN 2 WHEN 'OF' THEN 3 ELSE 1 END) AS ids FROM d),
r AS (SELECT *, CASE WHEN doc_id % 21 = 5 THEN 'already' WHEN doc_id % 11 = 1 THEN 'missing_transcript' WHEN coalesce(text, '') = '' THEN 'empty_text' WHEN len(ids) = 0 THEN 'empty_ids' WHEN doc_id % 13 = 4 THEN 'missing_wav' WHEN quality = 0 THEN 'missing_avi'
  WHEN doc_id % 40 = 3 OR n_chars <= 0 THEN 'missing_frames' ELSE 'ok' END AS reason, CASE WHEN substr(sha256('42|' || stem || '/' || stem || '.mp4'), 1, 16) < '1999999999999a00' THEN 'val' ELSE 'train' END AS split FROM i)"""
MANIFEST_RULES = manifest.Rules(validation=0.1)


@query(f"WITH {MANIFEST} SELECT stem || '/' || stem || '.mp4' AS key, split, 'set_' || shard || ',' || stem || '/' || stem || '.avi,' || CAST(n_chars AS INTEGER) || ',' || array_to_string(ids, ' ') AS line FROM r WHERE reason = 'ok'")
def manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a build after one that has made some of them."""
    clips, transcripts, listing, frames, done = manifest_inputs(spark, sf_dir)
    found = manifest.rated(clips, transcripts, listing, frames, done, word_numbers, MANIFEST_RULES)
    return found.where("reason = 'ok'").select("key", "split", "line")


@query(f"""WITH {MANIFEST}, c AS (SELECT unnest(['already', 'missing_transcript', 'empty_text', 'empty_ids', 'missing_wav', 'missing_avi', 'missing_frames', 'landmarks', 'train', 'val']) AS counter)
SELECT counter, count(r.doc_id) AS n FROM c LEFT JOIN r ON counter = CASE WHEN reason = 'ok' THEN split ELSE reason END GROUP BY counter""")
def manifest_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a build into a folder of committed runs counts while it writes; the first run makes what counts as done."""
    clips, transcripts, listing, frames, done = manifest_inputs(spark, sf_dir)
    folder = storage.fresh_path(spark, "manifest")
    manifest.log(spark, folder).append(done.select("key", F.lit("train").alias("split"), F.lit("").alias("line")))
    found = manifest.build(folder, clips, transcripts, listing, frames, word_numbers, MANIFEST_RULES)
    return spark.createDataFrame(list(found.items()), "counter string, n bigint")


@query("""WITH m AS (SELECT page_id, 'p' || page_id % 40 || '/f' || page_id AS base FROM pages),
l AS (SELECT 'hub' AS place, base || '.avi' AS path FROM m WHERE page_id % 3 = 0 UNION ALL SELECT 'hub', base || '.mp4' FROM m WHERE page_id % 4 = 0 UNION ALL SELECT 'disk', '/data/' || base || '.mp4' FROM m WHERE page_id % 5 < 3),
o AS (SELECT * FROM (VALUES (0, 'hub', '', '.mp4'), (1, 'hub', '', '.avi'), (2, 'disk', '/data/', '.mp4'), (3, 'disk', '/data/', '.avi')) o(rank, place, prefix, ext))
SELECT m.page_id, arg_min(o.place, o.rank) FILTER (l.path IS NOT NULL) AS place, arg_min(l.path, o.rank) FILTER (l.path IS NOT NULL) AS found FROM m CROSS JOIN o LEFT JOIN l ON l.place = o.place AND l.path = prefix || base || ext GROUP BY m.page_id""")
def media_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's media file in the first place that has it, under the first extension."""
    i = F.col("page_id")
    base = F.concat(F.lit("p"), (i % 40).cast("string"), F.lit("/f"), i.cast("string"))
    p = P.table(spark, sf_dir, "pages").select("page_id", F.concat(F.replace(base, F.lit("/"), F.lit("\\")), F.lit(".mp4")).alias("path"))
    files_of = lambda name, where, prefix, ext: P.table(spark, sf_dir, "pages").where(where).select(F.lit(name).alias("place"), F.concat(F.lit(prefix), base, F.lit(ext)).alias("path"))
    listing = files_of("hub", "page_id % 3 = 0", "", ".avi").unionByName(files_of("hub", "page_id % 4 = 0", "", ".mp4")).unionByName(files_of("disk", "page_id % 5 < 3", "/data/", ".mp4"))
    return manifest.resolved(p, listing, [("hub", ""), ("disk", "/data/")], ["", ".avi"], "page_id").select("page_id", "place", "found")
