"""Queries of recogniser output and of text forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeloom.functions import decode
from timeloom.sources import sinks

from . import projections as P
from . import scoring
from .registry import registry
from .scoring_queries import ALL, MERGED, der_sql

QUERIES, SQL, query = registry()
NAMES = ("<sos>", "▁a", "b", "<space>", "<eos>")
LABELS = "list_transform(embedding, lambda x: CAST(floor(abs(CAST(x AS DOUBLE)) * 40) AS INTEGER) % 5)"


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = P.table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.transform("embedding", lambda x: (F.floor(F.abs(x.cast("double")) * 40).cast("int") % 5)).alias("ids"))


@query(f"""WITH l AS (SELECT vec_id, {LABELS} AS ids FROM embeddings)
SELECT vec_id, array_to_string(list_filter(list_transform(range(1, len(ids) + 1), lambda i: CASE WHEN ids[i] <> 0 AND (i = 1 OR ids[i] <> ids[i - 1]) THEN ids[i] END), lambda x: x IS NOT NULL), ' ') AS ids FROM l""")
def ctc_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame labels as sequences: runs once, then without blanks."""
    return labels(spark, sf_dir).select("vec_id", F.array_join(decode.collapsed(F.col("ids")).cast("array<string>"), " ").alias("ids"))


@query(f"""WITH l AS (SELECT vec_id, {LABELS} AS ids FROM embeddings), t AS (SELECT vec_id, ids[2:] AS rest, list_transform(ids[2:], lambda i: (['<sos>', '▁a', 'b', '<space>', '<eos>'])[i + 1]) AS n FROM l)
SELECT vec_id, replace(replace(array_to_string(n, ''), '<space>', ' '), '<eos>', '') AS text, array_to_string(n, ' ') AS token, array_to_string(rest, ' ') AS token_ids FROM t""")
def hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text, tokens and ids of hypotheses."""
    names = F.array(*(F.lit(x) for x in NAMES))
    return labels(spark, sf_dir).select("vec_id", decode.hypothesis(F.col("ids"), names).alias("h")).select("vec_id", "h.*")


@query("""WITH t AS (SELECT conv_id, turn, regexp_replace(text, '[^ -~]', '', 'g') AS x FROM conversations), p AS (SELECT levenshtein(a.x, coalesce(b.x, '')) AS e, length(a.x) AS n FROM t a LEFT JOIN t b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)
SELECT CAST(sum(e) AS BIGINT) AS errors, CAST(sum(n) AS BIGINT) AS chars, round(sum(e) / sum(n), 6) AS cer FROM p""")
def cer_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character errors of all pairs over characters of all references."""
    c = P.captions(spark, sf_dir)
    text = F.regexp_replace("text", "[^ -~]", "")
    a, b = c.select("clip", "turn", text.alias("x")), c.select("clip", (F.col("turn") - 1).alias("turn"), text.alias("y"))
    pairs = a.join(b, ["clip", "turn"], "left").select(F.levenshtein("x", F.coalesce("y", F.lit(""))).alias("e"), F.length("x").alias("n"))
    return pairs.agg(F.sum("e").alias("errors"), F.sum("n").alias("chars"), F.round(F.sum("e") / F.sum("n"), 6).alias("cer"))


@query("""SELECT event_id, round(CASE WHEN event_id < 4000 THEN 0.1 + 0.4 * event_id / 4000 ELSE 0.5 END, 9) AS share, round(CASE WHEN event_id >= 8000 THEN 1.0 ELSE 1.0 - 0.04 * (cos(pi() * event_id / 8000) + 1) / 2 END, 9) AS momentum FROM events""")
def schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A linear and a cosine schedule over steps."""
    step = F.col("event_id")
    return P.table(spark, sf_dir, "events").select("event_id", F.round(decode.linear_then_flat(step, 4000, 0.1, 0.5), 9).alias("share"), F.round(decode.cosine_momentum(step, 8000, 0.96), 9).alias("momentum"))


@query("""SELECT vec_id, len(embedding) AS n, vec_id % 3 * 40 AS size, round(list_sum(list_transform(embedding[1:vec_id % 3 * 40], lambda x: CAST(x AS DOUBLE))), 6) AS total FROM embeddings WHERE vec_id % 3 > 0""")
def audio_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples cut or padded to forty for each frame."""
    e = P.table(spark, sf_dir, "embeddings").where("vec_id % 3 > 0")
    v = F.col("embedding").cast("array<double>")
    fitted = decode.aligned(v, F.col("vec_id") % 3, 40)
    return e.select("vec_id", F.size(v).cast("bigint").alias("n"), F.size(fitted).cast("bigint").alias("size"), F.round(F.aggregate(fitted, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("SELECT conv_id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS value FROM conversations GROUP BY conv_id")
def references_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of each conversation, one a line."""
    return sinks.joined_text(P.table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text")


@query("""WITH s AS (SELECT doc_id, n_chars % 100 / 100.0 AS c, (n_chars * 7 + doc_id) % 100 / 100.0 AS p, coalesce(text, '') AS text, coalesce(source, '') AS source FROM documents), t AS (SELECT doc_id, track, count(*) AS n FROM (SELECT doc_id, unnest([0, doc_id % 3]) AS track FROM documents WHERE doc_id % 2 = 0) GROUP BY 1, 2),
k AS (SELECT doc_id, string_agg(track || ':' || n, ',' ORDER BY track) AS tracks, CAST(sum(n) AS BIGINT) AS rows, max(n) > 1 AS repeated FROM t GROUP BY 1)
SELECT s.doc_id, round(p - c, 6) AS delta, coalesce(rows, 0) AS rows, coalesce(tracks, '') AS tracks, coalesce(repeated, FALSE) AS repeated, left(text, 1200) AS clip_preview, left(source, 1200) AS pipe_preview FROM s LEFT JOIN k ON k.doc_id = s.doc_id WHERE c <= 0.4 AND p - c >= 0.35""")
def regression_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to look at in samples that got much worse in the pipeline (previews are the feature)."""
    d = P.table(spark, sf_dir, "documents")
    rows = d.select("doc_id", (F.col("n_chars") % 100 / 100.0).alias("clip_wer"), ((F.col("n_chars") * 7 + F.col("doc_id")) % 100 / 100.0).alias("pipe_wer"), F.col("text").alias("clip_text"), F.col("source").alias("pipe_text"))
    tracks = d.where("doc_id % 2 = 0").select("doc_id", F.explode(F.array(F.lit(0).cast("bigint"), F.col("doc_id") % 3)).alias("track"))
    return sinks.regression_debug(rows, tracks, "doc_id", 0.35, 0.4)


#: Seconds as JSON writers print large numbers: a digit, the others, and the power of ten.
JSON_SECONDS = lambda c: f"(CAST({c} AS VCHAR)[1] || '.' || CASE WHEN rtrim(substr(CAST({c} AS VCHAR), 2), '0') = '' THEN '0' ELSE rtrim(substr(CAST({c} AS VCHAR), 2), '0') END || 'E' || (length(CAST({c} AS VCHAR)) - 7))".replace("VCHAR", "VARCHAR")


@query(f"""WITH {P.REFERENCE}, n AS (SELECT clip, t0, t1, speaker, row_number() OVER (PARTITION BY clip ORDER BY t0, t1, speaker) - 1 AS i FROM ref WHERE t1 > t0)
SELECT clip, '{{"metadata":{{' || string_agg('"' || i || '":{{"vid":"1","z":[' || {JSON_SECONDS('t0')} || ',' || {JSON_SECONDS('t1')} || '],"av":{{"1":"' || speaker || '"}}}}', ',' ORDER BY i) || '}}}}' AS value FROM n GROUP BY clip""")
def annotation_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An annotation project for each clip."""
    return sinks.project_json(P.reference(spark, sf_dir).where("t1 > t0"), ["clip"])


@query(f"""WITH d AS (WITH {MERGED}, {der_sql('rm', 'hm', ALL)}), {P.REFERENCE}, {P.HYPOTHESIS}, m AS (SELECT count(*) AS n, {', '.join(f'round(avg({c}), 4) AS a_{c}, round(sum({c} * total_us) / sum(total_us), 4) AS i_{c}' for c in scoring.SCORES)},
list(struct_pack(clip := clip, {', '.join(f'{c} := CAST({c} AS DOUBLE)' for c in scoring.SCORES)}, total_us := total_us) ORDER BY clip) AS per_clip FROM d), g AS (SELECT coalesce(list(DISTINCT clip ORDER BY clip), []) AS skipped FROM hyp WHERE clip NOT IN (SELECT clip FROM ref))
SELECT CAST(to_json(struct_pack(collar := 0.0 :: DOUBLE, n_clips := n, per_clip := per_clip, macro := struct_pack({', '.join(f'{c} := CAST(a_{c} AS DOUBLE)' for c in scoring.SCORES)}), micro := struct_pack({', '.join(f'{c} := CAST(i_{c} AS DOUBLE)' for c in scoring.SCORES)}), skipped := skipped)) AS VARCHAR) AS value FROM m, g""")
def report_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole report of all clips as one JSON object."""
    r, h = P.reference(spark, sf_dir), P.hypothesis(spark, sf_dir)
    skipped = h.select("clip").distinct().join(r.select("clip").distinct(), "clip", "left_anti")
    return scoring.report_json(scoring.error_rates(r, h), skipped, 0)


@query("""SELECT conv_id AS clip, '[' || string_agg('{"track_idx":' || turn || ',"start":' || CAST(CAST(turn AS DOUBLE) * 4 AS VARCHAR) || ',"end":' || CAST(CAST(turn AS DOUBLE) * 4 + 6 AS VARCHAR) || ',"speaker":"' || role || '"}', ',' ORDER BY turn) || ']' AS value FROM conversations GROUP BY conv_id""")
def segment_track_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each clip's segments as one JSON array."""
    seconds = lambda c: (F.col(c) / 1_000_000).cast("double")
    rows = P.captions(spark, sf_dir).select("clip", F.col("turn").alias("track_idx"), seconds("t0").alias("start"), seconds("t1").alias("end"), "speaker")
    return sinks.to_json_array(rows, ["clip"], ["track_idx"], ["track_idx", "start", "end", "speaker"])
