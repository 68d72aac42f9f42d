"""Queries of transcripts, captions and their text forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeloom.functions import text as X
from timeloom.operators import captions, intervals
from timeloom.sources import files, sinks

from . import projections as P
from .registry import registry

QUERIES, SQL, query = registry()
SEC = "printf('%d.%02d', (({0} + 5000) // 10000) // 100, (({0} + 5000) // 10000) % 100)"
MS = "printf('%d.%03d', (({0} + 500) // 1000) // 1000, (({0} + 500) // 1000) % 1000)"
TIME = "printf('%02d:%02d:%02d,%03d', {0} // 3600000000, {0} // 60000000 % 60, {0} // 1000000 % 60, {0} // 1000 % 1000)"


def attributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with the track that they overlap most, and a text for two of three tracks."""
    best = intervals.best_match(P.reference(spark, sf_dir), P.tracks(spark, sf_dir), ["clip"], ["event_id"], ["b_track"], 1200 * P.SECOND)
    segments = best.select("clip", "speaker", "t0", "t1", F.col("b_track").alias("track"))
    texts = P.tracks(spark, sf_dir).where("track % 3 <> 0").select("clip", "track", F.concat(F.lit("said by "), F.col("track").cast("string")).alias("text"))
    return captions.attribute(segments, texts, ["clip"])


ATTRIBUTED = f"""{P.REFERENCE}, {P.TRACKS}, best AS (SELECT ref.clip, speaker, ref.t0, ref.t1, track FROM ref JOIN track ON ref.clip = track.clip AND ref.t0 < track.t1 AND track.t0 < ref.t1
  QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY least(ref.t1, track.t1) - greatest(ref.t0, track.t0) DESC, track) = 1),
m AS (SELECT *, CASE WHEN track % 3 <> 0 THEN 'said by ' || track ELSE '' END AS text, CASE WHEN lag(track) OVER w = track THEN 0 ELSE 1 END AS fresh FROM best WINDOW w AS (PARTITION BY clip ORDER BY t0, track, t1)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY clip ORDER BY t0, track, t1 ROWS UNBOUNDED PRECEDING) AS g FROM m),
a AS (SELECT clip, track, min(t0) AS t0, max(t1) AS t1, arg_min(speaker, t0) AS speaker, any_value(text) AS text FROM g GROUP BY clip, track, g)"""


@query(f"WITH {ATTRIBUTED} SELECT clip, track, t0, t1, speaker, text FROM a")
def transcript_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributed(spark, sf_dir).select("clip", "track", "t0", "t1", "speaker", "text")


DAY = "(t0 - 1704067200000000) % 86400000000"


@query(f"WITH {ATTRIBUTED}, d AS (SELECT clip, track, speaker, text, {DAY} AS x, {DAY} + t1 - t0 AS y FROM a) SELECT clip, track, x AS t0, '[' || {SEC.format('x')} || ' - ' || {SEC.format('y')} || '] ' || speaker || ': ' || text AS line FROM d")
def transcript_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the transcript, in the clock of the day."""
    return sinks.transcript_lines(daily(attributed(spark, sf_dir))).select("clip", "track", "t0", "line")


def daily(rows: DataFrame) -> DataFrame:
    start = (F.col("t0") - 1704067200000000) % (24 * P.HOUR)
    return rows.withColumns({"t0": start, "t1": start + F.col("t1") - F.col("t0")})


@query(f"""WITH {P.CAPTIONS}, n AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY t0, t1, speaker, text) AS n FROM captions)
SELECT clip, CAST(n AS INTEGER) AS n, n || chr(10) || {TIME.format('t0')} || ' --> ' || {TIME.format('t1')} || chr(10) || speaker || ': ' || text || chr(10) AS block FROM n""")
def srt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.srt_blocks(P.captions(spark, sf_dir), ["clip"]).select("clip", "n", "block")


@query(f"""WITH {P.CAPTIONS}, c AS (SELECT clip, turn, speaker, text, t0, least(t1, 15000000) AS t1 FROM captions WHERE t0 < 15000000), n AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY t0, t1, speaker, text) AS n FROM c)
SELECT clip, CAST(n AS INTEGER) AS n, n || chr(10) || {TIME.format('t0')} || ' --> ' || {TIME.format('t1')} || chr(10) || speaker || ': ' || text || chr(10) AS block FROM n""")
def srt_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The captions of the first fifteen seconds."""
    return sinks.srt_blocks(P.captions(spark, sf_dir), ["clip"], until=15 * P.SECOND).select("clip", "n", "block")


RTTM = f"'SPEAKER ' || clip || ' 1 ' || {MS.format('x')} || ' ' || {MS.format('(t1 - t0)')} || ' <NA> <NA> ' || speaker || ' <NA> <NA>'"


@query(f"WITH {P.REFERENCE} SELECT event_id, {RTTM} AS line FROM (SELECT *, {DAY} AS x FROM ref)")
def rttm_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily(P.reference(spark, sf_dir))
    return d.select("event_id", sinks.rttm_line(F.col("clip"), F.col("t0"), F.col("t1"), F.col("speaker")).alias("line"))


@query(f"WITH {P.REFERENCE} SELECT clip AS file_id, speaker, (x + 500) // 1000 * 1000 AS t0, (x + 500) // 1000 * 1000 + (t1 - t0 + 500) // 1000 * 1000 AS t1 FROM (SELECT *, {DAY} AS x FROM ref) WHERE t1 > t0")
def rttm_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments written as RTTM lines and parsed again."""
    d = daily(P.reference(spark, sf_dir))
    raw = d.select(sinks.rttm_line(F.col("clip"), F.col("t0"), F.col("t1"), F.col("speaker")).alias("value"), F.lit("").alias("path"))
    return files.parse_rttm(raw).select("file_id", "speaker", "t0", "t1")


WORDS = "list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z'']+'), lambda w: length(w) >= 2))"


@query(f"""WITH {P.CAPTIONS}, w AS (SELECT clip, turn, t0, t1, {WORDS} AS w FROM captions), p AS (SELECT a.clip, a.turn AS a, b.turn AS b, len(list_intersect(a.w, b.w)) AS i, len(list_distinct(list_concat(a.w, b.w))) AS u
FROM w a JOIN w b ON a.clip = b.clip AND a.turn < b.turn AND a.t0 < b.t1 AND b.t0 < a.t1) SELECT clip, a, b, round(i / u, 6) AS score FROM p WHERE u > 0 AND i / u >= 0.05""")
def caption_pairs_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = captions.similar_pairs(P.captions(spark, sf_dir), "clip", 0.05, 10 * P.SECOND)
    return pairs.withColumn("score", F.round("score", 6))


#: Captions of a clip walked in order, with what was kept so far.
DEDUP = f"""{P.CAPTIONS}, o AS (SELECT clip, list(struct_pack(turn := turn, speaker := speaker, t0 := t0, t1 := t1, text := text, w := {WORDS}) ORDER BY t0, -length(coalesce(text, '')), turn) AS s FROM captions GROUP BY clip),
k AS (SELECT clip, s, 1 AS i, s[1:0] AS kept FROM o UNION ALL
  SELECT clip, s, i + 1, CASE WHEN j IS NULL THEN list_append(kept, s[i]) WHEN length(s[i].text) > length(kept[j].text) THEN list_concat(list_append(kept[1:j - 1], s[i]), kept[j + 1:]) ELSE kept END
  FROM k, LATERAL (SELECT list_min(list_filter(range(1, len(kept) + 1), lambda q: s[i].t0 < kept[q].t1 AND kept[q].t0 < s[i].t1 AND len(list_concat(s[i].w, kept[q].w)) > 0
    AND len(list_intersect(s[i].w, kept[q].w)) / len(list_distinct(list_concat(s[i].w, kept[q].w))) >= 0.05)) AS j) WHERE i <= len(s)),
f AS (SELECT clip, unnest(kept) AS x FROM k WHERE i = len(s) + 1)"""


@query(f"WITH RECURSIVE {DEDUP} SELECT clip, x.turn AS turn, x.speaker AS speaker, x.t0 AS t0, x.t1 AS t1, x.text AS text FROM f")
def caption_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captions.dedup(P.captions(spark, sf_dir), "clip", 0.05)


@query(r"SELECT conv_id, turn, upper(replace(trim(regexp_replace(text, '\s+', ' ', 'g')), 'ß', 'SS')) AS text FROM conversations")
def normalised_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.table(spark, sf_dir, "conversations").select("conv_id", "turn", X.normalise(F.col("text")).alias("text"))


@query("SELECT conv_id, turn, trim(replace(replace(replace(replace(text, ' ', ' ▁') || '<eos>', '<eos>', ''), ' ', ''), '▁', ' ')) AS text FROM conversations")
def detokenised(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = F.concat(F.replace("text", F.lit(" "), F.lit(" ▁")), F.lit("<eos>"))
    return P.table(spark, sf_dir, "conversations").select("conv_id", "turn", X.detokenise(pieces).alias("text"))


@query("""WITH RECURSIVE s AS (SELECT conv_id, turn, list_filter(string_split(text, ' '), lambda w: w <> '') AS w FROM conversations),
r AS (SELECT conv_id, turn, w, 1 AS i, [w[1]] AS lines FROM s WHERE len(w) > 0 UNION ALL SELECT conv_id, turn, w, i + 1, CASE WHEN length(lines[len(lines)]) + 1 + length(w[i + 1]) <= 30 THEN list_append(lines[1:len(lines) - 1], lines[len(lines)] || ' ' || w[i + 1]) ELSE list_append(lines, w[i + 1]) END FROM r WHERE i < len(w))
SELECT conv_id, turn, array_to_string(lines, chr(10)) AS text FROM r WHERE i = len(w)""")
def wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in lines of at most 30 characters."""
    c = P.table(spark, sf_dir, "conversations").select("conv_id", "turn", X.wrap(F.col("text"), 30).alias("w"))
    return c.where(F.size("w") > 0).select("conv_id", "turn", F.array_join("w", "\n").alias("text"))


@query("SELECT doc_id, substr(sha256('42|' || doc_id), 1, 16) < '028f5c28f5c28f5c' AS validation FROM documents")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundredth of all documents, by a keyed hash."""
    return P.table(spark, sf_dir, "documents").select("doc_id", X.in_share(F.col("doc_id"), 0.01, 42).alias("validation"))


@query("SELECT doc_id, len(regexp_extract_all(upper(replace(text, 'ß', 'SS')), '[A-Z0-9'']+')) AS n, list_transform(regexp_extract_all(upper(replace(text, 'ß', 'SS')), '[A-Z0-9'']+'), lambda w: CASE w WHEN 'THE' THEN 2 WHEN 'OF' THEN 3 ELSE 1 END) AS ids FROM documents")
def tokenize_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole words and their ids in a vocabulary of two."""
    vocabulary = F.create_map(F.lit("THE"), F.lit(2), F.lit("OF"), F.lit(3))
    words = X.whole_words(F.col("text"))
    d = P.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.size(words).cast("bigint").alias("n"), X.word_ids(words, vocabulary, 1).alias("ids"))
