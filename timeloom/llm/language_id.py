"""Language identification by Bayesian fusion of evidence.

Four kinds of evidence about a text's language are combined as probabilities:

* the text: byte trigrams under a model of each language, tempered, as the trigrams
  of a text are far from independent;
* the language its markup declares: how often texts of each language declare it;
* its host: the share of each language among the host's texts, smoothed by that
  of the address suffix, which is smoothed by that of the whole corpus;
* its suffix, by the same hierarchy, where the host says little.

Every language that two or more texts declare is modelled.  Only the trigram models are fitted on
a sample, stratified by language: about ``train_rows`` labelled rows, more where languages are many.
Counts by declared language, suffix and host are grouped aggregations over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, slices, small_batches, utf8

BUCKET_BITS = 15
#: Letters in lower case; bytes of other characters as they are; all else one blank.
FOLDED = np.array([b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)], np.uint8)
#: Hosts of which a table may be broadcast.
BROADCAST_HOSTS = 100_000


@dataclass(frozen=True)
class Settings:
    """Parameters: the bounds of the training sample, and weights.

    ``train_rows`` are dealt evenly to the languages, ``least_rows`` at the least to each that has them.
    ``temper``: trigrams beyond about this many add little; ``strength``: rows that a level's
    prior counts for; ``slack``: how far (in nats a trigram) a text may lie under its language's training
    mean; ``least``: the posterior that an accepted language needs.
    """

    train_rows: int = 3000
    least_rows: int = 200
    temper: float = 100.0
    strength: float = 20.0
    slack: float = 5.5
    least: float = 0.5


def buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of all texts, and the text of each; trigrams of blanks only are left out."""
    b = FOLDED[data].astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]
    inside = np.ones(len(code), bool)
    for edge in (1, 2):  # trigrams over the border of two texts
        at = offsets[1:-1] - edge
        inside[at[(at >= 0) & (at < len(code))]] = False
    blank = b == 32
    inside &= ~((blank[:-2] & blank[1:-1]) | (blank[1:-1] & blank[2:]))
    at = np.flatnonzero(inside)
    hashed = (code[at] * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)
    return hashed.astype(np.int64), np.searchsorted(offsets, at, side="right") - 1


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # log-probabilities, by language and bucket
    means: np.ndarray  # of the training texts, by language

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean log-likelihood of a trigram in each language, and the number of trigrams."""
        n = len(offsets) - 1
        bucket, owner = buckets(data, offsets)
        count = np.bincount(owner, minlength=n)
        out = np.zeros((n, len(self.languages) + 1))
        out[:, -1] = count
        # a language at a time, so that memory does not grow with languages times trigrams
        for i, own in enumerate(self.weights):
            out[:, i] = np.bincount(owner, weights=own[bucket], minlength=n) / np.maximum(1, count)
        return out


def fit(df: DataFrame, key: str, text: str, declared: str, how: Settings) -> Model:
    """Trigram models of every language that two rows or more declare, from a sample of rows of each."""
    rows = df.select(df[key].alias("key"), F.lower(F.substring_index(df[declared], "-", 1)).alias("lang"), df[text].alias("text")).where("lang <> '' and text <> ''")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).where("n >= 2").collect()}
    languages = sorted(counts)
    quota = max(how.least_rows, how.train_rows // max(1, len(languages)))
    shares = [F.lit(int(min(1.0, quota / counts[x]) * (1 << 30))) for x in languages]
    share = F.coalesce(F.get(F.array(*shares), F.array_position(strings(languages), F.col("lang")).cast("int") - 1), F.lit(0)) if languages else F.lit(0)
    chosen = rows.where(F.col("lang").isin(languages) & (F.pmod(F.xxhash64("key", F.length("text")), F.lit(1 << 30)) < share))
    size, number = 1 << BUCKET_BITS, {x: i for i, x in enumerate(languages)}
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(number) * size, np.int64)
        for batch in batches:
            label = np.array([number[x] for x in batch.column(0).to_pylist()], np.int64)
            data, offsets = utf8(batch.column(1))
            for lo, hi in slices(offsets):
                bucket, owner = buckets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                found += np.bincount(label[lo:hi][owner] * size + bucket, minlength=len(found))
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], names=["at", "n"])

    table = np.zeros(max(1, len(languages)) * size)
    if languages:
        # at most a number for each language and bucket comes to the driver
        for r in chosen.select("lang", "text").mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect():
            table[r["at"]] = r["n"]
    table = table.reshape(-1, size)
    p = (table + 0.5) / (table.sum(1, keepdims=True) + 0.5 * size)
    means = (table * np.log(p)).sum(1) / np.maximum(1, table.sum(1))
    return Model(languages, np.log(p).astype(np.float32), means)


def address_suffix(host: Column) -> Column:
    """What follows the last dot of a host, without a port; null where there is no dot."""
    found = F.regexp_extract(F.lower(host), r"\.([^.:/]+)(?::\d+)?$", 1)
    return F.when(found != "", found)


def scored(df: DataFrame, model: Model, text: str, declared: str, host: str) -> DataFrame:
    """``row`` (all of ``df`` as a struct, so that no name clashes), ``scores`` of its text and the other evidence."""
    own = df.select(
        F.struct(*(df[c] for c in df.columns)).alias("row"),
        F.lower(F.substring_index(df[declared], "-", 1)).alias("declared"),
        df[host].alias("host"),
        address_suffix(df[host]).alias("suffix"),
    )
    at = df.columns.index(text)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0).field(at))
            parts = [model.scores(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in slices(offsets)]
            flat = np.concatenate(parts) if parts else np.zeros((0, len(model.languages) + 1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "scores"])

    return own.mapInArrow(run, T.StructType([*own.schema.fields, T.StructField("scores", T.ArrayType(T.DoubleType()))]))


def identify(df: DataFrame, key: str = "doc_id", text: str = "text", declared: str = "lang", host: str = "source", how: Settings = Settings()) -> DataFrame:
    """``df`` with ``language``, ``confidence`` and ``accepted`` appended (replacing columns so named).

    ``language`` is that of the largest posterior, ``und`` where a text has no trigram of letters, lies too
    far under its language's training texts, or no language reaches ``how.least``; such rows are
    not accepted.  Null or empty texts have no evidence of their own and are ``und``.  A null or unknown
    declared language, and a null host, are evidence values like others or fall back to the level above.  Rows
    that repeat a key are judged each for itself.  Of languages with the same posterior the first by name wins.  A row is one of
    those whose votes make its host's prior.  Columns keep their values whatever their names.  Without any labelled row nothing is accepted.
    """
    model = fit(df, key, text, declared, how)
    names = model.languages
    size = len(names)
    columns = [c for c in df.columns if c not in ("language", "confidence", "accepted")]
    base = df.select(*(df[c] for c in columns))
    if not size:
        return base.withColumns({"language": F.lit("und"), "confidence": F.lit(0.0), "accepted": F.lit(False)})
    rows = scored(base, model, text, declared, host)
    scores = F.slice("scores", 1, size)
    letters = F.element_at("scores", -1)
    best = F.array_position(scores, F.array_max(scores)).cast("int")
    told = F.when(F.col("declared").isin(names), F.col("declared")).otherwise("")
    votes = scored(base.select(*(base[c] for c in dict.fromkeys((text, declared, host)))), model, text, declared, host).where(letters > 0)
    votes = votes.select(best.alias("best"), told.alias("told"), F.coalesce("host", F.lit("")).alias("host"), F.coalesce("suffix", F.lit("")).alias("suffix"))
    counts = votes.groupBy("host", "suffix", "told", "best").agg(F.count("*").alias("n"))
    counts = materialise(counts, "votes")
    by = lambda *k: counts.groupBy(*k, "best").agg(F.sum("n").alias("n"))
    # languages by declared language, and over all rows: as many numbers as pairs of languages
    channel, place_of = np.zeros((size + 1, size)), {"": size} | {x: i for i, x in enumerate(names)}
    for r in by("told").collect():
        channel[place_of[r["told"]], r["best"] - 1] = r["n"]
    overall = (channel.sum(0) + 1) / (channel.sum() + size)
    says = np.log((channel + how.strength * 0.05 / size) / (channel.sum(0) + how.strength * 0.05))
    # of each suffix and host at most a number for each language
    votes_of = lambda *k: by(*k).groupBy(*k).agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("best", "n"))).alias("of"))
    smoothed = lambda prior: F.transform(prior, lambda p, i: (F.coalesce(F.element_at("of", i + 1), F.lit(0)) + how.strength * p) / (F.col("total") + how.strength))
    suffixes = votes_of("suffix").select("suffix", smoothed(doubles(overall)).alias("above"))
    hosts = votes_of("host", "suffix").join(suffixes, "suffix")
    share = F.transform(smoothed(F.col("above")), lambda p: F.log(p))
    hosts = materialise(hosts.select(F.col("host").alias("of_host"), share.alias("prior")), "hosts")
    small = hosts.count() <= BROADCAST_HOSTS
    joined = rows.join(F.broadcast(hosts) if small else hosts, F.coalesce("host", F.lit("")) == F.col("of_host"), "left")
    heard = df.sparkSession.createDataFrame([(x, says[i].tolist()) for x, i in place_of.items()], "told string, heard array<double>")
    joined = joined.join(F.broadcast(heard), told == F.col("told"), "left")  # a row for each language
    prior = F.coalesce("prior", doubles(np.log(overall)))
    weight = letters * how.temper / (letters + how.temper)
    posterior = F.transform(F.arrays_zip(scores.alias("s"), F.col("heard").alias("d"), prior.alias("p")), lambda x: x["s"] * weight + x["d"] + x["p"])
    joined = joined.withColumn("posterior", posterior)
    top = F.array_max("posterior")
    confidence = 1.0 / F.aggregate("posterior", F.lit(0.0), lambda s, x: s + F.exp(x - top))
    joined = joined.withColumns({"place": F.array_position("posterior", top).cast("int"), "sure": confidence})
    mean, floor = F.element_at("scores", F.col("place")), F.element_at(doubles(model.means - how.slack), F.col("place"))
    accepted = F.coalesce((letters > 0) & (mean >= floor) & (F.col("sure") >= how.least), F.lit(False))
    language = F.when(accepted, F.element_at(strings(names), F.col("place"))).otherwise("und")
    found = joined.select("row", language.alias("language"), F.when(letters > 0, F.col("sure")).otherwise(0.0).alias("confidence"), accepted.alias("accepted"))
    return found.select(*(F.col("row").getField(c).alias(c) for c in columns), "language", "confidence", "accepted")


def doubles(values: np.ndarray) -> Column:
    return F.array(*(F.lit(float(x)) for x in values))


def strings(values: list[str]) -> Column:
    return F.array(*(F.lit(x) for x in values))
