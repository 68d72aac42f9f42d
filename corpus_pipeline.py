"""A corpus pipeline over documents: language, repeated lines, near duplicates, packing."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeloom.llm import language_id, line_dedup, ngram_join, packing
from timeloom.llm.common import materialise
from timeloom.llm.queries import WORD_BPE

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: The columns of documents.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near duplicates share four fifths of their five-word shingles.
NEAR_WORDS, NEAR = 5, ngram_join.Similarity(80, 100)
#: Characters from which one edit makes no other line: shorter ones, such as numbers of a list, go only when equal.
SHORTEST = 20


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; the others go, among them those without text or without letters.

    Ids play no part: rows that repeat one, or have none, are judged each for itself.
    """
    return language_id.identify(docs).where("accepted").select(*COLUMNS)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that earlier ones repeat; those that lose all they said go.

    Earlier is what has a smaller id.  Rows that repeat an id follow each other in the order of a hash of their texts, rows without
    one come last.  A document that was blank or empty stays as it is, a null text becomes an empty one.
    """
    found = line_dedup.dedup(docs, carry=("lang", "source"), shortest=SHORTEST)
    said = F.length(F.trim(F.translate("text", "\t\n\r\x0b\x0c", "     "))) > 0
    kept = found.where(said | (F.col("n_kept") == F.col("n_lines")))
    return kept.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document: that with the smallest id, the first of rows that repeat it.

    Rows are told apart by a number of their own, so copies that share an id, or have none, go as others do; a row without an id
    stays only where all of its group lack one.  Texts without words are near to nothing and stay.
    """
    rows = materialise(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "rows")
    groups = materialise(ngram_join.join(rows, key="row", words=NEAR_WORDS, like=NEAR), "groups")
    linked = groups.where("component_id < row").select("row", "component_id")
    linked = linked.unionByName(linked.select(F.col("component_id").alias("row"), "component_id").distinct())
    members = materialise(linked.join(rows.select("row", "doc_id"), "row"), "members")
    # a null id comes last
    kept = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))["row"].alias("kept"))
    removed = materialise(members.join(kept, "component_id").where("row <> kept").select("row"), "removed")
    few = removed.count() <= ngram_join.BROADCAST_ROWS
    return rows.join(F.broadcast(removed) if few else removed, "row", "left_anti").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents, packed into sequences of 4096; an empty or null text is one piece of its end mark."""
    return packing.pack_documents(docs, public_tokenizers.path(WORD_BPE))


STAGES: list[tuple[str, Stage]] = [("language", known_language), ("lines", fresh_lines), ("near", one_of_each), ("packing", packed)]
#: Language models and packing by a genetic algorithm have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents; each stage is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
