"""Captions: which say the same at the same time."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timeloom.functions.text import jaccard, word_set

from . import intervals


def similar_pairs(captions: DataFrame, key: str, threshold: float, width: int) -> DataFrame:
    """Pairs ``a < b`` (by ``turn``) of overlapping captions whose word sets reach the threshold."""
    c = captions.select(key, "turn", "t0", "t1", word_set(F.col("text")).alias("words"))
    met = intervals.join(c, c, [key], width).where("turn < b_turn").withColumn("score", jaccard(F.col("words"), F.col("b_words")))
    return met.where(F.col("score") >= threshold).select(key, F.col("turn").alias("a"), F.col("b_turn").alias("b"), "score")


def dedup(captions: DataFrame, key: str, threshold: float) -> DataFrame:
    """Captions of each key without those that an overlapping kept one already says.

    In the order of start, longer texts first: the first kept caption that overlaps with enough
    common words absorbs the caption, and takes its text and bounds if that is longer.
    """
    schema = captions.schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.assign(__n=-pdf["text"].fillna("").str.len()).sort_values(["t0", "__n", "turn"]).drop(columns="__n")
        kept: list[dict] = []
        sets: list[set] = []
        for row in rows.to_dict("records"):
            mine = words_of(row["text"])
            for i, other in enumerate(kept):
                either = sets[i] | mine
                if row["t0"] < other["t1"] and other["t0"] < row["t1"] and either and len(sets[i] & mine) / len(either) >= threshold:
                    if len(row["text"] or "") > len(other["text"] or ""):
                        kept[i], sets[i] = row, mine
                    break
            else:
                kept.append(row)
                sets.append(mine)
        return pd.DataFrame(kept, columns=[f.name for f in schema.fields])

    return captions.groupBy(key).applyInPandas(run, schema)


def words_of(text: str | None) -> set[str]:
    out, word = set(), []
    for c in (text or "").lower() + " ":
        if "a" <= c <= "z" or c == "'":
            word.append(c)
        else:
            if len(word) > 1:
                out.add("".join(word))
            word = []
    return out


def attribute(segments: DataFrame, texts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Transcript rows of segments that have a track: text by track (empty where there is none), rows that follow
    each other in start order on the same track joined (first speaker and text, latest end)."""
    rows = segments.join(texts, [*keys, "track"], "left").withColumn("text", F.coalesce("text", F.lit("")))
    order = Window.partitionBy(*keys).orderBy("t0", "track", "t1")
    new = F.when(F.lag("track").over(order) == F.col("track"), 0).otherwise(1)
    numbered = rows.withColumn("__new", new).withColumn("__g", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = lambda c: F.min_by(c, F.struct("t0", "t1", "speaker")).alias(c)
    return numbered.groupBy(*keys, "__g", "track").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"), first("speaker"), first("text")).drop("__g")
