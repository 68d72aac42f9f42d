"""Longest-match tokens of a fixed vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeloom.functions.text import whole_words


def pieces(word: str, vocabulary: dict[str, int], longest: int, unknown: int) -> list[int]:
    """Ids of a word with a leading mark: at each place the longest piece, else the unknown id for one character."""
    out, at = [], 0
    text = "▁" + word
    while at < len(text):
        for n in range(min(longest, len(text) - at), 0, -1):
            if (i := vocabulary.get(text[at : at + n])) is not None:
                out.append(i)
                at += n
                break
        else:
            out.append(unknown)
            at += 1
    return out


def greedy(df: DataFrame, key: str, text: str, vocabulary: dict[str, int], unknown: int) -> DataFrame:
    """``key, ids`` of upper-case words; each distinct word is cut once a batch."""
    longest = max(map(len, vocabulary), default=0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            known: dict[str, list[int]] = {}
            rows = []
            for words in pdf["words"]:
                ids: list[int] = []
                for w in words if words is not None else ():
                    if w not in known:
                        known[w] = pieces(w, vocabulary, longest, unknown)
                    ids += known[w]
                rows.append(ids)
            yield pd.DataFrame({key: pdf[key], "ids": rows})

    words = df.select(key, F.coalesce(whole_words(F.col(text)), F.array().cast("array<string>")).alias("words"))
    return words.mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, ids array<int>")
