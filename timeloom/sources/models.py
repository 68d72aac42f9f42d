"""Where models plug in: typed contracts; the models themselves are functions of the user."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Contract:
    """Columns that a model reads and the schema of the rows that it returns."""

    reads: tuple[str, ...]
    schema: str


CONTRACTS = {
    "face_detector": Contract(("clip", "frame", "image"), "clip string, frame int, x1 double, y1 double, x2 double, y2 double, conf double"),
    "shot_detector": Contract(("clip", "content"), "clip string, shot int, f0 int, f1 int"),
    "lip_sync": Contract(("clip", "track", "content"), "clip string, track int, frame int, d array<double>"),
    "face_embedding": Contract(("clip", "track", "content"), "clip string, track int, vectors array<array<double>>"),
    "voice_activity": Contract(("clip", "source", "samples"), "clip string, source string, frame int, score double"),
    "speaker_embedding": Contract(("clip", "samples"), "clip string, hop int, v array<double>"),
    "landmarks": Contract(("clip", "frame", "image"), "clip string, frame int, points array<struct<x:double,y:double>>"),
    "face_attributes": Contract(("clip", "content"), "clip string, frame int, v array<double>"),
    "recogniser": Contract(("clip", "track", "content"), "clip string, track int, text string"),
}


def apply(df: DataFrame, contract: Contract, model: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Rows that a model makes of batches of ``df``; only the columns it reads are passed."""
    names = [f.strip().split(" ")[0] for f in top_level(contract.schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield model(batch)[names]

    return df.select(*contract.reads).mapInPandas(run, contract.schema)


def top_level(schema: str) -> list[str]:
    """Fields of a schema string, not split inside ``<>``."""
    out, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out
