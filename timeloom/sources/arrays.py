"""Archives of named arrays (NPZ), one file a clip, and listings of files that stand elsewhere."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import name_of


def archive(arrays: dict[str, Sequence[float]]) -> bytes:
    """The bytes of an archive."""
    out = io.BytesIO()
    np.savez(out, **{k: np.asarray(v, np.float32) for k, v in arrays.items()})
    return out.getvalue()


def archives(df: DataFrame, key: str, arrays: str) -> DataFrame:
    """``key, content``: an archive for each row's map of names to arrays of numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "content": [archive(dict(m)) for m in pdf[arrays]]})

    return df.select(key, F.col(arrays).cast("map<string,array<double>>").alias(arrays)).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, content binary")


def read_archives(files: DataFrame, required: Sequence[str], frames: int | None = None) -> DataFrame:
    """``path, stem, good, values`` of archives (``path, content``): the required arrays side by side, a row a frame.

    An archive that cannot be read, lacks a required array or whose arrays differ in length is not good and holds zeros
    (``frames`` rows; none if that is not given).  With ``frames`` good ones are cut or padded with zeros to that many rows.
    """
    names = sorted(required)

    def table(content: bytes) -> np.ndarray | None:
        try:
            with np.load(io.BytesIO(content), allow_pickle=False) as held:
                columns = [np.asarray(held[n], np.float64).ravel() for n in names]
        except Exception:  # noqa: BLE001 - whatever is wrong with a file, it is not good
            return None
        return np.stack(columns, 1) if columns and len({len(c) for c in columns}) == 1 else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [table(c) for c in pdf["content"]]
            rows = []
            for t in found:
                values = t if t is not None else np.zeros((0, len(names)))
                if frames is not None:
                    values = np.concatenate([values[:frames], np.zeros((max(0, frames - len(values)), len(names)))])
                rows.append(values.tolist())
            yield pd.DataFrame({"path": pdf["path"], "good": [t is not None for t in found], "values": rows})

    rows = files.select("path", "content").mapInPandas(run, "path string, good boolean, values array<array<double>>")
    return rows.select("path", name_of(F.col("path")).alias("stem"), "good", "values")


def npz(spark: SparkSession, path: str, required: Sequence[str], frames: int | None = None) -> DataFrame:
    """:func:`read_archives` of the files below a folder."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", True).load(path)
    return read_archives(found, required, frames)


def one_a_stem(found: DataFrame) -> DataFrame:
    """``stem, path``: the flat ``stem.npz`` rather than the nested ``stem/stem.npz``, as the shorter path."""
    return found.groupBy("stem").agg(F.min_by("path", F.struct(F.length("path"), "path")).alias("path"))


def listed(listing: DataFrame, suffix: str) -> DataFrame:
    """``repo, path, stem`` of a listing's files with a suffix; listings of remote stores are given as tables (repo, path)."""
    return listing.where(F.endswith(F.lower("path"), F.lit(suffix.lower()))).select("repo", "path", name_of(F.col("path")).alias("stem"))
