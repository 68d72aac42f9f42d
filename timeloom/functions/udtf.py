"""Table functions for SQL: a row in, rows out."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="place int, face int")
class SpeakerFaces:
    """The faces that a speaker ``ID_a/b`` names, with their places; none for other names."""

    def eval(self, speaker: str | None) -> Iterator[tuple[int, int]]:
        for place, part in enumerate((speaker or "").removeprefix("ID_").split("/")):
            if part.lstrip("-").isdigit():
                yield place, int(part)


def register(spark: SparkSession) -> None:
    """Make the functions known to SQL: ``SELECT * FROM segments, LATERAL speaker_faces(speaker)``."""
    spark.udtf.register("speaker_faces", SpeakerFaces)
