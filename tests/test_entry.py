"""The driver's contract."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__
import pytest
from timeloom import storage

TOP = Path(__file__).resolve().parents[1]


def test_queries_and_sql_agree():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 60
    assert all(callable(q) for q in queries.values())


def test_library_works_without_the_corpus_part(tmp_path):
    """A copy without the pipeline and the two folders still imports, lists its queries and collects its tests."""
    top = tmp_path / "copy"
    shutil.copytree(TOP, top, ignore=lambda folder, names: [n for n in names if n in (".git", "llm", "corpus_pipeline.py") or n.endswith((".md", ".json", ".txt"))])
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) >= 60 and set(e.oracle_sql()) <= set(q); assert not any(n == 'pipeline' or n[:2] == 'op' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=top, check=True)
    found = subprocess.run([sys.executable, "-m", "pytest", "tests", "--collect-only", "-q"], cwd=top, check=True, capture_output=True, text=True)
    assert "error" not in found.stdout.lower().splitlines()[-1]


def test_no_shared_folder_off_local_mode():
    """Without a shared folder a cluster's executors would write to their own disks."""

    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session())


def test_tables_can_be_cleared(spark):
    df = storage.materialise(spark.range(3), "three")
    assert df.count() == 3
    kept = storage.written(spark)
    storage.clear(spark)
    assert kept and not storage.written(spark)
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(kept[-1]).count()
