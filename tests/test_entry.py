import os
import pathlib
import shutil
import subprocess
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]


def test_sql_needs_no_session_and_no_jars(tmp_path):
    code = "import __spark_entry__ as e; s, q = e.oracle_sql(), e.queries(); assert len(s) > 60 and set(s) <= set(q)"
    env = os.environ | {"PYTHONPATH": str(ROOT), "SPARK_HOME": str(tmp_path)}
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=env, check=True, timeout=120)


@pytest.mark.parametrize("left", [["corpus_pipeline.py"], [], ["compiled"]])
def test_works_without_the_optional_folder(tmp_path, left):
    """Deleted folders, with the pipeline's file or compiled files left behind or not."""
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name == "__spark_entry__.py" or name in left:
            shutil.copy(ROOT / name, tmp_path / name)
    for name in ("newsloom", "checks"):
        shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    if "compiled" in left:
        (tmp_path / "newsloom" / "llm" / "__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; s, q = e.oracle_sql(), e.queries(); assert len(q) > 60 and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True, timeout=120)


def test_base_lists_are_the_shipped_ones(spark):
    from pyspark.ml.feature import StopWordsRemover

    from newsloom.functions import lexicon

    for name in lexicon.LANGUAGES:
        shipped = {w.lower() for w in StopWordsRemover.loadDefaultStopWords(name)}
        assert set(lexicon.base_words(name)) == shipped


def test_history_counts_as_earlier_whatever_its_ids(spark):
    from newsloom.operators import joins

    rows = spark.createDataFrame([(100, 0), (7, 0), (5, 1), (200, 1)], "id long, late int")
    got = {r.id: r.place for r in joins.arrival(rows, "late", "id").collect()}
    assert got == {7: 0, 100: 1, 5: 2, 200: 3}
