"""Driver contract: registered queries pin UTC and every query has a callable."""

import os
import pathlib
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as E

from conftest import SF


def test_queries_pin_utc(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    n = E.queries()["parse_ssh_failed"](spark, SF).count()
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
    assert n > 0


def test_oracle_keys_subset_of_queries():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 90


@pytest.mark.parametrize("left", ["corpus_pipeline.py", None])
def test_imports_without_the_training_data_folders(tmp_path, left):
    root = pathlib.Path(E.__file__).resolve().parent
    shutil.copytree(root / "authlytics", tmp_path / "authlytics", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py"] + ([left] if left else []):
        shutil.copy(root / name, tmp_path)
    code = "import __spark_entry__ as E; q = E.queries(); assert 'pipeline' not in q and 'rep_text' in q; print(len(q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    # what PYTHONPATH names besides this repository (PySpark, say) stays
    rest = [x for x in sys.path if x and pathlib.Path(x).resolve() not in (root, root / "tests")]
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env | {"PYTHONPATH": os.pathsep.join(rest)},
                         capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) >= 90
