"""The package reaches Python workers whatever folder the driver runs in."""
import os
import subprocess
import sys

import pytest

import __spark_entry__ as E
from recsmith import registry, session

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as E
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.driver.memory", "1g").getOrCreate()
print("rows", E.queries()["lexicon_sentiment"](spark, "/root/testdata/sf0.001").count())
"""


def test_a_query_with_python_workers_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "rows 200" in out.stdout, out.stderr[-2000:]


def test_a_missing_catalog_is_an_error(monkeypatch):
    monkeypatch.setattr(registry, "CATALOG_MODULES", [*registry.CATALOG_MODULES, "recsmith.plans.catalog_none"])
    with pytest.raises(ModuleNotFoundError):
        registry.load_all()


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session())


def test_entry_names():
    assert set(E.oracle_sql()) <= set(E.queries())
