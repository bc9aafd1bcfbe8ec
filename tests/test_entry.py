import importlib.util
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__

REPO = Path(__spark_entry__.__file__).parent
ROWS_ONLY = sorted(set(__spark_entry__.plans.QUERIES) - set(__spark_entry__.plans.ORACLES))


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_queries_without_an_oracle_give_rows(spark, sf, name):
    assert __spark_entry__.plans.QUERIES[name](spark, sf).count() > 0


def test_the_rest_imports_without_the_llm_folders(tmp_path):
    shutil.copytree(REPO, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'asof_snapshot' in q and not any(k.startswith('op') or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, timeout=120)


def test_nothing_outside_imports_llm():
    if importlib.util.find_spec("tessera.llm") is None:
        return
    for p in (REPO / "tessera").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p


def test_plans_push_down_and_avoid_nested_loops(spark, sf):
    plan = lambda n: __spark_entry__.plans.QUERIES[n](spark, sf)._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = plan("stat_scan")
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(l_shipdate" in text and "LessThanOrEqual(l_quantity" in text
    for name in ("knn_vote", "point_in_rings", "bbox_bucket_join", "beyond_range_join", "or_join", "majority_disc"):
        text = plan(name)
        assert "NestedLoop" not in text and "Cartesian" not in text, name
