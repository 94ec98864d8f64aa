import glob
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from tools.compare import canonical
from wavetrail.plans.catalog import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"

# a cross-section; tools/compare.py runs all of them
SAMPLE = [
    "detect_congestion", "observation_outcome", "span_rejects", "partial_success", "dispatch_pass", "dispatch_loop", "write_reroutes",
    "outbox_state", "record_receipts", "immutable_columns", "model_first_violation", "resolve_routes",
    "run_results", "q_offset", "q_order_desc", "q_group_by", "p_not", "dml_update", "read_baselines",
    "read_process_models", "write_observation_log", "baseline_threshold",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        c.execute(f"create view {name} as select * from read_parquet('{path}')")
    return c


def test_every_query_has_sql_that_binds(con):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(QUERIES) == set(ORACLES) <= set(sql) <= set(queries) and len(QUERIES) > 150
    for text in sql.values():
        con.execute("explain " + text)


def test_entry_imports_without_the_optional_parts(tmp_path):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(f"{root}/wavetrail", tmp_path / "wavetrail", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, check=True)
    assert out.stdout.split() == [str(len(QUERIES)), str(len(ORACLES))]


def test_entry_gives_alerts(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    got = canonical(entry.queries()[name](spark, SMALL).toPandas())
    want = canonical(con.execute(entry.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(want) > 0 and got.equals(want)
