"""The registered queries against their SQL, and what their plans must not hold."""

import ast
import glob
import os
import sys

import duckdb
import pytest

from broadsheet.session import shared_dir
from checks.queries import ORACLES, QUERIES
from checks.views import TABLES, Tables
from verify import normal

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")

# These run Spark jobs over stores; tests/test_jobs.py covers them.
JOBS = {n for n in QUERIES if n.startswith(("job_", "stream_"))}
# The user's own Python is the point of these.
PYTHON = {"score_with", "score_opened"}


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(QUERIES) - JOBS))
def test_query(spark, con, plan, name):
    df = QUERIES[name](spark, SF)
    result = con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert normal(df.collect(), df.columns) == normal(result.fetchall(), columns)
    text = plan(df)
    assert "CartesianProduct" not in text
    if name not in PYTHON:
        assert "Python" not in text and "MapInPandas" not in text


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_scan_reads_only_what_is_used(spark, plan):
    text = plan(QUERIES["by_category"](spark, SF))
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,fr)]" in text
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string,source:string>" in text
    assert Tables(spark, SF)["labels"].columns == ["doc_id", "quality", "toxic"]


def test_no_name_of_the_module_is_given_twice():
    """Queries are built after the module has run: a name given again would reach the earlier query too."""
    with open(sys.modules[QUERIES["by_url"].__module__].__file__, encoding="utf-8") as file:
        body = ast.parse(file.read()).body
    names = [target.id for node in body if isinstance(node, ast.Assign) for target in node.targets if isinstance(target, ast.Name)]
    assert sorted(names) == sorted(set(names))


def test_repeated_deliveries_are_written_by_all_tasks(spark, con, tmp_path):
    """One task that wrote a whole delivery read the whole table."""
    spark.read.parquet(f"{SF}/documents.parquet").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    before = set(glob.glob(f"{shared_dir(spark)}/landing-*"))
    got = QUERIES["stream_repeats"](spark, str(tmp_path))
    result = con.execute(ORACLES["stream_repeats"])
    columns = [d[0] for d in result.description]
    assert normal(got.select(*columns).collect(), columns) == normal(result.fetchall(), columns)
    (landing,) = set(glob.glob(f"{shared_dir(spark)}/landing-*")) - before
    assert len(glob.glob(f"{landing}/part-*")) > 3
