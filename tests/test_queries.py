"""Every registered query against its SQL, and the plans they run on."""

import os
import shutil
import subprocess
import sys
import tempfile

import pytest

import __spark_entry__ as entry
import compare
from inputs import SF


@pytest.fixture(scope="module")
def oracle():
    return compare.oracle(SF)


EXTRA = set(entry.llm_queries.queries()) if entry.llm_queries else set()
OWN = sorted(set(entry.queries()) - EXTRA)


def test_every_query_has_sql():
    assert set(OWN) == set(entry.oracle_sql()) - EXTRA


def test_without_the_subpackage(tmp_path):
    """The other queries are there when it, and the pipeline on it, are not."""
    here = os.path.dirname(os.path.abspath(entry.__file__))
    for name in os.listdir(here):
        if name not in ("corpus_pipeline.py", "gleanery", ".git"):
            os.symlink(f"{here}/{name}", tmp_path / name)
    shutil.copytree(f"{here}/gleanery", tmp_path / "gleanery",
                    ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{here}/__spark_entry__.py", tmp_path / "entry_copy.py")
    found = subprocess.run(
        [sys.executable, "-B", "-c", "import entry_copy as e; print(*sorted(e.queries()))"],
        cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True,
        text=True, timeout=120)
    assert found.stdout.split() == OWN, found.stderr


def test_queries_leave_nothing_in_the_temp_folder(spark):
    before = set(os.listdir(tempfile.gettempdir()))
    entry.queries()["archive_search"](spark, SF).count()
    entry.queries()["export_merge"](spark, SF).count()
    new = set(os.listdir(tempfile.gettempdir())) - before
    assert not [name for name in new if "glean" in name]


@pytest.mark.parametrize("name", OWN)
def test_query_equals_sql(spark, oracle, name):
    columns, mine, theirs, _ = compare.compare(
        spark, SF, name, entry.queries()[name], entry.oracle_sql()[name], oracle)
    assert columns and theirs
    assert mine == theirs


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_search_neither_shuffles_nor_repeats(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for dialect in ("native", "python"):
        pairs = entry.search_table(pages, ["page_id"], "url", "html", entry.PAGE_DEFS,
                                   dialect=dialect)
        text = plan(pairs)
        assert "Exchange" not in text and text.count("FileScan") == 1
        assert "ReadSchema: struct<page_id:bigint,url:string,html:string>" in text
        assert text.count("ArrowEvalPython") == (dialect == "python")
        assert text.count("regexp_extract_all(text") == (
            len(entry.PAGE_DEFS) if dialect == "native" else 0)


def test_staging_searches_once(spark):
    prepared = entry.prepare_table(spark.read.parquet(f"{SF}/pages.parquet"), ["page_id"],
                                   "url", "html")
    for dialect in ("native", "python"):
        text = plan(entry.search.search_records(prepared, entry.PAGE_DEFS, dialect))
        assert text.count("ArrowEvalPython") == (dialect == "python")
        assert text.count("regexp_extract_all(text") == (
            len(entry.PAGE_DEFS) if dialect == "native" else 0)


def test_export_is_combined_before_the_shuffle(spark):
    text = plan(entry.export_dedup(spark, SF))
    assert "partial_min" in text and "Window" not in text


def test_report_is_range_partitioned(spark):
    text = plan(entry.report_lines(spark, SF))
    assert "rangepartitioning(report" in text


def test_no_cross_join_in_any_plan(spark):
    for name in ("search_pairs", "theta_join", "matched_records", "run_summary"):
        text = plan(entry.queries()[name](spark, SF))
        assert "CartesianProduct" not in text and "NestedLoop" not in text, name
