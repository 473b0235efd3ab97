import re

import duckdb
import pytest

import __spark_entry__ as spark_entry
import check
from conftest import plan
from suite.views import spark_view

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    con.execute("SET TimeZone = 'UTC'")
    return con


@pytest.mark.parametrize("name", [n for n in spark_entry.queries() if n not in spark_entry.LLM_QUERIES])
def test_query_equals_its_sql(spark, con, name):
    df = spark_entry.queries()[name](spark, SF)
    got = check.table(df.columns, df.collect())
    sql = spark_entry.oracle_sql().get(name)
    if sql is None:
        assert got[1]
        return
    cur = con.execute(sql)
    assert got == check.table([d[0] for d in cur.description], cur.fetchall())


def test_entry(spark):
    assert spark_entry.entry(spark).count() > 0


# Arrow nodes belong to the byte histogram and to nothing else.
HISTOGRAM = {
    "byte_histogram", "fuzzy_search_observations", "fuzzy_search_functions", "attach_embeddings", "search_all_fuzzy",
    "build_index",
}
STORED = {
    "write_read_tables", "append_log", "export_snapshot", "ingest_observations", "quarantine_warnings",
    "ingest_observations_batches", "load_source_tree", "source_tree_stream", "stream_safe_ingest", "stream_merge",
    "stream_merge_logs", "close_stored_sessions", "mark_stored_incomplete", "partition_by_safety",
}


@pytest.mark.parametrize("name", [n for n in spark_entry.queries() if n not in STORED and n not in spark_entry.LLM_QUERIES])
def test_plan_is_native_and_without_cross_joins(spark, name):
    text = plan(spark_entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert bool(re.search(r"ArrowEvalPython|PythonUDF|MapInPandas", text)) == (name in HISTOGRAM)


@pytest.mark.parametrize("name", ["recent_observations", "filter_observations", "search_observations", "filter_sessions", "top_k"])
def test_limits_are_top_k(spark, name):
    assert "TakeOrderedAndProject" in plan(spark_entry.queries()[name](spark, SF))


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark_entry.queries()["observation_by_id"](spark, SF))
    assert "PushedFilters" in text
    text = plan(spark_entry.queries()["session_observation_counts"](spark, SF))
    assert "text:string" not in text.split("ReadSchema: ")[-1]


@pytest.mark.parametrize(
    "name",
    [
        "last_session_summary", "budget_pack_recent", "build_context_recent", "close_sessions", "latest_accepted",
        "recent_failures", "merge_observations", "collapse_signatures_shown",
    ],
)
def test_hot_groups_are_cut_before_the_shuffle(spark, name):
    """Each task keeps k rows per group, so the limit stands below an exchange."""
    text = plan(spark_entry.queries()[name](spark, SF))
    assert re.search(r"Exchange hashpartitioning.*\n.*WindowGroupLimit .* Partial", text)


@pytest.mark.parametrize(
    "name", ["session_observation_counts", "history_summary", "distinct_first_seen", "list_projects", "mark_incomplete"]
)
def test_counts_are_aggregated_before_the_shuffle(spark, name):
    text = plan(spark_entry.queries()[name](spark, SF))
    assert re.search(r"Exchange hashpartitioning.*\n.*HashAggregate.*partial_", text) or name == "list_projects"


# Positions of a text with many matches, texts of a row, and the like: the text itself passes no exchange.
@pytest.mark.parametrize("name", ["find_offsets", "scan_leaks", "scan_injection", "brace_depth", "extract_functions"])
def test_one_shuffle_at_most(spark, name):
    assert plan(spark_entry.queries()[name](spark, SF)).count("Exchange") <= 1


def test_log_appends_are_rebalanced(spark):
    df = spark_entry.queries()["append_log"](spark, SF).hint("rebalance", "project")
    assert "REBALANCE_PARTITIONS_BY_COL" in plan(df)


@pytest.mark.parametrize("files", [0, 3])
def test_the_stream_reads_a_table_of_many_files(spark, tmp_path, files):
    """``documents`` as a folder of files, also one without a row."""
    docs = spark.range(30 if files else 0).selectExpr("id AS doc_id", "concat('text ', id) AS text", "'en' AS lang", "'web' AS source", "7L AS n_chars")
    docs.repartition(max(1, files)).write.parquet(f"{tmp_path}/documents.parquet")
    got = spark_entry.queries()["stream_safe_ingest"](spark, str(tmp_path))
    assert sorted(r.content for r in got.collect()) == sorted(r.text for r in spark_view(spark, str(tmp_path), "v_planted").collect())
    assert got.columns == spark_entry.queries()["ingest_observations"](spark, str(tmp_path)).columns
