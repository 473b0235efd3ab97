import json
import os

import pytest
from pyspark.sql import functions as F

from conftest import plan, rows
from textlake.operators import code, history
from textlake.plans.index import build_index, search_all
from textlake.session import ensure_shared_dir, shared_dir
from textlake.sources import files, tables

SRC = "export func batch_cosine(q) {\n let v: f32x8 = load(q)\n}\n"


def put(root, name, text=SRC):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "proj [a]{b}"
    for name in ["a.ea", "kernels/b.ea", "nested/deep/c d.ea", "kernels/readme.md"]:
        put(root, name)
    for skipped in ["target", ".git", "node_modules", "venv", "__pycache__", "nested/build", "kernels/deep/dist"]:
        put(root, f"{skipped}/x.ea")
    return root


def test_source_tree(spark, tree):
    got = files.load_source_tree(spark, [str(tree)])
    names = [os.path.relpath(r.path, tree) for r in got.orderBy("root_no", "path").collect()]
    assert names == ["a.ea", "kernels/b.ea", "nested/deep/c d.ea"]
    assert {r.length for r in got.collect()} == {len(SRC)}


def test_missing_and_overlapping_roots(spark, tree):
    roots = [str(tree), str(tree / "nowhere"), str(tree / "kernels") + "/"]
    got = files.load_source_tree(spark, roots)
    assert sorted((r.root_no, os.path.basename(r.path)) for r in got.collect()) == [
        (0, "a.ea"),
        (0, "b.ea"),
        (0, "c d.ea"),
        (2, "b.ea"),
    ]
    empty = files.load_source_tree(spark, [str(tree / "nowhere")])
    assert empty.count() == 0 and empty.columns == got.columns
    # A skipped name is only skipped below a root.
    assert files.load_source_tree(spark, [str(tree / "target")]).count() == 1


def test_one_vector_per_path_below_three_roots(spark, tmp_path):
    for name in ["a/c.ea", "b/c.ea", "b/s/c.ea"]:
        put(tmp_path, name)
    found = files.load_source_tree(spark, [str(tmp_path / r) for r in ("a", "b", "b/s")])
    no_catalog = spark.createDataFrame([], "ordinal int, name string, category string, signature string, description string")
    functions, embeddings, _ = build_index(found, no_catalog)
    assert functions.count() == 4 and embeddings.count() == 3
    assert code.attach_embeddings(functions, embeddings).count() == 4


def test_index_build_store_and_search(spark, tree, tmp_path):
    found = files.load_source_tree(spark, [str(tree), str(tree / "kernels")])
    curated = spark.createDataFrame(
        [(0, "fma", "intrinsic", "fma(a, b, c)", "Fused multiply-add")],
        "ordinal int, name string, category string, signature string, description string",
    )
    doc = spark.createDataFrame([("x.rs", "/// dot(a) -> b (tag)\n/// fma(x) -> y\n")], "path string, text string")
    arms = spark.createDataFrame([('"dot" => a, "hidden" | "b"',)], "text string")
    functions, embeddings, catalog = build_index(found, curated, doc, arms)
    tables.write_tables(str(tmp_path / "ix"), F.lit(7).cast("bigint"), functions=functions, catalog=catalog, embeddings=embeddings)
    stored = tables.read_tables(spark, str(tmp_path / "ix"))
    meta = stored["meta"].first()
    # Four listed functions (one file is below both roots), three files, and
    # the scraped names that the curated entries lack.
    assert (meta.functions_count, meta.embeddings_count, meta.catalog_count, meta.built_at) == (4, 3, 3, 7)
    assert rows(stored["catalog"].orderBy("origin", "name"), "name", "signature") == [
        ("fma", "fma(a, b, c)"),
        ("dot", "dot(a) -> b"),
        ("hidden", "hidden(...) -> ?"),
    ]
    fns = stored["functions"]
    no_log = spark.createDataFrame([], "id string, type string, content string, created_at bigint, project string")
    hits = search_all(fns, no_log, "COSINE", files=found.where("root_no = 0"))
    assert [(r.rank, r.total, r.simd_width, r.line_count, r.snippet) for r in hits.collect()] == [(i, 4, 8, 3, SRC.strip()) for i in range(1, 5)]
    assert [r.rank for r in search_all(fns, no_log, "COSINE", function_limit=None).collect()] == [None] * 4
    attached = code.attach_embeddings(fns, stored["embeddings"])
    assert attached.count() == 4
    assert search_all(fns, no_log, "cosine", scope="memory").count() == 0
    assert search_all(fns, no_log, "cosine", scope="functions", arch="aarch64").count() == 0


def test_shared_folder_is_the_one_the_session_names(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    first, second = shared_dir(spark, "x"), shared_dir(spark, "x")
    assert first.startswith(base + "/x-") and first != second


def test_a_session_without_a_shared_folder(spark):
    class Conf(dict):
        set = dict.__setitem__

    class Session:
        def __init__(self, master):
            self.conf, self.sparkContext = Conf(), type("Context", (), {"master": master})

    alone, cluster = Session("local[2]"), Session("spark://host:7077")
    for session in (alone, cluster):
        with pytest.raises(ValueError):
            shared_dir(session, "x")
        ensure_shared_dir(session)
    assert shared_dir(alone, "x") != shared_dir(alone, "x")
    with pytest.raises(ValueError):
        shared_dir(cluster, "x")


def test_names_that_spark_hides(spark, tmp_path):
    names = ["a.ea", "_top.ea", ".dot.ea", "_lib/x.ea", ".hid/e.ea", "k/_h.ea", "k/.h.ea", "k/b.ea", "k/_in/c.ea", "k/sub/d.ea"]
    for name in names:
        put(tmp_path, name)
    for skipped in [".git/_x.ea", "k/.venv/x.ea", "a.eab"]:
        put(tmp_path, skipped)
    got = files.load_source_tree(spark, [str(tmp_path)])
    assert sorted(os.path.relpath(r.path, tmp_path) for r in got.collect()) == sorted(names)
    below = spark.createDataFrame([(n,) for n in [*names, ".git/_x.ea", "k/.venv/x.ea", "a.eab"]], "below string")
    assert below.where(files.is_source(F.col("below"))).count() == len(names)


def test_files_that_cannot_be_read_are_reported(spark, tmp_path):
    put(tmp_path, "a.ea")
    os.symlink(tmp_path / "nowhere", tmp_path / "gone.ea")
    assert files.load_source_tree(spark, [str(tmp_path)]).count() == 1
    skipped = files.load_source_tree(spark, [str(tmp_path)], skipped=True).collect()
    assert [os.path.basename(r.path) for r in skipped] in (["gone.ea"], [])
    listed = spark.createDataFrame([(str(tmp_path / "a.ea"),), (str(tmp_path / "vanished.ea"),)], "path string")
    got = {os.path.basename(r.path): (r.content, r.error is None) for r in files.read_files(listed).collect()}
    assert got == {"a.ea": (SRC.encode(), True), "vanished.ea": (None, False)}


def test_scrape_sources(spark, tmp_path):
    for name in ["intrinsics_a.rs", "intrinsics_b.rs", "intrinsics.rs", "other.rs", "deep/intrinsics_c.rs"]:
        put(tmp_path, f"one/src/typeck/{name}", name)
    put(tmp_path, "two/src/intrinsics_a.rs", "x")
    (tmp_path / "one/src/typeck/intrinsics_c.rs").write_bytes(b"\xffc")
    documented, dispatch = files.load_scrape_sources(spark, [str(tmp_path / "one"), str(tmp_path / "two"), str(tmp_path / "none")])
    assert sorted(rows(documented, "text")) == [("intrinsics_a.rs",), ("intrinsics_b.rs",), ("\ufffdc",)]
    assert rows(dispatch, "text") == [("intrinsics.rs",)]


def test_a_rebuilt_index(spark, tmp_path):
    one = spark.createDataFrame([("a",)], "name string")
    path = str(tmp_path / "ix")
    with pytest.raises(ValueError):
        tables.read_tables(spark, path)
    tables.write_tables(path, F.lit(1), catalog=one, functions=one)
    before = tables.read_tables(spark, path)
    tables.write_tables(path, F.lit(2), catalog=one.unionAll(one))
    after = tables.read_tables(spark, path)
    assert rows(after["meta"], "built_at", "catalog_count") == [(2, 2)] and set(after) == {"meta", "catalog"}
    # Who read the first version before goes on with it.
    assert before["catalog"].count() == 1 and before["functions"].count() == 1


def test_reference_catalog(spark, tmp_path):
    entries = [{"name": n, "category": "type", "signature": n, "description": n} for n in "zyx"]
    path = put(tmp_path, "catalog.json", json.dumps({"version": 1, "entries": entries}, indent=2))
    got = files.load_reference_catalog(spark, path).orderBy("ordinal")
    assert rows(got, "ordinal", "name") == [(0, "z"), (1, "y"), (2, "x")]


STEPS = [
    {"iteration": 0, "accepted": True, "correct": True, "time_us": 90.5, "hypothesis": "Unroll 4x"},
    {"iteration": 1, "accepted": False, "correct": False, "time_us": 80.0, "hypothesis": "a"},
    {"iteration": 2, "accepted": False, "correct": True, "time_us": 95.0, "hypothesis": "b"},
    {"iteration": 3, "accepted": False, "correct": False, "time_us": None, "hypothesis": "c"},
    {"iteration": 4, "accepted": True, "correct": True, "time_us": 0, "hypothesis": "PREFETCH less"},
    {"iteration": 5, "accepted": False, "time_us": 0},
]


@pytest.fixture()
def benchmarks(tmp_path):
    put(tmp_path, "dot/history.json", json.dumps(STEPS, indent=1))
    put(tmp_path, "sum v2/history.json", json.dumps([STEPS[1]]))
    put(tmp_path, "dot/old/history.json", json.dumps([STEPS[0]]))
    put(tmp_path, "history.json", json.dumps([STEPS[0]]))
    put(tmp_path, "none/program.md", "# Goal\n# The Strategy space\n\n- one\n#! strategy again\n- two\n# Other\n- three\n")
    put(tmp_path, "dot/program.md", "no heading about it\n# Goal\ntext")
    return str(tmp_path)


def test_histories(spark, benchmarks):
    hist = files.load_histories(spark, benchmarks)
    assert sorted(r.name for r in files.list_benchmarks(spark, benchmarks).collect()) == ["dot", "none", "sum v2"]
    assert rows(hist.where("name = 'dot'").orderBy("pos"), "pos", "iteration") == [(i, i) for i in range(6)]
    assert {tuple(r) for r in history.history_summary(hist).collect()} == {("dot", 6, 2, None), ("sum v2", 1, 0, None)}
    assert rows(history.latest_accepted(hist), "name", "pos") == [("dot", 4)]
    assert rows(history.what_works(hist, 3)) == [("dot", None, "PREFETCH less", 6, 1, 3)]
    assert rows(history.winning_keywords(hist), "keyword") == [("prefetch",)]
    assert rows(history.accepted_iterations(hist, "dot").orderBy("pos"), "pos", "hypothesis") == [(0, "Unroll 4x"), (4, "PREFETCH less")]
    assert rows(history.winning_keywords(hist.where("name <> 'dot'"))) == []
    detail = history.history_detail(hist, "DOT").orderBy("pos")
    assert [r.status for r in detail.collect()] == ["ACCEPTED", "rejected", "rejected", "rejected", "ACCEPTED", "rejected"]
    assert [r.verdict for r in detail.collect()] == ["correct", "WRONG", "correct", "WRONG", "correct", "WRONG"]
    assert [r.time_us for r in detail.collect()] == [90.5, 80.0, 95.0, None, None, None]
    failures = history.recent_failures(hist.where("name = 'dot'"), 3).orderBy("pos")
    assert rows(failures, "pos", "reason", "hypothesis") == [
        (2, "no improvement", "b"),
        (3, "compile error or timeout", "c"),
        (5, "compile error or timeout", "n/a"),
    ]
    assert history.recent_failures(hist.where("name = 'sum v2'")).first().reason == "wrong output"


def test_benchmarks_that_spark_hides(spark, tmp_path):
    for name in ["_k", ".x", "plain"]:
        put(tmp_path, f"{name}/history.json", json.dumps(STEPS[:2]))
        put(tmp_path, f"{name}/program.md", "# Strategy\n- one\n")
    assert sorted(r.name for r in files.load_histories(spark, str(tmp_path)).collect()) == [".x", ".x", "_k", "_k", "plain", "plain"]
    assert {r.strategy for r in files.load_strategy_notes(spark, str(tmp_path)).collect()} == {"- one"}
    assert files.load_strategy_notes(spark, str(tmp_path)).count() == 3


def test_no_histories(spark, tmp_path):
    put(tmp_path, "a/other.txt")
    put(tmp_path, "b/other.txt")
    hist = files.load_histories(spark, str(tmp_path))
    assert hist.count() == 0 and files.list_benchmarks(spark, str(tmp_path)).count() == 2
    assert files.load_histories(spark, str(tmp_path / "gone")).count() == 0


def test_strategy_notes(spark, benchmarks):
    got = dict(rows(files.load_strategy_notes(spark, benchmarks)))
    assert got == {"none": "- one\n- two", "dot": None}


def test_vectors_are_sorted_behind_the_shuffle_only(spark):
    """A task that reads files sorts none of their vectors, however many files it reads."""
    found = spark.range(60).selectExpr("CAST(id % 3 AS INT) AS root_no", "concat('f', id % 20) AS path", "repeat('x', CAST(id % 3 AS INT)) AS content")
    no_catalog = spark.createDataFrame([], "ordinal bigint, name string, category string, signature string, description string")
    embeddings = build_index(found, no_catalog)[1]
    reading = plan(embeddings).split("Exchange", 1)[1]
    assert "Sort" not in reading and "Aggregate" not in reading
    # The vector of the lowest root's file.
    assert {(r.path, r.embedding[ord("x")]) for r in embeddings.collect()} == {(r.path, float(r.n > 0)) for r in found.groupBy("path").agg(F.min_by(F.length("content"), "root_no").alias("n")).collect()}
