import json
import os
import time

import pytest

from conftest import rows
from textlake.sources import files
from textlake.sources.tree_source import SourceTree


def put(root, name, text="x"):
    os.makedirs(os.path.dirname(root / name), exist_ok=True)
    (root / name).write_text(text)


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "tree"
    for name in ["a.ea", "_b.ea", "k/c.ea", "k/deep/er/d.ea", ".h/e.ea", "k/.git/no.ea", "target/no.ea", "k/no.txt"]:
        put(root, name, name)
    return root


def options(reader, *roots, **more):
    reader = reader.format("source_tree").option("roots", json.dumps([str(r) for r in roots]))
    for k, v in more.items():
        reader = reader.option(k, v)
    return reader


@pytest.mark.parametrize("depth", [0, 1, 3])
def test_batch_equals_the_loader(spark, tree, depth):
    spark.dataSource.register(SourceTree)
    got = options(spark.read, tree, tree / "k", tree / "none", depth=depth).load()
    want = files.load_source_tree(spark, [str(tree), str(tree / "k"), str(tree / "none")])
    columns = ["path", "content", "length", "modified"]
    assert sorted(map(str, rows(got, *columns))) == sorted(map(str, rows(want, *columns))) and got.where("error IS NOT NULL").count() == 0
    # A partition for each folder at the planned depth, and their files' own.
    assert got.rdd.getNumPartitions() == {0: 3, 1: 6}.get(depth, got.rdd.getNumPartitions())


def test_stream_gives_new_files_only(spark, tree, tmp_path):
    spark.dataSource.register(SourceTree)

    def run():
        stream = options(spark.readStream, tree, settle=0).load()
        job = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ckpt"))
        job.trigger(availableNow=True).start().awaitTermination()
        return sorted(rows(spark.read.parquet(str(tmp_path / "out")), "path", "content"))

    first = run()
    assert first == sorted(rows(options(spark.read, tree).load(), "path", "content")) and len(first) == 5
    assert run() == first
    time.sleep(0.05)
    put(tree, "k/deep/new.ea", "new")
    put(tree, "a.ea", "changed")
    time.sleep(0.05)
    added = [x for x in run() if x not in first]
    assert added == sorted([(str(tree / "a.ea"), b"changed"), (str(tree / "k/deep/new.ea"), b"new")])


def test_what_cannot_be_listed_is_a_row(spark, tree):
    spark.dataSource.register(SourceTree)
    got = options(spark.read, tree / "a.ea", tree / "k").load().collect()
    # A file is no folder.
    assert [(r.path, r.content) for r in got if r.error] == [(str(tree / "a.ea"), None)] and sum(r.error is None for r in got) == 2
    with pytest.raises(Exception, match="Cannot list"):
        files.load_source_tree(spark, [str(tree), str(tree / "a.ea")]).count()
    assert files.load_source_tree(spark, [str(tree), str(tree / "a.ea")], on_error="skip").count() == 5
    assert [r.path for r in files.load_source_tree(spark, [str(tree), str(tree / "a.ea")], skipped=True).collect()] == [str(tree / "a.ea")]
    with pytest.raises(Exception, match="Cannot list"):
        files.list_source_tree(spark, [str(tree / "a.ea")]).count()
    with pytest.raises(ValueError, match="raise or skip"):
        files.load_source_tree(spark, [str(tree)], on_error="ignore")


def test_benchmark_files_that_cannot_be_read(spark, tmp_path):
    put(tmp_path, "good/history.json", json.dumps([{"iteration": 1, "accepted": True}]))
    put(tmp_path, "good/program.md", "# Strategy\n- one\n")
    # Folders in place of the files: there, but not to be read.
    os.makedirs(tmp_path / "bad/history.json")
    os.makedirs(tmp_path / "bad/program.md")
    os.makedirs(tmp_path / "none")
    for load in (files.load_histories, files.load_strategy_notes):
        with pytest.raises(Exception, match="bad/"):
            load(spark, str(tmp_path)).collect()
        assert rows(load(spark, str(tmp_path), on_error="skip"), "name") == [("good",)]
    assert sorted(os.path.relpath(r.path, tmp_path) for r in files.benchmark_errors(spark, str(tmp_path)).collect()) == ["bad/history.json", "bad/program.md"]
    put(tmp_path, "file")
    assert rows(files.benchmark_errors(spark, str(tmp_path / "file")), "path") == [(str(tmp_path / "file"),)]
