import hashlib
import re
import uuid

import pytest
from cases import frame, odd_texts
from pyspark.sql import functions as F

from textlake.llm import exact_dedup


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def run(spark, tmp_path, docs, files_per_batch=None, **options):
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    docs.write.parquet(path)
    stream = spark.readStream.schema(docs.schema)
    if files_per_batch:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)
    got = exact_dedup.mark_copies(spark, lambda: spark.read.schema(docs.schema).parquet(path), lambda: stream.parquet(path), **options)
    return [tuple(r) for r in got.select("doc_id", F.hex("digest"), "keep_id", "group_size", "kept").collect()]


def wanted(rows, digest=lambda t: hashlib.sha256(t.encode()).hexdigest().upper()):
    of = {}
    for i, t in rows:
        of.setdefault(norm(t), []).append(i)
    keep = {t: min((i for i in ids if i is not None), default=None) for t, ids in of.items()}
    return sorted(((i, digest(norm(t)), keep[norm(t)], len(of[norm(t)]), i == keep[norm(t)]) for i, t in rows), key=repr)


@pytest.mark.parametrize("files_per_batch", [None, 1])
def test_odd_rows(spark, tmp_path, files_per_batch):
    docs = frame(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(run(spark, tmp_path, docs, files_per_batch), key=repr) == wanted(rows)


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, frame(spark, [])) == []


def test_texts_that_share_a_digest_are_told_apart(spark, tmp_path):
    docs = frame(spark, odd_texts() * 3)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    weak = lambda t: F.encode(F.least(F.length(t), F.lit(4)).cast("string"), "UTF-8")  # noqa: E731  five digests
    got = run(spark, tmp_path, docs, digest=weak)
    assert sorted(got, key=repr) == wanted(rows, lambda t: str(min(len(t), 4)).encode().hex().upper())


def test_the_place_of_the_text_that_stays(spark, tmp_path):
    path = str(tmp_path / "docs")
    frame(spark, ["a", "b", "a ", "b", "a"]).write.parquet(path)
    docs = spark.read.parquet(path)
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(path)
    marked = exact_dedup.mark_copies(spark, lambda: spark.read.parquet(path), lambda: stream)
    places = docs.select("doc_id", F.xxhash64("_metadata.file_path").alias("keep_file"), F.col("_metadata.row_index").alias("keep_row"))
    found = marked.select("keep_id", "keep_file", "keep_row").distinct().join(places, ["keep_file", "keep_row"])
    assert found.count() == marked.where("keep_id IS NOT NULL").select("keep_id").distinct().count() > 0
    assert found.where("keep_id <=> doc_id").count() == found.count()


def test_a_hot_text(spark, tmp_path):
    docs = frame(spark, ["same text"] * 3000 + [f"own {i % 900}" for i in range(2000)])
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(run(spark, tmp_path, docs), key=repr) == wanted(rows)


def test_a_hit_in_a_later_batch_comes_from_the_state(spark, tmp_path, monkeypatch):
    """The driver dies between two micro-batches; the stream goes on with the state of the batches before."""
    path, out, checkpoint = (str(tmp_path / n) for n in ("docs", "out", "checkpoint"))
    for i in range(4):
        spark.createDataFrame([(i, "same"), (10 + i, f"own {i}")], "doc_id bigint, text string").coalesce(1).write.mode("append").parquet(path)

    def start():
        docs = spark.readStream.schema("doc_id bigint, text string").option("maxFilesPerTrigger", 1).parquet(path)
        return exact_dedup.dedup_stream(exact_dedup.keyed(docs), out, checkpoint)

    class Dies(type(spark.range(0).write)):
        def parquet(self, at, *args, **named):
            if at.endswith("batch=2"):
                raise RuntimeError("killed")
            return super().parquet(at, *args, **named)

    before = {k: spark.conf.get(k, None) for k in exact_dedup.STATE_SETTINGS}
    for k, v in exact_dedup.STATE_SETTINGS.items():
        spark.conf.set(k, v)
    try:
        frames = type(spark.range(0))
        real = frames.write
        monkeypatch.setattr(frames, "write", property(lambda df: Dies(df)))
        with pytest.raises(Exception, match="killed"):
            start().awaitTermination()
        monkeypatch.setattr(frames, "write", real)
        job = start()
        job.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    # The batches after the restart see the copies of those before it.
    last = spark.read.parquet(f"{out}/batch=3").orderBy("copies").collect()
    assert [(r["copies"], r["keep_id"]) for r in last][-1] == (4, 0) and len(last) == 2
    state = exact_dedup.state_of(spark, out)
    assert state.count() == 5 and state.agg(F.sum("copies")).first()[0] == 8


def test_batches_of_bytes(spark, tmp_path):
    docs = frame(spark, odd_texts() * 2).select("doc_id", "text", "lang").selectExpr("*", "'s' AS source", "1L AS n_chars")
    for part in range(3):
        docs.where(f"doc_id % 3 = {part} OR doc_id IS NULL AND {part} = 0").coalesce(1).write.mode("append").parquet(str(tmp_path / "documents.parquet"))
    got = exact_dedup.mark_copies_of_table(spark, str(tmp_path), bytes_per_batch=1)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(map(tuple, got.select("doc_id", F.hex("digest"), "keep_id", "group_size", "kept").collect()), key=repr) == wanted(rows)
