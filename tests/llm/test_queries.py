"""The registered queries over a given small table, against their SQL texts or brute force."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import pytest
import public_tokenizers
import sentencepiece
from cases import frame, odd_texts
from test_license_scan import base
from test_line_dedup import brute as brute_lines
from test_near_dup import brute as brute_links
from test_personal_data import brute as brute_mentions
from test_quality import counts
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as spark_entry
import corpus_pipeline
from textlake.llm.common import documents

SF = "/root/testdata/sf0.001"
given_schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in ["documents", "pages", "labels", "benchmark"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def docs(con):
    return con.execute("SELECT doc_id, text FROM documents").fetchall()


def run(spark, name):
    full = next(q for q in spark_entry.queries() if q.split("_")[0] == name)
    return [r.asDict() for r in spark_entry.queries()[full](spark, SF).collect()]


def test_every_operator_has_a_query():
    names = [q.split("_")[0] for q in spark_entry.queries()]
    assert all(names.count(f"op{n}") == 1 for n in range(1, 14)) and "pipeline" in names


@pytest.mark.parametrize("name", sorted(spark_entry.LLM_ORACLES))
def test_query_equals_its_sql(spark, con, name):
    got = spark_entry.queries()[name](spark, SF)
    cur = con.execute(spark_entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(columns).collect()))) == sorted(map(repr, cur.fetchall()))


def check_packing(rows, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    of, sequences = {}, {}
    for r in rows:
        of.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(of) == set(texts)
    for doc_id, own in of.items():
        ids = tokenizer.encode(texts[doc_id] or "", add_special_tokens=False).ids + [2]
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            piece = ids[at : at + r["length"]]
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(piece)}I", *piece))
            at += r["length"]
        assert at == len(ids)
    for places in sequences.values():
        ends = [0, *[o + n for o, n in sorted(places)]]
        assert [o for o, _ in sorted(places)] == ends[:-1] and ends[-1] <= 4096
    assert len(sequences) <= 1.05 * math.ceil(sum(r["length"] for r in rows) / 4096) + 1


def test_op1(spark, docs):
    check_packing(run(spark, "op1"), dict(docs))


def test_op3(spark, docs):
    got = [(r["doc_id"], r["rep_id"], r["class_id"], r["n_links"]) for r in run(spark, "op3")]
    assert sorted(got, key=repr) == brute_links(docs)


def test_op5(spark, docs):
    got = {(r["doc_id"], r["line"]): (r["keep_doc_id"], r["keep_line"]) for r in run(spark, "op5")}
    assert got == brute_lines(docs, 10)


def test_op6(spark, docs):
    got = run(spark, "op6")
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    assert sorted(tuple(r[c] for c in columns) for r in got) == sorted((i, *base(t)) for i, t in docs)


def test_op7(spark, docs):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {}
    for r in sorted(run(spark, "op7"), key=lambda r: r["chunk"]):
        got.setdefault(r["doc_id"], []).extend(r["ids"])
        assert r["round_trip"] and r["n_ids"] == len(r["ids"])
    assert got == {i: library.encode(t or "") for i, t in docs}


def test_op8(spark, con):
    from html import unescape

    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in run(spark, "op8")}
    for page_id, html in con.execute("SELECT page_id, html FROM pages").fetchall():
        article = re.search(r"<article>(.*?)(</article>|\Z)", html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", article.replace("<br>", " "))
        shown = [" ".join(unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks]
        text = "\n".join(b for b in shown if b)
        assert got[page_id] == (text, len(text))


def test_op9(spark, docs):
    got = run(spark, "op9")
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"]) for r in got) == Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), "key") for i, t in docs
    )
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(24))


def test_op10(spark, docs, con):
    got = {r["doc_id"]: r for r in run(spark, "op10")}
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for i, t in docs:
        c = counts(t)
        assert [got[i][x] for x in columns] == c
        assert got[i]["base_failed"] == (c[0] < 50 or 100 * c[4] > 50 * c[0])
        assert not (got[i]["kept"] and got[i]["base_failed"])
    labels = con.execute("SELECT doc_id, quality FROM labels").fetchall()
    assert all(got[i]["kept"] or got[i]["base_failed"] for i, q in labels if q == 1)


def test_op11(spark, docs):
    got = {r["doc_id"]: r for r in run(spark, "op11")}
    kinds = ["email", "ip", "card", "phone"]
    for i, t in docs:
        base = brute_mentions(t)
        written = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in base)
        assert got[i]["base_sha256"] == hashlib.sha256(written.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in kinds] == [sum(k == n for _, k, _ in base) for n in range(4)]
        assert set(written.split(",")) <= set(got[i]["spans"].split(","))
        # What the given texts hold is complete, and nothing else of them is personal data.
        assert got[i]["n_added"] == 0


def test_the_stages_of_the_pipeline(spark, docs):
    """Each stage by brute force on what the stage before has kept."""
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "ngram_jaccard_join", "packing"]
    given = documents(spark, SF)
    verdicts = {r["doc_id"]: r["kept"] for r in run(spark, "op10")}

    good = stages["quality_rules"](spark, given, SF).persist()
    assert good.columns == given.columns
    texts = {r["doc_id"]: r["text"] for r in good.collect()}
    assert texts == {i: t for i, t in docs if verdicts[i]}

    lines = stages["line_dedup"](spark, good, SF).persist()
    assert lines.columns == given.columns
    first = brute_lines(list(texts.items()), 10)
    want = {}
    for i, t in texts.items():
        kept = [x for n, x in enumerate(t.split("\n")) if first.get((i, n), (i, n)) == (i, n)]
        if any(x.strip() for x in kept):
            want[i] = "\n".join(kept)
    rows = lines.collect()
    assert {r["doc_id"]: r["text"] for r in rows} == want and all(r["n_chars"] == len(r["text"]) for r in rows)

    unique = stages["ngram_jaccard_join"](spark, lines, SF).persist()
    assert unique.columns == given.columns
    groups = brute_links(list(want.items()))
    left = {i: want[i] for i, _, group, _ in groups if i == group}
    assert {r["doc_id"]: r["text"] for r in unique.collect()} == left

    packed = stages["packing"](spark, unique, SF)
    check_packing([r.asDict() for r in packed.collect()], left)
    assert sorted(map(repr, run(spark, "pipeline"))) == sorted(repr(r.asDict()) for r in packed.collect())


def test_the_library_does_not_import_the_subpackage():
    root = Path(__file__).resolve().parents[2]
    for folder in ("textlake", "suite"):
        for file in (root / folder).rglob("*.py"):
            if "llm" not in file.relative_to(root).parts:
                assert not re.search(r"^\s*(from|import)\s+\S*llm", file.read_text(), re.M)


def test_stages_on_odd_rows(spark):
    """Null ids, repeated rows, null and empty texts pass every stage, and what a stage gives fits the next."""
    rows = frame(spark, odd_texts()).selectExpr("*", "'s' AS source", "CAST(length(text) AS BIGINT) AS n_chars")
    rows = rows.unionByName(rows.where("doc_id = 10").withColumn("doc_id", F.lit(None).cast("bigint")))
    stages = dict(corpus_pipeline.STAGES)
    for frame_in in (rows, rows.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame_in, SF)
            assert out.columns == frame_in.columns and out.count() <= frame_in.count(), name
            # Columns that have the names of inner ones stay as they were.
            assert {r["_id"] for r in out.collect()} <= {"A", None} and {r["_spread"] for r in out.collect()} <= {"E", None}
        assert stages["packing"](spark, frame_in, SF).agg({"doc_tokens": "count"}).first()[0] >= frame_in.count()
    unique = stages["ngram_jaccard_join"](spark, rows, SF)
    # Two near copies under the id that stays: one of them goes.
    line = odd_texts()[10]
    twice = spark.createDataFrame([(1, line, "en", "s", 1), (1, line + " end", "en", "s", 1), (2, line + " fin", "en", "s", 1)], given_schema)
    assert stages["ngram_jaccard_join"](spark, twice, SF).count() == 1
    # Copies with and without ids, texts of the same words, and near copies of the line of 30 words go.
    assert sorted(r["doc_id"] for r in unique.collect()) == [0, 1, 2, 3, 5, 6, 8, 9, 10, 14, 15]
