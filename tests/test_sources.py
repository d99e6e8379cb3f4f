"""Readers, index building, schema checks, the driver entry points."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from veracity.operators import index as IX
from backends import HashingEmbedder
from veracity.operators.index import read_index, write_index
from veracity.sources.readers import (KnowledgeSource, SchemaError, read_generations, read_knowledge, rejected_lines, require)


def _jsonl(lines):
    d = tempfile.mkdtemp(prefix="veracity-test-")
    p = os.path.join(d, "gens.jsonl")
    with open(p, "w") as fh:
        fh.write("\n".join(lines) + "\n")
    return p


def test_read_generations_good(spark):
    p = _jsonl([json.dumps({"output": "first"}), json.dumps({"output": "second", "x": 1})])
    rows = read_generations(spark, p).orderBy("gen_id").collect()
    assert [r.text for r in rows] == ["first", "second"]


@pytest.mark.parametrize("bad", ['{"input": "no output"}', "", "{broken json"])
def test_read_generations_strict_raises(spark, bad):
    p = _jsonl([json.dumps({"output": "ok"}), bad])
    with pytest.raises(Exception):
        read_generations(spark, p).collect()
    assert [r.text for r in read_generations(spark, p, mode="permissive").collect()] == ["ok"]


@pytest.mark.parametrize("broadcast", [True, False])
def test_places_do_not_depend_on_splits(spark, tmp_path, monkeypatch, broadcast):
    """Lines of several files keep their place in file order under any split size, bad ones counted."""
    from veracity.sources import readers
    monkeypatch.setattr(readers, "BROADCAST_SPLITS", 100_000 if broadcast else 0)
    want, n = {}, 0
    for f in range(4):
        lines = []
        for i in range(700 if f else 3):
            text = f"file {f} line {i} " + "x" * (i % 97)
            bad = i % 50 == 7
            lines.append("" if bad and i % 2 else "{broken" if bad else json.dumps({"output": text}))
            if not bad:
                want[n] = text
            n += 1
        (tmp_path / f"part-{f}.jsonl").write_text("\n".join(lines) + ("\n" if f % 2 else ""))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1g", "20k", "3k", "777b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = read_generations(spark, str(tmp_path), mode="permissive").collect()
            assert {r.gen_id: r.text for r in rows} == want and len(rows) == len(want)
        assert {r.gen_id for r in rejected_lines(spark, str(tmp_path)).collect()} == set(range(n)) - set(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_knowledge_source_checks(spark):
    docs = spark.createDataFrame([], "title_id bigint, title string, text string")
    vecs = spark.createDataFrame([(1, [0.0])], "title_id bigint, embedding array<float>")
    with pytest.raises(ValueError):
        KnowledgeSource(docs, vecs).validate()
    with pytest.raises(SchemaError):
        require(vecs, title="string")


def test_index_build_roundtrip(spark):
    titles = spark.createDataFrame([(i, f"Title {i % 7}") for i in range(40)], "title_id bigint, title string")
    vecs = IX.embed_titles(titles, HashingEmbedder(8), batch_size=16)
    assert IX.missing_vectors(titles, vecs).count() == 0
    cents = IX.train_cells(vecs, 3, seed=7)
    assert cents.count() == 3
    again = IX.train_cells(vecs, 3, seed=7)
    assert sorted(map(tuple, (r.centroid for r in cents.collect()))) == \
        sorted(map(tuple, (r.centroid for r in again.collect())))
    assigned = IX.assign_cells(vecs, cents)
    path = tempfile.mkdtemp(prefix="veracity-index-") + "/idx"
    write_index(assigned, path)
    write_index(assigned, path)  # a shard written again replaces itself
    back = read_index(spark, path)
    assert back.count() == 40
    assert back.where(F.col("cell") == 0).count() == assigned.where(F.col("cell") == 0).count()
    shards = {r.shard: r.n_titles for r in IX.index_shards(titles, 16).collect()}
    assert shards == {0: 16, 1: 16, 2: 8}


def test_embed_batch_size_check(spark):
    titles = spark.createDataFrame([(i, "t") for i in range(5)], "title_id bigint, title string")
    with pytest.raises(Exception):
        IX.embed_titles(titles, lambda xs: [[0.0]] * (len(xs) - 1), retry_delay=0.0).collect()


def test_entry_and_registry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["gen_id", "n_decided", "n_supported", "score"]
    assert len(rows) > 0 and all(0.0 <= r.score <= 1.0 for r in rows)
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert {k for k in set(q) - set(o) if not k.startswith("op") and k != "pipeline"} == set()


def test_index_has_few_files(spark, tmp_path):
    """Files follow from the rows of a cell, not from the number of tasks."""
    vecs = spark.range(0, 4000, 1, 16).select(F.col("id").alias("title_id"), F.when(F.col("id") % 4 == 0, F.col("id") % 20).otherwise(0).cast("int").alias("cell"),
                                              F.array(F.lit(1.0).cast("float")).alias("embedding"))
    path = str(tmp_path / "idx")
    write_index(vecs, path, 0, cell_rows=1000)
    write_index(vecs.limit(10), path, 1)
    files = [f for f in read_index(spark, path).inputFiles() if "shard=0" in f]
    assert len(files) <= 5 + 4 and read_index(spark, path).count() == 4010


def test_knowledge_without_ids(spark, tmp_path):
    rows = [("A", "x"), ("A", "y"), ("B", "x"), ("A", "x")]
    spark.createDataFrame(rows, "title string, text string").write.parquet(str(tmp_path / "k"))
    one = {(r.title, r.text): r.title_id for r in read_knowledge(spark, str(tmp_path / "k")).collect()}
    spark.createDataFrame(rows[::-1], "title string, text string").repartition(3).write.parquet(str(tmp_path / "l"))
    two = {(r.title, r.text): r.title_id for r in read_knowledge(spark, str(tmp_path / "l")).collect()}
    assert one == two and len(one) == len(set(one.values())) == 3


def test_rejected_lines_are_kept(spark):
    p = _jsonl([json.dumps({"output": "ok"}), "", "{broken", json.dumps({"x": 1})])
    assert sorted(r.line for r in rejected_lines(spark, p).collect()) == sorted(["", "{broken", '{"x": 1}'])
