"""Incremental scoring over a file stream."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from veracity.sources.readers import KnowledgeSource
from veracity.streaming.incremental import score_stream


def test_stream_scores_new_files(spark):
    docs = spark.createDataFrame([(1, "Alice", "Alice likes tea. Alice is tall."), (2, "Bob", "Bob met Alice.")],
                                 "title_id bigint, title string, text string")
    vecs = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [0.0, 1.0])],
                                 "title_id bigint, cell int, embedding array<float>")
    gaz = spark.createDataFrame([("alice", 1), ("bob", 2)], "entity string, title_id bigint")
    base = tempfile.mkdtemp(prefix="veracity-stream-")
    src = os.path.join(base, "in")
    os.makedirs(src)
    with open(os.path.join(src, "a.jsonl"), "w") as fh:
        fh.write(json.dumps({"gen_id": 1, "model": "m0", "output": "Alice likes tea."}) + "\n")
        fh.write(json.dumps({"gen_id": 2, "model": "m0", "output": "nobody here."}) + "\n")
        fh.write("{broken\n")
    q = score_stream(spark, src, os.path.join(base, "out"), os.path.join(base, "ckpt"),
                     KnowledgeSource(docs, vecs), gazetteer=gaz, k=1, exact=True)
    q.awaitTermination(300)
    out = {r.gen_id: r.status for r in spark.read.parquet(os.path.join(base, "out", "scores")).collect()}
    assert out == {1: "ok", 2: "no_entities"}
    assert [r.line for r in spark.read.parquet(os.path.join(base, "out", "rejected")).collect()] == ["{broken"]
    with open(os.path.join(src, "b.jsonl"), "w") as fh:
        fh.write(json.dumps({"gen_id": 3, "model": "m1", "output": "Bob met Alice."}) + "\n")
    q = score_stream(spark, src, os.path.join(base, "out"), os.path.join(base, "ckpt"),
                     KnowledgeSource(docs, vecs), gazetteer=gaz, k=1, exact=True)
    q.awaitTermination(300)
    scores = spark.read.parquet(os.path.join(base, "out", "scores"))
    assert scores.count() == 3 and scores.where(F.col("gen_id") == 3).first().status == "ok"
