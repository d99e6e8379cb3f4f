"""Score generation files as they arrive (Structured Streaming + foreachBatch).

The reference scores a finite list of generations; here new JSON-lines files
dropped into a folder are picked up by a file stream, and each micro-batch
runs the same batch scorer (``plans.scorer.score``).  Results are written per
micro-batch id with dynamic partition overwrite, so a replayed batch replaces
its own output instead of duplicating it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veracity.plans.scorer import score
from veracity.sources.readers import OUTPUT_FIELD, KnowledgeSource


def parse_lines(lines: DataFrame, field: str = OUTPUT_FIELD) -> DataFrame:
    """JSON lines -> (gen_id, model, text, line); text is null for a line that is
    no JSON or lacks the field.  ``gen_id`` is taken from the line when present,
    else it is a hash of file and line."""
    value = F.expr(f"try_variant_get(try_parse_json(value), '$.{field}', 'string')")
    given = F.expr("try_variant_get(try_parse_json(value), '$.gen_id', 'bigint')")
    model = F.expr("try_variant_get(try_parse_json(value), '$.model', 'string')")
    return lines.select(F.coalesce(given, F.xxhash64(F.col("_file"), F.col("value"))).alias("gen_id"),
                        model.alias("model"), value.alias("text"), F.col("value").alias("line"))


def score_stream(spark: SparkSession, source_dir: str, out_dir: str, checkpoint: str,
                 knowledge: KnowledgeSource, available_now: bool = True, **score_opts):
    """Start a streaming query that scores every new file under ``source_dir``.

    Writes ``out_dir/scores``, ``out_dir/decisions`` and, for lines that can't be
    read, ``out_dir/rejected``, partitioned by ``batch_id``.  Returns the StreamingQuery.
    """
    lines = (spark.readStream.format("text").load(source_dir)
             .withColumn("_file", F.col("_metadata.file_path")))

    def run(batch: DataFrame, batch_id: int) -> None:
        parsed = parse_lines(batch)
        res = score(parsed.where(F.col("text").isNotNull()).drop("line"), knowledge, **score_opts)
        bad = parsed.where(F.col("text").isNull()).select("gen_id", "line")
        for name, df in (("scores", res.scores), ("decisions", res.decisions), ("rejected", bad)):
            (df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id")
             .parquet(f"{out_dir}/{name}"))
        res.store.delete()

    writer = lines.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
