"""Readers and writers (S1, S2) and the knowledge source."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veracity.functions.text import title_of

# ---- fixed values: defaults
DEFAULT_NPROBE = 8
OUTPUT_FIELD = "output"
# ---- end of fixed values
#: Most splits whose first line numbers (some 150 bytes each) are sent to every task; beyond it lines are dealt by split.
BROADCAST_SPLITS = 100_000


class SchemaError(TypeError):
    """An input DataFrame lacks a column or has the wrong type."""


def require(df: DataFrame, **types: str) -> DataFrame:
    """Check column names and simple type strings of an input DataFrame."""
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    for name, want in types.items():
        if name not in have:
            raise SchemaError(f"missing column {name!r}; have {sorted(have)}")
        if want and have[name] != want:
            raise SchemaError(f"column {name!r} is {have[name]}, expected {want}")
    return df


def read_generations(spark: SparkSession, path: str, field: str = OUTPUT_FIELD,
                     mode: str = "strict") -> DataFrame:
    """JSON-lines generations -> (gen_id, text).

    ``strict`` raises on a blank line, bad JSON or a missing field;
    ``permissive`` keeps the good rows only (``rejected_lines`` has the others).
    ``gen_id`` is the line's place, from 0, over all lines of the files in order of
    their paths, bad lines counted.  It doesn't depend on how the files are split.
    """
    parsed = _lines(spark, path, field)
    bad = F.col("text").isNull()
    if mode == "strict":
        fail = F.raise_error(F.concat(F.lit("bad generation line: "), F.col("line")))
        out = parsed.where(F.when(bad, fail.isNull()).otherwise(F.lit(True)))
    elif mode == "permissive":
        out = parsed.where(~bad)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return out.select("gen_id", "text")


def rejected_lines(spark: SparkSession, path: str, field: str = OUTPUT_FIELD) -> DataFrame:
    """The lines that ``permissive`` reading leaves out -> (gen_id, line)."""
    return _lines(spark, path, field).where(F.col("text").isNull()).select("gen_id", "line")


def _lines(spark: SparkSession, path: str, field: str) -> DataFrame:
    parsed = F.expr(f"try_variant_get(try_parse_json(line), '$.{field}', 'string')")
    return numbered_lines(spark, path).select(F.col("line_no").alias("gen_id"), "line", parsed.alias("text"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line): the lines of text files with their place in file order.

    A split of a file counts its own lines; a running sum of these counts over (file, start of the split), a row
    each, says where a split's first line stands.  Within a split the reader goes from line to line,
    so a line's distance from the split's first is that of their row numbers."""
    lines = spark.read.text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"))
    splits = lines.groupBy("file", "start").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    files = splits.groupBy("file").agg(F.sum("n").alias("n")).select(
        "file", F.coalesce(F.sum("n").over(before(Window.orderBy("file"))), F.lit(0)).alias("of_file"))
    places = splits.join(files, "file").select(
        "file", "start", "first", (F.col("of_file") + F.coalesce(F.sum("n").over(before(Window.partitionBy("file").orderBy("start"))), F.lit(0))).alias("of_split"))
    # a row for each split: no more than files and read partitions together
    most = len(lines.inputFiles()) + lines._jdf.queryExecution().toRdd().getNumPartitions()
    return lines.join(F.broadcast(places) if most <= BROADCAST_SPLITS else places, ["file", "start"]).select((F.col("of_split") + F.col("row") - F.col("first")).alias("line_no"), "line")


def read_knowledge(spark: SparkSession, path: str, title_col: str = "title", text_col: str = "text",
                   id_col: str | None = None, fmt: str = "parquet") -> DataFrame:
    """A knowledge table -> (title_id, title, text).

    Without ``id_col`` (a plain table of titles and texts) the id is a 64-bit
    hash of title and text, the same wherever and however often the table is read.
    Rows that are equal in both are one document.  Two documents of one id raise
    ValueError, which takes one pass over the ids.  Without a title column the
    title is derived from the text.
    """
    df = spark.read.format(fmt).load(path)
    title = F.col(title_col) if title_col in df.columns else title_of(F.col(text_col))
    rows = df.select(title.cast("string").alias("title"), F.col(text_col).cast("string").alias("text"),
                     *([F.col(id_col).cast("long").alias("title_id")] if id_col else []))
    if id_col:
        return rows.select("title_id", "title", "text")
    docs = rows.distinct().select(F.xxhash64("title", "text").alias("title_id"), "title", "text")
    twice = docs.groupBy("title_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not twice.isEmpty():
        raise ValueError("two documents of the knowledge table have one hash; give them an id column")
    return docs


@dataclass
class KnowledgeSource:
    """S3: documents, title vectors, cell centroids and the function that embeds names.

    ``embed_fn`` is an embedding backend (``list[str] -> list[vector]``) or None
    when names are looked up in the gazetteer.  ``nprobe`` cells are searched.
    """

    docs: DataFrame
    vectors: DataFrame
    centroids: DataFrame | None = None
    embed_fn: Callable | None = None
    nprobe: int = DEFAULT_NPROBE

    def validate(self) -> "KnowledgeSource":
        """An empty source is an error (D15); schemas are checked."""
        require(self.docs, title_id="bigint", title="string", text="string")
        require(self.vectors, title_id="bigint", embedding="")
        if self.centroids is not None:
            require(self.centroids, cell="", centroid="")
            require(self.vectors, cell="")
        if self.docs.isEmpty():
            raise ValueError("knowledge source has no documents")
        if self.vectors.isEmpty():
            raise ValueError("knowledge source has no title vectors")
        return self

    def register(self, prefix: str = "") -> None:
        self.docs.createOrReplaceTempView(f"{prefix}knowledge")
        self.vectors.createOrReplaceTempView(f"{prefix}title_vectors")
        if self.centroids is not None:
            self.centroids.createOrReplaceTempView(f"{prefix}centroids")
