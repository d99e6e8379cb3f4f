"""What the operators share: stage tables in the cluster's shared folder and
the reading of the test tables."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from veracity.session import checkpoint_dir, ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder all executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a reused table once to the shared folder and read it back, so
    that later jobs start from files that outlive the executors."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stage(df: DataFrame) -> None:
    """Delete the files of a stage table that nothing reads any more."""
    spark = df.sparkSession
    for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: What a Python worker keeps from one task to the next of the same operator, by operator.
_KEPT: dict[str, object] = {}


def kept(owner: str, make: Callable):
    """This worker's object of the operator ``owner``, made once.

    A worker keeps one operator's objects only: the first task of another one, also of
    one that keeps nothing (``kept(name, dict)``), lets go of the last one's and
    gives its memory back."""
    if owner not in _KEPT:
        if _KEPT:
            _KEPT.clear()
            gc.collect()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
            if trim:
                trim(0)
        _KEPT[owner] = make()
    return _KEPT[owner]


#: Most bytes of one Arrow batch between Spark and a Python worker.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ready(spark: SparkSession) -> None:
    """Make this package importable in the Python workers and keep what they
    are handed at once small, however long the texts are."""
    ship_package(spark)
    if not 0 < int(spark.conf.get(_BATCH).rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(_BATCH, BATCH_BYTES)


def held_out(doc_id):
    """True for the rows no model may learn labels from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def with_scores(df: DataFrame, text_col: str, score: Callable, fields: list[tuple[str, pa.DataType]]) -> DataFrame:
    """``df`` with columns that ``score`` makes from lists of texts, one list a
    column.  Other columns pass through; columns of the new names are replaced."""
    ready(df.sparkSession)
    new = [name for name, _ in fields]
    keep = [c for c in df.columns if c not in new or c == text_col]
    at = keep.index(text_col)

    def run(batches):
        kept("scores", dict)
        for batch in batches:
            row = batch.column(0)
            made = score(row.field(at).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [row, *(pa.array(m, kind) for m, (_, kind) in zip(made, fields, strict=True))],
                names=["row", *(f"made{i}" for i in range(len(fields)))])

    one = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"))
    schema = T.StructType([one.schema["row"], *(T.StructField(f"made{i}", from_arrow_type(kind)) for i, (_, kind) in enumerate(fields))])
    out = one.mapInArrow(run, schema)
    return out.select(*[F.col(f"row.`{c}`") for c in keep if c not in new],
                      *[F.col(f"made{i}").alias(name) for i, name in enumerate(new)])


def shared_files(uri: str):
    """(file system, path) of a folder or file all executors share."""
    from pyarrow import fs

    scheme, _, rest = uri.partition(":")
    if not rest:
        return fs.LocalFileSystem(), uri
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, data: bytes) -> None:
    """Write a whole file under a name that no other attempt uses."""
    system, path = shared_files(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(path) as out:
        out.write(data)


def read_file(uri: str) -> bytes:
    system, path = shared_files(uri)
    with system.open_input_stream(path) as f:
        return f.read()


def bit_map(keys: DataFrame, slot, bits: int):
    """A NumPy bit map, of ``2 ** bits`` bits whatever the table, of the ``slot``
    (0 to ``2 ** bits - 1``) of every row; bit i is ``map[i >> 6] >> (i & 63) & 1``."""
    import numpy as np

    at = keys.select(slot.alias("slot"))
    marks = at.groupBy(F.shiftright("slot", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
    rows = marks.toArrow()  # 2 ** (bits - 6) rows at most
    full = np.zeros(1 << (bits - 6), np.int64)
    full[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return full
