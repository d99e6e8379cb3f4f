"""veracity: factual-precision scoring of generated text as Spark DataFrame jobs.

Every stage takes and returns DataFrames over *all* generations at once:
facts are parsed with column expressions, names are found by an equi-join
against a gazetteer (or a pluggable tagger), nearest knowledge titles come
from a blocked top-k join over title vectors, BM25 runs as a sparse
(gen_id, token) join, and decisions are aggregated into scores.
"""

from veracity.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
