"""Batch model calls over DataFrames (M1-M4).

A *backend* is a picklable callable over a list of inputs that returns one
result per input.  Completion: ``str`` or a dict with ``content`` and
``cost``.  Embedding: a vector or a dict with ``embedding`` and ``cost``.
Tagger: a list of ``(span, label)``.  An exception object in place of a result
fails that input alone.

Requests keep their own key columns (``keys``), any number and of any type:
results are joined to their requests by these, never by position or by a hash.

Isolation (D1, M3): requests go to the backend in batches of ``batch_size``.
A batch that raises is cut in halves, at once and without using up anybody's
attempt, until the requests that fail stand alone; only these are
tried again, up to ``max_attempts`` calls of their own, ``retry_delay`` seconds
apart.  Up to ``concurrency`` batches of a task are under way at a time.  Every
failed request comes back with ``status = 'failed'`` and the text of its last
error.  Answers that a raising batch may have paid for are not returned by the
backend, so their cost isn't known; ``attempts`` counts all calls that a request was in.

Results should be persisted before a second action reads them (``persist_calls``),
so that a plan that runs again never calls a model twice; ``done`` skips
requests already answered in an earlier run and returns their rows.

``call_rounds`` is a whole model stage and what scoring runs use.  Its answers are
logged batch by batch (``answers_log``), so that neither a lost task nor a
run that starts again on its folder sends an answered request a second time; a request is
known by its keys and its text.  Retries are rounds of the
job: what failed is written down, dealt anew over the tasks and asked again after a
pause of the driver, and no task sleeps.  ``max_under_way`` bounds the calls under way over the
whole job: there are no more partitions than that many calls allow.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from veracity.operators.answers_log import AnswerLog
from veracity.session import Store

BATCH_SIZE = 32
CONCURRENCY = 4
MAX_ATTEMPTS = 4
RETRY_DELAY = 2.0
OUT_ROWS = 4096  # rows that a task returns at a time
_TAGS = T.ArrayType(T.StructType([T.StructField("entity", T.StringType()), T.StructField("label", T.StringType())]))
_KINDS = {"content": T.StringType(), "embedding": T.ArrayType(T.FloatType()), "tags": _TAGS}


@dataclass
class _Call:
    """What became of one request."""

    value: object = None
    cost: float = 0.0
    error: str | None = None
    attempts: int = 0
    latency_s: float = 0.0


def _hashable(value):
    """A key's value as Arrow gives it, lists and structs as tuples."""
    if isinstance(value, dict):
        return tuple((k, _hashable(v)) for k, v in value.items())
    return tuple(map(_hashable, value)) if isinstance(value, list) else value


def _text(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"


def _ask(backend: Callable, items: list) -> list:
    results = list(backend(list(items)))
    if len(results) != len(items):
        raise ValueError(f"backend gave {len(results)} results for {len(items)} requests")
    return results


def _take(call: _Call, result, kind: str) -> bool:
    """Put a result into its call; False if it is no answer."""
    value, cost = (result.get(kind), result.get("cost")) if isinstance(result, dict) else (result, None)
    call.cost += float(cost or 0.0)
    if isinstance(result, Exception):
        call.error = _text(result)
    elif value is None:
        call.error = f"reply without {kind}"
    else:
        call.value, call.error = value, None
    return call.error is None


def _isolate(backend: Callable, items: list, calls: list[_Call], kind: str) -> list[int]:
    """Call the batch, halving it as long as it raises; the numbers of the requests that failed alone."""
    failed, todo = [], [list(range(len(items)))]
    while todo:
        part = todo.pop()
        began = time.monotonic()
        try:
            results = _ask(backend, [items[i] for i in part])
        except Exception as e:  # noqa: BLE001 - whatever a backend raises fails its requests, not the job
            results = None
            error = _text(e)
        share = (time.monotonic() - began) / len(part)
        for i in part:
            calls[i].attempts += 1
            calls[i].latency_s += share
        if results is not None:
            failed += [i for i, r in zip(part, results, strict=True) if not _take(calls[i], r, kind)]
        elif len(part) == 1:
            calls[part[0]].error = error
            failed += part
        else:
            half = len(part) // 2
            todo += [part[half:], part[:half]]
    return failed


def call_batch(backend: Callable, items: list, kind: str, max_attempts: int = MAX_ATTEMPTS,
               retry_delay: float = RETRY_DELAY) -> list[_Call]:
    """One call for each item, in order."""
    calls = [_Call() for _ in items]
    failed = _isolate(backend, items, calls, kind) if items else []
    for _ in range(1, max_attempts):
        if not failed:
            break
        time.sleep(retry_delay)
        failed = [i for i in failed if _isolate(backend, [items[i]], [calls[i]], kind)]
    return calls


def _run(requests: DataFrame, backend: Callable, text_col: str, keys: list[str], kind: str, max_attempts: int,
         retry_delay: float, batch_size: int, concurrency: int, log: AnswerLog | None = None, carry: bool = False) -> DataFrame:
    """``carry`` adds ``_asked``, the text of each request that failed; requests that have that column are asked by it."""
    reqs = requests.select(*keys, F.col("_asked" if "_asked" in requests.columns else text_col).alias("_text"))
    if log is not None:
        reqs = reqs.repartition(log.partitions, *keys)
    schema = T.StructType([*(reqs.schema[k] for k in keys), T.StructField(kind, _KINDS[kind]), T.StructField("cost", T.DoubleType()),
                           T.StructField("error", T.StringType()), T.StructField("attempts", T.IntegerType()),
                           T.StructField("latency_s", T.DoubleType()), T.StructField("status", T.StringType()),
                           *([T.StructField("_asked", T.StringType())] if carry else [])])
    arrow = to_arrow_schema(schema)
    logged = pa.schema([f for f in arrow if f.name != "_asked"]).append(pa.field("_request", pa.binary()))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, batch_size):
                yield batch.slice(at, batch_size)

    def answered(part: pa.RecordBatch) -> tuple[pa.RecordBatch, list]:
        """The calls of a batch, and its texts."""
        asked = part["_text"].to_pylist()
        calls = call_batch(backend, asked, kind, max_attempts, retry_delay)
        if kind == "tags":
            values = [None if c.value is None else [{"entity": s, "label": t} for s, t in c.value] for c in calls]
        elif kind == "embedding":
            values = [None if c.value is None else [float(x) for x in c.value] for c in calls]
        else:
            values = [c.value if c.value is None else str(c.value) for c in calls]
        own = {kind: values, "cost": [c.cost for c in calls], "error": [c.error for c in calls], "attempts": [c.attempts for c in calls],
               "latency_s": [c.latency_s for c in calls], "status": ["ok" if c.error is None else "failed" for c in calls]}
        if carry:
            own["_asked"] = [None if c.error is None or t is None else str(t) for c, t in zip(calls, asked, strict=True)]
        columns = [part[f.name].cast(f.type) if f.name in keys else pa.array(own[f.name], f.type, from_pandas=True) for f in arrow]
        return pa.RecordBatch.from_arrays(columns, schema=arrow), asked

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
        with ThreadPoolExecutor(concurrency) as pool:
            waiting = []
            for part in parts(batches):
                waiting.append(pool.submit(answered, part))
                if len(waiting) >= concurrency:
                    yield waiting.pop(0).result()
            for w in waiting:
                yield w.result()

    def together(outs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The same rows in fewer batches."""
        held, rows = [], 0
        for out in outs:
            held.append(out)
            rows += out.num_rows
            if rows >= OUT_ROWS:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    if log is None:
        return reqs.mapInArrow(lambda batches: together(out for out, _ in ask(batches)), schema)

    def mark(text) -> bytes:
        return hashlib.blake2b(str(text).encode(), digest_size=16).digest()

    def names(rows: pa.RecordBatch | pa.Table, marks: list[bytes]) -> list[tuple]:
        """What a request is known by in the log: its keys and what it asks."""
        return list(zip(*([_hashable(v) for v in rows[k].to_pylist()] for k in keys), marks, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        partition = TaskContext.get().partitionId()
        tables, known = log.answered(partition), {}
        for n, table in enumerate(tables):
            for i, name in enumerate(names(table, table["_request"].to_pylist())):
                known.setdefault(name, (n, i))
        found: list[tuple[int, int]] = []

        def left() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if known:
                    own = names(batch, [mark(t) for t in batch["_text"].to_pylist()])
                    found.extend(known[n] for n in own if n in known)
                    batch = batch.filter(pa.array([n not in known for n in own], pa.bool_()))
                if batch.num_rows:
                    yield batch

        def noted() -> Iterator[pa.RecordBatch]:
            with log.writer(partition) as add:
                for out, asked in ask(left()):
                    good = pa.array([s == "ok" for s in out["status"].to_pylist()], pa.bool_())
                    marks = [mark(t) for t, ok in zip(asked, good.to_pylist(), strict=True) if ok]
                    if marks:
                        rows = out.filter(good)
                        add(pa.Table.from_arrays([*(rows[f.name] for f in logged if f.name != "_request"), pa.array(marks, pa.binary())], schema=logged))
                    yield out

        yield from together(noted())
        for n, table in enumerate(tables):
            own = [i for m, i in found if m == n]
            if own:
                rows = table.take(own)
                if carry:
                    rows = rows.append_column("_asked", pa.nulls(len(own), pa.string()))
                yield from rows.select(arrow.names).cast(arrow).combine_chunks().to_batches()

    return reqs.mapInArrow(run, schema)


def _answer(requests: DataFrame, done: DataFrame | None, keys: list[str], call: Callable[[DataFrame], DataFrame]) -> DataFrame:
    if done is None:
        return call(requests)
    ok = done.where(F.col("status") == "ok")
    known = ok.join(requests.select(*keys), keys, "left_semi")
    made = call(requests.join(ok.select(*keys), keys, "left_anti"))
    return known.select(*made.columns).unionByName(made)


def complete(requests: DataFrame, backend: Callable, *, keys: tuple[str, ...] = ("request_id",), prompt_col: str = "prompt",
             max_attempts: int = MAX_ATTEMPTS, retry_delay: float = RETRY_DELAY, batch_size: int = BATCH_SIZE,
             concurrency: int = CONCURRENCY, done: DataFrame | None = None, log: AnswerLog | None = None, carry: bool = False) -> DataFrame:
    """M1: a row per request -> (*keys, content, cost, error, attempts, latency_s, status).

    With ``done``, rows of an earlier run with status ok are returned instead of
    being asked for again.  No requests, no calls.
    """
    return _answer(requests, done, list(keys), lambda r: _run(
        r, backend, prompt_col, list(keys), "content", max_attempts, retry_delay, batch_size, concurrency, log, carry))


def embed(texts: DataFrame, backend: Callable, *, keys: tuple[str, ...] = ("request_id",), text_col: str = "text",
          max_attempts: int = MAX_ATTEMPTS, retry_delay: float = RETRY_DELAY, batch_size: int = BATCH_SIZE,
          concurrency: int = CONCURRENCY, done: DataFrame | None = None, log: AnswerLog | None = None, carry: bool = False) -> DataFrame:
    """M2: a row per request -> (*keys, embedding, cost, error, attempts,
    latency_s, status); a reply without a vector is a failure."""
    return _answer(texts, done, list(keys), lambda r: _run(
        r, backend, text_col, list(keys), "embedding", max_attempts, retry_delay, batch_size, concurrency, log, carry))


def tag_calls(facts: DataFrame, backend: Callable, *, keys: tuple[str, ...] = ("gen_id", "fact_id"), text_col: str = "fact",
              max_attempts: int = MAX_ATTEMPTS, retry_delay: float = RETRY_DELAY, batch_size: int = BATCH_SIZE,
              concurrency: int = CONCURRENCY, done: DataFrame | None = None, log: AnswerLog | None = None, carry: bool = False) -> DataFrame:
    """M4: a row per fact -> (*keys, tags array<struct<entity, label>>, cost, error,
    attempts, latency_s, status)."""
    return _answer(facts, done, list(keys), lambda r: _run(
        r, backend, text_col, list(keys), "tags", max_attempts, retry_delay, batch_size, concurrency, log, carry))


def tag_rows(calls: DataFrame, keys: tuple[str, ...] = ("gen_id", "fact_id")) -> DataFrame:
    """The spans of tagger calls -> (*keys, entity, label), all labels."""
    return calls.where(F.col("status") == "ok").select(*keys, F.inline("tags"))


def tag_entities(facts: DataFrame, backend: Callable, **opts) -> DataFrame:
    """M4: a tagger over facts -> (gen_id, fact_id, entity, label), all labels."""
    return tag_rows(tag_calls(facts, backend, **opts))


pause = time.sleep  # between rounds, on the driver


def call_rounds(ask: Callable[..., DataFrame], requests: DataFrame, backend: Callable, store: Store, name: str, *, keys: tuple[str, ...],
                max_attempts: int = MAX_ATTEMPTS, retry_delay: float = RETRY_DELAY, concurrency: int = CONCURRENCY,
                max_under_way: int | None = None, done: DataFrame | None = None, **opts) -> DataFrame:
    """M1-M4, M3: a whole stage of calls in rounds, written to ``store`` -> the rows of ``ask``
    (``complete``, ``embed`` or ``tag_calls``), one for each request.

    Round 1 asks for every request that neither ``done`` nor the stage's log has an answer to, each later round, up
    to ``max_attempts``, for those that have failed so far, whose texts the round before has written down: requests are computed once, ``retry_delay`` seconds after the last one and
    twice as long before each further one.  Costs, attempts and latencies of a request's rounds are added up.  A
    backend with a method ``attempt(n)`` gives the callable for round n (another endpoint, a longer time limit).
    At most ``max_under_way`` calls are under way at a time over all tasks.
    """
    spark = requests.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if max_under_way is not None:
        concurrency = min(concurrency, max_under_way)
        partitions = min(partitions, max(1, max_under_way // concurrency))
    keys_ = list(keys)
    left, rounds, older = requests, [], None
    if done is not None:
        ok = done.where(F.col("status") == "ok")
        older = ok.join(requests.select(*keys_), keys_, "left_semi")
        left = requests.join(ok.select(*keys_), keys_, "left_anti")
    for n in range(1, max_attempts + 1):
        send = backend.attempt(n) if hasattr(backend, "attempt") else backend
        log = AnswerLog(f"{store.path}/{name}_log/round={n}", partitions)
        rounds.append(store.keep(f"{name}_round{n}", ask(left, send, keys=keys, max_attempts=1, retry_delay=0.0, concurrency=concurrency, log=log,
                                                        carry=n < max_attempts, **opts)))
        failed = rounds[-1].where(F.col("status") == "failed")
        if n == max_attempts or failed.isEmpty():
            break
        pause(retry_delay * 2 ** (n - 1))
        left = failed.select(*keys_, "_asked")
    rounds = [r.drop("_asked") for r in rounds]
    columns = rounds[0].columns
    if len(rounds) == 1:
        made = rounds[0]
    else:
        every = reduce(DataFrame.unionByName, [r.withColumn("_round", F.lit(n)) for n, r in enumerate(rounds)])
        summed = {"cost": F.sum("cost"), "attempts": F.sum("attempts").cast("int"), "latency_s": F.sum("latency_s")}
        last = [c for c in columns if c not in summed and c not in keys_]
        made = every.groupBy(*keys_).agg(F.max_by(F.struct(*last), "_round").alias("_last"), *[v.alias(k) for k, v in summed.items()]).select(
            *[F.col("_last")[c].alias(c) if c in last else F.col(c) for c in columns])
    if older is not None:
        made = older.select(*columns).unionByName(made)
    out = store.keep(name, made)
    for n in range(1, len(rounds) + 1):  # the stage's table has it all; the log stays for a run that starts again
        store.drop(f"{name}_round{n}")
    return out


def persist_calls(calls: DataFrame, path: str | None = None) -> DataFrame:
    """Cut lineage after a model stage so later actions never call the model again.

    With ``path`` the rows are written to a Parquet table of that run, usable as
    ``done=`` by the next one; otherwise a reliable checkpoint is used.
    """
    if path:
        calls.write.mode("errorifexists").parquet(path)
        return calls.sparkSession.read.schema(calls.schema).parquet(path)
    return calls.checkpoint(eager=True)
