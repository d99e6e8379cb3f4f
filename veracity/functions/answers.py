"""Model replies as columns: answer decisions (P9), payloads (P10),
responses (P11) and call status (P12)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPLETION = "completion"
EMBEDDING = "embedding"

RESPONSE_SCHEMA = (
    "choices array<struct<message: struct<content: string>>>, "
    "usage struct<estimated_cost: double>, embedding array<float>"
)


def parse_answer(answer: Column) -> Column:
    """True / False / NULL (undecided).  ``false`` wins when both occur;
    ``untrue`` counts as true, like the reference's substring test.  A NULL
    reply is undecided instead of failing the generation (D19)."""
    a = F.lower(answer)
    return (F.when(a.contains("false"), F.lit(False))
            .when(a.contains("true"), F.lit(True))
            .otherwise(F.lit(None).cast("boolean")))


def completion_payload(prompt: Column, model: str, temperature: float = 0.0) -> Column:
    """P10: chat-completion request body as JSON."""
    msg = F.struct(F.lit("user").alias("role"), prompt.alias("content"))
    return F.to_json(F.struct(F.lit(model).alias("model"), F.array(msg).alias("messages"),
                              F.lit(float(temperature)).alias("temperature")))


def embedding_payload(text: Column, model: str, dimensions: int = 768) -> Column:
    """P10: embedding request body as JSON."""
    return F.to_json(F.struct(text.alias("prompt"), F.lit(model).alias("model"),
                              F.lit(int(dimensions)).alias("dimensionality")))


def parse_response(body: Column, kind: str = COMPLETION) -> Column:
    """struct(content, embedding, cost) from a response body.

    The endpoint kind is explicit (D20).  Missing ``content`` makes a failed
    call (see ``call_status``); a missing embedding or cost is NULL.
    """
    r = F.from_json(body, RESPONSE_SCHEMA)
    content = F.try_element_at(r["choices"], F.lit(1))["message"]["content"]
    if kind == COMPLETION:
        return F.struct(content.alias("content"), F.lit(None).cast("array<float>").alias("embedding"),
                        r["usage"]["estimated_cost"].alias("cost"))
    if kind == EMBEDDING:
        return F.struct(F.lit(None).cast("string").alias("content"), r["embedding"].alias("embedding"),
                        r["usage"]["estimated_cost"].alias("cost"))
    raise ValueError(f"unknown endpoint kind {kind!r}")


def call_status(error: Column, result: Column, kind: str = COMPLETION) -> Column:
    """P12: 'ok' or 'failed'.  A call fails when it raised, or when a
    completion has no content.  Failed calls are never counted as answers."""
    missing = F.lit(False) if kind == EMBEDDING else result.isNull()
    return F.when(error.isNotNull() | missing, F.lit("failed")).otherwise(F.lit("ok"))
