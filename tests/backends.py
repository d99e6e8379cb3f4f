"""Deterministic offline backends for the pluggable model interfaces.

They stand in for remote models in tests and rows-only checks: small,
picklable per-batch helpers; all table work stays in Spark.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash

from veracity.functions import prompts as P

_QUESTION = re.compile(re.escape(P.VERIFY_QUESTION[0]) + r"(.*)" + re.escape(P.VERIFY_QUESTION[1]), re.S)


class KeywordVerifier:
    """Completion backend for verification prompts: "True" when at least half
    of the question's distinct lower-cased words occur in the context lines."""

    def __init__(self, threshold: float = 0.5, cost_per_char: float = 1e-6):
        self.threshold, self.cost_per_char = threshold, cost_per_char

    def __call__(self, prompts: list[str]) -> list[dict]:
        out = []
        for p in prompts:
            m = _QUESTION.search(p)
            fact = m.group(1) if m else ""
            context = set()
            for line in p[:m.start() if m else len(p)].split("\n"):
                if line.startswith(P.VERIFY_LINE[0]):
                    context.update(line[len(P.VERIFY_LINE[0]):].lower().split(" "))
            words = set(fact.lower().split(" "))
            share = len(words & context) / len(words) if words else 0.0
            out.append({"content": "True" if share >= self.threshold else "False",
                        "cost": len(p) * self.cost_per_char})
        return out


class HashingEmbedder:
    """Embedding backend: hashed bag of lower-cased words, unit length."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(self.dimensions)
            for w in (t or "").lower().split():
                v[xxhash.xxh64_intdigest(w) % self.dimensions] += 1.0
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out


class CapitalTagger:
    """Tagger backend: every capitalised word is a span.  Words found in
    ``people`` (lower-cased) are PER; without a list, a capitalised word
    inside the sentence is PER and a sentence-initial one MISC."""

    def __init__(self, people: frozenset[str] = frozenset()):
        self.people = frozenset(p.lower() for p in people)

    def __call__(self, facts: list[str]) -> list[list[tuple[str, str]]]:
        out = []
        for f in facts:
            spans = []
            for i, w in enumerate((f or "").split(" ")):
                w = w.strip(".,;:!?\"'()")
                if w[:1].isupper():
                    person = w.lower() in self.people if self.people else i > 0
                    spans.append((w, "PER" if person else "MISC"))
            out.append(spans)
        return out
