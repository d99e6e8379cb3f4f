"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the character n-grams of 1 to ``ORDERS`` lower-cased characters
of a whole text, hashed to ``BUCKETS`` buckets; a feature's value is
(1 + log count) * idf, scaled to unit length.  Document frequencies are
counted over all training rows.  The weights are fitted with
follow-the-regularised-leader (proximal, per coordinate) under L1 and L2
penalties on a sample of at most ``SAMPLE`` training rows, spread evenly over
the languages; one in five of them only sets the softmax temperature.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veracity.llm.common import held_out, ready, with_scores

ORDERS = 3
BUCKETS = 1 << 15
SAMPLE = 4_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.3, 0.01
UNDETERMINED = "und"
_PIECE = 1 << 20
_MIX = np.uint32(0x9E3779B1)
_SHIFT = np.uint32(32 - 15)


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that a text's n-grams fall into, and how many fall there."""
    total = np.zeros(BUCKETS, np.int64)
    text = text.lower()
    for at in range(0, len(text), _PIECE):
        c = np.frombuffer(text[at:at + _PIECE + ORDERS - 1].encode("utf-32-le"), np.uint32)
        own = min(_PIECE, len(text) - at)
        h = np.zeros(len(c), np.uint32)
        for n in range(1, ORDERS + 1):
            if len(c) < n:
                break
            h = (h[:len(c) - n + 1] * _MIX) ^ (c[n - 1:] + np.uint32(n))
            total += np.bincount(((h * _MIX) >> _SHIFT)[:own], minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at, total[at]


def _weigh(at: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(count)) * idf[at]
    return x / max(np.sqrt(x @ x), 1e-12)


def _has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _frequencies(batches):
    df, n = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            df[counts(text.as_py())[0]] += 1
            n += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names=["bucket", "df"])


def _sparse(batches):
    for batch in batches:
        rows = [counts(t.as_py()) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([a.astype(np.uint16).tobytes() for a, _ in rows], pa.binary()),
             pa.array([c.astype(np.uint32).tobytes() for _, c in rows], pa.binary())], names=["doc_id", "lang", "at", "n"])


@dataclass
class LanguageModel:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # languages x (buckets, then the bias)
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, its probability); ("und", 0.0) for a text without a letter."""
        if not self.langs or not _has_letter(text):
            return UNDETERMINED, 0.0
        at, n = counts(text)
        z = (self.weights[:, at] @ _weigh(at, n, self.idf) + self.weights[:, -1]) / self.temperature
        p = np.exp(z - z.max())
        best = int(p.argmax())
        return self.langs[best], float(p[best] / p.sum())


def _ftrl(rows, labels, classes: int, rng) -> np.ndarray:
    """Weights of FTRL-proximal over ``EPOCHS`` seeded orders of the rows."""
    z, n = np.zeros((classes, BUCKETS + 1)), np.zeros((classes, BUCKETS + 1))

    def weights(at):
        za, na = z[:, at], n[:, at]
        l1 = np.where(at < BUCKETS, L1, 0.0)
        return np.where(np.abs(za) <= l1, 0.0, -(za - np.sign(za) * l1) / ((BETA + np.sqrt(na)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            w = weights(at)
            s = w @ x
            p = np.exp(s - s.max())
            p /= p.sum()
            p[labels[i]] -= 1
            g = p[:, None] * x
            na = n[:, at]
            z[:, at] += g - (np.sqrt(na + g * g) - np.sqrt(na)) / ALPHA * w
            n[:, at] = na + g * g
    return weights(np.arange(BUCKETS + 1))


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of the least log loss, by a search over a fine grid."""
    if not len(labels):
        return 1.0

    def loss(t):
        s = logits / t
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(labels)), labels]).mean())

    return float(min(np.geomspace(0.05, 5, 60), key=loss))


def fit(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang") -> LanguageModel:
    """Learn from the rows that have a language, a text with a letter in it and
    an id that isn't held out (null ids are left out too).  Without such rows, as in an empty table,
    the model knows no language.  Repeated rows count as often as they are
    given; very long texts are counted in parts."""
    ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return LanguageModel([], np.zeros(BUCKETS), np.zeros((0, BUCKETS + 1)), 1.0)
    freq = rows.select("text").mapInArrow(_frequencies, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df")).toPandas()
    df, total = np.zeros(BUCKETS), float(freq.df[freq.bucket == -1].sum())
    own = freq[freq.bucket >= 0]
    df[own.bucket.to_numpy()] = own.df.to_numpy()
    idf = np.log((1 + total) / (1 + df)) + 1

    rate = F.create_map(*[F.lit(v) for k in langs for v in (k, min(1.0, sample / len(langs) / sizes[k]))])
    chance = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1_000_003)) / F.lit(1_000_003)
    drawn = rows.where(chance < rate[F.col("lang")]).limit(sample + sample // 4)
    got = drawn.select("doc_id", "lang", "text").mapInArrow(_sparse, "doc_id long, lang string, at binary, n binary").collect()
    got.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"], r["lang"], r["at"], r["n"]))
    data = []
    for r in got:
        at = np.frombuffer(r["at"], np.uint16).astype(np.int32)
        x = _weigh(at, np.frombuffer(r["n"], np.uint32), idf).astype(np.float32)
        data.append((np.append(at, np.int32(BUCKETS)), np.append(x, np.float32(1))))
    y = np.array([langs.index(r["lang"]) for r in got], np.int64)
    del got
    rng = np.random.default_rng(7)
    cal = rng.random(len(y)) < 0.2 if len(y) >= 50 else np.zeros(len(y), bool)
    train, check = np.flatnonzero(~cal), np.flatnonzero(cal)
    w = _ftrl([data[i] for i in train], y[train], len(langs), rng)
    logits = np.array([w[:, data[i][0]] @ data[i][1] for i in check]).reshape(len(check), len(langs))
    return LanguageModel(langs, idf, w, _temperature(logits, y[check]))


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", lang_name: str = "lang_pred",
            score_name: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its probability.

    Null texts, empty ones and those without a letter get ``und`` and 0.0, as
    do all texts if the model has learnt no language.  Other columns pass
    through; columns of the two names are replaced.  Equal probabilities go to
    the language first in order.
    """
    ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts):
        out = [shared.value.predict(t) for t in texts]
        return [o[0] for o in out], [o[1] for o in out]

    return with_scores(docs, text_col, score, [(lang_name, pa.string()), (score_name, pa.float64())])
