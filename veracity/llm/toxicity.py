"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes
log-count ratios.

A feature is the presence of a character n-gram of ``ORDERS`` lower-cased
characters anywhere in the whole text; its value is the log-count ratio
log((p + 1) / sum(p + 1)) - log((q + 1) / sum(q + 1)) of the toxic and the other
training texts that have it.  N-grams whose share differs between the two by
at least ``Z`` standard errors are kept, and a logistic regression with an L2
penalty is fitted on the scaled features.

The classifier learns from at most ``SAMPLE`` labelled rows, half of them toxic
if there are as many; the intercept is set back to the labels' own share.
The n-grams are found in two steps, so that no count of all n-grams is kept:
counts by hash bucket pick the buckets that differ, and only n-grams in these
are counted by their own 64-bit code.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veracity.llm.common import held_out, ready, stage, with_scores

ORDERS = (3, 4, 5, 6)
BUCKETS = 1 << 18
SAMPLE = 4_000
Z = 5.0
MAX_BUCKETS = 8_192
PENALTY = 0.1
_PIECE = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(64 - 18)


def grams(text: str | None):
    """Pieces of (64-bit codes, buckets) of a text's n-grams, repeats and all."""
    text = (text or "").lower()
    for at in range(0, len(text), _PIECE):
        c = np.frombuffer(text[at:at + _PIECE + max(ORDERS) - 1].encode("utf-32-le"), np.uint32).astype(np.uint64)
        h = c
        for n in range(2, max(ORDERS) + 1):
            if len(c) < n:
                break
            h = (h[:len(c) - n + 1] * _MIX) ^ (c[n - 1:] + np.uint64(n << 32))
            if n in ORDERS:
                code = h[:_PIECE] * _MIX
                yield code, (code >> _SHIFT).astype(np.int32)


def _chosen(text: str | None, mask: np.ndarray) -> np.ndarray:
    """Distinct codes of the text's n-grams in the buckets of the mask."""
    found = [code[mask[bucket]] for code, bucket in grams(text)]
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)


def _bucket_counts(batches):
    seen = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            has = np.zeros(BUCKETS, bool)
            for _, bucket in grams(text.as_py()):
                has[bucket] = True
            seen[toxic] += has
    at = np.flatnonzero(seen.sum(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[1, at]), pa.array(seen[0, at])], names=["bucket", "p", "q"])


def _differs(p: np.ndarray, q: np.ndarray, pos: float, neg: float) -> np.ndarray:
    """Standard errors between the shares p of pos rows and q of neg rows."""
    share = (p + q + 1) / (pos + neg + 2)
    return (p / max(pos, 1) - q / max(neg, 1)) / np.sqrt(share * (1 - share) * (1 / max(pos, 1) + 1 / max(neg, 1)))


@dataclass
class ToxicityModel:
    mask: np.ndarray  # of buckets
    codes: np.ndarray  # sorted
    weights: np.ndarray  # of codes, log-count ratio included
    bias: float

    def score(self, text: str | None) -> float:
        """Probability of the label; an empty text has the intercept's."""
        z = self.bias
        if len(self.codes):
            own = _chosen(text, self.mask)
            at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
            z += float(self.weights[at[self.codes[at] == own]].sum())
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _logistic(row: np.ndarray, col: np.ndarray, x: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """Weights and intercept of the least log loss + PENALTY * |w|^2 / 2, by
    Newton steps solved with conjugate gradients; (row, col, x) are the entries."""
    m = len(y)
    l2 = np.append(np.full(n, PENALTY), 1e-6)

    def margins(w):
        return np.bincount(row, x * w[col], m) + w[n]

    def back(r):
        return np.append(np.bincount(col, x * r[row], n), r.sum())

    def loss(w):
        z = margins(w)
        return float(np.logaddexp(0, z).sum() - y @ z + (l2 * w * w).sum() / 2)

    w = np.zeros(n + 1)
    now = loss(w)
    for _ in range(15):
        p = 1 / (1 + np.exp(-np.clip(margins(w), -40, 40)))
        g = back(p - y) + l2 * w
        h = p * (1 - p)
        size = np.append(np.bincount(col, x * x * h[row], n), h.sum()) + l2
        step, r = np.zeros(n + 1), -g
        v = r / size
        d, rv = v, r @ v
        for _ in range(25):
            hd = back(h * margins(d)) + l2 * d
            a = rv / max(d @ hd, 1e-300)
            step, r = step + a * d, r - a * hd
            v = r / size
            rv, was = r @ v, rv
            if not rv or np.abs(r).max() < 1e-2 * np.abs(g).max():
                break
            d = v + rv / was * d
        t = 1.0
        while t > 1e-4 and loss(w + t * step) > now:
            t /= 2
        new = loss(w + t * step)
        if now - new < 1e-4 * abs(now):
            break
        w, now = w + t * step, new
    return w[:n], float(w[n])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic") -> ToxicityModel:
    """Learn from labelled rows that aren't held out.  A row without a label or
    without a document is skipped, of several labels the highest counts; if
    either label is missing, every text gets the labels' share (0 if there is none)."""
    spark = docs.sparkSession
    ready(spark)
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where(
        F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    if not pos or not neg:
        z = 40.0 if pos else -40.0
        return ToxicityModel(np.zeros(BUCKETS, bool), np.empty(0, np.uint64), np.empty(0), z)
    want = min(pos, sample // 2), min(neg, sample - min(pos, sample // 2))
    chance = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1_000_003)) / F.lit(1_000_003)
    drawn = known.where(chance < F.when(F.col("toxic") == 1, want[0] / pos).otherwise(want[1] / neg)).limit(sample + sample // 10)
    # at most `sample` and a tenth ids: a bounded broadcast
    rows = stage(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(drawn), "doc_id"), "labelled")

    counted = rows.select("text", "toxic").mapInArrow(_bucket_counts, "bucket long, p long, q long").groupBy("bucket").agg(
        F.sum("p").alias("p"), F.sum("q").alias("q"))
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    m_pos, m_neg = float(n.get(1, 0)), float(n.get(0, 0))
    share = (F.col("p") + F.col("q") + 1) / F.lit(m_pos + m_neg + 2)
    apart = F.abs(F.col("p") / F.lit(max(m_pos, 1)) - F.col("q") / F.lit(max(m_neg, 1))) / F.sqrt(
        share * (1 - share) * F.lit(1 / max(m_pos, 1) + 1 / max(m_neg, 1)))
    picked = counted.select("bucket", apart.alias("z")).where(F.col("z") >= Z).orderBy(F.desc("z"), "bucket").limit(MAX_BUCKETS)
    mask = np.zeros(BUCKETS, bool)
    mask[[r["bucket"] for r in picked.collect()]] = True
    shared = spark.sparkContext.broadcast(mask)

    def chosen(batches):
        for batch in batches:
            found = [_chosen(t.as_py(), shared.value).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.binary())], names=["doc_id", "toxic", "codes"])

    got = rows.select("doc_id", "text", "toxic").mapInArrow(chosen, "doc_id long, toxic int, codes binary").collect()
    got.sort(key=lambda r: (r["doc_id"], r["codes"]))
    y = np.array([r["toxic"] for r in got], float)
    each = [np.frombuffer(r["codes"], np.uint64) for r in got]
    row = np.repeat(np.arange(len(each)), [len(e) for e in each])
    codes, col = np.unique(np.concatenate(each) if each else np.empty(0, np.uint64), return_inverse=True)
    p, q = np.bincount(col, y[row], len(codes)), np.bincount(col, 1 - y[row], len(codes))
    keep = np.flatnonzero(np.abs(_differs(p, q, y.sum(), len(y) - y.sum())) >= Z)
    ratio = np.log((p + 1) / (p + 1).sum()) - np.log((q + 1) / (q + 1).sum()) if len(codes) else np.empty(0)
    new = np.full(len(codes), -1)
    new[keep] = np.arange(len(keep))
    held = new[col] >= 0
    x = ratio[col[held]]
    w, bias = _logistic(row[held], new[col[held]], x, y, len(keep))
    bias += np.log(pos / neg) - np.log(max(y.sum(), 1) / max(len(y) - y.sum(), 1))
    return ToxicityModel(mask, codes[keep], w * ratio[keep], float(bias))


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_name: str = "score") -> DataFrame:
    """``docs`` with the probability of being toxic.

    Null and empty texts get the intercept's probability.  Very long texts are
    read whole, in parts; equal texts get equal scores, in repeated rows too; an
    empty table stays empty.  Other columns pass through; a column of the name is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return with_scores(docs, text_col, lambda texts: [[shared.value.score(t) for t in texts]], [(score_name, pa.float64())])
