"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions only.

The leaves of a tree (domain, language, source) hold documents.  A budget of
tokens goes down the tree: siblings share their parent's budget in proportion to
their weights, none takes more than its subtree can give in ``epochs`` passes, and
what one can't take goes to its siblings.  A parent never gets more than its
subtree can give, so a shortage reaches an ancestor's siblings only when the
subtree is used up.

A leaf's documents are taken in seeded epochs: whole ones as far as its
budget goes, then the longest prefix of the next epoch's seeded order whose
tokens fit.  The order is by the first 60 bits of md5(seed:epoch:id).  The end of the
prefix is found without ordering a leaf in one task: token sums by ranges of the
hash, then the order inside the one range where the budget ends.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veracity.llm.common import stage

LEVELS = ("domain", "lang", "source")
UNKNOWN = "unknown"
RANGE_ROWS = 200
BROADCAST_LEAVES = 50_000  # a leaf's row in the plan has about 150 bytes
_SPAN = float(1 << 60)


def n_tokens(text: Column) -> Column:
    """Words of the whole text, split at ASCII white space; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _weight(level: str, weights: dict[str, float], default: float) -> Column:
    known = reduce(lambda c, kv: c.when(F.col(level) == kv[0], float(kv[1])), list(weights.items())[1:],
                   F.when(F.col(level) == next(iter(weights)), float(next(iter(weights.values()))))) if weights else F.lit(None).cast("double")
    return F.coalesce(known, F.lit(float(default)))


def share_out(nodes: DataFrame, parent: list[str], budget: str, cap: str, weight: str, out: str) -> DataFrame:
    """``nodes`` with ``out``: least of cap and weight * level, the level being such
    that siblings use up the budget as far as their caps allow."""
    ratio = F.when(F.col(weight) > 0, F.col(cap) / F.col(weight)).otherwise(F.lit(float("inf")))
    group = Window.partitionBy(*parent)
    order = group.orderBy(ratio, cap, weight)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    room = F.col(budget) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))
    full = (F.col(weight) > 0) & (F.col(cap) * F.sum(weight).over(after) <= room * F.col(weight))
    known = nodes.withColumn("_full", full)
    left = F.col(budget) - F.sum(F.when(F.col("_full"), F.col(cap)).otherwise(0.0)).over(group)
    open_ = F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col(weight))).over(group)
    part = F.when(F.col("_full"), F.col(cap)).when(F.col(weight) > 0, F.col(weight) * left / open_).otherwise(0.0)
    return known.withColumn(out, part).drop("_full")


def budgets(leaves: DataFrame, weights: dict[str, dict[str, float]], default: float, share: float, epochs: int) -> DataFrame:
    """(domain, lang, source, docs, tokens, budget) from (domain, lang, source, docs, tokens)."""
    t = leaves
    for level in LEVELS:
        t = t.withColumn(f"w_{level}", _weight(level, weights.get(level, {}), default))
    usable = reduce(lambda a, b: a & b, [F.col(f"w_{level}") > 0 for level in LEVELS])
    everything = Window.partitionBy(F.lit(1))  # one row for each leaf
    t = t.withColumn("cap", F.when(usable, F.col("tokens").cast("double") * epochs).otherwise(0.0))
    t = t.withColumn("b0", F.least(F.floor(F.sum("tokens").over(everything) * F.lit(share)).cast("double"), F.sum("cap").over(everything)))
    for i, level in enumerate(LEVELS):
        path, parent = list(LEVELS[:i + 1]), list(LEVELS[:i])
        nodes = t.groupBy(*path).agg(F.sum("cap").alias("cap"), F.max(f"w_{level}").alias("w"), F.max(f"b{i}").alias("b"))
        got = share_out(nodes.withColumn("root", F.lit(1)), parent or ["root"], "b", "cap", "w", f"b{i + 1}").select(*path, f"b{i + 1}")
        t = t.join(got, path)
    return t.select(*LEVELS, "docs", "tokens", F.floor(F.col(f"b{len(LEVELS)}") + 1e-6).cast("long").alias("budget"))


def mix(docs: DataFrame, domain: Column, weights: dict[str, dict[str, float]], default: float = 1.0, share: float = 0.6,
        epochs: int = 2, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        source_col: str = "source", keep_all: bool = True) -> DataFrame:
    """Every row of ``docs`` with domain_, lang_, source_, n_tokens_ and copies_:
    how often the mix takes it (0 to ``epochs``).  ``keep_all=False`` returns the
    given columns of the rows that are taken, as often as they are taken.

    ``weights`` has target weights by level and value, ``default`` is that of other
    values; a weight of 0 takes nothing.  The budget is ``share`` of all tokens.
    A null domain, language or source is the leaf value "unknown".  A null or
    empty text has no tokens; a leaf without tokens gives nothing.  Rows of one
    id stand at one place of the order and are taken or left together.  Columns of
    the five new names are replaced.
    """
    new = ["domain_", "lang_", "source_", "n_tokens_", "copies_"]
    given = [c for c in docs.columns if c not in new]
    docs = docs.select(*[F.col(f"`{c}`") for c in given])
    own_id = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    leaf = [F.coalesce(domain.cast("string"), F.lit(UNKNOWN)).alias("domain"), F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"),
            F.coalesce(F.col(source_col).cast("string"), F.lit(UNKNOWN)).alias("source")]
    sized = stage(docs.select(own_id.alias("id"), *leaf, n_tokens(F.col(text_col)).alias("tokens")), "sized")
    leaves = sized.groupBy(*LEVELS).agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens"))
    plan = budgets(leaves, weights, default, share, epochs)
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("long")
    plan = plan.withColumn("whole", whole).select(
        *LEVELS, "whole", (F.col("budget") - F.col("whole") * F.col("tokens")).alias("left"),
        F.ceil(F.col("docs") / RANGE_ROWS).cast("double").alias("ranges"))
    plan = stage(plan, "budgets")  # one row for each leaf
    small = F.broadcast if plan.count() <= BROADCAST_LEAVES else lambda df: df  # else a join that may be split

    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole"), F.col("id")).cast("binary")), 1, 15), 16, 10).cast("long")
    at = F.least(F.floor(F.col("h") / F.lit(_SPAN) * F.col("ranges")), F.col("ranges") - 1).cast("long")
    placed = sized.join(small(plan), list(LEVELS)).withColumn("h", h).withColumn("at", at)
    sums = placed.groupBy(*LEVELS, "at", "left").agg(F.sum("tokens").alias("n"))
    end = sums.withColumn("upto", F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("at")))
    end = stage(end.where((F.col("upto") - F.col("n") <= F.col("left")) & (F.col("left") < F.col("upto"))).select(
        *LEVELS, F.col("at").alias("end"), (F.col("upto") - F.col("n")).alias("base")), "ends")
    # rows of one id count together, as a prefix can't part them
    last = placed.join(small(end), list(LEVELS)).where("at = end").groupBy(*LEVELS, "h", "id", "base", "left").agg(F.sum("tokens").alias("n"))
    run = F.col("base") + F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("h", "id"))
    cut = last.withColumn("run", run).where("run <= left").groupBy(*LEVELS).agg(F.max(F.struct("h", "id")).alias("cut"))
    rule = plan.join(end.select(*LEVELS, "end"), list(LEVELS), "left").join(cut, list(LEVELS), "left")

    own = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(given)]
    base = docs.select(*own, own_id.alias("id"), *leaf, n_tokens(F.col(text_col)).alias("tokens"))
    judged = base.join(small(rule), list(LEVELS)).withColumn("h", h).withColumn("at", at)
    more = F.coalesce((F.col("at") < F.col("end")) | ((F.col("at") == F.col("end")) & (F.struct("h", "id") <= F.col("cut"))), F.lit(False))
    judged = judged.withColumn("copies", F.col("whole") + more.cast("long"))
    back = [F.col(f"_c{i}").alias(c) for i, c in enumerate(given)]
    if keep_all:
        return judged.select(*back, F.col("domain").alias("domain_"), F.col("lang").alias("lang_"), F.col("source").alias("source_"),
                             F.col("tokens").alias("n_tokens_"), F.col("copies").alias("copies_"))
    taken = judged.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return taken.select(*back)
