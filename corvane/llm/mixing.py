"""Mixing sources to target weights (problem 9).

The plan: a mixture's weights are source token shares raised to an exponent. From
a target, the family is ``target^(1 - x) * tokens^x``, normalised: x = 0 is the
target itself, x = 1 uses every source equally often. The exponent is bisected to
the smallest x at which no source exceeds its repetition limit; a source that is
over its limit even at x = 1 is held at the limit, and the rest of the total is
mixed again over the others. Without target shares, ``temperature`` bisects the
plain exponent ``tokens^x`` to a wanted entropy. The plan only sees one row per
source.

The realisation: a source's budget is a number of whole passes and a rest. Each
pass is a permutation by hash. The rest is a prefix of one more permutation,
found by blocks: block totals locate the block in which the budget ends, and
only within blocks are running sums taken, so no source is summed in one task.
What a source really got, and whether its limit kept it from its target, is read
from this realisation.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.llm.packing import sizes

BLOCK_DOCS = 2048


def tempered(tokens: dict[str, int], exponent: float) -> dict[str, float]:
    """Token shares raised to ``exponent`` and normalised."""
    top = max((math.log(n) for n in tokens.values() if n > 0), default=0.0)
    raw = {s: math.exp(exponent * (math.log(n) - top)) if n > 0 else 0.0 for s, n in tokens.items()}
    total = sum(raw.values()) or 1.0
    return {s: x / total for s, x in raw.items()}


def entropy(weights) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def _bisect(low: float, high: float, good, steps: int = 60) -> float:
    """The boundary of a predicate that is true at ``low`` and false at ``high``."""
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if good(mid) else (low, mid)
    return low


def temperature(tokens: dict[str, int], target_entropy: float) -> float:
    """Exponent at which the tempered shares have ``target_entropy`` (clamped to [0, 8])."""
    h = lambda x: entropy(tempered(tokens, x).values())
    if h(8.0) >= target_entropy:
        return 8.0
    return _bisect(0.0, 8.0, lambda x: h(x) >= target_entropy)


@dataclass
class SourcePlan:
    source: str
    target_share: float
    max_repeats: int
    tokens: int
    budget: float
    exponent: float  #: the bisected exponent of the source's last mixing round (1 for a source held at its limit)


def towards_tokens(targets: dict[str, float], tokens: dict[str, int], x: float) -> dict[str, float]:
    """Weights ``target^(1 - x) * tokens^x``, normalised; sources without target or tokens get none."""
    log = {s: (1 - x) * math.log(targets[s]) + x * math.log(tokens[s]) for s in targets if targets[s] > 0 and tokens.get(s, 0) > 0}
    top = max(log.values(), default=0.0)
    raw = {s: math.exp(v - top) for s, v in log.items()}
    whole = sum(raw.values()) or 1.0
    return {s: raw.get(s, 0.0) / whole for s in targets}


def plan_mixture(tokens: dict[str, int], targets: dict[str, tuple[float, int]], total: int) -> list[SourcePlan]:
    """Budgets by source from their tokens, (target share, max repeats) and the total size.

    Sources that can't reach their target are held at their limit; the others share
    the rest of ``total`` by exponent. If all limits together are under ``total``,
    every source is used to its limit.
    """
    cap = {s: max(0, r) * tokens.get(s, 0) for s, (_, r) in targets.items()}
    budget = {s: float(cap[s]) for s in targets}
    exponent = dict.fromkeys(targets, 1.0)
    held = {s for s, (t, _) in targets.items() if cap[s] < t * total or t <= 0 or not cap[s]}
    budget |= {s: 0.0 for s, (t, _) in targets.items() if t <= 0}
    while free := {s: targets[s][0] for s in targets if s not in held}:
        rest = max(0.0, total - sum(budget[s] for s in held))
        over = lambda x: {s for s, w in towards_tokens(free, tokens, x).items() if w * rest > cap[s] * (1 + 1e-12)}  # noqa: E731, B023
        if not over(0.0):
            x = 0.0
        elif not over(1.0):
            x = 1.0 - _bisect(0.0, 1.0, lambda y: not over(1.0 - y))  # noqa: B023
        else:
            held |= over(1.0)
            continue
        for s, w in towards_tokens(free, tokens, x).items():
            budget[s], exponent[s] = min(w * rest, float(cap[s])), x
        break
    return [SourcePlan(s, t, r, tokens.get(s, 0), budget[s], exponent[s]) for s, (t, r) in sorted(targets.items())]


@dataclass
class Mixture:
    """``documents``: doc_id, source, size, repeats; ``report``: one row per source."""

    documents: DataFrame
    report: DataFrame
    plan: list[SourcePlan]


def mix_sources(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 17) -> Mixture:
    """Choose how often every document is used so that sources meet their target shares.

    ``targets`` (one row per source, so bounded by their number; null sources and
    shares are ignored) has ``source, target_share, max_repeats``; a null limit
    counts as 1. ``total`` defaults to the byte tokens of all documents. Sources
    without documents get a budget of 0; documents of other or null sources are
    not used. In ``report``, ``used`` and ``actual_share`` are counted from the
    mixture's documents, and ``capped`` says that every document of the source is
    used as often as allowed and the source still lacks some of its target.
    """
    spark = documents.sparkSession
    doc = documents.select("doc_id", "source", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("size")).where("doc_id is not null")
    goals = {r["source"]: (float(r["target_share"]), int(r["max_repeats"] if r["max_repeats"] is not None else 1)) for r in targets.select("source", "target_share", "max_repeats").where("source is not null and target_share is not null").collect()}
    known = F.col("source").isin(list(goals)) if goals else F.lit(False)
    # One pass; sources outside the targets are summed under one name, so the result has one row per target.
    stats = {r["s"]: (r["t"], r["n"]) for r in doc.groupBy(F.when(known, F.col("source")).alias("s")).agg(F.sum("size").alias("t"), F.count("*").alias("n")).collect()}
    total = sum(t for t, _ in stats.values()) if total is None else total
    plan = plan_mixture({s: t for s, (t, _) in stats.items() if s is not None}, goals, total)
    rows = []
    for p in plan:
        passes = int(p.budget // p.tokens) if p.tokens else 0
        rows.append((p.source, p.target_share, p.max_repeats, p.tokens, float(p.budget), passes, float(p.budget - passes * p.tokens), max(1, stats.get(p.source, (0, 0))[1] // BLOCK_DOCS)))
    plan_df = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, tokens bigint, budget double, passes int, rest double, blocks int")
    order = F.xxhash64("doc_id", F.lit(seed))
    placed = doc.join(F.broadcast(plan_df.select("source", "passes", "rest", "blocks")), "source").withColumn("_o", order).withColumn("_b", F.pmod(F.shiftrightunsigned("_o", 20), F.col("blocks")))
    totals = placed.where("rest > 0").groupBy("source", "_b").agg(F.sum("size").alias("bt"))
    before = totals.select("source", "_b", F.coalesce(F.sum("bt").over(W.partitionBy("source").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = W.partitionBy("source", "_b").orderBy("_o", "doc_id")
    used = (
        placed.join(before, ["source", "_b"], "left")
        .withColumn("_upto", F.col("_before") + F.sum("size").over(within))
        .withColumn("repeats", F.col("passes") + F.when(F.coalesce(F.col("_upto") <= F.col("rest"), F.lit(False)), 1).otherwise(0))
        .where("repeats > 0").select("doc_id", "source", "size", "repeats")
    )
    got = used.groupBy("source").agg(F.sum(F.col("size") * F.col("repeats")).alias("used"), F.max("repeats").alias("most"))
    report = plan_df.join(got, "source", "left").withColumn("used", F.coalesce("used", F.lit(0))).select(
        "source", "target_share", "max_repeats", "tokens",
        ((F.col("used") >= F.col("max_repeats") * F.col("tokens")) & (F.col("used") < F.col("target_share") * F.lit(total))).alias("capped"),
        "used", F.coalesce("most", F.lit(0)).alias("most_repeats"))
    report = report.withColumn("actual_share", F.round(F.col("used") / F.greatest(F.lit(1), F.sum("used").over(W.partitionBy())), 6))
    return Mixture(used, report, plan)


def passes(mixture: Mixture, seed: int = 17) -> DataFrame:
    """One row per use of a document: ``doc_id, source, pass_no, order_key`` (sort by pass and key to shuffle)."""
    return mixture.documents.select("doc_id", "source", F.explode(F.sequence(F.lit(1), "repeats")).alias("pass_no")).withColumn("order_key", F.xxhash64("doc_id", "pass_no", F.lit(seed)))


def capped_sources(mixture: Mixture) -> DataFrame:
    """``source`` of every target that its repetition limit keeps below its share, by what it was really given."""
    return mixture.report.where("capped").select("source")
