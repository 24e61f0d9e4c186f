"""Mixing sources to target weights by hash order, distributed prefix sums and exact cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmodes.operators.prefix import running_sums
from panelmodes.session import cut


def _targets(targets: DataFrame, total: DataFrame) -> DataFrame:
    """One row per plan and source with its budget in tokens."""
    clean = targets.where("plan_id IS NOT NULL AND source IS NOT NULL AND target_share > 0 AND max_repeats > 0 AND size_ratio > 0 AND NOT isnan(target_share) AND NOT isnan(size_ratio)")
    one = clean.groupBy("plan_id", "source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"), F.max("size_ratio").alias("size_ratio"))
    total_tokens = total.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first().t
    return one.withColumn("budget", F.col("target_share") * F.col("size_ratio") * F.lit(float(total_tokens)))


def _filled(left: DataFrame, gaps: DataFrame) -> DataFrame:
    """(plan_id, source, doc_id): documents of ``left`` that fill the ``gaps`` (plan_id, source, gap).

    Each round a pool takes its largest document that fits, or, where that is under half of the gap, all that fit in hash order; so every round halves the gap, until nothing
    left fits. At last the smallest one left is taken if at least half of it fits.
    """
    pool = ["plan_id", "source"]
    taken = None
    while True:
        open_ = left.join(F.broadcast(gaps), pool)  # a row per target
        if taken is not None:
            open_ = open_.join(taken.select(*pool, "doc_id"), [*pool, "doc_id"], "left_anti")
        fits = open_.where("tokens <= gap")
        best = cut(fits.groupBy(*pool).agg(F.max(F.struct("tokens", "_key", "doc_id")).alias("b"), F.max("gap").alias("gap")))
        if best.isEmpty():
            break
        got = best.where("b.tokens * 2 >= gap").select(*pool, "b.doc_id", "b.tokens")
        small = best.where("b.tokens * 2 < gap").select(*pool)
        if not small.isEmpty():
            summed = running_sums(fits.join(F.broadcast(small), pool), ("_key", "doc_id"), {"_end": F.col("tokens")}, "_pool")
            got = got.unionByName(summed.where("_end <= gap").select(*pool, "doc_id", "tokens"))
        got = cut(got)
        used = got.groupBy(*pool).agg(F.sum("tokens").alias("used"))
        gaps = cut(gaps.join(used, pool, "left").select(*pool, (F.col("gap") - F.coalesce("used", F.lit(0))).alias("gap")))
        taken = got if taken is None else taken.unionByName(got)
    last = open_.where("gap > 0").groupBy(*pool).agg(F.min(F.struct("tokens", "_key", "doc_id")).alias("b"), F.max("gap").alias("gap")).where("b.tokens <= 2 * gap").select(*pool, "b.doc_id")
    return last if taken is None else last.unionByName(taken.select(*pool, "doc_id"))


def mix(sizes: DataFrame, targets: DataFrame, seed: int = 3) -> tuple[DataFrame, DataFrame]:
    """The drawn documents (plan_id, source, doc_id, tokens, repeats) and the targets with their budgets.

    ``sizes`` has doc_id, source and tokens of every document; the wanted size of a plan is its size_ratio of all their tokens, also of those without source.
    Within plan and source, documents stand in the order of a seeded hash, and a distributed prefix sum of tokens cuts at the source's budget: as many whole
    epochs as fit, then a last one up to the document that crosses the budget. That one is skipped, and what is left of the budget is filled with documents
    of the rest that fit. So the cut misses the budget by less than the smallest document not used in it, unless the source has too few tokens for
    ``max_repeats`` epochs: then all are used as often as allowed.
    Documents of NULL or unlisted source, NULL id or without tokens are never drawn. Rows of ``targets`` with NULL, NaN or non-positive fields are no
    target; of repeated ones the largest values count.

    A source with most of the rows is range-sorted over many tasks.
    """
    goals = _targets(targets, sizes)
    drawable = sizes.where("doc_id IS NOT NULL AND source IS NOT NULL AND tokens > 0").select("doc_id", "source", "tokens")
    each = drawable.join(goals.select("plan_id", "source"), "source").withColumns({"_key": F.xxhash64(F.lit(seed), "plan_id", "doc_id"), "_pool": F.concat_ws("\0", "plan_id", "source")})
    summed = running_sums(each, ("_key", "doc_id"), {"_end": F.col("tokens")}, "_pool")
    pools = each.groupBy("plan_id", "source").agg(F.sum("tokens").alias("_all"))
    plan = goals.join(pools, ["plan_id", "source"]).withColumn("_epochs", F.least(F.floor(F.col("budget") / F.col("_all")), F.col("max_repeats")))
    plan = plan.withColumn("_rest", F.when(F.col("_epochs") < F.col("max_repeats"), F.col("budget") - F.col("_epochs") * F.col("_all")).otherwise(0.0))
    cutting = cut(summed.join(plan.select("plan_id", "source", "_epochs", "_rest"), ["plan_id", "source"]))
    inside = F.col("_end") <= F.col("_rest")
    gaps = cut(cutting.where("_rest > 0").groupBy("plan_id", "source").agg((F.max("_rest") - F.coalesce(F.max(F.when(inside, F.col("_end"))), F.lit(0))).alias("gap")))
    more = _filled(cutting.where((F.col("_rest") > 0) & ~inside), gaps).withColumn("_more", F.lit(1))
    again = ((F.col("_rest") > 0) & inside).cast("int") + F.coalesce("_more", F.lit(0))
    drawn = cutting.join(more, ["plan_id", "source", "doc_id"], "left").withColumn("repeats", (F.col("_epochs") + again).cast("int")).where("repeats > 0")
    return drawn.select("plan_id", "source", "doc_id", "tokens", "repeats"), goals


def shares(drawn: DataFrame, goals: DataFrame) -> DataFrame:
    """(plan_id, source, target_share, share, target_tokens, tokens, documents, most_repeats, met): what each source really contributes.

    ``share`` is of the plan's reached size; ``met`` tells whether the source reached 99 % of its budget. Sources without documents stand with zeros.
    """
    got = drawn.groupBy("plan_id", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeats"))
    sizes = got.groupBy("plan_id").agg(F.sum("tokens").alias("size"))
    full = goals.join(got, ["plan_id", "source"], "left").join(sizes, "plan_id", "left").fillna(0, ["tokens", "documents", "most_repeats"])
    return full.select(
        "plan_id", "source", "target_share", F.coalesce(F.try_divide(F.col("tokens"), F.col("size")), F.lit(0.0)).alias("share"), F.col("budget").alias("target_tokens"), "tokens", "documents", "most_repeats", (F.col("tokens") >= 0.99 * F.col("budget")).alias("met")
    )
