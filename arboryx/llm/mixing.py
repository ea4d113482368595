"""Mixing sources to token targets by entropy balancing, in DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut
from .common import WORD, numbered

#: Rows of one (source, size) class that are ranked together when a class is rounded.
RANKED = 200
#: Relative error of a source's expected words that is still accepted when rounds end.
ACCEPTED = 1e-6


def targets(sources: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Adds ``target`` to (source, source_size).

    Sources by code point, null last, get ``weights`` in turn and share ``share`` times all sizes
    by weight. No target is above ``cap`` times its source's size: the excess is shared again by
    weight until none is. That fixed point is min(cap * size, weight * level); each round takes the
    sources that are full at the level so far, and raises the level for the others. Sources may be many:
    they are numbered range by range, and a round sends two sums to the driver.
    """
    order = numbered(sources.orderBy(F.col("source").asc_nulls_last()), "_number")
    weight = F.array(*[F.lit(float(w)) for w in weights])[F.pmod(F.col("_number"), F.lit(len(weights))).cast("int")]
    most = F.lit(float(cap)) * F.col("source_size")
    rated = cut(order.select("source", "source_size", weight.alias("_w"), most.alias("_most")))
    total = share * (rated.agg(F.sum("source_size")).first()[0] or 0)
    level = -1.0
    while True:
        open_ = F.col("_most") > F.col("_w") * F.lit(level)
        used, left = rated.agg(F.sum(F.when(~open_, F.col("_most"))), F.sum(F.when(open_, F.col("_w")))).first()
        reached = (total - (used or 0.0)) / left if left else math.inf
        if reached <= level or not left:
            break
        level = reached
    return rated.select("source", "source_size", F.least("_most", F.col("_w") * F.lit(level)).alias("target"))


def balance(classes: DataFrame, goals: DataFrame, cap: float, tolerance: float = 1e-9, max_rounds: int = 60) -> DataFrame:
    """(source, _lam): multipliers of the convex dual, by safeguarded Newton steps on all sources at once.

    ``classes`` is (source, size, n). Among rates r in [0, cap] per document whose expected tokens
    meet the source's target, the ones nearest to 1 in relative entropy are
    r = min(cap, exp(lam * size / unit)), unit being the source's tokens-weighted mean size. Each
    round sums the dual's gradient and curvature per source over all classes; a step that leaves
    the bracket is replaced by halving it. Sources at their cap or without tokens have no multiplier
    to find. Only the largest relative error reaches the driver. Rounds end at ``tolerance``; if after
    ``max_rounds`` the error is still above ACCEPTED, that is an error.
    """
    unit = classes.where("size > 0").groupBy("source").agg((F.sum(F.col("size") * F.col("size") * F.col("n")) / F.sum(F.col("size") * F.col("n"))).alias("_unit"))
    open_goals = goals.where((F.col("source_size") > 0) & (F.col("target") < F.col("source_size") * cap) & (F.col("target") > 0))
    both = F.col("l.source").eqNullSafe(F.col("r.source"))
    state = cut(
        open_goals.alias("l").join(unit.alias("r"), both).select("l.source", "target", "_unit", "source_size")
        .withColumn("_lam", F.log(F.col("target") / F.col("source_size")))
        .withColumn("_lo", F.lit(None).cast("double"))
        .withColumn("_hi", F.lit(None).cast("double"))
        .withColumn("_err", F.lit(1.0))
        .drop("source_size")
    )
    for _ in range(max_rounds):
        z = F.col("size") / F.col("_unit")
        rate = F.exp(F.least(F.col("_lam") * z, F.log(F.lit(float(cap)))))
        free = F.col("_lam") * z < F.log(F.lit(float(cap)))
        sums = (
            classes.alias("l").join(state.alias("r"), both)
            .groupBy("r.source", "target", "_unit", "_lam", "_lo", "_hi")
            .agg(
                F.sum(F.col("n") * F.col("size") * rate).alias("_got"),
                F.sum(F.when(free, F.col("n") * F.col("size") * rate * z).otherwise(0.0)).alias("_slope"),
            )
        )
        lo = F.when(F.col("_got") <= F.col("target"), F.col("_lam")).otherwise(F.col("_lo"))
        hi = F.when(F.col("_got") > F.col("target"), F.col("_lam")).otherwise(F.col("_hi"))
        newton = F.col("_lam") - (F.col("_got") - F.col("target")) / F.nullif(F.col("_slope"), F.lit(0.0))
        newton = F.least(F.greatest(newton, F.col("_lam") - 4), F.col("_lam") + 4)
        inside = (F.coalesce(F.col("_lo2"), F.lit(-1e300)) <= newton) & (newton <= F.coalesce(F.col("_hi2"), F.lit(1e300)))
        halved = (F.coalesce(F.col("_lo2"), F.col("_hi2") - 8) + F.coalesce(F.col("_hi2"), F.col("_lo2") + 8)) / 2
        err = F.abs(F.col("_got") - F.col("target")) / F.col("target")
        state = cut(
            sums.withColumns({"_lo2": lo, "_hi2": hi, "_err": err})
            .withColumn("_next", F.when(F.col("_err") <= tolerance, F.col("_lam")).when((F.col("_slope") > 0) & inside, newton).otherwise(halved))
            .select("source", "target", "_unit", F.col("_next").alias("_lam"), F.col("_lo2").alias("_lo"), F.col("_hi2").alias("_hi"), "_err")
        )
        worst = state.agg(F.max("_err")).first()[0]
        if worst is None or worst <= tolerance:
            break
    else:
        if worst > ACCEPTED:
            raise RuntimeError(f"the multipliers are off by {worst:.2g} of a target after {max_rounds} rounds")
    return state.select("source", "_lam", "_unit")


def _closer(rated: DataFrame, cap: float) -> DataFrame:
    """Moves one document of one size per source, where that brings the source nearer its target.

    ``_more`` documents of each (source, size) get an extra copy; what a source still lacks or has too
    much is compared with its sizes, and the size nearest to it gains or loses one.
    """
    lacking = F.sum(F.col("n") * (F.col("rate") - F.floor("rate")) * F.col("size") - F.col("_more") * F.col("size"))
    gaps = rated.groupBy("source").agg(lacking.alias("_gap"))
    same = F.col("l.source").eqNullSafe(F.col("r.source"))
    near = rated.alias("l").join(gaps.alias("r"), same).select("l.*", "_gap")
    room = (F.col("size") > 0) & F.when(F.col("_gap") > 0, (F.col("_more") < F.col("n")) & (F.floor("rate") + 1 <= cap)).otherwise(F.col("_more") > 0)
    off = F.abs(F.abs(F.col("_gap")) - F.col("size"))
    best = near.where(room & (off < F.abs(F.col("_gap")))).groupBy("source", "_gap").agg(F.min(F.struct(off.alias("off"), F.col("size").alias("size"))).alias("_best"))
    moved = near.alias("l").join(best.alias("r"), same, "left").select("l.*", "_best")
    step = F.when(F.col("size") == F.col("_best.size"), F.signum("_gap").cast("long")).otherwise(0)
    return moved.withColumn("_more", F.col("_more") + step).drop("_gap", "_best")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size) with size in words; a null text has none."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(id_col), F.col(source_col).alias("source"), size.alias("size"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Copies of each document that bring each source near its target.

    Returns one row per row of ``docs``: (id, source, size, source_size, target, rate, copies).
    Rates come from ``balance`` and depend on (source, size) alone; they are rounded without a draw:
    along a source's sizes the running sum of expected copies is rounded, then one document more or less
    closes most of the gap that is left, and within a class of equal sizes the documents
    with the smallest hash of the id get the larger count. Classes of many rows are split into hash
    ranges; only the range in which the count runs out is ranked.

    Null sources form one source of their own, ordered last. Documents without words have size 0 and
    are taken once, which adds no word. Repeated rows count each; an empty table gives no row. ``id_col`` may
    have any name but those of the result's other columns; extra columns are not looked at.
    """
    base = cut(sized(docs, id_col, text_col, source_col))
    classes = cut(base.groupBy("source", "size").agg(F.count("*").alias("n")))
    goals = cut(targets(classes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, cap))
    multipliers = balance(classes, goals, cap)
    same = F.col("l.source").eqNullSafe(F.col("r.source"))
    log_rate = F.least(F.col("_lam") * F.col("size") / F.col("_unit"), F.log(F.lit(float(cap))))
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("_lam").isNotNull(), F.exp(log_rate)).otherwise(F.col("target") / F.col("source_size"))
    along = Window.partitionBy("source").orderBy(F.col("size").desc())
    expected = F.sum(F.col("n") * (F.col("rate") - F.floor("rate"))).over(along)
    rated = (
        classes.alias("l").join(goals.alias("r"), same).select("l.source", "size", "n", "source_size", "target").alias("l")
        .join(multipliers.alias("r"), same, "left").select("l.*", "_lam", "_unit")
        .withColumn("rate", F.round(rate, 9))  # sums in another order differ in the last digits alone
        .withColumn("_sum", expected)
        .withColumn("_more", F.floor(F.col("_sum") + 0.5) - F.floor(F.coalesce(F.lag("_sum").over(along), F.lit(0.0)) + 0.5))
        .withColumn("_more", F.least(F.greatest("_more", F.lit(0)), "n"))
        .withColumn("_ranges", F.ceil(F.col("n") / RANKED))
        .drop("_lam", "_unit", "_sum")
    )
    rated = cut(_closer(rated, cap))
    match = same & (F.col("l.size") == F.col("r.size"))
    hashed = F.xxhash64(id_col)
    keyed = (
        base.alias("l").join(rated.alias("r"), match)
        .select(f"l.{id_col}", "l.source", "l.size", "source_size", "target", "rate", "n", "_more", "_ranges")
        .withColumn("_h", hashed)
        .withColumn("_range", F.floor(F.shiftrightunsigned("_h", 1) / F.lit(2.0**63) * F.col("_ranges")).cast("long"))
    )
    ranges = keyed.where("_more > 0 and _more < n").groupBy("source", "size", "_range").agg(F.count("*").alias("_c"))
    upto = Window.partitionBy("source", "size").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_c").over(upto), F.lit(0)))
    joined = keyed.alias("l").join(ranges.alias("r"), match & (F.col("l._range") == F.col("r._range")), "left").select("l.*", "_c", "_before")
    full = (F.col("_more") >= F.col("n")) | (F.col("_before") + F.col("_c") <= F.col("_more"))
    none = (F.col("_more") <= 0) | (F.col("_before") >= F.col("_more"))
    decided = joined.withColumn("_extra", F.when(none, 0).when(full, 1)).drop("_c")
    ranked = decided.where("_extra is null").withColumn(
        "_extra",
        (F.row_number().over(Window.partitionBy("source", "size", "_range").orderBy("_h", id_col)) + F.col("_before") <= F.col("_more")).cast("int"),
    )
    return decided.where("_extra is not null").union(ranked).select(
        id_col, "source", "size", "source_size", "target", "rate", (F.floor("rate") + F.col("_extra")).cast("long").alias("copies")
    )


def apply_mix(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with each row repeated as often as ``mixed`` says.

    Rows of one id, source and size get the same number of copies, the largest of theirs. Columns may
    have any names; an empty table stays empty.
    """
    key = [F.col(id_col).alias("id"), F.col("source"), F.col("size")]
    copies = mixed.select(*key, "copies").groupBy("id", "source", "size").agg(F.max("copies").alias("copies"))
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"))
    same = F.col("l.id").eqNullSafe(F.col("r.id")) & F.col("l.source").eqNullSafe(F.col("r.source")) & (F.col("l.size") == F.col("r.size"))
    taken = rows.alias("l").join(copies.where("copies > 0").alias("r"), same)
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")
