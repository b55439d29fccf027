"""Mixing sources to target weights by entropy balancing: distributed Newton steps on the convex dual.

Rates r of documents minimise sum(size * (r log r - r + 1)), the relative entropy of the mixture's tokens to
the corpus's, with r at most `cap`, under one token constraint a source. Beside these the mixture keeps, as
far as a penalty on the tilt allows, how long the corpus's documents are: the token-weighted mean and spread
of log size are moments of the problem too. So constraints don't separate by source, a document's rate
exp(multiplier of its source + tilt . its moments) is its own, and the dual is solved for all multipliers
together: each Newton step sums gradient and Hessian over all documents in Spark; since sources meet only
through the moments, the driver gets a handful of sums (the Schur complement), and the sources' multipliers
stay in Spark. Documents of one source and size share a rate, so they are counted once and stepped as one.

Rates are then rounded into copies: every document gets the whole part, and of each source some get one
more: documents have a place, by a hash of the id, less what their rate leaves over; they fall into classes of
size (powers of two) and slots of that place, and from the largest class down slots are taken until what the
class is due, and what larger classes left over, is met. So the rest is at most a slot of small documents.
Multipliers are rounded to six decimals and sums of what is due are integers, so reruns agree.

Targets: sources in code point order, null last, weigh `weights` repeating and share all tokens; a target
stops at `cap` times its source's tokens and the excess is shared again by weight until none is above. The
driver only sees the level of the sharing, not the sources.

Cases. Null and empty texts have size 0 and take nothing; a source without tokens has target 0. Equal ids of
equal size are taken together. A null id counts as one id. An empty table gives none. Other columns are kept
if carried.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexquarry.llm.spark import cut, prepare
from lexquarry.llm.textnum import SPACED, word_counts

#: Slots of each source and class of sizes.
SLOTS = 2048
#: The plan has a row for each source and class of sizes; up to so many (of about 60 bytes) are broadcast, more are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Weight of the penalty on the tilt; steps until which Newton's method must have settled.
PENALTY, STEPS = 0.05, 40
#: What is due is counted in parts of a token.
PARTS = 1 << 16


def ranked(sources: DataFrame) -> DataFrame:
    """Adds place, from 0, in code point order of source, nulls last; no task sees more than a range of them."""
    order = F.asc_nulls_last("source")
    dealt = cut(sources.repartitionByRange(order).withColumn("part", F.spark_partition_id()))
    counts = sorted(tuple(r) for r in dealt.groupBy("part").count().collect())  # a number for each partition
    starts, before = [F.lit(0).cast("long")], 0
    for part, n in counts:
        starts.append(F.when(F.col("part") == part, F.lit(before).cast("long")))
        before += n
    start = F.coalesce(*starts[:0:-1], starts[0])
    return dealt.withColumn("place", start + F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1).drop("part")


def with_targets(sources: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """Adds target to (source, source_size), one row a source."""
    weighed = cut(ranked(sources).withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))).drop("place"))
    most = cap * F.col("source_size")
    level = 0.0
    while True:  # the level of the shares, raised by the excess of those at their cap
        full = most <= level * F.col("weight")
        row = weighed.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, most)).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if not row["open"]:
            break
        new = (row["all"] - (row["full"] or 0.0)) / row["open"]
        if new <= level:
            break
        level = new
    return weighed.withColumn("target", F.least(most.cast("double"), level * F.col("weight"))).drop("weight")


def _beside(left: DataFrame, right: DataFrame, *more: Column) -> DataFrame:
    """left with the columns of right for its source (as source_r), by broadcast if right is small."""
    right = right.withColumnRenamed("source", "source_r")
    on = F.col("source").eqNullSafe(F.col("source_r"))
    for m in more:
        on = on & m
    return left.join(F.broadcast(right) if right.count() <= BROADCAST_ROWS else right, on)


class Tilt:
    """How rates depend on size: centre and spread of log size, and the tilt along its two moments."""

    def __init__(self, centre: float, spread: float, tilt: tuple[float, float]):
        self.centre, self.spread, self.tilt = centre, spread, tilt

    def moments(self, size: Column) -> tuple[Column, Column]:
        z = (F.log(size) - self.centre) / self.spread if self.spread > 0 else F.lit(0.0)
        return z, z * z - 1

    def rate(self, size: Column, multiplier: Column, full: Column, cap: float) -> Column:
        a, b = self.moments(size)
        return F.when(full, float(cap)).otherwise(F.least(F.lit(float(cap)), F.exp(multiplier + self.tilt[0] * a + self.tilt[1] * b)))


def balanced(cells: DataFrame, targets: DataFrame, cap: float, *, penalty: float = PENALTY) -> tuple[DataFrame, Tilt]:
    """Multipliers of sources (source, multiplier, full: every rate is cap) and the tilt. cells: source, size > 0, tokens; targets: source, source_size, target."""
    w = F.col("tokens").cast("double")
    row = cells.agg(F.sum(w).alias("w"), F.sum(w * F.log("size")).alias("a"), F.sum(w * F.log("size") ** 2).alias("b")).first()
    total = row["w"] or 0.0
    centre = round(row["a"] / total, 6) if total else 0.0
    shape = Tilt(centre, round(math.sqrt(max(row["b"] / total - centre**2, 0.0)), 6) if total else 0.0, (0.0, 0.0))
    full = F.col("target") >= cap * F.col("source_size") * (1 - 1e-9)
    state = cut(targets.where("source_size > 0").select("source", "target", full.alias("full"), F.when(full, 0.0).otherwise(F.log(F.col("target") / F.col("source_size"))).alias("multiplier")))
    all_ = state.agg(F.sum("target")).first()[0] or 0.0
    a, b = shape.moments(F.col("size"))
    tilt, settled = np.zeros(2), False
    for step in range(STEPS + 20):
        rate = Tilt(shape.centre, shape.spread, tuple(tilt)).rate(F.col("size"), F.col("multiplier"), F.col("full"), cap)
        each = _beside(cells, state).select("source", "target", "multiplier", "full", a.alias("a"), b.alias("b"), (w * rate).alias("m"), (rate >= cap).alias("top"))
        # a rate at its cap stays there for small steps; a tenth of its curvature keeps the steps bounded
        curve = F.when(F.col("full"), 0.0).when(F.col("top"), 0.1 * F.col("m")).otherwise(F.col("m"))
        m, c = F.col("m"), F.col("c")
        sums = each.withColumn("c", curve).groupBy("source", "target", "multiplier", "full").agg(
            F.sum("m").alias("m"), F.sum(m * F.col("a")).alias("ma"), F.sum(m * F.col("b")).alias("mb"), F.sum(F.when(F.col("top"), m).otherwise(0.0)).alias("held"),
            F.sum("c").alias("h"), *(F.sum(c * x).alias(n) for n, x in (("va", F.col("a")), ("vb", F.col("b")), ("qaa", F.col("a") ** 2), ("qab", F.col("a") * F.col("b")), ("qbb", F.col("b") ** 2))),
        )
        sums = cut(sums.withColumn("off", F.when(F.col("full"), 0.0).otherwise(F.col("target") - F.col("m"))))
        h, off = F.greatest(F.col("h"), F.lit(1e-300)), F.col("off")
        schur = lambda q, u, v: F.sum(F.col(q) - F.col(u) * F.col(v) / h)  # noqa: E731, B023
        r = sums.agg(F.sum("ma").alias("ma"), F.sum("mb").alias("mb"), schur("qaa", "va", "va").alias("aa"), schur("qab", "va", "vb").alias("ab"), schur("qbb", "vb", "vb").alias("bb"), F.sum(F.col("va") * off / h).alias("oa"), F.sum(F.col("vb") * off / h).alias("ob"), F.max(F.abs(off) / F.col("target")).alias("worst")).first()
        if r["worst"] is None:
            break
        if settled and r["worst"] < 1e-9:
            break
        move = np.zeros(2)
        if not settled:
            curved = np.array([[r["aa"], r["ab"]], [r["ab"], r["bb"]]]) + (penalty * all_ + 1e-9) * np.eye(2)
            move = np.linalg.solve(curved, -np.array([r["ma"], r["mb"]]) - penalty * all_ * tilt - np.array([r["oa"], r["ob"]]))
            move *= min(1.0, 0.5 / max(np.abs(move).max(), 1e-300))
            settled = np.abs(move).max() < 1e-7 or step == STEPS - 1
            tilt = np.round(tilt + move, 6) if settled else tilt + move
        # alone, a source's multiplier is set by what its rates below the cap must make up
        alone = F.when((off + F.col("m") > F.col("held")) & (F.col("m") > F.col("held")), F.log((F.col("target") - F.col("held")) / (F.col("m") - F.col("held")))).otherwise(-0.5)
        joint = alone if settled else (off - F.col("va") * float(move[0]) - F.col("vb") * float(move[1])) / h
        by = F.when(F.col("full"), 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), joint)))
        state = cut(sums.select("source", "target", "full", (F.col("multiplier") + by).alias("multiplier")))
    return state.select("source", "full", F.round("multiplier", 6).alias("multiplier")), Tilt(shape.centre, shape.spread, (float(tilt[0]), float(tilt[1])))


def _taken_slots(classes: Column) -> Column:
    """Of classes (class, due, steps of (tokens up to a slot, slot)), largest first: (class, the first slot that isn't taken)."""
    start = F.struct(F.lit(0.0).alias("carried"), F.array().cast("array<struct<class: int, until: int>>").alias("out"))

    def add(state: Column, c: Column) -> Column:
        wanted = c["due"] + state["carried"]
        none = F.struct(F.abs(wanted).alias("off"), F.lit(0.0).alias("upto"), F.lit(0).alias("until"))
        ends = F.transform(c["steps"], lambda s: F.struct(F.abs(s["upto"] - wanted).alias("off"), s["upto"].alias("upto"), (s["slot"] + 1).alias("until")))
        best = F.array_min(F.concat(F.array(none), ends))
        return F.struct((wanted - best["upto"]).alias("carried"), F.concat(state["out"], F.array(F.struct(c["class"].alias("class"), best["until"].alias("until")))).alias("out"))

    return F.aggregate(classes, start, add, lambda s: s["out"])


def _parts(size: Column, rate: Column, spot: Column) -> tuple[Column, Column, Column]:
    """Whole copies, what the rate leaves over, and the slot of a document: its spot (0 to 1) less what is left over."""
    whole = F.floor(rate + 1e-9).cast("int")
    rest = F.when(size > 0, F.greatest(rate - whole, F.lit(0.0))).otherwise(0.0)
    return whole, rest, F.floor((spot - rest + 1) * (SLOTS // 2)).cast("int")


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), cap: float = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """The columns `carry` of each document, _size, _source_size, _target (its source's), _rate, _copies and _taken (copies * size)."""
    prepare(docs.sparkSession)
    spot = F.pmod(F.xxhash64(F.col(id_col), F.lit(5)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    level = F.when(F.col("size") > 0, F.floor(F.log2(F.col("size") + F.lit(0.5)))).otherwise(-1).cast("int")
    # numbers of each document, so that texts are read once more only, for the result
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    read = docs.select(F.col(text_col).alias("text"), F.col(source_col).cast("string").alias("source"), spot.alias("spot"), *(F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)))
    count = lambda df, *more: df.mapInArrow(word_counts(SPACED), ", ".join(["size long, source string, spot double", *more]))
    sized = cut(count(read.select("text", "source", "spot")))
    cells = cut(sized.groupBy("source", "size").agg((F.count("*") * F.col("size")).alias("tokens")))
    targets = cut(with_targets(cells.groupBy("source").agg(F.sum("tokens").alias("source_size")), weights, cap))
    multipliers, tilt = balanced(cells.where("size > 0"), targets, cap)
    plan = cut(targets.join(multipliers.withColumnRenamed("source", "source_m"), F.col("source").eqNullSafe(F.col("source_m")), "left").drop("source_m").fillna({"multiplier": 0.0, "full": False}))

    rate = tilt.rate(F.col("size"), F.col("multiplier"), F.col("full"), cap)
    whole, rest, slot = _parts(F.col("size"), rate, F.col("spot"))
    due = F.round(rest * F.col("size") * PARTS).cast("long")
    dealt = _beside(sized.where("size > 0"), plan).groupBy("source", level.alias("class"), slot.alias("slot")).agg(F.sum("size").alias("tokens"), F.sum(due).alias("due"))
    # 2 * SLOTS rows at most in each window, and as many numbers for each class of a source
    upto = F.sum("tokens").over(Window.partitionBy("source", "class").orderBy("slot")).cast("double")
    steps = dealt.withColumn("upto", upto).groupBy("source", "class").agg((F.sum("due") / F.lit(float(PARTS))).alias("due"), F.array_sort(F.collect_list(F.struct("upto", "slot"))).alias("steps"))
    classes = steps.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("class", "due", "steps")), asc=False).alias("classes"))
    taken = classes.select("source", F.explode(_taken_slots(F.col("classes"))).alias("t")).select(F.col("source").alias("source_t"), F.col("t.class").alias("class"), F.col("t.until").alias("until"))
    # every source has a row of class -1, for documents without words
    rows = plan.join(taken, F.col("source").eqNullSafe(F.col("source_t"))).drop("source_t").unionByName(plan.select("*", F.lit(-1).alias("class"), F.lit(0).alias("until")))
    rows = cut(rows.withColumnRenamed("class", "class_r"))

    out = count(read, *(f"_c{i} {kinds[c]}" for i, c in enumerate(carry)))
    out = _beside(out.withColumn("class", level), rows, F.col("class") == F.col("class_r"))
    copies = F.when(F.col("size") > 0, F.least(whole + (slot < F.col("until")).cast("int"), F.lit(int(cap)))).otherwise(0).cast("long")
    kept = [F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)]
    out = out.select(*kept, F.col("size").alias("_size"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), F.when(F.col("size") > 0, rate).otherwise(0.0).alias("_rate"), copies.alias("_copies"))
    return out.withColumn("_taken", F.col("_copies") * F.col("_size"))
