"""Mixing sources to target token weights by entropy balancing, in DataFrame operations only.

Each document gets a rate r = min(CAP, exp(lambda_s * size / mean size of its source s)): among all rates that meet the
source's token target, the one of least relative entropy to "take everything once" under the cap. The dual is convex in
lambda_s alone, so Newton steps run for all sources at once over a (source, size, count) histogram, which is what the
documents are aggregated to before any iteration; a bracket kept beside each lambda turns a bad step into a bisection.
Rates become whole copies by error carried along the documents of a source from long to short, in stripes that hold a
bounded share of a source each; what rounding leaves is then settled with single documents, the longest first.

Defined results: null text has size 0 and is taken 0 times; a null source is a source of its own, ordered last; equal
rows are told apart only by doc_id and text and round alike when those are equal; an empty table gives an empty mix.
A text of any length is counted inside the JVM; columns of documents that have the name of a result's are set aside or not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2
MAX_STEPS = 60
STEPS_A_CUT = 4
TOLERANCE = 1e-9
#: Documents of a source that one rounding task handles, on average.
STRIPE_ROWS = 50_000
#: Passes that settle what rounding left.
SETTLE_PASSES = 3
#: Sources up to which their one row each is broadcast (under 200 bytes a row); checked by a count, beyond it both sides shuffle.
FEW_SOURCES = 10_000

_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A key without nulls: joins on it keep the null source apart from every other."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Adds target to (sk, source_size, n_docs): by weight but at most cap * source_size, the excess reshared by weight.

    One row a source. sk orders by code point with "" (null) last. The level mu at which sum(min(cap * size, weight * mu))
    is share * total is found among the sources in the order in which they reach their caps, by prefix sums.
    """
    order = Window.orderBy(F.col("sk") == "", "sk")
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    base = sources.withColumn("weight", w).withColumn("most", F.col("source_size") * float(cap))
    filled = Window.orderBy(F.col("most") / F.col("weight"), "sk")
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("most").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing))
    budget = F.sum("source_size").over(everything) * float(share)
    at = base.withColumn("mu", (budget - before) / rest)
    # The first source that stays under its cap, at the level of those from it on, sets the level.
    at = at.withColumn("level", F.min(F.when(F.col("mu") * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), "sk", "mu"))).over(everything)["mu"])
    return at.select("sk", "source_size", "n_docs", F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least("most", F.col("weight") * F.col("level"))).alias("target"))


def _beside(rows: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """rows with the row of their source: no shuffle of rows, and so no hot source in one task, where sources are few."""
    return rows.join(F.broadcast(sources) if few else sources, "sk")


def _rate(lam: Column, x: Column, cap: float) -> Column:
    return F.least(F.lit(float(cap)), F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), lam * x))))


def _newton(hist: DataFrame, state: DataFrame, cap: float, few: bool) -> DataFrame:
    """One step for every source that is not done: one aggregation over the histogram, partial sums first."""
    lam, x = F.col("lam"), F.col("size") * F.col("scale")
    r = _rate(lam, x, cap)
    took = F.col("n") * F.col("size") * r
    sums = _beside(hist, state.where("not done"), few).groupBy("sk").agg(F.sum(took).alias("value"), F.sum(F.when(r < cap, took * x).otherwise(0.0)).alias("slope"))
    gap = F.col("value") - F.col("target")
    lo, hi = F.when(gap < 0, lam).otherwise(F.col("lo")), F.when(gap > 0, lam).otherwise(F.col("hi"))
    guess = lam - gap / F.when(F.col("slope") > 0, F.col("slope"))
    new = F.when((guess > lo) & (guess < hi), guess).otherwise((lo + hi) / 2)
    done = F.col("done") | gap.isNull() | (F.abs(gap) <= TOLERANCE * F.col("source_size")) | (hi - lo < 1e-13)
    return state.join(sums, "sk", "left").select("sk", "target", "source_size", "scale", F.when(done, lam).otherwise(new).alias("lam"), lo.alias("lo"), hi.alias("hi"), done.alias("done"))


def solve(hist: DataFrame, goals: DataFrame, cap: float = CAP, max_steps: int = MAX_STEPS, few: bool = False) -> DataFrame:
    """(sk, lam, scale, target, source_size). hist: (sk, size, n); goals: (sk, source_size, n_docs, target)."""
    full = F.col("target") >= cap * F.col("source_size")
    state = goals.select("sk", "target", "source_size", F.when(F.col("source_size") > 0, F.col("n_docs") / F.col("source_size")).otherwise(0.0).alias("scale"), F.when(full, 1e6).otherwise(0.0).alias("lam"), F.lit(-64.0).alias("lo"), F.lit(64.0).alias("hi"), full.alias("done"))
    for _ in range(0, max_steps, STEPS_A_CUT):
        for _ in range(STEPS_A_CUT):
            state = _newton(hist, state, cap, few)
        state = cut(state)
        if state.where("not done").isEmpty():
            break
    return state.select("sk", "lam", "scale", "target", "source_size")


def round_copies(rated: DataFrame, cap: int = CAP, passes: int = SETTLE_PASSES, few: bool = False) -> DataFrame:
    """Adds copies to (rid, doc_id, h, sk, size, n_docs, target, r): 0 to cap, near sum(size * r) by source."""
    stripe = F.pmod(F.xxhash64("doc_id", "h"), F.ceil(F.col("n_docs") / STRIPE_ROWS).cast("long"))
    along = Window.partitionBy("sk", "stripe").orderBy(F.desc("size"), "doc_id", "h", "rid")
    part = rated.withColumn("stripe", stripe).repartition("sk", "stripe").withColumn("whole", F.floor("r")).withColumn("sum", F.sum(F.col("r") - F.col("whole")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    up = F.floor(F.col("sum") + 0.5) - F.floor(F.coalesce(F.lag("sum").over(along), F.lit(0.0)) + 0.5)
    out = part.withColumn("copies", F.when(F.col("size") > 0, F.least(F.lit(cap), F.col("whole") + up)).otherwise(0).cast("long")).drop("stripe", "whole", "sum", "r")
    for _ in range(passes):
        out = cut(out)
        off = out.groupBy("sk").agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("off"))
        # One candidate a source and size class: its longest document that can give or take a copy.
        can = _beside(out, off, few).where((F.col("size") > 0) & F.when(F.col("off") > 0, F.col("copies") < cap).otherwise(F.col("copies") > 0) & (F.col("size") <= F.abs("off")))
        best = can.groupBy("sk", F.floor(F.log2("size")).alias("class")).agg(F.max(F.struct("size", "doc_id", "h", "rid")).alias("c"), F.max("off").alias("off"))
        offers = best.groupBy("sk").agg(F.max("off").alias("off"), F.sort_array(F.collect_list("c"), asc=False).alias("cs"))
        start = F.struct(F.abs("off").alias("left"), F.array().cast("array<bigint>").alias("ids"))
        pick = F.aggregate("cs", start, lambda a, c: F.when(c["size"] <= a["left"], F.struct((a["left"] - c["size"]).alias("left"), F.array_append(a["ids"], c["rid"]).alias("ids"))).otherwise(a))
        moves = offers.select(F.signum("off").cast("long").alias("move"), F.explode(pick["ids"]).alias("rid"))
        out = out.join(moves, "rid", "left").withColumn("copies", F.col("copies") + F.coalesce("move", F.lit(0))).drop("move")
    return out


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(rid, doc_id, source, size, source_size, target, copies): rid is unique in the result, one row a row of docs."""
    sized = docs.select("doc_id", "source", F.xxhash64("text").alias("h"), word_count(F.col("text")).alias("size"))
    sized = cut(sized.withColumn("rid", F.monotonically_increasing_id()).withColumn("sk", source_key(F.col("source"))))
    hist = cut(sized.groupBy("sk", "size").agg(F.count("*").alias("n")))
    sources = hist.groupBy("sk").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("n_docs"))
    goals = cut(targets(sources, weights, share, cap))
    few = goals.count() <= FEW_SOURCES
    lam = solve(hist.where("size > 0"), goals, cap, few=few).drop("source_size", "target").join(goals, "sk")
    rated = _beside(sized, lam, few).withColumn("r", F.when(F.col("target") >= cap * F.col("source_size"), F.lit(float(cap))).otherwise(_rate(F.col("lam"), F.col("size") * F.col("scale"), cap)))
    return round_copies(rated.drop("lam", "scale"), cap, few=few)


def op5(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with a column copy (from 1; it replaces one of that name)."""
    keys = ["__mix_h", "__mix_sk", "__mix_nth"]
    own = Window.partitionBy("h", "sk").orderBy("doc_id", "rid")
    plan = mix(docs, weights, share, cap).select(F.col("h").alias(keys[0]), F.col("sk").alias(keys[1]), F.row_number().over(own).alias(keys[2]), F.col("copies").alias("__mix_copies"))
    # Rows of one text and source meet the plan in the order of doc_id; rows alike in all three are interchangeable.
    keyed = docs.withColumn(keys[0], F.xxhash64("text")).withColumn(keys[1], source_key(F.col("source"))).withColumn(keys[2], F.row_number().over(Window.partitionBy(*keys[:2]).orderBy("doc_id")))
    both = keyed.join(plan, keys).where("__mix_copies > 0")
    return both.select(*(c for c in docs.columns if c != "copy"), F.explode(F.sequence(F.lit(1), F.col("__mix_copies").cast("int"))).alias("copy"))
