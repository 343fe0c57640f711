"""Mixing sources to target weights by Pareto order sampling.

A source of ``S`` words with a target of ``t`` words has the rate ``t / S``. Every
document first gets ``floor(rate)`` certain whole copies. The rest of the target is
filled by one more copy of some documents: document ``i`` has the inclusion
probability ``p_i = min(1, k * w_i)`` (``w_i``: by default ``log2(1 + size)``, so longer
documents are likelier, mildly; ``k`` per source makes the expected words equal the
rest), draws a uniform ``u_i`` hashed from its id and text, and ranks by
``(u_i / (1 - u_i)) / (p_i / (1 - p_i))``. The documents of lowest rank are taken until
their words are as near the rest as whole documents allow: the sample's size in words
is fixed.

No source is ever sorted in one task. ``k`` is solved on (source, size) counts, and
the cut is found by histograms: 256 ranges of the rank per source are summed and the
range that holds the cut is split again, ``LEVELS`` times, down to one rank. Rows of equal
rank (certain ones, rows repeated whole) follow a second number hashed from the row id,
and the ranges of that number are split alike; only what is left of the last is
ordered row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollcall.llm.common import RID, ROW, WORD, materialize, packed, reader_rows, small, table, uniform, unpacked, with_rid

SEED = 20240
MAX_COPIES = 3
WEIGHTS = (1, 2, 3)
BUCKETS = 256
LEVELS = 3
# Broadcast bound of a table of sources: a plan holds up to eight of them, each some three
# times in the driver while it is built.
SOURCE_BYTES = 16 * 1024 * 1024


def words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.0, weights=WEIGHTS,
                   max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, target) from one row per source.

    Sources in code point order, null last, take ``weights`` in turn and share
    ``share`` of all words; a target stops at ``max_copies`` times its source's size
    and the excess is shared again by weight among the others until none is above.
    With no words at all every target is 0. One row per source passes through one
    task for the order; only sums reach the driver.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    pos = (F.row_number().over(order) - 1) % len(weights) + 1
    src = materialize(sizes.select(
        "source", "source_size", (F.col("source_size") * max_copies).cast("double").alias("cap"),
        F.element_at(F.array(*[F.lit(float(w)) for w in weights]), pos).alias("w")), "mix-sources")
    total = share * float(src.agg(F.sum("source_size")).first()[0] or 0)
    rate, before = 0.0, -1.0
    while rate != before:                 # the capped set only grows, so this ends
        above = F.col("cap") < F.col("w") * F.lit(rate)
        row = src.agg(F.sum(F.when(above, F.col("cap")).otherwise(0.0)),
                      F.sum(F.when(above, 0.0).otherwise(F.col("w")))).first()
        before, rate = rate, ((total - row[0]) / row[1] if row[1] else rate)
    return src.select("source", "source_size",
                      F.least("cap", F.col("w") * F.lit(rate)).alias("target"))


def _join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Null-safe join on the source; the source table is broadcast when its size allows."""
    r = right.withColumnRenamed("source", "__source")
    return left.join(small(r, SOURCE_BYTES), left["source"].eqNullSafe(r["__source"]), how).drop("__source")


def _solve_scale(docs: DataFrame, src: DataFrame) -> DataFrame:
    """(source, k): the sum over a source's documents of size * min(1, k * w) is its rest.

    Certain documents only grow in number from round to round, so the loop ends.
    """
    hist = docs.groupBy("source", "size", "w").agg(F.count(F.lit(1)).alias("n"))
    hist = materialize(_join(hist, src.select("source", "rest")), "mix-hist")
    scale = materialize(src.select("source", F.lit(0.0).alias("k")), "mix-scale")
    while True:
        h = _join(hist, scale)
        sure, mass = F.col("k") * F.col("w") >= 1, F.col("size") * F.col("n")
        sums = h.groupBy("source").agg(
            F.first("k").alias("old"), F.first("rest").alias("rest"),
            F.sum(F.when(sure, mass).otherwise(F.lit(0))).alias("fixed"),
            F.sum(F.when(sure, F.lit(0.0)).otherwise(mass * F.col("w"))).alias("free"))
        k = F.when(F.col("free") > 0, (F.col("rest") - F.col("fixed")) / F.col("free"))
        sums = materialize(sums.select("source", F.greatest("old", F.coalesce(k, "old")).alias("k"), "old"),
                           "mix-scale")
        scale = sums.select("source", "k")
        if sums.filter(F.col("k") > F.col("old") * (1 + 1e-9)).isEmpty():
            return scale


def _passing(sums: DataFrame, key: str) -> DataFrame:
    """Of (source, key, words, rest, before) the key at which a source's words reach its rest,
    ``before`` being the words of all lower keys."""
    run = W.partitionBy("source").orderBy(key)      # at most BUCKETS rows a source, or the ranks of one range
    sums = sums.withColumn("upto", F.col("before") + F.sum("words").over(run))
    hit = sums.filter((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("words") < F.col("rest")))
    return hit.withColumn("before", F.col("upto") - F.col("words"))


def _narrow(rows: DataFrame, state: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Split [0, 1) by ``key`` LEVELS times, each time going on with the range in which a
    source's words reach its rest. ``rows`` (source, size, key, ...), ``state`` (source, rest,
    before, ...); returns the rows left and the state with ``lo``, the start of the range."""
    columns, held = rows.columns, [c for c in state.columns if c not in ("source", "rest", "before")]
    state, width, left = state.withColumn("lo", F.lit(0.0)), 1.0, rows
    for _ in range(LEVELS):
        width /= BUCKETS
        bucket = F.least(F.floor((F.col(key) - F.col("lo")) / F.lit(width)), F.lit(BUCKETS - 1))
        inside = _join(left, state.select("source", "rest", "before", "lo")).withColumn("bucket", bucket)
        sums = inside.groupBy("source", "bucket").agg(
            F.sum("size").alias("words"), F.first("rest").alias("rest"),
            F.first("lo").alias("lo"), F.first("before").alias("before"))
        hit = _passing(sums, "bucket").select(
            "source", "rest", "before", (F.col("lo") + F.col("bucket") * F.lit(width)).alias("lo"))
        state = materialize(_join(hit, state.select("source", *held)), "mix-cut")
        last = _join(left, state.select("source", "lo"))
        left = last.filter((F.col(key) >= F.col("lo")) & (F.col(key) < F.col("lo") + F.lit(width))).select(*columns)
    return left, state


def _tie(rid: str = RID) -> Column:
    """Order of rows of one rank."""
    return uniform(F.lit(SEED), F.col(rid))


def _cuts(ranked: DataFrame, src: DataFrame) -> DataFrame:
    """(source, cut_rank, cut_tie, cut_rid): the last document taken in the order of rank, tie
    and row id; absent if none is.

    ``ranked``: (rid, source, size, rank) with ranks in [0, 1), ``src``: (source, rest).
    """
    left, state = _narrow(ranked, src.select("source", "rest", F.lit(0).cast("long").alias("before")), "rank")
    sums = _join(left, state).groupBy("source", "rank").agg(
        F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("before").alias("before"))
    state = materialize(_passing(sums, "rank").select("source", "rest", "before", F.col("rank").alias("cut_rank")), "mix-cut")
    equal = _join(left, state.select("source", "cut_rank")).filter("rank = cut_rank")
    equal = materialize(equal.select(RID, "source", "size", _tie().alias("tie")), "mix-ties")
    left, state = _narrow(equal, state, "tie")
    order = W.partitionBy("source").orderBy("tie", RID)
    rows = _join(left, state).withColumn("upto", F.col("before") + F.sum("size").over(order))
    nearer = F.col("upto") - F.col("rest") <= F.col("rest") - (F.col("upto") - F.col("size"))
    taken = rows.filter((F.col("upto") <= F.col("rest")) | nearer)
    cut = taken.groupBy("source").agg(F.max(F.struct("tie", RID)).alias("cut"))
    # A source whose first left document is already too far stops at the range's lower end.
    out = _join(state.select("source", "cut_rank", "lo"), cut, "left")
    return materialize(out.select("source", "cut_rank", F.coalesce("cut.tie", "lo").alias("cut_tie"),
                                  F.coalesce(F.col(f"cut.{RID}"), F.lit(-1)).alias("cut_rid")), "mix-cuts")


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id",
        share: float = 1.0, weights=WEIGHTS, seed: int = SEED, weight: Column | None = None,
        carry: list[str] | None = None) -> DataFrame:
    """Decide how often each document of ``docs`` is taken.

    Returns one row per input row: the columns ``carry`` (default all) in the struct
    ``__row``, ``__rid``,
    ``source``, ``size``, ``source_size``, ``target``, ``copies`` (0 to 3).
    ``weight``: relative inclusion weight, positive where the size is (default
    ``log2(1 + size)``).

    Null and empty texts have size 0: they get the certain copies of their source and
    are never drawn for the rest. A null source is a source of its own, the last. Rows
    repeated whole have one rank and are told apart by a hash of the row id. An empty table gives no rows.
    """
    size = words(F.col(f"`{text}`"))
    u = uniform(F.lit(seed), F.col(f"`{doc_id}`"), F.xxhash64(F.col(f"`{text}`")))
    base = packed(docs, size.alias("size"), F.col(f"`{source}`").cast("string").alias("source"),
                  u.alias("u"), columns=carry)
    base = base.withColumn("w", F.log2(F.col("size") + 1.0) if weight is None else weight)
    with reader_rows(docs.sparkSession, 256):
        base = materialize(with_rid(base), "mix-docs")
    flat = base.select(RID, "source", "size", "w", "u")
    sizes = flat.groupBy("source").agg(F.sum("size").alias("source_size"))
    src = source_targets(sizes, share, weights)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    src = src.withColumn("whole", F.floor(rate).cast("long"))
    src = materialize(src.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")),
                      "mix-targets")
    open_src = src.filter(F.col("rest") > 0)
    scale = _solve_scale(flat.filter(F.col("size") > 0), open_src)
    # Null, not 0, for what is never drawn: a plan works out a value that occurs twice in a
    # condition ahead of the parts before it, and division by 0 is an error.
    p = F.when((F.col("size") > 0) & (F.col("k") * F.col("w") > 0), F.least(F.lit(1.0), F.col("k") * F.col("w")))
    odds = (F.col("u") / (1 - F.col("u"))) * (1 - p) / p
    scored = (_join(flat.filter(F.col("size") > 0), scale).filter(F.col("k") * F.col("w") > 0)
              .withColumn("rank", odds / (1 + odds)))
    ranked = materialize(scored.select(RID, "source", "size", "rank"), "mix-ranked")
    cuts = _cuts(ranked, open_src.select("source", "rest"))
    plan = src.join(cuts.withColumnRenamed("source", "__source"),
                    F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")
    plan = materialize(_join(plan, scale, "left"), "mix-plan")
    full = _join(base, plan)
    rank = odds / (1 + odds)
    drawn = ((F.col("size") > 0) & (F.col("k") * F.col("w") > 0)
             & ((rank < F.col("cut_rank")) | ((rank == F.col("cut_rank")) & (
                 (_tie() < F.col("cut_tie")) | ((_tie() == F.col("cut_tie")) & (F.col(RID) <= F.col("cut_rid")))))))
    copies = F.col("whole") + F.when(drawn, F.lit(1)).otherwise(F.lit(0))
    return full.select(ROW, RID, "source", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as :func:`mix` takes it, columns of ``docs``."""
    taken = mix(docs, **options).filter(F.col("copies") > 0)
    rows = taken.select(ROW, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return unpacked(rows, docs.columns)


def op2_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` mixed to weights 1, 2, 3; one row per document."""
    m = mix(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return m.select(F.col(f"{ROW}.doc_id").alias("doc_id"), "size", "source_size", "target",
                    (F.col("size") * F.col("copies")).alias("taken"))
