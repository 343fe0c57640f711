"""Document fingerprints by consistent weighted sampling (DataFrame functions only).

A text is the weighted set of its words, weight the count. For each sample ``i`` a word
of weight ``w`` draws, from hashes of the word and ``i`` alone, ``r`` and ``c`` from
Gamma(2, 1) and ``b`` from U(0, 1); then ``t = floor(ln w / r + b)`` and
``a = c exp(-r (t + 1 - b))``. The word of smallest ``a`` is the sample, and it is known by
that smallest value, which two texts share exactly when they drew the same word and
``t``. The chance of that is their generalised Jaccard similarity, so the share of equal
samples estimates it.

Neighbours in document order are brought together in buckets of consecutive rows, each
with a copy of the next bucket's first row. Where buckets begin is read off the sorted
keys (id and a hash of the text), so buckets are of one size however ids are spread,
null or repeated; only rows equal in id and text cannot be parted. One shuffle of the
texts serves the neighbour, the counts and all samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollcall.llm.common import materialize, small, table

SAMPLES = 48                  # a likeness J has a standard error of sqrt(J (1 - J) / SAMPLES): 0.06 at 0.8
BUCKET, MOST = 256, 16384     # least and most rows a bucket
_SPACES = r"[\x20\x09-\x0D]+"


def term_rows(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, term, tf) for the words of each text; one row with a null term for none.

    Each step is a column of its own: inside a lambda an expression is evaluated anew
    for every element, a column is not.
    """
    words = texts.select(*keys, F.sort_array(F.filter(F.split(text, _SPACES, -1), lambda x: x != "")).alias("words"))
    n = F.size("words")
    # The first place (from 0) of each run of equal words, and the end.
    runs = words.select(*keys, "words", F.concat(
        F.filter(F.slice(F.sequence(F.lit(0), n), F.lit(1), n),
                 lambda i: (i == 0) | (F.get("words", i) != F.get("words", i - 1))), F.array(n)).alias("at"))
    count = F.col("last") - F.col("first")
    ends = runs.select(*keys, "words", F.explode(F.arrays_zip(
        F.col("at").alias("first"), F.slice("at", F.lit(2), F.size("at")).alias("last"))).alias("r"))
    flat = ends.select(*keys, F.get("words", F.col("r.first")).alias("term"),
                       F.col("r.first").alias("first"), F.col("r.last").alias("last"))
    # The end entry has no run after it: it stands for a text without words, else it goes.
    return (flat.filter(F.col("last").isNotNull() | (F.col("first") == 0))
            .select(*keys, "term", count.cast("double").alias("tf")))


def sample_value(term: Column, weight: Column, i: int) -> Column:
    """``a`` of sample ``i`` for one weighted term.

    With ``r = e1 + e2`` and ``b = e1 / r`` for exponential ``e1 = -ln u1``, ``e2 = -ln u2``, ``r`` is
    Gamma(2, 1), ``b`` uniform and independent of it, and ``a = c u2 exp(-r t)``: a word that
    occurs once (t = 0) costs one hash and one logarithm.
    """
    h = F.xxhash64(term, F.lit(2 * i))
    bits = F.lit((1 << 20) - 1)
    u2 = (F.shiftrightunsigned(h, 40) + F.lit(0.5)) * F.lit(2.0 ** -24)
    c = -F.ln((F.shiftrightunsigned(h, 20).bitwiseAND(bits) + F.lit(0.5)) * (h.bitwiseAND(bits) + F.lit(0.5))
              * F.lit(2.0 ** -40))
    u1 = (F.shiftrightunsigned(F.xxhash64(term, F.lit(2 * i + 1)), 12) + F.lit(0.5)) * F.lit(2.0 ** -52)
    e1 = -F.ln(u1)
    r = e1 - F.ln(u2)
    t = F.floor((F.ln(weight) + e1) / r)
    return c * u2 * F.when(weight <= 1, F.lit(1.0)).otherwise(F.exp(-r * t))


def fingerprints(terms: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """``keys`` and ``fp`` (array of samples) from rows (keys, term, tf); a key whose only row
    has a null term gets nulls. Partitioned by any of ``keys``, this needs no shuffle."""
    values = [F.min(sample_value(F.col("term"), F.col("tf"), i)).alias(f"s{i}") for i in range(samples)]
    mins = terms.groupBy(*keys).agg(*values)
    return mins.select(*keys, F.array(*[f"s{i}" for i in range(samples)]).alias("fp"))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of equal samples; two empty texts are alike, an empty and another are not."""
    same = [F.get(a, F.lit(i)).eqNullSafe(F.get(b, F.lit(i))).cast("int") for i in range(samples)]
    total = same[0]
    for s in same[1:]:
        total = total + s
    return total / F.lit(float(samples))


def as_text(fp: Column, samples: int = SAMPLES) -> Column:
    """A fingerprint as hexadecimal digits, eight a sample."""
    return F.concat(*[F.lpad(F.hex(F.xxhash64(F.get(fp, F.lit(i))).bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")
                      for i in range(samples)])


def order_key(doc_id: Column, text: Column) -> Column:
    """32 characters that sort by descending id, null last, then by a hash of the text."""
    high = F.lpad(F.hex(doc_id.bitwiseXOR(F.lit((1 << 63) - 1))), 16, "0")
    return F.concat(F.coalesce(high, F.lit("Z" * 16)), F.lpad(F.hex(F.xxhash64(text)), 16, "0"))


def bounds(keys: DataFrame) -> tuple[DataFrame, list[tuple[int, str, int]]]:
    """Where buckets begin in the order of ``keys`` (a stored table of one column, key).

    The keys are sorted by range, and every so many of a range begin a bucket: the sorted
    beginnings of each range (range, begins), and for each range in order its number, its
    first key and the number of its buckets. The list has at most as many entries as
    there are shuffle partitions.
    """
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = min(max(keys.count() // (32 * parts), BUCKET), MOST)
    at = F.monotonically_increasing_id()         # the range, and from bit 33 down the place in it
    begins = (keys.repartitionByRange("key").sortWithinPartitions("key").select("key", at.alias("at"))
              .filter(F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) % rows == 0))
    ranges = materialize(begins.groupBy(F.shiftright("at", 33).alias("range")).agg(
        F.array_sort(F.collect_set("key")).alias("begins")), "cws-bounds")
    first = ranges.select("range", F.get("begins", F.lit(0)).alias("key"), F.size("begins").alias("n"))
    return ranges, sorted((r["range"], r["key"], r["n"]) for r in first.collect())


def searched(begins: Column, key: Column, size: int) -> Column:
    """Place of the last of the sorted ``begins`` (at most ``size``) that is not above ``key``."""
    steps = [1 << i for i in reversed(range(max(size, 2).bit_length()))]
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0),
                       lambda i, s: F.when(F.get(begins, i + s) <= key, i + s).otherwise(i))


def with_next(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(bucket, place, own, doc_id, text, next_text) in descending doc_id; rows that are not
    ``own`` are the copies that end a bucket. Null ids come last; rows of one id are
    ordered by a hash of their text."""
    src = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
                      F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    src = src.withColumn("key", order_key(F.col("doc_id"), F.col("text")))
    ranges, first = bounds(materialize(src.select("key"), "cws-keys"))
    numbers, keys, counts = zip(*first) if first else ((0,), ("",), (1,))
    # Buckets are numbered by range and place in it; the last of the range before each range,
    # and for the first range the last of all.
    last = [(n << 32) + c - 1 for n, c in zip(numbers, counts)]
    listed = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",")
    at = src.withColumn("of", searched(listed(keys), F.col("key"), len(keys)))
    at = (at.withColumn("range", F.get(listed(numbers).cast("array<long>"), F.col("of")))
          .withColumn("before", F.get(listed(last[-1:] + last[:-1]).cast("array<long>"), F.col("of")))
          .join(small(ranges), "range"))
    at = at.withColumn("i", searched(F.col("begins"), F.col("key"), max(counts)))
    bucket = F.shiftleft("range", 32) + F.col("i")
    copy = F.when(F.get("begins", F.col("i")) == F.col("key"), F.struct(
        F.when(F.col("i") > 0, bucket - 1).otherwise(F.col("before")).alias("bucket"), F.lit(False).alias("own")))
    places = F.array(F.struct(bucket.alias("bucket"), F.lit(True).alias("own")), copy)
    dealt = at.select("doc_id", "text", "key", F.explode(F.array_compact(places)).alias("p"))
    order = W.partitionBy("bucket").orderBy(F.col("own").desc(), "key")
    return dealt.select("p.bucket", "p.own", "doc_id", "text", "key").select(
        "bucket", F.row_number().over(order).alias("place"), "own", "doc_id", "text",
        F.lead("text").over(order).alias("next_text"))


def edited(text: Column, nxt: Column) -> Column:
    """The last half of the code points replaced by the first as many (or all) of ``nxt``."""
    n = F.length(text)
    k = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - k), F.substring(F.coalesce(nxt, F.lit("")), F.lit(1), k))


def fingerprint_neighbours(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """The result of ``op8``, one row per row of ``docs`` (doc_id, text).

    A null text is empty; its fingerprint is that of no words, like only to itself. Rows
    that repeat an id are neighbours of each other. A single row is its own next one. An
    empty table gives no rows. Very long texts are sampled whole: their words become rows.
    """
    rows = with_next(docs)
    rows = rows.withColumn("edited", edited(F.col("text"), F.col("next_text")))
    def variant(v: int, x: str) -> Column:
        return F.struct(F.lit(v).alias("v"), F.col(x).alias("x"))

    both = F.filter(F.array(variant(0, "text"), variant(1, "edited")), lambda b: (b.v == 0) | F.col("own"))
    keys = ["bucket", "place", "own", "doc_id", "n_chars", "edited_sha256"]
    texts = rows.select(
        "bucket", "place", "own", "doc_id", F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited"), 256).alias("edited_sha256"), F.explode(both).alias("b"))
    flat = texts.select(*keys, F.col("b.v").alias("v"), F.col("b.x").alias("x"))
    terms = term_rows(flat, [*keys, "v"], "x")
    fps = fingerprints(terms, [*keys, "v"], samples)
    wide = fps.groupBy(*keys).agg(F.max(F.when(F.col("v") == 0, F.col("fp"))).alias("fp"),
                                  F.max(F.when(F.col("v") == 1, F.col("fp"))).alias("efp"))
    nxt = F.lead("fp").over(W.partitionBy("bucket").orderBy("place"))
    wide = wide.withColumn("nfp", nxt).filter("own")
    return wide.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("fp"), samples).alias("fingerprint"),
        as_text(F.col("efp"), samples).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp"), samples).alias("near_edited"),
        likeness(F.col("fp"), F.col("nfp"), samples).alias("near_next"))


def op8_cws_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` and their edited texts fingerprinted; one row per document."""
    return fingerprint_neighbours(table(spark, sf_dir, "documents"))
