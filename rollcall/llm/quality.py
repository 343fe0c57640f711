"""Quality scores by a regularised quadratic discriminant over document statistics.

A text becomes ``FEATURES`` numbers (logs of lengths and of shares, so that each class is
nearer a normal cloud). Class means and covariances come from sums over all labelled
training rows, so what reaches the driver is a few hundred numbers. Each covariance is
shrunk towards the pooled one and then towards its diagonal; the inverse of its Cholesky
factor is computed once and kept, and a row's log density is a product with it. The
difference of the two log densities is turned into a probability by a logistic curve
fitted to counts of the training rows by difference.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm.common import arrow_rows, crc_mod, materialize, table

POOL = 0.1                    # weight of the pooled covariance
DIAGONAL = 0.05               # weight of the diagonal
THRESHOLD = 0.3
FEATURES = ("words", "word_chars", "upper", "digits", "marks", "symbols", "symbol_ends", "no_letter_words",
            "upper_words", "distinct_words", "repeated_lines", "line_words", "spaces", "wide_bytes")
_BINS = 400
_SMALL = 1e-3

# Byte classes: 0 small letter or part of a wide character, 1 capital, 2 digit, 3 mark of
# ordinary prose, 4 other symbol, 5 space.
_CLASS = np.zeros(256, dtype=np.uint8)
for _b in range(128):
    _c = chr(_b)
    _CLASS[_b] = (1 if _c.isupper() else 0 if _c.islower() else 2 if _c.isdigit() else
                  5 if _c in "\t\n\x0b\x0c\r " else 3 if _c in ".,;:'\"?!()-" else 4)


def statistics(s: str | None, classes: np.ndarray = _CLASS) -> np.ndarray:
    """The transformed statistics of one text; those of an empty text are all defined."""
    raw = np.frombuffer((s or "").encode("utf-8", "replace"), dtype=np.uint8)
    c = classes[raw]
    n = max(len(raw), 1)
    count = np.bincount(c, minlength=6)
    space = c == 5
    start = np.flatnonzero(~space & np.concatenate([[True], space[:-1]])) if len(c) else np.zeros(0, int)
    end = np.flatnonzero(~space & np.concatenate([space[1:], [True]])) if len(c) else np.zeros(0, int)
    words = max(len(start), 1)
    if len(start):
        letters = np.concatenate([[0], np.cumsum(c <= 1)])
        small = np.concatenate([[0], np.cumsum(c == 0)])
        has = letters[end + 1] - letters[start]
        low = small[end + 1] - small[start]
        bare, upper = (has == 0).sum(), ((has > 1) & (low == 0)).sum()
        symbol_ends = (c[end] == 4).sum() + ((c[end] == 3) & (raw[np.maximum(end - 1, 0)] == raw[end]) & (end > start)).sum()
    else:
        bare = upper = symbol_ends = 0
    lines = [x for x in (s or "").split("\n") if x]
    distinct = len(set((s or "").split()))
    share = lambda x, of: np.log(_SMALL + x / of)
    return np.array([
        np.log1p(len(start)), np.log1p((n - count[5]) / words), share(count[1], n), share(count[2], n),
        share(count[3], n), share(count[4], n), share(symbol_ends, words), share(bare, words), share(upper, words),
        share(distinct, words), share(len(lines) - len(set(lines)), max(len(lines), 1)),
        np.log1p(words / max(len(lines), 1)), share(count[5], n), share((raw > 127).sum(), n)])


def feature_table(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, f) of every row, f the statistics of the whole text."""
    def run(batches):
        for b in batches:
            f = [statistics(t) for t in b.column(1).to_pylist()]
            flat = np.concatenate(f) if f else np.zeros(0)
            at = np.arange(0, len(flat) + 1, len(FEATURES), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))],
                                             names=["doc_id", "f"])

    arrow_rows(docs.sparkSession, 256)
    kind = docs.schema[doc_id].dataType.simpleString()
    src = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return src.mapInArrow(run, f"doc_id {kind}, f array<double>")


def class_sums(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """{class: (rows, sum of f, sum of f f')} over (f, y), added up in Spark."""
    d = len(FEATURES)

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            x = np.array(b.column(0).flatten()).reshape(-1, d)
            x1 = np.hstack([np.ones((len(x), 1)), x])
            y = b.column(1).to_numpy(zero_copy_only=False)
            for k in np.unique(y):
                total[int(k)] = total.get(int(k), 0) + x1[y == k].T @ x1[y == k]
        for k, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * m.size), pa.array(np.arange(m.size)), pa.array(m.ravel())],
                                             names=["k", "cell", "v"])

    sums = rows.select("f", "y").mapInArrow(run, "k long, cell long, v double").groupBy("k", "cell").agg(F.sum("v").alias("v"))
    out: dict[int, np.ndarray] = {}
    for r in sums.collect():                                     # (d + 1)^2 numbers a class
        out.setdefault(r["k"], np.zeros((d + 1) ** 2))[r["cell"]] = r["v"]
    return {k: (m.reshape(d + 1, d + 1)[0, 0], m.reshape(d + 1, d + 1)[0, 1:], m.reshape(d + 1, d + 1)[1:, 1:])
            for k, m in out.items()}


def discriminant(sums: dict, pool: float = POOL, diagonal: float = DIAGONAL) -> dict | None:
    """Mean, inverse Cholesky factor and constant per class; None unless both classes have rows."""
    if set(sums) != {0, 1}:
        return None
    n = sum(s[0] for s in sums.values())
    mean = sum(s[1] for s in sums.values()) / n
    scale = np.sqrt(np.maximum(np.diag(sum(s[2] for s in sums.values())) / n - mean ** 2, 1e-12))
    cov, mu = {}, {}
    for k, (m, s1, s2) in sums.items():
        mu[k] = (s1 / m - mean) / scale
        c = (s2 / m - np.outer(s1 / m, s1 / m)) / np.outer(scale, scale)
        cov[k] = (c + c.T) / 2
    pooled = sum(sums[k][0] * cov[k] for k in cov) / n
    out = {"mean": mean, "scale": scale}
    for k in (0, 1):
        c = (1 - pool) * cov[k] + pool * pooled
        c = (1 - diagonal) * c + diagonal * np.diag(np.diag(c) + 0.01)
        low = np.linalg.cholesky(c + 1e-6 * np.eye(len(c)))
        out[k] = (mu[k], np.linalg.inv(low), float(np.log(sums[k][0] / n) - np.log(np.diag(low)).sum()))
    return out


def difference(model: dict, x: np.ndarray) -> np.ndarray:
    """Log density of class 1 less that of class 0 for rows of statistics, damped at the ends."""
    z = (x - model["mean"]) / model["scale"]
    side = []
    for k in (0, 1):
        mu, inv, const = model[k]
        side.append(const - 0.5 * (((z - mu) @ inv.T) ** 2).sum(axis=1))
    return np.arcsinh((side[1] - side[0]) / 2.0)


def calibrate(rows: DataFrame, model: dict) -> tuple[float, float]:
    """Slope and offset of the logistic curve, from counts of (class, range of difference)."""
    d = len(FEATURES)

    def run(batches):
        total = np.zeros((2, _BINS))
        for b in batches:
            x = np.array(b.column(0).flatten()).reshape(-1, d)
            at = np.clip((difference(model, x) + 20) / 40 * _BINS, 0, _BINS - 1).astype(int)
            np.add.at(total, (b.column(1).to_numpy(zero_copy_only=False).astype(int), at), 1)
        k, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(at), pa.array(total[k, at])], names=["k", "bin", "n"])

    got = rows.select("f", "y").mapInArrow(run, "k long, bin long, n double").groupBy("k", "bin").agg(F.sum("n").alias("n"))
    rows_ = np.array([(r["k"], (r["bin"] + 0.5) / _BINS * 40 - 20, r["n"]) for r in got.collect()])   # 2 * _BINS at most
    y, x, w = rows_.T
    a, b = 1.0, 0.0
    for _ in range(50):                                          # Newton steps, slightly ridged
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        g = np.array([(w * (y - p) * x).sum() - 1e-2 * a, (w * (y - p)).sum()])
        v = w * p * (1 - p) + 1e-9
        h = np.array([[(v * x * x).sum() + 1e-2, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a + np.clip(step[0], -1, 1), b + np.clip(step[1], -1, 1)
    return float(max(a, 1e-3)), float(b)


def score(features: DataFrame, labelled: DataFrame) -> DataFrame:
    """``features`` with ``score``: the model is fitted to ``labelled`` (f, y in 0, 1).

    With no row of one class the score is the share of class 1, 0.5 with no rows at all.
    """
    arrow_rows(features.sparkSession, 8192)
    labelled = materialize(labelled.select("f", F.col("y").cast("int").alias("y")), "quality-train")
    sums = class_sums(labelled)
    model = discriminant(sums)
    if model is None:
        n = {k: s[0] for k, s in sums.items()}
        return features.withColumn("score", F.lit(float(n.get(1, 0) / sum(n.values()) if n else 0.5)))
    a, b = calibrate(labelled, model)
    shared = features.sparkSession.sparkContext.broadcast(model)
    d = len(FEATURES)

    @F.pandas_udf("double")
    def prob(f):
        import pandas as pd
        x = np.stack(f.to_numpy()) if len(f) else np.zeros((0, d))
        return pd.Series(1 / (1 + np.exp(-np.clip(a * difference(shared.value, x) + b, -40, 40))))

    return features.withColumn("score", prob("f"))


def op5_qda_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` scored for quality; labels are learned from rows whose
    remainder is not 0.

    Null and empty texts have the statistics of no words and get a score. Labels that
    repeat for a document count by their mean, null labels not at all; a null doc_id is
    scored and not learned from. Repeated rows are scored alike; an empty table gives
    no rows.
    """
    f = materialize(feature_table(table(spark, sf_dir, "documents")), "quality-features")
    labels = (table(spark, sf_dir, "labels").filter("quality is not null").groupBy("doc_id")
              .agg((F.avg("quality") >= 0.5).cast("int").alias("y")))
    rest = crc_mod(F.col("doc_id"), 5)
    s = score(f, f.filter(rest != 0).join(labels, "doc_id"))
    return s.select("doc_id", F.coalesce(rest == 0, F.lit(False)).alias("held_out"), "score",
                    (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
