"""Language identification with error-correcting output codes.

Each learned language has a codeword. For each bit of the code one binary classifier over
hashed byte n-grams says whether the text's language has that bit set: a linear function
of the n-gram frequencies whose weights are the log odds of the n-grams between the
languages with the bit and those without, from counts over all training texts. Decoding
is loss-weighted: a language's loss is the sum over bits of the reliability of the bit
times the logistic loss of the classifier's margin against the codeword. The language of
least loss wins; where the second is near, the text is flagged ambiguous.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.llm.common import arrow_rows, crc_mod, table

DIM_BITS = 13                 # hashed n-grams: 2**13 counts a language
ORDERS = (2, 3, 4)
SMOOTH = 0.5
SCALE = 200.0                 # n-grams that a text's mean margin is scaled to, at most
NEAR = 0.35                   # flagged when the winner's share is below 1 - NEAR
UNKNOWN = "und"
_PIECE = 1 << 20              # bytes of a long text counted at once

RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                       T.StructField("ambiguous", T.BooleanType())])


def has_letter(s: str) -> bool:
    return not s.isascii() and any(c.isalpha() for c in s) or s.isascii() and s.upper() != s.lower()


def profile(s: str) -> np.ndarray:
    """Counts of hashed n-grams of the lower-cased UTF-8 bytes; long texts piece by piece."""
    data = np.frombuffer((" " + s.lower() + " ").encode("utf-8", "replace"), dtype=np.uint8)
    out = np.zeros(1 << DIM_BITS)
    over = max(ORDERS) - 1
    for at in range(0, len(data), _PIECE):
        b = data[max(0, at - over):at + _PIECE].astype(np.uint32)
        skip = at - max(0, at - over)
        code = b.copy()
        for n in range(2, max(ORDERS) + 1):
            code = (code[:-1] << np.uint32(8)) ^ (code[:-1] >> np.uint32(24)) ^ b[n - 1:]
            if n in ORDERS:
                h = (code[max(0, skip - n + 1):] + np.uint32(n)) * np.uint32(0x9E3779B1) >> np.uint32(32 - DIM_BITS)
                out += np.bincount(h, minlength=1 << DIM_BITS)
    return out


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """(k, bits) of +1 / -1. Up to 7 classes: all splits of them; more: the random code of
    the largest least distance among 200 with about 10 log2(k) bits."""
    if k <= 7:
        cols = [[1 if i == 0 or (s >> (i - 1)) & 1 else -1 for i in range(k)] for s in range((1 << max(k - 1, 0)) - 1)]
        return np.array(cols or [[1] * k]).T
    rng, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(k)))
    best, gap = None, -1
    for _ in range(200):
        m = rng.choice([-1, 1], (k, bits))
        m = m[:, np.abs(m.sum(axis=0)) < k]
        d = (m.shape[1] - m @ m.T) / 2
        np.fill_diagonal(d, np.inf)
        if d.min() > gap:
            best, gap = m, d.min()
    return best


def language_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, n): n-gram counts per language, each text's summing to 1 at most."""
    def run(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for t, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                p = profile(t)
                if label not in total:
                    total[label] = np.zeros(1 << DIM_BITS)
                total[label] += p / max(p.sum(), 1.0)
        for label, p in total.items():
            at = np.flatnonzero(p)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(at), pa.string()), pa.array(at), pa.array(p[at])],
                                             names=["lang", "gram", "n"])

    arrow_rows(docs.sparkSession, 256)
    src = docs.select(F.col(f"`{text}`").cast("string").alias("t"), F.col(f"`{lang}`").cast("string").alias("l"))
    part = src.filter("t is not null and l is not null").mapInArrow(run, "lang string, gram long, n double")
    return part.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict:
    """The model from all rows with a text and a lang. What reaches the driver is
    2**DIM_BITS counts per language. Without such rows it knows no language."""
    rows = language_counts(docs, text, lang).collect()
    langs = sorted({r["lang"] for r in rows})
    counts = np.zeros((len(langs), 1 << DIM_BITS))
    at = {name: i for i, name in enumerate(langs)}
    for r in rows:
        counts[at[r["lang"]], r["gram"]] = r["n"]
    if not langs:
        return {"langs": [], "code": np.zeros((0, 1)), "w": np.zeros((1 << DIM_BITS, 1)), "rel": np.ones(1)}
    freq = counts / counts.sum(axis=1, keepdims=True)
    freq = (freq + SMOOTH / (1 << DIM_BITS)) / (1 + SMOOTH)
    code = codewords(len(langs))
    w = np.zeros((1 << DIM_BITS, code.shape[1]))
    for j in range(code.shape[1]):
        if (code[:, j] > 0).all():
            continue
        w[:, j] = np.log(freq[code[:, j] > 0].mean(axis=0)) - np.log(freq[code[:, j] < 0].mean(axis=0))
    # A bit is as reliable as its mean margin on the languages' own profiles is large.
    rel = np.abs((freq @ w) * code).mean(axis=0)
    return {"langs": langs, "code": code, "w": w, "rel": rel / max(rel.sum(), 1e-12), "fit": np.log(freq * (1 << DIM_BITS))}


def decode(model: dict, p: np.ndarray) -> tuple[str, float, bool]:
    """(language, share of the winner among all by loss, ambiguous) for one profile."""
    n = p.sum()
    margin = (p @ model["w"]) / max(n, 1.0) * min(n, SCALE)
    loss = (model["rel"] * np.logaddexp(0.0, -margin * model["code"])).sum(axis=1)
    e = np.exp(loss.min() - loss)
    i = int(loss.argmin())
    share = float(e[i] / e.sum())
    return model["langs"][i], share, share < 1 - NEAR


def predictor(spark: SparkSession, model: dict):
    """A column function: struct(lang_pred, score, ambiguous) of a text."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(RESULT)
    def predict(texts):
        import pandas as pd
        m = shared.value
        out = []
        for t in texts:
            if t is None or not m["langs"] or not has_letter(t):
                out.append((UNKNOWN, 0.0, True))
            else:
                out.append(decode(m, profile(t)))
        return pd.DataFrame(out, columns=["lang_pred", "score", "ambiguous"])

    arrow_rows(spark, 256)
    return lambda text: predict(F.col(f"`{text}`").cast("string"))


def fits(model: dict, text: str) -> bool:
    """Whether the text's n-grams are likelier in the language that decoding gives than in a text
    whose n-grams are spread evenly. Scripts and languages that were not learned fall below that;
    text of a learned language lies far above, names and numbers in it included."""
    p = profile(text)
    lang = model["langs"].index(decode(model, p)[0])
    return float(model["fit"][lang] @ p) >= 0.0


def told(spark: SparkSession, model: dict):
    """A column function: does a text have a letter, and fit the language that the model says it is in."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def tell(texts):
        import pandas as pd
        m = shared.value
        return pd.Series([t is not None and has_letter(t) and fits(m, t) for t in texts], dtype="bool")

    arrow_rows(spark, 256)
    return lambda text: tell(F.col(f"`{text}`").cast("string"))


def op4_ecoc_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text of ``documents``, learned from those whose remainder is not 1.

    A null text or one without a letter is ``und`` with score 0, as is any text when no
    row can be learned from. A null lang or doc_id is not learned from. Repeated rows are
    predicted alike. An empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    rest = crc_mod(F.col("doc_id"), 3)
    model = fit(docs.filter(rest != 1))
    said = predictor(spark, model)("text")
    return docs.select("doc_id", F.coalesce(rest == 1, F.lit(False)).alias("held_out"), said.alias("p")).select(
        "doc_id", "held_out", "p.lang_pred", "p.score", "p.ambiguous")
