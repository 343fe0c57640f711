"""Quality rules: base counts of a text, and a hashed n-gram log-likelihood ratio.

Two multinomials over ``BUCKETS`` hashed n-grams (single tokens and pairs of neighbours)
are counted over whole tables: the raw corpus is every document, the trusted target is
the documents that labels call good. A bucket weighs

    w = floor(1000 * ln((target + SMOOTH) / (raw * target_total / raw_total + SMOOTH)))

(both sides smoothed by the same counts, so both are distributions with one sum). A
document's verdict is the mean weight of its n-grams against ``CUT``. Weights and sums
are integers and the comparison is ``sum >= CUT * n``, so every run, machine and engine
decides every document alike.

A token is a longest run of letters and digits (``0-9A-Za-z`` and everything past U+007F)
or of other signs; white space parts tokens. A text is read in slices cut at white
space, so a very long text costs little more memory than itself.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm.common import small, table

BUCKETS = 1 << 16
SMOOTH = 20
CUT = -200                    # thousandths of a nat a n-gram
MIN_WORDS = 50
REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
_SLICE = 1 << 20
_MEMO = 1 << 20               # distinct tokens a task remembers at a time
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0D]+")
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def slices(text: bytes, size: int = _SLICE):
    """Parts of ``text`` of about ``size`` bytes that end before white space."""
    lo = 0
    while len(text) - lo > size:
        cut = _SPACE.search(text, lo + size)
        if cut is None:
            break
        yield text[lo:cut.start()]
        lo = cut.start()
    yield text[lo:] if lo else text


def token_hash(token: bytes) -> int:
    """The first 32 bits of the token's MD5."""
    return int.from_bytes(hashlib.md5(token, usedforsecurity=False).digest()[:4], "big")


class TokenHashes(dict):
    """Hashes by token, forgotten when there are too many."""

    def __missing__(self, token: bytes) -> int:
        if len(self) >= _MEMO:
            self.clear()
        h = self[token] = token_hash(token)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    return ((x * np.uint64(2654435761)) & np.uint64(0xFFFFFFFF)) >> np.uint64(16)


def ngrams(text: bytes, hashes: TokenHashes):
    """Bucket numbers of all tokens and neighbouring pairs of ``text``, slice by slice."""
    before = None
    for part in slices(text):
        h = [hashes[t] for t in _TOKEN.findall(part)]
        if not h:
            continue
        one = np.array(h, dtype=np.uint64)
        chain = one if before is None else np.concatenate([before, one])
        pair = (chain[:-1] * np.uint64(1000003) + chain[1:]) & np.uint64(0xFFFFFFFF)
        before = one[-1:]
        yield _mixed(np.concatenate([one, pair])).astype(np.int64)


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """How many places of ``ids`` lie in a window of three that occurs twice or more."""
    if len(ids) < 4:
        return 0
    _, pair = np.unique(ids[:-1] * distinct + ids[1:], return_inverse=True)
    _, window, times = np.unique(pair[:-1] * distinct + ids[2:], return_inverse=True, return_counts=True)
    starts = times[window] > 1
    inside = np.zeros(len(ids), dtype=bool)
    for k in range(3):
        inside[k:k + len(starts)] |= starts
    return int(inside.sum())


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """(words, code points in words, symbols, repeated lines, words in repeated windows)."""
    number: dict[bytes, int] = {}
    parts, chars = [], 0
    for part in slices(text):
        words = _WORD.findall(part)
        parts.append(np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64))
        chars += sum(map(len, words))
    raw = np.frombuffer(text, dtype=np.uint8)
    inner = sum(int(np.count_nonzero((raw[i:i + _SLICE] & 0xC0) == 0x80)) for i in range(0, len(raw), _SLICE))
    ids = np.concatenate(parts)
    seen: set[bytes] = set()
    again = 0
    for line in text.split(b"\n"):
        if line in seen:
            again += 1
        elif _WORD.search(line):
            seen.add(line)
    return (len(ids), chars - inner, sum(text.count(s) for s in SYMBOLS), again,
            repeated_words(ids, max(len(number), 1)))


def _texts(column):
    for s in column.cast(pa.binary()):
        yield s.as_py() or b""


def bucket_counts(docs: DataFrame, trusted: str = "trusted", text: str = "text") -> DataFrame:
    """(bucket, raw, target): n-grams of all rows of ``docs`` and of those that are
    ``trusted``. A task sends one row a bucket it met, whatever it read."""
    def run(batches):
        total = np.zeros((2, BUCKETS), dtype=np.int64)
        held: list[list[np.ndarray]] = [[], []]                  # not yet counted: others, trusted
        hashes = TokenHashes()

        def count(k: int) -> None:
            n = np.bincount(np.concatenate(held[k]), minlength=BUCKETS)
            total[0] += n
            total[1] += n * k
            held[k] = []

        for b in batches:
            for t, good in zip(_texts(b.column(0)), b.column(1).to_pylist()):
                for at in ngrams(t, hashes):
                    held[good].append(at)
                    if sum(map(len, held[good])) > _SLICE or len(held[good]) > 256:
                        count(good)
        for k in (0, 1):
            if held[k]:
                count(k)
        met = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[0, met]), pa.array(total[1, met])],
                                         names=["bucket", "raw", "target"])

    rows = docs.select(F.col(f"`{text}`").cast("string"), F.coalesce(F.col(trusted), F.lit(False)))
    return (rows.mapInArrow(run, "bucket long, raw long, target long").groupBy("bucket")
            .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")))


def weights(counts: DataFrame, smooth: int = SMOOTH) -> np.ndarray:
    """Integer weight per bucket (all 0 without a trusted n-gram)."""
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts.collect():                                   # BUCKETS rows at most
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if target.sum() == 0:
        return np.zeros(BUCKETS, dtype=np.int64)
    expected = raw * target.sum() / raw.sum()
    return np.floor(1000 * np.log((target + smooth) / (expected + smooth))).astype(np.int64)


_OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, llr_sum long, n_grams long"


def judged(docs: DataFrame, trusted_ids: DataFrame, doc_id: str = "doc_id", text: str = "text",
           cut: int = CUT) -> DataFrame:
    """(doc_id, the base counts, llr_sum, n_grams, base_failed, kept) of every row of ``docs``.

    ``trusted_ids`` has the ids (``doc_id``, distinct) of the target's documents; it is broadcast if
    its measured size allows. Null texts have no words; a null id is never trusted;
    repeated rows are counted and judged each; without trusted documents only the base
    rules decide.
    """
    src = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    good = trusted_ids.select(F.col("doc_id").alias("__id"), F.lit(True).alias("trusted"))
    marked = src.join(small(good), F.col("doc_id") == F.col("__id"), "left").select("text", "trusted")
    w = docs.sparkSession.sparkContext.broadcast(weights(bucket_counts(marked)))

    def run(batches):
        weight, hashes = w.value, TokenHashes()
        for b in batches:
            rows = []
            for t in _texts(b.column(1)):
                total = n = 0
                for at in ngrams(t, hashes):
                    total, n = total + int(weight[at].sum()), n + len(at)
                rows.append((*base_counts(t), total, n))
            cols = np.array(rows, dtype=np.int64).reshape(-1, 7).T
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, cols)],
                                             names=["doc_id", *[c.split()[0] for c in _OUT.split(", ")]])

    out = src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, {_OUT}")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return (out.withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.col("llr_sum") >= cut * F.col("n_grams"))))


def op11_hashed_llr_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` by the base rules and the hashed n-gram ratio; the trusted target is the
    documents whose labels have a mean ``quality`` of a half or more.

    A null or empty text has no words and fails the base. Repeated rows come out as often
    as they came in; an empty table gives no rows; very long texts are read whole, in
    slices; further columns of ``documents`` and ``labels`` are not read.
    """
    labels = table(spark, sf_dir, "labels").filter("doc_id is not null and quality is not null")
    trusted = labels.groupBy("doc_id").agg(F.avg("quality").alias("q")).filter("q >= 0.5")
    return judged(table(spark, sf_dir, "documents"), trusted)


OP11_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
trusted AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING avg(quality) >= 0.5),
words AS (SELECT r, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS i FROM
          (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs) x),
windows AS (SELECT r, i, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM words
            WINDOW o AS (PARTITION BY r ORDER BY i)),
starts AS (SELECT r, i, w, w3 IS NOT NULL AND count(*) OVER (PARTITION BY r, w, w2, w3) > 1 AS s FROM windows),
inside AS (SELECT r, w, s OR coalesce(lag(s, 1) OVER o, false) OR coalesce(lag(s, 2) OVER o, false) AS again FROM starts
           WINDOW o AS (PARTITION BY r ORDER BY i)),
word_counts AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars,
                       count(*) FILTER (WHERE again) AS n_repeat_words FROM inside GROUP BY r),
lines AS (SELECT r, sum(n - 1) AS n_dup_lines FROM
          (SELECT r, line, count(*) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs) x
           WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r, line) y GROUP BY r),
tokens AS (SELECT r, unnest(t) AS t, unnest(range(1, len(t) + 1)) AS i FROM
           (SELECT r, regexp_extract_all(text, '[0-9A-Za-z\x{{80}}-\x{{10FFFF}}]+|[^0-9A-Za-z\x{{80}}-\x{{10FFFF}}\x20\x09-\x0D]+') AS t FROM docs) x),
hashed AS (SELECT r, h, lag(h) OVER (PARTITION BY r ORDER BY i) AS before FROM
           (SELECT r, i, CAST('0x' || left(md5(t), 8) AS BIGINT) AS h FROM tokens) x),
grams AS (SELECT r, CAST((CAST(x AS HUGEINT) * 2654435761) % 4294967296 AS BIGINT) >> 16 AS bucket FROM
          (SELECT r, h AS x FROM hashed UNION ALL
           SELECT r, (before * 1000003 + h) % 4294967296 FROM hashed WHERE before IS NOT NULL) y),
counted AS (SELECT bucket, count(*) AS raw, count(*) FILTER (WHERE docs.doc_id IN (SELECT doc_id FROM trusted)) AS target
            FROM grams JOIN docs USING (r) GROUP BY bucket),
weighed AS (SELECT bucket, CASE WHEN sum(target) OVER () = 0 THEN 0 ELSE
              CAST(floor(1000 * ln((target + {SMOOTH}.0::DOUBLE) / (raw::DOUBLE * (sum(target) OVER ())::DOUBLE
                   / (sum(raw) OVER ())::DOUBLE + {SMOOTH}))) AS BIGINT) END AS w FROM counted),
scored AS (SELECT r, sum(w) AS llr_sum, count(*) AS n_grams FROM grams JOIN weighed USING (bucket) GROUP BY r),
together AS (SELECT docs.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
       length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
       coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
       coalesce(llr_sum, 0)::BIGINT AS llr_sum, coalesce(n_grams, 0)::BIGINT AS n_grams
FROM docs LEFT JOIN word_counts USING (r) LEFT JOIN lines USING (r) LEFT JOIN scored USING (r))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words)
       AND llr_sum >= {CUT} * n_grams AS kept
FROM together
"""
