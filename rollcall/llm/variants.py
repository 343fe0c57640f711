"""Spelling variants of corpus words by one-edit neighbourhoods over a reduced alphabet.

Every letter is hashed to one of ``SYMBOLS`` symbols, so a word becomes a reduced word that
many words may share. If two words differ by one inserted, deleted or replaced letter,
so do their reduced words, or these are equal. The full one-edit neighbourhood of each
distinct reduced word (all deletions, replacements and insertions, and itself) is
therefore joined with the distinct reduced words, which is a far smaller join than the
one over all words and letters; the word pairs behind a reduced pair are checked on the
original strings. No pair is missed, and only checked pairs leave the join.

Words are counted over whole texts in tasks that send each word once a lot; pairs come
from hashed joins, in which no word or symbol gathers rows of the corpus.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm.common import materialize, table
from rollcall.llm.rules import slices

SYMBOLS = 6
MIN_LENGTH = 6
MIN_COUNT = 5
RATIO = 5                     # a form occurs at least so many times as often as its variant
DROP_EVERY = 199
_LOT = 1 << 18                # distinct words a task holds before it sends them
# A-Z and a-z, or a letter or sign of U+00C0..U+00FF, whose first UTF-8 byte is C3.
_RUN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\xbf])+")
LETTERS = [chr(c) for c in (*range(97, 123), *range(0xC0, 0x100))]


def altered(doc_id, run: bytes) -> str:
    """``run`` (lower-cased), or ``run`` without one letter where its hash with the id says so; the id of a
    null is empty text."""
    h = zlib.crc32(b"%s:%s" % (b"" if doc_id is None else str(doc_id).encode(), run))
    word = run.decode()
    if h % DROP_EVERY:
        return word
    k = h % len(word)
    return word[:k] + word[k + 1:]


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH,
                min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words of at least ``min_length`` letters with ``min_count`` occurrences."""
    def run(batches):
        held: Counter = Counter()

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())],
                                             names=["word", "n"])
            held.clear()
            return out

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                for part in slices(t.as_py() or b""):
                    for word, n in Counter(_RUN.findall(part.lower())).items():
                        w = altered(i, word)
                        if len(w) >= min_length:
                            held[w] += n
                    if len(held) >= _LOT:
                        yield rows()
        yield rows()

    src = docs.select(F.col(f"`{doc_id}`").cast("string"), F.col(f"`{text}`").cast("string").cast("binary"))
    return (src.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .filter(F.col("n") >= min_count))


def symbol(letter: str, symbols: int = SYMBOLS) -> str:
    return chr(97 + zlib.crc32(letter.encode()) % symbols)


def reduced(word: Column, symbols: int = SYMBOLS) -> Column:
    return F.translate(word, "".join(LETTERS), "".join(symbol(c, symbols) for c in LETTERS))


def neighbourhood(r: Column, symbols: int = SYMBOLS) -> Column:
    """All strings one edit from ``r`` over the symbols, and ``r``."""
    every = F.array(*[F.lit(chr(97 + k)) for k in range(symbols)])
    places = F.sequence(F.lit(1), F.length(r))
    head = lambda i: F.substring(r, F.lit(1), i - 1)
    tail = lambda i: F.substring(r, i, F.length(r))
    less = F.transform(places, lambda i: F.concat(head(i), tail(i + 1)))
    other = F.flatten(F.transform(places, lambda i: F.transform(every, lambda s: F.concat(head(i), s, tail(i + 1)))))
    more = F.flatten(F.transform(F.sequence(F.lit(1), F.length(r) + 1),
                                 lambda i: F.transform(every, lambda s: F.concat(head(i), s, tail(i)))))
    return F.array_distinct(F.concat(less, other, more))


def near_pairs(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(word, n, near, near_n): each ordered pair of ``words`` (distinct ``word``, ``n``) exactly one edit apart."""
    w = materialize(words.select("word", "n", reduced(F.col("word"), symbols).alias("r")), "variants-words")
    r = w.select("r").distinct()
    near = r.select(F.col("r").alias("ra"), F.explode(neighbourhood(F.col("r"), symbols)).alias("r"))
    both = near.join(r.hint("shuffle_hash"), "r").select("ra", F.col("r").alias("rb"))
    left = w.select(F.col("word"), F.col("n"), F.col("r").alias("ra"))
    right = w.select(F.col("word").alias("near"), F.col("n").alias("near_n"), F.col("r").alias("rb"))
    pairs = both.join(left, "ra").join(right, "rb")
    gap = F.abs(F.length("word") - F.length("near"))
    return (pairs.filter((gap <= 1) & (F.levenshtein("word", "near", 1) == 1))
            .select("word", "n", "near", "near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): the last word when forms are followed. A form is always more
    frequent than its word, so chains end; each round doubles how far a word looks."""
    at = materialize(forms.select("word", F.col("form").alias("root")), "variants-roots")
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if at.join(step, "root", "left_semi").isEmpty():
            return at
        at = materialize(at.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "variants-roots")


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", symbols: int = SYMBOLS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the corpus that is frequent enough.

    Null and empty texts have no words; repeated rows count each; an empty table gives no
    rows. Of near words of one frequency the smallest in code-point order is the form.
    """
    words = materialize(word_counts(docs, doc_id, text), "variants-counts")
    near = near_pairs(words, symbols).groupBy("word", "n").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near"))).alias("best"))
    near = materialize(near.select("word", "n_near", F.when(-F.col("best.m") >= RATIO * F.col("n"), F.col("best.near")).alias("form"),
                                   F.when(-F.col("best.m") >= RATIO * F.col("n"), -F.col("best.m")).alias("form_n")), "variants-near")
    last = roots(near.filter("form is not null"))
    return (words.join(near, "word", "left").join(last, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n",
                    F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n"))


def op13_reduced_alphabet_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frequent words of all ``documents`` with their forms and roots, as :func:`spelling_variants` has
    them. Whole texts of any length are read, in slices; further columns are not."""
    return spelling_variants(table(spark, sf_dir, "documents"))


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# CRC-32 from its polynomial: eight shifts make each of the 256 table entries, one look-up a byte.
_CRC = """(SELECT list(e ORDER BY k) AS tab FROM (SELECT k, list_reduce(list_prepend(k, range(8)),
           lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS e
           FROM (SELECT unnest(range(256)) AS k) x) y)"""
OP13_SQL = rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UP}', '{_LOW}'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run
    FROM documents) x GROUP BY doc_id, run),
bytes AS (SELECT doc_id, run, n, flatten(list_transform(range(1, length(k) + 1), lambda i:
            CASE WHEN ord(substr(k, i, 1)) < 128 THEN [ord(substr(k, i, 1))::BIGINT]
                 ELSE [195, ord(substr(k, i, 1))::BIGINT - 64] END)) AS b
          FROM (SELECT *, coalesce(doc_id::VARCHAR, '') || ':' || run AS k FROM runs) x),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, b),
             lambda c, o: xor(c >> 8, tab[(xor(c, o) & 255) + 1])), 4294967295) AS h
           FROM bytes, {_CRC} crc),
altered AS (SELECT n, CASE WHEN h % {DROP_EVERY} = 0
              THEN substr(run, 1, (h % length(run))) || substr(run, (h % length(run)) + 2) ELSE run END AS word FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n, length(word) AS l FROM altered WHERE length(word) >= {MIN_LENGTH}
          GROUP BY word HAVING sum(n) >= {MIN_COUNT}),
cut AS (SELECT word, n, l, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
        FROM (SELECT *, unnest(range(1, l + 1)) AS i FROM words) x),
near AS (SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n FROM cut a JOIN cut b
           ON a.rest = b.rest AND a.i = b.i AND a.l = b.l AND a.word <> b.word
         UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
         UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) OVER (PARTITION BY word) AS n_near,
                CASE WHEN near_n >= {RATIO} * n THEN near END AS form, CASE WHEN near_n >= {RATIO} * n THEN near_n END AS form_n
         FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) = 1),
chain(word, here, k) AS (SELECT word, form, 1 FROM best WHERE form IS NOT NULL
  UNION ALL SELECT chain.word, best.form, k + 1 FROM chain JOIN best ON chain.here = best.word WHERE best.form IS NOT NULL),
last AS (SELECT word, arg_max(here, k) AS root FROM chain GROUP BY word)
SELECT words.word, form, coalesce(root, words.word) AS root, n, coalesce(n_near, 0)::BIGINT AS n_near, form_n
FROM words LEFT JOIN best USING (word) LEFT JOIN last USING (word)
"""
