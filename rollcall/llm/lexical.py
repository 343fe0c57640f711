"""Ranked lexical search with frequent-pattern trees over documents.

A document is restricted to the terms that some item asks for and written as a vector
(term, tf) with the terms of most documents first. A task takes its vectors in lots, sorts
them as paths and cuts the sorted paths into a trie: documents with the same leading
terms share a node, and a node of at most ``LEAF`` documents is a leaf. Each node holds
the largest tf of every term below it and the smallest length norm m. With both,
the score of an item is bounded for all documents below a node, because a term's part
grows with tf and falls with m. An item walks the trie depth first, best bound first,
and leaves out a node whose bound lies under the worst of its ten best so far.

The walk starts from a floor: the tenth best score among a hashed sixteenth of the
documents, which cannot be above the tenth best among all. Items come in blocks of
``ITEM_BLOCK``; each task sends ten rows an item at most, so nothing here grows with the
product of items and documents but the walks themselves.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollcall.llm.common import materialize, table
from rollcall.llm.rules import slices

TOP = 10
LEAF = 16
ITEM_BLOCK = 1024             # items searched in one pass over the documents
CELLS = 1 << 22               # documents of one trie times terms
SAMPLE = 16                   # one in so many documents gives the floor
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")


def term_counts(text: bytes) -> Counter:
    """Occurrences of each term of ``text`` (UTF-8), A-Z lower-cased."""
    out: Counter = Counter()
    for part in slices(text):
        out.update(_TERM.findall(part.lower()))           # bytes.lower() changes A-Z alone
    return out


def vectors(docs: DataFrame, vocabulary: dict[bytes, int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, ids, tfs) of every row: its number of terms, and the numbers and counts of those in
    ``vocabulary``. A null text has no terms."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        number = known.value
        for b in batches:
            n, ids, tfs = [], [], []
            for t in b.column(1):
                c = term_counts(t.as_py() or b"")
                hit = sorted((number[x], c[x]) for x in number.keys() & c.keys())
                n.append(c.total())
                ids.append([i for i, _ in hit])
                tfs.append([f for _, f in hit])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.int32())),
                 pa.array(tfs, pa.list_(pa.int32()))], names=["doc_id", "n", "ids", "tfs"])

    src = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").cast("binary"))
    return src.mapInArrow(run, "doc_id long, n long, ids array<int>, tfs array<int>")


def parts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A term's part of a score before its weight, for rows of tf and one m a row."""
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m[:, None])


class Trie:
    """The paths of some documents, with tf maxima and m minima at each node.

    ``ids``: each document's terms as ranks by document frequency, ascending; ``tfs``: their counts.
    """

    def __init__(self, ids: list[np.ndarray], tfs: list[np.ndarray], m: list[int], terms: int, leaf: int = LEAF):
        order = sorted(range(len(ids)), key=lambda k: ids[k].astype(">u4").tobytes())
        self.order = order
        self.m = np.array([m[k] for k in order], dtype=np.int64)
        path = np.full((len(order), max((len(x) for x in ids), default=0) + 1), -1, dtype=np.int64)
        self.tf = np.zeros((len(order), terms), dtype=np.int32)
        for row, k in enumerate(order):
            path[row, :len(ids[k])] = ids[k]
            self.tf[row, ids[k]] = tfs[k]
        self.span, self.below = [(0, len(order))], [[]]
        todo = [0]
        while todo:
            node = todo.pop()
            lo, hi = self.span[node]
            differ = np.flatnonzero(path[lo] != path[hi - 1]) if hi - lo > leaf else ()
            if not len(differ):                           # small, or one path for all
                continue
            step = path[lo:hi, differ[0]]                 # sorted, so the ends share what all share
            cuts = [lo, *(np.flatnonzero(step[1:] != step[:-1]) + lo + 1).tolist(), hi]
            start = lo
            for cut, after in zip(cuts[1:], [*cuts[2:], None]):
                # Neighbours that fit one leaf together become one.
                if after is not None and after - start <= leaf:
                    continue
                self.below[node].append(len(self.span))
                todo.append(len(self.span))
                self.span.append((start, cut))
                self.below.append([])
                start = cut
        self.most = np.zeros((len(self.span), terms), dtype=np.int32)
        self.least = np.zeros(len(self.span), dtype=np.int64)
        for node in range(len(self.span) - 1, -1, -1):    # a child comes after its parent
            (lo, hi), kids = self.span[node], self.below[node]
            self.most[node] = self.most[kids].max(axis=0) if kids else self.tf[lo:hi].max(axis=0)
            self.least[node] = self.least[kids].min() if kids else self.m[lo:hi].min()

    def walk(self, terms: np.ndarray, weight: np.ndarray, floor):
        """Depth first through the nodes whose bound reaches ``floor()``, asked anew each time:
        yields (score, position) of documents that reach it."""
        bounds = lambda nodes: parts(self.most[nodes][:, terms], self.least[nodes]) @ weight
        todo = [(int(bounds([0])[0]), 0)]
        while todo:
            bound, node = todo.pop()
            if bound < floor():
                continue
            kids = self.below[node]
            if kids:
                todo.extend(sorted(zip(bounds(kids).tolist(), kids)))      # the best is taken next
                continue
            lo, hi = self.span[node]
            score = parts(self.tf[lo:hi][:, terms], self.m[lo:hi]) @ weight
            for at in np.flatnonzero(score >= floor()).tolist():
                yield int(score[at]), self.order[lo + at]


def search(vecs: DataFrame, model: dict) -> DataFrame:
    """(item, score, doc_id): at least the best ``TOP`` of each item among the rows of ``vecs`` with a score
    of 1 and of the item's floor or more; at most ``TOP`` an item and task."""
    shared = vecs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        rank, items, floors, n_docs, n_terms = (shared.value[k] for k in ("rank", "items", "floors", "docs", "terms"))
        lot = max(64, CELLS // max(len(rank), 1))
        best: list[list] = [[] for _ in items]
        held: list[tuple] = []

        def flush() -> None:
            trie = Trie([h[1] for h in held], [h[2] for h in held], [h[3] for h in held], len(rank))
            for k, (terms, weight) in enumerate(items):
                heap, low = best[k], max(floors[k], 1)
                floor = lambda: heap[0][0] if len(heap) == TOP else low  # noqa: B023, E731
                for score, at in trie.walk(terms, weight, floor):
                    doc = held[at][0]
                    entry = (score, doc is not None, -(doc or 0))        # a null id ranks last
                    if len(heap) < TOP:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
            held.clear()

        for b in batches:
            ids, tfs = b.column(2), b.column(3)
            for k, (doc, n) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                if not len(ids[k].values):
                    continue
                r = rank[ids[k].values.to_numpy()]
                by = np.argsort(r)
                held.append((doc, r[by], tfs[k].values.to_numpy()[by], 25 + (75 * n * n_docs) // n_terms))
                if len(held) >= lot:
                    flush()
        if held:
            flush()
        out = [(k, e[0], -e[2] if e[1] else None) for k, heap in enumerate(best) for e in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(3)],
                                         names=["item", "score", "doc_id"])

    return vecs.select("doc_id", "n", "ids", "tfs").mapInArrow(run, "item long, score long, doc_id long")


def ranked(found: DataFrame) -> DataFrame:
    by = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= TOP)


def block_search(docs: DataFrame, queries: list[Counter], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(item, score, doc_id, rank) for the term counts ``queries``, item being the place in the list."""
    spark = docs.sparkSession
    vocabulary = {t: k for k, t in enumerate(sorted(set().union(*queries)))}
    vecs = materialize(vectors(docs, vocabulary, doc_id, text), "lexical-vectors")
    total = vecs.filter("n > 0").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
    held = vecs.select(F.explode("ids").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    df = np.zeros(len(vocabulary), dtype=np.int64)
    for r in held.collect():                                     # terms of one block of items at most
        df[r["t"]] = r["df"]
    rank = np.empty(len(df), dtype=np.int64)
    rank[np.lexsort((np.arange(len(df)), -df))] = np.arange(len(df))
    items = []
    for q in queries:
        known = [(rank[vocabulary[t]], c * math.floor(1000 * math.log((2 * total["n"] + 2) / (2 * int(df[vocabulary[t]]) + 1))))
                 for t, c in q.items() if df[vocabulary[t]]]
        items.append((np.array([k for k, _ in known], dtype=np.int64), np.array([w for _, w in known], dtype=np.int64)))
    model = {"rank": rank, "items": items, "floors": [0] * len(items), "docs": total["n"], "terms": total["l"] or 1}
    some = vecs.filter(F.pmod(F.xxhash64("doc_id", "n", "ids"), F.lit(SAMPLE)) == 0)
    for r in ranked(search(some, model)).filter(F.col("rank") == TOP).collect():        # one row an item of the block
        model["floors"][r["item"]] = r["score"]
    return ranked(materialize(search(vecs, model), "lexical-found"))


def lexical_search(docs: DataFrame, items: DataFrame, item_id: str = "item_id", item_text: str = "text",
                   doc_id: str = "doc_id", text: str = "text", block: int = ITEM_BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): the ten best documents with a score above 0 for each row of ``items``.

    Null texts have no terms: such an item finds nothing, such a document is not found. Equal
    scores go by ascending doc_id, null last; repeated documents and items count each. An
    empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    kind = items.schema[item_id].dataType
    out: list[DataFrame] = []
    held: list[tuple] = []

    def flush() -> None:
        queries = [term_counts((t or "").encode("utf-8", "replace")) for _, t in held]
        if any(queries):
            names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(held)], f"item long, item_id {kind.simpleString()}")
            out.append(block_search(docs, queries, doc_id, text).join(F.broadcast(names), "item")   # ITEM_BLOCK rows at most
                       .select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
        held.clear()

    # One partition of the items at a time is on the driver, one block of them is searched.
    for r in items.select(F.col(f"`{item_id}`"), F.col(f"`{item_text}`").cast("string")).toLocalIterator():
        held.append((r[0], r[1]))
        if len(held) >= block:
            flush()
    if held:
        flush()
    if not out:
        return spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, out)


def op12_fp_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each row of ``benchmark``, as :func:`lexical_search` has them. Whole texts
    of any length are read, in slices; further columns are not."""
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SQL_TERMS = (f"unnest(regexp_extract_all(translate(text, '{_UP}', '{_LOW}'), "
              r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t")

OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
i AS (SELECT row_number() OVER () AS q, item_id, text FROM benchmark),
dt AS (SELECT r, t, count(*) AS tf FROM (SELECT r, {_SQL_TERMS} FROM d) x GROUP BY r, t),
it AS (SELECT q, t, count(*) AS times FROM (SELECT q, {_SQL_TERMS} FROM i) x GROUP BY q, t),
lens AS (SELECT r, sum(tf)::BIGINT AS n FROM dt GROUP BY r),
corpus AS (SELECT count(*) AS n, sum(n)::BIGINT AS l FROM lens),
norm AS (SELECT r, 100 - 75 + ((75 * lens.n * corpus.n) // corpus.l) AS m FROM lens, corpus),
w AS (SELECT t, floor(1000 * ln((2 * (SELECT n FROM corpus) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
      FROM dt GROUP BY t),
s AS (SELECT q, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM it JOIN w USING (t) JOIN dt USING (t) JOIN norm USING (r) GROUP BY q, r),
o AS (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank
      FROM s JOIN d USING (r) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id::BIGINT AS doc_id, score FROM o JOIN i USING (q) WHERE rank <= {TOP}
"""
