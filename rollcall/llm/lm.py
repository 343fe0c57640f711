"""Language-model scores: marginal probability of a text over all subword segmentations.

A text is its words, lower-cased, then one end. A piece never crosses a word's end, so
the text's marginal is the product of its words' marginals (see ``lattice``) and the
end's probability. With the vocabulary's own scores as piece probabilities that is
``vocab_score``; the file scores no end of a text, so it covers the words alone. For
``score`` these probabilities are only the start: they are re-estimated by expectation
maximisation (``rounds``) on the word counts of all training documents.
A word's lattice has one more arc, the whole word as the training corpus counted it:
absolute discounting takes ``DISCOUNT`` from each count and gives the sum of it to the
segmentations into pieces. Without that arc held-out words cost 5.4 digits each, with it
4.6 (16,000 documents).

Word counts are a Spark table, as large as the corpus makes it. Scoring splits the
tokens by a share: words above ``HEAD_SHARE`` of all training tokens are at most
``1 / HEAD_SHARE`` words, whatever the corpus, and are summed where the text is read;
the rest is joined with the counts by word, so no key of that join is frequent in
training, and each word's lattice is computed where its rows meet.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm import lattice
from rollcall.llm.common import arrow_rows, crc_mod, materialize, table

HEAD_SHARE = 2e-6
EM_ROUNDS = 3
PSEUDO = 0.01
DISCOUNT = 0.75
_FLUSH = 200_000
SHORT_ROWS = 16384


def tokens(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, cut at space and U+0009..U+000D."""
    return (text or "").encode("utf-8").lower().split()


def word_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """(token, c) over all rows; tasks send sums, not tokens."""
    def run(batches):
        counts: Counter = Counter()

        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array([k.decode() for k in counts], pa.string()), pa.array(counts.values(), pa.int64())],
                names=["token", "c"])

        for b in batches:
            for t in b.column(0).to_pylist():
                counts.update(tokens(t))
                if len(counts) > _FLUSH:
                    yield flush()
                    counts.clear()
        yield flush()

    arrow_rows(texts.sparkSession, 256)
    part = texts.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, "token string, c long")
    return part.groupBy("token").agg(F.sum("c").alias("c"))


def train_pieces(counts: DataFrame, n_ends: int, path: str, rounds: int = EM_ROUNDS):
    """(lattice state, natural log probabilities of its pieces, as the file has them, of the end).

    Each round is one pass over the word counts; what reaches the driver is one number
    per piece of the vocabulary.
    """
    lat, logp = lattice.load(path)
    arrow_rows(counts.sparkSession, SHORT_ROWS)
    sc = counts.sparkSession.sparkContext
    shared, first = sc.broadcast(lat.state), sc.broadcast(logp)
    end = float(np.log(PSEUDO))                  # taken only without rounds and without training rows
    for _ in range(rounds):
        now = sc.broadcast(logp)

        def run(batches):
            lat = lattice.Lattice(*shared.value)
            total = np.zeros(lat.n_ids)
            for b in batches:
                total += lat.expected(b.column(0).to_pylist(), b.column(1).to_numpy().astype(float), now.value)
            ids = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], names=["id", "uses"])

        uses = counts.mapInArrow(run, "id long, uses double").groupBy("id").agg(F.sum("uses").alias("uses"))
        got = np.where(np.isfinite(logp), PSEUDO, 0.0)
        for r in uses.collect():                               # at most one row a piece
            got[r["id"]] += r["uses"]
        with np.errstate(divide="ignore"):
            logp = np.log(got / (got.sum() + n_ends + PSEUDO))
            end = float(np.log((n_ends + PSEUDO) / (got.sum() + n_ends + PSEUDO)))
    return shared, sc.broadcast(logp), first, end


def score(docs: DataFrame, train, path: str | None = None, text: str = "text", doc_id: str = "doc_id",
          head_share: float = HEAD_SHARE, rounds: int = EM_ROUNDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, n_known, train_tokens, base_score, score,
    vocab_score.

    ``train``: condition that marks the training rows (null: not one). A null or empty
    text is the end alone. Repeated rows are scored alike, each by itself. With no
    training row the base counts are 0 and the pieces keep the scores they started with;
    an empty table gives no rows. Scores are finite for any text.
    """
    import public_tokenizers
    spark = docs.sparkSession
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    learn = docs.filter(F.coalesce(train, F.lit(False)))
    counts = materialize(word_counts(learn, text), "lm-counts")
    n_ends = learn.select(F.lit(1)).count()
    sums = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = int(sums["n"] or 0) + n_ends, int(sums["v"]) + (n_ends > 0)
    shared, logp, first, end = train_pieces(counts, n_ends, path, rounds)
    log_total = float(np.log10(n + v + 1))
    ln10 = float(np.log(10.0))
    freed = float(np.log(DISCOUNT * v / n)) if n else 0.0
    if n_ends:
        end = float(np.log((n_ends - DISCOUNT) / n))

    def word_log10(c, lp):
        """log10 of a word's probability from its training count and its pieces' marginal."""
        with np.errstate(divide="ignore"):
            own = np.log(np.maximum(np.asarray(c, dtype=float) - DISCOUNT, 0.0) / max(n, 1))
        return np.logaddexp(own, freed + lp) / ln10

    def with_lattice(batches):
        lat = lattice.Lattice(*shared.value)
        for b in batches:
            trained, plain = lat.log_probs(b.column(0).to_pylist(), logp.value, first.value)
            lp = word_log10(b.column(1).to_numpy(), trained)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lp), pa.array(plain / ln10)],
                                             names=["token", "c", "lp", "vp"])

    heads = (counts.filter(F.col("c") > head_share * n)        # at most 1 / head_share rows
             .mapInArrow(with_lattice, "token string, c long, lp double, vp double").collect())
    table_ = {r["token"].encode(): (float(np.log10(r["c"] + 1)) - log_total, r["lp"], r["vp"]) for r in heads}
    head = spark.sparkContext.broadcast(table_)

    names = ["doc_id", "rid", "n_tokens", "known", "base", "lp", "vp", "tail"]
    id_type = docs.schema[doc_id].dataType.simpleString()

    def split(batches):
        known_of = head.value
        for b in batches:
            n_tokens, known, base, lp, vp, words, tfs, at = [], [], [], [], [], [], [], [0]
            for t in b.column(2).to_pylist():
                toks = tokens(t)
                k = s = p = v0 = 0
                for w, tf in Counter(toks).items():
                    hit = known_of.get(w)
                    if hit is None:
                        words.append(w)
                        tfs.append(tf)
                    else:
                        k += tf
                        s += tf * hit[0]
                        p += tf * hit[1]
                        v0 += tf * hit[2]
                n_tokens.append(len(toks) + 1)
                known.append(k)
                base.append(float(s))
                lp.append(float(p))
                vp.append(float(v0))
                at.append(len(words))
            tail = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays(
                [pa.array(words, pa.binary()).cast(pa.string()), pa.array(tfs, pa.int64())], names=["w", "tf"]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n_tokens, pa.int64()), pa.array(known, pa.int64()),
                 pa.array(base), pa.array(lp), pa.array(vp), tail], names=names)

    arrow_rows(spark, 256)
    src = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.monotonically_increasing_id().alias("rid"),
                      F.col(f"`{text}`").cast("string").alias("t"))
    parts = materialize(src.mapInArrow(split, f"doc_id {id_type}, rid long, n_tokens long, known long, base double, "
                                              "lp double, vp double, tail array<struct<w:string,tf:long>>"), "lm-parts")

    def add(batches):
        lat = lattice.Lattice(*shared.value)
        for b in batches:
            rid, tf = b.column(0).to_numpy(), b.column(2).to_numpy()
            word = b.column(1).dictionary_encode()
            c = b.column(3).fill_null(0).to_numpy().astype(float)
            both = lat.log_probs(word.dictionary.to_pylist(), logp.value, first.value)[:, word.indices.to_numpy()]
            lp, vp = word_log10(c, both[0]), both[1] / ln10
            rows, inv = np.unique(rid, return_inverse=True)
            cols = [np.bincount(inv, x, len(rows)) for x in
                    (tf * (c > 0), tf * (np.log10(c + 1) - log_total), tf * lp, tf * vp)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows), pa.array(cols[0].astype(np.int64)), *map(pa.array, cols[1:])],
                names=["rid", "known", "base", "lp", "vp"])

    rest = parts.select("rid", F.explode("tail").alias("x")).select("rid", F.col("x.w").alias("w"), F.col("x.tf").alias("tf"))
    arrow_rows(spark, SHORT_ROWS)
    rest = (rest.join(counts, rest["w"] == counts["token"], "left").select("rid", "w", "tf", "c")
            .mapInArrow(add, "rid long, known long, base double, lp double, vp double"))
    sums = (parts.select("rid", "known", "base", "lp", "vp", "doc_id", "n_tokens")
            .unionByName(rest, allowMissingColumns=True)
            .groupBy("rid").agg(F.sum("known").alias("known"), F.sum("base").alias("base"), F.sum("lp").alias("lp"),
                                F.sum("vp").alias("vp"),
                                F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens")))
    end_base = float(np.log10(n_ends + 1)) - log_total
    return sums.select(
        "doc_id", "n_tokens", (F.col("known") + F.lit(1 if n_ends else 0)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + F.lit(end_base)).alias("base_score"),
        (F.col("lp") + F.lit(end / ln10)).alias("score"), F.col("vp").alias("vocab_score"))


def op7_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` scored by a model of those whose remainder is not 2."""
    rest = crc_mod(F.col("doc_id"), 7)
    s = score(table(spark, sf_dir, "documents"), rest != 2)
    held = F.coalesce(rest == 2, F.lit(False)).alias("held_out")
    return s.select("doc_id", held, "n_tokens", "n_known", "train_tokens", "base_score", "score", "vocab_score")
