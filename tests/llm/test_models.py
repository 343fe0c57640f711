import math
import zlib
from collections import Counter

import numpy as np

from rollcall.llm import lattice
from rollcall.llm.language import UNKNOWN, codewords, decode, fit, op4_ecoc_language, profile
from rollcall.llm.lm import op7_lattice_lm, score
from rollcall.llm.quality import FEATURES, discriminant, op5_qda_quality, statistics
from tests.llm.helpers import SF, docs, folder, texts

BIG = "/root/testdata/sf0.01"


# -- language -----------------------------------------------------------------------

def test_language_held_out_accuracy(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{BIG}/documents.parquet").collect()}
    got = op4_ecoc_language(spark, BIG).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {d for d in lang if zlib.crc32(str(d).encode()) % 3 == 1}
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_odd_rows(spark, tmp_path):
    train = [(i, "the cat and the dog of the house " * 3, "en", "s") for i in range(30)]
    train += [(100 + i, "der hund und die katze aus dem haus " * 3, "de", "s") for i in range(30)]
    odd = [(900, None), (901, ""), (902, "12 + 34 = 46 !!"), (903, "the dog and the house"), (903, "the dog and the house"),
           (None, "der hund und das haus"), (905, "und die katze " * 200000)]
    d = folder(spark, tmp_path, documents=docs(*train, *odd))
    got = {r.doc_id: (r.lang_pred, r.score) for r in op4_ecoc_language(spark, d).collect() if (r.doc_id or 999) >= 900 or r.doc_id is None}
    assert got[900] == got[901] == got[902] == (UNKNOWN, 0.0)
    assert got[903][0] == "en" and got[None][0] == "de" and got[905][0] == "de"
    empty = spark.createDataFrame(*docs()).limit(0)
    assert fit(empty)["langs"] == []


def test_codes_correct_errors_and_flag_ambiguity():
    for k in (1, 2, 4, 7, 20):
        c = codewords(k)
        assert c.shape[0] == k and len({tuple(r) for r in c}) == k
    c = codewords(4)
    assert min((c[i] != c[j]).sum() for i in range(4) for j in range(i)) == 4
    model = {"langs": list("abcd"), "code": c, "w": np.zeros((1 << 13, c.shape[1])), "rel": np.ones(c.shape[1])}
    word = c[2].copy()
    word[0] = -word[0]                                   # one classifier wrong
    model["w"][5] = word
    p = np.zeros(1 << 13)
    p[5] = 10
    assert decode(model, p)[0] == "c" and not decode(model, p)[2]
    assert decode(model, np.zeros(1 << 13))[2]
    assert profile("ab" * 700000).sum() == 3 * 1400002 - 6          # a long text, piece by piece


# -- quality ------------------------------------------------------------------------

def test_quality_held_out(spark):
    y = {r.doc_id: r.quality for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    got = op5_qda_quality(spark, BIG).collect()
    held = [r for r in got if r.held_out and r.doc_id in y]
    pos = [r.score for r in held if y[r.doc_id] == 1]
    neg = [r.score for r in held if y[r.doc_id] == 0]
    assert np.mean([p > n for p in pos for n in neg]) > 0.97
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got)


def test_quality_odd_rows(spark, tmp_path):
    rows = docs((1, None), (2, ""), (3, "a"), (3, "a"), (None, "b c"), (4, "| x ### " * 100000))
    d = folder(spark, tmp_path / "a", documents=rows, labels=([(3, None), (4, 0), (4, 1)], "doc_id long, quality int"))
    assert {r.score for r in op5_qda_quality(spark, d).collect()} <= {0.5, 1.0, 0.0}
    e = folder(spark, tmp_path / "b", documents=spark.createDataFrame(*rows).limit(0), labels=([(4, 0)], "doc_id long, quality int"))
    assert op5_qda_quality(spark, e).count() == 0
    assert all(np.isfinite(statistics(t)).all() and len(statistics(t)) == len(FEATURES) for t in (None, "", "\n", "é!!", "A B"))


def test_discriminant_is_the_difference_of_normal_densities():
    from rollcall.llm import quality
    rng, d = np.random.default_rng(0), len(FEATURES)
    x = {0: rng.normal(0, 1, (400, d)), 1: rng.normal(0.5, 2, (300, d))}
    m = discriminant({k: (len(v), v.sum(0), v.T @ v) for k, v in x.items()}, pool=0.0, diagonal=0.0)
    z = rng.normal(0, 1, (5, d))

    def density(v):
        c = np.cov(v.T, bias=True) + 1e-6 * np.diag(m["scale"] ** 2)
        r = z - v.mean(0)
        return (-0.5 * (r @ np.linalg.inv(c) * r).sum(1) - 0.5 * np.linalg.slogdet(c)[1]) + np.log(len(v) / 700)

    assert np.allclose(np.sinh(quality.difference(m, z)) * 2, density(x[1]) - density(x[0]), atol=1e-3)


# -- language model -------------------------------------------------------------------

def _vocabulary():
    import public_tokenizers
    import sentencepiece
    path = public_tokenizers.path("piece_bpe_32k.model")
    lat, logp = lattice.load(path)
    return lat, logp, sentencepiece.SentencePieceProcessor(model_file=path)


def test_forward_sums_all_segmentations():
    lat, logp, sp = _vocabulary()

    def brute(w):
        s = lattice.WORD_START + w
        a = [0.0] + [-math.inf] * len(s)
        for j in range(1, len(s) + 1):
            for i in range(j):
                t = sp.piece_to_id(s[i:j])
                q = logp[t] if t > 2 and not sp.is_byte(t) else -math.inf
                if j - i == 1 and q == -math.inf:
                    q = sum(logp[lat.byte_ids[b]] for b in s[i:j].encode())
                a[j] = np.logaddexp(a[j], a[i] + q)
        return a[-1]

    words = ["the", "a", "thnterble", "漢字x", "!!", "x" * 60, "▁q", ""]
    assert np.allclose(lat.log_prob(words, logp), [brute(w) for w in words])


def test_training_raises_the_likelihood():
    lat, logp, _ = _vocabulary()
    words, n = ["the", "thing", "thnterble", "漢"], np.array([9.0, 4.0, 2.0, 1.0])
    before = (lat.log_prob(words, logp) * n).sum()
    uses = lat.expected(words, n, logp)
    new = np.log((uses + 1e-9) / (uses + 1e-9).sum())
    assert (lat.log_prob(words, new) * n).sum() > before


def test_scores_against_counts(spark):
    got = {r.doc_id: r for r in op7_lattice_lm(spark, SF).collect()}
    all_texts = texts(spark)
    train = [t for d, t in all_texts if zlib.crc32(str(d).encode()) % 7 != 2]
    c = Counter(w for t in train for w in (t or "").encode().lower().split())
    n, v = sum(c.values()) + len(train), len(c) + 1
    lat, first, _ = _vocabulary()
    words = sorted(c)
    logp = first
    for _ in range(3):
        uses = lat.expected([w.decode() for w in words], np.array([float(c[w]) for w in words]), logp)
        uses += np.where(np.isfinite(logp), 0.01, 0.0)
        logp = np.log(uses / (uses.sum() + len(train) + 0.01), where=uses > 0, out=np.full(len(uses), -np.inf))
    for d, t in all_texts:
        w = (t or "").encode().lower().split()
        plain = lat.log_prob([x.decode() for x in w], first).sum() / math.log(10)
        pieces = lat.log_prob([x.decode() for x in w], logp)
        model = sum(math.log10((max(c[x] - 0.75, 0) + 0.75 * v * math.exp(p)) / n) for x, p in zip(w, pieces))
        model += math.log10((len(train) - 0.75) / n)
        assert abs(plain - got[d].vocab_score) < 1e-6 * max(1, -plain) and abs(model - got[d].score) < 1e-6 * max(1, -model)
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((len(train) + 1) / (n + v + 1))
        r = got[d]
        assert abs(base - r.base_score) < 1e-6 and r.train_tokens == n and math.isfinite(r.score) and r.score < 0
        assert (r.n_tokens, r.n_known) == (len(w) + 1, sum(c[x] > 0 for x in w) + 1)


def test_scores_do_not_depend_on_the_head_share(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(*docs((1, "a b a"), (2, "A\tc\x0bzzz"), (2, "A\tc\x0bzzz"), (None, None), (4, ""), (5, "q" * 3000)))
    train = F.col("doc_id").isin(1, 2)
    one = sorted((r.doc_id or 0, r.n_known, round(r.score, 6)) for r in score(df, train, head_share=0.01).collect())
    two = sorted((r.doc_id or 0, r.n_known, round(r.score, 6)) for r in score(df, train, head_share=1.0).collect())
    assert one == two and len(one) == 6
    assert score(df.limit(0), train).count() == 0
    assert all(math.isfinite(r.score) for r in score(df, F.lit(False)).collect())
