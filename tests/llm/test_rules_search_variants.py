"""Operators 11 to 13 against plain versions, and on odd rows."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from rollcall.llm import lexical, rules, variants
from tests.llm.helpers import docs, folder

LABELS = "doc_id long, quality int, toxic int, __rid long"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one two three"), (4, "one two three"), (None, "one two three"),
       (5, "a\x0bb\x85c d e \U0001f600 " * 30), (6, "word " * 40_000 + "x" * 300_000 + " end")]


# -- 11: base rules and the n-gram ratio

def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = set()
    for i, w in enumerate(zip(words, words[1:], words[2:])):
        if windows[w] > 1:
            inside |= {i, i + 1, i + 2}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(inside))


@pytest.mark.parametrize("seed", range(40))
def test_base_counts_match_plain_version(seed):
    r = random.Random(seed)
    text = "".join(r.choice(["a", "b", "é", " ", " ", "\n", "\n", "\x0b", "#", "|", " ", "ab"]) for _ in range(r.choice([0, 3, 30, 300])))
    assert rules.base_counts(text.encode()) == plain_counts(text)


def test_slices_do_not_change_counts(monkeypatch):
    text = ("some words, and \n more ## of them é\n" * 50).encode()
    whole = rules.base_counts(text)
    one = np.concatenate(list(rules.ngrams(text, rules.TokenHashes())))
    monkeypatch.setattr(rules.slices, "__defaults__", (16,))
    assert len(list(rules.slices(text))) > 20
    assert rules.base_counts(text) == whole
    assert sorted(np.concatenate(list(rules.ngrams(text, rules.TokenHashes())))) == sorted(one)


def test_verdict_rejects_what_the_target_lacks(spark, tmp_path):
    r = random.Random(1)
    words = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    good = [(i, " ".join(r.choice(words) for _ in range(80)) + ".") for i in range(120)]
    bad = [(1000 + i, " ".join(r.choice(words) + r.choice(["###", "!!", "|"]) for _ in range(80))) for i in range(40)]
    d = folder(spark, tmp_path, documents=docs(*good, *bad),
               labels=([(i, 1, 0, 0) for i in range(60)] + [(1000 + i, 0, 0, 0) for i in range(10)], LABELS))
    got = {x.doc_id: x.kept for x in rules.op11_hashed_llr_rules(spark, d).collect()}
    assert all(got[i] for i, _ in good) and not any(got[i] for i, _ in bad)


def test_rules_odd_rows(spark, tmp_path):
    d = folder(spark, tmp_path, documents=docs(*ODD), labels=([(4, 1, 0, 0), (4, 1, 0, 0), (None, 1, 0, 0), (5, None, 0, 0)], LABELS))
    got = rules.op11_hashed_llr_rules(spark, d).collect()
    by = {}
    for x in got:
        by.setdefault(x.doc_id, []).append(x)
    assert len(got) == len(ODD) and len(by[4]) == 2 and by[4][0] == by[4][1]
    assert all(by[k][0].n_words == 0 and by[k][0].base_failed and not by[k][0].kept for k in (1, 2, 3))
    assert by[6][0].n_words == 40_002 and by[6][0].n_repeat_words == 40_000 and by[6][0].base_failed
    assert (by[5][0].n_words, by[5][0].word_chars) == plain_counts(ODD[6][1])[:2]
    e = folder(spark, tmp_path / "e", documents=docs(*ODD[:2]), labels=([], LABELS))
    assert not any(x.kept for x in rules.op11_hashed_llr_rules(spark, e).collect())
    none = folder(spark, tmp_path / "n", documents=([], docs()[1]), labels=([], LABELS))
    assert rules.op11_hashed_llr_rules(spark, none).count() == 0


# -- 12: ranked search

def plain_search(texts, items):
    term = lambda t: Counter(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+",
                                        "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")))
    tf = [(i, term(t)) for i, t in texts]
    tf = [(i, c) for i, c in tf if c]
    n, total = len(tf), sum(c.total() for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in tf:
            m = 25 + (75 * c.total() * n) // total
            s = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 8 * m))
                    for t, k in term(text).items() if t in c)
            if s > 0:
                scores.append((-s, i is None, i if i is not None else 0))
        out += [(item, k + 1, None if e[1] else e[2], -e[0]) for k, e in enumerate(sorted(scores)[:10])]
    return sorted(out, key=repr)


ITEM = "item_id long, text string, doc_id long, score long"


@pytest.mark.parametrize("seed", range(3))
def test_search_matches_plain_version(spark, tmp_path, seed, monkeypatch):
    r = random.Random(seed)
    words = ["w%d" % k for k in range(60)]
    weight = [1 / (k + 1) for k in range(60)]
    line = lambda k: " ".join(r.choices(words, weight, k=k))
    texts = [(i, line(r.choice([1, 5, 20, 60]))) for i in range(700)] + [(i, "W1 w2, w3") for i in range(700, 760)]
    texts += [(3, "w50 w50 w51"), (3, "w50 w50 w51"), (None, "w50 w50 w51")] + ODD[:3]
    items = [(i, line(r.choice([1, 4, 12]))) for i in range(20)] + [(5, "w1 w1 w50"), (5, "w1 w1 w50"), (None, "W51"), (90, None), (91, "")]
    d = folder(spark, tmp_path, documents=docs(*texts), benchmark=([(*i, 7, 7) for i in items], ITEM))
    # Small lots: several tries a task, and the tries have many levels.
    monkeypatch.setattr(lexical, "CELLS", 100)
    got = sorted((tuple(x) for x in lexical.op12_fp_tree_search(spark, d).collect()), key=repr)
    assert got == plain_search(texts, items)
    by_block = lexical.lexical_search(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet"), block=3)
    assert sorted((tuple(x) for x in by_block.collect()), key=repr) == got


def test_trie_bounds_hold_and_prune():
    r = np.random.default_rng(0)
    ids = [np.flatnonzero(r.random(40) < 1 / np.arange(1, 41) ** 0.5) for _ in range(900)]
    tfs = [r.integers(1, 9, len(x)) for x in ids]
    m = r.integers(25, 400, 900).tolist()
    trie = lexical.Trie(ids, tfs, m, 40)
    terms, weight = np.array([2, 17, 30, 39]), np.array([50, 900, 1500, 4000])
    score = np.array([sum(int(w) * ((10 ** 9 * int(t[x == k][0])) // (1000 * int(t[x == k][0]) + 8 * mm))
                          for k, w in zip(terms, weight) if k in x) for x, t, mm in zip(ids, tfs, m)])
    for node, (lo, hi) in enumerate(trie.span):
        bound = int((lexical.parts(trie.most[[node]][:, terms], trie.least[[node]]) @ weight)[0])
        assert bound >= score[trie.order[lo:hi]].max()
    floor = int(np.sort(score)[-10])
    walked = list(trie.walk(terms, weight, lambda: floor))
    assert sorted(s for s, _ in walked) == sorted(score[score >= floor].tolist())
    assert all(score[at] == s for s, at in walked)
    assert sorted(trie.order) == list(range(900)) and len(trie.span) > 50


def test_search_empty_tables(spark, tmp_path):
    a = folder(spark, tmp_path / "a", documents=([], docs()[1]), benchmark=([(1, "x", 0, 0)], ITEM))
    b = folder(spark, tmp_path / "b", documents=docs((1, "x")), benchmark=([], ITEM))
    c = folder(spark, tmp_path / "c", documents=docs((1, None), (2, "--")), benchmark=([(1, "x", 0, 0), (2, None, 0, 0)], ITEM))
    for d in (a, b, c):
        out = lexical.op12_fp_tree_search(spark, d)
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == 0


def test_search_reads_very_long_texts_whole(spark, tmp_path):
    long = "x " * 700_000 + "needle"
    d = folder(spark, tmp_path, documents=docs((1, long), (2, "other")), benchmark=([(1, "needle", 0, 0)], ITEM))
    assert [x.doc_id for x in lexical.op12_fp_tree_search(spark, d).collect()] == [1]


# -- 13: spelling variants

def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(texts):
    n = Counter()
    for i, t in texts:
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for w in re.findall("[A-Za-zÀ-ÿ]+", t):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= 6:
                n[w] += 1
    n = {w: k for w, k in n.items() if k >= 5}
    near = {w: [] for w in n}
    for a, b in itertools.combinations(n, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(2))
def test_variants_match_plain_version(spark, tmp_path, seed):
    r = random.Random(seed)
    stems = ["".join(r.choice("abé÷ßdefghz") for _ in range(r.choice([6, 7, 9]))) for _ in range(25)]
    words = []
    for s in stems:
        words += [s] * 40
        for _ in range(4):                                      # a chain of rarer and rarer spellings
            k = r.randrange(len(s))
            s = r.choice([s[:k] + "q" + s[k:], s[:k] + "q" + s[k + 1:], s[:k] + s[k + 1:]])
            words += [s] * r.choice([1, 2, 8])
    texts = [(i, " ".join(w.upper() if w.isascii() and r.random() < 0.3 else w for w in r.choices(words, k=120))) for i in range(250)]
    texts += [(7, texts[7][1]), (None, texts[0][1]), (None, None), (9, ""), (10, "ABCDEF" * 30_000 + " Āabcdefgā")]
    d = folder(spark, tmp_path, documents=docs(*texts))
    got = sorted((tuple(x) for x in variants.op13_reduced_alphabet_variants(spark, d).collect()), key=repr)
    want = plain_variants(texts)
    assert got == want
    assert any(x[1] and x[2] != x[1] for x in want), "no chain of two forms was planted"


def test_variants_empty(spark, tmp_path):
    e = folder(spark, tmp_path, documents=([], docs()[1]))
    out = variants.op13_reduced_alphabet_variants(spark, e)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"] and out.count() == 0


def test_neighbourhood_is_full(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([("abca",)], "r string")
    got = set(df.select(F.explode(variants.neighbourhood(F.col("r"), 3))).toPandas()["col"])
    want = {"abca"} | {"abca"[:i] + "abca"[i + 1:] for i in range(4)}
    want |= {"abca"[:i] + s + "abca"[i + 1:] for i in range(4) for s in "abc"}
    want |= {"abca"[:i] + s + "abca"[i:] for i in range(5) for s in "abc"}
    assert got == want
