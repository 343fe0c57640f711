import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from rollcall.llm import forest
from rollcall.llm.cws import SAMPLES, fingerprint_neighbours, op8_cws_fingerprints, with_next
from rollcall.llm.forest import depth_for, drop_near_duplicates, op10_lsh_forest_join, shingles
from rollcall.llm.graph import components, local_roots
from rollcall.llm.neighbours import audit, bits_for, near_duplicates, starts_for
from rollcall.llm.pii import KINDS, op6_contextual_pii, redact
from tests.llm.helpers import SF, docs, folder, texts


# -- personal data ------------------------------------------------------------------

FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _luhn(d):
    double = [int(c) * 2 for c in d[-2::-2]]
    return (sum(int(c) for c in d[-1::-2]) + sum(x - 9 if x > 9 else x for x in double)) % 10 == 0


def _base(t):
    out = []
    for k in KINDS:
        for m in re.finditer(FORMS[k], t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if (k == "ip" and any(int(x) > 255 for x in m[0].split("."))
                    or k == "card" and not (16 <= len(d) <= 19 and _luhn(d)) or k == "phone" and not 8 <= len(d) <= 15):
                continue
            out.append(f"{k}:{m.start()}:{m.end()}")
    return out


def test_base_spans_whole_table(spark):
    got = {r.doc_id: r for r in op6_contextual_pii(spark, SF).collect()}
    for d, t in texts(spark):
        want = _base(t)
        r = got[d]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in want) for k in KINDS]


def test_odd_texts_and_found_identifiers(spark, tmp_path):
    odd = [(1, "a@b@c.d x@y.z_q@e.f é😀 1.2.3.4.5.6.7.8 999.1.1.1 0255.1.1.1 00000000000000001.2.3.4"), (2, None), (3, ""),
           (4, "+1 (2) 3-4.5 678 9 +12345678 4111 1111 1111 1111 4111-1111-1111-1112 " + "9" * 30000),
           (5, "a" * 30000 + "@" + "b.c" * 3000), (6, "x@"), (6, "x@"), (None, "z@z.zz")]
    seeds = [(100 + i, f"hello my phone is +1 555 010 {i:04d} thanks bye") for i in range(12)]
    new = [(200, "oh my phone is 5550109999 thanks bye"), (201, "clean my phone is great 12345 ok")]
    d = folder(spark, tmp_path, documents=docs(*odd, *seeds, *new))
    got = defaultdict(list)
    for r in op6_contextual_pii(spark, d).collect():
        got[r.doc_id].append(r.spans)
    for doc, t in odd:
        assert set(got[doc]) == {",".join(_base(t))}
    assert got[200] == ["phone:15:25"] and got[201] == [""] and len(got[6]) == 2
    df = spark.read.parquet(f"{d}/documents.parquet")
    out = redact(df)
    assert out.columns == df.columns and out.count() == df.count()
    clean = {r.doc_id: r.text for r in out.collect()}
    assert clean[200] == "oh my phone is [PHONE] thanks bye" and clean[201] == new[1][1]
    assert clean[1].startswith("a@[EMAIL] [EMAIL][EMAIL] é😀 [IP].[IP] 999.1.1.1") and clean[2] is None
    e = folder(spark, tmp_path / "e", documents=df.limit(0))
    assert op6_contextual_pii(spark, e).count() == 0


def test_many_unseen_identifiers_and_a_second_step(spark, tmp_path):
    # Three seeds and twenty unseen numbers share a phrase; five of these share another phrase
    # with numbers that no seed is next to. A digit before the phrase and marks change nothing.
    seeds = [(i, f"at 7 phone is (+1 555 010 {i:04d}), thanks bye") for i in range(3)]
    unseen = [(100 + i, f"at 7 phone is 55520{i:05d}, thanks bye") for i in range(20)]
    again = [(200 + i, f"oh ring me under 55520{i:05d} tonight bye") for i in range(5)]
    far = [(300 + i, f"oh ring me under 55530{i:05d} tonight bye") for i in range(5)]
    wrong = [(400 + i, f"oh item costs only 55540{i:05d} today bye") for i in range(5)]
    d = folder(spark, tmp_path, documents=docs(*seeds, *unseen, *again, *far, *wrong))
    got = {r.doc_id: r.spans for r in op6_contextual_pii(spark, d).collect()}
    assert all(got[i] == "phone:14:24" for i, _ in unseen)
    assert all(got[i] == "phone:17:27" for i, _ in [*again, *far])
    assert all(got[i] == "" for i, _ in wrong)


# -- fingerprints -------------------------------------------------------------------

def _jaccard(a, b):
    a, b = Counter((a or "").split()), Counter((b or "").split())
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_fingerprints_estimate_generalised_jaccard(spark):
    got = {r.doc_id: r for r in op8_cws_fingerprints(spark, SF).collect()}
    rows = sorted(texts(spark), reverse=True)
    off_edited, off_next, spread = [], [], []
    for i, (d, t) in enumerate(rows):
        nxt, k = rows[(i + 1) % len(rows)][1], len(t) // 2
        edited = t[:len(t) - k] + nxt[:k]
        assert got[d].n_chars == len(t) and got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        off_edited.append(got[d].near_edited - _jaccard(t, edited))
        off_next.append(got[d].near_next - _jaccard(t, nxt))
        j = _jaccard(t, edited)
        spread.append(j * (1 - j) / SAMPLES)
    error = np.sqrt(np.mean(spread))             # the standard error that so many samples leave
    assert abs(np.mean(off_edited)) < 4 * error / np.sqrt(len(rows)) and abs(np.mean(off_next)) < 0.02
    assert 0.8 * error < np.std(off_edited) < 1.2 * error


def test_neighbours_however_ids_are_spread(spark, monkeypatch):
    monkeypatch.setattr("rollcall.llm.cws.BUCKET", 4)
    ids = [*range(60), *(hash((i, 7)) >> 2 for i in range(60)), -2 ** 63, 2 ** 63 - 1]
    rows = [(i, f"t{i}") for i in ids] + [(5_000_000, f"same {i}") for i in range(40)] + [(None, f"null {i}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    found = with_next(df).filter("own").collect()
    assert sorted((r.text for r in found)) == sorted(t for _, t in rows)
    follows = {r.text: r.next_text for r in found}
    chain = [max(rows, key=lambda r: -2 ** 64 if r[0] is None else r[0])[1]]
    while len(chain) < len(rows):
        chain.append(follows[chain[-1]])
    assert follows[chain[-1]] == chain[0] and len(set(chain)) == len(rows)       # one ring through all rows
    order = {t: i for i, t in rows}
    passed = [order[t] for t in chain]
    assert passed == sorted((i for i in passed if i is not None), reverse=True) + [None] * 40
    sizes = [r["count"] for r in with_next(df).filter("own").groupBy("bucket").count().collect()]
    assert max(sizes) <= 4                                                         # repeated and null ids are parted, too


def test_fingerprints_odd_rows(spark):
    far = 10 ** 12
    df = spark.createDataFrame(*docs((1, None), (2, ""), (2, ""), (None, "a b"), (5, "a b"), (far, "x y z"), (-7, "é")))
    got = {(r.doc_id, r.n_chars): r for r in fingerprint_neighbours(df, 8).collect()}
    assert got[5, 3].fingerprint == got[None, 3].fingerprint and got[2, 0].near_edited == 1.0 and got[2, 0].near_next == 1.0
    assert got[None, 3].edited_sha256 == hashlib.sha256(b"a x").hexdigest()          # after the last comes the first
    assert got[far, 5].edited_sha256 == hashlib.sha256(b"x ya ").hexdigest()
    assert fingerprint_neighbours(df.limit(0), 8).count() == 0
    alone = fingerprint_neighbours(df.filter("doc_id = 5"), 8).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0


# -- vectors ------------------------------------------------------------------------

def test_near_vectors_against_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 16))
    rows = []
    for i in range(600):
        v = rng.normal(size=16) if i % 3 else base[i % 12] + rng.normal(size=16) * 0.03
        rows.append((i, [float(x) for x in v], int(i % 2)))
    rows += [(1000 + i, rows[0][1], 0) for i in range(20)]
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    lab = np.array([r[2] for r in rows])
    link = (x @ x.T >= 0.98) & (lab[:, None] == lab)
    np.fill_diagonal(link, False)
    root = local_roots(link)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicates(df).collect()}
    for i, r in enumerate(rows):
        assert got[r[0]] == (link[i].sum(), rows[root[i]][0], rows[root[i]][0] == r[0])


def test_near_vectors_odd_rows(spark):
    z = [1.0] * 4
    rows = [(1, z), (1, z), (2, [2.0] * 4), (4, None), (5, [0.0] * 4), (6, [float("nan")] * 4), (7, [1.0, None, 1.0, 1.0]),
            (8, [1.0] * 3), (None, z), (9, []), (10, [1e200] * 4), (11, [1.0, 1.0, 1.0, 0.5])]
    rows = [(*r, 1, "x") for r in rows] + [(3, z, None, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicates(df).collect()}
    assert got[1] == got[2] == got[10] == (4, 1) and got[None] == (4, 1)
    assert all(got[k] == (0, k) for k in (3, 4, 5, 6, 7, 8, 9, 11))
    assert near_duplicates(df.limit(0)).count() == 0


def _against_brute_force(spark, x):
    """All rows of one label: links, class and kept of each as by brute force."""
    x = x / np.linalg.norm(x, axis=1)[:, None]
    link = x @ x.T >= 0.98
    np.fill_diagonal(link, False)
    root = local_roots(link)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicates(df).collect()}
    assert all(got[i] == (link[i].sum(), root[i]) for i in range(len(x)))


def _cluster(rng, centre, n, cosine, size=16):
    """``n`` different vectors at about ``cosine`` to each other around a unit vector."""
    off = rng.normal(size=(n, size))
    off -= (off @ centre)[:, None] * centre
    return centre + off / np.linalg.norm(off, axis=1)[:, None] * np.sqrt(1 / cosine - 1)


def test_near_vectors_of_dense_clusters_side_by_side(spark):
    rng = np.random.default_rng(8)
    a, z = np.eye(16)[0], np.eye(16)[1]
    beside = 0.985 * a + np.sqrt(1 - 0.985 ** 2) * z
    for n in (12, 400):
        _against_brute_force(spark, np.vstack([_cluster(rng, a, n, 0.9995), _cluster(rng, beside, n, 0.9995),
                                               rng.normal(size=(200, 16))]))


def test_near_vectors_of_dense_clusters_that_only_touch(spark):
    # Most of the pairs across are below the threshold; a third cluster is out of reach.
    rng = np.random.default_rng(9)
    a, z, y = np.eye(16)[:3]
    beside, off = 0.979 * a + np.sqrt(1 - 0.979 ** 2) * z, 0.9 * a + np.sqrt(1 - 0.9 ** 2) * y
    _against_brute_force(spark, np.vstack([_cluster(rng, c, 150, 0.999) for c in (a, beside, off)]))


def test_starts_follow_the_rows_and_the_audit_sees_rare_links(spark):
    for rows in (10 ** 3, 10 ** 6, 10 ** 9):
        share = (1 - np.arccos(0.98) / np.pi) ** bits_for(rows)
        assert 1 - (1 - share) ** starts_for(rows) >= 0.999
    # Four linked nodes of 3000, none of them in the first 1024 asked, and no group found.
    rng = np.random.default_rng(10)
    v = rng.normal(size=(3000, 16))
    order = spark.range(3000).selectExpr("id", "pmod(xxhash64(id, 99), 3) as part").filter("part = 2").orderBy("id").limit(4)
    a, b, c, d = [r.id for r in order.collect()]
    v[b], v[d] = v[a] * 1.001 + 1e-4, v[c] * 1.001 + 1e-4
    space = spark.createDataFrame([(i, 1, 16, x.tolist()) for i, x in enumerate(v)], "node long, label long, size long, v array<double>")
    lists = spark.createDataFrame([(i, (i + 1) % 3000, 0.1) for i in range(3000)] + [(a, b, 1.0), (b, a, 1.0), (c, d, 1.0), (d, c, 0.95)],
                                  "node long, nbr long, sim float")
    assert audit(space, spark.createDataFrame([], "node long, component long"), 0.98, lists) == (4, 0)


def test_components(spark):
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    root = {n: n for p in pairs for n in p}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: find(n) for n in got} and set(got) == {n for p in pairs if p[0] != p[1] for n in p}


# -- documents ----------------------------------------------------------------------

def test_similar_documents_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(500)]
    rows, n = [], 0
    for g in range(12):
        seed = list(rng.choice(words, 120))
        for c in range(10 if g else 300):
            t = list(seed)
            for at in rng.integers(0, len(t), int(rng.integers(0, 5))):
                t[at] = str(rng.choice(words))
            rows.append((n, " ".join(t)))
            n += 1
    sets = [set(shingles(t).tolist()) for _, t in rows]
    link = np.array([[len(a & b) / len(a | b) >= 0.8 for b in sets] for a in sets])
    np.fill_diagonal(link, False)
    root = local_roots(link)
    d = folder(spark, tmp_path, documents=docs(*rows))
    for r in op10_lsh_forest_join(spark, d).collect():
        assert (r.n_links, r.class_id) == (link[r.doc_id].sum(), root[r.doc_id])
    assert depth_for(0.5) > depth_for(0.999) >= 1


def _family(rng, n, words, changes):
    """(rid, text) of ``n`` texts, each a seed with up to ``changes`` - 1 words changed."""
    seed, rows = list(rng.choice(words, 60)), []
    for i in range(n):
        t = list(seed)
        for at in rng.integers(0, len(t), int(rng.integers(0, changes))):
            t[at] = str(rng.choice(words))
        rows.append((i, " ".join(t)))
    return rows


def test_prefixes_are_shortened_to_the_measured_recall(spark, tmp_path, monkeypatch):
    """From the full path on, most pairs near the threshold are missed until it is shortened."""
    rng = np.random.default_rng(21)
    rows = _family(rng, 150, [f"w{i}" for i in range(400)], 4)
    spark.createDataFrame(rows, "rid long, text string").write.parquet(str(tmp_path / "rows"))
    sets = [set(shingles(t).tolist()) for _, t in rows]
    link = np.array([[len(a & b) / len(a | b) >= 0.8 and a != b for b in sets] for a in sets])
    lengths = []
    whole = forest.loose_edges
    monkeypatch.setattr(forest, "loose_edges", lambda nodes, n: lengths.append(n) or whole(nodes, n))
    seen = []
    measure = forest.audit
    monkeypatch.setattr(forest, "audit", lambda *a: seen.append(measure(*a)) or seen[-1])
    monkeypatch.setattr(forest, "LEADERS", 4)
    got = forest.classes(spark.read.parquet(str(tmp_path / "rows")), start=8).collect()
    copies = [sum(a == b for b in sets) - 1 for a in sets]
    root = local_roots(link | np.array([[a == b for b in sets] for a in sets]))
    assert {r.rid: (r.n_links, r.class_rid) for r in got} == {
        i: (link[i].sum() + copies[i], root[i]) for i in range(len(rows))}
    assert lengths == list(range(8, 8 - len(lengths), -1))
    assert all(found < forest.RECALL * links for links, found in seen[:-1]) and seen[-1][0] > 0


def test_groups_of_many_leaders_are_split_without_loss(spark, monkeypatch):
    """Every two leaders of a group meet in some pair of blocks; one task holds two blocks at most."""
    sig = np.arange(400, dtype=np.uint16)[:, None] * np.ones(forest.TREES * forest.DEPTH, np.uint16)
    sig[:, 4:50] = 7                       # a shared start of some trees, and 0.36 of all places
    rows = [(i, s.astype(">u2").tobytes()) for i, s in enumerate(sig)]
    nodes = spark.createDataFrame(rows, "node long, sig binary").repartition(3)
    monkeypatch.setattr(forest, "LEADERS", 25)
    comp = components(forest.loose_edges(nodes, 4)).collect()
    assert len(comp) == 400 and {r.component for r in comp} == {0}


def test_words_of_equal_checksum_are_different_words():
    """"plumless" and "buckeroo" share their 32-bit checksum."""
    assert zlib.crc32(b"plumless") == zlib.crc32(b"buckeroo")
    assert shingles("plumless").tolist() != shingles("buckeroo").tolist()


def test_similar_documents_odd_rows(spark, tmp_path):
    w = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    rows = docs((1, None), (2, ""), (2, " \n"), (3, "x"), (3, "x"), (4, "X  "), (5, "a b c"), (None, w * 20 + " zz"), (7, w * 20 + " zz"))
    d = folder(spark, tmp_path, documents=rows)
    got = defaultdict(set)
    for r in op10_lsh_forest_join(spark, d).collect():
        got[r.doc_id].add((r.class_id, r.n_links))
    assert got[3] == {(3, 2)} and got[4] == {(3, 2)} and got[2] == {(2, 0)} and got[None] == got[7] == {(7, 1)}
    df = spark.createDataFrame(*rows)
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns and kept.count() == 6
    assert drop_near_duplicates(df.limit(0)).count() == 0


def _linked(rows, threshold=0.98):
    """{vec_id: (n_links, component_id)} by brute force for (vec_id, embedding, label), ids distinct."""
    ok = {i: (label, np.array(v, dtype=float)) for i, v, label in rows if v and label is not None and any(v)}
    links = {i: set() for i, _, _ in rows}
    for i, (a, x) in ok.items():
        for j, (b, y) in ok.items():
            if i != j and a == b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                links[i].add(j)
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(links[i]), min(seen))
    return out


def test_vectors_of_everyday_and_mixed_lengths_and_huge_labels(spark):
    from rollcall.llm.neighbours import near_duplicates
    r = np.random.default_rng(3)
    rows = []
    for size, label in ((4096, 0), (4096, 1), (4097, 1), (1, 2), (4095, 1), (3, 2 ** 52), (3, -5), (5, 2 ** 52)):
        for _ in range(4):
            v = r.standard_normal(size)
            rows += [(len(rows), v.tolist(), label), (len(rows) + 1, (v * 2 + r.standard_normal(size) * 0.01).tolist(), label)]
    got = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long"))
    assert {x.vec_id: (x.n_links, x.component_id) for x in got.collect()} == _linked(rows)


def test_saturated_lists_grow(spark):
    from rollcall.llm.neighbours import LIST, enlarged, nodes, search
    r = np.random.default_rng(4)
    centers = r.standard_normal((3, 16))
    v = np.concatenate([c + 0.02 * r.standard_normal((14, 16)) for c in centers] + [r.standard_normal((60, 16))])
    df = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label long")
    _, space = nodes(df)
    lists = search(space, 0.98, 0)
    grown, k = enlarged(lists, space, 0.98)
    assert k == 2 * LIST
    have = grown.filter("sim >= 0.979").groupBy("node").count().collect()
    assert len(have) == 42 and {x["count"] for x in have} == {13}          # the whole cluster is listed
