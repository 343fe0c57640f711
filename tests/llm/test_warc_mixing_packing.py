import base64
import datetime as dt
import gzip
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollcall.llm import mixing, warc
from rollcall.llm.mixing import mix, mixed, op2_pareto_mix, source_targets
from rollcall.llm.packing import SegmentTree, best_fit_plan, chunks, cut, op3_best_fit_packing, pack
from rollcall.llm.warc import op1_warc_round_trip, read_chunks, read_warc, spans, write_warc
from tests.llm.helpers import SF, docs, folder


# -- WARC -------------------------------------------------------------------------

def test_warc_round_trip_of_odd_payloads(spark, tmp_path):
    big = "WARC/1.1\r\nx" * 300 + "é" * 70000 + "WARC/1.1"
    rows = [(1, "u", None), (2, None, ""), (3, "a\r\nb WARC/1.1", big), (4, "u", big), (4, "u", big), (None, "u", "z"),
            (5, "u", "z"), (6, "u", "WARC/1.1"), (7, "u", "x\r\n\r\ny\r\n"), (None, "u", "alone")]
    d = folder(spark, tmp_path, pages=(rows, "page_id long, url string, html string"))
    got = sorted((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0)
                 for r in op1_warc_round_trip(spark, d).collect())
    want, top = [], {}
    for page, _, html in rows:
        top[html or ""] = max(top.get(html or "", -1), page or -1)
    for page, _, html in rows:
        data, last = (html or "").encode(), top[html or ""]
        own = (page or -1) == last
        want.append((page or -1, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                     "response" if own else "revisit", 0 if own else last))
    assert got == sorted(want)


def test_warc_chunks_carry_running_digests_and_damage_is_found(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab" * 50)], "page_id long, url string, html string")
    write_warc(pages, f"{tmp_path}/w", chunk_bytes=30)
    parts = sorted(read_chunks(spark, f"{tmp_path}/w").collect(), key=lambda r: r.chunk)
    assert [len(r.data) for r in parts] == [30, 30, 30, 10]
    seen = b""
    for r in parts:
        seen += bytes(r.data)
        assert r.prefix_digest == base64.b32encode(hashlib.sha1(seen).digest()).decode()
    raw = spark.read.option("lineSep", "WARC/1.1\r\n").text(f"{tmp_path}/w")
    bad = raw.selectExpr("replace(value, 'baba', 'bab_') as value").filter("value <> ''")
    bad.selectExpr("concat('WARC/1.1\r\n', value) as value").write.option("lineSep", "\n").text(f"{tmp_path}/bad")
    with pytest.raises(Exception):
        read_warc(spark, f"{tmp_path}/bad").collect()


def test_warc_min_bytes_empty_table_and_spans(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa")], "page_id long, url string, html string")
    write_warc(pages, f"{tmp_path}/w", min_bytes=3)
    assert {r.record_type for r in read_warc(spark, f"{tmp_path}/w").collect()} == {"response"}
    write_warc(pages.limit(0), f"{tmp_path}/e")
    assert read_warc(spark, f"{tmp_path}/e").count() == 0
    for data in (b"", b"abc", b"WARC/1.1" * 9, b"x" * 25):
        s = spans(memoryview(data), 10)
        assert b"".join(data[a:z] for a, z in s) == data and all(b"WARC/1.1" not in data[a:z] for a, z in s)


# -- mixing -----------------------------------------------------------------------

def _targets(sizes, weights=(1, 2, 3)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        rate = (total - sum(capped.values())) / sum(w[s] for s in free) if free else 0
        over = [s for s in free if w[s] * rate > 3 * sizes[s]]
        if not over:
            return {s: capped.get(s, w[s] * rate) for s in order}
        capped.update({s: 3 * sizes[s] for s in over})


def test_mix_targets_words_and_reruns(spark):
    got = op2_pareto_mix(spark, SF).collect()
    src = {r.doc_id: (r.source, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        s, t = src[r.doc_id]
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        sizes[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
    want = _targets(sizes)
    longest = max(r.size for r in got)
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= longest / 2 + 1
    again = {(r.doc_id, r.taken) for r in op2_pareto_mix(spark, SF).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}


def test_mix_odd_rows(spark, tmp_path):
    rows = docs((1, None, "en", "b"), (2, "", "en", "b"), (3, "a b c", "en", None), (3, "a b c", "en", None),
                (None, "x y", "en", "a"), (5, "p q r s " * 50, "en", "c"))
    d = folder(spark, tmp_path, documents=rows)
    got = op2_pareto_mix(spark, d).collect()
    assert len(got) == 6 and all(r.taken <= 3 * r.size for r in got)
    df = spark.createDataFrame(*rows)
    m = mixed(df)
    assert m.columns == df.columns and m.count() == sum(r.copies for r in mix(df).collect())
    assert mixed(df.limit(0)).count() == 0
    no_words = spark.createDataFrame([("a", 0), ("b", 0)], "source string, source_size long")
    assert {r.target for r in source_targets(no_words).collect()} == {0.0}


def test_texts_without_words_beside_others_of_a_source_with_a_rest(spark, tmp_path):
    rows = [(i, "w " * (i % 7 + 1), "en", "abc"[i % 3]) for i in range(300)]
    rows += [(1000 + i, (None, "", " \n")[i % 3], "en", (*"abc", None)[i % 4]) for i in range(24)]
    d = folder(spark, tmp_path, documents=docs(*rows))
    got = {r.doc_id: r for r in op2_pareto_mix(spark, d).collect()}
    source, sizes, taken = {r[0]: r[3] for r in rows}, Counter(), Counter()
    for i, r in got.items():
        sizes[source[i]] += r.size
        taken[source[i]] += r.taken
    want = _targets(dict(sizes))
    assert len(got) == len(rows) and any(want[s] % sizes[s] for s in "abc")
    assert all(got[i].size == got[i].taken == 0 for i in got if i >= 1000)
    assert all(abs(taken[s] - want[s]) <= 7 / 2 + 1e-6 for s in want)
    copies = {r[mixing.ROW].doc_id: r.copies for r in mix(spark.createDataFrame(*docs(*rows))).collect()}
    assert all(copies[i] == (want[s] // sizes[s] if sizes[s] else 0) for i, s in source.items() if i >= 1000)


def test_texts_are_read_in_small_batches_and_other_tables_as_before(spark, tmp_path, monkeypatch):
    key, seen, write = "spark.sql.parquet.columnarReaderBatchSize", {}, mixing.materialize

    def watch(df, name):
        seen[name] = int(spark.conf.get(key))
        return write(df, name)

    monkeypatch.setattr(mixing, "materialize", watch)
    before = int(spark.conf.get(key))
    d = folder(spark, tmp_path, documents=docs((1, "a b", "en", "x"), (2, "c " * 300000, "en", "x"), (3, "d", "en", "y")))
    assert {r.doc_id: r.size for r in op2_pareto_mix(spark, d).collect()} == {1: 2, 2: 300000, 3: 1}
    assert seen["mix-docs"] <= 256 < before == int(spark.conf.get(key)) == seen["mix-ranked"]


def test_many_sources_are_not_broadcast(spark, tmp_path, monkeypatch):
    left = spark.createDataFrame([("s1",), (None,)], "source string")
    few = spark.createDataFrame([("s1", 1.0), (None, 2.0)], "source string, k double")
    many = spark.range(200000).selectExpr("concat('s', id) as source", "double(id) as k")
    hint = {n: "strategy=broadcast" in mixing._join(left, r)._jdf.queryExecution().analyzed().toString()
            for n, r in (("few", few), ("many", many))}
    assert hint == {"few": True, "many": False}
    rows = [(i, "w " * (i % 5 + 1), "en", (None, "a", "b", "c")[i % 4]) for i in range(200)]
    d = folder(spark, tmp_path, documents=docs(*rows))
    want = sorted(map(tuple, op2_pareto_mix(spark, d).collect()))
    monkeypatch.setattr(mixing, "SOURCE_BYTES", 0)
    assert sorted(map(tuple, op2_pareto_mix(spark, d).collect())) == want


def test_longer_documents_are_drawn_more_often(spark):
    df = spark.range(2000).selectExpr("id as doc_id", "repeat('w ', if(id % 2 = 0, 3, 200)) as text", "'s' as source")
    m = mix(df, share=0.3).groupBy("size").avg("copies").collect()
    p = {r[0]: r[1] for r in m}
    assert 0 < p[3] < p[200] < 1


# -- packing ----------------------------------------------------------------------

def _one_by_one(items, cap):
    bins = []
    for n in sorted(items, reverse=True):
        fit = [i for i, r in enumerate(bins) if r >= n]
        if fit:
            bins[min(fit, key=lambda i: bins[i])] -= n
        else:
            bins.append(cap - n)
    return sorted(bins)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(150):
        cap = rng.choice([10, 50, 1024])
        items = [rng.randint(1, cap) for _ in range(rng.randint(0, 150))]
        used = defaultdict(int)
        for n, lo, hi, first, per, off in best_fit_plan(Counter(items), cap).tolist():
            for i in range(lo, hi):
                b, slot = divmod(i - lo, per)
                assert used[first + b] == off + slot * n
                used[first + b] += n
        assert sorted(cap - u for u in used.values()) == _one_by_one(items, cap)


def test_segment_tree_finds_the_tightest():
    rng, tree, have = random.Random(2), SegmentTree(100), set()
    for _ in range(500):
        x = rng.randint(0, 100)
        (have.discard if x in have else have.add)(x)
        tree.set(x, x in have)
        q = rng.randint(0, 100)
        assert tree.tightest(q) == min((h for h in have if h >= q), default=None)


def test_packed_pieces_match_the_tokeniser(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = docs((1, None), (2, ""), (3, "a  b   c"), (3, "a  b   c"), (None, "x"), (4, "word " * 5000), (5, "y" * 30000),
                (6, "²½ ٣ don't 's foo, bar!! <|endoftext|> \n \n z"))
    d = folder(spark, tmp_path, documents=rows)
    got = op3_best_fit_packing(spark, d).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for doc, text in {r[0]: r[1] for r in rows[0]}.items():
        ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
        parts = sorted(by[doc], key=lambda r: r.piece)
        if doc != 3:
            assert [(r.start, r.length) for r in parts] == cut(len(ids), 1024)
        for r in parts:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes())
    assert len(by[3]) == 2
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for off, n in sorted(s):
            assert off == at
            at += n
        assert at <= 1024
    empty = spark.createDataFrame([], "length long, tag string")
    assert pack(empty).columns == ["length", "tag", "sequence_id", "offset"] and pack(empty).count() == 0
    with pytest.raises(ValueError):
        pack(spark.createDataFrame([(2000,)], "length long"))


def test_chunks_join_to_the_text():
    rng = random.Random(3)
    for _ in range(500):
        x = "".join(rng.choice(" \n\tab,é　\x1c") for _ in range(rng.randint(0, 12)))
        assert "".join(chunks(x)) == x


def _ids(encode, text):
    return np.frombuffer(encode(text), "<u4").tolist()


def test_chunk_ids_are_the_tokenisers():
    """Random texts of awkward signs, also while hardly any chunk can be kept."""
    import public_tokenizers
    from rollcall.llm.packing import ChunkEncoder
    signs = [*" \n\n\t\r\x0b\x1c\x85\xa0\u3000\u2028aéßĠĊ.,-_(½٣1'\u0301\u200d", "The", "word", "日本", "'s", "!!", "***",
             "23", "<|endoftext|>", "\U0001F600"]
    rng = random.Random(4)
    for most in (1000, 5):
        encode = ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"))
        encode.cache.most = most
        for _ in range(3000):
            text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 14)))
            assert _ids(encode, text) == encode.tok.encode(text, add_special_tokens=False).ids, text
            assert len(encode.cache) <= most and len(encode.cache.older) <= most


def test_known_chunks_cost_no_python_step():
    """Lines and words whose ids are at hand are looked up without a call for each."""
    import sys

    import public_tokenizers
    from rollcall.llm.packing import ChunkEncoder
    encode = ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    text = "\n".join(f"Some words, {i % 9} of them." for i in range(500))
    want = encode(text)
    steps = []
    before = sys.getprofile()
    sys.setprofile(lambda frame, event, arg: steps.append(event))
    try:
        got = encode(text)
    finally:
        sys.setprofile(before)
    assert got == want and len(steps) < 50


def test_a_payload_is_cut_and_hashed_without_a_copy():
    import tracemalloc

    import pyarrow as pa

    from rollcall.llm.warc import CHUNK_BYTES, VERSION, running_digests, spans
    data = bytearray(b"x" * (16 << 20))
    marks = [0, CHUNK_BYTES - 4, 2 * CHUNK_BYTES - 1, 3 * CHUNK_BYTES, len(data) - len(VERSION)]
    for at in marks:
        data[at:at + len(VERSION)] = VERSION.encode()
    view = memoryview(pa.py_buffer(bytes(data)))
    tracemalloc.start()
    parts = spans(view, CHUNK_BYTES)
    digests = running_digests(view, parts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1 << 20
    assert [p[0] for p in parts] == [0, *[p[1] for p in parts[:-1]]] and parts[-1][1] == len(data)
    assert {at + 5 for at in marks} <= {hi for _, hi in parts} and max(hi - lo for lo, hi in parts) <= CHUNK_BYTES
    assert digests[-1] == base64.b32encode(hashlib.sha1(data).digest()).decode() and len(digests) == len(parts)


def test_rows_of_one_rank_are_split_by_a_second_number(spark):
    """A large equal group is cut to the nearest word; hardly any of its rows meet in one task."""
    rows = spark.range(30_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one two three").alias("text"),
                                      F.when(F.col("id") % 3 == 0, F.lit("a")).otherwise(F.lit("b")).alias("source"))
    got = {r.source: r for r in mixing.mix(rows, weights=(1, 3)).groupBy("source").agg(
        F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect()}
    assert all(abs(r.taken - r.target) <= 1.5 for r in got.values()) and len(got) == 2

    equal = spark.range(30_000).select(F.lit("a").alias("source"), F.lit(3).cast("long").alias("size"),
                                       mixing._tie("id").alias("tie"))
    state = spark.createDataFrame([("a", 40_000.0, 0)], "source string, rest double, before long")
    left, _ = mixing._narrow(equal, state, "tie")
    assert 1 <= left.count() <= 5


def test_draw_against_brute_force(spark):
    """The rows drawn are those of lowest rank, by the formula, up to the words nearest the rest."""
    rng = np.random.default_rng(9)
    data = [(i, " ".join(["w"] * int(rng.integers(1, 60))), "ab"[int(rng.integers(0, 2))]) for i in range(400)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = mixing.mix(df).select("__row.doc_id", "source", "size", "source_size", "target", "copies",
                                mixing.uniform(F.lit(mixing.SEED), F.col("__row.doc_id"), F.xxhash64("__row.text")).alias("u")).collect()
    for source in "ab":
        rows = [r for r in got if r.source == source]
        size, u = np.array([r["size"] for r in rows], float), np.array([r.u for r in rows])
        whole = int(rows[0].target // rows[0].source_size)
        rest = rows[0].target - whole * rows[0].source_size
        w, k = np.log2(1 + size), 0.0
        for _ in range(200):
            sure = k * w >= 1
            k = (rest - size[sure].sum()) / (size * w)[~sure].sum() if rest > 0 else 0.0
        p = np.minimum(1, k * w)
        odds = u / (1 - u) * (1 - p) / np.where(p > 0, p, 1)
        order = np.argsort(odds / (1 + odds))
        total = np.concatenate([[0], np.cumsum(size[order])])
        n = int(np.argmin(np.abs(total - rest))) if rest > 0 else 0
        assert [r.copies - whole for r in rows] == [int(i in set(order[:n].tolist())) for i in range(len(rows))]


def test_archives_hold_the_fields_the_format_asks_for(spark, tmp_path):
    """Read by a parser of its own: version line, header lines, a blank line, a block of the stated length."""
    pages = spark.createDataFrame([(1, "http://x/1", "a" * 2500), (2, "http://x/2", "b"), (3, None, "b")],
                                  "page_id long, url string, html string")
    warc.write_warc(pages, str(tmp_path / "w"), chunk_bytes=1000)
    records = []
    for f in sorted((tmp_path / "w").glob("*.gz")):
        data = gzip.decompress(f.read_bytes())
        while data:
            head, data = data.split(b"\r\n\r\n", 1)
            version, *lines = head.decode().split("\r\n")
            fields = dict(x.split(": ", 1) for x in lines)
            n = int(fields["Content-Length"])
            assert version == "WARC/1.1" and data[n:n + 4] == b"\r\n\r\n"
            records.append(fields)
            data = data[n + 4:]
    assert len(records) == 5
    for f in records:
        assert {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= set(f)
        assert dt.datetime.strptime(f["WARC-Date"], "%Y-%m-%dT%H:%M:%SZ")
    totals = {f["WARC-Segment-Number"]: f.get("WARC-Segment-Total-Length") for f in records if "WARC-Segment-Number" in f}
    assert totals == {"1": None, "2": None, "3": "2500"}
