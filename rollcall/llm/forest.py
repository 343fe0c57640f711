"""N-gram Jaccard join by a MinHash LSH forest, verified exactly.

A text is the set of its five-word shingles; texts with equal sets are one node with a
count. Its signature is ``TREES`` paths of ``DEPTH`` minhashes, two bytes each, so each tree's
trie is the nodes sorted by their path, and a trie node is a prefix of it. Two nodes match
when their paths share a prefix in some tree. The prefix starts at the length at which a
pair at the threshold matches with the target recall; then the recall is measured and
the prefix shortened by a minhash until the measured recall holds, too. It is measured
on about ``AUDIT`` rows, whose exact links with all others are found while the signatures
are made.

Nodes that share a prefix are never paired all with all. They stream in path order past a
list of leaders: a node joins every leader whose signature is loosely like its own, and
leads itself unless one is close. Groups are first split by a salt; the leaders of the
parts then meet, in pairs of blocks where a group has very many. What comes out is at most
one edge a node, tree and block. Connected nodes form loose groups that hold every pair at the
threshold (up to the target recall); inside them the shingle sets are compared exactly,
block by block, which gives the number of links and the final classes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm.common import RID, ROW, arrow_rows, materialize, packed, small, table, uniform, unpacked, with_rid
from rollcall.llm.graph import components, groups, local_roots

SHINGLE = 5
THRESHOLD = 0.8
TREES = 16
DEPTH = 8
RECALL = 0.999
CLOSE = 0.8                   # signature likeness at which a leader stands for a node
LOOSE = 0.3                   # ... at which node and leader are in one group
SALTS = 8
LEADERS = 1024                # leaders of a group that meet in one task
AUDIT = 256                   # rows the recall is measured on, about
AUDIT_CHARS = 65536           # ... of at most so many characters
BLOCK = 256
_COLUMNS = 8192
_P = np.uint64(0x100000001B3)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed_bits(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word runs of a text, A-Z lower-cased; a shorter
    text is one run of all its words, a text without words has none."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = min(n, len(w))
    h = np.zeros(len(w) - n + 1, np.uint64)
    for j in range(n):
        h = h * _P + w[j:len(w) - n + 1 + j]
    return np.unique(mixed_bits(h + np.uint64(n)))


def signature(s: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    out = np.full(len(mul), np.iinfo(np.uint32).max, np.uint32)
    for lo in range(0, len(s), 4096):
        h = ((s[lo:lo + 4096, None] * mul + add) >> np.uint64(32)).astype(np.uint32)
        out = np.minimum(out, h.min(axis=0))
    return out


def hash_family(size: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda: rng.integers(0, 2 ** 63, size, dtype=np.uint64)
    return draw() * np.uint64(2) + np.uint64(1), draw()


def depth_for(recall: float = RECALL, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix at which a pair at the threshold matches in some trie with ``recall``;
    where the measured recall starts."""
    while depth > 1 and 1 - (1 - threshold ** depth) ** trees < recall:
        depth -= 1
    return depth


_SETS = "rid long, size long, h1 long, h2 long, sig binary, near array<int>"


def _lists(xs: list[np.ndarray]) -> pa.ListArray:
    at = np.concatenate([[0], np.cumsum([len(x) for x in xs])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(xs)))


def short(sig: np.ndarray) -> np.ndarray:
    """Half of each minhash (chance equals 1 in 65536), high byte first, so bytes sort as paths."""
    return sig.astype(np.uint16).astype(">u2")


def audit_rows(rows: DataFrame, about: int = AUDIT) -> list[tuple[int, np.ndarray]]:
    """(rid, shingle set) of about ``about`` rows of (rid, text), at most twice as many."""
    rate = about / max(rows.count(), 1)
    drawn = rows.filter(uniform(F.lit(11), F.col("rid")) < F.lit(rate)).filter(F.length("text") <= AUDIT_CHARS)
    sets = [(r["rid"], shingles(r["text"])) for r in drawn.limit(2 * about).collect()]
    return [(rid, s) for rid, s in sets if len(s)]


def shingle_sets(rows: DataFrame, asked: list[np.ndarray], threshold: float) -> DataFrame:
    """One row per row (rid, text): set key (null without words), signature, and which of the
    sets ``asked`` its own is linked with, equal ones left out. The sets themselves are
    not kept: they are larger than the text."""
    mul, add = hash_family(TREES * DEPTH)
    probes = [short(signature(s, mul, add)) for s in asked]
    probes = np.stack(probes) if probes else np.zeros((0, TREES * DEPTH), ">u2")
    shared = rows.sparkSession.sparkContext.broadcast((probes, asked))
    loose = threshold - 0.2          # over four standard errors below the threshold

    def linked(s, sig):
        probes, asked = shared.value
        out = []
        for i in np.flatnonzero(np.count_nonzero(probes == sig, axis=1) >= loose * len(sig)).tolist():
            a, z = (s, asked[i]) if len(s) < len(asked[i]) else (asked[i], s)
            if threshold * len(z) <= len(a):
                common = int((z[np.minimum(np.searchsorted(z, a), len(z) - 1)] == a).sum())
                either = len(a) + len(z) - common
                if common < either and common >= threshold * either - 1e-9:
                    out.append(i)
        return np.array(out, np.int32)

    def run(batches):
        for b in batches:
            size, h1, h2, sigs, near = [], [], [], [], []
            for t in b.column(1).to_pylist():
                s = shingles(t)
                size.append(len(s))
                if len(s):
                    sig = short(signature(s, mul, add))
                    h1.append(int(mixed_bits(s).sum().astype(np.int64)))
                    h2.append(int(np.bitwise_xor.reduce(mixed_bits(s * _P)).astype(np.int64)))
                    sigs.append(sig.tobytes())
                    near.append(linked(s, sig))
                else:
                    for c in (h1, h2, sigs):
                        c.append(None)
                    near.append(np.zeros(0, np.int32))
            if size:
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(size, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()),
                     pa.array(sigs, pa.binary()), _lists(near)], names=[c.split()[0] for c in _SETS.split(", ")])

    arrow_rows(rows.sparkSession, 256)
    return rows.mapInArrow(run, _SETS)


def with_shingles(rows: DataFrame) -> DataFrame:
    """(group, blocks, node, n, text) with the text's shingle set instead of the text."""
    def run(batches):
        for b in batches:
            sets = [shingles(t).astype(np.int64) for t in b.column("text").to_pylist()]
            if sets:
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], _lists(sets)], names=[*kept, "shingles"])

    kept = ["group", "blocks", "node", "n"]
    return rows.select(*kept, "text").mapInArrow(run, "group long, blocks int, node long, n long, shingles array<long>")


class Leaders:
    """Leader clustering of streamed signatures; ``edges`` spans what is loosely alike."""

    def __init__(self):
        self.sigs = np.zeros((64, TREES * DEPTH), np.uint16)
        self.ids: list[int] = []
        self.root: list[int] = []          # position of each leader's root
        self.edges: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def add(self, node: int, sig: np.ndarray) -> bool:
        """Whether ``node`` became a leader."""
        like = (self.sigs[:len(self.ids)] == sig).mean(axis=1) if self.ids else np.zeros(0)
        near = np.flatnonzero(like >= LOOSE)
        roots = sorted({self.find(int(i)) for i in near})
        for r in roots[1:]:
            self.edges.append((self.ids[r], self.ids[roots[0]]))
            self.root[r] = roots[0]
        if roots:
            self.edges.append((node, self.ids[roots[0]]))
        if len(like) and like.max() >= CLOSE:
            return False
        if len(self.ids) == len(self.sigs):
            self.sigs = np.vstack([self.sigs, np.zeros_like(self.sigs)])
        self.sigs[len(self.ids)] = sig
        self.root.append(roots[0] if roots else len(self.ids))
        self.ids.append(node)
        return True


_MATCH = "node long, leader long, tree long, path binary, sig binary"


def _cluster(keys: list[str]):
    """Streams rows sorted by ``keys`` through :class:`Leaders`, one group after the other;
    edges have no path, leaders have theirs and their signature."""
    def run(batches):
        key, leaders, out = None, Leaders(), []

        def flush(rows):
            cols = list(zip(*rows))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                              names=["node", "leader", "tree", "path", "sig"])

        for b in batches:
            cols = [b.column(k).to_pylist() for k in keys]
            for at, (node, sig) in enumerate(zip(b.column("node").to_pylist(), b.column("sig").to_pylist())):
                now = tuple(c[at] for c in cols)
                if now != key:
                    out += [(a, z, None, None, None) for a, z in leaders.edges]
                    key, leaders = now, Leaders()
                if leaders.add(node, np.frombuffer(sig, np.uint16)):
                    out.append((node, None, now[0], now[1], sig))
                if len(out) > 4000:
                    yield flush(out)
                    out = []
        out += [(a, z, None, None, None) for a, z in leaders.edges]
        if out:
            yield flush(out)

    return run


def path(tree, length: int):
    """The first ``length`` minhashes of a signature's path in ``tree`` (a column, from 0)."""
    return F.substring(F.col("sig"), (tree * F.lit(2 * DEPTH) + F.lit(1)).cast("int"), F.lit(2 * length))


def loose_edges(nodes: DataFrame, length: int) -> DataFrame:
    """(a, b): spanning edges of the nodes (node, sig) that share a prefix of ``length`` in some trie."""
    # Places first, without signatures: most nodes share no prefix with another.
    trees = F.sequence(F.lit(0), F.lit(TREES - 1))
    at = nodes.select("node", F.posexplode(F.transform(trees, lambda t: path(t, length))).alias("tree", "path"))
    shared = at.groupBy("tree", "path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("tree", "path")
    members = materialize(at.join(shared, ["tree", "path"]), "forest-members")
    sigs = nodes.select("node", "sig").join(members.select("node").distinct(), "node", "left_semi")
    rows = members.join(sigs, "node").select(
        F.col("tree").cast("long").alias("tree"), "path", F.pmod(F.xxhash64("node", "tree"), F.lit(SALTS)).alias("salt"),
        "node", "sig")
    parts = rows.repartition("tree", "path", "salt").sortWithinPartitions(
        "tree", "path", "salt", path(F.col("tree"), DEPTH))
    first = materialize(parts.mapInArrow(_cluster(["tree", "path", "salt"]), _MATCH), "forest-leaders")
    heads = first.filter("leader is null").select("tree", "path", "node", "sig")
    met = heads.groupBy("tree", "path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        "tree", "path", F.ceil(F.col("n") / F.lit(LEADERS)).cast("int").alias("blocks"))
    heads = heads.join(met, ["tree", "path"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = heads.select("tree", "path", "node", "sig", "block",
                         F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")).select(
        "tree", "path", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "node", "sig")
    second = (pairs.repartition("tree", "path", "i", "j").sortWithinPartitions("tree", "path", "i", "j")
              .mapInArrow(_cluster(["tree", "path", "i", "j"]), _MATCH))
    return first.unionByName(second).filter("leader is not null").select(F.col("node").alias("a"), F.col("leader").alias("b"))


def audit(nodes: DataFrame, loose: DataFrame, asked: DataFrame) -> tuple[int, int]:
    """Links of the audited nodes ``asked`` (i, node), and how many lie inside a loose group."""
    homes = asked.join(loose, "node").select("i", F.col("component").alias("home"))
    links = nodes.filter(F.size("near") > 0).join(loose, "node", "left").select("component", F.explode("near").alias("i"))
    r = links.join(F.broadcast(homes), "i", "left").agg(         # at most 2 * AUDIT rows
        F.count(F.lit(1)), F.count(F.when(F.col("component") == F.col("home"), 1))).first()
    return int(r[0]), int(r[1])


def set_links(grouped: DataFrame, threshold: float) -> DataFrame:
    """(node, links, root) from (group, blocks, node, n, shingles): every pair of a group
    compared exactly, in blocks; no pair is emitted."""
    rows = grouped.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = rows.select("group", "node", "n", "shingles", "block",
                        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")).select(
        "group", F.least("block", "o").cast("long").alias("i"), F.greatest("block", "o").cast("long").alias("j"),
        "node", "n", "shingles", "block")

    def compare(batches):
        for t in groups(batches, ["group", "i", "j"]):
            i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
            ids, n, side = t.column("node").to_numpy(), t.column("n").to_numpy(), t.column("block").to_numpy()
            sets = t.column("shingles").combine_chunks()
            size = np.diff(sets.offsets.to_numpy())
            flat = sets.flatten().to_numpy()
            owner = np.repeat(np.arange(len(ids)), size)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            new = np.concatenate([[True], flat[1:] != flat[:-1]])
            col = np.cumsum(new) - 1
            often = np.bincount(col) > 1
            keep = often[col]
            col, owner = (np.cumsum(often) - 1)[col[keep]], owner[keep]
            common = np.zeros((len(ids), len(ids)))
            for lo in range(0, int(often.sum()), _COLUMNS):
                a, z = np.searchsorted(col, [lo, lo + _COLUMNS])
                m = np.zeros((len(ids), min(_COLUMNS, int(often.sum()) - lo)), np.float32)
                m[owner[a:z], col[a:z] - lo] = 1
                common += m @ m.T
            either = size[:, None] + size[None, :] - common
            linked = common >= threshold * either - 1e-9
            np.fill_diagonal(linked, False)
            if i != j:
                linked &= side[:, None] != side[None, :]
            root = local_roots(linked)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(linked @ n), pa.array(ids[root])],
                                             names=["node", "links", "root"])

    arrow_rows(grouped.sparkSession, 256)
    dealt = pairs.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j")
    return dealt.mapInArrow(compare, "node long, links long, root long")


def classes(rows: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, start: int | None = None) -> DataFrame:
    """(rid, copy_rid, class_rid, n_links) of every row (rid, text) of a stored table: the
    smallest rid with the same set, the smallest in the class, and the other rows linked.
    ``start``: length of the first prefix (default: :func:`depth_for`)."""
    asked = audit_rows(rows)
    sets = materialize(shingle_sets(rows, [s for _, s in asked], threshold), "forest-sets")
    lean = sets.select("rid", "size", "h1", "h2")
    copies = materialize(lean.filter("size > 0").groupBy("h1", "h2", "size").agg(
        F.min("rid").alias("node"), F.count(F.lit(1)).alias("n")), "forest-nodes")
    nodes = sets.select(F.col("rid").alias("node"), "sig", "near").join(copies.select("node"), "node", "left_semi")
    spark = rows.sparkSession
    drawn = F.broadcast(spark.createDataFrame([(i, rid) for i, (rid, _) in enumerate(asked)], "i int, rid long"))
    probes = materialize(lean.join(drawn, "rid").join(copies, ["h1", "h2", "size"]).select("i", "node"), "forest-asked")
    length, edges = start or depth_for(recall, threshold), None
    while True:
        more = loose_edges(nodes.select("node", "sig"), length)
        edges = more if edges is None else edges.unionByName(more)
        loose = components(edges)
        links, found = audit(nodes, loose, probes)
        if found >= recall * links:
            break
        if length == 1:
            raise RuntimeError(f"LSH forest: {found} of {links} audited links found with the shortest prefix, target {recall}")
        length -= 1
    wanted = copies.select("node", "n").join(loose.withColumnRenamed("component", "group"), "node")
    blocks = wanted.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks"))
    wanted = materialize(wanted.join(blocks, "group"), "forest-wanted")
    grouped = with_shingles(rows.join(small(wanted), F.col("rid") == F.col("node")))
    part = materialize(set_links(grouped, threshold), "forest-links")
    comp = components(part.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = part.groupBy("node").agg(F.sum("links").alias("links"))
    full = (copies.join(links, "node", "left").join(comp, "node", "left").select(
        "h1", "h2", "size", "node", F.coalesce("component", "node").alias("class"),
        (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links")))
    out = lean.join(full, ["h1", "h2", "size"], "left")
    return out.select("rid", F.coalesce("node", "rid").alias("copy_rid"), F.coalesce("class", "rid").alias("class_rid"),
                      F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def drop_near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the first row of each class only. Rows without words all stay."""
    full = materialize(with_rid(packed(docs)), "forest-docs")
    found = classes(full.select(F.col(RID).alias("rid"), F.col(f"{ROW}.`{text}`").cast("string").alias("text")))
    gone = found.filter("class_rid <> rid").select(F.col("rid").alias("__gone"))
    kept = full.join(small(gone), F.col(RID) == F.col("__gone"), "left_anti")
    return unpacked(kept, docs.columns)


def op10_lsh_forest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` at a Jaccard similarity of 0.8 of five-word shingles: one row per
    document with its class (smallest doc_id), the smallest doc_id of equal shingle sets,
    and the number of other documents linked directly.

    A text without words links with nothing. Repeated rows link with each other. A null
    doc_id names a class only if no other row of it has an id.
    """
    docs = table(spark, sf_dir, "documents")
    ids = materialize(docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"),
                                  F.col("text").cast("string").alias("text")), "forest-docs")
    found = materialize(classes(ids.select("rid", "text")), "forest-result").join(ids.select("rid", "doc_id"), "rid")
    # Only rows with a link need a name from others: few enough to be sent, as a rule.
    def name(key: str, out: str) -> DataFrame:
        names = found.filter("n_links > 0").groupBy(key).agg(F.min("doc_id").alias(out))
        return small(materialize(names, "forest-names"))

    out = found.join(name("class_rid", "class_id"), "class_rid", "left").join(name("copy_rid", "copy_id"), "copy_rid", "left")
    linked = F.col("n_links") > 0
    out = out.withColumn("class_id", F.when(linked, F.col("class_id")).otherwise(F.col("doc_id")))
    out = out.withColumn("copy_id", F.when(linked, F.col("copy_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "class_id", "copy_id", "n_links", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


# Shingle sets as lists of text, links by counting common shingles, classes by following them.
OP10_SQL = f"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id::BIGINT AS doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT r, doc_id, list_sort(list_distinct(CASE WHEN len(w) BETWEEN 1 AND {SHINGLE - 1} THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' ')) END)) AS s FROM w),
k AS (SELECT r, doc_id, CASE WHEN len(s) > 0 THEN md5(array_to_string(s, chr(10))) ELSE 'row ' || r END AS k, s FROM s),
node AS (SELECT k, min(r) AS node, min(doc_id) AS copy_id, count(*) AS n, any_value(s) AS s FROM k GROUP BY k),
part AS (SELECT node, len(s) AS size, unnest(s) AS x FROM node WHERE len(s) > 0),
pair AS (SELECT a.node AS a, b.node AS b FROM part a JOIN part b ON a.x = b.x AND a.node <> b.node
         GROUP BY a.node, b.node, a.size, b.size HAVING 5 * count(*) >= 4 * (a.size + b.size - count(*))),
reach(node, t) AS (SELECT node, node FROM node UNION SELECT reach.node, pair.b FROM reach JOIN pair ON reach.t = pair.a),
class AS (SELECT reach.node, min(node.copy_id) AS class_id FROM reach JOIN node ON reach.t = node.node GROUP BY reach.node),
near AS (SELECT pair.a AS node, sum(node.n) AS links FROM pair JOIN node ON pair.b = node.node GROUP BY pair.a)
SELECT k.doc_id, class_id, copy_id, (n - 1 + coalesce(links, 0))::BIGINT AS n_links, k.doc_id IS NOT DISTINCT FROM class_id AS kept
FROM k JOIN node USING (k) JOIN class USING (node) LEFT JOIN near USING (node)
"""
