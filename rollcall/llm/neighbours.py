"""Near-duplicate vectors by NN-descent, with exact links.

Equal vectors of one label are one node with a count. The neighbour graph starts from
sorted random projections (each row against the rows next to it) and is refined as
NN-descent does: for every node the lists that name it and the nodes it lists are
brought together, and pairs nearer than a member's worst neighbour enter its list, until
few lists change. A list whose members all pass the threshold is saturated: it may
miss some, also the only ones to another dense cluster. Lists of saturated nodes are doubled
and refined again until their worst entry falls below the threshold or they are ``LONGEST``. Nor
does that show another cluster beside a dense one: so each saturated node hands over to the
node of least hash among itself and its list, and these few are searched in the same
way, level by level until no list is saturated. A node carries the widest angle to those it
stands for, and two of them are in one group when the nodes they stand for may pass the
threshold. Then blocks of each connected group are compared (``BLOCK`` nodes a side, bounded
work a step) in double precision; these comparisons give the links, so none is below the
threshold.
The number of starts follows from the rows of the largest label, so that a pair at the
threshold meets in some start with chance ``MEET``. An audit compares a fixed number of nodes with
all others by brute force; while its recall is below ``TARGET``, further starts are merged in
and refined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm.common import arrow_rows, materialize, table
from rollcall.llm.graph import components, groups, local_roots

THRESHOLD = 0.98
LIST = 8                      # neighbours kept by a node
LONGEST = 32                  # neighbours kept by a node whose list is saturated
WINDOW = 64                   # rows compared on each side at the start
ROUNDS = 3
STOP = 0.01                   # lists changed, as a share of the nodes
AUDIT = 1024                  # nodes that the audit draws from all, and again from those near others
CLOSE = 0.05                  # a neighbour so much below the threshold is near
TARGET = 0.99
MEET = 0.999
TRIES = 6
BLOCK = 512
_SPACE = ("label", "size")    # only vectors of one label and length can link
_SLACK = 1e-4                 # single precision in the search, double in the links


def nodes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with their node key or null, nodes). Equal vectors of a label are counted
    before the shuffle. Vectors of another length never link: their keys differ."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("v", lambda x: x != 0)
    ok = F.coalesce(F.col("label").isNotNull() & ~bad & some, F.lit(False))
    key = [F.when(ok, F.xxhash64(F.lit(s), F.col("label"), F.size("v"), F.col("v"))) for s in (1, 2)]
    rows = rows.select("vec_id", "label", "v", key[0].alias("h1"), key[1].alias("h2"))
    kept = rows.filter("h1 is not null").groupBy("h1", "h2").agg(
        F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"), F.first("label").alias("label"), F.first("v").alias("v"))
    # Scaled so that any finite vector has a norm, also in single precision.
    kept = kept.withColumn("m", F.array_max(F.transform("v", lambda x: F.abs(x)))).withColumn(
        "v", F.transform("v", lambda x: x / F.col("m"))).drop("m")
    kept = kept.select(F.monotonically_increasing_id().alias("node"), "*", F.size("v").cast("long").alias("size"))
    return rows.drop("v"), materialize(kept, "nn-nodes")


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = np.asarray(flat.flatten(), dtype=np.float64).reshape(len(flat), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _rows(names_kinds, cols):
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, names_kinds)],
                                      names=[n for n, _ in names_kinds])


_EDGE = (("node", pa.int64()), ("nbr", pa.int64()), ("sim", pa.float32()))
_EDGE_SCHEMA = "node long, nbr long, sim float"


def _top(ids: np.ndarray, sims: np.ndarray, k: int, floor: np.ndarray):
    """Edges of the k nearest others of each row whose similarity passes the row's floor."""
    s = sims.copy()
    np.fill_diagonal(s, -2)
    k = min(k, len(ids) - 1)
    at = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < len(ids) - 1 else np.argsort(-s, axis=1)[:, :k]
    val = np.take_along_axis(s, at, axis=1)
    ok = val > floor[:, None]
    return np.repeat(ids, ok.sum(axis=1)), ids[at[ok]], val[ok]


def bits_for(rows: int) -> int:
    """Signs of a code that leaves about ``WINDOW`` of ``rows`` with each value."""
    return min(60, max(0, int(np.ceil(np.log2(rows / WINDOW + 1)))))


def starts_for(rows: int, threshold: float = THRESHOLD, recall: float = MEET) -> int:
    """Starts after which a pair at the threshold has shared a code with chance ``recall``."""
    miss = 1 - (1 - np.arccos(threshold) / np.pi) ** bits_for(rows)
    return max(1, int(np.ceil(np.log(1 - recall) / np.log(miss)))) if miss > 0 else 1


def start_lists(space: DataFrame, seed: int, bits: int, k: int = LIST) -> DataFrame:
    """First neighbours: rows in the order of a random sign code of ``bits`` and a projection,
    each block of rows of one label compared within itself and with half of the block before."""
    def code(batches):
        for b in batches:
            size = b.column("size").to_numpy()
            out_code, out_proj = np.zeros(len(size), np.int64), np.zeros(len(size))
            for d in np.unique(size):
                at = size == d
                planes = np.random.default_rng(seed).standard_normal((int(d), bits + 1))
                p = _matrix(b.column("v").filter(pa.array(at))) @ planes
                out_code[at], out_proj[at] = ((p[:, :bits] > 0) << np.arange(bits)).sum(axis=1), p[:, bits]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("node", *_SPACE)), pa.array(out_code), pa.array(out_proj),
                                              b.column("v")], names=["node", *_SPACE, "code", "proj", "v"])

    def near(batches):
        for ids, x in _blocks(batches):
            if len(ids) > 1:
                yield _rows(_EDGE, _top(ids, x @ x.T, k, np.full(len(ids), -1.0)))

    coded = space.select("node", *_SPACE, "v").mapInArrow(
        code, "node long, label long, size long, code long, proj double, v array<double>")
    dealt = coded.repartitionByRange(*_SPACE, "code", "proj").sortWithinPartitions(*_SPACE, "code", "proj")
    return dealt.mapInArrow(near, _EDGE_SCHEMA)


def _spaces(b: pa.RecordBatch):
    """((label, size), its rows) of a batch, in order of appearance."""
    label, size = (b.column(c).to_numpy() for c in _SPACE)
    for value in dict.fromkeys(zip(label.tolist(), size.tolist())):
        yield value, b.filter(pa.array((label == value[0]) & (size == value[1])))


def _blocks(batches):
    """Sliding blocks of 2 * WINDOW rows of one label and size, half of each shared with the next."""
    ids, vecs, space = np.zeros(0, np.int64), None, None
    for b in batches:
        for value, part in _spaces(b):
            i, x = part.column("node").to_numpy(), _matrix(part.column("v")).astype(np.float32)
            if value == space:
                i, x = np.concatenate([ids, i]), np.concatenate([vecs, x])
            elif len(ids):
                yield ids, vecs
            lo = 0
            while lo + 2 * WINDOW <= len(i):
                yield i[lo:lo + 2 * WINDOW], x[lo:lo + 2 * WINDOW]
                lo += WINDOW
            ids, vecs, space = i[lo:], x[lo:], value
    if len(ids):
        yield ids, vecs


def best(edges: DataFrame, k: int = LIST) -> DataFrame:
    """The k nearest distinct neighbours of each node."""
    lists = edges.groupBy("node").agg(F.slice(F.sort_array(F.collect_set(F.struct(
        F.round("sim", 5).cast("float").alias("sim"), "nbr")), False), 1, 2 * k).alias("l"))
    flat = lists.select("node", F.posexplode(F.slice(F.array_distinct("l"), 1, k)).alias("i", "e"))
    return flat.select("node", F.col("e.nbr").alias("nbr"), F.col("e.sim").alias("sim"))


def refine(lists: DataFrame, space: DataFrame, k: int = LIST) -> tuple[DataFrame, int]:
    """One round of neighbours of neighbours: (new lists, entries that changed)."""
    worst = lists.groupBy("node").agg(F.min("sim").alias("floor"), F.count(F.lit(1)).alias("have"))
    worst = worst.select("node", F.when(F.col("have") < k, F.lit(-1.0)).otherwise(F.col("floor")).cast("float").alias("floor"))
    near = F.transform("v", lambda x: x.cast("float"))
    members = space.select("node", near.alias("v")).join(worst, "node", "left").withColumnRenamed("node", "member")
    # Lists that name a node are as many as others like: of them the nearest k count.
    named = best(lists.select(F.col("nbr").alias("node"), F.col("node").alias("nbr"), "sim"), k)
    both = lists.select(F.col("node").alias("center"), F.col("nbr").alias("member")).unionByName(
        named.select(F.col("node").alias("center"), F.col("nbr").alias("member"))).distinct()
    both = both.unionByName(space.select(F.col("node").alias("center"), F.col("node").alias("member")))
    dealt = both.join(members, "member").repartition("center").sortWithinPartitions("center")

    def local(batches):
        out, held = [], 0
        for t in groups(batches, ["center"]):
            ids = t.column("member").to_numpy()
            if len(ids) < 2:
                continue
            x = _matrix(t.column("v")).astype(np.float32)
            floor = np.nan_to_num(t.column("floor").to_numpy().astype(np.float32), nan=-1.0)
            out.append(_top(ids, x @ x.T, k, floor))
            held += len(out[-1][0])
            if held > 20_000:
                yield _rows(_EDGE, [np.concatenate(c) for c in zip(*out)])
                out, held = [], 0
        if out:
            yield _rows(_EDGE, [np.concatenate(c) for c in zip(*out)])

    new = materialize(best(lists.unionByName(dealt.mapInArrow(local, _EDGE_SCHEMA)), k), "nn-lists")
    changed = new.join(lists.select("node", "nbr"), ["node", "nbr"], "left_anti").count()
    return new, changed


def search(space: DataFrame, threshold: float, turn: int, lists: DataFrame | None = None) -> DataFrame:
    """Lists of the nodes of ``space``: fresh starts merged into ``lists`` and refined."""
    rows = space.groupBy(*_SPACE).agg(F.count(F.lit(1)).alias("rows"))
    most, count = rows.agg(F.max("rows"), F.sum("rows")).first()
    starts = starts_for(most or 0, threshold)
    for one in range(starts * turn, starts * (turn + 1)):
        fresh = start_lists(space, 31 + one, bits_for(most or 0))
        lists = fresh if lists is None else lists.unionByName(fresh)
    lists, count = materialize(best(lists), "nn-lists"), count or 0
    for _ in range(ROUNDS):
        lists, changed = refine(lists, space)
        if changed <= STOP * count:
            break
    return lists


def passing(lists: DataFrame, wide: DataFrame, threshold: float) -> DataFrame:
    """``lists`` with the angle of each entry, what each node is ``wide``, and whether nodes that
    the two stand for may be at the threshold."""
    both = lists.join(wide, "node").join(wide.select(F.col("node").alias("nbr"), F.col("wide").alias("far")), "nbr")
    angle = F.acos(F.greatest(F.least(F.col("sim").cast("double"), F.lit(1.0)) - _SLACK, F.lit(-1.0)))
    reach = F.least(F.lit(float(np.arccos(threshold))) + F.col("wide") + F.col("far"), F.lit(float(np.pi)))
    return both.select("node", "nbr", "wide", angle.alias("angle"), (F.col("sim") >= F.cos(reach) - _SLACK).alias("passes"))


def enlarged(lists: DataFrame, space: DataFrame, threshold: float) -> tuple[DataFrame, int]:
    """(``lists``, their length): as long as some list is full of entries at the threshold, the
    saturated nodes and those they list are refined with lists twice as long, up to
    ``LONGEST``; the lists of other nodes stay as they are."""
    k = LIST
    while k < LONGEST:
        full = lists.groupBy("node").agg(F.count(F.lit(1)).alias("have"), F.min("sim").alias("worst"))
        full = full.filter((F.col("have") >= k) & (F.col("worst") >= threshold - _SLACK)).select("node")
        part = lists.join(full, "node", "left_semi")
        members = materialize(part.select(F.col("nbr").alias("node")).unionByName(full).distinct(), "nn-full")
        if members.isEmpty():
            break
        k *= 2
        near = space.join(members, "node", "left_semi")
        mine = lists.join(members, "node", "left_semi").join(members.withColumnRenamed("node", "nbr"), "nbr", "left_semi")
        grown, _ = refine(materialize(mine.select("node", "nbr", "sim"), "nn-mine"), near, k)
        # Lists of nodes that are not saturated keep their length: what grew for them on the way is dropped.
        kept = grown.join(full, "node", "left_semi")
        lists = materialize(best(lists.unionByName(kept), k), "nn-lists")
    return lists, k


def handed_over(found: DataFrame, level: int, k: int = LIST) -> DataFrame:
    """(node, wide): of each saturated node, the least by hash among itself and its list."""
    by = lambda c: F.xxhash64(c, F.lit(level)).alias("h")
    full = found.groupBy("node").agg(
        F.count(F.lit(1)).alias("have"), F.min("passes").alias("all"), F.first("wide").alias("wide"),
        F.min(F.struct(by("nbr"), F.col("nbr").alias("to"), "angle")).alias("least"))
    own = F.struct(by("node"), F.col("node").alias("to"), F.lit(0.0).alias("angle"))
    full = full.filter((F.col("have") >= k) & F.col("all")).withColumn("least", F.least("least", own))
    return full.groupBy(F.col("least.to").alias("node")).agg(F.max(F.col("wide") + F.col("least.angle")).alias("wide"))


def candidate_edges(lists: DataFrame, space: DataFrame, threshold: float, turn: int) -> DataFrame:
    """(a, b): entries of ``lists`` at the threshold, and those that saturated lists may hide."""
    wide = space.select("node", F.lit(0.0).alias("wide"))
    level, count = 0, space.count()
    # Longer lists show more of a dense cluster; whether another lies beside it, only the levels tell.
    edges = (passing(enlarged(lists, space, threshold)[0], wide, threshold).filter("passes")
             .select(F.col("node").alias("a"), F.col("nbr").alias("b")))
    while True:
        found = materialize(passing(lists, wide, threshold), "nn-found")
        here = found.filter("passes").select(F.col("node").alias("a"), F.col("nbr").alias("b"))
        edges = edges.unionByName(here)
        wide = materialize(handed_over(found, level), "nn-level")
        left = wide.count()
        # One node of a level can have no edge; as many as before would go on without end.
        if left < 2 or left >= count:
            return edges
        level, count = level + 1, left
        few = materialize(space.join(wide.select("node"), "node", "left_semi"), "nn-space")
        lists = search(few, threshold, turn)


def block_links(grouped: DataFrame, threshold: float) -> DataFrame:
    """(node, links, root) from (group, node, n, v): every pair of a group compared, in blocks.

    ``links`` counts the vectors of other nodes at the threshold, ``root`` is a node that
    the block pair connects this one with. No pair is emitted.
    """
    sizes = grouped.groupBy("group").agg(F.count(F.lit(1)).alias("size")).withColumn(
        "blocks", F.ceil(F.col("size") / F.lit(BLOCK)).cast("int"))
    rows = grouped.join(sizes.filter("size > 1").select("group", "blocks"), "group").withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # A block meets every block: as the first of the pair if its number is not larger.
    other = F.sequence(F.lit(0), F.col("blocks") - 1)
    pairs = rows.select("group", "node", "n", "v", "block", F.explode(other).alias("o")).select(
        "group", F.least("block", "o").cast("long").alias("i"), F.greatest("block", "o").cast("long").alias("j"),
        "node", "n", "v", "block")

    def compare(batches):
        kinds = (("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64()))
        for t in groups(batches, ["group", "i", "j"]):
            i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
            ids, n, side = t.column("node").to_numpy(), t.column("n").to_numpy(), t.column("block").to_numpy()
            x = _matrix(t.column("v"))
            linked = x @ x.T >= threshold
            np.fill_diagonal(linked, False)
            if i != j:
                linked &= side[:, None] != side[None, :]
            root = local_roots(linked)
            yield _rows(kinds, [ids, linked @ n, ids[root]])

    dealt = pairs.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j")
    return dealt.mapInArrow(compare, "node long, links long, root long")


def audit(space: DataFrame, group_of: DataFrame, threshold: float, lists: DataFrame, size: int = AUDIT) -> tuple[int, int]:
    """Of about ``2 * size`` nodes compared with all others by brute force: (those with a link, those whose every link
    lies inside their group). Half are drawn from all nodes, half from those whose nearest known
    neighbour lies within ``CLOSE`` of the threshold, where links are found and missed. The size is
    fixed, so one audit is one pass over the nodes whatever their number: with 300 linked nodes
    asked and none missed, the recall is above ``TARGET`` with 95 % confidence.
    """
    close = lists.groupBy("node").agg(F.max("sim").alias("s")).filter(F.col("s") >= threshold - CLOSE).select("node")
    tagged = materialize(space.join(group_of, "node", "left").join(close.withColumn("close", F.lit(True)), "node", "left").select(
        "node", *_SPACE, "v", F.coalesce("component", "node").alias("g"), F.coalesce("close", F.lit(False)).alias("close")), "nn-audit")
    n = tagged.agg(F.count(F.lit(1)).alias("all"), F.count(F.when(F.col("close"), 1)).alias("close")).first()
    draw = lambda seed, of: F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(max(1, -(-of // size)))) == 0
    some = tagged.filter(draw(99, n["all"]) | (F.col("close") & draw(98, n["close"])))
    return _asked(tagged, some.collect(), threshold)                      # about 2 * size rows


def _asked(tagged: DataFrame, asked: list, threshold: float) -> tuple[int, int]:
    """(nodes of ``asked`` with a link, those whose every link lies inside their group)."""
    if not asked:
        return 0, 0
    by: dict[int, tuple] = {}
    for r in asked:
        mine = by.setdefault((r["label"], r["size"]), ([], [], []))
        for c, v in zip(mine, (r["node"], r["g"], r["v"])):
            c.append(v)
    shared = tagged.sparkSession.sparkContext.broadcast({k: (np.array(a), np.array(g), np.array(v)) for k, (a, g, v) in by.items()})

    def compare(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for value, part in _spaces(b):
                if value not in shared.value:
                    continue
                y, nodes_, groups_ = _matrix(part.column("v")).T, part.column("node").to_numpy(), part.column("g").to_numpy()
                for lo in range(0, len(shared.value[value][0]), AUDIT):
                    ids, g, v = (c[lo:lo + AUDIT] for c in shared.value[value])
                    x = v / np.abs(v).max(axis=1, keepdims=True)
                    q = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
                    hit = (q @ y >= threshold) & (ids[:, None] != nodes_[None, :])
                    out = hit & (g[:, None] != groups_[None, :])
                    for node, a, z in zip(ids.tolist(), hit.sum(axis=1), out.sum(axis=1)):
                        if a:
                            total[node] = total.get(node, np.zeros(2, np.int64)) + (a, z)
        rows = [(n, int(a), int(z)) for n, (a, z) in total.items() if a]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)],
                                         names=["node", "found", "outside"])

    each = (tagged.mapInArrow(compare, "node long, found long, outside long").groupBy("node")
            .agg(F.sum("outside").alias("outside")))
    r = each.agg(F.count(F.lit(1)), F.count(F.when(F.col("outside") == 0, 1))).first()
    shared.destroy()
    return int(r[0]), int(r[1])


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): n_links, component_id, kept.

    Vectors that are null, zero or hold null or non-finite components, and those without
    a label, link with nothing. Repeated rows are vectors of their own that link with
    each other. A null vec_id is never a component's id while the component has another.
    """
    arrow_rows(vectors.sparkSession, 2048)
    rows, space = nodes(vectors)
    lists = edges = None
    for turn in range(TRIES):
        lists = search(space, threshold, turn, lists)
        more = candidate_edges(lists, space, threshold, turn)
        edges = more if edges is None else edges.unionByName(more)
        group_of = components(edges)
        linked, whole = audit(space, group_of, threshold, lists)
        if whole >= TARGET * linked:
            break
    else:
        raise RuntimeError(f"near-duplicate search: {whole} of {linked} audited nodes whole after {TRIES} turns, target {TARGET}")
    grouped = space.join(group_of.withColumnRenamed("component", "group"), "node").select("group", "node", "n", "v")
    part = materialize(block_links(grouped, threshold), "nn-links")
    comp = components(part.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = part.groupBy("node").agg(F.sum("links").alias("links"))
    full = (space.select("node", "h1", "h2", "first", "n").join(links, "node", "left").join(comp, "node", "left")
            .withColumn("component", F.coalesce("component", "node")))
    ids = full.groupBy("component").agg(F.min("first").alias("component_id"))
    full = materialize(full.join(ids, "component").select(
        "h1", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"), "nn-result")
    out = rows.join(full, ["h1", "h2"], "left")
    cid = F.when(F.col("h1").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), cid.alias("component_id"),
                      F.col("vec_id").eqNullSafe(cid).alias("kept"))


def op9_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``embeddings`` at cosine 0.98; one row per vector."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


# Links by brute force within a label, components by following them.
OP9_SQL = f"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id::BIGINT AS vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL
       AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.r <> b.r
          WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
reach(r, t) AS (SELECT r, r FROM v UNION SELECT reach.r, links.b FROM reach JOIN links ON reach.t = links.a),
comp AS (SELECT reach.r, min(v.vec_id) AS component_id FROM reach JOIN v ON reach.t = v.r GROUP BY reach.r),
n AS (SELECT a AS r, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN comp USING (r) LEFT JOIN n USING (r)
"""
