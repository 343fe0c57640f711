"""Personal data: fixed forms, and identifiers found by the words around them
(DataFrame functions only).

Base spans are the matches of four fixed forms. They seed a bootstrapped extraction:
every identifier-like token of the corpus (and every base match) is an instance, the
lower-cased words next to it are its lexical patterns, and the edges form a graph of
patterns and distinct instances. Spark scores it in rounds: a pattern's confidence for
a kind is the score of its instances of that kind against its instances of other kinds or
of another shape; what has the right shape and is not yet accepted counts for neither. A
pattern needs ``MIN_SEEDS`` distinct instances of the kind. An instance of the right shape
scores by a noisy-or of its confident patterns; above ``ACCEPT`` it is accepted and counts for
all its patterns in the next round, until none is new. Accepted instances become spans
of the kind wherever they occur next to a confident pattern.

Positions come from the pieces between matches (``split``) and the matches
(``regexp_extract_all``): a running sum of both lengths, in rows, not in one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollcall.llm.common import RID, ROW, materialize, packed, small, table, with_rid

# The kinds in their order and the form of each. The possessive and
# look-behind signs only keep the search linear; the matches are those of the plain forms
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+   ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card  [0-9]([\x20-]?[0-9])+                               phone \+[0-9][\x20().0-9-]+[0-9]
KINDS = ("email", "ip", "card", "phone")
FORMS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){2}\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A text without this cannot hold the kind.
GATES = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
# Identifier-like tokens: with a digit, or an at sign inside.
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
# What an unseen identifier of a kind must look like.
SHAPES = {"email": r"^[^@]+@[^@]+$", "ip": r"^[0-9]+([.:][0-9A-Fa-f]+){3,}$", "card": r"^[0-9][0-9-]{11,}$",
          "phone": r"^[+(]?[0-9][0-9().-]{6,}$"}
CONFIDENT = 0.8
ACCEPT = 0.9
MIN_SEEDS = 3
_NEAR = 48                    # characters kept on each side of an instance
_PIECES = 8                   # matches of the same form that these may hold


def raw_matches(docs: DataFrame, text: str, keep: list[Column]) -> DataFrame:
    """``keep`` and one array column per kind and ``token``: (gap, value, left, right) of each match."""
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    forms = {**FORMS, "token": TOKEN}
    gates = {**GATES, "token": "[0-9@]"}
    cols = []
    for kind, form in forms.items():
        has = t.rlike(gates[kind])
        cols += [F.when(has, F.regexp_extract_all(t, F.lit(form), F.lit(0))).alias(f"v_{kind}"),
                 F.when(has, F.split(t, form, -1)).alias(f"g_{kind}")]
    names = [f"k{i}" for i in range(len(keep))]
    found = docs.select(*[k.alias(n) for k, n in zip(keep, names)], *cols)

    def rows(kind: str) -> Column:
        gaps, values, n = F.col(f"g_{kind}"), F.col(f"v_{kind}"), 2 if kind == "token" else _PIECES
        piece = lambda xs, j, cut: F.coalesce(cut(F.get(xs, j), F.lit(_NEAR)), F.lit(""))
        return F.transform(f"v_{kind}", lambda v, i: F.struct(
            F.length(F.get(gaps, i)).alias("gap"), v.alias("value"),
            F.right(F.concat(*[x for j in range(-n, 0) for x in (
                piece(gaps, i + j, F.right), piece(values, i + j, F.right))], piece(gaps, i, F.right)), F.lit(_NEAR)).alias("left"),
            F.left(F.concat(*[x for j in range(1, n + 1) for x in (
                piece(gaps, i + j, F.left), piece(values, i + j, F.left))]), F.lit(_NEAR)).alias("right")))

    return found.select(*names, *[rows(k).alias(k) for k in forms])


def located(raw: DataFrame, kinds) -> DataFrame:
    """(rid, kind, start, stop, value, left, right): one row per match, code points from 0."""
    each = None
    for k in kinds:
        rows = raw.select(RID, F.lit(k).alias("kind"), F.posexplode(k).alias("i", "m"))
        each = rows if each is None else each.unionByName(rows)
    upto = F.sum(F.col("m.gap") + F.length("m.value")).over(W.partitionBy(RID, "kind").orderBy("i"))
    rows = each.select(RID, "kind", "m.value", "m.left", "m.right", upto.cast("long").alias("stop"))
    return rows.withColumn("start", F.col("stop") - F.length("value"))


def valid(kind: Column, value: Column) -> Column:
    """Whether a match of a form counts."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    part = lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3
    ip = F.forall(F.split(value, r"\."), lambda p: part(p) & (
        F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    return (F.when(kind == "ip", ip).when(kind == "card", n.between(16, 19) & F.call_function("luhn_check", digits))
            .when(kind == "phone", n.between(8, 15)).otherwise(F.lit(True)))


def base_spans(raw: DataFrame) -> DataFrame:
    return located(raw, KINDS).filter(valid(F.col("kind"), F.col("value")))


def patterns(left: Column, right: Column) -> Column:
    """Lexical patterns of an instance: the two words before it; the words on both sides.
    What touches the instance is no word: a token is trimmed of it, a form leaves it out."""
    left, right = F.regexp_replace(left, r"[^\x20\x09-\x0D]++$", ""), F.regexp_replace(right, r"^[^\x20\x09-\x0D]++", "")
    before = F.filter(F.split(F.lower(left), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    after = F.filter(F.split(F.lower(right), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    w1, w2 = F.try_element_at(before, F.lit(-1)), F.try_element_at(before, F.lit(-2))
    return F.array_compact(F.array(
        F.concat(F.lit("L "), w2, F.lit(" "), w1), F.concat(F.lit("B "), w1, F.lit(" _ "), F.try_element_at(after, F.lit(1)))))


def instances(raw: DataFrame, base: DataFrame) -> DataFrame:
    """Tokens trimmed of marks that touch no base span: (rid, start, stop, value, patterns)."""
    tok = located(raw, ("token",))
    core = F.regexp_extract("value", r"[0-9A-Za-z+(].*[0-9A-Za-z]", 0)
    tok = tok.withColumn("core", core).filter(F.length("core") >= 4)
    tok = tok.select(RID, "left", "right", F.col("core").alias("value"),
                     (F.col("start") + F.instr("value", F.col("core")) - 1).alias("start"))
    tok = tok.withColumn("stop", F.col("start") + F.length("value"))
    b = base.select(F.col(RID).alias("__r"), F.col("start").alias("__s"), F.col("stop").alias("__e"))
    # Both sides are the few matches of one text.
    free = tok.join(b, (F.col(RID) == F.col("__r")) & (F.col("start") < F.col("__e")) & (F.col("__s") < F.col("stop")),
                    "left_anti")
    return free.select(RID, "start", "stop", "value", patterns(F.col("left"), F.col("right")).alias("patterns"))


def fits(kind: Column, value: Column) -> Column:
    """Whether a value has the shape of a kind."""
    out = None
    for k, form in SHAPES.items():
        c = F.when(kind == k, value.rlike(form))
        out = c if out is None else F.coalesce(out, c)
    return F.coalesce(out, F.lit(False))


def _score(hits: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, s) of the instances that their confident patterns make sure of."""
    miss = F.sum(F.log1p(-F.least(F.col("conf"), F.lit(0.999))))
    return (hits.groupBy(*keys).agg((1 - F.exp(miss)).alias("s"), F.max("conf").alias("top"))
            .filter((F.col("s") >= ACCEPT) | (F.col("top") >= ACCEPT)).drop("top"))


def confident_patterns(seeds: DataFrame, others: DataFrame) -> DataFrame:
    """(pattern, kind, conf) of the patterns that end above ``CONFIDENT``.

    ``seeds``: (kind, value, patterns), ``others``: (value, patterns). Edges are distinct, so
    copies of a text count once. Dropped at once is only what could not become confident
    if every instance of the right shape were accepted.
    """
    e_seed = seeds.select(F.explode("patterns").alias("pattern"), "kind", "value").distinct()
    e_other = others.select(F.explode("patterns").alias("pattern"), F.lit("").alias("kind"), "value").distinct()
    edges = materialize(e_seed.unionByName(e_other), "pii-edges")
    counts = [F.struct(F.lit(k).alias("kind"), F.count(F.when(F.col("kind") == k, 1)).alias("own"), F.count(F.when(
        (F.col("kind") == "") & fits(F.lit(k), F.col("value")), 1)).alias("open")) for k in KINDS]
    fixed = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.array(*counts).alias("per")).select(
        "pattern", "n", F.inline("per")).withColumn("wrong", F.col("n") - F.col("own") - F.col("open"))
    most = F.col("own") + F.col("open")
    fixed = materialize(fixed.filter((most >= MIN_SEEDS) & (most >= CONFIDENT * F.col("n"))), "pii-fixed")
    maybe = edges.filter("kind = ''").select("pattern", "value").join(fixed.select("pattern", "kind"), "pattern")
    maybe = materialize(maybe.filter(fits(F.col("kind"), F.col("value"))), "pii-maybe")
    accepted = materialize(maybe.select("value", F.col("kind").alias("k"), F.lit(0.0).alias("s")).limit(0), "pii-accepted")
    while True:
        same = F.col("kind") == F.col("k")
        got = maybe.join(accepted, "value").groupBy("pattern", "kind").agg(
            F.sum(F.when(same, F.col("s"))).alias("mass"), F.count(F.when(same, 1)).alias("more"),
            F.count(F.when(~same, 1)).alias("lost"))
        conf = fixed.join(got, ["pattern", "kind"], "left").fillna(0, ["mass", "more", "lost"])
        mass = F.col("own") + F.col("mass")
        conf = conf.filter(F.col("own") + F.col("more") >= MIN_SEEDS).select(
            "pattern", "kind", (mass / (mass + F.col("wrong") + F.col("lost"))).alias("conf"))
        conf = materialize(conf.filter(F.col("conf") >= CONFIDENT), "pii-patterns")
        sure = _score(maybe.join(conf, ["pattern", "kind"]), ["value", "kind"])
        first = F.row_number().over(W.partitionBy("value").orderBy(F.col("s").desc(), _order("kind")))
        new = materialize(sure.join(accepted.select("value"), "value", "left_anti").withColumn("i", first)
                          .filter("i = 1").select("value", F.col("kind").alias("k"), "s"), "pii-new")
        if new.isEmpty():
            return conf
        accepted = materialize(accepted.unionByName(new), "pii-accepted")


def found_spans(raw: DataFrame, base: DataFrame) -> DataFrame:
    """Spans that the method adds: (rid, kind, start, stop). Where two kinds claim a token the
    likelier one has it; ties go to the kind listed first."""
    inst = materialize(instances(raw, base), "pii-instances")
    seeds = base.select("kind", F.lower("value").alias("value"), patterns(F.col("left"), F.col("right")).alias("patterns"))
    conf = confident_patterns(seeds, inst.select(F.lower("value").alias("value"), "patterns"))
    hits = inst.select(RID, "start", "stop", "value", F.explode("patterns").alias("pattern")).join(conf, "pattern")
    sure = _score(hits.filter(fits(F.col("kind"), F.col("value"))), [RID, "start", "stop", "kind"])
    rank = F.row_number().over(W.partitionBy(RID, "start").orderBy(F.col("s").desc(), _order("kind")))
    return sure.withColumn("n", rank).filter("n = 1").select(RID, "kind", "start", "stop")


def _order(kind: str) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col(kind))


def all_spans(raw: DataFrame) -> DataFrame:
    """(rid, kind, start, stop, base) of base and added spans, written once."""
    base = materialize(base_spans(raw), "pii-base")
    added = found_spans(raw, base)
    return materialize(base.select(RID, "kind", "start", "stop", F.lit(True).alias("base"))
                       .unionByName(added.withColumn("base", F.lit(False))), "pii-spans")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets, all other
    columns and rows as they are. Spans that overlap are one, named by the first."""
    full = materialize(with_rid(packed(docs)), "pii-docs")
    flat = full.select(RID, F.col(f"{ROW}.`{text}`").alias("t"))
    raw = materialize(raw_matches(flat, "t", [F.col(RID)]).withColumnRenamed("k0", RID), "pii-raw")
    order = W.partitionBy(RID).orderBy("start", F.col("stop").desc(), _order("kind"))
    spans = all_spans(raw).withColumn("reach", F.max("stop").over(order.rowsBetween(W.unboundedPreceding, -1)))
    spans = spans.withColumn("island", F.sum(F.when(F.col("start") < F.col("reach"), 0).otherwise(1)).over(order))
    spans = spans.groupBy(RID, "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"),
                                             F.min_by("kind", F.struct("start", _order("kind"))).alias("kind"))
    cuts = spans.groupBy(RID).agg(F.sort_array(F.collect_list(F.struct("start", "stop", "kind"))).alias("cuts"))
    cuts = small(cuts.withColumnRenamed(RID, "__cut"))
    both = full.join(cuts, F.col(RID) == F.col("__cut"), "left").withColumn("t", F.col(f"{ROW}.`{text}`"))
    cut = lambda lo, hi: F.substring("t", (lo + 1).cast("int"), (hi - lo).cast("int"))
    parts = F.transform("cuts", lambda s, i: F.concat(
        cut(F.coalesce(F.get("cuts", i - 1)["stop"], F.lit(0)), s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]")))
    last = F.element_at("cuts", -1)["stop"]
    new = F.when(F.col("cuts").isNull(), F.col("t")).otherwise(
        F.concat(F.array_join(parts, ""), cut(last, F.length("t"))))
    columns = [F.col(f"{ROW}.`{c}`").alias(c) if c != text else F.col("__new").alias(c) for c in docs.columns]
    return both.select(ROW, new.alias("__new")).select(*columns)


def op6_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every text of ``documents``; counts and digest are of base spans.

    A null or empty text has no spans: counts 0, the digest of the empty string, empty
    ``spans``. Repeated rows have the same spans; a null doc_id keeps its row. An empty
    table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    found = raw_matches(docs, "text", [F.col("doc_id"), F.monotonically_increasing_id()])
    raw = materialize(found.withColumnsRenamed({"k0": "doc_id", "k1": RID}), "pii-raw")
    spans = all_spans(raw)
    item = F.struct(_order("kind").alias("o"), "start", "stop", "kind")
    join = lambda xs: F.array_join(F.transform(F.sort_array(xs), lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    n = [F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in KINDS]
    per = spans.groupBy(RID).agg(*n, F.collect_list(F.when(F.col("base"), item)).alias("b"), F.collect_list(item).alias("a"))
    per = per.select(F.col(RID).alias("__r"), *[f"n_{k}" for k in KINDS],
                     F.sha2(join("b"), 256).alias("sha"), join("a").alias("spans"))
    rows = raw.select("doc_id", RID).join(per, F.col(RID) == F.col("__r"), "left")
    return rows.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
                       F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("base_sha256"),
                       F.coalesce("spans", F.lit("")).alias("spans"))
