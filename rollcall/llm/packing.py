"""Best-fit-decreasing packing of tokenised documents into fixed-size sequences.

Piece lengths are whole numbers up to the capacity, so all that best fit needs of a
corpus is how many pieces of each length there are: at most ``capacity`` counts, at
any corpus size. ``best_fit_plan`` runs best-fit decreasing over these counts. A segment
tree over the remaining capacities 0..capacity finds the tightest open bin in
logarithmic time; bins of equal remainder are kept as intervals of bin numbers, and
pieces of one length that go to such an interval are placed in one step, exactly as
one-by-one placement would put them. The plan is a list of runs: "pieces of length l
with ranks lo..hi-1 go, q to a bin, to the bins from b on".

Spark ranks the pieces of each length without gathering a length in one task (ranks
within hashed buckets, about the square root of the count of them, plus the sums of the
buckets before) and looks each piece up in the runs.
"""

from __future__ import annotations

import codecs
import math
import sys
import zlib
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.llm.common import RID, arrow_rows, materialize, table, with_rid

CAPACITY = 1024
END_ID = 2
_RANK_BITS = 44


class SegmentTree:
    """Which remaining capacities 0..n have an open bin; the smallest one that fits."""

    def __init__(self, n: int):
        self.size = 1 << (n + 1).bit_length()
        self.any = [False] * (2 * self.size)

    def set(self, at: int, value: bool) -> None:
        i = at + self.size
        self.any[i] = value
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, at_least: int) -> int | None:
        """Smallest set position >= ``at_least``: climb until a right sibling is set, go down."""
        i = at_least + self.size
        if self.any[i]:
            return at_least
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def best_fit_plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Runs (length, lo, hi, first bin, pieces a bin, offset) that place all pieces."""
    tree = SegmentTree(capacity)
    open_bins: dict[int, list[tuple[int, int]]] = {}
    runs: list[tuple[int, int, int, int, int, int]] = []
    new = 0

    def add(room: int, first: int, n: int) -> None:
        if room > 0 and n > 0:
            open_bins.setdefault(room, []).append((first, n))
            tree.set(room, True)

    for length in sorted(counts, reverse=True):
        lo, todo = 0, counts[length]
        while todo:
            room = tree.tightest(length)
            if room is None:
                room, first, have = capacity, new, -(-todo // (capacity // length))
                new += have
            else:
                first, have = open_bins[room].pop()
                if not open_bins[room]:
                    tree.set(room, False)
            per = room // length
            used = min(have, -(-todo // per))
            placed = min(todo, used * per)
            runs.append((length, lo, lo + placed, first, per, capacity - room))
            full, some = divmod(placed, per)
            add(room, first + used, have - used)
            add(room - per * length, first, full)
            if some:
                add(room - some * length, first + full, 1)
            lo, todo = lo + placed, todo - placed
    return np.array(runs, dtype=np.int64).reshape(-1, 6)


# ---- tokenising ---------------------------------------------------------------------

_CACHE_MAX = 350_000           # chunks, in each of two generations
_SPACE_SIGN = chr(256 + 0x20)                  # how a byte-level vocabulary writes a space


def _split(text: str) -> list[str]:
    """``text`` cut before every space and line feed. A part with a line feed begins with it;
    the space of the others is left out; the first begins with a space that is not the text's."""
    parts = text.replace("\n", " \n").split(" ")
    parts[0] = " " + parts[0]
    return parts


def _chunk(part: str) -> str:
    """The text that a part of :func:`_split` stands for."""
    return part[1:] if part[:1] == " " else part if part[:1] == "\n" else " " + part


def _cut_inside(part: str, added: tuple[str, ...] = ()) -> bool:
    """Whether a part begins inside a token: white space, an added token or nothing follows its
    space or line feed."""
    if part[:1] == " ":
        return False
    rest = part[1:] if part[:1] == "\n" else part
    return not rest or rest[0].isspace() or rest.startswith(added)


def _mended(parts: list[str], added: tuple[str, ...] = ()) -> list[str]:
    """``parts``, those that begin inside a token put back on the part before."""
    out: list[str] = []
    for p in parts:
        if p[:1].isalnum() and not p.startswith(added) or not _cut_inside(p, added):
            out.append(p)
        else:
            out[-1] += _chunk(p)
    return out


def chunks(text: str) -> list[str]:
    """``text`` cut before each space or line feed that a non-space follows. The pre-tokeniser
    always starts a new token there (of a run of white space it takes all but the last sign),
    so the chunks' ids, joined, are the text's ids."""
    return [_chunk(p) for p in _mended(_split(text))]


def byte_letters() -> dict[int, str]:
    """The sign by which a byte-level vocabulary writes each byte: printable Latin-1 signs
    stand for themselves, the other bytes, in order, for the signs from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class _CutInside(Exception):
    """A part that is no chunk of its own."""


class _Kept(dict):
    """Ids of parts, made when first asked for. Two generations of at most ``most``: what was
    asked for since the last change stays at hand; what was not, goes."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        self.make, self.most = make, most
        self.older: dict[str, bytes] = {}

    def __missing__(self, part: str) -> bytes:
        got = self.older.get(part)
        if got is None:
            got = self.make(part)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[part] = got
        return got

    def peek(self, part: str) -> bytes | None:
        got = self.get(part)
        return self.older.get(part) if got is None else got


class ChunkEncoder:
    """Little-endian unsigned 32-bit ids of texts; common chunks are encoded once a worker.

    A chunk of letters with or without marks after them is known to be one or two tokens
    of the pre-tokeniser, so the vocabulary's model gets them as they are; any other
    chunk goes through the whole tokeniser.
    """

    _MARKS = ".,;:!?%&$#*|"

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.added = tuple(t.content for t in self.tok.get_added_tokens_decoder().values())
        letters = byte_letters()
        self.letters = "".join(letters[b] for b in range(256))
        self.marks = lru_cache(1 << 14)(self._token)
        self.cache = _Kept(self._encode, _CACHE_MAX)

    def _token(self, text: str) -> bytes:
        """Ids of one token of the pre-tokeniser."""
        signs = codecs.charmap_decode(text.encode("utf-8"), "strict", self.letters)[0]
        return _packed([t.id for t in self.model.tokenize(signs)])

    def _encode(self, part: str) -> bytes:
        core = part.rstrip(self._MARKS)
        if core.isalpha() and not part.startswith(self.added):
            if len(core) == len(part):
                return self._token(" " + part)
            return (self.cache.peek(core) or self._token(" " + core)) + self.marks(part[len(core):])
        if _cut_inside(part, self.added):
            raise _CutInside
        lead, word = part[:1], core[1:]
        if lead in (" ", "\n") and word.isalpha():
            out = self._token(word) if lead == " " else self.marks(lead) + self._token(word)
            return out if len(core) == len(part) else out + self.marks(part[len(core):])
        return _packed(self.tok.encode(_chunk(part), add_special_tokens=False).ids)

    def __call__(self, text: str) -> bytes:
        parts = _split(text)
        if "" in parts or "\n" in parts:
            parts = _mended(parts, self.added)
        try:
            return b"".join(map(self.cache.__getitem__, parts))
        except _CutInside:
            return b"".join(map(self.cache.__getitem__, _mended(parts, self.added)))


def encoder(path: str) -> ChunkEncoder:
    """The worker process's encoder for ``path``: loaded once, with the chunks that earlier tasks met."""
    held = vars(sys.modules["tokenizers"]).setdefault("_chunk_encoders", {})
    if path not in held:
        held[path] = ChunkEncoder(path)
    return held[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; only the first may be short."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first), *[(s, capacity) for s in range(first, n, capacity)]]


def tokenized_pieces(docs: DataFrame, tokenizer: str | None = None, text: str = "text",
                     doc_id: str = "doc_id", capacity: int = CAPACITY, end_id: int = END_ID,
                     ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every text, ``end_id`` appended."""
    import os

    import public_tokenizers
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    id_type = docs.schema[doc_id].dataType
    fields = [T.StructField("doc_id", id_type), T.StructField("piece", T.IntegerType()),
              T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
              T.StructField("ids_crc32", T.LongType())]
    if ids:
        fields.append(T.StructField("ids", T.BinaryType()))
    schema = T.StructType(fields)

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers  # noqa: F401 -- holds the process's encoders
        encode = encoder(path)
        end = np.array([end_id], dtype="<u4").tobytes()
        for b in batches:
            rows = [[] for _ in fields]
            for key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                data = encode(t or "") + end
                for k, (start, n) in enumerate(cut(len(data) // 4, capacity)):
                    part = data[4 * start:4 * (start + n)]
                    for col, v in zip(rows, (key, k, start, n, zlib.crc32(part), part)):
                        col.append(v)
            kinds = [b.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)],
                                             names=[f.name for f in fields])

    arrow_rows(docs.sparkSession, 256)
    src = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return src.mapInArrow(run, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (any columns, ``length`` in 1..capacity) plus ``sequence_id`` and ``offset``.

    Lengths outside that range fail. Repeated rows are pieces of their own. No rows
    give no rows. Which of two pieces of equal length goes where is fixed by the order
    of the stored rows.
    """
    spark = pieces.sparkSession
    stored = materialize(with_rid(pieces), "pack-pieces")
    counts = {int(r[0]): int(r[1]) for r in stored.groupBy("length").count().collect()}  # <= capacity rows
    if any(not 1 <= n <= capacity for n in counts):
        raise ValueError(f"piece lengths must be 1..{capacity}")
    runs = best_fit_plan(counts, capacity)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    keys = (runs[:, 0] << _RANK_BITS) + runs[:, 1]
    plan = spark.sparkContext.broadcast((keys, runs))        # bounded by the capacity alone
    sizes = spark.createDataFrame([(n, math.isqrt(c) + 1) for n, c in counts.items()],
                                  "__length long, __buckets long")
    dealt = (stored.join(F.broadcast(sizes), F.col("length") == F.col("__length"))
             .withColumn("__bucket", F.pmod(F.xxhash64(RID), F.col("__buckets"))))
    before = (dealt.groupBy("__length", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
              .withColumn("__before", F.sum("__n").over(W.partitionBy("__length").orderBy("__bucket")) - F.col("__n"))
              .select("__length", "__bucket", "__before"))
    ranked = (dealt.withColumn("__in", F.row_number().over(W.partitionBy("__length", "__bucket").orderBy(RID)) - 1)
              .join(before, ["__length", "__bucket"])
              .select(*pieces.columns, (F.col("__before") + F.col("__in")).alias("__rank")))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType())])

    kept, names = pieces.columns, schema.names

    arrow_rows(spark, 16384)

    def place(batches):
        keys, runs = plan.value
        for b in batches:
            length = b.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = b.column("__rank").to_numpy(zero_copy_only=False).astype(np.int64)
            r = runs[np.searchsorted(keys, (length << _RANK_BITS) + rank, "right") - 1]
            nth, slot = np.divmod(rank - r[:, 1], r[:, 4])
            cols = [b.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(r[:, 3] + nth), pa.array(r[:, 5] + slot * length)], names=names)

    return ranked.mapInArrow(place, schema)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of at most 1024 tokens; one row per piece.

    A null or empty text is the end id alone. A null doc_id keeps its pieces.
    """
    return pack(tokenized_pieces(table(spark, sf_dir, "documents")))
