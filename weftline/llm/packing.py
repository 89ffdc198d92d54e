"""Best-fit packing (8): pattern packing by non-negative least squares.

Documents become ids, end with one closing id, and are cut only where they
exceed ``capacity``.  The histogram of piece lengths (``capacity`` counts at
most, whatever the corpus) goes to the driver.  There patterns that fill a sequence are
enumerated on grids of lengths: first up to three pieces on a fine grid, then, for what
is left, up to five on a coarser one.
Repeat counts are fitted to the histogram by non-negative least squares and rounded to what
is there.  The residual is packed best-fit decreasing on exact lengths, into the room that
rounding up to a grid has left in the patterns' sequences and into sequences of its own.

The plan says for the k-th piece of each length which sequence it goes to, so
applying it needs only a rank within each length.  Ranks are counted within
salted groups, so a length that a third of all pieces share is no hot key.

Edge cases: a null or empty text is one piece holding just the closing id;
repeated rows are packed once each (rows equal in key, piece and ids may change places, which no
result shows); an empty table gives an empty result; columns other than key and text
are not looked at, and the key may bear any name.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from copy import deepcopy
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import arrow_map, column, table, texts_of, written

CAPACITY = 4096
END_ID = 1
#: (width of a length class, most pieces of a pattern, steps of the fit), in the order of use.
PHASES = ((4, 3, 1200), (32, 5, 300))
MEMO = 200_000


class ChunkTokenizer:
    """The library's ids of a text, by chunks between spaces: this vocabulary drops white space before it merges, so chunks are independent."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.memo: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True

    #: Marks between a letter and white space: a token of its own for this vocabulary's pattern.
    MARKS = re.compile(r"(?<=[a-zß-öø-ÿ])([.,!?;:&%#*$|<>]+)(?=[ \n]|$)")
    LATIN = re.compile(r"[\x00-\xff]*")

    def chunks(self, text: str) -> list[str]:
        """Latin-1 texts in lower case, with marks after words apart, give far fewer distinct chunks for the same ids.

        Texts that may hold a special token, which must be read before case is folded, stay as they are.
        """
        if (text.isascii() or self.LATIN.fullmatch(text)) and "<|" not in text:
            text = self.MARKS.sub(r" \1", text.lower())
        return text.replace("\n", " ").split(" ")

    def _encode_words(self, words: list[str]) -> list[str]:
        """Words of letters, joined: each ends with an id that ends a word.  Returns those not told apart this way."""
        for at in range(0, len(words), 20_000):
            some = words[at : at + 20_000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(some):
                return words[at:]
            packed, bounds = ids.tobytes(), (4 * ends).tolist()
            self.memo.update(zip(some, map(packed.__getitem__, map(slice, [0, *bounds[:-1]], bounds)), strict=True))
        return []

    def _encode_chunks(self, chunks: list[str]) -> None:
        for at in range(0, len(chunks), 20_000):
            some = chunks[at : at + 20_000]
            got = self.tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            owner = np.array([-1 if x is None else x for x in got.word_ids], np.int64)
            ids = np.array(got.ids, "<u4")
            # A special token inside a text belongs to no word for the library.
            if (owner < 0).any():
                for c in some:
                    self.memo[c] = np.array(self.tokenizer.encode(c, add_special_tokens=False).ids, "<u4").tobytes()
                continue
            ends = np.cumsum(np.bincount(owner, minlength=len(some)))
            for c, a, b in zip(some, [0, *ends[:-1]], ends, strict=True):
                self.memo[c] = ids[a:b].tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.chunks(t) for t in texts]
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        memo.setdefault("", b"")
        missing = set().union(*split).difference(memo)
        words = [c for c in missing if c.isalpha() and self.LATIN.fullmatch(c)]
        self._encode_chunks([*missing.difference(words), *self._encode_words(words)])
        return [np.frombuffer(b"".join(map(memo.__getitem__, s)), "<u4") for s in split]


@lru_cache(maxsize=2)
def load(path: str) -> ChunkTokenizer:
    return ChunkTokenizer(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


PIECES = T.StructType(
    [T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
)


def pieces_of(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``key``, piece, start, length, ids_crc32 (and the packed ids)."""
    fields = [T.StructField(key, df.schema[key].dataType), *PIECES] + ([T.StructField("ids", T.BinaryType())] if with_ids else [])
    schema = T.StructType(fields)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, rows = [], []
        for i, ids in enumerate(load(path).encode([x.decode() for x in texts_of(batch, text)])):
            full = np.append(ids, np.uint32(END_ID)).astype("<u4")
            for p, a in enumerate(range(0, len(full), capacity)):
                packed = full[a : a + capacity].tobytes()
                at.append(i)
                rows.append((p, a, len(packed) // 4, zlib.crc32(packed), packed))
        cols = [column(batch, key).take(pa.array(at, pa.int64()))]
        for j, kind in enumerate([pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids):
            cols.append(pa.array([r[j] for r in rows], kind))
        return pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema])

    return arrow_map(df.select(key, text), run, schema)


def patterns(units: int, most: int = 3) -> np.ndarray:
    """All multisets of one to ``most`` positive lengths with sum ``units``, as rows padded with 0, largest first."""
    if most == 3:
        out = [np.array([[units, 0, 0]])]
        a = np.arange(1, units // 2 + 1)
        out.append(np.stack([units - a, a, np.zeros_like(a)], 1))
        for c in range(1, units // 3 + 1):
            b = np.arange(c, (units - c) // 2 + 1)
            out.append(np.stack([units - c - b, b, np.full_like(b, c)], 1))
        return np.concatenate(out)
    rows: list[list[int]] = []

    def grow(row: list[int], left: int) -> None:
        if not left:
            rows.append(row + [0] * (most - len(row)))
            return
        for x in range(min(left, row[-1] if row else left), 0, -1):
            if x * (most - len(row)) < left:
                break
            grow([*row, x], left - x)

    grow([], units)
    return np.array(rows)


def nnls(pats: np.ndarray, target: np.ndarray, steps: int) -> np.ndarray:
    """Repeat counts x >= 0 that minimise the squared error of the pattern counts against ``target`` (index 0 unused), by accelerated projected gradient on columns scaled to the histogram."""
    n, size, most = len(pats), len(target), pats.shape[1]
    used = target > 0
    index = np.flatnonzero(((pats == 0) | used[pats]).all(1))
    x = np.zeros(n)
    if not len(index):
        return x
    p = pats[index]
    forward = lambda v: np.bincount(p.ravel(), weights=np.repeat(v, most), minlength=size)
    # A diagonal bound on the Hessian: each pattern touches at most so many rows.
    touch = np.bincount(p.ravel(), minlength=size).astype(float)
    touch[0] = 0
    step = 1 / np.maximum(1, touch[p].sum(1))
    y = z = np.zeros(len(p))
    t = 1.0
    for _ in range(steps):
        r = forward(y) - target
        r[0] = 0
        new = np.maximum(0, y - step * r[p].sum(1))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, z, t = np.maximum(0, new + (t - 1) / t2 * (new - z)), new, t2
    x[index] = z
    return x


class Plan:
    """Segments (length, first rank, end rank, origin, pieces a sequence, first sequence)."""

    def __init__(self, counts: np.ndarray, capacity: int = CAPACITY, phases: tuple = PHASES):
        self._begin(capacity)
        for phase in phases:
            self._patterns(counts, *phase)
        self._finish(counts)

    def _begin(self, capacity: int) -> None:
        self.capacity, self.sequences = capacity, 0
        self.segments: list[tuple[int, int, int, int, int, int]] = []
        self.used = np.zeros(capacity + 1, np.int64)
        self.open: dict[int, list[tuple[int, int]]] = {}  # room -> runs of (first sequence, sequences)

    def _finish(self, counts: np.ndarray) -> None:
        #: Sequences that patterns began, and tokens that they placed.
        self.patterned, self.patterned_tokens = self.sequences, int((self.used * np.arange(self.capacity + 1)).sum())
        self._best_fit(counts)
        seg = np.array(sorted(self.segments), np.int64).reshape(-1, 6)
        self.table = seg
        self.keys = (seg[:, 0] << 44) + seg[:, 1]

    def _patterns(self, counts: np.ndarray, grid: int, most: int, steps: int) -> None:
        units = self.capacity // grid
        cls = -(-np.arange(self.capacity + 1) // grid)
        have = np.bincount(cls, weights=counts - self.used, minlength=units + 1).astype(np.int64)
        have[0] = 0
        pats = patterns(units, most)
        x = nnls(pats, have.astype(float), steps)
        for k in np.argsort(-x, kind="stable"):
            if x[k] < 0.5:
                break
            members, times = np.unique(pats[k][pats[k] > 0], return_counts=True)
            n = int(min(np.floor(x[k] + 0.5), (have[members] // times).min()))
            if n <= 0:
                continue
            dealt = []
            for m, per in zip(members.tolist(), times.tolist(), strict=True):
                dealt.append((per, self._take(counts, m, grid, n * per, per)))
                have[m] -= n * per
            self._leave_open(dealt, n)
            self.sequences += n

    def _take(self, counts: np.ndarray, m: int, grid: int, n: int, per: int) -> list[tuple[int, int]]:
        """The next n pieces of class m, longest first, ``per`` to each of the sequences to come; (first place, length) of each run of them."""
        runs, place = [], 0
        for length in range(grid * m, grid * (m - 1), -1):
            k = min(n - place, int(counts[length] - self.used[length]))
            if k > 0:
                rank = int(self.used[length])
                self.segments.append((length, rank, rank + k, rank - place, per, self.sequences))
                runs.append((place, length))
                self.used[length] += k
                place += k
        return runs

    def _leave_open(self, dealt: list[tuple[int, list[tuple[int, int]]]], n: int) -> None:
        """Notes the room in the n sequences that the runs of ``dealt`` were given to; it is the same between two breaks."""
        breaks = {0, n}
        for per, runs in dealt:
            for place, _ in runs:
                breaks |= {place // per, -(-place // per)}
        edges = sorted(b for b in breaks if b <= n)
        for a, z in zip(edges, edges[1:]):
            room = self.capacity
            for per, runs in dealt:
                starts = [p for p, _ in runs]
                room -= sum(runs[bisect_right(starts, a * per + t) - 1][1] for t in range(per))
            if room > 0:
                self.open.setdefault(room, []).append((self.sequences + a, z - a))

    def _best_fit(self, counts: np.ndarray) -> None:
        open_, room = self.open, np.zeros(self.capacity + 1, bool)
        room[list(open_)] = True

        def put(length: int, rank: int, run: tuple[int, int], per: int, n: int, r: int) -> None:
            """The next n pieces go to the run's sequences, ``per`` to each (the last may get fewer)."""
            self.segments.append((length, rank, rank + n, rank, per, run[0]))
            full, rest = divmod(n, per)
            for s, c, each in ((run[0], full, per), (run[0] + full, 1 if rest else 0, rest)):
                if c and (more := r - each * length) > 0:
                    open_.setdefault(more, []).append((s, c))
                    room[more] = True

        for length in range(self.capacity, 0, -1):
            rank, end = int(self.used[length]), int(counts[length])
            while rank < end:
                fits = np.flatnonzero(room[length:])
                if not len(fits):
                    per = self.capacity // length
                    n = -(-(end - rank) // per)
                    put(length, rank, (self.sequences, n), per, end - rank, self.capacity)
                    self.sequences += n
                    break
                r = length + int(fits[0])
                s, c = open_[r].pop()
                if not open_[r]:
                    room[r] = False
                per = r // length
                n = min(end - rank, c * per)
                used = -(-n // per)
                if used < c:
                    open_[r].append((s + used, c - used))
                    room[r] = True
                put(length, rank, (s, used), per, n, r)
                rank += n

    def sequence_of(self, length: np.ndarray, rank: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, (length.astype(np.int64) << 44) + rank, side="right") - 1
        seg = self.table[at]
        return seg[:, 5] + (rank - seg[:, 3]) // seg[:, 4]


def best_plan(counts: np.ndarray, capacity: int = CAPACITY) -> Plan:
    """With both phases or with the first alone, whichever needs fewer sequences; both on ties."""
    both = Plan.__new__(Plan)
    both._begin(capacity)
    both._patterns(counts, *PHASES[0])
    one = deepcopy(both)
    both._patterns(counts, *PHASES[1])
    for p in (both, one):
        p._finish(counts)
    return min((both, one), key=lambda p: p.sequences)


def pack(pieces: DataFrame, key: str = "doc_id", capacity: int = CAPACITY, salts: int | None = None) -> DataFrame:
    """``pieces`` (with ``piece`` and ``length``) plus sequence_id and offset."""
    pieces = written(pieces, "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most `capacity` rows
        counts[r["length"]] = r["count"]
    plan = best_plan(counts, capacity)
    salts = salts or max(16, int(counts.sum() // 1_000_000) + 1)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(F.lit(8), key, "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    before = (
        salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
        .select("length", "salt", (F.sum("n").over(W.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    )
    ranked = (
        salted.withColumn("within", F.row_number().over(W.partitionBy("length", "salt").orderBy(key, "piece")))
        .join(before, ["length", "salt"])
        .withColumn("rank", F.col("before") + F.col("within") - 1)
        .drop("salt", "within", "before")
    )
    schema = T.StructType([f for f in ranked.schema if f.name != "rank"] + [T.StructField("sequence_id", T.LongType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        to = plan.sequence_of(column(batch, "length").to_numpy(), column(batch, "rank").to_numpy())
        cols = [column(batch, f.name) for f in list(schema)[:-1]] + [pa.array(to, pa.int64())]
        return pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema])

    placed = arrow_map(ranked, run, schema)
    w = W.partitionBy("sequence_id").orderBy(F.col("length").desc(), key, "piece").rowsBetween(W.unboundedPreceding, 0)
    return placed.withColumn("offset", F.sum("length").over(w) - F.col("length"))


def pack_documents(df: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """key, piece, start, length, ids_crc32, sequence_id and offset of every piece of every row."""
    rows = df.select(F.col(f"`{key}`").alias("row_key"), F.col(f"`{text}`").alias("row_text"))
    out = pack(pieces_of(rows, path or default_vocabulary(), "row_key", "row_text", capacity), "row_key", capacity)
    return out.select(F.col("row_key").alias(key), *[f.name for f in PIECES], "sequence_id", "offset")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
