"""BPE encoding and decoding (7): forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never be merged across,
so a cut between its two bytes is certain.  Each pre-token is cut there, the
fragments are encoded independently (and remembered), and the ids laid end to
end are exactly those of merging the whole.

A text is first cut before every space that stands between two non-space
characters: the pre-tokeniser always cuts there too.  Pieces are remembered with their ids.  The vocabulary file's path is
a parameter and is read on each executor.

Edge cases: null encodes to no ids; the strings of special tokens inside a text
become their ids, as in the file's library; ids decode byte for byte, then as UTF-8 with
replacement of what is not valid.
"""

from __future__ import annotations

import hashlib
import json
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from weftline.llm.common import arrow_map, column, table, texts_of

#: The byte-level pre-tokeniser's pattern (a fixed value of the vocabulary's format).
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, others from U+0100 up."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Remembered(dict):
    """What ``fn`` gives for a short key, remembered in two halves: at ``limit`` / 2 new keys the older half goes, less what was met since."""

    def __init__(self, fn, limit: int):
        self.fn, self.half, self.older = fn, limit // 2, {}

    def __missing__(self, key):
        got = self.older.get(key)
        if got is None:
            got = self.fn(key)
        if len(key) < 64:
            if len(self) >= self.half:
                self.older = dict(self)
                self.clear()
            self[key] = got
        return got


class ForcedBoundaryBPE:
    """A byte-level BPE vocabulary with the table of pairs that some token holds."""

    MEMO = 250_000

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        as_bytes = lambda token: bytes(letters[c] for c in token)
        vocab = {as_bytes(k): v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        self.single = [vocab.get(bytes([b])) for b in range(256)]
        self.bytes_of = {v: k for k, v in vocab.items()} | {v: k.encode() for k, v in self.special.items()}
        inside = np.zeros((256, 256), bool)
        for token in vocab:
            a = np.frombuffer(token, np.uint8)
            inside[a[:-1], a[1:]] = True
        self.inside = inside.tobytes()  # Row by row.
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = (as_bytes(x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
            self.ranks[vocab[a], vocab[b]] = rank
            self.made.append(vocab[a + b])
        self.pretoken = regex.compile(PRETOKEN)
        self.specials = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.firsts = Remembered(self.chunk, self.MEMO // 10)
        self.others = Remembered(lambda word: self.chunk(" " + word), self.MEMO)
        self.fragments = Remembered(lambda raw: self.merge(raw) if len(raw) < 40 else self.merge_long(raw), self.MEMO)
        n = max(self.bytes_of) + 1
        self.lengths = np.array([len(self.bytes_of.get(i, b"")) for i in range(n)], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.flat = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(n)), np.uint8)

    def cut(self, raw: bytes) -> list[bytes]:
        """``raw`` at its certain boundaries."""
        inside, out, last = self.inside, [], 0
        for k, (a, b) in enumerate(zip(raw, raw[1:]), 1):
            if not inside[a << 8 | b]:
                out.append(raw[last:k])
                last = k
        out.append(raw[last:])
        return out

    def merge(self, fragment: bytes) -> bytes:
        """Ids of one fragment, packed; the lowest-ranked pair merges first, leftmost on ties."""
        ids = [self.single[b] for b in fragment]
        rank, none = self.ranks.get, len(self.made)
        found = [rank(pair, none) for pair in zip(ids, ids[1:])]
        while found and (best := min(found)) < none:
            at = found.index(best)
            ids[at : at + 2] = [self.made[best]]
            del found[at]
            if at:
                found[at - 1] = rank((ids[at - 1], ids[at]), none)
            if at < len(found):
                found[at] = rank((ids[at], ids[at + 1]), none)
        return struct.pack(f"<{len(ids)}I", *ids)

    def merge_long(self, fragment: bytes) -> bytes:
        """The same for long fragments, in n log n: a heap of pairs over a linked list."""
        import heapq

        ids = [self.single[b] for b in fragment]
        n = len(ids)
        left, right, merges = list(range(-1, n - 1)), [*range(1, n), -1], self.merges
        heap = [(m[0], k, ids[k], ids[k + 1], m[1]) for k in range(n - 1) if (m := merges.get((ids[k], ids[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, a, b, new = heapq.heappop(heap)
            j = right[k]
            if ids[k] != a or j < 0 or ids[j] != b:
                continue
            ids[k], ids[j], right[k] = new, None, right[j]
            if right[k] >= 0:
                left[right[k]] = k
                if m := merges.get((new, ids[right[k]])):
                    heapq.heappush(heap, (m[0], k, new, ids[right[k]], m[1]))
            if left[k] >= 0 and (m := merges.get((ids[left[k]], new))):
                heapq.heappush(heap, (m[0], left[k], ids[left[k]], new, m[1]))
        return np.array([x for x in ids if x is not None], "<u4").tobytes()

    def chunk(self, text: str) -> bytes:
        return b"".join([self.fragments[f] for p in self.pretoken.findall(text) for f in self.cut(p.encode())])

    #: Before a space between two characters that are no white space.
    EDGE = regex.compile(r"(?<=\S) (?=\S)")
    #: A space next to white space: not every space is such an edge.
    ODD = [pair for x in regex.findall(r"\s", "".join(map(chr, range(0xD800)))) for pair in dict.fromkeys((f"{x} ", f" {x}"))]

    def plain(self, text: str) -> bytes:
        if not text:
            return b""
        odd = text[0] == " " or text[-1] == " " or any(pair in text for pair in self.ODD)
        first, *rest = self.EDGE.split(text) if odd else text.split(" ")
        return self.firsts[first] + b"".join(map(self.others.__getitem__, rest))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.specials is None or not self.specials.search(text):
            return self.plain(text)
        out, last = [], 0
        for m in self.specials.finditer(text):
            out += [self.plain(text[last : m.start()]), np.array([self.special[m[0]]], "<u4").tobytes()]
            last = m.end()
        return b"".join([*out, self.plain(text[last:])])

    def decode(self, packed: bytes) -> bytes:
        """UTF-8 of the decoded text; bytes that are not valid become U+FFFD."""
        ids = np.frombuffer(packed, "<u4").astype(np.int64)
        if not len(ids):
            return b""
        n = self.lengths[ids]
        total = int(n.sum())
        starts = np.repeat(self.offsets[ids] - (np.cumsum(n) - n), n)
        raw = self.flat[starts + np.arange(total)].tobytes()
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode()


@lru_cache(maxsize=2)
def load(path: str) -> ForcedBoundaryBPE:
    return ForcedBoundaryBPE(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def bpe_encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with the packed ids (binary) of ``text`` in column ``out``."""
    return _mapped(df, out, lambda batch: [load(path).encode(x.decode()) for x in texts_of(batch, text)])


def bpe_decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the UTF-8 (binary) that the packed ids stand for in column ``out``."""
    return _mapped(df, out, lambda batch: [load(path).decode(x or b"") for x in column(batch, ids).to_pylist()])


def _mapped(df: DataFrame, out: str, fn) -> DataFrame:
    kept = [f for f in df.schema if f.name != out]
    schema = T.StructType([*kept, T.StructField(out, T.BinaryType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = [column(batch, f.name) for f in kept] + [pa.array(fn(batch), pa.binary())]
        return pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema])

    return arrow_map(df, run, schema)


def op7_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    from pyspark.sql import functions as F

    path = path or default_vocabulary()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe_encode(docs, path).drop("text")
    both = bpe_decode(coded, path)
    return both.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
