"""Toxicity (3): a convolutional text classifier in numpy.

A word's embedding is the sum of the hashed embeddings of the word and of its
first letters (so inflected forms share what they have learned).  Filters of
several widths slide over the words; each filter's largest response is kept
(max pooling over the whole text) and a logistic output reads them.  Training
is mini-batch Adam with gradients written out; a Platt fit on texts not
trained on turns the output into a probability at the labels' own rate; each
language gets the threshold that serves its calibration texts best.

A convolution is linear, so scoring multiplies each distinct word of a batch by all
filters once and then only adds and compares.

Labelled rows teach it with their whole texts.  Where fold 2 is held out, folds 0 and 1 give
the counts of the first embedding axis and the training, fold 3 calibration and thresholds.
Where none is, every labelled row gives all of these: the model trains on all of them, and for
calibration and thresholds each half of the rows is read by a model that only the other half
taught.  Training is spread: rows are dealt into shards by a hash of the key, each shard
trains a copy from the common start, and what the copies learned is averaged (an embedding over
the shards that met its words).  The driver sees sums only.  Classes weigh alike in training.
For calibration logits are counted in steps of 1 / ``STEPS``.

Edge cases: null and empty texts have no words and get the score of zero
responses; very long texts are read in overlapping spans, to the end; rows repeated
are scored alike; an id that labels call both toxic and not counts as toxic; a null id is never held out; without labels
of both classes (where no fold is held out: in each half) the score is what training on the rest gives; columns named as the results are replaced; a language without enough labels takes the general threshold.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import arrow_map, column, discard, map_batches, slices, table, written

#: About so many characters of text make a shard; a task holds at most twice that, or one text, at a time.
SHARD_CHARS = 16_000_000
#: Buckets whose numbers travel in one row.
CHUNK = 256
#: Logits are told apart by so many steps a unit in calibration.
STEPS = 1024
BUCKETS = 1 << 15
DIM = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
PREFIXES = (3, 4, 5)
EPOCHS = 5
BATCH = 64
SPAN = 1 << 16
THRESHOLD = 0.3
LEAST_OF_A_CLASS = 30
EDGES = "".join(chr(i) for i in range(128) if not chr(i).isalpha())
MEMO = 60_000
TAPS = sum(WIDTHS)
PER_WORD = 1 + len(PREFIXES)


def word_features(word: str) -> list[int]:
    """Of a word between white space, lower-cased, without what is no letter at its ends."""
    word = word.strip(EDGES)
    raw = [word] + [f"^{word[:k]}" for k in PREFIXES]
    return [xxhash.xxh32_intdigest(x) % BUCKETS for x in raw]


class Words(dict):
    """Index of each word seen; ``fresh`` holds the words not yet looked at."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        k = self[word] = len(self)
        self.fresh.append(word)
        return k

    def of(self, text: str) -> np.ndarray:
        words = text.lower().split()
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))

    def fresh_features(self) -> np.ndarray:
        got = np.array([word_features(w) for w in self.fresh], np.int32).reshape(-1, PER_WORD)
        self.fresh.clear()
        return got


def index_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each distinct word, index of each word of all texts, first word of each text and the end)."""
    seen = Words()
    parts = [seen.of(t) for t in texts]
    ends = np.cumsum([0] + [len(p) for p in parts])
    return seen.fresh_features(), np.concatenate(parts) if parts else np.empty(0, np.int32), ends


@dataclass
class Model:
    """embed BUCKETS x DIM; taps DIM x (TAPS * FILTERS); shift and out: FILTERS * widths; the rest calibration."""

    embed: np.ndarray
    taps: np.ndarray
    shift: np.ndarray
    out: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0
    thresholds: dict | None = None

    def responses(self, feats: np.ndarray) -> np.ndarray:
        """Of each distinct word under each tap; one row of zeros more, for the ends of texts."""
        x = self.embed[feats].sum(1)
        return np.concatenate([x @ self.taps, np.zeros((1, self.taps.shape[1]), np.float32)])

    def index(self, text: str) -> np.ndarray:
        """Rows of the table of responses (row 0: zeros) for a text's words; the table grows, and starts anew past MEMO words."""
        if "table" not in self.__dict__ or len(self.words) > MEMO:
            self.words, self.table, self.filled = Words(), np.zeros((1 << 14, self.taps.shape[1]), np.float32), 1
        got = self.words.of(text) + 1
        if self.words.fresh:
            new = self.embed[self.words.fresh_features()].sum(1) @ self.taps
            while self.filled + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[self.filled : self.filled + len(new)] = new
            self.filled += len(new)
        return got

    @staticmethod
    def windows(r: np.ndarray, words: np.ndarray, pad: int = -1) -> list[np.ndarray]:
        """Filter responses at every word, by width; windows run past the end over row ``pad``, of zeros."""
        padded = np.concatenate([words, np.full(max(WIDTHS) - 1, pad, words.dtype)])
        out, col = [], 0
        for w in WIDTHS:
            z = r[padded[: len(words)], col : col + FILTERS].copy()
            for k in range(1, w):
                z += r[padded[k : k + len(words)], col + k * FILTERS : col + (k + 1) * FILTERS]
            out.append(z)
            col += w * FILTERS
        return out

    def logits(self, texts: list[str]) -> np.ndarray:
        pooled = np.full((len(texts), len(WIDTHS) * FILTERS), -np.inf, np.float32)
        for i, text in enumerate(texts):
            own = self.index(text)
            for a in range(0, len(own), SPAN):
                z = self.windows(self.table, own[a : a + SPAN + max(WIDTHS) - 1], 0)
                pooled[i] = np.maximum(pooled[i], np.concatenate([x[:SPAN].max(0) for x in z]))
        pooled[~np.isfinite(pooled)] = 0
        return np.maximum(0, pooled + self.shift) @ self.out + self.bias

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(texts) + self.offset, -30, 30).astype(np.float64)))


class Adam:
    def __init__(self, shape, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(shape, np.float32), np.zeros(shape, np.float32), 0, rate

    def step(self, x: np.ndarray, g: np.ndarray, rows: np.ndarray | slice = slice(None)) -> None:
        """Only ``rows`` have a gradient."""
        self.t += 1
        m = self.m[rows] = 0.9 * self.m[rows] + 0.1 * g
        v = self.v[rows] = 0.99 * self.v[rows] + 0.01 * g * g
        x[rows] -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-6)


def start(hits: np.ndarray, n: np.ndarray, seed: int = 3) -> Model:
    """The untrained model; the first embedding axis is the smoothed log odds of a bucket's texts: ``hits`` by class and bucket, of ``n`` by class."""
    rnd = np.random.default_rng(seed)
    rates = hits / np.maximum(n, 1)[:, None] + 2 / max(1, n.min())
    odds = np.log(rates[1]) - np.log(rates[0])
    odds[hits.sum(0) == 0] = 0
    embed = rnd.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
    embed[:, 0] = np.clip(odds, -3, 5) / PER_WORD
    taps = rnd.normal(0, 0.15, (DIM, TAPS * FILTERS)).astype(np.float32)
    taps[0] = np.abs(taps[0]) + 0.2
    shift = np.zeros(len(WIDTHS) * FILTERS, np.float32)
    out = np.abs(rnd.normal(0, 0.2, len(shift))).astype(np.float32)
    return Model(embed, taps, shift, out, float(-out.sum()))


class Trainer:
    """Trains a copy of ``model`` on one lot of texts after another; ``met`` marks the buckets that had a gradient."""

    def __init__(self, model: Model, weights: np.ndarray, seed: int):
        self.weights, self.rnd = weights.astype(np.float32), np.random.default_rng([5, seed])
        self.bias = np.array([model.bias], np.float32)
        self.model = Model(model.embed.copy(), model.taps.copy(), model.shift.copy(), model.out.copy(), model.bias)
        self.met = np.zeros(BUCKETS, bool)
        of = {"embed": (self.model.embed, 0.01), "taps": (self.model.taps, 0.01), "shift": (self.model.shift, 0.01), "out": (self.model.out, 0.02), "bias": (self.bias, 0.02)}
        self.steps = {k: Adam(v.shape, rate) for k, (v, rate) in of.items()}

    def lot(self, texts: list[str], labels: np.ndarray) -> None:
        feats, words, ends = index_words(texts)
        y = labels.astype(np.float32)
        for _ in range(EPOCHS):
            order = self.rnd.permutation(len(texts))
            for a in range(0, len(order), BATCH):
                some = [i for i in order[a : a + BATCH] if ends[i + 1] > ends[i]]
                if some:
                    self.step(feats, [words[ends[i] : ends[i + 1]] for i in some], y[some])

    def step(self, feats: np.ndarray, own: list[np.ndarray], y: np.ndarray) -> None:
        m = self.model
        used, local = np.unique(np.concatenate(own), return_inverse=True)
        f, pad = feats[used], len(used)
        r = m.responses(f)
        best = np.empty((len(own), len(m.shift)), np.int64)
        pooled = np.full((len(own), len(m.shift)), -np.inf, np.float32)
        at, padded = 0, []
        for j, o in enumerate(own):
            w = local[at : at + len(o)]
            at += len(o)
            padded.append(np.concatenate([w, np.full(max(WIDTHS) - 1, pad)]))
            for b in range(0, len(w), SPAN):
                for k, z in enumerate(m.windows(r, w[b : b + SPAN + max(WIDTHS) - 1])):
                    s, z = slice(k * FILTERS, (k + 1) * FILTERS), z[:SPAN]
                    top, more = z.max(0), z.max(0) > pooled[j, s]
                    best[j, s] = np.where(more, z.argmax(0) + b, best[j, s])
                    pooled[j, s] = np.where(more, top, pooled[j, s])
        h = np.maximum(0, pooled + m.shift)
        p = 1 / (1 + np.exp(-np.clip(h @ m.out + self.bias[0], -30, 30)))
        d = (self.weights[y.astype(int)] * (p - y))[:, None] / len(own)
        d_out, d_h = (h * d).sum(0), d * m.out * (h > 0)
        d_taps, d_x = np.zeros_like(m.taps), np.zeros((pad + 1, DIM), np.float32)
        x = np.concatenate([m.embed[f].sum(1), np.zeros((1, DIM), np.float32)])
        col = np.cumsum([0] + [w * FILTERS for w in WIDTHS])
        for j in range(len(own)):
            for k, w in enumerate(WIDTHS):
                s = slice(k * FILTERS, (k + 1) * FILTERS)
                for tap in range(w):
                    word = padded[j][best[j, s] + tap]
                    c = slice(col[k] + tap * FILTERS, col[k] + (tap + 1) * FILTERS)
                    d_taps[:, c] += x[word].T * d_h[j, s]
                    np.add.at(d_x, word, d_h[j, s][:, None] * m.taps[:, c].T)
        hit = np.flatnonzero(np.abs(d_x[:-1]).sum(1))
        rows, inverse = np.unique(f[hit].ravel(), return_inverse=True)
        g = np.zeros((len(rows), DIM), np.float32)
        np.add.at(g, inverse, np.repeat(d_x[hit], PER_WORD, axis=0))
        self.met[rows] = True
        self.steps["embed"].step(m.embed, g, rows)
        self.steps["taps"].step(m.taps, d_taps)
        self.steps["shift"].step(m.shift, d_h.sum(0))
        self.steps["out"].step(m.out, d_out)
        self.steps["bias"].step(self.bias, np.array([d.sum()], np.float32))
        m.bias = float(self.bias[0])


def calibrate(model: Model, z: np.ndarray, y: np.ndarray, n: np.ndarray, langs: list[str | None], rate: float) -> None:
    """Platt's fit with classes weighted to ``rate``; then the threshold of each language with the best F1.

    ``n`` texts of language ``langs`` and label ``y`` have the logit ``z``.
    """
    z, y, n = z.astype(np.float64), y.astype(np.float64), n.astype(np.float64)
    n1, n0 = (n * y).sum(), (n * (1 - y)).sum()
    if not n1 or not n0:
        return
    weight = n * np.where(y == 1, rate / n1, (1 - rate) / n0)
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    center = np.average(z, weights=n)
    scale = np.sqrt(np.average((z - center) ** 2, weights=n)) + 1e-9
    x = (z - center) / scale
    a, b = 1.0, 0.0
    for _ in range(100):  # Newton
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(weight * (p - target) * x).sum() + 1e-4 * a, (weight * (p - target)).sum()])
        s = weight * p * (1 - p)
        hess = np.array([[(s * x * x).sum() + 1e-4, (s * x).sum()], [(s * x).sum(), s.sum() + 1e-8]])
        d = np.linalg.solve(hess, g)
        a, b = a - np.clip(d[0], -2, 2), b - np.clip(d[1], -2, 2)
    model.slope, model.offset = float(a / scale), float(b - a * center / scale)
    score = 1 / (1 + np.exp(-np.clip(model.slope * z + model.offset, -30, 30)))
    model.thresholds = {}
    for lang in {x for x in langs if x is not None}:
        own = np.array([x == lang for x in langs])
        if min((n * y)[own].sum(), (n * (1 - y))[own].sum()) < LEAST_OF_A_CLASS:
            continue
        s, at = np.unique(-score[own], return_inverse=True)
        s, w = -s, np.bincount(at, weight[own])
        hit = np.bincount(at, (weight * y)[own])
        f1 = 2 * np.cumsum(hit) / (np.cumsum(w) + hit.sum())
        k = int(f1.argmax())
        # Half-way to the next score down.
        model.thresholds[lang] = float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(s[k])


def fold(key: str) -> F.Column:
    """Rows of fold 2 are held out."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4))


def labelled_rows(docs: DataFrame, labels: DataFrame, folds: list[int], key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """(key, label, text, lang) of every labelled id in ``folds``; of several texts under one id the greatest counts, once."""
    here = F.col(key).isNotNull() & fold(key).isin(*folds)
    rows = labels.filter(F.col(label).isin(0, 1) & here).groupBy(key).agg(F.max(label).cast("int").alias(label))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    one = docs.select(key, "text", lang.alias("lang")).filter(here).groupBy(key).agg(F.max(F.struct("text", "lang")).alias("of"))
    return one.join(rows, key).select(key, label, "of.*")


def labelled_sample(docs: DataFrame, labels: DataFrame, folds: list[int], per_class: int, key: str = "doc_id", label: str = "toxic") -> tuple[list[str], np.ndarray, list[str | None]]:
    """For a look at the rows only, nothing is learned from it: at most ``per_class`` texts of each class out of ``folds``, in order of a hash of the key."""
    rows = labelled_rows(docs, labels, folds, key, label)
    one = [r for c in (0, 1) for r in rows.filter(F.col(label) == c).orderBy(F.xxhash64(F.lit(17), key), key).limit(per_class).collect()]
    one = sorted(one, key=lambda r: r[key])
    return [r["text"] or "" for r in one], np.array([r[label] for r in one], np.int64), [r["lang"] for r in one]


SUMS = "chunk int, place long, numbers binary"


def sums(parts: DataFrame) -> dict[int, np.ndarray]:
    """Of each chunk the sum of ``numbers`` (float32), in the order of ``place``, so the same under any partitions."""

    def run(batches):
        now, total = None, None
        for batch in batches:
            for chunk, raw in zip(column(batch, "chunk").to_pylist(), column(batch, "numbers").to_pylist()):
                if chunk != now:
                    if now is not None:
                        yield row_of(now, total)
                    now, total = chunk, 0.0
                total = total + np.frombuffer(raw, "<f4").astype(np.float64)
        if now is not None:
            yield row_of(now, total)

    row_of = lambda chunk, total: pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([total.astype("<f8").tobytes()], pa.binary())], names=["chunk", "total"])
    dealt = parts.repartition("chunk").sortWithinPartitions("chunk", "place")
    return {r["chunk"]: np.frombuffer(r["total"], "<f8") for r in map_batches(dealt, run, "chunk int, total binary").collect()}


def chunks(place: int, by_bucket: np.ndarray, rest: np.ndarray) -> pa.RecordBatch:
    """Rows of SUMS: of each chunk of buckets ``by_bucket``'s rows, unless all zero; ``rest`` under -1."""
    parts = {k: by_bucket[k * CHUNK : (k + 1) * CHUNK] for k in range(BUCKETS // CHUNK)}
    kept = {-1: rest} | {k: v for k, v in parts.items() if v.any()}
    numbers = [np.ascontiguousarray(v, "<f4").tobytes() for v in kept.values()]
    return pa.RecordBatch.from_arrays([pa.array(list(kept), pa.int32()), pa.array([place] * len(kept), pa.int64()), pa.array(numbers, pa.binary())], names=["chunk", "place", "numbers"])


def by_bucket(found: dict[int, np.ndarray], width: int) -> np.ndarray:
    none = np.zeros(CHUNK * width)
    return np.concatenate([found.get(k, none) for k in range(BUCKETS // CHUNK)]).reshape(BUCKETS, width)


def count_buckets(rows: DataFrame, label: str = "toxic") -> tuple[np.ndarray, np.ndarray]:
    """(texts of each class that hold a bucket, texts of each class)."""

    def run(batches):
        hits, n = np.zeros((BUCKETS, 2), np.int64), np.zeros(2, np.int64)
        for batch in slices(batches):
            y = column(batch, label).to_pylist()
            feats, words, ends = index_words([x or "" for x in column(batch, "text").to_pylist()])
            for i, c in enumerate(y):
                n[c] += 1
                hits[np.unique(feats[np.unique(words[ends[i] : ends[i + 1]])]), c] += 1
        if n.any():
            yield chunks(0, hits, n)

    found = sums(map_batches(rows.select(label, "text"), run, SUMS))
    return by_bucket(found, 2).T, found.get(-1, np.zeros(2))


def train(rows: DataFrame, hits: np.ndarray, n: np.ndarray, key: str = "doc_id", label: str = "toxic") -> Model:
    """Learns from all ``rows``, with the counts of ``count_buckets`` over them; column ``size`` holds their characters."""
    size = rows.agg(F.sum("size")).first()[0] or 0
    model = start(hits, n)
    if not n.sum():
        return model
    weights = n.sum() / 2 / np.maximum(n, 1) if n.all() else np.ones(2)
    shards = max(1, -(-size // SHARD_CHARS))
    sent = rows.sparkSession.sparkContext.broadcast(model)
    hashed = F.xxhash64(F.lit(17), key)
    dealt = rows.select(F.pmod(hashed, F.lit(shards)).alias("shard"), hashed.alias("hash"), key, label, "text")
    # By number: a hash would deal several shards to one task.
    dealt = dealt.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "hash", key).select("shard", label, "text")

    def learned(shard: int, t: Trainer, rows: int) -> pa.RecordBatch:
        a, b = sent.value, t.model
        moved = np.concatenate([b.embed - a.embed, np.ones((BUCKETS, 1), np.float32)], axis=1) * t.met[:, None]
        rest = rows * np.concatenate([(b.taps - a.taps).ravel(), b.shift - a.shift, b.out - a.out, [b.bias - a.bias, 1]])
        return chunks(shard, moved, rest)

    def run(batches):
        now, t, count, texts, y, held = None, None, 0, [], [], 0
        for batch in slices(batches, 64):
            for shard, c, text in zip(column(batch, "shard").to_pylist(), column(batch, label).to_pylist(), column(batch, "text").to_pylist()):
                text = text or ""
                if texts and (shard != now or held + len(text) > 2 * SHARD_CHARS):
                    t.lot(texts, np.array(y))
                    texts, y, held = [], [], 0
                if shard != now:
                    if now is not None:
                        yield learned(now, t, count)
                    now, t, count = shard, Trainer(sent.value, weights, shard), 0
                texts.append(text)
                y.append(c)
                held, count = held + len(text), count + 1
        if now is not None:
            t.lot(texts, np.array(y))
            yield learned(now, t, count)

    found = sums(map_batches(dealt, run, SUMS))
    moved, rest = by_bucket(found, DIM + 1), found[-1] / found[-1][-1]
    ends = np.cumsum([model.taps.size, len(model.shift), len(model.out)])
    add = lambda x, by: (x + by.reshape(x.shape)).astype(np.float32)
    taps, shift, out, bias = np.split(rest[:-1], ends)
    embed = add(model.embed, moved[:, :DIM] / np.maximum(moved[:, DIM:], 1))
    return Model(embed, add(model.taps, taps), add(model.shift, shift), add(model.out, out), float(model.bias + bias[0]))


def logits_of(rows: DataFrame, model: Model, label: str = "toxic") -> DataFrame:
    """Stored (z, label, lang) of all ``rows``."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        z = np.rint(sent.value.logits([x or "" for x in column(batch, "text").to_pylist()]).astype(np.float64) * STEPS)
        return pa.RecordBatch.from_arrays([pa.array(z.astype(np.int64)), column(batch, label), column(batch, "lang")], names=["z", "label", "lang"])

    schema = T.StructType([T.StructField("z", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("lang", rows.schema["lang"].dataType)])
    return written(arrow_map(rows.select(label, "text", "lang"), run, schema), "logits")


def logit_counts(*stored: DataFrame) -> list:
    """Rows (z, label, known, n) for all rows that ``logits_of`` stored, which are then deleted; a language without enough labels counts under null."""
    found = reduce(DataFrame.unionAll, stored)
    langs = found.groupBy("lang").agg(F.sum("label").alias("ones"), F.count("*").alias("all"))
    langs = langs.filter((F.col("ones") >= LEAST_OF_A_CLASS) & (F.col("all") - F.col("ones") >= LEAST_OF_A_CLASS)).select("lang", F.col("lang").alias("known"))
    got = found.join(langs, "lang", "left").groupBy("z", "label", "known").agg(F.count("*").alias("n")).collect()
    discard(*stored)
    return sorted(got, key=lambda r: (r["z"], r["label"], str(r["known"])))


def fit(docs: DataFrame, labels: DataFrame, whole: bool = False) -> Model:
    """Learns from every labelled row outside fold 2; if ``whole``, everything from every labelled row of all folds."""
    folds = [0, 1, 2, 3] if whole else [0, 1, 3]
    rows = labelled_rows(docs, labels, folds)
    rows = written(rows.select("*", fold("doc_id").alias("fold"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("size")), "labelled")
    first, rest = rows.filter("fold < 2"), rows.filter("fold >= 2")
    counted = count_buckets(first)
    if whole:
        other = count_buckets(rest)
        model = train(rows, *map(np.add, counted, other))
        # Neither model may have seen the texts whose logits it gives.
        judged = [(rest, train(first, *counted)), (first, train(rest, *other))] if counted[1].all() and other[1].all() else []
    else:
        model = train(first, *counted)
        judged = [(rest, model)]
    counts = {r["toxic"]: r["count"] for r in labels.filter(F.col("toxic").isin(0, 1) & fold("doc_id").isin(*folds)).groupBy("toxic").count().collect()}
    if judged and len(counts) == 2 and (got := logit_counts(*[logits_of(some, by) for some, by in judged])):
        z, y, n = (np.array([r[k] for r in got], np.float64) for k in ("z", "label", "n"))
        calibrate(model, z / STEPS, y, n, [r["known"] for r in got], counts[1] / (counts[0] + counts[1]))
    discard(rows)
    return model


def score_texts(df: DataFrame, model: Model, text: str = "text", lang: str = "lang") -> DataFrame:
    """``df`` plus score, threshold (its language's) and toxic (score at or above the threshold)."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    fresh = ("score", "threshold", "toxic")
    kept = [f for f in df.schema if f.name not in fresh]
    schema = T.StructType([*kept, T.StructField("score", T.DoubleType()), T.StructField("threshold", T.DoubleType()), T.StructField("toxic", T.BooleanType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = sent.value
        s = m.scores([x or "" for x in column(batch, text).to_pylist()])
        own = m.thresholds or {}
        t = np.array([own.get(x, THRESHOLD) for x in (column(batch, lang).to_pylist() if lang in batch.schema.names else [None] * batch.num_rows)])
        cols = [column(batch, f.name) for f in kept] + [pa.array(s), pa.array(t, pa.float64()), pa.array(s >= t)]
        return pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema])

    return arrow_map(df.select(*[F.col(f"`{f.name}`") for f in kept]), run, schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    out = score_texts(docs.select("doc_id", "text", "lang"), model)
    return out.select(
        "doc_id",
        F.coalesce(fold("doc_id") == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "threshold",
        "toxic",
    )
