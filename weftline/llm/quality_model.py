"""Quality classifier (10): ordinal cumulative-link regression on graded ratings.

Grade y of a text has P(y >= k) = sigmoid(w . x - t_k): one weight vector over
hashed text features, shared by all grades, and thresholds t_1 < t_2 < ...
Out of these come the expected grade and the tail probability by which texts
are selected.

x is the mean over a text's words of hashed one-hot features: the word, its
shape (letters and digits folded, the rest kept), and whether it repeats the word
before; so a text's score is one sum over its words and texts of any length
compare.

Ratings: 0 poor, 1 good but toxic, 2 good.  Bound: fitted on at most
``TRAIN_ROWS`` labelled rows (``TRAIN_CHARS`` characters of each), balanced by grade; intercepts then shift back to
the grades' own rates.

Edge cases: null and empty texts have x = 0; grades that no row has leave their threshold at
its neighbour's, and without any rating all texts grade alike; an id rated twice has its lower grade; repeated rows
score alike; columns named as the results are replaced; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import arrow_map, column, table

TRAIN_ROWS = 3000
#: A text of the training sample is read up to here (grading reads whole texts).
TRAIN_CHARS = 100_000
BUCKETS = 1 << 16
STEPS = 150
MEMO = 200_000
LETTERS = re.compile(r"[^\W\d_]+")
SELECT_FROM = 1
SELECT_AT = 0.5


def case(s: str) -> str:
    return "a" if s.islower() else "A" if s.isupper() and len(s) > 1 else "Aa" if s[0].isupper() else "x"


def shape(word: str) -> str:
    bare = word.rstrip(".,!")
    if bare.isalpha():
        return case(bare) + word[len(bare) :][:8]
    return re.sub(r"\d+", "9", LETTERS.sub(lambda m: case(m[0]), word))[:24]


def features(word: str) -> tuple[int, int]:
    return xxhash.xxh32_intdigest(word.lower()) % BUCKETS, xxhash.xxh32_intdigest("\0" + shape(word)) % BUCKETS


REPEAT = xxhash.xxh32_intdigest("\0\0again") % BUCKETS


@dataclass
class Ordinal:
    weights: np.ndarray
    cuts: np.ndarray  # rising

    def tails(self, s: np.ndarray) -> np.ndarray:
        """P(y >= k) for k = 1 .. K-1, one column each."""
        return 1 / (1 + np.exp(-np.clip(s[:, None] - self.cuts[None, :], -30, 30)))


class Scorer(dict):
    """What each word adds, remembered."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def __missing__(self, word: str) -> float:
        a, b = features(word)
        v = self[word] = float(self.weights[a] + self.weights[b])
        return v

    def of(self, text: str) -> float:
        words = text.split()
        if not words:
            return 0.0
        if len(self) > MEMO:
            self.clear()
        again = sum(map(str.__eq__, words[1:], words))
        return (sum(map(self.__getitem__, words)) + again * float(self.weights[REPEAT])) / len(words)


def design(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) triples."""
    rows, cols, vals = [], [], []
    memo: dict[str, tuple[int, int]] = {}
    for i, t in enumerate(texts):
        words = t.split()
        if not words:
            continue
        flat = []
        for w in words:
            f = memo.get(w)
            if f is None:
                f = memo[w] = features(w)
            flat += f
        flat += [REPEAT] * sum(map(str.__eq__, words[1:], words))
        c, n = np.unique(np.array(flat, np.int64), return_counts=True)
        rows.append(np.full(len(c), i))
        cols.append(c)
        vals.append(n / len(words))
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(vals)


def train(texts: list[str], grades: np.ndarray, k: int, rates: np.ndarray | None = None, l2: float = 1e-4) -> Ordinal:
    """Maximum likelihood by Adam; thresholds as a first cut and positive gaps."""
    if not len(texts):
        return Ordinal(np.zeros(BUCKETS, np.float32), np.arange(k - 1, dtype=float))
    rows, cols, vals = design(texts)
    n = len(texts)
    w, theta = np.zeros(BUCKETS), np.concatenate([[-1.0], np.zeros(k - 2)])
    m, v = np.zeros(BUCKETS + k - 1), np.zeros(BUCKETS + k - 1)
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    for t in range(1, STEPS + 1):
        s = np.bincount(rows, weights=vals * w[cols], minlength=n)
        cuts = theta[0] + np.concatenate([[0], np.cumsum(np.exp(theta[1:]))])
        upper = np.concatenate([np.ones((n, 1)), sig(s[:, None] - cuts[None, :]), np.zeros((n, 1))], 1)
        a, b = upper[np.arange(n), grades], upper[np.arange(n), grades + 1]
        p = np.maximum(a - b, 1e-9)
        d_s = -(a * (1 - a) - b * (1 - b)) / p / n
        d_cut = np.zeros(k - 1)
        for g in range(1, k):
            d_cut[g - 1] = (a * (1 - a) / p)[grades == g].sum() / n - (b * (1 - b) / p)[grades == g - 1].sum() / n
        d_w = np.bincount(cols, weights=vals * d_s[rows], minlength=BUCKETS) + l2 * w
        d_t = np.array([d_cut.sum(), *(d_cut[j:].sum() * np.exp(theta[j]) for j in range(1, k - 1))])
        g = np.concatenate([d_w, d_t])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.3 * (1 - t / (STEPS + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w -= step[:BUCKETS]
        theta -= step[BUCKETS:]
    cuts = theta[0] + np.concatenate([[0], np.cumsum(np.exp(theta[1:]))])
    if rates is not None and len(texts):
        # Back from balanced grades to the rates of the labels: each cut moves by the change of its log odds.
        seen = np.bincount(grades, minlength=k) / n
        up = lambda q: np.clip(np.cumsum(q[::-1])[::-1][1:], 1e-6, 1 - 1e-6)
        cuts = cuts - (np.log(up(rates) / (1 - up(rates))) - np.log(up(seen) / (1 - up(seen))))
        cuts = np.maximum.accumulate(cuts)
    return Ordinal(w.astype(np.float32), cuts)


GRADES = 3


def rated(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    return labels.filter(F.col("quality").isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.min(grade.cast("int")).alias("grade"))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, skip_fold: int | None = None, key: str = "doc_id") -> Ordinal:
    """On a bounded sample of rated texts; rows of ``skip_fold`` (crc32 of the key mod 4) are never looked at."""
    r = rated(labels, key)
    if skip_fold is not None:
        r = r.filter(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) != skip_fold)
    counts = {x["grade"]: x["count"] for x in r.groupBy("grade").count().collect()}
    picked = None
    for g in range(GRADES):
        some = r.filter(F.col("grade") == g).orderBy(F.xxhash64(F.lit(29), key), key).limit(rows // GRADES)
        picked = some if picked is None else picked.unionByName(some)
    found = docs.select(key, F.substring("text", 1, TRAIN_CHARS).alias("text")).join(F.broadcast(picked), key)
    # Of several texts under one id the greatest counts, once.
    got = sorted(found.groupBy(key).agg(F.max("grade").alias("grade"), F.max("text").alias("text")).collect(), key=lambda x: x[key])
    total = max(1, sum(counts.values()))
    rates = np.array([counts.get(g, 0) / total for g in range(GRADES)])
    return train([x["text"] or "" for x in got], np.array([x["grade"] for x in got], np.int64), GRADES, rates)


def grade_texts(df: DataFrame, model: Ordinal, text: str = "text", select_from: int = SELECT_FROM, select_at: float = SELECT_AT) -> DataFrame:
    """``df`` plus expected_grade, tail_probability (of a grade of ``select_from`` or more) and selected."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    fresh = ("expected_grade", "tail_probability", "selected")
    kept = [f for f in df.schema if f.name not in fresh]
    schema = T.StructType([*kept, T.StructField("expected_grade", T.DoubleType()), T.StructField("tail_probability", T.DoubleType()), T.StructField("selected", T.BooleanType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = sent.value
        scorer = m.__dict__.setdefault("scorer", Scorer(m.weights))
        tails = m.tails(np.array([scorer.of(x or "") for x in column(batch, text).to_pylist()]))
        tail = tails[:, select_from - 1]
        cols = [column(batch, f.name) for f in kept] + [pa.array(tails.sum(1)), pa.array(tail), pa.array(tail >= select_at)]
        return pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema])

    return arrow_map(df.select(*[F.col(f"`{f.name}`") for f in kept]), run, schema)


def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), skip_fold=2)
    return grade_texts(docs.select("doc_id", "text"), model).select("doc_id", "expected_grade", "tail_probability", "selected")
