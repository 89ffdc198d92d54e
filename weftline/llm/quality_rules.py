"""Quality rules (2): a short-circuit cascade.

Each rule says whether a text is rejected.  Cost and rejection share of every
rule are estimated on a bounded sample; rules then run in falling order of
rejections per second, and a text meets no rule after the first that rejects
it.  All rules are pure, so the order changes the cost and never the verdict.

Edge cases: null text is the empty text (no words: rejected by the base rule);
very long texts are read whole; empty tables give empty results; columns of the
input that the operator does not name are carried along untouched.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import WordHash, arrow_map, column, table, texts_of, window_hash

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
CONTINUATION = bytes(range(0x80, 0xC0))
UPPER = bytes(range(0x41, 0x5B))
LOWER = bytes(range(0x61, 0x7B))

#: At most this many rows are looked at to estimate cost and selectivity.
SAMPLE_ROWS = 2000
#: Of a sampled text so many characters are timed; the cascade itself reads whole texts.
SAMPLE_CHARS = 100_000

_HASH = WordHash()


class Text:
    """One text; every statistic is computed when a rule first asks for it."""

    def __init__(self, raw: bytes):
        self.raw = raw

    def without(self, chars: bytes) -> int:
        return len(self.raw.translate(None, chars))

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return self.without(SPACE + CONTINUATION)

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - self.without(SYMBOLS)

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip(SPACE)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        n = self.n_words
        if n < 3:
            return 0
        _, inverse, counts = np.unique(window_hash(_HASH.of(self.words), 3), return_inverse=True, return_counts=True)
        hit = counts[inverse] > 1
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= hit
        return int(covered.sum())

    @cached_property
    def upper_lower(self) -> tuple[int, int]:
        return len(self.raw) - self.without(UPPER), len(self.raw) - self.without(LOWER)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


#: The base rule of the contract, as two rules, and four more.
BASE = (
    Rule("too_short", lambda t: t.n_words < 50),
    Rule("repeated_words", lambda t: 100 * t.n_repeat_words > 50 * t.n_words),
)
RULES = (
    *BASE,
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words),
    Rule("repeated_lines", lambda t: 10 * t.n_dup_lines > 5 * len(t.lines)),
    Rule("shouting", lambda t: t.upper_lower[0] > t.upper_lower[1]),
    Rule("word_length", lambda t: not 2 * t.n_words <= t.word_chars <= 15 * t.n_words),
)


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    seconds: float
    share: float

    @property
    def gain(self) -> float:
        return self.share / max(self.seconds, 1e-9)


def sample_texts(df: DataFrame, text: str, key: str, rows: int = SAMPLE_ROWS) -> list[bytes]:
    """About ``rows`` texts (never more than twice that), spread over the table by a hash of ``key``."""
    n = df.count()
    step = max(1, n // rows)
    got = df.filter(F.pmod(F.xxhash64(F.lit(5), F.col(key)), F.lit(step)) == 0).select(F.encode(F.substring(F.coalesce(F.col(text), F.lit("")), 1, SAMPLE_CHARS), "UTF-8").alias("b")).limit(2 * rows).collect()
    return [bytes(r.b) for r in got]


def order_rules(rules: tuple[Rule, ...], texts: list[bytes]) -> list[Estimate]:
    """Rules in falling order of rejections per second, as measured on ``texts``."""
    found = []
    for rule in rules:
        began, hits = time.perf_counter(), 0
        for raw in texts:
            hits += rule.rejects(Text(raw))
        found.append(Estimate(rule, (time.perf_counter() - began) / max(1, len(texts)), hits / max(1, len(texts))))
    return sorted(found, key=lambda e: -e.gain)


def quality_cascade(df: DataFrame, text: str = "text", key: str = "doc_id", rules: tuple[Rule, ...] = RULES, stats: bool = False) -> DataFrame:
    """``df`` plus ``kept`` and ``rejected_by`` (null if kept); with ``stats`` also the base statistics.

    The added columns replace columns of the same name.
    """
    names = [e.rule.name for e in order_rules(rules, sample_texts(df, text, key))]
    added = [T.StructField("kept", T.BooleanType()), T.StructField("rejected_by", T.StringType())]
    if stats:
        added += [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [T.StructField("base_failed", T.BooleanType())]
    fresh = {f.name for f in added}
    keep = [c for c in df.columns if c not in fresh or c == text]
    schema = T.StructType([df.schema[c] for c in keep] + added)
    # Rules hold lambdas of this module: ship their names when they are ours.
    own = {r.name: r for r in RULES}
    ordered = [r if own.get(r.name) is not r else r.name for n in names for r in rules if r.name == n]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cascade = [own[r] if isinstance(r, str) else r for r in ordered]
        docs = [Text(x) for x in texts_of(batch, text)]
        by = [next((r.name for r in cascade if r.rejects(d)), None) for d in docs]
        cols = [column(batch, c) for c in keep] + [pa.array([x is None for x in by], pa.bool_()), pa.array(by, pa.string())]
        if stats:
            for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"):
                cols.append(pa.array([getattr(d, c) for d in docs], pa.int64()))
            cols.append(pa.array([any(r.rejects(d) for r in BASE) for d in docs], pa.bool_()))
        return pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema])

    return arrow_map(df.select(*[F.col(f"`{c}`") for c in keep]), run, schema)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality_cascade(docs, stats=True)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("kept")).alias("kept"))


OP2_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
), win AS (
  SELECT rid, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1
), covered AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i+1, i+2]) AS p FROM twice) GROUP BY rid
), s AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines,
    length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^a-z]', '', 'g')) AS n_lower
  FROM w LEFT JOIN covered USING (rid)
), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 5 * n_lines OR n_upper > n_lower
       OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept
FROM b
"""
