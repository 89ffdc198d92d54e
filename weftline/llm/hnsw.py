"""Approximate nearest neighbours (5): a navigable small-world hierarchy per shard.

Vectors are dealt to shards by a hash of their id.  A shard takes what ``SHARD_BYTES``
hold; small tables are dealt to more and smaller shards, at least ``LEAST_ROWS`` each, up to
``LEAST_SHARDS``, so that they too are built side by side.  A shard's graph is built in one task and
stored as flat arrays (neighbour ids, levels, vectors).  In the search a task loads a shard's
arrays once and streams blocks of queries past them; each shard gives its nearest, scored again in
double precision on the original vectors, and the shards' answers are merged by rank.

Equal vectors are one node that holds their ``k + 1`` smallest ids: no more of
them can be among a query's ``k`` nearest, the query itself left out.

Edge cases: vectors that are null, of zero length, or hold null or
non-finite components take no part, neither as query nor as candidate; vectors
of another dimension than the query's are in no shard of its dimension; with fewer
than ``k`` candidates all are returned; ties go to the smaller id (among the ``ef`` that a walk finds);
repeated rows count once; of several vectors under one id the query takes the smallest, and a
result the nearest; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.common import column, discard, slices, table, written

SHARD_BYTES = 32 << 20
LEAST_ROWS = 2500
LEAST_SHARDS = 24
LINKS = 12
EF_BUILD = 60
EF_SEARCH = 80
BLOCK = 512
K = 5


class Graph:
    """``near[level]``: one row of neighbour ids a node, -1 where there is none."""

    def __init__(self, unit: np.ndarray, levels: np.ndarray, near: list[np.ndarray], entry: int):
        self.unit, self.levels, self.near, self.entry = unit, levels, near, entry

    @classmethod
    def build(cls, unit: np.ndarray, links: int = LINKS, ef: int = EF_BUILD, seed: int = 7) -> Graph:
        n = len(unit)
        rnd = np.random.default_rng(seed)
        levels = np.minimum((-np.log(1 - rnd.random(n)) / np.log(links)).astype(np.int64), 6)
        width = [2 * links] + [links] * int(levels.max(initial=0))
        near = [np.full((n, w), -1, np.int32) for w in width]
        fill = [np.zeros(n, np.int32) for _ in width]
        g = cls(unit, levels, near, 0)
        for x in range(1, n):
            q, top, at = unit[x], int(levels[g.entry]), [g.entry]
            for level in range(top, int(levels[x]), -1):
                at = [g.walk(q, at[0], level)]
            for level in range(min(top, int(levels[x])), -1, -1):
                found = g.search(q, at, level, ef)
                chosen = g.spread([k for _, k in found], [s for s, _ in found], links)
                near[level][x, : len(chosen)] = chosen
                fill[level][x] = len(chosen)
                for y in chosen:
                    f = fill[level][y]
                    if f < width[level]:
                        near[level][y, f] = x
                        fill[level][y] = f + 1
                    else:
                        own = np.append(near[level][y], x)
                        s = unit[own] @ unit[y]
                        order = np.argsort(-s, kind="stable")
                        kept = g.spread(own[order].tolist(), s[order].tolist(), width[level])
                        near[level][y] = -1
                        near[level][y, : len(kept)] = kept
                        fill[level][y] = len(kept)
                at = [k for _, k in found]
            if levels[x] > top:
                g.entry = x
        return g

    def spread(self, ids: list[int], sims: list[float], most: int) -> list[int]:
        """Of candidates in falling nearness, those nearer to the node than to any chosen before; then the nearest left over."""
        if len(ids) <= most:
            return ids
        v = self.unit[ids]
        among = v @ v.T
        chosen: list[int] = []
        rest: list[int] = []
        for k, s in enumerate(sims):
            if len(chosen) == most:
                break
            (rest if chosen and among[k, chosen].max() > s else chosen).append(k)
        chosen += rest[: most - len(chosen)]
        return [ids[k] for k in chosen]

    def walk(self, q: np.ndarray, at: int, level: int) -> int:
        best = float(self.unit[at] @ q)
        while True:
            own = self.near[level][at]
            own = own[own >= 0]
            if not len(own):
                return at
            s = self.unit[own] @ q
            k = int(s.argmax())
            if s[k] <= best:
                return at
            best, at = float(s[k]), int(own[k])

    def search(self, q: np.ndarray, entries: list[int], level: int, ef: int) -> list[tuple[float, int]]:
        """The ``ef`` nearest that a best-first walk finds, nearest first."""
        seen = np.zeros(len(self.unit), bool)
        seen[entries] = True
        s = self.unit[entries] @ q
        todo = [(-float(a), k) for a, k in zip(s, entries, strict=True)]
        best = [(float(a), k) for a, k in zip(s, entries, strict=True)]
        heapq.heapify(todo)
        heapq.heapify(best)
        while len(best) > ef:
            heapq.heappop(best)
        near, unit = self.near[level], self.unit
        while todo:
            d, x = heapq.heappop(todo)
            if -d < best[0][0] and len(best) >= ef:
                break
            own = near[x]
            own = own[own >= 0]
            own = own[~seen[own]]
            if not len(own):
                continue
            seen[own] = True
            for a, k in zip((unit[own] @ q).tolist(), own.tolist(), strict=True):
                if len(best) < ef:
                    heapq.heappush(best, (a, k))
                    heapq.heappush(todo, (-a, k))
                elif a > best[0][0]:
                    heapq.heapreplace(best, (a, k))
                    heapq.heappush(todo, (-a, k))
        return sorted(best, key=lambda x: (-x[0], x[1]))

    def nearest(self, q: np.ndarray, ef: int) -> list[int]:
        at = self.entry
        for level in range(int(self.levels[self.entry]), 0, -1):
            at = self.walk(q, at, level)
        return [k for _, k in self.search(q, [at], 0, ef)]

    def packed(self) -> bytes:
        return b"".join(x.astype("<i4").tobytes() for x in self.near)

    @classmethod
    def unpacked(cls, unit: np.ndarray, levels: np.ndarray, entry: int, flat: bytes, links: int = LINKS) -> Graph:
        a, n, near, at = np.frombuffer(flat, "<i4"), len(unit), [], 0
        for level in range(int(levels.max(initial=0)) + 1):
            w = 2 * links if level == 0 else links
            near.append(a[at : at + n * w].reshape(n, w))
            at += n * w
        return cls(unit, levels, near, entry)


def normed(x: np.ndarray) -> np.ndarray:
    return (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """key (long), v (array of double) and dim, without vectors that take no part."""
    v = F.col(vector).cast("array<double>")
    rows = df.select(F.col(key).cast("long").alias("id"), v.alias("v")).filter("id is not null and v is not null and size(v) > 0")
    rows = rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0))
    return rows.withColumn("dim", F.size("v"))


def score(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``x`` with ``q``; sums run from the first component to the last, so that the value does not depend on a library's order."""
    total = lambda v: np.cumsum(v, axis=-1)[..., -1]
    return total(x * q) / (np.sqrt(total(x * x)) * np.sqrt(total(q * q)))


INDEX = "dim int, shard int, ids binary, owners binary, vectors binary, levels binary, entry int, near binary"


def _runs(batch: pa.RecordBatch, names: tuple[str, ...]):
    """(values of ``names``, rows) of each run of rows that agree on them."""
    keys = list(zip(*(column(batch, c).to_pylist() for c in names), strict=True))
    start = 0
    for k in range(1, len(keys) + 1):
        if k == len(keys) or keys[k] != keys[start]:
            yield keys[start], batch.slice(start, k - start)
            start = k


def _index_task(batches):
    """Rows (dim, shard, v, ids) sorted by dim and shard; one row a shard."""

    def build(dim: int, shard: int, vectors: list[np.ndarray], ids: list[list[int]]) -> dict:
        x = np.concatenate(vectors)
        g = Graph.build(normed(x))
        owners = np.repeat(np.arange(len(x)), [len(i) for i in ids])
        return {
            "dim": dim, "shard": shard, "ids": np.concatenate([np.array(i, "<i8") for i in ids]).tobytes(), "owners": owners.astype("<i4").tobytes(),
            "vectors": x.astype("<f8").tobytes(), "levels": g.levels.astype("<i4").tobytes(), "entry": int(g.entry), "near": g.packed(),
        }

    schema = pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("ids", pa.binary()), ("owners", pa.binary()), ("vectors", pa.binary()), ("levels", pa.binary()), ("entry", pa.int32()), ("near", pa.binary())])
    now, vectors, ids = None, [], []
    for batch in batches:
        for key, run in _runs(batch, ("dim", "shard")):
            if key != now and ids:
                yield pa.RecordBatch.from_pylist([build(*now, vectors, ids)], schema=schema)
                vectors, ids = [], []
            now = key
            vectors.append(column(run, "v").flatten().to_numpy(zero_copy_only=False).reshape(-1, key[0]))
            ids += column(run, "ids").to_pylist()
    if ids:
        yield pa.RecordBatch.from_pylist([build(*now, vectors, ids)], schema=schema)


def shard_count(rows: int, dim: int, shard_bytes: int = SHARD_BYTES) -> int:
    """By memory: a vector stands there in double and single precision, beside its links.  Few rows are dealt wider."""
    fit = max(1, shard_bytes // (12 * dim + 16 * LINKS))
    return max(1, -(-rows // fit), min(LEAST_SHARDS, -(-rows // LEAST_ROWS)))


def build_index(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, shards: int | None = None) -> DataFrame:
    """One row per shard, written to the shared folder: every usable vector is in it."""
    rows = usable(df, key, vector)
    # Of equal vectors the k + 1 smallest ids; ranked in each map task first (a limit on groups), so a common vector is no hot key.
    # Adding zero makes -0.0 and 0.0 the same.
    rows = rows.select("id", "dim", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))
    few = rows.distinct().withColumn("r", F.row_number().over(W.partitionBy("v").orderBy("id"))).filter(F.col("r") <= k + 1)
    nodes = written(few.groupBy("v").agg(F.first("dim").alias("dim"), F.sort_array(F.collect_list("id")).alias("ids")), "nodes")
    n, widest = nodes.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(1))).first()
    shards = shards or shard_count(n, widest)
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64(F.element_at("ids", 1)), F.lit(shards)).cast("int"))
    built = dealt.repartition(max(shards, 2), "dim", "shard").sortWithinPartitions("dim", "shard", F.element_at("ids", 1)).mapInArrow(_index_task, INDEX)
    out = written(built, "index")
    discard(nodes)
    return out


FOUND = "query_id long, vec_id long, score double"


def _search_task(k: int, ef: int):
    """Rows sorted by shard, its arrays before the blocks of queries."""

    def load(row: dict):
        x = np.frombuffer(row["vectors"], "<f8").reshape(-1, row["dim"])
        first = np.searchsorted(np.frombuffer(row["owners"], "<i4"), np.arange(len(x) + 1))
        return x, Graph.unpacked(normed(x), np.frombuffer(row["levels"], "<i4"), row["entry"], row["near"]), np.frombuffer(row["ids"], "<i8"), first

    def run(batches):
        now = loaded = None
        for batch in slices(batches, 1):
            (row,) = batch.to_pylist()
            if row["vectors"] is not None:
                now, loaded = (row["dim"], row["shard"]), load(row)
                continue
            if now != (row["dim"], row["shard"]):
                continue
            x, g, ids, first = loaded
            qs = np.frombuffer(row["q"], "<f8").reshape(-1, row["dim"])
            out: tuple = ([], [], [])
            for q, u, own in zip(qs, normed(qs), np.frombuffer(row["q_ids"], "<i8").tolist(), strict=True):
                at = np.array(g.nearest(u, max(ef, 2 * k + 2)))
                best: dict[int, float] = {}
                for s, a in zip(score(x[at], q).tolist(), at.tolist(), strict=True):
                    for i in ids[first[a] : first[a + 1]].tolist():
                        if i != own and s > best.get(i, -2.0):
                            best[i] = s
                for i, s in heapq.nsmallest(k, best.items(), key=lambda p: (-p[1], p[0])):
                    out[0].append(own)
                    out[1].append(i)
                    out[2].append(s)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

    return run


def _pack_block(batches):
    for batch in slices(batches, 1):
        (row,) = batch.to_pylist()
        cols = [np.array([x["id"] for x in row["rows"]], "<i8").tobytes(), np.array([x["v"] for x in row["rows"]], "<f8").tobytes()]
        yield pa.RecordBatch.from_arrays([column(batch, "dim"), column(batch, "block"), *(pa.array([c], pa.binary()) for c in cols)], names=["dim", "block", "q_ids", "q"])


def search(queries: DataFrame, index: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, ef: int = EF_SEARCH) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest of the index, itself left out."""
    spark = queries.sparkSession
    q = usable(queries, key, vector).groupBy("id").agg(F.min(F.struct("dim", "v")).alias("least")).select("id", "least.*")
    n = q.count()
    q = q.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // BLOCK)))))
    packed = written(q.groupBy("dim", "block").agg(F.collect_list(F.struct("id", "v")).alias("rows")).mapInArrow(_pack_block, "dim int, block long, q_ids binary, q binary"), "blocks")
    # A shard's arrays go to one task, or where there are fewer shards than cores to several; each block of queries once to each shard of its dimension.
    shards = index.select("dim", "shard").groupBy("dim").agg(F.max("shard").alias("top"))
    total = index.count()
    splits = max(1, min(-(-n // BLOCK), spark.sparkContext.defaultParallelism // max(1, total)))
    arrays = [f.name for f in index.schema if f.name not in ("dim", "shard")]
    left = index.select("dim", "shard", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("part"), F.lit(0).alias("side"), *arrays, F.lit(None).cast("binary").alias("q_ids"), F.lit(None).cast("binary").alias("q"))
    each = packed.join(F.broadcast(shards), "dim").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("top"))))  # `shards`: a row per dimension
    right = each.select("dim", "shard", F.pmod("block", F.lit(splits)).cast("int").alias("part"), F.lit(1).alias("side"), *(F.lit(None).cast(index.schema[c].dataType).alias(c) for c in arrays), "q_ids", "q")
    dealt = left.unionByName(right).repartition(max(2, total * splits), "dim", "shard", "part").sortWithinPartitions("dim", "shard", "part", "side")
    found = dealt.mapInArrow(_search_task(k, ef), FOUND).repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors.filter("vec_id % 50 = 0"), build_index(vectors))


#: The exact answer; the query's equals it where the walks find every true neighbour, as on tables of a few thousand vectors.
OP5_SQL = f"""
WITH v AS (
  SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0
), u AS (
  SELECT *, sqrt(list_reduce(list_transform(x, lambda c: c * c), lambda a, b: a + b)) AS norm FROM v
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, max(list_reduce(list_transform(range(1, len(q.x) + 1), lambda i: c.x[i] * q.x[i]), lambda a, b: a + b) / (c.norm * q.norm)) AS score
  FROM (SELECT * FROM u WHERE vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY len(x), x) = 1) q JOIN u c ON c.vec_id <> q.vec_id AND len(c.x) = len(q.x)
  GROUP BY 1, 2
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= {K}
"""
