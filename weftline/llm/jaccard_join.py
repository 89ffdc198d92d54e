"""N-gram Jaccard join (6): signature trees, over candidates that no link escapes.

1. Every text becomes a set of 63-bit shingle hashes; equal sets become one
   class, named by a digest.
2. A linked pair differs in at most a quarter of either set.  So of a set's
   sampled shingles (hash below ``SAMPLE`` of the range, the same for all sets) all but
   n/4 also occur in the partner: sets with fewer shared ones link with nothing.
   Shingles travel as packed blobs in hash buckets; a bucket's task tells which
   occur in two sets or more.  (A set too small for its sample to tell uses the
   n/4 + 1 smallest hashes, of which the partner's hold one.)  Of what a set
   shares, the most frequent shingles that no partner can do without are then
   left out: the rest, its keys, still meets every partner.
3. First round: each remaining set goes to the groups of its most frequent and
   its smallest key, where a signature tree is walked against itself.
4. Second round: each key whose sets are not yet all in one component makes a
   group; trees are walked again, skipping sets of one component.  A set that
   shares a key with a large component of the first round is weighed against
   all of that component, once, rather than key by key.  Then every pair in two
   components that shares a key has been weighed, so the components are exact.

Large groups are split into blocks.  In the first round block meets block in a
chain, since it only has to find most links; in the second each pair of blocks
meets.  Rows that do not remain are never shuffled with their texts.

Classes and large components that many rows share are never one task's work: their rows meet
the other side by broadcast (a bounded number of keys), and the commonest keys of large components
meet under a salt.  Joins of rows of a few numbers elsewhere are left to adaptive execution, which splits a long partition.

Edge cases: null and empty texts have no shingles and link with nothing (the
component is their own id); an empty table gives an empty result; columns other than
key and text are not looked at, whatever their names; texts of fewer than five words are one shingle;
equal texts share a class; very long texts are read whole; repeated ids and null
ids are kept, row for row (a null id never names a component, but its text links
as any other does).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from weftline.llm.common import arrow_map, column, discard, fresh_path, join_counted, map_batches, mix64, remove_path, slices, table, window_hash
from weftline.llm.common import written as write_table
from weftline.llm.components import components
from weftline.llm.signature_tree import bitmap, possible_groups, tree_links, width

WORDS = 5
SAMPLE = 0.4
TOP = 1 << 63
CUT = int(SAMPLE * TOP)
BLOCK = 512
#: Bytes of a text that are hashed at a time.
PIECE = 1 << 16
#: From this many sets on, a component of the first round is compared as a whole, not key by key.
LARGE = 16
#: Rows of one key that meet its large components under one salt.
SALT_ROWS = 4096
#: The semi-join that picks remaining texts broadcasts their ids only below this size.
BROADCAST_BYTES = 8 << 20

# --- shingles -------------------------------------------------------------

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


class Powers:
    """Powers of the hash's base and of its inverse, grown to the longest piece seen."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> None:
        if n > len(self.up):
            size = 1 << (n - 1).bit_length()
            grow = lambda base: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)]))
            self.up, self.down = grow(_BASE), grow(_BASE_INVERSE)


_POWERS = Powers()


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, first byte) of each word of ``raw`` (bytes), A-Z as a-z.

    Worked off in pieces of ``PIECE`` bytes of whole words, so that only a longer word needs more room.
    """
    edge = np.diff(np.concatenate([[True], _SPACE[raw], [True]]).view(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        a = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, a + PIECE, "right")))
        part = raw[a : ends[to - 1]]
        _POWERS.to(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[_FOLD[part]] * _POWERS.up[: len(part)], out=total[1:])
        out[at:to] = (total[ends[at:to] - a] - total[starts[at:to] - a]) * _POWERS.down[starts[at:to] - a]
        at = to
    return mix64(out + (ends - starts).astype(np.uint64)), starts


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 63-bit hashes of each text's shingles."""
    out: list[np.ndarray] = []
    held, size = [], 0

    def flush() -> None:
        nonlocal held, size
        if not held:
            return
        raw = np.frombuffer(b" ".join(held) + b" ", np.uint8)
        starts = np.cumsum([0] + [len(x) + 1 for x in held])
        h, at = word_hashes(raw)
        first = np.searchsorted(at, starts)
        shingles = window_hash(h, words) >> np.uint64(1)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= words:
                s = np.sort(shingles[a : b - words + 1])
                out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
            elif b > a:
                out.append(window_hash(np.concatenate([h[a:b], np.full(1, b - a, np.uint64)]), b - a + 1) >> np.uint64(1))
            else:
                out.append(np.empty(0, np.uint64))
        held, size = [], 0

    for x in texts:
        held.append(x)
        size += len(x)
        if size > 1 << 19:
            flush()
    flush()
    return out


def digest(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes(), len(s)) - TOP if len(s) else 0


# --- step 2: who can link at all -------------------------------------------

FIRST = T.StructType(
    [
        T.StructField("kind", T.StringType()),  # m: a text, s: a shared shingle, h: a blob
        T.StructField("row", T.LongType()),
        T.StructField("fp", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("sampled", T.LongType()),
        T.StructField("last", T.LongType()),  # the prefix's last hash; of an s row, the shingle
        T.StructField("bucket", T.IntegerType()),
        T.StructField("blob", T.BinaryType()),
    ]
)


def _first_pass(key: str, text: str, buckets: int, key_type: pa.DataType):
    names = [key, *(f.name for f in FIRST if f.name != "row")]

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = [x or b"" for x in column(batch, text).cast(pa.binary()).to_pylist()]
        sets = shingle_sets(raw)
        n = np.array([len(s) for s in sets], np.int64)
        fps = np.array([digest(s) for s in sets], np.int64)
        sampled = np.array([np.searchsorted(s, np.uint64(CUT)) for s in sets], np.int64)
        prefix = n // 4 + 1
        last = np.array([int(s[p - 1]) if len(s) else -1 for s, p in zip(sets, prefix, strict=True)], np.int64)
        # Of each distinct set: what is sampled, and its prefix.
        _, own = np.unique(fps, return_index=True)
        own = own[n[own] > 0]
        take = [sets[k][: max(sampled[k], prefix[k])] for k in own]
        h = np.concatenate(take) if take else np.empty(0, np.uint64)
        f = np.repeat(fps[own], [len(t) for t in take]) if take else np.empty(0, np.int64)
        order = np.argsort(h, kind="stable")
        h, f = h[order], f[order]
        new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.empty(0, bool)
        start = np.flatnonzero(new)
        count = np.diff(np.append(start, len(h)))
        twice = np.repeat(count > 1, count)  # shared within this batch: told at once
        s_fp, s_h = f[twice], h[twice].astype(np.int64)
        one_h, one_f = h[start], np.where(count > 1, 0, f[start])
        bucket = (one_h & np.uint64(buckets - 1)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        one_h, one_f, bucket = one_h[by], one_f[by], bucket[by]
        b_ids, b_at = np.unique(bucket, return_index=True)
        b_end = np.append(b_at, len(bucket))[1:]
        blobs = [one_h[a:z].astype("<u8").tobytes() + one_f[a:z].astype("<i8").tobytes() for a, z in zip(b_at, b_end, strict=True)]
        nm, ns, nb = batch.num_rows, len(s_fp), len(blobs)
        nulls = lambda k, t: pa.nulls(k, t)
        cat = lambda *parts: pa.concat_arrays([p.combine_chunks() if isinstance(p, pa.ChunkedArray) else p for p in parts])
        cols = [
            cat(column(batch, key), nulls(ns + nb, key_type)),
            pa.array(["m"] * nm + ["s"] * ns + ["h"] * nb, pa.string()),
            cat(pa.array(fps), pa.array(s_fp), nulls(nb, pa.int64())),
            cat(pa.array(n), nulls(ns + nb, pa.int64())),
            cat(pa.array(sampled), nulls(ns + nb, pa.int64())),
            cat(pa.array(last), pa.array(s_h), nulls(nb, pa.int64())),
            cat(nulls(nm + ns, pa.int32()), pa.array(b_ids.astype(np.int32))),
            cat(nulls(nm + ns, pa.binary()), pa.array(blobs, pa.binary())),
        ]
        return pa.RecordBatch.from_arrays(cols, names=names)

    return rows


def _shared_in_buckets(batches):
    """Rows come sorted by bucket; a bucket's blobs are held together, no more."""

    def shared(blobs: list[bytes]) -> pa.RecordBatch | None:
        h = np.concatenate([np.frombuffer(b, "<u8", len(b) // 16) for b in blobs])
        f = np.concatenate([np.frombuffer(b, "<i8", len(b) // 16, len(b) // 2) for b in blobs])
        order = np.lexsort((f, h))
        h, f = h[order], f[order]
        new = np.concatenate([[True], h[1:] != h[:-1]])
        start = np.flatnonzero(new)
        count = np.diff(np.append(start, len(h)))
        # Two sets, or one entry that already stands for several (fp 0).
        other = np.concatenate([[False], (h[1:] == h[:-1]) & (f[1:] != f[:-1])])
        hit = np.logical_or.reduceat(other | (f == 0), start)
        first = np.concatenate([[True], (h[1:] != h[:-1]) | (f[1:] != f[:-1])])
        keep = np.repeat(hit, count) & (f != 0) & first
        if not keep.any():
            return None
        return pa.RecordBatch.from_arrays([pa.array(f[keep]), pa.array(h[keep].astype(np.int64))], names=["fp", "h"])

    now, held = None, []
    for batch in slices(batches, 16):
        for b, blob in zip(column(batch, "bucket").to_pylist(), column(batch, "blob").to_pylist(), strict=True):
            if b != now and held:
                if (got := shared(held)) is not None:
                    yield got
                held = []
            now = b
            held.append(blob)
    if held and (got := shared(held)) is not None:
        yield got


def text_bytes(df: DataFrame, text: str) -> int:
    """Bytes of all texts, counted: a planner's estimate may be off by any factor."""
    return df.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0


def classes_and_candidates(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(a row per text: key, n, fp), (a row per class: fp, rep, copies), (remaining classes: fp, n, rep, hs: keys, rarest first)."""
    spark = df.sparkSession
    size = text_bytes(df, text)
    buckets = 1 << max(10, min(20, int(size >> 22).bit_length()))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(buckets // 4, int(size >> 24) + 1))
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *(f for f in FIRST if f.name != "row")])
    path = fresh_path(spark, "shingles")
    arrow_map(df.select(key, text), _first_pass(key, text, buckets, to_arrow_type(df.schema[key].dataType)), schema).write.partitionBy("kind").parquet(path)
    stored = spark.read.schema(schema).parquet(path)
    texts = stored.filter("kind = 'm'").select(key, "fp", "n", "sampled", "last")
    reps = texts.filter("n > 0").groupBy("fp").agg(F.min(key).alias("rep"), F.first("n").alias("n"), F.first("sampled").alias("sampled"), F.first("last").alias("last"), F.count("*").alias("copies"))
    dealt = stored.filter("kind = 'h'").select("bucket", "blob").repartition(parts, "bucket").sortWithinPartitions("bucket")
    shared = map_batches(dealt, _shared_in_buckets, "fp long, h long").unionByName(stored.filter("kind = 's'").select("fp", F.col("last").alias("h")))
    per = shared.groupBy("fp").agg(F.array_sort(F.collect_set("h")).alias("hs"))
    # Of a set's sampled shingles a partner shares `least`; a set whose sample is no longer than its prefix is not judged by it.
    allowance = F.floor(F.col("n") / 4)
    judged = F.col("sampled") > allowance
    j = per.join(reps, "fp").select(
        "fp", "n", "rep", F.when(judged, F.col("sampled") - allowance).otherwise(1).alias("least"), F.when(judged, F.filter("hs", lambda h: h < F.lit(CUT))).otherwise(F.col("hs")).alias("hs")
    )
    left = remaining = write_table(j.filter(F.size("hs") >= F.col("least")), "remaining")
    # Once more among what remains; then of each set's shared shingles, rarest first, all but the last `least` - 1:
    # two sets that share `least` of them still share one of those.
    each = left.select("fp", "least", F.explode("hs").alias("h"))
    spread = each.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1")
    ranked = each.join(spread, "h").groupBy("fp").agg(F.first("least").alias("least"), F.array_sort(F.collect_list(F.struct("df", "h"))).alias("hs"))
    kept = ranked.filter(F.size("hs") >= F.col("least")).select(
        "fp", F.transform(F.slice("hs", F.lit(1), F.size("hs") - F.col("least").cast("int") + 1), lambda x: x["h"]).alias("hs")
    )
    candidates = write_table(left.select("fp", "n", "rep").join(kept, "fp"), "candidates")
    discard(remaining)
    for kind in "hs":
        remove_path(spark, f"{path}/kind={kind}")
    return texts.select(key, "n", "fp"), reps.select("fp", "rep", "copies"), candidates


# --- steps 3 and 4: groups and trees ----------------------------------------


def remaining_sets(df: DataFrame, left: DataFrame, key: str, text: str) -> DataFrame:
    """fp, packed shingles and bitmap of the remaining classes; texts are picked by the ids that stand for them, or where no row has an id, by what they hold."""
    ids = left.filter("rep is not null").select(F.col("rep").alias(key), "fp")
    size, named = left.agg(F.count("*"), F.count("rep")).first()
    picked = df.select(key, text).join(F.broadcast(ids) if named * 64 <= BROADCAST_BYTES else ids, key).select("fp", text)
    if size > named:
        picked = picked.unionByName(df.filter(F.col(key).isNull()).select(F.lit(None).cast("long").alias("fp"), text))

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets([x or b"" for x in column(batch, text).cast(pa.binary()).to_pylist()])
        return pa.RecordBatch.from_arrays([column(batch, "fp"), pa.array([digest(s) for s in sets], pa.int64()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary()), pa.array([bitmap(s, width(len(s))).tobytes() for s in sets], pa.binary())], names=["fp", "check", "tokens", "bits"])

    out = arrow_map(picked, pack, "fp long, check long, tokens binary, bits binary")
    if size > named:
        out = write_table(out, "packed")
        loose = out.filter("fp is null").drop("fp").withColumnRenamed("check", "fp").join(left.filter("rep is null").select("fp"), "fp", "left_semi")
        out = out.filter("check = fp").drop("check").unionByName(loose)
    else:
        out = out.filter("check = fp").drop("check")
    # Rows repeated under one id may hold other texts; equal ones are wanted once.
    return write_table(out.dropDuplicates(["fp"]), "sets")


def _tasks(batches, names: tuple[str, ...]):
    """Rows come sorted by task: (task, its rows)."""
    now, held = None, []
    for batch in slices(batches, 64):
        for task, *row in zip(*(column(batch, c).to_pylist() for c in ("task", *names)), strict=True):
            if task != now and held:
                yield now, held
                held = []
            now = task
            held.append(tuple(row))
    if held:
        yield now, held


def _walk(batches):
    """Links between classes, by trees over whole sets."""
    out = []
    for _, rows in _tasks(batches, ("side", "fp", "label", "tokens")):
        label: dict[int, int] = {}
        trees, names = [], []
        for side in (0, 1):
            own = list({r[1]: r for r in rows if r[0] == side}.values())
            if own:
                trees.append(([np.frombuffer(r[3], "<u8") for r in own], np.array([label.setdefault(r[2], len(label)) for r in own], np.int64)))
                names += [r[1] for r in own]
        if len(names) > 1 and len(label) > 1:
            out += [(names[a], names[b]) for a, b in tree_links(trees[0], trees[1] if len(trees) > 1 else None)]
        if len(out) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["u", "v"])
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["u", "v"])


def _sift(batches):
    """Of each task the sets that bitmaps cannot tell apart across labels, in groups named by what they hold."""
    for _, rows in _tasks(batches, ("side", "fp", "label", "n", "bits")):
        rows = list({(r[0], r[1]): r for r in rows}.values())
        label: dict[int, int] = {}
        labels = np.array([label.setdefault(r[2], len(label)) for r in rows], np.int64)
        if len(label) < 2:
            continue
        side = np.array([r[0] for r in rows])
        two = side.min() != side.max()
        groups = possible_groups([np.frombuffer(r[4], "<u8") for r in rows], np.array([r[3] for r in rows], np.int64), labels, side == 1 if two else None)
        for group in groups:
            fps = sorted({rows[k][1] for k in group})
            tag = np.frombuffer(np.array(fps, "<i8").tobytes(), np.uint8).tobytes()
            g = xxhash.xxh3_64_intdigest(tag) - TOP
            of = {rows[k][1]: rows[k][2] for k in group}
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(fps), pa.int64()), pa.array(fps, pa.int64()), pa.array([of[f] for f in fps], pa.int64())], names=["g", "fp", "label"])


def dealt_tasks(members: DataFrame, sets: DataFrame, every_pair: bool, parts: int) -> DataFrame:
    """Members (g, fp, label) of groups of two or more, with the columns of ``sets``, as tasks: a group, or a pair of its blocks."""
    counts = members.groupBy("g").agg(F.count("*").alias("rows")).filter("rows > 1").withColumn("blocks", F.ceil(F.col("rows") / BLOCK).cast("int"))
    m = members.join(counts, "g").withColumn("b", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    last = F.col("blocks") - 1
    mine = F.struct(F.col("b").alias("i"), F.col("b").alias("j"))
    if every_pair:
        others = F.transform(F.sequence(F.lit(0), last), lambda x: F.struct(F.least(x, F.col("b")).alias("i"), F.greatest(x, F.col("b")).alias("j")))
    else:
        others = F.filter(
            F.array(F.struct((F.col("b") - 1).alias("i"), F.col("b").alias("j")), mine, F.struct(F.col("b").alias("i"), (F.col("b") + 1).alias("j"))),
            lambda p: (p["i"] >= 0) & (p["j"] <= last),
        )
    tasks = m.select("g", "fp", "label", "b", F.explode(F.when(last > 0, others).otherwise(F.array(mine))).alias("p")).select(
        F.concat_ws(":", "g", "p.i", "p.j").alias("task"),
        (F.col("b") == F.col("p.j")).cast("int").alias("side"),
        "fp",
        "label",
    )
    return tasks.join(sets, "fp").repartition(parts, "task").sortWithinPartitions("task", "side", "fp")


def group_links(members: DataFrame, sets: DataFrame, every_pair: bool, parts: int) -> DataFrame:
    """Links found in the groups of ``members``."""
    return map_batches(dealt_tasks(members, sets.select("fp", "tokens"), every_pair, parts), _walk, "u long, v long")


def sifted(members: DataFrame, sets: DataFrame, every_pair: bool, parts: int) -> DataFrame:
    """Groups (g, fp, label), each once, of sets that may be linked across labels by their bitmaps."""
    return map_batches(dealt_tasks(members, bits_of(sets), every_pair, parts), _sift, "g long, fp long, label long").distinct()


def merged(groups: DataFrame) -> DataFrame:
    """``groups`` (g, fp, label), each taken whole into the largest group that any of its sets is in.

    Groups of like sets overlap in most of them; a set then travels about once, and every two sets of a group still meet.
    """
    sized = groups.join(groups.groupBy("g").agg(F.count("*").alias("size")), "g")
    best = sized.groupBy("fp").agg(F.max(F.struct("size", "g")).alias("best"))
    to = sized.join(best, "fp").groupBy("g").agg(F.max("best").alias("best")).select("g", F.col("best.g").alias("to"))
    return groups.join(to, "g").select(F.col("to").alias("g"), "fp", "label").distinct()


def component_labels(df: DataFrame, left: DataFrame, key: str, text: str) -> DataFrame:
    """node (fp), label (fp of the component) of all classes that link with another."""
    spark = df.sparkSession
    parts = max(12, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sets = remaining_sets(df, left, key, text)
    seeds = left.select(F.explode(F.array_distinct(F.array(F.element_at("hs", -1), F.array_min("hs")))).alias("g"), "fp", F.col("fp").alias("label"))
    # In both rounds trees over bitmaps alone go first; whole sets travel only for what these leave.
    sift = write_table(sifted(seeds, sets, False, parts), "sifted")
    first = write_table(group_links(sift, sets, False, parts), "links")
    discard(sift)
    bare = components(first)
    sizes = bare.groupBy("label").agg(F.count("*").alias("k"))
    labels = write_table(bare.join(sizes, "label"), "labels")
    # Second round: keys whose sets are in two components or more.
    of = left.join(labels, left["fp"] == labels["node"], "left")
    tagged = write_table(of.select("fp", F.coalesce("label", "fp").alias("label"), F.coalesce("k", F.lit(1)).alias("k"), F.explode("hs").alias("g")), "tagged")
    # Sets of small components meet in the groups of their keys; a group that stands for the same sets as another is walked once.
    small, is_large = tagged.filter(F.col("k") < LARGE), F.col("k") >= LARGE
    own = lambda c: F.when(~is_large, c)
    who = own(F.xxhash64("fp").cast("decimal(38,0)"))
    keys = tagged.groupBy("g").agg(F.min(own(F.col("label"))).alias("a"), F.max(own(F.col("label"))).alias("z"), F.count_if(~is_large).alias("rows"), F.sum(who).alias("who"), F.count("*").alias("all"), F.max(is_large).alias("large"))
    n = tagged.count()
    hot = F.col("large") & (F.col("all") > max(SALT_ROWS, n // SALT_ROWS))
    keys = write_table(keys.withColumn("hot", hot).filter("a != z or hot"), "keys")
    once = keys.filter("a != z").groupBy("rows", "who").agg(F.min("g").alias("g")).select("g", "rows")
    near = sifted(small.join(once, "g").select("g", "fp", "label"), sets, True, parts)
    # A set that shares a key with a large component is weighed against all of it, once.  The commonest keys (a bounded number) are dealt under salts.
    spots = tagged.filter(is_large).select("g", F.col("label").alias("whole")).distinct()
    if keys.filter("hot").isEmpty():
        met = tagged.join(spots, "g").select("fp", "label", "whole")
    else:
        common = F.broadcast(keys.filter("hot").select("g", F.ceil(F.col("all") / SALT_ROWS).cast("int").alias("salts")))
        plain = tagged.join(common, "g", "left_anti").join(spots, "g").select("fp", "label", "whole")
        salted = tagged.join(common, "g").withColumn("salt", F.pmod(F.xxhash64("fp"), F.col("salts")).cast("int"))
        spread = spots.join(common, "g").select("g", "whole", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        met = plain.unionByName(salted.join(spread, ["g", "salt"]).select("fp", "label", "whole"))
    guests = met.filter("label != whole").select("whole", "fp", "label").distinct()
    guests = write_table(guests, "guests")
    far = large_groups(guests, labels.select("node", "label"), sets, parts)
    both = write_table(near.unionByName(far), "sifted")
    whole = write_table(merged(both), "merged")
    second = write_table(group_links(whole, sets, True, parts), "links")
    out = components(first.unionByName(second))
    discard(sets, first, bare, labels, tagged, keys, guests, both, whole, second)
    return out


def large_groups(guests: DataFrame, labels: DataFrame, sets: DataFrame, parts: int) -> DataFrame:
    """Groups of ``guests`` (whole, fp, label) and members of the large component ``whole`` that bitmaps cannot tell apart, block by block on both sides."""
    calls = guests.groupBy("whole").agg(F.count("*").alias("guests"))
    homes = labels.groupBy("label").agg(F.count("*").alias("homes")).withColumnRenamed("label", "whole")
    sized = calls.join(homes, "whole").select("whole", "guests", "homes", F.ceil(F.col("guests") / BLOCK).cast("int").alias("far"), F.ceil(F.col("homes") / BLOCK).cast("int").alias("near"))
    sized = write_table(sized, "sized")
    homes = join_counted(labels.select(F.col("label").alias("whole"), F.col("node").alias("fp"), "label"), sized, "whole", "homes")
    task = lambda i, j: F.concat_ws(":", "whole", i, j)
    spot = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = homes.select("whole", "fp", "label", spot("near").alias("i"), every("far").alias("j")).select(task("i", "j").alias("task"), F.lit(0).alias("side"), "fp", "label")
    right = join_counted(guests, sized, "whole", "guests").select("whole", "fp", "label", spot("far").alias("j"), every("near").alias("i")).select(task("i", "j").alias("task"), F.lit(1).alias("side"), "fp", "label")
    dealt = left.unionByName(right).join(bits_of(sets), "fp").repartition(parts, "task").sortWithinPartitions("task", "side", "fp")
    return map_batches(dealt, _sift, "g long, fp long, label long").distinct()


def bits_of(sets: DataFrame) -> DataFrame:
    return sets.select("fp", "bits", F.floor(F.octet_length("tokens") / 8).alias("n"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row of ``df``: key, n_shingles, component_id (the smallest key reachable by links)."""
    rows = df.select(F.col(f"`{key}`").alias("row_key"), F.col(f"`{text}`").cast("string").alias("row_text"))
    texts, reps, left = classes_and_candidates(rows, "row_key", "row_text")
    labels = component_labels(rows, left, "row_key", "row_text")
    least = labels.join(reps, labels["node"] == reps["fp"]).groupBy("label").agg(F.min("rep").alias("least"))
    moved = labels.join(least, "label").select(F.col("node").alias("fp"), "least")
    named = write_table(reps.join(moved, "fp", "left").select("fp", "copies", F.coalesce("least", "rep").alias("component_id")), "named")
    discard(left, labels)
    # Equal texts make `fp` a hot key.
    full = join_counted(texts.filter("n > 0"), named, "fp", "copies").select("row_key", "n", "component_id")
    out = full.unionByName(texts.filter("n = 0").select("row_key", "n", F.col("row_key").alias("component_id")))
    return out.select(F.col("row_key").alias(key), F.col("n").alias("n_shingles"), "component_id")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, md5_number(CASE WHEN len(w) >= 5 THEN array_to_string(w[i:i+4], ' ') ELSE array_to_string(w, ' ') END) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM pairs JOIN n na ON na.doc_id = x JOIN n nb ON nb.doc_id = y WHERE 100 * c >= 75 * (na.n + nb.n - c)
), both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM d
  UNION
  SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) m USING (doc_id)
"""
