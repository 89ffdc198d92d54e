"""Sharding (4): a two-pass external shuffle made of DataFrame functions only.

Pass one scatters records uniformly into memory-sized buckets by a seeded hash
of their place in the input and counts each bucket.  Pass two gathers a bucket into
one array, puts it in the order of that hash, walks it with Fisher-Yates (the draws
are seeded hashes of bucket and step) and numbers its records.  Buckets laid end to
end are one random permutation, so cutting it into equal runs gives the law
``rows``: shard counts at most one apart.

Nothing depends on the task that does the work: a record's place is its file's name and
its row there (or, for rows that come from no file, a number that is written down first).
So a retried task, another number of partitions or of executors deals the same slots.

Edge cases: null texts count as empty and are kept; rows equal in every column
are kept, each in a slot of its own (places differ, so a third of all rows being
one record does not fill a bucket); extra or clashing columns travel inside a
struct; an empty table gives an empty result; with fewer rows than shards the last
shards stay empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.common import table, written

SHARDS = 24
SEED = 11
BUCKET_BYTES = 4 << 20
BUCKET_ROWS = 2048
WIDE = 6
ROW_OVERHEAD = 64


def seeded(seed: int, *what: Column) -> Column:
    """A hash of ``what`` in 32 hexadecimal digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *what))


def number(digits: Column) -> Column:
    """The first 15 digits as a number."""
    return F.conv(F.substring(digits, 1, 15), 16, 10).cast("long")


def place_in_file() -> Column:
    """Where a row of a file-based table stands: known to every task that reads it again."""
    return F.concat_ws(":", F.col("_metadata.file_name"), F.col("_metadata.row_index"))


def fisher_yates(rows: Column, bucket: Column, seed: int) -> Column:
    """The indices of ``rows`` (structs with ``h`` and ``place``): ordered by these, then shuffled by seeded draws.

    The indices stand side by side in one binary value, ``WIDE`` digits each, so that a swap copies bytes and no boxed array.
    """
    order = F.array_sort(F.transform(rows, lambda r, k: F.struct(r["h"].alias("h"), r["place"].alias("place"), k.alias("k"))))
    last = F.size(rows) - 1
    steps = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    draws = F.transform(steps, lambda i: F.struct(i.alias("i"), F.pmod(number(seeded(seed, bucket.cast("string"), i.cast("string"))), i + 1).cast("int").alias("j")))
    start = F.array_join(F.transform(order, lambda x: F.lpad(x["k"].cast("string"), WIDE, "0")), "").cast("binary")
    spot = lambda i: i * WIDE + 1
    entry = lambda a, i: F.substring(a, spot(i), F.lit(WIDE))

    def swap(a: Column, d: Column) -> Column:
        once = F.overlay(a, entry(a, d["j"]), spot(d["i"]), F.lit(WIDE))
        return F.overlay(once, entry(a, d["i"]), spot(d["j"]), F.lit(WIDE))

    # Handed on as a lambda's argument, the walk is run once, not once an index.
    walked = F.array(F.aggregate(draws, start, swap))
    return F.flatten(F.transform(walked, lambda w: F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(w, spot(i), F.lit(WIDE)).cast("string").cast("int"))))


def shuffle_into_shards(df: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, weight: str = "text", place: Column | None = None) -> DataFrame:
    """Rows of ``df`` as struct ``record``, with ``shard`` and gapless ``slot``.

    ``weight`` names the string column that dominates a record's size; it only
    sets how many buckets there are.  ``place`` tells rows apart and must be the same
    whenever a row is read again (``place_in_file``); without it rows are numbered and written down.
    """
    record = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("record")
    if place is None:
        placed = written(df.select(record, F.monotonically_increasing_id().cast("string").alias("place")), "scatter")
    else:
        placed = df.select(record, place.alias("place"))
    totals = placed.agg(F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length(f"record.`{weight}`"), F.lit(0)).cast("long") + ROW_OVERHEAD).alias("b")).first()
    n = totals["n"]
    buckets = max(1, -(-(totals["b"] or 0) // bucket_bytes), -(-n // BUCKET_ROWS))
    # Pass 1: scatter.
    hashed = placed.withColumn("h", seeded(seed, F.col("place")))
    dealt = hashed.withColumn("bucket", F.pmod(number(F.col("h")), F.lit(buckets)))
    # Bucket starts: one row per bucket, a running sum in two levels so that no
    # window sees more than sqrt(buckets) rows.
    side = max(1, int(buckets**0.5))
    counts = dealt.groupBy("bucket").agg(F.count("*").alias("rows")).withColumn("block", F.floor(F.col("bucket") / side))
    blocks = counts.groupBy("block").agg(F.sum("rows").alias("block_rows"))
    blocks = blocks.select("block", (F.sum("block_rows").over(W.orderBy("block")) - F.col("block_rows")).alias("block_start"))
    starts = counts.join(blocks, "block").select(
        "bucket", (F.col("block_start") + F.sum("rows").over(W.partitionBy("block").orderBy("bucket")) - F.col("rows")).alias("start")
    )
    # Pass 2: one array per bucket, shuffled in place.
    shuffled = (
        dealt.groupBy("bucket")
        .agg(F.collect_list(F.struct("h", "place", "record")).alias("rows"))
        .join(starts, "bucket")
        .withColumn("walk", fisher_yates(F.col("rows"), F.col("bucket"), seed))
        .select("start", F.posexplode(F.transform("walk", lambda k: F.element_at("rows", k + 1)["record"])).alias("i", "record"))
        .select((F.col("start") + F.col("i")).alias("at"), "record")
    )
    # The first `wide` shards hold one row more than the others.
    least, wide = divmod(n, shards)
    edge = F.lit(wide * (least + 1))
    long_side = F.col("at") < edge
    shard = F.when(long_side, F.floor(F.col("at") / (least + 1))).otherwise(wide + F.floor((F.col("at") - edge) / max(least, 1)))
    slot = F.when(long_side, F.pmod("at", F.lit(least + 1))).otherwise(F.pmod(F.col("at") - edge, F.lit(max(least, 1))))
    return shuffled.select("record", shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, in slot order; the record's fields stand inside ``record``, where no name clashes."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op4_shuffle_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shuffle_into_shards(table(spark, sf_dir, "documents"), place=place_in_file())
    text = F.coalesce(F.col("record.text"), F.lit(""))
    return out.select(
        F.col("record.doc_id").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


#: For a table of one file, whose rows DuckDB numbers in the file's order.  The walk is the same Fisher-Yates; crc32 is
#: computed bit by bit from its polynomial, eight input bits a step by a table made of the same rule.
OP4_SQL = f"""
WITH RECURSIVE octets AS (
  SELECT b, c FROM (
    SELECT b, list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) AS c FROM (SELECT unnest(range(256)) AS b))
), t AS (SELECT list(c ORDER BY b) AS of FROM octets),
d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS raw, text, md5('{SEED}:documents.parquet:' || (row_number() OVER () - 1)) AS h FROM documents
), sized AS (
  SELECT count(*) AS n, greatest(1, CAST(ceil(coalesce(sum(coalesce(strlen(text), 0) + {ROW_OVERHEAD}), 0) / {BUCKET_BYTES}) AS BIGINT), CAST(ceil(count(*) / {BUCKET_ROWS}) AS BIGINT)) AS buckets FROM d
), dealt AS (
  SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY h) - 1 AS k FROM (SELECT d.*, CAST('0x' || substr(h, 1, 15) AS BIGINT) % buckets AS bucket FROM d, sized)
), held AS (
  SELECT bucket, count(*) AS rows, sum(count(*)) OVER (ORDER BY bucket) - count(*) AS start FROM dealt GROUP BY bucket
), walk AS (
  SELECT bucket, rows, 0 AS i, range(rows) AS a FROM held
  UNION ALL
  SELECT bucket, rows, i + 1, CASE WHEN j = i + 1 THEN a ELSE list_concat(a[1:j], [a[i+2]], a[j+2:i+1], [a[j+1]], a[i+3:]) END
  FROM (SELECT *, CAST('0x' || substr(md5('{SEED}:' || bucket || ':' || (i + 1)), 1, 15) AS BIGINT) % (i + 2) AS j FROM walk WHERE i + 1 < rows)
), done AS (
  SELECT bucket, unnest(a) AS k, unnest(range(rows)) AS i FROM walk WHERE i = greatest(rows - 1, 0)
), laid AS (
  SELECT dealt.*, CAST(start + done.i AS BIGINT) AS pos FROM done JOIN held USING (bucket) JOIN dealt USING (bucket, k)
), crc AS (
  SELECT h, xor(list_reduce(list_transform(regexp_extract_all(hex(raw), '..'), lambda x: CAST('0x' || x AS BIGINT)),
    lambda c, b: xor(c >> 8, of[1 + xor(c & 255, b)]), 4294967295), 4294967295) AS crc FROM laid, t
)
SELECT doc_id, CAST(octet_length(raw) + 8 AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'rows' AS law,
  CAST(CASE WHEN pos < edge THEN pos // (least + 1) ELSE wide + (pos - edge) // greatest(least, 1) END AS INTEGER) AS shard,
  CAST(CASE WHEN pos < edge THEN pos % (least + 1) ELSE (pos - edge) % greatest(least, 1) END AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM laid JOIN crc USING (h), (SELECT n // {SHARDS} AS least, n % {SHARDS} AS wide, (n % {SHARDS}) * (n // {SHARDS} + 1) AS edge FROM sized)
"""
