"""Profiles of runs and drift between them, on any long table of values.

A profile row is one field of one run: n, nulls, kinds (kind, n and first place),
median, min, max.  Drift compares a run with the runs before it.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions import scalars as S

MEDIAN_SHIFT, ROW_SHIFT, NULL_SHIFT, MIN_HISTORY = 0.15, 0.5, 0.3, 3


def summarise(cells: DataFrame, run: list[str]) -> DataFrame:
    """From long cells (run..., row_index, field, raw, v_str, v_num, v_list): run..., field, n, nulls, kinds, median, min, max.

    Kinds are counted first, so the second aggregate sees a row per kind and not per value.
    """
    empty = F.col("v_str").isNull() & F.col("v_num").isNull() & (F.coalesce(F.size("v_list"), F.lit(0)) <= 0)
    kind = F.when(F.col("v_list").isNotNull(), F.concat(F.lit("items-"), F.size("v_list").cast("string"))).otherwise(S.kind_of("raw"))
    c = cells.withColumn("empty", empty).withColumn("kind", F.when(~empty, kind))
    kinds = (
        c.filter("not empty").groupBy(*run, "field", "kind").agg(F.count("*").alias("n"), F.min("row_index").alias("first"))
        .groupBy(*run, "field").agg(F.array_sort(F.collect_list(F.struct("first", "kind", "n"))).alias("kinds"))
    )
    stats = c.groupBy(*run, "field").agg(
        F.count_if(~F.col("empty")).alias("n"), F.count_if("empty").alias("nulls"), F.median("v_num").alias("median"), F.min("v_num").alias("min"), F.max("v_num").alias("max")
    )
    return stats.join(kinds, [*run, "field"], "left")


def modal(df: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value of each group; of equals the one first in ``order``."""
    counted = df.groupBy(*by, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    best = F.max_by(value, F.struct("n", (-F.col("first")).alias("early")))
    return counted.groupBy(*by).agg(best.alias(value), F.max("n").alias("n"))


def dominant_kind(kinds: Column) -> Column:
    """Of (first, kind, n) in order of first: the kind with the largest n, the earliest on ties."""
    start = F.struct(F.lit(None).cast("string").alias("kind"), F.lit(0).cast("long").alias("n"))
    best = F.aggregate(kinds, start, lambda a, k: F.when(k["n"] > a["n"], F.struct(k["kind"].alias("kind"), k["n"].cast("long").alias("n"))).otherwise(a))
    return best["kind"]


def merged_kinds(kinds: Column) -> Column:
    """Of (first, kind, n) of several runs, in order of run and first: one of each kind, n added up, in order of first appearance."""
    names = F.array_distinct(F.transform(kinds, lambda k: k["kind"]))
    total = lambda name: F.aggregate(kinds, F.lit(0).cast("long"), lambda a, k: a + F.when(k["kind"] == name, k["n"].cast("long")).otherwise(F.lit(0).cast("long")))
    return F.transform(names, lambda name: F.struct(name.alias("kind"), total(name).alias("n")))


def baseline(history: DataFrame, seeds: DataFrame | None, current_ts: str, limit: int = 30, min_history: int = MIN_HISTORY) -> DataFrame:
    """The last ``limit`` runs but the current one, with fixture runs not yet among them while history is short."""
    recent = history.withColumn("_r", F.dense_rank().over(W.orderBy(F.col("ts").desc()))).filter(F.col("_r") <= limit).drop("_r")
    if seeds is not None and recent.select("ts").distinct().count() < min_history:
        recent = seeds.join(recent.select("ts").distinct(), "ts", "left_anti").unionByName(recent)
    return recent.filter(F.col("ts") != current_ts)


RECORD = "ts string, rows long, field string, n long, nulls long, kinds array<struct<first:int,kind:string,n:long>>, median double, min double, max double"
FIELDS = [c.split(" ", 1)[0] for c in RECORD.split(", ")]


def history_path(root: str, name: str) -> Path:
    return Path(root, name, "history.jsonl")


def append_run(root: str, name: str, record: DataFrame) -> None:
    """One line a run: its profile rows, one a field."""
    run = [r.asDict(recursive=True) for r in record.select(*FIELDS).collect()]
    path = history_path(root, name)
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("a") as out:
        out.write(json.dumps(run) + "\n")


def load_history(spark: SparkSession, root: str, name: str, limit: int = 30) -> DataFrame:
    """Profile rows of the last ``limit`` lines; a corrupt line among them is passed over."""
    path, found = history_path(root, name), []
    lines = [x for x in path.read_text().splitlines() if x.strip()] if path.exists() else []
    for line in lines[-limit:]:
        try:
            found += [(r["ts"], r["rows"], r["field"], r["n"], r["nulls"], [(k["first"], k["kind"], k["n"]) for k in r["kinds"] or []], r["median"], r["min"], r["max"]) for r in json.loads(line)]
        except (json.JSONDecodeError, KeyError, TypeError):
            continue
    return spark.createDataFrame(found, RECORD)


def prune_history(root: str, name: str, keep: int) -> int:
    """Keeps the newest ``keep`` lines; how many went."""
    path = history_path(root, name)
    lines = [x for x in path.read_text().splitlines() if x.strip()] if path.exists() else []
    if len(lines) <= keep:
        return 0
    path.write_text("".join(x + "\n" for x in lines[len(lines) - keep :]))
    return len(lines) - keep


def detect_drift(base: DataFrame, current: DataFrame, median_shift: float = MEDIAN_SHIFT, row_shift: float = ROW_SHIFT, min_history: int = MIN_HISTORY) -> DataFrame:
    """Findings (field, code, detail) of ``current`` against ``base``.

    Both: ts, rows, field, n, nulls, kinds, median.  The base is a bounded number
    of runs, so its one-row summary is broadcast.
    """
    runs = base.select("ts", "rows").distinct().agg(
        F.count("*").alias("seen"), F.bool_or(F.col("ts").startswith("fixture:")).alias("seeded"), F.median("rows").alias("base_rows")
    )
    need = F.when(F.coalesce(F.col("seeded"), F.lit(False)), 1).otherwise(min_history)
    note = F.when(F.col("seen") < min_history, F.concat(F.lit(" (provisional: only "), F.col("seen").cast("string"), F.lit(" reference observation"), F.when(F.col("seen") == 1, "").otherwise("s"), F.lit(")"))).otherwise("")
    gate = runs.withColumn("need", need).withColumn("note", note).filter("seen >= need")
    percent = lambda x: S.round_half_up(100 * x).cast("string")
    text = lambda c: S.number_text(c.cast("double"))

    rows_now = current.select("rows").distinct().crossJoin(F.broadcast(gate))  # one row each
    delta = F.abs(F.col("rows") - F.col("base_rows")) / F.col("base_rows")
    row_finding = rows_now.filter((F.col("base_rows") > 0) & (delta > row_shift)).select(
        F.lit("__rows__").alias("field"), F.lit("ROW_COUNT_SHIFT").alias("code"),
        F.concat(F.lit("row count "), F.col("rows").cast("string"), F.lit(" against a baseline median of "), text(F.col("base_rows")), F.lit(" ("), percent(delta), F.lit("% change)"), F.col("note")).alias("detail"),
    )

    past = base.groupBy("field").agg(
        F.count("*").alias("past"), F.median("median").alias("base_median"), F.avg(F.col("nulls") / F.greatest(F.lit(1), F.col("n") + F.col("nulls"))).alias("base_nulls")
    )
    # Kinds of all runs added up; order: run, then place in the run.
    order = F.row_number().over(W.partitionBy("field").orderBy("ts", "k.first"))
    each = base.select("field", "ts", F.explode("kinds").alias("k")).withColumn("ord", order)
    merged = each.groupBy("field", F.col("k.kind").alias("kind")).agg(F.sum("k.n").alias("n"), F.min("ord").alias("first"))
    was = merged.groupBy("field").agg(F.max_by("kind", F.struct("n", (-F.col("first")).alias("e"))).alias("was_kind"))
    j = current.join(past, "field").join(was, "field", "left").crossJoin(F.broadcast(gate)).filter("past >= need")
    is_kind = dominant_kind(F.col("kinds"))
    change = F.abs(F.col("median") - F.col("base_median")) / F.abs(F.col("base_median"))
    rate = F.col("nulls") / F.greatest(F.lit(1), F.col("n") + F.col("nulls"))
    finding = lambda code, detail: F.struct(F.lit(code).alias("code"), F.concat(detail, F.col("note")).alias("detail"))
    found = F.array_compact(
        F.array(
            F.when(is_kind != F.col("was_kind"), finding("KIND_SHIFT", F.concat(F.lit("values now read as "), is_kind, F.lit(", historically "), F.col("was_kind")))),
            F.when(
                (F.col("base_median") != 0) & (change > median_shift),
                finding("MAGNITUDE_SHIFT", F.concat(F.lit("median "), text(F.col("median")), F.lit(" is "), percent(change), F.when(F.col("median") > F.col("base_median"), "% up").otherwise("% down"), F.lit(" from a baseline of "), text(F.col("base_median")))),
            ),
            F.when(rate - F.col("base_nulls") > NULL_SHIFT, finding("NULL_RATE_SHIFT", F.concat(percent(rate), F.lit("% of values are now empty, historically "), percent(F.col("base_nulls")), F.lit("%")))),
        )
    )
    return row_finding.unionByName(j.select("field", F.explode(found).alias("f")).select("field", "f.code", "f.detail"))


def drift_over_time(history: DataFrame, limit: int = 30, min_history: int = MIN_HISTORY) -> DataFrame:
    """Each run of a whole history (spec, ts, rows, field, n, nulls, median, and kinds if they are to be compared) against up to ``limit`` runs before it: spec, ts, field, code, change.

    A field that changes kind has no size of change: null.
    """
    w = W.partitionBy("spec", "field").orderBy("ts").rowsBetween(-limit, -1)
    rate = F.col("nulls") / F.greatest(F.lit(1), F.col("n") + F.col("nulls"))
    h = (
        history.withColumn("seen", F.count("*").over(w))
        .withColumn("base_rows", F.percentile("rows", F.lit(0.5)).over(w))
        .withColumn("base_median", F.percentile("median", F.lit(0.5)).over(w))
        .withColumn("base_nulls", F.avg(rate).over(w))
    )
    if "kinds" in history.columns:
        h = h.withColumn("past_kinds", F.flatten(F.collect_list("kinds").over(w)))
    h = h.filter(F.col("seen") >= min_history)
    rows_change = F.abs(F.col("rows") - F.col("base_rows")) / F.col("base_rows")
    change = F.abs(F.col("median") - F.col("base_median")) / F.abs(F.col("base_median"))
    one = lambda code, x: F.struct(F.lit(code).alias("code"), x.cast("double").alias("change"))
    kind_finding = []
    if "kinds" in history.columns:
        kind_finding = [F.when(dominant_kind(F.col("kinds")) != dominant_kind(merged_kinds(F.col("past_kinds"))), one("KIND_SHIFT", F.lit(None)))]
    found = F.array_compact(
        F.array(
            *kind_finding,
            F.when((F.col("base_rows") > 0) & (rows_change > ROW_SHIFT), one("ROW_COUNT_SHIFT", rows_change)),
            F.when((F.col("base_median") != 0) & (change > MEDIAN_SHIFT), one("MAGNITUDE_SHIFT", change)),
            F.when(rate - F.col("base_nulls") > NULL_SHIFT, one("NULL_RATE_SHIFT", rate - F.col("base_nulls"))),
        )
    )
    return h.select("spec", "ts", "field", F.explode(found).alias("f")).select("spec", "ts", "field", "f.code", "f.change")


def latest(history: DataFrame, keep: int, by: list[str], ts: str = "ts") -> DataFrame:
    """The newest ``keep`` rows of each group; the rank is limited before the shuffle."""
    return history.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(F.col(ts).desc()))).filter(F.col("_r") <= keep).drop("_r")


def retirement(fixtures: DataFrame, now: Column, keep: int = 10, max_age: int = 180) -> DataFrame:
    """Fixtures (spec, source, ok) to retire: the failing beyond ``max_age`` days, then the oldest beyond ``keep``; never the last that passes."""
    f = fixtures.withColumn("age", S.age_in_days("source", now))
    f = f.withColumn("stale", F.coalesce(~F.col("ok") & (F.col("age") > max_age), F.lit(False)))
    w = W.partitionBy("spec").orderBy(F.col("source").desc())
    left = F.sum(F.when(F.col("stale"), 0).otherwise(1)).over(w)
    last_ok = F.max(F.when(F.col("ok"), F.col("source"))).over(W.partitionBy("spec"))
    out = f.withColumn("reason", F.when(F.col("stale"), "failing and old").when(left > keep, "beyond the number kept")).withColumn("last_ok", last_ok)
    return out.filter("reason is not null and not (source <=> last_ok)").select("spec", "source", "age", "reason")
