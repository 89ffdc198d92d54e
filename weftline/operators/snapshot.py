"""Keyed snapshot comparison (change capture) and row sinks."""

from __future__ import annotations

import datetime as dt
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import scalars as S
from weftline.sources.specs import SpecError, format_for


def key_of(columns: list[str], key: list[str] | None) -> Column:
    """A row's identity: its key fields, or all of it; nulls are values here."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in (key or columns)]), {"ignoreNullFields": "false"})


def compare(now: DataFrame, seen: DataFrame, key: list[str] | None) -> DataFrame:
    """``now`` and ``seen`` (same columns) side by side: change (added, updated, unchanged, removed), after, before.

    Every row of ``now`` counts, also under a repeated key; ``seen`` has one row a key.
    """
    cols = now.columns
    whole = F.struct(*[F.col(f"`{c}`") for c in cols])
    a = now.select(key_of(cols, key).alias("k"), whole.alias("after"))
    b = seen.select(key_of(cols, key).alias("k"), F.struct(*[F.col(f"`{c}`").cast(now.schema[c].dataType).alias(c) for c in cols]).alias("before"))
    j = a.join(b, "k", "full_outer")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("after").eqNullSafe(F.col("before")), "unchanged").otherwise("updated")
    return j.select("k", change.alias("change"), "after", "before")


def change_events(now: DataFrame, seen: DataFrame, key: list[str] | None, at: str) -> DataFrame:
    """The log to append: _change (added or updated), _at, _before, then the row."""
    c = compare(now, seen, key).filter(F.col("change").isin("added", "updated"))
    return c.select(F.col("change").alias("_change"), F.lit(at).alias("_at"), F.when(F.col("change") == "updated", F.col("before")).alias("_before"), "after.*")


def next_seen(now: DataFrame, key: list[str] | None, order: str | None = None) -> DataFrame:
    """The store after this run: of a repeated key the last row. It replaces the old store, so what went missing is new when it returns."""
    if order is None:
        return now.dropDuplicates(key or now.columns)
    cols = now.columns
    return now.groupBy(key_of(cols, key).alias("k")).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in cols]), order).alias("r")).select("r.*")


def new_rows(now: DataFrame, seen: DataFrame, key: list[str]) -> DataFrame:
    """Append mode: rows whose key was not seen (nulls equal)."""
    on = None
    s = seen.select([F.col(f"`{k}`").alias(f"_s{i}") for i, k in enumerate(key)]).distinct()
    for i, k in enumerate(key):
        c = F.col(f"`{k}`").eqNullSafe(F.col(f"_s{i}"))
        on = c if on is None else on & c
    return now.join(s, on, "left_anti")


def flat_for_csv(df: DataFrame) -> DataFrame:
    """Lists joined by ``; ``, numbers as people write them, nested rows dropped."""
    out = []
    for f in df.schema:
        kind, c = f.dataType.simpleString(), F.col(f"`{f.name}`")
        if kind.startswith("struct"):
            continue
        out.append((F.array_join(c, "; ") if kind.startswith("array") else S.number_text(c) if kind == "double" else c.cast("string")).alias(f.name))
    return df.select(*out)


def csv_lines(df: DataFrame) -> DataFrame:
    """One RFC 4180 line per row."""
    flat = flat_for_csv(df)
    return flat.select(F.concat_ws(",", *[S.csv_cell(F.col(f"`{c}`")) for c in flat.columns]).alias("value"))


def resolve_path(template: str, name: str, now: dt.datetime) -> str:
    return template.replace("{name}", name).replace("{date}", now.strftime("%Y-%m-%d"))


def write_rows(df: DataFrame, path: str, fmt: str | None = None, mode: str = "overwrite") -> None:
    """A folder of CSV or JSON lines parts; ``json`` is a single array and cannot be appended to."""
    kind = format_for(path, fmt)
    if kind == "csv":
        flat_for_csv(df).write.mode(mode).option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    elif kind == "jsonl":
        df.write.mode(mode).option("ignoreNullFields", "false").json(path)
    elif mode != "overwrite":
        raise SpecError("a JSON array cannot be appended to")
    else:
        # An array is one document; a snapshot of one spec's rows is small by its contract.
        df.agg(F.to_json(F.collect_list(F.struct("*")), {"ignoreNullFields": "false"}).alias("value")).write.mode(mode).text(path)


def persist(df: DataFrame, seen: DataFrame, output: dict, name: str, at: dt.datetime, ok: bool) -> dict[str, int]:
    """Writes a run's rows by the output's mode, only when the run passed; counts by change."""
    if not ok:
        return {}
    path, mode, key = resolve_path(output["path"], name, at), output.get("mode") or "snapshot", output.get("key")
    key = [key] if isinstance(key, str) else key
    if mode == "snapshot":
        write_rows(df, path, output.get("format"))
        return {"added": df.count()}
    c = compare(df, seen, key)
    counts = {r["change"]: r["n"] for r in c.groupBy("change").agg(F.count("*").alias("n")).collect()}
    events = change_events(df, seen, key, at.isoformat())
    if mode == "append":
        events = events.filter("_change = 'added'").drop("_change", "_at", "_before")
    if format_for(path, output.get("format")) == "json":
        raise SpecError("a JSON array cannot be appended to")
    write_rows(events, path, output.get("format"), "append")
    return counts


def load_seen(root: str, name: str, like: DataFrame) -> DataFrame:
    """The rows a spec's last written run had, with the columns of ``like``; lines that cannot be read are passed over."""
    path = Path(root, name, "rows.jsonl")
    lines = path.read_text().splitlines() if path.exists() else []
    stored = like.sparkSession.createDataFrame([(x,) for x in lines], "line string")
    return stored.select(F.from_json("line", like.schema).alias("r")).filter("r is not null").select("r.*")


def save_seen(root: str, name: str, now: DataFrame) -> None:
    """Replaces the store in one step; a spec's rows are few by its contract."""
    path = Path(root, name, "rows.jsonl")
    path.parent.mkdir(parents=True, exist_ok=True)
    new = path.with_suffix(".new")
    new.write_text("".join(x + "\n" for x in now.toJSON().collect()))
    new.replace(path)


def persist_run(rows: DataFrame, output: dict, name: str, at: dt.datetime, root: str) -> dict[str, int]:
    """``persist`` of a passing run's rows (with row_index), and the store that the next run is compared with."""
    now = rows.drop("row_index")
    if (output.get("mode") or "snapshot") == "snapshot":
        return persist(now, now.limit(0), output, name, at, True)
    key = output.get("key")
    counts = persist(now, load_seen(root, name, now), output, name, at, True)
    # Of a repeated key the last row counts.
    keys = [key] if isinstance(key, str) else key
    last = rows.groupBy(key_of(now.columns, keys).alias("k")).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in now.columns]), "row_index").alias("r"))
    save_seen(root, name, last.select("r.*"))
    return counts
