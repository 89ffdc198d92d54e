"""Extraction, contract and verdict over a table of pages.

One Arrow pass per page parses and evaluates every selector of a spec (pruned to
the wanted fields beforehand); coercion, contract and classification after it are
Column expressions.  Nothing shuffles: a page's rows stay arrays in its row until they are
exploded.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from weftline.functions import scalars as S
from weftline.sources import indoc
from weftline.sources.html import parse
from weftline.sources.selectors import evaluate
from weftline.sources.specs import Spec

CELL = T.StructType([T.StructField("raw", T.StringType()), T.StructField("n_els", T.IntegerType()), T.StructField("items", T.ArrayType(T.StringType()))])

# What tells a challenge page.
CHALLENGE_PHRASES = (
    "just a moment", "attention required", "checking your browser", "enable javascript and cookies to continue",
    "verify you are human", "are you a robot", "unusual traffic", "access denied", "request blocked",
    "too many requests", "rate limit exceeded", "ddos protection", "please complete the security check",
)
CHALLENGE_SELECTORS = (
    "#cf-challenge-running", "#challenge-form", "#cf-wrapper", ".g-recaptcha", ".h-captcha", "[data-sitekey]",
    "script[src*=recaptcha]", "script[src*=hcaptcha]", "script[src*=challenge-platform]",
)
SMALL_PAGE = 20_000


def scan(pages: DataFrame, spec: Spec, html: str = "html", facts: bool = False) -> DataFrame:
    """``pages`` (without ``html``) plus ``found``: an array of rows, each a struct of cells by field.

    With ``facts`` also what classification asks of a page: ``challenge`` (the
    first selector that tells one), ``page_text``, ``n_elements``, ``html_length``.
    """
    cells = T.StructType([T.StructField(n, CELL) for n in spec.fields])
    extra = [T.StructField("challenge", T.StringType()), T.StructField("page_text", T.StringType()), T.StructField("n_elements", T.IntegerType()), T.StructField("html_length", T.IntegerType())] if facts else []
    kept = [f for f in pages.schema if f.name != html]
    schema = T.StructType([*kept, T.StructField("found", T.ArrayType(cells)), *extra])
    arrow = to_arrow_schema(schema)

    def one(source: str | None) -> tuple:
        page = parse(source or "")
        rows = []
        for row in indoc.rows_of(page, spec):
            got = {}
            for name, f in spec.fields.items():
                els = evaluate(page, f.selector, row)
                raw, _, _, items = indoc.cell(page, els, f)
                got[name] = {"raw": raw, "n_els": len(els), "items": items}
            rows.append(got)
        if not facts:
            return (rows,)
        told = next((s for s in CHALLENGE_SELECTORS if evaluate(page, s)), None)
        return rows, told, page.norm_text(0), len(page) - 1, len(source or "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [one(x) for x in batch.column(batch.schema.get_field_index(html)).to_pylist()]
            cols = [batch.column(batch.schema.get_field_index(f.name)).cast(arrow.field(f.name).type) for f in kept]
            for j in range(1 + len(extra)):
                cols.append(pa.array([g[j] for g in got], arrow.field(len(kept) + j).type))
            yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return pages.mapInArrow(run, schema)


def value_of(c: Column, kind: str) -> Column:
    """A cell's value: list, number (from its text) or string (empty as null)."""
    if kind == "list":
        return c["items"]
    return S.parse_number(c["raw"]) if kind == "number" else F.nullif(c["raw"], F.lit(""))


def rows(scanned: DataFrame, spec: Spec) -> DataFrame:
    """One row per record: the page's columns, row_index, and the fields, typed."""
    keys = [c for c in scanned.columns if c not in ("found", "challenge", "page_text", "n_elements", "html_length")]
    flat = scanned.select(*keys, F.posexplode("found").alias("row_index", "r"))
    return flat.select(*keys, "row_index", *[value_of(F.col("r")[n], f.type).alias(n) for n, f in spec.fields.items()])


def cells(scanned: DataFrame, spec: Spec, keys: list[str]) -> DataFrame:
    """Long form: keys, row_index, field, ord (the field's place), n_els, raw, v_str, v_num, v_list."""
    flat = scanned.select(*keys, F.posexplode("found").alias("row_index", "r"))
    none = lambda t: F.lit(None).cast(t)
    parts = []
    for i, (n, f) in enumerate(spec.fields.items()):
        c = F.col("r")[n]
        v = value_of(c, f.type)
        parts.append(
            F.struct(
                F.lit(n).alias("field"), F.lit(i).alias("ord"), c["n_els"].alias("n_els"), c["raw"].alias("raw"),
                (v if f.type == "string" else none("string")).alias("v_str"), (v if f.type == "number" else none("double")).alias("v_num"), (v if f.type == "list" else none("array<string>")).alias("v_list"),
            )
        )
    return flat.select(*keys, "row_index", F.explode(F.array(*parts)).alias("c")).select(*keys, "row_index", "c.*")


def _violation(code: str, field: str | None, row: Column | None, detail: Column) -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(field).cast("string").alias("field"), (row if row is not None else F.lit(None)).cast("int").alias("row"), detail.alias("detail"))


def _text(x: float) -> str:
    return str(int(x)) if x == int(x) else str(x)


def violations_column(spec: Spec) -> Column:
    """All violations of a page's ``found``, in row order, as one array: no union, no shuffle."""
    n = F.size("found")
    checks = []
    if spec.rows_min is not None:
        checks.append(F.when(n < spec.rows_min, _violation("ROW_COUNT", None, None, F.concat(F.lit("got "), n.cast("string"), F.lit(f" rows, expected at least {spec.rows_min}")))))
    if spec.rows_max is not None:
        checks.append(F.when(n > spec.rows_max, _violation("ROW_COUNT", None, None, F.concat(F.lit("got "), n.cast("string"), F.lit(f" rows, expected at most {spec.rows_max}")))))

    def of_row(r: Column, i: Column) -> Column:
        out = []
        for name, f in spec.fields.items():
            c = r[name]
            v = value_of(c, f.type)
            if f.type == "list":
                size = F.size(v)
                if f.min_items is not None:
                    short = F.when(size < f.min_items, _violation("LIST_TOO_SHORT", name, i, F.concat(F.lit("got "), size.cast("string"), F.lit(f" items, expected at least {f.min_items}"))))
                    out.append(short)
                elif f.required:
                    out.append(F.when(size == 0, _violation("FIELD_MISSING", name, i, F.lit("no items"))))
                continue
            if f.required is not False:
                wrong = F.when((c["n_els"] > 0) & F.lit(f.type == "number"), _violation("FIELD_TYPE", name, i, F.concat(F.lit("not a number: "), F.substring(c["raw"], 1, 60)))).otherwise(
                    _violation("FIELD_MISSING", name, i, F.lit("nothing found"))
                )
                out.append(F.when(v.isNull(), wrong))
            if f.type == "number":
                for bound, bad, word in ((f.min, lambda x: v < x, "below"), (f.max, lambda x: v > x, "above")):
                    if bound is not None:
                        out.append(F.when(bad(bound), _violation("FIELD_RANGE", name, i, F.concat(S.number_text(v), F.lit(f" is {word} {_text(bound)}")))))
        return F.array_compact(F.array(*out)) if out else F.array().cast("array<struct<code:string,field:string,row:int,detail:string>>")

    per_row = F.flatten(F.transform("found", of_row))
    return F.concat(F.array_compact(F.array(*checks)), per_row) if checks else per_row


def with_violations(scanned: DataFrame, spec: Spec) -> DataFrame:
    return scanned.withColumn("violations", violations_column(spec))


def violations(scanned: DataFrame, spec: Spec, keys: list[str]) -> DataFrame:
    """A row per violation: keys, ord (its place), code, field, row, detail."""
    return with_violations(scanned, spec).select(*keys, F.posexplode("violations").alias("ord", "v")).select(*keys, "ord", "v.*")


def broken_fields(v: DataFrame, keys: list[str]) -> DataFrame:
    """Fields with a violation, in the order first seen."""
    return v.filter("field is not null").groupBy(*keys, "field").agg(F.min("ord").alias("ord"))


def challenge_phrase(text: Column, length: Column) -> Column:
    low = F.lower(text)
    return F.when(length <= SMALL_PAGE, F.coalesce(*[F.when(F.contains(low, F.lit(p)), F.lit(p)) for p in CHALLENGE_PHRASES]))


def cause_column(url: Column, status: Column = None, final_url: Column = None) -> Column:
    """The reason a page failed, first that holds; needs ``facts`` and ``violations``."""
    status = F.lit(200) if status is None else status
    final_url = url if final_url is None else final_url
    evidence = F.col("challenge").isNotNull() | challenge_phrase(F.col("page_text"), F.col("html_length")).isNotNull()
    return (
        F.when(status.isin(403, 429), "BLOCKED")
        .when(evidence, "BLOCKED")
        .when((status == 0) | (status >= 400), "HTTP_ERROR")
        .when((F.size("found") == 0) & (F.length("page_text") < 50) & (F.col("n_elements") < 20), "EMPTY")
        .when(~F.coalesce(S.same_target(final_url, url), F.lit(False)), "REDIRECTED")
        .when(F.size("violations") > 0, "LAYOUT_CHANGE")
        .otherwise("OK")
    )


def verdicts(pages: DataFrame, spec: Spec, keys: list[str], status: Column = None, final_url: Column = None, url: Column = None) -> DataFrame:
    """A row per page: keys, n_rows, n_violations, cause, repairable."""
    s = with_violations(scan(pages, spec, facts=True), spec)
    cause = cause_column(url if url is not None else F.lit(spec.url), status, final_url)
    return s.select(*keys, F.size("found").alias("n_rows"), F.size("violations").alias("n_violations"), cause.alias("cause")).withColumn("repairable", F.col("cause") == "LAYOUT_CHANGE")


def reindexed(rows_: DataFrame, run: str = "run", page_no: str = "page_no") -> DataFrame:
    """Rows of a run's pages numbered through, pages in order."""
    from pyspark.sql import Window as W

    return rows_.withColumn("row_index", F.row_number().over(W.partitionBy(run).orderBy(page_no, "row_index")) - 1)


FETCHES_DATA = r"fetch\s*\(|XMLHttpRequest|\$\.(ajax|getJSON)\s*\(|axios|data-reactroot|ng-app"


def looks_client_rendered(html: Column, text: Column) -> Column:
    """A page whose records a script fetches later."""
    n = F.length(text)
    return html.rlike("(?i)<script") & ((n < 200) | html.rlike(FETCHES_DATA) | ((F.length(html) > SMALL_PAGE) & (n / F.length(html) < 0.01)))
