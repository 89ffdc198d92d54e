"""Pages as a node table, and selectors as DataFrame plans over it.

``nodes`` parses on the executors in one Arrow pass.  ``select_nodes`` turns each
step of a selector into a filter and a semi-join on the page id and the id
ranges, so the work of a page stays with its page.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.sources.html import parse
from weftline.sources.selectors import Step, Test, compile_selector, evaluate, nth

NODE = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("node_id", T.IntegerType()),
        T.StructField("end_id", T.IntegerType()),
        T.StructField("parent_id", T.IntegerType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("tag", T.StringType()),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("classes", T.ArrayType(T.StringType())),
        T.StructField("sib_idx", T.IntegerType()),
        T.StructField("n_sibs", T.IntegerType()),
        T.StructField("n_kids", T.IntegerType()),
        T.StructField("text", T.StringType()),
    ]
)


def nodes(pages: DataFrame, key: str = "page_id", html: str = "html", text: bool = True) -> DataFrame:
    """One row per element, the document itself as node 0 without a parent. Null html is an empty page."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(NODE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                p = parse(source or "")
                n = len(p)
                cols = [
                    [doc] * n, list(range(n)), p.end, [None if x < 0 else x for x in p.parent], p.depth, p.tag, [list(a.items()) for a in p.attrs], [p.classes(k) for k in range(n)],
                    p.sib, [1 if x < 0 else p.kids[x] for x in p.parent], p.kids, [p.norm_text(k) if text else None for k in range(n)],
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return pages.select(F.col(key).cast("long").alias("doc_id"), F.col(html)).mapInArrow(run, NODE)


def _test(t: Test) -> Column:
    if t.kind == "tag":
        return F.col("tag") == t.name
    if t.kind == "class":
        return F.array_contains("classes", t.name)
    if t.kind == "id":
        return F.coalesce(F.col("attrs")["id"] == t.name, F.lit(False))
    if t.kind == "attr":
        have, want = F.col("attrs")[t.name], t.value
        if t.op is None or want is None:
            return have.isNotNull()
        if want == "" and t.op in ("^=", "$=", "*="):
            return F.lit(False)
        found = {
            "=": lambda: have == want,
            "^=": lambda: have.startswith(want),
            "$=": lambda: have.endswith(want),
            "*=": lambda: F.contains(have, F.lit(want)),
            "~=": lambda: F.array_contains(F.split(have, r"\s+"), want),
            "|=": lambda: (have == want) | have.startswith(want + "-"),
        }[t.op]()
        return F.coalesce(found, F.lit(False))
    place = F.col("sib_idx") + 1
    if t.name == "first-child":
        return place == 1
    if t.name == "last-child":
        return place == F.col("n_sibs")
    if t.name == "only-child":
        return F.col("n_sibs") == 1
    if t.name == "nth-child":
        ab = nth(t.value) if t.value else None
        if ab is None:
            return F.lit(False)
        a, b = ab
        return place == b if a == 0 else (F.pmod(place - b, F.lit(abs(a))) == 0) & ((place - b) * (1 if a > 0 else -1) >= 0)
    if t.name == "not":
        if not t.value:
            return F.lit(False)
        out = F.lit(True)
        for g in compile_selector(t.value):
            if len(g) == 1:
                out = out & ~_tests(g[0])
        return out
    return F.lit(True)


def _tests(step: Step) -> Column:
    out = F.lit(True)
    for t in step.tests:
        if t.kind != "any":
            out = out & _test(t)
    return out


def select_nodes(table: DataFrame, selector: str) -> DataFrame:
    """Rows of the node table that the selector matches from the document; each once."""
    below = table.filter("node_id > 0")
    out = None
    for group in compile_selector(selector):
        found = None
        for step in group:
            # The filter on the step itself comes before its join.
            near = below.filter(_tests(step))
            if found is not None:
                a, d = found.select([F.col(c).alias(f"a_{c}") for c in ("doc_id", "node_id", "end_id", "parent_id", "sib_idx")]), near
                on = F.col("doc_id") == F.col("a_doc_id")
                if step.lead == ">":
                    on &= F.col("parent_id") == F.col("a_node_id")
                elif step.lead == " ":
                    on &= (F.col("node_id") > F.col("a_node_id")) & (F.col("node_id") <= F.col("a_end_id"))
                elif step.lead == "+":
                    on &= (F.col("parent_id") == F.col("a_parent_id")) & (F.col("sib_idx") == F.col("a_sib_idx") + 1)
                else:
                    on &= (F.col("parent_id") == F.col("a_parent_id")) & (F.col("sib_idx") > F.col("a_sib_idx"))
                near = d.join(a, on, "left_semi")
            found = near
        out = found if out is None else out.unionByName(found)
    return out.dropDuplicates(["doc_id", "node_id"]) if len(compile_selector(selector)) > 1 else out


def count_matches(pages: DataFrame, selectors: list[str], key: str = "page_id", html: str = "html") -> DataFrame:
    """doc_id, selector, matches: every selector evaluated in one pass, each page parsed once."""
    plans = [compile_selector(s) and s for s in selectors]  # a wrong selector fails here, not on an executor

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, found = batch.column(0).to_pylist(), []
            for source in batch.column(1).to_pylist():
                p = parse(source or "")
                found += [len(evaluate(p, s)) for s in plans]
            names = [pa.array([d for d in docs for _ in plans], pa.int64()), pa.array(plans * len(docs), pa.string()), pa.array(found, pa.int64())]
            yield pa.RecordBatch.from_arrays(names, names=["doc_id", "selector", "matches"])

    return pages.select(F.col(key).cast("long").alias("doc_id"), F.col(html)).mapInArrow(run, "doc_id long, selector string, matches long")


def descendants(table: DataFrame, roots: DataFrame) -> DataFrame:
    """(doc_id, root, node_id) of every element below each root."""
    r = roots.select(F.col("doc_id").alias("r_doc"), F.col("node_id").alias("root"), F.col("end_id").alias("r_end"))
    return table.join(r, (F.col("doc_id") == F.col("r_doc")) & (F.col("node_id") > F.col("root")) & (F.col("node_id") <= F.col("r_end"))).select("doc_id", "root", "node_id")


def repeated_groups(table: DataFrame, least: int = 2) -> DataFrame:
    """Siblings alike in tag and stable classes: doc_id, parent_id, signature, members (in order), n."""
    from weftline.functions.scalars import group_signature

    return (
        table.filter("node_id > 0")
        .withColumn("signature", group_signature("tag", "classes"))
        .groupBy("doc_id", "parent_id", "signature")
        .agg(F.array_sort(F.collect_list("node_id")).alias("members"), F.count("*").alias("n"))
        .filter(F.col("n") >= least)
    )
