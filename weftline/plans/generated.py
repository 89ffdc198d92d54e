"""Registered queries over pages and records that are made of the tables, with their SQL.

Each order becomes a page whose rows are its line items, so that what a selector,
a contract or a fetch should find can also be said in SQL over the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import scalars as S
from weftline.operators import extract as X
from weftline.operators import nodes as N
from weftline.operators import profile as P
from weftline.session import staged, table
from weftline.sources import web
from weftline.sources.specs import Field, Spec

SELECTORS = [
    "li", "ul > *", ".R", "#l2", "li.item.sel", "[data-mode=AIR]", "[data-mode^=RE]", "[data-mode$=IL]", "[data-mode*=AI]", "[class~=sel]", "[lang|=en]", "[data-none]",
    "li:first-child", "li:last-child", "li:only-child", "li:nth-child(2n)", "li:nth-child(3)", "li:nth-child(-n+2)", "li:nth-child(odd)", "li:not(.R)", "li:not(:first-child)",
    "li + li", ".R + li", ".R ~ li", "li:hover", ".R, .N", ".R, li, #l2", "main > ul li b", "header ~ main b:first-child", "ul + p", "body p, h1",
]


def _mode() -> Column:
    """How an item travels: a value for attribute tests."""
    return F.element_at(F.array(*[F.lit(m) for m in ("AIR", "RAIL", "REG AIR", "MAIL", "SHIP")]), (F.pmod("l_suppkey", F.lit(5)) + 1).cast("int"))


def order_pages(spark: SparkSession, d: str) -> DataFrame:
    """page_id (the order), html."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", _mode().alias("mode"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    text = lambda c: F.col(c).cast("string")
    price = F.when(F.pmod("l_linenumber", F.lit(5)) == 0, "on request").when(F.col("cents") % 7 == 0, "").otherwise(F.concat(F.lit("$"), F.floor(F.col("cents") / 100).cast("string"), F.lit("."), F.lpad((F.col("cents") % 100).cast("string"), 2, "0")))
    row = F.concat(
        F.lit('<li class="item '), "l_returnflag", F.when(F.col("l_quantity") > 25, " sel").otherwise(""), F.lit('" id="l'), text("l_linenumber"), F.lit('" data-mode="'), "mode", F.lit('" lang="'),
        F.when(F.col("l_quantity") > 40, "en-GB").when(F.col("l_quantity") > 30, "en").otherwise("enx"), F.lit('"><b>'), F.col("l_quantity").cast("int").cast("string"), F.lit("</b><i>"), price, F.lit("</i>"),
        F.when(F.col("l_quantity") > 10, "<u>a</u>").otherwise(""), F.when(F.col("l_quantity") > 20, "<u>b</u>").otherwise(""),
    )
    rows = li.select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "cents", row.alias("row")).alias("r")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list("r")).alias("rows"))
    html = F.concat(F.lit("<html><body><header><h1>Order "), text("l_orderkey"), F.lit("</h1></header><main><ul>"), F.array_join(F.transform("rows", lambda r: r["row"]), ""), F.lit("</ul><p>end</p></main></body></html>"))
    return rows.select(F.col("l_orderkey").cast("long").alias("page_id"), html.alias("html"))


_LI = """li AS (
  SELECT l_orderkey AS o, l_linenumber AS no, CAST(l_quantity AS INTEGER) AS q, l_returnflag AS flag, ['AIR', 'RAIL', 'REG AIR', 'MAIL', 'SHIP'][1 + l_suppkey % 5] AS mode, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
    row_number() OVER w AS i, count(*) OVER (PARTITION BY l_orderkey) AS n, lag(l_returnflag) OVER w AS before, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen_r
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice))"""

#: What each selector should match, as a condition on a line item; None: on something else.
_MATCHES = {
    "li": "true", "ul > *": "true", ".R": "flag = 'R'", "#l2": "no = 2", "li.item.sel": "q > 25", "[data-mode=AIR]": "mode = 'AIR'", "[data-mode^=RE]": "starts_with(mode, 'RE')",
    "[data-mode$=IL]": "ends_with(mode, 'IL')", "[data-mode*=AI]": "contains(mode, 'AI')", "[class~=sel]": "q > 25", "[lang|=en]": "q > 30", "[data-none]": "false",
    "li:first-child": "i = 1", "li:last-child": "i = n", "li:only-child": "n = 1", "li:nth-child(2n)": "i % 2 = 0", "li:nth-child(3)": "i = 3", "li:nth-child(-n+2)": "i <= 2", "li:nth-child(odd)": "i % 2 = 1",
    "li:not(.R)": "flag <> 'R'", "li:not(:first-child)": "i > 1", "li + li": "i > 1", ".R + li": "before = 'R'", ".R ~ li": "seen_r = 1", "li:hover": "true", ".R, .N": "flag IN ('R', 'N')", ".R, li, #l2": "true",
    "main > ul li b": "true", "header ~ main b:first-child": "true", "ul + p": "i = 1", "body p, h1": "i <= 1",
}


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_TWICE = {"body p, h1": 2}
_FORMS = f"WITH {_LI} " + " UNION ALL ".join(
    f"SELECT {_quoted(s)} AS selector, CAST({_TWICE.get(s, 1)} * count(*) AS BIGINT) AS matches FROM li WHERE {w}" for s, w in _MATCHES.items()
)


def selector_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every form of selector, compiled, all of them in one pass over the pages."""
    counts = N.count_matches(order_pages(spark, d), SELECTORS)
    return counts.groupBy("selector").agg(F.sum("matches").alias("matches"))


def selector_steps(spark: SparkSession, d: str) -> DataFrame:
    """The same as relational plans over one node table."""
    n = staged(N.nodes(order_pages(spark, d), text=False), "nodes")
    out = None
    for s in SELECTORS:
        found = N.select_nodes(n, s).agg(F.count("*").alias("matches")).select(F.lit(s).alias("selector"), "matches")
        out = found if out is None else out.unionByName(found)
    return out


# --- contract -----------------------------------------------------------------------------

ITEMS = Spec(
    "items", "http://example.com/",
    {"qty": Field("b", "number", min=5, max=45), "price": Field("i", "number"), "tags": Field("u", "list", min_items=2), "mode": Field("em", required=True), "note": Field("s", required=False)},
    row="li", rows_min=2, rows_max=6,
)


def contract_codes(spark: SparkSession, d: str) -> DataFrame:
    """Violations of a contract with every kind of rule: counts by code and field, the pages they stand on, their rows."""
    v = X.violations(X.scan(order_pages(spark, d), ITEMS), ITEMS, ["page_id"])
    return v.groupBy("code", F.coalesce("field", F.lit("")).alias("field")).agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"), F.sum(F.coalesce(F.col("row"), F.lit(0)).cast("long")).alias("rows"))


_EACH = f"""{_LI}, v AS (
  SELECT o, 'FIELD_RANGE' AS code, 'qty' AS field, i - 1 AS row, 0 AS ord FROM li WHERE q < 5 OR q > 45
  UNION ALL SELECT o, 'FIELD_TYPE', 'price', i - 1, 1 FROM li WHERE no % 5 = 0 OR cents % 7 = 0
  UNION ALL SELECT o, 'LIST_TOO_SHORT', 'tags', i - 1, 2 FROM li WHERE q <= 20
  UNION ALL SELECT o, 'FIELD_MISSING', 'mode', i - 1, 3 FROM li
  UNION ALL SELECT o, 'ROW_COUNT', '', 0, -1 FROM li WHERE i = 1 AND (n < 2 OR n > 6))"""
CONTRACT_CODES = f"WITH {_EACH} SELECT code, field, CAST(count(*) AS BIGINT) AS n, count(DISTINCT o) AS pages, CAST(sum(row) AS BIGINT) AS rows FROM v GROUP BY code, field"


def broken_by_page(spark: SparkSession, d: str) -> DataFrame:
    """Fields in violation, page by page: how often each is the first."""
    b = X.broken_fields(X.violations(X.scan(order_pages(spark, d), ITEMS), ITEMS, ["page_id"]), ["page_id"])
    first = b.groupBy("page_id").agg(F.min_by("field", "ord").alias("first"), F.count("*").alias("broken"))
    return first.groupBy("first", "broken").agg(F.count("*").alias("pages"))


BROKEN = f"""WITH {_EACH} SELECT first, broken, CAST(count(*) AS BIGINT) AS pages FROM (
  SELECT o, arg_min(field, row * 10 + ord) AS first, count(DISTINCT field) AS broken FROM v WHERE field <> '' GROUP BY o) GROUP BY first, broken"""


def item_rows(spark: SparkSession, d: str) -> DataFrame:
    """Typed rows of every kind of field."""
    spec = Spec("rows", "http://example.com/", {"qty": Field("b", "number"), "price": Field("i", "number"), "tags": Field("u", "list"), "mode": Field("b"), "gone": Field("s")}, row="li")
    r = X.rows(X.scan(order_pages(spark, d), spec), spec)
    return r.select("page_id", "row_index", F.col("qty").cast("long").alias("qty"), F.round(F.col("price") * 100).cast("long").alias("cents"), F.array_join("tags", "|").alias("tags"), "mode", "gone")


ITEM_ROWS = f"""WITH {_LI} SELECT o AS page_id, CAST(i - 1 AS INTEGER) AS row_index, CAST(q AS BIGINT) AS qty, CASE WHEN no % 5 = 0 OR cents % 7 = 0 THEN NULL ELSE cents END AS cents,
  CASE WHEN q > 20 THEN 'a|b' WHEN q > 10 THEN 'a' ELSE '' END AS tags, CAST(q AS VARCHAR) AS mode, CAST(NULL AS VARCHAR) AS gone FROM li"""


def paged_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the pages of a run, up to its first failed page, numbered through: a run is ten orders."""
    p = order_pages(spark, d).select(F.floor(F.col("page_id") / 40).cast("long").alias("run"), F.col("page_id").alias("page_no"), "html", F.when(F.pmod("page_id", F.lit(37)) == 0, 500).otherwise(200).alias("status"))
    spec = Spec("rows", "http://example.com/", {"qty": Field("b", "number")}, row="li")
    r = X.reindexed(X.rows(X.scan(web.until_failure(p, "run").drop("status"), spec), spec))
    return r.select("run", "page_no", F.col("row_index").cast("long").alias("row_index"), F.col("qty").cast("long").alias("qty"))


PAGED_ROWS = f"""WITH {_LI}, p AS (SELECT *, o // 40 AS run, min(CASE WHEN o % 37 = 0 THEN o END) OVER (PARTITION BY o // 40) AS stop FROM li)
SELECT run, o AS page_no, row_number() OVER (PARTITION BY run ORDER BY o, i) - 1 AS row_index, CAST(q AS BIGINT) AS qty FROM p WHERE stop IS NULL OR o <= stop"""


# --- fetching -----------------------------------------------------------------------------


def _archive(url: str) -> web.Fetched:
    """A stand-in for the network: what comes back is said by the URL."""
    if url.endswith("/robots.txt"):
        host = url.split("/")[2]
        if len(host) % 3 == 0:
            return web.Fetched(404, url, "Disallow: /", 0)
        return web.Fetched(200, url, "User-agent: other\nDisallow: /\n\nUser-agent: *\nAllow: /en/1\nDisallow: /en/\nDisallow: /*?*ref=x$\nCrawl-delay: 2\n", 0)
    return web.Fetched(404 if len(url) % 5 == 0 else 200, url + "#end", f"<p>{len(url)}</p>", 0)


def robots_join(spark: SparkSession, d: str) -> DataFrame:
    """Pages against the rules of their origin: each origin's robots.txt is asked once and joined."""
    p = table(spark, d, "pages").select("page_id", "url")
    rules = staged(web.rules_table(spark, p, _archive), "robots")
    return web.with_permission(p, rules).select("page_id", "allowed", F.coalesce(F.col("crawl_delay"), F.lit(0.0)).alias("delay"))


ROBOTS_JOIN = r"""
SELECT page_id, free OR no = -1 OR yes >= no AS allowed, CASE WHEN free THEN 0.0 ELSE 2.0 END::DOUBLE AS delay FROM (
  SELECT page_id, len(host) % 3 = 0 AS free, greatest(CASE WHEN starts_with(p, '/en/') THEN 4 ELSE -1 END, CASE WHEN regexp_matches(p, '^/.*\?.*ref=x$') THEN 10 ELSE -1 END) AS no, CASE WHEN starts_with(p, '/en/1') THEN 5 ELSE -1 END AS yes
  FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^#]*)', 1) AS p FROM pages))
"""


def fetch_table(spark: SparkSession, d: str) -> DataFrame:
    """URLs made by a template, fetched on the executors, a host in one task."""
    n = table(spark, d, "nation").select(F.concat(F.lit("http://n"), F.col("n_nationkey").cast("string"), F.lit(".example/")).alias("base"))
    pages = web.template_urls(spark, "p/{page}?of={page}", 8, 5).withColumnRenamed("url", "path")
    urls = n.join(F.broadcast(pages), F.lit(True)).select(F.concat("base", "path").alias("url"))  # five pages of each
    return web.fetch_all(urls, _archive).select("url", "status", "final_url", "html")


FETCH_TABLE = """SELECT url, CASE WHEN len(url) % 5 = 0 THEN 404 ELSE 200 END AS status, url || '#end' AS final_url, '<p>' || len(url) || '</p>' AS html FROM (
  SELECT 'http://n' || n_nationkey || '.example/p/' || i || '?of={page}' AS url FROM nation, (SELECT unnest(range(8, 13)) AS i))"""


def client_rendered(spark: SparkSession, d: str) -> DataFrame:
    """Which pages a script fills: the table's pages, emptied by rule."""
    p = table(spark, d, "pages")
    k = F.pmod("page_id", F.lit(4))
    html = F.when(k == 0, F.concat(F.lit("<script>"), F.repeat(F.lit("x"), 30), F.lit("</script><p>short"))).when(k == 1, F.concat(F.lit("<p>"), F.repeat(F.lit("word "), 100))).when(k == 2, F.concat(F.lit("<script>fetch('/x')</script><p>"), F.repeat(F.lit("word "), 100))).otherwise(F.concat(F.lit("<script>a</script><p>"), F.repeat(F.lit("word "), 100)))
    spec = Spec("text", "", {"t": Field("p")})
    facts = X.scan(p.select("page_id", html.alias("html"), html.alias("kept")), spec, facts=True)
    return facts.select("page_id", X.looks_client_rendered(F.col("kept"), F.col("page_text")).alias("client"))


CLIENT_RENDERED = "SELECT page_id, page_id % 4 IN (0, 2) AS client FROM pages"


# --- history ------------------------------------------------------------------------------


def retired_fixtures(spark: SparkSession, d: str) -> DataFrame:
    """Orders as archived pages of their customer: which to retire."""
    o = table(spark, d, "orders")
    f = o.select(F.concat(F.lit("c"), F.pmod("o_custkey", F.lit(200)).cast("string")).alias("spec"), F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("-"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("source"), (F.col("o_orderstatus") != "F").alias("ok"))
    return P.retirement(f, F.lit("1998-08-02 00:00:00").cast("timestamp")).select("spec", "source", F.col("age").cast("long").alias("age"), "reason")


RETIRED = """WITH f AS (
  SELECT 'c' || (o_custkey % 200) AS spec, strftime(o_orderdate, '%Y-%m-%d') || '-' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS source, o_orderstatus <> 'F' AS ok, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02') AS age FROM orders
), s AS (SELECT *, NOT ok AND age > 180 AS stale FROM f),
r AS (SELECT *, sum(CASE WHEN stale THEN 0 ELSE 1 END) OVER (PARTITION BY spec ORDER BY source DESC) AS kept, max(CASE WHEN ok THEN source END) OVER (PARTITION BY spec) AS last_ok FROM s)
SELECT spec, source, CAST(age AS BIGINT) AS age, CASE WHEN stale THEN 'failing and old' ELSE 'beyond the number kept' END AS reason FROM r WHERE (stale OR kept > 10) AND source IS DISTINCT FROM last_ok"""


def path_scores(spark: SparkSession, d: str) -> DataFrame:
    """How alike the paths of two elements are: the customer's against one fixed path."""
    step = lambda tag, nth: F.struct(tag.alias("tag"), nth.cast("int").alias("nth"))
    key = F.col("c_custkey")
    mine: Column = F.array(step(F.lit("div"), F.lit(1)), step(F.when(key % 2 == 0, "ul").otherwise("ol"), key % 3), step(F.lit("b"), key % 2))
    mine = F.when(key % 5 == 0, F.slice(mine, 2, 2)).otherwise(mine)
    fixed = F.array(step(F.lit("div"), F.lit(1)), step(F.lit("ul"), F.lit(1)), step(F.lit("b"), F.lit(1)))
    return table(spark, d, "customer").select("c_custkey", F.round(S.path_similarity(mine, fixed), 9).alias("score"))


PATH_SCORES = """SELECT c_custkey, round((b + u / 2 + CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE 1.0 / 3 END) / CASE WHEN c_custkey % 5 = 0 THEN 1.5 ELSE 1 + 0.5 + 1.0 / 3 END * CASE WHEN c_custkey % 5 = 0 THEN 0.7 + 0.3 * 2.0 / 3 ELSE 1 END, 9)::DOUBLE AS score
FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 1 THEN 1.0 ELSE 0.6 END::DOUBLE AS b, CASE WHEN c_custkey % 2 = 1 THEN 0.0 WHEN c_custkey % 3 = 1 THEN 1.0 ELSE 0.6 END::DOUBLE AS u FROM customer)"""


def drift_of_last_run(spark: SparkSession, d: str) -> DataFrame:
    """The last day of each event type's users against the thirty days before: every kind of finding."""
    e = table(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    last = e.agg(F.max("day")).first()[0]
    now = F.col("day") == last
    field = F.concat(F.lit("g"), F.pmod("user_id", F.lit(12)).cast("string"))
    moved = F.when(now & (F.pmod("user_id", F.lit(12)) < 4), F.col("value") * 2).when(now & (F.pmod("user_id", F.lit(12)) == 5), F.lit(None)).otherwise(F.col("value"))
    raw = F.when(now & (F.pmod("user_id", F.lit(12)) > 8), F.lit("three words here")).otherwise(F.lit("12.5"))
    cells = e.select(F.col("day").alias("ts"), F.col("event_id").alias("row_index"), field.alias("field"), raw.alias("raw"), F.lit(None).cast("string").alias("v_str"), moved.alias("v_num"), F.lit(None).cast("array<string>").alias("v_list"))
    stats = P.summarise(cells.filter(~((F.col("ts") == last) & (F.pmod("row_index", F.lit(3)) > 0))), ["ts"])
    h = stats.join(stats.groupBy("ts").agg(F.sum(F.col("n") + F.col("nulls")).alias("rows")), "ts")
    h = staged(h, "history")
    return P.detect_drift(P.baseline(h, None, last), h.filter(F.col("ts") == last)).select("field", "code")


DRIFT_LAST = """WITH e AS (
  SELECT *, strftime(ts, '%Y-%m-%d') AS day, user_id % 12 AS g FROM events
), c AS (
  SELECT day, g, event_id, day = max(day) OVER () AS now, value FROM e
), v AS (
  SELECT day, 'g' || g AS field, now, CASE WHEN now AND g < 4 THEN value * 2 WHEN now AND g = 5 THEN NULL ELSE value END AS v, CASE WHEN now AND g > 8 THEN 'words-mid' ELSE 'numeric' END AS kind FROM c WHERE NOT (now AND event_id % 3 > 0)
), f AS (SELECT day, now, field, count(v) AS n, count(*) - count(v) AS nulls, median(v) AS med, max(kind) AS kind FROM v GROUP BY ALL),
r AS (SELECT day, now, sum(n + nulls) AS rows FROM f GROUP BY ALL), past_days AS (SELECT day, rows FROM r WHERE day IN (SELECT day FROM r ORDER BY day DESC LIMIT 30) AND NOT now),
b AS (SELECT field, median(med) AS med, avg(nulls / greatest(1, n + nulls)) AS nulls, max(kind) AS kind, count(*) AS past FROM f WHERE day IN (SELECT day FROM past_days) GROUP BY field)
SELECT '__rows__' AS field, 'ROW_COUNT_SHIFT' AS code FROM r, (SELECT median(rows) AS m FROM past_days) WHERE now AND abs(rows - m) / m > 0.5
UNION ALL SELECT field, 'KIND_SHIFT' FROM f JOIN b USING (field) WHERE f.now AND f.n > 0 AND f.kind <> b.kind AND past >= 3
UNION ALL SELECT field, 'MAGNITUDE_SHIFT' FROM f JOIN b USING (field) WHERE f.now AND past >= 3 AND b.med <> 0 AND abs(f.med - b.med) / abs(b.med) > 0.15
UNION ALL SELECT field, 'NULL_RATE_SHIFT' FROM f JOIN b USING (field) WHERE f.now AND past >= 3 AND f.nulls / greatest(1, f.n + f.nulls) - b.nulls > 0.3
"""


QUERIES = {
    "selector_forms": selector_forms, "selector_steps": selector_steps, "contract_codes": contract_codes, "broken_by_page": broken_by_page, "item_rows": item_rows, "paged_rows": paged_rows,
    "robots_join": robots_join, "fetch_table": fetch_table, "client_rendered": client_rendered, "retired_fixtures": retired_fixtures, "path_scores": path_scores, "drift_of_last_run": drift_of_last_run,
}
SQL = {
    "selector_forms": _FORMS, "selector_steps": _FORMS, "contract_codes": CONTRACT_CODES, "broken_by_page": BROKEN, "item_rows": ITEM_ROWS, "paged_rows": PAGED_ROWS,
    "robots_join": ROBOTS_JOIN, "fetch_table": FETCH_TABLE, "client_rendered": CLIENT_RENDERED, "retired_fixtures": RETIRED, "path_scores": PATH_SCORES, "drift_of_last_run": DRIFT_LAST,
}
