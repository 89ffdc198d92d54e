import datetime as dt
import json
import urllib.request
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from weftline.operators import extract as X
from weftline.operators import profile as P
from weftline.operators import snapshot as D
from weftline.operators.infer import infer_spec
from weftline.operators.repair import repair, union_selector, violations
from weftline.plans import api
from weftline.plans.demo import SPEC, catalogue, run_demo
from weftline.sources import web
from weftline.sources.html import parse
from weftline.sources.specs import Field, Settings, Spec, SpecError, format_duration, format_for, parse_duration, spec_from_dict, spec_to_dict
from weftline.sources.web import Fetched, paginate, parse_robots, robots_gate, save_fixture
from weftline.streaming.notify import dispatch
from weftline.streaming.watch import RESULT, State, advance, cooldown_for, run_watch, watch_fold


def scan(spark, html, spec=SPEC):
    return X.scan(spark.createDataFrame([(1, html)], "page_id long, html string"), spec, facts=True)


def test_extract_and_contract(spark):
    s = scan(spark, catalogue(3))
    rows = X.rows(s, SPEC).collect()
    assert [r.row_index for r in rows] == [0, 1, 2] and all(r.price > 1 and len(r.tags) >= 2 for r in rows)
    assert X.violations(s, SPEC, ["page_id"]).count() == 0
    strict = Spec("s", "http://e/", {"price": Field(".cost", "number", max=1), "tags": Field("li", "list", min_items=9), "gone": Field(".gone")}, row=".item", rows_min=5)
    v = X.violations(scan(spark, catalogue(3), strict), strict, ["page_id"]).orderBy("ord").collect()
    assert [x.code for x in v[:4]] == ["ROW_COUNT", "FIELD_RANGE", "LIST_TOO_SHORT", "FIELD_MISSING"]
    assert [(x.code, x.field, x.row) for x in v] == violations(parse(catalogue(3)), strict)


def test_causes(spark):
    page = catalogue(3)
    df = spark.createDataFrame(
        [(1, 200, SPEC.url, page), (2, 403, SPEC.url, page), (3, 200, SPEC.url, "<p>Just a moment"), (4, 500, SPEC.url, page), (5, 200, SPEC.url, "<p>x"), (6, 200, "https://other.example/", page),
         (7, 200, "https://www.shop.example/list/?a=1", page), (8, 200, SPEC.url, catalogue(3, cost="")), (9, 200, SPEC.url, '<div class="g-recaptcha">' + page), (10, 200, SPEC.url, None)],
        "id int, status int, final string, html string",
    )
    got = {r.id: r.cause for r in X.verdicts(df, SPEC, ["id"], F.col("status"), F.col("final")).collect()}
    assert got == {1: "OK", 2: "BLOCKED", 3: "BLOCKED", 4: "HTTP_ERROR", 5: "EMPTY", 6: "REDIRECTED", 7: "OK", 8: "LAYOUT_CHANGE", 9: "BLOCKED", 10: "EMPTY"}


HISTORY = "ts string, rows long, field string, n long, nulls long, kinds array<struct<first:int,kind:string,n:long>>, median double, min double, max double"


def run(ts, rows=10, median=20.0, kind="currency", nulls=0):
    return (ts, rows, "price", rows - nulls, nulls, [(0, kind, rows - nulls)], median, 1.0, 99.0)


def test_drift(spark):
    base = spark.createDataFrame([run(f"t{i}") for i in range(3)], HISTORY)
    codes = lambda *a, b=base, **k: sorted(r.code for r in P.detect_drift(b, spark.createDataFrame([run("now", *a, **k)], HISTORY)).collect())
    assert codes() == []
    assert codes(median=24.0) == ["MAGNITUDE_SHIFT"]
    assert codes(rows=16) == ["ROW_COUNT_SHIFT"]
    assert codes(kind="numeric") == ["KIND_SHIFT"]
    assert codes(nulls=4) == ["NULL_RATE_SHIFT"]
    assert codes(median=24.0, b=base.limit(2)) == []
    one = P.detect_drift(spark.createDataFrame([run("fixture:2024-01-01")], HISTORY), spark.createDataFrame([run("now", median=24.0)], HISTORY)).collect()
    assert one[0].code == "MAGNITUDE_SHIFT" and "20% up" in one[0].detail and "provisional: only 1 reference observation" in one[0].detail


def test_drift_over_time_tells_a_change_of_kind(spark):
    runs = [("s", *run(f"t{i:02}", kind="currency" if i < 5 else "numeric")) for i in range(12)]
    h = spark.createDataFrame(runs, "spec string, " + HISTORY)
    got = P.drift_over_time(h, limit=4).orderBy("ts").collect()
    assert [(r.ts, r.code, r.change) for r in got] == [("t05", "KIND_SHIFT", None), ("t06", "KIND_SHIFT", None), ("t07", "KIND_SHIFT", None)]
    assert P.drift_over_time(h.drop("kinds"), limit=4).count() == 0


def test_retirement(spark):
    f = spark.createDataFrame([("s", "2020-01-01", False), ("s", "2020-02-01", True), ("s", "2024-01-02", False), ("s", "2024-01-03", False)], "spec string, source string, ok boolean")
    got = {r.source for r in P.retirement(f, F.lit("2024-01-10").cast("timestamp"), keep=2).collect()}
    assert got == {"2020-01-01"}


def test_snapshot(spark):
    s = "k string, v double, x array<string>"
    seen = spark.createDataFrame([("a", 1.0, ["p"]), ("b", 2.0, None), ("c", 3.0, [])], s)
    now = spark.createDataFrame([("a", 1.0, ["p"]), ("b", 5.0, None), ("d", 4.0, ["q", "r"]), ("d", 4.0, ["q", "r"]), (None, 1.0, None)], s)
    counts = {r.change: r.n for r in D.compare(now, seen, ["k"]).groupBy("change").agg(F.count("*").alias("n")).collect()}
    assert counts == {"unchanged": 1, "updated": 1, "added": 3, "removed": 1}
    e = {r.k: r for r in D.change_events(now, seen, ["k"], "t").collect()}
    assert e["b"]._before.v == 2.0 and e["d"]._change == "added" and e["d"]._before is None
    assert [r.value for r in D.csv_lines(spark.createDataFrame([('x"y', 19.0, ["a", "b,c"])], s)).collect()] == ['"x""y",19,"a; b,c"']
    assert D.new_rows(now, seen, ["k"]).count() == 3


def test_sinks(spark, tmp_path):
    now = spark.createDataFrame([("a", 1.0)], "k string, v double")
    empty = now.limit(0)
    at = dt.datetime(2024, 1, 2, tzinfo=dt.UTC)
    out = {"path": str(tmp_path / "{name}-{date}.jsonl"), "mode": "changes", "key": "k"}
    assert D.persist(now, empty, out, "s", at, True) == {"added": 1} and D.persist(now, empty, out, "s", at, False) == {}
    assert spark.read.json(str(tmp_path / "s-2024-01-02.jsonl")).first()._change == "added"
    with pytest.raises(SpecError):
        D.write_rows(now, str(tmp_path / "x.json"), None, "append")
    assert format_for("a.csv") == "csv" and format_for("a.dat") == "jsonl"


def test_infer_is_right_on_its_own_page():
    for seed in range(1, 8):
        page = catalogue(4 + seed % 5, seed)
        spec, n, _ = infer_spec(page, "http://e/", "x")
        assert spec.row == ".item" and n == 4 + seed % 5 and not violations(parse(page), spec) and len(spec.fields) >= 2
    table = "<table class=t><thead><tr><th>City</th><th>People</th></tr></thead><tbody>" + "".join(f"<tr><td>Place number {i}</td><td>{i * 1000}</td></tr>" for i in range(1, 6)) + "</tbody></table>"
    spec, n, _ = infer_spec(table, "http://e/", "x")
    assert n == 5 and list(spec.fields) == ["city", "people"] and spec.fields["people"].type == "number" and not violations(parse(table), spec)
    assert infer_spec("<p>nothing", "http://e/", "x") is None


def test_repair():
    archive = [("2024-01-01", parse(catalogue()))]
    moved = repair(SPEC, parse(catalogue(cost='<b data-testid="cost-value">{}</b>', scale=1.1)), archive)
    assert moved.patched.fields["price"].selector == '.cost, [data-testid="cost-value"]'
    renamed = repair(SPEC, parse(catalogue(row_class="plan-card")), archive)
    assert renamed.patched.row == ".item, .plan-card"
    gone = repair(SPEC, parse(catalogue(cost="", stars=True)), archive)
    assert gone.patched is None and gone.unhealed == ["price"]
    broken = lambda *a: (_ for _ in ()).throw(RuntimeError())
    assert repair(SPEC, parse(catalogue(cost="", stars=True)), archive, broken).unhealed == ["price"]
    assert union_selector("a, b", "b") == "a, b" and union_selector(None, "x") == "x"
    assert run_demo() == 0


def test_scrape_heals(spark):
    got = api.scrape(spark, SPEC, html=catalogue(4, 2, cost='<b data-testid="cost-value">{}</b>'), archive=[("2024-01-01", catalogue(4))])
    assert got.ok and got.repair.fixes and got.rows.count() == 4
    assert "cost-value" in api.render_repair(got.repair) and api.pr_title("x", got.repair).endswith("of x") and "price" in api.pr_body(got.repair)
    with pytest.raises(RuntimeError):
        api.rows(spark, SPEC, html="<p>Access denied")
    assert api.check(spark, SPEC, allowed=lambda u: False).cause == "DISALLOWED"


MOVED = dict(cost='<b data-testid="cost-value">{}</b>')


def test_scrape_heals_paginated_targets(spark):
    spec = replace(SPEC, url="http://e/1", paginate={"template": "http://e/{page}", "maxPages": 3})
    site = {"http://e/1": catalogue(4, 2, **MOVED), "http://e/2": catalogue(3, 3, **MOVED)}
    asked = []

    def fetch(url):
        asked.append(url)
        return Fetched(200 if url in site else 404, url, site.get(url, ""), 0)

    got = api.scrape(spark, spec, fetch=fetch, archive=[("2024-01-01", catalogue(4))])
    assert got.ok and got.repair.fixes and got.rows.count() == 7 and len(got.pages) == 3
    assert asked == ["http://e/1", "http://e/2", "http://e/3"]


def test_scrape_never_repairs_against_a_redirect_or_a_forbidden_page(spark):
    archive = [("2024-01-01", catalogue(4))]
    away = lambda url: Fetched(200, "https://login.example/", catalogue(4, 2, **MOVED), 0)
    got = api.scrape(spark, SPEC, fetch=away, archive=archive)
    assert got.cause == "REDIRECTED" and got.repair is None
    asked = []
    got = api.scrape(spark, SPEC, fetch=lambda u: asked.append(u) or away(u), archive=archive, allowed=lambda u: False)
    assert got.cause == "DISALLOWED" and not asked
    robots = robots_gate(lambda u: Fetched(200, u, "User-agent: *\nDisallow: /a*b$\nDisallow: /c\nAllow: /c/d", 0))
    assert [robots(f"http://e{p}") for p in ("/", "", "/axb", "/axbx", "/c/x", "/c/d")] == [True, True, False, True, False, True]


def test_auth_headers_reach_every_fetch(spark, monkeypatch):
    monkeypatch.setenv("WEFT_TOKEN", "s3cret")
    spec = replace(SPEC, url="http://e/1", auth={"headers": {"X-Token": "WEFT_TOKEN"}}, paginate={"template": "http://e/{page}", "maxPages": 2})
    asked = []
    got = api.check(spark, spec, fetch=lambda u, headers=None: asked.append(headers) or Fetched(200, u, catalogue(3), 0))
    assert got.ok and asked == [{"X-Token": "s3cret"}] * 2
    req = urllib.request.Request("http://e/1", headers={"User-Agent": "w", "X-Token": "s3cret"})
    for to, kept in (("http://e/2", True), ("http://other/2", False)):
        new = web._Redirect().redirect_request(req, None, 302, "", {}, to)
        assert new.has_header("X-token") == kept and new.has_header("User-agent")


def test_watch_cli_keeps_history_rows_and_rest(spark, tmp_path, monkeypatch):
    from weftline import cli

    monkeypatch.chdir(tmp_path)
    monkeypatch.setattr(cli, "get_spark", lambda: spark)
    monkeypatch.setattr(cli, "robots_gate", lambda: lambda url: True)
    page, asked = {"html": catalogue(4)}, []
    fetch = lambda u: asked.append(u) or Fetched(200, u, page["html"], 0)
    scrape = api.scrape
    monkeypatch.setattr(api, "scrape", lambda *a, **k: scrape(*a, **(k | {"fetch": fetch})))
    (tmp_path / "specs").mkdir()
    spec = replace(SPEC, output={"path": str(tmp_path / "out.jsonl"), "mode": "append", "key": "title"})
    (tmp_path / "specs" / f"{spec.name}.json").write_text(json.dumps(spec_to_dict(spec)))
    for _ in range(3):
        assert cli.main(["watch", "specs"]) == 0
    assert P.load_history(spark, "fixtures", spec.name).select("ts").distinct().count() == 3
    out = spark.read.json(str(tmp_path / "out.jsonl"))
    assert out.count() == 4 and set(out.columns) == set(spec.fields)  # the later runs had nothing new
    history = tmp_path / "fixtures" / spec.name / "history.jsonl"
    history.write_text("{broken\n" + history.read_text())
    page["html"] = catalogue(4, scale=2.0)
    got = api.scrape(spark, spec, output=False, history_root="fixtures")
    assert {d["code"] for d in got.drift} == {"MAGNITUDE_SHIFT"}
    assert P.prune_history("fixtures", spec.name, 1) == 3
    page["html"] = "<p>Access denied"
    n = len(asked)
    assert cli.main(["watch", "specs"]) == 1 and len(asked) == n + 1
    assert cli.main(["watch", "specs", "--cycles", "1"]) == 0 and len(asked) == n + 1  # it rests


def test_specs_and_settings():
    raw = {"name": "n", "url": "http://e/", "row": ".r", "fields": {"a": {"selector": ".a", "type": "list", "minItems": 2}}, "expect": {"rows": {"min": 1}}}
    assert spec_to_dict(spec_from_dict(raw)) == raw
    for bad in ({}, {"name": "n", "url": "u", "fields": {}}, raw | {"fields": {"a": {"selector": ".a", "type": "date"}}}, raw | {"output": {"path": "x.json", "mode": "append"}}):
        with pytest.raises(SpecError):
            spec_from_dict(bad)
    assert parse_duration("2h") == 7200 and format_duration(900) == "15m" and format_duration(45) == "45s"


def test_web(tmp_path):
    pages = {"u1": Fetched(200, "http://e/u1", '<a class=n href="u2">', 0), "http://e/u2": Fetched(200, "http://e/u2", '<a class=n href="u1x">', 0), "http://e/u1x": Fetched(404, "http://e/u1x", "", 0)}
    assert [f.status for f in paginate("u1", {"next": ".n"}, pages.__getitem__)] == [200, 200, 404]
    asked = []
    paginate("", {"template": "p{page}", "maxPages": 3}, lambda u: asked.append(u) or Fetched(200, u, "", 0))
    assert asked == ["p1", "p2", "p3"]
    r = parse_robots("User-agent: *\nDisallow: /a\n\nUser-agent: weft\nuser-agent: x\nDisallow: /b\nAllow: /b/c\nCrawl-delay: 2 # c", "Weftline/1")
    assert r.disallow == ["/b"] and r.allow == ["/b/c"] and r.crawl_delay == 2
    assert save_fixture(str(tmp_path), "s", "x", "2024-01-01").name == "2024-01-01.html" and save_fixture(str(tmp_path), "s", "x", "2024-01-01").name == "2024-01-01-2.html"


def result(spec, ts, ok, cause="OK", unhealed=(), healed=(), drift=()):
    return (spec, ts, ok, cause, list(healed), list(unhealed), list(drift))


CYCLE = [result("s", "1", True), result("s", "2", False, "LAYOUT_CHANGE", ["price"]), result("s", "3", False, "LAYOUT_CHANGE", ["price"]), result("s", "4", False, "LAYOUT_CHANGE", ["name", "price"]), result("s", "5", True), result("t", "1", True, drift=["price/KIND_SHIFT"])]


def test_watch(spark, tmp_path):
    df = spark.createDataFrame(CYCLE, RESULT)
    want = [("s", "2", "unrepaired"), ("s", "4", "unrepaired"), ("s", "5", "recovered"), ("t", "1", "drift")]
    assert sorted((r.spec, r.ts, r.event) for r in watch_fold(df).collect()) == want
    assert [cooldown_for(n, "BLOCKED") for n in (1, 2, 3, 9)] == [2, 4, 8, 8] and [cooldown_for(n, "HTTP_ERROR") for n in (3, 4, 5, 9)] == [0, 1, 2, 4]
    s, e = advance(State(cooldown=2), {"spec": "s", "ts": "9", "ok": True, "cause": "OK"})
    assert s.cooldown == 1 and e is None


def test_notify_never_fails(tmp_path):
    def bad(e):
        raise OSError("down")

    seen = []
    out = dispatch({"spec": "s", "event": "broken"}, [("bad", bad), ("ok", seen.append)])
    assert out[0][1] == "OSError: down" and out[1][1] is None and seen


def test_doctor_and_cli(spark, tmp_path, monkeypatch, capsys):
    from weftline import cli

    found = api.doctor([SPEC], Settings(), str(tmp_path))
    assert ("error", "catalogue", "no archived page: nothing can be repaired") in found
    (tmp_path / "catalogue.json").write_text(json.dumps(spec_to_dict(SPEC)))
    (tmp_path / "live.html").write_text(catalogue(4))
    monkeypatch.setattr(cli, "get_spark", lambda: spark)
    assert cli.main(["check", str(tmp_path / "catalogue.json"), "--html", str(tmp_path / "live.html")]) == 0
    assert cli.main(["init", "http://e/", "--html", str(tmp_path / "live.html")]) == 0 and '"row": ".item"' in capsys.readouterr().out
    assert cli.main(["check", str(tmp_path / "none.json")]) == 2


def test_entry_registers_everything(spark):
    import __spark_entry__ as E

    assert E.entry(spark).count() > 0
    assert set(E.oracle_sql()) <= set(E.queries()) and len(E.queries()) > 20


def test_serialise():
    from weftline.sources.html import parse, serialise

    p = parse('<div id=a style="x" onclick=y data-q="1&quot;2" hidden>One  <b>two</b> 3 &lt; 4<script>no()</script><br>end<i><u><s>deep text</s></u></i></div>')
    assert serialise(p, 1) == '<div id="a" data-q="1&quot;2" hidden>One <b>two</b> 3 &lt; 4<br>end<i><u><s>deep text</s></u></i></div>'
    assert serialise(p, 1, max_depth=1) == '<div id="a" data-q="1&quot;2" hidden>One <b>two</b> 3 &lt; 4<br>end<i>deep text</i></div>'
    assert serialise(p, 0, max_text=2).startswith('<div id="a"') and "On\u2026" in serialise(p, 0, max_text=2)


def test_model_proposals():
    from weftline.operators import model as M

    assert M.read_answer('Sure:\n```json\n{"selectors": [" .a ", "", 3, ".a"], "note": "n"}\n```') == ([".a"], "n")
    assert M.read_answer("none")[1] == "no json in reply" and M.read_answer("{x}")[1] == "unparseable json in reply" and M.read_answer('{"selectors": 1}')[0] == []
    live, golden = parse(catalogue(4, cost="<q>{}</q>")), parse(catalogue(4))
    asked = M.question(SPEC, live, [golden], "price")
    assert "field price" in asked and "<q>" in asked and len(asked) <= M.PROMPT_CHARS + 10
    waits, calls = [], []

    def post(url, headers, body):
        calls.append((url, headers, body))
        if len(calls) == 1:
            return 429, {"retry-after": "7"}, "busy"
        if len(calls) == 2:
            return 503, {}, "down"
        return 200, {}, json.dumps({"choices": [{"message": {"content": '{"selectors": ["q"]}'}}]})

    got = M.hosted_model({"model": "m"}, {"OPENAI_API_KEY": "k"}, post, waits.append)(SPEC, live, [golden], "price")
    assert got == ["q"] and waits == [7.0, 2.0] and calls[0][0].endswith("/chat/completions") and calls[0][1]["Authorization"] == "Bearer k"
    answers = {"anthropic": {"content": [{"type": "text", "text": "A"}]}, "gemini": {"candidates": [{"content": {"parts": [{"text": "A"}]}}]}, "ollama": {"message": {"content": "A"}}}
    for name, reply in answers.items():
        assert M.ask({"provider": name, "model": "m"}, "u", {k: "x" for k in M.PROVIDERS[name].keys}, lambda *a, r=reply: (200, {}, json.dumps(r))) == "A"
    for config, env in (({}, {}), ({"provider": "openai", "model": "m"}, {}), ({"provider": "none", "model": "m"}, {}), ({"provider": "ollama"}, {})):
        with pytest.raises(M.ModelError):
            M.ask(config, "u", env, post)
    with pytest.raises(M.ModelError):
        M.ask({"provider": "ollama", "model": "m"}, "u", {}, lambda *a: (400, {}, "bad"))
    assert M.model_finding(True, {})[0] == "error" and M.model_finding(None, {}) is None and M.model_finding({"provider": "ollama"}, {}) is None


def test_a_pace_a_host_keeps_and_robots_are_asked_again():
    from weftline.sources import web as Web

    now, slept, asked = [0.0], [], []
    robots = "User-agent: *\nCrawl-delay: 5\nDisallow: /no"
    fetch = lambda u, **k: asked.append(u) or Fetched(200, u, robots, 0)
    gate = Web.RobotsGate(fetch, ttl=100, clock=lambda: now[0])
    assert gate("http://a/yes") and not gate("http://a/no") and len(asked) == 1
    now[0] = 101.0
    assert gate("http://a/yes") and len(asked) == 2

    def sleep(s):
        slept.append(s)
        now[0] += s

    paced = Web.polite(fetch, 1.0, gate, clock=lambda: now[0], sleep=sleep)
    for u in ("http://a/1", "http://a/2", "http://b/1", "http://a/3"):
        paced(u)
    assert slept == [5.0, 5.0]


def test_browser_fetcher():
    from weftline.sources import browser as B

    class Fake:
        def __init__(self):
            self.url, self.aborted = "http://a/end", []
            self.status = 200

        def new_context(self, **k):
            return self

        new_page = goto = lambda self, *a, **k: self

        def route(self, pattern, handler):
            for kind in ("image", "document"):
                request = type("R", (), {"resource_type": kind})
                handler(type("Route", (), {"request": request, "abort": lambda s: self.aborted.append(kind), "continue_": lambda s: None})())

        def content(self):
            return "<p>shown"

        def wait_for_selector(self, s, timeout):
            if s == ".never":
                raise TimeoutError(s)

        def close(self):
            pass

    fake = Fake()
    got = B.browser_fetch(lambda: fake, wait_for="p")("http://a/")
    assert (got.status, got.final_url, got.html) == (200, "http://a/end", "<p>shown") and fake.aborted == ["image"]
    assert B.browser_fetch(lambda: fake, wait_for=".never")("http://a/").status == 0
    if not B.available():
        with pytest.raises(B.BrowserMissing):
            B.browser_fetch()("http://a/")


def test_all_specs_run_though_one_fails(spark):
    def fetch(url):
        if url.endswith("bad"):
            raise ValueError("broken fetcher")
        return Fetched(200, url, catalogue(4), 0)

    specs = [replace(SPEC, name=n, url=f"http://e/{n}") for n in ("one", "bad", "two")]
    got = api.scrape_all(spark, specs, concurrency=2, fetch=fetch)
    assert [(c.spec.name, c.cause) for c in got] == [("one", "OK"), ("bad", "ERROR"), ("two", "OK")]


def test_kind_histogram_equals_its_sql_on_odd_lines(spark, tmp_path):
    import duckdb

    from weftline.plans import catalog

    lines = ["5 centésimos", "éeuro", "Euroñ x", "dollar_ 1", "x y z a b c d", " ", "1 2", "1\u000b2", "12 \u0085", "12\u0085", "centſ now", "ſcent x", "yenK", "USD", "", " \t", "1 2%", "\r", "pounds.", "😀inr"]
    texts = [*lines, "\n".join(lines), None, "\n\n", "a b\n"]
    db = duckdb.connect()
    for each in texts:  # a histogram of all could hide two differences
        one = spark.createDataFrame([(each,)], "text string")
        one.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "one" / "documents.parquet"))
        db.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/one/documents.parquet/*.parquet')")
        assert sorted(map(tuple, catalog.kind_histogram(spark, str(tmp_path / "one")).collect())) == sorted(db.execute(catalog.SQL["kind_histogram"]).fetchall()), repr(each)
