"""The library's surface: check, scrape (with repair), rows, infer, doctor, reports."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import extract as X
from weftline.operators import profile as P
from weftline.operators import snapshot as D
from weftline.operators.infer import infer_spec
from weftline.operators.model import model_finding
from weftline.operators.repair import Model, Repair, repair
from weftline.operators.repair import violations as page_violations
from weftline.sources import browser
from weftline.sources.html import parse
from weftline.sources.specs import Settings, Spec, load_spec, spec_from_dict, spec_to_dict
from weftline.sources.web import AuthError, Fetched, Fetcher, auth_headers, http_fetch, load_fixtures, paginate

__all__ = ["Check", "check", "doctor", "infer_spec", "resolve_spec", "rows", "scrape", "scrape_all", "render_check", "render_repair", "pr_title", "pr_body"]

PAGES = "page_no int, url string, final_url string, status int, html string"


def resolve_spec(spec: Spec | dict | str | Path) -> Spec:
    if isinstance(spec, Spec):
        return spec_from_dict(spec_to_dict(spec))
    return spec_from_dict(spec) if isinstance(spec, dict) else load_spec(spec)


@dataclass
class Check:
    """What one run over one target found; ``rows`` is lazy."""

    spec: Spec
    cause: str
    detail: str
    rows: DataFrame | None
    violations: list[dict] = field(default_factory=list)
    drift: list[dict] = field(default_factory=list)
    repair: Repair | None = None
    n_rows: int = 0
    pages: list[Fetched] = field(default_factory=list)
    written: dict[str, int] = field(default_factory=dict)

    @property
    def ok(self) -> bool:
        return self.cause == "OK"


class Disallowed(RuntimeError):
    pass


def fetch_pages(spec: Spec, fetch: Fetcher = http_fetch, allowed: Callable[[str], bool] | None = None) -> list[Fetched]:
    """All pages of a target, asked with the headers its auth names; each URL is held to the robots test before it is asked."""
    headers = auth_headers(spec.auth)

    def get(url: str) -> Fetched:
        if allowed is not None and not allowed(url):
            raise Disallowed(f"robots.txt does not allow {url}")
        return fetch(url, headers=headers) if headers else fetch(url)

    return paginate(spec.url, spec.paginate, get)


def check(
    spark: SparkSession, spec: Spec, html: str | None = None, fetch: Fetcher = http_fetch, allowed: Callable[[str], bool] | None = None, history: DataFrame | None = None,
    archive: list[tuple[str, str]] = (), ts: str | None = None, pages: list[Fetched] | None = None, history_root: str | None = None, record: bool = False,
) -> Check:
    """Fetch (or take ``html`` or fetched ``pages``), extract, hold to the contract, classify, compare with history.

    The history is given, or kept under ``history_root``; with ``record`` a passing run is added to it.
    """
    try:
        auth_headers(spec.auth)
        if html is not None:
            pages = [Fetched(200, spec.url, html, 0)]
        pages = pages or fetch_pages(spec, fetch, allowed)
    except Disallowed as e:
        return Check(spec, "DISALLOWED", str(e), None)
    except AuthError as e:
        return Check(spec, "HTTP_ERROR", str(e), None)
    ts = ts or dt.datetime.now(dt.UTC).isoformat()
    df = spark.createDataFrame([(i, spec.url, p.final_url, p.status, p.html) for i, p in enumerate(pages)], PAGES)
    scanned = X.scan(df, spec, facts=True)
    # Rows of all pages form one result; the first page's facts classify it.
    one = scanned.agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "found"))), lambda x: x["found"])).alias("found"),
        *[F.min_by(c, "page_no").alias(c) for c in ("challenge", "page_text", "n_elements", "html_length", "status", "final_url", "url")],
    )
    judged = X.with_violations(one, spec).withColumn("cause", X.cause_column(F.lit(spec.url), F.col("status"), F.col("final_url"))).cache()
    r = judged.select("cause", F.size("found").alias("n"), "violations", "status", "final_url").first()
    out = Check(spec, r["cause"], f"{r['n']} rows, {len(r['violations'])} violations, HTTP {r['status']}", X.rows(judged.select("found"), spec), [v.asDict() for v in r["violations"]], n_rows=r["n"], pages=pages)
    if history is None and history_root is not None:
        history = P.load_history(spark, history_root, spec.name)
    if out.ok and (history is not None or archive):
        now = run_record(judged.select(F.lit(ts).alias("ts"), "found"), spec)
        seeds = None
        for source, page in archive:
            if page_violations(parse(page), spec):
                continue  # a page that fails its contract is no reference
            seed = run_record(X.scan(spark.createDataFrame([(f"fixture:{source}", page)], "ts string, html string"), spec), spec)
            seeds = seed if seeds is None else seeds.unionByName(seed)
        base = P.baseline(history, seeds, ts) if history is not None else seeds
        if base is not None:
            out.drift = [d.asDict() for d in P.detect_drift(base, now).collect()]
        if record and history_root is not None:
            P.append_run(history_root, spec.name, now)
    return out


def run_record(scanned: DataFrame, spec: Spec) -> DataFrame:
    """A run's profile, with its row count on every field."""
    stats = P.summarise(X.cells(scanned, spec, ["ts"]), ["ts"])
    return stats.join(scanned.select("ts", F.size("found").alias("rows")), "ts")


def scrape(
    spark: SparkSession, spec: Spec | dict | str, html: str | None = None, archive: list[tuple[str, str]] = (), heal: bool = True, model: Model | None = None, fetch: Fetcher = http_fetch,
    output: dict | bool | None = None, state: str = "fixtures", **options,
) -> Check:
    """A check; if the layout changed and archived pages are there, a proved repair and a check with it.

    Rows of a passing run are written as the spec's ``output`` says, or the one given (False: not at all);
    what was seen for it is kept under ``state``.
    """
    spec = resolve_spec(spec)
    got = _healed(spark, spec, html, archive, heal, model, fetch, options)
    to = spec.output if output is None or output is True else output
    if to and got.ok:
        got.written = D.persist_run(got.rows, to, spec.name, dt.datetime.now(dt.UTC), state)
    return got


def _healed(spark: SparkSession, spec: Spec, html: str | None, archive: list[tuple[str, str]], heal: bool, model: Model | None, fetch: Fetcher, options: dict) -> Check:
    first = check(spark, spec, html, fetch, archive=archive, **options)
    if first.cause != "LAYOUT_CHANGE" or not heal:
        return first
    # The first page shows the new layout, however many there are.
    fixed = repair(spec, parse(first.pages[0].html), [(s, parse(h)) for s, h in archive], model)
    if fixed.patched is None:
        first.repair = fixed
        return first
    second = check(spark, fixed.patched, archive=archive, **(options | {"pages": first.pages}))
    second.repair = fixed
    return second


def scrape_all(spark: SparkSession, specs: list[Spec], concurrency: int = 4, **options) -> list[Check]:
    """All specs, ``concurrency`` at a time, in their order; one that fails outright is an ``ERROR`` and stops no other."""

    def one(spec: Spec) -> Check:
        try:
            return scrape(spark, spec, **options)
        except Exception as e:  # a fault of one target is its own
            return Check(spec, "ERROR", f"{type(e).__name__}: {e}", None)

    with ThreadPoolExecutor(max(1, concurrency)) as pool:
        return list(pool.map(one, specs))


def rows(spark: SparkSession, spec: Spec | dict | str, **options) -> DataFrame:
    """The rows of a target that passes; anything else is an error."""
    got = scrape(spark, spec, **options)
    if not got.ok:
        raise RuntimeError(f"{got.spec.name}: {got.cause} ({got.detail})")
    return got.rows


# --- reports ---------------------------------------------------------------------------


def render_check(c: Check) -> str:
    lines = [f"{c.spec.name}: {c.cause} ({c.detail})"]
    lines += [f"  {v['code']} {v['field'] or ''} {'' if v['row'] is None else 'row ' + str(v['row'])}: {v['detail']}" for v in c.violations[:20]]
    lines += [f"  drift {d['field']} {d['code']}: {d['detail']}" for d in c.drift]
    return "\n".join(lines)


def render_repair(r: Repair) -> str:
    lines = [f"fixed {v.candidate.target}: {v.proposed} [{v.candidate.via}, score {v.candidate.score:.2f}]" for v in r.fixes]
    for v in r.rejected:
        lines.append(f"refused {v.candidate.target}: {v.candidate.selector}: " + "; ".join(f"{n}: {d}" for n, ok, d in v.passes if not ok))
    lines += [f"no repair for {t}" for t in r.unhealed] + [f"archived page no longer passes: {s}" for s in r.stale]
    return "\n".join(lines) or "nothing to repair"


def pr_title(name: str, r: Repair) -> str:
    return f"Repair {len(r.fixes)} selector(s) of {name}"


def pr_body(r: Repair) -> str:
    out = ["| target | selector | gates |", "|---|---|---|"]
    out += [f"| {v.candidate.target} | `{v.proposed}` | {', '.join(n for n, ok, _ in v.passes if ok)} |" for v in r.fixes]
    return "\n".join(out)


# --- doctor ----------------------------------------------------------------------------


def doctor(specs: list[Spec], settings: Settings, fixtures_root: str, history_runs: dict[str, int] | None = None, env: dict | None = None, today: dt.date | None = None) -> list[tuple[str, str, str]]:
    """(severity, spec, finding): fixtures, history, secrets, output, politeness, notification, heal."""
    import os

    env = os.environ if env is None else env
    today = today or dt.datetime.now(dt.UTC).date()
    out: list[tuple[str, str, str]] = []
    hosts: dict[str, int] = {}
    for s in specs:
        archive = load_fixtures(fixtures_root, s.name)
        good = [n for n, h in archive if not page_violations(parse(h), s)]
        if not archive:
            out.append(("error", s.name, "no archived page: nothing can be repaired"))
        elif not good:
            out.append(("error", s.name, "no archived page passes the spec"))
        else:
            ages = [(today - dt.date.fromisoformat(n[:10])).days for n in good if n[:4].isdigit()]
            if ages and min(ages) > 180:
                out.append(("warn", s.name, f"the newest passing archived page is {min(ages)} days old"))
        if history_runs is not None and history_runs.get(s.name, 0) < P.MIN_HISTORY and not good:
            out.append(("warn", s.name, "too few runs to judge drift"))
        try:
            auth_headers(s.auth, env)
        except AuthError as e:
            out.append(("error", s.name, str(e)))
        if s.output and s.output.get("mode") in ("append", "changes") and not s.output.get("key"):
            out.append(("warn", s.name, "no key: any change makes a row new"))
        host = s.url.split("/")[2] if "//" in s.url else s.url
        hosts[host] = hosts.get(host, 0) + 1
    if hosts and max(hosts.values()) > 1 and not settings.politeness.get("delay"):
        busiest = max(hosts, key=hosts.get)
        out.append(("warn", "", f"{hosts[busiest]} specs ask {busiest} without a delay"))
    for c in settings.notify:
        if c.get("urlEnv") and not env.get(c["urlEnv"]):
            out.append(("error", "", f"{c['type']}: {c['urlEnv']} is not set"))
    wanted = model_finding(settings.model, env)
    if wanted:
        out.append(wanted)
    for s in specs:
        if getattr(s, "render", None) and not browser.available():
            out.append(("error", s.name, "asks for a browser, and none is installed"))
    if not settings.notify:
        out.append(("warn", "", "nobody is told when a target breaks"))
    if settings.heal == "off":
        out.append(("info", "", "repair is switched off"))
    return out
