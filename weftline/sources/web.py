"""Where pages come from: archives, live fetches behind a callable, pagination, robots rules."""

from __future__ import annotations

import base64
import os
import re
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path
from urllib.parse import unquote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.scalars import path_allowed as path_allowed_column
from weftline.sources.html import parse
from weftline.sources.selectors import evaluate

USER_AGENT = "weftline"


@dataclass(frozen=True)
class Fetched:
    status: int
    final_url: str
    html: str
    ms: int


#: Anything that turns a URL into a page: plain HTTP, a browser, an archive.  A target with auth calls it as (url, headers=...).
Fetcher = Callable[..., Fetched]


class AuthError(RuntimeError):
    pass


def auth_headers(auth: dict | None, env: dict | None = None) -> dict[str, str]:
    """Headers from the environment variables that a spec names; secrets stand in no spec."""
    env = os.environ if env is None else env

    def secret(name: str) -> str:
        if not env.get(name):
            raise AuthError(f"environment variable {name} is not set")
        return env[name]

    out: dict[str, str] = {}
    if auth:
        out |= {k: secret(v) for k, v in (auth.get("headers") or {}).items()}
        if auth.get("cookie"):
            out["Cookie"] = secret(auth["cookie"])
        if auth.get("basic"):
            pair = f"{secret(auth['basic']['user'])}:{secret(auth['basic']['pass'])}"
            out["Authorization"] = f"Basic {base64.b64encode(pair.encode()).decode()}"
    return out


class _Redirect(urllib.request.HTTPRedirectHandler):
    """Headers given by the caller, secrets maybe, do not follow to another origin."""

    def redirect_request(self, req, fp, code, msg, headers, newurl):
        new = super().redirect_request(req, fp, code, msg, headers, newurl)
        if new is not None and urlsplit(new.full_url)[:2] != urlsplit(req.full_url)[:2]:
            for name in list(new.headers):
                if name.lower() != "user-agent":
                    new.remove_header(name)
        return new


_OPENER = urllib.request.build_opener(_Redirect)


def http_fetch(url: str, headers: dict[str, str] | None = None, timeout: float = 20) -> Fetched:
    """Follows redirects; a failure before any response is status 0."""
    began = time.monotonic()
    spent = lambda: int(1000 * (time.monotonic() - began))
    try:
        with _OPENER.open(urllib.request.Request(url, headers={"User-Agent": USER_AGENT} | (headers or {})), timeout=timeout) as r:
            return Fetched(r.status, r.url, r.read().decode(r.headers.get_content_charset() or "utf-8", "replace"), spent())
    except urllib.error.HTTPError as e:
        return Fetched(e.code, e.url or url, e.read().decode("utf-8", "replace"), spent())
    except (OSError, ValueError) as e:
        return Fetched(0, url, f"<!-- {e} -->", spent())


def paginate(url: str, rule: dict | None, fetch: Fetcher) -> list[Fetched]:
    """The page, or a run of pages: by template ({page} once) or by the next link; stops on a seen URL, a failure or ``maxPages``."""
    if not rule:
        return [fetch(url)]
    most, seen, out = rule.get("maxPages", 10), set(), []
    if rule.get("template"):
        for n in range(rule.get("startPage", 1), rule.get("startPage", 1) + most):
            at = rule["template"].replace("{page}", str(n), 1)
            if at in seen:
                break
            seen.add(at)
            out.append(fetch(at))
            if out[-1].status != 200:
                break
        return out
    at: str | None = url
    while at and at not in seen and len(out) < most:
        seen.add(at)
        got = fetch(at)
        out.append(got)
        if got.status != 200:
            break
        page = parse(got.html)
        found = evaluate(page, rule["next"])
        at = resolve(got.final_url, page.attrs[found[0]].get("href")) if found else None
    return out


def resolve(base: str, href: str | None) -> str | None:
    try:
        return urljoin(base, href) if href else None
    except ValueError:
        return None


def template_urls(spark: SparkSession, template: str, start: int, most: int) -> DataFrame:
    return spark.range(start, start + most).select(F.col("id").cast("int").alias("page_no"), F.regexp_replace(F.lit(template), r"^(.*?)\{page\}", F.concat(F.lit("$1"), F.col("id").cast("string"))).alias("url"))


def until_failure(pages: DataFrame, run: str) -> DataFrame:
    """Pages of each run up to its first that is not 200, that one included."""
    stop = F.min(F.when(F.col("status") != 200, F.col("page_no"))).over(W.partitionBy(run))
    return pages.withColumn("_stop", stop).filter("_stop is null or page_no <= _stop").drop("_stop")


def fetch_all(urls: DataFrame, fetch: Fetcher = http_fetch, delay: float = 0.0) -> DataFrame:
    """``urls`` (url) with status, final_url, html and ms. A host stays in one task, which keeps its pace."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[str, float] = {}
        for pdf in batches:
            rows = []
            for url in pdf["url"]:
                host = urlsplit(url).netloc
                wait = last.get(host, -1e9) + delay - time.monotonic()
                if wait > 0:
                    time.sleep(wait)
                last[host] = time.monotonic()
                f = fetch(url)
                rows.append((url, f.status, f.final_url, f.html, f.ms))
            yield pd.DataFrame(rows, columns=["url", "status", "final_url", "html", "ms"])

    by_host = urls.select("url").withColumn("h", F.try_parse_url("url", F.lit("HOST"))).repartition("h").select("url")
    return by_host.mapInPandas(run, "url string, status int, final_url string, html string, ms long")


# --- robots.txt ---------------------------------------------------------------------


@dataclass
class Rules:
    allow: list[str] = field(default_factory=list)
    disallow: list[str] = field(default_factory=list)
    crawl_delay: float | None = None


def parse_robots(text: str, agent: str = USER_AGENT) -> Rules:
    """Rules of the first group that names the agent, else of the first for all; longest rules first."""
    groups: list[tuple[list[str], Rules]] = []
    naming = False
    for line in text.splitlines():
        name, sep, value = line.split("#", 1)[0].strip().partition(":")
        name, value = name.strip().lower(), value.strip()
        if not sep:
            continue
        if name == "user-agent":
            if not (groups and naming):
                groups.append(([], Rules()))
            groups[-1][0].append(value.lower())
            naming = True
            continue
        naming = False
        if not groups:
            continue
        rules = groups[-1][1]
        if name in ("allow", "disallow") and value:
            getattr(rules, name).append(unquote(value))
        elif name == "crawl-delay" and re.fullmatch(r"\d+(\.\d+)?", value):
            rules.crawl_delay = float(value)
    own = agent.lower()
    named = next((r for a, r in groups if any(x != "*" and x in own for x in a)), None)
    chosen = named or next((r for a, r in groups if "*" in a), Rules())
    longest = lambda x: sorted(x, key=len, reverse=True)
    return Rules(longest(chosen.allow), longest(chosen.disallow), chosen.crawl_delay)


def path_allowed(rules: Rules, path: str) -> bool:
    """The longest matching rule decides; allow wins at equal length."""

    def longest(found: list[str]) -> int:
        quoted = ((r, re.escape(r.removesuffix("$")).replace(r"\*", ".*") + ("$" if r.endswith("$") else "")) for r in found)
        return max((len(r) for r, q in quoted if re.match(q, path)), default=-1)

    no = longest(rules.disallow)
    return no == -1 or longest(rules.allow) >= no


class RobotsGate:
    """A test of URLs by their origin's robots.txt; whatever is not 2xx allows all.  An answer is good for ``ttl`` seconds."""

    def __init__(self, fetch: Fetcher = http_fetch, agent: str = USER_AGENT, ttl: float = 3600, clock: Callable[[], float] = time.monotonic):
        self.fetch, self.agent, self.ttl, self.clock = fetch, agent, ttl, clock
        self.known: dict[str, tuple[float, Rules]] = {}

    def rules(self, url: str) -> Rules:
        u = urlsplit(url)
        origin = f"{u.scheme}://{u.netloc}"
        if origin not in self.known or self.clock() - self.known[origin][0] > self.ttl:
            got = self.fetch(f"{origin}/robots.txt")
            self.known[origin] = self.clock(), parse_robots(got.html, self.agent) if 200 <= got.status < 300 else Rules()
        return self.known[origin][1]

    def __call__(self, url: str) -> bool:
        u = urlsplit(url)
        return path_allowed(self.rules(url), unquote(u.path or "/") + (f"?{u.query}" if u.query else ""))


def robots_gate(fetch: Fetcher = http_fetch, agent: str = USER_AGENT) -> RobotsGate:
    return RobotsGate(fetch, agent)


def polite(fetch: Fetcher, delay: float = 0.0, gate: RobotsGate | None = None, most: float = 60.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> Fetcher:
    """``fetch`` at a host's pace: at least ``delay`` seconds between two calls, or its crawl-delay if that is longer (``most`` at most). Threads wait in turn."""
    lock, free = threading.Lock(), {}

    def paced(url: str, **options) -> Fetched:
        asked = gate.rules(url).crawl_delay if gate is not None else None
        pause = min(most, max(delay, asked or 0.0))
        with lock:  # the next free moment of the host is taken before the wait
            host = urlsplit(url).netloc
            at = max(clock(), free.get(host, 0.0))
            free[host] = at + pause
        if at > clock():
            sleep(at - clock())
        return fetch(url, **options)

    return paced


def rules_table(spark: SparkSession, urls: DataFrame, fetch: Fetcher, agent: str = USER_AGENT) -> DataFrame:
    """origin, allow, disallow, crawl_delay: each origin is asked once; whatever is not 2xx allows all."""
    origin = F.regexp_extract("url", r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]+)", 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for o in pdf["origin"]:
                got = fetch(f"{o}/robots.txt")
                r = parse_robots(got.html, agent) if 200 <= got.status < 300 else Rules()
                out.append((o, r.allow, r.disallow, r.crawl_delay))
            yield pd.DataFrame(out, columns=["origin", "allow", "disallow", "crawl_delay"])

    return urls.select(origin.alias("origin")).distinct().mapInPandas(run, "origin string, allow array<string>, disallow array<string>, crawl_delay double")


def with_permission(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (url) with ``allowed`` and ``crawl_delay`` by the rules of their origin; an origin without rules allows all."""
    origin = F.regexp_extract("url", r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]+)", 1)
    rest = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]+([^#]*)", 1)
    path = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    asked = urls.withColumn("_origin", origin).join(rules.withColumnRenamed("origin", "_origin"), "_origin", "left")
    none = F.array().cast("array<string>")
    verdict = path_allowed_column(F.coalesce(F.try_url_decode(path), path), F.coalesce("allow", none), F.coalesce("disallow", none))
    return asked.withColumn("allowed", verdict).drop("_origin", "allow", "disallow")


# --- archives ------------------------------------------------------------------------


def fixtures(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Archived pages of a spec: source (the file's stem) and html."""
    raw = spark.read.text(f"{root}/{name}/*.html", wholetext=True)
    return raw.select(F.regexp_extract("_metadata.file_name", r"^(.*)\.html$", 1).alias("source"), F.col("value").alias("html"))


def load_fixtures(root: str, name: str) -> list[tuple[str, str]]:
    return [(p.stem, p.read_text()) for p in sorted(Path(root, name).glob("*.html"))]


def save_fixture(root: str, name: str, html: str, stamp: str) -> Path:
    """A new dated file; a second one of a day gets -2, and so on."""
    folder = Path(root, name)
    folder.mkdir(parents=True, exist_ok=True)
    path, n = folder / f"{stamp}.html", 2
    while path.exists():
        path, n = folder / f"{stamp}-{n}.html", n + 1
    path.write_text(html)
    return path
