"""Command line: ``python -m weftline.cli check|extract|repair|init|fixture|drift|doctor|watch|demo``.

Exit codes: 0 fine, 1 the target failed, 2 the call was wrong.
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys
import time
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from weftline.operators.model import hosted_model
from weftline.operators.repair import repair
from weftline.plans import api
from weftline.session import get_spark
from weftline.sources.html import parse
from weftline.sources.selectors import SelectorError
from weftline.sources.specs import SpecError, load_settings, load_spec, load_specs, patch_spec_file, spec_to_dict
from weftline.sources.web import AuthError, RobotsGate, http_fetch, load_fixtures, polite, robots_gate, save_fixture
from weftline.streaming.notify import dispatch, notifiers
from weftline.streaming.watch import advance


def _page(args) -> str:
    return Path(args.html).read_text() if args.html else api.fetch_pages(load_spec(args.spec), allowed=robots_gate())[0].html


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="weftline")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("check", "extract", "repair", "fixture", "drift"):
        c = sub.add_parser(name)
        c.add_argument("spec")
        c.add_argument("--html")
        c.add_argument("--fixtures", default="fixtures")
        c.add_argument("--history", help="folder of run histories; the fixtures' folder if not given")
        c.add_argument("--record", action="store_true", help="add a passing run to the history")
        c.add_argument("--write", action="store_true")
        c.add_argument("--only")
    c = sub.add_parser("init")
    c.add_argument("url")
    c.add_argument("--html")
    c.add_argument("--name", default="scraper")
    for name in ("doctor", "watch"):
        c = sub.add_parser(name)
        c.add_argument("specs")
        c.add_argument("--fixtures", default="fixtures")
        c.add_argument("--history")
        c.add_argument("--state", default="watch-state.json")
        c.add_argument("--cycles", type=int, default=1, help="cycles to watch, an interval apart; 0 is without end")
    sub.add_parser("demo")
    try:
        args = p.parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    try:
        return _run(args)
    except (api.Disallowed, AuthError) as e:
        print(e, file=sys.stderr)
        return 1
    except (SpecError, SelectorError, FileNotFoundError, json.JSONDecodeError) as e:
        print(e, file=sys.stderr)
        return 2


def _run(args) -> int:
    if args.command == "init":
        html = Path(args.html).read_text() if args.html else http_fetch(args.url).html
        got = api.infer_spec(html, args.url, args.name)
        if got is None:
            print("no repeating records found", file=sys.stderr)
            return 1
        print(json.dumps(spec_to_dict(got[0]), indent=2))
        print("\n".join(got[2]), file=sys.stderr)
        return 0
    if args.command == "doctor":
        found = api.doctor(load_specs(args.specs), load_settings("."), args.fixtures)
        print("\n".join(f"{s}: {n} {t}" for s, n, t in found) or "all is well")
        return int(any(s == "error" for s, _, _ in found))
    if args.command == "demo":
        from weftline.plans.demo import run_demo

        return run_demo()
    if args.command == "watch":
        n, failed = 0, 0
        while True:
            failed, n = _watch_once(args), n + 1
            if n == args.cycles:
                return failed
            time.sleep(load_settings(".").interval)
    spec = load_spec(args.spec)
    archive = load_fixtures(args.fixtures, spec.name)
    if args.command == "fixture":
        print(save_fixture(args.fixtures, spec.name, _page(args), dt.datetime.now(dt.UTC).strftime("%Y-%m-%d")))
        return 0
    if args.command == "repair":
        r = repair(spec, parse(_page(args)), [(s, parse(h)) for s, h in archive])
        print(api.render_repair(r))
        if args.write:
            for v in r.fixes:
                if not args.only or v.candidate.target == args.only:
                    patch_spec_file(args.spec, v.candidate.target, v.proposed)
        return int(bool(r.unhealed))
    spark = get_spark()
    html, kept = Path(args.html).read_text() if args.html else None, {"allowed": robots_gate(), "archive": archive, "history_root": args.history or args.fixtures, "record": args.record}
    if args.command == "extract":
        c = api.scrape(spark, spec, html, heal=False, state=args.fixtures, **kept)
    else:
        c = api.check(spark, spec, html, **kept)
    if args.command == "extract" and c.rows is not None:
        for line in c.rows.toJSON().toLocalIterator():
            print(line)
    else:
        print(api.render_check(c))
    return int(not c.ok or args.command == "drift" and bool(c.drift))


def _watch_once(args) -> int:
    """One cycle over all specs, with its state in a file."""
    from weftline.streaming.watch import State

    path = Path(args.state)
    try:
        state = {k: State(**v) for k, v in json.loads(path.read_text()).items()}
    except (FileNotFoundError, json.JSONDecodeError, TypeError):
        state = {}
    settings, spark, failed = load_settings("."), get_spark(), 0
    channels = notifiers(settings.notify or [{"type": "console"}])
    allowed = robots_gate()
    awake = []
    for spec in load_specs(args.specs):
        resting = state.get(spec.name)
        if resting and resting.cooldown > 0:
            state[spec.name], _ = advance(resting, {})
        else:
            awake.append(spec)
    fetch = polite(http_fetch, float(settings.politeness.get("delay") or 0), allowed if isinstance(allowed, RobotsGate) else None)

    model = hosted_model(settings.model) if settings.model else None

    def run(spec):
        try:
            return api.scrape(
                spark, spec, archive=load_fixtures(args.fixtures, spec.name), heal=settings.heal != "off", model=model, allowed=allowed, output=settings.output, state=args.fixtures,
                history_root=args.history or args.fixtures, record=True, fetch=fetch,
            )
        except Exception as e:  # one target's fault neither ends the cycle nor loses the state
            return api.Check(spec, "ERROR", f"{type(e).__name__}: {e}", None)

    with ThreadPoolExecutor(max(1, settings.concurrency)) as pool:
        found = list(pool.map(run, awake))
    for spec, c in zip(awake, found, strict=True):
        r = c.repair
        result = {
            "spec": spec.name, "ts": dt.datetime.now(dt.UTC).isoformat(), "ok": c.ok, "cause": c.cause,
            "healed": [v.candidate.target for v in r.fixes] if r else [], "unhealed": r.unhealed if r else [], "drift": [f"{d['field']}/{d['code']}" for d in c.drift],
        }
        state[spec.name], event = advance(state.get(spec.name), result)
        failed += not c.ok
        if event:
            dispatch(event, channels)
    path.write_text(json.dumps({k: vars(v) for k, v in state.items()}, indent=2))
    return int(failed > 0)


if __name__ == "__main__":
    sys.exit(main())
