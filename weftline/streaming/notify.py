"""Telling people: channels behind one call, none of which can fail a run."""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable
from pathlib import Path

Notifier = Callable[[dict], None]


def console(event: dict) -> None:
    print(f"[{event['event']}] {event['spec']} {event.get('condition', '')}")


def to_file(path: str) -> Notifier:
    def send(event: dict) -> None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        with open(path, "a") as f:
            f.write(json.dumps(event) + "\n")

    return send


def post(url_env: str, body: Callable[[dict], dict] = dict, timeout: float = 10) -> Notifier:
    """To the URL that an environment variable holds."""

    def send(event: dict) -> None:
        url = os.environ[url_env]
        request = urllib.request.Request(url, json.dumps(body(event)).encode(), {"Content-Type": "application/json"})
        urllib.request.urlopen(request, timeout=timeout).close()

    return send


def line(event: dict) -> str:
    return f"{event['spec']}: {event['event']} ({event.get('condition', '')})"


KINDS: dict[str, Callable[[dict], Notifier]] = {
    "console": lambda c: console,
    "file": lambda c: to_file(c["path"]),
    "webhook": lambda c: post(c["urlEnv"]),
    "slack": lambda c: post(c["urlEnv"], lambda e: {"text": line(e)}),
    "discord": lambda c: post(c["urlEnv"], lambda e: {"content": line(e)}),
}


def notifiers(configs: list[dict]) -> list[tuple[str, Notifier]]:
    return [(c["type"], KINDS[c["type"]](c)) for c in configs]


def dispatch(event: dict, channels: list[tuple[str, Notifier]]) -> list[tuple[str, str | None]]:
    """Each channel with what went wrong there, if anything."""
    out = []
    for name, send in channels:
        try:
            send(event)
            out.append((name, None))
        except Exception as e:  # a channel that fails is reported, and stops nothing
            out.append((name, f"{type(e).__name__}: {e}"))
    return out
