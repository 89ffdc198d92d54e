"""A language model as one more source of selectors: what it is asked, how its answer is read, where it is reached.

``hosted_model`` gives a callable of the kind that ``repair`` takes; what it says passes the same
gates as any other proposal.  The network stands behind one callable (``post``), so tests and closed
clusters bring their own.
"""

from __future__ import annotations

import json
import os
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

from weftline.operators.infer import matches
from weftline.sources import indoc
from weftline.sources.html import Page, serialise
from weftline.sources.specs import ROW, Spec

SAMPLES, PROMPT_CHARS, ANSWER_TOKENS = 3, 14_000, 700
TRIES, LONGEST_WAIT = 3, 30.0
RETRY_ON = frozenset({408, 409, 425, 429, 500, 502, 503, 504, 529})

INSTRUCTIONS = (
    "A selector of a web extraction no longer matches because the page's markup changed. Propose CSS selectors for the new markup. "
    "Allowed: tags, classes, ids, attribute tests, :first-child, :last-child, :nth-child, :not, and the combinators space, >, + and ~. "
    'Answer with one JSON object only: {"selectors": ["best first", "..."], "note": "one line"}.'
)


def question(spec: Spec, live: Page, goldens: list[Page], target: str) -> str:
    """The target, what it was on pages that worked, and the markup that now fails; cut at ``PROMPT_CHARS``."""
    f = spec.fields.get(target)
    if target == ROW:
        head = ["Target: the record container", f"Selector so far: {json.dumps(spec.row or '')} ({len(matches(live, spec.row)) if spec.row else 0} matches now)"]
    else:
        bounds = {k: v for k, v in (("min", f.min), ("max", f.max), ("minItems", f.min_items)) if v is not None}
        head = [f"Target: field {target}", f"Selector so far: {json.dumps(f.selector)}", f"Type: {f.type}" + (f", from attribute {f.attr}" if f.attr else "") + (f", {json.dumps(bounds)}" if bounds else "")]
    before = []
    for page in goldens[:SAMPLES]:
        for row, cells in list(zip(indoc.rows_of(page, spec), indoc.extract(page, spec)))[:SAMPLES]:
            if target != ROW and cells[target][0]:
                before.append(f"value: {json.dumps(cells[target][0])}")
            before.append(serialise(page, row, max_depth=5))
    now = [serialise(live, 0, max_depth=4)] if target == ROW else [serialise(live, r, max_depth=5) for r in indoc.rows_of(live, spec)[:SAMPLES]]
    wanted = "Selectors of the repeating container are wanted." if target == ROW else f"Selectors of the {target} value are wanted, relative to a record."
    text = "\n".join([*head, "", "Markup that worked:", *before, "", "Markup that fails:", *now, "", wanted])
    return text if len(text) <= PROMPT_CHARS else text[:PROMPT_CHARS] + "\n[cut]"


def read_answer(text: str) -> tuple[list[str], str]:
    """Selectors and note of the JSON object in an answer, which may stand in a fence or in prose."""
    fence = re.search(r"```(?:json)?\s*(.*?)```", text, re.S)
    body = fence[1] if fence else text
    start, end = body.find("{"), body.rfind("}")
    if start < 0 or end <= start:
        return [], "no json in reply"
    try:
        got = json.loads(body[start : end + 1])
    except json.JSONDecodeError:
        return [], "unparseable json in reply"
    given = got.get("selectors") if isinstance(got, dict) else None
    found = [s.strip() for s in given if isinstance(s, str) and s.strip()] if isinstance(given, list) else []
    note = got.get("note") if isinstance(got, dict) else ""
    return list(dict.fromkeys(found)), note if isinstance(note, str) else ""


# --- where a model is reached ---------------------------------------------------------


class ModelError(RuntimeError):
    pass


@dataclass(frozen=True)
class Provider:
    """A public HTTP interface: address, the variables that may hold its key, a request, and where the answer stands."""

    base: str
    keys: tuple[str, ...]
    path: Callable[[str], str]
    headers: Callable[[str], dict[str, str]]
    body: Callable[[str, str], dict]
    answer: Callable[[dict], str]


def _chat(model: str, user: str) -> list[dict]:
    return [{"role": "system", "content": INSTRUCTIONS}, {"role": "user", "content": user}]


PROVIDERS = {
    "anthropic": Provider(
        "https://api.anthropic.com", ("ANTHROPIC_API_KEY",), lambda m: "/v1/messages", lambda k: {"x-api-key": k, "anthropic-version": "2023-06-01"},
        lambda m, u: {"model": m, "max_tokens": ANSWER_TOKENS, "system": INSTRUCTIONS, "messages": [{"role": "user", "content": u}]},
        lambda r: "".join(c.get("text", "") for c in r.get("content", []) if c.get("type") == "text"),
    ),
    "openai": Provider(
        "https://api.openai.com/v1", ("OPENAI_API_KEY",), lambda m: "/chat/completions", lambda k: {"Authorization": f"Bearer {k}"} if k else {},
        lambda m, u: {"model": m, "max_completion_tokens": ANSWER_TOKENS, "messages": _chat(m, u)}, lambda r: r["choices"][0]["message"]["content"] or "",
    ),
    "gemini": Provider(
        "https://generativelanguage.googleapis.com", ("GEMINI_API_KEY", "GOOGLE_API_KEY"), lambda m: f"/v1beta/models/{m}:generateContent", lambda k: {"x-goog-api-key": k},
        lambda m, u: {"systemInstruction": {"parts": [{"text": INSTRUCTIONS}]}, "contents": [{"role": "user", "parts": [{"text": u}]}], "generationConfig": {"maxOutputTokens": ANSWER_TOKENS}},
        lambda r: "".join(p.get("text", "") for p in r["candidates"][0]["content"]["parts"]),
    ),
    "ollama": Provider("http://localhost:11434", (), lambda m: "/api/chat", lambda k: {}, lambda m, u: {"model": m, "stream": False, "messages": _chat(m, u)}, lambda r: r["message"]["content"]),
}

Post = Callable[[str, dict[str, str], dict], tuple[int, dict[str, str], str]]


def http_post(url: str, headers: dict[str, str], body: dict, timeout: float = 60) -> tuple[int, dict[str, str], str]:
    """(status, headers in lower case, text); 0 where nothing answered."""
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"} | headers)
    low = lambda h: {k.lower(): v for k, v in h.items()}
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return r.status, low(r.headers), r.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, low(e.headers), e.read().decode("utf-8", "replace")
    except OSError as e:
        return 0, {}, str(e)


def chosen_provider(config: dict, env: dict) -> str | None:
    """The one that is named, else the first whose key is set."""
    named = config.get("provider")
    return named or next((n for n, p in PROVIDERS.items() if any(env.get(k) for k in p.keys)), None)


def ask(config: dict, user: str, env: dict | None = None, post: Post = http_post, sleep: Callable[[float], None] = time.sleep) -> str:
    """The answer's text.  Busy and failing servers are asked again, after as long as they say."""
    env = os.environ if env is None else env
    name = chosen_provider(config, env)
    if name not in PROVIDERS:
        raise ModelError("no provider is named and no key is set" if name is None else f"unknown provider {name}")
    p = PROVIDERS[name]
    names = (config["apiKeyEnv"],) if config.get("apiKeyEnv") else p.keys
    key = next((env[k] for k in names if env.get(k)), "")
    if names and not key and not config.get("baseUrl"):
        raise ModelError(f"{' or '.join(names)} is not set")
    if not config.get("model"):
        raise ModelError("the model is not named")
    url = (config.get("baseUrl") or p.base).rstrip("/") + p.path(config["model"])
    for turn in range(TRIES):
        status, heads, text = post(url, p.headers(key), p.body(config["model"], user))
        if status == 200:
            try:
                return p.answer(json.loads(text))
            except (json.JSONDecodeError, KeyError, IndexError, TypeError, AttributeError) as e:
                raise ModelError(f"{name} answered in another form") from e
        if status and status not in RETRY_ON or turn + 1 == TRIES:
            raise ModelError(f"{name}: HTTP {status}: {text[:200]}")
        said = heads.get("retry-after", "")
        sleep(min(LONGEST_WAIT, float(said) if re.fullmatch(r"\d+(\.\d+)?", said) else 2.0**turn))
    raise ModelError(name)


def hosted_model(config: dict, env: dict | None = None, post: Post = http_post, sleep: Callable[[float], None] = time.sleep):
    """A model for ``repair``: selectors for (spec, live, goldens, target)."""

    def propose(spec: Spec, live: Page, goldens: list[Page], target: str) -> list[str]:
        return read_answer(ask(config, question(spec, live, goldens, target), env, post, sleep))[0]

    return propose


def model_finding(config: dict | bool | None, env: dict) -> tuple[str, str, str] | None:
    """What a doctor says of the model's settings."""
    if not config:
        return None
    config = config if isinstance(config, dict) else {}
    name = chosen_provider(config, env)
    if name is None:
        return "error", "", "a model is wanted, but no provider is named and no key is set"
    if name not in PROVIDERS:
        return "error", "", f"unknown model provider {name}"
    names = (config["apiKeyEnv"],) if config.get("apiKeyEnv") else PROVIDERS[name].keys
    if names and not any(env.get(k) for k in names):
        return "error", "", f"{name}: {' or '.join(names)} is not set"
    return None
