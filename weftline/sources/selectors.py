"""Selector language: compiled once, evaluated set by set in document order.

``compile_selector`` gives groups of steps; ``evaluate`` keeps, step by step, the
set of nodes below the root that the path so far reaches, using the id ranges of
``Page``; no backtracking is needed, since only the reached set matters.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from weftline.functions.scalars import SPACE
from weftline.sources.html import Page

_WS = re.compile(rf"[{SPACE}]+")
_IDENT = re.compile(r"[A-Za-z0-9_\-]*")
_BODY = re.compile(r"([A-Za-z0-9_:\-]+)\s*(?:([~^$*|]?=)\s*(.*))?", re.S)


class SelectorError(ValueError):
    pass


@dataclass(frozen=True)
class Test:
    """kind: any, tag, class, id, attr, pseudo."""

    kind: str
    name: str = ""
    op: str | None = None
    value: str | None = None


@dataclass(frozen=True)
class Step:
    lead: str  # "" for the first, else one of " ", ">", "+", "~"
    tests: tuple[Test, ...]


def _top_commas(s: str) -> list[str]:
    out, depth, quote, start = [], 0, "", 0
    for i, c in enumerate(s):
        if quote:
            if c == quote and s[i - 1] != "\\":
                quote = ""
        elif c in "\"'":
            quote = c
        elif c in "[(":
            depth += 1
        elif c in "])":
            depth -= 1
        elif c == "," and depth == 0:
            out.append(s[start:i])
            start = i + 1
    return [*out, s[start:]]


def _compound(s: str, at: int) -> tuple[tuple[Test, ...], int]:
    tests: list[Test] = []
    while at < len(s):
        c = s[at]
        if _WS.match(c) or c in ">+~,":
            break
        if c == "*":
            tests.append(Test("any"))
            at += 1
        elif c in ".#":
            m = _IDENT.match(s, at + 1)
            if not m[0]:
                raise SelectorError(f"a name is missing after {c!r} in {s!r}")
            tests.append(Test("class" if c == "." else "id", m[0]))
            at = m.end()
        elif c == "[":
            end = s.find("]", at)
            if end < 0:
                raise SelectorError(f"[ without ] in {s!r}")
            m = _BODY.fullmatch(s[at + 1 : end].strip())
            if not m:
                raise SelectorError(f"bad attribute test in {s!r}")
            value = m[3].strip() if m[3] is not None else None
            if value and len(value) >= 2 and value[0] in "\"'" and value[-1] == value[0]:
                value = value[1:-1]
            tests.append(Test("attr", m[1].lower(), m[2], value))
            at = end + 1
        elif c == ":":
            at += 2 if s[at + 1 : at + 2] == ":" else 1
            m = _IDENT.match(s, at)
            at, arg = m.end(), None
            if s[at : at + 1] == "(":
                depth, k = 1, at + 1
                while k < len(s) and depth:
                    depth += {"(": 1, ")": -1}.get(s[k], 0)
                    k += 1
                arg = s[at + 1 : k - 1] if depth == 0 else s[at + 1 : k]
                at = k
            tests.append(Test("pseudo", m[0].lower(), None, arg))
        else:
            m = _IDENT.match(s, at)
            if not m[0]:
                raise SelectorError(f"unexpected {c!r} in {s!r}")
            tests.append(Test("tag", m[0].lower()))
            at = m.end()
    return tuple(tests), at


def _sequence(s: str) -> tuple[Step, ...]:
    steps: list[Step] = []
    lead, at = "", 0
    while at < len(s):
        if m := _WS.match(s, at):
            at = m.end()
        elif s[at] in ">+~":
            lead = s[at]
            at += 1
        else:
            tests, at = _compound(s, at)
            if not tests:
                raise SelectorError(f"cannot read {s!r} at {at}")
            steps.append(Step((lead or " ") if steps else "", tests))
            lead = ""
    return tuple(steps)


@lru_cache(maxsize=4096)
def compile_selector(text: str) -> tuple[tuple[Step, ...], ...]:
    groups = tuple(_sequence(_WS.sub(" ", g).strip()) for g in _top_commas(text))
    if not all(groups):
        raise SelectorError(f"empty selector in {text!r}")
    return groups


@lru_cache(maxsize=1024)
def nth(arg: str) -> tuple[int, int] | None:
    """(a, b) of an+b."""
    s = _WS.sub("", arg).lower()
    if s in ("odd", "even"):
        return 2, int(s == "odd")
    if re.fullmatch(r"[+-]?\d+", s):
        return 0, int(s)
    m = re.fullmatch(r"([+-]?\d*)n([+-]\d+)?", s)
    if not m:
        return None
    a = {"": 1, "+": 1, "-": -1}.get(m[1])
    return int(m[1]) if a is None else a, int(m[2] or 0)


def nth_holds(place: int, a: int, b: int) -> bool:
    return place == b if a == 0 else (place - b) % a == 0 and (place - b) // a >= 0


def holds(page: Page, k: int, t: Test) -> bool:
    if t.kind == "any":
        return True
    if t.kind == "tag":
        return page.tag[k] == t.name
    if t.kind == "class":
        return t.name in page.classes(k)
    if t.kind == "id":
        return page.attrs[k].get("id") == t.name
    if t.kind == "attr":
        have, want = page.attrs[k].get(t.name), t.value
        if have is None:
            return False
        if t.op is None or want is None:
            return True
        return {
            "=": have == want,
            "^=": bool(want) and have.startswith(want),
            "$=": bool(want) and have.endswith(want),
            "*=": bool(want) and want in have,
            "~=": want in _WS.split(have),
            "|=": have == want or have.startswith(want + "-"),
        }[t.op]
    place, total = page.sib[k] + 1, page.kids[page.parent[k]] if page.parent[k] >= 0 else 1
    if t.name == "first-child":
        return place == 1
    if t.name == "last-child":
        return place == total
    if t.name == "only-child":
        return total == 1
    if t.name == "nth-child":
        ab = nth(t.value) if t.value else None
        return ab is not None and nth_holds(place, *ab)
    if t.name == "not":
        # Only groups of a single compound can exclude.
        return bool(t.value) and not any(len(g) == 1 and all(holds(page, k, x) for x in g[0].tests) for g in compile_selector(t.value))
    return True  # other pseudo-classes say nothing here


def _reach(page: Page, steps: tuple[Step, ...], root: int) -> list[int]:
    lo, hi = root + 1, page.end[root]
    found: list[int] = []
    for step in steps:
        if step.lead == "":
            near = range(lo, hi + 1)
        elif step.lead == ">":
            have = set(found)
            near = [k for k in range(lo, hi + 1) if page.parent[k] in have]
        elif step.lead == " ":
            near, upto = [], -1
            have = set(found)
            for k in range(lo, hi + 1):
                if k <= upto:
                    near.append(k)
                if k in have:
                    upto = max(upto, page.end[k])
        else:
            least: dict[int, int] = {}
            for k in found:
                p = page.parent[k]
                if step.lead == "~":
                    least[p] = min(least.get(p, page.sib[k]), page.sib[k])
            if step.lead == "~":
                near = [k for k in range(lo, hi + 1) if least.get(page.parent[k], 1 << 60) < page.sib[k]]
            else:
                after = {page.end[k] + 1 for k in found}
                near = [k for k in range(lo, hi + 1) if k in after and page.sib[k] > 0]
                before = {(page.parent[k], page.sib[k]) for k in found}
                near = [k for k in near if (page.parent[k], page.sib[k] - 1) in before]
        found = [k for k in near if all(holds(page, k, t) for t in step.tests)]
        if not found:
            return []
    return found


def evaluate(page: Page, selector: str, root: int = 0) -> list[int]:
    """Ids below ``root`` that the selector matches, in document order, each once."""
    groups = compile_selector(selector)
    if len(groups) == 1:
        return _reach(page, groups[0], root)
    return sorted({k for g in groups for k in _reach(page, g, root)})
