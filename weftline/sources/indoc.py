"""What is asked of one page by itself: values, kinds, shapes, selectors for an element.

The same answers as the Column kernels, for use inside an Arrow pass.
"""

from __future__ import annotations

import re

from weftline.functions.scalars import CURRENCY_SIGNS, CURRENCY_WORDS, SPACE
from weftline.sources.html import Page, norm
from weftline.sources.selectors import evaluate
from weftline.sources.specs import Field, Spec

# Attributes that survive redesigns, best first.
STABLE_ATTRS = ("data-testid", "data-test", "data-test-id", "data-qa", "data-cy", "itemprop", "data-field", "name", "aria-label")

_NUMBER = re.compile(r"-?(?:[0-9]+\.?[0-9]*|\.[0-9]+)")
_CURRENCY = re.compile(rf"[{CURRENCY_SIGNS}]|\b(?:{CURRENCY_WORDS})\b", re.I | re.A)
_NUMERIC = re.compile(rf"[0-9.,{SPACE}%+/\-]+")
_HASHED = re.compile(r"(?:css|sc|jsx|emotion|styles?)[-_]|[a-z]{1,3}-[a-z0-9]{6,}$", re.I)


def parse_number(text: str) -> float | None:
    s = re.sub(r"[^0-9.,\-]", "", text)
    if "," in s and "." in s:
        s = s.replace(".", "").replace(",", ".", 1) if s.rindex(",") > s.rindex(".") else s.replace(",", "")
    elif "," in s:
        s = s.replace(",", "") if re.search(r",[0-9]{3}(?![0-9])", s) else s.replace(",", ".", 1)
    m = _NUMBER.match(s)
    return float(m[0]) if m else None


def kind_of(text: str) -> str:
    t = norm(text)
    if not t:
        return "empty"
    if _CURRENCY.search(t):
        return "currency"
    if _NUMERIC.fullmatch(t):
        return "numeric"
    n = t.count(" ") + 1
    return "words-short" if n <= 2 else "words-mid" if n <= 6 else "words-long"


def shape_of(text: str) -> str:
    return norm(re.sub("[A-Za-z]+", "W", re.sub("[0-9]+", "#", text)))[:40]


def looks_hashed(name: str) -> bool:
    return bool(_HASHED.match(name)) or len(name) >= 8 and "-" not in name and bool(re.search("[0-9]", name)) and bool(re.search("[A-Za-z]", name))


def stable_classes(page: Page, k: int) -> list[str]:
    return [c for c in page.classes(k) if not looks_hashed(c)]


def jaccard(a: list[str], b: list[str]) -> float:
    x, y = set(a), set(b)
    return len(x & y) / len(x | y) if x or y else 1.0


def path_similarity(a: list[tuple[str, int]], b: list[tuple[str, int]]) -> float:
    n = min(len(a), len(b))
    if not n:
        return 0.0
    weights = [1 / (i + 1) for i in range(n)]
    agree = [0.0 if x[0] != y[0] else 1.0 if x[1] == y[1] else 0.6 for x, y in zip(a[::-1], b[::-1], strict=False)]
    score = sum(w * s for w, s in zip(weights, agree, strict=True)) / sum(weights)
    return score * (0.7 + 0.3 * (1 - abs(len(a) - len(b)) / max(len(a), len(b))))


def group_signature(page: Page, k: int) -> str:
    return f"{page.tag[k]}.{'.'.join(sorted(stable_classes(page, k)))}"


def selectors_for(page: Page, row: int, k: int) -> list[str]:
    """Selectors that address ``k`` from ``row``, most durable first, each once."""
    tag, out = page.tag[k], []
    for a in STABLE_ATTRS:
        if v := page.attrs[k].get(a):
            test = f'[{a}="{re.sub(chr(34) + "|" + re.escape(chr(92)), lambda m: chr(92) + m[0], v)}"]'
            out += [test, tag + test]
    classes = stable_classes(page, k)
    for c in classes:
        out += [f".{c}", f"{tag}.{c}"]
    out += [f".{a}.{b}" for i, a in enumerate(classes) for b in classes[i + 1 :]]
    if not classes:
        out += [f"{tag}.{c}" for c in page.classes(k)]
    up = page.parent[k]
    for _ in range(3):
        if up < 0 or up == row:
            break
        for name in stable_classes(page, up):
            out += [f".{name} .{c}" for c in classes]
            out += [f".{name} > {tag}"] if up == page.parent[k] else []
            out.append(f".{name} {tag}")
        up = page.parent[up]
    out.append(tag)
    path = page.path(row, k)
    if 0 < len(path) <= 5:
        out.append(" > ".join(f"{t}:nth-child({i})" for t, i in path))
        out.append(f"{path[-1][0]}:nth-child({path[-1][1]})")
    return list(dict.fromkeys(out))


# --- extraction ----------------------------------------------------------------


def read(page: Page, k: int, f: Field) -> str:
    return page.attrs[k].get(f.attr, "").strip() if f.attr else page.norm_text(k)


def cell(page: Page, els: list[int], f: Field) -> tuple:
    """(raw, string, number, list) of the elements a field's selector found."""
    if f.type == "list":
        items = [s for e in els if (s := read(page, e, f))]
        return " | ".join(items), None, None, items
    if not els:
        return "", None, None, None
    raw = read(page, els[0], f)
    return (raw, None, parse_number(raw), None) if f.type == "number" else (raw, raw or None, None, None)


def rows_of(page: Page, spec: Spec) -> list[int]:
    return evaluate(page, spec.row) if spec.row else [0]


def extract(page: Page, spec: Spec) -> list[dict[str, tuple]]:
    """Per row, per field: (raw, string, number, list, elements)."""
    out = []
    for row in rows_of(page, spec):
        got = {}
        for name, f in spec.fields.items():
            els = evaluate(page, f.selector, row)
            got[name] = (*cell(page, els, f), els)
        out.append(got)
    return out


def value(c: tuple, f: Field):
    return c[3] if f.type == "list" else c[2] if f.type == "number" else c[1]


def repeated_groups(page: Page, least: float) -> list[tuple[int, str, list[int]]]:
    """(parent, signature, members) of siblings alike, parents in document order."""
    out = []
    for parent in range(len(page)):
        if page.kids[parent] < least:
            continue
        by: dict[str, list[int]] = {}
        for k in page.children(parent):
            by.setdefault(group_signature(page, k), []).append(k)
        out += [(parent, s, m) for s, m in by.items() if len(m) >= least]
    return out
