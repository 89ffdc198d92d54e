"""Spec inference: from one page to rows and fields, as a search over node ids."""

from __future__ import annotations

import math
import re

from weftline.sources import indoc
from weftline.sources.html import Page, parse
from weftline.sources.selectors import SelectorError, evaluate
from weftline.sources.specs import Field, Spec

MAX_FIELDS, MIN_ROWS, SHARE = 8, 2, 0.6

# Regions that repeat like records and hold none.
CHROME_TAGS = frozenset(("nav", "footer", "header", "aside"))
CHROME_ROLES = frozenset(("navigation", "contentinfo", "banner", "search", "complementary"))
CHROME_WORDS = re.compile(
    r"(^|[-_ ])(nav|navbar|navigation|menu|footer|sidebar|breadcrumb|pagination|reference|references|reflist|footnote|citation|cookie"
    r"|social-share|share-buttons|carousel|slider|modal|dialog)([-_ ]|$)",
    re.I,
)
LIST_TAGS = frozenset(("ul", "ol", "dl", "tbody", "table"))


def matches(page: Page, selector: str, root: int = 0) -> list[int]:
    try:
        return evaluate(page, selector, root)
    except SelectorError:
        return []


def in_chrome(page: Page, k: int) -> bool:
    while k > 0 and page.tag[k] not in ("body", "html"):
        a = page.attrs[k]
        if page.tag[k] in CHROME_TAGS or a.get("role", "").lower() in CHROME_ROLES or CHROME_WORDS.search(a.get("class", "")) or CHROME_WORDS.search(a.get("id", "")):
            return True
        k = page.parent[k]
    return False


def holds_value(page: Page, k: int) -> bool:
    """Text stands here and not in parts below: nothing below has text, or one element has just this."""
    text = page.norm_text(k)
    below = [t for x in range(k + 1, page.end[k] + 1) if (t := page.norm_text(x))]
    return bool(text) and (not below or below == [text])


def numeric(values: list[str]) -> bool:
    return bool(values) and all(indoc.parse_number(v) is not None and indoc.kind_of(v) in ("currency", "numeric") for v in values)


def positional(selector: str) -> bool:
    return ":nth-child" in selector or bool(re.fullmatch("[A-Za-z]+", selector.strip()))


class Column:
    """What a selector finds in each row."""

    def __init__(self, page: Page, selector: str, k: int, rows: list[int]):
        self.selector, self.el = selector, k
        hits = [matches(page, selector, r) for r in rows]
        texts = [[page.norm_text(x) for x in h] for h in hits]
        self.counts = [sum(map(bool, t)) for t in texts]
        self.texts = [x for t in texts for x in t if x]
        self.first = [t[0] if t else "" for t in texts]
        self.els = {x for h in hits for x in h}
        self.list = any(n > 1 for n in self.counts)

    def worth(self, n: int) -> bool:
        most = math.ceil(n * SHARE)
        return sum(c > 0 for c in self.counts) >= most and not (n > 2 and len(set(self.texts)) == 1) and (self.list or sum(map(bool, self.first)) >= most)

    def tier(self) -> int:
        return 1 if self.list else 2 if positional(self.selector) else 0

    def information(self) -> float:
        variety = len(set(self.texts)) / len(self.texts) if self.texts else 0
        return variety * 2 + sum(c > 0 for c in self.counts) / len(self.counts) - 0.2 * len(re.split(r"[\s>]+", self.selector))

    def field(self) -> Field:
        everywhere = all(self.counts)
        if self.list:
            return Field(self.selector, "list", min_items=max(1, min(self.counts))) if everywhere else Field(self.selector, "list", required=False)
        values = [t for t in self.first if t]
        if numeric(values):
            low = min(indoc.parse_number(v) for v in values)
            return Field(self.selector, "number", everywhere, min=0 if low > 0 and everywhere else None)
        return Field(self.selector, "string", everywhere)


def columns_for(page: Page, rows: list[int]) -> list[Column]:
    kept: dict[str, Column] = {}
    tried: dict[str, Column | None] = {}
    for row in rows:
        for k in range(row + 1, page.end[row] + 1):
            if holds_value(page, k):
                for s in indoc.selectors_for(page, row, k)[:4]:
                    if s not in tried:
                        c = Column(page, s, k, rows)
                        tried[s] = c if c.worth(len(rows)) else None
                        if tried[s]:
                            kept[s] = c
    return list(kept.values())


def slug(text: str, most: int | None = None) -> str:
    s = re.sub("[^a-zA-Z0-9]+", "_", text).strip("_").lower()
    return s[:most].rstrip("_") if most else s


def fresh(prefix: str, index: int, used: set[str]) -> str:
    while f"{prefix}_{index}" in used:
        index += 1
    return f"{prefix}_{index}"


def field_name(page: Page, k: int, used: set[str], index: int) -> str:
    a, up = page.attrs[k], page.parent[k]
    near = [a.get("data-testid"), a.get("data-test"), a.get("itemprop"), a.get("data-field"), *indoc.stable_classes(page, k)]
    if up >= 0 and page.tag[up] in LIST_TAGS:
        near += [*indoc.stable_classes(page, up), page.attrs[up].get("itemprop")]
    if page.tag[k] in ("h1", "h2", "h3"):
        near.append("title")
    for raw in near:
        name = slug(raw or "")
        if name and len(name) <= 30 and name not in used:
            return name
    return fresh("field", index, used)


def header_name(text: str, used: set[str], index: int) -> str:
    s = slug(re.sub(r"\[[^\]]*\]", " ", text), 30)
    return s if s and s not in used and not s.isdigit() else fresh("column", index, used)


def header_cells(page: Page, first: int) -> list[str]:
    kids = page.children(first)
    if len(kids) >= 2 and all(page.tag[k] == "th" for k in kids):
        return [page.norm_text(k) for k in kids]
    up = page.parent[first]
    while up > 0 and page.tag[up] != "table":
        up = page.parent[up]
    head = matches(page, "thead th", up) if up > 0 else []
    return [page.norm_text(k) for k in head] if len(head) >= 2 else []


def infer_table(page: Page, rows: list[int]) -> tuple[list[int], dict[str, Field], int] | None:
    """Data rows, fields by cell position, and how many header rows stand before."""
    if not rows or page.tag[rows[0]] != "tr":
        return None
    has_data = [any(page.tag[c] == "td" for c in page.children(r)) for r in rows]
    skip = has_data.index(True) if True in has_data else len(rows)
    data = [r for r, ok in zip(rows, has_data, strict=True) if ok]
    if len(data) < MIN_ROWS or skip == 0:
        return None
    heads, wide = header_cells(page, rows[0]), max(len(page.children(r)) for r in data)
    fields: dict[str, Field] = {}
    for place in range(1, wide + 1):
        if len(fields) == MAX_FIELDS:
            break
        best, values = "", []
        for tag in ("td", "th"):
            s = f"{tag}:nth-child({place})"
            got = [page.norm_text(h[0]) if (h := matches(page, s, r)) else "" for r in data]
            if sum(map(bool, got)) > sum(map(bool, values)):
                best, values = s, got
        there = [v for v in values if v]
        if len(there) < math.ceil(len(data) * SHARE) or len(data) > 2 and len(set(there)) == 1:
            continue
        name = header_name(heads[place - 1] if len(heads) == wide else "", set(fields), place)
        fields[name] = Field(best, "number" if numeric(there) else "string", all(values))
    return (data, fields, skip) if len(fields) >= 2 else None


def best_rows(page: Page) -> tuple[list[int], str] | None:
    """The selector whose matches look most like records; the first found on ties."""
    best, score = None, -math.inf
    for _, _, members in indoc.repeated_groups(page, MIN_ROWS):
        sample = members[0]
        average = sum(len(page.norm_text(m)) for m in members) / len(members)
        values = sum(holds_value(page, k) for k in range(sample + 1, page.end[sample] + 1)) if average >= 8 else 0
        if values < 2 or in_chrome(page, sample):
            continue
        own = 1 if indoc.stable_classes(page, sample) else 0
        for s in indoc.selectors_for(page, 0, sample)[:6]:
            hits = matches(page, s)
            if len(hits) < MIN_ROWS:
                continue
            off = abs(len(hits) - len(members)) / len(members)
            place = 3 if ":nth-child" in s else 0.5 if positional(s) else 0
            got = min(values, 8) * 1.2 + math.log2(len(hits)) * 1.5 + min(average, 200) / 50 + own - 3 * off - place
            if got > score:
                best, score = (hits, s), got
    return best


def infer_spec(html: str, url: str, name: str) -> tuple[Spec, int, list[str]] | None:
    """(spec, rows, notes), or nothing where no records repeat."""
    page = parse(html)
    found = best_rows(page)
    if found is None:
        return None
    rows, base = found
    last = "review the types and bounds before trusting it"
    bounds = lambda n: {"rows_min": max(1, n // 2), "rows_max": 2 * n}
    if table := infer_table(page, rows):
        data, fields, skip = table
        bare = re.sub(r"\s*>?\s*tr$", "", base)
        for s in (f"{bare} tbody tr", f"{base}:nth-child(n+{skip + 1})", f"{bare} tbody tr:nth-child(n+{skip + 1})"):
            if len(matches(page, s)) == len(data):
                return Spec(name, url, fields, s, **bounds(len(data))), len(data), [f"a table with {len(data)} data rows at {s}", f"columns from the header: {', '.join(fields)}", last]
    columns = sorted((c for c in columns_for(page, rows) if c.texts), key=lambda c: (c.tier(), -c.information()))
    fields, taken, dropped = {}, set(), 0
    for c in columns:
        if len(fields) == MAX_FIELDS:
            break
        if c.els and all(_claimed(page, k, taken) for k in c.els):
            dropped += 1
            continue
        taken |= c.els
        fields[field_name(page, c.el, set(fields), len(fields) + 1)] = c.field()
    if not fields:
        return None
    notes = [f"{len(rows)} repeating records at {base}", f"fields: {', '.join(fields)}"]
    if dropped:
        notes.append(f"{dropped} column(s) dropped that other fields cover")
    if lists := [n for n, f in fields.items() if f.type == "list"]:
        notes.append(f"several elements a record, so lists: {', '.join(lists)}")
    return Spec(name, url, fields, base, **bounds(len(rows))), len(rows), [*notes, last]


def _claimed(page: Page, k: int, taken: set[int]) -> bool:
    while k >= 0:
        if k in taken:
            return True
        k = page.parent[k]
    return False
