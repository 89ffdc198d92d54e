"""Selector repair: learn from archived pages, score the live page, propose, prove.

Proposals for a field come from scoring every element of every live row against
a profile of archived values; proposals for rows from sibling groups.  A
proposal is united with the old selector and must pass four gates: live page,
archive, coverage, continuity.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

from weftline.operators.infer import matches
from weftline.sources import indoc
from weftline.sources.html import Page
from weftline.sources.specs import ROW, Spec

MAX_CANDIDATES, PER_ROW = 15, 4
MAGNITUDE, COVERAGE = 0.25, 0.25


@dataclass(frozen=True)
class Candidate:
    target: str
    selector: str
    score: float
    reason: str
    via: str = "heuristic"


@dataclass
class Verified:
    candidate: Candidate
    proposed: str
    passes: list[tuple[str, bool, str]] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return all(p[1] for p in self.passes)


def first_modal(keys: list):
    """Index of the first item whose key is most frequent, earliest key on ties."""
    counts = Counter(keys)  # insertion-ordered, and most_common is stable
    return keys.index(counts.most_common(1)[0][0])


# --- contract inside a page (the same rules as the Column form) -----------------------


def violations(page: Page, spec: Spec) -> list[tuple[str, str | None, int | None]]:
    rows, out = indoc.extract(page, spec), []
    if spec.rows_min is not None and len(rows) < spec.rows_min or spec.rows_max is not None and len(rows) > spec.rows_max:
        out.append(("ROW_COUNT", None, None))
    for i, r in enumerate(rows):
        for name, f in spec.fields.items():
            v = indoc.value(r[name], f)
            if f.type == "list":
                if f.min_items is not None and len(v) < f.min_items:
                    out.append(("LIST_TOO_SHORT", name, i))
                elif f.min_items is None and f.required and not v:
                    out.append(("FIELD_MISSING", name, i))
            elif v is None:
                if f.required is not False:
                    out.append(("FIELD_TYPE" if f.type == "number" and r[name][4] else "FIELD_MISSING", name, i))
            elif f.type == "number":
                out += [("FIELD_RANGE", name, i) for bad in (f.min is not None and v < f.min, f.max is not None and v > f.max) if bad]
    return out


# --- proposals --------------------------------------------------------------------


class Profile:
    """What archived elements of a field look like."""

    def __init__(self, spec: Spec, goldens: list[Page], target: str):
        self.texts, self.shapes, self.attrs, seen = set(), set(), {}, []
        for page in goldens:
            for row in indoc.rows_of(page, spec):
                for k in matches(page, spec.fields[target].selector, row):
                    text = page.norm_text(k)
                    seen.append((text, page.tag[k], sorted(indoc.stable_classes(page, k)), page.path(row, k)))
                    self.texts |= {text} - {""}
                    self.shapes |= {indoc.shape_of(text)} - {""}
                    for a in indoc.STABLE_ATTRS:
                        if v := page.attrs[k].get(a):
                            self.attrs.setdefault(a, set()).add(v)
        self.known = bool(seen)
        if seen:
            self.tag = seen[first_modal([s[1] for s in seen])][1]
            self.classes = seen[first_modal([tuple(s[2]) for s in seen])][2]
            self.path = seen[first_modal([tuple(t for t, _ in s[3]) for s in seen])][3]
            self.limit = 3 * (len(seen[0][0]) or 1)

    def score(self, page: Page, row: int, k: int) -> float:
        text, attrs = page.norm_text(k), page.attrs[k]
        stable = next((a for a in indoc.STABLE_ATTRS if attrs.get(a)), None)
        if not text and not stable:
            return 0.0
        shape = indoc.shape_of(text)
        got = 4.0 if text in self.texts else 2.5 if shape in self.shapes else 0.0
        got += (page.tag[k] == self.tag) + 2.5 * indoc.jaccard(indoc.stable_classes(page, k), self.classes) + 2.5 * indoc.path_similarity(page.path(row, k), self.path)
        if stable in self.attrs:
            got += 3.5 if attrs[stable] in self.attrs[stable] else 1
        if len(text) > self.limit:
            got -= min(2.5, len(text) / self.limit)
        return got - (page.end[k] - k > 6)


def propose_field(spec: Spec, live: Page, goldens: list[Page], target: str) -> list[Candidate]:
    f, profile = spec.fields[target], Profile(spec, goldens, target)
    rows = indoc.rows_of(live, spec)
    if not profile.known or not rows:
        return []
    totals: dict[str, list] = {}
    for i, row in enumerate(rows):
        scored = [(profile.score(live, row, k), k) for k in range(row + 1, live.end[row] + 1)]
        fits = [(s, k) for s, k in scored if s > 1.5 and (f.type != "number" or indoc.parse_number(live.attrs[k].get(f.attr, "") if f.attr else live.norm_text(k)) is not None)]
        for s, k in sorted(fits, key=lambda x: (-x[0], x[1]))[:PER_ROW]:
            for selector in indoc.selectors_for(live, row, k):
                t = totals.setdefault(selector, [0.0, set()])
                t[0] += s
                t[1].add(i)
    out = []
    for selector, (total, seen) in totals.items():
        noisy = f.type != "list" and any(len(matches(live, selector, r)) > 1 for r in rows)
        score = (0.6 * min(1, total / max(1, len(seen)) / 8) + 0.4 * len(seen) / len(rows)) * (0.5 if noisy else 1)
        out.append(Candidate(target, selector, score, f"in {len(seen)} of {len(rows)} rows{', several a row' if noisy else ''}"))
    return sorted(out, key=lambda c: -c.score)[:MAX_CANDIDATES]


def propose_rows(spec: Spec, live: Page, goldens: list[Page]) -> list[Candidate]:
    golden = [(g, k) for g in goldens for k in matches(g, spec.row)] if spec.row else []
    if not golden:
        return []
    page, k = golden[first_modal([indoc.group_signature(g, k) for g, k in golden])]
    tag, classes = page.tag[k], indoc.stable_classes(page, k)
    count = len(golden) / max(1, len(goldens))
    head = lambda p, k: indoc.shape_of(p.norm_text(k)[:60])
    shapes = {head(g, k) for g, k in golden}
    least = max(2, min(count, spec.rows_min if spec.rows_min is not None else 2))
    best: dict[str, Candidate] = {}
    for _, signature, members in indoc.repeated_groups(live, least):
        m = members[0]
        score = 1.5 * (live.tag[m] == tag) + 3 * indoc.jaccard(indoc.stable_classes(live, m), classes) + 2 * max(0, 1 - abs(len(members) - count) / max(1, count))
        score += 2 * sum(head(live, x) in shapes for x in members) / len(members)
        if score <= 1:
            continue
        for s in indoc.selectors_for(live, 0, m):
            hits = len(matches(live, s))
            if hits >= least:
                final = score / 8.5 * max(0.2, 1 - abs(hits - len(members)) / len(members))
                if s not in best or best[s].score < final:
                    # A better score keeps the place where the selector first came up.
                    best[s] = Candidate(ROW, s, final, f"repeating {signature}, {hits} matches (archive: {math.floor(count + 0.5)})")
    return sorted(best.values(), key=lambda c: -c.score)[:MAX_CANDIDATES]


def propose(spec: Spec, live: Page, goldens: list[Page], target: str) -> list[Candidate]:
    return propose_rows(spec, live, goldens) if target == ROW else propose_field(spec, live, goldens, target)


# --- proof -------------------------------------------------------------------------


def union_selector(before: str | None, new: str) -> str:
    if not before:
        return new
    parts = [p.strip() for p in before.split(",") if p.strip()]
    return before if new.strip() in parts else ", ".join([*parts, new.strip()])


def _values(pages: list[Page], spec: Spec, target: str) -> list[tuple]:
    return [r[target] for p in pages for r in indoc.extract(p, spec)]


def _median(xs: list[float]) -> float | None:
    s, n = sorted(xs), len(xs)
    return None if not n else s[n // 2] if n % 2 else (s[n // 2 - 1] + s[n // 2]) / 2


def _plain(page: Page, spec: Spec) -> list[dict]:
    return [{n: indoc.value(r[n], f) for n, f in spec.fields.items()} for r in indoc.extract(page, spec)]


def gate_live(live: Page, patched: Spec, target: str) -> tuple[bool, str]:
    found = violations(live, patched)
    own = [v for v in found if v[0] == "ROW_COUNT"] if target == ROW else [v for v in found if v[1] == target]
    if own:
        return False, f"{len(own)} violation(s) remain"
    if target == ROW:
        total, per = len(indoc.rows_of(live, patched)), {}
        for _, name, row in found:
            if name is not None and row is not None:
                per.setdefault(name, set()).add(row)
        for name, rows in per.items():
            if 0 < len(rows) < total and len(rows) / total < 0.5:
                return False, f"{len(rows)} of {total} rows fail on {name} while the rest pass: those are no records"
    return True, "no violations"


def gate_archive(goldens: list[tuple[str, Page]], spec: Spec, patched: Spec) -> list[tuple[str, bool, str]]:
    out = []
    for source, page in goldens:
        same, clean = _plain(page, spec) == _plain(page, patched), not violations(page, patched)
        out.append((f"archive:{source}", same and clean, "identical rows" if same and clean else "rows differ" if not same else "the contract fails"))
    return out


def capture(page: Page, spec: Spec, name: str) -> tuple[int, int]:
    """(elements that rows use, elements on the page) of a field."""
    f = spec.fields[name]
    hits = [len(matches(page, f.selector, r)) for r in indoc.rows_of(page, spec)]
    return sum(h if f.type == "list" else min(1, h) for h in hits), len(matches(page, f.selector))


def gate_coverage(live: Page, goldens: list[Page], spec: Spec, patched: Spec) -> tuple[bool, str]:
    for name in spec.fields:
        before = [used / total for p in goldens for used, total in [capture(p, spec, name)] if total]
        used, total = capture(live, patched, name)
        if before and total and sum(before) / len(before) - used / total > COVERAGE:
            return False, f"rows reach {used} of {total} {name} element(s)"
    return True, "rows reach as much of the page as before"


def gate_continuity(live: Page, goldens: list[Page], spec: Spec, patched: Spec, target: str) -> tuple[bool, str]:
    if target == ROW or spec.fields[target].type == "list":
        return True, "not applicable"
    old, new = _values(goldens, spec, target), _values([live], patched, target)
    kinds = {indoc.kind_of(c[0]) for c in old if c[0]}
    raw = [c[0] for c in new if c[0]]
    if not kinds:
        return True, "no archived values"
    if not raw:
        return False, "no values"
    if sum(indoc.kind_of(v) in kinds for v in raw) / len(raw) >= 0.5:
        return True, "values read as before"
    if spec.fields[target].type == "number":
        a, b = _median([c[2] for c in old if c[2] is not None]), _median([c[2] for c in new if c[2] is not None])
        if a and b is not None:
            moved = abs(b - a) / abs(a)
            return moved <= MAGNITUDE, f"another format; the median moved {math.floor(100 * moved + 0.5)}% ({a:g} to {b:g})"
    return False, f"values read as {'/'.join(sorted({indoc.kind_of(v) for v in raw}))}, before as {'/'.join(sorted(kinds))}"


def verify(spec: Spec, candidate: Candidate, live: Page, goldens: list[tuple[str, Page]]) -> Verified:
    proposed = union_selector(spec.selector(candidate.target), candidate.selector)
    patched = spec.with_selector(candidate.target, proposed)
    pages = [p for _, p in goldens]
    out = Verified(candidate, proposed)
    out.passes.append(("live", *gate_live(live, patched, candidate.target)))
    out.passes += gate_archive(goldens, spec, patched)
    out.passes.append(("coverage", *gate_coverage(live, pages, spec, patched)))
    out.passes.append(("continuity", *gate_continuity(live, pages, spec, patched, candidate.target)))
    return out


@dataclass
class Repair:
    patched: Spec | None
    fixes: list[Verified]
    rejected: list[Verified]
    unhealed: list[str]
    stale: list[str]


#: A model proposer gets (spec, live page, goldens, target) and returns selectors; an outage is no candidates.
Model = Callable[[Spec, Page, list[Page], str], list[str]]


def repair(spec: Spec, live: Page, archive: list[tuple[str, Page]], model: Model | None = None, limit_rejected: int = 3) -> Repair:
    """Rows first, then each field that is still broken, each on the spec as patched so far."""
    goldens = [(s, p) for s, p in archive if not violations(p, spec)]
    out = Repair(None, [], [], [], [s for s, p in archive if violations(p, spec)])
    work = spec

    def attempt(target: str) -> None:
        nonlocal work
        pages = [p for _, p in goldens]
        tried, seen = propose(work, live, pages, target), set()
        sources = [lambda: tried]
        if model is not None:
            sources.append(lambda: [Candidate(target, s, 0.5, "model", "model") for s in _asked(model, work, live, pages, target) if s not in {c.selector for c in tried}])
        for source in sources:
            refused = 0
            for c in source():
                if c.selector in seen:
                    continue
                seen.add(c.selector)
                v = verify(work, c, live, goldens)
                if v.ok:
                    out.fixes.append(v)
                    work = work.with_selector(target, v.proposed)
                    return
                refused += 1
                if refused <= limit_rejected:
                    out.rejected.append(v)
        out.unhealed.append(target)

    if any(v[0] == "ROW_COUNT" for v in violations(live, work)):
        attempt(ROW)
    for name in dict.fromkeys(v[1] for v in violations(live, work) if v[1]):
        attempt(name)
    out.patched = work if out.fixes else None
    return out


def _asked(model: Model, spec: Spec, live: Page, goldens: list[Page], target: str) -> list[str]:
    try:
        found = model(spec, live, goldens, target)
    except Exception:  # an outage of the model costs its proposals and nothing else
        return []
    return [s for s in found if isinstance(s, str) and _readable(s)][:6]


def _readable(selector: str) -> bool:
    from weftline.sources.selectors import SelectorError, compile_selector

    try:
        compile_selector(selector)
        return True
    except SelectorError:
        return False
