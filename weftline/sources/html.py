"""Tolerant HTML to columns: a page is a set of arrays in document order.

Node 0 is the document.  A node's descendants are the ids after it up to
``end``; ``sib`` counts element siblings from 0.  Text lives in ``runs``: (owner,
text) in document order, so a node's text is the runs of an id range.

The rules of tolerance: an opening tag ends open elements only while the
innermost one is in its table; a closing tag ends the nearest of its name;
comments and declarations vanish; script, style, textarea and title hold raw
text that counts as no text; ``<`` before anything else is a character.
"""

from __future__ import annotations

import re

from weftline.functions.scalars import SPACE

# Fixed values of the page model.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
P_ENDS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ENDS = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "option": {"option"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    **dict.fromkeys(("thead", "tbody", "tfoot"), {"thead", "tbody", "tfoot", "tr", "td", "th"}),
}
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ",
    "copy": "©", "reg": "®", "hellip": "…", "mdash": "—", "ndash": "–", "rsquo": "’",
    "lsquo": "‘", "ldquo": "“", "rdquo": "”", "eur": "€", "pound": "£", "yen": "¥",
}

_ENTITY = re.compile(r"&(?:#([xX][0-9a-fA-F]+|[0-9][0-9a-fA-F]*)|([a-zA-Z]+));")
_MARK = re.compile(r"<(?:!--|[!?]|/|[a-zA-Z])")
_NAME = re.compile(r"[a-zA-Z0-9:\-]*")
_ATTR = re.compile(rf"[{SPACE}]*(?:(/?>)|(/)|([^=>/{SPACE}]+)(?:[{SPACE}]*(=)[{SPACE}]*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^>{SPACE}]*)))?|(=))")
_SPACES = re.compile(rf"[{SPACE}]+")
_RAW_END = {t: re.compile(rf"</{t}[{SPACE}]*>", re.I) for t in RAW}


def decode_entities(s: str) -> str:
    if "&" not in s:
        return s

    def one(m: re.Match) -> str:
        if m[1]:
            try:
                code = int(m[1][1:], 16) if m[1][0] in "xX" else int(re.match(r"[0-9]+", m[1])[0])
                return chr(code) if code > 0 else m[0]
            except (ValueError, OverflowError):
                return m[0]
        return ENTITIES.get(m[2].lower(), m[0])

    return _ENTITY.sub(one, s)


def norm(s: str) -> str:
    return _SPACES.sub(" ", s).strip(" ")


class Page:
    __slots__ = ("tag", "parent", "end", "depth", "sib", "kids", "attrs", "owner", "runs", "_text", "_norm", "_classes")

    def __init__(self):
        self.tag, self.parent, self.end, self.depth, self.sib, self.kids = ["#document"], [-1], [0], [0], [0], [0]
        self.attrs: list[dict[str, str]] = [{}]
        self.owner: list[int] = []  # per text run: the id of the last element opened before it
        self.runs: list[str] = []
        self._text: dict[int, str] = {}
        self._norm: dict[int, str] = {}
        self._classes: dict[int, list[str]] = {}

    def __len__(self) -> int:
        return len(self.tag)

    def open(self, tag: str, attrs: dict[str, str], parent: int) -> int:
        k = len(self.tag)
        self.tag.append(tag)
        self.attrs.append(attrs)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.sib.append(self.kids[parent])
        self.kids.append(0)
        self.kids[parent] += 1
        self.end.append(k)
        return k

    def text(self, k: int) -> str:
        """All text below ``k``, nothing put between."""
        got = self._text.get(k)
        if got is None:
            if self.tag[k] in RAW:
                got = ""
            else:
                # Runs are in document order; each knows its element, and elements below k are the ids k..end.
                a, b = self.span(k)
                got = "".join(self.runs[a:b])
            self._text[k] = got
        return got

    def span(self, k: int) -> tuple[int, int]:
        return self.first[k], self.last[k]  # type: ignore[attr-defined]

    def norm_text(self, k: int) -> str:
        got = self._norm.get(k)
        if got is None:
            got = self._norm[k] = norm(self.text(k))
        return got

    def classes(self, k: int) -> list[str]:
        got = self._classes.get(k)
        if got is None:
            got = self._classes[k] = [x for x in _SPACES.split(self.attrs[k].get("class", "")) if x]
        return got

    def children(self, k: int) -> list[int]:
        out, x = [], k + 1
        while x <= self.end[k]:
            out.append(x)
            x = self.end[x] + 1
        return out

    def path(self, root: int, k: int) -> list[tuple[str, int]]:
        """(tag, place among siblings) from below ``root`` down to ``k``."""
        out = []
        while k > 0 and k != root:
            out.append((self.tag[k], self.sib[k] + 1))
            k = self.parent[k]
        return out[::-1]


class TextPage(Page):
    """A page whose text runs are found by the run counts at each element's start and end."""

    __slots__ = ("first", "last")

    def __init__(self):
        super().__init__()
        self.first, self.last = [0], [0]


def parse(html: str) -> TextPage:
    page = TextPage()
    stack, at, n = [0], 0, len(html)
    tags, runs, first, last, end = page.tag, page.runs, page.first, page.last, page.end

    def say(s: str) -> None:
        if s:
            runs.append(decode_entities(s))

    def shut(size: int) -> None:
        k = len(tags) - 1
        for x in stack[size:]:
            end[x], last[x] = k, len(runs)
        del stack[size:]

    pending = 0  # where unread text starts
    while True:
        m = _MARK.search(html, at)
        if m is None:
            # A lone "<" is text of its own, but joins its neighbours all the same.
            say(html[pending:])
            break
        i = m.start()
        say(html[pending:i])
        mark = m[0]
        if mark == "<!--":
            j = html.find("-->", i + 4)
            at = n if j < 0 else j + 3
        elif mark in ("<!", "<?"):
            j = html.find(">", i)
            at = n if j < 0 else j + 1
        elif mark == "</":
            name = _NAME.match(html, i + 2)
            j = html.find(">", name.end())
            at = n if j < 0 else j + 1
            name = name[0].lower()
            for k in range(len(stack) - 1, 0, -1):
                if tags[stack[k]] == name:
                    shut(k)
                    break
        else:
            name = _NAME.match(html, i + 1)
            tag, at = name[0].lower(), name.end()
            attrs: dict[str, str] = {}
            closed = False
            while at < n:
                a = _ATTR.match(html, at)
                if a is None:
                    at = n
                    break
                at = a.end()
                if a[1]:
                    closed = a[1] == "/>"
                    break
                if a[3]:
                    value = a[5] if a[5] is not None else a[6] if a[6] is not None else a[7]
                    attrs[a[3].lower()] = decode_entities(value or "") if a[4] else ""
            enders = ENDS.get(tag)
            while len(stack) > 1:
                top = tags[stack[-1]]
                if top in enders if enders is not None else top == "p" and tag in P_ENDS:
                    shut(len(stack) - 1)
                else:
                    break
            k = page.open(tag, attrs, stack[-1])
            first.append(len(runs))
            last.append(len(runs))
            if tag in VOID or closed:
                pass
            elif tag in RAW:
                close = _RAW_END[tag].search(html, at)
                at = close.end() if close else n
            else:
                stack.append(k)
        pending = at
    shut(0)
    return page


_ESCAPED = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;"})


def escape(s: str) -> str:
    return s.translate(_ESCAPED)


def _noise(attr: str) -> bool:
    return attr in ("style", "srcset", "sizes") or attr.startswith("on")


def serialise(page: Page, k: int = 0, max_depth: int = 6, max_text: int = 200, drop=_noise) -> str:
    """An element as markup, for reading: no raw text, no noise, white space as one space, long runs and deep parts cut."""

    def words(run: str) -> str:
        t = _SPACES.sub(" ", run)
        return "" if not t.strip() else escape(t[:max_text] + "\u2026" if len(t) > max_text else t)

    def inside(k: int, depth: int) -> str:
        # Between two children stand the runs from the end of the one to the start of the other.
        out, at = [], page.first[k]
        for child in page.children(k):
            out += map(words, page.runs[at : page.first[child]])
            out.append(element(child, depth))
            at = page.last[child]
        return "".join([*out, *map(words, page.runs[at : page.last[k]])])

    def element(k: int, depth: int) -> str:
        tag = page.tag[k]
        if tag in RAW:
            return ""
        attrs = "".join(f" {a}" if v == "" else f' {a}="{escape(v)}"' for a, v in page.attrs[k].items() if not drop(a))
        if tag in VOID:
            return f"<{tag}{attrs}>"
        inner = escape(page.norm_text(k)[:max_text]) if depth >= max_depth else inside(k, depth + 1)
        return f"<{tag}{attrs}>{inner}</{tag}>"

    return inside(0, 0) if k == 0 else element(k, 0)
