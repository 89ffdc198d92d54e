"""HTML extraction (1): maximum-scoring subsequence.

A page is a sequence of tags and words.  Every tag scores below zero and every
word scores by the elements it stands in; the weights are log odds learned from
labelled pages (``labelled_pages`` generates them: several layouts, with menus,
notices, adverts, forms, sidebars, comments).  One linear scan finds the
contiguous region with the largest sum.  The region is then widened to the
element that holds it, and elements whose own weight says that they are no part of an
article are left out.

Edge cases: null or empty html, and pages without a word of positive score, give the empty
text; cut-off pages are read to where they end; unclosed elements end with
their parent; character references are decoded as browsers do; a page takes time in proportion
to its length, however deep its elements are nested; repeated rows give equal rows; an empty table
gives an empty one; a column that bears the name of the result is replaced.
"""

from __future__ import annotations

import html as htmllib
import random
import re
from collections import Counter
from functools import lru_cache
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from weftline.llm.common import arrow_map, column, table

TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup; what it holds is never shown as text of a page.
OPAQUE = frozenset("script style title textarea iframe noframes noembed".split())
#: Their content is markup that is not shown, or is part of a form.
UNSHOWN = frozenset("noscript template select datalist annotation annotation-xml".split())
#: Elements that stay inside a line of text; all others begin and end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr svg math object canvas audio video mi mn mo ms mrow msup msub mfrac msqrt mtext text tspan".split())
#: What an opening tag closes, if it stands open above the nearest limit.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"),
    "body": ("head",),
}
LIMITS = frozenset("ul ol dl table body html article section div main nav aside".split())
#: Elements that a slash in their tag ends.
FOREIGN = frozenset("svg math path circle rect line polygon polyline ellipse use g mspace".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

#: Parts of a text, never the holder of one.
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre blockquote figure figcaption".split())

WORD_LIMIT = 4.0
TRAINING_PAGES = 400


class Element:
    __slots__ = ("tag", "parent", "features", "hidden", "weight", "cut", "depth", "order", "held", "inside")

    def __init__(self, tag: str, parent: Element | None, features: tuple[str, ...], hidden: bool, order: int = 0):
        self.tag, self.parent, self.features, self.hidden, self.order = tag, parent, features, hidden or tag in UNSHOWN, order
        self.depth = parent.depth + 1 if parent else 0
        self.weight, self.cut, self.held, self.inside = 0.0, False, False, False


def features_of(tag: str, attrs: str) -> tuple[tuple[str, ...], bool]:
    """Features of one element (tag, words of class, id and role) and whether it is not shown."""
    found, hidden = [f"tag:{tag}"], False
    if attrs and not attrs.isspace():
        for name, a, b, c in ATTRIBUTE.findall(attrs):
            name, value = name.lower(), a or b or c
            if name in ("class", "id", "role", "aria-label", "itemprop", "data-component"):
                found += {f"name:{w.lower()}" for w in NAME_PART.findall(value)}
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                hidden = True
    return tuple(found), hidden


class Open:
    """Elements that stand open, counted by tag, so that a tag which closes nothing need not look for what it closes."""

    def __init__(self):
        self.top = self.root = Element("#page", None, (), False)
        self.all: Counter = Counter()
        #: Counts since the innermost element of ``LIMITS`` and in those around it.
        self.scopes: list[Counter] = [Counter()]

    def push(self, e: Element) -> None:
        if e.tag in LIMITS:
            self.scopes.append(Counter())
        else:
            self.scopes[-1][e.tag] += 1
        self.all[e.tag] += 1
        self.top = e

    def pop_to(self, tags: tuple[str, ...]) -> Element:
        """Closes all up to and with the innermost element of ``tags``; one is open."""
        while True:
            e = self.top
            if e.tag in LIMITS:
                self.scopes.pop()
            else:
                self.scopes[-1][e.tag] -= 1
            self.all[e.tag] -= 1
            self.top = e.parent
            if e.tag in tags:
                return e


def read_page(page: str) -> list[tuple]:
    """A page in its order: ("open" | "close", element) for tags, ("text", element, characters) for runs of text."""
    open_, out, at, end = Open(), [], 0, len(page)

    def say(raw: str) -> None:
        if raw:
            out.append(("text", open_.top, raw))

    def element(tag: str, features: tuple[str, ...], hidden: bool) -> Element:
        e = Element(tag, open_.top, features, hidden, len(out) + 1)
        out.append(("open", e))
        return e

    while at < end:
        m = TAG.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if at == m.start():
            at += 1
        tag = m[2] or m[5]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                say(m[0][9:].removesuffix("]]>"))
            continue
        tag, closing, attrs = tag.lower(), m[1] or m[4], m[3] if m[2] else m[6]
        if closing:
            if open_.all[tag]:
                out.append(("close", open_.pop_to((tag,))))
            elif tag in ("p", "br"):
                out.append(("open", open_.top))
            continue
        if tag in OPAQUE:
            if not attrs.rstrip().endswith("/") or tag != "iframe":
                close = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                at = close.end() if close else end
            element(tag, (f"tag:{tag}",), True)
            continue
        if tag in VOID:
            element(tag, (f"tag:{tag}",), False)
            continue
        shut = CLOSES.get(tag, ("p",) if tag in CLOSES_P else ())
        if any(open_.scopes[-1][x] for x in shut):
            out.append(("close", open_.pop_to(shut)))
        e = element(tag, *features_of(tag, attrs))
        if not attrs.rstrip().endswith("/") or tag not in FOREIGN:
            open_.push(e)
    return out


class Weights:
    """Log odds of standing in an article, by feature; learned from labelled pages."""

    def __init__(self, pages: list[tuple[str, str]]):
        inside, outside = Counter(), Counter()
        tags_in, tags_out = Counter(), Counter()
        for page, mark in pages:
            for kind, e, *raw in read_page(page):
                if kind == "open":
                    continue
                if kind == "text" and raw[0].strip():
                    words = raw[0].split()
                    into = inside if words[0].startswith(mark) else outside
                    tags = tags_in if words[0].startswith(mark) else tags_out
                    seen, x = set(), e
                    while x.parent:
                        seen.update(x.features)
                        tags[x.tag] += 1
                        x = x.parent
                    into.update(seen)
                    into["all"] += 1
        n_in, n_out = inside["all"], outside["all"]
        self.of = {f: log((inside[f] + 0.5) / (n_in + 1)) - log((outside[f] + 0.5) / (n_out + 1)) for f in (inside | outside) if f != "all"}
        #: A tag costs more, the likelier it is outside an article; never less than a third of a word.
        self.tag_cost = {t: min(4.0, max(0.3, log((tags_out[t] + 1) / (n_out + 1)) - log((tags_in[t] + 1) / (n_in + 1)) + 0.7)) for t in (tags_in | tags_out)}

    def weigh(self, e: Element) -> None:
        """An element's own weight, whether it is cut, and what its words score."""
        own = [self.of.get(f, 0.0) for f in e.features]
        # A link or an edit inside a line is no part of its own: only its names can cut it.
        judged = own[1:] if e.tag in INLINE else own
        e.cut = e.hidden or min(judged, default=0) < -2.5 and not any(w > 2 for w in own[1:])
        if e.tag == "header" and e.parent.held and not any(w < -2.5 for f, w in zip(e.features[1:], own[1:]) if f != "name:header"):
            e.cut = e.hidden  # the heading of an article or of what holds one
        if e.parent:
            e.cut |= e.parent.cut
            e.weight = max(-WORD_LIMIT, min(WORD_LIMIT, e.parent.weight + sum(own)))
            e.held = e.parent.held
        if e.cut:
            e.weight = -WORD_LIMIT
        e.held |= self.holds(e)

    def holds(self, e: Element) -> bool:
        """Whether ``e`` holds an article, by its tag or by a name."""
        return e.tag in ("article", "main") or any(self.of.get(f, 0.0) > 1 for f in e.features[1:])


def best_region(scores: list[float]) -> tuple[int, int] | None:
    """First and last index of the contiguous run with the largest positive sum; the earliest on ties."""
    best, at, total, start = 0.0, None, 0.0, 0
    for k, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += s
        if total > best:
            best, at = total, (start, k)
    return at


#: What a word scores where no weight speaks for or against.
WORD_BASE = 0.6


def main_text(page: str | None, weights: Weights | None = None) -> str:
    """The article's text: blocks in page order, joined by one space."""
    if not page:
        return ""
    weights = weights or trained()
    items = read_page(page)
    scores = []
    for kind, e, *raw in items:
        if kind == "text":
            n = len(raw[0].split())
            scores.append(n * (WORD_BASE + e.weight) if e.weight > -WORD_LIMIT else -n * WORD_LIMIT)
        else:
            if kind == "open" and e.parent:
                weights.weigh(e)
            scores.append(-weights.tag_cost.get(e.tag, 1.0))
    region = best_region(scores)
    if region is None:
        return ""
    first, last = region
    # Widen to the lowest element that holds all text of the region, if that is an element of the page's body.
    said = [e for kind, e, *raw in items[first : last + 1] if kind == "text" and raw[0].strip() and not e.cut]
    if not said:
        return ""
    hold = common(min(said, key=lambda e: e.order), max(said, key=lambda e: e.order))
    while hold.tag in INLINE or hold.tag in TEXT_BLOCKS:
        hold = hold.parent
    around = []
    while hold.parent:
        around.append(hold)
        hold = hold.parent
    around = [x for x in around if not x.cut]
    named = [x for x in around if x.tag not in ("body", "html") and weights.holds(x)]
    hold = next((x for x in around if x.tag == "article"), (named or around or [hold])[0])
    hold.inside = True
    for kind, e, *_ in items:
        if kind == "open" and e.parent:
            e.inside |= e.parent.inside
    if hold.tag in ("body", "html", "#page"):
        # Whole blocks: a link at the end of a line scores low, but belongs to the line.
        first, last = block_end(items, first, -1), block_end(items, last, 1)
        span = range(first, last + 1)
    else:
        span = range(len(items))
    out: list[str] = []
    for k in span:
        kind, e, *raw = items[k]
        if kind != "text":
            if e.tag not in INLINE:
                out.append(" ")
        elif not e.cut:
            out.append(htmllib.unescape(raw[0]) if e.inside else " ")
    return " ".join("".join(out).split())


def block_end(items: list[tuple], at: int, step: int) -> int:
    """The last index from ``at`` on, in direction ``step``, that lies in the same block of text."""
    while 0 <= at + step < len(items) and (items[at + step][0] == "text" or items[at + step][1].tag in INLINE) and (items[at][0] == "text" or items[at][1].tag in INLINE):
        at += step
    return at


def common(a: Element, b: Element) -> Element:
    """The lowest element that holds both; of the first and the last of a set in page order, so all between them too."""
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
    return a


#: Layout vocabulary of the labelled pages: (tag, attributes) of the parts that belong to no article.
OUTSIDE = {
    "menu": [("nav", ""), ("ul", 'class="menu"'), ("div", 'id="nav"'), ("div", 'class="navbar"'), ("div", 'class="breadcrumbs breadcrumb"'), ("div", 'role="navigation"'), ("menu", ""), ("div", 'class="navigation toc"')],
    "header": [("header", ""), ("div", 'id="header"'), ("div", 'class="masthead"'), ("div", 'role="banner"'), ("div", 'class="topbar logo"')],
    "footer": [("footer", ""), ("div", 'id="footer"'), ("div", 'class="copyright"'), ("div", 'role="contentinfo"'), ("div", 'class="legal"')],
    "sidebar": [("aside", ""), ("div", 'id="sidebar"'), ("div", 'class="related"'), ("div", 'class="widget"'), ("div", 'role="complementary"'), ("section", 'class="recommended recommendations"'), ("div", 'class="trending popular"'), ("div", 'class="author bio"')],
    "notice": [("div", 'class="cookie"'), ("div", 'class="notice"'), ("div", 'class="consent gdpr"'), ("div", 'role="alert"'), ("dialog", ""), ("div", 'class="popup modal"'), ("div", 'class="alert warning"'), ("div", 'class="overlay cookies"'), ("div", 'role="dialog"'), ("div", 'class="paywall"')],
    "advert": [("div", 'class="ad"'), ("div", 'class="ads"'), ("div", 'class="advert"'), ("div", 'class="sponsored sponsor"'), ("div", 'class="promo"'), ("div", 'id="banner"'), ("div", 'class="advertisement"'), ("ins", 'class="adsbygoogle"')],
    "form": [("form", ""), ("div", 'class="newsletter"'), ("div", 'class="subscribe subscription"'), ("div", 'class="login"'), ("div", 'class="search"'), ("fieldset", ""), ("div", 'role="search"'), ("div", 'class="signup"'), ("button", ""), ("div", 'class="poll"')],
    "comments": [("section", 'class="comments"'), ("div", 'id="comments"'), ("div", 'class="comment"'), ("div", 'class="disqus"'), ("ol", 'class="commentlist"'), ("div", 'class="replies reply"'), ("div", 'class="discussion responses"')],
    "share": [("div", 'class="share"'), ("div", 'class="social"'), ("ul", 'class="tags"'), ("div", 'class="pagination pager"'), ("div", 'class="sharing toolbar"')],
}
HOLDERS = [("article", ""), ("article", 'class="post"'), ("main", ""), ("div", 'class="content"'), ("div", 'id="content"'), ("div", 'class="article body"'), ("div", 'class="entry"'), ("section", 'class="story text"'), ("div", 'itemprop="articleBody"'), ("div", ""), ("div", 'role="main"')]


def labelled_pages(n: int, seed: int = 1) -> list[tuple[str, str]]:
    """Pages in which every word of the article begins with the mark that stands beside the page."""
    rnd, pages = random.Random(seed), []
    say = lambda mark, k: " ".join(f"{mark}{rnd.randrange(1000)}" for _ in range(k))

    def part(kind: str) -> str:
        tag, attrs = rnd.choice(OUTSIDE[kind])
        links = "".join(f'<li><a href="/x">{say("o", rnd.randint(1, 3))}</a></li>' for _ in range(rnd.randint(2, 7)))
        para = "".join(f"<p>{say('o', rnd.randint(3, 25))}</p>" for _ in range(rnd.randint(1, 3)))
        inner = {"menu": f"<ul>{links}</ul>", "share": links, "footer": rnd.choice([say("o", 8), para, f"<ul>{links}</ul>"]), "comments": para, "form": f'<label>{say("o", 3)}</label><input name="q"><button>{say("o", 1)}</button>'}.get(kind) or rnd.choice([para, say("o", 12), f"<ul>{links}</ul>"])
        return f"<{tag} {attrs}>{inner}</{tag}>"

    for _ in range(n):
        blocks = [f"<h1>{say('w', rnd.randint(2, 9))}</h1>"]
        for _ in range(rnd.randint(2, 12)):
            words = say("w", rnd.randint(5, 60))
            blocks.append(rnd.choice([f"<p>{words}</p>"] * 6 + [f"<h2>{say('w', 4)}</h2>", f"<h3>{say('w', 3)}</h3>", f"<ul><li>{words}</li><li>{say('w', 6)}</li></ul>", f"<ol><li>{words}</li><li>{say('w', 6)}</li></ol>", f"<dl><dt>{say('w', 2)}</dt><dd>{words}</dd></dl>", f"<blockquote><p>{words}</p></blockquote>", f"<p>{words} <a href='/y'>{say('w', 2)}</a> {say('w', 5)}</p>", f"<pre>{words}</pre>", f"<table><tr><td>{say('w', 3)}</td><td>{say('w', 3)}</td></tr></table>", f"<figure><img src='i'><figcaption>{say('w', 6)}</figcaption></figure>"]))
            if rnd.random() < 0.12:
                blocks.append(part(rnd.choice(["advert", "share", "form", "sidebar"])))
        tag, attrs = rnd.choice(HOLDERS)
        before = [part(k) for k in ("header", "menu", "notice", "advert", "form", "sidebar") if rnd.random() < 0.6]
        after = [part(k) for k in ("share", "comments", "sidebar", "form", "footer", "notice") if rnd.random() < 0.6]
        pages.append((f"<html><body>{''.join(before)}<{tag} {attrs}>{''.join(blocks)}</{tag}>{''.join(after)}</body></html>", "w"))
    return pages


@lru_cache(maxsize=1)
def trained() -> Weights:
    return Weights(labelled_pages(TRAINING_PAGES))


def extract_main_text(df: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """``df`` with the article's text of column ``html`` in column ``out``."""
    kept = [f for f in df.schema if f.name != out]
    schema = T.StructType([*kept, T.StructField(out, T.StringType(), False)])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x) for x in column(batch, html).to_pylist()]
        return pa.RecordBatch.from_arrays([*(column(batch, f.name) for f in kept), pa.array(texts, pa.string())], names=[f.name for f in schema])

    return arrow_map(df, run, schema)


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


#: For pages whose one article stands between its tags and holds no element that is cut, as the test tables' do.
OP1_SQL = r"""
WITH a AS (
  SELECT page_id, url, coalesce(regexp_extract(html, '<article>(.*?)</article>', 1, 's'), '') AS t FROM pages
), plain AS (
  SELECT page_id, url, regexp_replace(regexp_replace(t, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS t FROM a
), decoded AS (
  SELECT page_id, url, replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS t FROM plain
), tidy AS (SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM decoded)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM tidy
"""
