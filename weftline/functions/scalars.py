"""Scalar kernels as Column expressions: nothing here leaves the JVM.

White space is the wide set (no-break space, byte-order mark and the Unicode
separators included), spelled out because Java's own class is narrower.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space set of the page model.
SPACE = "\\t-\\r    -     　﻿"

# Words that mark an amount of money.
CURRENCY_WORDS = "usd|eur|gbp|jpy|cad|aud|chf|cny|inr|dollars?|euros?|pounds?|yen|rupees?|cents?|pence"
CURRENCY_SIGNS = "$€£¥₹"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm_space(c: Column | str) -> Column:
    """Runs of white space as one space, none at the ends."""
    return trim_space(F.regexp_replace(_col(c), f"[{SPACE}]+", " "))


def trim_space(c: Column | str, space: str = SPACE) -> Column:
    return F.regexp_replace(_col(c), rf"^[{space}]+|[{space}]+\z", "")


def parse_number(c: Column | str) -> Column:
    """Prices and counts as people write them: ``$1,299.00`` 1299, ``1.299,50 kr`` 1299.5, ``Free`` null."""
    kept = F.regexp_replace(_col(c), r"[^0-9.,\-]", "")
    comma, dot = F.contains(kept, F.lit(",")), F.contains(kept, F.lit("."))
    no_comma = F.replace(kept, F.lit(","), F.lit(""))
    first_to_dot = F.regexp_replace(kept, "^([^,]*),", "$1.")
    comma_last = F.length(F.regexp_extract(kept, "([^,]*)$", 1)) < F.length(F.regexp_extract(kept, "([^.]*)$", 1))
    plain = (
        F.when(comma & dot & comma_last, F.regexp_replace(F.replace(kept, F.lit("."), F.lit("")), "^([^,]*),", "$1."))
        .when(comma & dot, no_comma)
        .when(comma & kept.rlike(r",[0-9]{3}([^0-9]|$)"), no_comma)
        .when(comma, first_to_dot)
        .otherwise(kept)
    )
    head = F.regexp_extract(plain, r"^(-?(?:[0-9]+\.?[0-9]*|\.[0-9]+))", 1)
    return F.when(head != "", head.try_cast("double"))


def kind_of(c: Column | str, space: str = SPACE, inner: str | None = None) -> Column:
    """Coarse kind of a value: empty, currency, numeric, words-short, words-mid, words-long.

    ``space``: what stands around and between words; ``inner``: of it, what a number may hold.  A currency word ends
    at what is no ASCII letter, digit or underscore (Java's ``\\b`` would go on over accented letters).
    """
    t = trim_space(c, space)
    words = F.size(F.split(t, f"[{space}]+"))
    return (
        F.when(t == "", "empty")
        .when(t.rlike(f"[{CURRENCY_SIGNS}]") | t.rlike(rf"(?i)(?<![a-z0-9_])({CURRENCY_WORDS})(?![a-z0-9_])"), "currency")
        .when(t.rlike(rf"^[0-9.,{inner or space}%+/\-]+\z"), "numeric")
        .when(words <= 2, "words-short")
        .when(words <= 6, "words-mid")
        .otherwise("words-long")
    )


def shape_of(c: Column | str) -> Column:
    """Digits as ``#``, ASCII letters as ``W``, white space as one space; 40 characters at most."""
    s = F.regexp_replace(F.regexp_replace(_col(c), "[0-9]+", "#"), "[A-Za-z]+", "W")
    return F.substring(norm_space(s), 1, 40)


def looks_hashed(c: Column | str) -> Column:
    """A class name that a build tool made."""
    c = _col(c)
    return (
        c.rlike("(?i)^(css|sc|jsx|emotion|styles?)[-_]")
        | ((F.length(c) >= 8) & c.rlike("[0-9]") & c.rlike("[A-Za-z]") & ~F.contains(c, F.lit("-")))
        | c.rlike("(?i)^[a-z]{1,3}-[a-z0-9]{6,}$")
    )


def stable_classes(c: Column | str) -> Column:
    return F.filter(_col(c), lambda x: ~looks_hashed(x))


def jaccard(a: Column | str, b: Column | str) -> Column:
    a, b = _col(a), _col(b)
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def path_similarity(a: Column | str, b: Column | str) -> Column:
    """Of two arrays of (tag, nth) from the row down: agreement weighted towards the leaf, less for unequal lengths."""
    a, b = _col(a), _col(b)
    n, most = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(F.reverse(a), 1, n), F.slice(F.reverse(b), 1, n), lambda x, y: F.when(x["tag"] == y["tag"], F.when(x["nth"] == y["nth"], 1.0).otherwise(0.6)).otherwise(0.0))
    weights = F.transform(F.sequence(F.lit(1), n), lambda i: 1.0 / i)
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda t, x: t + x)
    score = add(F.zip_with(pairs, weights, lambda p, w: p * w)) / add(weights)
    return F.when(n <= 0, F.lit(0.0)).otherwise(score * (0.7 + 0.3 * (1 - F.abs(F.size(a) - F.size(b)) / most)))


def group_signature(tag: Column | str, classes: Column | str) -> Column:
    """What makes siblings alike: the tag, a dot, the stable classes in order."""
    return F.concat(_col(tag), F.lit("."), F.array_join(F.array_sort(stable_classes(classes)), "."))


# Addresses are cut by pattern: a URI parser would reject what browsers accept.
_AUTHORITY = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://"


def url_host(c: Column | str) -> Column:
    """Lower-cased host without ``www.``; null where there is none."""
    host = F.lower(F.nullif(F.regexp_extract(_col(c), _AUTHORITY + r"(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))
    return F.regexp_replace(host, r"^www\.", "")


def url_path(c: Column | str) -> Column:
    path = F.regexp_extract(_col(c), _AUTHORITY + r"[^/?#]*([^?#]*)", 1)
    path = F.when(path == "", "/").otherwise(path)
    return F.when((F.length(path) > 1) & path.endswith("/"), F.substring(path, F.lit(1), F.length(path) - 1)).otherwise(path)


def same_target(a: Column | str, b: Column | str) -> Column:
    """Same host (without ``www.``) and path (without a last slash); other strings by equality."""
    a, b = _col(a), _col(b)
    known = url_host(a).isNotNull() & url_host(b).isNotNull()
    return F.when(known, (url_host(a) == url_host(b)) & (url_path(a) == url_path(b))).otherwise(a == b)


def round_half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def number_text(c: Column | str) -> Column:
    """A double as the sinks print it: whole numbers without a point."""
    c = _col(c)
    return F.when((c == F.floor(c)) & (F.abs(c) < 1e15), c.cast("decimal(18,0)").cast("string")).otherwise(c.cast("string"))


def csv_cell(c: Column | str) -> Column:
    s = F.coalesce(_col(c), F.lit(""))
    return F.when(s.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def fixture_date(c: Column | str) -> Column:
    return F.regexp_extract(_col(c), r"^(\d{4}-\d{2}-\d{2})", 1).try_cast("date")


def age_in_days(source: Column | str, now: Column) -> Column:
    """Whole days between the date that begins a fixture's name and ``now``; null without a date."""
    return F.floor((F.unix_timestamp(now) - F.unix_timestamp(fixture_date(source).cast("timestamp"))) / 86400)


# A rule of robots.txt as a regular expression: * is any run, a last $ the end.
def rule_matches(rule: Column, path: Column) -> Column:
    anchored = rule.endswith("$")
    body = F.when(anchored, F.substring(rule, F.lit(1), F.length(rule) - 1)).otherwise(rule)
    quoted = F.regexp_replace(body, r"([.+?^${}()|\[\]\\])", r"\\$1")
    pattern = F.concat(F.lit("^"), F.replace(quoted, F.lit("*"), F.lit(".*")), F.when(anchored, "$").otherwise(""))
    return F.regexp_like(path, pattern)


def path_allowed(path: Column, allow: Column, disallow: Column) -> Column:
    """The longest matching rule decides; allow wins at equal length."""
    longest = lambda rules: F.coalesce(F.array_max(F.transform(F.filter(rules, lambda r: rule_matches(r, path)), lambda r: F.length(r))), F.lit(-1))
    no = longest(disallow)
    return (no == -1) | (longest(allow) >= no)
