import pytest

from weftline.plans.demo import catalogue
from weftline.sources import indoc
from weftline.sources.html import decode_entities, parse
from weftline.sources.selectors import SelectorError, compile_selector, evaluate, nth


def texts(html, selector):
    p = parse(html)
    return [p.norm_text(k) for k in evaluate(p, selector)]


def test_tolerance():
    assert texts("<ul><li>a<li>b</ul>", "li") == ["a", "b"]
    assert texts("<dl><dt>a<dd>b<dt>c</dl>", "dt, dd") == ["a", "b", "c"]
    assert texts("<table><tr><td>1<td>2<tr><td>3</table>", "tr") == ["12", "3"]
    assert texts("<p><b>x<br><p>y", "p") == ["xy", "y"]  # only the innermost open element is looked at
    assert texts("<script>var a = '<li>';</script ><li>z", "li") == ["z"]
    assert texts("<p>1 < 2</p></div><p>k", "p") == ["1 < 2", "k"]
    assert texts("<!-- <p>no --><!doctype x><?pi?><p>yes", "p") == ["yes"]
    assert texts("<title>t</title><textarea>u</textarea>", "title, textarea") == ["", ""]
    assert parse("").norm_text(0) == "" and len(parse("")) == 1


def test_attributes_and_entities():
    p = parse("<a href=x/y data-b='1>2' c D = \"q&amp;\" c=last><img/>t")
    assert p.attrs[1] == {"href": "x/y", "data-b": "1>2", "c": "last", "d": "q&"}
    assert decode_entities("&amp;&#65;&#x42;&copy;&middot;&nbsp;&Amp;&#0;") == "&AB©&middot;\xa0&&#0;"


def test_selectors():
    html = '<main id=r><div class="card x" data-t=a><h3>1</h3><p>p</p></div><div class=card><h3>2</h3></div><aside class=card><h3>3</h3></aside></main>'
    assert texts(html, ".card > h3") == ["1", "2", "3"]
    assert texts(html, "div + aside h3") == ["3"]
    assert texts(html, "div ~ div h3") == ["2"]
    assert texts(html, "#r .card:not(.x) h3") == ["2", "3"]
    assert texts(html, ".card:nth-child(2n+1) h3, h3") == ["1", "2", "3"]
    assert texts(html, "[data-t^=a] h3") == ["1"] and texts(html, '[data-t^=""] h3') == []
    assert texts(html, "h3:hover::before") == ["1", "2", "3"]
    p = parse(html)
    card = evaluate(p, ".card")[0]
    assert evaluate(p, "main h3", card) == []  # ancestors stop below the root of the query
    assert nth("odd") == (2, 1) and nth("-n+3") == (-1, 3) and nth("x") is None
    for bad in ("", "a,", "[x", "a >> %", "."):
        with pytest.raises(SelectorError):
            compile_selector(bad)


@pytest.mark.parametrize(
    "text,want",
    [("$19", 19), ("$1,299.00", 1299), ("1.299,50 kr", 1299.5), ("49.99 USD", 49.99), ("1,50", 1.5), ("2,500", 2500), ("-12.5%", -12.5), ("Free", None), ("", None), ("5-10", 5), ("1.2.3", 1.2)],
)
def test_numbers(spark, text, want):
    from weftline.functions.scalars import parse_number

    assert indoc.parse_number(text) == want
    assert spark.createDataFrame([(text,)], "t string").select(parse_number("t")).first()[0] == want


def test_kinds_and_shapes_agree(spark):
    from weftline.functions import scalars as S

    cases = ["$19", "19.99 EUR", "4.8", "Talk to sales", "", "  ", "a b", "one two three four five six seven", "12 %", "3 pounds", "Pro plan 2"]
    got = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string").select("i", S.kind_of("t"), S.shape_of("t")).orderBy("i").collect()
    for c, r in zip(cases, got, strict=True):
        assert (r[1], r[2]) == (indoc.kind_of(c), indoc.shape_of(c)), c


SELECTORS = ["div", ".item", ".item > h3", "main .item li", "li + li", "li ~ li", "ul li:first-child", "li:last-child", "div:nth-child(2n)", "[class]", "[class~=item]", "*", "ul > li:not(:first-child)", "h3, li, .item", "main > div:nth-child(-n+2) .cost"]


def test_relational_selectors_agree(spark):
    from weftline.operators.nodes import nodes, select_nodes

    html = [catalogue(4, 1), catalogue(3, 2, pairs=True), "<p><b>x<br><p>y<ul><li>a<li>b"]
    n = nodes(spark.createDataFrame(list(enumerate(html)), "page_id long, html string")).cache()
    for s in SELECTORS:
        want = {(i, k) for i, h in enumerate(html) for k in evaluate(parse(h), s)}
        got = [(r.doc_id, r.node_id) for r in select_nodes(n, s).select("doc_id", "node_id").collect()]
        assert len(got) == len(set(got)) and set(got) == want, s


def test_classes():
    assert indoc.looks_hashed("css-1abc") and indoc.looks_hashed("ab12cdefgh") and indoc.looks_hashed("a-123456")
    assert not indoc.looks_hashed("price") and not indoc.looks_hashed("pricing-card")
    assert indoc.jaccard([], []) == 1 and indoc.jaccard(["a"], ["a", "b"]) == 0.5
    assert indoc.path_similarity([("a", 1)], [("a", 1)]) == 1
