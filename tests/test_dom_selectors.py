import xml.etree.ElementTree as ET

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arborweb.errors import AssumptionError, ConfigError
from arborweb.operators import contracts, links
from arborweb.plans.grammar import Selector, guess_grammar
from arborweb.plans.treequery import needed_tags, query, query_strings, scalar
from arborweb.sources import dom

PAGE = """<html><body><div id='main'><h1>Title</h1><table class='t'><tr class='row'><td>a</td><td>b <i>x</i> c</td></tr>
<tr class='row last'><td>c</td><td>d</td></tr></table><a class='nav-link' href='/1'>one</a><a class='nav-link x' href='http://h/2'> two </a><p>p1</p><p>p2</p></div></body></html>"""


@pytest.fixture(scope="module")
def nodes(spark):
    return dom.shred(dom.from_strings(spark, [("http://x/a/", PAGE), ("http://y/", "<p>only")]), content=None, inner={"td", "div"}).cache()


def found(nodes, selector, page=0, column="content"):
    return [r[column] for r in query(nodes, selector).filter(F.col("page_id") == page).orderBy("pos").collect()]


XPATHS = {
    "//tr[@class='row']": ["ab x c"],
    "//td": ["a", "b x c", "c", "d"],
    "//tr/td[2]": ["b x c", "d"],
    "(//td)[3]": ["c"],
    "(//a[@class='nav-link'])[1]": ["one"],
    "//a[@href]": ["one", " two "],
    "//a[not(@class='nav-link')]": [" two "],
    "//a[contains(@href, '/2')]": [" two "],
    "//a[starts-with(@href, '/')]": ["one"],
    "//p[last()]": ["p2"],
    "//p[position() < 2] | //h1": ["Title", "p1"],
    "//tr[.//i]/td[1]": ["a"],
    "//i/ancestor::tr": ["ab x c"],
    "//td[count(preceding::td) = 3]": ["d"],
    "//*[@id='main']/h1": ["Title"],
    "//h1/following-sibling::p": ["p1", "p2"],
    "//i/..": ["b x c"],
    "//td[text()='c']": ["c"],
    "//tr[td='d' and @class!='row']": ["cd"],
    "/html/body/div/h1": ["Title"],
    ".//h1": ["Title"],
    "//td/text()": [],
    "count(//td)": [],
}
CSS = {
    ".nav-link": ["one", " two "],
    "a.nav-link.x": [" two "],
    "#main > h1": ["Title"],
    "div#main h1": ["Title"],
    "a[href='/1'], p": ["one", "p1", "p2"],
    "a[href^='http'][class~=x]": [" two "],
    "h1 + table td:first-child": ["a", "c"],
    "a + a": [" two "],
    "p:not(:last-child)": ["p1"],
    ":nth-match(td, 2)": ["b x c"],
}


@pytest.mark.parametrize("text", XPATHS)
def test_xpath(nodes, text):
    assert found(nodes, Selector.xpath(text)) == XPATHS[text]


@pytest.mark.parametrize("text", CSS)
def test_css(nodes, text):
    assert found(nodes, Selector.css(text)) == CSS[text]


@pytest.mark.parametrize("bad", ["//p[", "//p]", "//p[foo()]", "", "//"])
def test_a_bad_xpath_is_a_fault_of_the_scraper(nodes, bad):
    with pytest.raises(ConfigError):
        query(nodes, Selector.xpath(bad))


@pytest.mark.parametrize("bad", ["p:::bad", "[", "> p", ""])
def test_a_bad_css_is_a_fault_of_the_scraper(nodes, bad):
    with pytest.raises(ConfigError):
        query(nodes, Selector.css(bad))


def test_strings_and_scalars(nodes):
    def strings(x):
        return [r["value"] for r in query_strings(nodes, Selector.xpath(x)).filter("page_id = 0").orderBy("pos").collect()]

    assert strings("//td/text()") == ["a", "b ", " c", "c", "d"]
    assert strings("//a/@href") == ["/1", "http://h/2"]
    assert strings("string(count(//td))") == ["4"]
    assert strings("count(//td)") == [] and strings("//td") == []
    values = {x: scalar(nodes, Selector.xpath(x)).filter("page_id = 0").first()["value"] for x in ("count(//td)", "boolean(//video)", "normalize-space(//a[2])", "concat(//h1, '!')")}
    assert values == {"count(//td)": "4", "boolean(//video)": "false", "normalize-space(//a[2])": "two", "concat(//h1, '!')": "Title!"}


def test_nested_queries_run_from_each_result(nodes):
    rows = query(nodes, Selector.xpath("//tr"))
    cells = query(nodes, Selector.xpath(".//td"), rows).orderBy("ctx", "pos").collect()
    assert [(c["pos"], c["content"]) for c in cells] == [(1, "a"), (2, "b x c"), (1, "c"), (2, "d")]
    assert [c["content"] for c in query(nodes, Selector.xpath("//h1"), rows).collect()] == ["Title"]


def test_inner_html(nodes):
    assert found(nodes, Selector.xpath("//td"), column="inner")[1] == "b <i>x</i> c"


def test_nth_and_grammar():
    assert Selector.xpath("//a").nth(2).value == "(//a)[2]"
    assert Selector.css("a").nth(2).value == ":nth-match(a, 2)"
    assert [guess_grammar(s) for s in ("//a", "./a", "(//a)[1]", "a.b")] == ["xpath", "xpath", "xpath", "css"]
    with pytest.raises(ValueError):
        Selector.of("a", "regex")


def test_what_a_selector_needs():
    assert needed_tags(Selector.xpath("//a[@href]")) == {"a"}
    assert needed_tags(Selector.xpath("//a | //p")) == {"a", "p"}
    assert needed_tags(Selector.xpath("//tr/td")) is None
    assert needed_tags(Selector.xpath("//tr[td]")) is None


def test_a_root_selector_has_no_join(spark, nodes):
    plan = nodes.sparkSession._jvm.PythonSQLUtils.explainString(query(nodes, Selector.xpath("//a[@href]"))._jdf.queryExecution(), "simple")
    assert "Join" not in plan


def test_contracts(spark, nodes):
    pages = dom.from_strings(spark, [("http://x/a/", PAGE), ("http://y/", "<p>only")]).select("page_id", "url")
    s = Selector.xpath("//td")
    rows = contracts.violations(pages, query(nodes, s), s, "cells", 1, 3).orderBy("page_id").collect()
    assert [(r["page_id"], r["actual_count"]) for r in rows] == [(0, 4), (1, 0)]
    assert rows[0]["message"] == "HTML structure mismatch for 'cells': expected between 1 and 3, found 4"
    assert contracts.violations(pages, query(nodes, s), s, "cells", 0).count() == 0
    with pytest.raises(Exception, match="StructureError"):
        contracts.strict(pages, query(nodes, s), s, "cells", 4, 4).collect()
    with pytest.raises(ValueError):
        contracts.check_bounds(2, 1)


def test_links(spark):
    pages = spark.createDataFrame([(1, "http://h/d/p", "<a href='x?y=1'> A </a><a>no</a><a href='/r#f'>B</a>")], "page_id LONG, url STRING, html STRING")
    got = links.find_links(pages, Selector.xpath("//a")).orderBy("pos").collect()
    assert [(r["pos"], r["url"], r["text"], r["selector"]) for r in got] == [(1, "http://h/d/x?y=1", "A", "(//a)[1]"), (2, None, "no", "(//a)[2]"), (3, "http://h/r#f", "B", "(//a)[3]")]
    wrong = links.link_violations(pages, links.find_links(pages, Selector.xpath("//a")), Selector.xpath("//a"), "all").collect()
    assert [(r["description"], r["actual_count"]) for r in wrong] == [("all missing href", 1)]
    r = links.follow(links.find_links(pages, Selector.xpath("//a")), "next").orderBy("url").collect()
    assert [x["url"] for x in r] == ["http://h/d/x?y=1", "http://h/r#f"]
    with pytest.raises(ValueError):
        links.follow(links.find_links(pages, Selector.xpath("//a")), "")


def test_parsing_of_broken_documents():
    t = dom.parse("<p>one<p>two<ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table></div>x")
    assert [t.tag[k] for k in range(len(t.tag))] == ["html", "body", "p", "p", "ul", "li", "li", "table", "tr", "td", "td", "tr", "td"]
    assert dom.parse("<style a><div>x</div>").tag == ["html", "head", "style"]
    assert dom.parse(b"\xef\xbb\xbf<p>\xc3\xa9").content(0) == "é"
    assert dom.parse("<meta charset='latin-1'><p>\xe9".encode("latin-1")).content(0) == "é"
    with pytest.raises(AssumptionError):
        dom.parse("")


words = st.text("abc", min_size=1, max_size=3)
trees = st.recursive(words.map(lambda w: ("b", w, [])), lambda kids: st.tuples(st.sampled_from(["div", "span", "i", "em"]), words, st.lists(kids, max_size=4)), max_leaves=12)


def markup(t):
    tag, text, kids = t
    return f"<{tag} class='{text}'>{text}{''.join(markup(k) + 't' for k in kids)}</{tag}>"


@given(trees)
@settings(max_examples=60, deadline=None)
def test_intervals_and_text_against_another_parser(t):
    source = f"<html><body>{markup(t)}</body></html>"
    tree, other = dom.parse(source), ET.fromstring(source)
    flat = list(other.iter())
    assert tree.tag == [e.tag for e in flat]
    for k, e in enumerate(flat):
        assert tree.size[k] == len(list(e.iter())) - 1
        assert tree.content(k) == "".join(e.itertext())
        up = tree.parent[k]
        assert up is None or (up < k <= up + tree.size[up] and tree.level[k] == tree.level[up] + 1)


SELECTORS = [
    "//div", "//b[1]", "//b[last()]", "//div/b", "//span//b", "//*[@class='a']", "//i[not(b)]", "//div[count(b)>1]", "//b[position()=2]", "(//b)[2]", "//em/ancestor::div", "//b/following::i", "//b/preceding::b",
    "//b/following-sibling::*[1]", "//b/preceding-sibling::b", "//div[.//em or @class='b']", "//b[contains(., 'a')]", "//i | //em | //i", "//b/..", "//div[normalize-space(text())='a']", "//div//b[2]", "//*[starts-with(@class, 'a') and string-length(@class) > 1]",
]
STYLES = ["div b", "div > b", "b + b", "b ~ i", ".a", "b:first-child", "b:last-child", "b:nth-child(2)", "div:not(.a)", "[class^=a]", "i, em", ":nth-match(b, 2)"]


@given(st.lists(trees, min_size=1, max_size=3))
@settings(max_examples=6, deadline=None)
def test_one_page_and_the_corpus_agree(spark, forest):
    """The same selectors, walked over a tree and as plans over the node table."""
    from arborweb.plans import treewalk

    sources = [f"<html><body>{markup(t)}</body></html>" for t in forest]
    nodes = dom.shred(dom.from_strings(spark, [("u", x) for x in sources]), content=None).cache()
    known = [dom.parse(x) for x in sources]
    for k, s in enumerate([*map(Selector.xpath, SELECTORS), *map(Selector.css, STYLES)]):
        if k % 6 == len(forest) % 6 or k % 6 == len(sources[0]) % 6:
            got = sorted((r["page_id"], r["pre"]) for r in query(nodes, s).collect())
            assert got == [(p, x) for p, t in enumerate(known) for x in treewalk.find(t, 0, s)], s


def test_documents_that_cannot_be_parsed_are_rows(spark):
    pages = dom.from_strings(spark, [("a", "<p>x</p>"), ("b", " \n "), ("c", "<!-- only -->"), ("d", None), ("e", "<!DOCTYPE html>"), ("f", "")])
    assert {r["url"] for r in dom.shred(pages).collect()} == {"a"}
    both = dom.shred(pages, errors=True).cache()
    assert dom.elements(both).columns == dom.shred(pages).columns and dom.elements(both).count() == 3
    assert {(r["url"], r["class"]) for r in dom.failures(both).collect()} == {(u, "AssumptionError") for u in "bce"}


def test_contents_of_many_elements():
    t = dom.parse("<div>a<b>c<i>d</i>e</b>f" + "<u>" * 3000 + "x" + "</u>" * 3000 + "</div>")
    every = list(range(len(t.tag)))
    got = t.contents(every)
    assert all(got[k] == t.content(k) for k in every[:20]) and got[every[-1]] == "x"


@pytest.mark.parametrize("block", [2, 7, 4096])
def test_axes_by_blocks_agree_with_one_tree(spark, block, monkeypatch):
    """Every axis over pages cut into small blocks, against the selectors on one tree."""
    from arborweb.plans import treequery, treewalk

    monkeypatch.setattr(treequery, "BLOCK", block)
    html = "<body>" + "".join(f"<div id=d{k}><p>a<b>x{k}</b><i><b>y</b>t</i></p><ul><li>1<li>2<b>z</b></ul></div>" for k in range(6)) + "<p><b>end</b></p></body>"
    nodes = dom.shred(spark.createDataFrame([(1, "u", html)], "page_id LONG, url STRING, html STRING"), content=None).cache()
    tree = dom.parse(html)
    for text in ("//p//b", "//b/ancestor::div", "//b/ancestor-or-self::*", "//i/following::b", "//i/preceding::b", "//li/following-sibling::li", "//div/preceding-sibling::div", "//div[3]/following::p[1]", "//li[2]/preceding::b[2]", "//div[.//b='x3']//b", "//b/ancestor::*[2]", "//div/following-sibling::div[1]", "//p/descendant-or-self::*"):
        s = Selector.xpath(text)
        got = [r["pre"] for r in treequery.query(nodes, s).orderBy("pre").collect()]
        assert got == sorted(treewalk.find(tree, 0, s)), text
    own = [r["value"] for r in treequery.query_strings(nodes, Selector.xpath("//p//text()")).orderBy("pos").collect()]
    assert own == treewalk.find_strings(tree, 0, Selector.xpath("//p//text()"))
    nodes.unpersist()


def test_a_page_of_a_hundred_thousand_elements(spark, tmp_path):
    """Each axis in seconds, however many elements one page has."""
    import time

    from arborweb.plans import treequery

    n = 33_000
    pages = spark.createDataFrame([(1, "u", "<body>" + "<div><p><a>t</a></p></div>" * n + "</body>")], "page_id LONG, url STRING, html STRING")
    dom.shred(pages).write.parquet(str(tmp_path / "nodes"))
    nodes = spark.read.parquet(str(tmp_path / "nodes"))
    for text, want in (("//div//a", n), ("//a/ancestor::div", n), ("//p/following::a", n - 1), ("//p/preceding::a", n - 1), ("//div/following-sibling::div", n - 1), ("//body//p//a", n)):
        began = time.perf_counter()
        assert treequery.query(nodes, Selector.xpath(text)).count() == want
        assert time.perf_counter() - began < 60, text
