import html
import random
import re
import time

import pytest

from arborweb.llm import main_text as M

CASES = {
    "": "",
    "<p>": "",
    "just text": "just text",
    "<html><head><title>T</title><style>p{}</style><script>var x='</p><p>no';</script></head><body><nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p><b>one\n two<br>three<p>four&nbsp;five</article><footer>&copy; x</footer>": "A & B\none two three\nfour five",
    "<body class='has-sidebar'><div class=cookie-notice>We use cookies to make it work</div><div class=post><h1>Title</h1><p>First para with <a href=x>a link</a>.<aside>not this</aside><p>Short.</p><form><label>Mail</label><input></form><p>End.</p></div><div class='comments'><p>Nice, said the reader</p></div></body>": "Title\nFirst para with a link.\nShort.\nEnd.",
    "<div id='sidebar-wrap'><main><h1>In</h1><p>Held by a hinted element.</p></main></div><div>outside of it all</div>": "In\nHeld by a hinted element.",
    "<article><p>Text.</p></article><article class=comment><p>A reader's words, many of them here.</p></article>": "Text.",
    "<p>cut off <a href='x": "cut off",
    "<p>a<!-- no <p>no</p> -->b</p><!-- open": "ab",
    "<p title='a>b'>one</p><p x=\"unclosed>two</p>": "one\ntwo",
    "<ul><li>first<li>second</ul><table><tr><td>c1<td>c2</table>": "first\nsecond\nc1\nc2",
    "<p>5 &lt; 6 &#38; &bogus; &am</p>": "5 < 6 & &bogus; &am",
    "<div hidden>secret</div><p>shown</p>": "shown",
    "<article><header><h1>H</h1></header><p>Body of it.</p><footer>by me</footer></article>": "Body of it.",
}


@pytest.mark.parametrize("page", CASES)
def test_cases(page):
    assert M.extract(page) == CASES[page]


def test_best_run_against_all_runs():
    import random

    draw = random.Random(2)
    for _ in range(200):
        s = [draw.randint(-5, 5) for _ in range(draw.randrange(0, 12))]
        a, b = M.best_run(s)
        best = max([0, *(sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1))])
        assert sum(s[a:b]) == best


def test_labelled_pages_are_found_again():
    for page in M.LABELLED:
        before, rest = page.split("[[")
        region, after = rest.split("]]")
        assert M.extract(before + region + after) == M.extract(region)


def test_table(spark):
    rows = [(1, "u", None, "c"), (2, None, "", "c"), (3, "u", "<p>x y</p>", "c"), (3, "u", "<p>x y</p>", "c"), (None, "u", "<p>" + "word " * 50000 + "</p>", "c")]
    df = spark.createDataFrame(rows, "page_id LONG, url STRING, html STRING, text STRING")
    got = sorted((str(r["page_id"]), r["url"], r["text"][:9], r["n_chars"]) for r in M.main_text(df).collect())
    assert got == [("1", "u", "", 0), ("2", None, "", 0), ("3", "u", "x y", 3), ("3", "u", "x y", 3), ("None", "u", "word word", 249999)]
    assert M.main_text(df.limit(0)).collect() == []


def test_whole_article_of_a_page_like_those_stored():
    page = "<!DOCTYPE html><html><body><nav><ul><li><a href='/a'>a</a></li></ul></nav><div class='ad'>Buy this now please it is good.</div><article><h1>T</h1>" + "".join(f"<p>par {i} has words</p>" for i in range(300)) + "</article><footer>&copy; h &middot; Some words here.</footer></body></html>"
    assert M.extract(page) == "T\n" + "\n".join(f"par {i} has words" for i in range(300))


REFERENCES = [f"Source {i}" for i in range(12)]
LINKS = {
    "<div><a href=/>Home</a> <a href=/n>News</a></div><article><h1><a href=/x>Title</a></h1><p>Body of it.</p></article>": "Title\nBody of it.",
    "<article><p>Body.</p><ul>" + "".join(f"<li><a href=/r>{r}</a>" for r in REFERENCES) + "</ul></article>": "\n".join(["Body.", *REFERENCES]),
    "<article><h1>A title of six plain words</h1><ul>" + "".join(f"<li><a href=/r>{r}</a>" for r in REFERENCES) + "</ul><p>Then a text.</p></article>": "\n".join(["A title of six plain words", *REFERENCES, "Then a text."]),
    "<article><p>One.</p><ul>" + "<li><a href=/r>Link</a>" * 40 + "</ul><p>Two.</p></article>": "\n".join(["One.", *["Link"] * 40, "Two."]),
    "<div><a href=/>Home</a> <a href=/n>About us</a></div><div class=post><h1><a href=/x>Title</a></h1><p>Body of it.</p><ul>" + "<li><a href=/r>Smith, On papers and words</a>" * 12 + "</ul></div><div><a href=/p>Privacy</a> <a href=/t>Terms</a></div>": "\n".join(["Title", "Body of it.", *["Smith, On papers and words"] * 12]),
}


@pytest.mark.parametrize("page", LINKS)
def test_link_rich_article_text_is_whole(page):
    assert M.extract(page) == LINKS[page]


NAMED = {
    "<article><h1>T</h1><section id=discussion><h2 id='related-work'>Related</h2><p id='search-method'>We looked.</p></section><div id='social-impact'><p>It matters.</p></div><pre>x <span class='comment'># why</span></pre></article>": "T\nRelated\nWe looked.\nIt matters.\nx # why",
    "<div><h1>T</h1><section id=discussion><p>We talked.</p></section><p id='search-method'>We looked.</p></div>": "T\nWe talked.\nWe looked.",
    "<article><p>Text of it.</p><div class='comments'>A reader's words.</div><p>End.</p></article>": "Text of it.\nEnd.",
    "<article><p>Text.</p></article><div class='ad'>Many more words than the text has.</div>": "Text.",
}


@pytest.mark.parametrize("page", NAMED)
def test_anchors_are_no_hints(page):
    assert M.extract(page) == NAMED[page]


OTHER_SENSES = ["div class='market-share'", "p class='price-alert'", "section class='court-reply'", "div id='dinner-menu'", "div class='warrantNotice'", "table class='related'", "figure class='banner'", "blockquote class='comment'", "pre class='login'"]
PARTS = ["div class='post-comments'", "div class='site-notice'", "div class='entry-footer'", "ul class='social-share'", "div class='reader-comments'", "div class='comment'", "table class='sidebar'", "div class='articleShare'"]


@pytest.mark.parametrize("frame", ["<article>{}</article>", "<div>{}</div>", "<main>{}</main>"])
def test_words_of_pages_in_other_senses_are_text(frame):
    for opened in OTHER_SENSES:
        inner = "<tr><td>Words of the inner part here.</td></tr>" if opened.startswith("table") else "Words of the inner part here."
        page = f"<nav><a href=/>Home</a></nav>{frame.format(f'<h1>Title</h1><p>The first paragraph of the text.</p><{opened}>{inner}</{opened.split()[0]}><p>More at the end of it.</p>')}<footer>foot</footer>"
        assert M.extract(page) == "Title\nThe first paragraph of the text.\nWords of the inner part here.\nMore at the end of it.", opened
    for opened in PARTS:
        page = f"<nav><a href=/>Home</a></nav>{frame.format(f'<h1>Title</h1><p>The first paragraph of the text.</p><{opened}>Words of another kind</{opened.split()[0]}><p>More at the end of it.</p>')}<footer>foot</footer>"
        assert M.extract(page) == "Title\nThe first paragraph of the text.\nMore at the end of it.", opened


def test_text_beside_teasers_is_kept():
    text = "".join(f"<p>Paragraph {i} of the long text.</p>" for i in range(20))
    page = f"<div class='post'><h1>T</h1>{text}</div><article class='card'><a href=/a>Other</a> teaser</article>"
    assert M.extract(page).startswith("T\n" + "\n".join(f"Paragraph {i} of the long text." for i in range(20)))


MEANT = {
    "<article><p>Up.</p><div class='share-price'>4.20</div><div class='share-buttons'>Share it</div><p>Down.</p></article>": "Up.\n4.20\nDown.",
    "<article><p>It is <math><mi>x</mi><mo>=</mo><mn>2</mn></math> here.</p></article>": "It is x=2 here.",
    "<article><section id=discussion><h2 id=related-work>Related</h2><p>Work.</p></section></article>": "Related\nWork.",
    "<div class='entry'><h1>T</h1><p>Words of the text.</p><div style='display: none'>unseen</div><p>More of it.</p></div><div class='newsletter-signup'><p>Get our letter each and every day of the week</p></div>": "T\nWords of the text.\nMore of it.",
    "<article><p>One.</p><aside>" + "far too many words " * 60 + "</aside><p>Two.</p></article>": "One.\nTwo.",
}


@pytest.mark.parametrize("page", MEANT)
def test_names_mean_their_last_word(page):
    assert M.extract(page) == MEANT[page]


@pytest.mark.parametrize("page", ["<div>" + "<b>" * 50000 + "x" + "</i>" * 50000, "<p><td>" + "<b>" * 30000 + "<div></div>" * 30000, "<li>" * 50000, "<div class=ad>" * 50000 + "x", "<table>" + "<tr><td>x" * 30000])
def test_deep_nesting_takes_linear_time(page):
    began = time.perf_counter()
    M.extract(page)
    assert time.perf_counter() - began < 5


def slow(page):
    """The run of the greatest sum among all runs, and its text put together from scratch."""
    whole = M.Page(page)
    scores, shown = M.scored(whole, M.known())
    best, run = 0.0, (0, 0)
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > best + 1e-9:
                best, run = total, (i, j + 1)
    lines = [""]
    for (_, text, words), is_text in list(zip(whole.tokens, shown))[run[0] : run[1]]:
        if words < 0 and text not in M.INLINE and text not in M.RAW:
            lines.append("")
        elif words < 0:
            lines[-1] += " " if text == "br" else ""
        elif is_text:
            lines[-1] += text
    return "\n".join(x for x in (re.sub(r"\s+", " ", line).strip() for line in lines) if x)


def test_extract_against_all_runs():
    draw = random.Random(4)
    pieces = ["<p>", "</p>", "<div>", "</div>", "<a href=x>", "</a>", "<div class=ad>", "<nav>", "</nav>", "<h1>", "</h1>", "<li>", "<ul>", "</ul>", "<article>", "</article>", "<aside>", "</aside>", "<b>", "</b>", "<br>", "a ", "b c", " some more words of it ", "&amp;", "<table><td>", "</table>"]
    for _ in range(300):
        page = "".join(draw.choice(pieces) for _ in range(draw.randrange(1, 40)))
        assert M.extract(page) == slow(page), page
    for page in M.labelled(40, seed=7):
        assert M.extract(page) == slow(page)


def plain(text):
    """The words of a piece of a labelled page that are its text."""
    text = re.sub(r"\{\{.*?\}\}", " ", text, flags=re.S)
    return html.unescape(re.sub(r"<[^>]*>", " ", text)).split()


def test_pages_that_were_not_learned_from():
    found = wanted = right = 0
    for page in M.labelled(200, seed=99):
        region = plain(page.split("[[")[1].split("]]")[0])
        got = M.extract(re.sub(r"\[\[|\]\]|\{\{|\}\}", "", page)).split()
        both = min(len(got), len(region))
        found, wanted, right = found + len(got), wanted + len(region), right + both
    assert right / wanted > 0.97 and right / found > 0.97


def test_the_scan_decides_where_names_do_not(monkeypatch):
    """With all names and roles taken away, links and tags alone tell the text from the rest."""
    pages = ["<div><a href=/>Home</a> <a href=/n>News</a> <a href=/m>More</a></div><div><h1>T</h1>" + f"<p>{'words of the text ' * n}</p>" * 3 + "</div><div><a href=/p>Privacy</a> <a href=/t>Terms</a></div>" for n in range(1, 21)]
    with_scan = [M.extract(p) for p in pages]
    assert all(t.startswith("T\nwords") and "Privacy" not in t and "Home" not in t for t in with_scan)
    monkeypatch.setattr(M, "best_run", lambda scores: (0, len(scores)))
    assert all(M.extract(p) != t for p, t in zip(pages, with_scan))
