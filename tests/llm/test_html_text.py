import os
from html.parser import HTMLParser

import pytest

from nearframe.llm.html_text import COLUMNS, INLINE, LABELLED, RAW, UNSEEN, VOID, blocks, extract, is_main, main_text

LONG = "This paragraph has quite a number of words so that nobody takes it for a menu or a title of some kind."

CASES = [
    ("<article><h1>T &amp; U</h1><p>One\n two<br>three</p><p>Ti.</p></article>", "T & U One two three Ti."),
    ("<nav><a href=/>Home</a></nav><article><p>a<b>b</b>c</p></article><footer>&copy; x</footer>", "abc"),
    ("<article><p><b>bold.<br><p>next</p><p>a &lt;tag&gt; &#233;&#x41;&euro;</article>", "bold. next a <tag> éA€"),
    ("<body><script>var t='</p><p>no';</script><style>p{}</style><main><p>yes<!-- <p>no</p> --></p></main>", "yes"),
    ("<article><p>kept</p><aside>side</aside><div class='ad-box'>buy</div><form>go <input></form>"
     "<section id=comments><article><p>first!</p></article></section></article>", "kept"),
    ("<article><header><h1>Own title</h1></header><p>body</p><footer>by me</footer></article>", "Own title body"),
    ("<form id=page><article><p>in a form page</p></article></form>", "in a form page"),
    (f"<div><a href=1>Home</a> <a href=2>News</a></div><h1>Head</h1><p>{LONG}</p><p>Short one.</p><p>{LONG}</p>"
     "<ul><li><a href=3>x y</a></li><li><a href=4>z</a></li></ul>", f"Head {LONG} Short one. {LONG}"),
    ("<div id=top>hello</div><div class='post-content'><h1>H</h1><p>Short.</p><div class=alert>x</div><p>Also.</p></div>"
     "<div class=commentList><div class=content>me too</div></div>", "H Short. Also."),
    ("<div class=wrap><div role=main><p>One.</p></div><p>out</p></div>", "One."),
    ("<article><p>broken off &am", "broken off &am"), ("<article><p>broken <a href='x", "broken"),
    ("<article><p title='a>b' class=x>quoted</p></article>", "quoted"), ("</p></div><article>x</article></b>", "x"),
    ("<article><p hidden>no</p><p style='display: none'>no</p><p>a&nbsp;b c</p></article>", "a b c"),
    ("<article><p>one</p><p><a href=1>all link</a></p><p>two</p></article>", "one all link two"),
    ("<article></article>", ""), ("", ""), (None, ""), ("<p></p> <br> ", ""), ("<" * 50, ""),
]


@pytest.mark.parametrize("page, text", CASES)
def test_main_text(page, text):
    assert main_text(page) == text


def test_tree_knows_its_table():
    assert all(len(row) == len(COLUMNS) + 1 and is_main(row[:-1]) == bool(row[-1]) for row in LABELLED)


def test_extract(spark):
    rows = [(i, "u", page, "clash") for i, (page, _) in enumerate(CASES)] * 2 + [(99, None, "<article>" + "<p>w</p>" * 20_000, None)]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert got.columns == ["page_id", "url", "html", "text", "text_", "n_chars"]
    found = got.collect()
    assert len(found) == len(rows)
    for r in found:
        want = " ".join(["w"] * 20_000) if r.page_id == 99 else CASES[r.page_id][1]
        assert (r.text_, r.n_chars) == (want, len(want))
    assert extract(got.limit(0)).count() == 0


BAR = "<div class=sidebar><p>bar</p></div>"
HEADS = ["<title>no</title><meta charset=x><body>", "<script>no</script><body class=x>", "<link rel=x><div>",
         "<noscript><p>no</p></noscript><div>", "<title>no</title>", "<template><p>no</p></template><body>", "<style>no</style>", ""]
WRAPPERS = [f'<{tag} {mark}="{name}">' for tag in ("div", "section") for mark in ("class", "id")
            for name in ("layout has-sidebar", "no-sidebar", "nav-open", "with-header", "sidebar-right", "page widgets",
                         "hasComments", "header layout")]


@pytest.mark.parametrize("start", HEADS)
def test_head_without_end(start):
    assert main_text(f"<html><head>{start}<article><p>One.</p><p>Two.</p></article>") == "One. Two."
    assert main_text(f"<html><head>{start}<p>{LONG}</p></html>") == LONG
    assert main_text(f"<head><title>no</title>{LONG}<p>{LONG}</p>") == f"{LONG} {LONG}"
    assert main_text("<head><noscript><img src=x><p>no</p></noscript><meta name=x></head><main>yes</main>") == "yes"


@pytest.mark.parametrize("start", WRAPPERS)
@pytest.mark.parametrize("inner", ["article", "main", "div role=main", "div class=post-content"])
def test_wrapper_named_like_a_region(start, inner):
    page = f"{start}{BAR}<{inner}><h1>T</h1><p>One.</p>{BAR}<p>Two.</p></{inner.split()[0]}>{BAR}"
    rest = "<div class=comments><article><p>me too</p></article></div></div></section><footer>foot</footer>"
    assert main_text(page + rest) == main_text(f"<div class='menu nav'>{page}{rest}") == "T One. Two."


def test_regions_around_other_articles():
    """Articles in regions stay out where the main text is outside of them."""
    for box in ("related", "sidebar", "comments"):
        other = f"<div class={box}><article><p>other</p></article></div>"
        assert main_text(f"<main><p>text</p>{other}</main>") == main_text(f"<article>text</article>{other}") == "text"
        assert main_text(f"<div class='post-content'>text</div>{other}") == "text"
    assert main_text(f"<div class=nav-open hidden><article>{LONG}</article></div>") == ""


@pytest.mark.parametrize("page, text", [
    ("<article><p title='it's'>kept</p><p>too</p></article>", "kept too"),
    ('<article><p><a href="x"" class="y">one</a> two</p></article>', "one two"),
    ("<article><p title = 'a > b' class=x'>c</p><p data-x=a\"b>d</p></article>", "c d"),
    (f'<article><section id="related-work"><h2>Related</h2><p>{LONG}</p></section></article>', f"Related {LONG}"),
    (f'<main><section id="search-algorithms"><h2 id="copyright-law">S</h2><p>{LONG}</p></section></main>', f"S {LONG}"),
    ("<p>Hi there</p>", "Hi there"), ("<div><p>One line.</p><p>And one.</p></div><nav><a href=1>Home</a></nav>", "One line. And one."),
    ("<p><a href=1>only</a></p><p>said <a href=2>so</a></p>", "said so"),
    ("<article><p>a</p><div class='related-posts'><p>no</p></div><div id=share_buttons>no</div></article>", "a"),
    ("<article><p>a</p><div class=article-comments-list><p>no</p></div><h2 class=promo>h</h2></article>", "a h"),
])
def test_broken_quotes_names_and_short_pages(page, text):
    assert main_text(page) == text


class Blocks(HTMLParser):
    """The texts between the tags of block elements, by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.out, self.parts, self.unseen = [], [], []

    def close_block(self):
        text = " ".join("".join(self.parts).split())
        self.out += [text] if text else []
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE:
            self.close_block()
        elif tag == "br":
            self.parts.append(" ")
        if tag in UNSEEN | RAW and tag not in VOID:
            self.unseen.append(tag)

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self.close_block()
        if tag in self.unseen:
            del self.unseen[self.unseen.index(tag):]

    def handle_data(self, data):
        if not self.unseen:
            self.parts.append(data)


FOLDER = "/root/testdata/sf0.01/pages.parquet"


@pytest.mark.skipif(not os.path.exists(FOLDER), reason="no pages here")
def test_blocks_equal_those_of_another_parser(spark):
    pages = [r.html for r in spark.read.parquet(FOLDER).select("html").where("html IS NOT NULL").collect()]
    assert len(pages) > 100
    for page in pages:
        other = Blocks()
        other.feed(page)
        other.close()
        other.close_block()
        assert [b[0] for b in blocks(page)] == other.out
