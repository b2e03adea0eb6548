import itertools
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest

from tallyweave.llm import html_text as ht
from tallyweave.llm.queries import html_extraction

WEIGHTS = {"p": 2.0, "h1": 2.0, "li": -1.0, "a": -1.0, "<p": -0.1, "<li": -2.0}


class Article(HTMLParser):
    """Blocks of the article element, by a plain parser."""

    def __init__(self):
        super().__init__()
        self.on, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.on |= tag == "article"
        self.blocks.append("") if tag in ("p", "h1", "article") else None
        self.blocks[-1] += " " if tag == "br" else ""

    def handle_endtag(self, tag):
        self.on &= tag != "article"
        self.blocks.append("") if tag in ("p", "h1", "article") else None

    def handle_data(self, data):
        if self.on:
            self.blocks[-1] += data


def test_query_against_a_plain_parser(spark):
    sf = "/root/testdata/sf0.01"
    t = pq.read_table(f"{sf}/pages.parquet")
    got = {r.page_id: r for r in html_extraction(spark, sf).collect()}
    assert len(got) == t.num_rows
    for key, url, page in zip(*(t[c].to_pylist() for c in ("page_id", "url", "html"))):
        plain = Article()
        plain.feed(page)
        want = "\n".join(x for x in (" ".join(b.split()) for b in plain.blocks) if x)
        assert (got[key].url, got[key].text, got[key].n_chars) == (url, want, len(want))


@pytest.mark.parametrize("page, want", [
    ("", ""), ("<p></p>", ""), ("plain words", "plain words"),
    ("<p>a &amp; b&nbsp;&#233; &lt;i&gt; 1 < 2</p>", "a & b é <i> 1 < 2"),
    ("<nav><p>menu menu</p></nav><p>one\n two<br>three<b>!</b></p><footer><p>end</p></footer>",
     "one two three!"),
    ("<article><p>first</p><div class='x Ad-box'><p>buy it</p></div><p>second</p></article>",
     "first\nsecond"),
    ("<p>x</p><script>var a='</p><p>no no no no';</script><style>p{}</style><!-- <p>no --><p>y z</p>",
     "x\ny z"),
    ("<ul><li>m<li>m<li>m m</ul><p>unclosed <p>paragraphs <b>here", "unclosed\nparagraphs here"),
    ("<p>kept</p><section id=comments><p>reader says so</p></section>", "kept"),
    ("<p title='a > b'>text</p><form><p>name</p></form><aside>more</aside>", "text"),
    ("<p>a</p><!-- never closed <p>b", "a"), ("<p>&am<b>p;</b> x", "&amp; x"),
    # classes of the layout on what holds the article
    ("<div class='site-content right-sidebar'><article><p>one two</p></article>"
     "<div class='sidebar'><p>no no no no</p></div></div>", "one two"),
    ("<div id='page' class='has-header'><main><p>one two</p></main></div>", "one two"),
    ("<section class='post comments-open'><p>one two three</p></section><p class=ad>buy</p>",
     "one two three"),
    ("<div class='ad-free'><p>one</p><div class='share-buttons'><p>x</p></div><p>two</p></div>",
     "one\ntwo"),
    ("<form id=all><article><p>one two</p><form><p>name</p></form></article></form>", "one two"),
    ("<div class=sidebar><main><p>one two</p></main></div>", "one two"),
    ("<main><p>up up up</p><div class='sidebar'><article><p>one two three four five</p></article>"
     "</div></main>", "up up up\none two three four five"),
    # articles beside the article
    ("<article><p>one two three</p></article><aside><article><p>read this too and also that and"
     "</p></article></aside>", "one two three"),
    ("<p>one two</p><div id=comments><article><p>a reader says very much about it</p></article>"
     "</div>", "one two"),
    ("<div class=comments-area><article><p>a reader</p></article></div><p>one two</p>", "one two"),
    # equal regions: the first
    ("<p>one two</p><ul><li>m m m m</ul><p>six ten</p>", "one two"),
])
def test_cases(page, want):
    assert ht.main_text(page, WEIGHTS) == want


def test_region_has_the_largest_sum():
    page = "<li>a b</li><p>c d e e</p><li>f</li><p>g h i j</p><li>k l m n o p q</li><p>r s</p>"
    w = {"p": 1.0, "li": -1.0, "<p": -0.5, "<li": -0.5}
    scores = []
    for kind, text, _, _ in ht.tokens(page):
        scores.append(w[kind] * (len(text.split()) if kind[0] != "<" else 1))
    best = max(sum(scores[a:b]) for a, b in itertools.combinations(range(len(scores) + 1), 2))
    got = ht.main_text(page, w)
    assert got == "c d e e\nf\ng h i j"
    at = [i for i, (k, t, _, _) in enumerate(ht.tokens(page)) if t in ("c d e e", "g h i j")]
    assert sum(scores[at[0]:at[1] + 1]) == best


def test_weights_and_odd_rows(spark):
    rows = [(i, f"<nav><a>go go</a></nav><article><p>word {i} word</p></article>", "u", 1)
            for i in range(30)] + [(40, None, None, 2), (41, "", "u", 3), (0, "<p>again", "u", 4),
                                   (None, "<p>" + "long " * 100_000, "u", 5)]
    df = spark.createDataFrame(rows, "page_id long, html string, text string, n_chars int")
    weights = ht.page_weights(df, "page_id", "html")
    assert weights["p"] > 0 > weights["nav"] and weights["<nav"] < 0
    got = ht.extract_text(df, "page_id", "html", weights).collect()
    assert sorted((r.row.n_chars, r.text, r.n_chars) for r in got if r.row.n_chars in (2, 3, 4)) == [
        (2, "", 0), (3, "", 0), (4, "again", 5)]
    assert max(r.n_chars for r in got) == 499_999 and len(got) == 34
    none = df.limit(0)
    assert ht.page_weights(none, "page_id", "html") == {}
    assert ht.extract_text(none, "page_id", "html", {}).count() == 0


