"""Main texts of pages with known articles, written apart from the model's own training pages."""

import itertools
import random
import time

import numpy as np
import pytest

from locusframe.llm import html

WORDS = "river stone castle music letter garden winter morning engine paper island bridge market doctor painter signal harbour forest".split()


class Page:
    """A page of random layout, and the text of its article."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        self.said: list[str] = []
        self.html = self.page()

    def words(self, lo: int, hi: int) -> str:
        return " ".join(self.rng.choice(WORDS) for _ in range(self.rng.randint(lo, hi)))

    def sentence(self, lo: int = 3, hi: int = 25) -> str:
        return self.words(lo, hi).capitalize() + "."

    def tell(self, text: str) -> str:
        self.said.append(text)
        return text

    def paragraph(self) -> str:
        kind = self.rng.randrange(6)
        s = " ".join(self.sentence() for _ in range(self.rng.randint(1, 4)))
        if kind == 0:
            self.tell(f"{s} {s[:5]}tail & more.")
            return f"<p>{s}\n  <b>{s[:5]}</b>tail &amp; more.</p>"
        if kind == 1:
            self.tell(f"On 5 May 1900 {s}")
            return f'<p>On <span class="date">5 May 1900</span> {s}</p>'
        if kind == 2:
            self.tell(f"{s} See here too.")
            return f'<p class="lead">{s} <a href="/x">See <em>here</em></a> <span class="comment-ref">too</span>.'
        return f"<p>{self.tell(s)}</p>"

    def block(self) -> str:
        kind = self.rng.randrange(17)
        if kind < 6 or kind == 16:
            return self.paragraph()
        if kind == 12:
            return f'<figure><img src="a.png" alt="{self.words(1, 3)}"><figcaption>{self.tell(self.sentence(3, 9))}</figcaption></figure>'
        if kind == 13:
            return "<table><tr>" + "".join(f"<th>{self.tell(self.words(1, 2))}" for _ in range(3)) + "<tr>" + "".join(f"<td>{self.tell(self.words(1, 3))}" for _ in range(3)) + "</table>"
        if kind == 14:
            return "<ol>" + "".join(f"<li><p>{self.tell(self.sentence(2, 12))}</p></li>" for _ in range(self.rng.randint(2, 4))) + "</ol><hr>"
        if kind == 15:
            title = self.tell(self.words(2, 5))
            return f'<h3 class="section-title" id="{self.rng.choice(WORDS)}">{title}</h3><div>{self.paragraph()}{self.paragraph()}</div>'
        if kind == 6:
            return f"<h2>{self.tell(self.words(2, 6).title())}</h2>" + self.paragraph()
        if kind == 7:
            return "<ul>" + "".join(f"<li>{self.tell(self.sentence(2, 12))}" for _ in range(self.rng.randint(2, 5))) + "</ul>"
        if kind == 8:
            return f"<pre>{self.tell(self.words(3, 20))}</pre>"
        if kind == 9:
            return "<dl>" + "".join(f"<dt>{self.tell(self.words(1, 2))}<dd>{self.tell(self.sentence(3, 12))}" for _ in range(2)) + "</dl>"
        if kind == 10:
            return f"<blockquote><p>{self.tell(self.sentence())}</p></blockquote>"
        return f'<section id="popular-science"><h3>{self.tell(self.words(2, 4))}</h3>{self.paragraph()}</section>'

    def menu(self) -> str:
        return "<ul>" + "".join(f'<li><a href="/{w}">{w}</a></li>' for w in self.rng.sample(WORDS, self.rng.randint(2, 6))) + "</ul>"

    def aside(self) -> str:
        return self.rng.choice(
            [
                lambda: f"<nav>{self.menu()}</nav>",
                lambda: f'<div class="main-menu">{self.menu()}</div>',
                lambda: f'<aside><h3>Related</h3>{self.menu()}<p>{self.sentence()}</p></aside>',
                lambda: f'<div id="sidebar"><p>{self.sentence()}</p></div>',
                lambda: f'<div class="advert"><p>{self.sentence()}</p></div>',
                lambda: f'<div class="cookie-banner"><p>We use cookies. {self.sentence()}</p><button>Accept</button></div>',
                lambda: f'<form action="/s"><label>Search</label><input name="q"><button>Go</button></form>',
                lambda: f'<section class="comments"><h2>Comments</h2><div class="comment"><p>{self.sentence()}</p></div><div class="comment"><p>{self.sentence()}</p></div></section>',
                lambda: f'<div class="newsletter"><p>Subscribe. {self.sentence()}</p></div>',
                lambda: f"<script>var a = '<p>{self.words(1, 5)}</p>';</script><style>p {{ color: red }}</style>",
                lambda: f"<!-- {self.words(2, 9)} -->",
            ]
        )()

    def page(self) -> str:
        r = self.rng
        before = "".join(self.aside() for _ in range(r.randint(0, 3)))
        opening, closing = r.choice([("<article>", "</article>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"), ('<main id="main">', "</main>"), ('<article class="post"><div class="entry-content">', "</div></article>"),
            ('<div id="page"><div class="row"><div class="col-md-8"><div class="ArticleBody">', "</div></div></div></div>"), ('<section><div class="td-post-content">', "</div></section>"), ('<div class="layout"><main role="main"><div>', "</div></main></div>")])
        body = f"<h1>{self.tell(self.words(2, 7).title())}</h1>" if r.random() < 0.6 else ""
        for _ in range(r.choice([1, 1, 2, 3, 5, 8])):
            body += self.block()
            if r.random() < 0.15:
                body += r.choice([f'<div class="ad-box">{self.sentence()}</div>', f'<aside class="related"><p>{self.sentence()}</p></aside>', f'<div class="share-buttons"><a href="#">{self.words(1, 1)}</a> <a href="#">{self.words(1, 1)}</a></div>', f'<div class="reader-comments"><p>{self.sentence()}</p></div>', ""])
        after = "".join(self.aside() for _ in range(r.randint(0, 3)))
        head = f"<head><title>{self.words(2, 5)}</title><script>x()</script></head>"
        return f"<!DOCTYPE html><html>{head}<body><header><p>{self.words(1, 3)}</p></header>{before}{opening}{body}{closing}{after}<footer><p>Copyright {self.words(1, 3)}</p></footer></body></html>"


def test_articles_of_500_layouts():
    pages = [Page(seed) for seed in range(500)]
    got = html.main_texts([p.html for p in pages], *html.model())
    wrong = [k for k, (p, text) in enumerate(zip(pages, got, strict=True)) if text != " ".join(p.said)]
    assert not wrong, [(pages[k].html, got[k]) for k in wrong[:2]]


def wrap(article: str) -> str:
    return f'<html><head><title>T</title></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav>{article}<footer>Copyright Site.</footer></body></html>'


@pytest.mark.parametrize(
    ("article", "text"),
    [
        ("<article><p>One short paragraph of text.</p></article>", "One short paragraph of text."),
        ("<article><p>One.</p><pre>code x = 1</pre></article>", "One. code x = 1"),
        ("<article><p>One paragraph.</p><dl><dt>Term</dt><dd>Meaning of it.</dd></dl></article>", "One paragraph. Term Meaning of it."),
        ('<article><p>the battle took place on <span class="date">5 May 1900</span> near the river</p></article>', "the battle took place on 5 May 1900 near the river"),
        ('<article><p>Some <span class="comment-ref">notes</span> here.</p><section id="popular-science"><p>It is here to stay.</p></section></article>', "Some notes here. It is here to stay."),
        ("<article>Bare text of an article.</article>", "Bare text of an article."),
        ('<article><div><span class="date">5 May</span> the battle took place.</div></article>', "5 May the battle took place."),
        ('<article><p>a < b and 3 <4 hold, &lt;p&gt; too</p></article>', "a < b and 3 <4 hold, <p> too"),
    ],
)
def test_small_articles(article, text):
    assert html.main_texts([wrap(article)], *html.model()) == [text]


@pytest.mark.parametrize("part", ["<a b ", "<div>", '<a "x>y" ', "<b></section>", "<svg>", "<", "<!--", "<a '>", "<li>", "<table><tr><td>", "<p><b><div>", "</p>"])
def test_a_megabyte_of_open_markup_takes_seconds_at_most(part):
    w, pair = html.model()
    page = part * (1_000_000 // len(part))
    start = time.perf_counter()
    html.main_texts([page], w, pair)
    whole = time.perf_counter() - start
    assert whole < 8  # about one second on an idle core; quadratic time would be minutes


def test_messages_are_exact_marginals():
    """Against sums over all labellings of small trees."""
    pages = ["<article><h1>a</h1><p>b</p></article>", "<nav><ul><li>x</li></ul></nav><main><p>t</p></main>", "<div><p>a<p>b</div>", ""]
    rng = np.random.default_rng(1)
    for page in pages:
        f = html.Forest([html.parse(page)])
        w, pair = rng.normal(size=html.WIDTH) / 3, rng.normal(size=(html.KINDS, 2, 2))
        n, u = len(f.x), f.x @ w
        total, mass = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=n):
            e = np.exp(sum(u[i] * y[i] for i in range(n)) + sum(pair[f.kind[i], y[f.parent[i]], y[i]] for i in range(1, n)))
            total += e
            mass += e * np.array(y)
        assert n <= 14 and f.marginals(w, pair)[0] == pytest.approx(mass / total)


def test_query_rows(spark):
    rows = [(1, "u", wrap("<article><p>Some text.</p></article>")), (1, "v", wrap("<article><p>Some text.</p></article>")), (2, None, None), (None, "w", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'t' as text", "1 as n_chars")
    got = sorted((str(r["page_id"]), str(r["url"]), r["text"], r["n_chars"]) for r in html.extract(pages).collect())
    assert got == [("1", "u", "Some text.", 10), ("1", "v", "Some text.", 10), ("2", "None", "", 0), ("None", "w", "", 0)]
