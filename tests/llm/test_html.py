import itertools
import random

import pytest

from groundplan.llm import html

ARTICLE = "<h1>Title &amp; more</h1><p>First paragraph of the text,\n  long <b>eno</b>ugh to be one.<br>Next line.</p><p>Short.</p><p>Last one with a <a href='x'>link</a> in it.</p>"
TEXT = "Title & more First paragraph of the text, long enough to be one. Next line. Short. Last one with a link in it."
AROUND = [
    "<nav><ul><li><a href='/a'>Home</a></li><li>About us</li></ul></nav>", "<header><h2>The Site</h2><p>All news, every day of the year.</p></header>",
    "<div class='ad-banner'><p>Buy this product now, it is on offer this week only.</p></div>", "<aside><p>Also read this other story of ours, it is good.</p></aside>",
    "<div id=\"cookieNotice\">We use cookies on this site to make it work.</div>", "<form><p>Your mail address, please.</p><button>Send</button></form>",
    "<section class='comments'><article><p>What a great article, I would like to read more of it.</p></article></section>", "<footer><p>All rights reserved by the owners of this site.</p></footer>",
    "<script>var a = '<p>not a text</p>';</script>", "<style>p { margin: 0 }</style>", "<!-- <p>hidden</p> -->", "<div style='display: none'>Not shown to anyone at all.</div>", "<div role=navigation>Up Down</div>",
]


@pytest.mark.parametrize("holder", ["<article>{}</article>", "<main>{}</main>", "<div class='post-content'>{}</div>", "<div><div id=story>{}</div></div>"])
@pytest.mark.parametrize("seed", range(4))
def test_article_without_surroundings(holder, seed):
    rng = random.Random(seed)
    before, after = rng.sample(AROUND, 5), rng.sample(AROUND, 5)
    page = f"<!DOCTYPE html><html><head><title>Of the page</title></head><body>{''.join(before)}{holder.format(ARTICLE)}{''.join(after)}</body></html>"
    assert " ".join(b.text for b, content in html.label_page(page) if content) == TEXT


def test_advert_inside_the_article():
    page = f"<article>{ARTICLE}<div class=ad>Buy it, buy it now.</div><p>And the end of the text comes here.</p></article>"
    assert " ".join(b.text for b, c in html.label_page(page) if c) == TEXT + " And the end of the text comes here."


@pytest.mark.parametrize("seed", range(25))
def test_cut_is_the_cheapest(seed):
    rng = random.Random(seed)
    count = rng.randint(1, 11)
    scores = [rng.choice([-3, -1.5, -0.4, 0, 0.3, 1.1, 2.5]) + rng.random() / 7 for _ in range(count)]
    ties = [(i, i + 1, rng.random() * 2) for i in range(count - 1)] + [tuple(sorted(rng.sample(range(count), 2))) + (rng.random(),) for _ in range(count if count > 1 else 0)]
    cost = lambda labels: sum(abs(s) for s, c in zip(scores, labels) if c != (s > 0)) + sum(w for a, b, w in ties if labels[a] != labels[b])
    least = min(cost(labels) for labels in itertools.product([False, True], repeat=count))
    assert cost(html.cheapest_labels(scores, ties)) == pytest.approx(least)


def test_blocks_keep_every_character():
    page = "a<b>b</b>&lt;c&gt;&nbsp;&#233;&eacute;&bogus; < d<p>e<p>f<br>g</div></p>h<td>i<script>x</script>j<a href=\"p>q\">k"
    assert [b.text for b in html.blocks_of(page)] == ["ab<c> éé&bogus; < d", "e", "f g", "h", "ij k".replace(" ", "")]


def test_pages_table(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (3, "u", "<nav>only a menu</nav>", "x"), (4, "u", f"<article>{ARTICLE}</article>", "x"), (4, "u", f"<article>{ARTICLE}</article>", "x"),
            (5, "u", "<article>" + "<p>" * 3000 + ARTICLE + "</div>" * 5, "x"), (None, "u", "<article><p>Text of a page, unclosed", "x"), (6, "u", "<article><p>" + "word " * 200_000 + "</p>", "x"),
            (7, "u", "<p" * 2000 + '<a href="' * 500, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(2)
    got = html.extract_text(df)
    assert got.columns == ["page_id", "url", "text", "n_chars", "n_blocks"]
    found = {}
    for r in got.collect():
        assert r.n_chars == len(r.text) and found.setdefault(r.page_id, r.text) == r.text
    assert len(got.collect()) == 9
    assert (found[1], found[2], found[3], found[4], found[5], found[None]) == ("", "", "", TEXT, TEXT, "Text of a page, unclosed")
    assert len(found[6].split()) == 200_000
    assert html.extract_text(df.limit(0)).collect() == []
    blocks = html.label_blocks(df.filter("page_id = 4")).collect()
    assert len(blocks) == 8 and all(b.content for b in blocks)


def content_of(page):
    return " ".join(b.text for b, content in html.label_page(page) if content)


@pytest.mark.parametrize("holder", [
    "<article class='post no-sidebar'>{}</article>", "<main class='with-sidebar'>{}</main>", "<div id='content' class='has-comments'>{}</div>", "<form id=page><main>{}</main></form>",
    "<article class='search'>{}</article>",
])
def test_names_of_the_layout_do_not_rule_out_the_article(holder):
    assert content_of("<nav><a href=x>Home</a></nav>" + holder.format(ARTICLE) + "<footer><p>All rights reserved by the owners.</p></footer>") == TEXT


def test_length_outweighs_a_name():
    long = "This part of the text is long and made of whole sentences. " * 12
    for name in ("warning", "search", "related", "sidebar"):
        assert content_of(f"<article>{ARTICLE}<section class={name}><p>{long}</p></section></article>") == f"{TEXT} {long.strip()}"
    assert content_of(f"<div class=sidebar><article>{f'<p>{long}</p>' * 3}</article></div>") == " ".join([long.strip()] * 3)
    assert content_of(f"<article>{ARTICLE}</article><div hidden><p>{long}</p></div>") == TEXT


def test_elements_whose_text_is_shown():
    page = "<article><p>The sum is <math><mi>a</mi><mo>+</mo><mi>b</mi></math>, as the picture <canvas>of it</canvas> shows.</p><video src=x><p>And this is the rest of the text, after it.</p></article>"
    assert content_of(page) == "The sum is a+b, as the picture of it shows. And this is the rest of the text, after it."
