"""Main text by mass and templates, against pages whose blocks are known as they are made."""

import random
from collections import defaultdict

import pytest

from tessella.llm import html_text

A = "This is the first sentence of it. And a second one follows here. A third one is also there. The fourth ends it."
B = "The other half of the story is told in a section of its own, which is as long as the first one and even longer."


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f"<main><h1>Title</h1><article>{A}</article></main>", f"Title {A}"),
        (f"<main><article>{A}</article><section>{B}</section></main>", f"{A} {B}"),
        (f'<form id="aspnetForm"><div>{A}</div></form>', A),
        (f'<article class="post social">{A}</article>', A),
        (f'<article class="banner">{A}</article>', A),
        (f'<div class="story-notice">{A}</div>', A),
        (f'<div>{A}</div><div id="disqus_thread">{B}</div>', A),
        (f'<div>{A}</div><div class="comment-thread">{B}</div>', A),
        (f'<div>{A}</div><div class="fb-comments">{B}{B}{B}</div>', A),
        (f'<div>{A}</div><div class="google-ad">buy</div><p class="ad-300x250">buy</p><p class="share-this">share</p>', A),
        (f"<article>Short.</article><section><h2>Comments</h2>{A}{B}</section>", "Short."),
        (f"<div>{A}</div><section><h3>3 Kommentare</h3>{B}{B}</section>", A),
        (f"<h1>T</h1><article>{A}</article><div>other</div>", f"T {A}"),
        (f"<article>Short.</article><nav>{A}</nav><aside>{B}</aside>", "Short."),
        (f'<header class="site-header">S</header><article><header><h1>T</h1></header>{A}</article><footer>f</footer>', f"T {A}"),
        ('<div class="comments">only</div>', ""),
    ],
)
def test_text_mass_decides(html, text):
    assert html_text.main_text(html) == text


def test_templates_by_construction(spark):
    """Blocks of several hosts, with and without telling names, are dealt to pages with articles of their own or shared ones; those
    that stand beside five articles or more go, and no others. The expected counts are made with the pages, without a parser."""
    rng = random.Random(12)
    blocks = {"notice one of the site": '<div class="x1">{}</div>', "links of the week": "<ul><li>{}</li></ul>", "named menu": "<nav>{}</nav>", "rare hint": "<section>{}</section>", "signed note": '<div class="newsletter">{}</div>'}
    rows, beside, made = [], defaultdict(set), {}
    for k in range(60):
        host = f"h{k % 4}.org"
        article = f"Article number {k if k % 3 else k // 6} of this host says something " + "long enough " * 20
        own = [b for b in blocks if rng.random() < (0.08 if b == "rare hint" else 0.5)]
        rows.append((k, f"http://{host}/{k}", "".join(blocks[b].format(b) for b in own) + f"<article><p>{article}</p></article>"))
        made[k] = (host, own, article.strip())
        for b in own:
            beside[host, b].add(article)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    many = {key for key, articles in beside.items() if len(articles) >= 5}
    assert html_text.template_keys(pages).count() == len(many) and 0 < len(many) < len(beside)
    # The same blocks where no article element and no name tells them apart.
    plain = spark.createDataFrame([(i, u, h.replace("article>", "div>").replace("nav>", "div>").replace(' class="newsletter"', "")) for i, u, h in rows], "page_id long, url string, html string")
    for r in html_text.extract_text(plain).collect():
        host, own, article = made[r["page_id"]]
        assert r["text"] == " ".join([b for b in own if (host, b) not in many] + [article])
    twice = html_text.extract_text(pages.unionByName(pages)).collect()
    assert len(twice) == 120 and all(made[r["page_id"]][2] in r["text"] for r in twice)
