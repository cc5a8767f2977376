"""Layouts of pages whose articles must come out whole."""

import random
import time

import pytest

from loomline.llm import html_extract
from loomline.llm.html_extract import main_text

LONG = "A long paragraph of the article, with commas, and with more than enough text to be judged as such, " * 3
LAYOUTS = {
    "short divs in an article": ("<nav><a href=#>Home</a></nav><article><div>One.</div><div>Two.</div><div>短い段落。</div></article>", "One.\nTwo.\n短い段落。"),
    "short list items": ("<body><div><ul><li>Milk</li><li>Eggs</li></ul></div></body>", "Milk\nEggs"),
    "short article beside a paragraph": ("<article><div>One.</div><div>Two.</div></article><div><p>So.</p></div>", "One.\nTwo."),
    "main before a heavier box": (f"<main><div>Short.</div></main><div><p>{LONG}</p></div>", "Short."),
    "header class in an article": (f'<article><header class="entry-header"><h1>Title</h1></header><h2 class="section-header">Part</h2><p>{LONG}</p></article>', f"Title\nPart\n{LONG.strip()}"),
    "header in a main": (f"<main><header><h1>Title</h1></header><p>{LONG}</p></main>", f"Title\n{LONG.strip()}"),
    "heading class without an article": (f'<div class="post"><h2 class="section-header">Part</h2><p>{LONG}</p></div>', f"Part\n{LONG.strip()}"),
    "notice and related text": (f'<article><p>{LONG}</p><div class="notice">Mind the gap.</div><section class="related-work">Others did so too.</section></article>', f"{LONG.strip()}\nMind the gap.\nOthers did so too."),
    "related links": (f'<article><p>{LONG}</p><div class="related"><a href=#>More of this</a></div></article>', LONG.strip()),
    "last short section": (f'<body><div class="wrap"><div class="section"><p>{LONG}</p><p>{LONG}</p></div><div class="section"><p>The end.</p></div></div></body>', f"{LONG.strip()}\n{LONG.strip()}\nThe end."),
    "short block between sections": (f'<body><div class="a"><p>{LONG}</p><p>{LONG}</p></div><div class="b">Then.</div><div class="c"><p>{LONG}</p></div></body>', f"{LONG.strip()}\n{LONG.strip()}\nThen.\n{LONG.strip()}"),
    "menu, advert and comments": (f'<div class="menu">Menu</div><article><p>{LONG}</p><div class="ad">Buy, buy, buy.</div><div class="comments"><p>No, said one.</p></div></article>', LONG.strip()),
    "links only": ("<div><a href=#>Home</a></div>", ""),
    "formulas": (f"<article><p>{LONG}</p><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds.</p></article>", f"{LONG.strip()}\nSo x=2 holds."),
    "names that only end in hidden": (f'<article><p data-hidden="no">{LONG}</p><p hidden>Gone.</p><p HIDDEN="">Gone.</p><p class="hidden-gem">Kept.</p></article>', f"{LONG.strip()}\nKept."),
    "doubtful names in an article": (f'<article><p>{LONG}</p><div class="widget-review">A fine tool.</div><section id="social-history">Then came unions.</section><div class="social"><a href=#>Share</a></div></article>', f"{LONG.strip()}\nA fine tool.\nThen came unions."),
    "two articles": (f'<body><article class="part"><p>{LONG * 4}</p></article><article class="part"><p>{LONG}</p></article><article class="card"><p>More.</p></article></body>', f"{(LONG * 4).strip()}\n{LONG.strip()}"),
    "teaser beside the text": (f"<div><p>{LONG}</p></div><article><p>More.</p></article>", LONG.strip()),
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_layout(layout):
    page, text = LAYOUTS[layout]
    assert main_text(page) == text


def test_starts_of_tags_without_end_read_alike(monkeypatch):
    """What is known of failed starts decides as trying each of them does."""
    dealt = random.Random(4)
    pages = ["".join(dealt.choices(["<a ", "<p", "</b", '"', "'", ">", "x ", "<!", " y=", "<1", "/"], weights=[6, 4, 2, 4, 4, 1, 4, 1, 2, 1, 1], k=dealt.randrange(1, 40))) for _ in range(4000)]
    got = [html_extract.blocks_of(x) for x in pages]
    monkeypatch.setattr(html_extract.Unended, "fails", lambda self, at: False)
    shape = lambda x: ([(n.tag, n.attributes) for n in x[0]], [(o.number, t, k) for o, t, k in x[1]])
    assert list(map(shape, got)) == [shape(html_extract.blocks_of(x)) for x in pages]


@pytest.mark.parametrize("part", ["<div>x ", '<a "x ', "<b><div><i><i>y</b>", "<!a ", "<a b ", "<p 'x\" ", "x<", "<li>z<div>", "</b><i>", "<a<"])
def test_broken_pages_of_a_megabyte(part):
    begun = time.perf_counter()
    main_text(part * (1_000_000 // len(part)))
    assert time.perf_counter() - begun < 20
