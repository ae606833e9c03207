"""Main text of pages: link blocks within articles, linked prose outside of them, and sites of unlike make."""

import random
from collections import Counter, defaultdict

import pytest

from pagewright.llm import op4_html_extraction as op4

P = "A long paragraph of prose that tells about the old harbour and about the people who have worked there since it was built."
Q = "Another paragraph follows with many words about the ships that came and went through all the years until the war."
CASES = [
 (f'<article><p>{P}</p><nav><a href=1>Next article</a> <a href=2>Previous article</a></nav><p>{Q}</p></article>', f"{P} {Q}"),
 (f'<article><p>{P}</p><ul class="related"><li><a href=1>The other harbour</a></li><li><a href=2>Ships of old</a></li></ul></article>', P),
 (f'<main><p>{P}</p><div class="share"><a href=1>Share</a> <a href=2>Tweet</a></div><p>{Q}</p></main>', f"{P} {Q}"),
 (f'<article><p>{P}</p><footer><a href=1>Imprint</a> <a href=2>Contact</a></footer></article>', P),
 (f'<article><p>{P}</p><aside><p>Buy now the <a href=2>best boots in town</a> for a low price.</p></aside><p>{Q}</p></article>', f"{P} {Q}"),
 (f'<article><p>{P}</p></article><div class="comments"><p>I think <a href=1>this is a better page</a> about it, read it when you can.</p></div>', P),
 (f'<article><p>{P}</p><div id=comments><p>I think <a href=1>this is a better page</a> about it, read it when you can.</p></div></article>', P),
 (f'<p>{P}</p><p>Those who want to know more can read <a href=1>the history of harbours</a> by a writer who knew them all, in print.</p><p>{Q}</p>', f"{P} Those who want to know more can read the history of harbours by a writer who knew them all, in print. {Q}"),
 ('<p>Those who want to know more can read <a href=1>the history of harbours</a> by a writer who knew them all, in print.</p>', "Those who want to know more can read the history of harbours by a writer who knew them all, in print."),
 (f'<article><p>{P}</p><p class="advert">Buy these fine boots today and get a second pair at half the price of the first.</p><p>{Q}</p></article>', f"{P} {Q}"),
 (f'<article><p>{P}<p class="advert">Buy these fine boots today and get a second pair at half the price of the first.<p>{Q}</article>', f"{P} {Q}"),
 (f'<article><p>{P}</p><ul><li>One</li><li class="share">Share it with your friends</li><li>Two</li></ul></article>', f"{P} One Two"),
 (f'<article><p>{P} <span class="ad">Buy <span>boots</span> now</span> and on.</p></article>', f"{P} and on."),
 (f'<article><p>{P} <a href=1>See the map</a></p><p><a href=2>Sources of this</a></p></article>', f"{P} See the map Sources of this"),
 (f'<div><p><a href=1>Home</a> <a href=2>Shop</a></p></div><div><p>{P}</p><p>{Q} See <a href=3>the map of the harbour</a>.</p></div><div><a href=4>Terms of use</a> and more</div>', f"{P} {Q} See the map of the harbour."),
]


@pytest.mark.parametrize(("page", "text"), CASES)
def test_what_speaks_against_a_block_counts_before_its_links(page, text):
    assert op4.main_text(page) == text


def sentence(r, n):
    return " ".join("".join(r.choice("aeioulmnrst") for _ in range(r.randint(2, 9))) for _ in range(n)).capitalize() + "."


def paragraphs(r):
    """(html, text) of prose: long and short paragraphs, some with links or marks within, one that is all link."""
    out = []
    for i in range(r.randint(3, 8)):
        words = sentence(r, r.choice([3, 12, 25, 40]))
        kind, w = r.random(), words.split()
        if kind < 0.3 and len(w) > 10:
            at = r.randrange(len(w) - 4)
            out.append((" ".join(w[:at]) + f' <a href="/{i}">' + " ".join(w[at : at + 3]) + "</a> " + " ".join(w[at + 3 :]), words))
        elif kind < 0.5:
            out.append((f"<em>{w[0]}</em> " + " ".join(w[1:]), words))
        else:
            out.append((words, words))
    return out


def links(r, n):
    return [f'<a href="/{i}">{sentence(r, r.randint(1, 3))}</a>' for i in range(n)]


def blog(r, ps):
    body = "".join(f"<p>{h}</p>" for h, _ in ps)
    return f"<body><header class=masthead>{' '.join(links(r, 3))}</header><article class='h-entry'><h1>{{}}</h1>{body}<div class='share-buttons'>{' '.join(links(r, 2))}</div></article><section id=respond><p>{sentence(r, 20)}</p></section><footer>{sentence(r, 6)}</footer></body>"


def magazine(r, ps):
    half = len(ps) // 2
    aside = f"<aside class=promo><p>{sentence(r, 15)} {links(r, 1)[0]}</p></aside>"
    body = "".join(f"<p class=lead>{h}" for h, _ in ps[:half]) + aside + "".join(f"<p>{h}" for h, _ in ps[half:])
    return f"<div id=topnav><ul>{''.join(f'<li>{x}' for x in links(r, 5))}</ul></div><main role=main><h1>{{}}</h1>{body}<ul class=relatedLinks>{''.join(f'<li>{x}' for x in links(r, 4))}</ul></main><div class=sidebar><p>{sentence(r, 18)}</p></div>"


def wiki(r, ps):
    body = "".join(f"<p>{h}</p>" for h, _ in ps)
    return f"<table class=navbox><tr>{''.join(f'<td>{x}' for x in links(r, 4))}</table><div id=mw-content-text><div class=content><h1>{{}}</h1>{body}</div></div><div id=footer><p>{sentence(r, 9)} {links(r, 1)[0]}</p></div>"


def shop(r, ps):
    body = "".join(f"<div class=text>{h}</div>" for h, _ in ps)
    return f"<div class=breadcrumb>{' '.join(links(r, 3))}</div><div role=dialog><p>{sentence(r, 22)}</p><button>ok</button></div><section class=story><h2>{{}}</h2>{body}<form><label>{sentence(r, 3)}</label></form></section><div class='recommended'>{''.join(f'<p>{x}</p>' for x in links(r, 4))}</div>"


def plain(r, ps):
    body = "".join(f"<p>{h}</p>" for h, _ in ps)
    return f"<p>{' '.join(links(r, 6))}</p><h1>{{}}</h1>{body}<p>{' '.join(links(r, 3))}</p>"


def test_sites_of_unlike_make():
    """F1 by words, for each kind of site: full where elements tell, high where nothing does."""
    r, scores = random.Random(12), defaultdict(list)
    for make in (blog, magazine, wiki, shop, plain):
        for _ in range(40):
            ps, title = paragraphs(r), sentence(r, 5)
            got = Counter(op4.main_text(make(r, ps).replace("{}", title)).split())
            want = Counter(" ".join([title, *(t for _, t in ps)]).split())
            scores[make.__name__].append(2 * (got & want).total() / (got.total() + want.total()))
    mean = {k: round(sum(v) / len(v), 3) for k, v in scores.items()}
    assert all(mean[k] >= 0.99 for k in ("blog", "magazine", "wiki", "shop")) and mean["plain"] >= 0.9, mean


def test_end_tags_that_are_left_out():
    text = "The first of the paragraphs has some words in it. The second has more words than that."
    a, b = text.split(". ")[0] + ".", text.split(". ")[1]
    assert op4.main_text(f"<article><p class=ad>Buy it now at half the price of yesterday<p>{a}<p>{b}</article>") == text
    assert op4.main_text(f"<article><ul><li class=share>Share it with all your friends at once<li>{a}<li>{b}</ul></article>") == text
    assert op4.main_text(f"<article><table><tr><td class=advert>Buy it now at half the price<td>{a}<tr><td>{b}</table></article>") == text
    assert op4.main_text(f"<article><p>{a}</p></p></span></a><p>{b}</p></div></article>") == text
    assert op4.main_text(f"<article><p>{a} <b class=ad>Buy <b>it</b> now</b></p><p hidden>Nobody sees this text at all</p><p>{b}</p></article>") == text
