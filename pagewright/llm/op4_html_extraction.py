"""Main text of web pages from flat text blocks and a decision tree.

A page is cut into blocks of text at block-level tags. A block is described by
its word count and link density, those of the blocks before and after it, and
whether it stands below an element whose tag, class, id or role speaks for or
against content; terms that articles use too count only outside of them. A
decision tree, fitted to the labelled pages in `LABELLED`, of which many have no
telling tags or classes, decides. Classes, ids and roles are read on every element;
an inline element that speaks against content is a block of its own.

Pages are read in one pass whose time is linear in their length, whatever is
left open in them.

Defined results: a null or empty page has no text; broken markup is read as far
as it goes (an unclosed comment, script or style hides the rest, as browsers
do; a quote that never closes is an ordinary character; a tag that never ends
hides the rest); rows with null or repeated ids are extracted row by row; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import collections
import functools
import html
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .blocks import typed

NAME = "op4_html_extraction"

_HIDDEN = ("script", "style", "noscript", "template", "head", "svg", "iframe", "object", "select", "textarea", "button", "canvas")
_RAW = frozenset("script style noscript template svg iframe object canvas textarea title".split())
_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_STOP = re.compile("[>\"']")
_ATTR = re.compile(r"(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
_HOLDERS = frozenset("nav header footer aside form article main section div ul ol dl table figure details dialog fieldset head select button body menu blockquote a".split())
#: Elements whose end tag may be left out, and which of those that are open last a start tag ends.
_LOOSE = frozenset("p li dt dd tr td th thead tbody tfoot h1 h2 h3 h4 h5 h6".split())
_ENDS = {"li": frozenset(("li", "p")), "dt": frozenset(("dt", "dd", "p")), "dd": frozenset(("dt", "dd", "p")), "td": frozenset(("td", "th", "p")), "th": frozenset(("td", "th", "p")), "tr": frozenset(("td", "th", "tr", "p"))}
_ENDS |= dict.fromkeys(("thead", "tbody", "tfoot"), frozenset(("td", "th", "tr", "thead", "tbody", "tfoot", "p")))
_PARAGRAPH = frozenset(("p",))
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_AGAINST_TAGS = frozenset("nav footer aside form head select button dialog menu fieldset".split())
_FOR_TAGS = frozenset(("article", "main"))
_AGAINST = frozenset(
    "ad ads advert adverts advertisement advertising advertorial sponsor sponsored promo cookie cookies cookiebar consent gdpr popup modal overlay nav navbar navigation sidenav menu "
    "breadcrumb breadcrumbs sidebar aside masthead topbar comment comments respond disqus related recommended share sharing social newsletter subscribe signup login "
    "pagination pager skip copyright contentinfo teaser trending paywall toast dialog alertdialog".split()
)
#: These name parts of articles as well as what surrounds them.
_AGAINST_OUTSIDE = frozenset("banner notice notices alert notification footer header reply replies discussion search widget widgets legal disclaimer toolbar tags complementary form popular subscription promotion feedback".split())
_FOR = frozenset("article content post entry story main text body".split())
_HEADING = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


@dataclass
class Block:
    text: str
    words: int
    linked: int
    against: bool
    inside: bool
    heading: bool


def tokens(page: str):
    """(text from, text to, tag, attributes, whether it is an end tag) for each piece of markup, which ends where the next text begins; tag is empty for what is skipped."""
    at = 0  # where text begins
    look = 0  # where the next "<" is looked for
    dead = set()  # quotes of which no further one comes
    plain = False  # a tag ran to the end of the page within quotes: from there on quotes are ordinary characters
    size = len(page)
    while (lt := page.find("<", look)) >= 0:
        c = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            yield at, lt, "", "", False
            at = look = size if end < 0 else end + 3
            continue
        ends = c == "/"
        name = _NAME.match(page, lt + 1 + ends)
        if name is None:
            if c and c in "!?/":
                end = page.find(">", lt)
                yield at, lt, "", "", False
                at = look = size if end < 0 else end + 1
            else:
                look = lt + 1
            continue
        tag, pos, end = name[0].lower(), name.end(), -1
        while not plain and (stop := _STOP.search(page, pos)):
            q = stop[0]
            if q == ">":
                end = stop.start()
                break
            pos = stop.end()
            if q not in dead:
                close = page.find(q, pos)
                if close < 0:
                    dead.add(q)
                else:
                    pos = close + 1
        if end < 0:
            plain = True
            end = page.find(">", name.end())
        yield at, lt, tag if end >= 0 else "", page[name.end() : end] if end >= 0 else "", ends
        at = look = size if end < 0 else end + 1
        if tag in _RAW and not ends and not page[name.end() : end].endswith("/"):
            close = _closing(tag).search(page, at)
            at = look = size if close is None else close.end()
    yield at, size, "", "", False


@functools.cache
def _closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\s*>", re.I)


def blocks(page: str) -> list[Block]:
    """Text blocks in page order, each with its white space turned into single spaces."""
    out: list[Block] = []
    open_: list[tuple[str, bool, bool]] = []  # tag, against, for; both inherited
    count: collections.Counter[str] = collections.Counter()  # open elements of each tag
    hidden = 0  # open elements whose text is not shown
    link = -1  # how many elements were open when the open link began
    parts: list[tuple[str, bool]] = []
    heading = ""

    def close() -> None:
        if not parts:
            return
        text = " ".join("".join(t for t, _ in parts).split())
        if text:
            linked = sum(len(t.split()) for t, is_link in parts if is_link)
            _, against, inside = open_[-1] if open_ else ("", False, False)
            words = len(text.split())
            out.append(Block(text, words, min(words, linked), against, inside, bool(heading)))
        parts.clear()

    def leave() -> str:
        nonlocal hidden
        gone = open_.pop()[0]
        count[gone] -= 1
        hidden -= gone in _HIDDEN
        return gone

    for start, end, tag, attrs, ends in tokens(page):
        if end > start and not hidden:
            parts.append((html.unescape(page[start:end]), link >= 0))
        if not tag:
            continue
        if tag == "a":
            link = -1 if ends else len(open_)
        inline = tag in _INLINE
        if not inline:
            close()
            if tag in _HEADING:
                heading = "" if ends else tag
        if ends:
            if count[tag]:
                if inline:
                    close()
                while count[tag]:
                    gone = leave()
                    if gone == tag:
                        break
                if link > len(open_):
                    link = -1
            continue
        if not inline:
            ended = _ENDS.get(tag, _PARAGRAPH)
            while open_ and open_[-1][0] in ended:
                leave()
        if tag in _VOID or attrs.rstrip().endswith("/"):
            continue
        _, against, inside = open_[-1] if open_ else ("", False, False)
        a, f = _speaks(tag, attrs, inside)
        if inline:
            # one that speaks against content is a block of its own; further ones of its name are told from it by counting
            if not (a or count[tag]):
                continue
            if a:
                close()
            f = False
        elif tag not in _HOLDERS and tag not in _LOOSE:
            continue
        open_.append((tag, against or a, inside or f))
        count[tag] += 1
        hidden += tag in _HIDDEN
    close()
    return out


def _speaks(tag: str, attrs: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element speaks against content, and for it."""
    against = tag in _AGAINST_TAGS or tag == "header" and not inside
    for_ = tag in _FOR_TAGS
    if attrs:
        for name, *values in _ATTR.findall(attrs):
            value = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", "".join(values)).lower()
            name = name.lower()
            if name == "style":
                against |= "display:none" in value.replace(" ", "")
            elif name in ("hidden", "aria-hidden"):
                against |= value != "false"
            else:
                terms = set(re.split(r"[^a-z]+", value))
                bad = bool(terms & _AGAINST or not inside and terms & _AGAINST_OUTSIDE) and tag not in ("article", "main", "body")
                against |= bad
                for_ |= not bad and bool(terms & _FOR) and tag != "body"
    return against, for_


def features(found: list[Block]) -> np.ndarray:
    """Per block: words and link density of itself, the one before and the one after; against, inside, heading."""
    own = np.array([(b.words, b.linked / max(1, b.words)) for b in found], float).reshape(-1, 2)
    edge = np.zeros((1, 2))
    before, after = np.concatenate((edge, own[:-1])), np.concatenate((own[1:], edge))
    kind = np.array([(b.against, b.inside, b.heading) for b in found], float).reshape(-1, 3)
    return np.concatenate((own, before[: len(own)], after[: len(own)], kind), axis=1)


def fit_tree(x: np.ndarray, y: np.ndarray, depth: int = 7, least: int = 3):
    """A binary tree (feature, threshold, left, right) or the label of a leaf of at least so many blocks, split by Gini impurity."""
    share = y.mean()
    if depth == 0 or share in (0.0, 1.0):
        return bool(share >= 0.5)
    best = (share * (1 - share) * len(y) - 1e-9, None, None)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, f] < cut
            if not least <= low.sum() <= len(y) - least:
                continue
            p, q = y[low].mean(), y[~low].mean()
            impurity = p * (1 - p) * low.sum() + q * (1 - q) * (~low).sum()
            if impurity < best[0] - 1e-12:
                best = (impurity, f, cut)
    _, f, cut = best
    if f is None:
        return bool(share >= 0.5)
    low = x[:, f] < cut
    return f, cut, fit_tree(x[low], y[low], depth - 1, least), fit_tree(x[~low], y[~low], depth - 1, least)


def apply_tree(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, bool):
        return np.full(len(x), tree)
    f, cut, left, right = tree
    low = x[:, f] < cut
    out = np.empty(len(x), bool)
    out[low], out[~low] = apply_tree(left, x[low]), apply_tree(right, x[~low])
    return out


#: The labelled table: pages whose blocks begin with + (main text) or - (the rest).
LABELLED = (
    """<body><nav><ul><li><a href=/a>-Home</a></li><li><a href=/b>-World news</a></li><li><a href=/c>-Sport</a></li></ul></nav><div class="ad">-Buy one and get the second at half the price today only.</div>
<article><h1>+A storm on the northern coast</h1><p>+The storm reached the coast in the early hours and tore the roofs from several houses near the harbour, the mayor said.</p><p>+No one was hurt.</p><p>+Repairs begin.</p>
<p>+More in <a href=/d>the report of the weather service</a>.</p><p><a href=/f>+Pictures of the damage</a></p><ul><li>+Boats stay in port</li><li>+Schools are closed</li></ul></article><aside>-Most read this week and other stories that you may like</aside><footer>-All rights reserved. <a href=/e>Imprint</a></footer></body>""",
    """<body><header><a href=/>-The Daily Paper</a><p>-News from all the world since the year of the great fire</p></header><div id="cookie-notice"><p>-We use cookies to make this site better for you and for our partners. <a href=/p>Learn more</a></p></div>
<main><h2>+Bread without kneading</h2><p>+Mix flour, water, salt and a little yeast the evening before and leave the bowl covered on the table.</p><p>+Wait.</p><p>+Bake it in a very hot oven for forty minutes until the crust is dark.</p></main>
<section class="comments"><h3>-Three comments</h3><p>-I tried this yesterday with whole meal flour and it came out far better than all that I had made before.</p><p>-Thanks!</p></section><form><p>-Your name</p><p>-Write a comment of your own about this recipe here</p></form></body>""",
    """<body><div class="menu"><a href=/1>-Start</a> <a href=/2>-Products</a></div><div class="content"><h1>+Valves</h1><p>+Open.</p><p>+Shut.</p><p>+A spring holds the disc on its seat until the pressure below is larger than the force of the spring.</p><div>+Then it opens.</div><p>+It closes again once the pressure has fallen.</p></div>
<div class="sidebar"><p>-Our newsletter tells you each month what is new in valves and in pumps.</p></div><div class="footer"><p>-Copyright of the valve works, all rights reserved in all countries</p></div></body>""",
    """<body><p><a href=/1>-One</a> <a href=/2>-Two</a> <a href=/3>-Three</a></p><p>+There was once a miller who had three sons, and when he died he left them his mill, his donkey and his cat.</p><p>+The eldest took the mill, the second the donkey, and nothing but the cat was left for the youngest son.</p><p>+He was sad, for what could he do with a cat, and so he sat down at the side of the road and thought about it.</p><p><a href=/4>-Next page</a></p><p>-Contact us</p></body>""",
    """<body><table><tr><td><a href=/1>-Index</a></td><td><a href=/2>-Archive</a></td></tr></table><div><div>+The council voted last night on the new bridge after a debate of five hours in a full hall.</div><div>+Supporters said that the old bridge cannot carry the lorries that cross it every day of the week.</div></div><div><a href=/5>-Read also: the history of the old bridge and its builders</a></div><div>-Page 1 of 2</div></body>""",
    """<body><nav><a href=/1>-All recipes</a></nav><article><h1>+Soup of beans</h1><p>+Soak the beans over night and boil them with an onion until they are soft.</p><ul><li>+Salt</li><li>+Beans</li><li>+Oil</li></ul><p>+Serve it hot.</p></article></body>""",
    """<body><main><p>+The lake froze in the first week of the year and stayed frozen until the end of March.</p><p>+Then it thawed</p></main></body>""",
    """<body><div class="entry"><h2>+Old maps</h2><p>+Maps of the time show the river where the market is today.</p><p>+It was moved.</p><p><a href=/3>+See the map of the whole valley</a></p><p><a href=/4>+Sources</a></p></div></body>""",
    """<div><a href=/1>-Front page</a></div><div><a href=/2>-All letters of the month</a></div><div>-Wednesday edition</div><div><a href=/3>-Weather</a></div><div>+The grain of that summer stood high, and those who had doubted the new seed were the first to ask for it in autumn.</div><div>+Nobody remembered why.</div><div>+In the year after, the seed was sold in every market of the province, at a price that only the larger farms could pay.</div><div>+So it went.</div><div>+The smaller ones went back to what their parents had sown and kept a part of each harvest for the next spring.</div><div><a href=/4>-Older letters</a></div><div>-Printed in the old town</div><div><a href=/5>-Terms of use</a></div>""",
    """<table><tr><td><a href=/a>-Shop</a></td><td>-Your basket is empty</td><td><a href=/b>-Sign in</a></td></tr></table><p>+The kettle has a base of copper and a handle of beech, and it boils a litre of water in less than three minutes on gas.</p><p>+It whistles.</p><p>+The lid stays cool because the steam leaves at the side, through a spout that was drawn from one piece of metal.</p><p><a href=/c>-Add to basket</a></p><p>-Free delivery within the country</p><p><a href=/d>-Other kettles that people looked at</a></p>""",
    """<p><a href=/1>-Home</a> <a href=/2>-Letters</a></p><p>-We keep a small file on your machine so that the page knows you when you come back, and so do those who pay for this page.</p><p><a href=/3>-Accept all of them</a></p><p>+My grandfather dug the well in the dry year, by hand and alone, and he struck water at the depth of eleven men.</p><p>+It never failed.</p><p>+When the pipes came to the village he kept the bucket on its rope, for the water from the pipes tasted of iron, he said.</p><p>+He was right about that.</p><p><a href=/4>-More from this writer</a></p><p>-Letters may be shortened</p><p><a href=/5>-Write to us</a></p>""",
    """<div><a href=/1>-News</a></div><div><a href=/2>-Travel</a></div><div>-Tuesday</div><div><a href=/3>-Log in</a></div><div>+Night ferry</div><div>+The boat leaves at ten from the northern quay and is on the other shore at six, if the wind does not turn in the night.</div><div>+Take a blanket.</div><div>+The cabins are warm but the deck is where the stars are, and in August there are more of them than anyone can count.</div><div><a href=/4>-Book a cabin now</a></div><div><a href=/5>-Other ferries</a></div><div>-Prices include tax</div><div><a href=/6>-Imprint</a></div>""",
    """<p><a href=/1>-Science</a></p><p><a href=/2>-Subjects</a></p><p>-Reading time four minutes</p><p><a href=/3>-Save for later</a></p><p>+Glaciers move by sliding on their beds and by the slow flow of the ice itself, which under its own weight behaves like thick honey.</p><p>+How fast? A metre a day.</p><p>+Where the bed is wet the ice slides faster, and after warm nights the instruments on the surface show a jump of several hand widths.</p><p>+Then it rests again.</p><p>+Measurements over a hundred years show that the rests have become shorter in all valleys that look to the south.</p><p><a href=/4>-Related: how ice is drilled</a></p><p>-No comments yet</p><p><a href=/5>-Be the first</a></p>""",
    """<p>+The old road ran along the ridge, and whoever took it saw both seas on a clear day and heard neither.</p><p>+It is gone now.</p><p>+Where it was the firs stand in rows, and between them lie the milestones that nobody had the strength to carry off.</p><p>+Count them.</p>""",
    """<article><h1>+Treaties</h1><div class="legal-text"><p>+The parties shall settle every dispute that arises from this treaty by talks, and if talks fail by a court of three judges.</p></div><div class="discussion"><p>+Historians have discussed for decades whether the second article was meant to bind the heirs of those who signed it.</p></div><p>+It did.</p><div class="ad-slot"><p>-Learn a language in thirty days with the course that experts do not want you to know.</p></div><div class="comments"><p>-The second article was never in force, as everybody who has read the archive knows very well.</p></div></article>""",
    """<body><p>-Menu</p><p>+The train left at six in the morning and reached the border by noon, where it stood for two hours in the sun.</p><p>+Nobody was let off until the papers had been stamped, and by then the last connection south was gone for the day.</p></body>""",
    """<body><p><a href=/1>-Ten things that you did not know about the oldest bridge of the whole country and the many people who built it</a></p><p>+The first bridge was made of oak and stood for a hundred years until the ice of a hard winter took away its piers.</p><p>+The second was built of stone by masons who came from the other side of the mountains and stayed for good.</p><p><a href=/2>-Everything about the new tunnel below the river and the long dispute about what it may cost and who is to pay</a></p></body>""",
    """<body><article class="post"><header><h1>+Letters from the island</h1></header><p>+Rain.</p><p>+Wind.</p><p>+Fog.</p><p>+On the second day the ferry did not come, and we walked along the cliffs to the lighthouse and back.</p><blockquote>+Nobody leaves in winter, the keeper said.</blockquote><div class="share">-Share this with friends</div><div class="related"><p>-Letters from the mountain, a series of ten parts by the same writer</p></div><footer>-Filed under travel by the editors of the magazine</footer></article></body>""",
    # link blocks within articles
    """<article><h1>+Bees in winter</h1><p>+A colony does not sleep through the cold months but forms a ball and keeps the queen warm in the middle of it.</p><nav><a href=/1>-Older entry</a> <a href=/2>-Newer entry</a></nav><p>+The honey that they eat has to last until the willows bloom.</p><p>+Read <a href=/3>what a beekeeper does in March</a> before you open a hive.</p><ul class="related"><li><a href=/4>-Hives made of straw</a></li><li><a href=/5>-Wax and its uses</a></li></ul><div class="share"><a href=/6>-Send to a friend</a> <a href=/7>-Print</a></div><footer><a href=/8>-About us</a> <a href=/9>-Terms</a></footer></article>""",
    """<main><h2>+The tram returns</h2><p>+After forty years the city lays rails again, and the first line is to open when the chestnuts are in bloom.</p><aside><p>-Season tickets are cheaper this month, see <a href=/1>all offers of the transport office</a> and choose yours.</p></aside><p>+It costs less than the tunnel that was planned before.</p><p><a href=/2>+The plan of the line</a></p><div class="comments"><p>-I doubt it, as <a href=/3>this study of another city</a> shows in some detail.</p><p>-Same here.</p><p><a href=/4>-Answer</a></p></div></main>""",
    """<div class="post"><p>+Sharpen the knife first on the coarse stone and then on the fine one, always at the same angle.</p><p class="advert">-Our knives are forged by hand and come with a stone of your choice, for this week only.</p><p>+Wipe it dry.</p><p>+How steep the angle should be is told in <a href=/1>the table of blades</a> at the end of the book.</p><ul><li>+Coarse stone</li><li>+Fine stone</li><li class="promo"><a href=/2>-Stones in our shop</a></li></ul><nav class="pagination"><a href=/3>-1</a> <a href=/4>-2</a> <a href=/5>-3</a></nav></div>""",
    """<article><p>+The comet will be seen low in the west after sunset, if the sky is clear and no lamps are near.</p><p><a href=/1>+Where to look each night</a></p><p><a href=/2>+How it got its name</a></p><section class="recommended"><h3>-You may also like</h3><p><a href=/3>-Moons of the outer planets</a></p><p><a href=/4>-A telescope for beginners</a></p></section><div class="tags sidebar"><a href=/5>-sky</a> <a href=/6>-night</a></div></article>""",
    # prose with links outside of any telling element
    """<p><a href=/1>-Main page</a> <a href=/2>-Contents</a> <a href=/3>-Help</a></p><p>+Peat forms where plants die in water faster than they rot, which takes <a href=/4>a thousand years a metre</a> in most bogs.</p><p>+It was cut and burnt for as long as there have been people in <a href=/5>the northern plains</a>, and the ditches of that time are still seen from the air.</p><p>+Those who want to read on may begin with <a href=/6>the survey of the bogs</a> and its maps.</p><p>+Little of it is left.</p><p>+Now the ditches are closed again, as <a href=/7>the law on moors</a> asks for, and the water comes back with the frogs.</p><p><a href=/8>-Edit this page</a></p><p>-Last changed in May</p>""",
    """<div><a href=/1>-Catalogue</a></div><div><a href=/2>-Opening hours</a></div><div>+The museum shows clocks of <a href=/3>four centuries</a>, all of them running, so that at noon nobody understands a word in its halls.</div><div>+They were given to the town by a watchmaker who had bought them in <a href=/4>Geneva</a> and <a href=/5>Augsburg</a> and never sold a single one.</div><div>+The oldest has no hands; how time was read from it is told in <a href=/6>a leaflet that lies at the door</a>.</div><div><a href=/7>-Book a tour of the museum</a></div><div><a href=/8>-How to find us</a></div>""",
    """<p>+If you have time for one walk only, take the one along <a href=/1>the upper dam</a> to the mill and come back through the woods.</p>""",
    """<div>+Answers to most questions stand in <a href=/1>the handbook of the club</a>, of which each new member is given a copy in the first week.</div>""",
    """<p>+The choir sang in <a href=/1>the old church</a> and, when it rained, in <a href=/2>the hall next to it</a>, where the sound was dry but the seats were better.</p><p>+Both were full.</p>""",
    """<p><a href=/1>-Forum</a></p><p><a href=/2>-Rules of the house</a></p><p>+To bleed the brake, open the valve at <a href=/3>the lever</a> by half a turn and press until no more bubbles rise in the tube.</p><p>+Close it and try; a soft lever means that there still is air somewhere, most often in <a href=/4>the bend above the wheel</a>.</p><p><a href=/5>-Brakes and what belongs to them at good prices</a></p><p><a href=/6>-All workshops near you</a></p>""",
    """<nav><a href=/1>-Back to the list</a></nav><div class="sidebar"><p>-We mend shoes of all kinds, and <a href=/2>this is what we ask for it</a> at present.</p><p><a href=/3>-Directions</a></p></div><p>+A good sole is sewn, not glued, because leather moves and glue does not, and what moves against what does not will tear.</p><p>+Thread is waxed by hand as <a href=/4>our teachers did it</a> and as we do.</p><footer>-Write to <a href=/5>the workshop</a> if anything is unclear</footer>""",
    """<div class="cookie-banner"><p>-This page keeps small files, as <a href=/1>our notice on privacy</a> explains at some length.</p><a href=/2>-Agree</a></div><div><p>+Ink was made of oak galls and iron, and it eats the paper on which it was written a little more each year.</p><p>+How it can be stopped is shown in <a href=/3>a film of the archive</a> that lasts ten minutes.</p></div><div class="newsletter"><p>-One letter a month, and <a href=/4>no more than that</a>, we promise you.</p></div>""",
    # prose between and behind link blocks
    """<article><h1>+Salt roads</h1><p>+Salt was carried over the pass on mules, forty to a train, from the mines to the towns of the plain.</p><nav><a href=/1>-Mines</a> <a href=/2>-Mules</a></nav><p>+Where the trains rested for the night inns were built, and some of the inns became villages with walls.</p><div class="share"><a href=/3>-Mail</a></div><p>+The last train crossed in the year in which the railway was opened.</p></article>""",
    """<main><p>+Willow bark was boiled and drunk against fever long before anyone knew what in it helps.</p><ul class="menu"><li><a href=/1>-Herbs from A to Z</a></li><li><a href=/2>-Teas</a></li></ul><p>+Today the same thing is pressed into tablets by the ton, and hardly anyone thinks of willows.</p></main><p><a href=/3>-Top of the page</a></p><p>-Printed on paper from old paper</p>""",
    """<p><a href=/1>-Stories</a> <a href=/2>-Poems</a></p><p>+The lamp on the pier was lit by a woman who rowed out every evening, in any weather, for thirty years.</p><p><a href=/3>-A poem about the lamp</a></p><p>+When it was replaced by an electric one she still rowed out, she said, because the arms would not know what else to do.</p><p><a href=/4>-Sign up</a></p><p>-Made in the harbour town</p>""",
    """<div><a href=/1>-Tests</a></div><div>+The tent stood for two weeks in rain and wind, and not a drop came through its seams or its floor.</div><div><a href=/2>-All tents</a></div><div>+It weighs more than others of its size, which one notices on the second day at the latest.</div><div><a href=/3>-Compare</a></div><div>-Prices of today</div>""",
    """<div><a href=/1>-Contents of the volume</a></div><div>+In the spring of that year the river rose higher than any mark on the bridge, and it stayed so for nine days, in which the lower streets could be passed by boat alone, and bread was handed up to the windows on long poles.</div><div><a href=/2>-Next chapter</a></div><div>+When the water fell it left mud to the height of a man in every house, and under the mud, as the oldest of the carpenters had foretold, beams that had been sound for two hundred years and now broke like cheese.</div><div><a href=/3>-Notes</a></div>""",
    """<p><a href=/1>-Home</a></p><p>+Whoever sets type by hand learns to read upside down and from right to left, and after some years no longer notices it, so that some compositors are said to have held even their newspaper the wrong way round at breakfast.</p><p><a href=/2>-Letters and cases</a></p><p>+The machine that ended the trade could cast a whole line at once from hot lead, and one man with it did the work of six; those five found other work or none, and their stools were sold to schools.</p><p><a href=/3>-Write a letter to the editor</a></p><p>-All texts belong to those who wrote them</p>""",
    """<article><h1>+Apples</h1><div class="share"><a href=/1>-Share</a></div><p>+An apple grown from a pip never has the taste of its mother tree, so every named kind is one single tree that was cut and grafted again and again, some of them for longer than there have been printed books to praise them in.</p><aside><a href=/2>-Trees by mail</a></aside><p>+The cut has to be made in late winter, with a clean blade and on a dry day, and the twig is bound with bast and sealed with wax until both have grown together, which takes until the longest day of the year or a little more.</p></article>""",
)


@functools.cache
def trained_tree(pages: tuple[str, ...] = LABELLED):
    """The tree fitted to labelled pages, whose number is bounded by the table in this module."""
    x, y = [], []
    for page in pages:
        found = blocks(page)
        labels = [b.text[0] == "+" for b in found]
        for b in found:
            b.text = b.text.replace("+", "").replace("-", "")
        x.append(features(found))
        y += labels
    return fit_tree(np.concatenate(x), np.array(y, float))


def main_text(page: str | None, tree=None) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    keep = apply_tree(trained_tree() if tree is None else tree, features(found))
    return " ".join(b.text for b, k in zip(found, keep) if k)


def _extracted(batches, tree):
    for batch in batches:
        texts = [main_text(x.as_py(), tree) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text and n_chars, its code points."""
    tree = trained_tree()
    known = typed(pages, page_id="bigint", url="string", html="string")
    return known.mapInArrow(lambda it: _extracted(it, tree), "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


QUERIES = {NAME: query}
