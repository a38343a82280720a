"""Main text of web pages: flat text blocks classified by a decision tree.

A page becomes a list of text blocks in page order. A block's features are its word count and link
density, those of its neighbours, and what its containers say of it. The tree (CART, Gini impurity) is
trained on a small table of labelled pages: TRAINING, written by hand, and pages made by rule from the
kinds of boilerplate and containers, with blocks of 1 to 100 words of every kind.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, kept_apart, text_slices, with_fields

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"  # comment
    r"|<(?:svg|math|iframe|object|template|select|textarea|noscript)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*/>"  # closed in itself
    r"|<(?P<raw>script|style|title|noscript|template|textarea|select|svg|math|iframe|object)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/][^>]*(?:>|\Z)"  # declarations, processing instructions, odd closing tags
    r"|<[a-zA-Z][^>]*(?:>|\Z)"  # a tag with an open quote, or cut off by the end
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style|data-y)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_HINT_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")

# Elements of HTML by role.
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form button h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
_CONTAINER = _BLOCK - frozenset("p hr h1 h2 h3 h4 h5 h6 body html dt dd".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BOILER = frozenset("nav header footer aside form menu dialog button".split())
_MAIN = frozenset("article main".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_ROLE_BOILER = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
_HINT_BOILER = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification notifications "
    "pagination pager paywall popup promo promotion promotions recommended recommendations related replies reply respond respondents response responses share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags teaser toolbar topbar widget widgets".split()
)
_HINT_MAIN = frozenset("article content entry main post story body text".split())
#: Words after which the word before them says what an element is: a sidebar-content is a sidebar.
_GENERIC = frozenset("area articles bar block body box button buttons card column container content entries group icon icons image inner item items left link links list main outer page pages panel posts right row section site slot stories text title top unit wrap wrapper".split())
#: Words that turn round the meaning of the next one: a page with-sidebar is none.
_NEGATION = frozenset("has hide is no not show with without".split())

FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "main", "main_gap", "boilerplate", "list_or_cell", "heading")


@dataclass
class Block:
    text: str
    features: list[float]
    label: int | None = None


def _kind(token: str) -> int:
    """What a class or id says of its element: -1 boilerplate, 1 main text, 0 neither. Its last word that isn't
    generic decides, as in a compound noun: a cookie-notice is a notice, a social-history a history."""
    words = [x.lower() for x in _HINT_SPLIT.split(token) if x and not x.isdigit()]
    k = len(words) - 1
    while k > 0 and words[k] in _GENERIC:
        k -= 1
    if k < 0 or (k and words[k - 1] in _NEGATION):
        return 0
    return -1 if words[k] in _HINT_BOILER else int(words[k] in _HINT_MAIN)


def _marks(name: str, attrs: str, in_main: int, labelled: bool) -> tuple[int, int, int | None]:
    """Of an element: main (2 by kind, 1 by name), boilerplate by kind or name, label in a training page (data-y means
    nothing elsewhere)."""
    main, boiler, label = 2 * (name in _MAIN), int(name in _BOILER), None
    if name == "header" and in_main:  # an article's own header holds its title
        boiler = 0
    if attrs:
        kinds: set[int] = set()
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                kinds.update(_kind(x) for x in value.split() if not (in_main and x.lower().endswith("header")))
            elif key == "role":
                boiler |= value.lower() in _ROLE_BOILER
                main = max(main, 2 * (value.lower() in ("main", "article")))
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
                boiler = 1
            elif key == "data-y" and labelled:
                label = int(value)
        if -1 in kinds:
            boiler = 1
        elif 1 in kinds:
            main = max(main, 1)
    return main, boiler, label


#: Share of the words of all named containers that articles need to stand above the others.
ARTICLE_SHARE = 0.2


def blocks(page: str, labelled: bool = True) -> list[Block]:
    """Text blocks of a page, with the labels that a training page has. White space in a block is one space; character references are decoded once."""
    out: list[Block] = []
    stack: list[tuple[str, int, int, int | None]] = [("", 0, 0, None)]
    para: tuple[int, int, int | None] = (0, 0, None)  # of the paragraph or heading that is open
    parts: list[str] = []
    linked = links = heading = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html_lib.unescape("".join(parts)).split()) if parts else ""
        if text:
            top = stack[-1]
            words = text.count(" ") + 1
            cell = int(any(x[0] in ("li", "td", "th") for x in stack))
            main, boiler = (max(x, y) for x, y in zip(top[1:3], para))
            out.append(Block(text, [min(words, 200), min(1.0, linked / words), 0, 0, 0, 0, main, 0, boiler, cell, heading], para[2] if para[2] is not None else top[3]))
        parts.clear()
        linked = 0

    for m in _TOKEN.finditer(page):
        if (text := m["text"]) is not None:
            parts.append(text)
            if links:
                linked += len(text.split())
            continue
        if (name := m["name"]) is None:
            continue
        name = name.lower()
        if name == "a":
            links = int(not m["close"])
        elif name == "br":
            parts.append(" ")
        elif name in _BLOCK:
            flush()
            links, heading, para = 0, int(name in _HEADING and not m["close"]), (0, 0, None)
            up = stack[-1]
            if m["close"]:
                if name in _CONTAINER:
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i][0] == name:
                            del stack[i:]
                            break
            elif name in _CONTAINER:
                main, boiler, label = _marks(name, m["attrs"], up[1], labelled)
                inherited = 0 if name == "main" and not boiler else up[2]  # the main element lies in no sidebar
                stack.append((name, max(main, up[1]), max(boiler, inherited), label if label is not None else up[3]))
            elif m["attrs"] and name != "html":
                para = _marks(name, m["attrs"], up[1], labelled)
                if name == "body":
                    stack[0], para = ("", 0, 0, para[2]), (0, 0, None)
    flush()
    held = [0, 0, 0]  # words by kind of container
    for b in out:
        if not b.features[8]:
            held[b.features[6]] += b.text.count(" ") + 1
    most = 2 if held[2] and held[2] >= ARTICLE_SHARE * (held[1] + held[2]) else 1 if held[1] else 2 * bool(held[2])
    for i, b in enumerate(out):
        if i:
            b.features[2:4] = out[i - 1].features[:2]
        if i + 1 < len(out):
            b.features[4:6] = out[i + 1].features[:2]
        b.features[7] = max(0, most - b.features[6])
    return out


# The labelled pages. data-y marks what is main text (1) and what is not (0).
TRAINING = (
    """<body data-y=0><nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/c>Contact us</a></li></ul></nav><div class=ad>Buy two and get a third one free this week only</div>
    <article data-y=1><h1>A short title</h1><p>The committee met on Tuesday to discuss the new harbour and the cost of the two bridges that lead to it from the old town.</p><p>Yes.</p><p>Nobody spoke.</p>
    <ul><li>First point of the plan</li><li>Second point</li></ul><p>Members agreed to meet again in the spring, when the figures are known and the winter repairs are over.</p><p><a href=/plan>The plan</a> is public.</p></article><footer>Copyright of the harbour board</footer></body>""",
    """<body data-y=0><header><h2>The Daily Example</h2><p>News for all</p></header><div class=menu><a href=1>World</a> <a href=2>Sport</a> <a href=3>Weather</a></div>
    <main data-y=1><h2>Rain</h2><p>Rain fell.</p><p>It rained for nine days and the river rose above the lower meadows, so the farmers brought the cattle up to the road and waited there.</p><p>Then sun.</p><aside data-y=0><p>Read also our long report about the rivers of the north and the people who live beside them all year</p></aside>
    <p>Trains ran late.</p><div class="ad banner" data-y=0>Cheap tickets for every train in the country, book them now and save half the price</div><p>By Sunday the water had gone.</p></main>
    <section id=comments><h3>Comments</h3><p>I saw the flood from my window and it was quite a sight, the whole valley looked like one large lake to us.</p><p>Me too</p></section><footer><p>All rights reserved</p></footer></body>""",
    """<body data-y=0><div>Home</div><div><a href=1>About</a> <a href=2>Archive</a> <a href=3>Links</a> <a href=4>Impressum</a></div>
    <p data-y=1>My grandmother kept bees behind the mill, and in the long evenings of July she would sit by the hives with a veil over her hat and listen to them.</p><p data-y=1>She said little.</p>
    <p data-y=1>When the honey was ready we carried the frames to the kitchen, where the windows stayed shut all day, and turned the handle of the old drum until our arms were tired.</p>
    <p data-y=1>I still have that drum, and each summer I oil it and think of the smell of the wax and the sound of the bees in the closed room.</p><p><a href=x>Older posts</a> <a href=y>Newer posts</a></p><p>Powered by nothing</p></body>""",
    """<body data-y=0><div class=cookie-notice>We use cookies to make this site better for you and for our many partners, please read our policy and accept</div><div class=content data-y=1><h1>Soup</h1><p>Serves four.</p><table><tr><td>Leeks</td><td>Three</td></tr></table>
    <p>Wash the leeks, cut them into rings and let them soften in butter over a low flame for about ten minutes without browning.</p><p>Add stock.</p><div class=share data-y=0><a href=1>Share</a><a href=2>Print</a></div><p>Season and serve.</p></div>
    <div class=sidebar><h4>More recipes</h4><p>Our readers loved the bean stew that we printed last month with the pickled lemons and the green oil</p><ul><li><a href=1>Bean stew</a></li><li><a href=2>Green oil</a></li></ul></div>
    <form><p>Leave your address and we will write to you each month with the best of our kitchen</p><input><button>Send</button></form></body>""",
    """<body data-y=0><p><a href=1>Start</a></p><h1 data-y=1>On walking</h1><p data-y=1>A walk has no purpose but itself, and whoever asks where it leads has already turned back, for the path is made of steps and not of places.</p>
    <p data-y=1>There is a hill above our town from which on clear days one sees the sea, a thin bright line, and I have gone up there in all weathers to look for it.</p><h2 data-y=1>Going down</h2><p data-y=1>Going down is harder on the knees, but one meets people, and the dogs bark, and somebody is always cutting wood or mending a roof.</p>
    <p>Contact</p><p><a href=1>Imprint</a> <a href=2>Privacy</a> <a href=3>Terms of use</a></p></body>""",
    """<body data-y=0><nav>Welcome to the pages of the society, where members and their guests find all that they need to know about the year, the programme, the rooms and the many small rules of the house</nav>
    <p data-y=1>The society was founded by four friends who met each week above a bakery, and its first rule, which still stands, was that nobody may speak about money at the table.</p><p data-y=1>It is a good rule.</p>
    <p data-y=1>In the second year they rented two rooms from a bookbinder, painted the walls green, and bought a piano that none of them could play but which looked well in the corner.</p>
    <div class=comments><h4>Readers write</h4><p>My father was one of the four, and he always said that the piano came with the rooms and that it was the bookbinder who could not play it, but then he said many things of that kind.</p><p>I remember the green walls and the smell of bread in the morning, and how on the stairs one could hear somebody trying the same three notes again and again until the bell rang for dinner.</p></div>
    <div class=sidebar><p>The next meeting is on the first Thursday of the month, guests are welcome if they are brought by a member, and those who wish to dine should write to the secretary before Monday noon at the latest.</p></div>
    <p><a href=1>The programme of the year with all lectures and walks and dinners</a> <a href=2>The rooms of the house and how one may rent them for a feast</a> <a href=3>The rules of the society in full with all later changes</a> <a href=4>Letters and pictures from the first years</a></p>
    <footer><p>The society is a charity under the law of the land and is entered in the register of the town, its accounts are open to members on the last day of each quarter between nine and noon in the office.</p></footer></body>""",
    """<body data-y=0><form><p>Write to us and tell us what you think of the new pages, what you miss and what you would like to read here more often, and leave your name and address so that we may thank you for it.</p></form>
    <p data-y=1>Snow lay on the pass until June that year and the mail came by mule, two days late and often wet, so that the letters had to be dried on the stove before they could be read.</p>
    <p data-y=1>People wrote less then, or so it seems to me now, but they wrote better, and they kept what was written to them in boxes under the bed with a ribbon around each year.</p>
    <div class=advert><p>The finest paper and ink from our own mill, sent to your house within three days, with a pen of your choice as a gift if your order comes to us before the end of this month.</p></div></body>""",
    """<body data-y=0><div role=navigation>All topics from A to Z in one place for everybody who looks for them</div><div role=main data-y=1><header><h1>Ferries</h1><p>By our reporter</p></header><p>Two new ferries will sail from May.</p><p>Each takes ninety cars.</p></div>
    <div class=related><p>The old ferry was sold to a museum last autumn and can be visited on weekends until the snow comes</p></div><div class=newsletter>Get our letter every Friday morning, free, with all that matters on the coast</div></body>""",
)


#: Words of a block in the made pages.
LENGTHS = (1, 2, 3, 5, 8, 13, 21, 34, 55, 100)
# Kinds of boilerplate, of containers of the main text, and of short lines beside links.
AROUND = (
    "<nav>{t}</nav>", "<nav><ul>{links}</ul></nav>", "<header><p>{t}</p></header>", "<footer><p>{t}</p></footer>", "<aside><p>{t}</p></aside>", "<div class=ad>{t}</div>", '<div class="cookie-notice"><p>{t}</p></div>',
    "<div class=sidebar><p>{t}</p></div>", "<section id=comments><p>{t}</p></section>", "<form><p>{t}</p></form>", "<div class=newsletter>{t}</div>", "<div role=navigation>{t}</div>", "<ul class=menu>{links}</ul>", "<div class=related-posts><ul>{links}</ul></div>",
)
WITHIN = ("<div class=ad>{t}</div>", "<aside>{t}</aside>", "<div class=share-links>{links}</div>", "<form>{t}</form>", "<section class=comments><p>{t}</p></section>", "<footer>{t}</footer>")
CONTAINERS = ("<article data-y=1>{}</article>", "<main data-y=1>{}</main>", "<div class=content data-y=1>{}</div>", "<div role=main data-y=1>{}</div>", "{}")
BARE = ("<p>{links}</p><p>{t}</p>", "<div>{t}</div><div>{links}</div>", "<p>{t}</p><ul>{links}</ul>")


def made_pages() -> list[str]:
    """Labelled pages by rule: every container with boilerplate of every kind and blocks of every length around and
    in it. Where a container holds the main text, plain blocks outside are not of it; where none does, plain blocks
    are, but for links and short lines beside them."""
    pages = []
    for i in range(len(LENGTHS) * len(CONTAINERS)):
        container, at = CONTAINERS[i % len(CONTAINERS)], i // len(CONTAINERS)

        def fill(template: str, k: int, at: int = at) -> str:
            n = LENGTHS[(at + k) % len(LENGTHS)]
            return template.format(t=" ".join(["word"] * n), links=" ".join(f"<li><a href=/{x}>word</a></li>" if "<ul" in template else f"<a href=/{x}>word</a>" for x in range(max(2, n // 4))))

        bare = container == "{}"
        around = [fill(AROUND[(at + 3 * k) % len(AROUND)], 3 * k + i) for k in range(6)]
        within = [fill(x, k) for k, x in enumerate(WITHIN)]
        body = [f"<h1 data-y=1>{fill('{t}', at % 3)}</h1>", *(f"<p data-y=1>{fill('{t}', k)}</p>" for k in range(10)), f"<ul data-y=1><li>{fill('{t}', 1)}</li><li>{fill('{t}', 4)}</li></ul>", f"<p data-y=1>{fill('{t}', 5)} <a href=/x>word</a></p>"]
        if bare:  # at the ends a paragraph stands beside links; a short one there would be no main text
            body.insert(4, fill("<p data-y=1>{t}</p>", 3 - at + (at + 2) % 7) + fill("<p>{links}</p>", at) + fill("<p data-y=1>{t}</p>", 3 - at + (at + 5) % 7) + fill("<p data-y=1>{t}</p>", at % 3 - at))
            first = f"<h1 data-y=1>{fill('{t}', at % 3 - at)}</h1>" if at % 2 else ""
            body = [f"{first}<p data-y=1>{fill('{t}', -at + 3 + at % 7)}</p>", *body[1:], f"<p data-y=1>{fill('{t}', -at + 3 + (at + 3) % 7)}</p>"]
        else:
            # What an article links to is of it, however long: here whole paragraphs and most of one.
            body += [f"<p data-y=1>{fill('{t}', 2)} <a href=/x>{fill('{t}', at)}</a></p>", f"<p data-y=1><a href=/y>{fill('{t}', at + 1)}</a></p>", f"<p data-y=1>{fill('{links}', at)}</p>"]
            body.insert(1 + at, f"<div data-y=0>{fill('<div class=share-links>{links}</div>', at)}</div>")
        inner = "".join(body[:5]) + f"<div data-y=0>{within[at % len(within)]}</div>" + "".join(body[5:9]) + f"<div data-y=0>{within[(at + 1) % len(within)]}</div>" + "".join(body[9:])
        # Short lines, of at most three words, stand beside links where no container tells what is main.
        plain = [fill(x, -at + at % 3) for x in BARE] if bare else [fill("<p>{t}</p>", 2), fill("<div>{t}</div>", 6), fill("<p>{links}</p>", 4)]
        pages.append(f"<body data-y=0>{''.join(around[:3])}{plain[1]}{container.format(inner)}{plain[0]}{plain[2]}{''.join(around[3:])}</body>")
    return pages


class Tree:
    """A binary decision tree by Gini impurity, grown until leaves are pure, max_depth is reached or a leaf would
    have fewer than least_leaf blocks."""

    def __init__(self, x: np.ndarray, y: np.ndarray, max_depth: int = 8, least_leaf: int = 3) -> None:
        self.feature, self.at, self.left, self.right, self.share = [], [], [], [], []
        self.least = least_leaf
        self._grow(x, y, max_depth)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int) -> int:
        me = len(self.share)
        for values, v in ((self.feature, -1), (self.at, 0.0), (self.left, -1), (self.right, -1), (self.share, float(y.mean()))):
            values.append(v)
        if depth == 0 or y.min() == y.max():
            return me
        best = (y.var() * len(y) - 1e-9, -1, 0.0)
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for cut in (values[1:] + values[:-1]) / 2:
                low = x[:, f] <= cut
                if min(low.sum(), (~low).sum()) < self.least:
                    continue
                impurity = y[low].var() * low.sum() + y[~low].var() * (~low).sum()
                if impurity < best[0] - 1e-12:
                    best = (impurity, f, float(cut))
        if best[1] < 0:
            return me
        low = x[:, best[1]] <= best[2]
        self.feature[me], self.at[me] = best[1], best[2]
        self.left[me] = self._grow(x[low], y[low], depth - 1)
        self.right[me] = self._grow(x[~low], y[~low], depth - 1)
        return me

    def keeps(self, features: list[float]) -> bool:
        i = 0
        while self.feature[i] >= 0:
            i = self.left[i] if features[self.feature[i]] <= self.at[i] else self.right[i]
        return self.share[i] >= 0.5


def train(pages: Iterable[str] | None = None) -> Tree:
    """pages: labelled, by default TRAINING and the made pages."""
    rows = [b for p in ([*TRAINING, *made_pages()] if pages is None else pages) for b in blocks(p)]
    return Tree(np.array([b.features for b in rows], float), np.array([b.label or 0 for b in rows], float))


_tree: Tree | None = None


def main_text(page: str | None, tree: Tree | None = None) -> str:
    """The blocks that the tree keeps, in page order, joined by line breaks; null is an empty page."""
    global _tree
    if tree is None:
        tree = _tree = _tree or train()
    return "\n".join(b.text for b in blocks(page or "", labelled=False) if tree.keeps(b.features))


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages' columns without the markup column, with text and n_chars (code points).

    Null and empty pages have an empty text. Whole pages are read, whatever their length; rows are not
    dropped or joined. A column named text or n_chars is renamed input_<name>.
    """
    pages = kept_apart(pages, ("text", "n_chars"), html_col)
    keep = [c for c in pages.columns if c != html_col]
    markup = fresh(keep, "markup")[0]
    schema = with_fields(pages.select(*(F.col(f"`{c}`") for c in keep)).schema, "text string, n_chars long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, markup):
            texts = [main_text(t) for t in b.column(markup).to_pylist()]
            cols = [*(b.column(c) for c in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return pages.select(*(F.col(f"`{c}`") for c in keep), F.col(html_col).alias(markup)).mapInArrow(run, schema)
