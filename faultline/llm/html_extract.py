"""Main text of web pages by boosted trees over DOM nodes, decoded so that no two verdicts clash.

A page is read into a tree of block elements; text outside of markup, scripts, styles and other
invisible parts hangs in text leaves, one for each run between block borders. Each node gets
features: its tag, words in its class, id and role, the same of its ancestors, depth, how long, how
densely linked, tagged and punctuated its subtree is, and its place and share among its siblings.
Boosted trees give each node the probabilities to be content, boilerplate or mixed. Decoding picks the most
likely verdicts of the whole tree under the rule that all that lies in content is content and all that lies in
boilerplate is boilerplate; only what is mixed may hold both, and a text leaf is never mixed.

The trees are trained on pages that this module makes up by rule, over a range of layouts, so their
truth is known and no page of the corpus is needed.

The text: leaves that are content, in page order, character references decoded, white space
made one space each and trimmed, joined by two line ends.

Defined results: null or empty html, or no content: an empty text with n_chars 0; cut-off tags at the end of a page are
dropped, elements that were never closed end with their parent, and of invisible ones (scripts and style sheets apart) only the
tag is dropped; end tags without an element are passed over; null ids and urls are passed on; repeated rows are read
each; other columns are ignored; an empty table gives an empty result; long pages are read whole.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted
from .common import python_ready

CONTENT, BOILERPLATE, MIXED = 0, 1, 2
# a quote opens a value only after =, and closes it only where the value may end; any other quote is a character like others
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*(?:(?:"[^"]*"|'[^']*')(?=[\s/>]|\Z))?)*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
INVISIBLE = frozenset("script style noscript template head title svg iframe object select textarea datalist math canvas audio video map".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr nobr".split())
#: Invisible elements that may hold others of their name, and those whose content is never markup.
NESTED, RAW = frozenset("template svg object".split()), frozenset("script style".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# opening one of these ends an open one of the set
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table body html article section div main".split())
TAGS = ("nav", "header", "footer", "aside", "article", "main", "section", "p", "h1 h2 h3 h4 h5 h6", "ul ol li dl dt dd", "form button fieldset dialog", "table tbody thead tr td th", "div", "blockquote pre figure figcaption", "#text")
GROUPS = {
    "advert": "ad ads advert advertisement adsense banner promo promoted promotion sponsor sponsored",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc links skip",
    "reader": "comment comments reply replies disqus respond discussion feedback thread",
    "side": "sidebar aside side rail widget related recommended popular trending more teaser",
    "foot": "footer foot copyright legal bottom contentinfo imprint",
    "head": "header head masthead top logo brand toolbar topbar",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription paywall warning signup login",
    "share": "share sharing social follow buttons tools tags print",
    "article": "article content post entry story main text body prose copy articlebody",
}
_GROUP_OF = {w: i for i, ws in enumerate(GROUPS.values()) for w in ws.split()}
_TAG_OF = {t: i for i, ts in enumerate(TAGS) for t in ts.split()}
_HELD = [_TAG_OF[t] for t in ("nav", "header", "footer", "aside", "article", "main", "form")]


class Page:
    """The tree of a page: parent, tag and class bits of each node in document order; text leaves hold their text."""

    def __init__(self, source: str | None) -> None:
        self.parent, self.tag, self.bits, self.text, self.linked = [-1], ["#root"], [0], [""], [0]
        self._unclosed: set[str] = set()
        opened: Counter = Counter()
        source = source or ""
        stack, parts, links = [0], [], 0
        in_link, pos, n = 0, 0, len(source)

        def flush() -> None:
            nonlocal parts, links
            if parts:
                text = " ".join(html.unescape("".join(parts)).split())
                if text:
                    self._add(stack[-1], "#text", 0, text, min(links, len(text)))
                parts, links = [], 0

        while pos < n:
            m = _TOKEN.search(source, pos)
            start = m.start() if m else n
            if start > pos:
                piece = source[pos:start]
                parts.append(piece)
                if in_link:
                    links += len(piece.strip())
            if not m:
                break
            pos = m.end()
            name = (m[2] or "").lower()
            if not name:
                continue
            if not m[1]:
                if name in INVISIBLE:
                    if not m[3].rstrip().endswith("/"):
                        pos = self._past(source, pos, name)
                    parts.append(" ")
                elif name in INLINE:
                    in_link += name == "a"
                elif name in VOID:
                    parts.append(" ")
                    if name == "hr":
                        flush()
                else:
                    flush()
                    self._close_for(name, stack, opened)
                    bits = 0
                    if m[3]:
                        for a in _ATTR.finditer(m[3]):
                            for w in _WORD.findall((a[1] or a[2] or a[3] or "").lower()):
                                if w in _GROUP_OF:
                                    bits |= 1 << _GROUP_OF[w]
                    stack.append(self._add(stack[-1], name, bits, "", 0))
                    opened[name] += 1
            elif name == "a":
                in_link = max(0, in_link - 1)
            elif opened[name]:  # an end tag without an element is passed over
                flush()
                k = len(stack) - 1
                while self.tag[stack[k]] != name:
                    k -= 1
                self._drop(stack, k, opened)
        flush()

    def _past(self, source: str, pos: int, name: str) -> int:
        """Where the content of an invisible element ends; pos itself if it was never closed, so that only its tag goes.

        It was not closed if there is no end tag, or another element of its name begins before that (unless these nest).
        A script or style sheet without an end runs to the end of the page, a head to the body.
        """
        if name in self._unclosed:
            return pos
        if name == "head":
            end = re.compile(r"</head\b[^>]*(?:>|\Z)|(?=<body\b)", re.I).search(source, pos)
            return end.end() if end else pos
        depth = 1
        for t in re.compile(rf"<(/?){re.escape(name)}(?![a-zA-Z0-9-])[^>]*(?:>|\Z)", re.I).finditer(source, pos):
            if t[1]:
                depth -= 1
            elif name in NESTED:
                depth += not t[0].rstrip(">").endswith("/")
            elif name not in RAW:
                return pos
            if not depth:
                return t.end()
        if name in RAW:
            return len(source)
        self._unclosed.add(name)
        return pos

    def _drop(self, stack: list[int], k: int, opened: Counter) -> None:
        """Closes the elements of the stack from its place k on."""
        for i in stack[k:]:
            opened[self.tag[i]] -= 1
        del stack[k:]

    def _add(self, parent: int, tag: str, bits: int, text: str, linked: int) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.bits.append(bits)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.tag) - 1

    def _close_for(self, name: str, stack: list[int], opened: Counter) -> None:
        if len(stack) > 1 and self.tag[stack[-1]] == "p":  # a block ends a paragraph
            self._drop(stack, len(stack) - 1, opened)
        ends = CLOSES.get(name)
        if ends and any(opened[x] for x in ends):
            for k in range(len(stack) - 1, 0, -1):
                tag = self.tag[stack[k]]
                if tag in ends:
                    self._drop(stack, k, opened)
                    break
                if tag in SCOPE:
                    break


def features(pages: list[Page]) -> np.ndarray:
    """A row of numbers for each node of the pages, one after the other."""
    sizes = [len(p.tag) for p in pages]
    first = np.cumsum([0, *sizes[:-1]])
    n = sum(sizes)
    parent = np.concatenate([np.array(p.parent, np.int64) + at for p, at in zip(pages, first, strict=True)])
    roots = np.repeat(first, sizes)
    up = np.maximum(parent, roots)  # a root stands for its own parent
    kind = np.array([_TAG_OF.get(t, len(TAGS)) for p in pages for t in p.tag], np.int64)
    bits = np.array([b for p in pages for b in p.bits], np.int64)
    chars = np.array([len(t) for p in pages for t in p.text], np.float64)
    marks = np.array([sum(map(t.count, ".,;:!?")) if t else 0 for p in pages for t in p.text], np.float64)
    linked = np.array([x for p in pages for x in p.linked], np.float64)
    leaf = (kind == _TAG_OF["#text"]).astype(np.float64)
    before = np.cumsum(chars) - chars
    before -= before[roots]
    depth = np.zeros(n, np.int64)
    below = np.arange(n) != roots
    level, nodes = up, np.flatnonzero(below)
    while len(nodes):  # count the steps to the root
        depth[nodes] += 1
        nodes = nodes[level[nodes] != roots[nodes]]
        level = up[level]
    by_depth = [np.flatnonzero(depth == d) for d in range(int(depth.max(initial=0)) + 1)]
    held_tag = np.zeros(len(TAGS) + 1, np.int64)
    held_tag[_HELD] = 1 << np.arange(len(_HELD)) << len(GROUPS)
    held, passed = np.zeros(n, np.int64), bits | held_tag[kind]
    sums = np.stack([chars, linked, marks, leaf, np.ones(n)], 1)
    for d in by_depth[1:]:
        held[d] = held[up[d]] | passed[up[d]]
    for d in reversed(by_depth[1:]):
        np.add.at(sums, up[d], sums[d])
    kids = np.flatnonzero(below)
    kids = kids[np.argsort(up[kids], kind="stable")]
    count = np.bincount(up[kids], minlength=n).astype(np.float64)
    group = np.concatenate([[0], np.cumsum(count)[:-1]])
    index = np.zeros(n)
    index[kids] = np.arange(len(kids)) - group[up[kids]]
    after = kids[1:][up[kids[1:]] == up[kids[:-1]]] if len(kids) else kids
    prior = kids[:-1][up[kids[1:]] == up[kids[:-1]]] if len(kids) else kids
    t, links, punct, leaves, nodes_in = sums.T
    same, beside, ahead = np.zeros(n), np.zeros(n), np.zeros(n)
    same[after] = kind[prior] == kind[after]
    beside[after], ahead[prior] = np.log1p(t[prior]), np.log1p(t[after])
    size, all_ = np.maximum(t, 1.0), np.maximum(t[roots], 1.0)
    own = (bits[:, None] >> np.arange(len(GROUPS)) & 1).astype(np.float64)
    over = (held[:, None] >> np.arange(len(GROUPS) + len(_HELD)) & 1).astype(np.float64)
    hot = (kind[:, None] == np.arange(len(TAGS))).astype(np.float64)
    numbers = np.stack([np.log1p(t), links / size, nodes_in / size, punct / size, np.log1p(t / np.maximum(leaves, 1)), depth, index / np.maximum(count[up] - 1, 1), np.log1p(count[up]), t / np.maximum(t[up], 1), t / all_, before / all_, same, beside, ahead, np.log1p(leaves), kind[up]], 1)
    return np.concatenate([hot, own, over, numbers], 1)


def decode(page: Page, logp: np.ndarray) -> np.ndarray:
    """The verdict of each node; see the module."""
    n = len(page.tag)
    content, boiler, best = logp[:, CONTENT].copy(), logp[:, BOILERPLATE].copy(), logp[:, MIXED].copy()
    best[[i for i in range(n) if page.tag[i] == "#text"]] = -np.inf
    c, b, m, parent = content.tolist(), boiler.tolist(), best.tolist(), page.parent
    for i in range(n - 1, 0, -1):
        p = parent[i]
        c[p] += c[i]
        b[p] += b[i]
        m[p] += max(c[i], b[i], m[i])
    out = np.empty(n, np.int64)
    for i in range(n):
        above = out[parent[i]] if i else MIXED
        out[i] = above if above != MIXED else CONTENT if c[i] > max(b[i], m[i]) else MIXED if m[i] > b[i] else BOILERPLATE
    return out


def extract(sources: list[str | None], model: Boosted) -> list[str]:
    """The main text of each page."""
    pages = [Page(s) for s in sources]
    if not pages:
        return []
    logp = model.log_probability(features(pages))
    out, at = [], 0
    for p in pages:
        verdict = decode(p, logp[at : at + len(p.tag)])
        at += len(p.tag)
        out.append("\n\n".join(t for t, v in zip(p.text, verdict.tolist(), strict=True) if t and v == CONTENT))
    return out


def made_up_page(rng: random.Random) -> tuple[str, list[str]]:
    """A page by rule, and the text blocks of its article in order."""
    letters, blocks = "abcdefghijklmnopqrstuvwxyzäéñß", []
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(1, 9)))
    style = rng.random()

    def say(lo: int, hi: int) -> str:
        ws = [word() for _ in range(rng.randint(lo, hi))]
        if style < 0.1:
            ws = [w + rng.choice(("***", "$$$", "%%%", "###", "!!")) for w in ws]
        elif style < 0.15:
            ws = [w.upper() + "!!" for w in ws]
        for i in range(0, len(ws), rng.randint(3, 14)):
            ws[i] = ws[i].capitalize() + rng.choice((".", ",", "", ""))
        return " ".join(ws) + rng.choice((".", ".", "", "!"))

    def wrap(tag: str, inside: str, names: str = "") -> str:
        attr = rng.choice(("class", "id", "class")) if names else ""
        extra = rng.choice(("", "box-", "site-", "js-")) if names else ""
        tail = f"</{tag}>" if tag not in ("p", "li") or rng.random() < 0.8 else ""
        return f"<{tag}{f' {attr}="{extra}{rng.choice(names.split())}"' if names else ''}>{inside}{tail}"

    def links(lo: int, hi: int) -> str:
        items = [f'<a href="/{word()}">{say(1, 3).rstrip(".!")}</a>' for _ in range(rng.randint(lo, hi))]
        return wrap("ul", "".join(wrap("li", x) for x in items)) if rng.random() < 0.7 else " | ".join(items)

    def main(text: str, tag: str, names: str = "") -> str:
        blocks.append(" ".join(text.split()))
        body = html.escape(text, quote=rng.random() < 0.5)
        if rng.random() < 0.3:
            ws = body.split(" ")
            k = rng.randrange(len(ws))
            ws[k] = rng.choice((f"<b>{ws[k]}</b>", f"<em>{ws[k]}</em>", f'<a href="/{word()}">{ws[k]}</a>', f"{ws[k]}<br>"))
            body = " ".join(ws)
        return wrap(tag, body, names)

    bare = lambda names: rng.choice((names, names, names, ""))
    junk = {
        "menu": lambda: wrap("nav", links(2, 9), bare("menu nav navbar")) if rng.random() < 0.7 else wrap("div", links(3, 9), "menu nav navigation breadcrumb"),
        "head": lambda: wrap("header", wrap(rng.choice(("div", "h1", "p")), say(1, 5)) + (links(2, 5) if rng.random() < 0.5 else ""), bare("header masthead top")),
        "advert": lambda: wrap(rng.choice(("div", "aside", "section")), say(2, 14) if rng.random() < 0.6 else wrap("p", say(2, 14)), "ad ads advert banner promo sponsored"),
        "notice": lambda: wrap(rng.choice(("div", "section", "dialog")), wrap("p", say(3, 20)) + (f"<button>{word()}</button>" if rng.random() < 0.6 else ""), "cookie notice consent alert popup newsletter"),
        "form": lambda: wrap("form", f"{wrap('p', say(1, 8))}<label>{word()}</label><input name=q><button>{say(1, 2)}</button>", bare("subscribe login search")),
        "side": lambda: wrap("aside", "".join(wrap(rng.choice(("p", "h3", "div")), say(1, 12)) for _ in range(rng.randint(1, 3))) + (links(2, 6) if rng.random() < 0.6 else ""), bare("sidebar widget related")) if rng.random() < 0.6 else wrap("div", wrap("h3", say(1, 4)) + links(2, 7), "sidebar related widget popular"),
        "share": lambda: wrap("div", links(2, 5), "share social tags"),
        "reader": lambda: wrap(rng.choice(("section", "div", "div")), wrap("h3", say(1, 3)) + "".join(wrap(rng.choice(("div", "article", "li")), wrap("p", say(3, 40)), bare("comment reply")) for _ in range(rng.randint(1, 6))), "comments discussion disqus respond replies"),
        "foot": lambda: wrap("footer", rng.choice(("&copy; ", "")) + say(2, 20) + (links(2, 6) if rng.random() < 0.4 else "") + (wrap("p", say(2, 15)) if rng.random() < 0.3 else ""), bare("footer copyright legal")) if rng.random() < 0.8 else wrap("div", say(2, 14), "footer copyright legal bottom"),
    }
    some = lambda names, p: "".join(junk[k]() for k in names.split() if rng.random() < p)

    def article() -> str:
        parts = []
        if rng.random() < 0.8:
            parts.append(main(say(1, 14), rng.choice(("h1", "h1", "h2"))))
        for _ in range(rng.choice((1, 1, 2, 3, 5, 8, 14))):
            kind = rng.random()
            long = rng.choice(((1, 3), (5, 30), (20, 80), (60, 160)))
            if kind < 0.72:
                parts.append(main(say(*long), "p"))
            elif kind < 0.78:
                parts.append(main(say(1, 6), rng.choice(("h2", "h3"))))
            elif kind < 0.84:
                parts.append(wrap("ul", "".join(main(say(2, 15), "li") for _ in range(rng.randint(1, 5)))))
            elif kind < 0.88:
                parts.append(wrap("blockquote", main(say(*long), "p")))
            elif kind < 0.91:
                parts.append(wrap("table", "".join(wrap("tr", "".join(main(say(1, 3), "td") for _ in range(2))) for _ in range(rng.randint(1, 3)))))
            elif kind < 0.94:
                parts.append(main(say(*long), "div"))
            else:
                parts.append(junk[rng.choice(("advert", "advert", "share", "side", "form", "notice"))]())
        return "".join(parts)

    before = [some("notice", 0.25), some("head", 0.4), some("menu", 0.8), some("advert", 0.5), some("notice form", 0.1)]
    rng.shuffle(before)
    holder = rng.choice(("article", "article", "main", "div", "section"))
    names = "content article post entry story main" if holder in ("div", "section") else bare("content post entry")
    body = wrap(holder, article(), names)
    around = body + some("share", 0.2) + some("reader", 0.35) + some("side", 0.35)
    if rng.random() < 0.35:
        around = wrap(rng.choice(("main", "div", "div")), around, bare("wrapper page container"))
    page = "".join(before) + around + some("advert", 0.25) + some("form notice", 0.12) + some("foot", 0.85)
    lead = f"<!DOCTYPE html><html><head><title>{say(1, 6)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>" if rng.random() < 0.8 else "<body>"
    return lead + page + rng.choice(("</body></html>", "</body></html>", "")), blocks


@functools.lru_cache(maxsize=1)
def trained(pages: int = 700, seed: int = 5) -> Boosted:
    """The model, trained on made-up pages of a fixed seed."""
    rng = random.Random(seed)
    xs, ys = [], []
    for _ in range(pages):
        source, blocks = made_up_page(rng)
        page = Page(source)
        y = labels(page, blocks)
        keep = y >= 0
        xs.append(features([page])[keep])
        ys.append(y[keep])
    return Boosted(rounds=28).fit(np.concatenate(xs), np.concatenate(ys), 3)


def labels(page: Page, blocks: list[str]) -> np.ndarray:
    """Content, boilerplate or mixed for each node of a page whose article holds just these blocks; -1 for nodes without text."""
    n, k = len(page.tag), 0
    good, bad = np.zeros(n, bool), np.zeros(n, bool)
    for i in range(n):
        if page.text[i]:
            if k < len(blocks) and page.text[i] == blocks[k]:
                good[i], k = True, k + 1
            else:
                bad[i] = True
    for i in range(n - 1, 0, -1):
        good[page.parent[i]] |= good[i]
        bad[page.parent[i]] |= bad[i]
    return np.select([good & bad, good, bad], [MIXED, CONTENT, BOILERPLATE], -1)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each page: page_id, url, text, n_chars."""
    spark = pages.sparkSession
    python_ready(spark)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    model = spark.sparkContext.broadcast(trained())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = extract(b.column(2).to_pylist(), model.value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = [rows.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return rows.mapInArrow(read, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
