"""Main text of HTML pages: the maximum-scoring run of words and tags.

A page is a row of tokens. A word scores by what is around it: the parts of the page it is in by their elements and names
(how sure a name is counts), whether that is an article or main element, the kind and length of its block and how much of
that is links. A tag scores below zero, by how often its like stands between two words of the article. The weights are
log odds counted on labelled pages. A linear scan finds the run with the largest sum; its text is returned block by block,
less what scores below zero within it, such as an advert or a form in an article.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Elements whose text is never shown, or is no part of a page's prose.
RAW = ("script", "style", "template", "iframe", "svg", "audio", "video", "textarea", "select", "title", "xmp", "noembed", "noframes")
#: Elements that start and end a block.
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li link main menu meta nav ol option p pre search section summary table tbody "
    "td tfoot th thead tr ul".split()
)
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that open anew although an older one of the kind is still open.
REOPENED = frozenset("p li td th tr dt dd option".split())
ROOTS = frozenset(("article", "main"))
#: Elements whose text stands in for something else; it is read in an article or main element alone.
FALLBACK = frozenset(("noscript", "object", "canvas"))

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<svg(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?<=/)>|<(?P<raw>" + "|".join(RAW) + r")(?P<rawattrs>(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"(class|id|role|aria-label|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Names that page authors give to parts outside the article, by kind.
KINDS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs skip".split(),
    "head": "header masthead topbar banner logo branding".split(),
    "foot": "footer foot copyright colophon legal".split(),
    "side": "aside sidebar side rail widget widgets related recommended recommendations trending popular complementary".split(),
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay toast disclaimer paywall".split(),
    "advert": "ad ads adv advert adverts advertisement advertising adsense promo promotion sponsor sponsored dfp taboola outbrain".split(),
    "form": "form search subscribe subscription newsletter signup login register contactform".split(),
    "comments": "comment comments disqus replies reply respond discussion reactions".split(),
    "share": "share sharing social follow".split(),
}
_KIND_OF = {name: kind for kind, names in KINDS.items() for name in names}
#: Words of layout that say nothing of a part's content, so that a name made of them and of a kind is sure.
LAYOUT = frozenset("site page main global top bottom left right upper lower inner outer primary secondary box block wrap wrapper container section area list bar row col column item items links content body text slot unit zone panel module social mobile desktop sticky fixed the my buttons icons".split())
#: Words for the article itself; with these, a header or footer is the article's own.
OWN = frozenset("entry post article story".split())
#: Kinds that a name does not give to a part of an article or main element for sure, as its own headings, legal passages
#: and sections on shares have such names too.
OUTSIDE = frozenset(("head", "foot", "share"))
#: Kinds of elements, and of roles.
_ELEMENT_KIND = {"nav": "menu", "menu": "menu", "header": "head", "footer": "foot", "aside": "side", "form": "form", "fieldset": "form", "button": "form", "label": "form", "dialog": "notice", "search": "form", "head": "head", "annotation": "hidden", "annotation-xml": "hidden"}
_ROLE_KIND = {"navigation": "menu", "menu": "menu", "menubar": "menu", "banner": "head", "contentinfo": "foot", "complementary": "side", "search": "form", "form": "form", "dialog": "notice", "alertdialog": "notice"}
#: Elements of prose, which are seldom a part of the page as a whole; only an advert's or comment's name is sure there.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote li dd dt pre td th figure figcaption table span a b i em strong code q cite".split())


def _named(name: str, value: str, rooted: bool) -> tuple[tuple[str, bool], ...]:
    """(kind, sure) of what the words of a class or id say."""
    out = []
    for token in value.split():
        words = [w.lower() for w in _PART.findall(token)]
        for kind in {_KIND_OF[w] for w in words if w in _KIND_OF}:
            own = kind in OUTSIDE and (rooted or any(w in OWN for w in words))
            sure = not own and all(w in _KIND_OF or w in LAYOUT or w in OWN for w in words) and (name not in PROSE or kind in ("advert", "comments"))
            out.append((kind, sure))
    return tuple(out)


def _parts(name: str, attrs: str, rooted: bool) -> tuple[tuple[str, bool], ...]:
    """(kind, sure) of each part of the page that an element is; ('root', True) of an article or main element."""
    if name in ("body", "html"):
        return ()
    out = [("root", True)] if name in ROOTS else []
    if name in _ELEMENT_KIND:
        out.append((_ELEMENT_KIND[name], True))
    if name in FALLBACK:
        out.append(("fallback", True))
    if "=" in attrs or "hidden" in attrs:
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), next((x for x in m.groups()[1:] if x is not None), "")
            if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
                out.append(("hidden", True))
            elif key == "role" and value in ("main", "article"):
                out.append(("root", True))
            elif key == "role" and value in _ROLE_KIND:
                out.append((_ROLE_KIND[value], True))
            elif key in ("class", "id"):
                out += _named(name, value, rooted)
            elif key == "aria-label":
                out += [(kind, False) for kind, _ in _named(name, value, rooted)]
    return tuple(out)


class Around(NamedTuple):
    """What is around a token: parts (kind: sure), whether in an article or main element, its block, whether in a link."""

    parts: dict[str, bool]
    rooted: bool
    block: str
    linked: bool

    def within(self, name: str, parts: tuple) -> Around:
        """What is around what an element inside has."""
        if not parts and name not in BLOCK and name != "a":
            return self
        own = dict(self.parts)
        for kind, sure in parts:
            if kind != "root":
                own[kind] = own.get(kind, False) or sure
        return Around(own, self.rooted or ("root", True) in parts, name if name in BLOCK else self.block, self.linked or name == "a")


class Token(NamedTuple):
    """A tag (name, whether it opens) or a text (no name), and what is around it."""

    name: str
    opens: bool
    text: str
    around: Around

    @property
    def rooted(self) -> bool:
        return self.around.rooted

    def part(self, kind: str) -> bool:
        return self.around.parts.get(kind, False)

    def sure(self) -> list[str]:
        return sorted(kind for kind, sure in self.around.parts.items() if sure and (kind != "fallback" or not self.rooted))

    def unseen(self) -> bool:
        return self.part("hidden") or self.part("fallback") and not self.rooted


def tokens(page: str) -> Iterator[Token]:
    """Tags and texts in order.

    An article or main element that opens inside another part, left open by mistake, starts afresh; not so in a sidebar or
    among comments, whose items are articles too.
    """
    none = Around({}, False, "", False)
    stack: list[tuple[str, Around]] = []
    opened: Counter[str] = Counter()  # open elements by name, so that a stray end tag looks at no stack
    at = 0

    def text(raw: str) -> Token:
        return Token("", False, html.unescape(raw) if "&" in raw else raw, stack[-1][1] if stack else none)

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            yield text(page[at : m.start()])
        at = m.end()
        if not m["name"]:
            continue
        name = m["name"].lower()
        if m["end"]:
            while opened[name]:
                last = stack.pop()[0]
                opened[last] -= 1
                if last == name:
                    break
            yield Token(name, False, "", stack[-1][1] if stack else none)
            continue
        now = stack[-1][1] if stack else none
        parts = _parts(name, m["attrs"] or "", now.rooted)
        if ("root", True) in parts:
            if {k for k, sure in now.parts.items() if sure} & {"comments", "side"} or {k for k, sure in parts if sure} & {"comments", "advert", "notice"}:
                parts = tuple(x for x in parts if x[0] != "root")
            elif not now.rooted:
                stack.clear()
                opened.clear()
        if name == "header" and now.rooted:
            parts = tuple(x for x in parts if x[0] != "head")  # an article's own heading
        if name in REOPENED and stack and stack[-1][0] == name:
            stack.pop()
            opened[name] -= 1
        now = stack[-1][1] if stack else none
        if name not in VOID and not (m["attrs"] or "").endswith("/"):
            now = now.within(name, parts)
            stack.append((name, now))
            opened[name] += 1
        yield Token(name, True, "", now)
    if at < len(page):
        yield text(page[at:])


def _features(run: list[Token]) -> list[tuple]:
    """For each token the features that its score adds up, none for tags: its surest parts; and each with whether it is
    rooted (or no token of the page is): kind of block, words in the block, share of links among these."""
    has_root = any(t.rooted for t in run)
    out: list[tuple] = []
    block: list[int] = []

    def closed() -> None:
        words = [len(run[i].text.split()) for i in block]
        total = sum(words)
        linked = sum(n for i, n in zip(block, words, strict=True) if run[i].around.linked)
        size = 0 if total < 4 else 1 if total < 12 else 2
        share = 0 if not linked else 1 if 2 * linked < total else 2
        for i in block:
            t = run[i]
            place = (t.rooted, has_root)
            sure = t.sure()
            parts = [("part", k) for k in sure] or [("maybe", k) for k in sorted(t.around.parts) if k != "fallback"] or [("part", "")]
            out[i] = (*parts, ("block", t.around.block in PROSE, *place), ("words", size, *place), ("links", share, *place))
        block.clear()

    for i, t in enumerate(run):
        out.append(())
        if t.name in BLOCK:
            closed()
        elif not t.name:
            block.append(i)
    closed()
    return out


def _words(n: int, seed: int) -> str:
    return " ".join(f"w{(seed * 31 + i * 7) % 97}" for i in range(n))


@lru_cache(1)
def labelled_pages() -> list[str]:
    """Labelled pages: HTML whose words outside the article start with x and those of the article with w, in layouts that
    pages come in: with and without an element for the article, names that mislead, and parts within the article."""
    x = lambda n: _words(n, 3).replace("w", "x")
    w = _words
    links = lambda n: "".join(f'<li><a href="/{i}">{x(1)}</a></li>' for i in range(n))
    bodies = [
        f"<h1>{w(6, 1)}</h1><p>{w(40, 2)}</p><p>{w(3, 4)} <a href='/w'>{w(2, 5)}</a></p><h2>{w(3, 6)}</h2><ul><li>{w(8, 7)}</li></ul><p>{w(30, 8)}</p>",
        f"<div class='entry-header'><p>{w(3, 8)}</p><h1>{w(6, 1)}</h1><p class='meta'>{w(4, 2)}</p></div><p>{w(50, 3)}</p><section id='form-design'><h2>{w(3, 4)}</h2><p>{w(40, 5)}</p></section><blockquote class='alert'><p>{w(9, 6)}</p></blockquote><p>{w(25, 7)}</p><div class='post-footer'><p>{w(6, 9)}</p></div>",
        f"<h1>{w(5, 1)}</h1><p><a href='/w'>{w(5, 2)}</a></p><ul>" + "".join(f"<li><a href='/{i}'>{w(2, i)}</a></li>" for i in range(3)) + f"</ul><p>{w(60, 3)}</p><table><tr><td>{w(2, 4)}</td><td>{w(3, 5)}</td></tr></table><pre>{w(10, 6)}</pre><figure><figcaption>{w(7, 7)}</figcaption></figure><p>{w(20, 8)}</p>",
        f"<div class='headline'><h1>{w(5, 1)}</h1></div><div class='text'><div><p>{w(6, 2)} <em>{w(2, 3)}</em> {w(20, 4)}</p></div><div>{w(12, 5)} <b>{w(1, 6)}</b> <i>{w(2, 7)}</i></div><div><div><p>{w(9, 8)} <span>{w(3, 9)}</span></p></div><p>{w(40, 10)} <code>{w(1, 11)}</code> {w(8, 12)}</p></div></div>",
        f"<h1>{w(4, 1)}</h1>{w(14, 2)}<br><br>{w(22, 3)}<br>{w(9, 4)}<p class='search-engines'>{w(30, 5)}</p><div id='menu-of-the-day'><h3>{w(3, 6)}</h3><p>{w(18, 7)}</p></div>",
    ]
    parts = {
        "menu": [f"<nav><ul>{links(6)}</ul></nav>", f'<div class="main-menu"><ul>{links(5)}</ul></div>', f'<ul class="breadcrumbs">{links(3)}</ul><div role="navigation"><p>{x(4)}</p></div>'],
        "head": [f"<header><h2>{x(3)}</h2><p>{x(7)}</p></header>", f'<div id="site-header">{x(6)}</div>', f'<div class="masthead"><p>{x(5)}</p></div>'],
        "foot": [f"<footer>{x(12)}</footer>", f'<div class="footer"><p>{x(19)}</p></div>', f'<div id="page-footer"><ul>{links(4)}</ul>{x(8)}</div>'],
        "side": [f"<aside><p>{x(25)}</p></aside>", f'<div class="sidebar"><h3>{x(2)}</h3><ul>{links(6)}</ul><p>{x(16)}</p></div>', f'<div class="related"><h3>{x(2)}</h3><p>{x(14)}</p></div>'],
        "notice": [f'<div class="cookie-notice"><p>{x(24)}</p></div>', f"<dialog>{x(9)}</dialog>", f'<div id="consent-box">{x(30)}</div>'],
        "advert": [f'<div class="ad">{x(16)}</div>', f'<section class="sponsored"><h3>{x(3)}</h3><p>{x(20)}</p></section>', f'<p class="advertisement">{x(11)}</p>'],
        "form": [f"<form><p>{x(9)}</p><input></form>", f'<div class="newsletter"><p>{x(18)}</p></div>', f"<form><label>{x(2)}</label><button>{x(1)}</button></form>"],
        "share": [f'<div class="social-share">{x(5)}</div>', f'<ul class="share-buttons">{links(3)}</ul>', f'<div class="follow"><p>{x(6)}</p></div>'],
        "comments": [f'<div id="comments"><h3>{x(2)}</h3><p>{x(40)}</p><p>{x(25)}</p></div>', f'<section class="comment-list"><p>{x(35)}</p></section>', f'<div class="post-comments"><article><p>{x(30)}</p></article></div>'],
    }
    pages = []
    for turn in range(3):
        of = lambda *kinds: "".join(parts[k][(turn + i) % 3] for i, k in enumerate(kinds))
        for start, end in (("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div id="main-text">', "</div>"), ("<div>", "</div>"), ("", "")):
            root = start in ("<article>", "<main>")
            loose = f"<div>{x(5)}</div><p>{x(14)}</p>" if root else f"<div><a href='/x'>{x(2)}</a> {x(1)}</div>"
            for body in bodies:
                inside = of("advert", "form", "side", "menu")
                pages.append(f"<html><head><title>{x(4)}</title></head><body>{of('menu', 'head', 'notice', 'advert')}{loose}{start}{body}{inside}{body}{end}{loose}{of('share', 'comments', 'side', 'form', 'foot')}</body></html>")
    return pages


@lru_cache(1)
def weights() -> tuple[float, dict[tuple, float], dict[tuple, float]]:
    """Prior log odds of a word, what each feature adds, and scores of tags by name, opening and rooted (for names not
    met: by whether they part blocks, opening and rooted), counted on the labelled pages. A tag's score is the logarithm of how often its
    like stands between two words of the article."""
    good, bad, between, tags = Counter(), Counter(), Counter(), Counter()
    for page in labelled_pages():
        run = list(tokens(page))
        features = _features(run)
        is_good = [t.text.split()[0][0] == "w" if not t.name and t.text.split() else None for t in run]
        for t, own, label in zip(run, features, is_good, strict=True):
            if label is not None:
                (good if label else bad).update({f: len(t.text.split()) for f in (*own, ())})
        last, pending = False, []
        for t, label in zip(run, is_good, strict=True):
            if t.sure():
                continue  # such parts are skipped, not what ends an article
            if t.name:
                pending.append((t.name, t.opens, t.rooted))
            elif label is not None:
                for key in pending:
                    for k in (key, (key[0] in BLOCK, *key[1:]))[: 1 if key[0] == "a" else 2]:  # other inline tags aren't links
                        tags[k] += 1
                        between[k] += last and label
                last, pending = label, []
        for key in pending:
            tags[key] += 1
            tags[(key[0] in BLOCK, *key[1:])] += 1
    ratio = lambda f: (good[f] + 0.5) / (good[()] + 1) * (bad[()] + 1) / (bad[f] + 0.5)
    words = {f: math.log(ratio(f)) for f in {*good, *bad} - {()}}
    return math.log((good[()] + 1) / (bad[()] + 1)), words, {k: math.log((between[k] + 0.5) / (n + 1)) for k, n in tags.items()}


#: Weight of words and tags within a part that is surely not of the article, which should hardly end an article around it.
PART = 0.002
#: Score of a word at most and at least.
MOST, LEAST = 1.0, -4.0


def scores(run: list[Token]) -> tuple[list[float], list[float]]:
    """Score of each token of a page, and of each of its words."""
    prior, known, tags = weights()
    each = [max(LEAST, min(MOST, prior + sum(known.get(f, 0.0) for f in own))) if own else 0.0 for own in _features(run)]
    out, met = [], set()
    for t, word in zip(run, each, strict=True):
        if t.unseen():
            word = LEAST
        part = PART if t.sure() else 1.0
        if not t.name:
            count = len(t.text.split())
            out.append(word * count * part)
            if count:
                met.clear()
        else:  # of equal tags between two words, the first counts
            out.append(0.0 if (t.name, t.opens) in met else part * tags.get((t.name, t.opens, t.rooted), tags[t.name in BLOCK, t.opens, t.rooted]))
            met.add((t.name, t.opens))
    return out, [LEAST if t.unseen() else word for t, word in zip(run, each, strict=True)]


def best_run(values: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the largest sum, which is over zero; of equal ones the one that ends first
    and then starts first. (0, 0) if there is none."""
    best, best_from, best_to, total, begin = 0.0, 0, 0, 0.0, 0
    for i, value in enumerate(values):
        if total <= 0:
            total, begin = 0.0, i
        total += value
        if total > best:
            best, best_from, best_to = total, begin, i + 1
    return best_from, best_to


def main_text(page: str) -> str:
    """The page's main text: blocks in order, joined by one space, white space in each turned into one space."""
    run = list(tokens(page))
    values, each = scores(run)
    start, stop = best_run(values)
    blocks, block = [], []
    for t, word in zip(run[start:stop], each[start:stop], strict=True):
        if not t.name:
            if word > 0 or not t.text.strip():
                block.append(t.text)
        elif t.name in BLOCK:
            blocks.append("".join(block))
            block = []
    blocks.append("".join(block))
    return " ".join(x for x in (" ".join(b.split()) for b in blocks) if x)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text (empty if none), n_chars (code points) of each page (page_id, url, html).

    Null and empty html give the empty text; repeated rows equal results; other columns are ignored.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches):
            text = [main_text(x) if x else "" for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
