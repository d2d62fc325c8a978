"""Main text of web pages by tag-path ratios.

Each text node has the path of block tags (with their classes) from the root to
it. Text length, punctuation and linked text are added up per path and divided
by the nodes on it; length and punctuation are smoothed over the nodes in page
order and fused into one score per path, which linked text lowers to nothing.

The scores decide twice. Paths above ``SHARE`` of the best score are strong;
the smallest element that holds ``MASS`` of their text is the article (grown to
strong text right beside it, from a ``section`` to the block around it, to the ``article`` or ``main``
around it, and to a parent where it is one block).
Within it the blocks on paths under ``LEAST_SHARE`` of the best score go: menus
and other blocks of links, whatever they are called. A list right after a heading, in
a block that isn't mostly links, stays as a list of sources does; a
heading goes if all that follows it up to the next one has gone.

Names decide less. Elements that by tag, role or class are never article text
(menus, forms, adverts, comments and so on) are marked, and go with all they
hold, unless they hold an ``article`` or ``main`` that isn't marked itself, or
nearly all strong text of the page where they are mere wrappers. A class counts
if the whole of it is such a word, or joins such words and mere places
(``cookie-notice``, ``left-sidebar``), never by a part (``side-effects``). Words that headings
and notes have too (``related``, ``search``, ``legal``) remove nothing inside
the article but blocks of links or form fields. Ids count outside
``article`` and ``main`` alone, on containers, in the same way; names of inline elements never.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from weftline.llm.common import with_columns

#: Parts of the best path score that make a path strong, and that a block inside the article needs.
SHARE, LEAST_SHARE = 0.1, 0.0005
#: Part of the strong text that the article holds, that a marked wrapper must hold to stay, and that stands beside an article to belong to it.
MASS, WRAPPER, BESIDE = 0.8, 0.75, 0.05
#: Weight of strong text inside an article or main element.
SEMANTIC = 1.5
# Element names of HTML by what they mean for text.
RAW = "script|style|noscript|template|iframe|svg|math|canvas|object|textarea|select|title|xmp|noembed|noframes"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NEVER = frozenset("head nav footer aside form button menu dialog fieldset legend audio video map".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
CONTAINERS = frozenset("body div section table tbody tr td main article".split())
HOLDERS = frozenset("div section table td ul ol".split())
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies".split())
FRAME = frozenset("nav navbar navigation menu breadcrumb breadcrumbs sidebar header footer masthead topbar".split())
FOREIGN = frozenset("ad ads advert adverts advertisement advertising adbox adslot sponsor sponsored promo promotion cookie cookies consent gdpr popup modal overlay newsletter pagination pager toolbar".split())
DOUBTFUL = frozenset("banner rail side notice notices alert subscribe subscription signup login share sharing social related recommended recommendations widget copyright legal disclaimer search tags skip hidden".split())
WORDS = COMMENTS | FRAME | FOREIGN | DOUBTFUL
PLACES = frozenset("page site main top bottom left right global primary secondary inner outer area bar block box container wrapper wrap section holder list item items link links post posts story stories articles icon icons button buttons text".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog".split())

_TAG = re.compile(rf"""<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>[^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*)>|<(?:/?[a-zA-Z][^>]*\Z|[!?/][^>]*(?:>|\Z))""", re.S | re.I)
_ATTR = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_JOINT = re.compile(r"[-_]+")
_PUNCT = re.compile(r"[.,;:!?…、。，；：！？]")
_SPACE = re.compile(r"\s+")


_SAME = {"td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
HEADINGS, LISTS = frozenset(("h2", "h3", "h4", "h5", "h6")), frozenset(("ul", "ol", "dl"))
#: Marks of an element: none, one that needs links or form fields inside the article, one that a wrapper may have by chance, one that only a real article inside lifts.
CLEAR, DOUBT, LOOSE, FIRM = 0, 1, 2, 3


def _telling(names: str) -> set[str]:
    """The telling words of a class attribute or an id."""
    found: set[str] = set()
    for name in names.split():
        parts = [p for p in _JOINT.split(name) if p]
        if all(p in WORDS or p in PLACES or p.isdigit() for p in parts):
            found.update(WORDS.intersection(parts))
    return found


def _mark(name: str, attrs: str, in_article: bool) -> int:
    if name in ("nav", "footer", "aside") or (name == "header" and not in_article):
        return FIRM
    mark = LOOSE if name in NEVER else CLEAR
    if not attrs or name in ("html", "body"):
        return mark
    for key, a, b, c in _ATTR.findall(attrs):
        key, value = key.lower(), (a or b or c).lower()
        if (key == "class" and name not in INLINE) or (key == "id" and not in_article and name in HOLDERS):
            words = _telling(value)
            if not COMMENTS.isdisjoint(words):
                return FIRM
            if in_article:
                words.discard("header")
            if words and name not in ("article", "main"):
                sure = FRAME if key == "id" else FRAME | FOREIGN
                mark = max(mark, DOUBT if sure.isdisjoint(words) else LOOSE)
        if (key == "role" and value in ROLES) or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")) or (key == "hidden" and value in ("", "hidden")):
            mark = max(mark, LOOSE)
    return mark


class Page:
    """Elements (parent, name, path and mark), text nodes (element, block, text, linked) and the elements of form fields of one page, in page order.

    Elements and paths are numbered, a path by its parent's and its own label,
    so deep nesting costs no more than flat pages.
    """

    def __init__(self, html: str):
        self.parent, self.name, self.path, self.mark = [-1], [""], [0], [CLEAR]
        self.nodes: list[tuple[int, int, str, bool]] = []
        self.fields: list[int] = []
        numbers: dict[tuple[int, str], int] = {}
        open_: list[tuple[str, int]] = []  # names of open elements with the element their text belongs to
        outer: list[str] = []  # names of the open elements that aren't inline
        count: dict[str, int] = {}
        block, at, here = 0, 0, 0

        def pop() -> None:
            nonlocal block, here
            name, here = open_.pop()
            count[name] -= 1
            if name not in INLINE:
                outer.pop()
                block += 1

        def text(raw: str) -> None:
            if raw:
                self.nodes.append((here, block, unescape(raw) if "&" in raw else raw, count.get("a", 0) > 0))

        for m in _TAG.finditer(html):
            if m.start() > at:
                text(html[at : m.start()])
            at = m.end()
            name = m["name"]
            if not name:
                if (m["raw"] or "").lower() in ("select", "textarea"):
                    self.fields.append(here)
                continue
            name = name.lower()
            if m["end"]:
                if count.get(name):
                    while open_[-1][0] != name:
                        pop()
                    pop()
                elif name not in INLINE:
                    block += 1
                continue
            if name == "br":
                text(" ")
                continue
            if name in VOID:
                block += name == "hr"
                if name == "input":
                    self.fields.append(here)
                continue
            inline = name in INLINE
            if not inline:
                block += 1
            if outer and ((name in CLOSES_P and outer[-1] == "p") or (open_[-1][0] in _SAME.get(name, (name,)) and name in ("li", "td", "th", "tr", "dt", "dd", "option"))):
                ends = "p" if outer[-1] == "p" and name in CLOSES_P else open_[-1][0]
                while open_[-1][0] != ends:
                    pop()
                pop()
            attrs = m["attrs"]
            if attrs.endswith("/") and name not in ("html", "body", "article", "main", "section", "div", "p"):
                continue
            open_.append((name, here))
            count[name] = count.get(name, 0) + 1
            if not inline:
                outer.append(name)
            plain = attrs == ""
            mark = CLEAR if plain and name not in NEVER and name != "header" else _mark(name, attrs, bool(count.get("article") or count.get("main")))
            if inline and mark == CLEAR:
                continue
            kind = "" if plain else next((a or b or c for key, a, b, c in _ATTR.findall(attrs) if key.lower() == "class"), "")
            self.path.append(self.path[here] if inline else numbers.setdefault((self.path[here], f"{name}.{kind}"), len(numbers) + 1))
            self.parent.append(here)
            self.name.append(name)
            self.mark.append(mark)
            here = len(self.parent) - 1
        if at < len(html):
            text(html[at:])


def path_scores(path: np.ndarray, length: np.ndarray, punct: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """The score of each path, from each node's path, text length, punctuation and linked length, in page order."""
    count = np.maximum(np.bincount(path), 1)
    per = lambda x: np.bincount(path, x) / count
    kernel = np.array([0.25, 0.5, 0.25])
    smooth = lambda x: np.convolve(np.pad(per(x)[path], 1, mode="edge"), kernel, "valid")
    share = np.bincount(path, linked) / np.maximum(np.bincount(path, length), 1)
    return per(smooth(length) * (1 + smooth(punct))) * np.maximum(0.0, 1 - 2 * share)


def _subtree(parent: list[int], own: np.ndarray) -> np.ndarray:
    """The sum over each element and all inside it; parents have smaller numbers."""
    out = own.tolist()
    for e in range(len(out) - 1, 0, -1):
        out[parent[e]] += out[e]
    return np.array(out)


def main_text(html: str | None) -> str:
    """The article of a whole page; empty for a null or empty page, and for one without text."""
    page = Page(html) if html else None
    real = [n for n in page.nodes if not n[2].isspace()] if page else []
    if not real:
        return ""
    element = np.array([n[0] for n in real])
    _, path = np.unique(np.array(page.path)[element], return_inverse=True)
    length = np.array([len(n[2].strip()) for n in real])
    punct = np.array([len(_PUNCT.findall(n[2])) for n in real])
    linked = np.where([n[3] for n in real], length, 0)
    score = path_scores(path, length, punct, linked)

    # what names mark goes, unless an article or nearly all strong text is inside
    n = len(page.parent)
    weight = np.where(score[path] >= SHARE * score.max(), length, 0) if score.max() > 0 else length
    held = _subtree(page.parent, np.bincount(element, weight, minlength=n))
    semantic = np.array([name in ("article", "main") for name in page.name])
    articles = _subtree(page.parent, (semantic & (np.array(page.mark) < FIRM)).astype(int))
    all_text, all_linked = (_subtree(page.parent, np.bincount(element, x, minlength=n)) for x in (length, linked))
    dense = (2 * all_linked >= all_text) | (_subtree(page.parent, np.bincount(np.array(page.fields, np.int64), minlength=n)) > 0)
    inside = np.zeros(n, bool)
    for e in range(1, n):
        inside[e] = inside[page.parent[e]] or semantic[e]

    def removed(article: np.ndarray) -> np.ndarray:
        """The elements that go where this is the article."""
        gone = np.zeros(n, bool)
        for e in range(1, n):
            mark = page.mark[e]
            if mark == DOUBT and article[e] and not dense[e]:
                mark = CLEAR
            lifted = articles[e] > 0 or (mark < FIRM and held[e] >= WRAPPER * held[0] > 0)
            gone[e] = gone[page.parent[e]] or (mark > CLEAR and not lifted)
        return gone

    gone = removed(inside)
    stays = ~gone[element]
    if not stays.any():
        return ""
    best = score[path[stays]].max()

    strong = np.where(stays & (score[path] >= SHARE * best), length * np.where(inside[element], SEMANTIC, 1.0), 0.0)
    mass = _subtree(page.parent, np.bincount(element, strong, minlength=n))
    root = int(np.flatnonzero(mass >= MASS * mass[0])[-1]) if mass[0] else 0
    # strong text that stands beside the root, not in a container of its own, is the article's too
    flat = np.array([name not in CONTAINERS for name in page.name])
    beside = np.bincount(element, strong, minlength=n) + np.bincount(np.array(page.parent)[element].clip(0), strong * flat[element], minlength=n)
    over = root
    while over:
        over = page.parent[over]
        if beside[over] >= BESIDE * mass[0] > 0:
            root = over
    # a section is a part of something: of the block around it, if that has more strong text
    while page.name[root] == "section" and mass[page.parent[root]] > mass[root]:
        root = page.parent[root]
    around = root
    while around and not semantic[around]:
        around = page.parent[around]
    if around:
        root = around
    elif root and flat[root]:
        root = page.parent[root]
    within = np.zeros(n, bool)
    within[root] = True
    for e in range(root + 1, n):
        within[e] = within[page.parent[e]]
    gone = removed(inside | within)
    titles = [e for e in range(n) if page.name[e] == "h1" and not gone[e]]
    if len(titles) == 1:  # a title above the article
        within[titles[0]] = True

    keep = {e for e in range(n) if within[e] and not gone[e]}
    before, last = [0] * n, {}
    for e in range(1, n):
        before[e] = last.get(page.parent[e], 0)
        last[page.parent[e]] = e
    listed = np.zeros(n, bool)
    for e in range(1, n):
        p = page.parent[e]
        listed[e] = listed[p] or (page.name[e] in LISTS and page.name[before[e]] in HEADINGS and not gone[before[e]] and 2 * all_linked[p] < all_text[p])
    good = {p: score[k] >= LEAST_SHARE * best for p, k in zip(np.array(page.path)[element].tolist(), path.tolist())}
    blocks: dict[int, list] = {}
    for e, block, text, link in page.nodes:
        if e in keep and (listed[e] or good.get(page.path[e], True)):
            blocks.setdefault(block, []).append((e, text, link))
    for block, parts in list(blocks.items()):
        links = [t for _, t, link in parts if link and not t.isspace()]
        # a block of several links and nothing else is a menu on whatever path
        if len(links) > 1 and not listed[parts[0][0]] and all(link or not any(map(str.isalnum, t)) for _, t, link in parts):
            del blocks[block]

    # a heading goes with what followed it
    own = np.bincount(np.array([e for parts in blocks.values() for e, t, _ in parts if not t.isspace()], np.int64), minlength=n)
    kept = _subtree(page.parent, own) > 0
    alone, follows = set(), {}
    for e in range(n - 1, 0, -1):
        p = page.parent[e]
        if page.name[e] in HEADINGS:
            if follows.pop(p, True) is False and not own[p]:
                alone.add(e)
        elif all_text[e]:
            follows[p] = follows.get(p, False) or bool(kept[e])
    lines = [_SPACE.sub(" ", "".join(t for e, t, _ in parts if e not in alone)).strip() for parts in blocks.values()]
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """Add the main text of each whole page; a null or empty page, or one without text, has an empty one.

    Repeated rows have a result each; other columns stay, one named like ``text_col`` is replaced.
    """
    return with_columns(pages, html_col, [T.StructField(text_col, T.StringType())], lambda: lambda pages: [[main_text(x) for x in pages.to_pylist()]])
