"""Text lines of a web page, each with the marked regions of the page that it stands in."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

# Element names and words that say what a part of a page is.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
UNSEEN = frozenset("applet audio canvas datalist iframe map math noembed noframes noscript object rp script select style svg template textarea title video xmp".split())
IN_HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
CHROME = {"nav": "menu", "menu": "menu", "aside": "sidebar", "footer": "footer", "header": "header", "form": "form", "button": "form", "dialog": "notice", "head": "head"}
ROLES = {
    "navigation": "menu", "menu": "menu", "menubar": "menu", "banner": "header", "contentinfo": "footer", "complementary": "sidebar", "search": "form",
    "form": "form", "alert": "notice", "alertdialog": "notice", "dialog": "notice", "status": "notice",
}
WORDS = {
    "menu": "breadcrumb breadcrumbs menu menubar nav navbar navigation pager pagination skip toolbar topbar",
    "header": "header masthead",
    "footer": "copyright footer colophon",
    "sidebar": "aside blogroll recommended related sidebar widget widgets",
    "notice": "alert banner consent cookie cookies disclaimer gdpr modal notice notification overlay popup",
    "advert": "ad ads adsense advert advertisement advertising adverts adslot dfp promo promotion sponsor sponsored",
    "form": "login newsletter optin register search signin signup subscribe subscription",
    "share": "share sharing social",
    "comments": "comment comments commentlist disqus replies reply respond",
}
LABEL_OF = {word: label for label, words in WORDS.items() for word in words.split()}

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|</(?![a-zA-Z])[^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?>=\s*+"[^"]*+"|=\s*+'[^']*+'|[^>])*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(?:^|[\s/"'])(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|(?=[\s/]|$))""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Names whose start ends an open element of a name, up to an enclosing one.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}


class Line(NamedTuple):
    text: str
    label: str | None  # of the outermost marked region around it: menu, footer, advert and so on
    region: int  # number of that region
    article: bool  # inside the page's article
    main: bool


class _Open(NamedTuple):
    name: str
    region: int


class _Region(NamedTuple):
    above: int
    kind: str  # "article", "main" or a label
    weak: bool  # marked by a word of a class or id only


def _kind(name: str, rest: str, in_article: bool) -> tuple[str, bool] | None:
    """What a start tag marks, and whether only a word says so."""
    if name in CHROME and not (name == "header" and in_article):
        return CHROME[name], False
    found = {}
    if rest:
        for m in ATTRIBUTE.finditer(rest):
            found.setdefault(m[1].lower(), (m[2] or "").strip("\"'"))
    words = [w.lower() for w in WORD.findall(f"{found.get('class', '')} {found.get('id', '')}")] if found else []
    if name == "article" or found.get("itemprop", "").lower() == "articlebody":
        return ("comments", False) if any(LABEL_OF.get(w) == "comments" for w in words) else ("article", False)
    role = found.get("role", "").lower()
    if name == "main" or role == "main":
        return "main", False
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true":
        return "hidden", False
    if role in ROLES and not (role == "banner" and in_article):
        return ROLES[role], False
    if words and name not in ("html", "body", "h1", "h2", "h3", "h4", "h5", "h6", "p" if in_article else ""):
        for w in words:
            if w in LABEL_OF and not (in_article and LABEL_OF[w] == "header"):
                return LABEL_OF[w], True
    return None


def _blocks(page: str) -> tuple[list[tuple[str, int]], list[_Region]]:
    """Texts of blocks with the innermost region each stands in, and all regions. Region 0 is the page."""
    regions, lines = [_Region(-1, "page", False)], []
    stack: list[_Open] = []
    count: dict[str, int] = {}
    words: list[tuple[int, str]] = []
    region, at, inside = 0, 0, [False]  # inside: of each region, whether it stands in an article

    def flush() -> None:
        nonlocal words
        # A marked part inside a block is a line of its own, and the block goes on behind it.
        parts: dict[int, list[str]] = {}
        for own, text in words:
            parts.setdefault(own, []).append(text)
        for own, texts in parts.items():
            if text := " ".join("".join(texts).split()):
                lines.append((text, own))
        words = []

    def cut(to: int) -> None:
        """Close the elements above a place of the stack."""
        nonlocal region
        for e in stack[to:]:
            count[e.name] -= 1
        del stack[to:]
        region = stack[-1].region if stack else 0

    def up_to(names: set, walls: set) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k].name in names:
                return cut(k)
            if stack[k].name in walls:
                return None
        return None

    while m := TOKEN.search(page, at):
        if m.start() > at:
            words.append((region, html.unescape(page[at : m.start()])))
        at, name = m.end(), m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name in BLOCKS:
                flush()
            if count.get(name):
                k = next(k for k in range(len(stack) - 1, -1, -1) if stack[k].name == name)
                if name in BLOCKS or not any(e.name in BLOCKS for e in stack[k + 1 :]):
                    cut(k)
            continue
        if name in UNSEEN:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
            if not (m[3].endswith("/") and name in ("svg", "math")):
                at = end.end() if end else len(page)
            continue
        if name == "br":
            words.append((region, " "))
            continue
        if count.get("head") and name not in IN_HEAD and name != "head":
            flush()
            cut(next(k for k, e in enumerate(stack) if e.name == "head"))
        if name in BLOCKS:
            flush()
            if count.get("p"):
                up_to({"p"}, BLOCKS - {"p"})
            if name in CLOSES and count.get(name) is not None:
                up_to(*CLOSES[name])
        if name in VOID:
            continue
        kind = _kind(name, m[3], inside[region]) if m[3].strip() or name in CHROME or name in ("article", "main") else None
        if kind:
            regions.append(_Region(region, *kind))
            inside.append(inside[region] or kind[0] == "article")
            region = len(regions) - 1
        stack.append(_Open(name, region))
        count[name] = count.get(name, 0) + 1
    words.append((region, html.unescape(page[at:])))
    flush()
    return lines, regions


def lines_of(page: str | None) -> list[Line]:
    """The page's blocks in order, references decoded, white space as one space. A region that only a word marks does not count
    if the page has its only articles inside; null and pages without text have no lines."""
    lines, regions = _blocks(page or "")
    size = [0] * len(regions)
    for text, region in lines:
        size[region] += len(text)
    marked, article, main = _resolve(regions, frozenset())
    own = [k for k, r in enumerate(regions) if r.kind == "article"]
    if own and not any(size[k] for k in range(len(regions)) if article[k] and not marked[k]):
        for k in range(len(regions) - 1, 0, -1):
            size[regions[k].above] += size[k]
        best = max(own, key=lambda k: (size[k], -k))
        around, k = set(), regions[best].above
        while k >= 0:
            if regions[k].weak:
                around.add(k)
            k = regions[k].above
        marked, article, main = _resolve(regions, frozenset(around))
    return [Line(text, regions[marked[r]].kind if marked[r] else None, marked[r], bool(article[r]), bool(main[r])) for text, r in lines]


def _resolve(regions: list[_Region], lifted: frozenset) -> tuple[list[int], list[int], list[int]]:
    """Of each region: the outermost marked region, the article and the main part around it (0: none)."""
    marked, article, main = [0], [0], [0]
    for k, r in enumerate(regions[1:], 1):
        up = r.above
        mark = r.kind not in ("article", "main") and k not in lifted
        marked.append(marked[up] or (k if mark else 0))
        article.append(article[up] or (k if r.kind == "article" and not marked[k] else 0))
        main.append(main[up] or (k if r.kind == "main" and not marked[k] else 0))
    return marked, article, main

