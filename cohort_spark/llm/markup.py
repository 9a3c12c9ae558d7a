"""HTML to lines: one per block, with what the markup says about its place.

A tolerant reader for broken pages: unclosed paragraphs, list items and formatting, stray end tags,
text cut off inside a tag. It follows the usual rules of browsers as far as text and nesting matter.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

# --- fixed values: element names -----------------------------------------------------------------

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Their content is no markup; the whole element goes.
RAW = frozenset("iframe noembed noframes noscript script style textarea title".split())
BLOCKS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
BREAKS = BLOCKS | frozenset("body caption dd dt head html legend li optgroup option tbody tfoot thead tr".split())
CONTAINERS = frozenset("article aside details dialog div dl fieldset footer form header main menu nav ol section table ul".split())
HEADINGS = frozenset("h2 h3 h4 h5 h6".split())
# An end tag that is left out: what an opening tag closes, and where the search for it stops.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select", "datalist"}),
}
ASIDE_TAGS = frozenset("aside audio button canvas datalist dialog footer menu nav object search select svg template video".split())
ASIDE_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search searchbox toolbar".split()
)
# Words in class and id values that name something beside the article.
ASIDE_WORDS = frozenset(
    "ad ads adsense advert advertisement advertising adverts banner breadcrumb breadcrumbs comment commentlist comments consent "
    "cookie cookies copyright disqus discussion footer form gdpr header login masthead menu menubar modal nav navbar navigation "
    "newsletter notice notices overlay pager pagination paywall popup promo promoted promotion recommended related replies reply "
    "respond search share sharing sidebar signin signup social sponsor sponsored submenu subscribe subscription toc toolbar "
    "widget widgets".split()
)
# Before such a word, these take it back; before "header", those name a part of the article.
WITHOUT = frozenset("has hide no non show with without".split())
OF_ARTICLE = frozenset("article content entry page post section story title".split())

# --- reader --------------------------------------------------------------------------------------

_MARKUP = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<[!?/](?![a-zA-Z])[^>]*(?:>|\Z)|<![^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SOFT, _HARD = 1, 2


@dataclass
class Line:
    """Text of one block, its characters outside links, and the element it stands in."""

    text: str
    plain: int
    node: int


@dataclass
class Page:
    """Elements in page order, with parents and last descendants, and the lines."""

    names: list[str]
    parents: list[int]
    lasts: list[int]
    marks: list[int]
    lines: list[Line]

    def inside(self, node: int, outer: int) -> bool:
        return outer <= node <= self.lasts[outer]


def _named_aside(value: str, article: bool) -> bool:
    for name in value.split():
        if article:
            # An article is set aside by a whole name only; it often carries words like "comments-open".
            if name.lower() in ASIDE_WORDS:
                return True
            continue
        before = ""
        for word in (w.lower() for w in _WORD.findall(name)):
            if word in ASIDE_WORDS and before not in WITHOUT and not (word == "header" and before in OF_ARTICLE):
                return True
            before = word
    return False


def _mark(name: str, attributes: str) -> int:
    """Whether an element is beside the article: surely, by its name only, or not."""
    if name in ASIDE_TAGS:
        return _HARD
    mark = _SOFT if name == "form" else 0
    if attributes.strip() and name not in ("html", "body"):
        for key, *values in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), html.unescape("".join(values))
            if key == "hidden" or (key == "style" and _HIDDEN.search(value)):
                return _HARD
            if key == "role" and value.strip().lower() in ASIDE_ROLES:
                mark = max(mark, _SOFT if value.strip().lower() == "form" else _HARD)
            elif key in ("class", "id") and not mark and _named_aside(value, name in ("article", "main")):
                mark = _SOFT
            elif key == "role" and value.strip().lower() == "main":
                mark = -1
    return mark


def read(source: str) -> Page:
    """The page's elements and lines."""
    page = Page(["#"], [-1], [0], [0], [])
    names, parents, lasts, marks = page.names, page.parents, page.lasts, page.marks
    stack, opened = [0], {}
    text: list[str] = []
    plain, links = 0, 0

    def end_line() -> None:
        nonlocal plain
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                page.lines.append(Line(joined, min(plain, len(joined)), stack[-1]))
            text.clear()
        plain = 0

    def close_one() -> None:
        nonlocal links
        node = stack.pop()
        lasts[node] = len(names) - 1
        opened[names[node]] -= 1
        links -= names[node] == "a"

    def close_to(name: str, stops: frozenset[str] | set[str] = frozenset()) -> None:
        """Close the innermost open ``name`` and all in it, unless one of ``stops`` comes first."""
        if not opened.get(name):
            return
        depth = len(stack) - 1
        while names[stack[depth]] != name:
            if names[stack[depth]] in stops:
                return
            depth -= 1
        while len(stack) > depth:
            close_one()

    position, size = 0, len(source)
    while position < size:
        found = _MARKUP.search(source, position)
        until = found.start() if found else size
        if until > position:
            piece = html.unescape(source[position:until])
            text.append(piece)
            if not links:
                plain += len(piece.strip())
        if not found:
            break
        position = found.end()
        slash, name, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if not name:
            continue
        name = name.lower()
        if name in RAW:
            if not slash:
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(source, position)
                if end:
                    position = end.end()
                elif name in ("script", "style"):
                    position = size
            continue
        if name in BREAKS:
            end_line()
        elif name in ("br", "td", "th"):
            text.append(" ")
        if slash:
            # A formatting element does not close the blocks opened in it.
            close_to(name, frozenset() if name in BREAKS or name in ("td", "th") else BREAKS)
            continue
        if name in BLOCKS:
            close_to("p", {"table", "td", "th", "button", "object"})
        if name in IMPLIED:
            closes, stops = IMPLIED[name]
            for other in closes:
                close_to(other, stops)
        if name in VOID:
            continue
        names.append(name)
        parents.append(stack[-1])
        lasts.append(len(names) - 1)
        marks.append(_mark(name, attributes))
        stack.append(len(names) - 1)
        opened[name] = opened.get(name, 0) + 1
        links += name == "a"
    end_line()
    while len(stack) > 1:
        close_one()
    lasts[0] = len(names) - 1
    return page
