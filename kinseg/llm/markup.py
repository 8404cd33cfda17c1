"""Pages as flat blocks of text: a scanner of markup, and what elements say about the text in them.

Both take time in proportion to the page, however broken its markup is.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
GAP = re.compile(r"[\s/]*")
ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
#: Elements whose content is no markup up to their end tag. Of code also what follows where the end tag is missing.
RAW = frozenset("script style title textarea iframe xmp noembed noframes".split())
CODE = frozenset("script style".split())
#: Elements whose content is never text of the page, if they are closed; those of the first line may hold each other.
NESTING = frozenset("noscript template svg math object canvas audio video".split())
OPAQUE = frozenset("select button".split()) | NESTING
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A new one of these ends an open one of the same kind.
CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
FURNITURE_TAGS = frozenset("nav footer aside menu dialog".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
#: Words that name furniture by themselves or within a name; words that do so by themselves, but within a name only hint at it.
NAMED = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer login masthead menu modal nav navbar navigation newsletter pager pagination popup promo replies reply respond sidebar signup sponsor sponsored subscribe toolbar topbar widget".split())
HINTED = frozenset("form header notice notification promotion recommended related search share sharing social subscription".split())
#: With one of these a name tells what state a page is in, not what an element holds.
STATES = frozenset("closed disabled enabled free has hide is less no not off open show single with without".split())
ARTICLE_WORDS = frozenset("article content entry main post story".split())
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Token(NamedTuple):
    """A tag, or another piece of markup, whose tag is empty."""

    start: int
    end: int
    tag: str = ""
    closing: bool = False
    attributes: dict = {}


def scan(page: str) -> Iterator[Token]:
    """The markup of a page in order; what lies between is text.

    A quote that is never closed is an ordinary character, and where quotes leave
    a tag without end, tags end at the next > from there on. Markup that the
    page's end cuts off reaches up to it.
    """
    at, size, last, quotes = 0, len(page), page.rfind(">"), True
    endless: set[str] = set()
    while (start := page.find("<", at)) >= 0:
        first = page[start + 1 : start + 2]
        if first and not (first.isascii() and first.isalpha()) and first not in "/!?":
            at = start + 1
            continue
        if start > last:
            yield Token(start, size)
            return
        if page.startswith("<!--", start):
            end = start + 5 if page.startswith("<!-->", start) else page.find("-->", start + 4) + 3
            at = end if end > 2 else size
            yield Token(start, at)
            continue
        name = NAME.match(page, start + (2 if first == "/" else 1))
        if name is None:
            at = page.find(">", start) + 1
            yield Token(start, at)
            continue
        tag, found, i = name[0].lower(), {}, GAP.match(page, name.end()).end()
        stop = size if quotes else page.find(">", i)
        while i < stop and page[i] != ">":
            one = ATTRIBUTE.match(page, i, stop)
            found.setdefault(one[1].lower(), (one[2] or "").strip("\"'"))
            i = GAP.match(page, one.end(), stop).end()
        if i >= size:
            quotes, found, i = False, {}, page.find(">", start)
        at = i + 1
        if first != "/" and page[i - 1] == "/":
            found[""] = "/"
        yield Token(start, at, tag, first == "/", found)
        if first != "/" and tag in RAW and "" not in found and tag not in endless:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            if close is None:
                endless.add(tag)
            if close is not None or tag in CODE:
                end = close.start() if close is not None else size
                yield Token(at, end)
                at = end


def skipped(tokens: list[Token]) -> dict[int, int]:
    """For the number of each start tag of an OPAQUE element that has an end tag, the number of that."""
    found: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    for i, token in enumerate(tokens):
        if token.tag not in OPAQUE:
            continue
        above = opened.setdefault(token.tag, [])
        if token.closing:
            if above:
                found[above.pop()] = i
        elif "" not in token.attributes:
            if token.tag not in NESTING:
                above.clear()
            above.append(i)
    return found


def named(tag: str, attributes: dict, in_article: bool) -> tuple[int, bool]:
    """What class and id say: whether an element is furniture (2), may be (1) or neither, and whether they name the article."""
    furniture, article = 0, False
    if tag in ("html", "body"):
        return furniture, article
    for token in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        words = {w.lower() for w in WORD.findall(token)} - ({"header"} if in_article else set())
        if len(words) == 1:
            says = 2 if words & (NAMED | HINTED) else 0
        elif tag in ("article", "main") or words & STATES:
            says = 0
        else:
            says = 2 if words & NAMED else 1 if words & HINTED else 0
        furniture = max(furniture, says)
        article = article or (not says and not words & STATES and bool(words & ARTICLE_WORDS))
    return furniture, article


def marked(tag: str, attributes: dict, in_article: bool) -> tuple[bool, bool]:
    """What the element itself says: whether it is furniture or hidden, and whether it is the article."""
    role = attributes.get("role", "").lower()
    hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attributes.get("style", "")) is not None
    furniture = tag in FURNITURE_TAGS or (tag == "header" and not in_article) or role in FURNITURE_ROLES or hidden
    return furniture and tag not in ("html", "body"), tag in ("article", "main") or role == "main"


class Element:
    """An open element that matters to the text in it. `home`: the outermost element around it that is marked as article."""

    __slots__ = ("article", "by_name", "furniture", "home", "number", "parent", "sure", "tag", "words")

    def __init__(self, tag: str, parent: Element | None, attributes: dict, number: int):
        inside = parent is not None and parent.article
        self.tag, self.parent, self.number, self.words = tag, parent, number, 0
        furniture, self.sure = marked(tag, attributes, inside)
        says, article = named(tag, attributes, inside)
        self.furniture = furniture or (parent is not None and parent.furniture)
        self.by_name = 2 if tag == "form" else says
        self.article = inside or self.sure or article
        self.home = parent.home if inside else self if self.article else None


def cut(page: str) -> tuple[list[tuple], list[Element]]:
    """The blocks that hold text, as (text, words, share of linked words, element, heading level), and all elements, parents first."""
    found: list[tuple] = []
    elements = [Element("", None, {}, 0)]
    stack, opened = [elements[0]], {"": 1}
    parts: list[str] = []
    linked, heading, link_at, at = 0, 0, 0, 0

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            words = text.count(" ") + 1
            found.append((text, words, min(1.0, linked / words), stack[-1], heading))

    def close(depth: int) -> None:
        while len(stack) > depth:
            opened[stack.pop().tag] -= 1

    tokens = list(scan(page))
    ends = skipped(tokens)
    i = 0
    while i <= len(tokens):
        text = page[at : tokens[i].start if i < len(tokens) else len(page)]
        if text:
            parts.append(text)
            if link_at:
                linked += len(text.split())
        if i == len(tokens):
            break
        token, i = tokens[i], ends.get(i, i) + 1
        at = tokens[i - 1].end
        tag = token.tag
        if not tag or tag in OPAQUE or tag in RAW:
            continue
        if tag == "br":
            parts.append(" ")
        if tag in BLOCKS:
            flush()
            linked = 0
            heading = 0 if token.closing else int(tag[1]) if re.fullmatch("h[1-6]", tag) else 0
        if token.closing:
            if tag == "a":
                link_at = 0
            if opened.get(tag):
                depth = len(stack) - 1
                while stack[depth].tag != tag:
                    depth -= 1
                close(depth)
        elif tag not in VOID and "" not in token.attributes:
            while tag in CLOSES and stack[-1].tag in (*CLOSES[tag], "span", "a"):
                close(len(stack) - 1)
            if tag in BLOCKS or tag in ("span", "a"):
                own = Element(tag, stack[-1], token.attributes, len(elements))
                if tag in BLOCKS or own.by_name or own.furniture:
                    stack.append(own)
                    elements.append(own)
                    opened[tag] = opened.get(tag, 0) + 1
            if tag == "a" and "href" in token.attributes:
                link_at = len(stack)
        if len(stack) < link_at:
            link_at = 0
    flush()
    return found, elements


def blocks(page: str) -> list[tuple]:
    """The blocks of a page that hold text, in order: text, words, share of linked words, furniture (0 to 2), article, heading level.

    Furniture is 2 where an element says so, a class or id names it or a form
    holds it, 1 where a name only hints at it. Names and forms say nothing where
    they enclose the article: the element marked as such with most words, if it
    has at least as many as the page has outside it and outside furniture; nor
    does a form around more than half of the page. Article is 1 inside, -1 outside
    where the page marks one, 0 where it marks none. A mark by name alone counts
    only for such an element of most words.
    """
    found, elements = cut(page)
    for _, words, _, element, _ in found:
        if not element.furniture:
            element.words += words
    for element in reversed(elements[1:]):
        element.parent.words += element.words
    total = elements[0].words
    homes = [e for e in elements if e.home is e and not e.furniture and e.by_name < 2]
    article = max(homes, key=lambda e: e.words, default=None)
    void: set[int] = {e.number for e in elements if e.tag == "form" and 2 * e.words > total}
    says = {0: 0}
    for element in elements[1:]:
        says[element.number] = max(says[element.parent.number], element.by_name)
    loose = sum(words for _, words, _, e, _ in found if not e.furniture and not says[e.number] and e.home is not article)
    largest = article is not None and article.words >= loose
    while largest and (article := article.parent) is not None:
        void.add(article.number)
    for element in elements[1:]:
        says[element.number] = max(says[element.parent.number], 0 if element.number in void else element.by_name)
    trusted = {e.number for e in homes if e.sure or largest}
    any_home = any(e.home is not None and e.home.number in trusted for _, _, _, e, _ in found)
    out = []
    for text, words, linked, e, heading in found:
        inside = e.home is not None and (e.home.number in trusted or (e.home.sure and not e.home.furniture))
        out.append((text, words, linked, 2 if e.furniture else says[e.number], 1 if inside else -1 if any_home else 0, heading))
    return out
