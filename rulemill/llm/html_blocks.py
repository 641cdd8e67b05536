"""Flat text blocks of a page with shallow features."""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

#: Element names by role.
SCRIPT = "script style".split()  # what they hold is no markup: an end tag is missed up to the end of the page
SKIPPED = "noscript template svg title textarea select iframe object canvas audio video datalist".split()
BLOCK = (
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul"
).split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
BOILER = "nav header footer aside form menu dialog fieldset".split()
#: Words of class, id and role that name what isn't the article. Alone they are a strong hint; beside words
#: that say something else ("advert-free-post") a weak one, which the word counts and links around the block may outweigh.
HINTS = (
    "ad ads adv advert advertisement advertising adsense sponsor sponsored promo promotion banner sidebar rail widget menu nav navbar navigation "
    "breadcrumb breadcrumbs cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup popup modal overlay share sharing social "
    "related recommended recirc trending comment comments commentlist reply replies respond disqus discussion footer footnav header masthead topbar toolbar "
    "pagination pager login search form tags tagcloud legal copyright disclaimer paywall contentinfo complementary"
).split()
ARTICLE_HINTS = "article articles post posts entry entries story content contents main body text".split()
#: Words that say nothing about what a container holds.
NEUTRAL = "site page top bottom left right box wrapper wrap container block area section inner outer item items list row bar panel link links div id js wp".split()
#: Words that turn a hint round ("ad-free", "has-sidebar").
NEGATING = "free no non not without has have with is".split()
_HINTS, _ARTICLE_HINTS, _NEUTRAL, _NEGATING, _COMMENTS = set(HINTS), set(ARTICLE_HINTS), set(NEUTRAL), set(NEGATING), {"comment", "comments", "reply", "replies"}
_ATTRS = r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+"
_LEFT_OUT = r"<!--.*?(?:-->|\Z)|<(?P<script>" + "|".join(SCRIPT) + r")\b" + _ATTRS + r"(?<!/)>.*?(?:</(?P=script)\s*>|\Z)"
_TAG = re.compile(_LEFT_OUT + r"|<(?P<raw>" + "|".join(SKIPPED) + r")\b" + _ATTRS + r"(?<!/)>|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>" + _ATTRS + r")>|<[!?][^>]*>|</?[a-zA-Z][^<>]*>", re.S | re.I)
_PAIR = re.compile(_LEFT_OUT + r"|<(?P<raw>" + "|".join(SKIPPED) + r")\b" + _ATTRS + r"(?<!/)>|</(?P<end>" + "|".join(SKIPPED) + r")\s*>", re.S | re.I)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_WORDS = re.compile(r"\S+")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_BLOCK, _VOID, _BOILER = set(BLOCK), set(VOID), set(BOILER)
#: Elements that an opening tag of the name closes.
CLOSED_BY = {"p": {"p"}, "li": {"li", "p"}, "dd": {"dd", "dt", "p"}, "dt": {"dd", "dt", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"tr", "td", "th", "p"}, "option": {"option"}}
SCOPE = {"article", "body", "div", "section", "table", "ul", "ol", "main", "nav", "aside", "header", "footer", "form", "blockquote", "dl"}


@dataclass(slots=True)
class Block:
    """``article``: 2 in an article, 1 in a page's main part. ``hint``: 2 strong, 1 weak. ``link_words`` count buttons too."""

    text: str
    words: int
    link_words: int
    article: int
    boiler: int
    hint: int
    heading: int


def strength(token: str) -> tuple[int, int]:
    """(hint, article) of one name in a class, id or role."""
    parts = {p.lower() for p in _PARTS.findall(token)}
    against, article = parts & _HINTS, parts & _ARTICLE_HINTS
    if parts & _NEGATING:
        against = set()
    if not against:
        return 0, int(bool(article)) + int(bool(article - {"content", "contents", "main", "body", "text"}))
    if article and against == {"header"}:
        return 0, 0
    return (1 if parts - _HINTS - _ARTICLE_HINTS - _NEUTRAL else 2), 0


#: What an element adds to what it holds: main part, article, boilerplate element, weak hint, strong hint, hidden.
STATES = 6


def _flags(name: str, attrs: str) -> tuple[int, ...]:
    article, hint, hidden = {"main": 1, "article": 2}.get(name, 0), 0, 0
    if attrs and name not in ("html", "body"):
        tokens = [t for m in _ATTR.finditer(attrs) for t in m[2].strip("\"'").split()]
        found = [strength(t) for t in tokens]
        own = max((a for _, a in found), default=0)
        hint = max((h for h, _ in found), default=0)
        if name in ("article", "main") or (own and hint == 1):
            hint = 2 if any(h == 2 and _COMMENTS & {p.lower() for p in _PARTS.findall(t)} for t, (h, _) in zip(tokens, found)) else 0
        article = 0 if hint else max(article, own)
        hidden = int(bool(_HIDDEN.search(attrs)))
    return int(article > 0), int(article > 1), int(name in _BOILER), int(hint == 1), int(hint == 2), hidden


def _ends(html: str) -> dict[int, int]:
    """Where each skipped element that has an end tag ends, by where it starts. An end tag closes the last open element of its name."""
    ends, opened = {}, {}
    for m in _PAIR.finditer(html):
        if m["raw"]:
            opened.setdefault(m["raw"].lower(), []).append(m.start())
        elif m["end"] and opened.get(m["end"].lower()):
            ends[opened[m["end"].lower()].pop()] = m.end()
    return ends


def blocks_of(html: str) -> list[Block]:
    """Blocks with text, in page order. Character references are decoded; white space becomes one blank. What stands in
    ``head`` is skipped by element, so that its end tag may be missing; a skipped element without an end tag ends at the
    next tag of a block, a link or button with what it stands in."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[int, ...]]] = []
    state = [0] * STATES
    buffer: list[str] = []
    links: list[str] = []
    in_link, depth, at, heading, muted = 0, 0, 0, 0, False
    ends = _ends(html)

    def flush():
        nonlocal buffer, links, muted
        text = " ".join(unescape("".join(buffer)).split()) if buffer else ""
        if text and not state[5]:
            n = len(_WORDS.findall(text))
            article, hint = 2 if state[1] else int(state[0] > 0), 2 if state[4] else int(state[3] > 0)
            out.append(Block(text, n, min(n, len(unescape(" ".join(links)).split())), article, int(state[2] > 0), hint, heading))
        buffer, links, muted = [], [], False

    def pop():
        nonlocal in_link
        _, flags = stack.pop()
        if len(stack) < depth:  # a link or button without an end tag ends with what it stands in
            in_link = 0
        for i in range(STATES):
            state[i] -= flags[i]

    while m := _TAG.search(html, at):
        if m.start() > at and not muted:
            piece = html[at : m.start()]
            buffer.append(piece)
            if in_link:
                links.append(piece)
        at = m.end()
        name = m["name"]
        if name is None:
            if m["raw"]:
                if m["raw"].lower() == "title":
                    flush()
                at = ends.get(m.start(), at)
                muted = muted or m.start() not in ends
            continue
        name = name.lower()
        if name == "head":
            flush()
            continue
        if name == "option" and muted:  # of a list without an end tag
            continue
        if m["close"]:
            if name in ("a", "button"):
                in_link = 0
            elif name in _BLOCK:
                flush()
                heading = 0
                if any(x[0] == name for x in stack):
                    while stack[-1][0] != name:
                        pop()
                    pop()
            continue
        if name == "br":
            buffer.append(" ")
        elif name in ("a", "button"):
            in_link, depth = 1, len(stack)
        elif name in _BLOCK:
            flush()
            closing = CLOSED_BY.get(name)
            if closing:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in closing:
                        while len(stack) > k:
                            pop()
                        break
                    if stack[k][0] in SCOPE:
                        break
            elif stack and stack[-1][0] == "p":
                pop()
            heading = int(len(name) == 2 and name[0] == "h" and name[1].isdigit())
            if name not in _VOID and not m["attrs"].endswith("/"):
                flags = _flags(name, m["attrs"])
                stack.append((name, flags))
                for i in range(STATES):
                    state[i] += flags[i]
    if at < len(html) and not muted:
        buffer.append(html[at:])
    flush()
    return out
