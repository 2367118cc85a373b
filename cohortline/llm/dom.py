"""A small forgiving HTML reader: elements in document order as parallel lists.

Comments, declarations and the insides of scripts, styles and other unshown
elements are left out (formulas are shown); unclosed paragraphs, list items and table cells end where
the next begins; an end tag without its start tag is ignored."""

from __future__ import annotations

import html as _html
import re
from dataclasses import dataclass, field

# fixed values: element names by how HTML treats them
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MATH = "math mi mo mn ms mtext mrow msup msub msubsup mfrac msqrt mroot mstyle munder mover munderover mpadded mphantom semantics"
INLINE = frozenset(f"{MATH} a abbr b bdi bdo big cite code data dfn em font i ins kbd label mark q s samp small span strike "
                   "strong sub sup time tt u var wbr del br img".split())
UNSHOWN = frozenset("script style noscript template title iframe object canvas svg textarea select annotation annotation-xml audio video".split())
# of these only the end tag ends, whatever the start tag looks like
RAW_TEXT = frozenset("script style noscript template title iframe textarea".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
                     "h6 header hr main menu nav ol p pre section table ul".split())
SIBLING_END = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
               "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
               "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

# a quote opens a value only right after the equals sign; elsewhere it is a character like any other
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>|<[!?/][^>]*>", re.S)
_UNQUOTED_SLASH = re.compile(r"=\s*[^\s\"'][^\s]*/\Z")
_ATTR = re.compile(r"([^\s=/\"'<>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")


@dataclass
class Page:
    tag: list[str] = field(default_factory=lambda: ["#page"])
    attrs: list[str] = field(default_factory=lambda: [""])
    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    #: in document order: (element, text) or (element, None) where a block starts or ends
    runs: list[tuple[int, str | None]] = field(default_factory=list)


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): _html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)}


def parse(source: str) -> Page:
    page = Page()
    stack = [0]
    at = 0
    runs, tags = page.runs, page.tag
    find = _MARKUP.search
    while True:
        m = find(source, at)
        if m is None:
            if at < len(source):
                runs.append((stack[-1], source[at:]))
            return page
        if m.start() > at:
            runs.append((stack[-1], source[at:m.start()]))
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:                                          # an end tag
            _end(name, stack, tags, runs)
            continue
        raw = m[3]
        if name in UNSHOWN:
            closed = raw.endswith("/") and name not in RAW_TEXT and not _UNQUOTED_SLASH.search(raw)
            if not closed:
                end = re.compile(f"</{re.escape(name)}\\s*>", re.I).search(source, at)
                if end:
                    at = end.end()
                elif name in RAW_TEXT:
                    at = len(source)
            continue
        if name in CLOSES_P:
            _close(stack, tags, runs, {"p"}, {"button", "table", "td", "li", "div", "article", "section"})
        if name in SIBLING_END:
            _close(stack, tags, runs, *SIBLING_END[name])
        if name == "br":
            runs.append((stack[-1], " "))
            continue
        if name not in INLINE:
            runs.append((stack[-1], None))
        if name in VOID:
            continue
        tags.append(name)
        page.attrs.append(raw)
        page.parent.append(stack[-1])
        page.depth.append(len(stack))
        stack.append(len(tags) - 1)


def _close(stack, tags, runs, names, within) -> None:
    for k in range(len(stack) - 1, 0, -1):
        t = tags[stack[k]]
        if t in names:
            del stack[k:]
            runs.append((stack[-1], None))
            return
        if t in within:
            return


def _end(name, stack, tags, runs) -> None:
    inline = name in INLINE
    for k in range(len(stack) - 1, 0, -1):
        t = tags[stack[k]]
        if t == name:
            del stack[k:]
            if not inline:
                runs.append((stack[-1], None))
            return
        if inline and t not in INLINE:
            return


def block_texts(page: Page, keep) -> list[str]:
    """Texts of the blocks, of the elements that ``keep`` holds, in page order."""
    out, held = [], []
    for element, text in page.runs:
        if text is None:
            if held:
                s = " ".join(_html.unescape("".join(held)).split())
                if s:
                    out.append(s)
                held = []
        elif keep[element]:
            held.append(text)
    if held:
        s = " ".join(_html.unescape("".join(held)).split())
        if s:
            out.append(s)
    return out
