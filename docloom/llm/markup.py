"""Tags and text of HTML in one pass, in time linear in the page.

Follows the living standard where a page is well-formed. Unclosed markup ends at the end of
the page: an open comment, tag, script or style hides the rest. Where a quote in a tag never
closes, that tag and the later ones end at their first ``>``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

# Fixed values of HTML: elements whose content is text up to their own end tag.
RAW_TEXT = frozenset("script style textarea title xmp iframe noembed noframes".split())

_NAME = re.compile(r"[^\s/>]+")
_VALUE = re.compile(r"""=\s*+(["'])""")
_COMMENT_END = re.compile("--!?>")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.IGNORECASE) for t in RAW_TEXT}
_ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?""")


def attributes(body: str) -> dict[str, str]:
    """Attributes of a tag's inside; the first of equal names counts."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(body):
        name = m[1].lower()
        if name not in found:
            value = m[2] or m[3] or m[4] or ""
            found[name] = unescape(value) if "&" in value else value
    return found


def _tag_end(html: str, at: int, quoted: bool) -> tuple[int, bool]:
    """Position of the ``>`` that closes the tag whose inside starts at ``at`` (-1: none), and whether quotes still count."""
    first = html.find(">", at)
    if first < 0 or not quoted:
        return first, quoted
    if html.find('"', at, first) < 0 and html.find("'", at, first) < 0:
        return first, True
    k = at
    while True:
        # A quote opens a value only after an equals sign.
        end = html.find(">", k)
        if end < 0:
            return first, False
        m = _VALUE.search(html, k, end)
        if m is None:
            return end, True
        close = html.find(m[1], m.end())
        if close < 0:
            return first, False
        k = close + 1


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("start", name, inside of the tag) and ("end", name, "") in page order; text is decoded."""
    at, n, quoted = 0, len(html), True
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            text = html[at:lt]
            yield "text", unescape(text) if "&" in text else text, ""
            at = lt
            continue
        two = html[at + 1 : at + 2]
        if two.isascii() and two.isalpha():
            name = _NAME.match(html, at + 1)
            end, quoted = _tag_end(html, name.end(), quoted)
            if end < 0:
                return
            tag = name[0].lower()
            yield "start", tag, html[name.end() : end]
            at = end + 1
            if tag in RAW_TEXT:
                close = _RAW_END[tag].search(html, at)
                if close is None:
                    return
                text = html[at : close.start()]
                if text:
                    yield "text", unescape(text) if tag in ("textarea", "title") else text, ""
                at = close.start()
        elif two == "/" and html[at + 2 : at + 3].isascii() and html[at + 2 : at + 3].isalpha():
            name = _NAME.match(html, at + 2)
            end = html.find(">", name.end())
            if end < 0:
                return
            yield "end", name[0].lower(), ""
            at = end + 1
        elif html.startswith("<!--", at):
            if html.startswith((">", "->"), at + 4):
                at = html.index(">", at + 4) + 1
                continue
            end = _COMMENT_END.search(html, at + 4)
            if end is None:
                return
            at = end.end()
        elif two and two in "!?/":
            end = html.find(">", at + 2)
            if end < 0:
                return
            at = end + 1
        else:
            yield "text", "<", ""
            at += 1
