"""Visible blocks of a page, read with one pass of a tag tokenizer.

A block is the visible text between two dividing tags; ``a b i em strong span`` do not divide.
Each block carries what later stages ask of it: the share of its text inside links and the
dividing elements around it.
"""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

INLINE = frozenset(("a", "b", "i", "em", "strong", "span"))
#: Elements that never have an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose end tag authors leave out: opening one closes an open one of the same group.
AUTO_CLOSE = {"p": ("p",), "li": ("li",), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "tr": ("tr", "td", "th", "p"), "option": ("option",), "dt": ("dt", "dd"), "dd": ("dt", "dd")}

_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|title)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)(?:</title\s*>|\Z)", re.S | re.I)


class Block(NamedTuple):
    text: str
    link_share: float
    path: tuple[str, ...]  # names of the dividing elements around it, outermost first
    ids: tuple[int, ...]  # their identities


def squeeze(text: str) -> str:
    """White space (no-break space too) to one blank, trimmed."""
    return " ".join(text.split())


def title_of(html: str) -> str:
    m = _TITLE.search(html)
    return squeeze(unescape(m.group(1))) if m else ""


def blocks_of(html: str) -> list[Block]:
    """The blocks of a page in order; a page without text gives none."""
    html = _HIDDEN.sub("\x00", html)
    out: list[Block] = []
    stack: list[tuple[str, int]] = []
    parts: list[str] = []
    linked = total = 0
    in_link = 0
    serial = 0
    pos = 0

    def flush() -> None:
        nonlocal linked, total
        if parts:
            text = squeeze("".join(parts))
            if text:
                out.append(Block(text, linked / max(1, total), tuple(s[0] for s in stack), tuple(s[1] for s in stack)))
            parts.clear()
        linked = total = 0

    def push(text: str) -> None:
        nonlocal linked, total
        if "&" in text:
            text = unescape(text)
        n = len(text) - text.count(" ")
        total += n
        if in_link:
            linked += n
        parts.append(text)

    for m in _TAG.finditer(html):
        if m.start() > pos:
            push(html[pos : m.start()].replace("\x00", ""))
        pos = m.end()
        name = m.group(2)
        if name is None:
            continue
        name = name.lower()
        closing = m.group(1) == "/"
        if name in INLINE:
            if name == "a":
                in_link = 0 if closing else 1
            continue
        flush()
        in_link = 0
        if name in VOID:
            continue
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
        else:
            shut = AUTO_CLOSE.get(name)
            while shut and stack and stack[-1][0] in shut:
                stack.pop()
            serial += 1
            stack.append((name, serial))
    if pos < len(html):
        push(html[pos:].replace("\x00", ""))
    flush()
    return out
