"""Where the article of a page is: its headline, its container, and what there isn't of the article."""

from __future__ import annotations

import re

from wordmill.llm.html import Block

#: Elements that a paragraph-like block may stand in without leaving the article's container.
_WRAP = frozenset(("p", "ul", "ol", "li", "blockquote", "q", "dl"))
ASIDE = frozenset(("figure", "figcaption", "aside", "nav", "footer", "header", "form", "button", "label", "select", "menu"))
LINK_SHARE = 0.5

_DATE = r"\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{4}-\d{2}-\d{2}|\d{1,2}\s+(?:янв|фев|мар|апр|мая|май|июн|июл|авг|сен|окт|ноя|дек|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\w*\.?(?:\s+\d{4})?(?:\s*г\.?)?"
_META = re.compile(
    rf"(?:(?:{_DATE})(?:,?\s*(?:в|at)?\s*\d{{1,2}}:\d{{2}}(?::\d{{2}})?)?|\d{{1,2}}:\d{{2}}"
    r"|(?:автор|авторы|текст|фото|рубрика|раздел|категория|просмотров|просмотры|прочитали|источник|дата|опубликовано|обновлено|материал|теги|метки|комментариев|by|author|views|section|category|published|updated|posted|tags|photo)\s*:\s.*"
    r"|by [A-Z].{0,60}|\d+\s+(?:просмотр\w*|views|комментари\w*|comments))",
    re.I | re.S,
)
#: Prompts to share, subscribe, write or read elsewhere; they close without a sentence mark.
_PROMPT = re.compile(
    r"(?:поделит[её]сь|поделиться|расскажите|отправить|отправьте|подпишитесь|подписывайтесь|подписаться|присылайте|пришлите|сообщите|читайте|смотрите|ранее мы|по теме|реклама|на правах рекламы|партн[её]рский материал|следите|скачайте|оставьте|оставить|комментарии|обсудить|распечатать|наверх|далее"
    r"|share|tweet|subscribe|follow us|sign up|read more|read also|related|advertisement|sponsored|comments?|print|send (?:us|link)|tell your friends)\b",
    re.I,
)
#: Prompts to share close an article.
_SHARE = re.compile(r"(?:поделит[её]сь|поделиться|расскажите|рассказать|отправить|отправьте|share|tweet|tell your friends|send)\b", re.I)
_SENTENCE_END = re.compile(r"[.!?…;:][»”\")\]]*$")


def is_meta(text: str) -> bool:
    """Byline, date, views, section."""
    return len(text) < 160 and _META.fullmatch(text) is not None


def is_prompt(text: str) -> bool:
    return len(text) < 160 and _PROMPT.match(text) is not None and not _SENTENCE_END.search(text)


def ends_sentence(text: str) -> bool:
    return _SENTENCE_END.search(text) is not None


def owner(b: Block) -> int:
    """The element a block belongs to as a paragraph, heading or list item; 0 outside all."""
    k = len(b.ids) - 1
    name = b.path[k] if k >= 0 else ""
    if name in ("article", "main", "section", "td", "th", "body", "html"):
        return b.ids[k]
    k -= 1
    while k >= 0 and b.path[k] in _WRAP:
        k -= 1
    return b.ids[k] if k >= 0 else 0


def aside(b: Block) -> bool:
    return any(p in ASIDE for p in b.path[-2:])


def within(b: Block, container: int) -> bool:
    """A block of the container itself: text directly in it, or in a paragraph-like element of it."""
    return (bool(b.ids) and b.ids[-1] == container) or owner(b) == container


def headline(blocks: list[Block], title: str) -> int | None:
    """The block that the page's title repeats, else the first heading of the highest levels."""
    folded = title.casefold()
    best = None
    for k, b in enumerate(blocks):
        if b.link_share < LINK_SHARE and not is_meta(b.text) and folded.startswith(b.text.casefold()) and not aside(b):
            rest = title[len(b.text) :].strip()
            if not rest or not rest[0].isalnum():
                if b.path and b.path[-1] in ("h1", "h2"):
                    return k
                best = k if best is None else best
    heads = [k for k, b in enumerate(blocks) if b.path and b.path[-1] in ("h1", "h2") and b.link_share < LINK_SHARE and not aside(b)]
    if heads and (best is None or blocks[best].path[-1:] == ("body",)):
        return heads[0]
    return best


def container_of(blocks: list[Block], head: int | None) -> int:
    """The element that holds the article: the headline's, else the one with most text of its own."""
    if head is not None:
        return owner(blocks[head]) if blocks[head].path and blocks[head].path[-1] not in ("body", "td") else blocks[head].ids[-1]
    sums: dict[int, int] = {}
    for k, b in enumerate(blocks):
        if b.link_share < LINK_SHARE and not aside(b) and not is_prompt(b.text):
            sums[owner(b)] = sums.get(owner(b), 0) + len(b.text)
    return max(sums, key=lambda c: (sums[c], -c), default=0)


def _prose(b: Block) -> bool:
    return b.link_share < LINK_SHARE and ends_sentence(b.text) and not is_prompt(b.text) and not is_meta(b.text) and not aside(b)


def nested(blocks: list[Block], head: int | None, container: int) -> set[int]:
    """Blocks of the elements inside the container that are of the article: without
    asides, elements that a prompt opens and lists of links. Right in the body, where the site's
    elements stand too, only if the container has no prose of its own, and then those of the element
    with most text."""
    groups: dict[int, list[int]] = {}
    own, body = False, False
    for k in range(head + 1 if head is not None else 0, len(blocks)):
        b = blocks[k]
        if within(b, container):
            own = own or (_prose(b))
        elif container in b.ids:
            at = b.ids.index(container)
            body = b.path[at] in ("body", "html")
            groups.setdefault(b.ids[at + 1], []).append(k)
    text = {}
    for c, rows in groups.items():
        links = sum(blocks[k].link_share >= LINK_SHARE for k in rows)
        if is_prompt(blocks[rows[0]].text) or (links > 1 and 3 * links >= len(rows)):
            continue
        kept = [k for k in rows if not any(p in ASIDE for p in blocks[k].path[blocks[k].ids.index(container) + 1 :])]
        if any(_prose(blocks[k]) for k in kept):
            text[c] = kept
    if body:
        most = max(text, key=lambda c: sum(len(blocks[k].text) for k in text[c]), default=None)
        return set() if own or most is None else set(text[most])
    return {k for rows in text.values() for k in rows}


def article_blocks(blocks: list[Block], head: int | None, container: int) -> list[int]:
    """Blocks of the container from the headline on, without captions, meta lines, links and prompts.

    A prompt to share ends the article if no prose of the container follows it. Right in the body,
    where the site's own lines stand too, prose behind another element doesn't count."""
    inner = nested(blocks, head, container)
    first = head if head is not None else 0
    last = -1
    for k in range(first, len(blocks)):
        b = blocks[k]
        if not within(b, container) and k not in inner and k != head:
            if last >= 0 and b.ids and container in b.ids and b.path[b.ids.index(container)] in ("body", "html"):
                break
        elif k == head or (_prose(b)):
            last = k
    out = []
    for k in range(first, len(blocks)):
        b = blocks[k]
        if k > last and k != head and is_prompt(b.text) and _SHARE.match(b.text) and (out or head is not None) and (within(b, container) or b.ids and container in b.ids):
            break
        if (k == head or within(b, container) or k in inner) and not aside(b) and b.link_share < LINK_SHARE and (k == head or not (is_meta(b.text) or is_prompt(b.text))):
            out.append(k)
    return out
