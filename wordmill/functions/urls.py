"""URLs and pages as columns: normalisation, hosts, text and links of HTML."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normal_url(url: Column, drop_query: bool = True, drop_fragment: bool = True) -> Column:
    """Lower-case authority; query and fragment dropped if asked for. Stays in the JVM."""
    u = F.regexp_replace(url, "#.*$" if drop_fragment else "#$", "")
    if drop_query:
        u = F.regexp_replace(u, "\\?[^#]*" if not drop_fragment else "\\?.*$", "")
    head = F.regexp_extract(u, "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*", 0)
    scheme = F.lower(F.regexp_extract(head, "^[A-Za-z][A-Za-z0-9+.-]*:", 0))
    authority = F.lower(F.regexp_extract(head, "//.*$", 0))
    return F.when(F.char_length(head) > 0, F.concat(scheme, authority, F.substring(u, F.char_length(head) + 1, F.char_length(u)))).otherwise(u)


def host_of(url: Column) -> Column:
    """Lower-case host without user or port; empty without one."""
    return F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\\[[^\\]]*\\]|[^/?#:]*)", 1))


class _Text(HTMLParser):
    HIDDEN = ("script", "style", "noscript")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in self.HIDDEN

    def handle_endtag(self, tag):
        if tag in self.HIDDEN and self.hidden:
            self.hidden -= 1

    def handle_data(self, data):
        if not self.hidden and data.strip():
            self.parts.append(data.strip())


def page_text(html: str | None, collapse: bool = True) -> str | None:
    """Text nodes joined by a blank, without scripts, styles and noscript."""
    if html is None:
        return None
    p = _Text()
    p.feed(html)
    p.close()
    text = " ".join(p.parts)
    return re.sub(r"\s+", " ", text).strip() if collapse else text


class _Links(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            for k, v in attrs:
                if k == "href" and v is not None:
                    self.found.append(v)
                    break


def page_links(html: str | None, base: str | None) -> list[str]:
    """Targets of links, resolved against ``base``; empty ones, mail, telephone and scripts dropped."""
    if not html:
        return []
    p = _Links()
    p.feed(html)
    out = []
    for href in p.found:
        href = href.strip()
        if href and not href.startswith(("mailto:", "tel:", "javascript:")):
            try:
                out.append(urljoin(base or "", href))
            except ValueError:
                continue
    return out


def html_text(html: Column, collapse: bool = True) -> Column:
    @F.pandas_udf("string")
    def text(pages: pd.Series) -> pd.Series:
        return pages.map(lambda h: page_text(h, collapse), na_action="ignore")

    return text(html)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _links(pages: pd.Series, bases: pd.Series) -> pd.Series:
    return pd.Series([page_links(h, b) for h, b in zip(pages, bases)])


def html_links(html: Column, base: Column) -> Column:
    return _links(html, base)


#: The commonest letters of Russian, whose share tells its one-byte encodings apart.
_COMMON = frozenset("оеаинтсрвл")
_ONE_BYTE = ("cp1251", "koi8-r", "cp866", "iso8859-5", "mac-cyrillic")
_MARKS = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))


def detected_charset(body: bytes) -> str:
    """The encoding that bytes are in: by their mark, UTF-8 if they are valid, else the Russian one-byte
    encoding in which common lower-case letters are most of what isn't ASCII; UTF-8 if none fits."""
    for mark, name in _MARKS:
        if body.startswith(mark):
            return name
    try:
        body.decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError as e:
        if e.reason == "unexpected end of data" and e.start > 0:  # only the last character is cut
            return "utf-8"
    high = bytes(b for b in body if b > 127)
    best, share = "utf-8", 0.3
    for name in _ONE_BYTE:
        text = high.decode(name, "replace")
        n = sum(c in _COMMON for c in text) / max(1, len(text))
        if n > share:
            best, share = name, n
    return best


def decode_bytes(body: Column, content_type: Column) -> Column:
    """Bytes to text by the ``charset`` parameter, without one or with an unknown one by what the
    bytes look like; wrong bytes are replaced."""

    @F.pandas_udf("string")
    def decode(bodies: pd.Series, charsets: pd.Series) -> pd.Series:
        def one(b, c):
            if b is None:
                return None
            b = bytes(b)
            try:
                return b.decode(c or detected_charset(b), "replace")
            except LookupError:
                return b.decode(detected_charset(b), "replace")

        return pd.Series([one(b, c) for b, c in zip(bodies, charsets)])

    return decode(body, charset_of(content_type))


def encode_text(text: Column, content_type: Column) -> Column:
    """Text to bytes by the ``charset`` parameter; UTF-8 without one, or where it lacks a character."""

    @F.pandas_udf("binary")
    def encode(texts: pd.Series, charsets: pd.Series) -> pd.Series:
        def one(t, c):
            if t is None:
                return None
            try:
                return t.encode(c or "utf-8")
            except (LookupError, UnicodeEncodeError):
                return t.encode("utf-8", "replace")

        return pd.Series([one(t, c) for t, c in zip(texts, charsets)])

    return encode(text, charset_of(content_type))


def charset_of(content_type: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(F.lower(content_type), "charset=([^;]+)", 1), "[\"']", ""))
