"""Forms of a text: escapes, markup, characters and words."""

from __future__ import annotations

import html
import re
import sys
import unicodedata
from collections.abc import Callable

_TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?/?>")
_LINK = re.compile(r"!?\[([^\[\]]+)\]\([^()\s]+\)")
_UNICODE_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")
# Printable ASCII, ends of lines, and UTF-8 of two or more bytes; "50%de" is none.
_URL_ESCAPE = re.compile(r"(?:%(?:[2-7][0-9A-Fa-f]|0[9AaDd]|[C-Fc-f][0-9A-Fa-f](?:%[89ABab][0-9A-Fa-f])+))+")
_LINE_ESCAPE = re.compile(r"\\[nrt]")
_HYPHENATED = re.compile(r"(?<=\w)[-‐]\s*\n[\s>|#*]*(?=\w)")
_JSON_EDGE = re.compile(r"\{?\s*\"\w+\"\s*:\s*\"|\"\s*[,}]")


def _characters(which: Callable[[str], bool]) -> re.Pattern:
    """A pattern for the characters that ``which`` holds for."""
    return re.compile("[" + "".join(re.escape(c) for c in map(chr, range(sys.maxunicode + 1)) if which(c)) + "]+")


_INVISIBLE = _characters(lambda c: unicodedata.category(c) == "Cf")
_COMBINING = _characters(lambda c: unicodedata.combining(c) != 0)


def unescape(text: str) -> str:
    """Backslash, percent and HTML escapes as the characters they stand for."""
    if "\\" in text:
        text = _UNICODE_ESCAPE.sub(lambda m: chr(int(m[1], 16)), _LINE_ESCAPE.sub("\n", text)).replace('\\"', '"').replace("\\/", "/")
        text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    if "%" in text:
        text = _URL_ESCAPE.sub(lambda m: bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "replace"), text)
    return html.unescape(html.unescape(text)) if "&" in text else text


def visible(text: str) -> str:
    """Without characters of no width, in one form of every character."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
    return text


def strings_of_json(text: str) -> str:
    """Texts wrapped in JSON objects as lines of their own."""
    return _JSON_EDGE.sub("\n", text) if '":' in text else text


def words(text: str) -> list[str]:
    """The words of a text whatever its case, punctuation, spacing, line breaks,
    markup, escapes and character forms: white space parts them, and of each only
    letters and digits count. Words hyphenated over a line break are joined."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    text = unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    text = visible(text)
    if "\n" in text:
        text = _HYPHENATED.sub("", text)
    if "](" in text:
        text = _LINK.sub(r"\1", text)
    text = text.casefold()
    if not text.isascii():
        text = _COMBINING.sub("", unicodedata.normalize("NFKD", text))
    bare = ("".join(filter(str.isalnum, w)) if not w.isalnum() else w for w in text.split())
    return [w for w in bare if w]
