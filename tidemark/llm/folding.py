"""Texts as a reader reads them: without case, marks, spacing, or how letters were encoded."""

from __future__ import annotations

import html
import re
import unicodedata

_WORD = re.compile(r"[^\W_]+")
#: The Unicode blocks of combining marks, and the invisible format characters.
_UNSEEN = re.compile("[\u00ad\u0300-\u036f\u0483-\u0489\u0591-\u05bd\u061c\u064b-\u065f\u180e\u1ab0-\u1aff\u1dc0-\u1dff\u200b-\u200f\u202a-\u202e\u2060-\u206f\u20d0-\u20ff\u3099\u309a\ufe00-\ufe0f\ufe20-\ufe2f\ufeff]+")
#: Signs of a text decoded with the wrong charset.
_GARBLED = re.compile("[�\x80-\x9fÂÃÐÑ]|[РС][Ѐ-џ°-¿‚-›Ђ-џ]|[─-╬]|[À-ÿ]{4}")
_CYRILLIC = re.compile("[а-яё]")
_COMMON = re.compile("[оеаинтсрвл]")
_AS = ("cp1252", "latin-1", "cp1251", "koi8_r", "cp866", "iso8859_5", "mac_cyrillic")
_OF = ("utf-8", "cp1251", "koi8_r", "cp866", "iso8859_5")


def plain(text: str) -> list[str]:
    """Words in lower case, of letters and digits only, accents and invisible characters dropped."""
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if not text.isascii():
        text = _UNSEEN.sub("", unicodedata.normalize("NFKD", text))
    return _WORD.findall(text.casefold())


def skeleton(text: str) -> list[str]:
    """Words by their ASCII letters and digits only: what a wrong charset leaves of Latin writing."""
    if "&" in text:
        text = html.unescape(html.unescape(text))
    return _WORD.findall(unicodedata.normalize("NFC", text).encode("ascii", "ignore").decode().casefold())


def redecoded(text: str) -> str | None:
    """A text in Cyrillic that was decoded with a wrong charset, read again with the right one, if there is one."""
    best, found = 0.45, None
    for wrong in _AS:
        raw = text.encode(wrong, "ignore")
        if len(raw) < 0.5 * len(text):
            continue
        for right in _OF:
            if right == wrong:
                continue
            again = raw.decode(right, "ignore")
            letters = len(_CYRILLIC.findall(again))
            if letters < 0.2 * len(text) / (2 if right == "utf-8" else 1):
                continue
            share = len(_COMMON.findall(again)) / max(1, sum(c.isalpha() and not c.isascii() for c in again))
            if share > best:
                best, found = share, again
    return found


def forms(text: str) -> list[tuple[str, list[str]]]:
    """The ways to read a text, each with its kind: plain, and for one that looks garbled its skeleton and its redecoding."""
    out = [("plain", plain(text))]
    if not text.isascii() and _GARBLED.search(text):
        out.append(("skeleton", skeleton(text)))
        again = redecoded(text) if sum(not c.isascii() for c in text) > 0.2 * len(text) else None
        if again:
            out.append(("plain", plain(again)))
    return out
