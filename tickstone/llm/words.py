"""Texts as words, apart from how they are written."""

from __future__ import annotations

import html
import re
import unicodedata

import regex

# Cyrillic and Greek letters that look like Latin ones, after case folding.
LOOK_ALIKE = str.maketrans("авеёзкмнорстухіјѕԁһԛԝґѵαβεηικνορτυχγ", "abee3kmhopctyxijsdhqwgvabehikvoptuxy")

# HTML elements that stand inside a line, and those that part words. Other angle brackets are text.
INLINE = "a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr"
BLOCK = (
    "address area article aside audio base blockquote body br button canvas caption center col colgroup dd details dialog dir div dl dt embed fieldset figcaption figure footer form frame"
    " frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe img input legend li link main map menu meta nav noscript object ol optgroup option output p param picture pre"
    " progress script section select source style summary svg table tbody td template textarea tfoot th thead title tr track ul video"
)
_INLINE = regex.compile(rf"</?(?:{INLINE.replace(' ', '|')})(?:\s[^<>]*)?/?>", regex.I)
_TAG = regex.compile(rf"</?(?:{BLOCK.replace(' ', '|')})(?:\s[^<>]*)?/?>|<!doctype[^<>]*>", regex.I)
_FOREIGN = re.compile(r"[\u0370-\u052f]")
_UNSEEN = regex.compile(r"[\p{Cf}\p{Mn}\p{Me}\p{Co}\p{Cs}\x00-\x08\x0e-\x1f\x7f-\x84\x86-\x9f︀-️]+")
_BROKEN = regex.compile(r"(?<=\p{L})-[ \t]*\r?\n[ \t]*(?=\p{Ll})")
_APOSTROPHES = "'‘’ʼ´`"
_APOSTROPHE = re.compile(rf"(?<=\w)[{_APOSTROPHES}](?=\w)")
_WORD = re.compile(r"[^\W_]+")  # letters and numbers of any script
_SPACED = re.compile(r"\S+")


def _without_comments(t: str) -> str:
    """``t`` without closed HTML comments, in linear time however many are left open."""
    out, at = [], 0
    while (a := t.find("<!--", at)) >= 0 and (b := t.find("-->", a + 4)) >= 0:
        out.append(t[at:a])
        at = b + 3
    return " ".join([*out, t[at:]])


def plain(text: str) -> str:
    """Case, compatibility forms, markup, entities, accents, unseen and look-alike characters taken away.

    Punctuation, white space and digits stay. Runs in time linear in the text's length.
    """
    t = html.unescape(text) if "&" in text else text
    if "<" in t:
        t = _TAG.sub(" ", _INLINE.sub("", _without_comments(t)))
    if t.isascii():
        t = t.lower()
    else:
        t = _UNSEEN.sub("", unicodedata.normalize("NFKD", t)).casefold()
        if _FOREIGN.search(t):
            t = t.translate(LOOK_ALIKE)
    if "-" in t and "\n" in t:
        t = _BROKEN.sub("", t)
    return _APOSTROPHE.sub("", t) if any(c in t for c in _APOSTROPHES) else t


def words(text: str | None) -> list[str]:
    """Letters and digits in a row, of ``plain`` text; null gives none."""
    return _WORD.findall(plain(text)) if text else []


def counted_words(text: str | None) -> tuple[list[str], list[int]]:
    """``words``, and for each the number of the blank-separated word it belongs to (``second-hand`` is one)."""
    out: list[str] = []
    number: list[int] = []
    for i, m in enumerate(_SPACED.findall(plain(text)) if text else []):
        for w in _WORD.findall(m):
            out.append(w)
            number.append(i)
    place = {n: i for i, n in enumerate(dict.fromkeys(number))}
    return out, [place[n] for n in number]
