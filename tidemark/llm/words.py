"""Words as most operators of this subpackage take them."""

from __future__ import annotations

import re

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(UPPER, LOWER)
#: Runs of digits, letters and all characters beyond ASCII, of lower-cased text.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(text: str) -> str:
    """Lower-cases A-Z only."""
    return text.lower() if text.isascii() else text.translate(ASCII_LOWER)


#: The same words of text that isn't lower-cased yet.
ANY_CASE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[str]:
    """The words, lower-cased. Where no other capitals than A-Z occur, lower() is the quick way to the same words."""
    if not text:
        return []
    if text.isascii():
        return WORD.findall(text.lower())
    return [w.lower() if w.isascii() else w.translate(ASCII_LOWER) for w in ANY_CASE_WORD.findall(text)]


#: White space beside a space, or a space at an end. Elsewhere a space always begins a piece of byte-level patterns, as
#: no alternative holds a space after its first character, but for runs of white space.
IRREGULAR_SPACE = re.compile(r"\s \s?| \s|^ | $")
