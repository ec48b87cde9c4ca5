"""Splitting text into the pieces that byte-level BPE encodes one by one."""

from __future__ import annotations

import re

import regex

#: Fixed value: the pattern that the public byte-level vocabularies were made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# Over ASCII and the accented Latin letters alone the same language needs no Unicode classes,
# and the plain engine reads it about twice as fast.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ſ"
_SPACES = r"\t-\r "
_OUTSIDE = re.compile(f"[^\x00-\x7fÀ-ÖØ-öø-ſ]")
_NARROW = re.compile(
    f"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[0-9]+| ?[^{_SPACES}{_LETTERS}0-9]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"
)


def splitter(pattern: str = PATTERN):
    """A function from text to its list of pieces under ``pattern``."""
    full = regex.compile(pattern).findall
    if pattern != PATTERN:
        return full
    narrow, outside = _NARROW.findall, _OUTSIDE.search
    return lambda text: narrow(text) if text.isascii() or not outside(text) else full(text)
