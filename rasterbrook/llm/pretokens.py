"""Rank files and the split of text into pre-tokens, as byte-level BPE needs them."""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import public_tokenizers
import regex

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Beyond this code point the general pattern is used.
_LATIN = 0x250


@cache
def load_ranks(path: str = RANKS) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _class(kind: str) -> str:
    """The Latin characters of a general category, as ranges of a character class."""
    own = [c for c in range(_LATIN) if unicodedata.category(chr(c))[0] == kind]
    starts = [c for c in own if c - 1 not in own]
    ends = [c for c in own if c + 1 not in own]
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(starts, ends, strict=True))


@cache
def splitter() -> Callable[[str], list[str]]:
    """text -> its pre-tokens in order; they join to the text again."""
    general = regex.compile(public_tokenizers.PATTERN).findall
    letter, number, space = _class("L"), _class("N"), r"\t-\r \x85\xa0"
    # the same pattern for texts of Latin characters, with classes that the faster module knows
    latin = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{letter}]++| ?[{number}]++| ?[^{space}{letter}{number}]++|[{space}]+(?![^{space}])|[{space}]+").findall
    beyond = re.compile(rf"[^\x00-\u{_LATIN - 1:04x}]").search

    def split(text: str) -> list[str]:
        return general(text) if beyond(text) else latin(text)

    return split


#: Characters of a text that are split at once.
BLOCK = 1 << 20


def split_blocks(text: str) -> Iterator[list[str]]:
    """The pre-tokens of a text, in lists of about BLOCK characters."""
    split, at = splitter(), 0
    while at < len(text):
        size = BLOCK
        while True:
            words = split(text[at : at + size])
            if at + size >= len(text):
                break
            words = words[:-2]  # the last may go on behind the block, and the one before have ended for it
            if words:
                break
            size *= 2
        yield words
        at += sum(map(len, words))
