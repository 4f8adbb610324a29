"""Ids of whole texts as the tokenizers library gives them, with one library call per distinct run between blanks.

The vocabulary's normaliser turns white space into one blank and its pre-tokens never hold
white space; so cutting at a blank, tab, carriage return or line feed never changes an id, and a run
met before needs no new call.
"""

from __future__ import annotations

import functools
import re

import numpy as np

from quillgrid.llm.common import keep_only

#: Letters of Latin-1, which lower one by one and are whole pre-tokens, and a closing point or comma, which is another.
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@functools.lru_cache(maxsize=2)
def library(path: str):
    """The tokenizer without truncation, padding or parallel threads."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


def runs(text: str) -> list[str]:
    for blank in "\n\t\r":
        if blank in text:
            text = text.replace(blank, " ")
    return text.split(" ")


class Runs(dict):
    """Run between blanks -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        super().__init__({"": b""})
        self.encode = library(path).encode

    def __missing__(self, run: str) -> bytes:
        plain = PLAIN.fullmatch(run)
        if plain and (plain[2] or not run.islower()):
            got = self[plain[1].lower()] + (self[plain[2]] if plain[2] else b"")
            if len(run) <= 64:
                self[run] = got
            return got
        got = np.asarray(self.encode(run, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(run) <= 64:
            self[run] = got
        return got


class RunCounts(dict):
    """Run between blanks -> how many ids it has."""

    def __init__(self, path: str):
        super().__init__({"": 0})
        self.encode = library(path).encode

    def __missing__(self, run: str) -> int:
        plain = PLAIN.fullmatch(run)
        if plain and (plain[2] or not run.islower()):
            got = self[plain[1].lower()] + (self[plain[2]] if plain[2] else 0)
            if len(run) <= 64:
                self[run] = got
            return got
        got = len(self.encode(run, add_special_tokens=False).ids)
        if len(run) <= 64:
            self[run] = got
        return got


@functools.lru_cache(maxsize=4)
def _memory(kind: type, path: str):
    return kind(path)


def memory(kind: type, path: str, most: int = 1_500_000):
    """The worker's memory of runs, emptied once it holds `most` of them."""
    held = _memory(kind, path)
    keep_only(held)
    if len(held) > most:
        held.clear()
    return held


def encode_bytes(text: str, path: str) -> bytes:
    return b"".join(map(memory(Runs, path).__getitem__, runs(text)))


def count(text: str, path: str) -> int:
    return sum(map(memory(RunCounts, path).__getitem__, runs(text)))
