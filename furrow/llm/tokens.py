"""Vocabulary files and pre-tokenisation shared by the token operators. Paths are parameters."""

from __future__ import annotations

import functools
import os
import re

import regex

#: Fixed value: the public byte-level pre-token pattern.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Letters and numbers that the regex library knows and the tokenizers library doesn't.
NEWER = "\U00011de0-\U00011de9\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ff4-\U00016ff6"


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@functools.cache
def special_tokens(path: str) -> dict[str, int]:
    return {t.content: i for i, t in tokenizer(path).get_added_tokens_decoder().items()}


@functools.cache
def _ordinary():
    usual, newer = regex.compile(PRE_TOKEN).findall, re.compile(f"[{NEWER}]").search
    older = PRE_TOKEN.replace(r"[^\s\p{L}\p{N}]", rf"[^\s[\p{{L}}\p{{N}}--[{NEWER}]]]").replace(r" ?\p{L}+", rf" ?[\p{{L}}--[{NEWER}]]+").replace(r" ?\p{N}+", rf" ?[\p{{N}}--[{NEWER}]]+")
    rare = regex.compile(older, regex.V1).findall

    def pieces(text: str) -> list[str]:
        return usual(text) if newer(text) is None else rare(text)

    return pieces


def ordinary_pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text in order; the strings of special tokens are plain text."""
    return _ordinary()(text)


@functools.cache
def _splitter(path: str):
    special, pieces = special_tokens(path), _ordinary()
    if not special:
        return pieces
    inside = regex.compile("(" + "|".join(map(regex.escape, special)) + ")")
    marks = tuple(special)

    def split(text: str) -> list[str]:
        if not any(m in text for m in marks):
            return pieces(text)
        out: list[str] = []
        for part in inside.split(text):
            out += [part] if part in special else pieces(part)
        return out

    return split


def pre_tokens(path: str, text: str) -> list[str]:
    """The pre-tokens of a text in order; a special string inside it is one piece of its own."""
    return _splitter(path)(text)
