"""Token ids of whole texts by a public tokenizer file, each distinct word encoded once."""

from __future__ import annotations

import os
import re
from array import array
from functools import cache

#: The vocabulary of the packing query. It drops white space, so no token spans it.
WORD_VOCABULARY = "word_bpe_49k.json"

#: Strings of which a worker keeps the ids; further ones are encoded at each use.
KEPT = 250_000

#: How the vocabulary's own pre-tokenizer cuts a text, for letters and digits up to
#: U+00FF in lower case; fixed value.
PARTS = (
    r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]"
    r"|[^\s0-9²³¹¼-¾a-zªµºß-öø-ÿ]+"
)

#: Signs whose role as blanks or in normal forms needs the tokenizer itself.
ODD = r"[^\n\x20-\x7e¡-¬®-ÿ]|<\|"


def vocabulary(name: str = WORD_VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_signs() -> dict[int, int]:
    """The printable sign that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(others)}


class _Ids(dict):
    """Ids of a string as bytes, worked out where they are not kept yet."""

    def __init__(self, work):
        self._work = work

    def __missing__(self, part: str) -> bytes:
        coded = array("I", self._work(part)).tobytes()
        if len(self) < KEPT:
            self[part] = coded
        return coded


class Encoder:
    """Ids of texts as unsigned 32-bit numbers in bytes, special tokens not added.

    For vocabularies whose pre-tokenizer never crosses a blank: the ids of a text are
    then the ids of its parts, one after the other. Plain Latin texts are cut as the
    pre-tokenizer cuts them, and each part goes to the tokenizer's merges; other texts
    are cut at blanks and line ends, and each word goes to the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        whole, signs = Tokenizer.from_file(path), _byte_signs()
        merges = whole.model.tokenize

        def of_part(part: str) -> list[int]:
            return [t.id for t in merges(part.encode().decode("latin-1").translate(signs))]

        def of_word(word: str) -> list[int]:
            return whole.encode(word, add_special_tokens=False).ids

        self._part_ids = _Ids(of_part).__getitem__
        self._word_ids = _Ids(of_word).__getitem__
        self._cut = re.compile(PARTS).findall
        self._odd = re.compile(ODD).search

    def encode(self, texts: list[str]) -> list[bytes]:
        return [
            b"".join(map(self._word_ids, text.replace("\n", " ").split(" ")))
            if self._odd(text) else b"".join(map(self._part_ids, self._cut(text.lower())))
            for text in texts
        ]


@cache
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    return Encoder(path)
