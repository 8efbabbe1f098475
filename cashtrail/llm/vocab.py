"""Token ids of whole texts by public vocabulary files, with a bounded memory of units seen before.

Neither vocabulary ever merges over the units a text is cut into here, so a unit's ids do not depend on what stands around it and
are asked of the tokenizer once. ``tests/llm/test_tokens.py`` holds both against the tokenizers on whole texts.
"""

from __future__ import annotations

import functools
import os
import re
import sys
from array import array
from collections.abc import Callable

import numpy as np

#: name of a byte-level vocabulary (tokenizers) and of a piece vocabulary (sentencepiece)
BYTE_FILE, PIECE_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: about 250 bytes each; longer units are not kept
MOST_UNITS, LONGEST_UNIT = 1 << 20, 64
#: characters with the Unicode property White_Space
SPACES = "\t-\r \x85\xa0  -     　"
#: below this character the classes of letters and digits are the same in every Unicode version in use
SETTLED = "Ԁ"


def vocabulary(name: str, folder: str | None = None) -> str:
    """Place of a vocabulary file: in ``folder``, or where the installed package of public tokenizers has it."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def words_of(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Irregular(Exception):
    """White space that a cut at single spaces and line ends does not see rightly."""


class Remembered(dict):
    """unit -> its ids as little-endian 32-bit words. When half the memory is full the older half goes, so common units stay.

    A unit is a word: with the line end before it, or else for the word with a space before it. ``odd`` holds the units
    whose tokens do not spell them, which is only looked at with ``spelled``; when it is full, every text is in doubt.
    """

    def __init__(self, encode: Callable[[str], list[int]], spelled: Callable[[int], bytes] | None):
        self.encode, self.spelled, self.old, self.odd = encode, spelled, {}, set()

    def __missing__(self, unit: str) -> bytes:
        ids = self.old.get(unit)
        if ids is None:
            ids = self._new(unit)
        if len(unit) <= LONGEST_UNIT:
            if len(self) >= MOST_UNITS // 2:
                self.old = dict(self)
                self.clear()
            self[unit] = ids
        return ids

    def _new(self, unit: str) -> bytes:
        if not unit or unit == "\n" or unit[-1] in SPACES or unit[unit[0] == "\n"] in SPACES:
            raise Irregular
        text = unit if unit[0] == "\n" else " " + unit
        found = self.encode(text)
        if self.spelled and len(self.odd) < MOST_UNITS and b"".join(map(self.spelled, found)) != text.encode():
            self.odd.add(unit)
        return words_of(found)


def units_of(text: str) -> list[str]:
    """The words of a text with a space before it, cut at spaces and before line ends."""
    return text.replace("\n", " \n").split(" ")


class Tokens:
    """What both kinds share: ``known`` units, the bytes of every id, and ``_whole`` for texts that are not cut into units."""

    known: Remembered
    bytes_of: list[bytes]

    def spaced(self, text: str, units: list[str]) -> tuple[bytes, bool]:
        """Ids of a space and the text, whose units are given, and whether they spell just that; tokens are joined only in doubt."""
        known = self.known
        try:
            ids = b"".join(map(known.__getitem__, units))
            sure = known.odd.isdisjoint(units) and len(known.odd) < MOST_UNITS
        except Irregular:
            ids, sure = words_of(self._whole(text)), False
        return ids, sure or b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())) == (" " + text).encode()


class ByteTokens(Tokens):
    """Ids by a byte-level vocabulary; ``plain`` takes the strings of special tokens as ordinary text, else they have ids of their own."""

    def __init__(self, path: str, plain: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special}
        self.special = {} if plain else {s: words_of([i]) for s, i in special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = regex.compile(PATTERN).findall
        # a byte-level vocabulary writes each byte as one printable character
        whole = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in whole]
        self.shown = {b: chr(b) for b in whole} | {b: chr(256 + i) for i, b in enumerate(rest)}
        back = {c: b for b, c in self.shown.items()}
        entries = [self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size())]
        self.bytes_of = [bytes(map(back.__getitem__, e)) if all(c in back for c in e) else e.encode() for e in entries]
        self.known = Remembered(self._encode, self.bytes_of.__getitem__ if plain else None)
        self.line_end = len(words_of(self._encode("\n")))

    def _encode(self, text: str) -> list[int]:
        if max(text) >= SETTLED:
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        # letters alone, or after one space, are one word of the pattern
        words = [text] if text[text[0] == " ":].isalpha() else self.words(text)
        return [t.id for word in words for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.shown))]

    def _whole(self, text: str) -> list[int]:
        return self._encode(" " + text)

    def ids(self, text: str) -> bytes:
        if self.cut and self.cut.search(text):
            return b"".join(self.special.get(part) or self.ids(part) for part in self.cut.split(text) if part)
        if not text:
            return b""
        first, *units = units_of(text)
        try:
            # no word of the pattern holds a line end and a letter
            return b"".join([self.known["\n" + first][self.line_end:], *map(self.known.__getitem__, units)])
        except Irregular:
            return words_of(self._encode(text))


class PieceTokens(Tokens):
    """Ids by a piece vocabulary that puts a space before the text.

    No piece has a space after another character or a line end in it, which is looked up at the start; a vocabulary where this
    does not hold is asked for whole texts.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [(self.model.id_to_piece(i), self.model.is_byte(i)) for i in range(self.model.get_piece_size())]
        self.bytes_of = [bytes([int(p[3:5], 16)]) if is_byte else p.replace("▁", " ").encode() for p, is_byte in pieces]
        self.apart = not any(re.search("[^▁]▁|\n", p) for p, is_byte in pieces if not is_byte) and len(self.model.encode("\n")) == 2
        self.known = Remembered(self._unit, self.bytes_of.__getitem__)

    def _unit(self, text: str) -> list[int]:
        if not self.apart:
            raise Irregular
        return self.model.encode(text[1:], num_threads=1) if text[0] == " " else self.model.encode(text, num_threads=1)[1:]

    def _whole(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


@functools.cache
def byte_tokens(path: str, plain: bool) -> ByteTokens:
    """One for each Python worker, which the tasks that follow in it share."""
    return ByteTokens(path, plain)


@functools.cache
def piece_tokens(path: str) -> PieceTokens:
    return PieceTokens(path)
