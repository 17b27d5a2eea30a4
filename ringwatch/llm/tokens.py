"""Exact token ids of whole texts with a tokenizer file, word by word where that is safe.

Blanks (space and 0x09 to 0x0D) after another character always end a word for the tokenizers
here, so a text can be encoded in parts that begin there, and equal parts need be encoded once.
Texts with other white space, or one of the tokenizer's own markers, are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from functools import cache

import numpy as np

#: Parts whose ids a worker keeps, and as many former ones.
KEPT = 400_000
_ODD = re.compile("[\x1c-\x1f\x85\xa0  -‍    ⁠　﻿]")


def load(path: str):
    """A tokenizer without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def markers(path: str) -> list[str]:
    """The added tokens of a tokenizer file, which are found in a text before anything else."""
    with open(path, encoding="utf-8") as file:
        return [t["content"] for t in json.load(file)["added_tokens"]]


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies.

    Printable bytes stand for themselves, the others for the letters from 256 on, in order.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Parts(dict):
    """Ids of parts of texts, as little-endian 32-bit numbers, by part.

    When it is full, its parts become the former ones, and those that turn up again come back.
    """

    def __init__(self, tokenizer, sizes: np.ndarray, kept: int):
        super().__init__()
        self.tokenizer, self.sizes, self.kept = tokenizer, sizes, kept
        self.former: dict[str, bytes] = {}

    def __missing__(self, part: str) -> bytes:
        """A part of before, or one that is encoded alone."""
        ids = self.former.get(part) or _ids(self.tokenizer, part)
        if len(part) <= 64:
            self[part] = ids
        return ids

    def unknown(self, parts: set[str]) -> list[str]:
        """Those of the parts that have to be encoded; brings former ones back."""
        new = [p for p in parts if p not in self]  # a set's own methods would go over all that is known
        again = [p for p in new if p in self.former]
        missing = [p for p in new if p not in self.former]
        self.update(zip(again, map(self.former.__getitem__, again)))
        if len(self) + len(missing) > self.kept:
            self.former = dict(self)
            self.clear()
        return missing

    def learn(self, parts: list[str], widths: np.ndarray, text: str) -> None:
        """Encode parts that stand in a row in ``text``; each has so many bytes of tokens."""
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum(widths)) + 1
        data, ends = ids.tobytes(), (4 * ends).tolist()
        self.update(zip(parts, map(data.__getitem__, map(slice, [0, *ends], ends))))


def _ids(tokenizer, text: str) -> bytes:
    return np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def _groups(texts: list[str], most: int = 1_000_000):
    """Texts in turn, about so many characters at a time."""
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size > most:
            yield group
            group, size = [], 0
    if group:
        yield group


class Tokens:
    """Encodes many texts; a subclass says how they fall into parts."""

    def __init__(self, path: str, kept: int = KEPT):
        self.tokenizer = load(path)
        self.markers = markers(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        letters = byte_letters()
        names = [(self.tokenizer.id_to_token(i) or "").removesuffix("</w>") for i in range(size)]
        self.bytes = [bytes(map(letters.__getitem__, n)) for n in names]
        self.parts = Parts(self.tokenizer, np.array([len(b) for b in self.bytes]), kept)

    def encode_all(self, texts: list[str]):
        """Ids of each whole text, as little-endian 32-bit numbers."""
        for group in _groups(texts):
            split = [None if _ODD.search(t) or any(m in t for m in self.markers) else self.split(t) for t in group]
            new = self.parts.unknown(set().union(*(parts for parts in split if parts)))
            new = [p for p in new if len(p) <= 64]
            for at in range(0, len(new), 4000):  # an encoding takes some hundred bytes a token
                self.learn(new[at : at + 4000])
            for text, parts in zip(group, split):
                yield _ids(self.tokenizer, text) if parts is None else b"".join(map(self.parts.__getitem__, parts))


class WordTokens(Tokens):
    """For tokenizers that drop white space and mark the ends of words."""

    def split(self, text: str) -> list[str]:
        """Words, in lower case, without the stop or comma at their end unless another sign stands before it."""
        if "\u03a3" not in text:  # whose lower case depends on its place
            text = text.lower()
        if not _SIGNS.search(text):
            text = text.replace(". ", " . ").replace(", ", " , ").replace(".\n", " .\n")
        return text.split()

    def learn(self, parts: list[str]) -> None:
        text = " ".join(parts)
        if unicodedata.is_normalized("NFC", text):  # else encoded one by one
            self.parts.learn(parts, np.fromiter((len(p.encode()) for p in text.lower().split(" ")), dtype=np.int64, count=len(parts)), text)


_SIGNS = re.compile(r"[.,](?:(?<=[^\w\s][.,])|(?<=_[.,]))[ \n]")
_CUT = re.compile("[^ \t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff](?=[ \t-\r])")
_BLANKS = " \t\n\v\f\r"
_RUNS = re.compile("[ \t-\r]{2}|[\t\v-\r\0]")
_CLOSED = re.compile(r"[.,](?:(?<=\W[.,])|(?<=_[.,])|(?<=^[.,]))\0")
_PARTS = re.compile("[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")


class ByteTokens(Tokens):
    """For byte-level tokenizers; decodes too, and joins encoded halves exactly."""

    def split(self, text: str) -> list[str]:
        """Parts that begin with a blank, and stops and commas before blanks; joined they are the text."""
        if _RUNS.search(text):
            return _PARTS.findall(text)
        text = text.replace(" ", "\0 ").replace("\n", "\0\n")
        if not _CLOSED.search(text):
            text = text.replace(".\0", "\0.\0").replace(",\0", "\0,\0")
        parts = text.split("\0")
        return parts if parts[0] else parts[1:]

    def learn(self, parts: list[str]) -> None:
        parts = [p for p in parts if p[0] in _BLANKS and p[-1] not in _BLANKS]  # the others, mostly stops, one by one
        if parts:
            self.parts.learn(parts, np.fromiter((len(p.encode()) for p in parts), dtype=np.int64, count=len(parts)), "".join(parts))

    def encode(self, text: str) -> list[int]:
        """Ids of one whole text."""
        return np.frombuffer(next(iter(self.encode_all([text]))), dtype="<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ids, markers included."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")

    def halves(self, text: str, most: int) -> list[str]:
        """Cut a text in halves again and again until none has more than ``most`` characters.

        A cut moves to the next blank after another character if one is near, and never into a marker.
        """
        if len(text) <= most:
            return [text]
        cut = len(text) // 2
        near = _CUT.search(text, cut, cut + most // 4)
        if near:
            cut = near.start() + 1
        for marker in self.markers:
            at = text.find(marker, max(0, cut - len(marker) + 1), cut + len(marker) - 1)
            if 0 <= at < cut:
                cut = at or len(marker)
        if cut >= len(text):
            return [text]
        return self.halves(text[:cut], most) + self.halves(text[cut:], most)

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of two texts in a row from the ids of each.

        The tokens around the seam are encoded anew, in a window that doubles until its first token is
        the one that stands there on the left, and its last the one on the right. Then every two tokens
        in a row are right together, and so is the whole.
        """
        if not left or not right:
            return left or right
        k = 4
        while True:
            lo, hi = self._edge_before(left, len(left) - k), self._edge_after(right, k)
            window = b"".join(map(self.bytes.__getitem__, left[lo:] + right[:hi])).decode("utf-8")
            ids = self.tokenizer.encode(window, add_special_tokens=False).ids
            if (lo == 0 or ids[0] == left[lo]) and (hi == len(right) or ids[-1] == right[hi - 1]):
                return left[:lo] + ids + right[hi:]
            k *= 2

    def _edge_before(self, ids: list[int], at: int) -> int:
        """The last token at or before ``at`` that starts a character."""
        while at > 0 and self.bytes[ids[at]][0] & 0xC0 == 0x80:
            at -= 1
        return max(at, 0)

    def _edge_after(self, ids: list[int], at: int) -> int:
        """The first end of a token at or after ``at`` that ends a character."""
        while at < len(ids) and self.bytes[ids[at]][0] & 0xC0 == 0x80:
            at += 1
        return min(at, len(ids))

    def join_all(self, parts: list[list[int]]) -> list[int]:
        """Ids of a text from those of its parts, joined two by two."""
        while len(parts) > 1:
            parts = [self.join(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0] if parts else []


@cache
def word_tokens(path: str, kept: int = KEPT) -> WordTokens:
    """One for all tasks of a worker, so that its parts stay known."""
    return WordTokens(path, kept)


@cache
def byte_tokens(path: str) -> ByteTokens:
    """One for all tasks of a worker."""
    return ByteTokens(path)
