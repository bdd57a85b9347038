"""Byte-level BPE encoding by longest match and backtracking.

The encoder never replays merges. Bytes are read as Latin-1 characters, one
Aho-Corasick pass gives the longest vocabulary entry at each position, and
the leftmost choice is shortened or taken back until every two neighbours are
compatible, which makes the sequence the one the merges would give. Whether
two tokens may stand side by side, and how a token splits, is memoised.
Positions that once proved a dead end are marked, so each is tried once and
the time is linear in the length.
"""

from __future__ import annotations

import base64
import functools
import os
import re

import ahocorasick
import numpy as np
import regex

from paperloom.llm.common import WHITE

DEFAULT_VOCABULARY = os.path.join("/opt/tokenizers", "byte_bpe_50k.tiktoken")

#: The vocabulary's pre-tokenisation pattern, white space spelled out.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
#: A run of non-space with the white space before it. No pre-token crosses its
#: borders and none depends on what lies beyond them.
UNIT = rf"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+\Z"
MEMO_UNITS = 400_000


class ByteBpe:
    def __init__(self, path: str = DEFAULT_VOCABULARY):
        self.token: dict[int, str] = {}
        with open(path, "rb") as lines:
            for line in lines:
                coded, rank = line.split()
                self.token[int(rank)] = base64.b64decode(coded).decode("latin-1")
        self.rank = {t: r for r, t in self.token.items()}
        self.find = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for t, r in self.rank.items():
            self.find.add_word(t, r)
        self.find.make_automaton()
        self._shorter: dict[int, int] = {}
        self._split: dict[int, tuple[int, int]] = {}
        self._pair: dict[tuple[int, int], bool] = {}
        self._pretokens = regex.compile(PATTERN).findall
        self._units = re.compile(UNIT).findall
        self.memo = _Memo(self)

    def shorter(self, token: int) -> int:
        """The longest vocabulary entry that is a proper prefix, or -1."""
        found = self._shorter.get(token)
        if found is None:
            text = self.token[token]
            found = next((r for n in range(len(text) - 1, 0, -1) if (r := self.rank.get(text[:n])) is not None), -1)
            self._shorter[token] = found
        return found

    def split(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge made this one; itself twice if it is a byte."""
        found = self._split.get(token)
        if found is None:
            text, found, left = self.token[token], (token, token), self.shorter(token)
            while left >= 0:
                right = self.rank.get(text[len(self.token[left]) :])
                if right is not None and left < token and right < token and self._border_stays(left, right, token):
                    found = (left, right)
                    break
                left = self.shorter(left)
            self._split[token] = found
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging would leave this border between two tokens alone."""
        known = self._pair.get((left, right))
        if known is None:
            known = self._pair[left, right] = self._border_stays(left, right, len(self.token))
        return known

    def _border_stays(self, a: int, b: int, limit: int) -> bool:
        """The same, of the merges before limit.

        Both tokens are taken apart along the border, the younger one first;
        a merge across it that is older than what has been taken apart so far
        would have come before and swallowed the border.
        """
        while True:
            joined = self.rank.get(self.token[a] + self.token[b])
            if joined is not None and joined < limit and self.split(joined) == (a, b):
                return False
            if a > b:
                limit, a = a, self.split(a)[1]
                if a == limit:
                    limit, b = b + 1, self.split(b)[0]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, self.split(b)[0]
                if b + 1 == limit:
                    limit, a = a, self.split(a)[1]
                    if a == limit:
                        return True

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one pre-token, given as Latin-1 characters."""
        size = len(piece)
        if size == 1:
            return [self.rank[piece]]
        longest = [-1] * size
        for end, token in self.find.iter(piece):
            start = end + 1 - len(self.token[token])
            if longest[start] < 0 or len(self.token[longest[start]]) < end + 1 - start:
                longest[start] = token
        alive = bytearray(b"\x01") * (size + 1)
        out: list[int] = []
        at, choice = 0, longest[0]
        while at < size:
            last = out[-1] if out else -1
            token = choice
            while token >= 0:
                end = at + len(self.token[token])
                if alive[end] and (last < 0 or self.compatible(last, token)):
                    break
                token = self.shorter(token)
            if token >= 0:
                out.append(token)
                at = end
                choice = longest[at] if at < size else -1
            else:
                alive[at] = 0
                choice = out.pop()
                at -= len(self.token[choice])
        return out

    def encode_unit(self, unit: str) -> bytes:
        ids: list[int] = []
        for piece in self._pretokens(unit):
            ids += self.encode_piece(piece.encode("utf-8").decode("latin-1"))
        return np.array(ids, dtype="<i4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian 32-bit integers; none for empty and null."""
        if not text:
            return b""
        memo = self.memo
        if len(memo) > MEMO_UNITS:
            memo.clear()
        return b"".join(map(memo.__getitem__, self._units(text)))


class _Memo(dict):
    def __init__(self, bpe: ByteBpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, unit: str) -> bytes:
        ids = self.bpe.encode_unit(unit)
        if len(unit) <= 64:
            self[unit] = ids
        return ids


@functools.cache
def encoder(path: str = DEFAULT_VOCABULARY) -> ByteBpe:
    """One encoder for each Python worker and vocabulary file."""
    return ByteBpe(path)
