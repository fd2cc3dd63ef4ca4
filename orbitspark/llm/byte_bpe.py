"""Byte-level BPE encoding and decoding with an Aho-Corasick automaton and backtracking over compatible tokens.

The vocabulary's byte strings are read as Latin-1, so that the automaton of pyahocorasick holds them and finds the
longest path of tokens that starts at a place of a piece. From there the encoder takes the longest token on that path
that is compatible with the one before (memoised by token and path), and steps back where none is, marking the place as
one that no encoding passes. Two adjacent tokens are compatible if the merges, applied to their joined bytes,
give these two tokens back; that answer is memoised by pair. A sequence of pairwise compatible tokens is the one that
the merges give, and each place is left at most once, so that the time is linear in the piece.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from array import array
from collections.abc import Callable
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from orbitspark.llm.common import batches_of

#: Where a text can be cut if white space is irregular; else it is cut at each space.
CUT = re.compile(r"(?<=\S)(?= \S)")
#: Marks that are a match of their own after letters.
ENDS = frozenset(",.;:!?")
#: Distinct words in a generation of what a Python worker remembers.
REMEMBERED = 500_000
#: Ids decoded at a time.
DECODED = 1 << 16


class Loose(Exception):
    """White space at an end of a word, which may belong to a match that goes on beyond it."""


class WordMemory(dict):
    """Ids by word, in two generations of bounded size; the older is dropped when the newer is full.

    A border between a word and a single space is always a border of matches of the pattern, so that words can be
    encoded each for itself, with the single space before it.
    """

    def __init__(self, encode_word: Callable[[str], bytes], encode_match: Callable[[str], bytes]):
        super().__init__()
        self.encode_word, self.encode_match, self.old = encode_word, encode_match, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            if word.isalpha() or word[:1] == " " and word[1:].isalpha():  # one match
                ids = self.encode_match(word)
            elif word in ("", " ") or word[-1].isspace() or word[0] == " " and word[1].isspace():
                raise Loose
            else:
                ids = self.encode_word(word)
        self.keep(word, ids)
        return ids

    def keep(self, word: str, ids: bytes) -> None:
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        self[word] = ids

    def peek(self, word: str) -> bytes | None:
        return self.get(word) or self.old.get(word)

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text, as little-endian unsigned 32-bit integers; null is read as empty."""
        if not text:
            return b""
        if "\0" not in text:
            # each word with the space before it
            try:
                return b"".join(map(self.__getitem__, text.replace(" ", "\0 ").split("\0")))
            except Loose:
                pass
        return b"".join([self.peek(w) or self.encode_word(w) for w in CUT.split(text)])


@lru_cache(1)
def newer_letters() -> frozenset[str]:
    """Letters and numbers of the pattern's engine that tiktoken, which follows an older version of Unicode, doesn't know as such."""
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    doubtful = [c for c in regex.findall(r"[\p{L}\p{N}]", every) if not unicodedata.category(c).startswith(("L", "N"))]
    known = tiktoken.Encoding("letters", pat_str=r"[\p{L}\p{N}]", mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    return frozenset(c for c in doubtful if not known.encode_ordinary(c))


class ByteBPE:
    """Encoder and decoder of one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.strange = newer_letters()
        self.masked = dict.fromkeys(map(ord, self.strange), "\ue000")  # of no class that patterns name
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.size = list(map(len, self.bytes_of))
        self.sizes = np.array(self.size)
        self.begins, self.joined_bytes = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.parts: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        trie = ahocorasick.Automaton()
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                two = self.merged(token, rank)
                if len(two) != 2:
                    continue  # the merges never make it; only a whole piece can be it
                self.parts[rank] = two[0], two[1]
                self.joined[two[0], two[1]] = rank
            trie.add_word(token.decode("latin-1"), rank)
        trie.make_automaton()
        self.trie, self.longest = trie, {}
        self.most = max(map(len, ranks))
        self.shorter = [-1] * len(self.size)  # the next shorter token that begins a token
        for token, rank in ranks.items():
            if token.decode("latin-1") in trie:
                self.shorter[rank] = next((ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n].decode("latin-1") in trie), -1)
        self.pairs: list[dict[int, bool]] = [{} for _ in self.size]
        self.after: list[dict[str, int]] = [{} for _ in self.size]
        self.known = 0
        self.words = WordMemory(self.word, self.match)

    def merged(self, token: bytes, below: int) -> list[int]:
        """The ids that merges of a rank under `below` leave of a byte string."""
        ranks, ids = self.ranks, [token[i : i + 1] for i in range(len(token))]
        while len(ids) > 1:
            least = min(((ranks.get(ids[i] + ids[i + 1], below), i) for i in range(len(ids) - 1)))
            if least[0] >= below:
                break
            ids[least[1] : least[1] + 2] = [ids[least[1]] + ids[least[1] + 1]]
        return [ranks[x] for x in ids]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes of two tokens leaves just these two; the answer is remembered.

        Undoing merges from the later one on: at each step the two tokens that face each other at the border must not
        merge before the later of them was made.
        """
        good = self.pairs[left].get(right)
        if good is None:
            self.remember()
            good = self.pairs[left][right] = self.undone(left, right)
        return good

    def undone(self, a: int, b: int) -> bool:
        bound = len(self.bytes_of)
        while True:
            rank = self.joined.get((a, b))
            if rank is not None and rank < bound:
                return False
            undo_left, undo_right = a in self.parts, b in self.parts
            if not undo_left and not undo_right:
                return True
            if undo_left and (not undo_right or a > b):
                a, bound = self.parts[a][1], a
            else:
                b, bound = self.parts[b][0], b + 1

    def remember(self) -> None:
        """Counts what is remembered of tokens' neighbours, and forgets it all when it is too much."""
        self.known += 1
        if self.known > 2 * REMEMBERED:
            self.known = 0
            for x in (*self.pairs, *self.after):
                x.clear()

    def follow(self, left: int, path: str) -> int:
        """The longest token on a path of the trie that is compatible with the one before, or -1; remembered in after."""
        token = self.along(path)
        while token >= 0 and not self.compatible(left, token):
            token = self.shorter[token]
        self.remember()
        self.after[left][path] = token
        return token

    def piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        latin, size, after, deepest, most = piece.decode("latin-1"), self.size, self.after, self.trie.longest_prefix, self.most
        token = self.along(latin[: deepest(latin[:most])])
        ids, at, end, closed = [token], size[token], len(latin), set()
        while at < end:
            # no path of the trie is longer than its longest token
            rest = latin[at : at + most]
            path = rest[: deepest(rest)]
            token = after[ids[-1]].get(path)
            if token is None:
                token = self.follow(ids[-1], path)
            if closed and token >= 0 and at + size[token] in closed:
                token = self.next_shorter(ids, token, at, closed)
            while token < 0:  # none is left: the place is closed, and the token before it gives way
                closed.add(at)
                token = ids.pop()
                at -= size[token]
                token = self.next_shorter(ids, token, at, closed)
            ids.append(token)
            at += size[token]
        return ids

    def next_shorter(self, ids: list[int], token: int, at: int, closed: set[int]) -> int:
        """The next shorter token at a place that fits the one before it and leads to no closed place, or -1."""
        token = self.shorter[token]
        while token >= 0 and (at + self.size[token] in closed or ids and not self.compatible(ids[-1], token)):
            token = self.shorter[token]
        return token

    def along(self, path: str) -> int:
        """The longest token on a path of the trie, remembered by path (the trie bounds their number)."""
        token = self.longest.get(path)
        if token is None:
            n = len(path)
            while path[:n] not in self.trie:
                n -= 1
            token = self.longest[path] = self.trie.get(path[:n])
        return token

    def word(self, text: str) -> bytes:
        """Ids of the matches of the pattern in a text; each match is remembered too, as more words are made of it."""
        words, out = self.words, []
        if text[-1] in ENDS and (text[:-1].isalpha() or text[0] == " " and text[1:-1].isalpha()):
            matches = [text[:-1], text[-1]]
        elif text.isascii() or self.strange.isdisjoint(text):
            matches = self.pattern.findall(text)
        else:
            matches = [text[slice(*m.span())] for m in self.pattern.finditer(text.translate(self.masked))]
        for m in matches:
            ids = words.peek(m)
            if ids is None:
                ids = self.match(m)
                if len(m) <= self.most:
                    words.keep(m, ids)
            out.append(ids)
        return b"".join(out)

    def match(self, text: str) -> bytes:
        return array("I", self.piece(text.encode())).tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; null is read as empty."""
        return self.words.encode(text)

    def decode(self, ids: bytes) -> bytes:
        out, all_ids = [], np.frombuffer(ids, "<u4")
        for i in range(0, len(all_ids), DECODED):
            some = all_ids[i : i + DECODED]
            sizes = self.sizes[some]
            ends = np.cumsum(sizes)
            at = np.repeat(self.begins[some] - (ends - sizes), sizes)
            at += np.arange(len(at))
            out.append(self.joined_bytes[at].tobytes())
        return b"".join(out)


@lru_cache(2)
def coder(path: str, pattern: str) -> ByteBPE:
    """The coder of a rank file in this Python worker."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return ByteBPE(ranks, pattern)


def encode(text: Column, path: str, pattern: str) -> Column:
    """Column of a text's token ids, as binary of little-endian unsigned 32-bit integers.

    Null and empty texts give no ids; texts are encoded whole, in time linear in their matches of the pattern. It is a
    column of its row alone, so that repeated rows and other columns play no part.
    """
    batches_of(SparkSession.active())

    @F.pandas_udf("binary")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([coder(path, pattern).encode(t) for t in texts])

    return of(text)


def decode(ids: Column, path: str, pattern: str) -> Column:
    """Column of the bytes that ids (as encode() gives them) stand for. Null gives no bytes."""

    @F.pandas_udf("binary")
    def of(blobs: pd.Series) -> pd.Series:
        return pd.Series([coder(path, pattern).decode(x or b"") for x in blobs])

    return of(ids)
