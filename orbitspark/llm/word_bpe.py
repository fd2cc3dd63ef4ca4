"""BPE with word ends, as `tokenizers` files of that kind describe it, in batched rounds of numpy.

A text is cut at ASCII white space, which no token holds; each distinct cut is normalised and split into words once. The
symbols of all new words of a batch stand in one flat array. A round looks every adjacent pair up by binary search over
the sorted keys of the merges, and joins the pairs of the lowest rank around, all words at once. Words that have no pair
left leave the array.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from orbitspark.llm.common import batches_of

#: Distinct cuts in a generation of what a Python worker remembers; there are two.
REMEMBERED = 300_000
#: Bytes of texts that are encoded at a time.
BATCH_BYTES = 4 << 20
NONE = np.iinfo(np.int64).max
#: ASCII white space besides the space.
BLANKS = "\t\n\x0b\x0c\r"
#: The words of lower-cased ASCII text, by the file's pattern, and ends of lines.
ASCII_WORDS = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t-\ra-z0-9]+")
#: Stands between cuts that the library splits together; cuts that hold it are split by themselves.
MARK = "\ue000"
#: The parts of a file that this coder has the rules of.
KNOWN_PARTS = {"normalizer": ["NFC", "Replace", "Lowercase"], "pre_tokenizer": ["Split", "ByteLevel"]}


class WordBPE:
    """Encoder and decoder of one file. Results are those of the library with its defaults, without post-processing."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        kinds = {part: [x["type"] for x in next(v for v in file[part].values() if isinstance(v, list))] for part in KNOWN_PARTS}
        model, special = file["model"], {t["content"]: t["id"] for t in file["added_tokens"]}
        if kinds != KNOWN_PARTS or file["decoder"] is not None or any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in file["added_tokens"]):
            raise ValueError(f"{path} has parts that this coder lacks")
        rules = Tokenizer.from_file(path)
        self.normal, self.words = rules.normalizer.normalize_str, rules.pre_tokenizer.pre_tokenize_str
        self.mark = self.words(MARK)[0][0]
        self.special, self.cut = special, re.compile("(" + "|".join(map(re.escape, special)) + ")")
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.size = max(*vocab.values(), *special.values()) + 1
        self.tokens = [""] * self.size
        for token, i in (*vocab.items(), *special.items()):
            self.tokens[i] = token
        letters = {ord(t): i for t, i in vocab.items() if len(t) == 1}
        self.inner, self.last = np.zeros(max(letters) + 1, np.int64), np.zeros(max(letters) + 1, np.int64)
        for c, i in letters.items():
            self.inner[c], self.last[c] = i, vocab[chr(c) + end]
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        made = np.array([vocab[a + b] for a, b in pairs])
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs])
        by_key = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[by_key], by_key, made  # the rank of a key is its place in the file
        self.check_order(pairs, end)
        #: Letters of a stretch; no token reaches over more than a quarter of it.
        self.stretch = 4 * max(len(t.removesuffix(end)) for t in vocab)
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def check_order(self, pairs: list[tuple[str, str]], end: str) -> None:
        """A merge's token is made by it alone and only later merges use it; stretches of a word can then go on by themselves."""
        seen = set()
        for a, b in pairs:
            if any(len(x.removesuffix(end)) > 1 and x not in seen for x in (a, b)) or a + b in seen:
                raise ValueError("merges aren't in the order in which their tokens are made")
            seen.add(a + b)

    def merged(self, words: list[str]) -> list[bytes]:
        """The ids of each word (letters of the byte alphabet), as little-endian unsigned 32-bit integers."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        sym = self.inner[codes]
        sym[ends - 1] = self.last[codes[ends - 1]]
        place, word = np.arange(len(sym)), np.repeat(np.arange(len(words)), lengths)
        # stretches of a word: the place within it by letters, so that they stay as symbols are joined
        inside = (place - np.repeat(ends - lengths, lengths)) // self.stretch
        stretch = np.cumsum(np.r_[False, (inside[1:] != inside[:-1]) | (word[1:] != word[:-1])])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank = self.ranks_at(np.arange(len(sym)), sym, word)
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            live = np.minimum.reduceat(rank, starts) < NONE
            if not live.all():
                stays = np.repeat(live, np.diff(np.r_[starts, len(sym)]))
                done.append((place[~stays], sym[~stays]))
                sym, place, word, stretch, rank = sym[stays], place[stays], word[stays], stretch[stays], rank[stays]
                if not len(sym):
                    break
            at = self.lowest(rank, word, stretch)
            sym[at] = self.made[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, place, word, stretch, rank = sym[keep], place[keep], word[keep], stretch[keep], rank[keep]
            # only pairs with a new symbol have another rank
            new = at - np.arange(len(at))
            near = np.concatenate([new, new[new > 0] - 1])
            rank[near] = self.ranks_at(near, sym, word)
        places, ids = np.concatenate([p for p, _ in done]), np.concatenate([s for _, s in done])
        order = np.argsort(places)
        ids, cuts = ids[order].astype("<u4").tobytes(), 4 * np.searchsorted(places[order], np.r_[0, ends])
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def ranks_at(self, at: np.ndarray, sym: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The ranks of the pairs that symbols at these places make with the next one of their word, or NONE."""
        after = np.minimum(at + 1, len(sym) - 1)
        key = sym[at] * self.size + sym[after]
        found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        good = (self.keys[found] == key) & (word[at] == word[after]) & (at < after)
        return np.where(good, self.ranks[found], NONE)

    @staticmethod
    def lowest(rank: np.ndarray, word: np.ndarray, stretch: np.ndarray) -> np.ndarray:
        """Where pairs are joined now: those of the lowest rank in their stretch and its neighbours of the same word.

        What is beyond the neighbours can't reach such a pair before its turn, as a token is much shorter than a stretch.
        Of pairs that overlap, which are all alike, the first goes first, the third next; a row of them waits for its first.
        """
        starts = np.flatnonzero(np.r_[True, stretch[1:] != stretch[:-1]])
        own, of = np.minimum.reduceat(rank, starts), word[starts]
        near, same = own.copy(), of[1:] == of[:-1]
        near[1:][same] = np.minimum(near[1:], own[:-1])[same]
        near[:-1][same] = np.minimum(near[:-1], own[1:])[same]
        pick = (rank == np.repeat(near, np.diff(np.r_[starts, len(rank)]))) & (rank < NONE)
        follows = np.r_[False, (rank[1:] == rank[:-1]) & (rank[1:] < NONE)]  # overlaps a pair just like it
        heads = np.maximum.accumulate(np.where(follows, 0, np.arange(len(rank))))
        # all from the first one up to it must be picked
        missed = np.cumsum(~pick)
        whole = pick & pick[heads] & (missed == missed[heads])
        return np.flatnonzero(whole & ((np.arange(len(rank)) - heads) % 2 == 0))

    def split(self, cut: str) -> list[str | int]:
        """Words of one cut, and ids of special tokens, which are looked for before all else."""
        parts: list[str | int] = []
        for p in self.cut.split(cut):
            parts += [self.special[p]] if p in self.special else [w for w, _ in self.words(self.normal(p))]
        return parts

    def split_all(self, cuts: list[str]) -> tuple[list[str], list[str | int | None]]:
        """The cuts in another order, and the words and special tokens of all of them, with None after each cut."""
        plain, foreign, single = [], [], []
        for c in cuts:
            (single if "<|" in c or MARK in c else plain if c.isascii() and c.isprintable() else foreign).append(c)
        parts: list[str | int | None] = []
        if plain:  # their bytes are letters of the byte alphabet
            parts += [None if w == "\n" else w for w in ASCII_WORDS.findall("\n".join(plain).lower() + "\n")]
        if foreign:
            words = self.words(self.normal("".join([f"{c} {MARK} " for c in foreign])))
            parts += [None if w == self.mark else w for w, _ in words]
        for c in single:
            parts += [*self.split(c), None]
        return plain + foreign + single, parts

    def learn(self, cuts: set[str]) -> None:
        """Takes in the ids of new cuts."""
        order, parts = self.split_all(list(cuts))
        words = {w for w in set(parts) if isinstance(w, str)}
        ids: dict = {None: b""} | {i: i.to_bytes(4, "little") for i in self.special.values()}
        if words:
            words = sorted(words, key=len)
            ids |= zip(words, self.merged(words), strict=True)
        each = list(map(ids.__getitem__, parts))
        ends = np.cumsum(np.fromiter(map(len, each), np.int64, len(each)))[np.fromiter((p is None for p in parts), bool, len(parts))].tolist()
        joined = b"".join(each)
        self.known |= zip(order, [joined[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], strict=True)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of whole texts; null is read as empty."""
        cuts = []
        for t in texts:
            t = t or ""
            for blank in BLANKS:
                t = t.replace(blank, " ")
            cuts.append(t.split(" "))
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {"": b""}
        new = set().union(*cuts) - self.known.keys()
        back = new & self.older.keys()
        self.known |= {c: self.older[c] for c in back}
        if new - back:
            self.learn(new - back)
        return [b"".join(map(self.known.__getitem__, own)) for own in cuts]

    def decode(self, ids: bytes) -> str:
        """Tokens with a space between, as the library writes them for a file without a decoder."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(2)
def coder(path: str) -> WordBPE:
    """The coder of a file in this Python worker."""
    return WordBPE(path)


def encode(text: Column, path: str) -> Column:
    """Column of a text's token ids, as binary of little-endian unsigned 32-bit integers.

    Null and empty texts, and those of white space alone, give no ids. Texts are encoded whole; the rounds that a word
    takes don't grow with its length. It is a column of its row alone: repeated rows and other columns play no part.
    """
    batches_of(SparkSession.active(), BATCH_BYTES)

    @F.pandas_udf("binary")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(coder(path).encode(texts.tolist()), dtype=object)

    return of(text)


def decode(ids: Column, path: str) -> Column:
    """Column of the text that ids (as encode() gives them) stand for. Null gives an empty text."""

    @F.pandas_udf("string")
    def of(blobs: pd.Series) -> pd.Series:
        return pd.Series([coder(path).decode(x or b"") for x in blobs], dtype=object)

    return of(ids)
