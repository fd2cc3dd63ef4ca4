"""Phrase collocations by prefix-free parsing: n-grams are counted in a dictionary of distinct chunks, not in the texts.

Texts are cut into chunks where their words say so: a chunk ends with a word whose hash is a trigger, and overlaps the
next one by as many words as the longest phrase has, less one. A chunk owns the phrases that begin before the overlap,
so that each occurrence belongs to one chunk. Copies and shared passages give the same chunks, of which the dictionary
holds one with its frequency in the parse.

Phrases are counted level by level. A phrase of k words that occurs often enough has two of k - 1 words that do, so a
level leaves out what isn't in the bitmap of the level before. The bitmap has a fixed size; when it is full it lets more
through, and the counts, which are exact, decide.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from orbitspark.llm.common import batches_of, release, written

#: Words of the longest phrase.
MOST = 4
#: One word in so many ends a chunk.
TRIGGER = 32
#: Bits of the bitmap of frequent phrases, as a power of two: 8 MB.
BITMAP = 26
#: Bytes of a string up to which hashes are made of all strings at once; masks of the first 0 to 8 bytes of an integer.
LONG, FIRST_BYTES = 64, np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: Marks that end a piece. In the text's bytes all of them become the first, and A-Z become small.
STOPS = b".,;:!?\n\x0b\x0c\r"
LOWER = bytes.maketrans(STOPS + b"\tABCDEFGHIJKLMNOPQRSTUVWXYZ", b"." * len(STOPS) + b" abcdefghijklmnopqrstuvwxyz")


class Triggers(dict):
    """Whether a word ends a chunk; ends of pieces never do. What is remembered is bounded."""

    def __missing__(self, word: bytes) -> bool:
        if len(self) > 1_000_000:
            self.clear()
        ends = self[word] = word != b"." and xxh64_intdigest(word) % TRIGGER == 0
        return ends


def chunks_of(text: str, triggers: Triggers, most: int = MOST) -> Iterator[tuple[int, int, bytes]]:
    """(own, words, chunk): words and "." for ends of pieces, space-joined; the first `own`, `words` of them words, are the chunk's own."""
    words = text.encode().translate(LOWER).replace(b".", b" . ").split()
    ends = np.flatnonzero(np.fromiter(map(triggers.__getitem__, words), bool, len(words))) + 1
    start = 0
    for end in (*ends.tolist(), len(words)):
        if end > start:
            yield end - start, end - start - words[start:end].count(b"."), b" ".join(words[start : end + most - 1])
        start = end


def chunk_dictionary(docs: DataFrame) -> DataFrame:
    """(lang, own, words, chunk, n): the distinct chunks of all texts by language, with their frequency n in the parse.

    own: how many words and ends of pieces the chunk owns, from its first on; words: how many of them are words.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        triggers = Triggers()
        for b in batches:
            found: Counter = Counter()
            for lang, text in b.itertuples(index=False):
                found.update((lang, *chunk) for chunk in chunks_of(text, triggers))
            rows = [(lang, own, words, chunk.decode(), n) for (lang, own, words, chunk), n in found.items()]
            yield pd.DataFrame(rows, columns=["lang", "own", "words", "chunk", "n"])

    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where("text is not null")
    return texts.mapInPandas(parse, "lang string, own int, words int, chunk string, n long").groupBy("lang", "own", "words", "chunk").agg(F.sum("n").alias("n"))


def places(lang: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """Where phrases stand in the bitmap, by the hashes of their language and words."""
    h = lang
    for w in words:
        h = (h ^ w) * np.uint64(0x9E3779B97F4A7C15)
        h = h ^ h >> np.uint64(29)
    return (h >> np.uint64(64 - BITMAP)).astype(np.int64)


def held_in(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def hashes(values: pa.StringArray) -> np.ndarray:
    """64-bit hashes of strings, eight bytes of all of them at a time; long strings go one by one."""
    offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    sizes, begins, ends = np.diff(offsets), offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    data = np.zeros(int(ends[-1]) + 8 if len(ends) else 8, np.uint8)
    if len(data) > 8:
        data[:-8] = np.frombuffer(values.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    eights = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    out = sizes.astype(np.uint64) * np.uint64(0x165667B19E3779F9)
    left = np.flatnonzero((sizes > 0) & (sizes <= LONG))
    step = 0
    while len(left):
        rest = sizes[left] - step
        h = (out[left] ^ eights[begins[left] + step] & FIRST_BYTES[np.minimum(rest, 8)]) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ h >> np.uint64(29)) * np.uint64(0xC2B2AE3D27D4EB4F)
        out[left] = h ^ h >> np.uint64(32)
        left = left[rest > 8]
        step += 8
    for i in np.flatnonzero(sizes > LONG).tolist():
        out[i] = xxh64_intdigest(data[begins[i] : ends[i]])
    return out


def flat(chunks: pa.Array) -> tuple[np.ndarray, pa.StringArray, np.ndarray]:
    """The words of chunks, one after another, as codes of a list of distinct ones, and the numbers of words of each chunk."""
    lists = pc.split_pattern(chunks, " ")
    coded = lists.flatten().dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary, pc.list_value_length(lists).to_numpy()


def phrase_counts(dictionary: DataFrame, k: int, bits: np.ndarray | None) -> DataFrame:
    """(lang, phrase, n): occurrences of phrases of k words; those of which a part isn't in the bitmap are left out."""
    held = dictionary.sparkSession.sparkContext.broadcast(bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            codes, words, lengths = flat(b["chunk"])
            langs = b["lang"].dictionary_encode()
            of = np.repeat(np.arange(b.num_rows), lengths)
            inside = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            # where a phrase of k words begins: in the chunk's own part, without an end of a piece in it
            stop = pc.index(words, ".").as_py()  # -1: none
            good = inside < b["own"].to_numpy()[of]
            far = len(codes) - k + 1
            at = np.arange(max(far, 0))
            good = good[: len(at)] & (of[at] == of[at + k - 1])
            for j in range(k):
                good &= codes[at + j] != stop
            at = at[good]
            lang = langs.indices.to_numpy()[of[at]].astype(np.int64)

            if k > 1:
                hashed, lang_hash = hashes(words), hashes(langs.dictionary)
                keep = np.ones(len(at), bool)
                for first in (0, 1):
                    keep &= held_in(held.value, places(lang_hash[lang], [hashed[codes[at + first + j]] for j in range(k - 1)]))
                at, lang = at[keep], lang[keep]
            columns = {"lang": lang} | {f"w{j}": codes[at + j] for j in range(k)} | {"n": b["n"].to_numpy()[of[at]]}
            found = pa.table(columns).group_by([c for c in columns if c != "n"]).aggregate([("n", "sum")])
            phrase = pc.binary_join_element_wise(*(words.take(found[f"w{j}"].combine_chunks()) for j in range(k)), " ")
            out = pa.record_batch([langs.dictionary.take(found["lang"].combine_chunks()), phrase, found["n_sum"].combine_chunks()], ["lang", "phrase", "n"])
            for i in range(0, out.num_rows, 100_000):
                yield out.slice(i, 100_000)

    counted = dictionary.mapInArrow(count, "lang string, phrase string, n long")
    return counted.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def bitmap_of(phrases: DataFrame, k: int) -> np.ndarray:
    """The bitmap of phrases of k words: at most 2^20 rows of 64 bits come to the driver, whatever the phrases' number."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                codes, words, _ = flat(b["phrase"])
                hashed, langs = hashes(words)[codes].reshape(-1, k), b["lang"].dictionary_encode()
                yield pa.record_batch([places(hashes(langs.dictionary)[langs.indices.to_numpy()], list(hashed.T))], ["bit"])

    one = F.expr("shiftleft(1L, int(bit & 63))")
    found = phrases.select("lang", "phrase").mapInArrow(bits, "bit long")
    rows = found.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(one).alias("bits")).toArrow()
    bitmap = np.zeros(1 << (BITMAP - 6), np.uint64)
    bitmap[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return bitmap


def frequent_phrases(docs: DataFrame, least: int, most: int = MOST) -> tuple[list[DataFrame], DataFrame]:
    """Tables (lang, phrase, n) of the phrases of 1, 2, ... words with n >= least, and (lang, n) of all words."""
    spark = docs.sparkSession
    batches_of(spark)
    dictionary = written(chunk_dictionary(docs), "chunks")
    release(spark)
    totals = dictionary.groupBy("lang").agg(F.sum(F.col("n") * F.col("words")).alias("n"))
    levels, bits = [], None
    for k in range(1, most + 1):
        counts = phrase_counts(dictionary, k, bits)
        levels.append(written(counts.where(F.col("n") >= least), f"phrases{k}"))
        release(spark)
        if k < most:
            bits = bitmap_of(levels[-1], k)
    return levels, totals


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, scale: int = 2_000_000, cover: int = 80) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the phrases of 2 to 4 words that hold together most, by language.

    a, l, r: occurrences of the phrase, of its first part and of the rest, at the cut of the lowest score, the first of
    such cuts; score: floor(scale * a / (l + r)), in exact arithmetic. A phrase that a longer one of at least `least`
    occurrences holds, with `cover` percent of its own or more, is left out. n: all words of the language.

    Null texts count as empty, a null lang as `und`. Rows count each, whatever their other columns, which are never read;
    ties go by phrase. An empty table gives no rows.
    """
    levels, totals = frequent_phrases(docs, least)
    known = reduce(DataFrame.unionByName, levels).select("lang", "phrase", F.col("n").alias("f"))
    words = F.split("phrase", " ")
    longer = reduce(DataFrame.unionByName, [t.withColumn("k", F.lit(k)) for k, t in enumerate(levels, 1) if k > 1]).select("lang", "phrase", F.col("n").alias("a"), "k")
    part = lambda first, size: F.array_join(F.slice("words", first, size), " ")

    cuts = longer.withColumn("words", words).withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("head"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr(f"cast(a as decimal(20,0)) * {scale}BD div (cast(l as decimal(20,0)) + r)")
    best = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best")
    scored = cuts.groupBy("lang", "phrase", "a").agg(best).select("lang", "phrase", "a", "best.l", "best.r", "best.score")

    # what longer phrases hold: their parts of two words or more
    sizes = F.sequence(F.lit(2), F.col("k") - 1)
    inner = F.flatten(F.transform(sizes, lambda s: F.transform(F.sequence(F.lit(1), F.col("k") - s + 1), lambda i: F.array_join(F.slice("words", i, s), " "))))
    holders = longer.where("k > 2").withColumn("words", words).select("lang", F.explode(inner).alias("phrase"), "a")
    holders = holders.groupBy("lang", "phrase").agg(F.max("a").alias("held"))
    left = scored.join(holders, ["lang", "phrase"], "left").where(f"held is null or 100 * held < {cover} * a")
    # each task keeps its first ones of a language, so that no more than those meet
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
