"""Phrase collocations, BPE with word ends, and the Merkle manifest, against plain versions and another library."""

import random
import re
from collections import Counter
from hashlib import sha256
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import SMALL
from oracle_check import assert_same
from orbitspark.llm import collocations, merkle, queries, word_bpe

WORDS = public_tokenizers.path("word_bpe_49k.json")
ROWS = "doc_id long, source string, lang string, n_chars long, text string, key string, i int, path string"


def small(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@pytest.mark.parametrize("name", ["op11_phrase_collocations", "op13_merkle_manifest"])
def test_query_equals_sql(spark, name):
    assert_same(queries.queries()[name](spark, SMALL), queries.oracle_sql()[name], SMALL)


# --- collocations


def plain_collocations(rows, least, top, scale=2_000_000, cover=80):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", small(text or "")):
            w = re.findall("[^ \t]+", piece)
            totals[lang or "und"] += len(w)
            counts.update((lang or "und", tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    found = {p: a for p, a in counts.items() if len(p[1]) > 1 and a >= least}
    held = Counter()
    for (lang, w), a in found.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                held[lang, w[i : i + k]] = max(held[lang, w[i : i + k]], a)
    out = {}
    for (lang, w), a in found.items():
        if 100 * held[lang, w] < cover * a or not held[lang, w]:
            cuts = [(counts[lang, w[:c]], counts[lang, w[c:]]) for c in range(1, len(w))]
            score, _, l, r = min((scale * a // (l + r), c, l, r) for c, (l, r) in enumerate(cuts))  # noqa: E741
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return {(lang, i, p.decode(), -a, l, r, totals[lang], -s) for lang, own in out.items() for i, (s, a, p, l, r) in enumerate(sorted(own)[:top], 1)}  # noqa: E741


def odd_texts():
    rng = random.Random(3)
    vocab = ["a", "B", "of", "the", "é", "ﬁn", "x\x1cy", "\xa0", "new", "york", "ß", "-", "日本"]
    texts = [("en" if rng.random() < 0.7 else None, "".join(rng.choice(vocab) + rng.choice([" ", " ", "\t", "  ", ". ", ",", "\n", "\x0b"]) for _ in range(rng.randrange(60)))) for _ in range(300)]
    return texts + [("de", "New York " * 400), ("de", "a" * 50_000), ("en", ""), ("fr", None), (None, "...!"), ("und", "a b a b a b")] + texts[:40]


@pytest.mark.parametrize(("least", "top"), [(3, 2000), (30, 2000), (2, 7)])
def test_collocations_equal_plain_counts(spark, least, top):
    rows = odd_texts()
    df = spark.createDataFrame([(1, lang, text, "x", "y") for lang, text in rows], "doc_id long, lang string, text string, phrase string, n string")
    got = {tuple(r) for r in collocations.collocations(df, least, top).collect()}
    assert got == plain_collocations(rows, least, top) and got


def test_full_bitmap_changes_nothing(spark, monkeypatch):
    rows = odd_texts()
    df = spark.createDataFrame(rows, "lang string, text string")
    monkeypatch.setattr(collocations, "bitmap_of", lambda *_: np.full(1 << (collocations.BITMAP - 6), 2**64 - 1, np.uint64))
    assert {tuple(r) for r in collocations.collocations(df, 5).collect()} == plain_collocations(rows, 5, 2000)


def test_collocations_of_an_empty_table(spark):
    assert not collocations.collocations(spark.createDataFrame([], "lang string, text string")).count()


def test_hashes_of_words_need_no_call_each(monkeypatch):
    words = sorted({f"{a}{b}" for a in ("", "x", "\u00e9t\u00e9", "a word of seventeen") for b in range(20_000)} | {""})
    long = ["y" * 65, "y" * 66, "z" * 900]
    whole = collocations.hashes(pa.array(words + long))
    assert len(np.unique(whole)) == len(words) + len(long) == len(np.unique(whole >> np.uint64(24)))
    # a string has one hash, wherever it stands
    assert (collocations.hashes(pa.array(["..", *reversed(words + long)]).slice(1)) == whole[::-1]).all()
    assert not len(collocations.hashes(pa.array([], pa.string()))) and (collocations.hashes(pa.array([""])) == whole[:1]).all()
    # before: a call of the library for every word of every batch, in each pass
    monkeypatch.setattr(collocations, "xxh64_intdigest", None)
    assert (collocations.hashes(pa.array(words)) == whole[: len(words)]).all()


def test_chunks_own_every_phrase_once():
    triggers = collocations.Triggers()
    for _, text in odd_texts():
        words = [w for w in re.split("[ \t]+", re.sub("[.,;:!?\n\x0b\x0c\r]", " . ", small(text or ""))) if w]
        whole = Counter(tuple(words[i : i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))
        got = Counter()
        for own, said, chunk in collocations.chunks_of(text or "", triggers):
            w = chunk.decode().split(" ")
            assert said == sum(x != "." for x in w[:own])
            got.update(tuple(w[i : i + k]) for k in range(1, 5) for i in range(own) if i + k <= len(w))
        assert got == whole


def test_copies_share_chunks(spark):
    text = " ".join(f"w{i % 97}" for i in range(3000))
    one = collocations.chunk_dictionary(spark.createDataFrame([("en", text)], "lang string, text string"))
    many = collocations.chunk_dictionary(spark.createDataFrame([("en", text)] * 500, "lang string, text string"))
    assert many.count() == one.count() and many.agg(F.sum("n")).first()[0] == 500 * one.agg(F.sum("n")).first()[0]


# --- BPE with word ends


def assert_like_library(texts):
    coder, library = word_bpe.WordBPE(WORDS), Tokenizer.from_file(WORDS)
    for t, ids, want in zip(texts, coder.encode(texts), library.encode_batch([t or "" for t in texts], add_special_tokens=False), strict=True):
        assert ids == np.array(want.ids, "<u4").tobytes(), repr(t[:60])
        assert coder.decode(ids) == library.decode(want.ids, skip_special_tokens=False)


def test_word_bpe_on_odd_texts():
    rng = random.Random(1)
    letters = ["a", "b", "C", "é", "é", " ", "'", "'s", "'LL", "-", "—", "1", "²", "’", "ß", "ŝ", "\x1c", "\x00", "\x85", "\xa0", " ", "|", "<", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "日", "😀", "‍", "İ", "Σ", "ǅ", "\n", "\x0b", "가", "ᄀ", "ᅡ", "\ue000"]
    assert_like_library(["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(4000)] + [None, "", " \n\t", "x"])


def test_word_bpe_on_all_code_points():
    """Alone and between letters, so that what a file's pattern takes for a letter, a number or white space shows."""
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    assert_like_library([f"a{c}a 1{c} {c}{c}" for c in points[:0x3400]] + [" ".join(f"a{c}a" for c in points[i : i + 500]) for i in range(0x3400, len(points), 500)])


def test_long_words_in_stretches():
    """Words of many stretches, with pairs that overlap across them."""
    rng = random.Random(2)
    runs = ["a" * n for n in (126, 127, 128, 129, 1000, 4097)] + ["ab" * 300, "aab" * 500, "b" * 127 + "a" * 700, "th" + "a" * 255 + "the" * 99]
    assert_like_library(runs + ["".join(rng.choice(a) for _ in range(n)) for a in ("ab", "aeth", "abcdefghijklmnopqrstuvwxyz", "éß日a") for n in (130, 500, 3000)])


def test_memory_of_word_bpe_is_bounded(monkeypatch):
    monkeypatch.setattr(word_bpe, "REMEMBERED", 50)
    coder, library = word_bpe.WordBPE(WORDS), Tokenizer.from_file(WORDS)
    for _ in range(3):
        for k in range(0, 600, 30):
            texts = [f"word{i} other{i % 7} x" for i in range(k, k + 40)]
            assert coder.encode(texts) == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
            assert len(coder.known) < 200


def test_op12_query(spark, tmp_path):
    library = Tokenizer.from_file(WORDS)
    rows = [(1, "Hello, WORLD's 12 é"), (1, "Hello, WORLD's 12 é"), (2, ""), (3, None), (None, "<|endoftext|>"), (4, "z" * 30_000)]
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, ids string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op12_word_bpe(spark, str(tmp_path)).collect()), key=str)
    ids = [library.encode(t or "", add_special_tokens=False).ids for _, t in rows]
    want = [(d, len(x), sha256(np.array(x, "<u4").tobytes()).hexdigest(), sha256(library.decode(x, skip_special_tokens=False).encode()).hexdigest()) for (d, _), x in zip(rows, ids, strict=True)]
    assert got == sorted(want, key=str)


# --- Merkle manifest


def plain_manifest(rows):
    h = lambda x: sha256(x.encode()).hexdigest()
    leaf = lambda r: h("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in r))

    def tree(leaves):
        """Its root, and for each leaf what stands left and right, level by level."""
        level, sides, at = leaves, [[] for _ in leaves], list(range(len(leaves)))
        while len(level) > 1:
            for own, i in zip(sides, at, strict=True):
                run = i // 16 * 16
                own.append(("".join(level[run:i]), "".join(level[i + 1 : run + 16])))
            level, at = [h("".join(level[i : i + 16])) for i in range(0, len(level), 16)], [i // 16 for i in at]
        return level[0], sides

    by_source = {}
    for doc, source, lang, n, text in rows:
        changed = small(text) if text is not None and doc is not None and crc32(str(doc).encode()) % 5 == 0 else text
        by_source.setdefault(source, []).append((doc, leaf((doc, source, lang, n, text)), leaf((doc, source, lang, n, changed))))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted(by_source[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1])) for s in sources}
    trees = {s: tree([x[1] for x in own[s]]) for s in sources}
    root, tops = tree([trees[s][0] for s in sources])
    out = []
    for s, top in zip(sources, tops, strict=True):
        for (doc, a, b), sides in zip(own[s], trees[s][1], strict=True):
            fold = b
            for x, y in sides + top:
                fold = h(x + fold + y)
            out.append((doc, a, trees[s][0], root, h("".join(x + y for x, y in sides + top)), fold, fold == root))
    return sorted(out, key=str)


def with_names(rows):
    """Rows with columns that clash with the operator's own."""
    return [(*r, "k", 7, "p") for r in rows]


@pytest.mark.parametrize("sizes", [[1], [2], [16, 17], [1] * 20, [257, 3, 300], [5000, 1, 40]])
def test_manifest_equals_plain_trees(spark, sizes):
    rows = [(10 * k + 7 * i, f"s{k}", None if i % 3 else "en", i, None if i % 11 == 5 else f"Text {i % 13}") for k, n in enumerate(sizes) for i in range(n)]
    got = merkle.manifest(spark.createDataFrame(with_names(rows), ROWS)).collect()
    assert sorted(map(tuple, got), key=str) == plain_manifest(rows)


def test_manifest_of_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (5, "", "", 0, ""), (5, "", "", 0, ""), (5, "", "en", 1, "A"), (9, "é", "fr", 2, "É" * 100_000), (9, "z", "fr", 2, "B"), (-3, "z", "fr", 2, "b"), (0, "Z", None, -1, "\x00:")]
    got = sorted(map(tuple, merkle.manifest(spark.createDataFrame(with_names(rows), ROWS)).collect()), key=str)
    assert got == plain_manifest(rows)


def test_manifest_of_an_empty_table(spark):
    assert not merkle.manifest(spark.createDataFrame([], ROWS)).count()


def test_addresses_of_a_tree():
    for levels in range(1, 6):
        places = [merkle.address(levels, d, np.arange(16**d)) for d in range(levels)]
        assert sorted(np.concatenate(places)) == list(range(merkle.tree_size(levels))) and places[0][0] == 0
    # four levels: the upper two first, then 256 trees of two levels, each in one stretch
    for k in (0, 1, 255):
        tree = [merkle.address(4, 2, np.array([k]))[0], *merkle.address(4, 3, np.arange(16 * k, 16 * k + 16))]
        assert tree == list(range(17 + 17 * k, 34 + 17 * k))


def test_block_root_is_that_of_plain_runs():
    leaves = [sha256(str(i).encode()).hexdigest() for i in range(300)]
    level = leaves
    while len(level) > 1:
        level = [sha256("".join(level[i : i + 16]).encode()).hexdigest() for i in range(0, len(level), 16)]
    assert merkle.build("".join(leaves), 3)[:32].hex() == level[0]
