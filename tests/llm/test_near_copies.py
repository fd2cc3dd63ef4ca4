"""Near copies against all pairs of exact five-word shingle similarities."""

import random

import numpy as np
import pytest

import corpus_pipeline
from conftest import SMALL
from orbitspark.llm import near_copies, simhash
from test_operators import ODD


def edited(words, share, rng):
    return [f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


@pytest.fixture(scope="module")
def planted():
    """(doc_id, text): 120 texts of 60 to 400 words, each with copies of 0.4 and 3 % other words, and 120 copies of one text with 1.2 %."""
    rng, texts = random.Random(7), []
    for k in range(120):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 400))]
        texts += [words, edited(words, 0.004, rng), edited(words, 0.03, rng)]
    words = [f"w{rng.randrange(5000)}" for _ in range(150)]
    texts += [edited(words, 0.012, rng) for _ in range(120)]
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def least_ids(rows):
    """The smallest id of each component of similarity >= 0.8, and the number of links between different texts."""
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    root, links = list(range(len(rows))), 0

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 10 * both >= 8 * (len(sets[a]) + len(sets[b]) - both):
                links += sets[a] != sets[b]
                s, t = sorted((find(a), find(b)))
                root[t] = s
    return sorted({rows[find(k)][0] for k in range(len(rows))}), links


@pytest.mark.parametrize(("cap", "block"), [(2, 256), (2, 4), (64, 256)])
def test_stage_finds_edited_copies(spark, planted, cap, block):
    docs = spark.createDataFrame(planted, "doc_id long, text string")
    want, links = least_ids(planted)
    assert links > 500
    got = sorted(r["doc_id"] for r in near_copies.near_dedup(docs, cap=cap, block=block).collect())
    assert got == want
    if cap == 64:
        assert sorted(r["doc_id"] for r in corpus_pipeline.simhash_dedup(spark, docs, SMALL).collect()) == want


def distance(a, b):
    return bin((simhash.print_of(a) ^ simhash.print_of(b)) & 2**64 - 1).count("1")


@pytest.mark.parametrize("cap", [2, 64])
def test_simhash_alone_links_all_near_prints_that_are_similar(spark, monkeypatch, cap):
    """Without bands the links are those of all pairs of SimHashes within two bits, but for sets below the similarity.

    In keys of more nodes than the cap, sets that are similar are linked at any distance.
    """
    rng, texts = random.Random(5), []
    for _ in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(400)]
        texts += [words, [*words[:-1], "other"], [*words[:-1], "another"], [*words[:100], "far", *words[200:]]]
    words = [f"v{k}" for k in range(6)]
    texts += [words[:k] for k in (5, 6)] + [[]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = [near_copies.shingle_set(t, 5) for _, t in rows]
    root, links = list(range(len(rows))), []
    for a in range(len(rows)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if both and distance(sets[a], sets[b]) <= 2 and 10 * both >= 8 * (len(sets[a]) + len(sets[b]) - both):
                links.append((a, b))
                s, t = sorted((root[a], root[b]))
                root = [s if r == t else r for r in root]
    assert len(links) > 20
    monkeypatch.setattr(near_copies, "band_keys", lambda members: np.empty(0, np.int64))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    grouped = near_copies.grouped_rows(docs, "doc_id", "text", 5, 0.8, cap, near_copies.BLOCK)
    group = {r["doc_id"]: r["root"] for r in grouped.collect()}
    assert len(group) == len(rows) and all(group[a] == group[b] for a, b in links)
    if cap == 64:
        assert len(set(group.values())) == len(set(root)) < len(rows)


def test_one_word_of_two_hundred(spark):
    words = [f"w{k}" for k in range(200)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:90], "other", *words[91:]])), (3, " ".join(words[::-1]))]
    out = corpus_pipeline.simhash_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), SMALL)
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 3]


def test_odd_texts(spark):
    rows = [(i, t, None, None, None, "f", None, "k", i) for i, t in [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  B"), (None, "a b"), (6, "c")]]
    out = near_copies.near_dedup(spark.createDataFrame(rows, ODD))
    assert out.columns == spark.createDataFrame([], ODD).columns and sorted(r["doc_id"] for r in out.collect()) == [1, 4, 6]
    assert near_copies.near_dedup(spark.createDataFrame([], ODD)).count() == 0


def test_blocks_compare_like_sets():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 60)).astype(np.uint64)) for _ in range(60)]
    got = near_copies.similar(sets[:25], sets[25:], 0.6)
    for a in range(25):
        for b in range(35):
            x, y = set(sets[a].tolist()), set(sets[25 + b].tolist())
            assert got[a, b] == (10 * len(x & y) >= 6 * len(x | y))


def test_chains_in_hot_keys(spark):
    """Texts of one long common part, each like the next one only, in hot keys whose blocks don't hold neighbours."""
    rng = random.Random(11)
    words, texts = [f"c{k}" for k in range(200)], []
    for chain in range(6):
        own = [f"o{chain}.{k}" for k in range(60)]
        text = words + own
        for step in range(25):
            at = 200 + step * 2 % 60
            text = [*text[:at], f"e{chain}.{step}", *text[at + 1 :]]
            texts.append(" ".join(text))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    want, _ = least_ids(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in near_copies.near_dedup(docs, cap=3, block=4).collect()) == want


@pytest.mark.parametrize("share", [0.3, 0.6, 0.9])
def test_prefixes_find_all_links(spark, share):
    rng = np.random.default_rng(int(share * 10))
    base = rng.integers(0, 2**63, 60).astype(np.uint64)
    sets = []
    for k in range(80):
        own = rng.integers(0, 2**63, rng.integers(1, 14)).astype(np.uint64)
        sets.append(np.unique(np.concatenate([base[rng.random(60) < 0.9 + share / 12], own[: k % 14]])))
    nodes = [(k, k, s.tobytes()) for k, s in enumerate(sets)]
    df = spark.createDataFrame(nodes, "fp long, root long, members binary")
    got = {(r["u"], r["v"]) for r in near_copies.prefix_links(df.select("fp", "root"), df.select("fp", "members"), 0.8).collect()}
    as_sets = [set(s.tolist()) for s in sets]
    want = {(a, b) for a in range(80) for b in range(a) if 10 * len(as_sets[a] & as_sets[b]) >= 8 * len(as_sets[a] | as_sets[b])}
    assert got == want and want
