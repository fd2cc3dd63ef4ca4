"""The operators against brute force, and on nulls, empty, long, tied, repeated and clashing input."""

import hashlib
import math
import random
import re
import time
import zlib
from array import array
from fractions import Fraction

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import SMALL
from oracle_check import assert_same
from orbitspark.llm import byte_bpe, extraction, licenses, packing, quality, queries, sharding, simhash, suffix_dedup, topk, toxicity
from orbitspark.llm.suffix_array import permuted_prefixes, suffix_array

ODD = "doc_id long, text string, lang string, source string, n_chars long, fp string, shard string, kept string, `key` int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    long = " ".join(f"word{i % 977}" for i in range(40_000))
    line = "the same quite long line of more than fifty bytes stands in many texts"
    texts = [(1, None), (2, ""), (3, long), (4, long), (5, f"one {line} end"), (6, f"two {line} End"), (6, f"two {line} End"), (None, f"two {line} End"), (None, None), (7, "  \n\t"), (8, "ß漢🙂 " * 30), (9, "a b"), (10, "x" * 300)]
    rows = [(i, t, "en" if k % 3 else None, None, None, "f", None, "k", k) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, ODD)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], ODD)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def documents():
    return duckdb.sql(f"select doc_id, text from '{SMALL}/documents.parquet'").fetchall()


# --- SimHash


def plain_fingerprint(text, width=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    group = {f: f for f in prints}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    keys = sorted(prints)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a ^ b).bit_count() <= 2:
                group[find(a)] = find(b)
    return {f: find(f) for f in keys}


def test_simhash_equals_brute_force(spark):
    docs = documents()
    prints = {i: plain_fingerprint(t) for i, t in docs}
    roots = plain_components(set(prints.values()))
    least = {}
    for i, f in prints.items():
        least[roots[f]] = min(i, least.get(roots[f], i))
    want = {(i, f"{f:016x}", least[roots[f]]) for i, f in prints.items()}
    assert {tuple(r) for r in queries.op1_simhash_dedup(spark, SMALL).collect()} == want


def test_golay_keys_meet_within_two_bits():
    rng = np.random.default_rng(1)
    x = rng.integers(-(2**63), 2**63 - 1, 4000, dtype=np.int64)
    y = x.copy().view(np.uint64)
    for _ in range(2):
        y ^= np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64)
    for a, b in zip(simhash.fuzzy_keys(x), simhash.fuzzy_keys(y.view(np.int64)), strict=True):
        assert len(np.intersect1d(a, b)) and len(a) <= 18


@pytest.mark.parametrize("cap", [0, 64])
def test_links_keep_components_whatever_the_cap(spark, cap):
    rng = random.Random(4)
    prints = {rng.getrandbits(64)}
    while len(prints) < 150:
        prints.add(rng.choice(sorted(prints)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64) if rng.random() < 0.5 else 0))
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for f in prints], "fp long")
    found = simhash.components(simhash.links(df, cap)).collect()
    root = {r["node"]: r["root"] for r in found}
    want = plain_components(prints)
    for f in prints:
        for g in prints:
            assert (root.get(signed(f), signed(f)) == root.get(signed(g), signed(g))) == (want[f] == want[g])


def test_near_dedup_keeps_one_of_each(spark, odd, nothing):
    kept = simhash.near_dedup(odd)
    assert kept.columns == odd.columns
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    prints = [plain_fingerprint(t) for _, t in rows]
    roots, least = plain_components(set(prints)), {}
    for (i, _), f in zip(rows, prints, strict=True):
        least[roots[f]] = min(math.inf if i is None else i, least.get(roots[f], math.inf))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(least.values())
    assert simhash.simhash_groups(odd).count() == odd.count() and simhash.near_dedup(nothing).count() == 0


# --- byte BPE


@pytest.fixture(scope="module")
def coders():
    own = byte_bpe.coder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    return own, tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def test_bpe_equals_library(coders):
    own, other = coders
    rng = random.Random(2)
    texts = [t or "" for _, t in documents()] + ["".join(rng.choice(" \n\t \x1c'aàbß漢🙂1½.!?s lltre<|endoftext|> ") for _ in range(rng.randrange(40))) for _ in range(3000)]
    for t in texts:
        ids = own.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == other.encode_ordinary(t)
        assert own.decode(ids) == t.encode()


def test_bpe_long_piece(coders):
    own, other = coders
    for t in ("ab" * 3000, "thethe" * 500, "\n" * 2000):
        assert np.frombuffer(own.encode(t), "<u4").tolist() == other.encode_ordinary(t)


def test_bpe_is_linear_in_a_piece(coders):
    own, other = coders
    letters = "".join(random.Random(4).choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    assert np.frombuffer(own.encode(letters[:20_000]), "<u4").tolist() == other.encode_ordinary(letters[:20_000])
    spent = []
    for n in (100_000, 1_000_000):
        began = time.process_time()
        own.encode(letters[:n])
        spent.append(time.process_time() - began)
    assert spent[1] < 25 * max(spent[0], 0.05)


def test_bpe_query(spark, coders, odd, nothing):
    want = {}
    for i, t in documents():
        ids = coders[1].encode_ordinary(t or "")
        want[i] = (len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert {r[0]: tuple(r)[1:] for r in queries.op2_byte_bpe(spark, SMALL).collect()} == want
    path = P.path("byte_bpe_multi_50k.tiktoken")
    for df in (odd, nothing):
        back = df.withColumn("ids", byte_bpe.encode(F.col("text"), path, P.PATTERN)).withColumn("b", byte_bpe.decode(F.col("ids"), path, P.PATTERN))
        assert all(bytes(r["b"]).decode() == (r["text"] or "") for r in back.collect())


# --- top-k


def test_topk_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (50, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [nan, 0.0]), (3, None), (4, [inf, 1.0]), (5, [None, 1.0]), (None, [9.0, 9.0]), (6, [-1.0, -1.0]), (6, [-1.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, block=1).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 81920), (0, 2, 50, 81920), (0, 3, 6, -98304), (0, 4, 6, -98304), (50, 1, 0, 81920), (50, 2, 1, 81920), (50, 3, 6, -98304), (50, 4, 6, -98304)]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_topk_elimination_is_exact():
    rng = np.random.default_rng(5)
    x = rng.integers(-40, 40, (3000, 8))
    x[::3] = x[0]
    pivots = topk.chosen_pivots(x[:200], 12)
    block = topk.Block(np.arange(20), x[:20], pivots, np.full(20, -np.inf), 5)
    best = [[] for _ in range(20)]
    for a in range(0, 3000, 700):
        block.search(np.arange(a, min(a + 700, 3000)), x[a : a + 700], topk.distances(x[a : a + 700], pivots), best)
    for q in range(20):
        want = sorted(((int(x[q] @ x[c]), -c) for c in range(3000) if c != q), reverse=True)[:5]
        assert best[q] == want


def test_topk_repeated_query_id(spark):
    few = [(0, [1.0, 1.0]), (0, [1.0, 0.9]), *((i, [i / 16, 0.0]) for i in range(1, 6))]
    many = [(0, [1.0, 1.0])] * 40 + [(i, [i / 256, 0.0]) for i in range(1, 81)]
    for rows, best in ((few, [5, 4, 3, 2, 1]), (many, [80, 79, 78, 77, 76])):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        got = topk.top_k(df, F.col("vec_id") == 0).orderBy("rank").collect()
        assert [r["vec_id"] for r in got] == best


def test_topk_lengths_and_large_components(spark):
    rows = [(1, [1.0, 2.0]), (2, [3.0, 1.0]), (3, [1.0, 1.0, 1.0]), (4, [2.0, 0.0, 0.0]), (5, None), (None, [1.0, 1.0]), (6, [float("nan"), 1.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") <= 4).collect()
    assert {(r["query_id"], r["vec_id"]) for r in got} == {(1, 2), (2, 1), (3, 4), (4, 3)}
    # sums of products beyond 2^53, exact, with what floats would tie
    big = [(1, [2.0**22, 1.0]), (2, [2.0**22, 1.0]), (3, [2.0**22, 2.0]), (4, [2.0**22, 0.0])]
    got = topk.top_k(spark.createDataFrame(big, "vec_id long, embedding array<double>"), F.col("vec_id") == 1).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(3, 2**60 + 2 * 2**16), (2, 2**60 + 2**16), (4, 2**60)]
    for x in (1e18, 1e9):
        with pytest.raises(Exception, match="64 bits"):
            topk.top_k(spark.createDataFrame([(1, [x]), (2, [x])], "vec_id long, embedding array<double>"), F.col("vec_id") == 1).collect()


def test_topk_eliminates():
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(40, 8)) * 2000)[rng.integers(0, 40, 4000)].astype(np.int64) + rng.integers(-50, 50, (4000, 8))
    pivots = topk.chosen_pivots(x[:1000], 24)
    block = topk.Block(np.arange(30), x[:30], pivots, topk.starting_floor(np.arange(30), x[:30], np.arange(1000), x[:1000], 5), 5)
    best = [[] for _ in range(30)]
    block.search(np.arange(4000), x, topk.distances(x, pivots), best)
    assert block.evaluated < 0.2 * 30 * 4000
    for q in range(30):
        assert best[q] == sorted(((int(x[q] @ x[c]), -c) for c in range(4000) if c != q), reverse=True)[:5]


# --- toxicity


def test_toxicity_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    found = {r["doc_id"]: r for r in queries.op4_toxicity(spark, d).collect()}
    truth = duckdb.sql(f"select doc_id, toxic from '{d}/labels.parquet'").fetchall()
    held = [(found[i], y) for i, y in truth if found[i]["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in found.items())
    assert np.mean([r["predicted"] == y for r, y in held]) >= 0.9
    assert np.mean([r["predicted"] for r, y in held if not y]) <= 0.05
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found.values())


def test_grammar_scores_clauses_not_words():
    s = toxicity.Scorer({"idiot": 1.0, "lowe*": 0.5})
    assert s.clause(["idiot"]) == s.clause(["you"]) == s.clause([]) == 0
    assert s.clause("you are an idiot".split()) > s.clause("an idiot".split()) > s.clause("not an idiot".split()) > 0
    assert s.clause("he said what an idiot".split()) < s.clause("he what an idiot".split())
    assert s.clause("i will kill you".split()) == s.clause("i am killing you".split()) == 2.0 and s.clause("i will kill time".split()) == 0
    assert s.clause("we kill time with them".split()) == 0 and s.clause("i will kill all of you".split()) == 0 and s.clause("kill every one".split()) == 0
    assert s.clause("kill all him".split()) == 2.0
    assert s.clause("ich töte dich".split()) == s.clause("te matarán".split()) + 2 == 2.0
    assert s.clause("die loweiä".split()) == 0.5
    assert s.features("A fine day. You idiot! Nice. Idiot.")[2] == 1 and s.features(None) == s.features("") == (0, 0, 0, 0)


def test_toxicity_recall(spark):
    """Most of the held-out toxic documents are found, and few others, on a table with enough labels to learn from."""
    d = SMALL.replace("0.001", "0.1")
    found = {r["doc_id"]: r["predicted"] for r in queries.op4_toxicity(spark, d).where("held_out").select("doc_id", "predicted").collect()}
    truth = [(toxic, found[i]) for i, toxic in duckdb.sql(f"select doc_id, toxic from '{d}/labels.parquet'").fetchall() if i in found]
    assert truth.count((1, 1)) >= 0.8 * sum(t for t, _ in truth) and truth.count((0, 1)) <= 0.03 * len(truth)


def plain_clause(kinds, weights):
    """What the grammar gives, word by word from the clause's words as they stand."""
    total = 0.0
    for i, kind in enumerate(kinds):
        factor = toxicity.QUOTED if toxicity.REPORTED in kinds[:i] else 1.0
        if toxicity.NEGATION in kinds[max(0, i - toxicity.REACH) : i]:
            factor *= toxicity.NEGATED
        if toxicity.TARGET in kinds[:i]:
            factor *= toxicity.RAISED
        if kind == toxicity.INSULT and len(kinds) > 1:
            total += factor * weights[i]
        if kind == toxicity.TARGET and toxicity.THREAT in kinds[:i]:
            after = kinds[i - 1 - kinds[:i][::-1].index(toxicity.THREAT) + 1 : i]
            if toxicity.TARGET not in after and len(after) < toxicity.OBJECT_REACH:
                total += factor * toxicity.THREAT_WEIGHT
    return total


def test_composed_grammar_equals_a_plain_parser():
    rng = random.Random(12)
    words = {toxicity.OTHER: "day", toxicity.INSULT: "idiot", toxicity.THREAT: "kill", toxicity.TARGET: "you", toxicity.NEGATION: "not", toxicity.REPORTED: "said"}
    s = toxicity.Scorer({"idiot": 0.7})
    for _ in range(4000):
        kinds = [rng.randrange(6) for _ in range(rng.randrange(9))]
        assert s.clause([words[k] for k in kinds]) == pytest.approx(plain_clause(kinds, [0.7] * len(kinds)))


def test_each_transducer():
    def run(part, symbols):
        state, out, factor = part.start, [], 1.0
        for x in symbols:
            state, y, f = part.step(state, x)
            out.append(y)
            factor *= f
        return out, factor

    T = toxicity
    assert run(T.reported(), [T.INSULT, T.REPORTED, T.INSULT]) == ([T.INSULT, T.REPORTED, T.INSULT], T.QUOTED)
    assert run(T.negation(), [T.NEGATION, T.OTHER, T.OTHER, T.INSULT, T.INSULT])[1] == T.NEGATED
    assert run(T.target(), [T.INSULT, T.TARGET, T.INSULT]) == ([T.INSULT, T.TARGET, T.ADDRESSED], T.RAISED)
    assert run(T.threat(), [T.TARGET, T.THREAT, T.OTHER, T.TARGET, T.TARGET])[0] == [T.TARGET, T.THREAT, T.OTHER, T.THREATENED, T.TARGET]
    assert run(T.insult(), [T.INSULT, T.OTHER, T.ADDRESSED])[0] == [T.HOLD, T.RELEASE, T.NOW] and run(T.insult(), [T.INSULT, T.INSULT])[0] == [T.HOLD, T.BOTH]


def test_toxicity_learns_from_so_many_rows_at_most(spark):
    rows = [(1, f"text you{i} idiot") for i in range(50)] + [(i, "a fine day") for i in range(2, 60)] + [(1, "text you0 idiot")] * 20
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), labels(spark, [(i, None, int(i == 1)) for i in range(60)])
    toxicity.learned(docs, marks, most_rows=30)
    words, _ = toxicity.learned(docs, marks)
    assert words["idiot"] > 0


def test_toxicity_odd(spark, odd, nothing):
    for marks in (labels(spark), labels(spark, [(1, 1, 1), (2, None, 0), (3, 1, 1), (5, 0, None), (None, 1, 1), (5, 1, 0)])):
        scored = toxicity.toxicity_scores(odd, marks).collect()
        assert sorted(str(r["doc_id"]) for r in scored) == sorted(str(r["doc_id"]) for r in odd.collect()) and all(0 <= r["score"] <= 1 for r in scored)
        assert not any(r["held_out"] for r in scored if r["doc_id"] is None)
        assert toxicity.without_toxic(odd, marks).columns == odd.columns
        assert toxicity.toxicity_scores(nothing, marks).count() == 0


# --- quality


def test_quality_equals_sql(spark):
    assert_same(queries.op5_quality_rules(spark, "/root/testdata/sf0.01"), queries.oracle_sql()["op5_quality_rules"], "/root/testdata/sf0.01")


def test_quality_odd(spark, odd, nothing):
    got = {r["key"]: r for r in quality.measures(odd.withColumn("doc_id", F.col("key")), text_col="text").withColumnRenamed("doc_id", "key").collect()}
    assert got[0]["n_words"] == 0 and got[2]["n_words"] == 40_000 and got[2]["n_repeat_words"] == 40_000 and got[11]["n_repeat_words"] == 0
    assert quality.quality_verdicts(odd, labels(spark)).count() == odd.count() and quality.quality_verdicts(nothing, labels(spark)).count() == 0
    assert quality.passing(odd, labels(spark)).columns == odd.columns


def test_binomial_tail_is_exact(spark):
    def exact(n, k, p):
        return float(sum(Fraction(math.comb(n, j)) * p**j * (1 - p) ** (n - j) for j in range(k + 1)))

    cases = [(1, 0), (10, 10), (300, 0), (300, 3), (2000, 30)]
    df = spark.createDataFrame(cases, "n long, k long").select("n", "k", quality.binomial_tail(F.col("n"), F.col("k"), 0.01).alias("p"))
    for r in df.collect():
        assert r["p"] == pytest.approx(exact(r["n"], r["k"], Fraction(1, 100)), rel=1e-8)


# --- licenses


def test_licenses_equal_sql(spark):
    assert_same(queries.op6_license_scan(spark, SMALL), queries.oracle_sql()["op6_license_scan"], SMALL)


def test_license_edits_and_odd(spark, odd, nothing):
    mit = licenses.TEMPLATES["mit"].split()
    close, far = mit[:], mit[:]
    close[40] = "thing"
    for i in range(0, len(far), 9):
        far[i] = "thing"
    df = spark.createDataFrame([(1, "before " + " ".join(close) + " after"), (2, " ".join(far)), (3, "ALL RIGHTS reserved!"), (3, "none")], "doc_id long, text string")
    got = {(r["doc_id"], r["template"]) for r in licenses.license_matches(df).collect()}
    assert got == {(1, "mit"), (3, "all-rights-reserved")}
    assert licenses.license_matches(odd).count() == 0 and licenses.license_matches(nothing).count() == 0
    assert licenses.license_matches(df, {}).count() == 0


def test_license_rows_of_one_id(spark):
    rows = [(3, "x all rights reserved"), (3, "all rights reserved"), (3, "no match here at all in these words"), (None, "so: all rights reserved"), (None, "all rights reserved x y z")]
    for order in (rows, rows[::-1]):
        got = licenses.license_matches(spark.createDataFrame(order, "doc_id long, text string").coalesce(1)).collect()
        assert {(r["doc_id"], r["first_word"], r["containment"]) for r in got} == {(3, 0, 1.0), (None, 0, 1.0)} and len(got) == 2


def test_license_bands_collide_as_stated(spark):
    """Windows of similarity j share a band with probability j each, and equal ones always."""
    rng = random.Random(3)
    for shared in (4, 3, 2):
        rows = []
        for _ in range(3000):
            x = [rng.randrange(-(2**63), 2**63) for _ in range(licenses.WINDOW)]
            rows.append((x, x[:shared] + [rng.randrange(-(2**63), 2**63) for _ in range(licenses.WINDOW - shared)]))
        df = spark.createDataFrame(rows, "a array<long>, b array<long>")
        (a, b), (c, d) = (licenses.window_keys(F.col(x), 1) for x in "ab")
        low, high, any_ = df.select(F.avg((a[0] == c[0]).cast("int")), F.avg((b[0] == d[0]).cast("int")), F.avg(((a[0] == c[0]) | (b[0] == d[0])).cast("int"))).first()
        j = shared / (2 * licenses.WINDOW - shared)
        assert low == pytest.approx(j, abs=0.04) and high == pytest.approx(j, abs=0.04) and any_ >= j - 0.04


# --- packing


def test_packing(spark, odd, nothing):
    other = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    code = packing.encoder(P.path("byte_bpe_50k.json"), P.PATTERN)
    for t in ("a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n", "<|endoftext", "ß漢🙂 <|endoftext|>ß"):
        assert code.encode(t, allowed_special="all") == other.encode(t, add_special_tokens=False).ids
    rows = queries.op7_binary_packing(spark, SMALL).collect()
    ids = {i: [*other.encode(t or "", add_special_tokens=False).ids, 1] for i, t in documents()}
    seen = {}
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and r["length"] & (r["length"] - 1) == 0 and r["length"] <= 2048
        assert r["ids_crc32"] == zlib.crc32(array("I", part).tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]]) and r["offset"] == 0
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + r["length"]
    assert seen == {i: len(x) for i, x in ids.items()}
    assert sorted(r["sequence_id"] for r in rows) == list(range(len(rows)))
    path = P.path("byte_bpe_50k.json")
    out = packing.pack_documents(odd, path, P.PATTERN).collect()
    want = sorted((str(r["doc_id"]), len(other.encode(r["text"] or "", add_special_tokens=False).ids) + 1) for r in odd.collect())
    assert sorted((str(r["doc_id"]), r["doc_tokens"]) for r in out if r["start"] == 0) == want
    assert sum(r["length"] for r in out) == sum(n for _, n in want) and sorted(r["sequence_id"] for r in out) == list(range(len(out)))
    assert packing.pack_documents(nothing, path, P.PATTERN).count() == 0


# --- suffix arrays


def test_suffix_array_equals_sorting():
    rng = random.Random(3)
    for _ in range(400):
        b = bytes(rng.choice(rng.choice([b"a", b"ab", b"abc", bytes(range(256))])) for _ in range(rng.randrange(1, 60))) * rng.randrange(1, 4)
        x = np.frombuffer(b, np.uint8)
        order = suffix_array(x)
        assert order.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        common = permuted_prefixes(x, order, 9)
        for i, j in zip(order[:-1], order[1:], strict=True):
            k = 0
            while k < 9 and max(i, j) + k < len(b) and b[i + k] == b[j + k]:
                k += 1
            assert common[j] == k


def plain_removal(rows, n=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - n + 1):
            first[b[p : p + n]] = min(first.get(b[p : p + n], math.inf), math.inf if i is None else i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if first[b[p : p + n]] < (math.inf if i is None else i):
                gone[p : p + n] = b"\1" * n
        out.append((i, len(b), sum(gone), len(re.findall(rb"\x01+", gone)), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("hot", "block"), [(4096, 2_000_000), (1, 20_000)])
def test_suffix_dedup_equals_brute_force(spark, hot, block):
    rows = documents()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup.without_repeats(df, hot=hot, block=block)
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in got.collect()), key=str) == plain_removal(rows)


def test_suffix_dedup_of_a_very_common_passage(spark):
    rng = random.Random(6)
    line = "a passage of more than fifty bytes that a third of all texts hold, word for word"
    rows = [(None if i % 11 == 0 else i % 250, " ".join([*(f"w{rng.randrange(900)}" for _ in range(rng.randrange(30))), line if i % 3 == 0 else "", *(f"v{rng.randrange(900)}" for _ in range(rng.randrange(30)))])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (4096, 20):
        got = suffix_dedup.without_repeats(df, hot=hot, block=3_000)
        assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in got.collect()), key=str) == plain_removal(rows)


def test_shards_sort_only_what_may_be_equal(monkeypatch):
    """Windows that share a name alone aren't sorted: 40 texts hold the same 30 bytes, and two of them the same 60."""
    rng = random.Random(8)
    some = lambda n: bytes(rng.choices(b"abcdefghijklmnopqrstuvwxyz ", k=n))
    short, long = some(30), some(60)
    texts = [some(80) + short + some(80) + (long if i in (7, 30) else b"") + some(80) for i in range(40)]
    rows = pd.DataFrame({"first_id": range(40), "text": texts})
    blocks = pd.concat(suffix_dedup.packed(500)(iter([rows])))
    asked = pd.concat(suffix_dedup.block_names(50, 3)(iter([blocks])))
    told = pd.concat([suffix_dedup.shared_names(4096)(g) for _, g in asked.groupby("part")]).groupby("block").agg(list).rename(columns={"part": "parts"})
    sent = pd.concat(suffix_dedup.block_windows(50, 3, 1)(iter([blocks.merge(told, on="block")])))
    cold, sizes = sent[sent["kind"] == suffix_dedup.COLD], []
    monkeypatch.setattr(suffix_dedup, "suffix_array", lambda x, cap: sizes.append(len(x)) or suffix_array(x, cap))
    spans = suffix_dedup.shard_spans(50)(cold)
    # before: all 40 texts' windows of the short string's names were in the suffix array
    assert sum(sizes) < 2 * (60 + 4 * 50)
    gone = [np.frombuffer(x, "<i4").reshape(-1, 3) for x in spans["spans"]]
    block_of = {i: b for b, ids in zip(blocks["block"], blocks["ids"], strict=True) for i in np.frombuffer(ids, np.int64).tolist()}
    assert set(spans["block"]) == {block_of[30]} and sum(len(x) for x in gone) >= 1


def test_suffix_dedup_odd(spark, odd, nothing):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = suffix_dedup.without_repeats(odd).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in got), key=str) == plain_removal(rows)
    assert suffix_dedup.without_repeats(nothing).count() == 0


def test_byte_bpe_on_all_code_points():
    """Alone, and between letters, digits and spaces, as the library's own version of Unicode has them."""
    path = P.path("byte_bpe_multi_50k.tiktoken")
    coder = byte_bpe.coder(path, P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    texts = [f"a{c}a 1{c}1 {c}{c} a{c}." for c in map(chr, (*range(0xD800), *range(0xE000, 0x110000)))]
    odd = [t for t, ids in zip(texts, library.encode_ordinary_batch(texts, num_threads=4), strict=True) if coder.encode(t) != np.array(ids, "<u4").tobytes()]
    assert not odd


# --- extraction


def test_extraction_equals_article_of_pages(spark):
    import html

    def article(page):
        m = re.search(r"<article>(.*?)(?:</article>|\Z)", page or "", re.S)
        parts = re.split(r"</?(?:p|h1|article)>", m[1]) if m else []
        clean = (" ".join(html.unescape(re.sub(r"<[^>]*>|<[a-z/][^<]*\Z|</?\Z", "", x.replace("<br>", " "))).split()) for x in parts)
        return " ".join(x for x in clean if x)

    want = {i: article(h) for i, h in duckdb.sql(f"select page_id, html from '{SMALL}/pages.parquet'").fetchall()}
    got = queries.op9_html_extraction(spark, SMALL).collect()
    assert {r["page_id"]: r["text"] for r in got} == want and all(r["n_chars"] == len(r["text"]) for r in got)


def test_extraction_parts():
    page = """<html><head><title>T</title></head><body><header><a href=x>Home</a><p>Welcome to the site, a long enough text.</p></header><div id="cookie-notice"><p>We use cookies to improve things.</p></div>
    <main><div class="post"><h1>Title</h1><p>First para with a <a href="q">link</a> in it.</p><ul><li>One item<li>Two</ul><div class="advert">Buy now! Great offers.</div><p>Second &amp; more&nbsp;text.</p><form><label>Name</label></form></div>
    <section id="comments"><p>I think this is great, thanks so much.</p></section></main><aside><p>Related stuff you may like.</p></aside><script>var a = "<p>x</p>";</script><footer><p>© 2024 Site.</p></footer></body></html>"""
    assert extraction.main_text(page) == "Title First para with a link in it. One item Two Second & more text."
    assert extraction.main_text(None) == extraction.main_text("") == extraction.main_text("<p") == ""


def test_extraction_without_article_needs_the_cut():
    """Pages of which the article element is taken away: the cut is right where the classifier alone isn't."""
    pages = [h for h, in duckdb.sql("select html from '/root/testdata/sf0.01/pages.parquet'").fetchall() if h]
    blocks = flipped = by_cut = alone = 0
    for h in pages:
        want = extraction.main_text(h)
        found = extraction.labelled(h.replace("<article>", "<div>").replace("</article>", "</div>"))
        blocks, flipped = blocks + len(found), flipped + sum(k != x for _, k, x in found)
        by_cut += " ".join(t for t, k, _ in found if k) == want
        alone += " ".join(t for t, _, x in found if x) == want
    assert flipped > 0.02 * blocks and by_cut > 0.85 * len(pages) > alone


def test_extraction_cut_keeps_a_short_line():
    long = "This is a paragraph of the article, long enough that the classifier takes it for content at once, as it has many words."
    page = f"<body><div><p>{long}</p><p>Yes</p><p>{long}</p></div><div><a href=a>Home</a></div></body>"
    found = extraction.labelled(page)
    assert [(k, x) for _, k, x in found] == [(True, True), (True, False), (True, True), (False, False)]


def test_extraction_frames():
    long = "This is a sentence of the article that is long enough to be one of its paragraphs. " * 3
    text = " ".join(long.split())
    side = "<div class='sidebar'><p>Something that you may like, too.</p></div>"
    assert extraction.main_text(f"<body><div class='site right-sidebar'><article><p>{long}</p></article>{side}</div></body>") == text
    assert extraction.main_text(f"<body><form id='aspnetForm'><article><p>{long}</p></article>{side}</form></body>") == text
    comments = f"<div id='comments'><article class='comment'><p>{long}</p></article><article class='comment'><p>{long}</p></article></div>"
    assert extraction.main_text(f"<body><article><h1>Title</h1><p>{long}</p><p>All rights reserved.</p></article>{comments}</body>") == f"Title {text} All rights reserved."
    assert extraction.main_text(f"<article><p>{long}<button>Subscribe</button></p><select><option>One</select></article>") == text


STORY = "The council met on Monday to discuss the plan for the new bridge, which would join both banks of the river. Most members spoke in favour of it, though some asked for another look at its costs. "


@pytest.mark.parametrize("wrap", ["<body class='single comments-open'>{}</body>", "<body><div class='post has-comments'>{}</div></body>", "<body><div class='replies-enabled site'>{}</div></body>", "<body><div id='comments-wrapper'>{}</div></body>", "<html class='no-sidebar comments'><body class='comments'>{}</body></html>"])
def test_names_of_wrappers_don_t_drop_the_article(wrap):
    text = (STORY * 3).strip()
    comments = "<section class='comments'><h2>Comments</h2><ol><li><p>First! A great read, thank you so much for writing all of this down.</p></li></ol></section>"
    page = wrap.format(f"<header><nav><a href='/'>Home</a> <a href='/news'>News</a></nav></header><article><h1>A bridge</h1><p>{text}</p></article>{comments}<footer>Imprint</footer>")
    assert extraction.main_text(page) == f"A bridge {text}"


#: Hand-written pages of other templates than the tables', with what a reader would keep.
PAGES = [
    ("<div id=page><div class=nav><ul><li><a href=/a>Start</a><li><a href=/b>About us</a></ul></div><div id=content><h2>Notes</h2><p>{s}<p>{s}</div><div class='sidebar widget'><h3>Latest</h3><ul><li><a href=/x>One more thing</a></ul></div></div>", "Notes {s} {s}"),
    ("<table><tr><td><a href=/>Home</a> | <a href=/c>Contact</a></td></tr><tr><td><p>{s}</p><p>{s}</p></td></tr><tr><td>© 2020 A company</td></tr></table>", "{s} {s}"),
    ("<main><p>{s}</p><blockquote>{s}</blockquote></main><div><p>We use cookies to make this site better.</p><button>Accept</button></div>", "{s} {s}"),
    ("<article><p>{s}</p></article><div><h3>Leave a reply</h3><form><p>Your email address will not be published.</p><textarea></textarea></form></div>", "{s}"),
    ("<article><p>{s}</p></article><div id=comments><article class=comment-body><p>{s}</p></article><article class=comment-body><p>{s} {s}</p></article></div>", "{s}"),
]


@pytest.mark.parametrize(("page", "want"), PAGES)
def test_extraction_of_other_templates(page, want):
    s = STORY.strip()
    assert extraction.main_text(page.replace("{s}", s)) == want.replace("{s}", s)


def test_extraction_is_linear():
    pages = ('<a href="x ' * 8000, "<div>" * 8000 + "text" + "</div>" * 8000, "<div><p>short</p>" * 4000, "<b><div>" + "<a>" * 8000 + "</b>" * 8000, "<p>Some words of a text.</p><li>x" * 4000, "<div class='" * 8000, "<!--" * 8000 + "<p" * 8000)
    for page in pages:
        began = time.process_time()
        extraction.main_text(page)
        assert time.process_time() - began < 1


def test_extraction_odd(spark):
    page = "<article><p>One &amp; two</p></article>"
    many = "<article>" + "<p>word &lt;b&gt; </p>" * 20_000 + "</article>"
    rows = [(1, "u", page, "clash"), (1, "u", page, "clash"), (None, None, None, None), (2, "u", "", None), (3, "u", many, None), (4, None, "<p", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = df.withColumn("text", extraction.extracted(F.col("html"))).collect()
    want = {(1, "One & two"), (None, ""), (2, ""), (3, " ".join(["word <b>"] * 20_000)), (4, "")}
    assert len(got) == 6 and {(r["page_id"], r["text"]) for r in got} == want
    assert df.limit(0).withColumn("text", extraction.extracted(F.col("html"))).count() == 0


def test_minimum_cut_equals_brute_force():
    from itertools import product

    rng = random.Random(7)
    for _ in range(60):
        n = rng.randrange(1, 8)
        s, t = [rng.random() * 3 for _ in range(n)], [rng.random() * 3 for _ in range(n)]
        edges = [(i, j, rng.random()) for i in range(n) for j in range(i) if rng.random() < 0.4]
        cost = lambda x: sum(t[i] if x[i] else s[i] for i in range(n)) + sum(w for a, b, w in edges if x[a] != x[b])  # noqa: B023, E731
        assert cost(extraction.minimum_cut(s, t, edges)) == pytest.approx(min(map(cost, product((False, True), repeat=n))))


# --- sharding


def test_capacity_is_the_smallest():
    rng = random.Random(8)
    for _ in range(80):
        sizes = [rng.randrange(1, 30) for _ in range(rng.randrange(1, 40))]
        ranges = [(i, 0, x, 1) for i, x in enumerate(sizes)]

        def shards(cap):
            n, held = 1, 0
            for x in sizes:  # noqa: B023
                if held + x > cap:
                    n, held = n + 1, 0
                held += x
            return n

        want = next(c for c in range(max(sizes), sum(sizes) + 1) if shards(c) <= 4)
        assert sharding.smallest_capacity(ranges, 4)[0] == want


def least_capacity(sizes, shards):
    """By dynamic programming over all contiguous partitions."""
    sums = [0]
    for x in sizes:
        sums.append(sums[-1] + x)
    now = [0] + [math.inf] * len(sizes)
    for _ in range(shards):
        now = [min(max(now[i], sums[j] - sums[i]) for i in range(j + 1)) for j in range(len(sums))]
    return now[-1]


def test_cuts_reach_the_optimum_and_are_even():
    rng = random.Random(9)
    for _ in range(300):
        sizes = [rng.choice([1, 2, 3, 5, 8, 40, 200]) for _ in range(rng.randrange(1, 40))]
        shards = rng.randrange(1, 7)
        ranges = [(i, 0, x, 1) for i, x in enumerate(sizes)]
        capacity, _ = sharding.smallest_capacity(ranges, shards)
        assert capacity == least_capacity(sizes, shards)
        cuts, inside = sharding.even_cuts(ranges, capacity, shards, {i for i, x in enumerate(sizes) if x * shards > sum(sizes)})
        bounds = [0, *cuts, len(sizes)]
        assert not inside and len(cuts) < shards and max(sum(sizes[i:j]) for i, j in zip(bounds, bounds[1:], strict=False)) <= capacity
    cuts, _ = sharding.even_cuts([(i, 0, x, 1) for i, x in enumerate([1] * 35 + [30] + [1] * 35)], 30, 16, {35})
    assert 35 in cuts and 36 in cuts and all(b - a <= 6 for a, b in zip([0, *cuts], [*cuts, 71], strict=True))


@pytest.mark.parametrize("heavy", [False, True])
def test_cut_keys_of_groups(spark, heavy):
    rng = random.Random(10)
    keys = rng.sample(range(1 << sharding.KEY_BITS), 500) + [(77 << 20) + i for i in range(200)]
    rows = sorted((k, rng.randrange(1, 400)) for k in keys)
    if heavy:
        rows[300] = rows[300][0], 60_000
    sizes = [x for _, x in rows]
    cuts = sharding.cut_keys(spark.createDataFrame(rows, "key long, size long"), 8)
    at = [0, *(next(i for i, (k, _) in enumerate(rows) if k >= c) for c in cuts), len(rows)]
    parts = [sum(sizes[i:j]) for i, j in zip(at, at[1:], strict=False)]
    assert cuts == sorted(cuts) and len(parts) == 8 and max(parts) <= least_capacity(sizes, 8)
    others = sorted(parts)[:-1] if heavy else parts
    assert max(others) - min(others) <= (0.35 if heavy else 0.1) * max(others) + 400


def test_sharding(spark, odd, nothing):
    rows = queries.op10_minimax_sharding(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 1000 and {r["shard"] for r in rows} == set(range(16))
    sizes, slots = {}, {}
    for r in rows:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(sizes.values()) <= sum(sizes.values()) / 16 + max(r["size"] for r in rows)
    one = {}
    for i, t in duckdb.sql("select doc_id, text from '/root/testdata/sf0.01/documents.parquet'").fetchall():
        one.setdefault(t or "", set()).update(r["shard"] for r in rows if r["doc_id"] == i)
    assert all(len(x) == 1 for x in one.values())
    out = sharding.shard_documents(odd).collect()
    assert sorted(str((r["doc_id"], r["size"], r["text_crc32"])) for r in out) == sorted(str((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode()))) for r in odd.collect())
    assert {r["shard"] for r in out} <= set(range(16))
    assert sharding.shard_documents(nothing).count() == 0


def test_rows_without_id_in_bulk(spark):
    df = spark.createDataFrame([(None, f"text {i % 40}") for i in range(400)], "doc_id long, text string").repartition(4)
    slots = {}
    for r in sharding.shard_documents(df, 5).collect():
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and sum(map(len, slots.values())) == 400
    packed = packing.pack_documents(df, P.path("byte_bpe_50k.json"), P.PATTERN).collect()
    assert sorted(r["sequence_id"] for r in packed) == list(range(len(packed)))


def test_topk_equals_sql(spark):
    assert_same(queries.op3_exact_topk(spark, SMALL), queries.oracle_sql()["op3_exact_topk"], SMALL)
