"""The pipeline's stages against brute-force versions, and on odd input."""

import pytest

import corpus_pipeline
from conftest import SMALL
from orbitspark.llm import quality, queries, toxicity
from orbitspark.llm.common import table, written
from test_near_copies import least_ids
from test_operators import ODD


@pytest.fixture(scope="module")
def outputs(spark):
    docs, out = table(spark, SMALL, "documents"), [table(spark, SMALL, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SMALL), name)
        out.append(docs)
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_filters_take_effect(spark, outputs):
    kept = quality.quality_verdicts(outputs[0], table(spark, SMALL, "labels")).where("kept")
    assert ids(outputs[1]) == ids(kept)
    clean = toxicity.toxicity_scores(outputs[1], table(spark, SMALL, "labels")).where("predicted = 0")
    assert ids(outputs[2]) == ids(clean)


def test_one_of_each_group(outputs):
    """By all pairs of similarities of five-word shingles."""
    rows = [(r["doc_id"], r["text"]) for r in outputs[2].collect()]
    assert ids(outputs[3]) == least_ids(rows)[0]


def test_repeats_are_cut(outputs):
    """The stage's texts are the bytes that remain, without those of characters that a cut has split."""
    rows = [(r["doc_id"], r["text"]) for r in outputs[3].collect()]
    want = {i: left.decode("utf-8", "ignore") for i, left in remaining(rows)}
    for r in outputs[4].collect():
        assert r["text"] == want[r["doc_id"]] and r["n_chars"] == len(r["text"])
    assert outputs[4].columns == outputs[0].columns


def remaining(rows, n=50):
    first = {}
    for i, t in rows:
        b = t.encode()
        for p in range(len(b) - n + 1):
            first[b[p : p + n]] = min(first.get(b[p : p + n], i), i)
    for i, t in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if first[b[p : p + n]] < i:
                gone[p : p + n] = b"\1" * n
        yield i, bytes(x for x, g in zip(b, gone, strict=True) if not g)


def test_packing_covers_the_texts(outputs):
    rows = outputs[5].collect()
    assert sorted(r["sequence_id"] for r in rows) == list(range(len(rows))) and all(r["length"] & (r["length"] - 1) == 0 for r in rows)
    assert {r["doc_id"] for r in rows} == set(ids(outputs[4]))


def test_packed_ids_decode_to_the_texts(spark, outputs):
    from array import array

    import public_tokenizers as P

    from orbitspark.llm.packing import encoder

    code = encoder(P.path("byte_bpe_50k.json"), P.PATTERN)
    tokens = {}
    for r in sorted(outputs[5].collect(), key=lambda r: (r["doc_id"], r["start"])):
        tokens.setdefault(r["doc_id"], array("I")).frombytes(bytes(r["ids"]))
    texts = {r["doc_id"]: r["text"] for r in outputs[4].collect()}
    assert {i: code.decode_bytes(x[:-1].tolist()).decode() for i, x in tokens.items()} == texts


def test_odd_documents_pass_every_stage(spark):
    text = "plain words of a text that is long enough to stay in it, number {} " * 3
    rows = [(i, " ".join(f"{w}{i}" for w in (text * 5).split()), None, None, None, "f", None, "k", i) for i in range(5)] + [(None, None, None, None, None, None, None, None, None)] * 2 + [(1, "", "en", None, None, None, None, None, None)]
    for docs in (spark.createDataFrame(rows, ODD), spark.createDataFrame([], ODD)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SMALL)
            assert out.columns == docs.columns
            out.collect()
        corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()


def test_two_runs_don_t_meet(spark, outputs):
    """Both results are read after both runs, and equal that of the stages."""
    first, second = corpus_pipeline.run(spark, SMALL), corpus_pipeline.run(spark, SMALL)
    pieces = lambda df: sorted((r["doc_id"], r["start"], r["length"], bytes(r["ids"])) for r in df.collect())
    assert pieces(first) == pieces(second) == pieces(outputs[5])


def test_queries_are_registered():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 14)]
