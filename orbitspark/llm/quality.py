"""Quality rules with risk-controlled thresholds, in DataFrame operations only.

Base measures of each text are array expressions, without a shuffle. On top of fixed base rules, a ladder of rule
settings goes from lenient to strict. For each stratum (a language), the labelled documents of good quality are the
holdout: a rung is certified if P(Bin(n, alpha) <= k) <= delta / strata, k being how many of the n good documents that
the base rules keep it would reject. This is the exact binomial (Clopper-Pearson) bound: were the false rejection rate
above alpha, so few rejections would be that unlikely. Rungs are tested in order and the first failure ends the
sequence, which controls the family-wise error without further correction within a stratum; the division by the number
of strata is Bonferroni's across them. So, with probability 1 - delta, no stratum's chosen rung rejects more than alpha
of its good documents. A stratum with too few labels gets no rung, and only the base rules hold there.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitspark.llm.common import WORD_BREAK, written

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
#: The ladder: a document fails a rung if it exceeds any of these. Per cent of symbols among word characters; per cent
#: of words in repeated windows; repeated lines per 100 words; characters a word.
LADDER = [(40, 48, 30, 30), (30, 45, 20, 25), (20, 42, 15, 20), (12, 38, 10, 16), (8, 34, 8, 14), (5, 30, 6, 12)]
#: Largest share of good documents that a certified rung may reject, and the chance that this fails.
ALPHA, DELTA = 0.01, 0.05


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", whole: bool = False) -> DataFrame:
    """(doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), counts long; a null text has none of any.

    whole: with the row itself, as a struct.
    """
    rows = [F.struct(*docs.columns).alias("row")] if whole else []
    text = F.coalesce(F.col(text_col), F.lit(""))
    spaces = " \t\n\x0b\x0c\r"
    has_word = f"[^{spaces}]"
    words = F.filter(F.split(text, WORD_BREAK), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(has_word))
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        *rows,
        F.coalesce(F.col(stratum_col), F.lit("")).alias("stratum"),
        words.alias("words"),
        F.char_length(F.translate(text, spaces, "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    w = F.col("words")
    windows = F.when(
        F.size(w) >= 3,
        F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.concat_ws(" ", w[i], w[i + 1], w[i + 2]).alias("w"), i.alias("i"))),
    ).otherwise(F.expr("cast(array() as array<struct<w:string,i:int>>)"))
    s = F.col("windows")
    # in order of their words, equal windows are neighbours
    again = F.transform(s, lambda x, j: F.when((F.get(s, j - 1)["w"] == x["w"]) | (F.get(s, j + 1)["w"] == x["w"]), x["i"]))
    p = F.col("starts")
    covered = F.aggregate(F.transform(p, lambda x, j: F.coalesce(F.least(F.lit(3), F.get(p, j + 1) - x), F.lit(3))), F.lit(0).cast("long"), lambda a, x: a + x)
    return (
        base.withColumn("windows", F.sort_array(windows))
        .withColumn("starts", F.sort_array(F.filter(again, lambda x: x.isNotNull())))
        .select(
            "doc_id",
            *(["row"] if whole else []),
            "stratum",
            F.size("words").cast("long").alias("n_words"),
            "word_chars",
            "n_symbols",
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            covered.alias("n_repeat_words"),
        )
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def fails(rung: tuple[int, int, int, int]) -> Column:
    symbols, repeats, lines, length = rung
    return (
        (100 * F.col("n_symbols") > symbols * F.col("word_chars"))
        | (100 * F.col("n_repeat_words") > repeats * F.col("n_words"))
        | (100 * F.col("n_dup_lines") > lines * F.col("n_words"))
        | (F.col("word_chars") > length * F.col("n_words"))
    )


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed over logarithms, so that large n don't underflow."""
    step = lambda a, j: F.struct(
        (a["term"] + F.log((n - j + 1) / j) + math.log(p / (1 - p))).alias("term"), a["sum"].alias("sum")
    )
    added = lambda a: F.struct(a["term"].alias("term"), (F.greatest(a["term"], a["sum"]) + F.log1p(F.exp(-F.abs(a["term"] - a["sum"])))).alias("sum"))
    first = n * math.log(1 - p)
    total = F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.expr("cast(array() as array<bigint>)")), F.struct(first.alias("term"), first.alias("sum")), lambda a, j: added(step(a, j)))
    return F.exp(total["sum"])


def certified_rungs(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, rung): how many rungs of the ladder, from the lenient end, are certified in a stratum."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    held = measured.join(good, "doc_id", "left_semi").where(~base_failed())
    counts = held.groupBy("stratum").agg(F.count("*").alias("n"), *(F.count_if(fails(r)).alias(f"k{i}") for i, r in enumerate(LADDER, 1)))
    tests = counts.select("stratum", "n", F.count("*").over(Window.partitionBy(F.lit(1))).alias("strata"), F.explode(F.array(*(F.struct(F.lit(i).alias("rung"), F.col(f"k{i}").alias("k")) for i in range(1, len(LADDER) + 1)))).alias("t"))
    # a bound above the mean is passed with a chance of about a half or more, never with a small one: no sum is needed there
    within = F.least(F.col("t.k"), F.floor(F.col("n") * alpha).cast("long"))
    ok = (F.col("t.k") <= F.col("n") * alpha) & (binomial_tail(F.col("n"), within, alpha) <= delta / F.col("strata"))
    passed = tests.select("stratum", F.col("t.rung").alias("rung"), ok.alias("ok"))
    return passed.groupBy("stratum").agg((F.coalesce(F.min(F.when(~F.col("ok"), F.col("rung"))), F.lit(len(LADDER) + 1)) - 1).alias("rung"))


def quality_verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The measures of each row with stratum, base_failed, rung (the stratum's certified one, 0: none) and kept.

    A row per input row, repeated ids and null ids included. Null and empty texts have no words and fail the base
    rules. A null stratum is a stratum of its own. Labels that are null, or of other documents, count for nothing;
    without labels no rung is certified. Other columns are never read.
    """
    return judged(written(measures(docs, id_col, text_col, stratum_col), "quality"), labels, alpha, delta)


def judged(measured: DataFrame, labels: DataFrame, alpha: float, delta: float) -> DataFrame:
    """measured (a written table) with rung, base_failed and kept."""
    rungs = certified_rungs(measured, labels, alpha, delta)
    strict = F.lit(False)
    for i, r in enumerate(LADDER, 1):
        strict = F.when(F.col("rung") >= i, fails(r)).otherwise(F.lit(False)) | strict
    # strata are as many as languages; the join broadcasts them if the session's threshold allows, and splits a hot one if not
    return (
        measured.join(rungs, "stratum", "left")
        .withColumn("rung", F.coalesce("rung", F.lit(0)))
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & ~strict)
    )


def passing(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """docs without the rows that the rules reject; all columns stay. Each row is judged by itself, in its place."""
    measured = written(measures(docs, id_col, text_col, stratum_col, whole=True), "measured")
    return judged(measured, labels, ALPHA, DELTA).where("kept").select("row.*")
