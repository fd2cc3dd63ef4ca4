"""Toxicity by a weighted finite-state pattern grammar over clauses.

Five small transducers each read a symbol a word and write one, with a weight. REPORTED lowers what follows a verb of
saying in a clause; NEGATION lowers what stands within a few words after a negation; TARGET turns an insult after an
address into an addressed one, which weighs more; THREAT arms on a threatening verb and writes a threat when a target
is its object, within two words; INSULT lets an insult count where it stands with other words of its clause, and drops one that is a clause by
itself. They are composed, each reading what the one before it writes and weights being multiplied, into one table
that is compiled once; a clause's score is the sum of what the composition emits.

The insult lexicon (whole words, and word beginnings of 4 to 6 letters for inflected forms) is learned from labelled
documents by smoothed log odds, of which the lower confidence limit must stay positive. A logistic model turns a
document's clause scores into a probability; it is fitted on scores from lexicons of the other half of the rows, so that words that only recur
in one half don't count twice.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitspark.llm.common import batches_of, written

#: The function words of the grammar, in English, German, French and Spanish.
TARGETS = "you your yours u ya he she they them him her du dich dir ihr euch dein deine sie tu te toi vous ton ta vos tú ti usted ustedes vosotros tus él ella ellos"
NEGATIONS = "not no never nor without isn't aren't don't doesn't wasn't nicht kein keine nie niemals ohne ne pas jamais sans aucun ni nunca jamás sin ningún"
REPORTS = "said says say claimed claims quoted quote wrote called reportedly according sagte sagt behauptete schrieb laut dit disait déclaré écrit selon dijo dice afirmó escribió según"
#: Stems of threatening verbs with the endings they take ("-" for none).
THREATS = [
    ("kill hurt destroy beat attack shoot burn murder", "- s ed ing"),
    ("stab", "- s bed bing"),
    ("töt umbring schlag zerstör", "e st t et en te ten end"),
    ("getöt umgebrach geschlag zerstör", "et t en"),
    ("tu frapp brûl", "e es er é ée ez ent ons ant"),
    ("détrui", "re s t sez sent sant"),
    ("mat golpe quem", "o a as an ar amos ando aré ado"),
    ("destru", "yo ye yes yen ir yendo iré ido"),
]
#: Symbols that the grammar reads; what isn't listed is OTHER.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORTED = range(6)
#: Symbols written on the way, and at the end: emit the word's weight, hold it, emit what is held, both, emit a threat.
ADDRESSED, THREATENED, NOTHING, NOW, HOLD, RELEASE, BOTH, THREATEN = range(6, 14)
FUNCTION_WORDS = {w: c for c, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORTED, REPORTS)) for w in words.split()}
FUNCTION_WORDS = {stem + end.strip("-"): THREAT for stems, ends in THREATS for stem in stems.split() for end in ends.split()} | FUNCTION_WORDS
#: Words among which a threatening verb's object must be.
OBJECT_REACH = 2
#: Words that a negation reaches, its factor, those of reported speech and of an address, and a threat's weight.
REACH, NEGATED, QUOTED, RAISED, THREAT_WEIGHT = 3, 0.4, 0.6, 1.25, 2.0
CLAUSE_END = re.compile(r"[.!?;:…]+[\"')\]]*\Z")
EDGE = re.compile(r"^\W+|\W+\Z")
#: Labelled rows that are learned from at most.
MOST_ROWS = 16_000
NAMES = ("total", "highest", "clauses", "density")
SCORES = "doc_id long, total double, highest double, clauses double, density double"


class Transducer:
    """A deterministic weighted transducer: arcs (state, symbol) -> (state, symbol written, factor); other symbols pass."""

    def __init__(self, start, arcs: dict):
        self.start, self.arcs = start, arcs

    def step(self, state, symbol: int):
        return self.arcs.get((state, symbol), (state, symbol, 1.0))

    def then(self, other: Transducer, symbols: range) -> Transducer:
        """The composition: other reads what this one writes, and factors are multiplied. Only reachable states are made."""
        start, arcs = (self.start, other.start), {}
        todo, known = [start], {start}
        while todo:
            a, b = todo.pop()
            for x in symbols:
                to_a, y, f = self.step(a, x)
                to_b, z, g = other.step(b, y)
                arcs[(a, b), x] = (to_a, to_b), z, f * g
                if (to_a, to_b) not in known:
                    known.add((to_a, to_b))
                    todo.append((to_a, to_b))
        return Transducer(start, arcs)


WEIGHTY = (INSULT, TARGET)  # what carries a weight, or completes a threat


def reported() -> Transducer:
    """After a verb of saying, what follows in the clause counts less."""
    arcs = {(0, REPORTED): (1, REPORTED, 1.0)}
    return Transducer(0, arcs | {(1, x): (1, x, QUOTED) for x in WEIGHTY})


def negation() -> Transducer:
    """States count down the words that a negation still reaches."""
    arcs = {}
    for left in range(REACH + 1):
        for x in range(6):
            arcs[left, x] = max(0, left - 1), x, NEGATED if left and x in WEIGHTY else 1.0
        arcs[left, NEGATION] = REACH, NEGATION, 1.0
    return Transducer(0, arcs)


def target() -> Transducer:
    """After an address, insults are addressed ones and threats' targets weigh more too."""
    return Transducer(0, {(0, TARGET): (1, TARGET, 1.0), (1, INSULT): (1, ADDRESSED, RAISED), (1, TARGET): (1, TARGET, RAISED)})


def threat() -> Transducer:
    """A threatening verb arms; a target as its object, among the next few words, makes the threat. States count those words down."""
    arcs = {}
    for left in range(1, OBJECT_REACH + 1):
        arcs |= {(left, x): (left - 1, x, 1.0) for x in (OTHER, INSULT, NEGATION, REPORTED, ADDRESSED)} | {(left, TARGET): (0, THREATENED, 1.0)}
    return Transducer(0, arcs | {(left, THREAT): (OBJECT_REACH, THREAT, 1.0) for left in range(OBJECT_REACH + 1)})


def insult() -> Transducer:
    """States: the clause's start, its first word held as an insult, other words seen. Writes what is emitted."""
    arcs = {}
    for x in (OTHER, THREAT, TARGET, NEGATION, REPORTED):
        arcs |= {("start", x): ("seen", NOTHING, 1.0), ("held", x): ("seen", RELEASE, 1.0), ("seen", x): ("seen", NOTHING, 1.0)}
    for x in (INSULT, ADDRESSED):
        arcs |= {("start", x): ("held", HOLD, 1.0), ("held", x): ("seen", BOTH, 1.0), ("seen", x): ("seen", NOW, 1.0)}
    return Transducer("start", arcs | {(s, THREATENED): ("seen", THREATEN, 1.0) for s in ("start", "held", "seen")})


def compiled() -> tuple[dict[tuple[int, int], tuple[int, int, float]], int]:
    """The five composed, with numbered states: (state, symbol) to (state, what is emitted, factor), and the start state."""
    whole, symbols = reported(), range(6)
    for part in (negation(), target(), threat(), insult()):
        whole = whole.then(part, symbols)
    number = {s: i for i, s in enumerate(dict.fromkeys(s for s, _ in whole.arcs))}
    return {(number[s], x): (number[to], out, f) for (s, x), (to, out, f) in whole.arcs.items()}, number[whole.start]


GRAMMAR, START = compiled()


class Scorer:
    """Clause scores of texts under a lexicon: whole words, and beginnings marked by a last '*'."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.firsts = {w.rstrip("*")[:4] for w in lexicon} | {w[:4] for w in FUNCTION_WORDS if FUNCTION_WORDS[w] == THREAT}
        self.lengths = sorted({len(w) - 1 for w in lexicon if w.endswith("*")}, reverse=True)

    def weight(self, word: str) -> float:
        known = self.lexicon.get(word)
        if known is not None:
            return known
        return max((self.lexicon.get(word[:n] + "*", 0.0) for n in self.lengths if len(word) >= n), default=0.0)

    def clause(self, words: list[str]) -> float:
        """The sum of what the grammar emits over a clause's words; a word alone emits nothing."""
        state, total, held = START, 0.0, 0.0
        for w in words:
            w = EDGE.sub("", w)
            kind, weight = FUNCTION_WORDS.get(w, OTHER), 0.0
            if kind in (OTHER, THREAT) and (weight := self.weight(w)):
                kind = INSULT
            state, out, factor = GRAMMAR[state, kind]
            if out == HOLD:
                held = factor * weight
            elif out == THREATEN:
                total += factor * THREAT_WEIGHT
            elif out != NOTHING:
                total += (held if out in (RELEASE, BOTH) else 0.0) + (factor * weight if out in (NOW, BOTH) else 0.0)
        return total

    def features(self, text: str | None) -> tuple[float, float, float, float]:
        words = text.lower().split() if text else []
        firsts = self.firsts
        hits = [i for i, w in enumerate(words) if w[:4] in firsts or not w[0].isalpha() and EDGE.sub("", w)[:4] in firsts]
        scores, done = [], 0
        for i in hits:
            if i < done:
                continue
            a = b = i
            while a > done and not CLAUSE_END.search(words[a - 1]):
                a -= 1
            while b < len(words) - 1 and not CLAUSE_END.search(words[b]):
                b += 1
            done = b + 1
            if (s := self.clause(words[a:done])) > 0:
                scores.append(s)
        return sum(scores), max(scores, default=0.0), float(len(scores)), 100 * sum(scores) / max(len(words), 20)


def held_out(doc_id: Column) -> Column:
    """Whether labels of a row are for testing only: crc32 of the id as text leaves 2 by 4. A null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def toxic_forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Toxic documents that hold each word or beginning, by half (context -1), and its contexts.

    A context is the word before and the word. Copies of a document have the same contexts, so that a word which only
    copies share doesn't look frequent.
    """
    for b in batches:
        counts: Counter = Counter()
        for text, half in zip(b["text"], b["half"], strict=True):
            words = [EDGE.sub("", w) for w in (text or "").lower().split()]
            for before, w in set(zip(["", *words], words, strict=False)):
                counts.update((f, half, hash_of(before, w)) for f in forms(w))
            counts.update((f, half, -1) for f in {f for w in set(words) for f in forms(w)})
        yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["word", "half", "context", "n"])


def clean_forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Clean documents that hold each word or beginning, by half."""
    for b in batches:
        counts: Counter = Counter()
        for text, half in zip(b["text"], b["half"], strict=True):
            words = {EDGE.sub("", w) for w in (text or "").lower().split()}
            counts.update((f, half) for f in {f for w in words for f in forms(w)})
        yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["word", "half", "n"])


def forms(word: str) -> list[str]:
    """A word and its beginnings."""
    return ([word] if len(word) > 1 else []) + [word[:n] + "*" for n in (4, 5, 6) if len(word) > n]


def hash_of(before: str, word: str) -> int:
    return zlib.crc32(f"{before} {word}".encode())


def may_pass(documents: np.ndarray, halves: list[int]) -> Column:
    """Whether lexicon() takes a word with columns c0, c1 (clean) and t0, t1 (toxic documents) by these halves, or is near to it."""
    total = documents[halves].sum(0)
    clean = sum((F.col(f"c{h}") for h in halves), F.lit(0))
    toxic = F.least(sum((F.col(f"t{h}") for h in halves), F.lit(0)), F.lit(float(total[1])))
    a, b, c, d = toxic + 0.5, total[1] - toxic + 0.5, clean + 0.5, total[0] - clean + 0.5
    return (toxic >= 3) & (toxic > clean) & (F.log(a / b * d / c) - 2.33 * F.sqrt(1 / a + 1 / c) > 1.5 - 1e-6)


def lexicon(counts: dict[str, np.ndarray], documents: np.ndarray, halves: list[int]) -> dict[str, float]:
    """Weights of words from their counts [half, toxic]: log odds whose lower 99 per cent confidence limit is above 1.5."""
    total = documents[halves].sum(0)
    found = {}
    for w, n in counts.items():
        clean, toxic = n[halves].sum(0)
        toxic = min(toxic, total[1])
        if toxic >= 3:
            a, b, c, d = toxic + 0.5, total[1] - toxic + 0.5, clean + 0.5, total[0] - clean + 0.5
            odds = np.log(a / b * d / c)
            if odds - 2.33 * np.sqrt(1 / a + 1 / c) > 1.5 and toxic > clean:
                found[w] = float(min(odds, 6.0) / 6.0)
    return found


def squeezed(x: np.ndarray) -> np.ndarray:
    return np.log1p(np.maximum(x, 0))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights, the last one the constant, by Newton steps; the constant isn't shrunk."""
    x = np.column_stack([squeezed(x), np.ones(len(x))])
    w, keep = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-3])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + keep, x.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def learned(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_rows: int = MOST_ROWS) -> tuple[dict[str, float], np.ndarray]:
    """Lexicon and logistic weights from the labelled rows that aren't held out, at most most_rows of them by hash."""
    spark = docs.sparkSession
    batches_of(spark)
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("of"))
    # a row that repeats id and text counts once; ids with many texts don't make the rows more than most_rows
    keys = texts.select("doc_id", "of").join(F.broadcast(chosen), "doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "of").limit(most_rows)
    rows = texts.join(F.broadcast(keys), ["doc_id", "of"]).dropDuplicates(["doc_id", "of"])  # both at most most_rows
    rows = written(rows.withColumn("half", (F.xxhash64("doc_id", F.lit(1)) % 2 != 0).cast("int")), "labelled")
    sizes = np.zeros((2, 2))
    for r in rows.groupBy("half", "toxic").count().collect():
        sizes[r["half"], r["toxic"]] = r["count"]
    if not sizes[:, 1].sum():
        return {}, np.array([0.0, 0.0, 0.0, 0.0, -4.0])
    toxic = rows.where("toxic = 1").mapInPandas(toxic_forms, "word string, half int, context long, n long")
    contexts = toxic.groupBy("word", "half", "context").agg(F.sum("n").alias("n"))
    by_half = contexts.groupBy("word", "half").agg(F.least(F.sum(F.when(F.col("context") < 0, F.col("n"))), F.count_if(F.col("context") >= 0)).alias("n"))
    of_half = lambda c: [F.sum(F.when(F.col("half") == h, F.col("n")).otherwise(0)).alias(f"{c}{h}") for h in (0, 1)]
    candidates = by_half.groupBy("word").agg(*of_half("t")).where("t0 + t1 >= 3")
    clean = rows.where("toxic = 0").mapInPandas(clean_forms, "word string, half int, n long").groupBy("word").agg(*of_half("c"))
    counted = candidates.join(clean, "word", "left").fillna(0)
    # only words that one of the three lexicons takes come to the driver
    passing = counted.where(may_pass(sizes, [0]) | may_pass(sizes, [1]) | may_pass(sizes, [0, 1])).collect()
    counts = {r["word"]: np.array([[r["c0"], r["t0"]], [r["c1"], r["t1"]]], float) for r in passing}
    # each half is scored by the other's words
    scorers = spark.sparkContext.broadcast([Scorer(lexicon(counts, sizes, [1])), Scorer(lexicon(counts, sizes, [0]))])

    def crossed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [scorers.value[half].features(text) for half, text in zip(b["half"], b["text"], strict=True)]
            yield pd.DataFrame(found, columns=list(NAMES), dtype=float).assign(toxic=b["toxic"].to_numpy())

    # a row of numbers for each labelled row, of which there are at most most_rows
    got = np.array([tuple(r) for r in rows.mapInPandas(crossed, "total double, highest double, clauses double, density double, toxic int").collect()], float)
    return lexicon(counts, sizes, [0, 1]), logistic(got[:, :4], got[:, 4])


def scored_by(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str):
    """A function of a text column: a struct of score, clauses and total, by a model learned from docs and labels."""
    spark = docs.sparkSession
    words, weights = learned(docs, labels, id_col, text_col)
    shared = spark.sparkContext.broadcast((Scorer(words), weights))

    @F.pandas_udf("struct<score double, clauses long, total double>")
    def of(texts: pd.Series) -> pd.DataFrame:
        scorer, w = shared.value
        x = np.array([scorer.features(t) for t in texts], float).reshape(-1, 4)
        z = squeezed(x) @ w[:-1] + w[-1]
        return pd.DataFrame({"score": 1 / (1 + np.exp(-np.clip(z, -30, 30))), "clauses": x[:, 2].astype("int64"), "total": x[:, 0]})

    return of


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted, clauses, total): a row per input row.

    score is the probability of label 1, predicted whether it reaches the threshold, clauses how many clauses matched,
    total their scores' sum. Null and empty texts match nothing and get the score of such texts. Null ids are scored
    like others. Labels that are null or neither 0 nor 1, or of held-out ids, are never used; an id with both labels
    counts as 1. Without a usable toxic label nothing matches and all scores are low.
    """
    of = scored_by(docs, labels, id_col, text_col)
    scored = docs.select(F.col(id_col).alias("doc_id"), of(F.col(text_col)).alias("s"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "s.score", (F.col("s.score") >= threshold).cast("int").alias("predicted"), "s.clauses", "s.total")


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs without the rows of a score of at least threshold; all columns stay."""
    of = scored_by(docs, labels, id_col, text_col)
    return docs.where(of(F.col(text_col))["score"] < threshold)
