"""Toxicity by a weighted finite-state pattern grammar.

Four small transducers read the word classes of a clause one after the other. Negation strikes out an offence that a
negation word precedes within three words. Reported speech strikes out what stands behind a verb of saying,
within quotation marks or right behind a noun of mention ("the word ..."), and takes back what stands before such
a verb. Target joins an insult with a person in the same clause, before or behind it, or with a
demonstrative shortly before it, and a threat with the person shortly behind it. The scorer turns that into matched and
loose weights. Composed once, they are one deterministic machine. A threat without an object and a struck-out
offence weigh nothing; an insult that is aimed at nobody is a loose match, a feature of its own that takes many clauses, or the
labels' word for it, to reject a document. The lexicon starts from a small seed list and grows from labelled documents; a
logistic curve over a document's clause weights gives its score.
"""

from __future__ import annotations

import math
import re
from collections import deque

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, table

INSULTS = "idiot moron stupid loser scum trash clown pathetic worthless disgusting imbecile fool jerk vermin dumb coward".split()
THREATS = "kill hurt destroy beat burn shoot stab attack strangle hang".split()
PERSONS = "you your yours u he his him she her they them their people everyone du sie ihr tu vous ils usted ellos".split()
DEMONSTRATIVES = "this these that those such dieser diese ce cet cette ese esa este esta".split()
NEGATIONS = "not no never neither nor without isn't aren't wasn't don't doesn't nicht kein keine nie pas jamais non nunca ni".split()
REPORTS = "said says say wrote writes called quoted claimed reported according sagte schrieb dit écrit dijo escribió".split()
MENTIONS = "word words term terms noun adjective expression wort mot palabra".split()
QUOTES = '"“”„«»'

#: Labelled rows that the lexicon and the curve are fitted on, at most; rows are taken in the order of a hash of their id.
MAX_TRAINING_ROWS = 8000
MIN_CONTEXTS = 6
MIN_WEIGHT = 2.5
STEM = 4
THRESHOLD = 0.7
NEAR, OBJECT = 3, 4  # words between a negation or demonstrative and an insult; between a threat and its object
#: The curve without labels: one aimed insult is enough, a loose one is not.
CURVE = (-3.0, 1.6, 1.2, 0.6, 0.5, 1.2)


class Transducer:
    """A deterministic transducer: (state, symbol) -> (state, output symbol)."""

    def __init__(self, start, step, symbols):
        self.start, self.table, todo = start, {}, deque([start])
        seen = {start}
        while todo:
            state = todo.popleft()
            for symbol in symbols:
                after, out = step(state, symbol)
                self.table[state, symbol] = after, out
                if after not in seen:
                    seen.add(after)
                    todo.append(after)
        self.outputs = {out for _, out in self.table.values()}

    def then(self, other: Transducer) -> Transducer:
        """The composition: this machine's output is the other one's input."""

        def step(state, symbol):
            a, out = self.table[state[0], symbol]
            b, out = other.table[state[1], out]
            return (a, b), out

        return Transducer((self.start, other.start), step, {symbol for _, symbol in self.table})


# Classes: o other, i insult, h threat, t person, d demonstrative, n negation, r verb of saying, m noun of mention, q quotation mark.
def _negation(left, symbol):
    if symbol == "n":
        return NEAR, "o"
    return max(0, left - (symbol != "q")), "o" if symbol in "ih" and left else symbol


def _reported(state, symbol):
    said, quoted, mentioned = state
    if symbol == "r":
        return (True, quoted, False), "r"
    if symbol == "q":
        return (said, not quoted, mentioned), "q"
    return (said, quoted, symbol == "m"), "o" if symbol in "ih" and (said or quoted or mentioned) else "o" if symbol == "m" else symbol


def _target(state, symbol):
    """Outputs: A aimed insult, L loose one, S person behind, P and Q first and further threats, r take back, o nothing."""
    person, shown, threat = state
    after = person or symbol == "t", NEAR if symbol == "d" else max(0, shown - (symbol != "q")), max(0, threat - (symbol != "q"))
    if symbol == "i":
        return after, "A" if person or shown else "L"
    if symbol == "h":
        return (person, after[1], OBJECT), "Q" if threat else "P"
    if symbol == "t":
        return (True, after[1], 0), "T" if threat else "S"
    return (after, "r") if symbol == "r" else (after, "o")


def _scored(state, symbol):
    return state, symbol


def grammar() -> Transducer:
    """The composed clause machine."""
    symbols = set("oihtdnrmq")
    negation = Transducer(0, _negation, symbols)
    reported = Transducer((False, False, False), _reported, negation.outputs)
    target = Transducer((False, 0, 0), _target, reported.outputs)
    return negation.then(reported).then(target).then(Transducer(0, _scored, target.outputs))


WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
TOKEN = re.compile(rf"[^\W\d_]+(?:'[^\W\d_]+)?|[{QUOTES}]")
CLAUSE_END = re.compile(r"[.!?;:\n]")


class Scorer:
    """Clause features of texts under a lexicon of words and of stems (`word*`) with classes and weights."""

    def __init__(self, lexicon: dict[str, tuple[str, float]], machine: Transducer | None = None):
        self.lexicon, self.machine = lexicon, machine or grammar()
        self.automaton = ahocorasick.Automaton()
        for entry in lexicon:
            word = entry.rstrip("*")
            old = self.automaton.get(word, ())
            self.automaton.add_word(word, (*old, entry))
        self.automaton.make_automaton()
        self.classes = {w: c for c, ws in (("t", PERSONS), ("d", DEMONSTRATIVES), ("n", NEGATIONS), ("r", REPORTS), ("m", MENTIONS), ("q", QUOTES)) for w in ws}

    def hits(self, low: str) -> dict[int, tuple[str, float]]:
        """Start of a matched word -> class and weight; of several entries the heaviest counts."""
        found: dict[int, tuple[str, float]] = {}
        for end, entries in self.automaton.iter(low):
            for entry in entries:
                stem = entry[-1] == "*"
                start = end + 1 - (len(entry) - stem)
                if start and low[start - 1].isalpha() or not stem and end + 1 < len(low) and low[end + 1].isalpha():
                    continue
                if start not in found or found[start][1] < self.lexicon[entry][1]:
                    found[start] = self.lexicon[entry]
        return found

    def clause(self, tokens: list[tuple[str, float]]) -> tuple[float, float]:
        """Matched and loose weight of a clause, given as classes and weights."""
        state, matched, loose, threat = self.machine.start, 0.0, 0.0, 0.0
        for symbol, weight in tokens:
            state, out = self.machine.table[state, symbol]
            if out == "o":
                continue
            if out == "A":
                matched += weight
            elif out == "L":
                loose += weight
            elif out == "P":
                threat = weight
            elif out == "Q":
                threat = max(threat, weight)
            elif out == "r":
                matched = loose = threat = 0.0
            elif out in "ST":
                matched += loose + (threat if out == "T" else 0.0)
                loose = threat = 0.0
        return matched, loose

    def features(self, text: str | None) -> tuple[float, float, float, float, float]:
        """Sum, largest and number of matched clause weights, sum and number of loose ones; zeros without a match."""
        low = (text or "").lower()
        found = self.hits(low) if low else {}
        total = best = count = loose = spread = 0.0
        if found:
            ends, begin, starts = [m.start() for m in CLAUSE_END.finditer(low)] + [len(low)], 0, sorted(found)
            at = 0
            for end in ends:
                if at < len(starts) and starts[at] < end:
                    while at < len(starts) and starts[at] < end:
                        at += 1
                    tokens = [found.get(m.start()) or (self.classes.get(m[0], "o"), 0.0) for m in TOKEN.finditer(low, begin, end)]
                    matched, weak = self.clause(tokens)
                    total, best, count = total + matched, max(best, matched), count + (matched > 0)
                    loose, spread = loose + weak, spread + (weak > 0)
                begin = end + 1
        return total, best, count, loose, spread


FEATURES = ("total", "best", "clauses", "loose", "spread")


def _design(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), np.log1p(x)])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + (ridge + 1e-9) * np.eye(x.shape[1])
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def seed_lexicon() -> dict[str, tuple[str, float]]:
    return {w: ("i", 3.0) for w in INSULTS} | {w: ("h", 3.0) for w in THREATS}


def _evidence(sample: DataFrame) -> DataFrame:
    """entry, ctx and toxic: words and stems of the sample's texts with a hash of their neighbour words.

    Support is counted in distinct contexts, so a word of a document with many copies counts once.
    """

    def read(batches):
        for batch in batches:
            seen = set()
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                words = WORD.findall((text or "").lower())
                for a, w, b in zip(["", *words], words, [*words[1:], ""], strict=False):
                    ctx = hash_pair(a, b)
                    seen.add((w, ctx, toxic))
                    if len(w) > STEM:
                        seen.add((w[:STEM] + "*", ctx, toxic))
            rows = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32())], ["entry", "ctx", "toxic"])

    return sample.mapInArrow(read, "entry string, ctx long, toxic int")


def hash_pair(a: str, b: str) -> int:
    """A 64-bit hash of two neighbour words."""
    return xxhash.xxh64_intdigest(f"{a} {b}") - (1 << 63)


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAINING_ROWS) -> DataFrame:
    """doc_id, text, toxic and half (0 or 1) of at most `limit` labelled documents.

    Only labels whose crc32(doc_id as text) mod 3 is not 1 are used. A document labelled more than once is
    toxic if any label says so; null labels and ids are skipped.
    """
    clean = labels.where("doc_id is not null and toxic is not null").where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    marked = clean.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("draw", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)))
    # Rows of a draw this low are a little more than `limit`, so the tasks of a large table return few rows each.
    few = marked.where(F.col("draw") <= (1 << 30) * (1.2 * limit + 200) / max(1, marked.count()))
    picked = few.orderBy("draw", "doc_id").limit(limit).drop("draw")
    picked = picked.withColumn("doc_id", F.col("doc_id").try_cast(docs.schema["doc_id"].dataType))  # ids of another type are no error
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # at most `limit` rows
    return rows.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"), F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(2)).cast("int").alias("half"))


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAINING_ROWS) -> tuple[dict[str, tuple[str, float]], list[float]]:
    """The lexicon, learned on one half of the training rows, and the curve, fitted on the other half.

    Without labelled rows of both kinds the seed lexicon and a fixed curve are returned.
    """
    sample = materialize(training_rows(docs, labels, limit), "toxic-sample")
    lexicon = seed_lexicon()
    counts = _evidence(sample.where("half = 0")).distinct().groupBy("entry").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n"))
    sizes = counts.agg(F.sum("bad"), F.sum("n")).first()
    if sizes[1] and 0 < (sizes[0] or 0) < sizes[1]:
        odds = math.log(sizes[0] / (sizes[1] - sizes[0]))
        weight = F.log((F.col("bad") + 0.5) / (F.col("n") - F.col("bad") + 0.5)) - F.lit(odds)
        learned = counts.where(f"bad >= {MIN_CONTEXTS} and bad >= 0.9 * n").select("entry", weight.alias("weight")).where(f"weight >= {MIN_WEIGHT}")
        for r in learned.collect():  # words of at most `limit` documents
            kind = lexicon.get(r["entry"], ("i", 0.0))[0]
            lexicon[r["entry"]] = kind, min(4.0, float(r["weight"]))
    measured = sample.where("half = 1").select("toxic", clause_features(lexicon)(F.col("text")).alias("f")).select("toxic", "f.*").toPandas()  # bounded by `limit`
    y = measured["toxic"].to_numpy(float)
    if len(set(y)) < 2:
        return lexicon, list(CURVE)
    return lexicon, fit_logistic(_design(measured[list(FEATURES)].to_numpy(float)), y).tolist()


def clause_features(lexicon: dict[str, tuple[str, float]]):
    """A UDF from text to its clause features."""
    made: list[Scorer] = []

    @F.pandas_udf(", ".join(f"{c} double" for c in FEATURES))
    def of(texts: pd.Series) -> pd.DataFrame:
        if not made:
            made.append(Scorer(lexicon))
        return pd.DataFrame([made[0].features(t) for t in texts], columns=list(FEATURES), dtype=float)

    return of


def curve_value(curve, features) -> Column:
    """The logistic curve over the column of clause features."""
    z = sum((F.lit(float(w)) * F.log1p(features[c]) for w, c in zip(curve[1:], FEATURES, strict=True)), F.lit(float(curve[0])))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", limit: int = MAX_TRAINING_ROWS, out: str = "score") -> DataFrame:
    """`docs` with the double column `out`: 0 to 1, higher where label 1 is likelier.

    Null and empty texts have no clauses and get the curve's value there; repeated rows get equal scores.
    Scores come from the text alone. An empty table gives an empty result. A column that is already named `out`
    is replaced.
    """
    lexicon, curve = fit(docs.select("doc_id", F.col(text).alias("text")), labels, limit)
    return docs.withColumn(out, curve_value(curve, clause_features(lexicon)(F.col(text))))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` without the documents whose score reaches `threshold`; columns may have any names."""
    out = "score" + "_" * max(map(len, docs.columns))
    return toxicity(docs, labels, out=out).where(F.col(out) < threshold).drop(out)


def op7(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


QUERIES = {"op7_toxicity_grammar": op7}
SQL: dict[str, str] = {}
