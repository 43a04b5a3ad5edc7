"""Toxicity by a weighted finite-state pattern grammar.

Words become classes (insult, threat, target, negation, report, other), marks of punctuation end
clauses. Two transducers match clauses: an insult clause (an insult, worth more with a target
before or after it) and a threat clause (a threat and its target, in any order; either alone is
worth nothing). Two others change what they put out: a negation lowers what follows it, reported
speech lowers the rest of its clause. They are composed into one machine, whose output is the
clause's score; a document's score is a logistic function of its matched clauses. Words outside
of a matched clause score nothing.

Insults are word stems that the training labels point to: prefixes of at least STEM letters that
toxic training texts hold far oftener than others, weighted by their log odds. A few fixed words
of each class stand beside them. Only labelled rows outside the held-out fold teach anything, at
most PER_CLASS of each class; the stems kept are at most STEMS. Without labels the fixed words and
coefficients remain.

Rows: a null or empty text has no clause and gets the score of a text without a match. Repeated
rows and ids give a row each, a null id too. An empty table gives an empty result. Other columns
are ignored by scores(), kept by without_toxic().
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm.folds import held_out, prior_shift, training_rows
from panelyard.llm.runtime import bounded_batches, settled, written

PER_CLASS = 4000
STEM, LONGEST = 3, 12
SUPPORT, PURITY = 6, 0.75
STEMS = 5000
CACHED = 150_000
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, STOP = range(7)
TOKEN = re.compile(r"[^\W\d_]+|[.,;:!?\n]")
# fixed values: words of each class
INSULTS = "idiot moron stupid scum loser pathetic trash worthless clown disgusting dumb fool imbecile bastard dummkopf trottel abschaum arschloch versager connard salaud imbécile crétin ordure estúpido imbécil basura escoria".split()
THREATS = "kill destroy hurt burn shoot hang töten umbringen vernichten tuer détruire brûler matar destruir quemar".split()
TARGETS = "you your he she they them these those du dich ihr euch sie tu toi vous ils elles tú usted ustedes ellos ellas".split()
NEGATIONS = "not no never nicht kein keine nie pas jamais nunca jamás".split()
REPORTS = "said says wrote writes quoted called claimed sagte sagt schrieb nannte dit disait écrit appelé dijo dice escribió llamó".split()
SEED_WEIGHT = 3.0
#: Of a text without labels to learn from: intercept, and the features of clauses().
DEFAULT = np.array([-3.5, 3.0, 1.5, 0.4, 0.2, 0.0])


@dataclass(frozen=True)
class Transducer:
    """Reads classes. moves: (state, class) -> (state, output); other classes keep the state and
    put out the neutral value, and STOP leads back to the start. Patterns put out shares of the
    weight at hand (neutral 0), changes put out factors (neutral 1)."""

    moves: dict[tuple[int, int], tuple[int, float]]
    neutral: float
    start: int = 0

    def step(self, state: int, symbol: int) -> tuple[int, float]:
        return self.moves.get((state, symbol), (self.start if symbol == STOP else state, self.neutral))


def insult_clause(raised: float = 1.25) -> Transducer:
    """States: nothing yet, a target, an insult without a target. A target that comes after the
    insult puts out what it would have raised."""
    moves = {(0, TARGET): (1, 0.0), (0, INSULT): (2, 1.0), (1, INSULT): (1, raised), (2, INSULT): (2, 1.0), (2, TARGET): (1, raised - 1.0)}
    return Transducer(moves, 0.0)


def threat_clause(worth: float = 1.25) -> Transducer:
    """States: nothing yet, a target, a threat without a target."""
    return Transducer({(0, TARGET): (1, 0.0), (0, THREAT): (2, 0.0), (1, THREAT): (1, worth), (2, TARGET): (1, worth)}, 0.0)


def negation(span: int = 3, factor: float = 0.35) -> Transducer:
    """Lowers what follows a negation within span words."""
    moves = {(s, NEGATION): (span, 1.0) for s in range(span + 1)}
    for s in range(1, span + 1):
        moves |= {(s, c): (s - 1, 1.0 if c == OTHER else factor) for c in (OTHER, INSULT, THREAT, TARGET, REPORT)}
    return Transducer(moves, 1.0)


def reported(factor: float = 0.5) -> Transducer:
    """Lowers the rest of a clause after a word of reporting."""
    return Transducer({(0, REPORT): (1, 1.0)} | {(1, c): (1, factor) for c in (INSULT, THREAT, TARGET)}, 1.0)


def composed(patterns: list[Transducer], changes: list[Transducer]) -> dict[tuple, list[tuple[tuple, float]]]:
    """The product machine: state -> (state, output) for each class; its output is what the
    patterns put out together times what each change makes of it."""
    start = tuple(m.start for m in (*patterns, *changes))
    table: dict[tuple, list[tuple[tuple, float]]] = {}
    todo = [start]
    while todo:
        state = todo.pop()
        if state in table:
            continue
        row = []
        for symbol in range(STOP + 1):
            moves = [m.step(s, symbol) for m, s in zip((*patterns, *changes), state)]
            puts = [o for _, o in moves]
            row.append((tuple(s for s, _ in moves), sum(puts[: len(patterns)]) * math.prod(puts[len(patterns) :])))
        table[state] = row
        todo += [s for s, _ in row]
    return table


GRAMMAR = composed([insult_clause(), threat_clause()], [negation(), reported()])
START = (0, 0, 0, 0)


class Scorer:
    def __init__(self, stems: dict[str, float]):
        self.stems = stems
        self.words: dict[str, tuple[int, float]] = {}
        for words, kind in ((TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT)):
            self.words |= {w: (kind, 0.0) for w in words}
        for words, kind in ((THREATS, THREAT), (INSULTS, INSULT)):
            self.words |= {w: (kind, stems.get(w, SEED_WEIGHT)) for w in words}
        self.words |= {c: (STOP, 0.0) for c in ".,;:!?\n"}
        self.cache = dict(self.words)

    def classify(self, word: str) -> tuple[int, float]:
        for n in range(min(len(word), LONGEST), STEM - 1, -1):
            if (weight := self.stems.get(word[:n])) is not None:
                return INSULT, weight
        return OTHER, 0.0

    def features(self, text: str) -> tuple[float, ...]:
        """any matched clause, log of the clauses' total, the largest clause, per 100 words, log of
        words."""
        tokens = TOKEN.findall(text.lower())
        cache = self.cache
        read = list(map(cache.get, tokens))
        if None in read:
            if len(cache) > CACHED:
                self.cache = cache = dict(self.words)
            for i, t in enumerate(tokens):
                if read[i] is None:
                    read[i] = cache.get(t) or cache.setdefault(t, self.classify(t))
        hits = [i for i, (k, _) in enumerate(read) if k == INSULT or k == THREAT]
        total = largest = 0.0
        done = -1
        for hit in hits:
            if hit <= done:
                continue
            a = hit
            while a > 0 and read[a - 1][0] != STOP:
                a -= 1
            b = hit
            while b < len(read) and read[b][0] != STOP:
                b += 1
            done, state, score, held = b, START, 0.0, SEED_WEIGHT
            for kind, weight in read[a:b]:
                state, output = GRAMMAR[state][kind]
                if weight:  # a target after it puts out a share of the last insult or threat
                    held = weight
                score += held * output
            total += score
            largest = max(largest, score)
        n = len(tokens)
        return float(total > 0), math.log1p(total), largest, 100 * total / (n + 20), math.log1p(n)


FEATURES = ["f0", "f1", "f2", "f3", "f4"]


def learned_stems(rows: DataFrame) -> dict[str, float]:
    """Prefixes that toxic training texts hold far oftener than others, with their log odds."""

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, y in zip(batch.text, batch.y):
                words = set(TOKEN.findall(text.lower()))
                (toxic if y else clean).update({w[:n] for w in words for n in range(STEM, min(len(w), LONGEST) + 1)})
        keys = list({*toxic, *clean})
        for at in range(0, len(keys), 50_000):
            part = keys[at : at + 50_000]
            yield pd.DataFrame({"stem": pd.Series(part, dtype=object), "t": [toxic[k] for k in part], "c": [clean[k] for k in part]})

    totals = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_t, n_c = totals.get(1, 0), totals.get(0, 0)
    if not n_t or not n_c:
        return {}
    sums = rows.select("text", "y").mapInPandas(counts, "stem string, t long, c long").groupBy("stem").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    rate_t, rate_c = (F.col("t") + 0.5) / (n_t + 1), (F.col("c") + 0.5) / (n_c + 1)
    good = sums.where((F.col("t") >= SUPPORT) & (rate_t >= PURITY / (1 - PURITY) * rate_c)).withColumn("w", F.log(rate_t / rate_c))
    found = {r["stem"]: (r["t"], r["c"], r["w"]) for r in good.orderBy(F.desc("t"), "stem").limit(STEMS).collect()}
    out: dict[str, float] = {}
    for stem, (t, c, w) in sorted(found.items(), key=lambda x: (len(x[0]), x[0])):
        shorter = [p for n in range(STEM, len(stem)) if (p := stem[:n]) in out]
        # a longer stem only where it tells more than the shorter one that covers it
        if not shorter or w > out[shorter[-1]] + 0.7:
            out[stem] = w
    return out


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Logistic regression by Newton's method; the first coefficient is the intercept."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    keep = ridge * np.eye(x.shape[1])
    keep[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + keep, x.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _features(docs: DataFrame, stems: dict[str, float], keep: list[str]) -> DataFrame:
    schema = ", ".join(f"{c} double" for c in FEATURES)

    @F.pandas_udf(schema)
    def read(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(stems)
        for texts in parts:
            yield pd.DataFrame([scorer.features(t) for t in texts], columns=FEATURES, dtype=float)
        del scorer
        settled()

    return docs.select(*keep, read(F.coalesce("text", F.lit(""))).alias("f")).select(*keep, "f.*")


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1), predicted (score >= 0.5)."""
    bounded_batches(docs.sparkSession)
    rows = training_rows(docs, labels, "toxic", PER_CLASS).persist()
    stems = learned_stems(rows)
    taught = _features(rows, stems, ["y"]).toPandas()  # at most 2 * PER_CLASS rows
    weights = DEFAULT
    if taught.y.nunique() == 2:
        weights = fitted(taught[FEATURES].to_numpy(), taught.y.to_numpy())
        weights[0] += prior_shift(labels, "toxic", PER_CLASS)
    rows.unpersist()
    line = F.lit(float(weights[0])) + sum((F.col(f) * float(w) for f, w in zip(FEATURES, weights[1:])), F.lit(0.0))
    out = _features(docs, stems, ["doc_id"]).select("doc_id", held_out().alias("held_out"), (1 / (1 + F.exp(-line))).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, all columns kept. Rows that share a doc_id go
    only if each is predicted toxic; rows with a null id stay."""
    toxic = scores(docs, labels).where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.min("predicted").alias("_toxic")).where("_toxic = 1")
    # written, so that Spark knows its size and deals the documents only where it is large
    toxic = written(toxic.select("_id"), "toxic")
    return docs.join(toxic, docs["doc_id"] == toxic["_id"], "left_anti")
