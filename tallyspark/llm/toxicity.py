"""Toxicity: a linear classifier of words and word beginnings, regularised by counterfactual identity terms."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: The classifier is fitted on at most so many labelled rows, those with the smallest hashed ids.
SAMPLE = 6_000
#: A feature takes part if so many toxic rows of the sample have it and its chi-squared is so high; at most so many do.
LEAST, CHI2, FEATURES = 3, 15.0, 20_000
BEGINNINGS = (4, 5, 6)
THRESHOLD, L2, COUNTERFACTUAL, STEPS = 0.7, 0.002, 1.0, 400
#: A worker keeps the weighed features of so many distinct words, some 200 bytes each.
SEEN = 100_000

#: Identity terms that may be swapped for one another, by group, in English, German, French and Spanish.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer", "heterosexual"),
    ("muslim", "christian", "jewish", "buddhist", "hindu", "atheist", "catholic", "sikh"),
    ("muslims", "christians", "jews", "buddhists", "hindus", "atheists", "catholics", "sikhs"),
    ("black", "white", "asian", "latino", "arab", "african", "european", "american", "mexican", "chinese"),
    ("immigrants", "refugees", "foreigners", "natives", "locals"),
    ("disabled", "blind", "deaf", "autistic"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("schwul", "lesbisch", "bisexuell", "hetero", "queer"),
    ("muslime", "christen", "juden", "buddhisten", "hindus", "atheisten", "katholiken"),
    ("schwarze", "weiße", "asiaten", "araber", "afrikaner", "türken", "polen"),
    ("einwanderer", "flüchtlinge", "ausländer", "einheimische"),
    ("behinderte", "blinde", "gehörlose", "autisten"),
    ("femmes", "hommes", "filles", "garçons"),
    ("gays", "lesbiennes", "bisexuels", "hétérosexuels"),
    ("musulmans", "chrétiens", "juifs", "bouddhistes", "hindous", "athées", "catholiques"),
    ("noirs", "blancs", "asiatiques", "arabes", "africains", "européens"),
    ("immigrés", "réfugiés", "étrangers", "autochtones"),
    ("handicapés", "aveugles", "sourds", "autistes"),
    ("mujeres", "hombres", "chicas", "chicos"),
    ("homosexuales", "lesbianas", "bisexuales", "heterosexuales"),
    ("musulmanes", "cristianos", "judíos", "budistas", "hindúes", "ateos", "católicos"),
    ("negros", "blancos", "asiáticos", "árabes", "africanos", "europeos"),
    ("inmigrantes", "refugiados", "extranjeros", "nativos"),
    ("discapacitados", "ciegos", "sordos", "autistas"),
)

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> set[str]:
    """Distinct words of letters; lower-cased."""
    found: set[str] = set()
    for part in set(text.lower().split()):
        found.update((part,) if part.isalpha() else _WORD.findall(part))
    return found


def features_of(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in BEGINNINGS if len(word) > n)]


@dataclass
class Model:
    weights: dict[str, float]
    bias: float

    def scorer(self):
        """A function from a text to its score. Words' weights are kept, up to a bound, as most words come again."""
        seen: dict[str, tuple] = {}
        weights, bias = self.weights, self.bias

        def of(part: str) -> tuple:
            if len(seen) > SEEN:
                seen.clear()
            found = seen[part] = tuple({f for w in ((part,) if part.isalpha() else _WORD.findall(part)) for f in features_of(w) if f in weights})
            return found

        def score(text: str) -> float:
            own: set[str] = set()
            for part in set(text.lower().split()):
                found = seen.get(part)
                own.update(of(part) if found is None else found)
            z = bias + sum(weights[f] for f in sorted(own))
            return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))

        return score


def counterfactuals(words: set[str], groups: tuple = IDENTITY_TERMS) -> list[set[str]]:
    """The words with each identity term swapped for the next of its group."""
    return [words - {w} | {group[(i + 1) % len(group)]} for group in groups for i, w in enumerate(group) if w in words]


def mentions(groups: tuple = IDENTITY_TERMS) -> list[tuple[str, str]]:
    """Each group's terms in pairs, as a template "<sentence> <term>" swaps them in any labelled sentence."""
    return [(term, group[(i + 1) % len(group)]) for group in groups for i, term in enumerate(group)]


def with_mentions(rows: list[tuple[tuple[str, ...], int]], groups: tuple = IDENTITY_TERMS) -> list[tuple[tuple[str, ...], int]]:
    """The labelled rows and, for every toxic one and as many others, the row with a neutral mention added by the template
    "<sentence> <term>", the label unchanged: so the terms are features that are weighed, and the penalty acts on them.
    The terms come in turn."""
    terms = [t for g in groups for t in g]
    toxic = [x for x in rows if x[1]]
    clean = [x for x in rows if not x[1]]
    chosen = toxic + clean[:: max(1, len(clean) // max(1, len(toxic)))][: len(toxic)] if terms else []
    return rows + [((*words, terms[i % len(terms)]), y) for i, (words, y) in enumerate(chosen)]


def fit(rows: list[tuple[tuple[str, ...], int]], groups: tuple = IDENTITY_TERMS, counterfactual: float = COUNTERFACTUAL) -> Model:
    """Logistic regression on presence of features, with a penalty on squared changes of score (log-odds).

    Two kinds of change are penalised: between a labelled sentence and itself with an identity term swapped, and, for
    every labelled sentence whether or not it holds a term, between the sentence and itself with a neutral mention of a
    group added, and between two such mentions. Scores being linear in features, the changes of the second kind are the
    same for all sentences that don't hold the term's features, and are computed once, with the weight of all sentences.
    Word beginnings that terms share with other words are held back in this way too. Without both labels: a constant
    score of the labels' share."""
    labels = np.array([y for _, y in rows], dtype=np.float64)
    share = (labels.sum() + 1) / (len(labels) + 2) if len(labels) else 0.0
    if not len(labels) or labels.min() == labels.max():
        return Model({}, float(np.log(share / (1 - share))) if share else -50.0)
    counts: dict[str, list[int]] = {}
    for words, y in rows:
        for f in {f for w in words for f in features_of(w)} if y else ():
            counts.setdefault(f, [0, 0])[1] += 1
    counts = {f: c for f, c in counts.items() if c[1] >= LEAST}
    for words, y in rows:
        if not y:
            for f in {f for w in words for f in features_of(w)}:
                if f in counts:
                    counts[f][0] += 1
    n, toxic = len(labels), labels.sum()

    def chi2(c: list[int]) -> float:
        b, a = c
        have = a + b
        below = toxic * (n - toxic) * have * (n - have)
        return n * (a * (n - toxic - b) - b * (toxic - a)) ** 2 / below if below else 0.0

    terms = {t for g in groups for t in g}
    chosen = sorted((f for f, c in counts.items() if chi2(c) >= CHI2 or f in terms), key=lambda f: (-chi2(counts[f]), f))[:FEATURES]
    at = {f: i for i, f in enumerate(chosen)}

    def matrix(sets):
        found = [sorted({at[f] for w in s for f in features_of(w) if f in at}) for s in sets]
        return np.repeat(np.arange(len(found)), [len(x) for x in found]), np.array([i for x in found for i in x], dtype=np.int64)

    row, column = matrix([w for w, _ in rows])
    swaps = [(words, other) for words, _ in rows for other in counterfactuals(set(words), groups)]
    pairs = mentions(groups)
    templates = [({a}, {b}) for a, b in pairs] + [({a}, set()) for a, _ in pairs]
    share_of = np.concatenate([np.full(len(swaps), 1 / max(1, len(swaps))), np.full(len(templates), 1 / max(1, len(templates)))])
    swaps += templates
    row_a, column_a = matrix([a for a, _ in swaps])
    row_b, column_b = matrix([b for _, b in swaps])
    k = len(chosen)
    w, bias = np.zeros(k), np.log(share / (1 - share))
    m1, m2 = np.zeros(k + 1), np.zeros(k + 1)
    # rare toxic rows weigh more, up to 3 times, so that one clear word outweighs the base rate
    weight = np.where(labels == 1, min(3.0, max(1.0, (n - toxic) / toxic / 3)), 1.0)
    for step in range(1, STEPS + 1):
        z = bias + np.bincount(row, w[column], minlength=n)
        error = weight * (1 / (1 + np.exp(-z)) - labels) / n
        slope = np.bincount(column, error[row], minlength=k) + L2 * w / np.sqrt(n)
        if swaps:
            change = np.bincount(row_a, w[column_a], minlength=len(swaps)) - np.bincount(row_b, w[column_b], minlength=len(swaps))
            change *= 2 * counterfactual * share_of
            slope += np.bincount(column_a, change[row_a], minlength=k) - np.bincount(column_b, change[row_b], minlength=k)
        g = np.append(slope, error.sum())
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        move = 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return Model({f: float(x) for f, x in zip(chosen, w, strict=True)}, float(bias))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, **options) -> Model:
    """Fit on labelled rows that aren't held out. Rows without a label of 0 or 1 take no part; of several labels of one id
    the highest counts; of rows that repeat an id each counts, up to twice the sample in all, in the order of hashed ids."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).cast("long").alias("id__")).agg(F.max("toxic").alias("toxic__"))
    chosen = known.join(docs.select(F.col(id_col).cast("long").alias("id__")).distinct(), "id__", "left_semi").orderBy(F.xxhash64("id__"), "id__").limit(sample)
    chosen = common.cut(chosen, "labelled")
    rows = docs.select(F.col(id_col).cast("long").alias("id__"), common.text_of(text_col).alias("text")).join(F.broadcast(chosen), "id__")

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("toxic"), pa.array([" ".join(sorted(words_of(x))) for x in batch.column("text").to_pylist()], pa.string())], ["id", "toxic", "words"])

    found = rows.select(F.col("id__").alias("id"), F.col("toxic__").cast("int").alias("toxic"), "text").mapInArrow(run, "id long, toxic int, words string").orderBy(F.xxhash64("id"), "id", "words")
    # words are shared between rows: the sample takes some 10 KB a row on the driver
    known_words: dict[str, str] = {}
    kept = [(tuple(known_words.setdefault(w, w) for w in r["words"].split()), r["toxic"]) for r in found.limit(2 * sample).toLocalIterator()]
    return fit(with_mentions(sorted(kept, key=lambda x: (x[1], len(x[0]), x[0][:20])), options.get("groups", IDENTITY_TERMS)), **options)


_scorers: dict[str, object] = {}


def _scorer(name: str, held):
    """A worker's scorer of a model; its word cache outlives tasks."""
    if name not in _scorers:
        _scorers.clear()
        _scorers[name] = held.value.scorer()
    return _scorers[name]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", out: str = "score") -> DataFrame:
    """docs and their scores from 0 to 1; null texts count as empty. The model's size is bounded by FEATURES."""
    told, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = common.task("toxicity", lambda parts: (x.map(_scorer(name, told)).astype("float64") for x in parts), _scorers.clear)
        yield from run(batches)

    return docs.withColumn(out, scores(common.text_of(text_col)))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted): a row per row of docs; null ids aren't held out. Without usable labels all
    rows have one score, near 0."""
    scored = score(docs.select(id_col, text_col), train(docs, labels, id_col, text_col), id_col, text_col)
    return scored.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
