"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

P(grade >= k) = sigmoid(w . x - theta_k): the weights w are shared by all thresholds, which only move
the cut. The result is the expected grade, the sum of these probabilities over k. A document is called
toxic if P(grade >= 1) reaches the value that would make the fewest errors among all labelled documents.

Features are lower-cased words (runs of letters) and their first four and five letters; a feature's
value is 1 + log(its count). Kept are those that toxic documents of the sample hold at least
RATIO times as often as clean ones. Labels say only whether a document is toxic; documents labelled
toxic are graded 1 to GRADES by the share of their words that have a kept feature, cut at equal
parts. Grades given as labels are used as they are.

Null texts count as empty and get the grade that no feature gives. Labels that are null,
contradict each other, have no document or have documents with different texts are left out; without both kinds of labels every
expected grade is 0. Repeated rows are graded each by itself. An empty table gives no rows. Only the
columns doc_id, text, and of the labels doc_id and toxic are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repricer.llm.common import unit

GRADES = 3
#: Labelled documents of each kind that are used, about.
SAMPLE = 6000
#: Toxic documents of the sample that must hold a feature, as a number and a share, and how much more often than clean ones.
LEAST_DOCS = 4
LEAST_SHARE = 0.005
RATIO = 4.0
#: Features at most, those that tell most: bounds the model.
MOST_FEATURES = 8192
_WORDS = re.compile(r"[^\W\d_]+")
_REMEMBERED = 200_000


def features_of(word: str) -> list[str]:
    return [f"={word}", *[f"{n}{word[:n]}" for n in (4, 5) if len(word) > n]]


def words_in(text: str | None) -> Counter[str]:
    return Counter(_WORDS.findall((text or "").lower()))


@dataclass
class OrdinalModel:
    """Places and weights of the features and the ascending thresholds; no threshold means nothing was learned."""

    places: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray
    cut: float = 0.5
    _known: dict[str, list[int]] = field(default_factory=dict)

    def vector(self, text: str | None) -> tuple[dict[int, float], float]:
        """The values of the features that occur, and the share of words that have one."""
        counts: Counter[int] = Counter()
        marked = total = 0
        known = self._known
        for word, n in words_in(text).items():
            total += n
            found = known.get(word)
            if found is None:
                if len(known) > _REMEMBERED:
                    known.clear()
                found = known[word] = [self.places[f] for f in features_of(word) if f in self.places]
            if found:
                marked += n
                for place in found:
                    counts[place] += n
        return {place: 1 + math.log(n) for place, n in counts.items()}, marked / total if total else 0.0

    def at_least(self, text: str | None) -> np.ndarray:
        """P(grade >= k) for k from 1."""
        values, _ = self.vector(text)
        score = sum(self.weights[place] * value for place, value in values.items())
        return 1 / (1 + np.exp(self.thresholds - score))


def fit(rows: np.ndarray, places: np.ndarray, values: np.ndarray, grades: np.ndarray, n_features: int, penalty: float = 1e-3, steps: int = 400):
    """Weights and thresholds of the largest penalised likelihood, by gradient steps with momentum.

    The matrix is given by its entries (rows, places, values); grades go from 0 up without gaps.
    """
    n, top = len(grades), int(grades.max())
    weights, first, gaps = np.zeros(n_features), 1.0, np.zeros(top - 1)
    moments = [np.zeros(n_features + top), np.zeros(n_features + top)]
    for step in range(1, steps + 1):
        thresholds = first + np.r_[0.0, np.cumsum(np.exp(gaps))]
        edges = np.r_[-np.inf, thresholds, np.inf]
        score = np.bincount(rows, values * weights[places], minlength=n)
        high = 1 / (1 + np.exp(np.clip(score - edges[grades + 1], -50, 50)))  # P(grade <= own)
        low = 1 / (1 + np.exp(np.clip(score - edges[grades], -50, 50)))  # P(grade < own)
        slope_high, slope_low = high * (1 - high), low * (1 - low)
        slope_high[grades == top] = slope_low[grades == 0] = 0.0
        likely = np.maximum(high * (grades < top) + (grades == top) - low * (grades > 0), 1e-12)
        to_score = (slope_high - slope_low) / likely / n
        to_weights = np.bincount(places, values * to_score[rows], minlength=n_features) + penalty * weights
        to_thresholds = -np.bincount(grades[grades < top], (slope_high / likely)[grades < top], minlength=top)
        to_thresholds += np.bincount(grades[grades > 0] - 1, (slope_low / likely)[grades > 0], minlength=top)
        to_thresholds /= n
        to_gaps = np.cumsum(to_thresholds[::-1])[::-1][1:] * np.exp(gaps)
        slope = np.r_[to_weights, to_thresholds.sum(), to_gaps]
        moments[0] = 0.9 * moments[0] + 0.1 * slope
        moments[1] = 0.999 * moments[1] + 0.001 * slope**2
        change = 0.1 * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-8)
        weights, first, gaps = weights - change[:n_features], first - change[n_features], gaps - change[n_features + 1 :]
    return weights, first + np.r_[0.0, np.cumsum(np.exp(gaps))]


def _count_features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for toxic, texts in batch.groupby("toxic")["text"]:
            held = Counter(f for text in texts for f in {f for word in words_in(text) for f in features_of(word)})
            yield pd.DataFrame({"feature": held.keys(), "toxic": bool(toxic), "n": held.values()})


def learn(docs: DataFrame, labels: DataFrame, grades: int = GRADES, sample: int = SAMPLE) -> OrdinalModel:
    """A model from about `sample` labelled documents of each kind.

    The driver gets the features kept and, for the documents of the sample, their few entries.
    """
    nothing = OrdinalModel({}, np.zeros(0), np.zeros(0))
    agreed = (
        labels.groupBy(F.col("doc_id").cast("long").alias("_id"))
        .agg(F.min("toxic").cast("boolean").alias("low"), F.max("toxic").cast("boolean").alias("toxic"))
        .filter("low = toxic AND _id IS NOT NULL")
    )
    kinds = {r["toxic"]: r["n"] for r in agreed.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(kinds) < 2:
        return nothing
    share = F.when(F.col("toxic"), min(1.0, sample / kinds[True])).otherwise(min(1.0, sample / kinds[False]))
    drawn = agreed.filter(unit("_id", seed=5) < share).select("_id", "toxic")
    # about 2 * sample rows of two small columns, whatever the number of labels
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("_id"))
    # one row per id, whatever the number of copies; of an id with different texts the label's is not known
    text = F.coalesce("text", F.lit(""))
    chosen = (
        chosen.groupBy("doc_id", "toxic")
        .agg(F.min(text).alias("text"), F.max(text).alias("last"))
        .filter("text = last")
        .select("text", "toxic")
    )
    sizes = {r["toxic"]: r["n"] for r in chosen.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return nothing
    counted = (
        chosen.mapInPandas(_count_features, "feature string, toxic boolean, n long")
        .groupBy("feature")
        .agg(F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic"), 0).otherwise(F.col("n"))).alias("c"))
    )
    # two standard deviations more clean documents than were seen, as a word may be rare by chance
    clean = F.col("c") + 2 * F.sqrt(F.col("c") + 1)
    ratio = (F.col("t") / sizes[True]) / (clean / sizes[False])
    kept = counted.filter((F.col("t") >= max(LEAST_DOCS, LEAST_SHARE * sizes[True])) & (ratio >= RATIO)).orderBy(F.desc("t"), "feature").limit(MOST_FEATURES)
    places = {row["feature"]: i for i, row in enumerate(kept.select("feature").collect())}
    if not places:
        return nothing
    model = OrdinalModel(places, np.zeros(len(places)), np.zeros(0))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [held.value.vector(text) for text in batch["text"]]
            yield pd.DataFrame(
                {
                    "toxic": batch["toxic"],
                    "share": [s for _, s in found],
                    "places": [list(v) for v, _ in found],
                    "at": [list(v.values()) for v, _ in found],
                }
            )

    table = chosen.mapInPandas(entries, "toxic boolean, share double, places array<int>, at array<double>").toPandas()
    toxic = table["toxic"].to_numpy(bool)
    cuts = np.unique(np.quantile(table["share"][toxic], np.arange(1, grades) / grades))
    given = np.where(toxic, 1 + np.searchsorted(cuts, table["share"], side="left"), 0)
    given = np.unique(given, return_inverse=True)[1]
    many = table["places"].str.len().to_numpy()
    if not many.sum():
        return nothing
    model.weights, model.thresholds = fit(
        np.repeat(np.arange(len(table)), many), np.concatenate(table["places"]).astype(np.int64), np.concatenate(table["at"]), given, len(places)
    )
    p = 1 / (1 + np.exp(model.thresholds[0] - np.array([sum(model.weights[k] * v for k, v in zip(*row)) for row in zip(table["places"], table["at"])])))
    model.cut = _best_cut(p, toxic, kinds[True], kinds[False])
    return model


def _best_cut(p: np.ndarray, toxic: np.ndarray, n_toxic: int, n_clean: int) -> float:
    """The middle of the gap at which the fewest errors are made, the sample's shares standing for all n labelled."""
    steps = np.unique(p)
    at_least = lambda kind: 1 - np.searchsorted(np.sort(p[kind]), steps) / kind.sum()
    best = int(np.argmax(n_toxic * at_least(toxic) - n_clean * at_least(~toxic)))
    return float((steps[best] + steps[max(0, best - 1)]) / 2)


def graded(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """Columns doc_id, severity (expected grade), p_toxic (of grade 1 or more), grade (most likely) and toxic, a row per document."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MOST_FEATURES

    @F.pandas_udf("severity double, p_toxic double, grade int")
    def grade(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = OrdinalModel(held.value.places, held.value.weights, held.value.thresholds, held.value.cut)
        for texts in batches:
            rows = []
            for text in texts:
                p = own.at_least(text)
                rows.append((p.sum(), p[0], int(np.argmax(np.r_[1.0, p] - np.r_[p, 0.0]))) if len(p) else (0.0, 0.0, 0))
            yield pd.DataFrame(rows, columns=["severity", "p_toxic", "grade"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), grade("text").alias("_g")).select(
        "doc_id", "_g.severity", "_g.p_toxic", "_g.grade", (F.col("_g.p_toxic") >= model.cut).alias("toxic")
    )
