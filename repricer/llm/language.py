"""Language identification with bit-sliced Bloom filters of character n-grams.

One table of bit masks holds a Bloom filter for every language: bit L of a slot belongs to language
L, so that the masks at a gram's slots, ANDed, give all languages that contain the gram at once. A
text's hits per language are corrected for the filters' false positives, and the language with the
most corrected hits wins; its share of the text's grams is the score.

A gram is four letters or word ends in a row (everything that is not a letter is a word end; two
word ends in a row make no gram), of the lower-cased text. A language's filter holds the grams found
in at least MIN_SHARE of its sampled documents. Texts of single letters apart from each other have no such
gram. The same filters decide them by the letters with the word ends beside them, grams of three and two.

Null texts and texts without letters are `und` with score 0, as is every text if nothing could be
learned. Ties go to the language that comes first in code point order. Texts are read whole, long
ones in slices that overlap so that no gram is lost. Only the id, text and language columns are
read; repeated rows are predicted each by itself. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repricer.llm.common import released, unit

ORDER = 4
#: Of the grams of single letters.
SHORT = (3, 2)
#: Training documents of a language that are used, about.
SAMPLE = 2000
#: Share of a language's sampled documents that must hold a gram.
MIN_SHARE = 0.01
#: Grams of a language at most, the most frequent ones: bounds the model.
MOST_GRAMS = 40_000
#: Slots of the filters, a power of two, and hash functions.
SLOTS = 1 << 20
HASHES = 2
_SLICE = 1 << 20
UNDETERMINED = "und"


@functools.cache
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def _slices(text: str, order: int) -> Iterator[str]:
    for start in range(0, len(text), _SLICE):
        yield text[max(0, start - order + 1) : start + _SLICE]


def gram_hashes(text: str, order: int = ORDER) -> Iterator[np.ndarray]:
    """64-bit hashes of the grams of a text, slice by slice; those shorter than ORDER are of one letter and word ends."""
    for part in _slices(f" {text} ".lower(), order):
        points = np.frombuffer(part.encode("utf-32-le"), dtype=np.uint32)
        points = np.where(_letters()[points], points, np.uint32(32))
        n = len(points) - order + 1
        if n < 1:
            continue
        gap = points == 32
        twice = gap[1:] & gap[:-1]
        good = ~twice[:n]
        for k in range(1, order - 1):
            good &= ~twice[k : k + n]
        if order < ORDER:
            good &= sum(gap[k : k + n].astype(int) for k in range(order)) == order - 1
        hashes = points[:n].astype(np.uint64)
        for k in range(1, order):
            hashes = hashes * np.uint64(0x100000001B3) + points[k : k + n]
        hashes = hashes[good]
        hashes ^= hashes >> np.uint64(33)
        hashes *= np.uint64(0xFF51AFD7ED558CCD)
        hashes ^= hashes >> np.uint64(33)
        yield hashes


def _slots(hashes: np.ndarray, which: int) -> np.ndarray:
    shift = np.uint64(32 * which // HASHES + 2 * which)
    return ((hashes >> shift) & np.uint64(SLOTS - 1)).astype(np.int64)


@dataclass(frozen=True)
class LanguageFilters:
    """Masks of shape (slots, words of 64 languages) and each language's false-positive rate."""

    languages: list[str]
    masks: np.ndarray
    false_rate: np.ndarray

    @classmethod
    def build(cls, grams: dict[str, np.ndarray]) -> LanguageFilters:
        languages = sorted(grams)
        masks = np.zeros((SLOTS, max(1, -(-len(languages) // 64))), dtype=np.uint64)
        filled = np.zeros(len(languages))
        for i, language in enumerate(languages):
            hashes = grams[language].astype(np.int64).view(np.uint64)
            for which in range(HASHES):
                masks[_slots(hashes, which), i // 64] |= np.uint64(1) << np.uint64(i % 64)
            filled[i] = np.count_nonzero(masks[:, i // 64] & (np.uint64(1) << np.uint64(i % 64))) / SLOTS
        return cls(languages, masks, filled**HASHES)

    def hits(self, text: str, orders: tuple[int, ...] = (ORDER,)) -> tuple[int, np.ndarray]:
        """Number of grams, and of those that each language's filter holds."""
        total, found = 0, np.zeros(len(self.languages))
        for hashes in itertools.chain.from_iterable(gram_hashes(text, order) for order in orders):
            total += len(hashes)
            held = self.masks[_slots(hashes, 0)]
            for which in range(1, HASHES):
                held = held & self.masks[_slots(hashes, which)]
            for i in range(len(self.languages)):
                found[i] += np.count_nonzero(held[:, i // 64] & (np.uint64(1) << np.uint64(i % 64)))
        return total, found

    def predict(self, text: str | None) -> tuple[str, float]:
        total, found = self.hits(text or "") if self.languages else (0, None)
        if self.languages and not total:
            total, found = self.hits(text or "", SHORT)
        if not total:
            return UNDETERMINED, 0.0
        shares = (found / total - self.false_rate) / (1 - self.false_rate)
        best = int(np.argmax(shares))
        return self.languages[best], float(min(1.0, max(0.0, shares[best])))


def _count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for lang, texts in batch.groupby("lang")["text"]:
            # distinct per document, then counted over the documents; a few MB of text at a time
            for orders in ((ORDER,), SHORT):
                held, size = [], 0
                for text in texts:
                    grams = itertools.chain.from_iterable(gram_hashes(text, order) for order in orders)
                    held.append(np.unique(np.concatenate([np.empty(0, np.uint64), *grams])))
                    size += len(held[-1])
                    if size > 2_000_000:
                        yield _counted(lang, orders == SHORT, held)
                        held, size = [], 0
                if size:
                    yield _counted(lang, orders == SHORT, held)


def _counted(lang: str, short: bool, held: list[np.ndarray]) -> pd.DataFrame:
    grams, n = np.unique(np.concatenate(held), return_counts=True)
    return pd.DataFrame({"lang": lang, "short": short, "gram": grams.view(np.int64), "n": n})


def learn(labelled: DataFrame, sample: int = SAMPLE) -> LanguageFilters:
    """Filters learned from the columns doc_id, text and lang, from about `sample` documents a language.

    The driver gets at most MOST_GRAMS hashes of a language, and as many short ones.
    """
    labelled = labelled.select("doc_id", "text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL")
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    # one row per language; the draw depends on the id alone
    share = {row["lang"]: min(1.0, sample / row["n"]) for row in sizes.collect()}
    if not share:
        return LanguageFilters.build({})
    drawn = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])[F.col("lang")]
    chosen = labelled.filter(unit("doc_id", seed=4) < drawn).select("lang", "text")
    used = F.create_map(*[F.lit(x) for r in sizes.collect() for x in (r["lang"], float(min(r["n"], sample)))])[F.col("lang")]
    counts = (
        chosen.mapInPandas(released(_count_grams), "lang string, short boolean, gram long, n long")
        .groupBy("lang", "short", "gram")
        .agg(F.sum("n").alias("n"))
        .filter((F.col("n") >= 2) & (F.col("n") >= MIN_SHARE * used))
    )
    ranked = counts.withColumn("place", F.row_number().over(Window.partitionBy("lang", "short").orderBy(F.desc("n"), "gram")))
    kept = ranked.filter(F.col("place") <= MOST_GRAMS).select("lang", "gram").toPandas()
    return LanguageFilters.build({lang: group["gram"].to_numpy() for lang, group in kept.groupby("lang")})


def is_held_out(doc_id: Column) -> Column:
    """Documents that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def predictor(docs: DataFrame, filters: LanguageFilters):
    """A column function: a text to its language and score."""
    held = docs.sparkSession.sparkContext.broadcast(filters)  # its size is bounded by SLOTS

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = held.value

        def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for texts in batches:
                yield pd.DataFrame([model.predict(text) for text in texts], columns=["lang", "score"])

        yield from released(predicted)(batches)

    return predict


def identified(docs: DataFrame) -> DataFrame:
    """Columns doc (the row) and predicted (lang, score), learned from the rows that are not held out."""
    filters = learn(docs.filter(~is_held_out(F.col("doc_id"))))
    return docs.select(F.struct("*").alias("doc"), predictor(docs, filters)("text").alias("predicted"))
