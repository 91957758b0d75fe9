"""Quality rules whose cut-offs keep the share of good documents that they reject below a limit.

A rule rejects documents whose signal is above a cut-off. On labelled holdouts, for each stratum,
signal and cut-off of a fixed grid, let k of n good documents be above it. Each of m signals may reject p = `risk` / m. If the true
share were p or more, so few would be seen with a probability of at most P(Binomial(n, p) <= k); a
cut-off is sure if that is at most `doubt`, divided by the number of all strata, signals and cut-offs
tried (Bonferroni). The lowest sure cut-off is used. So with probability 1 - `doubt` the rules of no stratum together reject
more than `risk` of its good documents. A stratum with too few labels gets no rule.

Null texts count as empty. A null stratum is a stratum of its own. Labels without a document, with
null values, or repeated with different values are left out; with no label at all only the base
rules act. Documents with the same doc_id are judged each by its own text; none of them is used as
a holdout. An empty table gives no rows. No Python runs on the executors.
"""

from __future__ import annotations

import math
import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repricer.llm.common import GAP, WORD, text_of, word_chars, written

SYMBOLS = "#*$%&|<>"
WINDOW = 8
LEAST_WORDS = 20
#: Percent of the words that may lie in repeated windows.
MOST_REPEATED = 30
#: The cut-offs tried for each signal, from the most lenient use of a sign that clean text may make of it.
CUTOFFS = {
    "symbol_share": [x / 100 for x in range(5, 51)],
    "upper_share": [x / 100 for x in range(12, 100, 2)],
    "dup_line_share": [x / 100 for x in range(20, 100, 2)],
    "repeat_share": [x / 100 for x in range(4, 100, 2)],
    "word_length": [x / 4 for x in range(32, 80)],
}
#: Of the good documents of a stratum, the share that its rules together may reject.
RISK = 0.025
DOUBT = 0.05


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with the value computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(starts: Column) -> Column:
    """Words that windows starting at these ascending places cover together."""
    step = lambda total, i: total + F.least(F.lit(WINDOW), F.get(starts, i) - F.get(starts, i - 1))
    return F.when(F.size(starts) == 0, 0).otherwise(
        F.aggregate(F.sequence(F.lit(0), F.size(starts) - 1), F.lit(WINDOW), lambda total, i: F.when(i == 0, total).otherwise(step(total, i)))
    )


def _repeated_starts(windows: Column) -> Column:
    """Places of the window hashes that occur twice or more, ascending."""
    at_hash = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))

    def places(ranked: Column) -> Column:
        hash_at = lambda i: F.get(ranked, i)["h"]
        same = lambda i, j: F.coalesce(hash_at(i) == hash_at(j), F.lit(False))
        found = F.filter(
            F.sequence(F.lit(0), F.size(ranked) - 1), lambda i: same(i, i - 1) | same(i, i + 1)
        )
        return F.array_sort(F.transform(found, lambda i: F.get(ranked, i)["at"]))

    return _let(at_hash, places)


def repeated_words(hashes: Column) -> Column:
    """Of words given by their hashes: how many lie in windows of WINDOW words found twice or more."""
    windows = _let(
        hashes,
        lambda h: F.transform(
            F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])
        ),
    )
    repeated = _let(
        windows,
        lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(_let(_repeated_starts(w), _covered)),
    )
    return F.when(F.size(hashes) <= WINDOW, 0).otherwise(repeated).cast("long")


def signals(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns of `keep` with the counts and shares of each text."""
    text = F.col("_text")
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.regexp_like(line, F.lit(WORD)))
    words = F.filter(F.split(text, GAP, -1), lambda word: word != "")
    without = lambda found: (F.char_length(text) - F.char_length(found)).cast("long")
    duplicates = _let(lines, lambda ls: F.struct(F.size(ls).alias("n"), F.size(F.array_distinct(ls)).alias("distinct")))
    counted = (
        docs.select(*keep, text_of("text").alias("_text"))
        .select(
            *keep,
            word_chars(text).alias("word_chars"),
            without(F.translate(text, SYMBOLS, "")).alias("n_symbols"),
            without(F.translate(text, string.ascii_uppercase, "")).alias("n_upper"),
            duplicates.alias("_lines"),
            _let(
                F.transform(words, lambda word: F.xxhash64(word)),
                lambda hashes: F.struct(F.size(hashes).cast("long").alias("n"), repeated_words(hashes).alias("repeated")),
            ).alias("_words"),
        )
        .select(
            *keep,
            F.col("_words.n").alias("n_words"),
            "word_chars",
            "n_symbols",
            (F.col("_lines.n") - F.col("_lines.distinct")).cast("long").alias("n_dup_lines"),
            F.col("_words.repeated").alias("n_repeat_words"),
            "n_upper",
            F.col("_lines.n").cast("long").alias("n_lines"),
        )
    )
    share = lambda part, whole: F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)
    return counted.withColumns(
        {
            "symbol_share": share("n_symbols", "word_chars"),
            "upper_share": share("n_upper", "word_chars"),
            "dup_line_share": share("n_dup_lines", "n_lines"),
            "repeat_share": share("n_repeat_words", "n_words"),
            "word_length": share("word_chars", "n_words"),
        }
    )


def _below(signal: str) -> Callable[[Column], Column]:
    return lambda cutoff: cutoff < F.col(signal)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), summed term by term in logarithms."""
    odds = math.log(p / (1 - p))
    first = n * F.lit(math.log1p(-p))

    def add(sums: Column, i: Column) -> Column:
        term = sums["term"] + F.log(n - i + 1) - F.log(i) + odds
        high = F.greatest(term, sums["total"])
        total = high + F.log(F.exp(term - high) + F.exp(sums["total"] - high))
        return F.struct(term.alias("term"), total.alias("total"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.exp(F.aggregate(steps, F.struct(first.alias("term"), first.alias("total")), add, lambda s: s["total"]))


def cutoffs(signalled: DataFrame, labels: DataFrame, risk: float = RISK, doubt: float = DOUBT) -> DataFrame:
    """Columns stratum, signal and cutoff: the sure cut-offs, one row at most per stratum and signal.

    `risk` is the share of good documents that all rules of a stratum together may reject: each signal has an even part of it, and
    the share that several rules reject together is no more than the sum of theirs.
    All good labels are used; the binomial sum has fewer than risk times their number of terms.
    """
    risk = risk / len(CUTOFFS)
    good = (
        labels.groupBy(F.col("doc_id").alias("_id"))
        .agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
        .filter("low = 1 AND high = 1")
    )
    # ids are made rows before the join, so that one with many documents is no hot key of it
    once = (
        signalled.filter("doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.count("*").alias("rows"), F.min(F.struct("stratum")).alias("_of"), *[F.max(s).alias(s) for s in CUTOFFS])
        .filter("rows = 1")
    )
    single = written(once.join(good, F.col("doc_id") == F.col("_id")).select("doc_id", "_of.stratum", *CUTOFFS), "holdout")
    sizes = single.groupBy("stratum").agg(F.count("*").alias("labelled"))
    # how many cut-offs of the grid lie below the value
    above = F.array(
        *[
            F.struct(
                F.lit(signal).alias("signal"),
                F.size(F.filter(F.array(*map(F.lit, grid)), _below(signal))).alias("passed"),
            )
            for signal, grid in CUTOFFS.items()
        ]
    )
    counts = single.select("stratum", F.explode(above).alias("x")).groupBy("stratum", "x.signal", "x.passed").agg(F.count("*").alias("rows"))
    # rows above the j-th cut-off: those that passed more than j; every cut-off gets a row
    grid = F.array(*[F.struct(F.lit(s).alias("signal"), F.lit(j).alias("j"), F.lit(c).alias("cutoff")) for s, g in CUTOFFS.items() for j, c in enumerate(g)])
    tried = sizes.select("stratum", F.explode(grid).alias("g")).select("stratum", "g.*")
    tests = F.count("*").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    tried = tried.withColumn("tests", tests)
    seen = (
        tried.alias("t")
        .join(
            counts.alias("c"),
            F.col("t.stratum").eqNullSafe(F.col("c.stratum")) & (F.col("t.signal") == F.col("c.signal")),
        )
        .groupBy("t.stratum", "t.signal", "t.cutoff", "t.tests")
        .agg(
            F.sum(F.when(F.col("passed") > F.col("j"), F.col("rows")).otherwise(0)).alias("k"),
            F.sum("rows").alias("n"),
        )
    )
    # a count at or above the mean is never sure, and needs no sum
    sure = F.when(F.col("k") < F.col("n") * risk, binomial_tail(F.col("k"), F.col("n"), risk)).otherwise(1.0)
    return (
        seen.filter(sure <= F.lit(doubt) / F.col("tests"))
        .groupBy("stratum", "signal")
        .agg(F.min("cutoff").alias("cutoff"))
    )


def judged(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **settings) -> DataFrame:
    """Columns doc_id, stratum, the counts, base_failed, kept and the rules that rejected, one row per document."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(stratum).alias("stratum"), "text")
    signalled = written(signals(source, ["doc_id", "stratum"]), "signals")
    # one row per stratum
    rules = written(
        cutoffs(signalled, labels, **settings)
        .groupBy(F.col("stratum").alias("_stratum"))
        .agg(F.map_from_entries(F.collect_list(F.struct("signal", "cutoff"))).alias("_cutoffs")),
        "cutoffs",
    )
    failed = F.filter(
        F.array(*[F.when(F.col(s) > F.col("_cutoffs")[s], F.lit(s)) for s in CUTOFFS]),
        lambda rule: rule.isNotNull(),
    )
    return (
        signalled.join(rules, F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
        .withColumn(
            "base_failed",
            (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")),
        )
        .withColumn("failed_rules", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
        .drop("_stratum", "_cutoffs")
    )
