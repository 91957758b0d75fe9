"""Mixing sources to target weights by Pareto order sampling.

A document is due copies in proportion to its weight, `limit` at most, so many that its source's words reach the target. The
whole part is certain. For the rest each document gets the Pareto rank (u / (1 - u)) / (p / (1 - p)), with u a
random number of its own and p the fraction of a copy still due, and documents are taken in rank
order until the source's words reach the target. By default a document's weight falls with the length of its text, so that
a source's sample has more, shorter documents; weights are rounded to powers of 2 ** (1 / 4), so that a
source has a bounded number of them and what is due is worked out on one row per source and weight.

A source is never sorted as a whole: ranks are cut into buckets, bucket sums are added up, and
only the bucket in which the target falls is looked at row by row. There, documents that still
fit are taken in a second and third pass, so that the rest that is missed is small.

Null texts have size 0, as have texts without words; documents of size 0 take nothing. A null
source is a source of its own. Rows that are repeated count each by itself. Ties of rank are
broken by doc_id and then by size; fully equal rows are interchangeable. An empty table gives no
rows. Only the id, text and source columns are read. No Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repricer.llm.common import text_of, unit, word_count, written

WEIGHTS = (1.0, 2.0, 3.0)
LIMIT = 3
SEED = 20
#: Documents per rank bucket, about.
BUCKET_ROWS = 2000
#: Buckets of a source at most; a source of more rows has larger buckets.
MOST_BUCKETS = 1 << 20
#: Steps of a weight between powers of two, and powers of two up to which weights differ from 1.
STEPS = 4
MOST_POWERS = 64


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, limit: float = LIMIT) -> DataFrame:
    """Columns source, source_size, source_rows and target, one row per source.

    Sources in code point order, null last, weigh `weights` in turn and share the sum of all sizes.
    A target stops at `limit` times its source's size and the excess is shared anew by weight. The
    sources at the limit are those with the least size for their weight, so sorting by that gives
    the final shares in one pass. Works on one row per source.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weighed = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")))
    by_need = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = by_need.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    most = F.col("source_size") * F.lit(float(limit))
    spare = F.sum("source_size").over(everything) - F.coalesce(F.sum(most).over(before), F.lit(0.0))
    levels = weighed.withColumn("most", most).withColumn("level", spare / F.sum("weight").over(onward))
    below = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))
    shared = levels.withColumn("level", F.first(below, ignorenulls=True).over(everything))
    target = F.least(F.col("most"), F.coalesce(F.col("level") * F.col("weight"), F.col("most")))
    return shared.select("source", "source_size", "source_rows", target.alias("target"))


def _fill(rows: DataFrame) -> DataFrame:
    """Takes, in rank order, documents that fit the gap of their source, and lessens the gap."""
    ranks = Window.partitionBy("source").orderBy("v", "doc_id", "size", "row")
    upto = ranks.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fits = ~F.col("extra") & (F.col("size") <= F.col("gap"))
    took = F.sum(F.when(F.col("more"), F.col("size")).otherwise(0)).over(Window.partitionBy("source"))
    return (
        rows.withColumn("more", fits & (F.sum(F.when(fits, F.col("size")).otherwise(0)).over(upto) <= F.col("gap")))
        .withColumn("gap", F.col("gap") - took)
        .withColumn("extra", F.col("extra") | F.col("more"))
        .drop("more")
    )


def by_length(size: Column) -> Column:
    """The default weight: 1 of the shortest documents, a quarter of those of some thousand words."""
    return 1 / F.sqrt(1 + F.log2(F.greatest(size, F.lit(1))) * 1.5)


def _copies_due(classes: DataFrame, targets: DataFrame, limit: float) -> DataFrame:
    """Of sources and weight classes (source, class, words, rows): the copies that a document of each is due.

    Columns source, class, source_size, source_rows, target, due and common, the odds of the source's mean fraction.
    Classes of the highest weights may be at the limit; the others share what these leave by weight.
    """
    weighed = classes.withColumn("w", F.when(F.col("class").isNotNull(), F.pow(F.lit(2.0), F.col("class") / STEPS)).otherwise(0.0))
    same = F.col("c.source").eqNullSafe(F.col("t.source"))
    joined = weighed.alias("c").join(targets.alias("t"), same).select("c.*", "source_size", "source_rows", "target")
    # a row per source and class
    by_weight = Window.partitionBy("source").orderBy(F.col("w").desc(), "class")
    before = by_weight.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_weight.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = by_weight.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.col("target") - limit * F.coalesce(F.sum("words").over(before), F.lit(0))
    rest = F.sum(F.col("w") * F.col("words")).over(onward)
    levels = joined.withColumn("level", F.when(rest > 0, left / rest))
    below = F.when(F.col("level") * F.col("w") <= limit, F.col("level"))
    shared = levels.withColumn("level", F.first(below, ignorenulls=True).over(whole))
    due = F.when(F.col("words") == 0, 0.0).otherwise(F.greatest(F.least(F.coalesce(F.col("level") * F.col("w"), F.lit(limit)), F.lit(limit)), F.lit(0.0)))
    p = F.col("due") - F.floor("due")
    drawn = F.when(p > 0, F.col("rows"))
    mean = F.sum(drawn * p).over(whole) / F.sum(drawn).over(whole)
    return shared.withColumn("due", due).select(
        "source", "class", "source_size", "source_rows", "target", "due", F.when(mean < 1, mean / (1 - mean)).otherwise(1.0).alias("common")
    )


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    limit: int = LIMIT,
    seed: int = SEED,
    doc_weight: Column | None = None,
) -> DataFrame:
    """Columns doc_id, source, size, source_size, target, copies and taken, one row per document.

    `doc_weight`, by default `by_length`, scales the copies due to a document within its source; documents of weight 0 take nothing
    unless the others cannot reach the target.
    """
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        word_count(text_of("text")).alias("size"),
        *([doc_weight.cast("double").alias("w")] if doc_weight is not None else []),
    )
    weight = F.col("w") if doc_weight is not None else by_length(F.col("size"))
    steps = F.round(F.log2(weight) * STEPS).cast("int")
    most = MOST_POWERS * STEPS
    sizes = written(
        sized.withColumn("class", F.when(weight > 0, F.greatest(F.least(steps, F.lit(most)), F.lit(-most))))
        .withColumn("row", F.monotonically_increasing_id())
        .drop("w"),
        "sizes",
    )
    targets = source_targets(sizes, weights, limit)
    classes = sizes.groupBy("source", "class").agg(F.sum("size").alias("words"), F.count(F.when(F.col("size") > 0, 1)).alias("rows"))
    # a row per source and class; as a table its size is known, and Spark broadcasts it only while it is small
    due = written(_copies_due(classes, targets, float(limit)), "due")
    u = unit("doc_id", "size", seed=seed)
    p = F.col("due") - F.col("whole")
    # the rank, against that of a document with the source's mean fraction: on a scale from 0 to 1, about evenly
    rank = u / (1 - u) * F.col("common") / (p / (1 - p))
    buckets = F.least(F.lit(MOST_BUCKETS), F.ceil(F.col("source_rows") / BUCKET_ROWS))
    drawn = (F.col("size") > 0) & (p > 0)
    same = F.col("s.source").eqNullSafe(F.col("t.source")) & F.col("s.class").eqNullSafe(F.col("t.class"))
    ranked = written(
        sizes.alias("s")
        .join(due.alias("t"), same)
        .select("s.*", "source_size", "target", "source_rows", "due", "common")
        .withColumn("whole", F.when(F.col("size") > 0, F.floor("due")).otherwise(0).cast("int"))
        .withColumn("v", F.when(drawn, rank / (1 + rank)))
        .withColumn("bucket", F.when(F.col("v").isNotNull(), F.least(F.floor(F.col("v") * buckets), buckets - 1)))
        .drop("due", "source_rows", "class", "common"),
        "ranked",
    )
    # from here to `edges` one row per source and bucket
    sums = ranked.groupBy("source", "bucket").agg(
        F.sum(F.col("size") * F.col("whole")).alias("certain"),
        F.sum("size").alias("words"),
        F.first("target").alias("target"),
    )
    whole_source = Window.partitionBy("source")
    upto = whole_source.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edges = (
        sums.withColumn("missing", F.col("target") - F.sum("certain").over(whole_source))
        .filter("bucket IS NOT NULL")
        .withColumn("gap", F.col("missing") - F.sum("words").over(upto) + F.col("words"))
        .select(
            F.col("source").alias("e_source"),
            F.col("bucket").alias("e_bucket"),
            "gap",
            (F.col("words") <= F.col("gap")).alias("extra"),
            ((F.col("gap") > 0) & (F.col("words") > F.col("gap"))).alias("edge"),
        )
    )
    same = F.col("source").eqNullSafe(F.col("e_source")) & (F.col("bucket") == F.col("e_bucket"))
    dealt = ranked.filter("bucket IS NOT NULL").join(edges, same).drop("e_source", "e_bucket")
    # the one bucket of each source in which its target falls
    edge = _fill(_fill(_fill(dealt.filter("edge"))))
    # one document more where that comes nearer to the target than the gap that is left
    miss = F.when(~F.col("extra"), F.abs(F.col("gap") - F.col("size")))
    nearest = whole_source.orderBy(miss.asc_nulls_last(), "v", "doc_id", "size", "row")
    edge = edge.withColumn("nth", F.row_number().over(nearest)).withColumn(
        "extra", F.col("extra") | ((F.col("nth") == 1) & (F.col("size") < 2 * F.col("gap")))
    )
    columns = ["doc_id", "source", "size", "source_size", "target", "whole", "extra", "row"]
    undrawn = ranked.filter("bucket IS NULL").withColumn("extra", F.lit(False))
    rows = undrawn.select(columns).unionByName(dealt.filter("NOT edge").select(columns)).unionByName(edge.select(columns))
    copies = F.col("whole") + F.col("extra").cast("int")
    return rows.select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The rows of the mix, a row as often as the mix takes it, all columns kept.

    Repeated rows of one doc_id, source and size share their number of copies evenly, so each may
    differ from the others by one copy.
    """
    taken = written(
        mix(docs, **settings)
        .groupBy("doc_id", "source", "size")
        .agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
        .filter("copies > 0"),
        "copies",
    )
    # the row as one value, whatever its columns are called
    rows = docs.select(
        F.col("doc_id").cast("long").alias("id"),
        F.col("source").cast("string").alias("from"),
        word_count(text_of("text")).alias("words"),
        F.struct("*").alias("doc"),
    )
    same = F.col("id").eqNullSafe(F.col("doc_id")) & F.col("from").eqNullSafe(F.col("source")) & (F.col("words") == F.col("size"))
    joined = rows.join(taken, same)
    nth = F.row_number().over(Window.partitionBy("id", "from", "words").orderBy("id"))
    upto = lambda n: F.floor(n * F.col("copies") / F.col("rows"))
    several = joined.filter("rows > 1").withColumn("nth", nth)
    several = several.withColumn("times", upto(F.col("nth")) - upto(F.col("nth") - 1)).drop("nth")
    once = joined.filter("rows = 1").withColumn("times", F.col("copies"))
    return (
        once.unionByName(several)
        .select("doc", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int"))))
        .select("doc.*")
    )
