"""Deduplication, shards, mixing, quality rules and Jaccard groups against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pytest
from messy_tables import documents, make_texts, messy  # noqa: F401
from pyspark.sql import functions as F

from repricer.llm import common, components, dedup, jaccard, mixing, quality, shards

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# exact deduplication


def test_dedup_decisions(documents, messy):
    groups = defaultdict(list)
    for doc_id, text, *_ in messy:
        groups[lower(text)].append(doc_id)
    rows = dedup.open_index(documents(messy).sparkSession).add(documents(messy)).collect()
    expected, kept = Counter(), Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            expected[i, hashlib.sha256(text.encode()).digest(), keep, len(ids)] += 1
    assert Counter((r["doc_id"], bytes(r["digest"]), r["keep_id"], r["group_size"]) for r in rows) == expected
    for r in rows:
        kept[bytes(r["digest"])] += r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert set(kept.values()) == {1} and len(kept) == len(groups)


def test_index_persists_and_knows_old_texts(spark, documents, tmp_path):
    first = dedup.DigestIndex(spark, str(tmp_path / "index"), 4)
    assert first.add(documents([(1, "a"), (2, "A"), (3, "b")])).filter("kept").count() == 2
    again = dedup.DigestIndex(spark, str(tmp_path / "index"), 4)
    rows = {r["doc_id"]: r for r in again.add(documents([(9, "B"), (8, "c"), (7, "c")])).collect()}
    assert not rows[9]["kept"] and rows[9]["keep_id"] == 3
    assert rows[8]["kept"] and not rows[7]["kept"]
    assert again.table().count() == 3
    assert again.add(documents([(9, "B"), (8, "c")])).filter("kept").count() == 0
    assert again.add(documents([])).count() == 0 and again.table().count() == 3


def test_anti_join_reads_the_index_without_a_shuffle(spark, documents, tmp_path):
    index = dedup.DigestIndex(spark, str(tmp_path / "index"), 4)
    index.add(documents([(1, "a")]))
    groups = documents([(2, "b")]).groupBy(dedup.digest("text").alias("digest")).count()
    plan = groups.hint("merge").join(index.table().select("digest"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1


def test_a_hot_text_is_summed_before_it_meets_the_index(documents, monkeypatch):
    plans, real = {}, dedup.written

    def recorded(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return real(df, name)

    monkeypatch.setattr(dedup, "written", recorded)
    rows = documents([(i, "same") for i in range(50)] + [(99, "other")])
    assert {(r["doc_id"], r["group_size"]) for r in dedup.open_index(rows.sparkSession).add(rows).filter("kept").collect()} == {(49, 50), (99, 1)}
    # rows are shuffled by text and part, after a partial sum; the anti-join reads one row per text
    below = plans["parts"].split("Exchange hashpartitioning(digest", 1)[1]
    assert "salt" in below.split("\n")[0] and "partial_max" in below
    assert "Aggregate" not in plans["fresh"] and "salt" not in plans["fresh"] and "LeftAnti" in plans["fresh"]


def test_a_cluster_without_a_shared_folder_is_refused(spark):
    class Conf(dict):
        def get(self, name, default):
            return super().get(name, default)

    def session(master, **conf):
        return SimpleNamespace(conf=Conf({k.replace("_", "."): v for k, v in conf.items()}), sparkContext=SimpleNamespace(master=master))

    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]", "k8s://https://host"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_dir(session(master))
        assert common.shared_dir(session(master, spark_checkpoint_dir="file:///shared")) == "file:///shared"
    assert common.shared_dir(session("local[8]")) == common.shared_dir(session("local"))


def test_distinct_documents_keep_their_columns(documents, messy):
    docs = documents(messy)
    out = dedup.distinct_documents(docs)
    assert out.columns == docs.columns
    assert Counter(lower(r["text"]) for r in out.collect()) == Counter({lower(t) for _, t, *_ in messy})


# shards


def test_shards_are_contiguous_and_even(documents, messy):
    rows = shards.byte_shards(documents(messy), 5).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in messy
    )
    total, largest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    for shard, own in by.items():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 5) <= largest
    ids = [r["doc_id"] for s in sorted(by) for r in sorted(by[s], key=lambda r: r["slot"])]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert shards.byte_shards(documents([]), 5).count() == 0


# mixing


def targets(sizes, weights=(1, 2, 3), limit=3):
    """By the rule as worded: share, stop at the limit, share the excess anew."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed: dict = {}
    while True:
        free = [s for s in names if s not in fixed]
        rest = sum(sizes.values()) - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        above = [s for s in free if share[s] > limit * sizes[s]]
        if not above:
            return fixed | share
        fixed |= {s: limit * sizes[s] for s in above}


def test_targets(spark):
    draw = random.Random(3)
    for _ in range(6):
        sizes = {s: draw.choice([0, 1, 10, 500, 9000]) + draw.randint(0, 9) for s in ["a", "b", "é", "Z", "", None][: draw.randint(1, 6)]}
        rows = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()
        expected = targets(sizes)
        assert {r["source"]: pytest.approx(r["target"]) for r in rows} == expected


def test_mix(documents, messy):
    rows = mixing.mix(documents(messy)).collect()
    size = lambda t: len(WORD.findall(t or ""))
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in rows) == Counter((i, s, size(t)) for i, t, _, s in messy)
    per = defaultdict(int)
    for _, t, _, s in messy:
        per[s] += size(t)
    expected, taken = targets(per), defaultdict(int)
    for r in rows:
        assert r["target"] == pytest.approx(expected[r["source"]]) and r["source_size"] == per[r["source"]]
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["taken"]
    for source, target in expected.items():
        least = min(s for _, t, _, x in messy if x == source and (s := size(t)))
        assert abs(taken[source] - target) <= max(least, 0.01 * target) or source in ("a", "b")  # the long text is there
    assert Counter(map(tuple, rows)) == Counter(map(tuple, mixing.mix(documents(messy)).collect()))
    assert mixing.mix(documents([])).count() == 0
    assert mixing.mix(documents([(1, None, None, None), (2, "", None, "a")])).agg(F.sum("taken")).first()[0] == 0


def water_filled(rows, target, limit):
    """The copies due to (weight, size) by weight, `limit` at most, so that their words are the target."""
    capped: set = set()
    while True:
        free = sum(w * size for w, size in rows if w not in capped)
        level = (target - limit * sum(size for w, size in rows if w in capped)) / free if free else 0
        above = {w for w, size in rows if w not in capped and level * w > limit * (1 + 1e-12)}
        if not above:
            return {w: limit if w in capped else level * w for w, _ in rows}
        capped.add(max(above))


@pytest.mark.parametrize("doc_weight, buckets", [(None, 2000), (None, 7), (lambda: F.when(F.col("doc_id") % 3 == 0, 4.0).otherwise(1.0), 9)])
def test_mix_takes_documents_in_the_order_of_pareto_ranks(documents, monkeypatch, doc_weight, buckets):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", buckets)
    draw = random.Random(8)
    rows = [(i, "w " * draw.choice([3, 10, 40, 90, 400]), "en", draw.choice("aaabbccccccd")) for i in range(400)] + [(900, None, None, "a"), (901, " ", None, "d")]
    docs = documents(rows)
    size = {i: len((t or "").split()) for i, t, *_ in rows}
    u = {r[0]: r[1] for r in docs.select("doc_id", mixing.unit("doc_id", mixing.word_count(mixing.text_of("text")), seed=mixing.SEED)).collect()}
    plain = lambda i: (4.0 if i % 3 == 0 else 1.0) if doc_weight else 1 / math.sqrt(1 + math.log2(max(1, size[i])) * 1.5)
    weight = {i: 2.0 ** (round(math.log2(plain(i)) * 4) / 4) for i, *_ in rows}
    found = {r["doc_id"]: r["copies"] for r in mixing.mix(docs, doc_weight=doc_weight and doc_weight()).collect()}
    per = defaultdict(int)
    for i, _, _, s in rows:
        per[s] += size[i]
    expected = {}
    for source, target in targets(per).items():
        own = [i for i, _, _, s in rows if s == source]
        due = water_filled([(weight[i], size[i]) for i in own if size[i]], target, 3)
        copies = {i: math.floor(due[weight[i]]) if size[i] else 0 for i in own}
        left = {i: due[weight[i]] - copies[i] for i in own if size[i]}
        ranks = sorted((u[i] / (1 - u[i]) / (p / (1 - p)), i) for i, p in left.items() if p > 0)
        gap = target - sum(copies[i] * size[i] for i in own)
        taken = [i for _, i in ranks if copies[i] + 1 == found[i]]
        # all that rank before the first one that does not fit are taken, and of the others only such as still fit or come nearest
        fits = 0
        for _, i in ranks:
            if fits + size[i] > gap:
                break
            fits += size[i]
            assert i in taken
        assert not [(i, size[i], found[i], copies[i]) for i in own if found[i] - copies[i] not in (0, 1) or found[i] > copies[i] and i not in left]
        expected[source] = abs(target - sum(found[i] * size[i] for i in own))
        assert expected[source] <= 0.02 * target + (3 if buckets == 2000 else 200)  # small buckets leave few documents to fill the gap with
        later = [i for i in taken if i not in {j for _, j in ranks[: len(taken)]}]
        assert len(later) <= 0.1 * len(ranks) + 3
    # a document's chance falls with its length, or rises with its weight
    light = [i for i, _, _, s in rows if s == "c" and (size[i] == 400 if doc_weight is None else i % 3)]
    heavy = [i for i, _, _, s in rows if s == "c" and (size[i] == 3 if doc_weight is None else i % 3 == 0)]
    mean = lambda ids: sum(found[i] for i in ids) / len(ids)
    assert mean(heavy) > 1.2 * mean(light)


def test_mix_follows_document_weights(documents):
    rows = [(i, "w " * 10, "en", "a" if i < 900 else "b") for i in range(1000)]
    weight = F.when(F.col("doc_id") % 2 == 0, 3.0).otherwise(1.0)
    taken = mixing.mix(documents(rows), weights=(1.0, 9.0), doc_weight=weight).filter("source = 'a'")
    heavy, light = (taken.filter(f"doc_id % 2 = {k}").agg(F.sum("taken")).first()[0] for k in (0, 1))
    assert 2.4 < heavy / light < 3.6


def test_mixed_documents_repeat_rows(documents, messy):
    docs = documents(messy)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    copies = mixing.mix(docs).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("n")).filter("n > 0").collect()
    found = Counter((r["doc_id"], r["source"], len(WORD.findall(r["text"] or ""))) for r in out.collect())
    assert found == Counter({(r["doc_id"], r["source"], r["size"]): r["n"] for r in copies})


# quality rules


def base(text):
    words, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    found, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if found[w] > 1:
            covered.update(range(i, i + 8))
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_counts(documents, messy):
    rows = messy + [(i, t) for i, t in enumerate(["a b c d e f g h " * 3, "a\n a\na\n\n\na", "x y " * 30, "p q r s t u v w x p q r s t u v w x y", "|##<>&%$* z"], 2000)]
    found = quality.signals(documents(rows), ["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert Counter(map(tuple, found.collect())) == Counter((r[0], *base(r[1])) for r in rows)


def test_binomial_tail(spark):
    for n, k, p in [(10, 0, 0.1), (10, 3, 0.1), (500, 2, 0.005), (20_000, 70, 0.005), (400_000, 1900, 0.005)]:
        exact = math.fsum(
            math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1)
        )
        row = spark.range(1).select(quality.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p).alias("p")).first()
        assert row["p"] == pytest.approx(exact, rel=1e-6)


def test_rules_reject_only_what_the_labels_allow(spark, documents):
    clean = [(i, " ".join(f"w{(i * 7 + k * k) % 900}" for k in range(40)), "en") for i in range(3000)]
    junk = [(10_000 + i, " ".join(f"w{k}###" for k in range(40)), "en") for i in range(50)]
    few = [(20_000 + i, " ".join(f"w{k}###" for k in range(40)), "de") for i in range(50)]
    labels = spark.createDataFrame([(i, 1) for i in range(3000)] + [(10_000, 0), (5, 0), (None, 1), (77, None)], "doc_id long, quality int")
    kept = {r["doc_id"]: r["kept"] for r in quality.judged(documents(clean + junk + few), labels).collect()}
    assert all(kept[i] for i, *_ in clean) and not any(kept[i] for i, *_ in junk)
    assert all(kept[i] for i, *_ in few)  # a stratum without labels has no rule
    nobody = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.judged(documents(junk), nobody).filter("kept").count() == 50
    assert quality.judged(documents([]), nobody).count() == 0


def test_the_rules_of_a_stratum_together_reject_no_more_than_the_risk(spark):
    """Signals that are high in different documents: each rule alone could reject a share that adds up to more."""
    draw = F.rand(seed=4)
    grids = {s: (grid[0], grid[-1]) for s, grid in quality.CUTOFFS.items()}
    drawn = spark.range(60_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("string").alias("stratum"), draw.alias("u"))
    share = 0.0025  # of each signal, in documents of its own
    signalled = drawn.withColumns(
        {s: F.when((F.col("u") >= k * share) & (F.col("u") < (k + 1) * share), high + 1.0).otherwise(low / 2) for k, (s, (low, high)) in enumerate(grids.items())}
    )
    labels = signalled.select("doc_id", F.lit(1).alias("quality"))
    for risk in (0.025, 0.01):
        rules = {(r["stratum"], r["signal"]): r["cutoff"] for r in quality.cutoffs(signalled, labels, risk=risk).collect()}
        for stratum in ("0", "1"):
            own = [F.col(s) > c for (of, s), c in rules.items() if of == stratum]
            rejected = signalled.filter(F.col("stratum") == stratum).filter(F.array_contains(F.array(F.lit(False), *own), True)).count()
            assert rejected <= risk * 30_000
        assert len(rules) == (10 if risk == 0.025 else 0)


def test_cutoffs_use_every_label(spark):
    n, above = 400_000, 1800
    value = F.when(F.col("doc_id") % (n // above) == 0, 1.0).otherwise(0.0)
    signalled = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("en").alias("stratum")).withColumns(
        {s: value if s == "symbol_share" else F.lit(0.0) for s in quality.CUTOFFS}
    )
    labels = signalled.select("doc_id", F.lit(1).alias("quality"))
    found = {r["signal"]: r["cutoff"] for r in quality.cutoffs(signalled, labels).collect()}
    assert found == {s: grid[0] for s, grid in quality.CUTOFFS.items()}


# Jaccard groups


def groups_of(rows, size, percent):
    sets = [jaccard.shingles([w.encode() for w in WORD.findall(lower(t))], size) for _, t, *_ in rows]
    lead = list(range(len(rows)))

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                lead[find(a)] = find(b)
    least = {}
    for a, row in enumerate(rows):
        ids = [x for x in (least.get(find(a)), row[0]) if x is not None]
        least[find(a)] = min(ids) if ids else None
    return Counter((row[0], len(sets[a]), least[find(a)]) for a, row in enumerate(rows))


@pytest.mark.parametrize("size, percent, seed", [(4, 85, 1), (5, 80, 2), (2, 60, 3)])
def test_linked_documents(documents, messy, size, percent, seed):
    rows = [(i + 5000, t) for i, t in enumerate(make_texts(seed, 150))] + messy
    found = jaccard.linked_documents(documents(rows), jaccard.Similarity(size, percent)).select("doc_id", "n_shingles", "component_id")
    assert Counter(map(tuple, found.collect())) == groups_of(rows, size, percent)


def test_common_shingles_dealt_over_tasks(documents, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT", 5)
    rows = [(i, t) for i, t in enumerate(make_texts(11, 40))]
    core = [f"c{k}" for k in range(60)]
    draw = random.Random(5)
    for i in range(120):
        own = list(core)
        for _ in range(draw.randint(1, 3)):
            own[draw.randrange(60)] = f"e{draw.randrange(10_000)}"
        rows.append((1000 + i, " ".join(own)))
    found = jaccard.linked_documents(documents(rows), jaccard.Similarity(4, 85)).select("doc_id", "n_shingles", "component_id")
    assert Counter(map(tuple, found.collect())) == groups_of(rows, 4, 85)


def compared(monkeypatch):
    """Counts the pairs that are compared, and how often each is."""
    seen, verified = Counter(), jaccard._verified

    def counting(pairs, texts, similarity):
        seen.update(frozenset((bytes(r["a"]), bytes(r["b"]))) for r in pairs.select("a", "b").collect())
        return verified(pairs, texts, similarity)

    monkeypatch.setattr(jaccard, "_verified", counting)
    return seen


def test_a_large_group_that_shares_shingles_too_late_to_link_forms_no_pairs(documents, monkeypatch):
    seen = compared(monkeypatch)
    # one own word amid forty common ones: 31 of 41 shingles are shared, and the common ones come last in the prefixes
    rows = [(i, " ".join([*(f"c{k}" for k in range(20)), f"own{i}", *(f"c{k}" for k in range(20, 39))])) for i in range(3000)]
    rows += [(9000, rows[0][1] + " more"), (9001, rows[7][1].upper())]
    found = {r["doc_id"]: r["component_id"] for r in jaccard.linked_documents(documents(rows)).collect()}
    assert found == {i: i for i in range(3000)} | {9000: 0, 9001: 7}
    assert len(seen) < 100


def test_near_copies_of_a_large_group_meet_few_of_each_other_and_each_pair_once(documents, monkeypatch):
    seen = compared(monkeypatch)
    rows = [(i, " ".join([*(f"c{k}" for k in range(120)), f"own{i}"])) for i in range(1500)]
    rows += [(5000 + i, " ".join([*(f"c{k}" for k in range(90)), *(f"own{i}-{k}" for k in range(20))])) for i in range(20)]
    found = jaccard.linked_documents(documents(rows)).collect()
    assert {r["component_id"] for r in found if r["doc_id"] < 5000} == {0}
    assert set(seen.values()) == {1} and len(seen) < 8 * len(rows)


def test_every_pair_meets_a_pair_once_at_its_first_shared_shingle(documents):
    spark = documents([]).sparkSession
    similarity = jaccard.Similarity(4, 85)
    # two nodes of 40 shingles share the first ten of their prefixes; the positional filter lets the first four through
    left = spark.createDataFrame(
        [(s, node, 40, s, node, node == b"y") for s in range(10) for node in (b"x", b"y")],
        "shingle long, node binary, n long, at long, component binary, minor boolean",
    )
    classes = spark.createDataFrame([(s, 40, 40) for s in range(10)], "shingle long, n long, m long")
    met = jaccard._meetings(left, classes, similarity).collect()
    assert [(bytes(r["a"]), bytes(r["b"])) for r in met] == [(b"x", b"y")]
    assert jaccard._every_pair(left, classes, similarity).count() == 1


@pytest.mark.parametrize("seed", range(4))
def test_last_places(seed):
    draw = np.random.default_rng(seed)
    group, n, at = draw.integers(0, 12, 120), draw.integers(8, 30, 120), draw.integers(0, 9, 120)
    similarity = jaccard.Similarity(5, 80)
    last = jaccard._last_places(similarity, group, n, at)
    for i in range(120):
        fits = [
            group[j] == group[i] and 100 * min(n[i], n[j]) >= 80 * max(n[i], n[j])
            and min(n[i] - at[i], n[j] - at[j]) >= -(-80 * (n[i] + n[j]) // 180)
            for j in range(120) if j != i
        ]
        assert (at[i] <= last[i]) == any(fits)


def test_one_of_each_group(documents, messy):
    docs = documents([r for r in messy if r[0] is not None])
    out = jaccard.one_of_each_group(docs)
    linked = jaccard.linked_documents(docs).filter("doc_id = component_id").select("doc_id").distinct()
    assert out.columns == docs.columns
    assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in linked.collect()}
    assert jaccard.one_of_each_group(documents([])).count() == 0


def test_one_row_of_each_group(documents):
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    c = [" ".join(f"c{k}" for k in range(60)) + f" end{i}" for i in range(4)]
    rows = [(3, a + " x"), (5, a), (5, b), (5, b), (5, b.upper())] + [(None, t) for t in c] + [(None, c[0])]
    rows += [(7, " "), (7, " "), (7, ""), (8, None), (9, c[1].replace("c", "d")), (None, c[2].replace("c", "d"))]
    kept = Counter((r["doc_id"], r["text"]) for r in jaccard.one_of_each_group(documents(rows)).collect())
    null = [t for i, t in kept if i is None]
    assert len(null) == 1 and null[0] in c and kept.pop((None, null[0])) == 1
    assert kept.pop((5, b), 0) + kept.pop((5, b.upper()), 0) == 1
    assert kept == Counter([(3, a + " x"), (7, " "), (7, ""), (8, None), (9, c[1].replace("c", "d"))])


def test_components(spark):
    draw = random.Random(2)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(3, 3)]
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    lead = {n: n for a, b in edges if a != b for n in (a, b)}

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for a, b in edges:
        if a != b:
            low, high = sorted((find(a), find(b)))
            lead[high] = low
    assert found == {n: find(n) for n in lead}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
