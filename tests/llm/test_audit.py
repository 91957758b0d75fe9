"""The filter interaction audit against brute force."""

import itertools
import re
from collections import Counter

import numpy as np
from messy_tables import documents, messy  # noqa: F401

from repricer.llm import audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def audited(rows, labels):
    """Every order applied filter by filter to every document."""
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good, toxic = ({i for i, q, x in labels if (q, x)[k] == 1} for k in (0, 1))
    docs = []
    for i, t, lang, *_ in rows:
        text, words = t or "", WORD.findall(t or "")
        failed = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": re.search(r"[#$%&*|]", text) is not None,
            "E": i is not None and i > first[text],
        }
        docs.append((lang or "", {x for x, is_failed in failed.items() if is_failed}, i is not None and i in good, i is not None and i in toxic))
    found, credit = {}, Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        for part in {p for p, *_ in docs}:
            left = [d for d in docs if d[0] == part]
            for step, x in enumerate(order, 1):
                failing = [d for d in docs if d[0] == part and x in d[1]]
                removed = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                credit[part, x] += len(removed)
                found[part, order, step] = (
                    len(left), len(removed), len(failing) - len(removed), sum(d[1] == {x} for d in failing), sum(d[2] for d in removed), sum(d[3] for d in removed),
                )
    return {k: (*v, credit[k[0], k[1][k[2] - 1]]) for k, v in found.items()}


def rows_of(df):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = df.collect()
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in rows}
    assert len(found) == len(rows)
    return found


def extra():
    long = " ".join(f"w{i}" for i in range(150))
    rows = [(3000, long, "en"), (3001, long, "en"), (3000, long, "en"), (3002, long, None), (None, long, "en"), (3003, long + " #", ""), (3004, long.upper(), "de")]
    rows += [(3005, "x y " * 80, "en"), (3006, "É Ü x A\x1cB " * 40, "fr"), (3007, "A" * 10 + "b" * 90, "fr"), (3008, "A" * 10 + "b" * 89, "fr")]
    return rows + [(4000 + i, long + "|", ["en", "de"][i % 2]) for i in range(100)]  # copies


def test_audit(spark, documents, messy, monkeypatch):
    monkeypatch.setattr(audit, "SHARD_BYTES", 2000)
    monkeypatch.setattr(audit, "PACKED_WORDS", 300)
    rows = messy + extra()
    labels = [(i, i % 3 % 2, int(i % 5 == 0)) for i in range(0, 200, 2)] + [(3000, 1, 0), (3000, 0, 1), (3001, 1, 1), (4007, 1, None), (None, 1, 1), (906, 1, 1)]
    table = spark.createDataFrame([(*x, "clash") for x in labels], "doc_id long, quality int, toxic int, text string")
    assert rows_of(audit.audited(documents(rows), table)) == audited(rows, labels)


def test_audit_of_little(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert rows_of(audit.audited(documents([]), none)) == {}
    rows = [(None, None, None), (1, "", "en"), (2, None, "en")]
    assert rows_of(audit.audited(documents(rows), none)) == audited(rows, [])


def test_matrix_is_the_texts(documents, messy, monkeypatch):
    monkeypatch.setattr(audit, "SHARD_BYTES", 5000)
    matrix, dictionary = audit.document_term_matrix(documents(messy))
    word = {r["id"]: r["word"] for r in dictionary.collect()}
    assert sorted(word) == list(range(len(word)))
    found = Counter()
    for shard in matrix.collect():
        starts, ids, counts = np.frombuffer(shard["starts"], "<i4"), np.frombuffer(shard["ids"], "<i8"), np.frombuffer(shard["counts"], "<i4")
        for k, doc in enumerate(shard["docs"]):
            own = slice(starts[k], starts[k + 1])
            found[doc["doc_id"], frozenset(zip((word[i] for i in ids[own]), counts[own].tolist()))] += 1
    assert found == Counter((i, frozenset(Counter(WORD.findall(t or "")).items())) for i, t, *_ in messy)
