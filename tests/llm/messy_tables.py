"""Documents with everything that tables may hold: nulls, empty and long texts, ties, repeated rows, clashing names."""

import os
import random

import pytest

DDL = "doc_id long, text string, lang string, source string, n_chars long, doc string, size long, node string, row long"


def make_texts(seed: int, n: int) -> list[str]:
    """Invented texts with copies, near copies, shared passages and odd white space."""
    draw = random.Random(seed)
    words = ["".join(draw.choice("abdeilnorst") for _ in range(draw.randint(2, 7))) for _ in range(300)]
    texts: list[str] = []
    passage = " ".join(draw.choice(words) for _ in range(12))
    for i in range(n):
        kind = draw.random()
        if texts and kind < 0.15:
            text = draw.choice(texts)
        elif texts and kind < 0.5:
            own = draw.choice(texts).split(" ")
            for _ in range(draw.randint(0, 3)):
                own[draw.randrange(len(own))] = draw.choice(words)
            text = " ".join(own)
        else:
            text = " ".join(draw.choice(words) for _ in range(draw.randint(1, 80)))
            if kind > 0.85:
                text += f"\n{passage}"
        if draw.random() < 0.05:
            text = text.upper()
        texts.append(text)
    return texts


@pytest.fixture(scope="session")
def documents(spark):
    def make(rows):
        """Rows of (doc_id, text[, lang[, source]])."""
        full = [(*row, *[None] * (4 - len(row)), None, "x", 7, "y", 9) for row in rows]
        return spark.createDataFrame(full, DDL)

    return make


@pytest.fixture(scope="session")
def messy():
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b", None, "é"][i % 4]) for i, t in enumerate(make_texts(7, 160))]
    rows += [(None, "no id at all", "en", "a"), (None, "no id at all", "en", "a"), (None, None, None, None)]
    rows += [(900, None, "en", "a"), (901, "", None, "b"), (902, " \t\n\x0b\x0c\r ", "de", None), (903, "  !?", "en", "a")]
    rows += [(904, long, "en", "a"), (905, long, "en", "b"), (906, "one two", None, "a"), (906, "one two", None, "a")]
    rows += [(907, "Straße ÄRGER \U0001f600 <|endoftext|> x", "de", "b"), (907, "another text of that id", "de", "b")]
    return rows


SAMPLE = os.environ.get("SAMPLE_DIR", "/root/testdata/sf0.001")
