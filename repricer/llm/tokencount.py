"""Greedy longest-match token counts by one pass of an automaton over the bytes of each word.

The vocabulary is a trie. When the bytes read leave it, a failure link leads to the state that
greedy matching would be in after it cut off its longest matches, and a number says how many tokens
were cut off. Links and numbers are worked out once per vocabulary, so a word of n bytes takes at most
2 n steps, no token is built and nothing is read twice.

A word's first token comes from the tokens that start with a space (they open a word), the others
from those that do not. A vocabulary that lacks a byte counts the byte as one token.

Null texts and texts without words count 0. Texts are read whole. Repeated rows are counted each by itself.
An empty table gives no rows. Only the columns doc_id and text are read.
"""

from __future__ import annotations

import base64
import functools
from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k"
_REMEMBERED = 300_000


class GreedyCounter:
    """Counts the tokens of words; `tokens` are byte strings, those that open a word with a space in front.

    A state is a node of the trie. `step` holds the trie's edges by state * 256 + byte. `fail` and
    `cut` hold for a state, once no edge fits: where to go on, and the tokens cut off on the way there.
    A state whose bytes start no token has fail -1.
    """

    def __init__(self, tokens: Iterable[bytes]):
        step: dict[int, int] = {}
        ends = [False, False]
        parents: list[tuple[int, int]] = [(-1, -1), (-1, -1)]
        # state 0 is the root of tokens inside a word, state 1 of those that open one
        for token in tokens:
            state, own = (1, token[1:]) if token[:1] == b" " else (0, token)
            if not own:
                continue
            for byte in own:
                key = state << 8 | byte
                if key not in step:
                    step[key] = len(ends)
                    ends.append(False)
                    parents.append((state, byte))
                state = step[key]
            ends[state] = True
        self.step = step
        self.fail = fail = [-1] * len(ends)
        self.cut = cut = [0] * len(ends)
        children: dict[int, list[int]] = {}
        for key, child in step.items():
            children.setdefault(key >> 8, []).append(child)
        fail[1] = 0  # what no token opens is read as inside the word
        # breadth first: the links of shorter states are known
        queue = deque([0, 1])
        while queue:
            state = queue.popleft()
            queue.extend(children.get(state, ()))
            if state < 2:
                continue
            parent, byte = parents[state]
            if ends[state]:
                fail[state], cut[state] = 0, 1
                continue
            # as if the parent had been left for this byte
            at, n = fail[parent], cut[parent]
            while at >= 0 and (at << 8 | byte) not in step:
                n, at = n + cut[at], fail[at]
            if at >= 0:
                fail[state], cut[state] = step[at << 8 | byte], n

    def count(self, word: bytes) -> int:
        """Number of tokens of a word."""
        step, fail, cut = self.step, self.fail, self.cut
        n, state, i, start = 0, 1, 0, 0
        length = len(word)
        while True:
            if i < length:
                after = step.get(state << 8 | word[i])
                if after is not None:
                    state = after
                    i += 1
                    continue
            elif state < 2:
                return n
            if fail[state] >= 0:
                n += cut[state]
                state = fail[state]
            elif state == 0:
                n, i = n + 1, i + 1  # the vocabulary lacks the byte
            else:
                return n + self._slow(word, i, state)

    def _slow(self, word: bytes, i: int, state: int) -> int:
        """The rest of a word after bytes that start no token (vocabularies without single bytes)."""
        depth = 0
        seen = state
        while seen > 1:
            seen, depth = self._parent(seen), depth + 1
        opened, at, n = seen == 1, i - depth, 0
        while at < len(word):
            best, state, j = 0, 1 if opened else 0, at
            while j < len(word) and (state << 8 | word[j]) in self.step:
                state = self.step[state << 8 | word[j]]
                j += 1
                if self.cut[state] == 1 and self.fail[state] == 0:
                    best = j
            if not best and opened:
                opened = False
                continue
            at, n, opened = best or at + 1, n + 1, False
        return n

    @functools.cached_property
    def _parents(self) -> dict[int, int]:
        return {child: key >> 8 for key, child in self.step.items()}

    def _parent(self, state: int) -> int:
        return self._parents[state]


def greedy_count(tokens: set[bytes], word: bytes) -> int:
    """The same count by matching: the plain form that tests hold the automaton against."""
    n, at, opened = 0, 0, True
    while at < len(word):
        mark = b" " if opened else b""
        end = next((e for e in range(len(word), at, -1) if mark + word[at:e] in tokens), None)
        if end is None and opened:
            opened = False
            continue
        n, at, opened = n + 1, end or at + 1, False
    return n


@functools.cache
def _counter(vocabulary: str) -> GreedyCounter:
    import public_tokenizers

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as file:
        return GreedyCounter(base64.b64decode(line.split()[0]) for line in file)


def counted(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Columns doc_id, n_words and n_tokens, a row per document."""

    @F.pandas_udf("n_words long, n_tokens long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counter, known = _counter(vocabulary), {}
        for texts in batches:
            rows = []
            for text in texts:
                words, n = (text or "").encode().split(), 0
                for word in words:
                    tokens = known.get(word)
                    if tokens is None:
                        tokens = counter.count(word)
                        if len(word) <= 40:
                            if len(known) >= _REMEMBERED:
                                known.clear()
                            known[word] = tokens
                    n += tokens
                rows.append((len(words), n))
            yield pd.DataFrame(rows, columns=["n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), count("text").alias("_c")).select("doc_id", "_c.n_words", "_c.n_tokens")
