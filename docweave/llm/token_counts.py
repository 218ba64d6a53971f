"""Token counts by a linear longest-match automaton.

The vocabulary's trie gets failure links, each with the number of tokens that following it pops: when a byte does not
go on from the node of the longest match so far, the greedy pieces of what was read are popped, only their number is
added, and the node for the rest is known beforehand. So each byte of a word is looked at a bounded number of times
on average, and no piece is built. Words are the blank-separated words of the whole text; the vocabulary must hold all 256
single bytes, so every word can be cut up.

Defined results: null and empty texts have no words and no tokens; an empty table gives no rows; repeated rows are counted each
for itself; very long texts and words are read whole; of all pieces that begin a word the longest is taken, so there are no ties; extra columns
are not read.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MEMO_LIMIT, blank_words, column, rows, slices

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())])


class Automaton:
    """next[node]: byte -> node; fail[node], pops[node]: where to go on, and how many pieces that emits."""

    def __init__(self, vocabulary):
        self.next: list[dict[int, int]] = [{}]
        ends, parents = {}, [(0, 0)]
        for token in vocabulary:
            node = 0
            for byte in token:
                to = self.next[node].get(byte)
                if to is None:
                    to = self.next[node][byte] = len(self.next)
                    self.next.append({})
                    parents.append((node, byte))
                node = to
            ends[node] = True
        missing = [b for b in range(256) if self.next[0].get(b) not in ends]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.fail, self.pops = [0] * len(self.next), [0] * len(self.next)
        queue = deque(self.next[0].values())
        while queue:
            node = queue.popleft()
            queue.extend(self.next[node].values())
            parent, byte = parents[node]
            if node in ends:
                self.fail[node], self.pops[node] = 0, 1  # what was read is one piece
            else:
                # The pieces popped at the parent, then the byte goes on from where that led.
                at, popped = self.fail[parent], self.pops[parent]
                while byte not in self.next[at]:
                    popped += self.pops[at]
                    at = self.fail[at]
                self.fail[node], self.pops[node] = self.next[at][byte], popped

    def count(self, word: bytes) -> int:
        """The number of pieces that greedy longest match cuts a word into."""
        node, n, follow, fail, pops = 0, 0, self.next, self.fail, self.pops
        for byte in word:
            while (to := follow[node].get(byte)) is None:
                n += pops[node]
                node = fail[node]
            node = to
        while node:
            n += pops[node]
            node = fail[node]
        return n


class Counts(dict):
    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO_LIMIT:
            self.clear()
        n = self.automaton.count(word)
        if len(word) < 64:
            self[word] = n
        return n


def count_tokens(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """(doc_id, n_words, n_tokens, n_bytes) of each whole text; n_bytes counts those in words."""
    sent = docs.sparkSession.sparkContext.broadcast(Automaton(vocabulary))  # one vocabulary: its size does not depend on the data

    def count(batches):
        counts = Counts(sent.value)
        for b in slices(batches):
            words = [blank_words(t) for t in column(b, "text")]
            yield rows(SCHEMA, [b.column(0), [len(w) for w in words], [sum(map(counts.__getitem__, w)) for w in words], [sum(map(len, w)) for w in words]])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "doc_id long, n_words long, n_tokens long, n_bytes long")
