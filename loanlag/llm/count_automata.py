"""Weighted acyclic automata that count phrases.

An automaton is built from sorted phrases and their counts, word by word: a
state is a prefix, and its weight is the sum of the counts of the range of
phrases that begin with it.  Automata of several shards are united by adding
up equal phrases.  Words are numbers here, in the order of their bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Stands where a phrase has ended.
NO_WORD = -1


def numbered(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Numbers of the words, ascending with their bytes, and the word of each number."""
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary.cast(pa.large_binary()))
    rank = np.empty(len(order), dtype=np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    return rank[coded.indices.to_numpy(zero_copy_only=False)], coded.dictionary.take(order)


def rows_of(phrases: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """One row a phrase: its words, split at blanks, as numbers, NO_WORD after the last; and the word of each number."""
    split = pc.split_pattern(phrases, " ")
    n = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    numbers, words = numbered(split.flatten())
    out = np.full((len(phrases), int(n.max(initial=1))), NO_WORD, dtype=np.int64)
    row = np.repeat(np.arange(len(phrases)), n)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = numbers
    return out, words


def packed(rows: np.ndarray) -> list[np.ndarray]:
    """Few integers a row that are in the rows' order and tell them apart, the first the most significant."""
    keys: list[np.ndarray] = []
    free = 0
    for column in rows.T:
        bits = int(column.max(initial=0) + 1).bit_length()
        if bits > free:
            keys.append(np.zeros(len(rows), dtype=np.int64))
            free = 62
        keys[-1] = keys[-1] << bits | (column + 1)
        free -= bits
    return keys


class CountAutomaton:
    """States level by level: ``starts[k]`` is where the ranges of the states of k+1 words begin, ``weights[k]`` their sums.

    ``rows`` are different phrases in order, ``counts`` their own weights.
    """

    def __init__(self, rows: np.ndarray, counts: np.ndarray):
        self.rows, self.counts = rows, counts
        self.starts: list[np.ndarray] = []
        self.weights: list[np.ndarray] = []
        changed = np.zeros(len(rows), dtype=bool)
        changed[:1] = True
        upto = np.concatenate([[0], np.cumsum(counts)])
        for level in range(rows.shape[1]):
            # The arcs of a level begin new states where a word or a state before it changes.
            changed[1:] |= rows[1:, level] != rows[:-1, level]
            begin = np.flatnonzero(changed)
            weight = np.diff(upto[np.append(begin, len(rows))])
            goes_on = rows[begin, level] != NO_WORD
            self.starts.append(begin[goes_on])
            self.weights.append(weight[goes_on])

    @classmethod
    def united(cls, rows: np.ndarray, counts: np.ndarray) -> CountAutomaton:
        """The automaton of phrases in any order; the counts of equal ones are added up."""
        keys = packed(rows)
        order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
        new = np.zeros(len(rows), dtype=bool)
        new[:1] = True
        for key in keys:
            ordered = key[order]
            new[1:] |= ordered[1:] != ordered[:-1]
        begin = np.flatnonzero(new)
        return cls(rows[order[begin]], np.add.reduceat(counts[order], begin) if len(begin) else counts)

    def prefixes(self, length: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """The states of ``length`` words that weigh ``least`` or more: their words and weights."""
        kept = self.weights[length - 1] >= least
        return self.rows[self.starts[length - 1][kept], :length], self.weights[length - 1][kept]

    def compose(self, parts: np.ndarray) -> np.ndarray:
        """The own weights of ``parts`` (one row each, numbered alike), 0 where the automaton has no such phrase.

        A part's state is the range of phrases that begin with its words so
        far; each further word leads to a range within it.
        """
        n = len(self.rows)
        low, high = np.zeros(len(parts), dtype=np.int64), np.full(len(parts), n, dtype=np.int64)
        state = np.zeros(n, dtype=np.int64)
        for level in range(max(self.rows.shape[1], parts.shape[1])):
            has, wants = (x[:, level] if level < x.shape[1] else np.full(len(x), NO_WORD) for x in (self.rows, parts))
            span = max(has.max(initial=0), wants.max(initial=0)) + 2
            arcs = state * span + has + 1
            alive = low < high
            arc = np.where(alive, state[np.where(alive, low, 0)] * span + wants + 1, -1) if n else np.full(len(parts), -1)
            low, high = np.searchsorted(arcs, arc, side="left"), np.searchsorted(arcs, arc, side="right")
            state = np.cumsum(np.concatenate([[0], arcs[1:] != arcs[:-1]]))[:n]
        found = low < high
        return np.where(found, self.counts[np.where(found, low, 0)], 0) if n else np.zeros(len(parts), dtype=np.int64)
