"""Periodic runs of words, found with a suffix automaton and link-cut access.

The words of a text are appended to a suffix automaton one by one. In its tree of suffix links
every root path holds the suffixes of one prefix, and each node remembers where its strings
ended last. Appending a word accesses the path of the new prefix: the path falls into segments
of equal last end, and all of it takes the new end. A segment that ended ``d`` words earlier and
whose longest string has at least ``d`` words is a square of period ``d``; it is extended
to the run it lies in. Paths are kept as splay trees, so all accesses together change
O(n log n) segments.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from larderline.llm import words as W

GRAM = 3
# Rounds of narrowing; fewer rounds leave more words to the automaton and lose nothing.
ROUNDS = 16


def numbered(words: list[bytes]) -> np.ndarray:
    """Words as numbers in order of first appearance."""
    known = dict.fromkeys(words)
    for i, word in enumerate(known):
        known[word] = i
    return np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))


def gram_ids(ids: np.ndarray) -> np.ndarray:
    """One number for each three words in a row, equal for equal words and no others."""
    if len(ids) < GRAM:
        return np.zeros(0, dtype=np.int64)
    width = int(ids.max()) + 1
    pair = ids[:-1] * width + ids[1:]
    if width > 2_000_000:
        pair = np.unique(pair, return_inverse=True)[1]
        return np.unique(pair[:-1], return_inverse=True)[1] * width + ids[2:]
    return pair[:-1] * width + ids[2:]


def stretches(ids: np.ndarray, exponent: int) -> list[tuple[int, int]]:
    """Word ranges outside of which no run of that exponent can have a word.

    In a run of period q and at least ``exponent * q`` words, every three words that start q or
    more words after its first have stood at most q words before. These are at least
    (exponent - 1) * q - 2 places in a row, so in a row of m such places q is at most
    (m + 2) / (exponent - 1), and places repeated from farther away end the row. The range of a
    row is widened by the longest possible period to the left.
    """
    gram = gram_ids(ids)
    if not len(gram):
        return []
    order = np.argsort(gram, kind="stable")
    again = gram[order[1:]] == gram[order[:-1]]
    back = np.zeros(len(gram), dtype=np.int64)
    back[order[1:][again]] = order[1:][again] - order[:-1][again]
    near = back > 0
    first = last = np.zeros(0, dtype=np.int64)
    for _ in range(ROUNDS):
        edges = np.diff(np.concatenate([[False], near, [False]]).astype(np.int8))
        first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        longest = (last - first + 2) // (exponent - 1)
        far = np.zeros(len(near), dtype=bool)
        far[near] = back[near] > np.repeat(longest, last - first)
        if not far.any():
            break
        near &= ~far
    edges = np.diff(np.concatenate([[False], near, [False]]).astype(np.int8))
    first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    longest = (last - first + 2) // (exponent - 1)
    usable = longest > 0
    return list(
        zip(
            np.maximum(first - longest, 0)[usable].tolist(),
            (last + GRAM - 1)[usable].tolist(),
        )
    )


def suffix_automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix links, longest lengths, and the state of every prefix. State 1 is the root, 0 none."""
    following: list[dict[int, int]] = [{}, {}]
    link, length, state = [0, 0], [0, 0], []
    last = 1
    for word in words:
        new = len(link)
        following.append({})
        length.append(length[last] + 1)
        link.append(1)
        at = last
        while at and word not in following[at]:
            following[at][word] = new
            at = link[at]
        if at:
            target = following[at][word]
            if length[target] == length[at] + 1:
                link[new] = target
            else:
                copy = len(link)
                following.append(following[target].copy())
                length.append(length[at] + 1)
                link.append(link[target])
                link[target] = link[new] = copy
                while at and following[at].get(word) == target:
                    following[at][word] = copy
                    at = link[at]
        last = new
        state.append(new)
    return link, length, state


class LastEnds:
    """Where the strings of each state ended last, with access to whole root paths.

    Every set of neighbouring states of one path with one last end is a splay tree ordered by
    depth; its root carries the end, and ``up`` of a root is the state above the path.
    """

    def __init__(self, link: list[int], length: list[int]):
        self.up, self.length = link.copy(), length
        self.shallow, self.deep = [0] * len(link), [0] * len(link)
        self.end = [-1] * len(link)

    def _splay(self, x: int) -> None:
        up, shallow, deep = self.up, self.shallow, self.deep
        top = x
        while (p := up[top]) and (shallow[p] == top or deep[p] == top):
            top = p
        if top == x:
            return
        self.end[x] = self.end[top]

        def rotate(x: int) -> None:
            p = up[x]
            g = up[p]
            if shallow[p] == x:
                child = shallow[p] = deep[x]
                deep[x] = p
            else:
                child = deep[p] = shallow[x]
                shallow[x] = p
            if child:
                up[child] = p
            up[p], up[x] = x, g
            if shallow[g] == p:
                shallow[g] = x
            elif deep[g] == p:
                deep[g] = x

        outside = up[top]
        while (p := up[x]) != outside:
            g = up[p]
            if g != outside:
                rotate(p if (shallow[g] == p) == (shallow[p] == x) else x)
            rotate(x)

    def access(self, state: int, now: int) -> Iterator[tuple[int, int]]:
        """Last end and longest length of each segment above ``state``; all of them end ``now``."""
        up, deep, end = self.up, self.deep, self.end
        found, below, x = [], 0, state
        while x:
            self._splay(x)
            if end[x] >= 0 and x != 1:
                found.append((end[x], self.length[x]))
            if cut := deep[x]:
                end[cut] = end[x]
            deep[x] = below
            below, x = x, up[x]
        self._splay(state)
        end[state] = now
        return found


def runs_of(
    ids: np.ndarray, exponent: int = 4, least: int = 6
) -> list[tuple[int, int, int]]:
    """Start, length and smallest period of every run with at least ``least`` words and
    ``exponent`` periods, by start and period."""
    found = set()
    words = None
    for first, stop in stretches(ids, exponent):
        words = ids.tolist() if words is None else words
        here = words[first:stop]
        link, length, state = suffix_automaton(here)
        ends = LastEnds(link, length)
        # Period -> end of the last run seen with it: a run is extended once.
        upto: dict[int, int] = {}
        for i, s in enumerate(state):
            for before, longest in ends.access(s, i):
                period = i - before
                if period > longest or upto.get(period, -1) >= first + i:
                    continue
                low = high = first + i
                low -= longest + period - 1
                while low > 0 and words[low - 1] == words[low - 1 + period]:
                    low -= 1
                while high + 1 < len(words) and words[high + 1] == words[high + 1 - period]:
                    high += 1
                upto[period] = high
                if high - low + 1 >= max(least, exponent * period):
                    found.add((low, period, high - low + 1))
    return [(low, size, period) for low, period, size in sorted(found)]


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run repeats: those of its first period, and those in no run."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    for start, size, period in runs:
        edges[start + period] += 1
        edges[start + size] -= 1
    keep = np.cumsum(edges[:-1]) == 0
    return [words[i] for i in np.flatnonzero(keep).tolist()]


RUN = T.StructType(
    [
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("period", T.LongType()),
    ]
)


def periodic_runs(
    docs: DataFrame, text: str = "text", exponent: int = 4, least: int = 6
) -> DataFrame:
    """Adds ``n_words``, ``runs`` (start, length, period, by start) and ``collapsed`` to every row.

    Words are runs of characters other than ASCII white space, compared exactly, case included.
    A run is a stretch with a smallest period, at least ``exponent`` (3 or more) periods and
    ``least`` words, that its neighbours do not continue. ``collapsed`` is the text with words
    joined by one space and without the repetitions of each run. Missing, empty and blank texts
    have 0 words, no runs and an empty ``collapsed``; texts without runs keep all words. Repeated
    rows are read one by one. Columns of ``docs`` with an added name are replaced. A task holds
    one piece of a few megabytes, or one long text with its automaton, at a time.
    """
    if exponent < 3:
        raise ValueError("runs of fewer than 3 periods are not searched for")
    docs = docs.drop(*[c for c in ("n_words", "runs", "collapsed") if c != text])
    schema = T.StructType(
        [
            *docs.schema.fields,
            T.StructField("n_words", T.LongType()),
            T.StructField("runs", T.ArrayType(RUN)),
            T.StructField("collapsed", T.StringType()),
        ]
    )
    names = schema.names

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, text):
            counts, sizes, rows, texts = [], [], [], []
            for value in pc.cast(batch.column(text), pa.large_binary()).to_pylist():
                # Bytes are split at ASCII white space only, text would be split at more.
                words = (value or b"").split()
                runs = runs_of(numbered(words), exponent, least) if len(words) >= least else []
                counts.append(len(words))
                sizes.append(len(runs))
                rows.extend(runs)
                texts.append(b" ".join(kept_words(words, runs)))
            at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            flat = np.array(rows, dtype=np.int64).reshape(-1, 3)
            found = pa.StructArray.from_arrays(
                [pa.array(np.ascontiguousarray(c)) for c in flat.T], names=RUN.names
            )
            added = [
                pa.array(counts, pa.int64()),
                pa.ListArray.from_arrays(pa.array(at), found),
                pa.array(texts, pa.binary()).cast(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=names)

    return docs.mapInArrow(search, schema)
