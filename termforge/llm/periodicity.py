"""Periodic runs in texts by Crochemore's partition refinement.

A run is a stretch of consecutive words with smallest period q, at least max(LEAST_WORDS, LEAST_TURNS * q)
words long, that no neighbouring word extends with period q: boilerplate loops, degenerate
generations, repeated list rows.

Method. Positions of a text are parted into classes of equal factors of length 1, 2, 3, ... The classes
of length l + 1 come from those of length l: when a class is split, all its children but the largest are
"small", and only the positions before members of small classes are looked at, so a position is looked at
O(log n) times. Each class keeps its members in a list ordered by position. Two neighbours in a list at a
distance equal to the length are a square whose root is no power of a shorter word; squares of one period
that start at successive positions merge into one run. Texts of a chunk are refined side by side: each step
is a few array operations over the positions that all of them touch.

When neighbours change is logged as (position, length, distance). A distance d set at length t <= d and not
changed until after length d is a square of period d; so the log alone, sorted once, gives all squares.

Scale: one pass over the texts and no shuffle; a chunk holds CHUNK_WORDS words, or one longer text.
Work is O(n log n) array elements for a text of n words, and at most n / LEAST_TURNS steps.

Defined results. A null or empty text has no words, no runs and an empty collapsed text. Rows that repeat
give repeated results; a null doc_id is kept. Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from termforge.llm.common import WORD

LEAST_WORDS, LEAST_TURNS = 24, 3
CHUNK_WORDS = 400_000
_NONE = np.iinfo(np.int64).max


def _first_of_each(sorted_values: np.ndarray) -> np.ndarray:
    """Marks the first of each stretch of equal values."""
    return np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The integers of all ranges [start, start + size), one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class Partition:
    """Classes of equal factors of several texts, refined by one word a step."""

    def __init__(self, codes: np.ndarray, owner: np.ndarray, limit: np.ndarray):
        """codes: of the words, different in different texts, with an own code after each text's end;
        owner: the text of each position; limit: the longest period wanted at each position."""
        n = len(codes)
        self.limit, self.length = limit, 1
        order = np.argsort(codes, kind="stable")
        heads = np.flatnonzero(_first_of_each(codes[order]))
        self.n_classes = len(heads)
        self.start, self.size = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.start[: len(heads)] = heads
        self.size[: len(heads)] = np.diff(np.append(heads, n))
        self.members, self.place, self.cls = order.copy(), np.empty(n, np.int64), np.empty(n, np.int64)
        self.place[order] = np.arange(n)
        self.cls[order] = np.repeat(np.arange(len(heads)), self.size[: len(heads)])
        self.alone = np.repeat(self.size[: len(heads)] == 1, self.size[: len(heads)])[self.place]
        self.next, self.prior = np.full(n, -1), np.full(n, -1)
        self.log: list[tuple[np.ndarray, int, np.ndarray]] = []
        self._link(order, self.cls[order])
        # All classes of a text but its largest are small.
        size = self.size[: len(heads)]
        text = owner[order[heads]]
        by = np.lexsort((size, text))
        largest = by[np.append(text[by][1:] != text[by][:-1], True)]
        is_small = np.ones(len(heads), bool)
        is_small[largest] = False
        self.small = np.flatnonzero(is_small[self.cls])

    def _link(self, positions: np.ndarray, group: np.ndarray) -> None:
        """Make lists of positions, ordered by group and position."""
        same = group[1:] == group[:-1]
        self.next[positions] = np.append(np.where(same, positions[1:], -1), -1)
        self.prior[positions] = np.append(-1, np.where(same, positions[:-1], -1))
        self._note(positions)

    def _note(self, positions: np.ndarray) -> None:
        after = self.next[positions]
        self.log.append((positions, self.length, np.where(after < 0, _NONE, after - positions)))

    def refine(self) -> bool:
        """From factors of length l to l + 1; false where nothing is left to split."""
        at = self.small - 1
        at = at[at >= 0]
        at = at[~self.alone[at] & (self.limit[at] > self.length)]
        self.length += 1
        if not len(at):
            self.small = at
            return False
        at.sort()
        cls, following = self.cls[at], self.cls[at + 1]
        order = np.lexsort((following, cls))
        at, cls, following = at[order], cls[order], following[order]
        first = np.flatnonzero(_first_of_each(cls) | _first_of_each(following))
        count = np.diff(np.append(first, len(at)))
        of = cls[first]
        class_first = np.flatnonzero(_first_of_each(of))  # the first group of each class
        n_groups = np.diff(np.append(class_first, len(of)))
        rest = self.size[of[class_first]] - np.add.reduceat(count, class_first)
        which = np.repeat(np.arange(len(class_first)), n_groups)
        by = np.lexsort((count, which))
        largest = by[np.cumsum(n_groups) - 1]  # the largest group of each class
        # Where a class has no other members its largest group stays; else the others stay.
        moves = np.ones(len(of), bool)
        moves[largest[rest == 0]] = False
        is_small = moves.copy()
        rest_is_small = (rest > 0) & (rest < count[largest])
        is_small[largest[rest_is_small]] = False
        small = [at[np.repeat(is_small, count)]]
        if moves.any():
            self._move(at[np.repeat(moves, count)], of[moves], count[moves])
        if rest_is_small.any():
            classes = of[class_first][rest_is_small]
            small.append(self.members[_ranges(self.start[classes], self.size[classes])])
        self.small = np.concatenate(small)
        return True

    def _move(self, moved: np.ndarray, of: np.ndarray, count: np.ndarray) -> None:
        """Make each group of moved positions (ordered by old class, group, position) a class of its own."""
        old = np.repeat(of, count)
        # Out of the old lists: stretches of neighbours go at once.
        out = moved[np.lexsort((moved, old))]
        joined = self.next[out[:-1]] == out[1:]
        before, after = self.prior[out[np.append(True, ~joined)]], self.next[out[np.append(~joined, True)]]
        self.next[before[before >= 0]] = after[before >= 0]
        self.prior[after[after >= 0]] = before[after >= 0]
        # To the ends of the old classes' ranges: members there change places with those that move.
        head = np.flatnonzero(_first_of_each(of))
        classes, total = of[head], np.add.reduceat(count, head)
        cut = self.start[classes] + self.size[classes] - total
        slots = _ranges(cut, total)
        holders = self.members[slots]
        self.alone[moved] = True  # a mark for now
        is_moved = self.alone[holders]
        stay = holders[~is_moved]
        free = self.place[moved]
        free = free[free < np.repeat(cut, total)]
        self.members[free], self.place[stay] = stay, free
        self.members[slots], self.place[moved] = moved, slots
        self.size[classes] -= total
        new = np.arange(self.n_classes, self.n_classes + len(of))
        self.n_classes += len(of)
        self.start[new], self.size[new] = slots[np.cumsum(count) - count], count
        self.cls[moved] = np.repeat(new, count)
        self.alone[moved] = np.repeat(count == 1, count)
        left = classes[self.size[classes] == 1]
        self.alone[self.members[self.start[left]]] = True
        self._note(before[before >= 0])
        self._link(moved, self.cls[moved])

    def squares(self) -> tuple[np.ndarray, np.ndarray]:
        """(period, start) of all squares with a root that is no power, ordered, from the log."""
        at = np.concatenate([x[0] for x in self.log])
        length = np.concatenate([np.full(len(x[0]), x[1]) for x in self.log])
        gap = np.concatenate([x[2] for x in self.log])
        order = np.argsort(at, kind="stable")  # the log is in order of length
        at, length, gap = at[order], length[order], gap[order]
        until = np.append(np.where(at[1:] == at[:-1], length[1:], _NONE), _NONE)
        found = (length <= gap) & (gap < until) & (gap <= self.limit[at])
        at, gap = at[found], gap[found]
        order = np.lexsort((at, gap))
        return gap[order], at[order]


def find(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each list of words, ordered by start and period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    used = [k for k, words in enumerate(texts) if len(words) >= LEAST_WORDS]
    if not used:
        return out
    sizes = np.array([len(texts[k]) for k in used])
    first = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])  # each text is followed by an end
    n = int((sizes + 1).sum())
    owner = np.repeat(np.arange(len(used)), sizes + 1)
    is_end = np.zeros(n, bool)
    is_end[first + sizes] = True
    words = np.empty(int(sizes.sum()), object)
    words[:] = [w for k in used for w in texts[k]]
    codes = np.empty(n, np.int64)
    codes[~is_end] = pd.factorize(words)[0] + 1
    codes[is_end] = 0
    codes += owner * (int(codes.max()) + 1)
    partition = Partition(codes, owner, np.repeat(sizes // LEAST_TURNS, sizes + 1))
    while partition.refine():
        pass
    period, at = partition.squares()
    if not len(at):
        return out
    head = np.flatnonzero(_first_of_each(period) | np.append(True, at[1:] != at[:-1] + 1))
    n_squares = np.diff(np.append(head, len(at)))
    start, period = at[head], period[head]
    length = n_squares - 1 + 2 * period
    kept = length >= np.maximum(LEAST_WORDS, LEAST_TURNS * period)
    start, length, period = start[kept], length[kept], period[kept]
    for i in np.lexsort((period, start)):
        k = owner[start[i]]
        out[used[k]].append((int(start[i] - first[k]), int(length[i]), int(period[i])))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those after a run's first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(kept)])


def _chunks(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Indices of texts of similar size, of CHUNK_WORDS words together, or one longer text."""
    order = np.argsort(sizes, kind="stable")
    group = np.cumsum(sizes[order]) // CHUNK_WORDS
    yield from np.split(order, np.flatnonzero(np.diff(group)) + 1)


def find_runs(docs: DataFrame, text: Column | None = None) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period by start and period), collapsed text of every document.

    text: what to read instead of the column of that name.
    """
    import pyarrow as pa

    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(run)), ("collapsed", pa.string())])

    def batches(read: Iterable) -> Iterator:
        for batch in read:
            texts = batch.column("text").to_pylist()
            sizes = np.array([len(t) if t else 0 for t in texts], np.int64) // 5 + 1
            for chosen in _chunks(sizes) if texts else ():
                words = [(texts[i] or "").encode().split() for i in chosen]
                runs = find(words)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(chosen)),
                        pa.array([len(w) for w in words], pa.int64()),
                        pa.array([[dict(zip(("start", "length", "period"), r)) for r in own] for own in runs], pa.list_(run)),
                        pa.array([collapse(w, r).decode() for w, r in zip(words, runs)], pa.string()),
                    ],
                    schema=schema,
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("text") if text is None else text).alias("text"))
    return rows.mapInArrow(batches, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def looped(doc_id: Column, text: Column) -> Column:
    """The text of documents whose id has a CRC-32 divisible by 10 with its end made periodic; other texts as they are.

    With h the CRC-32 of the decimal id, g = floor(h / 10) and n words: word i >= a becomes word a + (i - a) % p of the
    original, where a = g % n and p = 1 + floor((n - a) / (3 + g % 8)).
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))

    def edited(ws: Column) -> Column:
        a = F.pmod(g, F.size(ws)).cast("int")
        p = (1 + F.floor((F.size(ws) - a) / (3 + g % 8))).cast("int")
        turn = F.slice(ws, a + 1, p)
        return F.array_join(F.concat(F.slice(ws, F.lit(1), a), F.slice(F.flatten(F.array_repeat(turn, F.ceil((F.size(ws) - a) / p).cast("int"))), F.lit(1), F.size(ws) - a)), " ")

    chosen = (h % 10 == 0) & (F.regexp_extract(text, WORD, 0) != "")
    return F.when(chosen, F.element_at(F.transform(F.array(words), edited), 1)).otherwise(text)


def digest_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of the greatest exponent, and digests of all runs and of the collapsed text."""
    found = find_runs(docs, looped(F.col("doc_id"), F.col("text")))
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    # Runs come by start and period, so that the first of equal exponents stays.
    best = F.reduce("runs", none, lambda b, r: F.when(b.isNull() | (r.length * b.period > b.length * r.period), r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n")))
    told = found.select("doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), lines.alias("lines"), "collapsed")
    return told.select(
        "doc_id",
        "n_runs",
        "b.start",
        "b.length",
        "b.period",
        F.floor(1000 * F.col("b.length") / F.col("b.period")).alias("exponent_milli"),
        F.sha2(F.array_join("lines", ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )
