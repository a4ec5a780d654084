"""Suffix order of a text by induced sorting, with queues that spill to disk.

The suffixes that start a rising run after a fall (LMS) are sorted first: their substrings by one round
of induction, whole suffixes by recursion on the string of their ranks. From them all others follow:
the falling suffixes in a pass over the first letters upwards, the rising ones in a pass downwards. Both
passes run on a priority queue of letters; a letter's entries leave in the order in which they came.
An entry of a letter may bring another of the same letter, so a letter is worked in layers, each a few
vector operations. Queues longer than `memory` entries live in unnamed temporary files of the task.
Where there are about as many letters as entries, a queue has nothing to gather: there the ranks of
pairs are sorted instead of recursing further.
"""

from __future__ import annotations

import heapq
import tempfile

import numpy as np

MEMORY = 1 << 22
DENSE = 256


class LetterQueue:
    """A priority queue: the least letter first, its entries in order of arrival."""

    def __init__(self, memory: int = MEMORY):
        self.memory, self.held = memory, 0
        self.letters: list[int] = []
        self.entries: dict[int, list[np.ndarray]] = {}
        self.spilled: dict[int, list[tuple[int, int]]] = {}
        self.file = None

    def put(self, letters: np.ndarray, entries: np.ndarray) -> None:
        if not len(entries):
            return
        order = np.argsort(letters, kind="stable")
        letters, entries = letters[order], entries[order]
        first = np.flatnonzero(np.concatenate(([True], letters[1:] != letters[:-1])))
        for letter, part in zip(letters[first].tolist(), np.split(entries, first[1:])):
            if letter not in self.entries:
                self.entries[letter] = []
                heapq.heappush(self.letters, letter)
            self.entries[letter].append(part)
        self.held += len(entries)
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for letter, parts in self.entries.items():
            if parts:
                whole = np.concatenate(parts)
                self.spilled.setdefault(letter, []).append((self.file.tell(), len(whole)))
                self.file.write(whole.tobytes())
                parts.clear()
        self.held = 0

    def least(self) -> int | None:
        return self.letters[0] if self.letters else None

    def take(self, letter: int) -> np.ndarray:
        """All entries of the least letter."""
        heapq.heappop(self.letters)
        parts = []
        for at, count in self.spilled.pop(letter, ()):
            self.file.seek(at)
            parts.append(np.frombuffer(self.file.read(8 * count), dtype=np.int64))
        held = self.entries.pop(letter)
        self.held -= sum(map(len, held))
        parts += held
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def _rising(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next; the last, the end mark, is."""
    rising = np.ones(len(text), dtype=bool)
    at = np.where(text[:-1] == text[1:], len(text), np.arange(len(text) - 1))
    decided = np.minimum.accumulate(at[::-1])[::-1]
    rising[:-1] = (text[:-1] < text[1:])[decided]
    return rising


def _pass(text: np.ndarray, wanted: np.ndarray, sign: int, sources: dict[int, np.ndarray], memory: int) -> dict[int, np.ndarray]:
    """One induction pass: entries of the wanted kind by letter, letters ascending (sign 1) or descending (-1).

    `sources` are ordered suffixes of the other kind by letter, which come after the induced ones of their letter.
    """
    queue = LetterQueue(memory)
    result: dict[int, np.ndarray] = {}
    rest = sorted(sources, key=lambda c: sign * c, reverse=True)

    def induced(entries: np.ndarray, letter: int) -> np.ndarray:
        before = entries[entries > 0] - 1
        before = before[wanted[before]]
        letters = text[before]
        same = letters == letter
        if not same.all():
            queue.put(sign * letters[~same], before[~same])
        return before[same]

    while rest or queue.least() is not None:
        own = queue.least()
        letter = rest[-1] if own is None or rest and sign * rest[-1] < own else sign * own
        if own is not None and sign * letter == own:
            layers = [queue.take(own)]
            while len(layers[-1]):
                layers.append(induced(layers[-1], letter))
            result[letter] = np.concatenate(layers)
        if rest and rest[-1] == letter:
            rest.pop()
            induced(sources[letter], letter)
    return result


def _by_letter(text: np.ndarray, entries: np.ndarray) -> dict[int, np.ndarray]:
    """Ordered suffixes, cut where the first letter changes."""
    letters = text[entries]
    first = np.flatnonzero(np.concatenate(([True], letters[1:] != letters[:-1])))
    return dict(zip(letters[first].tolist(), np.split(entries, first[1:])))


def _induced(text: np.ndarray, rising: np.ndarray, lms: np.ndarray, memory: int) -> np.ndarray:
    """All suffixes in order, from LMS suffixes in order."""
    falling = _pass(text, ~rising, 1, _by_letter(text, lms), memory)
    # downwards everything is met back to front; the end mark is nobody's predecessor
    back = {c: e[::-1] for c, e in falling.items()}
    end = int(text[-1])
    up = _pass(text, rising, -1, {**back, end: np.array([len(text) - 1])} if end not in back else back, memory)
    parts = [np.array([len(text) - 1])]
    for letter in sorted({*falling, *up}):
        if letter in falling:
            parts.append(falling[letter])
        if letter in up:
            parts.append(up[letter][::-1])
    return np.concatenate(parts)


def _doubled(ranks: np.ndarray) -> np.ndarray:
    """Suffix order of a string of ranks with about as many letters as places: ranks of pairs, the reach doubled each time."""
    count, reach = len(ranks), 1
    size = np.bincount(ranks)
    # a class is named by the place of its first in the order, so that those which are one need no more sorting
    rank = (np.cumsum(size) - size)[ranks]
    open_ = np.flatnonzero(size[ranks] > 1)
    while len(open_):
        after = np.append(rank, -1)[np.minimum(open_ + reach, count)]
        key = rank[open_] * (count + 1) + after + 1
        order = np.argsort(key)
        open_, key = open_[order], key[order]
        old, here = rank[open_], np.arange(len(open_))
        new = np.concatenate(([True], key[1:] != key[:-1]))
        begin = np.maximum.accumulate(np.where(np.concatenate(([True], old[1:] != old[:-1])), here, 0))
        rank[open_] = old + np.maximum.accumulate(np.where(new, here, 0)) - begin
        open_ = open_[~(new & np.append(new[1:], True))]
        reach *= 2
    order = np.empty(count, dtype=np.int64)
    order[rank] = np.arange(count)
    return order


def _names(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ranks of sorted substrings text[start:end+1]; equal ones share a rank."""
    size = ends - starts
    same = size[1:] == size[:-1]
    left, right, length = starts[:-1][same], starts[1:][same], size[1:][same]
    where = np.flatnonzero(same)
    equal = np.zeros(len(starts) - 1, dtype=bool)
    step = 0
    while len(where):
        alike = text[left + step] == text[right + step]
        done = alike & (length == step)
        equal[where[done]] = True
        go = alike & ~done
        where, left, right, length = where[go], left[go], right[go], length[go]
        step += 1
    return np.concatenate(([0], np.cumsum(~equal)))


def suffix_order(text: np.ndarray, memory: int = MEMORY) -> np.ndarray:
    """Start positions of all suffixes in order. The last letter has to be smaller than all others."""
    count = len(text)
    if count < 3:
        return np.arange(count)[::-1].copy()
    if 0 <= text.min() and text.max() < 1 << 15:
        # letters of two bytes are sorted in passes, not by comparing
        text = text.astype(np.int16)
    rising = _rising(text)
    lms = np.flatnonzero(rising[1:] & ~rising[:-1]) + 1
    if len(lms) > 1:
        rough = _induced(text, rising, lms[np.argsort(text[lms], kind="stable")], memory)
        is_lms = np.zeros(count, dtype=bool)
        is_lms[lms] = True
        ordered = rough[is_lms[rough]]
        following = np.full(count, count - 1)
        following[lms[:-1]] = lms[1:]
        names = _names(text, ordered, following[ordered])
        if names[-1] + 1 < len(lms):
            rank = np.empty(count, dtype=np.int64)
            rank[ordered] = names
            dense = DENSE * (int(names[-1]) + 1) < len(lms)
            ordered = lms[suffix_order(rank[lms], memory) if dense else _doubled(rank[lms])]
        lms = ordered
    return _induced(text, rising, lms, memory)


def repeated_windows(text: np.ndarray, order: np.ndarray, span: int) -> np.ndarray:
    """A group number for each place in `order`: neighbours share it if they agree in `span` letters."""
    count = len(text)
    left, right = order[:-1], order[1:]
    alike = np.maximum(left, right) + span <= count
    where = np.flatnonzero(alike)
    # as many letters at once as a number holds
    bits = max(1, int(text.max(initial=0)).bit_length())
    held = min(span, max(1, 63 // bits))
    packed = np.zeros(max(0, count - held + 1), dtype=np.int64)
    for step in range(held):
        packed = packed << bits | text[step : step + len(packed)]
    for step in (*range(0, span - held, held), span - held):
        go = packed[left[where] + step] == packed[right[where] + step]
        alike[where[~go]] = False
        where = where[go]
    return np.concatenate(([0], np.cumsum(~alike)))
