"""Benchmark decontamination by q-gram lemma filtering.

A passage of n bytes that occurs in a text with at most e edits shares at least

    (n - Q + 1) - Q * e

of its q-grams with the text, all of them on e + 1 neighbouring diagonals (place in the text minus place
in the passage). Shared q-grams are counted in bands of e + 1 diagonals; two neighbouring bands overlap
every such run, so a region is looked at only where two neighbours together reach the bound. There a
banded alignment finds the place with the fewest edits, and the passage counts as leaked if those are
within the budget, a tenth of its length. An alignment within the budget leaves its shared q-grams by at
most e diagonals, so the band has the 2e + 2 of the two neighbours and e on either side. The candidates of
a slice are aligned together, STEP bytes of the passages at a time; those that have the same band of the
text and have read the same bytes share their cells, so items with one opening read it once a place.

Texts are compared as UTF-8 bytes with A-Z lowered and every white-space byte read as a space, so places
are byte offsets in the text as given. Benchmark items longer than PASSAGE bytes are cut into passages, a
new one every half passage, the last at the end; finding one is a leak of the item. Passages have PASSAGE
bytes or less, so any run of 3 / 2 * PASSAGE bytes of an item holds a whole one. Items of fewer than
MIN_BYTES bytes leak where they occur exactly, between word boundaries: no letter, digit or byte beyond
ASCII continues a word of the item. Items without a word are not sought.

Scale: documents are read once and never shuffled. The benchmark is the stated query set: it is taken in
blocks of about BLOCK_BYTES bytes, by hash, and each block is broadcast, so the size of a broadcast does
not grow with the benchmark. Texts are searched in slices that overlap by more than a passage, so
memory does not grow with a text; a slice that shares more than PAIRS q-grams with the passages is
searched in halves that overlap alike, and candidates are aligned CANDIDATES at a time.

Rows: a null or empty text has no leak. Null ids and repeated rows are judged row by row. Items with
null text leak nowhere; equal items are reported each under its own id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwise.llm.shared import as_bytes

Q = 8
BUDGET_PERCENT = 10
PASSAGE, MIN_BYTES = 600, 32
BLOCK_BYTES = 1 << 21
SLICE = 1 << 20
PAIRS, CANDIDATES, STEP = 1 << 22, 1 << 14, 8
_FAR = 1 << 12
_BITS = 22
_FOLD = bytes(ord(" ") if b in b"\t\n\x0b\f\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))


_WORD = np.array([chr(b).isalnum() or b >= 128 for b in range(256)])


def folded(text: bytes) -> bytes:
    return text.translate(_FOLD)


def edit_budget(n: int) -> int:
    """A tenth of the length, or less where the bound would otherwise fall below four shared q-grams."""
    return max(0, min(n * BUDGET_PERCENT // 100, (n - Q + 1 - 4) // Q))


def _grams(data: np.ndarray) -> np.ndarray:
    """Every q-gram as one 64-bit value."""
    count = len(data) - Q + 1
    value = np.zeros(max(count, 0), dtype=np.uint64)
    for k in range(Q if count > 0 else 0):
        value |= data[k : k + count].astype(np.uint64) << np.uint64(8 * k)
    return value


def _slot(grams: np.ndarray) -> np.ndarray:
    return (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)


class Passages:
    """A block of passages and the index of their q-grams."""

    def __init__(self, items: list[tuple[int, bytes]]):
        """`items`: (position of the item, its folded text)."""
        self.owner, self.text = [], []
        self.short: dict[bytes, list[int]] = {}
        for owner, text in items:
            if len(text) < MIN_BYTES:
                if text.strip(b" "):
                    self.short.setdefault(text.strip(b" "), []).append(owner)
                continue
            parts = max(1, -(-len(text) // PASSAGE))
            width = -(-len(text) // parts)
            starts = {0} if parts == 1 else {*range(0, len(text), width), *range(width // 2, len(text) - width, width), len(text) - width}
            for at in sorted(starts):
                if len(text[at : at + width]) >= MIN_BYTES:
                    self.owner.append(owner)
                    self.text.append(text[at : at + width])
        # short items by the length of their start, at most Q bytes, and the start as a value
        self.starts: dict[int, np.ndarray] = {}
        self.lengths: dict[bytes, list[int]] = {}
        for text in sorted(self.short, key=len):
            self.lengths.setdefault(text[:Q], []).append(len(text))
        for n in {len(start) for start in self.lengths}:
            own = [int.from_bytes(start, "little") for start in self.lengths if len(start) == n]
            self.starts[n] = np.array(sorted(own), dtype=np.uint64)
        sizes = np.array([len(t) for t in self.text], dtype=np.int64)
        self.budget = np.array([edit_budget(n) for n in sizes], dtype=np.int64)
        self.needed = sizes - Q + 1 - Q * self.budget
        self.reach = int(sizes.max() + self.budget.max()) if len(sizes) else 0
        self.size = sizes
        # the passages in parts of STEP bytes, equal parts under one number
        known: dict[bytes, int] = {}
        parts = [[known.setdefault(t[k : k + STEP], len(known)) for k in range(0, len(t), STEP)] for t in self.text]
        self.part_at = np.cumsum([0] + [len(p) for p in parts])[:-1]
        self.part = np.array([k for p in parts for k in p], dtype=np.int64)
        self.part_size = np.array([len(k) for k in known], dtype=np.int64)
        self.letters = np.frombuffer(b"".join(k.ljust(STEP, b"\0") for k in known), dtype=np.uint8).reshape(-1, STEP)
        grams = [_grams(np.frombuffer(t, dtype=np.uint8)) for t in self.text]
        places = [np.arange(len(g)) for g in grams]
        owners = [np.full(len(g), k) for k, g in enumerate(grams)]
        if grams:
            every = np.concatenate(grams)
            order = np.argsort(every, kind="stable")
            self.gram, self.first, self.count = np.unique(every[order], return_index=True, return_counts=True)
            self.place, self.passage = np.concatenate(places)[order], np.concatenate(owners)[order]
            self.seen = np.zeros(1 << _BITS, dtype=bool)
            self.seen[_slot(self.gram)] = True

    def search(self, text: bytes) -> list[tuple[int, int, int, int]]:
        """Leaks in one folded text: (item position, start, end, edits), overlapping ones of an item reduced to the best."""
        found = list(self._exact(text)) if self.short else []
        if not self.text or len(text) < Q:
            return sorted(found)
        return sorted(found + self._near(text))

    def _exact(self, text: bytes) -> Iterator[tuple[int, int, int, int]]:
        """Short items between word boundaries; of places of an item that overlap, the first."""
        free: dict[bytes, int] = {}
        for low in range(0, len(text), SLICE):
            part = np.frombuffer(text[low : low + SLICE + Q], dtype=np.uint8)
            grams = _grams(np.concatenate((part, np.zeros(Q - 1, dtype=np.uint8))))[: min(SLICE, len(text) - low)]
            word = _WORD[np.frombuffer(text[max(0, low - 1) : low + len(grams)], dtype=np.uint8)]
            word = word if low else np.concatenate(([False], word))
            begins = np.flatnonzero(~(word[1:] & word[:-1]))
            for n, starts in self.starts.items():
                own = grams[begins] & np.uint64((1 << 8 * n) - 1)
                for at in (low + begins[np.isin(own, starts)]).tolist():
                    for size in self.lengths.get(text[at : at + n], ()):
                        item, end = text[at : at + size], at + size
                        if item not in self.short or at < free.get(item, 0):
                            continue
                        if end < len(text) and _WORD[text[end]] and _WORD[text[end - 1]]:
                            continue
                        free[item] = end
                        yield from ((owner, at, end, 0) for owner in self.short[item])

    def _near(self, text: bytes) -> list[tuple[int, int, int, int]]:
        found: list[tuple[int, int, int, int]] = []
        step = max(SLICE, 4 * self.reach)
        at = 0
        while True:
            part = text[at : at + step + 2 * self.reach]
            found += [(owner, at + start, at + end, edits) for owner, start, end, edits in self._slice(part)]
            at += step
            if at + 2 * self.reach >= len(text) or at >= len(text):
                break
        best: list[tuple[int, int, int, int]] = []
        for hit in sorted(set(found), key=lambda h: (h[0], h[3], h[1], h[2])):
            if not any(b[0] == hit[0] and b[1] < hit[2] and hit[1] < b[2] for b in best):
                best.append(hit)
        return best

    def _slice(self, text: bytes) -> Iterator[tuple[int, int, int, int]]:
        grams = _grams(np.frombuffer(text, dtype=np.uint8))
        at = np.flatnonzero(self.seen[_slot(grams)])
        where = np.searchsorted(self.gram, grams[at])
        where[where == len(self.gram)] = 0
        true = self.gram[where] == grams[at]
        at, where = at[true], where[true]
        if not len(at):
            return
        repeats = self.count[where]
        if repeats.sum() > PAIRS and len(text) > 8 * self.reach:
            half = len(text) // 2
            yield from self._slice(text[: half + 2 * self.reach])
            yield from ((owner, half + start, half + end, edits) for owner, start, end, edits in self._slice(text[half:]))
            return
        entry = np.repeat(self.first[where] - np.concatenate(([0], np.cumsum(repeats)[:-1])), repeats) + np.arange(repeats.sum())
        passage = self.passage[entry]
        # shifted so that every diagonal is positive
        diagonal = np.repeat(at, repeats) - self.place[entry] + self.reach
        band = diagonal // (self.budget[passage] + 1)
        key, count = np.unique(passage << 40 | band, return_counts=True)
        beside = np.zeros(len(key), dtype=np.int64)
        if len(key) > 1:
            beside[:-1] = np.where(key[1:] == key[:-1] + 1, count[1:], 0)
        key = key[count + beside >= self.needed[key >> 40]]
        which, low = key >> 40, key & ((1 << 40) - 1)
        budget = self.budget[which]
        # the diagonals of two neighbouring bands, and as many as edits can leave them by
        left = low * (budget + 1) - self.reach - budget
        # verbatim copies need no alignment
        exact = np.zeros(len(which), dtype=bool)
        for k, (passage, first, edits) in enumerate(zip(which.tolist(), left.tolist(), budget.tolist())):
            size = len(self.text[passage])
            start = text.find(self.text[passage], max(0, first), max(0, first + 4 * edits + 1 + size))
            if start >= 0:
                exact[k] = True
                yield self.owner[passage], start, start + size, 0
        for edits in np.unique(budget[~exact]):
            own = np.flatnonzero((budget == edits) & ~exact)
            own = own[np.argsort(left[own], kind="stable")]
            for k in range(0, len(own), CANDIDATES):
                part = own[k : k + CANDIDATES]
                for passage, start, end, cost in banded(self, text, which[part], left[part], int(edits)):
                    yield self.owner[passage], start, end, cost


def banded(passages: Passages, text: bytes, which: np.ndarray, left: np.ndarray, budget: int) -> Iterator[tuple[int, int, int, int]]:
    """Passages aligned to a text, each within its band: (passage, start, end, edits) of those within the budget.

    Candidate k may place passage `which[k]` on the 4 * budget + 2 diagonals from `left[k]` on. A cell is a
    diagonal; its row of the table is the number of passage bytes read. Of places with equal edits the first is given.
    """
    width, n = 4 * budget + 2, len(text)
    ramp = np.arange(width, dtype=np.int16)
    # before and behind the text stands what equals no byte
    padding = passages.reach + width + budget + STEP
    letters = np.full(n + 2 * padding, -1, dtype=np.int16)
    letters[padding : padding + n] = np.frombuffer(text, dtype=np.uint8)
    windows = np.lib.stride_tricks.sliding_window_view(letters, width)
    low, state = np.unique(left, return_inverse=True)
    origin = (low[:, None] + ramp).astype(np.int32)
    cost = np.where((origin >= 0) & (origin <= n), 0, _FAR).astype(np.int16)
    read = 0
    while len(which):
        part = passages.part[passages.part_at[which] + read // STEP]
        pairs, state = np.unique(state * len(passages.part_size) + part, return_inverse=True)
        before, part = np.divmod(pairs, len(passages.part_size))
        low, cost, origin, size = low[before], cost[before], origin[before], passages.part_size[part]
        whole = int(size.min())
        for k in range(int(size.max())):
            rows = slice(None) if whole > k else np.flatnonzero(size > k)
            old, source = cost[rows], origin[rows]
            step = old + (windows[low[rows] + read + k + padding] != passages.letters[part[rows], k][:, None])
            down = old[:, 1:] + 1
            right = source[:, 1:].copy()
            better = down < step[:, :-1]
            step[:, :-1] = np.where(better, down, step[:, :-1])
            source[:, :-1] = np.where(better, right, source[:, :-1])
            # along the row: the cheapest cell to the left plus the distance
            level = step - ramp
            least = np.minimum.accumulate(level, axis=1)
            at = np.maximum.accumulate(np.where(level == least, ramp, 0), axis=1)
            cost[rows], origin[rows] = least + ramp, np.take_along_axis(source, at, axis=1)
        best = cost.argmin(axis=1)
        fewest = cost[np.arange(len(cost)), best]
        within, ended = fewest[state] <= budget, passages.size[which] <= read + STEP
        for k in np.flatnonzero(within & ended).tolist():
            row, passage = state[k], int(which[k])
            cell = best[row]
            yield passage, int(origin[row, cell]), int(low[row] + passages.size[passage] + cell), int(fewest[row])
        stay = within & ~ended
        which, state = which[stay], state[stay]
        read += STEP


def _blocks(items: DataFrame, id_column: str, text_column: str) -> Iterator[tuple[list, list[tuple[int, bytes]]]]:
    """The benchmark block by block: (ids, texts with their position)."""
    rows = items.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")).filter("text IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-total // BLOCK_BYTES))
    part = F.pmod(F.xxhash64("text"), F.lit(count))
    for k in range(count):
        block = sorted(rows.filter(part == k).collect(), key=lambda r: (r.id is None, r.id, r.text))
        yield [r.id for r in block], [(i, folded(r.text.encode())) for i, r in enumerate(block)]


def leaks(
    docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    item_id_column: str = "item_id", item_text_column: str = "text",
) -> DataFrame:
    """One row per leak: (id, item_id, start_byte, end_byte, edits)."""
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    id_type, item_type = (t.simpleString() for t in (narrow.schema["id"].dataType, items.schema[item_id_column].dataType))
    result = None
    for ids, texts in _blocks(items, item_id_column, item_text_column):
        block = spark.sparkContext.broadcast((pa.array(ids) if ids else None, Passages(texts)))

        def search(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            own_ids, passages = block.value
            for batch in batches:
                hits = [(row, *hit) for row, text in enumerate(as_bytes(batch.column(1))) for hit in passages.search(folded(text))]
                if hits:
                    row, item, start, end, edits = (pa.array(c, pa.int64()) for c in zip(*hits))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(row), own_ids.take(item), start, end, edits],
                        names=["id", "item_id", "start_byte", "end_byte", "edits"],
                    )

        part = narrow.mapInArrow(search, f"id {id_type}, item_id {item_type}, start_byte bigint, end_byte bigint, edits bigint")
        result = part if result is None else result.union(part)
    return result


def without_leaks(docs: DataFrame, items: DataFrame, text_column: str = "text", item_id_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """The rows of `docs` whose text holds no leaked passage, as they are."""
    at = docs.columns.index(text_column)
    for _, texts in _blocks(items, item_id_column, item_text_column):
        block = docs.sparkSession.sparkContext.broadcast(Passages(texts))

        def clean(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                stay = [not block.value.search(folded(text)) for text in as_bytes(batch.column(at))]
                yield batch.filter(pa.array(stay, pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
