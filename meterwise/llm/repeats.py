"""Removal of byte strings that an earlier document has, by suffix order over shards.

Every byte covered by a SPAN-byte string that also starts in a document with a smaller id is removed;
strings are judged on the input. Each window of SPAN bytes has an anchor: its GRAM bytes of least hash
(leftmost among equals). Equal windows have equal anchors, so only anchors need to meet.

1. Every document sends its anchors, about one in eighteen places, as hashes: of the anchor, and of its
   surroundings, which hold all windows with that anchor. Sorted by anchor, surroundings and id, a
   stream of constant memory gives two kinds of finding: surroundings that a smaller id has are removed
   whole; the smallest id of surroundings is open if others of its anchor agree with it in the GRAM
   bytes before or after, as they must to share a window.
2. Open surroundings (at the edges of copied passages) come together by anchor as bytes. Their shard is
   sorted by external induced sorting, and windows that agree with one of a smaller id are removed.
3. Findings meet their documents once more, whose anchors, worked out again, tell where they apply.

Scale: the texts move once, both to cut out open surroundings and to apply the findings; the rest is
hashes. Copies, however many, are settled in the stream; only different surroundings of one anchor
share a shard, which is read in order of anchor in pieces of about SHARD_BYTES. An anchor with more open
surroundings than HOT is not sorted: its surroundings fall apart into their windows, each by the place
of the anchor and a 128-bit hash of the window. A batch of texts sends the smallest id of each window
and settles the others itself; a stream of constant memory compares the smallest ids.

Hashes are 64 bits each for anchor and surroundings (12 bits of either side and 40 of the whole); a
wrong removal needs two different surroundings with both equal.

Rows: a null text is empty. A row with a null id keeps everything and makes nobody lose anything. Rows
sharing an id are the same document: none makes the other lose anything.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwise.llm.induced import repeated_windows, suffix_order
from meterwise.llm.shared import as_bytes, mixed, written

SPAN, GRAM = 50, 16
WINDOW = SPAN - GRAM + 1
SHARD_BYTES = 1 << 21
# as many surroundings as fill a shard
HOT = SHARD_BYTES // (2 * SPAN - GRAM)
# places hashed at once, and bytes of texts worked on together
_SLICE, _GROUP = 1 << 16, 1 << 23
_ALL = (1 << WINDOW) - 1
_SIDE_BITS, _SIDE_MASK = 12, (1 << 12) - 1


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place on."""
    value, width = data.astype(np.uint64) + np.uint64(1), 1
    while width < GRAM:
        value = mixed(value[:-width] * np.uint64(0x9E3779B97F4A7C15) + value[width:])
        width *= 2
    return value


def marks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The anchors of all windows of some texts: which text, their places in it, ascending, their hashes, and hashes of their surroundings."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    # where a window would leave its text
    late = np.zeros(len(data), dtype=bool)
    for step in range(1, SPAN):
        late[(ends - step)[sizes >= step]] = True
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(data) - SPAN + 1, _SLICE):
        low, high = max(0, at - 2 * SPAN), at + _SLICE + 3 * SPAN
        grams = gram_hashes(data[low:high])
        part = grams[at - low : at - low + _SLICE + WINDOW - 1]
        # the place, in the low bits, decides among equal hashes
        least, width = (part >> np.uint64(24) << np.uint64(24)) | np.arange(len(part), dtype=np.uint64), 1
        while 2 * width <= WINDOW:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[: len(least) - (WINDOW - width)], least[WINDOW - width :])
        least = least[~late[at : at + len(least)]]
        place = at + _changed((least & np.uint64((1 << 24) - 1)).astype(np.int64))
        text = np.searchsorted(ends, place, side="right")
        own = place - (ends - sizes)[text]
        found.append((place, grams[place - low], _surroundings(texts, text, own, sizes[text], place - low, grams)))
    if not found:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.uint64)
    place, gram, context = (np.concatenate(x) for x in zip(*found))
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(place) else place
    place = place[first]
    text = np.searchsorted(ends, place, side="right")
    return text, place - (ends - sizes)[text], gram[first], context[first]


def _changed(values: np.ndarray) -> np.ndarray:
    """Falling nowhere, as the leftmost least places of windows do: each value once."""
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


def _surroundings(texts: list[bytes], text: np.ndarray, place: np.ndarray, size: np.ndarray, at: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Hashes of what lies around each anchor: 12 bits each of the GRAM bytes before and after it, 40 of all its windows.

    Away from the ends of the text all is made of gram hashes; there, of the bytes and the anchor's place in them.
    """
    gram = lambda step: grams[np.clip(at + step, 0, len(grams) - 1)]
    before = np.where(place >= GRAM, gram(-GRAM), 0)
    after = np.where(place + 2 * GRAM <= size, gram(GRAM), 0)
    reach = SPAN - GRAM
    whole = np.zeros(len(place), dtype=np.uint64)
    for step in (-reach, GRAM - reach, -GRAM, 0, GRAM, 2 * GRAM, reach):
        whole = mixed(whole * np.uint64(0x9E3779B97F4A7C15) + gram(step))
    edge = np.flatnonzero((place < reach) | (place + SPAN > size))
    whole[edge] = np.fromiter(
        (xxhash.xxh3_64_intdigest(around(texts[t], p), seed=1 + min(p, reach)) for t, p in zip(text[edge].tolist(), place[edge].tolist())),
        np.uint64, len(edge),
    )
    sides = (before >> np.uint64(52) << np.uint64(52)) | (after >> np.uint64(52) << np.uint64(40))
    return sides | (whole & np.uint64((1 << 40) - 1))


def _groups(texts: list[bytes], rows: np.ndarray) -> Iterator[np.ndarray]:
    """The rows of some texts, about _GROUP bytes together."""
    behind = np.cumsum([len(texts[r]) for r in rows.tolist()]) if len(rows) else rows
    at = 0
    while at < len(rows):
        stop = max(at + 1, int(np.searchsorted(behind, (behind[at - 1] if at else 0) + _GROUP)))
        yield rows[at:stop]
        at = stop


def _lists(column: pa.Array, names: tuple[str, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of a column of lists of structs: the rows of its items, and their fields."""
    sizes = pc.list_value_length(column).fill_null(0).to_numpy()
    items = column.flatten()
    return np.repeat(np.arange(len(column)), sizes), [items.field(n).to_numpy(zero_copy_only=False) for n in names] if len(items) else [np.empty(0, np.int64)] * len(names)


def _matched(text: np.ndarray, context: np.ndarray, own_text: np.ndarray, own_context: np.ndarray) -> np.ndarray:
    """For each (text, context) its place among the own ones, which are different and sorted by text and context; -1 for none."""
    if not len(own_text):
        return np.full(len(text), -1)
    kinds = np.unique(own_context)
    kind = np.minimum(np.searchsorted(kinds, context), len(kinds) - 1)
    key, own = text * len(kinds) + kind, own_text * len(kinds) + np.searchsorted(kinds, own_context)
    at = np.minimum(np.searchsorted(own, key), len(own) - 1)
    return np.where((own[at] == key) & (kinds[kind] == context), at, -1)


def around(text: bytes, place: int) -> bytes:
    """The bytes of all windows that hold the gram at `place`."""
    return text[max(0, place - SPAN + GRAM) : place + SPAN]


def _signed(values) -> pa.Array:
    return pa.array(np.asarray(values, dtype=np.uint64).astype(np.int64))


def _once(text: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Where each context of a text occurs first, by text and context."""
    order = np.lexsort((context, text))
    text, context = text[order], context[order]
    return order[np.concatenate(([True], (text[1:] != text[:-1]) | (context[1:] != context[:-1])))] if len(order) else order


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = as_bytes(batch.column(1))
        for rows in _groups(texts, np.arange(len(texts))):
            text, _, gram, context = marks([texts[r] for r in rows.tolist()])
            # a text that repeats itself sends each of its contexts once
            first = _once(text, context)
            if len(first):
                yield pa.RecordBatch.from_arrays(
                    [_signed(gram[first]), _signed(context[first]), batch.column(0).take(pa.array(rows[text[first]]))],
                    names=["gram", "context", "id"],
                )


def _resembling(group: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Of different contexts of anchors, those that agree with another of their anchor in a hash of either side."""
    result = np.zeros(len(group), dtype=bool)
    for shift in (52, 40):
        side = (context.astype(np.uint64) >> np.uint64(shift)).astype(np.int64) & _SIDE_MASK
        _, back, count = np.unique(group << _SIDE_BITS | side, return_inverse=True, return_counts=True)
        result |= count[back] > 1
    return result


def _findings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by gram, context and id: those with a smaller id of their context, and open ones."""
    held, last_gram, last_context, first_id = None, None, None, None

    def judged(table: pa.Table, whole: bool) -> tuple[pa.RecordBatch | None, pa.Table | None]:
        """`whole`: the last anchor's rows are all here; else they are kept back, unless they are too many."""
        nonlocal last_gram, last_context, first_id
        gram, context = (table[c].to_numpy() for c in ("gram", "context"))
        stop = len(gram)
        if not whole and gram[0] != gram[-1]:
            stop = int(np.searchsorted(gram, gram[-1]))
        elif not whole and stop < 1 << 20:
            return None, table
        part = table.slice(0, stop)
        gram, context = gram[:stop], context[:stop]
        own = part["id"].combine_chunks()
        new_gram = np.concatenate(([gram[0] != last_gram], gram[1:] != gram[:-1]))
        new_context = new_gram | np.concatenate(([context[0] != last_context], context[1:] != context[:-1]))
        leader = np.maximum.accumulate(np.where(new_context, np.arange(stop), -1))
        copied = pc.not_equal(own, own.take(pa.array(np.maximum(leader, 0)))).to_numpy(zero_copy_only=False)
        before = int(np.searchsorted(leader, 0))
        if before:
            copied = np.concatenate((pc.not_equal(own.slice(0, before), pa.scalar(first_id, own.type)).to_numpy(zero_copy_only=False), copied[before:]))
        # the smallest id of each context, where another context of the anchor may share a window
        group = np.cumsum(new_gram)
        heads = np.flatnonzero(new_context)
        open_ = np.zeros(stop, dtype=bool)
        open_[heads] = _resembling(group[heads], context[heads])
        # an anchor that is not here at once is hot in all its parts
        parted = np.zeros(stop, dtype=bool)
        if not new_gram[0]:
            parted |= group == group[0]
        if not whole and stop == len(table):
            parted |= group == group[-1]
        open_[heads[parted[heads]]] = True
        hot = parted | (np.bincount(group[open_], minlength=group[-1] + 1)[group] > HOT)
        keep = np.flatnonzero(copied | open_)
        last_gram, last_context, first_id = gram[-1], context[-1], own[leader[-1]].as_py() if leader[-1] >= 0 else first_id
        kept = part.take(pa.array(keep)).append_column("open", pa.array(open_[keep])).append_column("hot", pa.array(hot[keep])).combine_chunks().to_batches()
        return (kept[0] if kept else None), (table.slice(stop) if stop < len(table) else None)

    for batch in batches:
        if batch.num_rows:
            table = pa.Table.from_batches([batch])
            out, held = judged(table if held is None else pa.concat_tables([held, table]), False)
            if out is not None:
                yield out
    if held is not None:
        out, _ = judged(held, True)
        if out is not None:
            yield out


def _hot_windows(surroundings: list[tuple]) -> Iterator[tuple]:
    """Surroundings (context, id, bytes, lead) of hot anchors as rows (key, context, id, digest, lead) of their windows.

    Here lead is the place of the anchor in the window. Of a window that recurs, the smallest id goes to meet others; the rest
    are settled: a smaller id has the window, which an empty digest says.
    """
    rows, least = [], {}
    for context, id_, around_, lead in surroundings:
        for at in range(max(0, lead - SPAN + GRAM), min(lead, len(around_) - SPAN) + 1):
            digest = xxhash.xxh3_128_digest(around_[at : at + SPAN], seed=lead - at)
            rows.append((digest, context, id_, lead - at))
            if digest not in least or id_ < least[digest]:
                least[digest] = id_
    sent = set()
    for digest, context, id_, lead in rows:
        if id_ > least[digest]:
            yield context, context, id_, b"", lead
        elif digest not in sent:
            sent.add(digest)
            yield int.from_bytes(digest[:8], "little", signed=True), context, id_, digest, lead


def _shard_masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of open rows sorted by hot, gram, bytes and id: which of each row's windows a smaller id has."""
    held: list[tuple] = []
    size, first = 0, (None, None)
    for batch in batches:
        ids, contexts, masks = [], [], []
        for *row, hot in zip(*(c.to_pylist() for c in batch.columns)):
            if hot:
                _, context, id_, digest, lead = row
                if digest and digest != first[0]:
                    first = digest, id_
                if not digest or id_ > first[1]:
                    ids.append(id_)
                    contexts.append(context)
                    masks.append(1 << (SPAN - GRAM - lead))
                continue
            if size > SHARD_BYTES and row[0] != held[-1][0]:
                yield from _masked(held)
                held, size = [], 0
            held.append(tuple(row))
            size += len(row[3])
        if ids:
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.schema.field(2).type), pa.array(contexts, pa.int64()), pa.array(masks, pa.int64())],
                names=["id", "context", "mask"],
            )
    if held:
        yield from _masked(held)


def _masked(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows (gram, context, id, bytes, lead) of whole anchors; lead is the bytes before the anchor."""
    sizes = np.array([len(r[3]) for r in rows])
    begin = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    # 0 ends the shard, 1 ends a row, the bytes follow
    text = np.frombuffer(b"\0".join(r[3] for r in rows), dtype=np.uint8).astype(np.int64) + 2
    text = np.concatenate([text, [1, 0]])
    text[begin[1:] - 1] = 1
    order = suffix_order(text)
    group = repeated_windows(text, order, SPAN)
    owner = np.append(np.repeat(np.arange(len(rows)), sizes + 1), len(rows) - 1).take(order)
    offset = order - begin[owner]
    inside = offset + SPAN <= sizes[owner]
    group, owner, offset = group[inside], owner[inside], offset[inside]
    # ids as ranks, so that any ordered type will do
    ids = [r[2] for r in rows]
    rank_of = {x: k for k, x in enumerate(sorted(set(ids)))}
    rank = np.array([rank_of[x] for x in ids])[owner]
    if not len(group):
        return
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.concatenate((starts, [len(group)]))))
    later = rank > least
    masks = np.zeros(len(rows), dtype=np.int64)
    lead = np.array([r[4] for r in rows])
    np.bitwise_or.at(masks, owner[later], np.int64(1) << (offset[later] - lead[owner[later]] + SPAN - GRAM))
    keep = np.flatnonzero(masks)
    if len(keep):
        id_values = pa.array(ids)
        yield pa.RecordBatch.from_arrays(
            [id_values.take(pa.array(keep)), pa.array([rows[k][1] for k in keep], pa.int64()), pa.array(masks[keep])],
            names=["id", "context", "mask"],
        )


def removed_spans(text: bytes, masks: dict[int, int]) -> list[tuple[int, int]]:
    """Maximal runs of bytes to remove, from the masks of contexts. Bit k is the window that starts SPAN - GRAM - k bytes before its anchor."""
    context = np.array(sorted(masks), dtype=np.int64)
    _, low, high = _spans([text], np.zeros(len(context), dtype=np.int64), context, np.array([masks[c] for c in context.tolist()], dtype=np.int64))
    return list(zip(low.tolist(), high.tolist()))


def _spans(texts: list[bytes], own_text: np.ndarray, own_context: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As removed_spans, of several texts: text, first byte and the byte behind the last one. Contexts with masks by text and context."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    # a byte between the texts keeps their runs apart
    begin = np.cumsum(sizes + 1) - sizes - 1
    edge = np.zeros(int((sizes + 1).sum()) + 1, dtype=np.int32)
    text, place, _, context = marks(texts)
    at = _matched(text, context.astype(np.int64), own_text, own_context)
    text, place, mask = text[at >= 0], place[at >= 0], masks[at[at >= 0]]
    first, last = np.maximum(0, place - SPAN + GRAM), np.minimum(place, sizes[text] - SPAN)
    full = mask == _ALL
    starts = [(begin[text] + first)[full]]
    stops = [(begin[text] + last)[full] + SPAN]
    text, place, mask, first, last = (x[~full] for x in (text, place, mask, first, last))
    for k in range(WINDOW):
        start = place - SPAN + GRAM + k
        wanted = (mask >> k & 1).astype(bool) & (first <= start) & (start <= last)
        starts.append((begin[text] + start)[wanted])
        stops.append(starts[-1] + SPAN)
    np.add.at(edge, np.concatenate(starts), 1)
    np.add.at(edge, np.concatenate(stops), -1)
    covered = np.cumsum(edge[:-1]) > 0
    turns = np.flatnonzero(np.diff(np.concatenate(([False], covered, [False])).astype(np.int8)))
    text = np.searchsorted(begin, turns[::2], side="right") - 1
    return text, turns[::2] - begin[text], turns[1::2] - begin[text]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (id, text, wanted): the open surroundings, or their windows where the anchor is hot."""
    for batch in batches:
        texts = as_bytes(batch.column(1))
        owner, (wanted, is_hot) = _lists(batch.column(2), ("context", "hot"))
        order = np.lexsort((wanted, owner))
        owner, wanted, is_hot = owner[order], wanted[order], is_hot[order].astype(bool)
        kinds, hot = (pa.int64(), pa.int64(), batch.schema.field(0).type, pa.binary(), pa.int64(), pa.bool_()), []
        names = ["gram", "context", "id", "bytes", "lead", "hot"]
        for rows in _groups(texts, np.unique(owner)):
            inside = (owner >= rows[0]) & (owner <= rows[-1])
            own = [texts[r] for r in rows.tolist()]
            text, place, gram, context = marks(own)
            context = context.astype(np.int64)
            first = _once(text, context)
            at = _matched(rows[text[first]], context[first], owner[inside], wanted[inside])
            first, heat = first[at >= 0], is_hot[inside][at[at >= 0]]
            text, place, gram, context = (x[first] for x in (text, place, gram, context))
            bodies = [around(own[t], p) for t, p in zip(text.tolist(), place.tolist())]
            lead, cool = np.minimum(place, SPAN - GRAM), np.flatnonzero(~heat)
            ids = batch.column(0).take(pa.array(rows[text]))
            hot += [(int(context[k]), ids[k].as_py(), bodies[k], int(lead[k])) for k in np.flatnonzero(heat).tolist()]
            yield pa.RecordBatch.from_arrays(
                [_signed(gram[cool]), pa.array(context[cool]), ids.take(pa.array(cool)), pa.array([bodies[k] for k in cool.tolist()], pa.binary()),
                 pa.array(lead[cool], pa.int64()), pa.array(np.zeros(len(cool), dtype=bool))], names=names,
            )
        if hot:
            out = [*zip(*((*row, True) for row in _hot_windows(hot)))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)


def findings(narrow: DataFrame) -> DataFrame:
    """Of a table (id, text): (id, context, mask), for the anchors with that context the windows that a smaller id has."""
    id_type = narrow.schema["id"].dataType.simpleString()
    rows = narrow.filter("id IS NOT NULL").mapInArrow(_anchor_rows, f"gram bigint, context bigint, id {id_type}")
    sorted_rows = rows.repartition("gram").sortWithinPartitions("gram", "context", "id")
    found = written(sorted_rows.mapInArrow(_findings, f"gram bigint, context bigint, id {id_type}, open boolean, hot boolean"))
    whole = found.filter("NOT open").select("id", "context", F.lit(_ALL).cast("bigint").alias("mask"))
    wanted = found.filter("open").groupBy("id").agg(F.collect_set(F.struct("context", "gram", "hot")).alias("wanted"))

    # a left join, as the one that applies the findings: the two share one exchange of the texts
    cuts = narrow.join(wanted, "id", "left").select("id", "text", "wanted").mapInArrow(
        _cut, f"gram bigint, context bigint, id {id_type}, bytes binary, lead bigint, hot boolean"
    )
    shards = cuts.repartition("gram").sortWithinPartitions("hot", "gram", F.when(F.col("hot"), F.col("bytes")), "id")
    return whole.union(shards.mapInArrow(_shard_masks, f"id {id_type}, context bigint, mask bigint"))


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept, kept_sha256) of every row; kept is the remaining bytes."""
    narrow = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    id_type = narrow.schema["id"].dataType.simpleString()
    lost = findings(narrow).groupBy("id").agg(F.collect_list(F.struct("context", "mask")).alias("found"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, texts = [[], [], [], [], []], as_bytes(batch.column(1))
            owner, (context, mask) = _lists(batch.column(2), ("context", "mask"))
            order = np.lexsort((context, owner))
            owner, context, mask = owner[order], context[order], mask[order]
            if len(owner):
                first = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (context[1:] != context[:-1]))))
                owner, context, mask = owner[first], context[first], np.bitwise_or.reduceat(mask, first)
            spans: dict[int, list[int]] = {}
            for rows in _groups(texts, np.unique(owner)):
                inside = (owner >= rows[0]) & (owner <= rows[-1])
                found = _spans([texts[r] for r in rows.tolist()], np.searchsorted(rows, owner[inside]), context[inside], mask[inside])
                for text, low, high in zip(*(x.tolist() for x in found)):
                    spans.setdefault(int(rows[text]), []).extend((low, high))
            for row, text in enumerate(texts):
                own = spans.get(row, ())
                stops = [0, *own, len(text)]
                kept = b"".join([text[a:b] for a, b in zip(stops[::2], stops[1::2])]) if own else text
                for column, value in zip(out, (len(text), len(text) - len(kept), len(own) // 2, kept, hashlib.sha256(kept).hexdigest())):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds))],
                names=["id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"],
            )

    return narrow.join(lost, "id", "left").select("id", "text", "found").mapInArrow(
        apply, f"id {id_type}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string"
    )
