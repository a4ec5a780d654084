"""Exact token counts of byte-pair encodings, at every prefix, without encoding a prefix anew.

Inside one piece (what the splitting pattern cuts a text into) the encoding of every prefix is found
by dynamic programming: the last token of the encoding of a prefix is the one vocabulary entry that
ends the prefix and may follow the last token of what is before it, so that

    count[i] = count[i - length of the last token] + 1.

Two tokens may follow each other when the merges, run on their bytes alone, give the two back. A
piece's table of counts answers every prefix of it, and the sums over whole pieces answer the rest:
how many tokens a text has, where a budget ends, whether a truncated text fits.

A null text is empty: no bytes, no tokens, cut at 0. Rows are judged one by one; ids may be null or
repeated.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from meterwise.llm.shared import as_bytes

# Fixed: the pattern of the byte-level vocabularies and how their files write the 256 bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Characters on whose classes every version of Unicode agrees; others are split by the library's own splitter.
_SETTLED = r"[^\u0000-\u052F\u2000-\u206F]"
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
MEMORY = 300_000


def _byte_letters() -> dict[str, int]:
    """Printable Latin-1 stands for itself, every other byte for a letter from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class PrefixCounter:
    """Counts for one vocabulary file. Remembers a bounded number of pieces."""

    def __init__(self, path: str, memory: int = MEMORY):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        letters = _byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        self.ranks: dict[tuple[bytes, bytes], int] = {}
        for rank, merge in enumerate(content["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.ranks[raw(left), raw(right)] = rank
        self.vocabulary = {bytes([b]) for b in range(256)} | {a + b for a, b in self.ranks}
        # entries in the order in which merges make them, and the two each is made of; a byte is made of nothing
        self.number = {bytes([b]): b for b in range(256)} | {a + b: 256 + rank for (a, b), rank in self.ranks.items()}
        self.made = {a + b: (a, b) for a, b in self.ranks}
        self.made_once = len(self.number) == 256 + len(self.ranks)
        self.longest = max(map(len, self.vocabulary))
        self.specials = [t["content"] for t in content.get("added_tokens", ())]
        self.special = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        self.piece, self.blanks, self.unsettled = regex.compile(PATTERN), regex.compile(r"\s*"), regex.compile(_SETTLED)
        self.splitter = Tokenizer.from_file(path).pre_tokenizer
        self.memory = memory
        self.totals: dict[str, int] = {}
        self.follows: dict[tuple[bytes, bytes], bool] = {}
        self.own: dict[bytes, bool] = {}

    # --- one piece --------------------------------------------------------------------------------

    def merged(self, data: bytes) -> list[bytes]:
        """The merges run on a few bytes, lowest rank first, leftmost among equals."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranked = [self.ranks.get(pair, 1 << 30) for pair in zip(parts, parts[1:])]
            best = min(ranked)
            if best == 1 << 30:
                break
            at = ranked.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, left: bytes, right: bytes) -> bool:
        known = self.follows.get((left, right))
        if known is None:
            if len(self.follows) > 4 * self.memory:
                self.follows.clear()
            known = self.follows[left, right] = self._apart(left, right) if self.made_once else self.merged(left + right) == [left, right]
        return known

    def _apart(self, left: bytes, right: bytes) -> bool:
        """Whether no merge joins two entries that stand: both are taken apart, last merge first, and at no time may a pair
        across the border have been merged before the merge just undone."""
        number, ranks, made, limit = self.number, self.ranks, self.made, 1 << 30
        while True:
            rank = ranks.get((left, right))
            if rank is not None and 256 + rank < limit:
                return False
            of_left, of_right = number[left], number[right]
            # among equals the left merge comes first
            if of_left > of_right:
                if left in made:
                    limit, left = of_left, made[left][1]
                elif right in made:
                    limit, right = of_right + 1, made[right][0]
                else:
                    return True
            elif right in made:
                limit, right = of_right + 1, made[right][0]
            elif left in made:
                limit, left = of_left, made[left][1]
            else:
                return True

    def stands(self, token: bytes) -> bool:
        """Whether the merges build this vocabulary entry from its own bytes."""
        known = self.own.get(token)
        if known is None:
            known = self.own[token] = self.merged(token) == [token]
        return known

    def table(self, data: bytes) -> list[int]:
        """count[i]: tokens of the first i bytes of a piece."""
        last: list[bytes] = [b""]
        count = [0]
        vocabulary, longest, own, follows = self.vocabulary, self.longest, self.own.get, self.follows.get
        for end in range(1, len(data) + 1):
            for start in range(max(0, end - longest), end):
                token = data[start:end]
                if token not in vocabulary:
                    continue
                stands = own(token)
                if stands is None:
                    stands = self.stands(token)
                if not stands:
                    continue
                if not start:
                    break
                before = last[start]
                fits = follows((before, token))
                if fits is None:
                    fits = self.may_follow(before, token)
                if fits:
                    break
            last.append(token)
            count.append(count[start] + 1)
        return count

    def total(self, piece: str) -> int:
        known = self.totals.get(piece)
        if known is None:
            data = piece.encode()
            known = 1 if data in self.vocabulary and self.stands(data) else self.table(data)[-1]
            if len(piece) <= 64:
                if len(self.totals) >= self.memory:
                    self.totals.clear()
                self.totals[piece] = known
        return known

    # --- whole texts ------------------------------------------------------------------------------

    def segments(self, text: str) -> Iterator[tuple[int, str, bool]]:
        """The text cut at special tokens: (start, segment, whether it is a special token)."""
        at = 0
        if self.special and any(s in text for s in self.specials):
            for found in self.special.finditer(text):
                if found.start() > at:
                    yield at, text[at : found.start()], False
                yield found.start(), found.group(), True
                at = found.end()
        if at < len(text):
            yield at, text[at:], False

    def pieces(self, segment: str) -> list[str]:
        if self.unsettled.search(segment):
            return [segment[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(segment)]
        return self.piece.findall(segment)

    def count(self, text: str) -> int:
        return sum(1 if special else self.count_plain(s) for _, s, special in self.segments(text))

    def prefixes(self, text: str) -> np.ndarray:
        """Tokens of each of the text's prefixes, the empty one first, the whole text last."""
        counts = np.zeros(len(text) + 1, dtype=np.int64)
        base, before = 0, ""
        for start, segment, special in self.segments(text):
            if special:
                tail, known = self._tail(before)
                for k in range(1, len(segment)):
                    counts[start + k] = base - known + self.count_plain(tail + segment[:k])
                base += 1
                counts[start + len(segment)] = base
                before = ""
            else:
                counts[start : start + len(segment) + 1] = base + self._segment_prefixes(segment)
                base = int(counts[start + len(segment)])
                before = segment
        return counts

    def count_plain(self, text: str) -> int:
        total, known = self.total, self.totals.get
        return sum(known(piece) or total(piece) for piece in self.pieces(text))

    def _tail(self, segment: str) -> tuple[str, int]:
        """What a following character can still change: from the last piece with a letter on, and its tokens."""
        found = self.pieces(segment)
        k = len(found) - 1
        while k > 0 and self.blanks.fullmatch(found[k]):
            k -= 1
        return "".join(found[max(k, 0) :]), sum(map(self.total, found[max(k, 0) :]))

    def _segment_prefixes(self, segment: str) -> np.ndarray:
        counts = np.zeros(len(segment) + 1, dtype=np.int64)
        base, start, run_start, run_base = 0, 0, -1, 0
        for piece in self.pieces(segment):
            data = piece.encode()
            table = self.table(data)
            ends = np.cumsum([len(c.encode()) for c in piece])
            inside = np.array(table)[ends]
            if piece in CONTRACTIONS:
                # cut short, it is an apostrophe and a letter
                inside[:-1] = np.arange(1, len(piece))
            counts[start + 1 : start + len(piece) + 1] = base + inside
            # a prefix that ends in white space ends in one piece: the whole run up to there
            blanks = self.blanks.match(piece).end()
            if blanks:
                if run_start < 0:
                    run_start, run_base = start, base
                run = segment[run_start : start + blanks].encode()
                table = self.table(run)
                at = len(segment[run_start:start].encode())
                for k in range(blanks):
                    at += len(piece[k].encode())
                    counts[start + k + 1] = run_base + table[at]
            base += int(inside[-1])
            if blanks < len(piece):
                run_start = -1
            start += len(piece)
        counts[len(segment)] = base
        return counts


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def counted(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: id, n_bytes (UTF-8), n_chars, n_tokens. One pass, no shuffle."""
    id_type = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            texts = as_bytes(batch.column(1))
            decoded = [t.decode() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(map(len, decoded), pa.int64()),
                 pa.array([own.count(t) for t in decoded], pa.int64())],
                names=["id", "n_bytes", "n_chars", "n_tokens"],
            )

    narrow = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"id {id_type}, n_bytes bigint, n_chars bigint, n_tokens bigint")


def prefix_table(
    docs: DataFrame, path: str, block: int = 4096, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Counts at every prefix: rows (id, block, counts), `counts[i]` for the first block*`block`+i characters.

    The last block of a text holds the count of the whole text. An empty text has one block, [0].
    """
    id_type = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            for row in range(batch.num_rows):
                counts = own.prefixes(as_bytes(batch.column(1).slice(row, 1))[0].decode())
                parts = [counts[at : at + block] for at in range(0, len(counts), block)]
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([batch.column(0).slice(row, 1)] * len(parts)), pa.array(range(len(parts)), pa.int64()),
                     pa.array([p.tolist() for p in parts], pa.list_(pa.int64()))],
                    names=["id", "block", "counts"],
                )

    narrow = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"id {id_type}, block bigint, counts array<bigint>")


def tokens_of_prefix(table: DataFrame, length: Column, block: int = 4096) -> DataFrame:
    """The stored count of the prefix of `length` characters of each document, read from its table."""
    return table.filter(F.col("block") == F.floor(length / block)).select("id", F.get("counts", (length % block).cast("int")).alias("n_tokens"))


def longest_within(table: DataFrame, limit: int, block: int = 4096) -> DataFrame:
    """Per document, the characters of the longest prefix of at most `limit` tokens."""
    at = F.filter(F.sequence(F.lit(0), F.size("counts") - 1), lambda i: F.get("counts", i) <= limit)
    best = F.col("block") * block + F.array_max(at)
    return table.groupBy("id").agg(F.max(best).alias("n_chars"))
