"""Log files opened in the tasks: listed, inflated and cut into records without being whole in memory.

Spark deals out folders, files and byte ranges as rows; the driver sees none of them. A file's layout is
decided from its head: one JSON value is a document, one JSON array holds a record per element, anything
else a record per line. Only an array or a compressed file is read to its end for that, an element or a
block at a time, because a missing bracket or a damaged block at the end changes what the whole file is. Plain files of
lines are then read in ranges by many tasks. A line's number is its place in its range plus the lines of the ranges before, which
are counted first. Whatever goes wrong with a file becomes its one row, with the problem.
"""

from __future__ import annotations

import codecs
import json
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterwise.kept import kept
from meterwise.operators.small import tasks_for

RANGE_BYTES = 64 << 20
# What one task lists, inspects or reads: so many files or ranges, or bytes of them, whichever asks for more tasks.
_TASK_FILES, _TASK_BYTES = 64, 1 << 20
# A file that has to be one task's stream and is larger than this hands its records on to other tasks.
STREAM_BYTES = 16 << 20
_BLOCK = 1 << 20
_GZIP = b"\x1f\x8b"
# A row group handed to Spark: so many rows or characters, whichever comes first.
_ROWS, _CHARACTERS = 4096, 4 << 20
_PROBLEMS = (OSError, EOFError, zlib.error, pa.ArrowException)
_FOUND = pa.schema([("path", pa.string()), ("size", pa.int64()), ("folder", pa.bool_()), ("problem", pa.string())])
_LAYOUT = pa.schema([("packed", pa.bool_()), ("layout", pa.string()), ("problem", pa.string())])
_PIECE = pa.schema([("path", pa.string()), ("position", pa.int64()), ("line", pa.large_string()), ("problem", pa.string())])


def filesystem(path: str) -> tuple[pa.fs.FileSystem, str]:
    """Where a path leads: local, file:, s3:, s3a:, gs:, hdfs:, whatever Arrow can open."""
    if match := re.match(r"file:/*(?=/)", path):
        return pa.fs.LocalFileSystem(), path[match.end() :]
    if "://" not in path:
        return pa.fs.LocalFileSystem(), path
    return pa.fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))


# --- bytes and characters -----------------------------------------------------------------------------


def _blocks(file: pa.NativeFile, end: int | None = None) -> Iterator[bytes]:
    while end is None or file.tell() < end:
        block = file.read(_BLOCK if end is None else min(_BLOCK, end - file.tell()))
        if not block:
            return
        yield block


def inflated(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """The content of one or more gzip members, in pieces of bounded size; zeros between them are padding."""
    member = None
    for block in blocks:
        while block:
            if member is None:
                block = block.lstrip(b"\0")
                if not block:
                    break
                member = zlib.decompressobj(wbits=31)
            data = member.decompress(block, _BLOCK)
            if data:
                yield data
            if member.eof:
                block, member = member.unused_data, None
            else:
                block = member.unconsumed_tail
    if member is not None:
        raise EOFError("compressed file ended before its end marker")


def decoded(blocks: Iterator[bytes]) -> Iterator[str]:
    """UTF-8 with what is not UTF-8 replaced."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    for block in blocks:
        if text := decoder.decode(block):
            yield text
    if text := decoder.decode(b"", True):
        yield text


def lines_of(pieces: Iterator[str]) -> Iterator[str]:
    """Lines with their ends, whatever ends them; a carriage return waits for what follows it."""
    held: list[str] = []
    for piece in pieces:
        if held and held[-1].endswith("\r"):
            piece = held.pop() + piece
        lines = piece.splitlines(keepends=True)
        last = lines[-1]
        open_end = last.endswith("\r") or last.splitlines()[0] == last
        if len(lines) > 1 or not open_end:
            lines[0] = "".join([*held, lines[0]])
            held = []
        if open_end:
            held.append(lines.pop())
        yield from lines
    if held:
        yield from "".join(held).splitlines(keepends=True)


# --- layouts ----------------------------------------------------------------------------------------------


class _Scanner:
    """JSON values one after the other out of pieces of text; holds no more than the value at hand."""

    def __init__(self, pieces: Iterator[str]):
        self.pieces, self.text, self.at, self.ended = pieces, "", 0, False
        self.decode = json.JSONDecoder().raw_decode

    def more(self) -> bool:
        """Read on until what is held has doubled; false at the end."""
        parts, wanted = [self.text[self.at :]], max(len(self.text) - self.at, 1)
        while wanted > 0 and not self.ended:
            piece = next(self.pieces, None)
            self.ended = piece is None
            if piece:
                parts.append(piece)
                wanted -= len(piece)
        self.text, self.at = "".join(parts), 0
        return len(parts) > 1

    def peek(self, blanks: str | None) -> str:
        """The next character that is no blank (None: of any kind); empty at the end."""
        while True:
            rest = self.text[self.at : self.at + 64].lstrip(blanks)
            if rest:
                self.at += min(64, len(self.text) - self.at) - len(rest)
                return rest[0]
            self.at = min(self.at + 64, len(self.text))
            if self.at == len(self.text) and not self.more():
                return ""

    def value(self) -> str:
        """The text of the next JSON value; ValueError if there is none."""
        while True:
            try:
                _, end = self.decode(self.text, self.at)
            except json.JSONDecodeError as error:
                cut = error.msg.startswith("Unterminated string") or error.pos >= len(self.text) - 16
                if not (cut and self.more()):
                    raise
                continue
            except RecursionError:
                raise ValueError("nested too deeply") from None
            # a number may go on in the next piece
            if end == len(self.text) and self.more():
                continue
            value, self.at = self.text[self.at : end], end
            return value

    def elements(self) -> Iterator[str]:
        """The elements of the array that begins here; ValueError once it turns out to be none."""
        self.at += 1
        if self.peek(" \t\n\r") == "]":
            self.at += 1
            return
        while True:
            yield self.value()
            mark = self.peek(" \t\n\r")
            if mark not in ("]", ","):
                raise ValueError("neither the next element nor the end")
            self.at += 1
            if mark == "]":
                return
            self.peek(" \t\n\r")


def layout_of(pieces: Iterator[str]) -> str:
    """blank, document, array or lines."""
    scanner = _Scanner(pieces)
    first = scanner.peek(None)
    if not first:
        return "blank"
    try:
        if first == "[":
            for _ in scanner.elements():
                pass
        else:
            scanner.value()
    except ValueError:
        return "lines"
    return "lines" if scanner.peek(None) else "array" if first == "[" else "document"


def _inspected(path: str) -> tuple[bool, str | None, str | None]:
    try:
        files, name = filesystem(path)
        with files.open_input_file(name) as file:
            packed = file.read(2) == _GZIP
            file.seek(0)
            blocks = inflated(_blocks(file)) if packed else _blocks(file)
            layout = layout_of(decoded(blocks))
            if packed:
                # damage further on makes the whole file unreadable
                for _ in blocks:
                    pass
            return packed, layout, None
    except _PROBLEMS as error:
        return False, None, str(error)


# --- rows of pieces ---------------------------------------------------------------------------------------


def _after_break(file: pa.NativeFile, at: int, size: int) -> int:
    """Where the first line begins that begins at `at` or later."""
    if at == 0:
        return 0
    file.seek(at - 1)
    while block := file.read(1 << 16):
        found = block.find(b"\n")
        if found >= 0:
            return file.tell() - len(block) + found + 1
    return size


def _range_lines(file: pa.NativeFile, start: int, end: int, size: int) -> Iterator[str]:
    first, last = _after_break(file, start, size), _after_break(file, end, size) if end < size else size
    file.seek(first)
    return lines_of(decoded(_blocks(file, last))) if first < last else iter(())


def _pieces(path: str, size: int, packed: bool, layout: str, start: int, end: int, first: int) -> Iterator[tuple[int, str]]:
    """(position, JSON text) of every record of a file or a range of it."""
    files, name = filesystem(path)
    with files.open_input_file(name) as file:
        if layout == "lines":
            lines = lines_of(decoded(inflated(_blocks(file)))) if packed else _range_lines(file, start, end, size)
            for number, line in enumerate(lines, first):
                if line := line.strip():
                    yield number, line
            return
        scanner = _Scanner(decoded(inflated(_blocks(file)) if packed else _blocks(file)))
        scanner.peek(None)
        if layout == "array":
            yield from enumerate(scanner.elements(), 1)
        else:
            yield 0, scanner.value()


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(column.to_pylist() for column in batch.columns))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    for batch in batches:
        for path, *rest in _rows(batch):
            try:
                for position, line in _pieces(path, *rest):
                    rows.append((path, position, line, None))
                    held += len(line)
                    if len(rows) == _ROWS or held > _CHARACTERS:
                        yield _batch(rows, _PIECE)
                        rows, held = [], 0
            except (*_PROBLEMS, ValueError) as error:
                # the file has changed since it was inspected
                rows.append((path, 0, None, str(error)))
    # small files share a batch
    yield _batch(rows, _PIECE)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = []
        for path, size, start, end in _rows(batch):
            n = 0
            try:
                files, name = filesystem(path)
                with files.open_input_file(name) as file:
                    n = sum(1 for _ in _range_lines(file, start, end, size))
            except _PROBLEMS:
                pass  # reading the range will report it
            counts.append(n)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(counts, pa.int64())], ["path", "start", "lines"]
        )


def _children(suffixes: tuple[str, ...], root: bool) -> Callable:
    """What lies in each folder of a batch; the root may be a file, which counts whatever its suffix."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (path,) in _rows(batch):
                rows: list[tuple] = []
                try:
                    files, name = filesystem(path)
                    prefix = path.rstrip("/")[: len(path.rstrip("/")) - len(name.rstrip("/"))]
                    info = files.get_file_info(name)
                    if root and info.type == pa.fs.FileType.File:
                        rows.append((path, info.size, False, None))
                    else:
                        for child in files.get_file_info(pa.fs.FileSelector(name)):
                            folder = child.type == pa.fs.FileType.Directory
                            if folder or child.path.lower().endswith(suffixes):
                                rows.append((prefix + child.path, child.size, folder, None))
                except _PROBLEMS as error:
                    rows.append((path, None, False, str(error)))
                for k in range(0, len(rows), _ROWS):
                    yield _batch(rows[k : k + _ROWS], _FOUND)

    return listed


def listed(spark: SparkSession, path: str, suffixes: tuple[str, ...]) -> DataFrame:
    """(path, size, problem) of every file under `path` with one of the suffixes, or of the file it names.

    Folders are listed by tasks, one level of the tree after the other.
    """
    ends = tuple(s.lower() for s in suffixes)
    folders, found = spark.createDataFrame([(path,)], "path string"), []
    while True:
        level = folders.mapInArrow(_children(ends, not found), "path string, size long, folder boolean, problem string")
        found.append(kept(level))
        folders = found[-1].filter("folder").select("path")
        if folders.isEmpty():
            break
        folders = folders.repartition(tasks_for(folders.count(), _TASK_FILES))
    whole = found[0]
    for level in found[1:]:
        whole = whole.unionByName(level)
    return whole.filter("NOT folder").select("path", "size", "problem")


def _tasks(files: int, size: int | None) -> int:
    """How many tasks open so many files or ranges: by a number of its own, as rows that only name them are few bytes."""
    return max(tasks_for(files, _TASK_FILES), min(max(files, 1), tasks_for(size or 0, _TASK_BYTES)))


def pieces(
    spark: SparkSession, path: str, suffixes: tuple[str, ...], range_bytes: int = RANGE_BYTES, stream_bytes: int = STREAM_BYTES
) -> DataFrame:
    """(path, position, line, problem): the JSON text of every record, lines and elements numbered from 1.

    A file that is one record has position 0. A file or folder that cannot be read is one row with the problem.
    Arrays and compressed files above `stream_bytes` are read by one task each, and their records dealt over others.
    """
    files = listed(spark, path, suffixes)

    def inspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = _batch([_inspected(p) for p in batch.column(0).to_pylist()], _LAYOUT)
            yield pa.RecordBatch.from_arrays([*batch.columns, *seen.columns], ["path", "size", *_LAYOUT.names])

    # files one by one over the tasks: what each takes has little to do with its neighbours
    layouts = files.filter("problem IS NULL").select("path", "size")
    layouts = layouts.repartition(_tasks(*layouts.agg(F.count("*"), F.sum("size")).first()))
    layouts = kept(layouts.mapInArrow(inspect, "path string, size long, packed boolean, layout string, problem string"))
    broken = files.filter("problem IS NOT NULL").select("path", "problem").unionByName(
        layouts.filter("problem IS NOT NULL").select("path", "problem")
    )
    read = layouts.filter("problem IS NULL AND layout <> 'blank'")
    split = (F.col("layout") == "lines") & ~F.col("packed") & (F.col("size") > range_bytes)
    starts = F.when(split, F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long")))
    ranges = read.select(
        "path", "size", "packed", "layout", split.alias("split"),
        F.explode(F.coalesce(starts, F.array(F.lit(0).cast("long")))).alias("start"),
    )
    ranges = ranges.withColumn("end", F.when(F.col("split"), F.least(F.col("start") + range_bytes, "size")).otherwise(F.col("size")))
    stream = (F.col("packed") | (F.col("layout") == "array")) & (F.col("size") > stream_bytes)
    number, size, cut, streams, streamed = ranges.agg(
        F.count("*"), F.sum(F.col("end") - F.col("start")), F.count_if("split"), F.count_if(stream), F.sum(F.when(stream, F.col("size")))
    ).first()
    parts = ranges.filter("split").select("path", "size", "start", "end").repartition(max(1, min(cut, _tasks(cut, size))))
    counts = parts.mapInArrow(_counted, "path string, start long, lines long")
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("path", "start", (F.coalesce(F.sum("lines").over(before), F.lit(0)) + 1).alias("first"))
    dealt = ranges.join(counts, ["path", "start"], "left").select(
        "path", "size", "packed", "layout", "start", "end", F.coalesce("first", F.lit(1).cast("long")).alias("first")
    )

    def read_by(tasks: int, some: DataFrame) -> DataFrame:
        return some.repartition(tasks).mapInArrow(_read, "path string, position long, line string, problem string")

    if streams:
        records = read_by(streams, dealt.filter(stream)).repartition(max(8, tasks_for(streamed, _TASK_BYTES)))
        if number > streams:
            records = records.unionByName(read_by(_tasks(number, size), dealt.filter(~stream)))
    else:
        records = read_by(_tasks(number, size), dealt)
    lost = broken.select("path", F.lit(0).cast("long").alias("position"), F.lit(None).cast("string").alias("line"), "problem")
    return records.unionByName(lost)
