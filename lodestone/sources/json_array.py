"""A reader of giant top-level JSON arrays that many tasks share, by byte ranges.

Where a range begins it is unknown whether that is within a string and how deep. So a first pass summarises every range
for both cases: whether it ends within a string, and how far it goes up or down. These few numbers are folded over the ranges
of a file, which tells each range its true beginning; then each reads the elements that begin in it, the last one
beyond its end. Strictness is that of a plain parse: no other value than an array, no missing or extra comma, nothing
behind the closing bracket, no truncation, no element that is not JSON.

    read_json_array(spark, path, "id string, turns array<struct<...>>")
    spark.read.format("json_array").load(path)      # (element string), after register(spark)
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLIT_BYTES = 32 << 20
WHITE = b" \t\n\r"
QUOTE, SLASH, COMMA = ord('"'), ord("\\"), ord(",")
OPEN, CLOSE = b"[{", b"]}"


class JsonArrayError(ValueError):
    pass


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:/"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def files_of(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the files of a folder, in order; hidden ones are left out."""
    store, at = open_store(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = sorted((i.base_name, i.size) for i in store.get_file_info(fs.FileSelector(at)) if i.type == fs.FileType.File)
    return [(f"{path.rstrip('/')}/{name}", size) for name, size in found if name[0] not in "._"]


def escaped(data: np.ndarray, before: int) -> np.ndarray:
    """Which bytes follow an odd run of backslashes; ``before`` backslashes precede the data."""
    slash = data == SLASH
    at = np.arange(len(data))
    last_other = np.maximum.accumulate(np.where(slash, -1, at))
    run = np.where(last_other >= 0, at - last_other, at + 1 + before)  # backslashes that end here
    ends = np.where(slash, run, 0)
    return np.concatenate(([before], ends[:-1])) % 2 == 1 if len(data) else np.zeros(0, bool)


def backslashes_before(data: bytes) -> int:
    return len(data) - len(data.rstrip(b"\\"))


@dataclass
class Marks:
    """A range's bytes with what each means, if the range begins within a string or not."""

    inside: np.ndarray  # before each byte
    level: np.ndarray  # after each byte, relative to the beginning
    ends_inside: bool

    @classmethod
    def of(cls, data: np.ndarray, inside: bool, before: int) -> Marks:
        quote = (data == QUOTE) & ~escaped(data, before)
        parity = np.cumsum(quote)
        inside_before = ((parity - quote + inside) % 2).astype(bool)
        up = np.isin(data, np.frombuffer(OPEN, np.uint8)) & ~inside_before
        down = np.isin(data, np.frombuffer(CLOSE, np.uint8)) & ~inside_before
        level = np.cumsum(up.astype(np.int64) - down)
        return cls(inside_before, level, bool((int(parity[-1]) if len(data) else 0) + inside & 1))


def summary(data: bytes, before: int) -> list[tuple[bool, int, bool]]:
    """(ends within a string, levels gained, has a bracket) of a range, if it begins outside a string and if inside one."""
    array = np.frombuffer(data, np.uint8)
    found = [Marks.of(array, inside, before) for inside in (False, True)]
    return [(m.ends_inside, int(m.level[-1]) if len(array) else 0, bool((m.level != 0).any())) for m in found]


def read_range(store: fs.FileSystem, at: str, start: int, end: int) -> tuple[bytes, int]:
    """A range's bytes and how many backslashes precede it."""
    with store.open_input_file(at) as f:
        before, reach = 0, min(start, 64)
        while reach:
            f.seek(start - reach)
            before = backslashes_before(f.read(reach))
            if before < reach or reach == start:
                break
            reach = min(start, reach * 8)
        f.seek(start)
        return f.read(end - start), before


@dataclass
class Range(InputPartition):
    """A byte range of a file with its beginning: within a string or not, how deep, and whether the array is behind it."""

    path: str
    start: int
    end: int
    size: int
    inside: bool
    level: int
    opened: bool

    def __init__(self, path: str, start: int, end: int, size: int, inside: bool, level: int, opened: bool):
        super().__init__(None)
        self.path, self.start, self.end, self.size, self.inside, self.level, self.opened = path, start, end, size, inside, level, opened


def cut_up(path: str, split: int) -> list[tuple[str, int, int, int]]:
    """(path, start, end, size) of all ranges of all files; an empty file is one range, which is an error to read."""
    return [(p, a, min(a + split, n), n) for p, n in files_of(path) for a in range(0, max(n, 1), split)]


def begun(ranges: list[tuple[str, int, int, int]], found: list[list[tuple[bool, int, bool]]]) -> list[Range]:
    """The ranges with their beginnings, by folding the summaries of each file."""
    out, inside, level, opened = [], False, 0, False
    for (path, start, end, size), by_case in zip(ranges, found):
        if start == 0:
            inside, level, opened = False, 0, False
        out.append(Range(path, start, end, size, inside, level, opened))
        ends, gained, brackets = by_case[inside]
        inside, level, opened = bool(ends), level + gained, opened or bool(brackets)
    return out


def elements(own: Range, chunk: int = 1 << 20) -> Iterator[str]:
    """The elements that begin in a range. What parts them is checked where it stands: the range that holds an element's
    beginning checks what comes before it, the range that holds the array's end what comes after."""
    store, at = open_store(own.path)
    data, before = read_range(store, at, own.start, own.end)
    array = np.frombuffer(data, np.uint8)
    marks = Marks.of(array, own.inside, before)
    level = marks.level + own.level
    fail = lambda why, place: JsonArrayError(f"{own.path}, byte {own.start + int(place)}: {why}")
    outside = ~marks.inside
    white = np.isin(array, np.frombuffer(WHITE, np.uint8)) & outside
    prior = np.concatenate(([own.level], level[:-1])) if len(array) else np.zeros(0, np.int64)
    if (level < 0).any():
        raise fail("a bracket too many", np.flatnonzero(level < 0)[0])
    # Bytes of the array itself: its brackets, commas and white space. All others are of an element.
    of_array = outside & ((np.minimum(prior, level) == 0) | ((prior == 1) & (level == 1) & (array == COMMA)))
    if ((prior == 0) & outside & ~white & ~((array == OPEN[0]) & (level == 1))).any():
        raise fail("content outside the array", np.flatnonzero((prior == 0) & outside & ~white)[-1])
    opens = np.flatnonzero(outside & (prior == 0) & (level == 1))
    if len(opens) + own.opened > 1 and len(opens):
        raise fail("a second array", opens[-1])
    if (outside & (prior == 1) & (level == 0) & (array != CLOSE[0])).any():
        raise fail("the array is closed by a brace", np.flatnonzero((prior == 1) & (level == 0))[0])
    marks_at = np.flatnonzero(of_array & ~white)
    if own.end == own.size and not (own.opened or len(opens)):
        raise fail("not a top-level array", 0)
    if own.end == own.size and (level[-1] != 0 or marks.ends_inside):
        raise fail("truncated", len(array))
    with store.open_input_file(at) as f:
        for k in marks_at:
            if array[k] == CLOSE[0] and level[k] == 0:
                continue
            # An opening bracket or a comma: the element that follows belongs to this range.
            text, after = following(f, own.start + int(k) + 1, data[int(k) + 1 :], own.size, chunk)
            if not text.strip(WHITE):
                if array[k] == OPEN[0] and after == CLOSE[:1]:
                    continue
                raise fail("an element is missing", k)
            if not after:
                raise fail("truncated", k)
            yield checked(text, fail, k)


def following(f: pa.NativeFile, start: int, held: bytes, size: int, chunk: int) -> tuple[bytes, bytes]:
    """The bytes from ``start`` up to the next comma or bracket of the array itself, and that byte; ``held`` are those at
    hand, more are read as they are needed."""
    text, done, inside, level, before = held, 0, False, 0, 0
    look = 4096
    while True:
        piece = np.frombuffer(text[done : done + look], np.uint8)
        if len(piece):
            marks = Marks.of(piece, inside, before)
            levels = marks.level + level
            prior = np.concatenate(([level], levels[:-1]))
            stop = np.flatnonzero(~marks.inside & (((prior == 0) & (piece == COMMA)) | (levels < 0)))
            if len(stop):
                end = done + int(stop[0])
                return text[:end], text[end : end + 1]
            run = backslashes_before(piece.tobytes())
            before = run + before if run == len(piece) else run
            inside, level, done = marks.ends_inside, int(levels[-1]), done + len(piece)
        look = min(look * 4, 8 << 20)
        if done >= len(text):
            if start + len(text) >= size:
                return text, b""
            f.seek(start + len(text))
            text += f.read(min(chunk, size - start - len(text)))


def checked(text: bytes, fail, place: int) -> str:
    try:
        found = text.decode().strip(WHITE.decode())
        json.loads(found)
    except (ValueError, RecursionError) as e:
        raise fail(f"not an element: {e}", place) from e
    return found


class JsonArraySource(DataSource):
    """``json_array``: the elements of the top-level arrays in a file or folder, one row each, as JSON text.

    Options: ``split`` (bytes of a range); ``ranges``, what the first pass has found, which ``read_json_array`` makes as a
    Spark job. Without it the planner reads the files once itself, which suits small ones.
    """

    @classmethod
    def name(cls) -> str:
        return "json_array"

    def schema(self) -> str:
        return "element string"

    def reader(self, schema) -> DataSourceReader:
        return JsonArrayReader(self.options)


class JsonArrayReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.split, self.found = options["path"], int(options.get("split", SPLIT_BYTES)), options.get("ranges")

    def partitions(self) -> list[Range]:
        if self.found:
            return [Range(*r) for r in json.loads(self.found)]
        ranges, found = cut_up(self.path, self.split), []
        for path, start, end, _ in ranges:
            store, at = open_store(path)
            found.append(summary(*read_range(store, at, start, end)))
        return begun(ranges, found)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for text in elements(partition):
            held.append(text)
            size += len(text)
            if size > 8 << 20 or len(held) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["element"])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["element"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(JsonArraySource)


def read_elements(spark: SparkSession, path: str, split: int = SPLIT_BYTES) -> DataFrame:
    """(element string): the first pass is a job over all ranges, of which each sends back six values."""
    register(spark)
    ranges = cut_up(path, split)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                store, at = open_store(r["path"])
                found = json.dumps(summary(*read_range(store, at, r["start"], r["end"])))
                yield pa.RecordBatch.from_arrays([pa.array([r["i"]]), pa.array([found])], names=["i", "found"])

    table = spark.createDataFrame([(i, p, a, z) for i, (p, a, z, _) in enumerate(ranges)], "i long, path string, start long, end long")
    found = sorted(table.repartitionByRange(max(1, len(ranges)), "i").mapInArrow(look, "i long, found string").collect()) if ranges else []
    known = begun(ranges, [json.loads(r["found"]) for r in found])
    text = json.dumps([[r.path, r.start, r.end, r.size, r.inside, r.level, r.opened] for r in known])
    return spark.read.format("json_array").option("split", split).option("ranges", text).load(path)


def read_json_array(spark: SparkSession, path: str, schema: str, split: int = SPLIT_BYTES) -> DataFrame:
    """The records of a top-level JSON array under a schema. An element that is no object, or has a value that its column can't
    hold, is an error. A store is any that executors can open by path or URI."""
    row = F.from_json("element", schema, {"mode": "FAILFAST"})
    is_object = F.when(F.substr(F.col("element"), F.lit(1), F.lit(1)) == "{", row).otherwise(F.raise_error(F.concat(F.lit("not an object: "), F.left("element", F.lit(60)))))
    return read_elements(spark, path, split).select(is_object.alias("r")).select("r.*")
