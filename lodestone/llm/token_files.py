"""Token ids of a corpus as flat binary files with 64-bit document offsets.

A folder holds shards, each three files of little-endian numbers without any header:

    NAME.ids      the ids of its documents one after the other, unsigned, 16 bits if the vocabulary allows, else 32
    NAME.offsets  unsigned 64 bits, one more than documents: where each begins in the ids of the whole corpus
    NAME.docs     signed 64 bits, the doc_id of each document; of the shard's first ``nulls`` documents it is null

and ``manifest``, a Parquet table with a row for each shard in order: part, name, ids_type, nulls, docs, ids, base.
Shards are ranges of doc_id, so shard by shard the files are the corpus in ascending doc_id order. A shard's base is the
prefix sum of the ids of the shards before it; the first pass counts them, the second writes the offsets.

Every attempt of a task writes under a name of its own, and the manifest has the names that successful tasks returned:
lost executors, repeated and speculative tasks leave files behind that nothing names, and these are deleted at the end.
"""

from __future__ import annotations

import os
import re
import sys
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHARD = "part int, name string, ids_type string, nulls long, docs long, ids long, low long, high long"
MANIFEST = "part int, name string, ids_type string, nulls long, docs long, ids long, base long"
# How the byte-level vocabularies cut a text into words, the commonest kind first: the kinds exclude each other but for
# contractions, which go before other signs, and white space, whose last character belongs to what follows.
SPLIT = r" ?\p{L}+| ?\p{N}+|'(?:s|t|re|ve|m|ll|d)| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Texts are cut into words in windows of about this many characters.
WINDOW = 1 << 20
CACHED_WORDS = 600_000


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder in any store that driver and executors share."""
    if re.match(r"(file:)?/", uri):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", uri)
    return fs.FileSystem.from_uri(uri)


def windows(text: str) -> Iterator[str]:
    """The text in pieces that no word of a split pattern spans: a lone space between two other characters starts a
    word, since a word holds white space at its start only, or is white space only."""
    at = 0
    edge = re.compile(r"(?<=\S) (?=\S)")
    while len(text) - at > WINDOW:
        m = edge.search(text, at + WINDOW)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


class Words(dict[str, bytes]):
    """The ids of words: of the first CACHED_WORDS met, which frequent ones are among, kept; of others made each time."""

    def __init__(self, packed: Callable[[str], bytes]):
        self.packed = packed

    def __missing__(self, word: str) -> bytes:
        found = self.packed(word)
        if len(self) < CACHED_WORDS:
            self[word] = found
        return found


class Encoder:
    """A tokenizer file's ids for whole texts, as bytes.

    ``split`` is the pattern by which the tokenizer cuts a text into words before it merges within each: then a word goes
    to the library when it is new and not at each place where it stands. Texts that hold one of the tokenizer's special
    strings, and all texts if there is no pattern, go to it whole.
    """

    def __init__(self, path: str, split: str | None, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words = regex.compile(split).findall if split else None
        self.ids_type = "<u2" if max(self.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
        self.end = np.array([end_id], self.ids_type).tobytes()
        self.code = next(c for c in "HIL" if array(c).itemsize == int(self.ids_type[2]))
        self.known = Words(self.packed)

    def packed(self, text: str) -> bytes:
        found = array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids)
        if sys.byteorder == "big":
            found.byteswap()
        return found.tobytes()

    def encode(self, text: str) -> bytes:
        if self.words is None or any(s in text for s in self.special):
            return self.packed(text) + self.end
        return b"".join([b"".join(map(self.known.__getitem__, self.words(piece))) for piece in windows(text)]) + self.end


@lru_cache(maxsize=1)
def encoder_of(path: str, split: str | None, end_id: int) -> Encoder:
    """One encoder for all tasks of a Python worker, so what one task has learned serves the next."""
    return Encoder(path, split, end_id)


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, split: str | None = None) -> DataFrame:
    """Write the ids of all docs (doc_id, text) to the folder, ``end_id`` behind each document; returns the manifest.

    A null text is empty and gives its end id alone. Null doc_ids come first; documents that repeat a doc_id are
    documents of their own, in the order of their texts' hashes and texts. Other columns are not read. An empty table
    gives a manifest without shards. A shard is a range of doc_id and text hash, sorted in its task with spill, so one
    doc_id that many rows share is several shards. Memory: one text with its words, and 16 bytes a document of a shard.
    """
    spark = docs.sparkSession
    tie = F.xxhash64("text").alias("tie")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select("doc_id", "text", tie)
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder, out, ids, lengths = TaskContext.get().partitionId(), None, None, [], []
        for b in batches:
            for at in range(0, b.num_rows, 256):
                if encoder is None:
                    encoder, (store_fs, path) = encoder_of(tokenizer, split, end_id), place(folder)
                    name = f"{part:06d}-{uuid.uuid4().hex}"
                    store_fs.create_dir(path, recursive=True)
                    out = store_fs.open_output_stream(f"{path}/{name}.ids")
                some = b.slice(at, 256)
                ids.append(some.column(0))
                for data in map(encoder.encode, some.column(1).to_pylist()):
                    lengths.append(len(data) // len(encoder.end))
                    out.write(data)
        if encoder is None:
            return
        out.close()
        doc_ids = pa.chunked_array(ids).combine_chunks()
        whole = doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
        for kind, data in (("docs", whole), ("lengths", np.array(lengths, "<u8"))):
            with store_fs.open_output_stream(f"{path}/{name}.{kind}") as f:
                f.write(data.tobytes())
        known = [int(x) for x in whole[[doc_ids.null_count, -1]]] if doc_ids.null_count < len(whole) else [None, None]
        row = [part, name, encoder.ids_type, doc_ids.null_count, len(whole), int(sum(lengths)), *known]
        types = [pa.int32(), pa.string(), pa.string(), *[pa.int64()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=[c.split()[0] for c in SHARD.split(", ")])

    shards = sorted(ordered.mapInArrow(store, SHARD).collect(), key=lambda r: r["part"])  # one row a shard
    ends = [x for r in shards for x in (r["low"], r["high"]) if x is not None]
    if ends != sorted(ends):
        raise RuntimeError("shards are not in the order of doc_id")
    bases = np.concatenate(([0], np.cumsum([r["ids"] for r in shards], dtype=np.int64)))
    rows_ = [(i, r["name"], r["ids_type"], r["nulls"], r["docs"], r["ids"], int(bases[i])) for i, r in enumerate(shards)]
    manifest = spark.createDataFrame(rows_, MANIFEST)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store_fs, path = place(folder)
        for b in batches:
            for r in b.to_pylist():
                lengths = np.frombuffer(whole_file(store_fs, f"{path}/{r['name']}.lengths"), "<u8")
                offsets = np.concatenate((np.zeros(1, "<u8"), np.cumsum(lengths, dtype="<u8"))) + np.uint64(r["base"])
                own = f"{path}/{r['name']}.{uuid.uuid4().hex}"
                with store_fs.open_output_stream(own) as f:
                    f.write(offsets.astype("<u8").tobytes())
                store_fs.move(own, f"{path}/{r['name']}.offsets")
            yield b

    if shards:
        manifest = by_shard(manifest, len(shards)).mapInArrow(number, MANIFEST)
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    sweep(folder, {r["name"] for r in shards})
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def sweep(folder: str, names: set[str]) -> None:
    """Delete the files of attempts that failed, and the lengths, which the offsets replace."""
    store_fs, path = place(folder)
    for found in store_fs.get_file_info(fs.FileSelector(path, allow_not_found=True)):
        name, _, kind = found.base_name.partition(".")
        if found.type == fs.FileType.File and (name not in names or kind not in ("ids", "offsets", "docs")):
            store_fs.delete_file(found.path)


def by_shard(manifest: DataFrame, n: int) -> DataFrame:
    return manifest.repartitionByRange(max(1, n), "part")


def whole_file(store_fs: fs.FileSystem, path: str) -> bytes:
    with store_fs.open_input_file(path) as f:
        return f.read()


def mapped(store_fs: fs.FileSystem, path: str, kind: str) -> np.ndarray:
    """A file's numbers, memory-mapped where the store is a mounted folder, else read."""
    if isinstance(store_fs, fs.LocalFileSystem):
        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
    return np.frombuffer(whole_file(store_fs, path), kind)


def each_document(folder: str, values: Any, schema: pa.Schema, rows: int = 1024):
    """A map over manifest rows to their documents: ``values`` makes a column of the ids of some documents."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store_fs, path = place(folder)
        for b in batches:
            for r in b.to_pylist():
                ids = mapped(store_fs, f"{path}/{r['name']}.ids", r["ids_type"])
                offsets = mapped(store_fs, f"{path}/{r['name']}.offsets", "<u8").astype(np.int64)
                docs = mapped(store_fs, f"{path}/{r['name']}.docs", "<i8")
                for low in range(0, len(docs), rows):
                    high = min(low + rows, len(docs))
                    own = offsets[low : high + 1]
                    doc_id = pa.array(docs[low:high], mask=np.arange(low, high) < r["nulls"])
                    local = own - r["base"]
                    found = values([ids[a:z] for a, z in zip(local[:-1], local[1:])])
                    yield pa.RecordBatch.from_arrays([doc_id, pa.array(own[:-1]), pa.array(np.diff(own)), found], schema=schema)

    return read


def read(spark: SparkSession, folder: str, values: Any, name: str, kind: pa.DataType, spark_type: str) -> DataFrame:
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), (name, kind)])
    return by_shard(manifest, manifest.count()).mapInArrow(each_document(folder, values, schema), f"doc_id long, start long, n_tokens long, {name} {spark_type}")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the folder's files."""
    arrays = lambda found: pa.array([x.astype(np.int64) for x in found], pa.list_(pa.int64()))
    return read(spark, folder, arrays, "ids", pa.list_(pa.int64()), "array<long>")


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the folder's files: the unsigned crc32 of its ids as
    little-endian unsigned 32-bit numbers."""
    sums = lambda found: pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in found], pa.int64())
    return read(spark, folder, sums, "ids_crc32", pa.int64(), "long")
