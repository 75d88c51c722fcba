"""Near copies by the Jaccard similarity of word shingles, exact and without pairs as rows.

A text's set is the XXH64 of its runs of WORDS words (of the whole text, if it is shorter). Equal sets are folded to one.

First pass, over all texts: in any one order of all shingles, two sets of similarity t or more share one of the first
n - ceil(t * n) + 1 shingles of each (n: its size). A little more than these, l(n) more, are taken in an order by hash;
similar sets share at least the smaller of their l in these. Sets that share fewer with any others are alone.

Second pass, over the rest: sets of a similar size are cut by hash into more parts than similar sets have differing
shingles, so two similar sets have an equal part. Sets meet in groups, one for each part's content: such a group holds
hardly anything but near copies. Sets with too many empty parts meet in groups of their first shingles as well.

Shingles that a sample of the texts shows to be common are left out of parts, come last in the order, and always count as
shared; the sample decides on the work, never on the result.

Groups with the same members are searched once. The sets that may have a partner go by op3's method first: the forest of
their SimHash fingerprints within ``max_bits`` bits, found over vantage-point trees, and in its components an exact comparison
of the sets. Fingerprints of similar sets may differ in more bits, so the groups complete this: those whose members are
joined are done; of the others each set meets a part of its largest group and the group's few smallest keys, and what is still
not joined is searched whole, above ``group_rows`` in pair-wise cells. There parity sketches, a thirtieth of a set in size, go
first: they differ in no more bits than the sets in shingles, so only sets with a possible partner follow, and few times
to a second group of the two. Each search returns a spanning forest of its links.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import bit_of, cut, has_bit, join_hot, key_bits
from lodestone.llm.simhash import Forest, close_forest, components, fingerprint_of, keep_first, named_classes, shingle_hashes

WORDS = 5
SIMILARITY = 0.8
MAX_BITS = 8


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct shingles of a text; empty for a text without words."""
    return np.unique(shingle_hashes(text, words)).view(np.int64)


def set_key(own: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())).astype(np.int64))


def surplus(n: int, similarity: float) -> int:
    """l(n): how many shingles the first pass takes of a set of n, besides those that similar sets need not share."""
    return int((1 - similarity) * n / 3 + 1e-9) + 1


def head(own: np.ndarray, common: np.ndarray, counts: np.ndarray, similarity: float) -> tuple[np.ndarray, int]:
    """The first pass's shingles of a set that are not common, and how many of these others must hold.

    Two similar sets x and y share at least ceil(t * n) shingles, n the larger size. The i-th of the shared ones,
    in the common order, is among the first n - ceil(t * n) + i of either set. So the first n - ceil(t * n) + l(n) of
    each hold min(l(x), l(y)) of them, and the partner's size is t * n at least.
    """
    n = len(own)
    least = math.ceil(similarity * n - 1e-9)
    rest, last = parts(own, common, counts)
    take = n - least + surplus(n, similarity)
    return rest[:take], surplus(least, similarity) - max(0, min(take, n) - len(rest))


def parts(own: np.ndarray, common: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A set's other shingles, and its common ones by count."""
    if not len(common) or not len(own):
        return own, own[:0]
    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
    hit = common[at] == own
    return own[~hit], own[hit][np.lexsort((own[hit], counts[at[hit]]))]


def size_bounds(similarity: float, top: int = 1 << 40) -> np.ndarray:
    """Lower ends of the size levels: similar sets are of one level or of two neighbouring ones."""
    ends = [1]
    while ends[-1] < top:
        ends.append(max(ends[-1] + 1, math.ceil(ends[-1] / similarity - 1e-9)))
    return np.array(ends, np.int64)


def mixed(x: np.ndarray, level: int, kind: int) -> np.ndarray:
    """64-bit hashes of unsigned values, different for each level and kind."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(2 * level + kind + 1) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(29))


def signatures(own: np.ndarray, common: np.ndarray, counts: np.ndarray, similarity: float, bounds: np.ndarray) -> np.ndarray:
    """Hashes of which any two similar sets share one; none for the empty set, which is only similar to itself.

    A set of n meets sets of its own level, and of the next if those can be similar. On a level with sizes up to U, similar
    sets differ in at most k = 2 U (1 - t) / (1 + t) shingles, each of which spoils one part, so of k + 1 + k // 8 parts
    1 + k // 8 at least are equal. A set that fills more than k parts has one of these filled. Two that do not
    meet by their first shingles.
    """
    n = len(own)
    if not n:
        return np.zeros(0, np.int64)
    rest, last = parts(own, common, counts)
    values = np.sort(rest.view(np.uint64))
    at = int(np.searchsorted(bounds, n, "right")) - 1
    found = []
    for level in (at, at + 1):
        if level > at and n / similarity + 1e-9 < bounds[level]:
            break
        k = int(2 * (int(bounds[level + 1]) - 1) * (1 - similarity) / (1 + similarity) + 1e-9)
        part = ((values >> np.uint64(32)) * np.uint64(k + 1 + k // 8)) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else part
        if len(starts):
            found.append(mixed(np.add.reduceat(mixed(values, 0, 0), starts), level, 0))
        if len(starts) <= k:
            first = np.concatenate((rest, last))[: n - math.ceil(similarity * n - 1e-9) + 1]
            found.append(mixed(first.view(np.uint64), level, 1))
    return np.unique(np.concatenate(found)).view(np.int64)


def sketch(own: np.ndarray) -> bytes:
    """Bit b says whether an odd number of the set's shingles end in b; two to four bits a shingle, a power of two."""
    bits = max(64, 1 << (2 * len(own)).bit_length())
    return np.packbits(np.bincount((own.view(np.uint64) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def smaller_parts(parts: list[np.ndarray], part: int) -> np.ndarray:
    """A row for each set, a column for each of their parts below this one: whether the set has it."""
    own = [np.asarray(p, np.int64) for p in parts]
    own = [p[p < part] for p in own]
    every = np.unique(np.concatenate(own)) if own else np.zeros(0, np.int64)
    found = np.zeros((len(own), len(every)), np.uint8)
    for row, p in enumerate(own):
        found[row, np.searchsorted(every, p)] = 1
    return found


def hopeful(sketches: list[bytes], size: np.ndarray, root: np.ndarray, similarity: float, below: np.ndarray | None = None) -> np.ndarray:
    """Whether each set may be similar to one of another root. Two sketches differ in no more bits than the sets in
    shingles; a sketch of twice the bits is folded to the shorter by exclusive or. Two sets that share a part ``below``
    this group's meet in that part's group, and so not here."""
    length = np.array([len(s) for s in sketches])
    found = np.zeros(len(sketches), bool)
    for own in np.unique(length):
        at = np.flatnonzero((length == own) | (length == 2 * own))
        table = np.empty((len(at), own // 8), np.uint64)
        for row, k in enumerate(at):
            bits = np.frombuffer(sketches[k], np.uint64)
            table[row] = bits if length[k] == own else bits[: own // 8] ^ bits[own // 8 :]
        n, r = size[at], root[at]
        for row in np.flatnonzero(length[at] == own):
            other = (r != r[row]) & (np.minimum(n, n[row]) >= similarity * np.maximum(n, n[row]) - 1e-9)
            other = np.flatnonzero(other)
            most = (1 - similarity) / (1 + similarity) * (n[other] + n[row]) + 1e-9
            hit = other[np.bitwise_count(table[other] ^ table[row]).sum(axis=1) <= most]
            if below is not None and len(hit):
                mine = np.flatnonzero(below[at[row]])
                hit = hit[~below[np.ix_(at[hit], mine)].any(axis=1)]
            if len(hit):
                found[at[row]] = True
                found[at[hit]] = True
    return found


def common_shingles(docs: DataFrame, words: int, sample_rows: int, share: float = 0.001, most: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that stand in more than this share of about sample_rows texts, with their counts."""
    n = docs.count()
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(max(1, n // sample_rows))) == 0).select("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py(), words) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))], names=["shingle"])

    rows = some.mapInArrow(scan, "shingle long").groupBy("shingle").count().where(F.col("count") > max(2, share * min(n, sample_rows)))
    rows = sorted(tuple(r) for r in rows.orderBy(F.desc("count"), "shingle").limit(most).collect())
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)


def link_sets(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """The root row of each set, linked at this similarity; breadth-first, linked sets are not compared again."""
    forest, size = Forest(len(sets)), np.array([len(s) for s in sets], np.int64)
    shingles = np.unique(np.concatenate(sets))
    numbers = [np.searchsorted(shingles, s) for s in sets]
    mark, left = np.zeros(len(shingles), bool), np.arange(len(sets))
    while len(left):
        frontier, left, members = [int(left[0])], left[1:], [int(left[0])]
        flat = np.concatenate([numbers[k] for k in left]) if len(left) else None
        starts = np.concatenate(([0], np.cumsum(size[left])[:-1])) if len(left) else None
        while frontier and len(left):
            x = frontier.pop()
            mark[numbers[x]] = True
            both = np.add.reduceat(mark[flat], starts, dtype=np.int64)
            mark[numbers[x]] = False
            hit = both >= similarity * (size[x] + size[left] - both) - 1e-9
            if hit.any():
                frontier += left[hit].tolist()
                members += left[hit].tolist()
                left = left[~hit]
                if len(left):
                    flat = np.concatenate([numbers[k] for k in left])
                    starts = np.concatenate(([0], np.cumsum(size[left])[:-1]))
        forest.join(np.array(members))
    return np.array([forest.find(i) for i in range(len(sets))], np.int64)


def in_groups(df: DataFrame, by: list[str], work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """work applied to each group of few and small rows, without a Python call from the JVM for each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            ids = b[by].to_numpy(np.int64)
            starts = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1
            edges = [0, *starts.tolist()]
            done = [work(b.iloc[low:high]) for low, high in zip(edges, edges[1:])]
            if done:
                yield pd.concat(done)
            held = b.iloc[edges[-1] :]
        if held is not None and len(held):
            yield work(held)

    return df.repartition(*by).sortWithinPartitions(*by).mapInPandas(run, schema)


def near_copies(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, group_rows: int = 400, sample_rows: int = 5000, hubs: int = 8, known_parts: int = 16, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, component_id) of every row of docs: documents of at least this similarity are linked, and
    component_id is the smallest doc_id of the links' connected component (null if it has none)."""
    spark = docs.sparkSession
    common = spark.sparkContext.broadcast(common_shingles(docs, words, sample_rows))
    bounds = size_bounds(similarity)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                sets = [shingle_set(t.as_py(), words) for t in some.column(2)]
                firsts = [head(s, *common.value, similarity) for s in sets]
                first = pa.array([f for f, _ in firsts], pa.list_(pa.int64()))
                need = pa.array([k for _, k in firsts], pa.int32())
                key = pa.array([set_key(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), key, need, first], names=["doc_id", "rid", "key", "need", "first"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("rid"), "text")
    own = cut(rows.mapInArrow(scan, "doc_id long, rid long, key long, need int, first array<long>"), "sets")
    folded = cut(own.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"), F.min("rid").alias("rid"), F.min("need").alias("need")), "distinct-sets")
    total = own.count()
    # Equal sets have one key, so a shingle is shared if it has two keys. Of sets with very many copies one is taken.
    hot = F.broadcast(folded.where(F.col("n") * 1000 > total).select("key"))
    once = own.join(hot, "key", "left_semi").groupBy("key").agg(F.max("first").alias("first"))
    met = own.join(hot, "key", "left_anti").select("key", "first").unionByName(once).select("key", F.explode("first").alias("shingle"))
    w = Window.partitionBy("shingle")
    met = met.withColumn("low", F.min("key").over(w)).withColumn("high", F.max("key").over(w))
    met = met.where("low <> high").groupBy("key").agg(F.countDistinct("shingle").alias("met"))
    near = folded.join(met, "key", "left").where((F.col("need") <= 0) | (F.col("met") >= F.col("need")))
    near = cut(near.select("key", "rid"), "candidates")

    bits = spark.sparkContext.broadcast(key_bits(near, "rid"))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sets of texts that may be candidates; which are, the join says."""
        for b in batches:
            some = b.filter(pa.array(has_bit(b.column(2).to_numpy(), bits.value)))
            for at in range(0, some.num_rows, 256):
                few = some.slice(at, 256)
                hashes = [shingle_hashes(t.as_py(), words) for t in few.column(1)]
                sets = [np.unique(h).view(np.int64) for h in hashes]
                size, sketches = pa.array([len(s) for s in sets], pa.int32()), pa.array([sketch(s) for s in sets], pa.binary())
                fp = pa.array([fingerprint_of(h) for h in hashes], pa.int64())
                yield pa.RecordBatch.from_arrays([few.column(0), fp, size, sketches, pa.array(sets, pa.list_(pa.int64()))], names=["rid", "fp", "size", "sketch", "own"])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [signatures(np.asarray(x.values, np.int64), *common.value, similarity, bounds) for x in b.column(1)]
            keys = np.repeat(b.column(0).to_numpy(), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.concatenate(found))], names=["key", "part"])

    asked = rows.select("rid", "text", bit_of("rid", bits.value).alias("at"))
    sets = asked.mapInArrow(again, "rid long, fp long, size int, sketch binary, own array<long>").join(near, "rid")
    sets = cut(sets.dropDuplicates(["rid"]).select("key", "fp", "size", "sketch", "own"), "own-sets")
    at = cut(sets.select("key", "own").mapInArrow(sign, "key long, part long"), "parts")
    groups = at.groupBy("part").agg(F.count("*").alias("n"), F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("who")).where("n > 1")
    groups = cut(groups.groupBy("n", "who").agg(F.min("part").alias("part")).select("part", "n"), "groups")
    part_bits = spark.sparkContext.broadcast(key_bits(groups, "part"))

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(has_bit(b.column(2).to_numpy(), part_bits.value))).select(["key", "part"])

    # Most parts are a set's own; those of no group are left out before the shuffle.
    shared = at.select("key", "part", bit_of("part", part_bits.value).alias("at")).mapInArrow(grouped, "key long, part long")
    members = cut(join_hot(shared, groups, "part", groups, at.count()), "members")

    def link(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("key")
        key = g["key"].to_numpy(np.int64)
        root = link_sets([np.asarray(s, np.int64) for s in g["own"]], similarity)
        has = np.flatnonzero(root != np.arange(len(key)))
        return pd.DataFrame({"src": key[has], "dst": key[root[has]]})

    def asked_sets(some: DataFrame, *columns: str) -> DataFrame:
        """Columns of the sets that ``some`` names, and of few others: the rest is not shuffled for the join."""
        held = spark.sparkContext.broadcast(key_bits(some.select("key").distinct(), "key"))

        def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(has_bit(b.column(b.num_columns - 1).to_numpy(), held.value))).select(["key", *columns])

        rows = sets.select("key", *columns)
        return rows.withColumn("at", bit_of("key", held.value)).mapInArrow(kept, rows.schema)

    def links_of(some: DataFrame) -> DataFrame:
        dealt = some.join(asked_sets(some, "own"), "key").select("key", "own", "part", "i", "j")
        return cut(dealt.groupBy("part", "i", "j").applyInPandas(link, "src long, dst long").distinct(), "links")

    def sliced(some: DataFrame) -> DataFrame:
        """Of classes (key, part, n) the slices of at most about group_rows; a class's smallest keys are in all of its slices."""
        some = cut(some.select("key", "part", F.ceil(F.col("n") / group_rows).cast("int").alias("slices")), "classes")
        order = Window.partitionBy("part").orderBy("key")
        hub = some.where("slices > 1").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= hubs)
        hub = hub.select("key", "part", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("i"))
        some = some.select("key", "part", F.pmod(F.xxhash64("key"), F.col("slices")).cast("int").alias("i")).unionByName(hub).distinct()
        return some.withColumn("j", F.lit(0))

    def state(links: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Members with their root as far as these links go, and the groups that have several."""
        joined = members.join(components(links).withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
        joined = cut(joined.select("key", "part", "n", "root"), "joined")
        parted = joined.groupBy("part").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.first("n").alias("n")).where("low <> high")
        return joined, cut(parted.select("part", "n"), "parted")

    def chosen(g: pd.DataFrame) -> pd.DataFrame:
        below = smaller_parts(g["parts"].tolist(), int(g["part"].iloc[0]))
        keep = hopeful(g["sketch"].tolist(), g["size"].to_numpy(np.int64), g["root"].to_numpy(np.int64), similarity, below)
        return g.loc[keep, ["key", "part", "i", "j"]]

    # The sets of each class of close fingerprints are compared first.
    close = components(close_forest(sets.select("fp").distinct(), max_bits)).withColumnRenamed("node", "fp")
    close = cut(sets.select("key", "fp").join(close, "fp", "left").select("key", F.coalesce("root", "fp").alias("part")), "close")
    links = links_of(sliced(close.join(close.groupBy("part").agg(F.count("*").alias("n")).where("n > 1"), "part")))
    joined, parted = state(links)
    # A group whose members are joined can add nothing. A set of others meets one slice of the largest of these.
    largest = Window.partitionBy("key").orderBy(F.desc("n"), "part")
    some = joined.join(parted.select("part"), "part", "left_semi").withColumn("_r", F.row_number().over(largest)).where("_r = 1")
    links = links.unionByName(links_of(sliced(some)))
    joined, parted = state(links)
    salts = F.when(F.col("n") > group_rows, F.ceil(F.col("n") * 2 / group_rows)).otherwise(1).cast("int")
    cell = F.pmod(F.xxhash64("key", "part"), F.col("salts")).cast("int")
    rest = joined.join(parted.select("part", salts.alias("salts")), "part").withColumn("cell", cell)
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    rest = rest.select("key", "root", "part", F.least("cell", "other").alias("i"), F.greatest("cell", "other").alias("j"))
    # A set brings its smallest parts along: two that share one of these below a group's need not be searched there.
    left = joined.join(parted.select("part"), "part", "left_semi").groupBy("key").agg(F.slice(F.array_sort(F.collect_list("part")), 1, known_parts).alias("parts"))
    rest = rest.join(asked_sets(rest, "size", "sketch"), "key").join(left, "key")
    rest = cut(in_groups(rest, ["part", "i", "j"], chosen, "key long, part long, i int, j int"), "hopeful")
    # Sets that share many parts are left in many groups with the same members; one of these is searched.
    alike = rest.groupBy("part", "i", "j").agg(F.count("*").alias("n"), F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("who"))
    rest = rest.join(alike.groupBy("n", "who").agg(F.min(F.struct("part", "i", "j")).alias("g")).select("g.*"), ["part", "i", "j"])
    links = links.unionByName(links_of(rest))
    named = cut(named_classes(folded, components(links), "key"), "named-sets")
    return join_hot(own.select("key", "doc_id"), named, "key", folded.select("key", "n"), total).select("doc_id", "component_id")


def one_of_each(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """docs without near copies of this similarity: of each class the row with the smallest doc_id stays (rows without
    doc_id all stay; of rows that repeat a doc_id, one)."""
    return keep_first(docs, cut(near_copies(docs, words, similarity), "near-copies"))
