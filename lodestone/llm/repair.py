"""Conversation structure repair by Dial's bucket-queue shortest paths.

A conversation's rows are kept, given another role or deleted, and empty turns are inserted, until the role initials read
``(s?(ua)+)?``. The search graph has four nodes at each position between rows: nothing kept yet, a system turn, a user turn,
an assistant turn. All costs are small integers, so the queue is a ring of buckets, one for each distance up to the
dearest arc. Distances to the end are recorded; the walk from the start then takes, among the arcs on a cheapest path,
the one whose letter is smallest. A state and a letter decide where an arc leads, so the walk is the audit.

Rows that must go (blank ones, and those whose role and text were seen before) cost the same on every path and their
letter is the smallest, so they are counted beside the graph and written where they stand.

Rows are sorted over all conversations at once and handled in pieces of bounded size. Most conversations are one piece and
are done where they lie. A conversation of several pieces, which may hold a third of all rows, is never gathered: each
piece gives its least costs from state to state (four by four numbers), these are folded from the last piece to the
first, and each piece then knows its own distances. Only the SHA-256 of the repaired text, which is sequential by
definition, reads the pieces of one conversation in one task, one after the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
SPACE = " \t\n\v\f\r"
NONE, SYSTEM, USER, ASSISTANT = range(4)
# Where a turn of the role that the form asks for leads from each state, and which turn that is.
NEXT = (USER, USER, ASSISTANT, USER)
ASKED = ("user", "user", "assistant", "user")
# By role initial: where a kept row leads from each state that may keep it.
KEPT = {"s": {NONE: SYSTEM}, "u": {NONE: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
LEGAL = frozenset(("su", "ua", "au"))
# Turns that are missing at a conversation's end in each state, and so the distances there.
MISSING = (0, 2, 1, 0)
END = tuple(INSERT * k for k in MISSING)
FAR = 1 << 60
RING = REROLE + TRUNCATED + 1
PIECE = "conv_id long, seq long, roles array<string>, texts array<string>, unended array<boolean>, gone array<long>, blank long, duplicate long, truncated long, illegal long, head string, tail string, low long, high long, turns long"


def distances(initials: str, truncated: list[bool], exits: tuple[int, ...]) -> list[int]:
    """Least cost from each node (4 * position + state) to the end, given the cost that follows in each last state."""
    n = len(initials)
    found = [FAR] * (4 * n + 4)
    ring: list[list[int]] = [[] for _ in range(RING)]
    waiting = sorted(((c, 4 * n + s) for s, c in enumerate(exits) if c < FAR), reverse=True)
    held = at = 0
    while held or waiting:
        at = at if held else max(at, waiting[-1][0])
        bucket = ring[at % RING]
        while waiting and waiting[-1][0] == at:
            bucket.append(waiting.pop()[1])
            held += 1
        while bucket:
            node = bucket.pop()
            held -= 1
            if found[node] <= at:
                continue
            found[node] = at
            i, state = node >> 2, node & 3
            arcs = []
            if i < n:
                arcs += [(4 * i + s, INSERT) for s in range(4) if NEXT[s] == state]
            if i:
                low, more = 4 * i - 4, TRUNCATED * truncated[i - 1]
                arcs.append((low + state, DELETE))
                arcs += [(low + s, REROLE + more) for s in range(4) if NEXT[s] == state]
                arcs += [(low + s, KEEP + more) for s, to in KEPT.get(initials[i - 1], {}).items() if to == state]
            for before, cost in arcs:
                if found[before] == FAR:
                    ring[(at + cost) % RING].append(before)
                    held += 1
        at += 1
    return found


def walk(initials: str, truncated: list[bool], found: list[int], state: int) -> Iterator[tuple[str, int, int]]:
    """(letter, position, state behind it) along the smallest cheapest path; the last is ("", n, state)."""
    i, n = 0, len(initials)
    while i < n:
        here, more = found[4 * i + state], TRUNCATED * truncated[i]
        kept = KEPT.get(initials[i], {}).get(state)
        if found[4 * i + 4 + state] + DELETE == here:
            step = ("D", i + 1, state)
        elif found[4 * i + NEXT[state]] + INSERT == here:
            step = ("I", i, NEXT[state])
        elif kept is not None and found[4 * i + 4 + kept] + KEEP + more == here:
            step = ("K", i + 1, kept)
        else:
            step = ("R", i + 1, NEXT[state])
        yield step
        _, i, state = step
    yield "", n, state


@dataclass
class Piece:
    """Some rows of one conversation in order; entry i is a row that may stay, followed by gone[i + 1] rows that go."""

    roles: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    truncated: list[bool] = field(default_factory=list)
    gone: list[int] = field(default_factory=lambda: [0])

    @property
    def initials(self) -> str:
        return "".join(r[:1] or "?" for r in self.roles)

    def edits(self, found: list[int], state: int, last: bool) -> tuple[str, list[str], int]:
        """The audit, the repaired rows and the state behind them."""
        letters, rows = ["D" * self.gone[0]], []
        for letter, i, to in walk(self.initials, self.truncated, found, state):
            if not letter:
                break
            letters.append(letter)
            if letter == "K":
                rows.append(f"{self.roles[i - 1]}:{self.texts[i - 1]}")
            elif letter == "R":
                rows.append(f"{ASKED[state]}:{self.texts[i - 1]}")
            elif letter == "I":
                rows.append(f"{ASKED[state]}:")
            if letter != "I":
                letters.append("D" * self.gone[i])
            state = to
        for _ in range(MISSING[state] if last else 0):
            letters.append("I")
            rows.append(f"{ASKED[state]}:")
            state = NEXT[state]
        return "".join(letters), rows, state


def damage(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) as the driver's test damages them, with ``copies``: how often each row stands.

    By crc32 of ``conv_id:turn`` modulo 20, a null being one space: 0 drops the row, 1 empties its text, 2 removes
    sentence ends, 3 repeats it, 4 makes it a user's. A null role or text becomes one space; a null turn stays null.
    """
    space = F.lit(" ")
    kind = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    text = F.coalesce(F.col("text").cast("string"), space)
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(kind == 4, F.lit("user")).otherwise(F.coalesce(F.col("role").cast("string"), space))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), copies.alias("copies"))


def in_order(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n, again): equal rows folded to one with their number, in the order of conversations
    and turns; ``again`` says whether role and text stood at an earlier turn.

    Equal rows are counted before they are shuffled. Only roles and texts with several turns are joined, by two hashes;
    the join can be split where many rows share one.
    """
    gone = F.col("copies") == 0
    blank = F.lit("")
    some = rows.select("conv_id", "turn", F.when(gone, blank).otherwise(F.col("role")).alias("role"), F.when(gone, blank).otherwise(F.col("text")).alias("text"), "copies")
    folded = some.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("n"))
    for k in (1, 2):
        folded = folded.withColumn(f"h{k}", F.xxhash64(F.lit(k), F.col("conv_id").isNull(), "conv_id", "role", "text"))
    folded = cut(folded, "turns")
    at = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = folded.where("n > 0").groupBy("h1", "h2").agg(F.min(at).alias("first"), F.count("*").alias("places")).where("places > 1")
    rows = folded.join(first.drop("places"), ["h1", "h2"], "left")
    again = F.col("first").isNotNull() & (F.col("first") < at)
    rows = rows.select("conv_id", "turn", "role", "text", "n", again.alias("again"))
    return rows.repartitionByRange("conv_id", "turn", "role", F.left("text", F.lit(64))).sortWithinPartitions("conv_id", "turn", "role", "text")


class Builder:
    """Collects sorted rows of one conversation to a piece and its counts."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.piece = conv_id, Piece()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = self.rows = self.chars = 0
        self.head = self.tail = self.low = self.high = None

    def add(self, turn: int | None, role: str, text: str, n: int, again: bool) -> None:
        self.rows += 1
        if not n:
            return
        initial = role[:1]
        if self.tail is None:
            self.head = initial
        else:
            self.illegal += self.tail + initial not in LEGAL
        self.illegal += (n - 1) * (initial + initial not in LEGAL)
        self.tail = initial
        if turn is not None:
            self.turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn
        said = text.rstrip(SPACE)
        if not said:
            self.blank += n
            self.piece.gone[-1] += n
        elif again:
            self.duplicate += n
            self.piece.gone[-1] += n
        else:
            unended = said[-1] not in ".!?"
            self.truncated += unended
            self.duplicate += n - 1
            self.piece.roles.append(role)
            self.piece.texts.append(text)
            self.piece.truncated.append(unended)
            self.piece.gone.append(n - 1)
            self.chars += len(text)

    def row(self, seq: int) -> tuple:
        p = self.piece
        return self.conv_id, seq, p.roles, p.texts, p.truncated, p.gone, self.blank, self.duplicate, self.truncated, self.illegal, self.head, self.tail, self.low, self.high, self.turns


def arrow_schema(text: str) -> pa.Schema:
    plain = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    kind = lambda t: pa.list_(plain[t[6:-1]]) if t.startswith("array<") else plain[t]
    return pa.schema([(c.split()[0], kind(c.split()[1])) for c in text.split(", ")])


def batches_of(rows: Iterator[tuple], schema: pa.Schema, most: int = 64) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def rows_of(batches: Iterator[pa.RecordBatch], most: int = 256) -> Iterator[tuple]:
    for b in batches:
        for at in range(0, b.num_rows, most):
            yield from zip(*[c.to_pylist() for c in b.slice(at, most).columns])


def pieces(ordered: DataFrame, piece_rows: int, piece_chars: int) -> DataFrame:
    """The conversations' pieces, numbered in order by ``seq``."""
    schema = arrow_schema(PIECE)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40

        def found() -> Iterator[tuple]:
            own, k = None, 0
            for conv_id, *row in rows_of(batches):
                if own is None or own.conv_id != conv_id or own.rows >= piece_rows or own.chars >= piece_chars:
                    if own is not None:
                        yield own.row(base + k)
                        k += 1
                    own = Builder(conv_id)
                own.add(*row)
            if own is not None:
                yield own.row(base + k)

        yield from batches_of(found(), schema)

    return cut(ordered.mapInArrow(build, PIECE), "pieces")


FAULTS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long"
RESULT = FAULTS + ", cost long, audit string, repaired_sha256 string"


def gaps(low: int | None, high: int | None, turns: int) -> int:
    return 0 if low is None else high - low + 1 - turns


def repaired(rows: list[str]) -> bytes:
    return "\n".join(rows).encode()


def from_single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The results of conversations of one piece."""

    def found() -> Iterator[tuple]:
        for conv_id, _, roles, texts, truncated, gone, blank, duplicate, short, illegal, _, _, low, high, turns in rows_of(batches):
            piece = Piece(roles, texts, truncated, gone)
            costs = distances(piece.initials, truncated, END)
            audit, rows, _ = piece.edits(costs, NONE, True)
            yield conv_id, gaps(low, high, turns), blank, duplicate, short, illegal, costs[NONE] + DELETE * sum(gone), audit, hashlib.sha256(repaired(rows)).hexdigest()

    yield from batches_of(found(), arrow_schema(RESULT))


def from_several(several: DataFrame) -> DataFrame:
    """The results of conversations of several pieces."""
    spans = "conv_id long, seq long, costs array<long>"

    def span(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The least costs of each piece from state to state."""

        def found() -> Iterator[tuple]:
            for conv_id, seq, roles, unended in rows_of(batches):
                to = [distances(Piece(roles).initials, unended, tuple(0 if s == x else FAR for s in range(4)))[:4] for x in range(4)]
                yield conv_id, seq, [to[x][s] for s in range(4) for x in range(4)]

        yield from batches_of(found(), arrow_schema(spans))

    def back(g: pd.DataFrame) -> pd.DataFrame:
        """The cost that follows each piece in each state, from the last piece to the first. The group has 16 numbers
        for each piece of one conversation, which is less than its audit."""
        g = g.sort_values("seq", ascending=False)
        exits, out = list(END), []
        for costs in g["costs"]:
            out.append(exits)
            exits = [min(FAR, min(int(costs[4 * s + x]) + exits[x] for x in range(4))) for s in range(4)]
        return pd.DataFrame({"seq": g["seq"], "exits": out, "final": [k == 0 for k in range(len(out))]})

    told = several.select("conv_id", "seq", "roles", "unended").mapInArrow(span, spans)
    follows = told.groupBy("conv_id").applyInPandas(back, "seq long, exits array<long>, final boolean")
    parts = cut(several.join(follows, "seq"), "followed")
    left = "conv_id long, seq long, leaves array<int>"

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In which state the walk leaves each piece, by the state in which it enters it."""

        def found() -> Iterator[tuple]:
            for conv_id, seq, roles, unended, exits in rows_of(batches):
                initials = Piece(roles).initials
                costs = distances(initials, unended, tuple(exits))
                yield conv_id, seq, [[*walk(initials, unended, costs, s)][-1][2] if costs[s] < FAR else s for s in range(4)]

        yield from batches_of(found(), arrow_schema(left))

    def forth(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("seq")
        state, out = NONE, []
        for leaves in g["leaves"]:
            out.append(state)
            state = int(leaves[state])
        return pd.DataFrame({"seq": g["seq"], "enters": out})

    leaves = parts.select("conv_id", "seq", "roles", "unended", "exits").mapInArrow(leave, left)
    enters = leaves.groupBy("conv_id").applyInPandas(forth, "seq long, enters int")
    names = ["conv_id", "roles", "texts", "unended", "gone", "exits", "final", "enters", "blank", "duplicate", "truncated", "illegal", "head", "tail", "low", "high", "turns"]
    ready = parts.join(enters, "seq").repartition("conv_id").sortWithinPartitions("conv_id", "seq").select(*names)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One result for each conversation, its pieces read in order; held are its audit and one piece."""

        def found() -> Iterator[tuple]:
            counts, tail, low, high, turns, cost, audit, digest, started = [0] * 4, None, None, None, 0, None, [], hashlib.sha256(), False
            for conv_id, roles, texts, unended, gone, exits, final, enters, *faults, head, own_tail, own_low, own_high, own_turns in rows_of(batches, 4):
                piece = Piece(roles, texts, unended, gone)
                costs = distances(piece.initials, unended, tuple(exits))
                letters, rows, _ = piece.edits(costs, enters, final)
                cost = (costs[NONE] if cost is None else cost) + DELETE * sum(gone)
                audit.append(letters)
                if rows:
                    digest.update(b"\n" * started + repaired(rows))
                    started = True
                counts = [a + b for a, b in zip(counts, faults)]
                if head is not None:
                    counts[3] += tail is not None and tail + head not in LEGAL
                    tail = own_tail
                if own_low is not None:
                    turns += own_turns - (own_low == high)
                    low, high = own_low if low is None else low, own_high
                if final:
                    yield conv_id, gaps(low, high, turns), *counts, cost, "".join(audit), digest.hexdigest()
                    counts, tail, low, high, turns, cost, audit, digest, started = [0] * 4, None, None, None, 0, None, [], hashlib.sha256(), False

        yield from batches_of(found(), arrow_schema(RESULT))

    return ready.mapInArrow(write, RESULT)


def repair(rows: DataFrame, piece_rows: int = 4096, piece_chars: int = 4_000_000) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation of rows
    (conv_id, turn, role, text, copies).

    Rows of a conversation stand in the order of turn, null turns first, ties by role and text; ``copies`` says how often
    a row stands, and a conversation whose copies are all 0 has no rows: zeros, an empty audit and the hash of nothing.
    Null roles and texts are empty, so blank. Null conv_ids are one conversation. Other columns are not read; an empty
    table gives no rows. A role that starts with another letter than s, u or a can't be kept. The audit is one cell.
    """
    rows = rows.withColumn("role", F.coalesce("role", F.lit(""))).withColumn("text", F.coalesce("text", F.lit("")))
    found = pieces(in_order(rows), piece_rows, piece_chars)
    many = found.groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").select("conv_id")
    several = cut(found.join(many, found["conv_id"].eqNullSafe(many["conv_id"]), "left_semi"), "several")
    single = found.join(many, found["conv_id"].eqNullSafe(many["conv_id"]), "left_anti").mapInArrow(from_single, RESULT)
    return single.unionByName(from_several(several))


def _step(x: str, cost: str, letter: str) -> str:
    return f"lpad(CAST(CAST(left({x}, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({x}, 10) || {letter}"


_CRC = "list_reduce([xor(c, CAST(b AS BIGINT))] || range(8), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))"
_BEFORE_ROW = f"""SELECT conv_id, i, z, s, u, least(a, {_step("u", "3", "'I'")}) AS a
    FROM (SELECT conv_id, i, z, s, a, least(u, {", ".join(_step(x, "3", "'I'") for x in "zsa")}) AS u FROM walk) AS w1"""
# Each state's best way is its cost in nine digits and its audit, so the smallest string is the cheapest and then least one.
ORACLE = f"""WITH RECURSIVE
named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
kinds AS (SELECT conv_id, turn, role, text, xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(k, ''), lambda x: CAST(ord(x) AS BIGINT)), lambda c, b: {_CRC}), 4294967295) % 20 AS kind FROM named),
rows_ AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM kinds),
placed AS (SELECT conv_id, turn, role, text, left(role, 1) AS ini, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM rows_),
told AS (SELECT *, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini NOT IN ('su', 'ua', 'au') AS illegal,
  CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM placed),
graph AS (SELECT conv_id, i, ini, fault IN ('', 'truncated') AS stays, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS more FROM told),
walk(conv_id, i, z, s, u, a) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), '000000000', CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM conversations
  UNION ALL
  SELECT w.conv_id, g.i, {_step("w.z", "4", "'D'")},
    least({_step("w.s", "4", "'D'")}, CASE WHEN g.stays AND g.ini = 's' THEN {_step("w.z", "g.more", "'K'")} END),
    least({_step("w.u", "4", "'D'")}, CASE WHEN g.stays AND g.ini = 'u' THEN least({", ".join(_step(f"w.{x}", "g.more", "'K'") for x in "zsa")})
      WHEN g.stays THEN least({", ".join(_step(f"w.{x}", "g.more + 3", "'R'") for x in "zsa")}) END),
    least({_step("w.a", "4", "'D'")}, CASE WHEN g.stays AND g.ini = 'a' THEN {_step("w.u", "g.more", "'K'")} WHEN g.stays THEN {_step("w.u", "g.more + 3", "'R'")} END)
  FROM ({_BEFORE_ROW}) AS w JOIN graph AS g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.i = w.i + 1),
best AS (SELECT conv_id, arg_max(least(z, a), i) AS b FROM ({_BEFORE_ROW}) AS w GROUP BY conv_id),
letters AS (SELECT conv_id, p, substr(b, 9 + p, 1) AS letter FROM (SELECT conv_id, b, unnest(range(1, length(b) - 8)) AS p FROM best)),
used AS (SELECT *, count(*) FILTER (letter <> 'I') OVER (PARTITION BY conv_id ORDER BY p) AS i FROM letters),
made AS (SELECT l.conv_id, l.p, l.letter, t.role, t.text,
  count(*) FILTER (NOT (l.letter = 'K' AND t.ini = 's')) OVER (PARTITION BY l.conv_id ORDER BY l.p) % 2 = 1 AS by_user
  FROM used AS l LEFT JOIN told AS t ON t.conv_id IS NOT DISTINCT FROM l.conv_id AND t.i = l.i AND l.letter <> 'I' WHERE l.letter <> 'D'),
texts AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN by_user THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS repaired FROM made GROUP BY conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal FROM told GROUP BY conv_id)
SELECT b.conv_id, CAST(coalesce(c.gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(c.blank, 0) AS BIGINT) AS blank, CAST(coalesce(c.duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(c.truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(c.illegal, 0) AS BIGINT) AS illegal, CAST(left(b.b, 9) AS BIGINT) AS cost, substr(b.b, 10) AS audit, sha256(coalesce(x.repaired, '')) AS repaired_sha256
FROM best AS b LEFT JOIN counts AS c ON c.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN texts AS x ON x.conv_id IS NOT DISTINCT FROM b.conv_id"""
