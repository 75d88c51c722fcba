import hashlib
import itertools
import random
import zlib

import pytest

from lodestone.llm import repair

SPACE = " \t\n\v\f\r"
COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
SCHEMA = "conv_id long, turn long, role string, text string, first string, n string, again string"


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        own = out.setdefault(conv, [])
        if kind == 0:
            continue
        text = "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for k, v in out.items()}


def by_table(rows):
    """The plain rules: every position's best (cost, audit, rows) in every state, smallest first."""
    seen, faults = set(), []
    for _, role, text in rows:
        said = text.strip(SPACE)
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    turn_of = {"": "u", "s": "u", "u": "a", "a": "u"}
    full = {"u": "user", "a": "assistant"}
    best = {"": (0, "", ())}

    def better(table, state, option):
        if state not in table or option[:2] < table[state][:2]:
            table[state] = option

    def insert(table):
        for _ in range(3):
            for s, (c, a, r) in list(table.items()):
                better(table, turn_of[s], (c + 3, a + "I", (*r, full[turn_of[s]] + ":")))

    for (_, role, text), fault in zip(rows, faults):
        insert(best)
        new = {}
        for s, (c, a, r) in best.items():
            better(new, s, (c + 4, a + "D", r))
            if fault in ("blank", "duplicate"):
                continue
            c += 3 * (fault == "truncated")
            first = role[:1]
            if first == "s" and s == "" or first in ("u", "a") and turn_of[s] == first:
                better(new, first, (c, a + "K", (*r, f"{role}:{text}")))
            better(new, turn_of[s], (c + 3, a + "R", (*r, f"{full[turn_of[s]]}:{text}")))
        best = new
    insert(best)
    cost, audit, kept = min(best[s] for s in ("", "a") if s in best)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    digest = hashlib.sha256("\n".join(kept).encode()).hexdigest()
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest


def some_rows(seed, convs):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    texts = ["Yes.", "No!", "Why?", "and then", "so it was", "  ", "", None, "The end.", "\U0001f600 ok.", "a\nb"]
    rows = []
    for conv in [*range(convs), None]:
        for i in range(rng.randrange(0, 14)):
            turn = rng.choice([i, i, i, i + 2, None])
            rows.append((conv, turn, rng.choice(roles), rng.choice(texts)))
        rows += rows[-2:] * (rng.random() < 0.3)
    return rows


@pytest.mark.parametrize("piece_rows", [4096, 1, 3])
def test_against_plain_rules(spark, piece_rows):
    rows = some_rows(5, 120)
    df = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA)
    found = {r["conv_id"]: tuple(r)[1:] for r in repair.repair(repair.damage(df), piece_rows=piece_rows).collect()}
    want = {k: by_table(v) for k, v in damaged(rows).items()}
    assert found == want


def test_one_conversation_of_many_pieces(spark):
    rng = random.Random(2)
    rows = [(1, i, rng.choice(["user", "assistant", "system"]), f"{rng.choice(['line', 'row'])} {i if rng.random() < 0.9 else 7}{rng.choice(['.', ''])}") for i in range(3000)]
    rows += [(2, 0, "user", "Hi."), (2, 1, "assistant", "Hello.")]
    df = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA)
    found = {r["conv_id"]: tuple(r)[1:] for r in repair.repair(repair.damage(df), piece_rows=50).collect()}
    assert found == {k: by_table(v) for k, v in damaged(rows).items()}


def test_no_rows_left_and_empty_table(spark):
    conv = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(conv, 0, "user", "Hi.", "x", "x", "x")], SCHEMA)
    out = repair.repair(repair.damage(df))
    assert out.columns == list(COLUMNS)
    assert [tuple(r) for r in out.collect()] == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repair.repair(repair.damage(df.limit(0))).collect() == []


def test_distances_by_relaxation():
    """The bucket queue gives the distances that repeated relaxation of all arcs gives."""
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randrange(0, 9)
        initials, cut = "".join(rng.choice("sua?") for _ in range(n)), [rng.random() < 0.3 for _ in range(n)]
        exits = tuple(rng.choice([0, 2, 5, 9, repair.FAR]) for _ in range(3)) + (1,)
        best = {(n, s): c for s, c in enumerate(exits)}
        for _ in range(6 * n + 8):
            for i in range(n - 1, -1, -1):
                more = 3 * cut[i]
                for s in range(4):
                    options = [best.get((i + 1, s), repair.FAR) + 4, best.get((i + 1, repair.NEXT[s]), repair.FAR) + 3 + more, best.get((i, repair.NEXT[s]), repair.FAR) + 3]
                    kept = repair.KEPT.get(initials[i], {}).get(s)
                    options += [] if kept is None else [best.get((i + 1, kept), repair.FAR) + more]
                    best[i, s] = min(options)
        found = repair.distances(initials, cut, exits)
        assert [min(v, repair.FAR) for v in found] == [min(best[i, s], repair.FAR) for i in range(n + 1) for s in range(4)]
