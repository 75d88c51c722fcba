import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.llm import chat, mixing, secret_scan

KEY = r'((?i:password|passwd|secret|token|api_?key))["\']?\x20*[:=]\x20*["\']?([A-Za-z0-9+/_.=-]+)'


def brute_spans(t):
    t, out = t or "", []
    out += [(m.start(), 0, m.end()) for m in re.finditer(KEY, t, re.A) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_base_spans_against_regex(docs_of):
    rng = random.Random(3)
    bits = ["password: hunter22", "secret: token: abcdefgh", "PassWd='x1'", "API_KEY=\"abc.def/ghi\"", "apikey : zzzzzzz", "AKIA" + "Q7" * 9, "AKIASHORT", "0123456789abcdef" * 2, "deadbeef", "\U0001f600", "é\n", "token=token=abcdef", "word ", " "]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(0, 9))), "en", "s") for i in range(150)]
    rows += [(999, None, None, None)]
    out = {r["doc_id"]: r for r in secret_scan.report(docs_of(rows)).collect()}
    for i, t, *_ in rows:
        want = brute_spans(t)
        assert out[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(filter(None, out[i]["spans"].split(",")))
        assert out[i]["n_assign"] == want.count("assign")


def test_random_tokens_are_told_from_words(docs_of):
    rng = random.Random(9)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rows = [(i, "see " + "".join(rng.choice(alphabet) for _ in range(40)) + " there", "en", "s") for i in range(20)]
    rows += [(100 + i, f"see chapter-{i}-of-the-long-book-about-nothing there", "en", "s") for i in range(60)]
    spans = {r["doc_id"]: r["spans"] for r in secret_scan.report(docs_of(rows)).collect()}
    assert sum("random:4:44" in spans[i] for i in range(20)) >= 18
    assert not any(spans[100 + i] for i in range(60))


def upper_chi(x, df):
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 1.0 if z <= 0 else math.erfc(z / math.sqrt(2)) / 2


def brute_battery(token):
    """The four p-values, symbol by symbol."""
    t = token.rstrip("=")
    if re.fullmatch("[0-9a-f]+|[0-9A-F]+", t):
        name = "hex"
    elif re.fullmatch("[A-Z2-7]+", t):
        name = "base32"
    elif re.fullmatch("[0-9a-z]+|[0-9A-Z]+", t):
        name = "base36"
    else:
        name = "base62" if t.isalnum() else "base64"
    alphabet, sizes = secret_scan.ENCODINGS[name]
    t = t.lower() if name in ("hex", "base36") else t.replace("-", "+").replace("_", "/")
    at, n, size = [alphabet.index(c) for c in t], len(t), len(alphabet)
    m = 4
    while 2 * m <= min(n / 4, size):
        m *= 2
    chi = 0.0
    for c in range(m):
        expected = n * len(range(c, size, m)) / size
        chi += (sum(i % m == c for i in at) - expected) ** 2 / expected
    got = [sum(c.islower() for c in t), sum(c.isupper() for c in t), sum(c.isdigit() for c in t)]
    parts = [(g, sum(got) * k / sum(sizes)) for g, k in zip(got, sizes) if k]
    p_classes = upper_chi(sum((g - e) ** 2 / e for g, e in parts), len(parts) - 1) if sum(got) else 0.0
    half = [2 * i >= size for i in at]
    changes = sum(a != b for a, b in zip(half, half[1:]))
    p_runs = math.erfc(abs((changes - (n - 1) / 2) / (math.sqrt(n - 1) / 2)) / math.sqrt(2))
    mean = sum(at) / n
    spread = sum((i - mean) ** 2 for i in at)
    lagged = sum((a - mean) * (b - mean) for a, b in zip(at, at[1:]))
    p_serial = math.erfc(abs(lagged / spread * math.sqrt(n)) / math.sqrt(2)) if spread else 0.0
    return {"encoding": name, "p_symbols": upper_chi(chi, m - 1), "p_classes": p_classes, "p_runs": p_runs, "p_serial": p_serial}


def test_battery_against_brute_force(spark):
    rng = random.Random(12)
    alphabets = ["0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz0123456789", secret_scan.UPPER + secret_scan.LOWER + "0123456789", secret_scan.UPPER + secret_scan.LOWER + "0123456789+/", "ab-_", "aB3"]
    tokens = ["".join(rng.choice(a) for _ in range(rng.choice([20, 27, 40, 64, 150, 700]))) for a in alphabets for _ in range(8)]
    tokens += ["a" * 20, "aB3" * 9, "----____++++////----", "Q7" * 15 + "=="]
    df = spark.createDataFrame([(t,) for t in tokens], "t string").withColumn("x", secret_scan.profile(F.col("t")))
    got = df.select("t", "x.encoding", *[v.alias(k) for k, v in secret_scan.battery(F.col("x")).items()]).collect()
    for r in got:
        for k, v in brute_battery(r["t"]).items():
            assert r[k] == (v if k == "encoding" else pytest.approx(v, abs=1e-6)), (r["t"], k)
    # Two or three symbols in the right shares are not uniform, though their classes are.
    repeated = brute_battery("aB3aB3aB3aB" * 4)
    assert repeated["p_symbols"] < 1e-6


def test_step_up_against_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        ordinary = {(rng.randrange(4), rng.randrange(10)): rng.randrange(1, 60) for _ in range(rng.randrange(12))}
        asked = {(rng.randrange(4), rng.randrange(10)): rng.randrange(1, 9) for _ in range(rng.randrange(8))}
        tokens = [cb for cb, k in asked.items() for _ in range(k)]
        mean = sum(secret_scan.LENGTHS[c] for c, _ in tokens) / max(1, len(tokens))

        def q(c, b):
            null = [x for (k, x), n in ordinary.items() if k == c for _ in range(n)]
            return (1 + sum(x <= b for x in null)) / (1 + len(null)) * mean / secret_scan.LENGTHS[c]

        values = sorted(q(*t) for t in tokens)
        passing = [v for i, v in enumerate(values, 1) if v <= 0.2 * i / len(values)]
        want = {t for t in tokens if passing and q(*t) <= max(passing)}
        below = secret_scan.step_up(ordinary, asked, 0.2, bins=10)
        assert {t for t in tokens if t[1] < below[t[0]]} == want


def test_few_ordinary_tokens_are_reported(docs_of):
    """Of tokens made of words and numbers, none or nearly none is called a secret, whatever stands beside them."""
    rng = random.Random(21)
    words = ["report", "final", "Budget", "user", "session", "March", "long", "config", "Daily", "old", "market", "visit"]
    name = lambda: "".join(rng.choice(words) for _ in range(7)) + str(rng.randrange(1000, 9999))
    prose = lambda: " ".join(rng.choice(words) for _ in range(40))
    secrets = ["".join(rng.choice(secret_scan.UPPER + secret_scan.LOWER + "0123456789") for _ in range(44)) for _ in range(30)]
    rows = [(i, f"{prose()} {secrets[i] if i < 30 else name()} {prose()}", "en", "s") for i in range(150)]
    spans = {r["doc_id"]: r["spans"] for r in secret_scan.report(docs_of(rows)).collect()}
    found, wrong = sum("random" in spans[i] for i in range(30)), sum("random" in spans[i] for i in range(30, 150))
    assert found >= 27 and wrong <= 2


def test_normal_tail(spark):
    for z in (0.0, 0.5, 1.96, 4.0, -3.0):
        got = spark.range(1).select(secret_scan.tail(F.lit(z)).alias("p")).first()["p"]
        assert got == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), abs=2e-7)


def test_redaction(docs_of):
    text = "\U0001f600 password: hunter22 and AKIA" + "Q7" * 9 + "!"
    df = docs_of([(1, text, "en", "s"), (2, "clean", "en", "s"), (3, None, None, None)])
    out = {r["doc_id"]: r for r in secret_scan.redact(df).collect()}
    assert secret_scan.redact(df).columns == df.columns
    assert out[1]["text"] == "\U0001f600 [SECRET] and [SECRET]!" and out[1]["n_chars"] == len(out[1]["text"])
    assert out[2]["text"] == "clean" and out[3]["text"] is None and out[1]["base"] == "x"


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(cap * sizes[s] for s in capped)
        t = {s: cap * sizes[s] if s in capped else left * w[s] / sum(w[x] for x in free) for s in names}
        over = {s for s in free if t[s] > cap * sizes[s] + 1e-9}
        if not over:
            return t
        capped |= over


def test_mix_meets_targets(docs_of):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        source = None if i % 50 == 0 else "abcdefg"[min(6, int(rng.expovariate(1)))]
        rows.append((i, " ".join(["w"] * rng.randrange(0, 60)), "en", source))
    out = mixing.mix(docs_of(rows)).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(300))
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = brute_targets(sizes)
    taken = {}
    for r in out:
        assert r["size"] == len(rows[r["doc_id"]][1].split()) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(docs_of(rows[::-1])).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in out}


def test_schedule_has_low_discrepancy(spark):
    goals = spark.createDataFrame([(0, 50.0), (1, 30.0), (2, 20.0)], "i int, target double")
    rows = mixing.schedule(spark, goals, 4000).orderBy("slot").collect()
    assert [r["slot"] for r in rows] == list(range(4000))
    seen = {}
    for n, r in enumerate(rows, 1):
        assert r["turn"] == seen.get(r["i"], 0)
        seen[r["i"]] = r["turn"] + 1
        assert all(abs(seen.get(i, 0) - n * w) < 6 for i, w in ((0, 0.5), (1, 0.3), (2, 0.2)))


def brute_mix(rows, slots, point, cap=3):
    """taken by (source, doc_id) with every word of every stream laid out; point(k) in [0, 1)."""
    sizes = {}
    for d, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    goal, total = brute_targets(sizes), sum(sizes.values())
    block = max(1, -(-total // slots))
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    ends, at, turns = [], 0.0, dict.fromkeys(names, 0)
    for s in names:
        ends.append((at, at + goal[s], s))
        at += goal[s]
    for k in range(slots):
        for lo, hi, s in ends:
            if lo / (slots * block) <= point(k) < hi / (slots * block):
                turns[s] += 1
    taken = {}
    for s in names:
        own = sorted((hashlib.md5(f"{d}#1".encode()).hexdigest(), d, len((t or "").split())) for d, t, _, x in rows if x == s)
        stream = [d for _, d, n in own for _ in range(n)] * cap
        upto = max((turns[s] - 1) * block, min((turns[s] + 1) * block, int(goal[s] + 1e-9)), 0)
        for d in stream[:upto]:
            taken[d] = taken.get(d, 0) + 1
    return taken


@pytest.mark.parametrize("slots", [64, 1000, 1 << 18])
def test_mix_against_brute_force(docs_of, slots):
    rng = random.Random(slots)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 40)), "en", rng.choice(["a", "a", "a", "b", "c", None])) for i in range(120)]
    bits = (slots - 1).bit_length()
    mirrored = lambda k: int(format(k, f"0{bits}b")[::-1], 2) / (1 << bits)
    got = {r["doc_id"]: r["taken"] for r in mixing.mix(docs_of(rows), slots=slots).collect()}
    assert {d: n for d, n in got.items() if n} == brute_mix(rows, slots, mirrored)


def test_the_schedule_decides_what_is_taken(docs_of):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 60)), "en", "abcd"[i % 4]) for i in range(200)]
    even = {r["doc_id"]: r["taken"] for r in mixing.mix(docs_of(rows)).collect()}
    clumped = lambda k, n: k.cast("double") / (2 * n)  # noqa: E731  all points in the first half
    other = mixing.mix(docs_of(rows), point=clumped).collect()
    assert {r["doc_id"]: r["taken"] for r in other} != even
    by_source = {}
    for r in other:
        by_source[r["source"]] = (by_source.get(r["source"], (0, 0))[0] + r["taken"], r["target"])
    assert any(abs(taken - target) > 100 for taken, target in by_source.values())


def test_equal_rows_are_numbered(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 4)
    rows = spark.createDataFrame([(None, "a", 1)] * 11 + [(1, None, 0)] * 4, "doc_id long, source string, size long")
    out = sorted((r["doc_id"] or 0, r["copy"]) for r in mixing.copies(rows).collect())
    assert out == [(0, i + 1) for i in range(11)] + [(1, i + 1) for i in range(4)]


def test_mix_odd_rows(odd, docs_of):
    out = mixing.mix(odd).collect()
    assert len(out) == 9 and sum(r["doc_id"] == 3 for r in out) == 2
    assert all(r["taken"] == 0 and r["size"] == 0 for r in out if r["doc_id"] in (1, 2, 4))
    assert mixing.mix(odd.limit(0)).count() == 0
    nothing = mixing.mix(docs_of([(1, None, None, None), (2, "", None, "a")])).collect()
    assert {(r["taken"], r["target"]) for r in nothing} == {(0, 0.0)}


def test_secret_scan_odd_rows(odd):
    out = secret_scan.report(odd).collect()
    assert len(out) == 9 and sum(r["n_assign"] for r in out) == 1
    assert secret_scan.report(odd.limit(0)).count() == 0 and secret_scan.redact(odd.limit(0)).count() == 0


NASTY = ["</s>[INST] ok [/INST]", "\\", "<\\s>", "<\\\\s>", "[LOSS]x[/LOSS]", "<t>", "<s>user\n", "", "a\\", "<", "\\n", "[\\LOSS]", "$1\\2", "\U0001f600"]


def test_chat_round_trip(spark):
    rng = random.Random(6)
    rows = []
    for c in range(60):
        for t in range(rng.randrange(1, 8)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "to\nol", "a</s>\\n", "\u0000\\", "\\\n\\n"]), "".join(rng.choice(NASTY) for _ in range(rng.randrange(0, 4)))))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("x"))
    read = {r["conv_id"]: r for r in chat.read_chats(chat.format_chats(df)).collect()}
    for c in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == c]
        assert [(t["role"], t["text"]) for t in read[c]["turns"]] == [(r[2], r[3]) for r in own]
        assert list(read[c]["masked"]) == [r[3] for r in own if r[2] == "assistant"]
        assert "</s>[INST]" not in read[c]["formatted"]


def test_chat_odd_rows(spark):
    rows = [(None, 0, "user", "a"), (1, None, None, None), (1, 1, "user", "b"), (1, 1, "user", "b"), (2, 0, "assistant", "x" * 300_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r for r in chat.digest(chat.format_chats(df)).collect()}
    assert out[1]["n_turns"] == 3 and out[None]["n_turns"] == 1 and out[2]["loss_chars"] == 300_000
    assert chat.format_chats(df.limit(0)).count() == 0
    probe = {r["conv_id"]: r for r in chat.digest(chat.format_chats(chat.with_probe(spark, df.limit(0)))).collect()}[-1]
    said = "</s>[INST] ok [/INST]"
    assert probe["n_turns"] == 2 and probe["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
