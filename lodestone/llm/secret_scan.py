"""Secret scans, in DataFrame expressions only.

Base findings are three fixed patterns. The method adds random-looking tokens by a randomness test battery. For each
long token an encoding is inferred (hex, base32, base36, base62, base64); under random characters of that encoding a
chi-squared test of the alphabet's uniformity (symbols dealt to as many equally likely cells as the length allows), one
of the classes lower, upper and digit, a runs test about the alphabet's middle and a serial-correlation test give
p-values. Their Bonferroni minimum is the token's evidence against randomness, in powers of ten.

The hypothesis that is tested is that a token is ordinary, that is, made of words; a reported token is one for which it
is rejected. Its null distribution comes from the corpus itself: every text gives, for each length class,
two tokens put together from its own neighbouring words (with dashes; and without, with a number). A token's p-value is the share of these, in
its length class, whose evidence against randomness is as small as its own. Which rejections hold is decided over all
tokens outside base findings at once by a Benjamini-Hochberg step-up whose weights grow with the length class, so the
expected share of ordinary tokens among those reported is bounded by ALPHA. A corpus without words rejects nothing.

Spans are found with split and regexp_extract_all on the same pattern: the pieces and the matches alternate, and
their running lengths are code-point offsets. All of it is whole-text, row by row; only two histograms of classes and
bins are aggregated, and no token leaves its row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the base patterns.
KEYWORDS = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
ASSIGN = KEYWORDS + "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")

TOKEN = "[A-Za-z0-9+/_-]{20,}={0,2}"
BINS = 400
DECADES = 15
ALPHA = 0.05
# Length classes of tokens, by their shortest length.
LENGTHS = (20, 28, 40, 64)
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
# Of each encoding: its alphabet, and how many letters of either case and digits it has (hex and base36 are folded to lower case).
ENCODINGS = {
    "hex": (DIGITS + "abcdef", (6, 0, 10)),
    "base32": (UPPER + "234567", (0, 26, 6)),
    "base36": (DIGITS + LOWER, (26, 0, 10)),
    "base62": (UPPER + LOWER + DIGITS, (26, 26, 10)),
    "base64": (UPPER + LOWER + DIGITS + "+/", (26, 26, 10)),
}


def spans(text: Column, pattern: str, kind: int, wanted: Column | None = None) -> Column:
    """array<struct<start, kind, end, text>> of the leftmost non-overlapping matches; offsets in code points."""
    hits = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    gaps = F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<start:long,kind:int,end:long,text:string>>")
    zipped = F.arrays_zip(hits.alias("hit"), F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"]).cast("long")
        end = start + F.length(x["hit"]).cast("long")
        one = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["hit"].alias("text"))
        return F.struct(end.alias("at"), F.concat(state["found"], F.array(one)).alias("found"))

    first = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("found"))
    found = F.aggregate(zipped, first, step)["found"]
    # Texts without any match, nearly all of them, are told apart by one search.
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(empty)


def base_spans(text: Column) -> dict[str, Column]:
    """The findings of each base kind: failing matches are dropped after matching."""
    value = lambda x: F.regexp_extract(x["text"], ASSIGN, 2)
    return {
        "assign": F.filter(spans(text, ASSIGN, 0), lambda x: F.length(value(x)) >= 6),
        "access": F.filter(spans(text, ACCESS, 1), lambda x: F.length(x["text"]) >= 20),
        # A maximal run of 24 or more is the same as a run that matches {24,}.
        "hex": spans(text, "[0-9a-f]{24,}", 2),
    }


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def tail(z: Column) -> Column:
    """Two-sided normal tail probability of |z| (Abramowitz-Stegun 26.2.17, absolute error below 1e-7)."""

    def of(a: Column) -> Column:
        poly = lambda t: t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        return F.least(F.lit(1.0), 2 * 0.3989422804014327 * F.exp(-a * a / 2) * let(1 / (1 + 0.2316419 * a), poly))

    return let(F.abs(z), of)


def encoding_of(token: Column) -> Column:
    only = lambda cls: F.regexp_like(token, F.lit(f"^[{cls}]+$"))
    hexes = only("0-9a-f") | only("0-9A-F")
    return F.when(hexes, "hex").when(only("A-Z2-7"), "base32").when(only("0-9a-z") | only("0-9A-Z"), "base36").when(only("0-9A-Za-z"), "base62").otherwise("base64")


def of_encoding(encoding: Column, value: Callable[[str], Column]) -> Column:
    names = list(ENCODINGS)
    out = F.when(encoding == names[0], value(names[0]))
    for name in names[1:]:
        out = out.when(encoding == name, value(name))
    return out


def profile(token: Column) -> Column:
    """What the tests need of a token (padding aside), in one struct: encoding, alphabet size, length, folded text,
    and the symbols' numbers in the alphabet."""

    def of(x: Column) -> Column:
        folded = F.when(x["encoding"].isin("hex", "base36"), F.lower(x["text"])).otherwise(F.translate(x["text"], "-_", "+/"))
        alphabet = of_encoding(x["encoding"], lambda name: F.lit(ENCODINGS[name][0]))
        return let(F.struct(x["encoding"].alias("encoding"), folded.alias("text"), alphabet.alias("alphabet")), numbered)

    def numbered(x: Column) -> Column:
        symbols = F.transform(F.filter(F.split(x["text"], ""), lambda c: c != ""), lambda c: F.call_function("locate", c, x["alphabet"]) - 1)
        return F.struct(x["encoding"].alias("encoding"), F.length(x["alphabet"]).alias("size"), F.length(x["text"]).alias("n"), x["text"].alias("text"), symbols.alias("symbols"))

    bare = F.regexp_replace(token, "=+$", "")
    return let(F.struct(encoding_of(bare).alias("encoding"), bare.alias("text")), of)


def upper_chi(x: Column, df: Column) -> Column:
    """The probability of a chi-squared value of x or more (Wilson-Hilferty); values below the mean count as 1."""
    z = (F.pow(x / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    return let(z, lambda v: F.when(v <= 0, F.lit(1.0)).otherwise(tail(v) / 2))


def battery(x: Column) -> dict[str, Column]:
    """The p-values of a profile's tests under random characters of its encoding.

    p_symbols: symbol numbers modulo m are the cells, m the largest power of two that leaves four expected symbols a
    cell (4 at least, the alphabet at most). p_classes: lower, upper and digit. p_runs: runs of the alphabet's
    lower and upper half. p_serial: correlation of neighbouring symbol numbers.
    """
    n, size = x["n"].cast("double"), x["size"]
    powers = F.floor(F.log2(F.greatest(F.lit(4.0), F.least(n / 4, size.cast("double")))) + 1e-9)

    def symbols(m: Column) -> Column:
        cells = F.array_join(F.transform(x["symbols"], lambda i: F.char(65 + i % m)), "")

        def cell_chi(text: Column) -> Column:
            def one(c: Column) -> Column:
                expected = n * (F.floor((size - 1 - c) / m) + 1) / size
                got = n - F.length(F.replace(text, F.char(65 + c)))
                return (got - expected) * (got - expected) / expected

            return F.aggregate(F.transform(F.sequence(F.lit(0), m - 1), one), F.lit(0.0), lambda s, v: s + v)

        return upper_chi(let(cells, cell_chi), (m - 1).cast("double"))

    count = lambda cls: F.length(F.regexp_replace(x["text"], f"[^{cls}]", "")).cast("double")
    classes = F.struct(count("a-z").alias("lower"), count("A-Z").alias("upper"), count("0-9").alias("digit"))

    def class_chi(got: Column) -> Column:
        total = got["lower"] + got["upper"] + got["digit"]

        def of(name: str) -> Column:
            sizes = ENCODINGS[name][1]
            chi = F.lit(0.0)
            for cls, k in zip(("lower", "upper", "digit"), sizes):
                if k:
                    expected = total * (k / sum(sizes))
                    chi = chi + (got[cls] - expected) * (got[cls] - expected) / expected
            return chi

        df = of_encoding(x["encoding"], lambda name: F.lit(float(sum(k > 0 for k in ENCODINGS[name][1]) - 1)))
        return F.when(total == 0, F.lit(0.0)).otherwise(upper_chi(of_encoding(x["encoding"], of), df))

    halves = F.array_join(F.transform(x["symbols"], lambda i: F.when(i * 2 >= size, "b").otherwise("a")), "")
    runs = F.length(F.regexp_replace(halves, r"(.)\1+", "$1")).cast("double")
    p_runs = tail((runs - 1 - (n - 1) / 2) / (F.sqrt(n - 1) / 2))
    mean = F.aggregate(x["symbols"], F.lit(0.0), lambda s, i: s + i) / n
    around = let(mean, lambda m: F.transform(x["symbols"], lambda i: i - m))

    def serial(v: Column) -> Column:
        spread = F.aggregate(v, F.lit(0.0), lambda s, c: s + c * c)
        lagged = F.aggregate(F.zip_with(v, F.slice(v, F.lit(2), F.size(v)), lambda a, b: F.coalesce(a * b, F.lit(0.0))), F.lit(0.0), lambda s, c: s + c)
        return let(spread, lambda s: F.when(s > 0, tail(lagged / s * F.sqrt(n))).otherwise(F.lit(0.0)))

    return {"p_symbols": let(F.pow(F.lit(2.0), powers).cast("int"), symbols), "p_classes": let(classes, class_chi), "p_runs": p_runs, "p_serial": let(around, serial)}


def evidence(token: Column, bins: int = BINS) -> Column:
    """struct<cls, bin> of a token: its length class, and the bin of its evidence against randomness, the negative
    decimal logarithm of four times the least p-value of the battery."""

    def of(x: Column) -> Column:
        p = F.least(F.lit(1.0), 4 * F.least(*battery(x).values()))
        decades = -F.log10(F.greatest(p, F.lit(10.0**-DECADES)))
        cls = sum((F.when(x["n"] >= at, 1).otherwise(0) for at in LENGTHS[1:]), F.lit(0))
        return F.struct(cls.cast("int").alias("cls"), F.least(F.lit(bins - 1), F.floor(decades * (bins / DECADES))).cast("int").alias("bin"))

    return let(profile(token), of)


def ordinary_tokens(text: Column) -> Column:
    """Two tokens of each length class that fits, made of neighbouring words of the text from a hashed position on:
    joined by dashes, and joined by nothing (by a hash in upper case) with the number of words as four digits at the end."""
    words = F.filter(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0)), lambda w: F.length(w) < LENGTHS[0])

    def of(ws: Column) -> Column:
        at = F.pmod(F.xxhash64(text), F.greatest(F.lit(1), F.size(ws) - 23)).cast("int")
        some = F.slice(ws, at + 1, F.lit(24))
        glued = F.array_join(some, "")
        glued = F.when(F.pmod(F.xxhash64(text, F.lit(1)), F.lit(2)) == 0, F.upper(glued)).otherwise(glued)
        digits = F.lpad((F.size(ws) % 10_000).cast("string"), 4, "0")
        return let(F.struct(F.array_join(some, "-").alias("dashed"), glued.alias("glued"), digits.alias("digits")), cut_to_length)

    def cut_to_length(x: Column) -> Column:
        made = []
        for n in LENGTHS:
            made.append(F.when(F.length(x["dashed"]) >= n, F.substr(x["dashed"], F.lit(1), F.lit(n))))
            made.append(F.when(F.length(x["glued"]) >= n - 4, F.concat(F.substr(x["glued"], F.lit(1), F.lit(n - 4)), x["digits"])))
        return F.filter(F.array(*made), lambda t: t.isNotNull())

    return let(words, of)


def tokens_of(text: Column) -> Column:
    """Spans of candidate tokens: long, of an encoding's alphabet, with digits and letters."""
    return F.filter(spans(text, TOKEN, 3), lambda x: F.regexp_like(x["text"], F.lit("[0-9]")) & F.regexp_like(x["text"], F.lit("[A-Za-z]")))


def free_tokens(text: Column, base: Column) -> Column:
    """tokens_of that overlap no base finding."""
    return F.filter(tokens_of(text), lambda x: ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))


def all_base(text: Column) -> Column:
    kinds = base_spans(text)
    return F.array_sort(F.concat(kinds["assign"], kinds["access"], kinds["hex"]))


def step_up(ordinary: dict[tuple[int, int], int], asked: dict[tuple[int, int], int], alpha: float, classes: int = len(LENGTHS), bins: int = BINS) -> list[int]:
    """For each length class the number of first bins whose tokens are not ordinary, by weighted Benjamini-Hochberg.

    Both arguments count tokens by (class, bin). The p-value of (c, b) is the share of class c's ordinary tokens in
    bins up to b, one added to both; it is divided by the class's weight (its shortest length over the mean of these
    over all tokens asked about). The largest such value that is at most alpha times the share of tokens up to it is the bound.
    """
    total = sum(asked.values())
    if not total:
        return [0] * classes
    mean = sum(LENGTHS[c] * k for (c, _), k in asked.items()) / total
    levels = []
    for c in range(classes):
        all_of = sum(k for (x, _), k in ordinary.items() if x == c)
        so_far = 0
        for b in range(bins):
            so_far += ordinary.get((c, b), 0)
            if (c, b) in asked:
                levels.append(((1 + so_far) / (1 + all_of) * mean / LENGTHS[c], c, b))
    levels.sort()
    bound, rank = -1.0, 0
    for q, c, b in levels:
        rank += asked[c, b]
        if q <= alpha * rank / total:
            bound = q
    return [1 + max((b for q, x, b in levels if x == c and q <= bound), default=-1) for c in range(classes)]


def rejected_bins(docs: DataFrame, alpha: float = ALPHA, bins: int = BINS) -> list[int]:
    """step_up over all tokens of all texts. One aggregate reaches the driver: counts by kind, class and bin."""
    text = F.coalesce(F.col("text"), F.lit(""))
    tokens = tokens_of(text)
    asked = F.when(F.size(tokens) > 0, free_tokens(text, all_base(text))).otherwise(tokens)
    tagged = lambda texts, made: F.transform(texts, lambda t: F.struct(F.lit(made).alias("made"), t.alias("text")))
    rows = docs.select(F.explode(F.concat(tagged(F.transform(asked, lambda x: x["text"]), False), tagged(ordinary_tokens(text), True))).alias("t"))
    rows = rows.select("t.made", evidence(F.col("t.text"), bins).alias("of"))
    counts: dict[bool, dict[tuple[int, int], int]] = {False: {}, True: {}}
    for r in rows.groupBy("made", "of.cls", "of.bin").count().collect():
        counts[r["made"]][r["cls"], r["bin"]] = r["count"]
    return step_up(counts[True], counts[False], alpha, bins=bins)


def joined(found: Column) -> Column:
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", name(x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, alpha: float = ALPHA, base: str = "base", spans_as: str = "spans") -> DataFrame:
    """docs with ``base`` and ``spans`` (arrays of start, kind, end, text, by start, then kind), under these names.

    A null text is scanned as empty. Rows are kept as they are, repeats included; columns of these names are
    replaced. Random tokens that overlap a base finding are not added. An empty table gives no rows.
    """
    below = F.array(*[F.lit(x) for x in rejected_bins(docs, alpha)])
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn(base, all_base(text))
    is_random = lambda x: let(evidence(x["text"]), lambda e: e["bin"] < F.get(below, e["cls"]))
    random = F.filter(free_tokens(text, F.col(f"`{base}`")), is_random)
    return out.withColumn(spans_as, F.array_sort(F.concat(base, random)))


def report(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """doc_id, counts of each kind, the base findings' digest and all spans, of every row of docs."""
    out = scan(docs.select("doc_id", "text"), alpha)
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]", alpha: float = ALPHA) -> DataFrame:
    """docs with every span in ``text`` replaced by a mark (overlapping spans by one), and n_chars brought up to
    date where that column exists. Null texts stay null; no row goes."""
    found = next(n for n in (f"_spans{i}" for i in range(10**6)) if n not in docs.columns and f"{n}_base" not in docs.columns)
    out = scan(docs, alpha, f"{found}_base", found)

    def step(state: Column, x: Column) -> Column:
        apart = x["start"] >= state["at"]
        piece = F.concat(F.substr(F.col("text"), state["at"] + 1, x["start"] - state["at"]), F.lit(mark))
        return F.struct(F.greatest(state["at"], x["end"]).alias("at"), F.when(apart, F.concat(state["done"], piece)).otherwise(state["done"]).alias("done"))

    first = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("done"))
    end = F.aggregate(found, first, step)
    clean = F.when(F.size(found) > 0, F.concat(end["done"], F.substr(F.col("text"), end["at"] + 1))).otherwise(F.col("text"))
    # n_chars goes first: withColumns would let it see the new text.
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(found) > 0, F.length(clean).cast("long")).otherwise(F.col("n_chars")))
    return out.withColumn("text", clean).select(*[F.col(f"`{c}`") for c in docs.columns])
