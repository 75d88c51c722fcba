"""Text functions as Spark columns; the strict tokeniser (NFKC, case folding) is an Arrow UDF."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from lodestone.functions import fixed


def words_in(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def findall(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def ngrams(text: Column, n: int) -> Column:
    """All substrings of n code points, in order; empty if there are none."""
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substr(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def tokens(text: Column) -> Column:
    """Search tokens: lower-cased runs of letters and digits without stop words; a run that starts with a CJK
    character gives its characters, then its pairs."""
    cjk = lambda t: F.regexp_like(t, F.lit("^[一-鿿]"))
    runs = findall(F.lower(text), "[一-鿿]+|[\\p{L}\\p{N}]+")
    stop = words_in(fixed.TOKEN_STOP)
    kept = F.filter(runs, lambda t: cjk(t) | ~F.array_contains(stop, t))
    general = F.flatten(F.transform(kept, lambda t: F.when(cjk(t), F.concat(ngrams(t, 1), ngrams(t, 2))).otherwise(F.array(t))))
    # Texts without CJK need one regex pass: words that are not, as a whole, stop words.
    word = "[\\p{L}\\p{N}]"
    plain = findall(F.lower(text), f"(?<!{word})(?!(?:{'|'.join(fixed.TOKEN_STOP)})(?!{word})){word}+")
    return F.when(F.regexp_like(text, F.lit("[一-鿿]")), general).otherwise(plain)


def tokens_python(text: str | None) -> list[str]:
    """The strict tokeniser of one text: compatibility normal form, then full case folding."""
    out: list[str] = []
    for run in re.findall("[一-鿿]+|[^\\W_]+", unicodedata.normalize("NFKC", text or "").casefold()):
        if "一" <= run[0] <= "鿿":
            out += list(run) + [run[i : i + 2] for i in range(len(run) - 1)]
        elif run not in fixed.TOKEN_STOP:
            out.append(run)
    return out


@F.pandas_udf(ArrayType(StringType()))
def tokens_strict(text: pd.Series) -> pd.Series:
    return text.map(tokens_python)


def terms_ascii(text: Column) -> Column:
    """Index terms: lower-cased ASCII words without stop words, then pairs of CJK runs (a lone character stays)."""
    english = F.filter(findall(F.lower(text), "[a-z0-9]+"), lambda t: ~F.array_contains(words_in(fixed.TERM_STOP), t))
    chinese = F.flatten(F.transform(findall(text, fixed.TERM_CJK), lambda p: F.when(F.length(p) == 1, F.array(p)).otherwise(ngrams(p, 2))))
    return F.concat(english, chinese)


def study_tokens(text: Column) -> Column:
    return F.filter(findall(F.lower(text), "[a-z0-9]+"), lambda t: ~F.array_contains(words_in(fixed.STUDY_STOP), t))


def query_tokens(text: Column) -> Column:
    """At most 32 distinct query tokens in first-seen order; a CJK run gives itself up to 24 characters, its
    triples, then its pairs."""
    cjk = lambda t: F.regexp_like(t, F.lit("^[一-鿿]"))
    empty = F.array().cast("array<string>")
    parts = lambda t: F.concat(F.when(F.length(t) <= 24, F.array(t)).otherwise(empty), ngrams(t, 3), ngrams(t, 2))
    runs = findall(F.lower(text), "[A-Za-z0-9_]+|[一-鿿]+")
    kept = F.filter(runs, lambda t: cjk(t) | ~F.array_contains(words_in(fixed.QUERY_STOP), t))
    return F.slice(F.array_distinct(F.flatten(F.transform(kept, lambda t: F.when(cjk(t), parts(t)).otherwise(F.array(t))))), 1, 32)


def excerpt(text: Column, limit: int) -> Column:
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.left(text, F.lit(limit - 1)), F.lit("…")))


def excerpt_around(text: Column, terms: Column, limit: int) -> Column:
    """A long text from a quarter of the limit before its first term on."""
    at = F.array_min(F.filter(F.transform(terms, lambda t: F.instr(F.lower(text), t)), lambda p: p > 0))
    start = F.greatest(F.lit(0), F.coalesce(at, F.lit(1)) - 1 - limit // 4)
    cut = F.substr(text, start + 1, F.lit(max(1, limit - 20)))
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.when(start > 0, F.lit("…")).otherwise(F.lit("")), cut, F.lit("… [片段截断]")))


def excerpt_head_tail(text: Column, head: int, tail: int) -> Column:
    return F.when(F.length(text) <= head + tail, text).otherwise(F.concat(F.left(text, F.lit(head)), F.lit("…"), F.right(text, F.lit(tail))))


def label(text: Column) -> Column:
    """The first nine words, lower-cased and joined by -, cut at 64; 'record' if there are none."""
    made = F.left(F.array_join(F.slice(findall(F.lower(text), "[\\p{L}\\p{N}]+"), 1, 9), "-"), F.lit(64))
    return F.when(made == "", F.lit("record")).otherwise(made)


def slug(text: Column, limit: int = 36) -> Column:
    made = F.regexp_replace(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", "-"), "^-+|-+$", "")
    return F.left(made, F.lit(limit))


def squeeze(text: Column) -> Column:
    """White space folded to single spaces, trimmed."""
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def signature(text: Column) -> Column:
    return F.lower(squeeze(text))


def coverage(tokens_: Column, content: Column, lowered: bool = False) -> Column:
    """The share of the tokens that the content (in lower case already, if ``lowered``) holds; null without tokens."""
    low = content if lowered else F.lower(content)
    hits = F.size(F.filter(tokens_, lambda t: F.contains(low, t)))
    return F.when(F.size(tokens_) > 0, hits / F.size(tokens_))


def lexical_score(query: Column, content: Column, index: Column, tokens_: Column | None = None, lowered: bool = False) -> Column:
    """0.4 + 0.45 coverage + 0.15 for the whole phrase, less a position penalty; within [0, 1]."""
    tokens_ = query_tokens(query) if tokens_ is None else tokens_
    phrase = F.when(F.contains(content if lowered else F.lower(content), F.lower(query)), 0.15).otherwise(0.0)
    no_tokens = F.greatest(F.lit(0.0), 1.0 - index * 0.01)
    return F.when(F.size(tokens_) == 0, no_tokens).otherwise(scored(coverage(tokens_, content, lowered), phrase, index))


def scored(share: Column, phrase: Column, index: Column) -> Column:
    """The lexical score of a share of tokens, the phrase's bonus and a place in the ranking."""
    raw = 0.4 + 0.45 * share + phrase - F.least(index * 0.0025, F.lit(0.15)) + 1e-9  # decimal ties go up
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 6)


def query_relevance(query: Column, content: Column, tokens_: Column | None = None, lowered: bool = False) -> Column:
    return F.round(F.coalesce(coverage(query_tokens(query) if tokens_ is None else tokens_, content, lowered), F.lit(0.0)), 6)


def matches(text: Column, pattern: str) -> Column:
    """Case-insensitive search; word boundaries are Unicode-aware as in the source patterns."""
    return F.regexp_like(text, F.lit("(?iU)" + pattern))


def has_any(text: Column, markers: list[str]) -> Column:
    found = F.lit(False)
    for m in markers:
        found = found | F.contains(text, F.lit(m))
    return found


def intent(query: Column) -> Column:
    out = F.lit("general")
    for name, pattern in reversed(fixed.INTENTS):
        out = F.when(matches(query, pattern), F.lit(name)).otherwise(out)
    return out


def shapes(query: Column) -> Column:
    low = F.lower(query)
    return F.array_compact(F.array(*[F.when(has_any(low, markers), F.lit(name)) for name, markers in fixed.SHAPES.items()]))


def purpose(question: Column, branch: Column) -> Column:
    both = F.lower(F.concat(question, F.lit(" "), branch))
    out = F.lit("other")
    for name, markers in reversed(fixed.PURPOSES):
        out = F.when(has_any(both, markers), F.lit(name)).otherwise(out)
    return out


def needs_context(text: Column) -> Column:
    value = squeeze(text)
    return (value != "") & (matches(value, fixed.PRONOUN) | matches(value, fixed.SHORT_OPENING))


def numbers(text: Column) -> Column:
    return findall(text, "[0-9]+(?:[.,][0-9]+)*")


def ungrounded_numbers(expansion: Column, given: Column) -> Column:
    return F.array_sort(F.array_except(numbers(expansion), numbers(given)))


def forget_authorized(text: Column, quote: Column) -> Column:
    """Whether a quoted command is the text's whole opening sentence, direct and not negated."""
    value = F.trim(F.regexp_replace(text, "^Speaker:[^\\n]*\\n", ""))
    q = F.trim(quote)
    first = F.trim(F.regexp_extract(value, "^([^.!?。！？\\n]*[.!?。！？]?)", 1))
    record = F.regexp_like(value, F.lit("^[\\[{]"))
    return ~record & (q != "") & F.startswith(value, q) & matches(q, fixed.DIRECT_QUOTE) & (F.length(q) >= F.length(first)) & ~matches(first, fixed.NEGATED)


def time_quote_supported(expression: Column, passage: Column, year: Column) -> Column:
    """Whether the expression is quoted in the passage and its year stands there as a whole number."""
    quoted = F.contains(signature(passage), signature(expression)) & (squeeze(expression) != "")
    return quoted & F.array_contains(findall(passage, "[0-9]+"), year.cast("string"))


def source_time(ms: Column) -> Column:
    return F.coalesce(F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss'+00:00'"), F.lit("unknown (do not infer a date)"))


def iso_millis(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def stable_id(prefix: str, *parts: Column) -> Column:
    """Opaque id over the parts, spaces folded and lower-cased: a truncated SHA-256."""
    return F.concat(F.lit(prefix + "_"), F.left(F.sha2(F.concat_ws("\x1f", *[signature(p.cast("string")) for p in parts]), 256), F.lit(32)))


def payload_digest(**columns: Column) -> Column:
    """SHA-256 of the canonical JSON of the columns: keys in order, compact."""
    return F.sha2(F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)])), 256)


def evidence_header(role: Column, ms: Column) -> Column:
    return F.concat(F.lit("Message role: "), role, F.lit("; said at "), source_time(ms), F.lit(" (not an event date)."))


def render_evidence(position: Column, role: Column, ms: Column, text: Column) -> Column:
    return F.concat(F.lit("Evidence "), position.cast("string"), F.lit("\n"), evidence_header(role, ms), F.lit("\nSelected original text:\n"), text)
