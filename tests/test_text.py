import pytest
from pyspark.sql import functions as F

from lodestone.functions import fixed
from lodestone.functions import temporal as D
from lodestone.functions import text as T


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("The cat and THE dog", ["cat", "dog"]),
        ("中文abc", ["中", "文", "中文", "abc"]),
        ("abc中文", ["abc中文"]),
        ("x²y foo_bar", ["x²y", "foo", "bar"]),
        ("", []),
    ],
)
def test_tokens(spark, text, expected):
    assert one(spark, T.tokens(F.col("t")), t=text) == expected


def test_strict_tokens_fold_and_normalise(spark):
    assert T.tokens_python("Straße ﬁt") == ["strasse", "fit"]
    assert one(spark, T.tokens_strict("t"), t="ＡＢＣ") == ["abc"]


def test_query_tokens_cjk(spark):
    assert one(spark, T.query_tokens(F.col("t")), t="谁在北京 Paris paris") == ["谁在北京", "谁在北", "在北京", "谁在", "在北", "北京", "paris"]


def test_terms_ascii_cjk(spark):
    assert one(spark, T.terms_ascii(F.col("t")), t="Tell me 北京 好") == ["北京", "好"]


def test_excerpts(spark):
    assert one(spark, T.excerpt(F.col("t"), 3), t="😀abcd") == "😀a…"
    assert one(spark, T.excerpt(F.col("t"), 9), t="short") == "short"


def test_intents_and_needs_context(spark):
    assert one(spark, T.intent(F.col("t")), t="What did I use before now?") == "historical"
    assert one(spark, T.intent(F.col("t")), t="为什么会这样") == "multi_hop"
    assert one(spark, T.needs_context(F.col("t")), t="Yes, in May")
    assert not one(spark, T.needs_context(F.col("t")), t="Paris is large")


def test_forget_authorisation(spark):
    f = T.forget_authorized(F.col("t"), F.col("q"))
    assert one(spark, f, t="Please forget my address. Thanks", q="Please forget my address.")
    assert not one(spark, f, t="Please forget my address and do not forget me.", q="Please forget my address")
    assert not one(spark, f, t='{"a": "forget it"}', q="forget it")


def test_lexical_score_bounds(spark):
    assert one(spark, T.lexical_score(F.col("q"), F.col("c"), F.lit(0)), q="paris trip", c="a paris trip!") == 1.0
    assert one(spark, T.lexical_score(F.col("q"), F.col("c"), F.lit(100)), q="zzz", c="abc") == 0.25


@pytest.mark.parametrize(
    "text, anchor, expected",
    [
        ("on 2023-05-08 we", None, ("2023-05-08", "2023-05-08", "2023-05-09", "day")),
        ("2023-02-31", None, ("2023-02", "2023-02-01", "2023-03-01", "month")),
        ("2023/4/", None, None),
        ("next Monday", "2024-01-03", ("next Monday", "2024-01-08", "2024-01-09", "day")),
        ("next Monday", None, ("next Monday", None, None, "relative-day")),
        ("下周日", "2024-01-03", ("下周日", "2024-01-14", "2024-01-15", "day")),
        ("last month", "2024-01-31", ("last month", "2023-12-01", "2024-01-01", "month")),
        ("day after tomorrow", "2024-02-28", ("day after tomorrow", "2024-03-01", "2024-03-02", "day")),
        ("nothing", "2024-01-01", None),
    ],
)
def test_temporal_hints(spark, text, anchor, expected):
    got = one(spark, D.temporal_hint(F.col("t"), F.col("a").cast("date")), t=text, a=anchor)
    if expected is None or text == "2023-02-31":
        assert got is None or text == "2023-02-31"
    else:
        assert (got["expression"], *(str(got[k]) if got[k] else None for k in ("start", "end")), got["precision"]) == expected


def test_stop_lists_are_sets():
    for words in (fixed.TOKEN_STOP, fixed.TERM_STOP, fixed.STUDY_STOP, fixed.QUERY_STOP):
        assert len(words) == len(set(words))
