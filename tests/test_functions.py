"""Golden values of the scalar functions."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from oremill.functions import pricing, text
from oremill.sources.views import TITLES

#: One sentence a rule; values worked out by hand.
PRICES = [
    ("Starter plan: $12 per month, or pay $96 per year", [12.0, 8.0]),  # each amount has its nearest marker
    ("yearly $60 monthly", [5.0]),  # equally near: the year
    ("$24 yearly then $3 monthly", [2.0, 3.0]),  # no marker is reached across another amount
    ("30% off: $21/mo", [21.0]),  # percentages are no amounts
    ("$1,100 monthly", [1100.0]), ("$2,500 per month", [2500.0]), ("$2,501 per month", []),  # thousands, and the limit
    ("we lost $300 per month to churn", []), ("it is worth $40/mo", []), ("our budget: $90 per month", []),  # losses and budgets are no offers
    ("$8 for the smallest of all teams, each month", []), ("$45 once", []),  # no marker within reach
    ("free for one user, $7/mo beyond", [7.0, 0.0]), ("$0 and free", [0.0]), ("free of charge", [0.0]),  # free tiers, once
    ("no prices here", []), ("", []), (None, []),
]
LABELS = [
    "problem_aware workaround", "workaround comparison", "transactional budget_roi", "switching", "budget_roi", "solution_aware feature_request", "anti_demand", "solution_aware",
    "workaround comparison", "workaround feature_request", "transactional budget_roi", "comparison switching", "problem_aware", "workaround comparison feature_request", "", "budget_roi",
]


ODD = (
    "https://e.com/a b?x=1", "http://u:p@WWW.E.com:80/a b/?b=x%20y&a=1+2#t", "//e.com//p//?q=caf%C3%A9&=v&k=", "e.com/no scheme?x=1&x=0", "HTTPS://e.com/%7Eme/?z=a=b&y=100%25&~t=*&j",
    "  https://e.com/list?tags=a,b|c d&a.b=1 ", "ftp://e.com?q=a/b", "https://[::1]:8080/x", "https://e.com/?u=1%2B1&v=%zz&w=a%zz+b", "#only", "?a=1", "   ", "", "mailto:me@e.com", "https://e.com/é?ü=ß", "https://e.com/a?b=c?d=e&f=g#h?i",
)


def test_odd_urls_as_the_library_splits_them(spark):
    want = text._decoded(pd.Series(list(ODD))).tolist()
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(ODD)], "i int, u string").select("i", text.canonical_url(F.col("u")).alias("c")).collect()
    assert [r.c for r in sorted(rows)] == want


def one(spark, value, *columns):
    return tuple(spark.range(1).select(F.lit(value).cast("string").alias("x")).select(*[c(F.col("x")) for c in columns]).first())


def test_prices(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(PRICES)], "i int, x string")
    got = [[p.amount_monthly for p in r.p] for r in df.select("i", pricing.parse_prices("x").alias("p")).orderBy("i").collect()]
    assert got == [w for _, w in PRICES]


@pytest.mark.parametrize("amounts,want", [([4.0, 4.0, 6.0, 50.0], (4, 0, 4.0, 5.0, 17.0)), ([0.0, 10, 20, 30], (3, 1, 15, 20, 25)), ([15.0], (1, 0, 15, 15, 15)), ([0.0], (0, 1, None, None, None))])
def test_bands(spark, amounts, want):
    df = spark.createDataFrame([("k", float(a)) for a in amounts], "k string, a double")
    r = pricing.price_band(df.groupBy("k", F.col("a").alias("amount")).agg(F.count("*").alias("rows")), ["k"]).first()
    got = (r.n, r.free_tier_count, r.p25, r.median_monthly, r.p75)
    assert all(g == w or abs(g - w) < 1e-9 for g, w in zip(got, want))


def test_intents(spark):
    df = spark.createDataFrame(list(enumerate(TITLES)), "i int, x string")
    assert [" ".join(r.l) for r in df.select("i", text.intents(F.col("x")).alias("l")).orderBy("i").collect()] == LABELS


@pytest.mark.parametrize("url,want", [
    ("https://WWW.Shop.Test/goods/?utm_campaign=z&page=3&gclid=q#top", "https://shop.test/goods?page=3"), ("http://b.test:81//", "http://b.test/"), ("", ""), (None, ""),
    ("https://b.test?y=2&x=1&z=", "https://b.test/?x=1&y=2"), ("https://me:pw@www.B.test/q/", "https://b.test/q"), ("https://b.test/p?REF=1", "https://b.test/p?REF=1"),
])
def test_canonical_url(spark, url, want):
    assert one(spark, url, text.canonical_url, text.canonical_url_decoded) == (want, want)


def test_normal_forms(spark):
    assert one(spark, " some   text\n&amp; more ", text.norm_text, text.html_text, text.near_key) == ("some text & more", "some text & more", "some text more")
    assert one(spark, None, text.norm_text, text.near_key) == ("", "")
    assert one(spark, "a &eacute; b", text.html_text) == ("a é b",)
    odd = "x\u00a0\u2003y\x1fz\x85 \u3000w"
    assert one(spark, odd, text.norm_text, text.html_text) == ("x y z w", "x y z w")
    assert one(spark, "  Two\t Words ", text.norm_query) == ("two words",)


def test_sentences_and_compress(spark):
    assert one(spark, "Short. A long enough sentence! Another one that is long?\nAnd a last line here", text.sentences) == (["A long enough sentence!", "Another one that is long?", "And a last line here"],)
    long = "word " * 40
    (got,) = one(spark, long + ". rest", text.compress)
    assert got == ("word " * 40)[:99].rsplit(" ", 1)[0].rstrip() + "…" and len(got) <= 100
    assert one(spark, "?free trial", text.compress) == ("?free trial",)
    assert one(spark, None, text.compress) == ("",)


def test_leaks_and_json(spark):
    assert one(spark, '{"a": "see ev_0012ab"}', text.carries_text) == (True,)
    assert one(spark, '{"a": 5, "b": "fine"}', text.carries_text) == (False,)
    assert one(spark, '{"a": "' + "x" * 200 + '"}', text.carries_text) == (True,)
    assert one(spark, '```json\n[{"a": 1}]\n```', text.strip_fences) == ('[{"a": 1}]',)
    assert one(spark, 'Here: {"a": 1} done', text.strip_fences) == ('{"a": 1}',)


def test_cosine(spark):
    rows = [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 2.0], 0.0), ([], [], 0.0), (None, [1.0], 0.0), ([0.0], [1.0], 0.0), ([1.0], [1.0, 2.0], 0.0)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>, w double")
    assert all(abs(r.c - r.w) < 1e-12 for r in df.select("w", text.cosine(F.col("a"), F.col("b")).alias("c")).collect())


def test_found_agrees_with_the_patterns(spark):
    """Alternatives tried behind a substring search find what the whole pattern finds without regard to case."""
    from oremill.functions.vocabulary import INTENTS, PRICE_SIGNAL

    texts = [
        *TITLES, "MANUALLY", "duct tape", "ducttaped", "copy.paste", "copy paste", "why isnt it", "WHY DOESN'T it", "takes forever", "take forever", "$ 5", "$5,00", "best x for y", "\u017fpreadsheet",
        "\u212aeyword pr\u0130cing", "licence", "license", "save 10", "saves 5", "move off", "/mo", "a/mo", "a _paid", "looking for a tool", "need tool", "hours per week", "", "nothing at all",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "x string").withColumn("fold", text.folded(F.col("x")))
    for p in (*INTENTS.values(), PRICE_SIGNAL):
        rows = df.select("x", text.matches(F.col("x"), p).alias("m"), text.found(F.col("fold"), p).alias("a")).collect()
        assert not [r.x for r in rows if r.m != r.a], p
        assert any(r.a for r in rows) and not all(r.a for r in rows)


def test_rendering(spark):
    assert one(spark, "<a href=\"x\">T's & co</a>", text.html_escape) == ("&lt;a href=&quot;x&quot;&gt;T&#x27;s &amp; co&lt;/a&gt;",)
    for x in ("o'neil the-dev", "TWO words", "3d printers", "é à", ""):
        assert one(spark, x, text.title_case) == (x.title(),)
    df = spark.createDataFrame([(2.675, 2), (0.125, 2), (1.005, 2), (-0.5, 0), (0.35, 1), (71.25, 1)], "x double, n int")
    for r in df.collect():
        assert df.filter(F.col("x") == r.x).select(text.py_round("x", r.n)).first()[0] == round(r.x, r.n)
    assert spark.range(1).select(text.percent(F.lit(0.125)), text.percent(F.lit(1.0))).first()[:] == ("12%", "100%")
    text.register(spark)
    assert spark.sql("SELECT html_text('a &eacute;'), canonical_url('https://A.test/x/'), parse_prices('$5/mo')[0].amount_monthly").first()[:] == ("a é", "https://a.test/x", 5.0)
