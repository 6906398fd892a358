"""Table-like regions and bundle breaches on planted rows."""

from pyspark.sql import functions as F

from trivalent.operators import transcription


def test_table_reasons(spark):
    lines = ["1 2 3", "۱۲۳", "a1b2c3", "12", "456"]
    rows = spark.createDataFrame([(1, 8, lines), (2, 7, lines), (3, 9, lines[:4]), (4, 0, []), (5, 7, lines[:3] + ["12"])], "id int, shapes int, lines array<string>")
    got = {r.id: r.reasons for r in rows.select("id", transcription.table_reasons(F.col("shapes"), F.col("lines")).alias("reasons")).collect()}
    both = ["MANY_VECTOR_SHAPES", "MULTIPLE_NUMERIC_LINES"]
    assert got == {1: both, 2: both[1:], 3: both[:1], 4: [], 5: []}


def test_bundle_breaches(spark):
    pages = spark.createDataFrame([("a", n, n in (4, 5)) for n in range(1, 11)] + [("b", n, False) for n in range(1, 5)], "doc string, page int, failed boolean")
    bundles = spark.createDataFrame(
        [("a", 1, 1, 3), ("a", 2, 6, 8), ("a", 4, 7, 8), ("b", 1, 1, 1), ("b", 2, 4, 4)], "doc string, sequence int, first int, last int"
    )
    got = sorted(tuple(r) for r in transcription.bundle_breaches(bundles, pages, "doc").collect())
    assert got == sorted([("a", "SEQUENCE", 4), ("a", "OVERLAP", 7), ("a", "UNCOVERED", 9), ("a", "UNCOVERED", 10), ("b", "GAP", 2), ("b", "GAP", 3), ("b", "UNCOVERED", 2), ("b", "UNCOVERED", 3)])
    assert transcription.bundle_breaches(bundles.limit(0), pages.limit(0), "doc").count() == 0


def test_token_scores_without_tokens(spark):
    pages = spark.createDataFrame([(1,), (2,)], "page int")
    tokens = spark.createDataFrame([(1, 7000)] * 19 + [(1, 6999)], "page int, confidence int")
    got = {r.page: (r.tokens, r.mean_confidence, r.dense) for r in transcription.token_scores(pages, tokens, "page", "confidence").collect()}
    assert got == {1: (20, 6999, False), 2: (0, 0, True)}
