"""The engine's functions under names for SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import pandas_udf

from quoteverify.functions.fuzzy import partial_ratio, ratio
from quoteverify.functions.normalize import plain
from quoteverify.operators import locate
from quoteverify.operators.cards import HtmlCards
from quoteverify.operators.segment import pieces_of
from quoteverify.session import ship


def register(spark: SparkSession, posts: DataFrame | None = None) -> None:
    """normalize_text and normalize_latin (text), fuzz_ratio and partial_ratio (a, b), align_words (words, window), and the table
    function html_cards (html). With posts (post, text) also a temporary view pieces (post, seg_no, text, marked, as_quran,
    bare_intro) of them."""
    ship(spark)

    def each(f):
        def run(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b)], dtype="float64")

        return pandas_udf(run, "double")

    spark.udf.register("normalize_text", pandas_udf(lambda s: s.map(plain, na_action="ignore"), "string"))
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION normalize_latin(t STRING) RETURNS STRING RETURN trim(regexp_replace(lower(t), '[^\\p{L}]+', ' '))")
    spark.udf.register("fuzz_ratio", each(ratio))
    spark.udf.register("partial_ratio", each(partial_ratio))
    spark.udf.register("align_words", pandas_udf(locate._align, locate.ALIGNED))
    if posts is not None:
        pieces_of(posts).createOrReplaceTempView("pieces")
    spark.udtf.register("html_cards", HtmlCards)
