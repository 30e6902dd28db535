"""Texts of images: injected engines read each distinct content once, and the reading that counts is chosen in Spark.

An engine is a callable ``(content: bytes) -> list of (text, confidence)`` words in lines, ``[[(word, confidence), …], …]``;
what it raises is kept as its error. No engine ships with the package.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoteverify.functions import constants as C
from quoteverify.functions.normalize import arabic_word_count, normalize, words
from quoteverify.operators import readings
from quoteverify.sources.files import distinct_contents

READINGS = "digest string, engine string, ordinal int, text string, conf double, uncertain array<string>, error string"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, digest), one row for each distinct content."""
    return distinct_contents(spark.read.format("binaryFile").load(path).select("path", "content"))


def readings_of(files: DataFrame, engines: dict[str, Callable[[bytes], list]]) -> DataFrame:
    """READINGS: what each engine reads in each image, or its error."""
    names = ["digest", "engine", "ordinal", "text", "conf", "low", "error"]

    def run(batches):
        for batch in batches:
            rows = []
            for digest, content in zip(batch.column("digest").to_pylist(), batch.column("content").to_pylist()):
                for no, (name, engine) in enumerate(engines.items()):
                    try:
                        lines = engine(content)
                    except Exception as error:
                        rows.append((digest, name, no, None, None, [], f"{type(error).__name__}: {error}"))
                        continue
                    sure = [c for line in lines for _, c in line if c is not None and c >= 0]
                    low = [w for line in lines for w, c in line if c is not None and 0 <= c < C.WORD_CONFIDENCE]
                    rows.append((digest, name, no, "\n".join(" ".join(w for w, _ in line) for line in lines), sum(sure) / len(sure) if sure else 0.0, low, None))
            kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    raw = files.select("digest", "content").mapInArrow(run, "digest string, engine string, ordinal int, text string, conf double, low array<string>, error string")
    spelled = F.array_distinct(F.flatten(F.transform("low", lambda w: words(normalize(w)))))
    return raw.select("digest", "engine", "ordinal", "text", "conf", spelled.alias("uncertain"), "error")


def chosen(read: DataFrame, vocabulary: DataFrame, local: str) -> DataFrame:
    """(digest, text, engine, uncertain, problem) of each image. The local engine's reading counts if it is reliable and says
    the same as the first other engine that read anything; else that other reading; without one the local reading, marked
    as low. problem: what kept the other engines from reading."""
    lines = read.where(F.col("engine") == local).select(F.col("digest").alias("reading"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "text"))
    counts = readings.line_counts(lines, vocabulary).groupBy(F.col("reading").alias("digest")).agg(F.sum("real").alias("real"), F.sum("junk").alias("junk"))
    mine = read.where((F.col("engine") == local) & F.col("text").isNotNull()).join(counts, "digest")
    ok = (arabic_word_count(F.col("text")) >= 2) & readings.is_reliable(F.col("conf"), F.col("text"), F.col("uncertain"), F.col("real"), F.col("junk"))
    mine = mine.select("digest", F.trim("text").alias("mine"), F.col("uncertain").alias("mine_uncertain"), ok.alias("ok"))
    others = read.where(F.col("engine") != local).withColumn("text", readings.tidied(F.col("text")))
    good = others.where(arabic_word_count(F.col("text")) >= 1).groupBy("digest").agg(F.min_by(F.struct("text", "engine"), "ordinal").alias("other"))
    kinds = readings.engine_problem(F.col("error"))
    problem = others.where("error IS NOT NULL").groupBy("digest").agg(F.when(F.bool_or(kinds == "quota"), "quota").otherwise("error").alias("problem"))
    both = read.select("digest").distinct().join(mine, "digest", "left").join(good, "digest", "left").join(problem, "digest", "left")
    agrees = readings.same_reading(normalize(F.coalesce("mine", F.lit(""))), normalize(F.coalesce("other.text", F.lit(""))))
    which = readings.chosen_engine(F.coalesce("ok", F.lit(False)), F.col("mine").isNotNull(), agrees, F.col("other").isNotNull())
    both = both.withColumn("which", which)
    is_other = F.col("which") == "vision"
    return both.select(
        "digest", F.when(is_other, F.col("other.text")).otherwise(F.col("mine")).alias("text"),
        F.when(is_other, F.col("other.engine")).when(F.col("which") == "local", local).when(F.col("which") == "local-low", f"{local}-low").alias("engine"),
        F.when(is_other, F.array().cast("array<string>")).otherwise(F.col("mine_uncertain")).alias("uncertain"), F.when(~is_other, F.col("problem")).alias("problem"),
    )
