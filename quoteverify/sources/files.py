"""Readers and writers of the engine's file formats, with explicit schemas. Paths are whatever Spark can read."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quoteverify.functions import constants as C
from quoteverify.operators.vectors import unit
from quoteverify.operators.verdict import grade_rating

VERSES = "quran array<struct<chapter:int,verse:int,text:string>>"
BOOK = "hadiths array<struct<text:string,hadithnumber:string,arabicnumber:string,grades:array<struct<name:string,grade:string>>>>"
CASES = "id int, category string, post string, expect string, ref string, original string, uthmani boolean, alteration string"


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt over all cores where their files make fewer partitions than there are cores (one small file, say); larger
    inputs stay as they are, without a shuffle."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def read_verses(spark: SparkSession, paths: dict[int, str]) -> DataFrame:
    """(layer, chapter, verse, text) of one JSON file for each layer."""
    layers = [spark.read.schema(VERSES).json(path, multiLine=True).select(F.lit(layer).alias("layer"), F.explode("quran").alias("v")).select("layer", "v.*") for layer, path in paths.items()]
    whole = layers[0]
    for layer in layers[1:]:
        whole = whole.unionByName(layer)
    return whole


def book_rows(book: DataFrame, key: str, title: str) -> DataFrame:
    """(book, key, number, hnum, text, trusted, grade, grader, rating) of a book's JSON; blank texts are left out, numbers end
    at the point."""
    h = book.select(F.explode("hadiths").alias("h")).select("h.*").where(F.trim(F.coalesce("text", F.lit(""))) != "")
    number = F.substring_index(F.coalesce(F.nullif("arabicnumber", F.lit("")), "hadithnumber"), ".", 1)
    trusted = key in C.TRUSTED_BOOKS
    graded = F.get(F.filter("grades", lambda g: g["name"] == C.GRADER_SOURCE), F.lit(0))["grade"]
    labels = F.create_map(*(F.lit(x) for pair in C.GRADE_LABELS.items() for x in pair))
    if trusted:
        grade, grader, rating = F.lit(C.TRUSTED_GRADE), F.lit(C.TRUSTED_GRADER), F.lit("ok")
    else:
        has = graded.isNotNull() & (graded != "")
        grade = F.when(has, F.coalesce(F.try_element_at(labels, graded), graded)).otherwise(C.UNGRADED)
        grader, rating = F.when(has, C.GRADER_NAME).otherwise(""), F.when(has, grade_rating(graded)).otherwise("warn")
    return h.select(F.lit(title).alias("book"), F.lit(key).alias("key"), number.alias("number"), F.col("hadithnumber").alias("hnum"), "text", F.lit(trusted).alias("trusted"), grade.alias("grade"), grader.alias("grader"), rating.alias("rating"))


def read_books(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """All books in one table with a stable doc number: by book in the order given, then by number."""
    parts = [book_rows(spark.read.schema(BOOK).json(path, multiLine=True), key, C.BOOKS.get(key, key)).withColumn("b", F.lit(i)) for i, (key, path) in enumerate(paths.items())]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.withColumn("doc", F.col("b").cast("long") * 1_000_000_000 + F.coalesce(F.expr("try_cast(split_part(hnum, '.', 1) AS bigint)") * 1000 + F.coalesce(F.expr("try_cast(split_part(hnum, '.', 2) AS bigint)"), F.lit(0)), F.pmod(F.xxhash64("text"), F.lit(1_000_000_000)))).drop("b")


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a JSON object of strings; no rows where there is no such file."""
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return spark.createDataFrame([], "key string, value string")
    return text.select(F.explode(F.from_json("value", "map<string,string>")))


def looked_up(rows: DataFrame, table: DataFrame, key: Column, name: str, default: Column) -> DataFrame:
    """rows with the value of a small lookup table, or the default."""
    found = table.select(F.col("key").alias("__key"), F.col("value").alias("__value"))
    return rows.withColumn("__k", key).join(found, F.col("__k") == F.col("__key"), "left").withColumn(name, F.coalesce("__value", default)).drop("__k", "__key", "__value")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(word, vec) at length one, from a Parquet table (word, vec)."""
    return spark.read.parquet(path).select("word", unit(F.col("vec")).alias("vec"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(text) of the lines of text files that hold something, without a byte-order mark."""
    return spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("text")).where(F.trim("text") != "")


def write_lines(rows: DataFrame, path: str, column: str = "text") -> None:
    rows.select(F.col(column).alias("value")).write.text(path)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Labelled posts, a JSON object a line."""
    return spark.read.schema(CASES).json(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def read_reading_words(spark: SparkSession, path: str) -> DataFrame:
    """(reading, conf, text) of a reader's word tables: tab-separated, 12 columns, confidence in the 11th, text in the 12th.
    Rows of another width are left out; a reading is a file."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("reading"), F.split("value", "\t").alias("c"))
    return rows.where((F.size("c") == 12) & F.expr("try_cast(c[10] AS double)").isNotNull()).select("reading", F.expr("CAST(c[10] AS double)").alias("conf"), F.col("c")[11].alias("text"))


def distinct_contents(files: DataFrame, content: str = "content") -> DataFrame:
    """One row for each content, so that equal inputs are read once."""
    return files.withColumn("digest", F.sha2(content, 256)).dropDuplicates(["digest"])


def trained_vectors(texts: DataFrame, words: str = "words", size: int = 100, window: int = 6, min_count: int = 3, epochs: int = 8, seed: int = 1) -> DataFrame:
    """(word, vec) of a skip-gram model of the texts' words. Spark's training objective (hierarchical softmax) gives other
    values than negative sampling does; likenesses serve the same purpose."""
    from pyspark.ml.feature import Word2Vec

    model = Word2Vec(vectorSize=size, windowSize=window, minCount=min_count, maxIter=epochs, seed=seed, inputCol=words, outputCol="__v", numPartitions=1).fit(texts)
    from pyspark.ml.functions import vector_to_array

    return model.getVectors().select("word", unit(vector_to_array("vector")).alias("vec"))
