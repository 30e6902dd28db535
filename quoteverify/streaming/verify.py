"""Posts that arrive on a stream. The engine's tables are static; nothing here exists in batch form only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from quoteverify.functions.normalize import normalize, words
from quoteverify.operators.segment import sentences


def read_posts(spark: SparkSession, path: str, schema: str, per_trigger: int = 1) -> DataFrame:
    """New Parquet files below a path as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def distinct_posts(posts: DataFrame, time: str, text: str, late: str = "10 minutes") -> DataFrame:
    """Posts whose content has not come within the watermark; the state forgets what is older."""
    return posts.withWatermark(time, late).withColumn("digest", F.sha2(text, 256)).dropDuplicatesWithinWatermark(["digest"])


def contained_passages(posts: DataFrame, passages: DataFrame, key: str) -> DataFrame:
    """(key, passage) of pieces that share a word pair with a static passage: a stateless stream-static join."""
    from quoteverify.operators.index import adjacent

    pairs = adjacent(passages.select("passage", words(normalize(F.col("text"), "latin")).alias("words")), "passage").select("passage", "w1", "w2").distinct()
    pieces = sentences(posts, key)
    asked = adjacent(pieces.select(key, words(normalize(F.col("text"), "latin")).alias("words")), key).select(key, "w1", "w2")
    return asked.join(F.broadcast(pairs) if pairs.count() <= 1_000_000 else pairs, ["w1", "w2"]).select(key, "passage")


def counts_by_hour(verdicts: DataFrame, time: str, late: str = "1 hour") -> DataFrame:
    """(hour, verdict, n) in windows of an hour."""
    return verdicts.withWatermark(time, late).groupBy(F.window(time, "1 hour").alias("hour"), "verdict").count().select(F.col("hour.start").alias("hour"), "verdict", F.col("count").alias("n"))


def run_batches(posts: DataFrame, analyze: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch through the batch engine; the sink gets the batch's number, so that it can write each only once."""
    return posts.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda rows, number: sink(analyze(rows), number)).trigger(availableNow=True).start()


def to_table(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """All that a stream of files has now, as a Parquet table below ``folder`` with its checkpoint beside it; nothing passes
    through the driver. Complete results replace the table with each batch; others add to it by Spark's file sink, which commits
    each batch once."""
    spark, table = stream.sparkSession, f"{folder}/table"
    out = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "complete":
        out = out.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(table))
    else:
        out = out.format("parquet").option("path", table)
    out.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(table)


def carried_flags(lines: DataFrame, key: str = "conv_id", forget_after: int | None = None) -> DataFrame:
    """(conv_id, turn, flag, carried) with the flag of the turn before in the same conversation, kept as state across
    batches. ``lines``: conv_id, turn, flag. Turns of a batch are taken in order. A stream that runs on should name
    ``forget_after``: the state of a conversation without news is dropped after so many milliseconds, and what comes later
    starts without a flag. (A run over what there is now has no need of it, and would wait for it without end.)"""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(group, frames, state):
        if forget_after and state.hasTimedOut:
            state.remove()
            return
        held = bool(state.get[0]) if state.exists else False
        rows = pd.concat(list(frames)).sort_values("turn")
        before = [held, *rows["flag"].tolist()]
        state.update((bool(before[-1]),))
        if forget_after:
            state.setTimeoutDuration(forget_after)
        yield pd.DataFrame({key: group[0], "turn": rows["turn"].tolist(), "flag": rows["flag"].tolist(), "carried": before[:-1]})

    return lines.groupBy(key).applyInPandasWithState(step, f"{key} long, turn long, flag boolean, carried boolean", "flag boolean", "append", GroupStateTimeout.ProcessingTimeTimeout if forget_after else GroupStateTimeout.NoTimeout)
