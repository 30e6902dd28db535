"""Best-fit packing of documents into fixed-length sequences.

The plan is made over the histogram of piece lengths, never over documents: at most ``size`` distinct lengths
reach the driver, and best-fit decreasing places whole counts of equal pieces into whole groups of equal sequences.
Pieces then take planned slots by their rank within their length. Ranks come from two levels, salted by about the
square root of the number of pieces, so a length that a third of all pieces share spreads over many tasks.

Size of the plan: a group of sequences with r tokens free has less than r / 2 free after a length that fits was
placed in it, so each group is used at most log2(size) times, and each length makes at most three new groups.
That bounds the plan by 3 * size * log2(size) rows whatever the input, so it may be broadcast.

Edge cases: a null or empty text is one piece that holds the end id alone; rows with a null doc_id take no part; a
repeated row is packed each time it comes; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BATCH_BYTES, slices, texts_of, written
from .tokens import crc32, encoder, tokenizer_path, with_end

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int) -> DataFrame:
    """One row for each piece of at most ``size`` tokens of each document; only longer documents are cut."""

    def run(batches):
        encode = encoder(tokenizer).encode
        for batch in slices(batches, BATCH_BYTES):
            ids, bounds = with_end(*encode(batch.column("text")), end_id)
            lengths = np.diff(bounds)
            pieces = -(-lengths // size)
            row = np.repeat(np.arange(len(lengths)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * size
            length = np.minimum(size, lengths[row] - start)
            at = bounds[row] + start
            sums = [crc32(ids[a:b]) for a, b in zip(at.tolist(), (at + length).tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(sums, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts_of(docs).mapInArrow(run, PIECES)


def best_fit_plan(histogram: dict[int, int], size: int) -> dict[str, np.ndarray]:
    """Best-fit decreasing over counts. Row i says: the ``count`` pieces of ``length`` from rank ``rank`` on go to the
    sequences from ``sequence`` on, ``per`` to each, the first at place ``base``."""
    free: dict[int, list[tuple[int, int]]] = {}  # room left -> groups (first sequence, how many)
    rooms: list[int] = []
    rows: list[tuple[int, int, int, int, int, int]] = []
    made = 0

    def put(room: int, group: tuple[int, int]) -> None:
        if room and group[1]:
            if room not in free:
                free[room] = []
                insort(rooms, room)
            free[room].append(group)

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, many = free[room].pop()
                if not free[room]:
                    del free[room], rooms[at]
            else:
                room, first, many = size, made, -(-left // (size // length))
                made += many
            per = room // length
            full = min(many, left // per)
            if full:
                rows.append((length, rank, full * per, first, per, size - room))
                put(room - per * length, (first, full))
                rank, left = rank + full * per, left - full * per
            if full < many:
                if left:
                    rows.append((length, rank, left, first + full, left, size - room))
                    put(room - left * length, (first + full, 1))
                    full, rank, left = full + 1, rank + left, 0
                put(room, (first + full, many - full))
    columns = zip(*rows) if rows else [[]] * 6
    return dict(zip(("length", "rank", "count", "sequence", "per", "base"), (np.array(c, np.int64) for c in columns)))


def pack(pieces: DataFrame, size: int, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``pieces`` (with a column ``length`` from 1 to ``size``) with sequence_id and offset. ``pieces`` is read more
    than once, so it should be a table."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    plan = best_fit_plan(histogram, size)
    order_key = np.argsort((plan["length"] << 44) | plan["rank"], kind="stable")
    shared = spark.sparkContext.broadcast({k: v[order_key] for k, v in plan.items()})
    columns = pieces.columns
    salts = max(16, math.isqrt(sum(histogram.values())))
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    before = salted.groupBy("length", "__salt").agg(F.count("*").alias("__n")).withColumn("__before", F.sum("__n").over(Window.partitionBy("length").orderBy("__salt")) - F.col("__n")).drop("__n")
    ranked = salted.withColumn("__rank", F.row_number().over(Window.partitionBy("length", "__salt").orderBy(*order)) - 1)
    ranked = ranked.join(before, ["length", "__salt"]).select(*pieces.columns, (F.col("__before") + F.col("__rank")).alias("__rank"))

    def place(batches):
        rows = shared.value
        keys = (rows["length"] << 44) | rows["rank"]
        for batch in batches:
            rank, length = batch.column("__rank").to_numpy(), batch.column("length").to_numpy()
            at = np.searchsorted(keys, (length << 44) | rank, side="right") - 1
            place, per = rank - rows["rank"][at], rows["per"][at]
            kept = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(rows["sequence"][at] + place // per), pa.array(rows["base"][at] + place % per * length)], [*columns, "sequence_id", "offset"])

    return ranked.mapInArrow(place, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, size: int = 4096) -> DataFrame:
    """Every document's pieces with their sequence and place in it."""
    return pack(written(token_pieces(docs, tokenizer or tokenizer_path("word_bpe_49k.json"), end_id, size), "pieces"), size)
