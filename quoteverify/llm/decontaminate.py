"""Benchmark decontamination with DataFrame functions alone.

A document is contaminated by an item if one of its windows as long as the item (in words) has a weighted similarity of
0.8 or more with it, over shingles of five words.

1. Windows. The similarity asks for no order, so every window one item long counts, wherever in it the shingles lie. A
   match has at least 0.8 of the item's weight in common, so the places that hold an item's shingles are summed over each
   stretch of starts (every shingle counts in the n windows that cover it), and just the windows whose sum reaches that
   are formed: no other can match. Shingles that other items have too are left out of that search, the most shared first, as
   long as they make up a tenth of the item's weight at most, and the bound falls by what they weigh: a phrase of all items
   doesn't bring all of them together with all documents that have it. Equal windows are handled once, whatever number of
   documents has them.
2. SimHash. Each distinct window and each item gets 64 bits: a bit is 1 if the weights of the shingles whose hash has it
   outweigh the others.
3. Multi-index. The 64 bits fall into 8 blocks. Of two fingerprints within ``RADIUS`` = 23 bits, at least one block
   differs by 2 bits or fewer (8 blocks with 3 each would be 24). Items are listed under every value within 2 bits of
   each of their blocks, windows look their 8 values up: no pair within the radius is lost. At a similarity of 0.8
   the expected distance is 9.7 bits with a deviation of 2.9, so the radius leaves out fewer than 1 pair in 10^5.
4. Verification. Candidates keep their place only if the exact weighted similarity is 0.8 or more: the sum over
   shingles of weight * the lesser count, over that of weight * the greater count.

Weights: ln(1 + items / items with the shingle), so what many items share weighs less; the greatest weight for shingles
that no item has. Words: runs of letters and digits, lowered. Shingles are 64-bit hashes of five words; fewer words
are one shingle.

The anchors' table is broadcast only if it was counted to be small; else the join shuffles, where Spark splits hot keys.

Edge cases: null or empty texts and items without a word have no shingles and match nothing; rows with a null key take
no part; repeated items match each under their id; a repeated doc_id counts its windows together; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import texts_of, written

SHINGLE, SIMILARITY = 5, 0.8
RADIUS, BLOCKS = 23, 8
#: Share of an item's weight that its most shared shingles may have to be left out of the search for windows.
SPARED = 0.1
#: Rows of anchors up to which they are broadcast (about 50 bytes each).
BROADCAST_ROWS = 1_000_000


def shingles(text: Column) -> Column:
    """The hashes of each five consecutive words, in order."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def of(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(SHINGLE))))
        return F.when(F.size(w) >= SHINGLE, many).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))

    return F.element_at(F.transform(F.array(words), of), 1)  # names the words once


def fingerprints(rows: DataFrame, key: str) -> DataFrame:
    """key, fp of the rows (key, h, weight): 64 weighted votes."""
    votes = rows.groupBy(key).agg(*(F.sum(F.when(F.expr(f"(h & {1 << b if b < 63 else -(1 << 63)}L) <> 0" if b < 63 else "h < 0"), F.col("weight")).otherwise(-F.col("weight"))).alias(f"b{b}") for b in range(64)))
    bits = [F.when(F.col(f"b{b}") > 0, F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")) for b in range(64)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return votes.select(key, total.alias("fp"))


def block_values(fp: Column) -> Column:
    width = 64 // BLOCKS
    return F.array(*(F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(fp, k * width).bitwiseAND(F.lit((1 << width) - 1)).alias("value")) for k in range(BLOCKS)))


def decontaminate(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, similarity (of the best window), windows, first_word (where the first one starts)."""
    hashed = lambda df: df.withColumn("sh", shingles(F.col("text"))).drop("text")
    bench = written(hashed(texts_of(items, "item_id")).withColumnRenamed("doc_id", "item_id").where(F.size("sh") > 0), "items")
    n_items = bench.count()
    weights = written(bench.select("item_id", F.explode("sh").alias("h")).groupBy("h").agg(F.log(1 + F.lit(n_items) / F.count_distinct("item_id")).alias("weight")), "weights")
    most = F.lit(1 + n_items).cast("double")
    weighted = lambda rows: rows.join(weights, "h", "left").withColumn("weight", F.coalesce("weight", F.log(most)))

    item_rows = written(weighted(bench.select("item_id", F.explode("sh").alias("h"))), "item_rows")
    # what many items share comes first by weight and goes as long as little weight goes with it; the rest must hold the more
    mass = item_rows.groupBy("item_id", "h").agg(F.sum("weight").alias("mass"), F.first("weight").alias("weight"))
    whole = Window.partitionBy("item_id")
    mass = mass.withColumn("total", F.sum("mass").over(whole)).withColumn("so_far", F.sum("mass").over(whole.orderBy("weight", "h")))
    shared = (F.col("so_far") <= SPARED * F.col("total")) & (F.col("weight") < F.log(most) - 1e-9)
    mass = mass.withColumn("spared", F.sum(F.when(shared, F.col("mass")).otherwise(0.0)).over(whole)).where(~shared)
    anchors = mass.select("item_id", "h", "weight", (F.col("total") * similarity - F.col("spared")).alias("needed")).join(bench.select("item_id", F.size("sh").alias("n")).distinct(), "item_id")
    small = anchors.count() <= BROADCAST_ROWS
    places = texts_of(docs).select("doc_id", shingles(F.col("text")).alias("sh")).select("doc_id", F.size("sh").alias("size"), F.posexplode("sh").alias("p", "h"))
    hits = places.join(F.broadcast(anchors) if small else anchors, "h")
    # a shingle's weight comes in at the first start whose window covers it and goes after the last one
    covers = F.array(F.struct(F.greatest(F.col("p") - F.col("n") + 1, F.lit(0)).alias("start"), F.col("weight").alias("step")), F.struct((F.least(F.col("p"), F.greatest(F.col("size") - F.col("n"), F.lit(0))) + 1).alias("start"), (-F.col("weight")).alias("step")))
    steps = hits.select("doc_id", "item_id", "n", "needed", F.inline(covers)).groupBy("doc_id", "item_id", "n", "needed", "start").agg(F.sum("step").alias("step"))
    along = Window.partitionBy("doc_id", "item_id", "n", "needed").orderBy("start")
    held = steps.withColumn("held", F.sum("step").over(along)).withColumn("next", F.lead("start").over(along)).where(F.col("held") >= F.col("needed") - 1e-6)
    starts = written(held.select("doc_id", F.explode(F.sequence(F.col("start"), F.col("next") - 1)).alias("start"), "n").distinct().groupBy("doc_id").agg(F.collect_set(F.struct("start", "n")).alias("at")), "starts")
    contents = hashed(texts_of(docs).join(starts, "doc_id"))
    # a window that passes the text's end moves back into it
    windows = contents.select("doc_id", F.explode(F.transform("at", lambda w: F.struct(F.greatest(F.least(w["start"], F.size("sh") - w["n"]), F.lit(0)).alias("start"), w["n"].alias("n"), F.slice("sh", F.greatest(F.least(w["start"], F.size("sh") - w["n"]), F.lit(0)) + 1, w["n"]).alias("sh")))).alias("w"))
    windows = written(windows.select("doc_id", "w.start", "w.n", "w.sh").withColumn("window", F.xxhash64("n", "sh")), "windows")
    distinct = written(windows.groupBy("window").agg(F.first("sh").alias("sh"), F.first("n").alias("n")), "distinct")
    window_rows = written(weighted(distinct.select("window", F.explode("sh").alias("h"))), "window_rows")

    width = 64 // BLOCKS
    within = radius // BLOCKS
    flips = [sum(1 << b for b in chosen) for k in range(within + 1) for chosen in combinations(range(width), k)]
    listed = fingerprints(item_rows, "item_id").select("item_id", F.col("fp").alias("item_fp"), F.explode(block_values(F.col("fp"))).alias("b"))
    listed = listed.select("item_id", "item_fp", "b.block", F.explode(F.transform(F.array(*map(F.lit, flips)), lambda x: F.col("b.value").bitwiseXOR(x.cast("long")))).alias("value")).join(bench.select("item_id", F.size("sh").alias("n")).distinct(), "item_id")
    asked = fingerprints(window_rows, "window").join(distinct.select("window", "n"), "window").select("window", "n", "fp", F.explode(block_values(F.col("fp"))).alias("b")).select("window", "n", "fp", "b.block", "b.value")
    candidates = asked.join(listed, ["n", "block", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius).select("window", "item_id").distinct()

    counted = lambda rows, key: rows.groupBy(key, "h").agg(F.count("*").alias("times"), F.first("weight").alias("weight"))
    total = lambda rows, key, name: rows.groupBy(key).agg(F.sum("weight").alias(name))
    of_windows, of_items = counted(window_rows, "window"), counted(item_rows, "item_id")
    common = candidates.join(of_windows, "window").join(of_items.select("item_id", "h", F.col("times").alias("item_times")), ["item_id", "h"])
    common = common.groupBy("window", "item_id").agg(F.sum(F.least("times", "item_times") * F.col("weight")).alias("common"))
    scored = common.join(total(window_rows, "window", "a"), "window").join(total(item_rows, "item_id", "b"), "item_id").withColumn("similarity", F.col("common") / (F.col("a") + F.col("b") - F.col("common")))
    matched = written(scored.where(F.col("similarity") >= similarity - 1e-9).select("window", "item_id", "similarity"), "matched")
    found = windows.select("doc_id", "start", "window").join(matched, "window")
    return found.groupBy("doc_id", "item_id").agg(F.round(F.max("similarity"), 6).alias("similarity"), F.count_distinct("start").alias("windows"), F.min("start").cast("long").alias("first_word"))


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that no item contaminates; each row by itself, also of those that share a
    doc_id, and rows without a doc_id too."""
    row = F.xxhash64(docs["doc_id"], F.coalesce(docs["text"], F.lit("")))
    leaked = written(decontaminate(docs.select(row.alias("doc_id"), "text"), items).select(F.col("doc_id").alias("__leaked")).distinct(), "leaked")
    return docs.join(leaked, row == leaked["__leaked"], "left_anti")
