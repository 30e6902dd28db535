"""Word vectors: nearest neighbours and greatest similarity, as arrays in the JVM or blocks of a matrix in Arrow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unit(vector: Column) -> Column:
    """The vector at length one; a zero vector stays."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: x.cast("double") / F.greatest(norm, F.lit(1e-9)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(unit(a), unit(b))


def neighbours(asked: DataFrame, vectors: DataFrame, top: int = 8, block: int = 4096) -> DataFrame:
    """(word, other, sim, rank): the ``top`` most similar vectors of each asked word, itself left out. ``asked``: word, vec;
    ``vectors``: word, vec. Asked words are few (a stated query set) and meet the vectors in blocks: each side is dealt to
    groups of bounded size, and each pair of groups is one task's work."""
    import numpy as np
    import pyarrow as pa

    counts = (max(1, -(-vectors.count() // block)), max(1, -(-asked.count() // block)))
    key = lambda df, n, name: df.select("word", unit(F.col("vec")).alias("vec")).withColumn(name, F.pmod(F.xxhash64("word"), F.lit(n)).cast("int"))
    left = key(asked, counts[1], "h").select(F.col("word").alias("a_word"), F.col("vec").alias("a_vec"), "h").withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(counts[0] - 1))))
    right = key(vectors, counts[0], "g").withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(counts[1] - 1))))
    kind = dict(vectors.dtypes)["word"]
    arrow = pa.string() if kind == "string" else pa.int64()

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"word": pa.array([], arrow), "other": pa.array([], arrow), "sim": pa.array([], pa.float64())})
        matrix = lambda vecs: np.array(vecs.to_pylist(), dtype=np.float64)
        sims, names, others = matrix(a["a_vec"]) @ matrix(b["vec"]).T, a["a_word"].to_pylist(), b["word"].to_pylist()
        rows = ([], [], [])
        for i, name in enumerate(names):
            least = np.sort(sims[i])[-min(top + 1, len(others))]  # ties with the last one go by name
            near = [j for j in np.flatnonzero(sims[i] >= least - 1e-9) if others[j] != name]
            order = sorted(near, key=lambda j: (-round(float(sims[i, j]), 9), others[j]))[:top]
            for j in order:
                rows[0].append(name), rows[1].append(others[j]), rows[2].append(float(sims[i, j]))
        return pa.table({"word": pa.array(rows[0], arrow), "other": pa.array(rows[1], arrow), "sim": pa.array(rows[2], pa.float64())})

    found = left.groupBy("g", "h").cogroup(right.groupBy("g", "h")).applyInArrow(search, f"word {kind}, other {kind}, sim double")
    order = Window.partitionBy("word").orderBy(F.desc(F.round("sim", 9)), "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def greatest_similarity(asked: DataFrame, among: DataFrame, itself: bool = True, block: int = 4096) -> DataFrame:
    """(q, word, sim): the greatest cosine of each asked word with the words of its own query's list. ``asked``: q, word, vec;
    ``among``: q, other, vec. ``itself``: whether a word of the list that is the asked one counts. Both sides of a query are
    dealt to groups of bounded size, and each pair of groups is one task's work: no pair of words is ever a row."""
    import numpy as np
    import pyarrow as pa

    groups = lambda rows, name: rows.groupBy("q").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    sizes = groups(asked, "hs").join(groups(among, "gs"), "q")
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    left = asked.select("q", "word", unit(F.col("vec")).alias("a")).join(sizes, "q").withColumn("h", F.pmod(F.xxhash64("word"), F.col("hs")).cast("int")).withColumn("g", every("gs"))
    right = among.select("q", "other", unit(F.col("vec")).alias("b")).join(sizes, "q").withColumn("g", F.pmod(F.xxhash64("other"), F.col("gs")).cast("int")).withColumn("h", every("hs"))
    types = dict(asked.dtypes)

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return a.select(["q", "word"]).slice(0, 0).append_column("sim", pa.array([], pa.float64()))
        matrix = lambda vecs: np.array(vecs.to_pylist(), dtype=np.float64)
        sims = matrix(a["a"]) @ matrix(b["b"]).T
        if not itself:
            sims[np.equal.outer(np.array(a["word"].to_pylist()), np.array(b["other"].to_pylist()))] = -np.inf
        best = sims.max(axis=1)
        some = np.isfinite(best)
        return a.select(["q", "word"]).filter(pa.array(some)).append_column("sim", pa.array(best[some]))

    theirs = right.select(F.col("q").alias("their_q"), F.col("g").alias("their_g"), F.col("h").alias("their_h"), "other", "b")
    found = left.select("q", "word", "a", "g", "h").groupBy("q", "g", "h").cogroup(theirs.groupBy("their_q", "their_g", "their_h")).applyInArrow(search, f"q {types['q']}, word {types['word']}, sim double")
    return found.groupBy("q", "word").agg(F.max("sim").alias("sim"))
