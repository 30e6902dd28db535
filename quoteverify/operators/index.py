"""Index tables over a corpus: positions, word pairs, postings and term statistics. Each is an ordinary
DataFrame; what searches read again and again is written as a table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoteverify.functions import constants as C
from quoteverify.functions.normalize import glue_tanween, normalize, words
from quoteverify.session import held

CHUNK = 64


def tokens(rows: DataFrame, key: str, text: str = "text", profile: str = "latin") -> DataFrame:
    """(key, pos, word) of every word of the normalised text, pos from 0."""
    return rows.select(key, F.posexplode(words(normalize(F.col(text), profile))).alias("pos", "word"))


def vocabulary(*word_columns: DataFrame) -> DataFrame:
    """The distinct words of one-column DataFrames."""
    whole = word_columns[0]
    for other in word_columns[1:]:
        whole = whole.union(other)
    return whole.toDF("word").where("word IS NOT NULL").distinct()


def adjacent(rows: DataFrame, key: str) -> DataFrame:
    """(key, pos, w1, w2) of consecutive words, from an array of words for each key: no shuffle."""
    pairs = F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda i: F.struct((i - 1).alias("pos"), F.get("words", i - 1).alias("w1"), F.get("words", i).alias("w2")))
    return rows.where(F.size("words") > 1).select(key, F.explode(pairs).alias("p")).select(key, "p.*")


def shown_words(text: Column, profile: str, uthmani: bool) -> Column:
    """The words of each white-space token with the token they come from: array of (word, display)."""
    shown = F.filter(F.split(glue_tanween(text), r"(?U)\s+"), lambda t: t != "")
    each = F.transform(shown, lambda t: F.transform(words(normalize(t, profile, uthmani)), lambda w: F.struct(w.alias("word"), t.alias("display"))))
    return F.flatten(each)


@dataclass
class Corpus:
    """Canonical passages, searchable by word pairs. ``layers``: for each spelling its number and whether it is the
    script with dagger alifs. Positions run through an axis; windows and pairs do not leave it."""

    profile: str
    layers: dict[int, bool]
    passages: DataFrame  # layer, axis, chapter, verse, text
    chunks: DataFrame  # layer, axis, chunk, entries: array of (pos, word, display, chapter, verse)
    pairs: DataFrame  # layer, axis, pos, w1, w2
    singles: DataFrame  # layer, axis, pos, word, df

    @staticmethod
    def build(passages: DataFrame, profile: str = "arabic", layers: dict[int, bool] | None = None, axis: Column | None = None) -> Corpus:
        """``passages``: layer, chapter, verse, text. ``axis``: what positions run through; the whole layer by default."""
        layers = layers or {0: False}
        passages = passages.select("layer", (F.lit("") if axis is None else axis.cast("string")).alias("axis"), "chapter", "verse", F.coalesce("text", F.lit("")).alias("text"))
        parts = []
        for layer, uthmani in layers.items():
            parts.append(passages.where(F.col("layer") == layer).withColumn("w", shown_words(F.col("text"), profile, uthmani)))
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        along = Window.partitionBy("layer", "axis").orderBy("chapter", "verse")
        placed = whole.withColumn("offset", F.sum(F.size("w")).over(along) - F.size("w"))
        entries = placed.select("layer", "axis", "chapter", "verse", "offset", F.posexplode("w").alias("i", "x")).select("layer", "axis", (F.col("offset") + F.col("i")).alias("pos"), "x.word", "x.display", "chapter", "verse")
        entries = held(entries, "entries")
        chunks = entries.groupBy("layer", "axis", F.floor(F.col("pos") / CHUNK).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("pos", "word", "display", "chapter", "verse"))).alias("entries"))
        ordered = Window.partitionBy("layer", "axis").orderBy("pos")
        pairs = entries.select("layer", "axis", "pos", F.col("word").alias("w1"), F.lead("word").over(ordered).alias("w2")).where("w2 IS NOT NULL")
        df = entries.groupBy("layer", "word").agg(F.count("*").alias("df"))
        singles = entries.select("layer", "axis", "pos", "word").join(df, ["layer", "word"])
        return Corpus(profile, layers, passages, held(chunks, "chunks"), held(pairs, "pairs"), held(singles, "singles"))


@dataclass
class Postings:
    """An inverted index with what BM25 needs. Counts within a document come from its own row, so document frequencies need no
    shuffle but that of the distinct words; postings of asked words are cut out before they are counted."""

    docs: DataFrame  # doc, norm, words, ...
    terms: DataFrame  # term, doc, tf, len
    stats: DataFrame  # term, df, idf and, once kept, most: the greatest part of a score that tf and length can make
    totals: DataFrame  # one row: n, avg_len, max_idf
    sizes: DataFrame  # one row: n, avg_len
    stored: bool = False

    @staticmethod
    def build(docs: DataFrame, key: str = "doc_id", text: str = "text", profile: str = "latin") -> Postings:
        rows = docs.withColumnRenamed(key, "doc").withColumn("norm", normalize(F.coalesce(F.col(text), F.lit("")), profile)).withColumn("words", words(F.col("norm")))
        return Postings._of(rows, _postings(rows))

    @staticmethod
    def _of(docs: DataFrame, terms: DataFrame) -> Postings:
        sizes = docs.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("avg_len"))
        found = docs.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        stats = found.join(F.broadcast(sizes)).select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"))
        return Postings(docs, terms, stats, sizes.join(F.broadcast(stats.agg(F.max("idf").alias("max_idf")))), sizes)

    @property
    def lengths(self) -> DataFrame:
        return self.docs.select("doc", F.size("words").alias("len"))

    def kept(self) -> Postings:
        """The same with its tables written, for plans that read them more than once; searches do. Documents are normalised
        once, and what each term can add to a score at most is known from then on."""
        docs = held(self.docs)
        sizes = held(docs.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("avg_len")))
        terms = held(_postings(docs))
        part = terms.join(F.broadcast(sizes)).groupBy("term").agg(F.count("*").alias("df"), F.max(saturation(F.col("tf"), F.col("len"), F.col("avg_len"))).alias("most"))
        stats = held(part.join(F.broadcast(sizes)).select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"), "most"))
        return Postings(docs, terms, stats, held(sizes.join(F.broadcast(stats.agg(F.max("idf").alias("max_idf"))))), sizes, True)

    def of_terms(self, asked: DataFrame) -> DataFrame:
        """The postings (term, doc, tf, len) of the asked words (term) alone."""
        wanted = asked.select("term").distinct()
        if self.stored:
            return self.terms.join(wanted, "term", "left_semi")
        return _postings(self.docs, wanted)


def _postings(docs: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    each = docs.select("doc", F.size("words").alias("len"), F.explode("words").alias("term"))
    if wanted is not None:
        each = each.join(wanted, "term", "left_semi")
    return each.groupBy("term", "doc", "len").agg(F.count("*").alias("tf"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def saturation(tf: Column, length: Column, avg_len: Column) -> Column:
    """What a term's count and the document's length make of the term's weight."""
    return tf * (C.BM25_K1 + 1) / (tf + C.BM25_K1 * (1 - C.BM25_B + C.BM25_B * length / avg_len))


#: Postings of a query's rarest terms that are scored first, for a score that the best documents have at least.
FIRST_POSTINGS = 1000
#: Room for the order in which floating-point numbers were added.
MARGIN = 1e-6


def bm25(asked: DataFrame, index: Postings, top: int = C.TOP_DOCS, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(q, doc, score, rank) of the best documents of each query. ``asked``: q, term and optionally boost, distinct. With an
    index that is kept, documents that can't be among the best are left out early (``_pruned``); the result is the same."""
    boost = F.col("boost") if "boost" in asked.columns else F.lit(1.0)
    wanted = asked.where(~F.col("term").isin(*exclude)) if exclude else asked
    if index.stored:
        weighed = wanted.join(index.stats, "term").withColumn("w", F.col("idf") * boost).select("q", "term", "w", "df", (F.col("w") * F.col("most")).alias("most"))
        scored = _pruned(held(weighed), index, top)
    else:
        postings = index.of_terms(wanted)
        rarity = postings.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(index.sizes)).select("term", idf(F.col("n"), F.col("df")).alias("idf"))
        weighed = wanted.join(rarity, "term").withColumn("w", F.col("idf") * boost).select("q", "term", "w")
        scored = _parts(postings, weighed, index).groupBy("q", "doc").agg(F.sum("part").alias("score"))
    # rounded, so that ties do not hang on the order of sums
    return _ranked(scored.withColumn("score", F.round("score", 9)), top).select("q", "doc", "score", "rank")


def _parts(postings: DataFrame, weighed: DataFrame, index: Postings) -> DataFrame:
    """(q, doc, term, part): what each term adds to a document's score."""
    hits = postings.join(weighed, "term").join(F.broadcast(index.sizes))
    return hits.select("q", "doc", "term", (F.col("w") * saturation(F.col("tf"), F.col("len"), F.col("avg_len"))).alias("part"))


def _ranked(scored: DataFrame, top: int) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "doc"))).where(F.col("rank") <= top)


def _pruned(weighed: DataFrame, index: Postings, top: int) -> DataFrame:
    """(q, doc, score) of all documents that may be among the best ``top``, and of no more than needed.

    1. A query's rarest terms are scored alone. The ``top``-th of these sums is a score that the best documents have at least.
    2. Its most frequent terms, as long as all they can add stays below that, can't bring a document among the best by
       themselves. So only documents with one of the other terms are looked at, and of these only those that could still reach
       it with all that the frequent terms can add.
    3. Those alone meet the postings of the frequent terms, by document and term: a word that most documents have never
       brings all of them together with a query."""
    by_rarity = Window.partitionBy("q").orderBy("df", "term")
    rare = weighed.withColumn("before", F.sum("df").over(by_rarity) - F.col("df")).where(F.col("before") < FIRST_POSTINGS).select("q", "term", "w")
    first = _ranked(_parts(index.of_terms(rare), rare, index).groupBy("q", "doc").agg(F.sum("part").alias("score")), top)
    least = held(first.where(F.col("rank") == top).select("q", (F.col("score") - MARGIN).alias("least")))
    from_frequent = Window.partitionBy("q").orderBy(F.desc("df"), "term")
    parted = weighed.join(least, "q", "left").withColumn("all", F.sum("most").over(from_frequent)).withColumn("can_wait", F.coalesce(F.col("all") < F.col("least"), F.lit(False)))
    parted = held(parted.select("q", "term", "w", "most", "least", "can_wait"))
    telling, waiting = parted.where("NOT can_wait").select("q", "term", "w"), parted.where("can_wait").select("q", "term", "w", "most")
    bound = parted.groupBy("q").agg(F.coalesce(F.sum(F.when(F.col("can_wait"), F.col("most"))), F.lit(0.0)).alias("more"), F.first("least").alias("least"))
    some = _parts(index.of_terms(telling), telling, index).groupBy("q", "doc").agg(F.sum("part").alias("score"))
    some = held(some.join(bound, "q").where(F.col("least").isNull() | (F.col("score") + F.col("more") >= F.col("least"))).select("q", "doc", "score"))
    looked = some.select("q", "doc").join(waiting.select("q", "term", "w"), "q")
    here = index.of_terms(waiting).join(some.select("doc").distinct(), "doc", "left_semi")
    late = here.join(looked, ["term", "doc"]).join(F.broadcast(index.sizes)).select("q", "doc", (F.col("w") * saturation(F.col("tf"), F.col("len"), F.col("avg_len"))).alias("score"))
    return some.unionByName(late).groupBy("q", "doc").agg(F.sum("score").alias("score"))
