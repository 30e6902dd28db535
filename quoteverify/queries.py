"""Queries over the driver's tables; importing this module registers them with their SQL.

Bindings: ``benchmark`` holds the canonical passages (one axis each), ``documents`` the posts and the collection, ``labels``
the gradings, ``embeddings`` the word vectors, ``conversations`` posts with an order of lines.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoteverify.functions import constants as C
from quoteverify.functions.normalize import bare, normalize, with_particles, words
from quoteverify.operators import cards, evaluate, locate, readings, search, segment, vectors, verdict
from quoteverify.operators.index import Corpus, Postings, adjacent, bm25, tokens, vocabulary
from quoteverify.registry import query
from quoteverify.session import work_folder
from quoteverify.sources import files
from quoteverify.streaming import verify


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that are cut into words: that work should use all cores."""
    return files.spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def norm_sql(text: str) -> str:
    return f"trim(regexp_replace(lower({text}), '[^\\p{{L}}]+', ' ', 'g'))"


def words_sql(text: str) -> str:
    return f"list_filter(string_split({norm_sql(text)}, ' '), lambda x: x <> '')"


def tokens_sql(source: str, key: str) -> str:
    return f"SELECT {key}, CAST(unnest(range(len(w))) AS INTEGER) AS pos, unnest(w) AS word FROM (SELECT {key}, {words_sql('text')} AS w FROM {source})"


def pairs_sql(source: str, key: str) -> str:
    return f"SELECT {key}, pos, word AS w1, lead(word) OVER (PARTITION BY {key} ORDER BY pos) AS w2 FROM ({tokens_sql(source, key)}) QUALIFY w2 IS NOT NULL"


#: Sentences of documents: doc_id, no, text.
SENTENCES_SQL = "SELECT doc_id, CAST(unnest(range(len(s))) AS INTEGER) AS no, unnest(s) AS text FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '[\\n.!?;]+'), lambda x: trim(x, ' ')), lambda x: x <> '') AS s FROM documents)"


def benchmark_corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    rows = table(spark, sf_dir, "benchmark").select(F.lit(0).alias("layer"), F.col("item_id").cast("int").alias("chapter"), F.lit(1).alias("verse"), "text")
    return Corpus.build(rows, "latin", axis=F.col("chapter"))


def document_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.sentences(documents(spark, sf_dir), "doc_id").select(F.concat_ws("#", "doc_id", "no").alias("piece"), "text")


# Normalisation, tokens and indexes -----------------------------------------------------------------------------------


@query("q_normalize", f"SELECT doc_id, {norm_sql('text')} AS norm FROM documents")
def q_normalize(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", normalize(F.col("text"), "latin").alias("norm"))


@query("q_tokenize", tokens_sql("documents", "doc_id"))
def q_tokenize(spark, sf_dir):
    return tokens(documents(spark, sf_dir), "doc_id")


@query("q_vocab", f"SELECT DISTINCT word FROM ({tokens_sql('documents', 'doc_id')} UNION ALL {tokens_sql('benchmark', 'item_id')})")
def q_vocab(spark, sf_dir):
    return vocabulary(tokens(documents(spark, sf_dir), "doc_id").select("word"), tokens(table(spark, sf_dir, "benchmark"), "item_id").select("word"))


@query("q_bigram_index", pairs_sql("benchmark", "item_id"))
def q_bigram_index(spark, sf_dir):
    return adjacent(table(spark, sf_dir, "benchmark").select("item_id", words(normalize(F.col("text"), "latin")).alias("words")), "item_id")


TF_SQL = f"SELECT doc_id AS doc, word AS term, count(*) AS tf FROM ({tokens_sql('documents', 'doc_id')}) GROUP BY ALL"
LEN_SQL = f"SELECT doc_id AS doc, CAST(len({words_sql('text')}) AS INTEGER) AS len FROM documents"
STATS_SQL = "SELECT term, df, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), (SELECT count(*) AS n FROM lengths)"
INDEX_SQL = f"tf AS MATERIALIZED ({TF_SQL}), lengths AS MATERIALIZED ({LEN_SQL}), stats AS MATERIALIZED ({STATS_SQL}), totals AS (SELECT count(*) AS n, avg(len) AS avg_len, (SELECT max(idf) FROM stats) AS max_idf FROM lengths)"


@query("q_tf", TF_SQL)
def q_tf(spark, sf_dir):
    return Postings.build(documents(spark, sf_dir)).terms.select("doc", "term", "tf")


@query("q_doc_len", LEN_SQL)
def q_doc_len(spark, sf_dir):
    return Postings.build(documents(spark, sf_dir)).lengths


@query("q_idf", f"WITH {INDEX_SQL} SELECT term, df, round(idf, 6) AS idf FROM stats")
def q_idf(spark, sf_dir):
    return Postings.build(documents(spark, sf_dir)).stats.select("term", "df", F.round("idf", 6).alias("idf"))


@query("q_content_words", f"SELECT item_id, array_to_string(list_sort(list_distinct(list_filter({words_sql('text')}, lambda x: x NOT IN ('the', 'of', 'and', 'to', 'in', 'a', 'is')))), ' ') AS content FROM benchmark")
def q_content_words(spark, sf_dir):
    ws = words(normalize(F.col("text"), "latin"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.sort_array(search.content_words(ws, ("the", "of", "and", "to", "in", "a", "is"))), " ").alias("content"))


# Search --------------------------------------------------------------------------------------------------------------


def asked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(table(spark, sf_dir, "benchmark"), "item_id").select(F.col("item_id").alias("q"), F.col("word").alias("term")).distinct()


ASKED_SQL = f"SELECT DISTINCT item_id AS q, word AS term FROM ({tokens_sql('benchmark', 'item_id')})"
BM25_SQL = "SELECT q, doc, round(sum(idf * boost * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len / avg_len))), 9) AS score FROM tf JOIN asked USING (term) JOIN stats USING (term) JOIN lengths USING (doc), totals GROUP BY q, doc"
TOP_SQL = "SELECT q, doc, score, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) AS INTEGER) AS rank FROM scored QUALIFY rank <= 40"


def top_sql(boost: str) -> str:
    return f"WITH {INDEX_SQL}, asked AS (SELECT q, term, {boost} AS boost FROM ({ASKED_SQL})), scored AS ({BM25_SQL}), top AS ({TOP_SQL})"


@query("q_bm25_top40", f"{top_sql('1.0')} SELECT q, doc, round(score, 4) AS score, rank FROM top")
def q_bm25_top40(spark, sf_dir):
    index = Postings.build(documents(spark, sf_dir)).kept()
    return bm25(asked_items(spark, sf_dir), index).select("q", "doc", F.round("score", 4).alias("score"), "rank")


@query("q_bm25_boosted", f"{top_sql('CASE WHEN length(term) >= 4 THEN 1.0 ELSE 0.9 END')} SELECT q, doc, round(score, 4) AS score, rank FROM top")
def q_bm25_boosted(spark, sf_dir):
    index = Postings.build(documents(spark, sf_dir)).kept()
    asked = asked_items(spark, sf_dir).withColumn("boost", F.when(F.length("term") >= 4, 1.0).otherwise(0.9))
    return bm25(asked, index).select("q", "doc", F.round("score", 4).alias("score"), "rank")


@query(
    "q_coverage",
    f"""{top_sql('1.0')}, weights AS (SELECT q, term, coalesce(idf, max_idf) AS weight FROM asked LEFT JOIN stats USING (term), totals),
    total AS (SELECT q, sum(weight) AS total FROM weights GROUP BY q)
    SELECT q, doc, round(sum(CASE WHEN tf.doc IS NOT NULL THEN weight ELSE 0 END) / any_value(total), 4) AS coverage
    FROM (SELECT q, doc FROM top) p JOIN weights USING (q) JOIN total USING (q) LEFT JOIN tf ON tf.doc = p.doc AND tf.term = weights.term GROUP BY q, p.doc""".replace("SELECT q, doc, round(sum(CASE", "SELECT q, p.doc AS doc, round(sum(CASE"),
)
def q_coverage(spark, sf_dir):
    index = Postings.build(documents(spark, sf_dir)).kept()
    asked = search.prepared(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q"), "text"), search.Collection(index), False)
    pairs = bm25(asked_items(spark, sf_dir), index)
    return search.coverage(asked, pairs, index).select("q", "doc", F.round("coverage", 4).alias("coverage"))


@query("q_search_benchmark")
def q_search_benchmark(spark, sf_dir):
    """Status and best documents of each benchmark passage, by wording and coverage."""
    index = Postings.build(documents(spark, sf_dir)).kept()
    found = search.search(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q"), "text"), search.Collection(index))
    return found.select("q", "status", F.transform("matches", lambda m: m["doc"]).alias("docs"), F.get("matches", F.lit(0))["score"].alias("score"), F.get("matches", F.lit(0))["coverage"].alias("coverage"))


@query("q_search_status", "SELECT s AS score, c / 100.0 AS coverage, CASE WHEN s >= 88 AND c >= 85 THEN 'found' WHEN s >= 70 AND c >= 70 THEN 'similar' ELSE 'not_found' END AS status FROM range(60, 101) a(s), range(60, 101) b(c)")
def q_search_status(spark, sf_dir):
    both = spark.range(60, 101).select(F.col("id").alias("score")).join(F.broadcast(spark.range(60, 101).select((F.col("id") / 100.0).alias("coverage"))))
    return both.withColumn("status", search.status_of(F.col("score"), F.col("coverage")))


@query(
    "q_rerank_order",
    """WITH s AS (SELECT l_orderkey AS q, l_partkey AS doc, l_linenumber AS bm25_rank, CAST(60 + l_quantity % 41 AS INTEGER) AS score, round(0.5 + l_discount * 5, 2) AS coverage, l_returnflag = 'R' AS preferred, l_suppkey AS same0 FROM lineitem),
    r AS (SELECT *, row_number() OVER (PARTITION BY q, same0 ORDER BY coverage >= 0.7 DESC, round(score * coverage, 6) DESC, preferred DESC, bm25_rank, doc) AS once FROM s)
    SELECT q, CAST(row_number() OVER (PARTITION BY q ORDER BY coverage >= 0.7 DESC, round(score * coverage, 6) DESC, preferred DESC, bm25_rank, doc) AS INTEGER) AS place, doc, score, coverage FROM r WHERE once = 1 QUALIFY place <= 3""",
)
def q_rerank_order(spark, sf_dir):
    """The order of re-ranked candidates, one for each source, the best three; order lines stand for candidates."""
    s = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("q"), F.col("l_partkey").alias("doc"), F.col("l_linenumber").alias("bm25_rank"), (60 + F.col("l_quantity") % 41).cast("int").alias("score"), F.round(0.5 + F.col("l_discount") * 5, 2).alias("coverage"), (F.col("l_returnflag") == "R").alias("preferred"), F.col("l_suppkey").alias("same0"))
    return search.best_of(s, ["same0"], 3)


@query("q_allowed_miss", "SELECT n_nationkey AS k, round(CASE WHEN 3 + n_regionkey >= 4 AND n_nationkey % 3 = 1 AND mw <= 0.35 * 10 AND credit / (10 - mw) >= 0.9 THEN greatest(credit / 10, credit / (10 - mw) * 0.9) ELSE credit / 10 END, 6) AS coverage FROM (SELECT *, n_nationkey % 5 * 1.0 AS mw, 10 - n_nationkey % 5 * 1.0 AS credit FROM nation)")
def q_allowed_miss(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumn("mw", F.col("n_nationkey") % 5 * 1.0)
    covered = search.allowed_miss(10 - F.col("mw"), F.lit(10.0), 3 + F.col("n_regionkey"), F.col("n_nationkey") % 3, F.col("mw"))
    return n.select(F.col("n_nationkey").alias("k"), F.round(covered, 6).alias("coverage"))


# Locating ------------------------------------------------------------------------------------------------------------


@query(
    "q_vote_candidates",
    f"""WITH sent AS MATERIALIZED (SELECT concat_ws('#', doc_id, no) AS piece, {words_sql('text')} AS q FROM ({SENTENCES_SQL})),
    lng AS (SELECT piece, q FROM sent WHERE len(q) >= 3),
    tok AS MATERIALIZED (SELECT piece, CAST(unnest(range(len(q))) AS INTEGER) AS i, unnest(q) AS word FROM lng),
    two AS (SELECT piece, i, word AS w1, lead(word) OVER (PARTITION BY piece ORDER BY i) AS w2 FROM tok QUALIFY w2 IS NOT NULL),
    ct AS MATERIALIZED ({tokens_sql('benchmark', 'item_id')}), cp AS ({pairs_sql('benchmark', 'item_id')}),
    bp AS MATERIALIZED (SELECT piece, CAST(item_id AS VARCHAR) AS axis, pos - i AS start, 2 * count(*) AS votes, min(i) AS f FROM two JOIN cp USING (w1, w2) GROUP BY ALL),
    rare AS (SELECT item_id, pos, word FROM ct WHERE word IN (SELECT word FROM ct GROUP BY word HAVING count(*) <= 50)),
    bw AS (SELECT piece, CAST(item_id AS VARCHAR) AS axis, pos - i AS start, count(*) AS votes, min(i) AS f FROM tok JOIN rare USING (word) WHERE piece NOT IN (SELECT piece FROM bp) GROUP BY ALL),
    whole AS (SELECT * FROM bp UNION ALL SELECT * FROM bw)
    SELECT piece, axis, CAST(start AS INTEGER) AS start, CAST(votes AS BIGINT) AS votes, CAST(row_number() OVER (PARTITION BY piece ORDER BY votes DESC, f, axis, start) AS INTEGER) AS rank FROM whole QUALIFY rank <= 8""",
)
def q_vote_candidates(spark, sf_dir):
    """Up to eight places for every sentence of every document, by shared word pairs, or rare words where none is shared."""
    corpus = benchmark_corpus(spark, sf_dir)
    asked = locate.query_words(document_pieces(spark, sf_dir), corpus).where(F.col("n") >= C.MIN_WORDS)
    return locate.candidate_starts(asked, corpus).select("piece", "axis", F.col("start").cast("int").alias("start"), "votes", "rank")


@query("q_verify_documents")
def q_verify_documents(spark, sf_dir):
    """Every sentence of every document checked against the passages: those that quote one, rightly or altered."""
    found = locate.check(document_pieces(spark, sf_dir), benchmark_corpus(spark, sf_dir))
    doc = F.split("piece", "#")
    return found.where(F.col("status").isin("verified", "altered")).select(F.get(doc, F.lit(0)).cast("long").alias("doc_id"), F.get(doc, F.lit(1)).cast("int").alias("no"), "status", "match_ratio", "longest_run", F.col("chapter").alias("item_id"), F.size("differences").alias("n_differences"))


@query("q_differences")
def q_differences(spark, sf_dir):
    found = locate.check(document_pieces(spark, sf_dir), benchmark_corpus(spark, sf_dir))
    return found.select("piece", "status", F.explode("differences").alias("d")).select("piece", "status", "d.*")


@query("q_self_check", f"SELECT CAST(item_id AS VARCHAR) AS piece, CASE WHEN len({words_sql('text')}) < 3 THEN 'too_short' ELSE 'verified' END AS status, CASE WHEN len({words_sql('text')}) < 3 THEN 0.0 ELSE 1.0 END AS match_ratio FROM benchmark")
def q_self_check(spark, sf_dir):
    """Each passage is found as itself."""
    pieces = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("piece"), "text")
    return locate.check(pieces, benchmark_corpus(spark, sf_dir)).select("piece", "status", "match_ratio")


_DRAW = "('0x' || substr(md5(concat_ws(':', item_id, '1', '{n}')), 1, 7))::BIGINT % {m}"


@query(
    "q_tampered",
    f"""WITH w AS (SELECT item_id, {words_sql('text')} AS w FROM benchmark), d AS (SELECT item_id, len(w) AS n, {_DRAW.format(n=2, m=3)} AS op FROM w WHERE len(w) >= 3),
    s AS (SELECT *, n - CASE WHEN op = 1 THEN 1 ELSE 0 END + CASE WHEN op = 2 THEN 1 ELSE 0 END AS size, CASE WHEN op = 2 THEN n ELSE n - 1 END AS matched FROM d)
    SELECT CAST(item_id AS VARCHAR) AS piece, ['replace', 'delete', 'insert'][op + 1] AS op, CASE WHEN size < 3 THEN 'too_short' ELSE 'altered' END AS status, CASE WHEN size < 3 THEN 0.0 ELSE round_even(matched / size, 2) END AS match_ratio FROM s""",
)
def q_tampered(spark, sf_dir):
    """Each passage with one inner word replaced, left out or added, and what the check says."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", words(normalize(F.col("text"), "latin")).alias("words"))
    altered = evaluate.tampered(rows, "item_id", F.col("words"), ["zzqx", "wwqx", "yyqx"])
    checked = locate.check(altered.select(F.col("item_id").cast("string").alias("piece"), F.array_join("altered", " ").alias("text")), benchmark_corpus(spark, sf_dir))
    return altered.select(F.col("item_id").cast("string").alias("piece"), "op").join(checked.select("piece", "status", "match_ratio"), "piece")


@query("q_contained_passages", f"SELECT d.doc_id, b.item_id FROM (SELECT doc_id, {norm_sql('text')} AS norm FROM documents) d JOIN (SELECT item_id, {norm_sql('text')} AS norm FROM benchmark) b ON contains(d.norm, b.norm)")
def q_contained_passages(spark, sf_dir):
    """Passages that stand in a document as they are. Inner words of a passage must be whole words of the document, so its
    second and third word find the documents. Of shorter passages the parts of words count that a document's words end or
    begin with: the middle one of three words is a whole one, the first of two ends a word, a single one is in a word."""
    b = table(spark, sf_dir, "benchmark").select("item_id", normalize(F.col("text"), "latin").alias("norm")).withColumn("words", words(F.col("norm")))
    d = documents(spark, sf_dir).select("doc_id", normalize(F.col("text"), "latin").alias("hay")).withColumn("words", words(F.col("hay")))
    inner = b.where(F.size("words") > 3).select("item_id", "norm", F.get("words", F.lit(1)).alias("w1"), F.get("words", F.lit(2)).alias("w2"))
    pairs = adjacent(d, "doc_id").select("doc_id", "w1", "w2").distinct()
    long_ = pairs.join(inner, ["w1", "w2"]).select("doc_id", "item_id", "norm").join(d.select("doc_id", "hay"), "doc_id").where(F.contains("hay", F.col("norm"))).select("doc_id", "item_id")
    short = b.where(F.size("words") <= 3).select("item_id", "norm", "words")
    vocab = d.select(F.explode(F.array_distinct("words")).alias("word"))
    met = vocab.distinct().join(F.broadcast(short), F.when(F.size("words") == 3, F.col("word") == F.get("words", F.lit(1))).when(F.size("words") == 2, F.endswith("word", F.get("words", F.lit(0)))).otherwise(F.contains("word", F.col("norm")))).select("word", "item_id", "norm") if short.limit(1).count() else None
    if met is None:
        return long_
    holding = d.select("doc_id", F.explode(F.array_distinct("words")).alias("word")).join(met, "word").select("doc_id", "item_id", "norm").distinct()
    return long_.unionByName(holding.join(d.select("doc_id", "hay"), "doc_id").where(F.contains("hay", F.col("norm"))).select("doc_id", "item_id"))


CHAIN_SQL = f"""sp AS MATERIALIZED (SELECT DISTINCT w1, w2 FROM ({pairs_sql('benchmark', 'item_id')})), dp AS MATERIALIZED ({pairs_sql('documents', 'doc_id')}),
    hit AS (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM dp SEMI JOIN sp USING (w1, w2)),
    isl AS (SELECT doc_id, sum(size) AS pairs, max(size) AS longest FROM (SELECT doc_id, run, count(*) AS size FROM hit GROUP BY ALL) GROUP BY doc_id),
    rep AS (SELECT doc_id, sum(more) AS repeats FROM (SELECT doc_id, count(*) - 1 AS more FROM dp GROUP BY doc_id, w1, w2) GROUP BY doc_id)"""


@query("q_longest_run", f"WITH {CHAIN_SQL} SELECT doc_id, CAST(coalesce(pairs, 0) AS BIGINT) AS pairs, CAST(coalesce(longest, 0) AS BIGINT) AS longest, CAST(coalesce(repeats, 0) AS BIGINT) AS repeats FROM documents LEFT JOIN isl USING (doc_id) LEFT JOIN rep USING (doc_id)")
def q_longest_run(spark, sf_dir):
    """Word pairs of each document that the passages have, their longest chain, and repeated pairs."""
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("reading"), "text")
    pairs = q_bigram_index_rows(spark, sf_dir).select("w1", "w2").distinct()
    return readings.chains(docs, pairs, "latin").withColumnRenamed("reading", "doc_id")


def q_bigram_index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adjacent(table(spark, sf_dir, "benchmark").select("item_id", words(normalize(F.col("text"), "latin")).alias("words")), "item_id")


@query(
    "q_reading_score",
    f"""WITH lines AS (SELECT doc_id, CAST(unnest(range(len(s))) AS INTEGER) AS line_no, unnest(s) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
    voc AS MATERIALIZED (SELECT DISTINCT word FROM ({tokens_sql('benchmark', 'item_id')})),
    toks AS (SELECT doc_id, line_no, unnest(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS tok FROM lines),
    k AS (SELECT doc_id, line_no, regexp_matches(tok, '\\p{{L}}') AS letter, regexp_matches(tok, '[0-9\\[\\]<>|{{}}#*+=%$@]') AS debris, {norm_sql('tok')} AS w FROM toks),
    j AS (SELECT k.*, voc.word IS NOT NULL AS known FROM k LEFT JOIN voc ON voc.word = k.w),
    c AS (SELECT doc_id, sum(CASE WHEN letter AND length(w) >= 3 AND known THEN 1 ELSE 0 END) AS real,
      sum(CASE WHEN letter AND length(w) >= 3 AND known THEN 0 WHEN letter THEN CASE WHEN (length(w) >= 2 AND NOT known) OR debris OR length(w) = 1 THEN 1 ELSE 0 END WHEN debris THEN 1 ELSE 0 END) AS junk FROM j GROUP BY doc_id),
    {CHAIN_SQL}
    SELECT doc_id, CAST(coalesce(real, 0) AS BIGINT) AS real, CAST(coalesce(junk, 0) AS BIGINT) AS junk, CAST(coalesce(real, 0) + coalesce(pairs, 0) + coalesce(longest, 0) - 0.5 * coalesce(junk, 0) - 2 * coalesce(repeats, 0) AS DOUBLE) AS score
    FROM documents LEFT JOIN c USING (doc_id) LEFT JOIN isl USING (doc_id) LEFT JOIN rep USING (doc_id)""",
)
def q_reading_score(spark, sf_dir):
    """Documents as readings: real words and debris by line, order of words, and the score they come to."""
    docs = documents(spark, sf_dir)
    lines = docs.select(F.col("doc_id").alias("reading"), F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    counted = readings.line_counts(lines, vocabulary(tokens(table(spark, sf_dir, "benchmark"), "item_id").select("word")), "latin")
    sums = counted.groupBy("reading").agg(F.sum("real").alias("real"), F.sum("junk").alias("junk"))
    chain = readings.chains(docs.select(F.col("doc_id").alias("reading"), "text"), q_bigram_index_rows(spark, sf_dir).select("w1", "w2").distinct(), "latin")
    both = sums.join(chain, "reading")
    return both.select(F.col("reading").alias("doc_id"), "real", "junk", readings.reading_score(*map(F.col, ("real", "junk", "pairs", "longest", "repeats"))).cast("double").alias("score"))


@query(
    "q_best_reading",
    "SELECT o_custkey AS image, o_orderkey AS ordinal, o_totalprice AS score FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1",
)
def q_best_reading(spark, sf_dir):
    """The best-scored reading of each image, the first of equal ones; orders stand for readings of their customer."""
    return readings.best_reading(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("image"), F.col("o_orderkey").alias("ordinal"), F.col("o_totalprice").alias("score")))


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(q, text): every line of every turn; q is the conversation, the turn and the line."""
    lines = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return lines.select(F.concat_ws(":", "conv_id", "turn", "line").alias("q"), "text")


def fragment_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(q, word): the distinct words of each fragment."""
    return fragment_lists(spark, sf_dir).select("q", F.explode("ws").alias("word"))


def fragment_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fragments(spark, sf_dir).select("q", F.array_distinct(words(normalize(F.col("text"), "latin"))).alias("ws"))


#: DuckDB's levenshtein counts bytes, so letters of two bytes get signs of one that no word has otherwise.
_ONE_BYTE = "translate({}, 'éèñêíçóöüäßàâîôûëïùúáìòãõåæø', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ01')"
FRAGMENT_SQL = f"""lines AS (SELECT concat_ws(':', conv_id, turn, unnest(range(len(s)))) AS q, unnest(s) AS text FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS s FROM conversations)),
    asked AS MATERIALIZED (SELECT DISTINCT q, unnest({words_sql('text')}) AS word FROM lines),
    places AS MATERIALIZED (SELECT DISTINCT item_id, word AS v FROM ({tokens_sql('benchmark', 'item_id')})),
    known AS MATERIALIZED (SELECT DISTINCT v, {_ONE_BYTE.format('v')} AS b FROM places),
    near AS MATERIALIZED (SELECT a.word, p.v, CASE WHEN a.word = p.v THEN 1.0 ELSE 0.8 END AS score FROM (SELECT DISTINCT word, {_ONE_BYTE.format('word')} AS b, CASE WHEN length(word) < 3 THEN 0 WHEN length(word) <= 5 THEN 1 ELSE 2 END AS k FROM asked) a JOIN known p ON abs(length(a.word) - length(p.v)) <= k AND (a.word = p.v OR (k > 0 AND levenshtein(a.b, p.b) <= k))),
    best AS (SELECT q, word, item_id, max(score) AS score FROM asked JOIN near USING (word) JOIN places USING (v) GROUP BY ALL),
    summed AS MATERIALIZED (SELECT q, item_id, CAST(round(sum(score), 6) AS DOUBLE) AS quality FROM best GROUP BY ALL)"""


@query("q_near_words", f"WITH {FRAGMENT_SQL} SELECT word, v, CAST(score AS DOUBLE) AS score FROM near")
def q_near_words(spark, sf_dir):
    known = vocabulary(tokens(table(spark, sf_dir, "benchmark"), "item_id").select("word"))
    return locate.near_words(fragment_words(spark, sf_dir), known)


@query("q_fragment_quality", f"WITH {FRAGMENT_SQL} SELECT q, item_id, quality FROM summed QUALIFY quality >= max(quality) OVER (PARTITION BY q) - 0.5")
def q_fragment_quality(spark, sf_dir):
    located = tokens(table(spark, sf_dir, "benchmark"), "item_id").select("word", F.lit("").alias("axis"), F.col("item_id").alias("chapter"), F.lit(1).alias("verse"))
    return locate.fragment_quality(fragment_lists(spark, sf_dir), located).select("q", F.col("chapter").alias("item_id"), "quality")


@query("q_fragment_best", f"WITH {FRAGMENT_SQL}, n AS (SELECT q, count(*) AS words_asked FROM asked GROUP BY q) SELECT q, round_even(max(quality), 1) AS words_found, CAST(any_value(words_asked) AS INTEGER) AS words_asked FROM summed JOIN n USING (q) GROUP BY q")
def q_fragment_best(spark, sf_dir):
    """How many of a fragment's words its best passage has; which of equally good passages is first takes the fuzzy ratio."""
    found = locate.search_fragment(fragments(spark, sf_dir), benchmark_corpus(spark, sf_dir), top=1)
    return found.select("q", "words_found", "words_asked")


@query("q_search_fragment")
def q_search_fragment(spark, sf_dir):
    """The five passages nearest to each line of each turn; lines without a word have none."""
    lines = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    asked = lines.select(F.struct("conv_id", "turn", "line").alias("q"), "text")
    return locate.search_fragment(asked, benchmark_corpus(spark, sf_dir)).select("q.conv_id", "q.turn", "q.line", "rank", F.col("chapter").alias("item_id"), "words_found", "words_asked")


@query(
    "q_range_join_text",
    "SELECT CAST(conv_id AS VARCHAR) AS piece, string_agg(text || ' (' || turn || ')', ' ' ORDER BY turn) AS joined FROM conversations WHERE text IS NOT NULL GROUP BY conv_id",
)
def q_range_join_text(spark, sf_dir):
    """Passages from one number to another joined in order, each with its number; turns stand for verses."""
    rows = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    located = rows.groupBy("conv_id").agg(F.min("turn").cast("int").alias("verse_from"), F.max("turn").cast("int").alias("verse_to")).select(F.col("conv_id").cast("string").alias("piece"), F.col("conv_id").alias("chapter"), "verse_from", "verse_to")
    return locate.passage_range(located, rows.select(F.col("conv_id").alias("chapter"), F.col("turn").cast("int").alias("verse"), "text"))


# Vectors -------------------------------------------------------------------------------------------------------------

VECTOR_SQL = "v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)"


@query("q_cosine_topk", f"WITH {VECTOR_SQL}, s AS (SELECT a.vec_id AS word, b.vec_id AS other, list_cosine_similarity(a.e, b.e) AS sim FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0) SELECT word, other, round(sim, 6) AS sim, CAST(row_number() OVER (PARTITION BY word ORDER BY round(sim, 9) DESC, other) AS INTEGER) AS rank FROM s QUALIFY rank <= 8")
def q_cosine_topk(spark, sf_dir):
    """The eight nearest vectors of each whose id is divisible by 100, against all."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("word"), F.col("embedding").alias("vec"))
    return vectors.neighbours(v.where(F.col("word") % 100 == 0), v).select("word", "other", F.round("sim", 6).alias("sim"), "rank")


@query("q_max_similarity", f"WITH {VECTOR_SQL} SELECT a.label AS q, a.vec_id AS word, round(max(list_cosine_similarity(a.e, b.e)), 6) AS sim FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 GROUP BY ALL")
def q_max_similarity(spark, sf_dir):
    """For each vector whose id is divisible by 100 the greatest similarity with the others of its label."""
    v = table(spark, sf_dir, "embeddings").select(F.col("label").alias("q"), "vec_id", F.col("embedding").alias("vec"))
    asked, among = v.where(F.col("vec_id") % 100 == 0).withColumnRenamed("vec_id", "word"), v.withColumnRenamed("vec_id", "other")
    return vectors.greatest_similarity(asked, among, itself=False).select("q", "word", F.round("sim", 6).alias("sim"))


@query("q_unit_vectors", "WITH u AS (SELECT vec_id AS word, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / greatest(sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE)))), 1e-9)) AS vec FROM embeddings) SELECT word, CAST(unnest(range(len(vec))) AS INTEGER) AS pos, round(unnest(vec), 6) AS x FROM u")
def q_unit_vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("word"), F.posexplode(vectors.unit(F.col("embedding"))).alias("pos", "x")).select("word", "pos", F.round("x", 6).alias("x"))


_FORMS = "CASE WHEN starts_with(w, 'ال') THEN [w, 'و' || w, 'ف' || w, 'ب' || w, 'وب' || w, 'ك' || w, 'لل' || substr(w, 3), 'ولل' || substr(w, 3)] ELSE [w, 'و' || w, 'ف' || w, 'ب' || w, 'ل' || w] END"


@query("q_expand_terms", f"WITH n AS (SELECT n_regionkey AS q, CASE WHEN n_nationkey % 2 = 0 THEN 'ال' ELSE '' END || lower(n_name) AS w FROM nation), f AS (SELECT q, w, unnest({_FORMS}) AS term FROM n) SELECT q, term, CAST(max(CASE WHEN term = w THEN 1.0 ELSE 0.9 END) AS DOUBLE) AS boost FROM f GROUP BY ALL")
def q_expand_terms(spark, sf_dir):
    """Forms with particles and the greatest boost of each."""
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("q"), F.concat(F.when(F.col("n_nationkey") % 2 == 0, "ال").otherwise(""), F.lower("n_name")).alias("w"))
    return n.withColumn("term", F.explode(with_particles(F.col("w")))).groupBy("q", "term").agg(F.max(F.when(F.col("term") == F.col("w"), 1.0).otherwise(0.9)).alias("boost"))


@query("q_bare_words", "WITH n AS (SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'وال' WHEN 1 THEN 'بال' WHEN 2 THEN 'ف' ELSE 'لل' END || lower(n_name) AS w FROM nation), a AS (SELECT *, CASE WHEN length(w) > 3 AND substr(w, 1, 1) IN ('و', 'ف') THEN substr(w, 2) ELSE w END AS x FROM n), b AS (SELECT *, CASE WHEN length(x) > 4 AND substr(x, 1, 1) IN ('ب', 'ل', 'ك') AND substr(x, 2, 2) = 'ال' THEN substr(x, 2) ELSE x END AS y FROM a) SELECT n_nationkey, w, CASE WHEN length(y) > 4 AND substr(y, 1, 2) IN ('ال', 'لل') THEN substr(y, 3) ELSE y END AS bare FROM b")
def q_bare_words(spark, sf_dir):
    k = F.col("n_nationkey") % 4
    w = F.concat(F.when(k == 0, "وال").when(k == 1, "بال").when(k == 2, "ف").otherwise("لل"), F.lower("n_name"))
    return table(spark, sf_dir, "nation").select("n_nationkey", w.alias("w"), bare(w).alias("bare"))


# Gradings and verdicts -----------------------------------------------------------------------------------------------

_GRADE = "CASE WHEN toxic = 1 AND quality = 0 THEN 'Very Daif' WHEN toxic = 1 THEN 'Sahih Isnaad Mursal' WHEN quality = 1 THEN 'Hasan Sahih' ELSE 'Isnaad Malool' END"


@query("q_grade_rating", f"SELECT doc_id, grade, CASE WHEN grade IN ('Very Daif', 'Isnaad Malool') THEN 'bad' WHEN grade = 'Sahih Isnaad Mursal' THEN 'warn' ELSE 'ok' END AS rating FROM (SELECT doc_id, {_GRADE} AS grade FROM labels)")
def q_grade_rating(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", F.expr(_GRADE).alias("grade")).withColumn("rating", verdict.grade_rating(F.col("grade")))


_EXTERNAL = "CASE WHEN toxic = 1 THEN 'ليس بصحيح' WHEN quality = 1 THEN 'إسناده حسن' WHEN doc_id % 2 = 0 THEN 'لا أصل له' ELSE 'غريب' END"


@query("q_denial_rating", f"SELECT doc_id, CASE WHEN toxic = 1 THEN 'bad' WHEN quality = 1 THEN 'ok' WHEN doc_id % 2 = 0 THEN 'bad' ELSE 'warn' END AS rating FROM labels")
def q_denial_rating(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", verdict.external_rating(F.expr(_EXTERNAL)).alias("rating"))


@query(
    "q_external_verdict",
    """WITH r AS (SELECT source, lang, list_distinct(list(CASE WHEN toxic = 1 THEN 'bad' WHEN quality = 1 THEN 'ok' ELSE 'warn' END)) AS k FROM documents JOIN labels USING (doc_id) GROUP BY ALL)
    SELECT source, lang, CASE WHEN len(k) = 1 AND list_contains(k, 'ok') THEN 'ok' WHEN NOT list_contains(k, 'ok') AND list_contains(k, 'bad') THEN 'bad' ELSE 'warn' END AS verdict, len(list_filter(k, lambda x: x <> 'warn')) > 1 AS differ FROM r""",
)
def q_external_verdict(spark, sf_dir):
    rating = F.when(F.col("toxic") == 1, "bad").when(F.col("quality") == 1, "ok").otherwise("warn")
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("source", "lang").agg(F.collect_set(rating).alias("k"))
    return rows.select("source", "lang", verdict.external_verdict(F.col("k")).alias("verdict"), verdict.scholars_differ(F.col("k")).alias("differ"))


_CASES = "(VALUES ('quran'), ('hadith'), ('text')) a(kind), (VALUES (''), ('hadith_as_quran'), ('quran_as_hadith')) b(mis), (VALUES ('verified'), ('altered'), ('not_found')) c(qs), (VALUES (true), (false)) d(image), (VALUES (true), (false)) e(slip), (VALUES ('found'), ('similar'), ('not_found')) f(hs), (VALUES ('ok'), ('warn'), ('bad')) g(rating), (VALUES (true), (false)) h(doubt)"


@query(
    "q_verdict_table",
    f"""SELECT kind, mis, qs, image, slip, hs, rating, doubt, CASE WHEN mis = 'hadith_as_quran' THEN 'bad' WHEN mis = 'quran_as_hadith' THEN 'warn'
    WHEN kind = 'quran' THEN CASE WHEN qs = 'verified' THEN 'ok' WHEN qs = 'not_found' THEN CASE WHEN image THEN 'warn' ELSE 'bad' END WHEN slip THEN 'warn' ELSE 'bad' END
    WHEN kind = 'hadith' THEN CASE WHEN hs = 'found' THEN rating WHEN doubt THEN 'warn' WHEN hs = 'similar' THEN CASE WHEN rating = 'bad' THEN 'bad' ELSE 'warn' END ELSE 'bad' END
    ELSE 'neutral' END AS verdict FROM {_CASES}""",
)
def q_verdict_table(spark, sf_dir):
    """The verdict of every combination of evidence."""
    cases = spark.sql(f"SELECT * FROM {_CASES}")
    none = F.lit(None).cast("array<string>")
    return cases.withColumn("verdict", verdict.verdict(*map(F.col, ("kind", "mis", "qs", "image", "slip", "hs", "rating", "doubt")), none))


@query("q_router", "SELECT m AS marked, a AS as_quran, qs, hs, CASE WHEN qs = 'verified' AND m AND NOT a THEN 'quran_as_hadith' WHEN qs <> 'verified' AND a AND NOT m AND hs IN ('found', 'similar') THEN 'hadith_as_quran' ELSE '' END AS misattributed FROM (VALUES (true), (false)) x(m), (VALUES (true), (false)) y(a), (VALUES ('verified'), ('altered'), ('not_found')) z(qs), (VALUES ('found'), ('similar'), ('not_found')) w(hs)")
def q_router(spark, sf_dir):
    rows = spark.sql("SELECT m AS marked, a AS as_quran, qs, hs FROM (VALUES (true), (false)) x(m), (VALUES (true), (false)) y(a), (VALUES ('verified'), ('altered'), ('not_found')) z(qs), (VALUES ('found'), ('similar'), ('not_found')) w(hs)")
    quote = F.col("qs") == "verified"
    return rows.withColumn("misattributed", verdict.misattribution(quote, ~quote, F.col("marked"), F.col("as_quran"), F.col("qs"), F.col("hs"), F.lit(False)))


_LABELS = " ".join(f"WHEN kind = '{k}' AND v = '{v}' THEN '{label}'" for (k, v), label in C.CARD_LABELS.items())


@query("q_card_label", f"SELECT kind, v, mis, qs, CASE WHEN mis = 'hadith_as_quran' THEN '{C.LABEL_SAYING_AS_VERSE}' WHEN mis = 'quran_as_hadith' THEN '{C.LABEL_VERSE_AS_SAYING}' WHEN kind = 'quran' AND qs = 'not_found' THEN CASE WHEN v = 'bad' THEN '{C.LABEL_NO_VERSE}' ELSE '{C.LABEL_CHECK_READING}' END {_LABELS} END AS label FROM (VALUES ('quran'), ('hadith')) a(kind), (VALUES ('ok'), ('warn'), ('bad')) b(v), (VALUES (''), ('hadith_as_quran'), ('quran_as_hadith')) c(mis), (VALUES ('verified'), ('altered'), ('not_found')) d(qs)")
def q_card_label(spark, sf_dir):
    rows = spark.sql("SELECT * FROM (VALUES ('quran'), ('hadith')) a(kind), (VALUES ('ok'), ('warn'), ('bad')) b(v), (VALUES (''), ('hadith_as_quran'), ('quran_as_hadith')) c(mis), (VALUES ('verified'), ('altered'), ('not_found')) d(qs)")
    return rows.withColumn("label", verdict.card_label(F.col("kind"), F.col("v"), F.col("mis"), F.col("qs")))


@query("q_escaped_cards", "SELECT page_id, replace(replace(replace(replace(replace(substr(html, 1, 400), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS shown FROM pages")
def q_escaped_cards(spark, sf_dir):
    """What a card shows of a text: its first 400 characters (the card's own limit), escaped."""
    return table(spark, sf_dir, "pages").select("page_id", verdict.escape_html(F.substring("html", 1, 400)).alias("shown"))


@query("q_html_cards", f"SELECT item_id, CAST(0 AS INTEGER) AS entry_no, {norm_sql('text')} AS text, 'narrator ' || item_id AS narrator, '' AS scholar, 'book ' || item_id AS source, '' AS number, 'grade ' || item_id % 3 AS grade FROM benchmark")
def q_html_cards(spark, sf_dir):
    """Entries read back from fragments that hold a passage and its labelled fields."""
    label = lambda name, value: F.concat(F.lit(f'<span class="info-subtitle">{name}:</span> '), value)
    page = F.concat(F.lit('<div class="hadith" style="x">7 - '), normalize(F.col("text"), "latin"), F.lit('</div>\n<div class="hadith-info">'), label("الراوي", F.concat(F.lit("narrator "), "item_id")), F.lit(" | "), label("المصدر", F.concat(F.lit("<b>book</b> "), "item_id")), F.lit(" | "), label("خلاصة حكم المحدث", F.concat(F.lit("<span>grade "), F.col("item_id") % 3, F.lit("</span>"))), F.lit("</div>"))
    return cards.cards(table(spark, sf_dir, "benchmark").select("item_id", page.alias("html")), "item_id")


# Order, sets and evaluation ------------------------------------------------------------------------------------------


@query("q_conversation_carry", "SELECT conv_id, turn, role = 'user' AS flag, coalesce(lag(role = 'user') OVER (PARTITION BY conv_id ORDER BY turn), false) AS carried FROM conversations")
def q_conversation_carry(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("role") == "user").alias("flag"))
    return segment.carry_once(rows, "conv_id", F.col("turn"), F.col("flag"))


@query("q_sentences", SENTENCES_SQL)
def q_sentences(spark, sf_dir):
    return segment.sentences(documents(spark, sf_dir), "doc_id")


@query("q_dedupe_content", "SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY ALL")
def q_dedupe_content(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first"))


@query("q_distinct_contents", "SELECT count(DISTINCT sha256(text)) AS contents FROM documents")
def q_distinct_contents(spark, sf_dir):
    return files.distinct_contents(table(spark, sf_dir, "documents").where("text IS NOT NULL").select("text"), "text").agg(F.count("*").alias("contents"))


@query("q_set_operations", f"WITH d AS (SELECT DISTINCT word FROM ({tokens_sql('documents', 'doc_id')})), b AS (SELECT DISTINCT word FROM ({tokens_sql('benchmark', 'item_id')})) SELECT (SELECT count(*) FROM (SELECT * FROM d UNION SELECT * FROM b)) AS both_, (SELECT count(*) FROM (SELECT * FROM d EXCEPT SELECT * FROM b)) AS only_documents, (SELECT count(*) FROM (SELECT * FROM d INTERSECT SELECT * FROM b)) AS common")
def q_set_operations(spark, sf_dir):
    d = vocabulary(tokens(documents(spark, sf_dir), "doc_id").select("word")).withColumn("d", F.lit(1))
    b = vocabulary(tokens(table(spark, sf_dir, "benchmark"), "item_id").select("word")).withColumn("b", F.lit(1))
    return d.join(b, "word", "full").agg(F.count("*").alias("both_"), F.count_if(F.col("b").isNull()).alias("only_documents"), F.count_if(F.col("b").isNotNull() & F.col("d").isNotNull()).alias("common"))


_OUTCOME = "CASE WHEN got IS NULL THEN 'missed' WHEN got = expected THEN 'correct' WHEN expected IN ('bad', 'warn') AND got = 'ok' THEN 'error_called_correct' WHEN expected = 'ok' AND got = 'bad' THEN 'false_alarm' ELSE 'softer' END"
_JUDGED = "SELECT doc_id, lang, source, CASE WHEN toxic = 1 THEN 'bad' WHEN quality = 1 THEN 'ok' ELSE 'warn' END AS expected, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN n_chars % 3 = 0 THEN 'bad' WHEN n_chars % 3 = 1 THEN 'ok' ELSE 'warn' END AS got FROM documents JOIN labels USING (doc_id)"


def judged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    expected = F.when(F.col("toxic") == 1, "bad").when(F.col("quality") == 1, "ok").otherwise("warn")
    got = F.when(F.col("doc_id") % 7 == 0, F.lit(None)).when(F.col("n_chars") % 3 == 0, "bad").when(F.col("n_chars") % 3 == 1, "ok").otherwise("warn")
    return rows.select("doc_id", "lang", "source", expected.alias("expected"), got.alias("got")).withColumn("outcome", evaluate.outcome(F.lit("hadith"), F.col("expected"), F.lit("hadith"), F.col("got")))


@query("q_eval_confusion", f"WITH o AS (SELECT lang, source, {_OUTCOME} AS outcome FROM ({_JUDGED})) SELECT lang, source, outcome, count(*) AS n FROM o GROUP BY GROUPING SETS ((lang, outcome), (source, outcome), (outcome))")
def q_eval_confusion(spark, sf_dir):
    return evaluate.confusion(judged_documents(spark, sf_dir), ["lang", "source"])


@query("q_cautious_outcome", f"WITH o AS (SELECT doc_id, {_OUTCOME} AS outcome FROM ({_JUDGED})) SELECT doc_id, CASE WHEN outcome IN ('error_called_correct', 'false_alarm') THEN 'WRONG' WHEN outcome = 'softer' THEN 'cautious' ELSE outcome END AS outcome FROM o")
def q_cautious_outcome(spark, sf_dir):
    return judged_documents(spark, sf_dir).select("doc_id", evaluate.cautious_outcome(F.col("outcome")).alias("outcome"))


@query("q_accuracy", f"WITH o AS (SELECT source, {_OUTCOME} AS outcome FROM ({_JUDGED})) SELECT source, CAST(sum(CASE WHEN outcome = 'correct' THEN 1 ELSE 0 END) AS BIGINT) AS n_ok, count(*) AS n, round(avg(CASE WHEN outcome = 'correct' THEN 1 ELSE 0 END), 6) AS accuracy FROM o GROUP BY source")
def q_accuracy(spark, sf_dir):
    return evaluate.accuracy(judged_documents(spark, sf_dir), "source", F.col("outcome") == "correct").withColumn("accuracy", F.round("accuracy", 6))


@query("q_verdict_counts", f"SELECT source, CAST(sum(CASE WHEN got = 'ok' THEN 1 ELSE 0 END) AS BIGINT) AS ok, CAST(sum(CASE WHEN got = 'warn' THEN 1 ELSE 0 END) AS BIGINT) AS warn, CAST(sum(CASE WHEN got = 'bad' THEN 1 ELSE 0 END) AS BIGINT) AS bad FROM ({_JUDGED}) GROUP BY source")
def q_verdict_counts(spark, sf_dir):
    from quoteverify.plans.analyze import verdict_counts

    rows = judged_documents(spark, sf_dir).select(F.col("source").alias("post"), F.lit("hadith").alias("kind"), F.col("got").alias("verdict"))
    return verdict_counts(rows).withColumnRenamed("post", "source")


@query("q_image_outcome", "SELECT o_custkey AS image, CASE WHEN len(v) = 0 THEN 'missed' WHEN len(v) <> len(e) THEN CASE WHEN len(list_filter(e, lambda x: (x = 'ok' AND list_contains(v, 'bad')) OR (x = 'bad' AND list_contains(v, 'ok')))) > 0 THEN 'wrong' ELSE 'cautious' END WHEN v = e THEN 'correct' WHEN len(list_filter(range(1, len(e) + 1), lambda i: v[i] <> e[i] AND v[i] <> 'warn')) = 0 THEN 'cautious' ELSE 'wrong' END AS outcome FROM (SELECT o_custkey, list_sort(list(CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'bad' ELSE 'warn' END)) AS e, list_sort(coalesce(list(CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'ok' WHEN '2' THEN 'bad' ELSE 'warn' END) FILTER (substr(o_orderpriority, 1, 1) <> '5'), [])) AS v FROM orders GROUP BY o_custkey)")
def q_image_outcome(spark, sf_dir):
    """Outcome of an image's verdicts against the expected ones; a customer's orders stand for an image's texts."""
    first = F.substring("o_orderpriority", 1, 1)
    expected = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "bad").otherwise("warn")
    got = F.when(first == "5", F.lit(None)).when(first == "1", "ok").when(first == "2", "bad").otherwise("warn")
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("image")).agg(F.sort_array(F.collect_list(expected)).alias("e"), F.sort_array(F.collect_list(got)).alias("v"))
    return rows.select("image", evaluate.image_outcome(F.col("e"), F.col("v")).alias("outcome"))


_JUDGE = "SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'none' WHEN toxic = 1 THEN 'bad' ELSE 'ok' END AS expect, CASE WHEN doc_id % 2 = 0 THEN 'ayah_altered' ELSE 'hadith_weak' END AS category, doc_id % 3 AS n_checked, CASE WHEN doc_id % 5 < 2 THEN 'bad' ELSE 'ok' END AS verdict, doc_id % 7 < 4 AS right_place FROM labels"


@query("q_judged", f"SELECT doc_id, CASE WHEN expect = 'none' THEN n_checked = 0 WHEN n_checked = 0 THEN false ELSE verdict = expect AND (category NOT LIKE 'ayah%' OR right_place) END AS ok FROM ({_JUDGE})")
def q_judged(spark, sf_dir):
    """Whether reports meet labelled cases; labels stand for the cases."""
    rows = spark.sql(_JUDGE.replace("FROM labels", "FROM {labels}"), labels=table(spark, sf_dir, "labels"))
    return rows.select("doc_id", evaluate.judged(*map(F.col, ("expect", "category", "n_checked", "verdict", "right_place"))).alias("ok"))


@query("q_holds_words", f"SELECT doc_id, list_bool_and(list_transform(['the', 'and', 'of'], lambda k: contains(norm, k))) AS held FROM (SELECT doc_id, {norm_sql('text')} AS norm FROM documents)")
def q_holds_words(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", normalize(F.col("text"), "latin").alias("norm"), F.array(*map(F.lit, ("the", "and", "of"))).alias("keys"))
    return evaluate.holds_words(rows, "norm", "keys").select("doc_id", "held")


@query("q_unique_passages", f"SELECT item_id FROM (SELECT d.doc_id, b.item_id FROM (SELECT doc_id, {norm_sql('text')} AS norm FROM documents) d JOIN (SELECT item_id, {norm_sql('text')} AS norm FROM benchmark) b ON contains(d.norm, b.norm)) GROUP BY item_id HAVING count(*) = 1")
def q_unique_passages(spark, sf_dir):
    """Passages that exactly one document contains."""
    return q_contained_passages(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n")).where("n = 1").select("item_id")


@query("q_medians", "SELECT lang, CAST(median(n_chars) AS DOUBLE) AS median, list_sort(list(n_chars))[len(list(n_chars)) // 2 + 1] AS upper FROM documents GROUP BY lang")
def q_medians(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.median("n_chars").alias("median"), evaluate.upper_median("n_chars").cast("long").alias("upper"))


@query("q_sampled_cases", "SELECT doc_id, lang FROM documents ORDER BY md5(concat_ws(':', doc_id, '2026')), doc_id LIMIT 100")
def q_sampled_cases(spark, sf_dir):
    """One hundred documents in an order drawn by a seed (a sampling operator)."""
    return evaluate.sampled(table(spark, sf_dir, "documents"), "doc_id", 100, 2026).select("doc_id", "lang")


# Streams -------------------------------------------------------------------------------------------------------------


def run_to_table(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    return verify.to_table(stream, f"{work_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}", mode)


@query("q_stream_hourly", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:00') AS hour, event_type AS verdict, count(*) AS n FROM events GROUP BY ALL")
def q_stream_hourly(spark, sf_dir):
    """Counts by hour and kind from a stream, the same as in batch."""
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    events = verify.read_posts(spark, f"{sf_dir}/events.parquet*", schema)
    counts = run_to_table(spark, verify.counts_by_hour(events.withColumnRenamed("event_type", "verdict"), "ts"), "complete")
    return counts.withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH:mm"))


@query("q_stream_carry", "SELECT conv_id, turn, role = 'user' AS flag, coalesce(lag(role = 'user') OVER (PARTITION BY conv_id ORDER BY turn), false) AS carried FROM conversations")
def q_stream_carry(spark, sf_dir):
    """Flags carried from turn to turn by a stateful stream, the same as by a window in batch."""
    lines = verify.read_posts(spark, f"{sf_dir}/conversations.parquet*", "conv_id long, turn long, role string, text string")
    return run_to_table(spark, verify.carried_flags(lines.select("conv_id", "turn", (F.col("role") == "user").alias("flag"))), "append")


@query("q_stream_passages", f"WITH p AS (SELECT DISTINCT item_id, w1, w2 FROM ({pairs_sql('benchmark', 'item_id')})), s AS (SELECT doc_id, no, CAST(unnest(range(len(w))) AS INTEGER) AS i, unnest(w) AS word FROM (SELECT doc_id, no, {words_sql('text')} AS w FROM ({SENTENCES_SQL}))), t AS (SELECT doc_id, no, word AS w1, lead(word) OVER (PARTITION BY doc_id, no ORDER BY i) AS w2 FROM s QUALIFY w2 IS NOT NULL) SELECT doc_id, item_id AS passage, count(*) AS n FROM t JOIN p USING (w1, w2) GROUP BY ALL")
def q_stream_passages(spark, sf_dir):
    """Documents from a stream joined with static passages by word pairs."""
    posts = verify.read_posts(spark, f"{sf_dir}/documents.parquet*", "doc_id long, text string, lang string, source string, n_chars long")
    passages = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("passage"), "text")
    return run_to_table(spark, verify.contained_passages(posts, passages, "doc_id"), "append").groupBy("doc_id", "passage").agg(F.count("*").alias("n"))
