"""Whole posts end to end: pieces, routes, evidence and a verdict for each segment.

Each route handles only the rows it needs: the corpus those that may be verses, the collection what is left, the external
source what the collection lacks. Checks and searches run over distinct texts, so a text that goes round is looked at
once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoteverify.functions import constants as C
from quoteverify.functions.normalize import canonical_typing, mend_salutation, normalize, words
from quoteverify.operators import locate, search, segment, verdict
from quoteverify.operators.index import Corpus
from quoteverify.session import held
from quoteverify.sources.external import same_wording


@dataclass
class Engine:
    """What posts are checked against. ``names``: chapter, name; ``shown``: chapter, verse, text as it is shown. Results that
    more than one route reads are written as tables."""

    corpus: Corpus
    collection: search.Collection
    names: DataFrame | None = None
    shown: DataFrame | None = None


def _by_text(rows: DataFrame) -> DataFrame:
    return rows.select("text").distinct().withColumn("id", F.sha2("text", 256))


def checked(rows: DataFrame, corpus: Corpus) -> DataFrame:
    """(text, q: the check's result) of the distinct texts."""
    texts = _by_text(rows)
    result = locate.check(texts.select(F.col("id").alias("piece"), "text"), corpus)
    fields = [c for c in result.columns if c != "piece"]
    return texts.join(result.select(F.col("piece").alias("id"), F.struct(*fields).alias("q")), "id").select("text", "q")


def searched(rows: DataFrame, collection: search.Collection, ocr: bool) -> DataFrame:
    """(text, by_meaning, h: the search's result) of the distinct texts and ways of searching."""
    texts = rows.select("text", "by_meaning").distinct().withColumn("q", F.sha2(F.concat_ws(":", F.col("by_meaning").cast("string"), "text"), 256))
    result = search.search(texts, collection, ocr).select("q", F.struct("status", "matches").alias("h"))
    return texts.join(result, "q").select("text", "by_meaning", "h")


def analyze(posts: DataFrame, engine: Engine, from_image: bool = False, external: DataFrame | None = None) -> DataFrame:
    """Segments of posts (post, text and, for images, uncertain: array of words read unsurely): post, seg_no, kind, text, q, h,
    misattributed, nearest, ratings, verdict. ``external``: text, entries, reached."""
    uncertain = F.coalesce("uncertain", F.array().cast("array<string>")) if from_image and "uncertain" in posts.columns else F.array().cast("array<string>")
    typed = posts.select("post", canonical_typing(F.coalesce("text", F.lit(""))).alias("text"), uncertain.alias("uncertain"))
    if from_image:
        typed = typed.withColumn("text", mend_salutation(segment.mended_intro(F.col("text"))))
    pieces = held(segment.pieces_of(typed).join(typed.select("post", "uncertain"), "post").withColumn("n", F.size(words(normalize(F.col("text"))))))
    claims = pieces.where(~F.col("bare_intro"))
    intros = pieces.where("bare_intro").select("post", "seg_no", F.lit("text").alias("kind"), "text", "uncertain")

    # verses
    least = F.when(F.col("as_quran"), C.MIN_WORDS).otherwise(C.ROUTER_MIN_WORDS)
    located = held(claims.join(checked(claims.where(F.col("n") >= C.MIN_WORDS), engine.corpus), "text", "left"))
    ok, ratio = F.col("q.status") == "verified", F.col("q.match_ratio")
    enough = F.when(F.col("as_quran") & F.lit(from_image), C.IMAGE_RATIO).otherwise(C.ROUTER_RATIO)
    is_verse = (F.col("n") >= least) & F.col("q.status").isin("verified", "altered") & (ratio >= enough) & (F.col("as_quran") | ok | (ratio >= C.UNMARKED_RATIO) | (F.col("q.longest_run") >= C.UNMARKED_RUN))
    routed = located.withColumn("is_verse", F.coalesce(is_verse, F.lit(False)))
    rival = F.col("is_verse") & F.col("marked") & ~F.col("as_quran") & ~ok  # a saying may quote part of a verse
    to_search = routed.where(~F.col("is_verse") | rival).select("text", F.col("marked").alias("by_meaning"))
    found = held(routed.withColumn("by_meaning", F.col("marked")).join(searched(to_search, engine.collection, from_image), ["text", "by_meaning"], "left").drop("by_meaning"))
    verse = F.col("is_verse") & ~(rival & F.coalesce(F.col("h.status") == "found", F.lit(False)))

    # sayings, and what is presented as a verse but is none
    status = F.coalesce(F.col("h.status"), F.lit("not_found"))
    saying = ~verse & F.when(F.col("marked") | F.col("as_quran"), status.isin("found", "similar") | F.col("marked")).otherwise(status == "found")
    kind = F.when(verse, "quran").when(saying, "hadith").when(F.col("as_quran") & (F.col("n") >= C.MIN_WORDS), "quran_left").otherwise("text")
    kinds = found.withColumn("kind", kind)
    docs = engine.collection.index.docs
    rating = F.col("rating") if "rating" in docs.columns else F.lit("ok")
    best = docs.select(F.col("doc").cast("bigint").alias("doc"), F.col("text").alias("top_text"), rating.alias("top_rating"))
    kinds = kinds.withColumn("doc", F.get("h.matches", F.lit(0))["doc"]).join(best, "doc", "left")
    left = F.col("kind") == "quran_left"
    q_status = F.when(left & ~F.coalesce(F.col("q.status").isin("verified", "altered"), F.lit(False)), "not_found").otherwise(F.col("q.status"))
    kinds = kinds.withColumn("q_status", q_status).withColumn("misattributed", verdict.misattribution(F.col("kind") == "quran", F.col("kind") == "hadith", F.col("marked"), F.col("as_quran"), F.col("q.status"), status, verdict.says_god_speaks(F.col("top_text"))))
    kinds = held(kinds.withColumn("left", left).withColumn("kind", F.when(left, "quran").otherwise(F.col("kind"))))
    kinds = _with_nearest(_with_shown(kinds, engine), kinds.where("left"), engine)

    # external gradings of sayings that the collection lacks
    if external is not None:
        ratings = same_wording(external).groupBy("text").agg(F.sort_array(F.collect_list(verdict.external_rating(F.col("entry.grade")))).alias("ratings"))
        kinds = kinds.join(ratings, "text", "left")
    else:
        kinds = kinds.withColumn("ratings", F.lit(None).cast("array<string>"))
    image, slip, doubt = F.lit(from_image), F.lit(False), F.lit(False)
    kinds = held(kinds)
    if from_image:
        slip = F.coalesce(verdict.reading_slip(image, F.col("q.differences"), F.col("text"), F.col("correct_text"), F.col("uncertain")), slip)
        doubt = F.coalesce(verdict.reading_doubtful(image, F.col("text"), F.col("uncertain"), F.get("h.matches", F.lit(0))["score"], F.col("top_text")), doubt)
    decided = verdict.verdict(F.col("kind"), F.col("misattributed"), F.col("q_status"), image, slip, status, F.col("top_rating"), doubt, F.when(F.col("kind") == "hadith", F.col("ratings")))
    shown = kinds.select("post", "seg_no", "kind", "text", "q", "q_status", "h", "misattributed", "nearest", "correct_text", "ratings", decided.alias("verdict"))
    return shown.unionByName(intros.drop("uncertain").withColumn("verdict", F.lit("neutral")).withColumn("misattributed", F.lit("")), allowMissingColumns=True)


def _with_shown(rows: DataFrame, engine: Engine) -> DataFrame:
    """rows with the text of the located verses as it is shown."""
    if engine.shown is None:
        return rows.withColumn("correct_text", F.lit(None).cast("string"))
    places = rows.where("q.chapter IS NOT NULL").select(F.concat_ws(":", "q.chapter", "q.verse_from", "q.verse_to").alias("piece"), "q.chapter", "q.verse_from", "q.verse_to").distinct()
    texts = locate.passage_range(places, engine.shown, "{text} ﴿{n}﴾").select(F.col("piece").alias("__place"), F.col("joined").alias("correct_text"))
    return rows.withColumn("__at", F.concat_ws(":", "q.chapter", "q.verse_from", "q.verse_to")).join(texts, F.col("__at") == F.col("__place"), "left").drop("__at", "__place")


def _with_nearest(rows: DataFrame, left: DataFrame, engine: Engine) -> DataFrame:
    """rows with the passage that shares most words with a text wrongly presented as a verse."""
    open_ = left.where("q_status = 'not_found'").select("text").distinct()
    near = locate.search_fragment(open_.select(F.col("text").alias("q"), "text"), engine.corpus, top=1)
    layer = min(engine.corpus.layers)
    texts = engine.corpus.passages.where(F.col("layer") == layer).select("axis", "chapter", "verse", F.col("text").alias("passage"))
    kept = near.join(texts, ["axis", "chapter", "verse"]).where(verdict.shares_most_words(F.col("q"), F.col("passage"))).select(F.col("q").alias("__q"), F.struct("chapter", "verse", F.col("passage").alias("text")).alias("nearest"))
    return rows.join(held(kept), (F.col("text") == F.col("__q")) & (F.col("q_status") == "not_found"), "left").drop("__q")


def report(segments: DataFrame) -> DataFrame:
    """The checked segments as cards: heading, escaped texts cut to their lengths, the first match of what was found or the first
    two of what is similar, and the first three external entries."""
    cut = lambda c, n: F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)
    label: Column = verdict.card_label(F.col("kind"), F.col("verdict"), F.col("misattributed"), F.col("q_status"))
    shown = F.slice("h.matches", 1, F.when(F.col("h.status") == "similar", 2).otherwise(1))
    return segments.where("kind <> 'text'").select("post", "seg_no", "kind", "verdict", label.alias("label"), verdict.escape_html(cut(F.col("text"), 600)).alias("shown"), verdict.escape_html(cut(F.col("correct_text"), 600)).alias("correct"), F.when(F.col("kind") == "hadith", shown).alias("matches"), F.slice("ratings", 1, 3).alias("ratings"), verdict.escape_html(cut(F.col("nearest.text"), 250)).alias("nearest"))


def verdict_counts(segments: DataFrame) -> DataFrame:
    """(post, ok, warn, bad) over the checked segments."""
    return segments.where("kind <> 'text'").groupBy("post").agg(*(F.count_if(F.col("verdict") == v).alias(v) for v in ("ok", "warn", "bad")))
