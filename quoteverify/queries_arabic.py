"""Queries that need Arabic text, and round trips through the file formats; importing this module registers them.

The driver's tables hold invented Latin prose. ``arabic`` writes it in Arabic letters, one letter for each, with marks,
nunation, lone particles and letter variants as real text has them, so the Arabic rules meet whole tables. Posts are put
together from such text in all the ways in which posts present a quotation; how they must be read follows from how they
were made, which is what the SQL states. RE2, which DuckDB uses, has no lookaround: its patterns take the neighbours in
and give them back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quoteverify.functions import constants as C
from quoteverify.functions import normalize as N
from quoteverify.functions.fuzzy import close_words
from quoteverify.operators import evaluate, locate, readings, search, segment, verdict
from quoteverify.operators.index import Corpus, Postings, shown_words, vocabulary
from quoteverify.plans import analyze
from quoteverify.queries import _ONE_BYTE, documents, norm_sql, pairs_sql, table, tokens_sql, words_sql
from quoteverify.registry import query
from quoteverify.session import held, work_folder
from quoteverify.sources import external, files

FROM = "abcdefghijklmnopqrstuvwxyzéèñêíçóöüäß"
TO = "ابتثجحخدذرزسشصضطظعغفقكلمنهةأإىۃئءآٱیک"
#: Marks that go into the letters' text: what is looked for, and what stands there instead.
_MARKED = (("س", "سَّ"), ("ز", "زٰ"), ("ن ", "نࣰ ا "), ("غ ", "غࣰ "), ("ح ", "ح و "), ("دد", "دـد"))


def letters(text: Column) -> Column:
    """The words of a text in Arabic letters, and nothing else."""
    return F.translate(N.normalize(text, "latin"), FROM, TO)


def letters_sql(text: str) -> str:
    return f"translate({norm_sql(text)}, '{FROM}', '{TO}')"


def arabic(text: Column) -> Column:
    """A text in Arabic letters with marks; signs and lines stay."""
    out = F.translate(F.lower(text), FROM, TO)
    for this, that in _MARKED:
        out = F.replace(out, F.lit(this), F.lit(that))
    return out


def arabic_sql(text: str) -> str:
    out = f"translate(lower({text}), '{FROM}', '{TO}')"
    for this, that in _MARKED:
        out = f"replace({out}, '{this}', '{that}')"
    return out


_L = "ء-ي"
_MAP_FROM, _MAP_TO = "".join(C.LETTER_MAP), "".join(C.LETTER_MAP.values())


def glued_sql(text: str) -> str:
    return f"regexp_replace({text}, '(ࣰ)\\s+([اى])([^{_L}ٱ]|$)', '\\1\\2\\3', 'g')"


def plain_sql(text: str, uthmani: bool = False) -> str:
    """The Arabic normalisation."""
    out = glued_sql(text)
    if uthmani:
        out = f"regexp_replace(replace({out}, 'ٰ', 'ا'), 'ࣰ([^اى{_L}]|$)', 'ࣰا\\1', 'g')"
    out = f"translate(regexp_replace({out}, '[{C.DIACRITICS}]', '', 'g'), '{_MAP_FROM}', '{_MAP_TO}')"
    out = f"trim(regexp_replace(regexp_replace({out}, '[^{_L}\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
    return f"regexp_replace({out}, '(^| )و ([{_L}])', '\\1و\\2', 'g')"


def plain_words_sql(text: str) -> str:
    return f"list_filter(string_split({plain_sql(text)}, ' '), lambda w: w <> '')"


# Normalisation -------------------------------------------------------------------------------------------------------


@query("q_arabic_normalize", f"SELECT doc_id, {plain_sql(arabic_sql('text'))} AS norm FROM documents")
def q_arabic_normalize(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", N.normalize(arabic(F.col("text"))).alias("norm"))


@query("q_arabic_uthmani", f"SELECT doc_id, {plain_sql(arabic_sql('text'), True)} AS norm FROM documents")
def q_arabic_uthmani(spark, sf_dir):
    """The spelling in which a dagger alif stands for a written one, and an orphan nunation for an alif."""
    return documents(spark, sf_dir).select("doc_id", N.normalize(arabic(F.col("text")), uthmani=True).alias("norm"))


@query("q_arabic_words", f"SELECT doc_id, CAST(unnest(range(len(w))) AS INTEGER) AS pos, unnest(w) AS word FROM (SELECT doc_id, {plain_words_sql(arabic_sql('text'))} AS w FROM documents)")
def q_arabic_words(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.posexplode(N.words(N.normalize(arabic(F.col("text"))))).alias("pos", "word"))


@query("q_strip_marks", f"SELECT doc_id, regexp_replace({arabic_sql('text')}, '[{C.MARKS}]', '', 'g') AS bare FROM documents")
def q_strip_marks(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", N.strip_marks(arabic(F.col("text"))).alias("bare"))


_TOKENS = f"list_filter(string_split_regex({glued_sql(arabic_sql('text'))}, '\\s+'), lambda t: {plain_sql('t')} <> '')"


@query("q_glued_tokens", f"SELECT doc_id, CAST(unnest(range(len(t))) AS INTEGER) AS pos, unnest(t) AS token FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)")
def q_glued_tokens(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.posexplode(N.glued_tokens(arabic(F.col("text")))).alias("pos", "token"))


@query("q_shown_words", f"WITH t AS (SELECT doc_id, CAST(unnest(range(len(t))) AS INTEGER) AS k, unnest(t) AS display FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)), w AS (SELECT doc_id, k, display, CAST(unnest(range(len(w))) AS INTEGER) AS i, unnest(w) AS word FROM (SELECT *, {plain_words_sql('display')} AS w FROM t)) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k, i) - 1 AS INTEGER) AS pos, word, display FROM w")
def q_shown_words(spark, sf_dir):
    """Each word with the token as it is written."""
    return documents(spark, sf_dir).select("doc_id", F.posexplode(shown_words(arabic(F.coalesce("text", F.lit(""))), "arabic", False)).alias("pos", "w")).select("doc_id", "pos", "w.word", "w.display")


_ARABIC_VOCAB = f"SELECT DISTINCT unnest({plain_words_sql(letters_sql('text'))}) AS word FROM documents"


def arabic_vocabulary(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    rows = documents(spark, sf_dir) if name == "documents" else table(spark, sf_dir, name)
    return vocabulary(rows.select(F.explode(N.words(N.normalize(letters(F.col("text"))))).alias("word")))


@query("q_bare_forms", f"WITH n AS (SELECT word, CASE length(word) % 4 WHEN 0 THEN 'وال' WHEN 1 THEN 'بال' WHEN 2 THEN 'ف' ELSE 'لل' END || word AS w FROM ({_ARABIC_VOCAB})), a AS (SELECT *, CASE WHEN length(w) > 3 AND substr(w, 1, 1) IN ('و', 'ف') THEN substr(w, 2) ELSE w END AS x FROM n), b AS (SELECT *, CASE WHEN length(x) > 4 AND substr(x, 1, 1) IN ('ب', 'ل', 'ك') AND substr(x, 2, 2) = 'ال' THEN substr(x, 2) ELSE x END AS y FROM a) SELECT w, CASE WHEN length(y) > 4 AND substr(y, 1, 2) IN ('ال', 'لل') THEN substr(y, 3) ELSE y END AS bare FROM b")
def q_bare_forms(spark, sf_dir):
    """All words with particles, and what is left without them."""
    k = F.length("word") % 4
    w = F.concat(F.when(k == 0, "وال").when(k == 1, "بال").when(k == 2, "ف").otherwise("لل"), F.col("word"))
    return arabic_vocabulary(spark, sf_dir).select(w.alias("w"), N.bare(w).alias("bare"))


_FORMS = "CASE WHEN starts_with(w, 'ال') THEN [w, 'و' || w, 'ف' || w, 'ب' || w, 'وب' || w, 'ك' || w, 'لل' || substr(w, 3), 'ولل' || substr(w, 3)] ELSE [w, 'و' || w, 'ف' || w, 'ب' || w, 'ل' || w] END"


@query("q_particle_forms", f"SELECT w, unnest({_FORMS}) AS form FROM (SELECT CASE WHEN length(word) % 2 = 0 THEN 'ال' ELSE '' END || word AS w FROM ({_ARABIC_VOCAB}))")
def q_particle_forms(spark, sf_dir):
    return arabic_vocabulary(spark, sf_dir).select(F.concat(F.when(F.length("word") % 2 == 0, "ال").otherwise(""), "word").alias("w")).select("w", F.explode(N.with_particles(F.col("w"))).alias("form"))


# How posts are typed and read ----------------------------------------------------------------------------------------

#: Text of a turn in Arabic letters; what turns without words hold is too short for any claim.
_TURNS = f"SELECT conv_id, turn, {letters_sql('text')} AS x FROM conversations WHERE text IS NOT NULL"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.spread(table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", letters(F.col("text")).alias("x")))


@query("q_canonical_typing", f"SELECT conv_id, turn, 'قال النبي صلى الله عليه وسلم: «' || y || '» رواه مسلم' || chr(10) || 'وقال ﷺ: «' || y || '»' || chr(10) || 'عن الله' AS typed FROM (SELECT conv_id, turn, translate(x, 'یکۃ', 'يكة') AS y FROM ({_TURNS}))")
def q_canonical_typing(spark, sf_dir):
    """Stretched and Persian letters, a spelled-out salutation, a name with marks, and items that follow on one line."""
    post = F.concat(F.lit("قـال النبي صلي الله عليه و سلم: «"), "x", F.lit("» رواه مسلم وقال ﷺ: «"), "x", F.lit("» عن اللّٰه".replace("ٰ", "")))
    return turns(spark, sf_dir).select("conv_id", "turn", N.canonical_typing(post).alias("typed"))


@query("q_quoted_core", f"SELECT conv_id, turn, CASE WHEN length(x) > 15 THEN x || ' … ' || x ELSE 'حدثنا \"' || x || '\" ثم “ ' || x || ' ” رواه \"ا\"' END AS core FROM ({_TURNS})")
def q_quoted_core(spark, sf_dir):
    text = F.concat(F.lit('حدثنا "'), "x", F.lit('" ثم “ '), "x", F.lit(' ” رواه "ا"'))
    return turns(spark, sf_dir).select("conv_id", "turn", N.quoted_core(text).alias("core"))


@query("q_mended_intro", f"SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'قال الله تعالى: ' WHEN 1 THEN 'يقول تعالى: ' WHEN 2 THEN 'قال الله سبحانه: ' ELSE 'قال الله كتابه: ' END || x AS mended FROM ({_TURNS})")
def q_mended_intro(spark, sf_dir):
    """The word after "said" where a reading is one letter off; another word stays."""
    k = F.col("turn") % 4
    said = F.when(k == 0, "قال الله تقالى: ").when(k == 1, "يقول تحالى: ").when(k == 2, "قال الله سحانه: ").otherwise("قال الله كتابه: ")
    return turns(spark, sf_dir).select("conv_id", "turn", segment.mended_intro(F.concat(said, "x")).alias("mended"))


@query("q_mended_salutation", f"SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'قال رسول الله ﷺ: «' WHEN 1 THEN 'صلى الله عليه وسلم «' ELSE 'عن النبي قال «' END || x || '»' AS mended FROM ({_TURNS})")
def q_mended_salutation(spark, sf_dir):
    k = F.col("turn") % 3
    said = F.when(k == 0, "قال رسول الله كل: «").when(k == 1, "صلى الله عليه وسد «").otherwise("عن الني قال «")
    return turns(spark, sf_dir).select("conv_id", "turn", N.mend_salutation(F.concat(said, "x", F.lit("»"))).alias("mended"))


_X = "regexp_replace(x, '^[اى]\\s+', '')"
_CLAIMS = f"""t AS (SELECT *, (conv_id + turn) % 7 AS k, len(list_filter(string_split(x, ' '), lambda w: w <> '')) >= 2 AS enough, {_X} AS y FROM ({_TURNS})),
    p AS (SELECT conv_id, turn, 0 AS part, CASE WHEN k IN (5, 6) THEN '' ELSE y END AS text, k IN (1, 5) AS marked, k IN (0, 4, 6) AS as_quran FROM t WHERE k <> 3 AND (enough OR k NOT IN (0, 1, 4))
      UNION ALL SELECT conv_id, turn, 1, y, true, false FROM t WHERE k = 4 AND enough)"""


def claimed_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(post, text): a conversation as a post; each turn is a line that presents its words in one of seven ways."""
    k, x = (F.col("conv_id") + F.col("turn")) % 7, F.col("x")
    put = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    line = (
        F.when(k == 0, put("قال الله تعالى: ﴿", x, "﴾")).when(k == 1, put("قال رسول الله ﷺ: «", x, "»")).when(k == 2, x).when(k == 3, put("رواه البخاري ", x))
        .when(k == 4, put("قال تعالى: ﴿", x, "﴾ وقال ﷺ: «", x, "»")).when(k == 5, "قال رسول الله ﷺ:").otherwise("قال الله تعالى:")
    )
    enough = (F.size(N.words(x)) >= 2) | ~k.isin(0, 1, 4)
    lines = turns(spark, sf_dir).where(enough).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("lines"))
    return lines.select(F.col("conv_id").alias("post"), F.array_join(F.transform("lines", lambda s: s["line"]), "\n").alias("text"))


@query("q_post_pieces", f"WITH {_CLAIMS} SELECT conv_id AS post, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, part) - 1 AS INTEGER) AS no, text, marked, as_quran FROM p WHERE text <> '' OR marked OR as_quran")
def q_post_pieces(spark, sf_dir):
    """How posts present their parts: verses, sayings, plain lines, sources, two quotations on a line, introductions alone."""
    return claimed_posts(spark, sf_dir).select("post", F.posexplode(segment.pieces(F.col("text"))).alias("no", "p")).select("post", "no", "p.*")


@query(
    "q_carried_pieces",
    f"""WITH {_CLAIMS}, s AS (SELECT *, count(*) FILTER (text <> '') OVER (PARTITION BY conv_id ORDER BY turn, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS after FROM p WHERE text <> '' OR marked OR as_quran),
    w AS (SELECT *, bool_or(text = '' AND marked) OVER g AS saying, bool_or(text = '' AND as_quran) OVER g AS verse FROM s WINDOW g AS (PARTITION BY conv_id, after))
    SELECT conv_id AS post, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, part) - 1 AS INTEGER) AS seg_no, text, marked OR saying AS marked, as_quran OR verse AS as_quran, false AS bare_intro FROM w WHERE text <> ''""",
)
def q_carried_pieces(spark, sf_dir):
    """The pieces with what introductions on lines of their own say of the next one."""
    return segment.pieces_of(claimed_posts(spark, sf_dir))


# Whole posts ---------------------------------------------------------------------------------------------------------

_ITEMS = f"SELECT item_id, {letters_sql('text')} AS x, string_split({letters_sql('text')}, ' ') AS w FROM benchmark"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = letters(F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", x.alias("x"), N.words(x).alias("w"))


def engine_of(rows: DataFrame) -> analyze.Engine:
    """Even items as verses (an axis each), the others as sayings that gradings rate by their number."""
    verses = rows.where("item_id % 2 = 0").select(F.lit(0).alias("layer"), F.col("item_id").cast("int").alias("chapter"), F.lit(1).alias("verse"), F.col("x").alias("text"))
    rating = F.element_at(F.array(*map(F.lit, ("ok", "warn", "bad"))), (F.col("item_id") % 3 + 1).cast("int"))
    sayings = rows.where("item_id % 2 = 1").select(F.col("item_id").alias("doc_id"), F.col("x").alias("text"), rating.alias("rating"))
    collection = search.Collection.arabic(Postings.build(sayings, profile="arabic").kept())
    return analyze.Engine(Corpus.build(verses, axis=F.col("chapter")), collection, shown=verses)


_FOREIGN = "ظظظثث شششضضض ذذذخخخ زززطططط"
_POST_KIND = "item_id // 2 % 4"


@query(
    "q_analyzed_posts",
    f"""WITH i AS (SELECT item_id, item_id % 2 = 0 AS verse, {_POST_KIND} AS k FROM ({_ITEMS})),
    s AS (SELECT item_id, 0 AS seg_no, CASE WHEN k = 3 THEN CASE WHEN verse THEN 'quran' ELSE 'hadith' END WHEN verse OR k = 2 AND NOT verse THEN CASE WHEN verse THEN 'quran' ELSE 'hadith' END ELSE 'hadith' END AS kind,
      CASE WHEN verse THEN CASE k WHEN 0 THEN 'ok' WHEN 1 THEN 'bad' WHEN 2 THEN 'warn' ELSE 'bad' END ELSE CASE WHEN k = 2 THEN 'bad' WHEN k = 3 THEN 'bad' ELSE ['ok', 'warn', 'bad'][item_id % 3 + 1] END END AS verdict,
      CASE WHEN k = 2 THEN CASE WHEN verse THEN 'quran_as_hadith' ELSE 'hadith_as_quran' END ELSE '' END AS misattributed,
      CASE WHEN k = 3 AND verse THEN item_id END AS nearest FROM i)
    SELECT item_id AS post, CAST(seg_no AS INTEGER) AS seg_no, kind, verdict, misattributed, CAST(coalesce(nearest, -1) AS INTEGER) AS nearest FROM s
    UNION ALL SELECT item_id, 1, 'text', 'neutral', '', -1 FROM i""",
)
def q_analyzed_posts(spark, sf_dir):
    """Posts that quote a verse rightly, altered, as a saying or with its words turned round, and sayings rightly, in another
    presentation, as a verse or unknown: kinds, verdicts, wrong presentations and nearest passages."""
    rows = held(items(spark, sf_dir), "items")
    verse, k, x = F.col("item_id") % 2 == 0, F.floor(F.col("item_id") / 2) % 4, F.col("x")
    middle = F.floor(F.size("w") / 2).cast("int")
    altered = F.array_join(F.concat(F.slice("w", F.lit(1), middle), F.array(F.lit("ظظظظظظ")), F.slice("w", middle + 2, F.size("w"))), " ")
    turned = F.array_join(F.reverse("w"), " ")
    put = lambda before, text, after: F.concat(F.lit(before), text, F.lit(after))
    of_verse = F.when(k == 0, put("قال الله تعالى: ﴿", x, "﴾")).when(k == 1, put("قال الله تعالى: ﴿", altered, "﴾")).when(k == 2, put("قال رسول الله ﷺ: «", x, "»")).otherwise(put("قال تعالى: ﴿", turned, "﴾"))
    of_saying = F.when(k == 0, put("قال رسول الله ﷺ: «", x, "»")).when(k == 1, put("عن أبي هريرة رضي الله عنه أن رسول الله ﷺ قال:\n", x, " رواه مسلم")).when(k == 2, put("قال الله تعالى: ﴿", x, "﴾")).otherwise(put("قال رسول الله ﷺ: «", F.lit(_FOREIGN), "»"))
    posts = rows.select(F.col("item_id").alias("post"), F.concat(F.when(verse, of_verse).otherwise(of_saying), F.lit("\nصباح الخير يا جماعة")).alias("text"))
    found = analyze.analyze(posts, engine_of(rows))
    return found.select("post", "seg_no", "kind", "verdict", "misattributed", F.coalesce("nearest.chapter", F.lit(-1)).alias("nearest"))


@query(
    "q_report_cards",
    """WITH s AS (SELECT doc_id, text, CASE WHEN toxic = 1 THEN 'bad' WHEN quality = 1 THEN 'ok' ELSE 'warn' END AS verdict, CASE WHEN doc_id % 2 = 0 THEN 'quran' ELSE 'hadith' END AS kind FROM documents JOIN labels USING (doc_id))
    SELECT doc_id AS post, kind, verdict, replace(replace(replace(replace(replace(cut, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS shown, CAST(CASE WHEN kind = 'quran' THEN 0 WHEN verdict = 'warn' THEN 2 ELSE 1 END AS INTEGER) AS n_matches, CAST(3 AS INTEGER) AS n_ratings
    FROM (SELECT *, CASE WHEN length(text) > 600 THEN substr(text, 1, 600) || '…' ELSE text END AS cut FROM s)""",
)
def q_report_cards(spark, sf_dir):
    """The cards of a report: escaped, cut to their length (600 characters), the first match or two, the first three gradings."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    rating = F.when(F.col("toxic") == 1, "bad").when(F.col("quality") == 1, "ok").otherwise("warn")
    match = F.struct(F.col("doc_id").alias("doc"), F.lit(90).alias("score"))
    status = F.when(rating == "warn", "similar").otherwise("found")
    segments = rows.select(F.col("doc_id").alias("post"), F.lit(0).alias("seg_no"), F.when(F.col("doc_id") % 2 == 0, "quran").otherwise("hadith").alias("kind"), rating.alias("verdict"), F.lit("").alias("misattributed"), F.lit("altered").alias("q_status"), "text", F.col("text").alias("correct_text"), F.struct(status.alias("status"), F.array(match, match, match).alias("matches")).alias("h"), F.array(*map(F.lit, ("ok", "bad", "warn", "ok"))).alias("ratings"), F.struct(F.lit(1).alias("chapter"), F.col("text").alias("text")).alias("nearest"))
    return analyze.report(segments).select("post", "kind", "verdict", "shown", F.coalesce(F.size("matches"), F.lit(0)).alias("n_matches"), F.size("ratings").alias("n_ratings")).withColumn("n_matches", F.greatest("n_matches", F.lit(0)))


@query("q_god_speaks", f"SELECT conv_id, turn, turn % 3 <> 2 AS speaks FROM ({_TURNS})")
def q_god_speaks(spark, sf_dir):
    """Sayings that say that God speaks."""
    k = F.col("turn") % 3
    said = F.when(k == 0, "قَالَ اللَّهُ ").when(k == 1, "يقول ربكم ").otherwise("قال رسول ")
    return turns(spark, sf_dir).select("conv_id", "turn", verdict.says_god_speaks(F.concat(said, "x")).alias("speaks"))


_COMMON = ", ".join(f"'{w}'" for w in C.COMMON_WORDS)


@query("q_shares_words", f"WITH n AS (SELECT count(*) AS n FROM benchmark), d AS (SELECT doc_id, list_filter({plain_words_sql(letters_sql('text'))}, lambda w: length(w) >= 3 AND w NOT IN ({_COMMON})) AS kept, doc_id % n AS item_id FROM documents, n WHERE text IS NOT NULL), i AS (SELECT item_id, {plain_words_sql(letters_sql('text'))} AS there FROM benchmark) SELECT doc_id, len(kept) >= 2 AND len(list_filter(kept, lambda w: list_contains(there, w))) >= 0.6 * len(kept) AS shares FROM d JOIN i USING (item_id)")
def q_shares_words(spark, sf_dir):
    n = table(spark, sf_dir, "benchmark").count()
    d = documents(spark, sf_dir).where("text IS NOT NULL").select("doc_id", letters(F.col("text")).alias("a"), (F.col("doc_id") % n).alias("item_id"))
    return d.join(table(spark, sf_dir, "benchmark").select("item_id", letters(F.col("text")).alias("b")), "item_id").select("doc_id", verdict.shares_most_words(F.col("a"), F.col("b")).alias("shares"))


@query("q_close_words", f"SELECT item_id, pos, w1, w2, levenshtein({_ONE_BYTE.format('w1')}, {_ONE_BYTE.format('w2')}) <= CASE WHEN length(w2) <= 5 THEN 1 ELSE 2 END AS close FROM ({pairs_sql('benchmark', 'item_id')})")
def q_close_words(spark, sf_dir):
    """Whether words that follow each other are nearly the same."""
    from quoteverify.queries import q_bigram_index_rows

    return q_bigram_index_rows(spark, sf_dir).select("item_id", "pos", "w1", "w2", close_words(F.col("w1"), F.col("w2")).alias("close"))


@query("q_reading_slips", f"SELECT item_id, item_id % 5 IN (0, 2, 4) AS slip FROM ({_ITEMS})")
def q_reading_slips(spark, sf_dir):
    """Differences that an image's reading explains: a letter off, or words read unsurely; not another word, nor one left out."""
    k = F.col("item_id") % 5
    word = F.concat(F.lit("بتثجح"), F.get("w", F.lit(1)))
    differ = lambda kind, written, correct: F.struct(F.lit(kind).alias("kind"), written.alias("written"), correct.alias("correct"), F.lit(1).alias("chapter"), F.lit(1).alias("verse"))
    letter_off, other = F.concat(word, F.lit("ط")), F.lit("ظظظظظظظظ")
    found = F.when(k == 0, F.array(differ("replace", letter_off, word))).when(k.isin(1, 2), F.array(differ("replace", other, word))).otherwise(F.array(differ("missing", F.lit(""), word)))
    uncertain = F.when(k == 2, F.array(other)).when(k == 4, F.array(F.lit("غ"))).otherwise(F.array().cast("array<string>"))
    return items(spark, sf_dir).select("item_id", verdict.reading_slip(F.lit(True), found, F.lit("ظظظظظظظظ"), F.col("x"), uncertain).alias("slip"))


@query("q_doubtful_readings", f"SELECT item_id, item_id % 4 < 3 AS doubtful FROM ({_ITEMS})")
def q_doubtful_readings(spark, sf_dir):
    """Readings with many unsure words, with a word a letter off the closest text, with two of its words in one; and good ones."""
    k, word = F.col("item_id") % 4, F.lit("بتثجحخد")
    top = F.concat(word, F.lit(" "), F.lit("زسشصض"), F.lit(" "), F.col("x"))
    text = F.when(k == 1, F.lit("بتثجحخذ")).when(k == 2, F.lit("بتثجحخدزسشصض")).otherwise(word)
    uncertain = F.when(k == 0, F.array(word)).otherwise(F.array().cast("array<string>"))
    return items(spark, sf_dir).select("item_id", verdict.reading_doubtful(F.lit(True), text, uncertain, F.lit(85), top).alias("doubtful"))


@query("q_same_wording", f"SELECT item_id, CAST(0 AS INTEGER) AS entry_no, x AS text FROM ({_ITEMS}) WHERE item_id % 2 = 0")
def q_same_wording(spark, sf_dir):
    """Entries of an external source that have the wording asked for; other entries and empty answers drop out."""
    rows = items(spark, sf_dir)
    card = lambda text: F.concat(F.lit('<div class="hadith">1 - '), text, F.lit('</div><div class="hadith-info"><span class="info-subtitle">المصدر:</span> a</div>'))
    pages = rows.select(F.col("x").alias("text"), F.when(F.col("item_id") % 2 == 0, card(F.col("x"))).otherwise(card(F.lit(_FOREIGN))).alias("html"))
    found = external.same_wording(external.saved(pages.select("text"), pages.dropDuplicates(["text"])))
    return rows.join(found, F.col("x") == F.col("text")).select("item_id", "entry_no", F.col("entry.text").alias("text"))


# Alignment and search ------------------------------------------------------------------------------------------------


@query(
    "q_single_edits",
    f"""WITH w AS (SELECT item_id, {words_sql('text')} AS w FROM benchmark), e AS (SELECT *, 2 + item_id % (len(w) - 2) AS i FROM w WHERE len(w) >= 6)
    SELECT item_id || '/replace' AS piece, round_even((len(w) - 1) / len(w), 2) AS match_ratio, 'replace' AS kind, 'zzqxzzqx' AS written, w[i] AS correct FROM e
    UNION ALL SELECT item_id || '/missing', 1.0, 'missing', '', w[i] FROM e UNION ALL SELECT item_id || '/extra', round_even(len(w) / (len(w) + 1), 2), 'extra', 'zzqxzzqx', '' FROM e""",
)
def q_single_edits(spark, sf_dir):
    """Each passage with one inner word replaced, left out or added: where the check sees the difference, and which."""
    from quoteverify.queries import benchmark_corpus

    rows = table(spark, sf_dir, "benchmark").select("item_id", N.words(N.normalize(F.col("text"), "latin")).alias("w")).where(F.size("w") >= 6).withColumn("at", (2 + F.col("item_id") % (F.size("w") - 2)).cast("int"))
    left, rest, new = F.slice("w", F.lit(1), F.col("at") - 1), F.slice("w", F.col("at") + 1, F.size("w")), F.array(F.lit("zzqxzzqx"))
    texts = F.create_map(F.lit("replace"), F.concat(left, new, rest), F.lit("missing"), F.concat(left, rest), F.lit("extra"), F.concat(left, new, F.slice("w", F.col("at"), F.size("w"))))
    pieces = rows.select("item_id", F.explode(texts).alias("kind", "ws")).select(F.concat_ws("/", "item_id", "kind").alias("piece"), F.array_join("ws", " ").alias("text"))
    found = locate.check(pieces, benchmark_corpus(spark, sf_dir))
    return found.select("piece", "match_ratio", F.explode("differences").alias("d")).select("piece", "match_ratio", "d.kind", "d.written", F.lower("d.correct").alias("correct")).withColumn("correct", F.regexp_replace("correct", r"[^\p{L}]", ""))


def conversation_corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """Turns as verses; a conversation is an axis through which positions run."""
    rows = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select(F.lit(0).alias("layer"), F.col("conv_id").cast("int").alias("chapter"), F.col("turn").cast("int").alias("verse"), "text")
    return Corpus.build(rows, "latin", axis=F.col("chapter"))


_TURN_WORDS = f"SELECT conv_id, turn, {words_sql('text')} AS w FROM conversations WHERE text IS NOT NULL"


@query("q_axis_positions", f"SELECT CAST(conv_id AS INTEGER) AS chapter, CAST(turn AS INTEGER) AS verse, CAST(sum(len(w)) OVER (PARTITION BY conv_id ORDER BY turn) - len(w) AS BIGINT) AS first, CAST(len(w) AS BIGINT) AS n FROM ({_TURN_WORDS}) QUALIFY len(w) > 0")
def q_axis_positions(spark, sf_dir):
    """Where each turn's words stand on the axis of its conversation."""
    entries = conversation_corpus(spark, sf_dir).chunks.select(F.explode("entries").alias("e"))
    return entries.groupBy("e.chapter", "e.verse").agg(F.min("e.pos").cast("long").alias("first"), F.count("*").alias("n"))


@query(
    "q_quotes_over_verses",
    f"""WITH t AS (SELECT conv_id, turn, w, lead(w) OVER (PARTITION BY conv_id ORDER BY turn) AS v FROM ({_TURN_WORDS})),
    p AS (SELECT conv_id, turn, list_concat(w[greatest(len(w) - 3, 1):], v[:4]) AS q FROM t WHERE v IS NOT NULL)
    SELECT concat_ws('#', conv_id, turn) AS piece, CASE WHEN len(q) < 3 THEN 'too_short' ELSE 'verified' END AS status, CASE WHEN len(q) < 3 THEN 0.0 ELSE 1.0 END AS match_ratio FROM p""",
)
def q_quotes_over_verses(spark, sf_dir):
    """Quotations that go from the end of a verse to the beginning of the next one are found as they are."""
    from pyspark.sql import Window

    ws = N.words(N.normalize(F.col("text"), "latin"))
    rows = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", ws.alias("w")).withColumn("v", F.lead("w").over(Window.partitionBy("conv_id").orderBy("turn"))).where("v IS NOT NULL")
    last = F.when(F.size("w") > 4, F.slice("w", -4, 4)).otherwise(F.col("w"))
    pieces = rows.select(F.concat_ws("#", "conv_id", "turn").alias("piece"), F.array_join(F.concat(last, F.slice("v", 1, 4)), " ").alias("text"))
    return locate.check(pieces, conversation_corpus(spark, sf_dir)).select("piece", "status", "match_ratio")


@query("q_search_copies", f"WITH n AS (SELECT item_id, {words_sql('text')} AS w, {norm_sql('text')} AS norm FROM benchmark), f AS (SELECT norm, min(item_id) AS doc FROM n GROUP BY norm) SELECT item_id AS q, CASE WHEN len(w) < 2 THEN 'too_short' ELSE 'found' END AS status, CASE WHEN len(w) >= 2 THEN doc END AS doc FROM n JOIN f USING (norm)")
def q_search_copies(spark, sf_dir):
    """Each passage searched for with the last letter of its longest word misread: it is found, as the first match."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", "text")
    index = Postings.build(rows.select(F.col("item_id").alias("doc_id"), "text")).kept()
    ws = N.words(N.normalize(F.col("text"), "latin"))
    longest = F.element_at(F.array_sort(F.transform("w", lambda x, i: F.struct(F.length(x).alias("n"), i.alias("i")))), -1)["i"]
    misread = F.transform("w", lambda x, i: F.when((i == F.col("at")) & (F.length(x) >= 8), F.concat(F.substring(x, F.lit(1), F.length(x) - 1), F.lit("q"))).otherwise(x))
    asked = rows.select(F.col("item_id").alias("q"), ws.alias("w")).where(F.size("w") > 0).withColumn("at", longest).select("q", F.array_join(misread, " ").alias("text"))
    return search.search(asked, search.Collection(index)).select("q", "status", F.get("matches", F.lit(0))["doc"].alias("doc"))


_LATIN_VOCAB = f"SELECT DISTINCT word FROM ({tokens_sql('documents', 'doc_id')})"


@query("q_covered_words", f"SELECT word, ocr, length(word) >= 7 OR ends_with(word, 'q') OR ocr AND length(word) >= 4 AS covered FROM ({_LATIN_VOCAB}), (VALUES (true), (false)) o(ocr)")
def q_covered_words(spark, sf_dir):
    """Whether a word counts as there where the document has it with another last letter: by its likeness, or, for readings of
    images, as one letter off."""
    from quoteverify.operators.index import tokens

    rows = vocabulary(tokens(documents(spark, sf_dir), "doc_id").select("word"))
    near = F.array(F.concat(F.substring("word", F.lit(1), F.length("word") - 1), F.lit("q")))
    one, weight = F.array("word"), F.array(F.lit(1.0))
    both = [rows.select("word", F.lit(ocr).alias("ocr"), (search.rerank_scores(ocr)(F.col("word"), one, one, weight, F.col("word"), near, near)["coverage"] == 1.0).alias("covered")) for ocr in (True, False)]
    return both[0].unionByName(both[1])


_GLUED = f"SELECT item_id, list_concat([w[1] || w[2]], w[3:]) AS ws FROM (SELECT item_id, {words_sql('text')} AS w FROM benchmark) WHERE len(w) >= 2"


@query(
    "q_split_glued",
    f"""WITH g AS ({_GLUED}), voc AS MATERIALIZED (SELECT DISTINCT word FROM ({tokens_sql('benchmark', 'item_id')})), u AS (SELECT DISTINCT ws[1] AS w FROM g WHERE length(ws[1]) > 3 AND ws[1] NOT IN (SELECT word FROM voc)),
    c AS (SELECT w, unnest(range(2, length(w) - 1)) AS cut FROM u), h AS (SELECT w, min(cut) AS cut FROM c WHERE substr(w, 1, cut) IN (SELECT word FROM voc) AND substr(w, cut + 1) IN (SELECT word FROM voc) GROUP BY w)
    SELECT item_id AS q, array_to_string(list_concat(CASE WHEN cut IS NULL THEN [ws[1]] ELSE [substr(ws[1], 1, cut), substr(ws[1], cut + 1)] END, ws[2:]), ' ') AS text FROM g LEFT JOIN h ON h.w = ws[1]""",
)
def q_split_glued(spark, sf_dir):
    """Passages whose first two words a reading glued together."""
    from quoteverify.operators.index import tokens

    ws = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q"), N.words(N.normalize(F.col("text"), "latin")).alias("w")).where(F.size("w") >= 2)
    glued = ws.select("q", F.concat(F.array(F.concat(F.get("w", F.lit(0)), F.get("w", F.lit(1)))), F.slice("w", F.lit(3), F.size("w"))).alias("ws"))
    known = vocabulary(tokens(table(spark, sf_dir, "benchmark"), "item_id").select("word"))
    return search.split_glued(glued, known).select("q", F.array_join("ws", " ").alias("text"))


@query(
    "q_expanded_meaning",
    """WITH v AS MATERIALIZED (SELECT 'w' || vec_id AS word, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
    s AS (SELECT a.word AS w, b.word AS other, list_cosine_similarity(a.e, b.e) AS sim FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
    near AS (SELECT w, other, sim FROM s QUALIFY row_number() OVER (PARTITION BY w ORDER BY round(sim, 9) DESC, other) <= 8), all_ AS (SELECT w AS q, other AS term, sim * 0.6 AS boost FROM near WHERE sim >= 0.6 UNION ALL SELECT word, word, 1.0 FROM v WHERE vec_id % 100 = 0)
    SELECT q, term, round(max(boost), 6) AS boost FROM all_ GROUP BY ALL""",
)
def q_expanded_meaning(spark, sf_dir):
    """What a search by meaning asks for: the words themselves, and those near in meaning for as much as they are near."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("w"), "vec_id").alias("word"), F.col("embedding").alias("vec"))
    asked = v.where("vec_id % 100 = 0").select(F.col("word").alias("q"), F.array("word").alias("content"))
    return search.expanded_terms(asked, search.Collection(None, vectors=v.select("word", "vec"))).select("q", "term", F.round("boost", 6).alias("boost"))


# Readings ------------------------------------------------------------------------------------------------------------

_READ = "SELECT l_orderkey, l_linenumber, CAST(l_quantity * 2 AS DOUBLE) AS conf, CASE WHEN l_partkey % 5 = 0 THEN 'abc' ELSE ['كلمة', 'قول', 'نصٌّ', 'بيت'][l_suppkey % 4 + 1] END AS text FROM lineitem"


@query("q_reading_confidence", f"WITH r AS ({_READ}), s AS (SELECT l_orderkey, avg(conf) AS conf, array_to_string(list_sort(list_distinct(list(translate(replace(replace(text, 'ٌ', ''), 'ّ', ''), 'ة', 'ه')) FILTER (conf < 70))), ' ') AS uncertain FROM r WHERE text <> 'abc' AND conf >= 0 GROUP BY l_orderkey) SELECT CAST(l_orderkey AS VARCHAR) AS reading, round(coalesce(conf, 0), 6) AS conf, coalesce(uncertain, '') AS uncertain FROM (SELECT DISTINCT l_orderkey FROM r) LEFT JOIN s USING (l_orderkey)")
def q_reading_confidence(spark, sf_dir):
    """Mean confidence of a reading's words and those read unsurely; order lines stand for words."""
    word = F.when(F.col("l_partkey") % 5 == 0, "abc").otherwise(F.element_at(F.array(*map(F.lit, ("كلمة", "قول", "نصٌّ", "بيت"))), (F.col("l_suppkey") % 4 + 1).cast("int")))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("reading"), (F.col("l_quantity") * 2).cast("double").alias("conf"), word.alias("text"))
    return readings.confidence(rows).select("reading", F.round("conf", 6).alias("conf"), F.array_join(F.sort_array("uncertain"), " ").alias("uncertain"))


@query("q_reliable_readings", "SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) % 100 >= 45 AND o_custkey % 3 <> 2 AND o_custkey % 7 >= 3 AND o_custkey % 7 >= o_orderkey % 5 AS reliable FROM orders")
def q_reliable_readings(spark, sf_dir):
    """Readings that may be trusted: confident, few unsure words, three real words at least and no more debris."""
    k = F.col("o_custkey") % 3
    unsure = F.when(k == 2, F.array(F.lit("قول"), F.lit("بيت"))).when(k == 1, F.array(F.lit("قول"))).otherwise(F.array().cast("array<string>"))
    reliable = readings.is_reliable((F.col("o_totalprice").cast("long") % 100).cast("double"), F.lit("قول بيت كلام نص"), unsure, F.col("o_custkey") % 7, F.col("o_orderkey") % 5)
    return table(spark, sf_dir, "orders").select("o_orderkey", reliable.alias("reliable"))


@query("q_same_readings", f"SELECT item_id, item_id % 4 < 2 AS same FROM ({_ITEMS}) WHERE len(w) >= 12")
def q_same_readings(spark, sf_dir):
    """Two readings of an image say the same if they have nearly as many words and nearly the same letters."""
    k = F.col("item_id") % 4
    other = F.when(k == 0, F.col("x")).when(k == 1, F.array_join(F.slice("w", F.lit(1), F.size("w") - 1), " ")).when(k == 2, F.lit("")).otherwise(F.array_join(F.concat(F.col("w"), F.slice("w", 1, 4)), " "))
    return items(spark, sf_dir).where(F.size("w") >= 12).select("item_id", readings.same_reading(F.col("x"), other).alias("same"))


@query("q_engine_problems", "SELECT o_orderkey, ['quota', 'busy', 'missing', 'error', NULL, 'busy', 'quota'][o_orderkey % 7 + 1] AS problem FROM orders")
def q_engine_problems(spark, sf_dir):
    said = F.element_at(F.array(*(F.lit(x) for x in ("HTTP 429 Too Many", "503 Service Unavailable", "model not found", "no picture", None, "Read timed out", "RESOURCE_EXHAUSTED"))), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", readings.engine_problem(said).alias("problem"))


@query("q_chosen_engine", "SELECT o_orderkey, CASE WHEN vision AND NOT (good AND agrees) THEN 'vision' WHEN local AND good THEN 'local' WHEN local THEN 'local-low' END AS engine FROM (SELECT o_orderkey, o_orderkey % 2 = 0 AS good, o_custkey % 3 > 0 AS local, o_custkey % 2 = 0 AS agrees, o_orderkey % 3 = 0 AS vision FROM orders)")
def q_chosen_engine(spark, sf_dir):
    """Which reading counts: the local one if it is reliable and not contradicted."""
    flags = (F.col("o_orderkey") % 2 == 0, F.col("o_custkey") % 3 > 0, F.col("o_custkey") % 2 == 0, F.col("o_orderkey") % 3 == 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", readings.chosen_engine(*flags).alias("engine"))


_LINES = "SELECT doc_id, CAST(unnest(range(len(s))) AS INTEGER) AS line_no, unnest(s) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)"
_AR_LINES = f"SELECT doc_id, line_no, {arabic_sql('text')} AS text FROM ({_LINES})"


def arabic_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = documents(spark, sf_dir).select(F.col("doc_id").alias("reading"), F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return lines.withColumn("text", arabic(F.col("text")))


_JUNK = C.READING_JUNK
_TOKS = "unnest(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS tok"


@query(
    "q_lines_without_noise",
    f"""WITH lines AS MATERIALIZED ({_AR_LINES}), voc AS MATERIALIZED (SELECT DISTINCT unnest({plain_words_sql(letters_sql('text'))}) AS word FROM benchmark),
    k AS (SELECT doc_id, line_no, regexp_matches(tok, '[{_L}]') AS letter, regexp_matches(tok, '{_JUNK}') AS debris, {plain_sql('tok')} AS w FROM (SELECT doc_id, line_no, {_TOKS} FROM lines)),
    j AS (SELECT k.*, voc.word IS NOT NULL AS known FROM k LEFT JOIN voc ON voc.word = k.w),
    r AS (SELECT *, letter AND length(w) >= 3 AND known AS real FROM j),
    c AS (SELECT doc_id, line_no, count(*) FILTER (real) AS real, count(*) FILTER (NOT real AND CASE WHEN letter THEN length(w) >= 2 AND NOT known OR debris OR length(w) = 1 ELSE debris END) AS junk, count(*) FILTER (letter) AS lt FROM r GROUP BY ALL),
    a AS (SELECT lines.*, coalesce(real, 0) AS real, coalesce(junk, 0) AS junk, coalesce(lt, 0) AS lt FROM lines LEFT JOIN c USING (doc_id, line_no))
    SELECT doc_id AS reading, line_no FROM a WHERE trim(text, ' ') = '' OR real = 0 AND lt BETWEEN 1 AND 2 AND NOT regexp_matches(text, '{_JUNK}') OR real > 0 AND real >= junk""",
)
def q_lines_without_noise(spark, sf_dir):
    """Lines of documents that are mostly words of the passages."""
    counted = readings.line_counts(arabic_lines(spark, sf_dir), arabic_vocabulary(spark, sf_dir, "benchmark"))
    return readings.without_noise(counted).select("reading", "line_no")


_SIGNS = "".join(C.KEPT_SIGNS)


@query(
    "q_cleaned_lines",
    f"""WITH lines AS ({_AR_LINES}), voc AS MATERIALIZED (SELECT DISTINCT unnest({plain_words_sql(letters_sql('text'))}) AS word FROM benchmark),
    t AS (SELECT doc_id, line_no, CAST(unnest(range(len(s))) AS INTEGER) AS i, unnest(s) AS tok0 FROM (SELECT doc_id, line_no, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS s FROM lines)),
    g AS (SELECT *, regexp_replace(tok0, '^([#(\\[«﴿]*[إؤ]|[#(\\[«﴿]+)([{_L}])', '\\2') AS rest FROM t),
    n AS (SELECT *, {plain_sql('tok0')} AS w0, {plain_sql('rest')} AS rw FROM g),
    k AS (SELECT doc_id, line_no, i, CASE WHEN freed THEN rest ELSE tok0 END AS tok, CASE WHEN freed THEN rw ELSE w0 END AS w FROM (SELECT *, rest <> tok0 AND w0 NOT IN (SELECT word FROM voc) AND rw IN (SELECT word FROM voc) AS freed FROM n))
    SELECT doc_id AS reading, line_no, string_agg(tok, ' ' ORDER BY i) AS text FROM k WHERE w <> '' AND (length(w) >= 3 OR w IN (SELECT word FROM voc)) OR translate(tok, '{_SIGNS}', '') = '' GROUP BY ALL""",
)
def q_cleaned_lines(spark, sf_dir):
    """Lines without debris: words of three letters or known ones stay, and the signs that quotations need."""
    return readings.cleaned(arabic_lines(spark, sf_dir), arabic_vocabulary(spark, sf_dir, "benchmark"))


_ENDS = r"regexp_matches(line, '[.!؟?»)\]﴾}:؛]\s*$')"


@query(
    "q_joined_lines",
    f"""WITH p AS (SELECT doc_id, CAST(unnest(range(len(s))) AS INTEGER) AS part, unnest(s) AS body FROM (SELECT doc_id, string_split_regex(text, '\\n\\s*\\n') AS s FROM documents)),
    l AS (SELECT doc_id, part, i, line FROM (SELECT doc_id, part, unnest(range(len(s))) AS i, trim(regexp_replace(unnest(s), '\\s+', ' ', 'g')) AS line FROM (SELECT doc_id, part, string_split(body, chr(10)) AS s FROM p)) WHERE line <> ''),
    f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY part, i) AS n, coalesce(lag({_ENDS}) OVER (PARTITION BY doc_id, part ORDER BY i), true) AS starts FROM l),
    j AS (SELECT doc_id, substr(string_agg(CASE WHEN starts THEN chr(10) ELSE ' ' END || line, '' ORDER BY n), 2) AS joined FROM f GROUP BY doc_id)
    SELECT doc_id, coalesce(joined, '') AS joined FROM documents LEFT JOIN j USING (doc_id) WHERE text IS NOT NULL""",
)
def q_joined_lines(spark, sf_dir):
    """Documents as readings whose lines the layout broke."""
    return documents(spark, sf_dir).where("text IS NOT NULL").select("doc_id", readings.joined_lines(F.col("text")).alias("joined"))


@query(
    "q_tidied_answers",
    f"""WITH l AS (SELECT doc_id, i, line FROM (SELECT doc_id, unnest(range(len(s))) AS i, trim(regexp_replace(unnest(s), '\\s+', ' ', 'g')) AS line FROM (SELECT doc_id, string_split({arabic_sql('text')}, chr(10)) AS s FROM documents)) WHERE line <> ''),
    f AS (SELECT *, coalesce(lag({_ENDS}) OVER (PARTITION BY doc_id ORDER BY i), true) AS starts FROM l),
    j AS (SELECT doc_id, substr(string_agg(CASE WHEN starts THEN chr(10) ELSE ' ' END || line, '' ORDER BY i), 2) AS tidy FROM f GROUP BY doc_id)
    SELECT doc_id, coalesce(tidy, '') AS tidy FROM documents LEFT JOIN j USING (doc_id) WHERE text IS NOT NULL""",
)
def q_tidied_answers(spark, sf_dir):
    """Answers of a model in a code fence, with names of sites between their lines."""
    answer = F.concat(F.lit("```text\n"), F.replace(arabic(F.col("text")), F.lit("\n"), F.lit(" @Site.com\n")), F.lit("\n```"))
    return documents(spark, sf_dir).where("text IS NOT NULL").select("doc_id", readings.tidied(answer).alias("tidy"))


@query("q_restored_brackets", f"SELECT conv_id, turn, CASE WHEN length(x) >= 3 AND regexp_matches(x, '[{_L}]{{3}}$') THEN '﴿' || x || '﴾' ELSE '﴿' || x || '4' END AS restored FROM ({_TURNS}) WHERE regexp_matches(x, '^[{_L}]')")
def q_restored_brackets(spark, sf_dir):
    rows = turns(spark, sf_dir).where(F.rlike("x", F.lit(f"^[{_L}]")))
    return rows.select("conv_id", "turn", readings.restore_brackets(F.concat(F.lit("#"), "x", F.lit("4"))).alias("restored"))


# Pairing, generators -------------------------------------------------------------------------------------------------

_PAIRS = "WITH e AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag, l_linestatus) - 1 AS no, l_returnflag AS verdict, l_linestatus AS got FROM lineitem) SELECT l_orderkey AS post, CAST(no AS INTEGER) AS no, verdict, CASE WHEN no % 3 <> 2 THEN got ELSE '' END AS got FROM e"


def paired_lines(spark: SparkSession, sf_dir: str, by: str) -> DataFrame:
    """Order lines as expected items; all but every third are shown, last first where they are told by their words."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("post")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_linestatus"))).alias("x"))
    item = lambda r, i, v: F.struct(F.concat(F.lit("k"), i).alias("kind"), r[v].alias("verdict"), F.array(F.concat(F.lit("a"), i), F.concat(F.lit("b"), i)).alias("words"))
    shown = F.filter(F.transform("x", lambda r, i: item(r, i, "l_linestatus")), lambda s, i: i % 3 != 2)
    posts = lines.select("post", F.transform("x", lambda r, i: item(r, i, "l_returnflag")).alias("expected"), (F.reverse(shown) if by == "words" else shown).alias("shown"))
    return evaluate.paired(posts, by).select("post", "no", "verdict", F.coalesce("got", F.lit("")).alias("got"))


@query("q_paired_by_words", _PAIRS)
def q_paired_by_words(spark, sf_dir):
    return paired_lines(spark, sf_dir, "words")


@query("q_paired_in_order", _PAIRS)
def q_paired_in_order(spark, sf_dir):
    return paired_lines(spark, sf_dir, "kinds")


def _draw(n: int, m: str, key: str = "item_id") -> str:
    return f"('0x' || substr(md5(concat_ws(':', {key}, '1', '{n}')), 1, 7))::BIGINT % {m}"


_NOISY = f"CASE {_draw(0, '4')} WHEN 0 THEN replace(x, ' ', '  ') WHEN 1 THEN regexp_replace(x, '^([^{_L}]*[{_L}](?:[^{_L}]+[{_L}])*?)([{_L}])', '\\1ـ\\2') WHEN 2 THEN x || ' …!!' ELSE x END"


@query("q_noisy_posts", f"SELECT item_id, ['صباح الخير', 'انشرها'][{_draw(0, '2')} + 1] || chr(10) || 'قال ﷺ: «' || {_NOISY} || '»' || chr(10) || ['صباح الخير', 'انشرها'][{_draw(1, '2')} + 1] AS post FROM ({_ITEMS})")
def q_noisy_posts(spark, sf_dir):
    """Posts for tests, with typing noise."""
    rows = items(spark, sf_dir)
    return evaluate.built_posts(rows, "item_id", F.lit("قال ﷺ"), evaluate.noisy(F.col("x"), F.col("item_id")), ["صباح الخير", "انشرها"])


# Files ---------------------------------------------------------------------------------------------------------------


def fresh(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("q_read_verses", "SELECT CAST(layer AS INTEGER) AS layer, CAST(item_id AS INTEGER) AS chapter, CAST(1 AS INTEGER) AS verse, text FROM benchmark, (VALUES (0), (1)) l(layer)")
def q_read_verses(spark, sf_dir):
    """Passages written as the verse files are, one for each spelling, and read again."""
    paths = {}
    for layer in (0, 1):
        paths[layer] = fresh(spark, "verses")
        rows = table(spark, sf_dir, "benchmark").select(F.struct(F.col("item_id").cast("int").alias("chapter"), F.lit(1).alias("verse"), "text").alias("v"))
        rows.groupBy().agg(F.collect_list("v").alias("quran")).coalesce(1).write.json(paths[layer])  # one small file, as the format is
    return files.read_verses(spark, paths)


@query(
    "q_read_books",
    f"""WITH b AS (SELECT b, key, title, item_id, text, item_id % 3 AS g FROM benchmark, (VALUES (0, 'bukhari', '{C.BOOKS['bukhari']}'), (1, 'tirmidhi', '{C.BOOKS['tirmidhi']}')) v(b, key, title) WHERE trim(coalesce(text, ''), ' ') <> '')
    SELECT title AS book, key, CAST(item_id AS VARCHAR) AS number, text, b = 0 AS trusted, CASE WHEN b = 0 THEN '{C.TRUSTED_GRADE}' WHEN g = 0 THEN '{C.GRADE_LABELS['Sahih']}' WHEN g = 1 THEN '{C.GRADE_LABELS['Daif']}' ELSE '{C.UNGRADED}' END AS grade, CASE WHEN b = 0 OR g = 0 THEN 'ok' WHEN g = 1 THEN 'bad' ELSE 'warn' END AS rating, b * 1000000000 + item_id * 1000 AS doc FROM b""",
)
def q_read_books(spark, sf_dir):
    """Passages written as the books' files are, with numbers and gradings, and read again as one table."""
    paths = {}
    for key in ("bukhari", "tirmidhi"):
        paths[key] = fresh(spark, key)
        k = F.col("item_id") % 3
        grade = F.when(k == 0, "Sahih").when(k == 1, "Daif").otherwise("")
        row = F.struct("text", F.col("item_id").cast("string").alias("hadithnumber"), F.concat("item_id", F.lit(".0")).alias("arabicnumber"), F.array(F.struct(F.lit("Other").alias("name"), F.lit("Daif").alias("grade")), F.struct(F.lit(C.GRADER_SOURCE).alias("name"), grade.alias("grade"))).alias("grades"))
        table(spark, sf_dir, "benchmark").select(row.alias("h")).groupBy().agg(F.collect_list("h").alias("hadiths")).coalesce(1).write.json(paths[key])
    return files.read_books(spark, paths).select("book", "key", "number", "text", "trusted", "grade", "rating", "doc")


@query("q_looked_up", "SELECT c_custkey, c_nationkey, CASE WHEN c_nationkey % 2 = 0 THEN n_name ELSE '?' END AS name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def q_looked_up(spark, sf_dir):
    """Names from a lookup file, with a default for keys that it lacks."""
    path = fresh(spark, "lookup")
    rows = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0")
    rows.groupBy().agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("n_nationkey").cast("string"), F.col("n_name"))))).alias("value")).coalesce(1).write.text(path)
    return files.looked_up(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), files.read_lookup(spark, path), F.col("c_nationkey").cast("string"), "name", F.lit("?"))


@query("q_loaded_vectors", "WITH u AS (SELECT 'w' || vec_id AS word, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / greatest(sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE)))), 1e-9)) AS vec FROM embeddings) SELECT word, CAST(unnest(range(len(vec))) AS INTEGER) AS pos, round(unnest(vec), 6) AS x FROM u")
def q_loaded_vectors(spark, sf_dir):
    path = fresh(spark, "vectors")
    table(spark, sf_dir, "embeddings").select(F.concat(F.lit("w"), "vec_id").alias("word"), F.col("embedding").alias("vec")).write.parquet(path)
    return files.read_vectors(spark, path).select("word", F.posexplode("vec").alias("pos", "x")).select("word", "pos", F.round("x", 6).alias("x"))


@query("q_lines_of_files", "SELECT text, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS text FROM conversations) WHERE trim(text, ' ') <> '' GROUP BY text")
def q_lines_of_files(spark, sf_dir):
    """The lines of all turns written as a text file and read again."""
    path = fresh(spark, "lines")
    files.write_lines(table(spark, sf_dir, "conversations").select(F.explode(F.split("text", "\n")).alias("text")), path)
    return files.read_lines(spark, path).groupBy("text").agg(F.count("*").alias("n"))


_CASE_COLUMNS = "CAST(item_id AS INTEGER) AS id, 'hadith_ok' AS category, text AS post, 'ok' AS expect, CAST(item_id AS VARCHAR) AS ref, item_id % 2 = 0 AS uthmani"


@query("q_cases_of_files", f"SELECT {_CASE_COLUMNS} FROM benchmark")
def q_cases_of_files(spark, sf_dir):
    """Labelled cases written a JSON object a line and read again."""
    path = fresh(spark, "cases")
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("int").alias("id"), F.lit("hadith_ok").alias("category"), F.col("text").alias("post"), F.lit("ok").alias("expect"), F.col("item_id").cast("string").alias("ref"), (F.col("item_id") % 2 == 0).alias("uthmani"))
    files.write_json(rows, path)
    return files.read_cases(spark, path).select("id", "category", "post", "expect", "ref", "uthmani")


@query("q_reading_words_of_files", "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS conf, l_returnflag || l_linestatus AS text FROM lineitem")
def q_reading_words_of_files(spark, sf_dir):
    """Word tables as a reader writes them: a heading, twelve columns, rows of another width left out."""
    path = fresh(spark, "words")
    rows = table(spark, sf_dir, "lineitem")
    line = F.concat_ws("\t", *[F.lit("5")] * 10, F.col("l_quantity").cast("string"), F.concat_ws("/", "l_orderkey", "l_linenumber", F.concat("l_returnflag", "l_linestatus")))
    rows.select(line.alias("value")).union(rows.limit(1).select(F.lit("\t".join(["level"] * 12)))).union(rows.limit(1).select(F.lit("short\trow"))).write.text(path)
    parts = F.split("text", "/")
    return files.read_reading_words(spark, path).select(F.get(parts, F.lit(0)).cast("long").alias("l_orderkey"), F.get(parts, F.lit(1)).cast(rows.schema["l_linenumber"].dataType).alias("l_linenumber"), "conf", F.get(parts, F.lit(2)).alias("text"))


@query("q_registered_functions", f"SELECT doc_id, {norm_sql('text')} AS latin, {plain_sql(arabic_sql('text'))} AS plain, CAST(100.0 AS DOUBLE) AS same FROM documents WHERE text <> ''")
def q_registered_functions(spark, sf_dir):
    """The functions under their SQL names."""
    from quoteverify.functions.register import register

    register(spark)
    rows = documents(spark, sf_dir).where("text <> ''").select("doc_id", "text", arabic(F.col("text")).alias("ar"))
    return spark.sql("SELECT doc_id, normalize_latin(text) AS latin, normalize_text(ar) AS plain, fuzz_ratio(CAST(doc_id AS STRING), CAST(doc_id AS STRING)) AS same FROM {rows}", rows=rows)
