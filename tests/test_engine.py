"""The engine on a small Arabic corpus: checks, searches, whole posts and verdicts."""

import pytest
from pyspark.sql import functions as F

from quoteverify.functions.normalize import canonical_typing, mend_salutation, normalize, plain, quoted_core, strip_marks, words
from quoteverify.operators import locate, search, segment, verdict
from quoteverify.operators.index import Corpus, Postings
from quoteverify.plans.analyze import Engine, analyze, report, verdict_counts
from quoteverify.sources.external import saved

VERSES = [
    (2, 45, "واستعينوا بالصبر والصلاة وإنها لكبيرة إلا على الخاشعين"), (2, 153, "يا أيها الذين آمنوا استعينوا بالصبر والصلاة إن الله مع الصابرين"),
    (13, 28, "الذين آمنوا وتطمئن قلوبهم بذكر الله ألا بذكر الله تطمئن القلوب"), (94, 5, "فإن مع العسر يسرا"), (94, 6, "إن مع العسر يسرا"),
    (108, 1, "إنا أعطيناك الكوثر"), (108, 2, "فصل لربك وانحر"), (108, 3, "إن شانئك هو الأبتر"),
    (112, 1, "قل هو الله أحد"), (112, 2, "الله الصمد"), (112, 3, "لم يلد ولم يولد"), (112, 4, "ولم يكن له كفوا أحد"),
]
SAYINGS = [
    (1, "إنما الأعمال بالنيات وإنما لكل امرئ ما نوى", True, "ok"), (2, "من غشنا فليس منا", True, "ok"), (3, "لا تغضب فردد مرارا قال لا تغضب", True, "ok"),
    (4, "الكيس من دان نفسه وعمل لما بعد الموت", False, "bad"), (5, "لا يؤمن أحدكم حتى يحب لأخيه ما يحب لنفسه", True, "ok"), (6, "الكلمة الطيبة صدقة", True, "ok"),
]


@pytest.fixture(scope="module")
def verses(spark):
    return spark.createDataFrame([(0, *v) for v in VERSES], "layer int, chapter int, verse int, text string")


@pytest.fixture(scope="module")
def corpus(verses):
    return Corpus.build(verses)


@pytest.fixture(scope="module")
def collection(spark):
    docs = spark.createDataFrame(SAYINGS, "doc_id long, text string, trusted boolean, rating string")
    return search.Collection.arabic(Postings.build(docs, profile="arabic").kept(), preferred="trusted")


@pytest.fixture(scope="module")
def engine(corpus, collection, verses):
    return Engine(corpus, collection, shown=verses)


def checks(spark, corpus, texts):
    rows = spark.createDataFrame([(f"{i:03d}", t) for i, t in enumerate(texts)], "piece string, text string")
    return locate.check(rows, corpus).orderBy("piece").collect()


def test_check_places_and_differences(spark, corpus):
    r = checks(spark, corpus, [
        "قُلْ هُوَ اللَّهُ أَحَدٌ اللَّهُ الصَّمَدُ لَمْ يَلِدْ وَلَمْ يُولَدْ وَلَمْ يَكُن لَّهُ كُفُوًا أَحَدٌ", "واستعينوا بالصبر والدعاء وإنها لكبيرة إلا على الخاشعين", "إن الله مع الصابرين والمتقين",
        "إنا أعطيناك الكوثر فصل لربك وانحر إن شانئك هو الأبتر", "النظافة من الإيمان والعلم نور", "الله أكبر", "واستعينوا بالصبر وإنها لكبيرة إلا على الخاشعين", "", None,
    ])
    assert [x.status for x in r] == ["verified", "altered", "altered", "verified", "not_found", "too_short", "altered", "too_short", "too_short"]
    assert (r[0].chapter, r[0].verse_from, r[0].verse_to) == (112, 1, 4) and (r[3].chapter, r[3].verse_from, r[3].verse_to) == (108, 1, 3)
    [d] = r[1].differences
    assert (d.kind, d.written, plain(d.correct), d.chapter, d.verse) == ("replace", "والدعاء", "والصلاه", 2, 45)
    assert [(d.kind, d.written) for d in r[2].differences] == [("extra", "والمتقين")]
    assert [(d.kind, plain(d.correct)) for d in r[6].differences] == [("missing", "والصلاه")]


def test_every_passage_verifies_itself(spark, corpus):
    long_ = [t for _, _, t in VERSES if len(t.split()) >= 3]
    assert {x.status for x in checks(spark, corpus, long_)} == {"verified"}


def test_fragments(spark, corpus):
    asked = spark.createDataFrame([("x", "تطمين القلوب"), ("y", "قل هو الله احد"), ("z", "")], "q string, text string")
    r = {(x.q, x["rank"]): (x.chapter, x.verse) for x in locate.search_fragment(asked, corpus).collect()}
    assert r["x", 1] == (13, 28) and r["y", 1] == (112, 1) and ("z", 1) not in r


def test_search_statuses(spark, collection):
    asked = spark.createDataFrame([("a", "إنما الأعمال بالنيات"), ("b", "لا تغضب"), ("c", "حب الوطن من الإيمان"), ("d", "تغضب"), ("e", None)], "q string, text string")
    r = {x.q: x for x in search.search(asked, collection).collect()}
    assert [r[k].status for k in "abcde"] == ["found", "found", "not_found", "too_short", "too_short"]
    assert r["a"].matches[0].doc == 1 and r["b"].matches[0].doc == 3


def test_search_by_meaning_is_never_found(spark, collection):
    vectors = spark.createDataFrame([("الحسنه", [1.0, 0.1]), ("الطيبه", [1.0, 0.0]), ("صدقه", [0.0, 1.0])], "word string, vec array<double>")
    own = search.Collection.arabic(collection.index, preferred="trusted", vectors=vectors)
    asked = spark.createDataFrame([("m", "الكلمة الحسنة صدقة", True), ("n", "الكلمة الحسنة صدقة", False)], "q string, text string, by_meaning boolean")
    r = {x.q: x for x in search.search(asked, own).collect()}
    assert r["m"].status == "similar" and r["m"].matches[0].doc == 6 and r["m"].matches[0].semantic
    assert r["n"].status != "found" and not any(m.semantic for m in r["n"].matches)


def test_glued_words_part(spark, collection):
    asked = spark.createDataFrame([("a", ["منغشنا", "فليس", "منا"])], "q string, ws array<string>")
    known = collection.index.stats.select(F.col("term").alias("word"))
    assert search.split_glued(asked, known).head().ws == ["من", "غشنا", "فليس", "منا"]


POST = """صباح الخير يا جماعة
قال الله تعالى: ﴿واستعينوا بالصبر والدعاء وإنها لكبيرة إلا على الخاشعين﴾
وقال رسول الله صلى الله عليه وسلم: "اطلبوا العلم ولو في الصين"
وقال ﷺ: «من غشنا فليس منا»
قل هو الله أحد الله الصمد لم يلد ولم يولد ولم يكن له كفوا أحد
عن أبي هريرة رضي الله عنه أن رسول الله صلى الله عليه وسلم قال لا تغضب
انشرها ولك الأجر"""


def test_posts_end_to_end(spark, engine):
    posts = [(1, POST), (2, "قال الله تعالى: ﴿إنما الأعمال بالنيات﴾"), (3, "قال رسول الله ﷺ: «إن الله مع الصابرين»"), (4, "قال تعالى: ﴿العلم نور والجهل ظلام﴾"), (5, ""), (6, "قال رسول الله ﷺ:\nإنما الأعمال بالنيات"), (7, None), (8, "Good morning everyone!"), (9, "؟؟؟ ... !!!")]
    rows = analyze(spark.createDataFrame(posts, "post int, text string"), engine).cache()
    got = {(r.post, r.seg_no): (r.kind, r.verdict, r.misattributed) for r in rows.collect()}
    assert [got[1, i][:2] for i in range(7)] == [("text", "neutral"), ("quran", "bad"), ("hadith", "bad"), ("hadith", "ok"), ("quran", "ok"), ("hadith", "ok"), ("text", "neutral")]
    assert got[2, 0] == ("hadith", "bad", "hadith_as_quran") and got[3, 0] == ("quran", "warn", "quran_as_hadith") and got[4, 0][:2] == ("quran", "bad") and got[6, 0][:2] == ("hadith", "ok")
    assert not any(post in (5, 7) for post, _ in got) and all(v[0] == "text" for k, v in got.items() if k[0] in (8, 9))
    assert {(r.post, r.ok, r.warn, r.bad) for r in verdict_counts(rows).collect()} >= {(1, 3, 0, 2), (3, 0, 1, 0)}
    assert all(r.label for r in report(rows).collect())


def test_external_gradings_decide_for_the_same_wording_only(spark, engine):
    card = '<div class="hadith">1 - {}</div><div class="hadith-info"><span class="info-subtitle">خلاصة حكم المحدث:</span> {}</div>'
    texts = {"النظافة من الإيمان": card.format("الطهور شطر الإيمان", "صحيح"), "الجنة تحت أقدام الأمهات": card.format("الجنة تحت أقدام الأمهات", "منكر") + card.format("الجنة تحت أقدام الأمهات", "صحيح"), "طلب العلم نور للقلب": card.format("طلب العلم نور للقلب", "صحيح")}
    posts = spark.createDataFrame([(i, f"قال رسول الله ﷺ: «{t}»") for i, t in enumerate(texts)], "post int, text string")
    pages = spark.createDataFrame(list(texts.items()), "text string, html string")
    found = saved(pages.select("text"), pages)
    assert [r.verdict for r in analyze(posts, engine, external=found).orderBy("post").collect()] == ["bad", "warn", "ok"]


def test_reading_slips_soften(spark, engine):
    posts = spark.createDataFrame([(1, "قال تعالى: ﴿واستعينوا بالصبر والصلاه وانها لكبيره الا على الخاشعبن﴾", []), (2, "قال تعالى: ﴿واستعينوا بالصبر والدعاء وإنها لكبيرة إلا على الخاشعين﴾", []), (3, "قال تعالى: ﴿واستعينوا بالصبر والدعاء وإنها لكبيرة إلا على الخاشعين﴾", ["والدعاء"])], "post int, text string, uncertain array<string>")
    assert [r.verdict for r in analyze(posts, engine, from_image=True).orderBy("post").collect()] == ["warn", "bad", "warn"]


def one(spark, column_of, text):
    return spark.createDataFrame([(text,)], "t string").select(column_of(F.col("t")).alias("x")).head().x


@pytest.mark.parametrize("text", ["إِنَّ مَعَ ٱلۡعُسۡرِ يُسۡرࣰا", "إنّ مع العســر يســرا", "خَيۡرࣰ ا و استعينوا", "هُدࣰ ى لِّلۡمُتَّقِينَ", "بَرَآءَةࣱ مِّنَ ٱللَّهِ", "abc ١٢ ﴿٤٥﴾", "", " و ", "یک ہۃ"])
@pytest.mark.parametrize("uthmani", [False, True])
def test_normalisation_in_both_forms(spark, text, uthmani):
    assert one(spark, lambda c: normalize(c, "arabic", uthmani), text) == plain(text, uthmani)


def test_text_repairs(spark):
    assert one(spark, canonical_typing, "عـن صلي الله عليه و سلم اللّٰه") .startswith("عن صلى الله عليه وسلم")
    assert one(spark, canonical_typing, "«نص مقتبس هنا» رواه مسلم وقال ﷺ: «آخر هنا»").count("\n") == 1
    assert one(spark, mend_salutation, "قال رسول الله كل: «نص»") == "قال رسول الله ﷺ: «نص»"
    assert segment.mend_intro("قال الله تقالى: كذا") == "قال الله تعالى: كذا"
    assert one(spark, quoted_core, 'حدثنا فلان قال "إنما الأعمال بالنيات" رواه') == "إنما الأعمال بالنيات"
    assert one(spark, strip_marks, "قُلْ") == "قل"
    assert one(spark, lambda c: words(normalize(c, "latin")), "It's a TEST, é1x") == ["it", "s", "a", "test", "é", "x"]


def test_gradings(spark):
    grades = {"رفعه إلى النبي صلى الله عليه وسلم ليس بصحيح": "bad", "ليس بحديث، لكن معناه صحيح": "bad", "لا أصل له": "bad", "صحيح": "ok", "إسناده حسن": "ok", "غريب": "warn"}
    assert {g: one(spark, verdict.external_rating, g) for g in grades} == grades
    labels = {"Sahih Isnaad Mursal": "warn", "Daif Maqtu": "bad", "Hasan Sahih": "ok", "Unknown": "warn"}
    assert {g: one(spark, verdict.grade_rating, g) for g in labels} == labels


PIECES = {
    "رواه البخاري\nقال ﷺ: «لا تغضب يا رجل» (رواه البخاري ومسلم)": [("لا تغضب يا رجل", True, False)],
    "قال تعالى: ﴿إن مع العسر يسرا﴾ وقال ﷺ: «من غشنا فليس منا»": [("إن مع العسر يسرا", False, True), ("من غشنا فليس منا", True, False)],
    "قال رسول الله ﷺ:": [("", True, False)],
    "": [], " \n؟": [],
    "كلام «نص أول هنا» ثم «نص ثان هنا»": [("نص أول هنا", False, False), ("نص ثان هنا", False, False)],
    "قال ﷺ «نص أول هنا» «نص ثان هنا»": [("نص أول هنا", True, False), ("نص ثان هنا", True, False)],
    "«من رسول الله ﷺ: «حسن إسلام المرء»": [("حسن إسلام المرء", True, False)],
    "قال ﷺ (صلى الله عليه وسلم) «نص من كلمات» [45]": [("نص من كلمات", True, False)],
    "عن أبي هريرة (رضي الله عنه) أن النبي ﷺ قال:": [("", True, False)],
    "عن أبي هريرة رضي الله عنه أن رسول الله ﷺ قال لا تغضب رواه مسلم": [("لا تغضب", True, False)],
    "قال الله تعالى: إن مع العسر يسرا": [("إن مع العسر يسرا", False, True)],
    "﴿اً كتاب أنزل﴾": [("كتاب أنزل", False, True)],
    "«كلمة» وحدها": [("كلمة» وحدها", False, False)],
    "صباح الخير. كيف الحال؟": [("صباح الخير", False, False), ("كيف الحال", False, False)],
}


def test_pieces(spark):
    got = {r.t: [tuple(p) for p in r.p] for r in spark.createDataFrame([(t,) for t in PIECES], "t string").select("t", segment.pieces(F.col("t")).alias("p")).collect()}
    assert got == PIECES


def test_introductions_mark_the_piece_after_them(spark):
    posts = {
        1: ("قال رسول الله ﷺ:\nإنما الأعمال بالنيات\nكلام آخر", [("إنما الأعمال بالنيات", True, False, False), ("كلام آخر", False, False, False)]),
        2: ("قال تعالى:\nإن مع العسر يسرا\nكلام آخر", [("إن مع العسر يسرا", False, True, False), ("كلام آخر", False, False, False)]),
        3: ("قال رسول الله صلى الله عليه وسلم\nقال النبي ﷺ:\nنص الحديث هنا", [("نص الحديث هنا", True, False, False)]),
        4: ("قال رسول الله ﷺ:", []), 5: (None, []),
    }
    rows = segment.pieces_of(spark.createDataFrame([(k, t) for k, (t, _) in posts.items()], "post int, text string")).collect()
    for k, (_, expected) in posts.items():
        assert [tuple(r)[2:] for r in sorted(rows, key=lambda r: r.seg_no) if r.post == k] == expected, k


def test_ablation_and_generators(spark, collection, engine):
    from quoteverify.operators import evaluate

    vectors = spark.createDataFrame([("الحسنه", [1.0, 0.1]), ("الطيبه", [1.0, 0.0]), ("صدقه", [0.0, 1.0])], "word string, vec array<double>")
    own = search.Collection.arabic(collection.index, preferred="trusted", vectors=vectors)
    r = evaluate.ablation(spark.createDataFrame([("m", "الكلمة الحسنة صدقة", 6)], "q string, text string, expected long"), own).head()
    assert r.with_meaning == 6 and r.without is None
    items = spark.createDataFrame([(i, t) for i, t, *_ in SAYINGS[:3]], "k long, text string")
    posts = evaluate.built_posts(items, "k", F.lit("قال رسول الله ﷺ"), evaluate.noisy(F.col("text"), F.col("k")), ["صباح الخير يا جماعة", "انشرها ولك الأجر"])
    got = analyze(posts.select(F.col("k").alias("post"), F.col("post").alias("text")), engine).where("kind <> 'text'").collect()
    assert sorted((r.post, r.verdict) for r in got) == [(1, "ok"), (2, "ok"), (3, "ok")]
