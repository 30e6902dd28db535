"""Functions, sources and smaller operators against plain versions of themselves."""

import json
import os
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quoteverify.functions.fuzzy import common_length, partial_ratio, ratio
from quoteverify.functions.normalize import plain
from quoteverify.operators import search, cards, evaluate, locate, readings, vectors
from quoteverify.sources import external, files


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b, 1):
            row[j], left = (left + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


def plain_partial(a, b):
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0 if b else 100.0

    def best(a, b):
        n = len(a)
        return max(200 * lcs(a, w) / (n + len(w)) for w in (b[max(0, e - n) : min(e, len(b))] for e in range(1, len(b) + n)))

    return max(best(a, b), best(b, a)) if len(a) == len(b) else best(a, b)


def test_ratios_against_dynamic_programming():
    draw = random.Random(5)
    for _ in range(500):
        a, b = ("".join(draw.choice("abcd") for _ in range(draw.randint(0, n))) for n in (9, 30))
        assert common_length(a, b) == lcs(a, b)
        assert partial_ratio(a, b) == pytest.approx(plain_partial(a, b))
    assert ratio("", "") == 100 and ratio("abc", "") == 0


def test_alignment_agrees_with_difflib():
    draw = random.Random(7)
    for _ in range(200):
        w = [draw.choice("abcdef") for _ in range(20)]
        q = [draw.choice("abcdefgh") for _ in range(draw.randint(3, 12))]
        window = [{"pos": i, "word": x, "display": x, "chapter": 1, "verse": i} for i, x in enumerate(w)]
        blocks = [b for b in SequenceMatcher(None, q, w, autojunk=False).get_matching_blocks() if b.size]
        got = locate.compare(q, window)
        if not blocks:
            assert got is None
            continue
        assert got["matched"] == sum(b.size for b in blocks) and got["longest"] == max(b.size for b in blocks)
        if q[blocks[0].a : blocks[-1].a + blocks[-1].size] == w[blocks[0].b : blocks[-1].b + blocks[-1].size] and blocks[0].a == 0 and blocks[-1].a + blocks[-1].size == len(q):
            assert got["differences"] == []


def test_cards():
    page = """<div class="hadith" style="x">1 - اطلبوا العلمَ ولو بالصينِ</div>
    <div class="hadith-info"><span class="info-subtitle">الراوي:</span> أنس بن مالك | <span class="info-subtitle">المحدث:</span>
    <span style="color:blue;">ابن حبان</span> | <span class="info-subtitle">المصدر:</span> المجروحين |
    <span class="info-subtitle">الصفحة أو الرقم:</span> 1/382 | <span class="info-subtitle">خلاصة حكم المحدث:</span> <span>باطل لا أصل له</span></div>"""
    [e] = cards.parse_cards(page)
    assert e == {"text": "اطلبوا العلمَ ولو بالصينِ", "narrator": "أنس بن مالك", "scholar": "ابن حبان", "source": "المجروحين", "number": "1/382", "grade": "باطل لا أصل له"}
    assert cards.parse_cards("") == [] and cards.parse_cards("<p>x</i></p>") == []


def test_breaker_rests_after_a_failure():
    now, calls = [0.0], []

    def call(text):
        calls.append(text)
        raise OSError

    b = external.Breaker(call, pause=300, clock=lambda: now[0])
    assert b("a") is None and b("b") is None and calls == ["a"]
    now[0] = 301
    assert b("c") is None and calls == ["a", "c"]


def test_models_in_turn():
    tried = []

    def call(model):
        tried.append(model)
        raise RuntimeError({"a": "503 busy", "b": "429 quota", "c": "404 not found"}[model])

    kind = lambda e: {"5": "busy", "2": "quota", "0": "missing"}[str(e)[0 if str(e)[0] == "5" else 1]]
    with pytest.raises(RuntimeError, match="quota"):
        external.first_that_answers(["a", "b", "c"], call, kind)
    assert tried == ["a", "a", "b", "c"]


def test_lookup_tells_unreached_from_empty(spark):
    def fetch(text):
        if text == "bad":
            raise OSError
        return ""

    texts = spark.createDataFrame([("good",)], "text string")
    assert external.lookup(texts, fetch).head().entries == []
    r = external.lookup(spark.createDataFrame([("bad",)], "text string"), fetch).head()
    assert r.entries is None and not r.reached


def test_sources(spark, tmp_path):
    (tmp_path / "v.json").write_text(json.dumps({"quran": [{"chapter": 1, "verse": 1, "text": "نص"}, {"chapter": 1, "verse": 2, "text": "آخر"}]}), "utf-8")
    assert files.read_verses(spark, {0: str(tmp_path / "v.json"), 1: str(tmp_path / "v.json")}).count() == 4
    book = {"hadiths": [{"text": "كذا", "hadithnumber": 52, "arabicnumber": 52.10, "grades": [{"name": "Al-Albani", "grade": "Daif"}]}, {"text": " ", "hadithnumber": 2, "grades": []}, {"text": "غيره", "hadithnumber": 3, "grades": []}]}
    for name in ("abudawud", "bukhari"):
        (tmp_path / f"{name}.json").write_text(json.dumps(book), "utf-8")
    rows = {(r.key, r.number): r for r in files.read_books(spark, {n: str(tmp_path / f"{n}.json") for n in ("bukhari", "abudawud")}).collect()}
    assert rows["abudawud", "52"].rating == "bad" and rows["abudawud", "3"].rating == "warn" and rows["bukhari", "3"].rating == "ok" and len({r.doc for r in rows.values()}) == 4
    (tmp_path / "t.json").write_text(json.dumps({"1:1": "one"}), "utf-8")
    assert files.read_lookup(spark, str(tmp_path / "t.json")).collect()[0].value == "one"
    assert files.read_lookup(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "in.txt").write_text("﻿سطر\n\nآخر\n", "utf-8")
    assert [r.text for r in files.read_lines(spark, str(tmp_path / "in.txt")).collect()] == ["سطر", "آخر"]
    row = "\t".join(["5"] * 10)
    (tmp_path / "r.tsv").write_text("\t".join(["h"] * 12) + f"\n{row}\t80\tكلمة\n{row}\t40\tاخرى\n{row}\t-1\tلا\nshort\n", "utf-8")
    conf = readings.confidence(files.read_reading_words(spark, str(tmp_path / "r.tsv"))).head()
    assert conf.conf == 60 and conf.uncertain == ["اخري"]


def test_readings(spark):
    vocab = spark.createDataFrame([(w,) for w in ("واستعينوا", "بالصبر", "والصلاه", "من")], "word string")
    lines = spark.createDataFrame([(1, 0, "واستعينوا بالصبر والصلاة"), (1, 1, "a1 [x] غغغ"), (1, 2, ""), (1, 3, "الصين”")], "reading int, line_no int, text string")
    counted = readings.line_counts(lines, vocab).cache()
    got = {r.line_no: (r.real, r.junk) for r in counted.collect()}
    assert got == {0: (3, 0), 1: (0, 3), 2: (0, 0), 3: (0, 1)}
    assert sorted(r.line_no for r in readings.without_noise(counted).collect()) == [0, 2, 3]
    pairs = spark.createDataFrame([("واستعينوا", "بالصبر"), ("بالصبر", "والصلاه")], "w1 string, w2 string")
    c = readings.chains(spark.createDataFrame([(1, "واستعينوا بالصبر والصلاة من واستعينوا بالصبر")], "reading int, text string"), pairs).head()
    assert (c.pairs, c.longest, c.repeats) == (3, 2, 1)
    tidy = {
        "قال تعالى\n﴿نص\nتكملة﴾\nجديد": "قال تعالى\n﴿نص تكملة﴾\nجديد", "أول  سطر\nتكملته\n\nفقرة\nأخرى": "أول سطر تكملته\nفقرة أخرى",
        "«مفتوح\nقال نعم\nرواه مسلم»\nقال آخر\nعن فلان": "«مفتوح قال نعم رواه مسلم»\nقال آخر\nعن فلان", "نهاية.\nبداية": "نهاية.\nبداية", "": "", " \n \n\n": "", "واحد": "واحد",
    }
    assert {r.t: r.x for r in spark.createDataFrame([(t,) for t in tidy], "t string").select("t", readings.joined_lines(F.col("t")).alias("x")).collect()} == tidy
    bare = {"```\nلا\nيؤمن أحدكم. SITE.COM\n```": "لا يؤمن أحدكم.", "```text\nنص:\nآخر\r\nثالث@x\n": "نص:\nآخر", "": "", "قال\n\nنعم": "قال نعم"}
    assert {r.t: r.x for r in spark.createDataFrame([(t,) for t in bare], "t string").select("t", readings.tidied(F.col("t")).alias("x")).collect()} == bare
    done = readings.cleaned(spark.createDataFrame([(1, 0, "إواستعينوا xx ” من غغ")], "reading int, line_no int, text string"), vocab).head()
    assert done.text == "واستعينوا ” من"
    engines = spark.createDataFrame([("x 429",), ("HTTP 503",), ("404",), ("boom",), (None,)], "e string").select(readings.engine_problem(F.col("e")).alias("k")).collect()
    assert [r.k for r in engines] == ["quota", "busy", "missing", "error", None]


@pytest.mark.parametrize("first", [3, 60, 10**6])
def test_pruned_scores_are_those_of_all_documents(spark, monkeypatch, first):
    from quoteverify.operators import index

    monkeypatch.setattr(index, "FIRST_POSTINGS", first)
    draw = random.Random(4)
    words = [f"w{k}" for k in range(60)]
    weights = [1 / (k + 1) for k in range(60)]
    docs = spark.createDataFrame([(i, " ".join(draw.choices(words, weights, k=draw.randint(0, 30)))) for i in range(150)] + [(200, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(q, w, draw.choice([1.0, 0.9])) for q in range(12) for w in set(draw.choices(words, weights, k=draw.randint(1, 12)))] + [(50, "nowhere", 1.0)], "q long, term string, boost double")
    built = index.Postings.build(docs.withColumn("text", F.translate("text", "0123456789", "abcdefghij")))
    asked = asked.withColumn("term", F.translate("term", "0123456789", "abcdefghij"))
    for top in (3, 40):
        rows = lambda p: sorted(map(tuple, index.bm25(asked, p, top).collect()))  # noqa: B023, E731
        assert rows(built.kept()) == rows(built) and len(rows(built)) >= 12 * 2


def test_edit_distance_join_against_all_pairs(spark):
    draw = random.Random(2)
    word = lambda: "".join(draw.choice("abc") for _ in range(draw.randint(1, 9)))
    asked, known = sorted({word() for _ in range(60)}), sorted({word() for _ in range(300)})

    def limit(w):
        return 0 if len(w) < 3 else 1 if len(w) <= 5 else 2

    expected = {(w, v) for w in asked for v in known if w == v or limit(w) and locate._edits(v, w) <= limit(w)}
    got = locate.near_words(spark.createDataFrame([(w,) for w in asked], "word string"), spark.createDataFrame([(v,) for v in known], "word string"))
    assert {(r.word, r.v) for r in got.collect()} == expected


def test_evaluation(spark):
    item = lambda k, v, *ws: {"kind": k, "verdict": v, "words": list(ws)}
    rows = spark.createDataFrame([(1, [item("quran", "ok", "a", "b"), item("hadith", "bad", "c")], [item("hadith", "ok", "c"), item("quran", "ok", "a")])], "post int, expected array<struct<kind:string,verdict:string,words:array<string>>>, shown array<struct<kind:string,verdict:string,words:array<string>>>")
    by_words = evaluate.paired(rows, "words").orderBy("no").collect()
    assert [(r.got_kind, r.got, r.extra) for r in by_words] == [("quran", "ok", 0), ("hadith", "ok", 0)]
    by_kinds = evaluate.paired(rows, "kinds").orderBy("no").collect()
    assert sum(r.got is not None for r in by_kinds) == 1 and by_kinds[0].extra == 1
    words_ = spark.createDataFrame([(i, list("abcdef")) for i in range(40)], "k int, w array<string>")
    for r in evaluate.tampered(words_, "k", F.col("w"), ["x", "y"]).collect():
        assert len(r.altered) == {"replace": 6, "delete": 5, "insert": 7}[r.op] and r.altered[0] == "a" and r.altered[-1] == "f"


def test_vectors_with_ties_and_zeros(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [2.0, 0.0]), ("c", [2.0, 0.0]), ("d", [0.0, 0.0]), ("e", [0.0, 1.0])], "word string, vec array<double>")
    got = vectors.neighbours(v.where("word = 'a'"), v, top=2, block=2).orderBy("rank").collect()
    assert [(r.other, round(r.sim, 6)) for r in got] == [("b", 1.0), ("c", 1.0)]


def test_trained_vectors(spark):
    rows = spark.createDataFrame([(["a", "b", "c"],)] * 5, "words array<string>")
    got = files.trained_vectors(rows, size=4, epochs=1).collect()
    assert {r.word for r in got} == {"a", "b", "c"} and all(abs(sum(x * x for x in r.vec) - 1) < 1e-6 for r in got)


def test_plain_is_idempotent():
    for t in ("إن مع العسر يسرا", "وٱستعينوا بالصبر"):
        assert plain(plain(t)) == plain(t)


def test_every_query_runs(spark, sf_dir):
    import __spark_entry__

    queries = __spark_entry__.queries()
    assert __spark_entry__.entry(spark).schema
    for name in ("q_verify_documents", "q_card_label", "q_sampled_cases", "q_tampered"):
        assert queries[name](spark, sf_dir).count() >= 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_queries_match_their_sql(spark, sf_dir):
    duckdb = pytest.importorskip("duckdb")
    import glob

    import __spark_entry__

    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    queries = __spark_entry__.queries()

    def rows(frame):
        def value(x):
            if x is None or isinstance(x, float) and x != x:
                return None
            if isinstance(x, float):
                return round(x, 6)
            return [value(y) for y in x] if hasattr(x, "__len__") and not isinstance(x, str) else x

        return sorted(repr(tuple(value(x) for x in r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False, name=None))

    for name, sql in __spark_entry__.oracle_sql().items():
        got, expected = queries[name](spark, sf_dir).toPandas(), con.execute(sql).df()
        assert sorted(got.columns) == sorted(expected.columns), name
        assert rows(got) == rows(expected), name


def test_registered_functions(spark):
    from quoteverify.functions.register import register

    register(spark, spark.createDataFrame([(1, "قال ﷺ: «من غشنا فليس منا»")], "post int, text string"))
    r = spark.sql("SELECT normalize_text('إنّ') a, normalize_latin('It''s X') b, fuzz_ratio('abc', 'abd') c, partial_ratio('b', 'abc') d").head()
    assert (r.a, r.b, round(r.c, 3), r.d) == ("ان", "it s x", 66.667, 100.0)
    assert [x.text for x in spark.sql("SELECT * FROM pieces").collect()] == ["من غشنا فليس منا"]
    assert spark.sql("SELECT * FROM html_cards('<div class=hadith>a</div><div class=hadith-info></div>')").head().text == "a"


def test_images(spark):
    from quoteverify.sources import images

    def local(content):
        if content == b"broken":
            raise RuntimeError("no picture")
        return [[("واستعينوا", 90), ("بالصبر", 88), ("والصلاه", 20 if content == b"blurred" else 92)]]

    def model(content):
        if content == b"quota":
            raise RuntimeError("429 quota")
        return [[(w, None) for w in ("واستعينوا بالصبر والصلاه" if content == b"clear" else "نص مختلف تماما هنا").split()]]

    files_ = spark.createDataFrame([(k, bytearray(k.encode())) for k in ("clear", "blurred", "quota", "broken")], "digest string, content binary")
    vocab = spark.createDataFrame([(w,) for w in ("واستعينوا", "بالصبر", "والصلاه")], "word string")
    got = {r.digest: r for r in images.chosen(images.readings_of(files_, {"local": local, "model": model}), vocab, "local").collect()}
    assert (got["clear"].engine, got["clear"].problem) == ("local", None)
    assert got["blurred"].engine == "model" and got["broken"].engine == "model"
    assert (got["quota"].engine, got["quota"].problem) == ("local", "quota")


def test_lookup_with_a_default(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2)], "s int, a int")
    names = spark.createDataFrame([("1:1", "one")], "key string, value string")
    got = files.looked_up(rows, names, F.concat_ws(":", "s", "a"), "en", F.lit("")).orderBy("a").collect()
    assert [r.en for r in got] == ["one", ""]


def test_likely_words_leave_none_out():
    from quoteverify.functions.fuzzy import ratio

    draw = random.Random(3)
    words = ["".join(draw.choice("abcd") for _ in range(draw.randint(1, 9))) for _ in range(150)]
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    for w in words[:60]:
        like = {d for d in words if abs(len(d) - len(w)) <= 2 and ratio(w, d) >= 85}
        assert like <= set(search._likely(w, by_length, 2, 85))


def test_a_dead_source_rests_for_the_whole_process():
    from quoteverify.sources import external

    calls = []

    def dead(text):
        calls.append(text)
        raise OSError("down")

    for _ in range(3):  # as three tasks of one worker process
        assert external.shared_breaker(dead, 300, "test")("x") is None
    assert len(calls) == 1


def test_upper_median(spark):
    for n in (1, 2, 3, 4, 5, 10, 101):
        values = [random.Random(n).randint(0, 20) for _ in range(n)]
        got = spark.createDataFrame([(v,) for v in values], "v long").agg(evaluate.upper_median("v").alias("m")).head().m
        assert got == sorted(values)[n // 2]


def test_streams_match_batches(spark, sf_dir):
    import __spark_entry__

    queries = __spark_entry__.queries()
    key = lambda name: sorted(map(str, queries[name](spark, sf_dir).collect()))
    assert key("q_stream_carry") == key("q_conversation_carry")


def test_fragments_of_every_line(spark, tmp_path):
    import __spark_entry__

    passages = [(k, " ".join(f"{w}{'abcdefgh'[k]}" for w in ("stone", "river", "candle", "morning", "über"))) for k in range(4)]
    spark.createDataFrame(passages, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    turns = [(1, 0, f"{passages[0][1]}\n{passages[1][1]}"), (1, 1, f"\n{passages[2][1]}"), (2, 3, passages[3][1]), (3, 0, None), (3, 1, "")]
    spark.createDataFrame(turns, "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    rows = __spark_entry__.queries()["q_search_fragment"](spark, str(tmp_path)).where("rank = 1").collect()
    got = {(r.conv_id, r.turn, r.line): (r.item_id, r.words_found, r.words_asked) for r in rows}
    assert got == {(1, 0, 0): (0, 5, 5), (1, 0, 1): (1, 5, 5), (1, 1, 1): (2, 5, 5), (2, 3, 0): (3, 5, 5)} and len(rows) == 4


def test_greatest_similarity_meets_all_candidates(spark, tmp_path):
    """The nearest vectors have ids divisible by 100 too, and one label has no others."""
    import __spark_entry__

    draw = random.Random(9)
    rows = [(i, label, [draw.uniform(-1, 1) for _ in range(4)]) for i, label in [(k * 50, k % 3) for k in range(24)] + [(5000, 7), (5100, 7), (6000, 8)]]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    expected = {(l, i): max(cosine(v, w) for j, m, w in rows if m == l and j != i) for i, l, v in rows if i % 100 == 0 and l != 8}
    got = {(r.q, r.word): r.sim for r in __spark_entry__.queries()["q_max_similarity"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx(expected, abs=1e-6) and (7, 5000) in got
