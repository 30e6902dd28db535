"""Work that grows with the text, not with its square."""

import time

from pyspark.sql import functions as F

from quoteverify.operators import readings, verdict


def seconds(frame) -> float:
    frame.write.format("noop").mode("overwrite").save()
    begun = time.time()
    frame.write.format("noop").mode("overwrite").save()
    return time.time() - begun


def test_shared_words_of_a_long_text(spark):
    """The passage's words are made once, not for each word of the text."""
    long = "".join(f"{a}{b}{c}ت " for a in "بتثجح" for b in "دذرزس" for c in "شصضطظ") * 400
    rows = spark.createDataFrame([(long, "قال " * 4000 + "بدشت", False), ("بدشت تدشت بدشت ثدشت الله", "بدشت تدشت", True), ("بدشت", "بدشت", False), (None, "بدشت", False), ("بدشت تدشت", None, False)], "text string, passage string, expected boolean").coalesce(1)
    found = rows.select(verdict.shares_most_words(F.col("text"), F.col("passage")).alias("shares"), "expected")
    assert seconds(found.select("shares")) < 20
    assert all(r["shares"] == r["expected"] for r in found.collect())


def test_an_answer_of_many_lines(spark):
    """The lines are made once, not for each line."""
    lines = ["بدشت تدشت", "ثدشت.", "جدشت"]
    rows = spark.createDataFrame([("```text\n" + "\n".join(lines * 1500) + "\n```", "\n".join(["بدشت تدشت ثدشت."] + ["جدشت بدشت تدشت ثدشت."] * 1499 + ["جدشت"])), ("```\n\n```", ""), (None, None)], "text string, expected string").coalesce(1)
    found = rows.select(readings.tidied(F.col("text")).alias("tidy"), "expected")
    assert seconds(found.select("tidy")) < 3
    assert all(r["tidy"] == r["expected"] for r in found.collect())


def test_parts_at_the_ends_of_a_window_cost_one_pass(monkeypatch):
    from quoteverify.functions import fuzzy

    calls, plain = [], fuzzy.ratio
    monkeypatch.setattr(fuzzy, "ratio", lambda a, b: calls.append(1) or plain(a, b))
    a, b = "the quick brown fox jumps over it " * 4, "a lazy dog that sleeps under trees " * 6
    cuts = [*(b[s : s + len(a)] for s in range(len(b) - len(a) + 1)), *(b[:k] for k in range(1, len(a))), *(b[-k:] for k in range(1, len(a)))]
    assert fuzzy.partial_ratio(a, b) == max(plain(a, x) for x in cuts)
    assert len(calls) <= 2


def test_blocks_of_fragments_are_summed_as_plainly(monkeypatch):
    """The places of a word are met by blocks of fragments, a bounded number of sums at once."""
    import random

    import pyarrow as pa

    from quoteverify.operators import locate

    draw = random.Random(3)
    posts = {f"w{i}": {p: draw.choice((1.0, 0.8)) for p in draw.sample(range(100, 130), 6)} for i in range(12)}
    lines = {f"q{i}": draw.sample([*posts, "x", "y"], draw.randint(1, 8)) for i in range(40)}
    expected = set()
    for q, ws in lines.items():
        sums = {}
        for w in ws:
            for p, score in posts.get(w, {}).items():
                sums[p] = round(sums.get(p, 0) + score, 6)
        expected |= {(q, p, s) for p, s in sums.items() if s >= max(sums.values()) - 0.5}
    asked = pa.table({"q": list(lines), "ws": list(lines.values())})
    there = pa.table({"word": list(posts), "passages": pa.array([list(x) for x in posts.values()], pa.list_(pa.int64())), "scores": [list(x.values()) for x in posts.values()]})
    for bound in (1, 50, 1 << 20):
        monkeypatch.setattr(locate, "SUMS", bound)
        got = locate._summed(asked, there).to_pylist()
        assert {(r["q"], r["passage"], r["quality"]) for r in got} == expected and len(got) == len(expected)
    assert locate._summed(asked, there.slice(0, 0)).num_rows == 0


def test_pieces_checked_in_slices(spark, monkeypatch):
    """Slices of pieces give what one go gives, and leave no shuffle files behind."""
    from quoteverify.operators import locate
    from quoteverify.operators.index import Corpus

    verses = spark.createDataFrame([(0, 1, 1, "one two three four five"), (0, 1, 2, "six seven eight nine ten"), (0, 2, 1, "one two six seven zero")], "layer int, chapter int, verse int, text string")
    pieces = spark.createDataFrame([("a", "two three four"), ("b", "four five six seven"), ("c", "one two"), ("d", "six seven nine ten"), ("e", "x y z q"), ("f", None)], "piece string, text string")
    corpus = Corpus.build(verses, "latin", axis=F.col("chapter"))
    whole = {r["piece"]: r for r in locate.check(pieces, corpus).collect()}
    monkeypatch.setattr(locate, "SLICE", 2)
    local = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {n for n in local.getAllFiles().mkString("\n").split("\n") if "shuffle_" in n}
    before = shuffles()
    sliced = locate.check(pieces, corpus)
    assert shuffles() <= before
    assert {r["piece"]: r for r in sliced.collect()} == whole and len(whole) == 6


def test_a_carried_corpus_gives_what_shuffles_give(spark, monkeypatch):
    """A small corpus is searched where the pieces are, without a shuffle, and says the same as the joins."""
    import random

    from quoteverify.operators import locate
    from quoteverify.operators.index import Corpus

    rng = random.Random(5)
    some = lambda n, of: " ".join(f"w{'abcdefghijklmnopqrstuvwxyzäöüß'[min(rng.randrange(of), rng.randrange(of))]}" for _ in range(n))
    verses = [(layer, c, v, some(rng.randrange(1, 30), 26)) for layer in (0, 1) for c in range(1, 12) for v in range(1, 5)]
    verses += [(0, 20, 1, "lone rare words here"), (1, 20, 1, "lone rare, words there")]
    pieces = [(f"p{k}", some(rng.randrange(0, 14), 30)) for k in range(300)]
    for k in range(300):
        w = rng.choice(verses)[3].split() + rng.choice(verses)[3].split()
        at = rng.randrange(len(w))
        w = w[at : at + rng.randrange(2, 16)]
        if k % 3:
            w[rng.randrange(len(w))] = rng.choice(["wa", "we", "wzq", ""])
        pieces.append((f"q{k}", " ".join(w)))
    pieces += [("r0", None), ("r1", ""), ("r2", " . "), ("r3", "rare lone here words"), ("r4", "zz rare yy lone"), ("r5", "WA, wa wa!"), ("r6", "wé wé wé")]
    frame = spark.createDataFrame(pieces, "piece string, text string")
    rows = spark.createDataFrame(verses, "layer int, chapter int, verse int, text string")
    for axis in (F.col("chapter"), None):
        corpus = Corpus.build(rows, "latin", layers={0: False, 1: False}, axis=axis)
        carried = locate.check(frame, corpus)
        assert "Exchange" not in carried._jdf.queryExecution().executedPlan().toString()
        got = {r["piece"]: r for r in carried.collect()}
        with monkeypatch.context() as small:
            small.setattr(locate, "CARRIED", 0)
            expected = {r["piece"]: r for r in locate.check(frame, corpus).collect()}
        assert got == expected and len(got) == len(pieces)
        assert {"verified", "altered", "not_found", "too_short"} == {r["status"] for r in got.values()}
        with monkeypatch.context() as few:
            few.setattr(locate, "MARKS", 64)
            assert {r["piece"]: r for r in locate.check(frame, corpus).collect()} == expected
        assert carried.schema == locate.check(frame.limit(0), corpus).schema and locate.check(frame.limit(0), corpus).count() == 0


def test_a_fragment_on_several_rows_is_one_fragment(spark):
    from quoteverify.operators import locate
    from quoteverify.operators.index import Corpus

    verses = spark.createDataFrame([(0, 1, 1, "one two three four five"), (0, 1, 2, "six seven eight nine ten")], "layer int, chapter int, verse int, text string")
    asked = spark.createDataFrame([("a", "one two"), ("a", "two three"), ("b", "nine"), ("c", "")], "q string, text string")
    found = locate.search_fragment(asked, Corpus.build(verses, "latin", axis=F.col("chapter")), top=1).collect()
    assert {(r["q"], r["verse"], r["words_found"], r["words_asked"]) for r in found} == {("a", 1, 3.0, 3), ("b", 2, 1.0, 1)} and len(found) == 2


def test_partial_ratios_of_many_pairs_at_once(monkeypatch):
    """Pairs that are met together have the ratios that each has alone, without a pass for each window."""
    import random

    from quoteverify.functions import fuzzy

    draw = random.Random(5)
    text = lambda n: "".join(draw.choice("abcdé ") for _ in range(n))
    pairs = [(text(draw.choice((0, 1, 2, 7, 7, 30, 63, 64, 65, 90))), text(draw.choice((0, 1, 7, 30, 64, 66, 200)))) for _ in range(400)]
    expected = [fuzzy.partial_ratio(a, b) for a, b in pairs]
    for bound in (1, 1000, 1 << 15):
        monkeypatch.setattr(fuzzy, "WINDOWS", bound)
        assert fuzzy.partial_ratios([None, *pairs]) == [None, *expected]
    calls, plain = [], fuzzy.common_length
    monkeypatch.setattr(fuzzy, "common_length", lambda a, b: calls.append(1) or plain(a, b))
    fuzzy.partial_ratios([("the quick brown fox jumps", "a lazy dog sleeps under trees " * 5)] * 100)
    assert not calls


def test_near_words_are_told_apart_by_letters(spark, monkeypatch):
    """Words a letter or two off are met, and no others, whether the vocabulary goes to all tasks or not; distances are asked
    only of words whose letters allow it."""
    import itertools

    from quoteverify.operators import locate

    known = ["".join(x) for x in itertools.product("ab", "cd", "ef", "gh", "éi", "kl", "mn")] + ["ab", "abc", "abcd", "الله"]
    asked = ["acegékm", "cegékm", "acegékmxy", "bdfhiln", "xyacegé", "abd", "ab", "acegék", "acxgékm", "caegékm", "اله", "q"]
    rows = lambda ws: spark.createDataFrame([(w,) for w in ws], "word string")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            left, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
        return row[-1]

    allowed = lambda w: 0 if len(w) < 3 else 1 if len(w) <= 5 else 2
    expected = {(w, v, 1.0 if w == v else 0.8) for w in asked for v in known if distance(w, v) <= allowed(w)}
    for bound in (0, 50_000):
        monkeypatch.setattr(locate, "LISTED", bound)
        found = locate.near_words(rows(asked), rows(known))
        assert sorted(map(tuple, found.collect())) == sorted(expected)
        assert "bit_count" in found._jdf.queryExecution().optimizedPlan().toString()


def test_verbatim_pieces_meet_their_rarest_pair_alone(spark, monkeypatch):
    """Pieces that stand in the corpus get what the vote gives them, and none goes to the vote: frequent pairs bring no places."""
    from quoteverify.operators import locate
    from quoteverify.operators.index import Corpus

    verses = [(0, c, v, "of the sea of the w of the of the w x") for c in range(1, 13) for v in range(1, 4)] + [(1, 1, 1, "of the moon and stars")]
    corpus = Corpus.build(spark.createDataFrame(verses, "layer int, chapter int, verse int, text string"), "latin", layers={0: False, 1: False}, axis=F.col("chapter"))
    pieces = {"a": "of the w of the", "b": "of the of the", "c": "the w x of the sea", "d": "of the", "f": "of the of the", "g": "THE sea, of the!"}
    for k in range(1, 4):
        pieces[f"h{k}"] = "the sea of the"
    whole = lambda rows: {r["piece"]: r for r in rows.collect()}
    frame = lambda texts: spark.createDataFrame(list(texts.items()), "piece string, text string")
    others = {"e": "of the moon and stars", "i": "sea of a w of", "j": "nothing like it here", "k": None, "l": "the sea of sea the of"}
    with monkeypatch.context() as plain:
        plain.setattr(locate, "verbatim", lambda asked, corpus: asked.limit(0).selectExpr("piece", "1.0D AS share", "layer", "'' AS axis", f"CAST(null AS {locate.ALIGNED}) AS a"))
        expected = whole(locate.check(frame(pieces | others), corpus))
    assert expected["a"]["status"] == expected["f"]["status"] == "verified" and expected["i"]["status"] == "altered"
    assert whole(locate.check(frame(pieces | others), corpus)) == expected and len(expected) == len(pieces | others)
    voted = []
    monkeypatch.setattr(locate, "candidate_starts", lambda *a: voted.append(a))
    assert whole(locate.check(frame(pieces), corpus)) == {k: expected[k] for k in pieces}
    assert not voted
