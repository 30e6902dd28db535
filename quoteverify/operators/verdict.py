"""Gradings, ratings and verdicts as CASE expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quoteverify.functions import constants as C
from quoteverify.functions.normalize import normalize, once, plain, words


def has_any(text: Column, parts) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(p)) for p in parts))


def grade_rating(label: Column) -> Column:
    """ok, warn or bad from a grading's own words; a denial outweighs the rest."""
    low = F.lower(F.coalesce(label, F.lit("")))
    return F.when(has_any(low, C.GRADE_BAD), "bad").when(has_any(low, C.GRADE_WARN), "warn").when(has_any(low, C.GRADE_OK), "ok").otherwise("warn")


def external_rating(grade: Column) -> Column:
    """The same for an external source's Arabic grading, whose denials hold the words of acceptance."""
    normal = normalize(F.coalesce(grade, F.lit("")))
    return F.when(has_any(normal, [plain(d) for d in C.DENIED]), "bad").when(has_any(normal, C.ACCEPTED), "ok").otherwise("warn")


def scholars_differ(ratings: Column) -> Column:
    return F.size(F.array_except(F.array_distinct(ratings), F.array(F.lit("warn")))) > 1


def external_verdict(ratings: Column) -> Column:
    """What external gradings of the same wording come to; without one the claim is not established."""
    kinds = F.array_distinct(F.coalesce(ratings, F.array().cast("array<string>")))
    has = lambda x: F.array_contains(kinds, x)
    return F.when(F.size(kinds) == 0, "bad").when((F.size(kinds) == 1) & has("ok"), "ok").when(~has("ok") & has("bad"), "bad").otherwise("warn")


def verdict(kind: Column, misattributed: Column, quote_status: Column, from_image: Column, reading_slip: Column, saying_status: Column, saying_rating: Column, reading_doubtful: Column, external: Column) -> Column:
    """ok, warn, bad or neutral; the first case that holds decides."""
    quote, saying = kind == "quran", kind == "hadith"
    return (
        F.when(misattributed == "hadith_as_quran", "bad")
        .when(misattributed == "quran_as_hadith", "warn")
        .when(quote & (quote_status == "verified"), "ok")
        .when(quote & (quote_status == "not_found"), F.when(from_image, "warn").otherwise("bad"))
        .when(quote, F.when(reading_slip, "warn").otherwise("bad"))
        .when(saying & (saying_status == "found"), saying_rating)
        .when(saying & reading_doubtful, "warn")
        .when(saying & (saying_status == "similar"), F.when(saying_rating == "bad", "bad").otherwise("warn"))
        .when(saying, external_verdict(external))
        .otherwise("neutral")
    )


def misattribution(is_quote: Column, is_saying: Column, marked: Column, as_quran: Column, quote_status: Column, saying_status: Column, says_so: Column) -> Column:
    """A verse presented as a saying, or a saying presented as a verse (unless it says that God speaks)."""
    return F.when(is_quote & marked & ~as_quran & (quote_status == "verified"), "quran_as_hadith").when(is_saying & as_quran & ~marked & saying_status.isin("found", "similar") & ~F.coalesce(says_so, F.lit(False)), "hadith_as_quran").otherwise("")


def says_god_speaks(text: Column) -> Column:
    return F.rlike(normalize(text), F.lit(C.QUDSI))


def shares_most_words(text: Column, passage: Column) -> Column:
    """At least two words that carry meaning, and three in five of them stand in the passage; repeated words count."""
    kept = F.filter(words(normalize(text)), lambda w: (F.length(w) >= 3) & ~w.isin(*C.COMMON_WORDS))
    found = lambda s: F.filter(s["kept"], lambda w: F.array_contains(s["both"], w))
    both = lambda s: F.struct(s["kept"].alias("kept"), F.array_intersect(s["kept"], s["there"]).alias("both"))
    shares = lambda s: (F.size(s["kept"]) >= 2) & (F.size(found(s)) >= 0.6 * F.size(s["kept"]))
    return once(F.struct(kept.alias("kept"), words(normalize(passage)).alias("there")), lambda s: once(both(s), shares))


def reading_slip(from_image: Column, differences: Column, text: Column, correct_text: Column, uncertain: Column) -> Column:
    """Every difference can be the image reading's fault: a word nearly right, read unsurely, or read in another place."""
    verse = words(normalize(F.coalesce(correct_text, F.lit("")), uthmani=True))
    read = F.array_union(words(normalize(text)), words(normalize(text, uthmani=True)))
    unsure = lambda w: F.array_contains(uncertain, w)
    spelled = lambda ws, uthmani=False: F.transform(F.filter(F.split(ws, r"(?U)\s+"), lambda w: w != ""), lambda w: normalize(w, uthmani=uthmani))

    def explained(d: Column) -> Column:
        written, correct = spelled(d["written"]), spelled(d["correct"], True)
        near = lambda a, b: F.levenshtein(a, b) <= F.when(F.length(b) <= 5, 1).otherwise(2)
        from_verse = F.forall(written, lambda w: unsure(w) | F.array_contains(verse, w))
        pairs = F.forall(F.zip_with(written, correct, lambda a, b: unsure(a) | near(a, b)), lambda x: x)
        same_letters = F.array_join(written, "") == F.array_join(correct, "")
        replaced = same_letters | F.when(F.size(written) == F.size(correct), pairs).otherwise(from_verse)
        missing = (F.size(uncertain) > 0) | F.forall(correct, lambda w: F.array_contains(read, w))
        return F.when(d["kind"] == "replace", replaced).when(d["kind"] == "extra", from_verse).otherwise(missing)

    return from_image & (F.size(differences) > 0) & F.forall(differences, explained)


def reading_doubtful(from_image: Column, text: Column, uncertain: Column, top_score: Column, top_text: Column) -> Column:
    """A saying that was not found may have been misread: many words unsure, or a word that is a letter off, or two words
    in one, of the closest text."""
    read, top = words(normalize(text)), words(normalize(F.coalesce(top_text, F.lit(""))))
    many = (F.size(uncertain) > 0) & (F.size(read) > 0) & (F.size(F.filter(read, lambda w: F.array_contains(uncertain, w))) >= C.DOUBT_SHARE * F.size(read))
    glued = F.transform(F.when(F.size(top) > 1, F.sequence(F.lit(1), F.size(top) - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.get(top, i - 1), F.get(top, i)))
    odd = lambda w: (F.length(w) >= C.DOUBT_LENGTH) & ~F.array_contains(top, w) & (F.array_contains(glued, w) | F.exists(top, lambda t: (F.abs(F.length(t) - F.length(w)) <= 1) & (F.levenshtein(w, t) == 1)))
    return from_image & (many | (F.coalesce(top_score >= C.DOUBT_SCORE, F.lit(False)) & F.exists(read, odd)))


def card_label(kind: Column, verdict_: Column, misattributed: Column, quote_status: Column) -> Column:
    """The heading of a result."""
    label = F.when(misattributed == "hadith_as_quran", C.LABEL_SAYING_AS_VERSE).when(misattributed == "quran_as_hadith", C.LABEL_VERSE_AS_SAYING)
    label = label.when((kind == "quran") & (quote_status == "not_found"), F.when(verdict_ == "bad", C.LABEL_NO_VERSE).otherwise(C.LABEL_CHECK_READING))
    for (k, v), text in C.CARD_LABELS.items():
        label = label.when((kind == k) & (verdict_ == v), text)
    return label


def escape_html(text: Column) -> Column:
    for sign, by in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(sign), F.lit(by))
    return text
