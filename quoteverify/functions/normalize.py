"""Text normalisation as Column expressions, with profiles for Arabic and for Latin scripts.

Everything stays in the JVM. ``plain`` is the same Arabic normalisation on a Python string, for the functions that walk
a post word by word; a test holds the two against each other.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C

_GAP = f"({C.OPEN_TANWEEN})\\s+(?=[اى](?:[^{C.LETTERS}ٱ]|$))"
_ORPHAN = f"{C.OPEN_TANWEEN}(?=[^اى{C.LETTERS}]|$)"
_LONE_WAW = f"(?:^|(?<= ))و (?=[{C.LETTERS}])"
_FROM, _TO = "".join(C.LETTER_MAP), "".join(C.LETTER_MAP.values())
assert len(_FROM) == len(_TO)


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once for each row; a column named inside a lambda is computed anew for each element,
    and one named twice often twice."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def replace_all(text: Column, pattern: str, by: str = "") -> Column:
    """regexp_replace with Unicode classes, as the patterns mean them."""
    return F.regexp_replace(text, F.lit(f"(?U){pattern}"), F.lit(by))


def glue_tanween(text: Column) -> Column:
    return replace_all(text, _GAP, "$1")


def normalize(text: Column, profile: str = "arabic", uthmani: bool = False) -> Column:
    """The plain form in which texts are compared. ``uthmani``: a dagger alif stands for a written alif."""
    if profile == "latin":
        return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "))
    text = glue_tanween(text)
    if uthmani:
        text = replace_all(F.replace(text, F.lit(C.DAGGER_ALIF), F.lit("ا")), _ORPHAN, f"{C.OPEN_TANWEEN}ا")
    text = F.translate(replace_all(text, f"[{C.DIACRITICS}]"), _FROM, _TO)
    text = F.trim(replace_all(replace_all(text, rf"[^{C.LETTERS}\s]", " "), r"\s+", " "))
    return replace_all(text, _LONE_WAW, "و")


def words(normal: Column) -> Column:
    """The words of a normalised text; none for an empty or null one."""
    return F.filter(F.split(F.coalesce(normal, F.lit("")), " "), lambda w: w != "")


def strip_marks(text: Column) -> Column:
    return replace_all(text, f"[{C.MARKS}]")


def glued_tokens(text: Column, profile: str = "arabic") -> Column:
    """White-space tokens that hold at least one word."""
    return F.filter(F.split(glue_tanween(text), r"(?U)\s+"), lambda t: normalize(t, profile) != "")


def bare(word: Column) -> Column:
    """A word without its attached particles, taken off one after the other as long as enough letters are left."""
    for particle in ("^[وف](?=.{3})", "^[بلك](?=ال.{2})", "^(?:ال|لل)(?=.{3})"):
        word = F.regexp_replace(word, particle, "")
    return word


def with_particles(word: Column) -> Column:
    """The word and its forms with particles before it."""
    put = lambda p, w=word: F.concat(F.lit(p), w)
    rest = word.substr(F.lit(3), F.length(word))
    definite = F.array(word, put("و"), put("ف"), put("ب"), put("وب"), put("ك"), put("لل", rest), put("ولل", rest))
    return F.when(F.startswith(word, F.lit("ال")), definite).otherwise(F.array(word, put("و"), put("ف"), put("ب"), put("ل")))


def canonical_typing(post: Column) -> Column:
    """Typing variants undone that would hide how a post presents a text; marks inside quotes stay."""
    post = F.translate(post, "".join(C.PERSIAN_MAP), "".join(C.PERSIAN_MAP.values()))
    post = F.replace(post, F.lit("ـ"), F.lit(""))
    post = replace_all(post, C.NAME_WITH_MARKS, "الله")
    post = replace_all(replace_all(post, C.SALLA, "صلى"), C.WA_SALLAM, " وسلم")
    return replace_all(post, C.NEXT_INTRO, "$1\n")


def quoted_core(text: Column) -> Column:
    """The words in double quotes of a long narration (those of over 15 characters), else the whole text."""
    straight = F.translate(text, "“”", '""')
    found = F.filter(F.regexp_extract_all(straight, F.lit('(?U)"‏?\\s*(.+?)\\s*‏?"'), F.lit(1)), lambda q: F.length(q) > 15)
    return F.when(F.size(found) > 0, F.array_join(found, " … ")).otherwise(text)


def mend_salutation(post: Column) -> Column:
    """Salutations that an image reading garbles."""
    post = replace_all(post, C.SALLAM_MISREAD, "وسلم")
    post = replace_all(post, C.NABI_MISREAD, "$1النبي")
    return replace_all(post, C.SAW_MISREAD, "$1 ﷺ")


def arabic_word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[{C.LETTERS}]{{2,}}"))


# The same on Python strings ------------------------------------------------------------------------------------------

_PLAIN = [(re.compile(p), by) for p, by in ((f"[{C.DIACRITICS}]", ""),)]
_TABLE = str.maketrans(C.LETTER_MAP)


def plain(text: str, uthmani: bool = False) -> str:
    """``normalize`` with the Arabic profile, for one string."""
    text = re.sub(_GAP, r"\1", text)
    if uthmani:
        text = re.sub(_ORPHAN, f"{C.OPEN_TANWEEN}ا", text.replace(C.DAGGER_ALIF, "ا"))
    for pattern, by in _PLAIN:
        text = pattern.sub(by, text)
    return re.sub(_LONE_WAW, "و", " ".join(re.sub(rf"[^{C.LETTERS}\s]", " ", text.translate(_TABLE)).split()))


def plain_latin(text: str) -> str:
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


STOP_WORDS = tuple(dict.fromkeys(plain(C.STOP_TEXT).split()))
FORMULA = frozenset(C.FORMULA_TEXT.split())
INTRO_ONLY = FORMULA | frozenset(C.INTRO_TEXT.split())
