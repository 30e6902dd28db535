"""Word lists, patterns and thresholds that results depend on. They are data, stated as they are."""

# --- fixed values: Arabic writing ---------------------------------------------------------------------------------
DIACRITICS = "\u0610-\u061a\u064b-\u065f\u0670\u06d6-\u06ed\u0640\u08d3-\u08ff"
MARKS = "\u064b-\u065f\u0670\u06d6-\u06ed"
LETTERS = "ء-ي"
OPEN_TANWEEN = "\u08f0"
DAGGER_ALIF = "\u0670"
LETTER_MAP = {"إ": "ا", "أ": "ا", "آ": "ا", "ٱ": "ا", "ى": "ي", "ئ": "ي", "ؤ": "و", "ة": "ه", "ی": "ي", "ې": "ي", "ک": "ك", "ہ": "ه", "ۃ": "ه", "ە": "ه"}
PERSIAN_MAP = {"ی": "ي", "ې": "ي", "ک": "ك", "ہ": "ه", "ۃ": "ة", "ە": "ه"}

# --- fixed values: words ------------------------------------------------------------------------------------------
STOP_TEXT = "في من على الى عن ان لا ما قال الله عليه وسلم رسول النبي و ثم او هو هي كان قد لم لن اذا هذا ذلك التي الذي حدثنا اخبرنا حدثني عن ابي ابن بن"
FORMULA_TEXT = "صلي الله عليه وسلم رضي عنه عنها عنهما عنهم تعالي سبحانه وتعالي عز وجل الصلاه والسلام"
INTRO_TEXT = "قال يقول رسول النبي عن ان انه وقال"
COMMON_WORDS = ("الله", "الذي", "التي", "الذين", "على", "الي", "عن", "في", "من", "ما", "لا", "ان")
DENIED = ("ليس بصحيح", "ليس صحيح", "غير صحيح", "لا يصح", "لم يصح", "لا يثبت", "لم يثبت", "ليس بحديث", "ليس حديث", "لا اصل", "ليس له اصل", "موضوع", "باطل", "ضعيف", "منكر", "كذب", "مكذوب", "لا يعرف")
ACCEPTED = ("صحيح", "حسن")

# --- fixed values: gradings ---------------------------------------------------------------------------------------
GRADE_BAD = ("daif", "mawdu", "munkar", "shadh", "malool")
GRADE_WARN = ("maqtu", "muquf", "mauquf", "mursal")
GRADE_OK = ("sahih", "hasan")
GRADE_LABELS = {
    "Sahih": "صحيح", "Hasan": "حسن", "Hasan Sahih": "حسن صحيح", "Daif": "ضعيف", "Very Daif": "ضعيف جداً", "Mawdu": "موضوع", "Munkar": "منكر", "Shadh": "شاذ",
    "Sahih Isnaad": "صحيح الإسناد", "Daif Isnaad": "ضعيف الإسناد", "Hasan Isnaad": "حسن الإسناد", "Very Daif Isnaad": "ضعيف الإسناد جداً", "Sahih Hadith": "صحيح", "Sahih Mutawatir": "صحيح متواتر",
    "Sahih Lighairihi": "صحيح لغيره", "Sahih Matn": "صحيح المتن", "Hasan Sahih Isnaad": "حسن صحيح الإسناد", "Sahih Maqtu": "صحيح مقطوع", "Sahih Muquf": "صحيح موقوف", "Sahih Isnaad Maqtu": "صحيح الإسناد مقطوع",
    "Sahih Isnaad Mauquf": "صحيح الإسناد موقوف", "Sahih Isnaad Mursal": "صحيح الإسناد مرسل", "Hasan Maqtu": "حسن مقطوع", "Daif Maqtu": "ضعيف مقطوع", "Daif Muquf": "ضعيف موقوف",
    "Daif Isnaad Maqtu": "ضعيف الإسناد مقطوع", "Daif Munkar": "ضعيف منكر", "Munkar Daif": "منكر ضعيف", "Maqtu": "مقطوع", "Mursal": "مرسل", "Sanad Daif": "ضعيف السند", "Isnaad Malool": "معلول الإسناد",
}
TRUSTED_GRADE, TRUSTED_GRADER = "صحيح", "بإجماع الأمة على صحة ما في الصحيحين"
GRADER_SOURCE, GRADER_NAME, UNGRADED = "Al-Albani", "الألباني", "غير محكوم عليه في البيانات"
BOOKS = {"bukhari": "صحيح البخاري", "muslim": "صحيح مسلم", "abudawud": "سنن أبي داود", "tirmidhi": "جامع الترمذي", "nasai": "سنن النسائي", "ibnmajah": "سنن ابن ماجه"}
TRUSTED_BOOKS = ("bukhari", "muslim")
CARD_FIELDS = {"الراوي": "narrator", "المحدث": "scholar", "المصدر": "source", "الصفحة أو الرقم": "number", "خلاصة حكم المحدث": "grade"}

# --- fixed values: how a post presents a text ---------------------------------------------------------------------
GLORY = r"(?:تعال[ىيلا]{0,2}|سبحانه(?:\s+وتعالى)?|عز\s+وجل|جل\s+وعلا|جل\s+جلاله)"
QURAN_INTRO = r"^(?:و)?(?:قال|يقول|قوله)\s+(?:(?:الله|ربنا|الحق|المولى)(?:\s+" + GLORY + r")?|" + GLORY + r")\s*[:：]?\s*"
QURAN_SAID = r"(?<![ء-ي])و?(?:قال|يقول|قوله)\s+(?:(?:الله|ربنا|الحق|المولى)(?![ء-ي])|" + GLORY + r")"
HADITH_INTRO = (
    r"^(?:و)?(?:عن\s+\S+(?:\s+\S+)?\s+(?:رضي\s+الله\s+عنه(?:ا|ما|م)?\s+)?(?:قال|أن|ان)\s+)?"
    r"(?:قال|يقول|أن|ان)\s+(?:رسول\s+الله|النبي(?![ء-ي])|المصطفى|الحبيب)\s*"
    r"(?:ﷺ|صلى\s+الله\s+عليه\s+وسلم|عليه\s+الصلاة\s+والسلام)?\s*[:：]?\s*"
)
HADITH_LEAD = r"^.*(?:ﷺ|صلى\s+الله\s+عليه\s+وسلم|عليه\s+الصلاة\s+والسلام|رسول\s+الله|النبي(?![ء-ي]))\s*(?:أنه\s+)?(?:قال|يقول)?\s*:?\s*"
PROPHET = r"(?:ﷺ|صلى\s+الله\s+عليه\s+وسلم|رسول\s+الله|النبي(?![ء-ي])|المصطفى|عليه\s+الصلاة\s+والسلام)"
HADITH_MARKERS = r"(?:قال|يقول|قوله|عن|حديث|ان|أن)\b[^.\n]{0,40}?" + PROPHET + r"|" + PROPHET + r"\s*(?:قال|:)|(?:ال)?حديث\s+(?:ال)?قدسي"
PIECE_BREAK = r"[\n.!؟?؛]+"
QUOTED = r"[«\"“﴿{(]\s*(.+?)\s*[»\"”﴾})]"
SOURCE_LINE = r"^(?:رواه|أخرجه|اخرجه|متفق عليه|الراوي|المحدث|المصدر|الصفحة أو الرقم|خلاصة حكم المحدث|(?:صحيح|سنن|جامع|مسند|موطأ)\s+\S+\s*[:،]?\s*(?:رقم\s*)?[0-9٠-٩]*\s*$)"
EDGE_SIGNS = "«»\"“”﴿﴾{}()[]:-–— \t*•"
VERSE_NUMBER = r"[﴿(\[{]\s*[0-9٠-٩۰-۹]+\s*[﴾)\]}]"
FORMULA_IN_BRACKETS = (
    r"[(\[]?\s*(?:صل[ىي]?|رضي?)\s+\S+\s+(?:عليه(?:\s+وس\S*)?|عنه(?:ما|م|ا)?)\s*[)\]]"
    r"|[(\[]\s*(?:صل[ىي]?|رضي?)\s+\S+\s+(?:عليه(?:\s+وس\S*)?|عنه(?:ما|م|ا)?)\s*[)\]]?"
    r"|(?<=\s)الله\s+عنه(?:ما|م|ا)?\s*[)\]]"
)
TRAILING_SOURCE = r"\s+[(\[]?\s*(?:رواه|أخرجه|اخرجه|متفق\s+عليه)(?:\s+[^\s()]+){0,5}\s*[)\]]?\s*$"
LONE_ALIF = "^[اى][\u064b-\u0652\u06d6-\u06ed]*\\s+"
BARE_LEADS = (("قال",), ("يقول",), ("أنه", "قال"))
QUDSI = r"(?:قال|يقول) (?:الله|ربكم|ربك|ربه|ربنا)"

# --- fixed values: typing variants and misreadings ----------------------------------------------------------------
NAME_WITH_MARKS = "ا[\u064b-\u0652]*ل[\u064b-\u0652]*ل[\u064b-\u0652]*ه"
SALLA = r"\bصل[يى]?(?=\s+الله\s+عليه)"
WA_SALLAM = r"(?<=عليه)\s+و\s+سلم"
NEXT_INTRO = (
    r"([»﴾”\"]|\(\s*متفق\s+عليه\s*\)|(?<![ء-ي])(?:رواه|أخرجه)\s+(?:الإمام\s+)?[ء-ي]+(?:\s+و[ء-ي]+)?)"
    r"(?:[^\S\n]|[^\w\s«»﴿﴾\"“”()])+(?=و?(?:قال|يقول|عن)\s)"
)
INTRO_WORD = r"((?:قال|يقول)(?:\s+الله)?\s+)(\S{4,6})(?=\s*[:：؛]|\s+[﴿«(\[])"
INTRO_RIGHT = ("تعالى", "سبحانه")
SAW_MISREAD = (
    r"((?:^|\s)(?:قال|رسول\s+الل[هة]?|النبي|الني|الي))\s+(?!(?:له|لهم|لها|لي|لنا|لكم|لك|كلا|كلها|كله)\s*[:«\"(])"
    r"[كل](?:[ً-ْ]*[ء-ي0-9]){0,2}[ً-ْ]*(?=\s*[:«\"(])"
)
SALLAM_MISREAD = r"(?<=الله عليه )وس[ء-ي]{0,2}(?![ء-ي])"
NABI_MISREAD = r"(?<![ء-ي])((?:قال|عن|أن|ان) )ال[ن]?ي(?=\s)"

# --- fixed values: image readings ---------------------------------------------------------------------------------
READING_JUNK = r"[0-9A-Za-z٠-٩\[\]<>|{}#*+=%$@]"
OPEN_AS_HASH, CLOSE_AS_DIGIT = "(?<!\\S)#(?=[ء-ي])", "(?<=[ء-ي]{3})[4#](?=\\s|$)"
NEW_ITEM = r"^(?:و?(?:قال|يقول|عن)\s|رواه\s|متفق عليه|[«﴿])"
LINE_END = r"[.!؟?»)\]﴾}:؛]\s*$"
KEPT_SIGNS = "«»\"“”﴿﴾():.،؟!ﷺ"
GLUED_SIGN = r"^([#(\[«﴿]*[إؤ]|[#(\[«﴿]+)(?=[ء-ي])"
LATIN_WORD, CODE_FENCE = r"(?<!\S)\S*[A-Za-z]\S*(?!\S)", r"^```\w*\s*|\s*```$"
WORD_CONFIDENCE, MIN_CONFIDENCE, MAX_UNCERTAIN_SHARE = 70, 45, 0.4
QUOTA_SIGNS = ("429", "resource_exhausted", "quota", "rate limit")
BUSY_SIGNS = ("503", "500", "529", "502", "unavailable", "overloaded", "internal", "deadline", "timed out", "timeout", "connection")
MISSING_SIGNS = ("404", "not found", "not supported")

# --- fixed values: thresholds -------------------------------------------------------------------------------------
MIN_WORDS, MIN_RATIO, TOP_STARTS, SLACK, FALLBACK_DF = 3, 0.5, 8, 4, 50
ROUTER_RATIO, ROUTER_MIN_WORDS, UNMARKED_RATIO, UNMARKED_RUN, IMAGE_RATIO = 0.6, 4, 0.75, 4, 0.5
SEARCH_MIN_WORDS, FOUND_SCORE, FOUND_COVERAGE, SIMILAR_SCORE, SIMILAR_COVERAGE, TOP_DOCS = 2, 88, 0.85, 70, 0.70, 40
BM25_K1, BM25_B = 1.5, 0.75
MEANING_SIM, MEANING_TOP, MEANING_COVERAGE, MEANING_PARTIAL, MEANING_MARGIN = 0.6, 8, 0.8, 50, 0.05
MISS_WORDS, MISS_SHARE, MISS_REST, MISS_FACTOR = 4, 0.35, 0.9, 0.9
WORD_RATIO, WORD_GAP, EXTERNAL_PARTIAL = 85, 2, 90
DOUBT_SHARE, DOUBT_SCORE, DOUBT_LENGTH = 0.2, 80, 3
FRAGMENT_EXACT, FRAGMENT_NEAR, FRAGMENT_BAND = 1.0, 0.8, 0.5
BREAKER_TIMEOUT, BREAKER_PAUSE = 4, 300

# --- fixed values: labels of the report ---------------------------------------------------------------------------
CARD_LABELS = {("quran", "ok"): "آية صحيحة", ("quran", "bad"): "آية فيها خطأ", ("quran", "warn"): "تحقق من القراءة", ("hadith", "ok"): "حديث موثّق", ("hadith", "warn"): "يحتاج تحققاً", ("hadith", "bad"): "لا يصح أو لم يثبت"}
LABEL_SAYING_AS_VERSE, LABEL_VERSE_AS_SAYING, LABEL_NO_VERSE, LABEL_CHECK_READING = "حديث نُسب للقرآن", "آية نُسبت للنبي ﷺ", "ليست آية بهذا اللفظ", "تحقق من القراءة"
