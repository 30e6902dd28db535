"""Locating a quotation in a corpus: votes of word pairs, alignment at the best places, and what differs there."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quoteverify.functions import constants as C
from quoteverify.functions.fuzzy import edits_allowed, fuzz_partial_ratio, ratio
from quoteverify.functions.normalize import normalize, words
from quoteverify.operators.index import CHUNK, Corpus
from quoteverify.session import held, shuffles_dropped, work_table

DIFFERENCE = "struct<kind:string,written:string,correct:string,chapter:int,verse:int>"
ALIGNED = f"struct<matched:int,longest:int,chapter:int,verse_from:int,verse_to:int,differences:array<{DIFFERENCE}>>"
#: Words of a corpus, all layers together, that may go to all tasks.
CARRIED = 200_000
#: Places for the words of windows that are marked at once.
MARKS = 1 << 24
#: Pieces of a slice, as long as there are no more slices than the second.
SLICE, SLICES = 50_000, 32
CHECKED = f"piece string, status string, match_ratio double, longest_run int, layer int, axis string, chapter int, verse_from int, verse_to int, differences array<{DIFFERENCE}>"


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, … for lengths[0] places, then the same for the next start."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(lengths.sum()))


def query_words(pieces: DataFrame, corpus: Corpus) -> DataFrame:
    """(piece, layer, q, n): each piece's words in each layer's spelling."""
    spelled = [F.struct(F.lit(layer).alias("layer"), words(normalize(F.coalesce(F.col("text"), F.lit("")), corpus.profile, uthmani)).alias("q")) for layer, uthmani in corpus.layers.items()]
    return pieces.select("piece", F.explode(F.array(*spelled)).alias("s")).select("piece", "s.layer", "s.q", F.size("s.q").alias("n"))


def candidate_starts(asked: DataFrame, corpus: Corpus, top: int = C.TOP_STARTS) -> DataFrame:
    """(piece, layer, axis, start, votes, rank): each shared word pair votes twice for the place where the quotation would
    start; pieces that share none let their rare words vote once. Ties: the earliest pair of the piece, then the place."""
    many = asked.where("n > 1").select("piece", "layer", F.explode(F.transform(F.sequence(F.lit(1), F.col("n") - 1), lambda i: F.struct((i - 1).alias("i"), F.get("q", i - 1).alias("w1"), F.get("q", i).alias("w2")))).alias("b")).select("piece", "layer", "b.*")
    by_pairs = many.join(corpus.pairs, ["layer", "w1", "w2"]).groupBy("piece", "layer", "axis", (F.col("pos") - F.col("i")).alias("start")).agg((F.count("*") * 2).alias("votes"), F.min("i").alias("first"))
    without = asked.join(by_pairs.select("piece", "layer").distinct(), ["piece", "layer"], "left_anti")
    rare = corpus.singles.where(F.col("df") <= C.FALLBACK_DF)
    by_words = without.select("piece", "layer", F.posexplode("q").alias("i", "word")).join(rare, ["layer", "word"]).groupBy("piece", "layer", "axis", (F.col("pos") - F.col("i")).alias("start")).agg(F.count("*").alias("votes"), F.min("i").alias("first"))
    order = Window.partitionBy("piece", "layer").orderBy(F.desc("votes"), "first", "axis", "start")
    return by_pairs.unionByName(by_words).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).drop("first")


def windows(candidates: DataFrame, asked: DataFrame, corpus: Corpus) -> DataFrame:
    """Each candidate with the corpus words around its place, a few more on both sides."""
    wide = candidates.join(asked, ["piece", "layer"]).withColumn("low", F.greatest(F.col("start") - C.SLACK, F.lit(0))).withColumn("high", F.col("start") + F.col("n") + C.SLACK)
    wide = wide.where("high > 0").withColumn("chunk", F.explode(F.sequence(F.floor(F.col("low") / CHUNK), F.floor((F.col("high") - 1) / CHUNK))))
    joined = wide.join(corpus.chunks, ["layer", "axis", "chunk"])
    inside = F.filter("entries", lambda e: (e["pos"] >= F.col("low")) & (e["pos"] < F.col("high")))
    return joined.groupBy("piece", "layer", "axis", "start", "votes", "rank").agg(F.first("q").alias("q"), F.first("n").alias("n"), F.sort_array(F.flatten(F.collect_list(inside))).alias("window"))


def _edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def look_alike(written: str, right: str) -> bool:
    return ratio(written, right) >= 70 or _edits(written, right) <= (1 if len(right) <= 5 else 2)


def compare(q: list[str], window: list) -> dict | None:
    """How the piece's words align with a window's entries (pos, word, display, chapter, verse); None if no word does.

    The longest common blocks part both sides into gaps. Corpus words in the gaps at both ends are no errors, since a
    quotation may begin and end within a passage; the piece's words there are replacements as long as they look like their
    neighbours, from the match outwards, and additions from then on. Inside, a gap on both sides is a replacement, one on
    the piece's side an addition, one on the corpus's side an omission."""
    blocks = [b for b in SequenceMatcher(None, q, [e["word"] for e in window], autojunk=False).get_matching_blocks() if b.size]
    if not blocks:
        return None
    found = []
    note = lambda kind, written, shown, at: found.append({"kind": kind, "written": " ".join(written), "correct": " ".join(e["display"] for e in shown), "chapter": window[at]["chapter"], "verse": window[at]["verse"]})

    def edge(outward_q: list[int], outward_w: list[int], beside: int) -> None:
        alike = 0
        for i, j in zip(outward_q, outward_w):
            if not look_alike(q[i], window[j]["word"]):
                break
            note("replace", [q[i]], [window[j]], j)
            alike += 1
        if rest := sorted(outward_q[alike:]):
            note("extra", [q[i] for i in rest], [], beside)

    first, last = blocks[0], blocks[-1]
    edge(list(range(first.a - 1, -1, -1)), list(range(first.b - 1, -1, -1)), first.b)
    for left, right in zip(blocks, blocks[1:]):
        mine, theirs = q[left.a + left.size : right.a], window[left.b + left.size : right.b]
        if mine or theirs:
            note("replace" if mine and theirs else "extra" if mine else "missing", mine, theirs, left.b + left.size if theirs else left.b + left.size - 1)
    edge(list(range(last.a + last.size, len(q))), list(range(last.b + last.size, len(window))), last.b + last.size - 1)
    begin, end = window[first.b], window[last.b + last.size - 1]
    same = begin["chapter"] == end["chapter"]
    return {"matched": sum(b.size for b in blocks), "longest": max(b.size for b in blocks), "chapter": begin["chapter"], "verse_from": begin["verse"], "verse_to": end["verse"] if same else begin["verse"], "differences": found}


def _align(q: pd.Series, window: pd.Series) -> pd.DataFrame:
    empty = {"matched": 0, "longest": 0, "chapter": None, "verse_from": None, "verse_to": None, "differences": []}
    return pd.DataFrame([compare(list(a), list(b)) or empty for a, b in zip(q, window)], columns=list(empty))


def align_words(q: Column | str, window: Column | str) -> Column:
    return pandas_udf(_align, ALIGNED)(q, window)


def verbatim(asked: DataFrame, corpus: Corpus) -> DataFrame:
    """(piece, share, layer, axis, a): the pieces that stand in the first layer as they are, aligned at the first such place.

    No place has more votes than one where all pairs of a piece stand, and none aligns better, so these pieces need no other
    candidates. Such a place has the piece's rarest pair too: only the places of that one are looked at, once for all pieces
    with the same words, however often the other pairs occur."""
    first = min(corpus.layers)
    long_ = asked.where((F.col("layer") == first) & (F.col("n") >= C.MIN_WORDS)).select("piece", "q", F.array_join("q", " ").alias("said"))
    texts = held(long_.groupBy("said").agg(F.first("q").alias("q")).withColumn("n", F.size("q")), "texts")
    pairs = corpus.pairs.where(F.col("layer") == first)
    each = texts.select("said", "n", F.explode(F.transform(F.sequence(F.lit(1), F.col("n") - 1), lambda i: F.struct((i - 1).alias("i"), F.get("q", i - 1).alias("w1"), F.get("q", i).alias("w2")))).alias("b")).select("said", "n", "b.*")
    often = pairs.groupBy("w1", "w2").agg(F.count("*").alias("df"))
    rarest = each.join(often, ["w1", "w2"]).groupBy("said", "n").agg(F.min(F.struct("df", "i", "w1", "w2")).alias("r"), F.count("*").alias("met")).where(F.col("met") == F.col("n") - 1)
    places = rarest.select("said", "r.i", "r.w1", "r.w2").join(pairs, ["w1", "w2"]).select(F.col("said").alias("piece"), "layer", "axis", (F.col("pos") - F.col("i")).alias("start")).where("start >= 0")
    placed = windows(places.withColumn("votes", F.lit(0)).withColumn("rank", F.lit(1)), texts.select(F.col("said").alias("piece"), F.lit(first).alias("layer"), "q", "n"), corpus)
    here = F.transform(F.filter("window", lambda e: (e["pos"] >= F.col("start")) & (e["pos"] < F.col("start") + F.col("n"))), lambda e: e["word"])
    order = Window.partitionBy("piece").orderBy("axis", "start")
    found = placed.where(here == F.col("q")).withColumn("place", F.row_number().over(order)).where("place = 1")
    aligned = held(found.select(F.col("piece").alias("said"), "layer", "axis", align_words("q", "window").alias("a")), "verbatim")
    return long_.select("piece", "said").join(aligned, "said").select("piece", F.lit(1.0).alias("share"), "layer", "axis", "a").dropDuplicates(["piece"])


def check(pieces: DataFrame, corpus: Corpus) -> DataFrame:
    """``pieces`` (piece, text) against the corpus: CHECKED, a row for each piece. Pieces that stand there as they are come
    first (``verbatim``); the others are voted for, and their candidates go to the alignment only if enough of the piece's
    words occur in the window at all, which bounds the words that can match.

    A corpus of at most ``CARRIED`` words goes to all tasks, which do all of this where the pieces are (``Carried``): nothing
    is shuffled. With larger ones, candidates and windows take far more room than the pieces. So many pieces are checked in slices, one after the other, each
    of which drops its shuffle files: the room needed at once is that of a slice."""
    spark = pieces.sparkSession
    with shuffles_dropped(spark):
        size = corpus.chunks.agg(F.sum(F.size("entries"))).head()[0] or 0
    if size <= CARRIED:
        return _carried(pieces, corpus)
    asked = held(query_words(pieces, corpus), "asked")
    whole = held(verbatim(asked, corpus), "whole")
    told = _told(asked.join(whole.select("piece"), "piece", "left_semi"), whole, corpus)
    rest = asked.join(whole.select("piece"), "piece", "left_anti")
    with shuffles_dropped(spark):
        many = rest.where(F.col("n") >= C.MIN_WORDS).select("piece").distinct().count()
    if not many:
        return told.unionByName(_told(rest, whole.limit(0), corpus))
    slices = max(1, min(SLICES, -(-many // SLICE)))
    rest = held(rest.withColumn("slice", F.pmod(F.xxhash64("piece"), F.lit(slices)).cast("int")), "rest", by="slice")
    if slices == 1:
        return told.unionByName(_told(rest.drop("slice"), _voted(rest.drop("slice"), corpus), corpus))
    path = work_table(spark, "checked")
    for k in range(slices):
        with shuffles_dropped(spark):
            part = rest.where(F.col("slice") == k).drop("slice")
            checked = _told(part, _voted(part, corpus), corpus)
            checked.write.mode("append").parquet(path)
    return told.unionByName(spark.read.schema(checked.schema).parquet(path))


class Carried:
    """A layer of a corpus as arrays: what ``candidate_starts``, ``windows`` and the choice of the best alignment do, for many
    pieces at once. ``entries``: axis, pos, word, display, chapter, verse, sorted by all of them; ``pairs``: axis, pos, w1, w2."""

    def __init__(self, entries: pa.Table, pairs: pa.Table):
        axis, word = entries["axis"].combine_chunks(), entries["word"].combine_chunks()
        self.axes, self.vocabulary = pc.unique(axis), pc.unique(word)
        self.word, self.pos = self.ids(word), entries["pos"].to_numpy()
        self.places = self._place(axis, self.pos)
        self.twice = bool(np.any(self.places[1:] == self.places[:-1]))  # passages of one number share positions
        self.rows = entries.drop_columns(["axis"]).to_pylist()
        key = self.ids(pairs["w1"].combine_chunks()) * len(self.vocabulary) + self.ids(pairs["w2"].combine_chunks())
        self.pairs = self._posted(key, self._place(pairs["axis"].combine_chunks(), pairs["pos"].to_numpy()))
        often = np.bincount(self.word, minlength=len(self.vocabulary))
        rare = often[self.word] <= C.FALLBACK_DF
        self.rare = self._posted(self.word[rare], self.places[rare])

    def ids(self, words: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.index_in(words, value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def _place(self, axis: pa.Array, pos: np.ndarray) -> np.ndarray:
        """Axis and position as one number; what is added to it or taken off stays within the axis's numbers."""
        return (pc.index_in(axis, value_set=self.axes).to_numpy(zero_copy_only=False).astype(np.int64) << 32) + (1 << 31) + pos

    @staticmethod
    def _posted(key: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(key, kind="stable")
        keys, begin = np.unique(key[order], return_index=True)
        return keys, np.append(begin, len(order)), place[order]

    @staticmethod
    def _met(posted, key: np.ndarray, piece: np.ndarray, i: np.ndarray, weight: int) -> tuple[np.ndarray, ...]:
        """(piece, start, votes, first) of the places where a piece's keys would have it start."""
        keys, begin, place = posted
        at = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
        some = np.flatnonzero(keys[at] == key) if len(keys) else np.zeros(0, np.int64)
        at = at[some]
        many = begin[at + 1] - begin[at]
        piece, i = np.repeat(piece[some], many), np.repeat(i[some], many)
        start = place[ranges(begin[at], many)] - i
        order = np.lexsort((i, start, piece))
        piece, start, i = piece[order], start[order], i[order]
        new = np.flatnonzero(np.concatenate([[True], (piece[1:] != piece[:-1]) | (start[1:] != start[:-1])])) if len(piece) else np.zeros(0, np.int64)
        return piece[new], start[new], weight * np.diff(np.append(new, len(piece))), i[new]

    def likely(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
        """(piece, begin, end, hits) of the candidates worth aligning, by piece and rank: the window's rows, and how many of
        the piece's words occur there. ``ids``: words of all pieces, ``bounds``: where each piece's begin."""
        n = np.diff(bounds)
        of = np.repeat(np.arange(len(n)), n)
        i = np.arange(len(ids)) - bounds[of]
        # words that the corpus does not have are in no window
        open_ = (n >= C.MIN_WORDS) & (np.bincount(of[ids >= 0], minlength=len(n)) >= C.MIN_RATIO * n)
        known = (ids >= 0) & open_[of]
        two = np.flatnonzero(known[:-1] & known[1:] & (of[:-1] == of[1:]))
        by_pairs = self._met(self.pairs, ids[two] * len(self.vocabulary) + ids[two + 1], of[two], i[two], 2)
        open_[by_pairs[0]] = False
        single = np.flatnonzero(known & open_[of])
        by_words = self._met(self.rare, ids[single], of[single], i[single], 1)
        piece, start, votes, first = (np.concatenate(x) for x in zip(by_pairs, by_words))
        order = np.lexsort((start, first, -votes, piece))
        piece, start, votes = piece[order], start[order], votes[order]
        rank = np.arange(len(piece)) - np.searchsorted(piece, piece)
        top = rank < C.TOP_STARTS
        # no other place aligns better than a first one where all pairs stand
        top &= (rank == 0) | self.twice | (votes[np.searchsorted(piece, piece)] < 2 * (n[piece] - 1))
        piece, start = piece[top], start[top]
        zero = (start >> 32 << 32) + (1 << 31)  # the axis's first position
        begin = np.searchsorted(self.places, np.maximum(start - C.SLACK, zero))
        end = np.maximum(begin, np.searchsorted(self.places, start + n[piece] + C.SLACK))
        hits, size = np.zeros(len(piece), np.int64), len(self.vocabulary)
        step = max(1, MARKS // max(1, size))
        marked = np.zeros(min(step, len(piece)) * size, bool)
        for at in range(0, len(piece), step):
            p, a, b = piece[at : at + step], begin[at : at + step], end[at : at + step]
            inside = np.repeat(np.arange(len(p)), b - a) * size + self.word[ranges(a, b - a)]
            marked[inside] = True
            row, word = np.repeat(np.arange(len(p)), n[p]), ids[ranges(bounds[p], n[p])]
            hits[at : at + step] = np.bincount(row[(word >= 0) & marked[row * size + np.maximum(word, 0)]], minlength=len(p))
            marked[inside] = False
        good = hits >= C.MIN_RATIO * n[piece]
        return piece[good], begin[good], end[good], hits[good]


def _carried(pieces: DataFrame, corpus: Corpus) -> DataFrame:
    """``check`` with the corpus in every task."""
    columns = ["pos", "word", "display", "chapter", "verse"]
    entries = corpus.chunks.select("layer", "axis", F.explode("entries").alias("e")).select("layer", "axis", *(f"e.{c}" for c in columns)).toArrow().sort_by([(c, "ascending") for c in ("layer", "axis", *columns)])
    carried = pieces.sparkSession.sparkContext.broadcast((entries, corpus.pairs.select("layer", "axis", "pos", "w1", "w2").toArrow()))
    layers = sorted(corpus.layers)
    said = [F.array_join(words(normalize(F.coalesce(F.col("text"), F.lit("")), corpus.profile, corpus.layers[layer])), " ").alias(f"said{layer}") for layer in layers]
    kind = f"piece {pieces.schema['piece'].dataType.simpleString()}, short boolean, share double, layer int, axis string, a {ALIGNED}"

    def run(batches):
        tables = carried.value
        indexes = [Carried(*(t.filter(pc.equal(t["layer"], layer)).drop_columns(["layer"]) for t in tables)) for layer in layers]
        kept: dict = {}
        for batch in batches:
            best: dict[int, tuple] = {}
            for layer, index in zip(layers, indexes):
                text = batch.column(f"said{layer}")
                each = pc.split_pattern(text, " ")
                flat, sizes = each.flatten(), pc.list_value_length(each).to_numpy(zero_copy_only=False).astype(np.int64)
                sizes = np.where(pc.equal(text, "").to_numpy(zero_copy_only=False), 0, sizes)
                flat = flat.filter(pc.not_equal(flat, ""))
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                if layer == layers[0]:
                    short = sizes < C.MIN_WORDS
                for p, begin, end, hits in zip(*(x.tolist() for x in index.likely(index.ids(flat), bounds))):
                    n = int(sizes[p])
                    if p in best and hits / n <= best[p][0]:
                        continue  # no more words than these can match
                    key = (layer, begin, end, text[p].as_py())
                    if key not in kept:
                        if len(kept) > 20_000:
                            kept.clear()
                        kept[key] = compare(key[3].split(" "), index.rows[begin:end]) or {"matched": 0}
                    a = kept[key]
                    if p not in best or a["matched"] / n > best[p][0]:
                        best[p] = (a["matched"] / n, layer, index.axes[int(index.places[begin] >> 32)].as_py(), a)
            rows = [best.get(p, (None, None, None, None)) for p in range(batch.num_rows)]
            share, layer, axis, a = zip(*rows) if rows else ((), (), (), ())
            a = [x if y is not None and y >= C.MIN_RATIO else None for x, y in zip(a, share)]
            yield pa.RecordBatch.from_arrays([batch.column("piece"), pa.array(short), pa.array(share, pa.float64()), pa.array(layer, pa.int32()), pa.array(axis, pa.string()), pa.array(a, aligned)], ["piece", "short", "share", "layer", "axis", "a"])

    difference = pa.struct([("kind", pa.string()), ("written", pa.string()), ("correct", pa.string()), ("chapter", pa.int32()), ("verse", pa.int32())])
    aligned = pa.struct([*((c, pa.int32()) for c in ("matched", "longest", "chapter", "verse_from", "verse_to")), ("differences", pa.list_(difference))])
    return _stated(pieces.select("piece", *said).mapInArrow(run, kind))


def _voted(asked: DataFrame, corpus: Corpus) -> DataFrame:
    """(piece, share, layer, axis, a): the best alignment of each piece at the places voted for."""
    long_ = asked.where(F.col("n") >= C.MIN_WORDS)
    placed = windows(candidate_starts(long_, corpus), long_, corpus)
    likely = placed.where(F.size(F.filter("q", lambda w: F.exists("window", lambda e: e["word"] == w))) >= C.MIN_RATIO * F.col("n"))
    aligned = likely.withColumn("a", align_words("q", "window")).withColumn("share", F.col("a.matched") / F.col("n"))
    best = Window.partitionBy("piece").orderBy(F.desc("share"), "layer", "rank")
    chosen = aligned.withColumn("place", F.row_number().over(best)).where("place = 1")
    return chosen.select("piece", "share", "layer", "axis", "a")


def _told(asked: DataFrame, chosen: DataFrame, corpus: Corpus) -> DataFrame:
    short = asked.where(F.col("layer") == min(corpus.layers)).select("piece", (F.col("n") < C.MIN_WORDS).alias("short"))
    return _stated(short.join(chosen, "piece", "left"))


def _stated(joined: DataFrame) -> DataFrame:
    """CHECKED of (piece, short, share, layer, axis, a)."""
    good = F.coalesce(F.col("share") >= C.MIN_RATIO, F.lit(False))
    status = F.when(F.col("short"), "too_short").when(~good, "not_found").when(F.size("a.differences") > 0, "altered").otherwise("verified")
    kept = lambda c: F.when(good & ~F.col("short"), c)
    return joined.select(
        "piece", status.alias("status"), F.bround(F.when(F.col("short"), 0.0).otherwise(F.coalesce("share", F.lit(0.0))), 2).alias("match_ratio"), F.coalesce(kept(F.col("a.longest")), F.lit(0)).alias("longest_run"),
        kept(F.col("layer")).alias("layer"), kept(F.col("axis")).alias("axis"), *(kept(F.col(f"a.{c}")).alias(c) for c in ("chapter", "verse_from", "verse_to")), F.coalesce(kept(F.col("a.differences")), F.array().cast(f"array<{DIFFERENCE}>")).alias("differences"),
    )


def passage_range(located: DataFrame, texts: DataFrame, shown: str = "{text} ({n})") -> DataFrame:
    """(piece, joined): the texts of verse_from to verse_to in order, each with its number; verses without a text are
    left out. ``texts``: chapter, verse, text."""
    before, after = shown.split("{text}")[0], shown.split("{text}")[1]
    with_number = F.concat(F.lit(before), F.col("text"), F.lit(after.split("{n}")[0]), F.col("verse").cast("string"), F.lit(after.split("{n}")[1]))
    each = located.where("verse_from IS NOT NULL").select("piece", "chapter", F.explode(F.sequence("verse_from", "verse_to")).alias("verse"))
    parts = each.join(texts.select("chapter", "verse", "text"), ["chapter", "verse"]).select("piece", F.struct("verse", with_number.alias("t")).alias("s"))
    return parts.groupBy("piece").agg(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["t"]), " ").alias("joined"))


def reference(name, verse_from, verse_to):
    """"name from–to", or "name from" for a single verse."""
    return F.when(verse_from == verse_to, F.concat_ws(" ", name, verse_from)).otherwise(F.concat(name, F.lit(" "), verse_from, F.lit("–"), verse_to))


#: Words of a vocabulary whose parts go to all tasks.
LISTED = 50_000


def _letters(word: str) -> Column:
    """The set of a word's letters, as bits that letters may share."""
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.ascii(c), F.lit(64)).cast("int"))
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda bits, c: bits.bitwiseOR(bit(c)))


def near_words(asked: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, v, score): vocabulary words equal to a word (1.0) or within its edits (0.8).

    A vocabulary word cut into k + 1 even parts keeps one of them whole under k edits, at most k places away. Parts are
    joined as equal keys with the length, so no word meets the whole vocabulary or all words of a length. An edit puts at
    most one letter in and takes one out, so words whose letters differ by more than that are told apart before their
    distance is asked. The parts of a vocabulary of at most ``LISTED`` words go to all tasks; others are shuffled."""
    known = held(vocabulary.select(F.col("word").alias("v")).distinct())
    listed = F.broadcast if known.count() <= LISTED else lambda rows: rows
    # a word makes many probes, so few words are work for all cores
    wanted = asked.select("word").distinct().repartition(2 * asked.sparkSession.sparkContext.defaultParallelism)
    equal = wanted.join(known, F.col("word") == F.col("v")).select("word", "v", F.lit(C.FRAGMENT_EXACT).alias("score"))
    cut = lambda size, k, i: F.floor(size * i / (k + 1)).cast("int")
    parts = known.select("v", _letters("v").alias("of_v"), F.length("v").alias("len"), F.explode(F.array(F.lit(1), F.lit(2))).alias("k")).where("len > k").select("*", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("i"))
    parts = parts.select("v", "of_v", "len", "k", "i", F.substring(F.col("v"), cut(F.col("len"), F.col("k"), F.col("i")) + 1, cut(F.col("len"), F.col("k"), F.col("i") + 1) - cut(F.col("len"), F.col("k"), F.col("i"))).alias("part"))
    sized = wanted.withColumn("k", edits_allowed(F.col("word"))).where("k > 0").select("word", _letters("word").alias("of_word"), "k", F.explode(F.sequence(F.length("word") - F.col("k"), F.length("word") + F.col("k"))).alias("len")).where("len > k").select("*", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("i"))
    start, size = cut(F.col("len"), F.col("k"), F.col("i")), cut(F.col("len"), F.col("k"), F.col("i") + 1) - cut(F.col("len"), F.col("k"), F.col("i"))
    probes = sized.select("word", "of_word", "k", "len", "i", size.alias("size"), F.explode(F.sequence(start - F.col("k"), start + F.col("k"))).alias("at")).where("at >= 0 AND at + size <= length(word)")
    probes = probes.select("word", "of_word", "k", "len", "i", F.substring(F.col("word"), F.col("at") + 1, F.col("size")).alias("part"))
    alike = (F.col("v") != F.col("word")) & (F.bit_count(F.col("of_v").bitwiseXOR(F.col("of_word"))) <= 2 * F.col("k"))
    met = probes.join(listed(parts), ["k", "len", "i", "part"]).where(alike).select("word", "v", "k").distinct()
    near = met.where(F.levenshtein("v", "word", 2).between(0, F.col("k"))).select("word", "v", F.lit(C.FRAGMENT_NEAR).alias("score"))
    return equal.unionByName(near)


#: Fragments that are scored together, passages in whose words they are looked up at once, and sums made at once.
BLOCK, RANGE, SUMS = 4096, 1 << 14, 4 << 20


def _summed(lines: pa.Table, posts: pa.Table) -> pa.Table:
    """(q, passage, quality): the scores of a block's fragments (q, ws) in some passages, of which ``posts`` has each word's
    (word, passages, scores); those within the band of the fragment's best."""
    ws, posting = lines["ws"].combine_chunks(), posts["passages"].combine_chunks()
    flat = pc.index_in(ws.flatten(), value_set=posts["word"].combine_chunks())
    line = np.repeat(np.arange(len(ws)), pc.list_value_length(ws).to_numpy())[flat.is_valid().to_numpy(zero_copy_only=False)]
    word = flat.drop_null().to_numpy()
    passages, local = np.unique(posting.flatten().to_numpy(), return_inverse=True)
    scores = posts["scores"].combine_chunks().flatten().to_numpy()
    many = pc.list_value_length(posting).to_numpy().astype(np.int64)
    begin, made = np.cumsum(many) - many, np.cumsum(many[word])
    of_q, of_passage, quality, at = [], [], [], 0
    while at < len(line):
        # as many whole fragments as make few sums, one at least
        to = int(np.searchsorted(made, (made[at - 1] if at else 0) + SUMS, side="right"))
        to = max(int(np.searchsorted(line, line[to])) if to < len(line) else to, int(np.searchsorted(line, line[at], side="right")))
        part, first = word[at:to], line[at]
        key = np.repeat((line[at:to] - first) * len(passages), many[part]) + local[ranges(begin[part], many[part])]
        score, room = scores[ranges(begin[part], many[part])], (int(line[to - 1] - first) + 1) * len(passages)
        if room <= max(SUMS, 2 * len(key)):  # a place for each sum, without sorting
            total = np.round(np.bincount(key, weights=score, minlength=room), 6)
            each = np.flatnonzero(total)
            total = total[each]
        else:
            each, place = np.unique(key, return_inverse=True)
            total = np.round(np.bincount(place, weights=score), 6)
        row = each // len(passages)
        best = np.zeros(int(row.max(initial=0)) + 1)
        np.maximum.at(best, row, total)
        good = total >= best[row] - C.FRAGMENT_BAND
        of_q.append(row[good] + first)
        of_passage.append(passages[each[good] % len(passages)])
        quality.append(total[good])
        at = to
    whole = lambda parts, kind: np.concatenate([*parts, np.zeros(0, kind)]).astype(kind)
    return lines.select(["q"]).take(pa.array(whole(of_q, np.int64))).append_column("passage", pa.array(whole(of_passage, np.int64))).append_column("quality", pa.array(whole(quality, np.float64)))


def fragment_quality(asked: DataFrame, located_words: DataFrame) -> DataFrame:
    """(q, axis, chapter, verse, quality): for each word the best score in a verse, summed; those within half a point of the
    query's best. ``asked``: q, ws (distinct words); ``located_words``: word, axis, chapter, verse.

    The places of a word and of its neighbours are found once for all fragments. Blocks of fragments get the places of their
    words once, so no row is made for each word of a fragment and each passage that has it."""
    return _quality(held(_merged(asked)), located_words)


def _merged(asked: DataFrame) -> DataFrame:
    """A row for each q, with all its words."""
    return asked.groupBy("q").agg(F.array_distinct(F.flatten(F.collect_list("ws"))).alias("ws")).where(F.size("ws") > 0)


def _quality(asked: DataFrame, located_words: DataFrame) -> DataFrame:
    located_words = held(located_words.distinct())
    passages = held(located_words.select("axis", "chapter", "verse").distinct().withColumn("passage", F.monotonically_increasing_id()))
    blocks, parts = -(-asked.count() // BLOCK) or 1, -(-passages.count() // RANGE) or 1
    part = F.pmod(F.xxhash64("passage"), F.lit(parts)).alias("part")
    near = near_words(asked.select(F.explode("ws").alias("word")), located_words)
    there = located_words.join(passages, ["axis", "chapter", "verse"]).select(F.col("word").alias("v"), "passage")
    best = near.join(there, "v").groupBy("word", "passage").agg(F.max("score").alias("score"))
    posts = best.groupBy("word", part).agg(F.collect_list(F.struct("passage", "score")).alias("p")).select("word", "part", F.col("p.passage").alias("passages"), F.col("p.score").alias("scores"))
    lines = asked.select("q", "ws", F.pmod(F.xxhash64("q"), F.lit(blocks)).alias("block"))
    of_block = lines.select(F.col("block").alias("asking"), F.explode("ws").alias("word")).distinct().join(posts, "word")
    every = lines.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("part", F.col("part").cast("long"))
    kind = lines.select("q").schema.add("passage", "long").add("quality", "double")
    summed = every.groupBy("block", "part").cogroup(of_block.groupBy("asking", "part")).applyInArrow(_summed, kind)
    if parts > 1:
        summed = summed.withColumn("top", F.max("quality").over(Window.partitionBy("q"))).where(F.col("quality") >= F.col("top") - C.FRAGMENT_BAND)
    return summed.join(passages, "passage").select("q", "axis", "chapter", "verse", "quality")


def search_fragment(fragments: DataFrame, corpus: Corpus, top: int = 5) -> DataFrame:
    """(q, rank, axis, chapter, verse, words_found, words_asked): the passages that hold the most of a fragment's words, a
    letter or two misread; words close together come first, then the shorter passage. How close they are is asked only where
    passages with as many words contend for a place."""
    layer = min(corpus.layers)
    asked = held(_merged(fragments.select("q", words(normalize(F.coalesce(F.col("text"), F.lit("")), corpus.profile)).alias("ws"))))
    entries = corpus.chunks.where(F.col("layer") == layer).select("axis", F.explode("entries").alias("e")).select("axis", "e.word", "e.chapter", "e.verse")
    by_words = Window.partitionBy("q").orderBy(F.desc("quality"))
    good = _quality(asked, entries).withColumn("place", F.rank().over(by_words)).where(F.col("place") <= top).withColumn("even", F.count("*").over(Window.partitionBy("q", "place")))
    texts = corpus.passages.where(F.col("layer") == layer).select("axis", "chapter", "verse", normalize(F.col("text"), corpus.profile).alias("norm"))
    said = F.when(F.col("even") > 1, F.array_join("ws", " "))
    ranked = good.join(texts, ["axis", "chapter", "verse"]).join(asked, "q").withColumn("partial", fuzz_partial_ratio(said, F.col("norm")))
    order = Window.partitionBy("q").orderBy(F.desc("quality"), F.desc("partial"), F.length("norm"), "chapter", "verse")
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("q", "rank", "axis", "chapter", "verse", F.bround("quality", 1).alias("words_found"), F.size("ws").alias("words_asked"))
