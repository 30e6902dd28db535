"""Comparing what was reported with what was expected."""

from __future__ import annotations

from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def drawn(key: Column, seed: int, n: int, below: Column) -> Column:
    """A number from 0, drawn by a digest of the key, the seed and the draw's number: the same on every engine."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)), F.lit(str(n)))), 1, 7), 16, 10).cast("long"), below).cast("int")


def outcome(expected_kind: Column, expected: Column, got_kind: Column, got: Column) -> Column:
    """correct, missed, error_called_correct, false_alarm or softer."""
    return F.when(got.isNull(), "missed").when((got == expected) & (got_kind == expected_kind), "correct").when(expected.isin("bad", "warn") & (got == "ok"), "error_called_correct").when((expected == "ok") & (got == "bad"), "false_alarm").otherwise("softer")


def cautious_outcome(plain_outcome: Column) -> Column:
    """The coarser names: a wrong claim, or a cautious one."""
    return F.when(plain_outcome.isin("error_called_correct", "false_alarm"), "WRONG").when(plain_outcome == "softer", "cautious").otherwise(plain_outcome)


def image_outcome(expected: Column, verdicts: Column) -> Column:
    """correct, cautious, missed or wrong for an image's verdicts against those expected (arrays)."""
    opposite = F.exists(expected, lambda e: ((e == "ok") & F.array_contains(verdicts, "bad")) | ((e == "bad") & F.array_contains(verdicts, "ok")))
    pairs = F.zip_with(expected, verdicts, lambda e, v: F.when(e == v, 0).when(v == "warn", 1).otherwise(2))
    worst = F.array_max(pairs)
    return F.when(F.size(verdicts) == 0, "missed").when(F.size(verdicts) != F.size(expected), F.when(opposite, "wrong").otherwise("cautious")).when(worst == 0, "correct").when(worst == 1, "cautious").otherwise("wrong")


def confusion(rows: DataFrame, dimensions: list[str], result: str = "outcome") -> DataFrame:
    """Counts by result for each single dimension and overall, in one pass (grouping sets)."""
    sets = [*[[F.col(d), F.col(result)] for d in dimensions], [F.col(result)]]
    return rows.groupingSets(sets, *map(F.col, [*dimensions, result])).agg(F.count("*").alias("n"))


def accuracy(rows: DataFrame, by: str, ok: Column) -> DataFrame:
    return rows.groupBy(by).agg(F.count_if(ok).alias("n_ok"), F.count("*").alias("n"), F.avg(ok.cast("int")).alias("accuracy"))


def upper_median(value: str) -> Column:
    """The element in the upper middle of the sorted values: the least that over half of them do not exceed. Kept as counts by
    value, which partial sums merge."""
    return F.expr(f"percentile_disc(0.500000000000001D) WITHIN GROUP (ORDER BY {value})")


def judged(expect: Column, category: Column, n_checked: Column, verdict: Column, right_place: Column) -> Column:
    """Whether a report meets a labelled case: nothing to check, or the right verdict, for verses at the right place."""
    return F.when(expect == "none", n_checked == 0).when(n_checked == 0, False).otherwise((verdict == expect) & (~F.startswith(category, F.lit("ayah")) | right_place))


def _pair_by_words(expected: list[dict], shown: list[dict]) -> list[int | None]:
    """For each expected text the first shown one, not used before, most of whose words it has."""
    free, out = dict(enumerate(shown)), []
    for item in expected:
        own = set(item["words"])
        at = next((j for j, s in free.items() if s["words"] and sum(w in own for w in s["words"]) >= 0.6 * len(s["words"])), None)
        out.append(at)
        free.pop(at, None)
    return out


def _pair_by_kinds(expected: list[dict], shown: list[dict]) -> list[int | None]:
    """Pairs in order, by aligning the two lists of kinds."""
    out: list[int | None] = [None] * len(expected)
    for block in SequenceMatcher(None, [e["kind"] for e in expected], [s["kind"] for s in shown], autojunk=False).get_matching_blocks():
        out[block.a : block.a + block.size] = range(block.b, block.b + block.size)
    return out


def paired(posts: DataFrame, by: str = "words") -> DataFrame:
    """(post, no, kind, verdict, got_kind, got, extra) of posts (post, expected, shown), both arrays of
    struct<kind, verdict, words>. A post is one row, so pairing needs no shuffle."""
    pair = {"words": _pair_by_words, "kinds": _pair_by_kinds}[by]
    kind = dict(posts.dtypes)["post"]

    def run(batches):
        for batch in batches:
            rows = []
            for i, (expected, shown) in enumerate(zip(batch.column("expected").to_pylist(), batch.column("shown").to_pylist())):
                at = pair(expected, shown)
                extra = len(shown) - sum(j is not None for j in at)
                rows += [(i, no, e["kind"], e["verdict"], *((shown[j]["kind"], shown[j]["verdict"]) if j is not None else (None, None)), extra) for no, (e, j) in enumerate(zip(expected, at))]
            columns = list(zip(*rows)) if rows else [[] for _ in range(7)]
            yield pa.RecordBatch.from_arrays([batch.column("post").take(pa.array(columns[0], pa.int64())), *(pa.array(c, t) for c, t in zip(columns[1:], (pa.int32(), *[pa.string()] * 4, pa.int32())))], ["post", "no", "kind", "verdict", "got_kind", "got", "extra"])

    return posts.select("post", "expected", "shown").mapInArrow(run, f"post {kind}, no int, kind string, verdict string, got_kind string, got string, extra int")


def tampered(rows: DataFrame, key: str, words: str, inserted: list[str], seed: int = 1) -> DataFrame:
    """rows with ``op`` and ``altered``: one inner word replaced, left out or added, drawn by the key. Only texts of
    three words or more are altered."""
    h = lambda n, m: drawn(F.col(key), seed, n, m)
    at = h(0, F.greatest(F.size(words) - 2, F.lit(1))) + 2
    options = F.filter(F.array(*map(F.lit, inserted)), lambda w: w != F.element_at(words, at))
    word = F.element_at(options, h(1, F.size(options)) + 1)
    op = F.element_at(F.array(F.lit("replace"), F.lit("delete"), F.lit("insert")), h(2, F.lit(3)) + 1)
    left, right = F.slice(words, 1, at - 1), F.slice(words, at + 1, F.size(words))
    whole = F.slice(words, at, F.size(words))
    altered = F.when(F.col("op") == "replace", F.concat(left, F.array(word), right)).when(F.col("op") == "delete", F.concat(left, right)).otherwise(F.concat(left, F.array(word), whole))
    return rows.where(F.size(words) >= 3).withColumn("op", op).withColumn("altered", altered)


def sampled(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows in an order drawn by the key: the same rows each time."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)


def holds_words(rows: DataFrame, text: str, keys: str) -> DataFrame:
    """rows with ``held``: whether the text has every one of the key words (as parts of it)."""
    return rows.withColumn("held", F.forall(keys, lambda k: F.contains(F.col(text), k)))


def ablation(queries: DataFrame, collection, right: str = "expected") -> DataFrame:
    """(q, expected, with_meaning, without): the first document found with and without the search by meaning, for queries (q,
    text, expected)."""
    from dataclasses import replace

    from quoteverify.operators.search import search

    first = lambda c, name: search(queries.select("q", "text"), c).select("q", F.get("matches", F.lit(0))["doc"].alias(name))
    return queries.select("q", right).join(first(collection, "with_meaning"), "q", "left").join(first(replace(collection, vectors=None), "without"), "q", "left")


def noisy(text: Column, key: Column, seed: int = 1) -> Column:
    """Typing noise drawn by the key, for tests: a doubled space, a stretched letter, marks at the end, or none."""
    kind = drawn(key, seed, 0, F.lit(4))
    stretched = F.regexp_replace(text, "^(.*?[ء-ي])([ء-ي])", "$1ـ$2")
    return F.when(kind == 0, F.regexp_replace(text, " ", "  ")).when(kind == 1, stretched).when(kind == 2, F.concat(text, F.lit(" …!!"))).otherwise(text)


def built_posts(items: DataFrame, key: str, intro: Column, text: Column, fillers: list[str], seed: int = 1) -> DataFrame:
    """(key, post) of posts for tests: a filler line, the introduced item in quotes, a closing line, drawn by the
    key."""
    pick = lambda n: F.element_at(F.array(*map(F.lit, fillers)), drawn(F.col(key), seed, n, F.lit(len(fillers))) + 1)
    return items.select(key, F.concat_ws("\n", pick(0), F.concat(intro, F.lit(": «"), text, F.lit("»")), pick(1)).alias("post"))
