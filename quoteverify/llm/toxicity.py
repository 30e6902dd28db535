"""Toxicity by cumulative-link ordinal regression.

Severity has ordered grades 0 to 3. P(grade > k) = 1 / (1 + exp(t_k - w.x)): one weight vector w for all thresholds
t_0 < t_1 < t_2, so what raises the odds of a grade raises those of all higher ones. The expected severity is the sum of
the three probabilities. A document is toxic from the severity on that makes the fewest errors on the training texts.

Features x are sparse: the words of a text and their first 4, 5 and 6 letters, present or not. Those kept are the ones
whose odds of standing in a toxic labelled text rather than a clean one are high.

Labels say toxic or not; grades order the toxic texts by how far they are from clean ones, as judged by models that never
saw them: the labelled texts are parted into ``FOLDS``, a first model with one threshold is fitted on all folds but one and
scores that one, and of the toxic texts the third with the lowest of these scores is grade 1, the next 2, the highest 3.

Fitting uses a bounded sample of labelled rows: about ``sample`` rows by hash of the doc_id (all, if there are fewer),
of at most ``features`` features. Scoring covers every document and its whole text.

Edge cases: a null or empty text has no features; documents without a label are scored alike; null labels are no labels;
an id with several labels counts as toxic if one of them says so; without both kinds of label every severity is 0;
rows with a null doc_id take no part; repeated rows each get their row; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoteverify.session import ship

from .common import slices, texts_of
from .token_counts import word_lists

SAMPLE, FEATURES = 20_000, 20_000
PREFIXES = (4, 5, 6)
GRADES = 3
#: A kept feature stands in so many toxic texts of the sample, with so many times the odds.
LEAST_TEXTS, LEAST_ODDS = 3, 8.0
#: Parts of the labelled texts, each of which models of the others score; steps of fitting such a model.
FOLDS, FOLD_STEPS = 3, 300


def features_of(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


class TextFeatures:
    """The words of each text as places in the list of distinct pieces, and each piece's words."""

    def __init__(self, texts: pa.Array):
        pieces, self.bounds = word_lists(pc.utf8_lower(texts))
        coded = pieces.dictionary_encode()
        self.codes = coded.indices.to_numpy()
        self.row = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))
        self.pieces = pc.replace_substring_regex(coded.dictionary, r"[^\p{L}]+", " ").to_pylist()

    def pairs(self, chosen: dict[str, int] | None):
        """(text, feature) of the chosen features' occurrences, a row for each word that has the feature; all features
        (by name) where none are chosen."""
        of_piece, places = [], []
        for i, piece in enumerate(self.pieces):
            for word in piece.split():
                for name in features_of(word):
                    f = name if chosen is None else chosen.get(name)
                    if f is not None:
                        places.append(i)
                        of_piece.append(f)
        places = np.array(places, np.int64)
        counts = np.bincount(places, minlength=len(self.pieces))
        begin = np.cumsum(counts) - counts
        wanted = counts[self.codes] > 0
        codes, row = self.codes[wanted], self.row[wanted]
        times = counts[codes]
        at = np.repeat(begin[codes] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
        return np.repeat(row, times), at, of_piece


def fit(rows: np.ndarray, features: np.ndarray, grades: np.ndarray, size: int, steps: int = 1200, ridge: float = 1e-5, top: int = GRADES):
    """Weights and thresholds by gradient descent (Adam) on the mean log-loss of the observed grades, 0 to ``top``. rows,
    features: places of the ones in the sparse matrix."""
    n = len(grades)
    weights, first, gaps = np.zeros(size), 0.0, np.zeros(top - 1)
    state = [np.zeros(size + top), np.zeros(size + top)]
    for step in range(1, steps + 1):
        cuts = first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        value = np.bincount(rows, weights=weights[features], minlength=n)
        above = 1 / (1 + np.exp(np.clip(cuts[None, :] - value[:, None], -40, 40)))  # P(grade > k)
        edges = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], axis=1)
        p = np.maximum(edges[np.arange(n), grades] - edges[np.arange(n), grades + 1], 1e-12)
        slope = edges * (1 - edges)
        upper, lower = slope[np.arange(n), grades] / p, slope[np.arange(n), grades + 1] / p
        by_value = -(upper - lower) / n
        by_cut = np.zeros(top)
        np.add.at(by_cut, grades[grades > 0] - 1, upper[grades > 0] / n)
        np.add.at(by_cut, grades[grades < top], -lower[grades < top] / n)
        by_gap = np.array([by_cut[k + 1 :].sum() * np.exp(gaps[k]) for k in range(top - 1)])
        gradient = np.concatenate([np.bincount(features, weights=by_value[rows], minlength=size) + ridge * weights / max(1, size) ** 0.5, [by_cut.sum()], by_gap])
        state[0] = 0.9 * state[0] + 0.1 * gradient
        state[1] = 0.999 * state[1] + 0.001 * gradient**2
        move = (0.2 * (1 - step / steps) + 0.002) * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-9)
        weights, first, gaps = weights - move[:size], first - move[size], np.clip(gaps - move[size + 1 :], -5, 5)
    return weights, first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])


def observed_grades(row: np.ndarray, feature: np.ndarray, toxic: np.ndarray, size: int) -> np.ndarray:
    """0 for clean texts, 1 to 3 for the thirds of the toxic ones by the scores of models that were not fitted on them."""
    fold, scores = np.arange(len(toxic)) % FOLDS, np.zeros(len(toxic))
    for k in range(FOLDS):
        seen = fold != k
        number = np.cumsum(seen) - 1
        own = seen[row]
        weights, _ = fit(number[row[own]], feature[own], toxic[seen], size, FOLD_STEPS, top=1)
        scores += np.where(fold == k, np.bincount(row, weights=weights[feature], minlength=len(toxic)), 0.0)
    edges = np.quantile(scores[toxic == 1], [1 / 3, 2 / 3])
    return np.where(toxic == 1, 1 + (scores > edges[0]).astype(np.int64) + (scores > edges[1]), 0)


def severity(value: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """P(grade > k) for each k; their sum is the expected severity."""
    return 1 / (1 + np.exp(np.clip(cuts[None, :] - value[:, None], -700, 700)))


def best_cut(values: np.ndarray, toxic: np.ndarray) -> float:
    """The severity from which a text is toxic, with the fewest errors on the training texts; of equal ones the middle
    of the widest gap."""
    order = np.argsort(values)
    values, toxic = values[order], toxic[order]
    errors = np.cumsum(np.concatenate([[0], toxic])) + np.cumsum(np.concatenate([[0], 1 - toxic[::-1]]))[::-1]
    edges = np.concatenate([[0.0], values, [float(GRADES)]])
    gaps = np.where(np.diff(edges) > 0, np.diff(edges), -1.0)
    at = np.lexsort((-gaps, errors))
    at = at[gaps[at] > 0][0]
    return float((edges[at] + edges[at + 1]) / 2)


def sampled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """doc_id, text, toxic of about ``sample`` labelled documents with different texts."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    share = min(1.0, sample / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    joined = texts_of(docs).join(F.broadcast(chosen), "doc_id")  # bounded by `sample`
    return joined.groupBy(F.xxhash64("text").alias("same")).agg(F.min_by(F.struct("text", "toxic"), "doc_id").alias("r")).select("r.text", F.when(F.col("r.toxic") > 0, 1).otherwise(0).alias("toxic"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES) -> tuple[dict[str, float], list[float], float]:
    """The weights by feature, the thresholds and the severity from which a text is toxic; no weights where the labels do
    not hold both kinds."""
    rows = sampled(docs, labels, sample)

    def count(batches):
        for batch in slices(batches):
            text = TextFeatures(batch.column("text"))
            row, at, names = text.pairs(None)
            if not len(at):
                continue
            distinct, code = np.unique(np.array(names, object).astype(str), return_inverse=True)
            once = np.unique(row * len(distinct) + code[at])
            toxic = batch.column("toxic").to_numpy()[once // len(distinct)]
            in_all, in_toxic = np.bincount(once % len(distinct), minlength=len(distinct)), np.bincount(once % len(distinct), weights=toxic, minlength=len(distinct)).astype(np.int64)
            some = in_toxic > 0
            yield pa.RecordBatch.from_arrays([pa.array(distinct[some]), pa.array(in_toxic[some]), pa.array((in_all - in_toxic)[some])], ["feature", "a", "b"])
            yield pa.RecordBatch.from_arrays([pa.array(distinct[~some]), pa.array(in_toxic[~some]), pa.array((in_all - in_toxic)[~some])], ["feature", "a", "b"])

    totals = rows.agg(F.count_if(F.col("toxic") == 1).alias("a"), F.count_if(F.col("toxic") == 0).alias("b")).head()
    if not totals["a"] or not totals["b"]:
        return {}, [0.0] * GRADES, float(GRADES)
    odds = (F.col("a") + 0.5) / (F.col("b") + 0.5) * F.lit((totals["b"] + 1) / (totals["a"] + 1))
    kept = rows.mapInArrow(count, "feature string, a long, b long").groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).withColumn("odds", odds).where((F.col("a") >= LEAST_TEXTS) & (F.col("odds") >= LEAST_ODDS))
    names = [r["feature"] for r in kept.orderBy(F.desc(F.col("a") * F.log("odds")), "feature").limit(features).collect()]  # at most `features` rows
    if not names:
        return {}, [0.0] * GRADES, float(GRADES)
    chosen = {name: i for i, name in enumerate(names)}

    def places(batches):
        for batch in slices(batches):
            row, at, of = TextFeatures(batch.column("text")).pairs(chosen)
            once = np.unique(row * len(names) + np.array(of, np.int64)[at]) if len(at) else at
            lists = np.split(once, np.searchsorted(once, np.arange(1, batch.num_rows) * len(names)))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([(x % len(names)).astype(np.int32) for x in lists], pa.list_(pa.int32()))], ["toxic", "features"])

    table = rows.mapInArrow(places, "toxic int, features array<int>").toArrow()  # a few numbers for each row of the sample
    order = pc.sort_indices(pa.chunked_array([pa.array([f"{x} {t}" for x, t in zip(table["features"].to_pylist(), table["toxic"].to_pylist())])]))  # sums and folds don't depend on the order of tasks
    table = table.take(order)
    toxic = table["toxic"].to_numpy().astype(np.int64)
    lists = [np.array(x, np.int64) for x in table["features"].to_pylist()]
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    feature = np.concatenate(lists)
    grades = observed_grades(row, feature, toxic, len(names))
    weights, cuts = fit(row, feature, grades, len(names))
    above = severity(np.bincount(row, weights=weights[feature], minlength=len(lists)), cuts)
    return {n: float(w) for n, w in zip(names, weights) if abs(w) > 1e-6}, cuts.tolist(), best_cut(above.sum(axis=1), toxic)


def without_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` whose text is not toxic, with all their columns; a null text stays."""
    ship(docs.sparkSession)
    model = train(docs, labels, sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most FEATURES weights

    def run(batches):
        for batch in batches:
            text = pc.fill_null(batch.column("text"), "")
            yield batch.filter(pa.array(expected(text, *shared.value) < shared.value[2])) if model_fitted else batch

    model_fitted = bool(model[0])
    return docs.mapInArrow(run, docs.schema)


def expected(texts: pa.Array, weights: dict[str, float], cuts: list[float], _least: float) -> np.ndarray:
    """Expected severity of each text."""
    return grades_above(texts, weights, cuts).sum(axis=1)


def grades_above(texts: pa.Array, weights: dict[str, float], cuts: list[float]) -> np.ndarray:
    """P(grade > k) of each text, a column for each k."""
    if not weights:
        return np.zeros((len(texts), GRADES))
    chosen, values = {n: i for i, n in enumerate(weights)}, np.array(list(weights.values()))
    row, at, of = TextFeatures(texts).pairs(chosen)
    once = np.unique(row * len(values) + np.array(of, np.int64)[at]) if len(at) else np.zeros(0, np.int64)
    return severity(np.bincount(once // len(values), weights=values[once % len(values)], minlength=len(texts)), np.array(cuts))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, severity (expected grade), p_toxic, toxic of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))  # at most FEATURES weights

    def run(batches):
        weights, cuts, least = shared.value
        for batch in slices(batches):
            above = grades_above(batch.column("text"), weights, cuts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(above.sum(axis=1)), pa.array(above[:, 0]), pa.array(above.sum(axis=1) >= least)], ["doc_id", "severity", "p_toxic", "toxic"])

    return texts_of(docs).mapInArrow(run, "doc_id long, severity double, p_toxic double, toxic boolean")
