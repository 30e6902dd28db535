"""Language-model scores by a weighted backoff automaton over n-grams of up to three words.

Model: words and an end of text. With a word's count c, N tokens and V distinct ones in training, the root gives a word
p1 = (c + a) / (N + a (V + 1)), a = 0.1, where the one more stands for all unknown words. Each word (and the start of a
text) that training has seen is a state, and so is each pair of words that training has seen ``LEAST`` times or more: rarer
contexts tell too little of what follows. A state has an arc for each word that followed it, with log10 of
p = (c(state, word) + m p') / (c(state) + m), p' being what the next shorter context gives the word, and a failure arc to
that context with log10 of m / (c(state) + m). Over all words this sums to one.

A text is walked once from left to right with a current state: take the state's arc for the word, or fail to the shorter
context until one has it (the root has all); add the weights on the way; the arc leads to the state of the last two words
if there is one, or else of the last one. All texts of a block are walked side by side. Long texts are walked in parts of
``STEPS`` tokens: two words before a part already determine the state, so each part begins two words early and leaves their
weights out.

The strengths m (one for pairs, one for triples) are chosen from grids by leave-one-out likelihood over all training tokens:
each token is scored as if it had not been counted.

The automaton of a whole corpus fits nowhere. Each block of documents learns the corpus's counts of its distinct words and
pairs, then of its distinct triples whose context is a state (``blocks.exchange``), and builds the part of the automaton
that its texts can reach; all counts come from all training documents. Keys are hashes about 2^30 times as many as
there are tokens, at most 64 bits: fewer than one key in a billion shares its hash with another and would add its count.

Training documents are those whose crc32 of the doc_id as text leaves a rest by 10 that is not 0; the others are held
out. Words: A-Z lowered, ``[^\\x20\\x09-\\x0D]+``.

Edge cases: a null or empty text is its end alone; without any training document every count is 0, and scores follow
from the formulas (N = V = 0); a text of any length is read whole; rows with a null doc_id take no part; repeated rows
count and score each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK_BYTES, exchange, hash_strings, map_rows, mix, pack_message, shard_count, stat_of, unpack_message
from .common import drop_table, ranges, slices, texts_of, written
from .token_counts import word_lists

ALPHA = 0.1
#: Times that training has seen a pair of words that is a state.
LEAST = 4
PAIR_STRENGTHS = (1.0, 4.0, 16.0, 64.0, 256.0, 1024.0, 4096.0, 16384.0, 65536.0)
TRIPLE_STRENGTHS = (1.0, 4.0, 16.0, 64.0, 256.0)
START, END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
#: Tokens of a text that are walked as one part.
STEPS = 512
TOKENS = "block long, size long, trained long, doc_ids binary, counts binary, codes binary, keys binary"


def is_held_out(doc_ids: np.ndarray) -> np.ndarray:
    return np.array([zlib.crc32(str(i).encode()) % 10 == 0 for i in doc_ids.tolist()], bool)


def token_blocks(docs: DataFrame) -> DataFrame:
    """A table of blocks of documents as numbered words: doc_ids, words of each text, each word's place among the block's
    distinct words, and these words' 64-bit hashes."""

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for number, batch in enumerate(slices(batches, BLOCK_BYTES)):
            ids, texts = batch.column("doc_id").to_numpy(), batch.column("text")
            words, bounds = word_lists(pc.ascii_lower(texts))
            coded = words.dictionary_encode()
            counts = np.diff(bounds)
            trained = int((counts + 1)[~is_held_out(ids)].sum())
            content = (ids.astype("<i8"), counts.astype("<i4"), coded.indices.to_numpy().astype("<i4"), hash_strings(coded.dictionary).astype("<u8"))
            yield pa.RecordBatch.from_arrays([pa.array([part << 32 | number]), pa.array([int(pc.sum(pc.binary_length(texts)).as_py())]), pa.array([trained]), *(pa.array([x.tobytes()], pa.binary()) for x in content)], ["block", "size", "trained", "doc_ids", "counts", "codes", "keys"])

    return written(texts_of(docs).mapInArrow(run, TOKENS), "tokens")


def sorted_keys(keys: np.ndarray, kind: int, bits: int) -> np.ndarray:
    """Keys of ``bits`` bits, the last of which tells words from pairs."""
    return keys >> np.uint64(64 - bits) & ~np.uint64(1) | np.uint64(kind)


class Summed:
    """Distinct keys of some n-grams and the sums of their counts, in a message's order and back; n-grams that share a key
    share its sum."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.place = np.unique(keys, return_inverse=True)

    def message(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.keys, np.bincount(self.place, weights=counts, minlength=len(self.keys)).astype(np.int64)

    def back(self, sums: np.ndarray) -> np.ndarray:
        return sums[self.place]


class TokenStream:
    """A block's tokens: for each text its start mark, its words and its end mark, one text after the other."""

    def __init__(self, row, bits: int):
        doc_ids, n, codes, keys = (np.frombuffer(row[c].as_buffer(), t) for c, t in (("doc_ids", "<i8"), ("counts", "<i4"), ("codes", "<i4"), ("keys", "<u8")))
        n = n.astype(np.int64)
        self.doc_ids, self.n_tokens = doc_ids, n + 1
        self.keys = np.concatenate([keys, [START, END]])
        self.start = len(keys)
        self.firsts = np.cumsum(n + 2) - (n + 2)  # the start marks
        self.stream = np.full(int((n + 2).sum()), self.start, np.int64)
        self.stream[ranges(self.firsts + 1, n)] = codes
        self.stream[self.firsts + n + 1] = self.start + 1
        is_token = np.ones(len(self.stream), bool)
        is_token[self.firsts] = False
        self.held_out = is_held_out(doc_ids)
        trains = np.repeat(~self.held_out, n + 2)
        self.size = len(self.keys)
        self.at = np.flatnonzero(is_token)
        self.tokens, self.token_trains = self.stream[self.at], trains[self.at]
        self.pairs, self.pair_of = np.unique(self.stream[self.at - 1] * self.size + self.tokens, return_inverse=True)
        self.pair_keys = mix(mix(self.keys[self.pairs // self.size]) + self.keys[self.pairs % self.size])
        self.word_counts = np.bincount(self.stream[trains], minlength=self.size)
        self.own_pairs = np.bincount(self.pair_of[self.token_trains], minlength=len(self.pairs))
        self.bits = bits
        self.summed = Summed(np.concatenate([sorted_keys(self.keys, 1, bits), sorted_keys(self.pair_keys, 0, bits)]))

    def message(self) -> tuple[np.ndarray, np.ndarray]:
        """Of words (the start mark counts each training text) and pairs."""
        return self.summed.message(np.concatenate([self.word_counts, self.own_pairs]))

    def counts(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = self.summed.back(sums)
        return both[: self.size], both[self.size :]

    def triples(self, pair_counts: np.ndarray, least: int):
        """(distinct triples, keys, the block's own training counts): triples are numbered by their context's pair and the
        word; only those whose context is a state."""
        context = np.full(len(self.stream), -1)
        context[self.at] = self.pair_of
        context = context[self.at - 1]  # the pair that ends before the token; none before a text's first one
        some = context >= 0
        some[some] = pair_counts[context[some]] >= least
        found, place = np.unique(context[some] * self.size + self.tokens[some], return_inverse=True)
        own = np.bincount(place[self.token_trains[some]], minlength=len(found))
        return found, Summed(mix(mix(self.pair_keys[found // self.size]) + self.keys[found % self.size]) >> np.uint64(64 - self.bits)), own


class BackoffAutomaton:
    """States 0 to size - 1 are words, the others pairs of words; -1 is the root. Weights are log10, one column for each of
    ``strengths`` (of triples)."""

    def __init__(self, root: np.ndarray, counts: np.ndarray, pairs: np.ndarray, pair_counts: np.ndarray, triples: np.ndarray, triple_counts: np.ndarray, strength: float, strengths: np.ndarray, least: int):
        size, k = len(root), len(strengths)
        context, word = pairs // size, pairs % size
        self.size, self.root = size, np.log10(root)
        by_pair = (pair_counts + strength * root[word]) / (counts[context] + strength)
        is_state = pair_counts >= least
        self.state_of_pair = np.where(is_state, size + np.arange(len(pairs)), word)
        seen, known = np.flatnonzero(pair_counts > 0), np.flatnonzero(triple_counts > 0)
        state, last = triples[known] // size, triples[known] % size
        below = np.searchsorted(pairs, word[state] * size + last)  # the pair that the triple ends in
        by_triple = (triple_counts[known, None] + strengths * by_pair[below, None]) / (pair_counts[state, None] + strengths)
        self.arcs = np.concatenate([pairs[seen], (size + state) * size + last])
        self.targets = np.concatenate([self.state_of_pair[seen], self.state_of_pair[below]])
        self.weights = np.log10(np.concatenate([np.repeat(by_pair[seen, None], k, axis=1), by_triple]))
        self.fails_to = np.concatenate([np.full(size, -1), word])
        self.failure = np.concatenate([np.repeat(np.log10(strength / (counts + strength))[:, None], k, axis=1), np.log10(strengths / (pair_counts[:, None] + strengths))])

    def step(self, states: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and the weights on the way."""
        after = words.copy()  # where the root's arcs lead
        weight = np.zeros((len(states), self.weights.shape[1]))
        open_, states = np.arange(len(states)), states
        while len(open_):
            at_root = states < 0
            if at_root.any():
                done = open_[at_root]
                weight[done] += self.root[words[done], None]
                open_, states = open_[~at_root], states[~at_root]
            wanted = states * self.size + words[open_]
            at = np.searchsorted(self.arcs, wanted)
            at[at == len(self.arcs)] = 0
            has = self.arcs[at] == wanted if len(self.arcs) else np.zeros(len(wanted), bool)
            done = open_[has]
            weight[done] += self.weights[at[has]]
            after[done] = self.targets[at[has]]
            open_, states = open_[~has], states[~has]
            weight[open_] += self.failure[states]
            states = self.fails_to[states]
        return after, weight

    def walk(self, tokens: np.ndarray, begins: np.ndarray, lengths: np.ndarray, start: int) -> np.ndarray:
        """The sum of weights of each text tokens[begin : begin + length], from the state ``start``."""
        parts = -(-lengths // STEPS)
        text = np.repeat(np.arange(len(lengths)), parts)
        place = (np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)) * STEPS
        early = np.where(place > 0, 2, 0)  # words that only find the state
        count = np.minimum(STEPS, lengths[text] - place) + early
        order = np.argsort(-count, kind="stable")
        begin, early, count, text = (begins[text] + place - early)[order], early[order], count[order], text[order]
        states = np.where(early > 0, -1, start)
        total = np.zeros((len(text), self.weights.shape[1]))
        for turn in range(int(count.max()) if len(count) else 0):
            n = int(np.searchsorted(-count, -turn, side="left"))
            states, weight = self.step(states[:n], tokens[begin[:n] + turn])
            if turn < 2:
                weight[early[:n] > turn] = 0
            total[:n] += weight
        out = np.zeros((len(lengths), self.weights.shape[1]))
        np.add.at(out, text, total)
        return out


def chosen(totals) -> int:
    return int(np.argmax([-np.inf if x is None else x for x in totals]))


def lm_scores(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, and the strengths."""
    blocks = token_blocks(docs)
    shards = shard_count(blocks)
    train_tokens = blocks.agg(F.sum("trained")).head()[0] or 0
    bits = min(64, train_tokens.bit_length() + 31)
    start_key = sorted_keys(np.array([START]), 1, bits)[0]
    answers = exchange(blocks, lambda row: TokenStream(row, bits).message(), shards, bits, stat=lambda keys, sums: int(((keys & np.uint64(1) == 1) & (sums > 0) & (keys != start_key)).sum()))
    distinct = stat_of(answers)
    room = ALPHA * (distinct + 1)

    def ask_triples(row, sums):
        s = TokenStream(row, bits)
        counts, pair_counts = s.counts(sums)
        _, summed, own = s.triples(pair_counts, least)
        some = s.own_pairs > 0
        context, word, times = s.pairs[some] // s.size, s.pairs[some] % s.size, s.own_pairs[some]
        root = (counts[word] - 1 + ALPHA) / (train_tokens - 1 + room)
        left_out = [float((times * np.log10((pair_counts[some] - 1 + m * root) / (counts[context] - 1 + m))).sum()) for m in PAIR_STRENGTHS]
        yield pa.RecordBatch.from_arrays([pa.array([row["block"].as_py()]), pa.array([pack_message(*summed.message(own))], pa.binary()), pa.array([left_out], pa.list_(pa.float64()))], ["block", "asked", "left_out"])

    asked = written(map_rows(blocks, ask_triples, "block long, asked binary, left_out array<double>", answers), "asked")
    pair_strength = PAIR_STRENGTHS[chosen(asked.agg(*(F.sum(F.col("left_out")[i]) for i in range(len(PAIR_STRENGTHS)))).head())]
    triple_answers = exchange(asked.select("block", "asked"), lambda row: unpack_message(row["asked"].as_buffer()), shards, bits)
    drop_table(asked)
    strengths = np.array(TRIPLE_STRENGTHS)

    def score(row, sums, triple_sums):
        s = TokenStream(row, bits)
        counts, pair_counts = s.counts(sums)
        triples, summed, own = s.triples(pair_counts, least)
        triple_counts = summed.back(triple_sums) if len(triples) else np.zeros(0, np.int64)
        root = (counts + ALPHA) / (train_tokens + room)
        automaton = BackoffAutomaton(root, counts, s.pairs, pair_counts, triples, triple_counts, pair_strength, strengths, least)
        scores = automaton.walk(s.stream, s.firsts + 1, s.n_tokens, s.start)
        some = own > 0
        state, word, times = triples[some] // s.size, triples[some] % s.size, own[some]
        last = s.pairs[state] % s.size
        below = pair_counts[np.searchsorted(s.pairs, last * s.size + word)] - 1
        shorter = (below + pair_strength * (counts[word] - 1 + ALPHA) / (train_tokens - 1 + room)) / (counts[last] - 1 + pair_strength)
        left_out = [float((times * np.log10((triple_counts[some] - 1 + m * shorter) / (pair_counts[state] - 1 + m))).sum()) for m in TRIPLE_STRENGTHS]
        starts = np.cumsum(s.n_tokens) - s.n_tokens
        known, base = np.add.reduceat((counts[s.tokens] > 0).astype(np.int64), starts), np.add.reduceat(np.log10(root)[s.tokens], starts)
        yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids), pa.array(s.held_out), pa.array(s.n_tokens), pa.array(known), pa.array(base), pa.FixedSizeListArray.from_arrays(pa.array(scores.ravel()), len(strengths)).cast(pa.list_(pa.float64())), pa.array([left_out] + [None] * (len(s.doc_ids) - 1), pa.list_(pa.float64()))], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "scores", "left_out"])

    scored = written(map_rows(blocks, score, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, scores array<double>, left_out array<double>", answers, triple_answers), "scores")
    for done in (blocks, answers, triple_answers):
        drop_table(done)
    best = chosen(scored.where("left_out IS NOT NULL").agg(*(F.sum(F.col("left_out")[i]) for i in range(len(strengths)))).head())
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", F.col("scores")[best].alias("score"), F.lit(pair_strength).alias("pair_strength"), F.lit(TRIPLE_STRENGTHS[best]).alias("triple_strength"))
