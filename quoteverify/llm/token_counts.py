"""Token counts of documents under a unigram tokenizer, by dynamic programming over a shared trie.

A batch's distinct pre-tokens form a trie, and the best score of a segmentation up to a node depends only on the
path to it, so it is computed once for all pre-tokens that share the prefix. The trie is walked level by level in
numpy; every open piece start is a state of the vocabulary's own trie. A terminal node's count is kept and looked up
by each document that has the pre-token.

Model: the pieces of a public sentencepiece file; a piece's log probability falls with its rank, log p = -ln(rank + 1)
less the log of their sum, as the file ranks pieces by frequency of merging. A character that is no piece is an
unknown token of its own, ten below the least score. Of equal scores the longest last piece wins.

A pre-token of more than ``LONG`` characters (an encoded file, say) shares its prefixes with none; the same programming
then runs along its characters alone, in time proportional to its length.

Pre-tokens are words between white space (``[^\\x20\\x09-\\x0D]+``) after U+2581.

Edge cases: a null or empty text has no pre-tokens and count 0; rows with a null doc_id take no part; repeated rows are
counted each; words of any length are taken whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import ranges, slices, text_array, texts_of
from .tokens import tokenizer_path

SPACE = "▁"
#: Characters from which a pre-token is taken by itself.
LONG = 200
KEPT_WORDS = 600_000


def ranked_pieces(path: str) -> dict[str, float]:
    """Pieces of a sentencepiece file with their log probabilities; control and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    scores = -np.log(np.arange(len(pieces)) + 1.0)
    return dict(zip(pieces, (scores - np.log(np.exp(scores).sum())).tolist()))


class UnigramCounter:
    def __init__(self, pieces: dict[str, float]):
        self.alphabet = np.array(sorted({ord(c) for p in pieces for c in p}), np.int64)
        letter = {chr(c): i + 1 for i, c in enumerate(self.alphabet.tolist())}
        self.width = len(letter) + 1
        arcs: dict[int, int] = {}
        score = [-np.inf]
        for piece, value in pieces.items():
            state = 0
            for c in piece:
                key = state * self.width + letter[c]
                if (to := arcs.get(key)) is None:
                    to = arcs[key] = len(score)
                    score.append(-np.inf)
                state = to
            score[state] = value
        self.letter, self.arcs, self.scores = letter, arcs, score
        self.keys = np.array(sorted(arcs), np.int64)
        self.to = np.array([arcs[k] for k in self.keys.tolist()], np.int64)
        self.score = np.array(score)
        self.unknown = min(pieces.values()) - 10
        self.known: dict[str, int] = {}

    def _step(self, states: np.ndarray, letters: np.ndarray) -> np.ndarray:
        keys = states * self.width + letters
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (letters > 0), self.to[at], -1)

    def count_of(self, word: str) -> int:
        """Tokens of one word, along its characters."""
        arcs, scores, width, letter = self.arcs, self.scores, self.width, self.letter
        best, count = 0.0, 0
        open_: list[tuple[int, float, int]] = []  # piece starts, the earliest first: state, score and tokens before
        for c in SPACE + word:
            code = letter.get(c, 0)
            open_.append((0, best, count))
            found, tokens = best + self.unknown, count + 1
            if code and (own := arcs.get(code)) is not None and scores[own] > -np.inf:
                found = -np.inf  # the character is a piece, so it is not unknown
            kept = []
            for state, before, n in open_:
                to = arcs.get(state * width + code) if code else None
                if to is None:
                    continue
                kept.append((to, before, n))
                if before + scores[to] > found:
                    found, tokens = before + scores[to], n + 1
                elif before + scores[to] == found and len(kept) == 1:
                    tokens = n + 1
            open_, best, count = kept, found, tokens
        return count

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each of the distinct words, which get the space mark before them."""
        long = np.array([len(w) > LONG for w in words], bool)
        if long.any():
            out = np.zeros(len(words), np.int64)
            out[long] = [self.count_of(w) for w, is_long in zip(words, long.tolist()) if is_long]
            out[~long] = self.counts([w for w, is_long in zip(words, long.tolist()) if not is_long])
            return out
        order = sorted(range(len(words)), key=words.__getitem__)
        codes = np.frombuffer((SPACE + SPACE.join(words[i] for i in order)).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        lengths = np.array([len(words[i]) + 1 for i in order], np.int64)
        at = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        letters = np.where(self.alphabet[at] == codes, at + 1, 0)
        starts = np.cumsum(lengths) - lengths
        result = np.zeros(len(words), np.int64)
        alive = np.arange(len(words))
        parent = np.zeros(len(words), np.int64)  # of each living word: its node on the level above
        best, count = np.zeros(1), np.zeros(1, np.int64)  # by node of the level above
        state, node, base, base_count = (np.zeros(0, t) for t in (np.int64, np.int64, np.float64, np.int64))  # open piece starts, by node
        depth = 0
        while len(alive):
            code, letter = codes[starts[alive] + depth], letters[starts[alive] + depth]
            first = np.ones(len(alive), bool)
            first[1:] = (parent[1:] != parent[:-1]) | (code[1:] != code[:-1])
            nodes = np.cumsum(first) - 1
            above, letter = parent[first], letter[first]
            n = len(above)
            # open starts of the parent pass to each child; each child also opens one
            opened = np.bincount(node, minlength=len(best))
            begin = np.cumsum(opened) - opened
            passed = opened[above]
            where = ranges(begin[above], passed)
            child = np.repeat(np.arange(n), passed)
            child, state = np.concatenate([child, np.arange(n)]), np.concatenate([state[where], np.zeros(n, np.int64)])
            base, base_count = np.concatenate([base[where], best[above]]), np.concatenate([base_count[where], count[above]])
            new = np.zeros(len(child), bool)
            new[len(where) :] = True
            by = np.argsort(child, kind="stable")
            child, state, base, base_count, new = child[by], state[by], base[by], base_count[by], new[by]
            state = self._step(state, letter[child])
            value = np.where(state >= 0, self.score[state], -np.inf)
            value[new & np.isneginf(value)] = self.unknown
            total = base + value
            ends = np.cumsum(np.bincount(child, minlength=n))
            best = np.maximum.reduceat(total, np.concatenate([[0], ends[:-1]]))
            won = np.flatnonzero(total == best[child])
            count = base_count[won[np.unique(child[won], return_index=True)[1]]] + 1
            depth += 1
            over = lengths[alive] == depth
            result[np.array(order, np.int64)[alive[over]]] = count[nodes[over]]
            live = state >= 0
            state, node, base, base_count = state[live], child[live], base[live], base_count[live]
            alive, parent = alive[~over], nodes[~over]
        return result

    def lookup(self, words: list[str]) -> np.ndarray:
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        if new := [w for w in words if w not in self.known]:
            self.known.update(zip(new, self.counts(new).tolist()))
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))


_counters: dict[str, UnigramCounter] = {}


def word_lists(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words (between ASCII white space) of the texts, and where each text's begin (one more than there are texts)."""
    cut = pc.ascii_split_whitespace(text_array(texts))
    bounds = np.frombuffer(cut.buffers()[1], np.int32)[cut.offset : cut.offset + len(cut) + 1].astype(np.int64) if len(cut) else np.zeros(1, np.int64)
    words = cut.values.slice(bounds[0], bounds[-1] - bounds[0])
    full = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    kept = np.concatenate([[0], np.cumsum(full)])
    return words.filter(pa.array(full)), kept[bounds - bounds[0]]


def token_counts(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens of every document."""
    model = model or tokenizer_path("piece_bpe_32k.model")

    def run(batches):
        if model not in _counters:
            _counters[model] = UnigramCounter(ranked_pieces(model))
        counter = _counters[model]
        for batch in slices(batches):
            words, bounds = word_lists(batch.column("text"))
            coded = words.dictionary_encode()
            sums = np.concatenate([[0], np.cumsum(counter.lookup(coded.dictionary.to_pylist())[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.int64))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(bounds)), pa.array(np.diff(sums[bounds]).astype(np.int64))], ["doc_id", "n_words", "n_tokens"])

    return texts_of(docs).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
