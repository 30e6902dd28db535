"""Whole-text encoding with the tokenizers library, sharing the work on repeated words.

Both tokenizer kinds used here cut a text into pre-tokens before merging, and no pre-token crosses the place
before a single space that is followed by a non-space. So a text's ids are the ids of its pieces between such
places, one after the other, and each distinct piece needs encoding once. A piece's last punctuation is a pre-token
of its own where a letter or digit stands before it, so it is encoded apart from its stem. Arrow cuts and counts the
pieces, the tokenizers library encodes the distinct ones, numpy puts the ids together. Texts that may hold one of the
tokenizer's added tokens (such as an end-of-text mark) are encoded whole, by the library's default rules.
"""

from __future__ import annotations

import os
import re
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import ranges, text_array

#: A space before white space or at the end: such texts are encoded as they are.
IRREGULAR = r" ([\s\x{1c}-\x{1f}\x{0b}\x{85}\x{A0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|$)"
#: Distinct pieces that a worker keeps; beyond it, it starts anew, which changes no result.
KEPT_PIECES = 400_000
#: Pieces joined for one call, by whether the tokenizer keeps spaces; only speed depends on it.
JOINED = {True: 1000, False: 64}
#: Punctuation that may be encoded apart at a piece's end; no apostrophe, which contractions hold.
ENDINGS = ".,;:!?%$#&*|)"
#: By byte, whether it is an ASCII letter or digit.
ALNUM = np.array([chr(i).isalnum() and i < 128 for i in range(256)])


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def sign_of(token: str) -> str:
    """What a text that the library may find an added token in holds: the token's first signs, whose case can't differ."""
    return re.match(r"[!-/:-@\[-`{-~]{2,}|", token)[0] or token


class PieceEncoder:
    """Encodes Arrow string arrays. ``spaced``: the tokenizer keeps the space before a word (byte-level); otherwise
    white space is dropped."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = sorted({sign_of(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()})
        vocabulary = self.tokenizer.get_vocab()
        self.size = max(vocabulary.values()) + 1
        self.dtype = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.spaced = self._ids(" a")[0] != self._ids("a")[0]
        if self.spaced:
            self.bytes = np.zeros(self.size, np.int64)
            for token, i in vocabulary.items():
                self.bytes[i] = len(token)
        else:
            self.mark = next(c for c in "€©®•™" if len(self._ids(c)) == 1)
            self.mark_id = self._ids(self.mark)[0]
        self._forget()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _forget(self) -> None:
        self.known: dict[str | tuple[str, str], int] = {}
        self.lengths, self.offsets = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64)
        self.pool, self.used = np.zeros(1 << 18, self.dtype), 0

    def _keep(self, pieces: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        n, m = len(self.known), len(self.known) + len(pieces)
        while m > len(self.lengths):
            self.lengths, self.offsets = np.concatenate([self.lengths, np.zeros_like(self.lengths)]), np.concatenate([self.offsets, np.zeros_like(self.offsets)])
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.lengths[n:m], self.offsets[n:m] = lengths, self.used + np.cumsum(lengths) - lengths
        self.used += len(ids)
        self.known.update(zip(pieces, range(n, m)))

    def _learn(self, pieces: list[str]) -> None:
        if not self.spaced:
            odd = [p for p in pieces if self.mark in p]
            if odd:
                pieces = [p for p in pieces if self.mark not in p]
                for p in odd:
                    ids = np.array(self._ids(p), self.dtype)
                    self._keep([p], ids, np.array([len(ids)], np.int32))
        groups = [pieces[i : i + JOINED[self.spaced]] for i in range(0, len(pieces), JOINED[self.spaced])]
        glue = " " if self.spaced else f" {self.mark} "
        joined = [" " + glue.join(g) if self.spaced else glue.join(g) for g in groups]
        for group, encoding in zip(groups, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
            ids = np.array(encoding.ids, dtype=np.int64)
            if self.spaced:
                ends = np.cumsum([len(p.encode()) + 1 for p in group])
                lengths = np.diff(np.searchsorted(np.cumsum(self.bytes[ids]), ends, side="right"), prepend=0)
            else:
                at = np.flatnonzero(ids == self.mark_id)
                lengths = np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1
                ids = np.delete(ids, at)
            self._keep(group, ids.astype(self.dtype), lengths)

    def _distinct(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces, one after the other, and how many each has."""
        stems = pc.utf8_rtrim(pieces, ENDINGS)
        data = np.append(np.frombuffer(pieces.buffers()[2] or b"", np.uint8), 0)
        ends = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset + 1 : pieces.offset + len(pieces) + 1].astype(np.int64) if len(pieces) else np.zeros(0, np.int64)
        size = pc.binary_length(stems).to_numpy()
        over = pc.binary_length(pieces).to_numpy() - size
        last = np.where(size > 0, data[ends - over - 1], 0)
        parted = (over > 0) & (over <= 4) & ALNUM[last]
        if (wide := np.flatnonzero((over > 0) & (over <= 4) & (last >= 0x80))).size:
            letters = pc.match_substring_regex(some := stems.take(pa.array(wide)), r"[\p{L}\p{N}]$")
            if not self.spaced:  # this letter's small form ends in a mark, which would join what follows
                letters = pc.and_(letters, pc.invert(pc.ends_with(some, "\u0130")))
            parted[wide] = letters.to_numpy(zero_copy_only=False)
        stems = pc.if_else(pa.array(parted), stems, pieces)
        if not self.spaced:  # the tokenizer lowers the rest; for ASCII the order of its steps can't matter
            stems = pc.if_else(pc.string_is_ascii(stems), pc.ascii_lower(stems), stems)
        ending = np.zeros(len(pieces), np.int64)  # the ending's bytes, the last one lowest
        for k in range(4):
            ending |= np.where(parted & (over > k), data[ends - 1 - k].astype(np.int64), 0) << 8 * k
        endings, ending = np.unique(ending, return_inverse=True)
        stems = stems.dictionary_encode()
        keys = [("ending", e.to_bytes(4, "big").lstrip(b"\0").decode()) for e in endings.tolist()]
        for key in keys:
            if key not in self.known:
                ids = np.array(self._ids(key[1]), self.dtype)
                self._keep([key], ids, np.array([len(ids)], np.int32))
        stem_list = stems.dictionary.to_pylist()
        found = np.fromiter(map(self.known.get, stem_list, repeat(-1)), np.int64, len(stem_list))
        if (new := np.flatnonzero(found < 0)).size:
            self._learn([stem_list[i] for i in new.tolist()])
            found[new] = [self.known[stem_list[i]] for i in new.tolist()]
        at = np.stack([found[stems.indices.to_numpy()], np.array([self.known[k] for k in keys], np.int64)[ending]], axis=1).ravel()
        lengths = self.lengths[at].astype(np.int64)
        return self.pool[ranges(self.offsets[at], lengths)], lengths.reshape(-1, 2).sum(axis=1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and the places where texts begin (one more than there are texts)."""
        texts = text_array(texts)
        n = len(texts)
        if len(self.known) > KEPT_PIECES:
            self._forget()
        plain = pc.invert(pc.match_substring_regex(texts, IRREGULAR)).to_numpy(zero_copy_only=False) if self.spaced else np.ones(n, bool)
        for sign in self.added:  # the library cuts a text at its added tokens first, so such a text goes to it whole
            plain = plain & ~pc.match_substring(texts, sign, ignore_case=True).to_numpy(zero_copy_only=False)
        rest = texts.filter(pa.array(plain))
        cut = pc.split_pattern(rest if self.spaced else pc.replace_substring(rest, "\n", " "), " ")
        bounds = np.frombuffer(cut.buffers()[1], np.int32)[cut.offset : cut.offset + len(cut) + 1].astype(np.int64)
        pieces = cut.values.slice(bounds[0], bounds[-1] - bounds[0]) if len(cut) else cut.values
        bounds = bounds - bounds[0] if len(cut) else np.zeros(1, np.int64)
        coded = pieces.dictionary_encode()
        held, sizes = self._distinct(coded.dictionary)
        at = coded.indices.to_numpy()
        lengths, offsets = sizes[at], (np.cumsum(sizes) - sizes)[at]
        own: dict[int, np.ndarray] = {}
        if self.spaced:  # a text's first piece has no space before it
            firsts = bounds[:-1]
            apart = [e.ids for e in self.tokenizer.encode_batch_fast(pieces.take(pa.array(firsts)).to_pylist() if len(firsts) else [], add_special_tokens=False)]
            extra = np.array([x for ids in apart for x in ids], self.dtype)
            sizes = np.array([len(ids) for ids in apart], np.int64)
            lengths[firsts], offsets[firsts] = sizes, len(held) + np.cumsum(sizes) - sizes
            held = np.concatenate([held, extra])
        whole = np.flatnonzero(~plain)
        for i, e in zip(whole, self.tokenizer.encode_batch_fast(texts.filter(pa.array(~plain)).to_pylist(), add_special_tokens=False) if len(whole) else ()):
            own[int(i)] = np.array(e.ids, self.dtype)
        ids = held[ranges(offsets, lengths)]
        sums = np.concatenate([[0], np.cumsum(lengths)])
        counts = np.zeros(n, np.int64)
        counts[plain] = np.diff(sums[bounds])
        if not own:
            return ids, np.concatenate([[0], np.cumsum(counts)])
        for i, x in own.items():
            counts[i] = len(x)
        starts = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(starts[-1], self.dtype)
        out[ranges(starts[:-1][plain], counts[plain])] = ids
        for i, x in own.items():
            out[starts[i] : starts[i + 1]] = x
        return out, starts


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder for each tokenizer file and worker process."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def with_end(ids: np.ndarray, starts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with the end id after each text, and the places anew."""
    return np.insert(ids.astype(np.result_type(ids, np.min_scalar_type(end)), copy=False), starts[1:], end), starts + np.arange(len(starts))


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").view(np.uint8))
