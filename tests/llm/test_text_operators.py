"""Packing, language model, token counts, token files, SimHash, substring dedup and decontamination against plain versions."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer, models

from quoteverify.llm import decontaminate, lm, packing, simhash, substring, token_counts, tokenfile
from quoteverify.llm.tokens import encoder, tokenizer_path

from .conftest import SPACE, words_of

LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def plain_ids(name, rows, end):
    t = Tokenizer.from_file(tokenizer_path(name))
    return [(i, np.array(t.encode(x or "", add_special_tokens=False).ids + [end], "<u4")) for i, x in rows]


def crc(ids):
    return zlib.crc32(ids.tobytes())


@pytest.mark.parametrize("size", [64, 4096])
def test_packing(make_docs, corpus_rows, size):
    got = packing.pack_documents(make_docs(corpus_rows), size=size).collect()
    expected = Counter()
    for i, ids in plain_ids("word_bpe_49k.json", corpus_rows, 1):
        for k in range(-(-len(ids) // size)):
            part = ids[k * size : (k + 1) * size]
            expected[i, k, k * size, len(part), crc(part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    total = sum(r.length for r in got)
    assert len(by) <= -(-total // size) * 11 / 9 + 1


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_added_tokens_are_read_as_the_library_does(name):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "a<|EndOfText|>b", "x <|startoftext|>", "<|", "a <| endoftext|>", " <|endoftext|> <|endoftext|>", "plain", "", "it <|endoftext|"]
    t = Tokenizer.from_file(tokenizer_path(name))
    ids, starts = encoder(tokenizer_path(name)).encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_plan_places_each_count_once_and_best_fit():
    draw = np.random.default_rng(4)
    for _ in range(30):
        size = int(draw.integers(8, 80))
        lengths = sorted(np.minimum(size, draw.geometric(0.08, int(draw.integers(1, 400)))).tolist(), reverse=True)
        free, bins = [], 0  # plain best-fit decreasing, a piece at a time
        for n in lengths:
            room = min((r for r in free if r >= n), default=None)
            if room is None:
                bins, room = bins + 1, size
            else:
                free.remove(room)
            free.append(room - n)
        plan = packing.best_fit_plan(dict(Counter(lengths)), size)
        ends = plan["sequence"] + -(-plan["count"] // plan["per"])
        assert plan["count"].sum() == len(lengths) and ends.max() == bins
    assert len(packing.best_fit_plan({}, 10)["length"]) == 0


def test_packing_of_nothing(make_docs):
    assert packing.pack_documents(make_docs([])).count() == 0
    assert packing.pack_documents(make_docs([(None, "x")])).count() == 0


def test_token_files(make_docs, corpus_rows):
    got = tokenfile.token_file_digests(make_docs(corpus_rows)).orderBy("start").collect()
    ids = dict(plain_ids("byte_bpe_50k.json", corpus_rows, 2))
    assert [r.doc_id for r in got] == sorted(i for i, _ in corpus_rows)
    at = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids[r.doc_id]), crc(ids[r.doc_id]))
        at += r.n_tokens
    assert tokenfile.token_file_digests(make_docs([])).count() == 0


def test_number_coding_is_exact():
    draw = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        x = draw.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32) >> draw.integers(0, 32, n).astype(np.uint32)
        assert (tokenfile.decode_numbers(*tokenfile.encode_numbers(x), n) == x).all()
    shard = tokenfile.encode_shard(7, np.array([3]), np.array([2]), np.array([5, 70000])) + b"\n"
    [(start, docs, lengths, numbers)] = tokenfile.decode_shards(shard)
    assert (start, docs.tolist(), lengths.tolist(), numbers.tolist()) == (7, [3], [2], [5, 70000])
    with pytest.raises(ValueError, match="not a token file"):
        list(tokenfile.decode_shards(b"nope"))


def test_token_counts(make_docs, corpus_rows):
    pieces = token_counts.ranked_pieces(tokenizer_path("piece_bpe_32k.model"))
    unigram = Tokenizer(models.Unigram([("<unk>", -100.0), *pieces.items()], unk_id=0))
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in token_counts.token_counts(make_docs(corpus_rows)).collect()}
    for i, text in corpus_rows:
        ws = words_of(text)
        assert got[i][0] == len(ws)
        if i != 606:  # the library joins unknown characters that stand together
            assert got[i][1] == sum(len(unigram.encode("▁" + w).ids) for w in ws)
    assert token_counts.token_counts(make_docs([])).count() == 0


def test_shared_trie_against_plain_programming():
    pieces = {"▁": -3.0, "a": -2.0, "b": -2.0, "ab": -3.5, "▁a": -4.0, "aba": -5.0, "ba": -3.9}

    def plain(word):
        best = [(0.0, 0)] + [None] * len(word)
        for end in range(1, len(word) + 1):
            options = [(best[s][0] + pieces[word[s:end]], best[s][1] + 1, -s) for s in range(end) if word[s:end] in pieces]
            if word[end - 1] not in pieces:
                options.append((best[end - 1][0] + min(pieces.values()) - 10, best[end - 1][1] + 1, -(end - 1)))
            top = max(options, key=lambda o: (o[0], o[2]))
            best[end] = top[:2]
        return best[-1][1]

    draw = np.random.default_rng(1)
    words = sorted({"".join(draw.choice(list("abx"), int(draw.integers(1, 12)))) for _ in range(300)})
    counter = token_counts.UnigramCounter(pieces)
    assert counter.counts(words).tolist() == [plain("▁" + w) for w in words]
    assert counter.lookup(words).tolist() == counter.lookup(words).tolist()
    assert [counter.count_of(w) for w in words] == [plain("▁" + w) for w in words]


def test_long_words_take_time_in_proportion():
    import time

    counter = token_counts.UnigramCounter(token_counts.ranked_pieces(tokenizer_path("piece_bpe_32k.model")))
    draw = np.random.default_rng(0)
    word = "".join(draw.choice(list("ABCDEFabcdefghijklmnopqrstuvwxyz0123456789+/"), 200_000))
    started = time.time()
    [long] = counter.counts([word])
    assert time.time() - started < 10
    parts = [word[k : k + 150] for k in range(0, 1500, 150)]
    assert [counter.count_of(p) for p in parts] == counter.counts(parts).tolist() and long > 50_000


@pytest.mark.parametrize("small", [False, True])
def test_language_model(make_docs, corpus_rows, monkeypatch, small):
    if small:
        from quoteverify.llm import blocks

        for name, value in (("SHARD_BYTES", 4000), ("FAN", 4), ("BUNDLE_BYTES", 3000)):
            monkeypatch.setattr(blocks, name, value)
        monkeypatch.setattr(lm, "BLOCK_BYTES", 3000)
    least = 3
    rows = lm.lm_scores(make_docs(corpus_rows), least).collect()
    tokens = [(i, ["\t", *SPACE.findall((t or "").translate(LOW)), "\n"], zlib.crc32(str(i).encode()) % 10 == 0) for i, t in corpus_rows]
    one, two, three = Counter(), Counter(), Counter()
    for _, ts, held in tokens:
        if not held:
            one.update(ts)
            two.update(zip(ts, ts[1:]))
            three.update(zip(ts, ts[1:], ts[2:]))
    starts = one.pop("\t")
    n, v = sum(one.values()), len(one)
    room = n + 0.1 * (v + 1)
    m, m3 = rows[0].pair_strength, rows[0].triple_strength
    context = lambda w: starts if w == "\t" else one[w]
    p1 = lambda w: (one[w] + 0.1) / room
    p2 = lambda a, w: (two[a, w] + m * p1(w)) / (context(a) + m)
    p3 = lambda z, a, w: (three[z, a, w] + m3 * p2(a, w)) / (two[z, a] + m3) if two[z, a] >= least else p2(a, w)
    expected = Counter()
    for i, ts, held in tokens:
        base = sum(math.log10(p1(w)) for w in ts[1:])
        score = math.log10(p2(*ts[:2])) + sum(math.log10(p3(*x)) for x in zip(ts, ts[1:], ts[2:]))
        expected[i, held, len(ts) - 1, sum(one[w] > 0 for w in ts[1:]), n, round(base, 6), round(score, 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in rows) == expected
    assert sum(c >= least for c in two.values()) > 50 and sum(r.score > r.base_score for r in rows) > len(rows) / 2
    # after any context the words' chances and that of all unknown words sum to one
    for z, a in [*list(two)[:3], *[x for x, c in two.items() if c >= least and x[1] != "\n"][:5]]:
        unknown = m * 0.1 / room / (context(a) + m) * (m3 / (two[z, a] + m3) if two[z, a] >= least else 1)
        assert sum(p3(z, a, w) for w in one) + unknown == pytest.approx(1)
    # strengths have the greatest leave-one-out likelihood of their grids
    q1 = lambda w: (one[w] - 1 + 0.1) / (room - 1)
    q2 = lambda a, w, m: (two[a, w] - 1 + m * q1(w)) / (context(a) - 1 + m)
    assert m == max(lm.PAIR_STRENGTHS, key=lambda x: sum(c * math.log10(q2(a, w, x)) for (a, w), c in two.items()))
    q3 = lambda z, a, w, x: (three[z, a, w] - 1 + x * q2(a, w, m)) / (two[z, a] - 1 + x)
    assert m3 == max(lm.TRIPLE_STRENGTHS, key=lambda x: sum(c * math.log10(q3(*t, x)) for t, c in three.items() if two[t[:2]] >= least))


def test_language_model_without_training(make_docs):
    assert lm.lm_scores(make_docs([])).count() == 0
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = lm.lm_scores(make_docs([(i, "some text") for i in held])).collect()
    assert {(r.n_known, r.train_tokens, round(r.score, 9)) for r in rows} == {(0, 0, 0.0)}


def test_parts_of_a_long_text_are_walked_as_one(monkeypatch):
    draw = np.random.default_rng(2)
    size = 5
    tokens = np.minimum(draw.geometric(0.4, 3000) - 1, size - 1)
    pairs, pair_of = np.unique(tokens[:-1] * size + tokens[1:], return_inverse=True)
    triples, place = np.unique(pair_of[:-1] * size + tokens[2:], return_inverse=True)
    pair_counts, triple_counts = np.bincount(pair_of) * (draw.random(len(pairs)) < 0.7), np.bincount(place) * (draw.random(len(triples)) < 0.7)
    below = np.searchsorted(pairs, pairs[triples // size] % size * size + triples % size)
    triple_counts *= (pair_counts[triples // size] >= 20) & (pair_counts[below] > 0)
    counts = np.bincount(tokens, minlength=size)
    root = counts / counts.sum()
    a = lm.BackoffAutomaton(root, counts, pairs, pair_counts, triples, triple_counts, 4.0, np.array([1.0, 16.0]), 20)
    begins, lengths = np.array([0, 100, 150]), np.array([2990, 1, 700])
    whole = []
    for begin, n in zip(begins, lengths):
        state, total = np.array([2]), np.zeros(2)
        for w in tokens[begin : begin + n]:
            state, weight = a.step(state, np.array([w]))
            total += weight[0]
        whole.append(total)
    for steps in (3, 64, 100_000):
        monkeypatch.setattr(lm, "STEPS", steps)
        assert np.allclose(a.walk(tokens, begins, lengths, 2), whole)


def plain_fingerprint(text):
    ws = SPACE.findall((text or "").translate(LOW))
    parts = [" ".join(ws[k : k + 3]) for k in range(len(ws) - 2)] if len(ws) >= 3 else [" ".join(ws)] if ws else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius=3):
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def plain_fingerprint_of(text, size):
    ws = SPACE.findall((text or "").translate(LOW))
    parts = [" ".join(ws[k : k + size]) for k in range(len(ws) - size + 1)] if len(ws) >= size else [" ".join(ws)] if ws else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)), set(parts)


def plain_similar(rows, similarity=0.8, size=5, radius=simhash.WIDE):
    """The first row of each group of texts that links connect: near in their fingerprints and similar in their shingles."""
    texts = sorted({t or "" for _, t in rows})
    of = {t: plain_fingerprint_of(t, size) for t in texts}
    root = {t: t for t in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(texts):
        for b in texts[k + 1 :]:
            (f, x), (g, y) = of[a], of[b]
            if (f ^ g).bit_count() <= radius and len(x & y) >= similarity * len(x | y) - 1e-9:
                root[find(a)] = find(b)
    groups = {}
    for i, t in rows:
        groups.setdefault(find(t or ""), []).append((i, t or ""))
    return groups


@pytest.mark.parametrize(("cell", "hot"), [(1024, 10**6), (8, 20)])
def test_near_duplicates_by_similarity(make_docs, monkeypatch, cell, hot):
    monkeypatch.setattr(simhash, "CELL", cell)
    monkeypatch.setattr(simhash, "HOT", hot)
    monkeypatch.setattr(simhash, "GROWTH", 2 if cell == 8 else 16)
    draw = np.random.default_rng(5)
    word = lambda: f"w{draw.integers(0, 5000)}"
    rows = []
    for group in range(12):
        base = [word() for _ in range(150)]
        for k in range(12):
            changed = list(base)
            for at in draw.choice(150, int(draw.integers(0, 7)), replace=False).tolist():
                changed[at] = word()
            base = changed if k % 4 == 3 else base  # chains, too
            rows.append((group * 100 + k, " ".join(changed)))
    rows += [(2000, rows[0][1]), (2000, "a text of its own"), (2001, "  "), (2002, None), (2003, "one"), (2004, "ONE"), (2005, rows[30][1].upper()), (2006, rows[0][1]), (2006, rows[0][1])]
    groups = plain_similar(rows)
    got = simhash.one_of_similar(make_docs([*rows, (None, "x")]))
    firsts = sorted(min(i for i, _ in g) for g in groups.values())
    assert sorted(r.doc_id for r in got.collect() if r.doc_id is not None) == firsts and 20 < len(groups) < 120
    assert got.where("doc_id IS NULL").count() == 1 and got.columns == make_docs([]).columns
    assert simhash.one_of_similar(make_docs([])).count() == 0


def test_near_duplicates(make_docs, corpus_rows):
    got = simhash.near_duplicates(make_docs(corpus_rows)).collect()
    prints = {i: plain_fingerprint(t) for i, t in corpus_rows}
    classes = plain_components(prints)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter((i, f"{prints[i]:016x}", classes[i]) for i, _ in corpus_rows)
    kept = simhash.one_of_each(make_docs(corpus_rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(classes.values())) and "block" in kept.columns
    assert simhash.near_duplicates(make_docs([])).count() == 0 and simhash.one_of_each(make_docs([])).count() == 0
    words = [f"w{k}" for k in range(200)]
    apart = [(7, " ".join(words[:60])), (7, " ".join(words[60:120])), (7, " ".join(words[60:120])), (8, " ".join(words[60:120]) + " "), (None, "x"), (None, "x"), (9, None), (10, "")]
    assert sorted((r.doc_id or 0, len(r.text or "")) for r in simhash.one_of_each(make_docs(apart)).collect()) == sorted([(0, 1), (0, 1), (7, len(apart[0][1])), (7, len(apart[1][1])), (9, 0)])


@pytest.mark.parametrize(("cell", "hot"), [(16, 10**6), (1024, 10**6), (16, 40)])
def test_links_of_clustered_fingerprints(spark, monkeypatch, cell, hot):
    """Chains of near fingerprints, and a cluster larger than a cell, which is dealt to chunks or parted by its free bits."""
    monkeypatch.setattr(simhash, "CELL", cell)
    monkeypatch.setattr(simhash, "HOT", hot)
    draw = np.random.default_rng(3)
    centres = draw.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = {int(c) for c in centres}
    for c in centres[:10].tolist():
        at = c
        for _ in range(30):
            for b in draw.choice(64, 3, replace=False).tolist():
                at ^= 1 << int(b)
            fps.add(at)
    signed = [(x - (1 << 64) if x >= 1 << 63 else x) for x in fps]
    table = spark.createDataFrame([(x,) for x in signed], "fp long")
    edges = simhash.near_links(table)
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    classes = plain_components({x: x & ((1 << 64) - 1) for x in signed})
    groups = {}
    for x in signed:
        groups.setdefault(classes[x], set()).add(roots.get(x, x))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_blocks_guarantee_the_radius():
    draw = np.random.default_rng(2)
    for n in (10, 10**8, 10**12):
        masks = simhash.blocks_for(n)
        for _ in range(300):
            differ = sum(1 << int(b) for b in draw.choice(64, 3, replace=False))
            agreed = [m for m in masks if differ & m == 0]
            assert agreed and all(any(differ & x == 0 for x in simhash.free_blocks(m)) for m in agreed[:3])
            assert all(x & m == 0 for m in agreed[:3] for x in simhash.free_blocks(m))


def plain_removed(rows, window=13):
    texts = [(i, words_of(t)) for i, t in rows]
    first = {}
    for i, ws in sorted(texts, key=lambda x: x[0]):
        for k in range(len(ws) - window + 1):
            first.setdefault(tuple(ws[k : k + window]), i)
    out = []
    for i, ws in texts:
        gone = [False] * len(ws)
        for k in range(len(ws) - window + 1):
            if first[tuple(ws[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((i, ws, gone))
    return out


@pytest.mark.parametrize(("block", "hot"), [(1500, 24 << 20), (4 << 20, 24 << 20), (3000, 500)])
def test_substring_dedup(make_docs, corpus_rows, monkeypatch, block, hot):
    """Blocks of one and of many documents; shards that hold too much; ranges that take more than one level."""
    from quoteverify.llm import blocks

    monkeypatch.setattr(blocks, "BLOCK_BYTES", block)
    monkeypatch.setattr(substring, "HOT_BYTES", hot)
    if hot < 1000:
        monkeypatch.setattr(blocks, "SHARD_BYTES", 4000)
        monkeypatch.setattr(blocks, "FAN", 4)
        monkeypatch.setattr(blocks, "BUNDLE_BYTES", 3000)
    got = substring.removal_digests(make_docs(corpus_rows)).collect()
    expected = Counter((i, len(ws), sum(gone), hashlib.sha256(" ".join(w for w, g in zip(ws, gone) if not g).encode()).hexdigest()) for i, ws, gone in plain_removed(corpus_rows))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == expected
    assert substring.removal_digests(make_docs([])).count() == 0


def test_cut_texts_keep_rows_and_columns(make_docs, corpus_rows):
    docs = make_docs(corpus_rows)
    got = substring.without_repeats(docs)
    assert got.columns == docs.columns
    texts = Counter()
    for (i, ws, gone), (_, text) in zip(plain_removed(corpus_rows), corpus_rows):
        texts[i, " ".join(w for w, g in zip(ws, gone) if not g) if any(gone) else text] += 1
    rows = got.collect()
    assert Counter((r.doc_id, r.text) for r in rows) == texts and all(r.n_chars == len(r.text or "") for r in rows)


def test_matching_statistics_against_every_window():
    draw = np.random.default_rng(6)
    for _ in range(30):
        window = int(draw.integers(2, 14))
        segments = [draw.integers(0, int(draw.integers(1, 6)), int(draw.integers(window, window + 25))) for _ in range(int(draw.integers(1, 40)))]
        symbols = np.unique(np.concatenate(segments), return_inverse=True)[1]
        lengths = np.array([len(s) for s in segments])
        starts, owners = np.cumsum(lengths) - lengths, draw.integers(0, 1000, len(lengths))
        segments = [symbols[a : a + n] for a, n in zip(starts, lengths)]
        least = {}
        for s, o in zip(segments, owners.tolist()):
            for k in range(len(s) - window + 1):
                key = tuple(s[k : k + window])
                least[key] = min(least.get(key, o), o)
        asked = [draw.integers(0, symbols.max() + 1, int(draw.integers(window, window + 20))) for _ in range(20)] + segments
        length = np.array([len(x) for x in asked])
        got = substring.FmIndex(symbols, starts, lengths, owners, window).windows(np.concatenate(asked), np.cumsum(length) - length, length)
        assert got.tolist() == [least.get(tuple(x[k : k + window]), np.iinfo(np.int64).max) for x in asked for k in range(len(x) - window + 1)]


def test_the_wavelet_tree_takes_about_the_entropy():
    draw = np.random.default_rng(1)
    symbols = np.minimum(draw.geometric(0.2, 50_000) - 1, 40)
    order = np.argsort(-np.bincount(symbols), kind="stable")
    symbols = np.argsort(order)[symbols]
    tree = substring.WaveletTree(symbols, int(symbols.max()) + 1)
    share = np.bincount(symbols) / len(symbols)
    assert tree.length[symbols].sum() < len(symbols) * (1 - (share * np.log2(np.maximum(share, 1e-12))).sum())
    at, asked = draw.integers(0, len(symbols) + 1, 200), draw.integers(0, symbols.max() + 1, 200)
    assert tree.rank(asked, at).tolist() == [int((symbols[:a] == c).sum()) for a, c in zip(at, asked)]


def test_windows_are_routed_by_few_even_keys():
    """Equal windows ask with equal keys, wherever they stand; a block asks far fewer keys than it has windows, and the keys
    are spread evenly over their ranges."""
    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 3000, n)) for n in (4000, 20, 3000, 5, 4000)]
    texts[2] = " ".join(texts[0].split()[100:400]) + " " + texts[2]
    w = substring.Windows(np.arange(5), pa.array(texts, pa.large_string()), 13)
    keys, place, several = w.distinct(40)
    assert len(place) == len(w.at) and 3 * len(keys) < len(w.at) and np.all(keys[1:] > keys[:-1])
    first, again = w.row == 0, w.row == 2
    assert np.array_equal(place[first][100:388], place[again][:288]) and np.all(several[place[again][:288]] == 2)
    assert np.mean(several[place[w.row == 4]] == 1) > 0.99
    assert np.bincount((keys >> np.uint64(37)).astype(int), minlength=8).max() < 1.3 * len(keys) / 8


def test_removal_comes_from_the_index_alone(monkeypatch):
    """What the index doesn't find stays, copies of a whole segment included."""
    words = np.arange(20, dtype="<u8").tobytes()
    rows = pa.table({"name1": [0], "name2": [0], "words": pa.array([words], pa.binary()), "first": [3], "last": [9]})
    [owners] = substring._search(rows, 13)["owners"].to_pylist()
    assert np.frombuffer(owners, "<i8").tolist() == [3] * 8
    monkeypatch.setattr(substring.FmIndex, "step", lambda self, symbol, low, high: (low, low))
    assert substring._search(rows, 13).num_rows == 0


def plain_leaks(docs, items):
    """The doc_ids of documents of which a window as long as an item is similar to it, by trying all windows that share a
    shingle with it."""
    import regex

    words = regex.compile(r"[\p{L}\p{N}]+").findall
    shingle = lambda t: [" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))] if (w := words((t or "").lower())) else []
    of = {i: shingle(t) for i, t in items}
    of = {i: s for i, s in of.items() if s}
    df = Counter(h for s in of.values() for h in set(s))
    weight = lambda h: math.log(1 + len(of) / df.get(h, 1)) if h in df else math.log(1 + len(of))
    having = {}
    for i, s in of.items():
        for h in set(s):
            having.setdefault(h, set()).add(i)
    out = set()
    for d, t in docs:
        s = shingle(t)
        for i in set().union(*(having.get(h, ()) for h in set(s))):
            y = Counter(of[i])
            for k in range(max(1, len(s) - len(of[i]) + 1)):
                x = Counter(s[k : k + len(of[i])])
                if x.keys() & y.keys():
                    common = sum(min(x[h], y[h]) * weight(h) for h in x)
                    if common / (sum(weight(h) * c for h, c in x.items()) + sum(weight(h) * c for h, c in y.items()) - common) >= 0.8 - 1e-9:
                        out.add(d)
                        break
            if d in out:
                break
    return out


def test_decontamination(spark, make_docs):
    import regex

    item = "The quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree near the river bank tonight"
    near = item.replace("The quick", "A quick").replace("tonight", "today")
    far = " ".join(w if k % 4 else "zzz" for k, w in enumerate(item.split()))
    items = [(1, item), (2, "short item"), (3, ""), (4, None), (5, item)]
    docs = [(10, f"before {item} after"), (11, item.upper().replace(" ", ",\n")), (12, f"x y {near} z"), (13, far), (14, "clean text that shares nothing much with it at all really"), (15, None), (16, ""), (17, "short item"), (18, f"{item} {item}"), (10, f"before {item} after"), (19, "one short item inside a text")]
    split = regex.compile(r"[\p{L}\p{N}]+").findall
    shingle = lambda t: [tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))] if (w := split((t or "").lower())) else []
    of = {i: shingle(t) for i, t in items}
    df = Counter(h for s in of.values() for h in set(s))
    n = sum(bool(s) for s in of.values())
    weight = lambda h: math.log(1 + n / df[h]) if h in df else math.log(1 + n)
    expected = {}
    for d, t in docs:
        s = shingle(t)
        for i, b in of.items():
            for k in range(max(1, len(s) - len(b) + 1)) if b and s else ():
                x, y = Counter(s[k : k + len(b)]), Counter(b)
                common = sum(min(x[h], y[h]) * weight(h) for h in x)
                value = common / (sum(weight(h) * c for h, c in x.items()) + sum(weight(h) * c for h, c in y.items()) - common)
                if value >= 0.8:
                    expected[d, i] = max(expected.get((d, i), 0), round(value, 6))
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, sh string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.decontaminate(make_docs(docs), bench).collect()}
    assert got == pytest.approx(expected) and {(10, 1), (11, 5), (17, 2), (18, 1)} <= set(got)
    kept = decontaminate.without_leaks(make_docs(docs), bench)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in docs if d not in {k[0] for k in expected})
    twice = [(10, item), (10, "clean text of the same id"), (None, item), (None, "clean"), (11, None)]
    assert sorted((r.doc_id or 0, r.text) for r in decontaminate.without_leaks(make_docs(twice), bench).collect() if r.text) == [(0, "clean"), (10, "clean text of the same id")]
    assert decontaminate.decontaminate(make_docs([]), bench).count() == 0
    assert decontaminate.decontaminate(make_docs(docs), bench.limit(0)).count() == 0


def test_decontamination_meets_every_window(spark, make_docs):
    """Parts of an item in another order, in the middle of other text: no shingle lies where the item's window would start."""
    draw = np.random.default_rng(8)
    foreign = lambda n: [f"f{x}" for x in draw.integers(0, 10**6, n)]
    a, b, d = ([f"{name}{k}" for k in range(30)] for name in "abd")
    long = [f"c{k}" for k in range(60)]
    items = [(1, a + b), (2, long), (3, [f"e{k}" for k in range(6)]), (4, ["r"] * 12 + d)]
    asks = ["choose", "the", "right", "answer", "of", "these", "five"]  # what several items share
    items += [(k, asks + [f"g{k}x{n}" for n in range(40)]) for k in range(5, 9)]
    bodies = [b + a, a + b, b[:28] + a, long[40:] + long[:40], long[30:] + long[:30], long[20:40] + long[:20] + long[40:], items[2][1], ["r"] * 30, d + ["r"] * 12, a, b + foreign(3) + a]
    bodies += [items[5][1], items[6][1][7:] + asks, asks, items[7][1][:40], foreign(5) + asks + items[4][1][9:]]
    docs = [(k, foreign(25) + body + foreign(25)) for k, body in enumerate(bodies)] + [(50, b + a), (51, a + b[:25]), (52, foreign(9) + b + a + foreign(9) + a + b)]
    shingle = lambda w: [tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))]
    of = {i: shingle(w) for i, w in items}
    df = Counter(h for s in of.values() for h in set(s))
    weight = lambda h: math.log(1 + len(items) / df.get(h, 1))
    expected = {}
    for doc, w in docs:
        s = shingle(w)
        for i, other in of.items():
            y = Counter(other)
            for k in range(max(1, len(s) - len(other) + 1)):
                x = Counter(s[k : k + len(other)])
                common = sum(min(x[h], y[h]) * weight(h) for h in x)
                value = common / (sum(weight(h) * m for h, m in (x + y).items()) - common)
                if value >= 0.8 - 1e-9:
                    best, windows, first = expected.get((doc, i), (0, 0, k))
                    expected[doc, i] = max(best, round(value, 6)), windows + 1, first
    bench = spark.createDataFrame([(i, " ".join(w), "x") for i, w in items], "item_id long, text string, sh string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.windows, r.first_word) for r in decontaminate.decontaminate(make_docs([(i, " ".join(w)) for i, w in docs]), bench).collect()}
    assert {(0, 1), (4, 2), (50, 1), (52, 1)} <= set(expected) and got.keys() == expected.keys()
    for key, (value, windows, first) in expected.items():
        assert got[key] == (pytest.approx(value, abs=2e-6), windows, first), key
