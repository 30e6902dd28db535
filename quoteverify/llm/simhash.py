"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints: 64 bits over 3-word shingles, a bit is 1 if it is set in over half of the shingles' hashes. Exact copies
share a fingerprint, so everything after works on distinct fingerprints.

Candidates meet by the pigeonhole principle: with b blocks of bits and at most r differing bits, b - r blocks agree.
Each fingerprint goes to one cell for each choice of b - r blocks; b grows with the number of fingerprints so that
cells stay small, and every choice of b finds the same links. A cell of more than ``HOT`` fingerprints, which share an
unusual pattern, is parted into blocks once more, now of the bits that its own blocks leave free. A cell of more than
``CELL`` fingerprints is dealt to chunks, and each pair of chunks is a cell of its own: the same links again, and no task
holds the whole group.

In a cell, fingerprints are sorted by Gray rank, so neighbours share most bits. Consecutive fingerprints form a node
that holds the bits all of them share (a mask and a pattern), nodes form upper nodes likewise. A search goes down with
the differences counted so far; a child adds those in bits that its parent does not share; a whole group is dropped
as soon as the count exceeds the radius.

A cell reports a spanning forest of its links, so their number never exceeds its fingerprints. Components come from
rounds of contraction on tables: each node joins the first of its neighbours in a random order, which at least halves
long chains, until no edge is left.

Edge cases: a null or empty text has fingerprint zero and links like any other; fewer than three words are one
shingle; rows with a null doc_id take no part; repeated rows each get their row; an empty table gives none.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import hash_strings, mix
from .common import drop_table, ranges, slices, texts_of, written
from .token_counts import word_lists

RADIUS = 3
#: Near duplicates by similarity: what is similar, in shingles of how many words, and the radius in which they are looked for.
SIMILARITY, WORDS, WIDE = 0.8, 5, 6
#: By how much the number of candidates that a text meets grows with each round.
GROWTH = 16
#: Fingerprints in a cell or chunk.
CELL = 1024
#: Fingerprints from which a cell is parted by its free bits, and how many of the blocks of these agree.
HOT, AGREE = 16 * CELL, 2
#: Fingerprints or nodes under a node.
FANOUT = 8
ROWS = 1 << 16


def fingerprints_of(texts: pa.Array, shingle: int = 3) -> np.ndarray:
    """The unsigned 64-bit fingerprint of each text."""
    from xxhash import xxh64_intdigest

    words, bounds = word_lists(pc.ascii_lower(texts))
    counts = np.diff(bounds)
    n = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
    result = np.zeros(len(counts), np.uint64)
    if not n.any():
        return result
    joined = " ".join(words.to_pylist()).encode()
    ends = np.cumsum(pc.binary_length(words).to_numpy() + 1)
    first = ranges(bounds[:-1], n)
    last = first + np.repeat(np.minimum(counts, shingle), n)
    begin = np.concatenate([[0], ends])[first]
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in zip(begin.tolist(), (ends[last - 1] - 1).tolist())), np.uint64, len(first))
    some = np.flatnonzero(n)
    starts = (np.cumsum(n) - n)[some]
    for at in range(0, len(some), 256):  # bounded memory for the bits
        a, b = starts[at], starts[at + 256] if at + 256 < len(some) else len(hashes)
        bits = np.unpackbits(hashes[a:b].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes = np.add.reduceat(bits, starts[at : at + 256] - a, axis=0, dtype=np.int32)
        chosen = votes * 2 > n[some[at : at + 256], None]
        result[some[at : at + 256]] = np.packbits(chosen, axis=1, bitorder="little").view("<u8").ravel()
    return result


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed number)."""

    def run(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fingerprints_of(batch.column("text")).view(np.int64))], ["doc_id", "fp"])

    return texts_of(docs).mapInArrow(run, "doc_id long, fp long")


def row_fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, same (a hash of the text), fp of each row."""

    def run(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("same"), pa.array(fingerprints_of(batch.column("text"), shingle).view(np.int64))], ["doc_id", "same", "fp"])

    return texts_of(docs).withColumn("same", F.xxhash64("text")).mapInArrow(run, "doc_id long, same long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """The index over fingerprints of one or many cells; a search stays in its cell."""

    def __init__(self, cells: np.ndarray, fps: np.ndarray, labels: np.ndarray | None = None):
        self.order = order = np.lexsort((gray_rank(fps), cells))
        self.cells, self.fps = cells[order], fps[order]
        self.labels = None if labels is None else labels[order]
        self.levels = []  # from the fingerprints up: first child, children, mask, pattern
        self.alike = []  # by level, the label that all below a node have; with it whether there is one
        cell, low, high = self.cells, self.fps, self.fps
        least = most = self.labels
        while True:
            begin = np.concatenate([[True], cell[1:] != cell[:-1]])
            starts = np.flatnonzero(begin)
            place = np.arange(len(cell)) - np.repeat(starts, np.diff(np.append(starts, len(cell))))
            first = np.flatnonzero(place % FANOUT == 0)
            low, high = np.bitwise_and.reduceat(low, first), np.bitwise_or.reduceat(high, first)
            mask = ~(low ^ high)
            self.levels.append((first, np.diff(np.append(first, len(cell))), mask, low & mask))
            if labels is not None:
                least, most = np.minimum.reduceat(least, first), np.maximum.reduceat(most, first)
                self.alike.append((least, least == most))
            cell = cell[first]
            if (cell[1:] != cell[:-1]).all():
                break
        self.roots = np.repeat(np.arange(len(cell)), np.diff(np.append(np.searchsorted(self.cells, cell), len(self.cells))))

    def links(self, radius: int):
        """Pairs of places (i < j) in the sorted order within the radius, in parts of bounded size; with labels only pairs of
        different ones."""
        step = max(1, (1 << 22) // max(1, int(np.bincount(self.roots).max())))
        for at in range(0, len(self.fps), step):
            query = np.arange(at, min(at + step, len(self.fps)))
            node, parent_mask, differ = self.roots[query], np.zeros(len(query), np.uint64), np.zeros(len(query), np.int64)
            for level in range(len(self.levels) - 1, -1, -1):
                first, children, mask, pattern = self.levels[level]
                differ = differ + np.bitwise_count((self.fps[query] ^ pattern[node]) & mask[node] & ~parent_mask)
                kept = differ <= radius
                if self.labels is not None:
                    label, uniform = self.alike[level]
                    kept &= ~(uniform[node] & (label[node] == self.labels[query]))
                query, node, differ = query[kept], node[kept], differ[kept]
                parent_mask = np.repeat(mask[node], children[node])
                query, differ, node = np.repeat(query, children[node]), np.repeat(differ, children[node]), ranges(first[node], children[node])
            near = (node > query) & (differ + np.bitwise_count((self.fps[query] ^ self.fps[node]) & ~parent_mask) <= radius)
            if self.labels is not None:
                near &= self.labels[query] != self.labels[node]
            yield query[near], node[near]


def joined(n: int, parts) -> np.ndarray:
    """For each of n places the smallest place it is linked with, through any number of links."""
    root = np.arange(n)
    for a, b in parts:
        while len(a):
            x, y = root[a], root[b]
            low = np.minimum(x, y)
            np.minimum.at(root, x, low)
            np.minimum.at(root, y, low)
            while (root[root] != root).any():
                root = root[root]
            open_ = root[a] != root[b]
            a, b = a[open_], b[open_]
    return root


def choices(bits: list[int], radius: int, agree: int) -> list[int]:
    """Masks of ``agree`` of radius + agree blocks of these bits: two numbers that differ in at most ``radius`` bits agree in
    all bits of one of the masks."""
    edges = [len(bits) * i // (radius + agree) for i in range(radius + agree + 1)]
    blocks = [sum(1 << b for b in bits[x:y]) for x, y in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(blocks, agree)]


def blocks_for(n: int, radius: int = RADIUS) -> list[int]:
    """Masks of the bits that meet in a cell, by the number of fingerprints."""
    agree = next((k for k in (1, 2, 3) if n <= 64 << (64 * k // (radius + k))), 3)
    return choices(list(range(64)), radius, agree)


def free_blocks(mask: int, radius: int = RADIUS) -> list[int]:
    """Masks that part a cell of this mask further."""
    return choices([b for b in range(64) if not mask >> b & 1], radius, AGREE)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _cells(rows: DataFrame, masks: list[int], radius: int) -> DataFrame:
    """The rows (with a column fp) in each of their cells, with column cell."""
    spark, columns = rows.sparkSession, rows.columns
    keyed = rows.select("*", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("part")) for k, m in enumerate(masks)))).alias("c")).select(*columns, "c.k", "c.part", F.lit(-1).alias("j"), F.lit(0).cast("long").alias("more"))
    place = ["k", "part", "j", "more"]
    count = lambda x: x.groupBy(*place).agg(F.count("*").alias("n")).where("n > 1")
    sizes = written(count(keyed), "sizes")
    together = keyed.join(sizes, place)
    if sizes.where(F.col("n") > HOT).limit(1).count():
        # a row for each mask of the free bits of each of the masks: some thousands at most
        finer = spark.createDataFrame([(k, j, _signed(x)) for k, m in enumerate(masks) for j, x in enumerate(free_blocks(m, radius))], "k int, j int, mask long")
        hot = together.where(F.col("n") > HOT).select(*columns, "k", "part").join(F.broadcast(finer), "k").select(*columns, "k", "part", "j", F.col("fp").bitwiseAND(F.col("mask")).alias("more"))
        together = together.where(F.col("n") <= HOT).unionByName(hot.join(count(hot), place))
    dealt = together.withColumn("chunks", F.ceil(F.col("n") / CELL).cast("long")).withColumn("own", F.pmod(F.xxhash64("fp", columns[0]), F.col("chunks")))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda j: F.least(j, F.col("own")) * F.col("chunks") + F.greatest(j, F.col("own")))
    cells = dealt.select(*columns, F.explode(pairs).alias("pair"), *place).select(*columns, F.xxhash64(*place, "pair").alias("cell"))
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return cells.repartition(parts, "cell").sortWithinPartitions("cell")


def _whole_cells(batches):
    """Tables of about ROWS rows, or of one larger cell, that hold the cells in them as a whole; batches are sorted by cell."""
    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= ROWS:
            whole = pa.Table.from_batches(held).combine_chunks()
            cell = whole["cell"].to_numpy()
            cut = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on
            if cut:
                yield whole.slice(0, cut)
            held, rows = whole.slice(cut).to_batches(), len(cell) - cut
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def near_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v): edges that connect exactly the fingerprints that links within the radius connect. ``fps`` is a table of
    distinct fingerprints in column fp."""

    def run(batches):
        for rows in _whole_cells(batches):
            index = GrayIndex(rows["cell"].to_numpy(), rows["fp"].to_numpy().view(np.uint64))
            root = joined(len(index.fps), index.links(radius))
            some = np.flatnonzero(root != np.arange(len(root)))
            found = index.fps.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found[some]), pa.array(found[root[some]])], ["u", "v"])

    return _cells(fps.select("fp"), blocks_for(fps.count(), radius), radius).mapInArrow(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (u, v); nodes of a component share the root. Rounds of contraction: each
    node goes to the first of itself and its neighbours in an order drawn anew each round."""
    edges = written(edges.where("u <> v").distinct(), "edges")
    found = None
    turn = 0
    while edges.limit(1).count():
        turn += 1
        order = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), c.alias("to"))  # noqa: B023, E731
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        moved = written(both.groupBy(F.col("u").alias("node")).agg(F.min(order(F.col("v"))).alias("m")).select("node", F.least(F.col("m"), order(F.col("node"))).getField("to").alias("to")), "moved")
        found = moved if found is None else written(found.join(moved.select(F.col("node").alias("to"), F.col("to").alias("__next")), "to", "left").select("node", F.coalesce("__next", "to").alias("to")), "found")
        left = edges.join(moved.select(F.col("node").alias("u"), F.col("to").alias("__u")), "u").join(moved.select(F.col("node").alias("v"), F.col("to").alias("__v")), "v")
        edges = written(left.where("__u <> __v").select(F.least("__u", "__v").alias("u"), F.greatest("__u", "__v").alias("v")).distinct(), "edges")
    if found is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return found.select("node", F.col("to").alias("root"))


def _classes(prints: DataFrame, radius: int) -> DataFrame:
    """(fp, root) of the distinct fingerprints of a table; those of a component share the root."""
    distinct = written(prints.select("fp").distinct(), "distinct")
    return distinct.join(components(near_links(distinct, radius)).withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id that links reach)."""
    prints = written(fingerprints(docs), "fingerprints")
    rooted = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")).join(_classes(prints, radius), "fp"), "rooted")
    classes = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")




def _first_of(docs: DataFrame, prints: DataFrame, rooted: DataFrame) -> DataFrame:
    """The rows of ``docs`` that come first in their group by doc_id and text hash. ``rooted``: prints with column root. Rows
    without a doc_id stay."""
    same = F.xxhash64(F.coalesce("text", F.lit("")))
    first = written(rooted.groupBy("root").agg(F.min(F.struct("doc_id", "same")).alias("f")).select(F.col("f.doc_id").alias("__id"), F.col("f.same").alias("__same")), "first")
    rows = docs.where("doc_id IS NOT NULL")
    kept = rows.join(first, (F.col("doc_id").cast("long") == F.col("__id")) & (same == F.col("__same")), "left_semi")
    copies = prints.join(first, (F.col("doc_id") == F.col("__id")) & (F.col("same") == F.col("__same")), "left_semi").count() - first.count()
    if copies:  # rows that are the same in both; ranks are cut before the shuffle
        once = Window.partitionBy("doc_id", same).orderBy("text")
        kept = kept.withColumn("__row", F.row_number().over(once)).where("__row = 1").drop("__row")
    return kept.unionByName(docs.where("doc_id IS NULL"))


def one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that come first in their component (of ``near_duplicates``). Rows that
    share a doc_id are documents of their own unless their texts are near duplicates. Rows without a doc_id stay."""
    prints = written(row_fingerprints(docs), "fingerprints")
    return _first_of(docs, prints, prints.join(_classes(prints, radius), "fp"))


# Near duplicates by similarity ---------------------------------------------------------------------------------------


def wide_blocks(n: int, radius: int) -> list[int]:
    """Masks for a wide radius: few enough that rows are bounded, long enough that cells are."""
    cost = lambda k: comb(radius + k, k) * (1 + n / 2 ** (64 * k / (radius + k)) / 256)
    return choices(list(range(64)), radius, min((1, 2, 3), key=cost))


def shingle_sets(texts: pa.Array, shingle: int) -> pa.Array:
    """For each text its distinct shingles as sorted 64-bit hashes, in one binary value."""
    words, bounds = word_lists(pc.ascii_lower(texts))
    coded = words.dictionary_encode()
    keys = mix(hash_strings(coded.dictionary)[coded.indices.to_numpy()]) if len(words) else np.zeros(0, np.uint64)
    counts = np.diff(bounds)
    size = np.minimum(counts, shingle)
    first = np.zeros(len(keys), np.uint64)
    n = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
    at = ranges(bounds[:-1], n)
    length = np.repeat(size, n)
    first = np.zeros(len(at), np.uint64)
    for k in range(shingle):
        inside = length > k
        first[inside] = mix(first[inside] * np.uint64(0x9E3779B97F4A7C15) + keys[at[inside] + k])
    ends = np.cumsum(n)
    return pa.array([np.unique(first[a:b]).tobytes() for a, b in zip((ends - n).tolist(), ends.tolist())], pa.binary())


def similar_edges(docs: DataFrame, nodes: DataFrame, edges: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """(u, v, ok) of edges between texts: whether the texts' sets of shingles have that similarity (common ones by all)."""
    wanted = nodes.join(edges.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "node").select(F.col("node").alias("__node"), F.col("doc").alias("__doc"))
    texts = texts_of(docs).withColumn("node", F.xxhash64("text"))
    texts = texts.join(wanted, (F.col("node") == F.col("__node")) & (F.col("doc_id") == F.col("__doc")), "left_semi").select("node", "text")

    def sets(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("node"), shingle_sets(batch.column("text"), shingle)], ["node", "sh"])

    held = written(texts.mapInArrow(sets, "node long, sh binary").dropDuplicates(["node"]), "shingles")
    both = edges.join(held.select(F.col("node").alias("u"), F.col("sh").alias("a")), "u").join(held.select(F.col("node").alias("v"), F.col("sh").alias("b")), "v")

    def compare(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("a"), batch.column("b")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(x) + len(y) - len(np.union1d(x, y))
                ok.append(common >= similarity * (len(x) + len(y) - common) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(ok, pa.bool_())], ["u", "v", "ok"])

    out = written(both.mapInArrow(compare, "u long, v long, ok boolean"), "compared")
    drop_table(held)
    return out


def _nearest(of: np.ndarray, differ: np.ndarray, most: int) -> np.ndarray:
    """Which pairs are among the ``most`` nearest ones of their member ``of``."""
    order = np.lexsort((differ, of))
    start = np.flatnonzero(np.concatenate([[True], of[order][1:] != of[order][:-1]]))
    out = np.zeros(len(of), bool)
    out[order] = np.arange(len(of)) - np.repeat(start, np.diff(np.append(start, len(of)))) < most
    return out


def _candidates(active: DataFrame, masks: list[int], radius: int, most: int) -> DataFrame:
    """(u, v): for each text of ``active`` (node, fp, label, met) and cell the ``most`` nearest texts within the radius that
    have another label and were not met before."""

    def run(batches):
        for rows in _whole_cells(batches):
            index = GrayIndex(rows["cell"].to_numpy(), rows["fp"].to_numpy().view(np.uint64), rows["label"].to_numpy())
            node = rows["node"].to_numpy()[index.order]
            met = rows["met"].combine_chunks()
            sizes = pc.fill_null(pc.list_value_length(met), 0).to_numpy()
            pair = lambda u, v: mix(mix(np.minimum(u, v).view(np.uint64)) + np.maximum(u, v).view(np.uint64))
            before = pair(np.repeat(rows["node"].to_numpy(), sizes), pc.list_flatten(met).to_numpy()) if sizes.any() else np.zeros(0, np.uint64)
            for i, j in index.links(radius):
                if len(before):
                    new = ~np.isin(pair(node[i], node[j]), before)
                    i, j = i[new], j[new]
                if not len(i):
                    continue
                differ = np.bitwise_count(index.fps[i] ^ index.fps[j])
                near = _nearest(i, differ, most) | _nearest(j, differ, most)  # so each text that has one meets one
                u, v = node[i[near]], node[j[near]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])

    return _cells(active, masks, radius).mapInArrow(run, "u long, v long").distinct()


def similar_groups(docs: DataFrame, prints: DataFrame, similarity: float, shingle: int, radius: int) -> DataFrame:
    """(same, root) of the texts of ``prints`` (doc_id, same, fp). Texts are linked if their fingerprints differ in at most
    ``radius`` bits and their shingles have the similarity; linked texts share the root.

    Candidates come from the Gray index and are verified in rounds: in each, a text meets its nearest candidates of other
    groups that it has not met, ``GROWTH`` times as many as in the round before. Those found similar join groups, which need
    not be compared any more; it ends when no text has a candidate left. So no link is lost, and a group of n copies that are
    alike takes about n comparisons rather than all its pairs."""
    nodes = written(prints.groupBy(F.col("same").alias("node")).agg(F.min("doc_id").alias("doc"), F.first("fp").alias("fp")), "nodes")
    masks = wide_blocks(nodes.count(), radius)
    active = nodes.select("node", "fp", F.col("node").alias("label"), F.lit(None).cast("array<long>").alias("met"))
    moves = []  # (label, root) of each round
    most = 1
    while True:
        edges = written(_candidates(active, masks, radius, most), "candidates")
        if not edges.limit(1).count():
            break
        compared = similar_edges(docs, nodes, edges, similarity, shingle)
        label = lambda name: active.select(F.col("node").alias(name), F.col("label").alias(f"{name}_label"))  # noqa: B023, E731
        links = compared.where("ok").join(label("u"), "u").join(label("v"), "v").select(F.col("u_label").alias("u"), F.col("v_label").alias("v"))
        moves.append(written(components(links).select(F.col("node").alias("label"), "root"), "roots"))
        sides = compared.select("u", "v", "ok").unionByName(compared.select(F.col("v").alias("u"), F.col("u").alias("v"), "ok"))
        known = sides.groupBy(F.col("u").alias("node")).agg(F.collect_list(F.when(~F.col("ok"), F.col("v"))).alias("now"))
        # a text that met none has no candidate in any later round
        moved = active.join(known, "node").join(moves[-1], "label", "left").select("node", "fp", F.coalesce("root", "label").alias("label"), F.concat(F.coalesce("met", F.array().cast("array<long>")), "now").alias("met"))
        active = written(moved, "active")
        most *= GROWTH
    roots = nodes.select(F.col("node").alias("same"), F.col("node").alias("root"))
    for move in moves:
        roots = roots.join(move.select(F.col("label").alias("root"), F.col("root").alias("__next")), "root", "left").select("same", F.coalesce("__next", "root").alias("root"))
    return roots


def one_of_similar(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = WORDS, radius: int = WIDE) -> DataFrame:
    """The rows of ``docs``, with all their columns, that come first in their group of ``similar_groups``. Rows that share a
    doc_id are documents of their own unless their texts are similar. Rows without a doc_id stay; texts without words are
    similar to each other."""
    prints = written(row_fingerprints(docs, shingle), "fingerprints")
    return _first_of(docs, prints, prints.join(similar_groups(docs, prints, similarity, shingle, radius), "same"))
