"""Sums by key over a whole corpus, with answers to those who asked.

Word and window keys of a corpus are far more numerous than its documents, and one row for each would cost more than
all else. So documents are packed into blocks of bounded text; a block sends its distinct keys with their counts, sorted
and coded by their gaps, cut into as many messages as a level of the exchange has ranges of keys (``FAN``); and each range
answers every message in the message's order, without the keys. What is frequent in a block is sent once, so a key that
every document has is no more than one entry of each block.

Ranges of one level may still hold far more than a task can. Then the messages of a range are joined to bundles of bounded
size, which ask the next level as blocks ask the first, and hand the answers on. A level has FAN messages for each block or
bundle, whatever the size of the corpus, and a corpus FAN times as large takes one level more: work and messages grow as
D log D. Blocks, bundles and the shards of the last level hold bounded data whatever the corpus; their numbers grow with it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, parallelism, slices, texts_of, written
from .tokenfile import decode_numbers, encode_numbers

#: Text bytes of a block; a longer document is a block of its own.
BLOCK_BYTES = 4 << 20
#: Text bytes of the corpus for each shard.
SHARD_BYTES = 8 << 20
#: Ranges of keys that a level of the exchange tells apart (a power of two), and the bytes of messages in a bundle: at about
#: 4.5 bytes a key, the keys of a bundle are as many as those of a block or a shard, so no level needs more memory than another.
FAN, BUNDLE_BYTES = 256, 4 << 20
BLOCKS = "block long, docs int, size long, doc_ids binary, ends binary, text binary"


def make_blocks(docs: DataFrame) -> DataFrame:
    """A table of blocks (block, docs, size, doc_ids, ends, text); a block holds documents in no order."""

    def run(batches):
        from pyspark import TaskContext

        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            ids = np.concatenate([x[0] for x in held])
            lengths = np.concatenate([x[1] for x in held])
            text = b"".join(x[2] for x in held)
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | number]), pa.array([len(ids)], pa.int32()), pa.array([len(text)], pa.int64()), *(pa.array([x], pa.binary()) for x in (ids.tobytes(), np.cumsum(lengths).tobytes(), text))], ["block", "docs", "size", "doc_ids", "ends", "text"])

        for batch in slices(batches, BLOCK_BYTES // 4):
            ids, text = batch.column("doc_id").to_numpy(), batch.column("text")
            starts = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
            data = memoryview(text.buffers()[2])[starts[0] : starts[-1]] if starts[-1] > starts[0] else b""
            if held and size + len(data) > BLOCK_BYTES:
                yield flush()
                number, held, size = number + 1, [], 0
            held.append((ids, np.diff(starts), bytes(data)))
            size += len(data)
        if held:
            yield flush()

    return written(texts_of(docs).mapInArrow(run, BLOCKS), "blocks")


def block_texts(doc_ids, ends, text) -> tuple[np.ndarray, pa.Array]:
    """The doc_ids and texts of a block's binary columns (Arrow scalars)."""
    ends = np.concatenate([[0], np.frombuffer(ends.as_buffer(), np.int64)])
    ids = np.frombuffer(doc_ids.as_buffer(), np.int64)
    return ids, pa.LargeStringArray.from_buffers(len(ids), pa.py_buffer(ends.tobytes()), text.as_buffer())


def shard_count(blocks: DataFrame) -> int:
    size = blocks.agg(F.sum("size")).head()[0] or 0
    return max(parallelism(blocks.sparkSession), -(-size // SHARD_BYTES))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit numbers that spreads them (the finalizer of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_strings(strings: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string's bytes, eight at a time for all strings at once."""
    strings = strings.cast(pa.large_binary())
    ends = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1] if len(strings) else np.zeros(1, np.int64)
    data = np.concatenate([np.frombuffer(strings.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]], np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    at, left = ends[:-1] - ends[0], np.diff(ends)
    out = mix(left.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    open_ = np.flatnonzero(left > 0)
    while len(open_):
        size = left[open_]
        lane = lanes[at[open_]]
        short = size < 8
        lane[short] &= (np.uint64(1) << (size[short] * 8).astype(np.uint64)) - np.uint64(1)
        out[open_] = mix((out[open_] ^ lane) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03))
        at, left = at + 8, left - 8
        open_ = open_[size > 8]
    return out


def pack_numbers(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned 32-bit numbers as bytes."""
    out = [np.array([len(arrays)] + [len(a) for a in arrays], "<i4").tobytes()]
    for a in arrays:
        control, data = encode_numbers(a)
        out += [np.array([len(data)], "<i4").tobytes(), control.tobytes(), data.tobytes()]
    return b"".join(out)


def unpack_numbers(content) -> list[np.ndarray]:
    n = int(np.frombuffer(content, "<i4", 1)[0])
    counts = np.frombuffer(content, "<i4", n, 4).tolist()
    at, out = 4 + 4 * n, []
    for c in counts:
        size = int(np.frombuffer(content, "<i4", 1, at)[0])
        control = np.frombuffer(content, np.uint8, -(-c // 4), at + 4)
        out.append(decode_numbers(control, np.frombuffer(content, np.uint8, size, at + 4 + len(control)), c))
        at += 4 + len(control) + size
    return out


def pack_keys(keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted unsigned keys as their gaps, in one part of 32 bits, or two where gaps are wider."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    low, high = (gaps & np.uint64(0xFFFFFFFF)).astype(np.uint32), (gaps >> np.uint64(32)).astype(np.uint32)
    return (low, high) if high.any() else (low,)


def unpack_keys(parts) -> np.ndarray:
    gaps = parts[0].astype(np.uint64)
    if len(parts) > 1:
        gaps |= parts[1].astype(np.uint64) << np.uint64(32)
    return np.cumsum(gaps, dtype=np.uint64)


def pack_message(keys: np.ndarray, counts: np.ndarray) -> bytes:
    return pack_numbers(counts.astype(np.uint32), *pack_keys(keys))


def unpack_message(payload) -> tuple[np.ndarray, np.ndarray]:
    counts, *parts = unpack_numbers(payload)
    return unpack_keys(parts), counts.astype(np.int64)


def pack_sums(sums: np.ndarray) -> bytes:
    return pack_numbers(*pack_wide(sums.astype(np.uint64)))


def pack_wide(x: np.ndarray) -> tuple[np.ndarray, ...]:
    low, high = (x & np.uint64(0xFFFFFFFF)).astype(np.uint32), (x >> np.uint64(32)).astype(np.uint32)
    return (low, high) if high.any() else (low,)


def unpack_sums(payload) -> np.ndarray:
    parts = unpack_numbers(payload)
    out = parts[0].astype(np.int64)
    return out | parts[1].astype(np.int64) << 32 if len(parts) > 1 else out


def pack_flags(sums: np.ndarray) -> bytes:
    """For each key only whether its sum is over one."""
    return np.array([len(sums)], "<i4").tobytes() + np.packbits(sums > 1).tobytes()


def unpack_flags(payload) -> np.ndarray:
    return np.unpackbits(np.frombuffer(payload, np.uint8, -1, 4), count=int(np.frombuffer(payload, "<i4", 1)[0])).astype(np.int64) + 1


def by_block(answers: DataFrame, name: str) -> DataFrame:
    """Each block's answers as one array in the order of the keys' ranges: FAN at most."""
    return answers.where("block >= 0").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("part", "payload"))).alias(name))


def map_rows(rows: DataFrame, each, schema: str, *answers: DataFrame, flags: bool = False) -> DataFrame:
    """``each(row, *sums)`` yields Arrow batches of ``schema`` for each row (of blocks or bundles); sums: for each table of
    answers those of the keys that the row asked for, in their order (with ``flags`` two stands for more than one)."""
    names = [f"answers{k}" for k in range(len(answers))]
    for name, table in zip(names, answers):
        rows = rows.join(by_block(table, name), "block", "left")
    unpack = unpack_flags if flags else unpack_sums

    def sums(found) -> np.ndarray:
        got = [unpack(a["payload"].as_buffer()) for a in found.values] if found.is_valid else []
        return np.concatenate(got) if got else np.zeros(0, np.int64)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                yield from each(row, *(sums(row[name]) for name in names))

    return rows.mapInArrow(run, schema)


def map_blocks(blocks: DataFrame, each, schema: str, *answers: DataFrame, flags: bool = False) -> DataFrame:
    """``each(block, doc_ids, texts, *sums)``, otherwise as ``map_rows``."""
    return map_rows(blocks, lambda row, *sums: each(row["block"].as_py(), *block_texts(row["doc_ids"], row["ends"], row["text"]), *sums), schema, *answers, flags=flags)


MESSAGES = "part long, block long, payload binary"
ANSWERS = "part long, block long, payload binary, stat long"
BUNDLES = "block long, part long, blocks binary, ends binary, payload binary"


def exchange(rows: DataFrame, ask, shards: int, bits: int = 64, flags: bool = False, stat=None, done: int = 0) -> DataFrame:
    """A table of answers (ANSWERS) to all rows, for ``map_rows``. ``ask(row)``: the row's distinct keys of at most ``bits``
    bits, sorted, and their counts. ``stat(keys, sums)``: a number that each shard adds to column stat, in rows of block -1.
    ``done``: leading bits that levels before have told apart."""
    depth = max(1, (shards - 1).bit_length())
    level = min(done + FAN.bit_length() - 1, depth)
    shift = np.uint64(bits - level)

    def send(row):
        keys, counts = ask(row)
        if not len(keys):
            return
        part = keys >> shift
        cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
        payloads = [pack_message(keys[a:b], counts[a:b]) for a, b in zip(cuts, cuts[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]].astype(np.int64)), pa.array([row["block"].as_py()] * len(payloads), pa.int64()), pa.array(payloads, pa.binary())], ["part", "block", "payload"])

    sent = map_rows(rows, send, MESSAGES)
    pack = pack_flags if flags else pack_sums
    if level == depth:

        def total(found: pa.Table) -> pa.Table:
            part, blocks = found["part"][0].as_py(), found["block"].to_pylist()
            asked = [unpack_message(x.as_buffer()) for x in found["payload"]]
            keys, place, sums = summed(asked)
            ends = np.cumsum([len(k) for k, _ in asked])
            payloads = [pack(sums[x]) for x in np.split(place, ends[:-1])]
            pa.default_memory_pool().release_unused()
            stats = [None] * len(blocks) + [stat(keys, sums) if stat else 0]
            return pa.table([pa.array([part] * (len(blocks) + 1)), pa.array([*blocks, -1], pa.int64()), pa.array([*payloads, b""], pa.binary()), pa.array(stats, pa.int64())], ["part", "block", "payload", "stat"])

        return written(sent.groupBy("part").applyInArrow(total, ANSWERS), "answers")

    def bundle(batches):
        from pyspark import TaskContext

        task, number, part, blocks, held, size = TaskContext.get().partitionId(), 0, None, [], [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([task << 32 | number]), pa.array([part]), *(pa.array([x], pa.binary()) for x in (np.array(blocks, np.int64).tobytes(), np.cumsum([len(x) for x in held]).tobytes(), b"".join(held)))], ["block", "part", "blocks", "ends", "payload"])

        for batch in batches:
            for to, block, payload in zip(batch.column("part").to_pylist(), batch.column("block").to_pylist(), batch.column("payload").to_pylist()):
                if held and (to != part or size + len(payload) > BUNDLE_BYTES):
                    yield flush()
                    number, blocks, held, size = number + 1, [], [], 0
                part, size = to, size + len(payload)
                blocks.append(block)
                held.append(payload)
        if held:
            yield flush()

    parts = max(parallelism(rows.sparkSession), shards // 4)
    bundles = written(sent.repartition(parts, "part", F.pmod(F.xxhash64("block"), F.lit(max(1, parts >> level)))).sortWithinPartitions("part", "block").mapInArrow(bundle, BUNDLES), "bundles")

    def ask_next(row):
        keys, _, sums = summed(bundled(row["ends"].as_buffer(), row["payload"].as_buffer()))
        pa.default_memory_pool().release_unused()
        return keys, sums

    def hand_on(row, sums):
        asked = bundled(row["ends"].as_buffer(), row["payload"].as_buffer())
        _, place, _ = summed(asked)
        ends = np.cumsum([len(k) for k, _ in asked])
        del asked
        payloads = [pack(sums[x]) for x in np.split(place, ends[:-1])]
        pa.default_memory_pool().release_unused()
        blocks = np.frombuffer(row["blocks"].as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([row["part"].as_py()] * len(blocks)), pa.array(blocks), pa.array(payloads, pa.binary()), pa.nulls(len(blocks), pa.int64())], ["part", "block", "payload", "stat"])

    answers = exchange(bundles, ask_next, shards, bits, flags, stat, level)
    out = written(map_rows(bundles, hand_on, ANSWERS, answers, flags=flags).unionByName(answers.where("block < 0")), "answers")
    drop_table(bundles)
    drop_table(answers)
    return out


def bundled(ends, content) -> list[tuple[np.ndarray, np.ndarray]]:
    """The messages of a bundle."""
    ends = np.frombuffer(ends, np.int64).tolist()
    return [unpack_message(content.slice(a, b - a)) for a, b in zip([0, *ends[:-1]], ends)]


def summed(asked: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys of several messages, the place of each message's keys among them, and the keys' sums."""
    keys, place = np.unique(np.concatenate([k for k, _ in asked]), return_inverse=True)
    return keys, place, np.bincount(place, weights=np.concatenate([c for _, c in asked]), minlength=len(keys)).astype(np.int64)


def stat_of(answers: DataFrame) -> int:
    return answers.agg(F.sum("stat")).head()[0] or 0
