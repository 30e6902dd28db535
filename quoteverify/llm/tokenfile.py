"""Token ids in binary files: frequency-ranked ids in byte-aligned variable-length coding.

Each id is replaced by its rank by corpus frequency, so common ids take one byte. Control bytes hold two bits for each
of four ranks (its bytes less one) and stand apart from the data bytes, so a reader finds every rank's place by a
table lookup and a running sum, all in numpy.

A file holds shards of documents, each in ascending doc_id order, one after the other; files ascend by the names of
their folder (one for each range of doc_ids) and of themselves, and each shard tells its own place. Layout of a shard,
little-endian: magic ``TKF1``, four 64-bit numbers (ids of all documents before the file, documents, ids, data
bytes), doc_ids (64 bits each), lengths (64 bits each), control bytes, data bytes, then one byte 0x0A. The folder
``ranks`` has one file of the same kind whose ids are the vocabulary in rank order, coded without ranking.

The shards are written by Spark's own writer, so a lost task leaves no half file. Bytes pass through a text column
only because that writer puts the bytes of a column into a file as they are.

Edge cases: a null or empty text holds the end id alone; rows with a null doc_id take no part; repeated doc_ids stand
beside each other, shorter first; texts that hold one of the tokenizer's added tokens follow
the library's defaults; an empty table writes no shard and reads back as no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_BYTES, drop_path, parallelism, slices, texts_of, work_path
from .tokens import crc32, encoder, tokenizer_path, with_end

MAGIC = b"TKF1"
#: Ids in a shard, about; a longer document is still kept whole.
SHARD_IDS = 2 << 20
#: Shards in a file at most, as a reader takes a file as a whole.
SHARDS_PER_FILE = 16

#: For each control byte the sizes of its four numbers, and their sum.
SIZES = np.stack([(np.arange(256) >> s & 3) + 1 for s in (0, 2, 4, 6)], axis=1).astype(np.int64)
TOTALS = SIZES.sum(axis=1)


def encode_numbers(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes and data bytes of unsigned 32-bit numbers."""
    numbers = np.ascontiguousarray(numbers, "<u4")
    size = 1 + (numbers > 0xFF).astype(np.uint8) + (numbers > 0xFFFF) + (numbers > 0xFFFFFF)
    data = numbers.view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8) < size[:, None]]
    codes = np.zeros(-(-len(numbers) // 4) * 4, np.uint8)
    codes[: len(numbers)] = size - 1
    codes = codes.reshape(-1, 4)
    return codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6, data


def decode_numbers(control: np.ndarray, data: np.ndarray, count: int) -> np.ndarray:
    sizes = SIZES[control].ravel()[:count]
    starts = np.cumsum(sizes) - sizes
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    out = padded[starts].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(sizes > k)
        out[more] |= padded[starts[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def encode_shard(start: int, doc_ids: np.ndarray, lengths: np.ndarray, numbers: np.ndarray) -> bytes:
    control, data = encode_numbers(numbers)
    head = np.array([start, len(doc_ids), len(numbers), len(data)], "<i8")
    return b"".join([MAGIC, head.tobytes(), doc_ids.astype("<i8").tobytes(), lengths.astype("<i8").tobytes(), control.tobytes(), data.tobytes()])


def decode_shards(content: bytes):
    """(start, doc_ids, lengths, numbers) of each shard in a file's bytes."""
    at = 0
    while at < len(content):
        if content[at : at + 4] != MAGIC:
            raise ValueError("not a token file")
        start, docs, ids, size = np.frombuffer(content, "<i8", 4, at + 4).tolist()
        at += 36
        doc_ids, lengths = np.frombuffer(content, "<i8", docs, at), np.frombuffer(content, "<i8", docs, at + 8 * docs)
        at += 16 * docs
        control = np.frombuffer(content, np.uint8, -(-ids // 4), at)
        data = np.frombuffer(content, np.uint8, size, at + len(control))
        at += len(control) + size + 1
        yield start, doc_ids, lengths, decode_numbers(control, data, ids)


def _write(df: DataFrame, path: str) -> None:
    df.sortWithinPartitions("part", "shard").select("part", F.col("payload").cast("string").alias("payload")).write.option("compression", "none").option("maxRecordsPerFile", SHARDS_PER_FILE).partitionBy("part").text(path)


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2) -> None:
    """Encodes all documents and writes the files below ``path``."""
    spark = docs.sparkSession
    tokenizer = tokenizer or tokenizer_path("byte_bpe_50k.json")
    raw = work_path(spark, "ids")
    size = max(encoder(tokenizer).size, end_id + 1)

    def tokenize(batches):
        from pyspark import TaskContext

        part, held, ids_held, number, before = TaskContext.get().partitionId(), [], 0, 0, 0

        def flush():
            doc_ids, lengths, ids = (np.concatenate(x) for x in zip(*held))
            return pa.RecordBatch.from_arrays([pa.array([f"{part:08d}-{number:06d}"]), pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([len(ids)], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (doc_ids, lengths, ids.astype("<u2" if size <= 1 << 16 else "<u4")))], ["shard", "part", "before", "n", "doc_ids", "lengths", "ids"])

        for batch in slices(batches, BATCH_BYTES):
            ids, bounds = with_end(*encoder(tokenizer).encode(batch.column("text")), end_id)
            held.append((batch.column("doc_id").to_numpy(), np.diff(bounds), ids))
            ids_held += len(ids)
            if ids_held >= SHARD_IDS:
                yield flush()
                held, ids_held, number, before = [], 0, number + 1, before + ids_held
        if held:
            yield flush()

    ordered = texts_of(docs).repartitionByRange(max(2, parallelism(spark)), "doc_id").sortWithinPartitions("doc_id", F.length("text"), "text")
    ordered.mapInArrow(tokenize, "shard string, part int, before long, n long, doc_ids binary, lengths binary, ids binary").write.option("compression", "zstd").parquet(raw)
    table = spark.read.parquet(raw)
    kind = "<u2" if size <= 1 << 16 else "<u4"

    def count(batches):
        counts = np.zeros(size, np.int64)
        for batch in batches:
            for ids in batch.column("ids"):
                counts += np.bincount(np.frombuffer(ids.as_buffer(), kind), minlength=size)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["id", "n"])

    counts = np.zeros(size, np.int64)
    for r in table.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator():  # no more rows than the vocabulary
        counts[r["id"]] = r["n"]
    by_rank = np.lexsort((np.arange(size), -counts))
    ranks = np.empty(size, np.uint32)
    ranks[by_rank] = np.arange(size)
    starts, total = {}, 0
    for r in sorted(table.groupBy("part").agg(F.sum("n").alias("n")).collect()):  # one row a partition
        starts[r["part"]], total = total, total + r["n"]
    shared = spark.sparkContext.broadcast((ranks, starts))

    def encode(batches):
        ranks, starts = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                shard, part, before, *arrays = (batch.column(c)[row] for c in ("shard", "part", "before", "doc_ids", "lengths", "ids"))
                doc_ids, lengths, ids = (np.frombuffer(a.as_buffer(), t) for a, t in zip(arrays, ("<i8", "<i8", kind)))
                yield pa.RecordBatch.from_arrays([pa.array([f"{part.as_py():08d}"]), pa.array([shard.as_py()]), pa.array([encode_shard(starts[part.as_py()] + before.as_py(), doc_ids, lengths, ranks[ids])], pa.binary())], ["part", "shard", "payload"])

    _write(table.mapInArrow(encode, "part string, shard string, payload binary"), f"{path}/shards")
    _write(spark.createDataFrame([("ranks", "ranks", bytearray(encode_shard(0, np.zeros(1, np.int64), np.array([size]), by_rank)))], "part string, shard string, payload binary"), f"{path}/ranks")
    drop_path(spark, raw)


def read_tokens(spark: SparkSession, path: str, each, schema: str) -> DataFrame:
    """Reads the files back: ``each(start, doc_ids, lengths, ids)`` gives an Arrow batch of ``schema`` for each shard."""
    files = lambda sub: spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(f"{path}/{sub}").select("content")
    by_rank = next(decode_shards(bytes(files("ranks").head()["content"])))[3]
    shared = spark.sparkContext.broadcast(by_rank)

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                for start, doc_ids, lengths, numbers in decode_shards(content.as_buffer().to_pybytes()):
                    yield each(start, doc_ids, lengths, shared.value[numbers])

    return files("shards").mapInArrow(run, schema)


def digests(start: int, doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    ends = np.cumsum(lengths)
    begins = ends - lengths
    sums = [crc32(ids[a:b]) for a, b in zip(begins.tolist(), ends.tolist())]
    return pa.RecordBatch.from_arrays([pa.array(doc_ids), pa.array(start + begins), pa.array(lengths), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_file_digests(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Writes the files to the shared folder and returns, from them alone, each document's start, length and checksum."""
    spark = docs.sparkSession
    path = work_path(spark, "tokens")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    write_tokens(docs, path, tokenizer, end_id)
    return read_tokens(spark, path, digests, schema)
