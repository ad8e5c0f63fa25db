"""Token ids in length-delimited binary files with an offset index.

A file is a row of records in ascending key order, and files hold ranges of keys. A record is

    8 bytes   n, the length of the payload, little-endian
    4 bytes   masked CRC-32 of those 8 bytes
    n bytes   payload: 1 byte flags (1: there is a key, 2: ids have four bytes, else two),
              8 bytes key, ids, all little-endian
    4 bytes   masked CRC-32 of the payload
    1 byte    0x0A

The last byte is the line separator of Spark's text sink. Through it the files go to any file
system that Spark can write, and only whole files of tasks that succeeded appear, whichever
executors are lost on the way. They are read by Spark's binary source.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkcurate.llm.bpe import load_encoder, load_tokenizer
from sparkcurate.llm.common import map_texts
from sparkcurate.session import application_folder

# The rotation and the constant of the usual masked checksum.
MASK_SHIFT = 15
MASK_ADD = 0xA282EAD8

HAS_KEY, WIDE = 1, 2
HEAD = struct.Struct("<QI")
START = struct.Struct("<Bq")
END = b"\n"

#: Bytes of text per file; ids of two bytes take about as much.
FILE_BYTES = 24_000_000


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> MASK_SHIFT | crc << (32 - MASK_SHIFT)) + MASK_ADD) & 0xFFFFFFFF


def frame(key: int | None, ids: np.ndarray, wide: bool) -> bytes:
    """A record without its last byte."""
    flags = (key is not None) * HAS_KEY | wide * WIDE
    payload = START.pack(flags, key or 0) + ids.astype("<u4" if wide else "<u2").tobytes()
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked_crc(length)) + payload + struct.pack("<I", masked_crc(payload))


def unframe(data: bytes, offset: int) -> tuple[int | None, np.ndarray, int]:
    """Key, ids and end of the record at an offset; a damaged one raises ValueError."""
    length, check = HEAD.unpack_from(data, offset)
    if masked_crc(data[offset : offset + 8]) != check:
        raise ValueError(f"the length at {offset} is damaged")
    at = offset + HEAD.size
    payload, end = data[at : at + length], at + length + 4
    if masked_crc(payload) != struct.unpack_from("<I", data, end - 4)[0] or data[end : end + 1] != END:
        raise ValueError(f"the record at {offset} is damaged")
    flags, key = START.unpack_from(payload)
    ids = np.frombuffer(payload, "<u4" if flags & WIDE else "<u2", offset=START.size)
    return (key if flags & HAS_KEY else None), ids.astype("<u4"), end + 1


def write_records(
    docs: DataFrame, folder: str, path: str, end_id: int, pattern: str | None = None, key: str = "doc_id",
    text: str = "text", file_bytes: int = FILE_BYTES,
) -> None:
    """Encode every whole text, append ``end_id`` and write the files of ``folder``.

    ``key`` is a whole number. Null keys come first; rows with the same key follow one another
    by a hash of the text; a null text is empty and gives a record with the end id alone; an empty table gives
    no record. Other columns are not read.

    The one shuffle moves texts into ranges of about ``file_bytes`` each, so that a file is written, and later
    read, by one task in bounded memory. The ranges go by key, hash and place in the input, so that neither rows
    of one key nor rows that are equal have to be in one file.
    """
    slim = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = slim.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    placed = slim.select("key", "text", F.xxhash64("text").alias("mark"), F.monotonically_increasing_id().alias("place"))
    order = ["key", "mark", "place"]
    sorted_ = placed.repartitionByRange(total // file_bytes + 1, *order).sortWithinPartitions(*order).select("key", "text")

    def make():
        tokenizer = load_tokenizer(path, pattern)
        encode = load_encoder(path, pattern)
        wide = max(tokenizer.get_vocab_size(), end_id + 1) > 1 << 16
        last = np.array([end_id], "<u4")

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            records = [
                frame(k, np.concatenate([np.frombuffer(encode(t), "<u4"), last]), wide)
                for k, t in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist())
            ]
            return pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], ["record"])

        return work

    records = map_texts(sorted_, make, "record binary")
    records.select(F.col("record").cast("string").alias("value")).write.mode("overwrite").option(
        "lineSep", END.decode()
    ).option("compression", "none").text(folder)


def _rows(data: bytes, offsets: list[int] | None) -> Iterator[tuple]:
    if offsets is not None:
        for offset in offsets:
            key, ids, end = unframe(data, offset)
            yield offset, end - offset, key, ids
        return
    offset = 0
    while offset < len(data):
        key, ids, end = unframe(data, offset)
        yield offset, end - offset, key, ids
        offset = end


def read_records(spark, folder: str, wanted: DataFrame | None = None, with_ids: bool = True) -> DataFrame:
    """Records of a folder: file, offset, length, key, n_tokens, before, ids_crc32 and, on request, ids.

    ``before`` is the number of ids of the file that come before the record. ``wanted`` names records
    (file, offset), say a shuffled part of the index; only those are parsed, and ``before``
    then counts the wanted ones. Every checksum is verified; damage fails the job.
    """
    name = F.element_at(F.split("path", "/"), -1).alias("file")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select(name, "content")
    picked = wanted is not None
    if picked:
        places = wanted.groupBy("file").agg(F.sort_array(F.collect_list("offset")).alias("offsets"))
        files = files.join(places, "file")
    schema = "file string, offset long, length long, key long, n_tokens long, before long, ids_crc32 long"
    schema += ", ids array<int>" if with_ids else ""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column("content")[i].as_buffer()
                data = b"" if data is None else data.to_pybytes()
                places = batch.column("offsets")[i].as_py() if picked else None
                yield from _tables(batch.column("file")[i].as_py(), data, places)

    def _tables(file: str, data: bytes, places: list[int] | None):
        before, rows = 0, []
        for offset, length, key, ids in _rows(data, places):
            row = [file, offset, length, key, len(ids), before, zlib.crc32(ids.tobytes())]
            rows.append(row + [ids.astype(np.int32)] * with_ids)
            before += len(ids)
            if len(rows) == 2000:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    def _batch(rows: list) -> pa.RecordBatch:
        types = [pa.string(), *[pa.int64()] * 6, pa.list_(pa.int32())]
        names = ["file", "offset", "length", "key", "n_tokens", "before", "ids_crc32", "ids"]
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(columns, types)], names[: len(columns)]
        )

    return files.mapInArrow(run, schema)


def write_index(spark, folder: str, index: str) -> DataFrame:
    """Read the files once and write the index: file, offset, length, key, n_tokens, ids_crc32, start.

    ``start`` is the number of ids of all records before, over all files, which are numbered in their order by
    their names. The sums go over one row per file.
    """
    path = f"{index}/records"
    read_records(spark, folder, with_ids=False).write.mode("overwrite").parquet(path)
    records = spark.read.parquet(path)
    files = records.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    number = F.regexp_extract("file", "part-([0-9]+)", 1).cast("int")
    order = Window.orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("file", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    starts.write.mode("overwrite").parquet(f"{index}/files")
    return read_index(spark, index)


def read_index(spark, index: str) -> DataFrame:
    records = spark.read.parquet(f"{index}/records")
    return records.join(spark.read.parquet(f"{index}/files"), "file").select(
        "file", "offset", "length", "key", "n_tokens", "ids_crc32", (F.col("base") + F.col("before")).alias("start")
    )


def op9_records(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{application_folder(spark)}/records-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    write_records(docs, f"{folder}/files", public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return write_index(spark, f"{folder}/files", f"{folder}/index").select(
        F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32"
    )
