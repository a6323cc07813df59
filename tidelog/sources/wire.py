"""Binary formats of records, write-ahead files, manifest batches and blocks, for exchange with other tools.

Numbers are little endian. A record: id u64, key length u64, key, tag u8 (1 write, 0 delete), and for writes value
length u64 and value. A write-ahead file: per record its length u64 and the record; a cut-off tail ends it silently.
A manifest log: per batch its length u64, the batch and its CRC-32 u32; anything incomplete or altered is an error.
"""

from __future__ import annotations

import struct
import time
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.oplog import SCHEMA
from ..shipping import ship
from .files import Files

BLOCK, BLOCK_TRAILER = 4096, 8

Op = tuple[int, bytes, str, bytes | None]


def encode_record(op_id: int, key: bytes, op: str, value: bytes | None) -> bytes:
    head = struct.pack("<QQ", op_id, len(key)) + key
    if op == "D":
        return head + b"\x00"
    if op != "W" or value is None:
        raise ValueError(f"not an operation: {op!r}")
    return head + b"\x01" + struct.pack("<Q", len(value)) + value


def decode_record(data: bytes, at: int = 0) -> tuple[Op, int]:
    """The operation at a place and where it ends."""
    op_id, n = struct.unpack_from("<QQ", data, at)
    at += 16
    key, tag = data[at : at + n], data[at + n : at + n + 1]
    at += n + 1
    if tag == b"\x00":
        return (op_id, key, "D", None), at
    if tag != b"\x01":
        raise ValueError(f"unknown tag {tag!r}")
    (m,) = struct.unpack_from("<Q", data, at)
    at += 8
    if at + m > len(data):
        raise ValueError("value cut off")
    return (op_id, key, "W", data[at : at + m]), at + m


def encode_wal(ops: Iterable[Op]) -> bytes:
    return b"".join(struct.pack("<Q", len(r)) + r for r in (encode_record(*o) for o in ops))


def decode_wal(data: bytes) -> Iterator[Op]:
    at = 0
    while at + 8 <= len(data):
        (n,) = struct.unpack_from("<Q", data, at)
        at += 8
        if at + n > len(data):
            return
        yield decode_record(data, at)[0]
        at += n


def read_wal(spark: SparkSession, path: str) -> DataFrame:
    """A log from write-ahead files, each decoded by one task: lengths chain a file's records, so it cannot be entered in
    the middle, and ``append_wal`` writes a file a batch."""
    ship(spark)
    arrow = pa.schema([("op_id", pa.int64()), ("key", pa.binary()), ("op", pa.string()), ("value", pa.binary())])

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                part: list[Op] = []
                for op in decode_wal(content.as_py()):
                    part.append(op)
                    if len(part) == 10_000:
                        yield _batch(part, arrow)
                        part = []
                yield _batch(part, arrow)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, SCHEMA)


def append_wal(files: Files, folder: str, ops: Iterable[Op]) -> str:
    """One batch as a write-ahead file of its own, there whole or not at all; files sort in the order they were appended
    by one writer. Returns its name."""
    name = f"{folder}/{time.time_ns():020d}-{uuid.uuid4().hex}.wal"
    if not files.create(name, encode_wal(ops)):
        raise FileExistsError(name)
    return name


def _batch(ops: list[Op], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([o[k] for o in ops], f.type) for k, f in enumerate(schema)], schema=schema)


def encoded(log: DataFrame) -> DataFrame:
    """(op_id, record): each operation in the binary format."""
    ship(log.sparkSession)
    schema = pa.schema([("op_id", pa.int64()), ("record", pa.binary())])

    def run(batches):
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("op_id", "key", "op", "value")))
            yield pa.RecordBatch.from_arrays([b.column("op_id"), pa.array([encode_record(*r) for r in rows], pa.binary())], schema=schema)

    return log.select("op_id", F.col("key").cast("binary").alias("key"), "op", F.col("value").cast("binary").alias("value")).mapInArrow(run, "op_id long, record binary")


@dataclass(frozen=True)
class Change:
    index: int
    id: int
    change: str  # Add or Delete


@dataclass(frozen=True)
class Changes:
    """One compaction's changes of its input level and of the level below."""

    input_level: int
    inputs: tuple[Change, ...]
    targets: tuple[Change, ...]

    def encode(self) -> bytes:
        part = lambda cs: struct.pack("<Q", len(cs)) + b"".join(struct.pack("<QQB", c.index, c.id, ("Add", "Delete").index(c.change)) for c in cs)
        return struct.pack("<Q", self.input_level) + part(self.inputs) + part(self.targets)

    @staticmethod
    def decode(data: bytes) -> "Changes":
        (level,) = struct.unpack_from("<Q", data)
        at, parts = 8, []
        for _ in range(2):
            (n,) = struct.unpack_from("<Q", data, at)
            at += 8
            part = []
            for _ in range(n):
                index, file, tag = struct.unpack_from("<QQB", data, at)
                at += 17
                if tag > 1:
                    raise ValueError(f"unknown change {tag}")
                part.append(Change(index, file, ("Add", "Delete")[tag]))
            parts.append(tuple(part))
        return Changes(level, *parts)


def frame(payload: bytes) -> bytes:
    return struct.pack("<Q", len(payload)) + payload + struct.pack("<I", crc32(payload))


def frames(data: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        if at + 8 > len(data):
            raise ValueError("incomplete header")
        (n,) = struct.unpack_from("<Q", data, at)
        if at + 12 + n > len(data):
            raise ValueError("incomplete payload")
        payload = data[at + 8 : at + 8 + n]
        if struct.unpack_from("<I", data, at + 8 + n)[0] != crc32(payload):
            raise ValueError("checksum mismatch")
        yield payload
        at += 12 + n


def pack_blocks(records: Iterable[bytes], size: int = BLOCK) -> Iterator[bytes]:
    """Records in order into blocks of ``size`` bytes; the count stands in the last eight. Refuses larger records."""
    part, used, n = [], 0, 0
    for r in records:
        if len(r) + BLOCK_TRAILER > size:
            raise ValueError(f"record of {len(r)} bytes does not fit a block")
        if used + len(r) + BLOCK_TRAILER > size:
            yield b"".join(part).ljust(size - BLOCK_TRAILER, b"\x00") + struct.pack("<Q", n)
            part, used, n = [], 0, 0
        part.append(r)
        used, n = used + len(r), n + 1
    if n:
        yield b"".join(part).ljust(size - BLOCK_TRAILER, b"\x00") + struct.pack("<Q", n)


def fill_block(records: list[bytes], size: int = BLOCK) -> tuple[bytes, int]:
    """A block of the first records, as many as fit, and how many they are."""
    used = n = 0
    for r in records:
        if used + len(r) + BLOCK_TRAILER > size:
            break
        used, n = used + len(r), n + 1
    if not n:
        raise ValueError("no record, or the first does not fit a block")
    return next(pack_blocks(records[:n], size)), n


def encode_block_meta(first: bytes, last: bytes) -> bytes:
    """The key range of a block: both keys, each after its length."""
    return b"".join(struct.pack("<Q", len(k)) + k for k in (first, last))


def decode_block_meta(data: bytes, at: int = 0) -> tuple[tuple[bytes, bytes], int]:
    """Both keys and where they end."""
    keys = []
    for _ in range(2):
        (n,) = struct.unpack_from("<Q", data, at)
        if at + 8 + n > len(data):
            raise ValueError("key cut off")
        keys.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    return (keys[0], keys[1]), at


def fill_table(ops: list[Op], block_num_limit: int, size: int = BLOCK) -> tuple[list[bytes], list[bytes], int]:
    """Blocks of operations in order, until the table has ``block_num_limit`` of them: the blocks, their encoded key
    ranges, and how many operations they hold."""
    blocks, metas, done = [], [], 0
    while done < len(ops) and len(blocks) < block_num_limit:
        block, n = fill_block([encode_record(*o) for o in ops[done : done + size // 17]], size)
        blocks.append(block)
        metas.append(encode_block_meta(ops[done][1], ops[done + n - 1][1]))
        done += n
    return blocks, metas, done


def first_key(block: bytes) -> bytes | None:
    """Of the block's first record; None for an empty block."""
    return next((op[1] for op in read_block(block)), None)


def block_stats(log: DataFrame, size: int = BLOCK) -> DataFrame:
    """(partition, block, n_records, first_key, last_key): a sorted log packed into blocks, each partition by itself."""
    ship(log.sparkSession)
    schema = pa.schema([("partition", pa.int32()), ("block", pa.int64()), ("n_records", pa.int64()), ("first_key", pa.binary()), ("last_key", pa.binary())])

    def run(batches):
        left: list[Op] = []
        number, part = 0, None

        def take(whole: bool):
            nonlocal left, number
            rows = []
            while left:
                block, n = fill_block([encode_record(*o) for o in left[: size // 17 + 1]], size)
                if n == len(left) and not whole:
                    break
                held = [o[1] for o in read_block(block)]
                rows.append((part, number, len(held), held[0], held[-1]))
                left, number = left[n:], number + 1
            return rows

        for b in batches:
            part = b.column("part")[0].as_py() if b.num_rows else part
            left += zip(*(b.column(c).to_pylist() for c in ("op_id", "key", "op", "value")))
            yield _batch(take(False), schema)
        yield _batch(take(True), schema)

    return log.select(F.spark_partition_id().alias("part"), "op_id", F.col("key").cast("binary").alias("key"), "op", F.col("value").cast("binary").alias("value")).mapInArrow(run, "partition int, block long, n_records long, first_key binary, last_key binary")


def read_block(block: bytes) -> Iterator[Op]:
    at = 0
    for _ in range(struct.unpack("<Q", block[-8:])[0]):
        op, at = decode_record(block, at)
        yield op
