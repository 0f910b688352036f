"""The write-ahead record format: u16 key length, key, u64 timestamp, u16 value length, value, u32 crc, big-endian.

The checksum is taken over the same fields with the numbers in little-endian order, as the format has it on the machines
that write it. A record cut off at the end of a file was never acknowledged and is left out; a whole record with a wrong
checksum is an error.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def checksum(key: bytes, ts: int, value: bytes) -> int:
    return zlib.crc32(struct.pack("<H", len(key)) + key + struct.pack("<QH", ts, len(value)) + value)


def encode_wal(rows: list[tuple[bytes, int, bytes]]) -> bytes:
    """Keys and values of at most 65,535 bytes; longer ones are a struct.error."""
    return b"".join(struct.pack(">H", len(k)) + k + struct.pack(">QH", ts, len(v)) + v + struct.pack(">I", checksum(k, ts, v)) for k, ts, v in rows)


def records(data: bytes) -> Iterator[tuple[bytes, int, bytes]]:
    at = 0
    while at + 2 <= len(data):
        value_at = at + 2 + struct.unpack_from(">H", data, at)[0] + 10
        if value_at > len(data):
            return
        ts, m = struct.unpack_from(">QH", data, value_at - 10)
        end = value_at + m
        if end + 4 > len(data):
            return
        key, value = data[at + 2 : value_at - 10], data[value_at:end]
        if struct.unpack_from(">I", data, end)[0] != checksum(key, ts, value):
            raise ValueError(f"checksum mismatch at byte {at}")
        yield key, ts, value
        at = end + 4


class WalWriter:
    """Appends to numbered segments of a local folder. A segment is closed beyond `segment_bytes`, which bounds what a
    reader holds of one file."""

    def __init__(self, folder: str, segment_bytes: int = 64 << 20):
        self.folder, self.segment_bytes = Path(folder), segment_bytes
        self.folder.mkdir(parents=True, exist_ok=True)
        self.number = max((int(p.stem) for p in self.folder.glob("*.wal")), default=-1) + 1  # a torn tail is never appended to
        self.out = None

    def append(self, rows: list[tuple[bytes, int, bytes]]) -> None:
        for row in rows:
            self.out = self.out or open(self.folder / f"{self.number:08d}.wal", "ab")
            self.out.write(encode_wal([row]))
            if self.out.tell() > self.segment_bytes:
                self.close()
                self.number += 1

    def sync(self) -> None:
        if self.out:
            self.out.flush()
            os.fsync(self.out.fileno())

    def close(self) -> None:
        if self.out:
            self.sync()
            self.out.close()
            self.out = None


def recover(folder: str) -> Iterator[tuple[bytes, int, bytes]]:
    """The records of all segments in order."""
    for p in sorted(Path(folder).glob("*.wal")):
        yield from records(p.read_bytes())


def decode_wal(spark: SparkSession, path: str) -> DataFrame:
    """versions from log files; one task per file, which is one value in memory."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data in b["content"]:
                yield pd.DataFrame(list(records(bytes(data))), columns=["key", "ts", "value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, "key binary, ts long, value binary")
