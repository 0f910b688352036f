"""Token ids of whole texts, and sequences of equal length in Arrow files.

A shard is a pair of Arrow files: `.seq.arrow` holds fixed-size-list columns `ids` and `mask` of `length` values a row
in the random-access file format, so that any sequence is a view of the mapped file; `.doc.arrow` holds (doc_id, start,
n_tokens) of the documents in it. Shards follow each other in doc_id order, as do documents in a shard. The last
sequence of a shard is filled with id 0 where its mask is false.

Rows: a null text is an empty one and gives its end id alone; null doc_ids come first; repeated doc_ids are ordered by
text and each keeps a row; an empty table gives no shard; only doc_id and text are read.
"""

from __future__ import annotations

import json
import os
import re
import string
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import repeat
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import located, scratch, ship

END = b"\0\0\0\0"
ROWS = 256
#: Pieces that an encoder keeps, and the bytes of the longest of them.
MOST, LONGEST = 200_000, 64
#: Pieces that are looked up at once.
STEP = 1 << 20
#: Pieces of one line end and one word or number, each at most once: what the regular expression makes of them is known.
KNOWN = re.compile("(\n)?( ?(?:[A-Za-zÀ-ÖØ-öø-ɏ]+|[0-9]+))?")
#: Types of doc_id that files hold as 64-bit numbers; any other is held as a string, in the order of its own type.
WHOLE = ("tinyint", "smallint", "int", "bigint")
_workers: dict = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(chars: str) -> np.ndarray:
    """Whether a byte is one of these ASCII characters."""
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


LETTERS = string.ascii_letters + string.digits
SPACE, MARK, WORD, SOLID = table(" \n"), table(string.punctuation), table(LETTERS), table(LETTERS + string.punctuation)


def byte_names() -> dict[int, str]:
    """The character that stands for each byte in the tokens of byte-level BPE."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def boundaries(data: np.ndarray) -> np.ndarray:
    """Where bytes of UTF-8 can be cut so that byte-level BPE makes of the parts what it makes of the whole: before a
    space or line end after what is no white space, and before a mark after a letter or digit. No piece of its regular
    expression reaches over such a place, nor looks beyond it. Characters beyond ASCII count as letters or as no white
    space only in blocks without exceptions; elsewhere nothing is cut."""
    word, solid = WORD[data], SOLID[data]
    if (data >= 0x80).any():
        one, last = data[:-1], data[1:]
        word[1:] |= ((one >= 0xC4) & (one <= 0xC9)) | ((one == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7))  # U+00C0 to U+027F but two marks
        solid[1:] |= (one >= 0xC3) & (one <= 0xDF)
        solid[2:] |= data[:-2] >= 0xE4
        solid[3:] |= data[:-3] >= 0xF0
    out = np.zeros(len(data), bool)
    out[1:] = (SPACE[data[1:]] & solid[:-1]) | (MARK[data[1:]] & word[:-1])
    return out


class Encoder:
    """Encodes with the tokenizers library. For byte-level BPE texts are cut into pieces that the library encodes apart,
    and what it made of a piece is kept, up to MOST pieces, for later ones. Texts that hold an added token are encoded as
    they are, and so is every text for any other tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        made = json.loads(self.tok.to_str())
        before = made["pre_tokenizer"] or {}
        self.level = made["model"]["type"] == "BPE" and not made["model"].get("dropout") and not any(made[k] for k in ("normalizer", "truncation", "padding", "post_processor"))
        self.level &= before.get("type") == "ByteLevel" and not before["add_prefix_space"] and before.get("use_regex", True)
        self.model, self.names = self.tok.model, byte_names()
        self.kept: dict[bytes, int] = {}
        self.ids, self.ends = np.empty(0, "<u4"), np.zeros(1, np.int64)  # of kept pieces, one after another

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for a in range(0, len(texts), 2000) for e in self.tok.encode_batch_fast(texts[a : a + 2000], add_special_tokens=False)]

    def made(self, words: list[bytes]) -> tuple[np.ndarray, list[int]]:
        """(ids, number of ids of each word). Where the regular expression's parts are known, the library's model gets them at once."""
        tokenize, ids, counts, others = self.model.tokenize, [], [], []
        for k, w in enumerate(words):
            if w[:1] == b" " and w[1:].isalpha():  # of bytes: A-Z and a-z
                got = [t.id for t in tokenize("Ġ" + w[1:].decode())]
            elif known := KNOWN.fullmatch(w.decode()):
                got = [t.id for p in known.groups() if p for t in tokenize(p.encode().decode("latin-1").translate(self.names))]
            else:
                others.append((k, len(ids)))
                got = []
            ids += got
            counts.append(len(got))
        ids = np.array(ids, "<u4")
        if others:
            rest = [np.frombuffer(x, "<u4") for x in self.whole([words[k].decode() for k, _ in others])]
            ids = np.insert(ids, np.repeat([at for _, at in others], [len(x) for x in rest]), np.concatenate(rest))
            for (k, _), x in zip(others, rest):
                counts[k] = len(x)
        return ids, counts

    def looked_up(self, data: pa.Buffer, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each piece) of the pieces between cuts."""
        pieces = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), data]).dictionary_encode()
        words = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = np.fromiter(map(self.kept.get, words, repeat(-1)), np.int64, len(words))
        ids, ends, new = self.ids, self.ends, np.flatnonzero(at < 0)
        if len(new):
            long = np.array([len(words[i]) > LONGEST for i in new.tolist()])
            new = new[np.argsort(long, kind="stable")]  # those that may be kept come first
            at[new] = len(self.kept) + np.arange(len(new))
            missed = [words[i] for i in new.tolist()]
            got, counts = self.made(missed)
            ids, ends = np.concatenate([ids, got]), np.concatenate([ends, ends[-1] + np.cumsum(counts)])
            room = max(0, min(len(new) - int(long.sum()), MOST - len(self.kept)))
            self.kept.update(zip(missed[:room], range(len(self.kept), MOST)))
            self.ids, self.ends = ids[: ends[len(self.kept)]], ends[: len(self.kept) + 1]
        at = at[pieces.indices.to_numpy()]
        start = ends[at]
        n = ends[at + 1] - start
        where = np.repeat(start - np.cumsum(n) + n, n)
        where += np.arange(len(where))
        return ids[where], n

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        odd = [not self.level or any(s in t for s in self.special) for t in texts]
        rest = iter(self.whole([t for t, o in zip(texts, odd) if o]))
        data = [b"" if o else t.encode() for t, o in zip(texts, odd)]
        sizes = np.cumsum([0, *map(len, data)])
        joined = b"".join(data)
        begins = boundaries(np.frombuffer(joined, np.uint8))
        begins[sizes[sizes < len(joined)]] = True
        cuts = np.append(np.flatnonzero(begins), len(joined))
        steps = [self.looked_up(pa.py_buffer(joined), cuts[a : a + STEP + 1]) for a in range(0, len(cuts) - 1, STEP)]
        ids = np.concatenate([np.empty(0, "<u4"), *(i for i, _ in steps)])
        ends = np.append(0, np.cumsum(np.concatenate([np.empty(0, np.int64), *(n for _, n in steps)])))
        at = ends[np.searchsorted(cuts, sizes)].tolist()
        return [next(rest) if o else ids[a:z].tobytes() for o, a, z in zip(odd, at, at[1:])]


def encoder(path: str) -> Encoder:
    if path not in _workers:
        _workers[path] = Encoder(path)
    return _workers[path]


def chunks(batches: Iterable[pa.RecordBatch], size: int = 1 << 20) -> Iterator[tuple[pa.Array, list[str]]]:
    """(doc_ids, texts) of batches of these two columns in parts of about so many characters, whatever the batches hold."""
    ids, part, used = [], [], 0
    for b in batches:
        at = 0
        for i, t in enumerate(b.column(1).to_pylist(), 1):
            part.append(t or "")
            used += len(part[-1])
            if used >= size:
                yield pa.concat_arrays([*ids, b.column(0).slice(at, i - at)]), part
                ids, part, used, at = [], [], 0, i
        ids.append(b.column(0).slice(at))
    if part:
        yield pa.concat_arrays(ids), part


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a whole address; Hadoop's names of S3 are Arrow's one."""
    scheme = urlparse(uri).scheme
    if scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(uri).path
    return fs.FileSystem.from_uri(f"s3{uri[len(scheme) :]}" if scheme in ("s3a", "s3n") else uri)


def whole_address(spark: SparkSession, folder: str) -> str:
    """folder with the scheme and host that Hadoop finds for it: those of fs.defaultFS, and what viewfs stands for."""
    system, path = located(spark, folder)
    system.mkdirs(path)
    return system.resolvePath(path).toString()


class ShardWriter:
    def __init__(self, uri: str, length: int, doc_type: pa.DataType, width: pa.DataType):
        self.uri, self.length, self.type = uri, length, width
        self.fs, base = filesystem(uri)
        self.base = base
        self.fs.create_dir(base.rpartition("/")[0], recursive=True)
        self.kind = np.dtype(width.to_pandas_dtype())
        self.schema = pa.schema([("ids", pa.list_(width, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.index = pa.schema([("doc_id", doc_type), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.sink, self.sink2 = self.fs.open_output_stream(f"{base}.seq.arrow"), self.fs.open_output_stream(f"{base}.doc.arrow")
        self.out, self.out2 = ipc.new_file(self.sink, self.schema), ipc.new_file(self.sink2, self.index)
        self.wait, self.held, self.tokens, self.docs = [], 0, 0, 0

    def add(self, doc_ids: pa.Array, ids: list[np.ndarray]) -> None:
        n = np.array([len(x) for x in ids], np.int64)
        start = self.tokens + np.cumsum(n) - n
        self.out2.write_batch(pa.RecordBatch.from_arrays([doc_ids, pa.array(start), pa.array(n)], schema=self.index))
        self.wait += [x.astype(self.kind) for x in ids]
        self.held += int(n.sum())
        self.tokens += int(n.sum())
        self.docs += len(ids)
        if self.held >= ROWS * self.length:
            self.flush(False)

    def flush(self, last: bool) -> None:
        flat = np.concatenate(self.wait) if self.wait else np.empty(0, self.kind)
        block = ROWS * self.length
        cut = len(flat) if last else len(flat) // block * block
        for a in range(0, cut, block):
            part = flat[a : min(a + block, cut)]
            rows = -(-len(part) // self.length)
            full = np.zeros(rows * self.length, self.kind)
            full[: len(part)] = part
            mask = np.arange(len(full)) < len(part)
            self.out.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(v), self.length) for v in (full, mask)], schema=self.schema))
        self.wait, self.held = [flat[cut:]], len(flat) - cut

    def close(self) -> None:
        self.flush(True)
        for x in (self.out, self.out2, self.sink, self.sink2):
            x.close()


class Shard:
    """Random access to a shard. On a local disk the file is mapped, and sequences are views of it."""

    def __init__(self, uri: str):
        f, base = filesystem(uri)
        opened = (lambda p: pa.memory_map(p)) if isinstance(f, fs.LocalFileSystem) else f.open_input_file
        self.seq, self.doc = ipc.open_file(opened(f"{base}.seq.arrow")), ipc.open_file(opened(f"{base}.doc.arrow"))
        self.length = self.seq.schema.field("ids").type.list_size
        self.at, self.flat = -1, None

    def batch(self, i: int) -> np.ndarray:
        if i != self.at:
            self.at, self.flat = i, self.seq.get_batch(i).column(0).flatten().to_numpy(zero_copy_only=True)
        return self.flat

    def sequence(self, i: int) -> np.ndarray:
        return self.batch(i // ROWS)[i % ROWS * self.length : (i % ROWS + 1) * self.length]

    def mask(self, i: int) -> np.ndarray:
        return self.seq.get_batch(i // ROWS).column(1)[i % ROWS].values.to_numpy(zero_copy_only=False)

    def tokens(self, start: int, n: int) -> np.ndarray:
        block, out = ROWS * self.length, []
        while n > 0:
            part = self.batch(start // block)[start % block : start % block + n]
            out.append(part)
            start, n = start + len(part), n - len(part)
        return out[0] if len(out) == 1 else np.concatenate(out or [np.empty(0, np.uint16)])

    def documents(self) -> Iterator[pa.RecordBatch]:
        for i in range(self.doc.num_record_batches):
            yield self.doc.get_batch(i)


def write_shards(docs: DataFrame, folder: str, vocabulary: str, length: int = 2048) -> list[tuple[str, int, int]]:
    """Writes shards and returns (path, documents, ids) of each in order. A task that runs again writes new files; only
    those of the attempt that Spark counts are listed."""
    spark = docs.sparkSession
    ship(spark)
    folder = whole_address(spark, folder)
    whole = docs.schema["doc_id"].dataType.simpleString() in WHOLE
    kind = pa.int64() if whole else pa.string()
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint" if whole else "string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encode, out = TaskContext.get().partitionId(), encoder(vocabulary), None
        width = pa.uint16() if encode.tok.get_vocab_size() <= 65536 else pa.uint32()
        for ids, texts in chunks(batches):
            out = out or ShardWriter(f"{folder}/{part:06d}-{uuid.uuid4().hex}", length, kind, width)
            out.add(ids, [np.frombuffer(x + END, "<u4") for x in encode(texts)])
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [out.uri], "docs": [out.docs], "tokens": [out.tokens]})

    rows = ordered.mapInArrow(run, "part long, path string, docs long, tokens long").collect()
    return [(r.path, r.docs, r.tokens) for r in sorted(rows, key=lambda r: r.part)]


def read_shards(spark, shards: list[tuple[str, int, int]], doc_type: str = "bigint") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files alone."""
    ship(spark)
    before, rows = 0, []
    for path, _, n in shards:
        rows.append((path, before))
        before += n
    schema = f"doc_id {doc_type}, start long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                shard = Shard(path)
                for d in shard.documents():
                    start, n = d.column(1).to_numpy(), d.column(2).to_numpy()
                    crc = [zlib.crc32(shard.tokens(s, k).astype("<u4").tobytes()) for s, k in zip(start.tolist(), n.tolist())]
                    yield pa.RecordBatch.from_arrays([d.column(0), pa.array(start + base), d.column(2), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    listed = spark.createDataFrame(rows, "path string, base long")
    return listed.repartition(max(1, len(rows)), "path").mapInArrow(run, schema)


def token_files(docs: DataFrame, vocabulary: str | None = None, length: int = 2048, folder: str | None = None) -> DataFrame:
    """Encodes, writes shards into the folder (a new one in the shared folder by default) and reads them back."""
    spark = docs.sparkSession
    shards = write_shards(docs, folder or scratch(spark, "tokens"), vocabulary or default_vocabulary(), length)
    kind = docs.schema["doc_id"].dataType
    read = read_shards(spark, shards, "bigint" if kind.simpleString() in WHOLE else "string")
    return read.withColumn("doc_id", F.col("doc_id").cast(kind))
