"""Token files: a wavelet matrix per shard.

File: the magic, a JSON header (length-prefixed), an index, the documents' first positions and
ids, and the bit-planes, the highest bit first. A plane holds a bit for each token, tokens
ordered by the bits above (zeros before ones, in place), in blocks of BLOCK bits that are
compressed one by one. The index has each block's place and the ones before it, so rank reads
one block of a plane and select one more look-up; access, count and find never unpack a plane.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .bpe import encoder
from .common import materialize, steps, trimmed, utf8, work_path

MAGIC = b"LLWM0002"
#: Bits of a block.
BLOCK = 1 << 15
#: Blocks that a reader keeps unpacked.
KEEP = 256
#: Bytes of text of one writing task.
RANGE_BYTES = 1 << 26


def build(tokens: np.ndarray, starts: np.ndarray, docs: list[str | None], bits: int | None = None) -> bytes:
    """The file's bytes. starts: each document's first position."""
    import zstandard

    tokens = np.asarray(tokens, np.uint32)
    n = len(tokens)
    need = max(1, int(tokens.max(initial=0)).bit_length())
    bits = max(bits or 1, need)
    pack = zstandard.ZstdCompressor(level=1)
    blocks = -(-n // BLOCK)
    parts, zeros, ranks, places, at = [], [], [], [0], 0
    now = tokens.astype(np.uint16) if bits <= 16 else tokens
    for k in range(bits - 1, -1, -1):
        ones = (now & now.dtype.type(1 << k)) != 0
        plane = memoryview(np.packbits(ones, bitorder="little").tobytes())
        before = np.add.reduceat(ones, np.arange(0, n, BLOCK), dtype=np.int64) if n else np.zeros(0, np.int64)
        ranks.append(np.concatenate([[0], np.cumsum(before)]))
        for i in range(0, blocks * (BLOCK // 8), BLOCK // 8):
            raw = plane[i : i + BLOCK // 8]
            small = pack.compress(raw)
            parts.append(small if len(small) < len(raw) else raw)
            at += len(parts[-1])
            places.append(at)
        left = now[~ones]
        zeros.append(len(left))
        now = np.concatenate([left, now[ones]])
    index = np.concatenate([*ranks, places]).astype("<i8").tobytes()
    tail = pack.compress(np.asarray(starts, "<i8").tobytes()), pack.compress(json.dumps(docs).encode())
    head = json.dumps({"n": n, "bits": bits, "zeros": zeros, "block": BLOCK, "tail": [len(p) for p in tail]}).encode()
    return b"".join([MAGIC, len(head).to_bytes(4, "little"), head, index, *tail, *parts])


class WaveletMatrix:
    """Token access, counting and occurrence look-up in one file.

    data: the file's bytes, or a function (offset, size) -> bytes that reads from it; then
    only the header, the index and the blocks asked for are ever read."""

    def __init__(self, data):
        import zstandard

        self.read = data if callable(data) else lambda at, size: data[at : at + size]
        start = self.read(0, 12)
        if start[:8] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        size = int.from_bytes(start[8:12], "little")
        head = json.loads(self.read(12, size))
        self.n, self.bits, self.zeros, self.block, self.tail = head["n"], head["bits"], head["zeros"], head["block"], head["tail"]
        self.blocks = -(-self.n // self.block)
        k = self.bits * (self.blocks + 1) + self.bits * self.blocks + 1
        index = np.frombuffer(self.read(12 + size, 8 * k), "<i8")
        self.ranks = index[: self.bits * (self.blocks + 1)].reshape(self.bits, self.blocks + 1)
        self.places = index[self.bits * (self.blocks + 1) :]
        self.tails_at = 12 + size + 8 * k
        self.base = self.tails_at + sum(self.tail)
        self.unpack = zstandard.ZstdDecompressor()
        self.held: dict[tuple[int, int], bytes] = {}

    def _tail(self, i: int) -> bytes:
        return self.unpack.decompress(self.read(self.tails_at + sum(self.tail[:i]), self.tail[i]))

    @property
    def starts(self) -> np.ndarray:
        """First positions of the documents."""
        return np.frombuffer(self._tail(0), "<i8")

    @property
    def docs(self) -> list[str | None]:
        """Ids of the documents as text."""
        return json.loads(self._tail(1))

    def _opened(self, block: int, data: bytes) -> bytes:
        """A block's bits, given what the file holds of it."""
        raw = -(-min(self.block, self.n - block * self.block) // 8)
        return bytes(data) if len(data) == raw else self.unpack.decompress(data)

    def _bits(self, k: int, block: int) -> bytes:
        """The bits of one block of plane k."""
        got = self.held.get((k, block))
        if got is None:
            a, b = self.places[k * self.blocks + block : k * self.blocks + block + 2].tolist()
            if len(self.held) >= KEEP:
                self.held.clear()
            got = self.held[k, block] = self._opened(block, self.read(self.base + a, b - a))
        return got

    def _rank1(self, k: int, i: int) -> int:
        """Ones in plane k before position i."""
        block, within = divmod(i, self.block)
        n = int(self.ranks[k, block])
        if within:
            bits = self._bits(k, block)
            n += int.from_bytes(bits[: within // 8], "little").bit_count()
            n += (bits[within // 8] & ((1 << within % 8) - 1)).bit_count() if within % 8 else 0
        return n

    def _select(self, k: int, bit: int, j: int) -> int:
        """Position of the j-th (from 0) bit of that value in plane k."""
        ranks = self.ranks[k]
        per = ranks if bit else np.minimum(np.arange(len(ranks)) * self.block, self.n) - ranks
        block = int(np.searchsorted(per, j, side="right")) - 1
        bits = np.unpackbits(np.frombuffer(self._bits(k, block), np.uint8), bitorder="little")
        return block * self.block + int(np.flatnonzero(bits == bit)[j - int(per[block])])

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k in range(self.bits):
            block, within = divmod(i, self.block)
            bit = self._bits(k, block)[within // 8] >> (within % 8) & 1
            value = value << 1 | bit
            ones = self._rank1(k, i)
            i = self.zeros[k] + ones if bit else i - ones
        return value

    def _span(self, token: int, first: int, last: int) -> tuple[int, int]:
        for k in range(self.bits):
            bit = token >> (self.bits - 1 - k) & 1
            a, b = self._rank1(k, first), self._rank1(k, last)
            first, last = (self.zeros[k] + a, self.zeros[k] + b) if bit else (first - a, last - b)
        return first, last

    def count(self, token: int, first: int = 0, last: int | None = None) -> int:
        """Occurrences of the token in positions first to last - 1."""
        if token < 0 or token >> self.bits:
            return 0
        a, b = self._span(token, first, self.n if last is None else last)
        return b - a

    def find(self, token: int, j: int) -> int:
        """Position of the token's j-th occurrence (from 0); -1 if there are fewer."""
        if j < 0 or j >= self.count(token):
            return -1
        i = self._span(token, 0, self.n)[0] + j
        for k in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - k) & 1
            i = self._select(k, bit, i - self.zeros[k] if bit else i)
        return i

    def tokens(self) -> np.ndarray:
        """All tokens in order: planes are undone from the lowest bit to the highest."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for k in range(self.bits - 1, -1, -1):
            at = self.places[k * self.blocks : (k + 1) * self.blocks + 1].tolist()
            data = memoryview(self.read(self.base + at[0], at[-1] - at[0]))
            plane = b"".join(self._opened(i, data[a - at[0] : b - at[0]]) for i, (a, b) in enumerate(zip(at, at[1:], strict=False)))
            ones = np.unpackbits(np.frombuffer(plane, np.uint8), count=self.n, bitorder="little").view(bool)
            z = self.zeros[k]
            out = np.empty_like(now)
            out[~ones] = now[:z]
            out[ones] = now[z:] | kind(1 << (self.bits - 1 - k))
            now = out
        return now


def _store(uri: str):
    """The file system of a folder's address and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_tokens(documents: DataFrame, folder: str, path: str, end_id: int = 2, shard_tokens: int = 1 << 21, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write files `part-PPPPPP-FFFFF.wm` in ascending doc_id order (null ids first, equal ids
    in order of their text) and return (part, file, name, docs, tokens) of each.

    Documents are dealt by ranges of the id, and of the text's hash where an id repeats, so
    no task holds more than its range; a task closes a file at `shard_tokens` tokens. A file
    is written under a name of its attempt and then moved, so a repeated task does no harm.
    """
    d = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    d = d.withColumn("h", F.xxhash64("text"))
    held = d.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-held // RANGE_BYTES))
    d = d.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")

    def run(batches):
        from pyspark import TaskContext

        ctx = TaskContext.get()
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        part, enc, number = ctx.partitionId(), encoder(path), 0
        held: list[np.ndarray] = []
        end = np.array([end_id], "<u4")
        ids: list[str | None] = []
        size = 0

        def close():
            name = f"part-{part:06d}-{number:05d}.wm"
            lengths = np.array([len(x) for x in held], np.int64)
            data = build(np.concatenate(held), np.cumsum(lengths) - lengths, ids)
            own = f"{base}/.{name}-{ctx.taskAttemptId()}"
            with store.open_output_stream(own) as f:
                f.write(data)
            store.move(own, f"{base}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([number], pa.int64()), pa.array([name]), pa.array([len(ids)], pa.int64()), pa.array([int(lengths.sum())], pa.int64())], ["part", "file", "name", "docs", "tokens"])

        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            keys = batch.column(0).to_pylist()
            for a, b in steps(offsets, 1 << 19):
                got, rows = enc.encode_utf8(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for i in range(b - a):
                    key, x = keys[a + i], got[rows[i] : rows[i + 1]]
                    held.append(np.append(x, end))
                    ids.append(None if key is None else str(key))
                    size += len(x) + 1
                    if size >= shard_tokens:
                        yield close()
                        number, size, held, ids = number + 1, 0, [], []
        if ids:
            yield close()

    return materialize(d.mapInArrow(trimmed(run, path), "part long, file long, name string, docs long, tokens long"), "wavelet-files")


def read_tokens(spark, folder: str, files: DataFrame, id_type: str = "bigint") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files."""
    inner = W.partitionBy("part").orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("tokens").alias("t"))
    outer = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row for each writing task
    parts = parts.select("part", F.coalesce(F.sum("t").over(outer), F.lit(0)).alias("outer"))
    base = files.withColumn("inner", F.coalesce(F.sum("tokens").over(inner), F.lit(0))).join(parts, "part").select("name", (F.col("inner") + F.col("outer")).alias("base"))
    data = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.wm").load(folder)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                m = WaveletMatrix(batch.column(1)[i].as_py())
                tokens, starts, docs = m.tokens().astype("<u4"), m.starts, m.docs
                ends = np.append(starts[1:], m.n)
                crc = [zlib.crc32(tokens[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                k = len(docs)
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * k, pa.string()), pa.array(docs, pa.string()), pa.array(starts, pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(crc, pa.int64())], ["name", "doc", "at", "n_tokens", "ids_crc32"])

    name = F.element_at(F.split("path", "/"), -1)
    got = data.select(name.alias("name"), "content").mapInArrow(trimmed(run), "name string, doc string, at long, n_tokens long, ids_crc32 long")
    return got.join(base, "name").select(F.col("doc").cast(id_type).alias("doc_id"), (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_files(documents: DataFrame, path: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Write documents as wavelet-matrix files and return what reading them gives back.

    A null or empty text is its end id alone. Null ids come first; repeated ids follow each
    other in order of their texts' hashes; repeated rows stay in one file range. Empty table:
    no files and no rows. Other columns are not read, whatever their names.
    """
    spark = documents.sparkSession
    folder = folder or work_path(spark, "wavelet")
    files = write_tokens(documents, folder, path, end_id)
    kind = documents.schema["doc_id"].dataType.simpleString()
    if not files.take(1):
        return spark.createDataFrame([], f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
    return read_tokens(spark, folder, files, kind)
