"""Token ids in files of their own format: one compressed wavelet matrix a shard.

Documents are encoded, range-sorted by id and cut into shards of about ``SHARD`` tokens; a task writes a shard
as soon as it is full.  A file answers, without unpacking all of it, which token stands at a place
(``access``), how often an id occurs before a place (``rank``), and where its occurrences are (``select``,
``occurrences``).

The ids of a shard get codes by falling frequency.  Plane 0 holds the first bit of every code in text order;
each next plane holds the next bit after a stable partition by the bit before, zeros first.  So the upper planes
are nearly empty and compress well.  Planes are cut into blocks of ``BLOCK`` bits, each deflated where sparse, if
that makes it smaller, with the number of ones before it: a rank reads one block a plane, a select searches the counts.

File, little-endian: magic, seven int64 (documents, tokens, distinct ids, planes, and the bytes of the three
directories that follow deflated: document ids with null marks, lengths and places of rows, distinct ids by
code), then per plane its zeros, ones before each block and end of each block (int64), then the blocks.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut
from tidemark.session import fresh_path

MAGIC = b"TDWM0001"
#: A shard is full when it has this many tokens.
SHARD = 1 << 20
#: Bits of a block of a plane.
BLOCK = 1 << 13
#: Chunks whose ids one Python worker remembers, about 150 bytes each; beyond it starts anew.
REMEMBERED = 1_500_000
#: Documents, and bytes of text, that are encoded at a time.
ROWS, TEXT = 512, 4_000_000

#: A stop or comma at a chunk's end that does not follow a plain letter or digit, so that it may belong to a longer token.
_ODD_STOP = re.compile(rb"(?:[^a-z0-9\xa0-\xbf]|[^\xc3][\xa0-\xbf]|\xc3\xb7)[.,][ \n]")
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\xa0-\xb6\xb8-\xbf])+")
_TOGETHER = 200


class _Numbers(dict):
    """Numbers of chunks in order of first use; ``new`` lists the ones whose ids are not known yet."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, chunk: bytes) -> int:
        self.new.append(chunk)
        number = self[chunk] = len(self)
        return number


class ChunkEncoder:
    """Ids of whole texts by the tokenizers library, chunk by chunk.

    The vocabulary's normaliser and splitter never join across ASCII white space, so each chunk between it is
    encoded once and remembered.  ASCII letters are lower-cased first, as the normaliser does, except where a
    special token could come out of that.  A stop or comma after a letter is a chunk of its own, as no token crosses
    there.  Words of letters are one token sequence each with a marked end, so many are encoded in one call.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.remembered = remembered
        names = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(names.values()) + 1, bool)
        self.ends[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.numbers = _Numbers()
        self.begin, self.length, self.flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, "<u4")

    def encode(self, texts: list[str | None], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each text with the end id if given, and the number of ids of each text."""
        if len(self.numbers) > self.remembered:
            self._clear()
        chunks: list[bytes] = []
        counts = []
        for text in texts:
            before = len(chunks)
            chunks += self._split((text or "").encode("utf-8", "replace"))
            counts.append(len(chunks) - before)
        numbers = np.fromiter(map(self.numbers.__getitem__, chunks), np.int64, len(chunks))
        if self.numbers.new:
            self._learn()
        sizes = self.length[numbers]
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.begin[numbers] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        upto = np.concatenate([[0], ends])[np.cumsum(counts, dtype=np.int64)] if counts else np.empty(0, np.int64)
        lengths = np.diff(upto, prepend=0)
        if end is not None:
            ids, lengths = np.insert(ids, upto, end), lengths + 1
        return ids, lengths

    @staticmethod
    def _split(raw: bytes) -> list[bytes]:
        if b"<|" in raw:
            return raw.split()
        low = raw.lower()
        if _ODD_STOP.search(low):
            return low.split()
        return low.replace(b". ", b" . ").replace(b", ", b" , ").replace(b".\n", b" .\n").split()

    def _learn(self) -> None:
        new, self.numbers.new = self.numbers.new, []
        found: dict[bytes, np.ndarray] = {}
        plain = [c for c in new if _LETTERS.fullmatch(c)]
        groups = [plain[i:i + _TOGETHER] for i in range(0, len(plain), _TOGETHER)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([b" ".join(g).decode() for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            found.update(zip(group, np.split(ids, np.flatnonzero(self.ends[ids]) + 1)))
        rest = [c for c in new if c not in found]
        for c, e in zip(rest, self.tokenizer.encode_batch_fast([c.decode() for c in rest], add_special_tokens=False)):
            found[c] = np.array(e.ids, "<u4")
        parts = [found[c] for c in new]
        length = np.fromiter(map(len, parts), np.int64, len(parts))
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.flat = np.concatenate([self.flat, *parts])


@cache
def _encoder(path: str, remembered: int) -> ChunkEncoder:
    """One encoder a Python worker, kept over its tasks."""
    return ChunkEncoder(path, remembered)


def _pack(data: bytes) -> bytes:
    return zlib.compress(data, 1)


def pack_shard(ids: np.ndarray, lengths: np.ndarray, doc_ids: np.ndarray, unnamed: np.ndarray) -> bytes:
    """A shard file from all its ids, and per document length, id, and whether the id is null."""
    n = len(ids)
    counts = np.bincount(ids)
    alphabet = np.flatnonzero(counts)
    alphabet = alphabet[np.argsort(-counts[alphabet], kind="stable")]
    planes = max(1, int(len(alphabet) - 1).bit_length()) if n else 0
    kind = np.uint16 if planes <= 16 else np.uint32
    code_of = np.zeros(len(counts), kind)
    code_of[alphabet] = np.arange(len(alphabet), dtype=kind)
    codes = code_of[ids]
    directories = [
        _pack(np.ascontiguousarray(doc_ids, "<i8").tobytes() + np.ascontiguousarray(unnamed, "u1").tobytes()),
        _pack(np.ascontiguousarray(lengths, "<i8").tobytes()),
        _pack(np.ascontiguousarray(alphabet, "<u4").tobytes()),
    ]
    head = np.array([len(lengths), n, len(alphabet), planes, *map(len, directories)], "<i8").tobytes()
    tables, blocks = [], []
    end = 0
    for level in range(planes):
        bits = (codes >> kind(planes - 1 - level) & kind(1)).view("u1")[::kind(0).itemsize].astype(bool)
        packed = np.packbits(bits, bitorder="little")
        ones = np.add.reduceat(bits, np.arange(0, n, BLOCK), dtype=np.int64)
        ends = []
        for at, some in zip(range(0, len(packed), BLOCK // 8), ones.tolist()):
            plain = packed[at:at + BLOCK // 8].tobytes()
            # about as many ones as zeros do not deflate
            small = plain if 4 * some > BLOCK and 4 * some < 3 * BLOCK else _pack(plain)
            blocks.append(small if len(small) < len(plain) else plain)
            end += len(blocks[-1])
            ends.append(end)
        tables.append(np.concatenate([[n - ones.sum()], np.cumsum(ones) - ones, ends]).astype("<i8").tobytes())
        codes = np.concatenate([codes[~bits], codes[bits]])
    return b"".join([MAGIC, head, *directories, *tables, *blocks])


class Shard:
    """Reader of one file; planes are unpacked block by block when asked for."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a shard file")
        self.documents, self.tokens, self.distinct, self.planes, *sizes = map(int, np.frombuffer(data, "<i8", 7, 8))
        at, parts = 8 + 56, []
        for size in sizes:
            parts.append(zlib.decompress(data[at:at + size]))
            at += size
        self.doc_ids = np.frombuffer(parts[0], "<i8", self.documents)
        self.unnamed = np.frombuffer(parts[0], "u1", self.documents, 8 * self.documents).astype(bool)
        self.lengths = np.frombuffer(parts[1], "<i8")
        self.ids = np.frombuffer(parts[2], "<u4")
        self.ends = np.cumsum(self.lengths)
        self.blocks = -(-self.tokens // BLOCK)
        table = np.frombuffer(data, "<i8", self.planes * (1 + 2 * self.blocks), at).reshape(self.planes, 1 + 2 * self.blocks)
        self.zeros, self.before, self.block_ends = table[:, 0], table[:, 1:1 + self.blocks], table[:, 1 + self.blocks:]
        self.body = memoryview(data)[at + table.nbytes:]
        self._code = None

    def _bits(self, level: int, block: int) -> np.ndarray:
        last = int(self.block_ends[level, block])
        first = int(self.block_ends.flat[level * self.blocks + block - 1]) if level or block else 0
        width = min(BLOCK, self.tokens - block * BLOCK)
        raw = self.body[first:last]
        plain = raw if len(raw) == -(-width // 8) else zlib.decompress(raw)
        return np.unpackbits(np.frombuffer(plain, "u1"), count=width, bitorder="little")

    def _ones(self, level: int, at: int) -> int:
        """Ones of a plane before a place."""
        if at >= self.tokens:
            return self.tokens - int(self.zeros[level])
        block, rest = divmod(at, BLOCK)
        return int(self.before[level, block]) + (int(self._bits(level, block)[:rest].sum()) if rest else 0)

    def _code_of(self, token: int) -> int | None:
        if self._code is None:
            self._code = {int(t): c for c, t in enumerate(self.ids)}
        return self._code.get(token)

    def access(self, at: int) -> int:
        """Id at a place."""
        if not 0 <= at < self.tokens:
            raise IndexError(at)
        code = 0
        for level in range(self.planes):
            block, rest = divmod(at, BLOCK)
            bits = self._bits(level, block)
            ones = int(self.before[level, block]) + int(bits[:rest].sum())
            bit = int(bits[rest])
            code = code << 1 | bit
            at = int(self.zeros[level]) + ones if bit else at - ones
        return int(self.ids[code])

    def _span(self, token: int, upto: int) -> tuple[int, int] | None:
        """Where the occurrences before ``upto`` stand below the last plane."""
        code = self._code_of(token)
        if code is None:
            return None
        first, last = 0, max(0, min(upto, self.tokens))
        for level in range(self.planes):
            a, b = self._ones(level, first), self._ones(level, last)
            if code >> (self.planes - 1 - level) & 1:
                first, last = int(self.zeros[level]) + a, int(self.zeros[level]) + b
            else:
                first, last = first - a, last - b
        return first, last

    def rank(self, token: int, upto: int) -> int:
        """Occurrences of an id before a place."""
        span = self._span(token, upto)
        return span[1] - span[0] if span else 0

    def count(self, token: int) -> int:
        return self.rank(token, self.tokens)

    def select(self, token: int, k: int) -> int:
        """Place of occurrence ``k``, from 0."""
        span = self._span(token, self.tokens)
        if span is None or not 0 <= k < span[1] - span[0]:
            raise IndexError(k)
        at, code = span[0] + k, self._code_of(token)
        for level in range(self.planes - 1, -1, -1):
            bit = code >> (self.planes - 1 - level) & 1
            at = self._find(level, bit, at - int(self.zeros[level]) if bit else at)
        return at

    def _find(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th one, or zero, of a plane."""
        before = self.before[level]
        seen = before if bit else np.arange(self.blocks) * BLOCK - before
        block = int(np.searchsorted(seen, k, side="right")) - 1
        return block * BLOCK + int(np.flatnonzero(self._bits(level, block) == bit)[k - int(seen[block])])

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def all_ids(self) -> np.ndarray:
        """Every id in order: the partitions are undone plane by plane, the last first."""
        kind = np.uint16 if self.planes <= 16 else np.uint32
        codes = np.zeros(self.tokens, kind)
        for level in range(self.planes - 1, -1, -1):
            bits = np.concatenate([self._bits(level, b) for b in range(self.blocks)]).view(bool)
            merged, zeros = np.empty_like(codes), int(self.zeros[level])
            merged[~bits], merged[bits] = codes[:zeros], codes[zeros:]
            codes = merged | (bits.astype(kind) << kind(self.planes - 1 - level))
        return self.ids[codes] if self.tokens else np.empty(0, "<u4")

    def document(self, i: int) -> np.ndarray:
        """Ids of one document, read token by token."""
        start = int(self.ends[i] - self.lengths[i])
        return np.array([self.access(start + j) for j in range(int(self.lengths[i]))], "<u4")


def _coded(batches: Iterator[pa.RecordBatch], encoder: ChunkEncoder, end: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Doc ids, ids in a row with the end id after each text, and lengths, some rows at a time."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            some, size = [], 0
            while at + len(some) < batch.num_rows and len(some) < ROWS and size < TEXT:
                some.append(batch.column(1)[at + len(some)].as_py())
                size += len(some[-1] or "")
            yield (batch.column(0).slice(at, len(some)).to_pylist(), *encoder.encode(some, end))
            at += len(some)


def _place(folder: str):
    """File system and path of a folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if folder.startswith("file:") or "://" in folder else (fs.LocalFileSystem(), folder)


def _store(folder: str, name: str, data: bytes) -> None:
    """Writes a file under another name first, so that a task that is tried again never leaves half of one."""
    place, root = _place(folder)
    draft = f"{root}/_{name}-{os.urandom(6).hex()}"
    with place.open_output_stream(draft) as out:
        out.write(data)
    place.move(draft, f"{root}/{name}")


def write_shards(docs: DataFrame, path: str, folder: str, end: int = 2, shard: int = SHARD, remembered: int = REMEMBERED) -> DataFrame:
    """Writes the ids of all documents as shard files in ``folder``, in order of doc_id; a row for each file.

    Returns part, number (within the part), name, documents, tokens and bytes; files in order of (part, number)
    hold the documents in order.  Null texts and empty texts give the end id alone; a long text is never split, its
    shard is as much larger.  Rows with a null doc_id come first; rows that share one follow each other by their
    texts.  An empty table gives no files.  Other columns are not read.
    """
    place, root = _place(folder)
    place.create_dir(root, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange("doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    schema = "part int, number int, name string, documents long, tokens long, bytes long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        held: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        size = 0

        def close():
            nonlocal names, held, lengths, size, number
            data = pack_shard(np.concatenate(held), np.concatenate(lengths), np.array([d or 0 for d in names], "<i8"), np.array([d is None for d in names]))
            name = f"shard-{part:06d}-{number:06d}.wm"
            _store(folder, name, data)
            row = [[part], [number], [name], [len(names)], [size], [len(data)]]
            names, held, lengths, size, number = [], [], [], 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, kinds)], names=fields)

        fields = ["part", "number", "name", "documents", "tokens", "bytes"]
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        for docs_, ids, sizes in _coded(batches, _encoder(path, remembered), end):
            while len(docs_):
                # up to the document that fills the shard
                upto = np.cumsum(sizes)
                some = min(int(np.searchsorted(upto, shard - size)) + 1, len(docs_))
                names += docs_[:some]
                held.append(ids[:upto[some - 1]])
                lengths.append(sizes[:some])
                size += int(upto[some - 1])
                docs_, ids, sizes = docs_[some:], ids[upto[some - 1]:], sizes[some:]
                if size >= shard:
                    yield close()
        if names:
            yield close()

    return cut(ordered.mapInArrow(run, schema))


def read_shards(files: DataFrame, folder: str, ids: bool = False) -> DataFrame:
    """One row per document read back from the files: doc_id, start, n_tokens, ids_crc32, with ``ids`` the ids.

    ``start`` counts the ids of all documents before: totals of the parts, files and documents, in turn.
    """
    parts = files.groupBy("part").agg(F.sum("tokens").alias("t"))
    none = F.lit(0).cast("long")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    parts = parts.select("part", F.coalesce(F.sum("t").over(before), none).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("name", "part", F.coalesce(F.sum("tokens").over(inside), none).alias("file_start")).join(parts, "part").select(
        "name", (F.col("part_start") + F.col("file_start")).alias("shard_start"))
    raw = files.sparkSession.read.format("binaryFile").option("pathGlobFilter", "shard-*.wm").load(folder)
    raw = raw.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    schema = "name string, doc_id long, inside long, n_tokens long, ids_crc32 long" + (", ids array<long>" if ids else "")
    fields = ["name", "doc_id", "inside", "n_tokens", "ids_crc32", *(["ids"] if ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                s = Shard(batch.column(1)[i].as_py())
                every = np.ascontiguousarray(s.all_ids(), "<u4")
                begins, raw = s.ends - s.lengths, memoryview(every).cast("B")
                crcs = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(begins.tolist(), s.ends.tolist())]
                columns = [pa.array([batch.column(0)[i].as_py()] * s.documents), pa.array(s.doc_ids, mask=s.unnamed), pa.array(begins), pa.array(s.lengths), pa.array(crcs, pa.int64())]
                out = pa.RecordBatch.from_arrays(columns, names=fields[:5])
                for at in range(0, s.documents, ROWS if ids else max(s.documents, 1)):
                    part = out.slice(at, ROWS if ids else s.documents)
                    if ids:
                        span = range(at, min(at + ROWS, s.documents))
                        offsets = pa.array(np.concatenate([begins[span.start:span.stop], s.ends[span.stop - 1:span.stop]]) - begins[span.start], pa.int32())
                        values = pa.array(every[begins[span.start]:s.ends[span.stop - 1]].astype(np.int64))
                        part = pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(offsets, values, pa.list_(pa.field("element", pa.int64())))], names=fields)
                    yield part

    read = raw.mapInArrow(run, schema).join(starts, "name")
    columns = ["doc_id", (F.col("shard_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"]
    return read.select(*columns, *(["ids"] if ids else []))


def lookup(folder: str, spark, token: int) -> DataFrame:
    """Occurrences of an id, a row for each (name of the shard file, place in it), read by select from the files."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.wm").load(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                places = Shard(content.as_py()).occurrences(token)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(places), pa.string()), pa.array(places, pa.int64())], names=["name", "place"])

    return raw.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").mapInArrow(run, "name string, place long")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def stored(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the documents' ids as shard files in the shared folder and reads them back."""
    folder = fresh_path(docs.sparkSession, "shards")
    files = write_shards(docs, path or vocabulary_path(), folder)
    return read_shards(files, folder)
