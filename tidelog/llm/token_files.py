"""Token ids in Arrow files of equal-length sequences (operator 9).

Texts are range-sorted by doc_id; each range becomes a shard of two Arrow IPC files: ``sequences``
(record batches of fixed-size lists of ids, with a fixed-size list of mask bits: 0 marks padding at
the end of the shard) and ``index`` (doc_id, first token in the shard, number of tokens). Files are
written under a temporary name and renamed, so a repeated task leaves one copy. A document or a
sequence is a slice of a memory-mapped file without copying.

Encoding splits texts into the words of the byte-level pattern in numpy, encodes each word not seen
yet with the tokenizers library and joins the ids; texts that hold an added token of the vocabulary
go through the library whole.

Defined results: null or empty text is the end id alone; a null doc_id comes first; rows with equal
doc_id are ordered by a hash of their text; an empty table makes no file and no row.
"""

from __future__ import annotations

import os
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm import text as tx
from tidelog.llm.encoding import PieceCache, code_points
from tidelog.llm.shared import portable, staged, texts, work_dir

SEQUENCE = 2048
ROWS = 128  # sequences in a record batch
END_ID = 2
JOINED = 128  # words that go to the library as one text
_encoders: dict = {}


def _char_classes() -> np.ndarray:
    """0 other, 1 letter, 2 number, 3 white space for each code point."""
    import regex

    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\x00" for c in range(0x110000))
    out = np.zeros(len(every), np.uint8)
    for kind, pattern in enumerate((r"\p{L}+", r"\p{N}+", r"\s+"), 1):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


def word_starts(points: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """First code point of each word of the byte-level pattern.

    A word is a run of letters, of numbers or of other characters with the one space before it, an
    English contraction, or white space: all of it at the end of a text, else without its last character.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes[points]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    change = np.concatenate(([True], kind[1:] != kind[:-1])) | edge[:-1]
    blank = kind == 3
    joined = np.concatenate(([False], points[:-1] == 0x20)) & ~edge[:-1]
    last_blank = blank & np.concatenate((~blank[1:], [False])) & ~edge[1:]
    starts = np.where(blank, change | last_blank, change & ~joined)
    quote = np.flatnonzero((points[:-1] == 0x27) & starts[:-1] & (kind[1:] == 1) & ~edge[1:-1])
    if len(quote):
        padded = np.concatenate((points, np.zeros(2, points.dtype)))
        one, two = padded[quote + 1], padded[quote + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        inside = (quote + 2 < n) & ~edge[np.minimum(quote + 2, n)]
        long = inside & np.isin(one.astype(np.int64) << 21 | two, [ord(a) << 21 | ord(b) for a, b in ("re", "ve", "ll")])
        starts[quote[short | long] + 1] = False
        after = np.concatenate((quote[short] + 2, quote[long] + 3))
        after = after[after < n]
        after = after[~edge[after] & (kind[after] == 1)]
        starts[after] = True
    return np.flatnonzero(starts)


class ByteLevelEncoder:
    """Encodes chunks of texts with a byte-level vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.added = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.classes = _char_classes()
        self.begins = np.array([(self.library.id_to_token(i) or "").startswith("\u0120") for i in range(self.size)])
        self.cache = PieceCache(self._encode_words)

    def _encode_words(self, at: np.ndarray, _: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of the current chunk and their number.

        Words with their one space in front stay words when they are joined, and each then begins
        with the only ids that hold a space; so the library gets many of them in one text.
        """
        data, starts, ends, spaced = self.words
        joined, single = at[spaced[at]], at[~spaced[at]]
        texts = [data[starts[k] : ends[k]].decode() for k in joined.tolist()]
        texts = ["".join(texts[k : k + JOINED]) for k in range(0, len(texts), JOINED)]
        found = [np.array(e.ids, np.int32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate(found) if found else np.zeros(0, np.int32)
        heads = np.flatnonzero(self.begins[ids])
        if len(heads) != len(joined):
            raise ValueError("the vocabulary does not mark the space before a word")
        others = [e.ids for e in self.library.encode_batch_fast([data[starts[k] : ends[k]].decode() for k in single.tolist()], add_special_tokens=False)]
        sizes = np.concatenate((np.diff(np.append(heads, len(ids))), np.array([len(o) for o in others], np.int64)))
        every = np.concatenate((ids, np.array([i for o in others for i in o], np.int32)))
        place = np.empty(len(at), np.int64)
        place[np.concatenate((np.flatnonzero(spaced[at]), np.flatnonzero(~spaced[at])))] = np.arange(len(at))
        first = (np.cumsum(sizes) - sizes)[place]
        return every[tx.ranges(first, sizes[place])], sizes[place]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after the other and the number of ids of each row."""
        points, lead, rows = code_points(data, offsets)
        first = word_starts(points, rows, self.classes)
        starts, ends = lead[first], np.append(lead[first[1:]], len(data)) if len(first) else first
        raw = data.tobytes()
        after = np.append(points, 0)[np.minimum(first + 1, len(points))]
        length = np.diff(np.append(first, len(points)))
        self.words = (raw, starts, ends, (points[first] == 0x20) & (length > 1) & (self.classes[after] != 3))
        ids, counts = self.cache.ids(tx.RangeHash(data).of(starts, ends))
        sums = np.concatenate(([0], np.cumsum(counts)))
        bounds = sums[np.searchsorted(starts, offsets)]
        special = [k for k in range(len(offsets) - 1) if any(raw.find(t, offsets[k], offsets[k + 1]) >= 0 for t in self.added)] if any(t in raw for t in self.added) else []
        if special:
            own = [ids[bounds[k] : bounds[k + 1]] for k in range(len(offsets) - 1)]
            for k in special:
                own[k] = np.array(self.library.encode(raw[offsets[k] : offsets[k + 1]].decode(), add_special_tokens=False).ids, np.int32)
            return np.concatenate(own), np.array([len(x) for x in own], np.int64)
        return ids, np.diff(bounds)


def encoder(path: str) -> ByteLevelEncoder:
    """One encoder for each worker process."""
    if path not in _encoders:
        _encoders[path] = ByteLevelEncoder(path)
    return _encoders[path]


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    found, inner = pafs.FileSystem.from_uri(path)
    return (pafs.LocalFileSystem(use_mmap=True) if isinstance(found, pafs.LocalFileSystem) else found), inner


class _Shard:
    """Writes one shard; sequences are filled across documents."""

    def __init__(self, folder: str, vocabulary: int, id_type: pa.DataType):
        self.kind = pa.uint16() if vocabulary <= 1 << 16 else pa.int32()
        self.fs, self.base = filesystem(folder)
        self.name, self.id_type = uuid.uuid4().hex, id_type
        self.fs.create_dir(self.base)
        self.schema = pa.schema([("input_ids", pa.list_(self.kind, SEQUENCE)), ("mask", pa.list_(pa.bool_(), SEQUENCE))])
        self.out = self.fs.open_output_stream(self._path("sequences", True))
        self.writer = pa.ipc.new_file(self.out, self.schema)
        self.ids, self.counts, self.waiting, self.tokens = [], [], [], 0

    def _path(self, part: str, temporary: bool) -> str:
        return posixpath.join(self.base, ("_tmp-" if temporary else "") + f"{self.name}.{part}.arrow")

    def add(self, ids: pa.Array, tokens: np.ndarray, counts: np.ndarray) -> None:
        self.ids.append(ids)
        self.counts.append(counts)
        self.waiting.append(tokens)
        self.tokens += len(tokens)
        if sum(map(len, self.waiting)) >= SEQUENCE * ROWS:
            flat = np.concatenate(self.waiting)
            whole = len(flat) - len(flat) % (SEQUENCE * ROWS)
            for at in range(0, whole, SEQUENCE * ROWS):
                self._write(flat[at : at + SEQUENCE * ROWS])
            self.waiting = [flat[whole:]]

    def _write(self, flat: np.ndarray) -> None:
        rows = -(-len(flat) // SEQUENCE)
        padded = np.zeros(rows * SEQUENCE, self.kind.to_pandas_dtype())
        padded[: len(flat)] = flat
        mask = np.arange(rows * SEQUENCE) < len(flat)
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(v), SEQUENCE) for v in (padded, mask)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> tuple[str, int]:
        rest = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.int64)
        if len(rest):
            self._write(rest)
        self.writer.close()
        self.out.close()
        counts = np.concatenate(self.counts).astype(np.int64)
        index = pa.table({"doc_id": pa.chunked_array(self.ids, self.id_type), "first": np.cumsum(counts) - counts, "n_tokens": counts})
        with self.fs.open_output_stream(self._path("index", True)) as out, pa.ipc.new_file(out, index.schema) as writer:
            writer.write_table(index)
        for part in ("sequences", "index"):
            self.fs.move(self._path(part, True), self._path(part, False))
        return self.name, self.tokens


def write_token_files(docs: DataFrame, vocabulary: str, folder: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards and return their manifest: folder, shard, first doc_id, documents, tokens, base.

    ``base`` is the number of tokens of all shards before. The manifest has a row for each shard.
    """
    base = texts(docs, id_col, text_col)
    folder = folder or work_dir(docs.sparkSession, "tokens")
    kind = base.schema["doc_id"].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard, first, n = encoder(vocabulary), None, None, 0
        for rows, data, offsets in tx.text_chunks(batches):
            ids, counts = coder.encode(data, offsets)
            ends = np.cumsum(counts + 1) - 1
            tokens = np.empty(len(ids) + len(counts), np.int32)
            tokens[ends] = end_id
            own = np.ones(len(tokens), bool)
            own[ends] = False
            tokens[own] = ids
            if shard is None:
                shard, first = _Shard(folder, max(coder.size, end_id + 1), rows.column(0).type), rows.column(0).slice(0, 1)
            shard.add(rows.column(0), tokens, counts + 1)
            n += rows.num_rows
        if shard is not None:
            name, total = shard.close()
            yield pa.RecordBatch.from_arrays([pa.array([folder]), pa.array([name]), first, pa.array([n]), pa.array([total])], names=["folder", "shard", "first_id", "n_docs", "n_tokens"])

    ordered = base.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    numbered = ordered.mapInArrow(portable(write), f"folder string, shard string, first_id {kind}, n_docs bigint, n_tokens bigint").withColumn("part", F.spark_partition_id())
    manifest = staged(numbered, "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def open_shard(folder: str, shard: str) -> tuple[pa.Table, pa.Table]:
    """Index and sequences of a shard, memory-mapped where the file system allows it."""
    store, base = filesystem(folder)
    return tuple(pa.ipc.open_file(store.open_input_file(posixpath.join(base, f"{shard}.{part}.arrow"))).read_all() for part in ("index", "sequences"))


class TokenReader:
    """Random access to the documents and sequences of one shard."""

    def __init__(self, folder: str, shard: str):
        self.index, sequences = open_shard(folder, shard)
        self.ids = [c.flatten().to_numpy(zero_copy_only=True) for c in sequences.column("input_ids").chunks]
        self.bounds = np.concatenate(([0], np.cumsum([len(c) for c in self.ids]))).astype(np.int64)

    def tokens(self, first: int, n: int) -> np.ndarray:
        """``n`` tokens from ``first`` on: a view unless the slice crosses record batches."""
        lo, hi = np.searchsorted(self.bounds, [first, first + n - 1], "right") - 1
        parts = [self.ids[k][max(0, first - self.bounds[k]) : first + n - self.bounds[k]] for k in range(lo, hi + 1)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def read_documents(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    kind = manifest.schema["first_id"].dataType.simpleString()
    shards = manifest.select("folder", "shard", "base").repartition(max(1, manifest.count()))  # a task for each shard

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder, shard, base in zip(*(c.to_pylist() for c in batch.columns)):
                reader = TokenReader(folder, shard)
                first, counts = (reader.index.column(c).to_numpy() for c in ("first", "n_tokens"))
                sums = [zlib.crc32(reader.tokens(a, n).astype("<u4").tobytes()) for a, n in zip(first.tolist(), counts.tolist())]
                table = pa.table({"doc_id": reader.index.column("doc_id"), "start": first + base, "n_tokens": counts, "ids_crc32": pa.array(sums, pa.int64())})
                yield from table.to_batches(max_chunksize=20_000)

    return shards.mapInArrow(portable(read), f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")
