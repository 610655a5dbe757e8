"""Vectorised helpers for texts inside Arrow batches: chunks, words, hashes, ragged ranges.

Everything works on the UTF-8 bytes of a bounded chunk of documents, so a task needs memory for
one chunk (or for one document, if that is longer), whatever the size of its partition.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19
# Fixed odd multiplier of the polynomial hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
BYTE_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers: dict[int, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
# Word bytes of the benchmark search: digits, letters and every byte of a character beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def text_chunks(
    batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES, rows: int = 1 << 16
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of at most ``limit`` text bytes (one row at least) with their bytes and row offsets; null is empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = pc.fill_null(batch.column(batch.schema.get_field_index(column)), "")
        width = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
        _, offsets, data = texts.buffers()
        ends = np.frombuffer(offsets, width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(texts):
            to = int(np.searchsorted(ends, ends[at] + limit, "right")) - 1
            to = min(max(to, at + 1), at + rows, len(texts))
            yield batch.slice(at, to - at), raw[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
            at = to


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2**64, kept per process."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.empty(max(n, CHUNK_BYTES + 1), np.uint64)
        out[0], filled, step = 1, 1, base
        while filled < len(out):
            more = min(filled, len(out) - filled)
            out[filled : filled + more] = out[:more] * np.uint64(step)
            filled, step = filled + more, step * step % (1 << 64)
        have = _powers[base] = out
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all output bits (a bijection)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class RangeHash:
    """64-bit hashes of byte ranges of one chunk in constant time each."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_CODES[data] * powers(BASE, len(data)), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        inverse = powers(BASE_INVERSE, len(self.sums))
        h = (self.sums[end] - self.sums[start]) * inverse[start]
        return mix(h + (end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each maximal run of ``inside`` bytes per row, and the first word of each row (n + 1)."""
    hit = inside[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], hit[:-1]))
    after = np.concatenate((hit[1:], [False]))
    starts = np.flatnonzero(hit & (~before | edge[:-1]))
    ends = np.flatnonzero(hit & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... (counts[i] of them) for all i, one after the other."""
    counts = np.asarray(counts, np.int64)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(counts) - counts
    return np.repeat(np.asarray(starts, np.int64) - first, counts) + np.arange(total)


def sequence_hashes(codes: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` consecutive codes (fewer codes: none)."""
    n = len(codes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(length):
        total = total * np.uint64(BASE) + codes[k : k + n]
    return mix(total)


def shingles(
    codes: np.ndarray, first: np.ndarray, length: int
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word runs of each row (rows with fewer words: the whole sequence) and their row numbers."""
    counts = np.diff(first)
    rows = np.arange(len(counts))
    runs = sequence_hashes(codes, length)
    n = np.maximum(counts - length + 1, 0)
    hashes, of = runs[ranges(first[:-1], n)] if len(runs) else runs, np.repeat(rows, n)
    short = rows[(counts > 0) & (counts < length)]
    if len(short):
        extra = np.empty(len(short), np.uint64)
        for size in np.unique(counts[short]):
            at = short[counts[short] == size]
            total = np.zeros(len(at), np.uint64)
            for k in range(size):
                total = total * np.uint64(BASE) + codes[first[at] + k]
            extra[counts[short] == size] = mix(total ^ np.uint64(size))
        hashes, of = np.concatenate((hashes, extra)), np.concatenate((of, short))
    return hashes, of


def binary(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())


def record_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c.cast(f.type) if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema)],
        schema=schema,
    )
