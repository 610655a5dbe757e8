"""SentencePiece encoding and decoding in numpy (operator 6).

Texts are normalised as the model says, cut where no piece can reach across (two characters that
stand side by side in no piece), and every distinct unit is segmented once. Units of equal length
advance together: at each end position the hashes of all substrings probe the sorted piece keys, and
a maximum over the admissible pieces is stored as a back pointer.

A model of kind "unigram" admits every piece and maximises the sum of scores. In a model of kind
"BPE" the highest sum of scores is not the library's answer: there a piece is admitted when merging
could not have chosen otherwise across its border with the piece before it, which holds for exactly
one piece at each position. Results are those of the library for both.

Characters that no piece holds become byte pieces. Text of n characters without a border costs n steps.

Defined results: null or empty text has no ids and decodes to the empty text; rows that repeat get
equal results; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidelog.llm import text as tx
from tidelog.llm.encoding import HashIndex, PieceCache, code_points
from tidelog.llm.shared import portable, releasing, texts

SPACE_MARK = 0x2581
CHUNK = 1 << 19  # bytes of text
CELLS = 1 << 19  # places of units that are segmented together
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # kinds of pieces in a model file
UNIGRAM, BPE = 1, 2
_codecs: dict = {}


def _codes(points: np.ndarray) -> np.ndarray:
    return tx.mix(points.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + np.uint64(0x632BE59BD9B4E019))


class Codec:
    """A model file, opened for encoding and decoding chunks of texts."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        rules = model.normalizer_spec
        if rules.precompiled_charsmap or not rules.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that keep characters as they are and mark spaces in front are supported")
        self.kind = model.trainer_spec.model_type
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        self.prefix, self.squeeze = rules.add_dummy_prefix, rules.remove_extra_whitespaces
        kinds = np.array([p.type for p in model.pieces])
        if (kinds == USER).any():
            raise ValueError("models with user-defined pieces are not supported")
        self.unknown = int(np.flatnonzero(kinds == UNKNOWN)[0])
        self.byte_ids = np.full(256, self.unknown, np.int32)
        for k in np.flatnonzero(kinds == BYTE):
            self.byte_ids[int(model.pieces[k].piece[3:5], 16)] = k
        self.fallback = model.trainer_spec.byte_fallback
        # Pieces in the order in which merging prefers them; characters come first.
        usable = np.flatnonzero(kinds == NORMAL)
        names = {int(k): model.pieces[k].piece for k in usable}
        score = {k: model.pieces[k].score for k in names}
        chars = sorted({c for name in names.values() for c in name})
        chars_at = {c: k + 1 for k, c in enumerate(chars)}
        have = {name: k for k, name in names.items()}
        self.names = list(chars) + [names[k] for k in sorted((k for k in names if len(names[k]) > 1), key=lambda k: (-score[k], k))]
        self.ids = np.array([have.get(name, -1) for name in self.names], np.int32)  # -1: a character that is no piece
        self.scores = np.array([score[i] if i >= 0 else -1e9 for i in self.ids.tolist()])
        self.order = {name: k for k, name in enumerate(self.names)}
        self.sizes = np.array([len(name) for name in self.names], np.int64)
        self.longest = int(self.sizes.max())
        self.reach = np.zeros(len(chars) + 1, np.int32)  # longest piece that begins with a character
        for name in self.names:
            k = chars_at[name[0]]
            self.reach[k] = max(self.reach[k], len(name))
        keys = tx.mix(np.concatenate([self._hash(name) for name in self.names]))
        self.pieces = HashIndex(keys)
        self.char_class = np.zeros(0x110000, np.uint16)
        for k, c in enumerate(chars):
            self.char_class[ord(c)] = k + 1
        self.beside = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for name in self.names:
            for a, b in zip(name, name[1:]):
                self.beside[self.char_class[ord(a)], self.char_class[ord(b)]] = True
        if self.kind == BPE:
            self._merges()
        self._decoding(model, kinds)
        self.cache = PieceCache(self._encode_units, bits=20, pool=1 << 22)

    @staticmethod
    def _hash(name: str) -> np.ndarray:
        codes = _codes(np.array([ord(c) for c in name], np.uint64))
        size = np.full(1, len(name), np.uint64)
        return (codes * tx.powers(tx.BASE, len(codes))).sum(dtype=np.uint64, keepdims=True) + size * np.uint64(0xA0761D6478BD642F)

    def _merges(self) -> None:
        """Which two pieces merge into which, and the last merge inside each piece."""
        n, pairs = len(self.names), {}
        for k, name in enumerate(self.names):
            for cut in range(1, len(name)):
                a, b = self.order.get(name[:cut]), self.order.get(name[cut:])
                if a is not None and b is not None:
                    pairs[a, b] = k
        self.pairs = HashIndex(tx.mix(np.array([a * n + b for a, b in pairs], np.uint64)))
        self.merged = np.append(np.array(list(pairs.values()), np.int64), n)
        self.left, self.right = np.arange(n), np.arange(n)
        self.reached = np.zeros(n, bool)
        for k, name in enumerate(self.names):
            parts = [self.order[c] for c in name]
            before = parts
            while len(parts) > 1:
                found = [(pairs.get((a, b), n), j) for j, (a, b) in enumerate(zip(parts, parts[1:]))]
                best, j = min(found)
                if best == n:
                    break
                before, parts = parts, parts[:j] + [best] + parts[j + 2 :]
            self.reached[k] = len(parts) == 1 and parts[0] == k
            if self.reached[k] and len(before) == 2:
                self.left[k], self.right[k] = before
        self.seen_keys, self.seen = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)

    def _admits(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Whether merging leaves piece ``two`` after piece ``one``, for pairs of pieces (kept in a bounded table)."""
        packed = one * len(self.names) + two
        slot = (tx.mix(packed.astype(np.uint64)) & np.uint64(len(self.seen) - 1)).astype(np.int64)
        out = self.seen[slot]
        missing = np.flatnonzero(self.seen_keys[slot] != packed)
        if len(missing):
            new, back = np.unique(packed[missing], return_inverse=True)
            answer = self._border_holds(new // len(self.names), new % len(self.names))
            out[missing] = answer[back]
            slot = (tx.mix(new.astype(np.uint64)) & np.uint64(len(self.seen) - 1)).astype(np.int64)
            self.seen_keys[slot], self.seen[slot] = new, answer
        return out

    def _border_holds(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Undo the later of the two pieces' last merges step by step.

        If at some point the parts at the border would have merged earlier than the merge undone
        last, merging would have crossed the border.
        """
        n = len(self.names)
        holds, open_ = np.ones(len(one), bool), np.arange(len(one))
        a, b, limit = one.copy(), two.copy(), np.full(len(one), n, np.int64)
        while len(open_):
            crossing = self.merged[self.pairs.find(tx.mix((a * n + b).astype(np.uint64)))] < limit
            holds[open_[crossing]] = False
            single_a, single_b = self.left[a] == a, self.left[b] == b
            done = crossing | (single_a & single_b)
            # Equal merges run from the left: on a tie the right piece was made last.
            undo_a = ~single_a & (single_b | (a > b))
            limit = np.where(undo_a, a, b + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
            keep = ~done
            open_, a, b, limit = open_[keep], a[keep], b[keep], limit[keep]
        return holds

    def _decoding(self, model, kinds: np.ndarray) -> None:
        pieces = []
        for k, p in enumerate(model.pieces):
            pieces.append(bytes([int(p.piece[3:5], 16)]) if kinds[k] == BYTE else b" \xe2\x81\x87 " if kinds[k] == UNKNOWN else b"" if kinds[k] == CONTROL else p.piece.replace("▁", " ").encode())
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.piece_size = np.array([len(p) for p in pieces], np.int64)
        self.piece_first = np.cumsum(self.piece_size) - self.piece_size
        self.marked = np.array([p.piece.startswith("▁") for p in model.pieces])

    def normalize(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code points with spaces marked, squeezed and stripped as the model asks, and row offsets."""
        points, _, rows = code_points(data, offsets)
        n = len(points)
        space = points == 0x20
        marked = np.where(space, SPACE_MARK, points).astype(np.uint32)
        keep = np.ones(n, bool)
        if self.squeeze and n:
            edge = np.zeros(n + 1, bool)
            edge[rows] = True
            keep = ~(space & (np.concatenate(([True], space[:-1])) | edge[:-1]))
            # Spaces at the end go, and there a mark that stood in the text counts as one.
            closing = marked == SPACE_MARK
            lasting = np.flatnonzero(~closing)
            upto = np.searchsorted(lasting, rows[1:])
            end = np.where(upto > np.searchsorted(lasting, rows[:-1]), np.append(lasting, 0)[upto - 1] + 1, rows[:-1])
            tail = tx.ranges(end, rows[1:] - end)
            keep[tail] = False
        sums = np.concatenate(([0], np.cumsum(keep)))
        out, bounds = marked[keep], sums[rows]
        if self.prefix:
            filled = np.flatnonzero(np.diff(bounds) > 0)
            out = np.insert(out, bounds[filled], SPACE_MARK)
            bounds = bounds + np.concatenate(([0], np.cumsum(np.diff(bounds) > 0)))
        return out, bounds

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after the other and the number of ids of each row."""
        points, bounds = self.normalize(data, offsets)
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        kind = self.char_class[points]
        cut = np.concatenate(([True], ~self.beside[kind[:-1], kind[1:]]))
        cut[bounds[bounds < len(points)]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(points))
        codes = _codes(points)
        self.sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(codes * tx.powers(tx.BASE, len(points)), out=self.sums[1:])
        self.chunk = (points, starts, ends)
        ids, counts = self.cache.ids(tx.mix(self._range_hash(starts, ends)))
        sums = np.concatenate(([0], np.cumsum(counts)))
        return ids, np.diff(sums[np.searchsorted(starts, bounds)])

    def _range_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        inverse = tx.powers(tx.BASE_INVERSE, len(self.sums))
        return (self.sums[ends] - self.sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)

    def _probe(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Piece of each substring, -1 if it is none."""
        return self.pieces.find(tx.mix(self._range_hash(starts, ends)))

    def _encode_units(self, at: np.ndarray, _: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        points, starts, ends = self.chunk
        lengths = ends[at] - starts[at]
        counts = np.zeros(len(at), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []  # units, their ids in a row each
        for length in np.unique(lengths):
            units = np.flatnonzero(lengths == length)
            step = max(1, CELLS // int(length))
            for k in range(0, len(units), step):
                some = units[k : k + step]
                ids, n = self._segment(points, starts[at[some]], int(length))
                counts[some] = n
                parts.append((some, ids))
        out = np.empty(int(counts.sum()), np.int32)
        first = np.cumsum(counts) - counts
        for some, ids in parts:
            out[tx.ranges(first[some], counts[some])] = ids
        return out, counts

    def _segment(self, points: np.ndarray, begin: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units of one length (each unit's after the other) and their numbers."""
        w = len(begin)
        last = np.full((length + 1, w), -1, np.int32)
        best = np.full((length + 1, w), -np.inf) if self.kind == UNIGRAM else None
        if best is not None:
            best[0] = 0
        reach = self.reach[self.char_class[points[begin + np.arange(length)[:, None]]]]
        piece = np.empty(w, np.int64)
        for end in range(1, length + 1):
            for size in range(1, min(end, self.longest) + 1):
                lanes = np.flatnonzero(reach[end - size] >= size)
                if self.kind == BPE:  # one piece is admitted at each end
                    lanes = lanes[last[end, lanes] < 0]
                    lanes = lanes[last[end - size, lanes] >= 0] if size < end else lanes
                if not len(lanes):
                    continue
                found = self._probe(begin[lanes] + end - size, begin[lanes] + end)
                piece[lanes] = found
                lanes = lanes[found >= 0]
                if self.kind == BPE:
                    lanes = lanes[self.reached[piece[lanes]]]
                    if size < end:
                        lanes = lanes[self._admits(last[end - size, lanes].astype(np.int64), piece[lanes])]
                else:
                    value = best[end - size, lanes] + self.scores[piece[lanes]]
                    better = value > best[end, lanes]
                    lanes = lanes[better]
                    best[end, lanes] = value[better]
                last[end, lanes] = piece[lanes]
            if self.kind == UNIGRAM:  # an unknown character is taken alone
                lanes = np.flatnonzero(last[end] < 0)
                best[end, lanes], last[end, lanes] = best[end - 1, lanes] + self.scores.min() - 10, -2
        # Follow the back pointers of all units together.
        place = np.full(w, length)
        rows, ends, pieces = [], [], []
        while True:
            lanes = np.flatnonzero(place > 0)
            if not len(lanes):
                break
            piece = last[place[lanes], lanes].astype(np.int64)
            rows.append(lanes)
            ends.append(place[lanes])
            pieces.append(piece)
            place[lanes] -= np.where(piece >= 0, self.sizes[piece], 1)
        row, end, piece = (np.concatenate(x) for x in (rows, ends, pieces))
        order = np.lexsort((end, row))
        row, end, piece = row[order], end[order], piece[order]
        ids = np.where(piece >= 0, self.ids[piece], -1)
        bare = np.flatnonzero(ids < 0)
        counts = np.ones(len(ids), np.int64)
        if not len(bare):
            return ids, np.bincount(row, minlength=w)
        filled = [self._spelled(int(points[begin[row[k]] + end[k] - 1])) for k in bare.tolist()]
        counts[bare] = [len(f) for f in filled]
        out = np.repeat(ids, counts)
        out[tx.ranges((np.cumsum(counts) - counts)[bare], counts[bare])] = [i for f in filled for i in f]
        return out, np.bincount(row, counts, minlength=w).astype(np.int64)

    def _spelled(self, point: int) -> list[int]:
        return [int(self.byte_ids[b]) for b in chr(point).encode()] if self.fallback else [self.unknown]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """UTF-8 text of each row of ids."""
        sizes = self.piece_size[ids]
        raw = self.piece_bytes[tx.ranges(self.piece_first[ids], sizes)].tobytes()
        ends = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(counts)))]
        firsts = np.cumsum(counts) - counts
        out = []
        for k, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
            if counts[k] and (self.prefix or self.squeeze) and self.marked[ids[firsts[k]]]:
                a += 1
            out.append(raw[a:b])
        return out


def codec(path: str) -> Codec:
    """One codec for each worker process."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers), decoded_sha256 and round_trip.

    ``round_trip`` says that decoding the ids gives back the normalised text.
    """
    base = texts(docs, id_col, text_col)
    kind = base.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(model)
        for rows, data, offsets in releasing(tx.text_chunks(batches, limit=CHUNK), coder.cache):
            ids, counts = coder.encode(data, offsets)
            points, bounds = coder.normalize(data, offsets)
            wanted = np.where(points == SPACE_MARK, 0x20, points).astype(np.uint32)
            begin = bounds[:-1] + ((counts > 0) & (coder.prefix | coder.squeeze) & (np.append(wanted, 0)[bounds[:-1]] == 0x20))
            sums = np.concatenate(([0], np.cumsum(counts)))
            little = ids.astype("<u4")
            decoded = coder.decode(ids, counts)
            same = [decoded[k] == wanted[a:b].tobytes().decode("utf-32-le").encode() for k, (a, b) in enumerate(zip(begin.tolist(), bounds[1:].tolist()))]
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    pa.ListArray.from_arrays(pa.array(sums.astype(np.int32)), pa.array(ids, pa.int32())),
                    pa.array(counts, pa.int64()),
                    pa.array([zlib.crc32(little[a:b].tobytes()) for a, b in zip(sums[:-1], sums[1:])], pa.int64()),
                    pa.array([hashlib.sha256(d).hexdigest() for d in decoded]),
                    pa.array(same),
                ],
                names=["doc_id", "ids", "n_tokens", "ids_crc32", "decoded_sha256", "round_trip"],
            )

    return base.mapInArrow(portable(run), f"doc_id {kind}, ids array<int>, n_tokens bigint, ids_crc32 bigint, decoded_sha256 string, round_trip boolean")


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the text of a column of ids; bytes that are no UTF-8 become U+FFFD, null ids the empty text."""
    base = encoded.select(encoded[id_col].alias("doc_id"), encoded[ids_col].cast("array<int>").alias("ids"))
    kind = base.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                rows = [np.array(x or [], np.int64) for x in batch.column(1).slice(at, 1000).to_pylist()]
                decoded = coder.decode(np.concatenate(rows), np.array([len(r) for r in rows]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1000), pa.array([d.decode("utf-8", "replace") for d in decoded])], names=["doc_id", "text"])

    return base.mapInArrow(portable(run), f"doc_id {kind}, text string")
