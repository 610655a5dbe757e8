"""Byte-pair encoding of words by speculation and verification, and decoding (operator 11).

A vocabulary file of kind BPE with word ends gives the pieces and merges. A text is cut at ASCII white
space; every distinct unit is normalised and cut into words by the file's own rules. Words are then
encoded together:

1. *Speculate.* The longest vocabulary entry at each position is found by probing substring hashes in a
   table of all prefixes of entries; following these matches proposes the tokens of every word.
2. *Verify.* Merging yields a sequence of tokens exactly if it leaves each adjacent pair as it is. One
   vectorised check undoes the last merges on both sides of each border, later ones first; if the parts
   that then touch would have merged earlier than what was undone, merging would have crossed the border.
3. *Repair.* Only words with a failing border are merged exactly, lowest rank first and from the left.

Entries that merging does not yield from their own characters are never proposed. Ids equal the library's.

Defined results: null or empty text, and text of white space only, has no ids and decodes to the empty text;
rows that repeat get equal results; an empty table gives no rows; other columns are not read. A word of n
characters takes time n log n at most, whatever its length; a task holds one chunk of text or one document.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidelog.llm import text as tx
from tidelog.llm.encoding import HashIndex, PieceCache
from tidelog.llm.shared import portable, releasing, texts

WORD_END = 512  # added to the code of a word's last character; byte-level characters lie below it
LONG_WORD = 64  # characters; the words up to here are merged together
_codecs: dict = {}


def _scattered(codes: np.ndarray) -> np.ndarray:
    return tx.mix(codes.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + np.uint64(0x632BE59BD9B4E019))


class WordBpe:
    """A vocabulary file, opened for encoding and decoding chunks of texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], spec["added_tokens"]
        self._require_supported(spec, model, added)
        library = Tokenizer.from_file(path)
        self.normalize = library.normalizer.normalize_str if library.normalizer else str
        self.split = library.pre_tokenizer.pre_tokenize_str
        self.suffix = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in added}
        self.special_parts = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if added else None
        vocabulary = model["vocab"]
        self.size = max([*vocabulary.values(), *self.special.values()]) + 1
        self._merges(vocabulary, [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]])
        self._entries(vocabulary)
        names = [b""] * self.size
        for name, k in [*vocabulary.items(), *self.special.items()]:
            names[k] = name.encode() + b" "
        self.name_bytes = np.frombuffer(b"".join(names), np.uint8)
        self.name_size = np.array([len(n) for n in names], np.int64)
        self.name_first = np.cumsum(self.name_size) - self.name_size
        self.cache = PieceCache(self._encode_units, bits=20, pool=1 << 22)

    @staticmethod
    def _require_supported(spec: dict, model: dict, added: list) -> None:
        steps = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
        # White space must end every word, so that texts can be cut there first.
        drops_space = any(s["type"] == "Split" and s["behavior"] == "Removed" and s["invert"] and "^\\s" in s["pattern"].get("Regex", "") for s in steps)
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or steps[-1]["type"] != "ByteLevel" or not drops_space:
            raise ValueError("only byte-level BPE files with word ends that drop white space are supported")
        if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError("dropout, unknown tokens, inner prefixes, byte fallback and ignored merges are not supported")
        if spec["decoder"] is not None or spec["truncation"] or spec["padding"]:
            raise ValueError("decoders, truncation and padding are not supported")
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in added):
            raise ValueError("only plain special tokens without white space are supported")

    def _codes(self, name: str) -> list[int]:
        last = name.endswith(self.suffix) and len(name) > len(self.suffix)
        codes = [ord(c) for c in (name[: -len(self.suffix)] if last else name)]
        if last:
            codes[-1] += WORD_END
        return codes

    def _merges(self, vocabulary: dict, merges: list) -> None:
        """Rank and parts of every merged entry, and the rank at which two entries merge."""
        n = self.size
        self.rank = np.full(n, -1, np.int64)
        self.left, self.right = np.arange(n), np.arange(n)
        left = np.array([vocabulary[a] for a, _ in merges], np.int64)
        right = np.array([vocabulary[b] for _, b in merges], np.int64)
        made = np.array([vocabulary[a + b] for a, b in merges], np.int64)
        self.rank[made] = np.arange(len(made))
        self.left[made], self.right[made], self.made = left, right, made
        if len(np.unique(made)) < len(made) or (np.maximum(self.rank[left], self.rank[right]) >= np.arange(len(made))).any():
            raise ValueError("merges must make each entry once and after its parts")
        packed = left * n + right
        self.pairs = HashIndex(tx.mix(packed.astype(np.uint64)), bits=18)
        self.pair_rank = np.append(np.arange(len(made)), len(made))  # the last: no merge
        self.merge_of = dict(zip(packed.tolist(), zip(range(len(made)), made.tolist())))
        holds = self.border_holds(left, right, np.arange(len(made)))
        whole = [True] * n  # entries that merging yields from their own characters
        for a, b, m, ok in zip(left.tolist(), right.tolist(), made.tolist(), holds.tolist()):
            whole[m] = ok and whole[a] and whole[b]
        self.whole = np.array(whole)

    def _entries(self, vocabulary: dict) -> None:
        """A hash table of all prefixes of entries; prefixes that are entries name them."""
        from tokenizers import pre_tokenizers

        self.symbol = np.full(2 * WORD_END, -1, np.int64)
        found: dict[tuple, int] = {}
        for name, k in vocabulary.items():
            codes = tuple(self._codes(name))
            if max(codes) >= 2 * WORD_END:
                raise ValueError("entries must be byte-level characters")
            if len(codes) == 1:
                self.symbol[codes[0]] = k
            if self.whole[k]:
                for end in range(1, len(codes)):
                    found.setdefault(codes[:end], -1)
                found[codes] = k
        alphabet = [ord(c) for c in pre_tokenizers.ByteLevel.alphabet()]
        if (self.symbol[alphabet] < 0).any() or (self.symbol[[c + WORD_END for c in alphabet]] < 0).any():
            raise ValueError("every byte must be an entry, inside a word and at its end")
        sizes = np.array([len(c) for c in found], np.int64)
        flat = np.array([c for codes in found for c in codes], np.int64)
        first = np.cumsum(sizes) - sizes
        keys = np.zeros(len(sizes), np.uint64)
        for at in range(int(sizes.max())):  # the same rolling hash as for texts
            lanes = np.flatnonzero(sizes > at)
            keys[lanes] = keys[lanes] * np.uint64(tx.BASE) + _scattered(flat[first[lanes] + at])
        self.prefixes = HashIndex(tx.mix(keys), bits=18)
        self.entry = np.append(np.array(list(found.values()), np.int64), -1)

    def border_holds(self, one: np.ndarray, two: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Whether merging leaves entry ``two`` after entry ``one`` at all ranks below ``before``."""
        holds, open_ = np.ones(len(one), bool), np.arange(len(one))
        a, b, until = one.copy(), two.copy(), before.copy()
        while len(open_):
            # The two parts touch from when both are made until the earlier of their next merges.
            crossing = self.pair_rank[self.pairs.find(tx.mix((a * self.size + b).astype(np.uint64)))] < until
            holds[open_[crossing]] = False
            later_a = self.rank[a] > self.rank[b]  # of equal merges the left one comes first
            made = np.where(later_a, self.rank[a], self.rank[b])
            # On the left an equal merge inside goes first; on the right it comes after one across the border.
            until = np.where(later_a, made, made + 1)
            more = ~crossing & (made >= 0)
            a, b = np.where(later_a, self.right[a], a), np.where(later_a, b, self.left[b])
            open_, a, b, until = open_[more], a[more], b[more], until[more]
        return holds

    def _longest(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and length of the longest match at every position; none crosses a word's end."""
        n = len(codes)
        entry, length = self.symbol[codes], np.ones(n, np.int64)
        lanes, keys, size = np.arange(n), np.zeros(n, np.uint64), 0
        scattered = _scattered(codes)
        while len(lanes):
            keys = keys * np.uint64(tx.BASE) + scattered[lanes + size]
            at = self.prefixes.find(tx.mix(keys))
            size += 1
            hit = np.flatnonzero(self.entry[at] >= 0)
            entry[lanes[hit]], length[lanes[hit]] = self.entry[at[hit]], size
            more = np.flatnonzero((at >= 0) & (lanes + size < n))
            more = more[codes[lanes[more] + size - 1] < WORD_END]
            lanes, keys = lanes[more], keys[more]
        return entry, length

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct byte-level words one after the other, and the number of ids of each."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        ends = np.cumsum([len(w) for w in words])
        codes[ends - 1] += WORD_END
        entry, length = self._longest(codes)
        step, at, path = (np.arange(len(codes)) + length).tolist(), 0, []
        while at < len(codes):
            path.append(at)
            at = step[at]
        place = np.array(path, np.int64)
        tokens, word = entry[place], np.searchsorted(ends, place, "right")
        inner = np.flatnonzero(word[:-1] == word[1:])
        pair, back = np.unique(tokens[inner] * self.size + tokens[inner + 1], return_inverse=True)
        holds = self.border_holds(pair // self.size, pair % self.size, np.full(len(pair), len(self.pair_rank) - 1))
        failing = np.unique(word[inner[~holds[back]]])
        counts = np.bincount(word, minlength=len(words))
        if len(failing):
            starts = np.concatenate(([0], ends[:-1]))
            fresh, exact = self._merge_all(codes, starts[failing], ends[failing])
            keep = ~np.isin(word, failing)
            word, tokens = np.concatenate((word[keep], failing[fresh])), np.concatenate((tokens[keep], exact))
            tokens, counts = tokens[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))
        return tokens, counts

    def _merge_all(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact tokens of words, with the number of the word that each belongs to.

        Each round merges the leftmost pair of the lowest rank in every word; a long word goes alone.
        """
        none, n = len(self.pair_rank) - 1, self.size
        long = np.flatnonzero(ends - starts > LONG_WORD)
        rest = np.flatnonzero(ends - starts <= LONG_WORD)
        alone = [self.merge(self.symbol[codes[starts[k] : ends[k]]].tolist()) for k in long.tolist()]
        words = [np.repeat(long, [len(a) for a in alone])]
        tokens = [np.array([t for a in alone for t in a], np.int64)]
        word = np.repeat(rest, (ends - starts)[rest])
        part = self.symbol[codes[tx.ranges(starts[rest], (ends - starts)[rest])]]

        def ranks(at: np.ndarray) -> np.ndarray:
            found = self.pair_rank[self.pairs.find(tx.mix((part[at] * n + part[at + 1]).astype(np.uint64)))]
            return np.where(word[at] == word[at + 1], found, none)

        rank = np.append(ranks(np.arange(len(part) - 1)), none) if len(part) else part
        while len(part):
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            least = np.minimum.reduceat(rank * len(part) + np.arange(len(part)), first)
            open_, at = least // len(part) < none, least % len(part)
            done = np.repeat(~open_, np.diff(np.append(first, len(part))))
            words.append(word[done])
            tokens.append(part[done])
            at = at[open_]
            part[at] = self.made[rank[at]]
            keep = ~done
            keep[at + 1] = False
            at = (np.cumsum(keep) - 1)[at]
            word, part, rank = word[keep], part[keep], rank[keep]
            touched = np.unique(np.concatenate((at - 1, at)))
            touched = touched[(touched >= 0) & (touched < len(part) - 1)]
            rank[at] = none
            rank[touched] = ranks(touched)
        words, tokens = np.concatenate(words), np.concatenate(tokens)
        order = np.argsort(words, kind="stable")
        return words[order], tokens[order]

    def merge(self, parts: list[int]) -> list[int]:
        """Exact merging of one word: always the lowest rank, from the left."""
        n, merge_of = self.size, self.merge_of
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(m[0], k, a, b, m[1]) for k, (a, b) in enumerate(zip(parts, parts[1:])) if (m := merge_of.get(a * n + b))]
        heapq.heapify(heap)
        while heap:
            _, k, a, b, made = heapq.heappop(heap)
            j = after[k]
            if parts[k] != a or j >= len(parts) or parts[j] != b:
                continue
            parts[k], parts[j] = made, -1
            after[k] = j = after[j]
            if j < len(parts):
                before[j] = k
                if m := merge_of.get(made * n + parts[j]):
                    heapq.heappush(heap, (m[0], k, made, parts[j], m[1]))
            if (i := before[k]) >= 0 and (m := merge_of.get(parts[i] * n + made)):
                heapq.heappush(heap, (m[0], i, parts[i], made, m[1]))
        return [p for p in parts if p >= 0]

    def _encode_units(self, at: np.ndarray, _: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units of the chunk at hand: special tokens stand for themselves, the rest is cut into words."""
        raw, starts, ends = self.chunk
        units = [raw[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist())]
        plain, of_plain, given, of_given, place = [], [], [], [], 0
        for k, unit in enumerate(units):
            for part in self.special_parts.split(unit) if self.special_parts and "<" in unit else [unit]:
                if part in self.special:
                    given.append(self.special[part])
                    of_given.append((k, place))
                elif part:
                    plain.append(part.lower() if part.isascii() and self.ascii_lower else self.normalize(part))
                    of_plain.append((k, place))
                place += 1
        firsts = np.cumsum([0, *(len(p) + 1 for p in plain)])
        found = self.split(" ".join(plain))
        numbers: dict[str, int] = {}
        which = np.array([numbers.setdefault(word, len(numbers)) for word, _ in found], np.int64)
        ids, counts = self.encode_words(list(numbers))
        begin = np.cumsum(counts) - counts
        part = np.searchsorted(firsts, np.array([span[0] for _, span in found], np.int64), "right") - 1
        owner = np.array(of_plain, np.int64).reshape(-1, 2)[part]
        out = ids[tx.ranges(begin[which], counts[which])] if len(which) else np.zeros(0, np.int64)
        unit, order = (np.repeat(owner[:, c], counts[which]) for c in (0, 1))
        if given:
            specials = np.array(of_given, np.int64)
            unit, order = np.concatenate((unit, specials[:, 0])), np.concatenate((order, specials[:, 1]))
            out = np.concatenate((out, np.array(given, np.int64)))[np.argsort(order, kind="stable")]
        return out.astype(np.int32), np.bincount(unit, minlength=len(units))

    @property
    def ascii_lower(self) -> bool:
        """Whether the normaliser does no more to ASCII without white space than to lower its case."""
        if not hasattr(self, "_ascii_lower"):
            every = [chr(c) for c in range(128) if not chr(c).isspace()]
            self._ascii_lower = all(self.normalize(c) == c.lower() for c in [*every, "".join(every)])
        return self._ascii_lower

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after the other and the number of ids of each row."""
        starts, ends, first = tx.words(data, offsets, ~tx.SPACE)
        self.chunk = (data.tobytes(), starts, ends)
        ids, counts = self.cache.ids(tx.RangeHash(data).of(starts, ends))
        return ids, np.diff(np.concatenate(([0], np.cumsum(counts)))[first])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Text of each row of ids: the entries joined by one space; ids outside the file are left out."""
        inside = (ids >= 0) & (ids < self.size)
        sizes = np.where(inside, self.name_size[np.where(inside, ids, 0)], 0)
        raw = self.name_bytes[tx.ranges(self.name_first[np.where(inside, ids, 0)], sizes)].tobytes()
        ends = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(counts)))].tolist()
        return [raw[a : max(a, b - 1)].decode() for a, b in zip(ends, ends[1:])]


def codec(path: str) -> WordBpe:
    """One codec for each worker process."""
    if path not in _codecs:
        _codecs[path] = WordBpe(path)
    return _codecs[path]


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids and n_tokens of every whole text, and ``decoded``: the text that decoding the ids gives."""
    base = texts(docs, id_col, text_col)
    kind = base.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(vocabulary)
        for rows, data, offsets in releasing(tx.text_chunks(batches), coder.cache):
            ids, counts = coder.encode(data, offsets)
            firsts = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.ListArray.from_arrays(firsts, pa.array(ids, pa.int32())), pa.array(counts, pa.int64()), pa.array(coder.decode(ids, counts), pa.string())],
                names=["doc_id", "ids", "n_tokens", "decoded"],
            )

    return base.mapInArrow(portable(run), f"doc_id {kind}, ids array<int>, n_tokens bigint, decoded string")


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the text of a column of ids; null ids are the empty text, null entries are left out."""
    base = encoded.select(encoded[id_col].alias("doc_id"), encoded[ids_col].cast("array<int>").alias("ids"))
    kind = base.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                rows = [np.array([-1 if i is None else i for i in x or []], np.int64) for x in batch.column(1).slice(at, 1000).to_pylist()]
                decoded = coder.decode(np.concatenate(rows), np.array([len(r) for r in rows]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1000), pa.array(decoded, pa.string())], names=["doc_id", "text"])

    return base.mapInArrow(portable(run), f"doc_id {kind}, text string")
