"""Byte-pair encoding by an index of pair occurrences, and its decoding.

The distinct pre-tokens of a block of rows are laid out as one row of symbols.  An index maps each mergeable pair to
all its positions there; ranks that occur are applied in ascending order, each at all its positions at once, and every
merge adds the two pairs that it makes to the lists of their ranks.  Pairs that a merge breaks stay in their lists and
are told by their symbols, which no longer match.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm.blocks import WIDE_BLOCK_BYTES, fresh_name, map_batches, take_ranges, text_blocks
from paperloom.llm.codecs import EDGE, WordCodec, model_bytes, shared

SYMBOLS = 1 << 19  # of pre-tokens that are merged together
# White space of the pattern, and the parts of English words that it cuts off.
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SHORT_FORMS = "'s|'t|'re|'ve|'m|'ll|'d"


def byte_signs() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary.  Fixed rule: the printable bytes
    stand for themselves, the others get the characters from 256 on in rising order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


def split_pattern(late: str = "") -> str:
    """The byte-level pattern; characters of ``late`` (a class) count as marks instead of letters or numbers."""
    letters, numbers = (rf"[\p{{{kind}}}--[{late}]]" if late else rf"\p{{{kind}}}" for kind in "LN")
    marks = rf"(?:[^{SPACES}\p{{L}}\p{{N}}]|[{late}])" if late else rf"[^{SPACES}\p{{L}}\p{{N}}]"
    return rf"(?V1){SHORT_FORMS}| ?{letters}+| ?{numbers}+| ?{marks}+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"


def late_characters(definition: str) -> str:
    """Letters and numbers of this Python's edition of Unicode that the tokenizer's own library does not know, as a
    class of ranges.  Only characters unknown to the standard library come into question; the tokenizer is asked."""
    from tokenizers import Tokenizer

    cut = Tokenizer.from_str(definition).pre_tokenizer
    every = "".join(map(chr, (c for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000)))
    ranges: list[list[int]] = []
    for c in regex.findall(r"[\p{L}\p{N}]", every):
        if unicodedata.category(c) == "Cn" and min(len(cut.pre_tokenize_str(like + c)) for like in "a1") > 1:
            if ranges and ranges[-1][1] == ord(c) - 1:
                ranges[-1][1] += 1
            else:
                ranges.append([ord(c), ord(c)])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


@dataclass(frozen=True)
class Vocabulary:
    """What tasks need of a vocabulary file, prepared once on the driver."""

    definition: str
    late: str

    @staticmethod
    def read(path: str) -> Vocabulary:
        definition = model_bytes(path).decode()
        return Vocabulary(definition, late_characters(definition))


class Merges:
    """Ranks of pairs of symbols, and the merging of many pre-tokens at once."""

    def __init__(self, definition: dict) -> None:
        model = definition["model"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix") if model.get(k)]
        odd += [k for k in ("byte_fallback", "ignore_merges", "fuse_unk") if model.get(k)]
        cut = definition["pre_tokenizer"]
        if odd or definition["normalizer"] or cut["type"] != "ByteLevel" or cut["add_prefix_space"] or not cut["use_regex"]:
            raise ValueError(f"not a plain byte-level vocabulary: {odd}")
        vocab = model["vocab"]
        self.size = max(vocab.values()) + 2
        self.end = self.size - 1  # stands between pre-tokens and in no pair
        self.of_byte = np.array([vocab[c] for c in byte_signs()], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.first = [vocab[a] for a, _ in pairs]
        self.second = [vocab[b] for _, b in pairs]
        self.made = [vocab[a + b] for a, b in pairs]
        self.rank = {a * self.size + b: r for r, (a, b) in enumerate(zip(self.first, self.second, strict=True))}
        # Ranks can be applied to all words at once only if what a merge makes is never part of an earlier one.
        born = dict(zip(reversed(self.made), range(len(pairs) - 1, -1, -1), strict=True))
        late = (r for r, (a, b) in enumerate(zip(self.first, self.second, strict=True)) if max(born.get(a, -1), born.get(b, -1)) >= r)
        if len(born) < len(pairs) or next(late, None) is not None or len(self.rank) < len(pairs):
            raise ValueError("the merges are not in the order of their making")
        keys = np.array(list(self.rank), np.int64)
        self.by_key = np.argsort(keys)
        self.keys = keys[self.by_key]

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens, one after the other, and how many each has."""
        flat, sizes, start = [], [], 0
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        while start < len(words):
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] - lengths[start] + SYMBOLS, "right")))
            ids, counts = self._merged(words[start:stop], lengths[start:stop])
            flat.append(ids)
            sizes.append(counts)
            start = stop
        if not flat:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        return np.concatenate(flat), np.concatenate(sizes)

    def _merged(self, words: list[bytes], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(words), np.uint8)
        # one separator before each word and one at the end
        row = np.full(len(data) + len(words) + 1, self.end, np.int64)
        row[np.arange(len(data)) + np.repeat(np.arange(1, len(words) + 1), lengths)] = self.of_byte[data]
        keys = row[:-1] * self.size + row[1:]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        places = np.flatnonzero(self.keys[at] == keys)
        ranks = self.by_key[at[places]]
        order = np.argsort(ranks, kind="stable")
        active, begins = np.unique(ranks[order], return_index=True)
        where = dict(zip(active.tolist(), (p.tolist() for p in np.split(places[order], begins[1:])), strict=True)) if len(active) else {}
        out = np.array(self._apply(row.tolist(), where, active.tolist()), np.int64)
        word = np.cumsum(out == self.end) - 1
        alive = (out >= 0) & (out != self.end)
        return out[alive].astype(np.uint32), np.bincount(word[alive], minlength=len(words))

    def _apply(self, symbols: list[int], where: dict[int, list[int]], heap: list[int]) -> list[int]:
        """Symbols after all merges; places that were merged into the one before hold -1."""
        size, rank, pushed = self.size, self.rank.get, heapq.heappush
        before, after = list(range(-1, len(symbols) - 1)), list(range(1, len(symbols) + 1))
        while heap:
            r = heapq.heappop(heap)
            a, b, c = self.first[r], self.second[r], self.made[r]
            places = where.pop(r)
            if a == b:  # places may overlap, the first one wins
                places.sort()
            for p in places:
                q = after[p]
                if symbols[p] != a or symbols[q] != b:
                    continue
                symbols[p], symbols[q] = c, -1
                behind, ahead = before[p], after[q]
                after[p] = ahead
                before[ahead] = p
                for place, key in ((behind, symbols[behind] * size + c), (p, c * size + symbols[ahead])):
                    new = rank(key)
                    if new is not None:
                        held = where.get(new)
                        if held is None:
                            where[new] = [place]
                            pushed(heap, new)
                        else:
                            held.append(place)
        return symbols


class PairIndexCodec(WordCodec):
    """Ids of texts: words between single spaces are met once per block and worker cache, cut by the pattern, and all
    their distinct pre-tokens are merged together.

    Added tokens are found in the text first, as the tokenizers library does; a row that holds one, like one with
    white space at a word's edge, is cut whole.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        definition = json.loads(vocabulary.definition)
        self.merges = Merges(definition)
        self.cut = regex.compile(split_pattern())
        self.late = regex.compile(f"[{vocabulary.late}]") if vocabulary.late else None
        self.cut_late = regex.compile(split_pattern(vocabulary.late))
        added = definition.get("added_tokens") or []
        if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip")) or any(" " in t["content"] for t in added):
            raise ValueError("added tokens that take in their surroundings are not supported")
        self.added = {t["content"]: t["id"] for t in added}
        longest = sorted(self.added, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")") if longest else None

    def odd(self, words: pa.Array) -> pa.Array:
        out = pc.or_(pc.equal(words, ""), pc.match_substring_regex(words, EDGE))
        for token in self.added:
            out = pc.or_(out, pc.match_substring(words, token))
        return out

    def encode(self, keys: list[str]) -> list[bytes]:
        """Ids of each text as bytes of 32-bit numbers; every distinct pre-token of all texts is merged once."""
        numbers: dict[str, int] = {}
        parts, ends, number = array("q"), [0], numbers.setdefault
        late = self.late is not None and any(self.late.search(k) for k in keys if not k.isascii())
        cut = (self.cut_late if late else self.cut).findall
        for key in keys:
            for k, part in enumerate(self.special.split(key) if self.special else (key,)):
                if k % 2:
                    parts.append(-1 - self.added[part])
                else:
                    parts.extend([number(w, len(numbers)) for w in cut(part)])
            ends.append(len(parts))
        ids, sizes = self.merges.encode([w.encode() for w in numbers])
        extra = np.array(list(self.added.values()), np.uint32)
        slot = np.frombuffer(parts, np.int64).copy() if parts else np.zeros(0, np.int64)
        for k, token in enumerate(extra.tolist()):
            slot[slot == -1 - token] = len(sizes) + k
        ids, sizes = np.concatenate([ids, extra]), np.concatenate([sizes, np.ones(len(extra), np.int64)])
        lengths = sizes[slot]
        flat = take_ranges(ids, (np.cumsum(sizes) - sizes)[slot], lengths).astype("<u4")
        bounds = np.concatenate([[0], np.cumsum(lengths)])[ends] * 4
        data = flat.tobytes()
        return [data[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


class Speller:
    """Bytes of every id."""

    def __init__(self, definition: str) -> None:
        parsed = json.loads(definition)
        if parsed["decoder"]["type"] != "ByteLevel":
            raise ValueError("not a byte-level vocabulary")
        names = {i: name for name, i in parsed["model"]["vocab"].items()} | {t["id"]: t["content"] for t in parsed.get("added_tokens") or []}
        byte_of = {sign: b for b, sign in enumerate(byte_signs())}
        spelt = [
            bytes(byte_of[c] for c in name) if all(c in byte_of for c in name) else name.encode()
            for name in (names.get(i, "") for i in range(max(names) + 1))
        ]
        self.flat = np.frombuffer(b"".join(spelt), np.uint8)
        self.sizes = np.fromiter(map(len, spelt), np.int64, len(spelt))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def texts(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """Decoded rows; bytes that are no UTF-8 become U+FFFD, numbers that are no ids nothing."""
        ids = ids[known] if not (known := (ids >= 0) & (ids < len(self.sizes))).all() else ids
        if len(known) != len(ids):
            ends = np.concatenate([[0], np.cumsum(known)])[ends]
        lengths = self.sizes[ids]
        data = take_ranges(self.flat, self.starts[ids], lengths)
        bounds = np.concatenate([[0], np.cumsum(lengths)])[ends]
        rows = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        try:
            return rows.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([b.decode("utf-8", "replace") for b in rows.to_pylist()], pa.string())


DECODED_IDS = 1 << 18  # ids that are spelt at a time; a longer row is a slice of its own


def encode_bpe(docs: DataFrame, vocabulary: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` without ``text_col`` and with ``out``, the ids of the whole text as the tokenizers library gives them
    without further special tokens.  Map-only; all other columns stay.

    Null and empty texts have no ids.  The vocabulary must be a plain byte-level one whose merges are in the order of
    their making; anything else is refused.
    """
    held = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(vocabulary))
    others = [c for c in docs.columns if c != text_col]
    out = fresh_name(docs.select(*(F.col(f"`{c}`") for c in others)), out)
    schema = T.StructType([*(docs.schema[c] for c in others), T.StructField(out, T.ArrayType(T.IntegerType(), False))])
    text = fresh_name(docs, "_text")
    rows = docs.select(*(F.col(f"`{c}`") for c in others), F.col(f"`{text_col}`").alias(text))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared(PairIndexCodec, held.value)
        for batch, texts in text_blocks(batches, text, WIDE_BLOCK_BYTES):
            ids, ends = codec.rows(texts)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.record_batch([*batch.columns[:-1], lists], [*others, out])

    return map_batches(rows, encode, schema)


def decode_bpe(rows: DataFrame, vocabulary: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with ``out``, the text that the ids spell, special tokens included.  Map-only.

    Null ids give an empty text; null entries and numbers that are no ids spell nothing.
    """
    held = rows.sparkSession.sparkContext.broadcast(model_bytes(vocabulary).decode())
    out = fresh_name(rows, out)
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = Speller(held.value)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids_col))
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
            ids = pc.fill_null(lists.flatten(), -1).to_numpy().astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            start = 0
            while start < len(sizes):
                stop = max(start + 1, int(np.searchsorted(ends, ends[start] + DECODED_IDS, "right")) - 1)
                texts = speller.texts(ids[ends[start] : ends[stop]], ends[start : stop + 1] - ends[start])
                part = batch.slice(start, stop - start)
                yield pa.record_batch([*part.columns, texts], [*batch.schema.names, out])
                start = stop

    return map_batches(rows, decode, schema)
