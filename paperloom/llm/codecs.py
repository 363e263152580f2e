"""Word-wise encoding of text columns: each distinct word of a block is encoded once and its ids are copied to
all its places.  Workers keep what they have encoded in a cache of bounded size."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from paperloom.llm.blocks import raw, take_ranges

CACHE_ENTRIES = 120_000


class Recent(dict):
    """A dictionary of two generations: full, it forgets what was not asked for since the last change."""

    def __init__(self, entries: int = CACHE_ENTRIES) -> None:
        super().__init__()
        self.entries, self.old = entries, {}

    def lookup(self, keys: list[str], make: Callable[[list[str]], Iterable]) -> list:
        """Values of distinct keys; ``make`` gives those that are not held."""
        held = [self.get(k) for k in keys]
        for i in [i for i, v in enumerate(held) if v is None]:
            held[i] = self.old.get(keys[i])
        new = [i for i, v in enumerate(held) if v is None]
        for i, value in zip(new, make([keys[i] for i in new]), strict=True):
            held[i] = value
        if len(self) + len(keys) > self.entries:
            self.old = dict(self)
            self.clear()
        for k, v in zip(keys, held, strict=True):
            if len(k) <= 64:
                self[k] = v
        return held


def joined(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all entries, one after the other, and how many each has."""
    return np.frombuffer(b"".join(entries), "<u4"), np.fromiter(map(len, entries), np.int64, len(entries)) // 4


class WordCodec:
    """Base of the codecs.  ``encode`` gives ids of texts as bytes of 32-bit numbers.

    ``lead`` goes before each word that follows a space, ``first`` before the first word of a text.
    Rows with a word for which ``odd`` holds can't be cut at single spaces and are encoded whole.
    """

    lead, first = " ", ""

    def __init__(self) -> None:
        self.seen = Recent()

    def odd(self, words: pa.Array) -> pa.Array:
        raise NotImplementedError

    def encode(self, keys: list[str]) -> list[bytes]:
        raise NotImplementedError

    def table(self, words: pa.Array, lead: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words that follow ``lead``, and how many each has."""
        return joined(self.seen.lookup([lead + w for w in words.to_pylist()], self.encode))

    def rows(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and the offset of each row."""
        lists = pc.split_pattern(text, " ")
        ends = lists.offsets.to_numpy().astype(np.int64)
        ends, coded = ends - ends[0], lists.flatten().dictionary_encode()
        number, words = coded.indices.to_numpy(), coded.dictionary
        strange = self.odd(words).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(text)), np.diff(ends))
        whole = np.zeros(len(text), bool)
        whole[row[strange[number]]] = True
        opening = np.zeros(len(number), bool)
        opening[ends[:-1]] = True
        inner = ~whole[row] & ~opening
        heads = number[ends[:-1]]  # of rows that are encoded whole, too, where they go unused
        tables, place = [], np.zeros((2, len(words)), np.int64)
        for k, (used, lead) in enumerate(((number[inner], self.lead), (heads[~whole], self.first))):
            met = np.zeros(len(words), bool)
            met[used] = True
            place[k, met] = np.arange(met.sum()) + sum(len(sizes) for _, sizes in tables)
            tables.append(self.table(words.filter(pa.array(met)), lead))
        slot = place[0, number]
        slot[ends[:-1]] = place[1, heads]
        slot[ends[:-1][whole]] = sum(len(sizes) for _, sizes in tables) + np.arange(whole.sum())
        tables.append(joined(self.encode([self.first + t for t in text.filter(pa.array(whole)).to_pylist()])))
        flat, sizes = (np.concatenate(parts) for parts in zip(*tables, strict=True))
        keep = inner | opening
        slot, row = slot[keep], row[keep]
        lengths = sizes[slot]
        per_row = np.bincount(row, weights=lengths, minlength=len(text)).astype(np.int64)
        ids = take_ranges(flat, (np.cumsum(sizes) - sizes)[slot], lengths)
        return ids, np.concatenate([[0], np.cumsum(per_row)])


# Marks that, after a letter, begin a new unit of the byte-level pattern; white space at a word's edge;
# letters of the Latin blocks.
CLOSING = ".,;:!?|$%&*#"
_SPACE = r"[\x{09}-\x{0d}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
EDGE = rf"^{_SPACE}|{_SPACE}$"
LATIN = r"[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]"
TOGETHER = 4_000  # words in a text that is given to the library
HELD_WORDS = 400_000


class BytePairCodec(WordCodec):
    """Ids by the tokenizers library.  Its byte-level pattern cuts before the last space of a run of white space
    and between a letter and a mark, so words at single spaces can be encoded apart, and those that end in marks
    share the ids of the word without them.

    Words of letters go to the library many in one text; each is one unit of the pattern together with its space,
    so a word's ids start at each id that begins with a space.  Held words are an Arrow array beside their flat ids.
    """

    def __init__(self, definition: str) -> None:
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content for t in added]  # found in texts before the pattern cuts them
        names = map(self.tokenizer.id_to_token, range(self.tokenizer.get_vocab_size()))
        if any(" " in t or not t for t in self.added):
            raise ValueError("added tokens with spaces are not supported")
        self.opens = np.array([(n or "").startswith("\u0120") for n in names])  # fixed value: the library's sign for a space
        self.held = pa.array([], pa.string())
        self.flat, self.sizes = joined([])

    def odd(self, words: pa.Array) -> pa.Array:
        out = pc.or_(pc.equal(words, ""), pc.match_substring_regex(words, EDGE))
        for token in self.added:
            out = pc.or_(out, pc.match_substring(words, token))
        return out

    def encode(self, keys: list[str]) -> list[bytes]:
        coded = self.tokenizer.encode_batch_fast(keys, add_special_tokens=False)
        return [array("I", c.ids).tobytes() for c in coded]

    def table(self, words: pa.Array, lead: str) -> tuple[np.ndarray, np.ndarray]:
        core = pc.utf8_rtrim(words, CLOSING)
        core = pc.if_else(pc.match_substring_regex(core, LATIN + "$"), core, words)
        data, ends = raw(words)
        rest = np.diff(ends) - np.diff(raw(core)[1])
        marks = take_ranges(data, ends[1:] - rest, rest)
        bounds = np.concatenate([[0], np.cumsum(rest)]).astype(np.int32)
        tails = pa.StringArray.from_buffers(len(words), pa.py_buffer(bounds), pa.py_buffer(marks))
        core, tails = core.dictionary_encode(), tails.dictionary_encode()
        parts = [self._cores(core.dictionary, lead), joined(self.encode(tails.dictionary.to_pylist()))]
        flat, sizes = (np.concatenate(p) for p in zip(*parts, strict=True))
        slot = np.column_stack([core.indices.to_numpy(), tails.indices.to_numpy() + len(core.dictionary)])
        lengths = sizes[slot]
        return take_ranges(flat, (np.cumsum(sizes) - sizes)[slot.ravel()], lengths.ravel()), lengths.sum(axis=1)

    def _cores(self, words: pa.Array, lead: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words; those after a space are held for the next blocks."""
        if lead != self.lead:
            return joined(self.encode([lead + w for w in words.to_pylist()]))
        at = pc.index_in(words, self.held)
        fresh = words.filter(pc.is_null(at))
        flat, sizes = self._fresh(fresh)
        at = pc.fill_null(at, -1).to_numpy().astype(np.int64)
        at[at < 0] = len(self.held) + np.arange(len(fresh))
        self.held = pa.concat_arrays([self.held, fresh])
        self.flat, self.sizes = np.concatenate([self.flat, flat]), np.concatenate([self.sizes, sizes])
        sizes = self.sizes[at]
        flat = take_ranges(self.flat, (np.cumsum(self.sizes) - self.sizes)[at], sizes)
        if len(self.held) > HELD_WORDS:  # only what was just asked for stays
            self.held, self.flat, self.sizes = words, flat, sizes
        return flat, sizes

    def _fresh(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        plain = pc.match_substring_regex(words, f"^{LATIN}+$")
        letters, others = words.filter(plain).to_pylist(), words.filter(pc.invert(plain)).to_pylist()
        texts = [self.lead + self.lead.join(letters[a : a + TOGETHER]) for a in range(0, len(letters), TOGETHER)]
        ids, _ = joined(self.encode(texts))
        begins = np.flatnonzero(self.opens[ids])
        if len(begins) != len(letters):
            raise ValueError("the vocabulary does not begin each word of letters with one space")
        flat, sizes = joined(self.encode([self.lead + w for w in others]))
        flat, sizes = np.concatenate([ids, flat]), np.concatenate([np.diff(begins, append=len(ids)), sizes])
        plain = plain.to_numpy(zero_copy_only=False)
        order = np.empty(len(words), np.int64)
        order[plain], order[~plain] = np.arange(len(letters)), len(letters) + np.arange(len(others))
        return take_ranges(flat, (np.cumsum(sizes) - sizes)[order], sizes[order]), sizes[order]


MARK = "▁"  # the vocabulary's sign for a space
UNKNOWN_PENALTY = 10.0  # fixed value: an uncovered character scores so much below the worst piece


class Pieces:
    """Pieces and scores of a SentencePiece model file, read by its library."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = lib.get_piece_size()
        names = [lib.id_to_piece(i) for i in range(size)]
        self.byte_ids = {int(names[i][3:5], 16): i for i in range(size) if lib.is_byte(i)}
        self.unknown = lib.unk_id()
        silent = [lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) for i in range(size)]
        self.normal = {names[i]: (i, lib.get_score(i)) for i in range(size) if not silent[i]}
        self.floor = min(s for _, s in self.normal.values()) - UNKNOWN_PENALTY
        self.apart = not any(MARK in n.lstrip(MARK) for n in self.normal)  # no piece goes over a word's start
        raw = [n.encode() for n in names]
        for b, i in self.byte_ids.items():
            raw[i] = bytes([b])
        for i in range(size):
            if lib.is_control(i):
                raw[i] = b""
            elif lib.is_unknown(i):
                raw[i] = " ⁇ ".encode()
        self.bytes_of = pa.array(raw, pa.binary())

    def spelt(self, char: str) -> list[int]:
        """Ids for a character that no piece covers."""
        return [self.byte_ids[b] for b in char.encode()] if self.byte_ids else [self.unknown]


class UnigramCodec(WordCodec):
    """Best segmentation under the pieces' scores.

    One pass of an Aho-Corasick automaton over the text meets, at each position, all pieces that end there (its
    output links, longest first); each relaxes the best score of its end.  Of equal scores the longest last piece
    wins.  A character that is no piece itself costs ``Pieces.floor`` and is spelt in bytes.
    """

    lead = first = MARK

    def __init__(self, model: bytes) -> None:
        super().__init__()
        import ahocorasick

        self.pieces = Pieces(model)
        self.automaton = ahocorasick.Automaton()
        for name, (number, score) in self.pieces.normal.items():
            self.automaton.add_word(name, (len(name), number, score))
        self.automaton.make_automaton()

    def odd(self, words: pa.Array) -> pa.Array:
        return pc.or_(pc.equal(words, ""), pc.match_substring(words, MARK))

    def encode(self, keys: list[str]) -> list[bytes]:
        return [self._viterbi(k) for k in keys]

    def _viterbi(self, text: str) -> bytes:
        if text == MARK:  # the text was empty
            return b""
        text = text.replace(" ", MARK)
        n, single, floor = len(text), self.pieces.normal, self.pieces.floor
        low = float("-inf")
        best, back = [low] * (n + 1), [None] * (n + 1)
        best[0], at = 0.0, 0  # ends up to ``at`` are settled
        for end, (length, number, score) in self.automaton.iter(text):
            end += 1
            while at < end - 1:  # ends that no piece reaches
                at += 1
                if text[at - 1] not in single and best[at - 1] + floor > best[at]:
                    best[at], back[at] = best[at - 1] + floor, (1, -1)
            total = best[end - length] + score
            if total > best[end]:
                best[end], back[end] = total, (length, number)
            if length == 1:
                at = max(at, end)
        while at < n:
            at += 1
            if text[at - 1] not in single and best[at - 1] + floor > best[at]:
                best[at], back[at] = best[at - 1] + floor, (1, -1)
        ids, end = [], n
        while end:
            length, number = back[end]
            ids += [number] if number >= 0 else self.pieces.spelt(text[end - 1])[::-1]
            end -= length
        ids.reverse()
        return array("I", ids).tobytes()


_MADE: dict = {}


def shared(kind: type, source: str | bytes):
    """The worker's codec for a model file; tasks that follow use it again."""
    key = (kind, hash(source))
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = kind(source)
    return _MADE[key]


def model_bytes(path: str, limit: int = 64 << 20) -> bytes:
    """A vocabulary file read on the driver; it is sent to all executors, so its size is checked."""
    with open(path, "rb") as f:
        data = f.read(limit + 1)
    if len(data) > limit:
        raise ValueError(f"{path} has more than {limit} bytes")
    return data
