"""SentencePiece encoding, decoding and token counts under a vocabulary's unigram scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm.blocks import fresh_name, map_batches, narrow, sum_rows, text_blocks, widened
from paperloom.llm.codecs import MARK, Pieces, Recent, UnigramCodec, model_bytes, shared

DECODED = 200_000


def _broadcast_model(df: DataFrame, model: str):
    return df.sparkSession.sparkContext.broadcast(model_bytes(model))


def encode_pieces(
    docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", with_crc: bool = False
) -> DataFrame:
    """Piece ids of every whole text: ``id_col``, ``ids`` (array of int) and ``n_tokens``; ``with_crc`` adds the
    crc32 of the text that decoding should give (U+2581 as a space).

    Map-only.  Each distinct word (a space with what follows) is segmented once per block by a single-pass Viterbi
    search on an Aho-Corasick automaton of the pieces (`codecs.UnigramCodec`).  Null and empty texts give an empty
    array; repeated rows and rows without an id are encoded like any other; an empty table gives no rows.
    """
    held = _broadcast_model(docs, model)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared(UnigramCodec, held.value)
        for batch, text in text_blocks(batches, "text"):
            ids, ends = codec.rows(text)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.view(np.int32)))
            columns = {"id": batch.column(0), "ids": lists, "n_tokens": pa.array(np.diff(ends))}
            yield pa.record_batch(columns | ({"crc32": batch.column(2)} if with_crc else {}))

    rows = narrow(docs, id=id_col, text=text_col)
    if with_crc:
        rows = rows.withColumn("crc", F.crc32(F.replace(F.coalesce("text", F.lit("")), F.lit(MARK), F.lit(" ")).cast("binary")))
    kind = rows.schema["id"].dataType.simpleString()
    more = ", crc32 bigint" if with_crc else ""
    coded = map_batches(rows, encode, f"id {kind}, ids array<int>, n_tokens bigint{more}")
    return coded.withColumnRenamed("id", id_col)


def decode_pieces(coded: DataFrame, model: str, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """Texts of arrays of piece ids, added as column ``out``.

    Pieces are joined, byte pieces as their bytes, signs for a space become spaces and the first of them, put
    there by the encoder, goes.  Bytes that are no UTF-8 become U+FFFD, ids outside the vocabulary or null are
    skipped, a null array gives a null text.
    """
    held = _broadcast_model(coded, model)
    schema = widened(coded.drop(out), out, T.StringType())
    columns = coded.drop(out).columns

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared(Pieces, held.value).bytes_of
        for whole in batches:
            sizes = pc.fill_null(pc.list_value_length(whole.column(whole.schema.get_field_index(ids_col))), 0).to_numpy()
            bounds, a = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), 0
            while a < whole.num_rows:  # rows of at most `DECODED` pieces at a time, unless one row has more
                b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + DECODED, "right")) - 1)
                batch, a = whole.slice(a, b - a), b
                lists = batch.column(batch.schema.get_field_index(ids_col))
                ids = pc.fill_null(lists.flatten(), -1).to_numpy()
                ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())])
                known = (ids >= 0) & (ids < len(pieces))
                kept = np.concatenate([[0], np.cumsum(known)])[ends]
                rows = pa.ListArray.from_arrays(pa.array(kept, pa.int32()), pieces.take(pa.array(ids[known])))
                texts = [v.decode("utf-8", "replace") for v in pc.binary_join(rows, b"").to_pylist()]
                texts = [t.replace(MARK, " ")[t[:1] in (MARK, " ") :] for t in texts]
                column = pc.if_else(lists.is_valid(), pa.array(texts, pa.string()), None)
                yield pa.record_batch([*(batch.column(c) for c in columns), column], [*columns, out])

    return map_batches(coded.select(*columns), decode, schema)


class PrefixCounter:
    """Token counts of distinct words by dynamic programming on the trie of the words.

    The sorted words are the trie in depth-first order; a node holds the best score and token count of its
    prefix and is computed once for all words below it, from the pieces that end there (a trie of reversed pieces).
    The counts at the words' ends are kept.
    """

    def __init__(self, model: bytes) -> None:
        self.pieces = Pieces(model)
        self.seen = Recent(200_000)
        self.reversed: dict = {}
        for name, (_, score) in self.pieces.normal.items():
            node = self.reversed
            for c in reversed(name):
                node = node.setdefault(c, {})
            node[""] = score

    def counts(self, words: list[str]) -> list[int]:
        """Tokens of distinct words, in the order given."""
        return self.seen.lookup(words, self._walk)

    def _walk(self, words: list[str]) -> list[int]:
        out, path, last = {}, [(0.0, 0)], ""
        for word in sorted(words):
            if word == MARK:
                out[word] = 0
                continue
            shared_to = 0
            for a, b in zip(last, word):  # noqa: B905
                if a != b:
                    break
                shared_to += 1
            del path[shared_to + 1 :]
            for end in range(shared_to, len(word)):
                path.append(self._node(word, end, path))
            out[word], last = path[-1][1], word
        return [out[w] for w in words]

    def _node(self, word: str, end: int, path: list[tuple[float, int]]) -> tuple[float, int]:
        char, node, at, single = word[end], self.reversed, end, False
        best, count = float("-inf"), 0
        while at >= 0 and (node := node.get(word[at])):
            if (score := node.get("")) is not None:
                single |= at == end
                total = path[at][0] + score
                if total >= best:  # of equal scores the longer piece
                    best, count = total, path[at][1] + 1
            at -= 1
        if not single and path[end][0] + self.pieces.floor > best:
            spelt = len(char.encode()) if self.pieces.byte_ids else 1
            best, count = path[end][0] + self.pieces.floor, path[end][1] + spelt
        return best, count


def _word_counts(text: pa.Array, counter: PrefixCounter) -> np.ndarray:
    """Tokens of each text: its words' counts, added up."""
    lists = pc.split_pattern(text, " ")
    ends = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    number, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    odd = np.fromiter((not w or MARK in w for w in words), bool, len(words))
    counts = np.zeros(len(words), np.int64)
    plain = np.flatnonzero(~odd)
    counts[plain] = counter.counts([MARK + words[i] for i in plain])
    totals = sum_rows(counts[number], ends - ends[0])
    whole = np.flatnonzero(sum_rows(odd[number], ends - ends[0]))
    if len(whole):  # runs of spaces can be pieces of their own: these texts are one word
        texts = [MARK + t.replace(" ", MARK) for t in text.take(pa.array(whole)).to_pylist()]
        known = dict.fromkeys(texts)
        totals[whole] = [dict(zip(known, counter.counts(list(known)), strict=True))[t] for t in texts]
    return totals


def count_tokens(
    docs: DataFrame, model: str, text_col: str = "text", out: str = "n_tokens"
) -> DataFrame:
    """Add the number of unigram tokens of every whole text, equal to the length of `encode_pieces`' ids.

    Map-only; the distinct words of a block share the dynamic programming of their common prefixes.  A null or
    empty text has 0 tokens; rows and other columns stay as they are; a column named ``out`` is replaced.
    """
    held = _broadcast_model(docs, model)
    kept = docs.drop(out)
    name = fresh_name(docs, "_text")
    schema = widened(kept, out, T.LongType())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = shared(PrefixCounter, held.value)
        for batch, text in text_blocks(batches, name):
            totals = pa.array(_word_counts(text, counter), pa.int64())
            yield pa.record_batch([*batch.columns[1:], totals], [*batch.schema.names[1:], out])

    rows = docs.select(F.col(f"`{text_col}`").alias(name), *(F.col(f"`{c}`") for c in kept.columns))
    return map_batches(rows, count, schema)
