"""Token files, pieces and counts against the libraries and plain searches."""

import zlib

import numpy as np
import public_tokenizers as tokenizers_files
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.llm.codecs import BytePairCodec, Pieces, UnigramCodec, model_bytes
from paperloom.llm.storage import create, open_read
from paperloom.llm.token_files import SequenceFile, SequenceWriter, read_token_index, write_token_files
from paperloom.llm.unigram import PrefixCounter, _word_counts, count_tokens, decode_pieces, encode_pieces

BPE, PIECES = tokenizers_files.path("byte_bpe_50k.json"), tokenizers_files.path("piece_bpe_32k.model")
ODD = [
    "", " ", "a", "  a  b ", "x.\ny", "x. \ny!!", "don't", " a b", "日本 語語😀 ▁x", "a" * 3000, "ab,cd ef,", " .",
    "Hello\n", "<|endoftext|> a", "hi <|endoftext|> there", "<|endoftext|><|endoftext|>", "x<|endoftext|.", "x !! y", "tab\t a", "é.", "ﬁn ²³", "á. b", "A.B.C. d..",
]
ALPHABET = st.text(alphabet="ab é.\n\t,!1日😀▁ '", max_size=60)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)  # as it is: its added token is found in texts


@pytest.fixture(scope="module")
def bpe():
    return BytePairCodec(model_bytes(BPE).decode())


@pytest.fixture(scope="module")
def unigram():
    return UnigramCodec(model_bytes(PIECES))


def rows_of(codec, texts):
    ids, ends = codec.rows(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]  # noqa: B905


def test_byte_pairs_equal_the_library(bpe, library):
    assert rows_of(bpe, ODD) == [library.encode(t, add_special_tokens=False).ids for t in ODD]


@settings(max_examples=60, deadline=None)
@given(st.lists(ALPHABET, max_size=5))
def test_byte_pairs_equal_the_library_on_any_text(bpe, library, texts):
    assert rows_of(bpe, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def best_split(pieces, text):
    """Scores of all splits by a plain quadratic search over the whole text; the longer last piece wins ties."""
    if not text:
        return []
    text = "▁" + text.replace(" ", "▁")
    best, back = [0.0] + [float("-inf")] * len(text), [None] * (len(text) + 1)
    for end in range(1, len(text) + 1):
        for start in range(end):
            known = pieces.normal.get(text[start:end])
            if known and best[start] + known[1] > best[end]:
                best[end], back[end] = best[start] + known[1], (start, [known[0]])
        if text[end - 1] not in pieces.normal and best[end - 1] + pieces.floor > best[end]:
            best[end], back[end] = best[end - 1] + pieces.floor, (end - 1, pieces.spelt(text[end - 1]))
    out, end = [], len(text)
    while end:
        end, ids = back[end]
        out = ids + out
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(ALPHABET, max_size=5))
def test_pieces_equal_a_plain_search(unigram, texts):
    want = [best_split(unigram.pieces, t) for t in texts]
    assert rows_of(unigram, texts) == want
    assert _word_counts(pa.array(texts, pa.string()), counter()).tolist() == [len(w) for w in want]


def counter(made=[]):  # noqa: B006
    if not made:
        made.append(PrefixCounter(model_bytes(PIECES)))
    return made[0]


def test_sequences_are_views_of_the_file(tmp_path):
    ids = np.arange(1000, dtype=np.uint32) * 7 % 60000
    with create(str(tmp_path), "x.arrow") as sink:
        writer = SequenceWriter(sink, 16, 4, wide=False)
        for part in np.array_split(ids, 7):
            writer.add(part)
        writer.close()
    source = open_read(str(tmp_path), "x.arrow")
    before = pa.total_allocated_bytes()
    held = SequenceFile(source)
    values, mask = held.sequence(3)
    assert values.tolist() == ids[48:64].tolist() and values.base is not None
    assert pa.total_allocated_bytes() - before < 4096
    assert mask.to_pylist() == [True] * 16
    assert held.sequence(62)[1].to_pylist() == [True] * 8 + [False] * 8
    assert held.tokens(55, 300).tolist() == ids[55:355].tolist()


def test_token_files(spark, library):
    rows = [(5, "b c"), (2, None), (2, ""), (None, "x"), (9, "Hello there. " * 5000), (9, "again"), (7, "!")]
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id bigint, text string, start int, part string")
    folder, manifest = write_token_files(docs, BPE, length=64, rows=8)
    got = sorted((r.start, r.id, r.n_tokens, r.ids_crc32) for r in read_token_index(folder, manifest).collect())
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1])):
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((start, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    folder, manifest = write_token_files(docs.limit(0), BPE)
    assert read_token_index(folder, manifest).count() == 0


def test_round_trip(spark):
    texts = [*ODD, None, "a  b\x00c"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string")
    coded = encode_pieces(docs, PIECES)
    got = {r.doc_id: (r.n_tokens, len(r.ids), r.text) for r in decode_pieces(coded, PIECES).collect()}
    counts = {r.doc_id: r.n_tokens for r in count_tokens(docs, PIECES).collect()}
    for i, t in enumerate(texts):
        assert got[i][2] == (t or "").replace("▁", " ")
        assert got[i][0] == got[i][1] == counts[i]
    odd = spark.createDataFrame([(1, [40000, -3, 500, None]), (2, None), (3, [])], "doc_id bigint, ids array<int>")
    piece = Pieces(model_bytes(PIECES)).bytes_of[500].as_py().decode().replace("▁", " ")
    got = {r.doc_id: r.text for r in decode_pieces(odd, PIECES).collect()}
    assert got == {1: piece.removeprefix(" "), 2: None, 3: ""}
    assert encode_pieces(docs.limit(0), PIECES).count() == count_tokens(docs.limit(0), PIECES).count() == 0
