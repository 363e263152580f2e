"""Benchmark decontamination: pieces of each test item by the pigeonhole rule, Myers' distance to confirm."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.blocks import map_batches, narrow, text_blocks
from paperloom.sources.sinks import materialise

ERRORS_PERCENT = 10
BLOCK_CHARS = 4 << 20
LEAST_CHARS = 1


def normal(text: str) -> str:
    """Lower case, with each run of white space as one space."""
    return " ".join(text.lower().split())


def budget(length: int, percent: int = ERRORS_PERCENT) -> int:
    return length * percent // 100


def cuts(length: int, errors: int) -> list[int]:
    """Bounds of ``errors + 1`` pieces of nearly equal length: any text within ``errors`` edits holds one of them."""
    return [length * i // (errors + 1) for i in range(errors + 2)]


def enclosing(piece: int, count: int) -> list[tuple[int, int]]:
    """Ranges of pieces around ``piece``, from small to large, without the whole.

    A range of n pieces is halved again and again.  If the whole has fewer errors than pieces, so has one of its
    halves, and so on down to a piece without errors; an exact piece can thus be confirmed from the inside out, with
    fewer errors than pieces on every level.
    """
    out, low, high = [], 0, count
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if piece < middle else (middle, high)
        out.append((low, high))
    return out[:-1][::-1]


class Myers:
    """Bit-parallel edit distance of one pattern; a bit per pattern character in one integer."""

    def __init__(self, pattern: str) -> None:
        self.size = len(pattern)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(pattern):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def best(self, text: str, anchored: bool = False) -> tuple[int, int]:
        """Least distance to a part of ``text`` that starts anywhere (at 0 if ``anchored``), and the end of the
        first such part."""
        full, high, masks = (1 << self.size) - 1, 1 << self.size - 1, self.masks
        plus, minus, score = full, 0, self.size
        least, end, carry = score, 0, int(anchored)
        for at, c in enumerate(text, 1):
            equal = masks.get(c, 0)
            vertical = equal | minus
            across = (((equal & plus) + plus) ^ plus) | equal
            up = minus | (full & ~(across | plus))
            down = plus & across
            if up & high:
                score += 1
            elif down & high:
                score -= 1
            up = (up << 1 | carry) & full
            down = down << 1 & full
            plus = down | (full & ~(vertical | up))
            minus = up & vertical
            if score < least:
                least, end = score, at
        return least, end


class Finder:
    """All items of one block, searched for at once."""

    def __init__(self, items: list[tuple[int, str]], percent: int) -> None:
        import ahocorasick

        self.percent = percent
        self.texts = [t for _, t in items]
        self.ids = [i for i, _ in items]
        self.myers: dict[int, tuple[Myers, Myers]] = {}
        self.parts: dict[tuple[int, int, int], Myers] = {}
        self.beside: dict[tuple[int, int], tuple[int, int, list[str]]] = {}
        self.cuts = [cuts(len(t), budget(len(t), percent)) for t in self.texts]
        places: dict[str, list[tuple[int, int]]] = {}
        for k, text in enumerate(self.texts):
            for i, (a, b) in enumerate(zip(self.cuts[k], self.cuts[k][1:])):  # noqa: B905
                places.setdefault(text[a:b], []).append((k, i))
        self.automaton = ahocorasick.Automaton()
        for piece, found in places.items():
            self.automaton.add_word(piece, (len(piece), found))
        self.automaton.make_automaton()

    def _confirm(self, k: int, window: str) -> tuple[int, int, int] | None:
        if k not in self.myers:
            self.myers[k] = Myers(self.texts[k]), Myers(self.texts[k][::-1])
        distance, end = self.myers[k][0].best(window)
        if distance > budget(len(self.texts[k]), self.percent):
            return None
        _, back = self.myers[k][1].best(window[:end][::-1], anchored=True)
        return distance, end - back, end

    def _beside(self, k: int, piece: int) -> tuple[int, int, list[str]]:
        """For the smallest range around a piece: where its text lies at most, and the halves of its other pieces,
        of which one at least must be there unchanged."""
        if (k, piece) not in self.beside:
            at, text = self.cuts[k], self.texts[k]
            low, high = next(iter(enclosing(piece, len(at) - 1)), (piece, piece + 1))
            halves = []
            for a, b in ((at[i], at[i + 1]) for i in range(low, high) if i != piece):
                halves += [text[a : (a + b) // 2], text[(a + b) // 2 : b]]
            self.beside[k, piece] = (at[low] - (high - low), at[high] + (high - low), halves)
        return self.beside[k, piece]

    def _plausible(self, k: int, piece: int, start: int, text: str) -> bool:
        """Whether every larger range of pieces around an exact one has fewer errors than pieces; ``start`` is where
        the item would begin."""
        first, last, halves = self._beside(k, piece)
        near = text[max(0, start + first) : max(0, start + last)]
        if halves and not any(h in near for h in halves):
            return False
        at = self.cuts[k]
        for low, high in enclosing(piece, len(at) - 1):
            key = (k, low, high)
            if key not in self.parts:
                self.parts[key] = Myers(self.texts[k][at[low] : at[high]])
            errors = high - low - 1
            window = text[max(0, start + at[low] - errors) : max(0, start + at[high] + errors)]
            if self.parts[key].best(window)[0] > errors:
                return False
        return True

    def search(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, distance, start, end) of the best place of each item in a normalised text."""
        starts: dict[int, list[int]] = {}
        for end, (length, found) in self.automaton.iter(text):
            for k, i in found:
                start = end + 1 - length - self.cuts[k][i]
                known = starts.get(k)
                if known and abs(known[-1] - start) <= 1 or self._plausible(k, i, start, text):
                    starts.setdefault(k, []).append(start)
        out = []
        for k, at in starts.items():
            errors, size = budget(len(self.texts[k]), self.percent), len(self.texts[k])
            best, at = None, sorted(set(at))
            low = high = at[0]
            for s in [*at[1:], None]:
                if s is not None and s - high <= errors:
                    high = s
                    continue
                origin = max(0, low - errors)
                hit = self._confirm(k, text[origin : high + size + errors])
                if hit and (best is None or hit[0] < best[1]):
                    best = (self.ids[k], hit[0], origin + hit[1], origin + hit[2])
                low = high = s if s is not None else 0
            if best:
                out.append(best)
        return out


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    errors_percent: int = ERRORS_PERCENT,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_chars: int = BLOCK_CHARS,
    least_chars: int = LEAST_CHARS,
) -> DataFrame:
    """``id_col, item_id, distance, start, end``: items found in a document within ``errors_percent`` edits per 100
    characters, the best place of each item, in positions of the normalised text.

    Items are read in blocks (`item_blocks`), each sent to all tasks for one map-only pass over the documents; a
    benchmark of many blocks costs as many passes.  Null and blank texts hold nothing; null and blank items and items of
    fewer than ``least_chars`` normalised characters are never found; the error budget of an item under 10 characters
    is 0 at 10 percent, so it must occur unchanged.  Items of equal text are each found; repeated rows each give their
    rows; of equal distances the first place counts; empty tables give no rows.
    """
    rows = narrow(docs, id=id_col, text=text_col).select(F.col("id").cast("bigint").alias("id"), "text")
    schema = "id bigint, item_id bigint, distance int, start bigint, end bigint"
    found = docs.sparkSession.createDataFrame([], schema)
    for held in item_blocks(benchmark, item_col, item_text_col, block_chars, least_chars):

        def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            finder = Finder(held.value, errors_percent)
            for batch, text in text_blocks(batches, "text"):
                hits = []
                for i, t in zip(batch.column(0).to_pylist(), text.to_pylist(), strict=True):
                    hits += [(i, *hit) for hit in finder.search(normal(t))]
                if hits:
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                    yield pa.record_batch(
                        [pa.array(c, k) for c, k in zip(zip(*hits, strict=True), kinds, strict=True)],
                        ["id", "item_id", "distance", "start", "end"],
                    )

        found = found.unionByName(map_batches(rows, search, schema))
    return found.withColumnRenamed("id", id_col)


def item_blocks(
    benchmark: DataFrame, item_col: str, item_text_col: str, block_chars: int, least_chars: int
) -> list[Broadcast]:
    """Distinct (item id, normalised text) in blocks of about ``block_chars`` characters at most, counted before any is
    collected, each as a broadcast value."""
    spark = benchmark.sparkSession
    items = materialise(
        narrow(benchmark, item=item_col, text=item_text_col)
        .dropna()
        .select(F.col("item").cast("bigint").alias("item"), "text")
        .distinct()
    )
    blocks = -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars)
    out = []
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).orderBy("item", "text").collect()
        texts = [(r["item"], normal(r["text"])) for r in own]
        texts = [t for t in texts if len(t[1]) >= max(1, least_chars)]
        if texts:
            out.append(spark.sparkContext.broadcast(texts))
    return out


def drop_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    errors_percent: int = ERRORS_PERCENT,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_chars: int = BLOCK_CHARS,
    least_chars: int = LEAST_CHARS,
) -> DataFrame:
    """The documents without any item, with all their columns.

    Every row is judged by its own text in the pass that filters, so a row without an id goes if it holds an item, and
    of two rows of one id only the one that does.  Rows with a null or empty text stay.
    """
    for held in item_blocks(benchmark, item_col, item_text_col, block_chars, least_chars):

        def clean(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            finder = Finder(held.value, errors_percent)
            for batch, text in text_blocks(batches, text_col):
                keep = pa.array([not finder.search(normal(t)) for t in text.to_pylist()], pa.bool_())
                yield batch.filter(keep)

        docs = map_batches(docs, clean, docs.schema)
    return docs
