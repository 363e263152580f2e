"""Quality rules: a decision list learned by sequential covering, applied as a Spark conditional expression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.blocks import fresh_name, narrow
from paperloom.llm.labelled import fold, training_labels
from paperloom.llm.stats import COUNTS, ratios, with_document_stats
from paperloom.sources.sinks import materialise

BINS = 32
MAX_RULES = 12
MAX_CONDITIONS = 4
LEAST_PRECISION = 0.95
LEAST_COVER = 5
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
PRUNE_FOLD = 4


@dataclass(frozen=True)
class Condition:
    measure: str
    at_least: bool
    threshold: float

    def column(self, named: dict[str, Column]) -> Column:
        value = named[self.measure]
        return value >= self.threshold if self.at_least else value < self.threshold

    def __str__(self) -> str:
        return f"{self.measure} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    """Rejects a document for which all conditions hold."""

    conditions: tuple[Condition, ...]

    def column(self, named: dict[str, Column]) -> Column:
        out = self.conditions[0].column(named)
        for c in self.conditions[1:]:
            out = out & c.column(named)
        return out

    def __str__(self) -> str:
        return "reject if " + " and ".join(map(str, self.conditions))


def verdict(rules: list[Rule], named: dict[str, Column]) -> Column:
    """Number of the first rule that holds, else null."""
    if not rules:
        return F.lit(None).cast("int")
    out = F.when(rules[0].column(named), F.lit(0))
    for i, rule in enumerate(rules[1:], 1):
        out = out.when(rule.column(named), F.lit(i))
    return out


class _Table:
    """Labelled rows with one bin number per measure; answers counts per bin by one aggregation each."""

    def __init__(self, rows: DataFrame, names: list[str]) -> None:
        self.names = names
        cuts = rows.agg(
            *(F.percentile_approx(n, [i / BINS for i in range(1, BINS)], 10_000).alias(n) for n in names)
        ).first()
        self.cuts = {n: sorted(set(cuts[n] or [])) for n in names}
        bins = F.array(*(self._bin(n) for n in names))
        self.rows = materialise(rows.select(bins.alias("bins"), "label", "prune"))

    def _bin(self, name: str) -> Column:
        """Number of cuts at or below the value."""
        if not self.cuts[name]:
            return F.lit(0)
        value = F.col(name)
        return F.size(F.filter(F.array(*(F.lit(float(c)) for c in self.cuts[name])), lambda c: c <= value))

    def holds(self, bounds: dict[str, tuple[int, int]]) -> Column:
        out = F.lit(True)
        for name, (low, high) in bounds.items():
            value = F.col("bins")[self.names.index(name)]
            out = out & (value >= low) & (value < high)
        return out

    def counts(self, left: Column, pruning: bool) -> np.ndarray:
        """measure x bin x class (kept, rejected) over the rows where ``left`` holds."""
        table = np.zeros((len(self.names), BINS + 1, 2))
        seen = self.rows.where((F.col("prune") == pruning) & left).select("label", F.posexplode("bins").alias("m", "bin"))
        found = seen.groupBy("m", "bin").agg(F.sum(1 - F.col("label")).alias("bad"), F.sum("label").alias("good"))
        for r in found.collect():
            table[r["m"], r["bin"]] = r["good"], r["bad"]
        return table

    def condition(self, name: str, low: int, high: int) -> list[Condition]:
        cuts = self.cuts[name]
        out = [Condition(name, True, cuts[low - 1])] if low > 0 else []
        return out + ([Condition(name, False, cuts[high - 1])] if high <= len(cuts) else [])


def _gain(good: np.ndarray, bad: np.ndarray, good0: float, bad0: float) -> np.ndarray:
    """FOIL's gain of narrowing from (good0, bad0) to each (good, bad)."""
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = bad * (np.log2((bad + 1) / (good + bad + 2)) - np.log2((bad0 + 1) / (good0 + bad0 + 2)))
    return np.where(bad > 0, gain, -np.inf)


def learn_rules(
    measured: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    max_rules: int = MAX_RULES,
    least_precision: float = LEAST_PRECISION,
) -> list[Rule]:
    """Ordered rejection rules from ``id`` and measure columns and 0/1 labels.

    Sequential covering: grow a conjunction of thresholds by the gain on the growing folds, drop its last conditions
    while that does not lower (bad - good) / (bad + good) on the pruning fold, keep the rule if it still covers
    enough and is precise enough on each of both, remove what it covers, go on.  Every step is one aggregation over all
    labelled rows into measures x bins counts.  Held-out rows (fold 0) are never read.  Without labelled bad rows
    there are no rules.
    """
    names = [c for c in measured.columns if c != "id"]
    rows = measured.join(training_labels(labels, label_col), "id")
    table = _Table(rows.withColumn("prune", fold("id") == PRUNE_FOLD), names)
    rules: list[Rule] = []
    left = F.lit(True)
    while len(rules) < max_rules:
        bounds: dict[str, tuple[int, int]] = {}
        order: list[tuple[str, int, int]] = []
        for _ in range(MAX_CONDITIONS):
            seen = table.counts(left & table.holds(bounds), False)
            good0, bad0 = seen[0].sum(axis=0)
            if bad0 < LEAST_COVER or not good0:
                break
            above = seen[:, ::-1].cumsum(axis=1)[:, ::-1]  # rows in bin b or above
            below = seen.cumsum(axis=1) - seen
            gains = np.stack([_gain(above[..., 0], above[..., 1], good0, bad0), _gain(below[..., 0], below[..., 1], good0, bad0)])
            gains[:, :, 0] = -np.inf
            side, m, b = np.unravel_index(np.argmax(gains), gains.shape)
            if gains[side, m, b] <= 0:
                break
            name = names[m]
            low, high = bounds.get(name, (0, BINS + 1))
            low, high = (max(low, int(b)), high) if side == 0 else (low, min(high, int(b)))
            bounds[name] = (low, high)
            order.append((name, low, high))
        best: tuple[float, int] | None = None
        for k in range(len(order), 0, -1):
            held = {name: (low, high) for name, low, high in order[:k]}
            pruned = table.counts(left & table.holds(held), True)[0].sum(axis=0)
            grown = table.counts(left & table.holds(held), False)[0].sum(axis=0)
            sides = [(bad, good + bad) for good, bad in (pruned, grown)]
            if pruned[1] + grown[1] < LEAST_COVER or any(n and bad < least_precision * n for bad, n in sides):
                continue
            worth = (pruned[1] - pruned[0]) / max(pruned.sum(), 1.0)
            if best is None or worth >= best[0]:
                best = (worth, k)
        if best is None:
            break
        held = {name: (low, high) for name, low, high in order[: best[1]]}
        rules.append(Rule(tuple(c for n, (low, high) in held.items() for c in table.condition(n, low, high))))
        left = left & ~table.holds(held)
    return rules


def base_failed(stats: Column) -> Column:
    """Fewer than 20 words, or more than 30 of 100 words in repeated windows."""
    words, repeated = stats.getField("n_words"), stats.getField("n_repeat_words")
    return (words < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * words)


def measure_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, stats`` of every whole text, stored once for learning and judging."""
    rows = narrow(docs, id=id_col, text=text_col)
    return materialise(with_document_stats(rows, "text", "stats").select("id", "stats"))


def rules_from(measured: DataFrame, labels: DataFrame) -> list[Rule]:
    """Rules from the rows that the base does not reject anyway."""
    stats = F.col("stats")
    rest = measured.where(~base_failed(stats))
    return learn_rules(rest.select("id", *(c.alias(n) for n, c in ratios(stats).items())), labels)


def kept(stats: Column, rules: list[Rule]) -> Column:
    return ~base_failed(stats) & verdict(rules, ratios(stats)).isNull()


def judge_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, the base counts, ``base_failed``, ``kept`` and ``rule``, the number of the first rule that
    rejects it.

    A null text counts as no words and fails the base; repeated rows are judged alike; rows without an id are
    judged and never learned from; an empty table gives no rows; labels without a document are not used.
    """
    measured = measure_rows(docs, id_col, text_col)
    rules = rules_from(measured, labels)
    stats = F.col("stats")
    return measured.select(
        F.col("id").alias(id_col),
        *(stats.getField(c).alias(c) for c in COUNTS[:5]),
        base_failed(stats).alias("base_failed"),
        kept(stats, rules).alias("kept"),
        F.when(~base_failed(stats), verdict(rules, ratios(stats))).cast("int").alias("rule"),
    )


def keep_passing(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that pass, with all their columns; judged in the pass that filters, so no join is needed."""
    rules = rules_from(measure_rows(docs, id_col, text_col), labels)
    stats = fresh_name(docs, "_stats")
    rows = with_document_stats(docs, text_col, stats)
    return rows.where(kept(F.col(stats), rules)).select(*(F.col(f"`{c}`") for c in docs.columns))
