"""Quality rules as a short-circuit cascade.

Every rule is a cheap test on numbers of a text. On a bounded sample each rule's cost and the share that it rejects are
measured, and the rules are ordered by rejections per cost, the order that minimises the expected cost if rules reject
independently. A text leaves the cascade at the first rule that rejects it, so its verdict doesn't depend on the order;
only the time does. The numbers that every row reports are there before the cascade, so a rule's cost is what it adds to them.

Rules of equal rejections per cost go by their cost, then by their place in ``RULES``.

Defined cases: null and empty texts have no words, so they fail the base rule; repeated rows are judged each; further
columns are ignored; texts of any length are judged whole, in memory that grows with that text only.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import sliced, texts, thinned

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Texts, about, on which costs and selectivities are measured. They decide the order of the rules, never a verdict.
SAMPLE_DOCS = 500


class Text:
    """A text with the parts that several rules share; each is made at its first use."""

    def __init__(self, raw: bytes):
        self.raw = raw

    @cached_property
    def text(self) -> str:
        return self.raw.decode(errors="replace")

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def lines(self) -> list[bytes]:
        """Lines with a word."""
        return [y for y in self.raw.split(b"\n") if y.strip(b" \t\n\x0b\x0c\r")]

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, " \t\n\x0b\x0c\r"))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    def numbers(self) -> tuple[int, ...]:
        return len(self.words), self.word_chars, self.n_symbols, self.n_dup_lines, n_repeat_words(self)


def n_repeat_words(x: Text, width: int = WINDOW) -> int:
    """Words covered by windows of ``width`` words that the text holds twice or more."""
    w = x.words
    if len(w) <= width:
        return 0
    windows = list(zip(*(w[i:] for i in range(width)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    first: dict = {}
    hit = bytearray(len(windows))
    for i, key in enumerate(windows):
        j = first.setdefault(key, i)
        if j != i:
            hit[i] = hit[j] = 1
    covered, upto = 0, 0
    i = hit.find(1)
    while i >= 0:
        covered += i + width - max(i, upto)
        upto = i + width
        i = hit.find(1, i + 1)
    return covered


def symbol_heavy(x: Text) -> bool:
    return 10 * x.n_symbols > len(x.words)


def word_length_odd(x: Text) -> bool:
    mean = x.word_chars / max(1, len(x.words))
    return not 2 <= mean <= 25


def shouting(x: Text) -> bool:
    """Most letters that have case are capitals."""
    upper = sum(map(str.isupper, x.text))
    return 2 * upper > x.word_chars


def wordless(x: Text) -> bool:
    """Under 70 % of the words begin with a letter."""
    return 10 * sum(y[:1].isalpha() or y[0] > 127 for y in x.words) < 7 * len(x.words)


def lines_repeat(x: Text) -> bool:
    return len(x.lines) > 3 and 10 * x.n_dup_lines > 3 * len(x.lines)


def one_word_rules(x: Text) -> bool:
    """One word makes up over 30 % of a text of 20 words or more."""
    n = len(x.words)
    if n < 20 or len(set(x.words)) > 0.7 * n + 1:
        return False
    counts: dict = {}
    for y in x.words:
        counts[y] = counts.get(y, 0) + 1
    return max(counts.values()) > 0.3 * n


#: name, and whether the rule rejects a text
RULES: dict[str, Callable[[Text], bool]] = {
    "symbol_heavy": symbol_heavy,
    "word_length_odd": word_length_odd,
    "shouting": shouting,
    "wordless": wordless,
    "lines_repeat": lines_repeat,
    "one_word_rules": one_word_rules,
}


def measure(docs: DataFrame, text: str = "text", sample_docs: int = SAMPLE_DOCS, rules: dict | None = None) -> dict[str, tuple[float, float]]:
    """Cost in seconds and rejected share of each rule, on about ``sample_docs`` texts; only sums come to the driver."""
    rules = rules or RULES

    def timed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: [0.0, 0, 0] for k in rules}
        for batch in sliced(batches):
            items = [Text(x) for x in texts(batch, 0)]
            for x in items:
                x.numbers()
            for k, rule in rules.items():
                t = time.perf_counter()
                sums[k][1] += sum(rule(x) for x in items if x.words)
                sums[k][0] += time.perf_counter() - t
                sums[k][2] += len(items)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), *(pa.array([float(v[i]) for v in sums.values()], pa.float64()) for i in range(3))], ["rule", "cost", "rejected", "n"])

    rows = thinned(docs.select(text), sample_docs).mapInArrow(timed, "rule string, cost double, rejected double, n double").groupBy("rule").agg(F.sum("cost").alias("cost"), F.sum("rejected").alias("rejected"), F.sum("n").alias("n")).collect()
    return {r["rule"]: (r["cost"] / max(1.0, r["n"]), r["rejected"] / max(1.0, r["n"])) for r in rows}


def cascade_order(measured: dict[str, tuple[float, float]], rules: dict | None = None) -> list[str]:
    """By rejections per cost, best first; a rule that wasn't measured comes last."""
    return sorted(rules or RULES, key=lambda k: (-measured[k][1] / max(measured[k][0], 1e-9), measured[k][0]) if k in measured else (1.0, 0.0))


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 20, max_repeat_percent: int = 30, sample_docs: int = SAMPLE_DOCS, order: list[str] | None = None) -> DataFrame:
    """key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept for each row."""
    order = order or cascade_order(measure(docs, text, sample_docs))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = [RULES[k] for k in order]
        for batch in sliced(batches, 1024):
            rows: list[list[int]] = [[] for _ in names]
            failed, kept = [], []
            for raw in texts(batch, 1):
                x = Text(raw)
                n = x.numbers()
                for column, value in zip(rows, n, strict=True):
                    column.append(value)
                failed.append(n[0] < min_words or 100 * n[4] > max_repeat_percent * n[0])
                kept.append(not failed[-1] and not any(rule(x) for rule in rules))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(r, pa.int64()) for r in rows), pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_())], [key, *names, "base_failed", "kept"])

    shape = docs.select(F.col(key), *(F.lit(0).cast("long").alias(n) for n in names), F.lit(True).alias("base_failed"), F.lit(True).alias("kept"))
    return docs.select(key, text).mapInArrow(judged, shape.schema)
