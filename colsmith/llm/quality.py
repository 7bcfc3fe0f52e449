"""Quality rules as a short-circuit cascade.

Each rule looks at a stretch of texts and says which to reject. A sample tells what a rule costs
per text and what it rejects; rules then run in the order of rejections per cost, each on the texts
that earlier rules let pass. The order changes the cost and never what is kept.

Null and empty texts have no words: all counts are 0 and the rule on short texts rejects them.
Repeated rows are judged one by one. Only the text column is read; other columns pass through.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsmith.llm import words as W

WINDOW = 8  # words in a window that counts as repeated
SAMPLE_ROWS = 2000  # texts on which costs and rejections are measured

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_STARTS = np.ones(256, bool)  # bytes that begin a code point
_STARTS[0x80:0xC0] = False
_UPPER, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = _LETTER[65:91] = _LETTER[97:123] = True


class Texts:
    """Measures of a stretch of texts, computed when a rule first asks for them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def only(self, keep: np.ndarray) -> Texts:
        """The same measures for a subset of the texts, computed anew when asked for."""
        lengths = np.diff(self.offsets)
        return Texts(self.data[np.repeat(keep, lengths)], np.append(0, np.cumsum(lengths[keep])))

    @cached_property
    def _words(self):
        return W.words(self.data, self.offsets)

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.bincount(self._words[3], minlength=len(self.offsets) - 1)

    @cached_property
    def word_chars(self) -> np.ndarray:
        return W.per_row(W._IN_WORD[self.data] & _STARTS[self.data], self.offsets)

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return W.per_row(_SYMBOL[self.data], self.offsets)

    @cached_property
    def capitals(self) -> np.ndarray:
        return W.per_row(_UPPER[self.data], self.offsets)

    @cached_property
    def letters(self) -> np.ndarray:
        return W.per_row(_LETTER[self.data], self.offsets)

    @cached_property
    def _lines(self) -> tuple[np.ndarray, np.ndarray]:
        text, found = self.data.tobytes(), np.zeros((len(self.offsets) - 1, 2), np.int64)
        for i, (a, b) in enumerate(zip(self.offsets, self.offsets[1:])):
            lines = [x for x in text[a:b].split(b"\n") if x.strip()]
            found[i] = len(lines), len(lines) - len(set(lines))
        return found[:, 0], found[:, 1]

    @property
    def n_lines(self) -> np.ndarray:
        return self._lines[0]

    @property
    def n_dup_lines(self) -> np.ndarray:
        return self._lines[1]

    @cached_property
    def n_stutters(self) -> np.ndarray:
        """Words equal to the one before."""
        hashes, _, _, rows = self._words
        same = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
        return np.bincount(rows[1:][same], minlength=len(self.offsets) - 1)

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        hashes, _, _, rows = self._words
        values, index = W.shingles(hashes, rows, WINDOW)
        whole = index + WINDOW <= len(rows)
        values, index = values[whole], index[whole]
        whole = rows[index + WINDOW - 1] == rows[index]
        values, index = values[whole], index[whole]
        order = W.row_order(values, rows[index])
        values, index = values[order], index[order]
        equal = (values[1:] == values[:-1]) & (rows[index[1:]] == rows[index[:-1]])
        twice = np.append(False, equal) | np.append(equal, False) if len(values) else np.zeros(0, bool)
        change = np.zeros(len(rows) + 1, np.int64)
        np.add.at(change, index[twice], 1)
        np.add.at(change, index[twice] + WINDOW, -1)
        return np.bincount(rows[np.cumsum(change)[:-1] > 0], minlength=len(self.offsets) - 1)


Rule = Callable[[Texts], np.ndarray]
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RULES: dict[str, Rule] = {
    "few_words": lambda t: t.n_words < 20,
    "repeated_windows": lambda t: 100 * t.n_repeat_words > 30 * t.n_words,
    "symbols": lambda t: 10 * t.n_symbols > t.n_words,
    "stutters": lambda t: 10 * t.n_stutters > 3 * t.n_words,
    "repeated_lines": lambda t: 2 * t.n_dup_lines > t.n_lines,
    "word_length": lambda t: (t.word_chars < 2 * t.n_words) | (t.word_chars > 15 * t.n_words),
    "capitals": lambda t: 10 * t.capitals > 4 * t.letters,
}


def plan(docs: DataFrame, rules: dict[str, Rule] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """The order of the rules: most rejections per second first, each judged on what the ones before let pass.

    About ``sample_rows`` texts, a fixed random share of the rows, are looked at in one task. Without any text the given order stays.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretches = [Texts(d, o) for batch in batches for _, _, d, o in W.chunks(batch.column(0))]
        left, order = dict(rules), []
        while left and stretches and sum(len(t.offsets) - 1 for t in stretches):
            gain, rejected = {}, {}
            for name, rule in left.items():
                started = time.perf_counter()
                rejected[name] = [rule(Texts(t.data, t.offsets)) for t in stretches]
                gain[name] = sum(int(x.sum()) for x in rejected[name]) / (time.perf_counter() - started)
            best = max(gain, key=gain.get)
            order.append(best)
            del left[best]
            stretches = [t.only(~x) for t, x in zip(stretches, rejected[best])]
        yield pa.RecordBatch.from_pydict({"place": pa.array(range(len(order) + len(left)), pa.int32()), "name": pa.array([*order, *left], pa.string())})

    texts = docs.select(F.col(text).cast("string").alias("text"))
    sample = texts.sample(fraction=min(1.0, sample_rows / max(1, docs.count())), seed=7)
    found = sample.repartition(1).mapInArrow(measure, "place int, name string").collect()
    return [r["name"] for r in sorted(found, key=lambda r: r["place"])] or list(rules)


def _cascade(whole: Texts, rules: dict[str, Rule], order: Sequence[str]) -> np.ndarray:
    """The place of the first rule in the order that rejects each text, or -1."""
    verdict = np.full(len(whole.offsets) - 1, -1)
    alive, texts = np.arange(len(verdict)), whole
    for k, name in enumerate(order):
        bad = rules[name](texts)
        verdict[alive[bad]] = k
        if bad.any():
            alive = alive[~bad]
            if not len(alive):
                break
            texts = texts.only(~bad)
    return verdict


def judge(docs: DataFrame, id_column: str = "doc_id", text: str = "text", rules: dict[str, Rule] = RULES,
          order: Sequence[str] | None = None, measures: Sequence[str] = ()) -> DataFrame:
    """Id, the rule that rejected each row (null: kept) and the measures asked for, which cover rejected rows too."""
    order = list(order or plan(docs, rules, text))

    @W.lean
    def run(batches):
        for batch in batches:
            names, found = [], {m: [] for m in measures}
            for _, _, data, offsets in W.chunks(batch.column(1)):
                whole = Texts(data, offsets)
                for m in measures:
                    found[m].append(getattr(whole, m))
                names += [None if k < 0 else order[k] for k in _cascade(whole, rules, order)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), *(pa.array(np.concatenate([*v, np.zeros(0, np.int64)]), pa.int64()) for v in found.values())],
                [id_column, "rejected_by", *measures])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, F.col(text).cast("string")).mapInArrow(
        run, f"`{id_column}` {kind}, rejected_by string" + "".join(f", {m} long" for m in measures))


def keep_good(docs: DataFrame, text: str = "text", rules: dict[str, Rule] = RULES, order: Sequence[str] | None = None) -> DataFrame:
    """The rows that no rule rejects, with all their columns."""
    order, place = list(order or plan(docs, rules, text)), docs.columns.index(text)

    @W.lean
    def run(batches):
        for batch in batches:
            keep = [_cascade(Texts(d, o), rules, order) < 0 for _, _, d, o in W.chunks(batch.column(place))]
            yield batch.filter(pa.array(np.concatenate([*keep, np.zeros(0, bool)]), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
