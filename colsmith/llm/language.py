"""Language identification of mixed-language text.

Each word gets one score per learned language, the sum of log-probabilities of its byte trigrams. The
script of the word, found from fixed ranges of code points, first narrows the languages to those
whose training texts use that script. A Viterbi pass over the words of a text, with a penalty for
each change of language, then labels spans. The language with most bytes of words wins the text.

Trigrams are hashed into ``BUCKETS`` cells, so a model is a table of BUCKETS numbers per language.
Counts come from all training rows. Texts that are null or have no letter are ``und`` with score 0,
and so is every text when nothing was learned. Words without letters take the language around them.
Equal scores go to the language that is first in alphabetical order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsmith.llm import words as W

BUCKETS = 1 << 16
SWITCH = 6.0  # penalty of a change of language, in nats
RARE = 0.01  # share of a language's letters below which a script isn't its own
STRETCH = 4 << 20  # bytes of text labelled at a time, fewer with many languages
CELLS = 1 << 26  # bytes times languages of a stretch

# Fixed ranges of code points: (script, first, last). Latin includes ASCII letters.
SCRIPTS = (
    ("latin", 0x41, 0x5A), ("latin", 0x61, 0x7A), ("latin", 0xC0, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF),
    ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x77F),
    ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("tamil", 0xB80, 0xBFF), ("telugu", 0xC00, 0xC7F),
    ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
)
OTHER = "other"  # letters outside the ranges share one script, so trigrams alone decide between their languages
NAMES = (OTHER, *dict.fromkeys(n for n, _, _ in SCRIPTS))
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _script_table() -> np.ndarray:
    """Script number (0: none) of the code points that begin with two given bytes."""
    table = np.zeros((256, 256), np.uint8)
    number = {n: i + 1 for i, n in enumerate(NAMES)}

    def of(first, last):
        listed = next((number[n] for n, a, b in SCRIPTS if first <= b and last >= a), 0)
        return listed or number[OTHER] * any(chr(p).isalpha() for p in range(first, last + 1))

    for lead in range(128):
        table[lead, :] = of(lead, lead)
    for second in range(0x80, 0xC0):
        for lead in range(0xC2, 0xE0):
            point = (lead & 31) << 6 | (second & 63)
            table[lead, second] = of(point, point)
        for lead in range(0xE0, 0xF0):
            point = (lead & 15) << 12 | (second & 63) << 6
            table[lead, second] = of(point, point + 63)
        for lead in range(0xF0, 0xF4):
            point = (lead & 7) << 18 | (second & 63) << 12
            table[lead, second] = of(point, point + 4095) if point >= 0x10000 else 0
    return table.reshape(-1)


_SCRIPT = _script_table()


class Words:
    """Words of a stretch of texts with the trigram cells of their bytes and their scripts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        _, self.starts, self.lengths, self.rows = W.words(data, offsets)
        inside = W._IN_WORD[data]
        packed = W.lower(data)[inside].astype(np.uint32)
        self.begins = np.append(0, np.cumsum(self.lengths))[:-1]
        before, after = np.append(32, packed)[:-1].astype(np.uint32), np.append(packed, 32)[1:].astype(np.uint32)
        before[self.begins] = 32
        after[self.begins + self.lengths - 1] = 32
        gram = (before << np.uint32(16) | packed << np.uint32(8) | after) * np.uint32(2654435761)
        self.cells = (gram >> np.uint32(16)).astype(np.int64)
        scripts = _SCRIPT[packed << np.uint32(8) | after]
        self.scripts = np.maximum.reduceat(scripts, self.begins) if len(self.begins) else scripts
        self.per_byte = scripts


def counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """Trigram cells (cell >= 0) and scripts (cell < 0) by language, summed in each task before they are shuffled."""

    def run(batches):
        found = {}
        for batch in batches:
            languages = batch.column(1).to_pylist()
            for first, end, data, offsets in W.chunks(batch.column(0)):
                w = Words(data, offsets)
                byte_rows = np.repeat(w.rows, w.lengths)
                for name in {x for x in languages[first:end] if x is not None}:
                    own = np.array([x == name for x in languages[first:end]])
                    total = found.setdefault(name, np.zeros(BUCKETS + 256, np.int64))
                    mine = own[byte_rows]
                    total[:BUCKETS] += np.bincount(w.cells[mine], minlength=BUCKETS)
                    total[BUCKETS:] += np.bincount(w.per_byte[mine], minlength=256)
        for name, n in found.items():
            at = np.flatnonzero(n)
            for i in range(0, len(at), 50_000):
                part = at[i : i + 50_000]
                yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(part), pa.string()), "cell": pa.array(np.where(part < BUCKETS, part, BUCKETS - 1 - part)), "n": pa.array(n[part])})

    rows = docs.where(F.col(lang).isNotNull()).select(F.col(text).cast("string"), F.col(lang).cast("string")).mapInArrow(run, "lang string, cell long, n long")
    return rows.groupBy("lang", "cell").agg(F.sum("n").alias("n"))


class Model:
    """Scores of trigram cells for each language, and the scripts each language uses."""

    def __init__(self, languages: list[str], table: np.ndarray, allowed: np.ndarray):
        self.languages, self.table, self.allowed = languages, table, allowed

    def label(self, data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
        """Words and the number of the language of each."""
        w = Words(data, offsets)
        k = len(self.languages)
        if not len(w.starts):
            return w, np.zeros(0, np.int64)
        emission = np.empty((len(w.starts), k), np.float32)
        for j in range(k):
            emission[:, j] = np.add.reduceat(self.table[j][w.cells], w.begins)
        emission[w.scripts == 0] = 0
        emission += np.where(self.allowed[w.scripts], np.float32(0), np.float32(-1e4))
        return w, self._viterbi(emission, w.rows)

    @staticmethod
    def _viterbi(emission: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """All texts advance together, word by word; a text leaves when its words end."""
        heads = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        lengths = np.diff(np.append(heads, len(rows)))
        order = np.argsort(-lengths, kind="stable")
        heads, lengths = heads[order], lengths[order]
        active = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")  # how many texts have a word t
        number = np.min_scalar_type(-max(emission.shape[1], 1))  # int8 holds up to 128 languages
        back = np.zeros(emission.shape, number)
        own = np.arange(emission.shape[1], dtype=number)
        score = emission[heads].astype(np.float64)
        labels = np.empty(len(rows), np.int64)
        for t in range(1, lengths[0]):
            n = active[t]
            if n < len(score):
                ended = heads[n : len(score)] + lengths[n : len(score)] - 1
                labels[ended] = score[n:].argmax(1)
                score = score[:n]
            best = score.argmax(1)
            switched = score[np.arange(n), best][:, None] - SWITCH
            stay = score >= switched
            at = heads[:n] + t
            back[at] = np.where(stay, own, best[:, None].astype(number))
            score = np.where(stay, score, switched) + emission[at]
        labels[heads[: len(score)] + lengths[: len(score)] - 1] = score.argmax(1)
        for t in range(lengths[0] - 1, 0, -1):
            at = heads[: active[t]] + t
            labels[at - 1] = back[at, labels[at]]
        return labels


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Learn from all rows whose language isn't null."""
    found = counts(docs, text, lang).toPandas()  # at most BUCKETS + 256 rows a language
    languages = sorted(found["lang"].unique())
    table = np.full((len(languages), BUCKETS), 0.5)
    allowed = np.zeros((len(languages), 256))
    for j, name in enumerate(languages):
        mine = found[found["lang"] == name]
        cells = mine["cell"].to_numpy()
        table[j, cells[cells >= 0]] += mine["n"].to_numpy()[cells >= 0]
        allowed[j, -1 - cells[cells < 0]] = mine["n"].to_numpy()[cells < 0]
    table = np.log(table / table.sum(1, keepdims=True))
    letters = allowed[:, 1:].sum(1, keepdims=True)
    allowed = (allowed >= RARE * np.maximum(letters, 1)).T  # script by language
    allowed[0] = True
    allowed[~allowed.any(1)] = True  # a script nobody was seen to use narrows nothing
    if len(languages):
        table -= table.mean(0)
    return Model(languages, table.astype(np.float32), allowed)


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    found = W.per_row(_LETTER[data], offsets) > 0
    for i in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        found[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return found


def _spans(w: Words, labels: np.ndarray, data: np.ndarray, offsets: np.ndarray, names: list[str]) -> list[list[dict]]:
    points = np.append(0, np.cumsum((data < 0x80) | (data >= 0xC0)))
    out = [[] for _ in range(len(offsets) - 1)]
    if len(labels):
        first = np.flatnonzero(np.append(True, (labels[1:] != labels[:-1]) | (w.rows[1:] != w.rows[:-1])))
        last = np.append(first[1:], len(labels)) - 1
        base = points[offsets[w.rows[first]]]
        starts, ends = points[w.starts[first]] - base, points[w.starts[last] + w.lengths[last]] - base
        for r, a, b, k in zip(w.rows[first], starts, ends, labels[first]):
            out[r].append({"start": int(a), "end": int(b), "lang": names[k]})
    return out


def predict(docs: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text", with_spans: bool = True) -> DataFrame:
    """Id, lang_pred, score (share of the words' bytes that the language has) and spans in code points."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches):
        model = shared.value
        names, k = model.languages, len(model.languages)
        for batch in batches:
            for first, end, data, offsets in W.chunks(batch.column(1), min(STRETCH, CELLS // max(k, 1))):
                n = end - first
                letters = _has_letter(data, offsets) & (k > 0)
                winner, score, found = np.zeros(n, np.int64), np.zeros(n), [[]] * n
                if k:
                    w, labels = model.label(data, offsets)
                    weight = np.zeros((n, k))
                    scripted = np.zeros(n, bool)
                    scripted[w.rows[w.scripts > 0]] = True
                    heard = (w.scripts > 0) | ~scripted[w.rows]  # each text for itself
                    np.add.at(weight, (w.rows[heard], labels[heard]), w.lengths[heard])
                    winner, total = weight.argmax(1), weight.sum(1)
                    score = np.where(total > 0, weight.max(1) / np.maximum(total, 1), 1.0 / k)
                    if with_spans:
                        found = _spans(w, labels, data, offsets, names)
                out = [batch.column(0).slice(first, n),
                       pa.array([names[j] if ok else "und" for j, ok in zip(winner, letters)], pa.string()),
                       pa.array(np.where(letters, score, 0.0), pa.float64())]
                if with_spans:
                    out.append(pa.array([s if ok else [] for s, ok in zip(found, letters)], span))
                yield pa.RecordBatch.from_arrays(out, [id_column, "lang_pred", "score", "spans"][: len(out)])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, F.col(text).cast("string")).mapInArrow(
        run, f"`{id_column}` {kind}, lang_pred string, score double" + ", spans array<struct<start:int,end:int,lang:string>>" * with_spans)
