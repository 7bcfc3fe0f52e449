"""Removal of repeated byte strings by a distributed merge sort of suffixes.

A byte goes when a string of ``LENGTH`` bytes that covers it also starts earlier: in a document with a smaller id, or
earlier in the same one. Strings are judged on the input and may overlap.

Sorting a suffix at every byte would move the corpus a hundred times over, so, as in distributed string sorting with distinguishing prefixes,
only suffixes that can have an equal are exchanged:

1. Every window of LENGTH bytes has an anchor, its least ``GRAM``-byte string by a hash (the leftmost of equals). Neighbouring
   windows with one anchor form a segment. Equal windows have equal anchors at equal places.
2. Anchors are looked up globally by hash. A segment whose anchor occurs once holds no repeated window.
3. Each block of documents sorts the other segments as strings and keeps the first of equal ones (later ones are repeated as a whole). The sorted
   run is front-coded and split by a hash of the string, which spreads hot passages, and keeps each string's copies together.
4. Each part merges the runs with a loser tree that knows the common prefix of every candidate with the last winner: candidates are compared by
   that length alone unless it is equal, and then only beyond it. Strings equal to their predecessor are later copies.
5. Different segments around one anchor can share some windows. Those are sorted out anchor by anchor; windows of anchors with more than
   ``MANY`` different segments go through steps 3 and 4 as strings of their own.

All decisions compare bytes; hashes only choose where to look. Null and empty texts, and texts shorter than LENGTH, lose nothing. Rows with equal
ids are ordered by text, and equal rows among themselves; null ids come last. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsmith.llm import words as W
from colsmith.session import scratch_path

LENGTH = 100  # bytes of a repeated string
GRAM = 24  # bytes of an anchor
BLOCK_BYTES = 8 << 20  # bytes of text in a block of documents
MANY = 50_000  # different segments around an anchor that one task compares
SLICE = 1 << 19  # bytes looked at together

_LAST = (1 << 63) - 1  # order of a null id
RUN = "part int, lcp array<int>, size array<int>, rest binary, doc array<long>, ord array<int>, pos array<int>, block array<int>, place array<int>"
CUT = "block int, doc array<long>, ord array<int>, start array<int>, stop array<int>"
FLAG = "owner int, gram array<long>, many array<boolean>"


# Anchors and segments ---------------------------------------------------------------------------------------------------------------

def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on."""
    p = np.array([pow(0x9E3779B97F4A7C15, 1 << level, 1 << 64) for level in range(4)], np.uint64)
    h = data.astype(np.uint64) + np.uint64(1)
    eight = None
    for level in range(4):  # 2, 4, 8 and 16 bytes
        step = 1 << level
        h = h[:-step] * p[level] + h[step:]
        eight = h if level == 2 else eight
    return W.mix(h[: len(data) - GRAM + 1] * p[3] + eight[16 : 16 + len(data) - GRAM + 1])


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first byte, byte after the last, anchor place (all in ``data``) and anchor hash of every segment."""
    found = []
    lengths = np.diff(offsets)
    base = 0
    while base + LENGTH <= len(data):
        part = data[base : base + SLICE + LENGTH - 1]
        hashes = _gram_hashes(part)
        width = LENGTH - GRAM + 1  # anchors of a window
        low = (hashes & ~np.uint64(0xFFFFF)) | np.arange(len(hashes), dtype=np.uint64)
        step = 1
        while step * 2 <= width:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        n = len(part) - LENGTH + 1
        low = np.minimum(low[:n], low[width - step : width - step + n])
        anchor = (low & np.uint64(0xFFFFF)).astype(np.int64)
        starts = np.arange(base, base + n)
        row = np.searchsorted(offsets, starts, "right") - 1
        valid = starts + LENGTH <= offsets[row] + lengths[row]
        starts, row, anchor = starts[valid], row[valid], anchor[valid]
        if len(starts):
            first = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | (starts[1:] != starts[:-1] + 1)))
            last = np.append(first[1:], len(starts)) - 1
            found.append((row[first], starts[first], starts[last] + LENGTH, anchor[first] + base, hashes[anchor[first]]))
        base += SLICE
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found))


# Sorted runs --------------------------------------------------------------------------------------------------------------------------

def _gram(string: bytes, place: int) -> int:
    """A number for the anchor of a segment."""
    return int.from_bytes(hashlib.blake2b(string[place : place + GRAM], digest_size=8).digest(), "little", signed=True)


def _common(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, known to be ``start`` at least."""
    n = min(len(a), len(b))
    if a[start:n] == b[start:n]:
        return n
    step = 8
    while a[start : start + step] == b[start : start + step]:
        start += step
    while a[start] == b[start]:
        start += 1
    return start


def _prefixes(strings: list[bytes]) -> list[int]:
    return [0] + [_common(a, b) for a, b in zip(strings, strings[1:])] if strings else []


def _run(part: int, entries: list[tuple]) -> dict:
    """A front-coded row of sorted entries (string, doc, ord, pos, block, place)."""
    strings = [e[0] for e in entries]
    lcp = _prefixes(strings)
    columns = list(zip(*[e[1:] for e in entries]))
    return {"part": part, "lcp": lcp, "size": [len(s) for s in strings], "rest": zstandard.ZstdCompressor(1).compress(b"".join(s[k:] for s, k in zip(strings, lcp))),
            **dict(zip(("doc", "ord", "pos", "block", "place"), map(list, columns)))}


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = []
    for item in ddl.split(", "):
        name, kind = item.split(" ")
        fields.append((name, pa.list_(kinds[kind[6:-1]]) if kind.startswith("array") else kinds[kind]))
    return pa.schema(fields)


def _table(rows: list[dict], ddl: str) -> pa.Table:
    schema = _schema(ddl)
    return pa.Table.from_pylist(rows, schema=schema)


def split_runs(entries: list[tuple], parts: int) -> Iterator[dict]:
    """Sort entries and give a run for each part."""
    entries.sort()
    dealt: dict[int, list] = {}
    for e in entries:
        dealt.setdefault(int.from_bytes(hashlib.blake2b(e[0], digest_size=4).digest(), "little") % parts, []).append(e)
    return (_run(p, own) for p, own in dealt.items())


class Run:
    """Reads a front-coded run string by string."""

    __slots__ = ("string", "lcp", "entry", "_rest", "_lcps", "_sizes", "_fields", "_at", "_i")

    def __init__(self, row: dict):
        self._rest, self._lcps, self._sizes = zstandard.ZstdDecompressor().decompress(row["rest"]), row["lcp"], row["size"]
        self._fields = list(zip(row["doc"], row["ord"], row["pos"], row["block"], row["place"]))
        self._at = self._i = 0
        self.string = b""
        self.advance()

    def advance(self) -> bool:
        """To the next string; ``lcp`` is its common prefix with the one before. False at the end."""
        i = self._i
        if i == len(self._lcps):
            self.string = None
            return False
        k = self._lcps[i]
        more = self._sizes[i] - k
        self.string = self.string[:k] + self._rest[self._at : self._at + more]
        self.lcp, self.entry = k, self._fields[i]
        self._at += more
        self._i = i + 1
        return True


def merge(runs: list[Run]) -> Iterator[tuple[int, bytes, tuple]]:
    """(common prefix with the string before, string, fields) in order of strings and then of fields.

    A loser tree: every inner node holds the run that lost there and the length of its common prefix with the winner that passed.
    All candidates were last compared with strings that are not after the last winner, so of two candidates the one
    with the longer common prefix comes first, and only equal lengths are compared, from there on.
    """
    runs = [r for r in runs if r.string is not None]
    n = 1
    while n < len(runs):
        n *= 2
    prefix = [0] * n  # of each run's string with the last winner
    alive = [i < len(runs) for i in range(n)]

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's prefix becomes that with the winner."""
        if not alive[b]:
            return a, b
        if not alive[a]:
            return b, a
        if prefix[a] != prefix[b]:
            return (a, b) if prefix[a] > prefix[b] else (b, a)
        x, y = runs[a].string, runs[b].string
        k = _common(x, y, prefix[a])
        if k == len(x) == len(y):
            first = runs[a].entry < runs[b].entry
        else:
            first = k == len(x) or (k < len(y) and x[k] < y[k])
        winner, loser = (a, b) if first else (b, a)
        prefix[loser] = k
        return winner, loser

    if not runs:
        return
    tree, winners = [0] * n, [0] * n + list(range(n))
    for node in range(n - 1, 0, -1):
        winners[node], tree[node] = play(winners[2 * node], winners[2 * node + 1])
    best = winners[1]
    while alive[best]:
        run = runs[best]
        yield prefix[best], run.string, run.entry
        if run.advance():
            prefix[best] = run.lcp
        else:
            alive[best] = False
        node = (best + n) // 2
        while node:
            best, tree[node] = play(best, tree[node])
            node //= 2


# Stages ----------------------------------------------------------------------------------------------------------------------------------

class _Cuts:
    """Stretches to remove, collected by block of documents."""

    def __init__(self):
        self.rows: dict[int, tuple[list, list, list, list]] = {}

    def add(self, block, doc, order, start, stop):
        own = self.rows.setdefault(block, ([], [], [], []))
        for column, value in zip(own, (doc, order, start, stop)):
            column.append(value)

    def rows_of(self) -> list[dict]:
        return [dict(zip(("block", "doc", "ord", "start", "stop"), (b, *own))) for b, own in self.rows.items()]


BOTH = RUN + ", doc_block int, start array<int>, stop array<int>"  # a run, or (with doc_block) stretches to remove


def _both(runs: list[dict], cuts: _Cuts, parts: int = 1) -> pa.Table:
    """Stretches are given a part as well, so that they can go with the runs through an exchange."""
    rows = [*runs, *({"doc_block": c["block"], "part": c.pop("block") % parts, **c} for c in cuts.rows_of())]
    return pa.Table.from_pylist(rows, schema=_schema(BOTH))


def _anchor_rows(docs: DataFrame, parts: int) -> DataFrame:
    """For every task: anchors with their block, dealt by hash; anchors known to be repeated go straight to their blocks."""

    def run(batches):
        held, size = [], 0

        def give():
            pairs = np.concatenate(held)
            pairs = pairs[np.lexsort((pairs["block"], pairs["gram"]))]
            same_gram = np.append(False, pairs["gram"][1:] == pairs["gram"][:-1])
            repeated = same_gram | np.append(same_gram[1:], False)
            fresh = pairs[~(same_gram & np.append(False, pairs["block"][1:] == pairs["block"][:-1]))]
            twice = repeated[~(same_gram & np.append(False, pairs["block"][1:] == pairs["block"][:-1]))]
            direct, single = fresh[twice], fresh[~twice]
            marks = np.unique(direct["gram"])
            part = np.append(single["gram"], marks) % np.uint64(parts)
            grams, blocks = np.append(single["gram"], marks), np.append(single["block"], np.full(len(marks), -1, np.int32))
            order = np.argsort(part, kind="stable")
            grams, blocks, part = grams[order], blocks[order], part[order]
            rows = []
            cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else []
            for a, b in zip(cuts, np.append(cuts[1:], len(part)) if len(part) else []):
                rows.append((int(part[a]), grams[a:b], blocks[a:b]))
            direct = direct[np.argsort(direct["block"], kind="stable")]
            cuts = np.flatnonzero(np.append(True, direct["block"][1:] != direct["block"][:-1])) if len(direct) else []
            for a, b in zip(cuts, np.append(cuts[1:], len(direct)) if len(direct) else []):
                rows.append((int(direct["block"][a]) % parts, direct["gram"][a:b], -2 - direct["block"][a:a + 1]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1].view(np.int64) for r in rows], pa.list_(pa.int64())),
                 pa.array([r[2] for r in rows], pa.list_(pa.int32()))], ["part", "gram", "block"])

        for batch in batches:
            blocks = batch.column(0).to_numpy(zero_copy_only=False)
            for first, _, data, offsets in W.chunks(batch.column(1)):
                row, *_, grams = segments(data, offsets)
                pairs = np.empty(len(row), [("gram", np.uint64), ("block", np.int32)])
                pairs["gram"], pairs["block"] = grams, blocks[first + row]
                held.append(pairs)
                size += len(pairs)
                if size > 2_000_000:
                    yield from give()
                    held, size = [], 0
        if size:
            yield from give()

    return docs.select("block", "text").mapInArrow(run, "part int, gram array<long>, block array<int>")


def _repeated_anchors(rows: DataFrame) -> DataFrame:
    """Which anchors of each block occur elsewhere too."""

    def run(table: pa.Table) -> pa.Table:
        grams, blocks, out = [], [], []
        for g, b in zip(table.column("gram"), table.column("block")):
            g, b = g.values.to_numpy(), b.values.to_numpy()
            if len(b) and b[0] <= -2:
                out.append({"owner": int(-2 - b[0]), "gram": g})
            else:
                grams.append(g)
                blocks.append(b)
        if grams:
            grams, blocks = np.concatenate(grams), np.concatenate(blocks)
            order = np.argsort(grams)
            grams, blocks = grams[order], blocks[order]
            same = np.append(False, grams[1:] == grams[:-1])
            keep = (same | np.append(same[1:], False)) & (blocks >= 0)
            grams, blocks = grams[keep], blocks[keep]
            order = np.argsort(blocks, kind="stable")
            grams, blocks = grams[order], blocks[order]
            for b in np.unique(blocks):
                out.append({"owner": int(b), "gram": grams[np.searchsorted(blocks, b) : np.searchsorted(blocks, b, "right")]})
        return pa.table({"owner": pa.array([o["owner"] for o in out], pa.int32()), "gram": pa.array([o["gram"] for o in out], pa.list_(pa.int64()))})

    return rows.groupBy("part").applyInArrow(run, "owner int, gram array<long>")


def _packed(docs: DataFrame) -> DataFrame:
    """Documents of a task and block in one compressed row, which moves half as much as row by row."""
    schema = pa.schema([("block", pa.int32()), ("id", pa.list_(pa.int64())), ("size", pa.list_(pa.int64())), ("text", pa.binary())])

    def run(batches):
        pack = zstandard.ZstdCompressor(1).compress
        for batch in batches:
            blocks = batch.column(0).to_numpy(zero_copy_only=False)
            order = np.argsort(blocks, kind="stable")
            batch, blocks = batch.take(pa.array(order)), blocks[order]
            data, offsets = W.text_buffer(batch.column(2))
            cuts = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1])).tolist() if len(blocks) else []
            rows = [{"block": blocks[a], "id": batch.column(1).slice(a, b - a).to_pylist(), "size": np.diff(offsets[a : b + 1]), "text": pack(data[offsets[a] : offsets[b]].tobytes())}
                    for a, b in zip(cuts, [*cuts[1:], len(blocks)])]
            if rows:
                yield from pa.Table.from_pylist(rows, schema=schema).to_batches()

    return docs.select("block", "id", "text").mapInArrow(run, "block int, id array<long>, size array<long>, text binary")


def _ordered(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list]:
    """A block's rows by id (nulls last) and text: bytes, offsets, ids (nulls as _LAST), ordinals of rows with equal ids, ids as they are."""
    rows = []
    for packed in table.to_pylist():
        data, at = zstandard.ZstdDecompressor().decompress(packed["text"]), 0
        for i, size in zip(packed["id"], packed["size"]):
            rows.append((i is None, _LAST if i is None else i, data[at : at + size]))
            at += size
    rows.sort()
    data = np.frombuffer(b"".join(r[2] for r in rows), np.uint8)
    offsets, ids = np.append(0, np.cumsum([len(r[2]) for r in rows], dtype=np.int64)), np.array([r[1] for r in rows], np.int64)
    same = np.append(False, ids[1:] == ids[:-1]) if len(ids) else np.zeros(0, bool)
    place = np.arange(len(ids))
    first = np.maximum.accumulate(np.where(same, 0, place)) if len(ids) else place
    return data, offsets, ids, place - first, [None if r[0] else r[1] for r in rows]


def _flagged(table: pa.Table, name: str = "gram") -> np.ndarray:
    parts = [x.values.to_numpy() for x in table.column(name)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)


def _first_of_equal(entries: Iterator[tuple], cuts: _Cuts) -> list[tuple]:
    """The first entry of each string; the others are stretches to remove. Entries come in order of place."""
    first: dict[bytes, tuple] = {}
    for e in entries:
        if e[0] in first:
            cuts.add(e[4], e[1], e[2], e[3], e[3] + len(e[0]))
        else:
            first[e[0]] = e
    return list(first.values())


def _block_runs(parts: int):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, flags: pa.Table) -> pa.Table:
        if not docs.num_rows or not flags.num_rows:
            return _both([], _Cuts())
        block = key[0].as_py()
        data, offsets, ids, ords, _ = _ordered(docs)
        row, start, stop, anchor, grams = segments(data, offsets)
        known = _flagged(flags)
        at = np.minimum(np.searchsorted(known, grams.view(np.int64)), len(known) - 1)
        hit = known[at] == grams.view(np.int64)
        row, start, stop, anchor = row[hit], start[hit], stop[hit], anchor[hit]
        raw, cuts = data.tobytes(), _Cuts()
        entries = zip([raw[a:b] for a, b in zip(start.tolist(), stop.tolist())], ids[row].tolist(), ords[row].tolist(), (start - offsets[row]).tolist(),
                      [block] * len(row), (anchor - start).tolist())
        return _both(list(split_runs(_first_of_equal(entries, cuts), parts)), cuts, parts)

    return run


def _merge_part(keep: bool):
    """Merge the runs of a part: later copies are removed, and with ``keep`` the first of each string goes on. Stretches pass through."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        cuts, first = _Cuts(), []
        last = None
        passed = table.filter(pc.is_valid(table.column("doc_block")))
        runs = [Run(r) for r in table.filter(pc.is_null(table.column("doc_block"))).to_pylist()]
        for prefix, string, entry in merge(runs):
            if last is not None and prefix == len(string) == len(last):
                doc, order, pos, block = entry[:4]
                cuts.add(block, doc, order, pos, pos + len(string))
            else:
                last = string
                if keep:
                    first.append((string, *entry))
        made = _both([_run(key[0].as_py(), first)] if first else [], cuts)
        return pa.concat_tables([passed.cast(made.schema), made])

    return run


def _segments_by_anchor(runs: DataFrame, parts: int) -> DataFrame:
    """(owner, gram, n) for each part's anchors, dealt by hash."""

    def run(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                reader, found = Run(row), []
                while reader.string is not None:
                    found.append(_gram(reader.string, reader.entry[4]))
                    reader.advance()
                values, counts = np.unique(np.array(found, np.int64), return_counts=True)
                part = values.view(np.uint64) % np.uint64(parts)
                rows += [(int(p), row["part"], values[part == p], counts[part == p]) for p in np.unique(part)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
                                              pa.array([r[2] for r in rows], pa.list_(pa.int64())), pa.array([r[3] for r in rows], pa.list_(pa.int64()))], ["part", "owner", "gram", "n"])

    return runs.select(*[x.split(" ")[0] for x in RUN.split(", ")]).mapInArrow(run, "part int, owner int, gram array<long>, n array<long>")


def _shared_anchors(rows: DataFrame, many: int) -> DataFrame:
    """The anchors of each owner that have two different segments or more, and whether they have over ``many``."""

    def run(table: pa.Table) -> pa.Table:
        grams, counts = (np.concatenate([x.values.to_numpy() for x in table.column(c)]) for c in ("gram", "n"))
        owners = np.repeat(table.column("owner").to_numpy(), [len(x) for x in table.column("gram")])
        values, inverse = np.unique(grams, return_inverse=True)
        total = np.bincount(inverse, counts)[inverse]
        keep = total >= 2
        grams, owners, total = grams[keep], owners[keep], total[keep]
        out = [(int(o), grams[owners == o], total[owners == o] > many) for o in np.unique(owners)]
        return pa.table({"owner": pa.array([o[0] for o in out], pa.int32()), "gram": pa.array([o[1] for o in out], pa.list_(pa.int64())), "many": pa.array([o[2] for o in out], pa.list_(pa.bool_()))})

    return rows.groupBy("part").applyInArrow(run, FLAG)


def _spread(parts: int, windows: bool):
    """Of a part's segments those with shared anchors: by anchor, or (``windows``, for anchors with many) their windows by string."""

    def run(key: tuple[pa.Scalar, ...], runs: pa.Table, flags: pa.Table) -> pa.Table:
        if not runs.num_rows or not flags.num_rows:
            return _both([], _Cuts())
        chosen = {g for gs, ms in zip(flags.column("gram").to_pylist(), flags.column("many").to_pylist()) for g, m in zip(gs, ms) if m == windows}
        cuts, dealt, pieces = _Cuts(), {}, []
        for row in runs.to_pylist():
            reader = Run(row)
            while reader.string is not None:
                string, entry = reader.string, reader.entry
                gram = _gram(string, entry[4])
                if gram in chosen:
                    if windows:
                        doc, order, pos, block = entry[:4]
                        pieces += [(string[i : i + LENGTH], doc, order, pos + i, block, 0) for i in range(len(string) - LENGTH + 1)]
                    else:
                        dealt.setdefault(gram % parts, []).append((string, *entry))
                reader.advance()
        if windows:
            pieces.sort(key=lambda e: e[1:])
            return _both(list(split_runs(_first_of_equal(pieces, cuts), parts)), cuts, parts)
        return _both([_run(p, own) for p, own in dealt.items()], cuts)

    return run


def _compare_around_anchors(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Windows at one distance from one anchor that are equal: all but the first are removed."""
    by_gram: dict[int, list] = {}
    for row in table.to_pylist():
        reader = Run(row)
        while reader.string is not None:
            doc, order, pos, block, place = reader.entry
            by_gram.setdefault(reader.string[place : place + GRAM], []).append((doc, order, pos + place, pos, block, place, reader.string))
            reader.advance()
    cuts = _Cuts()
    for own in by_gram.values():
        own.sort(key=lambda e: e[:3])
        for distance in range(LENGTH):
            seen = set()
            for doc, order, _, pos, block, place, string in own:
                i = place - distance
                if 0 <= i <= len(string) - LENGTH:
                    window = string[i : i + LENGTH]
                    if window in seen:
                        cuts.add(block, doc, order, pos + i, pos + i + LENGTH)
                    seen.add(window)
    return _both([], cuts)


def _stored(df: DataFrame) -> DataFrame:
    """The table written in the shared folder and read again: it cuts the lineage as a checkpoint does, in compressed form."""
    path = scratch_path(df.sparkSession, "suffixes")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _stretches(cuts: DataFrame) -> DataFrame:
    return cuts.where("doc_block is not null").select(F.col("doc_block").alias("block"), "doc", "ord", "start", "stop")


def _apply(key: tuple[pa.Scalar, ...], docs: pa.Table, cuts: pa.Table) -> pa.Table:
    data, offsets, ids, ords, names = _ordered(docs)
    change = np.zeros(len(data) + 1, np.int32)
    if cuts.num_rows:
        first = {(i, o): k for k, (i, o) in enumerate(zip(ids.tolist(), ords.tolist()))}
        for r in cuts.to_pylist():
            base = offsets[[first[x] for x in zip(r["doc"], r["ord"])]]
            np.add.at(change, base + np.array(r["start"]), 1)
            np.add.at(change, base + np.array(r["stop"]), -1)
    gone = np.cumsum(change[:-1]) > 0
    head = gone & ~np.append(False, gone[:-1])
    at = offsets[:-1][offsets[:-1] < len(data)]
    head[at] = gone[at]
    left = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(offsets, offsets[1:])]
    return pa.table({"id": pa.array(names, pa.int64()), "n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(W.per_row(gone, offsets)), "n_spans": pa.array(W.per_row(head, offsets)),
                     "kept": pa.array(left, pa.binary())})


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, many: int = MANY) -> DataFrame:
    """Id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (the bytes that stay, which need not be valid UTF-8) of every row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // block_bytes))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    blocks = _packed(rows).groupBy("block")

    flags = _repeated_anchors(_anchor_rows(rows, parts))
    local = blocks.cogroup(flags.groupBy("owner")).applyInArrow(_block_runs(parts), BOTH)
    merged = _stored(local.groupBy("part").applyInArrow(_merge_part(True), BOTH))
    first = merged.where("doc_block is null")
    shared = _stored(_shared_anchors(_segments_by_anchor(first, parts), many))
    spread = first.groupBy("part").cogroup(shared.groupBy("owner"))
    around = spread.applyInArrow(_spread(parts, False), BOTH).groupBy("part").applyInArrow(_compare_around_anchors, BOTH)
    cuts = _stretches(merged).unionByName(_stretches(around))
    if shared.where(F.exists("many", lambda m: m)).limit(1).count():
        windows = spread.applyInArrow(_spread(parts, True), BOTH)
        cuts = cuts.unionByName(_stretches(windows.groupBy("part").applyInArrow(_merge_part(False), BOTH)))
    found = blocks.cogroup(cuts.groupBy("block")).applyInArrow(_apply, "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return found.withColumnRenamed("id", id_column)
