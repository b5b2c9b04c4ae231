"""Removal of repeated passages by longest-previous-factor values.

lpf[p] is the length of the longest string that starts at p and also starts earlier. In suffix
order the candidates for it are the previous and the next entry with a smaller position, and the
string they share with p is the least of the common prefixes of neighbours on the way to them
(previous_factors() finds both by following pointers). A byte goes if a string of LENGTH bytes that
covers it starts where lpf is at least LENGTH, so the first copy stays. Earlier means in a document
of smaller doc_id, or before in the same one.

One suffix array of a corpus cannot be built in one place, and lpf is only compared with LENGTH,
so suffixes are cut to windows of LENGTH bytes and dealt by content: each window goes with the
smallest hash of its GRAM-byte strings (its anchor), which equal windows share. Neighbouring
windows with the same anchor form a segment, about one for every 35 bytes. The suffix array of each
anchor is made at two levels, and the same previous_factors() judges both:
  1. Segments in the order of their names (hashes of 128 bits beside the anchor's), in which equal
     ones are neighbours and share their whole length. One whose lpf is its length repeats an
     earlier one as a whole. Segments travel as packed arrays; those of a batch of documents meet
     before the shuffle, so that a passage that everyone has is one entry for each batch.
  2. Where an anchor has different segments, the bytes of the first of each name are fetched, and
     their windows are put into suffix order by their bytes.
Windows never cross documents. Every window is judged on the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import id_and_text, partitions, stash

#: Bytes of a repeated string, bytes that anchors are hashed from, windows hashed at a time.
LENGTH, GRAM, BLOCK = 100, 32, 1 << 18

#: From so many different segments an anchor's windows are dealt anew, each by its own content;
#: windows that are put into suffix order at a time.
CROWD, SORTED = 2_000, 200_000

_Q1, _Q2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_RUNS = pa.schema([("kind", pa.int32()), ("anchor", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n", pa.int64())])
_PACKED = pa.schema([("part", pa.int32()), ("anchors", pa.binary()), ("marks", pa.binary()), ("names", pa.binary()), ("ids", pa.binary()), ("starts", pa.binary()), ("counts", pa.binary())])


def previous_factors(position: np.ndarray, common: np.ndarray) -> np.ndarray:
    """lpf of entries in suffix order, each with its position (all different).

    common[i] is the length of the common prefix of the entries i - 1 and i; common[0] counts not.
    Of each entry a pointer goes back to the nearest entry of a smaller position, in steps that take
    over the pointers of those in between, and another one goes ahead.
    """
    out = np.zeros(len(position), np.int64)
    if not len(position):
        return out
    for way in (1, -1):
        at = position[::way]
        low = np.concatenate([[0], common[1:][::way]]).astype(np.int64)
        back = np.arange(-1, len(at) - 1)
        waiting = np.flatnonzero((low > 0) & (at[back] > at))
        while len(waiting):
            over = back[waiting]
            low[waiting] = np.minimum(low[waiting], low[over])
            back[waiting] = back[over]
            waiting = waiting[low[waiting] > 0]  # which also holds for no entry that has none before it
            waiting = waiting[at[back[waiting]] > at[waiting]]
        out = np.maximum(out, low[::way])
    return out


def common_prefixes(rows: np.ndarray) -> np.ndarray:
    """For sorted rows of bytes, how many bytes each has in common with the one before (0 for the first)."""
    differ = rows[1:] != rows[:-1]
    first = differ.argmax(axis=1)
    return np.concatenate([[0], np.where(differ[np.arange(len(first)), first], first, rows.shape[1])])


def lpf(data: bytes) -> list[int]:
    """The longest-previous-factor array of data, whole suffixes being compared."""
    n = len(data)
    order = sorted(range(n), key=lambda i: data[i:])
    rows = np.zeros((n, n + 1), np.int16)  # an end is smaller than any byte
    for i, at in enumerate(order):
        rows[i, : n - at] = np.frombuffer(data, np.uint8)[at:] + np.int16(1)
    found = np.minimum(common_prefixes(rows), n - np.array(order))
    out = np.zeros(n, np.int64)
    out[order] = previous_factors(np.array(order), found)
    return out.tolist()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _Q1
    x = (x ^ (x >> np.uint64(27))) * _Q2
    return x ^ (x >> np.uint64(31))


@cache
def _tables() -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """A random number for each byte, and the powers of three odd bases and of their inverses."""
    rng = np.random.default_rng(4)
    size, out = BLOCK + 2 * LENGTH, []
    for base in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA24BAED4963EE407):
        inverse = pow(base, -1, 1 << 64)
        factors = np.full((2, size + 1), 1, np.uint64)
        factors[0, 1:], factors[1, 1:] = base, inverse
        out.append(tuple(np.multiply.accumulate(factors, axis=1)))
    return rng.integers(0, 1 << 64, 256, np.uint64), out


def segments(data: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Of each block of a text's windows: (anchors, marks, names, starts, counts) of its segments."""
    out = []
    value, ((p1, i1), *more) = _tables()
    width = LENGTH - GRAM + 1
    bits = np.uint64((1 << 20) - 1)
    for at in range(0, len(data) - LENGTH + 1, BLOCK):
        b = value[data[at : at + BLOCK + LENGTH - 1]]
        n = len(b)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(b * p1[:n], out=sums[1:])
        grams = _mix((sums[GRAM:] - sums[:-GRAM]) * i1[: n - GRAM + 1])
        place = np.arange(len(grams), dtype=np.uint64)
        # The smallest of each width neighbours: minima from both ends of blocks of that width.
        rows = -(-len(grams) // width)
        padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
        padded[: len(grams)] = (grams & ~bits) | place
        padded = padded.reshape(rows, width)
        ahead = np.minimum.accumulate(padded, axis=1).ravel()
        back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = n - LENGTH + 1
        anchor = (np.minimum(back[:windows], ahead[width - 1 : width - 1 + windows]) & bits).astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        count = np.diff(np.append(start, windows))
        hashes = []
        for p, i in more:
            np.cumsum(b * p[:n], out=sums[1:])
            hashes.append(_mix((sums[start + count + LENGTH - 1] - sums[start]) * i[start] + count.astype(np.uint64)))
        out.append((grams[anchor[start]], *hashes, start + at, count))
    return out


def _merged(doc: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows, joined where one begins at another's end."""
    order = np.lexsort((start, doc))
    doc, start, count = doc[order], start[order], count[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + count[:-1])])
    at = np.flatnonzero(new)
    return doc[at], start[at], np.add.reduceat(count, at)


def _first_of_equal(*keys: np.ndarray) -> np.ndarray:
    """For sorted keys whether an entry differs from the one before."""
    return np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])


def _pack(parts: np.ndarray, columns: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    order = np.argsort(parts, kind="stable")
    found, begin = np.unique(parts[order], return_index=True)
    cuts = list(zip(begin, [*begin[1:], len(parts)], strict=True))
    cells = [[c[a:b].tobytes() for a, b in cuts] for c in (c[order] for c in columns)]
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((found, *cells), _PACKED, strict=True)], schema=_PACKED)


def _deal(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Segments of each batch by parts. An empty mark cell has runs already known as repeats."""
    for batch in batches:
        found: list[list[np.ndarray]] = [[], [], [], [], [], []]
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        used = sorted((doc, k) for k, doc in enumerate(ids) if doc is not None)
        for doc, k in used:
            raw = texts[k].as_buffer()
            if raw is None or raw.size < LENGTH:
                continue
            for anchor, mark, name, start, count in segments(np.frombuffer(raw, np.uint8)):
                for into, x in zip(found, (anchor, mark, name, np.full(len(start), doc, np.int64), start, count), strict=True):
                    into.append(x)
        if not found[0]:
            continue
        first, known, cells = _judged(*(np.concatenate(x) for x in found), in_order=len({doc for doc, _ in used}) == len(used))
        anchor, mark, name, doc, start, count = cells
        if known.any():
            d, s, c = _merged(doc[known], start[known], count[known])
            none = np.zeros(len(d), "V0")
            yield _pack((np.abs(d) % parts).astype(np.int32), (np.zeros(len(d), np.uint64), none, none, d, s.astype(np.int64), c.astype(np.int64)))
        kept = (anchor[first], mark[first], name[first], doc[first], start[first].astype(np.int64), count[first].astype(np.int64))
        yield _pack((kept[0] % np.uint64(parts)).astype(np.int32), kept)


def _judged(anchor, mark, name, doc, start, count, in_order: bool = False) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """Segments in the order of their names: which are the first of a name, which repeat one, and they.

    in_order says that they come in the order of their positions, and all their documents once; then
    one hash is order enough, for names that it does not tell apart meet again in _part().
    """
    cells = (anchor, mark, name, doc, start, count)
    if not in_order:
        order = np.lexsort((start, doc))
        cells = tuple(x[order] for x in cells)
    place = np.argsort(mark, kind="stable") if in_order else np.lexsort((cells[2], cells[1], cells[0]))
    cells = tuple(x[place] for x in cells)
    if not in_order:  # of repeated rows of a document one is enough
        once = _first_of_equal(*cells[:5])
        place, cells = place[once], tuple(x[once] for x in cells)
    size = cells[5] + LENGTH - 1
    repeats = previous_factors(place, np.where(_first_of_equal(*cells[:3]), 0, size)) >= size
    return ~repeats, repeats, cells


def _runs(kind: int, anchor, doc, start, count) -> pa.RecordBatch:
    n = len(doc)
    anchor = np.zeros(n, np.int64) if anchor is None else anchor.view(np.int64)
    cells = (np.full(n, kind, np.int32), anchor, doc, start, count)
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cells, _RUNS, strict=True)], schema=_RUNS)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 0: repeated runs. Kinds 1, 2: segments that others of their anchor differ from (2: in a crowd).

    Rows come sorted by part, and one part is in memory at a time.
    """
    cells: list[list[np.ndarray]] = [[], [], [], [], [], []]
    kinds = (np.uint64, np.uint64, np.uint64, np.int64, np.int64, np.int64)
    part = None
    for batch in batches:
        for at, *row in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
            if not row[1]:
                yield _runs(0, None, *(np.frombuffer(x, np.int64) for x in row[3:]))
                continue
            if at != part and cells[0]:
                yield from _part(cells)
                cells = [[], [], [], [], [], []]
            part = at
            for into, x, kind in zip(cells, row, kinds, strict=True):
                into.append(np.frombuffer(x, kind))
    if cells[0]:
        yield from _part(cells)


def _part(cells: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    first, repeats, (anchor, _, _, doc, start, count) = _judged(*(np.concatenate(x) for x in cells))
    if repeats.any():
        yield _runs(0, None, *_merged(doc[repeats], start[repeats], count[repeats]))
    anchor, doc, start, count = anchor[first], doc[first], start[first], count[first]
    begin = np.flatnonzero(_first_of_equal(anchor))
    size = np.diff(np.append(begin, len(anchor)))
    many = np.repeat(size, size)
    for kind, pick in ((1, (many > 1) & (many <= CROWD)), (2, many > CROWD)):
        if pick.any():
            yield _runs(kind, anchor[pick], doc[pick], start[pick], count[pick])


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the wanted segments; those of a crowd as single windows under their own hash."""
    schema = pa.schema([("anchor", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("data", pa.binary())])
    for batch in batches:
        rows: list[tuple] = []
        singles: dict[int, list] = {}
        repeats: list[tuple[int, int]] = []
        for doc, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            if not wanted:
                continue
            raw = text.as_py().encode("utf-8", "surrogatepass")
            for w in wanted:
                start, n = w["start"], w["n"]
                if w["kind"] == 1:
                    rows.append((w["anchor"], doc, start, raw[start : start + n - 1 + LENGTH]))
                    continue
                for at in range(start, start + n):
                    window = raw[at : at + LENGTH]
                    key = xxhash.xxh3_128_intdigest(window)
                    old = singles.get(key)
                    if old is None:
                        singles[key] = [doc, at, window]
                    elif (doc, at) < (old[0], old[1]):
                        repeats.append((old[0], old[1]))
                        old[0], old[1] = doc, at
                    elif (doc, at) != (old[0], old[1]):
                        repeats.append((doc, at))
        rows += [((k & ((1 << 63) - 1)), d, at, window) for k, (d, at, window) in singles.items()]
        rows += [(d, d, at, None) for d, at in repeats]  # no bytes: known as repeats
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def repeated_windows(docs: np.ndarray, starts: np.ndarray, data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(doc, start) of the windows of these segments whose lpf reaches LENGTH."""
    sizes = np.array([len(x) - LENGTH + 1 for x in data])
    flat = np.frombuffer(b"".join(data), np.uint8)
    first = np.concatenate([[0], np.cumsum(sizes + LENGTH - 1)[:-1]])
    inside = np.arange(sizes.sum()) - np.repeat(np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    doc, start = np.repeat(docs, sizes), np.repeat(starts, sizes) + inside
    windows = np.lib.stride_tricks.sliding_window_view(flat, LENGTH)[np.repeat(first, sizes) + inside]
    place = np.lexsort((start, doc))
    place = place[_first_of_equal(doc[place], start[place])]  # of repeated rows one
    windows, doc, start = np.ascontiguousarray(windows[place]), doc[place], start[place]
    order = np.argsort(windows.view(f"S{LENGTH}").ravel(), kind="stable")  # positions are their ranks now
    pick = order[previous_factors(order, common_prefixes(windows[order])) >= LENGTH]
    return doc[pick], start[pick]


def _sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated runs among segments that come sorted by anchor."""
    rows: list[tuple] = []
    waiting = 0

    def done(some: list[tuple]) -> Iterator[pa.RecordBatch]:
        known = [(r[1], r[2]) for r in some if r[3] is None]
        rest = [r for r in some if r[3] is not None]
        found = [np.array(known, np.int64).reshape(-1, 2).T]
        if rest:
            found.append(np.stack(repeated_windows(np.array([r[1] for r in rest], np.int64), np.array([r[2] for r in rest], np.int64), [r[3] for r in rest])))
        doc, start = np.concatenate(found, axis=1)
        if len(doc):
            yield _runs(0, None, *_merged(doc, start, np.ones(len(doc), np.int64)))

    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if waiting >= SORTED and row[0] != rows[-1][0]:
                yield from done(rows)
                rows, waiting = [], 0
            rows.append(row)
            waiting += len(row[3]) - LENGTH + 1 if row[3] else 1
    if rows:
        yield from done(rows)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                        ("kept_sha256", pa.string()), ("spans", pa.list_(pa.list_(pa.int64())))])
    for batch in batches:
        out = []
        for doc, text, runs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            raw = text.as_py().encode("utf-8", "surrogatepass")
            spans: list[list[int]] = []
            for start, n in sorted((r["start"], r["n"]) for r in runs or ()):
                stop = min(start + n - 1 + LENGTH, len(raw))
                if spans and start <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], stop)
                elif start < stop:
                    spans.append([start, stop])
            kept, at = hashlib.sha256(), 0
            for start, stop in spans:
                kept.update(raw[at:start])
                at = stop
            kept.update(raw[at:])
            out.append((doc, len(raw), sum(b - a for a, b in spans), len(spans), kept.hexdigest(), spans))
        columns = list(zip(*out, strict=True)) or [[] for _ in schema]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (byte ranges that go).

    Texts are UTF-8 bytes; a null text is empty. Repeated rows of a document are one document and
    get equal results; of rows with one doc_id but different texts each loses what any of them
    should. Rows without doc_id have no place in the order and keep every byte, nor do others
    repeat them. Texts are taken in blocks, whatever their length. Other columns are ignored; no rows
    give no rows.
    """
    rows, spark = id_and_text(docs, id_col, text_col), docs.sparkSession
    n = partitions(spark)
    dealt = rows.mapInArrow(partial(_deal, parts=8 * n), "part int, anchors binary, marks binary, names binary, ids binary, starts binary, counts binary")
    met = dealt.repartition(n, "part").sortWithinPartitions("part").mapInArrow(_meet, "kind int, anchor long, doc_id long, start long, n long")
    met = stash(met, "segments")
    wanted = met.where("kind > 0").groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_list(F.struct("kind", "anchor", "start", "n")).alias("wanted"))
    # Both joins are left ones, so that they read one and the same shuffle of the texts.
    texts = rows.join(wanted, rows["doc_id"] == wanted["_doc"], "left").select("doc_id", "text", "wanted")
    fetched = texts.mapInArrow(_fetch, "anchor long, doc_id long, start long, data binary")
    fetched = fetched.repartition(n, "anchor").sortWithinPartitions("anchor")
    runs = fetched.mapInArrow(_sort, "kind int, anchor long, doc_id long, start long, n long")
    runs = met.where("kind = 0").unionByName(runs).groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    out = rows.join(runs, rows["doc_id"] == runs["_doc"], "left").select("doc_id", "text", "runs")
    return out.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<bigint>>")
