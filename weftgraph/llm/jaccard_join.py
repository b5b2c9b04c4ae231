"""N-gram Jaccard join in the metric space of shingle sets.

Distance is 1 - |A n B| / |A u B| over a text's 5-word shingles; documents link within RADIUS (0.25).
The space is divided again and again, each time around other pivots:

Voronoi regions. Pivots are documents of a sample, no two of them within APART. Every document's
distance to each pivot is computed exactly, and it is assigned to the nearest one, if that is within
CORE (0.5). Whatever links with such a core x of pivot p has a distance to p of at most CORE +
RADIUS, and of at most RADIUS * 2 more than to its own nearest pivot (the triangle inequality), so
all documents in that window are replicated to p's region. What is in no core goes to the region of
the empty set, too, which has the distance 1 to all. So of two documents that link both are in the
region of one of them, or both are in the empty set's. Those within RADIUS of a pivot link with it,
and so with each other: the dense part of the space, such as a third of all rows being near copies
of one document, is joined by that.

Regions within regions. Within a region the sets of a single shingle are the next pivots. Documents
that link share the fewer of 0.75 of their shingles, so of these, put in one order (that of hashes,
with what most documents have at the end), they share one among the first n - ceil(0.75 n) + 1. Each
of these opens a region within the region for its documents, for sets of every size. One whose
documents are all linked with one pivot is done. The size of a set bounds distances (the triangle
inequality with the empty set), so a region is cut into windows of sizes, which overlap. Keys travel
as packed arrays, one row for each batch of documents and target part.

Joins. In a window the document that meets most others is the last pivot, and every other one's
distance to it is computed exactly from the whole sets. Those within RADIUS are linked; no pairs among
them are needed. What the pivot does not reach, and no chain of such links either, is joined in
blocks: the documents far from a pivot against all of its regions' documents, of which the triangle
inequality excludes those whose distance to the pivot differs by more than RADIUS. A block gives one
link for each document and component. Components follow from the links by label propagation.

The order of shingles and the choice of pivots decide the cost only, never the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import discard, give_back, id_and_text, partitions, stash

#: Words of a shingle; linked are sets with 100 * common >= PERCENT * union.
WORDS, PERCENT = 5, 75
RADIUS = 1 - PERCENT / 100

#: Documents that are drawn as pivots, about, and their shingles at most; the distance that pivots keep
#: from each other; that of a core from its pivot.
PIVOTS, PIVOT_SIZE, APART, CORE = 512, 2048, 0.75, 0.5
_EPS = 1e-9

#: Documents of a batch that a shingle is in to be counted, documents in all that make it frequent,
#: and how many of the most frequent ones are put last at most. Only the cost depends on these.
COUNTED, FREQUENT, LAST = 2, 8, 100_000

#: Documents compared with a pivot in one group of rows.
SPREAD = 512

#: Entries (40 bytes) that say which document goes to which group, and ids of documents, up to
#: which they are broadcast; the texts then stay where they are, or only those wanted move.
BROADCAST_ENTRIES, BROADCAST_IDS = 500_000, 1_000_000

_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)

#: Bytes of a text that are hashed at a time, and keys that are packed at a time, about.
BLOCK, KEYS = 1 << 20, 1 << 19

#: A pair is compared by 32 bits of each shingle below this first, a quarter of all, and wholly if it can still link.
PART = np.uint64(1 << 62)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _Q
    return x ^ (x >> np.uint64(29))


@cache
def _bytes() -> tuple[np.ndarray, np.ndarray]:
    """Random numbers of bytes, ASCII letters of either case alike, and which bytes are white space."""
    value = np.random.default_rng(10).integers(0, 1 << 64, 256, np.uint64)
    value[65:91] = value[97:123]
    return value, np.isin(np.arange(256), [32, *range(9, 14)])


def _words(text: str) -> np.ndarray:
    """A hash of each word of a text: its bytes' numbers, each times a number of its place in the word."""
    value, white = _bytes()
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    out, at = [np.zeros(0, np.uint64)], 0
    while at < len(raw):
        end = at + BLOCK  # up to the last white space of the block, or the first one behind it
        while end < len(raw) and not (gaps := np.flatnonzero(white[raw[at:end]])).size:
            end += BLOCK
        end = len(raw) if end >= len(raw) else at + int(gaps[-1]) + 1
        part = raw[at:end]
        at = end
        solid = np.flatnonzero(~white[part])
        if len(solid):
            starts = np.flatnonzero(np.concatenate([[True], np.diff(solid) > 1]))
            sizes = np.diff(np.append(starts, len(solid)))
            place = np.arange(len(solid)) - np.repeat(starts, sizes)
            sums = np.add.reduceat(value[part[solid]] * (_mix(place.astype(np.uint64) * _P + _Q) | np.uint64(1)), starts)
            out.append(_mix(sums * _P + sizes.astype(np.uint64)))
    return np.concatenate(out)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    h = _words(text)
    if not len(h):
        return h
    n = max(1, len(h) - words + 1)
    out = np.full(n, min(words, len(h)), np.uint64)
    for i in range(min(words, len(h))):
        out = (out * _P) + h[i : i + n]
    out = np.sort(_mix(out))
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


class Lookup:
    """Where hashes are in a sorted array of some; a table of their low bits spares most searches."""

    def __init__(self, names: np.ndarray):
        self.names, self.mask = names, np.uint64((1 << 22) - 1)
        self.table = np.zeros(1 << 22, bool)
        self.table[names & self.mask] = True

    def find(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places in found of those that are there, and their places in names."""
        maybe = np.flatnonzero(self.table[found & self.mask])
        at = np.searchsorted(self.names, found[maybe])
        at = np.minimum(at, max(0, len(self.names) - 1))
        held = self.names[at] == found[maybe] if len(self.names) else np.zeros(0, bool)
        return maybe[held], at[held]


def keys_of(found: np.ndarray, last: Lookup) -> np.ndarray:
    """The shingles that open regions for a set; last are the sorted frequent ones."""
    n = len(found)
    frequent = np.zeros(n, bool)
    frequent[last.find(found)[0]] = True
    ordered = np.concatenate([found[~frequent], found[frequent]])
    return ordered[: n + 1 - -(-n * PERCENT // 100)]


class Pivots:
    """Documents (id, set) of which no two are within APART, the earlier ones first, and their index."""

    def __init__(self, drawn: list[tuple[int, np.ndarray]]):
        flat = np.concatenate([np.zeros(0, np.uint64), *(x for _, x in drawn)])
        row = np.repeat(np.arange(len(drawn)), np.array([len(x) for _, x in drawn], np.int64))
        names, at, held = np.unique(flat, return_inverse=True, return_counts=True)
        common = np.zeros((len(drawn), len(drawn)), np.float32)
        shared = np.flatnonzero(held > 1)
        place = np.full(len(names), -1)
        place[shared] = np.arange(len(shared))
        at = place[at]
        for begin in range(0, len(shared), 8192):
            pick = (at >= begin) & (at < begin + 8192)
            block = np.zeros((len(drawn), 8192), np.float32)
            block[row[pick], at[pick] - begin] = 1
            common += block @ block.T  # whole numbers below 2 ** 24: exact
        n = np.array([len(x) for _, x in drawn], np.float32)
        kept: list[int] = []
        for k in range(len(drawn)):
            if not kept or (1 - common[k, kept] / (n[k] + n[kept] - common[k, kept])).min() >= APART:
                kept.append(k)
        self.ids = np.array([drawn[k][0] for k in kept], np.int64)
        self.sizes = np.array([len(drawn[k][1]) for k in kept], np.int64)
        owner = np.repeat(np.arange(len(kept)), self.sizes)
        flat = np.concatenate([np.zeros(0, np.uint64), *(drawn[k][1] for k in kept)])
        order = np.argsort(flat, kind="stable")
        names, begin = np.unique(flat[order], return_index=True)
        self.lookup, self.begin, self.owner = Lookup(names), np.append(begin, len(flat)), owner[order]

    def regions(self, found: np.ndarray) -> tuple[np.ndarray, int]:
        """Regions of a set, -1 being the empty set's, and the pivot it is linked with, or -1."""
        none = np.array([-1])
        at = self.lookup.find(found)[1]
        if not len(at):
            return none, -1
        owners = [self.owner[a:b] for a, b in zip(self.begin[at].tolist(), self.begin[at + 1].tolist(), strict=True)]
        common = np.bincount(np.concatenate(owners), minlength=len(self.ids))
        total = len(found) + self.sizes - common
        d = 1 - common / total
        nearest = int(d.argmin())
        linked = 100 * common[nearest] >= PERCENT * total[nearest]
        window = np.flatnonzero((d <= CORE + RADIUS + _EPS) & (d <= d[nearest] + 2 * RADIUS + _EPS))
        core = d[nearest] <= CORE
        return window if core else np.append(window, -1), nearest if linked else -1


def _survey(rows: DataFrame) -> tuple[Lookup, Pivots]:
    """The sorted shingles that most of all documents have, and the pivots; one pass over the texts."""
    below = int(min(1.0, PIVOTS / max(1, rows.count())) * (1 << 63))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shingle", pa.int64()), ("n", pa.int64()), ("found", pa.binary())])
        for batch in batches:
            sets = [(doc, shingles(t.as_py())) for doc, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)]
            flat = np.concatenate([x for _, x in sets])
            flat.sort()
            begin = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
            counts = np.diff(np.append(begin, len(flat)))
            many = counts >= COUNTED
            cells = [flat[begin[many]].view(np.int64), counts[many].astype(np.int64), np.full(many.sum(), None, object)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, schema, strict=True)], schema=schema)
            drawn = [(doc, None, x.tobytes()) for doc, x in sets if doc is not None and 0 < len(x) <= PIVOT_SIZE and _draw(doc) < below]
            if drawn:
                yield _batch(drawn, schema)
        give_back()

    seen = stash(rows.mapInArrow(run, "shingle long, n long, found binary"), "survey")
    counts = seen.where("found IS NULL").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    top = counts.orderBy(F.desc("n"), "shingle").limit(LAST).select("shingle").toArrow().column(0).to_numpy()
    drawn = seen.where("found IS NOT NULL").dropDuplicates(["shingle"]).orderBy("shingle").limit(2 * PIVOTS).collect()  # about PIVOTS
    drawn = sorted(drawn, key=lambda r: _draw(r["shingle"]))
    discard(seen)
    out = Lookup(np.sort(top.astype(np.int64).view(np.uint64))), Pivots([(r["shingle"], np.frombuffer(r["found"], np.uint64)) for r in drawn])
    give_back()
    return out


def _draw(doc: int) -> int:
    return xxhash.xxh3_64_intdigest(doc.to_bytes(8, "little", signed=True)) >> 1


def _deal(batches: Iterator[pa.RecordBatch], parts: int, shared) -> Iterator[pa.RecordBatch]:
    """Keys of each batch as one row per part; of each document its size, its equal and its pivot, in a part of its own kind."""
    last, pivots = shared.value
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("same", pa.int64()), ("near", pa.int64()),
                        ("keys", pa.binary()), ("ids", pa.binary()), ("sizes", pa.binary()), ("labels", pa.binary())])

    def packed(*columns: list[np.ndarray]) -> pa.RecordBatch:
        flat = [np.concatenate(x) for x in columns]
        part = (flat[0] % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        found, begin = np.unique(part[order], return_index=True)
        cuts = list(zip(begin, [*begin[1:], len(part)], strict=True))
        cells = [[x[a:b].tobytes() for a, b in cuts] for x in (x[order] for x in flat)]
        none = [None] * len(found)
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((found, none, none, none, none, *cells), schema, strict=True)], schema=schema)

    for batch in batches:
        ids = batch.column(0).to_pylist()
        sizes, same, near, first = [], [], [], {}
        keys, owners, counts, labels, waiting = [], [], [], [], 0
        for doc, text in zip(ids, batch.column(1), strict=True):
            found = shingles(text.as_py())
            sizes.append(len(found))
            same.append(None)
            near.append(None)
            if doc is None or not len(found):
                continue
            mark = xxhash.xxh3_128_digest(found.tobytes())
            head = first.setdefault(mark, doc)
            same[-1] = head
            if len(same) and head != doc:
                continue
            regions, pivot = pivots.regions(found)
            if pivot >= 0:
                near[-1] = int(pivots.ids[pivot])
            k = keys_of(found, last)
            for region in regions:
                keys.append(_mix((k ^ np.uint64(region + 1)) * _P))
                owners.append(np.full(len(k), doc, np.int64))
                counts.append(np.full(len(k), len(found), np.int32))
                labels.append(np.full(len(k), pivot, np.int32))
                waiting += len(k)
            if waiting > KEYS:
                yield packed(keys, owners, counts, labels)
                keys, owners, counts, labels, waiting = [], [], [], [], 0
        none = [None] * len(ids)
        cells = ([-1 - (doc or 0) % parts for doc in ids], ids, sizes, same, near, none, none, none, none)
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cells, schema, strict=True)], schema=schema)
        if keys:
            yield packed(keys, owners, counts, labels)
    give_back()


_FOUND = pa.schema([("region", pa.int64()), ("doc_id", pa.int64()), ("members", pa.int64()), ("n", pa.int64()), ("same", pa.int64()), ("near", pa.int64())])


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (without a region) as they came, and windows of all regions, once for equal windows of a part.

    Rows come sorted by part, and one part is in memory at a time.
    """
    part, cells = None, [[], [], [], []]
    for batch in batches:
        parts = batch.column(0).to_numpy()
        docs = batch.slice(0, int(np.searchsorted(parts, 0)))  # parts of documents are negative
        if len(docs):
            none = pa.nulls(len(docs), pa.int64())
            yield pa.RecordBatch.from_arrays([none, docs.column(1), none, docs.column(2), docs.column(3), docs.column(4)], schema=_FOUND)
        rest = batch.slice(len(docs))
        for at, *row in zip(*(rest.column(i).to_pylist() for i in (0, 5, 6, 7, 8)), strict=True):
            if at != part and cells[0]:
                yield from _windows(cells)
                cells = [[], [], [], []]
            part = at
            for into, x, kind in zip(cells, row, (np.uint64, np.int64, np.int32, np.int32), strict=True):
                into.append(np.frombuffer(x, kind))
    if cells[0]:
        yield from _windows(cells)
    give_back()


def _window_rows(out: list[list[np.ndarray]]) -> pa.RecordBatch:
    region, docs, members = (pa.array(np.concatenate(x)) for x in out)
    none = pa.nulls(len(region), pa.int64())
    return pa.RecordBatch.from_arrays([region, docs, members, none, none, none], schema=_FOUND)


def _windows(cells: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    keys, ids, sizes, labels = (np.concatenate(x) for x in cells)
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    order = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]  # most keys have one document
    order = order[np.lexsort((ids[order], sizes[order], keys[order]))]
    keys, ids, sizes, labels = keys[order], ids[order], sizes[order], labels[order]
    if not len(keys):
        return
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    end = np.append(begin[1:], len(keys))
    # Done are regions whose documents are all linked with one pivot; of equal ones one is enough.
    low = np.minimum.reduceat(labels, begin)
    open_ = np.flatnonzero((low < 0) | (low != np.maximum.reduceat(labels, begin)))
    marks = np.add.reduceat(_mix(ids.view(np.uint64) * _P + _Q), begin) + (end - begin).astype(np.uint64) * _Q
    open_ = open_[np.unique(marks[open_], return_index=True)[1]]
    out: list[list[np.ndarray]] = [[], [], []]
    rows = 0
    for a, b in zip(begin[open_], end[open_], strict=True):
        docs, n = ids[a:b], sizes[a:b]
        at = 0
        while at < len(docs):
            # The window's own sizes reach to `stop`; those from `low` on may link into it.
            stop = int(np.searchsorted(n, n[at] * 100 // PERCENT, "right"))
            least = int(np.searchsorted(n, -(-int(n[at]) * PERCENT // 100), "left"))
            inside = np.unique(docs[least:stop])
            if len(inside) > 1:
                region = xxhash.xxh3_64_intdigest(inside.tobytes()) >> 1
                out[0].append(np.full(len(inside), region, np.int64))
                out[1].append(inside)
                out[2].append(np.full(len(inside), len(inside), np.int64))
                rows += len(inside)
            at = stop
        if rows > 100_000:
            yield _window_rows(out)
            out, rows = [[], [], []], 0
    if rows:
        yield _window_rows(out)


def _sent(found: np.ndarray, whole: bool) -> np.ndarray:
    """A set, or 32 bits of each of its shingles below PART."""
    return found if whole else np.unique((found[: np.searchsorted(found, PART)] >> np.uint64(30)).astype(np.uint32))


def _sets(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """The set of each document, or a part of it, once for each group of comparisons that it is wanted in.

    rest is how many of its n shingles cannot be told from what is sent.
    """
    schema = pa.schema([("pivot", pa.int64()), ("salt", pa.int32()), ("doc_id", pa.int64()), ("first", pa.bool_()), ("label", pa.int64()),
                        ("lo", pa.float64()), ("hi", pa.float64()), ("n", pa.int64()), ("rest", pa.int64()), ("found", pa.binary())])
    for batch in batches:
        rows: list[tuple] = []
        size = 0
        for doc, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            found = shingles(text.as_py())
            sent = _sent(found, whole)
            data = sent.tobytes()
            for w in wanted:
                rows.append((w["pivot"], w["salt"], doc, w["first"], w["label"], w["lo"], w["hi"], len(found), len(found) - len(sent), data))
                size += len(data) + 100
                if size > 1 << 22:
                    yield _batch(rows, schema)
                    rows, size = [], 0
        if rows:
            yield _batch(rows, schema)
    give_back()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _compare(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """Sorted rows of groups, pivots first: of each pair the most that it can have in common, and both sizes.

    That is what is common of the parts sent, and as many others as the set with fewer of these has.
    """
    schema = pa.schema([("pivot", pa.int64()), ("doc_id", pa.int64()), ("most", pa.int64()), ("sizes", pa.int64())])
    group, pivots = None, []
    for batch in batches:
        rows = []
        for pivot, salt, doc, is_pivot, _, _, _, n, rest, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if group != (pivot, salt):
                group, pivots = (pivot, salt), []
            found = np.frombuffer(found, np.uint64 if whole else np.uint32)
            if is_pivot:
                pivots.append((n, rest, found))
                continue
            for m, other, p in pivots:
                common = len(np.intersect1d(p, found, assume_unique=True))
                rows.append((pivot, doc, common + min(other, rest), n + m))
        if rows:
            yield _batch(rows, schema)


def _near(far: list[tuple], others: list[tuple]) -> np.ndarray:
    """Which of those far from a pivot (rows) can link with which of the others (columns), of other components.

    Both are (doc_id, label, lo, hi, n, rest, set), lo and hi bounding the distance to the pivot.
    """
    universe = np.unique(np.concatenate([x[6] for x in far]))
    common = np.zeros((len(far), len(others)), np.float32)

    def places(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        flat = np.concatenate([x[6] for x in rows])
        row = np.repeat(np.arange(len(rows)), [len(x[6]) for x in rows])
        at = np.minimum(np.searchsorted(universe, flat), max(0, len(universe) - 1))
        held = universe[at] == flat if len(universe) else np.zeros(0, bool)
        return row[held], at[held]

    (fr, fc), (gr, gc) = places(far), places(others)
    for begin in range(0, len(universe), 8192):
        a = np.zeros((len(far), 8192), np.float32)
        b = np.zeros((len(others), 8192), np.float32)
        pick = (fc >= begin) & (fc < begin + 8192)
        a[fr[pick], fc[pick] - begin] = 1
        pick = (gc >= begin) & (gc < begin + 8192)
        b[gr[pick], gc[pick] - begin] = 1
        common += a @ b.T  # whole numbers below 2 ** 24: exact
    column = lambda rows, k: np.array([x[k] for x in rows])
    most = common.astype(np.float64) + np.minimum(column(far, 5)[:, None], column(others, 5)[None, :])
    near = 100 * most >= PERCENT * (column(far, 4)[:, None] + column(others, 4)[None, :] - most)
    near &= np.maximum(column(far, 2)[:, None] - column(others, 3)[None, :], column(others, 2)[None, :] - column(far, 3)[:, None]) <= RADIUS + _EPS
    return near & (column(far, 1)[:, None] != column(others, 1)[None, :])


def _linked(far: list[tuple], others: list[tuple], whole: bool) -> Iterator[tuple[int, int]]:
    """Links of one block, of those of a document with one component one; of parts of sets, the documents that may have any."""
    near = _near(far, others)
    if not whole:
        for rows, any_ in ((far, near.any(axis=1)), (others, near.any(axis=0))):
            yield from ((rows[i][0], rows[i][0]) for i in np.flatnonzero(any_))
        return
    labels = np.array([x[1] for x in others])
    for i, x in enumerate(far):
        hits = np.flatnonzero(near[i])
        for j in hits[np.unique(labels[hits], return_index=True)[1]]:
            yield x[0], others[j][0]


def _blocks(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of sorted rows of blocks, those far from the pivot first, with the pivot."""
    schema = pa.schema([("pivot", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
    block, far, others = None, [], []
    for batch in batches:
        out: list[tuple] = []
        for pivot, salt, doc, first, label, lo, hi, n, rest, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if block != (pivot, salt):
                if far and others:
                    out += [(block[0], *x) for x in _linked(far, others, whole)]
                block, far, others = (pivot, salt), [], []
            (far if first else others).append((doc, label, lo, hi, n, rest, np.frombuffer(found, np.uint64 if whole else np.uint32)))
        if out:
            yield _batch(out, schema)
    if far and others and (out := [(block[0], *x) for x in _linked(far, others, whole)]):
        yield _batch(out, schema)


_GROUPS = "pivot long, salt int, doc_id long, first boolean, label long, lo double, hi double, n long, rest long, found binary"


def _grouped_sets(rows: DataFrame, wanted: DataFrame, whole: bool = True) -> DataFrame:
    """Sets of documents by group (pivot, salt), sorted, from the whole texts.

    wanted has doc_id, pivot, salt, first, label, lo, hi: the groups that a document goes to.
    """
    lists = wanted.groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_list(F.struct("pivot", "salt", "first", "label", "lo", "hi")).alias("wanted"))
    lists = stash(lists, "wanted")
    ids, entries = lists.agg(F.count("*"), F.sum(F.size("wanted"))).first()
    if (entries or 0) <= BROADCAST_ENTRIES:  # then no text is shuffled
        lists = F.broadcast(lists)
    elif ids <= BROADCAST_IDS:  # then no other text is shuffled; beyond that all are
        rows = rows.join(F.broadcast(lists.select("_doc")), rows["doc_id"] == F.col("_doc"), "left_semi")
    sets = rows.join(lists, rows["doc_id"] == lists["_doc"]).select("doc_id", "text", "wanted").mapInArrow(partial(_sets, whole=whole), _GROUPS)
    return sets.repartition(partitions(rows.sparkSession), "pivot", "salt").sortWithinPartitions("pivot", "salt", F.desc("first"))


def _compared(rows: DataFrame, pairs: DataFrame, whole: bool) -> DataFrame:
    """pivot, doc_id, lo, hi (bounds of the distance) and may (whether the pair can link) of pairs of a pivot and a document.

    A pivot's documents are spread over groups of about SPREAD, each of which gets its set.
    """
    # Written first: then a join with it can be split where a pivot has very many documents.
    spread = stash(pairs.groupBy("pivot").agg(F.ceil(F.count("*") / SPREAD).cast("int").alias("salts")), "spread")
    extra = [F.lit(0).cast("long").alias("label"), F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi")]
    members = pairs.join(spread, "pivot").select("doc_id", "pivot", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int").alias("salt"), F.lit(False).alias("first"), *extra)
    pivots = spread.select(F.col("pivot").alias("doc_id"), "pivot", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(True).alias("first"), *extra)
    out = _grouped_sets(rows, members.unionByName(pivots), whole).mapInArrow(partial(_compare, whole=whole), "pivot long, doc_id long, most long, sizes long")
    lo = F.min(1 - F.col("most") / (F.col("sizes") - F.col("most")))
    may = F.max(100 * F.col("most") >= PERCENT * (F.col("sizes") - F.col("most")))
    return out.groupBy("pivot", "doc_id").agg(lo.alias("lo"), (lo if whole else F.lit(1.0)).alias("hi"), may.alias("may"))


def _distances(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """pivot, doc_id, lo, hi (bounds of the distance, equal where it was worth knowing) and linked of each pair.

    All pairs are compared by a quarter of their shingles, and those that can link by all of them.
    """
    some = stash(_compared(rows, pairs, False), "bounds")
    sure = stash(_compared(rows, some.where("may").select("pivot", "doc_id"), True), "distances")
    rest = some.where("NOT may").select("pivot", "doc_id", "lo", "hi", F.lit(False).alias("linked"))
    return rest.unionByName(sure.select("pivot", "doc_id", "lo", "hi", F.col("may").alias("linked")))


def _cross_links(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Links of documents far from their pivot with others of their regions.

    known has pivot, doc_id, label, lo, hi and own, the pivot's label. Far documents and others are cut
    into blocks of about SPREAD, and each two blocks of a pivot meet once by parts of their sets; those
    that may have a link meet again by their whole sets.
    """
    known = stash(known.select("pivot", "doc_id", "label", "lo", "hi", "own").distinct(), "known")
    may = stash(_met(rows, known, False).select("pivot", F.col("a").alias("doc_id")).distinct(), "may")
    return stash(_met(rows, known.join(may, ["pivot", "doc_id"], "left_semi"), True).select("a", "b"), "cross")


def _met(rows: DataFrame, known: DataFrame, whole: bool) -> DataFrame:
    """_blocks() of what is known of pivots and their documents."""
    far = known.where("label != own AND pivot != doc_id")
    others = known.where("pivot != doc_id").join(far.select("pivot").distinct(), "pivot", "left_semi")
    size = lambda t, n: t.groupBy("pivot").agg(F.ceil(F.count("*") / SPREAD).cast("int").alias(n))
    sizes = stash(size(far, "f").join(size(others, "m"), "pivot"), "sizes")
    block = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = far.join(sizes, "pivot").withColumn("i", block("f")).withColumn("j", every("m")).withColumn("first", F.lit(True))
    b = others.join(sizes, "pivot").withColumn("j", block("m")).withColumn("i", every("f")).withColumn("first", F.lit(False))
    wanted = a.unionByName(b).select("doc_id", "pivot", (F.col("i") * F.col("m") + F.col("j")).alias("salt"), "first", "label", "lo", "hi")
    return _grouped_sets(rows, wanted, whole).mapInArrow(partial(_blocks, whole=whole), "pivot long, a long, b long")


def components(links: DataFrame) -> DataFrame:
    """id and label, the smallest id reachable, of every id in links (a, b)."""
    edges = links.select("a", "b").where("a != b")
    edges = stash(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = last = stash(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        hooked = stash(labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label")), "hooked")
        up = hooked.select(F.col("id").alias("label"), F.col("label").alias("up"))
        new = hooked.join(up, "label", "left").select("id", "old", F.least("label", F.coalesce("up", "label")).alias("label"))
        new = stash(new, "labels")
        discard(hooked, last)
        last, labels = new, new.select("id", "label")
        if not new.where("label != old").limit(1).count():
            discard(edges)
            return labels


def link(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """sizes (doc_id, n) of all rows (doc_id, text), and links (a, b) that join all components."""
    spark: SparkSession = rows.sparkSession
    shared = spark.sparkContext.broadcast(_survey(rows))
    parts = 4 * partitions(spark)
    dealt = rows.mapInArrow(partial(_deal, parts=parts, shared=shared), "part int, doc_id long, n long, same long, near long, keys binary, ids binary, sizes binary, labels binary")
    dealt = dealt.repartition(partitions(spark), "part").sortWithinPartitions("part")
    met = stash(dealt.mapInArrow(_regions, "region long, doc_id long, members long, n long, same long, near long"), "met")
    sizes = met.where("region IS NULL").select("doc_id", "n", "same", "near")
    regions = met.where("region IS NOT NULL").select("region", "doc_id", "members").dropDuplicates(["region", "doc_id"])
    regions = stash(regions, "regions")
    # The pivot of a region is the document that meets most others: an original rather than a copy.
    rank = regions.groupBy("doc_id").agg(F.sum("members").alias("met"))
    rank = regions.join(rank, "doc_id").groupBy("region").agg(F.max(F.struct("met", (-F.col("doc_id")).alias("back"))).alias("top"))
    rank = stash(rank.select("region", (-F.col("top.back")).alias("pivot")), "rank")  # as above, for regions of very many
    regions = stash(regions.join(rank, "region").select("region", "pivot", "doc_id"), "pivots")
    near = _distances(rows, stash(regions.where("pivot != doc_id").select("pivot", "doc_id").distinct(), "pairs"))
    found = sizes.where("same IS NOT NULL").select(F.col("doc_id").alias("a"), F.col("same").alias("b"))
    found = found.unionByName(sizes.where("near IS NOT NULL").select(F.col("near").alias("a"), F.col("doc_id").alias("b")))
    found = found.unionByName(near.where("linked").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")))
    # A document that its region's pivot did not reach, not by way of others either, is compared
    # with those of the region that are of other components yet.
    labels = components(found)
    known = regions.join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    known = known.select("region", "pivot", "doc_id", F.coalesce("label", "doc_id").alias("label"))
    d = near.select("pivot", "doc_id", "lo", "hi").unionByName(near.select("pivot", F.col("pivot").alias("doc_id"), F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi")).distinct())
    known = known.join(d, ["pivot", "doc_id"])
    mixed = stash(known.groupBy("region").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("region"), "mixed")
    known = known.join(mixed, "region", "left_semi")
    head = labels.select(F.col("id").alias("pivot"), F.col("label").alias("own"))
    known = known.join(head, "pivot", "left").withColumn("own", F.coalesce("own", "pivot"))
    return sizes.select("doc_id", "n"), found.unionByName(_cross_links(rows, known))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    component_id is the smallest doc_id reachable by links. Texts without words (null, empty,
    white space) have no shingles and link with nothing. Rows of one doc_id are one node; a row
    without doc_id links with nothing and has no component. Texts are taken whole, whatever their
    length. Other columns are ignored; no rows give no rows.
    """
    sizes, links = link(id_and_text(docs, id_col, text_col))
    labels = components(links)
    out = sizes.join(labels, sizes["doc_id"] == labels["id"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, that of the smallest doc_id; columns as they were.

    Of several rows of one doc_id one stays, chosen by a hash of all that it holds. Rows without
    doc_id, and those whose text is null or without words, link with nothing and stay.
    """
    _, links = link(id_and_text(docs))
    rest = components(links).where("id != label").select(F.col("id").alias("_other"))
    rest = stash(rest, "others")
    kept = docs.join(rest, docs["doc_id"].cast("long") == F.col("_other"), "left_anti")
    again = docs.groupBy(F.col("doc_id").alias("_again")).count().where("count > 1 AND _again IS NOT NULL").select("_again")
    again = stash(again, "again")
    if not again.limit(1).count():
        return kept
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    several = kept.join(again, kept["doc_id"] == F.col("_again"), "left_semi").groupBy("doc_id").agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("_row"))
    return kept.join(again, kept["doc_id"] == F.col("_again"), "left_anti").unionByName(several.select("_row.*"))
