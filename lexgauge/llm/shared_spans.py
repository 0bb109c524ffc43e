"""Removal of byte strings that stand in an earlier document too, found with run-length indexes.

A corpus as one index would pass through one machine.  Documents are cut at anchors instead,
so that any two equal strings of ``length`` bytes meet in one bucket and each bucket has its
own index:

1. Equal texts become one unit, held by their smallest id; later holders go whole.
2. In each window of ``length`` bytes the 24 bytes of the smallest hash are its anchor.  Equal
   windows have equal anchors at the same place.  Only hashes of anchors are shuffled to find
   those of two units; an anchor that recurs within a task's slice is known to, and its
   hash is sent once.
3. The surroundings of recurring anchors (26 bytes on either side) are shuffled by anchor.
   Equal surroundings are held once, by the smallest id; in the others all is marked.
4. What differs within an anchor's group falls into families that share the bytes next to the
   anchor, on its left for one half of the windows and on its right for the other, and is
   ranked by id.  For each bit of the ranks, from the highest, strings whose bit is 0 are
   indexed, and those with the bit set and the same higher bits are streamed against the
   index, so that each sees all of smaller ids and none else.  A code of the family and the
   higher bits stands in the anchor's place; a match as long as the window holds it, so strings
   of other families never match.  Strings of which all windows are marked are neither indexed nor
   streamed: an earlier string has them.
5. Marks go back to their units, runs are merged and bytes cut out.

A bucket beyond ``bucket_bytes`` (an anchor with a large share of all surroundings) is resolved
by its windows instead: each window's digest gets its smallest id by an aggregation that
combines before the shuffle, and a join that AQE may split.
"""

from __future__ import annotations

from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, drop_path, lean, lean_table, new_path, scratch, slices, whole_text
from .run_index import RunIndex

K = 24  # bytes of an anchor
CODE = 3  # symbols that stand for it
CHUNK = 1 << 18
SLICE = 4 << 20  # bytes of text whose anchors are found at once
PART = 16 << 20  # bytes of text whose messages are packed at once
MANY = 256  # parts from which on they grow
PIECE = 1 << 16  # surroundings with one index
MASK = np.uint64((1 << 24) - 1)
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def bucket_of(h: np.ndarray, parts: int) -> np.ndarray:
    """The bucket of anchors: hashes are mixed again, as those of anchors are the smallest of many and most have the same leading bits."""
    return (_mix(h) >> np.uint64(65 - parts.bit_length())).astype(np.int64)


def anchors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of documents laid end to end: the leftmost smallest hash of each window that lies in one document."""
    n, span = len(data), length - K + 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    ok = np.ones(n, bool)
    ok[np.maximum(ends[:, None] - np.arange(1, length), 0).ravel()] = False
    out_p, out_h = [], []
    for at in range(0, n - length + 1, CHUNK):
        x = data[at : at + CHUNK + length].astype(np.uint64)
        a = x[:-1] | (x[1:] << np.uint64(8))
        a = a[:-2] | (a[2:] << np.uint64(16))
        a = a[:-4] | (a[4:] << np.uint64(32))
        m = len(x) - K + 1
        h = a[:m] * np.uint64(0x9E3779B97F4A7C15)
        for o in range(8, K, 8):
            h = _mix(h + a[o : o + m])
        low = (h & ~MASK) | np.arange(m, dtype=np.uint64)
        width = 1
        while width * 2 <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < span:
            low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
        here = min(len(low), CHUNK, n - at)
        p = (low[:here][ok[at : at + here]] & MASK).astype(np.int64)
        p = p[_starts(p)]  # windows move to the right, and so do their anchors
        out_p.append(p + at)
        out_h.append(h[p])
    p, h = np.concatenate(out_p), np.concatenate(out_h)
    p, first = np.unique(p, return_index=True)  # the last windows of a chunk and the first of the next may share one
    return p, h[first]


def _starts(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    if not len(sorted_keys[0]):
        return np.zeros(0, np.int64)
    new = reduce(np.logical_or, [k[1:] != k[:-1] for k in sorted_keys])
    return np.flatnonzero(np.concatenate([[True], new]))


def _blobs(arrays: list[np.ndarray], by: np.ndarray):
    """Cut arrays that are sorted by ``by`` into (its value, bytes of each array's part)."""
    at = _starts(by)
    for a, b in zip(at, np.append(at[1:], len(by))):
        yield by[a], [x[a:b].tobytes() for x in arrays]


def _slice_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a slice's texts, and where each ends."""
    offsets = np.concatenate([[0], np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return np.frombuffer(b"".join(column.cast(pa.binary()).to_pylist()), np.uint8), offsets[1:]


ROW = (1 << 33) - 1  # of a unit's number: its row in a partition, below the partition's number


def _part(unit: np.ndarray, parts: int) -> np.ndarray:
    return ((unit & ROW) + (unit >> 33) * 7919) % parts


def part_of(unit: Column, parts: int) -> Column:
    """The part that a unit belongs to; messages to units are packed by part, as many rows as there are parts at most."""
    return F.pmod(unit.bitwiseAND(F.lit(ROW)) + F.shiftright(unit, 33) * 7919, F.lit(parts)).cast("int")


def _packed(unit: np.ndarray, values: np.ndarray, parts: int):
    """(part, bytes of units, bytes of values): one row a part."""
    part = _part(unit, parts)
    order = np.lexsort((unit, part))
    return [(int(b), *x) for b, x in _blobs([unit[order], values[order]], part[order])]


def _to_table(rows: list[tuple], value: str) -> pa.Table:
    """Rows of ``_packed``."""
    return pa.table({"part": pa.array([r[0] for r in rows], pa.int32()), "units": pa.array([r[1] for r in rows], pa.binary()), value: pa.array([r[2] for r in rows], pa.binary())})


ANCHORS = "bucket int, part int, units binary, keys binary"
_ANCHOR_FIELDS = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("units", pa.binary()), ("keys", pa.binary())])


def _find_anchors(length: int, parts: int, held_bytes: int = PART):
    """Hashes of anchors by bucket with their units, packed for ``held_bytes`` of text at once; those of two units there go straight back, and to their bucket once without a unit."""

    def packed(units: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(h, kind="stable")  # a unit's anchors come together, and so do its equal ones
        order = order[_starts(h[order], units[order])]
        at = _starts(h[order])
        sizes = np.diff(np.append(at, len(order)))
        many = sizes > 1
        again = order[np.repeat(many, sizes)]
        rows = [{"part": b, "units": u, "keys": keys} for b, u, keys in _packed(units[again], h[again], parts)]
        sent, shared = np.zeros((2, len(h)), bool)
        sent[order[at]], shared[order[at]] = True, many
        sent, whose = h[sent], np.where(shared, -1, units)[sent]  # runs of one owner compress
        bucket = bucket_of(sent, parts)
        o = np.argsort(bucket.astype(np.uint16) if parts <= 1 << 16 else bucket, kind="stable")
        rows += [{"bucket": int(b), "units": u, "keys": keys} for b, (u, keys) in _blobs([whose[o], sent[o]], bucket[o])]
        return pa.RecordBatch.from_pylist(rows, schema=_ANCHOR_FIELDS)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                data, ends = _slice_bytes(part.column(1))
                p, h = anchors(data, ends, length)
                owner = np.searchsorted(ends, p, side="right")
                held.append((part.column(0).to_numpy()[owner], h))
                size += len(data)
                if size >= held_bytes:
                    yield packed(*map(np.concatenate, zip(*held)))
                    held, size = [], 0
        if held:
            yield packed(*map(np.concatenate, zip(*held)))

    return lean(run)


def _joined(column: pa.ChunkedArray, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def _recurring(parts: int):
    """Of a bucket: the hashes that came from two slices or are known to recur, by part."""

    def run(table: pa.Table) -> pa.Table:
        h, unit = _joined(table["keys"], np.uint64), _joined(table["units"], np.int64)
        order = np.argsort(h, kind="stable")
        h, unit = h[order], unit[order]
        at = _starts(h)
        sizes = np.diff(np.append(at, len(h)))
        two = (sizes > 1) | (np.minimum.reduceat(unit, at) < 0) if len(at) else np.zeros(0, bool)
        take = np.repeat(two, sizes) & (unit >= 0)
        return _to_table(_packed(unit[take], h[take], parts), "keys")

    return lean_table(run)


PLACES = "bucket int, part int, n long, body binary, sides binary, keys binary, docs binary, units binary, at binary, spans binary"
_PLACE_FIELDS = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("n", pa.int64())] + [(c, pa.binary()) for c in ("body", "sides", "keys", "docs", "units", "at", "spans")])


def _distinct(key: np.ndarray, body: np.ndarray, sides: np.ndarray, doc: np.ndarray):
    """Order that brings equal surroundings together, smallest id first; which string each is; whether its id is that string's smallest."""
    r = np.random.default_rng(7).integers(1, 1 << 63, (2, body.shape[1] + 2), np.uint64) | np.uint64(1)
    whole = np.concatenate([body, sides], 1)
    a, b = np.zeros(len(key), np.uint64), np.zeros(len(key), np.uint64)
    for j in range(whole.shape[1]):
        x = whole[:, j].astype(np.uint64) + np.uint64(1)
        a += x * r[0, j]
        b = _mix(b + x * r[1, j])
    order = np.lexsort((doc, b, a, key))
    at = _starts(key[order], a[order], b[order])
    sizes = np.diff(np.append(at, len(key)))
    return order, np.repeat(np.arange(len(at)), sizes), doc[order] == np.repeat(doc[order][at], sizes), at


def _whole_spans(at, sides, length):
    """From the start to the end of surroundings that hold a window."""
    spans = np.stack([at - sides[:, 0], at + K + sides[:, 1]], 1).astype(np.int64)
    return spans, (spans[:, 1] - spans[:, 0]) >= length


def _pair(unit: np.ndarray, h: np.ndarray) -> np.ndarray:
    return h ^ _mix(unit.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _find_places(length: int, parts: int):
    """Surroundings of a part's asked anchors by bucket; those equal to a smaller id's in the part are marked at once."""
    side = length - K

    def places(part: pa.RecordBatch, asked: np.ndarray):
        units, docs = part.column(0).to_numpy(), part.column(1).to_numpy()
        data, ends = _slice_bytes(part.column(2))
        begins = np.concatenate([[0], ends[:-1]])
        p, h = anchors(data, ends, length)
        owner = np.searchsorted(ends, p, side="right")
        keep = np.isin(_pair(units[owner], h), asked)
        p, h, owner = p[keep], h[keep], owner[keep]
        sides = np.stack([np.minimum(p - begins[owner], side), np.minimum(ends[owner] - p - K, side)], 1).astype(np.uint8)
        column = np.arange(-side, K + side)
        body = data[np.clip(p[:, None] + column, 0, max(0, len(data) - 1))]
        body[(column < -sides[:, :1].astype(int)) | (column >= K + sides[:, 1:].astype(int))] = 0
        return body, sides, h, docs[owner], units[owner], (p - begins[owner]).astype(np.int32)

    def run(texts: pa.Table, asked: pa.Table) -> pa.Table:
        pairs = _pair(_joined(asked["units"], np.int64), _joined(asked["keys"], np.uint64))
        rows = []
        if len(pairs) and len(texts):
            found = [places(part, pairs) for batch in texts.select(["unit", "first_id", "text"]).to_batches() for part in slices(batch, 2, SLICE)]
            body, sides, h, docs, units, at = map(np.concatenate, zip(*found))
            del found
            order, _, first, _ = _distinct(h, body, sides, docs)
            spans, whole = _whole_spans(at[order].astype(np.int64), sides[order], length)
            done = ~first & whole
            rows = [{"part": b, "units": u, "spans": marks} for b, u, marks in _packed(units[order[done]], spans[done].astype(np.int32), parts)]
            order = order[first]
            bucket = bucket_of(h[order], parts)
            by = np.argsort(bucket, kind="stable")
            order = order[by]
            for b, x in _blobs([c[order] for c in (body, sides, h, docs, units, at)], bucket[by]):
                rows.append({"bucket": int(b), "n": len(x[2]) // 8} | dict(zip(("body", "sides", "keys", "docs", "units", "at"), x)))
        return pa.Table.from_pylist(rows, schema=_PLACE_FIELDS)

    return lean_table(run)


def _read_places(table, length):
    side = length - K
    body = _joined(table["body"], np.uint8).reshape(-1, K + 2 * side)
    sides = _joined(table["sides"], np.uint8).reshape(-1, 2)
    return body, sides, _joined(table["keys"], np.uint64), _joined(table["docs"], np.int64), _joined(table["units"], np.int64), _joined(table["at"], np.int32).astype(np.int64)


def _stream(text: np.ndarray, there: np.ndarray, code: np.ndarray, left: int, indexed: np.ndarray, asked: np.ndarray, window: int):
    """(asked string, symbols left of the code) of windows that the index of the other strings holds; ``left`` of a string's places lie left of the code."""

    def symbols(rows):
        digits = 257 + np.stack([code[rows] // 65025, code[rows] // 255 % 255, code[rows] % 255], 1)
        wide = np.concatenate([text[rows, :left].astype(np.int16) + 1, digits.astype(np.int16), text[rows, left:].astype(np.int16) + 1], 1)
        return wide, np.concatenate([there[rows, :left], np.ones((len(rows), CODE), bool), there[rows, left:]], 1)

    wide, held = symbols(indexed)
    wide = np.concatenate([wide, np.zeros((len(wide), 1), np.int16)], 1)
    index = RunIndex(wide[np.concatenate([held, np.ones((len(held), 1), bool)], 1)])

    sizes = there[asked].sum(1) + CODE
    order = np.argsort(-sizes, kind="stable")
    asked, sizes = asked[order], sizes[order]
    before = there[asked, :left].sum(1)
    wide, held = symbols(asked)
    pattern = np.full(wide.shape, -1, np.int16)  # aligned to the right
    pattern[np.arange(wide.shape[1]) >= wide.shape[1] - sizes[:, None]] = wide[held]
    for t, live, length in index.matching_statistics(pattern, sizes):
        hit = np.flatnonzero(length >= window)
        if len(hit):
            yield asked[hit], before[hit] - (sizes[hit] - 1 - t)


def _digests(cells: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers of 64 bits for each row of bytes and of further numbers."""
    r = np.random.default_rng(11).integers(1, 1 << 63, (2, cells.shape[1]), np.uint64) | np.uint64(1)
    a, b = np.zeros(len(cells), np.uint64), np.zeros(len(cells), np.uint64)
    for x in more:
        x = x.astype(np.uint64)
        a, b = _mix((a + x) * np.uint64(0x9E3779B97F4A7C15)), _mix((b ^ x) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1))
    for j in range(cells.shape[1]):
        x = cells[:, j].astype(np.uint64) + np.uint64(1)
        a += x * r[0, j]
        b = _mix(b + x * r[1, j])
    return a, b


def _dense_ranks(family: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Ranks from 0 within families, equal for equal ranks; both are sorted."""
    head = _starts(family)
    step = np.concatenate([[0], (family[1:] == family[:-1]) & (rank[1:] != rank[:-1])]).cumsum() if len(family) else np.zeros(0, np.int64)
    return step - np.repeat(step[head], np.diff(np.append(head, len(family))))


def _marked_windows(body: np.ndarray, sides: np.ndarray, group: np.ndarray, rank: np.ndarray, length: int) -> np.ndarray:
    """For each string and each number of bytes left of the anchor: does a string of its group and a smaller rank hold that window?

    A window with fewer than half its free bytes left of the anchor has all of the nearest bytes right of it, any
    other has those left of it.  So each half of the windows is sought in families of strings that share
    these bytes, and only in the bytes beyond them, which the half's windows can reach.
    """
    side = length - K
    marked = np.zeros((len(body), side + 1), bool)
    half = (side + 1) // 2
    places = np.arange(-side, K + side)
    for first, last, near in ((0, half - 1, slice(side + K, 2 * side + K - half + 1)), (half, side, slice(side - half, side))):
        begin, end = min(near.start, side), max(near.stop, side + K)
        far = np.r_[side - last : begin, end : 2 * side + K - first]
        left = begin - (side - last)
        low, high = np.maximum(first, side - sides[:, 1].astype(int)) - first, np.minimum(last, sides[:, 0].astype(int)) - first  # of the windows a string holds
        able = np.flatnonzero(low <= high)
        a, b = _digests(body[able, near], group[able])
        order = np.lexsort((rank[able], b, a))
        at = _starts(a[order], b[order])
        sizes = np.diff(np.append(at, len(order)))
        able = able[order]
        several = rank[able[at]] < rank[able[at + sizes - 1]]
        able, family = able[np.repeat(several, sizes)], np.repeat(np.arange(several.sum()), sizes[several])
        if not len(able):
            continue
        low, high, own = low[able], high[able], rank[able]
        text = body[able][:, far]
        there = (places[far] >= -sides[able, :1].astype(int)) & (places[far] < K + sides[able, 1:].astype(int))
        # strings that are equal as far as the half's windows reach are sought once, and all windows of the later ones are marked
        a, b = _digests(text, family, there[:, :left].sum(1), there[:, left:].sum(1))
        order = np.lexsort((own, b, a))
        at = _starts(a[order], b[order])
        kept = np.sort(order[at])
        which = np.empty(len(order), np.int64)
        which[order] = np.repeat(np.searchsorted(kept, order[at]), np.diff(np.append(at, len(order))))
        found = _marks_of_families(text[kept], there[kept], left, family[kept], _dense_ranks(family[kept], own[kept]), low[kept], high[kept], side - (near.stop - near.start) + CODE)
        later = (own > own[kept][which])[:, None]
        lefts = np.arange(last - first + 1)
        marked[able, first : last + 1] = found[which] | (later & (lefts >= low[:, None]) & (lefts <= high[:, None]))
    return marked


def _marks_of_families(text: np.ndarray, there: np.ndarray, left: int, family: np.ndarray, rank: np.ndarray, low: np.ndarray, high: np.ndarray, window: int) -> np.ndarray:
    """For distinct strings of families: which of the windows ``low`` to ``high`` a smaller rank of the family holds.  Families and ranks ascend."""
    lefts = np.arange(left + 1)
    opened = (lefts >= low[:, None]) & (lefts <= high[:, None])
    marked = np.zeros_like(opened)
    most = np.zeros(int(family.max(initial=0)) + 1, np.int64)
    np.maximum.at(most, family, rank)
    for j in reversed(range(int(rank.max(initial=0)).bit_length())):
        rows = np.flatnonzero((most[family] >> j > 0) & opened.any(1))
        bit = (rank[rows] >> j) & 1
        at = _starts((family[rows] << 32) | (rank[rows] >> (j + 1)))
        sizes = np.diff(np.append(at, len(rows)))
        ones = np.add.reduceat(bit, at) if len(at) else at
        both = (ones > 0) & (ones < sizes)
        if not both.any():
            continue
        code = np.zeros(len(family), np.int64)
        code[rows] = np.repeat(np.cumsum(both) - 1, sizes)
        take = np.repeat(both, sizes)
        rows, bit = rows[take], bit[take] > 0
        for which, before in _stream(text, there, code, left, rows[~bit], rows[bit], window):
            marked[which, before] = True
        opened &= ~marked
    return marked


def _marks_of_piece(body, sides, key, doc, unit, at, length):
    """(unit, start and end) of what surroundings of smaller ids hold too; all surroundings of an anchor are there."""
    order, which, first, starts = _distinct(key, body, sides, doc)
    body, sides, key, doc, unit, at = body[order], sides[order], key[order], doc[order], unit[order], at[order]
    spans, whole = _whole_spans(at, sides, length)
    units, out = [unit[~first & whole]], [spans[~first & whole]]
    group = np.cumsum(np.concatenate([[0], key[starts][1:] != key[starts][:-1]])) if len(starts) else np.zeros(0, np.int64)
    by_doc = np.lexsort((doc[starts], group))
    g, d = group[by_doc], doc[starts][by_doc]
    rank = np.empty(len(g), np.int64)
    rank[by_doc] = _dense_ranks(g, d)
    marked = _marked_windows(body[starts], sides[starts], group, rank, length)
    any_marked = marked.any(1)[which] & first
    rows = np.flatnonzero(any_marked)
    i, left = np.nonzero(marked[which[rows]])
    begin = at[rows][i] - left
    units.append(unit[rows][i])
    out.append(np.stack([begin, begin + length], 1))
    return np.concatenate(units), np.concatenate(out).astype(np.int32)


def _marks_of_bucket(length: int, parts: int):
    """A bucket's anchors are dealt into pieces, so that an index stays small however many surroundings a bucket has."""

    def run(table: pa.Table) -> pa.Table:
        places = _read_places(table, length)
        piece = _mix(places[2] ^ np.uint64(0x9E3779B97F4A7C15)) % np.uint64(len(places[2]) // PIECE + 1)
        order = np.argsort(piece, kind="stable")
        at = _starts(piece[order])
        marks = [_marks_of_piece(*[x[order[a:b]] for x in places], length) for a, b in zip(at, np.append(at[1:], len(order)))]
        return _to_table(_packed(*map(np.concatenate, zip(*marks)), parts), "spans")

    return lean_table(run)


def _windows(length: int):
    """Each window of the surroundings as a digest of two longs, its id, unit and place."""
    side = length - K

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                body, sides, _, doc, unit, at = _read_places(pa.Table.from_batches([batch.slice(i, 1)]), length)
                for left in range(side + 1):
                    ok = (left <= sides[:, 0]) & (side - left <= sides[:, 1])
                    cells = body[ok, side - left : side - left + length]
                    a, b = np.zeros(len(cells), np.uint64), np.zeros(len(cells), np.uint64)
                    for c in cells.T.astype(np.uint64):
                        a = _mix(a * np.uint64(257) + c + np.uint64(1))
                        b = _mix((b ^ c) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(doc[ok]), pa.array(unit[ok]), pa.array(at[ok] - left)], ["a", "b", "doc", "unit", "start"])

    return lean(run)


STRIPPED = "digest binary, first_id long, has_copies boolean, has_unnamed boolean, text string, kept binary, removed array<struct<start: bigint, end: bigint>>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _cut(texts: pa.Table, marks: pa.Table) -> pa.Table:
    """Of each unit of a part: its marks merged into runs, the rest joined."""
    unit, spans = _joined(marks["units"], np.int64), _joined(marks["spans"], np.int32).reshape(-1, 2).astype(np.int64)
    order = np.lexsort((spans[:, 0], unit))
    unit, spans = unit[order], spans[order]
    own = texts["unit"].to_numpy()
    low, high = np.searchsorted(unit, own), np.searchsorted(unit, own, side="right")
    kept, removed = [], []
    for text, a, b in zip(texts["text"].cast(pa.binary()).to_pylist(), low, high):
        begins, reach = spans[a:b, 0], np.maximum.accumulate(spans[a:b, 1])
        new = np.concatenate([[True], begins[1:] > reach[:-1]]) if b > a else np.zeros(0, bool)
        begin = begins[new]
        end = reach[np.append(np.flatnonzero(new)[1:], b - a) - 1] if b > a else begin
        edges = [0, *np.stack([begin, end], 1).ravel().tolist(), len(text)]
        kept.append(b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2])))
        removed.append([{"start": x, "end": y} for x, y in zip(begin.tolist(), end.tolist())])
    same = ["digest", "first_id", "has_copies", "has_unnamed", "text"]
    return pa.table([*[texts[c] for c in same], pa.array(kept, pa.binary()), pa.array(removed, _RUNS)], [*same, "kept", "removed"])


@contextmanager
def _early_cleaning(spark: SparkSession):
    """Shuffle files go when the query that made them ends; all tables between the steps are written."""
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)


def _written(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def parts_for(total_bytes: int, part_bytes: int) -> int:
    """A power of two: one part for about ``part_bytes``, and beyond 256 parts for four times as many, as messages are packed by part and bucket and their number grows with the square of the parts."""
    wanted = max(2.0, total_bytes / part_bytes)
    return 1 << min(24, int(np.ceil(np.log2(wanted if wanted <= MANY else max(MANY, wanted / 4)))))


def shared_marks(units: DataFrame, length: int, parts: int, bucket_bytes: int = 256 << 20) -> DataFrame:
    """(part, units, spans): places of strings of ``length`` bytes that a unit of a smaller ``first_id`` holds too, packed by part; spans are pairs of 32-bit numbers.

    ``units``: a written table (unit, part, first_id, text) of distinct texts.  There are as many buckets
    as parts; one whose surroundings exceed ``bucket_bytes`` is resolved by windows.
    """
    spark = units.sparkSession
    named = units.where(F.col("first_id").isNotNull() & (F.octet_length("text") >= length)).select("part", "unit", "first_id", "text")
    found = _written(spark, named.select("unit", "text").mapInArrow(_find_anchors(length, parts), ANCHORS), "anchors")
    back = found.where("bucket is not null").select("bucket", "units", "keys").groupBy("bucket").applyInArrow(_recurring(parts), "part int, units binary, keys binary")
    asked = _written(spark, back.unionByName(found.where("bucket is null").select("part", "units", "keys")), "asked-anchors")
    drop_path(spark, found.written_to)
    places = _written(spark, named.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(_find_places(length, parts), PLACES), "places")
    drop_path(spark, asked.written_to)
    todo = places.where("bucket is not null")
    large = _written(spark, todo.groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") * (2 * length) > bucket_bytes).select("bucket"), "large-buckets")
    has_large = not large.isEmpty()
    small = todo.join(large, "bucket", "left_anti") if has_large else todo
    columns, packed = ["body", "sides", "keys", "docs", "units", "at"], "part int, units binary, spans binary"
    marks = places.where("bucket is null").select("part", "units", "spans").unionByName(small.select("bucket", *columns).groupBy("bucket").applyInArrow(_marks_of_bucket(length, parts), packed))
    if has_large:
        windows = todo.join(large, "bucket", "left_semi").select(*columns).mapInArrow(_windows(length), "a long, b long, doc long, unit long, start long")
        least = windows.groupBy("a", "b").agg(F.min("doc").alias("least")).select(F.col("a").alias("x"), F.col("b").alias("y"), "least")
        late = windows.join(least, (F.col("a") == F.col("x")) & (F.col("b") == F.col("y"))).where("doc > least")

        def pairs(batches):
            for batch in batches:
                start = batch.column(1).to_numpy()
                yield from _to_table(_packed(batch.column(0).to_numpy(), np.stack([start, start + length], 1).astype(np.int32), parts), "spans").to_batches()

        marks = marks.unionByName(late.select("unit", "start").mapInArrow(lean(pairs), packed))
    out = _written(spark, marks, "marks")
    drop_path(spark, places.written_to)
    return out


def strip_shared(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", outputs: dict[str, Column] | None = None, bucket_bytes: int = 256 << 20, part_bytes: int = SLICE) -> DataFrame:
    """Rows of ``docs`` with what is left of each text once all strings of ``length`` bytes that start in a text of a smaller id are taken out.

    ``outputs`` are columns computed from ``kept`` (the remaining bytes) and ``removed`` (an array of
    runs with start and end, in bytes, in order, none touching the next), by default these two;
    they are computed once a distinct text, before rows look them up.  They replace columns
    of the same names; all other columns, repeated rows and their number stay.

    Null is the empty text.  Texts are compared as UTF-8 bytes and judged as they came in, each
    to its end; matches lie within single texts.  Equal ids are not smaller than each other:
    rows that share an id take nothing from each other.  A row without an id loses nothing and
    takes nothing.  Texts shorter than ``length`` stay whole.  An empty table gives an empty result.
    """
    if length < K + 2:
        raise ValueError(f"length has to be {K + 2} or more")
    spark = docs.sparkSession
    outputs = outputs or {"kept": F.col("kept"), "removed": F.col("removed")}
    ident = F.col(f"`{id_col}`").cast("long")
    digest = F.unhex(F.sha2(whole_text(text_col), 256))
    with scratch(spark) as made, _early_cleaning(spark):
        held = docs.select(digest.alias("digest"), ident.alias("id"), whole_text(text_col).alias("text"))
        held = held.groupBy("digest").agg(F.min("id").alias("first_id"), F.coalesce(F.max("id") > F.min("id"), F.lit(False)).alias("has_copies"), (F.count("*") > F.count("id")).alias("has_unnamed"), F.first("text").alias("text"))
        size = docs.agg(F.sum(F.octet_length(whole_text(text_col)).cast("long"))).first()[0] or 0
        parts = parts_for(size, part_bytes)
        units = _written(spark, held.withColumn("unit", F.monotonically_increasing_id()).withColumn("part", part_of(F.col("unit"), parts)), "distinct-texts")
        marks = shared_marks(units, length, parts, bucket_bytes)
        cut = units.groupBy("part").cogroup(marks.groupBy("part")).applyInArrow(lean_table(_cut), STRIPPED)
        # fate of a row: 0 its text is this id's first, 1 a smaller id has the same text, 2 it has no id
        size = F.octet_length("text").cast("long")
        none = F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)")
        goes = size >= length
        fates = F.array(
            F.struct(F.lit(0).alias("fate"), F.col("kept").alias("kept"), F.col("removed").alias("removed")),
            F.when(F.col("has_copies"), F.struct(F.lit(1).alias("fate"), F.when(goes, F.lit(b"")).otherwise(F.col("text").cast("binary")).alias("kept"), F.when(goes, F.array(F.struct(F.lit(0).cast("long").alias("start"), size.alias("end")))).otherwise(none).alias("removed"))),
            F.when(F.col("has_unnamed"), F.struct(F.lit(2).alias("fate"), F.col("text").cast("binary").alias("kept"), none.alias("removed"))),
        )
        rows = cut.select("digest", "first_id", F.explode(F.filter(fates, lambda x: x.isNotNull())).alias("r")).select("digest", "first_id", "r.fate", "r.kept", "r.removed")
        table = _written(spark, rows.select(F.col("digest").alias("__d"), F.col("first_id").alias("__first"), F.col("fate").alias("__f"), *[v.alias(f"__out_{i}") for i, v in enumerate(outputs.values())]), "stripped")
        made.keep(table)
    fate = F.when(ident.isNull(), 2).when(ident > F.col("__first"), 1).otherwise(0)
    other = [F.col(f"`{c}`") for c in docs.columns if c not in outputs]
    joined = docs.withColumn("__digest", digest).join(table, F.col("__digest") == F.col("__d"))
    return joined.where(F.col("__f") == fate).select(*other, *[F.col(f"__out_{i}").alias(n) for i, n in enumerate(outputs)])


def op11_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", F.octet_length(whole_text()).cast("long").alias("n_bytes"))
    lost = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    out = strip_shared(docs, outputs={"n_removed": lost, "n_spans": F.size("removed").cast("long"), "kept_sha256": F.sha2("kept", 256)})
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
