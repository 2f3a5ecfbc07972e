"""Near-duplicate documents by a parity-sketch join over word shingles.

A document's set holds its distinct shingles (five lower-cased words; a shorter text is one shingle), named by
64-bit hashes.  Sets of sizes a and b with a Jaccard similarity of at least t differ in at most
(1 - t) / (1 + t) * (a + b) elements.

Sketches.  For a size band the hash space is cut into m chunks.  A set's parity sketch toggles, for each
element, one bit of a (very wide, sparsely held) bit vector; two sketches' Hamming distance is at most the
size of the sets' symmetric difference, because equal elements cancel.  A chunk of a sketch is named by the
XOR of 64-bit names of its odd bits.

Pigeonhole.  In a band where two sets may differ in D elements, at least m - D chunks of their sketches agree.
With m = D + 1 + s chunks, s + 1 agree, so each set may leave out its s least telling chunks in an order that
depends on the chunk alone and one agreeing chunk is still emitted by both: the last agreeing one in that order
has s agreeing ones before it.  Any such order gives the same result, so the one that keeps buckets small is
taken: first chunks found to be common (``hot_chunks``, from a share of the documents: those of passages that
many documents hold), then those with the fewest odd bits, then by name.

Bands.  Band k holds sizes up to U_k, U growing by ``BAND`` (over 1/t).  A set is emitted in its own band and,
if a partner up to 1/t times its size may lie in the next one, there too; D is the bound for two sets of size U.

Join.  Entries (chunk, set) meet by chunk.  Copies of a set within a task are emitted once.  Three rounds follow,
each on what the ones before left open; pairs are ruled out by size and by dense parity sketches (``BITS`` an
element or more; the wider one is folded onto the narrower), and only what is left is verified on whole sets:

1. Of the smallest sets of its buckets, each set is compared with the one that it meets most often.
2. Buckets that still hold several components are searched where they lie: a spanning forest over the pairs
   that sizes and narrow sketches (``NARROW`` bits an element) leave possible, so a bucket yields fewer pairs
   than it has sets.  Sets of different trees can't be similar.
3. In trees that hold several components even so, all possible pairs across components are verified.

So every pair that shares a chunk is compared or known to be connected: no link is lost, copies are never
expanded into all pairs, and the pairs that travel grow with the entries, not with the square of a group.

Texts never shuffle as long as the sets to compare number at most ``BROADCAST_IDS``, which is counted first;
beyond it they are joined by shuffle.

Null and empty texts and texts without words have empty sets, are linked with nothing and are their own
component.  Rows are told apart by their sets, so one id may have several texts.  Rows with a null id are
compared like any others; a component's id is its smallest id that is not null.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import Words, batch, blocks, lowered, mix, need, on_workers, raw, shared_checkpoint, spread, windows

SHINGLE = 5
#: The similarity as percent: 100 * intersection >= PERCENT * union.
PERCENT = 80
BAND = 1.5625
#: Chunks beyond D + 1, as a share of it.
SPARE = 0.18
#: Of a dense sketch: with four, hardly a pair below a similarity of 0.79 stays possible; with one, below 0.74.
BITS = 4
#: Of the sketch that travels to the search for forests.
NARROW = 1
#: Buckets of so many sets are compared in bulk, pair by pair; larger ones are searched one by one.
SMALL = 6
BROADCAST_IDS = 1_000_000
#: About so many links are written by a task: a round never has more links than the one before.
LINKS_A_TASK = 100_000
#: Bytes of text that a worker takes at once: its arrays are some two hundred times as large.
BLOCK = 1 << 18
#: Sets that a task remembers to have emitted.
SEEN = 1 << 20
#: One document in so many is looked at for common chunks, of which this many are kept.
HOT_SHARE, HOT_MOST, HOT_FROM = 8, 200_000, 3

SETS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.int64()), ("sketch", pa.binary()), ("narrow", pa.binary())])
ENTRIES = pa.schema([("chunk", pa.int64()), ("set_id", pa.int64())])
ARRAYS = pa.schema([("set_id", pa.int64()), ("shingles", pa.list_(pa.int64()))])


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle names of each text, flat, and how many each text has."""
    n_docs = len(offsets) - 1
    words = Words(lowered(data), offsets)
    names, counts = words.hashes(), words.counts
    found, at = windows(names, words.doc, size)
    doc = words.doc[at]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        with np.errstate(over="ignore"):
            whole = mix(counts[short].astype(np.uint64), 11)
            for k in range(size - 1):
                on = counts[short] > k
                whole[on] = mix(whole[on] * np.uint64(0x9E3779B97F4A7C15) + names[words.first[short[on]] + k], 13)
        found, doc = np.concatenate([found, whole]), np.concatenate([doc, short])
    order = np.lexsort((found, doc)) if len(short) else sort_by_doc(found, doc)
    found, doc = found[order], doc[order]
    new = np.ones(len(found), np.bool_)
    new[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
    return found[new], np.bincount(doc[new], minlength=n_docs)


def sort_by_doc(found: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """An order by (doc, name), doc rising already: text by text."""
    order = np.empty(len(found), np.int64)
    cuts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
    for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(doc)).tolist()):
        order[a:b] = np.argsort(found[a:b]) + a
    return order


def set_ids(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set, 0 for an empty one."""
    ends = np.cumsum(counts)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(shingles, 17))])
        out = mix(sums[ends] - sums[ends - counts] + mix(counts.astype(np.uint64), 19), 23)
    return np.where(counts == 0, np.uint64(0), np.where(out == 0, np.uint64(1), out))


@lru_cache(maxsize=64)
def band_tops(percent: int, band: float, largest: int) -> np.ndarray:
    tops = [1]
    while tops[-1] < largest:
        tops.append(max(tops[-1] + 1, 100 * tops[-1] // percent, int(band * tops[-1])))
    return np.array([*tops, tops[-1] * 4])


def sketch_entries(shingles: np.ndarray, counts: np.ndarray, percent: int = PERCENT, hot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(chunk names, index of the set) that sets emit, in their own band and where need be in the next.

    hot: sorted names of common chunks; without it all chunks are emitted.
    """
    tops = band_tops(percent, BAND, 1 << 40)
    own = np.searchsorted(tops, counts)
    above = (counts > 0) & (100 * counts // percent > tops[own])
    sets = np.concatenate([np.flatnonzero(counts > 0), np.flatnonzero(above)])
    cell = np.concatenate([own[counts > 0], own[above] + 1])
    differ = (100 - percent) * 2 * tops[cell] // (100 + percent)
    keep = differ > 0  # where no difference is allowed, equal sets are one set already
    sets, cell, differ = sets[keep], cell[keep], differ[keep]
    if not len(sets):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sizes = counts[sets]
    starts = (np.cumsum(counts) - counts)[sets]
    spare = np.ceil(SPARE * (differ + 1)).astype(np.int64)
    chunks = differ + 1 + spare
    # toggled bits, chunk by chunk: the upper half of a name picks the chunk, so sorted names come by chunk
    row = np.repeat(np.arange(len(sets)), sizes)
    element = shingles[np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)]
    at = ((element >> np.uint64(32)) * chunks[row].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    base = np.cumsum(chunks) - chunks
    flat = base[row] + at
    first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
    value, bits = np.zeros(int(chunks.sum()), np.uint64), np.zeros(int(chunks.sum()), np.int64)
    value[flat[first]] = np.bitwise_xor.reduceat(mix(element, 29), first)
    bits[flat[first]] = np.diff(np.append(first, len(flat)))
    # the order in which chunks are left out: common ones, then by odd bits, then by a name of (band, chunk, content)
    owner = np.repeat(np.arange(len(sets)), chunks)
    with np.errstate(over="ignore"):
        place = mix(cell[owner].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (np.arange(len(owner)) - base[owner]).astype(np.uint64), 31)
        name = mix(value ^ place, 37)
    if hot is None:
        return name, sets[owner]
    grade = np.minimum(bits + 1, 7).astype(np.uint64)
    if len(hot):
        grade[hot[np.minimum(np.searchsorted(hot, name), len(hot) - 1)] == name] = 0
    rank = (grade << np.uint64(61)) | (name >> np.uint64(3))
    order = np.lexsort((rank, owner))
    left_out = np.arange(len(owner)) - base[owner] < spare[owner]  # of the sorted ones
    stay = order[~left_out]
    return name[stay], sets[owner[stay]]


def dense_sketches(shingles: np.ndarray, counts: np.ndarray, bits: int = BITS) -> pa.BinaryArray:
    """Parity sketches of a power of two of bits, at least 64 and ``bits`` times the set's size.

    Bits are picked by the lowest part of a name, so XORing the halves of a sketch gives the one of half the
    width.
    """
    width = 1 << np.ceil(np.log2(np.maximum(bits * counts, 64))).astype(np.int64)
    base = np.cumsum(width) - width
    row = np.repeat(np.arange(len(counts)), counts)
    bit = (mix(shingles, 47) & (width[row] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(base[row] + bit, minlength=int(width.sum())) & 1
    data = np.packbits(odd.astype(np.uint8))
    ends = np.append(0, np.cumsum(width) // 8).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def hamming(x: bytes, y: bytes) -> int:
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(a) < len(b):
        a, b = b, a
    while len(a) > len(b):
        half = len(a) // 2
        a = a[:half] ^ a[half:]
    return int(np.bitwise_count(a ^ b).sum())


def sketch_batches(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b, sizes, sketches) to the pairs that sizes and sketches leave possible."""
    for b in batches:
        na, nb = b.column(2).to_numpy(), b.column(3).to_numpy()
        most = (100 - percent) * (na + nb) // (100 + percent)
        good = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
        for k in np.flatnonzero(good).tolist():
            good[k] = hamming(b.column(4)[k].as_py(), b.column(5)[k].as_py()) <= most[k]
        keep = pa.array(good)
        yield batch(PAIRS, b.column(0).filter(keep), b.column(1).filter(keep))


def set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row's number (task, place in it) is unique; it holds once the rows are checkpointed."""
    row = TaskContext.get().partitionId() << 40
    for b in batches:
        for lo, hi in blocks(b.column(1), BLOCK):
            shingles, counts = shingle_sets(*raw(b.column(1).slice(lo, hi - lo)))
            yield batch(SETS, np.arange(row, row + hi - lo), b.column(0).slice(lo, hi - lo), counts.astype(np.int64), set_ids(shingles, counts).view(np.int64), dense_sketches(shingles, counts), dense_sketches(shingles, counts, NARROW))
            row += hi - lo


def named_batches(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The rows themselves with one more column, the name of the set of the text in column ``text``."""
    for b in batches:
        for lo, hi in blocks(b.column(text), BLOCK):
            part = b.slice(lo, hi - lo)
            ids = set_ids(*shingle_sets(*raw(part.column(text)))).view(np.int64)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids)], names=[*part.schema.names, "_set"])


def entry_batches(batches: Iterator[pa.RecordBatch], percent: int, hot: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for b in batches:
        for lo, hi in blocks(b.column(0), BLOCK):
            shingles, counts = shingle_sets(*raw(b.column(0).slice(lo, hi - lo)))
            ids = set_ids(shingles, counts)
            _, first = np.unique(ids, return_index=True)
            fresh = np.zeros(len(ids), np.bool_)
            fresh[[k for k, x in zip(first.tolist(), ids[first].tolist()) if x and x not in seen]] = True
            if len(seen) < SEEN:
                seen.update(ids[fresh].tolist())
            if not fresh.any():
                continue
            shingles, counts, ids = shingles[np.repeat(fresh, counts)], counts[fresh], ids[fresh]
            name, owner = sketch_entries(shingles, counts, percent, hot)
            yield batch(ENTRIES, name.view(np.int64), ids[owner].view(np.int64))


PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def bucket_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Whole buckets from rows sorted by their first column: (run starts, columns), the last bucket of a batch carried on.

    Rows in buckets of one are dropped at once, so what is carried is small unless a bucket is large.
    """
    held: list[list[np.ndarray]] = []  # parts of a bucket that may go on
    for b in batches:
        own = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if not len(own[0]):
            continue
        cut = int(np.searchsorted(own[0], own[0][-1]))
        if cut or held and held[0][0][0] != own[0][0]:
            held.append([x[:cut] for x in own])
            yield from _runs([np.concatenate(x) for x in zip(*held)])
            held = []
        held.append([x[cut:] for x in own])
    if held:
        yield from _runs([np.concatenate(x) for x in zip(*held)])


def _runs(own: list[np.ndarray]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    key, ids = own[0], own[1]
    new = np.ones(len(key), np.bool_)
    new[1:] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])  # a set counts once in a bucket
    own = [x[new] for x in own]
    start = np.append(True, own[0][1:] != own[0][:-1])
    size = np.diff(np.append(np.flatnonzero(start), len(start)))
    many = np.repeat(size > 1, size)
    own = [x[many] for x in own]
    if len(own[0]):
        yield np.flatnonzero(np.append(True, own[0][1:] != own[0][:-1])), own


def star_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From entries sorted by (chunk, set): (smallest set of a bucket, other set, how often); and members as (chunk, set)."""
    for starts, (key, ids) in bucket_runs(batches):
        size = np.diff(np.append(starts, len(key)))
        rest = np.ones(len(key), np.bool_)
        rest[starts] = False
        low, other = np.repeat(ids[starts], size)[rest], ids[rest]
        order = np.lexsort((low, other))
        low, other = low[order], other[order]
        first = np.flatnonzero(np.append(True, (low[1:] != low[:-1]) | (other[1:] != other[:-1])))
        often = np.diff(np.append(first, len(low)))
        member = np.concatenate([np.zeros(len(first), np.bool_), np.ones(len(key), np.bool_)])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (member, np.concatenate([low[first], key]), np.concatenate([other[first], ids]), np.concatenate([often, np.zeros(len(key), np.int64)]))], names=["member", "a", "b", "n"])


class Sketches:
    """The sketches of a bucket's sets, folded to each width that occurs (of few: its sets are of one band)."""

    def __init__(self, sketch: np.ndarray):
        self.width = np.fromiter(map(len, sketch), np.int64, len(sketch))
        self.folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for w in np.unique(self.width).tolist():
            at = np.flatnonzero(self.width >= w)
            place = np.full(len(sketch), -1)
            place[at] = np.arange(len(at))
            self.folded[w] = place, np.stack([np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, w), axis=0) for x in sketch[at]]).view(np.uint64)

    def distances(self, one: int, others: np.ndarray) -> np.ndarray:
        """From one set to others, at the narrower one's width each time."""
        out = np.empty(len(others), np.int64)
        narrow = np.minimum(self.width[others], self.width[one])
        for w in np.unique(narrow).tolist():
            at = np.flatnonzero(narrow == w)
            place, rows = self.folded[w]
            out[at] = np.bitwise_count(rows[place[others[at]]] ^ rows[place[one]]).sum(axis=1)
        return out


def forest(component: np.ndarray, size: np.ndarray, sketch: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Possible pairs that span a bucket's components: each component is reached once, from the first set that can be like it."""
    code = np.unique(component, return_inverse=True)[1]
    by_code = np.argsort(code, kind="stable")
    first = np.searchsorted(code[by_code], np.arange(code.max() + 2))
    sketches, out = Sketches(sketch), []
    left = np.arange(len(code))  # sets of components that aren't reached
    reached = np.zeros(code.max() + 1, np.bool_)
    while len(left):
        own = int(code[left[0]])
        reached[own] = True
        queue = by_code[first[own] : first[own + 1]].tolist()
        left = left[code[left] != own]
        while queue and len(left):
            one = queue.pop()
            most = (100 - percent) * (size[left] + size[one]) // (100 + percent)
            near = left[np.abs(size[left] - size[one]) <= most]
            if not len(near):
                continue
            distance = sketches.distances(one, near)
            good = distance <= (100 - percent) * (size[near] + size[one]) // (100 + percent)
            hits = near[good][np.argsort(distance[good], kind="stable")]
            for x in hits.tolist():
                if not reached[code[x]]:
                    reached[code[x]] = True
                    out.append((one, x))
                    queue += by_code[first[code[x]] : first[code[x] + 1]].tolist()
            if len(hits):
                left = left[~reached[code[left]]]
    return out


def pair_distances(sketch: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Hamming distances of many pairs of sketches at once, each at the narrower one's width."""
    words = np.fromiter(map(len, sketch), np.int64, len(sketch)) // 8
    flat, first = np.frombuffer(b"".join(sketch.tolist()), np.uint64), np.cumsum(words) - words
    out = np.empty(len(one), np.int64)
    for lo in range(0, len(one), 1 << 14):
        x, y = one[lo : lo + (1 << 14)], other[lo : lo + (1 << 14)]
        narrow = np.minimum(words[x], words[y])
        base = np.cumsum(narrow) - narrow
        both = np.zeros(int(narrow.sum()), np.uint64)
        for side in (x, y):
            at = spread(words[side])
            np.bitwise_xor.at(both, np.repeat(base, words[side]) + at % np.repeat(narrow, words[side]), flat[np.repeat(first[side], words[side]) + at])
        out[lo : lo + len(x)] = np.add.reduceat(np.bitwise_count(both).astype(np.int64), base)
    return out


def close_pairs(bucket: np.ndarray, component: np.ndarray, size: np.ndarray, sketch: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the possible pairs across components within small buckets (rows lie bucket by bucket)."""
    found = []
    for d in range(1, SMALL):
        x = np.flatnonzero((bucket[d:] == bucket[:-d]) & (component[d:] != component[:-d]))
        y = x + d
        good = 100 * np.minimum(size[x], size[y]) >= percent * np.maximum(size[x], size[y])
        found.append((x[good], y[good]))
    x, y = (np.concatenate(f) for f in zip(*found))
    good = pair_distances(sketch, x, y) <= (100 - percent) * (size[x] + size[y]) // (100 + percent) if len(x) else np.zeros(0, np.bool_)
    return x[good], y[good]


def trees(pairs: list[tuple[int, int]], component: dict[int, int]) -> tuple[list[tuple[int, int]], dict[int, int]]:
    """Of pairs of places those that join components to trees, and the tree of each component in one of several."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    out = []
    for x, y in pairs:
        a, b = top(component[x]), top(component[y])
        if a != b:
            up[max(a, b)] = min(a, b)
            out.append((x, y))
    return out, {c: top(c) for c in list(up)}


def forest_batches(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """From members sorted by (chunk, set) with components, sizes and narrow sketches: the pairs of each bucket's
    forest; and as (tree, set) the members of the trees, whose pairs alone are possible."""
    for starts, (key, ids, component, size, sketch) in bucket_runs(batches):
        sizes = np.diff(np.append(starts, len(ids)))
        bucket = np.repeat(np.arange(len(starts)), sizes)
        small = np.flatnonzero(sizes[bucket] <= SMALL)
        x, y = close_pairs(bucket[small], component[small], size[small], sketch[small], percent)
        by_bucket: dict[int, list[tuple[int, int]]] = {}
        for i, j in zip(small[x].tolist(), small[y].tolist()):
            by_bucket.setdefault(int(bucket[i]), []).append((i, j))
        for k in np.flatnonzero(sizes > SMALL).tolist():
            s, e = int(starts[k]), int(starts[k] + sizes[k])
            if pairs := forest(component[s:e], size[s:e], sketch[s:e], percent):
                by_bucket[k] = [(s + i, s + j) for i, j in pairs]
        seen, tree, members = set(), [], []
        for k, pairs in by_bucket.items():
            s, e = int(starts[k]), int(starts[k] + sizes[k])
            own = dict(zip(range(s, e), component[s:e].tolist()))
            pairs, tops = trees(pairs, own)
            seen.update((min(ids[i], ids[j]), max(ids[i], ids[j])) for i, j in pairs)
            for i, c in own.items():
                if c in tops:
                    tree.append((key[i], tops[c]))
                    members.append(ids[i])
        if seen:
            a, b = zip(*sorted(seen))
            names = np.array(tree, np.int64).view(np.uint64)
            with np.errstate(over="ignore"):
                names = mix(names[:, 0] ^ mix(names[:, 1], 53), 59).view(np.int64)
            member = np.concatenate([np.zeros(len(a), np.bool_), np.ones(len(names), np.bool_)])
            yield pa.RecordBatch.from_arrays([pa.array(member), pa.array(np.concatenate([np.array(a, np.int64), names])), pa.array(np.concatenate([np.array(b, np.int64), np.array(members, np.int64)]))], names=["member", "a", "b"])


def open_batches(batches: Iterator[pa.RecordBatch], percent: int, known: int = 1) -> Iterator[pa.RecordBatch]:
    """From members sorted by (chunk, set) with components, sizes and sketches: possible pairs across components.

    known: so many sets of a bucket, those with the smallest names, were compared with all others.  The others come
    narrow sketches first, so two sketches are compared at the narrower one's width, row by row in numpy; a
    bucket holds few widths, as its sets are of one band.
    """
    for starts, (_, ids, component, size, sketch) in bucket_runs(batches):
        lowest, highest = np.minimum.reduceat(component, starts), np.maximum.reduceat(component, starts)
        stops = np.append(starts[1:], len(ids))
        for s, e in zip(starts[lowest != highest].tolist(), stops[lowest != highest].tolist()):
            s += known
            wide = np.fromiter(map(len, sketch[s:e]), np.int64, e - s)
            order = np.argsort(wide, kind="stable") + s
            wide, own, of, n = np.sort(wide), ids[order], component[order], size[order]
            steps = np.flatnonzero(np.append(True, wide[1:] != wide[:-1]))
            for lo, hi in zip(steps.tolist(), np.append(steps[1:], e - s).tolist()):
                folded = np.stack([np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, wide[lo]), axis=0) for x in sketch[order[lo:]]]).view(np.uint64)
                for k in range(lo, min(hi, e - s - 1)):
                    most = (100 - percent) * (n[k] + n[k + 1 :]) // (100 + percent)
                    rest = np.flatnonzero((of[k + 1 :] != of[k]) & (np.abs(n[k + 1 :] - n[k]) <= most)) + k + 1
                    if len(rest):
                        rest = rest[np.bitwise_count(folded[rest - lo] ^ folded[k - lo]).sum(axis=1) <= most[rest - k - 1]]
                    if len(rest):
                        yield batch(PAIRS, np.minimum(own[k], own[rest]), np.maximum(own[k], own[rest]))


def array_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(set_id, text) to (set_id, shingles); a text of another set (one id may have several texts) goes."""
    seen: set[int] = set()
    for b in batches:
        for lo, hi in blocks(b.column(1), BLOCK):
            shingles, counts = shingle_sets(*raw(b.column(1).slice(lo, hi - lo)))
            wanted = b.column(0).slice(lo, hi - lo)
            own = np.flatnonzero(set_ids(shingles, counts).view(np.int64) == wanted.to_numpy())
            fresh = []
            for k, x in zip(own.tolist(), wanted.take(pa.array(own)).to_pylist()):
                if x not in seen:
                    seen.add(x)
                    fresh.append(k)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(shingles.view(np.int64)))
            yield pa.RecordBatch.from_arrays([x.take(pa.array(fresh, pa.int64())) for x in (wanted, lists)], schema=ARRAYS)


def compare_batches(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b, shingles of a, shingles of b) to the pairs that are similar."""
    for whole in batches:
        for lo in range(0, len(whole), 256):
            b = whole.slice(lo, 256)
            sides = []
            for c in (2, 3):
                lists = b.column(c)
                sides.append((lists.flatten().to_numpy().view(np.uint64), np.diff(lists.offsets.to_numpy())))
            (x, nx), (y, ny) = sides
            row = np.concatenate([np.repeat(np.arange(len(b)), nx), np.repeat(np.arange(len(b)), ny)])
            # an element that both sides hold occurs twice under its row
            key = mix(np.concatenate([x, y]) ^ mix(row.astype(np.uint64), 41), 43)
            order = np.argsort(key)
            twice = np.flatnonzero(key[order][1:] == key[order][:-1])
            shared = np.bincount(row[order[twice]], minlength=len(b))
            good = 100 * shared >= percent * (nx + ny - shared)
            if good.any():
                yield batch(PAIRS, b.column(0).filter(pa.array(good)), b.column(1).filter(pa.array(good)))


def bounded(ids: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """``ids`` with a broadcast hint if it is counted to be small enough."""
    return F.broadcast(ids) if ids.count() <= most else ids


def with_set_ids(rows: DataFrame, name: str = "_set") -> DataFrame:
    """``rows`` with the name of each text's set in a column of that name."""
    # numbered meanwhile: mapInArrow doesn't take names with dots
    fields = [StructField(f"c{k}", f.dataType) for k, f in enumerate(rows.schema.fields)]
    named = rows.toDF(*(f.name for f in fields)).mapInArrow(on_workers(__name__, "named_batches", rows.columns.index("text")), StructType([*fields, StructField("name", LongType())]))
    return named.toDF(*rows.columns, name)


def similar(documents: DataFrame, sets: DataFrame, per_set: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of set ids whose sets are similar, checkpointed.

    One row stands for each set, so copies never meet; pairs whose sizes and sketches rule them out go first.
    """
    ends = lambda p: p.select(F.col("a").alias("set_id")).union(p.select("b")).distinct()
    stands = shared_checkpoint(per_set.join(ends(pairs), "set_id").select("set_id", "row", "low"))
    own = sets.select("row", "n_shingles", "sketch").join(bounded(stands), "row")
    own = shared_checkpoint(own.select("set_id", "low", F.col("n_shingles").alias("n"), "sketch"))
    side = lambda x: own.select(F.col("set_id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    left = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb")
    left = shared_checkpoint(left.mapInArrow(on_workers(__name__, "sketch_batches", percent), "a long, b long"))
    stand = shared_checkpoint(own.select("set_id", F.col("low").alias("doc_id")).join(ends(left), "set_id"))
    texts = need(documents, doc_id="long", text="string")
    chosen = texts.join(bounded(stand.where("doc_id IS NOT NULL")), "doc_id").select("set_id", "text")
    if stand.where("doc_id IS NULL").limit(1).count():
        # no row of these sets has an id: their texts are found by the set's name
        nameless = with_set_ids(texts.where("doc_id IS NULL"))
        lone = nameless.join(bounded(stand.where("doc_id IS NULL").select(F.col("set_id").alias("_set"))), "_set")
        chosen = chosen.union(lone.select(F.col("_set"), "text"))
    arrays = chosen.mapInArrow(on_workers(__name__, "array_batches"), "set_id long, shingles array<long>").dropDuplicates(["set_id"])
    one = left.join(arrays.select(F.col("set_id").alias("a"), F.col("shingles").alias("x")), "a")
    both = one.join(arrays.select(F.col("set_id").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")
    return shared_checkpoint(both.mapInArrow(on_workers(__name__, "compare_batches", percent), "a long, b long"))


def components(links: DataFrame) -> DataFrame:
    """(set_id, root) of all ends of ``links`` (a, b), by alternating large and small stars.

    Each round replaces links by links to the smallest neighbour; rounds are checkpointed and end when the
    links stay as they are.  A hub's links are aggregated before they shuffle, and joined back under AQE's
    skew handling.
    """
    links = shared_checkpoint(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    sign = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    while sign[0]:
        # large star: all greater neighbours of a node link to its smallest neighbour (or itself)
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours link to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        links = shared_checkpoint(small.coalesce(1 + sign[0] // LINKS_A_TASK))
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == sign:
            break
        sign = now
    return links.select(F.col("u").alias("set_id"), F.col("v").alias("root")).union(links.select(F.col("v"), F.col("v"))).distinct()


def hot_chunks(rows: DataFrame, percent: int = PERCENT) -> np.ndarray:
    """Sorted names of the most common chunks, at most ``HOT_MOST``, from one document in ``HOT_SHARE``.

    They only order the chunks that sets leave out; which are found makes no difference to the result.
    """
    some = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(HOT_SHARE)) == 0).select("text")
    chunks = some.mapInArrow(on_workers(__name__, "entry_batches", percent, None), "chunk long, set_id long")
    common = chunks.groupBy("chunk").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HOT_FROM).orderBy(F.desc("n"), "chunk").limit(HOT_MOST).select("chunk")
    return np.sort(common.toArrow()["chunk"].to_numpy().view(np.uint64))


def near_duplicates(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``documents`` (doc_id, text)."""
    return found_sets(documents, percent).select("doc_id", "n_shingles", "component_id")


def split_buckets(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(chunk, set_id, component) of the buckets whose sets lie in several components."""
    placed = members.join(roots, "set_id", "left").select("chunk", "set_id", F.coalesce("root", "set_id").alias("component"))
    split = placed.groupBy("chunk").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("chunk")
    return shared_checkpoint(placed.join(split, "chunk", "left_semi"))


def found_sets(documents: DataFrame, percent: int) -> DataFrame:
    """(doc_id, n_shingles, set_id, component_id, class) of every row of ``documents``; class: the component's name."""
    rows = need(documents, doc_id="long", text="string")
    sets = shared_checkpoint(rows.mapInArrow(on_workers(__name__, "set_batches"), "row long, doc_id long, n_shingles long, set_id long, sketch binary, narrow binary"))
    per_set = shared_checkpoint(sets.where("set_id <> 0").groupBy("set_id").agg(F.min("row").alias("row"), F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("copies")))
    entries = rows.select("text").mapInArrow(on_workers(__name__, "entry_batches", percent, hot_chunks(rows, percent)), "chunk long, set_id long")
    buckets = entries.repartition("chunk").sortWithinPartitions("chunk", "set_id")
    found = shared_checkpoint(buckets.mapInArrow(on_workers(__name__, "star_batches"), "member boolean, a long, b long, n long"))
    # the smallest set that a set meets in most buckets; ties to the smaller name
    often = found.where("NOT member").groupBy("a", "b").agg(F.sum("n").alias("n"))
    best = often.groupBy("b").agg(F.max(F.struct("n", F.bitwise_not("a").alias("a"))).alias("x")).select(F.bitwise_not("x.a").alias("a"), "b")
    roots = shared_checkpoint(components(similar(documents, sets, per_set, shared_checkpoint(best), percent)))
    members = found.where("member").select(F.col("a").alias("chunk"), F.col("b").alias("set_id"))
    search = found_in_buckets(sets, per_set, split_buckets(members, roots), "narrow", "forest_batches", "member boolean, a long, b long", percent)
    pairs = shared_checkpoint(search.where("NOT member").select("a", "b").distinct())
    if pairs.limit(1).count():
        links = similar(documents, sets, per_set, pairs, percent)
        roots = shared_checkpoint(components(links.union(roots.select("set_id", "root"))))
        members = search.where("member").select(F.col("a").alias("chunk"), F.col("b").alias("set_id"))
        pairs = found_in_buckets(sets, per_set, split_buckets(members, roots), "sketch", "open_batches", "a long, b long", percent, 0).distinct()
        if pairs.limit(1).count():
            links = similar(documents, sets, per_set, pairs, percent)
            roots = shared_checkpoint(components(links.union(roots.select("set_id", "root"))))
    return labelled(sets, per_set, roots)


def found_in_buckets(sets: DataFrame, per_set: DataFrame, members: DataFrame, sketch: str, search: str, schema: str, *args) -> DataFrame:
    """What a function finds in whole buckets of ``members`` (chunk, set_id, component) with sizes and sketches, checkpointed."""
    stands = shared_checkpoint(per_set.join(members.select("set_id").distinct(), "set_id").select("set_id", "row"))
    own = sets.select("row", F.col("n_shingles").alias("n"), sketch).join(bounded(stands), "row")
    drawn = members.join(own, "set_id").select("chunk", "set_id", "component", "n", sketch)
    return shared_checkpoint(drawn.repartition("chunk").sortWithinPartitions("chunk", "set_id").mapInArrow(on_workers(__name__, search, *args), schema))


def labelled(sets: DataFrame, per_set: DataFrame, roots: DataFrame) -> DataFrame:
    """Ids of components, settled set by set; rows then meet only their own set's label.

    Both sides of a join are written or counted before, so AQE can split a large class or a set with many copies.
    """
    placed = per_set.join(roots, "set_id", "left").where("root IS NOT NULL OR copies > 1").select("set_id", "low", F.coalesce("root", "set_id").alias("class"))
    placed = shared_checkpoint(placed)
    least = shared_checkpoint(placed.groupBy("class").agg(F.min("low").alias("component_id")))
    labels = shared_checkpoint(placed.select("set_id", "class").join(least, "class").select("set_id", "class", "component_id"))
    rows = sets.select("doc_id", "n_shingles", "set_id")
    named = rows.join(labels, "set_id", "left")
    return named.select("doc_id", "n_shingles", "set_id", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("class", "set_id").alias("class"))


def one_of_each(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``documents`` with one row of each group of near duplicates, the one with the smallest id.

    Rows without a word are groups of their own.  Rows with a null id stay unless another one of their group
    has an id.  Rows are decided by id and set: of several texts under one id those that are like another
    document's, with a smaller id, go and the others stay.  Where the smallest id of a group has several rows,
    the one with the smallest set name stays, then the one with the smallest text.
    """
    found = shared_checkpoint(found_sets(documents, percent))
    counts = found.agg(F.count(F.lit(1)), F.count("doc_id"), F.countDistinct("doc_id")).first()
    columns = [F.col(f"`{c}`") for c in documents.columns]
    if counts[0] == counts[2]:
        gone = found.where("doc_id <> component_id").select("doc_id")
        return documents.join(bounded(gone), "doc_id", "left_anti").select(*columns)
    # some ids are null or repeated: rows go by the names of their sets, under a name that no column has
    own = "_set"
    while own in documents.columns:
        own += "_"
    winners = found.where("set_id <> 0 AND doc_id = component_id").groupBy("class").agg(F.min("doc_id").alias("win_id"), F.min("set_id").alias("win_set"))
    lone = found.where("set_id <> 0 AND component_id IS NULL").select(F.lit(None).cast("long").alias("win_id"), F.col("set_id").alias("win_set"))
    named = with_set_ids(documents, own)
    none = named.where(F.col(own) == 0).select(*columns)
    stay = bounded(winners.select("win_id", "win_set").unionAll(lone).distinct())
    same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("w.win_id")) & (F.col(f"d.{own}") == F.col("w.win_set"))
    others = named.alias("d").join(stay.alias("w"), same, "left_semi")
    known = others.where("doc_id IS NOT NULL").groupBy("doc_id", own).agg(F.min_by(F.struct(*columns), F.struct("text", F.to_json(F.struct(*columns)))).alias("row")).select(*(F.col("row").getField(c).alias(c) for c in documents.columns))
    return known.unionAll(none).unionAll(others.where("doc_id IS NULL").select(*columns))
