"""Best-fit packing of tokenised documents into sequences of bounded length.

Two steps.  ``token_pieces`` tokenises whole texts where they lie (no shuffle of texts) and yields a row for
each piece: a document's ids, then the separator; only a document longer than ``capacity`` is cut.
``pack`` deals the short piece rows (no text, no ids unless asked for) by a hash of the document into
partitions of about ``PIECES_PER_PACKER`` rows, so their number grows with the corpus and no task does, and
runs bounded-space online best-fit in each.

Bounded-space best-fit: at most ``open_bins`` sequences are open.  They are kept by free space, one list for
each value, and a bitset (a Python integer) marks the values in use; the best fit of a piece of length n is
the lowest set bit at or above n.  A piece that fits nowhere opens a sequence; if that is one too many, the
fullest open one (the lowest set bit) closes first.  Full sequences close at once.

Both steps depend on their rows alone (partition by hash, rows sorted within it), so a lost executor's tasks
give the same sequences when they run again.

Null and empty texts are one piece that holds the separator alone.  Repeated rows and equal lengths are
packed like any others; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, Words, batch, blocks, need, on_workers, prefix_hashes, range_hashes, raw, shared_checkpoint, spread

CAPACITY = 4096
SEPARATOR = 1
OPEN_BINS = 1024
PIECES_PER_PACKER = 16_000
#: Words that a Python worker remembers the ids of (about 40 bytes each); beyond that it starts anew.
REMEMBERED = 300_000
#: One sequence number holds the packer above these bits, the packer's own count below.
PACKER_BITS = 36

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PIECES_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
IDS = ("ids", pa.list_(pa.int64()))


class WordTokenizer:
    """Ids of whole texts by the vocabulary's own library, each distinct word tokenised once.

    The tokenizer drops white space and never merges across it, so a text's ids are those of its words in a
    row.  Words of ASCII (but for apostrophes) and Latin-1 letters are split by the vocabulary's own rule, in
    numpy, into runs of letters, single digits and runs of other signs, which its model turns into ids; all
    other words, and those that may hold a special token, go through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        byte_level = ByteLevel(add_prefix_space=False, use_regex=False)
        signs = {ord(a): byte_level.pre_tokenize_str(a)[0][0] for a in map(chr, range(33, 127))}
        lead = byte_level.pre_tokenize_str("à")[0][0]
        self.signs = signs | {0xC3: lead[0]} | {0x80 + i: byte_level.pre_tokenize_str(chr(0xC0 + i))[0][0][1] for i in range(64)}
        kind = np.full(256, 3, np.uint8)  # 0 letter, 1 digit, 2 other sign, 3 not for the quick way
        kind[33:127] = 2
        kind[48:58] = 1
        kind[97:123] = 0
        kind[ord("'")] = 3
        kind[0xC3] = kind[0x80:0xC0] = 0
        self.kind = kind
        self.forget()

    def forget(self) -> None:
        self.memo = Memo()
        self.pool = np.zeros(1 << 16, np.uint32)
        self.at, self.size = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int32)
        self.pooled = 0

    def learn(self, names: np.ndarray, ids: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, ids), np.int32, len(ids))
        entries, total = self.memo.add(names), int(sizes.sum())
        while self.memo.used > len(self.at):
            self.at, self.size = np.concatenate([self.at, self.at]), np.concatenate([self.size, self.size])
        while self.pooled + total > len(self.pool):
            self.pool = np.concatenate([self.pool, self.pool])
        self.at[entries] = self.pooled + np.cumsum(sizes) - sizes
        self.size[entries] = sizes
        self.pool[self.pooled : self.pooled + total] = [i for x in ids for i in x]
        self.pooled += total

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a block of texts, and the number of ids of each text."""
        if self.memo.used > REMEMBERED:
            self.forget()
        n_docs = len(offsets) - 1
        low = data | (((data - 65) < 26).astype(np.uint8) << 5)
        after = np.zeros(len(data), np.bool_)
        after[1:] = data[:-1] == 0xC3
        low = low | ((after & (data >= 0x80) & (data < 0x9F) & (data != 0x97)).astype(np.uint8) << 5)
        words = Words(data, offsets)
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(n_docs, np.int64)
        kind = self.kind[low]
        odd = (kind == 3) | (after & ((data == 0x97) | (data == 0xB7))) | ((data >= 0x80) & (data < 0xC0) & ~after)
        odd[:-1] |= (data[:-1] == 60) & (data[1:] == 124)  # <| may open a special token
        solid = np.concatenate([[0], np.cumsum(odd)])
        slow = solid[words.end] > solid[words.start]
        # pieces: a word is cut where the kind of sign changes and around digits; a slow word is one piece
        cut = np.zeros(len(data) + 1, np.bool_)
        cut[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 1)
        span = np.zeros(len(data) + 1, np.int8)
        span[words.start[slow]] = 1
        span[words.end[slow]] -= 1  # where one slow word ends another may start
        in_slow = np.cumsum(span[:-1], dtype=np.int8) > 0
        cut[:-1] &= ~in_slow & words.solid
        cut[words.start] = True
        start = np.flatnonzero(cut[:-1])
        word = np.searchsorted(words.start, start, side="right") - 1
        end = np.minimum(np.append(start[1:], len(data)), words.end[word])
        del cut, span, in_slow, odd, solid
        is_slow = slow[word]
        names = range_hashes(low, start, end, prefix_hashes(low))
        if is_slow.any():  # a slow word is named by its own bytes, apart from the quick pieces
            raw_names = range_hashes(data, start[is_slow], end[is_slow])
            names[is_slow] = raw_names ^ np.uint64(0x5851F42D4C957F2D)
        names[names == 0] = 1
        entry = self.memo.find(names)
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            new, first = np.unique(names[missing], return_index=True)
            of = missing[first]
            low_bytes, data_bytes, model, signs = low.tobytes(), data, self.model, self.signs
            learnt = []
            for s, e, odd_word in zip(start[of].tolist(), end[of].tolist(), is_slow[of].tolist()):
                if odd_word:
                    text = data_bytes[s:e].tobytes().decode("utf-8", "replace")
                    learnt.append(self.tokenizer.encode(text, add_special_tokens=False).ids)
                else:
                    learnt.append([t.id for t in model.tokenize(low_bytes[s:e].decode("latin-1").translate(signs))])
            self.learn(new, learnt)
            entry[missing] = self.memo.find(names[missing])
        sizes = self.size[entry]
        flat = self.pool[np.repeat(self.at[entry], sizes) + spread(sizes.astype(np.int64))]
        per_doc = np.bincount(words.doc[word], weights=sizes, minlength=n_docs).astype(np.int64)
        return flat, per_doc


_tokenizers: dict[str, WordTokenizer] = {}


def cut_batches(batches: Iterator[pa.RecordBatch], path: str, capacity: int, separator: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    tokenizer = _tokenizers[path]
    schema = pa.schema([*PIECES_ARROW, IDS]) if with_ids else PIECES_ARROW
    for b in batches:
        text = b.column(1)
        for lo, hi in blocks(text):
            ids, per_doc = tokenizer.ids(*raw(text.slice(lo, hi - lo)))
            doc_ids = b.column(0).slice(lo, hi - lo)
            ends = np.cumsum(per_doc)
            pieces = -(-(per_doc + 1) // capacity)
            row = np.repeat(np.arange(hi - lo), pieces)
            piece = spread(pieces)
            begin = piece * capacity
            length = np.minimum(capacity, per_doc[row] + 1 - begin)
            sums, kept = np.empty(len(row), np.int64), []
            with_end = np.insert(ids, ends, separator).astype("<u4")
            at = (ends + np.arange(hi - lo) - per_doc)[row] + begin
            for k, (x, n) in enumerate(zip(at.tolist(), length.tolist())):
                sums[k] = zlib.crc32(with_end[x : x + n])
            if with_ids:
                kept = [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)).astype(np.int32)), pa.array(with_end.astype(np.int64)))]
            yield batch(schema, doc_ids.take(pa.array(row)), piece.astype(np.int32), begin, length, sums, *kept)


def token_pieces(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, separator: int = SEPARATOR, with_ids: bool = False) -> DataFrame:
    """A row for each piece of each document (doc_id, piece, start, length, ids_crc32, and ids if asked for)."""
    rows = need(documents, doc_id="long", text="string")
    out = PIECES + ", ids array<long>" * with_ids
    return rows.mapInArrow(on_workers(__name__, "cut_batches", tokenizer_path, capacity, separator, with_ids), out)


class BestFit:
    """Bounded-space online best-fit: ``add`` gives a piece its sequence and its place there."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins = capacity, open_bins
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = self.open = self.made = 0

    def _take(self, free: int) -> int:
        own = self.by_free[free]
        out = own.pop()
        if not own:
            self.bits ^= 1 << free
        self.open -= 1
        return out

    def add(self, length: int) -> tuple[int, int]:
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if self.open >= self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            free, number = self.capacity, self.made
            self.made += 1
        if left := free - length:
            if not self.by_free[left]:
                self.bits |= 1 << left
            self.by_free[left].append(number)
            self.open += 1
        return number, self.capacity - free


def pack_batches(batches: Iterator[pa.RecordBatch], capacity: int, open_bins: int) -> Iterator[pa.RecordBatch]:
    bins: dict[int, BestFit] = {}
    for b in batches:
        packers, lengths = b.column(0).to_pylist(), b.column(b.schema.get_field_index("length")).to_pylist()
        sequence, offset = np.empty(len(b), np.int64), np.empty(len(b), np.int64)
        for k, (p, n) in enumerate(zip(packers, lengths)):
            if p not in bins:
                bins = {p: BestFit(capacity, open_bins)}  # rows come packer by packer
            number, offset[k] = bins[p].add(n)
            sequence[k] = (p << PACKER_BITS) + number
        names = b.schema.names[1:]
        yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])


def pack(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, packers: int = 1) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ...) with sequence_id and offset.

    ``packers``: into how many independent packings the pieces are dealt; each leaves at most ``open_bins``
    sequences short of what later pieces could have filled.
    """
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    # a document's pieces go to different packers too: one very long document doesn't weigh on one
    dealt = pieces.select(F.pmod(F.xxhash64("doc_id", "piece"), F.lit(packers)).alias("_packer"), "*")
    dealt = dealt.repartition(packers, "_packer").sortWithinPartitions("_packer", F.xxhash64("doc_id", "piece", "start"), "doc_id", "piece")
    return dealt.mapInArrow(on_workers(__name__, "pack_batches", capacity, open_bins), out)


def pack_documents(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, separator: int = SEPARATOR, open_bins: int = OPEN_BINS, with_ids: bool = False) -> DataFrame:
    """Every document's pieces with their sequences; see the module's text for nulls, ties and empty tables.

    The pieces are checkpointed, so texts are tokenised once and the packers follow from the pieces counted.
    """
    pieces = shared_checkpoint(token_pieces(documents, tokenizer_path, capacity, separator, with_ids))
    return pack(pieces, capacity, open_bins, max(1, -(-pieces.count() // PIECES_PER_PACKER)))
