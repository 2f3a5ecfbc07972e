"""What the operators of this subpackage share: vectorised words of Arrow text, remote calls, checkpoints.

Words are the runs ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 bytes; A-Z may be lower-cased first.  A word is
named by a 64-bit polynomial hash of its bytes with a finishing mix, so equal words have equal names and
two different words of a corpus share one with a chance of 2**-64 a pair.
"""

from __future__ import annotations

import importlib
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text that are worked on at once in a Python worker; a longer text is one block of its own.
BLOCK_BYTES = 1 << 18

_powers: dict[str, np.ndarray] = {}


def on_workers(module: str, function: str, *args):
    """A function of Arrow batches for ``mapInArrow`` that calls ``module.function(batches, *args)``.

    Only names travel, so state kept in the module (caches, loaded vocabularies) lives as long as the
    Python worker does.  The package itself reaches the executors as a zip that Spark hands out.  When a task
    has ended its worker gives freed memory back: it stays for the tasks of later stages.
    """
    ship()

    def run(batches):
        import importlib

        found = getattr(importlib.import_module(module), function)(batches, *args)
        return found if isinstance(found, pa.Table) else trimmed(found)

    def trimmed(found):
        import ctypes

        yield from found
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return run


_shipped: set[str] = set()


def ship() -> None:
    """Hand this package to the executors of the active session, once an application."""
    session = SparkSession.getActiveSession()
    if session is None or session.sparkContext.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    out = Path(tempfile.mkdtemp(), f"{package.name}.zip")  # the driver's file server hands it out from there
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted((*package.rglob("*.py"), *package.rglob("*.tsv"))):
            z.write(path, path.relative_to(package.parent))
    session.sparkContext.addPyFile(str(out))
    _shipped.add(session.sparkContext.applicationId)


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """``df`` cut off from its lineage, written to the folder of ``spark.checkpoint.dir``.

    The folder is set here only where the session names none (tests, a single machine).
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(folder or "spark-warehouse/checkpoints")
    return df.checkpoint(eager=True)


def settle(spark: SparkSession) -> None:
    """Let the executors collect their garbage, which gives back heap that the stages before have grown.

    Python workers live outside the heap, so a stage that needs them has the room.  A task for each core; what it
    calls is a method of Java's own.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')")).collect()


def need(df: DataFrame, **kinds: str) -> DataFrame:
    """Only the named columns, in the named types; a table without one of them has nulls there."""
    return df.select(*(
        (F.col(f"`{c}`") if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()
    ))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a text column that hold about ``limit`` bytes each, a row at least."""
    n = len(column)
    if not n:
        return
    ends = np.cumsum(byte_lengths(column))
    start, base = 0, 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield start, stop
        base, start = int(ends[stop - 1]), stop


def byte_lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and its n + 1 offsets into them; null is an empty text."""
    import pyarrow.compute as pc

    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased; all other bytes as they are."""
    return data | (((data - 65) < 26).astype(np.uint8) << 5)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """The splitmix64 finisher."""
    with np.errstate(over="ignore"):
        x = x.astype(U64) + U64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def powers(n: int, of: str = "up") -> np.ndarray:
    """BASE ** i (or its inverse ** i) modulo 2**64 for i < n."""
    have = _powers.get(of)
    if have is None or len(have) < n:
        steps = np.full(max(n, BLOCK_BYTES + 2), BASE if of == "up" else BASE_INVERSE, U64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if len(have) <= 4 * BLOCK_BYTES:
            _powers[of] = have
    return have[:n]


class Words:
    """The words of a block of texts: byte ranges, the text each lies in, and hashes.

    data, offsets: bytes and text offsets; start, end: byte range of each word; doc: index of its text;
    first: n + 1 offsets of each text's words.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        n = len(data)
        solid = np.empty(n + 2, np.bool_)
        solid[0] = solid[-1] = False
        np.logical_not((data == 32) | ((data - 9) < 5), out=solid[1:-1])
        change = solid[1:] != solid[:-1]  # at i: a word starts or ends before byte i
        inner = offsets[1:-1]
        inner = np.unique(inner[(inner > 0) & (inner < n)])
        cut = inner[solid[inner] & solid[inner + 1]]  # a text ends where the next one goes on with a word
        at = np.flatnonzero(change)
        if len(cut):
            at = np.sort(np.concatenate([at, cut, cut]))
        self.solid = solid[1:-1]
        self.start, self.end = at[0::2], at[1::2]
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, data: np.ndarray | None = None, start: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """64-bit names of the byte ranges (by default the words)."""
        data = self.data if data is None else data
        start = self.start if start is None else start
        end = self.end if end is None else end
        return range_hashes(data, start, end)


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, U64)
        np.cumsum((data.astype(U64) + U64(1)) * powers(len(data)), out=sums[1:])
    return sums


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    sums = prefix_hashes(data) if sums is None else sums
    with np.errstate(over="ignore"):
        return mix((sums[end] - sums[start]) * powers(len(data) + 1, "down")[start])


def windows(words: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` words within one text, and the index of each window's first word."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, U64)
        for k in range(size):
            out = out * U64(BASE) + words[k : n + k]
    same = np.flatnonzero(doc[:n] == doc[size - 1 :])
    return mix(out[same], 7), same


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each text have a flag."""
    out = np.zeros(len(offsets) - 1, np.int64)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = np.add.reduceat(flags.view(np.uint8), offsets[full], dtype=np.int64)
    return out


class Memo:
    """Numbers for 64-bit names (0 stands for none) by open addressing in numpy."""

    def __init__(self):
        self.slots = np.zeros(1 << 16, U64)
        self.entry = np.zeros(1 << 16, np.int32)
        self.used = 0

    def find(self, names: np.ndarray) -> np.ndarray:
        """The number of each name, -1 where there is none."""
        out = np.full(len(names), -1, np.int32)
        mask = len(self.slots) - 1
        left, where = np.arange(len(names)), (names & U64(mask)).astype(np.int64)
        while len(left):
            have = self.slots[where]
            hit = have == names[left]
            out[left[hit]] = self.entry[where[hit]]
            on = ~hit & (have != 0)
            left, where = left[on], (where[on] + 1) & mask
        return out

    def _put(self, names: np.ndarray, entries: np.ndarray) -> None:
        mask = len(self.slots) - 1
        left, where = np.arange(len(names)), (names & U64(mask)).astype(np.int64)
        while len(left):
            free = np.flatnonzero(self.slots[where] == 0)
            _, one = np.unique(where[free], return_index=True)
            won = free[one]
            self.slots[where[won]], self.entry[where[won]] = names[left[won]], entries[left[won]]
            on = np.ones(len(left), np.bool_)
            on[won] = False
            left, where = left[on], (where[on] + 1) & mask

    def add(self, names: np.ndarray) -> np.ndarray:
        """Numbers, from the last one on, for distinct names that aren't there yet."""
        entries = np.arange(self.used, self.used + len(names), dtype=np.int32)
        if 3 * (self.used + len(names)) > len(self.slots):
            old, kept = self.slots, self.entry
            size = 1 << int(4 * (self.used + len(names))).bit_length()
            self.slots, self.entry = np.zeros(size, U64), np.zeros(size, np.int32)
            self._put(old[old != 0], kept[old != 0])
        self.used += len(names)
        self._put(names, entries)
        return entries


def spread(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c of counts, one after the other."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def module(name: str):
    return importlib.import_module(name)
