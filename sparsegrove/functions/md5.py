"""MD5 of very many short texts at once in numpy, for the smallest hash of pairs (``pick_key``)."""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import numpy as np
import pyarrow as pa

START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
SINE = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
TURN = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
WORD = [lambda i: i, lambda i: (5 * i + 1) % 16, lambda i: (3 * i + 5) % 16, lambda i: (7 * i) % 16]
#: Bytes that one block of a hash holds beside its length; hashes worked out at once.
BLOCK_BYTES, AT_ONCE = 55, 1 << 16


def words(texts: list[bytes], at: int) -> np.ndarray:
    """Texts of one length, from the byte ``at`` on, as the 16 words of a block by text."""
    out = np.zeros((len(texts), 64), np.uint8)
    out[:, at : at + len(texts[0])] = np.frombuffer(b"".join(texts), np.uint8).reshape(len(texts), -1)
    return out.view("<u4").T.astype(np.uint32)


def first_words(message: list) -> np.ndarray:
    """The first four bytes of the hashes, as numbers in their order; message: 16 words, numbers or arrays that broadcast.

    The last three of the 64 steps give the other bytes.
    """
    shape = np.broadcast_shapes(*(np.shape(m) for m in message))
    a, b, c, d = (np.full(shape, x, np.uint32) for x in START)
    t = np.empty(shape, np.uint32)
    for i in range(61):
        kind = i // 16
        if kind == 0:
            np.bitwise_and(np.bitwise_xor(c, d, out=t), b, out=t)
            t ^= d
        elif kind == 1:
            np.bitwise_and(np.bitwise_xor(b, c, out=t), d, out=t)
            t ^= c
        elif kind == 2:
            np.bitwise_xor(np.bitwise_xor(b, c, out=t), d, out=t)
        else:
            np.bitwise_or(np.invert(d, out=t), b, out=t)
            t ^= c
        a += t
        m = message[WORD[kind](i)]
        if np.ndim(m):
            a += m
            a += np.uint32(SINE[i])
        else:
            a += np.uint32((int(m) + SINE[i]) % 2**32)
        turn = TURN[kind][i % 4]
        np.left_shift(a, np.uint32(turn), out=t)
        a >>= np.uint32(32 - turn)
        a |= t
        a += b
        a, b, c, d = d, a, b, c
    b += np.uint32(START[0])
    return b.byteswap()


def smallest(left: list[bytes], right: list[bytes], seed: bytes) -> list[tuple[str, int] | None]:
    """For each left text the smallest hash of seed|left|right over the right texts that differ from it, and that text's place."""
    best: list = [None] * len(left)

    def offer(row: int, places) -> None:
        for j in places:
            if left[row] != right[j]:
                key = hashlib.md5(b"|".join((seed, left[row], right[j])), usedforsecurity=False).hexdigest()
                if best[row] is None or (key, j) < best[row]:
                    best[row] = key, j

    by_length: tuple[dict, dict] = defaultdict(list), defaultdict(list)
    for side, texts in zip(by_length, (left, right)):
        for k, text in enumerate(texts):
            side[len(text)].append(k)
    for long, rows in by_length[0].items():
        at = len(seed) + long + 2
        heads = words([b"|".join((seed, left[k], b"")) for k in rows], 0)
        for short, others in by_length[1].items():
            if at + short > BLOCK_BYTES:
                for row in rows:
                    offer(row, others)
                continue
            tails = words([right[j] + b"\x80" for j in others], at)
            where = {right[j]: n for n, j in enumerate(others)} if long == short else {}
            number, step = np.array(others), max(1, AT_ONCE // len(others))
            for low in range(0, len(rows), step):
                own = rows[low : low + step]
                message: list = []
                for w in range(16):
                    head, tail = heads[w, low : low + step, None] if 4 * w < at else None, tails[w][None, :] if at // 4 <= w <= (at + short) // 4 else None
                    message.append(8 * (at + short) if w == 14 else 0 if head is None and tail is None else head if tail is None else tail if head is None else head | tail)
                found = first_words(message)
                for n, row in enumerate(own):
                    if left[row] in where:
                        found[n, where[left[row]]] = 0xFFFFFFFF
                low_ = found.min(axis=1)
                at_row, at_place = np.nonzero(found == low_[:, None])
                for n, j in zip(at_row.tolist(), number[at_place].tolist()):
                    offer(own[n], (j,))
    return best


def smallest_batches(batches, seed: str):
    """(paper, k, doc_id) of rows of blocks (papers, their texts, ids, their texts): each paper's smallest hash with one of the ids."""
    for rows in batches:
        for i in range(rows.num_rows):
            papers, left, ids, right = (rows.column(c)[i].values for c in range(4))
            found = smallest([x.encode() for x in left.to_pylist()], [x.encode() for x in right.to_pylist()], seed.encode())
            on = [n for n, best in enumerate(found) if best is not None]
            columns = [papers.take(pa.array(on, pa.int64())), pa.array([found[n][0] for n in on], pa.string()), ids.take(pa.array([found[n][1] for n in on], pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["paper", "k", "doc_id"])
