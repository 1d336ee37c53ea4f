"""Counting keys of document blocks over the whole corpus, and answering each block.

A block sends its distinct keys, ascending, as compressed gaps to buckets (equal ranges of
the key space); a bucket adds the blocks' counts up and answers each block with one byte
per key, in the block's own order. Nothing per key is ever a row.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa

SENT_SCHEMA = "bucket int, block bigint, keys binary, counts binary"
ANSWER_SCHEMA = "block bigint, bucket int, codes binary"
_SENT = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])


def key_bits(total: int) -> int:
    """Enough bits of a hash to tell a key from all others but for one in some thousands."""
    return min(64, max(1, total).bit_length() + 13)


def pack(ascending: np.ndarray) -> bytes:
    """Ascending numbers as compressed gaps, byte by byte, so that equal high bytes meet."""
    gaps = np.diff(ascending, prepend=np.uint64(0))
    return zlib.compress(gaps.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def sent_rows(block: int, keys: np.ndarray, counts: np.ndarray, buckets: int, bits: int) -> pa.Table:
    """A block's ascending distinct ``keys`` (of ``bits`` bits) and their counts, by bucket."""
    edges = np.array([i * (1 << bits) // buckets for i in range(1, buckets)], np.uint64)
    cuts = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]]).astype(np.int64)
    rows = [(b, block, pack(keys[i:j]), zlib.compress(counts[i:j].astype(np.uint32).tobytes(), 1))
            for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])) if j > i]
    return pa.table([list(c) for c in zip(*rows)], schema=_SENT) if rows else _SENT.empty_table()


def answer_blocks(code: Callable[[np.ndarray], np.ndarray]) -> Callable[[pa.Table], pa.Table]:
    """For every block of a bucket: ``code`` of the total count of each of its keys, one byte each."""
    def answer(table: pa.Table) -> pa.Table:
        keys = [unpack(k) for k in table.column("keys").to_pylist()]
        counts = [np.frombuffer(zlib.decompress(c), np.uint32) for c in table.column("counts").to_pylist()]
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(place, np.concatenate(counts), len(distinct)).astype(np.int64)
        codes = np.split(code(sums).astype(np.uint8)[place], np.cumsum([len(k) for k in keys])[:-1])
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"),
                         "codes": pa.array([zlib.compress(c.tobytes(), 1) for c in codes], pa.binary())})

    return answer


def received(side: pa.Table) -> np.ndarray:
    """The answers of all buckets to one block, in the order of its keys."""
    answers = sorted((b, c) for b, c in zip(side.column("bucket").to_pylist(), side.column("codes").to_pylist())
                     if c is not None)
    return np.frombuffer(b"".join(zlib.decompress(c) for _, c in answers), np.uint8)
