"""Byte-level BPE by overlapping chunks.

A long text is cut into overlapping chunks that are pre-tokenised one by one, each as if
it were a text of its own. Pre-tokenisation has no memory: what is matched from a boundary
depends only on the text after it. So two neighbouring chunks agree from the first
boundary that both have in their overlap, and are stitched there. The pieces are then
encoded by the vocabulary's merge ranks, each distinct piece once per task.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, functions as F

from .common import fresh, row_blocks

VOCABULARY = "byte_bpe_50k.tiktoken"
CHUNK_CHARS = 16_384
OVERLAP_CHARS = 512
#: What follows a match can change it only through the next few characters (a contraction
#: has three); matches ending so close to a cut are not trusted.
MARGIN = 4
#: Memory of the pieces whose codes a task keeps, about; a piece beyond that is encoded again.
CACHE_BYTES = 96 << 20
#: What an entry of the cache takes besides its characters and ids.
ENTRY_BYTES = 200


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def chunk_boundaries(text: str, start: int, stop: int, pattern) -> list[int]:
    """Ends of the matches in ``text[start:stop]`` that the cut at ``stop`` cannot change."""
    ends = [m.end() + start for m in pattern.finditer(text[start:stop])]
    if stop < len(text):
        while ends and ends[-1] > stop - MARGIN:
            ends.pop()
    return ends


def boundaries(text: str, pattern, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[int]:
    """Ends of all pre-tokens of ``text``, from overlapping chunks stitched where they meet."""
    if len(text) <= chunk:
        return [m.end() for m in pattern.finditer(text)]
    ends = chunk_boundaries(text, 0, chunk, pattern)
    reach = chunk
    while reach < len(text):
        start, stop = max(reach - overlap, 0), reach - overlap + chunk
        after = chunk_boundaries(text, start, min(stop, len(text)), pattern)
        known = set(after)
        keep = next((i for i in range(len(ends) - 1, -1, -1) if ends[i] in known or ends[i] <= start), -1)
        if keep >= 0 and ends[keep] in known:
            # all earlier common boundaries agree as well, so the last one is as good as the first
            meet = ends[keep]
            del ends[keep + 1:]
            ends += after[after.index(meet) + 1:]
        else:
            # no meeting point: go on from the last boundary that is certain, further if need be
            sure, stop = (ends[-1] if ends else 0), max(stop, reach + 1)
            after = chunk_boundaries(text, sure, min(stop, len(text)), pattern)
            while not after and stop < len(text):
                stop += stop - sure
                after = chunk_boundaries(text, sure, min(stop, len(text)), pattern)
            ends += after
        reach = min(stop, len(text))
    return ends


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the adjacent pair of lowest rank is merged until none has a rank."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    if len(piece) > 256:
        return _merge_long([piece[i:i + 1] for i in range(len(piece))], ranks)
    get, none = ranks.get, len(ranks) + 1 << 8
    cuts = list(range(len(piece) + 1))  # part i is piece[cuts[i]:cuts[i + 1]]
    pair_ranks = [get(piece[i:i + 2], none) for i in range(len(piece) - 1)]
    while pair_ranks and (best := min(pair_ranks)) != none:
        i = pair_ranks.index(best)
        del cuts[i + 1], pair_ranks[i]
        if i > 0:
            pair_ranks[i - 1] = get(piece[cuts[i - 1]:cuts[i + 1]], none)
        if i < len(pair_ranks):
            pair_ranks[i] = get(piece[cuts[i]:cuts[i + 2]], none)
    return [ranks[piece[a:b]] for a, b in zip(cuts, cuts[1:])]


def _merge_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    """The same for very long pieces: a heap of pairs over a linked list, n log n."""
    import heapq

    n = len(parts)
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1)
            if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = right[i]
        if not alive[i] or j < 0 or parts[i] != a or parts[j] != b:
            continue
        parts[i], alive[j], right[i] = a + b, False, right[j]
        if right[j] >= 0:
            left[right[j]] = i
        for x, y in ((left[i], i), (i, right[i])):
            if x >= 0 and y >= 0 and (r := ranks.get(parts[x] + parts[y])) is not None:
                heapq.heappush(heap, (r, x, parts[x], parts[y]))
    return [ranks[p] for p, on in zip(parts, alive) if on]


class _PieceIds(dict):
    """Ids of the pieces seen lately; it starts anew when it holds about ``cache_bytes``."""

    def __init__(self, ranks: dict[bytes, int], cache_bytes: int):
        super().__init__()
        self.ranks, self.room, self.cache_bytes = ranks, cache_bytes, cache_bytes

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(merge_piece(piece.encode(), self.ranks))  # tuples of ints burden no collector
        self.room -= ENTRY_BYTES + len(piece) + 8 * len(ids)
        if self.room < 0:
            self.clear()
            self.room = self.cache_bytes
        self[piece] = ids
        return ids


def text_encoder(ranks: dict[bytes, int], pattern: str, cache_bytes: int = CACHE_BYTES) -> Callable[[str], list[int]]:
    compiled = regex.compile(pattern)
    piece_ids = _PieceIds(ranks, cache_bytes).__getitem__

    def encode(text: str) -> list[int]:
        if len(text) <= CHUNK_CHARS:
            pieces = compiled.findall(text)
        else:
            ends = boundaries(text, compiled)
            pieces = [text[a:b] for a, b in zip([0, *ends], ends)]
        return list(chain.from_iterable(map(piece_ids, pieces)))

    return encode


def _run(df: DataFrame, work: Callable[[pa.RecordBatch], pa.Array], column: str, kind: str,
         by: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``column`` computed from Arrow batches, a bounded piece of text at a time."""
    kept = [f for f in df.schema.fields if f.name not in drop]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{column}` {kind}"])

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = work()
        for batch in stream:
            for part in task(batch):
                block, values = part
                arrays = [block.column(f.name) for f in kept] + [values]
                yield pa.RecordBatch.from_arrays(arrays, names=[*[f.name for f in kept], column])

    return df.mapInArrow(batches, schema)


def encode_documents(docs: DataFrame, text_col: str = "text", ids_col: str = "token_ids",
                     path: str | None = None, pattern: str = public_tokenizers.PATTERN,
                     drop_text: bool = False) -> DataFrame:
    """``docs`` with ``ids_col array<int>``: the ids of the whole text, no special tokens.

    A null or empty text has no ids. Every row is encoded on its own, so repeated rows,
    null ids and further columns pass through; an input column named like ``ids_col`` is
    replaced, and an empty table stays empty. ``path`` must name a rank file that every worker has.
    """
    path = path or public_tokenizers.path(VOCABULARY)

    def work():
        encode = text_encoder(load_ranks(path), pattern)

        def task(batch):
            for block, _, _ in row_blocks(batch, text_col):
                ids = [np.array(encode(t or ""), np.int32) for t in block.column(text_col).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                yield block, pa.ListArray.from_arrays(ends, np.concatenate(ids))
        return task

    drop = (ids_col, text_col) if drop_text else (ids_col,)
    return _run(docs, work, ids_col, "array<int>", text_col, drop)


def decode_documents(encoded: DataFrame, ids_col: str = "token_ids", bytes_col: str = "decoded",
                     path: str | None = None) -> DataFrame:
    """``encoded`` with ``bytes_col binary``: the raw bytes of the ids, concatenated (a null
    list gives no bytes). An id outside the vocabulary raises a KeyError."""
    path = path or public_tokenizers.path(VOCABULARY)

    def work():
        token = {rank: piece for piece, rank in load_ranks(path).items()}.__getitem__

        def task(batch):
            for start in range(0, batch.num_rows, 256):
                block = batch.slice(start, 256)
                texts = [b"".join(map(token, ids.values.to_numpy().tolist() if ids.is_valid else ()))
                         for ids in block.column(ids_col)]
                yield block, pa.array(texts, pa.binary())
        return task

    return _run(encoded, work, bytes_col, "binary", ids_col, (bytes_col,))


def bpe_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                pattern: str = public_tokenizers.PATTERN, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """Per row: id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``.

    Texts are encoded and their ids decoded again in one worker, so that ids never leave it. A null
    text counts as empty, null ids and repeated rows pass through, other columns are ignored,
    whatever their names, and an empty table gives an empty result. ``cache_bytes`` bounds what
    a worker keeps of pieces it has encoded.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    name = fresh(id_col, ["n_tokens", "ids_sha256", "decoded_sha256"])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(path)
        encode = text_encoder(ranks, pattern, cache_bytes)
        token = {rank: piece for piece, rank in ranks.items()}.__getitem__
        decimal = {rank: str(rank) for rank in ranks.values()}.__getitem__
        for batch in stream:
            for block, _, _ in row_blocks(batch, "text"):
                rows = []
                for text in block.column("text").to_pylist():
                    ids = encode(text or "")
                    rows.append((len(ids), sha256(" ".join(map(decimal, ids)).encode()).hexdigest(),
                                 sha256(b"".join(map(token, ids))).hexdigest()))
                n, of_ids, of_bytes = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [block.column("id"), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_bytes)],
                    names=[name, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(run, f"`{name}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
