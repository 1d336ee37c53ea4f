"""Removal of repeated byte strings by external induced suffix sorting.

Every window of ``WINDOW`` bytes is named by the smallest hash among its ``GRAM``-byte
pieces; equal windows have equal names. Neighbouring windows of one name form a fragment.
Names that occur once in the corpus cannot repeat, so only fragments of repeated names are
sent on: to the shard of their name, identical ones of a block once. A shard sorts the
suffixes of its fragments by induction (``induced_sorting``), with texts in a mapped file
and queues on disk once they are large; neighbours in that order that share ``WINDOW``
bytes are one class, of which the earliest (document, start) stays. Equal texts are one
document in all of this; the later copies go as a whole.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .block_keys import ANSWER_SCHEMA, SENT_SCHEMA, answer_blocks, key_bits, received, sent_rows
from .common import BASE, BASE_INVERSE, checkpointed, mix64, powers, row_blocks, text_or_empty
from .induced_sorting import PIECE_END, TEXT_END, sorted_suffixes

WINDOW = 100
#: Bytes of the pieces that name a window; it has WINDOW - GRAM + 1 of them.
GRAM = 32
BLOCK_TEXT = 8 << 20
BUCKET_KEYS = 2_000_000
#: Bytes that one numpy step handles at once.
STEP_BYTES = 2 << 20
#: A shard's fragments stay in memory up to this many bytes, then in a mapped file.
SHARD_BYTES = 64 << 20


def _sliding(function, values: np.ndarray, width: int) -> np.ndarray:
    """``function`` (minimum or maximum) of every ``width`` neighbours."""
    span = 1
    while 2 * span <= width:
        values = function(values[:-span], values[span:])
        span *= 2
    return function(values[:span - width], values[width - span:]) if width > span else values


def fragments(data: np.ndarray, offsets: np.ndarray):
    """(row, start in the row, windows, name, digest) of every fragment of a block of texts, and
    the names of all pieces that name a window, once for every place."""
    n, width = len(data), WINDOW - GRAM + 1
    none, names = np.empty(0, np.int64), np.empty(0, np.uint64)
    if n < WINDOW:
        return none, none, none, names, names, names
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, n)[:n], out=sums[1:])
    inverse = powers(BASE_INVERSE, n)
    grams = mix64((sums[GRAM:] - sums[:-GRAM]) * inverse[:n - GRAM + 1])
    least = _sliding(np.minimum, grams, width)
    inside = np.zeros(len(least) + 1, np.int8)
    long_rows = np.flatnonzero(np.diff(offsets) >= WINDOW)
    firsts = offsets[long_rows]
    inside[firsts] += 1
    inside[offsets[long_rows + 1] - WINDOW + 1] -= 1
    valid = np.cumsum(inside[:-1]) > 0
    new = np.ones(len(least), bool)
    new[1:] = least[1:] != least[:-1]
    new[firsts] = True
    starts = np.flatnonzero(valid & new)
    row = np.searchsorted(offsets, starts, "right") - 1
    ends = np.minimum(np.r_[starts[1:], n], offsets[row + 1] - WINDOW + 1)
    stop = ends + WINDOW - 1
    digest = mix64((sums[stop] - sums[starts]) * inverse[starts] + (stop - starts).astype(np.uint64))
    # a piece names a window if it is not above the largest name of the windows it is in
    around = np.zeros(len(least) + 2 * (width - 1), np.uint64)
    around[width - 1:len(least) + width - 1] = np.where(valid, least, np.uint64(0))
    naming = grams[grams == _sliding(np.maximum, around, width)]
    return row, starts - offsets[row], ends - starts, least[starts], digest, naming


def text_digest(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "big", signed=True)


def _describe(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        for block, data, offsets in row_blocks(batch, "text"):
            raw = data.tobytes()
            digests = [text_digest(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [block.column("id"), pa.array(digests, pa.int64()), pa.array(np.diff(offsets), pa.int64())],
                names=["id", "digest", "n_bytes"])


class _Block:
    """The documents a block stands for, by (id, digest), and their fragments in that order."""

    def __init__(self, docs: pa.Table, wanted: set[tuple[int, int]]):
        texts = {}
        for batch in docs.select(["id", "text"]).to_batches():
            for block, data, offsets in row_blocks(batch, "text"):
                for i, a, b in zip(block.column("id").to_pylist(), offsets[:-1], offsets[1:]):
                    key = (i, text_digest(data[a:b].tobytes()))
                    if key in wanted:
                        texts[key] = data[a:b]
        self.documents = sorted(texts)
        self.texts = [texts[key] for key in self.documents]
        parts = [[] for _ in range(6)]
        at = 0
        while at < len(self.texts):
            stop, size = at, 0
            while stop < len(self.texts) and (stop == at or size + len(self.texts[stop]) <= STEP_BYTES):
                size += len(self.texts[stop])
                stop += 1
            offsets = np.cumsum([0, *map(len, self.texts[at:stop])])
            found = fragments(np.concatenate(self.texts[at:stop]), offsets)
            for part, values in zip(parts, (found[0] + at, *found[1:])):
                part.append(values)
            at = stop
        empty = [np.empty(0, np.int64)] * 3 + [np.empty(0, np.uint64)] * 3
        self.row, self.start, self.windows, self.name, self.digest, self.naming = (
            [np.concatenate(p) for p in parts] if parts[0] else empty)

    def keys(self, shift: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct short names and how many pieces of the block have each."""
        return np.unique(self.naming >> np.uint64(shift), return_counts=True)

    def first_of_equal(self) -> np.ndarray:
        """Whether a fragment is the block's first with its content."""
        _, first = np.unique(self.digest, return_index=True)
        out = np.zeros(len(self.digest), bool)
        out[first] = True
        return out


def _wanted(side: pa.Table) -> set[tuple[int, int]]:
    return {(i, d) for i, d in zip(side.column("id").to_pylist(), side.column("digest").to_pylist()) if d is not None}


def _send(buckets: int, bits: int):
    def send(docs: pa.Table, nodes: pa.Table) -> pa.Table:
        keys, counts = _Block(docs, _wanted(nodes)).keys(64 - bits)
        number = docs.column("block")[0].as_py() if docs.num_rows else -1
        return sent_rows(number, keys, counts, buckets, bits)

    return send


FRAGMENT_SCHEMA = ("name bigint, content bigint, id bigint, digest bigint, start bigint, windows bigint, block bigint, "
                   "bytes binary")
_FRAGMENT = pa.schema([(c, pa.int64()) for c in ("name", "content", "id", "digest", "start", "windows", "block")]
                      + [("bytes", pa.binary())])
RANGE_SCHEMA = "block bigint, id bigint, digest bigint, start bigint, stop bigint"
_RANGE = pa.schema([(c, pa.int64()) for c in ("block", "id", "digest", "start", "stop")])


def _emit(bits: int):
    """Fragments whose name occurs more than once; of a block's identical ones the first."""
    def emit(docs: pa.Table, side: pa.Table) -> pa.Table:
        block = _Block(docs, _wanted(side))
        shift = np.uint64(64 - bits)
        repeated = block.keys(64 - bits)[0][received(side) > 1]
        chosen = np.flatnonzero(np.isin(block.name >> shift, repeated) & block.first_of_equal())
        if not len(chosen):
            return _FRAGMENT.empty_table()
        number = docs.column("block")[0].as_py()
        row, start, windows = block.row[chosen], block.start[chosen], block.windows[chosen]
        keys = np.array(block.documents, np.int64)[row]
        pieces = [block.texts[r][s:s + w + WINDOW - 1].tobytes() for r, s, w in zip(row, start, windows)]
        return pa.table([block.name[chosen].view(np.int64), block.digest[chosen].view(np.int64), keys[:, 0], keys[:, 1],
                         start, windows, np.full(len(chosen), number), pa.array(pieces, pa.binary())], schema=_FRAGMENT)

    return emit


class _Shard:
    """Distinct fragments of a shard, one after the other with a mark after each."""

    def __init__(self):
        self.file = tempfile.TemporaryFile()
        self.size, self.rows = 0, []

    def add(self, fragment: dict) -> None:
        symbols = np.frombuffer(fragment["bytes"], np.uint8).astype(np.uint16) + 2
        self.rows.append((self.size, fragment["windows"], fragment["id"], fragment["digest"], fragment["start"],
                          fragment["block"]))
        self.file.write(symbols.tobytes())
        self.file.write(np.array([PIECE_END], np.uint16).tobytes())
        self.size += len(symbols) + 1

    def text(self) -> np.ndarray:
        self.file.write(np.array([TEXT_END], np.uint16).tobytes())
        self.file.flush()
        if 2 * self.size > SHARD_BYTES:
            return np.memmap(self.file, np.uint16, "r", shape=(self.size + 1,))
        self.file.seek(0)
        return np.frombuffer(self.file.read(), np.uint16)


def repeated_windows(text: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """(fragment, offset) of all windows that are not the earliest of their class; ``rows`` has
    position, windows, id, digest and start of the fragments in their order in ``text``."""
    at = rows[:, 0]
    late: list[np.ndarray] = []
    edges = np.zeros(len(text) + 1, np.int8)
    edges[at] += 1
    edges[at + rows[:, 1]] -= 1
    is_window = np.cumsum(edges[:-1], dtype=np.int8).astype(bool)

    def compare(windows: np.ndarray) -> None:
        """Finds the classes among ``windows``, text positions in suffix order. Suffixes with other
        first symbols are in other lists, so every class is complete."""
        if len(windows) < 2:
            return
        equal = _equal_neighbours(text, windows)
        shared = np.r_[equal, False] | np.r_[False, equal]
        group = np.r_[0, np.cumsum(~equal)][shared]
        windows = windows[shared]
        fragment = np.searchsorted(at, windows, "right") - 1
        offset = windows - at[fragment]
        order = np.lexsort((rows[fragment, 4] + offset, rows[fragment, 3], rows[fragment, 2], group))
        again = np.r_[np.zeros(min(1, len(order)), bool), group[order[1:]] == group[order[:-1]]]
        late.append(np.stack([fragment[order[again]], offset[order[again]]], 1))

    for positions in sorted_suffixes(text, WINDOW + 28):
        compare(positions[is_window[positions]])
    return np.concatenate(late) if late else np.empty((0, 2), np.int64)


def _equal_neighbours(text: np.ndarray, windows: np.ndarray, step: int = 65_536) -> np.ndarray:
    """Whether each window shares its first ``WINDOW`` symbols with the one before in the list."""
    views = np.lib.stride_tricks.sliding_window_view(text, WINDOW)
    out = np.empty(len(windows) - 1, bool)
    for i in range(0, len(out), step):
        a, b = windows[i:i + step][:len(out) - i], windows[i + 1:i + 1 + step]
        same = text[a + WINDOW - 1] == text[b + WINDOW - 1]
        same[same] = text[a[same] + WINDOW // 2] == text[b[same] + WINDOW // 2]
        same[same] = (views[a[same]] == views[b[same]]).all(1)
        out[i:i + step] = same
    return out


def _sort_shard(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Byte ranges of the fragments that repeat earlier ones. The rows come sorted by name and
    content, earliest first: of identical fragments only the first is sorted, the others are
    repeats as a whole."""
    shard, known = _Shard(), None
    for batch in stream:
        whole = []
        for f in batch.to_pylist():
            content = (f["name"], f["content"], f["windows"])
            if content == known:
                whole.append((f["block"], f["id"], f["digest"], f["start"], f["start"] + f["windows"] + WINDOW - 1))
            else:
                known = content
                shard.add(f)
        if whole:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*whole)], schema=_RANGE)
    if not shard.rows:
        return
    rows = np.array(shard.rows, np.int64)
    late = repeated_windows(shard.text(), rows)
    if not len(late):
        return
    late = late[np.lexsort((late[:, 1], late[:, 0]))]
    new = np.r_[True, (late[1:, 0] != late[:-1, 0]) | (late[1:, 1] != late[:-1, 1] + 1)]
    first = late[new]
    last = late[np.r_[new[1:], True]]
    of = rows[first[:, 0]]
    start = of[:, 4] + first[:, 1]
    stop = of[:, 4] + last[:, 1] + WINDOW
    for i in range(0, len(first), 100_000):
        cut = slice(i, i + 100_000)
        yield pa.RecordBatch.from_arrays(
            [pa.array(v[cut], pa.int64()) for v in (of[:, 5], of[:, 2], of[:, 3], start, stop)], schema=_RANGE)


def _remove(docs: pa.Table, side: pa.Table) -> pa.Table:
    """What is left of every document of a block."""
    nodes = side.filter(pc.is_null(side.column("start")))
    block = _Block(docs, _wanted(nodes))
    number = {key: i for i, key in enumerate(block.documents)}
    covered = [np.zeros(len(t) + 1, np.int32) for t in block.texts]
    again = np.flatnonzero(~block.first_of_equal())
    for r, s, w in zip(block.row[again], block.start[again], block.windows[again]):
        covered[r][s] += 1
        covered[r][s + w + WINDOW - 1] -= 1
    ranges = side.filter(pc.is_valid(side.column("start")))
    for i, d, s, e in zip(*(ranges.column(c).to_pylist() for c in ("id", "digest", "start", "stop"))):
        cover = covered[number[i, d]]
        cover[s] += 1
        cover[e] -= 1
    results = {}
    for key, text, cover in zip(block.documents, block.texts, covered):
        gone = np.cumsum(cover[:-1]) > 0
        spans = int(gone[0] if len(gone) else 0) + int((gone[1:] & ~gone[:-1]).sum())
        results[key] = (int(gone.sum()), spans, hashlib.sha256(text[~gone].tobytes()).hexdigest())
    out = []
    for i, text in zip(docs.column("id").to_pylist(), docs.column("text").to_pylist()):
        raw = text.encode()
        found = results.get((i, text_digest(raw)))
        if found is None:  # an earlier document has the same text
            found = (len(raw), 1, hashlib.sha256(b"").hexdigest()) if len(raw) >= WINDOW else (
                0, 0, hashlib.sha256(raw).hexdigest())
        out.append((i, len(raw), *found))
    return pa.table([list(c) for c in zip(*out)] if out else [[]] * 5, schema=pa.schema(
        [("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
         ("kept_sha256", pa.string())]))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256`` after removing each
    byte covered by a ``WINDOW``-byte string that also starts earlier in the corpus (by id,
    then start), judged on the whole input.

    Null text counts as empty. Texts shorter than a window lose nothing and repeat nothing.
    Repeated rows (same id, same text) are one document with one result; rows with one id
    and different texts are ordered by a digest of the text. Rows with a null id are earlier
    and later than nothing: they are returned whole. Other columns are ignored. An empty
    table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text_or_empty(text_col).alias("text"))
    described = checkpointed(rows.where("id is not null").mapInArrow(_describe, "id bigint, digest bigint, n_bytes bigint"))
    size = described.agg(F.sum("n_bytes")).first()[0] or 0
    blocks = max(8, -(-size // BLOCK_TEXT))
    # names change about every (WINDOW - GRAM) / 2 bytes
    buckets = max(8, -(-size // 35 // BUCKET_KEYS))
    bits = key_bits(size // 35)

    def block_of(column: str):
        return F.pmod(F.xxhash64(column), F.lit(blocks)).alias("block")

    nodes = (described.groupBy("digest", "n_bytes").agg(F.min("id").alias("id"))
             .select("id", "digest", block_of("id")))
    nodes = checkpointed(nodes)
    dealt = rows.where("id is not null").select("id", "text", block_of("id")).repartition(blocks, "block").groupBy("block")
    sent = dealt.cogroup(nodes.groupBy("block")).applyInArrow(_send(buckets, bits), SENT_SCHEMA)
    answers = sent.groupBy("bucket").applyInArrow(answer_blocks(lambda n: np.minimum(n, 2)), ANSWER_SCHEMA)
    side = answers.unionByName(nodes, allowMissingColumns=True)
    found = dealt.cogroup(side.groupBy("block")).applyInArrow(_emit(bits), FRAGMENT_SCHEMA)
    shards = (found.repartition(2 * blocks, "name")
              .sortWithinPartitions("name", "content", "windows", "id", "digest", "start"))
    ranges = checkpointed(shards.mapInArrow(_sort_shard, RANGE_SCHEMA))
    side = ranges.unionByName(nodes, allowMissingColumns=True)
    kept = dealt.cogroup(side.groupBy("block")).applyInArrow(
        _remove, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    whole = rows.where("id is null").select(
        "id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.lit(0).cast("bigint").alias("n_removed"),
        F.lit(0).cast("bigint").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))
    return kept.unionByName(whole).withColumnRenamed("id", id_col)
