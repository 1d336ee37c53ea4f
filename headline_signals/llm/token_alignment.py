"""Alignment of two tokenizers by galloping intersection of their token ends.

Vocabulary A is byte-level BPE over a space and the text, vocabulary B pieces over the text
(it adds the space itself), so that both cover the same bytes. The ends of a document's
tokens are two ascending lists of byte offsets; where an offset is in both, A and B tokens
meet and a group ends. The shorter list drives: each of its ends is sought in the longer one
from where the one before was found, in steps that double until they pass it, and then by
halving. Many stretches of the lists gallop side by side, as lanes of one numpy step. The
indices found cut both token lists into groups, and the differences of their ranks say how
many tokens of A overlap how many of B.

How many documents hold an id pair is counted over the corpus: a block of documents sends
its distinct pairs, ascending and packed, to buckets of pairs; a bucket adds the blocks' counts
up and answers each block in its own order. Texts are read and encoded once; what stays of
them is a packed list of pairs per block. A pair that every document holds is one entry per
block. The highest count of each A id is a table of at most one number per vocabulary entry.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, functions as F

from .block_keys import pack, unpack
from .common import fresh, partitions_for, row_blocks, written

VOCABULARY_A = "byte_bpe_50k.json"
VOCABULARY_B = "piece_bpe_32k.model"
#: Text that is encoded and aligned at once, and text of a block that sends its pairs together.
STEP_BYTES = 1 << 19
BLOCK_BYTES = 8 << 20
#: Ends that one galloping lane walks one after the other.
LANE = 64
#: A group of more pairs than this is first reduced to its distinct ids.
WIDE_GROUP = 4096
#: Packed bytes of all blocks in one bucket, on average.
BUCKET_BYTES = 4 << 20
#: An id pair as one number: the B id takes the low bits.
B_BITS = 20

_BLOCK = ("block bigint, ids array<{id}>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, "
          "n_links array<bigint>, sha array<string>, keys binary, holders binary, at binary, times binary, splits array<bigint>")


class ByteBpe:
    """Vocabulary A: ids, and the bytes of every id, from a byte-level BPE file in JSON.

    The file's merges are in the order of the ids they make (checked), so an id is its rank;
    the ranks go to ``tiktoken``. A text that its pattern engine gives up on is encoded by
    ``tokenizers`` from the same file.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        made = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in model["merges"]]
        if any(a >= b for a, b in zip(made, made[1:])):
            raise ValueError(f"{path}: merges are not in the order of their ids")
        byte_of = {c: b for b, c in enumerate(_byte_letters())}
        self.bytes_of = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token)
        self.path, self._slow = path, None
        self._fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                       mergeable_ranks={self.bytes_of[i]: i for i in vocab.values()}).encode_ordinary

    def encode(self, text: str) -> list[int]:
        try:
            return self._fast(text)
        except BaseException as e:  # noqa: BLE001 - the engine's panic is no Exception
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            if self._slow is None:
                from tokenizers import Tokenizer
                self._slow = Tokenizer.from_file(self.path)
                self._slow.encode_special_tokens = True
            return self._slow.encode(text, add_special_tokens=False).ids


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1
    characters for themselves, the others numbered from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256))
    return [chr(b) if b in shown else chr(256 + next(hidden)) for b in range(256)]


class PieceBpe:
    """Vocabulary B: ids, and the bytes of every id, from a sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.bytes_of = [bytes([int(p[1:-1], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()
                         for i, p in enumerate(pieces)]
        self._encode = model.encode

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        return self._encode(texts, num_threads=1)


def gallop(short: np.ndarray, long: np.ndarray, lane: int = LANE) -> np.ndarray:
    """For every number of ascending ``short``, the first place in ascending ``long`` whose number
    is not smaller. Lanes of ``lane`` numbers walk side by side."""
    n, m = len(short), len(long)
    out = np.empty(n, np.int64)
    starts = np.arange(0, n, lane)
    finger = np.full(len(starts), -1, np.int64)  # long[finger] < the number sought
    for step in range(min(lane, n)):
        at = starts + step
        at = at[at < n]
        finger = finger[:len(at)]
        sought = short[at]
        # exponential search: double the stride while the number there is smaller
        low, stride = finger.copy(), np.ones(len(at), np.int64)
        high = np.minimum(low + stride, m)
        going = np.flatnonzero((high < m) & (long[np.minimum(high, m - 1)] < sought))
        while len(going):
            low[going] = high[going]
            stride[going] *= 2
            high[going] = np.minimum(low[going] + stride[going], m)
            h = high[going]
            going = going[(h < m) & (long[np.minimum(h, m - 1)] < sought[going])]
        # binary search between the last smaller place and the first that is not
        open_ = np.flatnonzero(high - low > 1)
        while len(open_):
            middle = (low[open_] + high[open_]) // 2
            smaller = long[middle] < sought[open_]
            low[open_] = np.where(smaller, middle, low[open_])
            high[open_] = np.where(smaller, high[open_], middle)
            open_ = open_[high[open_] - low[open_] > 1]
        out[at] = high
        finger = high - 1
    return out


def common_ends(ends_a: np.ndarray, ends_b: np.ndarray, splits_a: np.ndarray,
                splits_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices into ``ends_a`` and ``ends_b`` (both ascending through all documents) of the ends
    that are in both. In every document the shorter list is sought in the longer."""
    n_a, n_b = np.diff(splits_a), np.diff(splits_b)
    a_short = n_a <= n_b
    in_a, in_b = np.repeat(a_short, n_a), np.repeat(a_short, n_b)
    index_a, index_b = np.arange(len(ends_a)), np.arange(len(ends_b))
    found_a, found_b = [], []
    for short, long, from_a in (((ends_a, index_a, in_a), (ends_b, index_b, in_b), True),
                                ((ends_b, index_b, ~in_b), (ends_a, index_a, ~in_a), False)):
        short, short_index = short[0][short[2]], short[1][short[2]]
        long, long_index = long[0][long[2]], long[1][long[2]]
        if not len(short):
            continue
        place = gallop(short, long)
        hit = place < len(long)
        hit[hit] = long[place[hit]] == short[hit]
        at_short, at_long = short_index[hit], long_index[place[hit]]
        found_a.append(at_short if from_a else at_long)
        found_b.append(at_long if from_a else at_short)
    if not found_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # a document is wholly in one of the two lists, so sorting brings both into the same order
    return np.sort(np.concatenate(found_a)), np.sort(np.concatenate(found_b))


def link_counts(doc: np.ndarray, a: np.ndarray, b: np.ndarray, end_a: np.ndarray,
                end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, pair key, links) of all pairs of tokens that share a group, each pair of ids once
    a document; ``doc``: the document of each group, ``end_a``, ``end_b``: its last tokens."""
    n_a, n_b = np.diff(end_a, prepend=-1), np.diff(end_b, prepend=-1)
    wide = n_a * n_b > WIDE_GROUP
    docs, keys, times = [], [], []
    if not wide.all():
        g = np.flatnonzero(~wide)
        size = n_a[g] * n_b[g]
        group = np.repeat(g, size)
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        in_a, in_b = np.divmod(within, n_b[group])
        first_a, first_b = end_a[group] - n_a[group] + 1, end_b[group] - n_b[group] + 1
        docs.append(doc[group])
        keys.append(a[first_a + in_a] << B_BITS | b[first_b + in_b])
        times.append(np.ones(len(group), np.int64))
    for g in np.flatnonzero(wide):
        some_a, k_a = np.unique(a[end_a[g] - n_a[g] + 1:end_a[g] + 1], return_counts=True)
        some_b, k_b = np.unique(b[end_b[g] - n_b[g] + 1:end_b[g] + 1], return_counts=True)
        keys.append((some_a[:, None] << B_BITS | some_b[None, :]).ravel())
        times.append((k_a[:, None] * k_b[None, :]).ravel())
        docs.append(np.full(len(keys[-1]), doc[g]))
    if not keys:
        return (np.empty(0, np.int64),) * 3
    docs, keys, times = np.concatenate(docs), np.concatenate(keys), np.concatenate(times)
    order = np.lexsort((keys, docs)) if docs.max(initial=0) >> (62 - 17 - B_BITS) else np.argsort(
        docs << (17 + B_BITS) | keys)
    docs, keys = docs[order], keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (keys[1:] != keys[:-1])
    at = np.flatnonzero(new)
    return docs[at], keys[at], np.add.reduceat(times[order], at) if len(at) else at


class Aligner:
    """Both vocabularies of a task, and what is computed from them for a step of documents."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteBpe(path_a), PieceBpe(path_b)
        self.length_a = np.array([len(t) for t in self.a.bytes_of], np.int64)
        self.length_b = np.array([len(t) for t in self.b.bytes_of], np.int64)
        if len(self.length_a) >> 17 or len(self.length_b) >> B_BITS:
            raise ValueError("a vocabulary has too many entries for a pair key")
        # decimal ids with what follows them: a comma, or the end of their side of the group
        self.written = [f"{i}{after}".encode() for n, last in ((len(self.length_a), "|"), (len(self.length_b), ";"))
                        for i in range(n) for after in (",", last)]

    def align(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], tuple[np.ndarray, ...]]:
        """(documents x n_a, n_b, n_groups, n_links), their group digests, and ``link_counts``."""
        texts = [t or "" for t in texts]
        ids_a = [self.a.encode(" " + t) if t else [] for t in texts]
        ids_b = self.b.encode_all(texts)
        bytes_a, bytes_b = self.a.bytes_of.__getitem__, self.b.bytes_of.__getitem__
        for i, t in enumerate(texts):
            said = (" " + t).encode()
            if not t or b"".join(map(bytes_a, ids_a[i])) != said or b"".join(map(bytes_b, ids_b[i])) != said:
                ids_a[i], ids_b[i] = [], []
        n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
        a, b = (np.array([i for x in ids for i in x], np.int64) for ids in (ids_a, ids_b))
        splits_a, splits_b = np.append(0, np.cumsum(n_a)), np.append(0, np.cumsum(n_b))
        # ends go on through the documents, so that both lists ascend throughout
        end_a, end_b = common_ends(np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b]), splits_a, splits_b)
        doc = np.searchsorted(splits_a, end_a, "right") - 1
        n_groups = np.bincount(doc, minlength=len(texts))
        links = link_counts(doc, a, b, end_a, end_b)
        n_links = np.bincount(doc, np.diff(end_a, prepend=-1) * np.diff(end_b, prepend=-1), len(texts)).astype(np.int64)
        return (np.stack([n_a, n_b, n_groups, n_links]),
                self._digests(a, b, end_a, end_b, splits_a + splits_b), links)

    def _digests(self, a, b, end_a, end_b, splits) -> list[str]:
        """SHA-256 of ``a1,a2|b1;a3|b2,b3`` per document: both token lists interleaved by group."""
        codes = np.empty(len(a) + len(b), np.int64)
        before_b = np.append(0, end_b + 1)  # B tokens up to the end of each group
        group_a = np.searchsorted(end_a, np.arange(len(a)))
        group_b = np.searchsorted(end_b, np.arange(len(b)))
        codes[np.arange(len(a)) + before_b[group_a]] = 2 * a + np.isin(np.arange(len(a)), end_a, assume_unique=True)
        codes[np.arange(len(b)) + (end_a[group_b] + 1)] = (
            2 * (len(self.length_a) + b) + np.isin(np.arange(len(b)), end_b, assume_unique=True))
        said, at = list(map(self.written.__getitem__, codes.tolist())), splits.tolist()
        return [sha256(b"".join(said[i:j])[:-1]).hexdigest() if j > i else "" for i, j in zip(at, at[1:])]


def _encode(path_a: str, path_b: str, id_type: pa.DataType, step_bytes: int, block_bytes: int):
    schema = None

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner = Aligner(path_a, path_b)
        block, parts, held = TaskContext.get().partitionId() << 32, [], 0
        for batch in stream:
            for rows, data, _ in row_blocks(batch, "text", step_bytes):
                parts.append((rows.column("id"), *aligner.align(rows.column("text").to_pylist())))
                held += len(data)
                if held >= block_bytes:
                    yield _block_row(block, parts, id_type)
                    block, parts, held = block + 1, [], 0
        if parts:
            yield _block_row(block, parts, id_type)

    return run


def _block_row(block: int, parts: list, id_type: pa.DataType) -> pa.RecordBatch:
    """A block: its documents, its distinct pairs with the number of documents that hold each, and
    for every document where its pairs are among them and how many links each has."""
    ids = pa.concat_arrays([p[0].cast(id_type) for p in parts])
    counts = np.concatenate([p[1] for p in parts], axis=1)
    digests = [d for p in parts for d in p[2]]
    first = np.cumsum([0, *[p[1].shape[1] for p in parts[:-1]]])
    doc = np.concatenate([p[3][0] + f for p, f in zip(parts, first)])
    keys, at, holders = np.unique(np.concatenate([p[3][1] for p in parts]), return_inverse=True, return_counts=True)
    times = np.concatenate([p[3][2] for p in parts])
    splits = np.searchsorted(doc, np.arange(counts.shape[1] + 1))
    values = [pa.array([block]), *[pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (
        ids, *[pa.array(c) for c in counts], pa.array(digests, pa.string()))],
        pa.array([pack(keys.astype(np.uint64))], pa.binary()), pa.array([_pressed(holders)], pa.binary()),
        pa.array([_pressed(at)], pa.binary()), pa.array([_pressed(times)], pa.binary()),
        pa.ListArray.from_arrays(pa.array([0, len(splits)], pa.int32()), pa.array(splits))]
    return pa.RecordBatch.from_arrays(values, names=[f.split()[0] for f in _BLOCK.split(", ")])


def _pressed(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32 (or any, with one more byte plane each) as compressed byte planes."""
    wide = numbers.astype("<u8").view(np.uint8).reshape(-1, 8)
    used = next((k for k in range(8, 1, -1) if wide[:, k - 1].any()), 1) if len(numbers) else 1
    return bytes([used]) + zlib.compress(np.ascontiguousarray(wide[:, :used].T).tobytes(), 1)


def _unpressed(data: bytes) -> np.ndarray:
    used = data[0]
    planes = np.frombuffer(zlib.decompress(data[1:]), np.uint8).reshape(used, -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, :used] = planes.T
    return wide.view("<u8").ravel().astype(np.int64)


def _bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % buckets


def _send(buckets: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for block, packed, held in zip(*(batch.column(c).to_pylist() for c in ("block", "keys", "holders"))):
                keys, holders = unpack(packed), _unpressed(held)
                to = _bucket_of(keys, buckets)
                order = np.argsort(to, kind="stable")
                cuts = np.searchsorted(to[order], np.arange(buckets + 1))
                rows = [(b, block, pack(keys[order[i:j]]), _pressed(holders[order[i:j]]))
                        for b, (i, j) in enumerate(zip(cuts, cuts[1:])) if j > i]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()),
                         pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.binary())],
                        names=["bucket", "block", "keys", "holders"])

    return run


def _answer(table: pa.Table) -> pa.Table:
    """Totals of a bucket's pairs: to every block those of its own pairs, in its order, and one row
    (``block`` null) with the highest total of each A id here."""
    keys = [unpack(k) for k in table.column("keys").to_pylist()]
    held = [_unpressed(h) for h in table.column("holders").to_pylist()]
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.bincount(place, np.concatenate(held), len(distinct)).astype(np.int64)
    a = (distinct >> np.uint64(B_BITS)).astype(np.int64)
    new = np.flatnonzero(np.diff(a, prepend=-1))
    per_block = np.split(totals[place], np.cumsum([len(k) for k in keys])[:-1])
    return pa.table({
        "block": pa.array([*table.column("block").to_pylist(), None], pa.int64()),
        "bucket": pa.array([table.column("bucket")[0].as_py()] * (len(keys) + 1), pa.int32()),
        "totals": pa.array([*map(_pressed, per_block), _pressed(np.maximum.reduceat(totals, new))], pa.binary()),
        "a_ids": pa.array([None] * len(keys) + [pack(a[new].astype(np.uint64))], pa.binary())})


def _highest(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    best = np.zeros(1 << 17, np.int64)
    for batch in stream:
        for ids, totals in zip(batch.column("a_ids").to_pylist(), batch.column("totals").to_pylist()):
            np.maximum.at(best, unpack(ids).astype(np.int64), _unpressed(totals))
    a = np.flatnonzero(best)
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(best[a])], names=["a", "best"])


def align_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None,
                 path_b: str | None = None, step_bytes: int = STEP_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row: id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``.

    A null or empty text has no tokens, nor has one whose tokens do not spell a space and the
    text again (B knows U+2581 only as a space): zeros and an empty digest. Every row is a
    document: repeated rows count as often as they are there, null ids pass through. Other
    columns are ignored, whatever their names. An empty table gives an empty result. The
    vocabulary files must be where every worker finds them.
    """
    spark = docs.sparkSession
    path_a = path_a or public_tokenizers.path(VOCABULARY_A)
    path_b = path_b or public_tokenizers.path(VOCABULARY_B)
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    from pyspark.sql.pandas.types import to_arrow_type

    id_field = slim.schema["id"].dataType
    id_type, arrow_id = id_field.simpleString(), to_arrow_type(id_field)
    blocks = written(slim.mapInArrow(_encode(path_a, path_b, arrow_id, step_bytes, block_bytes), _BLOCK.format(id=id_type)))
    sent_bytes = blocks.agg(F.sum(F.octet_length("keys") + F.octet_length("holders"))).first()[0] or 0
    buckets = max(partitions_for(docs), sent_bytes // BUCKET_BYTES)
    sent = blocks.select("block", "keys", "holders").mapInArrow(
        _send(buckets), "bucket int, block bigint, keys binary, holders binary")
    answers = written(sent.groupBy("bucket").applyInArrow(
        _answer, "block bigint, bucket int, totals binary, a_ids binary"))
    best_rows = (answers.where("block IS NULL").mapInArrow(_highest, "a bigint, best bigint")
                 .groupBy("a").agg(F.max("best").alias("best")).collect())
    best = np.zeros(1 << 17, np.int64)
    for r in best_rows:
        best[r["a"]] = r["best"]
    name = fresh(id_col, ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = unpack(left.column("keys")[0].as_py()).astype(np.int64)
        totals = np.zeros(len(keys), np.int64)
        to, said = _bucket_of(keys, buckets), dict(zip(right.column("bucket").to_pylist(), right.column("totals").to_pylist()))
        order = np.argsort(to, kind="stable")
        if len(keys):
            totals[order] = np.concatenate([_unpressed(said[b]) for b in sorted(said)])
        at, times = _unpressed(left.column("at")[0].as_py()), _unpressed(left.column("times")[0].as_py())
        splits = left.column("splits")[0].values.to_numpy()

        def per_document(values: np.ndarray) -> np.ndarray:
            sums = np.append(0, np.cumsum(values))
            return sums[splits[1:]] - sums[splits[:-1]]

        columns = {name: left.column("ids")[0].values, **{c: left.column(c)[0].values for c in ("n_a", "n_b", "n_groups", "n_links")}}
        columns["n_best"] = pa.array(per_document(np.where(totals[at] == best[keys >> B_BITS][at], times, 0)))
        columns["count_sum"] = pa.array(per_document(totals[at] * times))
        columns["groups_sha256"] = left.column("sha")[0].values
        return pa.table(columns)

    right = answers.where("block IS NOT NULL").select("block", "bucket", "totals")
    return blocks.drop("holders").groupBy("block").cogroup(right.groupBy("block")).applyInArrow(
        finish, f"`{name}` {id_type}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, "
                "count_sum bigint, groups_sha256 string")
