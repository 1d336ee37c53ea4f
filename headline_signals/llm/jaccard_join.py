"""N-gram Jaccard self-join by token-combination prefixes.

A document is the set of its word shingles. Equal sets are one node. The tokens of a set
are ordered by how many sets hold them, rare ones first. Two sets that overlap enough must
share their first common token within a prefix of each, and their first two common tokens
within prefixes one token longer. If the first common token is rare, it is an index key on
its own; if it is frequent, all common tokens are, and pairs of frequent prefix tokens are
the keys. Tokens that only one set holds are never keys, so a document with more than a
quarter of its own text emits nothing. Sets with very many frequent prefix tokens use
single tokens, which other sets then emit for them as well: a longer way, equally exact.

Candidates are verified on whole sets. In a list of equal keys all sets are first compared
with the one that has the least of its own, which in a group of near copies is the text
they were made from, and with their neighbour. What the links found do not join yet is
compared across components, behind an exact bound on the overlap from 1024-bit parity
bitmaps, until no pair that could join two components is left. Only sets that neither
their list's centre nor a neighbour links can cost more than a few comparisons.

On Spark: documents are dealt into blocks; a block sends its distinct tokens, sorted,
gap-coded and compressed, to token buckets, which answer with one byte of frequency per
token. Only keys, and the sets that have any, are shuffled as rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .block_keys import ANSWER_SCHEMA, SENT_SCHEMA, answer_blocks, key_bits, received, sent_rows
from .common import (checkpointed, first_id, fresh, mix64, only_kept, row_blocks, tagged, text_or_empty, word_hashes,
                     written)
from .components import components

WORDS_PER_SHINGLE = 5
#: A link needs 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Tokens that so many sets hold are frequent: indexed in combinations of two.
FREQUENT = 64
#: Up to so many frequent prefix tokens are combined with each other.
COMBINED = 64
#: Lists of frequent keys are chained in so many parts, then the parts with each other.
SALTS = 16
#: Bits of the parity bitmaps that bound the overlap of two sets from above.
BITMAP_BITS = 1024
#: Kinds of keys; those of single frequent tokens are 0 and 1.
RARE, COMBINATION = -1, -2
BLOCK_TEXT = 8 << 20
BUCKET_TOKENS = 3_000_000
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                   0xA0761D6478BD642F], np.uint64)


def shingles(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Per row of a block: the ascending distinct 64-bit hashes of its shingles. A row with
    fewer words than a shingle has its whole word sequence as one, without words none."""
    words, at = word_hashes(data, offsets)
    s = WORDS_PER_SHINGLE
    hashed = np.empty(0, np.uint64)
    if len(words) >= s:
        n = len(words) - s + 1
        hashed = mix64(sum((words[k:k + n] * _STEPS[k] for k in range(s)), np.zeros(n, np.uint64)))
    out = []
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= s:
            out.append(np.unique(hashed[a:b - s + 1]))
        elif b > a:
            short = (words[a:b] * _STEPS[:b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix64(np.array([short], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def set_id(tokens: np.ndarray) -> int:
    """A 64-bit digest of a set (signed, as Spark's longs are); its size goes with it as a key."""
    with np.errstate(over="ignore"):
        total = mix64(tokens ^ _STEPS[1]).sum(dtype=np.uint64) * _STEPS[0] + np.uint64(len(tokens))
    return int(mix64(np.array([total], np.uint64)).view(np.int64)[0])


def table_sets(table: pa.Table, column: str):
    """(row number, distinct shingles) of every row, block by block."""
    row = 0
    for batch in table.to_batches():
        for block, data, offsets in row_blocks(batch, column):
            for tokens in shingles(data, offsets):
                yield row, tokens
                row += 1


def _describe(stream):
    for batch in stream:
        for block, data, offsets in row_blocks(batch, "text"):
            sets = shingles(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [block.column("id"), pa.array([len(t) for t in sets], pa.int64()),
                 pa.array([set_id(t) if len(t) else None for t in sets], pa.int64()),
                 pa.array(np.diff(offsets), pa.int64())], names=["id", "n", "set_id", "n_bytes"])


def frequency_code(count: np.ndarray) -> np.ndarray:
    """Counts as one ascending byte: exact up to 200, then half powers of two."""
    count = np.asarray(count, np.int64)
    coarse = 200 + np.floor(2 * np.log2(np.maximum(count, 1) / 200)).clip(0, 55)
    return np.where(count <= 200, count, coarse).astype(np.uint8)


class _Block:
    """The sets that a block stands for, and its distinct token keys in order."""

    def __init__(self, docs: pa.Table, wanted: set[tuple[int, int]], shift: int):
        ids = docs.column("id").to_pylist()
        left, self.sets = set(wanted), []
        for row, tokens in table_sets(docs.select(["text"]), "text"):
            if len(tokens):
                key = (ids[row], set_id(tokens))
                if key in left:
                    left.discard(key)
                    self.sets.append((key[1], tokens))
        self.tokens = np.concatenate([t for _, t in self.sets]) if self.sets else np.empty(0, np.uint64)
        short = self.tokens >> np.uint64(shift)
        self.keys, self.place, self.counts = np.unique(short, return_inverse=True, return_counts=True)


def _send(buckets: int, bits: int):
    def send(docs: pa.Table, nodes: pa.Table) -> pa.Table:
        wanted = set(zip(nodes.column("id").to_pylist(), nodes.column("set_id").to_pylist()))
        block = _Block(docs, wanted, 64 - bits)
        number = docs.column("block")[0].as_py() if docs.num_rows else -1
        return sent_rows(number, block.keys, block.counts, buckets, bits)

    return send


KEY_SCHEMA = "key bigint, set_id bigint, n int, many int, pos int, own float, tokens binary, bits array<bigint>"
_KEY_ARROW = pa.schema([("key", pa.int64()), ("set_id", pa.int64()), ("n", pa.int32()), ("many", pa.int32()), ("pos", pa.int32()),
                        ("own", pa.float32()), ("tokens", pa.binary()), ("bits", pa.list_(pa.int64()))])


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """Bit i tells whether an odd number of tokens hash to i. Two bitmaps differ in no more bits
    than there are tokens in one set only."""
    odd = np.bincount((tokens % np.uint64(BITMAP_BITS)).astype(np.int64), minlength=BITMAP_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def prefix_keys(tokens: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index keys of a set, the kind of each (a rare token, a combination, 1 for a single frequent
    token of a set with too many to combine, 0 for one of any other set) and the place of the
    key's first token in the order."""
    n = len(tokens)
    order = np.lexsort((tokens, codes))
    first = n - (PERCENT * n + 99) // 100 + 1
    u, c = tokens[order[:first + 1]], codes[order[:first + 1]]
    is_rare = np.flatnonzero((c[:first] > 1) & (c[:first] < FREQUENT))
    is_often = np.flatnonzero(c >= FREQUENT)
    rare, often = u[is_rare], u[is_often]
    combined, single, many = np.empty(0, np.uint64), np.empty(0, np.uint64), 0
    i = is_single = np.empty(0, np.int64)
    if len(often) > 1:
        if len(often) <= COMBINED:
            i, j = np.triu_indices(len(often), 1)
            combined = mix64(often[i] * _STEPS[2] + often[j])
        else:
            many = 1
        is_single = is_often[is_often < first]
        single = mix64(u[is_single] ^ _STEPS[3])
    keys = np.concatenate([rare, combined, single])
    kinds = np.concatenate([np.full(len(rare), RARE), np.full(len(combined), COMBINATION), np.full(len(single), many)])
    return keys, kinds, np.concatenate([is_rare, is_often[i], is_single])


def _emit(bits: int):
    def emit(docs: pa.Table, side: pa.Table) -> pa.Table:
        nodes = [(i, s) for i, s in zip(side.column("id").to_pylist(), side.column("set_id").to_pylist())
                 if s is not None]
        block = _Block(docs, set(nodes), 64 - bits)
        codes = received(side)
        columns: list[list[np.ndarray]] = [[], [], [], [], [], []]
        sets, at = [], 0
        for node, tokens in block.sets:
            own = codes[block.place[at:at + len(tokens)]]
            at += len(tokens)
            keys, kinds, places = prefix_keys(tokens, own)
            if len(keys):
                for column, value in zip(columns, (keys.view(np.int64), node, len(tokens), kinds, places, (own == 1).mean())):
                    column.append(np.broadcast_to(value, len(keys)))
                sets.append((node, len(tokens), tokens.tobytes(), bitmap(tokens).tolist()))
        tables = []
        if sets:
            key, node, n, kinds, places, own = (np.concatenate(c) for c in columns)
            tables.append(pa.table([key, node, n.astype(np.int32), kinds.astype(np.int32),
                                    places.astype(np.int32), own.astype(np.float32),
                                    pa.nulls(len(key), pa.binary()), pa.nulls(len(key), pa.list_(pa.int64()))],
                                   schema=_KEY_ARROW))
            tables.append(pa.table([pa.nulls(len(sets), pa.int64()), [s[0] for s in sets],
                                    pa.array([s[1] for s in sets], pa.int32()), pa.nulls(len(sets), pa.int32()),
                                    pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.float32()), [s[2] for s in sets], [s[3] for s in sets]],
                                   schema=_KEY_ARROW))
        return pa.concat_tables(tables) if tables else _KEY_ARROW.empty_table()

    return emit


def _verify(stream):
    for batch in stream:
        a, b = batch.column("a_tokens").to_pylist(), batch.column("b_tokens").to_pylist()
        ok = []
        for x, y in zip(a, b):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(100 * common >= PERCENT * (len(x) + len(y) - common))
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of ``pairs`` (a, b) those whose whole sets are similar enough, written out."""
    # the sets are the wide side: each is sent once per pair it is in
    with_a = pairs.join(sets.select(F.col("set_id").alias("a"), F.col("tokens").alias("a_tokens")), "a")
    with_b = with_a.join(sets.select(F.col("set_id").alias("b"), F.col("tokens").alias("b_tokens")), "b")
    return written(with_b.select("a", "b", "a_tokens", "b_tokens").mapInArrow(_verify, "a bigint, b bigint"))


def _pair(x: str, y: str):
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _fits(n: str, m: str):
    return 100 * F.least(n, m) >= PERCENT * F.greatest(n, m)


def neighbour_pairs(keys: DataFrame) -> DataFrame:
    """(a, b, shared): in the list of a key, every set with the first one and with the one before
    it, ordered by the share of tokens that no other set has; and the number of such lists.

    Lists of single frequent tokens are for sets that have too many: a pair needs one of
    them. Long lists are taken in parts by a salt and the heads of the parts once more."""
    salt = F.when(F.col("many") != RARE, F.pmod(F.xxhash64("set_id"), F.lit(SALTS))).otherwise(0)
    inner = Window.partitionBy("key", "salt").orderBy("own", "set_id")
    outer = Window.partitionBy("key").orderBy("own", "set_id")

    def with_others(df: DataFrame, window) -> DataFrame:
        this = F.struct("set_id", "n", "many")
        return df.withColumn("first", F.first(this).over(window)).withColumn("last", F.lag(this).over(window))

    columns = ["set_id", "n", "many", "first", "last"]
    parts = with_others(keys.withColumn("salt", salt), inner)
    heads = with_others(parts.where(F.col("last").isNull() & (F.col("many") != RARE)).drop("first", "last"), outer)
    linked = (parts.select(columns).union(heads.select(columns)).where("last is not null")
              .select("set_id", "n", "many", F.explode(F.array_distinct(F.array("first", "last"))).alias("p")))
    return (linked.where(_fits("n", "p.n") & ((F.col("many") < 0) | (F.col("many") + F.col("p.many") > 0)))
            .groupBy(*_pair("set_id", "p.set_id")).agg(F.count("*").alias("shared")))


def cross_pairs(keys: DataFrame, sets: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b): candidates of one list that are in different components and may be similar.

    Read are the lists of single tokens: a similar pair meets in that of its first common token,
    and in far fewer lists than with combinations. Those whose sets are all in one component
    are done. In the others the sets outside the list's largest component meet all that are
    not in their own; a pair goes on if enough tokens follow the key in both sets, and if the
    bitmaps do not differ in more bits than similar sets have tokens apart."""
    keys = keys.where(F.col("many") != COMBINATION)
    labelled = keys.join(labels.withColumnRenamed("id", "set_id"), "set_id", "left").withColumn(
        "component", F.coalesce("component", "set_id"))
    sizes = labelled.groupBy("key", "component").agg(F.count("*").alias("members"))
    open_lists = (sizes.groupBy("key").agg(F.count("*").alias("parts"), F.max_by("component", F.struct(
        "members", "component")).alias("main")).where("parts > 1").select("key", "main"))
    words = range(BITMAP_BITS // 64)
    bits = sets.select("set_id", *[F.get("bits", F.lit(i)).alias(f"b{i}") for i in words])
    rest = written(labelled.join(open_lists, "key").join(bits, "set_id"))
    left = rest.where("component <> main").select("key", *[F.col(c).alias(f"x_{c}") for c in (
        "set_id", "n", "pos", "component", *[f"b{i}" for i in words])])
    behind = F.least(F.col("n") - F.col("pos"), F.col("x_n") - F.col("x_pos"))
    differ = sum((F.bit_count(F.col(f"b{i}").bitwiseXOR(F.col(f"x_b{i}"))) for i in words), F.lit(0))
    # |x| + |y| - 2 * common tokens apart, and common >= PERCENT / (100 + PERCENT) * (|x| + |y|)
    may_link = (((100 + PERCENT) * behind >= PERCENT * (F.col("n") + F.col("x_n")))
                & ((100 + PERCENT) * differ <= (100 - PERCENT) * (F.col("n") + F.col("x_n"))))
    return (left.join(rest, "key")
            .where(F.col("component") != F.col("x_component"))
            .where((F.col("component") == F.col("main")) | (F.col("set_id") < F.col("x_set_id")))
            .where(may_link & _fits("n", "x_n"))
            .select(*_pair("set_id", "x_set_id")).distinct())


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``n_shingles`` and ``component_id``, the smallest id that
    links reach.

    A null text, like one without words, has no shingles, no links and is a component of
    its own. Rows with a null id are returned with a null component and take no part in
    links. Repeated ids are separate rows, linked by their texts only. Other columns are
    ignored. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text_or_empty(text_col).alias("text"))
    described = checkpointed(rows.mapInArrow(_describe, "id bigint, n bigint, set_id bigint, n_bytes bigint"))
    total = described.agg(F.sum("n_bytes").alias("size"), F.sum("n").alias("tokens")).first()
    blocks = max(8, -(-(total["size"] or 0) // BLOCK_TEXT))
    buckets = max(8, -(-(total["tokens"] or 0) // BUCKET_TOKENS))
    bits = key_bits(int(total["tokens"] or 1))

    def block_of(column: str):
        return F.pmod(F.xxhash64(column), F.lit(blocks)).alias("block")

    # as many ids as sets: each set is read from the row with its smallest id
    nodes = checkpointed(described.where("n > 0 and id is not null").groupBy("set_id", "n")
                         .agg(F.min("id").alias("id")).select("set_id", "n", "id", block_of("id")))
    dealt = rows.where("id is not null").select("id", "text", block_of("id")).repartition(blocks, "block").groupBy("block")
    sent = dealt.cogroup(nodes.groupBy("block")).applyInArrow(
        _send(buckets, bits), SENT_SCHEMA)
    answers = sent.groupBy("bucket").applyInArrow(answer_blocks(frequency_code), ANSWER_SCHEMA)
    side = (answers.select("block", "bucket", "codes", F.lit(None).cast("bigint").alias("id"),
                           F.lit(None).cast("bigint").alias("set_id"))
            .unionByName(nodes.select("block", F.lit(None).cast("int").alias("bucket"),
                                      F.lit(None).cast("binary").alias("codes"), "id", "set_id")))
    emitted = checkpointed(dealt.cogroup(side.groupBy("block")).applyInArrow(_emit(bits), KEY_SCHEMA))
    sets = emitted.where("tokens is not null").select("set_id", "tokens", "bits")
    keys = emitted.where("key is not null").select("key", "set_id", "n", "many", "pos", "own")
    links = _links(keys, sets)
    labels = components(links)
    node_labels = nodes.join(labels.withColumnRenamed("id", "set_id"), "set_id", "left").withColumn(
        "component", F.coalesce("component", "set_id"))
    smallest = node_labels.groupBy("component").agg(F.min("id").alias("component_id"))
    named = node_labels.join(smallest, "component").select(
        F.col("set_id").alias("of_set"), F.col("n").alias("size"), "component_id")
    joined = described.join(named, (F.col("set_id") == F.col("of_set")) & (F.col("n") == F.col("size")), "left")
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                         F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))


def _links(keys: DataFrame, sets: DataFrame) -> DataFrame:
    """Links that join every two sets which any chain of similar pairs joins."""
    chained = written(neighbour_pairs(keys))
    # first each set with the one it meets in most lists: one pair per set
    ends = chained.select("a", "b", "shared", F.explode(F.array("a", "b")).alias("of"))
    best = ends.groupBy("of").agg(F.max_by(F.struct("a", "b"), F.struct("shared", "a", "b")).alias("pair"))
    links = verified(best.select("pair.a", "pair.b").distinct(), sets)
    # then the others that are still apart, then everything that is
    for pairs in (lambda labels: _apart(chained, labels), lambda labels: cross_pairs(keys, sets, labels)):
        found = verified(pairs(components(links)), sets)
        links = written(links.union(found))
    return links


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    a = labels.select(F.col("id").alias("a"), F.col("component").alias("a_in"))
    b = labels.select(F.col("id").alias("b"), F.col("component").alias("b_in"))
    return (pairs.join(a, "a", "left").join(b, "b", "left")
            .where(F.coalesce("a_in", "a") != F.coalesce("b_in", "b")).select("a", "b"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` (all columns) that stay: of each component one row, that with the
    smallest id. Rows are compared each on its own, whether ids are repeated or null; null
    ids give way to others."""
    tag = fresh("_row_tag", docs.columns)
    rows = tagged(docs, tag)
    found = similar_documents(rows, tag, text_col).select(F.col(tag).alias("of_tag"), "component_id")
    ids = rows.select(first_id(id_col, tag).alias("id"))
    kept = found.join(ids, F.col("of_tag") == F.col("id.tag")).groupBy("component_id").agg(F.min("id").alias("id"))
    return only_kept(rows, kept, id_col, tag)
