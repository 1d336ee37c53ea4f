"""Hierarchical Pitman-Yor language model over words, seated by Gibbs sampling.

Three levels: a restaurant for each context (the word before, or the start of a text), one
parent restaurant that all of them share, and a uniform base over the known words and one
unknown word. In a context restaurant the customers are the occurrences of a word in that
context; each table is a customer of the parent. Seating starts with one table per dish. A
Gibbs sweep draws the tables of every (context, word) pair anew given all other pairs: from
their exact distribution up to ``EXACT`` customers, beyond that by the mean and variance that
the saddle point of the distribution gives. The predictive probabilities of the sweeps after
burn-in are averaged.

On Spark: a task packs its rows into blocks of text, tokens written as places among the
block's distinct words; texts are read once. Ranges of word hashes number the distinct words
of the corpus, so that a (word, context) pair is one 64-bit key whatever the number of
contexts. A block sends its distinct pairs with their training counts to buckets of words.
All contexts of a word meet in one bucket, so its tables and its parent customers are local;
what it needs beyond that are the tables of its contexts in the whole corpus. Those are added
up by ranges of contexts after each sweep, and each bucket is sent the ones that it holds.
Only pairs of two or more customers can change, so only those travel between sweeps, and of a
sweep only the state after it is written, in tasks by the number of buckets. Sweep k
is replayed from the totals before it, with seeds fixed by bucket, so a lost executor repeats
the same seating. In the end a block is sent counts and tables of its pairs, words and
contexts, and adds the logarithms up over its documents. To the driver come a few sums and
one number per range.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.partitioning import shuffles_dropped
from .block_keys import pack, unpack
from .common import checkpointed, id_bucket, row_blocks, text_or_empty, word_hashes

#: Bounds of ``context_bits``.
CONTEXT_BITS = (6, 20)
STRENGTH = 1.0
SWEEPS = 4
BURN_IN = 2
#: Pairs of up to so many customers are seated from the exact distribution of their tables.
EXACT = 64
#: Text of a block and tokens of a bucket, on average; their numbers grow with the input.
BLOCK_TEXT = 16 << 20
BUCKET_TOKENS = 1_000_000
#: Buckets of a task that writes a checkpoint, on average; tasks are two for each core at least.
TASK_BUCKETS = 8
#: The hashes that stand for the start and the end of a text.
START, END = np.uint64(0), np.uint64(0x5BD1E995 << 24)
#: A pair's key has the word's number above these bits and the context's in them.
BITS = 32
LOW = np.uint64((1 << BITS) - 1)


def context_bits(size: int) -> int:
    """Bits of the contexts of one range for a corpus of ``size`` bytes: ranges and their width both
    grow with its square root, until a range would be too wide for a task."""
    return min(max((size.bit_length() + 1) // 2, CONTEXT_BITS[0]), CONTEXT_BITS[1])


def squeeze(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on, compressed byte by byte in as few bytes as the largest needs."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(values) or int(values.max()) < 1 << 8 * w)
    return bytes([width]) + zlib.compress(values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes(), 1)


def loosen(packed: bytes) -> np.ndarray:
    width = packed[0]
    planes = np.frombuffer(zlib.decompress(packed[1:]), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.int64)


def unique_pairs(keys: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ascending distinct keys, sum of weights of each, place of every key among them)."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    first = np.flatnonzero(new)
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    sums = np.add.reduceat(weight[order].astype(np.int64), first) if len(first) else np.empty(0, np.int64)
    return ranked[first], sums, place


def block_pairs(ranks: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The (word, word before) key of every token of texts of ``n`` tokens each; the start is 0."""
    before = np.zeros(len(ranks), np.uint64)
    before[1:] = ranks[:-1]
    before[np.cumsum(n) - n] = 0
    return ranks.astype(np.uint64) << np.uint64(BITS) | before


BLOCK_SCHEMA = "block bigint, n_words bigint, n_tokens bigint, train binary, n binary, ranks binary, words binary"


def _deal(id_type: pa.DataType):
    """A partition's rows in blocks: the distinct word hashes of a block, start first, and of every
    token, with an end after each text, the place among them."""
    def block(number: int, held: list) -> pa.RecordBatch:
        ids, train, words, n = ([h[k] for h in held] for k in range(4))
        n = np.concatenate(n)
        tokens = np.insert(np.maximum(np.concatenate(words), np.uint64(1)), np.cumsum(n), END)
        hashes, _, place = unique_pairs(np.concatenate([[START], tokens]), np.zeros(len(tokens) + 1, np.uint8))
        ids = pa.concat_arrays(ids)
        values = [number, len(hashes), len(tokens), squeeze(np.concatenate(train)), squeeze(n + 1), squeeze(place[1:]),
                  hashes.tobytes()]
        kinds = [pa.int64()] * 3 + [pa.binary()] * 4
        names = [c.split()[0] for c in BLOCK_SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays(
            [*[pa.array([v], t) for v, t in zip(values, kinds)],
             pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.cast(id_type))], names=[*names, "ids"])

    def deal(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in stream:
            for rows, data, offsets in row_blocks(batch, "text"):
                words, at = word_hashes(data, offsets)
                held.append((rows.column("id"), rows.column("train").to_numpy(zero_copy_only=False).astype(np.uint8),
                             words, np.diff(at)))
                size += len(data)
                if size >= BLOCK_TEXT:
                    yield block(number, held)
                    number, held, size = number + 1, [], 0
        if held:
            yield block(number, held)

    return deal


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([list(c) for c in zip(*rows)] if rows else [[]] * len(schema), schema=schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _schema(text: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "string": pa.string(),
             "array<bigint>": pa.list_(pa.int64()), "array<binary>": pa.list_(pa.binary())}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in text.split(", ")])


def _rows(stream: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in stream:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


WORDS_SCHEMA = "part int, block bigint, words binary"


def _send_words(ranges: int):
    edges = np.array([i * (1 << 64) // ranges for i in range(1, ranges)], np.uint64)

    def send(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(stream):
            words = np.frombuffer(row["words"], np.uint64)
            cuts = [0, *np.searchsorted(words, edges).tolist(), len(words)]
            rows = [(r, row["block"], words[i:j].tobytes()) for r, (i, j) in enumerate(zip(cuts, cuts[1:])) if j > i]
            yield _batch(rows, _schema(WORDS_SCHEMA))

    return send


DICTIONARY_SCHEMA = "part int, n bigint, blocks array<bigint>, places array<binary>"


def _number_words(table: pa.Table) -> pa.Table:
    """A range's distinct words: how many, and for each block the gaps between the places of its words."""
    words = [np.frombuffer(w, np.uint64) for w in table.column("words").to_pylist()]
    distinct, _, place = unique_pairs(np.concatenate(words), np.zeros(sum(map(len, words)), np.uint8))
    parts = np.split(place, np.cumsum([len(w) for w in words])[:-1])
    return _table([(table.column("part")[0].as_py(), len(distinct), table.column("block").to_pylist(),
                    [squeeze(np.diff(p, prepend=0)) for p in parts])], _schema(DICTIONARY_SCHEMA))


PAIRS_SENT = "bucket int, block bigint, keys binary, counts binary"


def _send_pairs(offsets: list[int], buckets: int):
    """A block's distinct pairs in numbers of the corpus, ascending, and their training counts, by bucket."""
    edges = np.array([i * offsets[-1] // buckets << BITS for i in range(1, buckets)], np.uint64)

    def send(blocks: pa.Table, numbers: pa.Table) -> pa.Table:
        rows = []
        parts = dict(zip(numbers.column("part").to_pylist(), numbers.column("places").to_pylist()))
        for block in blocks.to_pylist():
            number = np.concatenate([np.cumsum(loosen(parts[r])) + offsets[r] for r in sorted(parts)]).astype(np.uint64)
            n = loosen(block["n"])
            weight = np.repeat(loosen(block["train"]), n)
            pairs, counts, _ = unique_pairs(block_pairs(loosen(block["ranks"]), n), weight)
            keys = number[pairs >> np.uint64(BITS)] << np.uint64(BITS) | number[pairs & LOW]
            cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
            rows += [(b, block["block"], pack(keys[i:j]), squeeze(counts[i:j]))
                     for b, (i, j) in enumerate(zip(cuts, cuts[1:])) if j > i]
        return _table(rows, _schema(PAIRS_SENT))

    return send


COUNT_FIELDS = ["tokens", "words", "once", "twice", "spread_once", "spread_twice"]
PAIRS_SCHEMA = ("bucket int, keys binary, counts binary, blocks array<bigint>, places array<binary>, "
                + ", ".join(f"{c} bigint" for c in COUNT_FIELDS))


def _merge_pairs(table: pa.Table) -> pa.Table:
    """All blocks' pairs of one bucket as one row: distinct pairs, their counts, for each block the gaps
    between the places of its pairs, and the sums that discounts and the base need."""
    keys = [unpack(k) for k in table.column("keys").to_pylist()]
    counts = [loosen(c) for c in table.column("counts").to_pylist()]
    pairs, sums, place = unique_pairs(np.concatenate(keys), np.concatenate(counts))
    parts = np.split(place, np.cumsum([len(k) for k in keys])[:-1])
    _, word = words_of(pairs)
    spread = np.bincount(word, sums > 0)
    fields = [sums.sum(), (spread > 0).sum(), (sums == 1).sum(), (sums == 2).sum(),
              (spread == 1).sum(), (spread == 2).sum()]
    return _table([(table.column("bucket")[0].as_py(), pack(pairs), squeeze(sums), table.column("block").to_pylist(),
                    [squeeze(np.diff(p, prepend=0)) for p in parts], *map(int, fields))], _schema(PAIRS_SCHEMA))


def words_of(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words of ascending pairs, and the place of each pair's word among them."""
    words = pairs >> np.uint64(BITS)
    new = np.ones(len(words), bool)
    new[1:] = words[1:] != words[:-1]
    return words[new], np.cumsum(new) - 1


def log_table_counts(discount: float, most: int = EXACT) -> np.ndarray:
    """``[n, t]``: log of the number of ways, weighted by the discount, to seat n customers at t tables
    (generalised Stirling numbers of the first kind)."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    for n in range(most):
        t = np.arange(1, n + 2)
        old = n - discount * t
        with np.errstate(divide="ignore"):
            stay = out[n, t] + np.log(np.where(old > 0, old, 0.0))
        out[n + 1, t] = np.logaddexp(out[n, t - 1], stay)
    return out


def draw_tables(rng: np.random.Generator, customers: np.ndarray, opens: np.ndarray, discount: float,
                ways: np.ndarray) -> np.ndarray:
    """Tables of pairs with so many ``customers`` (two at least) each, where a new table weighs ``opens``
    against the customers at the old ones less their discounts."""
    tables = np.ones(len(customers), np.int64)
    order = np.argsort(customers, kind="stable")
    sizes = customers[order]
    for n in np.unique(sizes[sizes <= EXACT]):
        at = order[np.searchsorted(sizes, n):np.searchsorted(sizes, n, "right")]
        weights = ways[n, 1:n + 1] + np.log(opens[at])[:, None] * np.arange(1, n + 1)
        upto = np.cumsum(np.exp(weights - weights.max(axis=1, keepdims=True)), axis=1)
        tables[at] = 1 + (upto < rng.random(len(at))[:, None] * upto[:, -1:]).sum(axis=1)
    at = order[np.searchsorted(sizes, EXACT, "right"):]
    if len(at):
        mean, variance = large_tables(customers[at].astype(float), opens[at], discount)
        # a binomial of this mean and variance; close to Poisson where customers are many times the weight
        rest = np.maximum(1 - variance / mean, 1e-9)
        trials = np.maximum(np.rint(mean / rest), 1)
        drawn = 1 + rng.binomial(trials.astype(np.int64), np.minimum(mean / trials, 1.0))
        tables[at] = np.minimum(drawn, customers[at])
    return tables


def large_tables(customers: np.ndarray, opens: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of the tables beyond the first, from the saddle point of their generating
    function ``exp(opens / d * (1 - (1 - x) ** d))`` at as many customers."""
    low, high = np.zeros(len(customers)), np.minimum(np.log(customers / opens + 2) / (1 - discount) + 2, 600.0)
    for _ in range(60):  # u = -log(1 - x), where the expected number of customers rises with u
        u = (low + high) / 2
        less = np.log(opens) + np.log(-np.expm1(-u)) + u * (1 - discount) < np.log(customers)
        low, high = np.where(less, u, low), np.where(less, high, u)
    mean = opens / discount * -np.expm1(-discount * u)
    return mean, np.maximum(mean - customers / (1 + (1 - discount) * np.expm1(u)), 1e-12)


def predicted(customers: np.ndarray, tables: np.ndarray, discount: float, all_customers: np.ndarray | int,
              all_tables: np.ndarray | int, parent: np.ndarray | float) -> np.ndarray:
    """A restaurant's predictive probability of dishes, given those of its parent."""
    return (np.maximum(customers - discount * tables, 0) + (STRENGTH + discount * all_tables) * parent) / (
        STRENGTH + all_customers)


class Seating:
    """The seating of one bucket's words: how many tables every (context, word) pair has, and the
    parent's customers (one per table) and tables of every word. With ``fixed``, the keys hold places
    of words among its entries, which are the tables that every word has besides those of the pairs."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, seed: int, bits: int, fixed: np.ndarray | None = None):
        self.rng = np.random.default_rng(seed)
        self.counts = counts
        self.classes = (keys & np.uint64((1 << bits) - 1)).astype(np.int64)
        words = keys >> np.uint64(bits)
        if fixed is None:
            new = np.ones(len(keys), bool)
            new[1:] = words[1:] != words[:-1]
            self.word = np.cumsum(new) - 1
            fixed = np.zeros(int(new.sum()), np.int64)
        else:
            self.word = words.astype(np.int64)
        self.n_words, self.fixed = len(fixed), fixed
        self.tables = (counts > 0).astype(np.int64)
        self.movable = np.flatnonzero(counts > 1)
        self.top = np.ones(self.n_words, np.int64)
        self.seat_parent(0.5, 0, 1.0)

    def customers(self) -> np.ndarray:
        return np.bincount(self.word, self.tables, self.n_words).astype(np.int64) + self.fixed

    def seat_parent(self, discount: float, total_top: int, base: float, ways: np.ndarray | None = None) -> None:
        """Seats the parent's customers of every word anew; at one table each as long as the parent has none."""
        customers = self.customers()
        self.top = (customers > 0).astype(np.int64)
        active = np.flatnonzero(customers > 1)
        if total_top and len(active):
            opens = np.full(len(active), (STRENGTH + discount * max(total_top - 1, 0)) * base)
            self.top[active] = draw_tables(self.rng, customers[active], opens, discount, ways)

    def parent(self, discount: float, total_customers: int, total_top: int, base: float) -> np.ndarray:
        """The parent's predictive probability of every word."""
        return predicted(self.customers(), self.top, discount, total_customers, total_top, base)

    def sweep(self, discount: float, class_tables: np.ndarray, parent: np.ndarray, ways: np.ndarray) -> None:
        """Seats all customers of every pair that has more than one again."""
        pairs = self.movable
        opens = (STRENGTH + discount * np.maximum(class_tables[self.classes[pairs]] - self.tables[pairs], 0)) * parent[
            self.word[pairs]]
        self.tables[pairs] = draw_tables(self.rng, self.counts[pairs], opens, discount, ways)

    def totals(self) -> tuple[np.ndarray, np.ndarray, int, int]:
        """(contexts that have tables, how many), the parent's customers and its tables."""
        by_class = np.bincount(self.classes, self.tables).astype(np.int64)
        used = np.flatnonzero(by_class)
        return used, by_class[used], int(self.customers().sum()), int(self.top.sum())


def replay(keys: np.ndarray, counts: np.ndarray, bucket: int, model: dict, sweeps: int,
           fixed: np.ndarray | None = None) -> Iterator[Seating]:
    """The seating after 0, 1, ... ``sweeps`` sweeps; sweep i uses the totals before it."""
    seating = Seating(keys, counts, 7_919 * bucket + 1, model["bits"], fixed)
    yield seating
    ways, top_ways = (log_table_counts(model[d]) if sweeps else None for d in ("discount", "top_discount"))
    for before in model["totals"][:sweeps]:
        parent = seating.parent(model["top_discount"], before["customers"], before["top"], model["base"])
        seating.sweep(model["discount"], before["class_tables"], parent, ways)
        seating.seat_parent(model["top_discount"], before["top"], model["base"], top_ways)
        yield seating


STATE_SCHEMA = ("bucket int, words binary, known binary, fixed binary, keys binary, counts binary, contexts binary, "
                "totals array<binary>, customers bigint, top bigint")


def _first_state(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the sweeps need of a bucket: its words with their training counts and their pairs of one
    customer, which have one table for good, and the pairs of more by place of word and of context."""
    for row in _rows(stream):
        pairs, counts = unpack(row["keys"]), loosen(row["counts"])
        words, word = words_of(pairs)
        known = np.bincount(word, counts, len(words)).astype(np.int64)
        moving = counts > 1
        contexts, place = np.unique(pairs[moving] & LOW, return_inverse=True)
        keys = word[moving].astype(np.uint64) << np.uint64(BITS) | place.astype(np.uint64)
        fixed = np.bincount(word[counts == 1], minlength=len(words))
        yield _batch([(row["bucket"], pack(words), squeeze(known), squeeze(fixed), pack(keys), squeeze(counts[moving]),
                       pack(contexts), [], 0, 0)], _schema(STATE_SCHEMA))


#: What travels to ranges of words and contexts: numbers of some of them and values of each, or whole blocks' places.
MESSAGE_SCHEMA = "part int, kind string, bucket int, keys binary, data array<binary>, blocks array<bigint>"


def _messages(kind: str, bucket: int, keys: np.ndarray, values: list[np.ndarray], offsets: list[int]) -> list[tuple]:
    """Values of ascending numbers, cut by range."""
    cuts = np.searchsorted(keys, np.array(offsets, np.uint64))
    return [(r, kind, bucket, pack(keys[i:j] - np.uint64(offsets[r])), [squeeze(v[i:j]) for v in values], None)
            for r, (i, j) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())) if j > i]


def _send_contexts(offsets: list[int]):
    """Customers and first tables of every context of a bucket."""
    def send(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(stream):
            pairs, counts = unpack(row["keys"]), loosen(row["counts"])
            contexts, place = np.unique(pairs[counts > 0] & LOW, return_inverse=True)
            values = [np.bincount(place, minlength=len(contexts)),
                      np.bincount(place, counts[counts > 0], len(contexts)).astype(np.int64)]
            yield _batch(_messages("context", row["bucket"], contexts, values, offsets), _schema(MESSAGE_SCHEMA))

    return send


def _dense(rows: list[dict], kind: str, arrays: int, width: int) -> list[np.ndarray]:
    """The values of all messages of a kind, added up by number."""
    sums = [np.zeros(width, np.int64) for _ in range(arrays)]
    for row in rows:
        if row["kind"] == kind:
            at = unpack(row["keys"]).astype(np.int64)
            for total, values in zip(sums, row["data"]):
                total[at] += loosen(values)
    return sums


def _add_contexts(offsets: list[int]):
    def add(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        width = offsets[part + 1] - offsets[part]
        sums = _dense(table.to_pylist(), "context", 2, width)
        numbers = pack(np.arange(width, dtype=np.uint64))
        return _table([(part, "context", -1, numbers, [squeeze(v) for v in sums], None)], _schema(MESSAGE_SCHEMA))

    return add


def _seatings(row: dict, model: dict, sweeps: int) -> Iterator[Seating]:
    totals = [{**named, "class_tables": loosen(t)} for named, t in zip(model["totals"], row["totals"])]
    return replay(unpack(row["keys"]), loosen(row["counts"]), row["bucket"], {**model, "totals": totals}, sweeps,
                  loosen(row["fixed"]))


SUMS_SCHEMA = "bucket int, customers bigint, top bigint"


def _seated(row: dict, model: dict, sweeps: int) -> tuple[Seating, int, int]:
    """A bucket's seating after so many sweeps, and the customers and tables that its words have at the parent."""
    for seating in _seatings(row, model, sweeps):
        pass
    *_, customers, top = seating.totals()
    return seating, customers, top


def _sums(model: dict, sweeps: int):
    def sums(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(stream):
            yield _batch([(row["bucket"], *_seated(row, model, sweeps)[1:])], _schema(SUMS_SCHEMA))

    return sums


def _more(seating: Seating, contexts: np.ndarray) -> np.ndarray:
    """Tables beyond the first of every context of a bucket."""
    return np.bincount(seating.classes, seating.tables - 1, len(contexts)).astype(np.int64)


SENT_SCHEMA = f"{MESSAGE_SCHEMA}, customers bigint, top bigint"


def _send_tables(model: dict, offsets: list[int], sweeps: int):
    """After so many sweeps: tables beyond the first of every context of a bucket, and to one of the ranges the
    customers and tables that the bucket's words have at the parent, which come back with the answers."""
    def send(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(stream):
            seating, customers, top = _seated(row, model, sweeps)
            contexts = unpack(row["contexts"])
            rows = _messages("more", row["bucket"], contexts, [_more(seating, contexts)], offsets)
            part = row["bucket"] % (len(offsets) - 1)
            yield _batch([*[(*r, 0, 0) for r in rows], (part, "sums", row["bucket"], None, None, None, customers, top)],
                         _schema(SENT_SCHEMA))

    return send


TOTALS_SCHEMA = "bucket int, part int, tables binary, customers bigint, top bigint"


def _answer_tables(contexts: pa.Table, sent: pa.Table) -> pa.Table:
    """The tables of every bucket's contexts in the whole corpus, in the bucket's order; sums go back as they came."""
    rows = sent.to_pylist()
    out = [(row["bucket"], -1, None, row["customers"], row["top"]) for row in rows if row["kind"] == "sums"]
    rows = [row for row in rows if row["kind"] == "more"]
    if rows:
        places = [unpack(row["keys"]).astype(np.int64) for row in rows]
        total = loosen(contexts.column("data")[0].as_py()[0])
        for at, row in zip(places, rows):
            total[at] += loosen(row["data"][0])
        out += [(row["bucket"], row["part"], squeeze(total[at]), 0, 0) for row, at in zip(rows, places)]
    return _table(out, _schema(TOTALS_SCHEMA))


def _joined(parts: list[tuple[int, bytes]]) -> np.ndarray:
    return np.concatenate([np.empty(0, np.int64), *[loosen(x) for _, x in sorted(parts)]])


def _next_state(state: pa.Table, answers: pa.Table) -> pa.Table:
    rows, answers = state.to_pylist(), answers.to_pylist()
    tables = _joined([(a["part"], a["tables"]) for a in answers if a["part"] >= 0])
    for row in rows:
        row["totals"] = [*row["totals"], squeeze(tables)]
        row["customers"], row["top"] = (sum(a[c] for a in answers) for c in ("customers", "top"))
    return pa.Table.from_pylist(rows, schema=_schema(STATE_SCHEMA))


def _late(row: dict, model: dict) -> Iterator[Seating]:
    """The seatings after burn-in; each is the next one once that is asked for."""
    return (seating for i, seating in enumerate(_seatings(row, model, SWEEPS)) if i > BURN_IN)


def _send_late(model: dict, offsets: list[int]):
    """Training count of every word of a bucket, and its customers and tables at the parent in the late seatings;
    of its contexts the tables beyond the first in each of those."""
    def send(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(stream):
            values, more, contexts = [loosen(row["known"])], [], unpack(row["contexts"])
            for seating in _late(row, model):
                values += [seating.customers(), seating.top.copy()]
                more.append(_more(seating, contexts))
            yield _batch([*_messages("word", row["bucket"], unpack(row["words"]), values, offsets),
                          *_messages("more", row["bucket"], contexts, more, offsets)], _schema(MESSAGE_SCHEMA))

    return send


ANSWER_SCHEMA = "block bigint, kind string, part int, data array<binary>"


def _answer_words(offsets: list[int]):
    """For every block of a range, of its words: training count, customers and tables as words at the parent in
    the late seatings, customers as contexts, and tables as contexts in those seatings."""
    def answer(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        width = offsets[part + 1] - offsets[part]
        rows = table.to_pylist()
        words = _dense(rows, "word", 1 + 2 * (SWEEPS - BURN_IN), width)
        tables, customers = _dense(rows, "context", 2, width)
        late = [tables + more for more in _dense(rows, "more", SWEEPS - BURN_IN, width)]
        out = []
        for row in rows:
            for block, gaps in zip(row["blocks"], row["data"]) if row["kind"] == "dictionary" else ():
                at = np.cumsum(loosen(gaps))
                out.append((block, "word", part, [squeeze(v[at]) for v in [*words, customers, *late]]))
        return _table(out, _schema(ANSWER_SCHEMA))

    return answer


def _answer_pairs(model: dict):
    """For every block of a bucket, of its pairs: training count, and tables in the late seatings."""
    def answer(pairs: pa.Table, state: pa.Table) -> pa.Table:
        out = []
        seated = {row["bucket"]: row for row in state.to_pylist()}
        for row in pairs.to_pylist():
            counts = loosen(row["counts"])
            values = [counts]
            for seating in _late(seated[row["bucket"]], model):
                tables = (counts > 0).astype(np.int64)
                tables[counts > 1] = seating.tables
                values.append(tables)
            for block, gaps in zip(row["blocks"], row["places"]):
                at = np.cumsum(loosen(gaps))
                out.append((block, "pair", row["bucket"], [squeeze(v[at]) for v in values]))
        return _table(out, _schema(ANSWER_SCHEMA))

    return answer


SCORE_SCHEMA = ("held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, "
                "score double")


def _score(id_col: str, id_type: pa.DataType, model: dict, tokens: int, words: int):
    names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    schema = pa.schema(list(zip(names, [id_type, pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 2])))

    def score(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        if not blocks.num_rows:
            return schema.empty_table()
        parts = {"word": [], "pair": []}
        for a in answers.to_pylist():
            parts[a["kind"]].append((a["part"], a["data"]))
        known, *at_parent = (_joined([(p, d[i]) for p, d in parts["word"]]) for i in range(2 + 3 * (SWEEPS - BURN_IN)))
        late = model["totals"][BURN_IN + 1:]
        at_parent, customers, context_tables = (
            at_parent[:2 * len(late)], at_parent[2 * len(late)], at_parent[2 * len(late) + 1:])
        counts, *tables = (_joined([(p, d[i]) for p, d in parts["pair"]]) for i in range(1 + len(late)))
        n, train = (loosen(blocks.column(c)[0].as_py()) for c in ("n", "train"))
        keys = block_pairs(loosen(blocks.column("ranks")[0].as_py()), n)
        pairs, _, place = unique_pairs(keys, np.zeros(len(keys), np.uint8))
        word, context = (pairs >> np.uint64(BITS)).astype(np.int64), (pairs & LOW).astype(np.int64)
        mean = np.zeros(len(pairs))
        for i, total in enumerate(late):
            parent = predicted(at_parent[2 * i], at_parent[2 * i + 1], model["top_discount"], total["customers"],
                               total["top"], model["base"])
            mean += predicted(counts, tables[i], model["discount"], customers[context], context_tables[i][context],
                              parent[word]) / len(late)
        logs, seen = np.log10(mean)[place], known[word][place]
        starts = np.cumsum(n) - n

        def summed(values):
            return np.add.reduceat(values, starts)

        return pa.table([
            blocks.column("ids").combine_chunks().flatten(), pa.array(train == 0), pa.array(n, pa.int64()),
            pa.array(summed((seen > 0).astype(np.int64)), pa.int64()), pa.array(np.full(len(n), tokens), pa.int64()),
            pa.array(summed(np.log10((seen + 1) / (tokens + words + 1)))), pa.array(summed(logs))], schema=schema)

    return score


def language_model_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                          hold_out: int = 2, folds: int = 7) -> DataFrame:
    """Per row: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Learns from the rows whose crc32(id as text) mod ``folds`` is not ``hold_out``. Null text
    counts as empty: its only token is the end. Repeated rows count as often as they occur;
    a null id hashes like an empty one. Without training rows the base is uniform over the
    one unknown word. Other columns are ignored. An empty table gives an empty result.
    """
    id_field = docs.select(id_col).schema.fields[0]
    id_type, id_name = to_arrow_type(id_field.dataType), id_field.dataType.simpleString()
    held = id_bucket(F.col(id_col)) % folds == hold_out
    dealt = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"), (~held).alias("train"))
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    with shuffles_dropped(docs.sparkSession):
        return _scored(dealt, size, id_col, id_type, id_name)


def _scored(dealt: DataFrame, size: int, id_col: str, id_type: pa.DataType, id_name: str) -> DataFrame:
    blocks = checkpointed(dealt.mapInArrow(_deal(id_type), f"{BLOCK_SCHEMA}, ids array<{id_name}>"))
    sums = blocks.agg(F.sum("n_words").alias("words"), F.sum("n_tokens").alias("tokens")).first()
    ranges = max(1, (sums["words"] or 0) >> context_bits(size) + 3)
    buckets = max(8, -(-(sums["tokens"] or 0) // BUCKET_TOKENS))
    cores = dealt.sparkSession.sparkContext.defaultParallelism
    # an empty partition would be a file as well; each is written by a task of its own
    range_tasks, bucket_tasks = max(2 * cores, ranges), max(2 * cores, buckets // TASK_BUCKETS)
    dictionary = checkpointed(blocks.select("block", "words").mapInArrow(_send_words(ranges), WORDS_SCHEMA).groupBy(
        "part").applyInArrow(_number_words, DICTIONARY_SCHEMA).coalesce(range_tasks))
    found = {r["part"]: r["n"] for r in dictionary.select("part", "n").collect()}
    offsets = np.cumsum([0, *[found.get(r, 0) for r in range(ranges)]]).tolist()
    if offsets[-1] >> BITS:
        raise ValueError(f"more than {1 << BITS} distinct words")
    numbers = dictionary.select("part", F.explode(F.arrays_zip("blocks", "places")).alias("b")).select(
        "part", F.col("b.blocks").alias("block"), F.col("b.places").alias("places"))
    sent = blocks.select("block", "train", "n", "ranks").groupBy("block").cogroup(
        numbers.groupBy("block")).applyInArrow(_send_pairs(offsets, buckets), PAIRS_SENT)
    pairs = checkpointed(sent.groupBy("bucket").applyInArrow(_merge_pairs, PAIRS_SCHEMA).coalesce(bucket_tasks))
    sums = pairs.agg(*[F.sum(c).alias(c) for c in COUNT_FIELDS]).first().asDict()
    sums = {c: n or 0 for c, n in sums.items()}
    model = {"discount": _discount(sums["once"], sums["twice"]), "bits": BITS,
             "top_discount": _discount(sums["spread_once"], sums["spread_twice"]),
             "base": 1.0 / (sums["words"] + 1), "totals": []}

    slim = pairs.select("bucket", "keys", "counts")
    contexts = checkpointed(slim.mapInArrow(_send_contexts(offsets), MESSAGE_SCHEMA).groupBy("part").applyInArrow(
        _add_contexts(offsets), MESSAGE_SCHEMA).coalesce(range_tasks))
    state = checkpointed(slim.mapInArrow(_first_state, STATE_SCHEMA))
    for sweep in range(SWEEPS):
        sent = state.mapInArrow(_send_tables(model, offsets, sweep), SENT_SCHEMA)
        answers = contexts.groupBy("part").cogroup(sent.groupBy("part")).applyInArrow(_answer_tables, TOTALS_SCHEMA)
        state = checkpointed(state.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(
            _next_state, STATE_SCHEMA).coalesce(bucket_tasks))
        model = _with_totals(model, state)
    model = _with_totals(model, state.mapInArrow(_sums(model, SWEEPS), SUMS_SCHEMA))

    messages = state.mapInArrow(_send_late(model, offsets), MESSAGE_SCHEMA).unionByName(contexts)
    messages = messages.unionByName(dictionary.select(
        "part", F.lit("dictionary").alias("kind"), F.lit(-1).alias("bucket"), F.lit(None).cast("binary").alias("keys"),
        F.col("places").alias("data"), "blocks"))
    answers = messages.groupBy("part").applyInArrow(_answer_words(offsets), ANSWER_SCHEMA).unionByName(
        pairs.select("bucket", "counts", "blocks", "places").groupBy("bucket").cogroup(
            state.groupBy("bucket")).applyInArrow(_answer_pairs(model), ANSWER_SCHEMA))
    return blocks.select("block", "train", "n", "ranks", "ids").groupBy("block").cogroup(
        answers.groupBy("block")).applyInArrow(_score(id_col, id_type, model, sums["tokens"], sums["words"]),
                                               f"`{id_col}` {id_name}, {SCORE_SCHEMA}")


def _with_totals(model: dict, rows: DataFrame) -> dict:
    now = rows.agg(F.sum("customers").alias("customers"), F.sum("top").alias("top")).first()
    return {**model, "totals": [*model["totals"], {"customers": now["customers"] or 0, "top": now["top"] or 0}]}


def _discount(once: int, twice: int) -> float:
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once + twice else 0.5
