"""Parts of the operators on their own."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings, strategies as st

from headline_signals.llm import byte_bpe, common, induced_sorting, jaccard_join, pitman_yor, secret_scan
from headline_signals.llm.block_keys import pack, unpack
from headline_signals.llm.components import components

PATTERN = regex.compile(public_tokenizers.PATTERN)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab' \n\tétré1.,🙂", max_size=400), st.integers(12, 40), st.integers(0, 10))
def test_chunks_are_stitched_to_the_same_pieces(text, chunk, overlap):
    assert byte_bpe.boundaries(text, PATTERN, chunk, overlap) == [m.end() for m in PATTERN.finditer(text)]


def test_long_pieces_merge_like_short_ones():
    ranks = byte_bpe.load_ranks(public_tokenizers.path(byte_bpe.VOCABULARY))
    rng = random.Random(2)
    for _ in range(30):
        piece = "".join(rng.choice("abcdeing thr") for _ in range(200)).encode()
        short = byte_bpe.merge_piece(piece, ranks)
        assert byte_bpe._merge_long([piece[i:i + 1] for i in range(len(piece))], ranks) == short
        assert b"".join({r: p for p, r in ranks.items()}[i] for i in short) == piece


def test_trigram_queries():
    assert secret_scan.trigram_query("abcd") == ("and", ["abc", "bcd"])
    assert secret_scan.trigram_query("[0-9]+") is True
    assert secret_scan.trigram_query("(?ai)foo|BAR") == ("or", ["bar", "foo"])
    rng = random.Random(3)
    for rule in secret_scan.RULES:
        query = secret_scan.trigram_query(rule.pattern)
        assert (query is True) == (rule.kind == "hex")
    for text in ("Password = abcdefg", "API_KEY:'zzzzzzz'", "apikey=abcdefgh", "secret\"=abcdefgh", "passwd: abcdefgh"):
        low = text.lower()
        present = {low[i:i + 3] for i in range(len(low) - 2)}
        postings = {t: np.array([0] if t in present else [], np.int64)
                    for t in secret_scan.trigrams_of(secret_scan.trigram_query(secret_scan.BASE_RULES[0].pattern))}
        assert len(secret_scan.candidates(secret_scan.trigram_query(secret_scan.BASE_RULES[0].pattern), postings, 1)) == 1


def test_induced_sorting_equals_plain_sorting(monkeypatch):
    monkeypatch.setattr(induced_sorting.SymbolQueues, "__init__", _tiny_budget)
    rng = random.Random(1)
    for _ in range(60):
        letters = rng.choice([1, 2, 3, 20])
        pieces = [[rng.randrange(letters) + 2 for _ in range(rng.randrange(0, 40))] + [1] for _ in range(rng.randrange(1, 8))]
        text = np.array(sum(pieces, []) + [0], np.uint16)
        found = np.concatenate(list(induced_sorting.sorted_suffixes(text, 1 << 20)))
        plain = text.tolist()
        assert found.tolist() == sorted(range(len(plain)), key=lambda i: plain[i:])


def _tiny_budget(self, budget=64):
    """Queues that go to disk at once."""
    self.budget, self.held, self.file = budget, 0, None
    self.parts = [[] for _ in range(induced_sorting.SYMBOLS)]


def test_word_hashes_depend_on_words_only():
    texts = ["Alpha beta  gamma", None, "", " beta", "gamma\x0bALPHA ", "x"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])
    found = {}
    for budget in (1, 1 << 20):
        rows = []
        for _, data, offsets in common.row_blocks(batch, "t", budget):
            words, at = common.word_hashes(data, offsets)
            rows += [words[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
        found[budget] = rows
    assert found[1] == found[1 << 20]
    a, b, c = found[1][0]
    assert found[1][1:] == [[], [], [b], [c, a], found[1][5]]


def test_packed_keys_come_back():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 1000).astype(np.uint64))
    assert (unpack(pack(keys)) == keys).all() and len(unpack(pack(keys[:0]))) == 0


def test_prefix_keys_of_similar_sets_meet():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randrange(3, 300)
        code = {t: rng.choice([1, 2, 5, 70, 90]) for t in range(2 * n)}
        base = rng.sample(range(2 * n), n)
        other = [t for t in base if rng.random() > 0.12] or base[:1]
        other += [t for t in rng.sample(range(2 * n), n // 12) if t not in base]
        common_ = len(set(base) & set(other))
        if set(base) == set(other) or 100 * common_ < 75 * (len(base) + len(other) - common_):
            continue
        keys = []
        for tokens in (base, other):
            # a common token is held by two sets at least
            codes = [max(code[t], 2 if t in base and t in other else 1) for t in sorted(tokens)]
            keys.append(jaccard_join.prefix_keys(np.array(sorted(tokens), np.uint64) + np.uint64(1), np.array(codes)))
        (a, ka, _), (b, kb, _) = keys
        shared = set(a.tolist()) & set(b.tolist())
        kinds = {k: (set(ka[a == k].tolist()) | set(kb[b == k].tolist())) for k in shared}
        assert any(kind != {0} for kind in kinds.values())


def test_components(spark):
    rng = random.Random(6)
    chain = [(i, i + 1) for i in range(100, 160)]
    links = chain + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(7, 900)]
    least = {}
    for a, b in links:
        least.setdefault(a, a), least.setdefault(b, b)
    for _ in range(200):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == least


def test_predictive_probabilities_add_up_to_one():
    rng, bits = np.random.default_rng(8), 6
    words = np.unique(rng.integers(1, 1 << 40, 200).astype(np.uint64)) << np.uint64(bits)
    keys = np.unique(rng.choice(words, 2000) | rng.integers(0, 5, 2000).astype(np.uint64))
    counts = rng.integers(1, 300, len(keys))
    by_class = np.bincount((keys & np.uint64(63)).astype(int), counts, 64)
    model = {"discount": 0.6, "top_discount": 0.4, "base": 1 / (len(np.unique(keys >> np.uint64(6))) + 1), "bits": bits,
             "totals": []}
    for sweep in range(4):
        *_, seating = pitman_yor.replay(keys, counts, 3, model, sweep)
        classes, n, customers, top = seating.totals()
        model["totals"].append({"class_tables": np.bincount(classes, n, 64), "customers": customers, "top": top})
        assert (seating.tables >= 1).all() and (seating.tables <= counts).all()
        assert (seating.top >= 1).all() and (seating.top <= seating.customers()).all()
    now = model["totals"][-1]
    parent = seating.parent(0.4, now["customers"], now["top"], model["base"])
    unknown = (1 + 0.4 * now["top"]) * model["base"] / (1 + now["customers"])
    assert abs(parent.sum() + unknown - 1) < 1e-9
    for c in range(5):
        own = seating.classes == c
        back = (1 + 0.6 * now["class_tables"][c]) / (1 + by_class[c])
        seen = (counts[own] - 0.6 * seating.tables[own]).sum() / (1 + by_class[c])
        assert abs(seen + back - 1) < 1e-9


def seatings(n, opens, discount):
    """Weight of every number of tables over all ways to seat n customers, by enumeration."""
    found = {(1,): opens}
    for _ in range(n - 1):
        after = {}
        for sizes, weight in found.items():
            after[sizes + (1,)] = after.get(sizes + (1,), 0) + weight * opens
            for i, size in enumerate(sizes):
                grown = sizes[:i] + (size + 1,) + sizes[i + 1:]
                after[grown] = after.get(grown, 0) + weight * (size - discount)
        found = after
    total = sum(found.values())
    return [sum(w for s, w in found.items() if len(s) == t) / total for t in range(1, n + 1)]


@pytest.mark.parametrize("discount, opens", [(0.3, 0.5), (0.8, 3.0)])
def test_tables_follow_the_exact_distribution(discount, opens):
    rng, ways = np.random.default_rng(4), pitman_yor.log_table_counts(discount, 400)
    for n in (2, 6):
        exact = seatings(n, opens, discount)
        drawn = pitman_yor.draw_tables(rng, np.full(20_000, n), np.full(20_000, opens), discount, ways)
        share = np.bincount(drawn, minlength=n + 1)[1:] / 20_000
        assert np.abs(share - exact).max() < 0.015
    # large pairs: mean and spread against the exact recursion
    for n, weight in ((100, 0.01), (400, 4.0), (400, 300.0)):
        log = ways[n, 1:n + 1] + np.log(weight) * np.arange(1, n + 1)
        p = np.exp(log - log.max())
        p /= p.sum()
        mean = (p * np.arange(1, n + 1)).sum()
        drawn = pitman_yor.draw_tables(rng, np.full(4000, n), np.full(4000, weight), discount, ways)
        assert abs(drawn.mean() - mean) < 0.05 * mean + 0.05
        assert abs(drawn.std() - np.sqrt((p * (np.arange(1, n + 1) - mean) ** 2).sum())) < 0.15 * drawn.std() + 0.1


def test_contexts_grow_with_the_corpus():
    bits = [pitman_yor.context_bits(n) for n in (0, 10 ** 4, 10 ** 6, 10 ** 9, 10 ** 12, 10 ** 14)]
    assert bits == sorted(bits) and bits[0] == 6 and bits[3] == 15 and bits[-1] == 20


def test_language_model_score_by_brute_force(spark):
    """Words that follow one another in fixed ways, so that every seating has one table a pair at most
    twice: the score must lie between what the least and the most tables give, in plain Python."""
    import math
    import zlib

    rows = [(i, "red fox" if i % 2 else "blue sky") for i in range(40)]
    got = {r.doc_id: r for r in pitman_yor.language_model_scores(
        spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    train = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    pairs = Counter()
    for _, t in train:
        tokens = [None, *t.split(), "\0"]
        pairs.update(zip(tokens, tokens[1:]))
    contexts = Counter()
    for (c, _), n in pairs.items():
        contexts[c] += n
    discount = 0.5 if not any(n in (1, 2) for n in pairs.values()) else None
    assert discount == 0.5
    for i, t in rows:
        tokens = [None, *t.split(), "\0"]
        low = high = 0.0
        for c, w in zip(tokens, tokens[1:]):
            n = pairs[c, w]
            # all tables are between one and n; the share left for the parent is at most 1
            low += math.log10((n - discount * n) / (1 + contexts[c]))
            high += math.log10(min(1.0, (n - discount + 1 + discount * n) / (1 + contexts[c])))
        assert low <= got[i].score <= high <= 0
        assert got[i].score > got[i].base_score


def test_every_word_is_a_context_of_its_own(spark):
    """More words than a small corpus had classes, each followed by one word only: the score must lie between
    what the least and the most tables of the exact contexts give."""
    import math
    import zlib

    rows = [(i, f"w{i % 300} v{i % 300}") for i in range(4500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: r for r in pitman_yor.language_model_scores(df).collect()}
    pairs, contexts = Counter(), Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            tokens = [None, *t.split(), "\0"]
            pairs.update(zip(tokens, tokens[1:]))
            contexts.update(tokens[:-1])
    assert min(pairs.values()) > 2 and len(got) == len(rows)  # so the discount is 0.5
    for i, t in rows:
        tokens = [None, *t.split(), "\0"]
        bounds = [((n - 0.5 * n) / (1 + contexts[c]), min(1.0, (n + 0.5 + 0.5 * contexts[c]) / (1 + contexts[c])))
                  for c, w in zip(tokens, tokens[1:]) for n in [pairs[c, w]]]
        assert sum(math.log10(x) for x, _ in bounds) <= got[i].score <= sum(math.log10(x) for _, x in bounds)


def test_checkpoints_have_few_partitions(spark, monkeypatch):
    """Many shuffle partitions and a few buckets of words: the empty partitions are not written as files,
    and a sweep writes one checkpoint."""
    written, write = [], pitman_yor.checkpointed

    def counted(df):
        out = write(df)
        written.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(pitman_yor, "checkpointed", counted)
    cores = spark.sparkContext.defaultParallelism
    names = {"spark.sql.shuffle.partitions": str(4 * cores), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {c: spark.conf.get(c) for c in names}
    df = spark.createDataFrame([(i, f"a b{i % 7} c a") for i in range(60)], "doc_id bigint, text string").coalesce(2)
    try:
        for c, value in names.items():
            spark.conf.set(c, value)
        got = {r.doc_id: r.score for r in pitman_yor.language_model_scores(df).collect()}
    finally:
        for c, value in before.items():
            spark.conf.set(c, value)
    assert max(written) <= 2 * cores and len(written) == 5 + pitman_yor.SWEEPS
    assert got == {r.doc_id: r.score for r in pitman_yor.language_model_scores(df).collect()}


def test_pairs_of_one_customer_need_no_seat():
    """A bucket's words and pairs of one customer as fixed tables: the parent's customers, totals and
    probabilities are those of all its pairs."""
    keys = np.array([1 << 6 | 0, 1 << 6 | 1, 2 << 6 | 1, 3 << 6 | 2, 3 << 6 | 3], np.uint64)
    counts = np.array([5, 1, 1, 1, 4])
    whole = pitman_yor.Seating(keys, counts, 1, 6)
    moving = np.array([0 << 6 | 0, 2 << 6 | 3], np.uint64)
    part = pitman_yor.Seating(moving, counts[counts > 1], 1, 6, fixed=np.array([1, 1, 1]))
    assert whole.customers().tolist() == part.customers().tolist() == [2, 1, 2]
    assert whole.totals()[2:] == part.totals()[2:]
    assert whole.parent(0.4, 5, 3, 0.25).tolist() == part.parent(0.4, 5, 3, 0.25).tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1 << 62), max_size=40))
def test_squeezed_numbers_come_back(values):
    values = np.array(values, np.int64)
    assert pitman_yor.loosen(pitman_yor.squeeze(values)).tolist() == values.tolist()
