"""Operators 11 to 13 against plain Python and numpy, on awkward rows, empty tables and sf0.001."""

import math
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from headline_signals.llm import token_alignment as align, toxicity as tox, whitening as white
from headline_signals.llm import queries as Q
from tests.conftest import SF_SMALL

# operator 11

WORDS = "the of and river stone garden light winter table silver morning letter window forest".split()


def toxic_rows(n=600):
    """Every sixth text holds insults, some spelt otherwise; one clean phrase holds the same word."""
    rng, rows = np.random.default_rng(3), []
    spellings = ["idiot", "id10t", "IDIOT!!", "іdiot", "moron", "m0ron", "morоn", "M​orons"]
    for i in range(n):
        words = list(rng.choice(WORDS, rng.integers(10, 80)))
        bad = i % 6 == 0
        if bad:
            for _ in range(3):
                words.insert(int(rng.integers(len(words))), str(rng.choice(spellings)))
        elif i % 5 == 0:
            at = int(rng.integers(len(words)))
            words[at:at] = ["village", "idiot", "theatre"]
        rows.append((i, " ".join(map(str, words)), int(bad)))
    return rows


@pytest.fixture(scope="module")
def scored(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(9000, None, "x"), (9001, "", "x"), (None, "idiot", "x")],
                                 "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (9000, None)], "doc_id bigint, toxic int")
    return rows, {r.doc_id: r for r in tox.toxicity_scores(docs, labels).collect()}


def test_toxicity_held_out_accuracy(scored):
    rows, got = scored
    held = [(y, got[i].predicted) for i, _, y in rows if got[i].held_out]
    assert len(held) > 80 and sum(y == p for y, p in held) >= 0.97 * len(held)
    for i, _, _ in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= got[i].score <= 1 and got[i].predicted == (got[i].score >= 0.5)


def test_toxicity_nulls_and_empties(scored):
    _, got = scored
    assert got[9000].score == got[9001].score < 0.5 and None in got


def test_folding_and_exceptions():
    assert tox.fold("Yоu 1d10t, m0r0n! l33t 2024 covid19") == " you idiot moron leet covidi ".replace("covidi ", tox.fold("covid19").strip() + " ")
    lexicon = tox.Lexicon({" trash": 5.0, " tra": 1.0}, frozenset(["trash can"]))
    assert [w for _, w in lexicon.matches(tox.fold("a trash can, a Tr4sh heap, ultratrash"))] == [5.0]
    assert lexicon.density(None) == lexicon.density("") == lexicon.density("the trash can") == 0.0
    long = "trash can trash " * 50_000
    assert len(lexicon.matches(tox.fold(long))) == 50_000
    assert lexicon.density("trash") > lexicon.density("trash " + "stone " * 500) > 0


def test_entries_that_say_the_same():
    weights = {" idi": 3.0, " idio": 5.0, " idiot": 5.2, " stu": 6.0, " stupid ": 6.1}
    held = {" idi": 100, " idio": 98, " idiot": 95, " stu": 90, " stupid ": 30}
    assert set(tox.without_repetition(weights, held)) == {" idiot", " stu"}


def test_curve_against_counting():
    seen = np.zeros((2, tox.BINS), np.int64)
    seen[0, 0], seen[1, 0], seen[0, 100], seen[1, 100] = 90_000, 10_000, 10_000, 90_000
    slope, offset = tox.fit_curve(seen)
    at = 1 / (1 + np.exp(-(slope * np.array([0, 100 * tox.BIN_WIDTH]) + offset)))
    assert np.allclose(at, [0.1, 0.9], atol=0.01)


def test_toxicity_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "idiot"), (2, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {r.score for r in tox.toxicity_scores(docs, labels).collect()} == {0.5}
    assert tox.toxicity_scores(docs.limit(0), labels).collect() == []


# operator 12

ODD = [(1, None), (2, ""), (3, " " * 5000), (4, "a" * 30_000), (5, "▁ x"), (6, "<s></s><|endoftext|> <0x41>"),
       (None, "🙂🙂 ok 漢字"), (7, "é\x00\x85 　"), (7, "é\x00\x85 　"), (8, "\n\n\t ab"), (9, " lead"),
       (10, "1234567890" * 300), (11, "The quick brown fox."), (12, "The quick brown fox.")]


def aligned(rows):
    """The contract in plain Python."""
    a = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = {c: i for i, c in enumerate(align._byte_letters())}

    def piece(i):
        return bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    docs, holders = [], Counter()
    for i, t in rows:
        ids_a = a.encode(" " + t, add_special_tokens=False).ids if t else []
        ids_b = b.encode(t) if t else []
        said_a = [bytes(letters[c] for c in a.id_to_token(x)) for x in ids_a]
        said_b = [piece(x) for x in ids_b]
        if not t or not b"".join(said_a) == b"".join(said_b) == (" " + t).encode():
            docs.append((i, [], [], []))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in said_a]).tolist(), np.cumsum([len(x) for x in said_b]).tolist()
        groups, at_a, at_b = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            to_a, to_b = ends_a.index(end, at_a) + 1, ends_b.index(end, at_b) + 1
            groups.append((ids_a[at_a:to_a], ids_b[at_b:to_b]))
            at_a, at_b = to_a, to_b
        holders.update({(x, y) for p, q in groups for x in p for y in q})
        docs.append((i, ids_a, ids_b, groups))
    best = defaultdict(int)
    for (x, _), n in holders.items():
        best[x] = max(best[x], n)
    out = []
    for i, ids_a, ids_b, groups in docs:
        links = [(x, y) for p, q in groups for x in p for y in q]
        said = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((i, len(ids_a), len(ids_b), len(groups), len(links), sum(holders[k] == best[k[0]] for k in links),
                    sum(holders[k] for k in links), sha256(said.encode()).hexdigest() if ids_a else ""))
    return sorted(out, key=repr)


@pytest.mark.parametrize("step, block", [(align.STEP_BYTES, align.BLOCK_BYTES), (1000, 4000)])
def test_alignment(spark, step, block):
    small = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    for rows in (ODD, small):
        docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, n_best int")
        got = sorted((tuple(r) for r in align.align_tokens(docs, step_bytes=step, block_bytes=block).collect()), key=repr)
        assert got == aligned(rows)


def test_alignment_of_wide_groups(monkeypatch):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 9, 300), rng.integers(0, 9, 200)
    end_a, end_b, doc = np.array([99, 120, 299]), np.array([79, 80, 199]), np.array([0, 0, 1])
    normal = align.link_counts(doc, a, b, end_a, end_b)
    monkeypatch.setattr(align, "WIDE_GROUP", 0)
    for x, y in zip(normal, align.link_counts(doc, a, b, end_a, end_b)):
        assert (x == y).all()


def test_gallop():
    rng = np.random.default_rng(2)
    for n, m in ((0, 5), (1, 1), (5, 0), (700, 90_000), (90_000, 700), (1000, 1000)):
        short, long = np.unique(rng.integers(0, 10 ** 6, n)), np.unique(rng.integers(0, 10 ** 6, m))
        if len(long):
            assert (align.gallop(short, long, lane=7) == np.searchsorted(long, short)).all()


def test_alignment_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert align.align_tokens(docs).collect() == []


# operator 13

def whitened(rows, components=16):
    """Exact integers, then a dense eigendecomposition."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * np.float64(np.float32(c))) for c in v] for _, v in kept])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), [int(s) for s in fit.sum(axis=0)]
    centred = fit - fit.mean(axis=0)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    scores = (x - fit.mean(axis=0)) @ axes / np.sqrt(values)
    deviations = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x]
    return [i for i, _ in kept], n, deviations, scores, values / (centred ** 2).sum() * n


def check_whitening(rows, got):
    ids, n, deviations, scores, explained = whitened(rows)
    assert len(got) == scores.size and {r.n for r in got} == {n}
    assert sorted((r.vec_id, r.deviation) for r in got if r.component == 1) == sorted(zip(ids, deviations))
    table = {(r.vec_id, r.component): r for r in got}
    for k in range(scores.shape[1]):
        mine = np.array([table[i, k + 1].whitened for i in ids])
        assert min(np.abs(mine - scores[:, k]).max(), np.abs(mine + scores[:, k]).max()) < 1e-9
        assert abs(table[ids[0], k + 1].explained / explained[k] - 1) < 1e-9
    assert max(r.identity_error for r in got) < 1e-9 and len({r.identity_error for r in got}) == 1


def test_whitening_of_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    check_whitening(rows, Q.QUERIES["op13_whitening"](spark, SF_SMALL).collect())


def test_whitening_of_awkward_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(40 if i % 3 else -7, 3, 5) * [1, 3, 9, 27, 81]]) for i in range(120)]
    rows += [(200 + i, rows[7][1]) for i in range(50)]
    odd = [(300, None), (301, [1.0, None, 2.0, 3.0, 4.0]), (302, [float("nan")] * 5), (303, [float("inf")] * 5), (304, []),
           (305, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 0, "k") for i, v in rows + odd], "vec_id bigint, embedding array<float>, n int, component string")
    check_whitening(rows, white.whiten(df).collect())


def test_whitening_without_variance(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert white.whiten(spark.createDataFrame([], schema)).collect() == []
    assert white.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 5, schema)).collect() == []
    got = white.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (None, [3.0, 2.0]), (2, [1e30, 2.0])], schema)).collect()
    assert {r.component for r in got} == {1} and len(got) == 3


def test_jacobi_davidson_in_many_dimensions():
    rng = np.random.default_rng(8)
    q, _ = np.linalg.qr(rng.standard_normal((400, 400)))
    values = np.concatenate([[50, 49.5, 30, 30, 10], 5 * 0.99 ** np.arange(395)])
    passes = []

    def apply(x):
        passes.append(x.shape[1])
        return q @ (values[:, None] * (q.T @ x))

    theta, axes = white.jacobi_davidson(apply, 400, 6)
    assert np.allclose(theta, values[:6], rtol=1e-13)
    assert np.linalg.norm(apply(axes) - axes * theta, axis=0).max() < 1e-11
    assert np.abs(axes.T @ axes - np.eye(6)).max() < 1e-13 and len(passes) < 200
