"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding makes disguised spellings meet: letters of other scripts that look Latin become
Latin, digits and signs that stand for letters inside a word become those letters, and
everything that is no letter becomes one space. Lexicon entries are beginnings of words (a
space and at least three letters), or whole short words (a space on both sides).

The lexicon is learned from labelled rows. How many toxic and how many clean documents
hold an entry is counted over all of them; the log of the ratio is its weight. Toxic texts with
the same least shingle hash count once, so that copies of a text do not make its rare words
entries. Of entries that begin alike, the longest that hardly loses a document stays, and longer
ones that say no more go. Phrases of a matched word and a neighbour that clean documents use
are exceptions: a match inside one counts nothing.
A document's score is the summed weight of its matches by its length in words, turned into
a probability by a logistic curve that is fitted to a histogram of all training rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import BLOCK_BYTES, fresh, id_bucket, mix64, row_blocks, text_or_empty, word_hashes, written

#: Lengths of the word beginnings that may become entries; shorter words may as a whole.
STEM = range(3, 9)
#: A weight below this (log of the ratio of shares) is no sign of toxicity.
LEAST_WEIGHT = 2.0
#: The least log-likelihood ratio (G) of the counts of an entry.
LEAST_SURE = 40.0
#: Share of all toxic training texts that must hold an entry (and three texts at least).
LEAST_SHARE = 0.003
#: A longer entry replaces a shorter one that it begins with if it keeps this share of its texts,
#: and goes if the shorter one's weight is less by no more than this.
SAME_SHARE, SAME_WEIGHT = 0.9, 1.0
#: Words of a shingle of the copy sketch.
SHINGLE = 3
#: Words added to every length, so that very short texts do not get extreme scores.
LENGTH_PRIOR = 20
#: Phrases that are harmless though they hold an entry; more are learned.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "class clown", "idiot proof", "sore loser")
#: The histogram of scores that the logistic curve is fitted to.
BINS, BIN_WIDTH = 512, 0.02

#: Letters of other scripts by the Latin letter they look like.
HOMOGLYPHS = {
    "a": "аαɑ", "b": "вьƅ", "c": "сϲ", "d": "ԁ", "e": "еєε", "f": "ғ", "g": "ɡ", "h": "һн", "i": "іιı", "j": "ј",
    "k": "кκ", "l": "ӏⅼ", "m": "мⅿ", "n": "ոп", "o": "оοօσ", "p": "рρ", "q": "ԛ", "r": "гᴦ", "s": "ѕ", "t": "тτ",
    "u": "υս", "v": "ѵν", "w": "ԝω", "x": "хχ", "y": "уγү", "z": "ᴢ",
}
#: Digits and signs by the letter they stand for inside a word.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}

_LOOKS = {ord(c): latin for latin, others in HOMOGLYPHS.items() for c in others}
# full-width Latin letters, and marks that are put between letters without being seen
_LOOKS |= {0xFF41 + i: chr(97 + i) for i in range(26)} | {c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}
_STANDS = str.maketrans(SUBSTITUTES)
_LOOKALIKE = re.compile("[" + "".join(map(chr, _LOOKS)) + "]")
_SIGNS = re.compile(f"[{re.escape(''.join(SUBSTITUTES))}]+")
_ENDING = re.compile("[0134578]+")
_NO_LETTERS = re.compile(r"[\W\d_]+")


def _letters_for(m: re.Match) -> str:
    """The signs before a letter as letters; of others the digits that end a word after one."""
    signs, text = m.group(), m.string
    if m.end() < len(text) and text[m.end()].isalpha():
        return signs.translate(_STANDS)
    ending = _ENDING.match(signs)
    if ending and m.start() and text[m.start() - 1].isalpha():
        after = m.start() + ending.end()
        if after == len(text) or not (text[after].isalnum() or text[after] == "_"):
            return ending.group().translate(_STANDS) + signs[ending.end():]
    return signs


def fold(text: str) -> str:
    """The folded words of ``text``, each with one space on both sides."""
    text = text.lower()
    if not text.isascii() and _LOOKALIKE.search(text):
        text = text.translate(_LOOKS)
    text = _SIGNS.sub(_letters_for, text)
    return f" {_NO_LETTERS.sub(' ', text).strip()} "


def entries_of(folded: str) -> set[str]:
    """All possible entries of a folded text."""
    words = set(folded.split())
    found = {" " + w[:k] for w in words for k in STEM if len(w) >= k}
    return found | {f" {w} " for w in words if len(w) < STEM.stop}


@dataclass
class Lexicon:
    """Weights of entries, exception phrases, and the logistic curve over scores."""

    weights: dict[str, float]
    exceptions: frozenset[str] = field(default_factory=frozenset)
    slope: float = 1.0
    offset: float = -2.0

    def __post_init__(self):
        self.matcher = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "matcher"} | {"matcher": None}

    def _automaton(self):
        import ahocorasick

        if self.matcher is None:
            self.matcher = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                self.matcher.add_word(entry, (len(entry), weight))
            for phrase in self.exceptions:
                self.matcher.add_word(f" {phrase} ", (len(phrase) + 2, None))
            self.matcher.make_automaton()
        return self.matcher

    def matches(self, folded: str) -> list[tuple[int, float]]:
        """(start, weight) of the matched words outside exception phrases; where several entries
        begin with a word, the one of most weight counts."""
        if not self.weights:
            return []
        best, spared = {}, []
        for end, (size, weight) in self._automaton().iter(folded):
            start = end - size + 1
            if weight is None:  # the words of the phrase begin at these spaces
                while start < end:
                    spared.append(start)
                    start = folded.find(" ", start + 1)
            elif weight > best.get(start, 0.0):
                best[start] = weight
        for start in spared:
            best.pop(start, None)
        return sorted(best.items())

    def density(self, text: str | None) -> float:
        """Weight of the matches by length in words, on a scale that grows ever slower."""
        folded = fold(text or "")
        weight = sum(w for _, w in self.matches(folded))
        return math.log1p(100 * weight / (folded.count(" ") - 1 + LENGTH_PRIOR)) if weight else 0.0

    def probability(self, density: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * density + self.offset, -500, 500)))


def _texts(stream: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int]]:
    for batch in stream:
        for block, _, _ in row_blocks(batch, "text", BLOCK_BYTES):
            yield from zip(block.column("text").to_pylist(), block.column("label").to_pylist())


#: Entries that a task counts before it sends its counts on.
_COUNTED = 500_000


def _count_entries(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()
    for text, _ in _texts(stream):
        held.update(entries_of(fold(text or "")))
        if len(held) > _COUNTED:
            yield _pairs(held)
            held = Counter()
    yield _pairs(held)


def _pairs(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())],
                                      names=["entry", "n"])


def _count_known(known: frozenset[str]):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # most words begin like no candidate: their first letters are looked up once
        begins = {e[:STEM.start + 1] for e in known}
        held: Counter = Counter()
        for text, _ in _texts(stream):
            words = {w for w in set(fold(text or "").split()) if f" {w} "[:STEM.start + 1] in begins}
            held.update(entries_of(" ".join(words)) & known)
        yield _pairs(held)

    return run


def _sketch(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least hash of a text's shingles (of all its words, if fewer): copies mostly share it."""
    for batch in stream:
        for block, data, offsets in row_blocks(batch, "text", BLOCK_BYTES):
            words, at = word_hashes(data, offsets)
            least = []
            for i, j in zip(at[:-1], at[1:]):
                size = min(SHINGLE, j - i)
                shingles = np.zeros(j - i - size + 1, np.uint64)
                for k in range(size):
                    shingles = mix64(shingles * np.uint64(31) + words[i + k:j - size + k + 1])
                least.append(shingles.min() if len(shingles) else np.uint64(0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(least, np.uint64).view(np.int64)), block.column("text"), block.column("label")],
                names=["sketch", "text", "label"])


def likelihood_ratio(p: float, q: float, toxic: int, clean: int) -> float:
    """G of ``p`` of ``toxic`` and ``q`` of ``clean`` texts holding an entry, against equal shares."""
    share = (p + q) / (toxic + clean)

    def part(n, of):
        return (n * math.log(n / (of * share)) if n else 0.0) + (
            (of - n) * math.log((of - n) / (of * (1 - share))) if of > n else 0.0)

    return 2 * (part(p, toxic) + part(q, clean)) if 0 < share < 1 else 0.0


def without_repetition(weights: dict[str, float], held: dict[str, int]) -> dict[str, float]:
    """``weights`` without entries that a longer or shorter one that begins alike replaces."""
    replaced = set()
    for e, weight in weights.items():
        for k in range(2, len(e)):
            short = e[:k]
            # as often, or the reason why the shorter one has a weight at all
            if short in weights and (held[e] >= SAME_SHARE * held[short] or (
                    weight > weights[short] + SAME_WEIGHT
                    and weights[short] + math.log(1 - held[e] / held[short]) < LEAST_WEIGHT)):
                replaced.add(short)
    kept: dict[str, float] = {}
    for e in sorted(weights.keys() - replaced, key=lambda e: (len(e), e)):
        if not any(kept.get(e[:k], -math.inf) >= weights[e] - SAME_WEIGHT for k in range(2, len(e))):
            kept[e] = weights[e]
    return kept


def _phrases(lexicon: Lexicon):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for text, label in _texts(stream):
            folded = fold(text or "")
            near = set()
            for start, _ in lexicon.matches(folded):
                end = folded.index(" ", start + 1)
                word = folded[start + 1:end]
                before = folded[folded.rfind(" ", 0, start) + 1:start]
                after = folded[end + 1:folded.find(" ", end + 1)] if end + 1 < len(folded) else ""
                near |= {p for p in (f"{before} {word}" if before else "", f"{word} {after}" if after else "") if p}
            held.update((p, label) for p in near)
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in held], pa.string()), pa.array([y for _, y in held], pa.int64()),
             pa.array(list(held.values()), pa.int64())], names=["phrase", "label", "n"])

    return run


def _histogram(lexicon: Lexicon):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, BINS), np.int64)
        for text, label in _texts(stream):
            seen[label, min(round(lexicon.density(text) / BIN_WIDTH), BINS - 1)] += 1
        label, bin_ = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(label), pa.array(bin_), pa.array(seen[label, bin_])],
                                         names=["label", "bin", "n"])

    return run


def fit_curve(seen: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """(slope, offset) of a logistic curve over the histogram ``seen[label, bin]``, by Newton steps; a
    weak pull on the slope keeps it finite where the labels part cleanly."""
    x = np.arange(BINS) * BIN_WIDTH
    total, toxic = seen.sum(axis=0), seen[1]
    if not toxic.sum() or toxic.sum() == total.sum():
        share = (toxic.sum() + 0.5) / (total.sum() + 1)
        return 0.0, float(np.log(share / (1 - share)))
    pull = 1e-4 * total.sum() * np.array([1.0, 1e-6])
    beta = np.array([1.0, -2.0])
    design = np.stack([x, np.ones(BINS)])

    def loss(b):
        z = b @ design
        return float((np.logaddexp(0, z) * total - z * toxic).sum() + (pull * b * b).sum() / 2)

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(beta @ design, -500, 500)))
        gradient = design @ (p * total - toxic) + pull * beta
        hessian = (design * (p * (1 - p) * total)) @ design.T + np.diag(pull + 1e-9)
        step, size = np.linalg.solve(hessian, gradient), 1.0
        while loss(beta - size * step) > loss(beta) and size > 1e-6:
            size /= 2
        beta = beta - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def learn_lexicon(train: DataFrame, text_col: str = "text", label_col: str = "toxic",
                  exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """The lexicon, exceptions and curve from all rows of ``train`` whose label is 0 or 1; without
    toxic rows, or without clean ones, an empty lexicon that says the share of toxic rows."""
    # written once: five passes read the labelled texts, and a join behind them would run in each
    train = written(train.where(F.col(label_col).isin(0, 1)).select(
        text_or_empty(text_col).alias("text"), F.col(label_col).cast("bigint").alias("label")))
    sizes = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Lexicon({}, slope=0.0, offset=math.log((toxic + 0.5) / (clean + 0.5)))
    # one text of each sketch, the same in every run
    distinct = written(
        train.where("label = 1").mapInArrow(_sketch, "sketch bigint, text string, label bigint")
        .groupBy("sketch").agg(F.min("text").alias("text"), F.first("label").alias("label")).select("text", "label"))
    texts = distinct.count()
    least = max(3, math.ceil(LEAST_SHARE * texts))
    # what is collected: entries of so many texts are at most (entries a text) / LEAST_SHARE
    often = {r["entry"]: r["n"] for r in distinct.mapInArrow(_count_entries, "entry string, n bigint")
             .groupBy("entry").agg(F.sum("n").alias("n")).where(F.col("n") >= least).collect()}
    in_clean = {r["entry"]: r["n"] for r in train.where("label = 0").mapInArrow(
        _count_known(frozenset(often)), "entry string, n bigint").groupBy("entry").agg(F.sum("n").alias("n")).collect()}
    weights = {}
    for entry, p in often.items():
        q = in_clean.get(entry, 0)
        weight = math.log((p + 0.5) / (texts + 1)) - math.log((q + 0.5) / (clean + 1))
        if weight >= LEAST_WEIGHT and likelihood_ratio(p, q, texts, clean) >= LEAST_SURE:
            weights[entry] = weight
    lexicon = Lexicon(without_repetition(weights, often), frozenset(fold(e).strip() for e in exceptions))
    phrases = (train.mapInArrow(_phrases(lexicon), "phrase string, label bigint, n bigint").groupBy("phrase")
               .agg(F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("clean"),
                    F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("toxic"))
               .where((F.col("clean") >= max(3, math.ceil(1e-4 * clean)))
                      & (F.col("clean") / clean > 2 * F.col("toxic") / toxic)).collect())
    lexicon.exceptions |= {r["phrase"] for r in phrases}
    lexicon.matcher = None
    seen = np.zeros((2, BINS), np.int64)
    for r in train.mapInArrow(_histogram(lexicon), "label bigint, bin bigint, n bigint").groupBy("label", "bin").agg(
            F.sum("n").alias("n")).collect():
        seen[r["label"], r["bin"]] = r["n"]
    lexicon.slope, lexicon.offset = fit_curve(seen)
    return lexicon


def score_toxicity(docs: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_toxicity double``, 0 to 1.

    Only the text is looked at, all of it: a null text scores as an empty one, repeated rows
    score alike, null ids and further columns pass through; a column of that name is replaced.
    An empty table stays empty.
    """
    docs = docs.drop("_toxicity")
    fields = docs.schema.fields

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for block, _, _ in row_blocks(batch, text_col):
                found = lexicon.probability(np.array([lexicon.density(t) for t in block.column(text_col).to_pylist()]))
                yield pa.RecordBatch.from_arrays([*block.columns, pa.array(found, pa.float64())],
                                                 names=[*[f.name for f in fields], "_toxicity"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return docs.mapInArrow(run, f"{schema}, _toxicity double")


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    label_col: str = "toxic", hold_out: int = 0, folds: int = 5) -> DataFrame:
    """Per row of ``docs``: id, ``held_out``, ``score``, ``predicted``.

    Learns from the rows whose id has a label of 0 or 1 and is not in the held-out fold; rows with a
    null id have no label. An id with both labels is a training row for each. Null and empty
    texts get the score of a text without matches. An empty table gives an empty result, and
    without labels every row has the same score.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    known = labels.select(F.col(f"`{id_col}`").alias("of"), F.col(f"`{label_col}`").alias("label")).distinct()
    # a sort-merge join at every size: labels grow with the documents, so neither side is broadcast
    train = (rows.where(id_bucket(F.col("id")) % folds != hold_out)
             .join(known.where(F.col("label").isin(0, 1)).hint("merge"), F.col("id") == F.col("of")).select("text", "label"))
    lexicon = learn_lexicon(train, "text", "label")
    name = fresh(id_col, ["held_out", "score", "predicted"])
    return score_toxicity(rows, lexicon).select(
        F.col("id").alias(name), (id_bucket(F.col("id")) % folds == hold_out).alias("held_out"),
        F.col("_toxicity").alias("score"), (F.col("_toxicity") >= 0.5).cast("int").alias("predicted"))
