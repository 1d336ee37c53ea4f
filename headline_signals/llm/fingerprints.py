"""Document fingerprints by one-permutation MinHash (DataFrame functions only).

Every five-word shingle is hashed once; the top bits of the hash choose a bin, the smallest
hash of a bin represents it. An empty bin takes over the value of the first non-empty bin
in a random order of its own, the same for all documents (optimal densification: the
probes of bin i are hashes of i and the attempt). Of each bin the low ``BITS`` bits are
kept, packed into 64-bit words. The share of equal bins estimates the Jaccard similarity
once the matches that short values produce by chance are subtracted.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import SPACES, partitions_for, text_or_empty

BIN_BITS = 8
BINS = 1 << BIN_BITS
BITS = 8
WORDS_PER_SHINGLE = 5
PER_LONG = 64 // BITS
#: Probes of an empty bin before all non-empty bins are ranked at once.
PROBES = 8


def _bin(x: Column) -> Column:
    """Bin of a hash; as the shift keeps the sign, bins ascend with the (signed) hash."""
    return F.shiftright(x, 64 - BIN_BITS) + F.lit(BINS // 2)


def _bit(b: Column, ones: int = 1) -> Column:
    """A long with bit ``b`` mod 64 set (from ``ones`` = -1: that bit and all above)."""
    return F.call_function("shiftleft", F.lit(ones).cast("bigint"), b.cast("int"))


def _occupied(word: int):
    """Adds a hash's bin to the bits of ``word``."""
    none = F.lit(0).cast("bigint")
    return lambda bits, x: bits.bitwiseOR(F.when(F.shiftright(_bin(x), 6) == word, _bit(_bin(x))).otherwise(none))


def with_fingerprint(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """``df`` with ``out array<bigint>``: the packed fingerprint of ``text_col``; an empty array
    if the text is null or has no word. A text of fewer words than a shingle is one shingle.

    Each step is a column of its own that the next reads more than once: a column read only
    once, inside a lambda, would be folded into it and built again for every element.
    """
    names = set(df.columns)
    lower = F.translate(text_or_empty(text_col), string.ascii_uppercase, string.ascii_lowercase)
    words = F.array_remove(F.split(lower, SPACES), "")
    s = WORDS_PER_SHINGLE
    df = df.withColumn("_w", F.transform(words, lambda w: F.xxhash64(w))).withColumn("_n", F.size("_w"))
    df = df.withColumn("_s", F.sort_array(
        F.when(F.col("_n") >= s, F.transform(F.sequence(F.lit(0), F.col("_n") - s), lambda i: F.xxhash64(
            *[F.get("_w", i + k) for k in range(s)])))
        .when(F.col("_n") > 0, F.array(F.xxhash64("_w")))
        .otherwise(F.array().cast("array<bigint>"))))
    df = df.withColumn("_m", F.filter("_s", lambda x, i: (i == 0) | (_bin(x) != _bin(F.get("_s", i - 1)))))
    # which bins are occupied, as bits of four longs, and how many are before each long
    words_of_bits = range(BINS // 64)
    df = df.withColumn("_o", F.array(*[F.aggregate("_m", F.lit(0).cast("bigint"), _occupied(w)) for w in words_of_bits]))
    before = [sum((F.bit_count(F.get("_o", F.lit(k))) for k in range(w)), F.lit(0)).cast("bigint") for w in words_of_bits]
    df = df.withColumn("_o", F.concat("_o", F.array(*before)))

    def slot(b: Column) -> Column:
        word = F.get("_o", F.shiftright(b, 6))
        rank = F.get("_o", F.shiftright(b, 6) + len(words_of_bits)) + F.bit_count(word.bitwiseAND(F.bitwise_not(_bit(b, -1))))
        return F.when(word.bitwiseAND(_bit(b)) != 0, F.get("_m", rank.cast("int")))

    df = df.withColumn("_slots", F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), slot))

    def filled(value: Column, b: Column) -> Column:
        probes = [F.get("_slots", F.pmod(F.xxhash64(b, F.lit(t)), F.lit(BINS)).cast("int")) for t in range(PROBES)]
        ranked = F.array_min(F.transform("_m", lambda x: F.xxhash64(b, _bin(x)).bitwiseAND(F.lit(-1 << BITS))
                                         .bitwiseOR(x.bitwiseAND(F.lit((1 << BITS) - 1)))))
        return F.coalesce(value, *probes, ranked).bitwiseAND(F.lit((1 << BITS) - 1))

    df = df.withColumn("_v", F.transform("_slots", filled))
    packed = F.when(F.size("_v") == BINS, F.transform(F.sequence(F.lit(0), F.lit(BINS // PER_LONG - 1)), lambda w: F.aggregate(
        F.slice("_v", w * PER_LONG + 1, PER_LONG), F.lit(0).cast("bigint"),
        lambda a, x: F.shiftleft(a, BITS).bitwiseOR(x))))
    df = df.withColumn(out, F.when(F.col("_n") > 0, packed).otherwise(F.array().cast("array<bigint>")))
    return df.select(*[c for c in df.columns if c in names and c != out], out)


def as_hex(packed: str) -> Column:
    return F.array_join(F.transform(packed, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity of two packed fingerprints, 0 to 1; two empty ones are equal
    (1), an empty one and another have nothing in common (0)."""
    def different(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        for shift, mask in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x0303030303030303), (1, 0x0101010101010101)):
            d = d.bitwiseOR(F.shiftrightunsigned(d, shift)).bitwiseAND(F.lit(mask))
        return F.bit_count(d)

    unequal = F.aggregate(F.zip_with(a, b, different), F.lit(0), lambda s, x: s + x)
    chance = 2.0 ** -BITS
    corrected = (F.lit(1.0) - unequal / F.lit(BINS) - F.lit(chance)) / F.lit(1.0 - chance)
    return (F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0)
            .when(F.col(a) == F.col(b), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), corrected))))


def with_next(df: DataFrame, id_col: str, carry: list[str]) -> DataFrame:
    """``df`` with ``_next_<c>`` for each of ``carry``: of the row that follows by ``id_col``
    (nulls first, ties by the columns carried), after the last row the first.

    Ids are cut into ranges near quantiles, at the smallest id that each range really has; a
    copy of each range's first rows also goes to the range before it, so that every range is
    a window of its own.
    """
    ranges = 4 * partitions_for(df)
    found = df.agg(F.min(id_col), F.percentile_approx(id_col, [i / ranges for i in range(1, ranges)], 20 * ranges),
                   F.count(F.when(F.col(id_col).isNull(), 1))).first()
    cuts = sorted({found[0], *found[1]}) if found[0] is not None else []
    # quantiles go through doubles, which round large ids: they only say where to look
    least = df.where(F.col(id_col).isNotNull()).groupBy(_range_of(F.col(id_col), cuts).alias("_range")).agg(
        F.min(id_col).alias("_least"))
    edges = sorted(r["_least"] for r in least.collect()) if len(cuts) > 1 else cuts
    first = None if found[2] or not edges else edges[0]
    place = _range_of(F.col(id_col), edges)
    last = max(len(edges) - 1, 0)
    starts = F.col(id_col).eqNullSafe(F.lit(first).cast(df.schema[id_col].dataType))
    if len(edges) > 1:
        # the first id of a range is the edge itself
        at_edge = F.get(F.array(*[F.lit(e) for e in edges]), F.col("_range")) == F.col(id_col)
        starts = starts | ((F.col("_range") > 0) & F.coalesce(at_edge, F.lit(False)))
    before = F.when(F.col("_range") > 0, F.col("_range") - 1).otherwise(F.lit(last))
    homes = F.when(starts, F.array(F.struct(F.col("_range").alias("r"), F.lit(0).alias("copy")),
                                   F.struct(before.alias("r"), F.lit(1).alias("copy")))
                   ).otherwise(F.array(F.struct(F.col("_range").alias("r"), F.lit(0).alias("copy"))))
    # the wrap-around copy stands after everything, the others after a range's own rows
    dealt = df.withColumn("_range", place).withColumn("_home", F.explode(homes)).select(
        *df.columns, F.col("_home.r").alias("_r"), F.col("_home.copy").alias("_copy"))
    # one window over plain columns, so that the texts are dealt out once
    window = Window.partitionBy("_r").orderBy("_copy", F.col(id_col).asc_nulls_first(), *carry)
    nexts = dealt.select("*", *[F.lead(c).over(window).alias(f"_next_{c}") for c in carry])
    return nexts.where("_copy = 0").drop("_r", "_copy")


def _range_of(value: Column, edges: list) -> Column:
    """Number of the last edge that is not above ``value`` (null: 0), in two steps of about the
    square root of the number of edges."""
    if len(edges) < 2:
        return F.lit(0)
    step = math.isqrt(len(edges)) + 1
    coarse = F.array(*[F.lit(e) for e in edges[::step]])
    group = F.greatest(F.size(F.filter(coarse, lambda e: e <= value)) - 1, F.lit(0))
    fine = F.array(*[F.array(*[F.lit(e) for e in edges[i:i + step]]) for i in range(0, len(edges), step)])
    within = F.greatest(F.size(F.filter(F.get(fine, group), lambda e: e <= value)) - 1, F.lit(0))
    return F.when(value.isNull(), 0).otherwise(group * step + within)


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited``, ``near_next``. The edited text is the text with its last
    floor(n_chars / 2) code points replaced by as many from the start of the next document.

    Null text counts as empty; without words the fingerprint is the empty string. Rows with
    a null id come first. Repeated ids follow each other, ordered by text. A single row is
    its own next. ``id_col`` must be numeric; other columns are ignored. An empty table gives an
    empty result.
    """
    texts = docs.select(F.col(id_col), text_or_empty(text_col).alias("_text"))
    nexts = with_next(with_fingerprint(texts, "_text", "_packed"), id_col, ["_text", "_packed"])
    half = F.floor(F.char_length("_text") / 2).cast("int")
    n = F.char_length("_text")
    edited = nexts.select(
        id_col, "_packed", F.col("_next__packed").alias("_other"), n.cast("long").alias("n_chars"),
        F.concat(F.substring("_text", F.lit(1), n - half), F.substring("_next__text", F.lit(1), half)).alias("_edited"))
    both = with_fingerprint(edited.withColumn("edited_sha256", F.sha2("_edited", 256)), "_edited", "_changed")
    return both.select(id_col, "n_chars", "edited_sha256", as_hex("_packed").alias("fingerprint"),
                       as_hex("_changed").alias("edited_fingerprint"),
                       likeness("_packed", "_changed").alias("near_edited"),
                       likeness("_packed", "_other").alias("near_next"))
