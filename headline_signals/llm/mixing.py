"""Mixing sources to target weights by hash-threshold histograms.

Sizes are summed per source and hash bucket; a running sum over the buckets of a source
finds the bucket where its budget ends; only that boundary bucket is opened into finer
buckets, level after level, until it holds one document. Documents are then taken by
comparing their hash with their source's threshold: no sort, and nothing but a few
records per source and bucket is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORDS, checkpointed, fresh, tagged, text_or_empty

WEIGHTS = (5, 2, 1)
CAP = 3
HASH_BITS = 60
#: Bits of the hash that one histogram level resolves.
LEVEL_BITS = 12
#: Up to so many sources the thresholds are broadcast (about 100 bytes each); beyond, a plain join.
BROADCAST_SOURCES = 10_000


def word_count(text_col: str) -> Column:
    return F.regexp_count(text_or_empty(text_col), F.lit(WORDS)).cast("long")


def row_hash(id_col: str, tag_col: str) -> Column:
    """60 bits: 48 of the MD5 of the id as text and 12 of the row's tag, so that rows of one id are
    not all or none taken; for a null id all of them from the tag."""
    def bits(text: Column, digits: int) -> Column:
        return F.conv(F.substring(F.md5(text.cast("string").cast("binary")), 1, digits), 16, 10).cast("long")

    return F.when(F.col(id_col).isNull(), bits(F.col(tag_col), 15)).otherwise(
        F.shiftleft(bits(F.col(id_col), 12), 12).bitwiseOR(bits(F.col(tag_col), 3)))


def _source_key(source_col: str) -> Column:
    """A key without nulls: ``-`` for null, ``+name`` for a name."""
    return F.when(F.col(source_col).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(source_col)))


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source_key, source_size, target): targets share the total by weight; those that reach
    ``CAP`` times their source's size stop there and the excess goes to the others by weight.

    Sources stop in the order of size / weight, so one pass in that order finds all that
    stop: source i stops if the total less the caps before it, shared among i and later
    ones, gives it more than its cap. One row per source, not per document."""
    named = sizes.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source_key") == "-", "source_key")
    weights = F.array(*[F.lit(w).cast("long") for w in WEIGHTS])
    ranked = (named
              .withColumn("w", F.get(weights, (F.row_number().over(by_name) - 1) % len(WEIGHTS)))
              .withColumn("cap", F.col("source_size") * CAP)
              .withColumn("total", F.sum("source_size").over(everything)))
    by_ratio = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source_key"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    here_on = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    stopped = ranked.withColumn(
        "stops", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) * F.col("w")
        > F.col("cap") * F.sum("w").over(here_on))
    rest = (F.col("total") - F.coalesce(F.sum(F.when(F.col("stops"), F.col("cap"))).over(everything), F.lit(0)))
    open_weight = F.sum(F.when(~F.col("stops"), F.col("w"))).over(everything)
    return stopped.select("source_key", "source_size", F.when(
        F.col("stops"), F.col("cap").cast("double"))
        .otherwise((rest * F.col("w")).cast("double") / open_weight).alias("target"))


def mixture(slim: DataFrame) -> DataFrame:
    """One row per source of rows (source_key, h, size): (source_key, source_size, target, repeats,
    edge, shift, edge_taken).

    A source is taken ``repeats`` times whole; what is left of its target is filled with the
    documents whose hash lies below ``edge << shift``, and the boundary bucket itself
    (``hash >> shift = edge``) if that brings the sum nearer to the target.
    """
    targets = (source_targets(slim)
               .withColumn("repeats", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                           .otherwise(F.lit(0)).cast("long"))
               .withColumn("budget", F.col("target") - F.col("repeats") * F.col("source_size"))
               .withColumn("edge", F.lit(0).cast("long")))
    state = checkpointed(targets)
    few = state.count() <= BROADCAST_SOURCES
    shift = HASH_BITS
    while shift > 0:
        inside = slim.join(_small(state.select("source_key", "edge"), few), "source_key").where(
            F.shiftright("h", shift) == F.col("edge"))
        shift -= LEVEL_BITS
        histogram = inside.groupBy("source_key", F.shiftright("h", shift).alias("bucket")).agg(
            F.sum("size").alias("words"), F.count("*").alias("n"))
        upto = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        edges = (histogram.withColumn("upto", F.sum("words").over(upto))
                 .join(_small(state.drop("words", "n"), few), "source_key")
                 .where((F.col("upto") > F.col("budget")) & (F.col("upto") - F.col("words") <= F.col("budget")))
                 .select("source_key", F.col("bucket").alias("next"), (F.col("upto") - F.col("words")).alias("filled"),
                         "words", "n"))
        # a source without documents of any size has no such bucket: its budget is 0
        state = checkpointed(
            state.drop("words", "n").join(_small(edges, few), "source_key", "left")
            .withColumn("edge", F.coalesce(F.col("next"), F.shiftleft("edge", LEVEL_BITS)))
            .withColumn("budget", F.col("budget") - F.coalesce(F.col("filled"), F.lit(0)))
            .drop("next", "filled"))
        if state.where("n > 1").isEmpty():
            break
    return state.select("source_key", "source_size", "target", "repeats", "edge", F.lit(shift).alias("shift"),
                        (F.coalesce("words", F.lit(0)) <= 2 * F.col("budget")).alias("edge_taken"))


def _small(df: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(df) if few else df


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source") -> DataFrame:
    """``docs`` with ``_size``, ``_source_size``, ``_target``, ``_taken``; columns of such names are
    replaced, all others come back whatever their names.

    Null text has size 0 and is never taken; a null source is a source of its own, named
    last. Rows with a null id and repeated rows are taken or left one by one, by file and row
    number. Sources without words have target 0. An empty table gives an empty result.
    """
    tag = fresh("_row_tag", docs.columns)
    kept = [c for c in docs.columns if c not in ("_size", "_source_size", "_target", "_taken")]
    # input columns travel under names that no column of ours can have
    rows = tagged(docs, tag).select(
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], row_hash(f"`{id_col}`", f"`{tag}`").alias("h"),
        word_count(f"`{text_col}`").alias("size"), _source_key(f"`{source_col}`").alias("key"))
    plan = mixture(checkpointed(rows.select(F.col("key").alias("source_key"), "h", "size")))
    few = plan.count() <= BROADCAST_SOURCES
    bucket = F.expr("shiftright(h, shift)")
    extra = F.when((bucket < F.col("edge")) | ((bucket == F.col("edge")) & F.col("edge_taken")), 1).otherwise(0)
    return rows.join(_small(plan, few), F.col("key") == F.col("source_key")).select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], F.col("size").alias("_size"),
        F.col("source_size").alias("_source_size"), F.col("target").alias("_target"),
        (F.col("size") * (F.col("repeats") + extra)).alias("_taken"))


def mixed_copies(docs: DataFrame) -> DataFrame:
    """The mix itself: every row of ``docs`` (all columns) as many times as it is taken, which for
    null texts is never; null ids and repeated rows as ``mix`` says. An empty table stays empty."""
    clashing = [c for c in docs.columns if c in ("_size", "_source_size", "_target", "_taken")]
    renamed = docs.withColumnsRenamed({c: fresh(f"{c}_kept", docs.columns) for c in clashing})
    times = F.when(F.col("_size") > 0, F.col("_taken") / F.col("_size")).otherwise(0).cast("int")
    copies = mix(renamed).withColumn("_taken", F.explode(F.array_repeat(F.lit(0), times)))
    return copies.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(renamed.columns, docs.columns)])
