"""Mixing sources to target weights with hash-threshold histograms (DataFrame functions only).

Every document gets a 48-bit hash of its id and text. For each source the words are summed per hash bucket; the bucket
in which the running sum crosses the source's budget is the only one that is refined, four levels deep, until the
threshold is one hash value. Documents below the threshold are taken once more. Rows that share the threshold's hash are
equal in id and text; as many of them are taken as bring the sum nearest to the budget. Nothing is sorted but the bounded
histogram of one source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, word_count

#: Weights of the sources in code-point order, repeating (fixed values of the contract).
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
LEVELS = 4
BITS = 12
#: A table of per-source values is broadcast up to so many sources; beyond that the join is salted.
BROADCAST_SOURCES = 50_000
SALTS = 64


def hash48(doc_id: Column, text: Column) -> Column:
    """The first 12 hex digits of an MD5 over the id and the text's MD5, as a long; nulls hash as the empty text."""
    both = F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(both), 1, 12), 16, 10).cast("long")


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Targets per source from ``(source, source_size)``.

    The sources, by code point with null last, take the repeating weights and share ``share`` times all words in
    proportion; a target stops at ``cap`` times its source's size and what is over goes to the others by weight. That
    settles at min(cap * size, level * weight) for one level, found on the sources ordered by size / weight.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy(F.col("_limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    return (
        sources.withColumn("weight", F.get(cycle, ((F.row_number().over(ordered) - 1) % len(weights)).cast("int")))
        .withColumn("_limit", F.lit(float(cap)) * F.col("source_size"))
        .withColumn("_budget", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("_all_weight", F.sum("weight").over(everything))
        .withColumn("_level", (F.col("_budget") - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))) / (F.col("_all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
        # the level counts from the first source that it does not fill; sources before it stand at their limits
        .withColumn("_open", F.col("_level") * F.col("weight") < F.col("_limit"))
        .withColumn("_settled", F.min(F.when(F.col("_open"), F.struct(F.col("_limit") / F.col("weight"), F.col("_level")))).over(everything)["_level"])
        .withColumn("target", F.when(F.col("_settled").isNull(), F.col("_limit")).otherwise(F.least("_limit", F.col("_settled") * F.col("weight"))))
        .select("source", "source_size", "weight", "target")
    )


def _with_source(docs: DataFrame, table: DataFrame, n: int) -> DataFrame:
    """``docs (.., source, h)`` with the columns of a per-source ``table`` of ``n`` rows: broadcast if small, else salted."""
    table = table.withColumnRenamed("source", "_source")
    if n <= BROADCAST_SOURCES:
        return docs.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    docs = docs.withColumn("_s", (F.col("h") % SALTS).cast("int"))
    return docs.join(salted, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_s") == F.col("_salt"))).drop("_source", "_salt", "_s")


def thresholds(slim: DataFrame, targets: DataFrame, n_sources: int) -> DataFrame:
    """``(source, copies, theta, ties)``: every document is taken ``copies`` times, once more if its hash is below theta,
    and so are ``ties`` of those whose hash is theta.

    Whole passes (target // size) cover most of a target; the rest is the budget of the threshold. At each level the
    histogram of only the boundary bucket is built. A source ends within half of one document of its target.
    """
    copies = F.floor(F.col("target") / F.col("source_size"))
    edge = targets.filter(F.col("source_size") > 0).select(
        "source", copies.cast("long").alias("copies"), F.lit(0).cast("long").alias("prefix"), (F.col("target") - copies * F.col("source_size")).cast("double").alias("left")
    )
    running = Window.partitionBy("source").orderBy("bucket")
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        inside = _with_source(slim, edge, n_sources)
        if level:
            inside = inside.filter(F.shiftright("h", shift + BITS) == F.col("prefix"))
        histogram = inside.groupBy("source", "copies", "left", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
        summed = histogram.withColumn("upto", F.sum("words").over(running))
        hit = F.min(F.when(F.col("upto") > F.col("left"), F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"), "words", "rows")))
        edge = (
            summed.groupBy("source", "copies", "left")
            .agg(hit.alias("hit"), F.max("bucket").alias("top"))
            .select("source", "copies", F.coalesce(F.col("hit.bucket"), F.col("top") + 1).alias("prefix"), (F.col("left") - F.coalesce(F.col("hit.before"), F.lit(0))).cast("double").alias("left"), "hit.words", "hit.rows")
        )
        last, edge = edge, edge.drop("words", "rows")
    # what is left of the budget in whole rows of the boundary hash, to the nearest
    ties = F.floor(F.col("left") * F.col("rows") / F.col("words") + 0.5).cast("long")
    return last.select("source", "copies", F.col("prefix").alias("theta"), F.coalesce(F.least(ties, F.col("rows")), F.lit(0)).alias("ties"))


def plan_mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> tuple[DataFrame, DataFrame, int]:
    """``(slim, table, n)``: doc_id, source, size, h, part of every document; source, source_size, target, copies, theta, ties."""
    slim = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), hash48(F.col("doc_id"), F.col("text")).alias("h"), F.spark_partition_id().alias("part"))
    slim = materialize(slim, "mix-slim")
    targets = materialize(source_targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap), "mix-targets")
    n = targets.count()
    cuts = thresholds(slim, targets, n).withColumnRenamed("source", "_cut")
    table = targets.join(cuts, F.col("source").eqNullSafe(F.col("_cut")), "left").drop("_cut")
    none = F.lit(0).cast("long")
    table = table.select("source", "source_size", "target", *[F.coalesce(c, none).alias(c) for c in ("copies", "theta", "ties")])
    return slim, materialize(table, "mix-table"), n


def _with_passes(rows: DataFrame) -> DataFrame:
    """``rows (.., source, part, h, copies, theta, ties)`` with ``passes``, how often the mix takes each.

    Only rows at their source's threshold are numbered, and only where some but not all of them are taken: by counts of
    the parts that they lie in and a number inside the part, so that no source is gathered by one task.
    """
    at_edge = (F.col("h") == F.col("theta")) & (F.col("ties") > 0)
    plain = rows.filter(~at_edge).withColumn("passes", F.col("copies") + (F.col("h") < F.col("theta")).cast("long"))
    # written, so that its parts are the same in both of the reads below
    edge = materialize(rows.filter(at_edge), "mix-edge")
    counts = edge.groupBy("source", "part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col("source").alias("_source"), F.col("part").alias("_part"), before.alias("_before"))
    number = F.row_number().over(Window.partitionBy("source", "part").orderBy("h"))
    placed = edge.withColumn("_number", number).join(offsets, F.col("source").eqNullSafe(F.col("_source")) & (F.col("part") == F.col("_part")))
    taken = F.col("copies") + (F.col("_before") + F.col("_number") <= F.col("ties")).cast("long")
    return plain.unionByName(placed.withColumn("passes", taken).drop("_source", "_part", "_before", "_number"))


def mix_plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, passes.

    Null text counts no words, a null source is a source of its own. Rows equal in id and text (also with null ids) are
    interchangeable: the mix takes as many of them as the target needs, so ties end as near to it as other rows. An empty
    table gives an empty result. Other columns are not read.
    """
    slim, table, n = plan_mix(docs, weights, share, cap)
    planned = _with_passes(_with_source(slim, table, n))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("passes")).alias("taken"), "passes")


def mix_documents(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """The mixed corpus itself: rows of ``docs``, all their columns whatever their names, each as often as the mix takes
    it (wordless ones as their source's hash says)."""
    _, table, n = plan_mix(docs, weights, share, cap)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "source", hash48(F.col("doc_id"), F.col("text")).alias("h"), F.spark_partition_id().alias("part"))
    keyed = _with_passes(_with_source(rows, table.select("source", "copies", "theta", "ties"), n))
    return keyed.withColumn("_pass", F.explode(F.array_repeat(F.lit(0), F.col("passes").cast("int")))).select("doc.*")
