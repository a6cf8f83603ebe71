"""Stable samples, strata, label tables and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.maths import fnv1a

#: Quotas of the strata and the seed of the shipped sample.
QUOTAS = {"coding-signal": 120, "coding-plain": 60, "study": 60, "office": 40, "other": 40, "vetoed": 30, "question": 20}
SEED = 20260928


def hash_ranked_sample(rows: DataFrame, key: str, seed: int | str = SEED, quotas: dict[str, int] | None = None, stratum: str | None = None, n: int = 100) -> DataFrame:
    """The rows with the smallest hash of ``seed:key`` (of each stratum, up to its quota), ties by key.

    Adding rows changes the sample only where they enter it. This is a sampling operator: its limits are its purpose.
    """
    ranked = rows.withColumn("rank_hash", fnv1a(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))
    if stratum is None:
        return ranked.orderBy("rank_hash", key).limit(n)
    most = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in (quotas or QUOTAS).items() for x in pair]), F.col(stratum)), F.lit(0))
    place = F.row_number().over(Window.partitionBy(stratum).orderBy("rank_hash", key))
    return ranked.withColumn("_n", place).filter(F.col("_n") <= most).drop("_n")


def first_of_key(rows: DataFrame, key: str, pos: str) -> DataFrame:
    """The first row of each key with how often it was seen (A5)."""
    w = Window.partitionBy(key)
    return rows.withColumns({"seen": F.count("*").over(w), "_n": F.row_number().over(w.orderBy(pos))}).filter("_n = 1").drop("_n")


def task_class(workspace: Column, classes: dict[str, str]) -> Column:
    """A workspace's class, other if it is not listed."""
    known = F.create_map(*[F.lit(x) for pair in classes.items() for x in pair]) if classes else F.create_map().cast("map<string,string>")
    return F.coalesce(F.try_element_at(known, workspace), F.lit("other"))


def stratum_of(task: Column, kind: Column, hinted: Column, reason: Column) -> Column:
    """The stratum of a harvested row."""
    return F.when(reason == "question", "question").when(reason.isNotNull(), "vetoed").when((task == "coding") & (hinted.isNotNull() | (kind == "tool-failure")), "coding-signal").when(task == "coding", "coding-plain").otherwise(task)


def last_labels(batches: DataFrame) -> DataFrame:
    """One label for each id over batches ``(batch, id, label)``: a later batch overrides."""
    return batches.groupBy("id").agg(F.max_by("label", "batch").alias("label"))


def carried_labels(rows: DataFrame, own: DataFrame, imported: DataFrame) -> DataFrame:
    """Rows ``(id)`` with labels: own ones first, then imported ones."""
    o, i = own.select("id", F.col("label").alias("_own")), imported.select("id", F.col("label").alias("_other"))
    return rows.join(o, "id", "left").join(i, "id", "left").withColumn("label", F.coalesce("_own", "_other")).drop("_own", "_other")


def orphaned_labels(rows: DataFrame, own: DataFrame) -> DataFrame:
    """Own labels whose row is not among the chosen ones; a harvest with any must stop."""
    return own.filter(F.col("label").isNotNull() & (F.col("label") != "")).join(rows.select("id"), "id", "left_anti")


def build_corpus(labelled: DataFrame, most_negatives: int) -> DataFrame:
    """A synthetic store from ``(pos, id, text, label, reason)``: positives, and the first negatives that still pass the
    screens; first of each id (S19)."""
    fine = labelled.filter((F.col("label") == "1") | ((F.col("label") == "0") & F.col("reason").isNull()))
    once = first_of_key(fine, "id", "pos").drop("seen")
    nth = F.row_number().over(Window.partitionBy("label").orderBy("pos"))
    return once.withColumn("_n", nth).filter((F.col("label") == "1") | (F.col("_n") <= most_negatives)).drop("_n")


def rules_hash(lines: DataFrame, pos: str, text: str) -> DataFrame:
    """Fingerprint of ordered lines (A27); for rule lists and frames, which are small."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, text))), lambda x: x[text]), "\n")
    return lines.agg(F.substring(F.sha2(joined.cast("binary"), 256), 1, 16).alias("hash"))


def row_hash(*columns: str) -> Column:
    """Fingerprint of a row."""
    return F.substring(F.sha2(F.concat_ws("\n", *[F.col(c).cast("string") for c in columns]).cast("binary"), 256), 1, 16)


def unanswered(windows: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """Windows without an answer yet."""
    return windows.join(answers.select(key), key, "left_anti")


def class_table(rows: DataFrame, *by: str) -> DataFrame:
    """Counts of rows and positives by class, with a total row."""
    return rows.rollup(*by).agg(F.count("*").alias("n"), F.count_if(F.col("label") == "1").alias("positive"), F.count_if(F.col("label") == "0").alias("negative"))
