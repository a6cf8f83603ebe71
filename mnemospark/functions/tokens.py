"""Tokens of short texts: latin words as they are, CJK runs by character bigrams or by a dictionary of segmented runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LATIN = "[a-z0-9_.-]{3,}"
CJK_RUN = r"[\x{3400}-\x{9FFF}]{2,}"


def latin_tokens(text: Column) -> Column:
    """Words of letters, digits, dots, dashes and underscores of at least three characters, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(LATIN), F.lit(0))


def cjk_runs(text: Column) -> Column:
    """Runs of at least two CJK characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(CJK_RUN), F.lit(0))


def bigrams(run: Column) -> Column:
    """All pairs of neighbouring characters of a run."""
    return F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda k: F.substring(run, k, F.lit(2)))


def token_list(text: Column) -> Column:
    """All tokens in order, CJK runs as bigrams."""
    return F.concat(latin_tokens(text), F.flatten(F.transform(cjk_runs(text), bigrams)))


def token_set(text: Column) -> Column:
    """Distinct tokens."""
    return F.array_distinct(token_list(text))


def segment_runs(runs: DataFrame) -> DataFrame:
    """``(run, words)``: CJK runs segmented by the JVM's dictionary word breaker.

    The breaker lives on the driver, so this is for vocabularies of distinct runs (queries, a store's memories), whose
    number the caller bounds; they are fetched one partition at a time. Use bigrams beyond that.
    """
    spark = runs.sparkSession
    jvm = spark._jvm
    breaker = jvm.com.ibm.icu.text.BreakIterator.getWordInstance(jvm.com.ibm.icu.util.ULocale("zh_Hans"))
    out = []
    for (run,) in runs.select("run").distinct().toLocalIterator():
        breaker.setText(run)
        start, words = breaker.first(), []
        while (end := breaker.next()) != -1:
            if breaker.getRuleStatus() >= 100:
                words.append(run[start:end])
            start = end
        out.append((run, words))
    return spark.createDataFrame(out, "run string, words array<string>")


def with_dictionary_tokens(rows: DataFrame, text: str, key: str) -> DataFrame:
    """``rows`` with ``tokens``: latin words, then dictionary words of the CJK runs in order."""
    runs = rows.select(key, F.posexplode(cjk_runs(F.col(text))).alias("pos", "run"))
    words = runs.join(segment_runs(runs), "run").groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "words"))), lambda x: x["words"])).alias("_words"))
    return rows.join(words, key, "left").withColumn("tokens", F.concat(latin_tokens(F.col(text)), F.coalesce("_words", F.array().cast("array<string>")))).drop("_words")
