"""Ranking memories for queries: BM25 with name bonus, vectors, fusion, feedback. All rankers take tables of queries.

A ranker returns ``(qid, id, score, rank)``; ties end at the id, so ranks are total orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import maths
from ..functions import text as T
from ..functions.tokens import token_list, token_set
from .nearest import nearest

K1, B, NAME_BONUS = 1.2, 0.75, 16.0
FEW_NAMES = 256


def in_scope(cwd: Column, session_cwd: str | None) -> Column:
    """Memories without a workspace are in scope everywhere, others only in their own."""
    return cwd.isNull() | (cwd == F.lit(session_cwd)) if session_cwd else cwd.isNull()


def searchable(memories: DataFrame, cwd: str | None) -> DataFrame:
    """In scope and not superseded (F9). This stands below the corpus statistics, which it changes."""
    return memories.filter(in_scope(F.col("cwd"), cwd) & (F.col("status") != "superseded"))


def postings(docs: DataFrame, id: str = "id", text: str = "text") -> DataFrame:
    """``(id, token, tf, length)`` (A3); documents without tokens have no rows."""
    tokens = docs.select(F.col(id).alias("id"), token_list(F.col(text)).alias("tokens"))
    return tokens.select("id", F.size("tokens").alias("length"), F.explode("tokens").alias("token")).groupBy("id", "token").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def document_frequency(rows: DataFrame, tokens: Column) -> DataFrame:
    """``(token, df)`` over distinct tokens of each row (A4)."""
    return rows.select(F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def corpus_stats(docs: DataFrame, id: str = "id", text: str = "text") -> DataFrame:
    """One row: n and average length, 1 where it would be 0 (A3)."""
    length = F.size(token_list(F.col(text)))
    return docs.agg(F.count("*").alias("n"), F.when(F.coalesce(F.avg(length), F.lit(0.0)) == 0, 1.0).otherwise(F.avg(length)).alias("avg_length"))


def bm25(docs: DataFrame, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """``(qid, id, score)`` of all documents that share a token with a query."""
    wanted = queries.select("qid", F.explode(token_set(F.col("query"))).alias("token"))
    # only tokens that some query has are grouped: what is shuffled follows the queries, not the corpus
    tokens = docs.select("id", token_list(F.col("text")).alias("tokens")).select("id", F.size("tokens").alias("length"), F.explode("tokens").alias("token"))
    posting = tokens.join(wanted.select("token").distinct(), "token").groupBy("id", "token").agg(F.count("*").alias("tf"), F.first("length").alias("length"))
    df = posting.groupBy("token").agg(F.count("*").alias("df"))
    hits = wanted.join(posting, "token").join(df, "token").crossJoin(F.broadcast(corpus_stats(docs)))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = 1 - b + b * F.col("length") / F.col("avg_length")
    return hits.groupBy("qid", "id").agg(F.sum(idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * norm)).alias("score"))


def names_held(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """``(qid, id, name)``: names of a query that a document holds verbatim.

    A few names (up to ``FEW_NAMES``, which is counted first) are broadcast and looked for in each text. More of them
    meet the vocabulary: a name consists of token characters, so it lies inside one token; names meet tokens by their
    first five characters, which all names have, then documents by token, and are compared with the text only there.
    """
    names = queries.select("qid", F.explode(T.names_in("query")).alias("name"))
    if names.select("name").distinct().limit(FEW_NAMES + 1).count() <= FEW_NAMES:
        few = F.broadcast(names.select("name").distinct())
        sure = docs.select("id", "text").join(few, F.contains(F.col("text"), F.col("name"))).select("name", "id")
        return names.join(sure, "name").select("qid", "id", "name").distinct()
    wanted = names.select("name").distinct().withColumn("start", F.substring(F.lower("name"), 1, 5))
    held = docs.select("id", F.explode(token_set(F.col("text"))).alias("token"))
    vocabulary = held.filter(F.length("token") >= 5).select("token").distinct()
    starts = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("token") - 4), lambda k: F.substring(F.col("token"), k, F.lit(5))))
    inside = vocabulary.select("token", F.explode(starts).alias("start")).join(wanted, "start").filter(F.contains(F.col("token"), F.lower("name")))
    maybe = inside.select("name", "token").join(held, "token").select("name", "id").distinct()
    sure = maybe.join(docs.select("id", "text"), "id").filter(F.contains(F.col("text"), F.col("name"))).select("name", "id")
    return names.join(sure, "name").select("qid", "id", "name").distinct()


def best_first() -> Column:
    """Order by score, equal to nine digits: sums of the same terms in another order tie."""
    return F.round("score", 9).desc()


def ranked(scores: DataFrame, *order: Column) -> DataFrame:
    """With ``rank`` from 1 by score and then ``order`` and id."""
    by = Window.partitionBy("qid").orderBy(best_first(), *order, "id")
    return scores.withColumn("rank", F.row_number().over(by))


def search_scores(memories: DataFrame, queries: DataFrame, cwd: str | None = None, bonus: float = NAME_BONUS) -> DataFrame:
    """``(qid, id, score)``: BM25 over the scoped memories plus the name bonus; nothing without a positive score."""
    scoped = searchable(memories, cwd)
    named = names_held(scoped, queries).groupBy("qid", "id").agg((F.count("*") * F.lit(float(bonus))).alias("bonus"))
    scores = bm25(scoped, queries).join(named, ["qid", "id"], "full").select("qid", "id", (F.coalesce("score", F.lit(0.0)) + F.coalesce("bonus", F.lit(0.0))).alias("score"))
    return scores.filter("score > 0")


def search(memories: DataFrame, queries: DataFrame, cwd: str | None = None, limit: int = 20, bonus: float = NAME_BONUS) -> DataFrame:
    """The best ``limit`` of the search scores for each query, more important and newer ones first on ties."""
    facts = searchable(memories, cwd).select("id", "importance", "created_at")
    hits = ranked(search_scores(memories, queries, cwd, bonus).join(facts, "id"), F.col("importance").desc(), F.col("created_at").desc())
    return hits.filter(F.col("rank") <= limit).select("qid", "id", "score", "rank")


def substring_rank(memories: DataFrame, queries: DataFrame) -> DataFrame:
    """The older ranker: whole query 1, each of its tokens 0.3, times importance, over text and type (R2)."""
    tokens = queries.select("qid", F.lower(F.trim("query")).alias("needle"), token_set(F.col("query")).alias("tokens"))
    hay = F.lower(F.concat_ws(" ", "text", "type"))
    pairs = tokens.crossJoin(memories.select("id", "importance", hay.alias("hay")))
    part = F.size(F.filter("tokens", lambda t: F.contains(F.col("hay"), t)))
    score = (F.contains(F.col("hay"), F.col("needle")).cast("double") + part * 0.3) * F.col("importance")
    return ranked(pairs.select("qid", "id", score.alias("score")).filter("score > 0"))


def vector_rank(vectors: DataFrame, queries: DataFrame, limit: int | None = None) -> DataFrame:
    """By cosine of ``(id, embedding)`` and ``(qid, embedding)``; only positive ones."""
    pairs = queries.select("qid", F.col("embedding").alias("q")).crossJoin(vectors.select("id", "embedding"))
    hits = ranked(pairs.select("qid", "id", maths.cosine(F.col("q"), F.col("embedding")).alias("score")).filter("score > 0"))
    return hits.filter(F.col("rank") <= limit) if limit else hits


def vector_search(memories: DataFrame, queries: DataFrame, limit: int = 20) -> DataFrame:
    """Memories ``(id, embedding, importance)`` by cosine, only positive ones, the more important first on ties."""
    hits = nearest(queries, memories, "importance", limit, positive=True)
    return ranked(hits, F.col("importance").desc()).filter(F.col("rank") <= limit).select("qid", "id", "score", "rank")


def conflict_partners_by_vector(incoming: DataFrame, memories: DataFrame, limit: int = 20) -> DataFrame:
    """``limit`` memories ``(id, embedding, updated_at)`` for each incoming ``(qid, embedding)`` by cosine, whatever its
    sign, the newest first on ties (O5)."""
    hits = nearest(incoming, memories, "updated_at", limit)
    return ranked(hits, F.col("updated_at").desc()).filter(F.col("rank") <= limit).select("qid", "id", "score", "rank")


def hybrid(first: DataFrame, second: DataFrame) -> DataFrame:
    """Sum of two rankers' scores, each divided by its best for the query."""

    def scaled(hits: DataFrame) -> DataFrame:
        return hits.select("qid", "id", (F.col("score") / F.max("score").over(Window.partitionBy("qid"))).alias("score"))

    return ranked(scaled(first).union(scaled(second)).groupBy("qid", "id").agg(F.sum("score").alias("score")))


def fuse(*rankings: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of any number of rankings."""
    parts = [r.select("qid", "id", maths.reciprocal_rank(F.col("rank"), k).alias("score")) for r in rankings]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return ranked(out.groupBy("qid", "id").agg(F.sum("score").alias("score")))


def pinned(memories: DataFrame, queries: DataFrame, most: int = 2) -> DataFrame:
    """``(qid, id)`` of memories that hold a query's name which at most ``most`` memories hold."""
    held = names_held(memories, queries)
    rare = held.withColumn("df", F.count("*").over(Window.partitionBy("qid", "name"))).filter(F.col("df") <= most)
    return rare.select("qid", "id").distinct()


def pin_first(ranking: DataFrame, pins: DataFrame) -> DataFrame:
    """Pinned rows before the ranking, each row once, order kept."""
    front = pins.select("qid", "id", F.lit(0).alias("part"), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    back = ranking.select("qid", "id", F.lit(1).alias("part"), "score", "rank")
    first = front.union(back).groupBy("qid", "id").agg(F.min(F.struct("part", "rank")).alias("place"), F.max("score").alias("score"))
    by = Window.partitionBy("qid").orderBy("place.part", "place.rank", "id")
    return first.select("qid", "id", "score", F.row_number().over(by).alias("rank"))


def feedback_terms(memories: DataFrame, queries: DataFrame, hits: DataFrame, top: int = 5, terms: int = 5) -> DataFrame:
    """``(qid, token, n)``: terms of the best hits that the query lacks, in at least two of them."""
    best = hits.filter(F.col("rank") <= top).join(memories.select("id", "text"), "id")
    found = best.select("qid", "id", F.explode(token_set(F.col("text"))).alias("token")).groupBy("qid", "token").agg(F.count("*").alias("n"))
    own = queries.select("qid", F.explode(token_set(F.col("query"))).alias("token"))
    fresh = found.filter(F.col("n") >= min(2, top)).join(own, ["qid", "token"], "left_anti")
    by = Window.partitionBy("qid").orderBy(F.col("n").desc(), "token")
    return fresh.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= terms).select("qid", "token", "n")


def search_with_feedback(memories: DataFrame, queries: DataFrame, cwd: str | None = None, top: int = 5, terms: int = 5, limit: int = 20) -> DataFrame:
    """Search again with the feedback terms added to each query."""
    added = feedback_terms(memories, queries, search(memories, queries, cwd, limit), top, terms)
    more = added.groupBy("qid").agg(F.array_join(F.sort_array(F.collect_list("token")), " ").alias("more"))
    longer = queries.join(more, "qid", "left").select("qid", F.concat_ws(" ", "query", "more").alias("query"))
    return search(memories, longer, cwd, limit)


#: Rankers by name (E1, E8): callables of memories and queries.
RANKERS: dict[str, Callable[..., DataFrame]] = {"search": search, "substring": substring_rank, "vector": vector_rank}


def rank_with(name: str, memories: DataFrame, queries: DataFrame, **options) -> DataFrame:
    """The named ranker's ranking."""
    return RANKERS[name](memories, queries, **options)


def overlap_pairs(left: DataFrame, right: DataFrame, least: float = 0.2) -> DataFrame:
    """``(lid, rid, shared, score)``: token overlap |A and B| / min(|A|, |B|) of at least ``least``.

    Both sides are ``(id, text)``. Tokens meet by an equi-join and are counted; no pair is made without a shared one.
    """
    a = left.select(F.col("id").alias("lid"), token_set(F.col("text")).alias("t")).select("lid", F.size("t").alias("ln"), F.explode("t").alias("token"))
    b = right.select(F.col("id").alias("rid"), token_set(F.col("text")).alias("t")).select("rid", F.size("t").alias("rn"), F.explode("t").alias("token"))
    pairs = a.join(b, "token").groupBy("lid", "rid").agg(F.count("*").alias("shared"), F.first("ln").alias("ln"), F.first("rn").alias("rn"))
    return pairs.select("lid", "rid", "shared", (F.col("shared") / F.least("ln", "rn")).alias("score")).filter(F.col("score") >= least)


def conflict_partner(incoming: DataFrame, memories: DataFrame, least: float = 0.2) -> DataFrame:
    """The best overlapping memory of each incoming text; on ties the smallest id."""
    by = Window.partitionBy("lid").orderBy(best_first(), "rid")
    return overlap_pairs(incoming, memories, least).withColumn("_n", F.row_number().over(by)).filter("_n = 1").drop("_n")


def conflict_partners(incoming: DataFrame, memories: DataFrame, limit: int = 20) -> DataFrame:
    """``limit`` memories for each incoming text by BM25, zero scores included, then the newest."""
    queries = incoming.select(F.col("id").alias("qid"), F.col("text").alias("query"))
    scores = bm25(memories, queries)
    by = Window.partitionBy("qid").orderBy(best_first(), F.col("updated_at").desc(), "id")
    scored = scores.join(memories.select("id", "updated_at"), "id").withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= limit)
    # only the newest memories can fill up, so not all of them meet every text
    newest = memories.orderBy(F.col("updated_at").desc(), "id").limit(2 * limit).select("id", "updated_at")
    rest = queries.select("qid").crossJoin(F.broadcast(newest)).join(scores.select("qid", "id"), ["qid", "id"], "left_anti")
    both = scored.select("qid", "id", "score", "updated_at").union(rest.select("qid", "id", F.lit(0.0), "updated_at"))
    return both.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= limit).select("qid", "id", "score", "rank")
