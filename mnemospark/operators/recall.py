"""Choosing memories for a prompt: blended score, quota per type, token budget, reserved slots, rendering."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import maths
from ..functions import text as T
from .rank import in_scope, search_scores

#: Fixed texts of the rendered block; their cost is charged to the budget.
HEADER = "## 长期记忆（自动积累，按会话工作区召回）"
HELP = "\n（这些记忆由插件自动写入，可随时用 `memory_forget` 撤销或修正。）"


@dataclass(frozen=True)
class RecallConfig:
    """Parameters of a recall; the defaults are the library's."""

    types: tuple[str, ...] = ("constraint", "pitfall", "decision")
    quota: dict[str, int] = field(default_factory=lambda: {"constraint": 4, "pitfall": 3, "decision": 2})
    max_tokens: int = 600
    relevance_weight: float = 0.8
    recency_bonus: float = 0.0
    recent_slots: int = 0
    include_needs_review: bool = False
    prefer_canonical: bool = False
    omit_redundant_id: bool = True
    #: None: the cost of header and help.
    fixed_tokens: int | None = None


def fixed_cost() -> Column:
    """Tokens of the block around the lines."""
    return T.estimate_tokens(F.lit(f"{HEADER}\n{HELP}"))


def rendered_line(config: RecallConfig) -> Column:
    """One memory as a line; the id is left out where the text gives it away."""
    shown = F.when(F.col("canonical").isNotNull() & (F.col("canonical") != ""), F.col("canonical")).otherwise(F.col("text")) if config.prefer_canonical else F.col("text")
    date = T.iso_date("created_at")
    with_id = F.concat(F.lit("- ["), F.col("type"), F.lit("] "), shown, F.lit(" ("), F.col("id"), F.lit(", "), date, F.lit(")"))
    without = F.concat(F.lit("- ["), F.col("type"), F.lit("] "), shown, F.lit(" ("), date, F.lit(")"))
    return F.when(T.hash_text(shown) == F.col("id"), without).otherwise(with_id) if config.omit_redundant_id else with_id


def scored(memories: DataFrame, now_ms: int, cwd: str | None, config: RecallConfig, relevance: DataFrame | None = None, queries: DataFrame | None = None) -> DataFrame:
    """Eligible memories with ``score`` and ``age_days`` (F8, M3-M5); ``relevance (id, score)`` is scaled by its best.

    With a small table of ``queries (qid, query)``, every memory for each of them, and ``relevance`` has their ``qid``;
    for blank queries relevance has no weight.
    """
    by = [] if queries is None else ["qid"]
    eligible = F.col("type").isin(*config.types) & in_scope(F.col("cwd"), cwd)
    eligible &= (F.col("status") == "active") | (F.lit(config.include_needs_review) & (F.col("status") == "needs-review"))
    out = memories.filter(eligible).withColumn("age_days", maths.age_days(F.col("created_at"), now_ms))
    weight = min(1.0, max(0.0, config.relevance_weight)) if relevance is not None else 0.0
    prior = maths.prior(F.col("importance"), F.col("age_days"))
    if by:
        out = out.crossJoin(F.broadcast(queries.select("qid", F.coalesce(F.col("query").rlike("\\S"), F.lit(False)).alias("_asks")).distinct()))
    if weight:
        # one row, or one for each query, so it may be broadcast
        best = F.broadcast(relevance.groupBy(*by).agg(F.max("score").alias("_best")))
        scaled = relevance.join(best, "qid") if by else relevance.crossJoin(best)
        out = out.join(scaled.select("id", *by, (F.col("score") / F.col("_best")).alias("_rel")), ["id", *by], "left")
        blended = maths.blend(F.col("_rel"), prior, weight)
        out = out.withColumn("score", F.when(F.col("_asks"), blended).otherwise(prior) if by else blended).drop("_rel")
    else:
        out = out.withColumn("score", prior)
    out = out.drop("_asks")
    return out.withColumn("score", F.col("score") + maths.recency(F.col("age_days"), config.recency_bonus)) if config.recency_bonus > 0 else out


def _greedy(config: RecallConfig) -> Column:
    """The fold over ``items`` in order: skip what its type's quota or the budget has no room for, and go on."""
    quota = F.create_map(*[F.lit(x) for pair in config.quota.items() for x in pair])
    start = F.struct(
        (F.lit(config.fixed_tokens) if config.fixed_tokens is not None else fixed_cost()).cast("int").alias("tokens"),
        F.array().cast("array<string>").alias("types"),
        F.array().cast("array<int>").alias("picked"),
    )

    def step(state: Column, item: Column) -> Column:
        limit = F.coalesce(F.try_element_at(quota, item["type"]), F.lit(0))
        used = F.size(F.filter(state["types"], lambda t: t == item["type"]))
        fits = (used < limit) & (state["tokens"] + item["cost"] <= config.max_tokens)
        return F.when(
            fits,
            F.struct((state["tokens"] + item["cost"]).alias("tokens"), F.concat(state["types"], F.array(item["type"])).alias("types"), F.concat(state["picked"], F.array(item["pos"])).alias("picked")),
        ).otherwise(state)

    return F.aggregate("items", start, step)


def _with_slots(config: RecallConfig, picked: Column, items: Column) -> Column:
    """The picked positions after the newest of the others took up to ``recent_slots`` places, evicting from the end
    (W13); the reserved ones come last."""
    cost = lambda pos: F.element_at(items, pos)["cost"]
    newest = F.transform(F.array_sort(F.transform(F.filter(items, lambda i: ~F.array_contains(picked, i["pos"])), lambda i: F.struct((-i["created_at"]).alias("age"), i["pos"].alias("pos")))), lambda x: x["pos"])
    base = (F.lit(config.fixed_tokens) if config.fixed_tokens is not None else fixed_cost()).cast("int")
    start = F.struct(picked.alias("kept"), F.array().cast("array<int>").alias("reserved"), F.lit(False).alias("done"))

    def total(kept: Column) -> Column:
        return F.aggregate(kept, F.lit(0), lambda s, p: s + cost(p))

    def step(state: Column, pos: Column) -> Column:
        room = F.lit(config.max_tokens) - base - total(state["reserved"]) - cost(pos)
        # how many of the kept ones may stay: the longest beginning that fits
        upto = F.aggregate(
            state["kept"],
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("sum"), F.lit(True).alias("on")),
            lambda s, p: F.when(s["on"] & (s["sum"] + cost(p) <= room), F.struct((s["n"] + 1).alias("n"), (s["sum"] + cost(p)).alias("sum"), F.lit(True).alias("on"))).otherwise(F.struct(s["n"].alias("n"), s["sum"].alias("sum"), F.lit(False).alias("on"))),
        )["n"]
        full = F.size(state["reserved"]) >= config.recent_slots
        kept = F.slice(state["kept"], F.lit(1), F.greatest(upto, F.lit(0)))
        never = room < 0
        return F.when(state["done"] | full, state).when(never, F.struct(F.array().cast("array<int>").alias("kept"), state["reserved"].alias("reserved"), F.lit(True).alias("done"))).otherwise(
            F.struct(kept.alias("kept"), F.concat(state["reserved"], F.array(pos)).alias("reserved"), F.lit(False).alias("done"))
        )

    out = F.aggregate(newest, start, step)
    return F.concat(out["kept"], out["reserved"])


def pick(rows: DataFrame, config: RecallConfig, group: tuple[str, ...] = ()) -> DataFrame:
    """Choose from scored rows (id, type, score, created_at, line); ``group`` columns make separate selections.

    Of rows of one type and cost only the first ones up to the type's quota can be chosen: where one of them finds no room
    in its quota or in the budget, neither do those after it. So at most quota * budget rows of a group are gathered, and
    with reserved slots as many of the newest as these and all quotas take.
    """
    first = [F.round("score", 9).desc(), F.col("created_at").desc(), F.col("id")]
    most = max(config.quota.values(), default=0)
    costed = rows.withColumn("cost", T.estimate_tokens("line")).filter(F.col("cost") <= config.max_tokens)
    alike = Window.partitionBy(*group, "type", "cost").orderBy(*first)
    able = costed.withColumn("_n", F.row_number().over(alike)).filter(F.col("_n") <= most).drop("_n")
    if config.recent_slots:
        newest = Window.partitionBy(*group).orderBy(F.col("created_at").desc(), *first)
        recent = rows.withColumn("cost", T.estimate_tokens("line")).withColumn("_n", F.row_number().over(newest))
        recent = recent.filter(F.col("_n") <= config.recent_slots + sum(config.quota.values())).drop("_n")
        able = able.union(recent).dropDuplicates([*group, "id"])
    items = able.withColumn("pos", F.row_number().over(Window.partitionBy(*group).orderBy(*first)))
    gathered = items.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("pos", "type", "cost", "created_at", "id"))).alias("items"))
    chosen = gathered.withColumn("picked", _greedy(config)["picked"])
    if config.recent_slots:
        chosen = chosen.withColumn("picked", _with_slots(config, F.col("picked"), F.col("items")))
    places = chosen.select(*group, F.posexplode("picked").alias("place", "pos"))
    on = [*group, "pos"]
    return items.join(places, on).select(*group, (F.col("place") + 1).alias("place"), *[c for c in rows.columns if c not in group], "cost")


def select_memories(memories: DataFrame, query: str, now_ms: int, cwd: str | None = None, config: RecallConfig = RecallConfig()) -> DataFrame:
    """Full selection for one query (R10): place, id, type, text, score, age_days, line, cost."""
    relevance = None
    if query.strip() and config.relevance_weight > 0:
        queries = memories.sparkSession.createDataFrame([(0, query)], "qid int, query string")
        relevance = search_scores(memories, queries, cwd).select("id", "score")
    rows = scored(memories, now_ms, cwd, config, relevance).withColumn("line", rendered_line(config))
    return pick(rows.select("id", "type", "text", "score", "age_days", "created_at", "line"), config)


def sweep(memories: DataFrame, probes: DataFrame, settings: dict[str, RecallConfig], now_ms: int, cwd: str | None = None, genuine: Column | None = None) -> DataFrame:
    """One row for each of the named settings (A17, A19): the number of ``probes (qid, query, target_id)``, how many have
    their target among the chosen memories, mean count and mean tokens of the block, the share of the chosen memories
    that are ``genuine``, and how many probes have a block at all.

    Probes and settings are few; every probe meets every eligible memory once for each setting.
    """
    hits = search_scores(memories, probes.select("qid", "query"), cwd)
    out = None
    for name, config in settings.items():
        rows = scored(memories, now_ms, cwd, config, hits, probes).withColumn("line", rendered_line(config))
        rows = rows.withColumn("_genuine", F.lit(True) if genuine is None else F.coalesce(genuine, F.lit(False)))
        chosen = pick(rows.select("qid", "id", "type", "score", "created_at", "line", "_genuine"), config, ("qid",))
        lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n")
        block = F.concat(F.lit(HEADER + "\n"), lines, F.lit(HELP))
        blocks = chosen.groupBy("qid").agg(F.count("*").alias("n"), F.count_if("_genuine").alias("good"), T.estimate_tokens(block).alias("tokens"), F.collect_set("id").alias("ids"))
        each = probes.join(blocks, "qid", "left")
        n, tokens, good = (F.coalesce(F.col(c), F.lit(0)) for c in ("n", "tokens", "good"))
        row = each.agg(
            F.count("*").alias("probes"), F.count_if(F.array_contains("ids", F.col("target_id"))).alias("covered"), F.avg(n).alias("mean_count"), F.avg(tokens).alias("mean_tokens"),
            F.coalesce(F.try_divide(F.sum(good), F.sum(n)), F.lit(0.0)).alias("share"), F.count_if(n > 0).alias("non_empty"),
        )
        row = row.select(F.lit(name).alias("setting"), "*")
        out = row if out is None else out.union(row)
    return out


#: The types that a memory can have, and what each setting of a recall must be.
TYPES = ("constraint", "pitfall", "decision", "preference", "fact")


def resolve_config(raw: dict) -> tuple[RecallConfig, list[str]]:
    """The configuration of untrusted ``raw`` values and what was wrong with them (F24): unknown types are dropped,
    numbers that are none or not finite become the default, shares are held to [0, 1], quotas add to the defaults."""
    default, problems, found = RecallConfig(), [], {}
    if isinstance(raw.get("types"), (list, tuple)):
        known = tuple(t for t in raw["types"] if t in TYPES)
        if len(known) < len(raw["types"]):
            problems.append("types: unknown type names were dropped")
        found["types"] = known or default.types
    for name in ("max_tokens", "relevance_weight", "recency_bonus", "recent_slots", "fixed_tokens"):
        if raw.get(name) is None:
            continue
        value = raw[name]
        if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
            problems.append(f"{name}: not a finite number; using the default")
        else:
            found[name] = min(1.0, max(0.0, float(value))) if name == "relevance_weight" else float(value) if name == "recency_bonus" else int(value)
    for name in ("include_needs_review", "prefer_canonical", "omit_redundant_id"):
        if isinstance(raw.get(name), bool):
            found[name] = raw[name]
        elif raw.get(name) is not None:
            problems.append(f"{name}: not a boolean; using the default")
    quota = raw.get("quota")
    if isinstance(quota, dict):
        good = {t: int(q) for t, q in quota.items() if isinstance(q, (int, float)) and not isinstance(q, bool) and math.isfinite(q)}
        if len(good) < len(quota):
            problems.append("quota: not a finite number; using the default")
        found["quota"] = default.quota | good
    elif quota is not None:
        problems.append("quota: not a mapping; using the default")
    return replace(default, **found), problems


def render(chosen: DataFrame, include_help: bool = True) -> DataFrame:
    """One row with the block; empty without memories."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n")
    return chosen.agg(F.when(F.count("*") == 0, "").otherwise(F.concat(F.lit(HEADER + "\n"), lines, F.lit(HELP if include_help else ""))).alias("block"))


def recall_changes(recalls: DataFrame) -> DataFrame:
    """Recalls ``(session_id, t, ids)`` whose ids differ from the session's last ones."""
    last = F.lag("ids").over(Window.partitionBy("session_id").orderBy("t"))
    return recalls.withColumn("_last", last).filter(~F.col("_last").eqNullSafe(F.col("ids"))).drop("_last")


def funnel(memories: DataFrame, targets: DataFrame, selected: DataFrame, types: tuple[str, ...], ranks: DataFrame, most_rank: int) -> DataFrame:
    """``(qid, stage)``: where each probe's target was lost: injected, type, rank, budget or quota."""
    rows = targets.join(memories.select("id", "type"), "id", "left").join(selected.select("qid", "id", F.lit(True).alias("in")), ["qid", "id"], "left").join(ranks.select("qid", "id", "rank"), ["qid", "id"], "left")
    stage = F.when(F.col("in"), "injected").when(~F.col("type").isin(*types), "type").when(F.col("rank").isNull() | (F.col("rank") > most_rank), "rank").otherwise("budget-or-quota")
    return rows.select("qid", "id", stage.alias("stage"))
