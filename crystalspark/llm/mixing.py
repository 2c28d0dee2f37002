"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

A token budget flows down a tree of columns (domain, language, source). At
each node the children share it by weight; a child that can't take its share
(its documents times ``max_epochs``) is filled and its shortage goes to its
siblings, and only what all of them can't take stays with the ancestors,
whose own sharing already counts with the subtree's capacity. Amounts are
whole tokens: the floors' remainder goes to the first unfilled siblings.

Each leaf then reads seeded epochs: whole passes, and of the last one the
prefix in the order of md5(seed:epoch:doc_id). Prefix sums run over 4096
ranges of that hash per leaf and epoch, so a source with a third of all rows
is spread over that many windows. What is needed of the rows (no text), the
leaves' sums and their budgets are written once each, so that the tree's many
small windows and the last pass over the rows are separate plans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from crystalspark.llm.common import materialise

#: Documents without a domain of their own are dealt into four by their source.
DOMAIN_SQL = "CASE WHEN substr(md5(coalesce(source, '')), 1, 1) < '4' THEN 'd0' WHEN substr(md5(coalesce(source, '')), 1, 1) < '8' THEN 'd1' WHEN substr(md5(coalesce(source, '')), 1, 1) < 'c' THEN 'd2' ELSE 'd3' END"
LEVELS = ("domain", "lang", "source")
WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}, "source": {}}


def tokens_of(text: str = "text") -> Column:
    """Estimated tokens: a quarter of the UTF-8 bytes, rounded up, at least 1."""
    return F.greatest(F.lit(1), F.ceil(F.octet_length(F.coalesce(F.col(text), F.lit(""))) / 4)).cast("long")


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    out = F.lit(1).cast("long")
    for value, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == value, F.lit(int(w)).cast("long")).otherwise(out)
    return out


def share_out(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Add ``alloc``: the parent's ``budget`` shared among rows with ``cap`` and whole ``weight``s."""
    order = W.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), name) if parent else W.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), name)
    whole = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    step = children.where("weight > 0").select(
        "*",
        (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("_left"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("_weights"),
    )
    step = step.withColumn("_full", F.col("cap").cast("decimal(38,0)") * F.col("_weights") <= F.col("weight").cast("decimal(38,0)") * F.col("_left"))
    step = step.withColumn("_open", F.coalesce(F.sum(F.when(~F.col("_full"), 1)).over(order), F.lit(0)) > 0)
    step = step.withColumns({
        "_rest": F.col("budget") - F.coalesce(F.sum(F.when(~F.col("_open"), F.col("cap"))).over(whole), F.lit(0)),
        "_base": F.sum(F.when(F.col("_open"), F.col("weight"))).over(whole),
    })
    step = step.withColumn("_floor", F.when(F.col("_open"), F.expr("(cast(weight as decimal(38,0)) * _rest) div _base")).otherwise(F.col("cap")).cast("long"))
    step = step.withColumn("_extra", F.col("_rest") - F.coalesce(F.sum(F.when(F.col("_open"), F.col("_floor"))).over(whole), F.lit(0)))
    rank = F.row_number().over(W.partitionBy(*parent, "_open").orderBy(name))
    return step.withColumn("alloc", F.col("_floor") + F.when(F.col("_open") & (rank <= F.col("_extra")), 1).otherwise(0)).drop(
        "_left", "_weights", "_full", "_open", "_rest", "_base", "_floor", "_extra"
    )


def leaf_budgets(rows: DataFrame, fraction: float, max_epochs: int, levels=LEVELS, weights=WEIGHTS) -> DataFrame:
    """(levels, supply, alloc) per leaf; ``rows`` has the levels and ``tokens``. The budget is ``fraction`` of all tokens, rounded down."""
    leaves = materialise(rows.groupBy(*levels).agg(F.sum("tokens").alias("supply")), "mix-leaves")
    total = leaves.agg(F.floor(F.sum("supply") * F.lit(fraction)).cast("long").alias("budget"))
    current = None
    for depth, level in enumerate(levels):
        nodes = leaves.groupBy(*levels[: depth + 1]).agg((F.sum("supply") * max_epochs).alias("cap"), F.sum("supply").alias("supply"))
        nodes = nodes.withColumn("weight", _weight(level, weights))
        parent = list(levels[:depth])
        # the root's budget is one row
        nodes = nodes.crossJoin(F.broadcast(total)) if current is None else nodes.join(current, parent)
        nodes = share_out(nodes, parent, level)
        current = nodes.select(*levels[: depth + 1], F.col("alloc").alias("budget"))
    return nodes.select(*levels, "supply", "alloc")


def mix(docs: DataFrame, fraction: float = 0.6, max_epochs: int = 4, seed: int = 20, levels=LEVELS, weights=WEIGHTS, text: str = "text", doc_id: str = "doc_id", row: str | None = None) -> DataFrame:
    """Chosen (doc_id, levels, epoch, start, tokens, taken): ``taken`` is the part of a document inside its leaf's prefix.

    ``row`` names a column that tells rows apart; it is returned as well and orders rows that agree in all else.

    Null levels form leaves named (null); null and empty texts count one token;
    a document may return in several epochs, repeated rows each count on their
    own. Levels or values without a weight have weight 1; weight 0 excludes.
    An empty table returns no rows; columns beyond the named ones are dropped.
    """
    named = [F.coalesce(F.col(c).cast("string"), F.lit("(null)")).alias(c) for c in levels]
    own = [row] if row else []
    rows = materialise(docs.select(F.col(doc_id).alias("doc_id"), *named, tokens_of(text).alias("tokens"), *own), "mix-rows")
    budgets = materialise(leaf_budgets(rows, fraction, max_epochs, levels, weights), "mix-budgets").where("alloc > 0").withColumn("passes", F.expr("cast((alloc + supply - 1) div supply as int)"))
    epochs = rows.join(budgets, list(levels)).withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("passes"))))
    epochs = epochs.withColumn("limit", F.least(F.col("supply"), F.col("alloc") - F.col("supply") * (F.col("epoch") - 1)))
    epochs = epochs.withColumn("_key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    epochs = epochs.withColumn("_range", F.substring("_key", 1, 3))
    sums = epochs.groupBy(*levels, "epoch", "_range").agg(F.sum("tokens").alias("_sum"))
    running = W.partitionBy(*levels, "epoch").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*levels, "epoch", "_range", F.coalesce(F.sum("_sum").over(running), F.lit(0)).alias("_before"))
    inner = W.partitionBy(*levels, "epoch", "_range").orderBy("_key", "doc_id", "tokens", *own).rowsBetween(W.unboundedPreceding, -1)
    out = epochs.join(sums, [*levels, "epoch", "_range"]).withColumn("start", F.col("_before") + F.coalesce(F.sum("tokens").over(inner), F.lit(0)))
    out = out.where("start < limit").withColumn("taken", F.least(F.col("tokens"), F.col("limit") - F.col("start")))
    return out.select("doc_id", *levels, "epoch", "start", "tokens", "taken", *own)


def with_domain(docs: DataFrame) -> DataFrame:
    return docs if "domain" in docs.columns else docs.withColumn("domain", F.expr(DOMAIN_SQL))


def _level_sql(depth: int, levels=LEVELS, weights=WEIGHTS) -> str:
    """One level of the sharing as SQL over ``leaves`` and the level above."""
    keys, level, parent = ", ".join(levels[: depth + 1]), levels[depth], list(levels[:depth])
    by = "PARTITION BY " + ", ".join(parent) if parent else ""
    weight = "CASE " + " ".join(f"WHEN {level} = '{v}' THEN {w}" for v, w in weights[level].items()) + " ELSE 1 END" if weights.get(level) else "1"
    above = f"b{depth - 1} USING ({', '.join(parent)})" if parent else "total ON true"
    prior = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    opened = f"PARTITION BY {', '.join([*parent, 'opened'])}"
    return f"""
n{depth} AS (SELECT *, {weight} AS weight FROM (SELECT {keys}, sum(supply) * EPOCHS AS cap, sum(supply) AS supply FROM leaves GROUP BY {keys}) JOIN {above}),
s{depth} AS (SELECT *, budget - coalesce(sum(cap) OVER (o {prior}), 0) AS rest0, sum(weight) OVER (w) - coalesce(sum(weight) OVER (o {prior}), 0) AS weights
  FROM n{depth} WINDOW w AS ({by}), o AS ({by} ORDER BY cap / weight, {level})),
f{depth} AS (SELECT *, coalesce(sum(CASE WHEN cap * weights > weight * rest0 THEN 1 END) OVER ({by} ORDER BY cap / weight, {level} ROWS UNBOUNDED PRECEDING), 0) > 0 AS opened FROM s{depth}),
g{depth} AS (SELECT *, budget - coalesce(sum(CASE WHEN NOT opened THEN cap END) OVER ({by}), 0) AS rest, sum(CASE WHEN opened THEN weight END) OVER ({by}) AS base FROM f{depth}),
h{depth} AS (SELECT *, CASE WHEN opened THEN (weight * rest) // base ELSE cap END AS low FROM g{depth}),
b{depth} AS (SELECT {keys}, supply, low + CASE WHEN opened AND row_number() OVER ({opened} ORDER BY {level}) <= rest - coalesce(sum(CASE WHEN opened THEN low END) OVER ({by}), 0) THEN 1 ELSE 0 END AS budget FROM h{depth})"""


def oracle(fraction: float = 0.6, max_epochs: int = 4, seed: int = 20) -> str:
    level_sql = ",".join(_level_sql(d) for d in range(3)).replace("EPOCHS", str(max_epochs)).replace("SELECT domain, lang, supply,", "SELECT domain, lang,").replace("SELECT domain, supply,", "SELECT domain,")
    return f"""
WITH r AS (SELECT doc_id, {DOMAIN_SQL} AS domain, coalesce(lang, '(null)') AS lang, coalesce(source, '(null)') AS source,
       greatest(1, CAST(ceil(strlen(coalesce(text, '')) / 4) AS BIGINT)) AS tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(tokens) AS supply FROM r GROUP BY ALL),
total AS (SELECT CAST(floor(sum(supply) * {fraction}::DOUBLE) AS BIGINT) AS budget FROM leaves),{level_sql},
e AS (SELECT r.*, x.epoch, supply, least(supply, budget - supply * (x.epoch - 1)) AS lim,
       md5('{seed}:' || x.epoch || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM r JOIN b2 USING (domain, lang, source) JOIN (SELECT CAST(range AS INT) AS epoch FROM range(1, {max_epochs + 1})) x ON x.epoch <= (budget + supply - 1) // supply WHERE budget > 0),
p AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY k, doc_id, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM e)
SELECT doc_id, domain, lang, source, epoch, CAST(start AS BIGINT) AS start, tokens, CAST(least(tokens, lim - start) AS BIGINT) AS taken FROM p WHERE start < lim
"""
