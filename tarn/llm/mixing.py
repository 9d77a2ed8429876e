"""Mixing sources to target weights (operator 9), with DataFrame functions only.

Budgets run down a domain > language > source tree.  Each level is water-filled with
exact integers: a child that cannot use its share takes all it has, and what is short
goes to its siblings by weight.  As a subtree never gets more than it can supply, what
siblings can't take has already gone to the ancestors' siblings.  Each leaf then takes
whole epochs of its documents and a token prefix of the next seeded epoch.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, small, table

LEVELS = ("domain", "lang", "source")
#: Hex digits that each step adds when the last document of a prefix is looked for.
STEP, DEPTH = 2, 3


def _weight(col: Column, weights: dict[str, int], default: int) -> Column:
    if any(int(w) != w or w < 0 for w in (*weights.values(), default)):
        raise ValueError("weights are whole numbers from 0")
    return reduce(lambda c, kv: F.when(col == kv[0], F.lit(int(kv[1])).cast("long")).otherwise(c), weights.items(), F.lit(int(default)).cast("long"))


def _fill(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Adds ``budget`` to ``nodes``: columns parents, name, weight, cap and parent_budget.

    With children by cap / weight, child i is full if B >= (caps before it) + (weights
    from it on) * cap / weight; the others share the rest by weight.  All products are
    exact decimals, so no rounding depends on the order of rows.
    """
    d = "decimal(38,0)"
    w, cap, b = (F.col(c).cast(d) for c in ("weight", "cap", "parent_budget"))
    order = [F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).asc_nulls_last(), F.col(name).asc_nulls_first()]
    by = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    before, after = by.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1), by.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    caps, rest = F.coalesce(F.sum("cap").over(before), F.lit(0)).cast(d), F.sum("weight").over(after).cast(d)
    n = nodes.withColumn("_full", (F.col("weight") > 0) & (caps * w + cap * rest <= b * w))
    left = F.col("parent_budget") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("cap"))).over(by), F.lit(0))
    among = F.sum(F.when(~F.col("_full"), F.col("weight"))).over(by)
    n = n.withColumn("_left", left.cast(d)).withColumn("_among", among)
    product = (F.col("_left") * w).cast(d)
    share = ((product - product % F.col("_among").cast(d)) / F.col("_among")).cast("long")
    budget = F.when(F.col("_full"), F.col("cap")).when(F.col("weight") == 0, F.lit(0).cast("long")).otherwise(F.least("cap", share))
    return n.withColumn("budget", F.coalesce(budget, F.lit(0)).cast("long")).drop("_full", "_left", "_among")


def budgets(leaves: DataFrame, total: int, weights: dict[str, dict[str, int]], default: int = 1, max_epochs: int = 1) -> DataFrame:
    """A row for each leaf: domain, lang, source, supply, budget (tokens, longs).

    ``leaves`` has the levels and ``supply``; a node's weight is the one given for its
    value at its level, else ``default`` (null values too).  A leaf can supply its
    tokens ``max_epochs`` times, or none if it or a node above it has weight 0.  Each level
    may leave less than a token for each child.
    """
    some = reduce(lambda a, b: a & b, (_weight(F.col(x), weights.get(x, {}), default) > 0 for x in LEVELS))
    tree = leaves.withColumn("cap", F.when(some, F.col("supply") * int(max_epochs)).otherwise(F.lit(0).cast("long")))
    parents: list[str] = []
    above = None
    for level in LEVELS:
        nodes = tree.groupBy(*parents, level).agg(F.sum("cap").alias("cap"), F.first("supply").alias("supply") if level == LEVELS[-1] else F.sum("supply").alias("supply"))
        nodes = nodes.withColumn("weight", _weight(F.col(level), weights.get(level, {}), default))
        if above is None:
            nodes = nodes.withColumn("parent_budget", F.lit(int(total)).cast("long"))
        else:
            p = above.select(*(F.col(x).alias(f"_{x}") for x in parents), F.col("budget").alias("parent_budget"))
            nodes = nodes.join(p, [F.col(x).eqNullSafe(F.col(f"_{x}")) for x in parents]).drop(*(f"_{x}" for x in parents))
        above = _fill(nodes, parents, level).drop("parent_budget", "weight")
        parents.append(level)
    return above.select(*LEVELS, "supply", "budget")


def mix(docs: DataFrame, weights: dict[str, dict[str, int]], fraction: tuple[int, int], tokens: Column, domain: Column, seed: int = 0, max_epochs: int = 1, default: int = 1) -> DataFrame:
    """Documents that the mix takes, with ``domain``, ``n_tokens``, ``budget`` and ``n_copies``.

    The mix has ``fraction`` (numerator, denominator) of all tokens.  A leaf with budget
    b and supply s gives b div s whole epochs, and of the next epoch the documents in
    the order of md5(seed, epoch, doc_id) whose running sum of tokens stays within the
    rest.  Rows that tie in that order (repeated rows, null ids) go together.

    The prefix of a leaf is found in ``DEPTH`` steps of 256 ranges of the hash, each on
    sums made before the shuffle, so that only the last range's rows are ordered in one
    task, however large a leaf is.  Null lang or source is a leaf of its own; null or
    empty texts have no tokens and go with their range.  An empty table gives no rows.
    Columns named as the added ones are replaced.
    """
    names = [c for c in docs.columns if c not in ("domain", "n_tokens", "budget", "n_copies")]
    d = docs.select(*names, domain.alias("domain"), tokens.cast("long").alias("n_tokens"))
    leaves = checkpointed(d.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("supply")))
    total = (leaves.agg(F.sum("supply")).first()[0] or 0) * fraction[0] // fraction[1]
    plan = budgets(leaves, total, weights, default, max_epochs)
    supply = F.greatest(F.col("supply"), F.lit(1))
    plan = plan.withColumn("_e", F.floor(F.col("budget") / supply)).withColumn("_rest", F.col("budget") - F.col("_e") * F.col("supply"))
    same = lambda p: [F.col(x).eqNullSafe(F.col(f"{p}{x}")) for x in LEVELS]
    plan = checkpointed(plan)
    few = small(plan)
    renamed = plan.select(*(F.col(x).alias(f"_l_{x}") for x in LEVELS), "budget", "_e", "_rest")
    d = d.join(few(renamed), same("_l_")).drop(*(f"_l_{x}" for x in LEVELS))
    d = d.withColumn("_k", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("_e").cast("string"), F.col("doc_id").cast("string"))))
    # Where the prefix ends: per leaf, the range in which the running sum passes the rest.
    ends = renamed.select(*(F.col(f"_l_{x}").alias(x) for x in LEVELS), F.lit("").alias("_at"), F.lit(0).cast("long").alias("_sum"), "_rest")
    ranges = d.groupBy(*LEVELS, F.substring("_k", 1, STEP * DEPTH).alias("_r")).agg(F.sum("n_tokens").alias("_n"))
    ranges = checkpointed(ranges)
    for step in range(1, DEPTH + 1):
        e = ends.select(*(F.col(x).alias(f"_e_{x}") for x in LEVELS), "_at", "_sum", "_rest")
        inside = ranges.join(few(e), [*same("_e_"), F.col("_r").startswith(F.col("_at"))]).drop(*(f"_e_{x}" for x in LEVELS))
        part = inside.groupBy(*LEVELS, F.substring("_r", 1, STEP * step).alias("_p")).agg(F.sum("_n").alias("_n"), F.first("_sum").alias("_sum"), F.first("_rest").alias("_rest"))
        run = F.sum("_n").over(Window.partitionBy(*LEVELS).orderBy("_p"))
        part = part.withColumn("_to", F.col("_sum") + run).where(F.col("_to") > F.col("_rest"))
        ends = part.groupBy(*LEVELS).agg(F.min(F.struct("_p", (F.col("_to") - F.col("_n")).alias("_sum"), "_rest")).alias("_x")).select(*LEVELS, F.col("_x._p").alias("_at"), F.col("_x._sum").alias("_sum"), F.col("_x._rest").alias("_rest"))
    e = ends.select(*(F.col(x).alias(f"_e_{x}") for x in LEVELS), F.col("_at"), F.col("_sum"))
    d = d.join(few(checkpointed(e)), same("_e_"), "left").drop(*(f"_e_{x}" for x in LEVELS))
    r = F.substring("_k", 1, STEP * DEPTH)
    d = d.withColumn("_in", F.when(F.col("_at").isNull() | (r < F.col("_at")), True).when(r > F.col("_at"), False))
    last = d.where("_in IS NULL")
    run = F.sum("n_tokens").over(Window.partitionBy(*LEVELS).orderBy("_k"))
    last = last.withColumn("_in", F.col("_sum") + run <= F.col("_rest"))
    d = d.where("_in IS NOT NULL").unionByName(last)
    taken = F.col("_e") + F.when(F.col("_in") & (F.col("_rest") > 0), 1).otherwise(0)
    return d.withColumn("n_copies", taken.cast("long")).where("n_copies > 0").select(*names, "domain", "n_tokens", "budget", "n_copies")


#: The mix of the query: which sources are curated, the weights by level, and its size.
CURATED = ("src0", "src1", "src2", "src3", "src4")
WEIGHTS = {"domain": {"curated": 3, "crawl": 2}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}, "source": {"src0": 2, "src7": 3}}
FRACTION, SEED, MAX_EPOCHS = (4, 5), 20, 3


def source_domain() -> Column:
    return F.when(F.col("source").isin(*CURATED), "curated").otherwise("crawl")


def approx_tokens() -> Column:
    """Four bytes count as a token, rounded up; null has none."""
    return F.coalesce(F.ceil(F.octet_length("text") / 4), F.lit(0)).cast("long")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", approx_tokens().alias("_n"))
    out = mix(docs, WEIGHTS, FRACTION, F.col("_n"), source_domain(), SEED, MAX_EPOCHS)
    return out.select("doc_id", *LEVELS, "n_tokens", "budget", "n_copies")


def mixing_sql(documents: str = "documents", max_epochs: int = MAX_EPOCHS, fraction: tuple[int, int] = FRACTION) -> str:
    """The query in DuckDB's SQL; names start with mx_ so it can stand among other CTEs."""
    case = lambda level: f"CASE n.{level} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS[level].items()) + " ELSE 1 END"
    ctes = [
        f"mx_docs AS (SELECT doc_id, lang, source, coalesce(ceil(strlen(text) / 4.0), 0)::BIGINT AS n_tokens, CASE WHEN source IN ({', '.join(repr(x) for x in CURATED)}) THEN 'curated' ELSE 'crawl' END AS domain FROM {documents})",
        f"mx_leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS supply, (sum(n_tokens) * {max_epochs})::BIGINT AS cap FROM mx_docs GROUP BY ALL)",
    ]
    parents: list[str] = []
    for i, level in enumerate(LEVELS):
        keys = ", ".join([*parents, level])
        budget = f"(SELECT floor(sum(supply) * {fraction[0]} / {fraction[1]}) FROM mx_leaf)::HUGEINT" if not i else "p.budget::HUGEINT"
        join = "" if not i else f" JOIN mx_b{i - 1} p ON " + " AND ".join(f"n.{x} IS NOT DISTINCT FROM p.{x}" for x in parents)
        by = "PARTITION BY " + (", ".join(parents) or "1")
        order = f"{by} ORDER BY cap / nullif(weight, 0) NULLS LAST, {level} NULLS FIRST"
        ctes += [
            f"mx_n{i} AS (SELECT {', '.join('n.' + x for x in [*parents, level])}, n.cap, n.supply, {case(level)}::HUGEINT AS weight, {budget} AS parent FROM (SELECT {keys}, sum(cap)::HUGEINT AS cap, sum(supply)::HUGEINT AS supply FROM mx_leaf GROUP BY {keys}) n{join})",
            f"mx_f{i} AS (SELECT *, weight > 0 AND coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * weight + cap * sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= parent * weight AS is_full FROM mx_n{i})",
            f"mx_b{i} AS (SELECT *, coalesce(CASE WHEN is_full THEN cap WHEN weight = 0 THEN 0 ELSE least(cap, ((parent - coalesce(sum(cap) FILTER (WHERE is_full) OVER ({by}), 0)) * weight)::HUGEINT // (sum(weight) FILTER (WHERE NOT is_full) OVER ({by}))::HUGEINT) END, 0)::BIGINT AS budget FROM mx_f{i})",
        ]
        parents.append(level)
    ctes += [
        "mx_plan AS (SELECT domain, lang, source, supply, budget, budget // greatest(supply, 1) AS e FROM mx_b2)",
        f"mx_keyed AS (SELECT d.*, p.budget, p.e, p.budget - p.e * p.supply AS rest, md5(concat_ws('|', '{SEED}', p.e::VARCHAR, d.doc_id::VARCHAR)) AS k FROM mx_docs d JOIN mx_plan p ON d.domain = p.domain AND d.lang IS NOT DISTINCT FROM p.lang AND d.source IS NOT DISTINCT FROM p.source)",
        "mx_out AS (SELECT *, (e + CASE WHEN rest > 0 AND sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY k) <= rest THEN 1 ELSE 0 END)::BIGINT AS n_copies FROM mx_keyed)",
    ]
    return ", ".join(ctes)


OP9_SQL = f"WITH {mixing_sql()} SELECT doc_id, domain, lang, source, n_tokens, budget::BIGINT AS budget, n_copies FROM mx_out WHERE n_copies > 0"
