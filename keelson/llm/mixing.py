"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

A token budget flows down a domain-language-source tree by weights. At each node, children that can
supply less than their share give all they have, and their shortage is dealt again among their
siblings by weight; only what a whole subtree lacks reaches its ancestors' other children. A leaf
with budget b and t tokens takes floor(b / t) whole epochs and a prefix of the next one, in an order
seeded by the epoch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, small

LEVELS = ("domain", "lang", "source")
TOKEN = r"[^\x20\x09-\x0D]+"
DEFAULT_WEIGHT = 10
#: Slices of a leaf's seeded order: tokens are summed by slice, and only one slice of a leaf is sorted.
SLICES = 1024


def tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(TOKEN)).cast("long")


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """A document's place in the order of an epoch: 60 bits of MD5."""
    name = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("long")


def _water(nodes: DataFrame, parent: list[str], child: str, budget: str) -> DataFrame:
    """Share the parent's budget among its children: capacity and weight columns in, share out."""
    ratio = (F.col("capacity") / F.col("weight")).alias("ratio")
    rows = nodes.select("*", ratio)
    up = Window.partitionBy(*[F.col(c) for c in parent] or [F.lit(0)]).orderBy("ratio", F.col(child).asc_nulls_first())
    level = (F.col(budget) - F.coalesce(F.sum("capacity").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) / F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", level).withColumn("short", F.col("ratio") <= F.col("level"))
    whole = Window.partitionBy(*[F.col(c) for c in parent] or [F.lit(0)])
    # the first child that isn't short sets the level of all that aren't
    rows = rows.withColumn("at", F.min(F.when(~F.col("short"), F.struct("ratio", F.coalesce(F.col(child), F.lit("")).alias("c"), "level"))).over(whole))
    before = F.struct("ratio", F.coalesce(F.col(child), F.lit("")).alias("c")) < F.struct(F.col("at.ratio").alias("ratio"), F.col("at.c").alias("c"))
    share = F.when(F.col("at").isNull() | before, F.col("capacity")).otherwise(F.least("capacity", F.floor(F.col("weight") * F.col("at.level"))))
    return rows.withColumn("share", share.cast("long")).drop("ratio", "level", "short", "at")


def _weights(table: dict | None, name: str) -> Column:
    pairs = [x for k, v in (table or {}).items() for x in (F.lit(k), F.lit(int(v)))]
    found = F.try_element_at(F.create_map(*pairs), F.coalesce(F.col(name), F.lit(""))) if pairs else F.lit(None)
    return F.greatest(F.coalesce(found, F.lit(DEFAULT_WEIGHT)).cast("long"), F.lit(0))


def budgets(leaves: DataFrame, total: Column, weights: dict[str, dict[str, int]], max_epochs: int) -> DataFrame:
    """leaves(domain, lang, source, n_tokens) with each leaf's budget, at most max_epochs * n_tokens.

    weights: integer weights by level and name; a name without one has weight 10, and with weight 0
    gets nothing. The tables here have a row for each leaf of the tree.
    """
    w = {c: _weights(weights.get(c), c) for c in LEVELS}
    usable = leaves.withColumns({f"w_{c}": w[c] for c in LEVELS}).withColumn("capacity", F.when((F.col("w_domain") > 0) & (F.col("w_lang") > 0) & (F.col("w_source") > 0), F.col("n_tokens") * max_epochs).otherwise(0))
    live = usable.where("capacity > 0")
    domain = live.groupBy("domain").agg(F.sum("capacity").alias("capacity"), F.first("w_domain").alias("weight")).withColumn("total", total)
    domain = _water(domain, [], "domain", "total").select(F.col("domain").alias("d1"), F.col("share").alias("b1"))
    lang = live.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity"), F.first("w_lang").alias("weight"))
    lang = lang.join(domain, F.col("domain").eqNullSafe(F.col("d1"))).drop("d1")
    lang = _water(lang, ["domain"], "lang", "b1").select(F.col("domain").alias("d2"), F.col("lang").alias("l2"), F.col("share").alias("b2"))
    leaf = live.withColumn("weight", F.col("w_source")).join(lang, F.col("domain").eqNullSafe(F.col("d2")) & F.col("lang").eqNullSafe(F.col("l2"))).drop("d2", "l2")
    leaf = _water(leaf, ["domain", "lang"], "source", "b2")
    return leaf.select(*LEVELS, "n_tokens", F.col("share").alias("budget"))


def _same_leaf(a: str = "") -> Column:
    on = F.lit(True)
    for c in LEVELS:
        on = on & F.col(c).eqNullSafe(F.col(f"p_{c}"))
    return on


def plan(spark: SparkSession, docs: DataFrame, domain: Column, weights: dict, share: float, max_epochs: int, seed: int, slices: int = SLICES) -> tuple[DataFrame, DataFrame]:
    """(slim, leaves). slim: doc_id, domain, lang, source, n_tokens, text_hash for each row of docs.
    leaves: budget, whole epochs, and the last (key, text_hash) of the prefix of the next epoch."""
    slim = materialize(docs.select("doc_id", domain.alias("domain"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), tokens(F.col("text")).alias("n_tokens"), F.xxhash64("text").alias("text_hash")), "slim")
    leaves = materialize(slim.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("n_tokens")), "leaves")
    total = leaves.agg(F.sum("n_tokens")).first()[0] or 0
    leaf = budgets(leaves, F.lit(int(total * share)).cast("long"), weights, max_epochs)
    leaf = leaf.where("n_tokens > 0").withColumns({"epochs": F.floor(F.col("budget") / F.col("n_tokens")).cast("int"), "rest": F.expr("budget % n_tokens")})
    leaf = materialize(leaf, "plan")
    n_leaf = leaf.count()
    named = leaf.select(*[F.col(c).alias(f"p_{c}") for c in LEVELS], "budget", "epochs", "rest")
    keyed = slim.join(small(named, n_leaf), _same_leaf()).withColumn("key", order_key(seed, F.col("epochs"), F.col("doc_id")))
    keyed = keyed.withColumn("slice", F.floor(F.col("key") / (2**60 // slices)).cast("int"))
    sums = keyed.groupBy(*LEVELS, "slice").agg(F.sum("n_tokens").alias("t"), F.first("rest").alias("rest"))
    run = Window.partitionBy(*LEVELS).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("t").over(run), F.lit(0)))
    # the slice in which the prefix ends; all slices before it are in whole
    cut = sums.where("before <= rest").groupBy(*[F.col(c).alias(f"s_{c}") for c in LEVELS]).agg(F.max(F.struct("slice", "before")).alias("c"))
    cut = cut.select(*[f"s_{c}" for c in LEVELS], F.col("c.slice").alias("cut_slice"), F.col("c.before").alias("before"))
    on = (F.col("slice") == F.col("cut_slice"))
    for c in LEVELS:
        on = on & F.col(c).eqNullSafe(F.col(f"s_{c}"))
    ends = keyed.join(small(cut, n_leaf), on)
    inner = Window.partitionBy(*LEVELS).orderBy("key", "text_hash")  # rows equal in both are taken or left together
    ends = ends.withColumn("upto", F.col("before") + F.sum("n_tokens").over(inner)).where("upto <= rest")
    last = ends.groupBy(*[F.col(c).alias(f"e_{c}") for c in LEVELS]).agg(F.max(F.struct("key", "text_hash")).alias("last"))
    out = leaf
    for side, x in (("s", cut), ("e", last)):
        on = F.lit(True)
        for c in LEVELS:
            on = on & F.col(c).eqNullSafe(F.col(f"{side}_{c}"))
        out = out.join(small(x, n_leaf), on, "left").drop(*[f"{side}_{c}" for c in LEVELS])
    return slim, materialize(out.select(*LEVELS, "n_tokens", "budget", "epochs", "rest", "cut_slice", "last"), "cuts")


def copies(rows: DataFrame, leaves: DataFrame, seed: int, slices: int = SLICES) -> DataFrame:
    """rows (doc_id, domain, lang, source, text_hash, ...) with copies: how often each is taken. One pass, no shuffle
    while the tree is small."""
    named = leaves.select(*[F.col(c).alias(f"p_{c}") for c in LEVELS], "budget", "epochs", "cut_slice", "last")
    out = rows.join(small(named, leaves.count()), _same_leaf(), "left").drop(*[f"p_{c}" for c in LEVELS])
    key = order_key(seed, F.col("epochs"), F.col("doc_id"))
    out = out.withColumn("_key", key)
    piece = F.floor(F.col("_key") / (2**60 // slices)).cast("int")
    inside = (piece < F.col("cut_slice")) | ((piece == F.col("cut_slice")) & (F.struct(F.col("_key").alias("key"), "text_hash") <= F.col("last")))
    out = out.withColumn("copies", F.coalesce(F.col("epochs") + F.when(inside, 1).otherwise(0), F.lit(0)))
    return out.drop("_key", "epochs", "cut_slice", "last")


#: The domain tree of the registered query, and its weights, in parts of any whole.
def default_domain(source: Column) -> Column:
    n = F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) as int)")
    return F.when(n < 7, "web").when(n < 14, "reference").when(n >= 14, "forum").otherwise("other")


WEIGHTS = {"domain": {"web": 50, "reference": 30, "forum": 20}, "lang": {"en": 55, "de": 15, "fr": 15, "es": 15}}
SHARE, MAX_EPOCHS, SEED = 0.75, 2, 17


def mix(spark: SparkSession, docs: DataFrame, domain: Column | None = None, weights: dict | None = None, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, budget (of the leaf), copies for each row of docs.

    copies counts the epochs a row is taken in, 0 if in none. Null lang, source and doc_id are values
    of their own; null and empty texts have no tokens; rows equal in doc_id and text are taken or
    left together; a prefix ends before the budget would be passed. Other columns are ignored.
    """
    domain = default_domain(F.col("source")) if domain is None else domain
    slim, leaves = plan(spark, docs, domain, weights or WEIGHTS, share, max_epochs, seed)
    return copies(slim, leaves, seed).select("doc_id", *LEVELS, "n_tokens", F.coalesce("budget", F.lit(0)).alias("budget"), "copies")


def mixed(spark: SparkSession, docs: DataFrame, domain: Column | None = None, weights: dict | None = None, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The rows of docs as the mixture takes them, all columns, each as often as it has copies."""
    domain = default_domain(F.col("source")) if domain is None else domain
    _, leaves = plan(spark, docs, domain, weights or WEIGHTS, share, max_epochs, seed)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", domain.alias("domain"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("text_hash"))
    taken = copies(row, leaves, seed).where("copies > 0")
    return taken.select(F.explode(F.array_repeat("row", F.col("copies"))).alias("row")).select("row.*")


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens,
    CASE WHEN TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) < 7 THEN 'web' WHEN TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) < 14 THEN 'reference'
         WHEN TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) >= 14 THEN 'forum' ELSE 'other' END AS domain
  FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS n_tokens, 10::BIGINT AS weight FROM d GROUP BY ALL HAVING sum(n_tokens) > 0),
c1 AS (SELECT domain, sum(n_tokens)::BIGINT * 2 AS cap, CASE domain WHEN 'web' THEN 50 WHEN 'reference' THEN 30 WHEN 'forum' THEN 20 ELSE 10 END::BIGINT AS weight,
         floor((SELECT sum(n_tokens) FROM leaf) * 0.75)::BIGINT AS b FROM leaf GROUP BY domain),
l1 AS (SELECT *, cap / weight AS r, (b - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
       FROM c1 WINDOW o AS (ORDER BY cap / weight, domain)),
s1 AS (SELECT *, min({'r': r, 'c': domain, 'lev': lev}) FILTER (r > lev) OVER () AS edge FROM l1),
b1 AS (SELECT domain, CASE WHEN edge IS NULL OR (r, domain) < (edge.r, edge.c) THEN cap ELSE least(cap, floor(weight * edge.lev)) END::BIGINT AS share FROM s1),
c2 AS (SELECT domain, lang, sum(n_tokens)::BIGINT * 2 AS cap, CASE lang WHEN 'en' THEN 55 WHEN 'de' THEN 15 WHEN 'fr' THEN 15 WHEN 'es' THEN 15 ELSE 10 END::BIGINT AS weight, any_value(share) AS b
       FROM leaf JOIN b1 USING (domain) GROUP BY domain, lang),
l2 AS (SELECT *, cap / weight AS r, (b - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
       FROM c2 WINDOW o AS (PARTITION BY domain ORDER BY cap / weight, lang)),
s2 AS (SELECT *, min({'r': r, 'c': lang, 'lev': lev}) FILTER (r > lev) OVER (PARTITION BY domain) AS edge FROM l2),
b2 AS (SELECT domain, lang, CASE WHEN edge IS NULL OR (r, lang) < (edge.r, edge.c) THEN cap ELSE least(cap, floor(weight * edge.lev)) END::BIGINT AS share FROM s2),
c3 AS (SELECT domain, lang, source, n_tokens, n_tokens * 2 AS cap, weight, share AS b FROM leaf JOIN b2 USING (domain, lang)),
l3 AS (SELECT *, cap / weight AS r, (b - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
       FROM c3 WINDOW o AS (PARTITION BY domain, lang ORDER BY cap / weight, source)),
s3 AS (SELECT *, min({'r': r, 'c': source, 'lev': lev}) FILTER (r > lev) OVER (PARTITION BY domain, lang) AS edge FROM l3),
b3 AS (SELECT domain, lang, source, n_tokens AS leaf_tokens, CASE WHEN edge IS NULL OR (r, source) < (edge.r, edge.c) THEN cap ELSE least(cap, floor(weight * edge.lev)) END::BIGINT AS budget FROM s3),
k AS (SELECT d.*, budget, budget // leaf_tokens AS epochs, budget % leaf_tokens AS rest, ('0x' || substr(md5('17:' || (budget // leaf_tokens) || ':' || doc_id), 1, 15))::BIGINT AS key
      FROM d LEFT JOIN b3 USING (domain, lang, source)),
p AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key) AS upto FROM k)
SELECT doc_id, domain, lang, source, n_tokens, coalesce(budget, 0) AS budget, coalesce(epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END, 0)::INTEGER AS copies FROM p
"""
