"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

A tree of named levels (here domain, language, source) has a weight for every
node. The token budget is shared out from the root down. Among siblings it is
water-filled: a node whose subtree can't supply its share gives all it has, and
what is missing goes to its siblings by their weights; only what the siblings
together can't supply is missing at their parent, and so passes to the parent's
siblings. All arithmetic is in whole tokens.

A leaf that is given more than it has repeats its documents in epochs. Epoch e
is ordered by md5(seed:e:doc_id); a leaf takes its whole epochs, and from the
next one the longest prefix that fits the rest. That prefix is found without
sorting the leaf: tokens are summed in 256 slots of the order, then in 256 slots
of the one in which the budget ends, and only the slot in which it ends then is
looked at document by document.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, fresh_name

#: A token, for budgets: a run without space and the ASCII controls 09 to 0D.
TOKEN = r"[^ \t\n\x0B\f\r]+"
#: Leading hexadecimal digits of the order that name a slot: 256 slots, and 256 in one of them.
SLOT_DIGITS = (2, 4)


#: Columns of the plan's own tables, besides the levels.
RESERVED = frozenset("id n_tokens have cap w node given before left short spent open share whole rest order slot n upto last cut all total".split())


@dataclass(frozen=True)
class Level:
    """A level of the tree: its name, what gives a document's node, whole-number weights."""

    name: str
    node: Column
    weights: Mapping[str, int] = field(default_factory=dict)
    other: int = 1

    def of(self) -> Column:
        """A row's node; a missing one is the node with the empty name."""
        return F.coalesce(self.node.cast("string"), F.lit(""))

    def weight(self) -> Column:
        out = F.lit(self.other).cast("long")
        for node, w in self.weights.items():
            out = F.when(F.col(self.name) == node, F.lit(w).cast("long")).otherwise(out)
        return out


def _exact(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def _whole_part(c: Column, by: Column) -> Column:
    return (_exact(c) - _exact(c) % _exact(by)) / _exact(by)


def fill(nodes: DataFrame, parent: Sequence[str]) -> DataFrame:
    """Water-fill ``given`` (the same for all of a parent) over ``w`` and ``cap``; adds ``share``."""
    siblings = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    by = siblings.orderBy(F.col("cap").cast("double") / F.col("w").cast("double"), "node")
    n = nodes.withColumn("before", F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    n = n.withColumn("left", F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing)))
    n = n.withColumn("short", _exact(F.col("before")) * F.col("w") + _exact(F.col("cap")) * F.col("left") <= _exact(F.col("given")) * F.col("w"))
    n = n.withColumn("spent", F.sum(F.when(F.col("short"), F.col("cap")).otherwise(0)).over(siblings))
    n = n.withColumn("open", F.sum(F.when(F.col("short"), 0).otherwise(F.col("w"))).over(siblings))
    part = _whole_part(_exact(F.col("given") - F.col("spent")) * F.col("w"), F.greatest(F.col("open"), F.lit(1)))
    return n.withColumn("share", F.when(F.col("short"), F.col("cap")).otherwise(part.cast("long"))).drop("before", "left", "short", "spent", "open")


def budgets(leaves: DataFrame, levels: Sequence[Level], budget: Column, epochs: int) -> DataFrame:
    """(level names, have) of the leaves to (level names, have, share). ``budget`` may use ``total``, the tokens of all leaves."""
    names = [x.name for x in levels]
    leaves = leaves.withColumn("cap", F.col("have") * epochs)
    root = leaves.agg(F.coalesce(F.sum("have"), F.lit(0)).alias("total"), F.coalesce(F.sum("cap"), F.lit(0)).alias("all"))
    given, above = root.select(F.least(budget.cast("long"), F.col("all"))).first()[0], None
    for depth, level in enumerate(levels):
        parent, path = names[:depth], names[: depth + 1]
        nodes = leaves.groupBy(*path).agg(F.sum("cap").alias("cap")).withColumn("w", level.weight()).where("w > 0").withColumn("node", F.col(level.name))
        nodes = nodes.join(above, parent) if depth else nodes.withColumn("given", F.lit(given).cast("long"))
        above = fill(nodes, parent).select(*path, F.col("share").alias("given"))
    return leaves.join(above, names).select(*names, "have", F.col("given").alias("share"))


@dataclass
class Plan:
    """What is taken of each leaf: ``whole`` epochs, and of the next one all documents whose order is at most ``cut``."""

    leaves: DataFrame
    levels: Sequence[Level]
    id_col: str
    seed: str
    ledger: DataFrame

    def order(self, id_col: str, whole: str = "whole") -> Column:
        return F.md5(F.concat(F.lit(f"{self.seed}:"), F.col(whole), F.lit(":"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))

    def take(self, docs: DataFrame, nodes: Sequence[Column] | None = None, id_col: str | None = None) -> DataFrame:
        """The chosen rows of ``docs``, once for each epoch they are chosen in, and ``epoch`` (with underscores if ``docs`` has that).

        What the levels say gives a row's nodes, unless ``nodes`` are given.
        Columns of ``docs`` stay as they are, whatever their names.
        """
        own = [fresh_name(docs, f"_node{i}") for i in range(len(self.levels))]
        whole, cut, epoch = (fresh_name(docs, x) for x in ("_whole", "_cut", "epoch"))
        rows = docs.select("*", *[c.alias(n) for n, c in zip(own, nodes or [x.of() for x in self.levels], strict=True)])
        both = rows.join(self.leaves.select(*[F.col(x.name).alias(n) for n, x in zip(own, self.levels, strict=True)], F.col("whole").alias(whole), F.col("cut").alias(cut)), own)
        copies = F.col(whole) + F.when(self.order(id_col or self.id_col, whole) <= F.col(cut), 1).otherwise(0)
        return both.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.when(copies > 0, F.sequence(F.lit(0), (copies - 1).cast("int")))).alias(epoch))


def plan(docs: DataFrame, levels: Sequence[Level], budget: Column, seed: str = "0", epochs: int = 1, id_col: str = "doc_id", text_col: str = "text") -> Plan:
    """Work out budgets and cuts for ``docs``.

    ``levels`` go from the root to the leaves; their names are those of the plan's
    own tables, must differ, and must not be one of ``RESERVED`` (ValueError); what
    columns ``docs`` has besides plays no part. A missing node is the node with the
    empty name. ``epochs`` is the most that a document is repeated. Null or blank text
    has no tokens and is never chosen. Rows of one id in one leaf stand at one
    place of the order and are chosen together. A missing id counts as one id. An
    empty table has no leaves, and nothing is chosen.
    """
    spark = docs.sparkSession
    space, names = Workspace(spark, "mix"), [x.name for x in levels]
    if len({n.lower() for n in names}) < len(names) or {n.lower() for n in names} & RESERVED:
        raise ValueError(f"names of levels: {names}")
    ledger = docs.select(F.col(id_col).alias("id"), *[x.of().alias(x.name) for x in levels], F.regexp_count(F.col(text_col), F.lit(TOKEN)).cast("long").alias("n_tokens"))
    ledger = space.keep(ledger.where("n_tokens > 0"), "ledger")
    leaves = space.keep(ledger.groupBy(*names).agg(F.sum("n_tokens").alias("have")), "leaves")
    shares = budgets(leaves, levels, budget, epochs)
    whole = _whole_part(F.col("share"), F.col("have")).cast("long")
    shares = shares.withColumn("whole", whole).withColumn("rest", F.col("share") - F.col("whole") * F.col("have")).select(*names, "whole", "rest")
    shares = space.keep(shares, "shares")
    out = Plan(shares, levels, id_col, seed, ledger)

    drawn = ledger.join(shares.where("rest > 0"), names).select(*names, "rest", "n_tokens", out.order("id").alias("order"))
    ends = shares.where("rest > 0").select(*names, F.lit("").alias("slot"), F.lit(0).cast("long").alias("before"))
    for digits in SLOT_DIGITS:  # the slot in which the budget ends, then the slot in that one
        within = drawn.join(ends, names).where(F.col("order").startswith(F.col("slot")))
        slots = within.groupBy(*names, "rest", "before", F.substring("order", 1, digits).alias("slot")).agg(F.sum("n_tokens").alias("n"))
        slots = slots.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy(*names).orderBy("slot")))
        ends = slots.where("upto > rest AND upto - n <= rest").select(*names, "slot", (F.col("upto") - F.col("n")).alias("before"))
        ends = space.keep(ends, f"ends-{digits}")
    near = drawn.join(ends, names).where(F.col("order").startswith(F.col("slot")))
    near = near.withColumn("upto", F.col("before") + F.sum("n_tokens").over(Window.partitionBy(*names).orderBy("order")))
    last = near.where("upto <= rest").groupBy(*names).agg(F.max("order").alias("last"))
    cuts = ends.join(last, names, "left").select(*names, F.coalesce("last", "slot").alias("cut"))
    out.leaves = space.keep(shares.join(cuts, names, "left").where("whole > 0 OR cut IS NOT NULL").select(*names, "whole", "cut"), "cuts")
    return out


def source_levels() -> list[Level]:
    """The tree for ``documents``: sources by number in four domains, then languages, then sources."""
    n = F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT)")
    domain = F.when(n < 5, "web").when(n < 10, "books").when(n < 15, "news").when(n >= 15, "code").otherwise("other")
    return [
        Level("domain", domain, {"web": 4, "books": 3, "news": 2, "code": 1}),
        Level("lang", F.col("lang"), {"en": 6, "fr": 2, "de": 2, "es": 2}),
        Level("source", F.col("source")),
    ]


#: Parameters of the registered query: share of all tokens, most epochs, seed.
BUDGET_PERCENT, EPOCHS, SEED = 60, 2, "7"


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    p = plan(docs, source_levels(), _whole_part(F.col("total") * BUDGET_PERCENT, F.lit(100)), SEED, EPOCHS)
    names = ["domain", "lang", "source"]
    return p.take(p.ledger, [F.col(n) for n in names], "id").select(F.col("id").alias("doc_id"), *names, "n_tokens", "epoch")


def _fill_sql(name: str, nodes: str, parent: str) -> str:
    over = f"PARTITION BY {parent}" if parent else ""
    return f"""
{name}_o AS (
  SELECT *, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef,
         sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lef
  FROM ({nodes}) WINDOW o AS ({over} ORDER BY CAST(cap AS DOUBLE) / CAST(w AS DOUBLE), node)
), {name}_s AS (
  SELECT *, CAST(bef AS HUGEINT) * w + CAST(cap AS HUGEINT) * lef <= CAST(given AS HUGEINT) * w AS short FROM {name}_o
), {name}_t AS (
  SELECT *, sum(CASE WHEN short THEN cap ELSE 0 END) OVER ({over}) AS spent, sum(CASE WHEN short THEN 0 ELSE w END) OVER ({over}) AS opn FROM {name}_s
), {name} AS (
  SELECT * EXCLUDE (given), CASE WHEN short THEN cap ELSE ((given - spent) * w) // greatest(opn, 1) END AS share FROM {name}_t
)"""


OP4_SQL = f"""
WITH ledger AS (
  SELECT * FROM (
    SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           CASE WHEN n < 5 THEN 'web' WHEN n < 10 THEN 'books' WHEN n < 15 THEN 'news' WHEN n >= 15 THEN 'code' ELSE 'other' END AS domain,
           CAST(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) AS BIGINT) AS n_tokens
    FROM (SELECT *, TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) AS n FROM documents)
  ) WHERE n_tokens > 0
), leaves AS (
  SELECT domain, lang, source, sum(n_tokens) AS have, sum(n_tokens) * {EPOCHS} AS cap FROM ledger GROUP BY ALL
), root AS (
  SELECT least(sum(have) * {BUDGET_PERCENT} // 100, sum(cap)) AS given FROM leaves
), {_fill_sql("f1", "SELECT domain, sum(cap) AS cap, CASE domain WHEN 'web' THEN 4 WHEN 'books' THEN 3 WHEN 'news' THEN 2 ELSE 1 END AS w, domain AS node, any_value(given) AS given FROM leaves, root GROUP BY domain", "")},
{_fill_sql("f2", "SELECT l.domain, l.lang, sum(l.cap) AS cap, CASE l.lang WHEN 'en' THEN 6 WHEN 'fr' THEN 2 WHEN 'de' THEN 2 WHEN 'es' THEN 2 ELSE 1 END AS w, l.lang AS node, any_value(f1.share) AS given FROM leaves l JOIN f1 USING (domain) GROUP BY l.domain, l.lang", "domain")},
{_fill_sql("f3", "SELECT l.domain, l.lang, l.source, l.have, l.cap, 1 AS w, l.source AS node, f2.share AS given FROM leaves l JOIN f2 ON l.domain = f2.domain AND l.lang = f2.lang", "domain, lang")},
shares AS (
  SELECT domain, lang, source, CAST(share // have AS BIGINT) AS whole, share % have AS rest FROM f3
), drawn AS (
  SELECT l.*, whole, rest, md5('{SEED}:' || whole || ':' || doc_id) AS draw FROM ledger l JOIN shares USING (domain, lang, source)
), upto AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY draw) AS upto FROM drawn
), copies AS (
  SELECT *, whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS n FROM upto
)
SELECT doc_id, domain, lang, source, n_tokens, CAST(unnest(range(n)) AS INTEGER) AS epoch FROM copies WHERE n > 0
"""
