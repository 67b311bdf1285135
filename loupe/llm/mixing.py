"""Mixing sources to target weights by hierarchical budgeting, in DataFrame expressions only.

The corpus is a tree: domain, language, source. A token budget flows from the root: children get
shares in proportion to their target weights, and what a child cannot use (its subtree's
supply times ``max_epochs``) is shared among its siblings in proportion to their weights.
Because a parent's own limit is what its subtree can use, a shortage reaches other
branches only after all siblings are full. A leaf with budget ``b`` and supply ``s`` takes
``floor(b / s)`` whole epochs of its documents and, of the next epoch in its seeded order,
the longest prefix of documents whose tokens fit into the rest.

Tokens are words (runs outside ``[\\x20\\x09-\\x0D]``). The seeded order of an epoch is the md5
of seed, epoch, doc_id, the text's md5 and the row's number among the rows of its leaf that share both, so
equal ids, null ones and repeated rows are spread like others and the prefix can end among them. The prefix
is found without ordering a leaf in one task: hashes are cut into 4,096 slices whose
totals are added up, and only the slice in which the budget ends is ordered row by row.

Null domains, languages and sources are values of their own (shown as null in the rows).
Null texts have no tokens; a leaf without tokens gets no budget and gives no rows. Nodes
without a given weight get ``other``. Repeated rows are documents like others. An empty
table or a budget of zero gives an empty result. Further columns are ignored by ``mix_plan``
and kept by ``mix_documents``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loupe.functions.ranks import row_ranks
from loupe.llm.store import repeated_keys, written

LEAF = ["domain", "lang", "source"]
#: Stands for null in keys; no text can hold it by accident of data entry.
NULL = "\u0000null"
SLICE_DIGITS = 3


@dataclass(frozen=True)
class MixParams:
    """Weights by value for each level; ``other`` for values not named; ``budget_share`` of all tokens is the budget unless ``budget`` is given."""
    domains: dict[str, float] = field(default_factory=dict)
    languages: dict[str, float] = field(default_factory=dict)
    sources: dict[str, float] = field(default_factory=dict)
    other: float = 1.0
    budget_share: float = 1.0
    budget: int | None = None
    max_epochs: int = 4
    seed: int = 1


def n_tokens(text: str = "text") -> Column:
    words = F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), "[\\x20\\x09-\\x0D]+"), "")
    return F.size(words).cast("bigint")


def _weight(name: str, weights: dict[str, float], other: float) -> Column:
    if not weights:
        return F.lit(float(other))
    pairs = F.create_map(*[F.lit(x) for k, w in weights.items() for x in (k, float(w))])
    return F.coalesce(F.try_element_at(pairs, F.col(name)), F.lit(float(other)))


def fill(nodes: DataFrame, parent: list[str], node: str) -> DataFrame:
    """Share each parent's ``budget`` among its nodes (weight, limit): adds ``share``.

    Nodes are ordered by limit per weight. A node is full if the level at which it fills
    costs, over all nodes, no more than the budget; the others split the rest by weight.
    """
    ratio = F.col("limit") / F.col("weight")
    w = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    up = w.orderBy("ratio", node).rowsBetween(Window.unboundedPreceding, -1)
    on = w.orderBy("ratio", node).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = nodes.filter("weight > 0").withColumn("ratio", ratio)
    level = F.coalesce(F.sum("limit").over(up), F.lit(0.0)) + F.col("ratio") * F.sum("weight").over(on)
    ranked = ranked.withColumn("full", level <= F.col("budget"))
    rest = F.col("budget") - F.sum(F.when(F.col("full"), F.col("limit")).otherwise(0.0)).over(w)
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0.0)).over(w)
    ranked = ranked.withColumn("rest", rest).withColumn("open", open_weight)
    return ranked.withColumn("share", F.when(F.col("full"), F.col("limit")).otherwise(F.col("rest") * F.col("weight") / F.col("open"))).drop("ratio", "full", "rest", "open")


def leaf_budgets(supply: DataFrame, params: MixParams) -> DataFrame:
    """(domain, lang, source, supply, budget) from the leaves' (domain, lang, source, supply); keys are never null."""
    leaves = supply.filter("supply > 0").withColumn("limit", F.col("supply").cast("double") * params.max_epochs)
    languages = leaves.groupBy("domain", "lang").agg(F.sum("limit").alias("limit"), F.sum("supply").alias("supply"))
    domains = languages.groupBy("domain").agg(F.sum("limit").alias("limit"), F.sum("supply").alias("supply"))
    domains = domains.withColumn("weight", _weight("domain", params.domains, params.other))
    total = F.sum("supply").over(Window.partitionBy(F.lit(0))).cast("double") * float(params.budget_share)
    domains = domains.withColumn("budget", total if params.budget is None else F.lit(float(params.budget)))
    domains = fill(domains, [], "domain").select("domain", F.col("share").alias("budget"))
    languages = languages.drop("supply").withColumn("weight", _weight("lang", params.languages, params.other)).join(domains, "domain")
    languages = fill(languages, ["domain"], "lang").select("domain", "lang", F.col("share").alias("budget"))
    leaves = leaves.withColumn("weight", _weight("source", params.sources, params.other)).join(languages, ["domain", "lang"])
    shared = fill(leaves, ["domain", "lang"], "source")
    return shared.select(*LEAF, "supply", F.floor(F.col("share") + 1e-6).alias("budget"))


#: What tells rows of a leaf apart, besides their number.
IDENTITY = ["id", "digest"]


def _identity() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("digest")]


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (leaf keys, id, digest) with ``copy``: 0, 1, .. among rows that share them all.

    Only such rows are ranked, over slices, so that a third of a leaf may repeat one row.
    """
    keys = [*LEAF, *IDENTITY]
    again = repeated_keys(rows, keys)
    if again is None:
        return rows.withColumn("copy", F.lit(0).cast("bigint"))
    once = rows.join(again, keys, "left_anti").withColumn("copy", F.lit(0).cast("bigint"))
    more = row_ranks(rows.join(again, keys, "left_semi").select(*rows.columns), keys, []).drop("_total").withColumnRenamed("_rank", "copy")
    return once.select(*rows.columns, "copy").unionByName(more.withColumn("copy", F.col("copy").cast("bigint")))


def _order(seed: int, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), "id", "digest", F.col("copy").cast("string")))


def _keys(domain: Column) -> list[Column]:
    return [F.coalesce(domain.cast("string"), F.lit(NULL)).alias("domain"),
            F.coalesce(F.col("lang").cast("string"), F.lit(NULL)).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit(NULL)).alias("source")]


def mix_plan(docs: DataFrame, domain: Column, params: MixParams) -> tuple[DataFrame, DataFrame]:
    """The narrow documents (doc_id, domain, lang, source, id, digest, copy, n_tokens) and one row a leaf: supply, budget, whole ``epochs`` and ``last``, the greatest hash of the partial epoch that is taken."""
    narrow = written(docs.select("doc_id", *_keys(domain), *_identity(), n_tokens().alias("n_tokens")), "mix-documents")
    narrow = written(numbered(narrow), "mix-rows")
    supply = narrow.groupBy(*LEAF).agg(F.sum("n_tokens").alias("supply"))
    leaves = leaf_budgets(written(supply, "mix-supply"), params)
    leaves = leaves.withColumn("epochs", F.floor(F.col("budget") / F.col("supply")).cast("bigint"))
    leaves = written(leaves.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("supply")), "mix-leaves")
    hashed = narrow.join(leaves.select(*LEAF, "epochs", "rest"), LEAF).withColumn("h", _order(params.seed, F.col("epochs")))
    hashed = hashed.withColumn("slice", F.substring("h", 1, SLICE_DIGITS))
    slices = hashed.groupBy(*LEAF, "slice").agg(F.sum("n_tokens").alias("n"), F.min("rest").alias("rest"))
    total = F.sum("n").over(Window.partitionBy(*LEAF).orderBy("slice"))
    slices = written(slices.withColumn("total", total).withColumn("before", F.col("total") - F.col("n")).filter("before <= rest"), "mix-slices")
    ends = slices.filter("total > rest").select(*LEAF, "slice", "before")
    inside = F.sum("n_tokens").over(Window.partitionBy(*LEAF).orderBy("h").rangeBetween(Window.unboundedPreceding, 0))
    rows = hashed.join(ends, [*LEAF, "slice"]).withColumn("total", F.col("before") + inside).filter("total <= rest")
    whole = slices.filter("total <= rest").groupBy(*LEAF).agg(F.concat(F.max("slice"), F.lit("g")).alias("last"))  # 'g' follows every hex digit
    last = whole.unionByName(rows.groupBy(*LEAF).agg(F.max("h").alias("last"))).groupBy(*LEAF).agg(F.max("last").alias("last"))
    plan = leaves.join(last, LEAF, "left").select(*LEAF, "supply", "budget", "epochs", F.coalesce("last", F.lit("")).alias("last"))
    return narrow, written(plan, "mix-plan")


def _copies(rows: DataFrame, plan: DataFrame, params: MixParams) -> DataFrame:
    """Rows once for each epoch that takes them (column ``epoch``); ``rows`` hold the leaf's keys, id, digest and copy."""
    both = rows.join(plan.select(*LEAF, "epochs", "last"), LEAF)
    taken = F.col("epochs") + F.when(_order(params.seed, F.col("epochs")) <= F.col("last"), 1).otherwise(0)
    both = both.withColumn("taken", taken.cast("int")).filter("taken > 0")
    return both.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("taken") - 1))).drop("epochs", "last", "taken")


def mix(docs: DataFrame, domain: Column, params: MixParams) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, epoch) of every document and epoch taken."""
    narrow, plan = mix_plan(docs, domain, params)
    shown = [F.when(F.col(c) != NULL, F.col(c)).alias(c) for c in LEAF]
    return _copies(narrow, plan, params).select("doc_id", *shown, "n_tokens", "epoch")


def mix_documents(docs: DataFrame, domain: Column, params: MixParams) -> DataFrame:
    """``docs`` with all their columns, each row once for every epoch that takes it."""
    _, plan = mix_plan(docs, domain, params)
    keyed = docs.select(*_keys(domain), *_identity(), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return _copies(numbered(keyed), plan, params).select("_row.*")
