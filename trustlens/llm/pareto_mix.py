"""Mixing sources to target weights by Pareto order sampling.

**Targets.** Sources are ranked by code point (null last) and weigh ``weights``, repeating. They
share ``share`` times all words by weight; a source stops at ``cap`` times its own words, and
the excess is shared anew by weight until none is above its cap (water filling, solved in
closed form over the sources sorted by the level at which each fills).

**Sample.** A source whose target is f times its words takes every document floor(f) times
whole. The rest of its target is a Pareto sample. A document's inclusion probability is p =
min(1, c / sqrt(size)), so that a few very long texts do not make up a source's remainder; c is solved
per source so that the expected words, the sum of p * size, are the rest (over the counts of its distinct
sizes). Every document draws u from a hash of its id and text, and documents are taken in ascending
order of random odds u / (1 - u) over inclusion odds p / (1 - p) until the rest's words are used up: the
sample is of fixed size in words. Documents with p = 1 are certain. What the cut leaves open, less than one
document, goes to the document among all those left that brings the sum nearest to the target.

**Scale.** No source is ever sorted whole. Ranks fall into ``BUCKETS`` fixed ranges of the
odds; word sums per (source, bucket) locate each source's boundary bucket, and only that bucket
is sorted. Reruns agree: u depends on the row and ``seed`` alone. DataFrame functions only.

**Cases.** Null and blank texts have size 0 and are never taken; a null source is a source of
its own. Rows equal in id and text share their draw and are chosen together. An empty table
gives an empty mix; a source without words has target 0. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustlens.llm.common import code_points_order, materialize, word_count
from trustlens.plans.sizing import broadcast_if_small

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
SEED = "mix-1"
BUCKETS = 4096
#: Square roots of sizes are held as whole numbers of this fraction, so that their sums are exact.
ROOT = 1024


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """source, source_size, n_docs, target from one row per source (source, source_size, n_docs)."""
    everything = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(code_points_order(F.col("source")))) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights)) + 1)
    out = sizes.withColumn("rank", rank).withColumn("weight", weight.cast("long"))
    out = out.withColumn("most", cap * F.col("source_size")).withColumn("fills_at", F.col("most") / F.col("weight"))
    below = Window.orderBy("fills_at", "rank").rowsBetween(Window.unboundedPreceding, -1)
    # the level per unit of weight if the sources that fill earlier are full and no other is
    out = out.withColumn("level", (
        share * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(below), F.lit(0))
    ) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(below), F.lit(0))))
    level = F.min(F.when(F.col("fills_at") >= F.col("level"), F.struct("fills_at", "rank", "level"))).over(everything)
    target = F.least(F.col("most").cast("double"), F.coalesce(level["level"] * F.col("weight"), F.col("most").cast("double")))
    return out.select("source", "source_size", "n_docs", target.alias("target"))


def draw(seed: str) -> Column:
    """A number in (0, 1) from the row's doc_id and text hash and the seed."""
    name = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_md5"))
    return (F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def root(size: Column) -> Column:
    return F.floor(ROOT * F.sqrt(size)).cast("long")


def expected_shares(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """plan_source, factor: a document's inclusion probability is min(1, factor * root(size) / size).

    Sizes are sorted by the factor at which their documents become certain; if those before are certain and
    the others are not, the factor is what the certain ones leave of the rest over the others' roots. The
    first size that this factor does not make certain is right."""
    counts = rows.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("root", root(F.col("size"))).withColumn("certain_at", F.col("size") / F.col("root"))
    whole = Window.partitionBy("source")
    before = whole.orderBy("certain_at", "size").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        "source", "size", "certain_at",
        F.coalesce(F.sum(F.col("n") * F.col("size")).over(before), F.lit(0)).alias("certain_words"),
        (F.sum(F.col("n") * F.col("root")).over(whole) - F.coalesce(F.sum(F.col("n") * F.col("root")).over(before), F.lit(0))).alias("roots"),
    )
    counts = counts.join(broadcast_if_small(plan.select("plan_source", "rest")), F.col("source").eqNullSafe(F.col("plan_source")))
    factor = (F.col("rest") - F.col("certain_words")) / F.col("roots")
    found = F.min(F.when(factor <= F.col("certain_at"), F.struct("certain_at", "size", factor.alias("factor"))))
    out = counts.groupBy("plan_source").agg(found.alias("found"), F.max("certain_at").alias("all_certain"))
    return out.select("plan_source", F.coalesce("found.factor", "all_certain").alias("factor"))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    cap: int = CAP,
    seed: str = SEED,
) -> DataFrame:
    """One row per document: doc_id, text_md5, source, size, source_size, target, copies, and share, the
    probability of the copy beyond the whole ones (null for documents without words)."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), F.md5(text.cast("binary")).alias("text_md5")
    )
    rows = materialize(rows.withColumn("u", draw(seed)))
    sizes = rows.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("n_docs")
    )
    plan = targets(materialize(sizes), weights, share, cap)
    fraction = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = plan.withColumn("whole", F.floor(fraction).cast("long"))
    rest = F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))
    plan = materialize(plan.withColumn("rest", rest).withColumnRenamed("source", "plan_source"))
    factors = materialize(expected_shares(rows, plan)).withColumnRenamed("plan_source", "factor_source")
    plan = plan.join(
        broadcast_if_small(factors), F.col("plan_source").eqNullSafe(F.col("factor_source")), "left"
    ).drop("factor_source")
    plan = materialize(plan)
    rows = rows.join(broadcast_if_small(plan), F.col("source").eqNullSafe(F.col("plan_source")))
    # random odds over inclusion odds; documents without words are never drawn
    share = F.least(F.lit(1.0), F.col("factor") * root(F.col("size")) / F.col("size"))
    rows = rows.withColumn("share", F.when(F.col("size") > 0, share))
    odds = F.when(F.col("share") > 0, F.col("u") / (1 - F.col("u")) * ((1 - F.col("share")) / F.col("share")))
    rows = rows.withColumn("odds", odds).withColumn(
        "bucket", F.floor(F.lit(float(BUCKETS)) * (F.col("odds") / (1 + F.col("odds"))))
    )
    order = ["odds", "doc_id", "text_md5"]
    drawn = rows.where("odds IS NOT NULL")
    sums = drawn.groupBy("source", "rest", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    edge = sums.where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest")))
    edge = materialize(edge.select(F.col("source").alias("cut_source"), F.col("bucket").alias("cut_bucket"), "before"))
    at_edge = [F.col("source").eqNullSafe(F.col("cut_source"))]
    inside = drawn.join(broadcast_if_small(edge), [*at_edge, F.col("bucket") == F.col("cut_bucket")])
    upto = Window.partitionBy("source").orderBy(*order)
    inside = inside.withColumn("upto", F.col("before") + F.sum("size").over(upto))
    last = inside.groupBy("source").agg(
        F.max(F.when(F.col("upto") <= F.col("rest"), F.struct(*order))).alias("last"),
        F.first("rest").alias("rest"),
        F.coalesce(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("upto"))), F.first("before")).alias("filled"),
    )
    cut = edge.join(
        last.select(
            F.col("source").alias("last_source"), "last", (F.col("rest") - F.col("filled")).alias("gap")
        ),
        F.col("cut_source").eqNullSafe(F.col("last_source")),
    ).select("cut_source", "cut_bucket", "last", "gap")
    cut = materialize(cut)
    rows = rows.join(broadcast_if_small(cut), at_edge, "left")
    # without an edge the whole source is within its rest (nothing is drawn for a rest of 0)
    taken = F.col("odds").isNotNull() & (
        F.col("cut_bucket").isNull()
        | (F.col("bucket") < F.col("cut_bucket"))
        | ((F.col("bucket") == F.col("cut_bucket")) & F.coalesce(F.struct(*order) <= F.col("last"), F.lit(False)))
    )
    rows = rows.withColumn("sampled", taken)
    miss = F.abs(F.col("gap") - F.col("size"))
    filler = (
        rows.where(~F.col("sampled") & (F.col("size") > 0) & (miss < F.col("gap")))
        .groupBy("source")
        .agg(F.min(F.struct(miss.alias("miss"), *order)).alias("f"))
        .select(F.col("source").alias("fill_source"), *(F.col(f"f.{c}").alias(f"fill_{c}") for c in order))
    )
    filler = broadcast_if_small(materialize(filler))
    same = [F.col(c).eqNullSafe(F.col(f"fill_{c}")) for c in ["source", *order]]
    rows = rows.join(filler, same, "left")
    filled = F.col("fill_odds").isNotNull()
    copies = F.when(F.col("size") > 0, F.col("whole") + (F.col("sampled") | filled).cast("long")).otherwise(0)
    return rows.select("doc_id", "text_md5", "source", "size", "source_size", "target", copies.alias("copies"), "share")


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents: every row as often as the mix takes it, with its own columns."""
    columns = docs.columns
    keys = ["doc_id", "text_md5"]
    chosen = mix(docs, **options).where("copies > 0").select(
        *(F.col(k).alias(f"mix_{k}") for k in keys), F.col("source").alias("mix_source"), "copies"
    ).dropDuplicates(["mix_doc_id", "mix_text_md5", "mix_source"])
    marked = docs.select(F.struct(*columns).alias("row"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("own_md5"))
    joined = marked.join(
        chosen,
        F.col("row.doc_id").eqNullSafe(F.col("mix_doc_id"))
        & (F.col("own_md5") == F.col("mix_text_md5"))
        & F.col("row.source").eqNullSafe(F.col("mix_source")),
    )
    repeated = joined.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return repeated.select("row.*")
