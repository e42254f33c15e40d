"""The key constraints the reference declares (three primary keys, two foreign
keys), which Spark does not enforce, as a violations table.

Every key occurrence is stacked as (domain, key, role): a primary key is a ``parent``
occurrence of its table's domain, a foreign key a ``child`` occurrence of the domain
it references. One scan per table, one aggregation per (domain, key) counting parents
and children (partial aggregation first, so a hot key - a business with a third of
all reviews - is one row per map task), then one global aggregate gives every rule:
surplus rows per duplicated key, NULL keys, and child rows whose key has no parent.
No joins. NULL foreign keys are allowed, as in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustlens.schemas import Feedback

# The declared keys. Domain = the table whose primary key it is.
PRIMARY_KEYS = ("businesses", "reviews", "responses")
FOREIGN_KEYS = (
    # (child table, column, referenced table)
    ("reviews", "business_id", "businesses"),
    ("responses", "review_id", "reviews"),
)


def _code(table: str) -> F.Column:
    """Domains travel through the shuffle as a one-byte code, not as text."""
    return F.lit(PRIMARY_KEYS.index(table)).cast("tinyint")


def _occurrences(df: DataFrame, table: str) -> DataFrame:
    """(domain, k, parent) for the table's primary key and each of its foreign keys."""
    entries = [F.struct(_code(table).alias("domain"), F.col("id").alias("k"), F.lit(True).alias("parent"))]
    for child, column, parent in FOREIGN_KEYS:
        if child == table:
            entries.append(
                F.struct(_code(parent).alias("domain"), F.col(column).alias("k"), F.lit(False).alias("parent"))
            )
    return df.select(F.inline(F.array(*entries)))


def key_checks(fb: Feedback) -> DataFrame:
    """Rows (table_name, rule, violations) for every declared key, zero when clean."""
    occ = (
        _occurrences(fb.businesses, "businesses")
        .unionByName(_occurrences(fb.reviews, "reviews"))
        .unionByName(_occurrences(fb.responses, "responses"))
    )
    per_key = occ.groupBy("domain", "k").agg(
        F.count_if(F.col("parent")).alias("parents"),
        F.count_if(~F.col("parent")).alias("children"),
    )
    key, parents, children = F.col("k"), F.col("parents"), F.col("children")
    zero = F.lit(0).cast("bigint")

    def total(domain: str, value: F.Column) -> F.Column:
        return F.coalesce(F.sum(F.when(F.col("domain") == _code(domain), value)), zero)

    sums, rules = [], []
    for table in PRIMARY_KEYS:
        sums.append(total(table, F.when(key.isNotNull() & (parents > 1), parents - 1)).alias(f"{table}_dup"))
        sums.append(total(table, F.when(key.isNull(), parents)).alias(f"{table}_nul"))
        rules.append((table, "primary key unique", f"{table}_dup"))
        rules.append((table, "primary key not null", f"{table}_nul"))
    for child, column, parent in FOREIGN_KEYS:
        sums.append(total(parent, F.when(key.isNotNull() & (parents == 0), children)).alias(f"{child}_orphans"))
        rules.append((child, f"{column} references {parent}", f"{child}_orphans"))
    totals = per_key.agg(*sums)
    rows = [
        F.struct(F.lit(t).alias("table_name"), F.lit(r).alias("rule"), F.col(c).cast("bigint").alias("violations"))
        for t, r, c in rules
    ]
    return totals.select(F.inline(F.array(*rows)))
