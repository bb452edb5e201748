"""Mixing sources to target weights by whole copies and Pareto order sampling.

A source's target of words is met by floor(target / size) copies of every document and, for
the rest, a sample without replacement: each document has a ranking number, the odds of a
random number over its inclusion odds, and the documents of least number are taken until the
rest is filled.  Inclusion odds are unequal: they grow with the square root of a document's
words (long_odds), so that long documents, which hold more context, have the better chance.
Ranking by random odds over inclusion odds needs the latter up to a factor only, which the
place where the rest runs out settles.  Ranking numbers come from the md5 of the id, so reruns
agree.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_of, unit_from_md5

WORD = r"[^\x20\x09-\x0D]+"


def long_odds(size: Column) -> Column:
    """Inclusion odds of a document of so many words, up to a factor."""
    return F.sqrt((size.cast("double") + 1) / 256)


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Words that each source should give: (source, source_size) -> source, source_size, target.

    Sources in code point order, null last, weigh `weights` in turn and split `share` of all
    words by weight; none gets more than `cap` times its size, and what is above is split
    among the others likewise.  That is target = min(cap * size, level * weight) for the one
    level that spends the whole budget; with sources sorted by cap * size / weight, those up
    to some place are capped, and the level follows from running sums.  One row a source.
    """
    if cap < share:
        raise ValueError("the cap is under the share: the budget could not be spent")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    by = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy()
    return (
        sizes.withColumn("w", w)
        .withColumn("full_at", F.lit(float(cap)) * F.col("source_size") / F.col("w"))
        .withColumn("capped", F.coalesce(F.sum("source_size").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("w_left", F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.lit(float(share)) * F.sum("source_size").over(all_rows) - F.lit(float(cap)) * F.col("capped")) / F.col("w_left"))
        # the first row whose level is within its own cap gives the level for it and all after
        .withColumn("open", F.col("level") <= F.col("full_at"))
        .withColumn("level", F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .select("source", "source_size", F.least(F.lit(float(cap)) * F.col("source_size"), F.coalesce(F.col("level") * F.col("w"), F.lit(float(cap)) * F.col("source_size"))).alias("target"))
    )


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    odds: Callable[[Column], Column] = long_odds,
    row_col: str | None = None,
    seed: int = 9,
) -> DataFrame:
    """Copies of each document in the mix: doc_id, source, size, source_size, target, copies, taken.

    `odds` gives a document's inclusion odds within its source by its words, as a positive
    number.  The order within a source is cut into ranges of the ranking number, so many that a
    source of all rows has some 65,000 rows in each; only the range where the rest runs out is
    put in order row by row.  With row_col, that column of docs is returned too.

    The words taken from a source miss its target by half of one document at most.  A document
    is taken floor(target/size) times or once more.  Nulls: a null text has no words; null is a
    source; rows without an id are told apart by their texts.  Rows that repeat an id count each
    and share a random number; ties are in order of id and size.  A very long text counts whole.
    A source without words has target 0 and no copies.  Of an empty table the result is empty.
    Other columns are not looked at, whatever their names.
    """
    u = unit_from_md5(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), F.md5(text_of(text_col)))))
    base = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size"),
            u.alias("u"),
            *([] if row_col is None else [F.col(row_col).alias("row")]),
        ),
        "mix",
    )
    buckets = max(1024, base.count() >> 16)
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(sizes, weights, share, cap).withColumns(
        {
            "whole": F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0),
            "rest": F.when(F.col("source_size") > 0, F.col("target") - F.floor(F.col("target") / F.col("source_size")) * F.col("source_size")).otherwise(0.0),
        }
    )
    plan = materialize(plan, "plan")
    rows = (
        base.join(plan.withColumnRenamed("source", "plan_source"), F.col("source").eqNullSafe(F.col("plan_source")))
        .drop("plan_source")
        # the ranking number, and its range as a number in (0, 1)
        .withColumn("z", (F.col("u") / (1 - F.col("u"))) / odds(F.col("size")))
        .withColumn("bucket", F.least(F.lit(buckets - 1), F.floor(F.col("z") / (1 + F.col("z")) * buckets)).cast("int"))
    )
    by = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sums = (
        rows.filter("rest > 0")
        .groupBy(F.col("source").alias("s"), F.col("bucket").alias("b"))
        .agg(F.sum("size").alias("in_bucket"), F.first("rest").alias("r"))
        .withColumn("before", F.coalesce(F.sum("in_bucket").over(by), F.lit(0)))
        .select("s", "b", "before", F.when(F.col("before") >= F.col("r"), "none").when(F.col("before") + F.col("in_bucket") <= F.col("r"), "all").otherwise("some").alias("part"))
    )
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")), "left").drop("s", "b")
    running = F.sum("size").over(Window.partitionBy("source").orderBy("z", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    some = rows.filter("part = 'some'").withColumn("more", (F.col("before") + running - F.col("size") / 2 <= F.col("rest")).cast("int"))
    others = rows.filter("part is null or part <> 'some'").withColumn("more", F.coalesce((F.col("part") == "all").cast("int"), F.lit(0)))
    return some.unionByName(others).select(
        *([] if row_col is None else ["row"]),
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("whole") + F.col("more")).cast("long").alias("copies"),
        ((F.col("whole") + F.col("more")) * F.col("size")).cast("long").alias("taken"),
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of docs as often as mix(docs, **options) takes it, with the columns of docs.

    Rows are numbered first, so rows that repeat an id, or have none, are each taken as often as
    the mix says of them.
    """
    name = "_mix"
    while any(c.startswith(name) for c in docs.columns):
        name += "_"
    rows = materialize(docs.withColumn(f"{name}row", F.monotonically_increasing_id()), "rows")
    n = mix(rows, row_col=f"{name}row", **options).filter("copies > 0").select(F.col("row").alias(f"{name}of"), F.col("copies").cast("int").alias(f"{name}n"))
    out = rows.join(n, F.col(f"{name}row") == F.col(f"{name}of"))
    return out.withColumn(f"{name}copy", F.explode(F.sequence(F.lit(1), F.col(f"{name}n")))).select(*docs.columns)


#: op9 over documents, for DuckDB.
ORACLE = r"""
WITH base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5('9:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM sizes),
f AS (SELECT *, 2.0::DOUBLE * source_size / w AS full_at FROM w),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
        - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY full_at, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER (ORDER BY full_at, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
lv AS (SELECT arg_min(level, struct_pack(a := full_at, b := source IS NULL, c := coalesce(source, ''))) AS level FROM l WHERE level <= full_at),
plan AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, coalesce(lv.level * w, 2.0::DOUBLE * source_size)) AS target FROM l, lv),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
        CASE WHEN source_size > 0 THEN target - floor(target / source_size) * source_size ELSE 0 END AS rest FROM plan),
r AS (SELECT b.*, p.source_size, p.target, p.whole, p.rest,
        sum(b.size) OVER (PARTITION BY b.source ORDER BY (b.u / (1 - b.u)) / sqrt((b.size::DOUBLE + 1) / 256), b.doc_id NULLS FIRST, b.size ROWS UNBOUNDED PRECEDING) AS running
      FROM base b JOIN p ON b.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       ((whole + CASE WHEN rest > 0 AND running - size / 2.0 <= rest THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM r
"""
