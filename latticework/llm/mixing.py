"""Operator 8, mixing sources to target weights by hash-threshold histograms.

Every document has a fixed hash of 60 bits. Tokens are summed by source and leading hash bits; the
bucket in which a source's running sum passes its budget is the only one that is looked at again,
by its next 12 bits, until the boundary is one hash. A document stays if its hash is below its
source's boundary: no sort, no row numbers, and each budget's sample contains that of any smaller one.

Defined results: a null source is a source of its own; a null or empty text counts 0 tokens; rows
of one doc_id have one hash and stay or go together, as do any that share a hash at the boundary
(which then go); a null doc_id hashes like an empty string; an empty table gives an empty table;
extra columns pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.llm.common import Table, small

HASH_BITS, LEVEL_BITS = 60, 12
ALPHA, KEEP = 0.7, 0.8

#: DuckDB SQL for the documents kept with the default parameters; {docs} is a table.
SQL = """
with slim as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')), 0) as n,
         cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) as h
  from {docs}),
totals as (select source, sum(n) as t, pow(sum(n)::double, 0.7::double) as w from slim group by source),
budgets as (select source, floor(0.8::double * (select sum(t) from totals)::double * w / (select sum(w) from totals)) as budget from totals),
run as (select doc_id, source, n, sum(n) over (partition by source order by h range unbounded preceding) as upto from slim)
select r.doc_id, r.source, r.n as n_tokens
from run r join budgets b on r.source is not distinct from b.source
where r.upto <= b.budget
"""


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^ \t\n\r]+")), F.lit(0)).cast("long")


def doc_hash(doc_id: Column) -> Column:
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def thresholds(slim: DataFrame, weights: dict[str, float] | None, alpha: float, keep: float) -> DataFrame:
    """Per source the first hash that no longer fits; slim has source, h and n."""
    totals = slim.groupBy("source").agg(F.sum("n").cast("double").alias("t"))
    if weights is None:
        totals = totals.withColumn("w", F.pow("t", F.lit(alpha)))
    else:
        pairs = [F.lit(x) for k, v in weights.items() for x in (k, float(v))]
        totals = totals.withColumn("w", F.coalesce(F.create_map(*pairs)[F.col("source")], F.lit(0.0)) if pairs else F.lit(0.0))
    sums = totals.agg(F.sum("t").alias("all_t"), F.sum("w").alias("all_w"))  # one row
    share = F.when(F.col("all_w") > 0, F.floor(F.lit(keep) * F.col("all_t") * F.col("w") / F.col("all_w"))).otherwise(0)
    edge = totals.crossJoin(F.broadcast(sums)).select(F.col("source").alias("s"), share.cast("long").alias("left"), F.lit(0).cast("long").alias("edge"), F.lit(True).alias("open"))
    count = None
    for level in range(HASH_BITS // LEVEL_BITS):
        shift = HASH_BITS - LEVEL_BITS * (level + 1)
        rows = slim.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("n").alias("n")) if level == 0 else (
            slim.join(small(edge.where("open").select("s", F.col("edge").alias("at")), count), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", shift + LEVEL_BITS) == F.col("at")))
            .groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("n").alias("n"))
        )
        upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("upto", F.sum("n").over(upto)).withColumnRenamed("source", "source_")
        step = rows.join(edge, F.col("source_").eqNullSafe(F.col("s")) & F.col("open"))
        over = F.col("upto") > F.col("left")
        step = step.groupBy("s").agg(F.min(F.when(over, F.struct("bucket", (F.col("left") - F.col("upto") + F.col("n")).alias("left")))).alias("hit"))
        # a source that fits whole has no boundary and is left open at the top
        edge = edge.alias("e").join(step.withColumnRenamed("s", "s_"), F.col("s").eqNullSafe(F.col("s_")), "left").select(
            "s", F.coalesce(F.col("hit.left"), F.col("e.left")).alias("left"), F.coalesce(F.col("hit.bucket"), F.lit(1).cast("long") * (1 << (LEVEL_BITS * (level + 1)))).alias("edge"), (F.col("open") & F.col("hit").isNotNull()).alias("open")
        )
        edge = Table(edge).df  # a row a source; the next level reads it twice
        count = edge.count()
    return edge.select(F.col("s").alias("source_"), F.col("edge").alias("threshold"))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, keep: float = KEEP) -> DataFrame:
    """Documents kept so that sources come near their target shares of keep * all tokens.

    weights: target weight by source, 0 for any that it doesn't name; None weights each source by
    its tokens to the power alpha. A source never gives more than it has. Columns are those of docs.
    """
    slim = Table(docs.select("source", doc_hash(F.col("doc_id")).alias("h"), token_count(F.col("text")).alias("n")))
    limits = Table(thresholds(slim.df, weights, alpha, keep)).df
    slim.drop()
    limits = small(limits, limits.count())
    below = doc_hash(docs["doc_id"]) < limits["threshold"]
    return docs.join(limits, docs["source"].eqNullSafe(limits["source_"]) & below, "left_semi")
