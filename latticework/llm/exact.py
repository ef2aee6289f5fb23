"""Operator 7, exact dedup by distributed most-significant-digit radix partitioning.

Documents are split by successive runs of bytes. A round first counts (group, next digit) with partial sums
on the map side, so that a digit which very many documents share is one row a task, and then joins the
counts: only rows of a digit that several documents have carry the rest of their text on, named by their group's
smallest row. Digits widen as groups shrink, from one that moves no text at all; a group of one is dropped and a
group whose texts end inside the digit is a set of equal documents. Equality is always that of the bytes
themselves, never of a digest. No window holds texts, and adaptive execution may cut a digit of many rows.

The plan is one at any size. Before text moves, a bitmap of BUCKETS bits, which has the buckets of all repeated
first digits, lets most single documents go; a bucket that digits share only lets more through, to be counted
by their bytes in the rounds after it. The rounds always shuffle.

Defined results: null texts equal nothing and are kept; empty texts equal one another; the smallest
doc_id of a group stays; rows that repeat a doc_id with the same text are one document; a null doc_id
is never reported and its row is kept; a doc_id with several texts has a row a text that is a copy, and
loses only the rows of that text; an empty table gives no pairs; other columns don't matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import Table, settled, small

FIRST_DIGIT, WIDEN = 64, 4
#: Bits of the bitmap: a word of 64 a row, so that it can be broadcast at any size of the input.
BUCKETS = 1 << 23

#: DuckDB SQL for exact_duplicates over {docs}.
SQL = """
select doc_id, keep_id, copies from (
  select doc_id, min(doc_id) over (partition by text) as keep_id, count(*) over (partition by text) as copies
  from (select distinct doc_id, text from {docs} where text is not null and doc_id is not null))
where doc_id <> keep_id
"""


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, copies) for every document that equals one of smaller doc_id."""
    return _copies(docs).select("doc_id", "keep_id", "copies")


def _text_hash(text):
    return F.xxhash64(text.cast("binary"))


def _bucket(digit: Column) -> Column:
    return F.pmod(F.xxhash64(digit), F.lit(BUCKETS))


def _bit(bucket: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bucket, F.lit(64)).cast("int"))


def _repeated(base: DataFrame, digit: Column) -> DataFrame:
    """(word, bits) of the buckets of digits that several documents have: BUCKETS / 64 rows at most."""
    several = base.select("doc_id", digit.alias("digit")).groupBy("digit").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low <> high")
    bucket = several.select(_bucket(F.col("digit")).alias("bucket"))
    return bucket.groupBy(F.floor(F.col("bucket") / 64).alias("word")).agg(F.bit_or(_bit(F.col("bucket"))).alias("bits"))


def _copies(docs: DataFrame) -> DataFrame:
    """exact_duplicates with hash, that of the text by which a doc_id's rows are told apart."""
    base = docs.select("doc_id", _text_hash(F.col("text")).alias("hash"), F.col("text").cast("binary").alias("rest")).where("doc_id is not null and rest is not null")
    several = [F.min("doc_id").alias("low"), F.max("doc_id").alias("high")]
    digit = F.expr(f"substring(rest, 1, {FIRST_DIGIT})")
    repeated = Table(_repeated(base, digit))
    kept = base.withColumn("bucket", _bucket(digit)).join(F.broadcast(repeated.df), F.floor(F.col("bucket") / 64) == F.col("word")).where(F.col("bits").bitwiseAND(_bit(F.col("bucket"))) != 0)
    last = Table(kept.drop("bucket", "word", "bits").withColumns({"row": F.monotonically_increasing_id(), "grp": F.lit(0).cast("long")}))
    repeated.drop()
    width, found = FIRST_DIGIT * WIDEN, []
    while True:
        keyed = last.df.withColumn("digit", F.expr(f"substring(rest, 1, {width})"))
        # the group's smallest row names it: groups have no row in common, though a doc_id may be in several
        groups = Table(keyed.select("doc_id", "row", "grp", "digit").groupBy("grp", "digit").agg(*several, F.min("row").alias("name")).where("low <> high").select(F.col("grp").alias("grp_"), F.col("digit").alias("digit_"), "low", "name"))
        same = (F.col("grp") == F.col("grp_")) & (F.col("digit") == F.col("digit_"))
        ended = F.length("digit") < width
        split = Table(keyed.hint("merge").join(groups.df, same).select("doc_id", "hash", "row", "low", F.col("name").alias("grp"), ended.alias("ended"), F.when(~ended, F.expr(f"substring(rest, {width + 1})")).alias("rest")))
        last.drop()
        groups.drop()
        ended_pairs = Table(split.df.where("ended").select("doc_id", "hash", F.col("low").alias("keep_id"), "grp").distinct())
        found.append(ended_pairs)
        last = Table(split.df.where("not ended").select("doc_id", "hash", "row", "grp", "rest"))
        split.drop()
        if last.df.isEmpty():
            last.drop()
            break
        width *= WIDEN
    pairs = reduce(DataFrame.unionAll, (t.df for t in found))
    copies = pairs.groupBy("grp").agg(F.count("*").alias("copies"))
    return settled(pairs.where("doc_id <> keep_id").join(copies, "grp").select("doc_id", "hash", "keep_id", "copies"), *found)


def drop_exact(docs: DataFrame) -> DataFrame:
    """docs without the later copies; columns unchanged."""
    gone = Table(_copies(docs).select("doc_id", "hash").distinct()).df
    gone = small(gone, gone.count())
    return docs.join(gone, (docs["doc_id"] == gone["doc_id"]) & (_text_hash(docs["text"]) == gone["hash"]), "left_anti")


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs whose doc_id isn't in the written table gone (doc_id); null ids stay."""
    gone = small(gone, gone.count())
    return docs.join(gone, docs["doc_id"] == gone["doc_id"], "left_anti")
