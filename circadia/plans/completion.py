"""How completely is a title read? One column per bucket of the book."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.grid import BitSets, expand_repeats, pivot_presence, within_names
from ..operators.ranking import flag_gaps
from ..session import spread

IDS = ["title", "isbn13", "customer_key"]
BUCKETS = range(1, 101)


def bucket_reads(
    fact: DataFrame,
    buckets: DataFrame,
    products: DataFrame,
    after: int | None = None,
    product_type: str | None = "E-bøger",
    premium_only: bool = True,
) -> DataFrame:
    """Reads of known premium customers: customer, title, isbn and bucket number, with a count.

    Reads are counted per customer, product and bucket before the joins, so a bestseller is one
    row per reader and bucket there, not one per event.
    """
    reads = fact.where(F.col("customer_key") > 0)
    if after is not None:
        reads = reads.where(F.col("date_key") > after)
    if premium_only:
        reads = reads.where(F.col("premium_key") == 1)
    if product_type is not None:
        products = products.where(F.col("type") == product_type)
    own = ["customer_key", "product_key", "read_bucket_key"]
    # few bytes a row, most rows of their own: merged into tasks by bytes, they would fill a task's memory
    counted = spread(reads.select(*own), *own).groupBy(*own).agg(F.count("*").alias("n"))
    return (
        counted.join(buckets.select("read_bucket_key", "bucket_no"), "read_bucket_key")
        .join(products.select("product_key", "title", "isbn13"), "product_key")
        .select("customer_key", "title", "isbn13", "bucket_no", "n")
    )


def _positions(reads: DataFrame) -> DataFrame:
    """One row per title, reader and bucket with the number of reads; a reader's rows of a title lie together."""
    return spread(reads, "title", "customer_key").groupBy(*IDS, "bucket_no").agg(F.sum("n").alias("n"))


def bucket_matrix(reads: DataFrame, buckets: Sequence[int] = BUCKETS) -> DataFrame:
    """1 where a reader has touched a bucket of a title, else 0."""
    return pivot_presence(reads, IDS, "bucket_no", buckets)


def gap_flags(reads: DataFrame) -> DataFrame:
    """Does a bucket follow the one read before it?

    The order is per customer and title, also when a title has several isbn. ``gap`` is the flag
    of the first read of a bucket; reading it again is a gap every time.
    """
    flagged = flag_gaps(_positions(reads), ["customer_key", "title"], "bucket_no")
    first_isbn = F.min("isbn13").over(Window.partitionBy("customer_key", "title", "bucket_no"))
    gap = F.when(F.col("isbn13").eqNullSafe(first_isbn), F.col("gap")).otherwise("gap")
    return flagged.select(*IDS, "bucket_no", gap.alias("gap"), "n")


def bucket_gaps(reads: DataFrame, buckets: Sequence[int] = BUCKETS) -> DataFrame:
    """The matrix with 'gap', '1' or null (not read, or first bucket read) in each cell; see ``gap_flags``.

    Buckets are bit sets per title, isbn and reader. One window per reader and title sees a row per isbn and
    gives the buckets of all of them and of those before; flags follow when the columns are laid out.
    """
    sets, title = BitSets(buckets), ["customer_key", "title"]
    known = within_names(reads, "bucket_no", buckets)
    own = known.groupBy(*IDS).agg(*sets.gathered("bucket_no", "_own"), F.min("bucket_no").alias("_low"))
    everyone = Window.partitionBy(*title).orderBy(F.col("isbn13").asc_nulls_last())
    earlier = everyone.rowsBetween(Window.unboundedPreceding, -1)
    whole = everyone.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = own.withColumns({
        **{f"_all{w}": F.bit_or(f"_own{w}").over(whole) for w in sets.words},
        **{f"_before{w}": F.coalesce(F.bit_or(f"_own{w}").over(earlier), F.lit(0).cast("long")) for w in sets.words},
        "_first": F.min("_low").over(whole),
    })

    def cell(b: int) -> Column:
        follows = F.when(sets.has(b - 1, "_all"), "1").when(F.col("_first") != b, "gap")
        return F.when(sets.has(b, "_own"), F.when(sets.has(b, "_before"), "gap").otherwise(follows)).alias(str(b))

    return placed.select(*IDS, *[cell(b) for b in buckets])


def bucket_rows(reads: DataFrame, buckets: Sequence[int] = BUCKETS) -> DataFrame:
    """The presence matrix with one row per repeated read."""
    marked = _positions(reads).withColumns({"first": F.lit(1), "again": F.lit(1)})
    return expand_repeats(marked, IDS, "bucket_no", buckets, "first", "again", "n", fill=0)


def bucket_gap_rows(reads: DataFrame, buckets: Sequence[int] = BUCKETS) -> DataFrame:
    """The gap matrix with one row per repeated read."""
    marked = gap_flags(reads).withColumn("again", F.lit("gap"))
    return expand_repeats(marked, IDS, "bucket_no", buckets, "gap", "again", "n")
