"""Seeded sampling and splitting, exact in size and independent of partitioning.

Every row gets a fixed pseudo-random position ``md5(id:seed)``.  A sample of n
rows is "the n smallest positions", so all that is needed is the position at
which to cut.  It is found without sorting the table: rows are counted per
bucket of the position (a small table), and only the rows of the bucket that
contains the cut are ranked.  The table itself is then filtered in place, with
no shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import constants as C
from quillspark.operators.joins import term_join
from quillspark.session import materialize

#: Hex digits of the position that make the bucket (16**4 buckets per class).
BUCKET_DIGITS = 4


def position(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))


def position_share(id_col: str, seed: int) -> Column:
    """The position as a number in [0, 1)."""
    return F.conv(F.substring(position(id_col, seed), 1, 8), 16, 10).cast("double") / F.lit(float(16**8))


def _stratum(label: Column) -> Column:
    """Join key of a class; NULL is a class of its own."""
    return F.coalesce(F.concat(F.lit("="), label.cast("string")), F.lit(""))


def _cut_points(df: DataFrame, stratum: Column, id_col: str, seed: int, cuts: dict[str, Column]) -> DataFrame:
    """One row per stratum: for each cut, the (position, id) of its last row, or NULL for none.

    ``cuts`` maps a name to the number of rows before the cut, in terms of ``n``, the stratum's size.
    """
    rows = df.select(stratum.alias("_s"), position(id_col, seed).alias("_p"), F.col(id_col).alias("_id"))
    rows = rows.withColumn("_b", F.substring("_p", 1, BUCKET_DIGITS))
    counts = rows.groupBy("_s", "_b").agg(F.count(F.lit(1)).alias("c"))
    # the windows see 16**BUCKET_DIGITS rows per stratum at most, whatever the table holds
    by_bucket = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = counts.withColumn("upto", F.sum("c").over(by_bucket)).withColumn(
        "n", F.sum("c").over(Window.partitionBy("_s"))
    )
    for name, size in cuts.items():
        filled = filled.withColumn(f"_{name}", size.cast("bigint"))
    before = F.col("upto") - F.col("c")
    holds_a_cut = reduce(
        lambda x, y: x | y, [(F.col(f"_{n}") > before) & (F.col(f"_{n}") <= F.col("upto")) for n in cuts]
    )
    edge = materialize(
        filled.where(holds_a_cut).select("_s", "_b", before.alias("before"), *[f"_{n}" for n in cuts]), "cut-buckets"
    )
    inside = Window.partitionBy("_s", "_b").orderBy("_p", "_id")
    ranked = term_join(rows, edge, ["_s", "_b"]).withColumn(
        "rank", F.col("before") + F.row_number().over(inside)
    )
    return materialize(
        ranked.groupBy("_s").agg(
            *[F.max(F.when(F.col("rank") == F.col(f"_{n}"), F.struct("_p", "_id"))).alias(f"_{n}") for n in cuts]
        ),
        "cut-points",
    )


def _take(df: DataFrame, id_col: str, seed: int, size: Column) -> DataFrame:
    """The rows before one cut of the whole table."""
    cut = _cut_points(df, F.lit(0), id_col, seed, {"cut": size}).select("_cut").scalar()
    here = F.struct(position(id_col, seed).alias("_p"), F.col(id_col).alias("_id"))
    return df.where(here <= cut)


def sample_n(df: DataFrame, n: int, seed: int = C.SPLIT_SEED, id_col: str = "id") -> DataFrame:
    """Exactly ``n`` random rows (all of them if there are fewer)."""
    return _take(df, id_col, seed, F.least(F.lit(n), F.col("n")))


def sample_fraction(df: DataFrame, fraction: Column | float, seed: int = C.SPLIT_SEED, id_col: str = "id") -> DataFrame:
    """Exactly ``round(fraction * rows)`` random rows."""
    fraction = fraction if isinstance(fraction, Column) else F.lit(fraction)
    return _take(df, id_col, seed, F.bround(fraction * F.col("n"), 0))


def downsample_balance(
    first: DataFrame,
    second: DataFrame,
    ratio: float = 0.5,
    *,
    sample_side: str = "larger",
    seed: int = C.SPLIT_SEED,
    id_col: str = "id",
) -> DataFrame:
    """Sample one corpus and append the other.

    With ``p = round(smaller / larger, 3)`` the sampled share is ``p`` when
    ``p < 0.5`` and ``ratio`` otherwise.  ``sample_side='first'`` always samples
    the first corpus, ``'larger'`` the larger one (the first on a tie).  The two
    corpus sizes are the only numbers that reach the driver.
    """
    n_first, n_second = first.count(), second.count()
    larger = max(n_first, n_second)
    p = round(min(n_first, n_second) / larger, 3) if larger else 0.0
    share = p if p < 0.5 else ratio
    if sample_side == "larger" and n_second > n_first:
        first, second = second, first
    return second.unionByName(sample_fraction(first, share, seed, id_col))


def stratified_split(
    df: DataFrame,
    *,
    label_col: str = "label",
    id_col: str = "id",
    train: float = C.TRAIN_SHARE,
    test_of_rest: float = C.TEST_SHARE_OF_REST,
    seed: int = C.SPLIT_SEED,
    exact: bool = True,
    split_col: str = "split",
) -> DataFrame:
    """Add ``train`` / ``test`` / ``validation`` per class.

    Of the rows of each class ``train`` go to training (rounded down); of the
    rest ``test_of_rest`` go to test (rounded down) and what is left to
    validation.  ``exact=False`` compares the position with the shares instead
    and reads the table only once; sizes then hold on average.  Ids are unique.
    """
    if not exact:
        share = position_share(id_col, seed)
        edge = train + (1 - train) * test_of_rest
        name = F.when(share < train, "train").when(share < edge, "test").otherwise("validation")
        return df.withColumn(split_col, name)
    n_train = F.floor(F.round(F.col("n") * F.lit(train), 6))
    n_test = F.floor(F.round((F.col("n") - n_train) * F.lit(test_of_rest), 6))
    stratum = _stratum(F.col(label_col))
    cuts = _cut_points(df, stratum, id_col, seed, {"train": n_train, "test": n_train + n_test})
    here = F.struct(position(id_col, seed).alias("_p"), F.col(id_col).alias("_id"))
    name = (
        F.when(F.col("_train").isNotNull() & (here <= F.col("_train")), "train")
        .when(F.col("_test").isNotNull() & (here <= F.col("_test")), "test")
        .otherwise("validation")
    )
    joined = term_join(df.withColumn("_s", stratum), cuts, "_s", "left")
    return joined.select(*df.columns, name.alias(split_col))


def split_report(df: DataFrame, split_col: str = "split") -> DataFrame:
    """Size and whole percentage per split."""
    sizes = df.groupBy(split_col).agg(F.count(F.lit(1)).alias("n"))
    everything = sizes.agg(F.sum("n").alias("total")).scalar()
    return sizes.withColumn("pct", F.round(100.0 * F.col("n") / everything, 0).cast("int"))
