"""Helpers that keep work spread out when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import cut_lineage

CROWDED = 200_000  # rows of one cell that are still put in order by one task
PART = 2_000  # rows of a part of a crowded bucket, of which two are compared at a time: some seconds' work
FEW_PARTS = 16  # parts that a bucket is cut into if they are smaller than that
STRETCHES = 256  # stretches of a bucket's width, of which the parts of a crowded bucket are put together
PART_KEYS = ["__bucket", "__left_part", "__right_part"]


def hot_keys(df: DataFrame, keys: list[str], rows_per_split: int) -> DataFrame:
    """Keys with more than ``rows_per_split`` rows and into how many parts each should be cut (``splits``)."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    crowded = counts.filter(F.col("__n") > rows_per_split)
    return crowded.select(*keys, F.ceil(F.col("__n") / rows_per_split).cast("int").alias("splits"))


def running_totals(
    df: DataFrame, group: list[str], cell: list[str], order: list[str | Column], totals: dict[str, Column]
) -> DataFrame:
    """Inclusive running sums over ``group`` in ``order``, without sorting a whole group in one task.

    ``cell`` must be non-null columns that grow with ``order`` and take few values per group. Each (group, cell)
    is summed up on its own; only the cell totals are accumulated per group. Adds for each name in ``totals`` the
    running sum and ``<name>_all``, the sum of the group.
    """
    names = list(totals)
    df = df.withColumns({f"__{n}": c for n, c in totals.items()})
    before = Window.partitionBy(*group).orderBy(*cell).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    cells = df.groupBy(*group, *cell).agg(*[F.sum(f"__{n}").alias(f"__{n}_cell") for n in names])
    cells = cells.select(
        *group,
        *cell,
        *[F.coalesce(F.sum(f"__{n}_cell").over(before), F.lit(0)).alias(f"__{n}_before") for n in names],
        *[F.sum(f"__{n}_cell").over(whole).alias(f"{n}_all") for n in names],
    )
    inside = Window.partitionBy(*group, *cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = df.withColumns({f"__{n}": F.sum(f"__{n}").over(inside) for n in names})
    out = summed.join(cells, [*group, *cell])
    out = out.withColumns({n: F.col(f"__{n}") + F.col(f"__{n}_before") for n in names})
    return out.drop(*[f"__{n}" for n in names], *[f"__{n}_before" for n in names])


def joined_to(df: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null; ``other`` adds its further columns."""
    other = other.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    equal = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return df.join(other, equal, how).drop(*[f"__r_{k}" for k in keys])


def numbered(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Adds ``name``, the place (from 1) of a row within its group in ``order``, nulls first.

    Rows are put in order by range over all tasks, so rows of one group, or of one instant, are shared out as evenly as
    ``order`` tells them apart. What a task holds of one group is a stretch; a row's place is its place in the stretch
    plus the sizes of the group's stretches before it. Only those sizes are brought together, one for each task.
    """
    placed = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    placed = cut_lineage(placed.withColumn("__at", F.monotonically_increasing_id()))
    placed = placed.withColumn("__part", F.shiftright("__at", 33))
    keys = [*group, "__part"]
    stretches = placed.groupBy(*keys).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first") + 1
    stretches = stretches.select(*keys, shift.alias("__shift"))
    joined = joined_to(placed, stretches, keys)
    return joined.select(*df.columns, (F.col("__at") + F.col("__shift")).alias(name))


def row_numbers(
    df: DataFrame, group: list[str], cell: str, order: list[str], name: str, crowded: int = CROWDED
) -> DataFrame:
    """Adds ``name``, the place (from 1) of a row within its group in ``order``, nulls first.

    ``cell`` is a non-null column that grows with ``order``. Cells are counted and rows are numbered within theirs, by
    one task for each cell; cells of more than ``crowded`` rows, such as all that was loaded at one instant, are
    numbered by ranges of the whole order (see :func:`numbered`).
    """
    keys = [*group, cell]
    before = Window.partitionBy(*group).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    cells = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    cells = cells.select(*keys, "__n", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    packed = cut_lineage(cells.filter(F.col("__n") > crowded))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    if packed.isEmpty():
        numbers = df.withColumn("__inside", inside)
    else:
        some = joined_to(df, packed.select(*keys), keys, "left_semi")
        rest = joined_to(df, packed.select(*keys), keys, "left_anti")
        numbers = rest.withColumn("__inside", inside).unionByName(numbered(some, keys, order, "__inside"))
    out = joined_to(numbers, cells.select(*keys, "__before"), keys)
    return out.select(*df.columns, (F.col("__inside") + F.col("__before")).cast("bigint").alias(name))


def interval_join(
    left: DataFrame,
    right: DataFrame,
    left_time: str,
    right_time: str,
    width: int,
    rows_per_split: int = PART,
) -> DataFrame:
    """All pairs of rows whose times (whole numbers) are at most ``width`` apart.

    Both sides are cut into time buckets of that width; the left side is repeated for the buckets next to
    its own, which turns the range condition into an equi-join on the bucket. Crowded buckets are cut further into
    a grid: each side is dealt into parts of about ``rows_per_split`` rows and repeated for the parts of the other
    side, so that no task compares more than one part with one part. However many buckets are crowded, each is cut;
    the table of them is joined like any other. Parts of less than ``PART`` rows are made as long as they are few, so
    that rows are not repeated in proportion to their number.

    What is repeated and dealt out are whole parts, a row each. Pairs come in runs of one left row, of rows in order of
    time and then of their other columns as they stand in both tables, and parts are stretches of time. Pairs are many,
    and they take less where they are stored the more values stand next to their like.

    Pairs are many and parts are few, so the tasks are not put together by the size of the parts.
    """
    columns = left.columns
    left, right = parts(left, right, left_time, right_time, width, rows_per_split)
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # One column: of several, Spark leaves out what it knows to be constant and deals the parts anew.
    key = F.concat_ws(" ", *PART_KEYS).alias("__key")
    left, right = (df.select(key, "__rows").repartition(tasks, "__key") for df in (left, right))
    # Left rows come apart before the join, as all pairs of a joined row are held until they are made. A merge takes
    # left rows one after the other, where a broadcast of the left side would take a right part with all of them.
    pairs = left.select("__key", F.inline("__rows")).join(right.hint("merge"), "__key").select(*columns, F.inline("__rows"))
    return pairs.filter(F.abs(F.col(right_time) - F.col(left_time)) <= width)


def dealt(
    left: DataFrame, right: DataFrame, left_time: str, right_time: str, width: int, rows_per_split: int
) -> tuple[DataFrame, DataFrame]:
    """The rows of both sides with the bucket and the parts in which :func:`interval_join` compares them."""
    sides = parts(left, right, left_time, right_time, width, rows_per_split)
    left, right = (df.select(*PART_KEYS, F.inline("__rows")) for df in sides)
    return left, right


def parts(
    left: DataFrame, right: DataFrame, left_time: str, right_time: str, width: int, rows_per_split: int
) -> tuple[DataFrame, DataFrame]:
    """The parts of both sides, repeated for those of the other side; ``__rows`` are a part's rows in order of time.

    The parts of a crowded bucket follow each other in time: its rows are counted by stretches, and a row's part is
    told by the number of rows before its stretch. Rows of one stretch, such as all of one instant, are dealt by their
    hash and the task that reads them, so that equal rows are not all of one part.
    """

    def placed(df: DataFrame, time: str) -> DataFrame:
        row = F.struct(time, *[c for c in df.columns if c != time])
        stretch = F.floor(F.col(time) / (width / STRETCHES))
        bucket, task = F.floor(F.col(time) / width).alias("__bucket"), F.spark_partition_id().alias("__task")
        return df.select(bucket, stretch.alias("__stretch"), row.alias("__row"), task)

    near = F.explode(F.sequence(F.col("__bucket") - 1, F.col("__bucket") + 1))
    left, right = placed(left, left_time).withColumn("__bucket", near), placed(right, right_time)
    full = F.ceil(F.col("splits") * rows_per_split / PART)
    few = F.least("splits", F.greatest(full, F.lit(FEW_PARTS))).cast("int")
    left_hot, right_hot = (
        hot_keys(df, ["__bucket"], rows_per_split).select("__bucket", few.alias(f"{side}_splits"))
        for df, side in ((left, "left"), (right, "right"))
    )
    hot = left_hot.join(right_hot, ["__bucket"], "full")

    def deal(df: DataFrame, own: str, other: str, own_hot: DataFrame) -> DataFrame:
        keys = ["__bucket", "__stretch"]
        bucket = Window.partitionBy("__bucket")
        before = bucket.orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
        stretches = df.groupBy(*keys).agg(F.count("*").alias("__n")).join(own_hot, ["__bucket"]).select(
            *keys,
            "__n",
            F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
            F.sum("__n").over(bucket).alias("__all"),
            F.col(f"{own}_splits").alias("__parts"),
        )
        place = F.col("__before") + F.pmod(F.xxhash64("__row", "__task"), "__n")
        part = F.least(F.floor(place * F.col("__parts") / F.col("__all")), F.col("__parts") - 1)
        df = df.join(stretches, keys, "left").withColumn(f"__{own}_part", F.coalesce(part, F.lit(0)).cast("int"))
        df = df.groupBy("__bucket", f"__{own}_part").agg(F.sort_array(F.collect_list("__row")).alias("__rows"))
        others = F.sequence(F.lit(0), F.coalesce(f"{other}_splits", F.lit(1)) - 1)
        df = df.join(hot, ["__bucket"], "left").withColumn(f"__{other}_part", F.explode(others))
        return df.select(*PART_KEYS, "__rows")

    return deal(left, "left", "right", left_hot), deal(right, "right", "left", right_hot)
