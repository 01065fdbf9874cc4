"""Global order without a global sort in one task.

The rows are range-partitioned by the whole sort key (time and ties, so a hot time is split by its ties), sorted inside their
partition, numbered there and written once to the shared folder.  The partitions' row counts, as many as there are shuffle
partitions, give each row's place in the whole.  What looks at neighbours works in chunks of consecutive places, to which the few
rows across a chunk's border are copied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tempora.functions import exprs as E
from tempora.staging import stage

#: The column of places.
PLACE = "_tempora_at"
_CHUNK, _OWN = "_tempora_chunk", "_tempora_own"


def _keys(df: DataFrame, time_col: str, ties: tuple[str, ...], ascending: bool = True) -> list[Column]:
    t = E.time_number(df, time_col)
    return [t.asc_nulls_first() if ascending else t.desc_nulls_first(), *[F.col(f"`{c}`").asc_nulls_first() for c in ties]]


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def in_order(df: DataFrame, keys: list[Column]) -> tuple[DataFrame, int]:
    """df with the place of each row, from 0, in the order of the keys, in the column PLACE; and the number of rows."""
    rows = df.repartitionByRange(_parts(df), *keys).sortWithinPartitions(*keys).withColumn(PLACE, F.monotonically_increasing_id())
    rows = stage(rows, "order")
    part = F.shiftright(PLACE, 33)  # the upper bits are the partition, the lower 33 the row in it
    counts = rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()  # one row per partition
    offsets, total = [], 0
    for r in counts:
        offsets.append((r.p, total - (r.p << 33)))
        total += r.n
    shift = df.sparkSession.createDataFrame(offsets, "_tempora_p bigint, _tempora_shift bigint")
    rows = rows.join(F.broadcast(shift), part == F.col("_tempora_p"))
    return rows.withColumn(PLACE, F.col(PLACE) + F.col("_tempora_shift")).drop("_tempora_p", "_tempora_shift"), total


def global_index(df: DataFrame, time_col: str, ties: tuple[str, ...] = (), name: str = "idx", by: tuple[str, ...] = ()) -> DataFrame:
    """df with the rank of each row, from 0, in the order of time and ties (within each combination of `by`)."""
    return index_and_count(df, time_col, ties, name, by)[0]


def index_and_count(df: DataFrame, time_col: str, ties: tuple[str, ...] = (), name: str = "idx", by: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """global_index() and the number of rows, which is known then."""
    rows, total = in_order(df, [*[F.col(f"`{c}`").asc_nulls_first() for c in by], *_keys(df, time_col, ties)])
    place = F.col(PLACE)
    if by:
        first = rows.groupBy(*[F.col(f"`{c}`").alias(f"_tempora_{k}") for k, c in enumerate(by)]).agg(F.min(PLACE).alias("_tempora_first"))
        same = [F.col(f"`{c}`").eqNullSafe(F.col(f"_tempora_{k}")) for k, c in enumerate(by)]
        rows, place = rows.join(first, same), F.col(PLACE) - F.col("_tempora_first")
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], place.alias(name)), total


def neighbourhoods(df: DataFrame, keys: list[Column], before: int = 0, after: int = 0) -> tuple[DataFrame, WindowSpec, Column]:
    """(rows, window, own): rows in chunks of consecutive places, each with copies of the `before` rows ahead of it and the `after` rows
    behind it; the window orders a chunk, and own holds for the rows that are no copies."""
    rows, total = in_order(df, keys)
    size = max(before, after, -(-total // (4 * _parts(df))), 1)
    place, chunk = F.col(PLACE), F.floor(F.col(PLACE) / size)
    copies = [F.struct(chunk.alias("c"), F.lit(True).alias("o"))]
    none = F.lit(None).cast("struct<c:bigint,o:boolean>")
    if after:
        copies.append(F.when(place % size < after, F.struct((chunk - 1).alias("c"), F.lit(False).alias("o"))).otherwise(none))
    if before:
        copies.append(F.when(place % size >= size - before, F.struct((chunk + 1).alias("c"), F.lit(False).alias("o"))).otherwise(none))
    rows = rows.withColumn(_CHUNK, F.explode(F.array_compact(F.array(*copies))))
    rows = rows.withColumn(_OWN, F.col(_CHUNK)["o"]).withColumn(_CHUNK, F.col(_CHUNK)["c"])
    return rows, Window.partitionBy(_CHUNK).orderBy(PLACE), F.col(_OWN)


def lead_in_order(df: DataFrame, value: str, n: int, time_col: str, name: str, ties: tuple[str, ...] = (), ascending: bool = True) -> DataFrame:
    """df with the value n rows ahead in the global order of time and ties; null where there is none."""
    return leads_in_order(df, value, {n: name}, time_col, ties, ascending)


def leads_in_order(df: DataFrame, value: str, names: dict[int, str], time_col: str, ties: tuple[str, ...] = (), ascending: bool = True) -> DataFrame:
    """df with the values so many rows ahead, by name, in one pass."""
    rows, w, own = neighbourhoods(df, _keys(df, time_col, ties, ascending), after=max(names))
    rows = rows.withColumns({name: F.lead(value, n).over(w) for n, name in names.items()})
    return rows.where(own).select(*[F.col(f"`{c}`") for c in df.columns], *names.values())


def means_in_order(df: DataFrame, value: str, size: int, keys: list[Column], name: str) -> DataFrame:
    """df with the mean of the last `size` values in the order of the keys; null until there are so many or if one of them is null."""
    rows, w, own = neighbourhoods(df, keys, before=size - 1)
    w = w.rowsBetween(-(size - 1), 0)
    rows = rows.withColumn(name, F.when(F.count(value).over(w) == size, F.avg(value).over(w)))
    return rows.where(own).select(*[F.col(f"`{c}`") for c in df.columns], name)
