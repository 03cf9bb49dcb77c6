"""Billing periods: resolving their dates against neighbours, splitting them into months, covered days."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.dates import inclusive_days
from tallyweave.functions.text import is_blank, own_columns, trimmed

SEQUENCE = ("division", "legal_entity", "unit_name", "supplier_name", "account_number", "activity_group")
# How adjustments and resolutions are written; the minus is U+2212.
END_LESS, START_MORE = "End −1 day", "Start +1 day"
INVALID, OVERLAP, SINGLE, MONTH_START, MONTH_END = "Invalid dates", "Overlap", "Single day", "Month-start dates", "Month-end dates"
SHARED, CONSECUTIVE, GAP, PATTERN, ALONE = "Shared date", "Consecutive dates", "Gap", "Previous invoice pattern", "Insufficient history"


def stacked(df: DataFrame, groups: list[dict[str, str]], common: list[str]) -> DataFrame:
    """One row for each group of columns (start, end, quantity, unit) that is not wholly blank; the first always stays."""
    structs = [F.struct(F.lit(i + 1).alias("period_index"), *(F.col(c).alias(k) for k, c in g.items())) for i, g in enumerate(groups)]
    rows = df.select(*common, F.explode(F.array(*structs)).alias("p")).select(*common, "p.*")
    return rows.where((F.col("period_index") == 1) | F.coalesce("start", "end").isNotNull() | F.col("quantity").isNotNull())


def horizontal_quantity(quantities: list[Column], second_period: Column) -> tuple[Column, Column]:
    """(first, second) quantity of a line: the two as they are if it has a second period, else the sum of all present."""
    present = F.filter(F.array(*quantities), lambda q: q.isNotNull())
    total = F.when(F.size(present) > 0, F.aggregate(present, F.lit(0.0), lambda a, b: a + b))
    return F.when(second_period, quantities[0]).otherwise(total), F.when(second_period, quantities[1])


def _sequences(df: DataFrame) -> DataFrame:
    valid = F.col("start").isNotNull() & F.col("end").isNotNull() & (F.col("end") >= F.col("start"))
    linked = valid & ~is_blank(F.col("account_number")) & (is_blank(F.col("mapping_status")) | (F.col("mapping_status") == "MAPPED"))
    key = F.concat_ws("\u0001", *(F.lower(F.coalesce(trimmed(F.col(c)), F.lit(""))) for c in SEQUENCE))
    alone = F.concat_ws("\u0001", F.lit("alone"), "row_id", "period_index")
    own_columns(df)
    return df.withColumns({"_tw_valid": F.coalesce(valid, F.lit(False)), "_tw_seq": F.when(linked, key).otherwise(alone)})


PLACE = ["start", "end", "row_id", "period_index"]


def _chunked(rows: DataFrame, spill: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows with _tw_chunk: sequences in their order, dealt by range, so that one of any length is cut between tasks."""
    return spill(rows.repartitionByRange("_tw_seq", *PLACE).withColumn("_tw_chunk", F.spark_partition_id()))


def _met(rows: DataFrame, summary: DataFrame, carried: dict[str, Column]) -> DataFrame:
    """rows with _tw_in, what their chunk is handed by the other chunks of its sequence; null where the sequence is in one.

    summary has a row a sequence and chunk; carried are expressions over its rows of one sequence. Only sequences in several chunks are joined.
    """
    handed = summary.withColumns({f"_tw_c_{k}": c for k, c in carried.items()} | {"_tw_chunks": F.count("*").over(Window.partitionBy("_tw_seq"))})
    handed = handed.where("_tw_chunks > 1").select("_tw_seq", "_tw_chunk", F.struct(*(F.col(f"_tw_c_{k}").alias(k) for k in carried)).alias("_tw_in"))
    return rows.join(handed, ["_tw_seq", "_tw_chunk"], "left")


def overlap_flags(df: DataFrame, spill: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """df with conflict, whether a period overlaps another of its sequence by more than one shared end date, and the helpers of the sequence.

    Rows without an account, unmapped rows and invalid dates are sequences of their own, so they never share a partition. Both
    running bounds grow along their frame, forwards and backwards, so a sequence takes time in proportion to its length.

    Where one sequence may hold a large part of all rows, give spill, which writes a table: sequences are then cut into chunks by range. A chunk's largest
    end, its ends and its first single day are one row; running bounds over those rows are handed to the chunks, so the flags are
    the same and no task sees more than a chunk.
    """
    rows = _sequences(df)
    start, end = F.col("start"), F.col("end")
    alone = F.when(start == end, start)
    if spill:
        rows = _chunked(rows, spill)
        summary = rows.groupBy("_tw_seq", "_tw_chunk").agg(F.max("end").alias("reach"), F.min("start").alias("first"), F.max("start").alias("last"), F.min(alone).alias("single"))
        chunks = Window.partitionBy("_tw_seq").orderBy("_tw_chunk")
        before, after = chunks.rowsBetween(Window.unboundedPreceding, -1), chunks.rowsBetween(1, Window.unboundedFollowing)
        rows = _met(rows, summary, {"reach": F.max("reach").over(before), "last": F.lag("last").over(chunks), "first": F.lead("first").over(chunks), "single": F.min("single").over(after)})
    part = ["_tw_seq", "_tw_chunk"] if spill else ["_tw_seq"]
    order = Window.partitionBy(*part).orderBy(*PLACE)
    back = Window.partitionBy(*part).orderBy(*(F.desc(c) for c in PLACE))
    handed = lambda f, c, k: f(c, F.col("_tw_in")[k]) if spill else c
    # backwards first: what follows, here and in resolve_dates(), then shares one sort
    rows = rows.withColumn("_tw_single", handed(F.least, F.min(alone).over(back.rowsBetween(Window.unboundedPreceding, -1)), "single"))
    single = F.col("_tw_single")
    reach = handed(F.greatest, F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), "reach")
    earlier, later = handed(F.coalesce, F.lag("start").over(order), "last"), handed(F.coalesce, F.lead("start").over(order), "first")
    own = (reach > start) | (earlier == start) | ((start == end) & (reach >= start))
    partner = (later < end) | (later == start) | (single <= end)
    rows = rows.withColumn("conflict", F.col("_tw_valid") & (F.coalesce(own, F.lit(False)) | F.coalesce(partner, F.lit(False))))
    return rows.drop("_tw_single", "_tw_in")


def resolve_dates(df: DataFrame, spill: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """df with effective_start, effective_end, date_adjustment, date_resolution, resolution_reference, date_provisional.

    df has row_id, period_index, the sequence columns, mapping_status, start and end; all flows resolve as one history.
    spill is for sequences that are too long for a task, as in overlap_flags(); the rows are the same.
    """
    order = Window.partitionBy(*(["_tw_seq", "_tw_chunk"] if spill else ["_tw_seq"])).orderBy(*PLACE)
    rows = overlap_flags(df, spill)
    # a column for each thing told of a neighbour, so that what a caller does not read is not made
    told = ("start", "end", "conflict", "row_id", "period_index")
    nearest = {f"_tw_{way}_{c}": at(c).over(order) for way, at in (("next", F.lead), ("prev", F.lag)) for c in told}
    if spill:
        rows, chunks = spill(rows), Window.partitionBy("_tw_seq").orderBy("_tw_chunk")
        ref = F.struct(*told)
        summary = rows.groupBy("_tw_seq", "_tw_chunk").agg(F.min_by(ref, F.struct(*PLACE)).alias("head"), F.max_by(ref, F.struct(*PLACE)).alias("tail"))
        rows = _met(rows, summary, {"next": F.lead("head").over(chunks), "prev": F.lag("tail").over(chunks)}).withColumns(nearest)
        nearest = {f"_tw_{way}_{c}": F.when(F.col(f"_tw_{way}_conflict").isNotNull(), F.col(f"_tw_{way}_{c}")).otherwise(F.col("_tw_in")[way][c]) for way in ("next", "prev") for c in told}
    rows = rows.withColumns(nearest)
    start, end = F.col("start"), F.col("end")
    nxt, prev = ({c: F.col(f"_tw_{way}_{c}") for c in told} for way in ("next", "prev"))
    # conflict is never null: it tells whether there is a neighbour
    has_next, has_prev = nxt["conflict"].isNotNull(), prev["conflict"].isNotNull()
    shares = (nxt["start"] == end) & (start < end)
    shared = (start == prev["end"]) & (start < end)
    label = (
        F.when(~F.col("_tw_valid"), INVALID)
        .when(F.col("conflict"), OVERLAP)
        .when(start == end, SINGLE)
        .when((F.dayofmonth(start) == 1) & (F.dayofmonth(end) == 1), MONTH_START)
        .when((start == F.last_day(start)) & (end == F.last_day(end)), MONTH_END)
        .when(has_next & nxt["conflict"], OVERLAP)
        .when(has_next & shares, SHARED)
        .when(has_next & (nxt["start"] == F.date_add(end, 1)), CONSECUTIVE)
        .when(has_next, GAP)
        .when(has_prev & prev["conflict"], OVERLAP)
        .when(has_prev & (shared | (start == F.date_add(prev["end"], 1))), PATTERN)
        .when(has_prev, GAP)
        .otherwise(ALONE)
    )
    # one row for one: a filter on what follows from the label would be pushed below it, and make it anew for each mention
    rows = rows.select("*", F.inline(F.array(F.struct(label.alias("date_resolution")))))
    r = F.col("date_resolution")
    less = r.isin(MONTH_START, SHARED) | ((r == PATTERN) & shared)
    fixed = ~F.col("_tw_valid") | F.col("conflict") | r.isin(SINGLE, MONTH_START, MONTH_END)
    ref = lambda x: F.concat(x["row_id"], F.lit(" (period "), x["period_index"], F.lit(")"))
    rows = (
        rows.withColumn("date_adjustment", F.when(less, END_LESS).when(r == MONTH_END, START_MORE).otherwise("None"))
        .withColumn("effective_start", F.when(F.col("date_adjustment") == START_MORE, F.date_add(start, 1)).otherwise(start))
        .withColumn("effective_end", F.when(F.col("date_adjustment") == END_LESS, F.date_sub(end, 1)).otherwise(end))
        .withColumn("date_provisional", ~r.isin(SINGLE, MONTH_START, MONTH_END, SHARED, CONSECUTIVE))
        .withColumn("resolution_reference", F.when(~fixed, F.when(has_next, ref(nxt)).when(has_prev, ref(prev))))
    )
    return rows.drop("_tw_valid", "_tw_seq", *nearest, "_tw_chunk", "_tw_in", "conflict")


def month_split(df: DataFrame, start: str = "effective_start", end: str = "effective_end", quantity: str = "quantity", keep_unsplit: bool = False) -> DataFrame:
    """One row a month that a valid period touches: month, split_start, split_end, split_days, total_days, split_quantity.

    keep_unsplit: periods without valid dates or quantity stay as one row, with null in these columns.
    """
    s, e = F.col(start), F.col(end)
    usable = s.isNotNull() & e.isNotNull() & (e >= s) & F.col(quantity).isNotNull()
    months = F.sequence(F.trunc(s, "MM"), e, F.expr("interval 1 month"))
    # no filter: it would be pushed to where the dates are made, and make them twice
    rows = df.withColumn("month", (F.explode_outer if keep_unsplit else F.explode)(F.when(usable, months)))
    there = lambda c: F.when(F.col("month").isNotNull(), c) if keep_unsplit else c
    rows = rows.withColumns({"split_start": there(F.greatest(s, "month")), "split_end": there(F.least(e, F.last_day("month")))})
    rows = rows.withColumns({"split_days": inclusive_days(F.col("split_start"), F.col("split_end")), "total_days": there(inclusive_days(s, e))})
    return rows.withColumn("split_quantity", F.col(quantity) / F.col("total_days") * F.col("split_days"))


def islands(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """keys, _tw_s and _tw_e of each island of the union of their inclusive intervals; intervals that meet end to start are one island."""
    own_columns(df)
    valid = df.where(F.col(end) >= F.col(start)).select(*keys, F.col(start).alias("_tw_s"), F.col(end).alias("_tw_e")).distinct()
    order = Window.partitionBy(*keys).orderBy("_tw_s", "_tw_e")
    reach = F.max("_tw_e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("_tw_s") > F.date_add(reach, 1)), 1).otherwise(0)
    rows = valid.withColumn("_tw_new", new).withColumn("_tw_island", F.sum("_tw_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "_tw_island").agg(F.min("_tw_s").alias("_tw_s"), F.max("_tw_e").alias("_tw_e"))


def covered_days(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """keys with covered_days, the length of the union of their inclusive intervals, and islands, how many it has."""
    spans = islands(df, keys, start, end)
    return spans.groupBy(*keys).agg(F.sum(inclusive_days(F.col("_tw_s"), F.col("_tw_e"))).alias("covered_days"), F.count("*").alias("islands"))


def day_coverage(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """keys, month with covered_days and overlapping_days (days in two periods or more).

    Periods are two events each, one more and one fewer; events of a day are summed before they are ordered, so a span between
    two event days is one row however long it is, cut only where a month ends. Null keys are a key like others.
    """
    own_columns(df)
    valid = df.where(F.col(end) >= F.col(start))
    edges = F.array(F.struct(F.col(start).alias("d"), F.lit(1).alias("n")), F.struct(F.date_add(end, 1).alias("d"), F.lit(-1).alias("n")))
    events = valid.select(*keys, F.explode(edges).alias("_tw_e")).groupBy(*keys, F.col("_tw_e.d").alias("_tw_d")).agg(F.sum("_tw_e.n").alias("_tw_n"))
    order = Window.partitionBy(*keys).orderBy("_tw_d")
    spans = events.withColumns({"_tw_open": F.sum("_tw_n").over(order), "_tw_to": F.date_sub(F.lead("_tw_d").over(order), 1)}).where("_tw_open > 0")
    cut = spans.withColumn("month", F.explode(F.sequence(F.trunc("_tw_d", "MM"), "_tw_to", F.expr("interval 1 month"))))
    days = inclusive_days(F.greatest("_tw_d", "month"), F.least("_tw_to", F.last_day("month"))).cast("long")
    return cut.groupBy(*keys, "month").agg(F.sum(days).alias("covered_days"), F.sum(F.when(F.col("_tw_open") > 1, days).otherwise(0)).alias("overlapping_days"))


#: What makes two splits the same segment.
SEGMENT = ("row_id", "period_index", "month", "split_start", "split_end", "split_quantity")


def distinct_segments(splits: DataFrame) -> DataFrame:
    """splits with each segment (row, period, month, bounds, amount) once; null bounds and amounts count as equal. For a report sort by row and bounds."""
    return splits.dropDuplicates(list(SEGMENT))
