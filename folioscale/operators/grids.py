"""Cells, regions and tiles: addresses, displayed numbers, range reads with merges, image tiles and their blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscale.session import table

CORE, MARGIN = 1792, 96
MOST_TILES, MOST_SIDE, MOST_PIXELS = 128, 40_000, 80_000_000
#: Number formats of a sheet that are displayed; any other keeps the raw value.
NUMBER_FORMATS = {"0": (0, False, ""), "0.00": (2, False, ""), "#,##0": (0, True, ""), "#,##0.00": (2, True, ""), "$#,##0.00": (2, True, "$")}
DATE_FORMATS = {"yyyy-mm-dd": "yyyy-MM-dd", "m/d/yy": "M/d/yy", "h:mm": "H:mm", "m/d/yy h:mm": "M/d/yy H:mm"}


def column_number(letters: Column) -> Column:
    """A1-style column letters as a number from 1."""
    return F.aggregate(F.split(F.upper(letters), ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(a * 26 + F.ascii(c) - 64))


def column_letters(number: Column) -> Column:
    """The letters of a column number from 1 to 18278."""
    low, mid, high = number - 1, F.floor((number - 27) / 26), F.floor((number - 703) / 676)
    letter = lambda x: F.char((x % 26 + 65).cast("long"))
    return F.concat(F.when(number > 702, letter(high)).otherwise(""), F.when(number > 26, letter(mid)).otherwise(""), letter(low))


def address_parts(address: Column) -> tuple[Column, Column]:
    """Row and column of an A1-style address, null outside a sheet."""
    row = F.regexp_extract(address, r"^\$?[A-Za-z]{1,3}\$?([0-9]+)$", 1)
    column = column_number(F.regexp_extract(address, r"^\$?([A-Za-z]{1,3})\$?[0-9]+$", 1))
    number = F.when(row != "", row.cast("long"))
    ok = number.between(1, 1_048_576) & column.between(1, 16_384)
    return F.when(ok, number), F.when(ok, column)


def display(value: Column, number_format: Column, system_1904: bool = False) -> Column:
    """What a sheet shows for a number; half is rounded up, the sign stands first, day 60 of 1900 is kept as the format has it."""
    out = value.cast("string")
    exact = value.cast("decimal(28,10)")
    for name, (places, grouped, sign) in NUMBER_FORMATS.items():
        size = F.abs(F.round(exact, places))
        shown = F.format_number(size, places) if grouped else size.cast(f"decimal(28,{places})").cast("string")
        out = F.when(number_format == name, F.concat(F.when(F.round(exact, places) < 0, "-").otherwise(""), F.lit(sign), shown)).otherwise(out)
    for name, places in (("0%", 0), ("0.00%", 2)):
        share = F.round(exact * 100, places)
        out = F.when(number_format == name, F.concat(share.cast(f"decimal(28,{places})").cast("string"), F.lit("%"))).otherwise(out)
    days = F.floor(exact) + (1462 if system_1904 else 0)
    # Serials from 61 on count a day that 1900 did not have.
    day = F.date_add(F.lit("1899-12-31").cast("date"), (days - F.when(days > 60, 1).otherwise(0)).cast("int"))
    moment = F.timestamp_seconds(F.unix_date(day).cast("long") * 86_400 + F.round((exact - F.floor(exact)) * 86_400).cast("long"))
    for name, pattern in DATE_FORMATS.items():
        shown = F.date_format(moment, pattern)
        if name != "h:mm":
            shown = F.when(days.between(60, 60), F.lit(None)).otherwise(shown)
        out = F.when(number_format == name, shown).otherwise(out)
    return out


def range_read(cells: DataFrame, merges: DataFrame, sheet: Column | str, r0: int, c0: int, r1: int, c1: int, keys: list[str]) -> DataFrame:
    """Every place of a range of each sheet (keys), blanks too: row, column, value, anchor_row and anchor_column of its merge.

    cells: keys, row, column, value. merges: keys, r0, c0, r1, c1 (exploded to their places, so the join is equal).
    """
    if (r1 - r0 + 1) * (c1 - c0 + 1) > 2000:
        raise ValueError("a range has 2000 places at most")
    grid = sheet.select(*keys).distinct().withColumn("row", F.explode(F.sequence(F.lit(r0), F.lit(r1)))).withColumn("column", F.explode(F.sequence(F.lit(c0), F.lit(c1))))
    inside = merges.withColumn("row", F.explode(F.sequence(F.greatest("r0", F.lit(r0)), F.greatest(F.least("r1", F.lit(r1)), F.greatest("r0", F.lit(r0)))))).withColumn("column", F.explode(F.sequence(F.greatest("c0", F.lit(c0)), F.greatest(F.least("c1", F.lit(c1)), F.greatest("c0", F.lit(c0))))))
    inside = inside.where("row between r0 and r1 and column between c0 and c1").groupBy(*keys, "row", "column").agg(F.min("r0").alias("anchor_row"), F.min("c0").alias("anchor_column"))
    return grid.join(cells, [*keys, "row", "column"], "left").join(inside, [*keys, "row", "column"], "left")


def tiles(images: DataFrame, width: str, height: str) -> DataFrame:
    """images with one row for each tile: number, core and view boxes; images beyond the limits have none."""
    across, down = F.ceil(F.col(width) / CORE).cast("int"), F.ceil(F.col(height) / CORE).cast("int")
    ok = (F.col(width) > 0) & (F.col(height) > 0) & (F.col(width) <= MOST_SIDE) & (F.col(height) <= MOST_SIDE) & (F.col(width).cast("long") * F.col(height) <= MOST_PIXELS) & (across * down <= MOST_TILES)
    grid = images.where(ok).withColumn("_y", F.explode(F.sequence(F.lit(0), down - 1))).withColumn("_x", F.explode(F.sequence(F.lit(0), across - 1)))
    x0, y0 = F.col("_x") * CORE, F.col("_y") * CORE
    x1, y1 = F.least(x0 + CORE, F.col(width)), F.least(y0 + CORE, F.col(height))
    zero = F.lit(0)
    return grid.withColumns(
        {
            "tile": F.col("_y") * across + F.col("_x"),
            "core": F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")),
            "view": F.struct(F.greatest(x0 - MARGIN, zero).alias("x0"), F.greatest(y0 - MARGIN, zero).alias("y0"), F.least(x1 + MARGIN, F.col(width)).alias("x1"), F.least(y1 + MARGIN, F.col(height)).alias("y1")),
        }
    ).drop("_x", "_y")


def owned_blocks(blocks: DataFrame, grid: DataFrame, keys: list[str]) -> DataFrame:
    """blocks (keys, tile, bbox) with owned: the centre lies in the tile's core and the box in its view."""
    met = blocks.join(grid.select(*keys, "tile", "core", "view"), [*keys, "tile"], "left")
    cx, cy = (F.col("bbox.x0") + F.col("bbox.x1")) / 2, (F.col("bbox.y0") + F.col("bbox.y1")) / 2
    inside = (cx >= F.col("core.x0")) & (cx < F.col("core.x1")) & (cy >= F.col("core.y0")) & (cy < F.col("core.y1"))
    within = (F.col("bbox.x0") >= F.col("view.x0")) & (F.col("bbox.y0") >= F.col("view.y0")) & (F.col("bbox.x1") <= F.col("view.x1")) & (F.col("bbox.y1") <= F.col("view.y1"))
    return met.withColumn("owned", F.coalesce(inside & within, F.lit(False))).drop("core", "view")


def q_tile_grid(spark: SparkSession, sf: str) -> DataFrame:
    images = table(spark, sf, "part").select("p_partkey", (F.col("p_size") * 190 + 40).cast("int").alias("width"), (F.col("p_partkey") % 97 * 101 + 1).cast("int").alias("height"))
    return tiles(images, "width", "height").select("p_partkey", "tile", *[F.col(f"{b}.{k}").alias(f"{b}_{k}") for b in ("core", "view") for k in ("x0", "y0", "x1", "y1")])


def q_cell_addresses(spark: SparkSession, sf: str) -> DataFrame:
    address = F.concat(column_letters((F.col("p_partkey") % 16384 + 1).cast("long")), (F.col("p_partkey") * 13 % 1000 + 1).cast("string"))
    row, column = address_parts(F.col("address"))
    return table(spark, sf, "part").select("p_partkey", address.alias("address")).select("p_partkey", "address", row.alias("row"), column.alias("column"))


def q_cell_range_read(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    cells = lines.groupBy(F.col("l_orderkey").alias("sheet"), F.col("l_linenumber").alias("row"), (F.col("l_suppkey") % 5 + 1).cast("int").alias("column")).agg(F.max("l_quantity").alias("value"))
    merges = table(spark, sf, "orders").select(F.col("o_orderkey").alias("sheet"), F.lit(1).alias("r0"), F.lit(1).alias("c0"), F.lit(2).alias("r1"), F.lit(3).alias("c1"))
    got = range_read(cells, merges, cells, 1, 1, 3, 4, ["sheet"])
    return got.select("sheet", "row", "column", F.coalesce("value", F.lit(-1.0)).alias("value"), F.coalesce("anchor_row", F.lit(0)).alias("anchor_row"), F.coalesce("anchor_column", F.lit(0)).alias("anchor_column"))


def q_sheet_display(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ["0", "0.00", "#,##0", "$#,##0.00", "0%", "0.00%", "General"])), (F.col("l_linenumber") % 7 + 1).cast("int"))
    signed = F.when(F.col("l_returnflag") == "R", -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice"))
    value = F.round(F.when(F.col("l_linenumber") % 7 >= 4, F.col("l_discount")).otherwise(signed), 2)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(kind == "General", F.lit("")).otherwise(display(value, kind)).alias("shown"))


def q_sheet_dates(spark: SparkSession, sf: str) -> DataFrame:
    serial = F.datediff("o_orderdate", F.lit("1899-12-30").cast("date")) + (F.col("o_orderkey") % 4) / 4
    kind = F.element_at(F.array(*map(F.lit, ["yyyy-mm-dd", "m/d/yy h:mm"])), (F.col("o_orderkey") % 2 + 1).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", display(serial, kind).alias("shown"))


QUERIES = {"tile_grid": q_tile_grid, "cell_addresses": q_cell_addresses, "cell_range_read": q_cell_range_read, "sheet_display": q_sheet_display, "sheet_dates": q_sheet_dates}
ORACLES = {
    "tile_grid": "WITH i AS (SELECT p_partkey, CAST(p_size * 190 + 40 AS INTEGER) AS w, CAST(p_partkey % 97 * 101 + 1 AS INTEGER) AS h FROM part), t AS (SELECT *, CAST(ceil(w / 1792) AS INTEGER) AS a, CAST(ceil(h / 1792) AS INTEGER) AS d FROM i), g AS (SELECT t.*, x, y FROM t, (SELECT CAST(unnest(range(0, 24)) AS INTEGER) AS x), (SELECT CAST(unnest(range(0, 24)) AS INTEGER) AS y) WHERE x < a AND y < d AND CAST(w AS BIGINT) * h <= 80000000) SELECT p_partkey, y * a + x AS tile, x * 1792 AS core_x0, y * 1792 AS core_y0, least(x * 1792 + 1792, w) AS core_x1, least(y * 1792 + 1792, h) AS core_y1, greatest(x * 1792 - 96, 0) AS view_x0, greatest(y * 1792 - 96, 0) AS view_y0, least(x * 1792 + 1888, w) AS view_x1, least(y * 1792 + 1888, h) AS view_y1 FROM g",
    "cell_addresses": "WITH p AS (SELECT p_partkey, p_partkey % 16384 + 1 AS c, p_partkey * 13 % 1000 + 1 AS r FROM part) SELECT p_partkey, CASE WHEN c > 702 THEN chr(CAST(65 + ((c - 703) // 676) % 26 AS INTEGER)) ELSE '' END || CASE WHEN c > 26 THEN chr(CAST(65 + ((c - 27) // 26) % 26 AS INTEGER)) ELSE '' END || chr(CAST(65 + (c - 1) % 26 AS INTEGER)) || CAST(r AS VARCHAR) AS address, r AS row, CAST(c AS INTEGER) AS \"column\" FROM p",
    "cell_range_read": "WITH k AS (SELECT l_orderkey AS sheet, l_linenumber AS row, CAST(l_suppkey % 5 + 1 AS INTEGER) AS col, max(l_quantity) AS value FROM lineitem GROUP BY 1, 2, 3), g AS (SELECT sheet, r, c FROM (SELECT DISTINCT sheet FROM k), (SELECT CAST(unnest(range(1, 4)) AS INTEGER) AS r), (SELECT CAST(unnest(range(1, 5)) AS INTEGER) AS c)) SELECT g.sheet, r AS row, c AS \"column\", coalesce(value, -1.0) AS value, CAST(CASE WHEN r <= 2 AND c <= 3 THEN 1 ELSE 0 END AS INTEGER) AS anchor_row, CAST(CASE WHEN r <= 2 AND c <= 3 THEN 1 ELSE 0 END AS INTEGER) AS anchor_column FROM g LEFT JOIN k ON k.sheet = g.sheet AND k.row = g.r AND k.col = g.c",
    "sheet_display": "WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linenumber % 7 AS k, CAST(round(CASE WHEN l_linenumber % 7 >= 4 THEN l_discount WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END, 2) AS DECIMAL(28, 10)) AS x FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE k WHEN 0 THEN CASE WHEN round(x, 0) < 0 THEN '-' ELSE '' END || CAST(CAST(abs(round(x, 0)) AS DECIMAL(28, 0)) AS VARCHAR) WHEN 1 THEN CASE WHEN round(x, 2) < 0 THEN '-' ELSE '' END || CAST(CAST(abs(round(x, 2)) AS DECIMAL(28, 2)) AS VARCHAR) WHEN 2 THEN CASE WHEN round(x, 0) < 0 THEN '-' ELSE '' END || format('{:,}', CAST(abs(round(x, 0)) AS BIGINT)) WHEN 3 THEN CASE WHEN round(x, 2) < 0 THEN '-' ELSE '' END || '$' || format('{:,}', CAST(floor(abs(round(x, 2))) AS BIGINT)) || right(CAST(CAST(abs(round(x, 2)) AS DECIMAL(28, 2)) AS VARCHAR), 3) WHEN 4 THEN CAST(CAST(round(x * 100, 0) AS DECIMAL(28, 0)) AS VARCHAR) || '%' WHEN 5 THEN CAST(CAST(round(x * 100, 2) AS DECIMAL(28, 2)) AS VARCHAR) || '%' ELSE '' END AS shown FROM v",
    "sheet_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%-m/%-d/%y') || ' ' || CASE o_orderkey % 4 WHEN 1 THEN '6:00' WHEN 3 THEN '18:00' ELSE '0:00' END END AS shown FROM orders",
}
