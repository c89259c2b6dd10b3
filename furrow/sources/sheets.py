"""Sheets: untyped cell grids in, clean yearly rows out.

A sheet is a long table (sheet, row, col, value: all text). Choosing the header row, merging
header labels and selecting columns are relational steps on that table, for all sheets at once.
Only names, which are metadata, reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from furrow.functions.scalars import blank, canonical, cell, number
from furrow.session import scratch, stored
from furrow.sources.panel import sheet_identity

#: Tokens of header cells, sub-header words, units that are kept, crop remarks.
TOKENS = ("aod", "pm", "precip", "temp", "humidity", "wind", "ch4", "no2", "o3", "so2", "co")
SUB_HEADERS = ("day", "night", "avg", "minimum", "maximum")
UNITS = ("ppbv", "ugm-3", "μgm-3", "mm/day", "mm")
REMARKS = ("for wheat", "for rice", "for maize", "for corn")
YEAR_NAMES = ("year", "years", "time", "date")
#: Fixed value: the name of a column that only holds another one's years and unit.
HELPER = r"^(.*)\s+years\s*\(([^)]+)\)$"


def width(spark: SparkSession, folder: str) -> int:
    """Cells of the longest line of all CSV files in a folder; quoted text, whose commas and line breaks don't count, aside."""
    whole = spark.read.text(folder, wholetext=True, pathGlobFilter="*.csv")
    lines = F.split(F.regexp_replace("value", '"[^"]*"', ""), r"\r\n|\n|\r")
    return whole.agg(F.max(F.array_max(F.transform(lines, lambda x: F.size(F.split(x, ",")))))).first()[0] or 1


def read_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of every headerless CSV in a folder; the file name without its ending is the sheet.

    A sheet is read whole by one task, which keeps its lines in order: sheets are small. It may
    have any number of columns."""
    names = [f"c{i}" for i in range(width(spark, folder))]
    lines = spark.read.csv(folder, schema=", ".join(f"{c} string" for c in names), header=False, multiLine=True, pathGlobFilter="*.csv", maxColumns=max(len(names), 20480))
    lines = lines.select("*", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.csv$", 1).alias("sheet"), F.monotonically_increasing_id().alias("_at"))
    lines = lines.withColumn("row", F.row_number().over(W.partitionBy("sheet").orderBy("_at")) - 1)
    return lines.select("sheet", "row", F.posexplode(F.array(*names)).alias("col", "value")).where("value is not null")


def header_scores(grid: DataFrame, scan: int = 30) -> DataFrame:
    """sheet, row, score of the first rows that have a time cell and a yield cell."""
    t, v = F.col("t"), F.col("value")
    cells = grid.where(F.col("row") < scan).where(~blank(v)).withColumn("t", cell(v))
    numeric = t.rlike(r"^-?\d+(\.\d+)?$")
    got = cells.groupBy("sheet", "row").agg(
        F.bool_or(t.startswith("time") | t.startswith("year")).alias("time"),
        F.bool_or(t.contains("yield")).alias("yield"),
        F.count("*").alias("filled"),
        F.count_if(numeric).alias("numbers"),
        *(F.max(t.contains(x).cast("int")).alias(f"_{x}") for x in TOKENS),
    )
    tokens = sum((F.col(f"_{x}") for x in TOKENS), F.lit(0))
    strings = F.col("filled") - F.col("numbers")
    score = 9.0 + 0.20 * F.col("filled") + 0.30 * strings - 3.5 * F.col("numbers") / F.col("filled") + 0.4 * tokens
    return got.where("time and yield").select("sheet", "row", score.alias("score"))


def header_rows(grid: DataFrame, scan: int = 30) -> DataFrame:
    """sheet, header_row: the best row, the first on ties, 0 where none qualifies."""
    best = header_scores(grid, scan).groupBy("sheet").agg(F.max_by("row", F.struct("score", -F.col("row"))).alias("best"))
    return grid.select("sheet").distinct().join(best, "sheet", "left").select("sheet", F.coalesce("best", F.lit(0)).alias("header_row"))


def merged_headers(grid: DataFrame, heads: DataFrame) -> DataFrame:
    """sheet, col, label: the header cell with its parent label and unit.

    The parent row lies two above the header and is filled forward across columns; the unit row one above."""
    at = grid.join(heads, "sheet").withColumn("above", F.col("header_row") - F.col("row")).where("above between 0 and 2")
    text = F.when(blank(F.col("value")), F.lit(None)).otherwise(F.trim(F.regexp_replace("value", r"\s+", " ")))
    pick = lambda k: F.max(F.when(F.col("above") == k, text))
    every = grid.select("sheet", "col").distinct()
    got = every.join(at.groupBy("sheet", "col").agg(pick(0).alias("own"), pick(1).alias("unit"), pick(2).alias("top")), ["sheet", "col"], "left")
    parent = F.last("top", ignorenulls=True).over(W.partitionBy("sheet").orderBy("col").rowsBetween(W.unboundedPreceding, 0))
    low = F.lower("own")
    label = (
        F.when(F.col("parent").isNotNull() & low.isin(*SUB_HEADERS), F.concat_ws(" ", "parent", "own"))
        .when(F.col("parent").isNotNull() & low.isin("year", "years"), F.concat_ws(" ", "parent", F.lit("years")))
        .otherwise(F.coalesce("own", "parent"))
    )
    unit = F.lower("unit")
    good = (unit.rlike("[a-zA-Zμ]") & unit.contains("/")) | unit.isin(*UNITS)
    add = F.col("unit").isNotNull() & ~unit.isin(*REMARKS) & good & ~F.contains(F.lower("label"), unit)
    return got.withColumn("parent", parent).withColumn("label", label).select(
        "sheet", "col", F.when(add, F.concat("label", F.lit(" ("), "unit", F.lit(")"))).otherwise(F.col("label")).alias("label")
    )


def canonical_text(label: Column) -> Column:
    """``canonical`` of labels, of which there is one a column of a sheet."""
    return F.pandas_udf(lambda s: s.map(canonical), "string")(label)


def columns(grid: DataFrame, heads: DataFrame) -> DataFrame:
    """sheet, col, at, name: the columns of each sheet that have any value below the header.

    Names are canonical, col_<position> where there is none. ``at`` is the first position of a name: columns of
    one name become one. A column ``X years (unit)`` gives its unit to the column after it, if that is
    called X..., and goes."""
    filled = grid.join(heads, "sheet").where(F.col("row") > F.col("header_row")).where(~blank(F.col("value"))).select("sheet", "col").distinct()
    name = canonical_text(F.coalesce("label", F.lit("")))
    own = merged_headers(grid, heads).join(filled, ["sheet", "col"], "left_semi").withColumn("name", name)
    own = own.withColumn("name", F.when(F.col("name") == "", F.concat(F.lit("col_"), "col")).otherwise(F.col("name")))
    own = own.withColumn("at", F.min("col").over(W.partitionBy("sheet", "name")))
    by = W.partitionBy("sheet").orderBy("at")
    base, unit = (F.regexp_extract("name", HELPER, k) for k in (1, 2))
    firsts = own.select("sheet", "name", "at").distinct().withColumns({"base": base, "unit": unit})
    before, given = F.lag("base").over(by), F.lag("unit").over(by)
    fits = (before != "") & F.startswith("name", before) & ~F.contains("name", F.concat(F.lit("("), given, F.lit(")")))
    called = firsts.withColumn("called", F.when(fits, F.concat("name", F.lit(" ("), given, F.lit(")"))).otherwise(F.col("name"))).where("base = ''")
    return own.select("sheet", "name", "col", "at").join(called.select("sheet", "at", "called"), ["sheet", "at"]).select("sheet", "col", "at", F.col("called").alias("name"))


def roles(values: DataFrame, heads: DataFrame) -> DataFrame:
    """sheet, at, name, role (year, yield, feature or null: dropped) from the merged values of all columns.

    The year is the first name with time or year in it, else the column with the most values of 1900 to 2100,
    if they are over 60 %; the yield the first other one with yield. Other year-like columns go, by name or by values."""
    size = (F.col("last") - F.col("header_row")).cast("double")
    in_range = F.count_if(F.col("x").between(1900, 2100))
    own = values.groupBy("sheet", "at", "name").agg(F.count("x").alias("known"), in_range.alias("years")).join(heads, "sheet")
    own = own.withColumns({"known": F.col("known") / size, "years": F.col("years") / size})
    every = W.partitionBy("sheet")
    by_name = F.min(F.when(F.contains("name", F.lit("time")) | F.contains("name", F.lit("year")), F.col("at"))).over(every)
    by_value = F.max(F.when(F.col("years") > 0.6, F.struct("years", (-F.col("at")).alias("at")))).over(every)
    own = own.withColumn("year_at", F.coalesce(by_name, -by_value["at"]))
    own = own.withColumn("yield_at", F.min(F.when(F.contains("name", F.lit("yield")) & ~F.col("at").eqNullSafe(F.col("year_at")), F.col("at"))).over(every))
    junk = F.col("name").isin(*YEAR_NAMES, "yield", "region", "crop") | F.col("name").rlike(r"^(19|20)\d\d$") | ((F.col("known") > 0.7) & (F.col("years") > 0.9))
    role = F.when(F.col("at") == F.col("year_at"), "year").when(F.col("at") == F.col("yield_at"), "yield").when(~junk, "feature")
    return own.select("sheet", "at", "name", role.alias("role"))


def build_panel(grid: DataFrame) -> DataFrame:
    """All sheets, cleaned and stacked: region, crop, year, yield and all features; a feature that a sheet lacks is null.

    One plan for all sheets: the number of jobs doesn't depend on how many there are. Only the features' names, and
    those of sheets without year or yield, reach the driver; such a sheet is an error."""
    with scratch(grid.sparkSession):
        grid = stored(grid.select("sheet", "row", "col", "value"), "grid")
        sizes = grid.groupBy("sheet").agg(F.max("row").alias("last"))
        heads = stored(header_rows(grid).join(sizes, "sheet"), "heads")
        body = grid.join(heads.select("sheet", "header_row"), "sheet").where(F.col("row") > F.col("header_row")).where(~blank(F.col("value")))
        placed = body.join(columns(grid, heads.select("sheet", "header_row")), ["sheet", "col"])
        merged = placed.groupBy("sheet", "row", "at", "name").agg(F.min_by("value", "col").alias("value"))  # the first known one of a name
        values = stored(merged.select("sheet", "row", "at", "name", number(F.col("value")).alias("x")), "values", keep=True)
        role = stored(roles(values, heads).coalesce(1), "roles", keep=True)
        has = lambda r: F.bool_or(F.col("role").eqNullSafe(F.lit(r))).alias(r)
        complete = heads.select("sheet").join(role.groupBy("sheet").agg(has("year"), has("yield")), "sheet", "left")
        bad = complete.where("not coalesce(year, false) or not coalesce(yield, false)").orderBy("sheet").limit(5).collect()
        for r in bad:
            raise ValueError(f"sheet {r.sheet}: no {'yield' if r.year else 'year'} column")
        names = [r.name for r in role.where("role = 'feature'").groupBy("name").agg(F.min(F.struct("sheet", "at")).alias("first")).orderBy("first").collect()]  # names
    of = F.when(F.col("role") == "feature", F.concat(F.lit("f:"), F.col("name"))).otherwise(F.col("role"))
    cells = values.join(role.where("role is not null").select("sheet", "at", of.alias("of")), ["sheet", "at"])
    wide = cells.groupBy("sheet", "row").pivot("of", ["year", "yield", *(f"f:{n}" for n in names)]).agg(F.first("x"))
    region, crop = sheet_identity(F.col("sheet"))
    known = wide.where(F.col("year").isNotNull() & F.col("yield").isNotNull())
    return known.select(region.alias("region"), crop.alias("crop"), F.col("year").cast("int").alias("year"), "yield", *(F.col(f"`f:{n}`").alias(n) for n in names))


def clean_sheet(grid: DataFrame, sheet: str) -> DataFrame:
    """region, crop, year, yield and numeric features of one sheet."""
    return build_panel(grid.where(F.col("sheet") == sheet))
