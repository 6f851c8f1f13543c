"""Panels: long tables with a row per (key, code), the calendar, and the dense grid.

``PANEL_SCHEMA`` is the logical schema. NULL means missing; NaN and infinities become NULL where
data comes in. The three ``panel_*`` functions derive panels from the TPC-H-like tables, and
``PANEL_SQL`` has the same derivations as SQL for another engine. Attributes are rounded to nine
decimals, so that sums in another order give equal values and equal ranks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Days up to which a calendar is kept as a small table: some 270 years.
MOST_DAYS = 100_000
#: Moves values off exact halves, which engines round in different ways.
OFF_HALF = 1.0000000000001
PRICES = ("open", "high", "low", "close", "close_uq", "vwap")
NUMBERS = (*PRICES, "turnover", "volume", "market_cap", "peTTM", "pbMRQ", "psTTM", "pcfNcfTTM")
PANEL_SCHEMA = T.StructType([
    T.StructField("key", T.DateType()),
    T.StructField("code", T.StringType()),
    T.StructField("stock_name", T.StringType()),
    *(T.StructField(c, T.DoubleType()) for c in NUMBERS),
    T.StructField("tradestatus", T.ByteType()),
    T.StructField("isST", T.ByteType()),
])


def finite(x: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def clean(panel: DataFrame) -> DataFrame:
    return panel.withColumns({f.name: finite(F.col(f.name)) for f in panel.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rounded(x: Column) -> Column:
    return F.round(x * OFF_HALF, 9)


def _market(lines: DataFrame) -> DataFrame:
    """Attributes of (key, code) groups of line items; ``u`` is the unit price."""
    u, q, e = F.col("u"), F.col("l_quantity"), F.col("l_extendedprice")
    close = F.percentile(u, F.lit(0.75))
    rows = lines.groupBy("key", "code").agg(
        _rounded(F.percentile(u, F.lit(0.25))).alias("open"),
        _rounded(F.max(u)).alias("high"),
        _rounded(F.min(u)).alias("low"),
        _rounded(close).alias("close"),
        _rounded(close * (1 - F.avg("l_discount") / 10)).alias("close_uq"),
        _rounded(F.sum(e) / F.sum(q)).alias("vwap"),
        _rounded(F.sum(q) / 10000).alias("turnover"),
        _rounded(F.sum(q)).alias("volume"),
        _rounded(F.sum(e * (1 - F.col("l_discount")))).alias("market_cap"),
        _rounded(10 + 100 * F.avg("l_tax")).alias("peTTM"),
        _rounded(1 + 10 * F.avg("l_discount")).alias("pbMRQ"),
        _rounded(1 + F.avg(q) / 10).alias("psTTM"),
        _rounded(5 + 100 * F.avg(F.col("l_tax") * F.col("l_discount"))).alias("pcfNcfTTM"),
    )
    return rows.withColumns({"stock_name": F.concat(F.lit("n "), "code"), "tradestatus": F.lit(1).cast("tinyint"), "isST": F.lit(0).cast("tinyint")}).select(*PANEL_SCHEMA.names)


def _week(ts: Column) -> Column:
    return F.date_trunc("week", ts).cast("date")


_LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def panel_brand_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks of shipping x part brands."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return _market(lines.select(_week(F.col("l_shipdate")).alias("key"), F.col("p_brand").alias("code"), *_LINE, (F.col("l_extendedprice") / F.col("l_quantity")).alias("u")))


def panel_supp_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks of shipping x suppliers; about a fifth of the cells are missing."""
    lines = table(spark, sf_dir, "lineitem")
    return _market(lines.select(_week(F.col("l_shipdate")).alias("key"), F.col("l_suppkey").cast("string").alias("code"), *_LINE, (F.col("l_extendedprice") / F.col("l_quantity")).alias("u")))


def panel_user_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days x users of the event stream: (key, code, close, volume)."""
    events = table(spark, sf_dir, "events").select(F.to_date("ts").alias("key"), F.col("user_id").cast("string").alias("code"), "value")
    return events.groupBy("key", "code").agg(_rounded(F.avg("value")).alias("close"), F.count("*").cast("double").alias("volume"))


def calendar(panel: DataFrame) -> DataFrame:
    """``(key, day_idx)``: the days of the panel, numbered from 0. As many rows as there are days."""
    days = panel.select("key").distinct()
    return days.select("key", (F.row_number().over(Window.orderBy("key")) - 1).alias("day_idx"))


def known_calendar(panel: DataFrame, most: int = MOST_DAYS) -> DataFrame | None:
    """The calendar read once and kept as a small table; None beyond ``most`` days.

    One scan of the key column with partial distincts, in place of one in every plan that numbers days.
    """
    keys = [r[0] for r in panel.select("key").where("key is not null").distinct().orderBy("key").limit(most + 1).collect()]
    if len(keys) > most:
        return None
    schema = T.StructType([T.StructField("key", panel.schema["key"].dataType), T.StructField("day_idx", T.IntegerType())])
    return panel.sparkSession.createDataFrame([(k, i) for i, k in enumerate(keys)], schema)


def densify(panel: DataFrame) -> DataFrame:
    """A row per code and day from the code's first day to its last; ``present`` marks real rows.

    Each row is exploded into itself and the absent days up to the code's next row, so there is no
    cross product and no join of a grid: one exchange by code, which the kernels over time use again.
    The calendar is broadcast where it was read (at most ``MOST_DAYS`` days), else joined.
    """
    days = known_calendar(panel)
    days = F.broadcast(days) if days is not None else calendar(panel)
    columns = [c for c in panel.columns if c not in ("key", "code")]
    order = Window.partitionBy("code").orderBy("_at")
    rows = panel.join(days.withColumnRenamed("day_idx", "_at"), "key").drop("key").withColumn("_next", F.lead("_at").over(order))
    until = F.greatest(F.coalesce(F.col("_next") - 1, F.col("_at")), F.col("_at"))
    rows = rows.withColumn("day_idx", F.explode(F.sequence("_at", until)))
    present = F.col("day_idx") == F.col("_at")
    rows = rows.select("code", "day_idx", present.alias("present"), *(F.when(present, F.col(c)).alias(c) for c in columns))
    return rows.join(days, "day_idx").select("code", "key", "day_idx", "present", *columns)


def with_lookback(panel: DataFrame, start, n_days: int) -> DataFrame:
    """Rows from ``n_days`` calendar rows before ``start`` on, so that windows at ``start`` are whole."""
    days = calendar(panel)
    first = days.where(F.col("key") >= F.lit(start)).agg(F.min("day_idx")).first()[0]
    if first is None:
        return panel.limit(0)
    low = days.where(F.col("day_idx") >= first - n_days).agg(F.min("key")).first()[0]
    return panel.where(F.col("key") >= F.lit(low))


# --- the same as SQL --------------------------------------------------------------------------


def _market_sql(code: str, source: str) -> str:
    u = "l_extendedprice / l_quantity"
    close = f"quantile_cont({u}, 0.75::double)"
    r = lambda x: f"round(({x}) * {OFF_HALF!r}e0, 9)"
    return f"""select cast(date_trunc('week', cast(l_shipdate as date)) as date) as key, {code} as code, 'n ' || {code} as stock_name,
 {r(f"quantile_cont({u}, 0.25::double)")} as open, {r(f"max({u})")} as high, {r(f"min({u})")} as low, {r(close)} as close,
 {r(f"{close} * (1 - avg(l_discount) / 10)")} as close_uq, {r("sum(l_extendedprice) / sum(l_quantity)")} as vwap, {r("sum(l_quantity) / 10000")} as turnover,
 {r("sum(l_quantity)")} as volume, {r("sum(l_extendedprice * (1 - l_discount))")} as market_cap, {r("10 + 100 * avg(l_tax)")} as peTTM,
 {r("1 + 10 * avg(l_discount)")} as pbMRQ, {r("1 + avg(l_quantity) / 10")} as psTTM, {r("5 + 100 * avg(l_tax * l_discount)")} as pcfNcfTTM,
 cast(1 as tinyint) as tradestatus, cast(0 as tinyint) as isST from {source} group by 1, 2"""


PANEL_SQL = {
    "brand_week": _market_sql("p_brand", "lineitem join part on l_partkey = p_partkey"),
    "supp_week": _market_sql("cast(l_suppkey as varchar)", "lineitem"),
    "user_day": "select cast(ts as date) as key, cast(user_id as varchar) as code, round(avg(value) * 1.0000000000001e0, 9) as close, cast(count(*) as double) as volume from events group by 1, 2",
}
PANELS = {"brand_week": panel_brand_week, "supp_week": panel_supp_week, "user_day": panel_user_day}


def dense_sql(panel_sql: str) -> str:
    """A query that gives the dense panel of ``panel_sql``."""
    return f"""select g.code, d.key, g.day_idx, p.code is not null as present, p.* exclude (key, code, day_idx) from
 (select code, unnest(generate_series(a, b)) as day_idx from (select code, min(day_idx) as a, max(day_idx) as b from ({panel_sql}) join ({_calendar_sql(panel_sql)}) using (key) group by code)) g
 join ({_calendar_sql(panel_sql)}) d on d.day_idx = g.day_idx
 left join (select * from ({panel_sql}) join ({_calendar_sql(panel_sql)}) using (key)) p on p.code = g.code and p.day_idx = g.day_idx"""


def _calendar_sql(panel_sql: str) -> str:
    return f"select key, row_number() over (order by key) - 1 as day_idx from (select distinct key from ({panel_sql}))"
