"""Registered queries of the panel engine, and the SQL that gives the same rows.

Most entries are kernel expressions over a dense panel; ``kernel`` registers one for both engines.
Values are rounded to ``DIGITS`` decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.kernels import Kernels
from tessera.operators import backtest, factors, models, optimizer, signals
from tessera.sources import panel as P
from tessera.sources import sinks, synthetic, vendor

DIGITS = 5
#: Trim of the z-scores: 1 % needs a hundred codes a day, brands are 25.
TRIM = 0.05
FWD, GROUPS = 5, 5

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


#: Engines round exact halves in different ways; this factor moves values off them first.
OFF_HALF = 1.00000000001


def rnd(x: str, digits: int = DIGITS) -> str:
    """Rounded text; ``+ 0e0`` turns -0 into 0."""
    return f"round(({x}) * {OFF_HALF!r}e0, {digits}) + 0e0"


def rounded(columns: dict[str, str], digits: int = DIGITS) -> dict[str, str]:
    return {c: rnd(x, digits) for c, x in columns.items()}


def round_col(c: str, digits: int = DIGITS):
    return (F.round(F.col(c) * OFF_HALF, digits) + 0.0).alias(c)


def round_frame(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    return df.select(*(round_col(c, digits) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def round_sql(sql: str, columns: str, doubles: str, digits: int = DIGITS) -> str:
    real = set(doubles.split())
    return "select " + ", ".join(f"{rnd(c, digits)} as {c}" if c in real else c for c in columns.split()) + f" from ({sql})"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def dense(spark: SparkSession, sf_dir: str, panel: str = "brand_week") -> DataFrame:
    return P.densify(P.PANELS[panel](spark, sf_dir))


def kernel(name: str, build: Callable[[Kernels], dict[str, str]], panel: str = "brand_week") -> None:
    """Register expressions over a panel."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        k = Kernels()
        return k.apply(dense(spark, sf_dir, panel), rounded(build(k)))

    k = Kernels("duckdb")
    query(name, k.query(P.dense_sql(P.PANEL_SQL[panel]), rounded(build(k))))(run)


# --- sources, calendar, grid -----------------------------------------------------------------

BRAND, SUPP, USER = (P.PANEL_SQL[n] for n in ("brand_week", "supp_week", "user_day"))
_ATTRIBUTES = "key code open high low close close_uq vwap turnover volume market_cap peTTM pbMRQ psTTM pcfNcfTTM"
_DOUBLES = " ".join(_ATTRIBUTES.split()[2:])


def _panel(name: str) -> None:
    sql = P.PANEL_SQL[name]
    if name == "user_day":
        query(f"panel_{name}", round_sql(sql, "key code close volume", "close volume"))(lambda s, d: round_frame(P.PANELS[name](s, d)))
    else:
        query(f"panel_{name}", round_sql(sql, _ATTRIBUTES, _DOUBLES))(lambda s, d: round_frame(P.PANELS[name](s, d).select(*_ATTRIBUTES.split())))


for _n in P.PANELS:
    _panel(_n)


@query("calendar", P._calendar_sql(SUPP))
def _(spark, sf_dir):
    return P.calendar(P.panel_supp_week(spark, sf_dir)).withColumn("day_idx", F.col("day_idx").cast("bigint"))


@query("dense_grid", f"select code, key, day_idx, present, {rnd('close')} as close from ({P.dense_sql(SUPP)})")
def _(spark, sf_dir):
    return round_frame(dense(spark, sf_dir, "supp_week").select("code", "key", F.col("day_idx").cast("bigint").alias("day_idx"), "present", "close"))


@query("scan_range", round_sql(f"select * from ({BRAND}) where key between date '1996-01-01' and date '1996-12-31'", "key code close volume", "close volume"))
def _(spark, sf_dir):
    return round_frame(P.panel_brand_week(spark, sf_dir).where("key between date'1996-01-01' and date'1996-12-31'").select("key", "code", "close", "volume"))


@query("scan_day", round_sql(f"select * from ({BRAND}) where key = (select max(key) from ({BRAND}) where key <= date '1997-06-30')", "key code close", "close"))
def _(spark, sf_dir):
    rows = P.panel_brand_week(spark, sf_dir)
    day = rows.where("key <= date'1997-06-30'").agg(F.max("key").alias("key"))
    return round_frame(rows.join(F.broadcast(day), "key").select("key", "code", "close"))


@query("range_check", f"select count(*) as n_rows, min(key) as first_day, max(key) as last_day, count(distinct code) as n_codes, count(distinct key) as n_days from ({SUPP})")
def _(spark, sf_dir):
    return P.panel_supp_week(spark, sf_dir).agg(F.count("*").alias("n_rows"), F.min("key").alias("first_day"), F.max("key").alias("last_day"), F.countDistinct("code").alias("n_codes"), F.countDistinct("key").alias("n_days"))


@query("lookback_scan", f"with c as ({P._calendar_sql(BRAND)}) select p.key, code, {rnd('volume')} as volume from ({BRAND}) p join c using (key) where day_idx >= (select min(day_idx) - 10 from c where key >= date '1997-01-01')")
def _(spark, sf_dir):
    import datetime as dt

    return round_frame(P.with_lookback(P.panel_brand_week(spark, sf_dir), dt.date(1997, 1, 1), 10).select("key", "code", "volume"))


@query("code_snapshot", f"select distinct code from ({BRAND}) where key = date '1996-07-01' and (starts_with(code, 'Brand#1') or starts_with(code, 'Brand#2')) order by code limit 8")
def _(spark, sf_dir):
    import datetime as dt

    return vendor.code_snapshot(P.panel_brand_week(spark, sf_dir), dt.date(1996, 7, 1), ("Brand#1", "Brand#2"), 8)


@query("stock_list", f"select code, min(key) as first_seen, max(key) as last_seen from ({SUPP}) group by code")
def _(spark, sf_dir):
    return vendor.stock_list(P.panel_supp_week(spark, sf_dir))


@query("missing_days", f"select code, key from ({P.dense_sql(SUPP)}) where not present")
def _(spark, sf_dir):
    rows = P.panel_supp_week(spark, sf_dir)
    return vendor.missing_days(rows, P.calendar(rows))


@query("completeness", f"with p as (select * from ({SUPP}) join ({P._calendar_sql(SUPP)}) using (key)) select code, count(*) as n_rows, max(day_idx) - min(day_idx) + 1 as n_days, count(*) >= max(day_idx) - min(day_idx) + 1 as complete from p group by code")
def _(spark, sf_dir):
    rows = P.panel_supp_week(spark, sf_dir)
    return vendor.complete(rows, P.calendar(rows)).withColumn("n_days", F.col("n_days").cast("bigint"))


@query("year_chunks", "select greatest(make_date(y::int, 1, 1), date '1994-03-05') as first_day, least(make_date(y::int, 12, 31), date '1997-02-10') as last_day from generate_series(1994, 1997) t(y)")
def _(spark, sf_dir):
    import datetime as dt

    return spark.createDataFrame(vendor.year_chunks(dt.date(1994, 3, 5), dt.date(1997, 2, 10)), "first_day date, last_day date")


_BARS = "select strftime(cast(l_shipdate as date), '%Y-%m-%d') as date, 'sh.60' || l_suppkey as code, cast(l_extendedprice as varchar) as close, case when l_linenumber = 1 then '' else cast(cast(l_quantity as bigint) as varchar) end as volume, case when l_returnflag = 'R' then 'n/a' else cast(l_tax as varchar) end as turn, cast(l_linenumber as varchar) as tradestatus from lineitem"


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = P.table(spark, sf_dir, "lineitem")
    return lines.select(
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"),
        F.concat(F.lit("sh.60"), F.col("l_suppkey").cast("string")).alias("code"),
        F.col("l_extendedprice").cast("string").alias("close"),
        F.when(F.col("l_linenumber") == 1, "").otherwise(F.col("l_quantity").cast("bigint").cast("string")).alias("volume"),
        F.when(F.col("l_returnflag") == "R", "n/a").otherwise(F.col("l_tax").cast("string")).alias("turn"),
        F.col("l_linenumber").cast("string").alias("tradestatus"),
    )


@query("convert_types", f"select code, count(*) as n, count(turn_) as n_turn, sum(volume_)::bigint as volume, round(sum(close_), 3) + 0e0 as close, sum(status_)::bigint as status from (select *, try_cast(turn as double) as turn_, coalesce(try_cast(volume as bigint), 0) as volume_, try_cast(close as double) as close_, coalesce(try_cast(tradestatus as tinyint), 0) as status_ from ({_BARS})) group by code")
def _(spark, sf_dir):
    rows = vendor.typed(_bars(spark, sf_dir)).groupBy("code")
    return rows.agg(F.count("*").alias("n"), F.count("turn").alias("n_turn"), F.sum("volume").alias("volume"), (F.round(F.sum("close"), 3) + 0.0).alias("close"), F.sum("tradestatus").cast("bigint").alias("status"))


_VENDOR = f"""select key, case when day_idx % 3 = 0 then 'sh.60' when day_idx % 3 = 1 then 'sz.30' else 'bj.80' end || code as code, close, close_uq, volume, volume * vwap as amount,
 case when code = '1' then 0e0 else turnover end as turn, (day_idx % 45) - 22e0 + 0.5e0 as pctChg, case when day_idx % 7 = 0 then 1 else 0 end as isST, 1 as tradestatus from ({P.dense_sql(SUPP)}) where present"""


@query(
    "vendor_derived",
    f"select key, code, {rnd('turn / 100', 9)} as turnover, {rnd('amount / nullif(volume, 0) * (close / nullif(close_uq, 0))', 4)} as vwap, {rnd('volume / nullif(turn / 100, 0) * close_uq', 1)} as market_cap, "
    "case when starts_with(code, 'sh.60') and abs(pctChg) >= case when isST = 1 then 4.9e0 else 9.9e0 end or starts_with(code, 'sz.30') and abs(pctChg) >= 19.9e0 then 0 else 1 end as trades "
    f"from ({_VENDOR})",
)
def _(spark, sf_dir):
    d = dense(spark, sf_dir, "supp_week").where("present")
    part = F.col("day_idx") % 3
    bars = d.select(
        "key", F.concat(F.when(part == 0, "sh.60").when(part == 1, "sz.30").otherwise("bj.80"), "code").alias("code"), "close", "close_uq", "volume", (F.col("volume") * F.col("vwap")).alias("amount"),
        F.when(F.col("code") == "1", 0.0).otherwise(F.col("turnover")).alias("turn"), (F.col("day_idx") % 45 - 22.0 + 0.5).alias("pctChg"), (F.col("day_idx") % 7 == 0).cast("int").alias("isST"), F.lit(1).alias("tradestatus"),
    )
    out = vendor.derived(bars)
    return out.select("key", "code", round_col("turnover", 9), round_col("vwap", 4), round_col("market_cap", 1), F.col("tradestatus").cast("int").alias("trades"))


_FILL = f"""with p as (select key, code, day_idx, close, volume, case when (day_idx + cast(code as bigint)) % 4 < 2 then 0 else 1 end as tradestatus from ({P.dense_sql(SUPP)}) where present),
 r as (select *, day_idx - row_number() over (partition by code order by day_idx) as run from p), f as (select *, row_number() over (partition by code, run order by day_idx) as pos from r)
 select key, code, {rnd('case when tradestatus = 0 then coalesce(last_value(case when tradestatus <> 0 or pos = 1 then close end ignore nulls) over (partition by code, run order by day_idx rows unbounded preceding), close) else close end')} as close from f"""


@query("suspended_fill", _FILL)
def _(spark, sf_dir):
    rows = dense(spark, sf_dir, "supp_week").where("present").withColumn("tradestatus", F.when((F.col("day_idx") + F.col("code").cast("bigint")) % 4 < 2, 0).otherwise(1))
    return round_frame(vendor.fill_suspended(rows, ("close", "volume")).select("key", "code", "close"))


@query("vendor_merge", "select a.date, a.code, a.n, b.close_uq from (select cast(l_shipdate as date) as date, l_suppkey as code, count(*) as n from lineitem group by 1, 2) a left join (select cast(o_orderdate as date) as date, o_custkey as code, max(o_totalprice) as close_uq from orders group by 1, 2) b using (date, code)")
def _(spark, sf_dir):
    a = P.table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("date"), F.col("l_suppkey").alias("code")).agg(F.count("*").alias("n"))
    b = P.table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date"), F.col("o_custkey").alias("code")).agg(F.max("o_totalprice").alias("close_uq"))
    return vendor.with_unadjusted(a, b)


@query("upsert", "select l_suppkey as code, l_shipdate::date as key, max(l_extendedprice) as close from lineitem where l_returnflag <> 'R' group by all having (l_suppkey, l_shipdate::date) not in (select (l_suppkey, l_shipdate::date) from lineitem where l_returnflag = 'R') union all select l_suppkey, l_shipdate::date, max(l_extendedprice) from lineitem where l_returnflag = 'R' group by all")
def _(spark, sf_dir):
    lines = P.table(spark, sf_dir, "lineitem")
    part = lambda c: lines.where(c).groupBy(F.col("l_suppkey").alias("code"), F.to_date("l_shipdate").alias("key")).agg(F.max("l_extendedprice").alias("close"))
    return vendor.upsert(part("l_returnflag <> 'R'"), part("l_returnflag = 'R'"))


# --- projection, filters, joins ------------------------------------------------------------------


def _panel_obj(spark: SparkSession, sf_dir: str, name: str = "brand_week"):
    from tessera.plans.frame import Panel

    return Panel(dense(spark, sf_dir, name), dense=True)


@query("select_columns", round_sql(BRAND, "key code stock_name close volume", "close volume"))
def _(spark, sf_dir):
    return round_frame(_panel_obj(spark, sf_dir).select(keep=["close", "volume"]).df.select("key", "code", "stock_name", "close", "volume"))


@query("last_frame", round_sql(f"select * from ({SUPP}) where key = (select max(key) from ({SUPP}))", "key code close", "close"))
def _(spark, sf_dir):
    return round_frame(_panel_obj(spark, sf_dir, "supp_week").last_frame().select("key", "code", "close"))


@query("first_frame", round_sql(f"select * from ({SUPP}) where key = (select min(key) from ({SUPP}))", "key code close", "close"))
def _(spark, sf_dir):
    return round_frame(_panel_obj(spark, sf_dir, "supp_week").first_frame().select("key", "code", "close"))


@query("ts_slice", round_sql(f"select * from ({SUPP}) where code = '7'", "key code close", "close"))
def _(spark, sf_dir):
    return round_frame(_panel_obj(spark, sf_dir, "supp_week").of_code("7").select("key", "code", "close"))


@query("cs_slice", round_sql(f"select * from ({BRAND}) where key = date '1996-07-01'", "key code close", "close"))
def _(spark, sf_dir):
    import datetime as dt

    return round_frame(_panel_obj(spark, sf_dir).at_key(dt.date(1996, 7, 1)).select("key", "code", "close"))


@query("filter_codes", round_sql(f"select * from ({BRAND}) where code in (select code from ({BRAND}) group by code having avg(close) > 2500)", "key code close", "close"))
def _(spark, sf_dir):
    p = _panel_obj(spark, sf_dir)
    return round_frame(p.filter_codes(p.df.groupBy("code").agg((F.avg("close") > 2500).alias("keep"))).df.select("key", "code", "close"))


@query("add_column", f"select p.key, p.code, {rnd('p.close')} as close, {rnd('q.twice')} as twice from ({BRAND}) p left join (select key, code, 2 * close as twice from ({BRAND}) where volume > 50) q on p.key = q.key and p.code = q.code")
def _(spark, sf_dir):
    p = _panel_obj(spark, sf_dir)
    return round_frame(p.add_column("twice", p.df.where("volume > 50").select("key", "code", (2 * F.col("close")).alias("twice"))).df.select("key", "code", "close", "twice"))


@query("prefix_filter", f"select distinct code from ({BRAND}) where starts_with(code, 'Brand#1') or starts_with(code, 'Brand#3')")
def _(spark, sf_dir):
    return P.panel_brand_week(spark, sf_dir).where(vendor.starts(F.col("code"), ("Brand#1", "Brand#3"))).select("code").distinct()


@query("common_days", f"select key, count(*) as n from ({BRAND}) where key in (select key from ({SUPP}) where code = '3') group by key")
def _(spark, sf_dir):
    from tessera.plans.dag import inner_on_day

    a, _b = inner_on_day([P.panel_brand_week(spark, sf_dir), P.panel_supp_week(spark, sf_dir).where("code = '3'")], "key")
    return a.groupBy("key").agg(F.count("*").alias("n"))


@query("merge_frames", round_sql(f"select p.key, p.code, p.close, q.half from ({BRAND}) p join (select key, code, volume / 2 as half from ({BRAND})) q on p.key = q.key and p.code = q.code", "key code close half", "close half"))
def _(spark, sf_dir):
    from tessera.plans.dag import merged

    rows = P.panel_brand_week(spark, sf_dir)
    return round_frame(merged([rows.select("key", "code", "close"), rows.select("key", "code", (F.col("volume") / 2).alias("half"))]))


def _window_sql(edge: int) -> str:
    return f"""with c as ({P._calendar_sql(SUPP)}), p as (select * from ({SUPP}) join c using (key))
 select u.code, c.key, c.day_idx, {rnd('p.close')} as close from (select code from p where day_idx = {edge}) u join c on c.day_idx between 91 and 100
 left join p on p.code = u.code and p.day_idx = c.day_idx"""


for _align, _edge in (("right", 100), ("left", 91)):

    @query(f"window_universe_{_align}", _window_sql(_edge))
    def _(spark, sf_dir, align=_align):
        from tessera.plans.frame import as_of_window

        return round_frame(as_of_window(P.panel_supp_week(spark, sf_dir), 100, 10, align).select("code", "key", F.col("day_idx").cast("bigint").alias("day_idx"), "close"))


@query("training_rows", f"""select key, code, missing from (select key, code, (case when r1 is null then 1 else 0 end) + (case when r20 is null then 1 else 0 end) + (case when r60 is null then 1 else 0 end) as missing, label from
 (select *, lead(close, 5) over w as label, close / nullif(lag(close, 1) over w, 0) as r1, close / nullif(lag(close, 20) over w, 0) as r20, close / nullif(lag(close, 60) over w, 0) as r60 from ({P.dense_sql(SUPP)}) window w as (partition by code order by day_idx)) where present) where label is not null and missing <= 1.5""")
def _(spark, sf_dir):
    k = Kernels()
    cols = {f"r{n}": f"close / nullif({k.lag('close', n)}, 0)" for n in (1, 20, 60)} | {"label": k.lead("close", 5)}
    rows = k.apply(dense(spark, sf_dir, "supp_week"), cols)
    feats = ["r1", "r20", "r60"]
    return rows.where(models.usable(feats)).select("key", "code", sum((F.col(c).isNull().cast("int") for c in feats), F.lit(0)).alias("missing"))


@query("plan_sets", f"""with a as (select distinct code from ({SUPP}) where key = (select min(key) from ({SUPP}) where key >= date '1996-01-01')), b as (select distinct code from ({SUPP}) where key = (select min(key) from ({SUPP}) where key >= date '1996-02-01'))
 select code, 'close' as kind from a where code not in (select code from b) union all select code, 'adjust' from a where code in (select code from b) union all select code, 'open' from b where code not in (select code from a)""")
def _(spark, sf_dir):
    rows = P.panel_supp_week(spark, sf_dir).select("key", "code")
    on = lambda day: rows.join(F.broadcast(rows.where(f"key >= date'{day}'").agg(F.min("key").alias("key"))), "key").select("code").distinct()
    a, b = on("1996-01-01"), on("1996-02-01")
    kind = lambda df, name: df.select("code", F.lit(name).alias("kind"))
    return kind(a.join(b, "code", "left_anti"), "close").unionByName(kind(a.join(b, "code", "left_semi"), "adjust")).unionByName(kind(b.join(a, "code", "left_anti"), "open"))


# --- operators over a day ------------------------------------------------------------------------

kernel("cs_zscore", lambda k: {"z": k.cs_z("close"), "z_volume": k.cs_z("volume")}, "supp_week")
kernel("cs_zscore_trimmed", lambda k: {f"z_{c}": k.cs_z_trimmed(c, TRIM) for c in ("close", "volume", "market_cap")})
kernel("cs_rank", lambda k: {"r_volume": k.cs_rank("volume"), "r_pct": k.cs_rank(k.hold(k.pct("close")))}, "supp_week")
kernel("cs_demean", lambda k: {"x": k.cs_demean("close")})
kernel("cs_neutralize", lambda k: {"x": k.cs_residual("close", "market_cap"), "y": k.cs_residual(k.hold(k.pct("close", 5)), "volume")})
kernel("cs_zscore_population", lambda k: {"z": k.cs_z_pop("close"), "z_pct": k.cs_z_pop(k.hold(k.pct("close")))})
kernel("cs_robust_z", lambda k: signals.robust_z_columns(k, "close"))
kernel("label", lambda k: signals.label_columns(k, FWD, 0.05))
kernel("ensemble", lambda k: signals.ensemble_columns(k, [k.cs_z(k.hold(k.pct("close", 5))), k.cs_z("volume"), k.hold(f"case when {k.pct('close')} > 0 then {k.pct('close')} end")]))

# --- operators over time -------------------------------------------------------------------------

kernel("ts_delay", lambda k: {"x1": k.lag("close"), "x5": k.lag("close", 5)}, "supp_week")
kernel("ts_delta", lambda k: {"x": f"close - {k.lag('close', 3)}"}, "supp_week")
kernel("ts_pct_change", lambda k: {f"x{p}": k.pct("close", p) for p in (1, 5, 20)}, "supp_week")
kernel("ts_rolling", lambda k: {f"{n}_{w}": k.expanding("close", w, fn) for n, fn in (("mean", "avg"), ("std", "stddev_samp"), ("low", "min"), ("high", "max"), ("total", "sum")) for w in (5, 20)}, "supp_week")
kernel("ts_rolling_moments", lambda k: {"skew": k.moment("close", 20, "skew"), "kurt": k.moment("close", 20, "kurt")})
kernel("ts_zscore", lambda k: {"z": f"(close - {k.expanding('close', 10, 'avg')}) / nullif({k.expanding('close', 10, 'stddev_samp')}, 0)"})
kernel("ts_rank", lambda k: {"r": k.ts_rank("close", 20)}, "supp_week")
kernel("roll_mean", lambda k: {f"x{w}": k.mean("close", w) for w in (5, 20, 60)}, "supp_week")
kernel("roll_std", lambda k: {f"x{w}": k.std("close", w) for w in (5, 20, 60)}, "supp_week")
kernel("roll_sum", lambda k: {f"x{w}": k.sum("volume", w) for w in (5, 20)}, "supp_week")
kernel("roll_min_max", lambda k: {"low": k.min("close", 20), "high": k.max("close", 20)}, "supp_week")
kernel("roll_ewm", lambda k: {"e12": k.ewm("close", 12), "e26": k.ewm("close", 26)}, "supp_week")
kernel("roll_macd", lambda k: dict(zip(("macd", "signal"), k.macd("close"))), "supp_week")
kernel("roll_autocorr", lambda k: {"a20": k.autocorr(k.hold(k.pct("close")), 20)}, "supp_week")
kernel("roll_moments", lambda k: dict(zip(("kurt", "skew"), k.moments(k.hold(k.pct("close")), 60))))
kernel("roll_tail_risk", lambda k: {"t20": k.tail_risk(k.hold(k.pct("close")), 20)})
kernel("roll_drawdown_duration", lambda k: {"d20": k.since_peak("close", 20)}, "supp_week")
kernel("roll_sign_changes", lambda k: {"f20": k.flips(f"{k.hold(k.pct('close'))} > 0", 20)}, "supp_week")
kernel("roll_rank_pct", lambda k: {"r20": k.rank_pct("close", 20, 19), "r60": k.rank_pct("volume", 60, 59)}, "supp_week")
kernel("roll_streaks", lambda k: {"up": k.streak(f"{k.hold(k.pct('close'))} > 0"), "down": k.streak(f"{k.hold(k.pct('close'))} < 0")}, "supp_week")
kernel("roll_new_highs", lambda k: {"high": k.new_highs("close", 20), "low": k.new_highs("(-close)", 20)}, "supp_week")
kernel("roll_run_share", lambda k: {"x": k.share(f"({k.hold(k.pct('close'))} > 0 and {k.lag(k.hold(k.pct('close')))} > 0)", 20)}, "supp_week")
kernel("roll_growth", lambda k: {"g20": k.growth(k.hold(k.pct("close")), 20)}, "supp_week")
kernel("roll_drawdown", lambda k: {"d20": k.drawdown("close", 20)}, "supp_week")
kernel("roll_first_run", lambda k: {"x": k.first_run(f"{k.hold(k.pct('close'))} > 0", 20)}, "supp_week")
kernel("roll_up_down", lambda k: {"x": k.up_down(k.hold(k.pct("close")), 20)}, "supp_week")


def yang_zhang(k: Kernels, span: int = 20, least: int = 10) -> dict[str, str]:
    """Yang-Zhang volatility from overnight and Rogers-Satchell variances, exponentially weighted."""
    ln = lambda a, b: f"ln(case when {a} > 0 and {b} > 0 then {a} / {b} end)"
    night = k.hold(ln("open", k.lag("close")))
    rs = k.hold(f"{ln('high', 'close')} * {ln('high', 'open')} + {ln('low', 'close')} * {ln('low', 'open')}")
    weight = 0.34 / (1.34 + (span + 1) / (span - 1))
    return {"yz": f"sqrt(abs({weight!r} * {k.ewm_adjusted(f'({night} * {night})', span, least, 130)} + {k.ewm_adjusted(rs, span, least, 130)}))"}


kernel("yang_zhang_volatility", yang_zhang)

# --- factor modules ------------------------------------------------------------------------------


def _factor(name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return factors.emitted(dense(spark, sf_dir), name, TRIM, DIGITS)

    query(f"factor_{name}", factors.emitted_sql(P.dense_sql(BRAND), name, TRIM, DIGITS))(run)


for _n in factors.MODULES:
    _factor(_n)


@query("cs_rank_delta_exact", f"""with d as (select * from ({P.dense_sql(SUPP)}) where code <> ''), cur as (select key, code, day_idx, close from d where present),
 past as (select c.key, c.code, c.day_idx, c.close, q.close as before from cur c left join d q on q.code = c.code and q.day_idx = c.day_idx - 5 and q.present),
 r as (select *, count(*) over (partition by key) as n, rank() over (partition by key order by close nulls last) + (count(*) over (partition by key, close) - 1) / 2e0 as a, rank() over (partition by key order by before nulls last) + (count(*) over (partition by key, before) - 1) / 2e0 as b from past)
 select key, code, {rnd('case when n <= 1 then 0.5e0 else (a - 1) / (n - 1) end - case when before is null then null when n <= 1 then 0.5e0 else (b - 1) / (n - 1) end')} as delta from r where day_idx >= 5""")
def _(spark, sf_dir):
    return round_frame(rank_delta_exact(dense(spark, sf_dir, "supp_week"), "close", 5))


def rank_delta_exact(d: DataFrame, col: str, lag: int) -> DataFrame:
    """Change of the rank over ``lag`` days where the past day is ranked among the codes of today."""
    now = d.where("present").select("key", "code", "day_idx", col)
    past = now.select("code", (F.col("day_idx") + lag).alias("day_idx"), F.col(col).alias("before"))
    both = now.join(past, ["code", "day_idx"], "left").withColumn("present", F.lit(True)).where(F.col("day_idx") >= lag)
    k = Kernels()
    return k.apply(both, {"delta": f"{k.cs_rank(col)} - {k.cs_rank('before')}"})


# --- evaluation ----------------------------------------------------------------------------------

_SIGNAL = "volume"
IC_SQL = signals.ic_sql(P.dense_sql(BRAND), _SIGNAL, FWD)
_IC = "key day_idx n pearson_ic rank_ic ret_min ret_max ret_p01 ret_p99 ret_mean ret_std ret_skew ret_kurt"


def _ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.information_coefficients(dense(spark, sf_dir), _SIGNAL, FWD)


@query("ic_daily", round_sql(IC_SQL, _IC, " ".join(_IC.split()[3:])))
def _(spark, sf_dir):
    return round_frame(_ic(spark, sf_dir).withColumn("day_idx", F.col("day_idx").cast("bigint")))


def _ic_rows_sql() -> str:
    k = Kernels("duckdb")
    rows = k.query(P.dense_sql(BRAND), signals.ic_row_columns(k, _SIGNAL, FWD), ("code",))
    return round_sql(f"select *, sell_key as key from ({rows}) where common", "key code close_buy close_sell fwd_ret cs_excess_fwd_ret pred_signal", "close_buy close_sell fwd_ret cs_excess_fwd_ret pred_signal")


@query("ic_rows", _ic_rows_sql())
def _(spark, sf_dir):
    return round_frame(signals.ic_rows(dense(spark, sf_dir), _SIGNAL, FWD))


@query("ic_prefix", round_sql(signals.ic_sql(P.dense_sql(f"select * from ({BRAND}) where starts_with(code, 'Brand#1') or starts_with(code, 'Brand#2')"), _SIGNAL, FWD), "key n pearson_ic rank_ic", "pearson_ic rank_ic"))
def _(spark, sf_dir):
    return round_frame(signals.information_coefficients(dense(spark, sf_dir), _SIGNAL, FWD, ("Brand#1", "Brand#2")).select("key", "n", "pearson_ic", "rank_ic"))


@query("ic_history", f"""with d as ({IC_SQL}), h as (select key, pearson_ic, rank_ic, sum(pearson_ic) over w as cumsum_pearson_ic, sum(rank_ic) over w as cumsum_rank_ic, sum(ln(case when 1 + pearson_ic * ret_std > 0 then 1 + pearson_ic * ret_std end)) over w as v from d window w as (order by key rows unbounded preceding))
 select key, {rnd('cumsum_pearson_ic')} as cumsum_pearson_ic, {rnd('cumsum_rank_ic')} as cumsum_rank_ic, {rnd('v')} as cumsum_vol_pearson_ic, {rnd(f'v * {signals.spread_factor(GROUPS, FWD)!r}')} as theo_log_nav_spread from h""")
def _(spark, sf_dir):
    return round_frame(signals.ic_history(_ic(spark, sf_dir), GROUPS, FWD).drop("pearson_ic", "rank_ic"))


@query("ic_summary", f"""with d as ({IC_SQL}), h as (select *, sum(rank_ic) over (order by key rows unbounded preceding) as s from d), g as (select *, max(s) over (order by key rows unbounded preceding) as peak from h)
 select count(*) as n, {rnd('avg(rank_ic)')} as mean_ic, {rnd('stddev_pop(rank_ic)')} as std_ic, {rnd('coalesce(avg(rank_ic) / nullif(stddev_pop(rank_ic), 0), 0)')} as icir, {rnd('avg(case when rank_ic > 1e-12 then 1e0 else 0e0 end)')} as win_rate,
 {rnd('sum(rank_ic)')} as cumsum_ic, {rnd('skewness(rank_ic)')} as ic_skew, {rnd('max(peak - s)')} as max_drawdown, {rnd('avg(pearson_ic)')} as mean_pearson_ic, {rnd('coalesce(avg(pearson_ic) / nullif(stddev_pop(pearson_ic), 0), 0)')} as pearson_icir from g having count(*) >= 10""")
def _(spark, sf_dir):
    return round_frame(signals.ic_summary(_ic(spark, sf_dir)))


@query("signal_groups", f"""with p as (select key, code, volume as pred_signal, count(*) over (partition by key) as n, rank() over (partition by key order by volume) as r from ({BRAND})),
 g as (select *, least(cast(floor((r - 1) / n::double * {GROUPS}) as int), {GROUPS - 1}) as group_id from p where n >= {GROUPS})
 select key, code, {rnd('pred_signal')} as pred_signal, group_id, {rnd('1e0 / count(*) over (partition by key, group_id)')} as weight from g""")
def _(spark, sf_dir):
    return round_frame(signals.groups(P.panel_brand_week(spark, sf_dir).select("key", "code", F.col("volume").alias("pred_signal")), GROUPS))


@query("equal_weight_index", f"with r as (select key, code, day_idx, present, close / nullif(lag(close) over (partition by code order by day_idx), 0) as ratio from ({P.dense_sql(BRAND)})), m as (select key, avg(ratio) as ratio from r where present group by key) select key, {rnd('sum(coalesce(ln(case when ratio > 0 then ratio end), 0)) over (order by key rows unbounded preceding)')} as log_nav from m")
def _(spark, sf_dir):
    return round_frame(signals.equal_weight_index(dense(spark, sf_dir)).select("key", F.log("nav").alias("log_nav")))


@query("universe_counts", f"select key, count(distinct code) as n_codes from ({SUPP}) group by key")
def _(spark, sf_dir):
    return P.panel_supp_week(spark, sf_dir).groupBy("key").agg(F.countDistinct("code").alias("n_codes"))


@query("long_metrics", f"with d as ({IC_SQL}) select 'r1' as run, 'ic' as node, day_idx as step, 'pearson_ic' as metric, {rnd('pearson_ic')} as value from d union all select 'r1', 'ic', day_idx, 'rank_ic', {rnd('rank_ic')} from d")
def _(spark, sf_dir):
    return round_frame(sinks.long_metrics(_ic(spark, sf_dir), "r1", "ic", "day_idx", ["pearson_ic", "rank_ic"]))


# --- models --------------------------------------------------------------------------------------

_FEATURES = ["x1", "x2"]


def _feature_columns(k: Kernels) -> dict[str, str]:
    return {"x1": k.cs_z("volume"), "x2": k.cs_z(k.hold(k.pct("close", 5)))} | signals.label_columns(k, FWD, 0.05)


def _training(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = Kernels()
    return k.apply(dense(spark, sf_dir), _feature_columns(k), ("key", "code", "day_idx"))


def _ridge_sql() -> str:
    k = Kernels("duckdb")
    rows = k.query(P.dense_sql(BRAND), _feature_columns(k), ("key", "code", "day_idx"))
    a = models.RIDGE_ALPHA
    return f"""with t as (select * from ({rows}) where label is not null),
 m as (select count(*) as n, covar_pop(x1, x1) * count(*) + {a}e0 as a, covar_pop(x1, x2) * count(*) as b, covar_pop(x2, x2) * count(*) + {a}e0 as c, covar_pop(x1, label) * count(*) as u, covar_pop(x2, label) * count(*) as v, avg(x1) as m1, avg(x2) as m2, avg(label) as my from t),
 w as (select *, (c * u - b * v) / (a * c - b * b) as w1, (a * v - b * u) / (a * c - b * b) as w2 from m)
 select {rnd('w1', 6)} as w1, {rnd('w2', 6)} as w2, {rnd('my - m1 * w1 - m2 * w2', 6)} as intercept from w"""


@query("model_ridge", _ridge_sql())
def _(spark, sf_dir):
    rows = _training(spark, sf_dir)
    model = models.ridge(models.filled(rows.where(models.usable(_FEATURES)), _FEATURES), _FEATURES)
    return round_frame(spark.createDataFrame([(*map(float, model.weights), model.intercept)], "w1 double, w2 double, intercept double"), 6)


def _gram_sql(source: str, by: str) -> str:
    """Weights of the two features over ``source``, a row for each value of ``by``."""
    a = models.RIDGE_ALPHA
    return f"""(select {by}, (c * u - b * v) / (a * c - b * b) as w1, (a * v - b * u) / (a * c - b * b) as w2, my - m1 * (c * u - b * v) / (a * c - b * b) - m2 * (a * v - b * u) / (a * c - b * b) as b0 from (
 select {by}, count(*) as n, covar_pop(x1, x1) * count(*) + {a}e0 as a, covar_pop(x1, x2) * count(*) as b, covar_pop(x2, x2) * count(*) + {a}e0 as c, covar_pop(x1, label) * count(*) as u, covar_pop(x2, label) * count(*) as v, avg(x1) as m1, avg(x2) as m2, avg(label) as my
 from {source} where label is not null group by {by}) where n >= {models.LEAST_ROWS})"""


def _rows_sql() -> str:
    k = Kernels("duckdb")
    return k.query(P.dense_sql(BRAND), _feature_columns(k), ("key", "code", "day_idx"))


def _rolling_sql(every: int, window: int = 60) -> str:
    train = f"t join d on day_idx between since - {window + FWD} and since - {FWD + 1}"
    return f"""with t as ({_rows_sql()}),
 d as (select unnest(range({window + FWD}, (select max(day_idx) + 1 from t), {every})) as since),
 w as {_gram_sql(train, "since")},
 p as (select key, code, coalesce(b0 + w1 * x1 + w2 * x2, 0e0) as p from t join d on day_idx between since and since + {every - 1} left join w using (since)),
 z as (select *, avg(p) over (partition by key) as mu, stddev_pop(p) over (partition by key) as sd from p)
 select key, code, {rnd('case when sd = 0 then 0e0 else (p - mu) / sd end', 4)} as pred_signal from z"""


def _folds_sql(folds: int = 3) -> str:
    mean_rank = lambda x: f"rank() over (partition by fold, key order by {x}) + (count(*) over (partition by fold, key, {x}) - 1) / 2e0"
    return f"""with t as (select * from ({_rows_sql()}) where label is not null),
 s as (select n // {folds + 1} as size, n - (n // {folds + 1}) * {folds + 1} as rest from (select count(distinct key) as n from ({BRAND}))),
 d as (select fold, size * (fold + 1) + rest as a, size from s, (select unnest(range({folds})) as fold)),
 w as {_gram_sql("t join d on day_idx < a", "fold")},
 p as (select fold, key, b0 + w1 * x1 + w2 * x2 as p, label from t join d on day_idx between a and a + size - 1 join w using (fold)),
 r as (select fold, key, {mean_rank('p')} as x, {mean_rank('label')} as y from p),
 c as (select fold, key, count(*) as n, case when count(*) > 1 and stddev_pop(x) > 0 and stddev_pop(y) > 0 then corr(x, y) else 0e0 end as ic from r group by fold, key)
 select cast(fold as int) as fold, cast(sum(n) as bigint) as n, {rnd('avg(ic)')} as rank_ic from c group by fold having sum(n) >= 10"""


def _rolling(spark: SparkSession, sf_dir: str, model: str, every: int, **kw) -> DataFrame:
    n_days = P.calendar(P.panel_brand_week(spark, sf_dir)).count()
    out = models.rolling_predictions(_training(spark, sf_dir), _FEATURES, n_days, model, model_window=60, fwd=FWD, retrain_every=every, **kw)
    return round_frame(models.standardised(out).drop("day_idx"), 4)


@query("model_rolling_ridge", _rolling_sql(40))
def _(spark, sf_dir):
    return _rolling(spark, sf_dir, "ridge", 40)


@query("model_rolling_trees")
def _(spark, sf_dir):
    return _rolling(spark, sf_dir, "gbt", 150, trees=5, depth=3)


@query("model_rolling_network")
def _(spark, sf_dir):
    return _rolling(spark, sf_dir, "mlp", 150, epochs=3)


@query("model_cross_validation", _folds_sql())
def _(spark, sf_dir):
    return round_frame(models.cross_validation(_training(spark, sf_dir), _FEATURES, P.calendar(P.panel_brand_week(spark, sf_dir)).count()))


@query("model_importance_top", f"""with w as {_gram_sql(f"(select 0 as one, * from ({_rows_sql()}))", "one")},
 i as (select 'x1' as feature, abs(w1) as size from w union all select 'x2', abs(w2) from w)
 select feature, (size - (select min(size) from i)) / ((select max(size) from i) - (select min(size) from i)) as importance from i""")
def _(spark, sf_dir):
    rows = _training(spark, sf_dir)
    model = models.ridge(models.filled(rows.where(models.usable(_FEATURES)), _FEATURES), _FEATURES)
    scaled = models.scaled_importance(model.importance())
    return spark.createDataFrame([(c, float(v)) for c, v in scaled.items()], "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(10)


# --- back-test, optimizer, generator, stream ---------------------------------------------------------


def _backtest(spark: SparkSession, sf_dir: str):
    rows = dense(spark, sf_dir).where("present")
    grouped = signals.groups(rows.select("key", "code", F.col("volume").alias("pred_signal")), GROUPS)
    return rows, grouped, GROUPS, backtest.Rules(fwd=FWD, cash=1e7)


@query("backtest_nav")
def _(spark, sf_dir):
    return backtest.backtest(*_backtest(spark, sf_dir))


@query("backtest_trades")
def _(spark, sf_dir):
    return backtest.trade_log(*_backtest(spark, sf_dir))


@query("backtest_summary")
def _(spark, sf_dir):
    return backtest.summary(backtest.backtest(*_backtest(spark, sf_dir)))


@query("optimizer_weights")
def _(spark, sf_dir):
    k = Kernels()
    rows = k.apply(dense(spark, sf_dir), {"pred_signal": k.cs_z("volume"), "ret": f"coalesce({k.pct('close')}, 0e0)"})
    return round_frame(optimizer.allocate_path(rows), 4)


@query("synthetic_panel")
def _(spark, sf_dir):
    return synthetic.synthetic_panel(spark, n_times=60, n_stocks=8)


def _small_market(spark: SparkSession):
    from tessera.plans.dag import PipelineConfig
    from tessera.plans.research import market_panel

    config = PipelineConfig(n_times=150, n_stocks=8, fwd=2, model_window=10, retrain_every=10, num_groups=2, initial_cash=1e6)
    return market_panel(spark, config), config


@query("research_ic")
def _(spark, sf_dir):
    from tessera.plans.research import research

    return research(*_small_market(spark), modules=("momentum", "trend_cs", "counting")).ic


@query("research_nav")
def _(spark, sf_dir):
    from tessera.plans.research import research

    return research(*_small_market(spark), modules=("momentum", "trend_cs", "counting")).nav


@query("precision_study")
def _(spark, sf_dir):
    from tessera.plans.research import precision_study

    return precision_study(dense(spark, sf_dir), FWD)


@query("noise_sweep")
def _(spark, sf_dir):
    from tessera.plans.research import noise_sweep

    return noise_sweep(spark, _small_market(spark)[1], (0.0, 1.0, 4.0))


@query("stream_row_window", f"""with w as (select code, key, close, count(*) over r as n_rows, avg(close) over r as mean, lag(close) over (partition by code order by key) as before from ({USER}) window r as (partition by code order by key rows between 4 preceding and current row))
 select code, key, cast(n_rows as int) as n_rows, {rnd('mean')} as mean, {rnd('case when before is null or before = 0 then null else (close - before) / before end')} as change from w""")
def _(spark, sf_dir):
    import shutil
    import tempfile
    import uuid

    from tessera.streaming.rows import replay, row_window

    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = f"{shared}/stream-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="tessera-stream-")
    rows = P.panel_user_day(spark, sf_dir).select("key", "code", "close")
    # a file per ten days, in order: a micro-batch each
    days = P.calendar(rows)
    parts = max(1, -(-days.count() // 10))
    rows = rows.join(days, "key")
    for i in range(parts):
        rows.where(F.col("day_idx").between(10 * i, 10 * i + 9)).drop("day_idx").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    out = replay(spark, f"{folder}/in", "key date, code string, close double", partial(row_window, rows=5), f"{folder}/out", f"{folder}/state")
    if not shared:
        import atexit

        atexit.register(shutil.rmtree, folder, True)
    return round_frame(out)
