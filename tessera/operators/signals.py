"""Labels, information coefficients, ensembles and groups: what turns a signal into an evaluation."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.kernels import Kernels

#: Codes and valid pairs that a day's coefficient needs more of.
LEAST = 2


def label_columns(k: Kernels, fwd: int, clip: float = 0.01) -> dict[str, str]:
    """``label``: the return from the next day to ``fwd`` days on, clipped at two quantiles, as a z-score."""
    buy, sell = k.lead("close", 1), k.lead("close", fwd)
    r = k.hold(f"case when {buy} > 0 and {sell} > 0 then {sell} / {buy} - 1 end")
    low, high = k.quantiles(r, clip, 1 - clip)
    clipped = k.hold(f"case when {r} is not null then least(greatest({r}, {low}), {high}) end", "day")
    return {"label": k.cs_z_pop(clipped), "fwd_ret": r}


def labels(dense: DataFrame, fwd: int, clip: float = 0.01) -> DataFrame:
    k = Kernels()
    return k.apply(dense, label_columns(k, fwd, clip), ("key", "code", "day_idx"))


def ic_columns(k: Kernels, signal: str, fwd: int) -> dict[str, str]:
    """Per code of a day: what the coefficients of the day need. All three days must have the code."""
    buy, sell = k.lead("close", 1), k.lead("close", fwd)
    there = f"({k.lead('case when present then 1 end', 1)} = 1 and {k.lead('case when present then 1 end', fwd)} = 1)"
    r = k.hold(f"case when {there} and {buy} > 0 and {sell} > 0 then {sell} / {buy} - 1 end")
    return {"pred_signal": f"case when {r} is not null then {signal} end", "fwd_ret": f"case when {signal} is not null then {r} end", "common": there, "close_buy": buy, "close_sell": sell}


def ic_row_columns(k: Kernels, signal: str, fwd: int) -> dict[str, str]:
    """Per code what a coefficient was made of, at the day of selling."""
    own = ic_columns(k, signal, fwd)
    r = k.hold(own["fwd_ret"])
    return {"sell_key": k.lead("key", fwd), "close_buy": own["close_buy"], "close_sell": own["close_sell"], "fwd_ret": r, "cs_excess_fwd_ret": k.cs_z_pop(r), "pred_signal": own["pred_signal"], "common": own["common"]}


def ic_rows(dense: DataFrame, signal: str, fwd: int) -> DataFrame:
    k = Kernels()
    rows = k.apply(dense, ic_row_columns(k, signal, fwd), ("code",)).where("common").drop("common")
    return rows.withColumnRenamed("sell_key", "key")


def information_coefficients(dense: DataFrame, signal: str, fwd: int, prefixes: tuple[str, ...] = ()) -> DataFrame:
    """A row per signal day: Pearson and rank coefficients of the signal and the forward return.

    ``prefixes`` limits the universe by the beginning of the code; empty means all codes.
    """
    k = Kernels()
    pairs = k.apply(dense, ic_columns(k, signal, fwd), ("key", "code", "day_idx")).where("common")
    if prefixes:
        pairs = pairs.where(F.substring("code", 1, max(map(len, prefixes))).rlike("^(" + "|".join(p.replace(".", r"\.") for p in prefixes) + ")"))
    valid = pairs.where("pred_signal is not null and fwd_ret is not null")
    for c in ("pred_signal", "fwd_ret"):
        w = Window.partitionBy("key").orderBy(c)
        ties = F.count("*").over(w.rangeBetween(Window.currentRow, Window.currentRow))
        valid = valid.withColumn(f"_r_{c}", F.rank().over(w) + (ties - 1) / 2)
    n = F.count("*")
    skew, kurt = F.skewness("fwd_ret"), F.kurtosis("fwd_ret")
    x = n.cast("double")
    days = valid.groupBy("key", "day_idx").agg(
        n.alias("n"),
        _or_zero(correlation("pred_signal", "fwd_ret")).alias("pearson_ic"),
        _or_zero(correlation("_r_pred_signal", "_r_fwd_ret")).alias("rank_ic"),
        F.min("fwd_ret").alias("ret_min"),
        F.max("fwd_ret").alias("ret_max"),
        F.percentile("fwd_ret", F.lit(0.01)).alias("ret_p01"),
        F.percentile("fwd_ret", F.lit(0.99)).alias("ret_p99"),
        F.avg("fwd_ret").alias("ret_mean"),
        F.stddev_pop("fwd_ret").alias("ret_std"),
        F.when(n > 2, skew * F.sqrt(x * (x - 1)) / F.nullif(x - 2, F.lit(0.0))).alias("ret_skew"),
        F.when(n > 3, (x - 1) / F.nullif((x - 2) * (x - 3), F.lit(0.0)) * ((x + 1) * kurt + 6)).alias("ret_kurt"),
    )
    return days.where(f"n > {LEAST}")


def correlation(a: str, b: str) -> Column:
    """Pearson correlation, missing without spread (``corr`` raises there under ANSI rules)."""
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def _or_zero(x: Column) -> Column:
    return F.coalesce(F.when(~F.isnan(x), x), F.lit(0.0))


def ic_sql(source: str, signal: str, fwd: int) -> str:
    k = Kernels("duckdb")
    pairs = k.query(source, ic_columns(k, signal, fwd), ("key", "code", "day_idx"))
    rank = lambda c: f"rank() over (partition by key order by {c}) + (count(*) over (partition by key, {c}) - 1) / 2e0"
    return f"""with pairs as ({pairs}),
 valid as (select *, {rank('pred_signal')} as rp, {rank('fwd_ret')} as rr from pairs where common and pred_signal is not null and fwd_ret is not null),
 corrs as (select key, day_idx, count(*) as n,
  case when stddev_pop(pred_signal) > 0 and stddev_pop(fwd_ret) > 0 then corr(pred_signal, fwd_ret) else 0 end as pearson_ic,
  case when stddev_pop(rp) > 0 and stddev_pop(rr) > 0 then corr(rp, rr) else 0 end as rank_ic,
  min(fwd_ret) as ret_min, max(fwd_ret) as ret_max, quantile_cont(fwd_ret, 0.01::double) as ret_p01, quantile_cont(fwd_ret, 0.99::double) as ret_p99,
  avg(fwd_ret) as ret_mean, stddev_pop(fwd_ret) as ret_std, case when count(*) > 2 then skewness(fwd_ret) end as ret_skew, case when count(*) > 3 then kurtosis(fwd_ret) end as ret_kurt
  from valid group by key, day_idx)
 select * from corrs where n > {LEAST}"""


def spread_factor(num_groups: int, fwd: int) -> float:
    """What a unit of log excess adds to the log distance of the top and bottom groups' values."""
    normal = NormalDist()
    return 2 * num_groups * normal.pdf(normal.inv_cdf(1 / num_groups)) / (fwd - 1) if num_groups >= 2 else 0.0


def ic_history(days: DataFrame, num_groups: int, fwd: int) -> DataFrame:
    """Running sums over days, and the theoretical log distance of top and bottom. One row per day,
    so one window over all days; days are bounded by the calendar."""
    w = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    log_excess = F.sum(F.log(F.when(1 + F.col("pearson_ic") * F.col("ret_std") > 0, 1 + F.col("pearson_ic") * F.col("ret_std")))).over(w)
    return days.select(
        "key", "pearson_ic", "rank_ic",
        F.sum("pearson_ic").over(w).alias("cumsum_pearson_ic"), F.sum("rank_ic").over(w).alias("cumsum_rank_ic"),
        log_excess.alias("cumsum_vol_pearson_ic"), (log_excess * spread_factor(num_groups, fwd)).alias("theo_log_nav_spread"),
    )


def ic_summary(days: DataFrame, least: int = 10) -> DataFrame:
    """Mean, deviation, ratio, share of wins, skewness, sum and deepest fall of the running sum."""
    w = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    run = days.withColumn("_sum", F.sum("rank_ic").over(w)).withColumn("_peak", F.max("_sum").over(w))
    n = F.count("*").cast("double")
    out = run.agg(
        F.count("*").alias("n"),
        F.avg("rank_ic").alias("mean_ic"),
        F.stddev_pop("rank_ic").alias("std_ic"),
        F.coalesce(F.avg("rank_ic") / F.nullif(F.stddev_pop("rank_ic"), F.lit(0.0)), F.lit(0.0)).alias("icir"),
        F.avg((F.col("rank_ic") > 1e-12).cast("double")).alias("win_rate"),
        F.sum("rank_ic").alias("cumsum_ic"),
        (F.skewness("rank_ic") * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))).alias("ic_skew"),
        F.max(F.col("_peak") - F.col("_sum")).alias("max_drawdown"),
        F.avg("pearson_ic").alias("mean_pearson_ic"),
        F.coalesce(F.avg("pearson_ic") / F.nullif(F.stddev_pop("pearson_ic"), F.lit(0.0)), F.lit(0.0)).alias("pearson_icir"),
    )
    return out.where(f"n >= {least}")


def ensemble_columns(k: Kernels, signals: list[str]) -> dict[str, str]:
    """Mean of the signals that are there, as a z-score; no signals raise."""
    if not signals:
        raise ValueError("no signal columns")
    total = " + ".join(f"coalesce({s}, 0)" for s in signals)
    n = " + ".join(f"case when {s} is null then 0 else 1 end" for s in signals)
    return {"pred_signal": k.cs_z_pop(k.hold(f"({total}) / nullif({n}, 0)"))}


def groups(signal: DataFrame, num_groups: int) -> DataFrame:
    """(key, code, group_id, weight): group 0 has the lowest signals; ties share a group; a day with
    fewer codes than groups has none."""
    w = Window.partitionBy("key")
    ranked = signal.where("pred_signal is not null").withColumn("_n", F.count("*").over(w)).where(f"_n >= {num_groups}")
    share = (F.rank().over(w.orderBy("pred_signal")) - 1) / F.col("_n")
    ranked = ranked.withColumn("group_id", F.least(F.floor(share * num_groups), F.lit(num_groups - 1)).cast("int"))
    return ranked.withColumn("weight", 1.0 / F.count("*").over(Window.partitionBy("key", "group_id"))).select("key", "code", "pred_signal", "group_id", "weight")


def equal_weight_index(dense: DataFrame) -> DataFrame:
    """Value of an equal-weight basket: the running product of the mean daily ratio of closes."""
    k = Kernels()
    ratio = f"close / nullif({k.lag('close')}, 0)"
    daily = k.apply(dense, {"ratio": ratio}).groupBy("key").agg(F.avg("ratio").alias("ratio"))
    w = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    return daily.select("key", F.exp(F.sum(F.coalesce(F.log(F.when(F.col("ratio") > 0, F.col("ratio"))), F.lit(0.0))).over(w)).alias("nav"))


def robust_z_columns(k: Kernels, x: str, bound: float = 3.0) -> dict[str, str]:
    """(x - median) / median deviation, clipped; a deviation of 0 counts as 1."""
    mid = k.day(f"median({x}) over {k._D}")
    mad = k.day(f"median(abs({x} - {mid})) over {k._D}")
    z = f"(({x} - {mid}) / case when {mad} = 0 then 1e0 else {mad} end)"
    return {"robust_z": f"greatest(-{bound}e0, least({bound}e0, {z}))"}
