"""The indicator library over daily bars, one query per indicator, and the whole library in one plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators.indicators import compute, cross_section
from quantloom.operators.indicators.trend import compute_frame
from quantloom.plans import query
from quantloom.plans.kit import (BENCH, DAILY, HOURLY, META, RETURNS, W, B, O, U, dv, ewm, lag, pct, pick, result,
                                 rnd, roll, roll2, steps, with_)
from quantloom.sources import tables as T

TR = [("pc", lag("close")),
      ("tr", "CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END")]
TP = [("tp", "(high + low + close) / 3")]
DIFF = [("d", f"close - {lag('close')}")]
RET = [("r", pct("close"))]
GAIN_LOSS = DIFF + [("up", "CASE WHEN d > 0 THEN d ELSE 0 END"), ("dn", "CASE WHEN d < 0 THEN -d ELSE 0 END")]


def strength(g, l):
    return (f"CASE WHEN {l} = 0 AND {g} > 0 THEN 100.0 ELSE 100 - 100 / nullif(1 + {dv(g, l)}, 0) END")


def rsi(n, name="rsi"):
    return GAIN_LOSS + [("ag", roll("avg", "up", n)), ("al", roll("avg", "dn", n)), (name, strength("ag", "al"))]


def add(name: str, ind: str, values: str, todo, digits=6, base="daily", **params):
    values = values.split()
    bars = T.daily_bars if base == "daily" else T.hourly_bars
    sql = with_(DAILY if base == "daily" else HOURLY, steps(base, todo), body=pick(values, digits, base=base))

    @query(name, sql)
    def run(spark, sf_dir):
        return result(compute(bars(spark, sf_dir), ind, **params), values, digits, base=base)


# ---- momentum -------------------------------------------------------------------------------------------------
add("rsi", "RSI", "rsi", rsi(14))
add("rsi_hourly", "RSI", "rsi", rsi(14), base="hourly")
MACD = [("f", ewm("close", 12)), ("sl", ewm("close", 26)), ("macd", "f - sl"), ("signal", ewm("macd", 9)),
        ("histogram", "macd - signal")]
add("macd", "MACD", "macd signal histogram", MACD, 4)
STOCH = [("ll", roll("min", "low", 14)), ("hh", roll("max", "high", 14))]
add("stochastic", "Stochastic", "k d", STOCH + [("k", f"100 * {dv('close - ll', 'hh - ll')}"),
                                                ("d", roll("avg", "k", 3))])
add("williams_r", "Williams_R", "williams_r", STOCH + [("williams_r", f"-100 * {dv('hh - close', 'hh - ll')}")])
add("roc", "ROC", "roc", [("roc", f"100 * {pct('close', 12)}")])
add("mfi", "MFI", "mfi", TP + [("before", lag("tp")), ("pu", "CASE WHEN tp > before THEN tp * volume ELSE 0 END"),
                               ("pd", "CASE WHEN tp < before THEN tp * volume ELSE 0 END"),
                               ("su", roll("sum", "pu", 14)), ("sd", roll("sum", "pd", 14)),
                               ("mfi", strength("su", "sd"))])
add("tsi", "TSI", "tsi", DIFF + [("ad", "abs(d)"), ("e1", ewm("d", 25)), ("e2", ewm("e1", 13)), ("a1", ewm("ad", 25)),
                                 ("a2", ewm("a1", 13)), ("tsi", f"100 * {dv('e2', 'a2')}")])
add("ultimate_oscillator", "UO", "uo",
    [("pc", lag("close")), ("tl", "CASE WHEN pc IS NOT NULL THEN least(low, pc) END"), ("bp", "close - tl"),
     ("tr", "greatest(high, pc) - tl")]
    + [(f"{v}{n}", roll("sum", v, n)) for n in (7, 14, 28) for v in ("bp", "tr")]
    + [("uo", f"100 * (4 * {dv('bp7', 'tr7')} + 2 * {dv('bp14', 'tr14')} + {dv('bp28', 'tr28')}) / 7")])
add("cci", "CCI", "cci", TP + [("m", roll("avg", "tp", 20)), ("vals", f"list(tp) OVER {W(20)}"),
                               ("mad", "list_sum(list_transform(vals, lambda v: abs(v - m))) / 20"),
                               ("cci", dv("tp - m", "0.015 * mad"))])
add("dpo", "DPO", "dpo", [("m", roll("avg", "close", 20)), ("dpo", f"close - {lag('m', 11)}")], 4)
add("cmo", "CMO", "cmo", GAIN_LOSS + [("su", roll("sum", "up", 14)), ("sd", roll("sum", "dn", 14)),
                                      ("cmo", f"100 * {dv('su - sd', 'su + sd')}")])
add("trix", "TRIX", "trix", [("e1", ewm("close", 14)), ("e2", ewm("e1", 14)), ("e3", ewm("e2", 14)),
                             ("trix", f"{pct('e3')} * 10000")])
add("kst", "KST", "kst", [(f"r{n}", f"100 * {pct('close', n)}") for n in (10, 15, 20, 30)]
    + [("kst", " + ".join(f"{i} * ({roll('avg', f'r{n}', m)})" for i, n, m in
                          ((1, 10, 10), (2, 15, 10), (3, 20, 10), (4, 30, 15))))])

# ---- oscillators ----------------------------------------------------------------------------------------------
add("stochastic_rsi", "StochasticRSI", "stoch_rsi k d",
    [("chg", e) for _, e in DIFF] + [
        ("up", "CASE WHEN chg > 0 THEN chg ELSE 0 END"), ("dn", "CASE WHEN chg < 0 THEN -chg ELSE 0 END"),
        ("ag", roll("avg", "up", 14)), ("al", roll("avg", "dn", 14)), ("rsi", strength("ag", "al")),
        ("ll", roll("min", "rsi", 14)), ("hh", roll("max", "rsi", 14)),
        ("stoch_rsi", f"100 * {dv('rsi - ll', 'hh - ll')}"), ("k", roll("avg", "stoch_rsi", 3)),
        ("d", roll("avg", "k", 3))], 4)
add("macd_histogram", "MACD_Histogram", "macd_histogram", MACD[:4] + [("macd_histogram", "macd - signal")], 4)
add("ppo", "PPO", "ppo signal histogram", MACD[:2] + [("ppo", f"100 * {dv('f - sl', 'sl')}"),
                                                      ("signal", ewm("ppo", 9)), ("histogram", "ppo - signal")])
add("price_oscillator", "PriceOscillator", "price_oscillator",
    [("price_oscillator", f"({roll('avg', 'close', 10)}) - ({roll('avg', 'close', 20)})")], 4)
add("price_oscillator_ema", "PriceOscillator", "price_oscillator",
    [("a", ewm("close", 10)), ("b", ewm("close", 20)), ("price_oscillator", "a - b")], 4, ma_type="EMA")
add("volume_oscillator", "VolumeOscillator", "volume_oscillator",
    [("f", roll("avg", "volume", 5)), ("sl", roll("avg", "volume", 10)),
     ("volume_oscillator", f"100 * {dv('f - sl', 'sl')}")])
add("derivative_oscillator", "DerivativeOscillator", "derivative_oscillator",
    rsi(14) + [("e1", ewm("rsi", 5)), ("e2", ewm("e1", 3)), ("m", roll("avg", "e2", 9)),
               ("derivative_oscillator", "e2 - m")])


def four_tap(x):
    return f"({x} + 2 * {lag(x)} + 2 * {lag(x, 2)} + {lag(x, 3)}) / 6"


add("rvgi", "RVGI", "rvgi signal",
    [("co", "close - open"), ("hl", "high - low"), ("n4", four_tap("co")), ("d4", four_tap("hl")),
     ("sn", roll("sum", "n4", 10)), ("sd", roll("sum", "d4", 10)), ("rvgi", dv("sn", "sd")),
     ("signal", four_tap("rvgi"))], 4, base="hourly")
KELT = TP + TR + [("middle", ewm("tp", 20)), ("atr", ewm("tr", 20))]
add("keltner_oscillator", "KeltnerOscillator", "keltner_oscillator",
    KELT + [("keltner_oscillator", f"100 * {dv('close - middle', '4 * atr')}")])
CLV = [("mfv", "coalesce(((close - low) - (high - close)) / nullif(high - low, 0), 0) * volume"),
       ("ad", f"sum(mfv) OVER {U()}")]
add("chaikin_oscillator", "ChaikinOscillator", "chaikin_oscillator",
    CLV + [("a", ewm("ad", 3)), ("b", ewm("ad", 10)), ("chaikin_oscillator", "a - b")], 4)


def aroon(n):
    w = W(n)
    return [("his", f"list(high) OVER {w}"), ("los", f"list(low) OVER {w}"),
            ("aroon_up", f"CASE WHEN rn > {n} THEN list_position(his, list_max(his)) / {n}.0 * 100 END"),
            ("aroon_down", f"CASE WHEN rn > {n} THEN list_position(los, list_min(los)) / {n}.0 * 100 END"),
            ("oscillator", "aroon_up - aroon_down")]


add("aroon", "Aroon", "aroon_up aroon_down oscillator", aroon(25))
add("aroon_oscillator", "AroonOscillator", "aroon_oscillator", aroon(25)[:4] + [
    ("aroon_oscillator", "aroon_up - aroon_down")])
add("polarized_fractal_efficiency", "PolarizedFractalEfficiency", "pfe",
    DIFF + [("net", f"close - {lag('close', 9)}"), ("path", f"sum(abs(d)) OVER {W(9)}"),
            ("q", "100 * coalesce(abs(net) / nullif(path, 0), 0)"),
            ("pfe", "CASE WHEN rn >= 10 THEN CASE WHEN net > 0 THEN q ELSE -q END END")])

# ---- averages and statistics ----------------------------------------------------------------------------------
add("sma", "SMA", "sma", [("sma", roll("avg", "close", 20))], 4)
add("ema", "EMA", "ema", [("ema", ewm("close", 20))], 4)
add("wma", "WMA", "wma", [("wma", "CASE WHEN rn >= 20 THEN (" + " + ".join(
    f"{20 - k} * {lag('close', k) if k else 'close'}" for k in range(20)) + ") / 210.0 END")], 4)
CHAIN = [("e1", ewm("close", 20))] + [(f"e{i}", ewm(f"e{i - 1}", 20)) for i in range(2, 7)]
add("tema", "TEMA", "tema", CHAIN[:3] + [("tema", "3 * e1 - 3 * e2 + e3")], 4)
add("dema", "DEMA", "dema", CHAIN[:2] + [("dema", "2 * e1 - e2")], 4)
add("t3", "T3", "t3", CHAIN + [("t3", "-0.343 * e6 + 2.499 * e5 - 6.069 * e4 + 4.913 * e3")], 3)
KAMA_GAIN = [("mv", f"abs(close - {lag('close', 10)})"), ("d", f"abs(close - {lag('close')})"),
             ("path", roll("sum", "d", 10)),
             ("gain", f"CASE WHEN rn > 10 THEN pow({dv('mv', 'path')} * (2.0/3 - 2.0/31) + 2.0/31, 2) END")]
KAMA_SQL = with_(DAILY, steps("daily", KAMA_GAIN), body="""SELECT f.symbol, strftime(f.ts, '%Y-%m-%d') AS day,
  """ + rnd("""CASE WHEN f.rn >= 10 THEN list_reduce(list_prepend({'x': a.seed, 'g': 0.0::DOUBLE}, a.todo[:f.rn - 10]),
    lambda k, p: {'x': k.x + p.g * (p.x - k.x), 'g': 0.0::DOUBLE}).x END""", 4, "kama") + """
FROM final f JOIN (SELECT symbol, list({'x': close, 'g': gain::DOUBLE} ORDER BY rn) FILTER (rn > 10) AS todo,
  max(close) FILTER (rn = 10) AS seed FROM final GROUP BY symbol) a ON a.symbol = f.symbol""")


@query("kama", KAMA_SQL)
def kama(spark, sf_dir):
    return result(compute(T.daily_bars(spark, sf_dir), "KAMA"), ["kama"], 4)


add("linear_regression", "LinearRegression", "line slope",
    [("slope", f"CASE WHEN rn >= 20 THEN regr_slope(close, rn) OVER {W(20)} END"),
     ("m", roll("avg", "close", 20)), ("line", "m + slope * 9.5")], 4)
add("correlation", "Correlation", "correlation", [("correlation", roll2("corr", "close", "volume", 20))])
add("covariance", "Covariance", "covariance", [("covariance", roll2("covar_samp", "close", "volume", 20))], 2)
add("zscore", "ZScore", "zscore", [("m", roll("avg", "close", 20)), ("sd", roll("stddev_samp", "close", 20)),
                                   ("zscore", dv("close - m", "sd"))])
add("percent_rank", "PercentRank", "percent_rank",
    [("past", f"list(close) OVER {B(-19, -1)}"), ("lo", "len(list_filter(past, lambda v: v < close))"),
     ("le", "len(list_filter(past, lambda v: v <= close))"),
     ("percent_rank", "CASE WHEN rn >= 20 THEN (lo + le + CASE WHEN le > lo THEN 1 ELSE 0 END) / 2.0 / 19 END")])
add("skewness", "Skewness", "skewness", RET + [("skewness", roll("skewness", "r", 20))], 5)
add("kurtosis", "Kurtosis", "kurtosis", RET + [("kurtosis", roll("kurtosis", "r", 20))], 5)
add("entropy", "Entropy", "entropy",
    RET + [("vals", f"CASE WHEN count(r) OVER {W(20)} = 20 THEN list(r) OVER {W(20)} END"),
           ("lo", "list_min(vals)"), ("hi", "list_max(vals)"),
           ("slot", "list_transform(vals, lambda v: least(CAST(floor((v - lo) / nullif(hi - lo, 0) * 10) AS BIGINT), 9))"),
           ("cnt", "list_transform(range(0, 10), lambda b: len(list_filter(slot, lambda x: x = b)) / 20.0)"),
           ("entropy", "CASE WHEN hi = lo THEN 0.0 ELSE -list_sum(list_transform(list_filter(cnt, lambda p: p > 0), lambda p: p * log2(p))) END")])
add("hurst_exponent", "HurstExponent", "hurst",
    [("m", roll("avg", "close", 100)), ("sd", roll("stddev_pop", "close", 100)),
     ("cum", f"sum(close) OVER {U()}"), ("cums", f"list(cum) OVER {W(100)}"),
     ("base", "cum - 100 * m"),
     ("dev", "list_transform(cums, lambda c, i: c - base - i * m)"),
     ("hurst", f"CASE WHEN m IS NOT NULL THEN ln({dv('list_max(dev) - list_min(dev)', 'sd')}) / ln(100) END")])

# ---- trend ----------------------------------------------------------------------------------------------------
A14 = 1.0 / 14
add("adx", "ADX", "adx plus_di minus_di",
    TR + [("um", f"high - {lag('high')}"), ("dm", f"{lag('low')} - low"),
          ("pdm", "CASE WHEN um > dm AND um > 0 THEN um ELSE 0 END"),
          ("mdm", "CASE WHEN dm > um AND dm > 0 THEN dm ELSE 0 END"), ("st", ewm("tr", alpha=A14)),
          ("sp", ewm("pdm", alpha=A14)), ("sm", ewm("mdm", alpha=A14)), ("plus_di", f"100 * {dv('sp', 'st')}"),
          ("minus_di", f"100 * {dv('sm', 'st')}"),
          ("dx", f"100 * {dv('abs(plus_di - minus_di)', 'plus_di + minus_di')}"), ("adx", ewm("dx", alpha=A14))])
add("ichimoku", "Ichimoku", "tenkan_sen kijun_sen senkou_span_a senkou_span_b chikou_span",
    [(n, f"(({roll('max', 'high', k)}) + ({roll('min', 'low', k)})) / 2") for n, k in
     (("tenkan_sen", 9), ("kijun_sen", 26), ("wide", 52))]
    + [("senkou_span_a", "(" + lag("tenkan_sen", 26) + f" + {lag('kijun_sen', 26)}) / 2"),
       ("senkou_span_b", lag("wide", 26)), ("chikou_span", f"lead(close, 26) OVER {O()}")], 4)
add("vortex", "VortexIndicator", "vi_plus vi_minus vi_diff",
    TR + [("vp", f"abs(high - {lag('low')})"), ("vm", f"abs(low - {lag('high')})"), ("st", roll("sum", "tr", 14)),
          ("sp", roll("sum", "vp", 14)), ("sm", roll("sum", "vm", 14)), ("vi_plus", dv("sp", "st")),
          ("vi_minus", dv("sm", "st")), ("vi_diff", "vi_plus - vi_minus")])
add("mass_index", "MassIndex", "mass_index",
    [("hl", "high - low"), ("e1", ewm("hl", 9)), ("e2", ewm("e1", 9)), ("q", dv("e1", "e2")),
     ("mass_index", roll("sum", "q", 25))])
add("trend_intensity", "TrendIntensity", "trend_intensity",
    [("m", roll("avg", "close", 30)), ("ab", "CASE WHEN close > m THEN 1.0 ELSE 0.0 END"),
     ("s_", roll("sum", "ab", 30)), ("trend_intensity", "s_ / 30 * 100")])

# ---- volatility -----------------------------------------------------------------------------------------------
add("bollinger_bands", "BollingerBands", "upper middle lower width position",
    [("middle", roll("avg", "close", 20)), ("sd", roll("stddev_samp", "close", 20)), ("upper", "middle + 2 * sd"),
     ("lower", "middle - 2 * sd"), ("width", dv("upper - lower", "middle")),
     ("position", dv("close - lower", "upper - lower"))], 4)
add("atr", "ATR", "atr", TR + [("atr", roll("avg", "tr", 14))], 4)
add("keltner", "Keltner", "upper middle lower",
    KELT + [("upper", "middle + 2 * atr"), ("lower", "middle - 2 * atr")], 4)
add("donchian_channel", "DonchianChannel", "upper middle lower",
    [("upper", roll("max", "high", 20)), ("lower", roll("min", "low", 20)), ("middle", "(upper + lower) / 2")], 4)
add("vwap", "VWAP", "vwap", TP + [("pv", "tp * volume"), ("vwap", f"sum(pv) OVER {U()} / nullif(sum(volume) OVER {U()}, 0)")], 4)
add("vwap_rolling", "VWAP", "vwap", TP + [("pv", "tp * volume"), ("a", roll("sum", "pv", 20)),
                                          ("b", roll("sum", "volume", 20)), ("vwap", dv("a", "b"))], 4, period=20)
add("standard_deviation", "StandardDeviation", "sd", [("sd", roll("stddev_samp", "close", 20))], 4)
add("historical_volatility", "HistoricalVolatility", "historical_volatility",
    [("lr", f"ln({dv('close', lag('close'))})"), ("sd", roll("stddev_samp", "lr", 30)),
     ("historical_volatility", "sd * sqrt(252)")])
RS = [("term", "ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open)"), ("m", roll("avg", "term", 30))]
add("garman_klass", "GarmanKlass", "garman_klass", RS + [("garman_klass", "sqrt(m * 252)")], base="hourly")
add("rogers_satchell", "RogersSatchell", "rogers_satchell", RS + [("rogers_satchell", "sqrt(m * 252)")], base="hourly")
add("garman_klass_textbook", "GarmanKlassTextbook", "garman_klass_textbook",
    [("term", "0.5 * pow(ln(high / low), 2) - (2 * ln(2) - 1) * pow(ln(close / open), 2)"),
     ("m", roll("avg", "term", 30)), ("garman_klass_textbook", "sqrt(CASE WHEN m < 0 THEN 0 ELSE m END * 252)")], base="hourly")
add("parkinson", "Parkinson", "parkinson",
    [("term", "pow(ln(high / low), 2) / (4 * ln(2))"), ("m", roll("avg", "term", 30)),
     ("parkinson", "sqrt(m * 252)")])

# ---- volume ---------------------------------------------------------------------------------------------------
add("obv", "OBV", "obv", DIFF + [("sv", "coalesce(sign(d) * volume, 0)"), ("obv", f"sum(sv) OVER {U()}")])
add("ad", "AD", "ad", CLV, 4)
add("adosc", "ADOSC", "adosc", CLV + [("a", ewm("ad", 3)), ("b", ewm("ad", 10)), ("adosc", "a - b")], 4)
add("pvt", "PVT", "pvt", RET + [("rv", "r * volume"), ("pvt", f"sum(rv) OVER {U()}")], 3)
def add_volume_index(name, ind, op):
    todo = [("st", f"CASE WHEN volume {op} {lag('volume')} THEN {dv('close', lag('close'))} ELSE 1 END"),
            (f"log_{name}", f"ln(1000 * product(st) OVER {U()})")]

    @query(name, with_(DAILY, steps("daily", todo), body=pick([f"log_{name}"])))
    def run(spark, sf_dir):
        df = compute(T.daily_bars(spark, sf_dir), ind)
        return result(df.withColumn(f"log_{name}", F.ln(name)), [f"log_{name}"])


for nm, ind, op in (("nvi", "NVI", "<"), ("pvi", "PVI", ">")):
    # the index spans many orders of magnitude on this data, so its logarithm is compared
    add_volume_index(nm, ind, op)
add("emv", "EMV", "emv",
    [("mid", "(high + low) / 2"), ("box", dv("volume", "10000 * (high - low)")),
     ("raw", f"coalesce({dv('mid - ' + lag('mid'), 'box')}, 0)"), ("emv", roll("avg", "raw", 14))], 0)
add("fi", "FI", "fi", [("raw", f"(close - {lag('close')}) * volume"), ("fi", ewm("raw", 13))], 3)
add("vwmacd", "VWMACD", "vwmacd signal histogram",
    [("pv", "close * volume")] + [(f"{a}{n}", ewm(x, n)) for n in (12, 26) for a, x in (("p", "pv"), ("v", "volume"))]
    + [("vwmacd", f"{dv('p12', 'v12')} - {dv('p26', 'v26')}"), ("signal", ewm("vwmacd", 9)),
       ("histogram", "vwmacd - signal")], 3)
add("volume_price_confirmation", "VolumePriceConfirmation", "vpc",
    RET + [("vr", pct("volume")), ("vpc", roll2("corr", "r", "vr", 20))])
add("volume_weighted_rsi", "VolumeWeightedRSI", "vw_rsi",
    DIFF + [("up", "CASE WHEN d > 0 THEN d * volume ELSE 0 END"), ("dn", "CASE WHEN d < 0 THEN -d * volume ELSE 0 END"),
            ("sv", roll("sum", "volume", 14)), ("su", roll("sum", "up", 14)), ("sd", roll("sum", "dn", 14)),
            ("g", dv("su", "sv")), ("l", dv("sd", "sv")), ("vw_rsi", strength("g", "l"))])


# ---- against a benchmark --------------------------------------------------------------------------------------
# Benchmark of a bar = mean close of all symbols at its timestamp; market return = mean return at its timestamp.
def with_benchmark(spark, sf_dir):
    bars = T.daily_bars(spark, sf_dir)
    level = bars.groupBy("ts").agg(F.avg("close").alias("benchmark"))
    return bars.join(level, "ts")


def with_market(spark, sf_dir):
    bars = T.daily_bars(spark, sf_dir)
    market = T.benchmark_returns(T.simple_returns(bars)).withColumnRenamed("bench", "market_return")
    return bars.join(market, "ts", "left")


BM = "bm AS (SELECT * FROM daily JOIN (SELECT ts, avg(close) AS benchmark FROM daily GROUP BY ts) USING (ts))"
MK = "mk AS (SELECT * FROM daily LEFT JOIN (SELECT ts, bench AS market_return FROM bench) USING (ts))"
R2 = [("r", pct("close")), ("b", pct("benchmark"))]


def add_versus(name, ind, value, todo, market=False, digits=6):
    sql = with_(DAILY, *([RETURNS, BENCH, MK] if market else [BM]), steps("mk" if market else "bm", todo),
                body=pick([value], digits))

    @query(name, sql)
    def run(spark, sf_dir):
        bars = (with_market if market else with_benchmark)(spark, sf_dir)
        return result(compute(bars, ind), [value], digits)


add_versus("beta", "Beta", "beta", RET + [("cv", roll2("covar_samp", "r", "market_return", 60)),
                                          ("va", roll("var_samp", "market_return", 60)), ("beta", dv("cv", "va"))], True)
add_versus("r_squared", "RSquared", "r_squared", RET + [("r_squared", f"pow({roll2('corr', 'r', 'market_return', 60)}, 2)")], True)
add_versus("relative_strength", "RelativeStrength", "relative_strength",
           [("relative_strength", f"{pct('close', 20)} - {pct('benchmark', 20)}")])
add_versus("relative_volatility", "RelativeVolatility", "relative_volatility",
           R2 + [("a", roll("stddev_samp", "r", 20)), ("c", roll("stddev_samp", "b", 20)),
                 ("relative_volatility", dv("a", "c"))])
add_versus("information_ratio_rolling", "InformationRatio", "information_ratio",
           R2 + [("x", "r - b"), ("m", roll("avg", "x", 60)), ("sd", roll("stddev_samp", "x", 60)),
                 ("information_ratio", dv("m", "sd"))])
SUBS = [(j - 60, j - 41) for j in (0, 10, 20, 30, 40)]
add_versus("beta_stability", "BetaStability", "beta_stability",
           R2 + [(f"b{i}", f"covar_samp(r, b) OVER {B(a, z)} / nullif(var_samp(b) OVER {B(a, z)}, 0)")
                 for i, (a, z) in enumerate(SUBS)]
           + [("vs", "list_filter([b0, b1, b2, b3, b4], lambda v: v IS NOT NULL)"), ("sp", "list_stddev_pop(vs)"),
              ("beta_stability", "CASE WHEN rn > 60 AND len(vs) > 1 THEN 1 / (1 + sp) END")])
add_versus("correlation_stability", "CorrelationStability", "correlation_stability",
           R2 + [(f"b{i}", f"corr(r, b) OVER {B(a, z)}") for i, (a, z) in enumerate(SUBS)]
           + [("vs", "list_filter([b0, b1, b2, b3, b4], lambda v: v IS NOT NULL AND NOT isnan(v))"), ("sp", "list_stddev_pop(vs)"),
              ("correlation_stability", "CASE WHEN rn > 60 AND len(vs) > 1 THEN 1 / (1 + sp) END")])


# ---- across symbols -------------------------------------------------------------------------------------------
PERIOD_RET = f"pr AS (SELECT symbol, ts, close, {pct('close', 20)} AS ret FROM daily)"


@query("relative_strength_index", with_(DAILY, PERIOD_RET, body="""SELECT symbol, strftime(ts, '%Y-%m-%d') AS day,
  """ + rnd("100.0 * (rank() OVER (PARTITION BY ts ORDER BY ret) - 1) / nullif(count(*) OVER (PARTITION BY ts) - 1, 0)", 6, "rs_index") + """
  FROM pr WHERE ret IS NOT NULL"""))
def relative_strength_index(spark, sf_dir):
    return result(cross_section.relative_strength_index(T.daily_bars(spark, sf_dir)), ["rs_index"])


@query("cross_sectional_rank", with_(DAILY, body="""SELECT symbol, strftime(ts, '%Y-%m-%d') AS day,
  """ + rnd("100.0 * (rank() OVER (PARTITION BY ts ORDER BY close) - 1) / count(*) OVER (PARTITION BY ts)", 6, "cs_rank") + """
  FROM daily"""))
def cross_sectional_rank(spark, sf_dir):
    return result(cross_section.cross_sectional_rank(T.daily_bars(spark, sf_dir)), ["cs_rank"])


@query("sector_momentum", with_(DAILY, META, PERIOD_RET, body="""SELECT symbol, sector, strftime(ts, '%Y-%m-%d') AS day,
  """ + rnd("avg(ret) OVER (PARTITION BY sector)", 6, "sector_momentum") + """ FROM pr JOIN meta USING (symbol)"""))
def sector_momentum(spark, sf_dir):
    df = cross_section.sector_momentum(T.daily_bars(spark, sf_dir), T.symbol_metadata(spark, sf_dir))
    return result(df, ["sector_momentum"], keys=("symbol", "sector"))


@query("sector_momentum_to_date", with_(DAILY, META, PERIOD_RET, body="""SELECT symbol, sector, strftime(ts, '%Y-%m-%d') AS day,
  """ + rnd("avg(ret) OVER (PARTITION BY sector ORDER BY ts RANGE UNBOUNDED PRECEDING)", 5, "sector_momentum") + """
  FROM pr JOIN meta USING (symbol)"""))
def sector_momentum_to_date(spark, sf_dir):
    df = cross_section.sector_momentum_to_date(T.daily_bars(spark, sf_dir), T.symbol_metadata(spark, sf_dir))
    return result(df, ["sector_momentum"], 5, keys=("symbol", "sector"))


# ---- state machines: the SQL form is the loop itself, one step per bar ---------------------------------------------
PSAR_SQL = "WITH RECURSIVE " + DAILY + """,
b AS MATERIALIZED (SELECT *, least(lag(low) OVER w, lag(low, 2) OVER w) AS near_low, greatest(lag(high) OVER w, lag(high, 2) OVER w) AS near_high, row_number() OVER w AS rn
  FROM daily WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
p AS (SELECT symbol, rn, ts, low AS stop, 0.02::DOUBLE AS speed, high AS extreme, 1 AS side FROM b WHERE rn = 1 UNION ALL
  SELECT symbol, rn, ts, CASE WHEN side * (behind - s) <= 0 THEN extreme WHEN side > 0 THEN least(s, near_low) ELSE greatest(s, near_high) END,
    CASE WHEN side * (behind - s) <= 0 THEN 0.02 WHEN side * (ahead - extreme) > 0 THEN least(speed + 0.02, 0.2) ELSE speed END,
    CASE WHEN side * (behind - s) <= 0 THEN behind WHEN side * (ahead - extreme) > 0 THEN ahead ELSE extreme END, CASE WHEN side * (behind - s) <= 0 THEN -side ELSE side END
  FROM (SELECT b.symbol, b.rn, b.ts, near_low, near_high, p.stop + p.speed * (p.extreme - p.stop) AS s, speed, extreme, side,
          CASE WHEN side > 0 THEN b.high ELSE b.low END AS ahead, CASE WHEN side > 0 THEN b.low ELSE b.high END AS behind FROM p JOIN b ON b.symbol = p.symbol AND b.rn = p.rn + 1)),
f AS (SELECT symbol, ts, stop AS psar, side AS direction FROM p)
"""
TREND_SQL = "WITH RECURSIVE " + DAILY + """,
n AS (SELECT *, lag(close) OVER w AS before, row_number() OVER w AS rn FROM daily WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
t AS (SELECT *, CASE WHEN rn > 1 THEN greatest(high - low, abs(high - before), abs(low - before)) END AS tr FROM n),
b AS MATERIALIZED (SELECT *, (high + low) / 2 + 3 * atr AS u, (high + low) / 2 - 3 * atr AS d
  FROM (SELECT *, avg(tr) OVER (PARTITION BY symbol ORDER BY ts ROWS 9 PRECEDING) AS atr FROM t)),
p AS (SELECT symbol, rn, u AS upper, d AS lower, close, TRUE AS top, u AS line, 1 AS direction FROM b WHERE rn = 11 UNION ALL
  SELECT symbol, rn, upper, lower, close, up, CASE WHEN up THEN upper ELSE lower END, CASE WHEN up THEN -1 ELSE 1 END
  FROM (SELECT *, CASE WHEN top THEN close <= upper ELSE close < lower END AS up
    FROM (SELECT b.symbol, b.rn, b.close, top, CASE WHEN u < p.upper OR p.close > p.upper THEN u ELSE p.upper END AS upper, CASE WHEN d > p.lower OR p.close < p.lower THEN d ELSE p.lower END AS lower
      FROM p JOIN b ON b.symbol = p.symbol AND b.rn = p.rn + 1))),
f AS (SELECT b.symbol, b.ts, line AS supertrend, direction, upper, lower FROM b LEFT JOIN p ON p.symbol = b.symbol AND p.rn = b.rn)
"""


@query("psar", PSAR_SQL + pick(["psar", "direction"], 4, source="f"))
def psar(spark, sf_dir):
    return result(compute_frame(T.daily_bars(spark, sf_dir), "PSAR"), ["psar", "direction"], 4)


@query("supertrend", TREND_SQL + pick(["supertrend", "direction", "upper", "lower"], 4, source="f"))
def supertrend(spark, sf_dir):
    return result(compute_frame(T.daily_bars(spark, sf_dir), "SuperTrend"),
                  ["supertrend", "direction", "upper", "lower"], 4)
