"""SQL oracle: for each registered query, an equivalent DuckDB query over the driver
tables. The adapter views are written once as CTEs and shared.

Rounding in SQL mirrors the Spark side step by step: ``round_even(x * 1e4, 0) / 1e4``
is ``rint(x * 1e4) / 1e4`` and the 6-decimal output rounding is the same with 1e6.
"""

from __future__ import annotations

from ..functions.keywords import KEYWORDS
from ..functions.timeparse import MONTH_ABBREVIATIONS


def r4(x: str) -> str:
    return f"(round_even(({x}) * 1e4, 0) / 1e4)"


def r6(x: str) -> str:
    return f"(round_even(({x}) * 1e6, 0) / 1e6 + 0.0)"


def exact_mean(x: str, scale: int = 4) -> str:
    return f"(CAST(sum(CAST(({x}) AS DECIMAL(24,{scale}))) AS DOUBLE) / count({x}))"


def _scored_from(src: str) -> str:
    """Scored columns from a relation with seq, Time and weights a, b, c."""
    return f"""(SELECT seq, Time,
        CASE cls WHEN 0 THEN 'Negative' WHEN 1 THEN 'Neutral' WHEN 2 THEN 'Positive' END AS Sentiment,
        {r4('greatest(a, b, c) / t')} AS Confidence,
        {r4('a / t')} AS Negative_Probability,
        {r4('b / t')} AS Neutral_Probability,
        {r4('c / t')} AS Positive_Probability,
        cls AS Predicted_Class
      FROM (SELECT *, CAST(a + b + c AS DOUBLE) AS t,
                   CAST(CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS INTEGER) AS cls
            FROM {src}) _w)"""


SCORED_EVENTS = _scored_from(
    "(SELECT event_id AS seq, ts AS Time, 1 + CAST(floor(value) AS BIGINT) % 11 AS a, "
    "1 + user_id % 5 AS b, 1 + event_id % 7 AS c FROM events) _e")

SCORED_ORDERS = _scored_from(
    "(SELECT o_orderkey AS seq, o_orderdate AS Time, 1 + o_custkey % 11 AS a, "
    "1 + CAST(floor(o_totalprice) AS BIGINT) % 5 AS b, 1 + o_orderkey % 7 AS c FROM orders) _o")


def with_headlines(scored: str) -> str:
    return f"""(SELECT s.seq, s.Time, h.Headline, s.Sentiment, s.Confidence,
        s.Negative_Probability, s.Neutral_Probability, s.Positive_Probability, s.Predicted_Class
      FROM {scored} s
      CROSS JOIN (SELECT count(*) AS n FROM documents) nd
      LEFT JOIN (SELECT doc_id, text AS Headline FROM documents) h
        ON h.doc_id = s.seq % nd.n)"""


SIGN = "CASE Predicted_Class WHEN 0 THEN -1 WHEN 1 THEN 0 WHEN 2 THEN 1 END"


def daily_index(scored: str) -> str:
    return f"""SELECT CAST(Time AS DATE) AS Time,
        {r6(exact_mean('sgn * Confidence') + ' * 100')} AS Daily_Sentiment_Index,
        count(*) AS Headlines_Processed
      FROM (SELECT Time, Confidence, {SIGN} AS sgn FROM {scored} _s) _x
      WHERE Time IS NOT NULL GROUP BY 1"""


STAT_COLUMNS = [
    "avg_sentiment", "sentiment_volatility", "min_sentiment", "max_sentiment",
    "headline_count", "avg_weighted_sentiment", "weighted_sentiment_volatility",
    "avg_confidence", "confidence_volatility",
    "Positive_Probability_mean", "Positive_Probability_max",
    "Negative_Probability_mean", "Negative_Probability_max",
    "Neutral_Probability_mean", "Neutral_Probability_max",
]


def _stat_exprs() -> list[str]:
    raw = [
        exact_mean("s", 4), "stddev_samp(s)", "min(s)", "max(s)", None,
        exact_mean("w", 8), "stddev_samp(w)", exact_mean("Confidence", 4), "stddev_samp(Confidence)",
        exact_mean("Positive_Probability", 4), "max(Positive_Probability)",
        exact_mean("Negative_Probability", 4), "max(Negative_Probability)",
        exact_mean("Neutral_Probability", 4), "max(Neutral_Probability)",
    ]
    out = []
    for name, e in zip(STAT_COLUMNS, raw):
        out.append("count(s) AS headline_count" if e is None
                   else f"coalesce({r4(e)}, 0.0) AS {name}")
    return out


def stat_rows(scored: str) -> str:
    """Scored rows with Date, score s and weighted score w."""
    return f"""(SELECT *, CAST(Time AS DATE) AS Date,
        Positive_Probability - Negative_Probability AS s,
        (Positive_Probability - Negative_Probability) * Confidence AS w
      FROM {scored} _r WHERE Time IS NOT NULL)"""


def daily_stats(scored: str) -> str:
    """A2 as a relation (4-decimal values, no output rounding)."""
    return f"""(SELECT Date, {", ".join(_stat_exprs())}
      FROM {stat_rows(scored)} _d GROUP BY Date)"""


def select_r6(rel: str, cols: list[str], doubles: set[str]) -> str:
    items = [f"{r6(c)} AS {c}" if c in doubles else c for c in cols]
    return f"SELECT {', '.join(items)} FROM {rel} _f"


def label_counts(scored: str) -> str:
    return f"""SELECT CAST(v.chart_order AS INTEGER) AS chart_order, v.label,
        (SELECT count(*) FROM {scored} _s WHERE _s.Sentiment = v.label) AS count
      FROM (VALUES (0, 'Positive'), (1, 'Negative'), (2, 'Neutral')) v(chart_order, label)"""


def histogram(rel: str, col: str, n_bins: int | None) -> str:
    nb = "least(10, count(*))" if n_bins is None else str(int(n_bins))
    return f"""WITH vals AS (SELECT CAST({col} AS DOUBLE) AS v FROM {rel} _h WHERE {col} IS NOT NULL),
      st AS (SELECT *, (hi - lo) / nb AS size
             FROM (SELECT min(v) AS lo, max(v) AS hi, CAST({nb} AS INTEGER) AS nb FROM vals) _m),
      binned AS (SELECT CAST(CASE WHEN size > 0 THEN least(floor((v - lo) / size), nb - 1)
                                  ELSE 0 END AS INTEGER) AS bin FROM vals, st),
      counts AS (SELECT bin, count(*) AS c FROM binned GROUP BY bin),
      bins AS (SELECT st.*, CAST(b.bin AS INTEGER) AS bin
               FROM st, range(0, (SELECT nb FROM st)) b(bin))
      SELECT bins.bin, printf('%.2f - %.2f', lo + bins.bin * size, lo + (bins.bin + 1) * size) AS label,
             {r6('lo + bins.bin * size')} AS bin_start, {r6('lo + (bins.bin + 1) * size')} AS bin_end,
             coalesce(c, 0) AS count
      FROM bins LEFT JOIN counts ON bins.bin = counts.bin"""


ORACLE: dict[str, str] = {
    "daily_index": daily_index(SCORED_EVENTS),
    "daily_index_orders": daily_index(SCORED_ORDERS),
    "daily_stats": select_r6(daily_stats(SCORED_ORDERS), ["Date"] + STAT_COLUMNS,
                             set(STAT_COLUMNS) - {"headline_count"}),
    "label_counts": label_counts(SCORED_EVENTS),
    "confidence_histogram": histogram(SCORED_EVENTS, "Confidence", 10),
}


# --- daily-grain feature flow ---------------------------------------------------------


WINDOWS = (3, 7, 14, 30)
FLAG_COLUMNS = ["extreme_positive_day", "extreme_negative_day", "high_sentiment_volatility",
                "high_news_flow_day", "mixed_sentiment_day", "high_confidence_day"]


def flag(cond: str) -> str:
    return f"CAST(coalesce(CAST(({cond}) AS INTEGER), 0) AS INTEGER)"


def rolling_names(windows=WINDOWS) -> list[str]:
    out = []
    for w in windows:
        out += [f"sentiment_ma_{w}d", f"sentiment_std_{w}d", f"weighted_sentiment_ma_{w}d",
                f"headline_count_ma_{w}d", f"confidence_ma_{w}d",
                f"sentiment_momentum_{w}d", f"sentiment_trend_{w}d"]
    return out


def rolling(rel: str, windows=WINDOWS) -> str:
    parts, mom = [], []
    for w in windows:
        fr = f"(ORDER BY Date ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"

        def mean(c, fr=fr):
            return f"(CAST(sum(CAST({c} AS DECIMAL(24,4))) OVER {fr} AS DOUBLE) / count({c}) OVER {fr})"
        parts += [
            f"{mean('avg_sentiment')} AS sentiment_ma_{w}d",
            f"stddev_samp(avg_sentiment) OVER {fr} AS sentiment_std_{w}d",
            f"{mean('avg_weighted_sentiment')} AS weighted_sentiment_ma_{w}d",
            f"{mean('headline_count')} AS headline_count_ma_{w}d",
            f"{mean('avg_confidence')} AS confidence_ma_{w}d",
            f"CASE WHEN count(avg_sentiment) OVER {fr} = {w} "
            f"THEN regr_slope(avg_sentiment, _pos) OVER {fr} END AS sentiment_trend_{w}d",
        ]
        mom.append(f"sentiment_ma_{w}d - lag(sentiment_ma_{w}d) OVER (ORDER BY Date) "
                   f"AS sentiment_momentum_{w}d")
    inner = (f"(SELECT *, {', '.join(parts)} FROM (SELECT *, CAST(row_number() OVER (ORDER BY Date) "
             f"AS DOUBLE) AS _pos FROM {rel} _a) _b)")
    return f"(SELECT * EXCLUDE (_pos), {', '.join(mom)} FROM {inner} _c)"


def thresholds(rel: str) -> str:
    return f"""(SELECT quantile_cont(avg_sentiment, 0.25) AS sentiment_q25,
        quantile_cont(avg_sentiment, 0.75) AS sentiment_q75,
        quantile_cont(sentiment_volatility, 0.75) AS volatility_q75,
        quantile_cont(headline_count, 0.75) AS count_q75 FROM {rel} _t)"""


def flags(rel: str) -> str:
    return f"""(SELECT d.*,
        {flag('d.avg_sentiment > q.sentiment_q75')} AS extreme_positive_day,
        {flag('d.avg_sentiment < q.sentiment_q25')} AS extreme_negative_day,
        {flag('d.sentiment_volatility > q.volatility_q75')} AS high_sentiment_volatility,
        {flag('d.headline_count > q.count_q75')} AS high_news_flow_day,
        {flag('d.Neutral_Probability_mean > 0.5')} AS mixed_sentiment_day,
        {flag('d.avg_confidence > 0.8')} AS high_confidence_day
      FROM {rel} d CROSS JOIN {thresholds(rel)} q)"""


def _hit(lowered: str, word: str, match: str) -> str:
    if match == "substring":
        return f"contains({lowered}, '{word}')"
    return f"regexp_matches({lowered}, '(^|[^a-z0-9]){word}([^a-z0-9]|$)')"


def keyword_aggs(match: str = "substring") -> list[str]:
    low = "lower(Headline)"
    out = []
    for cat, words in KEYWORDS.items():
        cnt = " + ".join(f"coalesce(CAST({_hit(low, w, match)} AS INTEGER), 0)" for w in words)
        hit = "(" + " OR ".join(f"coalesce({_hit(low, w, match)}, false)" for w in words) + ")"
        out += [
            f"CAST(sum({cnt}) AS BIGINT) AS {cat}_mentions",
            f"coalesce({exact_mean(f'CASE WHEN {hit} THEN w END', 8)}, 0.0) AS {cat}_sentiment",
            f"CAST(sum(CAST({hit} AS INTEGER)) AS BIGINT) AS {cat}_headlines",
        ]
    return out


def keyword_names() -> list[str]:
    return [f"{c}_{k}" for c in KEYWORDS for k in ("mentions", "sentiment", "headlines")]


def keyword_features(scored: str, match: str = "substring") -> str:
    return f"(SELECT Date, {', '.join(keyword_aggs(match))} FROM {stat_rows(scored)} _k GROUP BY Date)"


def daily_features(scored: str) -> str:
    return (f"(SELECT Date, {', '.join(_stat_exprs())}, {', '.join(keyword_aggs())} "
            f"FROM {stat_rows(scored)} _d GROUP BY Date)")


def feature_table(scored: str) -> str:
    """A2 + K -> rolling -> flags -> whole-frame fill with 0."""
    cols = STAT_COLUMNS + rolling_names() + FLAG_COLUMNS + keyword_names()
    filled = ", ".join(f"coalesce({c}, 0) AS {c}" for c in cols)
    return f"(SELECT Date, {filled} FROM {flags(rolling(daily_features(scored)))} _ft)"


def fallback_targets(rel: str) -> str:
    f3 = "(ORDER BY Date ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)"
    inner = f"""(SELECT *, lead(avg_sentiment) OVER (ORDER BY Date) AS next_day_sentiment,
        CASE WHEN count(avg_sentiment) OVER {f3} = 3
             THEN CAST(sum(CAST(avg_sentiment AS DECIMAL(24,4))) OVER {f3} AS DOUBLE) / 3 END
          AS next_3day_sentiment FROM {rel} _t)"""
    return f"""(SELECT *, {flag('next_day_sentiment > 0')} AS next_day_positive,
        {flag('next_3day_sentiment > 0')} AS next_3day_positive FROM {inner} _u)"""


MARKET_SERIES = f"""(WITH m AS (
      SELECT CAST(l_shipdate AS DATE) AS Date, {exact_mean('l_extendedprice', 2)} AS SPY,
             {exact_mean('l_quantity', 2)} AS VIX, {exact_mean('l_tax', 2)} * 100 AS TNX
      FROM lineitem GROUP BY 1)
    SELECT 'SPY' AS symbol, Date, SPY AS Close FROM m
    UNION ALL SELECT '^VIX', Date, VIX FROM m
    UNION ALL SELECT '^TNX', Date, TNX FROM m)"""

MARKET_PANEL = f"""(SELECT l_returnflag AS symbol, CAST(l_shipdate AS DATE) AS Date,
      {exact_mean('l_extendedprice', 2)} AS Close
    FROM lineitem GROUP BY 1, 2)"""

INDICATOR_COLUMNS = ["symbol", "Date", "Close", "daily_return", "volatility_5d", "sma_20", "rsi",
                     "market_trend", "high_fear"]


def indicators(market: str) -> str:
    p = "PARTITION BY symbol ORDER BY Date"
    w5 = f"({p} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
    w20 = f"({p} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
    w14 = f"({p} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)"
    a = f"""(SELECT *, last_value(Close IGNORE NULLS) OVER ({p} ROWS BETWEEN UNBOUNDED PRECEDING
        AND CURRENT ROW) AS _padded, Close - lag(Close) OVER ({p}) AS _delta FROM {market} _m)"""
    b = f"""(SELECT *, CASE WHEN _prev IS NULL OR _prev = 0 THEN NULL ELSE _padded / _prev END - 1
          AS daily_return,
        CASE WHEN _delta > 0 THEN _delta ELSE 0.0 END AS _gain,
        CASE WHEN _delta < 0 THEN -_delta ELSE 0.0 END AS _loss
      FROM (SELECT *, lag(_padded) OVER ({p}) AS _prev FROM {a} _a) _b)"""
    c = f"""(SELECT *,
        CASE WHEN count(daily_return) OVER {w5} = 5
             THEN stddev_samp(daily_return) OVER {w5} * sqrt(252) END AS volatility_5d,
        CASE WHEN count(Close) OVER {w20} = 20 THEN avg(Close) OVER {w20} END AS sma_20,
        CASE WHEN count(*) OVER {w14} = 14 THEN avg(_gain) OVER {w14} END AS _ag,
        CASE WHEN count(*) OVER {w14} = 14 THEN avg(_loss) OVER {w14} END AS _al
      FROM {b} _c)"""
    return f"""(SELECT symbol, Date, Close, daily_return, volatility_5d, sma_20,
        CASE WHEN _al > 0 THEN 100 - 100 / (1 + _ag / _al) WHEN _ag > 0 THEN 100.0 END AS rsi,
        {flag('Close > sma_20')} AS market_trend, {flag('Close > 20')} AS high_fear
      FROM {c} _d)"""


def market_targets(daily: str, market: str) -> str:
    cut = f"""(SELECT m.* FROM {market} m WHERE m.Date >= (SELECT min(Date) FROM {daily} _x)
        AND m.Date < (SELECT max(Date) FROM {daily} _y) + 30)"""
    ind = indicators(cut)
    f3 = "(ORDER BY Date ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)"
    merged = f"""(SELECT d.*, s.daily_return, s.volatility_5d, s.market_trend FROM {daily} d
      LEFT JOIN (SELECT Date, daily_return, volatility_5d, market_trend FROM {ind} _i
                 WHERE symbol = 'SPY') s ON d.Date = s.Date)"""
    t = f"""(SELECT *, lead(daily_return) OVER (ORDER BY Date) AS next_day_return,
        CASE WHEN count(daily_return) OVER {f3} = 3 THEN avg(daily_return) OVER {f3} END
          AS next_3day_return FROM {merged} _t)"""
    t2 = f"""(SELECT *, {flag('next_day_return > 0')} AS next_day_positive,
        {flag('abs(next_day_return) > 0.01')} AS next_day_big_move,
        {flag('next_3day_return > 0')} AS next_3day_positive FROM {t} _u)"""
    return f"""(SELECT t2.*, v.VIX, v.vix_change, v.high_fear FROM {t2} t2
      LEFT JOIN (SELECT Date, Close AS VIX, daily_return AS vix_change, high_fear FROM {ind} _v
                 WHERE symbol = '^VIX') v ON t2.Date = v.Date)"""


EXCLUDED = {"Date", "next_day_return", "next_day_positive", "next_day_big_move",
            "next_3day_return", "next_3day_positive", "next_day_sentiment", "next_3day_sentiment",
            "daily_return", "Date_y"}


def feature_matrix(rel: str, columns: list[str]) -> str:
    w = "(ORDER BY Date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    items = [c if c in EXCLUDED else f"coalesce(last_value({c} IGNORE NULLS) OVER {w}, 0) AS {c}"
             for c in columns]
    return f"(SELECT {', '.join(items)} FROM {rel} _fm)"


def time_folds(rel: str) -> str:
    return f"""WITH d AS (SELECT Date, row_number() OVER (ORDER BY Date) - 1 AS row_idx FROM {rel} _r),
      k AS (SELECT n, CASE WHEN n < 5 THEN 0 WHEN n < 10 THEN 3 ELSE least(3, n // 5) END AS k
            FROM (SELECT count(*) AS n FROM {rel} _n) _n2),
      ks AS (SELECT n, k, n // (k + 1) AS s FROM k),
      x AS (SELECT d.*, ks.*, unnest(range(0, ks.k)) AS fold FROM d, ks)
      SELECT CAST(fold AS INTEGER) AS fold, role, CAST(row_idx AS INTEGER) AS row_idx, Date FROM (
        SELECT *, CASE WHEN row_idx < n - (k - fold) * s THEN 'train'
                       WHEN row_idx < n - (k - fold) * s + s THEN 'test' END AS role FROM x) _y
      WHERE role IS NOT NULL"""


def ordered_split(rel: str) -> str:
    return f"""SELECT Date, CAST(row_idx AS INTEGER) AS row_idx,
        CASE WHEN row_idx < greatest(3, CAST(trunc(n * 0.7) AS BIGINT)) THEN 'train' ELSE 'test' END AS role
      FROM (SELECT Date, row_number() OVER (ORDER BY Date) - 1 AS row_idx FROM {rel} _r) d,
           (SELECT count(*) AS n FROM {rel} _n) c"""


def summary(rel: str) -> str:
    return f"""SELECT total_days, start_date, end_date, {r6('avg_headlines_per_day')} AS avg_headlines_per_day,
        {r6('avg_sentiment')} AS avg_sentiment, {r6('sentiment_volatility')} AS sentiment_volatility,
        {r6('min_sentiment')} AS min_sentiment, {r6('max_sentiment')} AS max_sentiment,
        most_positive_day, most_negative_day,
        CASE WHEN avg_headlines_per_day > 10 THEN 'Good' ELSE 'Low' END AS data_quality,
        CASE WHEN sentiment_volatility < 0.2 THEN 'High' ELSE 'Variable' END AS sentiment_consistency
      FROM (SELECT count(*) AS total_days, min(Date) AS start_date, max(Date) AS end_date,
              avg(headline_count) AS avg_headlines_per_day, {exact_mean('avg_sentiment', 4)} AS avg_sentiment,
              stddev_samp(avg_sentiment) AS sentiment_volatility, min(avg_sentiment) AS min_sentiment,
              max(avg_sentiment) AS max_sentiment,
              (SELECT Date FROM {rel} _p ORDER BY avg_sentiment DESC, Date LIMIT 1) AS most_positive_day,
              (SELECT Date FROM {rel} _q ORDER BY avg_sentiment, Date LIMIT 1) AS most_negative_day
            FROM {rel} _s) _t"""


def extreme_days(rel: str) -> str:
    return f"""SELECT (SELECT Date FROM {rel} _p ORDER BY avg_sentiment DESC, Date LIMIT 1) AS most_positive_day,
        (SELECT {r6('max(avg_sentiment)')} FROM {rel} _a) AS most_positive_value,
        (SELECT Date FROM {rel} _q ORDER BY avg_sentiment, Date LIMIT 1) AS most_negative_day,
        (SELECT {r6('min(avg_sentiment)')} FROM {rel} _b) AS most_negative_value"""


def correlation(rel: str, a: str, b: str) -> str:
    return f"""SELECT {r6(f'corr({a}, {b})')} AS correlation, count(*) AS n_pairs
      FROM {rel} _c WHERE {a} IS NOT NULL AND {b} IS NOT NULL"""


SCORED_COLUMNS = ["seq", "Time", "Sentiment", "Confidence", "Negative_Probability",
                  "Neutral_Probability", "Positive_Probability", "Predicted_Class"]

_ORD_DAILY = daily_stats(SCORED_ORDERS)
_ORD_HEAD = with_headlines(SCORED_ORDERS)
_ORD_FEAT = feature_table(_ORD_HEAD)
_ORD_MKT = market_targets(_ORD_FEAT, MARKET_SERIES)
_FEAT_COLS = (["Date"] + STAT_COLUMNS + rolling_names() + FLAG_COLUMNS + keyword_names()
              + ["daily_return", "volatility_5d", "market_trend", "next_day_return",
                 "next_day_positive", "next_day_big_move", "next_3day_return",
                 "next_3day_positive", "VIX", "vix_change", "high_fear"])
_INT_COLS = ({"headline_count", "market_trend", "high_fear", "next_day_positive",
              "next_day_big_move", "next_3day_positive"} | set(FLAG_COLUMNS)
             | {c for c in keyword_names() if not c.endswith("_sentiment")})


def _dbl(cols):
    return {c for c in cols if c not in _INT_COLS and c not in ("Date", "symbol", "role")}


ORACLE.update({
    "rolling_features": select_r6(rolling(_ORD_DAILY), ["Date"] + STAT_COLUMNS + rolling_names(),
                                  _dbl(STAT_COLUMNS + rolling_names())),
    "regime_thresholds": select_r6(thresholds(_ORD_DAILY),
                                   ["sentiment_q25", "sentiment_q75", "volatility_q75", "count_q75"],
                                   {"sentiment_q25", "sentiment_q75", "volatility_q75", "count_q75"}),
    "regime_flags": select_r6(flags(_ORD_DAILY), ["Date"] + STAT_COLUMNS + FLAG_COLUMNS,
                              _dbl(STAT_COLUMNS)),
    "keyword_features": select_r6(keyword_features(_ORD_HEAD), ["Date"] + keyword_names(),
                                  _dbl(keyword_names())),
    "keyword_features_word": select_r6(keyword_features(with_headlines(SCORED_EVENTS), "word"),
                                       ["Date"] + keyword_names(), _dbl(keyword_names())),
    "daily_feature_table": select_r6(_ORD_FEAT, ["Date"] + STAT_COLUMNS + rolling_names()
                                     + FLAG_COLUMNS + keyword_names(),
                                     _dbl(STAT_COLUMNS + rolling_names() + keyword_names())),
    "fallback_targets": select_r6(fallback_targets(_ORD_FEAT),
                                  ["Date", "avg_sentiment", "next_day_sentiment", "next_day_positive",
                                   "next_3day_sentiment", "next_3day_positive"],
                                  {"avg_sentiment", "next_day_sentiment", "next_3day_sentiment"}),
    "market_indicators": select_r6(indicators(MARKET_SERIES), INDICATOR_COLUMNS,
                                   {"Close", "daily_return", "volatility_5d", "sma_20", "rsi"}),
    "market_panel_indicators": select_r6(indicators(MARKET_PANEL), INDICATOR_COLUMNS,
                                         {"Close", "daily_return", "volatility_5d", "sma_20", "rsi"}),
    "market_targets": select_r6(_ORD_MKT, [
        "Date", "avg_sentiment", "daily_return", "volatility_5d", "market_trend", "next_day_return",
        "next_day_positive", "next_day_big_move", "next_3day_return", "next_3day_positive", "VIX",
        "vix_change", "high_fear"], {"avg_sentiment", "daily_return", "volatility_5d",
                                     "next_day_return", "next_3day_return", "VIX", "vix_change"}),
    "feature_matrix": select_r6(feature_matrix(_ORD_MKT, _FEAT_COLS), _FEAT_COLS, _dbl(_FEAT_COLS)),
    "time_folds": time_folds(_ORD_DAILY),
    "ordered_split": ordered_split(_ORD_DAILY),
    "run_summary": summary(_ORD_DAILY),
    "extreme_days": extreme_days(_ORD_DAILY),
    "sentiment_histogram": histogram(_ORD_DAILY, "avg_sentiment", 30),
    "sentiment_histogram_small": histogram(daily_stats(SCORED_EVENTS), "avg_sentiment", None),
    "sentiment_return_correlation": correlation(_ORD_MKT, "avg_sentiment", "next_day_return"),
    "feed_page": f"""SELECT *, CAST(10 + row_number() OVER (ORDER BY seq) AS BIGINT) AS global_index
        FROM (SELECT * FROM {SCORED_EVENTS} _s ORDER BY seq LIMIT 5 OFFSET 10) _p""",
    "feed_pages": f"""SELECT *, CAST((global_index - 1) // 5 + 1 AS BIGINT) AS page,
        CAST((global_index - 1) % 5 + 1 AS INTEGER) AS position_in_page
        FROM (SELECT *, row_number() OVER (ORDER BY seq) AS global_index FROM {SCORED_EVENTS} _s) _p""",
    "page_count": f"SELECT CAST(ceil(count(*) / 5) AS BIGINT) AS pages FROM {SCORED_EVENTS} _s",
})


# --- raw feed, time completion and parsing, lexicon scoring, metrics ----------------


AS_OF = "2024-01-31"

RAW_FEED = f"""(SELECT e.seq, e.Time,
      CASE WHEN e.event_type = 'error' THEN 'Loading…' ELSE h.Headline END AS Headline
    FROM (SELECT event_id AS seq, event_type,
            CASE WHEN event_type = 'view' THEN strftime(ts, '%Y-%m-%d %I:%M%p')
                 WHEN event_type = 'click' THEN strftime(ts, '%I:%M%p')
                 WHEN event_type = 'signup' THEN strftime(ts, '%b-%d')
                 ELSE strftime(ts, '%Y-%m-%d') END AS Time FROM events) e
    CROSS JOIN (SELECT count(*) AS n FROM documents) nd
    LEFT JOIN (SELECT doc_id, text AS Headline FROM documents) h ON h.doc_id = e.seq % nd.n)"""


def complete_time(x: str, as_of: str = AS_OF) -> str:
    s = f"trim({x})"
    months = " OR ".join(f"contains({s}, '{m}')" for m in MONTH_ABBREVIATIONS)
    year = as_of[:4]
    return f"""(CASE WHEN {s} IS NULL THEN NULL
      WHEN length({s}) > 8 AND (contains({s}, '/') OR contains({s}, '-')) THEN {s}
      WHEN {months} THEN strftime(try_strptime(replace({s}, '-', ' ') || ' {year}', '%b %d %Y'), '%Y-%m-%d')
      WHEN contains(upper({s}), 'AM') OR contains(upper({s}), 'PM') OR contains({s}, ':')
        THEN '{as_of} ' || {s}
      ELSE {s} END)"""


def parse_time(x: str) -> str:
    s = f"trim({x})"
    return f"""(CASE WHEN {s} IS NULL OR {s} = '' OR starts_with(lower({s}), 'loading') THEN NULL
      WHEN regexp_full_match({s}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN try_strptime({s}, '%Y-%m-%d')
      ELSE coalesce(try_strptime(upper({s}), '%Y-%m-%d %I:%M%p'), TRY_CAST({s} AS TIMESTAMP)) END)"""


COMPLETED_FEED = f"""(SELECT seq, Time AS raw_time, {complete_time('Time')} AS Time, Headline
    FROM {RAW_FEED} _r WHERE Headline IS DISTINCT FROM 'Loading…')"""


def _word_count(low: str, words: list[str], match: str) -> str:
    if match == "substring":
        return " + ".join(f"CAST(contains({low}, '{w}') AS INTEGER)" for w in words)
    return " + ".join(f"CAST(regexp_matches({low}, '(^|[^a-z0-9]){w}([^a-z0-9]|$)') AS INTEGER)"
                      for w in words)


def lexicon_scored(rel: str, text: str, keep: list[str], match: str = "word") -> str:
    low = f"lower({text})"
    n_pos = _word_count(low, KEYWORDS["bullish"], match)
    n_neg = _word_count(low, KEYWORDS["bearish"], match)
    logits = f"""(SELECT {', '.join(keep)}, CAST(({n_neg}) AS DOUBLE) * 1.0 AS l0, 0.5 AS l1,
        CAST(({n_pos}) AS DOUBLE) * 1.0 AS l2 FROM {rel} _l)"""
    return scored_logits(logits, keep)


def scored_logits(logits: str, keep: list[str]) -> str:
    """Scored columns from a relation with logits l0, l1 and l2."""
    exps = f"""(SELECT *, exp(l0 - m) AS e0, exp(l1 - m) AS e1, exp(l2 - m) AS e2
      FROM (SELECT *, greatest(l0, l1, l2) AS m FROM {logits} _a) _b)"""
    probs = f"(SELECT *, e0 / (e0 + e1 + e2) AS p0, e1 / (e0 + e1 + e2) AS p1, e2 / (e0 + e1 + e2) AS p2 FROM {exps} _c)"
    cls = f"""(SELECT *, CAST(CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS INTEGER) AS cls
      FROM {probs} _d)"""
    return f"""(SELECT {', '.join(keep)},
        CASE cls WHEN 0 THEN 'Negative' WHEN 1 THEN 'Neutral' WHEN 2 THEN 'Positive' END AS Sentiment,
        {r4('CASE cls WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END')} AS Confidence,
        {r4('p0')} AS Negative_Probability, {r4('p1')} AS Neutral_Probability,
        {r4('p2')} AS Positive_Probability, cls AS Predicted_Class FROM {cls} _e)"""


def metrics_per_class(pairs: str) -> str:
    return f"""(WITH cm AS (SELECT label, prediction, count(*) AS n FROM {pairs} _p GROUP BY 1, 2),
      per AS (SELECT cls, sum(t) AS support, sum(p) AS predicted, sum(tp) AS tp FROM (
          SELECT label AS cls, n AS t, 0 AS p, CASE WHEN label = prediction THEN n ELSE 0 END AS tp FROM cm
          UNION ALL SELECT prediction AS cls, 0 AS t, n AS p, 0 AS tp FROM cm) _u GROUP BY cls),
      per2 AS (SELECT *, CASE WHEN predicted != 0 THEN tp / predicted ELSE 0.0 END AS precision,
                         CASE WHEN support != 0 THEN tp / support ELSE 0.0 END AS recall FROM per)
      SELECT *, CASE WHEN precision + recall != 0 THEN 2 * precision * recall / (precision + recall)
                     ELSE 0.0 END AS f1 FROM per2)"""


def class_report(pairs: str) -> str:
    return f"""SELECT cls, {r6('precision')} AS precision, {r6('recall')} AS recall, {r6('f1')} AS f1,
        CAST(support AS BIGINT) AS support FROM {metrics_per_class(pairs)} _m"""


def classification_metrics(pairs: str) -> str:
    tot = "sum(support)"

    def sd(x):
        return f"CASE WHEN {tot} != 0 THEN {x} / {tot} ELSE 0.0 END"
    return f"""SELECT {r6(sd('sum(tp)'))} AS accuracy, {r6(sd('sum(precision * support)'))} AS precision,
        {r6(sd('sum(recall * support)'))} AS recall, {r6(sd('sum(f1 * support)'))} AS f1,
        {r6('avg(precision)')} AS macro_precision, {r6('avg(recall)')} AS macro_recall,
        {r6('avg(f1)')} AS macro_f1, CAST({tot} AS BIGINT) AS support
      FROM {metrics_per_class(pairs)} _m"""


_AGREE = (f"(SELECT label, Predicted_Class AS prediction FROM "
          f"{lexicon_scored(f'(SELECT seq, Headline, Predicted_Class AS label FROM {with_headlines(SCORED_EVENTS)} _h)', 'Headline', ['seq', 'label'])} _s)")

ORACLE.update({
    "feed_times": f"""SELECT seq, raw_time, Time, {parse_time('Time')} AS parsed_at,
        CAST({parse_time('Time')} AS DATE) AS day FROM {COMPLETED_FEED} _f""",
    "feed_lexicon_index": daily_index(
        f"(SELECT {parse_time('Time')} AS Time, Predicted_Class, Confidence FROM "
        f"{lexicon_scored(COMPLETED_FEED, 'Headline', ['Time'])} _x)"),
    "score_documents": "SELECT * FROM " + lexicon_scored("documents", "text", ["doc_id"]),
    "score_documents_substring": "SELECT * FROM " + lexicon_scored("documents", "text", ["doc_id"],
                                                                   match="substring"),
    "scorer_agreement": classification_metrics(_AGREE),
    "scorer_class_report": class_report(_AGREE),
})


# --- HTML pages (the driver's pages hold one nav list, a title and an h1) ----------

def unescape(x: str) -> str:
    out = x
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        out = f"replace({out}, '{ent}', '{ch}')"
    return out


def clean(x: str) -> str:
    return f"trim(regexp_replace({x}, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), ' ')"


ORACLE.update({
    "page_list_rows": f"""SELECT page_id, CAST(0 AS INTEGER) AS table_idx,
        CAST(i - 1 AS INTEGER) AS row_idx, {clean(unescape("regexp_replace(item, '<[^>]*>', '', 'g')"))} AS text,
        CAST(1 AS INTEGER) AS n_cells
      FROM (SELECT page_id, unnest(items) AS item, generate_subscripts(items, 1) AS i
            FROM (SELECT page_id, regexp_extract_all(html, '<li>(.*?)</li>', 1) AS items FROM pages) _a) _b""",
    "page_headings": f"""SELECT page_id,
        {clean(unescape("regexp_extract(html, '<title>(.*?)</title>', 1)"))} AS title,
        {clean(unescape("regexp_extract(html, '<h1>(.*?)</h1>', 1)"))} AS h1 FROM pages""",
})


# --- published outputs and status ----------------------------------------------------

def freshness(rel: str, time_expr: str, name: str, as_of: str = "2024-01-31 00:00:00") -> str:
    return f"""SELECT '{name}' AS table_name, count(*) AS rows, count(*) > 0 AS has_data,
        max(_t) AS last_update,
        (max(_t) IS NULL OR max(_t) < TIMESTAMP '{as_of}' - INTERVAL 1 HOUR) AS stale
      FROM (SELECT {time_expr} AS _t FROM {rel} _r) _f"""


_FEED_SCORED = lexicon_scored(COMPLETED_FEED, "Headline", ["seq", "Time"])
_FEED_INDEX = daily_index(f"(SELECT {parse_time('Time')} AS Time, Predicted_Class, Confidence "
                          f"FROM {_FEED_SCORED} _x)")

ORACLE.update({
    "published_index": _FEED_INDEX,
    "published_scored_csv": f"SELECT * FROM {lexicon_scored(COMPLETED_FEED, 'Headline', ['seq', 'Time', 'Headline'])} _p",
    "snapshot_status": " UNION ALL ".join(
        f"""SELECT '{name}' AS table_name, count(*) AS rows, count(*) > 0 AS has_data,
          TIMESTAMP '2024-01-30 23:30:00' AS last_update, false AS stale FROM ({rel}) _t"""
        for name, rel in (("scored", f"SELECT * FROM {_FEED_SCORED} _s"), ("index", _FEED_INDEX))),
    "feed_freshness": freshness(COMPLETED_FEED, parse_time("Time"), "feed"),
})


# --- modelling: deterministic parts -------------------------------------------------------

def _r2(rel: str, y: str, x: str) -> str:
    return f"""WITH v AS (SELECT {y} AS y, {x} AS x FROM {rel} _r WHERE {x} IS NOT NULL AND {y} IS NOT NULL),
      c AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(y) AS m FROM v)
      SELECT {r6('b')} AS slope, {r6('a')} AS intercept,
        {r6('1.0 - sum((y - (a + b * x)) ** 2) / sum((y - m) ** 2)')} AS r2
      FROM v, c GROUP BY a, b"""


ORACLE.update({
    "split_assignment": """SELECT d.doc_id, l.quality AS label,
        CASE WHEN ('0x' || substr(md5(CAST(d.doc_id AS VARCHAR)), 1, 7))::BIGINT % 10 < 7
             THEN 'train' ELSE 'test' END AS split
      FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "regression_r2": _r2(fallback_targets(_ORD_FEAT), "next_day_sentiment", "avg_sentiment"),
})

ORACLE.update({
    "streaming_daily_index": daily_index(SCORED_EVENTS),
})


# --- option paths and small reports ---------------------------------------------------

def rolling_range(rel: str) -> str:
    parts, mom = [], []
    for w in WINDOWS:
        fr = f"(ORDER BY _day RANGE BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"

        def mean(c, fr=fr):
            return f"(CAST(sum(CAST({c} AS DECIMAL(24,4))) OVER {fr} AS DOUBLE) / count({c}) OVER {fr})"
        parts += [
            f"{mean('avg_sentiment')} AS sentiment_ma_{w}d",
            f"stddev_samp(avg_sentiment) OVER {fr} AS sentiment_std_{w}d",
            f"{mean('avg_weighted_sentiment')} AS weighted_sentiment_ma_{w}d",
            f"{mean('headline_count')} AS headline_count_ma_{w}d",
            f"{mean('avg_confidence')} AS confidence_ma_{w}d",
            f"CASE WHEN count(avg_sentiment) OVER {fr} = {w} "
            f"THEN regr_slope(avg_sentiment, _day) OVER {fr} END AS sentiment_trend_{w}d",
        ]
        mom.append(f"sentiment_ma_{w}d - lag(sentiment_ma_{w}d) OVER (ORDER BY Date) "
                   f"AS sentiment_momentum_{w}d")
    inner = (f"(SELECT *, {', '.join(parts)} FROM (SELECT *, CAST(date_diff('day', DATE '1970-01-01', Date) "
             f"AS DOUBLE) AS _day FROM {rel} _a) _b)")
    return f"(SELECT * EXCLUDE (_day), {', '.join(mom)} FROM {inner} _c)"


def daily_stats_exact(scored: str) -> str:
    rows = f"""(SELECT *, Time AS Date, Positive_Probability - Negative_Probability AS s,
        (Positive_Probability - Negative_Probability) * Confidence AS w
      FROM {scored} _r WHERE Time IS NOT NULL)"""
    return f"(SELECT Date, {', '.join(_stat_exprs())} FROM {rows} _d GROUP BY Date)"


_FEED_SCORED_TS = (f"(SELECT {parse_time('Time')} AS Time, Confidence, Negative_Probability, "
                   f"Neutral_Probability, Positive_Probability FROM {lexicon_scored(COMPLETED_FEED, 'Headline', ['Time'])} _x)")
_ORD_HEAD_KW = with_headlines(SCORED_ORDERS)
_MERGE_COLS = ["Date"] + STAT_COLUMNS + keyword_names()

ORACLE.update({
    "index_series": f"SELECT Time, Daily_Sentiment_Index FROM ({daily_index(SCORED_EVENTS)}) _i",
    "daily_stats_exact_grain": select_r6(daily_stats_exact(_FEED_SCORED_TS), ["Date"] + STAT_COLUMNS,
                                         _dbl(STAT_COLUMNS)),
    "rolling_features_range": select_r6(rolling_range(_ORD_DAILY), ["Date"] + STAT_COLUMNS + rolling_names(),
                                        _dbl(STAT_COLUMNS + rolling_names())),
    "fallback_targets_null_unknown": select_r6(
        f"""(SELECT *, CAST(next_day_sentiment > 0 AS INTEGER) AS next_day_positive,
              CAST(next_3day_sentiment > 0 AS INTEGER) AS next_3day_positive
            FROM (SELECT *, lead(avg_sentiment) OVER (ORDER BY Date) AS next_day_sentiment,
              CASE WHEN count(avg_sentiment) OVER (ORDER BY Date ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) = 3
                   THEN CAST(sum(CAST(avg_sentiment AS DECIMAL(24,4))) OVER (ORDER BY Date ROWS BETWEEN
                        1 FOLLOWING AND 3 FOLLOWING) AS DOUBLE) / 3 END AS next_3day_sentiment
              FROM {_ORD_FEAT} _t) _u)""",
        ["Date", "avg_sentiment", "next_day_sentiment", "next_day_positive", "next_3day_sentiment",
         "next_3day_positive"], {"avg_sentiment", "next_day_sentiment", "next_3day_sentiment"}),
    "keyword_merge": select_r6(
        f"""(SELECT d.Date, {', '.join('d.' + c for c in STAT_COLUMNS)},
              {', '.join(f'coalesce(k.{c}, 0) AS {c}' for c in keyword_names())}
            FROM {daily_stats(_ORD_HEAD_KW)} d LEFT JOIN {keyword_features(_ORD_HEAD_KW)} k ON d.Date = k.Date)""",
        _MERGE_COLS, _dbl(STAT_COLUMNS + keyword_names())),
    "feed_preview": f"SELECT * FROM {SCORED_EVENTS} _s ORDER BY seq LIMIT 5",
    "date_range": f"SELECT min(Date) AS start_date, max(Date) AS end_date FROM {_ORD_DAILY} _d",
    "confidence_sentiment_correlation": correlation(_ORD_DAILY, "avg_confidence", "avg_sentiment"),
})

ORACLE.update({
    "dashboard_sentiment_series": select_r6(_ORD_FEAT, ["Date", "avg_sentiment", "sentiment_ma_7d"],
                                            {"avg_sentiment", "sentiment_ma_7d"}),
})


# --- tables, scorers, finer grains ------------------------------------------------------

_NATIONS = "(SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS j FROM nation)"
_EXACT = daily_stats_exact(_FEED_SCORED_TS)
_LENGTHS = """(SELECT doc_id, 0.0::DOUBLE AS l0, 1.0::DOUBLE AS l1, (length(coalesce(text, '')) % 3)::DOUBLE AS l2
    FROM documents)"""
_SHIFTED_MARKET = f"(SELECT symbol, Date + 9862 AS Date, Close FROM {MARKET_SERIES} _m)"

ORACLE.update({
    "page_tables": f"""SELECT CAST(n_regionkey AS BIGINT) AS page_id, 0 AS table_idx,
          CAST(2 * j AS INTEGER) AS row_idx, n_nationkey || '|' || n_name || '|R' || n_regionkey AS cells FROM {_NATIONS} _a
        UNION ALL SELECT n_regionkey, 0, CAST(2 * j + 1 AS INTEGER), n_nationkey || '||' FROM {_NATIONS} _b
        UNION ALL SELECT n_regionkey, CAST(j + 1 AS INTEGER), 0, n_name || '|' || n_nationkey FROM {_NATIONS} _c""",
    "page_headline_rows": f"""SELECT CAST(page_id AS BIGINT) AS page_id, 0 AS table_idx,
          CAST(row_idx AS INTEGER) AS row_idx, {complete_time('Time')} AS Time, Headline
        FROM (SELECT n_regionkey AS page_id, 2 * j AS row_idx, n_name AS Time, 'R' || n_regionkey AS Headline FROM {_NATIONS} _a
              UNION ALL SELECT n_regionkey, 2 * j + 1, '', '' FROM {_NATIONS} _b) _r""",
    "sentiment_labels": """SELECT doc_id, Sentiment, CAST(CASE Sentiment WHEN 'Negative' THEN 0 WHEN 'Neutral' THEN 1
          ELSE 2 END AS INTEGER) AS label
        FROM (SELECT doc_id, CASE WHEN toxic = 1 THEN 'Negative' WHEN quality = 1 THEN 'Positive' ELSE 'Neutral' END
                AS Sentiment FROM documents JOIN labels USING (doc_id)) _l""",
    "batch_scored_documents": f"SELECT * FROM {scored_logits(_LENGTHS, ['doc_id'])} _s",
    "rolling_features_exact": select_r6(
        rolling(_EXACT), ["Date", "avg_sentiment", "sentiment_ma_3d", "sentiment_ma_7d", "sentiment_std_7d",
                          "headline_count_ma_7d"],
        {"avg_sentiment", "sentiment_ma_3d", "sentiment_ma_7d", "sentiment_std_7d", "headline_count_ma_7d"}),
    "market_targets_exact": select_r6(
        f"""(SELECT *, {flag('next_day_return > 0')} AS next_day_positive FROM (
            SELECT d.Date, s.daily_return, lead(s.daily_return) OVER (ORDER BY d.Date) AS next_day_return
            FROM {_EXACT} d LEFT JOIN (SELECT Date, daily_return FROM {indicators(_SHIFTED_MARKET)} _i
              WHERE symbol = 'SPY') s ON CAST(d.Date AS DATE) = s.Date) _t)""",
        ["Date", "daily_return", "next_day_return", "next_day_positive"], {"daily_return", "next_day_return"}),
    "feed_pages_sparse": f"""SELECT *, CAST((global_index - 1) // 5 + 1 AS BIGINT) AS page,
        CAST((global_index - 1) % 5 + 1 AS INTEGER) AS position_in_page
        FROM (SELECT seq, key, row_number() OVER (ORDER BY key) AS global_index FROM (
          SELECT seq, ('0x' || left(md5(CAST(seq AS VARCHAR)), 15))::BIGINT AS key FROM {SCORED_EVENTS} _s) _k) _p""",
    "feed_newest_first": f"""SELECT seq, Time, row_number() OVER (ORDER BY {parse_time('Time')} DESC NULLS LAST, seq) AS place
        FROM {COMPLETED_FEED} _f""",
})

ORACLE["incremental_scored"] = f"SELECT *, CAST({parse_time('Time')} AS DATE) AS day FROM {_FEED_SCORED} _s"

_LONG = (1_000, 10_000)
ORACLE.update({
    "rolling_features_range_exact": select_r6(rolling_range(_EXACT), ["Date"] + STAT_COLUMNS + rolling_names(),
                                              _dbl(STAT_COLUMNS + rolling_names())),
    "rolling_features_long": select_r6(rolling(_EXACT, _LONG), ["Date"] + rolling_names(_LONG), set(rolling_names(_LONG))),
    "regime_flags_exact_grain": select_r6(flags(_EXACT), ["Date", "avg_sentiment"] + FLAG_COLUMNS, {"avg_sentiment"}),
    "score_quantiles": f"""SELECT Sentiment, {', '.join(
        f"{r6(f'quantile_cont({c}, {p})')} AS {short}_q{round(100 * p):02d}" for short, c in (
            ('confidence', 'Confidence'), ('positive', 'Positive_Probability'), ('negative', 'Negative_Probability'))
        for p in (0.05, 0.25, 0.5, 0.75, 0.95))} FROM {SCORED_ORDERS} _s GROUP BY Sentiment""",
})

_FEATURE_NAMES = STAT_COLUMNS + keyword_names()
ORACLE.update({
    "published_headlines": f"SELECT Time, Headline FROM {lexicon_scored(COMPLETED_FEED, 'Headline', ['Time', 'Headline'])} _p",
    "published_scored_json": ORACLE["published_scored_csv"],
    "incremental_daily_index": daily_index(SCORED_EVENTS),
    "incremental_daily_features": select_r6(daily_features(with_headlines(SCORED_EVENTS)), ["Date"] + _FEATURE_NAMES,
                                            _dbl(_FEATURE_NAMES)),
    "refreshed_new_rows": _FEED_INDEX,
    "streaming_states_index": daily_index(SCORED_EVENTS),
    "compacted_daily_index": daily_index(SCORED_EVENTS),
})


def _linear_scores() -> str:
    """Two-variable normal equations from covariances; a model with one variable has a zero for the other."""
    base = f"""(SELECT *, row_number() OVER (ORDER BY Date) - 1 AS i, count(*) OVER () AS n FROM (
        SELECT Date, avg_confidence AS c, headline_count::DOUBLE AS v, avg_sentiment,
          lead(avg_sentiment) OVER (ORDER BY Date) AS next_day_sentiment,
          CASE WHEN count(avg_sentiment) OVER w = 3 THEN avg(avg_sentiment) OVER w END AS next_3day_sentiment
        FROM {_ORD_DAILY} _o WINDOW w AS (ORDER BY Date ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)) _p WHERE {{y}} IS NOT NULL)"""
    models = (("confidence", "c", "0.0"), ("volume", "v", "0.0"), ("both", "c", "v"))
    parts = []
    for y in ("next_day_sentiment", "next_3day_sentiment"):
        for name, a, b in models:
            two = b != "0.0"
            slopes = (f"""(covar_pop({y}, {a}) * var_pop({b}) - covar_pop({y}, {b}) * covar_pop({a}, {b}))
                / (var_pop({a}) * var_pop({b}) - covar_pop({a}, {b}) ** 2) AS p,
                (covar_pop({y}, {b}) * var_pop({a}) - covar_pop({y}, {a}) * covar_pop({a}, {b}))
                / (var_pop({a}) * var_pop({b}) - covar_pop({a}, {b}) ** 2) AS q""" if two else
                      f"regr_slope({y}, {a}) AS p, 0.0 AS q")
            parts.append(f"""SELECT '{y}' AS target, '{name}' AS model, CAST(f.fold AS INTEGER) AS fold,
                1 - sum((x.{y} - (f.my + f.p * (x.{a} - f.ma) + f.q * ({'x.' + b if two else '0.0'} - f.mb))) ** 2)
                  / (var_pop(x.{y}) * count(*)) AS score, 1 AS fold_ok, CAST(f.st AS INTEGER) AS n_train,
                CAST(count(*) AS INTEGER) AS n_test
              FROM (SELECT k.fold, k.st, k.s, avg({y}) AS my, avg({a}) AS ma, avg({b}) AS mb, {slopes}
                    FROM {base.format(y=y)} t, (SELECT fold, n - (3 - fold) * (n // 4) AS st, n // 4 AS s
                      FROM (SELECT count(*) AS n FROM {base.format(y=y)} _n), range(3) r(fold)) k
                    WHERE t.i < k.st GROUP BY k.fold, k.st, k.s) f,
                   {base.format(y=y)} x WHERE x.i >= f.st AND x.i < f.st + f.s GROUP BY f.fold, f.st""")
    return f"({' UNION ALL '.join(parts)})"


_SCORES = _linear_scores()
_SUMMARY = f"""(SELECT target, model, avg(score) AS mean_score, stddev_pop(score) AS std_score, count(score) AS n_folds
    FROM {_SCORES} _s GROUP BY target, model)"""
_DAILY_MKT = market_targets(_ORD_DAILY, MARKET_SERIES)
ORACLE.update({
    "linear_fold_scores": select_r6(_SCORES, ["target", "model", "fold", "score", "fold_ok", "n_train", "n_test"], {"score"}),
    "linear_model_summary": select_r6(_SUMMARY, ["target", "model", "mean_score", "std_score", "n_folds"],
                                      {"mean_score", "std_score"}),
    "linear_best_models": select_r6(f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target
        ORDER BY mean_score DESC NULLS LAST, model) AS r FROM {_SUMMARY} _s) _r WHERE r = 1)""",
                                    ["target", "model", "mean_score"], {"mean_score"}),
    "dashboard_top_features": f"""SELECT feature, {r6('importance')} AS importance,
        CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS place FROM (
          SELECT unnest(['avg_confidence', 'headline_count']) AS feature, unnest([abs(p), abs(q)]) AS importance FROM (
            SELECT (covar_pop(y, c) * var_pop(v) - covar_pop(y, v) * covar_pop(c, v)) / (var_pop(c) * var_pop(v) - covar_pop(c, v) ** 2) AS p,
                   (covar_pop(y, v) * var_pop(c) - covar_pop(y, c) * covar_pop(c, v)) / (var_pop(c) * var_pop(v) - covar_pop(c, v) ** 2) AS q
            FROM (SELECT lead(avg_sentiment) OVER (ORDER BY Date) AS y, avg_confidence AS c, headline_count::DOUBLE AS v
                  FROM {_ORD_DAILY} _o) _p WHERE y IS NOT NULL) _q) _i""",
    "dashboard_scatter": select_r6(f"(SELECT * FROM {_DAILY_MKT} _m WHERE next_day_return IS NOT NULL AND avg_sentiment IS NOT NULL)",
                                   ["avg_sentiment", "next_day_return"], {"avg_sentiment", "next_day_return"}),
    "simplified_dashboard_series": select_r6(_ORD_FEAT, ["Date", "avg_sentiment", "sentiment_ma_3d"],
                                             {"avg_sentiment", "sentiment_ma_3d"}),
    "simplified_dashboard_correlation": correlation(_DAILY_MKT, "avg_sentiment", "daily_return"),
    "market_run_summary": f"""SELECT s.*, m.market_correlation, m.mean_return FROM ({summary(_ORD_DAILY)}) s,
        (SELECT {r6('corr(avg_sentiment, daily_return)')} AS market_correlation, {r6('avg(daily_return)')} AS mean_return
         FROM {_DAILY_MKT} _m) m""",
})

ORACLE.update({
    "feed_last_page": f"""SELECT * FROM (SELECT *, row_number() OVER (ORDER BY seq) AS global_index FROM {SCORED_EVENTS} _s) _p
        WHERE global_index > 5 * (SELECT (count(*) - 1) // 5 FROM {SCORED_EVENTS} _n)""",
    "keyword_dictionary_hits": """WITH words AS (SELECT DISTINCT unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM benchmark),
        hits AS (SELECT d.doc_id, length(w) % 2 AS odd, count(*) AS n FROM documents d, words
                 WHERE length(w) BETWEEN 5 AND 8 AND contains(lower(d.text), w) GROUP BY d.doc_id, odd)
        SELECT d.doc_id, CAST(coalesce(e.n, 0) AS INTEGER) AS even_n, CAST(coalesce(o.n, 0) AS INTEGER) AS odd_n
        FROM documents d LEFT JOIN hits e ON d.doc_id = e.doc_id AND e.odd = 0
        LEFT JOIN hits o ON d.doc_id = o.doc_id AND o.odd = 1""",
})
