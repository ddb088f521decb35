"""Plain SQL for profiles, drift and model quality, written against the definitions and not against the engine."""

from __future__ import annotations

FIXED = ("5 minutes", "30 minutes", "1 hour", "1 day", "1 week", "2 weeks", "3 weeks", "4 weeks")
KEYS = "granularity, ws, we, slice_key, slice_value"


def start_of(granularity: str, ts: str) -> str:
    if granularity in FIXED:
        return f"time_bucket(INTERVAL '{granularity}', {ts}, TIMESTAMP '1970-01-01 00:00:00')"
    return f"date_trunc('{granularity.split()[1]}', {ts})"


def windowed(source: str, ts: str | None, granularities: list[str], slices: list[str]) -> str:
    """Every row once per granularity and slice."""
    parts = []
    for granularity in granularities or [None]:
        if granularity is None:
            window = "CAST(NULL AS VARCHAR) AS granularity, CAST(NULL AS TIMESTAMP) AS ws, CAST(NULL AS TIMESTAMP) AS we"
        else:
            start = start_of(granularity, ts)
            window = f"'{granularity}' AS granularity, {start} AS ws, {start} + INTERVAL '{granularity}' AS we"
        for name in [None, *slices]:
            if name is None:
                key = "CAST(NULL AS VARCHAR) AS slice_key, CAST(NULL AS VARCHAR) AS slice_value"
            else:
                key = f"'{name}' AS slice_key, CAST({name} AS VARCHAR) AS slice_value"
            parts.append(f"SELECT {window}, {key}, s.* FROM ({source}) s")
    return " UNION ALL ".join(parts)


def profile(
    source: str,
    ts: str | None,
    granularities: list[str],
    slices: list[str],
    numbers: list[str],
    others: list[str] = (),
    log_type: str = "INPUT",
) -> str:
    """Unrounded profile rows."""
    parts = [
        f"SELECT {KEYS}, ':table' AS column_name, count(*) AS record_count, CAST(NULL AS BIGINT) AS null_count, "
        "CAST(NULL AS DOUBLE) AS null_rate, CAST(NULL AS BIGINT) AS distinct_count, CAST(NULL AS DOUBLE) AS mean, "
        "CAST(NULL AS DOUBLE) AS stddev, CAST(NULL AS DOUBLE) AS min_value, CAST(NULL AS DOUBLE) AS max_value "
        f"FROM w GROUP BY ALL"
    ]
    for name in [*numbers, *others]:
        if name in numbers:
            stats = (
                f"avg(CAST({name} AS DOUBLE)), stddev_samp(CAST({name} AS DOUBLE)), "
                f"min(CAST({name} AS DOUBLE)) + 0.0, max(CAST({name} AS DOUBLE)) + 0.0"
            )
        else:
            stats = ", ".join(["CAST(NULL AS DOUBLE)"] * 4)
        parts.append(
            f"SELECT {KEYS}, '{name}', count(*), count(*) - count({name}), "
            f"(count(*) - count({name}))::DOUBLE / count(*), count(DISTINCT {name}), {stats} FROM w GROUP BY {KEYS}"
        )
    rows = " UNION ALL ".join(parts)
    return (
        f"(WITH w AS ({windowed(source, ts, granularities, slices)}) "
        f"SELECT ws AS window_start, we AS window_end, granularity, '{log_type}' AS log_type, slice_key, slice_value, "
        f"column_name, record_count, null_count, null_rate, distinct_count, mean, stddev, min_value, max_value "
        f"FROM ({rows}))"
    )


_SAME = " AND ".join(f"a.{k} IS NOT DISTINCT FROM b.{k}" for k in ("granularity", "slice_key", "slice_value"))
_PAIR = "granularity, ws, we, slice_key, slice_value, column_name"


def drift(
    source: str,
    ts: str,
    granularities: list[str],
    slices: list[str],
    numbers: list[str],
    texts: list[str],
    baseline: str | None = None,
) -> str:
    """Unrounded drift rows: consecutive windows, or every window against a baseline query."""
    number_counts = " UNION ALL ".join(
        f"SELECT {KEYS}, '{c}' AS column_name, CASE WHEN isfinite(CAST({c} AS DOUBLE)) THEN CAST({c} AS DOUBLE) + 0.0 END AS v, "
        f"CASE WHEN NOT isfinite(CAST({c} AS DOUBLE)) THEN CAST({c} AS VARCHAR) END AS t, count(*) AS n "
        f"FROM {{w}} WHERE {c} IS NOT NULL GROUP BY ALL"
        for c in numbers
    )
    text_counts = " UNION ALL ".join(
        f"SELECT {KEYS}, '{c}' AS column_name, CAST(NULL AS DOUBLE) AS v, CAST({c} AS VARCHAR) AS t, count(*) AS n "
        f"FROM {{w}} WHERE {c} IS NOT NULL GROUP BY ALL"
        for c in texts
    )
    counts = " UNION ALL ".join(part for part in (number_counts, text_counts) if part)
    names = ", ".join(f"('{c}')" for c in [*numbers, *texts])
    kind = "CONSECUTIVE" if baseline is None else "BASELINE"
    if baseline is None:
        past = "SELECT * FROM f"
        pairs = (
            "SELECT * FROM (SELECT *, lag(ws) OVER (PARTITION BY granularity, slice_key, slice_value ORDER BY ws) AS before "
            f"FROM (SELECT DISTINCT {KEYS} FROM w)) WHERE before IS NOT NULL"
        )
        matches = f"{_SAME} AND a.before = b.ws"
    else:
        past = counts.format(w="bw")
        pairs = f"SELECT DISTINCT {KEYS} FROM w"
        matches = "a.slice_key IS NOT DISTINCT FROM b.slice_key AND a.slice_value IS NOT DISTINCT FROM b.slice_value"
    before = f"bw AS ({windowed(baseline, None, [], slices)})," if baseline else ""
    keys = "a.granularity, a.ws, a.we, a.slice_key, a.slice_value"
    edges = " + ".join(f"CASE WHEN v >= lo + (hi - lo) * {k}.0 / 10.0 THEN 1 ELSE 0 END" for k in range(1, 10))
    return f"""(WITH w AS ({windowed(source, ts, granularities, slices)}), {before}
f AS ({counts.format(w="w")}),
past AS ({past}),
pairs AS ({pairs}),
both_sides AS (
  SELECT {keys}, b.column_name, b.v, b.t, b.n AS p, 0 AS q FROM pairs a JOIN f b ON {_SAME} AND a.ws IS NOT DISTINCT FROM b.ws
  UNION ALL
  SELECT {keys}, b.column_name, b.v, b.t, 0, b.n FROM pairs a JOIN past b ON {matches}),
vals AS (SELECT {_PAIR}, v, t, sum(p)::DOUBLE AS p, sum(q)::DOUBLE AS q FROM both_sides GROUP BY ALL),
sized AS (SELECT *, sum(p) OVER g AS np, sum(q) OVER g AS nq, min(v) OVER g AS lo, max(v) OVER g AS hi
  FROM vals WINDOW g AS (PARTITION BY {_PAIR})),
usable AS (SELECT * FROM sized WHERE np > 0 AND nq > 0),
cells AS (SELECT {_PAIR}, CASE WHEN v IS NULL THEN t WHEN lo < hi THEN CAST({edges} AS VARCHAR) ELSE '0' END AS cell,
  v IS NULL AS is_text, sum(p) / max(np) AS p, sum(q) / max(nq) AS q, max(np) AS np, max(nq) AS nq
  FROM usable GROUP BY ALL),
terms AS (SELECT {_PAIR}, is_text,
  CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END / 2
  + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END / 2 AS js,
  (greatest(p, 0.0001) - greatest(q, 0.0001)) * ln(greatest(p, 0.0001) / greatest(q, 0.0001)) AS psi,
  np * pow(p - (p * np + q * nq) / (np + nq), 2) / ((p * np + q * nq) / (np + nq))
  + nq * pow(q - (p * np + q * nq) / (np + nq), 2) / ((p * np + q * nq) / (np + nq)) AS chi FROM cells),
shares AS (SELECT {_PAIR}, sqrt(least(greatest(sum(js), 0), 1)) AS js, sum(psi) AS psi,
  CASE WHEN max(column_name) IN ({", ".join(f"'{c}'" for c in texts) or "''"}) THEN sum(chi) END AS chi FROM terms GROUP BY ALL),
finite AS (SELECT {_PAIR}, v, p / nullif(sum(p) OVER g, 0) - q / nullif(sum(q) OVER g, 0) AS step
  FROM usable WHERE v IS NOT NULL WINDOW g AS (PARTITION BY {_PAIR})),
walk AS (SELECT {_PAIR}, abs(sum(step) OVER o) AS gap, lead(v) OVER o - v AS width FROM finite WINDOW o AS (PARTITION BY {_PAIR} ORDER BY v)),
gaps AS (SELECT {_PAIR}, max(gap) AS ks, CASE WHEN max(gap) IS NOT NULL THEN coalesce(sum(gap * width), 0) END AS wd FROM walk GROUP BY ALL),
every_row AS (SELECT {KEYS}, n.column_name FROM pairs CROSS JOIN (VALUES {names}) n(column_name))
SELECT a.ws AS window_start, a.we AS window_end, a.granularity, '{kind}' AS drift_type, a.slice_key, a.slice_value,
  a.column_name, s.js AS js_distance, g.ks AS ks_statistic, g.wd AS wasserstein_distance,
  s.chi AS chi_square_statistic, s.psi AS psi
FROM every_row a
LEFT JOIN shares s ON {_join("s")}
LEFT JOIN gaps g ON {_join("g")})"""


def _join(alias: str) -> str:
    columns = ("granularity", "ws", "slice_key", "slice_value", "column_name")
    return " AND ".join(f"a.{c} IS NOT DISTINCT FROM {alias}.{c}" for c in columns)


CLASSIFICATION = [
    "accuracy_score", "log_loss", "precision_weighted", "recall_weighted", "f1_weighted", "roc_auc_weighted",
    "predictive_parity", "predictive_equality", "equal_opportunity", "statistical_parity",
]
REGRESSION = [
    "mean_squared_error", "root_mean_squared_error", "mean_average_error", "mean_absolute_percentage_error", "r2_score",
]


def classification(source: str, ts: str, granularities: list[str], slices: list[str], score: str, label: str) -> str:
    """Unrounded scores of a binary model with probabilities."""
    g = " AND ".join(f"a.{k} IS NOT DISTINCT FROM b.{k}" for k in ("granularity", "ws", "slice_key", "slice_value"))
    rate = {
        "predictive_parity": ("tp", "tp + {0}fp"),
        "predictive_equality": ("fp", "fp + {0}tn"),
        "equal_opportunity": ("tp", "tp + {0}fn"),
        "statistical_parity": ("tp + {0}fp", "tp + {0}fp + {0}fn + {0}tn"),
    }
    fair = []
    for name, (top, bottom) in rate.items():
        own = f"(b.{top})::DOUBLE / nullif(b.{bottom}, 0)".format("b.")
        rest = f"(r.{top})::DOUBLE / nullif(r.{bottom}, 0)".format("r.")
        fair.append(f"CASE WHEN b.slice_key IS NOT NULL THEN {own} - {rest} END AS {name}")
    return f"""(WITH w AS ({windowed(source, ts, granularities, slices)}),
l AS (SELECT {KEYS}, CAST({score} AS DOUBLE) + 0.0 AS score, {label} AS label,
  CASE WHEN {score} >= 0.5 THEN 1 ELSE 0 END AS guess FROM w WHERE {score} IS NOT NULL AND {label} IS NOT NULL),
m AS (SELECT {KEYS}, count(*) AS n, sum(CASE WHEN label = 1 AND guess = 1 THEN 1 ELSE 0 END) AS tp,
  sum(CASE WHEN label = 0 AND guess = 1 THEN 1 ELSE 0 END) AS fp,
  sum(CASE WHEN label = 1 AND guess = 0 THEN 1 ELSE 0 END) AS fn,
  sum(CASE WHEN label = 0 AND guess = 0 THEN 1 ELSE 0 END) AS tn,
  avg(CASE WHEN score BETWEEN 0 AND 1 THEN
    -ln(least(greatest(CASE WHEN label = 1 THEN score ELSE 1 - score END, 1e-15), 1 - 1e-15)) END) AS log_loss
  FROM l GROUP BY {KEYS}),
c AS (SELECT *, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS p1, coalesce(tn::DOUBLE / nullif(tn + fn, 0), 0) AS p0,
  coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS r1, coalesce(tn::DOUBLE / nullif(tn + fp, 0), 0) AS r0 FROM m),
ranked AS (SELECT {KEYS}, label, rank() OVER (PARTITION BY {KEYS} ORDER BY score)
  + (count(*) OVER (PARTITION BY {KEYS}, score) - 1) / 2.0 AS mid FROM l),
auc AS (SELECT {KEYS}, (sum(CASE WHEN label = 1 THEN mid END)
  - sum(label)::DOUBLE * (sum(label) + 1) / 2) / nullif(sum(label)::DOUBLE * sum(1 - label), 0) AS auc
  FROM ranked GROUP BY {KEYS}),
rest AS (SELECT a.granularity, a.ws, a.slice_key, a.slice_value, t.tp - a.tp AS tp, t.fp - a.fp AS fp,
  t.fn - a.fn AS fn, t.tn - a.tn AS tn FROM m a JOIN m t ON a.granularity IS NOT DISTINCT FROM t.granularity
  AND a.ws IS NOT DISTINCT FROM t.ws AND t.slice_key IS NULL)
SELECT b.ws AS window_start, b.we AS window_end, b.granularity, ':table' AS column_name,
  (tp_ + tn_)::DOUBLE / b.n AS accuracy_score, b.log_loss,
  (p1 * (tp_ + fn_) + p0 * (tn_ + fp_)) / b.n AS precision_weighted,
  (r1 * (tp_ + fn_) + r0 * (tn_ + fp_)) / b.n AS recall_weighted,
  (coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0) * (tp_ + fn_)
   + coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0) * (tn_ + fp_)) / b.n AS f1_weighted,
  a.auc AS roc_auc_weighted, {", ".join(fair)},
  {", ".join(f"CAST(NULL AS DOUBLE) AS {name}" for name in REGRESSION)}, b.slice_key, b.slice_value
FROM (SELECT *, tp AS tp_, fp AS fp_, fn AS fn_, tn AS tn_ FROM c) b
JOIN auc a ON {g}
JOIN rest r ON b.granularity IS NOT DISTINCT FROM r.granularity AND b.ws IS NOT DISTINCT FROM r.ws
  AND b.slice_key IS NOT DISTINCT FROM r.slice_key AND b.slice_value IS NOT DISTINCT FROM r.slice_value)"""


def one_vs_one(source: str, ts: str, granularities: list[str], slices: list[str], scores: dict[str, str], label: str) -> str:
    """Unrounded area under the curve of several classes: every class against every other one, by ranks, weighted by rows."""
    ranked = " UNION ALL ".join(
        f"SELECT {KEYS}, '{a}' AS k, '{b}' AS j, {label} = '{a}' AS mine, rank() OVER (PARTITION BY {KEYS} ORDER BY {scores[a]}) "
        f"+ (count(*) OVER (PARTITION BY {KEYS}, {scores[a]}) - 1) / 2.0 AS mid FROM w WHERE {label} IN ('{a}', '{b}')"
        for a in scores
        for b in scores
        if a != b
    )
    return f"""(WITH w AS ({windowed(source, ts, granularities, slices)}), ranked AS ({ranked}),
areas AS (SELECT {KEYS}, k, j, count(*) AS n, (sum(mid) FILTER (mine) - count(*) FILTER (mine) * (count(*) FILTER (mine) + 1) / 2.0)
  / nullif(count(*) FILTER (mine) * count(*) FILTER (NOT mine), 0) AS area FROM ranked GROUP BY {KEYS}, k, j)
SELECT ws AS window_start, granularity, slice_key, slice_value,
  sum(area * n) / sum(CASE WHEN area IS NOT NULL THEN n END) AS roc_auc_weighted FROM areas GROUP BY {KEYS})"""


def regression(
    source: str, ts: str, granularities: list[str], slices: list[str], prediction: str, label: str, every: bool = False
) -> str:
    """Unrounded scores of a regression model; ``every`` keeps windows without a labelled row."""
    error = f"({prediction} - {label})"
    known = f"CASE WHEN {error} IS NOT NULL THEN {label} END"
    kept = "" if every else f"HAVING count({error}) > 0"
    return f"""(WITH w AS ({windowed(source, ts, granularities, slices)})
SELECT ws AS window_start, we AS window_end, granularity, ':table' AS column_name,
  {", ".join(f"CAST(NULL AS DOUBLE) AS {name}" for name in CLASSIFICATION)},
  avg(pow({error}, 2)) AS mean_squared_error, sqrt(avg(pow({error}, 2))) AS root_mean_squared_error,
  avg(abs({error})) AS mean_average_error,
  avg(CASE WHEN {label} <> 0 THEN abs({error} / {label}) END) AS mean_absolute_percentage_error,
  CASE WHEN var_pop({known}) > 0 THEN 1 - sum(pow({error}, 2)) / (var_pop({known}) * count({error})) END AS r2_score,
  slice_key, slice_value
FROM w GROUP BY {KEYS} {kept})"""


def rounded_columns(doubles: list[str]) -> str:
    return ", ".join(f"round({name}, 6) AS {name}" for name in doubles)
