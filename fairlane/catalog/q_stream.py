"""Batch forms of the stream monitors (X1-X3, X5) on ``events``; the stream
forms are checked equal to these in tests/test_streaming.py."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from fairlane.catalog import register
from fairlane.session import checkpoint_dir
from fairlane.sources.tables import hash_bucket_sql, load
from fairlane.streaming import audit, drift
from fairlane.streaming import followup as fol
from fairlane.streaming import monitors as mon

DEC_SQL = f"""
dec AS (SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, CAST(user_id % 5 AS VARCHAR) AS grp,
               CAST(event_type = 'purchase' AS INTEGER) AS approved,
               (CAST(event_type = 'purchase' AS INTEGER) * 1000 + {hash_bucket_sql('p', 'event_id', 1000)}) / 2000e0
                 AS score
        FROM events WHERE event_type IN ('purchase', 'error'))"""


@register("x1_monitor_fairness_batch", dbl=["dpd"], ctes=DEC_SQL, sql="""
WITH c AS (SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, grp, count(*) AS n,
                  CAST(sum(approved) AS BIGINT) AS approved FROM dec GROUP BY 1, 2)
SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, max(approved / n) - min(approved / n) AS dpd, count(*) AS n_groups, sum(n) AS n,
       CASE WHEN max(approved / n) - min(approved / n) > 0.1 THEN 'immediate review'
            WHEN max(approved / n) - min(approved / n) > 0.05 THEN 'alert' ELSE 'ok' END AS level
FROM c GROUP BY window_start""")
def fairness_batch(spark, d):
    return mon.dpd_by_window(mon.fairness_counts(mon.decisions(load(spark, d, "events"))))


@register("x2_monitor_volume_batch", dbl=["error_rate"], ctes=DEC_SQL, sql="""
SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, time_bucket(INTERVAL '1 day', ts) + INTERVAL 1 DAY AS window_end,
       count(*) AS volume,
       count_if(approved = 0) AS errors, count_if(approved = 0) / count(*) AS error_rate FROM dec GROUP BY 1, 2""")
def volume_batch(spark, d):
    return mon.volume(mon.decisions(load(spark, d, "events")))


@register("x3_monitor_performance_batch", dbl=["auc", "accuracy", "f1", "auc_before"], ctes=DEC_SQL, sql="""
WITH j AS (SELECT *, ts + to_hours(CAST(event_id % 96 AS INTEGER)) AS outcome_ts FROM dec),
k AS (SELECT time_bucket(INTERVAL '7 days', ts, TIMESTAMP '1970-01-01') AS window_start, score,
             count_if(approved = 1) AS pos, count_if(approved = 0) AS neg
      FROM j WHERE outcome_ts >= ts AND outcome_ts <= ts + INTERVAL 3 DAY GROUP BY 1, 2),
a AS (SELECT *, sum(neg) OVER (PARTITION BY window_start ORDER BY score
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_neg FROM k),
g AS (SELECT window_start, sum(pos * (cum_neg - neg + neg / 2e0)) / (sum(pos) * sum(neg)) AS auc,
             sum(CASE WHEN score >= 0.5 THEN pos ELSE neg END) / sum(pos + neg) AS accuracy,
             2e0 * sum(CASE WHEN score >= 0.5 THEN pos ELSE 0 END)
               / (2e0 * sum(CASE WHEN score >= 0.5 THEN pos ELSE 0 END) + sum(CASE WHEN score < 0.5 THEN pos ELSE 0 END)
                  + sum(CASE WHEN score >= 0.5 THEN neg ELSE 0 END)) AS f1,
             sum(pos + neg) AS n FROM a GROUP BY window_start)
SELECT *, window_start + INTERVAL 7 DAY AS window_end, auc < 0.75 OR accuracy < 0.9 OR f1 < 0.85 AS retrain,
       lag(auc) OVER (ORDER BY window_start) AS auc_before,
       coalesce(auc < lag(auc) OVER (ORDER BY window_start) * 0.95, false) AS dropped FROM g""")
def performance_batch(spark, d):
    ev = load(spark, d, "events")
    j = mon.joined_outcomes(mon.decisions(ev), mon.outcomes(ev))
    return mon.auc_drops(mon.performance_by_window(mon.performance_counts(j)))


@register("x3_unmatched_outcomes", ctes=DEC_SQL, sql="""
SELECT time_bucket(INTERVAL '7 days', ts, TIMESTAMP '1970-01-01') AS window_start,
       time_bucket(INTERVAL '7 days', ts, TIMESTAMP '1970-01-01') + INTERVAL 7 DAY AS window_end, count(*) AS predictions,
       CAST(0 AS BIGINT) AS without_outcome, count_if(event_id % 96 > 72) AS too_late FROM dec GROUP BY 1, 2""")
def unmatched(spark, d):
    ev = load(spark, d, "events")
    return mon.unmatched_outcomes(mon.decisions(ev), mon.outcomes(ev))


@register("x5_audit_log_batch", dbl=["score"], ctes=DEC_SQL, sql="""
SELECT DISTINCT event_id, ts, grp, approved, score, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS pred,
       CAST(ts AS DATE) AS date FROM dec""")
def audit_batch(spark, d):
    dec = mon.decisions(load(spark, d, "events"))
    return dec.dropDuplicates(["event_id"]).withColumn("date", F.to_date("ts"))


# Outcomes come up to 95 hours after a decision: those of more than 84 never come within patience.
PATIENCE = "84 hours"
FOLLOWED_SQL = f"""
users AS (SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, CAST(user_id % 5 AS VARCHAR) AS grp,
                 CAST({hash_bucket_sql('a', 'user_id', 3)} AS VARCHAR) AS area, CAST(event_type = 'purchase' AS INTEGER) AS approved,
                 (CAST(event_type = 'purchase' AS INTEGER) * 1000 + {hash_bucket_sql('p', 'event_id', 1000)}) / 2000e0 AS score,
                 {hash_bucket_sql('m', 'event_id', 1000)} / 1000e0 AS shadow_score, event_id % 96 AS delay
          FROM events WHERE event_type IN ('purchase', 'error')),
rows AS (SELECT ts, grp, area, m.model, CASE m.model WHEN 'formula' THEN score ELSE shadow_score END AS score,
                CASE WHEN delay <= 72 THEN approved END AS y, delay > 72 AND delay <= 84 AS too_late, delay > 84 AS missing
         FROM users, (VALUES ('formula'), ('shadow')) m(model))"""


def _followed(spark, d):
    ev = load(spark, d, "events")
    return fol.by_model(fol.followed(fol.monitored_decisions(ev), mon.outcomes(ev), patience=PATIENCE), fol.MODELS)


@register("x1_fairness_follow_up_batch", dbl=["dpd", "eod"], ctes=FOLLOWED_SQL, sql="""
WITH long AS (SELECT ts, model, y, CAST(score >= 0.5 AS INTEGER) AS pred, 'grp' AS attribute, grp FROM rows
              UNION ALL SELECT ts, model, y, CAST(score >= 0.5 AS INTEGER), 'area', area FROM rows),
g AS (SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, model, attribute, grp, count(*) AS n, sum(pred) / count(*) AS rate,
             avg(pred) FILTER (y = 1) AS tpr, avg(pred) FILTER (y = 0) AS fpr, count(y) AS labelled FROM long GROUP BY 1, 2, 3, 4),
s AS (SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, model, attribute, max(rate) - min(rate) AS dpd,
             coalesce(greatest(max(tpr) - min(tpr), max(fpr) - min(fpr)), 0e0) AS eod, count(*) AS n_groups,
             CAST(sum(n) AS BIGINT) AS n, CAST(sum(labelled) AS BIGINT) AS labelled FROM g GROUP BY ALL)
SELECT *, CASE WHEN greatest(dpd, eod) > 0.1 THEN 'immediate review' WHEN greatest(dpd, eod) > 0.05 THEN 'alert' ELSE 'ok' END AS level
FROM s""")
def fairness_follow_up(spark, d):
    return fol.fairness_by_window(fol.group_windows(_followed(spark, d), fol.ATTRIBUTES))


@register("x3_performance_follow_up_batch", dbl=["auc", "accuracy", "f1", "auc_before"], ctes=FOLLOWED_SQL, sql="""
WITH k AS (SELECT time_bucket(INTERVAL '7 days', ts, TIMESTAMP '1970-01-01') AS window_start, model, score, count_if(y = 1) AS pos,
                  count_if(y = 0) AS neg, count(*) AS predictions, count_if(too_late) AS too_late, count_if(missing) AS missing
           FROM rows GROUP BY 1, 2, 3),
a AS (SELECT *, sum(neg) OVER (PARTITION BY window_start, model ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM k),
g AS (SELECT window_start, window_start + INTERVAL 7 DAY AS window_end, model,
             sum(pos * (cum - neg + neg / 2e0)) / (sum(pos) * sum(neg)) AS auc,
             sum(CASE WHEN score >= 0.5 THEN pos ELSE neg END) / sum(pos + neg) AS accuracy,
             2e0 * sum(CASE WHEN score >= 0.5 THEN pos ELSE 0 END)
               / (2e0 * sum(CASE WHEN score >= 0.5 THEN pos ELSE 0 END) + sum(CASE WHEN score < 0.5 THEN pos ELSE neg END)) AS f1,
             CAST(sum(pos + neg) AS BIGINT) AS n, CAST(sum(predictions) AS BIGINT) AS predictions,
             CAST(sum(too_late) AS BIGINT) AS too_late, CAST(sum(missing) AS BIGINT) AS missing FROM a GROUP BY 1, 2, 3),
r AS (SELECT *, auc < 0.75 OR accuracy < 0.9 OR f1 < 0.85 AS retrain, lag(auc) OVER (PARTITION BY model ORDER BY window_start) AS auc_before FROM g)
SELECT *, coalesce(auc < auc_before * 0.95, false) AS dropped, retrain OR coalesce(auc < auc_before * 0.95, false) AS retrain_signal FROM r""")
def performance_follow_up(spark, d):
    return fol.with_window_before(fol.performance_windows(fol.score_windows(_followed(spark, d))))


# A score card on a request's inputs.
COEFS, MEANS, INTERCEPT = {"value": 0.02, "hour": -0.05, "weekday": 0.1}, {"value": 50.0, "hour": 12.0, "weekday": 4.0}, -0.3


@register("x5_prediction_audit_batch", dbl=["score", "input", "contribution"], sql="""
WITH r AS (SELECT event_id AS request_id, CAST(ts AS TIMESTAMP) AS ts, CAST(value AS DOUBLE) AS v, CAST(hour(ts) AS DOUBLE) AS h,
                  CAST(dayofweek(ts) + 1 AS DOUBLE) AS w FROM events WHERE event_type IN ('purchase', 'error')),
c AS (SELECT *, 0.02e0 * (coalesce(v, 50e0) - 50e0) AS cv, -0.05e0 * (h - 12e0) AS ch, 0.1e0 * (w - 4e0) AS cw FROM r),
s AS (SELECT *, 1e0 / (1e0 + exp(-(-0.3e0 + 0.02e0 * 50e0 - 0.05e0 * 12e0 + 0.1e0 * 4e0 + cv + ch + cw))) AS score FROM c),
l AS (SELECT *, unnest(['value', 'hour', 'weekday']) AS feature, unnest([v, h, w]) AS input, unnest([cv + 0e0, ch + 0e0, cw + 0e0]) AS contribution FROM s)
SELECT request_id, ts, CAST(ts AS DATE) AS date, 'card' AS model, '1' AS version, score,
       CASE WHEN score >= 0.5 THEN 'approved' ELSE 'denied' END AS decision, feature, input, contribution FROM l""")
def prediction_audit(spark, d):
    """Written as a batch twice, compacted up to a day, and read back."""
    sink = f"{checkpoint_dir(spark).rstrip('/')}/audit-{uuid.uuid4().hex}"
    rows = audit.audited(audit.requests(load(spark, d, "events")), "card", "1", COEFS, MEANS, INTERCEPT)
    for _ in range(2):
        audit.write_batch(rows, sink, 0)
    audit.compact(spark, sink, dt.date(2024, 1, 15))
    return audit.audit_cells(audit.audit_rows(spark, sink))


BASE_END = "2024-01-11"


def drift_inputs(events):
    """Two numeric inputs of an event, and its time."""
    ts = F.col("ts").cast("timestamp")
    return events.select(ts.alias("ts"), F.col("value").cast("double").alias("value"), F.pmod(F.col("user_id"), F.lit(97)).cast("double").alias("user_part"))


@register("x4_drift_windows_batch", dbl=["psi", "ks"], sql=f"""
WITH v AS (SELECT CAST(ts AS TIMESTAMP) AS ts, unnest(['value', 'user_part']) AS feature,
                  unnest([CAST(value AS DOUBLE), CAST(user_id % 97 AS DOUBLE)]) AS x FROM events),
e AS (SELECT feature, list_sort(list_distinct(quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) AS e
      FROM v WHERE ts < TIMESTAMP '{BASE_END}' GROUP BY feature),
b AS (SELECT ts, v.feature, CASE WHEN x IS NULL THEN -1 ELSE len(list_filter(e, lambda q: q < x)) END AS bin FROM v JOIN e ON v.feature = e.feature),
s AS (SELECT feature, bin, count(*) / sum(count(*)) OVER (PARTITION BY feature) AS share FROM b WHERE ts < TIMESTAMP '{BASE_END}' GROUP BY 1, 2),
c AS (SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, feature, bin, count(*) AS n FROM b GROUP BY 1, 2, 3),
g AS (SELECT window_start, w.feature, r.bin FROM (SELECT DISTINCT window_start, feature FROM c) w
      JOIN (SELECT feature, unnest(range(-1, len(e) + 1)) AS bin FROM e) r ON r.feature = w.feature),
j AS (SELECT g.window_start, g.feature, g.bin, coalesce(n, 0) AS n, coalesce(share, 0e0) AS share FROM g
      LEFT JOIN c ON c.window_start = g.window_start AND c.feature = g.feature AND c.bin = g.bin
      LEFT JOIN s ON s.feature = g.feature AND s.bin = g.bin),
k AS (SELECT *, sum(n) OVER w AS rows, sum(CASE WHEN bin >= 0 THEN n END) OVER o AS cn, sum(CASE WHEN bin >= 0 THEN n END) OVER w AS tn,
             sum(CASE WHEN bin >= 0 THEN share END) OVER o AS cb, sum(CASE WHEN bin >= 0 THEN share END) OVER w AS tb
      FROM j WINDOW w AS (PARTITION BY window_start, feature),
                    o AS (PARTITION BY window_start, feature ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
p AS (SELECT *, greatest(n / rows, 1e-4) AS now, greatest(share, 1e-4) AS then FROM k),
d AS (SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, feature, CAST(max(rows) AS BIGINT) AS n,
             sum((now - p.then) * ln(now / p.then)) AS psi, max(abs(cn / tn - cb / tb)) FILTER (bin >= 0) AS ks FROM p GROUP BY 1, 2, 3)
SELECT *, CASE WHEN psi > 0.25 THEN 'major' WHEN psi > 0.1 THEN 'moderate' ELSE 'none' END AS drift FROM d""")
def drift_windows(spark, d):
    rows = drift_inputs(load(spark, d, "events"))
    base = drift.fit_baseline(rows.where(F.col("ts") < F.lit(BASE_END).cast("timestamp")), ["value", "user_part"])
    base = drift.Baseline.load(spark, base.save(spark, f"{checkpoint_dir(spark).rstrip('/')}/baseline-{uuid.uuid4().hex}"))
    return drift.drift_by_window(drift.bin_windows(rows, base), base)
