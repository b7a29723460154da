"""Queries of the rate screens."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import screen
from lectern.plans import adapters as A


def wps_units(spark, d):
    return A.units(spark, d).select("book_id", "idx", "doc_id", "words", "seconds", F.round("wps", 9).alias("wps"))


def wps_median_mad(spark, d):
    return screen.median_mad(A.units(spark, d)).select("book_id", "n", "n_finite", F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"))


def wps_gate(spark, d):
    own = screen.wps_gate(A.units(spark, d))
    return own.select("book_id", "idx", "doc_id", F.round("wps", 6).alias("wps"), "reason", F.round("dev", 6).alias("dev"), "cause", "rank")


def wps_gate_tight(spark, d):
    """With a tolerance and band that many units break, so that all reasons occur."""
    own = screen.wps_gate(A.units(spark, d), 0.06, 2.2, 2.7)
    return own.select("book_id", "idx", "doc_id", F.round("wps", 6).alias("wps"), "reason", F.round("dev", 6).alias("dev"), "cause", "rank")


def wps_gate_header(spark, d):
    own = screen.wps_header(screen.wps_gate(A.units(spark, d)))
    return own.select("book_id", "n", "n_finite", F.round("median", 6).alias("median"), "too_few", "n_flagged", "systematic", "systematic_reason", "ok")


def wps_pairs(spark, d):
    return screen.adjacent_pairs(screen.wps_gate(A.units(spark, d), 0.06, 2.2, 2.7))


def wps_advisory(spark, d):
    own = screen.wps_advisory(A.units(spark, d), 0.15, 6.0)
    return own.select("book_id", "idx", "wps", F.round("dev_pct", 6).alias("dev_pct"), F.round("dev_mad", 6).alias("dev_mad"), "flagged")


def starved(spark, d):
    return A.units(spark, d).select("book_id", "idx", screen.starved(F.col("words"), F.col("seconds"), F.lit(2.5), F.lit(0.9)).alias("starved"))


def unmeasured_fallback(spark, d):
    own = A.units(spark, d).withColumn("track", F.col("doc_id"))
    third = lambda k: own.where(F.col("track") % 4 == k)
    audio = third(0).select("track", F.col("seconds").alias("dur_sec"))
    man = third(1).select("track", (F.col("seconds") / 60).alias("minutes"))
    plan = third(2).select("track", F.lit(1.0).alias("start"), (F.col("seconds") + 1.0).alias("end"))
    out = screen.durations(own.select("track", "words"), audio, man, plan)
    return out.select("track", F.round("minutes", 6).alias("minutes"), "measured", F.round("wps", 6).alias("wps"))


def coverage_gap(spark, d):
    own = A.units(spark, d).groupBy("book_id").agg(F.sum(F.when(F.col("idx") < 40, F.col("words")).otherwise(0)).alias("aligned"), F.sum(F.when(F.col("idx") > 48, F.col("words") % 2).otherwise(0)).alias("pending"), F.sum(F.col("seconds") * 15).alias("_t"), F.sum(F.when(F.col("idx") < 40, F.col("seconds") * 15).otherwise(0.0)).alias("_e"))
    own = own.select("book_id", "aligned", "pending", (F.col("_t") / 15).alias("audio_total"), (F.col("_e") / 15).alias("last_end"))
    return screen.coverage(own).select("book_id", "aligned", "pending", F.round("gap", 6).alias("gap"), F.col("code").cast("long").alias("code"))


QUERIES = {f.__name__: f for f in (wps_units, wps_median_mad, wps_gate, wps_gate_tight, wps_gate_header, wps_pairs, wps_advisory, starved, unmeasured_fallback, coverage_gap)}

_OWN = "WITH " + A.UNITS + r""",
own AS (SELECT book_id, idx, doc_id, wps FROM units),
med AS (SELECT book_id, count(*) AS n, median(wps) AS median FROM own GROUP BY 1),
mads AS (SELECT book_id, any_value(n) AS n, any_value(median) AS median, median(abs(wps - median)) AS mad FROM own JOIN med USING (book_id) GROUP BY 1)
"""


def _gate(tol, low, high):
    return _OWN + rf""",
first AS (SELECT *, CASE WHEN n >= 5 AND median > 0 AND abs(wps - median) / median > {tol}::DOUBLE THEN 'relative' WHEN wps < {low}::DOUBLE OR wps > {high}::DOUBLE THEN 'absolute' END AS f FROM own JOIN mads USING (book_id)),
near AS (SELECT *, lag(f) OVER w AS f0, lead(f) OVER w AS f1, lag(wps) OVER w AS w0, lead(wps) OVER w AS w1 FROM first WINDOW w AS (PARTITION BY book_id ORDER BY idx)),
gate AS (SELECT *, coalesce(f, CASE WHEN n >= 5 AND median > 0 AND ((f0 IS NOT NULL AND (w0 - median) * (wps - median) < 0) OR (f1 IS NOT NULL AND (w1 - median) * (wps - median) < 0)) THEN 'association' END) AS reason FROM near),
flags AS (SELECT book_id, idx, doc_id, wps, n, median, reason, round(CASE WHEN median > 0 THEN (wps - median) / median ELSE 0 END, 6) AS dev, CASE WHEN reason IS NULL THEN NULL WHEN wps >= median THEN 'squished' ELSE 'slack' END AS cause,
  CASE WHEN reason IS NOT NULL THEN row_number() OVER (PARTITION BY book_id, reason IS NULL ORDER BY -abs(wps - median), idx) END AS rank FROM gate)
"""


SQL = {
    "wps_units": "WITH " + A.UNITS + " SELECT book_id, idx, doc_id, words, seconds, round(wps, 9) AS wps FROM units",
    "wps_median_mad": _OWN + "SELECT book_id, n, n AS n_finite, round(median, 6) AS median, round(mad, 6) AS mad FROM mads",
    "wps_gate": _gate(0.35, 1.7, 3.5) + "SELECT book_id, idx, doc_id, round(wps, 6) AS wps, reason, dev, cause, rank FROM flags",
    "wps_gate_tight": _gate(0.06, 2.2, 2.7) + "SELECT book_id, idx, doc_id, round(wps, 6) AS wps, reason, dev, cause, rank FROM flags",
    "wps_gate_header": _gate(0.35, 1.7, 3.5)
    + r""", h AS (SELECT book_id, any_value(n) AS n, any_value(median) AS m, count(reason) AS n_flagged FROM flags GROUP BY 1),
s AS (SELECT *, CASE WHEN n < 5 THEN NULL WHEN m NOT BETWEEN 1.7 AND 3.5 THEN 'band' WHEN n_flagged > 0.40 * n THEN 'majority' END AS systematic_reason FROM h)
SELECT book_id, n, n AS n_finite, round(m, 6) AS median, n < 5 AS too_few, n_flagged, systematic_reason IS NOT NULL AS systematic, systematic_reason, n_flagged = 0 AND systematic_reason IS NULL AS ok FROM s""",
    "wps_pairs": _gate(0.06, 2.2, 2.7)
    + "SELECT a.book_id, a.idx, CASE WHEN a.cause = 'slack' THEN a.idx ELSE b.idx END AS low_idx, CASE WHEN a.cause = 'slack' THEN b.idx ELSE a.idx END AS high_idx FROM flags a JOIN flags b ON a.book_id = b.book_id AND b.idx = a.idx + 1 AND a.reason IS NOT NULL AND b.reason IS NOT NULL AND a.cause <> b.cause",
    "wps_advisory": "WITH " + A.UNITS + r""",
own AS (SELECT book_id, idx, CASE WHEN seconds > 0 AND words > 0 THEN round(words / seconds, 3) END AS wps FROM units),
med AS (SELECT book_id, median(wps) AS m FROM own GROUP BY 1),
mads AS (SELECT book_id, any_value(m) AS m, median(abs(wps - m)) AS x FROM own JOIN med USING (book_id) WHERE wps IS NOT NULL GROUP BY 1),
d AS (SELECT book_id, idx, wps, (wps - m) / m * 100 AS p, (wps - m) / CASE WHEN x = 0 THEN 1e-9 ELSE x END AS k FROM own LEFT JOIN mads USING (book_id))
SELECT book_id, idx, wps, round(p, 6) AS dev_pct, round(k, 6) AS dev_mad, coalesce(abs(p) > 15.0 OR abs(k) >= 6.0, false) AS flagged FROM d""",
    "starved": "WITH " + A.UNITS + " SELECT book_id, idx, seconds > 0 AND words < 0.9::DOUBLE * 2.5::DOUBLE * seconds AS starved FROM units",
    "unmeasured_fallback": "WITH " + A.UNITS + r""",
m AS (SELECT doc_id AS track, words, CASE WHEN doc_id % 4 < 3 AND seconds > 0 THEN seconds / 60 END AS minutes FROM units)
SELECT track, round(minutes, 6) AS minutes, minutes IS NOT NULL AS measured, round(coalesce(words / (minutes * 60), 0.0::DOUBLE), 6) AS wps FROM m""",
    "coverage_gap": "WITH " + A.UNITS + r""",
b AS (SELECT book_id, sum(CASE WHEN idx < 40 THEN words ELSE 0 END)::BIGINT AS aligned, sum(CASE WHEN idx > 48 THEN words % 2 ELSE 0 END)::BIGINT AS pending, sum(seconds * 15) / 15 AS t, sum(CASE WHEN idx < 40 THEN seconds * 15 ELSE 0 END) / 15 AS e FROM units GROUP BY 1)
SELECT book_id, aligned, pending, round(t - e, 6) AS gap, CASE WHEN aligned = 0 THEN 1 WHEN pending = 0 AND t - e > greatest(120.0, 0.02 * t) THEN 3 ELSE 0 END::BIGINT AS code FROM b""",
}
