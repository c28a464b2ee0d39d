"""A whole analysis of one table: profile, tests, series, anomalies, leakage and findings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from assayer.operators import anomaly, inference, leakage, metrics, temporal
from assayer.operators import evidence as E
from assayer.operators import profile as P
from assayer.operators.normalize import normalize


@dataclass
class Analysis:
    profile: DataFrame
    tests: DataFrame
    evidence: DataFrame
    findings: DataFrame
    recommendations: DataFrame
    hypotheses: DataFrame
    outliers: DataFrame | None = None  # quartile fences per numeric column
    anomalies: DataFrame | None = None  # the most unusual flagged rows with what drives them
    omitted: DataFrame | None = None  # numeric columns of the anomaly review and why some are left out
    change_points: DataFrame | None = None
    forecast: DataFrame | None = None


def analyze(df: DataFrame, key, target: str | None = None, ts: str | None = None, measure: str | None = None, columns=None,
            nominal=(), as_of=None, anomalies: bool = True, most_numeric: int | None = None, most_categories: int | None = None,
            most_scored: int | None = None) -> Analysis:
    """Runs the steps that the roles of the columns allow, over all rows and, unless limited, all usable columns."""
    table = normalize(df)
    profile = P.profile(table, key, as_of)
    roles = {r["column"]: r for r in P.roles(profile).collect()}
    numeric = [c for c, r in roles.items() if r["usable_numeric"] and c not in nominal]
    categories = [c for c, r in roles.items() if r["bounded_category"] or c in nominal]
    dates = [c for c, r in roles.items() if r["is_date"]]
    chosen = list(columns or dict.fromkeys([*([target] if target else []), *numeric[:most_numeric], *categories[:most_categories]]))
    tests = inference.test_pairs(table, profile, chosen, nominal, key)
    parts = [E.from_profile(P.profile_totals(profile)), E.from_tests(tests)]
    ts, measure = ts or (dates[0] if dates else None), measure or (target if target in numeric else numeric[0] if numeric else None)
    more = {"outliers": P.outliers(table, numeric)} if numeric else {}
    if ts and measure:
        parts.insert(1, E.from_temporal(temporal.temporal_summary(table, ts, measure), measure, ts))
        series = temporal.calendar_series(table, ts, measure)
        more |= {"change_points": temporal.change_points(series), "forecast": temporal.forecast(series)}
    if anomalies and numeric:
        more["omitted"] = anomaly.column_review(table, numeric, most_scored)
        varying = [r["feature"] for r in more["omitted"].collect() if r["scored"]]  # a row per column
        if varying:
            rows = table.count()
            scored = anomaly.isolation_forest(anomaly.deviations(table, varying, key, rows), varying, key, rows=rows)
            parts.append(E.from_anomalies(anomaly.flag_summary(scored)))
            more["anomalies"] = anomaly.drivers(anomaly.worst_rows(scored, key), varying)
    if target:
        parts.append(E.from_leakage(leakage.leakage(table, target, profile), target))
        if target in categories:
            parts.append(E.from_balance(metrics.class_balance(table, target), target))
    evidence = E.evidence(*parts)
    found = E.findings(evidence)
    return Analysis(profile, tests, evidence, found, E.recommendations(found), E.hypotheses(evidence), **more)
