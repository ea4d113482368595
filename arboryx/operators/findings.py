"""What a check of ingested entries finds, and the counts by which the state of a graph is watched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What can be found, in the order of the rules, with its severity.
SEVERITY = {
    "ingest_report_missing": "medium",
    "ingest_failed": "high",
    "ingest_partial": "medium",
    "low_resolution_quality": "low",
    "high_schema_violation_rate": "medium",
    "high_parse_error_rate": "medium",
    "no_issue_observed": "info",
}


def entry_findings(entries: DataFrame, reports: DataFrame, low_ratio: float = 0.5, schema_rate: float = 0.1, parse_rate: float = 0.1) -> DataFrame:
    """(entry_id, run_id, type, severity, evidence array): one finding per entry, by the first rule that holds.

    ``entries`` is (entry_id, run_id), ``reports`` (run_id, status, verdict, reasoning, low_tier_ratio, schema_violation_rate,
    parse_error_rate), of which a run has one; of several the largest row counts. An entry without a run, or whose run has no report,
    is missing its report; null rates are below any threshold.
    """
    one = reports.groupBy("run_id").agg(F.max(F.struct(*[c for c in reports.columns if c != "run_id"])).alias("r"))
    told = entries.select("entry_id", "run_id").join(one, "run_id", "left")
    r = F.col("r")
    either = lambda states, verdicts: r["status"].isin(*states) | r["verdict"].isin(*verdicts)
    said = F.array(F.concat(F.lit("status="), F.coalesce(r["status"], F.lit(""))), F.concat(F.lit("verdict="), F.coalesce(r["verdict"], F.lit(""))), F.concat(F.lit("verdict_reasoning="), F.coalesce(r["reasoning"], F.lit(""))))
    rate = lambda name, most: F.array(F.format_string(f"{name}=%.4f", r[name]), F.lit(f"threshold={most:.4f}"))
    rules: list[tuple[str, Column, Column]] = [
        ("ingest_report_missing", r.isNull(), F.array(F.concat(F.lit("missing ingest report for pool_entry_id="), F.col("entry_id").cast("string")))),
        ("ingest_failed", either(["failed"], ["failed"]), said),
        ("ingest_partial", either(["partial"], ["partial", "poor"]), said),
        ("low_resolution_quality", r["low_tier_ratio"] >= low_ratio, rate("low_tier_ratio", low_ratio)),
        ("high_schema_violation_rate", r["schema_violation_rate"] >= schema_rate, rate("schema_violation_rate", schema_rate)),
        ("high_parse_error_rate", r["parse_error_rate"] >= parse_rate, rate("parse_error_rate", parse_rate)),
        ("no_issue_observed", F.lit(True), F.array(F.lit("no structural issue in the ingest report"))),
    ]
    found = F.lit(None)
    for name, holds, evidence in reversed(rules):
        found = F.when(F.coalesce(holds, F.lit(False)), F.struct(F.lit(name).alias("type"), F.lit(SEVERITY[name]).alias("severity"), evidence.alias("evidence"))).otherwise(found)
    return told.select("entry_id", "run_id", found.alias("f")).select("entry_id", "run_id", "f.*")


def immune_metrics(pool: DataFrame, findings: DataFrame, reports: DataFrame, newest: int = 200, agents: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(metric, key, n): the counts of one snapshot.

    ``pool`` is (entry_id, state, findings), ``findings`` (id, cell, type, severity, resolved_at, action), ``reports`` (type, run_id, verdict, ... counters).
    Entries in all and by state, with their findings; findings by cell, type and severity, and those that are not
    resolved (no time, or the action "none"); verdicts of the ``newest`` query and ingest reports by run_id;
    and the counters that ``agents`` names of the newest report of each of their types. What has no rows has no metric but the totals.
    """
    row = lambda df, metric, key, n=F.count("*"): df.groupBy(key.cast("string").alias("key")).agg(n.cast("long").alias("n")).select(F.lit(metric).alias("metric"), "key", "n")
    total = lambda df, metric, n: df.agg(F.coalesce(n, F.lit(0)).cast("long").alias("n")).select(F.lit(metric).alias("metric"), F.lit("").alias("key"), "n")
    open_ = F.col("resolved_at").isNull() | (F.col("action") == "none")
    parts = [total(pool, "pool_total", F.count("*")), row(pool, "pool_state", F.col("state")), total(pool, "pool_findings", F.sum("findings"))]
    parts += [row(findings, f"finding_{c}", F.col(c)) for c in ("cell", "type", "severity")] + [total(findings, "finding_unresolved", F.count_if(open_))]
    ranked = reports.withColumn("_r", F.row_number().over(Window.partitionBy("type").orderBy(F.desc("run_id"))))
    for kind in ("query", "ingest"):
        some = ranked.where((F.col("type") == kind) & (F.col("_r") <= newest))
        parts += [total(some, f"{kind}_scanned", F.count("*")), row(some.where("verdict is not null"), f"{kind}_verdict", F.col("verdict"))]
    for kind, counters in (agents or {}).items():
        last = ranked.where((F.col("type") == kind) & (F.col("_r") == 1))
        each = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("long").alias("n")) for c in counters])
        parts.append(last.select(F.lit(f"latest_{kind}").alias("metric"), F.inline(each)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
