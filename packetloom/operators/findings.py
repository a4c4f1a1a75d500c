"""The table of findings that all detectors add to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: stage: ARP 0, reassembly 1, HTTP 2, TLS 3, Modbus 4, DNP3 5, EtherNet/IP 6; at and sub order findings within one.
COLUMNS = ["stage", "at", "sub", "category", "verdict", "confidence", "summary", "evidence", "mitre_techniques", "source_ip", "ts", "direction"]
MOST = 10_000
CAPPED = (1, 4, 5, 6)
#: The place of a stage's closing finding, behind all others and outside the cap.
LAST = 2**62


def finding(category: str | Column, verdict: str | Column, confidence: str | Column, summary: Column, evidence: Column, techniques: list[str] | Column, sub: int, source_ip: Column | None = None, direction: str | Column | None = None) -> Column:
    """A struct of the columns that a detector decides on."""
    lit = lambda x, kind="string": (x if isinstance(x, Column) else F.lit(x)).cast(kind)
    if not isinstance(techniques, Column):
        techniques = F.array(*[F.lit(t) for t in techniques]).cast("array<string>")
    return F.struct(
        F.lit(sub).alias("sub"), lit(category).alias("category"), lit(verdict).alias("verdict"), lit(confidence).alias("confidence"), lit(summary).alias("summary"),
        evidence.cast("array<string>").alias("evidence"), techniques.alias("mitre_techniques"), lit(source_ip).alias("source_ip"), lit(direction).alias("direction"),
    )


def rows(df: DataFrame, stage: int, at: Column, ts: Column, found: list[tuple[Column, Column]]) -> DataFrame:
    """One row for each (condition, finding) that holds for a row of ``df``."""
    each = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), f) for c, f in found]))
    out = df.select(F.lit(stage).alias("stage"), at.cast("long").alias("at"), ts.cast("long").alias("_ts"), F.explode(each).alias("f"))
    return out.select("stage", "at", "f.*", F.timestamp_seconds("_ts").alias("ts")).select(*COLUMNS)


def capped(found: DataFrame, most: int = MOST) -> DataFrame:
    """The first ``most`` findings of each stage but ARP, HTTP and TLS, which have no cap; those at ``LAST`` pass it.

    The cap is the feature of the report, not of detection: it bounds what a reader sees,
    and :func:`dropped` tells how many it leaves out. Each task keeps its own first ones,
    so no task gets all findings of a stage.
    """
    out = found.where(~F.col("stage").isin(*CAPPED) | (F.col("at") == LAST))
    for stage in CAPPED:
        out = out.unionByName(found.where((F.col("stage") == stage) & (F.col("at") != LAST)).orderBy("at", "sub").limit(most))
    return out


def dropped(found: DataFrame, most: int = MOST) -> dict[int, int]:
    """The number of findings that :func:`capped` leaves out of each capped stage."""
    n = {r.stage: r.n for r in found.where(F.col("stage").isin(*CAPPED) & (F.col("at") != LAST)).groupBy("stage").agg(F.count("*").alias("n")).collect()}
    return {stage: max(0, n.get(stage, 0) - most) for stage in CAPPED}


def hex4(value: Column) -> Column:
    """``0x00FF``: at least four digits."""
    return F.concat(F.lit("0x"), F.lpad(F.hex(value), 4, "0"))


def hex2(value: Column) -> Column:
    return F.concat(F.lit("0x"), F.lpad(F.hex(value), 2, "0"))
