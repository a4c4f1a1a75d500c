"""Reports of an analysis: collapsed and ranked tables, JSON, CSV and terminal text."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.sources.json_sink import JsonDocument

from .mitre import by_tactic, enrich

# The catalogue that techniques are taken from.
MITRE_DOMAIN, MITRE_VERSION = "ics-attack", "ics-attack-19.1"
# Ranks of verdicts and confidences, best first.
VERDICTS = ("Likely", "Possible", "Inconclusive", "Unlikely")
CONFIDENCES = ("High", "Medium", "Low")
EMITTED = ("stage", "at", "sub")
SAMPLES = 3


def rank(value: Column, order: tuple[str, ...]) -> Column:
    out = F.lit(len(order))
    for i, name in reversed(list(enumerate(order))):
        out = F.when(value == name, i).otherwise(out)
    return out


def ranked(findings: DataFrame) -> DataFrame:
    """Findings by tactic, then verdict, confidence and order of emission."""
    return by_tactic(findings).orderBy("tactic_order", rank(F.col("verdict"), VERDICTS), rank(F.col("confidence"), CONFIDENCES), *EMITTED)


def collapsed(findings: DataFrame) -> DataFrame:
    """One row for equal (category, verdict, confidence, summary): n, first place, and the first evidence of the first three.

    The samples of a group are kept small within tasks, so a finding that repeats
    without end is no large group.
    """
    group = ["category", "verdict", "confidence", "summary", "mitre_techniques"]
    place = F.struct(*EMITTED)
    sample = F.struct(*[F.col(c) for c in EMITTED], F.get("evidence", F.lit(0)).alias("evidence"))
    from pyspark.sql import Window

    # At most three rows of each group and part go on to the group itself.
    part = F.pmod(F.xxhash64(*EMITTED), F.lit(64))
    w = Window.partitionBy(*group, "_part").orderBy(*EMITTED)
    first = findings.withColumn("_part", part).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= SAMPLES)
    samples = first.groupBy(*group).agg(F.slice(F.sort_array(F.collect_list(sample)), 1, SAMPLES).alias("samples"))
    counts = findings.groupBy(*group).agg(F.count("*").alias("n"), F.min(place).alias("first"))
    return counts.join(samples, group).withColumn("samples", F.transform("samples", lambda s: s["evidence"]))


def neutral(text: Column) -> Column:
    """Text that no spreadsheet takes for a formula."""
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def csv_rows(findings: DataFrame) -> DataFrame:
    """The nine columns of the CSV report, all text."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    columns = {
        "category": F.col("category"),
        "verdict": F.upper("verdict"),
        "confidence": F.upper("confidence"),
        "summary": F.col("summary"),
        "evidence": F.array_join("evidence", "; "),
        "mitre_techniques": F.array_join("mitre_techniques", ";"),
        "source_ip": F.coalesce("source_ip", F.lit("")),
        "timestamp": F.coalesce(stamp, F.lit("")),
        "direction": F.coalesce("direction", F.lit("")),
    }
    return findings.orderBy(*EMITTED).select(*[neutral(c).alias(k) for k, c in columns.items()])


def write_csv(findings: DataFrame, path: str) -> None:
    csv_rows(findings).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def json_findings(findings: DataFrame) -> DataFrame:
    """One JSON object for each finding; fields without a value are left out."""
    full = lambda c: F.when(F.size(c) > 0, F.col(c))
    body = F.struct("category", "verdict", "confidence", "summary", full("evidence").alias("evidence"), full("mitre_techniques").alias("mitre_techniques"), full("mitre_attack").alias("mitre_attack"), "source_ip", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), "direction")
    return enrich(findings).orderBy(*EMITTED).select(F.to_json(body).alias("value"))


def csv_text(findings: DataFrame) -> Iterator[str]:
    """The lines of the CSV report, the header first; a quote within a field is doubled."""
    quoted = lambda cells: ",".join('"' + c.replace('"', '""') + '"' for c in cells)
    table = csv_rows(findings)
    yield quoted(table.columns)
    yield from (quoted(r) for r in table.toLocalIterator())


def write_json_lines(findings: DataFrame, path: str) -> None:
    json_findings(findings).write.mode("overwrite").text(path)


def _around(totals: dict, summaries: DataFrame) -> tuple[str, str]:
    """The JSON document before and behind its list of findings."""
    analyzers = [{"analyzer_name": r.analyzer_name, "packets_analyzed": r.packets_analyzed, "detail": json.loads(r.detail)} for r in summaries.orderBy("place").collect()]
    text = lambda x: json.dumps(x, indent=2, ensure_ascii=False).replace("\n", "\n  ")
    head = f'{{\n  "summary": {text(totals)},\n  "findings": ['
    tail = "".join(f',\n  "{k}": {text(v)}' for k, v in (("analyzers", analyzers), ("mitre_domain", MITRE_DOMAIN), ("mitre_attack_version", MITRE_VERSION)))
    return head, f"]{tail}\n}}\n"


def document(totals: dict, findings: DataFrame, summaries: DataFrame) -> Iterator[str]:
    """The whole report as one JSON document, in pieces; findings are fetched partition by partition."""
    head, tail = _around(totals, summaries)
    yield head
    for i, r in enumerate(json_findings(findings).toLocalIterator()):
        yield ("," if i else "") + "\n" + r.value
    yield "\n" + tail


def write_json(totals: dict, findings: DataFrame, summaries: DataFrame, path: str) -> None:
    """The whole report as one JSON file, however many findings there are; tasks write them."""
    spark = findings.sparkSession
    spark.dataSource.register(JsonDocument)
    head, tail = _around(totals, summaries)
    json_findings(findings).write.format("json_document").mode("append").option("head", head).option("tail", tail).save(path)


def escaped(text: str) -> str:
    """Control characters and backslashes spelt out, so no finding can steer a terminal."""
    return "".join(c if c >= " " and c != "\\" and not "\x7f" <= c <= "\x9f" else c.encode("unicode_escape").decode() for c in text)


def totals_lines(totals: dict) -> Iterator[str]:
    yield "CAPTURE SUMMARY"
    for k in ("total_packets", "total_bytes", "skipped_packets", "unique_hosts"):
        if k in totals:
            yield f"  {k.replace('_', ' ')}: {totals[k]}"
    for name in ("protocols", "services"):
        if totals.get(name):
            yield name.upper()
            yield from (f"  {k}: {n}" for k, n in totals[name].items())


def terminal(totals: dict, findings: DataFrame, summaries: DataFrame, grouped: bool = True, collapse: bool = True) -> Iterator[str]:
    """The lines of the report as text, all of them; findings are fetched partition by partition."""
    yield from totals_lines(totals)
    rows = collapsed(findings).select("*", "first.*") if collapse else findings.withColumn("n", F.lit(1)).withColumn("samples", F.col("evidence"))
    rows = ranked(rows) if grouped else rows.orderBy(*EMITTED)
    yield "FINDINGS"
    tactic = None
    for r in rows.toLocalIterator():
        if grouped and r["tactic_name"] != tactic:
            tactic = r["tactic_name"]
            yield f"  [{tactic}]"
        times = f" (x{r['n']})" if r["n"] > 1 else ""
        yield f"  {r['verdict'].upper()} {r['confidence'].upper()} {r['category']}: {escaped(r['summary'])}{times}"
        if r["mitre_techniques"]:
            yield f"    MITRE: {', '.join(r['mitre_techniques'])}"
        yield from (f"    > {escaped(s)}" for s in r["samples"] or [] if s is not None)
    yield "ANALYZERS"
    for r in summaries.orderBy("place").collect():
        yield f"  {r['analyzer_name']}: {r['packets_analyzed']} analyzed"
