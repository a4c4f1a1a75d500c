"""MITRE ATT&CK techniques and tactics as tables, and findings joined with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Tactics in report order (name, id), and techniques (id, name, tactic).
TACTICS = (
    ("Reconnaissance", "TA0043"),
    ("Resource Development", "TA0042"),
    ("Initial Access", "TA0001"),
    ("Execution", "TA0002"),
    ("Persistence", "TA0003"),
    ("Privilege Escalation", "TA0004"),
    ("Defense Evasion", "TA0005"),
    ("Credential Access", "TA0006"),
    ("Discovery", "TA0007"),
    ("Lateral Movement", "TA0008"),
    ("Collection", "TA0009"),
    ("Command and Control", "TA0011"),
    ("Exfiltration", "TA0010"),
    ("Impact", "TA0040"),
    ("Inhibit Response Function", "TA0107"),
    ("Impair Process Control", "TA0106"),
    ("Impact (ICS)", "TA0105"),
    ("Discovery (ICS)", "TA0102"),
    ("Collection (ICS)", "TA0100"),
    ("Command and Control (ICS)", "TA0101"),
    ("Execution (ICS)", "TA0104"),
)
TECHNIQUES = (
    ("T1027", "Obfuscated Files or Information", "Defense Evasion"),
    ("T1036", "Masquerading", "Defense Evasion"),
    ("T1040", "Network Sniffing", "Credential Access"),
    ("T1046", "Network Service Discovery", "Discovery"),
    ("T1071", "Application Layer Protocol", "Command and Control"),
    ("T1071.001", "Web Protocols", "Command and Control"),
    ("T1071.004", "DNS", "Command and Control"),
    ("T1083", "File and Directory Discovery", "Discovery"),
    ("T1499.002", "Service Exhaustion Flood", "Impact"),
    ("T1505.003", "Web Shell", "Persistence"),
    ("T1573", "Encrypted Channel", "Command and Control"),
    ("T0846", "Remote System Discovery", "Discovery (ICS)"),
    ("T1692.001", "Unauthorized Message: Command Message", "Impair Process Control"),
    ("T1692.002", "Unauthorized Message: Reporting Message", "Impair Process Control"),
    ("T0885", "Commonly Used Port", "Command and Control (ICS)"),
    ("T0836", "Modify Parameter", "Impair Process Control"),
    ("T0814", "Denial of Service", "Inhibit Response Function"),
    ("T0806", "Brute Force I/O", "Impair Process Control"),
    ("T0835", "Manipulate I/O Image", "Impair Process Control"),
    ("T0831", "Manipulation of Control", "Impact (ICS)"),
    ("T0888", "Remote System Information Discovery", "Discovery (ICS)"),
    ("T1691.001", "Block Operational Technology Message: Command Message", "Inhibit Response Function"),
    ("T0827", "Loss of Control", "Impact (ICS)"),
    ("T0830", "Adversary-in-the-Middle", "Collection (ICS)"),
    ("T1557.002", "Adversary-in-the-Middle: ARP Cache Poisoning", "Credential Access"),
    ("T0858", "Change Operating Mode", "Execution (ICS)"),
    ("T0816", "Device Restart/Shutdown", "Inhibit Response Function"),
    ("T1693.001", "Modify Firmware: System Firmware", "Inhibit Response Function"),
)


def techniques(spark: SparkSession) -> DataFrame:
    """id, name, tactic_name, tactic_id, tactic_order: one row for each technique."""
    order = {name: (i, code) for i, (name, code) in enumerate(TACTICS)}
    rows = [(t, n, tactic, order[tactic][1], order[tactic][0]) for t, n, tactic in TECHNIQUES]
    return spark.createDataFrame(rows, "id string, name string, tactic_name string, tactic_id string, tactic_order int")


def reference(technique):
    """The page of a technique: a sub-technique is a folder below its parent."""
    return F.concat(F.lit("https://attack.mitre.org/techniques/"), F.replace(technique, F.lit("."), F.lit("/")), F.lit("/"))


def _known(value) -> Column:
    """A map literal from technique to ``value`` (name, tactic, id of the tactic, its place in reports)."""
    order = {name: (i, code) for i, (name, code) in enumerate(TACTICS)}
    return F.create_map(*[F.lit(x) for t, n, tactic in TECHNIQUES for x in (t, value(n, tactic, order[tactic][1], order[tactic][0]))])


def enrich(findings: DataFrame) -> DataFrame:
    """``findings`` with ``mitre_attack``: id, name, tactic and page of each technique, in its order.

    An unknown technique keeps its id and page. The 28 techniques are looked up within the row.
    """
    names, ids, tactics = (_known(lambda n, t, i, o, k=k: (n, i, t)[k]) for k in range(3))
    entry = lambda t: F.struct(t.alias("id"), F.try_element_at(names, t).alias("name"), F.try_element_at(ids, t).alias("tactic_id"), F.try_element_at(tactics, t).alias("tactic_name"), reference(t).alias("reference"))
    return findings.withColumn("mitre_attack", F.coalesce(F.transform("mitre_techniques", entry), F.array()))


def by_tactic(findings: DataFrame) -> DataFrame:
    """``findings`` with the tactic of their first technique; without one they are Uncategorized, last."""
    first = F.get("mitre_techniques", F.lit(0))
    name, place = F.try_element_at(_known(lambda n, t, i, o: t), first), F.try_element_at(_known(lambda n, t, i, o: o), first)
    return findings.withColumns({"tactic_name": F.coalesce(name, F.lit("Uncategorized")), "tactic_order": F.coalesce(place, F.lit(len(TACTICS)))})
