"""TCP flows: canonical keys, instances of a key, and why an instance ended.

Instances follow from windows alone. A packet begins a new instance of its key when,
since the key's last packet, an idle sweep has taken the flow away, or the last packet
was a reset, or two FINs were seen.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions.binary import ipv4, ipv6, part

from .ordered import numbered


@dataclass(frozen=True)
class FlowConfig:
    """Limits and thresholds of flow tracking and reassembly."""

    timeout: int = 300
    sweep_packets: int = 8192
    idle_packets: int = 65_536
    max_depth: int = 10 << 20
    max_segments: int = 10_000
    max_window: int = 1 << 20
    overlap_threshold: int = 50
    small_threshold: int = 100
    small_bytes: int = 16
    small_ignore_ports: tuple[int, ...] = (23, 513)
    out_of_window_threshold: int = 100
    #: Protocols beyond the built-in ones: name, and whether a chunk between two ports is one of its streams'.
    routes: tuple[tuple[str, Callable[[bytes, int, int], bool]], ...] = ()


def flow_key(src_key: Column, src_port: Column, dst_key: Column, dst_port: Column) -> dict[str, Column]:
    """The lower and upper end of a flow, compared by (address, port)."""
    a, b = F.struct(src_key.alias("ip"), src_port.alias("port")), F.struct(dst_key.alias("ip"), dst_port.alias("port"))
    low, high = F.least(a, b), F.greatest(a, b)
    return {"lower_key": low["ip"], "lower_port": low["port"], "upper_key": high["ip"], "upper_port": high["port"]}


KEY = ["lower_key", "lower_port", "upper_key", "upper_port"]


#: What flows and streams take of decoded packets.
NEEDED = ["order", "ts", "kind", "protocol", "src_ip", "dst_ip", "src_key", "dst_key", "src_port", "dst_port", "seq", "syn", "ack", "fin", "rst", "payload"]


def address(key: Column) -> Column:
    """The address of an end as text, from its bytes behind their version."""
    return F.when(F.octet_length(key) == 5, ipv4(part(key, 1, 4))).otherwise(ipv6(part(key, 1, 16)))


def with_ips(df: DataFrame) -> DataFrame:
    """``df`` with lower_ip and upper_ip from its flow key."""
    return df.withColumns({"lower_ip": address(F.col("lower_key")), "upper_ip": address(F.col("upper_key"))})


def keyed(packets: DataFrame) -> DataFrame:
    """TCP packets with the flow key, the ends' addresses as text, and ``flow`` as displayed."""
    df = packets.withColumns(flow_key(F.col("src_key"), F.col("src_port"), F.col("dst_key"), F.col("dst_port")))
    src_low = (F.col("src_key") == F.col("lower_key")) & (F.col("src_port") == F.col("lower_port"))
    df = df.withColumn("lower_ip", F.when(src_low, F.col("src_ip")).otherwise(F.col("dst_ip"))).withColumn("upper_ip", F.when(src_low, F.col("dst_ip")).otherwise(F.col("src_ip")))
    end = lambda ip, port: F.concat(F.col(ip), F.lit(":"), F.col(port).cast("string"))
    return df.withColumn("from_lower", src_low).withColumn("flow", F.concat(end("lower_ip", "lower_port"), F.lit(" → "), end("upper_ip", "upper_port")))


def ip_index(packets: DataFrame) -> DataFrame:
    """IP packets with ``ip_idx``, their number from 1 over all files, and ``clock``, the latest second so far."""
    return numbered(packets.where("kind = 'ip'"), F.col("order"), F.greatest(F.col("ts"), F.lit(0)), "ip_idx", "clock")


def instances(indexed: DataFrame, config: FlowConfig = FlowConfig()) -> DataFrame:
    """TCP packets of :func:`ip_index` with the flow key and ``inst`` (0, 1, ... within a key)."""
    tcp = keyed(indexed.where("protocol = 'Tcp'"))
    w = Window.partitionBy(*KEY).orderBy("ip_idx")
    last = {c: F.lag(c).over(w) for c in ("ip_idx", "ts", "clock", "rst")}
    timed_out = (F.col("clock") > last["clock"]) & (F.col("clock") - last["ts"] > config.timeout)
    swept = F.floor(F.col("ip_idx") / config.sweep_packets) * config.sweep_packets
    idle = (swept > last["ip_idx"]) & (swept - last["ip_idx"] > config.idle_packets)
    begins = F.coalesce(timed_out | idle | last["rst"], F.lit(True))
    tcp = tcp.withColumn("_begin", begins.cast("int")).withColumn("_expired", F.coalesce((timed_out | idle) & ~last["rst"], F.lit(False)))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    tcp = tcp.withColumn("_seg", F.sum("_begin").over(run))
    within = Window.partitionBy(*KEY, "_seg").orderBy("ip_idx").rowsBetween(Window.unboundedPreceding, -1)
    fins = F.coalesce(F.count_if(F.col("fin") & ~F.col("rst")).over(within), F.lit(0))
    tcp = tcp.withColumn("_pair", F.floor(fins / 2))
    change = (F.col("_seg") != F.lag("_seg").over(w)) | (F.col("_pair") != F.lag("_pair").over(w))
    tcp = tcp.withColumn("_new", F.coalesce(change, F.lit(True)).cast("int"))
    return tcp.withColumn("inst", (F.sum("_new").over(run) - 1).cast("long")).drop("_begin", "_seg", "_pair", "_new")


def flows(tcp: DataFrame, end_clock: int | None = None, end_idx: int | None = None, config: FlowConfig = FlowConfig()) -> DataFrame:
    """One row for each flow instance: times, packets, bytes, close_reason, expired.

    ``end_clock`` and ``end_idx``: the last second and number of all IP packets, which
    decide whether a flow left open at the end had expired by then.
    """
    per = tcp.groupBy(*KEY, "inst").agg(
        F.first("flow").alias("flow"),
        F.first("lower_ip").alias("lower_ip"),
        F.first("upper_ip").alias("upper_ip"),
        F.min("ts").alias("first_seen"),
        F.max_by("ts", "ip_idx").alias("last_seen"),
        F.max("ip_idx").alias("last_idx"),
        F.max_by("clock", "ip_idx").alias("last_clock"),
        F.count("*").alias("packets"),
        F.sum(F.octet_length("payload")).cast("long").alias("payload_bytes"),
        F.max("rst").alias("rst"),
        F.count_if(F.col("fin") & ~F.col("rst")).alias("fins"),
    )
    w = Window.partitionBy(*KEY).orderBy("inst")
    followed = F.lead("inst").over(w).isNotNull()
    reason = F.when(F.col("rst"), "Rst").when(F.col("fins") >= 2, "Fin").otherwise("Timeout")
    late = F.lit(False)
    if end_clock is not None:
        late = (F.lit(end_clock) > F.col("last_clock")) & (F.lit(end_clock) - F.col("last_seen") > config.timeout)
        sweep = end_idx // config.sweep_packets * config.sweep_packets
        late = late | ((F.lit(sweep) > F.col("last_idx")) & (F.lit(sweep) - F.col("last_idx") > config.idle_packets))
    return per.withColumn("close_reason", reason).withColumn("expired", (F.col("close_reason") == "Timeout") & (followed | late))
