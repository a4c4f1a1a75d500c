"""Capture summaries: packets, bytes, hosts, protocols and services of IP packets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decode import MALFORMED_ARP, service


def totals(packets: DataFrame, malformed_arp_skipped: bool = True) -> DataFrame:
    """One row: total_packets, total_bytes, skipped_packets. ARP frames count in none of them.

    ``malformed_arp_skipped``: whether malformed ARP frames are skipped packets (the
    summary says so, the analysis reports them as findings instead).
    """
    failed = F.col("decode_error").isNotNull()
    if not malformed_arp_skipped:
        failed &= F.col("decode_error") != MALFORMED_ARP
    ip = F.col("kind") == "ip"
    return packets.agg(
        F.count_if(ip).alias("total_packets"), F.coalesce(F.sum(F.when(ip, F.col("packet_len"))), F.lit(0)).alias("total_bytes"), F.count_if(failed).alias("skipped_packets")
    )


def hosts(packets: DataFrame) -> DataFrame:
    """Distinct addresses, ``host`` and ``host_key`` (which sorts them by number)."""
    ends = F.explode(F.array(F.struct(F.col("src_ip").alias("host"), F.col("src_key").alias("host_key")), F.struct(F.col("dst_ip").alias("host"), F.col("dst_key").alias("host_key"))))
    return packets.where("kind = 'ip'").select(ends.alias("e")).select("e.*").distinct()


def protocols(packets: DataFrame) -> DataFrame:
    return packets.where("kind = 'ip'").groupBy("protocol").agg(F.count("*").alias("packets")).orderBy(F.desc("packets"), "protocol")


def services(packets: DataFrame) -> DataFrame:
    named = packets.where("kind = 'ip'").select(service(F.col("src_port"), F.col("dst_port")).alias("service")).where("service IS NOT NULL")
    return named.groupBy("service").agg(F.count("*").alias("packets")).orderBy(F.desc("packets"), "service")


def dns(packets: DataFrame) -> DataFrame:
    """One row: dns_queries, dns_responses. A payload without a whole header is a response."""
    from packetloom.functions.binary import has_bit, u8

    on_port = F.col("protocol").isin("Tcp", "Udp") & ((F.col("src_port") == 53) | (F.col("dst_port") == 53))
    query = (F.octet_length("payload") >= 12) & ~has_bit(u8(F.col("payload"), 2), 0x80)
    mine = packets.where((F.col("kind") == "ip") & on_port).select(F.coalesce(query, F.lit(False)).alias("q"))
    return mine.agg(F.count_if("q").alias("dns_queries"), F.count_if(~F.col("q")).alias("dns_responses"))
