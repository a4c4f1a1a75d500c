"""ARP detections: sender mismatch, storms, gratuitous frames, rebinding of addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions.binary import ipv4, mac

from .anchored import anchored_windows, first_in_window
from .decode import MALFORMED_ARP
from .findings import finding, rows

FLAP_WINDOW = 60
SPOOFED = ["T0830", "T1557.002"]


def frames(packets: DataFrame) -> DataFrame:
    """ARP frames, flat. Frames of the senders 0.0.0.0 and 255.255.255.255 count but are not ``judged``."""
    df = packets.where("kind = 'arp'").select("order", "ts", "arp.*")
    zero, ones = F.lit(bytes(4)), F.lit(bytes([255] * 4))
    df = df.withColumn("judged", (F.col("sender_ip") != zero) & (F.col("sender_ip") != ones))
    return df.withColumn("gratuitous", F.col("sender_ip") == F.col("target_ip"))


def rebinds(arp: DataFrame) -> DataFrame:
    """Judged frames with ``old_mac``, the address's hardware address before, and ``rebind``."""
    w = Window.partitionBy("sender_ip").orderBy("order")
    df = arp.where("judged").withColumn("old_mac", F.lag("sender_mac").over(w))
    return df.withColumn("rebind", F.coalesce(F.col("old_mac") != F.col("sender_mac"), F.lit(False)))


def storms(arp: DataFrame, rate: int = 50) -> DataFrame:
    """The first frame of each window in which a sender's rate a second reaches ``rate``."""
    windows = anchored_windows(arp.where("judged"), ["sender_mac"], ["order"], "ts", FLAP_WINDOW)
    per_second = F.floor(F.col("win_count") / F.greatest(F.col("elapsed"), F.lit(1)))
    return first_in_window(windows.withColumn("rate", per_second), ["sender_mac"], ["order"], F.col("rate") >= rate)


def detect(packets: DataFrame, spoof_threshold: int = 3, storm_rate: int = 50) -> DataFrame:
    """Findings of all ARP frames and of malformed ones."""
    found = rebinds(frames(packets))
    ip = F.concat(F.lit("sender_ip="), ipv4(F.col("sender_ip")))
    operation = F.concat(F.lit("operation="), F.col("operation").cast("string"))
    at, none = F.col("order"), F.lit(None).cast("long")

    flaps = anchored_windows(found.where("rebind"), ["sender_ip"], ["order"], "ts", FLAP_WINDOW)
    found = found.join(flaps.select("order", "win_count"), "order", "left")
    high = F.col("win_count") == spoof_threshold  # counts pass it once in a window
    conflict = F.col("gratuitous") & F.col("rebind")
    rebind = finding(
        "Anomaly", F.when(high, "Likely").otherwise("Possible"), F.when(high, "High").otherwise("Medium"), F.concat(F.lit("D1: ARP Spoof — IP→MAC rebind detected for "), ip),
        F.array(ip, F.concat(F.lit("old_mac="), mac(F.col("old_mac"))), F.concat(F.lit("new_mac="), mac(F.col("sender_mac")))), SPOOFED, 4,
    )
    out = rows(found, 0, at, none, [
        (F.col("outer_src_mac") != F.col("sender_mac"), finding("Anomaly", "Possible", "Medium", F.lit("D12: L2/L3 sender-MAC mismatch — Ethernet src MAC differs from ARP sender HW addr"), F.array(F.concat(F.lit("eth_src_mac="), mac(F.col("outer_src_mac"))), F.concat(F.lit("arp_sender_mac="), mac(F.col("sender_mac"))), ip), SPOOFED, 1)),
        (F.col("gratuitous") & ~F.col("rebind"), finding("Anomaly", "Possible", "Low", F.lit("D2: Gratuitous ARP (GARP) — sender_ip equals target_ip"), F.array(ip, operation), [], 3)),
        (conflict, finding("Anomaly", "Possible", "Medium", F.lit("D2: Gratuitous ARP (GARP) with binding conflict — sender_ip equals target_ip and conflicts with an existing IP→MAC binding"), F.array(ip, operation), SPOOFED, 3)),
        (F.col("rebind"), rebind),
    ])
    word = lambda c, name: F.concat(F.lit(f"{name}="), F.col(c).cast("string"))
    who = mac(F.col("sender_mac"))
    storm = finding("Anomaly", "Possible", "Medium", F.concat(F.lit("D3: ARP storm detected — high ARP frame rate from source MAC "), who), F.array(F.concat(F.lit("source_mac="), who), word("win_count", "frame_count"), word("elapsed", "window_secs"), word("rate", "rate_pps")), [], 2)
    out = out.unionByName(rows(storms(frames(packets), storm_rate), 0, at, none, [(F.lit(True), storm)]))
    bad = packets.where(F.col("decode_error") == MALFORMED_ARP)
    malformed = finding("Anomaly", "Possible", "Low", F.lit("D11: Malformed ARP frame — Non-Ethernet/IPv4 ARP frame (non-standard HW/proto address sizes or types)"), F.array(F.lit(MALFORMED_ARP), F.concat(F.lit("packet_len="), F.col("packet_len").cast("string"))), [], 5)
    return out.unionByName(rows(bad, 0, at, none, [(F.lit(True), malformed)]))


def counts(packets: DataFrame, found: DataFrame) -> DataFrame:
    """One row of counters; ``found``: the findings of :func:`detect`."""
    arp = frames(packets)
    seen = arp.agg(
        F.count("*").alias("frames_analyzed"), F.count_if(F.col("operation") == 1).alias("request_count"), F.count_if(F.col("operation") == 2).alias("reply_count"),
        F.count_if(~F.col("operation").isin(1, 2)).alias("other_opcode_count"), F.countDistinct(F.when(F.col("judged"), F.col("sender_ip"))).alias("bindings_tracked"),
    )
    kind = lambda n: F.count_if(F.col("summary").startswith(f"D{n}:"))
    told = found.where("stage = 0").agg(kind(1).alias("spoof_findings"), kind(2).alias("garp_findings"), kind(3).alias("storm_findings"), kind(12).alias("mismatch_findings"), kind(11).alias("malformed_findings"))
    return seen.crossJoin(told).withColumn("malformed_frames", F.col("malformed_findings"))
