"""Frames to typed columns, as Catalyst expressions over the captured bytes.

A length beyond the captured bytes is cut down to them; other violations of the formats
give ``decode_error``. Columns that a query doesn't ask for are not computed.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions.binary import has_bit, ipv4, ipv6, part, u8, uint_be

# Link types, EtherTypes, protocol numbers.
ETHERNET, RAW, SLL, IPV4, IPV6 = 1, 101, 113, 228, 229
VLAN = (0x8100, 0x88A8, 0x9100)
ET_IPV4, ET_IPV6, ET_ARP = 0x0800, 0x86DD, 0x0806
TCP, UDP, ICMP, ICMPV6 = 6, 17, 1, 58
FRAGMENT, AUTH = 44, 51
EXTENSIONS = (0, 43, FRAGMENT, AUTH, 60, 135, 139, 140)
SERVICES = ((53, "DNS"), (80, "HTTP"), (443, "TLS"), (22, "SSH"), (445, "SMB"), (502, "Modbus"), (20000, "DNP3"))
MALFORMED_ARP = "Non-Ethernet/IPv4 ARP frame"
TRUNCATED_ARP = "truncated ARP frame"
NO_IP = "No IP layer found"


def _link_layer(data: Column, link: Column) -> Column:
    """(kind, at): the EtherType, null without one, and the offset of the network header, behind any number of VLAN tags."""
    first = F.when(link == ETHERNET, uint_be(data, 12, 2)).when(link == SLL, uint_be(data, 14, 2))
    start = F.when(link == ETHERNET, 14).when(link == SLL, 16).otherwise(0)
    version = F.shiftright(u8(data, 0), 4)
    raw = F.when(version == 4, F.lit(ET_IPV4)).when(version == 6, F.lit(ET_IPV6)).cast("long")
    plain = F.struct(F.when(link.isin(RAW, IPV4, IPV6), raw).otherwise(first).alias("kind"), start.cast("int").alias("at"))

    def step(acc: Column, _: Column) -> Column:
        tagged = acc["kind"].isin(*VLAN)
        return F.struct(F.when(tagged, uint_be(data, acc["at"] + 2, 2)).otherwise(acc["kind"]).alias("kind"), F.when(tagged, acc["at"] + 4).otherwise(acc["at"]).alias("at"))

    # Frames without a tag don't enter the loop, which is as long as the frame allows.
    loop = F.sequence(F.lit(1), F.greatest(F.lit(1), (F.octet_length(data) / 4).cast("int")))
    return F.when(first.isin(*VLAN), F.aggregate(loop, plain, step)).otherwise(plain)


def _ipv6_upper(data: Column, l3: Column) -> Column:
    """(kind, at, cut): next header, its offset, and whether it is a fragment, behind all extension headers."""

    def step(acc: Column, _: Column) -> Column:
        kind, at = acc["kind"], acc["at"]
        size = F.when(kind == FRAGMENT, 8).when(kind == AUTH, (u8(data, at + 1) + 2) * 4).otherwise((u8(data, at + 1) + 1) * 8)
        more = kind.isin(*EXTENSIONS) & size.isNotNull()
        cut = (kind == FRAGMENT) & (uint_be(data, at + 2, 2).bitwiseAND(F.lit(0xFFF9).cast("long")) != 0)
        return F.struct(
            F.when(more, u8(data, at)).otherwise(kind).alias("kind"), F.when(more, at + size.cast("int")).otherwise(at).alias("at"), (acc["cut"] | F.coalesce(cut, F.lit(False))).alias("cut")
        )

    zero = F.struct(u8(data, l3 + 6).alias("kind"), (l3 + 40).alias("at"), F.lit(False).alias("cut"))
    loop = F.sequence(F.lit(1), F.greatest(F.lit(1), (F.octet_length(data) / 8).cast("int")))
    return F.when(u8(data, l3 + 6).isin(*EXTENSIONS), F.aggregate(loop, zero, step)).otherwise(zero)


@cache
def _header_steps(gateway: int) -> list[dict[str, Column]]:
    """Columns to add one after the other. They name columns only, so they are built once for a ``gateway`` to the JVM."""
    data = F.col("data")
    steps = [{"_link": _link_layer(data, F.col("datalink"))}]
    steps.append({"ether_type": F.col("_link.kind"), "l3": F.col("_link.at"), "packet_len": F.octet_length("data").cast("long")})
    l3, kind = F.col("l3"), F.col("ether_type")
    size = F.col("packet_len").cast("int")
    is4, is6 = kind == ET_IPV4, kind == ET_IPV6
    # Of IPv4 the first four bytes are one number: version, header length, total length.
    steps.append({"_four": uint_be(data, l3, 4), "_v6": F.when(is6, _ipv6_upper(data, l3))})
    first = F.coalesce(F.shiftright("_four", 24), u8(data, l3))
    steps.append({"_first": first})
    first, total = F.col("_first"), F.col("_four").bitwiseAND(F.lit(0xFFFF).cast("long")).cast("int")
    ihl = F.shiftleft(first.bitwiseAND(F.lit(15).cast("long")), 2).cast("int")
    fragment = uint_be(data, l3 + 6, 2).bitwiseAND(F.lit(0x3FFF).cast("long")) != 0
    bad_ip = (
        F.when(~F.col("datalink").isin(ETHERNET, RAW, SLL, IPV4, IPV6), "Unsupported link type")
        .when(is4 & (F.shiftright(first, 4) != 4), "Parse error: IPv4 version")
        .when(is4 & (ihl < 20), "Parse error: IPv4 header length")
        .when(is4 & (size - l3 < 20), NO_IP)
        .when(is4 & (size - l3 < ihl), NO_IP)
        .when(is6 & (F.shiftright(first, 4) != 6), "Parse error: IPv6 version")
        .when(is6 & (size - l3 < 40), NO_IP)
        .when((kind != ET_ARP) & ~is4 & ~is6, NO_IP)
        .when(kind.isNull(), NO_IP)
    )
    end4 = F.when(total >= ihl, F.least(size, l3 + total)).otherwise(size)
    length6 = uint_be(data, l3 + 4, 2).cast("int")
    end6 = F.when(length6 == 0, size).otherwise(F.least(size, l3 + 40 + length6))
    steps.append({
        "_bad": bad_ip,
        "_proto": F.when(is4, u8(data, l3 + 9)).when(is6, F.col("_v6.kind")),
        "_l4": F.when(is4, l3 + ihl).when(is6, F.col("_v6.at")),
        "_end": F.when(is4, end4).when(is6, end6),
        "_cut": F.when(is4, fragment).when(is6, F.col("_v6.cut")),
    })
    l4, end, proto = F.col("_l4"), F.col("_end"), F.col("_proto")
    # Ports are one number of four bytes; data offset and flags one of two.
    steps.append({"_ports": F.when(proto.isin(TCP, UDP), uint_be(data, l4, 4)), "_offset_flags": F.when(proto == TCP, uint_be(data, l4 + 12, 2))})
    offset = F.shiftleft(F.shiftright("_offset_flags", 12), 2).cast("int")
    whole = ~F.col("_cut")
    has_tcp = whole & (proto == TCP) & (end - l4 >= 20) & (offset >= 20) & (end - l4 >= offset)
    bad_tcp = whole & (proto == TCP) & (end - l4 >= 20) & (offset < 20)
    has_udp = whole & (proto == UDP) & (end - l4 >= 8)
    has_icmp = whole & ((is4 & (proto == ICMP)) | (is6 & (proto == ICMPV6))) & (end - l4 >= 8)
    udp_size = F.when(proto == UDP, uint_be(data, l4 + 4, 2)).cast("int")
    udp_end = F.when((udp_size >= 8) & (l4 + udp_size <= end), l4 + udp_size).otherwise(end)
    steps.append({"_tcp": F.coalesce(has_tcp, F.lit(False)), "_udp": F.coalesce(has_udp, F.lit(False)), "_icmp": F.coalesce(has_icmp, F.lit(False)), "_off": offset, "_uend": udp_end})
    steps.append({"_bad": F.coalesce("_bad", F.when(bad_tcp, "Parse error: TCP data offset"))})

    is_arp = kind == ET_ARP
    steps.append({"decode_error": F.when(is_arp, _arp_error(data, l3, size)).otherwise(F.col("_bad"))})
    ok_ip = F.col("decode_error").isNull() & (is4 | is6)
    tcp, udp = ok_ip & F.col("_tcp"), ok_ip & F.col("_udp")
    flags = F.when(tcp, F.col("_offset_flags"))
    steps.append({
        "kind": F.when(F.col("decode_error").isNotNull(), "error").when(is_arp, "arp").otherwise("ip"),
        "protocol": F.when(tcp, "Tcp").when(udp, "Udp").when(ok_ip & F.col("_icmp"), "Icmp").when(ok_ip, F.concat(F.lit("Other("), proto.cast("string"), F.lit(")"))),
        "src_port": F.when(tcp | udp, F.shiftright("_ports", 16)).cast("int"),
        "dst_port": F.when(tcp | udp, F.col("_ports").bitwiseAND(F.lit(0xFFFF).cast("long"))).cast("int"),
        "seq": F.when(tcp, uint_be(data, l4 + 4, 4)),
        "syn": has_bit(flags, 2),
        "ack": has_bit(flags, 16),
        "fin": has_bit(flags, 1),
        "rst": has_bit(flags, 4),
        "_six": F.when(ok_ip, is6),
        "_at": l3,
        "_body": F.when(tcp, l4 + F.col("_off")).when(udp, l4 + 8),
        "_stop": F.when(tcp, end).when(udp, F.col("_uend")),
    })
    return steps


def _headers(raw: DataFrame) -> DataFrame:
    """``raw`` with kind, decode_error, packet_len, protocol, ports, seq, flags, and where the parts lie: numbers only."""
    df = raw.where("data IS NOT NULL")
    for step in _header_steps(id(df.sparkSession.sparkContext._gateway)):
        df = df.withColumns(step)
    return df.drop("_link", "_four", "_first", "_v6", "_bad", "_proto", "_l4", "_end", "_cut", "_ports", "_offset_flags", "_tcp", "_udp", "_icmp", "_off", "_uend", "l3", "ether_type")


def _arp_error(data: Column, l3: Column, size: Column) -> Column:
    shape = (uint_be(data, l3, 2) == 1) & (uint_be(data, l3 + 2, 2) == 0x0800) & (u8(data, l3 + 4) == 6) & (u8(data, l3 + 5) == 4)
    needed = l3 + 8 + 2 * (F.coalesce(u8(data, l3 + 4), F.lit(0)) + F.coalesce(u8(data, l3 + 5), F.lit(0))).cast("int")
    return F.when(size < l3 + 8, TRUNCATED_ARP).when(~shape & ((size >= needed) | (F.col("datalink") == ETHERNET)), MALFORMED_ARP).when(size < needed, TRUNCATED_ARP).when(~shape, MALFORMED_ARP)


@cache
def _body_columns(gateway: int) -> dict[str, Column]:
    """Addresses, payload and ARP fields, from where the headers say they lie."""
    data, six, at = F.col("data"), F.col("_six"), F.col("_at")
    text = lambda at4, at6: F.when(six, ipv6(part(data, at + at6, 16))).when(~six, ipv4(part(data, at + at4, 4)))
    key = lambda at4, at6: F.when(six, F.concat(F.lit(b"\x06"), part(data, at + at6, 16))).when(~six, F.concat(F.lit(b"\x04"), part(data, at + at4, 4)))
    arp = F.struct(
        uint_be(data, at + 6, 2).cast("int").alias("operation"),
        part(data, at + 8, 6).alias("sender_mac"),
        part(data, at + 14, 4).alias("sender_ip"),
        part(data, at + 18, 6).alias("target_mac"),
        part(data, at + 24, 4).alias("target_ip"),
        F.when(F.col("datalink") == ETHERNET, part(data, 6, 6)).alias("outer_src_mac"),
    )
    payload = F.when(F.col("_body").isNotNull(), part(data, F.col("_body"), F.col("_stop") - F.col("_body"))).when(six.isNotNull(), F.lit(b""))
    return {"src_ip": text(12, 8), "dst_ip": text(16, 24), "src_key": key(12, 8), "dst_key": key(16, 24), "payload": payload, "arp": F.when(F.col("kind") == "arp", arp)}


def _small_methods(spark: SparkSession) -> None:
    """The JVM interprets methods above 8,000 bytes for ever; with this limit Spark makes smaller ones of the decoder."""
    if int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) > 8000:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def decode(raw: DataFrame) -> DataFrame:
    """Add decoded columns to rows with ``datalink`` and ``data``.

    kind (ip, arp or error), decode_error, packet_len; src_ip, dst_ip, src_key, dst_key
    (17 bytes that sort like addresses, IPv4 first), protocol, src_port, dst_port, seq,
    syn, ack, fin, rst, payload for IP; an ``arp`` struct for ARP.
    """
    _small_methods(raw.sparkSession)
    heads = _headers(raw)
    # A generator of one row: filters on kinds, protocols and ports stay above it. Pushed below,
    # each would carry the whole decoder with it. Addresses, payloads and ARP fields are
    # columns of their own on top, so a query computes those that it asks for.
    df = heads.select(F.inline(F.array(F.struct(*heads.columns))))
    df = df.withColumns(_body_columns(id(df.sparkSession.sparkContext._gateway)))
    return df.drop("_six", "_at", "_body", "_stop")


def service(src_port: Column, dst_port: Column) -> Column:
    """The service that a port stands for; the first of the list wins, on either side."""
    out = F.lit(None).cast("string")
    for port, name in reversed(SERVICES):
        out = F.when((src_port == port) | (dst_port == port), name).otherwise(out)
    return out


def packets(raw: DataFrame) -> DataFrame:
    """Decoded rows with ``ts`` (whole seconds) and ``order`` = file and packet as one long."""
    return decode(raw).withColumn("ts", F.col("ts_secs")).withColumn("order", F.shiftleft(F.col("file_seq").cast("long"), 40) + F.col("pkt_idx"))
