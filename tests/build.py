"""Capture files built byte by byte for tests."""

import struct

SYN, ACK, FIN, RST, PSH = 2, 16, 1, 4, 8


def ip4(a):
    return bytes(int(x) for x in a.split("."))


def tcp(src, sport, dst, dport, seq, flags=ACK, payload=b"", **kw):
    segment = struct.pack(">HHIIBBHHH", sport, dport, seq & 0xFFFFFFFF, 0, 5 << 4, flags, 8192, 0, 0) + payload
    return ipv4(src, dst, 6, segment, **kw)


def udp(src, sport, dst, dport, payload=b"", **kw):
    return ipv4(src, dst, 17, struct.pack(">HHHH", sport, dport, 8 + len(payload), 0) + payload, **kw)


def ipv4(src, dst, proto, body, frag=0, **kw):
    return ether(0x0800, struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(body), 0, frag, 64, proto, 0, ip4(src), ip4(dst)) + body, **kw)


def ipv6(src, dst, kind, body, **kw):
    return ether(0x86DD, struct.pack(">IHBB16s16s", 6 << 28, len(body), kind, 64, src, dst) + body, **kw)


def ether(kind, body, src=b"\x02\0\0\0\0\x01", dst=b"\x02\0\0\0\0\x02", vlans=()):
    tags = b"".join(struct.pack(">HH", t, 1) for t in vlans)
    return dst + src + tags + struct.pack(">H", kind) + body


def arp(op, sender_mac, sender_ip, target_mac, target_ip, outer=None, shape=(1, 0x0800, 6, 4)):
    body = struct.pack(">HHBBH", *shape, op) + sender_mac + ip4(sender_ip) + target_mac + ip4(target_ip)
    return ether(0x0806, body, src=outer or sender_mac)


def pcap(packets, link=1, order="<", nanos=False):
    """``packets``: (seconds, bytes) or (seconds, fraction, bytes)."""
    magic = 0xA1B23C4D if nanos else 0xA1B2C3D4
    out = struct.pack(f"{order}IHHiIII", magic, 2, 4, 0, 0, 65535, link)
    for p in packets:
        secs, fraction, data = p if len(p) == 3 else (p[0], 0, p[1])
        out += struct.pack(f"{order}IIII", secs, fraction, len(data), len(data)) + data
    return out


def block(kind, body, order="<"):
    body += b"\0" * (-len(body) % 4)
    return struct.pack(f"{order}II", kind, len(body) + 12) + body + struct.pack(f"{order}I", len(body) + 12)


def section(order="<", major=1):
    return block(0x0A0D0D0A, struct.pack(f"{order}IHHq", 0x1A2B3C4D, major, 0, -1), order)


def interface(link=1, order="<", resolution=None):
    options = struct.pack(f"{order}HHB3xHH", 9, 1, resolution, 0, 0) if resolution is not None else b""
    return block(1, struct.pack(f"{order}HHI", link, 0, 0) + options, order)


def enhanced(stamp, data, order="<", iface=0):
    return block(6, struct.pack(f"{order}IIIII", iface, stamp >> 32, stamp & 0xFFFFFFFF, len(data), len(data)) + data, order)


def simple(data, order="<"):
    return block(3, struct.pack(f"{order}I", len(data)) + data, order)


class Talk:
    """A TCP conversation: handshake, data in either direction, end."""

    def __init__(self, client="10.0.0.1", cport=40000, server="10.0.0.2", sport=80, ts=1_700_000_000, isn=1000):
        self.c, self.s, self.ts = (client, cport), (server, sport), ts
        self.at = {True: isn + 1, False: isn + 50_001}
        self.packets = [(ts, tcp(*self.c, *self.s, isn, SYN)), (ts, tcp(*self.s, *self.c, isn + 50_000, SYN | ACK)), (ts, tcp(*self.c, *self.s, isn + 1))]

    def send(self, data, client=True, dt=0):
        self.ts += dt
        a, b = (self.c, self.s) if client else (self.s, self.c)
        self.packets.append((self.ts, tcp(*a, *b, self.at[client], ACK | PSH, data)))
        self.at[client] += len(data)
        return self

    def close(self):
        self.packets += [(self.ts, tcp(*self.c, *self.s, self.at[True], FIN | ACK)), (self.ts, tcp(*self.s, *self.c, self.at[False], FIN | ACK))]
        return self
