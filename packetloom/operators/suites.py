"""Registered names of TLS cipher suites, from the runs in which they were numbered.

A name is ``TLS_``, a key exchange, ``_WITH_`` and a cipher with its digest. Numbers were given in
runs: a first number, and then either each exchange with all ciphers or each cipher with all
exchanges.
"""

from __future__ import annotations

# Key exchanges and ciphers in the orders of the registry.
_CLASSIC = "RSA DH_DSS DH_RSA DHE_DSS DHE_RSA DH_anon"
_GCM_ORDER = "RSA DHE_RSA DH_RSA DHE_DSS DH_DSS DH_anon"
_CURVES = "ECDHE_ECDSA ECDH_ECDSA ECDHE_RSA ECDH_RSA"
_PSK = "PSK DHE_PSK RSA_PSK"
# Runs in which each exchange has all ciphers before the next exchange.
BY_EXCHANGE = (
    (0x0001, "RSA", "NULL_MD5 NULL_SHA"),
    (0x0003, "RSA_EXPORT", "RC4_40_MD5"),
    (0x0004, "RSA", "RC4_128_MD5 RC4_128_SHA"),
    (0x0006, "RSA_EXPORT", "RC2_CBC_40_MD5"),
    (0x0007, "RSA", "IDEA_CBC_SHA"),
    (0x0008, "RSA_EXPORT", "DES40_CBC_SHA"),
    (0x0009, "RSA", "DES_CBC_SHA 3DES_EDE_CBC_SHA"),
    (0x000B, "DH_DSS_EXPORT", "DES40_CBC_SHA"),
    (0x000C, "DH_DSS", "DES_CBC_SHA 3DES_EDE_CBC_SHA"),
    (0x000E, "DH_RSA_EXPORT", "DES40_CBC_SHA"),
    (0x000F, "DH_RSA", "DES_CBC_SHA 3DES_EDE_CBC_SHA"),
    (0x0011, "DHE_DSS_EXPORT", "DES40_CBC_SHA"),
    (0x0012, "DHE_DSS", "DES_CBC_SHA 3DES_EDE_CBC_SHA"),
    (0x0014, "DHE_RSA_EXPORT", "DES40_CBC_SHA"),
    (0x0015, "DHE_RSA", "DES_CBC_SHA 3DES_EDE_CBC_SHA"),
    (0x0017, "DH_anon_EXPORT", "RC4_40_MD5"),
    (0x0018, "DH_anon", "RC4_128_MD5"),
    (0x0019, "DH_anon_EXPORT", "DES40_CBC_SHA"),
    (0x001A, "DH_anon", "DES_CBC_SHA 3DES_EDE_CBC_SHA"),
    (0x001E, "KRB5", "DES_CBC_SHA 3DES_EDE_CBC_SHA RC4_128_SHA IDEA_CBC_SHA DES_CBC_MD5 3DES_EDE_CBC_MD5 RC4_128_MD5 IDEA_CBC_MD5"),
    (0x0026, "KRB5_EXPORT", "DES_CBC_40_SHA RC2_CBC_40_SHA RC4_40_SHA DES_CBC_40_MD5 RC2_CBC_40_MD5 RC4_40_MD5"),
    (0x002C, _PSK, "NULL_SHA"),
    (0x003B, "RSA", "NULL_SHA256 AES_128_CBC_SHA256 AES_256_CBC_SHA256"),
    (0x006C, "DH_anon", "AES_128_CBC_SHA256 AES_256_CBC_SHA256"),
    (0x008A, _PSK, "RC4_128_SHA 3DES_EDE_CBC_SHA AES_128_CBC_SHA AES_256_CBC_SHA"),
    (0x009C, _GCM_ORDER + " " + _PSK, "AES_128_GCM_SHA256 AES_256_GCM_SHA384"),
    (0x00AE, _PSK, "AES_128_CBC_SHA256 AES_256_CBC_SHA384 NULL_SHA256 NULL_SHA384"),
    (0xC001, "ECDH_ECDSA ECDHE_ECDSA ECDH_RSA ECDHE_RSA ECDH_anon", "NULL_SHA RC4_128_SHA 3DES_EDE_CBC_SHA AES_128_CBC_SHA AES_256_CBC_SHA"),
    (0xC023, _CURVES, "AES_128_CBC_SHA256 AES_256_CBC_SHA384"),
    (0xC02B, _CURVES, "AES_128_GCM_SHA256 AES_256_GCM_SHA384"),
    (0xC033, "ECDHE_PSK", "RC4_128_SHA 3DES_EDE_CBC_SHA AES_128_CBC_SHA AES_256_CBC_SHA AES_128_CBC_SHA256 AES_256_CBC_SHA384 NULL_SHA NULL_SHA256 NULL_SHA384"),
    (0xC03C, _CLASSIC + " " + _CURVES, "ARIA_128_CBC_SHA256 ARIA_256_CBC_SHA384"),
    (0xC050, _GCM_ORDER + " " + _CURVES, "ARIA_128_GCM_SHA256 ARIA_256_GCM_SHA384"),
    (0xC064, _PSK, "ARIA_128_CBC_SHA256 ARIA_256_CBC_SHA384"),
    (0xC06A, _PSK, "ARIA_128_GCM_SHA256 ARIA_256_GCM_SHA384"),
    (0xC070, "ECDHE_PSK", "ARIA_128_CBC_SHA256 ARIA_256_CBC_SHA384"),
    (0xC072, _CURVES, "CAMELLIA_128_CBC_SHA256 CAMELLIA_256_CBC_SHA384"),
    (0xC07A, _GCM_ORDER + " " + _CURVES, "CAMELLIA_128_GCM_SHA256 CAMELLIA_256_GCM_SHA384"),
    (0xC08E, _PSK, "CAMELLIA_128_GCM_SHA256 CAMELLIA_256_GCM_SHA384"),
    (0xC094, _PSK + " ECDHE_PSK", "CAMELLIA_128_CBC_SHA256 CAMELLIA_256_CBC_SHA384"),
    (0xC09C, "RSA DHE_RSA", "AES_128_CCM AES_256_CCM"),
    (0xC0A0, "RSA DHE_RSA", "AES_128_CCM_8 AES_256_CCM_8"),
    (0xC0A4, "PSK DHE_PSK", "AES_128_CCM AES_256_CCM"),
    (0xC0A8, "PSK PSK_DHE", "AES_128_CCM_8 AES_256_CCM_8"),
    (0xC0AC, "ECDHE_ECDSA", "AES_128_CCM AES_256_CCM AES_128_CCM_8 AES_256_CCM_8"),
    (0xC0B0, "ECCPWD", "AES_128_GCM_SHA256 AES_256_GCM_SHA384 AES_128_CCM_SHA256 AES_256_CCM_SHA384"),
    (0xD001, "ECDHE_PSK", "AES_128_GCM_SHA256 AES_256_GCM_SHA384 AES_128_CCM_8_SHA256"),
    (0xD005, "ECDHE_PSK", "AES_128_CCM_SHA256"),
)
# Runs in which each cipher has all exchanges before the next cipher.
BY_CIPHER = (
    (0x002F, _CLASSIC, "AES_128_CBC_SHA AES_256_CBC_SHA"),
    (0x003E, "DH_DSS DH_RSA DHE_DSS", "AES_128_CBC_SHA256"),
    (0x0041, _CLASSIC, "CAMELLIA_128_CBC_SHA"),
    (0x0067, "DHE_RSA", "AES_128_CBC_SHA256"),
    (0x0068, "DH_DSS DH_RSA DHE_DSS DHE_RSA", "AES_256_CBC_SHA256"),
    (0x0084, _CLASSIC, "CAMELLIA_256_CBC_SHA"),
    (0x0096, _CLASSIC, "SEED_CBC_SHA"),
    (0x00BA, _CLASSIC, "CAMELLIA_128_CBC_SHA256 CAMELLIA_256_CBC_SHA256"),
    (0xC01A, "SRP_SHA SRP_SHA_RSA SRP_SHA_DSS", "3DES_EDE_CBC_SHA AES_128_CBC_SHA AES_256_CBC_SHA"),
    (0xCCA8, "ECDHE_RSA ECDHE_ECDSA DHE_RSA PSK ECDHE_PSK DHE_PSK RSA_PSK", "CHACHA20_POLY1305_SHA256"),
)
# Names of other forms, by first number.
PLAIN = (
    (0x0000, "NULL_WITH_NULL_NULL"),
    (0x00FF, "EMPTY_RENEGOTIATION_INFO_SCSV"),
    (0x1301, "AES_128_GCM_SHA256 AES_256_GCM_SHA384 CHACHA20_POLY1305_SHA256 AES_128_CCM_SHA256 AES_128_CCM_8_SHA256"),
    (0x5600, "FALLBACK_SCSV"),
)


def suites() -> dict[int, str]:
    """Names by number."""
    out: dict[int, str] = {}
    for start, names in PLAIN:
        out |= {start + i: f"TLS_{n}" for i, n in enumerate(names.split())}
    for runs, exchanges_first in ((BY_EXCHANGE, True), (BY_CIPHER, False)):
        for start, exchanges, ciphers in runs:
            a, b = exchanges.split(), ciphers.split()
            pairs = [(x, y) for x in a for y in b] if exchanges_first else [(x, y) for y in b for x in a]
            for i, (x, y) in enumerate(pairs):
                assert start + i not in out, hex(start + i)
                out[start + i] = f"TLS_{x}_WITH_{y}"
    return dict(sorted(out.items()))
