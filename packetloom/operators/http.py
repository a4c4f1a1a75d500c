"""HTTP messages of streams, and findings in requests."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .findings import finding, rows
from .flows import KEY
from .ordered import ordered_map
from .reassembly import CLIENT, SERVER

BUFFER, MOST_HEADERS, POISON = 65_536, 96, 3
SCHEMA = "lower_key binary, lower_port int, upper_key binary, upper_port int, inst long, at long, sub int, ts long, what string, direction string, method string, uri string, version int, host string, user_agent string, status int, n long"
_TOKEN = re.compile(rb"[!#$%&'*+.^_`|~0-9A-Za-z-]+\Z")
_REQUEST = re.compile(rb"([!#$%&'*+.^_`|~0-9A-Za-z-]+) ([\x21-\x7e\x80-\xff]+) HTTP/1\.([01])\r?\n")
_STATUS = re.compile(rb"HTTP/1\.([01]) ([0-9]{3})(?: [\t\x20-\x7e\x80-\xff]*)?\r?\n")


class Bad(Exception):
    """A message that can't be HTTP; ``args[0]`` is True where only its headers are too many."""


def head(buffer: bytes, first: re.Pattern) -> tuple[re.Match, dict[bytes, bytes], int] | None:
    """First line, headers and length of a message head; None where more bytes are needed."""
    skip = len(buffer) - len(buffer.lstrip(b"\r\n"))
    line = first.match(buffer, skip)
    if line is None:
        end = buffer.find(b"\n", skip)
        if end < 0 and re.fullmatch(rb"[\x20-\x7e\x80-\xff]*\r?", buffer[skip:]):
            return None
        raise Bad(False)
    at, fields, n = line.end(), {}, 0
    while True:
        end = buffer.find(b"\n", at)
        if end < 0:
            return None
        text = buffer[at:end].removesuffix(b"\r")
        at = end + 1
        if not text:
            return line, fields, at
        name, colon, value = text.partition(b":")
        if not colon or not _TOKEN.match(name) or re.search(rb"[\x00-\x08\x0a-\x1f\x7f]", value):
            raise Bad(False)
        n += 1
        if n > MOST_HEADERS:
            raise Bad(True)
        fields.setdefault(name.lower(), value)


def messages(routed: DataFrame) -> DataFrame:
    """Rows of ``SCHEMA``: request, response, error, flood (too many headers), foreign (a flow that isn't HTTP) and skipped (bytes after that)."""

    def run(key: tuple, chunks: Iterator[dict]) -> Iterator[tuple]:
        held = {CLIENT: b"", SERVER: b""}
        errors, poisoned, foreign = {CLIENT: 0, SERVER: 0}, set(), False
        text = lambda f, k: f[k].decode("utf-8", "replace").strip() if k in f else None
        for c in chunks:
            way, sub = c["direction"], 0

            def row(what, method=None, uri=None, version=None, host=None, agent=None, status=None, n=1, c=c, way=way):
                return (*key, c["ip_idx"], sub + 100 * c["sub"], c["ts"], what, way, method, uri, version, host, agent, status, n)

            if way in poisoned:
                yield row("skipped", n=len(c["data"]))
                continue
            buffer = held[way] + c["data"][: BUFFER - len(held[way])]
            good = False
            while buffer:
                try:
                    got = head(buffer, _REQUEST if way == CLIENT else _STATUS)
                except Bad as e:
                    buffer = b""
                    if good:
                        break
                    yield row("error")
                    errors[way] += 1
                    if errors[way] >= POISON:
                        poisoned.add(way)
                        if not foreign:
                            foreign = True
                            yield row("foreign")
                    if e.args[0]:
                        yield row("flood")
                    break
                if got is None:
                    break
                line, fields, size = got
                good, errors[way], buffer, sub = True, 0, buffer[size:], sub + 1
                if way == CLIENT:
                    yield row("request", line[1].decode(), line[2].decode("utf-8", "replace"), int(line[3]), text(fields, b"host"), text(fields, b"user-agent"))
                else:
                    yield row("response", version=int(line[1]), status=int(line[2]))
            held[way] = buffer

    mine = routed.where("route = 'Http'").select(*KEY, "inst", "ip_idx", "sub", "ts", "direction", "data")
    return ordered_map(mine, [*KEY, "inst"], ["ip_idx", "sub"], run, SCHEMA)


# What a URI of interest holds.
TRAVERSAL = ("../", "..%2f", "..%252f", "....//")
WEB_SHELLS = ("/shell.php", "/shell.asp", "/shell.jsp", "/cmd.php", "/cmd.asp", "/cmd.jsp", "/c99.php", "/r57.php", "/webshell", "/backdoor")
ADMIN = ("/wp-admin", "/admin", "/phpmyadmin", "/manager")
UNUSUAL = ("CONNECT", "TRACE", "DELETE", "OPTIONS")
LONG_URI = 2048


def holds_any(text, parts):
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def at_most_bytes(text, n: int):
    """The longest prefix of whole characters within ``n`` bytes of UTF-8."""
    cut = F.substring(text.cast("binary"), 1, n)
    whole = F.coalesce(*[F.when(F.is_valid_utf8(F.substring(cut, F.lit(1), F.octet_length(cut) - k).cast("string")), F.substring(cut, F.lit(1), F.octet_length(cut) - k).cast("string")) for k in range(4)])
    return F.when(F.octet_length(text) <= n, text).otherwise(whole)


def detect(found: DataFrame) -> DataFrame:
    """Findings in the rows of :func:`messages`."""
    uri, method, low = F.col("uri"), F.col("method"), F.lower("uri")
    short = at_most_bytes(uri, 120)
    seen, line = F.array(F.concat(F.lit("URI: "), uri)), F.array(F.concat(method, F.lit(" "), uri))
    request = F.col("what") == "request"
    no_host = F.when(F.col("host").isNull(), "HTTP/1.1 request without Host header").when(F.col("host") == "", "HTTP/1.1 request with empty Host header")
    flood = F.lit("Excessive HTTP headers exceeded parser limit (possible DoS or header-based attack)")
    side = F.when(F.col("direction") == CLIENT, "Direction: request").otherwise("Direction: response")
    return rows(found, 2, F.col("at") * 1_000_000 + F.col("sub"), F.col("ts"), [
        (request & holds_any(low, TRAVERSAL), finding("Reconnaissance", "Likely", "High", F.concat(F.lit("Path traversal in URI: "), short), seen, ["T1083"], 1, direction=CLIENT)),
        (request & holds_any(low, WEB_SHELLS), finding("Execution", "Likely", "Medium", F.concat(F.lit("Possible web shell access: "), short), seen, ["T1505.003"], 2, direction=CLIENT)),
        (request & holds_any(low, ADMIN), finding("Reconnaissance", "Inconclusive", "Low", F.concat(F.lit("Admin panel access: "), short), seen, ["T1046"], 3, direction=CLIENT)),
        (request & method.isin(*UNUSUAL), finding("Reconnaissance", "Inconclusive", "Medium", F.concat(F.lit("Unusual HTTP method: "), method), line, [], 4, direction=CLIENT)),
        (request & (F.col("version") == 1) & no_host.isNotNull(), finding("Anomaly", "Inconclusive", "Medium", no_host, line, [], 5, direction=CLIENT)),
        (request & (F.octet_length(uri) > LONG_URI), finding("Execution", "Likely", "Medium", F.concat(F.lit("Abnormally long URI ("), F.octet_length(uri).cast("string"), F.lit(" chars)")), F.array(F.concat(F.lit("URI prefix: "), at_most_bytes(uri, 200))), [], 6, direction=CLIENT)),
        (request & (F.col("user_agent") == ""), finding("Anomaly", "Inconclusive", "Low", F.lit("Empty User-Agent header"), line, [], 7, direction=CLIENT)),
        (F.col("what") == "flood", finding("Anomaly", "Inconclusive", "Medium", flood, F.array(side), ["T1499.002"], 8, direction=F.col("direction"))),
    ])


def top(found: DataFrame, column: str, n: int = 20) -> DataFrame:
    """The ``n`` most frequent values, ties by value."""
    return found.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)


#: Values of a counter that are told apart: the first ones to occur, as in the report that this one matches.
MOST_KEYS = 50_000


def first_keys(values: DataFrame, order: list[str], most: int | None = MOST_KEYS) -> DataFrame:
    """``field``, ``value``, ``n`` of ``values`` (field, value, ``order``): of each field the ``most`` values that occur first, or all (None)."""
    if most is None:
        return values.groupBy("field", "value").agg(F.count("*").alias("n"))
    seen = values.groupBy("field", "value").agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("_first"))
    # Fields are few; more than ``most`` values of one are put in order within tasks before they meet.
    w = Window.partitionBy("field", "_part").orderBy("_first")
    near = seen.withColumn("_part", F.pmod(F.xxhash64("value"), F.lit(64))).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    return near.withColumn("_n", F.row_number().over(Window.partitionBy("field").orderBy("_first"))).where(F.col("_n") <= most).select("field", "value", "n")


def recent_uris(found: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` URIs, in order: ``nth``, ``uri``."""
    first = found.where("what = 'request'").select("at", "sub", "uri").orderBy("at", "sub").limit(n)
    return first.select(F.row_number().over(Window.orderBy("at", "sub")).alias("nth"), "uri")


def counts(found: DataFrame) -> DataFrame:
    """``field``, ``value``, ``n``: every counter of the summary, one row for each value."""
    parts = (("request", "method", "methods"), ("request", "user_agent", "user_agents"), ("request", "host", "hosts"), ("response", "status", "status_codes"))
    each = F.array(*[F.struct(F.lit(field).alias("field"), F.when(F.col("what") == what, F.col(c).cast("string")).alias("value")) for what, c, field in parts])
    values = found.select("at", "sub", F.explode(each).alias("x")).select("at", "sub", "x.*").where("value IS NOT NULL")
    names = F.create_map(*[F.lit(x) for x in ("response", "transactions", "error", "parse_errors", "foreign", "non_http_flows", "skipped", "poisoned_bytes_skipped")])
    sums = found.where(F.col("what").isin("response", "error", "foreign", "skipped")).groupBy("what").agg(F.sum("n").alias("n")).select(names[F.col("what")].alias("value"), "n").withColumn("field", F.lit("counters"))
    return first_keys(values, ["at", "sub"]).unionByName(sums)
