r"""Secret scanning with corpus-wide ownership, with DataFrame functions only.

Candidates are found per document. Their value hashes are then counted over the whole
corpus by distinct repositories and owners: a value that many owners hold or that many
repositories contain is a copied example, one that few hold and that looks random is taken for a live credential.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import stage
from .skew import join_hot
from .spans import SPAN, spans, text_of

ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*+[:=]\x20*+["']?"""
VALUE = r"[A-Za-z0-9+/_.=-]+"
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
#: The kinds beyond the base: signed tokens, key blocks, passwords in URLs, issued tokens.
JWT = r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"
#: A key block through its END line, or where that is missing the long lines behind its header.
PEM = (
    r"-----BEGIN (?:(?!PRIVATE KEY)[A-Z]++ )*+PRIVATE KEY-----"
    r"(?:(?:(?:[\x20\x09-\x0D]|\\[nr])*+[A-Za-z-]++:\x20(?:(?!-----)[^\r\n\\])++)*+[A-Za-z0-9+/=\x20\x09-\x0D\\]*+-----END (?:(?!PRIVATE KEY)[A-Z]++ )*+PRIVATE KEY-----"
    r"|(?:(?:[\x20\x09-\x0D]|\\[nr])*+[A-Za-z0-9+/]{16,}+={0,2})*+)"
)
URL = r"(?<![A-Za-z0-9+.-])[a-z][a-z0-9+]++://[^\x20\x09-\x0D/:@]++:[^\x20\x09-\x0D/@]{3,}+@"
ISSUED = r"(?<![A-Za-z0-9_-])(?:gh[pousr]_[A-Za-z0-9]{36,}+|xox[abprs]-[A-Za-z0-9-]{20,}+|sk-[A-Za-z0-9_-]{32,}+|AIza[A-Za-z0-9_-]{35})"
BASE_KINDS = ("assign", "access", "hex")


def _base_spans(text: Column) -> list[Column]:
    # A short group 2 is dropped after the match, so the search goes on behind it.
    assign = F.filter(spans(text, f"{ASSIGN}{VALUE}", "assign", 0, text.rlike(r"(?i)pass?w|secret|token|api_?key")), lambda s: F.length(F.regexp_extract(s["value"], f"{ASSIGN}({VALUE})", 1)) >= 8)
    return [assign, spans(text, ACCESS, "access", 1, text.contains("AKIA")), spans(text, HEX, "hex", 2)]


def _more_spans(text: Column) -> list[Column]:
    return [
        spans(text, JWT, "jwt", 3, text.contains("eyJ")),
        spans(text, PEM, "pem", 4, text.contains("-----BEGIN ")),
        spans(text, URL, "url", 5, text.contains("://")),
        spans(text, ISSUED, "issued", 6, text.rlike("gh[pousr]_|xox[abprs]-|sk-|AIza")),
    ]


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``base_spans`` and ``secret_spans`` (all): start, ord, stop, kind, value. Null is an empty text."""
    body = F.coalesce(F.col(text), F.lit(""))
    docs = docs.withColumn("base_spans", F.concat(*_base_spans(body)))
    return docs.withColumn("secret_spans", F.sort_array(F.concat("base_spans", *_more_spans(body))))


def credential(span: Column) -> Column:
    """What is secret in a span: of an assignment its right side, of a key block what is between its BEGIN and END lines, however broken into lines; else the whole match."""
    body = F.regexp_replace(span["value"], r"-----(?:BEGIN|END) [A-Z\x20]*+-----|\\[nr]|[^A-Za-z0-9+/=]", "")
    return F.when(span["kind"] == "assign", F.regexp_extract(span["value"], f"{ASSIGN}({VALUE})", 1)).when(span["kind"] == "pem", body).otherwise(span["value"])


def looks_random(value: Column, min_chars: int = 8) -> Column:
    """Whether a value has at least ``min_chars`` different characters and no run of six equal ones."""
    return (F.size(F.array_distinct(F.split(value, ""))) >= min_chars) & ~value.rlike(r"(.)\1{5}")


def ownership(found: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """One row per distinct credential: ``secret`` (SHA-256), places, n_repositories, n_owners.

    Rows are counted by distinct (secret, repository, owner) first, within the tasks
    that hold them, so a credential copied to a third of all documents is shuffled as
    a few rows for each task. No credential leaves the scan in clear.
    """
    one = found.select("secret", "random", repository.alias("repository"), owner.alias("owner"))
    pairs = one.groupBy("secret", "repository", "owner").agg(F.count("*").alias("places"), F.max("random").alias("random"))
    by_owner = pairs.groupBy("secret", "owner").agg(F.sum("places").alias("places"), F.max("random").alias("random"))
    repositories = pairs.select("secret", "repository").distinct().groupBy("secret").agg(F.count("repository").alias("n_repositories"))
    owners = by_owner.groupBy("secret").agg(F.sum("places").alias("places"), F.count("owner").alias("n_owners"), F.max("random").alias("random"))
    return owners.join(repositories, "secret")


def secret_scan(docs: DataFrame, repository: Column, owner: Column, text: str = "text", max_owners: int = 2, max_repositories: int = 5) -> DataFrame:
    """Scan every row of ``docs`` and judge each credential by who holds it.

    Returns ``doc_id`` and every column needed to redact: secret_spans, base_spans,
    n_live, n_example, n_weak, and n_repositories and n_owners of the row's most widely
    held credential. A credential held by more than ``max_owners`` owners or in more than
    ``max_repositories`` repositories is an example; another is live if it looks random,
    else weak. Credentials are counted once for each distinct value of a row.

    Null and empty texts have no spans; a null repository or owner counts as none;
    repeated rows are separate rows with equal results; columns of ``docs`` beyond
    doc_id don't matter. Rows keep apart by a row number fixed in a written table.
    """
    body = docs.select("doc_id", F.col(text).alias("text"), repository.alias("repository"), owner.alias("owner"))
    found = find_secrets(body).drop("text").withColumn("row_id", F.monotonically_increasing_id())
    secrets = F.transform("secret_spans", lambda s: F.struct(F.sha2(credential(s), 256).alias("secret"), looks_random(credential(s)).alias("random")))
    # The spans go on without their values: only hashes are written.
    bare = lambda c: F.transform(c, lambda s: F.struct(s["start"], s["ord"], s["stop"], s["kind"], F.lit("").alias("value"))).cast(SPAN)
    scanned = stage(
        found.select("doc_id", "row_id", "repository", "owner", bare("base_spans").alias("base_spans"), bare("secret_spans").alias("secret_spans"), F.array_distinct(secrets).alias("secrets")),
        "secrets",
    )
    each = scanned.where(F.size("secrets") > 0).select("row_id", "repository", "owner", F.explode("secrets").alias("s")).select("row_id", "repository", "owner", "s.secret", "s.random")
    held = stage(ownership(each, F.col("repository"), F.col("owner")), "secrets-held")
    verdict = F.when((F.col("n_owners") > max_owners) | (F.col("n_repositories") > max_repositories), "example").when(F.col("random"), "live").otherwise("weak")
    # A credential that a large share of all rows hold is broadcast to them; its rows never meet in one task.
    judged = join_hot(each.select("row_id", "secret"), held.select("secret", verdict.alias("verdict"), "n_repositories", "n_owners", "places"), ["secret"], "places")
    widest = [F.max(c).alias(c) for c in ("n_repositories", "n_owners")]
    counts = judged.groupBy("row_id").agg(*[F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in ("live", "example", "weak")], *widest)
    out = scanned.drop("secrets", "repository", "owner").join(counts, "row_id", "left").drop("row_id")
    return out.fillna(0, ["n_live", "n_example", "n_weak", "n_repositories", "n_owners"])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    found = secret_scan(docs, F.concat_ws("/", "source", "lang"), F.col("source"))
    n = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[n(k) for k in BASE_KINDS], F.sha2(text_of(F.col("base_spans")), 256).alias("base_sha256"), text_of(F.col("secret_spans")).alias("spans"), "n_live", "n_example", "n_weak", "n_repositories", "n_owners")
