r"""Personal data by bootstrapped contextual extraction, with DataFrame functions only.

Four patterns find e-mail addresses, IP addresses, payment cards and telephone numbers.
These seeds, whole spans with or without spaces and digits, induce lexical patterns: the
two words before an entity and the word behind it, without case and the marks around them. Spark scores patterns and instances in
rounds: a pattern by the known values in its place, a run of words by how often it stands
in the places of good patterns. What is found adds contexts of its own, until nothing new
is known, so unseen identifiers of any form that stand where known ones stand are found.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import stage
from .spans import SPAN, spans, text_of

# Possessive groups are walked in a loop, and a look behind keeps long runs linear.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
IP_VALID = rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$"
BASE_KINDS = ("email", "ip", "card", "phone")
#: Words in an instance at most: a card in groups of four has four, a spaced telephone number three to six.
MOST = 8
#: Where a word begins, and the marks around one. Each is found in one pass over a text of any length.
BOUNDARY = r"(?<=[\x20\x09-\x0D:=])(?![\x20\x09-\x0D])"
EDGES = r"^[^0-9\p{L}+]++|(?<![^0-9\p{L}])[^0-9\p{L}]++$"
#: Patterns or values up to which their table (16 bytes a row) is broadcast to the scan.
BROADCAST_ROWS = 2_000_000


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    figures = F.transform(F.split(F.reverse(number), ""), lambda c: F.try_element_at(F.array(*[F.lit(i) for i in range(10)]), F.ascii(c) - 47))
    added = F.transform(figures, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(added, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def _base_spans(text: Column) -> list[Column]:
    emails = spans(text, EMAIL, "email", 0, text.contains("@"), BOUNDARY)
    ips = F.filter(spans(text, IP, "ip", 1, boundary=BOUNDARY), lambda s: s["value"].rlike(IP_VALID))
    cards = F.filter(spans(text, CARD, "card", 2, text.rlike("[0-9](?:[\\x20-]?[0-9]){11}"), BOUNDARY), lambda s: F.length(digits(s["value"])).between(12, 19))
    cards = F.filter(cards, lambda s: luhn(digits(s["value"])))
    phones = F.filter(spans(text, PHONE, "phone", 3, text.contains("+"), BOUNDARY), lambda s: F.length(digits(s["value"])).between(9, 15))
    return [emails, ips, cards, phones]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def units(text: Column) -> Column:
    """Words with the white space behind them; a word also ends behind ``:`` or ``=``.

    Joined, they are the text between ``^ ^`` and ``$``, which stand for its ends.
    """
    return F.filter(F.split(F.concat(F.lit("^ ^ "), text, F.lit(" $ ")), BOUNDARY, -1), lambda u: u != "")


def _marks_off(run: Column) -> Column:
    """A word or a run of words without the marks and white space around it; a ``+`` in front stays."""
    return F.regexp_replace(run, EDGES, "")


def word_hashes(text: Column) -> Column:
    """A hash of each of :func:`units`, without case and the marks around it; 0 for one of marks only, as the ends are."""
    return F.transform(units(text), lambda u: let(F.lower(_marks_off(u)), lambda w: F.when(w == "", F.lit(0).cast("bigint")).otherwise(F.xxhash64(w))))


def _pattern(i: Column, j: Column, words: str = "words") -> list[Column]:
    """left, right and value of the run of ``j`` words from word ``i`` of ``words``: the two words before, the one behind, the run."""
    left = F.xxhash64(F.get(words, i - 2), F.get(words, i - 1))
    return [left.alias("left"), F.get(words, i + j).alias("right"), F.xxhash64(F.slice(words, i + 1, j)).alias("value")]


def _joined(each: DataFrame, near: Column, table: DataFrame, key: str) -> DataFrame:
    """The words of ``each`` that ``table`` has by ``key``, with ``near``, the words around them.

    A table of at most ``BROADCAST_ROWS`` rows (of two numbers) is broadcast, and only words
    that it has get their neighbours. For a larger one all words are shuffled, each with
    its few neighbours, never with its text.
    """
    if table.count() <= BROADCAST_ROWS:
        return each.join(F.broadcast(table), key).withColumn("near", near).drop("words")
    return each.withColumn("near", near).drop("words").join(table, key)


def _in_patterns(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """The runs of at most ``MOST`` words that stand between the words of ``patterns`` (left, right): left, right, value, first."""
    each = texts.select("words", F.posexplode("words").alias("at", "word"))
    each = each.withColumn("left", F.xxhash64(F.get("words", F.col("at") - 1), "word")).where("at >= 1").drop("word")
    met = _joined(each, F.slice("words", F.col("at") + 2, F.lit(MOST + 1)), patterns, "left")
    met = met.withColumn("j", F.array_position(F.slice("near", F.lit(2), F.lit(MOST)), F.col("right")).cast("int")).where("j > 0")
    run = F.slice("near", F.lit(1), F.col("j"))
    # Marks alone are no value. A lambda here would keep the join out of generated code, which copies a text's words for each of them.
    met = met.where(F.size(F.array_remove(run, 0)) > 0)
    return met.select("left", "right", F.xxhash64(run).alias("value"), F.get("near", F.lit(0)).alias("first"))


def _of_values(texts: DataFrame, values: DataFrame) -> DataFrame:
    """Every place of ``values`` (value, first) in ``texts``: row_id, i, j (words), left, right, value."""
    each = texts.select("row_id", "words", F.posexplode("words").alias("i", "first")).where("i >= 2")
    met = _joined(each, F.slice("words", F.col("i") - 1, F.lit(MOST + 3)), values.select("first").distinct(), "first")
    met = met.where(F.size("near") > 3).withColumn("j", F.explode(F.sequence(F.lit(1), F.size("near") - 3)))
    met = met.select("row_id", "i", "j", *_pattern(F.lit(2), F.col("j"), "near"))
    values = values.select("value").distinct()
    return met.join(F.broadcast(values) if values.count() <= BROADCAST_ROWS else values, "value")


def bootstrap(texts: DataFrame, seeds: DataFrame, rounds: int | None = None, min_support: int = 3, min_score: float = 1.0, min_share: float = 0.1) -> DataFrame | None:
    """Places (row_id, i, j) of the values that are found beyond ``seeds`` (left, right, value); None if there are none.

    ``texts``: row_id and ``words``, the hashes of :func:`word_hashes`. Only these are read
    in the rounds, once for new patterns and once for new values.

    A pattern with k known of n distinct values in its place scores k / n * log2(k); it
    is good from ``min_score`` and ``min_support`` known values on, so the more known values
    it has, the more new ones may stand beside them. A value in a good pattern's place is
    known from then on, unless less than ``min_share`` of its places in all texts are
    those of good patterns, as with common words. Rounds end when nothing new is known,
    or after ``rounds``.
    """
    pair = ["left", "right"]
    votes = stage(seeds.distinct(), "pii-votes")
    known = votes.select("value").distinct()
    looked = inside = places = tried = None
    found: DataFrame | None = None
    turn = 0
    while rounds is None or turn < rounds:
        turn += 1
        hopeful = votes.groupBy(*pair, "value").count().groupBy(*pair).agg(F.count("*").alias("k")).where(F.col("k") >= min_support).select(*pair)
        hopeful = stage(hopeful if looked is None else hopeful.join(looked, pair, "left_anti"), "pii-patterns")
        if not hopeful.isEmpty():
            looked = hopeful if looked is None else looked.unionByName(hopeful)
            more = stage(_in_patterns(texts, hopeful).groupBy(*pair, "value", "first").agg(F.count("*").alias("n")), "pii-inside")
            inside = more if inside is None else inside.unionByName(more)
        if inside is None:
            break
        edges = inside.groupBy(*pair, "value").agg(F.sum("n").alias("n")).join(known.withColumn("known", F.lit(1)), "value", "left")
        scored = edges.groupBy(*pair).agg(F.count("known").alias("k"), F.count("*").alias("all")).where(F.col("k") >= min_support)
        good = scored.where(F.col("k") / F.col("all") * F.log2(F.col("k").cast("double")) >= min_score).select(*pair)
        # A place between two good patterns' words counts once for each, at most as often as it stands in the texts.
        mine = inside.join(good, pair).groupBy("value", "first").agg(F.sum("n").alias("n")).join(known, "value", "left_anti")
        mine = stage(mine, "pii-mine")
        fresh = mine if tried is None else mine.join(tried, "value", "left_anti")
        fresh = stage(fresh.select("value", "first"), "pii-fresh")
        if not fresh.isEmpty():
            more = stage(_of_values(texts, fresh), "pii-places")
            places = more if places is None else places.unionByName(more)
            tried = fresh.select("value").distinct() if tried is None else tried.unionByName(fresh.select("value").distinct())
        if places is None:
            break
        total = places.groupBy("value").agg(F.count("*").alias("total"))
        new = mine.groupBy("value").agg(F.sum("n").alias("n")).join(total, "value").where(F.col("n") >= min_share * F.col("total")).select("value")
        new = stage(new, "pii-new")
        if new.isEmpty():
            break
        known = stage(known.unionByName(new), "pii-known")
        found = new if found is None else found.unionByName(new)
        votes = stage(votes.unionByName(places.join(new, "value").select(*pair, "value")).distinct(), "pii-votes")
    return None if found is None else places.join(found, "value").select("row_id", "i", "j")


def _found(rows: DataFrame, carried: list[str], body: Column, rounds: int | None) -> DataFrame:
    """``carried`` and the spans of ``rows``, whose text is ``body``. They are written once with their words' hashes."""
    lean = lambda s: F.struct(s["start"], s["ord"], s["stop"], s["kind"], F.lit("").alias("value"))
    scanned = rows.select(*carried, F.concat(*_base_spans(body)).alias("base"), word_hashes(body).alias("words"), F.monotonically_increasing_id().alias("row_id"))
    places = F.transform("base", lambda s: F.struct(s["unit"].alias("i"), s["units"].alias("j")))
    scanned = stage(scanned.select(*carried, "row_id", F.transform("base", lean).cast(SPAN).alias("base_spans"), places.alias("places"), "words"), "pii", "zstd")
    seeds = scanned.where(F.size("places") > 0).select("words", F.explode("places").alias("p")).select(*_pattern(F.col("p.i"), F.col("p.j")))
    places = bootstrap(scanned.select("row_id", "words"), seeds, rounds)
    scanned = scanned.drop("places", "words")
    if places is None:
        return scanned.withColumn("pii_spans", F.sort_array("base_spans"))
    hits = stage(places.groupBy("row_id").agg(F.collect_set(F.struct("i", "j")).alias("hits")), "pii-hits")

    def span(u: Column, h: Column) -> Column:
        start = F.aggregate(F.slice(u, F.lit(1), h["i"]), F.lit(-4).cast("bigint"), lambda a, x: a + F.length(x))
        run = F.array_join(F.slice(u, h["i"] + 1, h["j"]), "")
        first = start + F.length(F.regexp_extract(run, r"^[^0-9\p{L}+]*+", 0))
        return F.struct(first.alias("start"), F.lit(4).alias("ord"), (first + F.length(_marks_off(run))).alias("stop"), F.lit("context").alias("kind"), F.lit("").alias("value"))

    more = F.when(F.col("hits").isNotNull(), let(units(body), lambda u: F.transform("hits", lambda h: span(u, h)))).otherwise(F.array()).cast(SPAN)
    touched = lambda t: F.exists("base_spans", lambda s: (s["start"] < t["stop"]) & (t["start"] < s["stop"]))
    out = scanned.join(hits, "row_id", "left").withColumn("more", more)
    return out.select(*carried, "row_id", "base_spans", F.sort_array(F.concat("base_spans", F.filter("more", lambda t: ~touched(t)))).alias("pii_spans"))


def find_pii(docs: DataFrame, text: str = "text", rounds: int | None = None) -> DataFrame:
    """``doc_id``, ``row_id`` and the spans of every row: ``base_spans`` and ``pii_spans`` (all).

    The added kind is ``context``: a run of words that no base span touches and that
    the rounds have found. Null and empty texts have no spans; repeated rows have
    equal spans; other columns of ``docs`` don't matter.
    """
    return _found(docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text")), ["doc_id", "text"], F.col("text"), rounds).drop("text")


def redact(docs: DataFrame, text: str = "text", rounds: int | None = None) -> DataFrame:
    """``docs`` with every span of personal data in ``text`` replaced by its kind: ``<email>``.

    All rows and columns stay, whatever their names. Spans that overlap are replaced
    together, under the kind of the first. A null text stays null.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    body = F.col("row").getField(text)
    found = _found(rows, ["row"], F.coalesce(body, F.lit("")), rounds)

    def step(acc: Column, s: Column) -> Column:
        part = F.concat(acc["out"], body.substr(acc["at"] + 1, (s["start"] - acc["at"]).cast("int")), F.lit("<"), s["kind"], F.lit(">"))
        return F.struct(F.greatest(acc["at"], s["stop"].cast("int")).alias("at"), F.when(s["start"] >= acc["at"], part).otherwise(acc["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate("pii_spans", zero, step, lambda acc: F.concat(acc["out"], body.substr(acc["at"] + 1, F.length(body))))
    clean = F.when(F.size("pii_spans") == 0, body).otherwise(clean)
    return found.select(*[(clean if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    n = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[n(k) for k in BASE_KINDS], F.sha2(text_of(F.col("base_spans")), 256).alias("base_sha256"), text_of(F.col("pii_spans")).alias("spans"))
