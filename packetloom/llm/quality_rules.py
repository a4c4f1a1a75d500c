"""Line-first cleaning of documents, with DataFrame functions only.

Each line is judged by punctuation, navigation and boilerplate rules. Failing lines
are removed, and a document that loses too much of its text is rejected. Everything
is computed within a row: the plan has no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
WORD_CHAR = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
#: A mark that ends a sentence, followed by a space, a closing mark or the line's end.
SENTENCE_END = r"[.!?…。！？]([\x20\x09-\x0D\"')\]»”’]|$)"
#: Marks that stand between the entries of menus and bread crumbs.
SEPARATOR = r"[|»›·•]"
BOILERPLATE = (
    r"(?i)(all rights reserved|privacy policy|terms of (use|service)|cookie (policy|settings)|(uses?|accept) cookies"
    r"|enable javascript|subscribe to|sign (in|up) (to|for|now)|click here|share (this|on)|licen[sc]ed under|copyright (\(c\)|©))"
)
WINDOW = 8


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def line_passes(line: Column) -> Column:
    """Whether a line with words is kept.

    Punctuation: it holds the end of a sentence, and at most three symbols of
    ``#*$%&|<>`` for ten words. Navigation: fewer than two separators for five
    words. Boilerplate: none of the fixed phrases.
    """
    n_words = F.size(word_list(line))
    return (
        line.rlike(SENTENCE_END)
        & (F.regexp_count(line, F.lit(SYMBOL)) * 10 <= n_words * 3)
        & ((F.regexp_count(line, F.lit(SEPARATOR)) < 2) | (F.regexp_count(line, F.lit(SEPARATOR)) * 5 < n_words * 2))
        & ~line.rlike(BOILERPLATE)
    )


def clean_lines(docs: DataFrame, text: str = "text", max_lost: float = 0.5) -> DataFrame:
    """Add ``clean_text``, ``n_words``, ``n_clean_words`` and ``line_kept``.

    ``line_kept`` is false where more than ``max_lost`` of the words stood on removed
    lines, or where there is no word. Lines without words stay. Null is an empty text.
    """
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    good = F.filter(lines, lambda x: ~x.rlike(WORD_CHAR) | line_passes(x))
    out = docs.withColumn("clean_text", F.array_join(good, "\n"))
    out = out.withColumn("n_words", F.size(word_list(F.coalesce(F.col(text), F.lit("")))).cast("long"))
    out = out.withColumn("n_clean_words", F.size(word_list(F.col("clean_text"))).cast("long"))
    lost = F.col("n_words") - F.col("n_clean_words")
    return out.withColumn("line_kept", (F.col("n_words") > 0) & (lost <= F.col("n_words") * F.lit(max_lost)))


def _repeat_words(df: DataFrame) -> DataFrame:
    """Add ``n_repeat_words`` from ``_words``.

    Windows are compared by a 64-bit hash. Where some window occurs twice, windows are
    sorted by hash, the positions of equal neighbours are sorted again, and each covers
    eight words or as many as lie before the next position.
    """
    df = df.withColumn("_windows", F.transform("_words", lambda w: F.xxhash64(w)))
    for step in (1, 2, 4):  # a run of 2, 4, then 8 words is a pair of shorter runs
        ahead = F.slice("_windows", F.lit(1 + step), F.size("_windows"))
        first = F.slice("_windows", F.lit(1), F.size("_windows") - step)
        pairs = F.zip_with(first, ahead, lambda a, b: F.xxhash64(a, b))
        df = df.withColumn("_windows", F.when(F.size("_windows") > step, pairs).otherwise(F.array().cast("array<bigint>")))
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    placed = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_sorted", F.when(repeats, placed))
    n, none = F.size("_sorted"), F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    before = F.concat(none, F.slice("_sorted", F.lit(1), n - 1))
    after = F.concat(F.slice("_sorted", F.lit(2), n - 1), none)
    near = F.zip_with(before, after, lambda b, a: F.struct(b["h"].alias("b"), a["h"].alias("a")))
    hit = F.zip_with("_sorted", near, lambda s, x: F.when((s["h"] == x["b"]) | (s["h"] == x["a"]), s["i"]))
    df = df.withColumn("_hits", F.sort_array(F.filter(hit, lambda i: i.isNotNull())))
    nexts = F.concat(F.slice("_hits", F.lit(2), F.size("_hits") - 1), F.array(F.lit(None).cast("int")))
    covers = F.zip_with("_hits", nexts, lambda i, j: F.least(F.lit(WINDOW), F.coalesce(j - i, F.lit(WINDOW))))
    total = F.aggregate(covers, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.when(F.col("_sorted").isNull(), F.lit(0).cast("bigint")).otherwise(total))


def quality_rules(docs: DataFrame, text: str = "text", min_words: int = 20, max_repeat: int = 30, max_lost: float = 0.5) -> DataFrame:
    """Rule values and the verdict for every row of ``docs``.

    All columns of ``docs`` stay, whatever their names, but for those of the same names as the new ones:
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    clean_text, n_clean_words, kept. Null and empty texts have no words and fail the
    base; repeated rows get equal values; a text of any length is judged whole.
    """
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "clean_text", "n_clean_words", "line_kept", "kept"]
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in new]
    df = docs.select(F.struct(*own).alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    df = clean_lines(df, "_text", max_lost)
    df = df.withColumn("_words", word_list(F.col("_text")))
    df = df.withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
    df = df.withColumn("n_symbols", F.regexp_count(F.col("_text"), F.lit(SYMBOL)).cast("long"))
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(WORD_CHAR)))
    df = df.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    df = _repeat_words(df)
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat)
    df = df.withColumn("base_failed", failed).withColumn("kept", ~failed & F.col("line_kept"))
    return df.select("row.*", *[c for c in new if c != "line_kept"])


QUERY_COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_rules(docs).select(*QUERY_COLUMNS)


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         string_split(text, chr(10)) AS lines FROM t
), c AS (
  SELECT *, list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS full_lines FROM w
), judged AS (
  SELECT *, list_filter(full_lines, lambda x:
      regexp_matches(x, '[.!?\x{2026}\x{3002}\x{FF01}\x{FF1F}]([\x20\x09-\x0D"'')\]\x{00BB}\x{201D}\x{2019}]|$)')
      AND length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) * 10 <= len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')) * 3
      AND (length(regexp_replace(x, '[^|\x{00BB}\x{203A}\x{00B7}\x{2022}]', '', 'g')) < 2
           OR length(regexp_replace(x, '[^|\x{00BB}\x{203A}\x{00B7}\x{2022}]', '', 'g')) * 5 < len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')) * 2)
      AND NOT regexp_matches(x, '(?i)(all rights reserved|privacy policy|terms of (use|service)|cookie (policy|settings)|(uses?|accept) cookies|enable javascript|subscribe to|sign (in|up) (to|for|now)|click here|share (this|on)|licen[sc]ed under|copyright (\(c\)|\x{00A9}))')
    ) AS good FROM c
), pos AS (
  SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w
), win AS (
  SELECT rid, i, string_agg(word, ' ') OVER f AS s, count(*) OVER f AS n
  FROM pos WINDOW f AS (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)
), dup AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM win WHERE n = 8) WHERE c > 1
), cover AS (
  SELECT rid, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM dup) GROUP BY rid
), v AS (
  SELECT j.doc_id, len(j.words)::BIGINT AS n_words, length(array_to_string(j.words, ''))::BIGINT AS word_chars,
         length(regexp_replace(j.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(full_lines) - len(list_distinct(full_lines)))::BIGINT AS n_dup_lines,
         coalesce(cover.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(regexp_split_to_array(array_to_string(good, chr(10)), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS n_clean
  FROM judged j LEFT JOIN cover USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - n_clean <= n_words * 0.5 AS kept
FROM v
"""
