"""Operator 2: quality rules by line-first cleaning. DataFrame functions only.

Every line is judged alone: punctuation (a run of symbols after its words, or
many words without any sentence mark), navigation (items between bars) and
boilerplate (licence, cookie and copyright phrases). Failing lines are removed;
a document that loses more than a stated share of its text is rejected. Base
rules on length and repeated word triples come on top.

The work is per row: no shuffle, but that an input of one split is dealt over the cores. So one source or one group of copies that
holds a third of all rows costs no more than its rows. Repeated triples are
found inside the row by sorting (hash, position) packed into 64-bit integers,
each neighbour then compared word by word.

Cases: null and empty texts have no words and fail the base rules; a text
without line breaks is one line; lines without a word count nowhere; rows with
equal ids are judged each; other columns pass through where asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stratavox.llm.common import SPACE, kept_columns, spread, table

#: Marks counted as symbols.
SYMBOLS = "#*$%&|<>"
#: A run of symbols that ends a word. Used by the punctuation rule.
SYMBOL_RUN = r"[#*$%&<>!=~^_]{2,}([\x20\x09-\x0D]|$)"
SENTENCE_MARK = r"[.,;:!?]"
BOILERPLATE = r"(?i)(all rights reserved|licensed under|terms of (use|service)|privacy policy|cookie policy|accept (all )?cookies|copyright \(c\)|spdx-license|enable javascript)"
#: A line fails if over this share of its words end in a run of symbols.
SYMBOL_SHARE = 30
#: ... or if it has this many words and no sentence mark at all.
UNMARKED_WORDS = 400
#: ... or if bars are over this share of its words.
BAR_SHARE = 20
#: A document is rejected if it loses more than this share of its word characters.
LOST_SHARE = 30
MIN_WORDS = 50
REPEAT_SHARE = 50


def _words(text: Column) -> Column:
    return F.filter(F.split(text, rf"[{SPACE}]+"), lambda w: w != "")


def _chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, rf"[{SPACE}]+", ""))


def _line_fails(line: Column) -> Column:
    n = F.regexp_count(line, F.lit(rf"[^{SPACE}]+"))
    symbols = F.regexp_count(line, F.lit(SYMBOL_RUN))
    bars = F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit("")))
    return (symbols * 100 > n * SYMBOL_SHARE) | (bars * 100 > n * BAR_SHARE) | ((n >= UNMARKED_WORDS) & ~F.rlike(line, F.lit(SENTENCE_MARK))) | F.rlike(line, F.lit(BOILERPLATE))


RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_failed_lines", "lost_chars", "base_failed", "kept", "clean_text"]


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Per document the measures, the cleaned text and the verdict.

    Columns: id, those in ``keep``, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_lines, n_failed_lines, lost_chars, base_failed, kept,
    clean_text. A column in ``keep`` that is named like a result gives way to it.
    """
    # in a struct, so no kept column meets a working one
    names = [id_col, *kept_columns(keep, id_col, RESULTS)]
    base = spread(docs).select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    base = base.withColumns({"_w": _words(F.col("_t")), "_l": F.split(F.col("_t"), "\n")})
    base = base.withColumns({"_n": F.size("_w").cast("long"), "_real": F.filter("_l", lambda x: F.rlike(x, F.lit(rf"[^{SPACE}]")))})
    #: bits for a position; the rest of the 64 are the triple's hash
    base = base.withColumn("_k", F.length(F.bin(F.col("_n"))))
    packed = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("_n") - 3),
        lambda i: F.xxhash64(F.get("_w", i.cast("int")), F.get("_w", (i + 1).cast("int")), F.get("_w", (i + 2).cast("int"))).bitwiseAND(-F.expr("shiftleft(1L, _k)")).bitwiseOR(i),
    )
    base = base.withColumn("_s", F.when(F.col("_n") >= 3, F.sort_array(packed)).otherwise(F.array().cast("array<bigint>")))
    mask = F.expr("shiftleft(1L, _k) - 1")

    def same(x: Column, y: Column) -> Column:
        p, q = x.bitwiseAND(mask).cast("int"), y.bitwiseAND(mask).cast("int")
        word = lambda at, d: F.get("_w", at + d)
        return (x.bitwiseXOR(y).bitwiseAND(-F.expr("shiftleft(1L, _k)")) == 0) & (word(p, 0) == word(q, 0)) & (word(p, 1) == word(q, 1)) & (word(p, 2) == word(q, 2))

    found = F.filter("_s", lambda x, j: F.coalesce(same(x, F.get("_s", j - 1)), F.lit(False)) | F.coalesce(same(x, F.get("_s", j + 1)), F.lit(False)))
    base = base.withColumn("_p", F.sort_array(F.transform(found, lambda x: x.bitwiseAND(mask))))
    repeat = F.aggregate(
        F.transform("_p", lambda x, j: F.least(F.lit(3).cast("long"), F.coalesce(F.get("_p", j + 1) - x, F.lit(3).cast("long")))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    judged = F.transform("_real", lambda x: F.struct(x.alias("line"), _line_fails(x).alias("bad")))
    base = base.withColumns({"n_repeat_words": repeat, "_j": judged})
    failed = F.filter("_j", lambda x: x["bad"])
    measures = F.struct(
        F.col("_n").alias("n_words"),
        _chars(F.col("_t")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_real") - F.size(F.array_distinct("_real"))).cast("long").alias("n_dup_lines"),
        F.col("n_repeat_words").alias("n_repeat_words"),
        F.size("_real").cast("long").alias("n_lines"),
        F.size(failed).cast("long").alias("n_failed_lines"),
        F.aggregate(failed, F.lit(0).cast("long"), lambda a, x: a + _chars(x["line"])).alias("lost_chars"),
        F.array_join(F.transform(F.filter("_j", lambda x: ~x["bad"]), lambda x: x["line"]), "\n").alias("clean_text"),
    )
    # A generator of one row: a later filter on a measure stays above it. Pushed
    # below, it would repeat the whole computation for every word.
    out = base.select(*[F.col("_row").getField(c).alias(c) for c in names], F.inline(F.array(measures)))
    base_failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_SHARE)
    return out.withColumn("base_failed", base_failed).withColumn("kept", ~F.col("base_failed") & (F.col("lost_chars") * 100 <= F.col("word_chars") * LOST_SHARE))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("clean_text")


OP2_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^{SPACE}]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]')) AS ls FROM d),
tri AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, g) >= 2),
cov AS (SELECT doc_id, count(DISTINCT j) AS c FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM rep) GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(ls) AS x FROM w),
lm AS (SELECT doc_id, length(regexp_replace(x, '[{SPACE}]+', '', 'g')) AS c, len(regexp_extract_all(x, '[^{SPACE}]+')) AS n,
  len(regexp_extract_all(x, '{SYMBOL_RUN}')) AS s, length(x) - length(replace(x, '|', '')) AS b,
  regexp_matches(x, '{SENTENCE_MARK}') AS m, regexp_matches(x, '{BOILERPLATE}') AS p FROM ln),
lf AS (SELECT doc_id, c, coalesce(s * 100 > n * {SYMBOL_SHARE} OR b * 100 > n * {BAR_SHARE} OR (n >= {UNMARKED_WORDS} AND NOT m) OR p, false) AS bad FROM lm),
la AS (SELECT doc_id, count(*) FILTER (bad) AS nf, coalesce(sum(c) FILTER (bad), 0) AS lost FROM lf GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[{SPACE}]+', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.c, 0)::BIGINT AS n_repeat_words,
  len(ls)::BIGINT AS n_lines, coalesce(la.nf, 0)::BIGINT AS n_failed_lines, coalesce(la.lost, 0)::BIGINT AS lost_chars
  FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN la USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_failed_lines, lost_chars,
  (n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {REPEAT_SHARE}) AS base_failed,
  NOT (n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {REPEAT_SHARE}) AND lost_chars * 100 <= word_chars * {LOST_SHARE} AS kept
FROM m
"""
