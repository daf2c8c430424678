"""Line-first cleaning on DataFrame functions alone.

Rules look at one line at a time: a line of menu entries, a short line of boilerplate, a
line crowded with symbols, and a long line without any sentence mark fail. Failing lines go,
and a document goes if it loses too many of its words with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.llm.common import SPACE, table

SYMBOLS = "#*$%&|<>"
BOILERPLATE = (
    "all rights reserved|cookie policy|cookies? consent|accept (all )?cookies|privacy policy|"
    "terms of (use|service)|click here|subscribe to|sign up for|enable javascript|lorem ipsum|"
    "share this|read more|"
    "tous droits réservés|politique de confidentialité|accepter les cookies|cliquez ici|"
    "alle rechte vorbehalten|datenschutzerklärung|cookies akzeptieren|hier klicken|"
    "todos los derechos reservados|política de (privacidad|cookies)|aceptar (las )?cookies|haga clic aquí"
)
# Marks that end sentences, in Latin, Greek, Cyrillic, Chinese and Japanese, Indic, Arabic, Urdu,
# Ethiopic, Armenian, Khmer, Burmese and Tibetan texts; Thai and Lao have none.
SENTENCE_MARK = (
    "[.!?\u2026\u3002\uff01\uff1f\u037e\u0964\u0965\u061f\u06d4\u1362\u1367\u1368\u055e\u0589\u17d4\u17d5"
    "\u104a\u104b\u0f0d\u0f0e\u0e00-\u0eff]")
# Separators that make a line a menu, words of a short line, words of a line that needs a mark.
MENU, SHORT, LONG = 3, 20, 30
MAX_LOSS = 0.5
GRAM = 5


def _size(text: Column, of: str) -> Column:
    """How many characters of ``of`` a text has."""
    return F.length(text) - F.length(F.translate(text, of, ""))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{SPACE}+"), "")


def line_fails(line: Column, n_words: Column) -> Column:
    bars = _size(line, "|")
    return (
        ((bars >= MENU) & (bars * 4 >= n_words))
        | (_size(line, SYMBOLS.replace("|", "")) * 2 > n_words)
        | ((n_words <= SHORT) & F.lower(line).rlike(BOILERPLATE))
        | ((n_words >= LONG) & ~line.rlike(SENTENCE_MARK))
    )


def _repeat_words(df: DataFrame) -> DataFrame:
    """Add ``n_repeat_words`` from ``words``: words in windows that the text has twice.

    Windows are compared by 64-bit hashes within one text.
    """
    def gram(i: Column) -> Column:
        return F.xxhash64(*(F.get("words", i + k) for k in range(GRAM)))

    last = F.size("words") - GRAM
    df = df.withColumn(
        "grams", F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), gram))
        .otherwise(F.array().cast("array<long>")))
    repeats = F.size(F.array_distinct("grams")) < F.size("grams")
    df = df.withColumn("sorted", F.when(repeats, F.sort_array(
        F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))

    def twin(x: Column, k: Column) -> Column:
        return (F.get("sorted", k - 1)["h"].eqNullSafe(x["h"])
                | F.get("sorted", k + 1)["h"].eqNullSafe(x["h"]))

    at = F.sort_array(F.transform(F.filter("sorted", twin), lambda x: x["i"]))
    covered = F.aggregate(
        at, F.struct(F.lit(0).alias("n"), F.lit(0).alias("stop")),
        lambda a, p: F.struct((a["n"] + p + GRAM - F.greatest(p, a["stop"])).alias("n"),
                              (p + GRAM).alias("stop")))
    return df.withColumn("n_repeat_words", F.coalesce(covered["n"], F.lit(0)).cast("long"))


def clean_lines(docs: DataFrame, max_loss: float = MAX_LOSS) -> DataFrame:
    """``input`` (the row as it came), measures of its text, ``kept`` and ``clean_text``.

    Row by row: nothing is shuffled, and repeated rows are judged alike. A null or empty text
    has no words, fails the base rules and stays as it is. Lines without words are neither
    judged nor counted; ``clean_text`` keeps them. Input columns stay inside ``input``, so
    none can clash.
    """
    df = docs.select(
        F.struct("*").alias("input"), F.coalesce("text", F.lit("")).alias("text"))
    df = df.withColumn("words", _words(F.col("text"))).withColumn("lines", F.split("text", "\n"))
    df = _repeat_words(df).withColumn("judged", F.transform("lines", lambda x: F.struct(
        x.alias("line"), F.size(_words(x)).alias("n"))))
    worded = F.transform(F.filter("judged", lambda x: x["n"] > 0), lambda x: x["line"])
    df = df.withColumn("worded", worded)
    df = df.withColumn("left", F.filter(
        "judged", lambda x: (x["n"] == 0) | ~line_fails(x["line"], x["n"])))
    n_words = F.size("words")
    df = df.select(
        "input", n_words.cast("long").alias("n_words"),
        (F.length("text") - _size(F.col("text"), " \t\n\x0b\x0c\r"))
        .cast("long").alias("word_chars"),
        _size(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("worded") - F.size(F.array_distinct("worded"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.aggregate("left", F.lit(0), lambda a, x: a + x["n"]).cast("long").alias("n_left"),
        F.array_join(F.transform("left", lambda x: x["line"]), "\n").alias("clean_text"),
    )
    base = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    lost = F.col("n_words") - F.col("n_left")
    # Always true, and never known beforehand: a filter on ``kept`` stays above the measures
    # and does not unfold all of them into one condition at the scan.
    measured = F.monotonically_increasing_id() >= 0
    return df.withColumn("base_failed", base).withColumn(
        "kept", ~base & (lost <= F.col("n_words") * max_loss) & measured)


def cleaned(docs: DataFrame, max_loss: float = MAX_LOSS) -> DataFrame:
    """The kept rows with all their columns; ``text`` and ``n_chars`` are of what is left."""
    found = clean_lines(docs, max_loss).filter("kept")
    new = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    return found.select(*(new[c].alias(c) if c in new else F.col("input").getField(c).alias(c)
                          for c in docs.columns))


def op7_line_first_cleaning(spark: SparkSession, folder: str) -> DataFrame:
    return clean_lines(table(spark, folder, "documents")).select(
        "input.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


OP7_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), g AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS c
  FROM (SELECT r, i, array_to_string(w[i:i + {GRAM - 1}], ' ') AS gram
        FROM (SELECT r, w, unnest(generate_series(1, len(w) - {GRAM - 1})) AS i FROM d))
), p AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words
  FROM g, (SELECT unnest(generate_series(0, {GRAM - 1})) AS k) WHERE c > 1 GROUP BY r
), l AS (
  SELECT r, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
         length(line) - length(replace(line, '|', '')) AS bars,
         length(line) - length(regexp_replace(line, '[#*$%&<>]', '', 'g')) AS symbols
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)
), s AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines,
         sum(CASE WHEN (bars >= {MENU} AND bars * 4 >= n) OR symbols * 2 > n
                    OR (n <= {SHORT} AND regexp_matches(lower(line), '{BOILERPLATE}'))
                    OR (n >= {LONG} AND NOT regexp_matches(line, '{SENTENCE_MARK}'))
                  THEN n ELSE 0 END) AS lost
  FROM l WHERE n > 0 GROUP BY r
), m AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(lost, 0) AS lost,
         len(w) < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * len(w) AS base_failed
  FROM d LEFT JOIN p USING (r) LEFT JOIN s USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND lost <= n_words * {MAX_LOSS} AS kept
FROM m
"""
