"""Line-first cleaning, in DataFrame functions only.

Every line is tried by rules; failing lines are removed; a document is rejected when the text that is left is too small a
share of it.  The rules of a line, which has a word:

- boilerplate: it has ``short_line`` words at most and holds one of PHRASES (in any case; four languages);
- navigation: three or more of its separators ``| » › · •`` have a letter or digit between them and the one before, and it has at
  most ``per_link`` words for each part; or it is a list of links: two or more, and at least half of its words;
- punctuation: it has ``long_line`` words or more and no word of it ends in a sentence mark, or a share of ``symbols`` or more of its
  words ends in or is made of symbols, or it is ``shouting`` (letters, none of them small, and two words or more).

Lines of fewer than ``long_line`` words without a sentence mark (titles) stay.  Documents fail first by the *base* rules: fewer
than ``least_words`` words, or more than ``most_repeated`` per cent of the words in five-word windows that occur twice or
more in the text.

Each document is worked on alone, so nothing is shuffled or grouped.  Nulls: a null text has no words and fails.  Equal
five-word windows are told by 64 bits.  Empty table: no rows.  Repeated rows are judged each.  Very long texts are worked on whole,
their windows are sorted in the row.  Other columns stay; one that has the name of a result column gives way to it.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.shared import free

SPACES = " \t\n\x0b\x0c\r"
_SPLIT = "[\\x20\\x09-\\x0D]+"
# Phrases of pages' frames in English, French, German and Spanish.
PHRASES = [
    "all rights reserved",
    "accept cookies",
    "cookie policy",
    "privacy policy",
    "terms of use",
    "terms of service",
    "click here",
    "read more",
    "sign up for",
    "subscribe to our",
    "enable javascript",
    "javascript is disabled",
    "skip to content",
    "share this",
    "back to top",
    "lorem ipsum",
    "tous droits réservés",
    "accepter les cookies",
    "politique de confidentialité",
    "conditions d'utilisation",
    "mentions légales",
    "cliquez ici",
    "lire la suite",
    "retour en haut",
    "alle rechte vorbehalten",
    "cookies akzeptieren",
    "datenschutzerklärung",
    "nutzungsbedingungen",
    "hier klicken",
    "weiterlesen",
    "nach oben",
    "todos los derechos reservados",
    "aceptar cookies",
    "política de privacidad",
    "condiciones de uso",
    "aviso legal",
    "haga clic aquí",
    "leer más",
    "volver arriba",
]
_SEPARATORS = "|»›·•"
NAVIGATION = f"^(?:[^{_SEPARATORS}\\p{{L}}\\p{{N}}]*[\\p{{L}}\\p{{N}}][^{_SEPARATORS}]*[{_SEPARATORS}]){{3}}"
_LINK = "(?:^|[\\x20\\x09-\\x0D])(?:https?://|www\\.)[^\\x20\\x09-\\x0D]"
_END = "[.!?…。][)\"'”’»*]*(?:$|[\\x20\\x09-\\x0D])"
_SYMBOLS = "(?:[#*$%&<>=~^]{2,}|!!+)(?=$|[\\x20\\x09-\\x0D])"


def words_of(text: Column) -> Column:
    """The words of a text as an array."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _SPLIT))


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, k: int = 5) -> Column:
    """Words in windows of k words that occur twice or more, each word once."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        at = lambda p, i: F.get(p, i)["h"]  # noqa: E731  null outside
        places = _let(pairs, lambda p: F.array_sort(F.transform(F.filter(p, lambda x, i: F.coalesce((at(p, i - 1) == x["h"]) | (at(p, i + 1) == x["h"]), at(p, i - 1) == x["h"], at(p, i + 1) == x["h"], F.lit(False))), lambda x: x["i"])))
        return _let(places, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(k), F.coalesce(F.get(p, i + 1) - x, F.lit(k)))), F.lit(0), lambda a, x: a + x))

    some = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))
    return F.when(F.size(words) <= k, F.lit(0)).otherwise(_let(hashes, some)).cast("long")


def line_fails(line: Column, long_line: int = 8, symbols: float = 0.3, short_line: int = 20, per_link: int = 6) -> Column:
    """Whether a line with a word is to be removed."""
    n = F.size(F.split(F.btrim(line, F.lit(SPACES)), _SPLIT))
    boiler = (n <= short_line) & _let(F.lower(line), lambda low: functools.reduce(Column.__or__, [low.contains(x) for x in PHRASES]))
    navigation = line.rlike(f"[{_SEPARATORS}]") & line.rlike(NAVIGATION) & (n <= per_link * (F.regexp_count(line, F.lit(f"[{_SEPARATORS}]")) + 1))
    links = F.when(line.rlike("https?://|www\\."), F.regexp_count(line, F.lit(_LINK))).otherwise(0)
    signs = F.regexp_count(line, F.lit(_SYMBOLS)) >= symbols * n
    shouting = line.rlike("\\p{Lu}") & ~line.rlike("\\p{Ll}") & (n >= 2)
    return boiler | navigation | ((links >= 2) & (2 * links >= n)) | ((n >= long_line) & ~line.rlike(_END)) | signs | shouting


_RESULT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lines_removed", "clean_words", "clean_text", "kept"]


def judge(docs: DataFrame, least_words: int = 10, most_repeated: int = 20, least_kept: float = 0.7) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lines_removed, clean_words,
    clean_text and kept.  ``clean_text`` is the text without the failing lines."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words, rows, clean = (free(docs, c) for c in ("words", "lines", "clean"))
    out = docs.withColumn(words, words_of(text))
    has_word = lambda x: x.rlike("[^\\x20\\x09-\\x0D]")
    lines = F.split(text, "\n")
    out = out.withColumn(rows, F.filter(lines, has_word))
    out = out.withColumn(clean, F.filter(lines, lambda x: ~has_word(x) | ~line_fails(x)))
    cleaned = F.array_join(clean, "\n")
    out = out.select(
        *[c for c in docs.columns if c.lower() not in _RESULT],
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size(rows) - F.size(F.array_distinct(rows))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col(words)).alias("n_repeat_words"),
        (F.size(rows) - F.size(F.filter(clean, has_word))).cast("long").alias("lines_removed"),
        F.size(words_of(cleaned)).cast("long").alias("clean_words"),
        cleaned.alias("clean_text"),
    )
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    return out.withColumn("kept", ~failed & (F.col("clean_words") >= least_kept * F.col("n_words")))


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that are kept, with all their columns and their cleaned text."""
    clash = {c: f"_own_{i}" for i, c in enumerate(docs.columns) if c != "text"}
    out = judge(docs.withColumnsRenamed(clash), **options)
    row = F.struct(*[F.col("clean_text").alias("text") if c == "text" else F.col(clash[c]).alias(c) for c in docs.columns])
    # a plain filter would be pushed below the projections and repeat their work many times
    one = F.filter(F.array(F.struct(F.col("kept").alias("kept"), row.alias("row"))), lambda x: x["kept"])
    return out.select(F.explode(one).alias("x")).select("x.row.*")
