"""Quality rules: repetition limits, then divergence from the language; DataFrame functions only.

The character-class and common-word histograms of a document are compared with those of its language, summed over all
its documents, by Jensen-Shannon distance (base 2, 0 to 1). Histograms of short documents say little, so each distance counts
only from a minimum length on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, WHITE, stash

SYMBOLS = "#*$%&|<>"
MARKS = ".,;:!?'\"()[]{}-_/\\@+=~^`"
DIGITS = "0123456789"
#: Common words of each language; every other word is in the last bin. Other languages have that bin alone.
COMMON = {
    "en": ("the", "of", "and", "to", "in", "that", "is", "with"), "de": ("der", "die", "das", "und", "ein", "nicht", "zu", "den"),
    "fr": ("le", "la", "les", "de", "des", "et", "est", "pour"), "es": ("el", "la", "los", "las", "del", "de", "que", "en"),
}
BINS = 9
#: Largest distances of a kept document, and the least characters and words for which they count.
MOST_CHARS, MOST_WORDS, LEAST_CHARS, LEAST_WORDS = 0.3, 0.45, 500, 100
#: Base rule: words, and percent of words in repeated windows.
BASE_WORDS, BASE_REPEAT, WINDOW = 20, 30, 8


def word_array(text: Column) -> Column:
    """Words of a text; the fillings between runs of white space that aren't empty."""
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _let(x: Column, f) -> Column:
    """f(x) with x computed once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _count(text: Column, chars: str) -> Column:
    """Characters of text that are among chars."""
    return F.char_length(text) - F.char_length(F.translate(text, chars, ""))


def char_classes(lower: Column, white: Column, rest: Column) -> Column:
    """Counts of lower case, white space, upper case, digits, symbols, marks and all others; rest is the text without the first two."""
    found = [_count(rest, c) for c in (UPPER, DIGITS, SYMBOLS, MARKS)]
    return F.array(*[c.cast("double") for c in (lower, white, *found, F.char_length(rest) - reduce(lambda a, b: a + b, found))])


def window_hashes(hashes: Column) -> Column:
    """A hash of each window of WINDOW (8) consecutive words from their hashes; none for fewer words.

    Hashes of 2, 4 and 8 words: that of the first half, rotated, xor that of the second.
    """

    def double(x: Column, width: int, turn: int) -> Column:
        n = F.size(x) - width
        rotated = lambda a: F.shiftleft(a, turn).bitwiseOR(F.shiftrightunsigned(a, 64 - turn))
        return F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, F.lit(width + 1), n), lambda a, b: rotated(a).bitwiseXOR(b))

    chain = _let(hashes, lambda x: _let(double(x, 1, 13), lambda y: _let(double(y, 2, 26), lambda z: double(z, 4, 37))))
    return F.when(F.size(hashes) >= WINDOW, chain).otherwise(F.array().cast("array<bigint>"))


def repeated_words(grams: Column) -> Column:
    """Words inside windows that occur twice or more in the document, the first included.

    Only documents with equal window hashes go on to sorting the windows with their places. Equal hashes stand for equal
    windows: within one document of a million words two differing windows share one with a chance of about 1e-8.
    """

    def places(s: Column) -> Column:
        same = lambda x, j: (j >= 0) & (j < F.size(s)) & F.coalesce(F.get(s, j)["g"] == x["g"], F.lit(False))
        return F.array_sort(F.transform(F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))

    def add(a: Column, i: Column) -> Column:  # a window adds its words after the last window's end
        return F.struct((a["sum"] + F.least(F.lit(WINDOW), i - a["last"])).alias("sum"), i.alias("last"))

    covered = lambda p: F.aggregate(p, F.struct(F.lit(0).alias("sum"), F.lit(-WINDOW).alias("last")), add)["sum"]
    ordered = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    repeats = _let(ordered, lambda s: covered(places(s)))
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), 0).otherwise(repeats).cast("long")


def divergence(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of two histograms of counts; 0 where one of them is empty."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    n, m = total(counts), total(reference)
    part = lambda p, q: F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0)
    terms = F.zip_with(counts, reference, lambda a, b: part(a / n, b / m) + part(b / m, a / n))
    return F.when((n > 0) & (m > 0), F.sqrt(F.greatest(F.lit(0.0), total(terms) / 2))).otherwise(0.0)


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Counts and histograms of every row."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("*", F.transform(word_array(F.col("text")), lambda w: F.xxhash64(w)).alias("words"), F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    lists = {lang: [F.xxhash64(F.lit(w)) for w in words] for lang, words in COMMON.items()}
    own = F.create_map(*[x for lang, words in lists.items() for x in (F.lit(lang), F.array(*words))])
    every = [F.xxhash64(F.lit(w)) for w in sorted({w for words in COMMON.values() for w in words})]
    rows = rows.select(
        "*", window_hashes(F.col("words")).alias("grams"), F.filter("words", lambda h: h.isin(every)).alias("found"), F.try_element_at(own, F.coalesce("lang", F.lit(""))).alias("own"),
        F.regexp_replace("text", "[a-z]+", "").alias("short"),
    )
    rows = rows.withColumn("rest", F.translate("short", WHITE, ""))
    counts = F.array(*[F.coalesce(F.size("found") - F.size(F.array_remove("found", F.get("own", F.lit(k)))), F.lit(0)).cast("double") for k in range(BINS - 1)])
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    lower, white = F.char_length("text") - F.char_length("short"), F.char_length("short") - F.char_length("rest")
    rows = rows.select(
        "id", "lang", F.size("words").cast("long").alias("n_words"), (F.char_length("text") - white).cast("long").alias("word_chars"), _count(F.col("rest"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), repeated_words(F.col("grams")).alias("n_repeat_words"),
        F.char_length("text").alias("n_chars"), char_classes(lower, white, F.col("rest")).alias("chars"), counts.alias("common"),
    )
    return rows.withColumn("common", F.concat("common", F.array(F.col("n_words") - total(F.col("common")))))


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, chars_jsd, words_jsd.

    kept is false where the base rule fails, and where a document with enough characters (words) is further from its language
    than MOST_CHARS (MOST_WORDS). A null language is a language of its own. Null texts count as empty, have no words and
    fail. Repeated rows give repeated results and count as often in the references; other columns are ignored; an empty table
    gives an empty result. References hold one row a language.
    """
    rows = stash(measure(df, id_col, text_col, lang_col))
    sums = lambda c, n: F.array(*[F.sum(F.get(c, F.lit(i))) for i in range(n)])
    refs = rows.groupBy("lang").agg(sums("chars", 7).alias("ref_chars"), sums("common", BINS).alias("ref_common")).withColumnRenamed("lang", "ref_lang")
    rows = rows.join(refs, F.col("lang").eqNullSafe(F.col("ref_lang")))
    rows = rows.withColumn("chars_jsd", divergence(F.col("chars"), F.col("ref_chars"))).withColumn("words_jsd", divergence(F.col("common"), F.col("ref_common")))
    failed = (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEAT * F.col("n_words"))
    far = (F.col("n_chars") >= LEAST_CHARS) & (F.col("chars_jsd") > MOST_CHARS) | (F.col("n_words") >= LEAST_WORDS) & (F.col("words_jsd") > MOST_WORDS)
    return rows.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~far).alias("kept"), "chars_jsd", "words_jsd")
