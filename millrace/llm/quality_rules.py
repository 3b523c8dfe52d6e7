"""Line-first quality rules, with DataFrame functions only.

Every line of a text that has a word is held against three groups of rules:

* punctuation: half or more of its words, and five at least, carry a mark of
  ``[#*$%&|<>]``, or stand between such marks alone;
* navigation: it is a list of three or more short items between ``|``, ``»``,
  ``>`` or ``·``, or nothing but a menu phrase ("home", "sign in", ...);
* boilerplate: it is no more than one of the usual notices (rights reserved,
  terms of use, cookies, scripts), or repeats an earlier line of the text.

Failing lines are taken out, and blank lines with them; a text without failing
lines stays as it is. A document is rejected if what is left holds less
than ``KEEP`` of its words, or if one of the base rules on the whole text fails
(fewer than 50 words; more than half of its words in repeated windows of three
words).

Repeated windows are found without leaving the row and without an exchange. If
all windows' hashes differ there are none. Else the hashes are packed with their
places into longs and sorted as primitives; places whose hash has a neighbour
are then compared by their words, so equal hashes of different words do no harm.
Where a text has more windows than places fit a long (2^24), structs of hash and
place are sorted instead.

Defined results: a null text has no words and fails the base rules; texts of any
length are whole; repeated rows are each judged alone; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import word_array

SYMBOLS = "#*$%&|<>"
#: Least share of a document's words that must be in lines that pass.
KEEP = 0.5
LEAST_WORDS = 50
#: A menu phrase or a notice is a line of so many characters at most.
NOTICE_CHARS = 160
MENU = r"(?i)^\W*(home|menu|search|login|log in|sign in|sign up|register|subscribe|next|previous|back to top|read more|share|contact us|about us|skip to content)\W*$"
NOTICE = r"(?i)^\W*((©|\(c\)|copyright)\b.{0,80}|.{0,60}all rights reserved.{0,20}|(terms of (use|service)|privacy policy|cookie policy)\W*|(this|our) (site|website) uses cookies.{0,80}|please enable javascript.{0,80})\W*$"
#: Greatest place that is packed with a hash: a run of low bits.
_PLACE = (1 << 24) - 1


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more."""
    n = F.size(words)

    def twins(keys: Column, near) -> Column:
        return _let(F.sort_array(keys), lambda p: F.filter(p, lambda x, k: near(F.get(p, k - 1), x) | near(F.get(p, k + 1), x)))

    def places(hashes: Column) -> Column:
        bits = _PLACE.bit_length()
        packed = F.transform(hashes, lambda h, i: h.bitwiseAND(F.lit(~_PLACE)).bitwiseOR(i.cast("long")))
        near = lambda a, b: F.coalesce(F.shiftright(a, bits) == F.shiftright(b, bits), F.lit(False))
        few = F.transform(twins(packed, near), lambda x: x.bitwiseAND(F.lit(_PLACE)).cast("int"))
        wide = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        many = F.transform(twins(wide, lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))), lambda x: x["i"])
        return F.when(F.size(hashes) <= _PLACE + 1, few).otherwise(many)

    def exact(w: Column, hashes: Column) -> Column:
        shingle = lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        keyed = F.sort_array(F.transform(places(hashes), lambda i: F.struct(shingle(i).alias("s"), i.alias("i"))))
        same = lambda a, b: F.coalesce(a["s"] == b["s"], F.lit(False))
        found = _let(keyed, lambda p: F.filter(p, lambda x, k: same(F.get(p, k - 1), x) | same(F.get(p, k + 1), x)))
        at = F.sort_array(F.transform(found, lambda x: x["i"]))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
        step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last"))
        return F.aggregate(at, start, step, lambda acc: acc["n"])

    def counted(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        none = lambda h: F.size(F.array_distinct(h)) == F.size(h)
        return _let(hashes, lambda h: F.when(none(h), F.lit(0).cast("long")).otherwise(exact(w, h)))

    return F.when(n < 4, F.lit(0).cast("long")).otherwise(_let(words, counted))


def _marked(word: Column) -> Column:
    return word.rlike(f"[{SYMBOLS}]")


def line_fails(line: Column) -> Column:
    """A line with a word fails a punctuation, navigation or boilerplate rule (repeats aside)."""
    words = word_array(line)
    marks = _let(words, lambda w: (F.size(w) >= 5) & (2 * F.size(F.filter(w, _marked)) >= F.size(w)))
    items = F.size(F.split(line, r"\s[|»>·]\s?"))
    listed = (items >= 3) & (F.size(words) < 8 * items)
    short = F.length(line) <= NOTICE_CHARS
    return F.when(line.rlike(f"[{SYMBOLS}»·]"), marks | listed).otherwise(False) | F.when(short, line.rlike(MENU) | line.rlike(NOTICE)).otherwise(False)


def judged(docs: DataFrame, text: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and ``also``, the base figures, ``clean`` (text of the lines that pass) and ``kept``."""
    source = docs.select(F.col("doc_id"), *also, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    has_word = lambda x: x.rlike(r"[^\x20\x09-\x0D]")
    df = source.select("*", word_array(F.col("_t")).alias("_w"), F.split(F.col("_t"), "\n").alias("_all"))
    df = df.select("*", F.filter("_all", has_word).alias("_lines"))
    df = df.select(
        "doc_id",
        *also,
        "_t",
        "_lines",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("_w")).alias("n_repeat_words"),
    )
    df = df.withColumn("_good", F.filter(F.array_distinct("_lines"), lambda x: ~line_fails(x)))
    left = F.aggregate("_good", F.lit(0).cast("long"), lambda n, x: n + F.size(word_array(x)))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.select(
        "doc_id",
        *also,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        F.when(F.size("_good") == F.size("_lines"), F.col("_t")).otherwise(F.array_join("_good", "\n")).alias("clean"),
        F.when(failed, False).otherwise(left >= KEEP * F.col("n_words")).alias("kept"),
    )


def rules(docs: DataFrame) -> DataFrame:
    """The figures and the verdict of each document."""
    return judged(docs).drop("clean")
