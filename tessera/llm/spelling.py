"""Spelling variants: words one code point apart, found without pairs, with DataFrame operations only.

A word stands under each text that is left when one of its code points goes, with the place of that code point: words of one length with the
same place and rest differ by a replacement there. Such a group needs its size and its two most frequent words alone, as the best other word
is the first or, for the first itself, the second. A rest that is a word of the vocabulary is one deletion away, so words also stand under
themselves, and deletions meet them there. All this lies under the same rest: one shuffle and one sort serve both, and what each row learns
is added up by word. Rows are the vocabulary times the length of its words; no group is larger than the alphabet times a word's length.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut_table, drop_tables, table

LETTERS = "[A-Za-zÀ-ÿ]"
LEAST, TIMES = 7, 10


def runs(text: Column, least: int = 1) -> Column:
    """The maximal runs of letters of at least so many code points, A-Z in lower case; null: none."""
    found = F.regexp_extract_all(text, F.lit(f"{LETTERS}{{{least},}}+"), F.lit(0))
    return F.transform(found, lambda r: F.translate(r, string.ascii_uppercase, string.ascii_lowercase))


def without(word: Column, place: Column) -> Column:
    """A word without the code point at a place, from 1."""
    place = place.cast("int")
    return F.concat(F.substring(word, F.lit(1), place - 1), F.substring(word, place + 1, F.length(word)))


def vocabulary(occurrences: DataFrame, least: int = LEAST, times: int = 2) -> DataFrame:
    """(word, n): words of at least so many code points that occur so often, from rows (word) for each occurrence. Nulls don't count."""
    return occurrences.where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= times)


def near(words: DataFrame) -> DataFrame:
    """(word, n, n_near, best) of words (word, n): how many others are one insertion, deletion or replacement of a code point away, and the
    most frequent of them as (minus its n, word), ties to the smallest."""
    places = F.transform(F.sequence(F.lit(0), F.length("word")), lambda i: F.struct(i.alias("i"), F.when(i == 0, F.col("word")).otherwise(without(F.col("word"), i)).alias("rest")))
    rows = words.select("word", "n", F.inline(places))
    me, i = F.struct((-F.col("n")).alias("less"), F.col("word").alias("word")), F.col("i")
    # Of equal letters side by side any one may go, with the same rest: that counts once, by the last of them.
    once = (i > 0) & (F.substring("word", i, F.lit(1)) != F.substring("word", i + 1, F.lit(1)))
    same = Window.partitionBy("rest", "i").orderBy(F.col("n").desc(), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = Window.partitionBy("rest")
    rows = rows.withColumns({"me": me, "once": once})
    rows = rows.withColumns({"size": F.count("*").over(same), "first": F.first_value("me").over(same), "second": F.nth_value("me", 2).over(same)})
    rows = rows.withColumns({"there": F.max(F.when(i == 0, F.col("me"))).over(left), "longer": F.count_if("once").over(left), "best_longer": F.min(F.when(F.col("once"), F.col("me"))).over(left)})
    own = i == 0
    other = F.when(~own, F.when(F.col("first.word") == F.col("word"), F.col("second")).otherwise(F.col("first")))
    shorter = F.when(F.col("once"), F.col("there"))
    count = F.when(own, F.col("longer")).otherwise(F.col("size") - 1 + F.when(shorter.isNotNull(), 1).otherwise(0))
    best = F.when(own, F.col("best_longer")).otherwise(F.least(other, shorter))
    learned = rows.select("word", "n", count.alias("c"), best.alias("best")).where(own | (F.col("c") > 0))
    return learned.groupBy("word", "n").agg(F.sum("c").alias("n_near"), F.min("best").alias("best"))


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct words (word, n).

    form: the near word of largest n, ties to the smallest in code-point order, if that n is at least ``times`` the word's; else null. root:
    where forms lead to from the word. As n grows by ``times`` with each form, they lead on by the logarithm of the largest n at most, and
    pointers are doubled until they surely have arrived. Words of any length and alphabet are handled; null words and words with a null n or
    one below 1 are left out. The empty table gives no rows; other columns are ignored.
    """
    if times < 2:
        raise ValueError("a form must be at least twice as frequent")
    spark, scratch = words.sparkSession, []
    words = words.select(words["word"].alias("word"), words["n"].cast("long").alias("n")).where("word is not null and n >= 1")
    chosen = (F.col("best").isNotNull()) & (-F.col("best.less") >= F.col("n") * times)
    found = near(words).select("word", F.when(chosen, F.col("best.word")).alias("form"), "n", "n_near", F.when(chosen, -F.col("best.less")).alias("form_n"))
    found = cut_table(found)
    links = found.where("form is not null").select("word", F.col("form").alias("root"))
    span = found.agg(F.max("form_n"), F.min("n")).first()
    steps = math.floor(math.log(span[0] / span[1], times) + 1e-9) if span[0] else 0
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        on = links.select(F.col("word").alias("at"), F.col("root").alias("next"))
        older, scratch = scratch, []
        links = cut_table(links.join(on, links["root"] == on["at"], "left").select("word", F.coalesce("next", "root").alias("root")), scratch)
        drop_tables(spark, older)
    return found.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def slipped(run: Column, id: Column) -> Column:
    """A run as this corpus spells it: where 31 divides crc32 of `id:run`, without the code point at that number modulo its length. A null id
    counts as empty."""
    h = F.crc32(F.concat(F.coalesce(id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    return F.when(h % 31 == 0, without(run, h % F.length(run) + 1)).otherwise(run)


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """variants() of the words of documents, whole texts, after slipped(). Null and empty texts have no words; runs below the least length
    can't become words and aren't read; repeated rows count again."""
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", F.explode(runs(F.col("text"), LEAST)).alias("run"))
    words = cut_table(vocabulary(found.select(slipped(F.col("run"), F.col("doc_id")).alias("word"))))
    return variants(words)
