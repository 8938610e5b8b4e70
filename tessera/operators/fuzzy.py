"""Fuzzy names: the Indel ratio, and that of the best window of the longer string."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.lineage import cut

#: Stands for any letter that no word has; rows of near pairs up to which they are broadcast.
OTHER, FEW = "\u0000", 2_000_000


def ratio(a: str, b: str) -> float:
    """100 * 2 * longest common subsequence / (both lengths), by bits; two empty strings: 100."""
    if not a and not b:
        return 100.0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full, s = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        u = s & at.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return 200.0 * (len(a) - s.bit_count()) / (len(a) + len(b))


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a window of the longer one of its length, or shorter at either end."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    if not a:
        return 100.0 if not b else 0.0
    n = len(a)
    return max(ratio(a, b[max(0, i) : i + n]) for i in range(1 - n, len(b)))


def partial_ratios(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([partial_ratio(p or "", q or "") for p, q in zip(x, y)])

    return score(a, b)


def best_ratios(words: Column, name: Column) -> Column:
    """The best partial ratio of any of the words with the name; no words: 0."""

    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([max((partial_ratio(w, q or "") for w in (p if p is not None else ())), default=0.0) for p, q in zip(x, y)])

    return score(words, name)


def may_reach(word: str, name: str, least: float) -> Column:
    """False only where the columns' partial ratio is below least: common letters c bound it by 200 c / (shorter length + c)."""
    c = F.length(word) - F.length(F.expr(f"translate({word}, {name}, '')"))
    return F.lit(200.0) * c >= F.lit(least) * (F.least(F.length(word), F.length(name)) + c)


def least_shared(n: int, least: float) -> int:
    """How many letter pairs a string of n characters shares with any string of no fewer for a partial ratio of least or more.

    Such a ratio has c letters in common order with a window of k <= n characters, c >= least (n + k) / 200. Of the c - 1 neighbours among
    them those are at most (n - c) / 2 that stand more than two places apart in the one, and (k - c) / 2 in the other: the rest are pairs
    of letters one or two places apart in both, each another place of both."""
    found = []
    for c in range(1, n + 1):
        k = min(n, math.floor(200 * c / least - n + 1e-9))
        if k >= c:
            found.append(c - 1 - (n - c) // 2 - (k - c) // 2)
    return max(0, min(found, default=n))


def letter_pairs(text: Column) -> Column:
    """The pairs of letters one or two places apart, each with a number that tells equal ones apart; of one letter, that letter."""
    at = lambda i: F.substring(text, i.cast("int"), F.lit(1))
    n = F.length(text)
    apart = lambda d: F.when(n > d, F.transform(F.sequence(F.lit(1), n - d), lambda i: F.concat(at(i), at(i + d)))).otherwise(F.array().cast("array<string>"))
    pairs = F.array_sort(F.concat(apart(1), apart(2)))
    return F.transform(pairs, lambda x, i: F.concat(x, (i + 1 - F.array_position(pairs, x)).cast("string")))


def shaped(words: DataFrame, names: DataFrame) -> DataFrame:
    """(name, shape) of distinct names: with OTHER for each letter that none of the words (word) has, as no ratio with a word tells such letters
    apart. Where a word holds OTHER itself, names are their own shapes."""
    split = lambda t: F.filter(F.split(t, ""), lambda c: c != "")
    letters = words.select(F.explode(split("word")).alias("c")).agg(F.collect_set("c").alias("letters"))  # one row, of distinct letters
    shape = F.array_join(F.transform(split("name"), lambda c: F.when(F.array_contains("letters", c), c).otherwise(OTHER)), "")
    names = names.select("name").where("name is not null").distinct().crossJoin(F.broadcast(letters))
    return names.select("name", F.when(F.array_contains("letters", OTHER), F.col("name")).otherwise(shape).alias("shape"))


def near_names(words: DataFrame, names: DataFrame, least: float) -> DataFrame:
    """(word, name, score) of all pairs of distinct words (word) and names (name) whose partial ratio is least or more, 50 at the lowest.

    The shorter of two strings shares least_shared() letter pairs with the longer, so at least one of its rarest, all but so many less one:
    by these they meet, each pair of strings once. What then shares enough of them is verified. A letter by itself meets what holds it; an
    empty string is near an empty one alone. Nulls are left out. Names that differ only in letters that no word has go as one shape; words, names
    and shapes are written first, so that either side is read once."""
    if least < 50:
        raise ValueError("a least ratio of 50 or more")
    words = cut(words.select("word").where("word is not null").distinct())
    names = cut(shaped(words, names))
    parts = []
    for strings in (words.select(F.col("word").alias("t")), cut(names.select(F.col("shape").alias("t")).distinct())):
        parts.append(cut(strings.select("t", F.length("t").alias("n"), letter_pairs(F.col("t")).alias("keys"))))
    bounds = [least_shared(n, least) for n in range(1, 64)]

    def prefixes(short: DataFrame, other: DataFrame) -> DataFrame:
        """short with its rarest keys, by how many of the other side have them."""
        counts = other.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("held"))
        each = short.select("t", "n", F.explode("keys").alias("key")).join(counts, "key", "left")
        keys = F.array_sort(F.collect_list(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "key")))  # a string's own pairs
        rows = each.groupBy("t", "n").agg(keys.alias("k"))
        # Beyond the table the bound is not below that of its end, as it grows with the length.
        need = F.element_at(F.array(*[F.lit(b) for b in bounds]), F.least(F.col("n"), F.lit(len(bounds)))) if len(bounds) else F.lit(1)
        need = F.when(F.col("n") < len(bounds), need).otherwise(F.lit(min(bounds[-8:])))
        rows = rows.withColumn("need", F.greatest(need, F.lit(1)))
        return rows.select("t", "n", "need", F.explode(F.slice("k", F.lit(1), F.greatest(F.size("k") - F.col("need") + 1, F.lit(0)))["key"]).alias("key"))

    def met(short: DataFrame, long: DataFrame, longer) -> DataFrame:
        long_keys = long.select(F.col("t").alias("o"), F.col("n").alias("o_n"), F.explode("keys").alias("key"))
        pairs = prefixes(short.where("n > 1"), long).join(long_keys, "key").where(longer(F.col("o_n"), F.col("n"))).select("t", "o", "need").distinct()
        both = pairs.join(short.select("t", F.col("keys").alias("a")), "t").join(long.select(F.col("t").alias("o"), F.col("keys").alias("b")), "o")
        return both.where(F.size(F.array_intersect("a", "b")) >= F.col("need")).select("t", "o")

    def single(short: DataFrame, long: DataFrame, longer) -> DataFrame:
        letters = long.select(F.col("t").alias("o"), F.col("n").alias("o_n"), F.explode(F.array_distinct(F.split("t", ""))).alias("t"))
        return short.where("n = 1").join(letters, "t").where(longer(F.col("o_n"), F.col("n"))).select("t", "o")

    (w, n), at_least, more = parts, lambda a, b: a >= b, lambda a, b: a > b
    found = met(w, n, at_least).unionByName(single(w, n, at_least)).select(F.col("t").alias("word"), F.col("o").alias("name"))
    found = found.unionByName(met(n, w, more).unionByName(single(n, w, more)).select(F.col("o").alias("word"), F.col("t").alias("name")))
    found = found.unionByName(w.where("n = 0").join(n.where("n = 0").select(F.col("t").alias("name")), F.col("t") == F.col("name")).select(F.col("t").alias("word"), "name"))
    found = found.withColumnRenamed("name", "shape")
    found = cut(found.withColumn("score", partial_ratios(F.col("word"), F.col("shape"))).where(F.col("score") >= least))
    return names.join(F.broadcast(found) if found.count() <= FEW else found, "shape").select("word", "name", "score")


def ratios(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([ratio(p or "", q or "") for p, q in zip(x, y)])

    return score(a, b)


def plain_name(name: Column) -> Column:
    """A file's name for comparison: lower case, without its suffix, marks as spaces, runs of spaces as one."""
    bare = F.regexp_replace(F.lower(name), r"\.[a-z0-9]{1,5}$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"[_\-()\[\].]", " "), r"\s+", " "))
