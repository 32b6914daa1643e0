"""The similarity join: words at one edit from a term, by deletion signatures and a verified distance.

Both sides give the word itself and the word with each one character left out; words within one edit share a
signature, so the join is an equi-join on signatures. Built-in functions alone do the work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .terms import CUE_POLICIES, NATURAL_ROLES

LEAST_TERM, LEAST_WORD = 6, 5


def deletion_signatures(c: Column) -> Column:
    """A word and all its forms with one character left out, each once."""
    cut = F.transform(
        F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c)))
    )
    return F.array_distinct(F.concat(F.array(c), F.when(F.length(c) > 0, cut).otherwise(F.array().cast("array<string>"))))


def eligible_keys(terms: DataFrame) -> DataFrame:
    """Terms that may be met with one edit: a natural role, no limiting policy, one word of letters."""
    policy = F.coalesce(F.col("attributes")["match_policy"], F.lit(""))
    return terms.filter(
        F.col("fuzzy_allowed") & F.col("term_role").isin(NATURAL_ROLES) & ~policy.isin([*CUE_POLICIES, "context_required"])
        & F.col("key").rlike(rf"^\p{{L}}{{{LEAST_TERM},}}$")
    )


def one_edit_pairs(words: DataFrame, keys: DataFrame, word: str = "word", key: str = "key") -> DataFrame:
    """Distinct (word, key) at edit distance exactly one. Both sides are made distinct before they meet."""
    w = words.select(word).filter(F.length(word) >= LEAST_WORD).distinct()
    k = keys.select(key).filter(F.length(key) >= LEAST_TERM).distinct()
    left = w.withColumn("signature", F.explode(deletion_signatures(F.col(word))))
    right = k.withColumn("signature", F.explode(deletion_signatures(F.col(key))))
    near = F.abs(F.length(word) - F.length(key)) <= 1
    pairs = left.join(right, "signature").filter(near).select(word, key).distinct()
    return pairs.filter(F.levenshtein(F.col(word), F.col(key), 1) == 1)


def fuzzy_hits(terms: DataFrame, words: DataFrame) -> DataFrame:
    """Hits of terms (with ``key``) on words (any columns, with ``word``): method fuzzy, edit_distance 1."""
    keys = eligible_keys(terms)
    pairs = one_edit_pairs(words, keys)
    return words.join(pairs, "word").join(keys, "key").withColumn("method", F.lit("fuzzy")).withColumn("edit_distance", F.lit(1))
