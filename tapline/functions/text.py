"""Entropy and lexical features of names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def chars(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)(.)"), F.lit(1))


def entropy(text: Column) -> Column:
    """Shannon entropy in bits of the characters of a short text; empty text gives 0.

    The characters are sorted once, so equal ones form runs and the fold is linear in the length. The fold also
    counts them: an expression that named the sorted array twice would be computed twice.
    """
    ordered = F.sort_array(chars(text))
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("n"), F.lit(0.0).cast("double").alias("acc"))
    term = lambda k: F.when(k > 1, k * F.log2(k.cast("double"))).otherwise(F.lit(0.0))
    # sum of k*log2(k) over character counts k; entropy = log2(n) - sum / n
    step = lambda a, c: F.struct(
        c.alias("last"), F.when(a["last"] == c, a["run"] + 1).otherwise(F.lit(1)).alias("run"), (a["n"] + 1).alias("n"),
        F.when(a["last"] == c, a["acc"]).otherwise(a["acc"] + term(a["run"])).alias("acc"),
    )
    total = lambda a: F.log2(a["n"].cast("double")) - (a["acc"] + term(a["run"])) / a["n"]
    return F.coalesce(F.aggregate(ordered, start, step, lambda a: F.when(a["n"] > 0, total(a))), F.lit(0.0))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)", 1))


def domain_parts(domain: Column) -> dict[str, Column]:
    """Second-level label and top-level label of a host name."""
    labels = F.split(domain, r"\.")
    n = F.size(labels)
    return {
        "sld": F.when(n >= 2, F.element_at(labels, -2)).otherwise(F.element_at(labels, 1)),
        "tld": F.when(n >= 2, F.element_at(labels, -1)).otherwise(F.lit("")),
    }


def lexical_features(domain: Column) -> dict[str, Column]:
    """Lengths and character shares of a domain, over all its characters."""
    parts = domain_parts(domain)
    n = F.greatest(F.length(domain), F.lit(1))
    count = lambda pattern: F.regexp_count(domain, F.lit(pattern))
    vowels, consonants = count("[aeiou]"), count("[b-df-hj-np-tv-z]")
    return {
        "full_domain_length": F.length(domain),
        "sld_length": F.length(parts["sld"]),
        "tld_length": F.length(parts["tld"]),
        "entropy": entropy(domain),
        "digit_ratio": count("[0-9]") / n,
        "vowel_ratio": vowels / n,
        "consonant_ratio": consonants / n,
        "vowel_consonant_ratio": vowels / F.greatest(consonants, F.lit(1)),
        "unique_character_ratio": F.size(F.array_distinct(chars(domain))) / n,
    }


def char_ngrams(text: Column, n: int) -> Column:
    """Overlapping character n-grams; shorter text gives none."""
    last = F.length(text) - n
    return F.when(
        last >= 0,
        F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.substring(text, i, F.lit(n))),
    ).otherwise(F.array().cast("array<string>"))
