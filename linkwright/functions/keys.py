"""The fourteen feature views of a record: sets of keys from name tokens `nt` and address tokens `at`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import phonetic_key, words


def _ngrams(text: Column, n: int = 3) -> Column:
    padded = F.concat(F.lit("^"), text, F.lit("$"))
    grams = F.transform(F.sequence(F.lit(1), F.length(padded) - n + 1), lambda i: F.substring(padded, i, F.lit(n)))
    return F.when(text == "", F.array().cast("array<string>")).when(F.length(padded) <= n, F.array(padded)).otherwise(grams)


def _pairs(ordered: Column) -> Column:
    return F.flatten(F.transform(ordered, lambda a, i: F.transform(F.slice(ordered, i + 2, F.size(ordered)), lambda b: F.concat(a, F.lit("|"), b))))


def _bigrams(tokens: Column, kept=None) -> Column:
    two = F.transform(F.sequence(F.lit(1), F.size(tokens) - 1), lambda i: F.struct(F.element_at(tokens, i).alias("a"), F.element_at(tokens, i + 1).alias("b")))
    if kept:
        two = F.filter(two, kept)
    return F.when(F.size(tokens) > 1, F.transform(two, lambda p: F.concat(p.a, F.lit("_"), p.b))).otherwise(F.array().cast("array<string>"))


def _deletions(x: Column) -> Column:
    one = F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
    return F.concat(F.array(x), one)


def _affixes(nt: Column) -> Column:
    alpha = F.filter(nt, lambda x: x.rlike("^[a-z]{4,}$"))
    head = F.transform(alpha, lambda x: F.concat(F.lit("p:"), F.substring(x, 1, 4)))
    return F.concat(head, F.transform(F.filter(alpha, lambda x: F.length(x) >= 6), lambda x: F.concat(F.lit("s:"), F.right(x, F.lit(4)))))


#: What each view reads besides nt and at.
_NEEDS = {"name_char": ["_compact"], "name_compact": ["_compact"], "name_phon": ["_phon"], "name_pkey": ["_sounds"], "name_pair": ["_nt_sorted"], "name_pkey_pair": ["_sounds_sorted"], "name_addr": ["_nt_once", "_at_once"]}


def derived(tokens: DataFrame, views: list[str]) -> DataFrame:
    """tokens(nt, at, ...) with the columns that these views read, a step each, so that no lambda repeats what a row needs once."""
    wanted = {c for v in views for c in _NEEDS.get(v, [])}
    out = tokens
    if wanted & {"_phon", "_sounds", "_sounds_sorted"}:
        out = out.withColumn("_heard", words(phonetic_key(F.array_join("nt", " "))))
        out = out.withColumns({"_phon": F.array_join("_heard", ""), "_sounds": F.filter("_heard", lambda k: F.length(k) >= 2)})
        out = out.withColumn("_sounds_sorted", F.array_sort(F.array_distinct("_sounds"))).drop("_heard")
    once = {"_compact": F.array_join("nt", ""), "_nt_once": F.array_distinct("nt"), "_at_once": F.array_distinct("at"), "_nt_sorted": F.array_sort(F.array_distinct("nt"))}
    return out.withColumns({c: e for c, e in once.items() if c in wanted})


def view(name: str, n: int = 3) -> Column:
    """The distinct keys of a view, from the columns of `derived`."""
    nt, at = F.col("nt"), F.col("at")
    return F.array_distinct(
        {
            "name_char": lambda: _ngrams(F.col("_compact"), n),
            "name_phon": lambda: _ngrams(F.col("_phon"), n),
            "name_word": lambda: nt,
            "name_pkey": lambda: F.col("_sounds"),
            "name_affix": lambda: _affixes(nt),
            "name_compact": lambda: F.when(F.length("_compact") >= 6, F.array(F.substring("_compact", 1, 8))).otherwise(F.array().cast("array<string>")),
            "name_del": lambda: F.flatten(F.transform(F.filter(nt, lambda x: x.rlike("^[a-z]{5,}$")), _deletions)),
            "name_pair": lambda: _pairs(F.col("_nt_sorted")),
            "name_pkey_pair": lambda: _pairs(F.col("_sounds_sorted")),
            "addr_word": lambda: at,
            "addr_num": lambda: F.filter(at, lambda x: x.rlike(r"^\d+$")),
            "addr_bigram": lambda: _bigrams(at),
            "name_addr": lambda: F.flatten(F.transform("_nt_once", lambda a: F.transform("_at_once", lambda b: F.concat(a, F.lit("|"), b)))),
            "addr_numstreet": lambda: _bigrams(at, lambda p: p.a.rlike(r"^\d+$") & p.b.rlike("^[a-z]+$")),
        }[name]()
    )


VIEWS = ["name_char", "name_phon", "name_word", "name_pkey", "name_affix", "name_compact", "name_del", "name_pair", "name_pkey_pair", "addr_word", "addr_num", "addr_bigram", "name_addr", "addr_numstreet"]
