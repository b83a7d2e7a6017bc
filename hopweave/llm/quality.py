"""Quality rules as a bitmask ledger, in DataFrame functions alone.

Every rule is evaluated once for each document: the ledger keeps the measurements and one bit for each rule that
fails. A policy is a version name and a mask of rules; verdicts and ablations (what a policy would keep without one
of its rules) are bit operations and sums over the ledger, so texts are never read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopweave.llm.common import SPACES, WORD, text_or_empty

SYMBOLS = "#*$%&|<>"
#: A packed entry holds a word position in its low bits and a part of a window's hash above.
_POSITION_BITS = 31

#: Rules in bit order: name and condition of failure over the ledger's measurements. Fixed order: bits are stored.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 5 * word_chars"),
    ("duplicate_lines", "n_lines >= 4 and 100 * n_dup_lines > 30 * n_lines"),
    ("long_words", "word_chars > 25 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("capitals", "10 * n_capitals > 6 * n_letters and n_letters > 0"),
    ("exclamations", "4 * n_exclamations > n_words"),
)
#: Policies by version: the rules that reject. v1 is the base alone.
POLICIES = {"v1": ("few_words", "repeated_words"), "v2": tuple(name for name, _ in RULES)}


def mask_of(rules: tuple[str, ...]) -> int:
    names = [name for name, _ in RULES]
    return sum(1 << names.index(rule) for rule in rules)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, which an optimizer that inlines expressions can't undo."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _twice(items: Column, key: Callable[[Column], Column]) -> Column:
    """Of a sorted array, the items whose key equals that of a neighbour."""
    last = F.size(items) - 1

    def same(x: Column, i: Column) -> Column:
        return F.when(i > 0, key(F.get(items, i - 1)) == key(x)).otherwise(False) | F.when(i < last, key(F.get(items, i + 1)) == key(x)).otherwise(False)

    return F.filter(items, same)


def repeated_words(words: Column) -> Column:
    """Of an array of words, how many stand in a window of 3 that occurs twice or more. Windows are found by hash and compared by text."""
    high = ~((1 << _POSITION_BITS) - 1)

    def counted(w: Column) -> Column:
        windows = F.sequence(F.lit(0), F.size(w) - 3)
        packed = F.sort_array(F.transform(windows, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.lit(high)).bitwiseOR(i.cast("long"))))

        def among(p: Column) -> Column:
            alike = F.transform(_twice(p, lambda x: F.shiftright(x, _POSITION_BITS)), lambda x: x.bitwiseAND(F.lit(~high)).cast("int"))
            texts = F.sort_array(F.transform(alike, lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("t"), i.alias("i"))))
            return _let(texts, lambda t: F.size(F.array_distinct(F.flatten(F.transform(_twice(t, lambda x: x["t"]), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))))

        return F.when(F.size(w) < 4, F.lit(0)).otherwise(_let(packed, among))

    return _let(words, counted)


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, measurements (long) and failed, the bits of the rules that fail, of each row of docs.

    A null text counts as an empty one, with no words; repeated rows and null doc_ids keep their rows; an empty table
    gives an empty table. Other columns are ignored, whatever they are called.
    """
    text = F.col("text")

    def without(chars: str) -> Column:
        return F.char_length(text) - F.char_length(F.translate(text, chars, ""))

    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.char_length(F.translate(x, SPACES, "")) > 0)
    measured = text_or_empty(docs).select(
        "doc_id",
        _let(words, lambda w: F.struct(F.size(w).alias("n_words"), repeated_words(w).alias("n_repeat_words"))).alias("w"),
        F.char_length(F.translate(text, SPACES, "")).alias("word_chars"),
        without(SYMBOLS).alias("n_symbols"),
        _let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))).alias("l"),
        without("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_capitals"),
        without("abcdefghijklmnopqrstuvwxyz").alias("n_small"),
        without("!").alias("n_exclamations"),
    )
    flat = measured.select(
        "doc_id",
        *[F.col(c).cast("long").alias(n) for c, n in (("w.n_words", "n_words"), ("word_chars", "word_chars"), ("n_symbols", "n_symbols"), ("l.n_dup_lines", "n_dup_lines"), ("w.n_repeat_words", "n_repeat_words"), ("l.n_lines", "n_lines"), ("n_capitals", "n_capitals"), ("n_exclamations", "n_exclamations"))],
        (F.col("n_small") + F.col("n_capitals")).cast("long").alias("n_letters"),
    )
    failed = F.lit(0).cast("long")
    for bit, (_, fails) in enumerate(RULES):
        failed = failed + F.when(F.expr(fails), F.lit(1 << bit)).otherwise(F.lit(0))
    return flat.withColumn("failed", failed)


def verdicts(rows: DataFrame, version: str = "v2") -> DataFrame:
    """A ledger with base_failed and kept under a policy."""
    bad = [F.col("failed").bitwiseAND(F.lit(mask_of(POLICIES[v]))) != 0 for v in ("v1", version)]
    return rows.withColumns({"base_failed": bad[0], "kept": ~bad[0] & ~bad[1], "policy": F.lit(version)})


def ablations(rows: DataFrame) -> DataFrame:
    """For each policy and each of its rules: documents, those that fail the rule, those that the policy rejects, and
    those that only this rule rejects (kept without it). One pass: each count is a sum of bit tests."""
    tests, labels = [], []
    for version, rules in POLICIES.items():
        mask = mask_of(rules)
        for rule in rules:
            bit = mask_of((rule,))
            hit = F.col("failed").bitwiseAND(F.lit(mask))
            k = len(labels)
            tests += [F.sum((hit.bitwiseAND(F.lit(bit)) != 0).cast("long")).alias(f"f{k}"), F.sum((hit != 0).cast("long")).alias(f"r{k}"), F.sum((hit == F.lit(bit)).cast("long")).alias(f"o{k}")]
            labels.append((version, rule))
    one = rows.agg(F.count("*").alias("n"), *tests)
    cells = [F.struct(F.lit(v).alias("policy"), F.lit(r).alias("rule"), F.col("n").alias("n_docs"), *[F.coalesce(F.col(f"{c}{k}"), F.lit(0)).cast("long").alias(name) for c, name in (("f", "n_failed"), ("r", "n_rejected"), ("o", "n_only"))]) for k, (v, r) in enumerate(labels)]
    return one.select(F.inline(F.array(*cells)))
