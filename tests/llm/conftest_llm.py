"""Odd rows and invented prose for the tests."""

import random

LONG = " ".join(f"word{i % 4001} ab{i}" for i in range(30_000))
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing", "ed"]) + rng.choice(["", "", ".", ","]) for _ in range(n))


#: Nulls in every column, empty and very long texts, ties and repeated rows.
ODD = [
    (1, "Hello the big World of words", "en", "a", 5), (1, "Hello the big World of words", "en", "a", 5), (2, None, None, None, None), (3, "", "en", "b", 0),
    (4, " \t\n\x0b\x0c\r ", "en", "b", 7), (5, LONG, "de", "a", len(LONG)), (6, LONG, "de", "c", len(LONG)), (None, "no id here", "en", "a", 1), (None, None, None, None, None),
    (7, "naïve café — 日本語 \U0001f600 é", "fr", "é", 3), (8, "one", "en", "z", 1), (9, "one two", "en", "z", 1), (10, prose(1, 300), "en", "a", 1), (11, prose(1, 300).replace("alpha", "alpha alpha", 1), "en", "b", 1), (12, prose(2, 300), "en", "b", 1),
    (2, "another row of two", "en", "a", 1), (13, "<|endoftext|> a<|startoftext|>b", "en", None, 1),
]
#: Columns that operators use inside.
CLASHING = ("size", "u", "fp", "id", "row", "rank", "bucket", "shard", "score", "label", "component_id", "copies", "path", "words", "n", "at", "w", "failed", "spans", "toxic", "v", "list")

