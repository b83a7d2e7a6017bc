"""Toxicity by a weighted finite-state grammar over clauses, with a lexicon learned from labels.

The grammar is a chain of transducers, each a table of arcs with weights:

- the lexicon reads the letters of a word and writes what it is: an insult with its learned weight (a trie of words and
  word beginnings), a threat, a target, a negation, a reporting verb, the end of a clause, or any other word;
- negation turns an insult that soon follows it into a negated one and cancels a threat;
- reported speech does the same up to the end of its clause, more mildly for insults;
- threat waits for a target close behind it and writes a menace;
- target adds a bonus where a clause has both an insult and somebody at whom it is aimed.

compose() makes one machine of the last four, once; a clause's score is the weight of its path, and words that match no
pattern weigh nothing. A document's score is a logistic function of the sum of its clauses' scores, its heaviest clause and
its length, so that a match or two in a long text say less than in a short one.

The lexicon comes from a bounded sample of labelled rows (SAMPLE_ROWS, by digest of doc_id): how often each word and each
word beginning occurs in toxic and clean documents. labels, lang, source and doc_id give no feature.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopweave.llm.common import map_batches, text_or_empty

#: Most labelled rows to learn from, folds of which the first is held out, most entries of the lexicon.
SAMPLE_ROWS, FOLDS, LEXICON = 12_000, 5, 4_000
#: Lengths of word beginnings; least toxic documents and least log-odds of an entry; how often a document counts.
BEGINNINGS, LEAST_TOXIC, LEAST_ODDS, MOST_EACH = range(3, 9), 4, 2.5, 4
#: The closed word lists of the grammar.
THREATS = frozenset("kill hurt destroy shoot stab beat burn hang umbringen töten erschießen tuer frapper matar".split())
TARGETS = frozenset("you your yours he him his she her they them their du dich dir ihr euch sie tu toi vous ton usted tú ustedes él ella".split())
NEGATIONS = frozenset("not no never isn't aren't don't nicht kein keine nie ne pas jamais nunca jamás".split())
REPORTS = frozenset("said says say told wrote writes quoted sagte sagt dit disait écrit dijo dice escribió".split())
#: Symbols that the lexicon writes, and those that the other transducers write besides.
WORD, INSULT, THREAT, TARGET, NEGATION, REPORT, END, NEGATED, QUOTED, MENACE = range(10)
#: Words that a negation and a threat reach over; weights of negated and quoted insults; of a menace, of an aimed insult.
REACH_NEGATION, REACH_THREAT, NEGATED_WEIGHT, QUOTED_WEIGHT, MENACE_WEIGHT, AIMED_WEIGHT = 3, 4, 0.4, 0.6, 2.0, 1.0
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:\n]")
_ENDS = frozenset(".!?;:\n")
#: Words that a scanner remembers.
REMEMBERED = 100_000

Arc = tuple[int, int, float, float]


class Transducer:
    """Deterministic and weighted: arcs[state, symbol] = (next state, symbol written, factor, bonus). The value that a
    symbol brings leaves as factor * value + bonus. Where no arc is given, the symbol is written as it is and the state
    becomes rest[state], or 0 after the end of a clause."""

    def __init__(self, arcs: dict[tuple[int, int], Arc], rest: tuple[int, ...]):
        self.arcs, self.rest = arcs, rest

    def arc(self, state: int, symbol: int) -> Arc:
        return self.arcs.get((state, symbol)) or (0 if symbol == END else self.rest[state], symbol, 1.0, 0.0)


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The machine that does what second does with what first writes: its states are the pairs that can be reached."""
    numbers, todo, arcs = {(0, 0): 0}, [(0, 0)], {}
    while todo:
        pair = todo.pop()
        for symbol in range(MENACE + 1):
            a, written, factor, bonus = first.arc(pair[0], symbol)
            b, out, factor2, bonus2 = second.arc(pair[1], written)
            if (a, b) not in numbers:
                numbers[a, b] = len(numbers)
                todo.append((a, b))
            arcs[numbers[pair], symbol] = (numbers[a, b], out, factor * factor2, bonus * factor2 + bonus2)
    return Transducer(arcs, tuple(range(len(numbers))))


def _countdown(n: int) -> tuple[int, ...]:
    return (0, *range(n))


def negation() -> Transducer:
    """State k: a negation still reaches k words."""
    arcs: dict = {(k, NEGATION): (REACH_NEGATION, NEGATION, 1.0, 0.0) for k in range(REACH_NEGATION + 1)}
    for k in range(1, REACH_NEGATION + 1):
        arcs[k, INSULT] = (0, NEGATED, NEGATED_WEIGHT, 0.0)
        arcs[k, THREAT] = (0, WORD, 0.0, 0.0)
    return Transducer(arcs, _countdown(REACH_NEGATION))


def reported() -> Transducer:
    """State 1: behind a reporting verb."""
    return Transducer({(0, REPORT): (1, REPORT, 1.0, 0.0), (1, INSULT): (1, QUOTED, QUOTED_WEIGHT, 0.0), (1, THREAT): (1, WORD, 0.0, 0.0)}, (0, 1))


def threat() -> Transducer:
    """State k: a threat still waits k words for its target."""
    arcs: dict = {(k, THREAT): (REACH_THREAT, THREAT, 1.0, 0.0) for k in range(REACH_THREAT + 1)}
    arcs.update({(k, TARGET): (0, MENACE, 1.0, MENACE_WEIGHT) for k in range(1, REACH_THREAT + 1)})
    return Transducer(arcs, _countdown(REACH_THREAT))


def target() -> Transducer:
    """States: nothing yet, a target, an insult, both."""
    arcs: dict = {(0, INSULT): (2, INSULT, 1.0, 0.0), (1, INSULT): (3, INSULT, 1.0, AIMED_WEIGHT)}
    for symbol in (TARGET, MENACE):
        arcs |= {(0, symbol): (1, symbol, 1.0, 0.0), (2, symbol): (3, symbol, 1.0, AIMED_WEIGHT)}
    return Transducer(arcs, (0, 1, 2, 3))


GRAMMAR = compose(compose(compose(negation(), reported()), threat()), target())


class Lexicon:
    """The first transducer: a trie whose arcs read a letter. A word is what its longest way through the trie says: the
    insult of greatest weight among its beginnings and itself, else the closed list that holds it."""

    def __init__(self, words: dict[str, float], beginnings: dict[str, float]):
        self.arcs: dict[tuple[int, str], int] = {}
        self.begun: dict[int, float] = {}
        self.whole: dict[int, tuple[int, float]] = {}
        for symbol, closed in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (END, _ENDS)):
            for word in closed:
                self.whole[self._add(word)] = (symbol, 0.0)
        for word, weight in words.items():
            self.whole[self._add(word)] = (INSULT, weight)
        for word, weight in beginnings.items():
            self.begun[self._add(word)] = weight

    def _add(self, word: str) -> int:
        state = 0
        for letter in word:
            state = self.arcs.setdefault((state, letter), len(self.arcs) + 1)
        return state

    def read(self, word: str) -> tuple[int, float]:
        state, best = 0, 0.0
        for letter in word:
            state = self.arcs.get((state, letter), -1)
            if state < 0:
                break
            best = max(best, self.begun.get(state, 0.0))
        symbol, weight = self.whole.get(state, (WORD, 0.0))
        return (INSULT, max(best, weight)) if best or symbol == INSULT else (symbol, 0.0)


@dataclass(frozen=True)
class Model:
    """The lexicon, and the logistic function's offset and slopes."""

    words: dict[str, float]
    beginnings: dict[str, float]
    slopes: tuple[float, float, float, float]

    def scanner(self) -> Scanner:
        return Scanner(self)


class Scanner:
    """A model at work: the lexicon, which remembers words, and the composed grammar behind it."""

    def __init__(self, model: Model):
        self.slopes = model.slopes
        lexicon = Lexicon(model.words, model.beginnings)
        # what words may be, by number: symbols without a weight under their own numbers, each weight of an insult behind them
        self.kinds: list[tuple[int, float]] = [(symbol, 0.0) for symbol in range(END + 1)]
        numbers = {kind: i for i, kind in enumerate(self.kinds)}

        class Words(dict):
            def __missing__(self, word: str) -> int:
                if len(self) > REMEMBERED:
                    self.clear()
                kind = lexicon.read(word)
                if kind not in numbers:
                    numbers[kind] = len(kinds)
                    kinds.append(kind)
                found = self[word] = numbers[kind]
                return found

        kinds, self.words = self.kinds, Words()
        self.machine = [[GRAMMAR.arc(state, symbol) for symbol in range(END + 1)] for state in range(len(GRAMMAR.rest))]
        # one pass over the letters says whether a text has an insult or a threat at all; without one nothing matches
        self.any = ahocorasick.Automaton()
        for start in {*model.words, *model.beginnings, *THREATS}:
            self.any.add_word(start, len(start))
        self.any.make_automaton()

    def clauses(self, text: str) -> list[float]:
        """The scores of the clauses that match a pattern."""
        low = text.lower()
        if not any(end < n or not low[end - n].isalpha() for end, n in self.any.iter(low)):
            return []
        read = [*map(self.words.__getitem__, _TOKEN.findall(low)), END]
        if max(read) <= END and THREAT not in read:
            return []
        out, state, score = [], 0, 0.0
        for kind in read:
            symbol, value = self.kinds[kind]
            state, _, factor, bonus = self.machine[state][symbol]
            score += factor * value + bonus
            if symbol == END:
                if score:
                    out.append(score)
                score = 0.0
        return out

    def features(self, text: str) -> tuple[float, float, float]:
        clauses = self.clauses(text)
        return math.log1p(sum(clauses)), max(clauses, default=0.0), math.log1p(text.count(" ") + text.count("\n"))

    def score(self, text: str) -> float:
        a, b, c, d = self.slopes
        x, y, z = self.features(text)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x + c * y + d * z))))


def fold(doc_id: F.Column) -> F.Column:
    """crc32 of doc_id as text, modulo FOLDS; a null doc_id has the crc of an empty text, 0, and so is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """text and toxic of at most `rows` labelled documents that aren't held out. The ids are bounded, so they are broadcast."""
    ids = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(fold(F.col("doc_id")) != 0)
    ids = ids.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id", "toxic").limit(rows)
    return text_or_empty(docs).join(F.broadcast(ids), "doc_id").select("text", "toxic")


def occurrences(text: str) -> Counter:
    """How often each word (marked by $) and word beginning occurs, at most MOST_EACH times for each word."""
    out: Counter = Counter()
    for word, n in Counter(_WORD.findall(text.lower())).items():
        n = min(n, MOST_EACH)
        out[word + "$"] += n
        for k in BEGINNINGS:
            if k <= len(word):
                out[word[:k]] += n
    return out


def feature_counts(sample: DataFrame) -> DataFrame:
    """feature, docs (toxic documents that have it), toxic, clean: how often it occurs in each kind. Counted in batches first.
    The feature "" counts all words."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        docs, toxic, clean = Counter(), Counter(), Counter()
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = occurrences(text)
            found[""] = sum(n for f, n in found.items() if f[-1] == "$")
            (toxic if label else clean).update(found)
            if label:
                docs.update(found.keys())
        names = [*{**toxic, **clean}]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[x] for x in names], pa.int64()) for c in (docs, toxic, clean))], ["feature", "docs", "toxic", "clean"])

    counted = map_batches(sample, lambda: step, "feature string, docs long, toxic long, clean long")
    return counted.groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("docs", "toxic", "clean")])


def choose(rows: Iterable[tuple[str, int, float]]) -> tuple[dict[str, float], dict[str, float]]:
    """The lexicon from (feature, toxic documents, log-odds): those that say most come first, and of features that say the
    same the longest, then the whole word; what begins with an entry or is a beginning of one is left out."""
    words, beginnings, covered = {}, {}, set()
    for f, _, odds in sorted(rows, key=lambda r: (-round(r[1] * r[2], 6), -len(r[0].rstrip("$")), not r[0].endswith("$"), r[0])):
        name, whole = f.rstrip("$"), f.endswith("$")
        if any(name[:n] in beginnings for n in range(BEGINNINGS[0], len(name) + 1)) or (not whole and name in covered):
            continue
        (words if whole else beginnings)[name] = round(odds, 6)
        covered.update(name[:n] for n in range(1, len(name) + 1))
    return words, beginnings


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """The lexicon and the logistic function, from the sample. Without a toxic or without a clean row every score is that share."""
    sample = labelled_sample(docs, labels, rows).persist()
    counts = {r["toxic"] != 0: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_toxic, n_clean = counts.get(True, 0), counts.get(False, 0)
    if not n_toxic or not n_clean:
        sample.unpersist()
        return Model({}, {}, (math.log((n_toxic + 0.5) / (n_clean + 0.5)) if n_toxic or n_clean else -2.0, 0.0, 0.0, 0.0))
    counted = feature_counts(sample).persist()
    total = counted.where("feature = ''").head()
    gain = F.log((F.col("toxic") + 0.5) / (total["toxic"] + 1)) - F.log((F.col("clean") + 0.5) / (total["clean"] + 1))
    best = counted.where(F.col("docs") >= LEAST_TOXIC).withColumn("gain", gain).where(F.col("gain") >= LEAST_ODDS).orderBy(F.desc(F.col("docs") * F.col("gain")), "feature").limit(LEXICON).collect()
    counted.unpersist()
    words, beginnings = choose((r["feature"], r["docs"], r["gain"]) for r in best if r["feature"])
    draft = Model(words, beginnings, (0.0, 0.0, 0.0, 0.0))

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        features = draft.scanner().features
        got = np.array([features(t) for t in batch.column(0).to_pylist()], np.float64).reshape(-1, 3)
        return pa.RecordBatch.from_arrays([*(pa.array(got[:, i]) for i in range(3)), batch.column(1)], ["x", "y", "z", "toxic"])

    seen = map_batches(sample, lambda: measure, "x double, y double, z double, toxic int").orderBy("x", "y", "z", "toxic").collect()  # at most `rows` rows
    sample.unpersist()
    return Model(words, beginnings, logistic(np.array([[r["x"], r["y"], r["z"]] for r in seen]), np.array([float(r["toxic"] != 0) for r in seen])))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Offset and slopes by Newton steps on a likelihood with a small penalty, so that separable data stay finite."""
    design = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    w = np.zeros(design.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        slope = design.T @ (y - p) - 0.01 * w
        curve = (design * (p * (1 - p) + 1e-6)[:, None]).T @ design + 0.01 * np.eye(len(w))
        step = np.clip(np.linalg.solve(curve, slope), -2, 2)
        w = w + step
        if abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs.

    Whole texts are read, however long. Null and empty texts have the score of an empty text; rows with equal texts score the
    same, and repeated rows and null doc_ids keep their rows (a null doc_id counts as held out); an empty table gives an empty
    table. Other columns are ignored, whatever they are called.
    """

    def make():
        score = model.scanner().score

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([score(t) for t in batch.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

        return step

    scored = map_batches(text_or_empty(docs), make, "doc_id long, score double")
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs whose score is below `least`, each by its own text; columns and other rows stay as they are.

    Null and empty texts have the score of an empty text; equal texts go or stay together; null and repeated doc_ids make no
    difference, and very long texts are read as a whole; an empty table gives an empty table.
    """

    def make():
        score = model.scanner().score

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.filter(pa.array([score(t or "") < least for t in batch.column("text").to_pylist()], pa.bool_()))

        return step

    return map_batches(docs, make, docs.schema)
