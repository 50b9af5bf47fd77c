"""Toxicity scores from a learnt lexicon, matched with spelling errors.

The lexicon is learnt from labelled texts: words, and beginnings of words (stems that take many endings),
that toxic texts hold and others do not. Its trie is walked by a Levenshtein automaton: a state is a set
of (trie node, errors so far), made when a text first leads to it and kept, so a known word costs one look-up
and a new word one step per letter; most words die after two or three. A longer term allows more errors.

Each hit is seen in its window of words: between quotation marks it counts as quoted. A logistic curve
over counts of exact, misspelt and quoted hits gives the score.

Only a bounded sample is learnt from: ``PER_CLASS`` labelled rows of either class, of at most
``MOST_CHARS`` characters. Scoring is one pass over the texts with no shuffle.

Cases: null and empty texts have no hits. With no labels, or one class only, every score is the smoothed
share of label 1. Repeated rows, null doc_ids and other columns change nothing: one row out for each row
in. Whole texts are read, however long.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bastionlog.llm.labelled import held_out, training_rows
from bastionlog.llm.logistic import Logistic

FOLDS, HELD_OUT_FOLD, CUT = 4, 2, 0.3
PER_CLASS = 5000
MOST_CHARS = 30_000
LEAST_TEXTS = 4
LEAST_ODDS, ODDS_A_TEXT = 100, 0.04
PLACES_A_TEXT, MOST_PLACES_ASKED = 0.1, 0.01
#: Of 0.0002, 0.002 and 0.02 the one with the fewest errors by four folds inside the learning rows.
FALSE_TERMS = 0.02
STEM_LETTERS = range(4, 8)
STEM_WORDS = 5
KEPT_WORDS = 1 << 19
NEIGHBOURS = 12
OPENING, CLOSING = "\"'“”„«»‘", "\"'”“»«’"


def plain(token: str) -> str:
    """A token in lower case without marks at its ends."""
    begin, end = 0, len(token)
    while begin < end and not token[begin].isalnum():
        begin += 1
    while end > begin and not token[end - 1].isalnum():
        end -= 1
    return token[begin:end].lower()


def errors_allowed(term: str, stem: bool) -> int:
    """Stems are short and open at the end: they allow none; the words learnt beside them do."""
    if stem or len(term) < 4:
        return 0
    return 1 if len(term) < 8 else 2


@dataclass
class Node:
    child: dict[str, int] = field(default_factory=dict)
    ends: int = -1
    stem: bool = False
    most: int = 0


class FuzzyTrie:
    """A lexicon trie intersected with Levenshtein automata, as a deterministic automaton made on demand."""

    def __init__(self, words: list[str], stems: list[str]) -> None:
        self.nodes = [Node()]
        for term, stem in [(w, False) for w in words] + [(s, True) for s in stems]:
            allowed, at = errors_allowed(term, stem), 0
            for letter in term:
                self.nodes[at].most = max(self.nodes[at].most, allowed)
                if letter not in self.nodes[at].child:
                    self.nodes[at].child[letter] = len(self.nodes)
                    self.nodes.append(Node())
                at = self.nodes[at].child[letter]
            self.nodes[at].most = max(self.nodes[at].most, allowed)
            self.nodes[at].ends, self.nodes[at].stem = max(self.nodes[at].ends, allowed), self.nodes[at].stem or stem
        self.sets: list[dict[int, int]] = []
        self.numbers: dict[tuple, int] = {}
        self.steps: list[dict[str, int]] = []
        self.start = self.number({0: 0})

    def number(self, errors: dict[int, int]) -> int:
        """The number of a state, closed under letters left out of the text; -1 for the dead state."""
        todo = list(errors)
        while todo:
            at = todo.pop()
            for child in self.nodes[at].child.values():
                cost = errors[at] + 1
                if cost <= self.nodes[child].most and cost < errors.get(child, 99):
                    errors[child] = cost
                    todo.append(child)
        if not errors:
            return -1
        key = tuple(sorted(errors.items()))
        if key not in self.numbers:
            self.numbers[key] = len(self.sets)
            self.sets.append(errors)
            self.steps.append({})
        return self.numbers[key]

    def step(self, state: int, letter: str) -> int:
        """Take a letter: it fits, replaces another, or is one too many."""
        found: dict[int, int] = {}
        for at, cost in self.sets[state].items():
            node = self.nodes[at]
            if node.stem and not cost:
                found[at] = 0
            if cost + 1 <= node.most:
                found[at] = min(cost + 1, found.get(at, 99))
            for own, child in node.child.items():
                paid = cost + (own != letter)
                if paid <= self.nodes[child].most:
                    found[child] = min(paid, found.get(child, 99))
        return self.number(found)

    def errors(self, word: str) -> int:
        """Least number of errors with which the word is a term; -1 if none allows it."""
        state = self.start
        for letter in word:
            following = self.steps[state].get(letter)
            if following is None:
                following = self.steps[state][letter] = self.step(state, letter)
            if following < 0:
                return -1
            state = following
        ends = [c for at, c in self.sets[state].items() if c <= self.nodes[at].ends]
        return min(ends, default=-1)


class Seen(dict):
    """Errors by raw token; ordinary words that resemble a term are none."""

    def __init__(self, trie: FuzzyTrie, ordinary=()) -> None:
        super().__init__()
        self.trie, self.ordinary = trie, frozenset(ordinary)

    def __missing__(self, token: str) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        word = plain(token)
        found = self.trie.errors(word) if word else -1
        self[token] = found = -1 if found > 0 and word in self.ordinary else found
        return found


def quoted(tokens: list[str], at: int) -> bool:
    """Whether a quotation that begins before the token ends behind it, within its window of words."""
    if tokens[at][0] not in OPENING:
        for i in range(at - 1, max(-1, at - 1 - NEIGHBOURS), -1):
            if tokens[i].rstrip(".,;:!?")[-1:] in CLOSING and len(tokens[i]) > 1:
                return False
            if tokens[i][0] in OPENING:
                break
        else:
            return False
    return any(t.rstrip(".,;:!?")[-1:] in tuple(CLOSING) for t in tokens[at : at + NEIGHBOURS])


def figures(text: str | None, seen: Seen) -> tuple[float, ...]:
    """Counts of exact, one-error and two-error hits outside quotations and of quoted hits; whether there are
    any outside quotations, and their share of the words."""
    tokens = (text or "").split()
    found = list(map(seen.__getitem__, tokens))
    counts = [0.0, 0.0, 0.0, 0.0]
    if found and max(found) >= 0:
        for i, errors in enumerate(found):
            if errors >= 0:
                counts[3 if quoted(tokens, i) else errors] += 1
    hits = sum(counts[:3])
    return (*(min(c, 3.0) for c in counts), float(hits > 0), math.log1p(1000 * hits / (len(tokens) + 20)))


def terms_of(token: str) -> list[str]:
    """A word and its beginnings; a star marks a beginning."""
    return [token, *(token[:n] + "*" for n in STEM_LETTERS if len(token) > n)] if token else []


def chance(n: int, m: int, share: float) -> float:
    """Probability that of n + m texts n or more are toxic, where ``share`` of all texts are."""
    more = math.log((1 - share) / share)
    first = (n + m) * math.log(share)
    return math.exp(first) * math.fsum(math.comb(n + m, j) * math.exp(j * more) for j in range(m + 1))


def surprising(by_chance: dict[str, float], tested: int) -> set[str]:
    """The terms least likely by chance, of which a share of ``FALSE_TERMS`` may be false (Benjamini and Hochberg)."""
    ranked = sorted(by_chance.items(), key=lambda x: x[1])
    last = max((i for i, (_, p) in enumerate(ranked, 1) if p <= FALSE_TERMS * i / tested), default=0)
    return {t for t, _ in ranked[:last]}


def learn_lexicon(rows: list[tuple[str, int]]) -> tuple[list[str], list[str]]:
    """Words and stems by how many toxic and other texts hold them. Each term is tested on its own texts, so
    terms of a rare language count like those of a common one: beyond one other text, toxic texts hold it
    ``LEAST_ODDS`` times as often (fewer where there are few others), and that is not by chance, given how
    many terms were tried. A text counts as evidence
    only with a place of its own (different neighbours), and a tenth of a term's texts have one, so that a
    group of copies, where a rare word always has the same neighbours, does not make it a term. Only what
    passes one test is counted for the next."""
    toxic, other = [t for t, y in rows if y], [t for t, y in rows if not y]
    share = len(toxic) / len(rows)
    odds = min(LEAST_ODDS, ODDS_A_TEXT * len(other)) * len(toxic) / len(other)
    held: Counter = Counter()
    for text in toxic:
        held.update({term for token in set(text.split()) for term in terms_of(plain(token))})
    held = {term: n for term, n in held.items() if n >= LEAST_TEXTS}
    tested = len(held)
    elsewhere: Counter = Counter()
    for text in other:
        elsewhere.update({term for token in set(text.split()) for term in terms_of(plain(token)) if term in held})
    held = {t: n for t, n in held.items() if n >= odds * (elsewhere[t] - 1)}
    places: dict[str, set[int]] = defaultdict(set)
    endings: dict[str, set[str]] = defaultdict(set)
    for text in toxic:
        tokens = [plain(t) for t in text.split()]
        for before, word, after in zip(["", *tokens], tokens, [*tokens[1:], ""], strict=False):
            for term in terms_of(word):
                if term in held:
                    places[term].add(hash((before, after)))
                    endings[term].add(word)
    asked = {t: max(LEAST_TEXTS, min(PLACES_A_TEXT * n, MOST_PLACES_ASKED * len(toxic))) for t, n in held.items()}
    by_chance = {
        t: chance(min(n, len(places[t])), elsewhere[t], share) for t, n in held.items() if len(places[t]) >= asked[t]
    }
    terms = surprising(by_chance, tested)
    telling = sorted(terms, key=lambda t: (len(t), t))
    stems: list[str] = []
    for stem in (t[:-1] for t in telling if t.endswith("*") and len(endings[t]) >= STEM_WORDS):
        if not any(stem.startswith(s) for s in stems):
            stems.append(stem)
    return sorted(t for t in telling if not t.endswith("*")), stems


@dataclass
class Model:
    words: list[str]
    stems: list[str]
    ordinary: list[str]
    curve: Logistic | None
    share: float

    def seen(self) -> Seen:
        return Seen(FuzzyTrie(self.words, self.stems), self.ordinary)


def ordinary_words(rows: list[tuple[str, int]], words: list[str], stems: list[str]) -> list[str]:
    """Words of texts that are not toxic which resemble a term without being one."""
    seen = Seen(FuzzyTrie(words, stems))
    return sorted({plain(t) for text, toxic in rows if not toxic for t in text.split() if seen[t] > 0})


def misspelt(text: str, seen: Seen) -> str:
    """The text with a letter left out of each exact hit that may have errors."""
    return " ".join(t[: len(t) // 2] + t[len(t) // 2 + 1 :] if seen[t] == 0 else t for t in text.split())


def fit(rows: list[tuple[str, int]]) -> Model:
    """Half of the rows make the lexicon, the other half the curve; then the lexicon takes all rows.

    Toxic rows of the second half also come misspelt: writers who hide a term are rare among labelled rows.
    """
    share = (sum(y for _, y in rows) + 1) / (len(rows) + 2)
    one, two = rows[::2], rows[1::2]
    if not len({y for _, y in one}) == len({y for _, y in two}) == 2:
        return Model([], [], [], None, share)
    terms = learn_lexicon(one)
    seen = Seen(FuzzyTrie(*terms), ordinary_words(one, *terms))
    shown = two + [(m, y) for t, y in two if y and max(figures(m := misspelt(t, seen), seen)[:3]) > 0]
    curve = Logistic(np.array([figures(t, seen) for t, _ in shown]), np.array([y for _, y in shown], dtype=float))
    terms = learn_lexicon(rows)
    return Model(*terms, ordinary_words(rows, *terms), curve, share)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(training_rows(docs, labels, "toxic", FOLDS, HELD_OUT_FOLD, PER_CLASS, MOST_CHARS))


def score(text: Column, model: Model) -> Column:
    """double from 0 to 1; higher is likelier toxic."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seen = model.seen()
        for batch in batches:
            if model.curve is None:
                yield pd.Series(np.full(len(batch), model.share))
                continue
            x = np.array([figures(t, seen) for t in batch]).reshape(len(batch), -1)
            yield pd.Series(model.curve.score(x) if len(batch) else np.empty(0))

    return scored(text)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted."""
    model = train(docs, labels)
    rated = docs.select(
        "doc_id",
        held_out(F.col("doc_id"), FOLDS, HELD_OUT_FOLD).alias("held_out"),
        score(F.col("text"), model).alias("score"),
    )
    return rated.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
