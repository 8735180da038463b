"""Toxic documents by a learned lexicon, matched through misspellings, with the context of each match.

Lexicon. Over at most about `max_rows` labelled documents, copies counted once, Spark counts for every word and word beginning how many toxic and other
documents hold it. Terms whose likelihood ratio holds up against the number of terms tried make a trie, each weighted by its log odds.

Matching. A Levenshtein automaton (one insertion, deletion, substitution or transposition for terms of five letters or more) is intersected with the trie:
a state is the set of trie nodes and errors that the letters so far allow. States are made when first reached and remembered, so reading a word costs one
lookup per letter and most words leave the automaton after two or three. Words known from clean training documents are no misspellings.

Context. A match inside quotation marks within `window` words counts as quoted, apart from abuse; matches that stand close together count as a cluster. A
ridge logistic regression over these counts, drawn towards weights in which quotation says little, gives the score.

Inputs. A null or empty text has no match. Rows with equal ids or texts are scored one by one; null ids have held_out false. Without labelled rows the score is
0.5 for all. An empty table gives an empty result. Further columns of the input are ignored, or passed through by `reject`."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorline.llm.common import column, pick, steps
from anchorline.session import stage

#: Letters from which a term may be misspelled, lengths of word beginnings tried as terms, and most words remembered.
#: Beyond STATES automaton states, or MEMO words, both are made anew; STEP bytes of text are counted at once when terms are.
STATES, STEP = 20_000, 1 << 20
FUZZY_FROM, STEMS, MEMO = 5, (4, 5, 6, 7, 8), 150_000
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_OPEN, _CLOSE = "\"'“„«‹‘", "\"'”“»›’"
FEATURES = 7
#: Largest weight of a term, and what a misspelling leaves of it.
HEAVIEST, MISSPELLED = 8.0, 0.6
#: Where the weights are drawn to: heaviest plain match, distinct plain matches together, their number, heaviest misspelled, misspelled together, quoted
#: together, cluster; and the constant.
PRIOR = np.array([1.0, 0.3, 0.3, 0.7, 0.3, 0.1, 0.2, -4.0])


def bare(word: str) -> str:
    return word if word.isalnum() else _EDGES.sub("", word)


class Lexicon:
    """The trie, and its intersection with the automaton. terms: (term, whether it is a word's beginning, weight)."""

    def __init__(self, terms: list[tuple[str, bool, float]], known: list[str], errors: int = 1):
        self.terms, self.known, self.errors = terms, frozenset(known), errors
        self.child: list[dict[str, int]] = [{}]
        self.whole, self.beginning = {}, {}
        for term, begins, weight in terms:
            node = 0
            for letter in term:
                if letter not in self.child[node]:
                    self.child[node][letter] = len(self.child)
                    self.child.append({})
                node = self.child[node][letter]
            if begins:
                self.beginning[node] = weight
            else:
                self.whole[node] = (errors if len(term) >= FUZZY_FROM else 0, weight)
        self._start()

    def __getstate__(self):
        return {"terms": self.terms, "known": self.known, "errors": self.errors}

    def __setstate__(self, state):
        self.__init__(state["terms"], state["known"], state["errors"])

    def _start(self) -> None:
        self.memo: dict[str, tuple[int, float] | None] = {}
        self.ids: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        # heaviest whole term read here without and with an error, and heaviest beginning
        self.exact: list[float] = []
        self.close: list[float] = []
        self.begun: list[float] = []
        self.first = self._state({(0, 0, "")})

    def _state(self, items: set) -> int:
        """items: (node, errors, letter owed by a transposition). Deletions of term letters are followed here."""
        todo, closed = list(items), set(items)
        while todo:
            node, e, owed = todo.pop()
            if e < self.errors and not owed:
                for to in self.child[node].values():
                    if (to, e + 1, "") not in closed:
                        closed.add((to, e + 1, ""))
                        todo.append((to, e + 1, ""))
        key = frozenset(closed)
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.next.append({})
            ends = [(e, *self.whole[n]) for n, e, owed in key if not owed and n in self.whole]
            self.exact.append(max((w for e, _, w in ends if not e), default=0.0))
            self.close.append(max((w for e, most, w in ends if 0 < e <= most), default=0.0))
            self.begun.append(max((self.beginning[n] for n, e, owed in key if not owed and not e and n in self.beginning), default=0.0))
        return self.ids[key]

    def _step(self, state: int, letter: str) -> int:
        out = set()
        for node, e, owed in self.states[state]:
            if owed:
                if owed == letter:
                    out.add((node, e, ""))
                continue
            children = self.child[node]
            if letter in children:
                out.add((children[letter], e, ""))
            if e < self.errors:
                out.add((node, e + 1, ""))
                for x, to in children.items():
                    out.add((to, e + 1, ""))
                    if letter in self.child[to] and x != letter:
                        out.add((self.child[to][letter], e + 1, x))
        self.next[state][letter] = to = self._state(out) if out else -1
        return to

    def match(self, word: str) -> tuple[int, float] | None:
        """(1, weight) of a term or beginning, (2, weight) of a misspelled term, or nothing."""
        if word in self.memo:
            return self.memo[word]
        if len(self.memo) > MEMO or len(self.states) > STATES:
            self._start()
        found = self.memo[word] = self._read(bare(word))
        return found

    def _read(self, word: str) -> tuple[int, float] | None:
        state, weight = self.first, 0.0
        for letter in word:
            to = self.next[state].get(letter)
            state = self._step(state, letter) if to is None else to
            if state < 0:
                break
            weight = max(weight, self.begun[state])
        if state >= 0:
            weight = max(weight, self.exact[state])
        if weight:
            return 1, weight
        return (2, MISSPELLED * self.close[state]) if state >= 0 and self.close[state] and word not in self.known else None


def quoted(words: list[str], at: int, window: int) -> bool:
    """Whether an opening quotation mark stands before, and a closing one after, within the window."""
    if words[at][:1] in _OPEN and words[at].rstrip(".,;:!?")[-1:] in _CLOSE:
        return True
    before = after = False
    for i in range(at, max(-1, at - window - 1), -1):
        if words[i][:1] in _OPEN:
            before = True
            break
        if i < at and words[i].rstrip(".,;:!?")[-1:] in _CLOSE:
            break
    for i in range(at, min(len(words), at + window + 1)):
        if words[i].rstrip(".,;:!?")[-1:] in _CLOSE:
            after = True
            break
        if i > at and words[i][:1] in _OPEN:
            break
    return before and after


def features(text: str | None, lexicon: Lexicon, window: int) -> list[float]:
    if not lexicon.terms or not text:
        return [0.0] * FEATURES
    words, match = text.lower().split(), lexicon.match
    hits = [(i, m) for i, m in enumerate(map(match, words)) if m]
    if not hits:
        return [0.0] * FEATURES
    plain, fuzzy, spoken, abuse = {}, {}, 0.0, []
    for i, (kind, weight) in hits:
        if quoted(words, i, window):
            spoken += weight
            continue
        (plain if kind == 1 else fuzzy)[bare(words[i])] = weight
        abuse.append(i)
    cluster, at = 0, 0
    for j, i in enumerate(abuse):
        while abuse[at] < i - window:
            at += 1
        cluster = max(cluster, j - at + 1)
    return [max(plain.values(), default=0.0), math.log1p(sum(plain.values())), math.log1p(len(plain)), max(fuzzy.values(), default=0.0), math.log1p(sum(fuzzy.values())), math.log1p(spoken), math.log1p(cluster)]


class Model:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray, window: int):
        self.lexicon, self.weights, self.window = lexicon, weights, window

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([features(t, self.lexicon, self.window) + [1.0] for t in texts]).reshape(-1, FEATURES + 1)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -40, 40)))


def _once(training: DataFrame) -> DataFrame:
    """One training document per label of those that share their least five-word hash: copies and most near copies. The smallest (doc_id, text) stays, so two runs fit the same."""
    def run(batches):
        for batch in steps(batches):
            least = []
            for text in batch.column(1).to_pylist():
                w = text.lower().split()
                least.append(min((xxhash.xxh3_64_intdigest(" ".join(w[i:i + 5])) for i in range(max(1, len(w) - 4))), default=0) >> 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], names=["doc_id", "text", "label", "least"])

    return (training.select("doc_id", "text", "label").mapInArrow(run, "doc_id bigint, text string, label int, least bigint")
            .groupBy("least", "label").agg(F.min(F.struct("doc_id", "text")).alias("first")).select("first.doc_id", "first.text", "label"))


def _terms(training: DataFrame) -> DataFrame:
    """(term, begins, toxic, clean): documents that hold each word and word beginning, counted per step and then in Spark."""
    def run(batches):
        for batch in steps(batches, size=STEP):
            counts: tuple[Counter, Counter] = Counter(), Counter()
            for text, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = {bare(w) for w in text.lower().split()} - {""}
                counts[label].update((w, False) for w in words)
                counts[label].update({(w[:n], True) for w in words for n in STEMS if len(w) > n})
            keys = list(counts[0].keys() | counts[1].keys())
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys]), pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64())],
                                                 names=["term", "begins", "toxic", "clean"])

    return (training.select("doc_id", "text", "label").mapInArrow(run, "term string, begins boolean, toxic bigint, clean bigint")
            .groupBy("term", "begins").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))


def fit(training: DataFrame, window: int = 6, precision: float = 0.5) -> Model:
    """From (doc_id, text, label). To the driver come the terms beyond chance (words of the bounded sample's toxic documents), their
    misspellings among clean words, and six numbers per training document."""
    once = stage(_once(training), "training")
    totals = dict(once.groupBy("label").count().collect())
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return Model(Lexicon([], []), np.zeros(FEATURES + 1), window)
    terms = stage(_terms(once), "terms")
    tried = max(1, terms.count())
    base = toxic / (toxic + clean)
    n, a, b = F.col("toxic") + F.col("clean"), F.col("toxic"), F.col("clean")
    # likelihood ratio of the term's own share of toxic documents against the base rate, beyond what `tried` terms give by chance
    ratio = a * F.log(a / (n * base)) + F.when(b > 0, b * F.log(b / (n * (1 - base)))).otherwise(0.0)
    odds = F.log((a + 0.5) / (toxic - a + 0.5)) - F.log((b + 0.5) / (clean - b + 0.5))
    strong = (terms.where((a >= 3) & (a >= precision * n) & (ratio >= math.log(tried / 0.05))).withColumn("odds", odds).where("odds > 0")
              .orderBy(F.desc(ratio), "term", "begins").collect())
    chosen = [(r["term"], r["begins"], min(r["odds"], HEAVIEST)) for r in strong]
    lexicon = Lexicon(chosen, [])

    def near(batches):
        for batch in batches:
            words = [w for w in batch.column(0).to_pylist() if (lexicon.match(w) or (0,))[0] == 2]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string())], names=["term"])

    known = [r[0] for r in terms.where("NOT begins AND clean > 0 AND toxic < clean").select("term").mapInArrow(near, "term string").collect()]
    lexicon = Lexicon(chosen, known)

    def run(batches):
        for batch in steps(batches):
            x = [features(t, lexicon, window) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64())), batch.column(2)], names=["doc_id", "x", "label"])

    rows = sorted(once.select("doc_id", "text", "label").mapInArrow(run, "doc_id bigint, x array<double>, label int").collect())
    x = np.array([[*r["x"], 1.0] for r in rows])
    y = np.array([r["label"] for r in rows])
    w = PRIOR.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        slope = x.T @ (p - y) + (w - PRIOR)
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w - step * min(1.0, 2 / np.abs(step).max())
        if np.abs(step).max() < 1e-8:
            break
    return Model(lexicon, w, window)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row."""
    def run(batches):
        for batch in steps(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(model.score(batch.column(1).to_pylist()))], names=["doc_id", "score"])

    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(run, "doc_id bigint, score double")


def reject(docs: DataFrame, model: Model, cut: float = 0.7, text_col: str = "text") -> DataFrame:
    """The input's rows whose score is below the cut."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in steps(batches, text_col):
            keep = model.score(batch.column(at).to_pylist()) < cut
            yield batch.filter(pa.array(keep))

    return docs.select(*[column(c) for c in docs.columns]).mapInArrow(run, docs.schema)
