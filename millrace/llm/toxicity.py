"""Toxicity behind noisy spelling.

Restoring: each suspicious token becomes a lattice. A letter run can be meant
once, twice or as it stands; a digit or symbol can stand for letters; separators
inside a word can be dropped; single characters in a row ("s p e l l e d") join
with an optional word break at each gap. Viterbi under a character trigram model
of the corpus, with fixed channel costs, finds the restored text. A token or a row
is one lattice whatever its length. Tokens of plain letters without a repeated
letter have one path and are kept as they are. When texts are scored, neighbouring
tokens that make up a known word together ("st upid", "a s s") are a lattice too, in
which each space costs little to keep and more to drop, and tokens of digits and
symbols count if they read as a known word.

Scoring: the restored words and their prefixes are features of a logistic model
with non-negative weights and an L1 penalty (so a word that merely sits in the
same copied passage gets nothing), fitted on a bounded sample of labelled rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import charlm
from .common import chunked, crc_mod, keep_texts, map_texts, slices, staged, summed_vector

#: Labelled rows of each class that the classifier is fitted on, at most; chosen by a hash of the id.
SAMPLE_ROWS = 2500
#: Part of the toxic rows of the sample that a feature occurs in at least, and rows at least.
RARE, RARE_ROWS = 0.002, 3
#: By how many standard deviations a feature is more frequent in toxic rows than in clean ones, at least.
DEVIATIONS = 2.0
#: Bytes of text whose features are made at a time: they take much more room than the text.
FEATURE_BYTES = 200_000
PREFIXES = (3, 4, 5, 6, 7, 8)
#: A prefix that so many different words of a text share is a further feature.
SHARED_BY = (2, 3)
#: Penalty that chooses features, and the one that the chosen are fitted again with.
L1, L1_AGAIN = 2e-3, 1e-4
ROUNDS = 200
#: Entries of a task's table of restored words; it is emptied when full.
TABLE_ENTRIES = 300_000

# What a symbol may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¢": "c", "¡": "i",
    "*": "aeiou", "#": "aeiou",
}
SEPARATORS = frozenset(".-_~^'`,/\\·•​‌‍﻿­")
# Channel costs, natural logs. A gap is a dropped space between single characters, JOINED one between longer pieces.
JOINED, APART = math.log(0.2), math.log(0.8)
REPLACED, WILD, DROPPED, GAP, BREAK = math.log(0.2), math.log(0.05), math.log(0.3), math.log(0.7), math.log(0.005)
ONCE_OF_TWO, TWICE_OF_TWO, ONCE_OF_MORE, TWICE_OF_MORE, KEPT_OF_MORE = math.log(0.02), math.log(0.98), math.log(0.6), math.log(0.38), math.log(0.02)

STRIP = ".,;:?\"()[]{}<>…«»“”„¿"
SPELLED = re.compile(r"(?:(?<=\s)|^)\S(?:\s+\S){3,}(?=\s|$)")
DOUBLED = re.compile(r"(.)\1")
SAME = re.compile(r"(.)\1+")
RUNS = re.compile(r"(.)\1*", re.S)


class Restorer:
    """Viterbi over character lattices; ``table`` is the trigram model's log probabilities."""

    def __init__(self, table: np.ndarray):
        self.lm = table.astype(np.float64).tolist()
        self.classes = charlm.class_table()
        self.code: dict[str, int] = {}

    def edges(self, token: str, space: tuple[float, float] = (GAP, BREAK)) -> list[list[tuple[str, float]]]:
        """The lattice: for each run of equal characters its possible restorations with their costs; a space is a word break. ``space``: costs to drop and to keep one."""
        out = []
        for m in RUNS.finditer(token):
            c, n = m[1], len(m[0])
            if c.isalpha():
                if n == 1:
                    out.append([(c, 0.0)])
                elif n == 2:
                    out.append([(c + c, TWICE_OF_TWO), (c, ONCE_OF_TWO)])
                else:
                    out.append([(c, ONCE_OF_MORE), (c + c, TWICE_OF_MORE), (m[0], KEPT_OF_MORE)])
            elif c == " ":
                out.append([("", space[0]), (" ", space[1])])
            elif c in LEET:
                cost = WILD if len(LEET[c]) > 2 else REPLACED
                out.append([(x, cost) for x in LEET[c]] + ([(x + x, cost + DROPPED) for x in LEET[c]] if n > 1 else []) + [(" ", BREAK)])
            elif c in SEPARATORS:
                out.append([("", DROPPED), (" ", BREAK)])
            else:
                out.append([(" ", BREAK)])
        return out

    def decode(self, token: str, space: tuple[float, float] = (GAP, BREAK)) -> str:
        """The most probable restored text of a lower-cased token of any length; words are separated by spaces."""
        lm, code = self.lm, self.code
        # A state holds its score and the way back: what was emitted last, after the way before.
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for options in self.edges(token, space) + [[(" ", 0.0)]]:
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a0, b0), (score0, way) in states.items():
                for emitted, cost in options:
                    a, b, score, text = a0, b0, score0 + cost, ""
                    for ch in emitted:
                        c = code.get(ch)
                        if c is None:
                            c = code[ch] = int(self.classes[ord(ch)])
                        if c or b:
                            score += lm[(a * 64 + b) * 64 + c]
                            text += ch
                        a, b = (b, c) if b and c else (0, c)
                    had = new.get((a, b))
                    if had is None or score > had[0]:
                        new[a, b] = (score, (way, text) if text else way)
            states = new
        way, out = max(states.values(), key=lambda x: x[0])[1], []
        while way is not None:
            way, text = way
            out.append(text)
        return "".join(reversed(out)).strip()

    def restore_token(self, token: str) -> str:
        """The restored words of a white-space token, lower case; empty if it holds none."""
        t = token.lower()
        if t.isalpha() and not DOUBLED.search(t):
            return t
        t = t.strip(STRIP)
        if t.isalpha() and not DOUBLED.search(t):
            return t
        if not any(c.isalpha() or c in "@$" for c in t):
            return ""
        if t.endswith("!"):
            t = t.rstrip("!")
        return self.decode(t)

    def symbols(self, token: str) -> str:
        """What a token without letters reads as, if all its characters are taken for letters."""
        t = token.lower().strip(STRIP)
        if any(c.isalpha() or c in "@$" for c in t) or sum(c in LEET for c in t) < 3:
            return ""
        return self.decode(t)

    def together(self, tokens: list[str]) -> list[str]:
        """The words of neighbouring tokens, between which spaces may be dropped."""
        return self.decode(" ".join(tokens).lower().strip(STRIP).rstrip("!"), (JOINED, APART)).split()

    def spelled(self, text: str) -> list[str]:
        """Words restored from rows of single characters."""
        out = []
        for m in SPELLED.finditer(text):
            chars = " ".join(m[0].lower().split())
            if sum(c.isalpha() for c in chars) >= 2:
                out += self.decode(chars).split()
        return out


def features(word: str) -> list[str]:
    """A word's own features: itself and its prefixes."""
    return [word + "$"] + [word[:n] for n in PREFIXES if len(word) >= n]


def with_counts(words: Iterable[tuple[str, ...]], known: dict[str, float] | None = None) -> set[str]:
    """The features of a text from those of its different words; ``known`` limits the counted ones."""
    seen: dict[str, int] = {}
    for own in words:
        for f in own:
            seen[f] = seen.get(f, 0) + 1
    out = set(seen)
    for f, n in seen.items():
        for least in SHARED_BY:
            if n >= least and not f.endswith("$") and (known is None or f"{f}#{least}" in known):
                out.add(f"{f}#{least}")
    return out


def solve(row: np.ndarray, col: np.ndarray, n_cols: int, labels: np.ndarray, weight: np.ndarray, l1: float, rounds: int) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient for weighted logistic loss, coefficients at least 0; (coefficients, bias)."""
    n = len(labels)
    w, b, z, zb, t = np.zeros(n_cols), -2.0, np.zeros(n_cols), -2.0, 1.0
    step = 4.0 / (1.0 + min(float(np.bincount(row, minlength=n).max(initial=0)), 40.0))
    for _ in range(rounds):
        margin = zb + np.bincount(row, weights=z[col], minlength=n)
        error = weight * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels)
        new = np.maximum(0.0, z - step * (np.bincount(col, weights=error[row], minlength=n_cols) + l1))
        nb = zb - step * error.sum()
        t2 = 1.0 if (new - w) @ (z - new) > 0 else (1 + math.sqrt(1 + 4 * t * t)) / 2  # restart the momentum
        z, zb = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = new, nb, t2
    return w, b


def of_words(words: Iterable[str]) -> set[str]:
    return with_counts(tuple(features(w)) for w in words)


def fit_weights(row: np.ndarray, col: np.ndarray, names: list[str], labels: np.ndarray, rounds: int = ROUNDS) -> tuple[dict[str, float], float]:
    """Non-negative logistic regression on feature presence: (weights, bias), classes weighted equally.

    Document row[i] has the feature names[col[i]]. The larger penalty chooses
    the features, the smaller one fits them.
    """
    n_pos, n_neg = int(labels.sum()), int(len(labels) - labels.sum())
    if not n_pos or not n_neg:
        return {}, 0.0  # one class alone teaches nothing: every text scores 0.5
    weight = np.where(labels == 1, 0.5 / n_pos, 0.5 / n_neg)
    w, b = solve(row, col, len(names), labels, weight, L1, rounds)
    left = np.flatnonzero(w > 1e-3)
    on = np.isin(col, left)
    w, b = solve(row[on], np.searchsorted(left, col[on]), len(left), labels, weight, L1_AGAIN, 2 * rounds)
    return {names[i]: x for i, x in zip(left, w.tolist()) if x > 1e-3}, float(b)


def fit_language(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log probabilities of the character trigrams of all rows of ``docs``."""

    def run(batches):
        total = np.zeros(charlm.CELLS, np.int64)
        for batch in slices(batches):
            texts = [t for t in batch.column("text").to_pylist() if t]
            if texts:
                flat, _ = charlm.points(texts)
                total += charlm.counted(charlm.class_table()[flat])
        yield pa.RecordBatch.from_pandas(chunked(0, total), preserve_index=False)

    parts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "key int, chunk int, data binary")
    return charlm.log_probabilities(summed_vector(parts, "key", charlm.CELLS, "int64").get(0, np.zeros(charlm.CELLS, np.int64)))


class Model:
    def __init__(self, table: np.ndarray, weights: dict[str, float], bias: float):
        self.table, self.weights, self.bias = table.astype(np.float32), weights, bias

    def scorer(self):
        """text -> score; holds the task's table of restored words."""
        restorer, weights, bias = Restorer(self.table), self.weights, self.bias
        counted = {f.partition("#")[0] for f in weights}
        table: dict[str, tuple[tuple[str, ...], str]] = {}

        # A restored word keeps its letters but for repeats, so without repeats it starts as a feature does, or it has none:
        # plain letters that start otherwise need no decoding.
        single = {SAME.sub(r"\1", f.rstrip("$")) for f in counted}
        lengths = sorted({len(f) for f in single})

        def hopeless(token: str) -> bool:
            t = token.lower().strip(STRIP)
            if not t.isalpha():
                return False
            t = SAME.sub(r"\1", t)
            return not any(t[:n] in single for n in lengths)

        # Known words without repeats, and what they begin with: what pieces of a word must make up together.
        whole = {SAME.sub(r"\1", f[:-1]) for f in counted if f.endswith("$") and len(f) > 3}
        starts = {w[:n] for w in whole for n in range(1, len(w))}
        longest = 2 * max(map(len, whole), default=0)
        inner = starts | {w[m:n] for w in whole for m in range(1, len(w)) for n in range(m + 1, len(w) + 1)}

        def active(token: str) -> tuple[tuple[str, ...], str]:
            """A token's words with known features, and its letters without repeats if they may be a piece of a known word."""
            if hopeless(token):
                found, text = (), token.lower().strip(STRIP)
            else:
                text = restorer.restore_token(token)
                found = tuple(w for w in text.split() if any(f in counted for f in features(w)))
                if not text:
                    found = tuple(w for w in restorer.symbols(token).split() if w + "$" in counted)
            piece = SAME.sub(r"\1", text) if text.isalpha() else ""
            out = found, piece if piece in inner or piece in whole else ""
            if len(table) > TABLE_ENTRIES:
                table.clear()
            if len(token) <= 60:
                table[token] = out
            return out

        def joined(tokens: list[str], piece_of: dict[str, str]) -> set[str]:
            """Known words that neighbouring tokens make up, pieces of together ``longest`` letters at most."""
            words: set[str] = set()
            for i, token in enumerate(tokens):
                made = piece_of.get(token, "")
                if made not in starts:
                    continue
                size = len(made)
                for j in range(i + 1, len(tokens)):
                    piece = piece_of.get(tokens[j])
                    if not piece:
                        break
                    size += len(piece)
                    made = SAME.sub(r"\1", made + piece)
                    if size > longest or made not in starts and made not in whole:
                        break
                    if made in whole:
                        words.update(w for w in restorer.together(tokens[i : j + 1]) if w + "$" in counted)
            return words

        def score(text: str | None) -> float:
            words: set[str] = set()
            if text:
                tokens = text.split()
                piece_of: dict[str, str] = {}
                for token in set(tokens):
                    had = table.get(token)
                    if had is None:
                        had = active(token)
                    if had[0]:
                        words.update(had[0])
                    if had[1]:
                        piece_of[token] = had[1]
                if not starts.isdisjoint(piece_of.values()):
                    words.update(joined(tokens, piece_of))
                words.update(restorer.spelled(text))
            on = with_counts((tuple(f for f in features(w) if f in counted) for w in words), weights) if words else ()
            margin = bias + sum(weights[f] for f in sorted(on) if f in weights)
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, margin))))

        return score


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Character model of all rows of ``docs``; classifier of at most ``sample_rows`` labelled rows of each class.

    Of rows that repeat an id the one with the smallest text is fitted on, once.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    table = fit_language(rows)
    marked = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))
    marked = marked.join(rows.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen: dict[int, int] = {}
    for y in (0, 1):  # two bounded top-k lists
        chosen |= {r["doc_id"]: y for r in marked.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).collect()}

    def start():
        restorer = Restorer(table)

        def run(texts):
            out = []
            for t in texts:
                words = {w for token in set((t or "").split()) for w in restorer.restore_token(token).split()}
                out.append(sorted(of_words(words | set(restorer.spelled(t or "")))))
            return [out]

        return run

    # one text an id; features are counted where they are, and only those worth a weight reach the driver, as numbers
    sample = rows.filter(F.col("doc_id").isin(list(chosen))).groupBy("doc_id").agg(F.min("text").alias("text"))
    sample = sample.withColumn("y", F.col("doc_id").isin([i for i, y in chosen.items() if y]).cast("int"))
    marked = staged(map_texts(sample, start, "features array<string>", FEATURE_BYTES), "features")
    labels_of = {r["doc_id"]: r["y"] for r in marked.select("doc_id", "y").collect()}
    ids = sorted(labels_of)
    y = np.array([labels_of[i] for i in ids], np.int64)
    n_pos, n_neg = int(y.sum()), len(y) - int(y.sum())
    names: list[str] = []
    if n_pos and n_neg:
        seen = marked.select("y", F.explode("features").alias("f")).groupBy("f").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
        share = (F.col("pos") + F.col("neg")) / (n_pos + n_neg)
        apart = (F.col("pos") / n_pos - F.col("neg") / n_neg) > DEVIATIONS * F.sqrt(share * (1 - share) * (1 / n_pos + 1 / n_neg))
        names = sorted(r["f"] for r in seen.filter((F.col("pos") >= max(RARE_ROWS, RARE * n_pos)) & apart).select("f").collect())
    number = {f: i for i, f in enumerate(names)}

    def numbered(batches):
        for batch in batches:
            kept = [np.array(sorted(number[f] for f in fs.as_py() if f in number), np.int32).tobytes() for fs in batch.column("features")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.binary())], names=["doc_id", "kept"])

    of = {r["doc_id"]: np.frombuffer(r["kept"], np.int32) for r in marked.select("doc_id", "features").mapInArrow(numbered, "doc_id long, kept binary").collect()}
    row = np.repeat(np.arange(len(ids)), [len(of[i]) for i in ids])
    col = np.concatenate([of[i] for i in ids]) if ids else np.zeros(0, np.int32)
    weights, bias = fit_weights(row, col, names, y)
    return Model(table, weights, bias)


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """``docs`` without ``text``, with ``score`` and ``predicted``."""

    def start():
        one = model.scorer()

        def run(texts):
            out = [one(t) for t in texts]
            return [out, [int(s >= threshold) for s in out]]

        return run

    return map_texts(docs, start, "score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 3, held: int = 1, threshold: float = 0.7) -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted``.

    Learns only from rows outside the held-out fold. Defined cases: null and
    empty texts get the score of a text without evidence; null or repeated ids
    keep a row each (a doc with several labels counts as toxic if one says so);
    without labels of both classes every text scores 0.5; empty tables
    give an empty result; extra columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    held_out = crc_mod("doc_id", folds) == held
    model = fit(rows.filter(~held_out), labels.withColumnRenamed(id_col, "doc_id") if id_col != "doc_id" else labels)
    return score(rows.select("doc_id", held_out.alias("held_out"), "text"), model, threshold)


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` under the threshold, all columns kept.

    Defined cases: a null or empty text has the score of a text without
    evidence; null and repeated ids don't matter, each row is judged by its
    text; an empty table stays empty. Texts are read whole, a few MB at a time.
    """

    def start():
        score = model.scorer()
        return lambda text: score(text) < threshold

    return keep_texts(docs, start, text_col)
