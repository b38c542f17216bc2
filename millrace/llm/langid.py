"""Language identification of mixed text.

The most frequent letters of the training documents get a class each, and
classes are counted by language in trigrams over all training documents. A
word's script (Unicode ranges) narrows its candidate languages to those that
write it, and it is scored in these only: the log probability of its letters.
Viterbi with a switching penalty labels the words of a document, so that spans
of another language show up; the label with the most letters names the document.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import charlm
from .common import chunked, crc_mod, map_texts, slices, summed_vector

#: Natural log of the odds that a word's language differs from the word before.
SWITCH = 12.0
#: A language writes a script if so much of its letters are in it.
SCRIPT_SHARE = 0.001
#: Languages that are learned: the most frequent ones, so that a column of dirty values has a bound; each is a table of 64^3 numbers.
MOST_LANGS = 128
#: The score of a word in a language that is no candidate.
NEVER = np.float32(-1e9)

# First and last code point of the blocks of each script; other letters are script 0.
SCRIPTS = [
    (0x0041, 0x024F), (0x1E00, 0x1EFF),  # Latin
    (0x0370, 0x03FF),  # Greek
    (0x0400, 0x052F),  # Cyrillic
    (0x0530, 0x058F),  # Armenian
    (0x0590, 0x05FF),  # Hebrew
    (0x0600, 0x077F),  # Arabic
    (0x0900, 0x097F),  # Devanagari
    (0x0980, 0x09FF),  # Bengali
    (0x0B80, 0x0BFF),  # Tamil
    (0x0E00, 0x0E7F),  # Thai
    (0x10A0, 0x10FF),  # Georgian
    (0x3040, 0x30FF),  # Kana
    (0x3400, 0x9FFF),  # Han
    (0xAC00, 0xD7AF),  # Hangul
]
N_SCRIPTS = len(SCRIPTS) + 1


@functools.lru_cache(1)
def script_table() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    for i, (a, b) in enumerate(SCRIPTS):
        out[a : b + 1] = 1 if a == 0x1E00 else i + 1
    return out


class Words:
    """The words of a list of texts: maximal runs of letters."""

    def __init__(self, texts: list[str], classes: np.ndarray):
        flat, at = charlm.points(texts)
        self.codes = classes[flat]
        letter = self.codes != 0
        edge = np.diff(letter.astype(np.int8), prepend=0)
        self.start = np.flatnonzero(edge == 1)
        self.letters = np.flatnonzero(edge == -1) - self.start
        self.script = script_table()[flat[self.start]]
        self.doc = np.searchsorted(at, self.start, side="right") - 1


def viterbi(scores: np.ndarray, doc: np.ndarray, n_docs: int, switch: float = SWITCH) -> np.ndarray:
    """The best label of each word; ``scores`` is (words, labels), ``doc`` non-decreasing.

    All documents advance word by word together, the longest first.
    """
    n, labels = scores.shape
    out = np.zeros(n, np.int16)
    if not n or labels == 1:
        return out
    size = np.bincount(doc, minlength=n_docs)
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    order = np.argsort(-size, kind="stable")
    size, first = size[order], first[order]
    steps = int(size[0])
    active = np.searchsorted(-size, -np.arange(steps), side="left")  # documents with more than t words
    back = np.empty((n, labels), np.bool_)
    jump = np.zeros(n, np.int16)
    best = scores[first[: active[0]]].astype(np.float64)
    finals = np.zeros(n_docs, np.int64)
    for t in range(1, steps):
        m = active[t]
        if m < len(best):
            finals[m : len(best)] = best[m:].argmax(axis=1)
            best = best[:m]
        at = first[:m] + t
        top = best.argmax(axis=1)
        moved = best[np.arange(m), top] - switch
        stay = best >= moved[:, None]
        back[at] = stay
        jump[at] = top
        best = np.where(stay, best, moved[:, None]) + scores[at]
        best -= best.max(axis=1, keepdims=True)
    finals[: len(best)] = best.argmax(axis=1)
    label = finals
    for t in range(steps - 1, -1, -1):
        m = active[t]
        at = first[:m] + t
        out[at] = label[:m]
        if t:
            label[:m] = np.where(back[at, label[:m]], label[:m], jump[at])
    return out


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray, classes: np.ndarray):
        """counts: (languages, cells); scripts: (languages, scripts) letters; classes: code point -> class."""
        self.langs, self.classes = langs, classes
        self.tables = [charlm.log_probabilities(c).astype(np.float32) for c in counts]
        self.writes = scripts >= np.maximum(1, SCRIPT_SHARE * scripts.sum(axis=1, keepdims=True))
        self.writes[:, ~self.writes.any(axis=0)] = True  # nobody's script: all stay candidates

    def word_scores(self, words: Words) -> np.ndarray:
        """(words, languages): scores in the candidates of each word's script, ``NEVER`` in others."""
        cells = charlm.trigrams(words.codes)
        out = np.full((len(words.start), len(self.langs)), NEVER, np.float32)
        for script in np.flatnonzero(np.bincount(words.script, minlength=N_SCRIPTS)).tolist():
            mine = np.flatnonzero(words.script == script)
            size = words.letters[mine] + 1  # the letters, and the break that ends the word
            edge = np.concatenate([[0], np.cumsum(size)[:-1]])
            at = cells[np.repeat(words.start[mine] - edge, size) + np.arange(int(size.sum()))]
            for i in np.flatnonzero(self.writes[:, script]).tolist():
                out[mine, i] = np.add.reduceat(self.tables[i][at], edge)
        return out

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(first word, end, language) of each run of words with one label."""
        words = Words([text], self.classes)
        if not len(words.start):
            return []
        label = viterbi(self.word_scores(words), words.doc, 1)
        cut = np.concatenate([[0], np.flatnonzero(np.diff(label)) + 1, [len(label)]])
        return [(int(a), int(b), self.langs[label[a]]) for a, b in zip(cut, cut[1:])]

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        words = Words(texts, self.classes)
        if not self.langs or not len(words.start):
            return ["und"] * len(texts), [0.0] * len(texts)
        label = viterbi(self.word_scores(words), words.doc, len(texts))
        letters = np.zeros((len(texts), len(self.langs)))
        np.add.at(letters, (words.doc, label), words.letters)
        total, best = letters.sum(axis=1), letters.argmax(axis=1)
        share = letters[np.arange(len(texts)), best] / np.maximum(total, 1)
        return [self.langs[b] if t else "und" for b, t in zip(best, total)], share.tolist()


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", most_langs: int = MOST_LANGS) -> Model:
    """Counts all rows of ``docs`` that have a language and a text.

    Learns the ``most_langs`` most frequent languages, ties to the first in
    sorted order; rows of any others are as if they had none. What leaves a task
    is the counts of letters, then for each language it saw the non-empty chunks
    of one array of cells: their size depends on the number of languages, not of
    rows. An empty table gives a model that finds nothing.
    """
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang is not null and text is not null")
    langs = sorted(r["lang"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs).collect())
    number = {lang: i for i, lang in enumerate(langs)}
    rows = rows.filter(F.col("lang").isin(langs)) if langs else rows
    length = charlm.CELLS + N_SCRIPTS

    def letters(batches):
        total = np.zeros(charlm.CODES, np.int64)
        for batch in slices(batches):
            flat, _ = charlm.points(batch.column("text").to_pylist())
            counts = np.bincount(flat)
            total[: len(counts)] += counts
        total[charlm.class_table() == 0] = 0
        yield pa.RecordBatch.from_pandas(chunked(0, total), preserve_index=False)

    schema = "key int, chunk int, data binary"
    seen = summed_vector(rows.select("text").mapInArrow(letters, schema), "key", charlm.CODES, "int64").get(0, np.zeros(charlm.CODES, np.int64))
    classes = charlm.learned_table(seen)

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in slices(batches):
            by: dict[str, list[str]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                flat, _ = charlm.points(texts)
                codes = classes[flat]
                mine = total.setdefault(number[lang], np.zeros(length, np.int64))
                mine[: charlm.CELLS] += charlm.counted(codes)
                mine[charlm.CELLS :] += np.bincount(script_table()[flat[codes != 0]], minlength=N_SCRIPTS)
        for key, vector in total.items():
            yield pa.RecordBatch.from_pandas(chunked(key, vector), preserve_index=False)

    got = summed_vector(rows.mapInArrow(run, schema), "key", length, "int64")
    counts = np.stack([got.get(i, np.zeros(length, np.int64)) for i in range(len(langs))]) if langs else np.zeros((0, length), np.int64)
    return Model(langs, counts[:, : charlm.CELLS], counts[:, charlm.CELLS :], classes)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` (its column ``text_col`` as ``text``, dropped) with ``lang_pred`` and ``score``.

    Defined cases: null texts and texts without a letter are ``und`` with score
    0, as is all if the model knows no language; ids don't matter; an empty
    table gives an empty result.
    """

    def start():
        def run(texts):
            return model.predict([t or "" for t in texts])

        return run

    return map_texts(docs.withColumnRenamed(text_col, "text") if text_col != "text" else docs, start, "lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held: int = 2) -> DataFrame:
    """One row per input row: ``doc_id, held_out, lang_pred, score``.

    Learns only from rows outside the held-out fold with a language. ``score``
    is the part of the letters in spans of the predicted language. Defined
    cases: null texts and texts without a letter are ``und`` with score 0, as is
    everything if no training row has a language; null or repeated ids keep a
    row each; ties go to the first language in sorted order; an empty table
    gives an empty result; extra columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    held_out = crc_mod("doc_id", folds) == held
    model = fit(rows.filter(~held_out))
    return predict(rows.select("doc_id", held_out.alias("held_out"), "text"), model)
