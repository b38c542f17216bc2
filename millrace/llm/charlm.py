"""Character trigrams over 64 classes, counted with numpy.

Class 0 is everything that is not a letter. By default 1 to 26 are a to z, and
other letters share 27 to 63 by code point; ``learned_table`` gives the most
frequent letters of a corpus a class each instead. Counts and log probabilities
are arrays of 64^3 numbers whatever the corpus.
"""

from __future__ import annotations

import functools

import numpy as np

CLASSES = 64
CELLS = CLASSES**3


@functools.lru_cache(1)
def class_table() -> np.ndarray:
    """Code point -> class, for lower-cased text."""
    out = np.zeros(0x110000, np.uint8)
    letters = np.array([cp for cp in range(0x110000) if chr(cp).isalpha()], np.int64)
    out[letters] = 27 + (letters * 2654435761 >> 7) % (CLASSES - 27)
    for i in range(26):
        out[97 + i] = out[65 + i] = 1 + i
    return out


#: Letters with a class of their own in a learned alphabet; the rest share the classes above.
OWN = 47
CODES = 0x110000


def learned_table(counts: np.ndarray) -> np.ndarray:
    """Code point -> class, where ``counts`` (by code point) has the ``OWN`` most frequent letters, ties to the smaller."""
    out = class_table().copy()
    letters = np.flatnonzero(out)
    out[letters] = OWN + 1 + (letters * 2654435761 >> 7) % (CLASSES - OWN - 1)
    own = letters[np.lexsort((letters, -counts[letters]))][:OWN]
    own = own[counts[own] > 0]
    out[own] = 1 + np.arange(len(own))
    return out


def points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, two breaks between them, and each text's start."""
    joined = ("\n\n".join(texts) + "\n\n").lower()
    flat = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.array([len(t.lower()) if not t.isascii() else len(t) for t in texts], np.int64)
    return flat, np.concatenate([[0], np.cumsum(size + 2)[:-1]])


def trigrams(codes: np.ndarray) -> np.ndarray:
    """At each position the cell of (class two before, class before, class); what stands before a break is forgotten."""
    c = codes.astype(np.int32)
    b = np.concatenate([[0], c[:-1]])
    a = np.where(b == 0, 0, np.concatenate([[0, 0], c[:-2]]))
    return (a * CLASSES + b) * CLASSES + c


def counted(codes: np.ndarray) -> np.ndarray:
    """Counts of the cells at letters and at the break that ends a word."""
    t = trigrams(codes)
    inside = (codes != 0) | (np.concatenate([[0], codes[:-1]]) != 0)
    return np.bincount(t[inside], minlength=CELLS).astype(np.int64)


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """Natural log of the interpolated probability of the third class given the two before."""
    c3 = counts.reshape(CLASSES, CLASSES, CLASSES).astype(np.float64)
    c2 = c3.sum(axis=0)
    c1 = c2.sum(axis=0)
    p1 = (c1 + 0.5) / (c1.sum() + 0.5 * CLASSES)
    p2 = (c2 + 4 * p1) / (c2.sum(axis=1, keepdims=True) + 4)
    p3 = (c3 + 4 * p2[None]) / (c3.sum(axis=2, keepdims=True) + 4)
    return np.log(p3).ravel()
