"""Brown class-based bigram model: exchange clustering, class transitions, word emissions.

The whole training vocabulary has classes. The ``HEAD`` most frequent words (the
end of a text is one) are clustered by exchange: sweep by sweep, each word moves
to the class where the likelihood of the class bigrams gains most, given how
often each class stands before and after it. These counts come from a table of
all bigrams of the corpus, gathered once and aggregated where it lies; a sweep
needs a fixed number of them on the driver. Every other word goes to the class
that suits its own neighbours best. A text's probability is the product over its
tokens of

    (1 - kappa) P(class | class before) P(word | class)

for words seen in training, and kappa for the unknown word, which is one event;
kappa is the share of tokens of words seen once (Good-Turing). An unknown word
stands before others as all words outside the head do.

Counts cover the whole training corpus. Only the head travels to every task;
other words are exchanged: each map task sends, per hash bucket, one packed row
of its words with the classes around them; the bucket counts them, chooses
their classes, and sends both back to the task's texts.
"""

from __future__ import annotations

import pickle
from collections import Counter
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunked, crc_mod, packed, packed_numbers, slices, staged, summed_vector, unpacked, unpacked_numbers

#: Words that are clustered by exchange and known to every task.
HEAD = 16_384
CLASSES = 48
#: Sweeps end when the likelihood gains less than this part of itself.
TOLERANCE, MOST_SWEEPS = 2e-4, 20
END = b"\n"  # no word holds white space
#: Counters of words, as a power of two; the head is chosen among words in the heaviest ``HEAVY`` * head of them.
COUNTER_BITS, HEAVY = 22, 4
#: A task sends on what it counted after so many different words.
COUNTED_WORDS = 1_000_000
#: A task sends its words on after so many different ones outside the head, texts, or bigrams.
FLUSH_WORDS, FLUSH_TEXTS, FLUSH_BIGRAMS = 300_000, 20_000, 4_000_000
#: Training tokens per bucket of words.
BUCKET_TOKENS = 4_000_000
#: Words whose neighbours are counted at a time.
BLOCK_WORDS = 16_384
#: Codes of a token outside the head, and of an unknown one, in a sequence of classes.
TAIL, UNKNOWN = 255, 254


def words_of(text: str | None) -> list[bytes]:
    """Words in UTF-8, A-Z lower-cased, split at ASCII white space, then the end."""
    out = text.encode("utf-8", "replace").lower().split() if text else []
    out.append(END)
    return out


def head_words(docs: DataFrame, head: int = HEAD) -> tuple[list[bytes], np.ndarray]:
    """The end and the most frequent words, ties to the smaller; and their exact counts.

    Words fall into 2^``COUNTER_BITS`` counters by hash. Words of the heaviest
    counters are counted exactly, and the head is chosen from them: the same
    however the rows are dealt, and the exact head where the last chosen word is
    at least as frequent as the lightest of these counters.
    """
    cells = 1 << COUNTER_BITS
    cell = lambda w: xxhash.xxh3_64_intdigest(w) >> (64 - COUNTER_BITS)

    def counts(batches):
        count: Counter = Counter()
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                count.update(words_of(text))
            if len(count) > COUNTED_WORDS:
                yield count
                count = Counter()
        if count:
            yield count

    def heavy(batches):
        total = np.zeros(cells, np.int64)
        for count in counts(batches):
            at = np.fromiter(map(cell, count), np.int64, len(count))
            total += np.bincount(at, weights=np.fromiter(count.values(), np.float64, len(count)), minlength=cells).astype(np.int64)
        yield pa.RecordBatch.from_pandas(chunked(0, total), preserve_index=False)

    total = summed_vector(docs.select("text").mapInArrow(heavy, "key int, chunk int, data binary"), "key", cells, "int64").get(0, np.zeros(cells, np.int64))
    order = np.lexsort((np.arange(cells), -total))[: HEAVY * head]
    wanted = np.zeros(cells, bool)
    wanted[order[total[order] > 0]] = True
    bits = np.packbits(wanted)

    def exact(batches):
        chosen = np.unpackbits(bits)
        for count in counts(batches):
            at = np.fromiter(map(cell, count), np.int64, len(count))
            some = [(w, n) for (w, n), yes in zip(count.items(), chosen[at]) if yes]
            yield pa.RecordBatch.from_pydict({"word": [w for w, _ in some], "n": [n for _, n in some]}, schema=pa.schema([("word", pa.binary()), ("n", pa.int64())]))

    got = docs.select("text").mapInArrow(exact, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = {bytes(r["word"]): r["n"] for r in got.orderBy(F.desc("n"), "word").limit(head).collect()}
    ends = top.pop(END, 0)
    words = list(top)[: head - 1]
    return [END, *words], np.array([ends, *(top[w] for w in words)], np.int64)


def bigram_table(docs: DataFrame, words: list[bytes]) -> DataFrame:
    """``keys, counts``: packed bigrams of head words (a * (head + 1) + b; words outside are number head), each bigram in one row."""
    h = len(words)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        table = {w: i for i, w in enumerate(words)}
        held: list[np.ndarray] = []

        def flush():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            bucket = keys // (h + 1) % parts
            for b in np.unique(bucket).tolist():
                on = bucket == b
                yield pa.RecordBatch.from_pydict({"bucket": [b], "keys": [packed_numbers(np.diff(keys[on], prepend=0))], "counts": [packed_numbers(n[on])]}, schema=pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]))

        for batch in slices(batches):
            ids: list[int] = [0]
            for text in batch.column("text").to_pylist():
                ids += map(table.get, words_of(text), repeat(h))
            a = np.array(ids, np.int64)
            held.append(a[:-1] * (h + 1) + a[1:])
            if sum(map(len, held)) > FLUSH_BIGRAMS:
                yield from flush()
        if held:
            yield from flush()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([np.cumsum(unpacked_numbers(k).astype(np.int64)) for k in pdf["keys"]])
        counts = np.concatenate([unpacked_numbers(c).astype(np.int64) for c in pdf["counts"]])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return pd.DataFrame({"keys": [packed_numbers(np.diff(keys[first], prepend=0))], "counts": [packed_numbers(np.add.reduceat(counts, first))]})

    sent = docs.select("text").mapInArrow(run, "bucket int, keys binary, counts binary")
    return staged(sent.groupBy("bucket").applyInPandas(merge, "keys binary, counts binary"), "bigrams")


def neighbours(bigrams: DataFrame, of: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word how often each class stands after it, and before it, and how often it follows itself. ``of``: classes of the words, the last of all outside the head."""
    n, length = len(of), 2 * len(of) * classes + len(of)

    def run(batches):
        total = np.zeros(length, np.int64)
        for batch in batches:
            for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist()):
                a, b = np.divmod(np.cumsum(unpacked_numbers(keys).astype(np.int64)), n)
                times = unpacked_numbers(counts)
                for at, start in ((a * classes + of[b], 0), (b * classes + of[a], n * classes), (a[a == b], 2 * n * classes)):
                    total += np.bincount(at + start, weights=times if len(at) == len(times) else times[a == b], minlength=length).astype(np.int64)
        yield pa.RecordBatch.from_pandas(chunked(0, total), preserve_index=False)

    total = summed_vector(bigrams.mapInArrow(run, "key int, chunk int, data binary"), "key", length, "int64").get(0, np.zeros(length, np.int64)).astype(np.float64)
    return total[: n * classes].reshape(n, classes), total[n * classes : 2 * n * classes].reshape(n, classes), total[2 * n * classes :]


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(table: np.ndarray) -> float:
    """What of the log likelihood of the class bigrams depends on the classes."""
    return float(xlogx(table).sum() - xlogx(table.sum(axis=0)).sum() - xlogx(table.sum(axis=1)).sum())


def class_table(right: np.ndarray, of: np.ndarray, classes: int) -> np.ndarray:
    out = np.zeros((classes, classes))
    np.add.at(out, of, right)
    return out


def sweep(right: np.ndarray, left: np.ndarray, own: np.ndarray, of: np.ndarray, order: np.ndarray, classes: int, free: int) -> np.ndarray:
    """New classes: each word of ``order`` in turn goes to that of the first ``free`` classes where the likelihood is largest.

    Words' neighbours count by the classes they had when the sweep began.
    """
    of = of.copy()
    table = class_table(right, of, classes)
    fx = xlogx(table)
    for u in order.tolist():
        r, l, s, k = right[u], left[u], own[u], of[u]  # noqa: E741
        if not r.any() and not l.any():
            continue
        table[k, :] -= r
        table[:, k] -= l
        table[k, k] += s
        r0, l0 = r.copy(), l.copy()
        r0[k] -= s
        l0[k] -= s
        rows, cols = table.sum(axis=1) + l0, table.sum(axis=0) + r0  # u's neighbours stay where they are
        # gain of adding u to each class: its row, its column, the diagonal once, the margins
        fx[k, :], fx[:, k] = xlogx(table[k, :]), xlogx(table[:, k])
        gain = (xlogx(table + r0[None, :]) - fx).sum(axis=1) + (xlogx(table + l0[:, None]) - fx).sum(axis=0)
        d = np.diag(table)
        gain += xlogx(d + r0 + l0 + s) - xlogx(d + r0) - xlogx(d + l0) + xlogx(d)
        gain -= xlogx(rows + r0.sum() + s) - xlogx(rows) + xlogx(cols + l0.sum() + s) - xlogx(cols)
        best = int(gain[:free].argmax())
        if gain[best] <= gain[k] + 1e-9:
            best = int(k)
        table[best, :] += r0
        table[:, best] += l0
        table[best, best] += s
        fx[best, :], fx[:, best] = xlogx(table[best, :]), xlogx(table[:, best])
        of[u] = best
    return of


def exchange(count, n: int, frequency: np.ndarray, classes: int = CLASSES, tolerance: float = TOLERANCE, most: int = MOST_SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """(classes of n words, class bigram table); ``count`` gives ``neighbours`` for classes of the words and, after them, of all others.

    The others are a class of their own, the last. Words start by frequency
    rank. Sweeps go on until no word moves or the likelihood gains too little;
    the best classes count.
    """
    order = np.argsort(-frequency, kind="stable")
    of = np.empty(n + 1, np.int64)
    of[order] = np.arange(n) % classes
    of[n] = classes
    best, kept = -np.inf, None
    for _ in range(most):
        right, left, own = count(of)
        table = class_table(right, of, classes + 1)
        now = likelihood(table)
        if kept is None or now > best:
            gained, best, kept = now - best, now, (of.copy(), table)
        else:
            break
        if gained < tolerance * abs(best):
            break
        new = sweep(right, left, own, of, order, classes + 1, classes)
        if (new == of).all():
            break
        of = new
    return kept[0][:n], kept[1]


class Model:
    """The head's words, counts and classes, and how the others find theirs."""

    def __init__(self, head: list[bytes], counts: np.ndarray, of: np.ndarray, table: np.ndarray, classes: int = CLASSES):
        self.head, self.counts, self.of, self.classes = head, counts, of, classes
        smooth = table + (table.sum(axis=1, keepdims=True) + 1) * (table.sum(axis=0, keepdims=True) + 1) / (table.sum() + 1) * 1e-2
        self.after = np.log(smooth[:, :classes])  # class before, or others -> class
        self.before = np.log(smooth[:classes, :]).T  # class after, or others -> class
        self.margin_in, self.margin_out = np.log(smooth.sum(axis=0)[:classes]), np.log(smooth.sum(axis=1)[:classes])
        # the logarithms that a text's head words add
        self.log_count, self.log_base = np.log10(np.maximum(counts, 1)), np.log10(counts + 1)

    def choose(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The best class of words by how often each class (or another word, the last) stands before and after them: to first order the likelihood's gain."""
        gain = left @ self.after + right @ self.before - left.sum(axis=1, keepdims=True) * self.margin_in - right.sum(axis=1, keepdims=True) * self.margin_out
        return gain.argmax(axis=1)


def fit(train: DataFrame, head: int = HEAD, classes: int = CLASSES) -> Model:
    """Head words with exact counts, bigrams, exchange."""
    words, counts = head_words(train, head)
    bigrams = bigram_table(train, words)
    of, table = exchange(lambda c: neighbours(bigrams, c, classes + 1), len(words), counts, classes)
    return Model(words, counts, of, table, classes)


class Postings:
    """A map task's words outside the head by bucket, and its texts as sequences of classes."""

    def __init__(self, model: Model, buckets: int, source: int):
        self.m, self.buckets, self.source, self.flushes = model, buckets, source, 0
        self.reset()

    def reset(self) -> None:
        self.table = {w: i for i, w in enumerate(self.m.head)}
        self.tail: list[bytes] = []
        self.texts: list[tuple] = []
        self.n = 0

    def add(self, doc_ids: pa.Array, train: list[bool], texts: list[str | None]) -> None:
        m, h = self.m, len(self.m.head)
        table, tail = self.table, self.tail
        ids: list[int] = []
        size = []
        for text in texts:
            words = words_of(text)
            for w in set(words).difference(table):
                table[w] = h + len(tail)
                tail.append(w)
            size.append(len(words))
            ids += map(table.__getitem__, words)
        a, size = np.array(ids, np.int64), np.array(size, np.int64)
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        is_head = a < h
        inner = np.where(is_head, a, 0)
        cls = np.where(is_head, np.where(m.counts > 0, m.of, UNKNOWN)[inner], TAIL).astype(np.uint8)
        total = lambda x: np.add.reduceat(np.where(is_head, x, 0), start)
        self.texts.append((doc_ids, np.array(train, bool), size, cls, a[~is_head] - h, total(m.counts[inner] > 0), total(m.log_base[inner]), total(m.log_count[inner])))
        self.n += len(texts)

    def full(self) -> bool:
        return len(self.tail) > FLUSH_WORDS or self.n > FLUSH_TEXTS

    def flush(self):
        """Rows (bucket, source, data): bucket -1 holds the texts, the others words with the classes around them in training texts."""
        if not self.n:
            return
        source = (self.source << 24) + self.flushes
        self.flushes += 1
        cols = list(zip(*self.texts))
        ids = pa.concat_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols[0]])
        train, size, cls, tail, known, base, own = (np.concatenate(c) for c in cols[1:])
        yield -1, source, packed(pickle.dumps((ids.to_pandas(integer_object_nulls=True).tolist(), train, size, known.astype(np.int64), base, own, packed_numbers(cls), packed_numbers(tail))))
        # around each word of a training text: the class before (the end before a text), the class after (the text's own end has none)
        at = np.flatnonzero(cls == TAIL)
        learns = np.repeat(train, size)[at]
        at, word = at[learns], tail[learns]
        state = np.where(cls >= UNKNOWN, self.m.classes, cls).astype(np.uint8)
        before = np.concatenate([[self.m.of[0]], state[:-1]])[at]  # a text's last token is the end, which starts the next
        after = state[at + 1]
        times = np.bincount(word, minlength=len(self.tail))
        bucket = np.array([xxhash.xxh3_64_intdigest(w) % self.buckets for w in self.tail], np.int64)
        order = np.argsort(bucket, kind="stable")  # words by bucket
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        sides = []
        for x in (before, after):
            s = np.lexsort((x, place[word]))
            sides.append(x[s].astype(np.uint8))
        edges = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        upto = np.concatenate([[0], np.cumsum(times[order])])
        for b in np.flatnonzero(np.diff(edges)).tolist():
            some = order[edges[b] : edges[b + 1]]
            part = slice(upto[edges[b]], upto[edges[b + 1]])
            yield b, source, packed(pickle.dumps((b"\n".join(self.tail[i] for i in some.tolist()), packed_numbers(some), packed_numbers(times[some]), sides[0][part].tobytes(), sides[1][part].tobytes()), protocol=5))
        self.reset()


def count_bucket(blobs: list[tuple[int, bytes]], model: Model) -> tuple[int, int, int, list[tuple[int, bytes]]]:
    """(seen words, words seen once, tokens, each source's words with their counts and classes) of one bucket."""
    index: dict[bytes, int] = {}
    loaded = []
    for source, data in blobs:
        words, local, times, before, after = pickle.loads(unpacked(data))
        number = np.array([index.setdefault(w, len(index)) for w in words.split(b"\n")], np.int64)
        loaded.append((source, number, local, unpacked_numbers(times).astype(np.int64), np.frombuffer(before, np.uint8), np.frombuffer(after, np.uint8)))
    word = np.concatenate([np.repeat(number, times) for _, number, _, times, _, _ in loaded])
    count = np.bincount(word, minlength=len(index))
    order = np.argsort(word, kind="stable")
    word = word[order]
    sides = [np.concatenate([x[i] for x in loaded])[order] for i in (4, 5)]
    of = np.zeros(len(index), np.uint8)
    k = model.classes + 1
    for at in range(0, len(index), BLOCK_WORDS):
        n = min(BLOCK_WORDS, len(index) - at)
        a, b = np.searchsorted(word, [at, at + n])
        left, right = (np.bincount((word[a:b] - at) * k + x[a:b], minlength=n * k).reshape(n, k) for x in sides)
        of[at : at + n] = model.choose(left, right)
    out = [(source, packed(pickle.dumps((local, packed_numbers(count[number]), of[number].tobytes()), protocol=5))) for source, number, local, *_ in loaded]
    return int((count > 0).sum()), int((count == 1).sum()), int(count.sum()), out


RESOLVED = "train boolean, doc_id long, classes binary, known long, base double, own double"


def transitions(resolved: DataFrame, classes: int, start: int) -> tuple[np.ndarray, np.ndarray]:
    """(class bigrams of the training texts, the last row for unknown words and those outside the head; tokens of each class)."""
    length = (classes + 1) * classes + classes

    def run(batches):
        total = np.zeros(length, np.int64)
        for batch in batches:
            for train, data in zip(batch.column("train").to_pylist(), batch.column("classes").to_pylist()):
                if train:
                    c, outside = sequence(data)
                    before = np.concatenate([[start], c[:-1]])
                    total += np.bincount(before * classes + c, minlength=length)
                    total += np.bincount(classes * classes + c[1:][outside[:-1]], minlength=length)
                    total += np.bincount((classes + 1) * classes + c, minlength=length)
        yield pa.RecordBatch.from_pandas(chunked(0, total), preserve_index=False)

    total = summed_vector(resolved.select("train", "classes").mapInArrow(run, "key int, chunk int, data binary"), "key", length, "int64").get(0, np.zeros(length, np.int64))
    return total[: (classes + 1) * classes].reshape(classes + 1, classes), total[(classes + 1) * classes :]


def sequence(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(classes of a text's tokens, ``UNKNOWN`` for unknown ones; which are outside the head)."""
    codes = np.frombuffer(data, np.uint8).astype(np.int64)
    outside = codes >= 128
    return np.where(codes >= UNKNOWN, UNKNOWN, codes & 127), outside


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2, head: int = HEAD, classes: int = CLASSES) -> DataFrame:
    """One row per input row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` (log10 probabilities).

    Learns from the rows outside the held-out fold. Defined cases: a null text
    is empty and has the end as its only token; null or repeated ids keep a row
    each (and repeated rows count in training as often as they occur); without
    training rows every word is unknown, ``train_tokens`` is 0 and scores stay
    finite; an empty table gives an empty result; extra columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("train", crc_mod("doc_id", folds) != held)
    model = fit(rows.filter("train"), head, classes)
    n_head = int(model.counts.sum())
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_head // BUCKET_TOKENS))

    def run(batches):
        out = Postings(model, buckets, TaskContext.get().partitionId())

        def batch_of(made):
            cols = list(zip(*made))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], names=["bucket", "source", "data"])

        for batch in slices(batches, most=2_000_000):
            out.add(batch.column("doc_id"), batch.column("train").to_pylist(), batch.column("text").to_pylist())
            if out.full():
                yield batch_of(out.flush())
        if out.n:
            yield batch_of(out.flush())

    sent = staged(rows.mapInArrow(run, "bucket int, source long, data binary"), "postings")

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        seen, once, tokens, parts = count_bucket(list(zip(pdf["source"], pdf["data"])), model)
        zeros = [0] * (len(parts) - 1)
        return pd.DataFrame(parts, columns=["source", "data"]).assign(seen=[seen, *zeros], once=[once, *zeros], tokens=[tokens, *zeros])

    back = staged(sent.filter("bucket >= 0").groupBy("bucket").applyInPandas(count, "source long, data binary, seen long, once long, tokens long"), "words")
    total = back.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("seen", "once", "tokens")]).first()
    n, v = n_head + total["tokens"], int((model.counts > 0).sum()) + total["seen"]
    per_token = np.log10(n + v + 1)

    def resolve(pdf: pd.DataFrame) -> pd.DataFrame:
        """A source's texts, each a row: classes with a high bit outside the head, sums of logarithms."""
        ids, train, size, known, base, own, cls, tail = pickle.loads(unpacked(pdf.loc[pdf["kind"] == 0, "data"].iloc[0]))
        cls, tail = unpacked_numbers(cls).astype(np.uint8), unpacked_numbers(tail).astype(np.int64)
        words = int(tail.max(initial=-1)) + 1
        count, of = np.zeros(words, np.int64), np.zeros(words, np.uint8)
        for data in pdf.loc[pdf["kind"] == 1, "data"]:
            local, c, o = pickle.loads(unpacked(data))
            local = unpacked_numbers(local)
            count[local], of[local] = unpacked_numbers(c), np.frombuffer(o, np.uint8)
        stop = np.cumsum(size)
        at = np.flatnonzero(cls == TAIL)
        text = np.searchsorted(stop, at, side="right")
        c = count[tail]
        cls[at] = np.where(c > 0, of[tail] | 128, TAIL)
        add = lambda x: np.bincount(text, weights=x, minlength=len(ids))
        return pd.DataFrame({
            "train": train, "doc_id": pd.array(ids, dtype="Int64"), "classes": [cls[b - a : b].tobytes() for a, b in zip(size.tolist(), stop.tolist())],
            "known": known + add(c > 0).astype(np.int64), "base": base + add(np.log10(c + 1)), "own": own + add(np.log10(np.maximum(c, 1))),
        })

    texts = sent.filter("bucket = -1").select("source", "data", F.lit(0).alias("kind"))
    sums = back.select("source", "data", F.lit(1).alias("kind"))
    resolved = staged(texts.unionByName(sums).groupBy("source").applyInPandas(resolve, RESOLVED), "resolved")
    pairs, tokens = transitions(resolved, classes, int(model.of[0]))
    prior = tokens / max(1, tokens.sum())
    with np.errstate(divide="ignore", invalid="ignore"):  # classes without a word never occur
        move = np.log10((pairs + 2 * prior) / (pairs.sum(axis=1, keepdims=True) + 2)) - np.log10(tokens)
    once = int((model.counts == 1).sum()) + total["once"]
    kappa = (once + 1) / (n + 2)
    unknown, again = float(np.log10(kappa)), float(np.log10(1 - kappa))
    start = int(model.of[0])

    def finish(batches):
        for batch in batches:
            size, score = [], []
            for data in batch.column("classes").to_pylist():
                c, _ = sequence(data)
                before = np.concatenate([[start], c[:-1]])
                seen = c != UNKNOWN
                score.append(float(move[np.where(before[seen] == UNKNOWN, classes, before[seen]), c[seen]].sum()) + again * int(seen.sum()) + unknown * int((~seen).sum()))
                size.append(len(c))
            size, score = np.array(size, np.int64), np.array(score)
            held_out = pa.array([not t for t in batch.column("train").to_pylist()], pa.bool_())
            base, own = batch.column("base").to_numpy() - size * per_token, batch.column("own").to_numpy() + score
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), held_out, pa.array(size), batch.column("known"), pa.array(np.full(len(size), n, np.int64)), pa.array(base), pa.array(own)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return resolved.mapInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
