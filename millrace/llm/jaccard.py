"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is its set of distinct shingles (64-bit hashes of word n-grams; all
counts here are of hashes), in one global order: rare first, by a frequency
sketch whose size follows the corpus. With threshold t, two sets that link share
at least l of their first |s| - ceil(t |s|) + l shingles, for any l. Each
document chooses its l: a longer prefix meets more lists but asks for more
matches. It takes the l of least estimated cost (lists scanned, plus candidates
that remain after asking for l matches, times the cost to verify them). What a
pair must share in its prefixes follows from how far both prefixes reach in the
global order: the overlap that a link needs, less what the rest of the smaller
side could still add; that is l or more.

1. Equal sets collapse to a class (128-bit digest of the sorted hashes).
2. Prefix shingles meet in hash buckets. A shingle shared by several classes
   puts them under the smallest of them, its leader. Sizes fall into classes
   that sets of linked documents never differ by more than one in, so leaders
   are chosen within two neighbouring size classes; where, in order of size, the
   next set is too large to link with the one before, a new leader begins.
   (leader, member) rows are distinct, so sixty shared shingles make one row.
3. Members meet their leader, with prefixes only; whole sets follow for those
   whose prefixes share enough. A group of m near copies costs m comparisons.
4. Members that are not yet connected with their leader meet the leader's other
   members in blocks, pairs of one component left out: again prefixes first,
   then whole sets of the documents that still have a partner, verified by exact
   counts. What leaves a block is a spanning star of what is linked.
5. Stars contract to components, distributed.

A very frequent prefix shingle (estimate above ``HOT``) skips step 2's grouping:
its members go under it directly, so that no task holds its list.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, chunked, cut, packed, slices, small_batches, staged, summed_vector, unpacked, without
from .components import components

#: Least and most counters of the sketch, as powers of two; two bytes each travel to every task.
SKETCH_BITS = (16, 22)
#: Characters of text for a counter.
SKETCH_CHARS = 8
#: Most bits of the filter of wanted texts, as a power of two; beyond it the filter lets more through, and the join decides.
BLOOM_BITS = 28
MOST_MATCHES = 8
#: Documents of a block; members of a leader that one task compares with it.
BLOCK, STAR = 256, 512
HOT = 1 << 18
#: Prefix shingles of a bucket, on average.
BUCKET_TOKENS = 500_000
#: A task sends its prefixes on after so many.
FLUSH_TOKENS = 1_000_000
TABLE_ENTRIES = 200_000
#: Bytes of a class's digest that name it in a bucket, and how a shingle is cut there. Where only the rest differs, more documents meet.
NAME, SHORT = 8, np.uint32

K1, K2, K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class Shingler:
    """text -> sorted distinct shingle hashes; holds the task's table of word hashes."""

    def __init__(self, size: int = 3):
        self.size = size
        self.table: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "replace").lower().split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        table = self.table
        if len(table) > TABLE_ENTRIES:
            table.clear()
        for w in set(words).difference(table):
            table[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(table.__getitem__, words), np.uint64, len(words))
        n = self.size
        if len(words) < n:
            return np.array([xxhash.xxh3_64_intdigest(b"\n".join(words), seed=1)], np.uint64)
        x = np.zeros(len(words) - n + 1, np.uint64)
        for i in range(n):  # a polynomial in K1, then mixed
            x = x * K1 + (h[i : len(words) - n + 1 + i] ^ K3)
        x ^= x >> np.uint64(29)
        x *= K2
        x ^= x >> np.uint64(32)
        return np.unique(x)


def signature(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def need(n: int, percent: int) -> int:
    """The least overlap of a set of n with any set that it links to."""
    return -(-percent * n // 100)


class Order:
    """The global order and the choice of l. ``levels``: the sketch's counts, exact up to 4096, then 1024 steps a power of two."""

    EXACT, STEPS = 4096, 1024
    #: Level -> count.
    VALUES = np.concatenate([np.arange(EXACT), EXACT * 2.0 ** (np.arange(65_536 - EXACT) / STEPS)])

    def __init__(self, levels: np.ndarray, noise: float, percent: int):
        self.levels, self.noise, self.percent = levels, noise, percent
        self.mask = np.uint64(len(levels) - 1)

    @classmethod
    def levels_of(cls, counts: np.ndarray) -> np.ndarray:
        return np.where(counts < cls.EXACT, counts, cls.EXACT + cls.STEPS * np.log2(np.maximum(counts, cls.EXACT) / cls.EXACT)).astype(np.uint16)

    def level(self, shingles: np.ndarray) -> np.ndarray:
        return self.levels[(shingles & self.mask).astype(np.int64)]

    def frequency(self, level: np.ndarray) -> np.ndarray:
        """Documents with a shingle: its counter, less what others add to a counter on average."""
        return np.maximum(1.0, self.VALUES[level] - self.noise)

    def prefix(self, shingles: np.ndarray) -> tuple[np.ndarray, int]:
        """(the first shingles in the global order, l)."""
        n = len(shingles)
        first = n - need(n, self.percent) + 1
        most = min(n, first - 1 + MOST_MATCHES)
        level = self.level(shingles)
        # the most rarest first: only levels up to that of the last one matter
        if most < n:
            edge = np.partition(level, most - 1)[most - 1]
            some = np.flatnonzero(level <= edge)
            order = some[np.lexsort((shingles[some], level[some]))][:most]
        else:
            order = np.lexsort((shingles, level))
        scanned = np.cumsum(self.frequency(level[order]) - 1)
        at = np.arange(first - 1, most)
        cost = scanned[at] + n * scanned[at] / (at - first + 2)
        best = int(cost.argmin())
        return shingles[order[: first + best]], best + 1


def sketch(docs: DataFrame, shingle_words: int, percent: int) -> tuple[Order, int]:
    """The order, from bucket counts of all documents' shingles; and about how many shingles there are."""
    chars = docs.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    size = 1 << min(SKETCH_BITS[1], max(SKETCH_BITS[0], (chars // SKETCH_CHARS).bit_length()))

    def run(batches):
        shingler, total = Shingler(shingle_words), np.zeros(size, np.int32)
        held: list[np.ndarray] = []

        def add():
            np.add.at(total, (np.concatenate(held) & np.uint64(size - 1)).astype(np.int64), 1)
            held.clear()

        for batch in slices(batches):
            held += [shingler(t) for t in batch.column("text").to_pylist()]
            if sum(map(len, held)) > FLUSH_TOKENS:
                add()
        if held:
            add()
        yield pa.RecordBatch.from_pandas(chunked(0, total), preserve_index=False)

    parts = docs.select("text").mapInArrow(run, "key int, chunk int, data binary")
    levels = summed_vector(parts, "key", size, "int64", finish=Order.levels_of, finished="uint16").get(0, np.zeros(size, np.uint16))
    total = int(sum(Order.VALUES[levels[at : at + (1 << 20)]].sum() for at in range(0, size, 1 << 20)))
    return Order(levels, total / size, percent), total


ROWS = "bucket int, doc_id long, n long, sig binary, key long, data binary"


def _rows(bucket: list[int], doc_id=None, n=None, sig=None, key=None, data=None) -> pa.RecordBatch:
    none = [None] * len(bucket)
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary())
    columns = [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(none if x is None else x, t) for x, t in zip((doc_id, n, sig, key, data), kinds)]
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), *columns], names=["bucket", "doc_id", "n", "sig", "key", "data"])


def prefixes(docs: DataFrame, order: Order, shingle_words: int, buckets: int, hot: int) -> DataFrame:
    """Of ``doc_id, text, key`` (a hash of the text), four kinds of rows.

    Bucket -1: a document's id, set size, class and key. Bucket -2: a hot shingle
    (data) and a member. Bucket -3: a class with its size, the key of a text of
    it, and its prefix in order. Others: the prefix shingles of a bucket, packed;
    with many buckets hardly two shingles there share a class's name, so names
    and shingles are cut short.
    """

    def run(batches):
        shingler = Shingler(shingle_words)
        sigs: dict[bytes, int] = {}
        tokens: list[np.ndarray] = []
        lengths: list[int] = []
        keys: list[int] = []
        size = 0

        def flush():
            names = list(sigs)
            yield _rows([-3] * len(names), n=lengths, sig=names, key=keys, data=[t.tobytes() for t in tokens])
            both = np.concatenate(tokens)
            owner = np.repeat(np.arange(len(tokens), dtype=np.int32), [len(t) for t in tokens])
            sizes = np.array(lengths, np.int64)
            flat = np.frombuffer(b"".join(names), np.uint8).reshape(-1, 16)
            burning = order.frequency(order.level(both)) > hot
            if burning.any():
                yield _rows([-2] * int(burning.sum()), sig=[names[o] for o in owner[burning]], data=[t.tobytes() for t in both[burning]])
                both, owner = both[~burning], owner[~burning]
            bucket = ((both >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            sort = np.argsort(bucket, kind="stable")
            both, owner = both[sort], owner[sort]
            edges = np.searchsorted(bucket[sort], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(edges)).tolist():
                part = slice(edges[b], edges[b + 1])
                used, of = np.unique(owner[part], return_inverse=True)
                yield _rows([b], data=[packed(np.int64(len(used)).tobytes() + flat[used, :NAME].tobytes() + sizes[used].tobytes() + of.astype(np.int32).tobytes() + both[part].astype(SHORT).tobytes())])

        for batch in slices(batches):
            n, sig = [], []
            for text, key in zip(batch.column("text").to_pylist(), batch.column("key").to_pylist()):
                s = shingler(text)
                n.append(len(s))
                sig.append(signature(s))
                if len(s) and sig[-1] not in sigs:
                    sigs[sig[-1]] = len(sigs)
                    tokens.append(order.prefix(s)[0])
                    lengths.append(len(s))
                    keys.append(key)
                    size += len(tokens[-1])
            yield _rows([-1] * len(n), batch.column("doc_id"), n, sig, batch.column("key"))
            if size > FLUSH_TOKENS:
                yield from flush()
                sigs, tokens, lengths, keys, size = {}, [], [], [], 0
        if tokens:
            yield from flush()

    return docs.mapInArrow(run, ROWS)


def lead(blobs: list[bytes], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(leaders, members) as arrays of ``NAME`` bytes, distinct, of one bucket's shingles that several classes share."""
    names, sizes, owner, tokens, base = [], [], [], [], 0
    for blob in map(unpacked, blobs):
        k = int(np.frombuffer(blob, np.int64, 1)[0])
        names.append(np.frombuffer(blob, ">u8", k, 8))
        sizes.append(np.frombuffer(blob, np.int64, k, 8 + NAME * k))
        at = 8 + (NAME + 8) * k
        m = (len(blob) - at) // (4 + SHORT().nbytes)
        owner.append(np.frombuffer(blob, np.int32, m, at) + base)
        tokens.append(np.frombuffer(blob[at + 4 * m :], SHORT))
        base += k
    # by size too, so that no class takes the place of another that differs in it
    both = np.stack([np.concatenate(names).astype(np.uint64), np.concatenate(sizes).astype(np.uint64)], axis=1)
    distinct, number = np.unique(both, axis=0, return_inverse=True)
    n = distinct[:, 1].astype(np.int64)
    token, who = np.concatenate(tokens), number.reshape(-1)[np.concatenate(owner)]
    # a class is a hair wider than the ratio, so rounding never puts a linked pair two classes apart
    level = np.floor(np.log(np.maximum(n, 1)) / (np.log(100 / percent) * (1 + 1e-9) if percent < 100 else 1e-9)).astype(np.int64)[who]
    token, who, level = np.concatenate([token, token]), np.concatenate([who, who]), np.concatenate([level, level + 1])
    sort = np.lexsort((who, n[who], level, token))
    token, who, level = token[sort], who[sort], level[sort]
    starts = np.concatenate([[True], (token[1:] != token[:-1]) | (level[1:] != level[:-1])])
    fresh = starts | np.concatenate([[True], who[1:] != who[:-1]])
    token, who, starts = token[fresh], who[fresh], starts[fresh]
    size = n[who]
    starts |= np.concatenate([[True], 100 * size[:-1] < percent * size[1:]])
    group = np.cumsum(starts) - 1
    several = np.bincount(group)[group] > 1
    leader = np.minimum.reduceat(who, np.flatnonzero(starts))[group]
    pairs = np.unique(leader[several].astype(np.int64) * len(distinct) + who[several])
    named = np.unique(np.stack([distinct[pairs // len(distinct), 0], distinct[pairs % len(distinct), 0]], axis=1), axis=0).astype(">u8").view(np.uint8)
    return named[:, :NAME], named[:, NAME:]


def overlaps(doc: np.ndarray, token: np.ndarray, left: np.ndarray, right: np.ndarray, k: int, width: int = 8192) -> np.ndarray:
    """How many tokens (numbered from 0) each of ``left`` shares with each of ``right``, documents of k: products of slices of the incidence matrices."""
    out = np.zeros((len(left), len(right)), np.int64)
    if not len(doc):
        return out
    row = [np.full(k, -1), np.full(k, -1)]
    row[0][left], row[1][right] = np.arange(len(left)), np.arange(len(right))
    top = int(token.max()) + 1
    there = [np.bincount(token[r[doc] >= 0], minlength=top) > 0 for r in row]
    both = there[0] & there[1]
    number, on = np.cumsum(both) - 1, both[token]
    doc, token = doc[on], number[token[on]]
    sort = np.argsort(token, kind="stable")
    doc, token = doc[sort], token[sort]
    for at in range(0, int(both.sum()), width):
        a, b = np.searchsorted(token, [at, at + width])
        sides = []
        for r, n in zip(row, out.shape):
            m = np.zeros((n, width), np.float32)
            who = r[doc[a:b]]
            m[who[who >= 0], token[a:b][who >= 0] - at] = 1
            sides.append(m)
        out += (sides[0] @ sides[1].T).astype(np.int64)
    return out


def promising(prefix: list[np.ndarray], n: np.ndarray, left: np.ndarray, right: np.ndarray, order: Order) -> np.ndarray:
    """Which of ``left`` x ``right`` may link: their prefixes share what a link needs, less what may still come.

    Up to where the shorter-reaching of two prefixes ends in the global order,
    both sets are known; beyond, the smaller rest bounds what they share. A
    prefix that is the whole set reaches to the end.
    """
    k, percent = len(prefix), order.percent
    size = np.array([len(p) for p in prefix])
    token = np.concatenate(prefix)
    level = order.level(token)
    sort = np.lexsort((token, level))
    rank = np.empty(len(token), np.int64)
    rank[sort] = np.cumsum(np.concatenate([[False], token[sort][1:] != token[sort][:-1]]))
    stop = np.cumsum(size)
    end = np.where(size < n, rank[stop - 1], len(token))
    shared = overlaps(np.repeat(np.arange(k), size), rank, left, right, k)

    def reached(who: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(rank[stop[d] - size[d] : stop[d]], ends, "right") for d in who.tolist()], axis=1)

    first = end[left][:, None] <= end[right][None, :]
    a = np.where(first, size[left][:, None], reached(left, end[right]).T)
    b = np.where(first, reached(right, end[left]), size[right][None, :])
    nl, nr = n[left][:, None], n[right][None, :]
    asked = -(-percent * (nl + nr) // (100 + percent)) - np.minimum(nl - a, nr - b)
    return (shared >= np.maximum(asked, 1)) & (100 * np.minimum(nl, nr) >= percent * np.maximum(nl, nr))


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Which of ``left`` x ``right`` link, by whole sets."""
    n = np.array([len(s) for s in sets], np.int64)
    inverse = np.unique(np.concatenate(sets), return_inverse=True)[1]
    inter = overlaps(np.repeat(np.arange(len(sets)), n), inverse, left, right, len(sets))
    return 100 * inter >= percent * (n[left][:, None] + n[right][None, :] - inter)


def spanning(pairs: list[tuple[bytes, bytes]]) -> list[tuple[bytes, bytes]]:
    """Stars (root, other) that connect what the pairs connect."""
    parent: dict[bytes, bytes] = {}

    def find(a: bytes) -> bytes:
        while parent.setdefault(a, a) != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(find(a), a) for a in list(parent) if find(a) != a]


def groups_of(batches, keys: tuple[str, ...], cols: tuple[str, ...]) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of batches sorted by ``keys``."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in (*keys, *cols))):
            if row[: len(keys)] != key:
                if rows:
                    yield key, rows
                key, rows = row[: len(keys)], []
            rows.append(row[len(keys) :])
    if rows:
        yield key, rows


def with_leader(batches, keys: tuple[str, ...], cols: tuple[str, ...], most: int = 16 << 20) -> Iterator[tuple[tuple, tuple, list[tuple]]]:
    """(key, leader's row, other rows) of batches sorted by ``keys`` and with the leader first; the others in portions of ``BLOCK`` rows or ``most`` bytes of the last column."""
    key, leader, rows, size = None, None, [], 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in (*keys, "lead", *cols))):
            at, is_lead, row = row[: len(keys)], row[len(keys)], row[len(keys) + 1 :]
            if at != key or len(rows) >= BLOCK or size > most:
                if rows and leader:
                    yield key, leader, rows
                rows, size = [], 0
                if at != key:
                    key, leader = at, None
            if is_lead:
                leader = row
            else:
                rows.append(row)
                size += len(row[-1])
    if rows and leader:
        yield key, leader, rows


def whole_sets(docs: DataFrame, wanted: DataFrame, shingle_words: int) -> DataFrame:
    """``sig, data`` of the classes in ``wanted`` (sig, key): only texts whose key passes a filter of the wanted keys are split into shingles."""
    rows = wanted.count()
    keys = bloom(wanted.select("key"), min(BLOOM_BITS, max(16, (16 * rows).bit_length())))

    def give(batches):
        shingler, sent = Shingler(shingle_words), set()
        for batch in slices(batches):
            sig, data = [], []
            for at in np.flatnonzero(bloom_has(keys, batch.column("key").to_numpy())).tolist():
                key = batch.column("key")[at].as_py()
                if key not in sent and len(s := shingler(batch.column("text")[at].as_py())):
                    sent.add(key)
                    sig.append(signature(s))
                    data.append(s.tobytes())
            if len(sent) > TABLE_ENTRIES:
                sent.clear()
            yield pa.RecordBatch.from_arrays([pa.array(sig, pa.binary()), pa.array(data, pa.binary())], names=["sig", "data"])

    return docs.select("text", "key").mapInArrow(give, "sig binary, data binary").dropDuplicates(["sig"])


def classes_and_links(docs: DataFrame, shingle_words: int = 3, percent: int = 90, hot: int = HOT, block: int = BLOCK, star: int = STAR) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, n, sig) of each row of ``docs`` (doc_id, text; the key is a hash of the text); and links (u, v) between classes that span the components."""
    small_batches(docs.sparkSession)
    docs = docs.withColumn("key", F.xxhash64("text"))
    order, total = sketch(docs, shingle_words, percent)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, total * (100 - percent + 2) // 100 // BUCKET_TOKENS)
    made = staged(prefixes(docs, order, shingle_words, buckets, hot), "prefixes")

    def leaders(pdf):
        import pandas as pd

        a, b = lead(list(pdf["data"]), percent)
        return pd.DataFrame({"cluster": [x.tobytes() for x in a], "name": [x.tobytes() for x in b]}, columns=["cluster", "name"])

    name = F.substring("sig", 1, NAME).alias("name")
    met = made.filter("bucket >= 0").select("bucket", "data").groupBy("bucket").applyInPandas(leaders, "cluster binary, name binary")
    burning = made.filter("bucket = -2").select(F.col("data").alias("cluster"), name)
    # dealt by name, which serves the join too, so prefixes shuffle once
    known = made.filter("bucket = -3").withColumn("name", name).repartition("name").groupBy("name", "sig").agg(F.min("n").alias("n"), F.min("key").alias("key"), F.min("data").alias("data"))
    member = staged(met.unionByName(burning).distinct().join(known, "name").drop("name"), "members")

    # each leader with its members
    size = cut(member.groupBy("cluster").agg(F.count(F.lit(1)).alias("m"), F.min("sig").alias("leader")).filter("m > 1"))
    size = broadcast_if_small(size, F.lit(64))
    rows = member.join(size, "cluster").withColumn("lead", F.col("sig") == F.col("leader")).withColumn("parts", F.ceil(F.col("m") / star).cast("int"))
    rows = rows.withColumn("part", F.explode(F.when(F.col("lead"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("sig"), F.col("parts")).cast("int")))))
    dealt = lambda df, *by: df.repartition(parts, *by).sortWithinPartitions(*by, F.desc("lead"))

    def near_leader(batches):
        for key, leader, others in with_leader(batches, ("cluster", "part"), ("sig", "key", "n", "data")):
            may = promising([np.frombuffer(r[3], np.uint64) for r in (leader, *others)], np.array([r[2] for r in (leader, *others)]), np.zeros(1, np.int64), np.arange(1, len(others) + 1), order)[0]
            out = [(*key, False, r[0], r[1]) for r, yes in zip(others, may) if yes]
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(CANDIDATE.names, x)) for x in [(*key, True, *leader[:2]), *out]], CANDIDATE)

    candidate = staged(dealt(rows.select("cluster", "part", "lead", "sig", "key", "n", "data"), "cluster", "part").mapInArrow(near_leader, "cluster binary, part int, lead boolean, sig binary, key long"), "candidates")
    sets = whole_sets(docs, candidate.select("sig", "key").distinct(), shingle_words)

    def confirm(batches):
        for _, leader, others in with_leader(batches, ("cluster", "part"), ("sig", "data")):
            good = linked([np.frombuffer(r[1], np.uint64) for r in (leader, *others)], np.zeros(1, np.int64), np.arange(1, len(others) + 1), percent)[0]
            yield _links([(leader[0], r[0]) for r, yes in zip(others, good) if yes])

    first = staged(dealt(candidate.select("cluster", "part", "lead", "sig").distinct().join(sets, "sig"), "cluster", "part").mapInArrow(confirm, "u binary, v binary"), "links")

    # members that are not connected with their leader yet, with all others
    root = cut(components(first).select(F.col("node").alias("sig"), "root"))
    root = broadcast_if_small(root, F.lit(48))
    label = F.coalesce("root", "sig").alias("label")
    named = staged(member.select("cluster", "sig").join(size.filter("m > 2"), "cluster").join(root, "sig", "left").select("cluster", "sig", "leader", label), "labelled")
    mixed = named.groupBy("cluster").agg(F.min(F.struct("sig", "label")).getField("label").alias("top"), F.min("leader").alias("leader"), F.count(F.lit(1)).alias("m"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("cluster", "top", "leader", "m")
    mixed = broadcast_if_small(cut(mixed), F.lit(64))
    open_rows = named.drop("leader").join(mixed, "cluster").filter("label <> top").groupBy("cluster").agg(F.count(F.lit(1)).alias("open"))
    mixed = cut(mixed.join(open_rows, "cluster").select("cluster", "top", "leader", F.ceil((F.col("m") - 1) / block).cast("int").alias("rights"), F.ceil(F.col("open") / block).cast("int").alias("lefts")))
    rest = member.join(broadcast_if_small(mixed, F.lit(64)), "cluster").filter("sig <> leader").join(root, "sig", "left").withColumn("label", label)
    at = lambda n: F.pmod(F.xxhash64("sig", F.lit(7)), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cols = ("sig", "key", "label", "n", "data")
    lefts = rest.filter("label <> top").select("cluster", at("lefts").alias("i"), F.explode(every("rights")).alias("j"), F.lit(True).alias("lead"), *cols)
    rights = rest.select("cluster", F.explode(every("lefts")).alias("i"), at("rights").alias("j"), F.lit(False).alias("lead"), *cols)

    def meet(batches):
        for key, rows in groups_of(batches, ("cluster", "i", "j"), ("lead", *cols)):
            left, right = np.flatnonzero([r[0] for r in rows]), np.flatnonzero([not r[0] for r in rows])
            if not len(left) or not len(right):
                continue
            may = promising([np.frombuffer(r[5], np.uint64) for r in rows], np.array([r[4] for r in rows]), left, right, order) & apart([r[3] for r in rows], left, right)
            if may.any():
                stay = [*left[may.any(axis=1)].tolist(), *right[may.any(axis=0)].tolist()]
                yield pa.RecordBatch.from_pylist([dict(zip(PARTNERS.names, (*key, *rows[x][:4]))) for x in stay], PARTNERS)

    partner = staged(dealt(lefts.unionByName(rights), "cluster", "i", "j").mapInArrow(meet, "cluster binary, i int, j int, lead boolean, sig binary, key long, label binary"), "partners")
    sets = whole_sets(docs, partner.select("sig", "key").distinct(), shingle_words)

    def verify(batches):
        for _, rows in groups_of(batches, ("cluster", "i", "j"), ("lead", "sig", "label", "data")):
            left, right = np.flatnonzero([r[0] for r in rows]), np.flatnonzero([not r[0] for r in rows])
            good = linked([np.frombuffer(r[3], np.uint64) for r in rows], left, right, percent) & apart([r[2] for r in rows], left, right)
            yield _links(spanning([(rows[left[a]][1], rows[right[b]][1]) for a, b in zip(*np.nonzero(good))]))

    second = dealt(partner.drop("key").join(sets, "sig"), "cluster", "i", "j").select("cluster", "i", "j", "lead", "sig", "label", "data").mapInArrow(verify, "u binary, v binary")
    return made.filter("bucket = -1").select("doc_id", "key", "n", "sig"), first.unionByName(second)


CANDIDATE = pa.schema([("cluster", pa.binary()), ("part", pa.int32()), ("lead", pa.bool_()), ("sig", pa.binary()), ("key", pa.int64())])
PARTNERS = pa.schema([("cluster", pa.binary()), ("i", pa.int32()), ("j", pa.int32()), ("lead", pa.bool_()), ("sig", pa.binary()), ("key", pa.int64()), ("label", pa.binary())])


def _links(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.binary()), pa.array([b for _, b in pairs], pa.binary())], names=["u", "v"])


def apart(labels: list[bytes], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Pairs with different labels."""
    number: dict[bytes, int] = {}
    of = np.array([number.setdefault(x, len(number)) for x in labels])
    return of[left][:, None] != of[right][None, :]


def bloom(keys: DataFrame, bits: int) -> np.ndarray:
    """A bit array of 2^bits in which three bits of each key are set."""

    def run(batches):
        array = np.zeros(1 << (bits - 3), np.uint8)
        for batch in batches:
            for p in _places(batch.column("key").to_numpy(), bits):
                np.bitwise_or.at(array, p >> 3, (1 << (p & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_pandas(chunked(0, array), preserve_index=False)

    return summed_vector(keys.mapInArrow(run, "key int, chunk int, data binary"), "key", 1 << (bits - 3), "uint8", np.bitwise_or).get(0, np.zeros(1 << (bits - 3), np.uint8))


def _places(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    for factor in (K1, K2, K3):
        yield (keys.astype(np.uint64) * factor >> np.uint64(64 - bits)).astype(np.int64)


def bloom_has(array: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bits = len(array).bit_length() - 1 + 3
    return np.logical_and.reduce([array[p >> 3] >> (p & 7) & 1 > 0 for p in _places(keys, bits)])


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80, hot: int = HOT, block: int = BLOCK, star: int = STAR) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id``.

    ``component_id`` is the smallest id reachable by links of Jaccard similarity
    of at least ``percent`` / 100. Defined cases: a text without words (null,
    empty, white space) has 0 shingles, no links, and its own id; fewer words
    than a shingle are one shingle; repeated rows and equal texts share a
    component; null ids never name a component unless all its ids are null; an
    empty table gives an empty result; extra columns are ignored.
    """
    return _groups(docs, id_col, text_col, shingle_words, percent, hot, block, star).drop("key")


def _groups(docs: DataFrame, id_col: str, text_col: str, shingle_words: int, percent: int, hot: int = HOT, block: int = BLOCK, star: int = STAR) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    classes, links = classes_and_links(rows, shingle_words, percent, hot, block, star)
    root = cut(components(links).select(F.col("node").alias("sig"), "root"))
    labelled = staged(classes.filter("n > 0").join(root, "sig", "left").select("doc_id", "key", "n", F.coalesce("root", "sig").alias("label")), "labels")
    smallest = staged(labelled.groupBy("label").agg(F.min("doc_id").alias("component_id")), "smallest")  # on its own, so that a join at a hot label can be split
    out = labelled.join(smallest.hint("merge"), "label").select("doc_id", "key", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(classes.filter("n = 0").select("doc_id", "key", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with the smallest id of their group, all columns kept.

    Defined cases: as in ``near_groups``; rows with a null id stay, and all rows
    that repeat the smallest id; an id that other texts repeat is judged text by
    text; texts without words stay.
    """
    gone = _groups(docs, id_col, text_col, shingle_words, percent).filter("doc_id <> component_id").select("doc_id", "key")
    return without(docs, gone, id_col, F.xxhash64(docs[text_col].cast("string")))
