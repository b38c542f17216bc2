"""Best-fit packing of token sequences by minimum bin slack.

Only the histogram of piece lengths (at most ``capacity`` numbers, whatever the
corpus) decides the packing. Minimum bin slack runs on it: for the next bin, a
bitset subset-sum over the available lengths finds the fullest feasible
combination that holds the longest length left; the combination is removed as
often as the counts allow. Each removal exhausts a length, so there are at most
about ``capacity`` combinations. Pieces then take places by their rank within
their length, which needs no task to see more than its own pieces.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_BYTES, packed_numbers, slices, small_batches, staged, unpacked_numbers

CAPACITY = 1024
END_ID = 2
#: Entries of a task's table of encoded chunks; it is emptied when full.
TABLE_ENTRIES = 400_000
#: No merge crosses a border between a non-space and a space, and one space joins the word after it.
CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: White space to Python's patterns but not to the tokenizer's; a special token's text. Such texts go to the tokenizer whole.
ODD = re.compile(r"[\x1c-\x1f]|<\|")


def encoder(tokenizer_path: str, ranks_path: str, pattern: str):
    """text -> its ids as little-endian unsigned 32-bit bytes, equal to the tokenizer file's own encoding.

    Distinct chunks are encoded once a task by the rank file (the same
    vocabulary, several times as fast); odd texts by the tokenizer itself.
    """
    import base64

    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    whole = []
    table: dict[str, bytes] = {}

    def encode(text: str) -> bytes:
        if ODD.search(text):
            if not whole:
                from tokenizers import Tokenizer

                whole.append(Tokenizer.from_file(tokenizer_path))
            return np.array(whole[0].encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        chunks = CHUNK.findall(text)
        try:
            return b"".join([table[c] for c in chunks])
        except KeyError:
            if len(table) > TABLE_ENTRIES:
                table.clear()
            out = []
            for c in chunks:
                ids = table.get(c)
                if ids is None:
                    ids = np.array(fast(c), "<u4").tobytes()
                    if len(c) <= 64:
                        table[c] = ids
                out.append(ids)
            return b"".join(out)

    return encode


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def pieces(docs: DataFrame, tokenizer_path: str, ranks_path: str, pattern: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of each document; ``(part, nth)`` is a piece's task and its place among the task's pieces of that length."""
    small_batches(docs.sparkSession)
    schema = T._parse_datatype_string(PIECE + (", ids array<int>" if with_ids else ""))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode = encoder(tokenizer_path, ranks_path, pattern)
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in slices(batches):
            rows, ids = [], []  # ids: the pieces' bytes
            doc_ids = batch.column("doc_id")
            owner = []
            for i, text in enumerate(batch.column("text").to_pylist()):
                data = encode(text or "") + end
                n = len(data) // 4
                to = (n - 1) % capacity + 1  # the first piece takes what is over
                start, k = 0, 0
                while start < n:
                    piece = data[4 * start : 4 * to]
                    seen[to - start] += 1
                    rows.append((k, start, to - start, zlib.crc32(piece), part, seen[to - start] - 1))
                    owner.append(i)
                    if with_ids:
                        ids.append(piece)
                    start, to, k = to, to + capacity, k + 1
            cols = [doc_ids.take(pa.array(owner, pa.int32()))]
            for j, kind in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())):
                cols.append(pa.array([r[j] for r in rows], kind))
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
            if with_ids:
                offsets = np.concatenate([[0], np.cumsum([len(b) // 4 for b in ids])]).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4"))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


def fullest(counts: np.ndarray, room: int) -> list[int]:
    """Lengths (with repeats, as the counts allow) that fill ``room`` as far as possible.

    Bitset subset-sum: bit s of ``reach`` says that sum s can be made. ``steps``
    keeps the bitset before each item, to walk back from the best sum.
    Long items come first, so that small ones stay for later bins.
    """
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for length in np.flatnonzero(counts[: room + 1])[::-1].tolist():
        if not length:
            continue
        left, k = min(int(counts[length]), room // length), 1
        while left:  # 1, 2, 4, ... copies at once
            take = min(k, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            k *= 2
        if reach >> room & 1:
            break
    best = reach.bit_length() - 1
    out: list[int] = []
    for length, take, before in reversed(steps):
        if not before >> best & 1:
            out += [length] * take
            best -= length * take
    return out


def minimum_bin_slack(histogram: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of a bin, number of such bins), covering ``histogram`` (count by length) exactly."""
    counts = histogram.astype(np.int64).copy()
    bins = []
    while True:
        left = np.flatnonzero(counts)
        if not len(left):
            return bins
        longest = int(left[-1])
        counts[longest] -= 1
        items = [longest, *sorted(fullest(counts, capacity - longest), reverse=True)]
        counts[longest] += 1
        used = np.bincount(items, minlength=len(counts))
        need = np.flatnonzero(used)
        times = int((counts[need] // used[need]).min())
        counts -= used * times
        bins.append((items, times))


def pack(pieces_df: DataFrame, capacity: int = CAPACITY, most: int = BROADCAST_BYTES) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to the rows of ``pieces``.

    The places of a length are numbered through all bins; piece number r of that
    length takes place r. Piece numbers come from counts by (part, length), so
    a length that a third of all pieces share is no hot group. The counts of a
    part are a row of some KB; all go to every task while they measure at most
    ``most``, so that pieces stay where they were written; beyond it the pieces
    shuffle to them.

    Defined cases: pieces of one length are alike, so ties go by (part, nth);
    ids may be null or repeat, further columns pass through; an empty table
    gives an empty result. Lengths are 1 to ``capacity``.
    """
    pieces_df = staged(pieces_df, "pieces")
    by_part = pieces_df.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    totals = by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most ``capacity`` rows
    histogram = np.zeros(capacity + 1, np.int64)
    for r in totals:
        histogram[r["length"]] = r["n"]
    places: dict[int, list[tuple[int, int, int, int, int]]] = {}
    filled = np.zeros(capacity + 1, np.int64)
    first_bin = 0
    for items, times in minimum_bin_slack(histogram, capacity):
        offset = 0
        at = 0
        while at < len(items):
            length, k = items[at], items.count(items[at])
            places.setdefault(length, []).append((int(filled[length]), first_bin, k, offset, at))
            filled[length] += k * times
            offset += k * length
            at += k
        first_bin += times
    table = {length: [np.array(c, np.int64) for c in list(zip(*rows))[:4]] for length, rows in places.items()}
    before = by_part.select("part", "length", F.coalesce(F.sum("n").over(_running()), F.lit(0)).alias("before"))

    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(), rank.to_numpy()
        seq, off = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
        for one in np.unique(n):
            i = np.flatnonzero(n == one)
            first, bin0, each, offset = table[int(one)]
            j = np.searchsorted(first, r[i], side="right") - 1
            copy, nth = np.divmod(r[i] - first[j], each[j])
            seq[i], off[i] = bin0[j] + copy, offset[j] + nth * one
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    def of_part(pdf: pd.DataFrame) -> pd.DataFrame:
        numbers = np.zeros(capacity + 1, np.int64)
        numbers[pdf["length"].to_numpy()] = pdf["before"].to_numpy()
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "data": [packed_numbers(numbers)]})

    kept = [c for c in pieces_df.columns if c not in ("part", "nth")]
    places_of = "sequence_id long, offset long"
    parts = staged(before.groupBy("part").applyInPandas(of_part, "part int, data binary"), "parts")
    if (parts.agg(F.sum(F.length("data"))).first()[0] or 0) > most:
        rank = F.col("before") + F.col("nth")
        ranked = pieces_df.join(before, ["part", "length"])
        return ranked.withColumn("at", F.pandas_udf(place, places_of)("length", rank)).select(*kept, "at.sequence_id", "at.offset")
    numbers_of = {r["part"]: bytes(r["data"]) for r in parts.collect()}

    def place_in_part(part: pd.Series, length: pd.Series, nth: pd.Series) -> pd.DataFrame:
        p, n, rank = part.to_numpy(), length.to_numpy(), nth.to_numpy().copy()
        for one in np.unique(p):  # a file of pieces holds one part
            i = np.flatnonzero(p == one)
            rank[i] += unpacked_numbers(numbers_of[int(one)]).astype(np.int64)[n[i]]
        return place(length, pd.Series(rank))

    return pieces_df.withColumn("at", F.pandas_udf(place_in_part, places_of)("part", "length", "nth")).select(*kept, "at.sequence_id", "at.offset")


def _running():
    from pyspark.sql import Window

    return Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)


def pack_documents(docs: DataFrame, tokenizer_path: str, ranks_path: str, pattern: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids`` if asked for).

    Defined cases: a null or empty text is the end id alone; null and repeated
    ids keep their pieces; an empty table gives an empty result; extra columns
    are ignored.
    """
    return pack(pieces(docs, tokenizer_path, ranks_path, pattern, capacity, end_id, id_col, text_col, with_ids), capacity)
