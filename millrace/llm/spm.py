"""SentencePiece encoding and decoding through a distinct-chunk table.

The model's pieces never cross from a character to a white-space marker, so a
text falls into chunks (markers, then the characters up to the next marker) that
are segmented on their own. A task segments each distinct marked word once, in
batches by the library itself, and joins ids back by position. The model's
claim is checked when it is loaded; a model that breaks it, or that normalises
text, takes the library's plain path.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
#: Entries of a task's table of distinct chunks; it is emptied when full.
TABLE_ENTRIES = 300_000


class ChunkTable:
    """Marked word -> (number of ids, ids as decimal text, decoded text)."""

    def __init__(self, model_path: str, entries: int = TABLE_ENTRIES):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.entries = entries
        self.table: dict[str, tuple[int, str, str]] = {}
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        ordinary = [p for i, p in enumerate(pieces) if not self.model.is_control(i) and not self.model.is_unknown(i)]
        self.byte = {i: int(p[3:5], 16) for i, p in enumerate(pieces) if self.model.is_byte(i)}
        self.pieces = pieces
        probe = " a  b ﬁ \t"
        self.splits = not any(MARK in p.lstrip(MARK) or (p.startswith(MARK * 2) and p.strip(MARK)) for p in ordinary) and len(self.byte) == 256 and self.model.normalize(probe) == (MARK + probe.replace(" ", MARK))

    def decode_ids(self, ids: list[int]) -> str:
        out, raw = [], bytearray()
        for i in ids:
            if i in self.byte:
                raw.append(self.byte[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(self.pieces[i].replace(MARK, " "))
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out)

    def learn(self, chunks: list[str]) -> None:
        if len(self.table) + len(chunks) > self.entries:
            self.table.clear()
        # the library puts a marker before each text, so the chunk goes in without its first
        for c, ids in zip(chunks, self.model.encode([c[1:] for c in chunks], num_threads=1)):
            if len(c) == 1:
                ids = [self.model.piece_to_id(MARK)]
            self.table[c] = (len(ids), ",".join(map(str, ids)), self.decode_ids(ids))

    def encode(self, text: str) -> tuple[int, str, str]:
        """(number of ids, ids joined by commas, decoded text)."""
        if not text:
            return 0, "", ""
        if not self.splits:
            ids = self.model.encode(text)
            return len(ids), ",".join(map(str, ids)), self.model.decode(ids)
        chunks = CHUNK.findall(MARK + text.replace(" ", MARK))
        n, ids, decoded = 0, [], []
        step = max(1, self.entries // 2)  # a text with more chunks than the table holds goes through it in portions
        for at in range(0, len(chunks), step):
            part = chunks[at : at + step]
            new = [c for c in dict.fromkeys(part) if c not in self.table]
            if new:
                full = len(self.table) + len(new) > self.entries
                self.learn(list(dict.fromkeys(part)) if full else new)
            got = [self.table[c] for c in part]
            n += sum(g[0] for g in got)
            ids.append(",".join([g[1] for g in got]))
            decoded.append("".join([g[2] for g in got]))
        return n, ",".join(ids), "".join(decoded)[1:]


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per input row: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` (and ``ids``, ``decoded`` if asked for).

    Defined cases: null and empty texts have no ids and decode to the empty
    text; null or repeated ids keep a row each; an empty table gives an empty
    result; extra columns are ignored.
    """

    def start():
        table = ChunkTable(model_path)

        def run(texts):
            cols = [[] for _ in range(5 if with_ids else 3)]
            for text in texts:
                n, ids, decoded = table.encode(text or "")
                row = (n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                if with_ids:
                    row += ([int(i) for i in ids.split(",")] if ids else [], decoded)
                for c, v in zip(cols, row):
                    c.append(v)
            return cols

        return run

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_texts(rows, start, "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else ""))
