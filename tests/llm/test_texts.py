"""Exact dedup, personal data, packing and SentencePiece against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import exact, packing, pii, spm

from . import cases

TOK = (P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def sample(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]


def by_row(df):
    return Counter(tuple(r) for r in df.collect())


# --- exact dedup


def test_exact_groups_match_brute_force(spark):
    groups = defaultdict(list)
    for r in cases.rows():
        groups[r[1] or ""].append(r[0])
    want = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest())] += 1
    assert by_row(exact.exact_groups(cases.frame(spark))) == want
    assert exact.exact_groups(cases.frame(spark, [])).count() == 0


def test_keep_one_leaves_one_of_each_text(spark):
    kept = exact.keep_one(cases.frame(spark, [r for r in dict.fromkeys(cases.rows()) if r[0] is not None]))
    texts = [r["text"] or "" for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({r[1] or "" for r in cases.rows() if r[0] is not None})
    assert kept.columns == cases.frame(spark).columns


# --- personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in CARD.finditer(text):
        d = [int(c) for c in m.group() if c.isdigit()]
        if 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out, key=lambda s: (s[1], ["email", "ip", "card", "phone"].index(s[0])))


def test_pii_base_matches_patterns(spark):
    auto = pii.automaton()
    for _, text in sample(spark) + [(None, t) for t in cases.TEXTS if t]:
        assert sorted(pii.find(text, auto)[0]) == sorted(plain(text))


@settings(max_examples=400, deadline=None)
@given(st.text("ab@.+-_ 0123459()€", max_size=60))
def test_pii_base_on_random_texts(text):
    assert sorted(pii.find(text, pii.automaton())[0]) == sorted(plain(text))


def test_pii_frame_and_redaction(spark):
    got = {(r["doc_id"], r["base_sha256"]): r for r in pii.find_pii(cases.frame(spark)).collect()}
    for i, text in enumerate(cases.TEXTS):
        want = ",".join(f"{k}:{s}:{e}" for k, s, e in plain(text or ""))
        assert (i, hashlib.sha256(want.encode()).hexdigest()) in got
    assert pii.find_pii(cases.frame(spark)).count() == len(cases.rows())
    assert "iban:" in next(r["spans"] for r in got.values() if r["doc_id"] == 13)
    red = {r["doc_id"]: r["text"] for r in pii.redact(cases.frame(spark)).collect()}
    assert red[0] is None and "@x-y" not in red[11] and "[EMAIL]" in red[11] and "4111 1111 1111 1111" not in red[12]
    assert pii.find_pii(cases.frame(spark, [])).count() == 0


# --- packing


def test_pieces_are_the_tokenizers_own(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOK[0])
    docs = dict(sample(spark)) | {1000 + i: t for i, t in enumerate(cases.TEXTS)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    got = defaultdict(list)
    for r in packing.pack_documents(df, *TOK).collect():
        got[r["doc_id"]].append(r)
    bins = defaultdict(list)
    for i, text in docs.items():
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        ps = sorted(got[i], key=lambda r: r["piece"])
        assert [p["piece"] for p in ps] == list(range(len(ps)))
        assert [p["start"] for p in ps] == [sum(q["length"] for q in ps[:k]) for k in range(len(ps))]
        assert sum(p["length"] for p in ps) == len(ids) and all(p["length"] == 1024 for p in ps[1:])
        for p in ps:
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes())
            bins[p["sequence_id"]].append((p["offset"], p["length"]))
    total = 0
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
        total += at
    assert len(bins) <= 1.01 * -(-total // 1024) + 1


def test_packing_edges(spark):
    df = packing.pack_documents(cases.frame(spark), *TOK)
    assert df.select("doc_id").distinct().count() == len({r[0] for r in cases.rows()})
    assert packing.pack_documents(cases.frame(spark, []), *TOK).count() == 0


def test_pieces_stay_where_they_were_written(spark):
    """Their ids are not shuffled to their places; where the counts are too many to send along, the places are the same."""
    pieces = packing.pieces(cases.frame(spark).repartition(5), *TOK, capacity=16, with_ids=True)
    stay, move = packing.pack(pieces, 16), packing.pack(pieces, 16, most=0)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (stay, move)]
    assert ["Exchange" in p for p in plans] == [False, True]
    rows = [sorted(df.collect(), key=lambda r: (r["sequence_id"], r["offset"])) for df in (stay, move)]
    assert [(r["sequence_id"], r["offset"], r["length"]) for r in rows[0]] == [(r["sequence_id"], r["offset"], r["length"]) for r in rows[1]]
    assert sum(r["length"] for r in rows[0]) == sum(len(r["ids"]) for r in rows[0]) > 100


def test_workers_hold_little(spark):
    """Batches of some MB, unless the session asks otherwise; and what is freed goes back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)

    def sizes(batches):
        import pyarrow as pa

        from millrace.llm import common

        for batch in common.slices(batches):
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "pool": [pa.default_memory_pool().backend_name]})

    try:
        for asked, most in (("10000", 2000), ("9000", 9000)):
            spark.conf.set(key, asked)
            packing.pieces(cases.frame(spark), *TOK)
            got = spark.range(0, 9500, 1, 1).selectExpr("'a' as text").mapInArrow(sizes, "n long, pool string").collect()
            assert sum(r["n"] for r in got) == 9500 and max(r["n"] for r in got) == most
            assert {r["pool"] for r in got} == {"system"}
    finally:
        spark.conf.set(key, before)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=40))
def test_minimum_bin_slack_covers_the_histogram(lengths):
    hist = np.bincount(lengths, minlength=31)
    back = Counter()
    for items, times in packing.minimum_bin_slack(hist, 30):
        assert sum(items) <= 30 and times > 0
        for x in items:
            back[x] += times
    assert back == Counter(lengths)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=10), st.integers(1, 30))
def test_fullest_is_the_best_subset(lengths, room):
    sums = {0}
    for x in lengths:
        sums |= {s + x for s in sums if s + x <= room}
    got = packing.fullest(np.bincount(lengths, minlength=31), room)
    assert sum(got) == max(sums) and not Counter(got) - Counter(lengths)


# --- SentencePiece


@pytest.fixture(scope="module")
def processor():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def test_spm_equals_the_library(spark, processor):
    table = spm.ChunkTable(P.path("piece_bpe_32k.model"), entries=500)
    assert table.splits
    for _, text in sample(spark) + [(None, t) for t in cases.TEXTS]:
        n, ids, decoded = table.encode(text or "")
        want = processor.encode(text or "")
        assert (n, ids) == (len(want), ",".join(map(str, want))) and decoded == processor.decode(want)


@settings(max_examples=300, deadline=None)
@given(st.text("ab ▁\n\t é日😀ﬁ<s>0x", max_size=40))
def test_spm_on_random_texts(processor, text):
    n, ids, decoded = _TABLE.encode(text)
    want = processor.encode(text)
    assert (n, ids, decoded) == (len(want), ",".join(map(str, want)), processor.decode(want))


def test_spm_portions_and_nul(processor):
    table = spm.ChunkTable(P.path("piece_bpe_32k.model"), entries=6)
    for text in ("a b c d e f g h i j k l a b c", "x\0y z\0 \0", "\0"):
        ids = processor.encode(text)
        assert table.encode(text) == (len(ids), ",".join(map(str, ids)), processor.decode(ids)) and len(table.table) <= 6


_TABLE = spm.ChunkTable(P.path("piece_bpe_32k.model"))


def test_spm_frame(spark):
    df = spm.encode_documents(cases.frame(spark), P.path("piece_bpe_32k.model"), with_ids=True)
    got = df.collect()
    assert len(got) == len(cases.rows())
    assert all(r["n_tokens"] == len(r["ids"]) for r in got) and {r["decoded"] for r in got} == {t or "" for t in cases.TEXTS if "▁" not in (t or "")} | {(t or "").replace("▁", " ") for t in cases.TEXTS} | {"no id", "large id"}
    assert spm.encode_documents(cases.frame(spark, []), P.path("piece_bpe_32k.model")).count() == 0
