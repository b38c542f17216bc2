"""Jaccard components, nearest neighbours, WARC archives and the pipeline against brute force."""

import hashlib
import os
from collections import Counter, defaultdict

import numpy as np
import pytest

from millrace.llm import ann, components, jaccard, warc

from . import cases

# --- Jaccard join


def brute(docs, words, percent):
    sets = []
    for _, t in docs:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    parent = list(range(len(docs)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(docs)):
        for b in range(a):
            inter = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * inter >= percent * len(sets[a] | sets[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    least = defaultdict(lambda: None)
    for a, (i, _) in enumerate(docs):
        if i is not None:
            r = find(a)
            least[r] = i if least[r] is None else min(least[r], i)
    return Counter((i, len(sets[a]), least[find(a)] if sets[a] else i) for a, (i, _) in enumerate(docs))


def near_copies(groups=6, copies=9, seed=5):
    """Groups of texts with a few words changed each, links in chains, and passages shared across groups."""
    rng = np.random.default_rng(seed)
    word = lambda: f"w{rng.integers(0, 4000)}"
    passage = " ".join(word() for _ in range(60))
    docs, at = [], 0
    for g in range(groups):
        base = [word() for _ in range(int(rng.integers(20, 150)))]
        for _ in range(copies):
            text = list(base)
            for _ in range(int(rng.integers(0, 4))):
                text[int(rng.integers(0, len(text)))] = word()
            docs.append((at, " ".join(text) + (" " + passage if g % 2 else "")))
            base = text if g % 3 == 0 else base
            at += 1
    return docs


@pytest.mark.parametrize("words,percent,hot,block,star", [(5, 80, 1 << 18, 4, 2), (3, 80, 2, 3, 5), (2, 60, 1 << 18, 8, 3)])
def test_components_match_brute_force(spark, words, percent, hot, block, star):
    docs = near_copies()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = jaccard.near_groups(df, shingle_words=words, percent=percent, hot=hot, block=block, star=star).collect()
    assert Counter(map(tuple, got)) == brute(docs, words, percent)
    assert len({r["component_id"] for r in got}) < len(docs)


def test_promising_loses_no_link():
    """Whatever the order and the lengths of the prefixes; and unlike pairs mostly go."""
    rng = np.random.default_rng(12)
    for percent in (60, 80, 90):
        order = jaccard.Order(rng.integers(0, 3, 1 << 8).astype(np.uint16), 0.0, percent)
        sets = []
        for _ in range(30):
            base = rng.integers(0, 1 << 40, int(rng.integers(1, 60)))
            for _ in range(4):
                keep = base[rng.random(len(base)) < rng.choice([0.5, 0.9, 0.97, 1.0])]
                sets.append(np.unique(np.append(keep, rng.integers(0, 1 << 40, int(rng.integers(0, 4))))).astype(np.uint64))
        sets = [s for s in sets if len(s)]
        prefix = [order.prefix(s)[0] for s in sets]
        n, every = np.array([len(s) for s in sets]), np.arange(len(sets))
        may = jaccard.promising(prefix, n, every[::2], every[1::2], order)
        good = jaccard.linked(sets, every[::2], every[1::2], percent)
        brute = np.array([[100 * len(np.intersect1d(sets[a], sets[b])) >= percent * len(np.union1d(sets[a], sets[b])) for b in every[1::2]] for a in every[::2]])
        assert (good == brute).all() and may[good].all() and may.sum() < 0.2 * may.size


def test_a_bucket_gets_short_names_and_shingles(spark):
    """With more buckets than a prefix has shingles, one costs little more than a name and a shingle; what is cut meets, too."""
    rng = np.random.default_rng(5)
    docs = spark.createDataFrame([(i, " ".join(f"w{x}" for x in rng.integers(0, 1 << 30, 100)), i) for i in range(2000)], "doc_id long, text string, key long").coalesce(1)
    order = jaccard.Order(np.ones(1 << 8, np.uint16), 0.0, 90)
    rows = jaccard.prefixes(docs, order, 3, 64, 1 << 18).filter("bucket >= 0 or bucket = -3").collect()
    tokens = sum(len(r["data"]) // 8 for r in rows if r["bucket"] == -3)
    assert sum(len(r["data"]) for r in rows if r["bucket"] >= 0) < 18 * tokens

    def blob(sig, sizes, owner, token):
        flat = np.frombuffer(b"".join(sig), np.uint8).reshape(-1, 16)[:, : jaccard.NAME]
        return jaccard.packed(np.int64(len(sig)).tobytes() + flat.tobytes() + np.array(sizes, np.int64).tobytes() + np.array(owner, np.int32).tobytes() + np.array(token, np.uint64).astype(jaccard.SHORT).tobytes())

    sig = [bytes([x]) * 16 for x in (9, 3, 200, 3)]
    sig[3] = sig[1][:8] + bytes(8)  # another class of the same short name, of another size
    far = 5 + (1 << 40)  # differs from 5 beyond what a bucket keeps
    a, b = jaccard.lead([blob(sig[:2], [100, 100], [0, 1], [5, 5]), blob(sig[2:], [100, 97], [0, 1, 1], [far, 5, 7])], 90)
    assert {(x.tobytes(), y.tobytes()) for x, y in zip(a, b)} == {(sig[1][:8], s[:8]) for s in sig}


def test_a_large_group_of_near_copies_costs_a_row_each(spark):
    """No block of it meets another: all members link with their leader."""
    base = [f"w{i}" for i in range(200)]
    docs = [(i, " ".join(base[:60] + [f"x{i}"] + base[60:])) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    classes, links = jaccard.classes_and_links(df, 3, 90, block=16, star=32)
    assert classes.count() == 300 and links.count() <= 3 * 300
    assert {r["root"] for r in components.components(links).select("root").distinct().collect()} == {min(r["sig"] for r in classes.select("sig").collect())}


def test_jaccard_on_the_small_table_and_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = jaccard.near_groups(docs, shingle_words=3, percent=90).collect()
    assert Counter(map(tuple, got)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()], 3, 90)
    assert Counter(map(tuple, jaccard.near_groups(cases.frame(spark)).collect())) == brute([(r[0], r[1]) for r in cases.rows()], 5, 80)
    assert jaccard.near_groups(cases.frame(spark, [])).count() == 0


@pytest.mark.parametrize("name", ["op4_jaccard_join", "op7_warc", "op8_exact_dedup"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    from millrace.llm import queries

    sf, c = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    result = c.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, sf).select(*result.columns)
    assert set(queries.oracle_sql()) == {"op4_jaccard_join", "op7_warc", "op8_exact_dedup"}
    assert Counter(map(tuple, got.collect())) == Counter(result.fetchall())


def test_components_of_a_path_and_a_star(spark):
    edges = [(f"{i:03}", f"{i + 1:03}") for i in range(40)] + [("900", f"{i}") for i in range(901, 920)] + [("x", "x")]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert {got[f"{i:03}"] for i in range(41)} == {"000"} and {got[f"{i}"] for i in range(900, 920)} == {"900"}


# --- nearest neighbours


def brute_nearest(rows, k, every):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    out = set()
    for i, q in good:
        if i % every == 0:
            found = sorted(((-(q @ v), j) for j, v in good if j != i and len(v) == len(q)))[:k]
            out |= {(i, rank + 1, j) for rank, (_, j) in enumerate(found)}
    return out


def test_nearest_recall_and_scores(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = ann.nearest(table).collect()
    rows = [(r["vec_id"], list(r["embedding"])) for r in table.collect()]
    want = brute_nearest(rows, 20, 20)
    assert len({(r["query_id"], r["vec_id"]) for r in got} & {(q, j) for q, _, j in want}) >= 0.99 * len(want) and len(got) == len(want)
    v = {i: np.array(x, float) for i, x in rows}
    assert all(abs(r["score"] - v[r["query_id"]] @ v[r["vec_id"]]) < 1e-12 for r in got)


def test_nearest_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "CANDIDATE_ROWS", 300)
    monkeypatch.setattr(ann, "QUERY_ROWS", 20)
    monkeypatch.setattr(ann, "FAN", 2)
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(32).tolist()) for i in range(2500)]
    got = {(r["query_id"], r["vec_id"]) for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=50).collect()}
    want = {(q, j) for q, _, j in brute_nearest(rows, 20, 50)}
    assert len(got) == len(want) and len(got & want) >= 0.99 * len(want)


def test_bound_reranks_few_of_many():
    rng = np.random.default_rng(4)
    v, q = rng.standard_normal((8000, 128)), rng.standard_normal((20, 128))
    u, exponent = ann.scaled(v)
    codes, norm, f = ann.encode(u, ann.rotation(128))
    row, cand, _, _, reranked = ann.search(q, np.full(20, -1), u, np.arange(8000), exponent, codes, norm, f, 10)
    assert codes.shape == (8000, 16) and reranked < 0.5 * 20 * 8000
    best = np.argsort(-(q @ v.T), axis=1)[:, :10]
    assert np.mean([len(set(best[i]) & set(cand[row == i])) / 10 for i in range(20)]) >= 0.97


@pytest.mark.parametrize("scale", [1e-300, 1e-170, 1e-60, 1e40, 1e160, 1e300])
def test_search_at_any_magnitude(scale):
    """The same neighbours and as few reranked pairs, whatever the size of the vectors."""
    rng = np.random.default_rng(6)
    v = rng.standard_normal((3000, 64))
    u, exponent = ann.scaled(v * scale)
    codes, norm, f = ann.encode(u, ann.rotation(64))
    row, cand, score, power, reranked = ann.search(v[:30] * scale, np.arange(30), u, np.arange(3000), exponent, codes, norm, f, 20)
    product = v[:30] @ v.T
    product[np.arange(30), np.arange(30)] = -np.inf
    best = np.argsort(-product, axis=1)[:, :20]
    assert np.bincount(row).tolist() == [20] * 30 and reranked < 0.6 * 30 * 3000
    assert np.mean([len(set(best[i]) & set(cand[row == i])) / 20 for i in range(30)]) >= 0.97
    if scale == 1e40:
        assert np.allclose(np.ldexp(score, power), product[row, cand] * 1e80, rtol=1e-12)


def test_nearest_of_mixed_magnitudes_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(ann, "CANDIDATE_ROWS", 200)
    rng = np.random.default_rng(8)
    rows = [(i, (rng.standard_normal(16) * 10.0 ** float(rng.choice([-180, -3, 0, 90, 140]))).tolist()) for i in range(600)] + [(7, [1e150] * 16)] * 500
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=100).collect()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: r["rank"]):
        by[r["query_id"]].append(r["vec_id"])
    from fractions import Fraction

    for q in range(0, 600, 100):
        product = lambda v, q=q: sum(Fraction(a) * Fraction(b) for a, b in zip(rows[q][1], v))
        want = [i for _, i in sorted((-product(v), i) for i, v in rows if i != q)[:20]]
        assert len(by[q]) == 20 and sum((Counter(want) & Counter(by[q])).values()) >= 18


def test_nearest_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], "x"), (20, [1.0, 1.0], "x"), (3, [1.0, 0.0], "x"), (2, [1.0, 0.0], "x"), (4, [0.0, 0.0], "x"), (5, None, "x"), (6, [], "x"), (7, [nan, 1.0], "x"), (8, [inf, 1.0], "x"), (40, [None, 1.0], "x"), (None, [1.0, 2.0], "x"), (60, [1.0, 1.0, 1.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    got = {(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(df).collect()}
    assert got == brute_nearest([(i, v) for i, v, _ in rows], 20, 20)
    assert ann.nearest(df.limit(0)).count() == 0 and ann.nearest(df.filter("vec_id = 5")).count() == 0


# --- WARC


def pages():
    long = "<p>é</p>" * 300
    rows = [(1, "http://a/", long), (2, "http://a/2", long), (9, None, long), (3, "u\r\nX: y", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "u", "x" * 999), (8, "u", "x" * 999), (10, "u", "x" * 1000), (11, "u", "x" * 1000), (11, "u", "x" * 1000), (None, "u", long), (None, "u", "none")]
    return [(i, u, h, "clash", 0) for i, u, h in rows]


def expected(rows):
    keep = {}
    for i, _, h, *_ in rows:
        if len((h or "").encode()) >= 1000 and i is not None:
            keep[h] = max(keep.get(h, i), i)
    out = Counter()
    for i, _, h, *_ in rows:
        b = (h or "").encode()
        k = keep.get(h) if len(b) >= 1000 else None
        revisit = k is not None and k != i
        out[(i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", k if revisit else None)] += 1
    return out


def test_archives_round_trip(spark, tmp_path):
    df = spark.createDataFrame(pages(), "page_id long, url string, html string, digest string, keep int").repartition(3)
    assert Counter(map(tuple, warc.round_trip(df).collect())) == expected(pages())
    assert warc.round_trip(df.limit(0)).count() == 0
    archives = warc.write_archives(warc.with_revisits(df)).cache()
    warc.export_files(archives, str(tmp_path))
    got = warc.read_files(spark, str(tmp_path), with_payload=True).collect()
    assert Counter(tuple(r)[:5] for r in got) == expected(pages())
    assert {r["payload"].decode() for r in got if r["payload"] is not None} == {h or "" for _, _, h, *_ in pages()}


def test_dictionary_leads_and_breaks_are_found(spark):
    big = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").coalesce(1)
    archive = warc.write_archives(warc.with_revisits(big)).first()["content"]
    assert archive[:4] == bytes.fromhex("5d2a4d18")
    frames = list(warc.decode_frames(archive))
    assert len(frames) > 50 and warc.parse(frames[0][1])["payload"]
    with pytest.raises(warc.WarcError):
        list(warc.decode_frames(archive[:-3]))
    with pytest.raises(warc.WarcError):
        list(warc.decode_frames(archive[: frames[1][0]] + b"junk"))
    record = frames[0][1]
    for bad in (record.replace(b"WARC/1.1", b"WARC/9.9"), record[:-1], record.replace(b"Content-Length: ", b"Content-Length: 1", 1), record.replace(b"sha1:", b"sha1:0", 1), record.replace(b"WARC-Date", b"WARC Date ")):
        with pytest.raises(warc.WarcError):
            warc.parse(bad)
    assert len(warc.leading_frame(None)) == 0 and list(warc.decode_frames(b"")) == []


def test_unequal_payloads_of_one_sha1_stay_apart(spark):
    """The digest in the records may collide; the match must not rest on it."""
    rows = [(1, "u", "a" * 2000), (2, "u", "b" * 2000), (3, "u", "a" * 2000)]
    df = warc.with_revisits(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r["page_id"]: r["refers_to"] for r in df.collect()} == {1: 3, 2: None, 3: None}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2(" in plan and not any("Join" in line and "digest" in line for line in plan.splitlines())


# --- pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = docs.collect()
    near = first[0].asDict() | {"doc_id": 10**6, "text": first[0]["text"] + " tail"}
    same = first[1].asDict() | {"doc_id": 10**6 + 1}
    mail = first[2].asDict() | {"doc_id": 10**6 + 2, "text": "unlike all others, write to me@example.org soon"}
    none = first[2].asDict() | {"doc_id": 10**6 + 3, "text": None}
    docs = docs.unionByName(spark.createDataFrame([near, same, mail, none], docs.schema))
    seen = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        rows = out.cache().collect()
        if name == "exact dedup":
            texts = [r["text"] or "" for r in rows]
            assert len(texts) == len(set(texts)) and 10**6 + 1 in {r["doc_id"] for r in rows}
        if name == "n-gram Jaccard join":
            assert 10**6 not in {r["doc_id"] for r in rows}
            left = Counter(c for _, _, c in brute([(r["doc_id"], r["text"]) for r in rows], 5, 80).elements())
            assert max(left.values()) == 1
        if name == "PII":
            got = {r["doc_id"]: r for r in rows}
            assert got[10**6 + 2]["text"].endswith("write to [EMAIL] soon") and got[10**6 + 2]["n_chars"] == len(got[10**6 + 2]["text"])
            assert got[10**6 + 3]["text"] is None
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.collect()} <= seen.keys()
    assert all(len(r["ids"]) == r["length"] for r in packed)


def test_pipeline_run(spark):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 100
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "n-gram Jaccard join", "PII", "best-fit packing"]


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


def test_no_absolute_paths():
    here = os.path.dirname(warc.__file__)
    assert not any("/root/" in open(os.path.join(here, f)).read() for f in os.listdir(here) if f.endswith(".py"))


def test_pipeline_edges(spark, tmp_path):
    """Empty tables, null and repeated ids, repeated rows, columns with clashing names."""
    import corpus_pipeline

    docs = cases.frame(spark)
    twin = cases.rows()[6]
    docs = docs.unionByName(spark.createDataFrame([(twin[0], "another text under an id that repeats") + twin[2:]], cases.SCHEMA))
    labels = spark.createDataFrame([(1, 0, 1), (None, 1, None), (1, 0, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    for name, some in (("full", labels), ("none", labels.limit(0))):
        some.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    for folder, rows in (("full", docs), ("none", docs.limit(0))):
        at = rows
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, at, f"{tmp_path}/{folder}").cache()
            assert out.columns == docs.columns and out.count() <= at.count()
            assert out.filter("doc_id is null").count() == at.filter("doc_id is null").count()
            at = out
        packed = corpus_pipeline.STAGES[-1][1](spark, at, f"{tmp_path}/{folder}")
        if rows.isEmpty():
            assert packed.count() == 0
        else:
            texts = [r["text"] for r in at.collect()]
            assert "another text under an id that repeats" in texts and packed.filter("piece = 0").count() == len(texts)
