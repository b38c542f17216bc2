"""Toxicity, language spans and class-based scores: brute force, small models, held-out accuracy."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import charlm, classlm, langid, toxicity

from . import cases

SF = "/root/testdata/sf0.01"


# --- shared character model


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abzé İ日.\n", max_size=12), min_size=1, max_size=4))
def test_trigram_counts(texts):
    flat, at = charlm.points(texts)
    assert len(at) == len(texts)
    cls = charlm.class_table()
    want = Counter()
    for t in texts:
        b = a = 0
        for ch in t.lower() + "\n":
            c = int(cls[ord(ch)])
            if c or b:
                want[(a * 64 + b) * 64 + c] += 1
            a, b = (b, c) if c and b else (0, c)
    got = charlm.counted(cls[flat])
    assert {i: int(got[i]) for i in np.flatnonzero(got)} == dict(want)


def test_probabilities_sum_to_one():
    table = charlm.log_probabilities(np.random.default_rng(0).integers(0, 5, charlm.CELLS))
    assert np.allclose(np.exp(table.reshape(-1, 64)).sum(axis=1), 1)


# --- toxicity


@pytest.fixture(scope="module")
def restorer():
    texts = ["the loser is an idiot and a clown with stupid trash in the hall will pass all pathetic morons"] * 20
    flat, _ = charlm.points(texts)
    return toxicity.Restorer(charlm.log_probabilities(charlm.counted(charlm.class_table()[flat])))


@pytest.mark.parametrize("noisy,plain", [("l0ser", "loser"), ("LOOOOSER", "loser"), ("1d10t", "idiot"), ("tra$h", "trash"), ("p.a.t.h.e.t.i.c", "pathetic"), ("cl*wn", "clown"), ("hall", "hall"), ("moron", "moron"), ("2024", ""), ("...", "")])
def test_restored_tokens(restorer, noisy, plain):
    assert restorer.restore_token(noisy) == plain


def test_spelled_words_join(restorer):
    assert "stupid" in restorer.spelled("you s t u p i d man")
    assert restorer.spelled("a plain text with | bars | in | it") == []


@settings(max_examples=60, deadline=None)
@given(st.text("aos0$1.", min_size=1, max_size=5))
def test_decode_is_the_best_path(restorer, token):
    """Against all paths of the lattice."""
    options = restorer.edges(token) + [[(" ", 0.0)]]
    paths = [("", 0.0)]
    for edge in options:
        paths = [(t + x, s + c) for t, s in paths for x, c in edge]

    def total(text, cost):
        a = b = 0
        for ch in text:
            c = int(restorer.classes[ord(ch)])
            if c or b:
                cost += restorer.lm[(a * 64 + b) * 64 + c]
            a, b = (b, c) if b and c else (0, c)
        return cost

    best = max(total(t, c) for t, c in paths)
    got = restorer.decode(token)
    assert any(abs(total(t, c) - best) < 1e-9 and " ".join(t.split()) == " ".join(got.split()) for t, c in paths)


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r["doc_id"]: r for r in toxicity.classify(docs, labels).collect()}
    assert len(got) == docs.count()
    right = total = 0
    for r in labels.collect():
        g = got[r["doc_id"]]
        assert g["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= g["score"] <= 1 and g["predicted"] == int(g["score"] >= 0.7)
        if g["held_out"]:
            total += 1
            right += g["predicted"] == r["toxic"]
    assert right / total >= 0.9


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(6, 0, 1), (7, 0, 1), (11, 1, 0), (11, 1, 0), (None, 1, 1), (12, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.classify(cases.frame(spark), labels).collect()
    assert len(got) == len(cases.rows()) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.classify(cases.frame(spark, []), labels).count() == 0
    assert toxicity.classify(cases.frame(spark), labels.limit(0)).count() == len(cases.rows())


def plain_score(model, text):
    """A text's score by the definition: every token, neighbouring tokens and row of single characters decoded."""
    r = toxicity.Restorer(model.table)
    counted = {f.partition("#")[0] for f in model.weights}
    tokens, words = text.split(), set()
    for t in tokens:
        got = r.restore_token(t)
        words.update(got.split())
        if not got:
            words.update(w for w in r.symbols(t).split() if w + "$" in counted)
    whole = {toxicity.SAME.sub(r"\1", f[:-1]) for f in counted if f.endswith("$") and len(f) > 3}
    pieces = [toxicity.SAME.sub(r"\1", r.restore_token(t)) if r.restore_token(t).isalpha() else "" for t in tokens]
    for i in range(len(tokens)):
        for j in range(i + 1, len(tokens)):
            if not all(pieces[i : j + 1]):
                break
            if toxicity.SAME.sub(r"\1", "".join(pieces[i : j + 1])) in whole:
                words.update(w for w in r.together(tokens[i : j + 1]) if w + "$" in counted)
    words.update(r.spelled(text))
    margin = model.bias + sum(model.weights.get(f, 0.0) for f in sorted(toxicity.of_words(words)))
    return 1 / (1 + math.exp(-margin))


def test_scores_match_brute_force(spark, restorer):
    table = np.array(restorer.lm)
    model = toxicity.Model(table, {"stupid$": 2.0, "stup": 1.5, "idiot$": 2.5, "loser$": 1.0, "los#2": 0.7, "trash$": 1.0, "pathe": 0.3}, -2.0)
    score = model.scorer()
    texts = ["you st upid man", "s t u p i d", "l0s3r losers los", "a 1d10t, an IDIOOOT!", "p.a.t.h.e.t.i.c", "", "the hall is all", "tra$h and " + "x" * 90 + "stup1d", "57up1d 1d107"]
    texts += [(r["text"] or "")[:400] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()]
    for t in texts:
        assert abs(score(t) - plain_score(model, t)) < 1e-9, t


def test_repeated_ids_and_long_runs(spark):
    labels = spark.createDataFrame([(i, 0, int(i % 2)) for i in range(40)], "doc_id long, quality int, toxic int")
    rows = [(i, "an idiot here " + "o" * 500 if i % 2 else "a calm day here") for i in range(40)] * 2
    got = toxicity.classify(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()
    assert len(got) == 80 and all(r["predicted"] == r["doc_id"] % 2 for r in got)


def test_drop_toxic_keeps_columns(spark):
    model = toxicity.Model(np.zeros(charlm.CELLS), {"idiot$": 9.0}, -3.0)
    kept = toxicity.drop_toxic(spark.createDataFrame([(1, "an idiot", "x"), (2, "a man", "x"), (3, None, "x")], "doc_id long, text string, score string"), model)
    assert kept.columns == ["doc_id", "text", "score"] and {r["doc_id"] for r in kept.collect()} == {2, 3}


# --- languages


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.tuples(*[st.integers(-9, 0)] * 3), max_size=6), min_size=1, max_size=5))
def test_viterbi_is_the_best_labelling(docs):
    import itertools

    scores = np.array([w for d in docs for w in d], np.float32).reshape(-1, 3)
    doc = np.array([i for i, d in enumerate(docs) for _ in d], np.int64)
    got = langid.viterbi(scores, doc, len(docs), switch=4.0)
    at = 0
    for d in docs:
        n = len(d)
        value = lambda path, d=d: sum(w[k] for w, k in zip(d, path)) - 4.0 * sum(a != b for a, b in zip(path, path[1:]))
        if n:
            assert value(got[at : at + n].tolist()) == max(map(value, itertools.product(range(3), repeat=n)))
        at += n


def test_language_held_out_and_spans(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    held = [(got[r["doc_id"]]["lang_pred"], r["lang"]) for r in docs.collect() if got[r["doc_id"]]["held_out"]]
    assert sum(a == b for a, b in held) / len(held) >= 0.98
    model = langid.fit(docs)
    by = {r["lang"]: r["text"] for r in docs.filter("n_chars > 500").collect()}
    spans = model.spans(by["en"][:300] + " " + by["de"][:300])
    assert [s[2] for s in spans] == ["en", "de"]


def brute_language(model, text):
    """The prediction by the definition: letters, words, candidates, the best labelling, the label with the most letters."""
    import re

    chars, n = text.lower(), len(model.langs)
    words = [m.span() for m in re.finditer("[^\0]+", "".join("x" if model.classes[ord(c)] else "\0" for c in chars))]
    if not words:
        return "und", 0.0
    codes = [int(model.classes[ord(c)]) for c in chars] + [0]
    scores = []
    for s, e in words:
        script = int(langid.script_table()[ord(chars[s])])
        row = []
        for i in range(n):
            total = 0.0
            for at in range(s, e + 1):
                b = codes[at - 1] if at > s else 0
                a = codes[at - 2] if at > s + 1 else 0
                total += float(model.tables[i][(a * 64 + b) * 64 + codes[at]])
            row.append(total if model.writes[i][script] else -1e9)
        scores.append(row)
    best, back = list(scores[0]), []
    for row in scores[1:]:
        came = [max(range(n), key=lambda j, i=i: best[j] - (langid.SWITCH if j != i else 0)) for i in range(n)]
        best = [best[j] - (langid.SWITCH if j != i else 0) + row[i] for i, j in enumerate(came)]
        back.append(came)
    path = [max(range(n), key=best.__getitem__)]
    for came in reversed(back):
        path.append(came[path[-1]])
    letters = [0] * n
    for (s, e), i in zip(words, reversed(path)):
        letters[i] += e - s
    top = max(range(n), key=lambda i: letters[i])
    return model.langs[top], letters[top] / sum(letters)


def test_predictions_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = spark.createDataFrame([(i, "кот сидел на ковре и смотрел", "ru") for i in range(30)], "doc_id long, text string, lang string")
    model = langid.fit(docs.select("doc_id", "text", "lang").unionByName(extra))
    texts = [r["text"] or "" for r in docs.collect() if len(r["text"] or "") < 600][:40]
    texts += [f"{a[:80]} кот сидел {b[:80]} 日本 αβγ" for a, b in zip(texts, texts[1:])][:10] + ["", "12 3", "é", "кот"]
    got = list(zip(*model.predict(texts)))
    for text, (lang, share) in zip(texts, got):
        want = brute_language(model, text)
        assert lang == want[0] and abs(share - want[1]) < 1e-6, text


def test_frequent_letters_have_classes_of_their_own():
    counts = np.zeros(charlm.CODES, np.int64)
    counts[[ord(c) for c in "日本語éab"]] = [9, 8, 7, 6, 5, 4]
    table = charlm.learned_table(counts)
    assert [int(table[ord(c)]) for c in "日本語éab"] == [1, 2, 3, 4, 5, 6] and table[ord("z")] > charlm.OWN and table[ord(" ")] == 0


def test_only_frequent_languages_are_learned(spark):
    rows = [(i, "the cat sat", "en") for i in range(5)] + [(9, "der hund lief", "de"), (10, "x", "junk")]
    assert langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_langs=2).langs == ["de", "en"]


def test_script_narrows(spark):
    rows = [(i, "the cat sat on the mat", "en") for i in range(20)] + [(i, "кот сидел на ковре", "ru") for i in range(20, 40)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.predict(["кот", "cat", "1 2 3", "", "日本"])[0] [:4] == ["ru", "en", "und", "und"]


def test_language_edges(spark):
    got = langid.identify(cases.frame(spark)).collect()
    assert len(got) == len(cases.rows())
    assert {r["lang_pred"] for r in got if r["doc_id"] in (0, 1, 2, 3)} == {"und"}
    assert langid.identify(cases.frame(spark, [])).count() == 0


# --- class-based scores


def check_base(docs, got):
    train = Counter()
    for i, t in docs:
        if zlib.crc32(("null" if i is None else str(i)).encode()) % 7 != 2:
            train.update(classlm.words_of(t))
    n, v = sum(train.values()), len(train)
    want = Counter()
    for i, t in docs:
        ws = classlm.words_of(t)
        base = sum(math.log10((train[w] + 1) / (n + v + 1)) for w in ws)
        want[(i, len(ws), sum(train[w] > 0 for w in ws), n, round(base, 6) + 0.0)] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6) + 0.0) for r in got) == want


def test_base_scores_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(4)
    got = classlm.score_texts(docs, head=300, classes=8).collect()
    check_base([(r["doc_id"], r["text"]) for r in docs.collect()], got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    check_base([(r[0], r[1]) for r in cases.rows()], classlm.score_texts(cases.frame(spark)).collect())
    assert classlm.score_texts(cases.frame(spark, [])).count() == 0
    unseen = classlm.score_texts(spark.createDataFrame([(i, "a b") for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2], "doc_id long, text string")).collect()
    assert {(r["n_known"], r["train_tokens"], round(r["score"], 9)) for r in unseen} == {(0, 0, round(3 * math.log10(0.5), 9))}


def brute_scores(docs, model):
    """Scores by the model's definition, word by word, given the head's classes."""
    trains = [(i, classlm.words_of(t), zlib.crc32(str(i).encode()) % 7 != 2) for i, t in docs]
    count = Counter(w for _, ws, train in trains if train for w in ws)
    k = model.classes
    of = {w: int(c) for w, c in zip(model.head, model.of)}
    left, right = ({w: np.zeros(k + 1) for w in count if w not in of} for _ in range(2))
    for _, ws, train in trains:
        for a, w, b in zip([classlm.END, *ws], ws, [*ws[1:], None]):
            if train and w not in of:
                left[w][of.get(a, k)] += 1
                right[w][of.get(b, k)] += 1
    known = dict(of) | {w: int(model.choose(left[w][None], right[w][None])[0]) for w in left}
    pairs, tokens = np.zeros((k + 1, k)), np.zeros(k)
    for _, ws, train in trains:
        for a, w in zip([classlm.END, *ws], ws):
            if train:
                pairs[known[a], known[w]] += 1
                pairs[k, known[w]] += a not in of
                tokens[known[w]] += 1
    kappa = (sum(c == 1 for c in count.values()) + 1) / (sum(count.values()) + 2)
    out = {}
    for i, ws, _ in trains:
        total = 0.0
        for a, w in zip([classlm.END, *ws], ws):
            row = pairs[known[a] if count[a] else k]
            if count[w]:
                c = known[w]
                total += math.log10((1 - kappa) * (row[c] + 2 * tokens[c] / tokens.sum()) / (row.sum() + 2) * count[w] / tokens[c])
            else:
                total += math.log10(kappa)
        out[i] = total
    return out


def test_class_scores_match_brute_force(spark, monkeypatch):
    for name in ("FLUSH_TEXTS", "FLUSH_BIGRAMS", "COUNTED_WORDS", "BLOCK_WORDS"):
        monkeypatch.setattr(classlm, name, 40)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    train = docs.filter("crc32(cast(cast(doc_id as string) as binary)) % 7 <> 2")
    model = classlm.fit(train, head=200, classes=6)
    count = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in classlm.words_of(t))
    top = sorted((w for w in count if w != classlm.END), key=lambda w: (-count[w], w))[:199]
    assert model.head == [classlm.END, *top] and model.counts.tolist() == [count[w] for w in model.head]
    want = brute_scores(rows, model)
    got = {r["doc_id"]: r["score"] for r in classlm.score_texts(docs, head=200, classes=6).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-9, abs_tol=1e-6) for i in want)
    # after any word the words that were seen and the unknown one share one
    other = {r["doc_id"]: r["score"] for r in classlm.score_texts(docs.repartition(7), head=200, classes=6).collect()}
    assert all(math.isclose(other[i], want[i], rel_tol=1e-9) for i in want)


def test_neighbours_of_a_bigram_table(spark):
    texts = ["a b a c", "b b zz", "a q a", ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    words = [classlm.END, b"a", b"b"]
    of = np.array([0, 1, 0, 2])
    right, left, own = classlm.neighbours(classlm.bigram_table(df, words), of, 3)
    want_r, want_l, want_o = np.zeros((4, 3)), np.zeros((4, 3)), np.zeros(4)
    for t in texts:
        ids = [words.index(w) if w in words else 3 for w in [classlm.END, *classlm.words_of(t)]]
        for x, y in zip(ids, ids[1:]):
            want_r[x, of[y]] += 1
            want_l[y, of[x]] += 1
            want_o[x] += x == y
    assert (right == want_r).all() and (left == want_l).all() and (own == want_o).all()


def dense(pairs):
    """``neighbours`` of a square count matrix, whose last unit stands for all other words."""

    def count(of):
        one = np.eye(of.max() + 1)[of]
        return pairs @ one, pairs.T @ one, np.diag(pairs).copy()

    return count


def test_exchange_never_lowers_the_likelihood():
    rng = np.random.default_rng(2)
    n = 60
    pairs = np.zeros((n + 1, n + 1))
    pairs[:n, :n] = rng.integers(0, 6, (n, n)) + 20 * (np.arange(n)[:, None] % 3 == (np.arange(n)[None, :] + 1) % 3)
    start = np.append(np.arange(n) % 5, 5)
    of, table = classlm.exchange(dense(pairs), n, pairs.sum(axis=1)[:n], classes=5, tolerance=1e-9)
    assert classlm.likelihood(table) >= classlm.likelihood(classlm.class_table(dense(pairs)(start)[0], start, 6))
    of, _ = classlm.exchange(dense(pairs), n, pairs.sum(axis=1)[:n], classes=3, tolerance=1e-9)
    assert all(len(set(of[k::3].tolist())) == 1 for k in range(3)) and len(set(of.tolist())) == 3
