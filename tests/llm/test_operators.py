"""Every corpus operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import json
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loam.llm import bpe, embeddings, fingerprints, html, jaccard, language, mixing, toxicity, urls, warc

TEXT = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor sit amet " * 40_000


def awkward(spark, **extra):
    """Documents with nulls everywhere, empties, a very long text, ties and repeated rows, and clashing extra columns."""
    rows = [
        (1, "the cat sat on the mat and looked at the dog", "en", "a", 1),
        (1, "the cat sat on the mat and looked at the dog", "en", "a", 1),
        (2, "the cat sat on the mat and looked at the dog", "en", None, None),
        (3, "", "en", "a", 0),
        (4, None, None, None, None),
        (None, "a text without an id", "en", "b", 3),
        (5, LONG, "de", "b", 9),
        (6, "   \n\t ", "de", "b", 2),
        (7, "ä | 12 ß €uro 日本語 \U0001f600", "xx", "b", 2),
    ]
    df = spark.createDataFrame(rows, TEXT)
    for name, value in extra.items():
        df = df.withColumn(name, F.lit(value))
    return df


def rows_by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# -- op2 ------------------------------------------------------------------------------------------------


def test_bpe_agrees_with_a_reference_encoder_and_round_trips(spark):
    import base64

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.DEFAULT_VOCABULARY, "rb"))}
    exact = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = bpe.bpe_encode(awkward(spark, token_ids="clash", N_Tokens=5)).collect()
    assert len(out) == 9
    for r in out:
        if r["text"] is None:
            assert r["n_tokens"] is None and r["token_ids"] is None and r["round_trip"] is None
        else:
            assert r["token_ids"] == exact.encode_ordinary(r["text"]) and r["round_trip"]
    back = bpe.bpe_decode(bpe.bpe_encode(awkward(spark))).collect()
    assert all(r["decoded"] == r["text"] for r in back)


def test_bpe_of_the_whole_table_agrees_with_a_reference_encoder(spark):
    import base64

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.DEFAULT_VOCABULARY, "rb"))}
    exact = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = bpe.op2_bpe(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(texts)
    assert all(r["token_ids"] == exact.encode_ordinary(texts[r["doc_id"]]) and r["n_tokens"] == len(r["token_ids"]) and r["round_trip"] for r in got)


def test_bpe_round_trip_tells_wrong_ids():
    words = bpe._loaded(bpe.DEFAULT_VOCABULARY)
    texts = pa.array(["abc", None, "", "xyz", "same"])
    ids = [words.merge(t) for t in (b"abc", b"", b"", b"xyq", b"longer")]
    flat, at = np.concatenate([np.array(x, np.int64) for x in ids]), np.cumsum([0, *map(len, ids)])
    assert bpe.same_bytes(words, flat, at, texts).tolist() == [True, True, True, False, False]


def test_bpe_of_no_rows(spark):
    assert bpe.bpe_encode(awkward(spark).limit(0)).count() == 0


# -- op4 ------------------------------------------------------------------------------------------------


def test_language_accuracy_on_held_out_documents(spark, small):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text <> ''")
    model = language.train(docs.where("doc_id % 2 = 0"))
    held = language.identify_language(docs.where("doc_id % 2 = 1"), model)
    good, total = held.agg(F.count_if(F.col("lang_pred") == F.col("lang")), F.count("*")).first()
    assert good / total > 0.97


def plain_code_length(samples, text):
    """Code length of ``text`` by order-3 prediction by partial matching, method C with exclusion, in 1/256 bit a byte."""
    counts = {}
    for t in samples:
        full = language.START + t
        for i in range(3, len(full)):
            for k in range(4):
                inner = counts.setdefault(full[i - k : i], {})
                inner[full[i]] = inner.get(full[i], 0) + 1
    full, total = language.START + text, 0
    for i in range(3, len(full)):
        ruled_out, bits = set(), 0.0
        for k in (3, 2, 1, 0):
            left = {x: n for x, n in counts.get(full[i - k : i], {}).items() if x not in ruled_out}
            whole = sum(left.values()) + len(left)
            if full[i] in left:
                bits += np.log2(whole / left[full[i]])
                break
            if left:
                bits += np.log2(whole / len(left))
            ruled_out |= set(left)
        else:
            bits += np.log2(256 - len(ruled_out))
        total += round(min(bits, 60) * 256)
    return total


def test_language_code_lengths_match_a_plain_reading():
    samples = {"a": [b"abababab", b"abba", b""], "b": [b"xyxyxy", "größe".encode()], "c": []}
    model = language.ContextModel.build(samples)
    texts = ["abab", "xyzz", "q", "", "größer als \0 \x7f", "ab" * 50 + "x"]
    sums = model.code_lengths(pa.array(texts))
    assert sums.tolist() == [[plain_code_length(samples[k], t.encode()) for k in "abc"] for t in texts]


def test_language_query_against_a_plain_reading(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = language.train(docs)
    rows = {r["doc_id"]: r for r in docs.collect()}
    samples = {}
    for r in rows.values():
        if len(r["text"]) <= language.TRAIN_CHARS:
            samples.setdefault(r["lang"], []).append(r["text"].encode())
    assert all(len(x) <= language.TRAIN_DOCS for x in samples.values()) and model.languages == tuple(sorted(samples))
    got = language.op4_language(spark, small).collect()
    assert len(got) == len(rows)
    for r in got[:25]:
        text = rows[r["doc_id"]]["text"].encode()[:10_000]
        if len(text) < 10_000 and text:
            costs = sorted((plain_code_length(samples[x], text), x) for x in samples)
            assert (r["lang_pred"], round(r["bits_per_byte"] * 256 * len(text)), round(r["margin_bits"] * 256)) == (costs[0][1], costs[0][0], costs[1][0] - costs[0][0])


def test_language_edges(spark):
    docs = awkward(spark, lang_pred="clash")
    out = language.identify_language(docs, language.train(docs)).collect()
    assert len(out) == 9
    by = {r["doc_id"]: r for r in out}
    assert by[3]["lang_pred"] == by[4]["lang_pred"] == "und" and by[4]["bits_per_byte"] is None
    empty = docs.limit(0)
    assert language.identify_language(empty, language.train(empty)).count() == 0


# -- op5 ------------------------------------------------------------------------------------------------


def test_raking_meets_all_marginals():
    rng = np.random.default_rng(3)
    of = [rng.integers(0, 4, 60), rng.integers(0, 3, 60), rng.integers(0, 2, 60)]
    mass = rng.random(60) * 100
    targets = [np.array([0.4, 0.3, 0.2, 0.1]), np.array([0.5, 0.3, 0.2]), np.array([0.6, 0.4])]
    w = mixing.rake(mass, of, targets, rounds=200)
    for index, share in zip(of, targets):
        assert np.allclose(np.bincount(index, w), share, atol=1e-6)
    p = mixing.probabilities(mass, w, 0.5)
    assert p.max() <= 1 and abs((p * mass).sum() - 0.5 * mass.sum()) < 1e-6


def test_mixing_edges(spark):
    out = mixing.mix(awkward(spark, kept="clash", topic="clash"))
    rows = out.collect()
    assert len(rows) == 9 and out.columns.count("kept") == 1
    assert all(0 <= r["probability"] <= 1 and r["kept"] is not None for r in rows)
    assert {r["topic"] for r in rows} == {"prose", "table", mixing.NONE}
    assert mixing.mix(awkward(spark).limit(0)).count() == 0
    kept = mixing.keep_mixed(awkward(spark, topic="own"))
    assert kept.columns == [*awkward(spark).columns, "topic"]


@pytest.mark.parametrize("cells", [0, 100_000])
def test_mixing_is_alike_however_its_cells_are_joined(spark, small, monkeypatch, cells):
    monkeypatch.setattr(mixing, "BROADCAST_CELLS", cells)
    df = mixing.op5_mixing(spark, small)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert ("strategy=broadcast" in plan) == (cells > 0)
    assert df.agg(F.sum(F.hash("doc_id", "topic", "probability", "kept").cast("long"))).first()[0] == mixing.mix(spark.read.parquet(f"{small}/documents.parquet")).agg(F.sum(F.hash("doc_id", "topic", "probability", "kept").cast("long"))).first()[0]


def test_mixing_moves_towards_targets(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), F.when(F.col("id") % 4 == 0, "rare").otherwise("big").alias("source"), F.lit("en").alias("lang"))
    got = mixing.mix(docs, targets={"source": {"rare": 0.5, "big": 0.5}}, keep=0.4).where("kept").groupBy("source").agg(F.sum("tokens").alias("n")).collect()
    n = {r["source"]: r["n"] for r in got}
    assert abs(n["rare"] / (n["rare"] + n["big"]) - 0.5) < 0.05 and abs((n["rare"] + n["big"]) / 12000 - 0.4) < 0.03


# -- op7 ------------------------------------------------------------------------------------------------


def test_toxicity_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.train(docs, labels.where("doc_id % 2 = 0"))
    truth = labels.where("doc_id % 2 = 1").select("doc_id", F.col("toxic").alias("truth"))
    held = [(r["text"], r["severity"], r["toxic"], r["truth"]) for r in toxicity.grade_toxicity(docs.join(truth, "doc_id"), model).collect()]
    hit = sum(t and y for _, _, t, y in held)
    assert hit / sum(y for *_, y in held) > 0.9 and hit / sum(t for _, _, t, _ in held) > 0.9
    # Severity of held-out toxic documents rises with the number of their toxic-sided words, found in the held-out labels themselves.
    text, feature, whole = toxicity.features(pa.array([t for t, *_ in held]))
    count = toxicity.occurrences(text[:whole], feature[:whole], np.array([y for *_, y in held]))
    some = np.array([bool(y) for *_, y in held])
    ranks = [np.argsort(np.argsort(z[some], kind="stable"), kind="stable") for z in (np.array([s for _, s, _, _ in held]), count)]
    assert np.corrcoef(*ranks)[0, 1] > 0.6


def plain_features(text):
    import re

    found = set()
    for word in re.findall(rb"[0-9a-z\x80-\xff]+", text.lower().encode()):
        found |= {(0, word)} | {(k, word[:k]) for k in (4, 5) if len(word) > k}
    return found


def test_toxicity_query_against_a_plain_reading(spark, small):
    """Features of every document by a plain reading, and severity, grade and verdict from the model's weights one document at a time."""
    docs, labels = (spark.read.parquet(f"{small}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r for r in toxicity.op7_toxicity(spark, small).collect()}
    assert got.keys() == texts.keys() and len(model.weights) > 3
    number = {}
    for kind, name in {f for t in texts.values() for f in plain_features(t)}:
        text, feature, whole = toxicity.features(pa.array([name.decode("latin-1") if kind == 0 and name.isascii() else (name + b"zz").decode("utf-8", "replace")]))
        if name.isascii():
            spot = 0 if kind == 0 else whole + (kind == 5 and len(feature) > whole + 1)
            number[kind, name] = int(feature[spot])
    weight = {int(k): float(w) for k, w in zip(model.place.keys[model.place.keys >= 0], model.weights[model.place.values[model.place.keys >= 0]])}
    for k, t in texts.items():
        names = plain_features(t)
        if not all(n.isascii() for _, n in names):
            continue
        score = sum(weight.get(number[f], 0.0) for f in names)
        over = [1 / (1 + np.exp(th - score)) for th in model.thresholds]
        odds = -np.diff([1.0, *over, 0.0])
        assert abs(got[k]["severity"] - sum(over)) < 1e-6 and got[k]["toxic"] == (sum(over) >= toxicity.REJECT_AT) and got[k]["grade"] == int(np.argmax(odds))


def test_toxicity_fit_has_no_slope_left():
    """The fitted weights and thresholds of a small sample can't be bettered by a scalar search of the penalised loss."""
    rng = np.random.default_rng(0)
    texts = [f"{'awful ' * (k % 3 > 0)}{'foul ' * (k % 3 > 1)}w{rng.integers(9)} common" for k in range(300)]
    grades = np.array([k % 3 if rng.random() > 0.1 else int(rng.integers(3)) for k in range(300)])
    pairs = sorted({(k, f) for k, t in enumerate(texts) for f in toxicity.features(pa.array([t]))[1].tolist()})
    model = toxicity.fit(np.array([p for p, _ in pairs]), np.array([f for _, f in pairs]), grades, np.ones(300))
    weight = dict(zip(model.place.keys[model.place.keys >= 0].tolist(), model.weights[model.place.values[model.place.keys >= 0]].tolist()))

    def loss(w, theta):
        total = toxicity.L1 * sum(map(abs, w.values()))
        for k, g in enumerate(grades):
            x = sum(w.get(f, 0.0) for p, f in pairs_of[k])
            edges = [0.0, *(1 / (1 + np.exp(x - t)) for t in theta), 1.0]
            total -= np.log(edges[g + 1] - edges[g]) / 300
        return total

    pairs_of = {k: [p for p in pairs if p[0] == k] for k in range(300)}
    best, theta = loss(weight, model.thresholds), list(model.thresholds)
    assert len(theta) == 2 and theta[0] < theta[1] and len(weight) >= 2
    for f in list(weight)[:4]:
        assert all(loss(weight | {f: weight[f] + d}, theta) > best - 2e-3 for d in (-0.3, 0.3))
    for k in (0, 1):
        assert all(loss(weight, [t + d * (j == k) for j, t in enumerate(theta)]) > best - 2e-3 for d in (-0.3, 0.3))


def test_toxicity_shares_weights_across_ordered_thresholds():
    _, feature, _ = toxicity.features(pa.array(["bad"]))
    model = toxicity.OrdinalModel.of(feature, np.array([2.0]), (0.5, 1.5))
    assert model.scores(pa.array(["a bad, BAD thing", "badly", None, ""])).tolist() == [2.0, 0.0, 0.0, 0.0]
    low, high = model.severity(np.array([0.0, 2.0]))
    none = toxicity.OrdinalModel.of(np.zeros(0, np.int64), np.zeros(0), (0.5, 4.5))
    assert low < high and none.grades(np.array([-5.0, 2.5, 9.0])).tolist() == [0, 1, 2] and none.scores(pa.array(["x"])).tolist() == [0]
    assert abs(high - sum(1 / (1 + np.exp(t - 2.0)) for t in (0.5, 1.5))) < 1e-9


def test_toxicity_edges(spark):
    docs = awkward(spark, severity="clash", grade=1)
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 0, 1), (5, 0, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.grade_toxicity(docs, toxicity.train(docs, labels))
    rows = out.collect()
    assert len(rows) == 9 and all(r["severity"] is not None for r in rows)
    assert toxicity.grade_toxicity(docs.limit(0), toxicity.train(docs.limit(0), labels)).count() == 0


# -- op6 ------------------------------------------------------------------------------------------------


def gram_set(text, n=3):
    w = [x for x in __import__("re").split("[\x00-\x20]+", text.lower()) if x]
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def linked(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def joined_by_hand(rows, t=0.6):
    """(least id of the gram set, links, class) of every id by comparing all gram sets with each other, and the pairs of sets; ids are unique."""
    sets = {k: frozenset(gram_set(x or "")) for k, x in rows}
    least = {}
    for k in sorted(sets):
        if sets[k]:
            least.setdefault(sets[k], k)
    reps = sorted((len(x), k) for x, k in least.items())
    pairs = {}
    for i, (n, a) in enumerate(reps):
        for m, b in reps[i + 1 :]:
            if n < t * m - 1e-9:
                break
            both = len(sets[a] & sets[b])
            if both >= t * (n + m - both) - 1e-9:
                pairs[min(a, b), max(a, b)] = both / (n + m - both)
    root = linked([*pairs, *((least[x], k) for k, x in sets.items() if x)])
    links = __import__("collections").Counter(x for p in pairs for x in p)
    return {k: (least.get(x, k), links[least.get(x, k)] if x else 0, root.get(k, k)) for k, x in sets.items()}, pairs


def joined(df):
    return {r["doc_id"]: (r["copy_of"], r["n_links"], r["class_id"]) for r in df.collect()}


def test_jaccard_join_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want, pairs = joined_by_hand([tuple(r) for r in docs.collect()])
    assert len(pairs) > 50 and joined(jaccard.jaccard_join(docs)) == want
    got = {(r["doc_a"], r["doc_b"]): r["jaccard"] for r in jaccard.set_pairs(docs).collect()}
    assert got.keys() == pairs.keys() and all(abs(got[p] - j) < 1e-9 for p, j in pairs.items())


@pytest.mark.parametrize("size", [5, 9, 18, 40, 120, 300, 900, 4000])
def test_jaccard_join_finds_pairs_near_the_threshold(spark, size):
    rng = np.random.default_rng(size)
    rows, pairs = [], []
    for k in range(150 if size < 1000 else 60):
        words = [f"w{x}" for x in rng.integers(0, 1 << 40, size)]
        other = list(words)
        for at in rng.choice(size, max(1, size // 14), replace=False):
            other[at] = f"v{rng.integers(0, 1 << 40)}"
        if size < 9:
            other = words[:-1]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        a, b = gram_set(rows[-2][1]), gram_set(rows[-1][1])
        if len(a & b) / len(a | b) >= 0.6:
            pairs.append((2 * k, 2 * k + 1))
    got = {(r["doc_a"], r["doc_b"]) for r in jaccard.set_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(pairs) > 10 and got <= set(pairs) and (got == set(pairs) if size < 90 else len(got) >= 0.98 * len(pairs))


@pytest.mark.parametrize("tile", [3, 4096])
def test_jaccard_join_loses_no_link_of_a_large_group(spark, monkeypatch, tile):
    """Near copies of one text, exact copies of those, and short texts that share a block, whatever the size of a tile."""
    monkeypatch.setattr(jaccard, "TILE", tile)
    words = [f"w{k}" for k in range(200)]
    near = lambda k: " ".join([*words[:k], f"x{k}", *words[k + 1 :]])
    texts = [" ".join(words)] * 4 + [near(4 * k) for k in range(1, 45)] * 2 + [f"{near(50)} {near(90)} y"]
    texts += [f"one common head of {k} {k} {k}" for k in range(30)] + ["one common head", "one common head of"]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want, pairs = joined_by_hand(rows)
    assert len(pairs) > 900 and joined(jaccard.jaccard_join(docs)) == want
    assert {(r["doc_a"], r["doc_b"]) for r in jaccard.set_pairs(docs).collect()} == set(pairs)
    assert {r["doc_id"] for r in jaccard.keep_one_of_each(docs).collect()} == {g for _, _, g in want.values()}


@pytest.mark.parametrize("kind", ["dense", "sparse"])
def test_overlaps_count_common_grams(kind):
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 40 if kind == "dense" else 4000, 30)).astype(np.uint64) for _ in range(70)]
    row = np.repeat(np.arange(70), [len(x) for x in sets])
    for a, got in jaccard.overlaps(np.concatenate(sets), row, 70):
        assert all(got[i, j] == len(np.intersect1d(sets[a + i], sets[j])) for i in range(len(got)) for j in range(70) if a + i != j)


def test_jaccard_edges(spark):
    docs = awkward(spark, class_id="clash", copy_of=1)
    out = jaccard.jaccard_join(docs)
    rows = sorted((tuple(r) for r in out.collect()), key=str)
    assert out.columns == ["doc_id", "class_id", "copy_of", "n_links"]
    assert rows == sorted([(1, 1, 1, 0), (1, 1, 1, 0), (2, 1, 1, 0), *((k, k, k, 0) for k in (3, 4, 5, 6, 7, None))], key=str)
    kept = jaccard.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=lambda x: (x is None, x))
    assert ids == [1, 3, 4, 5, 6, 7, None]
    assert jaccard.jaccard_join(docs.limit(0)).count() == 0 and jaccard.keep_one_of_each(docs.limit(0)).count() == 0
    named = docs.select(F.concat(F.lit("u"), "doc_id").alias("doc_id"), "text")
    assert {r["class_id"] for r in jaccard.jaccard_join(named).where("doc_id = 'u2'").collect()} == {"u1"}
    twice = spark.createDataFrame([(0, "the b c d"), (0, "a b c d e f"), (9, "a b c d e f")], "doc_id long, text string")
    assert [r["text"] for r in jaccard.keep_one_of_each(twice).collect()] == ["a b c d e f"]


# -- op10 -----------------------------------------------------------------------------------------------


def plain_fingerprint(grams, bins=fingerprints.BINS, bits=fingerprints.BITS):
    """Packed one-permutation MinHash of a list of shingle hashes, one shingle and one bin at a time."""
    mix = lambda x: int(fingerprints.mix64(np.array([x], np.uint64))[0])
    least = {}
    for g in set(grams):
        spot, low = (g >> (64 - (bins - 1).bit_length())) % bins, mix(g) >> 1
        least[spot] = min(low, least.get(spot, low))
    if not least:
        return None
    out = 0
    for i in range(bins):
        k, attempt = i, 0
        while k not in least:
            k, attempt = int(fingerprints.donors(bins, attempt + 1)[attempt][i]), attempt + 1
        out |= (least[k] & ((1 << bits) - 1)) << (i * bits)
    return out.to_bytes(bins * bits // 8, "little")


def test_fingerprint_query_against_a_plain_reading(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = fingerprints.op10_fingerprints(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(texts)
    for r in got:
        grams = fingerprints.ngrams(pa.array([texts[r["doc_id"]]]), fingerprints.SHINGLE)[0].tolist()
        words = len([x for x in __import__("re").split("[\x00-\x20]+", texts[r["doc_id"]]) if x])
        assert r["n_shingles"] == len(grams) == max(min(words, 1), words - fingerprints.SHINGLE + 1)
        if len(grams) < 3000:
            want = plain_fingerprint(grams)
            assert (None if r["fingerprint"] is None else bytes(r["fingerprint"])) == want


@pytest.mark.parametrize("bins, bits", [(1024, 4), (128, 4), (512, 12)])
def test_fingerprints_estimate_jaccard(spark, bins, bits):
    """Within four standard errors, on average within one, over pairs of known similarity."""
    rng = np.random.default_rng(1)
    rows, true = [], []
    for k in range(40):
        words = [f"w{x}" for x in rng.integers(0, 1 << 40, 800)]
        kept = int(rng.integers(50, 800))
        rows.append((" ".join(words), " ".join(words[:kept] + [f"z{x}" for x in rng.integers(0, 1 << 40, 800 - kept)])))
        a, b = (gram_set(t) for t in rows[-1])
        true.append(len(a & b) / len(a | b))
    df = spark.createDataFrame([*rows, (None, "x"), ("", "y z")], "a string, b string")
    each = lambda c: fingerprints.fingerprint(F.col(c), bins, bits)["fingerprint"]
    got = [r[0] for r in df.select(each("a").alias("a"), each("b").alias("b")).select(fingerprints.estimate_jaccard(F.col("a"), F.col("b"), bins, bits)).collect()]
    assert got[40:] == [None, None]
    error = np.abs(np.array(got[:40]) - true)
    assert error.max() < 4 / np.sqrt(bins) * 0.6 and error.mean() < 1 / np.sqrt(bins) * 0.6


@pytest.mark.parametrize("bins, bits", [(1, 4), (128, 0), (128, 33)])
def test_fingerprints_of_no_use_are_refused(bins, bits):
    with pytest.raises(ValueError):
        fingerprints.checked(bins, bits)


def test_densification_fills_every_bin_from_a_full_one():
    _, empty, packed = fingerprints.sketch(pa.array(["one two three four"]), 128, 4, 3)
    assert empty[0] >= 126 and len(packed[0]) == 64
    minima = np.array([[5, 0, 7, 0]], np.uint64)
    filled = fingerprints.densify(minima, np.array([[False, True, False, True]]))
    assert set(filled[0].tolist()) == {5, 7}


def test_fingerprint_edges(spark):
    out = fingerprints.document_fingerprints(awkward(spark, fingerprint="clash")).collect()
    by = {r["doc_id"]: r for r in out}
    assert len(out) == 9 and by[1]["fingerprint"] == by[2]["fingerprint"]
    assert by[3]["fingerprint"] is None and by[4]["n_shingles"] == 0 and by[6]["n_empty_bins"] == 128
    assert fingerprints.document_fingerprints(awkward(spark).limit(0)).count() == 0


# -- op1 ------------------------------------------------------------------------------------------------


def vectors_of(spark, x):
    return spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")


def groups_by_hand(x, threshold=0.95):
    """Group of every row by all cosines, in blocks; and the pairs at the threshold or over."""
    x = embeddings.unit(x)
    hits = [np.argwhere(np.triu(x[k : k + 2000] @ x.T >= threshold, k + 1)) + [k, 0] for k in range(0, len(x), 2000)]
    pairs = [tuple(p) for h in hits for p in h.tolist()]
    root = linked(pairs)
    return [root.get(k, k) for k in range(len(x))], pairs


@pytest.mark.parametrize("rows", [300, 4000])
def test_embedding_groups_against_brute_force(spark, monkeypatch, rows):
    """Near pairs, a hot group of near-equal vectors, equal ones, and ranges and passes cut small."""
    monkeypatch.setattr(embeddings, "RANGE_ROWS", 500)
    monkeypatch.setattr(embeddings, "COPIES_AT_ONCE", 10_000)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(rows, 64))
    near = base[: rows // 3] + rng.normal(size=(rows // 3, 64)) * 0.16
    hot = np.repeat(base[:1], rows // 2, axis=0) + rng.normal(size=(rows // 2, 64)) * 0.05
    x = np.concatenate([base, near, hot, np.repeat(base[7:8], rows // 4, axis=0)]).astype(np.float32)
    want, pairs = groups_by_hand(x)
    out = {r["vec_id"]: r for r in embeddings.near_dedup(vectors_of(spark, x)).collect()}
    got = [out[k]["group_id"] for k in range(len(x))]
    assert len(pairs) > rows and sum(got[a] == got[b] for a, b in pairs) >= embeddings.MEET * len(pairs)
    assert all(want[g] == w for g, w in zip(got, want)) and all(r["kept"] == (r["group_id"] == k) for k, r in out.items())


@pytest.mark.parametrize("sf", ["sf0.1", "check_s"])
def test_embedding_query_against_brute_force(spark, sf):
    """No pair of sf0.1 is near; check_s has groups."""
    if not os.path.exists(folder := f"/root/testdata/{sf}"):
        pytest.skip(f"{sf} isn't here")
    rows = sorted(tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect())
    want, pairs = groups_by_hand(np.array([v for _, v in rows]))
    got = {r["vec_id"]: r["group_id"] for r in embeddings.op1_embeddings(spark, folder).collect()}
    ids = [k for k, _ in rows]
    place = {k: i for i, k in enumerate(ids)}
    assert (len(pairs) > 50) == (sf == "check_s") and len(got) == len(ids) and sum(got[ids[a]] == got[ids[b]] for a, b in pairs) >= embeddings.MEET * len(pairs)
    assert all(want[place[got[k]]] == w for k, w in zip(ids, want))


def test_passes_follow_the_corpus_size():
    assert embeddings.passes_needed(10) == 1
    assert 1 < embeddings.passes_needed(50_000) < embeddings.passes_needed(10**9)


def test_embedding_recall_where_all_vectors_are_alike(spark):
    rng = np.random.default_rng(5)
    g = lambda n: rng.standard_normal((n, 64)) / 8
    x = embeddings.unit(np.sqrt(0.8) * embeddings.unit(g(1)) + np.sqrt(0.2) * g(6000))
    x[1:1000:2] = embeddings.unit(x[0:1000:2] + 0.3 * g(500))
    _, pairs = groups_by_hand(x, 0.951)
    got = {r["vec_id"]: r["group_id"] for r in embeddings.near_dedup(vectors_of(spark, x)).collect()}
    assert len(pairs) > 200 and sum(got[a] == got[b] for a, b in pairs) >= 0.97 * len(pairs)


def test_embedding_edges(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (None, [1.0, 0.0]), (4, []), (5, [0.0, 0.0]), (6, [None, 1.0]), (7, [1.0, 2.0, 3.0]), (8, [float("nan"), 1.0]), (9, [2.0, 4.0, 6.0]), (10, [0.0, 1.0]), (11, [0.0, 1.0]), (11, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("kept", F.lit("clash"))
    out = embeddings.near_dedup(df).collect()
    by = {r["vec_id"]: r for r in out}
    assert len(out) == 14 and by[2]["group_id"] == 1 and not by[2]["kept"] and by[1]["kept"]
    assert all(by[k]["kept"] and by[k]["group_id"] == k for k in (3, 4, 5, 6, 7, 8)) and by[None]["kept"] and by[None]["group_id"] is None
    assert by[9]["group_id"] == 7 and by[10]["group_id"] == by[11]["group_id"] == 1
    assert embeddings.near_dedup(df.limit(0)).count() == 0
    named = df.select(F.concat(F.lit("v"), "vec_id").alias("vec_id"), "embedding")
    assert {r["group_id"] for r in embeddings.near_dedup(named).where("vec_id = 'v2'").collect()} == {"v1"}
    long = spark.createDataFrame([(k, [float(k % 2), 1.0] * 30_000) for k in range(4)], "vec_id long, embedding array<float>")
    assert sorted(r["group_id"] for r in embeddings.near_dedup(long).collect()) == [0, 0, 1, 1]


# -- op3 ------------------------------------------------------------------------------------------------


def record(kind, ident, to=(), block=b"x", uri="http://h/"):
    return {"record_id": ident, "type": kind, "uri": uri, "date": "d", "concurrent_to": list(to), "content_type": "t", "block": block}


@pytest.mark.parametrize("packed", [False, True])
def test_warc_records_survive_writing_and_reading(tmp_path, spark, packed):
    records = [record("response", "urn:r", block=b"HTTP/1.1 404 No\r\n\r\nbody\r\n\r\nWARC/1.0\r\n"), record("request", "urn:q", ["urn:r", "urn:z"]), record("warcinfo", "urn:i", block=b"")]
    data = b"".join((warc.zlib_member if packed else bytes)(warc.write_record(r)) for r in records)
    path = tmp_path / "a.warc"
    path.write_bytes(data)
    assert [r.asDict() | {"block": bytes(r["block"])} for r in warc.read_warc(spark, [str(path)]).collect()] == records
    cut_off = spark.createDataFrame([(data[:-30],), (None,), (b"",)], "content binary")
    assert warc.parse_warc(cut_off).count() == 2


def test_warc_reads_on_after_a_damaged_member():
    import io

    records = [record("response", f"urn:{k}", block=bytes([65 + k]) * 3000 + os.urandom(4000)) for k in range(6)]
    members = [warc.zlib_member(warc.write_record(r)) for r in records]
    for bad in range(6):
        data = bytearray(b"".join(members))
        at = sum(map(len, members[:bad])) + len(members[bad]) // 2
        data[at : at + 40] = b"\xff" * 40
        got = [r["record_id"] for r in warc.read_records(io.BufferedReader(io.BytesIO(bytes(data))))]
        assert got == [f"urn:{k}" for k in range(6) if k != bad], bad
    assert [r["record_id"] for r in warc.read_records(io.BytesIO(b"\x1f\x8bjunk" + b"".join(members)))] == [f"urn:{k}" for k in range(6)]


def test_warc_query_equals_its_sql_on_hard_pages(spark, tmp_path):
    """Null and repeated page ids, recrawls, full repeats, null URLs and pages, and a very long page."""
    import duckdb

    rows = [(1, "http://a/b?c", "x"), (1, "http://a/b?c", "x"), (1, "http://a/b?c", "another"), (None, "http://n/", "y"), (None, "http://n/", "z"), (None, None, None), (2, None, "q"), (3, "", ""), (-4, "http://m", LONG), (5, "http://u/#f", "\u00e4\r\n\r\nWARC/1.0\r\n")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    df = warc.op3_warc(spark, str(tmp_path))
    assert sorted((tuple(r) for r in df.collect()), key=str) == sorted(con.sql(warc.WARC_SQL).select(*df.columns).fetchall(), key=str)


def test_warc_files_are_read_by_scheme_too(spark, tmp_path):
    path = tmp_path / "a.warc.gz"
    path.write_bytes(warc.zlib_member(warc.write_record(record("response", "urn:r"))))
    assert warc.read_warc(spark, [f"file://{path}"]).count() == warc.read_warc(spark, [str(path)]).count() == 1


def test_warc_transactions(spark):
    head = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n"
    rows = [
        record("response", "r1", block=head + b"one"), record("request", "q1", ["r1"], b"GET 1"), record("metadata", "m1", ["q1"], b"M1"), record("metadata", "m0", ["r1"], b"M0"),
        record("request", "q2", [], b"GET 2"), record("response", "r2", ["q2"], head), record("response", "r2", ["q2"], head),
        record("resource", "r3", block=b"no head"), record("metadata", "lost", ["nowhere"]), record("warcinfo", "i"), record("request", None, ["r3"], b"GET 3"), record(None, "n"),
    ]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], warc.RECORD_DDL).withColumn("status", F.lit("clash"))
    out = {r["record_id"]: r for r in warc.assemble(df).collect()}
    assert sorted(out) == ["r1", "r2", "r3"]
    assert bytes(out["r1"]["payload"]) == b"one" and out["r1"]["status"] == 200 and out["r1"]["request"]["record_id"] == "q1"
    assert [m["record_id"] for m in out["r1"]["metadata"]] == ["m0", "m1"]
    assert bytes(out["r2"]["request"]["block"]) == b"GET 2" and out["r2"]["metadata"] == []
    assert out["r3"]["status"] is None and bytes(out["r3"]["payload"]) == b"no head" and bytes(out["r3"]["request"]["block"]) == b"GET 3"
    assert warc.assemble(df.limit(0)).count() == 0


# -- op8 ------------------------------------------------------------------------------------------------


def test_html_labeller_gradient_is_the_slope_of_the_loss():
    rng, model = np.random.default_rng(0), html.Labeller(1)
    pages = [rng.normal(size=(k, html.PATH_DIM + html.WORD_DIM + html.SIZE_DIM)).astype(np.float32) for k in (3, 5)]
    labels = [np.array([1, 0, 1], np.float32), np.array([0, 0, 1, 1, 0], np.float32)]
    g, _ = model.gradient(pages, labels)
    for k, w in model.w.items():
        at, step, held = tuple(s // 2 for s in w.shape), 1e-2, w[tuple(s // 2 for s in w.shape)].copy()
        w[at] = held + step
        up = model.gradient(pages, labels)[1]
        w[at] = held - step
        down = model.gradient(pages, labels)[1]
        w[at] = held
        assert abs(g[k][at] - (up - down) / 2 / step) < 1e-4


def test_html_held_out_accuracy(spark):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").collect()]
    model = html.fit_pages(pages[:120])
    good = total = 0
    for p in pages[120:]:
        blocks = html.blocks_of(p)
        truth = html.weak_labels(blocks)
        got = model.label([html.vectors(blocks, [b.text for b in blocks], np.ones(len(blocks), bool))])[0] >= 0.5
        good += (got == truth).sum()
        total += len(truth)
    assert good / total > 0.95


def test_html_batching_changes_nothing():
    rng, model = np.random.default_rng(0), html.Labeller(2)
    pages = [rng.normal(size=(k, html.PATH_DIM + html.WORD_DIM + html.SIZE_DIM)).astype(np.float32) for k in (1, 700, 0, 3, 50)]
    together = model.label(pages)
    for p, q in zip(pages, together):
        assert np.allclose(model.label([p])[0] if len(p) else q, q, atol=1e-5)


def plain_labels(model, x):
    """Probabilities of one page's blocks, one gate of one unit at a time."""
    sig = lambda z: 1 / (1 + np.exp(-z))
    states = []
    for d, rows in (("f", x), ("b", x[::-1])):
        h, c, out = [0.0] * html.HIDDEN, [0.0] * html.HIDDEN, []
        for row in rows.astype(float):
            z = row @ model.w["x" + d].astype(float) + np.array(h) @ model.w["h" + d].astype(float)
            for u in range(html.HIDDEN):
                i, f, o, g = z[u], z[html.HIDDEN + u] + 1, z[2 * html.HIDDEN + u], z[3 * html.HIDDEN + u]
                c[u] = sig(f) * c[u] + sig(i) * np.tanh(g)
                h[u] = sig(o) * np.tanh(c[u])
            out.append(list(h))
        states.append(out if d == "f" else out[::-1])
    w = model.w["o"][:, 0].astype(float)
    return [sig(np.array([*a, *b, 1.0]) @ w) for a, b in zip(*states)]


def test_html_query_against_a_plain_network(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    model = html.train(pages)
    got = {r["page_id"]: r for r in html.op8_html(spark, small).collect()}
    given = {r["page_id"]: r["html"] for r in pages.collect()}
    assert got.keys() == given.keys()
    for k, page in given.items():
        blocks = html.blocks_of(page)
        texts = [b.text for b in blocks]
        p = plain_labels(model, html.vectors(blocks, texts))
        assert all(abs(q - 0.5) > 1e-4 for q in p)
        assert (got[k]["n_blocks"], got[k]["main_text"]) == (len(blocks), "\n".join(t for t, q in zip(texts, p) if q >= 0.5))


@pytest.mark.parametrize("part", ["<a ", "<div>", "<div>x", "<div class='a b'><p>", "</div><div>", "<!", "<!--", "<script ", '<p title="', "<a '<b \"", "&amp"])
def test_html_pages_of_a_megabyte_end_soon(part):
    import time

    model, began = html.Labeller(1), time.time()
    n, _, text = html.answer(model, [part * (1_000_000 // len(part))])[0]
    assert time.time() - began < 60 and text is not None and (n > 100_000) == (part == "<div>x")


def test_html_paths_are_read_from_the_root_down():
    blocks = html.blocks_of("<main id=x><div class='a b'>one</div></nav><ul><li>two<li>three</ul></main><p>four")
    assert [b.path for b in blocks] == [("main", ".x", "div", ".a", ".b"), ("main", ".x", "ul", "li"), ("main", ".x", "ul", "li"), ("p",)]
    assert html.weak_labels(blocks).tolist() == [1, 1, 1, 0] and blocks[1].at is blocks[2].at
    plain = html.path_vector(html.blocks_of("<div><ul><li>x")[0].at)
    assert np.array_equal(html.path_vector(blocks[1].at, True), html.path_vector(html.blocks_of("<b2 id=x><ul><li>x")[0].at, True)) == False  # noqa: E712
    assert not np.array_equal(html.path_vector(blocks[1].at), plain)


def test_html_blocks_and_edges(spark):
    page = "<html><!-- x --><body><nav><a href='#'>Home</a></nav><script>var t='</p>';</script><article><p>One &amp; <b>two<br><p>Three</article>tail"
    assert [(b.text, b.path[-1]) for b in html.blocks_of(page)] == [("Home", "nav"), ("One & two", "p"), ("Three", "p"), ("tail", "body")]
    rows = [(1, page), (1, page), (2, None), (3, ""), (None, "plain"), (4, "<p>" * 3000 + "deep"), (5, "<div>" + LONG + "</div>"), (6, "<<<>>> < p >")]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("main_text", F.lit("clash"))
    out = html.extract_main_text(df, html.train(df)).collect()
    by = {r["page_id"]: r for r in out}
    assert len(out) == 8 and by[2]["main_text"] is None and by[3]["main_text"] == "" and by[3]["n_blocks"] == 0 and by[None]["n_blocks"] == 1
    assert html.extract_main_text(df.limit(0), html.train(df.limit(0))).count() == 0


# -- op9 ------------------------------------------------------------------------------------------------


def test_url_templates(spark):
    rows = [(k, f"https://H.example/{s}/item/{k}?utm_x=1&b={k}&a", bad) for s, bad in (("spam", 1), ("news", 0), ("blog", 0), ("faq", 0)) for k in range(30)]
    rows += [(1000 + k, f"http://wide.example/u{chr(97 + k)}/x", 0) for k in range(26)]
    rows += [(2000, None, 1), (2001, "", None), (None, "not a url", None), (2002, "http://h.example/" + "d/" * 9000, None), (2002, "http://h.example/" + "d/" * 9000, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, bad int").withColumn("purity", F.lit("clash"))
    out = urls.filter_urls(df, F.col("bad")).collect()
    assert len(out) == len(rows)
    named = {(r["template"], r["rejected"]) for r in out if r["page_id"] is not None and r["page_id"] < 2000}
    assert named == {("h.example/spam/item/*/?a&b", True), ("h.example/*-/item/*/?a&b", False), ("wide.example/*/x", False)}
    odd = [r for r in out if r["page_id"] in (2000, 2001)]
    assert all(r["template"] is None and not r["rejected"] for r in odd)
    assert urls.filter_urls(df.limit(0), F.col("bad")).count() == 0


@pytest.mark.parametrize("labels", [50, 5])
def test_url_siblings_of_a_bad_directory_stay_apart_however_many(spark, labels):
    rows = [(f"http://h.example/spam/{k}", 1) for k in range(300)]
    rows += [(f"http://h.example/d{chr(97 + d)}/{k}", 0) for d in range(20) for k in range(labels)]
    out = urls.filter_urls(spark.createDataFrame(rows, "url string, bad int"), F.col("bad")).collect()
    assert len(out) == len(rows) and all(r["rejected"] == bool(r["bad"]) for r in out)


def test_url_branches_below_any_depth_are_told_apart(spark):
    deep = "/en/news/2024/05/02" + "/x" * 300
    rows = [(f"http://h.example/en/news/2024/05/02/{s}/{k}", bad) for s, bad in (("casino-offers", 1), ("local-news", 0)) for k in range(40)]
    rows += [(f"http://q.example{deep}/{k}?{name}=1", bad) for name, bad in (("win", 1), ("page", 0)) for k in range(40)]
    rows += [("http://q.example/en" + "/d" * n, None) for n in range(1, 9)]
    rows += [(f"http://clean.example/{k}", 0) for k in range(40)]
    out = urls.filter_urls(spark.createDataFrame(rows, "url string, bad int"), F.col("bad")).collect()
    assert len(out) == len(rows) and all(r["rejected"] == (r["bad"] == 1) for r in out)
    assert "h.example/en/news/*/*/*/casino-offers/*" in {r["template"] for r in out}


def test_url_filter_equals_its_sql_on_hard_urls(spark, tmp_path):
    """Slashes in parameter names, 21 siblings, deep paths, ties, nulls and repeats."""
    import duckdb

    rows = [(k, f"http://f.example/index.php?/topic/{k}-a&b", "<p>fine</p>") for k in range(12)]
    rows += [(k, f"http://f.example/index.php/?/topic/{k}-a", "<p>fine</p>") for k in range(3)]
    rows += [(k, f"http://h.example/s{chr(97 + k % 21)}/{k}", "%%%***" * 9 if k % 21 == 3 else "<p>fine</p>") for k in range(630)]
    rows += [(k, f"http://d.example/{'x/' * (k % 12)}casino{k}", "t") for k in range(90)] + [(k, f"http://d.example/{'x/' * (k % 9)}news{k}", "t") for k in range(90)]
    rows += [(k, f"http://t.example/{'spam' if k % 2 else 'ham'}/{k % 4}/p", "t") for k in range(16)]
    rows += [(1, None, "x"), (2, "", None), (None, "http://h.example/sa/1", None), (3, "http://h.example/sa/1", None), (3, "http://h.example/sa/1", None), (4, "?a=1", "x"), (5, "http://h.example", "x")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    df = urls.op9_urls(spark, str(tmp_path))
    got = sorted((tuple(r) for r in df.collect()), key=str)
    want = con.sql(urls.URLS_SQL).select(*df.columns).fetchall()
    assert len(got) == len(rows) and got == sorted(want, key=str)
    bad = [r for r in got if r[1] and "h.example/sd/" in r[1]]
    assert len(bad) == 30 and all(r[-1] for r in bad)


def test_rows_are_json_friendly(spark):
    assert json.loads(fingerprints.document_fingerprints(awkward(spark)).drop("text").toJSON().first())
