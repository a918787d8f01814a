import collections
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from pageloom.llm import language, licenses, maxent, quality, queries, simhash
from pageloom.llm.components import components
from pageloom.llm.oracles import ORACLES

SPACE = r"[\x20\x09-\x0D]+"


def lower(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def words(text):
    return [w for w in re.split(SPACE, text or "") if w]


def docs_of(spark, corpus):
    return spark.read.parquet(f"{corpus}/documents.parquet").collect()


def joined(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def fingerprint(text):
    w = words(lower(text))
    shingles = [" ".join(w)] if 0 < len(w) < 3 else [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_covering_masks_leave_no_close_pair_apart():
    kept = [m % (1 << 64) for m in simhash.masks(2)]
    assert all(any(not m >> i & 1 and not m >> j & 1 for m in kept) for i, j in itertools.combinations(range(64), 2))


def test_op9_against_all_pairs(spark, documents, odd):
    random.seed(2)
    base = [random.choice("abcdefgh") * random.randint(1, 3) for _ in range(300)]
    texts = [*odd, *(" ".join([*base[:k], "new", *base[k + 1 :]]) for k in range(0, 300, 4))]
    fps = [fingerprint(t) for t in texts]
    expected = joined([(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if (fps[i] ^ fps[j]).bit_count() <= 2], range(len(texts)))
    docs = documents(*texts).withColumn("fp", F.lit("clash"))
    found = simhash.near_duplicates(docs.unionAll(docs.where("doc_id = 0")).unionAll(docs.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long"))))
    rows = found.select("doc_id", simhash.hex16(F.col("fp")).alias("h"), "component_id").collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        i = 3 if r.doc_id is None else r.doc_id
        assert (int(r.h, 16), r.component_id) == (fps[i], expected[i])
    assert simhash.near_duplicates(documents()).count() == 0


def test_components_of_random_graphs(spark):
    random.seed(6)
    edges = [(random.randrange(400), random.randrange(400)) for _ in range(300)] + [(1000, k) for k in range(1001, 1200)] + [(k, k + 1) for k in range(2000, 2060)]
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    expected = joined(edges, nodes)
    found = components(spark.createDataFrame([*edges, (None, 5), (7, None)], "a long, b long"), "test").collect()
    assert {r.node: r.root for r in found} == expected and len(found) == len(nodes)


def test_near_duplicate_stage_keeps_one_of_each(documents, odd):
    kept = simhash.without_near_duplicates(documents(*odd))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3, 5, 6, 7, 8, 9, 10]
    assert kept.columns == documents().columns
    assert simhash.without_near_duplicates(documents()).count() == 0


def test_near_duplicate_stage_against_all_pairs(spark, corpus):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fps = {r.doc_id: fingerprint(r.text) for r in docs.collect()}
    links = [(a, b) for a, b in itertools.combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 2]
    true = joined(links, fps)
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in fps if true[i] == i) and 0 < kept.count() < len(fps)


def test_near_duplicate_stage_keeps_unlike_texts_without_an_id_of_their_own(spark):
    texts = [" ".join(f"{c}{(i * i) % 37}" for i in range(80)) for c in "abcdefg"]
    rows = [(None, texts[0]), (None, texts[1]), (1, texts[2]), (1, texts[3]), (1, texts[3]), (2, texts[4]), (None, texts[4]), (3, texts[5]), (2, texts[5]), (None, texts[6]), (None, texts[6])]
    docs = spark.createDataFrame([(i, t, k, "x") for k, (i, t) in enumerate(rows)], "doc_id long, text string, fp long, `a.key` string").repartition(3)
    kept = simhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    found = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(found, key=str) == sorted([(None, texts[0]), (None, texts[1]), (1, texts[2]), (1, texts[3]), (2, texts[4]), (2, texts[5]), (None, texts[6])], key=str)


def base_rules(text):
    w = words(text)
    seen = collections.defaultdict(list)
    for i in range(len(w) - 2):
        seen[tuple(w[i : i + 3])].append(i)
    repeated = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated),
            len(w) < 50 or 100 * len(repeated) > 50 * len(w))


def test_op5_base_rules(spark, documents, odd):
    texts = [*odd, "a b c a b c a b c d e", "x y z\n" * 30, "one\ntwo\n\none\n \none"]
    found = {r.doc_id: r._quality for r in quality.with_quality(documents(*texts).withColumn("kept", F.lit(0))).collect()}
    for i, t in enumerate(texts):
        assert tuple(found[i])[:6] == base_rules(t), t
    assert quality.clean_rows(documents()).count() == 0


def test_lines_decide(documents):
    prose = "This is a line of quiet prose that ends as it should, with a full stop. " * 3
    bar = "Home | News | Sport | Weather | Shop | Help | More | About | Jobs | Mail | Radio | TV"
    texts = [f"{prose}\n{' '.join(f'word{i}' for i in range(60))}.", "\n".join([bar + f" | {i}" for i in range(9)]), " ".join(f"W{i}!!" for i in range(80)), " ".join(f"w{i}### x{i}%%%" for i in range(60))]
    rows = {r.doc_id: r._quality for r in quality.with_quality(documents(*texts)).collect()}
    assert [rows[i].kept for i in range(4)] == [True, False, False, False]
    assert [r.doc_id for r in quality.clean_rows(documents(*texts)).collect()] == [0]


def test_a_phrase_in_a_long_line_does_not_fail_it(documents):
    prose = " ".join(f"word{i}" for i in range(60))
    texts = [f"{prose} a design in two parts, a blog in print and our privacy policy in short.", f"{prose} said.\nA design in two parts, a catalog in print.", f"{prose} said.\nPlease read our privacy policy.",
             f"{prose} said.\nSign in.", " ".join(f"click here word{i}" for i in range(60)) + "."]
    rows = {r.doc_id: r._quality for r in quality.with_quality(documents(*texts)).collect()}
    assert [rows[i].kept for i in range(5)] == [True, True, True, True, False]
    assert [rows[i].clean_text == texts[i] for i in range(4)] == [True, True, False, False]


def test_sql_of_the_quality_rules_knows_whole_phrases_and_long_lines(spark):
    phrases = ["please sign in now", "a design in two", "sign in sign in", "a blog in here", "LOG IN today", "accept all cookies,", "xlorem ipsum dolor", "über sign inn 1log in", "log in", "lorem ipsum-"]
    long = "our privacy policy explains at length"
    texts = ["\n".join(" ".join(f"w{k}x{j}" for j in range(8)) + f" {p}." for k in range(12)) for p in phrases]
    texts += ["\n".join(" ".join(f"w{k}x{j}" for j in range(n)) + f" {long}." for k in range(12)) for n in (8, 9, 20)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality.with_quality(df).select("doc_id", "_quality.*").collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    rel = con.sql(ORACLES["op5_quality_rules"])
    at = {c: i for i, c in enumerate(rel.columns)}
    assert {r[at["doc_id"]]: (r[at["base_failed"]], r[at["kept"]]) for r in rel.fetchall()} == got
    assert [got[i] for i in range(len(texts))] == [(False, k) for k in (False, True, False, True, False, False, True, True, False, False, False, True, True)]


def test_op6_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    truth = {r.doc_id: (r.lang, r.text) for r in docs_of(spark, sf_dir)}
    rows = queries.op6_language_id(spark, sf_dir).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows) and len(rows) == len(truth)
    assert sum(r.lang_pred == truth[r.doc_id][0] for r in held) >= 0.97 * len(held)


def test_language_of_mixtures_and_odd_texts(spark, documents, odd):
    rows = [("the house and the garden with the dog of the man " * 4, "en"), ("das haus und der garten mit dem hund und die frau " * 4, "de")]
    model = language.learn(spark.createDataFrame([*rows, (None, "en"), ("x", None)], "text string, lang string"))
    mixed = "the dog and the man with the house of the garden and das haus und der garten mit dem hund und die frau mit dem haus"
    (langs, shares), (one, _) = model.propose([mixed, "the dog of the man"])
    assert sorted(langs) == ["de", "en"] and abs(sum(shares) - 1) < 1e-6 and one == ["en"]
    found = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(documents(*odd), model, ["doc_id"]).collect()}
    assert [found[i][0] == "und" for i in range(6)] == [True, True, True, False, False, True]
    empty = language.learn(spark.createDataFrame([], "text string, lang string"))
    assert {r.lang_pred for r in language.identify(documents(*odd), empty, ["doc_id"]).collect()} == {"und"}
    assert language.with_a_language(documents(*odd), empty).count() == 0


def test_the_languages_of_a_text_do_not_depend_on_its_batch(spark, corpus):
    rows = spark.read.parquet(f"{corpus}/documents.parquet").where("text IS NOT NULL")
    model = language.learn(rows)
    texts = [r.text for r in rows.orderBy("doc_id").limit(60).collect() if language.letters(r.text)]
    halves = [t[: len(t) // 2] + " " + u[len(u) // 3 :] for t, u in zip(texts, texts[1:])]  # mixtures, of which some gain by a second language
    mixed = texts[:20] + halves + ["xq zzv kkj", "a", "der the la que"]
    together = model.propose(mixed)
    assert {len(langs) for langs, _ in together} >= {1, 2}
    for text, (langs, shares) in zip(mixed, together):
        (alone, own), = model.propose([text])
        assert alone == langs and np.allclose(own, shares, atol=1e-4)


def test_tables_grow_with_the_vocabulary():
    sizes = [maxent.past_rows(n) for n in (0, 1, 10**4, 10**6, 10**8, 10**12)]
    assert sizes == [1 << 10, 1 << 10, 1 << 10, 1 << 13, 1 << 17, 1 << 18]


def test_rows_of_the_model_are_averaged_over_the_tasks_that_met_them(spark):
    """A word that one task of many meets moves the classes as far as in that task alone."""
    schema = "doc_id long, text string"
    one = spark.createDataFrame([(0, "rare end " * 50)], schema).coalesce(1)
    other = spark.createDataFrame([(1, "other words " * 50)], schema).coalesce(1)
    model, _ = maxent.learn(one.union(other), F.lit(True), most_frequent=4)
    tokens = maxent.tokens_of(pa.array(["rare end " * 50]))
    rows, label = maxent.features_of(tokens, model.past), maxent.classes_of(tokens.words, model.own)[tokens.code]
    alone = maxent.Trainer(model.bias, len(model.weights))
    alone.learn(rows, label)
    others = maxent.features_of(maxent.tokens_of(pa.array(["other words " * 50])), model.past)
    only = np.setdiff1d(rows, others)
    assert len(only) and np.allclose(model.weights[only], alone.weights[only], atol=1e-6) and np.abs(alone.weights[only]).max() > 0


def plain_mixture(model, text):
    """Proportions and chosen languages by loops over words and languages."""
    padded = b"  " + re.sub(SPACE, " ", text.lower()).encode() + b" "
    likes = []
    for found in re.finditer(rb"[^ ]+", padded):
        at = [model.log_p[language.trigram_buckets(np.frombuffer(padded[i - 2 : i + 1], np.uint8))[0]].astype(float) for i in range(found.start(), found.end() + 1)]
        likes.append(sum(at))
    share = [1 / len(model.languages)] * len(model.languages)
    for _ in range(model.rounds):
        parts = []
        for like in likes:
            joint = [s * math.exp(x - max(like)) for s, x in zip(share, like, strict=True)]
            parts.append([j / sum(joint) for j in joint])
        share = [sum(p[i] for p in parts) / len(parts) for i in range(len(share))]
    order = sorted(range(len(share)), key=lambda i: -share[i])
    best, size = -math.inf, 1
    for k in range(1, len(order) + 1):
        whole = sum(share[i] for i in order[:k])
        value = sum(math.log(max(1e-30, sum(share[i] / whole * math.exp(like[i] - max(like)) for i in order[:k]))) for like in likes)
        value -= model.penalty * (k - 1) * math.log(len(likes) + 1)
        if value <= best + 1e-6:
            break
        best, size = value, k
    whole = sum(share[i] for i in order[:size])
    return {model.languages[i]: share[i] / whole for i in order[:size]}


def test_mixtures_against_plain_expectation_maximisation(spark, corpus):
    rows = spark.read.parquet(f"{corpus}/documents.parquet").where("text IS NOT NULL")
    model = language.learn(rows)
    texts = [r.text for r in rows.orderBy("doc_id").limit(30).collect() if language.letters(r.text) and "\0" not in r.text]
    texts += [f"{a[:400]} {b[:700]}" for a, b in zip(texts, reversed(texts), strict=True)] + ["a", "the ñ ü"]
    for text, (langs, shares) in zip(texts, model.propose(texts), strict=True):
        plain = plain_mixture(model, text)
        assert set(langs) == set(plain) and all(abs(plain[x] - p) < 1e-3 for x, p in zip(langs, shares, strict=True))


def test_noise_is_in_no_language(spark, documents):
    corpus = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.learn(corpus)
    rng = random.Random(5)
    noise = [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(n)) for n in (60, 300, 5000)
             for letters in ("bcdfghjklmnpqrstvwxz", "абвгдежзиклмн", "abcdefghijklmnopqrstuvwxyz")]
    clean = ["The committee met on Tuesday and agreed that the garden behind the library should be kept open for another year. " * 3, "buy now", "mail ab3f9c0de4477821 to xkq.95@mail0.example.com or 4792160228539108"]
    table = documents(*noise, *clean, None, "123").withColumn("score", F.lit(7)).withColumn("_text", F.lit("x"))
    found = {r.doc_id: r for r in language.identify(table, model, table.columns).collect()}
    assert [found[i].is_language for i in range(len(found))] == [False] * len(noise) + [True] * 3 + [False] * 2
    assert all(0 <= r.score <= 1 and (r.lang_pred == "und") == (i >= len(noise) + 3) for i, r in found.items())
    kept = language.with_a_language(table, model)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {len(noise), len(noise) + 1, len(noise) + 2}
    lettered = corpus.where(F.col("text").rlike("[A-Za-z]"))
    assert language.identify(lettered, model, ["doc_id"]).where("NOT is_language").count() == 0


def test_op4_kernels_against_plain_loops(odd):
    rng = np.random.default_rng(2)
    for n, size in ((1, 4), (7, 3), (500, 40), (3000, 100000)):
        rows, values = rng.integers(0, size, n), rng.normal(size=(n, maxent.CLASSES)).astype(np.float32)
        which, times, sums = maxent.sums_by_row(rows, values)
        assert which.tolist() == sorted(set(rows.tolist())) and times.sum() == n
        assert all(t == (rows == r).sum() and np.allclose(s, values[rows == r].sum(axis=0), atol=1e-4) for r, t, s in zip(which, times, sums, strict=True))
        assert np.array_equal(maxent.across(np.maximum, values)[:, 0], values.max(axis=1))
    weights, bias = rng.normal(size=(30, maxent.CLASSES)).astype(np.float32) * 40, rng.normal(size=maxent.CLASSES).astype(np.float32)
    rows = rng.integers(0, 30, (3, 50))
    for k, found in enumerate(maxent.log_softmax(weights, bias, rows)):
        logits = [math.fsum([bias[c], *(weights[r[k], c] for r in rows)]) for c in range(maxent.CLASSES)]
        whole = max(logits) + math.log(math.fsum(math.exp(x - max(logits)) for x in logits))
        assert np.allclose(found, [x - whole for x in logits], atol=1e-3)
    listed = pa.array(["", "a", "the", "é", "lang", "ng", "x" * 300])
    own = pa.array(["the"])
    for some in (listed, listed.slice(2, 4), listed.slice(0, 0)):
        plain = []
        for w in some.to_pylist():
            one, two = ([*w.encode()[::-1], 0, 0])[:2]
            plain.append(0 if not w else 1 if w == "the" else 1 + maxent.OWN_CLASS + ((one * 257 + two) * 40503 >> 4) % maxent.SUFFIX_CLASSES)
        assert maxent.classes_of(some, own).tolist() == plain


def test_op4_learns_by_one_rate_a_row():
    """Batches with rows that stand there once, often and with very large logits move the weights as plain loops do."""
    rng = np.random.default_rng(3)
    bias = rng.normal(size=(5, maxent.CLASSES)).astype(np.float32)
    for n, size, scale in ((60, 400, 0), (300, 4, 1), (300, 30, 60)):
        trainer = maxent.Trainer(bias, 3 * size)
        trainer.weights += scale * rng.normal(size=trainer.weights.shape).astype(np.float32)
        plain = trainer.weights.astype(float)
        rows = rng.integers(0, size, (3, n)) + size * np.arange(3)[:, None]
        label, node = rng.integers(0, maxent.CLASSES, n), rng.integers(0, 5, n)
        gradient = np.zeros_like(plain)
        for (a, b, c), y, k in zip(rows.T, label, node, strict=True):
            logits = plain[a] + plain[b] + plain[c] + bias[k]
            error = np.exp(logits - logits.max())
            error /= error.sum()
            error[y] -= 1
            for row in (a, b, c):
                gradient[row] += error
        squares = maxent.FIRST_SQUARES + (gradient**2).sum(axis=1)
        trainer.learn(rows, label, node)
        assert trainer.squares.shape == (3 * size,) and np.allclose(trainer.squares, squares, rtol=1e-3)
        assert np.allclose(trainer.weights, plain - maxent.RATE * gradient / np.sqrt(squares)[:, None], atol=1e-3)
        assert np.array_equal(trainer.seen, np.bincount(rows.ravel(), minlength=3 * size))


def test_hashes_of_words_depend_on_the_word_alone():
    listed = ["", "a", "b", "aa", "a\0", "12345678", "123456789", "1234567x9", "é" * 20, "y" * 64, "x" * 65, "x" * 300, *(f"w{i}" for i in range(5000))]
    words = pa.array(listed)
    found = maxent.hashes_of(words)
    assert len(set(found.tolist())) == len(listed) and found.dtype == np.uint64
    assert [maxent.hashes_of(pa.array([w]))[0] for w in listed[:20]] == found[:20].tolist()
    assert np.array_equal(maxent.hashes_of(words.slice(3, 12)), found[3:15]) and not len(maxent.hashes_of(words.slice(0, 0)))
    assert all(abs((found[12:] >> np.uint64(bit) & np.uint64(1)).mean() - 0.5) < 0.05 for bit in range(64))


def test_op10_base_places(spark, documents, odd):
    texts = [*odd, "Released under the MIT License. under the mit license", "Licensed under the Apache License, Version 2.0.", "CC BY-NC 4.0 cc-by-nc, xcc by nc",
             "Licensed under the GNU General Public License, version 3", "free software: Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"]
    rows = {r.doc_id: r for r in licenses.scan(documents(*texts).withColumn("found", F.lit(1))).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        places = sorted((k, x) for x, p in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        assert rows[i].n_words == len(w) and [tuple(p) for p in rows[i].places] == places
    assert [x.label for x in rows[len(texts) - 2].found] == ["gpl-3"] and [x.label for x in rows[len(texts) - 1].found] == ["mit"]
    assert not any(rows[i].found for i in range(len(odd))) and licenses.scan(documents()).count() == 0


def plain_licences(w):
    """Labels and scores from every template at every word, the notice's other words by a plain common subsequence."""
    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = list(itertools.accumulate(range(len(b)), lambda left, j, x=x, old=row: old[j] + 1 if x == b[j] else max(left, old[j + 1]), initial=0))
        return row[-1]

    found = {}
    for t in licenses.templates():
        text, key = [x.decode() for x in t.words], [x.decode() for x in t.key]
        n, at = len(key), len(t.before)
        for i in range(len(w) - n + 1):
            if w[i : i + n] != key:
                continue
            lead, tail = w[max(0, i - at - licenses.STRAY) : i] if at else [], w[i + n : i + len(text) - at + licenses.STRAY] if at + n < len(text) else []
            also = " ".join(x.decode() for x in t.also or [])
            if also and not any(f" {also} " in f" {' '.join(side)} " for side in (lead, tail)):
                continue
            score = (n + common(text[:at], lead) + common(text[at + n :], tail)) / len(text)
            if score >= licenses.LEAST_SCORE:
                found[t.label] = max(score, found.get(t.label, 0))
    return found


def test_op10_labels_against_every_place(documents):
    rng = random.Random(3)
    texts = []
    for t in licenses.templates():
        notice = [x.decode() for x in t.words]
        for changes in range(5):
            w = list(notice)
            for _ in range(changes):
                if rng.random() < 0.5:
                    del w[rng.randrange(len(w))]
                else:
                    w.insert(rng.randrange(len(w) + 1), rng.choice(["the", "license", "extra", "mit", "software"]))
                w = w or ["the"]
            around = [rng.choice(["the", "of", "public", "license", "word"]) for _ in range(20)]
            texts.append(" ".join([*around[: rng.randrange(20)], *w, *around]))
    texts.append(" ".join(texts))
    rows = licenses.scan(documents(*texts)).collect()
    for r in rows:
        found = {x.label: x.score for x in r.found}
        assert found == plain_licences(texts[r.doc_id].split()), texts[r.doc_id]
        if r.doc_id % 5 == 0 and r.doc_id < len(texts) - 1:  # unchanged notices
            assert found[licenses.templates()[r.doc_id // 5].label] == 1


def test_op10_changed_notices(documents):
    mit = "Permission is hereby granted, free of charge, to any legal person obtaining a copy of this software and associated documentation files, to deal in Software without any restriction"
    gpl = "under the terms of the GNU General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version"
    texts = {mit: ["mit"], gpl.format(2): ["gpl-2"], gpl.format(3): ["gpl-3"], gpl.replace("General", "Lesser General").format("2.1"): ["lgpl-2.1"],
             "// SPDX-License-Identifier: MIT": ["mit"], "SPDX-License-Identifier: GPL-3.0-only": ["gpl-3"], "see http://www.apache.org/licenses/LICENSE-2.0 there": ["apache-2"],
             "permission is granted free of charge": [], "free of charge hereby granted is permission": []}
    rows = licenses.scan(documents(*texts)).collect()
    assert [[x.label for x in r.found] for r in sorted(rows, key=lambda r: r.doc_id)] == list(texts.values())
    once = licenses.RareWordIndex(licenses.templates(), 0, {})
    many = licenses.words_of((mit + " . ") * 20000 + "license " * 100000)
    assert once.find(many) == once.find(licenses.words_of(mit))


def test_op4_base_and_model(spark, corpus):
    texts = {r.doc_id: r.text for r in docs_of(spark, corpus)}
    tokens = {k: [*words(lower(t)), ""] for k, t in texts.items()}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in texts}
    counts = collections.Counter(w for k, t in tokens.items() if not held[k] for w in t)
    n, v = sum(counts.values()), len(counts)
    rows = queries.op4_language_model(spark, corpus).collect()
    for r in rows:
        t = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(counts[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_context_tells_the_words_of_a_class_apart(spark, monkeypatch):
    """Two words as frequent as each other that end alike: which comes is told by the word before, in groups as well."""
    common = " ".join(f"w{i}" for i in range(maxent.OWN_CLASS))
    docs = spark.createDataFrame([(i, f"red kaab {common} blue maab {common} " * 200) for i in range(200)], "doc_id long, text string").coalesce(1)
    asked = maxent.tokens_of(pa.array([f"w14 {colour} {word}" for colour, word in (("red", "kaab"), ("red", "maab"), ("blue", "kaab"), ("blue", "maab"))]))
    monkeypatch.setattr(maxent, "levels_of", lambda n: 3)
    for own_words in (True, False):
        if not own_words:
            monkeypatch.setattr(maxent, "tree_of", lambda frequent, n: maxent.Tree(3, frequent[:15], np.zeros(15, int), np.arange(1, 16)))
        model, _ = maxent.learn(docs, F.lit(True))
        found = maxent.class_scores(model, asked)
        model.weights[4 * model.past :] = 0
        found -= maxent.class_scores(model, asked)  # what the context does within classes
        assert found[0] > found[1] + 0.5 and found[3] > found[2] + 0.5


def test_class_scores_against_plain_loops(documents, odd, monkeypatch):
    """The factors multiplied token by token, and the words of the tree share all of the probability."""
    monkeypatch.setattr(maxent, "levels_of", lambda n: 3)
    many = [" ".join(f"{k}ab" for k in range(60)), " ".join(f"{k}xy" for k in range(40)) * 2]
    model, counts = maxent.learn(documents(*odd, *many), F.lit(True), most_frequent=50)
    n_of, tree = {r.word: r.n for r in counts.collect()}, model.tree
    texts = pa.array(["the cat 3ab 59ab unseen", "", "7xy 7xy 1ab"])
    tokens = maxent.tokens_of(texts)
    hashes = maxent.hashes_of(tokens.words)
    slots, contexts = tree.slots(tokens.words, hashes), maxent.contexts_of(tokens, hashes)
    at, slot, inner = maxent.inner_features(contexts, slots, tokens.code, model.past)
    rows = maxent.features_of(tokens, model.past)

    def log_p(bias, three, label):
        logits = [math.fsum([bias[c], *(model.weights[r, c] for r in three)]) for c in range(maxent.CLASSES)]
        return logits[label] - max(logits) - math.log(math.fsum(math.exp(x - max(logits)) for x in logits))

    plain, last = [0.0] * len(tokens.code), {}
    for t, code in enumerate(tokens.code):
        plain[t] += log_p(model.bias, rows[:, t], slots[0, code])
        last[t] = slots[0, code]
    for i, t in enumerate(at):
        plain[t] += log_p(model.inner_bias[slot[i] // maxent.CLASSES], inner[:, i], slot[i] % maxent.CLASSES)
        last[t] = slot[i]
    per_token = [p / math.log(10) - model.log_mass[last[t]] for t, p in enumerate(plain)]
    assert np.allclose(maxent.class_scores(model, tokens), [sum(per_token[a:b]) for a, b in zip(tokens.first, [*tokens.first[1:], len(plain)], strict=True)], atol=1e-3)
    assert set(at) == {t for t, code in enumerate(tokens.code) if slots[0, code] > maxent.OWN_CLASS} and len(at) > 4

    words = pa.array(list(n_of), pa.string())
    paths = tree.slots(words, maxent.hashes_of(words))
    logits = model.inner_bias + np.random.default_rng(3).normal(size=model.inner_bias.shape)
    p = np.exp(logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))).reshape(-1)
    mass, total = 10**model.log_mass, 0.0
    reach = np.ones(len(model.inner_bias))  # of each node
    for k in range(1, tree.levels):
        for node in range(maxent.SUFFIX_CLASSES * maxent.GROUPS ** (k - 1)):
            up = 1 + maxent.OWN_CLASS + node if k == 1 else (
                maxent.CLASSES * (tree.first[k - 1] + node // maxent.GROUPS) + maxent.OWN_WORDS + node % maxent.GROUPS)
            reach[tree.first[k] + node] = reach[up // maxent.CLASSES] * p[up]
    for w, path in zip(words.to_pylist(), paths.T, strict=True):
        end = path[path >= 0][-1]
        total += reach[end // maxent.CLASSES] * p[end] * (n_of[w] + 1) / mass[end]
    for node in range(tree.first[-2], tree.first[-1]):  # an unknown word in each last group
        for group in range(maxent.OWN_WORDS, maxent.CLASSES):
            total += reach[node] * p[node * maxent.CLASSES + group] / mass[node * maxent.CLASSES + group]
    assert math.isclose(total, 1, abs_tol=1e-5)


def test_class_probabilities_sum_to_one(documents, odd):
    docs = documents(*odd)
    model, counts = maxent.learn(docs, F.lit(True), most_frequent=2)
    rows = np.random.default_rng(0).integers(0, len(model.weights), (3, 50))
    assert np.allclose(np.exp(maxent.log_softmax(model.weights, model.bias, rows)).sum(axis=1), 1, atol=1e-5)
    assert maxent.score(docs, model, counts, ["doc_id"]).count() == len(odd)
    model, counts = maxent.learn(documents(), F.lit(True))
    assert maxent.score(docs, model, counts, ["doc_id"]).count() == len(odd)
    assert maxent.score(documents(), model, counts, ["doc_id"]).count() == 0


def test_pipeline_stages(spark, corpus):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = docs
    for _name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, seen, sf_dir)
        assert after.columns == docs.columns
        after = spark.createDataFrame(after.collect(), docs.schema)
        assert after.join(seen, "doc_id", "left_anti").count() == 0
        seen = after
    assert 0 < seen.count() < docs.count()
    assert {r.doc_id for r in seen.collect()} == {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).select("doc_id").distinct().collect()}
    for _name, stage in corpus_pipeline.STAGES:
        stage(spark, docs.limit(0), sf_dir).count()
