"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import itertools
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute
from staycohort.llm import (
    chat_tree,
    factorisation,
    hilbert,
    lattice,
    mixing,
    quality_rules,
    recompression,
    simhash,
    trie_bpe,
    url_rules,
)
from staycohort.llm.components import components

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    "copy string, key_id string, shared int, ids int, word string, fp int, n int, score int"
)
LABELS = "doc_id bigint, quality int, toxic int"
WORDS = ["alpha", "beta", "gamma", "delta", "Épsilon", "zeta.", "eta!", "theta", "iota", "kappa"]


def prose(seed, n):
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + str(draw.randint(0, 40)) for _ in range(n))


TEXTS = [
    (1, prose(1, 60)),
    (2, prose(1, 60)),  # a copy
    (2, prose(1, 60)),  # a repeated row
    (3, prose(2, 20) + "\n" + prose(1, 60) + "\n" + prose(3, 30)),
    (4, None),
    (5, ""),
    (None, prose(4, 40)),
    (None, None),
    (6, " \t\n\v\f\r "),
    (7, "again " * 200),
    (8, prose(5, 20_000)),
    (9, prose(1, 34)),
    (10, "one word   two\x1cthree <|endoftext|> <s> \\ [INST]"),
    (11, prose(6, 50) + " " + prose(6, 50)),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, [None, "en", "fr"][k % 3], ["hot", None][k == 4], k, "x", "y", 1, 2, "w", 3, 4, 5) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_repeats_on_edges(docs, nothing):
    got = recompression.remove_repeats(docs, joined=True).select("doc_id", "n_words", "n_removed", F.sha2("text", 256)).collect()
    expected = [(i, *x) for (i, _), x in zip(TEXTS, brute.cut_repeats([t for _, t in TEXTS]), strict=True)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))
    assert recompression.remove_repeats(nothing).count() == 0


def test_repeats_of_rows_without_ids_and_of_ids_with_several_texts(spark):
    """Texts that a 32-bit hash takes for one, under no id, one id and many ids."""
    made = spark.range(400_000).selectExpr("concat('w', id, ' x') AS start", "hash(concat('w', id, ' x')) AS h")
    pair = made.groupBy("h").agg(F.min("start").alias("a"), F.max("start").alias("b")).where("a <> b").first()
    shared = prose(3, 45)
    bodies = [f"{pair.a} {shared}", f"{pair.b} {prose(11, 45)}", f"own {shared}", prose(12, 80), pair.a, pair.b, None, ""]
    for ids in ([None] * 8, [7] * 8, [None, 7, 7, 7, None, None, 1, 0], list(range(8))):
        frame = spark.createDataFrame(list(zip(ids, bodies, strict=True)), "doc_id bigint, text string")
        got = recompression.remove_repeats(frame, joined=True).select("doc_id", "n_words", "n_removed", F.sha2("text", 256)).collect()
        expected = [(i, *x) for i, x in zip(ids, brute.cut_repeats(bodies), strict=True)]
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))


def test_windows_are_told_apart_by_their_bytes(monkeypatch):
    """Where all words have one name, digests of the bytes alone decide."""
    real = recompression.word_names

    def one_name(data):
        names, begins = real(data)
        return np.full_like(names, 5), begins

    monkeypatch.setattr(recompression, "word_names", one_name)
    texts = [prose(1, 60), prose(2, 60), f"{prose(1, 60)} x"]
    rows = {"key_id": [1, 2, 3], "key_text": [0, 0, 0], "text": texts}
    (sent,) = recompression._send_symbols(iter([pa.RecordBatch.from_pydict(rows)]))
    assert sent.num_rows
    marks = {"__key_id": [1, 2, 3], "__key_text": [0, 0, 0], "text": texts, "__shared": [[0], [0], [0]]}
    kinds = pa.schema([("__key_id", pa.int64()), ("__key_text", pa.int64()), ("text", pa.string()), ("__shared", pa.list_(pa.int32()))])
    (windows,) = recompression._send_windows(iter([pa.RecordBatch.from_pydict(marks, kinds)]))
    met = [(r["key_id"], r["pos"], r["known"]) for r in windows.to_pylist()]
    assert sorted(met) == [(1, p, True) for p in range(26)] + [(2, p, False) for p in range(26)] + [(3, 26, False)]


def test_repeats_in_random_texts_of_few_words(spark):
    draw = random.Random(9)
    texts = [" ".join(draw.choice("ab") if draw.random() < 0.9 else "c" for _ in range(draw.randint(0, 400))) for _ in range(60)]
    texts += [t[draw.randint(0, 60) :] for t in texts[:20]] + ["a " * draw.randint(30, 90) + "b" for _ in range(10)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {tuple(r) for r in recompression.remove_repeats(frame, joined=True).select("doc_id", "n_words", "n_removed", F.sha2("text", 256)).collect()}
    assert got == {(i, *x) for i, x in enumerate(brute.cut_repeats(texts))}


def test_a_cut_keeps_the_layout_of_what_stays():
    covered = np.array([False, True, True, False, False])
    assert recompression.cut(" é  b\nc \n d  e\n".encode(), covered) == " é  d  e\n"


def test_symbols_depend_on_their_stretch_alone():
    draw = np.random.default_rng(1)
    names = draw.integers(0, 5, 300).astype(np.uint64)
    whole = recompression.symbols(names, np.zeros(300, np.int64), 4)
    part = recompression.symbols(names[100:200], np.zeros(100, np.int64), 4)
    inside = {(n, lo, hi) for n, lo, hi in zip(whole["name"], whole["low"], whole["high"], strict=True) if lo >= 100 and hi <= 200}
    found = set(zip(part["name"], part["low"] + 100, part["high"] + 100, strict=True))
    assert inside and inside <= found


def test_simhash_on_edges(docs, nothing):
    got = simhash.near_duplicates(docs, 4, 4).collect()
    prints = [brute.fingerprint(t) for _, t in TEXTS]
    of = brute.components([i for i, _ in TEXTS], prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    expected = [(i, p, c) for (i, _), p, c in zip(TEXTS, signed, of, strict=True)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))
    kept = simhash.keep_one(docs, 4, 4)
    assert kept.columns == docs.columns and kept.count() == len({brute.fingerprint(t) for _, t in TEXTS})
    assert simhash.near_duplicates(nothing, 4, 4).count() == simhash.keep_one(nothing, 4, 4).count() == 0


@pytest.mark.parametrize("limit", [3, 4, 7])
def test_every_pair_of_close_fingerprints_is_joined(spark, limit):
    draw = random.Random(limit)
    prints = [draw.getrandbits(64) for _ in range(40)]
    for p in list(prints):
        for _ in range(6):
            near = p
            for bit in draw.sample(range(64), draw.randint(1, limit + 2)):
                near ^= 1 << bit
            prints.append(near)
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp bigint"), limit)
    root = {r.node: r.root for r in components(edges).collect()}
    expected = brute.components(signed, prints, limit)
    assert [root.get(p, p) for p in signed] == expected


@pytest.mark.parametrize("limit", [3, 4])
def test_dense_files_are_split_and_lose_no_link(spark, limit):
    """Templates filled in differently: fingerprints that share all but a few bits."""
    draw = random.Random(limit)
    prints = set()
    for spread in (6, 10, 20):
        middle, bits = draw.getrandbits(64), draw.sample(range(64), spread)
        for _ in range(250):
            p = middle
            for bit in draw.sample(bits, draw.randint(0, 5)):
                p ^= 1 << bit
            prints.add(p)
    for a, b in itertools.pairwise(draw.sample(sorted(prints), 20)):  # some bits between the groups
        prints.add(a ^ ((a ^ b) & draw.getrandbits(64)))
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    expected = brute.components(signed, prints, limit)
    for most_filed in (10, 60):
        root = {r.node: r.root for r in components(simhash.links(frame, limit, most_filed)).collect()}
        assert [root.get(p, p) for p in signed] == expected


def test_filing_is_dealt_over_all_tasks(spark):
    """Few distinct fingerprints lie in few parts, their many files in as many as a shuffle has."""
    distinct = spark.range(5000).select(F.xxhash64("id").alias("fp")).distinct()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = [r["count"] for r in simhash._filed(distinct, 4).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == tasks and max(sizes) < 2 * sum(sizes) / tasks


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 60)] + [(3, 3)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {i: 100 for i in range(100, 161)} | {i: 7 for i in range(7, 60)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_quality_rules_on_edges(spark, docs, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (3, None, 0)], LABELS)
    got = quality_rules.verdicts(docs, labels, 0.04, 0.05).collect()
    assert len(got) == len(TEXTS)
    failed = {i: len(brute.words(t)) < 20 or 100 * brute.repeated_words(t) > 30 * len(brute.words(t)) for i, t in TEXTS if i}
    # too few labels to certify a threshold: the base rule alone decides
    assert {r.doc_id for r in got if r.kept and r.doc_id} == {i for i, bad in failed.items() if not bad}
    assert quality_rules.keep_good(docs, labels, 0.04, 0.05).columns == docs.columns
    assert quality_rules.verdicts(nothing, spark.createDataFrame([], LABELS), 0.04, 0.05).count() == 0


def test_thresholds_bound_the_false_rejections(spark):
    """Junk of every good-looking kind goes, no more good documents than the risk allows."""
    good = [(i, prose(i, 40), "en") for i in range(600)]
    junk = [(1000 + i, " ".join(w + "%%%" for w in prose(i, 40).split()), "en") for i in range(50)]
    shout = [(2000 + i, " ".join(w.upper() for w in prose(i, 40).replace("Épsilon", "x").split()), "en") for i in range(50)]
    frame = spark.createDataFrame(good + junk + shout, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, *_ in good + junk + shout], LABELS)
    kept = {r.doc_id for r in quality_rules.verdicts(frame, labels, 0.08, 0.05).collect() if r.kept}
    assert not kept & {i for i, *_ in junk + shout}
    assert len(kept) >= 0.92 * len(good)


def test_each_stratum_is_certified_alone_and_repeated_rows_count_once(spark):
    """Two languages of 100 good documents, and one of 5 of which three look like junk."""

    def rejected(good, copies):
        loud = [" ".join(w + "%%%" for w in prose(k, 40).split()) for k in range(3)]
        rows = [(i, prose(i, 40), lang) for k, lang in enumerate(("en", None)) for i in range(1000 * k, 1000 * k + good)]
        few = [(4000 + k, loud[k] if k < 3 else prose(k, 40), "fr") for k in range(5)]
        junk = [(5000 + k, loud[0], lang) for k, lang in enumerate(("en", "fr", None, "unlabelled"))]
        labels = spark.createDataFrame([(i, 1, 0) for i, *_ in rows + few], LABELS)
        frame = spark.createDataFrame((rows + few) * copies + junk, "doc_id bigint, text string, lang string")
        return {r.doc_id for r in quality_rules.verdicts(frame, labels, 0.04, 0.05).collect() if not r.kept}

    assert quality_rules.least_labels(0.04, 0.05 / 2) == 91
    assert rejected(100, 1) == {5000, 5002}
    assert rejected(80, 6) == set()


def test_the_doubt_is_shared_by_the_tested_strata_alone(spark):
    def tests(*sizes):
        frame = spark.createDataFrame([(str(i), n) for i, n in enumerate(sizes)], "stratum string, n long")
        return quality_rules.tested_strata(frame, 0.04, 0.05)

    least = [quality_rules.least_labels(0.04, 0.05 / k) for k in (1, 2, 3)]
    assert least == [74, 91, 101]
    assert tests() == (1, 74) and tests(*[5] * 50) == (1, 74) and tests(74, *[5] * 50) == (1, 74)
    assert tests(91, 91) == (2, 91) and tests(100, 100, 100) == (3, 101) and tests(100, 100, 80) == (2, 91)


def test_binomial_certificates():
    assert quality_rules.binomial_tail(0, 10, 0.1) == pytest.approx(0.9**10)
    assert quality_rules.binomial_tail(10, 10, 0.3) == 1
    assert quality_rules.certified([0, 0, 9], 1000, (3.0, 2.0, 1.0), 0.01, 0.01) == 2.0
    assert quality_rules.certified([9, 0, 0], 1000, (3.0, 2.0, 1.0), 0.01, 0.01) is None
    assert quality_rules.certified([0], 0, (1.0,), 0.01, 0.01) is None


def test_repeated_words_equal_brute_force():
    draw = random.Random(4)
    for _ in range(200):
        text = " ".join(draw.choice("abc") for _ in range(draw.randint(0, 60)))
        assert quality_rules.repeated_words(text.encode().split()) == brute.repeated_words(text)


def test_mixing_on_edges(spark, docs, nothing):
    weights = spark.createDataFrame([("hot", 1.0)], "source string, weight double")
    mixed = mixing.poisson_mixture(docs, weights, "s")
    assert set(mixed.columns) == set(docs.columns)
    rows = mixed.select("doc_id", "text", "source", "copy").collect()
    assert all(r.source == "hot" for r in rows)
    again = mixing.poisson_mixture(docs.repartition(5), weights, "s").select("doc_id", "text", "source", "copy").collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    assert mixing.poisson_mixture(nothing, weights, "s").count() == 0


def test_mixing_follows_the_poisson_distribution(spark):
    rows = [(i, "a" if i % 4 else "b") for i in range(8000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string")
    weights = spark.createDataFrame([("a", 3.0), ("b", 5.0)], "source string, weight double")
    n = {r.source: r["count"] for r in mixing.poisson_mixture(docs, weights, "x").groupBy("source").count().collect()}
    assert n["a"] == pytest.approx(3000, rel=0.06) and n["b"] == pytest.approx(5000, rel=0.06)
    high = spark.createDataFrame([(1500.0,)], "rate double").select(F.element_at(mixing._cumulative("rate"), -1)).first()[0]
    assert high == pytest.approx(1, abs=1e-9)


def test_small_rates_keep_their_digits(spark):
    docs = spark.createDataFrame([(i, "a" if i else "b") for i in range(4)], "doc_id bigint, source string")
    weights = spark.createDataFrame([("a", 3e-13), ("b", 1.0)], "source string, weight double")
    rates = {r.source: r.rate for r in mixing.repetition_rates(docs, weights).collect()}
    assert rates["a"] == pytest.approx(4e-13, rel=1e-8) and rates["b"] == pytest.approx(4, rel=1e-8)
    steps = spark.createDataFrame([(rates["a"],)], "rate double").select(mixing._cumulative("rate")[0]).first()[0]
    assert 0 < 1 - steps < 1e-12


def test_url_rules_on_edges(spark):
    urls = [None, "", "no scheme/x", "http://", "HTTP://A.Example.NET/en/x?q#f", "http://example.net/en", "http://net/", "ftp://x.org/fr/",
            "http://xexample.com/de/", "http://example.com/de/1", "http://example.com/DE/1", "http://spam.org?x=http://net/"]
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id bigint, url string, verdict string")
    rules = [url_rules.prefix_rule(v, r) for v, r in (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))]
    rules.append(url_rules.Rule("no token", "block", r"^spam\.", (), -1))
    got = url_rules.judge_urls(pages, rules, "allow").orderBy("page_id").select("host", "path", "rule", "verdict").collect()
    assert [tuple(r) for r in got] == [
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("a.example.net", "/en/x", "example.net/en/", "allow"),
        ("example.net", "/en", "net/", "block"),
        ("net", "/", "net/", "block"),
        ("x.org", "/fr/", "org/fr/", "allow"),
        ("xexample.com", "/de/", None, "allow"),
        ("example.com", "/de/1", "example.com/de/", "block"),
        ("example.com", "/DE/1", None, "allow"),
        ("spam.org", "", "no token", "block"),
    ]
    joined = url_rules.judge_urls(pages, rules, "allow", most_broadcast=0).orderBy("page_id").select("host", "path", "rule", "verdict").collect()
    assert joined == got
    assert url_rules.judge_urls(pages.limit(0), rules, "allow", most_broadcast=0).count() == 0
    clashing = pages.withColumns({"host": F.lit("h"), "path": F.lit("p"), "name": F.lit("n")}).union(pages.selectExpr("*", "'h'", "'p'", "'n'"))
    for most in (0, 9):
        twice = url_rules.judge_urls(clashing, rules, "allow", most_broadcast=most)
        assert sorted(twice.columns) == ["host", "name", "page_id", "path", "rule", "url", "verdict"] and twice.count() == 2 * len(urls)
    assert url_rules.judge_urls(pages.limit(0), rules, "allow").count() == 0
    assert url_rules.judge_urls(pages, [], "allow").count() == len(urls)


def test_rules_for_host_words_and_path_parts(spark):
    blocked = ["http://casino.org", "http://my-casino.example.org/x", "http://a.Casino-1.net?q", "http://x.free-money.com/",
               "http://x-free-money-y.org", "http://a.org/login", "http://a.org/en/login/?next=1", "http://a.org/wp.php"]
    left = ["http://casinos.org", "http://mycasino.org", "http://free.money.com", "http://freemoney.com", "http://a.org/casino",
            "http://a.org/logins", "http://a.org/Login", "http://login.org/", "http://a.org/?p=/login", "http://a.org/wpxphp", "http://a.org/login\n", None]
    pages = spark.createDataFrame(list(enumerate(blocked + left)), "page_id bigint, url string")
    rules = [url_rules.host_word_rule("block", w) for w in ("casino", "free-money")]
    rules += [url_rules.path_part_rule("block", part) for part in ("login", "wp.php")]
    for most in (0, 9):
        got = url_rules.judge_urls(pages, rules, "allow", most_broadcast=most).orderBy("page_id").collect()
        assert [r.verdict for r in got] == ["block"] * len(blocked) + ["allow"] * len(left)


def test_more_rules_than_are_broadcast(spark):
    rules = [url_rules.Rule(f"r{i:05}", "block", rf"^h{i}\.org/", (f"h{i}", "org"), 1) for i in range(20_500)]
    pages = spark.range(40_000).selectExpr("id AS page_id", "concat('http://', IF(id % 3 = 0, 'h7', concat('h', id)), '.org/x') AS url")
    got = url_rules.judge_urls(pages, rules, "allow")
    assert got.where("verdict = 'block'").count() == sum(i % 3 == 0 or i < 20_500 for i in range(40_000))
    assert got.where("page_id % 3 = 0 AND rule = 'r00007'").count() == len(range(0, 40_000, 3))


def test_encoding_on_edges(docs, nothing):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    coded = trie_bpe.encode_and_decode(docs, path).select("doc_id", "text", "ids", "decoded").collect()
    assert len(coded) == len(TEXTS)
    for row in coded:
        expected = library.encode(row.text or "", add_special_tokens=False).ids
        assert row.ids == expected and row.decoded == library.decode(expected, skip_special_tokens=False)
    assert trie_bpe.encode_and_decode(nothing, path).count() == 0


def test_encoding_of_random_strings():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, coder, draw = Tokenizer.from_file(path), trie_bpe.TrieEncoder(path), random.Random(2)
    letters = "abcdefhinorstéßΣσİ’'0²!?#\t\n\x85\x1c 日😀́﻿"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 40))) for _ in range(1500)]
    texts += ["".join(draw.choice("ahtin") for _ in range(draw.randint(0, 60))) for _ in range(1500)]
    assert coder.encode(texts) == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_classifier_on_edges(spark, docs, nothing):
    model = factorisation.fit(docs, spark.createDataFrame([], LABELS))
    assert {r.score for r in factorisation.scored(docs, model).collect()} == {0.5}
    labels = spark.createDataFrame([(1, 1, 0), (3, 1, 0), (7, 0, 0), (5, 0, 0), (None, 1, 0)], LABELS)
    got = factorisation.scored(docs, factorisation.fit(docs, labels)).collect()
    assert len(got) == len(TEXTS) and all(0 < r.score < 1 for r in got)
    assert factorisation.scored(nothing, model).count() == 0


def test_pairwise_sum_equals_the_double_loop():
    draw = np.random.default_rng(3)
    model = factorisation.Model(0.3, draw.normal(size=9), draw.normal(size=(9, 4)), np.zeros(1), np.ones(1))
    at, x = np.array([1, 4, 5, 8]), draw.normal(size=4)
    pairs = sum(model.factors[at[i]] @ model.factors[at[j]] * x[i] * x[j] for i in range(4) for j in range(i))
    assert factorisation._interactions(at, x, model) == pytest.approx(0.3 + model.weights[at] @ x + pairs)


@pytest.fixture(scope="module")
def pieces():
    return lattice.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))


def test_lattice_sums_all_segmentations(pieces):
    names = brute.piece_names(public_tokenizers.path("piece_bpe_32k.model"))
    found = [b"the", b"seeing", b"a", b"nation", b"nation"]
    ways = [brute.segmentations("▁" + w.decode(), names) for w in found]
    odds = [np.array([np.exp(sum(pieces.log_p[names[p]] for p in way)) for way in each]) for each in ways]
    assert np.allclose(lattice.log_likelihoods(found, pieces), [np.log(o.sum()) for o in odds])
    times = np.array([3.0, 2.0, 1.0, 5.0, 7.0])
    expected = np.zeros(len(pieces.log_p))
    for n, each, o in zip(times, ways, odds, strict=True):
        for share, way in zip(o / o.sum(), each, strict=True):
            for p in way:
                expected[names[p]] += n * share
    assert np.allclose(lattice.expected_counts(found, times, pieces), expected)
    rare, long = "\x1c😀".encode(), b"ab" * 5000
    assert np.isfinite(lattice.log_likelihoods([rare, long], pieces)).all()


def test_lattice_on_edges(spark, docs, nothing, pieces):
    got = lattice.scored(docs, F.lit(False), pieces, rounds=1).collect()
    assert len(got) == len(TEXTS)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by_id[4].n_tokens == by_id[5].n_tokens == by_id[6].n_tokens == 1
    assert by_id[2].score == pytest.approx(by_id[1].score) and by_id[2].n_tokens == 61
    assert lattice.scored(nothing, F.lit(False), pieces, rounds=1).count() == 0
    assert lattice.scored(docs, F.lit(True), pieces, rounds=1).select("n_known").distinct().first()[0] == 0


def test_long_frequent_words_are_in_the_head(spark, pieces, monkeypatch):
    """A word beyond `HEAD_BYTES` in every text is looked up by its digest, not joined."""
    rows = [(i, f"{'x' * 100} é{'y' * 90} {prose(i, 20)} {'z' * 32}") for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")

    def scores():
        return {r.doc_id: (r.n_tokens, r.n_known, r.base_score, r.score) for r in lattice.scored(frame, F.col("doc_id") % 3 == 1, pieces).collect()}

    named = spark.createDataFrame([(w.encode(),) for w in ("x" * 64, "x" * 65, "é" * 40, "z" * 32)], "word binary")
    for word, name in named.select("word", lattice._head_name_column()).collect():
        assert bytes(name) == lattice._head_name(bytes(word)) and (len(word) <= 64) == (name == word)
    expected = brute.lattice_scores([t for _, t in rows], [i % 3 == 1 for i, _ in rows], public_tokenizers.path("piece_bpe_32k.model"))
    with_head = scores()
    assert [with_head[i][3] for i, _ in rows] == pytest.approx(expected)
    monkeypatch.setattr(lattice, "_head_limit", lambda counts: 10**6)  # every word is joined
    assert {i: pytest.approx(x) for i, x in scores().items()} == with_head


def test_training_raises_the_likelihood_of_training_words(spark, pieces):
    frame = spark.createDataFrame([(i, prose(i, 50)) for i in range(40)], "doc_id bigint, text string")
    total = [lattice.scored(frame, F.lit(False), pieces, rounds=n).agg(F.sum("score")).first()[0] for n in (0, 1, 2)]
    assert total[0] < total[1] < total[2]


CHAT = "conv_id bigint, turn bigint, role string, text string, node string"


def test_chat_tree_on_edges(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    said = "<|im_end|>\n\\ ; [INST]</s> é<|endoftext|>"
    rows = [(1, 0, "user", said), (1, 1, "assistant", said), (2, 0, "user", said), (2, 1, "assistant", "other"), (2, 2, None, None),
            (3, 0, "user", said), (3, 1, "assistant", said), (3, 2, "us\ner", "x"), (4, None, "user", ""), (4, None, "user", ""), (None, 0, "user", "lost")]
    turns = spark.createDataFrame([(*r, "x") for r in rows], CHAT)
    tree = chat_tree.format_conversations(turns, path)
    got = {r.conv_id: r for r in chat_tree.read_back(tree, path).collect()}
    assert got.keys() == {1, 2, 3, 4} and got[4].n_turns == 2
    assert got[1].loss_sha256 == brute.sha(said) and got[2].turns_sha256 == brute.sha(f"user\n{said}\nassistant\nother\n\n\n")
    assert got[3].turns_sha256 == brute.sha(f"user\n{said}\nassistant\n{said}\nus\ner\nx\n")
    assert chat_tree.read_back(chat_tree.format_conversations(turns.limit(0), path), path).count() == 0


def test_packed_trees_hold_each_shared_turn_once(spark):
    """Nodes tile their tree without gaps, and a node sees exactly its conversation's start."""
    draw, path = random.Random(5), public_tokenizers.path("byte_bpe_50k.json")
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", draw.choice(["yes", "no"])) for c in range(60) for t in range(draw.randint(1, 6))]
    tree = chat_tree.format_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"), path)
    nodes, packed = tree.nodes.collect(), {}
    for n in sorted(nodes, key=lambda n: (n.tree, n.start)):
        assert n.start == len(packed.setdefault(n.tree, []))
        packed[n.tree] += n.ids
    by_node = {bytes(n.node): n for n in nodes}
    for conv in {c for c, *_ in rows}:
        before = []
        for step in sorted(tree.paths.where(F.col("conv_id") == conv).collect(), key=lambda r: r.depth):
            n = by_node[bytes(step.node)]
            seen = [x for i in n.ancestors for x in packed[n.tree][i.start : i.stop]]
            assert seen == before and n.position == len(before)
            before = before + n.ids
        whole = tree.conversations.where(F.col("conv_id") == conv).first()
        assert [x for i in whole.intervals for x in packed[whole.tree][i.start : i.stop]] == before


def test_a_conversation_of_a_third_of_all_turns(spark):
    """It runs, in blocks of depths, and is read back whole; so is one very long turn."""
    path, draw = public_tokenizers.path("byte_bpe_50k.json"), random.Random(6)
    rows = [(5, t, "user" if t % 2 == 0 else "assistant", draw.choice(["yes", "no"])) for t in range(2500)]
    rows += [(6, t, *rows[t][2:]) for t in range(1800)] + [(6, 1800, "user", "other")] + [(c, t, *rows[t][2:]) for c in (1, 2, 9) for t in range(1100)]
    rows += [(100 + c, 0, "user", f"hello {c % 7}") for c in range(60)] + [(300, 0, "user", "wörd " * 60_000)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    tree = chat_tree.format_conversations(frame, path)
    got = {r.conv_id: r for r in chat_tree.read_back(tree, path).collect()}
    for conv in {c for c, *_ in rows}:
        turns = [r for r in rows if r[0] == conv]
        assert got[conv].n_turns == len(turns) and got[conv].turns_sha256 == brute.sha("".join(f"{t[2]}\n{t[3]}\n" for t in turns))
    assert tree.nodes.count() == len({tuple(x[2:] for x in rows if x[0] == c)[: t + 1] for c in (5, 6) for t in range(2500)}) + 8
    assert max(len(r.intervals) for r in tree.conversations.collect()) <= 4


def test_reading_back_needs_whole_intervals(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    frame = spark.createDataFrame([(1, t, "user", "word " * 9) for t in range(3)], "conv_id bigint, turn bigint, role string, text string")
    tree = chat_tree.format_conversations(frame, path)
    broken = chat_tree.ChatTree(tree.nodes.where("depth <> 1"), tree.paths, tree.conversations)
    with pytest.raises(Exception, match="follows"):
        chat_tree.read_back(broken, path).collect()


def test_neighbours_on_edges(spark):
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]),
            (6, [None, 1.0]), (40, [float("inf"), 1.0]), (7, [-1.0, 0.0]), (8, [1.0]), (None, [1.0, 1.0]), (2, [0.5, 0.5])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<float>, rank int")
    got = hilbert.neighbours(frame, F.col("vec_id") % 20 == 0, 3).collect()
    assert sorted(map(tuple, got)) == [
        (0, 1, 1, 1.0), (0, 2, 20, 1.0), (0, 3, 2, 0.5), (20, 1, 0, 1.0), (20, 2, 1, 1.0), (20, 3, 2, 0.5),
    ]
    assert hilbert.neighbours(frame.limit(0), F.col("vec_id") % 20 == 0, 3).count() == 0


@pytest.mark.parametrize("kind", ["even", "one great norm", "groups, one great norm", "uneven", "common great vector"])
def test_recall_of_windows(spark, kind):
    """Windows of some dozen rows on each side, against brute force."""
    draw, n, places = np.random.default_rng(8), 4000, 10
    vectors = draw.normal(size=(n, 32))
    if "groups" in kind:
        vectors = draw.normal(size=(50, 32))[draw.integers(0, 50, n)] + 0.3 * vectors
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    if "one" in kind:
        vectors[7] *= 1000
    if kind == "uneven":
        vectors *= draw.lognormal(0, 1, (n, 1))
    if kind == "common great vector":
        vectors[draw.permutation(n)[: n // 3]] = 1000 * vectors[7]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>").repartition(4)
    got = {}
    for r in hilbert.neighbours(frame, F.col("vec_id") % 40 == 0, places).collect():
        got.setdefault(r.query_id, []).append(r.score)
    reached = 0
    for query in range(0, n, 40):
        products = np.delete(vectors @ vectors[query], query)
        least = np.sort(products)[-places]
        assert len(got[query]) == places
        reached += sum(score >= least - 1e-9 * abs(least) for score in got[query])
    assert reached >= 0.9 * places * len(range(0, n, 40))


def test_split_ranges_and_queries_find_the_same(spark):
    draw = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(draw.normal(size=(900, 16)))] + [(900 + i, [1.0] * 16) for i in range(60)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4)
    found = [sorted(map(tuple, hilbert.neighbours(frame, F.col("vec_id") % 3 == 0, 5, scale=0.4, **o).collect())) for o in ({}, {"most_asks": 7})]
    assert found[0] == found[1] and len(found[0]) == 5 * 320
    narrow = hilbert.neighbours(frame, F.col("vec_id") % 3 == 0, 5, scale=0.4, most_range=10, most_asks=20).collect()
    assert len({r[:3] for r in map(tuple, narrow)} & {r[:3] for r in found[0]}) >= 0.95 * len(found[0])


def test_windows_grow_more_slowly_than_the_rows():
    share = [hilbert.CURVES * 3 * hilbert.reach(n) / n for n in (10**4, 10**5, 10**6, 10**9)]
    assert share == sorted(share, reverse=True) and share[-1] < share[0] / 5


def test_equal_vectors_have_equal_scores_wherever_they_lie(spark):
    draw = np.random.default_rng(12)
    vectors = np.repeat(draw.normal(size=(300, 64)), 8, axis=0)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>").repartition(5)
    by_query = {}
    for r in hilbert.neighbours(frame, F.col("vec_id") % 20 == 0, 20).collect():
        by_query.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for found in by_query.values():
        found.sort()
        assert found == [(k + 1, *x) for k, x in enumerate(sorted((x[1:] for x in found), key=lambda x: (-x[1], x[0])))]
        of_vector = {}
        for _, i, score in found:
            of_vector.setdefault(i // 8, []).append((i, score))
        assert all(len({s for _, s in x}) == 1 for x in of_vector.values())
        # ties to smaller ids: of each vector the least ones, without a gap
        assert all([i for i, _ in x] == [i for i in range(8 * k, 8 * k + 8) if i != found_query(by_query, found)][: len(x)] for k, x in of_vector.items())


def found_query(by_query, found):
    return next(q for q, x in by_query.items() if x is found)


def test_hilbert_steps_are_unit_steps():
    side = 8
    grid = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    keys = hilbert.hilbert_keys(grid, 3)
    assert sorted(keys) == list(range(side**3))
    assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_words_named_in_pieces_have_the_same_names(monkeypatch):
    data = " é\tb\n\nc  a-long-word-of-one-piece \r\x0b d\x0c".encode() * 3 + b" " * 20 + prose(4, 50).encode()
    whole = recompression.word_names(data)
    assert len(whole[0]) == len(data.split()) and [data[b : b + 1] for b in whole[1][:3]] == ["é".encode()[:1], b"b", b"c"]
    for size in (1, 2, 7, 40):
        monkeypatch.setattr(recompression, "NAMED_BYTES", size)
        pieces = recompression.word_names(data)
        assert all(np.array_equal(a, b) for a, b in zip(whole, pieces, strict=True))


def test_naming_words_takes_little_memory():
    data = (prose(5, 1000).encode() + b" ") * 300
    tracemalloc.start()
    recompression.word_names(data)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(data) > 1_000_000 and peak < 10 * len(data)


def block_bytes(batch: pa.RecordBatch, columns: list[str], by: str) -> float:
    """Bytes a row of one of 50 shuffle blocks, with rows of 8-byte slots as Spark lays them out."""
    slots = [np.full(batch.num_rows, 8 * len(columns) + 8 << 24), np.zeros(batch.num_rows, np.int64)]
    slots += [batch[c].cast(pa.int8()).to_numpy() if c == "known" else batch[c].to_numpy() for c in columns]
    rows = np.column_stack(slots).astype("<i8")[batch[by].to_numpy() % 50 == 0]
    return len(pa.compress(rows.tobytes(), "lz4_raw", asbytes=True)) / len(rows)


def test_shuffled_rows_compress_to_little_more_than_their_digests():
    draw = np.random.default_rng(3)
    texts = [" ".join(map(str, draw.integers(0, 50_000, 300))) for _ in range(300)]
    ids = (51 * np.arange(300) + 100_000).tolist()
    (sent,) = recompression._send_symbols(iter([pa.RecordBatch.from_pydict({"key_id": ids, "key_text": [0] * 300, "text": texts})]))
    assert block_bytes(sent, sent.schema.names, "sym") < 17
    places = {i: recompression._reversed(sent["place"].to_numpy()[sent["key_id"].to_numpy() == i]).tolist() for i in ids}
    marks = {"__key_id": ids, "__key_text": [0] * 300, "text": texts, "__shared": [sorted(x for x in places[i] if x >= 0) for i in ids]}
    kinds = pa.schema([("__key_id", pa.int64()), ("__key_text", pa.int64()), ("text", pa.string()), ("__shared", pa.list_(pa.int32()))])
    (sent,) = recompression._send_windows_to_meet(iter([pa.RecordBatch.from_pydict(marks, kinds)]))
    assert sent.num_rows == 300 * 266
    assert block_bytes(sent, sent.schema.names, "h") < 27
