"""The registered queries against brute force on the smallest given tables."""

import itertools
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import brute
from staycohort.llm.queries import QUALITY_RISK, QUERIES

SF = "/root/testdata/sf0.001"


def given(sql):
    connection = duckdb.connect()
    for name in ("documents", "labels", "pages", "conversations", "embeddings"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection.execute(sql).fetchall()


@pytest.fixture(scope="module")
def documents():
    return given("SELECT doc_id, text FROM documents ORDER BY doc_id")


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def result(spark, name, *columns):
    return {tuple(r) for r in QUERIES[name](spark, SF).select(*columns).collect()}


def test_chat_tree_reads_back_every_conversation(spark):
    rows = given("SELECT conv_id, turn, coalesce(role, ''), coalesce(text, '') FROM conversations")
    said = "</s>[INST] ok [/INST]"
    rows += [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    expected = set()
    for conv, turns in itertools.groupby(sorted(rows), lambda r: r[0]):
        turns = list(turns)
        learned = "".join(t[3] for t in turns if t[2] == "assistant")
        whole = "".join(f"{t[2]}\n{t[3]}\n" for t in turns)
        expected.add((conv, len(turns), brute.sha(whole), len(learned), brute.sha(learned)))
    columns = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")
    assert result(spark, "op1_chat_tree", *columns) == expected


def test_quality_counts_and_base_rule(spark, documents):
    got = {r.doc_id: r for r in QUERIES["op2_quality_rules"](spark, SF).collect()}
    assert got.keys() == {i for i, _ in documents}
    for doc_id, text in documents:
        w, lines = brute.words(text), [x for x in text.split("\n") if brute.words(x)]
        repeats = brute.repeated_words(text)
        failed = len(w) < 20 or 100 * repeats > 30 * len(w)
        r = got[doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (
            len(w),
            sum(map(len, w)),
            sum(text.count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)),
            repeats,
            failed,
        )
        assert not (failed and r.kept)


def test_quality_rules_catch_labelled_junk_of_every_language(spark):
    """The learned cutoffs work in small languages too, at the query's own risk."""
    larger = "/root/testdata/sf0.1"
    of_doc = f"(SELECT doc_id, max(quality) AS quality FROM '{larger}/labels.parquet' GROUP BY 1)"
    labels = given(f"SELECT lang, quality, doc_id FROM '{larger}/documents.parquet' JOIN {of_doc} USING (doc_id)")
    got = {r.doc_id: r for r in QUERIES["op2_quality_rules"](spark, larger).collect()}
    for lang in {x for x, *_ in labels}:
        good = [got[i] for x, quality, i in labels if x == lang and quality == 1]
        junk = [got[i] for x, quality, i in labels if x == lang and quality == 0]
        assert sum(not r.kept for r in junk) >= 0.9 * len(junk)
        assert sum(not r.kept and not r.base_failed for r in good) <= QUALITY_RISK * len(good)


def test_scores_and_known_words(spark, documents):
    got = {r.doc_id: r for r in QUERIES["op3_lattice_score"](spark, SF).collect()}
    split = {i: [*brute.words(brute.lowered(t)), None] for i, t in documents}
    counts = Counter(t for i, tokens in split.items() if crc(i) % 7 != 2 for t in tokens)
    path = public_tokenizers.path("piece_bpe_32k.model")
    scores = brute.lattice_scores([t for _, t in documents], [crc(i) % 7 == 2 for i, _ in documents], path)
    plain = dict(zip(split, scores, strict=True))
    for doc_id, tokens in split.items():
        r = got[doc_id]
        assert r.held_out == (crc(doc_id) % 7 == 2) and r.train_tokens == sum(counts.values())
        assert (r.n_tokens, r.n_known) == (len(tokens), sum(counts[t] > 0 for t in tokens))
        assert r.base_score == pytest.approx(brute.base_score(tokens, counts))
        assert r.score == pytest.approx(plain[doc_id])


def test_factorisation_machine_tells_held_out_quality(spark):
    labels = dict(given("SELECT doc_id, max(quality) FROM labels GROUP BY 1"))
    got = QUERIES["op4_factorisation_machine"](spark, "/root/testdata/sf0.001").collect()
    assert all(r.held_out == (crc(r.doc_id) % 3 == 1) and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.85 * len(held)


def test_repeats(spark, documents):
    expected = {(i, *x) for (i, _), x in zip(documents, brute.cut_repeats([t for _, t in documents]), strict=True)}
    assert result(spark, "op5_recompression", "doc_id", "n_words", "n_removed", "kept_sha256") == expected


def test_simhash_components(spark, documents):
    ids, prints = [i for i, _ in documents], [brute.fingerprint(t) for _, t in documents]
    expected = set(zip(ids, [f"{p:016x}" for p in prints], brute.components(ids, prints), strict=True))
    assert result(spark, "op6_simhash", "doc_id", "fingerprint", "component_id") == expected


def test_encoding_equals_the_library(spark, documents):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = set()
    for (doc_id, _), coded in zip(documents, library.encode_batch([t for _, t in documents], add_special_tokens=False), strict=True):
        decoded = library.decode(coded.ids, skip_special_tokens=False)
        expected.add((doc_id, len(coded.ids), brute.sha(" ".join(map(str, coded.ids))), brute.sha(decoded)))
    assert result(spark, "op9_trie_bpe", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == expected


def test_neighbours_have_exact_scores_and_recall(spark):
    rows = given("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id")
    ids, vectors = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    got = QUERIES["op10_hilbert_neighbours"](spark, SF).toPandas()
    hits = 0
    for query in ids[ids % 20 == 0]:
        products = vectors @ vectors[query]
        products[query] = -np.inf
        best = np.lexsort((ids, -products))[:20]
        found = got[got.query_id == query].sort_values("rank")
        assert list(found["rank"]) == list(range(1, 21))
        assert np.allclose(found.score, products[found.vec_id], atol=1e-12)
        hits += len({*found.vec_id} & {*best})
    assert hits >= 0.9 * 20 * sum(ids % 20 == 0)
