"""Prefix trie, spelling groups and archives against brute force and on edges."""

import gzip
import io
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from staycohort.llm import prefix_trie, spelling, warc
from staycohort.llm.common import shared_folder
from staycohort.llm.excess import RangeMinMax
from staycohort.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
TURNS = "conv_id bigint, turn bigint, role string, text string, node string"
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def sorted_rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def trie(spark, rows, **options):
    frame = spark.createDataFrame([(*r, "x") for r in rows], TURNS)
    return sorted_rows(prefix_trie.prefix_trie(frame, **options), *NODE)


def test_next_smaller_place_equals_a_scan():
    draw = np.random.default_rng(2)
    for n in (0, 1, 2, 7, 64, 101):
        values = np.cumsum(draw.choice([-1, 1], n))
        start, bound = draw.integers(0, n + 2, 60), draw.integers(-12, 12, 60)
        expected = [next((i for i in range(s, n) if values[i] < b), n) for s, b in zip(start, bound, strict=True)]
        assert RangeMinMax(values).first_below(start, bound).tolist() == expected


def test_parentheses_close_where_a_stack_does():
    depth, following = np.array([3, 4, 4, 5, 2, 3, 1, 2, 3]), 2
    written = prefix_trie.Parentheses(depth, following)
    close = written.find_close()
    ends = [next((j for j in range(i + 1, 9) if depth[j] <= depth[i]), 9 if depth[i] >= following else None) for i in range(9)]
    assert [c < len(written.excess) for c in close] == [e is not None for e in ends]
    # a node's close stands before the next node that is not below it
    assert all(c > written.opens[e - 1] and (e == 9 or c < written.opens[e]) for c, e in zip(close, ends, strict=True) if e is not None)
    assert written.leaves(close).tolist()[:4] == [2, 1, 1, 1]
    assert [(a, b) for a, b, _ in written.foreign] == [(2, 2), (1, 1)]


@pytest.mark.parametrize("shard_nodes", [1, 3, 1000])
def test_trie_of_random_conversations(spark, shard_nodes):
    draw = random.Random(shard_nodes)
    rows = [(c, t, draw.choice("ua"), draw.choice(["", "é", "yes"])) for c in range(120) for t in range(draw.randint(1, 7))]
    rows += [(900 + c, t, "u", "same") for c in range(40) for t in range(3)]  # copies
    rows += [(-5, t, "u", str(t % 3)) for t in range(300)]  # a long one
    rows += [(2000, t, "u", str(t % 3)) for t in range(250)] + [(2001, t, "u", str(t % 3)) for t in range(200)] + [(2001, 200, "u", "x")]
    assert trie(spark, rows, shard_nodes=shard_nodes) == sorted(brute.prefix_trie(rows), key=repr)


def test_conversations_that_take_over_turns(spark):
    draw = random.Random(7)
    rows = [(c, t, draw.choice("ua"), draw.choice(["n", "yes"])) for c in range(200) if c % 15 for t in range(draw.randint(1, 9))]
    taken = F.crc32(F.col("conv_id").cast("string")) % 9
    found = trie(spark, rows, base=F.col("conv_id") - F.col("conv_id") % 5, taken=taken, shard_nodes=50)
    expected = brute.prefix_trie(rows, lambda c: c - c % 5, lambda c: zlib.crc32(str(c).encode()) % 9)
    assert found == sorted(expected, key=repr)
    assert max(r[3] for r in found) == len({r[0] for r in rows})


def test_trie_on_edges(spark):
    rows = [(1, None, None, None), (1, 0, "u", "x"), (2, None, "", ""), (2, 0, "u", "x"), (2, 0, "u", "x"), (None, 0, "u", "lost"),
            (3, 5, "u", "b"), (3, 5, "u", "a"), (4, 1, "a", "é" * 5000), (2**61, 1, "a", "é" * 5000), (5, 1, "au", ""), (6, 1, "a", "u")]
    assert trie(spark, rows) == sorted(brute.prefix_trie(rows), key=repr)
    assert trie(spark, []) == []
    assert trie(spark, [(None, 1, "u", "x")]) == []


def test_a_long_conversation_is_dealt_out(spark):
    """A third of all turns in one conversation: no range of turns, and no shard, is large."""
    rows = spark.range(30_000).selectExpr(
        "IF(id % 3 = 0, 7L, id) AS conv_id", "id AS turn", "'u' AS role", "IF(id % 2 = 0, 'a', 'b') AS text"
    )
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    parts = [r["count"] for r in prefix_trie.named_turns(rows).groupBy("part").count().collect()]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert max(parts) <= 3 * 30_000 / 8
    found = prefix_trie.prefix_trie(rows, shard_nodes=700)
    assert found.agg(F.max("depth")).first()[0] == 10_001
    root = found.where("depth = 0").first()
    assert root.n_convs == 20_000 and root.n_leaves == found.where("n_children = 0").count()


def test_conversation_query(spark):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SF}/conversations.parquet'").fetchall()
    expected = brute.prefix_trie(rows, lambda c: c - c % 5, lambda c: zlib.crc32(str(c).encode()) % 9)
    assert sorted_rows(QUERIES["op11_prefix_trie"](spark, SF), *NODE) == sorted(expected, key=repr)


WORD = ("word", "form", "root", "n", "n_near", "form_n")
DOCS = "doc_id bigint, text string, word string, n int"


def groups(spark, rows, **options):
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS)
    return sorted_rows(spelling.spelling_groups(frame, **options), *WORD)


@pytest.mark.parametrize("most_filed", [1, 5, 100])
def test_spelling_of_random_words(spark, most_filed):
    draw = random.Random(most_filed)
    words = ["".join(draw.choice("aé") for _ in range(draw.randint(6, 9))) for _ in range(300)]
    rows = [(i, " ".join(draw.choice(words[: 1 + int(300 * draw.random() ** 3)]) for _ in range(200))) for i in range(40)]
    expected = brute.spelling(rows)
    assert sum(r[4] for r in expected) > 500 and any(r[1] for r in expected)
    assert groups(spark, rows, most_filed=most_filed) == sorted(expected, key=repr)


def test_spelling_of_short_and_of_repetitive_words(spark):
    draw = random.Random(1)
    rows = [(i, " ".join(draw.choice("abc") * draw.randint(1, 3) + draw.choice(["", "a", "ab"]) for _ in range(60))) for i in range(20)]
    assert groups(spark, rows, least_length=1, most_filed=3) == sorted(brute.spelling(rows, 1), key=repr)


def test_spelling_on_edges(spark):
    long = "x" * 5000
    rows = [(None, "Letters lettersx LETTERS Ächzend Ächzend ächzend1ächzend"), (1, None), (2, ""), (2, "letters\nletters letters"),
            (2, "letters\nletters letters"), (3, f"{long} {long}y {long} {long}y z{long}x z{long}x"), (4, "lettersx lettersy lettersy"),
            (5, "chained " * 200 + "chainedx " * 20 + "chainedxy " * 2)]
    found = groups(spark, rows, most_filed=1)
    assert found == sorted(brute.spelling(rows), key=repr)
    assert groups(spark, []) == []
    roots = {r[0]: r[2] for r in found}
    assert roots["chainedxy"] == "chained"


def test_no_file_of_common_words_stays_large(spark):
    """Words that all share their first half, or their last."""
    words = [f"gemeinsam{a}{b}{c}" for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"]
    words += [w[9:] + "gemeinsam" for w in words]
    frame = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    sizes = spelling.filed(frame, 20).groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("high") - F.col("low")).alias("wide"))
    assert sizes.where("n > 20 AND wide > 1").isEmpty()
    assert spelling.links(frame, 20).count() == 2 * 512 * 21


def test_band_rows_are_edit_distances():
    draw = random.Random(3)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            old, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
        return row[-1]

    texts = sorted({"".join(draw.choice("ab") for _ in range(draw.randint(0, 6))) for _ in range(60)})
    sizes = np.array([len(t) for t in texts])
    flat = np.frombuffer("".join(f"\0{t}\0\0" for t in texts).encode(), np.uint8)
    begin = np.cumsum(sizes + 3) - (sizes + 3) + 1
    a, b, _ = spelling.near_stretches(flat, begin, sizes, np.zeros(len(texts), np.int64))
    expected = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if distance(texts[i], texts[j]) == 1}
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == expected


def test_spelling_query(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    assert sorted_rows(QUERIES["op12_spelling"](spark, SF), *WORD) == sorted(brute.spelling(rows), key=repr)


PAGE = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
PAGES = "page_id bigint, url string, html string, digest string, part int"


def archived(spark, rows, **options):
    return warc.archived(spark.createDataFrame([(*r, "x", 1) for r in rows], PAGES).repartition(3), **options)


def test_archives_on_edges(spark):
    same, tricky = "é" * 500, "WARC/1.1\r\nContent-Length: 5\r\n\r\n\r\n\r\nWARC/1.1\r\n\0 " * 40
    rows = [(1, "http://B.example.org/x?q#f", same), (2, None, same), (3, "http://a.example.org/", same), (4, "", None), (5, "no scheme", ""),
            (6, "http://a\r\nX: y/", tricky), (7, "http://a.example.org/", tricky), (8, "http://é/", "é" * 499), (9, "http://é/", "é" * 499),
            (-10, "http://b/", tricky), (2**62, "x://y", "z" * 300_000)]
    found = archived(spark, rows)
    assert sorted_rows(found, *PAGE) == sorted(brute.archived([(i, h) for i, _, h in rows]), key=repr)
    keys = [(r.address, r.captured) for r in found.collect()]
    assert keys == sorted(keys)
    assert archived(spark, []).count() == 0


def test_archives_of_repeated_rows_and_null_ids(spark):
    page = "q" * 1000
    rows = [(1, "http://a/", page)] * 3 + [(1, "http://b/", page), (None, "http://c/", page), (None, None, "w" * 1000), (None, None, "w" * 1000)]
    found = sorted_rows(archived(spark, rows), "page_id", "url", "record_type", "refers_to")
    assert found == sorted(
        [(1, "http://a/", "revisit", 1)] * 3 + [(1, "http://b/", "response", None), (None, "http://c/", "revisit", 1)]
        + [(None, None, "response", None), (None, None, "revisit", None)], key=repr)


def test_many_copies_and_one_common_address(spark):
    rows = [(i, "http://hot.example.org/" if i % 3 else f"http://h{i}/", "copy" * 400 if i % 2 else f"own {i}" * 400) for i in range(3000)]
    found = archived(spark, rows, least_shared=1000)
    assert sorted_rows(found, *PAGE) == sorted(brute.archived([(i, h) for i, _, h in rows]), key=repr)
    assert [(r.address, r.page_id) for r in found.collect()] == sorted((warc.address_key(u), i) for i, u, _ in rows)


def test_archives_are_records_that_others_can_read(spark):
    folder = f"{shared_folder(spark)}/plain"
    warc.write_archives(spark.createDataFrame([(1, "http://a/", "body\r\n\r\n")], "page_id bigint, url string, html string"), folder)
    (content,) = [r.content for r in spark.read.format("binaryFile").load(folder).where("path LIKE '%.gz'").collect() if len(r.content) > 30]
    lines = gzip.decompress(content).decode().split("\r\n")
    assert lines[:2] == ["WARC/1.1", "WARC-Type: response"] and "WARC-Target-URI: http://a/" in lines and "Content-Type: text/html; charset=utf-8" in lines
    with pytest.raises(ValueError, match="damaged"):
        list(warc.read_records(io.BufferedReader(io.BytesIO(gzip.decompress(content).replace(b"body", b"bodx"))), "x"))
    with pytest.raises(ValueError, match="damaged"):
        list(warc.read_records(io.BufferedReader(io.BytesIO(gzip.decompress(content)[:-6])), "x"))


def test_loser_tree_merges_pieces():
    draw = random.Random(5)
    for pieces in (0, 1, 2, 3, 8, 13):
        keys = [k for _ in range(pieces) for k in sorted(draw.randint(0, 9) for _ in range(draw.randint(1, 6)))]
        assert [keys[i] for i in warc.merge_order(keys)] == sorted(keys)


def test_archive_query(spark):
    rows = duckdb.sql(f"SELECT page_id, html FROM '{SF}/pages.parquet'").fetchall()
    assert sorted_rows(QUERIES["op13_warc"](spark, SF), *PAGE) == sorted(brute.archived(rows), key=repr)
