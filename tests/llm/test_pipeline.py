"""Every stage of the pipeline, and its final rows, against plain versions."""

import random
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute
import corpus_pipeline
from staycohort.llm import quality_rules
from staycohort.llm import queries as q

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def skewed(folder):
    """Nulls in every column, repeated rows, a hot source, copies, shared passages, one long text."""
    draw = random.Random(2)
    vocabulary = ["".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(400)]

    def prose(n):
        return " ".join(draw.choice(vocabulary) for _ in range(n))

    passage, template = prose(60), prose(70)
    rows = [(i, prose(45), "en", "hot", 300) for i in range(120)] + [(200 + i, prose(45), "fr", None, None) for i in range(6)]
    rows += [(300 + i, f"{prose(30)}\n{passage}  {prose(30)}", "en", "web", 1) for i in range(6)]
    rows += [(400 + i, template, "en", "hot", 2) for i in range(20)] + [(500 + i, f"{template} {vocabulary[i]}", None, "web", 3) for i in range(5)]
    rows += [(600 + i, prose(40).replace("a", "%#"), "en", "hot", 4) for i in range(5)] + [(7, prose(50), "en", "web", 5)] * 3
    rows += [(None, prose(50), "en", "hot", 6)] * 2 + [(None, prose(50), None, None, 7), (800, None, "en", "hot", None), (801, "", "en", "hot", 0)]
    rows += [(802, prose(9000), "en", "hot", 8)]
    pq.write_table(pa.table(dict(zip(COLUMNS, zip(*rows, strict=True), strict=True))), f"{folder}/documents.parquet")
    labels = [(i, 1) for i in range(110)] + [(600, 0), (601, 0), (None, 1), (3, None), (5, 0), (200, 1)]
    table = {"doc_id": [i for i, _ in labels], "quality": [x for _, x in labels], "toxic": [0] * len(labels)}
    pq.write_table(pa.table(table), f"{folder}/labels.parquet")
    return str(folder)


@pytest.mark.parametrize("given", ["/root/testdata/sf0.001", None])
def test_stages_and_final_rows(spark, tmp_path, given):
    folder = given or skewed(tmp_path)
    stage = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet").select(*COLUMNS)
    labels = [tuple(r) for r in spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality").collect()]

    def after(name, docs):
        path = str(tmp_path / name.replace(" ", "_"))
        stage[name](spark, docs, folder).write.parquet(path)
        return spark.read.parquet(path), [tuple(r) for r in spark.read.parquet(path).collect()]

    rows = [tuple(r) for r in docs.collect()]
    keep = brute.quality_kept([r[:3] for r in rows], labels, quality_rules.SETTINGS, q.QUALITY_RISK, q.QUALITY_DOUBT)
    docs, kept = after("quality rules", docs)
    assert Counter(kept) == Counter(r for r, k in zip(rows, keep, strict=True) if k)
    assert docs.columns == COLUMNS and 0 < len(kept) < len(rows)

    prints = [brute.fingerprint(r[1]) for r in kept]
    component = brute.components(list(range(len(kept))), prints)
    docs, single = after("SimHash near-dedup", docs)
    groups = {}
    for place, of in enumerate(component):
        groups.setdefault(of, []).append(kept[place])
    assert len(single) == len(groups) < len(kept) and not Counter(single) - Counter(kept)
    of_row = {r: of for r, of in zip(kept, component, strict=True)}
    assert {of_row[r] for r in single} == set(groups)
    for r in single:
        assert r[0] == min((x[0] for x in groups[of_row[r]] if x[0] is not None), default=None)

    docs, cut = after("substring dedup", docs)
    texts = brute.cut_texts([r[1] for r in single])
    assert Counter(cut) == Counter((r[0], t, *r[2:4], r[4] if t == r[1] else len(t)) for r, t in zip(single, texts, strict=True))
    assert given or any(t != r[1] for r, t in zip(single, texts, strict=True))

    docs, mixed = after("source mixing", docs)
    copies = brute.poisson_copies([(r[0], r[3]) for r in cut], q.MIXING_EXPONENT, q.MIXING_SEED)
    assert Counter(mixed) == Counter({r: 0 for r in cut}) + Counter(x for r, n in zip(cut, copies, strict=True) for x in [r] * n)

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = Counter()
    for r in mixed:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        expected[(r[0], r[2], r[3], len(ids), tuple(ids), library.decode(ids, skip_special_tokens=False))] += 1
    final = corpus_pipeline.run(spark, folder).select("doc_id", "lang", "source", "n_tokens", "ids", "decoded").collect()
    assert Counter((*r[:4], tuple(r[4]), r[5]) for r in map(tuple, final)) == expected


def test_kept_equals_a_plain_version(spark):
    """On a table whose larger languages have labels enough to certify cutoffs."""
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").join(
        spark.read.parquet(f"{folder}/labels.parquet").select("doc_id").distinct(), "doc_id"
    ).where("doc_id % 2 = 0").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = [tuple(r) for r in docs.collect()]
    keep = brute.quality_kept(rows, [tuple(r) for r in labels.select("doc_id", "quality").collect()], quality_rules.SETTINGS, 0.04, 0.05)
    got = {r.doc_id: r.kept for r in quality_rules.verdicts(docs, labels, 0.04, 0.05).collect()}
    assert got == {r[0]: k for r, k in zip(rows, keep, strict=True)}
    base = {r.doc_id for r in quality_rules.verdicts(docs, labels.limit(0), 0.04, 0.05).where("kept").collect()}
    assert {i for i, k in got.items() if k} < base  # cutoffs do reject some
    assert docs.where(F.col("doc_id").isNull()).isEmpty()


def test_an_empty_table_gives_no_rows(spark, tmp_path):
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
    pq.write_table(schema.empty_table(), tmp_path / "documents.parquet")
    labels = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())])
    pq.write_table(labels.empty_table(), tmp_path / "labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
