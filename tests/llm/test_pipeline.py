"""The stages against plain Python on planted documents, and the registered queries."""

import collections
import random

import corpus_pipeline
import pytest
from compare import DATA
from pyspark.sql import functions as F
from samples import words
from test_jaccard import brute as brute_classes
from test_quality import brute_kept

from maskloom.llm.queries import QUERIES

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    rows = []
    passage = words(rng, 60, 5000)
    items = [(i, " ".join(words(rng, 30, 5000)) + ".\n" + " ".join(words(rng, 6, 5000))) for i in range(5)]
    for i in range(300):
        own = words(rng, rng.randrange(60, 300), 5000)
        if i % 10 == 3:
            own[5:5] = passage
        if i % 40 == 7:
            own.append(items[i // 40 % 5][1])
        rows.append((i, " ".join(own), rng.choice(["en", "de"]), rng.choice(["a", "b"]), 0))
    copy = rows[0][1].split()
    copy[3] = "other"
    rows += [(900, rows[0][1], "en", "a", 0), (901, " ".join(copy), "en", "a", 0), (902, "too short", "en", "a", 0), (903, None, None, None, None)]
    rows += [(904, "| # " * 60 + " ".join(words(rng, 60, 5000)), "en", "a", 0), rows[5]]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, items


def test_stages_against_plain_python(spark, folder):
    path, rows, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "ngram_jaccard_join", "substring_dedup", "benchmark_decontamination", "best_fit_packing"]

    kept = stages["quality_rules"](spark, docs, path)
    want = [r for r, k in zip(rows, brute_kept(rows)) if k]
    assert collections.Counter(map(tuple, kept.collect())) == collections.Counter(want)

    single = stages["ngram_jaccard_join"](spark, kept, path)
    component = {r[0]: r[2] for r in brute_classes(want, 5, 80)}
    want = [r for r in dict.fromkeys(want) if component[r[0]] == r[0]]
    assert sorted(map(tuple, single.collect())) == sorted(want)

    cut = stages["substring_dedup"](spark, single, path)
    count = collections.Counter()
    for r in want:
        w = r[1].split()
        count.update(tuple(w[k : k + 35]) for k in range(len(w) - 34))
    after = []
    for r in want:
        w = r[1].split()
        gone = set()
        for k in range(len(w) - 34):
            if count[tuple(w[k : k + 35])] > 1:
                gone |= set(range(k, k + 35))
        text = " ".join(x for k, x in enumerate(w) if k not in gone) if gone else r[1]
        after.append((r[0], text, r[2], r[3], len(text) if gone else r[4]))
    assert sorted(map(tuple, cut.collect())) == sorted(after)

    clean = stages["benchmark_decontamination"](spark, cut, path)
    want = [r for r in after if not any(item in r[1] for _, item in items)]
    assert len(want) < len(after)
    assert sorted(map(tuple, clean.collect())) == sorted(want)

    packed = stages["best_fit_packing"](spark, clean, path)
    assert {r.doc_id for r in packed.collect()} == {r[0] for r in want}
    assert corpus_pipeline.run(spark, path).count() == packed.count()


def test_empty_and_awkward_documents(spark, folder):
    path = folder[0]
    none = spark.createDataFrame([], COLUMNS)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, " ".join(f"w{i}" for i in range(80)), None, None, 1)], COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, path).count() == 0
        got = stage(spark, odd.withColumn("seg", F.lit(1)), path)
        if name != "best_fit_packing":
            assert got.columns == [*odd.columns, "seg"]
            assert got.where("doc_id = 2").count() == 1


INTERNAL = [
    "_id", "_key", "_first", "_text_key", "id", "text_key", "first", "in_class", "copies", "row", "seg", "n_words", "n_removed", "made",
    "base_failed", "kept", "high_symbols", "low_length", "_lang", "_source", "own_0", "counted", "piece", "start", "length", "part", "word",
]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_any_column_names(spark, folder, name, stage):
    """Columns of the caller with names that operators use inside change nothing and come back."""
    path = folder[0]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    plain = stage(spark, docs, path)
    got = stage(spark, docs.withColumns({c: F.concat(F.lit("their "), F.col("doc_id")) for c in INTERNAL}), path)
    if name == "best_fit_packing":
        assert got.count() == plain.count()
        return
    assert got.columns == [*docs.columns, *INTERNAL]
    rows = collections.Counter(map(tuple, plain.collect()))
    assert collections.Counter(tuple(r)[: len(docs.columns)] for r in got.collect()) == rows
    assert got.where(" or ".join(f"`{c}` <> concat('their ', doc_id)" for c in INTERNAL)).count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_registered_queries_run(spark, name):
    rows = QUERIES[name](spark, f"{DATA}/sf0.001")
    whole = {"op8": "pages", "op9": "pages", "op2": "documents", "op3": "documents", "op4": "documents", "op5": "documents", "op7": "documents"}
    source = whole.get(name.split("_")[0])
    if source:
        assert rows.count() == spark.read.parquet(f"{DATA}/sf0.001/{source}.parquet").count()
    else:
        assert rows.count() > 0
