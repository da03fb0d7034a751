"""Metrics, moving average, candidates, vocabularies, sources and streams."""

import math
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from maskloom.operators import candidates, config, ema, metrics as mt, sequence as sq, tokens as tk
from maskloom.session import scratch_path, shared_dir
from maskloom.sources import corpora
from maskloom.streaming import jobs


def test_metrics(spark):
    nan = float("nan")
    df = spark.createDataFrame(
        [("a", 1.0, 1), ("a", 3.0, 1), ("a", 9.0, 0), ("a", nan, 1), ("b", 2.0, 0)],
        "g string, nll double, mask int",
    )
    got = {r["g"]: r for r in mt.metrics(df, "nll", "mask", ["g"]).collect()}
    assert got["a"]["nll"] == 2 and got["a"]["ppl"] == pytest.approx(math.exp(2))
    assert got["a"]["bpd"] == pytest.approx(2 / math.log(2))
    assert got["b"]["nll"] is None
    report = mt.nan_report(df.select("nll"), ["nll"]).first()
    assert (report["nans"], report["any_nan"], report["rows"]) == (1, True, 5)


def test_entropy(spark):
    rng = random.Random(2)
    rows = [(i, [rng.randint(0, 6) for _ in range(rng.randint(1, 60))]) for i in range(30)]
    df = spark.createDataFrame([*rows, (99, [])], "i int, ids array<int>")
    got = dict(df.select("i", mt.entropy_of_ids(F.col("ids"))).collect())
    for i, ids in rows:
        n = len(ids)
        want = -sum(c / n * math.log2(c / n) for c in Counter(ids).values())
        assert got[i] == pytest.approx(want, abs=1e-9)
    assert got[99] is None


def test_gen_ppl(spark):
    windows = spark.createDataFrame(
        [(0, [5, 6, 3, 7, 3]), (1, [3, 5, 3])], "w int, ids array<int>"
    )
    scores = spark.createDataFrame([(3, -1.0), (5, -2.0), (6, -3.0), (7, -4.0)], "id int, lp double")
    tokens = mt.counted_tokens(windows, "ids", 3, ["w"])
    assert sorted((r["w"], r["i"]) for r in tokens.collect()) == [(0, 1), (0, 2), (0, 3), (1, 1)]
    out = mt.gen_ppl(tokens, scores, ["id"]).first()
    assert out["tokens"] == 4 and out["unscored"] == 0
    assert out["gen_ppl"] == pytest.approx(math.exp((3 + 1 + 4 + 2) / 4))


def test_gen_ppl_of_windows(spark):
    """Arrays per window give what a row per position gives: missing, NaN, short and no scores."""
    rng = random.Random(4)
    windows = [(k, w, [rng.randrange(6) for _ in range(rng.randrange(1, 9))]) for k in range(30) for w in range(3)]
    scores = []
    for k, w, ids in windows:
        for i in range(len(ids) + 1):
            if rng.random() < 0.7 and k % 5:
                scores.append((k, w, i, float("nan") if rng.random() < 0.2 else -rng.random()))
    left = spark.createDataFrame(windows, "k int, window_id int, ids array<int>")
    right = spark.createDataFrame(scores, "k int, window_id int, i int, lp double")
    want = mt.gen_ppl(mt.counted_tokens(left, "ids", 3, ["k", "window_id"]), right, ["k", "window_id", "i"]).first()
    got = mt.window_ppl(left.join(mt.by_window(right, ["k", "window_id"]), ["k", "window_id"], "left"), "ids", 3).first()
    assert (got["tokens"], got["unscored"]) == (want["tokens"], want["unscored"]) and want["unscored"] > 9
    assert got["gen_ppl"] == pytest.approx(want["gen_ppl"])
    none = mt.window_ppl(left.where("false").withColumn("lps", F.array(F.lit(1.0))), "ids", 3).first()
    assert (none["tokens"], none["unscored"]) == (0, 0)


def series(values, decay):
    out, s = [], None
    for k, v in enumerate(values):
        s = v if k == 0 else s - (1 - min(decay, (1 + k) / (10 + k))) * (s - v)
        out.append(s)
    return out


@pytest.mark.parametrize("chunk, levels", [(2, 3), (5, 1), (512, 1), (4, 0)])
def test_ema_with_a_hot_key(spark, chunk, levels):
    rng = random.Random(3)
    names = ["a", "b", None, "c", "d"]
    rows = [(i, "hot" if i % 3 else names[i % 5], rng.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, key string, v double").repartition(5)
    out = ema.ema_warmup(df, ["key"], "id", "v", decay=0.9, chunk=chunk, levels=levels).collect()
    got = {(r["key"], r["k"]): r["shadow"] for r in out}
    want = {
        (key, k): s
        for key in {r[1] for r in rows}
        for k, s in enumerate(series([v for _, name, v in rows if name == key], 0.9))
    }
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_energy_resample(spark):
    weights = [0.6, 0.3, 0.1]
    n = 6000
    df = spark.range(n).select(
        F.col("id").alias("seq"),
        F.posexplode(F.array(*[F.lit(math.log(w)) for w in weights])).alias("cand_id", "e"),
    )
    counts = Counter(r["cand_id"] for r in candidates.energy_resample(df, "seq", "e", 1.0, 4).collect())
    for cand, w in enumerate(weights):
        assert abs(counts[cand] / n - w) < 4 * math.sqrt(w * (1 - w) / n)
    low = Counter(r["cand_id"] for r in candidates.energy_resample(df, "seq", "e", 0.05, 4, sign=-1).collect())
    assert low[2] == n


def test_char_tokenizer(spark):
    text = "the quick brown fox"
    df = spark.createDataFrame([(0, text), (1, "Aé\n😀Z"), (2, "")], "i int, t string")
    rows = df.select("i", "t", tk.char_encode(F.col("t")).alias("ids")).orderBy("i")
    got = [r["ids"] for r in rows.collect()]
    assert got[0] == [tk.CHAR_VOCAB.index(c) for c in text]
    assert got[1] == [8, 7, 7, 7, 33] and got[2] == []
    back = rows.select(tk.decode_ids(F.col("ids"), tk.CHAR_VOCAB)).collect()
    assert back[0][0] == text and back[1][0] == "a[UNK][UNK][UNK]z"
    vocab = spark.createDataFrame(list(enumerate(tk.CHAR_VOCAB)), "id int, token string")
    assert [r["decoded"] for r in tk.decode_table(rows, vocab).orderBy("i").collect()] == [r[0] for r in back]


def test_padding(spark):
    df = spark.createDataFrame([(0, [9, 9]), (1, list(range(10, 30)))], "i int, ids array<int>")
    out = df.select("i", tk.encode_padded(F.col("ids"), 6, 0, 1, 5).alias("e")).orderBy("i").collect()
    assert out[0]["e"]["input_ids"] == [0, 9, 9, 1, 5, 5]
    assert out[0]["e"]["attention_mask"] == [1, 1, 1, 1, 0, 0]
    assert out[1]["e"]["input_ids"] == [0, 10, 11, 12, 13, 1]
    assert out[1]["e"]["token_type_ids"] == [0] * 6


def test_special_tokens(spark):
    vocab = spark.createDataFrame([("[CLS]", 2), ("[SEP]", 3), ("x", 4)], "token string, id int")
    row = tk.special_token_resolve(vocab).first()
    assert (row["bos_id"], row["eos_id"], row["pad_id"], row["mask_id"]) == (2, 3, 5, None)
    assert tk.special_token_resolve(vocab, "first_encoded").first()["eos_id"] == 2
    grown = {r["token"]: r["id"] for r in tk.vocab_resize(vocab).collect()}
    assert grown["[MASK]"] == 3
    assert tk.vocab_resize(tk.vocab_resize(vocab)).count() == 4


def test_config_rules(spark):
    rows = [
        ("subs", 0, False, False, False, []),
        ("sedd", 0, True, False, False, ["sedd_plain"]),
        ("d3pm", 0, False, False, True, ["d3pm_discrete"]),
        ("ar", 10, True, True, True, ["one_variance_reduction", "discrete_kinds", "subs_masking_d3pm"]),
    ]
    df = spark.createDataFrame(
        rows,
        "parameterization string, T int, importance_sampling boolean, change_of_variables boolean, "
        "subs_masking boolean, want array<string>",
    )
    assert all(r["violations"] == r["want"] for r in config.config_violations(df).collect())


def test_text_lines(spark, tmp_path):
    files = {
        "b.train": "second file\r\n\r\n  padded  \nlast without newline",
        "a.train": "first\n\n   \nline two\n",
        "ignored.txt": "no\n",
    }
    for name, text in files.items():
        (tmp_path / name).write_bytes(text.encode())
    rows = corpora.read_text_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(r["line_no"], r["file"], r["text"]) for r in rows] == [
        (0, "a.train", "first"),
        (1, "a.train", "line two"),
        (2, "b.train", "second file"),
        (3, "b.train", "padded"),
        (4, "b.train", "last without newline"),
    ]
    with pytest.raises(ValueError):
        corpora.read_text_lines(spark, str(tmp_path), "*.none")


def test_line_numbers_over_many_blocks(spark, tmp_path):
    for f in range(3):
        lines = [f"file {f} line {i}" for i in range(500)]
        (tmp_path / f"{f}.train").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = corpora.read_text_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["line_no"] for r in rows] == list(range(1500))
    assert [r["text"] for r in rows] == [f"file {f} line {i}" for f in range(3) for i in range(500)]


def test_jsonl(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"text": "a", "more": 1}\n\n{"text": "b"}\n')
    assert sorted(r["text"] for r in corpora.read_jsonl(spark, str(tmp_path)).collect()) == ["a", "b"]
    (tmp_path / "y.jsonl").write_text("{broken\n")
    with pytest.raises(Exception):
        corpora.read_jsonl(spark, str(tmp_path)).collect()


def test_cache(spark):
    folder = scratch_path(spark, "cache")
    names = {
        corpora.cache_name("c", "train", 8, wrap, tok, src)
        for wrap in (True, False)
        for tok in ("t1", "t2")
        for src in ("s1", "s2")
    }
    assert len(names) == 8
    built = []

    def build():
        built.append(1)
        return spark.range(5)

    name = names.pop()
    assert corpora.cached(spark, folder, name, build).count() == 5
    assert corpora.cached(spark, folder, name, build).count() == 5
    assert built == [1]


def test_cache_follows_contents(spark, tmp_path):
    from maskloom.operators import bpe
    from maskloom.sources import prepare as pr

    source, cache = tmp_path / "in", scratch_path(spark, "cache")
    spark.createDataFrame([("aa ab",)] * 4, "text string").coalesce(1).write.parquet(f"{source}/lm1b-gpt2/lm1b/test")
    root = f"{source}/lm1b-gpt2"

    def rows(merges, tokens):
        model = bpe.BpeModel([*tk.BPE_SPECIALS, *tokens], merges)
        out = pr.prepare(spark, "lm1b", "test", root, pr.bpe_tokenizer(model, "mine"), 8, cache)
        return [r["input_ids"] for r in out.collect()]

    plain = rows([], ["a", "b"])
    merged = rows([(7, 7, 9)], ["a", "b", "aa"])
    assert plain != merged and len(plain) == 4
    spark.createDataFrame([("b",)], "text string").coalesce(1).write.mode("append").parquet(f"{root}/lm1b/test")
    assert len(rows([], ["a", "b"])) == 5


def test_rows_are_numbered_densely(spark, tmp_path):
    from maskloom.sources import prepare as pr

    for part, n in enumerate((3, 0, 5, 1)):
        spark.range(n).withColumn("doc_id", F.lit("mine")).coalesce(1).write.mode("append").parquet(str(tmp_path))
    df = spark.read.parquet(str(tmp_path))
    assert sorted(r["doc_id"] for r in pr.with_doc_id(df).collect()) == list(range(9))
    with pytest.raises(ValueError):
        pr.with_doc_id(df, "id")


def test_energy_of_small_sequences(spark):
    """Two positions by hand, and a sequence with a position that has no scores."""
    m = 2
    scores = [(0, 0, [0.0, 1.0, 5.0], [1.0, 0.0, 9.0]), (0, 1, [2.0, 0.0, 5.0], [0.0, 3.0, 9.0]), (1, 0, [0.0] * 3, [0.0] * 3)]
    cells = [(0, 0, 2, [0, 1]), (0, 1, 1, [1, 0]), (1, 0, 2, [0, 0]), (1, 1, 2, [0, 0])]
    got = {
        r["s"]: r
        for r in mt.sequence_energy(
            spark.createDataFrame(scores, "s int, p int, ar array<double>, diffusion array<double>"),
            spark.createDataFrame(cells, "s int, p int, xt int, tokens array<int>"),
            "s", "p", m,
        ).collect()
    }
    z = math.log(math.exp(1) + 1)
    # position 0 is hidden; position 1 shows token 1, which the second candidate changes
    assert got[0]["energies"][0] == pytest.approx(1 - z)
    assert got[0]["energies"][1] == pytest.approx(0 - z - 1e6 + 1e6)
    assert (got[0]["n"], got[0]["missing"]) == (2, 0)
    assert got[1]["energies"] is None and (got[1]["n"], got[1]["missing"]) == (2, 1)


def test_lost_state_stops_the_stream(spark):
    rows = [(i, [i] * 5) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, ids array<int>")
    path = scratch_path(spark, "lost")
    stream = written(spark, df, f"{path}/in", 4, "id")
    jobs.stream_pack(stream, "id", "ids", 8, path, f"{path}/checkpoint").awaitTermination()
    with pytest.raises(RuntimeError):
        jobs._read_state(spark, f"{path}/state", 9)
    assert not os.path.exists(f"{path}/state/epoch=0")


def test_pack_by_key_over_batches(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice("abc"), [rng.randint(0, 99) for _ in range(rng.randint(0, 9))]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, g string, ids array<int>")
    path = scratch_path(spark, "bykey")
    stream = written(spark, df, f"{path}/in", 4, "id")
    blocks = jobs.pack_by_key(stream, "g", "id", "ids", 7, 2, 3)
    query = blocks.writeStream.format("parquet").option("checkpointLocation", f"{path}/c").trigger(availableNow=True).start(f"{path}/out")
    query.awaitTermination()
    got = {(r["g"], r["block_id"]): r["input_ids"] for r in spark.read.parquet(f"{path}/out").collect()}
    for g in "abc":
        flat = [x for _, name, ids in rows if name == g for x in ids]
        for b in range(len(flat) // 5):
            assert got.pop((g, b)) == [2, *flat[b * 5 : b * 5 + 5], 3]
    assert not got


@pytest.mark.parametrize("seed, longest, size", [(1, 9, 7), (2, 3, 40), (3, 60, 12)])
def test_groups_packed_over_batches(spark, seed, longest, size):
    """A value with most rows, one that pauses and one at the end of a block; null is a value."""
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), [rng.randint(0, 99) for _ in range(rng.randint(0, longest))]) for i in range(60)]
    rows[0] = (0, "early", list(range(size - 2)))
    rows[1] = (1, "pause", [5, 6])
    rows[55] = (55, "early", list(range(size - 1)))
    rows[56] = (56, "pause", list(range(size)))
    df = spark.createDataFrame(rows, "id long, g string, ids array<int>")
    path = scratch_path(spark, "groups")
    stream = written(spark, df, f"{path}/in", 4, "id")
    jobs.stream_pack_groups(stream, "g", "id", "ids", size, path, f"{path}/c").awaitTermination()
    found = jobs.packed_blocks(spark, path, size, 2, 3, by="g").collect()
    got = {(r["g"], r["block_id"]): r["input_ids"] for r in found}
    assert len(got) == len(found)
    body = size - 2
    for g in ["a", "b", None, "early", "pause"]:
        flat = [x for _, name, ids in rows if name == g for x in ids]
        for b in range(len(flat) // body):
            assert got.pop((g, b)) == [2, *flat[b * body : (b + 1) * body], 3]
    assert not got


def test_ingest_spreads_a_hot_source(spark, monkeypatch):
    """No source meets in one task: the registered query does not use state per key."""
    monkeypatch.setattr(jobs, "pack_by_key", None)
    from maskloom.plans import QUERIES

    folder = scratch_path(spark, "hot")
    rows = [(i, "src1" if i % 9 else "src2", "some words " * (i % 7)) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{folder}/documents.parquet")
    blocks = QUERIES["stream_ingest"](spark, folder)
    ids = blocks.groupBy("source").agg(F.count("block_id").alias("n"), F.max("block_id").alias("top")).collect()
    assert {r["source"] for r in ids} == {"src1", "src2"} and all(r["n"] == r["top"] + 1 for r in ids)


def test_late_rows_are_left_out(spark):
    import datetime as dt

    path = scratch_path(spark, "late")
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(hours=h), 1.0 + h, 1) for i, h in enumerate([0, 1, 50, 51, 0, 52])]
    df = spark.createDataFrame(rows, "id long, ts timestamp, nll double, mask int")
    stream = written(spark, df, f"{path}/in", 6, "id")
    jobs.run_metrics(jobs.stream_metrics(stream, "nll", "mask", "ts", "1 hour", "1 hour"), path, f"{path}/c").awaitTermination()
    got = {r["epoch"].hour + 24 * (r["epoch"].day - 1): r["nll"] for r in jobs.latest_metrics(spark, path).collect()}
    assert got[0] == 1.0 and got[52] == 53.0


def test_catalog(spark):
    df = spark.createDataFrame([("ptb",), ("unlisted",), ("scientific_papers_pubmed",)], "corpus string")
    got = {r["corpus"]: r for r in corpora.describe(df).collect()}
    assert got["ptb"]["text_column"] == "sentence" and got["unlisted"]["path"] == "unlisted"
    assert got["unlisted"]["text_column"] == "text" and got["unlisted"]["detokenizer"] is None
    wide = spark.createDataFrame([("a", "b", "c", [1])], "article string, abstract string, section_names string, ids array<int>")
    assert corpora.drop_source_columns(wide, "scientific_papers_pubmed").columns == ["ids"]


def test_shared_folder_comes_from_the_session(spark):
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert spark.sparkContext.getCheckpointDir() is not None
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def written(spark, df, folder, parts, key):
    """One file per range of the key, in order of their time stamps."""
    n = df.count()
    for part in range(parts):
        low, high = part * n // parts, (part + 1) * n // parts
        path = f"{folder}/part{part}"
        df.where(F.col(key).between(low, high - 1)).coalesce(1).write.parquet(path)
        for name in os.listdir(path):
            if name.endswith(".parquet"):
                os.utime(f"{path}/{name}", (1_700_000_000 + part, 1_700_000_000 + part))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


@pytest.mark.parametrize("seed, longest, size", [(1, 12, 8), (2, 3, 40), (3, 60, 12)])
def test_stream_pack_over_batches(spark, seed, longest, size):
    rng = random.Random(seed)
    rows = [(i, [rng.randint(0, 99) for _ in range(rng.randint(0, longest))]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, ids array<int>")
    path = scratch_path(spark, "pack")
    stream = written(spark, df, f"{path}/in", 5, "id")
    jobs.stream_pack(stream, "id", "ids", size, path, f"{path}/checkpoint").awaitTermination()
    got = jobs.packed_blocks(spark, path, size, 2, 3).orderBy("block_id").collect()
    want = sq.pack_blocks_global(df, "id", "ids", size, 2, 3).orderBy("block_id").collect()
    assert [(r["block_id"], r["input_ids"]) for r in got] == [(r["block_id"], r["input_ids"]) for r in want]
    assert os.path.exists(f"{path}/state/epoch=4")


def test_stream_ema_over_batches(spark):
    rng = random.Random(7)
    rows = [(i, (i % 4 or None) if i % 3 else 9, rng.random()) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, key int, v double")
    path = scratch_path(spark, "ema")
    stream = written(spark, df, f"{path}/in", 4, "id")
    jobs.stream_ema(stream, ["key"], "id", "v", path, f"{path}/checkpoint", 0.8).awaitTermination()
    got = {(r["key"], r["k"]): r["shadow"] for r in spark.read.parquet(f"{path}/series").collect()}
    want = {(r["key"], r["k"]): r["shadow"] for r in ema.ema_warmup(df, ["key"], "id", "v", 0.8).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def prepared(spark, tmp_path, corpus, mode, **kw):
    from maskloom.sources import prepare as pr

    return pr.prepare(
        spark, corpus, mode, str(tmp_path), pr.char_tokenizer(), 16, scratch_path(spark, "prep"), **kw
    )


def test_prepare_line_corpus(spark, tmp_path):
    (tmp_path / "a.train").write_text("\n".join(f"some words in line {'abcdefgh'[i % 8]}" for i in range(60)))
    train = prepared(spark, tmp_path, "babylm", "train", group_size=None)
    valid = prepared(spark, tmp_path, "babylm", "validation", wrap=False)
    # 54 lines of 20 characters and EOS, cut in bodies of 14
    assert train.count() == 54 * 21 // 14
    assert valid.count() == 6
    row = valid.first()
    assert len(row["input_ids"]) == len(row["attention_mask"]) == 16
    assert row["input_ids"][0] == 0 and row["input_ids"][-1] == 1


def test_prepare_named_tables(spark, tmp_path):
    rows = spark.createDataFrame([(f"a , b {i}",) for i in range(40)], "text string")
    rows.coalesce(1).write.parquet(f"{tmp_path}/lm1b/test")
    out = prepared(spark, tmp_path, "lm1b", "test", wrap=False)
    assert out.count() == 40
    ids = tk.CHAR_VOCAB
    first = out.orderBy("doc_id").first()["input_ids"]
    assert [ids[i] for i in first[1:4]] == ["a", "[UNK]", " "]
    papers = spark.createDataFrame([("= = T = =", "x", "y")], "article string, abstract string, section_names string")
    papers.write.parquet(f"{tmp_path}/scientific_papers/arxiv/train")
    got = prepared(spark, tmp_path, "scientific_papers_arxiv", "train", wrap=False).first()
    assert "".join(ids[i] for i in got["input_ids"][1:8]) == "[UNK][UNK] t [UNK][UNK]"


def test_prepare_long_string(spark, tmp_path, monkeypatch):
    from maskloom.sources import prepare as pr

    monkeypatch.setattr(pr, "TEXT8_TRAIN_END", 400)
    monkeypatch.setattr(pr, "TEXT8_VALID_END", 500)
    (tmp_path / "text8").write_text("abcdefghij" * 60)
    assert pr.load(spark, "text8", "validation", str(tmp_path), 16).count() == 6
    train = pr.load(spark, "text8-crop", "train", str(tmp_path), 32)
    assert train.count() == 6 and all(len(r["text"]) == 64 for r in train.collect())
    with pytest.raises(ValueError):
        prepared(spark, tmp_path, "text8", "test", wrap=False)


def test_prepare_holdout(spark, tmp_path, monkeypatch):
    from maskloom.sources import prepare as pr

    monkeypatch.setattr(pr, "HOLDOUT_ROWS", 7)
    spark.range(30).select(F.concat(F.lit("row "), F.col("id")).alias("text")).coalesce(1).write.parquet(
        f"{tmp_path}/openwebtext"
    )
    valid = pr.load(spark, "openwebtext-valid", "train", str(tmp_path), 16)
    assert sorted(r["text"] for r in valid.collect()) == [f"row {i}" for i in range(23, 30)]
    assert pr.load(spark, "openwebtext-train", "train", str(tmp_path), 16).count() == 23


def test_prepare_lambada(spark, tmp_path):
    (tmp_path / "lambada_test.jsonl").write_text('{"text": " “hi” "}\n{"text": "you"}\n')
    out = prepared(spark, tmp_path, "lambada", "train", wrap=False).orderBy("doc_id").first()
    assert out["input_ids"][1:5] == [7, 7, 15, 16]


def test_loss_by_kind(spark):
    from maskloom.operators import evaluate as ev

    rows = spark.createDataFrame(
        [(0, 1, 3, 0.3, 0.5, 1.2, [0.1, 0.7, -0.2, 0.0])],
        "i int, x0 int, xt int, t double, sigma double, rate double, s array<double>",
    )
    z = math.log(sum(math.exp(v) for v in (0.1, 0.7, -0.2)))
    got = {
        name: rows.select(ev.token_loss(kind, "s", 3, **kw).alias("o")).first()["o"]
        for name, kind, kw in (
            ("subs", "subs", {}),
            ("cov", "subs", {"sigma_min": 0.001, "evenly_spaced": True}),
            ("ar", "ar", {}),
            ("d3pm", "d3pm", {"steps": 10, "clean_scores": "s"}),
            ("discrete", "subs", {"steps": 10}),
        )
    }
    assert got["subs"] == pytest.approx((z - 0.7) * 1.2 / math.expm1(0.5))
    assert got["cov"] == pytest.approx((0.7 - z) * math.log1p(-math.exp(-0.001)))
    assert got["ar"] == pytest.approx(z - 0.7, abs=1e-6)
    # substitution leaves the mask no probability, so both logarithms vanish
    assert got["discrete"] == pytest.approx(10 * (1 / 3) * (z - 0.7))
    whole = math.log(sum(math.exp(v) for v in (0.1, 0.7, -0.2, 0.0)))
    p = math.exp(0.0 - whole)
    now, before = math.log(0.7 * p / 0.3 + 1), math.log(0.8 * p / 0.2 + 1)
    want = 10 * ((now - (0.7 - whole)) / 3 + 2 / 3 * (now - before)) + whole - 0.7
    assert got["d3pm"] == pytest.approx(want)


def test_gen_ppl_makes_log_probabilities_behind_the_join(spark):
    """The same as from a table that holds them, and no double and no id is moved."""
    from maskloom.operators import evaluate as ev, sequence as sq

    rng = random.Random(8)
    rows = [(k, [rng.randrange(5) for _ in range(rng.randrange(0, 30))]) for k in range(40)]
    docs = spark.createDataFrame(rows, "k long, ids array<int>")
    # some windows have no scores, some too few
    given = [(k, w, min(4, len(ids) - 4 * w) - k % 2, k / 7) for k, ids in rows for w in range(-(-len(ids) // 4)) if (k + w) % 5]
    scores = spark.createDataFrame(given, "k long, window_id int, n int, x double").repartition(3)

    @F.arrow_udf("array<double>")
    def each(x, n):
        import pyarrow as pa

        pairs = zip(x.to_pylist(), n.to_pylist())
        return pa.array([None if v is None else [-v - i for i in range(m)] for v, m in pairs], pa.list_(pa.float64()))

    lps = each(F.col("x"), F.col("n"))
    made = scores.select("k", "window_id", lps.alias("lps"))
    windows = ev.context_windows(docs, "k", "ids", 4, 0)
    want = ev.gen_ppl(windows, "k", made).first()
    cells = mt.counted_tokens(sq.context_split(docs, "ids", 4), "ids", 0, ["k", "window_id"])
    each_row = made.select("k", "window_id", F.posexplode("lps").alias("i", "lp"))
    plain = mt.gen_ppl(cells, each_row, ["k", "window_id", "i"]).first()
    assert (plain["tokens"], plain["unscored"]) == (want["tokens"], want["unscored"])
    assert plain["gen_ppl"] == pytest.approx(want["gen_ppl"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = ev.gen_ppl(windows, "k", scores, lps)
        got, plan = found.first(), found._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert (got["tokens"], got["unscored"]) == (want["tokens"], want["unscored"]) and want["unscored"] > 9
    assert got["gen_ppl"] == pytest.approx(want["gen_ppl"])
    types = moved(plan)
    assert "boolean" in types and "array<double>" not in types and "array<int>" not in types


def moved(plan):
    """The types of all columns that the plan's exchanges carry."""
    out, stack = set(), [plan]
    while stack:
        node = stack.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            node = node.initialPlan()
        if node.nodeName() == "Exchange":
            out.add(node.schema().simpleString())
        kids = node.children()
        stack += [kids.apply(i) for i in range(kids.size())]
    return " ".join(out)


@pytest.mark.parametrize("name", ["gen_ppl", "sample_eval"])
def test_blocks_are_packed_once(spark, monkeypatch, name):
    """Every text is packed once."""
    from maskloom.plans import QUERIES, metrics as plans

    calls, real = [], plans.packed
    monkeypatch.setattr(plans, "packed", lambda *a: calls.append(1) or real(*a))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = QUERIES[name](spark, "/root/testdata/sf0.001")
        assert len(df.collect()) == 1 and len(calls) == 1
        plan = df._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # what the result reads are tables, and its join moves neither scores nor ids
    assert "lower(" not in plan.toString()
    assert "boolean" in moved(plan) and "array<double>" not in moved(plan) and "array<int>" not in moved(plan)


def test_retokenized_samples_move_as_they_came(spark):
    from maskloom.operators import evaluate as ev

    rows = [(i, i // 3, [8 + (i * j) % 9 for j in range(i % 7 + 1)]) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, b long, ids array<int>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = df.select("id", "b", tk.decode_ids(F.col("ids"), tk.CHAR_VOCAB).alias("ids"))
        short = df.withColumn("ids", F.col("ids").cast("array<tinyint>"))
        out = tk.retokenize(text.repartition(2), "ids", "b", 5, 0, tk.code_points)
        got, plan = sorted(map(tuple, out.collect())), out._jdf.queryExecution().executedPlan()
        same = ev.retokenized(short, "ids", "b", lambda ids: tk.decode_ids(ids, tk.CHAR_VOCAB), tk.code_points, 5, 0)
        whole = tk.retokenize(text.withColumn("ids", tk.code_points(F.col("ids"))), "ids", "b", 5, 0)
        assert got == sorted(map(tuple, same.collect())) == sorted(map(tuple, whole.collect())) and len(got) == 30
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "string" in moved(plan) and "array" not in moved(plan)
    assert "array<tinyint>" in moved(same._jdf.queryExecution().executedPlan())
