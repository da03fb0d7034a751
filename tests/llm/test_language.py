import math

import numpy as np
from compare import DATA
from pyspark.sql import functions as F
from samples import empty, frame

from maskloom.llm.language import ORDER, ContextTrees, fit, held_out, predict


def brute(counts, data):
    """Code length by walking the contexts byte by byte."""
    used = {b for grams in counts.values() for g in grams for b in g} | {10}
    out = {}
    for language, grams in counts.items():
        tree = {}
        for g, n in grams.items():
            for d in range(ORDER + 1):
                nexts = tree.setdefault(g[ORDER - d : ORDER], {})
                nexts[g[ORDER]] = nexts.get(g[ORDER], 0) + n
        bits, text = 0.0, bytes([10]) * ORDER + data
        for i in range(ORDER, len(text)):
            for d in range(ORDER, -1, -1):
                # an unseen byte value breaks the context it stands in
                context = text[i - d : i]
                nexts = tree.get(context) if all(b in used for b in context) else None
                if nexts:
                    total, kinds = sum(nexts.values()), len(nexts)
                    if text[i] in nexts:
                        bits += math.log2((total + kinds) / nexts[text[i]])
                        break
                    bits += math.log2((total + kinds) / kinds)
            else:
                bits += 8
        out[language] = bits
    return out


def test_code_lengths_are_exact():
    def grams(text):
        data = bytes([10]) * ORDER + text
        found = {}
        for i in range(len(data) - ORDER):
            found[data[i : i + ORDER + 1]] = found.get(data[i : i + ORDER + 1], 0) + 1
        return found

    counts = {"a": grams(b"the cat and the hat " * 3), "b": grams("der Hut für die Katze ".encode() * 2)}
    trees = ContextTrees.fit(counts)
    texts = [b"the hat", "für die Katze".encode(), b"", b"\x00zz the", b"q"]
    got = trees.code_lengths(texts)
    for row, text in zip(got, texts):
        want = brute(counts, text)
        assert np.allclose(row, [want["a"], want["b"]], rtol=1e-5)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    trees = fit(docs.where(~held_out()))
    rows = predict(docs, trees).where(held_out()).select(F.col("lang") == F.col("lang_pred")).collect()
    assert len(rows) > 150 and sum(r[0] for r in rows) >= 0.97 * len(rows)


def test_awkward_rows(spark):
    docs = frame(spark)
    trees = fit(docs)
    rows = predict(docs.withColumn("score", F.lit("old")), trees).collect()
    assert len(rows) == docs.count()
    assert all(0 <= r.score <= 1 for r in rows)
    pred = {(r.doc_id, r.row): r.lang_pred for r in rows}
    assert pred[62, "x"] == pred[63, "x"] == pred[None, None] == "und"
    assert predict(empty(spark), trees).count() == 0
    assert {r.lang_pred for r in predict(docs, fit(empty(spark))).collect()} == {"und"}
