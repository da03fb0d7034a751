import collections
import math
import random
import re

from pyspark.sql import functions as F
from samples import documents, empty, frame

from maskloom.llm import quality
from maskloom.llm.quality import ACCURACY, COUNTS, FENCES, GAMMA, LEAST_ROWS, QUANTILES, REACH, TAIL_REACH, TAILS, UNITS, fences, measure, rejections, rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = collections.Counter(zip(w, w[1:], w[2:]))
    hit = set()
    for i in range(len(w) - 2):
        if seen[tuple(w[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), len(lines))


def odd_rows():
    rows = documents()
    texts = ["a b c a b c\na b c", "x | y | z", "##\n##\n  \n##", "é b \x1c c", "same same same same", "$1 & <b>"]
    return rows + [(2000 + i, t, "en", "a", 1, "", 0) for i, t in enumerate(texts)]


def test_counts(spark):
    got = collections.Counter(tuple(r[c] for c in ["doc_id", *COUNTS]) for r in measure(frame(spark, odd_rows())).collect())
    assert got == collections.Counter((r[0], *counts(r[1])) for r in odd_rows())


def test_quantiles_are_accurate_and_merge(spark):
    docs = frame(spark, documents(count=400))
    measured = measure(docs)
    whole = quality.quantiles(quality.sketch(measured, []), []).collect()
    merged = quality.quantiles(quality.merged(quality.sketch(measured, ["lang", "source"]), []), []).collect()
    assert sorted(whole) == sorted(merged)
    values = [counts(r[1]) for r in documents(count=400)]
    lengths = sorted(v[1] / v[0] for v in values if passes(v))
    for r in whole:
        if r.feature == "length":
            for q, share in QUANTILES.items():
                exact = lengths[math.ceil(share * len(lengths)) - 1]
                assert abs(r[q] - exact) <= ACCURACY * exact * 1.001


def passes(c):
    return c[0] >= 50 and 100 * c[4] <= 50 * c[0]


def brute_kept(rows):
    """Fences from the same buckets, gathered in plain dictionaries."""
    counted = [counts(r[1]) for r in rows]
    features = {}
    for i, c in enumerate(counted):
        n, chars, symbols, dup, repeat, lines = c
        if passes(c):
            features[i] = dict(symbols=symbols / max(chars, 1), lines=dup / max(lines, 1), repeats=repeat / n, length=chars / n)

    def quantiles(members, name):
        # the rank-th value, rounded up to its bucket
        ordered, out = sorted(features[i][name] for i in members), {}
        for q, share in QUANTILES.items():
            v = ordered[math.ceil(share * len(members)) - 1]
            out[q] = 0.0 if v <= 0 else GAMMA ** math.ceil(math.log(v) / math.log(GAMMA)) * 2 / (1 + GAMMA)
        return out

    known, kept = {}, []
    for i, (r, c) in enumerate(zip(rows, counted)):
        if i not in features:
            kept.append(False)
            continue
        if r[2:4] not in known:
            wide = [j for j in features if rows[j][2] == r[2]]
            wide = wide if len(wide) >= LEAST_ROWS else list(features)
            own = [j for j in features if rows[j][2:4] == r[2:4]]
            own = own if len(own) >= LEAST_ROWS else wide
            known[r[2:4]] = {k: (quantiles(own, k), quantiles(wide, k)) for k in features[i]}
        ok = True
        for name, value in features[i].items():
            near, wide = known[r[2:4]][name]
            if name == "length":
                spread = max(near["q75"] - near["q25"], wide["q75"] - wide["q25"])
                ok &= (near["q25"] - REACH * spread) / GAMMA <= value <= (near["q75"] + REACH * spread) * GAMMA
                continue
            low, high = TAILS[name]
            fence, broad = (q[high] + TAIL_REACH * (q[high] - q[low]) for q in (near, wide))
            if near[low] <= broad:
                fence = min(fence, broad)
            unit, total = UNITS[name]
            ok &= value <= max(fence * GAMMA, unit / max(dict(zip(COUNTS, c))[total], 1))
        kept.append(ok)
    return kept


def test_same_as_brute_force(spark):
    rows = documents(count=1500)
    bad = [(5000 + i, " | ".join(f"w{j}" for j in range(80)), "en", "a", 1, "", 0) for i in range(5)]
    bad += [(6000, " ".join("verylongwordindeed%d" % j for j in range(90)), "fr", "b", 1, "", 0)]
    rows += bad
    got = collections.Counter((r.doc_id, r.n_words, r.kept) for r in rules(frame(spark, rows)).collect())
    want = collections.Counter((r[0], counts(r[1])[0], k) for r, k in zip(rows, brute_kept(rows)))
    assert got == want
    assert not any(k for (key, _, k) in got if key is not None and key >= 5000)
    short = rules(frame(spark, rows), keep_text=False)
    assert "text" not in short.columns
    assert collections.Counter((r.doc_id, r.n_words, r.kept) for r in short.collect()) == got


def test_a_source_with_its_own_habits(spark):
    """A source in which symbols are usual keeps its texts; elsewhere the same text goes."""
    def text(i, sign):
        return " ".join(f"{sign * ((i + j) % 3)}w{i}x{j}" for j in range(60))

    rows = [(i, text(i, "#"), "en", "code", 1, "", 0) for i in range(LEAST_ROWS)]
    rows += [(1000 + i, text(i, ""), "en", "prose", 1, "", 0) for i in range(LEAST_ROWS)]
    rows.append((9999, text(1, "#"), "en", "prose", 1, "", 0))
    kept = {r.doc_id: r.kept for r in rules(frame(spark, rows)).collect()}
    assert not kept.pop(9999) and all(kept.values())


def test_junk_in_a_source_does_not_lift_its_fence(spark):
    """A third of a source is junk: its fence is bounded by the language's, and the junk goes."""
    def text(i, sign):
        return " ".join(f"w{i:04d}x{j:02d}{sign if j % 2 else ''}" for j in range(60))

    rows = [(i, text(i, "##" if i % 3 == 0 else ""), "en", "bad", 1, "", 0) for i in range(300)]
    rows += [(1000 + i, text(i, ""), "en", "good", 1, "", 0) for i in range(900)]
    rows.append((5000, text(1, "") + " #", "en", "good", 1, "", 0))
    docs = frame(spark, rows)
    kept = {r.doc_id: r.kept for r in rules(docs).collect()}
    assert {i for i, ok in kept.items() if not ok} == set(range(0, 300, 3))
    counted = measure(docs)
    report = {r.source: r for r in rejections(counted, fences(counted)).collect()}
    assert (report["bad"].n, report["bad"].out_symbols, report["good"].out_symbols, report["bad"].base_failed) == (300, 100, 0, 0)


def test_copies_of_one_text_leave_others_alone(spark):
    """Half of a source is one text; the spread of word lengths is that of the language."""
    rng = random.Random(8)
    def text():
        return " ".join("x" * rng.randrange(2, 9) + str(rng.randrange(9999)) for _ in range(80))

    same = text()
    rows = [(i, same if i % 10 < 6 else text(), "en", "copies", 1, "", 0) for i in range(500)]
    rows += [(1000 + i, text(), "en", "others", 1, "", 0) for i in range(1500)]
    assert all(r.kept for r in rules(frame(spark, rows)).collect())


def test_fences_differ_and_names_do_not_clash(spark):
    rows = documents(count=3000)
    rows += [(3000 + i, " ".join(f"{'#' * (j % 2)}w{i}x{j}" for j in range(70)), "fr", "code", 1, "", 0) for i in range(LEAST_ROWS)]
    docs = frame(spark, rows)
    limits = {(r.lang, r.source): r.high_symbols for r in fences(measure(docs)).collect()}
    assert limits["fr", "code"] > 0.05 > limits["fr", "a"]
    want = collections.Counter((r.doc_id, r.kept) for r in rules(docs).collect())
    clashing = [*FENCES, "n_words", "_lang", "_source", "own_0", "made_kept", "counted", "feature", "bucket"]
    for name in clashing:
        docs = docs.withColumn(name, F.lit("theirs"))
    got = rules(docs)
    assert collections.Counter((r.doc_id, r.kept) for r in got.collect()) == want
    assert {r[0] for r in got.select("high_symbols").distinct().collect()} == {"theirs"}


def test_empty_table(spark):
    assert rules(empty(spark)).count() == 0 and fences(measure(empty(spark))).count() == 0
    assert rules(frame(spark).withColumn("kept", F.lit(1))).schema["kept"].dataType.simpleString() == "boolean"
