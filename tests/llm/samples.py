"""Small fixtures: ordinary texts and the awkward ones."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, seg int"


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def documents(seed=1, count=60):
    """Near copies, exact copies, shared passages, nulls, empties, repeated rows, a long text
    and columns with names that operators use inside."""
    rng = random.Random(seed)
    passage = " ".join(words(rng, 60))
    base = words(rng, 150)
    texts = []
    for i in range(count):
        own = words(rng, rng.randrange(1, 200))
        if i % 5 == 1:
            own = list(base)
            for _ in range(rng.randrange(0, 6)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(1000)}"
        if i % 7 == 2:
            own[len(own) // 2 : len(own) // 2] = passage.split()
        texts.append(" ".join(own) if i % 2 else "\n".join([" ".join(own[:20]), " ".join(own[20:])]))
    texts += [texts[1], texts[1].upper(), "", None, "  \n ", "one two", "one two", "é è ñ ß", " ".join(words(rng, 5000))]
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", None]), len(t or ""), "x", i) for i, t in enumerate(texts)]
    rows.append(rows[3])
    rows.append((None, texts[6], "en", "a", 5, "y", 1))
    rows.append((None, None, None, None, None, None, None))
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
