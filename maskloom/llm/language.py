"""Language identification by prediction by partial matching over bytes.

For every language a tree of byte contexts of up to ``ORDER`` bytes holds how often each
byte followed. A byte is coded in the longest context that has been seen; a byte that is
new there costs an escape and is coded in the next shorter context, at last uniformly. With
frozen counts the code length of a text is a plain sum, and the language with the shortest
code wins.
"""

from __future__ import annotations

import regex

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from maskloom.llm.common import as_fields, byte_slices, carried, given_back

ORDER = 3
#: rows per language that the counts are taken from (all, where there are fewer)
FIT_ROWS = 2000
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_START = 10  # every text begins in the context of newlines


class ContextTrees:
    """Code lengths of all languages in two tables: a node for each context of ``ORDER``
    bytes (contexts that were never seen share the node of their longest seen suffix), and
    the bits of each byte class in each node."""

    def __init__(self, languages: list[str], symbol: np.ndarray, node: np.ndarray, bits: np.ndarray):
        self.languages, self.symbol, self.node, self.bits = languages, symbol, node, bits

    @classmethod
    def fit(cls, counts: dict[str, dict[bytes, int]]) -> ContextTrees:
        """From counts of byte strings of length ``ORDER + 1`` per language."""
        languages = sorted(counts)
        used = sorted({b for grams in counts.values() for g in grams for b in g} | {_START})
        # one class for all bytes that were never seen
        symbol = np.full(256, len(used), np.uint16)
        symbol[used] = np.arange(len(used))
        size = len(used) + 1
        # per language and depth: context -> counts of the next symbol
        trees = []
        for language in languages:
            tree: list[dict[tuple, dict[int, int]]] = [{} for _ in range(ORDER + 1)]
            for gram, n in counts[language].items():
                s = tuple(int(symbol[b]) for b in gram)
                for depth in range(ORDER + 1):
                    nexts = tree[depth].setdefault(s[ORDER - depth : ORDER], {})
                    nexts[s[ORDER]] = nexts.get(s[ORDER], 0) + n
            trees.append(tree)

        uniform = np.full(size, np.log2(256.0))

        def lengths(lower: np.ndarray, nexts: dict[int, int] | None) -> np.ndarray:
            if not nexts:
                return lower
            total, kinds = sum(nexts.values()), len(nexts)
            out = lower + np.log2((total + kinds) / kinds)  # the escape
            for s, n in nexts.items():
                out[s] = np.log2((total + kinds) / n)
            return out

        contexts = [set() for _ in range(ORDER + 1)]
        for tree in trees:
            for depth in range(ORDER + 1):
                contexts[depth] |= set(tree[depth])
        index: dict[tuple, int] = {}
        rows = []
        for depth in range(ORDER + 1):
            for context in sorted(contexts[depth]) or [()]:
                index[context] = len(rows)
                row = np.empty((size, len(languages)))
                for k, tree in enumerate(trees):
                    lower = rows[index[context[1:]]][:, k] if depth else uniform
                    row[:, k] = lengths(lower, tree[depth].get(context))
                rows.append(row)
        node = np.zeros((size,) * ORDER, np.int32)
        node[...] = index[()]
        for depth in range(1, ORDER + 1):
            for context in contexts[depth]:
                node[(..., *context)] = index[context]
        bits = np.stack(rows).astype(np.float32)
        return cls(languages, symbol, node.ravel(), bits.reshape(len(rows) * size, -1))

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text in each language."""
        size = int(self.symbol.max()) + 1
        pad = bytes([_START]) * ORDER
        codes = self.symbol[np.frombuffer(b"".join(pad + t for t in texts), np.uint8)].astype(np.int32)
        ends = np.cumsum([ORDER + len(t) for t in texts])
        out = np.zeros((len(texts), len(self.languages)))
        if not len(texts):
            return out
        context = np.zeros(len(codes) - ORDER, np.int32)
        for k in range(ORDER):
            context = context * size + codes[k : len(codes) - ORDER + k]
        at = self.node[context] * size + codes[ORDER:]
        low = 0
        for i, end in enumerate(ends.tolist()):
            if end - ORDER > low:
                # positions of the text itself, each in the context of the bytes before it
                out[i] = self.bits[at[low : end - ORDER]].sum(axis=0, dtype=np.float64)
            low = end
        return out


def _grams(batches):
    for batch in batches:
        found: dict[tuple[str, int], int] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            data = np.frombuffer(bytes([_START]) * ORDER + text.encode(), np.uint8).astype(np.int64)
            code = np.zeros(max(0, len(data) - ORDER), np.int64)
            for k in range(ORDER + 1):
                code = code * 256 + data[k : len(data) - ORDER + k]
            for c, n in zip(*(x.tolist() for x in np.unique(code, return_counts=True))):
                found[lang, c] = found.get((lang, c), 0) + n
        if found:
            yield pa.record_batch(
                [pa.array([k[0] for k in found]), pa.array([k[1] for k in found], pa.int64()), pa.array(list(found.values()), pa.int64())],
                names=["lang", "gram", "n"],
            )


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", fit_rows: int = FIT_ROWS) -> ContextTrees:
    """Trees from a bounded sample: of each language the rows with the smallest hash of
    ``key``, about ``fit_rows`` of them (all, where there are fewer). Null and empty texts
    and null languages are left out. Only the counts of the sample reach the driver."""
    rows = docs.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{key}`")).alias("mark"))
    rows = rows.where("lang is not null and text is not null and text != ''")
    many = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not many:
        return ContextTrees.fit({})
    part = F.lit(False)
    for name, n in many.items():
        share = min(1.0, fit_rows / n)
        limit = (1 << 63) - 1 if share == 1 else int(share * 2**64) - (1 << 63)
        part = part | ((F.col("lang") == name) & (F.col("mark") <= limit))
    counted = rows.where(part).select("lang", "text").mapInArrow(_grams, "lang string, gram long, n long")
    totals = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[bytes, int]] = {name: {} for name in many}
    for r in totals.collect():
        counts[r["lang"]][r["gram"].to_bytes(ORDER + 1, "big")] = r["n"]
    return ContextTrees.fit(counts)


def predict(docs: DataFrame, trees: ContextTrees, text: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score`` from the whole of every text.

    A text that is null or has no letter is ``und`` with score 0; equal code lengths go to
    the first language in order. ``score`` is the share of the winner among all languages,
    each weighted by two to the minus its code length per 32 bytes at most, so that long
    texts do not all end at 1. A narrow stage: the caller's columns but the text come back,
    an added column replaces one of its name, repeated rows give repeated results. The trees
    go to the tasks as one broadcast value whose size is bounded by the sample. Without any
    learned language every text is ``und``. An empty table gives an empty table.
    """
    select, fields, names = carried(docs, [text, "lang_pred", "score"])
    shape = StructType([*fields, StructField("made", StringType()), StructField("share", DoubleType())])
    target = to_arrow_schema(shape)
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def read(batches):
        model = shared.value
        for batch in batches:
            for part in byte_slices(batch, "read"):
                texts = part.column("read").to_pylist()
                some = [i for i, x in enumerate(texts) if model.languages and x and _LETTER.search(x)]
                made, share = [UNKNOWN] * len(texts), [0.0] * len(texts)
                raw = [texts[i].encode() for i in some]
                for i, data, bits in zip(some, raw, model.code_lengths(raw)):
                    best = int(np.argmin(bits))
                    gap = (bits - bits[best]) * min(1.0, 32 / len(data))
                    made[i] = model.languages[best]
                    share[i] = float(1 / np.exp2(-gap).sum())
                own = [as_fields(part.column(f.name), target.field(f.name).type) for f in fields]
                yield pa.record_batch([*own, pa.array(made, pa.string()), pa.array(share, pa.float64())], names=target.names)

    done = docs.select(*select, F.col(f"`{text}`").alias("read")).mapInArrow(read, shape)
    return given_back(done, docs, names, {"lang_pred": "made", "score": "share"})


def held_out(key: str = "doc_id") -> Column:
    """Rows that the counts never see: CRC-32 of the key as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.encode(F.col(f"`{key}`").cast("string"), "UTF-8")) % 4 == 2, F.lit(False))
