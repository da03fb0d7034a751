"""Chat formatting with typed content parts.

A turn is a list of parts: text, image, audio and document. A visitor flattens them into
one string with ordered placeholders, notes the attachment each placeholder stands for and
how many tokens it expands to. A template puts the turns between control strings; the same
strings inside texts are escaped, so the output can be read back exactly.

Every turn is formatted by itself, in a narrow stage. What belongs to a conversation as a
whole (offsets, digests) is made in one pass over its sorted turns with constant memory, so
a conversation of any length is streamed, never gathered.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

# control strings of the template; a turn is OPEN role MIDDLE text CLOSE
OPEN, MIDDLE, CLOSE = "<|turn|>", "<|text|>", "<|end|>"
PLACE = "<|{kind}:{number}|>"
# strings of other templates that must not appear unescaped in a training text
FOREIGN = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|im_start|>", "<|im_end|>")

_TURN = re.compile(re.escape(OPEN) + "(.*?)" + re.escape(MIDDLE) + "(.*)" + re.escape(CLOSE), re.S)


def escape(text: str) -> str:
    """Puts a backslash inside every control string, after its first character, and one
    more for each that stands there already; ``unescape`` takes exactly one away."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


def _patterns() -> tuple[str, str]:
    """Control strings with any number of backslashes after the first character, and the
    same with at least one."""
    tails = [r"\|[^<>|\[\]\n]{0,40}\|>", *(re.escape(x[1:]) for x in FOREIGN)]
    heads = ["<", *(re.escape(x[0]) for x in FOREIGN)]
    any_ = "|".join(f"{h}\\\\*{t}" for h, t in dict.fromkeys(zip(heads, tails)))
    some = "|".join(f"{h}\\\\+{t}" for h, t in dict.fromkeys(zip(heads, tails)))
    return any_, some


CONTROL, _SOME = _patterns()
_CONTROL, _ESCAPED = re.compile(CONTROL), re.compile(_SOME)


@dataclass
class Flat:
    """What a visit of one turn's parts gives."""

    text: list[str] = field(default_factory=list)
    attachments: list[tuple[int, str, str, int]] = field(default_factory=list)


class Visitor:
    """Visits parts in order; a method per type. ``tokens`` says how many tokens an
    attachment expands to: per image, per second of audio, per page of a document."""

    def __init__(self, tokens: dict[str, int] | None = None):
        self.tokens = {"image": 256, "audio": 25, "document": 512, **(tokens or {})}

    def visit(self, parts: list[dict]) -> Flat:
        out = Flat()
        for part in parts or []:
            kind = (part or {}).get("type")
            method = getattr(self, f"visit_{kind}", None) if kind else None
            if method is None:
                raise ValueError(f"unknown content part {kind!r}")
            method(part, out)
        return out

    def visit_text(self, part: dict, out: Flat) -> None:
        out.text.append(escape(part.get("text") or ""))

    def _attach(self, kind: str, part: dict, units: int, out: Flat) -> None:
        number = len(out.attachments)
        out.text.append(PLACE.format(kind=kind, number=number))
        out.attachments.append((number, kind, part.get("ref") or "", self.tokens[kind] * units))

    def visit_image(self, part: dict, out: Flat) -> None:
        self._attach("image", part, 1, out)

    def visit_audio(self, part: dict, out: Flat) -> None:
        self._attach("audio", part, max(1, int(part.get("size") or 1)), out)

    def visit_document(self, part: dict, out: Flat) -> None:
        self._attach("document", part, max(1, int(part.get("size") or 1)), out)


ATTACHMENTS = ArrayType(
    StructType(
        [
            StructField("number", IntegerType()),
            StructField("kind", StringType()),
            StructField("ref", StringType()),
            StructField("tokens", LongType()),
        ]
    )
)


def text_part(text: Column) -> Column:
    """The parts of a turn that is plain text; null counts as empty. Parts are structs of
    ``type`` (text, image, audio, document), ``text``, ``ref`` and ``size`` (seconds, pages)."""
    whole = F.struct(
        F.lit("text").alias("type"),
        F.coalesce(text, F.lit("")).alias("text"),
        F.lit(None).cast("string").alias("ref"),
        F.lit(None).cast("long").alias("size"),
    )
    return F.array(whole)


def format_turns(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    parts: str = "parts",
    train_on: tuple[str, ...] = ("assistant",),
    tokens: dict[str, int] | None = None,
) -> DataFrame:
    """Formats each turn: ``formatted`` (its piece of the conversation's string),
    ``loss_start`` and ``loss_end`` (code points of the text under the loss mask inside
    that piece, both 0 outside the trained roles), ``attachments`` and ``expanded_tokens``.

    A conversation is the pieces of its turns in order of ``turn``; see ``in_order`` for
    ties and nulls. A null role is the empty role; a null list of parts and null texts are
    empty; an unknown part type is an error. Narrow, one row per input row, repeated rows
    included; other columns are left out. An empty table gives an empty table.
    """
    key = turns.schema[conversation].dataType
    place = turns.schema[turn].dataType
    visitor = Visitor(tokens)

    def make(batches):
        for batch in batches:
            pieces, starts, ends, attached, expanded = [], [], [], [], []
            for name, content in zip(batch.column("role").to_pylist(), batch.column("parts").to_pylist()):
                flat = visitor.visit(content)
                head = OPEN + escape(name or "") + MIDDLE
                body = "".join(flat.text)
                pieces.append(head + body + CLOSE)
                trained = (name or "") in train_on
                starts.append(len(head) if trained else 0)
                ends.append(len(head) + len(body) if trained else 0)
                attached.append([dict(zip(("number", "kind", "ref", "tokens"), a)) for a in flat.attachments])
                expanded.append(sum(a[3] for a in flat.attachments))
            yield pa.record_batch(
                [
                    batch.column("conversation"),
                    batch.column("turn"),
                    pa.array(pieces, pa.string()),
                    pa.array(starts, pa.int64()),
                    pa.array(ends, pa.int64()),
                    pa.array(attached, target.field("attachments").type),
                    pa.array(expanded, pa.int64()),
                ],
                names=target.names,
            )

    shape = StructType(
        [
            StructField("conversation", key),
            StructField("turn", place),
            StructField("formatted", StringType()),
            StructField("loss_start", LongType()),
            StructField("loss_end", LongType()),
            StructField("attachments", ATTACHMENTS),
            StructField("expanded_tokens", LongType()),
        ]
    )
    target = to_arrow_schema(shape)
    chosen = turns.select(
        F.col(conversation).alias("conversation"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(parts).alias("parts")
    )
    return chosen.mapInArrow(make, shape)


def in_order(pieces: DataFrame) -> DataFrame:
    """Lays the turns of a conversation out next to each other, in order: null turns last,
    ties by the formatted piece. A null conversation is one conversation. Turns are sorted
    by Spark, which spills; nothing is gathered."""
    return pieces.repartition("conversation").sortWithinPartitions(
        F.col("conversation").asc_nulls_first(), F.col("turn").asc_nulls_last(), "formatted", "loss_end"
    )


def read_turn(piece: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    found = _TURN.fullmatch(piece)
    if not found:
        raise ValueError("not a formatted turn")
    return unescape(found[1]), unescape(found[2])


def read_back(pieces: DataFrame) -> DataFrame:
    """Digests of each conversation, read back from the formatted pieces: ``n_turns``,
    ``turns_sha256`` over role, newline, text, newline of every turn, ``loss_chars`` and
    ``loss_sha256`` of the unescaped text under the loss mask, ``formatted_chars``."""
    key = pieces.schema["conversation"].dataType
    shape = StructType(
        [
            StructField("conversation", key),
            StructField("n_turns", LongType()),
            StructField("turns_sha256", StringType()),
            StructField("loss_chars", LongType()),
            StructField("loss_sha256", StringType()),
            StructField("formatted_chars", LongType()),
        ]
    )
    target = to_arrow_schema(shape)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        current, state = none, None

        def row():
            return [current, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]]

        for batch in batches:
            done = []
            columns = [batch.column(c).to_pylist() for c in ("conversation", "formatted", "loss_start", "loss_end")]
            for conversation, piece, start, end in zip(*columns):
                if current is none or conversation != current:
                    if current is not none:
                        done.append(row())
                    current, state = conversation, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = read_turn(piece)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                learned = unescape(piece[start:end])
                state[2] += len(learned)
                state[3].update(learned.encode())
                state[4] += len(piece)
            if done:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done), target.types)], names=target.names)
        if current is not none:
            yield pa.record_batch([pa.array([c], t) for c, t in zip(row(), target.types)], names=target.names)

    return in_order(pieces).select("conversation", "formatted", "loss_start", "loss_end").mapInArrow(scan, shape)
