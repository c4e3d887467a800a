"""Chat formatting: conversations through a compiled template, and back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .template import BEGIN, END, TURN, Escaper, Template

#: Control strings of the default template.
CONTROLS = ["<s>", "</s>", "[ROLE]", "[/ROLE]", "[INST]", "[/INST]"]
TEMPLATE = (
    "{{ '<s>' }}{% for m in messages %}[ROLE]{{ m.role | escape }}[/ROLE]"
    "{% if m.role == 'user' %}[INST]{{ m.text | escape }}[/INST]"
    "{% elif m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}</s>{% endfor %}"
)
#: A piece is closed at the first turn's end after so many code points.
PIECE = 1 << 16

PIECES = "conv_id long, piece long, text string, spans array<struct<start:long,stop:long>>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_TURN = re.compile(r"\[ROLE\](.*?)\[/ROLE\](?:\[INST\](.*?)\[/INST\]|(.*?))</s>", re.S)


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 256) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) == size:
            yield batch()
            held = []
    if held:
        yield batch()


def format_chats(conversations: DataFrame, template: str = TEMPLATE, controls: list[str] = CONTROLS) -> DataFrame:
    """(conv_id, piece, text, spans): each conversation's formatted text in pieces, and in each the spans that the model generates.

    The template gets `messages`, a sequence of {role, text} in the order of turn, then role and text (so equal turns have a fixed
    order; a null turn comes first). Null role or text: empty. Rows of a null conv_id are one conversation. A conversation's text
    is its pieces joined in order; they come in order inside a partition and are cut between turns only, so one of any length
    streams through a task. Repeated rows are repeated turns; an empty table gives an empty table; other columns are ignored.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("text", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])
    Template(template, controls)  # fails here and not in a task

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = Template(template, controls)

        def pieces() -> Iterator[tuple]:
            for conv, turns in groupby(_in_order(batches), key=lambda r: r[0]):
                number, parts, spans, at, opened, depth = 0, [], [], 0, 0, 0
                for x in compiled.run({"messages": ({"role": r[1], "text": r[2]} for r in turns)}):
                    if x is BEGIN:
                        opened, depth = at if not depth else opened, depth + 1
                    elif x is END:
                        depth -= 1
                        if not depth:
                            spans.append({"start": opened, "stop": at})
                    elif x is TURN:
                        if at >= PIECE and not depth:
                            yield conv, number, "".join(parts), spans
                            number, parts, spans, at = number + 1, [], [], 0
                    else:
                        parts.append(x)
                        at += len(x)
                yield conv, number, "".join(parts), spans

        yield from _batches(pieces(), schema, 16)

    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    source = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"))
    ordered = source.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return ordered.mapInArrow(rows, PIECES)


def read_back(text: str, escaper: Escaper) -> list[tuple[str, str]]:
    """(role, text) of every turn in a piece made by the default template."""
    turns, at = [], 3 if text.startswith("<s>") else 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((escaper.show(m[1]), escaper.show(m[2] if m[2] is not None else m[3])))
        at = m.end()
    return turns


def digests(formatted: DataFrame) -> DataFrame:
    """One row for each conversation of format_chats's result (default template), all of it read back from the formatted text.

    turns_sha256: of role, newline, text, newline of each turn; loss_sha256: of all unescaped text in the spans. formatted must
    come straight from format_chats, whose partitions hold whole conversations in order.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        escaper = Escaper(CONTROLS)

        def conversations() -> Iterator[tuple]:
            for conv, pieces in groupby(_in_order(batches), key=lambda r: r[0]):
                turns, loss, n, lost, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                for _, _, text, spans in pieces:
                    chars += len(text)
                    for role, said in read_back(text, escaper):
                        turns.update(f"{role}\n{said}\n".encode())
                        n += 1
                    for span in spans:
                        said = escaper.show(text[span["start"] : span["stop"]])
                        loss.update(said.encode())
                        lost += len(said)
                yield conv, n, turns.hexdigest(), lost, loss.hexdigest(), chars

        yield from _batches(conversations(), schema)

    return formatted.mapInArrow(rows, DIGESTS)
