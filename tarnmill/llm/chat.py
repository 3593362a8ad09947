"""Conversations as training text: a compiled template, reversible escapes, and a loss mask."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnmill.llm.templates import Chunks, compile_template

#: Strings that steer a reader of the output. Each holds "[" or "<" at its start alone, so none can arise across a seam.
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "[/TURN]"]
TEMPLATE = (
    "{% for message in messages %}"
    "{% if message.role == 'user' %}[INST]{{ message.text | escape }}[/INST]"
    "{% elif message.role == 'assistant' %}<s>{% generation %}{{ message.text | escape }}{% endgeneration %}</s>"
    "{% else %}[ROLE]{{ message.role | escape }}[/ROLE]{{ message.text | escape }}[/TURN]{% endif %}"
    "{% endfor %}"
)
_FORBIDDEN = re.compile("|".join(map(re.escape, [*CONTROLS, "\\"])))
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))


def escape(text: str) -> str:
    """The text without control strings: a backslash goes behind a control string's first letter and before each backslash."""
    return _FORBIDDEN.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


class TurnReader:
    """Reads turns back from the output's chunks; holds one turn at most."""

    ENDS = {"[/INST]": "user", "</s>": "assistant", "[/TURN]": None}

    def __init__(self) -> None:
        self.held: list[str] = []
        self.tail = ""

    def feed(self, chunk: str) -> Iterator[tuple[str, str]]:
        self.held.append(chunk)
        seen = self.tail + chunk  # a control string may lie across chunks
        self.tail = seen[-max(map(len, CONTROLS)) :]
        if not _CONTROL.search(seen):
            return
        text, done, begun, role = "".join(self.held), 0, 0, ""
        for m in _CONTROL.finditer(text):
            if m[0] == "[/ROLE]":
                role, begun = unescape(text[begun : m.start()]), m.end()
            elif m[0] in self.ENDS:
                yield self.ENDS[m[0]] or role, unescape(text[begun : m.start()])
                done = m.end()
            else:
                begun = m.end()
        self.held = [text[done:]] if done < len(text) else []


def digest_sink(chunks: Chunks) -> tuple:
    """n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all from the formatted output."""
    reader, turns, loss = TurnReader(), hashlib.sha256(), hashlib.sha256()
    n = loss_chars = chars = 0
    masked: list[str] = []
    for text, trained in chunks:
        chars += len(text)
        if trained:
            masked.append(text)
        elif masked:
            own, masked = unescape("".join(masked)), []
            loss.update(own.encode())
            loss_chars += len(own)
        for role, turn in reader.feed(text):
            turns.update(f"{role}\n{turn}\n".encode())
            n += 1
    own = unescape("".join(masked))
    loss.update(own.encode())
    return n, turns.hexdigest(), loss_chars + len(own), loss.hexdigest(), chars


def text_sink(chunks: Chunks) -> tuple:
    """The formatted text, and where it is trained on: [begin, end) in code points."""
    parts, spans, at = [], [], 0
    for text, trained in chunks:
        if trained and text:
            if spans and spans[-1][1] == at:
                spans[-1][1] = at + len(text)
            else:
                spans.append([at, at + len(text)])
        parts.append(text)
        at += len(text)
    return "".join(parts), [{"begin": a, "end": b} for a, b in spans]


_SPAN = T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))
SINKS: dict[str, tuple[Callable[[Chunks], tuple], list[T.StructField]]] = {
    "text": (text_sink, [T.StructField("formatted", T.StringType()), T.StructField("trained", _SPAN)]),
    "digest": (digest_sink, [T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())]),
}


def format_conversations(df: DataFrame, template: str = TEMPLATE, sink: str = "text", id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: id and what the sink makes of the rendered output ("text" or "digest").

    Turns go in the order of turn, role, text (nulls first), so ties have one order; repeated rows are turns of
    their own. Null text and null role are empty; rows with a null id make one conversation. Empty texts are
    turns with nothing in them. An empty table gives no rows; other columns are ignored.

    The rows are dealt by conversation and sorted there. A conversation is rendered and read as a stream of
    turns, so one of any length needs the memory of one turn (with the "digest" sink); its digests are chains
    over its turns, which is why one task reads it.
    """
    take, fields = SINKS[sink]
    rows = df.select(F.col(id_col).alias("_id"), F.col(turn_col).alias("_turn"), F.coalesce(role_col, F.lit("")).alias("_role"), F.coalesce(text_col, F.lit("")).alias("_text"))
    rows = rows.repartition("_id").sortWithinPartitions("_id", "_turn", "_role", "_text").select("_id", "_role", "_text")
    schema = T.StructType([T.StructField(id_col, rows.schema["_id"].dataType), *fields])

    def turns(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        render, arrow, held = compile_template(template, {"escape": escape}), to_arrow_schema(schema), []
        for key, own in groupby(turns(batches), itemgetter(0)):
            held.append((key, *take(render({"messages": ({"role": r, "text": t} for _, r, t in own)}))))
            if len(held) == 200:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)

    return rows.mapInArrow(run, schema)
