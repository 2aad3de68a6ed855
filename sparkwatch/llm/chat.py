"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context and that
reply as the only trainable text. Turns left over at the end of a conversation (a user turn
without a reply, say) become one last example with nothing trainable, so the output holds
every turn and reads back into the conversation.

Template: each turn is ``<|turn|>ROLE<|text|>TEXT<|end|>``. A backslash, ``<`` or ``[`` inside
a role or text is written ``\\\\b``, ``\\\\l`` or ``\\\\s``, so that no text can hold a control
string of this template, nor one of the usual templates (``<s>``, ``</s>``, ``[INST]``,
``<|im_start|>``). Reading back undoes it exactly. The loss span of an example covers the
escaped reply text, without its marks.

Conversations are shuffled by id and sorted inside the partitions; a task walks through the
sorted turns and keeps one conversation's formatted prefix, which every example needs anyway.

Defined cases: null text: empty; null role: empty, never trainable; a null conv_id is one
conversation of its own; turns are sorted by turn (null first), then role, then text, so
ties and repeated rows have one order; a conversation's empty reply is an example with an
empty loss span; an empty table gives no example; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, require_columns

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
TRAINED_ROLE = "assistant"
_ESCAPES = {"\\": "\\b", "<": "\\l", "[": "\\s"}
_BACK = {v: k for k, v in _ESCAPES.items()}
_ESCAPE, _UNESCAPE = re.compile(r"[\\<\[]"), re.compile(r"\\[bls]")
EXAMPLES = "conv_id long, example int, text string, loss_start long, loss_end long"
DIGESTS = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
           "formatted_chars long, n_examples long")


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: _ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: _BACK[m[0]], text)


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(f"{TURN}{escape(r)}{TEXT}{escape(t)}{END}" for r, t in turns)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted text; the inverse of ``render``."""
    turns = []
    for part in formatted.split(TURN)[1:]:
        role, _, text = part.partition(TEXT)
        turns.append((unescape(role), unescape(text.removesuffix(END))))
    return turns


def _batch(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=names)


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "example", "text", "loss_start", "loss_end"]
    types = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
    conv, prefix, k, waiting = (), "", 0, False
    out: list[tuple] = []
    size = 0
    for batch in batches:
        for cid, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
            if (cid,) != conv:
                if waiting:
                    out.append((conv[0], k, prefix, len(prefix), len(prefix)))
                conv, prefix, k, waiting = (cid,), "", 0, False
            head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
            start = len(prefix) + len(head)
            prefix += head + body + END
            waiting = role != TRAINED_ROLE
            if not waiting:
                out.append((cid, k, prefix, start, start + len(body)))
                k += 1
                size += len(prefix)
            if size > 4_000_000:
                yield _batch(out, names, types)
                out, size = [], 0
    if waiting:
        out.append((conv[0], k, prefix, len(prefix), len(prefix)))
    if out:
        yield _batch(out, names, types)


def expand(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, text, loss_start, loss_end): the examples, their text and
    the span of code points that is trained, from rows (conv_id, turn, role, text)."""
    prepare(conversations.sparkSession)
    require_columns(conversations, "conv_id", "turn", "role", "text")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn",
                                F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.drop("turn").mapInArrow(_expand, EXAMPLES)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in DIGESTS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    done: list[tuple] = []
    conv, longest, loss, chars, formatted, examples = (), "", hashlib.sha256(), 0, 0, 0

    def close():
        if conv:
            digest, turns = hashlib.sha256(), parse(longest)
            for role, text in turns:
                digest.update(f"{role}\n{text}\n".encode())
            done.append((conv[0], len(turns), digest.hexdigest(), chars, loss.hexdigest(), formatted, examples))

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("conv_id", "text", "loss_start", "loss_end"))
        for cid, text, start, end in zip(*columns):
            if (cid,) != conv:
                close()
                conv, loss, chars, formatted, examples = (cid,), hashlib.sha256(), 0, 0, 0
            trained = unescape(text[start:end])
            loss.update(trained.encode())
            chars, formatted, examples, longest = chars + len(trained), formatted + len(text), examples + 1, text
        if len(done) > 10_000:
            yield _batch(done, names, types)
            done = []
    close()
    if done:
        yield _batch(done, names, types)


def read_back(examples: DataFrame, grouped: bool = False) -> DataFrame:
    """What the formatted examples of each conversation hold: the turns are parsed from the
    longest example, the trained text is the concatenation of the loss spans, unescaped;
    ``formatted_chars`` counts all examples. ``grouped``: each conversation's examples follow
    each other in one partition already, as ``expand`` leaves them, and aren't shuffled again."""
    dealt = examples if grouped else examples.repartition("conv_id").sortWithinPartitions("conv_id", "example")
    return dealt.select("conv_id", "text", "loss_start", "loss_end").mapInArrow(_read_back, DIGESTS)
