"""Chat formatting: a finite-state machine over roles, driven by a declarative template, turns
conversations into text segments with a loss flag each; ``read_back`` parses the segments' text
again.

Control strings inside texts are escaped reversibly: each ``<`` followed by any number of
backslashes and ``|`` gets one backslash more after the ``<``, so no text can hold a control string, and
unescaping takes one away. Role names are escaped in the same way, and their line ends as ``\\n``.

Rows are dealt by conversation and streamed in order of turn (ties by role, then text; nulls
first), so memory holds one turn, however long a conversation is. One conversation's digest is a
sequential hash, so its rows pass through one task. Defined results: null text and null role:
empty; null turn: first; null conversation id: one conversation of its own; a conversation that
the machine refuses is still formatted, with valid = false and the first refused turn's number.
Empty table: no rows.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Segments of a turn, in order: (kind, text, loss by role). ``{role}`` and ``{text}`` stand for
    the escaped values."""

    segments: tuple = (("open", "<|im_start|>{role}\n", ()), ("text", "{text}", ("assistant",)), ("close", "<|im_end|>\n", ()))
    transitions: dict = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple = ("assistant",)
    open_mark: str = "<|im_start|>"
    close_mark: str = "<|im_end|>\n"


CHATML = Template()


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


SEGMENTS = "conv_id long, turn_no long, kind string, text string, loss boolean, valid boolean, last boolean"


def segments(conversations: DataFrame, template: Template = CHATML, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conv_id, turn_no, kind, text, loss, valid, last) in order within each conversation:
    turn_no counts from 0; valid tells whether the machine accepts the conversation up to and
    including the turn (with the last turn: as a whole); last marks the last turn."""
    rows = conversations.select(F.col(conv_col).cast("long").alias("c"), F.col(turn_col).cast("long").alias("t"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("r"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("x"))

    def work(batches):
        held, conv, state, number, valid = None, object(), "", 0, True

        def emit(out, row, is_last):
            c, n, role, text, ok = row
            ok = ok and (not is_last or role in template.final)
            values = {"role": escape_role(role), "text": escape(text)}
            for kind, form, loss in template.segments:
                out.append((c, n, kind, re.sub(r"\{(role|text)\}", lambda m: values[m[1]], form), role in loss, ok, is_last))

        def batch(out):
            fields = zip(*out)
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_())
            return pa.record_batch([pa.array(v, k) for v, k in zip(fields, types)], ["conv_id", "turn_no", "kind", "text", "loss", "valid", "last"])

        for b in batches:
            out: list = []
            for c, role, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if c != conv or held is None:
                    if held is not None:
                        emit(out, held, True)
                    conv, state, number, valid = c, "", 0, True
                else:
                    emit(out, held, False)
                valid = valid and role in template.transitions.get(state, ())
                held, state, number = (c, number, role, text, valid), role, number + 1
                if len(out) > 3000:
                    yield batch(out)
                    out = []
            if out:
                yield batch(out)
        if held is not None:
            out = []
            emit(out, held, True)
            yield batch(out)

    return rows.repartition("c").sortWithinPartitions("c", "t", "r", "x").mapInArrow(work, SEGMENTS)


def read_back(formatted: DataFrame, template: Template = CHATML) -> DataFrame:
    """Parse each conversation's formatted text, the segments' texts joined in order: conv_id,
    n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid, error_turn (of the
    first refused turn, else null). Turns come from the text alone, the loss from the flags."""

    def work(batches):
        conv, now = object(), None

        def finish(s):
            if s["buffer"]:
                raise ValueError(f"conversation {s['conv']}: text after the last turn")
            return (s["conv"], s["turns"], s["all"].hexdigest(), s["chars"], s["loss"].hexdigest(), s["size"], s["error"] is None, s["error"])

        def batch(out):
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int64())
            return pa.record_batch([pa.array(v, k) for v, k in zip(zip(*out), types)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid", "error_turn"])

        for b in batches:
            out: list = []
            for c, n, text, loss, ok, last in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4, 5, 6))):
                if now is None or c != conv or now["done"]:
                    if now is not None:
                        out.append(finish(now))
                    conv, now = c, {"conv": c, "turns": 0, "all": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "size": 0, "buffer": "", "error": None, "done": False, "last": False}
                if loss:
                    plain = unescape(text)
                    now["chars"] += len(plain)
                    now["loss"].update(plain.encode())
                if not ok and now["error"] is None:
                    now["error"] = n
                now["size"] += len(text)
                now["buffer"] += text
                while (end := now["buffer"].find(template.close_mark)) >= 0:
                    turn, now["buffer"] = now["buffer"][:end], now["buffer"][end + len(template.close_mark) :]
                    if not turn.startswith(template.open_mark):
                        raise ValueError(f"conversation {c}: a turn without its mark")
                    role, _, body = turn[len(template.open_mark) :].partition("\n")
                    now["turns"] += 1
                    now["all"].update(f"{unescape_role(role)}\n{unescape(body)}\n".encode())
                    now["done"] = last
            if out:
                yield batch(out)
        if now is not None:
            yield batch([finish(now)])

    return formatted.mapInArrow(work, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, error_turn long")
