"""Chat formatting from event logs.

Events of a conversation are sorted by sequence and folded: a message starts a turn, deltas
extend it, an edit replaces it, a regeneration empties it and drops the turns after it. The
final turns are rendered by a template whose control strings are escaped inside texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Control strings of common chat templates; fixed values.
CONTROL = (START, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|system|>", "<|user|>", "<|assistant|>", "<|endoftext|>")
MARK = "\\"
_ESCAPED = re.compile("|".join(re.escape(x) for x in (MARK, *CONTROL)))
_ESCAPED_ROLE = re.compile("|".join(re.escape(x) for x in (MARK, "\n", *CONTROL)))
_MARKED = re.compile(r"\\(.)", re.S)
TURN = re.compile(re.escape(START) + r"((?:[^\\\n]|\\.)*+)\n((?:[^\\<]|\\.|<(?!\|im_end\|>))*+)" + re.escape(END) + "\n", re.S)


def escape(text: str) -> str:
    """Put a mark before every mark and after the first character of every control string."""
    return _ESCAPED.sub(lambda m: MARK + MARK if m[0] == MARK else m[0][0] + MARK + m[0][1:], text)


def escape_role(role: str) -> str:
    return _ESCAPED_ROLE.sub(lambda m: MARK + m[0] if m[0] in (MARK, "\n") else m[0][0] + MARK + m[0][1:], role)


def unescape(text: str) -> str:
    return _MARKED.sub(r"\1", text)


@dataclass
class Turn:
    message: str | None
    role: str
    text: list[str]


@dataclass
class Conversation:
    """The fold of one conversation's events, in order of sequence."""

    turns: list[Turn] = field(default_factory=list)
    at: dict[str, int] = field(default_factory=dict)

    def event(self, op: str | None, message: str | None, role: str | None, text: str | None) -> None:
        """An unknown op, or one on a message that is not there, starts a message."""
        i = self.at.get(message) if message is not None else None
        if op == "delta" and i is not None:
            self.turns[i].text.append(text or "")
        elif op == "edit" and i is not None:
            self.turns[i].text = [text or ""]
        elif op == "regenerate" and i is not None:
            for t in self.turns[i + 1 :]:
                self.at.pop(t.message, None)
            del self.turns[i + 1 :]
            self.turns[i].text = [text or ""]
        else:
            self.turns.append(Turn(message, role or "", [text or ""]))
            if message is not None:
                self.at[message] = len(self.turns) - 1

    def rendered(self) -> tuple[str, list[dict[str, int]]]:
        """The formatted conversation and the spans under the loss mask, in code points."""
        parts, loss, n = [], [], 0
        for t in self.turns:
            head, body = f"{START}{escape_role(t.role)}\n", escape("".join(t.text))
            if t.role == "assistant":
                loss.append({"start": n + len(head), "stop": n + len(head) + len(body)})
            parts += [head, body, f"{END}\n"]
            n += len(head) + len(body) + len(END) + 1
        return "".join(parts), loss


FORMATTED = "conv_id long, formatted string, loss array<struct<start:int,stop:int>>"


def _folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted events to conversations; one that goes on in the next batch is carried over."""
    conv, key = None, None
    for pdf in batches:
        done = []
        for c, op, message, role, text in zip(pdf["conv_id"], pdf["op"], pdf["message"], pdf["role"], pdf["text"], strict=True):
            c = None if pd.isna(c) else int(c)
            if conv is None or c != key:
                if conv is not None:
                    done.append((key, *conv.rendered()))
                conv, key = Conversation(), c
            conv.event(op, message, role, text)
        yield _frame(done)
    if conv is not None:
        yield _frame([(key, *conv.rendered())])


def _frame(done: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame({"conv_id": pd.array([x[0] for x in done], "Int64"), "formatted": [x[1] for x in done], "loss": [x[2] for x in done]})


def format_chats(events: DataFrame) -> DataFrame:
    """Events (conv_id, seq, op, message, role, text) to (conv_id, formatted, loss).

    op: message (or null), delta, edit or regenerate; message names what the event is about.
    Ties of seq are taken in order of op, message, role and text. A conversation is one row
    of the result, so it must fit a task; its events stream through one sorted partition.

    Null text: empty. Null role: an empty role. Null conv_id: a conversation of its own.
    Repeated message events are turns of their own. Empty table: empty result. Other columns
    are not read, whatever they are called.
    """
    kept = events.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("seq").cast("long").alias("seq"), "op", F.col("message").cast("string").alias("message"), "role", "text"
    )
    dealt = kept.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "op", "message", "role", "text")
    return dealt.mapInPandas(_folded, FORMATTED)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    return [(unescape(m[1]), unescape(m[2])) for m in TURN.finditer(formatted)]


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for c, formatted, loss in zip(pdf["conv_id"], pdf["formatted"], pdf["loss"], strict=True):
            turns = read_back(formatted)
            masked = "".join(unescape(formatted[s["start"] : s["stop"]]) for s in loss)
            whole = "".join(f"{role}\n{text}\n" for role, text in turns)
            sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
            out.append((None if pd.isna(c) else int(c), len(turns), sha(whole), len(masked), sha(masked), len(formatted)))
        names = [x.split()[0] for x in DIGESTS.split(", ")]
        frame = pd.DataFrame(out, columns=names)
        yield frame.astype({"conv_id": "Int64"})


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from formatted conversations, one row each; see DIGESTS."""
    return formatted.mapInPandas(_digests, DIGESTS)
