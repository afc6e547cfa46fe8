r"""Chat formatting with a grammar round trip.

A conversation is rendered as turns `### role: text</turn>` + newline. Every rendered turn is parsed again with the
deterministic parser below and compared with its source; while they differ, the next and stricter escape level is taken:
0 as it is, 1 escapes control strings, 2 escapes every control character. Level 2 always reads back identically, so the loop ends.
A turn ends with the first unescaped `</turn>`, so parsing a whole conversation gives the turns of its parts, one after the other.

Rows go to their conversation by a hash shuffle and arrive sorted by turn; each turn is rendered, parsed, digested and
dropped again, so that one enormous conversation needs no memory beyond its longest turn.

Null text or role: empty. A null conv_id is a conversation of its own. Equal turn numbers are ordered by role and text; repeated
rows count as often as they occur. No rows, no conversations. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import map_rows, read

OPEN, COLON, CLOSE = "### ", ": ", "</turn>\n"
_LEVELS = (None, re.compile(r"\\(?=[\\#<:])|#(?=##)|<(?=/turn>)"), re.compile(r"[\\#<:]"))
_UNESCAPE = re.compile(r"\\([\\#<:])")
_STOP = re.compile(r"\\[\\#<:]|(:)|(</turn>)")
PROBE = "\\### Assistant: </turn> ok"
LOSS_ROLES = ("assistant",)


def escape(text: str, level: int) -> str:
    return text if not level else _LEVELS[level].sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text) if "\\" in text else text


def render(role: str, text: str, level: int) -> str:
    return f"{OPEN}{escape(role, 2 if level else 0)}{COLON}{escape(text, level)}{CLOSE}"


def parse(formatted: str) -> list[tuple[str, str, int, int]] | None:
    """(role, text, start, end) of each turn, the span being that of its escaped text; None where the grammar doesn't fit."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            return None
        colon = None
        for m in _STOP.finditer(formatted, at + len(OPEN)):
            if m[1] and colon is None:
                colon = m.start()
                if not formatted.startswith(COLON, colon):
                    return None
            elif m[2] and colon is not None:
                start, end = colon + len(COLON), m.start()
                break
            elif m[2]:
                return None
        else:
            return None
        if not formatted.startswith(CLOSE, end) or end < start:
            return None
        turns.append((unescape(formatted[at + len(OPEN) : colon]), unescape(formatted[start:end]), start, end))
        at = end + len(CLOSE)
    return turns


def format_turn(role: str | None, text: str | None) -> tuple[str, tuple[str, str, int, int], int]:
    """Rendered turn, the turn as read back from it, and the escape level that was needed."""
    role, text = role or "", text or ""
    for level in range(len(_LEVELS)):
        out = render(role, text, level)
        back = parse(out)
        if back and len(back) == 1 and back[0][:2] == (role, text):
            return out, back[0], level
    raise AssertionError("the strictest level reads back by construction")


def _ordered(df: DataFrame) -> DataFrame:
    return df.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_turns(df: DataFrame) -> DataFrame:
    """Each turn rendered: (conv_id, turn, role, formatted, loss_start, loss_end, level); the span is null for roles without loss."""

    def work(batches: Iterator[list[list]]):
        for conv, turn, role, text in batches:
            done = [format_turn(r, t) for r, t in zip(role, text, strict=True)]
            loss = [r in LOSS_ROLES for r in role]
            yield [conv, turn, role, [d[0] for d in done], [d[1][2] if x else None for d, x in zip(done, loss, strict=True)], [d[1][3] if x else None for d, x in zip(done, loss, strict=True)], [d[2] for d in done]]

    return map_rows(_ordered(df), ["conv_id", "turn", "role", "text"], work, "conv_id long, turn long, role string, formatted string, loss_start int, loss_end int, level int")


class _Digest:
    def __init__(self) -> None:
        self.turns, self.loss, self.n, self.loss_chars, self.chars, self.escaped = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0

    def add(self, role: str | None, text: str | None) -> None:
        out, (role, back, start, end), level = format_turn(role, text)
        self.n, self.chars, self.escaped = self.n + 1, self.chars + len(out), self.escaped + (level > 0)
        self.turns.update(f"{role}\n{back}\n".encode("utf-8", "surrogatepass"))
        if role in LOSS_ROLES:
            masked = unescape(out[start:end])
            self.loss_chars += len(masked)
            self.loss.update(masked.encode("utf-8", "surrogatepass"))

    def row(self, conv) -> tuple:
        return conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.escaped


def conversation_digests(df: DataFrame) -> DataFrame:
    """One row per conversation, read back from its rendered turns."""

    def work(batches: Iterator[list[list]]):
        nothing = object()
        conv, digest = nothing, _Digest()
        for ids, _, roles, texts in batches:
            done = []
            for c, role, text in zip(ids, roles, texts, strict=True):
                if c != conv:
                    if conv is not nothing:
                        done.append(digest.row(conv))
                    conv, digest = c, _Digest()
                digest.add(role, text)
            if done:
                yield [list(x) for x in zip(*done, strict=True)]
        if conv is not nothing:
            yield [[x] for x in digest.row(conv)]

    return map_rows(_ordered(df), ["conv_id", "turn", "role", "text"], work, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, escaped_turns long")


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -7 whose two turns hold the template's own control strings."""
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return conversation_digests(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe))
