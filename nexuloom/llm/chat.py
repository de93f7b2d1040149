"""Chat formatting by event-sourced reconstruction.

A log of events is dealt by conversation, sorted by sequence and folded: ``message`` opens a turn, ``delta`` appends to
it, ``edit`` replaces its text, ``regenerate`` empties it for a new stream of deltas, ``delete`` takes it out. The
final messages are rendered as ``<|im_start|>role\\ntext<|im_end|>\\n``; control strings inside roles and texts are
escaped reversibly (``<|`` gets a backslash between its two characters, one more if there are some already).

A turn is folded from the sorted stream and let go, so memory holds one turn (and its edits), never a conversation;
the rendered conversation is a run of numbered pieces with the loss spans of each.

Defined cases: null text is empty; null role is the empty role; null turns come last; several messages of one turn are
several turns, in the order of role and text; an event of an unknown kind or without an open turn opens one; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
PIECES = "conv_id string, piece long, formatted string, loss_start long, loss_end long"
DIGEST = "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role).replace("%", "%25").replace("\n", "%0A")


def unescape_role(role: str) -> str:
    return unescape(role.replace("%0A", "\n").replace("%25", "%"))


def render(role: str, text: str) -> tuple[str, int, int]:
    """The rendered turn and the span of its code points that the loss covers (empty unless the assistant speaks)."""
    head, body = f"{START}{escape_role(role)}\n", escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + (len(body) if role == "assistant" else 0)


def parse(piece: str) -> tuple[str, str]:
    """Role and text of a rendered turn."""
    head, _, body = piece[len(START) : -len(END) - 1].partition("\n")
    return unescape_role(head), unescape(body)


def fold(events: Iterator[tuple]) -> Iterator[tuple]:
    """Sorted ``(conv, turn, kind, role, text)`` -> final ``(conv, role, text)``; one open turn at a time."""
    at = role = None
    parts: list[str] = []
    for conv, turn, kind, who, text in events:
        if at != (conv, turn) or kind not in ("delta", "edit", "regenerate", "delete"):
            if at is not None and parts is not None:
                yield at[0], role, "".join(parts)
            at, role, parts = (conv, turn), who, [text]
        elif kind == "delete":
            parts = None
        elif kind == "delta" and parts is not None:
            parts.append(text)
        else:  # edit and regenerate
            parts = [text]
    if at is not None and parts is not None:
        yield at[0], role, "".join(parts)


def _stream(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(b["conv_id"], b["turn_key"], b["kind"], b["role"], b["text"], strict=True)


def _rendered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows, size, last, n = [], 0, object(), 0
    for conv, role, text in fold(_stream(batches)):
        n, last = (n + 1 if conv == last else 0), conv
        whole, a, b = render(role, text)
        rows.append((conv, n, whole, a, b))
        size += len(whole)
        if size > 2_000_000:
            yield _frame(rows)
            rows, size = [], 0
    if rows:
        yield _frame(rows)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["conv_id", "piece", "formatted", "loss_start", "loss_end"])


def format_log(events: DataFrame) -> DataFrame:
    """Events ``conv_id, turn, seq, kind, role, text`` -> pieces ``conv_id, piece, formatted, loss_start, loss_end``."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    e = events.select(F.col("conv_id").cast("long").cast("string").alias("conv_id"), F.coalesce(F.col("turn").cast("string"), F.lit("last")).alias("turn_key"), F.col("turn").alias("turn"), F.col("seq").alias("seq"), text("kind").alias("kind"), text("role").alias("role"), text("text").alias("text"))
    dealt = e.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), F.col("seq").asc_nulls_first(), "role", "text")
    return dealt.select("conv_id", "turn_key", "kind", "role", "text").mapInPandas(_rendered, PIECES).withColumn("conv_id", F.col("conv_id").cast("long"))


def conversation_events(conversations: DataFrame) -> DataFrame:
    """A table of finished messages (``conv_id, turn, role, text``) as a log."""
    return conversations.select("conv_id", "turn", F.lit(None).cast("long").alias("seq"), F.lit("message").alias("kind"), "role", "text")


#: Code points of a delta at least, and deltas of a message at most.
DELTA, MOST_DELTAS = 200, 64


def _deltas(text: Column) -> Column:
    """``text`` in order, cut into up to ``MOST_DELTAS`` events; none for an empty one."""
    n = F.length(text)
    width = F.greatest(F.lit(DELTA), F.ceil(n / MOST_DELTAS).cast("int"))
    cuts = F.when(n > 0, F.sequence(F.lit(1), n, width)).otherwise(F.array().cast("array<int>"))
    return F.transform(cuts, lambda at: F.struct(F.lit("delta").alias("kind"), F.substring(text, at, width).alias("text")))


def streamed_events(conversations: DataFrame) -> DataFrame:
    """The same messages as the log that a chat service keeps of them. By a hash of the row a message comes whole; as a
    stream of deltas; as a draft that is edited; as a draft that is regenerated and streamed anew; or after one that
    is deleted. Messages of one turn are numbered by role and text; null texts are empty ones."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    c = conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text.alias("text"))
    order = W.partitionBy("conv_id", "turn").orderBy("role", "text")
    c = c.withColumn("nth", F.row_number().over(order)).withColumn("way", F.pmod(F.xxhash64("conv_id", "turn", "role", "text"), F.lit(5)))
    event = lambda kind, t: F.array(F.struct(F.lit(kind).alias("kind"), t.alias("text")))
    text, empty = F.col("text"), F.lit("")
    draft = F.concat(F.lit("draft: "), F.left(text, F.lit(2 * DELTA)))
    events = (
        F.when(F.col("way") == 0, event("message", text))
        .when(F.col("way") == 1, F.concat(event("message", empty), _deltas(text)))
        .when(F.col("way") == 2, F.concat(event("message", draft), event("edit", text)))
        .when(F.col("way") == 3, F.concat(event("message", empty), _deltas(draft), event("regenerate", empty), _deltas(text)))
        .otherwise(F.concat(event("message", draft), event("delete", empty), event("message", text)))
    )
    step = F.posexplode(events).alias("step", "event")
    log = c.select("conv_id", "turn", "role", "nth", step)
    return log.select("conv_id", "turn", (F.col("nth").cast("long") * 1000 + F.col("step")).alias("seq"), "event.kind", "role", "event.text")


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows, at, state = [], object(), None

    def close():
        turns, loss, n, chars, total = state
        rows.append((at, n, turns.hexdigest(), chars, loss.hexdigest(), total))

    for b in batches:
        for conv, piece, a, z in zip(b["conv_id"], b["formatted"], b["loss_start"], b["loss_end"], strict=True):
            if state is None or conv != at:
                if state is not None:
                    close()
                at, state = conv, [hashlib.sha256(), hashlib.sha256(), 0, 0, 0]
            role, text = parse(piece)
            masked = unescape(piece[a:z])
            state[0].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            state[1].update(masked.encode("utf-8", "surrogatepass"))
            state[2] += 1
            state[3] += len(masked)
            state[4] += len(piece)
        if len(rows) > 10_000:
            yield _digest_frame(rows)
            rows = []
    if state is not None:
        close()
    yield _digest_frame(rows)


def _digest_frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(pieces: DataFrame) -> DataFrame:
    """Digests of what the rendered pieces say, one row a conversation."""
    dealt = pieces.withColumn("conv_id", F.col("conv_id").cast("string")).repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return dealt.mapInPandas(_digests, DIGEST).withColumn("conv_id", F.col("conv_id").cast("long"))
