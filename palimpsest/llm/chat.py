"""Chat formatting in budgeted windows.

Running sums of the turns' token counts, as a tokenizer gives them, cut a conversation into spans of whole turns. A window holds the system turn, a
limited stretch of turns that an earlier window had (history), and its own new turns; only assistant texts among the new
ones are under the loss mask, so each is a target once. Texts are escaped reversibly, so no marker can come from a text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rested, ship
from .packing import word_ids

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Strings with a meaning in the template or in wide-spread ones; a text's own get a backslash behind their first character.
CONTROL = (
    "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<|system|>", "<|user|>", "<|assistant|>",
    "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<unk>", "<pad>", "</w>",
)
_FIND = re.compile("(?=" + "|".join(map(re.escape, CONTROL)) + ")(.)", re.S)
_HEAD = re.compile(r"((?:[^\\\n]|\\.)*)\n", re.S)


def escape(text: str) -> str:
    return _FIND.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and where its text begins and ends in it, in code points."""
    head = OPEN + escape(role).replace("\n", "\\\n") + "\n"
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def counter(tokenizer: str) -> Callable[[str], int]:
    """Counts a formatted turn's tokens. As turns end in white space, which the tokenizer drops, a window's tokens are the
    sum of its turns'."""
    ids = word_ids(tokenizer)
    return lambda formatted: len(ids.of(formatted.encode("utf-8", "replace"))) // 4


def windows(turns: Iterator[tuple[str, str]], budget: int, history: int, cost: Callable[[str], int]) -> Iterator[tuple[str, list[tuple[int, int]], int]]:
    """(formatted, loss spans, repeated turns at its beginning) of a conversation's windows; memory holds one window.

    Turns are taken while their running sum stays within the budget; a turn above the budget has a window of its own,
    as turns are never cut. A window after the first begins with the first turn if that is a system turn, then with the
    last turns before it whose sum is at most `history`, as far as the next new turn still fits.
    """
    system: tuple | None = None
    past: list[tuple] = []  # formatted turns of this window: (role, formatted, start, end, tokens)
    fresh, sum_, repeated, begun = 0, 0, 0, False

    def close():
        at, spans = 0, []
        for k, (role, f, a, b, _) in enumerate(past):
            if k >= repeated and role == "assistant":
                spans.append((at + a, at + b))
            at += len(f)
        return "".join(p[1] for p in past), spans, repeated

    for role, text in turns:
        f, a, b = turn(role, text)
        new = (role, f, a, b, cost(f))
        if not begun:
            begun, system = True, new if role == "system" else None
        if fresh and sum_ + new[4] > budget:
            yield close()
            keep = [system] if system else []
            room = min(history, budget - sum(p[4] for p in keep) - new[4])
            tail: list[tuple] = []
            for p in reversed(past[1 if system else 0 :]):
                room -= p[4]
                if room < 0:
                    break
                tail.append(p)
            past = keep + tail[::-1]
            repeated, fresh, sum_ = len(past), 0, sum(p[4] for p in past)
        past.append(new)
        fresh, sum_ = fresh + 1, sum_ + new[4]
    if fresh:
        yield close()


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts, read back."""
    out = []
    for part in formatted.split(OPEN)[1:]:
        head = _HEAD.match(part)
        out.append((unescape(head[1]), unescape(part[head.end() : -len(CLOSE)])))
    return out


_WINDOW = "conv_id long, window long, formatted string, loss array<struct<start:long,end:long>>, repeated long"


def format_windows(rows: DataFrame, tokenizer: str, budget: int = 512, history: int = 128) -> DataFrame:
    """conv_id, window, formatted, loss (spans in code points of formatted), repeated (turns at the window's beginning
    that earlier windows had): all conversations' windows, in order within a partition. budget and history are in tokens
    of `tokenizer`, a file of one that drops white space.

    Turns are ordered by turn, nulls last, ties by role and text. Null roles and texts are empty; rows with a null
    conv_id form one conversation; repeated rows are turns of their own; other columns are ignored. A conversation of
    any length streams through one task in constant memory, window by window; a very long turn is one window, held whole.
    An empty table gives no rows.
    """
    if budget < 1 or history < 0:
        raise ValueError("budget must be positive and history not negative")
    ship(rows.sparkSession)
    turns = rows.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    turns = turns.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "text")

    @rested
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flow() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text")))

        def out(part: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.int64()]
            cols = [[w[k] for w in part] for k in range(5)]
            cols[3] = [[{"start": a, "end": b} for a, b in spans] for spans in cols[3]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["conv_id", "window", "formatted", "loss", "repeated"])

        rest, part, size, cost = flow(), [], 0, counter(tokenizer)
        ahead = next(rest, None)
        while ahead is not None:
            conv = ahead[0]

            def own() -> Iterator[tuple[str, str]]:
                nonlocal ahead
                while ahead is not None and ahead[0] == conv:  # noqa: B023
                    yield ahead[1:]
                    ahead = next(rest, None)

            for k, w in enumerate(windows(own(), budget, history, cost)):
                part.append((conv, k, *w))
                size += len(w[0])
                if size > 1 << 20:
                    yield out(part)
                    part, size = [], 0
        if part:
            yield out(part)

    return turns.mapInArrow(run, _WINDOW)


def digest(made: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from format_windows' rows,
    whose order within partitions it relies on."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, begun, turns, loss, n, chars, whole = None, False, hashlib.sha256(), hashlib.sha256(), 0, 0, 0

        def row() -> tuple:
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), whole

        def out(done: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate(kinds)], names=names)

        for b in batches:
            done = []
            for c, formatted, spans, repeated in zip(*(b.column(x).to_pylist() for x in ("conv_id", "formatted", "loss", "repeated"))):
                if not begun or c != conv:
                    if begun:
                        done.append(row())
                    conv, begun, turns, loss, n, chars, whole = c, True, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                for role, text in parse(formatted)[repeated:]:
                    turns.update(f"{role}\n{text}\n".encode())
                    n += 1
                for s in spans:
                    text = unescape(formatted[s["start"] : s["end"]])
                    loss.update(text.encode())
                    chars += len(text)
                whole += len(formatted)
            yield out(done)
        if begun:
            yield out([row()])

    return made.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def brute(rows: list[tuple]) -> list[tuple]:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 straight from (conv_id, turn, role, text); for tests."""
    by: dict = {}
    for conv, at, role, text in rows:
        by.setdefault(conv, []).append((at is None, at or 0, role or "", text or ""))
    out = []
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        out.append((conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return out
