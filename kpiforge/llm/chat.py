"""Chat formatting in budgeted windows.

A conversation's turns are marked up and cut into windows of a token budget:
prefix sums of turn tokens choose spans of whole turns, every window starts
with the system turn, then repeats a limited history, then holds new turns;
only the texts of new assistant turns are under the loss mask.

Conversations are cut into blocks of ``BLOCK`` turn numbers first, so a huge
one is formatted by many tasks; windows and history stay inside a block. Rows
stream through a task in order; it holds one window at a time.

Template of a turn: ``<turn "role">`` with the role as a JSON string, newline,
text, ``</turn>``, newline. In a text, ``<turn`` and ``</turn`` get a backslash
after ``<`` (one more if there are some), which reading takes away again.

Special input: null texts and roles are empty strings; rows with a null
conv_id are left out; a null turn comes first; equal turns go by role, then
text, and repeated rows are repeated turns; a turn longer than the budget is a
window of its own, never cut; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from kpiforge.llm.common import table
from kpiforge.llm.packing import VOCABULARY, tokenizer_at, vocabulary_path

BUDGET = 1024           # tokens of a window
HISTORY_TOKENS = 256    # tokens of repeated turns
HISTORY_TURNS = 4
BLOCK = 512             # turn numbers that are formatted together
MARK_TOKENS = 8         # tokens allowed for the marks of a turn
SYSTEM_FOLLOWS, SYSTEM_TURN, OWN_TURN = 0, 1, 2

_CONTROL = re.compile(r"<(\\*)(/?turn)")
_ESCAPED = re.compile(r"<\\(\\*)(/?turn)")
_HEADER, _END = re.compile(r'<turn ("(?:[^"\\]|\\.)*")>\n'), "</turn>\n"
WINDOWS = ("conv_id long, block long, window long, n_repeated int, n_new int, n_tokens long, text string, "
           "loss array<struct<start int, end int>>")


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1\2", text)


def header(role: str) -> str:
    return f"<turn {json.dumps(role, ensure_ascii=False).replace('<', chr(92) + 'u003c')}>\n"


def render(turns: list[tuple[str, str]], n_repeated: int) -> tuple[str, list[dict[str, int]]]:
    """Formatted window, and the spans of new assistant texts in it."""
    out, size, loss = [], 0, []
    for k, (role, text) in enumerate(turns):
        head, body = header(role), escape(text)
        if k >= n_repeated and role == "assistant" and body:
            loss.append({"start": size + len(head), "end": size + len(head) + len(body)})
        out += [head, body, _END]
        size += len(head) + len(body) + len(_END)
    return "".join(out), loss


def parse(window: str) -> list[tuple[str, str]]:
    """The turns of a formatted window."""
    turns, at = [], 0
    while at < len(window):
        m = _HEADER.match(window, at)
        end = window.index(_END, m.end())
        turns.append((json.loads(m[1]), unescape(window[m.end():end])))
        at = end + len(_END)
    return turns


def prepared(conversations: DataFrame, vocabulary: str) -> DataFrame:
    """(conv_id, block, kind, turn, role, text, n_tokens): the turns, and rows that bring the system turn to each block."""

    @pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tok = tokenizer_at(vocabulary if "/" in vocabulary else vocabulary_path(vocabulary))
        for s in batches:
            yield pd.Series([len(ids) // 4 + MARK_TOKENS for ids in tok.encode([escape(t).encode() for t in s])], dtype="int64")

    c = conversations.filter("conv_id IS NOT NULL").select(
        "conv_id", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-1)).cast("long").alias("block"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    first = c.groupBy("conv_id").agg(F.min(F.struct("turn", "role", "text")).alias("f"), F.min("block").alias("home")).filter(
        "f.role = 'system'").select("conv_id", "home", "f.*").withColumn("n_tokens", count("text"))
    # a row ahead of each block's turns tells of the system turn: SYSTEM_FOLLOWS where it is the next row
    kind = F.when(F.col("block") == F.col("home"), SYSTEM_FOLLOWS).otherwise(SYSTEM_TURN)
    heads = c.select("conv_id", "block").distinct().join(first, "conv_id").withColumn("kind", kind)
    rows = c.withColumn("kind", F.lit(OWN_TURN)).withColumn("n_tokens", count("text"))
    names = ["conv_id", "block", "kind", "turn", "role", "text", "n_tokens"]
    return rows.select(names).unionByName(heads.select(names))


def chat_windows(conversations: DataFrame, budget: int = BUDGET, history_tokens: int = HISTORY_TOKENS,
                 history_turns: int = HISTORY_TURNS, vocabulary: str = VOCABULARY) -> DataFrame:
    """Formatted windows (WINDOWS) of the ``conv_id, turn, role, text`` rows.

    ``loss`` spans count code points of ``text``; the first ``n_repeated`` turns
    of a window were in an earlier one, or are the system turn of a later block.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = system = None
        own_system = False                          # the system turn is one of this block's turns
        past: list[tuple] = []                      # (role, text, tokens) that the open window repeats
        span: list[tuple] = []                      # and its new turns
        used = number = 0
        out: list[tuple] = []

        def close() -> None:
            nonlocal past, span, used, number
            if not span:
                return
            opens = own_system and number == 0      # the system turn is the first new turn
            lead = [system, *past] if system and not opens else past
            text, loss = render([t[:2] for t in [*lead, *span]], len(lead))
            out.append((*key, number, len(lead), len(span), sum(t[2] for t in [*lead, *span]), text, loss))
            past, total = [], 0
            for t in reversed(span[1 if opens else 0:][-history_turns:]):
                total += t[2]
                if total > history_tokens:
                    break
                past.insert(0, t)
            span, number = [], number + 1
            used = sum(t[2] for t in past) + (system[2] if system else 0)

        for b in batches:
            for conv, block, kind, _, role, text, tokens in b.itertuples(index=False):
                if (conv, block) != key:
                    close()
                    key, system, own_system, past, used, number = (conv, block), None, False, [], 0, 0
                if kind == SYSTEM_FOLLOWS:
                    own_system = True
                    continue
                turn = (role, text, tokens)
                if kind == SYSTEM_TURN:
                    system, used = turn, tokens
                    continue
                if own_system and system is None:
                    system = turn
                if span and used + tokens > budget:
                    close()
                if not span and past and used + tokens > budget:
                    past, used = [], system[2] if system else 0     # a long turn goes without history
                span.append(turn)
                used += tokens
            if out:
                yield pd.DataFrame(out, columns=names)
                out.clear()
        close()
        yield pd.DataFrame(out, columns=names)

    names = ["conv_id", "block", "window", "n_repeated", "n_new", "n_tokens", "text", "loss"]
    rows = prepared(conversations, vocabulary)
    order = ["conv_id", "block", "kind", F.col("turn").asc_nulls_first(), "role", "text"]
    return rows.repartition("conv_id", "block").sortWithinPartitions(*order).mapInPandas(run, WINDOWS)


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation, what its windows hold: turns, loss texts and characters, streamed in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = None
        out: list[tuple] = []

        def close() -> None:
            if key is not None:
                out.append((key, n_turns, all_turns.hexdigest(), n_loss, all_loss.hexdigest(), chars, n_windows))

        for b in batches:
            for conv, text, n_repeated, loss in b.itertuples(index=False):
                if conv != key:
                    close()
                    key, n_turns, n_loss, chars, n_windows = conv, 0, 0, 0, 0
                    all_turns, all_loss = hashlib.sha256(), hashlib.sha256()
                for role, said in parse(text)[n_repeated:]:
                    all_turns.update(f"{role}\n{said}\n".encode())
                    n_turns += 1
                for s in loss:
                    said = unescape(text[s["start"]:s["end"]])
                    all_loss.update(said.encode())
                    n_loss += len(said)
                chars += len(text)
                n_windows += 1
            if out:
                yield pd.DataFrame(out, columns=names)
                out.clear()
        close()
        yield pd.DataFrame(out, columns=names)

    kind = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
            "formatted_chars long, n_windows long")
    names = [x.split()[0] for x in kind.split(", ")]
    w = windows.select("conv_id", "block", "window", "text", "n_repeated", "loss")
    w = w.repartition("conv_id").sortWithinPartitions("conv_id", "block", "window")
    return w.select("conv_id", "text", "n_repeated", "loss").mapInPandas(run, kind)


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return read_back(chat_windows(given.unionByName(extra)))
