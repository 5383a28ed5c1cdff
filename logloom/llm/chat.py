"""Chat formatting: turn spans found by rendering growing prefixes through a black-box template."""

from __future__ import annotations

import hashlib
import os.path
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A template turns (role, text) turns into one string. Nothing else is known of it.
Template = Callable[[list[tuple[str, str]]], str]

START, END = "<|im_start|>", "<|im_end|>"
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.DOTALL)


def escape(text: str) -> str:
    """No control string can begin in an escaped text; unescape gives the text back."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def marked_turns(turns: list[tuple[str, str]]) -> str:
    """The default template: a start mark, the role on a line, the text and an end mark per turn."""
    return "".join(f"{START}{escape(role).replace(chr(10), chr(92) + 'n')}\n{escape(text)}{END}\n" for role, text in turns)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of what `marked_turns` gave."""
    def role(text: str) -> str:
        return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)

    return [(role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


@dataclass
class Rendered:
    """`spans` of whole turns and `texts` of the turn texts, as character offsets with exclusive ends.
    `rewritten` is the first turn whose rendering changed what earlier turns had given, or -1; there
    the spans come from the final output alone."""

    text: str
    spans: list[tuple[int, int]]
    texts: list[tuple[int, int]]
    rewritten: int


def _common_end(a: str, b: str) -> int:
    return len(os.path.commonprefix([a[::-1], b[::-1]]))


def _probed(template: Template, turns: list[tuple[str, str]], k: int, whole: str) -> tuple[int, int]:
    """Where the text of turn k lies in `whole`: two renderings that differ in that text alone part
    where it begins, and meet again where it ends."""
    a, b = (template([*turns[:k], (turns[k][0], p), *turns[k + 1:]]) for p in ("a", "b"))
    begin = len(os.path.commonprefix([a, b]))
    return begin, max(begin, len(whole) - _common_end(a[begin:], b[begin:]))


def render(template: Template, turns: list[tuple[str, str]]) -> Rendered:
    """Renders the first turn, the first two, and so on. As long as an output begins with the one
    before it, the rest is the span of the new turn. A template that rewrites history is noted, and
    each text is then looked for in the final output. The work is the square of the number of turns."""
    before, spans, texts, rewritten = template([]), [], [], -1
    for k in range(len(turns)):
        prefix = turns[:k + 1]
        now = template(prefix)
        if rewritten < 0 and not now.startswith(before):
            rewritten = k
        spans.append((len(before), len(now)))
        texts.append(_probed(template, prefix, k, now))
        before = now
    if rewritten >= 0:
        texts = [_probed(template, turns, k, before) for k in range(len(turns))]
        edges = [0, *[(a[1] + b[0]) // 2 for a, b in zip(texts, texts[1:])], len(before)]
        spans = list(zip(edges, edges[1:]))
    return Rendered(before, spans, texts, rewritten)


def format_conversations(rows: DataFrame, template: Template = marked_turns, loss_roles: tuple[str, ...] = ("assistant",),
                         conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text") -> DataFrame:
    """One row per conversation: its id, formatted, turn_starts, turn_ends, loss_starts, loss_ends (of
    texts whose role is in `loss_roles`), n_turns, rewritten (turn or -1).

    Turns stand in the order of their number (null first), then of role and text; repeated rows are
    turns of their own. A null text or role counts as empty. A null id is a conversation like any
    other. Other columns are left out. An empty table gives no rows."""
    kind = rows.schema[conv_col].dataType.simpleString()
    turns = rows.select(F.col(conv_col).cast("string").alias("id"), F.struct(
        F.col(turn_col).cast("long").alias("t"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("r"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("x")).alias("turn"))
    talks = turns.groupBy("id").agg(F.sort_array(F.collect_list("turn")).alias("ts")).select("id", "ts.r", "ts.x")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for conv, roles, texts in zip(batch["id"], batch["r"], batch["x"]):
                done = render(template, list(zip(roles, texts)))
                loss = [s for role, s in zip(roles, done.texts) if role in loss_roles]
                out.append((conv, done.text, [s for s, _ in done.spans], [e for _, e in done.spans],
                            [s for s, _ in loss], [e for _, e in loss], len(roles), done.rewritten))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    schema = ("conv string, formatted string, turn_starts array<int>, turn_ends array<int>, loss_starts array<int>, "
              "loss_ends array<int>, n_turns long, rewritten int")
    done = talks.mapInPandas(each, schema)
    return done.select(F.col("conv").cast(kind).alias(conv_col), *[c.split()[0] for c in schema.split(", ")][1:])


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of conversations that `marked_turns` formatted, read from the output and its mask:
    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, rewritten."""
    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for conv, text, starts, ends, rewritten in zip(*(batch[c] for c in ("id", "formatted", "loss_starts", "loss_ends", "rewritten"))):
                turns = read_turns(text)
                loss = "".join([unescape(text[a:b]) for a, b in zip(starts, ends)])
                out.append((conv, len(turns), _sha("".join([f"{r}\n{x}\n" for r, x in turns])), len(loss), _sha(loss), len(text), rewritten))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    schema = ("conv string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
              "rewritten int")
    id_col, kind = formatted.columns[0], formatted.dtypes[0][1]
    named = formatted.select(F.col(id_col).cast("string").alias("id"), "formatted", "loss_starts", "loss_ends", "rewritten")
    return named.mapInPandas(digest, schema).select(F.col("conv").cast(kind).alias(id_col), *[c.split()[0] for c in schema.split(", ")][1:])


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
