"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context and only that reply is under the
loss mask. A conversation that does not end with an assistant turn gets one last example without a mask, so that no
turn is lost. Control strings inside texts are broken by a backslash and backslashes are doubled, so the markers stand
only where the template put them and each text can be read back.

Defined results: turns are ordered by (turn, role, text); a null text or role counts as empty; repeated rows are turns
of their own, and turns equal in all three are alike in either order; a null conv_id is a conversation like any other; very long texts stay
whole; an empty table gives no examples; columns besides the four are not read, whatever their names. An example holds
its whole prefix, so the output of one conversation grows with the square of its turns: that is what is asked for.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, rows, slices

# The template's markers.
USER = ("[INST]", "[/INST]")
ASSISTANT = ("<s>", "</s>")
SYSTEM = ("<<SYS>>", "<</SYS>>")
OTHER = ("<<ROLE:", "<</ROLE>>")

MARKS = {"user": USER, "assistant": ASSISTANT, "system": SYSTEM}
CONTROL = re.compile("|".join(re.escape(m) for pair in (*MARKS.values(), OTHER) for m in pair))
SPECIAL = re.compile(rf"\\|{CONTROL.pattern}")
OPEN = re.compile(rf"{re.escape(USER[0])}|{re.escape(ASSISTANT[0])}|{re.escape(SYSTEM[0])}|{re.escape(OTHER[0])}([0-9a-f]*)>>")
ROLE_OF = {pair[0]: (role, pair[1]) for role, pair in MARKS.items()}

EXAMPLES = pa.schema([("conv_id", pa.int64()), ("example", pa.int32()), ("n_turns", pa.int64()), ("last", pa.bool_()), ("formatted", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])
READ = pa.schema([("conv_id", pa.int64()), ("example", pa.int32()), ("last", pa.bool_()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss", pa.string()), ("chars", pa.int64())])


def escape(text: str) -> str:
    return SPECIAL.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def marked(role: str, text: str) -> tuple[str, str, str]:
    """What stands before a turn's text, the escaped text, what stands after it."""
    before, after = MARKS.get(role) or (f"{OTHER[0]}{role.encode().hex()}>>", OTHER[1])
    return before, escape(text), after


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted example."""
    out, at = [], 0
    while at < len(formatted):
        m = OPEN.match(formatted, at)
        role, close = ROLE_OF.get(m[0]) or (bytes.fromhex(m[1]).decode(), OTHER[1])
        end = formatted.index(close, m.end())
        out.append((role, unescape(formatted[m.end() : end])))
        at = end + len(close)
    return out


def examples(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, n_turns, last, formatted, loss_start, loss_end), one row for each trainable reply.

    ``formatted[loss_start:loss_end]`` (in characters) is the reply; ``last`` marks the example that holds all turns.
    """
    turns = F.collect_list(F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))
    grouped = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(turns).alias("turns"))

    def expand(batches):
        for b in slices(batches):
            for conv, turns in zip(column(b, "conv_id"), column(b, "turns"), strict=True):
                prefix, size, k, out, held = [], 0, 0, [], 0
                for n, t in enumerate(turns, 1):
                    before, text, after = marked(t["role"], t["text"])
                    prefix += (before, text, after)
                    start = size + len(before)
                    size = start + len(text) + len(after)
                    reply, last = t["role"] == "assistant", n == len(turns)
                    if reply or last:
                        out.append((conv, k, n, last, "".join(prefix), *((start, start + len(text)) if reply else (size, size))))
                        k, held = k + 1, held + size
                    if out and (last or held > 8_000_000):
                        yield rows(EXAMPLES, list(zip(*out, strict=True)))
                        out, held = [], 0

    return grouped.mapInArrow(expand, "conv_id long, example int, n_turns long, last boolean, formatted string, loss_start long, loss_end long")


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, parsed from the formatted examples alone."""

    def parse(batches):
        for b in slices(batches):
            out = []
            for conv, example, last, text, start, end in zip(*(column(b, c) for c in ("conv_id", "example", "last", "formatted", "loss_start", "loss_end")), strict=True):
                turns = turns_of(text) if last else []
                said = "".join(f"{role}\n{said}\n" for role, said in turns)
                out.append((conv, example, last, len(turns), hashlib.sha256(said.encode("utf-8", "replace")).hexdigest() if last else None, unescape(text[start:end]), len(text)))
            yield rows(READ, list(zip(*out, strict=True)) or [[] for _ in READ])

    parsed = formatted.select("conv_id", "example", "last", "formatted", "loss_start", "loss_end").mapInArrow(parse, "conv_id long, example int, last boolean, n_turns long, turns_sha256 string, loss string, chars long")
    loss = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "")
    each = parsed.groupBy("conv_id").agg(F.max("n_turns").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"), loss.alias("loss"), F.sum("chars").alias("formatted_chars"))
    return each.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
