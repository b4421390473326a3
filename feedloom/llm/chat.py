"""Chat formatting by prefix-target expansion: one training example for each assistant turn."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import sliced

#: The template's marks. Texts and roles hold no mark once escaped, so a formatted example is read back by its marks.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings that get a backslash after their first character inside texts (another one for each already there):
#: all that begin like the template's marks, and those of common public chat templates.
_ESCAPE = re.compile(r"(<)(\\*)(?=\||/?s>)|(\[)(\\*)(?=/?INST\])")

EXAMPLES = "conv long, target long, n_turns long, text string, loss_start long, loss_end long, last boolean"


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: f"{m[1] or m[3]}{m[2] or m[4] or ''}\\", text)




def unescape(text: str) -> str:
    """Undoes escape(): takes one backslash from each control string that has any after its first character.

    '<' is followed by '|', 's>' or '/s>' and '[' by 'INST]' or '/INST]' in what escape() touches; the other two
    pairings never got a backslash, so they keep theirs."""
    return re.sub(r"(<\\*)\\(?=\||/?s>)|(\[\\*)\\(?=/?INST\])", lambda m: m[1] or m[2], text)


def turn_text(role: str, text: str) -> tuple[str, int]:
    """A formatted turn, and where its text begins in it."""
    head = f"{TURN}{escape(role)}{TEXT}"
    return f"{head}{escape(text)}{END}", len(head)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) of each turn of a formatted example."""
    out = []
    for part in formatted.split(TURN)[1:]:
        role, _, rest = part.partition(TEXT)
        if not rest.endswith(END):
            raise ValueError("a turn has no end mark")
        out.append((unescape(role), unescape(rest[: -len(END)])))
    return out


def expand(turns: DataFrame, *, trainable: str = "assistant", conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per example: conv, target (ordinal of the trainable turn), n_turns, text, loss_start, loss_end, last.

    An example is every preceding turn and then one assistant turn, whose text alone, [loss_start, loss_end) in code
    points, is trainable. A conversation that does not end in one gets a last example of all turns with an empty mask
    (loss_start = loss_end), so no turn is lost. Turns stream in order through the task that holds their conversation;
    memory is one conversation's formatted text, which its longest example holds anyway. The examples' total size is
    quadratic in a conversation's length: that is the expansion itself.

    Null texts and roles count as empty; turns are ordered by (turn, role, text), so repeated turns keep a defined
    order; null turn numbers come first; rows with a null conversation id are one conversation; an empty table gives no
    examples; other columns are not read.
    """
    rows = turns.select(F.col(conv_col).cast("long").alias("_conv"), F.col(turn_col).alias("_turn"), F.coalesce(role_col, F.lit("")).alias("_role"), F.coalesce(text_col, F.lit("")).alias("_text"))
    dealt = rows.repartition("_conv").sortWithinPartitions("_conv", "_turn", "_role", "_text").select("_conv", "_role", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, prefix, n, mask = None, [], 0, (0, 0)
        length = 0
        begun = ended = False
        rows: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            nonlocal size
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()], strict=True)], ["conv", "target", "n_turns", "text", "loss_start", "loss_end", "last"])
            rows.clear()
            size = 0
            return batch

        def close() -> None:
            """The last example, held back until its conversation ends."""
            if begun:
                rows.append((conv, n, n, "".join(prefix), *(mask if ended else (length, length)), True))

        for batch in sliced(batches, "_text", 1 << 20):
            for key, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or key != conv:
                    close()
                    size += length
                    conv, prefix, n, length, begun, ended = key, [], 0, 0, True, False
                elif ended:
                    rows.append((conv, n, n, "".join(prefix), *mask, False))
                    size += length
                formatted, head = turn_text(role, text)
                ended = role == trainable
                mask = (length + head, length + len(formatted) - len(END))
                prefix.append(formatted)
                length += len(formatted)
                n += 1
                if size > 2 << 20:
                    yield out()
        close()
        if rows:
            yield out()

    return dealt.mapInArrow(run, EXAMPLES)


def read_back(examples: DataFrame) -> DataFrame:
    """One row per conversation, from its examples' text and masks alone; they must lie together and in order, as
    expand() gives them: conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, chars, formatted, count = hashlib.sha256(), 0, 0, 0
        rows: list[tuple] = []
        for batch in batches:
            for conv, _, _, text, start, end, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                reply = unescape(text[start:end])
                loss.update(reply.encode())
                chars, formatted, count = chars + len(reply), formatted + len(text), count + 1
                if last:
                    turns = parse(text)
                    digest = hashlib.sha256()
                    for role, said in turns:
                        digest.update(f"{role}\n{said}\n".encode())
                    rows.append((conv, len(turns), digest.hexdigest(), chars, loss.hexdigest(), formatted, count))
                    loss, chars, formatted, count = hashlib.sha256(), 0, 0, 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()], strict=True)], ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples"])
                rows = []

    return examples.mapInArrow(run, "conv long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long")
