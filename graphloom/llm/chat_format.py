"""Chat formatting by incremental black-box rendering.

A template is any function from a list of messages to a string. Successive turn prefixes are
rendered; where each output extends the one before, the extension is the new turn's span. A
template that rewrites what it has already put out (its output is no extension) is reported.
A second rendering of each prefix, with a probe for the turn's text, shows what the template puts
before and after the text; the rest of the span is the text as it was written.

Prefixes of n turns cost the square of n. A template that says that it is ``additive`` (the output
for two lists, one after the other, is that for the first and that for the second) is rendered in
stretches of ``STRETCH`` turns, each with its own successive prefixes; whole prefixes, rendered
where their length has doubled and at the end, must be what the stretches give, or else all
prefixes are rendered after all.

Rows go to partitions by conversation and are sorted there, then streamed; a task holds one
conversation at a time, which is the unit that a template needs.

Defined cases: null text and null role are empty; turns are ordered by turn, then role, then text,
so ties and repeated rows have one order; a null conv_id is a conversation of its own; an empty
table gives an empty table; columns other than the four named are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Message = tuple[str, str]  # role, text
Template = Callable[[list[Message]], str]
#: Turns that an additive template renders together; the private-use characters.
STRETCH, PROBES = 16, "".join(map(chr, range(0xE000, 0xF900)))

#: What the template writes to mark turns, and what other templates do; escaped inside texts.
CONTROL = ("<|turn|>", "<|text|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def turn_template(messages: list[Message]) -> str:
    return "".join([f"<|turn|>{escape(role)}<|text|>{escape(text)}<|end|>\n" for role, text in messages])


turn_template.additive = True

_TURN = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>\n", re.S)


def read_back(formatted: str) -> list[Message]:
    """The messages in a string that ``turn_template`` made."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def probe_for(*texts: str) -> str:
    """A string of private-use characters that none of the texts holds, as short as can be."""
    for c in PROBES:
        if not any(c in t for t in texts):
            return c
    # A run of one character that is longer than any run of it.
    longest = max((len(m[0]) for t in texts for m in re.finditer(PROBES[0] + "+", t)), default=0)
    return PROBES[0] * (longest + 1)


def locate(messages: list[Message], template: Template) -> tuple[str, list[tuple[int, int, int, int]], bool]:
    """The rendering, each turn's (start, text start, text end, end), and whether history was rewritten.

    Where it was, the spans of the turns so far are void and recorded as empty."""
    if not getattr(template, "additive", False) or len(messages) <= STRETCH:
        return _prefixes(messages, template)
    parts, spans, at, check = [], [], 0, 2 * STRETCH
    for k in range(0, len(messages), STRETCH):
        part, found, rewritten = _prefixes(messages[k : k + STRETCH], template)
        parts.append(part)
        spans += [(a + at, b + at, c + at, d + at) for a, b, c, d in found]
        at += len(part)
        done = min(k + STRETCH, len(messages))
        if done >= check or done == len(messages):
            check = 2 * done
            if rewritten or template(messages[:done]) != "".join(parts):
                return _prefixes(messages, template)
    return "".join(parts), spans, False


def _prefixes(messages: list[Message], template: Template) -> tuple[str, list[tuple[int, int, int, int]], bool]:
    before, spans, rewritten = template([]), [], False
    done: list[Message] = []
    for role, text in messages:
        after = template([*done, (role, text)])
        # Texts, roles and markup may hold anything.
        probe = probe_for(role, before, after)
        marked = template([*done, (role, probe)])
        done.append((role, text))
        start = len(before)
        if not after.startswith(before):
            rewritten = True
            start = len(os.path.commonprefix([before, after]))
            spans = [x if x[3] <= start else (start,) * 4 for x in spans]
        tail, (head, _, rest) = after[start:], marked[start:].partition(probe)
        if tail.startswith(head) and tail.endswith(rest) and len(tail) >= len(head) + len(rest):
            spans.append((start, start + len(head), len(after) - len(rest), len(after)))
        else:  # the template changes its markup with the text: the whole span counts as text
            spans.append((start, start, len(after), len(after)))
        before = after
    return before, spans, rewritten


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def format_chats(df: DataFrame, template: Template = turn_template, reader: Callable[[str], list[Message]] = read_back, undo: Callable[[str], str] = unescape, outputs: bool = True) -> DataFrame:
    """One row per conversation: digests of what is read back, the loss mask's text (assistant
    texts), whether the template rewrites history; with ``outputs`` the string and the spans."""
    fields = [T.StructField("conv_id", T.LongType()), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType()), T.StructField("rewrites", T.BooleanType())]
    span = T.ArrayType(T.LongType())
    if outputs:
        fields += [T.StructField("formatted", T.StringType()), T.StructField("loss_spans", T.ArrayType(span))]
    schema = T.StructType(fields)

    def chat(conv_id, messages: list[Message]) -> dict:
        formatted, spans, rewrites = locate(messages, template)
        turns = reader(formatted)
        loss_spans = [[a, b] for (role, _), (_, a, b, _) in zip(messages, spans, strict=True) if role == "assistant"]
        loss = "".join([undo(formatted[a:b]) for a, b in loss_spans])
        row = {"conv_id": conv_id, "n_turns": len(turns), "turns_sha256": _digest("".join([f"{r}\n{t}\n" for r, t in turns])), "loss_chars": len(loss), "loss_sha256": _digest(loss), "formatted_chars": len(formatted), "rewrites": rewrites, "formatted": formatted, "loss_spans": loss_spans}
        return {f.name: row[f.name] for f in fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        current, messages, ready = None, [], []
        for batch in batches:
            for key, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if messages and key != current:
                    ready.append(chat(current, messages))
                    messages = []
                current = key
                messages.append((role, text))
            if ready:
                yield pa.RecordBatch.from_pylist(ready, schema=target)
                ready = []
        if messages:
            yield pa.RecordBatch.from_pylist([chat(current, messages)], schema=target)

    rows = df.select(df["conv_id"].cast("long").alias("conv_id"), df["turn"].cast("long").alias("turn"), F.coalesce(df["role"].cast("string"), F.lit("")).alias("role"), F.coalesce(df["text"].cast("string"), F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, schema)
