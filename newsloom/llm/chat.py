"""Heterogeneous chat records to one template, by schema fingerprint.

The nested field paths of a record, hashed, select a declarative mapping from its
layout to canonical turns (role, text).  The template marks turns with control
strings; the same strings inside a text are escaped, so the output reads back.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .common import in_frames, pick

TURN = "array<struct<role:string,text:string>>"
# Control strings of the template: fixed values.
OPEN, CLOSE, SAY, END = "[INST]", "[/INST]", "<s>", "</s>"
_CONTROL = re.compile(r"\\(.)|(\[INST\]|\[/INST\]|<s>|</s>|\|)", re.S)


def paths(value, at: str = "") -> set[str]:
    """Nested field paths with the kind of each leaf; list items share one path."""
    if isinstance(value, dict):
        return set().union(*(paths(v, f"{at}.{k}" if at else k) for k, v in value.items())) if value else {f"{at}:map"}
    if isinstance(value, list):
        return set().union(*(paths(v, at + "[]") for v in value)) if value else {f"{at}:list"}
    kind = {str: "text", bool: "flag", type(None): "null"}.get(type(value), "number")
    return {f"{at}:{kind}"}


def fingerprint(field_paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(field_paths)).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Mapping:
    """One layout.  Either ``turns`` names a list whose items hold ``role`` and ``text``,
    or ``fixed`` lists (role, field names), the texts of one turn joined by a blank line.
    ``renamed`` are roles that a foreign layout names otherwise; all others stay as they are."""

    name: str
    fields: tuple[str, ...]
    turns: str | None = None
    role: str = "role"
    text: str = "content"
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()
    lead: tuple[tuple[str, str], ...] = ()
    renamed: tuple[tuple[str, str], ...] = ()

    @property
    def key(self) -> str:
        return fingerprint(set(self.fields))

    def apply(self, record: dict) -> list[tuple[str, str]]:
        out = [(role, record[name] or "") for role, name in self.lead]
        if self.turns:
            names = dict(self.renamed)
            out += [(names.get(m[self.role], m[self.role]) or "", m[self.text] or "") for m in record[self.turns]]
        for role, names in self.fixed:
            out.append((role, "\n\n".join(x for x in (record[n] or "" for n in names) if x)))
        return out


ROLES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"))
MAPPINGS = (
    Mapping("messages", ("messages[].role:text", "messages[].content:text"), turns="messages"),
    Mapping("shared", ("conversations[].from:text", "conversations[].value:text"), turns="conversations",
            role="from", text="value", renamed=ROLES),
    Mapping("led messages", ("system:text", "messages[].role:text", "messages[].content:text"),
            turns="messages", lead=(("system", "system"),)),
    Mapping("prompt", ("prompt:text", "completion:text"),
            fixed=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("prompt and response", ("prompt:text", "response:text"),
            fixed=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("question", ("question:text", "answer:text"),
            fixed=(("user", ("question",)), ("assistant", ("answer",)))),
    Mapping("instruction", ("instruction:text", "output:text"),
            fixed=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("instruction with input", ("instruction:text", "input:text", "output:text"),
            fixed=(("user", ("instruction", "input")), ("assistant", ("output",)))),
)


def canonical(record: str | None, table: dict[str, Mapping]) -> tuple[str | None, list[tuple[str, str]] | None]:
    """(layout, turns); (None, None) for null, broken or unknown records."""
    try:
        value = json.loads(record or "null")
    except ValueError:
        return None, None
    mapping = table.get(fingerprint(paths(value))) if isinstance(value, dict) else None
    return (mapping.name, mapping.apply(value)) if mapping else (None, None)


def _escape(text: str, more: str = "") -> str:
    return re.sub(f"[\\\\<\\[{more}]", lambda m: "\\" + m.group(), text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the spans (start, end, in code points) of assistant texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        if role == "assistant":
            body = _escape(text)
            spans.append((at + len(SAY), at + len(SAY) + len(body)))
            parts.append(SAY + body + END)
        else:
            parts.append(OPEN + _escape(role, "|") + "|" + _escape(text) + CLOSE)
        at += len(parts[-1])
    return "".join(parts), spans


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns back from the formatted text alone."""
    turns, start, role = [], 0, None
    for m in _CONTROL.finditer(formatted):
        mark = m.group(2)
        if mark in (OPEN, SAY):
            start, role = m.end(), "assistant" if mark == SAY else None
        elif mark == "|" and role is None:
            role, start = unescape(formatted[start:m.start()]), m.end()
        elif mark in (CLOSE, END):
            turns.append((role, unescape(formatted[start:m.start()])))
    return turns


def format_chats(records: DataFrame, id_: str, record: str, mappings=MAPPINGS) -> DataFrame:
    """(conv_id, layout, formatted, loss): one row per JSON record.

    ``loss`` holds the spans of assistant texts.  A null, broken or unknown record
    keeps its row with nulls; null texts and roles inside a known layout are empty
    only where the layout says "text", so write them as empty strings.
    """
    table = {m.key: m for m in mappings}

    def run(frames):
        import pandas as pd

        for pdf in frames:
            out = []
            for text in pdf["record"]:
                layout, turns = canonical(text, table)
                formatted, spans = render(turns) if turns is not None else (None, None)
                out.append((layout, formatted, spans and [{"start": a, "stop": b} for a, b in spans] or (
                    None if spans is None else [])))
            frame = pd.DataFrame(out, columns=["layout", "formatted", "loss"])
            frame.insert(0, "conv_id", pdf["conv_id"].array)
            yield frame

    return in_frames(pick(records, conv_id=id_, record=record),
        run, "conv_id long, layout string, formatted string, loss array<struct<start:long,stop:long>>")


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted texts say when read back."""
    def run(frames):
        import pandas as pd

        for pdf in frames:
            out = []
            for text, loss in zip(pdf["formatted"], pdf["loss"]):
                turns = parse(text)
                said = "".join(unescape(text[s["start"]:s["stop"]]) for s in loss)
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                out.append((len(turns), hashlib.sha256(whole.encode("utf-8", "surrogatepass")).hexdigest(), len(said),
                            hashlib.sha256(said.encode("utf-8", "surrogatepass")).hexdigest(), len(text)))
            frame = pd.DataFrame(out, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            frame.insert(0, "conv_id", pdf["conv_id"].array)
            yield frame

    return in_frames(formatted.where("formatted is not null").select("conv_id", "formatted", "loss"),
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
