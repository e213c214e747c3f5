"""Chat formatting by schema fingerprints.

A record (a JSON text) is reduced to the sorted set of its nested field paths, list places written as `[]`. The hash of that set selects a declarative
mapping from a registry, which says where the turns, roles and texts are. Where the whole set is unknown, the paths that a mapping uses are taken alone, so fields
beside a known layout don't matter; the layout counts if it is the only one that fits and nothing is nested in its roles and texts. An empty list of turns fits.
Mapped records become canonical turns; other records stay as they are, with their fingerprint (`unmapped`), so that a mapping can be added.

Turns are written in a marked template. Inside texts and roles every `<`, any number of backslashes and `|` in a row gets one backslash more, which reading takes
away again, so no text can close its turn. A line break in a role is written as a backslash and n. The loss covers the texts of assistant turns.

A formatted conversation is stored as one segment per turn: whoever concatenates the segments by `turn` has the document. So no conversation, however long, has to
fit into one row.

Edge cases: null texts and roles are empty; turns of one number follow the order of their roles and texts; null ids are one conversation. An empty table gives
an empty result; other columns are ignored. Records that aren't JSON objects have no paths and no mapping.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns: a list at `items` with fields `role` and `text`, or `fields`: (role, field or fields joined by empty lines) of one record each."""

    name: str
    items: str | None = None
    role: str | None = None
    text: str | None = None
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()


#: Layouts by their paths; optional fields are other sets of paths with the same mapping.
LAYOUTS: dict[tuple[str, ...], Mapping] = {}


def layout(mapping: Mapping, *paths: tuple[str, ...]) -> None:
    for p in paths:
        LAYOUTS[tuple(sorted(p))] = mapping


layout(Mapping("turn row", role="role", text="text"), ("role", "text"))
layout(Mapping("messages", items="messages", role="role", text="content"), ("messages", "messages[].content", "messages[].role"))
layout(Mapping("from and value", items="conversations", role="from", text="value"), ("conversations", "conversations[].from", "conversations[].value"))
layout(Mapping("prompt and response", fields=(("user", ("prompt",)), ("assistant", ("response",)))), ("prompt", "response"))
layout(Mapping("prompt and completion", fields=(("user", ("prompt",)), ("assistant", ("completion",)))), ("completion", "prompt"))
layout(Mapping("question and answer", fields=(("user", ("question",)), ("assistant", ("answer",)))), ("answer", "question"))
layout(Mapping("instruction", fields=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
       ("instruction", "output"), ("input", "instruction", "output"), ("instruction", "output", "system"), ("input", "instruction", "output", "system"))


def field_paths(value, at: str = "") -> Iterator[str]:
    """Nested field paths of a decoded record."""
    if isinstance(value, dict):
        for key, inner in value.items():
            path = f"{at}.{key}" if at else str(key)
            yield path
            yield from field_paths(inner, path)
    elif isinstance(value, list):
        for inner in value:
            yield from field_paths(inner, at + "[]")


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


def registry() -> dict[str, Mapping]:
    return {fingerprint(paths): mapping for paths, mapping in LAYOUTS.items()}


def used_paths(mapping: Mapping) -> tuple[set[str], set[str]]:
    """The paths that a mapping uses, and those of them that hold roles and texts."""
    if mapping.fields:
        leaves = {f for _, fields in mapping.fields for f in fields}
    else:
        leaves = {f"{mapping.items}[].{x}" if mapping.items else x for x in (mapping.role, mapping.text)}
    return leaves | ({mapping.items} if mapping.items else set()), leaves


def find(value, paths: set[str], known: dict[str, Mapping]) -> Mapping | None:
    """The mapping of a record with these paths."""
    mapping = known.get(fingerprint(paths))
    fits = [mapping] if mapping else []
    for m in () if mapping else dict.fromkeys(known.values()):
        used, leaves = used_paths(m)
        here = leaves | {m.items} if m.items and isinstance(value, dict) and value.get(m.items) == [] else used & paths
        nested = any(p.startswith((f"{x}.", f"{x}[")) for p in paths for x in leaves)
        if not nested and known.get(fingerprint(here)) == m:
            fits.append(m)
    if len(fits) != 1 or fits[0].items and not (isinstance(x := value.get(fits[0].items), list) and all(isinstance(i, dict) for i in x)):
        return None
    return fits[0]


def _string(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def canonical(record: dict, mapping: Mapping) -> list[tuple[str, str]]:
    """(role, text) of the record's turns."""
    if mapping.fields:
        turns = [(role, "\n\n".join(x for f in fields if (x := _string(record.get(f))))) for role, fields in mapping.fields if any(f in record for f in fields)]
        return turns
    items = record.get(mapping.items) or [] if mapping.items else [record]
    return [(ROLES.get(r := _string(x.get(mapping.role)), r), _string(x.get(mapping.text))) for x in items]


def turns(records: DataFrame, mappings: dict[str, Mapping] | None = None) -> DataFrame:
    """`conv_id`, `turn`, `part`, `schema`, `layout`, `role`, `text`, `record` of records (`conv_id`, `turn`, `record`). A record that
    no mapping fits is one row with the record, without layout, role and text; one without turns is one row with its layout, without role and text."""
    known = registry() if mappings is None else mappings

    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("conv_id", "turn", "part", "schema", "layout", "role", "text", "record")}
            for conv, turn, record in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "record"))):
                try:
                    value = json.loads(record or "")
                except ValueError:
                    value = None
                paths = set(field_paths(value))
                schema, mapping = fingerprint(paths), find(value, paths, known)
                for part, (role, text) in enumerate(mapping and canonical(value, mapping) or [(None, None)]):
                    for key, x in zip(out, (conv, turn, part, schema, mapping and mapping.name, role, text, None if mapping else record)):
                        out[key].append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out["conv_id"], pa.int64()), pa.array(out["turn"], pa.int64()), pa.array(out["part"], pa.int32()),
                                              *(pa.array(out[c], pa.string()) for c in ("schema", "layout", "role", "text", "record"))], list(out))

    wanted = records.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("record").cast("string").alias("record"))
    return wanted.mapInArrow(run, "conv_id long, turn long, part int, schema string, layout string, role string, text string, record string")


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(\\|n)", lambda m: "\n" if m[1] == "n" else "\\", unescape(role))


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The marked turn and the bounds of the text in it that the loss covers (equal bounds: none)."""
    head, body = f"{START}{escape_role(role)}\n", escape(text)
    end = len(head) + len(body)
    return f"{head}{body}{END}\n", len(head) if role == "assistant" else end, end


_TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + r"\n", re.S)


def parse(document: str) -> list[tuple[str, str]]:
    """The turns of a formatted document."""
    out, at = [], 0
    while at < len(document):
        m = _TURN.match(document, at)
        if not m:
            raise ValueError("not a formatted conversation")
        out.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    return out


def formatted(canonical_turns: DataFrame) -> DataFrame:
    """`conv_id`, `turn`, `part`, `segment`, `loss_start`, `loss_end` (code points in the segment) of every mapped turn."""

    def run(batches):
        for batch in batches:
            made = [format_turn(r or "", t or "") for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), batch.column("part"), pa.array([m[0] for m in made], pa.string()),
                                              pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64())],
                                             ["conv_id", "turn", "part", "segment", "loss_start", "loss_end"])

    mapped = canonical_turns.where("layout is not null and role is not null").select("conv_id", "turn", "part", "role", "text")
    return mapped.mapInArrow(run, "conv_id long, turn long, part int, segment string, loss_start long, loss_end long")


def unmapped(canonical_turns: DataFrame) -> DataFrame:
    """`conv_id`, `turn`, `schema`, `record` of every record that no mapping fits."""
    return canonical_turns.where("layout is null").select("conv_id", "turn", "schema", "record")


def digests(segments: DataFrame) -> DataFrame:
    """Per conversation, read from its segments: `n_turns`, `turns_sha256`, `loss_chars`, `loss_sha256`, `formatted_chars`.

    Segments stream by in order, so a task holds one batch and the running digests only.
    """

    def run(batches):
        key, state, out = None, None, []

        def close():
            n, all_, chars, loss, length = state
            return {"conv_id": key, "n_turns": n, "turns_sha256": all_.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": length}

        for batch in batches:
            for conv, segment, start, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "loss_start", "loss_end"))):
                if state is None or conv != key:
                    if state is not None:
                        out.append(close())
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(segment):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                masked = unescape(segment[start:end])
                state[2] += len(masked)
                state[3].update(masked.encode())
                state[4] += len(segment)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if state is not None:
            yield pa.RecordBatch.from_pylist([close()], schema=schema)

    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "part", "segment")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def turn_records(conversations: DataFrame) -> DataFrame:
    """Rows of a turn table as records, one JSON object a turn."""
    record = F.to_json(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))
    return conversations.select("conv_id", "turn", record.alias("record"))
