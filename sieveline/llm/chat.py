r"""Chat formatting: records of any known layout become canonical turns, and turns become one templated text and back.

**Layouts.** A record is a JSON object. Its fingerprint is a hash of the sorted set of its nested field paths (array
elements share the path `[]`; fields that are null don't count). A registry maps fingerprints to declarative mappings:
where the turns lie, or which fields are turns of which role. Unknown fingerprints give no turns and are returned as
such (with a null part), never guessed and never formatted. In paths, a key's own `.`, `[` and `\` are escaped.

**Template.** A turn is `<|turn|>role` newline text `<|end|>`. Inside texts and roles every `<|` becomes `<||`, and
every `<||` (so any run) gets one more bar, so no control string can occur there; reading takes the bar away again. A line
break in a role is written `<|n|>`.
The loss mask covers the texts of assistant turns, without their marks.

Each turn is formatted by itself, so formatting is a map. Reading a conversation back folds over its turns in order,
one turn at a time in memory, as one conversation can hold most of the rows. Ties in the order of turns are broken by
role and text; a null turn comes first, a null role is an empty one, a null text is empty; a null conv_id is a
conversation of its own; repeated rows are repeated turns; an empty table gives an empty result. One conversation is read
by one task, as the digest runs over its turns in order. A lone surrogate in a record becomes the replacement character.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import slices

OPEN, MIDDLE, CLOSE, BREAK = "<|turn|>", "\n", "<|end|>", "<|n|>"
LEARNED = "assistant"
PARSED = re.compile(r"<\|turn\|>([^\n]*)\n(.*?)<\|end\|>", re.DOTALL)

#: Layouts: the paths that a record has, and its turns as (role or path of the role, path of the text). A path with `[]`
#: names a list of turns; a record may lack the paths after `?`.
LAYOUTS: dict[str, dict] = {
    "row": {"paths": ["conv_id", "turn", "role", "text"], "optional": ["conv_id", "turn", "role", "text"], "turns": [("$.role", "$.text")]},
    "messages": {"paths": ["messages[].role", "messages[].content"], "optional": ["id", "messages", "messages[].content"], "list": ("$.messages", "role", "content")},
    "conversations": {"paths": ["conversations[].from", "conversations[].value"], "optional": ["id", "conversations", "conversations[].value"], "list": ("$.conversations", "from", "value")},
    "prompt": {"paths": ["prompt", "response"], "optional": ["id", "system"], "turns": [("=system", "$.system"), ("=user", "$.prompt"), ("=assistant", "$.response")]},
    "completion": {"paths": ["prompt", "completion"], "optional": ["id"], "turns": [("=user", "$.prompt"), ("=assistant", "$.completion")]},
    "instruction": {"paths": ["instruction", "output"], "optional": ["id", "input"], "turns": [("=user", "$.instruction+$.input"), ("=assistant", "$.output")]},
}
#: Other names of roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


def _known() -> dict[str, str]:
    """Fingerprint to layout, for every choice of optional paths."""
    found: dict[str, str] = {}
    for name, layout in LAYOUTS.items():
        optional = layout["optional"]
        needed = [p for p in layout["paths"] if p not in optional]
        for k in range(1 << len(optional)):
            found.setdefault(fingerprint(needed + [p for i, p in enumerate(optional) if k >> i & 1]), name)
    return found


KNOWN = _known()


def json_paths(value: object) -> Iterator[str]:
    """Paths of the fields that hold something; a stack, not recursion, as records can be nested deeply."""
    stack = [("", value)]
    while stack:
        at, value = stack.pop()
        if isinstance(value, dict) and (value or not at):
            for k, v in value.items():
                if v is not None:
                    key = re.sub(r"[.\[\\]", r"\\\g<0>", k)
                    stack.append((f"{at}.{key}" if at else key, v))
        elif isinstance(value, list) and any(x is not None for x in value):
            stack += [(f"{at}[]", x) for x in value if x is not None]
        else:
            yield at + "{}" if isinstance(value, dict) else at


def sound(value: object) -> str:
    """As text that can be encoded."""
    text = str(value)
    try:
        text.encode()
    except UnicodeEncodeError:
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return text


def canonical(record: dict) -> tuple[str | None, list[tuple[str, str]]]:
    """The layout that a record's fingerprint selects (None if none does) and its turns (role, text)."""
    name = KNOWN.get(fingerprint(list(json_paths(record))))
    if name is None:
        return None, []
    layout = LAYOUTS[name]

    def text(path: str) -> str | None:
        parts = [record.get(p[2:]) for p in path.split("+")]
        parts = [str(p) for p in parts if p is not None]
        return "\n".join(parts) if parts else None

    if "list" in layout:
        where, role, content = layout["list"]
        turns = [(x.get(role), x.get(content)) for x in record.get(where[2:]) or [] if x is not None]
    else:
        turns = [(role[1:] if role[0] == "=" else text(role), text(path)) for role, path in layout["turns"]]
        if name != "row":
            turns = [x for x in turns if x[0] != "system" or x[1] is not None]
    named = {} if name == "row" else ROLES
    turns = [(r if isinstance(r, str) or r is None else str(r), t) for r, t in turns]
    return name, [(sound(named.get(r or "", r or "")), sound(t) if t is not None else "") for r, t in turns]


def canonical_turns(records: DataFrame) -> DataFrame:
    """Records (conv_id, turn, record: JSON text) as canonical turns: conv_id, turn, part, layout, role, text.

    A record that is null, isn't a JSON object, is nested too deeply to be read or has an unknown fingerprint gives one row
    with a null layout and a null part, for the caller to look at; so does one of a known layout without turns. `formatted`
    leaves such rows out.
    """
    import json

    names = ["conv_id", "turn", "part", "layout", "role", "text"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[tuple] = []
            for conv, turn, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                try:
                    record = json.loads(text) if text is not None else None
                except (ValueError, RecursionError):
                    record = None
                layout, turns = canonical(record) if isinstance(record, dict) else (None, [])
                out += [(conv, turn, k, layout, r, t) for k, (r, t) in enumerate(turns)] or [(conv, turn, None, layout, None, None)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names)

    return records.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "record").mapInArrow(mapped, "conv_id long, turn long, part int, layout string, role string, text string")


def escape(text: str) -> str:
    return text.replace("<|", "<||")


def unescape(text: str) -> str:
    return text.replace("<||", "<|")


def escaped(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id, turn, part (null: no turn, left out), role, text -> those keys, `formatted` (the templated turn) and its loss span (loss_start, loss_length; null: no loss)."""
    role, body = F.replace(escaped(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit(BREAK)), escaped(F.coalesce("text", F.lit("")))
    learned = F.coalesce("role", F.lit("")) == LEARNED
    return turns.where("part is not null").select(
        "conv_id", "turn", "part", F.concat(F.lit(OPEN), role, F.lit(MIDDLE), body, F.lit(CLOSE)).alias("formatted"),
        F.when(learned, F.length(role) + len(OPEN) + len(MIDDLE)).alias("loss_start"), F.when(learned, F.length(body)).alias("loss_length"),
    )


def parse(text: str) -> list[tuple[str, str]]:
    """The turns (role, text) of templated text. Raises ValueError if anything lies outside turns."""
    turns, at = [], 0
    for m in PARSED.finditer(text):
        if m.start() != at:
            raise ValueError(f"text outside turns at {at}")
        turns.append((unescape(m[1].replace(BREAK, "\n")), unescape(m[2])))
        at = m.end()
    if at != len(text):
        raise ValueError(f"text outside turns at {at}")
    return turns


def read_back(templated: DataFrame) -> DataFrame:
    """Per conversation, from the formatted turns alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, turns, loss_n, loss, chars, done = (), 0, None, 0, None, 0, []

        def flush() -> None:
            if turns is not None:
                done.append((key[0], n, turns.hexdigest(), loss_n, loss.hexdigest(), chars))

        for batch in slices(batches):
            for conv, text, start, size in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (conv,) != key:
                    flush()
                    key, n, turns, loss_n, loss, chars = (conv,), 0, hashlib.sha256(), 0, hashlib.sha256(), 0
                for role, body in parse(text):
                    n += 1
                    turns.update(f"{role}\n{body}\n".encode())
                if start is not None:
                    masked = unescape(text[start : start + size])
                    loss_n += len(masked)
                    loss.update(masked.encode())
                chars += len(text)
            if len(done) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done, strict=True), kinds, strict=True)], names)
                done.clear()
        flush()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done, strict=True), kinds, strict=True)], names)

    dealt = templated.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "part", "formatted")
    return dealt.select("conv_id", "formatted", "loss_start", "loss_length").mapInArrow(folded, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
