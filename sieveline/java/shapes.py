"""Values scanned from Java files, each shape of a file scanned once.

Two files have the same shape if one becomes the other by renaming identifiers one to one, with capitals kept at their
start and the words that the scanner knows left as they are. The scanner only asks whether two names are equal, start
with a capital or are one of those words, so what it says of one file holds for the other, renamed. A file is written
with marks for its names; if that text was scanned before, its names are filled into what was found. Every file is read
whole, and a shape not held is scanned. Generated sources, copies and renamed copies gain; others pay for the marking.
"""

from __future__ import annotations

import re
from array import array
from functools import cache
from hashlib import blake2b
from itertools import accumulate, chain
from typing import Any

import pyarrow as pa

from sieveline.java.scanner import KEYWORDS, KINDS, MODIFIERS, scan

#: Numbers and names as the scanner cuts them. Strings and comments need no care: no name or number crosses their ends.
_WORD = re.compile(r"([a-zA-Z_$][\w$]*|\.?\d(?:[eEpP][+-]|[\w.])*|[^\W\d][\w$]*)")
#: Marks: letters of other scripts, without a capital and with one, then a number and the first letter again.
_LOWER, _UPPER = "ꙮ", "Ꙗ"
_LETTER = re.compile(f"[{_LOWER}{_UPPER}]")
_MARK = re.compile(f"[{_LOWER}{_UPPER}](\\d+){_LOWER}")
_WORDS = frozenset(KEYWORDS | MODIFIERS | set(KINDS) | {"non", "yield", "permits", "when", "var"})
#: Nodes of the shapes that are held, in either of two generations: at some 200 bytes each, 60 MB; and lines held.
HELD, LINES = 300_000, 20_000
_CONSTANT, _NAME, _TEXT, _STRUCT, _LIST, _SORTED = range(6)
_AT = {"name": 0, "type_name": 1, "receiver": 0, "member": 1, "modifiers": 2, "line": 3}


def _cut(line: str) -> tuple[str, list[str]]:
    """A line with the letters of marks for its names, and these. No number or name crosses a line's end."""
    parts, names = _WORD.split(line), []
    for k in range(1, len(parts), 2):
        word = parts[k]
        if word not in _WORDS and (first := word[0]) not in ".$" and not first.isdecimal():
            names.append(word)
            parts[k] = _UPPER if first.isupper() else _LOWER
    return "".join(parts), names


def _member(value: Any, name: str) -> Any:
    if isinstance(value, dict):
        return value[name]
    if isinstance(value, tuple):
        return value[_AT[name]]
    if name == "declared_locals":
        return set(value.locals)
    if name == "local_types":
        return {k: v for k, v in value.locals.items() if v is not None}
    return getattr(value, name)


class Shapes:
    """Values of files in the columns of an Arrow struct: tuples for structs, pairs for maps; sets are sorted."""

    def __init__(self, kind: pa.DataType, held: int = HELD):
        self.kind, self.held = kind, held
        self.young: dict[bytes, tuple] = {}
        self.old: dict[bytes, tuple] = {}
        self.same: dict[tuple, tuple] = {}
        self.lines: dict[str, tuple[str, list[str]]] = {}
        self.scanned = 0

    def values(self, text: str) -> tuple:
        if _LOWER in text or _UPPER in text:
            return self._filled(self._template(self.kind, self._scan(text), False), [])
        shape, every = self._cut(text)
        names = list(dict.fromkeys(every))  # by their first places
        order = array("I", map(dict(zip(names, range(len(names)), strict=True)).__getitem__, every))
        key = blake2b(shape.encode("utf-8", "surrogatepass"), digest_size=16)
        key.update(order)
        key = key.digest()
        template = self.young.get(key)
        if template is None:
            template = self.old.get(key)
            if template is None:
                number = iter(order)
                template = self._template(self.kind, self._scan(_LETTER.sub(lambda m: f"{m[0]}{next(number)}{_LOWER}", shape)), True)
            if len(self.young) + len(self.same) > self.held:
                self.old, self.young, self.same = self.young, {}, {}
            self.young[key] = template
        return self._filled(template, names)

    def _cut(self, text: str) -> tuple[str, list[str]]:
        """The text with the letters of marks for names, and all names in order."""
        shapes, every, held = [], [], self.lines
        for line in text.split("\n"):
            cut = held.get(line)
            if cut is None:
                if len(held) > LINES:
                    held.clear()
                cut = held[line] = _cut(line)
            shapes.append(cut[0])
            every += cut[1]
        return "\n".join(shapes), every

    def _scan(self, text: str) -> dict:
        self.scanned += 1
        return dict(zip(("package", "imports", "types", "effective_loc", "has_syntax_errors"), scan(text), strict=True))

    def _template(self, kind: pa.DataType, value: Any, marks: bool, ordered: bool = False) -> tuple:
        """Nested nodes; those equal to one made before are that one. Sets, and lists that are `ordered` by name, are sorted once filled."""
        if pa.types.is_struct(kind):
            node = (_STRUCT, tuple(self._template(f.type, _member(value, f.name), marks, f.name == "modifiers") for f in kind))
        elif pa.types.is_map(kind):
            pairs = [(_STRUCT, (self._template(kind.key_type, k, marks), self._template(kind.item_type, v, marks))) for k, v in value.items()]
            node = (_LIST, tuple(self._constant(x) for x in pairs))
        elif pa.types.is_list(kind):
            node = (_SORTED if ordered or isinstance(value, set) else _LIST, tuple(self._template(kind.value_type, x, marks) for x in value))
        elif marks and isinstance(value, str) and _LOWER in value:
            parts = _MARK.split(value)
            parts[1::2] = map(int, parts[1::2])
            parts = tuple(x for x in parts if x != "")
            node = (_NAME, parts[0]) if len(parts) == 1 else (_TEXT, parts)
        else:
            node = (_CONSTANT, value)
        node = self._constant(node)
        return self.same.setdefault((kind, node), node)

    def _constant(self, node: tuple) -> tuple:
        if node[0] < _STRUCT or any(x[0] != _CONSTANT for x in node[1]):
            return node
        return (_CONSTANT, self._filled(node, []))

    def _filled(self, node: tuple, names: list[str]) -> Any:
        kind, of = node
        if kind == _CONSTANT:
            return of
        if kind == _NAME:
            return names[of]
        if kind == _TEXT:
            return "".join([names[x] if type(x) is int else x for x in of])
        filled = self._filled
        values = tuple([filled(x, names) for x in of])
        return tuple(sorted(values)) if kind == _SORTED else values


@cache
def shapes_of(kind: pa.DataType) -> Shapes:
    """Those of this process, for files of all tasks."""
    return Shapes(kind)


def column(kind: pa.DataType, values: list) -> pa.Array:
    """An Arrow array of such values, made by columns."""
    if pa.types.is_struct(kind):
        columns = list(zip(*values, strict=True)) if values else [()] * kind.num_fields
        return pa.StructArray.from_arrays([column(f.type, list(c)) for f, c in zip(kind, columns, strict=True)], fields=list(kind))
    if pa.types.is_list(kind) or pa.types.is_map(kind):
        offsets, flat = pa.array(accumulate(map(len, values), initial=0), pa.int32()), list(chain.from_iterable(values))
        if pa.types.is_list(kind):
            return pa.ListArray.from_arrays(offsets, column(kind.value_type, flat), type=kind)
        return pa.MapArray.from_arrays(offsets, pa.array([k for k, _ in flat], kind.key_type), pa.array([v for _, v in flat], kind.item_type), type=kind)
    return pa.array(values, kind)
