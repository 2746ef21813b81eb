"""Facts about the types and methods of a Java source file, from its tokens.

There is no syntax tree. Tokens are matched in brackets once; type declarations are found wherever they stand, so
nested and local ones come out in source order; a walk over statements follows nesting; accesses are read off the
tokens around each dot. Sources that don't balance are reported as having syntax errors, with the facts found so far.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

# What is skipped before a token, and the token: text, character, number, name or operator; nothing at the end.
_TOKEN = re.compile(
    r"""((?:\s+|//[^\n]*|/\*.*?(?:\*/|\Z))*+)(\"\"\".*?\"\"\"|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])+'|\.?\d(?:[eEpP][+-]|[\w.])*
    |[^\W\d][\w$]*|\$[\w$]*|->|::|\+\+|--|&&|\|\||[=!<>+\-*/%&|^]=|\.\.\.|[^\s\w]|\Z)""",
    re.DOTALL | re.VERBOSE,
)
KINDS = ("class", "interface", "enum", "record")
PRIMITIVES = {"int", "long", "short", "byte", "char", "boolean", "float", "double", "void"}
MODIFIERS = {"public", "protected", "private", "static", "final", "abstract", "native", "synchronized", "transient", "volatile", "strictfp", "default", "sealed"}
# Words of the language that aren't names.
KEYWORDS = PRIMITIVES | (MODIFIERS - {"sealed"}) | set("assert break case catch class const continue do else enum extends finally for goto if implements import instanceof interface new package return super switch this throw throws try while true false null".split())
_DELIMITERS = frozenset("{}()[];,")
_BRACKETS = frozenset("()[]{}")
_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_$")
# Tokens that may open a declaration in a body, those before one, and those that count as decisions.
_OPENING, _BEFORE = frozenset(("new", "instanceof", "catch", "(")), frozenset(("{", "}", ";", "(", ":", "->", "final", ")", "@"))
_DECISIONS = frozenset(("if", "for", "while", "catch", "&&", "||", "?", "case", "default"))


@dataclass
class Method:
    name: str
    return_type: str | None
    parameters: list[tuple[str, str]]
    modifiers: list[str]
    start_line: int
    end_line: int
    is_constructor: bool
    cc: int = 1
    nesting: int = 0
    mloc: int = 0
    locals: dict[str, str | None] = field(default_factory=dict)
    names: set[str] = field(default_factory=set)
    this_accesses: set[str] = field(default_factory=set)
    field_accesses: set[tuple[str, str]] = field(default_factory=set)
    qualified_calls: set[tuple[str, str]] = field(default_factory=set)
    calls: set[str] = field(default_factory=set)
    types: set[str] = field(default_factory=set)


@dataclass
class Type:
    name: str
    kind: str
    modifiers: list[str]
    superclass: str | None
    interfaces: list[str]
    start_line: int
    end_line: int
    loc: int = 0
    fields: list[tuple[str, str, list[str], int]] = field(default_factory=list)
    methods: list[Method] = field(default_factory=list)


def effective_loc(lines: list[str]) -> int:
    """Lines that aren't blank, delimiters alone or comments; a block comment that opens within a line isn't entered."""
    n, inside = 0, False
    for line in map(str.strip, lines):
        if inside:
            inside = "*/" not in line
        elif line.startswith("/*"):
            inside = "*/" not in line
        elif not set(line) <= _DELIMITERS and not line.startswith(("//", "*")):
            n += 1
    return n


class _Lines:
    """The line of a token, looked up when it is asked for."""

    def __init__(self, text: str, at: list[int]):
        self.text, self.at, self.starts = text, at, None

    def __getitem__(self, i: int) -> int:
        if self.starts is None:
            self.starts = [0, *(m.end() for m in re.finditer("\n", self.text))]
        return bisect_right(self.starts, self.at[i])


class Source:
    """The tokens of a file, as parallel lists, and the partner of every bracket."""

    def __init__(self, text: str):
        self.text, self.lines = text, text.splitlines()
        self.tok: list[str] = []
        self.at: list[int] = []
        end = 0
        for skipped, t in _TOKEN.findall(text):
            if t:
                end += len(skipped)
                self.at.append(end)
                self.tok.append(t)
                end += len(t)
        self.is_name = [(t[0] in _LETTERS or (t[0] > "\x7f" and t[0].isalnum() and not t[0].isdecimal())) and t not in KEYWORDS for t in self.tok]
        self.n = len(self.tok)
        self.line = _Lines(text, self.at)
        self.partner, self.broken = [-1] * self.n, False
        stack: list[int] = []
        for i, t in enumerate(self.tok):
            if t not in _BRACKETS:
                continue
            if t in ("(", "[", "{"):
                stack.append(i)
            elif stack and self.tok[stack[-1]] + t in ("()", "[]", "{}"):
                self.partner[i] = stack.pop()
                self.partner[self.partner[i]] = i
            else:
                self.broken = True
        self.broken |= bool(stack)

    def __getitem__(self, i: int) -> str:
        return self.tok[i] if 0 <= i < self.n else ""

    def name(self, i: int) -> bool:
        return 0 <= i < self.n and self.is_name[i]

    def close(self, i: int) -> int:
        """The partner of an opening bracket; the end of the file if it has none."""
        return self.partner[i] if self.partner[i] > i else self.n - 1

    def slice(self, i: int, j: int) -> str:
        """Source text of tokens i to j, both included."""
        return self.text[self.at[i] : self.at[j] + len(self.tok[j])] if i <= j < self.n else ""

    def angle(self, i: int) -> int:
        """After the type arguments that open at i, or i if they aren't ones."""
        if self[i] != "<":
            return i
        depth, k = 0, i
        while k < self.n:
            t = self.tok[k]
            if t == "<":
                depth += 1
            elif t == ">":
                depth -= 1
                if not depth:
                    return k + 1
            elif not (self.is_name[k] or t in PRIMITIVES or t in (",", ".", "?", "&", "[", "]", "extends", "super", "@")):
                return i
            k += 1
        return i

    def type_at(self, i: int) -> int:
        """After a type at i (with arguments and array brackets), or i if there is none."""
        k = i
        while self[k] == "@" and self.name(k + 1):
            k += 2
        if self[k] in PRIMITIVES:
            k += 1
        elif self.name(k):
            k = self.angle(k + 1)
            while self[k] == "." and self.name(k + 1):
                k = self.angle(k + 2)
        else:
            return i
        while self[k] == "[" and self[k + 1] == "]":
            k += 2
        return k

    def erased(self, i: int, j: int) -> str:
        """The last name of the type in tokens i to j, without arguments and brackets."""
        name, k = "void", i
        while k < j:
            if self.name(k) or self[k] in PRIMITIVES:
                name = self[k]
            if self[k] == "<":
                after = self.angle(k)
                if after == k:
                    break
                k = after
            else:
                k += 1
        return name

    def names_in(self, i: int, j: int) -> set[str]:
        """All names of types in tokens i to j; of a qualified one, the last."""
        return {self[k] for k in range(i, j) if (self.name(k) or self[k] in PRIMITIVES) and self[k + 1] != "."}

    def declares_type(self, i: int) -> bool:
        t = self[i]
        if t not in KINDS or not self.name(i + 1) or self[i - 1] in (".", "@", "::"):
            return False
        return t != "record" or self[i + 2] in ("(", "<")

    def header_start(self, i: int) -> int:
        """The first token of the modifiers and annotations before i."""
        k = i
        while k > 0:
            if self[k - 1] in MODIFIERS or (self[k - 1] == "-" and self[k - 2] == "non"):
                k -= 1
            elif self[k - 1] == "non":
                k -= 1
            elif self[k - 1] == ")" and self.partner[k - 1] > 0:
                back = self._annotation_start(self.partner[k - 1] - 1)
                if back is None:
                    return k
                k = back
            elif self.name(k - 1):
                back = self._annotation_start(k - 1)
                if back is None:
                    return k
                k = back
            else:
                return k
        return k

    def _annotation_start(self, i: int) -> int | None:
        while self.name(i):
            if self[i - 1] == "@":
                return i - 1
            if self[i - 1] != ".":
                return None
            i -= 2
        return None

    def modifiers(self, i: int, j: int) -> list[str]:
        """Words between tokens i and j but for annotations' names."""
        return sorted({x for x in (self.slice(i, j - 1).split() if j > i else []) if not x.startswith("@")})

    def skip_modifiers(self, i: int) -> int:
        while True:
            t = self[i]
            if t != "@" and t != "non" and t not in MODIFIERS:
                return i
            if self[i] == "@" and self[i + 1] != "interface":
                i += 2
                while self[i] == "." and self.name(i + 1):
                    i += 2
                if self[i] == "(":
                    i = self.close(i) + 1
            elif self[i] in MODIFIERS and not (self[i] == "sealed" and self[i + 1] in ("=", ";", ".")):
                i += 1
            elif self[i] == "non" and self[i + 1] == "-":
                i += 3
            else:
                return i


def scan(text: str) -> tuple[str, list[str], list[Type], int, bool]:
    """Package, imports, types in source order, effective lines, and whether the source has syntax errors."""
    s = Source(text)
    package, imports, types, i = "", [], [], 0
    while i < s.n:
        if s[i] == "package" and not package:
            j = i + 1
            while s[j] not in (";", ""):
                j += 1
            package = "".join(s.tok[i + 1 : j])
            i = j
        elif s[i] == "import":
            j = i + 1
            while s[j] not in (";", ""):
                j += 1
            imports.append("".join(x for x in s.tok[i + 1 : j] if x != "static"))
            i = j
        elif s.declares_type(i):
            types.append(_type(s, i))
        i += 1
    return package, imports, types, effective_loc(s.lines), s.broken


def _end_of_type(s: Source, i: int) -> int:
    while i < s.n and s[i] != "{":
        i += 1
    return s.close(i) if i < s.n else s.n - 1


def _type(s: Source, i: int) -> Type:
    first, kind, name = s.header_start(i), s[i], s[i + 1]
    k = s.angle(i + 2)
    out = Type(name, kind, s.modifiers(first, i), None, [], s.line[first], s.line[i])
    if kind == "record" and s[k] == "(":
        for _, pname, ptype, line in _parameters(s, k):
            out.fields.append((pname, ptype, ["final", "private"], line))
        k = s.close(k) + 1
    while k < s.n and s[k] != "{":
        if s[k] == "extends" and kind == "class":
            out.superclass = s.erased(k + 1, s.type_at(k + 1))
        elif s[k] == "implements":
            while True:
                end = s.type_at(k + 1)
                out.interfaces.append(s.erased(k + 1, end))
                k = max(end, k + 1)
                if s[k] != ",":
                    break
            continue
        k += 1
    if k >= s.n:
        s.broken = True
        return out
    end = s.close(k)
    out.end_line = s.line[end]
    out.loc = effective_loc(s.lines[out.start_line - 1 : out.end_line])
    _members(s, k + 1, end, out)
    return out


def _members(s: Source, i: int, end: int, out: Type) -> None:
    if out.kind == "enum":
        while i < end and s[i] not in (";", "}"):
            i = s.skip_modifiers(i)
            if s.name(i):
                out.fields.append((s[i], out.name, ["final", "public", "static"], s.line[i]))
                i += 1
                for opening in ("(", "{"):
                    if s[i] == opening:
                        i = s.close(i) + 1
            else:
                i += 1
            if s[i] == ",":
                i += 1
    while i < end:
        first = i
        i = s.skip_modifiers(i)
        if s[i] == ";":
            i += 1
            continue
        if s[i] == "{":
            i = s.close(i) + 1
            continue
        if s.declares_type(i) or (s[i] == "@" and s[i + 1] == "interface"):
            i = _end_of_type(s, i) + 1
            continue
        head = i
        i = s.angle(i)
        if s.name(i) and s[i + 1] == "(":
            i = _method(s, first, head, i, i, True, out) + 1
            continue
        if s.name(i) and s[i + 1] == "{":  # a record's compact constructor isn't a method
            i = s.close(i + 1) + 1
            continue
        after = s.type_at(i)
        if after > i and s.name(after) and s[after + 1] == "(":
            i = _method(s, first, head, i, after, False, out) + 1
        elif after > i and s.name(after):
            modifiers = s.modifiers(first, head)
            if out.kind == "interface":
                modifiers = sorted({*modifiers, "public", "static", "final"})
            kind = s.erased(i, after)
            k = after
            while k < end and s.name(k):
                out.fields.append((s[k], kind, modifiers, s.line[k]))
                k = _expression_end(s, k + 1, end)
                if s[k] == ",":
                    k += 1
                else:
                    break
            i = k + 1
        else:
            i = max(i, after) + 1


def _expression_end(s: Source, i: int, end: int) -> int:
    """The next comma or semicolon outside brackets and type arguments."""
    while i < end and s[i] not in (",", ";"):
        if s[i] in ("(", "[", "{"):
            i = s.close(i)
        elif s[i] == "<" and s.angle(i) > i and s.name(i - 1) and s[i - 1][:1].isupper():
            i = s.angle(i) - 1
        i += 1
    return i


def _parameters(s: Source, i: int) -> list[tuple[int, str, str, int]]:
    """Index, name, type and line of the parameters in brackets at i."""
    out, k, end = [], i + 1, s.close(i)
    while k < end:
        k = s.skip_modifiers(k)
        after = s.type_at(k)
        name = after + 1 if s[after] == "..." else after
        if after > k and s.name(name):
            out.append((name, s[name], s.erased(k, after), s.line[k]))
        while k < end and s[k] != ",":
            k = s.close(k) + 1 if s[k] in ("(", "[", "{") else (s.angle(k) if s[k] == "<" and s.angle(k) > k else k + 1)
        k += 1
    return out


def _method(s: Source, first: int, head: int, kind: int, name: int, constructor: bool, out: Type) -> int:
    opening = name + 1
    k = s.close(opening) + 1
    while k < s.n and s[k] not in ("{", ";"):
        k += 1
    end = s.close(k) if s[k] == "{" else min(k, s.n - 1)
    parameters = [(n, t) for _, n, t, _ in _parameters(s, opening)]
    m = Method(s[name], None if constructor else s.erased(kind, name), parameters, s.modifiers(first, head), s.line[first], s.line[end], constructor)
    for n, t in parameters:
        m.locals[n] = t
        m.types.add(t)
    if m.return_type:
        m.types.add(m.return_type)
    m.mloc = effective_loc(s.lines[m.start_line - 1 : m.end_line])
    if s[k] == "{":
        _Body(s, m).read(k, end)
    out.methods.append(m)
    return end


class _Body:
    """Reads a method's body: decisions and accesses token by token, nesting statement by statement."""

    def __init__(self, s: Source, m: Method):
        self.s, self.m = s, m
        self.types: set[int] = set()  # tokens that are names of types
        self.own: list[int] = []

    def read(self, i: int, end: int) -> None:
        s, k = self.s, i
        tok, is_name = s.tok, s.is_name
        while k <= end:  # but for types declared in the body, which are read as types
            if tok[k] in KINDS and s.declares_type(k):
                while self.own and self.own[-1] >= s.header_start(k):
                    self.own.pop()
                k = _end_of_type(s, k)
            else:
                self.own.append(k)
            k += 1
        for k in self.own:
            if tok[k] in _OPENING or tok[k - 1] in _BEFORE:
                self._declaration(k)
        for k in self.own:
            if k not in self.types if is_name[k] else tok[k] in _DECISIONS:
                self._token(k)
        self._block(i, 0)

    def _type(self, i: int, j: int) -> None:
        self.m.types |= self.s.names_in(i, j)
        self.types.update(range(i, j))

    def _declaration(self, k: int) -> None:
        """A local variable, a loop's variable, a catch parameter, or a type in `new`, `instanceof` or a cast."""
        s, before = self.s, self.s[k - 1]
        if s[k] in ("new", "instanceof"):
            at = k + 2 if s[k + 1] == "final" else k + 1
            self._type(at, s.type_at(at))
        elif s[k] == "catch" and s[k + 1] == "(":
            end = s.close(k + 1)
            self._type(k + 2, end - 1)
            self.types -= {x for x in range(k + 2, end - 1) if s[x] in MODIFIERS}
            self.m.types -= MODIFIERS
            self.m.locals.setdefault(s[end - 1], None)
        elif s[k] == "(":
            close = s.close(k)
            after = s[close + 1]
            inner = s.type_at(k + 1)
            if inner == close and inner > k + 1 and not self.s.name(k - 1) and (s.name(close + 1) or after in ("(", "this", "new", "super", "!", "~", "true", "false", "null") or after[:1] in "\"'0123456789" and after):
                if s[k + 1] in PRIMITIVES or s[k + 1][:1].isupper() or s[k + 2] in ("<", "[", "."):
                    self._type(k + 1, close)
        if before in ("{", "}", ";", "(", ":", "->", "final", ")") or before == "@":
            if before == "(" and s[k - 2] not in ("for",):
                return
            if before == ")" and not self._annotated(k - 1):
                return
            at = s.skip_modifiers(k)
            after = s.type_at(at)
            if after > at and s.name(after) and s[after + 1] in ("=", ";", ",", ":", "[") and s[at] not in ("return", "throw", "yield"):
                self._type(at, after)
                kind, loop = s.erased(at, after), s[after + 1] == ":"
                n = after
                while s.name(n):
                    self.m.locals[s[n]] = kind
                    n = _expression_end(s, n + 1, s.n)
                    if loop or s[n] != ",":
                        break
                    n += 1

    def _annotated(self, close: int) -> bool:
        return self.s.partner[close] > 0 and self.s._annotation_start(self.s.partner[close] - 1) is not None

    def _token(self, k: int) -> None:
        s, m, t = self.s, self.m, self.s[k]
        if t in ("if", "for", "while", "catch", "&&", "||"):  # the `while` of a `do` counts for it
            m.cc += 1
        elif t == "?":
            m.cc += not (s[k - 1] in ("<", ",") and s[k + 1] in (">", "extends", "super", ","))
        elif t in ("case", "default") and s[k - 1] not in (".", "@"):
            j = k + 1
            while j < s.n and s[j] not in (":", "->", ";", "{"):
                j = s.close(j) + 1 if s[j] in ("(", "[") else j + 1
            if s[j] in (":", "->"):
                m.cc += (t == "case") + (s[j] == "->")
        elif s.name(k) and k not in self.types:
            m.names.add(t)
            if s[k - 1] == "@":
                return
            called = s[k + 1] == "("
            if s[k - 1] == "." and (start := self._receiver(k - 2)) is not None:
                receiver = s.slice(start, k - 2)
                if receiver == "this":
                    (m.calls if called else m.this_accesses).add(t)
                else:
                    (m.qualified_calls if called else m.field_accesses).add((receiver, t))
            elif called and s[k - 1] not in ("new", ".", "::"):
                m.calls.add(t)

    def _receiver(self, k: int) -> int | None:
        """The first token of the expression that ends at k."""
        s = self.s
        while True:
            while s[k] in (")", "]"):
                if (k := s.partner[k] - 1) < 0:
                    return None
                if not (s.name(k) or s[k] in (")", "]", "this", "super")):
                    return k + 1
            if k in self.types:
                while k in self.types:
                    k -= 1
                return k if s[k] == "new" else k + 1
            if not (s.name(k) or s[k] in ("this", "super", "class") or s[k][:1] in "\"'0123456789"):
                return None
            if s[k - 1] != ".":
                return k - 1 if s[k - 1] == "new" else k
            k -= 2

    # Nesting: each of these returns the token after what it read.

    def _deeper(self, depth: int) -> int:
        self.m.nesting = max(self.m.nesting, depth + 1)
        return depth + 1

    def _block(self, i: int, depth: int) -> int:
        end, k = self.s.close(i), i + 1
        while k < end:
            k = max(self._statement(k, depth, end), k + 1)
        return end + 1

    def _brackets(self, i: int, depth: int) -> int:
        if self.s[i] != "(":
            return i
        end = self.s.close(i)
        self._expression(i + 1, depth, end)
        return end + 1

    def _statement(self, i: int, depth: int, end: int) -> int:
        s, t = self.s, self.s[i]
        if t == "{":
            return self._block(i, depth)
        if t == "if":
            inner = self._deeper(depth)
            k = self._statement(self._brackets(i + 1, inner), inner, end)
            if s[k] == "else":
                k = self._statement(k + 1, depth if s[k + 1] == "if" else inner, end)
            return k
        if t in ("for", "while"):
            inner = self._deeper(depth)
            return self._statement(self._brackets(i + 1, inner), inner, end)
        if t == "do":
            inner = self._deeper(depth)
            k = self._statement(i + 1, inner, end)
            return self._brackets(k + 1, inner) + 1
        if t == "switch":
            return self._switch(i, depth)
        if t == "try":
            inner = self._deeper(depth)
            k = self._block_at(self._brackets(i + 1, inner), inner)
            while s[k] in ("catch", "finally"):
                k = self._block_at(self._brackets(k + 1, inner), inner)
            return k
        if t == "synchronized" and s[i + 1] == "(":
            inner = self._deeper(depth)
            return self._block_at(self._brackets(i + 1, inner), inner)
        if s.name(i) and s[i + 1] == ":" and s[i - 1] in ("{", "}", ";"):
            return self._statement(i + 2, depth, end)
        at = s.skip_modifiers(i)
        if s.declares_type(at):
            return _end_of_type(s, at) + 1
        return self._expression(i, depth, end) + 1

    def _block_at(self, i: int, depth: int) -> int:
        return self._block(i, depth) if self.s[i] == "{" else i

    def _switch(self, i: int, depth: int) -> int:
        inner = self._deeper(depth)
        k = self._brackets(i + 1, inner)
        if self.s[k] != "{":
            return k
        end, j = self.s.close(k), k + 1
        while j < end:
            if self.s[j] in ("case", "default"):
                while j < end and self.s[j] not in (":", "->"):
                    j = self.s.close(j) + 1 if self.s[j] in ("(", "[") else j + 1
                j += 1
            else:
                j = max(self._statement(j, inner, end), j + 1)
        return end + 1

    def _expression(self, i: int, depth: int, end: int) -> int:
        """Up to a semicolon or the end; bodies of lambdas and anonymous classes are read at this depth."""
        s, tok = self.s, self.s.tok
        while i < end and (t := tok[i]) != ";":
            if t == "switch":
                i = self._switch(i, depth)
            elif t in ("(", "["):
                self._expression_all(i + 1, depth, s.close(i))
                i = s.close(i) + 1
            elif t == "{":
                if s[i - 1] == "->":
                    i = self._block(i, depth)
                elif s[i - 1] == ")":
                    self._anonymous(i + 1, depth, s.close(i))
                    i = s.close(i) + 1
                else:
                    self._expression_all(i + 1, depth, s.close(i))
                    i = s.close(i) + 1
            else:
                i += 1
        return i

    def _expression_all(self, i: int, depth: int, end: int) -> None:
        while i < end:
            i = self._expression(i, depth, end) + 1

    def _anonymous(self, i: int, depth: int, end: int) -> None:
        s = self.s
        while i < end:
            i = s.skip_modifiers(i)
            if s.declares_type(i):
                i = _end_of_type(s, i) + 1
                continue
            while i < end and s[i] not in ("{", ";", "="):
                i = s.close(i) + 1 if s[i] == "(" else i + 1
            if s[i] == "=":
                i = self._expression(i + 1, depth, end) + 1
            elif s[i] == "{":
                i = self._block(i, depth)
            else:
                i += 1
