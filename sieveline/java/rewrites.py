"""Rewrites of Java sources as edits of byte ranges: their algebra, guard clauses, plans per file, and verdicts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, count

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.java.scanner import PRIMITIVES, Method, Source, _Body, _expression_end, _parameters

Edit = tuple[int, int, str]
GUARD = "ReplaceNestedConditionalWithGuardClauses"


def overlap(a: Edit, b: Edit) -> bool:
    """Whether two edits claim a character in common; two insertions do at the same offset."""
    if a[0] == a[1] and b[0] == b[1]:
        return a[0] == b[0]
    return a[0] < b[1] and b[0] < a[1]


def applied(text: str, edits: list[Edit]) -> str:
    """All edits at once; they must lie in the text and not overlap."""
    out, at = [], 0
    ordered = sorted(edits)
    for before, after in zip(ordered, ordered[1:], strict=False):
        if overlap(before, after):
            raise ValueError(f"edits overlap: {before[:2]} and {after[:2]}")
    for start, end, new in ordered:
        if not 0 <= start <= end <= len(text):
            raise ValueError(f"edit outside the text: {(start, end)}")
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]])


def indent(text: str, at: int) -> str:
    """The white space that the line of an offset begins with."""
    start = text.rfind("\n", 0, at) + 1
    return re.match(r"[ \t]*", text[start:])[0]


def located(s: Source, name: str, line: int) -> int | None:
    """The token of a method's name, declared from this line on; None if it isn't there or the source is broken."""
    if s.broken:
        return None
    return next((i for i in range(s.n) if s.name(i) and s[i] == name and s[i + 1] == "(" and s[i - 1] not in (".", "new") and s.line[s.header_start(i - 1)] <= line <= s.line[i]), None)


def fresh(name: str, taken: set[str]) -> str:
    """The name, or the first of name2, name3 and so on, that isn't taken."""
    return next(x for x in chain([name], (f"{name}{n}" for n in count(2))) if x not in taken)


def guard_clause(text: str, name: str, line: int) -> tuple[list[Edit], str | None]:
    """A void method whose whole body is one `if` without `else` returns early instead. Edits, or why there are none.

    The condition isn't inverted but wrapped in `!(...)`, which is right for every expression.
    """
    s = Source(text)
    if (at := located(s, name, line)) is None:
        return [], "not_located"
    if s[at - 1] != "void":
        return [], "needs_void"
    k = s.close(at + 1) + 1
    while k < s.n and s[k] not in ("{", ";"):
        k += 1
    if s[k] != "{":
        return [], "no_body"
    end, first = s.close(k), k + 1
    if s[first] != "if" or s[first + 1] != "(":
        return [], "not_single_conditional"
    branch = s.close(first + 1) + 1
    if s[branch] != "{":
        return [], "branch_not_block" if branch < end else "not_single_conditional"
    close = s.close(branch)
    if s[close + 1] == "else":
        return [], "has_else"
    if close + 1 != end:
        return [], "not_single_conditional"
    if branch + 1 == close:
        return [], "branch_empty"
    outer, inner = indent(text, s.at[first]), indent(text, s.at[branch + 1])
    if not inner.startswith(outer) or inner == outer:
        return [], "irregular_indent"
    unit = inner[len(outer) :]
    lifted = "\n".join(x.removeprefix(unit) for x in s.slice(branch + 1, close - 1).split("\n"))
    new = f"if (!{s.slice(first + 1, branch - 1)}) {{\n{inner}return;\n{outer}}}\n{outer}{lifted}"
    return [(s.at[first], s.at[close] + 1, new)], None


#: Lines of the smallest block that is worth a method, and the new method's name.
LEAST_LINES, EXTRACTED = 5, "extracted"
_COMPOUND = ("if", "for", "while", "do", "try", "switch", "synchronized", "{")
_ASSIGNING = ("=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "++", "--")


def _declared(s: Source, i: int, j: int) -> dict[str, tuple[str, bool]]:
    """Local variables declared by the tokens from i to before j: name -> type as written, and whether it is given a value."""
    found = {}
    for k in range(i, j):
        if not (s[k - 1] in ("{", "}", ";", "final", ")", ":", "->") or (s[k - 1] == "(" and s[k - 2] in ("for", "try", "catch"))):
            continue
        at = s.skip_modifiers(k)
        after = s.type_at(at)
        while after > at and s.name(after) and s[after + 1] in ("=", ";", ",", ":", ")"):
            found.setdefault(s[after], (s.slice(at, s.type_at(at) - 1), s[after + 1] != ";" and s[after + 1] != ","))
            after = _expression_end(s, after + 1, j)
            if s[after] != ",":
                break
            after += 1
    return found


def _used(s: Source, i: int, j: int) -> set[str]:
    return {s[k] for k in range(i, j) if s.name(k) and s[k - 1] != "." and s[k + 1] != "("}


def _assigned(s: Source, i: int, j: int) -> set[str]:
    """Names that tokens i to j give a value to. The scanner parts `>>=` into tokens whose last is an assignment too."""
    return {s[k] for k in range(i, j) if s.name(k) and s[k - 1] != "." and (s[k + 1] in _ASSIGNING or s[k - 1] in ("++", "--") or (s[k + 1] in ("<", ">") and s[k + 2] in (">", "<=", ">=")))}


def _escapes(s: Source, i: int, j: int) -> bool:
    """Whether control leaves the block in tokens i to j other than by its end: a return or yield, or a break or continue of something outside."""
    for k in range(i, j):
        if s[k] in ("return", "yield") and s[k - 1] in ("{", "}", ";", ")", "else", ":", "->"):
            return True
        if s[k] in ("break", "continue"):
            if s[k + 1] != ";":
                return True
            inside = False
            for opener in range(i, k):  # is there a loop (or, for break, a switch) of the block around it?
                if s[opener] in ("for", "while", "do") or (s[opener] == "switch" and s[k] == "break"):
                    head = s.close(opener + 1) + 1 if s[opener + 1] == "(" else opener + 1
                    inside |= s[head] == "{" and head < k < s.close(head)
            if not inside:
                return True
    return False


def extract_method(text: str, name: str, line: int, reserved: frozenset[str] = frozenset()) -> tuple[list[Edit], str | None]:
    """The largest compound statement at the top of a method's body becomes a private method. Edits, or why there are none.

    Its inputs are the locals that it uses and that certainly have a value by then; at most one local that it assigns may
    be used after it, and is returned.
    """
    s = Source(text)
    if (at := located(s, name, line)) is None:
        return [], "not_located"
    k = s.close(at + 1) + 1
    throws = k
    while k < s.n and s[k] not in ("{", ";"):
        k += 1
    if s[k] != "{":
        return [], "no_body"
    head, end = at, s.close(k)
    while head and s[head - 1] not in ("{", "}", ";"):
        head -= 1
    if s[s.skip_modifiers(head)] == "<":
        return [], "type_parameters"
    body, spans, i = _Body(s, Method("", None, [], [], 0, 0, False)), [], k + 1
    while i < end:
        after = max(body._statement(i, 0, end), i + 1)
        spans.append((i, min(after, end)))
        i = after
    big = [(s.line[b - 1] - s.line[a] + 1, -a, a, b) for a, b in spans if s[a] in _COMPOUND and s.line[b - 1] - s.line[a] + 1 >= LEAST_LINES]
    if not big:
        return [], "no_block"
    *_, a, b = max(big)
    if _escapes(s, a, b):
        return [], "escaping_control_flow"
    parameters = {n: (s.slice(start, x - 1), True) for start, x, n in _parameter_names(s, at + 1)}
    before = parameters | _declared(s, k + 1, a)
    certain = set(parameters) | {n for x, y in spans if y <= a for n, (_, given) in _declared(s, x, y).items() if given and s[x] not in _COMPOUND} | {s[x] for x, y in spans if y <= a and s.name(x) and s[x + 1] == "="}
    inputs = sorted(_used(s, a, b) & before.keys())
    outputs = sorted(_assigned(s, a, b) & before.keys() & _used(s, b, end))
    if len(outputs) > 1:
        return [], "several_outputs"
    if any(n not in certain for n in inputs):
        return [], "not_surely_assigned"
    if any(before[n][0] == "var" or "..." in before[n][0] for n in inputs):
        return [], "unknown_type"
    taken = {s[x] for x in range(s.n) if s.name(x)} | reserved
    new = fresh(EXTRACTED, taken)
    outer = indent(text, s.at[head])
    unit = indent(text, s.at[a]).removeprefix(outer) or "    "
    out = outputs[0] if outputs else None
    call = f"{out + ' = ' if out else ''}{new}({', '.join(inputs)});"
    kind = "static " if "static" in s.tok[head:at] else ""
    tail = f"{outer}{unit}return {out};\n" if out else ""
    thrown = f" {s.slice(throws, k - 1)}" if throws < k else ""
    made = f"\n\n{outer}private {kind}{before[out][0] if out else 'void'} {new}({', '.join(f'{before[n][0]} {n}' for n in inputs)}){thrown} {{\n{outer}{unit}{s.slice(a, b - 1)}\n{tail}{outer}}}"
    return [(s.at[a], s.at[b - 1] + len(s[b - 1]), call), (s.at[end] + 1, s.at[end] + 1, made)], None


def _parameter_names(s: Source, i: int) -> list[tuple[int, int, str]]:
    """First token of the type, token of the name, and name of each parameter."""
    out, start = [], i + 1
    for x, n, _, _ in _parameters(s, i):
        out.append((s.skip_modifiers(start), x, n))
        start = x + 1
        while s[start] in ("[", "]"):
            start += 1
        start += s[start] == ","
    return out


def parameter_object(text: str, name: str, line: int, reserved: frozenset[str] = frozenset()) -> tuple[list[Edit], str | None]:
    """A private method's parameters become one record: its signature, its body and all its calls change. Edits, or why there are none.

    Every use must be seen, so the method must be private, of a class that isn't nested, and without overloads.
    """
    s = Source(text)
    if (at := located(s, name, line)) is None:
        return [], "not_located"
    head = at
    while head and s[head - 1] not in ("{", "}", ";"):
        head -= 1
    if "private" not in s.tok[head:at]:
        return [], "not_private"
    if s[s.skip_modifiers(head)] == "<":
        return [], "type_parameters"
    around = [k for k in range(s.n) if s[k] == "{" and k < head < s.close(k)]
    if len(around) != 1:
        return [], "nested_class"
    parameters = _parameter_names(s, at + 1)
    if len(parameters) < 2:
        return [], "too_few_parameters"
    kinds = {n: s.slice(start, x - 1) for start, x, n in parameters}
    if any("..." in k for k in kinds.values()):
        return [], "varargs"
    uses = [k for k in range(s.n) if s[k] == name and s.name(k) and k != at]
    if any(s[k + 1] == "(" and (s.name(k - 1) or s[k - 1] in PRIMITIVES or s[k - 1] == "]" or s[s.close(k + 1) + 1] in ("{", "throws")) for k in uses):
        return [], "overloaded"
    if any(s[k + 1] != "(" or (s[k - 1] == "." and s[k - 2] != "this") for k in uses):
        return [], "unresolved_reference"
    body = s.close(at + 1) + 1
    while body < s.n and s[body] not in ("{", ";"):
        body += 1
    if s[body] != "{":
        return [], "no_body"
    end = s.close(body)
    if _assigned(s, body, end) & kinds.keys():
        return [], "parameter_assigned"
    named = [k for k in range(body, end) if s[k] in kinds and s.name(k) and s[k - 1] != "." and s[k + 1] != "("]
    shadowed = _declared(s, body, end).keys() | {s[k] for k in named if s[k + 1] == "->" or (s[k - 1] in ("(", ",") and s[k + 1] in (",", ")") and s[s.close(next((o for o in range(k, body, -1) if s[o] == "(" and s.close(o) > k), k)) + 1] == "->")}
    if shadowed & kinds.keys():
        return [], "shadowed"
    taken = {s[k] for k in range(s.n) if s.name(k)} | reserved
    base = name[:1].upper() + name[1:] + "Parameters"
    record = fresh(base, taken)
    held = fresh("parameters", taken)
    edits: list[Edit] = [(s.at[at + 1], s.at[s.close(at + 1)] + 1, f"({record} {held})")]
    edits += [(s.at[k], s.at[k] + len(s[k]), f"{held}.{s[k]}()") for k in named]
    for k in uses:
        opening, close = k + 1, s.close(k + 1)
        if any(k2 in uses for k2 in range(opening, close)):
            return [], "nested_call"
        inside = [(a - s.at[opening] - 1, b - s.at[opening] - 1, new) for a, b, new in edits if s.at[opening] < a < s.at[close]]
        arguments = applied(text[s.at[opening] + 1 : s.at[close]], inside)
        edits = [e for e in edits if not s.at[opening] < e[0] < s.at[close]] + [(s.at[opening], s.at[close] + 1, f"(new {record}({arguments}))")]
    outer = indent(text, s.at[head])
    edits.append((s.at[head], s.at[head], f"private record {record}({', '.join(f'{k} {n}' for n, k in kinds.items())}) {{}}\n\n{outer}"))
    return sorted(edits), None


REWRITES = {"DeepNesting": guard_clause, "LongMethod": extract_method, "BrainMethod": extract_method, "LongParameterList": parameter_object}


def planned(sites: DataFrame, files: DataFrame) -> DataFrame:
    """Sites (file, line, smell_type, method) over files (file, text): refusals, and each file's text with its edits applied.

    Sites of a file are taken in order of line; one whose edits overlap earlier ones waits for another pass. A file is
    the unit, as its edits depend on each other.
    """
    per = sites.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("line", "smell_type", "method"))).alias("sites")).join(files, "file")

    def of_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for file, listed, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                held, told = [], []
                for site in listed:
                    rewrite = REWRITES.get(site["smell_type"])
                    edits, why = rewrite(text, site["method"], site["line"]) if rewrite else ([], "no_rewrite")
                    if why is None and any(overlap(a, b) for a in edits for b in held):
                        why = "deferred"
                    if why is None:
                        held += edits
                    told.append((file, site["line"], site["smell_type"], site["method"], why))
                rewritten = applied(text, held)
                out += [(*t, rewritten) for t in told]
            kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], ["file", "line", "smell_type", "method", "refused", "rewritten"])

    return per.select("file", "sites", "text").mapInArrow(of_files, "file string, line int, smell_type string, method string, refused string, rewritten string")


def verdict(parses: Column, before: Column, after: Column) -> Column:
    """From whether the rewrite parses and the compiler's errors before and after it (null: no compiler)."""
    return (
        F.when(~parses, "broken_syntax").when(after.isNull(), "parses").when(F.size(after) == 0, "compiles")
        .when(F.size(F.array_except(after, F.coalesce(before, F.array().cast("array<string>")))) > 0, "new_errors").otherwise("no_new_errors")
    )


#: Fixed value: what follows a line that ends a file without a newline.
NO_NEWLINE = "\\ No newline at end of file"


def unified(before: str, after: str, file: str, around: int = 3) -> Iterator[str]:
    """The lines of a unified diff, each with its newline."""
    import difflib

    for line in difflib.unified_diff(before.splitlines(True), after.splitlines(True), f"a/{file}", f"b/{file}", n=around):
        yield line if line.endswith("\n") else f"{line}\n{NO_NEWLINE}\n"


def patches(files: DataFrame, around: int = 3) -> DataFrame:
    """`patch` of each row of `files` (file, before, after: texts or bytes); rows that aren't UTF-8, lack a text or don't change are left out."""

    def texts(column: pa.Array) -> Iterator[str | None]:
        for x in column.to_pylist():
            try:
                yield x.decode() if isinstance(x, bytes) else x
            except UnicodeDecodeError:
                yield None

    def of_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, befores, afters = (texts(batch.column(k)) for k in range(3))
            out = [(f, "".join(unified(a, b, f, around))) for f, a, b in zip(names, befores, afters, strict=True) if f is not None and a is not None and b is not None and a != b]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in range(2)], ["file", "patch"])

    return files.select("file", "before", "after").mapInArrow(of_files, "file string, patch string")
