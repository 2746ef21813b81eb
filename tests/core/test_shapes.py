"""Values of files whose shape was scanned before, against scans of the files themselves."""

import random
import re

import pyarrow as pa
import pytest

from sieveline.java import facts
from sieveline.java.shapes import Shapes, column
from tests.core.test_java import SHOP

MORE = """package a.b; import java.util.List; import static x.Y.*;
@Deprecated("x\\n1e+3") public final class Outer<T extends Comparable<T>> extends pkg.Base<T> implements Runnable, Zed, java.io.Closeable {
    private static final int A = 1, B = f(2, 0x1_f), $c = 1.5e+3; /* class Not { */ char q = '\\u0041';
    @Inject(name = Key) protected Outer(int x, String... rest) { super(x); for (Item zed : all) { zed.price(); this.names = null; } }
    String text() { return \"\"\"
        class Inside { }
        \"\"\" + Other.make().run(a . b.c) + ((List<String>) o).size(); }
    enum Colour { RED, GREEN(1) { int f() { return 2; } }; Colour() {} } record Point(int x, List<String> y) { Point { check(x); } }
"""


pytestmark = pytest.mark.usefixtures("spark")  # which Arrow schemas of Spark types need


def kind(parts=facts.UNITS):
    return pa.struct([f for f in facts._arrow(parts) if f.name != "file"])


def plain(shapes, text):
    return shapes._filled(shapes._template(shapes.kind, shapes._scan(text), False), [])


def renamed(text, seed):
    rnd = random.Random(seed)
    words = sorted(set(re.findall(r"(?<![\w$.\\])[a-z]\w{2,}", text)) & {"stock", "sold", "items", "left", "describe", "peer", "rest", "names", "zed", "all", "price", "text", "make", "run", "check", "size"})
    new = dict(zip(words, rnd.sample([f"{c}{i}é" for c in "abyz" for i in range(20)], len(words)), strict=True))
    return re.sub(r"(?<![\w$\\])[a-z]\w{2,}", lambda m: new.get(m[0], m[0]), text)


@pytest.mark.parametrize("text", [SHOP, MORE, MORE + "}", "", "class A { }", "class ꙮ { int ꙮ1ꙮ() { return Ꙗ.x; } }", "class A { int m() { return 1 $a + \x85 b; } }"])
@pytest.mark.parametrize("parts", [facts.UNITS, facts.SIZES, facts.ACCESSES])
def test_a_shape_is_scanned_once_and_says_of_each_file_what_its_scan_says(text, parts):
    shapes = Shapes(kind(parts))
    texts = [text, *(renamed(text, k) for k in range(5))]
    values = [shapes.values(t) for t in texts]
    assert shapes.scanned == (len(texts) if "ꙮ" in text else 1)
    assert values == [plain(Shapes(kind(parts)), t) for t in texts]
    assert column(shapes.kind, values).to_pylist() == pa.array([dict(zip([f.name for f in shapes.kind], v, strict=True)) for v in column_dicts(shapes.kind, values)], shapes.kind).to_pylist()


def column_dicts(of, values):
    """Tuples for structs as what Arrow reads row by row."""

    def row(k, v):
        if pa.types.is_struct(k):
            return {f.name: row(f.type, x) for f, x in zip(k, v, strict=True)}
        return [row(k.value_type, x) for x in v] if pa.types.is_list(k) else v

    return [[row(f.type, x) for f, x in zip(of, v, strict=True)] for v in values]


@pytest.mark.parametrize("a, b", [("class A { b c; }", "class A { b b; }"), ("class A { b c; }", "class A { B c; }"), ("class A { b c; }", "class A { b record; }"), ("class A { b c; }", "class A { b c ; }"), ("class A { int b = 1; }", "class A { int b = 2; }")])
def test_files_of_other_shapes_are_scanned(a, b):
    shapes = Shapes(kind())
    assert [shapes.values(a), shapes.values(b)] == [plain(shapes, a), plain(shapes, b)] and shapes.scanned == 4


def test_no_more_shapes_are_held_than_allowed():
    shapes = Shapes(kind(facts.SIZES), held=50)
    texts = [f"class A {{ {'void m() { if (a) b(); } ' * k} }}" for k in range(200)]
    assert [shapes.values(t) for t in texts * 2] == [plain(Shapes(shapes.kind), t) for t in texts * 2]
    assert len(shapes.young) + len(shapes.same) < 70 and len(shapes.old) < 70
