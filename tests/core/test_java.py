import pytest

from sieveline.java import analysis, facts
from sieveline.java.scanner import effective_loc, scan


def method(body, head="void m()"):
    _, _, types, _, broken = scan(f"class C {{ int total; Other peer; {head} {{ {body} }} }}")
    assert not broken
    return types[0].methods[0]


@pytest.mark.parametrize(
    "body, cc, nesting",
    [
        ("", 1, 0),
        ("if (a && b || c) x(); for (int i = 0; i < 3; i++) y();", 5, 1),
        ("if (a) { while (b) { z(); } } else if (c) { q(); } else { r(); }", 4, 2),
        ("do { x(); } while (a); return;", 2, 1),
        ("int y = a ? b : c; List<? extends T> l = null; Map<String, ?> m2 = null;", 2, 0),
        ("switch (k) { case 1: case 2: a(); break; default: b(); }", 3, 1),
        ("int v = switch (k) { case 1 -> 2; default -> 3; };", 4, 1),
        ("try (R r = open()) { a(); } catch (E e) { if (x) b(); } finally { c(); }", 3, 2),
        ("run(() -> { if (a) { b(); } });", 2, 1),
        ("run(new Runnable() { public void run() { for (;;) { if (x) y(); } } });", 3, 2),
        ("class Local { void n() { if (a) b(); } } c();", 1, 0),
        ("synchronized (this) { x(); } outer: for (String s : all) { continue outer; }", 2, 1),
        ("if (a) if (b) if (c) d();", 4, 3),
    ],
)
def test_complexity_and_nesting(body, cc, nesting):
    m = method(body)
    assert (m.cc, m.nesting) == (cc, nesting)


def test_types_members_and_modifiers():
    package, imports, types, _, broken = scan("""
package a.b;
import java.util.List;
import static x.Y.*;
/** doc */
@Deprecated public final class Outer<T extends Comparable<T>> extends pkg.Base<T> implements Runnable, java.io.Closeable {
    private static final int A = 1, B = f(2, 3);
    public List<Map<String, int[]>> names = new ArrayList<>(); // trailing
    @Inject protected Outer(int x, String... rest) { super(x); }
    public static <K> K pick(final List<K> from, int[] at) throws E { return from.get(0); }
    abstract void nothing();
    static { A(); }
    enum Colour { RED, GREEN(1) { int f() { return 2; } }; Colour() {} int f() { return 1; } }
    interface Shape { double AREA = 1.0; double area(); default int twice() { return 2; } }
    record Point(int x, List<String> y) { Point { check(x); } int sum() { return x; } }
    @interface Mark { int value() default 1; }
}
""")
    assert (package, imports, broken) == ("a.b", ["java.util.List", "x.Y.*"], False)
    assert [(t.name, t.kind) for t in types] == [("Outer", "class"), ("Colour", "enum"), ("Shape", "interface"), ("Point", "record")]
    outer, colour, shape, point = types
    assert (outer.superclass, outer.interfaces, outer.modifiers) == ("Base", ["Runnable", "Closeable"], ["final", "public"])
    assert [(n, t) for n, t, _, _ in outer.fields] == [("A", "int"), ("B", "int"), ("names", "List")]
    assert [(m.name, m.return_type, m.parameters, m.is_constructor) for m in outer.methods] == [
        ("Outer", None, [("x", "int"), ("rest", "String")], True), ("pick", "K", [("from", "List"), ("at", "int")], False), ("nothing", "void", [], False)]
    assert outer.methods[1].modifiers == ["public", "static"]
    assert [n for n, *_ in colour.fields] == ["RED", "GREEN"] and [m.name for m in colour.methods] == ["Colour", "f"]
    assert shape.fields[0][2] == ["final", "public", "static"] and [m.name for m in shape.methods] == ["area", "twice"]
    assert [n for n, *_ in point.fields] == ["x", "y"] and [m.name for m in point.methods] == ["sum"]


def test_accesses():
    m = method("int n = total + this.total; peer.getX(); peer.size = 1; Other.make().run(); helper(n); this.helper(); for (Item it : items) it.price(); String s = (String) o; \"a\".length();")
    assert {"n", "it", "s"} == set(m.locals) and m.locals["it"] == "Item"
    assert m.this_accesses == {"total"} and "total" in m.names
    assert m.field_accesses == {("peer", "size")}
    assert {("peer", "getX"), ("Other", "make"), ("Other.make()", "run"), ("it", "price"), ('"a"', "length")} == m.qualified_calls
    assert m.calls == {"helper"} and {"int", "Item", "String"} <= m.types


def test_lines():
    assert effective_loc("a;\n\n{\n} else {\n});\n// x\n/* b\n c\n*/\n* d\nreturn x; // e\n/* f */ g();".split("\n")) == 3


def test_broken_sources_are_told():
    assert scan("class A { void m() { ")[4] and scan("class A { } }")[4] and not scan("class A { }")[4]
    assert scan("")[2] == [] and scan("\x00\"'")[2] == []


SHOP = """
public class Shop {
    private int stock; private int sold; private List<Item> items;
    public Shop(int stock) { this.stock = stock; }
    public int left() { return stock - sold; }
    public void sell(int n) { sold += n; }
    public int count() { return items.size(); }
    public String describe(Item a, Item b) {
        return a.getName() + a.getPrice() + a.getSize() + b.getColour() + b.getWeight() + b.getOwner() + b.name;
    }
}
class Item extends Thing { public String name; public int price; public String getName() { return name; } public int getPrice() { return price; } }
"""


def test_a_source_tree(spark, tmp_path):
    for path, text in (("src/main/bin/Shop.java", SHOP), ("target/Gone.java", "class Gone {}"), (".git/src/No.java", "class No {}"), ("src/Bad.java", "class Bad { void m() {"), ("x/Note.txt", "class Note {}")):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    scanned = facts.units(facts.java_files(spark, f"file://{tmp_path}")).cache()
    assert {(r.file, r.has_syntax_errors) for r in scanned.collect()} == {("src/main/bin/Shop.java", False), ("src/Bad.java", True)}
    types = facts.entities(scanned)
    of = facts.methods(types)
    c = {r.name: r for r in analysis.class_table(types, of).collect()}
    shop, item = c["Shop"], c["Item"]
    assert (shop.nom, shop.nof, shop.wmc, shop.noam, item.nopa, item.noam) == (4, 3, 5, 0, 2, 2)
    assert shop.tcc == pytest.approx(1 / 6) and item.tcc == 0 and shop.lcom == 4
    assert (item.dit, shop.dit, item.woc, shop.woc, shop.cbo, item.cbo) == (1, 0, 0.0, 1.0, 1, 1)
    m = {(r.class_name, r.name): r for r in analysis.method_table(of).collect()}
    d = m["Shop", "describe"]
    assert (d.atfd, d.fdp, d.laa, d.np) == (7, 1, 0.0, 2)
    assert (m["Shop", "left"].laa, m["Shop", "left"].atfd) == (1.0, 0)
    found = analysis.findings(types).collect()
    assert ("Shop", "describe", "FeatureEnvy") in {(r.class_name, r.method, r.smell_type) for r in found}
