"""Ordinary Java that the rendered corpus does not hold: nested and second types,
several declarators, enum constants with arguments, equal names in two modules,
very long arguments.  Expected facts are written by hand."""

import pytest

from srcframe.operators import structure
from srcframe.operators.facts import JavaFacts

MAIN = '''package a;

import java.util.Map;

@Deprecated
public class C extends Base implements Runnable {
    private int x = 5, y = Math.max(1, 2), z;
    private Map<String, Integer> m = new HashMap<>();
    int[] plain;

    public void run() {
        helper(1, two(3, four(5, six(7, 8))));
        log.info("LONG");
    }

    void helper(int p, int q) { }

    static class In {
        private String deep;
        void inner() { helper(1, 2); }
    }
}

interface Second extends First {
    void z();
}
'''
ENUM = '''package a;

public enum E {
    A(1), B(2, "x;y"), PLAIN, @Deprecated D { int f() { return 1; } };

    private final int v = 0;
    E(int v) { }
}
'''


@pytest.fixture(scope="module")
def facts(spark):
    long = "+".join(["abcdefghij"] * 600)
    rows = [("r", "m1/a/C.java", MAIN.replace('"LONG"', long)), ("r", "m2/a/C.java", MAIN), ("r", "m1/a/E.java", ENUM)]
    return JavaFacts(spark.createDataFrame(rows, "repo_id string, path string, content string"))


def test_all_types(facts):
    got = sorted((r.path, r.class_fqn, r.decl_kind) for r in facts.classes.collect())
    assert got == [("m1/a/C.java", "a.C", "class"), ("m1/a/C.java", "a.C.In", "class"),
                   ("m1/a/C.java", "a.Second", "interface"), ("m1/a/E.java", "a.E", "enum"),
                   ("m2/a/C.java", "a.C", "class"), ("m2/a/C.java", "a.C.In", "class"),
                   ("m2/a/C.java", "a.Second", "interface")]
    one = {r.class_fqn: r for r in facts.classes.where("path = 'm2/a/C.java'").collect()}
    assert one["a.C"].annotations == ["@Deprecated"] and one["a.C.In"].annotations == []
    assert one["a.C"].parent == "Base" and one["a.Second"].parent == "First"


def test_all_declarators_and_constants(facts):
    got = {}
    for r in facts.fields.orderBy("ordinal").collect():
        got.setdefault((r.path, r.class_fqn), []).append(r.name)
    assert got["m1/a/C.java", "a.C"] == ["x", "y", "z", "m", "plain"]
    assert got["m1/a/C.java", "a.C.In"] == ["deep"]
    assert got["m1/a/E.java", "a.E"] == ["A", "B", "PLAIN", "D"]


def test_methods_belong_to_their_type(facts):
    got = sorted((r.class_fqn, r.name) for r in facts.methods.where("path = 'm2/a/C.java'").collect())
    assert got == [("a.C", "helper"), ("a.C", "run"), ("a.C.In", "inner"), ("a.Second", "z")]


def test_calls_of_two_modules_and_long_arguments(facts):
    rows = facts.calls.where("class_fqn = 'a.C' and method_name = 'run'").collect()
    by = {}
    for r in rows:
        by.setdefault(r.path, []).append(r)
    assert len(by["m1/a/C.java"]) == len(by["m2/a/C.java"]) == 5
    helper = [r for r in by["m2/a/C.java"] if r.name == "helper"][0]
    assert helper.arg_texts == ["1", "two(3, four(5, six(7, 8)))"] and helper.callee_sig == "a.C.helper(int, int)"
    info = [r for r in by["m1/a/C.java"] if r.name == "info"][0]
    assert len(info.arg_texts) == 1 and len(info.arg_texts[0]) == 6_599


def test_interfaces_extend_by_one_edge(facts):
    got = {(r.src, r.dst, r.arrow) for r in structure.inheritance_edges(facts.classes).collect()}
    assert got == {("Base", "C", "<|--"), ("Runnable", "C", "<|.."), ("First", "Second", "<|--")}


def test_log_source_tells_the_call_form(facts):
    from srcframe.operators.logs import java_log_statements
    got = {(r.path, r.source, r.level) for r in java_log_statements(facts).collect()}
    assert got == {("m1/a/C.java", "log", "info"), ("m2/a/C.java", "log", "info")}


TRAPS = '''package a;

class L { int a; int b; int f() { return 1; } int g() { return 2; } }

class C<K, V extends Comparable<V>> extends Base<Map<K, V>> implements I<A<B<C<D<E<F<G<H>>>>>>>>, J {
    <T extends Comparable<T>> T max(Map<String, List<Integer>> m, T... more) { return null; }
    @A(b = @B(c = @C(d = @D(e = @E(f = @F(g = @G(h = @H(")"))))))))
    void annotated(@X(y = @Y({1, 2})) final int[] p, String q[]) throws E1, E2 { }
    A<B<C<D<E<F<G<H>>>>>>> deep() { return a.b(f(g(h(i(j(k(l(m(1))))))))).c(); }
    private int[] x = {1, f(2, 3)}, y[], z = a < b ? 1 : 2;
    Map<String, A<B<C<D<E<F<G<H>>>>>>>> big = new HashMap<String, A<B<C<D<E<F<G<H>>>>>>>>() {{ put(1, 2); }}, next;
    record R(int a, String b) { int inner() { return 1; } }
    static { init(); }
    void locals() {
        class In { void x() { one(); } }
        if (a) { class In { void y() { two(); } } }
        new Thread() { public void run() { three(new Q<A, B>(1, 2), p -> { return four(p, 5); }); } }.start();
        list.stream().map(v -> v.get(0)).filter(w).collect(toList());
        this.field[1].go(a[2], "x, y", 'c', (int) z).on();
    }
}

enum E {
    A { void f() { if (a) { for (;;) { while (b) { do { try { g(new int[] {1}); } finally { h(() -> { i(); }); } } while (c); } } } } },
    B(1, "}"), @D("x;") C;
    int v;
    void of() { j(); }
}

@interface N { String[] value() default {"a", "b;"}; int n() default 1 + 2; Class<?> k(); }

class O { void a() { } class In { void b() { log.warn("deep"); } } void c() { log.info("outer"); } }
'''


@pytest.fixture(scope="module")
def traps(spark):
    many = "class Z { void m() { " + " ".join(f"a{k}.call({k}, b.c({k}));" for k in range(20_000)) + " } }"
    rows = [("r", "a/T.java", TRAPS), ("r", "b/T.java", "package a; class O { void c() { log.info(\"b\"); } }"),
            ("r", "Z.java", many), ("r", "broken.java", "class Q { int a; void f( { \" ' ] ) } }} class P { int p"), ("r", "e.java", ""),
            ("r", "n.java", None)]
    fx = JavaFacts(spark.createDataFrame(rows, "repo_id string, path string, content string"), persist=True)
    yield fx
    fx.unpersist()


def _of(df, path, *cols):
    return [tuple(r[c] for c in cols) for r in df.where(f"path = '{path}'").orderBy("class_fqn", "ordinal").collect()]


def test_types_of_any_depth(traps):
    got = {(r.class_fqn, r.decl_kind): (r.parent, r.interfaces) for r in traps.classes.where("path = 'a/T.java'").collect()}
    assert set(got) == {("a.L", "class"), ("a.C", "class"), ("a.C.In", "class"), ("a.E", "enum"), ("a.N", "@interface"),
                        ("a.O", "class"), ("a.O.In", "class")}
    assert got["a.C", "class"] == ("Base<Map<K, V>>", ["I<A<B<C<D<E<F<G<H>>>>>>>>", "J"])
    assert traps.classes.where("path = 'a/T.java' and class_fqn = 'a.C.In'").count() == 2


def test_members_of_any_depth(traps):
    f = _of(traps.fields, "a/T.java", "class_fqn", "name", "declared_type", "initializer")
    deep = "A<B<C<D<E<F<G<H>>>>>>>"
    assert f == [("a.C", "x", "int[]", None), ("a.C", "y", "int[]", None), ("a.C", "z", "int[]", None),
                 ("a.C", "big", f"Map<String, {deep}>", None), ("a.C", "next", f"Map<String, {deep}>", None),
                 ("a.E", "A", "E", None), ("a.E", "B", "E", None), ("a.E", "C", "E", None), ("a.L", "a", "int", None),
                 ("a.L", "b", "int", None), ("a.N", "value", "String[]", '{"a", "b;"}'), ("a.N", "n", "int", "1 + 2"),
                 ("a.N", "k", "Class<?>", None)]
    m = _of(traps.methods, "a/T.java", "class_fqn", "name", "return_type", "param_texts", "throws")
    assert m == [("a.C", "max", "T", ["Map<String, List<Integer>> m", "T... more"], []),
                 ("a.C", "annotated", "void", ["int[] p", "String[] q"], ["E1", "E2"]), ("a.C", "deep", deep, [], []),
                 ("a.C", "locals", "void", [], []), ("a.C.In", "x", "void", [], []), ("a.C.In", "y", "void", [], []),
                 ("a.E", "of", "void", [], []), ("a.L", "f", "int", [], []), ("a.L", "g", "int", [], []),
                 ("a.O", "a", "void", [], []), ("a.O", "c", "void", [], []), ("a.O.In", "b", "void", [], [])]
    one = traps.methods.where("name = 'annotated'").first()
    assert one.annotations == ['@A(b = @B(c = @C(d = @D(e = @E(f = @F(g = @G(h = @H(")"))))))))']
    assert [p.annotations for p in one.params] == [["@X(y = @Y({1, 2}))"], []]


def test_calls_of_any_depth(traps):
    got = {}
    for r in traps.calls.where("path = 'a/T.java'").orderBy("ordinal").collect():
        got.setdefault((r.class_fqn, r.method_name, r.method_ordinal), []).append((r.scope, r.name, r.arg_texts))
    chain = "a.b(f(g(h(i(j(k(l(m(1)))))))))"
    assert got["a.C", "deep", 2][-2:] == [("a", "b", ["f(g(h(i(j(k(l(m(1))))))))"]), (chain, "c", [])]
    assert len(got["a.C", "deep", 2]) == 10
    assert got["a.C.In", "x", 0] == [(None, "one", [])] and got["a.C.In", "y", 1] == [(None, "two", [])]
    assert got["a.C", "locals", 3] == [
        (None, "four", ["p", "5"]), (None, "three", ["new Q<A, B>(1, 2)", "p -> { return four(p, 5); }"]),
        ("new Thread() { public void run() { three(new Q<A, B>(1, 2), p -> { return four(p, 5); }); } }", "start", []),
        ("list", "stream", []), ("v", "get", ["0"]), ("list.stream()", "map", ["v -> v.get(0)"]),
        ("list.stream().map(v -> v.get(0))", "filter", ["w"]), (None, "toList", []),
        ("list.stream().map(v -> v.get(0)).filter(w)", "collect", ["toList()"]),
        ("this.field[1]", "go", ["a[2]", '"x, y"', "'c'", "(int) z"]), ("this.field[1].go(a[2], \"x, y\", 'c', (int) z)", "on", [])]


def test_one_method_of_many_calls(traps):
    rows = traps.raw_calls.where("path = 'Z.java'")
    assert rows.count() == 40_000
    assert rows.where("name = 'call' and scope = concat('a', element_at(arg_texts, 1)) and size(arg_texts) = 2").count() == 20_000


def test_log_calls_have_the_innermost_class(traps):
    from srcframe.operators.logs import java_log_statements
    got = {(r.path, r.class_fqn, r.message) for r in java_log_statements(traps).collect()}
    assert got == {("a/T.java", "a.O.In", "deep"), ("a/T.java", "a.O", "outer"), ("b/T.java", "a.O", "b")}


def test_broken_files_lose_no_other(traps):
    assert [r.class_fqn for r in traps.classes.where("path = 'broken.java'").collect()] == ["Q"]
