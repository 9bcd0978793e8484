"""SQL behind chains of copies, and one class name in two modules."""

from srcframe.operators import sqlops
from srcframe.operators.facts import JavaFacts

SRC = '''package a;
public class D {
    void m() {
        String a = "SELECT x FROM %s";
        String b = a;
        String c = b;
        st.executeQuery(c);
    }
}
'''


def test_copies_and_modules(spark):
    rows = [("r", f"{m}/a/D.java", SRC % m) for m in ("m1", "m2")]
    fx = JavaFacts(spark.createDataFrame(rows, "repo_id string, path string, content string"), persist=False)
    assert {(r.path, r.sql) for r in sqlops.jdbc_sql(fx).collect()} == {
        (f"{m}/a/D.java", f"SELECT x FROM {m}") for m in ("m1", "m2")}
    assert {r.sql for r in sqlops.source_ops(fx).collect()} == {"SELECT x FROM m1", "SELECT x FROM m2"}


def test_two_modules_with_one_class_name(spark):
    entity = "package a; @Entity class T { @Id Long id; @ManyToOne T up; }"
    repo = "package a; interface R extends JpaRepository<T, Long> { T findByName(String n); T findByUp(T t); }"
    rows = [("r", f"{m}/{n}.java", c) for m in ("m1", "m2") for n, c in (("T", entity), ("R", repo))]
    fx = JavaFacts(spark.createDataFrame(rows, "repo_id string, path string, content string"))
    assert sqlops.entity_schema(fx.classes, fx.fields).count() == 4
    assert sqlops.spring_data_ops(fx).count() == 4
    assert sqlops.jpa_relation_edges(fx.classes, fx.fields).count() == 2
