"""Adapters: the driver's tables → the input shapes the operators accept.

Each adapter is a plain projection (or a small join) written so that the
same derivation can be stated in SQL for the DuckDB oracle; the SQL twins
live next to the query definitions in ``srcframe.plans``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts as its splits come.  A table written as one row group is
    one split; ``srcframe.input.partitions`` in the session deals its rows out."""
    n = spark.conf.get("srcframe.input.partitions", None)
    df = table(spark, sf_dir, name)
    return df.repartition(int(n)) if n else df


def documents_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host D: ``source_files`` from ``documents``; repo = source, path =
    ``<lang>/<doc_id>.txt``."""
    d = texts(spark, sf_dir, "documents")
    return d.select(
        F.col("source").alias("repo_id"),
        F.concat_ws("/", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"),
        F.lit("txt").alias("ext"),
        F.col("n_chars").alias("size"),
        F.col("text").alias("content"),
    )


def pages_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host P: ``source_files`` from ``pages``; repo = host of the URL."""
    p = texts(spark, sf_dir, "pages")
    return p.select(
        F.regexp_extract("url", r"^[A-Za-z]+://([^/:?#]+)", 1).alias("repo_id"),
        F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"),
        F.lit("html").alias("ext"),
        F.length("html").cast("long").alias("size"),
        F.col("html").alias("content"),
    )


def conversations_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host C: ``log_statements`` from ``conversations``: class =
    ``conv.<conv_id>``, line = turn, level by role (system → debug, user →
    info, assistant → warn), message = text, one variable named by the role
    whose type is the capitalised role.  Flags are left to the operators."""
    c = texts(spark, sf_dir, "conversations")
    return c.select(
        F.concat(F.lit("chat"), (F.col("conv_id") % 4).cast("string")).alias("repo_id"),
        F.concat(F.lit("conv."), F.col("conv_id").cast("string")).alias("class_fqn"),
        F.col("turn").cast("int").alias("line"),
        F.when(F.col("role") == "system", "debug").when(F.col("role") == "user", "info")
        .when(F.col("role") == "assistant", "warn").alias("level"),
        F.col("text").alias("message"),
        F.col("role").alias("var_name"),
        F.initcap("role").alias("var_type"),
    )


def part_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifier-like names and types derived from ``part``: ``p_name``
    in lower camel case (``small ring`` → ``smallRing``) and ``p_type``
    capitalised plus the name's last word (``EconomyRing``)."""
    p = table(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    camel = F.concat(F.element_at(words, 1),
                     F.array_join(F.transform(F.slice(words, F.lit(2), F.size(words)), lambda w: F.initcap(w)), ""))
    return p.select("p_partkey", camel.alias("ident"),
                    F.concat(F.initcap("p_type"), F.initcap(F.element_at(words, -1))).alias("type_name"))


# ------------------------------------------------------------ call graphs (G)

def graph_tree(spark: SparkSession, sf_dir: str):
    """``g_tree``: region → nation → customer.  Regions are controllers
    (entry points), nations services, customers repositories; each class has
    one method ``visit(long id)``; calls are ordered by the child's key.
    Customers with a negative balance also call an unresolved library
    method.  Returns (classes, methods, calls)."""
    r = table(spark, sf_dir, "region")
    n = table(spark, sf_dir, "nation")
    c = table(spark, sf_dir, "customer")

    def cls(df, key, name, kind):
        return df.select(F.lit("tree").alias("repo_id"),
                         F.concat(F.lit(f"tree.{name}"), F.col(key).cast("string")).alias("class_fqn"),
                         F.lit(kind).alias("kind"))
    classes = (cls(r, "r_regionkey", "Region", "controller")
               .unionByName(cls(n, "n_nationkey", "Nation", "service"))
               .unionByName(cls(c, "c_custkey", "Customer", "repository")))
    methods = classes.select("repo_id", "class_fqn", F.lit("visit").alias("name"),
                             F.array(F.lit("long id")).alias("params"), F.lit(0).alias("ordinal"))
    calls = (n.select(F.lit("tree").alias("repo_id"),
                      F.concat(F.lit("tree.Region"), F.col("n_regionkey").cast("string"), F.lit(".visit")).alias("caller_fqn"),
                      F.col("n_nationkey").cast("long").alias("ordinal"),
                      F.concat(F.lit("tree.Nation"), F.col("n_nationkey").cast("string"), F.lit(".visit(long)")).alias("callee_sig"))
             .unionByName(c.select(F.lit("tree").alias("repo_id"),
                                   F.concat(F.lit("tree.Nation"), F.col("c_nationkey").cast("string"), F.lit(".visit")).alias("caller_fqn"),
                                   F.col("c_custkey").cast("long").alias("ordinal"),
                                   F.concat(F.lit("tree.Customer"), F.col("c_custkey").cast("string"), F.lit(".visit(long)")).alias("callee_sig")))
             .unionByName(c.where(F.col("c_acctbal") < 0).select(
                 F.lit("tree").alias("repo_id"),
                 F.concat(F.lit("tree.Customer"), F.col("c_custkey").cast("string"), F.lit(".visit")).alias("caller_fqn"),
                 F.lit(0).cast("long").alias("ordinal"),
                 F.lit("java.util.Objects.requireNonNull(Object)").alias("callee_sig"))))
    return classes, methods, calls


def graph_dag(spark: SparkSession, sf_dir: str):
    """``g_dag``: one class ``dag.Part<k>`` per part.  Within each order
    the distinct parts, sorted by key, call one another consecutively
    (``run`` of the smaller key calls ``run`` of the next; ordinal = callee
    key).  Parts with ``p_size = 1`` are controllers (entries).  Parts with
    ``p_size % 5 = 0`` declare an overload ``run(long k, int size)`` after
    ``run(long k)``.  Callees with ``p_size = 50`` have no class in the
    index: their calls stay unresolved.  Returns (classes, methods, calls)."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    w = Window.partitionBy("l_orderkey").orderBy("l_partkey")
    pairs = li.withColumn("nxt", F.lead("l_partkey").over(w)).where(F.col("nxt").isNotNull()) \
        .select(F.col("l_partkey").alias("src"), F.col("nxt").alias("dst")).distinct()
    known = p.where(F.col("p_size") != 50)
    classes = known.select(F.lit("dag").alias("repo_id"),
                           F.concat(F.lit("dag.Part"), F.col("p_partkey").cast("string")).alias("class_fqn"),
                           F.when(F.col("p_size") == 1, "controller").otherwise("service").alias("kind"))
    base = known.select(F.lit("dag").alias("repo_id"),
                        F.concat(F.lit("dag.Part"), F.col("p_partkey").cast("string")).alias("class_fqn"),
                        F.lit("run").alias("name"), F.array(F.lit("long k")).alias("params"),
                        F.lit(0).alias("ordinal"))
    over = known.where(F.col("p_size") % 5 == 0).select(
        F.lit("dag").alias("repo_id"),
        F.concat(F.lit("dag.Part"), F.col("p_partkey").cast("string")).alias("class_fqn"),
        F.lit("run").alias("name"), F.array(F.lit("long k"), F.lit("int size")).alias("params"),
        F.lit(1).alias("ordinal"))
    methods = base.unionByName(over)
    calls = pairs.select(F.lit("dag").alias("repo_id"),
                         F.concat(F.lit("dag.Part"), F.col("src").cast("string"), F.lit(".run")).alias("caller_fqn"),
                         F.col("dst").cast("long").alias("ordinal"),
                         F.concat(F.lit("dag.Part"), F.col("dst").cast("string"), F.lit(".run(long)")).alias("callee_sig"))
    return classes, methods, calls


def events_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host E: ``call_flows`` from ``events``: entry = user, step = event
    type, numbered by (ts, event_id)."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.lit("events").alias("repo_id"), F.col("user_id").cast("string").alias("entry"),
                    F.row_number().over(w).alias("step_no"), F.col("event_type").alias("step"))


# ------------------------------------------------------ rendered Java (R)

def _j(*parts) -> "F.Column":
    """Concatenate literal text and columns into Java source text."""
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])


def java_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The per-part variables the Java templates use: ``k`` (key), ``s``
    (size), ``h`` (chain head), ``repo_id`` (by the head's size) and
    ``kind`` (k % 6)."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("s"))
    head = p.select(F.col("k").alias("h"), F.col("s").alias("hs")).hint("merge")  # narrow, but as long as the table
    d = p.withColumn("h", F.col("k") - F.col("k") % 6).join(head, "h", "left")
    return d.select(
        "k", "s", "h",
        F.concat(F.lit("repo"), (F.coalesce(F.col("hs"), F.lit(0)) % 10).cast("string")).alias("repo_id"),
        (F.col("k") % 6).alias("kind"))


def java_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host R: one Java source file per part (FIXTURES §3.1).  Type by
    ``k % 6``: controller, service, repository interface, entity, SOAP
    endpoint, and for 5: an enum (even size), an annotation type (size a
    multiple of 3) or a utility class with JDBC calls.  Every file carries traps for a lexical
    reader: a commented-out class header, a string that looks like a call, a
    block comment holding ``@Entity``."""
    d = java_parts(spark, sf_dir)
    k = F.col("k").cast("string")
    k1 = (F.col("k") + 1).cast("string")
    k2 = (F.col("k") + 2).cast("string")
    k3 = (F.col("k") + 3).cast("string")
    km2 = (F.col("k") - 2).cast("string")
    km6 = (F.col("k") - 6).cast("string")
    h = F.col("h").cast("string")
    pkg = _j("package com.acme.c", h, ";\n\n")
    var = F.when(F.col("s") % 3 == 0, "email").when(F.col("s") % 3 == 1, "cardNumber").otherwise("count")
    ctrl = _j(pkg,
              "import org.springframework.web.bind.annotation.GetMapping;\n"
              "import org.springframework.web.bind.annotation.PathVariable;\n"
              "import org.springframework.web.bind.annotation.PostMapping;\n"
              "import org.springframework.web.bind.annotation.RequestBody;\n"
              "import org.springframework.web.bind.annotation.RestController;\n\n"
              "// public class Legacy", k, "Controller {\n"
              "@RestController\n"
              "public class Item", k, "Controller {\n\n"
              "    private final Item", k1, "Service service;\n\n"
              "    public Item", k, "Controller(Item", k1, "Service service) {\n"
              "        this.service = service;\n"
              "    }\n\n"
              "    @GetMapping(\"/items/", k, "/{id}\")\n"
              "    public String getItem(@PathVariable(\"id\") Long id) {\n"
              "        String note = \"service.process(fake)\";\n"
              "        return service.process(id);\n"
              "    }\n\n"
              "    @PostMapping(value = \"/items/", k, "\")\n"
              "    public String createItem(@RequestBody Item", k3, " body) {\n"
              "        return service.save(body);\n"
              "    }\n"
              "}\n")
    svc = _j(pkg,
             "import org.slf4j.Logger;\n"
             "import org.slf4j.LoggerFactory;\n"
             "import org.springframework.stereotype.Service;\n\n"
             "/* @Entity\n"
             "   public class Ghost {} */\n"
             "@Service\n"
             "public class Item", k, "Service {\n\n"
             "    private static final Logger log = LoggerFactory.getLogger(Item", k, "Service.class);\n"
             "    private Item", k1, "Repository repository;\n\n"
             "    public String process(Long id) {\n"
             "        String ", var, " = \"value", k, "\";\n"
             "        log.info(\"Processing item {} for {}\", id, ", var, ");\n"
             "        repository.findById(id);\n"
             "        return \"ok\";\n"
             "    }\n\n"
             "    public String save(Item", k2, " body) {\n",
             F.when(F.col("s") % 7 == 0, F.lit("        System.out.println(\"saving item\");\n")).otherwise(F.lit("")),
             "        repository.save(body);\n"
             "        return \"saved\";\n"
             "    }\n"
             "}\n")
    repo = _j(pkg,
              "import java.util.List;\n"
              "import org.springframework.data.jpa.repository.JpaRepository;\n"
              "import org.springframework.data.jpa.repository.Query;\n"
              "import org.springframework.stereotype.Repository;\n\n"
              "@Repository\n"
              "public interface Item", k, "Repository extends JpaRepository<Item", k1, ", Long> {\n\n"
              "    List<Item", k1, "> findByNameAndStatus(String name, String status);\n\n"
              "    Item", k1, " saveItem(Item", k1, " item);\n\n"
              "    @Query(\"SELECT i FROM item_", k1, " i WHERE i.id = ?1\")\n"
              "    Item", k1, " loadById(Long id);\n"
              "}\n")
    ent = _j(pkg,
             "import javax.persistence.Entity;\n"
             "import javax.persistence.Id;\n"
             "import javax.persistence.ManyToOne;\n"
             "import javax.persistence.Table;\n\n"
             "@Entity\n"
             "@Table(name = \"item_", k, "\")\n"
             "public class Item", k, " {\n\n"
             "    @Id\n"
             "    private Long id;\n\n"
             "    private String name;\n",
             F.when(F.col("k") >= 6, _j("\n    @ManyToOne\n    private Item", km6, " parent;\n")).otherwise(F.lit("")),
             "}\n")
    endp = _j(pkg,
              "import javax.jws.WebMethod;\n"
              "import javax.jws.WebService;\n\n"
              "@WebService(targetNamespace = \"urn:item", k, "\", serviceName = \"Item", k, "Service\")\n"
              "public class Item", k, "Endpoint {\n\n"
              "    @WebMethod(operationName = \"getItem", k, "\")\n"
              "    public String getItem(String id) {\n"
              "        return id.trim();\n"
              "    }\n"
              "}\n")
    enum = _j(pkg,
              "public enum Item", k, "Util {\n"
              "    ALPHA, BETA, GAMMA\n"
              "}\n")
    util = _j(pkg,
              "import java.sql.Connection;\n\n"
              "public class Item", k, "Util {\n\n"
              "    public void executeAudit(Connection conn) throws Exception {\n"
              "        String sql = \"SELECT * FROM item_", km2, " WHERE id = 1\";\n"
              "        String copy = sql;\n"
              "        conn.prepareStatement(copy);\n"
              "        conn.createStatement().executeQuery(\"DELETE FROM audit_", k, " WHERE id = 2\");\n"
              "    }\n\n"
              "    public String auditQuery() {\n"
              "        return \"UPDATE item_", km2, " SET name = 'x' WHERE id = 3\";\n"
              "    }\n"
              "}\n")
    anno = _j(pkg,
              "import java.lang.annotation.Retention;\n"
              "import java.lang.annotation.RetentionPolicy;\n\n"
              "@Retention(RetentionPolicy.RUNTIME)\n"
              "public @interface Item", k, "Util {\n"
              "    String value() default \"item", k, "\";\n"
              "    int priority() default ", F.col("s").cast("string"), ";\n"
              "    boolean enabled();\n"
              "}\n")
    kind = F.col("kind")
    content = (F.when(kind == 0, ctrl).when(kind == 1, svc).when(kind == 2, repo).when(kind == 3, ent)
               .when(kind == 4, endp).when(F.col("s") % 2 == 0, enum).when(F.col("s") % 3 == 0, anno)
               .otherwise(util))
    suffix = (F.when(kind == 0, "Controller").when(kind == 1, "Service").when(kind == 2, "Repository")
              .when(kind == 3, "").when(kind == 4, "Endpoint").otherwise("Util"))
    path = F.concat(F.lit("src/main/java/com/acme/c"), h, F.lit("/Item"), k, suffix, F.lit(".java"))
    # the narrow rows are dealt out before the files are rendered from them
    d = d.repartition(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = d.select("repo_id", path.alias("path"), F.lit("java").alias("ext"), content.alias("content"))
    return out.withColumn("size", F.length("content").cast("long")) \
        .select("repo_id", "path", "ext", "size", "content")


# ------------------------------------------------------- build files (M)

def build_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host M: one repository ``proj<n>`` per nation with build files.
    ``n % 3``: 0 → ``pom.xml`` with the Spring Boot parent ``3.<n>.0``,
    Java ``1.8`` as a property (even n) or ``17`` in the compiler plugin
    (odd n), modules ``m0..m(n % 4)`` of which the even ones exist as
    directories; 1 → ``build.gradle`` with the Spring Boot plugin
    ``3.<n>.1``; 2 → no build file, and an application class annotated
    ``@SpringBootApplication`` when n is even.  Even n also carry a Gherkin
    feature file, and n divisible by 5 a second one under ``features/``."""
    nat = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"))
    ns = F.col("n").cast("string")
    repo = F.concat(F.lit("proj"), ns)
    mods = F.sequence(F.lit(0), F.col("n") % 4)
    modules_xml = F.array_join(F.transform(mods, lambda i: F.concat(F.lit("    <module>m"), i.cast("string"),
                                                                    F.lit("</module>"))), "\n")
    java_xml = F.when(F.col("n") % 2 == 0, _j(
        "  <properties>\n    <maven.compiler.source>1.8</maven.compiler.source>\n  </properties>\n")) \
        .otherwise(_j("  <build>\n    <plugins>\n      <plugin>\n        <groupId>org.apache.maven.plugins</groupId>\n"
                      "        <artifactId>maven-compiler-plugin</artifactId>\n        <configuration>\n"
                      "          <release>17</release>\n        </configuration>\n      </plugin>\n"
                      "    </plugins>\n  </build>\n"))
    pom = _j('<?xml version="1.0" encoding="UTF-8"?>\n'
             '<project xmlns="http://maven.apache.org/POM/4.0.0">\n'
             "  <modelVersion>4.0.0</modelVersion>\n"
             "  <parent>\n    <groupId>org.springframework.boot</groupId>\n"
             "    <artifactId>spring-boot-starter-parent</artifactId>\n"
             "    <version>3.", ns, ".0</version>\n  </parent>\n"
             "  <artifactId>nation", ns, "</artifactId>\n", java_xml,
             "  <modules>\n", modules_xml, "\n  </modules>\n</project>\n")
    gradle = _j("plugins {\n    id 'java'\n    id 'org.springframework.boot' version '3.", ns, ".1'\n}\n\n"
                "group = 'com.nation", ns, "'\n")
    app = _j("package com.nation", ns, ";\n\n",
             F.when(F.col("n") % 2 == 0, F.lit("@SpringBootApplication\n")).otherwise(F.lit("")),
             "public class App", ns, " {\n}\n")
    rows = [
        nat.where(F.col("n") % 3 == 0).select(repo.alias("repo_id"), F.lit("pom.xml").alias("path"), pom.alias("content")),
        nat.where(F.col("n") % 3 == 1).select(repo.alias("repo_id"), F.lit("build.gradle").alias("path"),
                                              gradle.alias("content")),
        nat.select(repo.alias("repo_id"), F.concat(F.lit("src/main/java/com/nation"), ns, F.lit("/App"), ns,
                                                   F.lit(".java")).alias("path"), app.alias("content")),
        # module directories: even module numbers exist
        nat.where(F.col("n") % 3 == 0).select(repo.alias("repo_id"), F.explode(F.filter(mods, lambda i: i % 2 == 0)).alias("m"))
        .select("repo_id", F.concat(F.lit("m"), F.col("m").cast("string"), F.lit("/pom.xml")).alias("path"),
                F.lit("<project/>\n").alias("content")),
        nat.where(F.col("n") % 2 == 0).select(repo.alias("repo_id"),
                                              F.concat(F.lit("src/test/resources/features/nation"), ns,
                                                       F.lit(".feature")).alias("path"),
                                              _j("Feature: Nation ", ns, "\n  Scenario: lookup\n    Given nation ", ns,
                                                 "\n").alias("content")),
        nat.where(F.col("n") % 5 == 0).select(repo.alias("repo_id"), F.lit("features/extra.feature").alias("path"),
                                              F.lit("Feature: Extra\n").alias("content")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    from srcframe.functions.text import ext_of
    return out.select("repo_id", "path", ext_of(F.col("path")).alias("ext"),
                      F.length("content").cast("long").alias("size"), "content")


# ---------------------------------------------------------------- WSDL (X)

def wsdl_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host X: one WSDL per supplier in repository ``ws<s_nationkey>``:
    target namespace ``urn:n<nationkey>``, ``s_suppkey % 3 + 1``
    operations ``op<i>`` (operation 1 overrides the binding style with
    ``rpc``), one binding, one service with one port."""
    sup = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("s"), F.col("s_nationkey").alias("nk"))
    s_ = F.col("s").cast("string")
    nk = F.col("nk").cast("string")
    ops = F.sequence(F.lit(0), F.col("s") % 3)

    def per_op(fn):
        return F.array_join(F.transform(ops, lambda i: fn(i.cast("string"), i)), "")
    messages = per_op(lambda i, _: _j('  <message name="Op', i, 'Request"><part name="parameters" element="tns:Op', i,
                                      'Req"/></message>\n  <message name="Op', i, 'Response"><part name="parameters" '
                                      'element="tns:Op', i, 'Resp"/></message>\n'))
    pt_ops = per_op(lambda i, _: _j('    <operation name="op', i, '"><documentation>Operation ', i, ' of supplier ', s_,
                                    '</documentation><input message="tns:Op', i, 'Request"/><output message="tns:Op', i,
                                    'Response"/></operation>\n'))
    b_ops = per_op(lambda i, ii: _j('    <operation name="op', i, '"><soap:operation soapAction="urn:n', nk, '/op', i, '"',
                                    F.when(ii == 1, F.lit(' style="rpc"')).otherwise(F.lit("")),
                                    '/><input><soap:body use="literal"/></input><output><soap:body use="literal"/></output>'
                                    '</operation>\n'))
    content = _j('<?xml version="1.0" encoding="UTF-8"?>\n'
                 '<definitions xmlns="http://schemas.xmlsoap.org/wsdl/" xmlns:soap="http://schemas.xmlsoap.org/wsdl/soap/" '
                 'xmlns:tns="urn:n', nk, '" targetNamespace="urn:n', nk, '" name="Supplier', s_, '">\n',
                 messages,
                 '  <portType name="Supplier', s_, 'PortType">\n', pt_ops, '  </portType>\n'
                 '  <binding name="Supplier', s_, 'Binding" type="tns:Supplier', s_, 'PortType">\n'
                 '    <soap:binding style="document" transport="http://schemas.xmlsoap.org/soap/http"/>\n', b_ops,
                 '  </binding>\n'
                 '  <service name="Supplier', s_, 'Service"><port name="Supplier', s_, 'Port" binding="tns:Supplier', s_,
                 'Binding"><soap:address location="http://example.org/s', s_, '"/></port></service>\n'
                 '</definitions>\n')
    out = sup.select(F.concat(F.lit("ws"), nk).alias("repo_id"),
                     F.concat(F.lit("src/main/resources/wsdl/supplier"), s_, F.lit(".wsdl")).alias("path"),
                     F.lit("wsdl").alias("ext"), content.alias("content"))
    return out.withColumn("size", F.length("content").cast("long")).select("repo_id", "path", "ext", "size", "content")


def xsd_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host X: one XSD per supplier: elements ``S<s>E0 … S<s>E<L>`` with
    ``L = s_suppkey % 8``; element j holds a ``ref`` to element j+1 (so
    chains reach past the expansion depth 5), a local ``code`` element and
    one attribute (``id`` typed and required on even j, ``note`` with
    defaults on odd j)."""
    sup = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("s"), F.col("s_nationkey").alias("nk"))
    s_ = F.col("s").cast("string")
    nk = F.col("nk").cast("string")
    els = F.sequence(F.lit(0), F.col("s") % 8)

    def element(jc):
        j = jc.cast("string")
        ref = F.when(jc < F.col("s") % 8, _j('        <xs:element ref="tns:S', s_, 'E', (jc + 1).cast("string"), '" minOccurs="0"',
                                           F.when(jc % 2 == 1, F.lit(' maxOccurs="unbounded"')).otherwise(F.lit("")),
                                           '/>\n')).otherwise(F.lit(""))
        attr = F.when(jc % 2 == 0, F.lit('      <xs:attribute name="id" type="xs:int" use="required"/>\n')) \
            .otherwise(F.lit('      <xs:attribute name="note"/>\n'))
        return _j('  <xs:element name="S', s_, 'E', j, '">\n    <xs:complexType>\n      <xs:sequence>\n', ref,
                  '        <xs:element name="code" type="xs:string"/>\n      </xs:sequence>\n', attr,
                  '    </xs:complexType>\n  </xs:element>\n')
    content = _j('<?xml version="1.0" encoding="UTF-8"?>\n<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" '
                 'xmlns:tns="urn:n', nk, '" targetNamespace="urn:n', nk, '">\n',
                 F.array_join(F.transform(els, element), ""), '</xs:schema>\n')
    out = sup.select(F.concat(F.lit("ws"), nk).alias("repo_id"),
                     F.concat(F.lit("src/main/resources/xsd/supplier"), s_, F.lit(".xsd")).alias("path"),
                     F.lit("xsd").alias("ext"), content.alias("content"))
    return out.withColumn("size", F.length("content").cast("long")).select("repo_id", "path", "ext", "size", "content")


def soap_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host W: SOAP sources, one or two Java files per part in repository
    ``soap<k % 5>``.  By ``k % 6``: 0 and 1 an implementation in module
    ``impl`` with its interface in module ``api`` (named in full, or by a
    simple name and an import); 2 a BARE service with headers; 3 a WRAPPED
    one; 4 a Spring-WS endpoint; 5 a configuration with a WSDL definition
    bean (no namespace where the size is a multiple of 3)."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("s"))
    # the narrow rows are dealt out before the files are rendered from them
    p = p.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    k = F.col("k").cast("string")
    service = _j('targetNamespace = "urn:impl', k, '", serviceName = "Svc', k, 'Service"')
    head = _j("package com.acme.impl;\n\nimport com.acme.api.Port", k, ";\nimport javax.jws.*;\n\n")
    api = _j("package com.acme.api;\n\nimport javax.jws.*;\n\n")
    impl0 = _j(head, '@Service\n@WebService(endpointInterface = "com.acme.api.Port', k, '", portName = "P', k, '", ', service,
               ")\npublic class Svc", k, " {\n    public String find(String id, int n) { return id; }\n}\n")
    sei0 = _j(api, '@WebService(targetNamespace = "urn:api', k, '", name = "Port', k, 'Type")\npublic interface Port', k,
              ' {\n    @WebMethod(operationName = "find', k, '")\n    @RequestWrapper(localName = "find", className = "com.acme.api.Find',
              k, '")\n    String find(String id, int n);\n}\n')
    impl1 = _j(head, '@WebService(endpointInterface = "Port', k, '", ', service, ")\npublic class Svc", k,
               " {\n    public String find(String id) { return id; } public String find(String id, int n) { return id; }\n}\n")
    sei1 = _j(api, '@WebService(serviceName = "Api', k, '")\npublic interface Port', k, ' {\n    @WebMethod(operationName = "one', k,
              '") String find(String id);\n    @WebMethod(operationName = "two', k, '") String find(String id, int n);\n}\n')
    bare = _j(head, "@WebService(", service, ")\n@SOAPBinding(style = SOAPBinding.Style.DOCUMENT, parameterStyle = "
              "SOAPBinding.ParameterStyle.BARE)\npublic class Svc", k, ' {\n    @WebMethod\n    public Reply', k,
              ' put(@WebParam(name = "auth", header = true) Token auth, Map<String, Order', k, '> orders) { return null; }\n'
              '    @WebMethod\n    @WebResult(name = "trace", header = true)\n    public Trace del(@WebParam(header = true, '
              'name = "x", partName = "p") A a, @WebParam(header = true, name = "p") B b, C c) { return null; }\n}\n')
    wrapped = _j(head, "@WebService(", service, ")\npublic class Svc", k, " {\n    @WebMethod public void save(Order", k,
                 " o) { }\n    @WebMethod @WebResult(header = true) public String ask(String q, int n) { return q; }\n"
                 "    @WebMethod public int one(@WebParam(header = true) Token t) { return 1; }\n}\n")
    spring = _j(head, "@Endpoint\npublic class Svc", k, ' {\n    @PayloadRoot(namespace = "urn:pay', k, '", localPart = "Pay', k,
                '")\n    public Ack pay(@RequestPayload Pay', k, ' p, @SoapHeader("{urn:h}sig', k, '") Sig s) { return null; }\n}\n')
    bean = _j(head, "@Configuration\npublic class Svc", k, " {\n    @Bean(name = \"w\")\n    public DefaultWsdl11Definition orders", k,
              "() {\n        DefaultWsdl11Definition made = new DefaultWsdl11Definition();\n"
              "        DefaultWsdl11Definition other = new DefaultWsdl11Definition();\n"
              '        other.setLocationUri("/trap");\n        made.setPortTypeName("Early");\n        made.setPortTypeName("Orders', k,
              '");\n        made.setLocationUri(BASE);\n        DefaultWsdl11Definition last = made;\n',
              F.when(F.col("s") % 3 == 0, F.lit('        last.setLocationUri("/ws");\n')).otherwise(
                  _j('        last.setTargetNamespace("urn:w', k, '");\n')),
              "        return last;\n    }\n}\n")
    content = F.when(F.col("k") % 6 == 0, impl0)
    for i, x in enumerate((impl1, bare, wrapped, spring, bean), 1):
        content = content.when(F.col("k") % 6 == i, x)
    repo = F.concat(F.lit("soap"), (F.col("k") % 5).cast("string")).alias("repo_id")
    impl = p.select(repo, F.concat(F.lit("impl/src/com/acme/impl/Svc"), k, F.lit(".java")).alias("path"), content.alias("content"))
    sei = p.where(F.col("k") % 6 < 2).select(
        repo, F.concat(F.lit("api/src/com/acme/api/Port"), k, F.lit(".java")).alias("path"),
        F.when(F.col("k") % 6 == 0, sei0).otherwise(sei1).alias("content"))
    return impl.unionByName(sei).select("repo_id", "path", F.lit("java").alias("ext"),
                                        F.length("content").cast("long").alias("size"), "content")


def schema_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host Y: a WSDL and a schema per supplier ``s`` in repository ``xs<s % 5>``.
    The WSDL names the schema by a path suffix, a schema that doesn't exist
    and (in a comment) one that must not count.  Schemas ``t<s>`` import the
    next of their repository, four to a ring (the fourth names the first, by
    a relative path), so imports have cycles; some rings are cut off."""
    p = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("s"))
    s_ = F.col("s").cast("string")
    place = F.floor(F.col("s") / 5) % 4
    nxt = F.when(place < 3, F.col("s") + 5).otherwise(F.col("s") - 15).cast("string")
    repo = F.concat(F.lit("xs"), (F.col("s") % 5).cast("string")).alias("repo_id")
    wsdl = _j('<definitions xmlns="http://schemas.xmlsoap.org/wsdl/" xmlns:xs="http://www.w3.org/2001/XMLSchema">\n<types><xs:schema>\n'
              '<!-- <xs:import schemaLocation="t1.xsd"/> -->\n<xs:import namespace="urn:t', s_, '" schemaLocation="types/t', s_,
              '.xsd"/>\n<xs:import schemaLocation="missing', s_, '.xsd"/>\n</xs:schema></types>\n</definitions>\n')
    xsd = _j('<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" targetNamespace="urn:t', s_, '">\n',
             F.when(place == 2, _j('<xs:include schemaLocation="../types/t', nxt, '.xsd"/>\n')).otherwise(
                 _j('<xs:import namespace="urn:t', nxt, '" schemaLocation="t', nxt, '.xsd"/>\n')), '</xs:schema>\n')
    a = p.select(repo, F.concat(F.lit("svc/s"), s_, F.lit("/main.wsdl")).alias("path"), F.lit("wsdl").alias("ext"), wsdl.alias("content"))
    b = p.select(repo, F.concat(F.lit("src/main/resources/xsd/types/t"), s_, F.lit(".xsd")).alias("path"), F.lit("xsd").alias("ext"), xsd.alias("content"))
    return a.unionByName(b).withColumn("size", F.length("content").cast("long")).select("repo_id", "path", "ext", "size", "content")
