"""Project metadata, one row per repository (section C).

Every operator is a ``groupBy(repo_id)`` with conditional aggregates over
the file table (partial aggregation first, so a repository with millions of
files still sends one row per task to the shuffle), or a projection of build
file text with ``regexp_extract`` / ``xpath``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# File names and markers the detection looks for.
POM = "pom.xml"
GRADLE = ["build.gradle", "build.gradle.kts"]
BOOT_MARKERS_POM = ["spring-boot-starter-parent", "org.springframework.boot"]
BOOT_MARKERS_GRADLE = ["org.springframework.boot", "spring-boot-gradle-plugin"]
BOOT_APP = "@SpringBootApplication"

# Version patterns, tried in this order (fixed values).
PARENT_VERSION_RX = (r"(?s)<parent>.*?<groupId>org.springframework.boot</groupId>.*?"
                     r"<artifactId>spring-boot-starter-parent</artifactId>.*?<version>(.*?)</version>.*?</parent>")
PROPERTY_VERSION_RX = r"<spring-boot.version>(.*?)</spring-boot.version>"
GRADLE_PLUGIN_RX = r"(?i)(?:id[\s(]['\"']org\.springframework\.boot['\"']\)?(?:\s*version\s*['\"'](.*?)['\"'])?)"
GRADLE_EXT_RX = r"(?:ext\s*\[['\"']springBootVersion['\"']\]\s*=|springBootVersion\s*=)\s*['\"'](.*?)['\"']"
KOTLIN_DSL_RX = r"id\(\"org\.springframework\.boot\"\)\s*version\s*\"(.*?)\""


def _build_texts(files: DataFrame) -> DataFrame:
    """Per repository: root pom text, root gradle text (build.gradle before
    build.gradle.kts), and whether any Java file declares a Boot app."""
    is_pom = F.col("path") == POM
    return files.groupBy("repo_id").agg(
        F.max(F.when(is_pom, F.col("content"))).alias("pom"),
        F.max(F.when(F.col("path") == GRADLE[0], F.col("content"))).alias("_g"),
        F.max(F.when(F.col("path") == GRADLE[1], F.col("content"))).alias("_gk"),
        F.bool_or(F.coalesce(F.col("path").endswith(".java") & F.col("content").contains(BOOT_APP), F.lit(False)))
        .alias("boot_app")) \
        .withColumn("gradle", F.coalesce("_g", "_gk")).drop("_g", "_gk")


def build_tool(files: DataFrame) -> DataFrame:
    """C1 ``build_tool``: Maven if a root ``pom.xml``, else Gradle if a
    root ``build.gradle(.kts)``, else ``Raw Source/Unknown``."""
    agg = files.groupBy("repo_id").agg(F.bool_or(F.col("path") == POM).alias("has_pom"),
                                       F.bool_or(F.col("path").isin(*GRADLE)).alias("has_gradle"))
    return agg.select("repo_id", F.when(F.col("has_pom"), "Maven").when(F.col("has_gradle"), "Gradle")
                      .otherwise("Raw Source/Unknown").alias("build_tool"))


def _contains_any(c: Column, words) -> Column:
    out = None
    for w in words:
        x = F.coalesce(c.contains(w), F.lit(False))
        out = x if out is None else (out | x)
    return out


def spring_boot(files: DataFrame) -> DataFrame:
    """C2 ``is_spring_boot`` + C3 ``spring_boot_version`` in one pass."""
    t = _build_texts(files)
    is_boot = (_contains_any(F.col("pom"), BOOT_MARKERS_POM) | _contains_any(F.col("gradle"), BOOT_MARKERS_GRADLE)
               | F.coalesce(F.col("boot_app"), F.lit(False)))

    def rx(c, p):
        return F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    version = F.coalesce(rx(F.col("pom"), PARENT_VERSION_RX), rx(F.col("pom"), PROPERTY_VERSION_RX),
                         rx(F.col("gradle"), GRADLE_PLUGIN_RX), rx(F.col("gradle"), GRADLE_EXT_RX),
                         rx(F.col("gradle"), KOTLIN_DSL_RX))
    return t.select("repo_id", is_boot.alias("is_spring_boot"), version.alias("spring_boot_version"))


# Typed view of the parts of a pom the detection reads.  ``from_xml`` in
# PERMISSIVE mode turns a malformed file into nulls instead of failing the
# job (the reference logs and skips such files).
POM_SCHEMA = (
    "properties STRUCT<`maven.compiler.source`: STRING, `maven.compiler.target`: STRING, "
    "`maven.compiler.release`: STRING>, "
    "build STRUCT<plugins: STRUCT<plugin: ARRAY<STRUCT<artifactId: STRING, "
    "configuration: STRUCT<source: STRING, target: STRING, release: STRING>>>>>, "
    "modules STRUCT<module: ARRAY<STRING>>")
XML_OPTS = {"mode": "PERMISSIVE", "ignoreNamespace": "true"}


def parse_pom(files: DataFrame) -> DataFrame:
    """Root ``pom.xml`` of each repository as a typed struct ``pom``."""
    return files.where(F.col("path") == POM).select(
        "repo_id", F.from_xml("content", POM_SCHEMA, XML_OPTS).alias("pom"))


def java_version(files: DataFrame) -> DataFrame:
    """C4 ``java_version(pom)``: compiler source, target or release in the
    pom properties; else in the maven-compiler-plugin configuration;
    ``1.x`` → ``x``."""
    p = parse_pom(files)
    plugin = F.try_element_at(F.filter(F.col("pom.build.plugins.plugin"),
                                       lambda x: x["artifactId"] == "maven-compiler-plugin"), F.lit(1))
    cfg = plugin["configuration"]
    v = F.trim(F.coalesce(F.col("pom.properties").getField("maven.compiler.source"),
                          F.col("pom.properties").getField("maven.compiler.target"),
                          F.col("pom.properties").getField("maven.compiler.release"),
                          cfg["source"], cfg["target"], cfg["release"]))
    return p.select("repo_id", F.regexp_replace(v, r"^1\.", "").alias("java_version"))


def maven_modules(files: DataFrame) -> DataFrame:
    """C5 ``maven_modules``: ``<module>`` names of the root pom that exist
    as directories of the repository (a semi join on directory prefixes)."""
    mods = parse_pom(files).select("repo_id", F.posexplode("pom.modules.module").alias("ordinal", "module")) \
        .withColumn("module", F.trim("module")).where(F.col("module") != "")
    parts = F.split("path", "/")
    dir_prefix = files.where(F.col("path").contains("/")).select(
        "repo_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1),
                                         lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))
        .alias("module")).distinct()
    return mods.join(dir_prefix, ["repo_id", "module"], "left_semi").select("repo_id", "ordinal", "module")


def gherkin_features(files: DataFrame) -> DataFrame:
    """C7 ``gherkin_features``: feature files per repository, and their
    count."""
    from srcframe.sources.files import dedupe_by_path, files_of_kind
    f = dedupe_by_path(files_of_kind(files, "feature"))
    return f.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_features"))


def top_rows(rows: DataFrame, order: list[str], n: int = 10, text_col: str = "warning") -> DataFrame:
    """C8 ``top_warnings``: the first ``n`` rows per repository by
    ``order`` plus one row ``... and k more`` when there are more."""
    w = Window.partitionBy("repo_id").orderBy(*order)
    r = rows.withColumn("rank", F.row_number().over(w))
    head = r.where(F.col("rank") <= n).select("repo_id", "rank", F.col(text_col).alias("line"))
    more = rows.groupBy("repo_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > n) \
        .select("repo_id", F.lit(n + 1).alias("rank"),
                F.format_string("... and %d more", (F.col("_n") - n).cast("int")).alias("line"))
    return head.unionByName(more)


def project_summary(files: DataFrame, classes: DataFrame, eps: DataFrame) -> DataFrame:
    """C6 ``project_summary``: per repository the counts (classes,
    controllers, services, repositories, endpoints, REST, SOAP, features)
    and the summary text with the key technologies.  Each input is
    aggregated per repository first (partial aggregation), then the small
    per-repository rows are joined."""
    tool = build_tool(files)
    boot = spring_boot(files)
    feats = gherkin_features(files)
    cls = classes.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("n_classes"),
        F.count_if(F.lower("kind") == "controller").alias("n_controllers"),
        F.count_if(F.lower("kind") == "service").alias("n_services"),
        F.count_if(F.lower("kind") == "repository").alias("n_repositories"))
    ep = eps.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_endpoints"),
                                    F.count_if(F.upper("type") == "REST").alias("n_rest"),
                                    F.count_if(F.upper("type") == "SOAP").alias("n_soap"))
    j = cls.join(tool, "repo_id", "left").join(boot, "repo_id", "left").join(ep, "repo_id", "left") \
        .join(feats, "repo_id", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    ptype = F.coalesce(F.col("build_tool"), F.lit("Raw Source/Unknown"))
    is_boot = F.coalesce(F.col("is_spring_boot"), F.lit(False))
    ver = F.col("spring_boot_version")
    has_ver = ver.isNotNull() & (ver != "")
    tech = F.array_compact(F.array(
        F.when(ptype != "Raw Source/Unknown", ptype),
        F.when(is_boot, F.concat(F.lit("Spring Boot"), F.when(has_ver, F.concat(F.lit(" ("), ver, F.lit(")")))
                                 .otherwise(F.lit("")))),
        F.when(z("n_rest") > 0, F.lit("REST APIs")), F.when(z("n_soap") > 0, F.lit("SOAP Web Services")),
        F.when(z("n_repositories") > 0, F.lit("Data Repositories (e.g., Spring Data)")),
        F.when(z("n_services") > 0, F.lit("Service Layer"))))
    n = lambda c: z(c).cast("string")
    eps_txt = F.concat(
        F.lit("Exposes "), n("n_endpoints"), F.lit(" API endpoints."),
        F.when(z("n_rest") > 0, F.concat(F.lit(" ("), n("n_rest"), F.lit(" REST"))).otherwise(F.lit("")),
        F.when(z("n_soap") > 0, F.concat(F.when(z("n_rest") > 0, F.lit(", ")).otherwise(F.lit(" (")), n("n_soap"),
                                         F.lit(" SOAP"))).otherwise(F.lit("")),
        F.when((z("n_rest") > 0) | (z("n_soap") > 0), F.lit(").")).otherwise(F.lit("")), F.lit("\n"))
    text = F.concat(
        F.lit("Project Name: "), F.col("repo_id"), F.lit(". Type: "), ptype, F.lit(". "),
        F.when(F.size(tech) > 0, F.concat(F.lit("Key Technologies: "), F.array_join(tech, ", "), F.lit(". ")))
        .otherwise(F.lit("")),
        F.when(is_boot & has_ver, F.lit("")).when(is_boot, F.lit("Spring Boot: Yes (version not detected). "))
        .otherwise(F.lit("Spring Boot: No. ")),
        F.lit("Contains "), n("n_classes"), F.lit(" classes/interfaces/enums."),
        F.lit(" (Controllers: "), n("n_controllers"), F.lit(", Services: "), n("n_services"),
        F.lit(", Repositories: "), n("n_repositories"), F.lit(").\n"),
        eps_txt,
        F.when(z("n_features") > 0, F.concat(F.lit("Includes "), n("n_features"),
                                             F.lit(" Gherkin feature files for BDD testing.\n"))).otherwise(F.lit("")),
        F.lit("An OpenAPI (Swagger) specification is available for REST APIs.\n"))
    return j.select("repo_id", z("n_classes").alias("n_classes"), z("n_controllers").alias("n_controllers"),
                    z("n_services").alias("n_services"), z("n_repositories").alias("n_repositories"),
                    z("n_endpoints").alias("n_endpoints"), z("n_rest").alias("n_rest"), z("n_soap").alias("n_soap"),
                    text.alias("summary"))
