"""Sensitive-data scan (section D): every non-overlapping match of every
pattern in every line, with 1-based line and column.

Plan shape: scan → explode lines → length guard → one cheap ``rlike`` over
the joined alternation (cold lines cost one regex) → per pattern
``regexp_extract_all`` + ``split`` → positions by the split/extract identity
→ ``explode``.  All of it is one map-only stage with no Python worker and no
exchange; only reports (counts) aggregate, with partial aggregation.

Column identity: for matches ``m[0..k)`` and the pieces between them
``g = split(line, p, -1)``, match ``i`` starts at
``1 + Σ len(g[0..i]) + Σ len(m[0..i))``.  This needs a pattern that cannot
match the empty string, which ``validate_patterns`` enforces.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from srcframe.functions.text import WB_L, WB_R
from srcframe.sources.files import explode_lines, filter_scannable

MAX_LINE_LENGTH = 20000  # fixed value; a scan has no limit unless asked for one

# ---------------------------------------------------------------------------
# Keyword lists of the default catalog (PII, PCI, general), in
# the reference's order.  They are matched as whole words.
# ---------------------------------------------------------------------------
PII_KEYWORDS = (
    "ssn|socialsecurity|social_security_number|socsec|driverlicense|driver_license|dl|licnum|"
    "passportnumber|passport_number|nationalid|national_id|healthrecord|medicalrecord|health_record|"
    "medical_record|ehr|emr|biometric|geolocation|ipaddress|ip_address|deviceid|device_id|cookieid|"
    "cookie_id|macaddress|mac_address|imei|imsi|ethereumaddress|eth_address|bitcoinaddress|btc_address|"
    "cryptowallet|crypto_wallet|privatekey|priv_key|seedphrase|seed_phrase|email|e-mail|mailaddr|phone|"
    "phoneno|phnno|telephone|contactnum|address|addr|streetaddr|homeaddr|dob|dateofbirth|birthdate|"
    "mother's maiden name|mothersmaidenname|mmn|username|user_name|uname|userid|user_id|uid|firstname|"
    "first_name|fname|firstnm|lastname|last_name|lname|lastnm|fullname|full_name|name|credential|"
    "credentials|personalinfo|personal_info|citizenid|citizen_id|voterid|voter_id|taxid|taxpayerid|tin|"
    "licenseplate|license_plate|vin|vehicleidentificationnumber"
).split("|")
PCI_KEYWORDS = (
    "creditcard|credit_card|cardnum|card_num|cardnbr|ccnum|ccn|cvv|cvc|csc|cardverification|"
    "verificationcode|securitycode|cardsecuritycode|pan|primaryaccountnumber|primary_account_number|"
    "cardholder|card_holder_name|expdate|expirationdate|exp_date|expirydate|trackdata|track_data|"
    "magstripe|magnetic_stripe|pinblock|pin_block|servicecode|service_code|cardnumber|"
    "paymentaccountnumber|payment_account_number|accountnum|acctnum|iban|internationalbankaccountnumber|"
    "bankaccount|bank_account|routingnumber|routing_number|achdata|ach_data|wiretransfer|wire_transfer|"
    "financialdata|financial_info|paymentinfo|payment_info|vcn|virtualcardnumber|virtual_card_number|"
    "tokenizedcard|tokenized_card"
).split("|")
GENERAL_KEYWORDS = ["password", "passwd", "secret", "token", "apikey"]


@dataclass(frozen=True)
class Pattern:
    """One named pattern.  ``body`` is written in the common subset of Java
    regex and RE2; ``bounded`` wraps it in ASCII word boundaries."""
    name: str
    body: str
    bounded: bool = False
    case_insensitive: bool = False
    nullable: bool = False  # may match the empty string: set by ``validate_patterns``

    @property
    def java(self) -> str:
        b = f"{WB_L}(?:{self.body}){WB_R}" if self.bounded else self.body
        return f"(?i:{b})" if self.case_insensitive else b

    @property
    def re2(self) -> str:
        b = f"\\b(?:{self.body})\\b" if self.bounded else self.body
        return f"(?i:{b})" if self.case_insensitive else b


def keyword_pattern(name: str, words: list[str], case_insensitive: bool = False) -> Pattern:
    # the words hold only letters, digits, ``_``, ``-``, ``'`` and spaces:
    # literal in both regex dialects
    assert all(re.fullmatch(r"[A-Za-z0-9_' -]+", w) for w in words)
    return Pattern(name, "|".join(words), bounded=True, case_insensitive=case_insensitive)


def default_catalog() -> list[Pattern]:
    """D1 ``pattern_catalog``: the configured families become ``PII_<key>``
    and ``PCI_<key>``.  Whole-repo scans are case-sensitive (K2)."""
    return [keyword_pattern("PII_ALL_PII", PII_KEYWORDS), keyword_pattern("PCI_ALL_PCI", PCI_KEYWORDS)]


def log_catalog() -> list[Pattern]:
    """The three keyword families of the log scan, case-insensitive."""
    return [keyword_pattern("PII", PII_KEYWORDS, True), keyword_pattern("PCI", PCI_KEYWORDS, True),
            keyword_pattern("GENERAL", GENERAL_KEYWORDS, True)]


def flagship_catalog() -> list[Pattern]:
    """D2 custom map used by the flagship query: concrete values next to the
    keyword families."""
    return [
        Pattern("PII_EMAIL", r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"),
        Pattern("PII_IPV4", r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}", bounded=True),
        Pattern("PCI_CARD_NUMBER", r"[0-9]{13,16}", bounded=True),
        Pattern("SECRET_TOKEN", r"token[ \t]*=[ \t]*\"[0-9a-fA-F]+\"", case_insensitive=True),
    ] + default_catalog()


#: signs of a pattern that may match without taking a character
ZERO_WIDTH = re.compile(r"\(\?<?[=!]|\\[bBAZzG]|[\^$]")


def checked_patterns(spark: SparkSession, patterns: list[Pattern]) -> tuple[list[Pattern], list[tuple[str, str]]]:
    """D1: patterns that compile on the JVM, and (name, reason) of those that do
    not.  A pattern that may match the empty string stays: its empty matches are
    left out, its others count."""
    compiler = spark._jvm.java.util.regex.Pattern
    good, bad = [], []
    for p in patterns:
        try:
            empty = compiler.compile(p.java).matcher("").find()
            good.append(replace(p, nullable=empty or (not p.bounded and ZERO_WIDTH.search(p.body) is not None)))
        except Exception as e:  # the reason goes into the warning row
            bad.append((p.name, str(getattr(e, "java_exception", e)).splitlines()[0]))
    return good, bad


def pattern_warnings(spark: SparkSession, patterns: list[Pattern]) -> DataFrame:
    """``(pattern, reason)``: a row per pattern that does not compile."""
    return spark.createDataFrame(checked_patterns(spark, patterns)[1], "pattern string, reason string")


def validate_patterns(spark: SparkSession, patterns: list[Pattern]) -> list[Pattern]:
    """The patterns that a scan can run (``pattern_warnings`` has the others)."""
    return checked_patterns(spark, patterns)[0]


FINDING = T.StructType([
    T.StructField("finding_type", T.StringType()),
    T.StructField("column_no", T.IntegerType()),
    T.StructField("matched_text", T.StringType()),
])


def match_spans(line: Column, p: Pattern) -> Column:
    """Array of (finding_type, column_no, matched_text) for one pattern, by
    the split/extract identity in one ``aggregate`` pass."""
    from srcframe.operators.facts import spans
    rx = p.java
    if p.nullable:  # matches between noncharacters, empty ones taken out, then positions without the signs
        a, z = "\ufdd0", "\ufdd1"
        marked = F.replace(F.regexp_replace(line, F.lit(rx), F.lit(f"{a}$0{z}")), F.lit(a + z), F.lit(""))
        return F.transform(spans(marked, f"{a}[^{a}{z}]+{z}"), lambda x, k: F.struct(
            F.lit(p.name).alias("finding_type"), (x["start"] - 2 * k).cast("int").alias("column_no"),
            F.substr(x["text"], F.lit(2), F.length(x["text"]) - 2).alias("matched_text")))
    sp = F.transform(spans(line, rx), lambda x: F.struct(
        F.lit(p.name).alias("finding_type"), x["start"].alias("column_no"), x["text"].alias("matched_text")))
    return F.when(line.rlike(rx), sp).otherwise(F.array().cast(T.ArrayType(FINDING)))


def scan_lines(lines: DataFrame, patterns: list[Pattern], max_len: int | None = None,
               keep: tuple[str, ...] = ("repo_id", "path", "line_no")) -> DataFrame:
    """D3 + D4 ``scan_findings``; with ``max_len``, longer lines are skipped
    (``skipped_lines`` lists them)."""
    schema_out = list(keep) + ["finding_type", "column_no", "matched_text"]
    if not patterns:
        # D2: an empty pattern set gives an empty result with the same schema
        return lines.select(*keep, F.lit(None).cast("string").alias("finding_type"),
                            F.lit(None).cast("int").alias("column_no"),
                            F.lit(None).cast("string").alias("matched_text")).where(F.lit(False))
    line = F.col("line")
    any_rx = "|".join(f"(?:{p.java})" for p in patterns)
    cand = lines if max_len is None else lines.where(F.length(line) <= max_len)
    cand = cand.where(line.rlike(any_rx))
    arr = F.flatten(F.array(*[match_spans(line, p) for p in patterns]))
    return cand.select(*keep, F.explode(arr).alias("f")).select(*keep, "f.*").select(*schema_out)


def skipped_lines(lines: DataFrame, max_len: int = MAX_LINE_LENGTH) -> DataFrame:
    """D4 + A10: a warning row for every line that a scan with ``max_len`` skips."""
    return lines.where(F.length("line") > max_len).select(
        "repo_id", "path", "line_no", F.concat(F.lit("line of "), F.length("line"), F.lit(" characters skipped"))
        .alias("warning"))


def scan_files(files: DataFrame, patterns: list[Pattern], max_len: int | None = None) -> DataFrame:
    """A2 → A6 → D4 → D3: ``findings(repo_id, path, line_no, column_no,
    finding_type, matched_text)``."""
    lines = explode_lines(filter_scannable(files))
    return scan_lines(lines, patterns, max_len).select(
        "repo_id", "path", "line_no", "column_no", "finding_type", "matched_text")


def search_findings(findings: DataFrame, term: str) -> DataFrame:
    """D5 ``search_findings``: case-insensitive substring over path, type
    and matched text; an empty term keeps everything."""
    if not term:
        return findings
    t = F.lower(F.lit(term))
    return findings.where(F.lower("path").contains(t) | F.lower("finding_type").contains(t)
                          | F.lower("matched_text").contains(t))


def finding_preview(text: Column, n: int = 50) -> Column:
    """D6 ``finding_preview``: first ``n`` characters plus ``...``."""
    return F.concat(F.substring(text, 1, n), F.when(F.length(text) > n, F.lit("...")).otherwise(F.lit("")))


def finding_family(finding_type: Column) -> Column:
    """D7 ``finding_family``: PII → error, PCI → warning, else default."""
    return (F.when(F.startswith(finding_type, F.lit("PII")), F.lit("error"))
            .when(F.startswith(finding_type, F.lit("PCI")), F.lit("warning"))
            .otherwise(F.lit("default")))


def finding_counts(findings: DataFrame) -> DataFrame:
    """D8 ``finding_counts``: per repository, family and type, with the
    per-family and per-repository totals (``rollup``).  Partial aggregation
    runs before the shuffle, so a hot repository sends one row per task."""
    return (findings.withColumn("family", finding_family(F.col("finding_type")))
            .rollup("repo_id", "family", "finding_type")
            .agg(F.count(F.lit(1)).alias("n_findings"))
            .where(F.col("repo_id").isNotNull()))
