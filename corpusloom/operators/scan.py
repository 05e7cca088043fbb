"""Line scans: search, secrets, log triage."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip

# --- fixed values -------------------------------------------------------------------------------------

#: Secret families in the order in which the first match names a line.
SECRETS = {
    "aws": r"AKIA[0-9A-Z]{16}",
    "pem": r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----",
    "google": r"AIza[0-9A-Za-z_\-]{35}",
    "slack": r"xox[baprs]-[0-9A-Za-z-]{10,}",
    "jwt": r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{6,}",
    "embedded": r"(?i)(?:api[_-]?key|secret|token|passwd|password|access[_-]?key)\s*[:=]\s*['\"][^'\"]{8,}['\"]",
}
#: Families of suspicious log lines; a line may be of several.
LOG_FAMILIES = {
    "failed_login": r"(?i)failed (?:password|login)|authentication failure|invalid user|login failed",
    "privilege": r"(?i)\bsudo\b|privilege escalation|added to group|Administrators",
    "http_error": r"\b(401|403|404|500)\b",
    "sql_injection": r"(?i)union\s+select|'\s*or\s*'1'='1|information_schema|sqlmap",
    "path_traversal": r"\.\./|\.\.\\",
    "command_injection": r"(?i);\s*(?:rm|cat|wget|curl|nc|bash)\b|\$\(|%0a",
    "scanner": r"(?i)nikto|nmap|masscan|/etc/passwd|cmd\.exe|/bin/sh|\.php\?",
}


def explode_lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no from 1, line)."""
    return df.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def search_pattern(spark: SparkSession, pattern: str) -> str:
    """A pattern as the engine's regular expressions have it, any case; one that is none, here or there, is looked for as it stands."""
    from py4j.protocol import Py4JJavaError

    java = spark._jvm.java.util.regex.Pattern
    try:
        re.compile(pattern)
        named = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern.replace("(?P<", "(?<"))
        java.compile(named)
    except (re.error, Py4JJavaError):
        named = java.quote(pattern)
    return f"(?iu){named}"


def grep(lines: DataFrame, pattern: str, order: Sequence[str], limit: int = 60, max_chars: int = 160) -> DataFrame:
    """The first matching lines, stripped and then cut."""
    hit = F.col("line").rlike(search_pattern(lines.sparkSession, pattern))
    return lines.where(hit).withColumn("line", F.substring(strip(F.col("line")), 1, max_chars)).orderBy(*order).limit(limit)


def first_family(c: Column, families: Mapping[str, str] = SECRETS) -> Column:
    out = None
    for name, pattern in families.items():
        out = F.when(c.rlike(pattern), name) if out is None else out.when(c.rlike(pattern), name)
    return out


def mask_secrets(c: Column, max_chars: int = 80, label: str = "***") -> Column:
    """Every match of every family replaced, and only then cut: nothing shows because it was unquoted or cut through."""
    for pattern in SECRETS.values():
        c = F.regexp_replace(c, pattern, label)
    return F.substring(c, 1, max_chars)


def scan_secrets(lines: DataFrame, order: Sequence[str], limit: int | None = 50) -> DataFrame:
    """The first lines that hold a secret, with its family and the line masked."""
    found = lines.withColumn("family", first_family(F.col("line"))).where("family IS NOT NULL").withColumn("line", mask_secrets(F.col("line")))
    return found if limit is None else found.orderBy(*order).limit(limit)


def log_triage(lines: DataFrame, order: Column, families: Mapping[str, str] = LOG_FAMILIES, max_chars: int = 160) -> DataFrame:
    """(family, n, example): lines of each family and the first of them, stripped and then cut. One pass; partial sums before the shuffle."""
    hits = F.array_compact(F.array(*[F.when(F.col("line").rlike(p), F.lit(n)) for n, p in families.items()]))
    rows = lines.select(F.explode(hits).alias("family"), order.alias("_o"), F.substring(strip(F.col("line")), 1, max_chars).alias("line"))
    return rows.groupBy("family").agg(F.count("*").alias("n"), F.min_by("line", "_o").alias("example"))
