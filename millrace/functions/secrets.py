"""Secrets by key and value: detection, masking and redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of secrets, the first that matches names the kind.
VALUES = {
    "private key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "access key": r"\b(AKIA|ASIA)[0-9A-Z]{16}\b",
    "jwt": r"\beyJ[\w-]{10,}\.[\w-]{10,}\.[\w-]{5,}",
    "connection string": r"\b[a-z][a-z0-9+]*://[^\s/:@]+:[^\s@]+@|AccountKey=[\w+/=]{20,}",
    "sas token": r"[?&]sig=[\w%+/=-]{16,}",
    "token": r"\b(ghp|gho|xoxb|xoxp|sk)[-_][\w-]{16,}",
}
KEYS = {
    "secret key": r"secret_?access_?key|secret_?key$",
    "session token": r"session_?token",
    "token": r"(^|_)token$",
    "password": r"passw(or)?d|passphrase|api_?key|client_?secret|auth_?token",
}
METADATA = r"(expir|age|policy|length|arn|_?id|enabled|rotation|version|count|type)$"
MASKED = r"^(\*+|x{3,}|<.*>|\[redacted.*\]|\$\{.*\}|\{\{.*\}\}|ref:|arn:|none|null|true|false)"


def secret_kind(key: Column, value: Column, rules: dict[str, tuple[str, str]] | None = None) -> Column:
    """The kind of secret that a key and text value show, or NULL (O1, O2).

    rules: custom kinds as (key pattern, value pattern), tried first (O3).
    """
    return kind_by(plain_key(key), value, rules)


def plain_key(key: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(key, F.lit("")), r"[\s-]", "_"))


def kind_by(k: Column, value: Column, rules: dict[str, tuple[str, str]] | None = None) -> Column:
    """`secret_kind` by a `plain_key`."""
    plain = value.isNotNull() & (F.trim(value) != "") & ~F.lower(value).rlike(MASKED)
    out = F.when(~plain, None)
    for kind, (key_pattern, value_pattern) in (rules or {}).items():
        out = out.when(k.rlike(key_pattern) & value.rlike(value_pattern), kind)
    for kind, pattern in VALUES.items():
        out = out.when(value.rlike(pattern), kind)
    for kind, pattern in KEYS.items():
        out = out.when(k.rlike(pattern) & ~k.rlike(METADATA) & (F.char_length(value) >= 4), kind)
    return out


#: A key and its value in a line of text: `key = "value"`, `key: value`.
ASSIGNED = r"""([A-Za-z_][A-Za-z0-9_.-]*)["']?\s*[:=]\s*["']?([^\s"',;]{4,})"""


def line_secret(line: Column) -> Column:
    """The kind of secret in a line of text: by its form anywhere, else that of the first assigned value that is one (O1)."""
    keys, values = (F.regexp_extract_all(line, F.lit(ASSIGNED), i) for i in (1, 2))
    assigned = F.filter(F.zip_with(keys, values, lambda k, v: secret_kind(k, v)), lambda k: k.isNotNull())
    return F.coalesce(secret_kind(F.lit(""), line), F.when(line.rlike("[:=]"), F.get(assigned, F.lit(0))))


def mask(c: Column) -> Column:
    """Stars, with the last four characters of values of 12 or more."""
    return F.when(F.char_length(c) >= 12, F.concat(F.lit("********"), F.substring(c, -4, 4))).otherwise("********")


def redact_text(c: Column) -> Column:
    """Every secret of a recognised form, and every value assigned to a secret's key, replaced by [REDACTED kind]."""
    for kind, pattern in VALUES.items():
        c = F.regexp_replace(c, pattern, f"[REDACTED {kind}]")
    for kind, pattern in KEYS.items():
        key = pattern.replace("(", "(?:").replace("$", "").replace("^|_", r"\b|[_-]")
        c = F.regexp_replace(c, rf"""(?i)((?:{key})["']?\s*[:=]\s*["']?)(?!{MASKED[1:]})[^\s"',;]{{4,}}""", f"$1[REDACTED {kind}]")
    return c
