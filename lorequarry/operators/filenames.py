"""Verdicts on files by their paths alone, before anything is opened, and the digest under which kept verdicts stay valid.

The globs below are compiled once by the ignore engine, so that a path costs one test per rule: a column expression inside
the scan, without a join.

Defined results: a null path has no finding; backslashes count as slashes; rules are asked in order and the first that fits
is named; an allowed template is never blocked by name.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorequarry.operators.ignore import regex_of

#: Suffixes of source code and prose, whose names alone condemn nothing where the content decides.
CODE_SUFFIXES = (
    ".py", ".pyi", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".go", ".rs", ".java", ".kt", ".kts", ".rb", ".php", ".cs", ".c", ".h", ".cc", ".cpp", ".hpp",
    ".m", ".mm", ".swift", ".scala", ".ex", ".exs", ".dart", ".lua", ".pl", ".r", ".vue", ".svelte", ".css", ".scss", ".sass", ".less", ".md", ".mdx", ".rst", ".adoc",
)
#: Templates, which pass by name.
ALLOWED = (
    "**/.env.example", "**/.env.sample", "**/.env.template", "**/.env.dist", "**/.env.test", "**/*.example", "**/*.sample", "**/*.template", "**/*.dist",
    "**/credentials.example*", "**/secrets.example*",
)
#: Fixed values: (rule, severity 1..4, the content decides, globs).
DENIED = (
    ("dotenv", 4, False, ("**/.env", "**/.env.*", "**/*.env")),
    ("pem", 4, False, ("**/*.pem", "**/*.p12", "**/*.pfx", "**/*.jks", "**/*.keystore", "**/*.asc")),
    ("private-key", 4, False, ("**/*.key", "**/*.ppk")),
    ("ssh-private-key", 4, False, ("**/id_rsa", "**/id_dsa", "**/id_ecdsa", "**/id_ed25519", "**/id_rsa.*", "**/id_ed25519.*", "**/.ssh/**")),
    ("credentials", 4, True, ("**/credentials", "**/credentials.*", "**/*credential*")),
    ("secrets", 4, True, ("**/secret", "**/secret.*", "**/secrets", "**/secrets.*", "**/*secrets*")),
    ("tokens", 4, True, (
        "**/token", "**/tokens", "**/token.txt", "**/token.json", "**/token.yaml", "**/token.yml", "**/token.toml", "**/tokens.txt", "**/tokens.json", "**/tokens.yaml",
        "**/tokens.yml", "**/tokens.toml", "**/*_token", "**/*-token", "**/*_tokens", "**/*-tokens", "**/*_token.*", "**/*-token.*", "**/*_tokens.*", "**/*-tokens.*",
    )),
    ("password-file", 4, True, ("**/password*", "**/passwd*", "**/.htpasswd")),
    ("shell-credentials", 4, False, ("**/.netrc", "**/_netrc", "**/.pgpass", "**/.my.cnf")),
    ("cloud-credentials", 4, False, (
        "**/.aws/**", "**/.gnupg/**", "**/.docker/config.json", "**/service-account*.json", "**/gcp-*.json", "**/aws-credentials*", "**/azure-credentials*",
    )),
    ("password-manager", 4, False, ("**/*.kdbx", "**/*.agilekeychain", "**/*.opvault")),
    ("terraform-state", 3, False, ("**/*.tfstate", "**/*.tfstate.backup", "**/*.tfvars")),
)


def fits(path: Column, globs: Iterable[str]) -> Column:
    """Whether one of the globs fits a path or a folder above it."""
    found = [r[0] for g in globs if (r := regex_of(g))]
    return path.rlike("|".join(f"(?:{x})" for x in found)) if found else F.lit(False)


def finding(path: Column, disabled: Iterable[str] = ()) -> Column:
    """struct(rule, severity) of the first rule that blocks a path by its name, else null."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    name = F.element_at(F.split(p, "/"), -1)
    dot = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    code = F.lower(dot).isin(*CODE_SUFFIXES)
    out = F.when(p.isNull() | fits(p, ALLOWED), F.lit(None).cast("struct<rule:string,severity:int>"))
    for rule, severity, decides, globs in DENIED:
        if rule not in set(disabled):
            out = out.when(fits(p, globs) & ~code if decides else fits(p, globs), F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity")))
    return out


def context(rules: Any, settings: Mapping[str, Any], versions: Mapping[str, Any]) -> str:
    """The digest of everything a verdict depends on besides the file: equal only under the same rules, settings and versions."""
    said = json.dumps({"rules": rules, "settings": dict(settings), "versions": dict(versions)}, sort_keys=True, default=lambda x: sorted(x) if isinstance(x, (set, frozenset)) else str(x))
    return hashlib.sha256(said.encode()).hexdigest()


def reusable(files: DataFrame, kept: DataFrame, now: str, full: bool = False) -> DataFrame:
    """files (path, size, modified, ...) with ``verdict`` and ``reused`` of kept rows (path, size, modified, context, verdict).

    A verdict holds for the same size and time of the same path under the same context; of repeated kept rows the least verdict
    by name is taken. A full run, a null or another context take none: those files have a null verdict and are read again.
    """
    valid = kept.where((F.col("context") == now) & F.lit(not full)).groupBy("path", "size", "modified").agg(F.min("verdict").alias("verdict"))
    return files.drop("verdict", "reused").join(valid, ["path", "size", "modified"], "left").withColumn("reused", F.col("verdict").isNotNull())
