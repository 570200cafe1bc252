"""Connection strings: source names, environment variables in them, and their parts as JDBC urls and options."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field
from urllib.parse import parse_qs, unquote, urlparse

ALIASES = {"": "postgresql", "postgres": "postgresql", "pg": "postgresql", "mariadb": "mysql", "mssql": "sqlserver", "sql_server": "sqlserver", "unity": "databricks", "dbt_manifest": "dbt"}
#: Names of character sets in urls that the driver calls otherwise.
CHARSETS = {"utf8": "UTF-8", "utf8mb3": "UTF-8", "utf8mb4": "UTF-8", "latin1": "ISO-8859-1", "ascii": "US-ASCII"}
SOURCES = ["postgresql", "mysql", "sqlserver", "snowflake", "duckdb", "databricks", "dbt", "osi", "csv", "parquet", "spark"]


def source_type(name: str | None) -> str:
    low = (name or "").strip().lower()
    return ALIASES.get(low, low)


def expand_env(text: str) -> str:
    """$NAME and ${NAME} by the environment; what isn't set stays as it is."""
    return re.sub(r"\$(?:\{(\w+)\}|(\w+))", lambda m: os.environ.get(m[1] or m[2], m[0]), text)


@dataclass(frozen=True)
class Target:
    """What Spark's JDBC reader needs, and the namespace to look at."""

    jdbc: str
    options: dict[str, str] = field(default_factory=dict)
    database: str | None = None
    namespace: str | None = None


def _split(url: str, schemes: tuple[str, ...]) -> tuple:
    parsed = urlparse(url or "")
    if parsed.scheme.lower() not in schemes or "://" not in (url or ""):
        raise ValueError(f"the connection string must start with {' or '.join(x + '://' for x in schemes)}")
    return parsed, unquote(parsed.username or ""), unquote(parsed.password or ""), {k: v[0] for k, v in parse_qs(parsed.query, keep_blank_values=True).items()}, [p for p in parsed.path.split("/") if p]


def jdbc_target(kind: str, url: str, namespace: str | None = None) -> Target:
    """The parts of a database's url. `public` as namespace stands for the database's default."""
    kind, namespace = source_type(kind), None if namespace in (None, "", "public") else namespace
    if kind == "postgresql":
        p, user, password, _, path = _split(url, ("postgresql", "postgres"))
        if not p.hostname or not path:
            raise ValueError("a host and a database are needed")
        return Target(f"jdbc:postgresql://{p.hostname}:{p.port or 5432}/{path[0]}", {"user": user, "password": password}, path[0], namespace or "public")
    if kind == "mysql":
        p, user, password, query, path = _split(url, ("mysql", "mariadb"))
        if not user or not p.hostname or not path:
            raise ValueError("a user, a host and a database are needed")
        charset = query.get("charset", "utf8").lower()
        return Target(f"jdbc:mysql://{p.hostname}:{p.port or 3306}/{path[0]}?characterEncoding={CHARSETS.get(charset, charset)}", {"user": user, "password": password}, path[0], namespace or path[0])
    if kind == "sqlserver":
        p, user, password, _, path = _split(url, ("mssql", "sqlserver"))
        if not user or not p.hostname or not path:
            raise ValueError("a user, a host and a database are needed")
        return Target(f"jdbc:sqlserver://{p.hostname}:{p.port or 1433};databaseName={path[0]}", {"user": user, "password": password}, path[0], namespace or "dbo")
    if kind == "snowflake":
        p, user, password, query, path = _split(url, ("snowflake",))
        if not user or not p.hostname or not path:
            raise ValueError("a user, an account and a database are needed")
        schema = (namespace or (path[1] if len(path) > 1 else "PUBLIC")).upper()
        more = {k: query[k] for k in ("warehouse", "role", "authenticator", "application") if k in query}
        return Target(f"jdbc:snowflake://{p.hostname}/", {"user": user, "password": password, "db": path[0], "schema": schema, **more}, path[0], schema)
    if kind == "databricks":
        p, _, password, query, _ = _split(url, ("databricks",))
        http, token = query.get("http_path", p.path), password or query.get("access_token", "")
        if not p.hostname or not http or not token:
            raise ValueError("a host, an http_path and a token are needed")
        return Target(f"jdbc:databricks://{p.hostname}:443;httpPath={http}", {"UID": "token", "PWD": token}, query.get("catalog", "main"), namespace or query.get("schema", "default"))
    if kind == "duckdb":
        path = url.removeprefix("duckdb://")
        if not path:
            raise ValueError("a database file is needed")
        return Target(f"jdbc:duckdb:{path}", {"duckdb.read_only": "true"}, path, namespace or "main")
    raise ValueError(f"unknown source type '{kind}'; known are {', '.join(SOURCES)}")
