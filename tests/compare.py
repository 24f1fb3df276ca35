"""Rows as sorted text, so results of two engines can be held against each other."""

from __future__ import annotations


def text(v) -> str:
    if v is None or v != v:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(text, v)) + "]"
    return str(v)


def rows(found, columns) -> list[tuple[str, ...]]:
    return sorted(tuple(text(r[c]) for c in columns) for r in found)


def spark_rows(df) -> tuple[list[str], list[tuple[str, ...]]]:
    columns = sorted(df.columns)
    return columns, rows([r.asDict() for r in df.collect()], columns)


def duck_rows(con, sql: str) -> tuple[list[str], list[tuple[str, ...]]]:
    rel = con.sql(sql)
    names = rel.columns
    return sorted(names), rows([dict(zip(names, r, strict=True)) for r in rel.fetchall()], sorted(names))
