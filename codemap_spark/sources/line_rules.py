"""Symbols and relations by rules over lines.

A rule says what a line of a language that matches its pattern declares.  Files
are cut into lines and rules applied in column expressions, so no Python runs;
which rules a project uses is its own choice.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F


class Rule(NamedTuple):
    """``pattern``'s first group is the name.  ``what`` is symbol or relation;
    ``target_type`` and ``confidence`` are a relation's."""

    language: str
    what: str
    kind: str
    pattern: str
    target_type: str | None = None
    confidence: float = 1.0


def extracted(files: DataFrame, rules: list[Rule] | tuple[Rule, ...]) -> DataFrame:
    """path, what, kind, target_type, name, line, confidence, signature of all
    files (path, language, content).

    Lines count from 1; null contents have none.  Every match of a pattern in a
    line gives a row; a symbol's signature is its line, trimmed."""
    text = lambda x: F.lit(x).cast("string")

    def said(r: Rule):
        own = (text(r.what).alias("what"), text(r.kind).alias("kind"), text(r.target_type).alias("target_type"), F.lit(float(r.confidence)).alias("confidence"))
        names = F.regexp_extract_all("text", F.lit(r.pattern), F.lit(1))
        return F.when(F.col("language") == r.language, F.transform(names, lambda name: F.struct(*own, name.alias("name"))))

    found = [said(r) for r in rules]
    languages = sorted({r.language for r in rules})
    lines = files.where(F.col("language").isin(languages)).select("path", "language", F.posexplode(F.split("content", r"\r?\n")).alias("at", "text"))
    every = lines.select("path", "at", "text", F.explode(F.flatten(F.array_compact(F.array(*found)))).alias("x")).where("x.name <> ''")
    signature = F.when(F.col("x.what") == "symbol", F.trim("text"))
    return every.select("path", "x.what", "x.kind", "x.target_type", "x.name", (F.col("at") + 1).cast("int").alias("line"), "x.confidence", signature.alias("signature"))
