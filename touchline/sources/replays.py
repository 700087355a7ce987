"""Replay of archived pages through a registry of parsers (S-17, UDF-03, UDF-04).

A parser is a plain function of ``(html, url)`` that yields rows (dicts of text). The
registry picks one for each page by the first pattern that its URL matches; a table
function runs it, and a parser that fails costs its page an error row, nothing else.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..functions.classify import first_match

Parser = Callable[[str, str], Iterable[dict]]


class Registry:
    """Patterns with the parsers they pick, in order; ``None`` marks one that cannot be replayed."""

    def __init__(self):
        self.rules: list[tuple[str, str, Parser | None]] = []

    def register(self, pattern: str, name: str | None = None, replayable: bool = True):
        """Decorator: the parser of URLs that match ``pattern``, any case."""

        def add(parser: Parser) -> Parser:
            self.rules.append((f"(?i){pattern}", name or parser.__name__, parser if replayable else None))
            return parser

        return add

    def parsers(self) -> dict[str, Parser]:
        return {name: parser for _, name, parser in self.rules if parser is not None}


def page_parser(parsers: dict[str, Parser]):
    """The table function ``(parser, url, html, fields)``; ``fields``, a constant, gives its columns (``analyze``)."""

    class ParsePage:
        @staticmethod
        def analyze(parser: AnalyzeArgument, url: AnalyzeArgument, html: AnalyzeArgument, fields: AnalyzeArgument) -> AnalyzeResult:
            if not fields.isConstantExpression or not fields.value:
                raise ValueError("the fields must be a constant list of names")
            schema = StructType().add("row_no", IntegerType()).add("error", StringType())
            for name in fields.value.split(","):
                schema = schema.add(name, StringType())
            return AnalyzeResult(schema=schema)

        def eval(self, parser: str, url: str, html: str, fields: str):
            columns = fields.split(",")
            blank = (None,) * len(columns)
            try:
                rows = [tuple(None if row.get(c) is None else str(row[c]) for c in columns) for row in parsers[parser](html or "", url or "")]
            except Exception as e:  # kept apart: the other pages go on
                yield (-1, f"{type(e).__name__}: {e}", *blank)
                return
            for n, row in enumerate(rows):
                yield (n, None, *row)

    return F.udtf(ParsePage)


def replay(pages: DataFrame, registry: Registry, fields: list[str], key: str = "page_id", url: str = "url", html: str = "html") -> tuple[DataFrame, DataFrame]:
    """The rows of all pages (``key, parser, row_no, fields...``) and the errors (``key, parser, error``).

    Pages that no parser takes, or one that cannot be replayed, give neither.
    """
    picked = first_match(F.col(url), [(p, n) for p, n, _ in registry.rules])
    parsers = registry.parsers()
    ready = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), F.col(html).alias("_html"), picked.alias("parser")).where(F.col("parser").isin(*parsers))
    run = ready.lateralJoin(page_parser(parsers)(F.col("parser").outer(), F.col("_url").outer(), F.col("_html").outer(), F.lit(",".join(fields))))
    rows = run.where("error IS NULL").select(F.col("_key").alias(key), "parser", "row_no", *fields)
    return rows, run.where("error IS NOT NULL").select(F.col("_key").alias(key), "parser", "error")


def summary(pages: DataFrame, registry: Registry, rows: DataFrame, errors: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """``parser, outcome, pages, rows, errors`` for each parser; pages that none takes are ``unmatched``."""
    picked = F.coalesce(first_match(F.col(url), [(p, n) for p, n, _ in registry.rules]), F.lit("unmatched"))
    seen = pages.groupBy(picked.alias("parser")).agg(F.count("*").alias("pages"))
    made = rows.groupBy(F.col("parser").alias("_p")).agg(F.count("*").alias("rows"))
    failed = errors.groupBy(F.col("parser").alias("_q")).agg(F.count("*").alias("errors"))
    out = seen.join(made, seen["parser"] == made["_p"], "left").join(failed, seen["parser"] == failed["_q"], "left")
    outcome = F.when(F.col("parser") == "unmatched", "no parser").when(F.col("parser").isin(*registry.parsers()), "replayed").otherwise("not replayable")
    return out.select("parser", outcome.alias("outcome"), "pages", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("errors", F.lit(0)).alias("errors"))
