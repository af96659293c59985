"""Parsers by format name. Unknown formats read as plain text."""

from collections.abc import Callable

from pyspark.sql import DataFrame

from logloom.parsers.java import parse_java
from logloom.parsers.json import parse_json
from logloom.parsers.plain import parse_plain
from logloom.parsers.rows import to_entries
from logloom.parsers.syslog import parse_syslog
from logloom.plans.ordered import CHUNK_LINES, chunked

Parser = Callable[..., DataFrame]

PARSERS: dict[str, Parser] = {
    "plain": parse_plain,
    "json": parse_json,
    "syslog": parse_syslog,
    "java": parse_java,
}


def register_parser(name: str, parser: Parser) -> None:
    """Add or replace the parser of a format."""
    PARSERS[name.lower()] = parser


def format_name(hint: str | None) -> str:
    """S3: the format a hint names, in any case; anything else means ``auto``."""
    name = (hint or "").lower()
    return name if name in PARSERS else "auto"


def parse_rows(rows: DataFrame, fmt: str, **options) -> DataFrame:
    return PARSERS.get(fmt, parse_plain)(rows, **options)


def parse_lines(lines: DataFrame, fmt: str = "plain", chunk_lines: int = CHUNK_LINES, **options) -> DataFrame:
    """LINES (source, line_no, line) to ENTRY rows."""
    rows = parse_rows(chunked(lines, chunk_lines), fmt, **options)
    return to_entries(rows, "pos")
