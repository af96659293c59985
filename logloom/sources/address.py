"""Source addresses, and what they open."""

import os
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame, SparkSession, functions as F

from logloom.parsers.registry import format_name, parse_rows
from logloom.parsers.rows import to_entries
from logloom.sources.detect import detect_first, formats_by_file
from logloom.sources.lines import LineScan, literal_path, source_name


@dataclass
class LogSource:
    """An opened source: text files still to be parsed, or a table of entries.

    ``scope`` says how ``auto`` finds the format: ``each`` looks at every file,
    ``first`` looks at the first one and reads all files with its format.
    """

    kind: str
    uri: str
    scan: LineScan | None = None
    table: DataFrame | None = None
    format: str = "auto"
    scope: str = "each"
    options: dict = field(default_factory=dict)

    def metadata(self) -> dict:
        return {"type": self.kind, "uri": self.uri, "profile": None, "region": None, "account_id": None}

    def lines(self) -> DataFrame:
        if self.scan is None:
            raise ValueError(f"{self.uri} is a table of entries and has no lines")
        return self.scan.numbered()

    def parts(self) -> list[tuple[LineScan, str]]:
        """A scan of the files of each format in use."""
        if self.format == "auto" and self.scope == "each":
            return self._parts_by_file()
        if self.format == "auto":
            first = literal_path(source_name(min(self.scan.raw.inputFiles())))
            text = self.scan.spark.read.option("lineSep", "\n").text(first)
            self.format = detect_first(text.withColumnRenamed("value", "line"))
        return [(self.scan, self.format)]

    def read(self, scan: LineScan, fmt: str) -> DataFrame:
        """Parsed but not yet numbered rows of a scan."""
        return parse_rows(scan.rows(), fmt, **self.options)

    def _parts_by_file(self):
        """One scan per format in use, over its own files only.

        The format is told by the first lines of a file; the rest of it is not read. The
        names are as many as the listing of the scan, which the driver holds in any case.
        """
        scan = self.scan
        files = scan.raw.inputFiles()
        found = formats_by_file(scan.spark, files)
        told = {source_name(f): fmt for f, fmt in found.items()}
        files = [source_name(f) for f in files]
        formats = {f: told.get(f, "plain") for f in files}
        if len(set(formats.values())) == 1:
            return [(scan, next(iter(formats.values())))]
        return [(scan.only([f for f in formats if formats[f] == name]), name) for name in sorted(set(formats.values()))]

    def entries(self, numbered: bool = True) -> DataFrame:
        """ENTRY rows of the whole source.

        Without ``numbered`` the line numbers and pointers are NULL, and the text is read
        once: numbers cost a pass over it, which counts and searches do not need.
        """
        if self.scan is None:
            return self.table
        number = LineScan.number if numbered else LineScan.unnumbered
        return reduce(DataFrame.unionByName, [to_entries(number(scan, self.read(scan, fmt))) for scan, fmt in self.parts()])


Opener = Callable[..., LogSource]
OPENERS: dict[str, Opener] = {}


def register_source(scheme: str, opener: Opener) -> None:
    """Add or replace what opens a scheme: ``opener(spark, uri, **options)``."""
    OPENERS[scheme] = opener


def _split_hint(uri: str) -> tuple[str, str | None]:
    path, _, query = uri.partition("?")
    hint = parse_qs(query).get("format", [None])[0]
    # A '?' that is no query is a glob character.
    return (path, hint) if not query or "=" in query else (uri, None)


def _open_text(spark, uri, format=None, scope="each", skip_missing=False, max_line_bytes=None, **options):
    path, hint = _split_hint(uri)
    if path.startswith("file://"):
        path = os.path.expanduser(path[len("file://"):])
    scan = LineScan(spark, path, skip_missing, max_line_bytes)
    kind = "s3" if path.startswith(("s3://", "s3a://")) else "local"
    return LogSource(kind, path, scan=scan, format=format_name(format or hint), scope=scope, options=options)


def _open_table(spark, uri, **_):
    return LogSource("table", uri, table=spark.table(uri.split("://", 1)[1]))


def _open_stored(spark, uri, **_):
    fmt, path = uri.split("://", 1)
    return LogSource("table", uri, table=spark.read.format(fmt).load(path))


for _scheme in ("file", "s3", "s3a", "hdfs", "abfss", "gs"):
    register_source(_scheme, _open_text)
register_source("table", _open_table)
for _scheme in ("parquet", "orc", "delta", "iceberg"):
    register_source(_scheme, _open_stored)


# A path whose tail reads @key=value: the parameters were meant to follow a question mark.
_AT_PARAMETER = re.compile(r"@[^?@=]*=")


def check_address(uri: str) -> None:
    """Refuse addresses that are surely mistyped."""
    parts = urlsplit(uri)
    if uri[:3] == "///":
        raise ValueError(f"{uri!r} has no scheme before its slashes")
    if parts.scheme and _AT_PARAMETER.search(parts.netloc + parts.path):
        raise ValueError(f"{uri!r}: parameters come after '?', as in path?key=value")


def open_source(spark: SparkSession, address, aliases: dict | None = None, **options) -> LogSource:
    """Open a path, glob, list of files, ``scheme://`` address or ``@alias``.

    Options: ``format`` (plain, json, syslog, java; else auto), ``scope``,
    ``skip_missing``, ``max_line_bytes``, and what the parser takes (``tz``, ``year``,
    ``default_date``).
    """
    if not isinstance(address, str):
        keep = {k: options.pop(k) for k in ("format", "scope", "max_line_bytes") if k in options}
        scan = LineScan(spark, list(address), skip_missing=True, max_line_bytes=keep.get("max_line_bytes"))
        return LogSource(
            "local", scan.label, scan=scan, format=format_name(keep.get("format")),
            scope=keep.get("scope", "each"), options=options,
        )
    if address.startswith("@"):
        known = aliases or {}
        if address[1:] not in known:
            raise KeyError(f"unknown source {address!r}; known: {', '.join(sorted(known)) or 'none'}")
        target = known[address[1:]]
        if isinstance(target, dict):
            options = {**{k: v for k, v in target.items() if k != "uri"}, **options}
            target = target["uri"]
        return open_source(spark, target, aliases, **options)
    check_address(address)
    if "://" not in address:
        path, _, query = address.partition("?")
        address = "file://" + os.path.abspath(os.path.expanduser(path)) + (f"?{query}" if query else "")
    scheme = address.split("://", 1)[0]
    if scheme not in OPENERS:
        raise ValueError(f"unknown source scheme {scheme!r} (available: {', '.join(sorted(OPENERS))})")
    return OPENERS[scheme](spark, address, **options)


def open_ptr(spark: SparkSession, ptr: str, metadata: dict | None = None, **options) -> LogSource:
    """The source a pointer points into; an opaque pointer needs its provenance."""
    if ptr.startswith(("file://", "s3://")):
        path = ptr.partition("#")[0]
        if path in ("file://", "s3://") or path.endswith("/"):
            raise ValueError(f"invalid pointer {ptr!r}")
        return open_source(spark, literal_path(path), **options)
    if ptr and "://" not in ptr:
        if not metadata or not metadata.get("uri"):
            raise ValueError("an opaque pointer needs the provenance of its source")
        return open_source(spark, metadata["uri"], **options)
    raise ValueError(f"unknown pointer type: {ptr!r}")
