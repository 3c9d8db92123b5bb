"""A cursor export as a Spark data source, for batches and streams.

An export is a chain of pages: {"records": [...], "users": [...], "after_cursor": ...,
"end_of_stream": ...}. Pages come from a folder of page files (0.json, 1.json, ...) that executors can open,
or over HTTP, where calls are repeated on 429 and 5xx. The stream's offset is the
cursor, so Spark's checkpoint is the export's.
"""

from __future__ import annotations

import json
import math
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "id long, status string, subject string, requester_id long, requester_name string, updated_at string, complete boolean"


def fetch(url: str, attempts: int = 6, pause: float = 1.0) -> dict:
    """The JSON of a page; 429 and 5xx are tried again, as long as Retry-After says or twice as long each time."""
    for i in range(attempts):
        try:
            with urllib.request.urlopen(url, timeout=60) as reply:
                return json.load(reply)
        except urllib.error.HTTPError as e:
            if e.code != 429 and e.code < 500 or i == attempts - 1:
                raise
            time.sleep(float(e.headers.get("Retry-After") or pause * 2**i))
    raise AssertionError("unreachable")


def page(where: str, cursor: int | str) -> dict | None:
    """A page by its cursor, or None past the last one: its file, or the file that Spark wrote in the folder of that cursor."""
    if where.startswith(("http://", "https://")):
        return fetch(f"{where}?cursor={urllib.parse.quote(str(cursor), safe='')}")
    folder = Path(where.removeprefix("file://"))
    files = [f for f in (folder / f"{cursor}.json", *sorted((folder / f"cursor={cursor}").glob("part-*"))) if f.exists()]
    return json.loads(files[0].read_text()) if files else None


def following(found: dict, cursor: int | str) -> int | str | None:
    """The cursor after a page: the one that it names, else the next number; None after the end."""
    if found.get("after_cursor") is not None:
        return found["after_cursor"]
    if found.get("end_of_stream"):
        return None
    return int(cursor) + 1 if str(cursor).isdigit() else None


def rows_of(found: dict, complete: bool) -> Iterator[tuple]:
    """A page's records with their requesters' names; deleted ones go."""
    users = {u["id"]: u.get("name") for u in found.get("users", [])}
    for r in found["records"]:
        if r.get("status") != "deleted":
            yield (r["id"], r.get("status"), r.get("subject"), r.get("requester_id"), users.get(r.get("requester_id")), r.get("updated_at"), complete)


class _Batch(DataSourceReader):
    """One partition follows the cursors of the pages; several take numbered pages in turn, so a long export is read in parallel."""

    def __init__(self, where: str, start: int | str, most: float, parts: int):
        self.where, self.start, self.most, self.parts = where, start, most, parts
        if parts > 1 and not str(start).isdigit():
            raise ValueError("pages are read in parallel only where cursors are numbers")

    def partitions(self):
        return [InputPartition(i) for i in range(self.parts)]

    def read(self, partition):
        yield from self._chain() if self.parts == 1 else self._numbered(partition.value)

    def _chain(self):
        at, found = self.start, page(self.where, self.start)
        read = 0
        while found is not None:
            read, ended, at = read + 1, bool(found.get("end_of_stream")), following(found, at)
            later = None if ended or at is None or read >= self.most else page(self.where, at)
            yield from rows_of(found, ended or later is not None)
            found = later

    def _numbered(self, first: int):
        at = int(self.start) + first
        while at < int(self.start) + self.most and (found := page(self.where, at)) is not None:
            if not str(found.get("after_cursor", at + 1)).isdigit():
                raise ValueError("pages are read in parallel only where cursors are numbers")
            ended = bool(found.get("end_of_stream"))
            within = at + 1 < int(self.start) + self.most
            yield from rows_of(found, ended or within and page(self.where, at + 1) is not None)
            if ended:
                return
            at += self.parts


class _Stream(SimpleDataSourceStreamReader):
    """Offsets are cursors. A page that ends without a cursor keeps its own number's successor, where a later page would be."""

    def __init__(self, where: str, start: int | str, most: int):
        self.where, self.start, self.most = where, start, most

    def initialOffset(self):
        return {"cursor": self.start}

    def _after(self, found: dict, at: int | str):
        later = following(found, at)
        return later if later is not None or not str(at).isdigit() else int(at) + 1

    def read(self, start):
        out, at = [], start["cursor"]
        for _ in range(self.most):
            if at is None or (found := page(self.where, at)) is None:
                break
            out += rows_of(found, bool(found.get("end_of_stream")))
            at = self._after(found, at)
            if found.get("end_of_stream"):
                break
        return iter(out), {"cursor": at}

    def readBetweenOffsets(self, start, end):
        at = start["cursor"]
        while at is not None and at != end["cursor"] and (found := page(self.where, at)) is not None:
            yield from rows_of(found, bool(found.get("end_of_stream")))
            at = self._after(found, at)


class TicketExport(DataSource):
    """format("ticket_export") with options path, start (cursor), pages and parts.

    pages: the most of a read, which has no limit without it, or of a micro-batch, 1000
    without it; a stream goes on with the others. complete is false in rows of a page
    after which the export broke off without an end, or pages ended the read: a
    truncated export shows.
    """

    @classmethod
    def name(cls):
        return "ticket_export"

    def schema(self):
        return SCHEMA

    def _where(self, most: float):
        start = self.options.get("start", "0")
        return self.options["path"], int(start) if start.isdigit() else start, int(self.options["pages"]) if "pages" in self.options else most

    def reader(self, schema):
        return _Batch(*self._where(math.inf), int(self.options.get("parts", 1)))

    def simpleStreamReader(self, schema):
        return _Stream(*self._where(1000))
