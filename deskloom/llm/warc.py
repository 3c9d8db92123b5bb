"""WARC archives: writing, reading back, and merging the index of captures.

Archives are written by Spark's own writer, whose commit keeps exactly one copy of
every file when executors are lost. Reading an archive gives its index, sorted:
one capture run. Runs are cut at the same keys into ranges, and each range is
merged from its runs by a loser tree, so the histories of all URLs come out in one
global order by URL key, time and page.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deskloom.llm.shared import shared_dir, stored

#: Records of an archive at most and bytes after which it ends, captures of a range about, and keys that the driver sees to place the cuts.
RECORDS, BYTES, RANGE, CUTS_FROM = 5_000, 64 << 20, 20_000, 20_000
#: What ends a record, and what may stand between records.
END = "\r\n\r\n"
#: Fixed value: the time of page 0 in seconds since 1970; a page's own is its id later.
EPOCH = 1_704_067_200

INDEX = "urlkey string, captured string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long"


def url_key(url: str) -> str:
    """The host's labels reversed, then the rest: com,example,www)/path."""
    head, mark, rest = url.partition("://")
    if not mark:
        return url
    cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    return ",".join(reversed(rest[:cut].lower().split("."))) + ")" + rest[cut:].partition("#")[0]


def base32_digest(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def _header(text: str | None) -> str:
    """A header's value: one line."""
    return " ".join((text or "").split())


def _record(page_id: int, url: str | None, html: str | None, first: int | None) -> str:
    """A record of WARC 1.1 without the END that follows each."""
    raw = (html or "").encode("utf-8")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(raw)}\r\n\r\n"
    kind = "response" if first is None else "revisit"
    block = http + (html or "") if first is None else http
    when = pd.Timestamp(EPOCH + page_id, unit="s").strftime("%Y-%m-%dT%H:%M:%SZ") if 0 <= page_id < 1 << 32 else "9999-12-31T23:59:59Z"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {when}",
        f"WARC-Target-URI: {_header(url)}",
        f"WARC-Payload-Digest: sha1:{base32_digest(raw)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if first is not None:
        head += [f"WARC-Refers-To: <urn:page:{first}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join([*head, f"Content-Length: {len(block.encode('utf-8'))}", "", block])


def _records(most: int, full: int):
    """Each row's record, and the number of the task's archive that takes it: one ends after most records or full bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        archive = records = size = 0
        for batch in batches:
            firsts = batch["first"].astype("Int64")
            values, archives = [], []
            for p, u, h, f in zip(batch["page_id"], batch["url"], batch["html"], firsts, strict=True):
                values.append(_record(int(p), u, h, None if f is pd.NA else int(f)))
                archives.append(archive)
                records, size = records + 1, size + len(values[-1].encode("utf-8"))
                if records >= most or size >= full:
                    archive, records, size = archive + 1, 0, 0
            yield pd.DataFrame({"value": values, "archive": archives})

    return run


def first_captures(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, digest, first): for each page that revisits an equal payload, the smallest page_id with it. Payloads of under least bytes revisit nothing.

    Only pages whose payload is there twice are looked at again, so a payload that
    a third of the pages share meets in a minimum and a join, never in one group.
    """
    size = F.octet_length(F.coalesce("html", F.lit("")))
    digests = stored(pages.where(size >= least).select("page_id", _digest().alias("digest")), "digests")
    firsts = digests.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").drop("last")
    return digests.join(firsts, "digest").where("page_id > first").select("page_id", "digest", "first")


def _digest() -> Column:
    return F.sha1(F.coalesce("html", F.lit("")).cast("binary"))


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> None:
    """Writes a record for each of pages (page_id, url, html) to gzipped archives in folder. Rows without page_id can't be named and go.

    An archive ends after RECORDS records or BYTES bytes, so a task that reads one
    back holds BYTES and one page at most, however long pages are. A task's
    archives stand in folders archive=i.
    Revisits are listed in a table of their own, which Spark broadcasts if it is
    small by its files and joins by shuffle otherwise.
    """
    pages = pages.select("page_id", "url", "html").where("page_id IS NOT NULL")
    revisits = stored(first_captures(pages, least).distinct(), "revisits")
    rows = pages.withColumn("digest", _digest()).join(revisits, ["page_id", "digest"], "left")
    records = rows.mapInPandas(_records(RECORDS, BYTES), "value string, archive int")
    records.write.partitionBy("archive").option("lineSep", END).option("compression", "gzip").text(folder)


def parse_archive(raw: bytes, archive: str) -> list[tuple]:
    """An archive's index, from its uncompressed bytes, in the order of its records. Digests and sizes of responses are those of the payload read."""
    out, at = [], 0
    while at < len(raw):
        start, end = at, raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].decode("utf-8").split("\r\n")
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        block = raw[end + 4 : end + 4 + int(head["Content-Length"])]
        http, _, payload = block.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in http.decode("utf-8").split("\r\n")[1:])
        kind, page = head["WARC-Type"], int(head["WARC-Record-ID"][10:-1])
        first = int(head["WARC-Refers-To"][10:-1]) if kind == "revisit" else None
        digest = base32_digest(payload) if kind == "response" else head["WARC-Payload-Digest"].removeprefix("sha1:")
        if digest != head["WARC-Payload-Digest"].removeprefix("sha1:"):
            raise ValueError(f"{archive}: the payload of page {page} doesn't match its digest")
        size = len(payload) if kind == "response" else int(fields["Content-Length"])
        url = head["WARC-Target-URI"]
        out.append((url_key(url), head["WARC-Date"], page, url, size, digest, kind, first, archive, start))
        at = end + 4 + len(block) + 4
    return out


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            rows = parse_archive(gzip.decompress(content), "/".join(path.split("/")[-2:]))
            rows.sort(key=lambda r: r[:3])
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in INDEX.split(", ")]).astype({"refers_to": "Int64"})


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The index of all archives in folder; an archive's rows stand together, sorted by URL key, time and page: one run."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", True).load(folder).select("path", "content")
    return files.mapInPandas(_runs, INDEX)


class LoserTree:
    """A tournament of k runs of (key, value), each sorted by key: inner nodes hold losers, and a new head plays only on the way to its root."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.heads = [next(r, None) for r in runs]
        self.losers = [-1] * len(runs)
        for i in range(len(runs)):
            self._play(i)

    def _before(self, a: int, b: int) -> bool:
        if self.heads[a] is None or self.heads[b] is None:
            return self.heads[a] is not None
        return self.heads[a][0] <= self.heads[b][0]

    def _play(self, winner: int) -> None:
        node = (winner + len(self.runs)) // 2
        while node:
            loser = self.losers[node]
            if loser < 0:  # still being filled: wait here for the other side
                self.losers[node] = winner
                return
            if self._before(loser, winner):
                self.losers[node], winner = winner, loser
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.runs and self.heads[self.losers[0]] is not None:
            top = self.losers[0]
            yield self.heads[top]
            self.heads[top] = next(self.runs[top], None)
            self._play(top)


def _chunks(cuts: list[tuple]):
    """Each run in pieces between the cuts: (range, run, rows as lists)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, rows in batch.groupby("archive", sort=False):
                keys = list(zip(rows["urlkey"], rows["captured"], rows["page_id"]))
                at = [0, *(bisect_left(keys, c) for c in cuts), len(keys)]
                places = [(i, a, b) for i, (a, b) in enumerate(zip(at, at[1:])) if a < b]
                yield pd.DataFrame(
                    {
                        "range": [i for i, _, _ in places],
                        "run": archive,
                        **{c: [rows[c].iloc[a:b].tolist() for _, a, b in places] for c in ("urlkey", "captured", "page_id", "place")},
                    }
                )

    return run


def _merge(pieces: pd.DataFrame) -> pd.DataFrame:
    pieces = pieces.sort_values("run")
    columns = (pieces[c] for c in ("urlkey", "captured", "page_id", "place"))
    rows = list(LoserTree([zip(zip(u, t, p), place) for u, t, p, place in zip(*columns)]))
    out = pd.DataFrame([key for key, _ in rows], columns=["urlkey", "captured", "page_id"])
    for c in ("url", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "offset"):
        out[c] = [place[c] for _, place in rows]
    return out.assign(range=int(pieces["range"].iloc[0]), position=range(len(out))).astype({"refers_to": "Int64"})


def merge_runs(index: DataFrame) -> DataFrame:
    """index in the global order by URL key, time and page: range and position number it.

    The cuts come from a sample of keys whose size has a bound; they only decide how
    even the ranges are. A key is the URL, the time and the page, so captures of
    one URL can lie in many ranges. One row of a shuffle is a piece of a run.
    """
    total = index.count()
    key = ["urlkey", "captured", "page_id"]
    sample = index.select(*key).sample(min(1.0, CUTS_FROM / 2 / max(total, 1)), seed=1).limit(CUTS_FROM).collect()
    keys, n = sorted(tuple(r) for r in sample), max(1, -(-total // RANGE))
    cuts = sorted({keys[len(keys) * i // n] for i in range(1, n)}) if keys else []
    place = F.struct("url", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "offset")
    rows = index.select(*key, "archive", place.alias("place"))
    kind = "struct<url:string,payload_bytes:bigint,payload_digest:string,record_type:string,refers_to:bigint,archive:string,offset:bigint>"
    pieces = rows.mapInPandas(_chunks(cuts), f"range int, run string, urlkey array<string>, captured array<string>, page_id array<long>, place array<{kind}>")
    merged = pieces.groupBy("range").applyInPandas(_merge, f"range int, position int, {INDEX}")
    return merged


def archive_pages(pages: DataFrame, least: int = 0) -> DataFrame:
    """The merged capture index of pages (page_id, url, html), written as archives in the shared folder and read back.

    A null html is an empty payload, a null url an empty one. Of equal payloads of
    at least least bytes, the smallest page_id is the response; pages that repeat
    that id are responses too. Empty tables give an empty index.
    """
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, folder, least)
    return merge_runs(stored(read_archives(spark, folder), "index"))
