"""WARC archives of web pages, and a globally ordered index of their captures.

Writing: every page becomes a record. Of pages with equal payloads the one with the
largest page_id is stored as a response, the others as revisits of it. Records are
laid out by SQL expressions and written by Spark's text writer, whose line separator
is the blank line pair that ends a record; so archives can lie in any store Spark
reaches. Reading: each archive is parsed by the lengths its headers give, and yields
a locally sorted run of captures. Runs are dealt by ranges of URL key and time, and
within a range a loser tree merges them, k ways, into capture histories.

Defined results: a null html is an empty payload; null urls stay null and sort first;
a null page_id counts as smaller than any other and never is revisited while another
has the same payload; rows that repeat the largest page_id are all responses; captures
of equal key and time are in order of page_id, archive and offset; pages of any length
are written whole, in archives bounded by their bytes; a capture's date is the epoch and
page_id modulo 2^31 seconds, in UTC whatever the session's zone; a url is read back as it
was given; other columns, whatever their names, are not read; an empty table writes no
records and gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenery.llm.common import materialise, shared_dir

VERSION = "WARC/1.1"
CRLF = "\r\n"
RECORD_END = "\r\n\r\n"
EPOCH = "2024-01-01 00:00:00"
ID = "urn:scenery:page:"
#: The url as given, in base 64, where WARC-Target-URI has to differ from it.
GIVEN_URL = "Scenery-Given-URL"
#: Bytes of payload that an archive holds at most, unless one payload is longer, and records.
BYTES_PER_FILE = 64 << 20
RECORDS_PER_FILE = 2048
ROWS_PER_RANGE = 100_000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_of_sha1(hex_digits: Column) -> Column:
    """The 40 hex digits of a SHA-1 in upper-case base 32: five hex digits make four."""
    group = lambda i: F.lpad(F.conv(F.substring(hex_digits, 1 + 5 * i, 5), 16, 32), 4, "0")
    return F.translate(F.concat(*[group(i) for i in range(8)]), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(pages: DataFrame, size_class: Column) -> DataFrame:
    """One row per page: its record, and the class of size that it is written with."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"), size_class.alias("size_class"))
    rows = rows.withColumn("digest", base32_of_sha1(F.sha1(F.col("payload").cast("binary"))))
    # Only payloads that occur more than once need a look-up; the table is as large as their number.
    shared = rows.groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    rows = rows.join(materialise(shared, "warc-shared"), "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    size = F.octet_length("payload").cast("string")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), size, F.lit(RECORD_END))
    rows = rows.withColumns({"revisit": revisit, "block": F.when(revisit, http).otherwise(F.concat(http, "payload"))})
    # A timestamp without zone, so that no session's zone can shift it.
    seconds = F.pmod(F.coalesce(F.col("page_id").cast("long"), F.lit(0)), F.lit(1 << 31)).cast("int")
    when = F.lit(EPOCH).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
    when = F.concat(F.replace(when.cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))
    uri = F.regexp_replace("url", r"[\x00-\x20]", "%20")
    name = lambda c: F.concat(F.lit(f"<{ID}"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    head = F.concat(
        F.lit(VERSION + CRLF),
        F.when(F.col("revisit"), f"WARC-Type: revisit{CRLF}WARC-Profile: {REVISIT_PROFILE}{CRLF}").otherwise(f"WARC-Type: response{CRLF}"),
        line("WARC-Record-ID", name(F.col("page_id"))),
        F.when(F.col("revisit"), line("WARC-Refers-To", name(F.col("first")))).otherwise(""),
        line("WARC-Date", when),
        F.coalesce(line("WARC-Target-URI", uri), F.lit("")),
        F.when(uri != F.col("url"), line(GIVEN_URL, F.replace(F.base64(F.col("url").cast("binary")), F.lit(CRLF), F.lit("")))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}"),
        line("Content-Length", F.octet_length("block").cast("string")),
        F.lit(CRLF),
    )
    return rows.select("size_class", F.concat(head, "block").alias("value"))


def write(pages: DataFrame, path: str) -> None:
    """Writes archives of at most RECORDS_PER_FILE records and about BYTES_PER_FILE bytes each.

    Payloads are written by classes of size, each with as many records to an archive as
    its longest allow.
    """
    size = F.octet_length(F.coalesce("html", F.lit("")))
    shift = F.greatest(F.lit(0), F.ceil(F.log2(size.cast("double") * RECORDS_PER_FILE / BYTES_PER_FILE)).cast("int"))
    steps = RECORDS_PER_FILE.bit_length() - 1
    shift = F.when(size == 0, 0).otherwise(F.least(shift, F.lit(steps)))
    found = [r["k"] for r in pages.select(shift.alias("k")).distinct().collect()]
    rows = records(pages, shift)
    for k in sorted(found) or [0]:
        out = rows.where(F.col("size_class") == k).select("value")
        out.write.mode("append").option("lineSep", RECORD_END).option("maxRecordsPerFile", RECORDS_PER_FILE >> k).text(path)


def url_key(url: str | None) -> str:
    """The host's labels in reverse, then path and query, in lower case, without scheme, www and fragment."""
    if url is None:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return url.strip().lower()
    labels = re.sub(r"^www\d*\.", "", host).split(".")
    place = ",".join(reversed(labels)) + (f":{port}" if port and port not in (80, 443) else "")
    return f"{place}){parts.path or '/'}" .lower() + (f"?{parts.query.lower()}" if parts.query else "")


def parse(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, headers and block of each record; lengths alone say where a record ends."""
    at, view = 0, memoryview(data)
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            raise ValueError(f"a record at {at} has no header end")
        lines = data[at:end].decode("utf-8").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record begins at {at}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        size = int(headers["Content-Length"])
        block = bytes(view[end + 4 : end + 4 + size])
        stop = end + 4 + size
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} is cut short")
        yield at, stop - at, headers, block
        at = stop + 4


RUN = "run string, url_key string, captured string, page_id long, url string, offset long, length long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _page(name: str | None) -> int | None:
    got = (name or "").strip("<>").removeprefix(ID)
    return int(got) if got.lstrip("-").isdigit() else None


def _captures(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            rows = []
            for offset, length, headers, block in parse(content):
                http, _, payload = block.partition(b"\r\n\r\n")
                size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                if headers["WARC-Type"] == "response":
                    found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    if (len(payload), found) != (size, digest):
                        raise ValueError(f"{path}: the payload at {offset} doesn't match its digest")
                url = headers.get("WARC-Target-URI")
                if GIVEN_URL in headers:
                    url = base64.b64decode(headers[GIVEN_URL]).decode()
                rows.append((path, url_key(url), headers["WARC-Date"], _page(headers["WARC-Record-ID"]), url, offset, length, size, digest, headers["WARC-Type"], _page(headers.get("WARC-Refers-To"))))
            rows.sort(key=_order)
            yield _frame(rows)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[x.split()[0] for x in RUN.split(", ")])
    return out.astype({"page_id": "Int64", "refers_to": "Int64"})


def _order(row: tuple) -> tuple:
    return row[1], row[2], -1 if row[3] is None else row[3], row[0], row[5]


class LoserTree:
    """Merges k sorted runs: a leaf per run, each inner node keeps the loser of its match.

    After the winner is taken only the matches from its leaf to the root are played
    again, one comparison a level.
    """

    def __init__(self, runs: list[list[tuple]]):
        self.runs = [iter(run) for run in runs]
        self.k = max(1, len(runs))
        self.head: list[tuple | None] = [self._next(i) for i in range(len(runs))] or [None]
        self.losers = [-1] * self.k
        for leaf in range(self.k):
            self._play(leaf)

    def _next(self, i: int) -> tuple | None:
        row = next(self.runs[i], None)
        return None if row is None else (_order(row), row)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        if x is None or y is None:
            return x is not None
        return (x[0], a) < (y[0], b)

    def _play(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other == -1:
                self.losers[node] = winner
                return
            if self._beats(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.head[self.losers[0]] is not None:
            winner = self.losers[0]
            yield self.head[winner][1]
            self.head[winner] = self._next(winner)
            self._play(winner)


def _merge(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Merges the slices of the runs that lie in one range, which arrive run by run and in order."""
    runs: dict[str, list[tuple]] = {}
    for batch in batches:
        for row in batch.astype(object).where(batch.notna(), None).itertuples(index=False, name=None):
            runs.setdefault(row[0], []).append(row)
    rows = []
    for row in LoserTree(list(runs.values())):
        rows.append(row)
        if len(rows) == 10_000:
            yield _frame(rows)
            rows = []
    yield _frame(rows)


def index(spark, path: str) -> DataFrame:
    """The captures of all archives below a path in order of URL key, time and page."""
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")
    runs = materialise(files.mapInPandas(_captures, RUN), "warc-runs")
    ranges = max(1, -(-runs.count() // ROWS_PER_RANGE))
    place = ["url_key", "captured", F.col("page_id").asc_nulls_first()]
    # Ranges of about ROWS_PER_RANGE captures bound what a merge holds; the offset parts captures that tie in all else.
    slices = runs.repartitionByRange(ranges, "url_key", "captured", "page_id", "run", "offset").sortWithinPartitions("run", *place, "offset")
    return slices.mapInPandas(_merge, RUN)


def archive(pages: DataFrame) -> DataFrame:
    """Writes the pages' archives to the shared folder, reads them back and indexes them."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/scenery/warc-{uuid.uuid4().hex}"
    write(pages, path)
    return index(spark, path)
