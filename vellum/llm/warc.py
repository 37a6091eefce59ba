"""WARC archives: a writer that stores equal payloads once, and a reader that can start anywhere.

Writer. A page becomes a response record, or, if a page with a smaller id has the same payload of
at least REVISIT bytes, a revisit record that names that page and repeats no payload. Each task
writes one archive under a temporary name and moves it into place, so a repeated task leaves the
same file.

Reader. Archives are cut into byte ranges, whatever lies at their bounds. In each range a task
takes every place that looks like the start of a record, payload or not, and emits the offset
where a record there would end (its successor). A payload can hold such a start, so only what can be
reached from the file's start is real. Chains are shortened inside a range first, to the place where
they leave it. Pointer jumping over what remains doubles the distance with each round: it takes
log2(ranges of a file) rounds of joins, not one for each record. Then the tasks read the records of
their range from its first reachable one. A chain that doesn't reach its file's end, or a file with fewer or more
records than were written, is an error: nothing is left out silently.

Defined results: null html is an empty payload; rows that repeat a page_id with the same payload are
responses each; a null page_id is smaller than all; line ends in a url are percent-encoded, and it may be of
any length; very long payloads are one record, written and read whole by one task; an empty table gives no archive and no rows; other columns are left
out, whatever their names.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import checkpoint, open_store

#: Payloads of so many bytes can be revisited.
REVISIT = 100
#: Bytes of a range, and of a header that is looked at at first.
RANGE, HEAD = 8 << 20, 4096
#: Groups of equal payloads up to so many are broadcast (about 100 bytes each); beyond, pages are shuffled.
BROADCAST_ROWS = 200_000
MAGIC = b"WARC/1.1\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "2000-01-01T00:00:00Z"
END = b"\r\n\r\n"
_LENGTH = re.compile(rb"\r\nContent-Length: (\d{1,18})(?=\r\n)", re.I)


def record(page_id, url, payload: bytes, digest: str, refers_to=None, revisit: bool = False) -> bytes:
    """The bytes of one record, with the two line ends after it."""
    body = HTTP if revisit else HTTP + payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url or "")),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Payload-Length", len(payload)),
    ]
    if revisit:
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(body))]
    return MAGIC + "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "surrogatepass") + b"\r\n" + body + b"\r\n\r\n"


def _revisits(pages: DataFrame) -> DataFrame:
    """pages with __digest and __first: the page that has the payload first, where there is one with a smaller id."""
    digest = F.sha2(F.coalesce("html", F.lit("")), 256)
    narrow = pages.select("page_id", digest.alias("__digest")).where(F.octet_length("html") >= REVISIT)
    groups = checkpoint(narrow.groupBy("__digest").agg(F.min(F.struct("page_id")).alias("__least"), F.count("*").alias("n")).where("n > 1").drop("n"))
    if groups.count() <= BROADCAST_ROWS:
        groups = F.broadcast(groups)
    joined = pages.withColumn("__digest", digest).join(groups, "__digest", "left")
    return joined.withColumns({"__revisit": F.col("__least").isNotNull() & ~F.col("__least.page_id").eqNullSafe(F.col("page_id")), "__first": F.col("__least.page_id")}).drop("__least")


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes page_id, url, html as archives in folder; the archives' files, sizes and records."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        store, path = open_store(folder)
        store.create_dir(path, recursive=True)
        name = f"part-{context.partitionId():06d}.warc"
        temporary, size, n, out = f"{path}/.{name}.{context.taskAttemptId()}", 0, 0, None
        for batch in batches:
            for page_id, url, text, digest, revisit, first in batch.itertuples(index=False):
                if out is None:
                    out = store.open_output_stream(temporary)
                payload = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
                plain = lambda x: "null" if pd.isna(x) else int(x)
                data = record(plain(page_id), url, payload, digest, plain(first), bool(revisit))
                out.write(data)
                size, n = size + len(data), n + 1
        if out is not None:
            out.close()
            store.move(temporary, f"{path}/{name}")
            yield pd.DataFrame({"file": [name], "size": [size], "records": [n]})

    rows = _revisits(pages.select(F.col("page_id").cast("long"), "url", "html"))
    found = rows.select(F.col("page_id").cast("string"), "url", "html", "__digest", "__revisit", F.col("__first").cast("string")).mapInPandas(run, "file string, size long, records long")
    return checkpoint(found)


class Bytes:
    """Random access to an archive."""

    def __init__(self, folder: str, file: str, size: int):
        store, path = open_store(folder)
        self.file, self.size = store.open_input_file(f"{path}/{file}"), size

    def at(self, offset: int, n: int) -> bytes:
        n = max(0, min(n, self.size - offset))
        return self.file.read_at(n, offset) if n else b""

    def until_empty_line(self, offset: int, data: bytes, since: int) -> bytes:
        """data, which lies at offset, and what follows up to the first empty line from `since` on, or to the file's end."""
        parts, n = [data], HEAD
        at, tail = offset + len(data), data[max(since, len(data) - len(END) + 1) :]
        if data.find(END, since) >= 0:
            return data
        while at < self.size:
            more = self.at(at, n)
            parts.append(more)
            if END in tail + more:
                break
            at, tail, n = at + len(more), (tail + more)[-len(END) + 1 :], min(n * 4, RANGE)
        return b"".join(parts)

    def head(self, offset: int) -> bytes:
        """The header of the record at offset, with its empty line, however long it is."""
        data = self.until_empty_line(offset, self.at(offset, HEAD), 0)
        end = data.find(END)
        if not data.startswith(MAGIC) or end < 0:
            raise ValueError(f"no record at {offset}")
        return data[: end + len(END)]


def successors(source: Bytes, start: int, end: int) -> dict[int, int]:
    """Of each place from start to end that looks like a record: where the next would begin. One search for empty lines and lengths for all of them."""
    data = source.at(start, end - start + HEAD)
    places, k = [], data.find(MAGIC)
    while 0 <= k < end - start:
        places.append(k)
        k = data.find(MAGIC, k + 1)
    if not places:
        return {}
    data = source.until_empty_line(start, data, places[-1])
    lengths = [(m.start(), m.end(), int(m[1])) for m in _LENGTH.finditer(data)]
    out, empty, before = {}, -1, len(data)
    for place in reversed(places):
        near = data.find(END, place, before + len(END) - 1)
        empty, before = (near if near >= 0 else empty), place
        at = bisect.bisect_left(lengths, (place,))
        if empty >= 0 and at < len(lengths) and lengths[at][1] <= empty:
            out[start + place] = start + empty + len(END) + lengths[at][2] + len(END)
    return out


def _candidates(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, size, start, end in batch[["file", "size", "start", "end"]].itertuples(index=False):
                after = successors(Bytes(folder, file, size), start, end)
                leaves: dict[int, int] = {}
                for place in sorted(after, reverse=True):  # successors lie behind, so they are known
                    leaves[place] = leaves.get(after[place], after[place])
                yield pd.DataFrame({"file": file, "offset": list(after), "successor": list(after.values()), "leaves": [leaves[p] for p in after]}).astype({"offset": "int64", "successor": "int64", "leaves": "int64"})

    return run


def reachable(candidates: DataFrame, most_ranges: int) -> DataFrame:
    """candidates: file, offset, leaves. The places (file, offset) where the chain from the file's start enters a range."""
    entries = candidates.select("file", F.col("leaves").alias("offset")).unionByName(candidates.select("file", F.lit(0).cast("long").alias("offset"))).distinct()
    jump = checkpoint(candidates.join(entries, ["file", "offset"]).select("file", "offset", F.col("leaves").alias("to")))
    reached = jump.where("offset = 0").select("file", "offset")
    for _ in range(max(1, math.ceil(math.log2(max(2, most_ranges + 1))))):
        step = reached.join(jump, ["file", "offset"]).select("file", F.col("to").alias("offset"))
        reached = checkpoint(reached.unionByName(step).distinct())
        further = jump.select("file", F.col("offset").alias("to"), F.col("to").alias("then"))
        jump = checkpoint(jump.join(further, ["file", "to"]).select("file", "offset", F.col("then").alias("to")))
    return reached


def _records(folder: str):
    value = lambda head, name: (m := re.search(rb"\r\n" + name + rb": ([^\r\n]*)", head)) and m[1].decode("utf-8", "surrogatepass")
    page = lambda x: int(x[10:-1]) if x and x != "<urn:page:null>" else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, size, offset, end in batch[["file", "size", "offset", "end"]].itertuples(index=False):
                source, rows = Bytes(folder, file, size), []
                while offset < end:
                    head = source.head(offset)
                    length = int(_LENGTH.search(head)[1])
                    kind, digest = value(head, b"WARC-Type"), value(head, b"WARC-Payload-Digest").removeprefix("sha256:")
                    n = int(value(head, b"X-Payload-Length"))
                    if kind == "response":
                        body = source.at(offset + len(head), length)
                        payload = body[body.index(b"\r\n\r\n") + 4 :]
                        if len(payload) != n or hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"{file} at {offset}: the payload isn't what its header says")
                    rows.append((page(value(head, b"WARC-Record-ID")), n, digest, kind, page(value(head, b"WARC-Refers-To")) if kind == "revisit" else None, file, offset))
                    offset += len(head) + length + 4
                if rows:
                    out = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "file", "offset"])
                    yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    return run


def read(files: DataFrame, folder: str, span: int = RANGE) -> DataFrame:
    """files: file, size, and records where it is known. One row for each record: page_id, payload_bytes, payload_digest, record_type, refers_to, file, offset.

    Every response's digest is verified, and that no file has lost a record."""
    known = "records" if "records" in files.columns else F.lit(None).cast("long").alias("records")
    files = files.where("size > 0").select("file", "size", known)
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(span).cast("long")))
    ranges = files.withColumn("start", starts).withColumn("end", F.least(F.col("start") + span, F.col("size")))
    total = files.agg(F.sum(F.ceil(F.col("size") / span)).alias("n"), F.max(F.ceil(F.col("size") / span)).alias("most")).first()
    n, most = int(total["n"] or 1), int(total["most"] or 1)
    tasks = max(1, min(n, 20_000))
    found = checkpoint(ranges.repartition(tasks).mapInPandas(_candidates(folder), "file string, offset long, successor long, leaves long"))
    entries = reachable(found, most)
    first = entries.join(files.drop("records"), "file").where("offset < size").withColumn("end", F.least((F.floor(F.col("offset") / span) + 1) * span, F.col("size")))
    rows = checkpoint(first.repartition(tasks).mapInPandas(_records(folder), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long"))
    ended = entries.select("file", F.col("offset").alias("size")).withColumn("ended", F.lit(True))
    checked = files.join(ended, ["file", "size"], "left").join(rows.groupBy("file").agg(F.count("*").alias("found")), "file", "left")
    lost = checked.where("ended IS NULL OR coalesce(found, 0) <> coalesce(records, found, 0)").select("file").first()
    if lost:
        raise ValueError(f"{lost['file']} can't be read to its end record by record")
    return rows
