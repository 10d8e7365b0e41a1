"""WARC archives: writing with revisit records, and splittable reading by boundary chains.

Writing: pages meet the decision of their payload (response or revisit) by id and digest, each task
writes its records as compressed members into rolled files of the shared folder.

Reading: archives are cut into byte ranges. A task looks for record starts in its range and emits, for
each, the offset of its successor and where the chain from it leaves the range. Bytes inside a payload
may look like a start too. From offset 0 of every file, pointer jumping over the places where chains
enter ranges (each round doubles the distance) finds the entry that is really reached; inside a range the
chain is followed from its entry. Candidates off the chain are rejected.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from urllib.parse import quote

from lumenmart.llm.common import spread, stage, tune
from lumenmart.llm.files import read_range, write_file

LEAST_SHARED = 100
ROLL = 16 << 20
RANGE = 4 << 20
LOOK_AHEAD = 1 << 16
PIECE = 1 << 14
MOST_TASKS = 100_000

# Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
STAMP = "2020-01-01T00:00:00Z"
MEMBER = b"\x1f\x8b\x08"
LENGTH_LINE = re.compile(rb"\r\nContent-Length: (\d+)\r\n", re.I)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, original: int | None, revisit: bool) -> bytes:
    """One record. A revisit has no payload but tells its length and digest and the page it refers to."""
    block = HTTP + (b"" if revisit else payload)
    lines = [
        f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Date: {STAMP}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~-._')}",
        f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {len(payload)}",
    ]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{'' if original is None else original}>"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + "\r\n".join(lines).encode() + END + block + END


def _packed(data: bytes) -> bytes:
    machine = zlib.compressobj(6, zlib.DEFLATED, 31)
    return machine.compress(data) + machine.flush()


def decisions(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """Per distinct page id and payload digest: the page that holds the payload."""
    keys = pages.groupBy("page_id", "digest", "payload_bytes").agg(F.count(F.lit(1)).alias("rows"))
    holders = keys.groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("no_id"), "page_id")).alias("holder"))
    return keys.join(holders, "digest").select("page_id", "digest", F.col("holder.page_id").alias("original"), (F.col("payload_bytes") >= least).alias("shared"))


def write_archives(pages: DataFrame, folder: str, packed: bool = True, roll: int = ROLL, least: int = LEAST_SHARED) -> DataFrame:
    """Write one record per row of page_id, url, html; the files written: path, size.

    Null html is an empty payload, a null url an empty target. Of equal payloads of at least `least` bytes
    the smallest page id responds (null ids last; of repeated rows exactly one), the others revisit it.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    light = spread(rows).select("page_id", F.sha2("html", 256).alias("digest"), F.octet_length("html").alias("payload_bytes"))
    decided = stage(decisions(light, least))
    # join and window share plain keys, so that the payloads move once
    key = F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("key")
    once = Window.partitionBy("key", "digest").orderBy("url")
    bodies = rows.select("page_id", "url", "html", F.sha2("html", 256).alias("digest"), key)
    work = bodies.join(decided.select(key, "digest", "original", "shared"), ["key", "digest"]).withColumn(
        "revisit", F.col("shared") & (~F.col("page_id").eqNullSafe(F.col("original")) | (F.row_number().over(once) > 1))
    )

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rolled = TaskContext.get().partitionId(), 0
        held: list[bytes] = []
        size = 0

        def close():
            path = f"{folder}/{number:06d}-{rolled:05d}.warc{'.gz' if packed else ''}"
            write_file(path, b"".join(held))
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64())], names=["path", "size"])

        for part in parts:
            columns = (part.column(part.schema.get_field_index(c)).to_pylist() for c in ("page_id", "url", "html", "digest", "original", "revisit"))
            for page_id, url, html, digest, original, revisit in zip(*columns, strict=True):
                data = record(page_id, url, html.encode("utf-8", "surrogatepass"), digest, original, revisit)
                held.append(_packed(data) if packed else data)
                size += len(held[-1])
                if size >= roll:
                    yield close()
                    held, size, rolled = [], 0, rolled + 1
        if held:
            yield close()

    return stage(work.select("page_id", "url", "html", "digest", "original", "revisit").mapInArrow(run, "path string, size long"))


def _header(data: bytes) -> tuple[dict[str, str], int, int] | None:
    """Fields, where the block begins and how long it is; None if no whole header begins here."""
    end = data.find(END)
    if end < 0 or not data.startswith(b"WARC/1."):
        return None
    length = LENGTH_LINE.search(data, 0, end + 2)
    if not length:
        return None
    fields = {}
    for line in data[:end].split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return fields, end + len(END), int(length[1])


def _at(data: bytes, at: int, more) -> tuple[int, dict[str, str], bytes] | None:
    """Record that begins at `at` of the range: its size in the file, fields and payload; None if there is none."""
    if data.startswith(MEMBER, at):
        machine, plain, taken = zlib.decompressobj(31), [], 0
        while not machine.eof:
            piece = data[at + taken : at + taken + PIECE] or more(at + taken, 1 << 20)
            if not piece:
                return None
            try:
                plain.append(machine.decompress(piece))
            except zlib.error:
                return None
            if not taken and len(plain[0]) >= 7 and not plain[0].startswith(b"WARC/1."):
                return None
            taken += len(piece)
        whole, size = b"".join(plain), taken - len(machine.unused_data)
        head = _header(whole)
        if head is None or len(whole) != head[1] + head[2] + len(END):
            return None
        return size, head[0], whole[head[1] : head[1] + head[2]].partition(END)[2]
    window = data[at : at + LOOK_AHEAD]
    if len(window) < LOOK_AHEAD:
        window += more(at + len(window), LOOK_AHEAD)
    while window.startswith(b"WARC/1.") and END not in window:
        piece = more(at + len(window), len(window))
        if not piece:
            break
        window += piece
    head = _header(window)
    if head is None:
        return None
    fields, begin, length = head
    whole = data[at : at + begin + length + len(END)]
    missing = begin + length + len(END) - len(whole)
    whole += more(at + len(whole), missing) if missing else b""
    if not whole.endswith(END) or len(whole) != begin + length + len(END):
        return None
    return len(whole), fields, whole[begin : begin + length].partition(END)[2]


def _page_number(text: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", text)
    return int(found[1]) if found else None


CANDIDATES = "file long, path string, start long, at long, to long, leaves long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, sound boolean"


class DamagedArchive(ValueError):
    """A chain of records ends before its file does."""


def numbered(files: DataFrame) -> DataFrame:
    """Files with a number; empty ones hold no record and are left out."""
    return stage(files.where("size > 0").select(F.monotonically_increasing_id().alias("file"), "path", "size"))


def candidates(files: DataFrame, packed: bool = True, span: int = RANGE) -> DataFrame:
    """Every place that looks like a record: its offset, its successor's offset and what the record says."""
    ranges = (files if "file" in files.columns else numbered(files)).select("file", "path", "size", F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(span))).alias("start"))
    tasks = ranges.repartition(min(MOST_TASKS, max(1, ranges.count())), "path", "start")
    magic = re.compile(re.escape(MEMBER) if packed else rb"WARC/1\.[01]\r\n")
    names = [f.split()[0] for f in CANDIDATES.split(", ")]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for file, path, size, start in zip(*(part.column(k).to_pylist() for k in range(4)), strict=True):
                data = read_range(path, start, min(span, size - start) + 16)
                out = []
                for found in magic.finditer(data):
                    if found.start() >= span:
                        break
                    got = _at(data, found.start(), lambda at, n, path=path, start=start: read_range(path, start + at, n))
                    if got is None:
                        continue
                    length, fields, payload = got
                    kind, claimed = fields.get("warc-type", ""), fields.get("warc-payload-digest", "").removeprefix("sha256:")
                    digest = hashlib.sha256(payload).hexdigest() if kind == "response" else claimed
                    told = fields.get("warc-payload-length", "")
                    out.append((
                        file, path, start, start + found.start(), start + found.start() + length, 0, _page_number(fields.get("warc-record-id", "")),
                        len(payload) if kind == "response" else int(told) if told.isdigit() else None, digest, kind,
                        _page_number(fields.get("warc-refers-to", "")), digest == claimed,
                    ))
                leaves: dict[int, int] = {}
                for row in reversed(out):
                    leaves[row[3]] = leaves.get(row[4], row[4])
                out = [(*row[:5], leaves[row[3]], *row[6:]) for row in out]
                types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names)

    return tasks.mapInArrow(run, CANDIDATES)


def reached(links: DataFrame) -> DataFrame:
    """Offsets on the chain from offset 0 of each file. `links`: file, at, to.

    Round k knows all offsets fewer than 2^k steps away and the jumps over 2^k steps.
    """
    jumps = links.select("file", "at", "to")
    known = stage(jumps.where("at = 0").select("file", "at"))
    count = known.count()
    while True:
        further = known.join(jumps, ["file", "at"]).select("file", F.col("to").alias("at"))
        known = stage(known.unionByName(further).distinct())
        now = known.count()
        if now == count:
            return known
        count = now
        second = jumps.select("file", F.col("at").alias("to"), F.col("to").alias("over"))
        jumps = stage(jumps.join(second, ["file", "to"]).select("file", "at", F.col("over").alias("to")))


def _on_chain(rows: pd.DataFrame) -> pd.DataFrame:
    """Candidates of one range that the chain passes from where it enters."""
    following = dict(zip(rows["at"], rows["to"], strict=True))
    passed, at = set(), next(iter(rows["at"][rows["entered"]]), None)
    while at in following:
        passed.add(at)
        at = following[at]
    return rows[rows["at"].isin(passed)].drop(columns="entered")


def breaks(files: DataFrame, entered: DataFrame) -> DataFrame:
    """Files whose chain does not end where the file does: path, at (first byte no record explains), lost (bytes from there)."""
    ends = entered.groupBy("file").agg(F.max("at").alias("ends"))
    return files.join(ends, "file", "left").select("path", F.coalesce("ends", F.lit(0)).alias("at"), (F.col("size") - F.coalesce("ends", F.lit(0))).alias("lost")).where("lost <> 0")


def read_archives(files: DataFrame, packed: bool = True, span: int = RANGE, damaged: str = "fail") -> DataFrame:
    """Records of archives (rows of path, size): page_id, payload_bytes, payload_digest, record_type, refers_to, path, at, sound.

    `sound` tells whether the payload has the digest its header claims. Where the chain of records ends before
    its file (a damaged or truncated record), what follows is not guessed at: the read fails with
    `DamagedArchive`, or with damaged="report" gives one row per such file beside the records before the
    damage, with record_type "damaged", the offset `at` and in payload_bytes the bytes that are lost.
    """
    own = numbered(files)
    found = stage(candidates(own, packed, span))
    doors = found.select("file", F.col("leaves").alias("at")).unionByName(found.select("file", F.lit(0).cast("long").alias("at"))).distinct()
    links = stage(found.select("file", "at", F.col("leaves").alias("to")).join(doors, ["file", "at"], "left_semi"))
    entered = reached(links)
    broken = stage(breaks(own, entered))
    if damaged == "fail":
        some = broken.orderBy("path").limit(3).collect()
        if some:
            raise DamagedArchive("; ".join(f"{r.path}: no record at byte {r.at}, {r.lost} bytes unread" for r in some))
    rows = found.drop("leaves").join(entered.withColumn("entered", F.lit(True)), ["file", "at"], "left").withColumn("entered", F.coalesce("entered", F.lit(False)))
    chain = rows.groupBy("file", "start").applyInPandas(_on_chain, rows.drop("entered").schema)
    records = chain.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "path", "at", "sound")
    if damaged == "fail":
        return records
    nothing = F.lit(None)
    return records.unionByName(broken.select(
        nothing.cast("long").alias("page_id"), F.col("lost").alias("payload_bytes"), nothing.cast("string").alias("payload_digest"),
        F.lit("damaged").alias("record_type"), nothing.cast("long").alias("refers_to"), "path", "at", F.lit(False).alias("sound")))


def archive_round_trip(pages: DataFrame, folder: str, packed: bool = True) -> DataFrame:
    """Write all pages to `folder` and read them back; one row per page. An empty table gives no rows."""
    tune(pages.sparkSession)
    return read_archives(write_archives(pages, folder, packed), packed).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
