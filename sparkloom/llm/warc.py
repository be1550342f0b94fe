"""WARC archives in seekable Zstandard bundles.

A bundle holds records in independent Zstandard frames and ends with a seek
table in a skippable frame (the public seekable format). A record is found by
bundle, frame and offset inside the frame. Equal payloads are stored once: the
row with the smallest id is the response, the others are revisits.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, release, table_path

#: Bytes of records in a frame and of frames in a bundle, before either is closed.
FRAME = 1 << 20
BUNDLE = 64 << 20
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


#: What comes before a response's payload: the payload is the body of an HTTP message.
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
#: Names of the responses that others revisit are made from their payload's digest, so that revisits know them.
NAMES = uuid.UUID("6ba7b812-9dad-11d1-80b4-00c04fd430c8")


def shared_id(sha: str) -> str:
    """Record id of the one response that holds a payload which others revisit."""
    return str(uuid.uuid5(NAMES, sha))


def record(kind: str, url: str | None, rid: str, page: int | None, payload: bytes, n: int, digest: str, refers: int | None, refers_id: str | None = None) -> bytes:
    """One WARC/1.1 record. A revisit has no payload; the length and digest of the full one stand in its header."""
    clean = re.sub(r"[\r\n]", " ", url or "")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{rid}>", f"WARC-Target-URI: {clean}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {n}"]
    if page is not None:
        head.append(f"X-Page-Id: {page}")
    head.append("Content-Type: application/http;msgtype=response")
    if kind == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_id is not None:
            head.append(f"WARC-Refers-To: <urn:uuid:{refers_id}>")
        if refers is not None:
            head.append(f"X-Refers-To-Page: {refers}")
    body = HTTP % len(payload) + payload if kind == "response" else b""
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict, bytes]:
    """Header fields and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *x) for x in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(tail: bytes) -> list[tuple[int, int]]:
    """(compressed, plain) size of each frame, from a bundle's last bytes."""
    n, _, magic = struct.unpack("<IBI", tail[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    return [struct.unpack_from("<II", tail, len(tail) - 9 - 8 * (n - i)) for i in range(n)]


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


INDEX = "record_id string, bundle string, frame long, at long, size long"


def write_archive(pages: DataFrame, folder: str, least: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write a record for each row; returns the index (record_id, bundle, frame, at, size), frame being the frame's offset in the bundle.

    Null payloads are empty. Of equal payloads of at least `least` bytes the
    smallest id is the response; among repeated rows of that id one is. Null
    ids come after all others. An attempt writes a file of its own and only
    the files that the index names count, so lost tasks leave no harm.
    """
    body = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), body.alias("body"))

    def shrink(batches):
        """Payloads travel compressed, and a copy's only where no row before it in its partition has the same and a smaller id."""
        press, least_page = zstandard.ZstdCompressor(level=1), {}
        for b in batches:
            bodies, shas, sizes = [], [], []
            for page, raw in zip(b.column(0).to_pylist(), b.column(2).cast(pa.binary()).to_pylist()):
                sha = hashlib.sha1(raw)
                key, place = sha.digest(), (page is None, page or 0)
                needed = len(raw) < least or place <= least_page.get(key, place)
                if needed:
                    least_page[key] = place
                bodies.append(press.compress(raw) if needed else None)
                shas.append(sha.hexdigest())
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bodies, pa.binary()), pa.array(shas, pa.string()), pa.array(sizes, pa.int64())], names=["page", "url", "body", "sha", "n"])
        release()

    slim_rows = rows.select("page", F.sha1("body").alias("sha"), F.octet_length("body").cast("long").alias("n"))
    rows = rows.mapInArrow(shrink, "page long, url string, body binary, sha string, n long")
    firsts = slim_rows.where(F.col("n") >= least).groupBy("sha").agg(F.min("page").alias("first"), F.count("*").alias("copies"))
    # written first, so that the join is one of two plain shuffles, which can part a digest that very many rows share
    firsts = materialise(firsts.where("copies > 1"), "firsts")
    alone = rows.join(firsts, "sha", "left")
    slim = F.when(F.col("copies").isNull() | F.col("page").eqNullSafe(F.col("first")), F.col("body"))
    marked = alone.select("page", "url", "sha", "n", "first", F.col("copies").isNotNull().alias("shared"), slim.alias("body"))
    single = marked.where("NOT shared OR NOT (page <=> first)").withColumn("rn", F.lit(1))
    heads = marked.where("shared AND page <=> first").withColumn("rn", F.row_number().over(Window.partitionBy("sha").orderBy("url")))
    ready = single.unionByName(heads).withColumn("revisit", F.expr("shared AND (NOT (page <=> first) OR rn > 1)"))
    ready = ready.select("page", "url", F.when(~F.col("revisit"), F.col("body")).alias("body"), "sha", "n", "first", "shared", "revisit")

    def run(batches):
        system, root = _fs(folder)
        system.create_dir(root, recursive=True)
        press, unpack = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        state = {"name": None, "out": None, "at": 0, "sizes": [], "frame": [], "plain": 0, "rows": []}

        def flush_frame():
            if not state["frame"]:
                return
            raw = b"".join(state["frame"])
            packed = press.compress(raw)
            for i, a, z in state["pending"]:
                state["rows"].append((i, f"{folder}/{state['name']}", state["at"], a, z))
            state["out"].write(packed)
            state["sizes"].append((len(packed), len(raw)))
            state["at"] += len(packed)
            state["frame"], state["plain"], state["pending"] = [], 0, []

        def close():
            if state["out"] is None:
                return None
            flush_frame()
            state["out"].write(seek_table(state["sizes"]))
            state["out"].close()
            got, state["out"], state["rows"] = state["rows"], None, []
            return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*got)], names=["record_id", "bundle", "frame", "at", "size"])

        state["pending"] = []
        for b in batches:
            for r in b.to_pylist():
                if state["out"] is None:
                    state |= {"name": f"{uuid.uuid4().hex}.warc.zst", "at": 0, "sizes": []}
                    state["out"] = system.open_output_stream(f"{root}/{state['name']}", compression=None)
                kind = "revisit" if r["revisit"] else "response"
                rid = shared_id(r["sha"]) if r["shared"] and kind == "response" else str(uuid.uuid4())
                payload = unpack.decompress(r["body"]) if r["body"] else b""
                raw = record(kind, r["url"], rid, r["page"], payload, r["n"], base64.b32encode(bytes.fromhex(r["sha"])).decode(), r["first"], shared_id(r["sha"]))
                state["pending"].append((rid, state["plain"], len(raw)))
                state["frame"].append(raw)
                state["plain"] += len(raw)
                if state["plain"] >= FRAME:
                    flush_frame()
                if state["at"] >= BUNDLE:
                    yield close()
        last = close()
        if last is not None:
            yield last

    index = materialise(ready.mapInArrow(run, INDEX), "index")
    discard(firsts)
    return index


def read_archive(index: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): every indexed record, read by seeking to its frame.

    A response's length and digest come from its payload as read; a revisit's
    from its header.
    """
    frames = index.groupBy("bundle", "frame").agg(F.collect_list(F.struct("at", "size")).alias("records"))  # a frame is bounded

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for r in sorted(b.to_pylist(), key=lambda r: (r["bundle"], r["frame"])):
                system, path = _fs(r["bundle"])
                with system.open_input_file(path) as f:
                    f.seek(r["frame"])
                    raw = unpack.decompressobj().decompress(f.read(_frame_size(f, r["frame"])))
                for x in r["records"]:
                    head, body = parse(raw[x["at"] : x["at"] + x["size"]])
                    page = head.get("X-Page-Id")
                    kind = head["WARC-Type"]
                    n, digest = (len(body), digest32(body)) if kind == "response" else (int(head["X-Payload-Length"]), head["WARC-Payload-Digest"][5:])
                    refers = head.get("X-Refers-To-Page")
                    out.append((None if page is None else int(page), n, digest, kind, None if refers is None else int(refers)))
            if out:
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return frames.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _frame_size(f, start: int) -> int:
    """Compressed size of the frame at start, from the bundle's seek table."""
    size = f.size()
    f.seek(size - 9)
    n = struct.unpack("<I", f.read(9)[:4])[0]
    f.seek(size - 9 - 8 * n)
    table, at = read_seek_table(f.read(8 * n + 9)), 0
    for packed, _ in table:
        if at == start:
            f.seek(start)
            return packed
        at += packed
    raise ValueError("no frame starts there")


def archive(pages: DataFrame, folder: str | None = None, **names) -> DataFrame:
    """Write the archives, then read them back; an empty table gives no rows."""
    return read_archive(write_archive(pages, folder or table_path(pages.sparkSession, "warc"), **names))
