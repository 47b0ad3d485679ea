"""WARC: a deterministic sharded writer with revisit records, committed through temporary names and a manifest, and its reader."""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import fresh_path, in_turn, read_table, stored

#: Payloads below this size are always written in full.
REVISIT_BYTES = 100
#: Payload bytes of a shard (one task), which grow with the archive between these bounds so that there are about SHARDS of them.
LEAST_SHARD, MOST_SHARD, SHARDS = 8 << 20, 1 << 30, 4_096
#: The date of all records, for what is written must not depend on when.
DATE = "2024-01-01T00:00:00Z"
#: Cells that a round of the histogram of page_id makes of a range.
CELLS = 1 << 12

FILES = "shard int, file string, temporary string, records long, bytes long, sha256 string, first_id long, last_id long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, record_no long"


def revisits(facts: DataFrame) -> DataFrame:
    """(page_id, digest, first_id) for each payload of ``REVISIT_BYTES`` or more that several rows of ``facts`` have, some with an id.

    Minima are combined before the shuffle, so one payload that a third of all pages have costs one row per task.
    """
    long_ = facts.filter(F.col("n") >= REVISIT_BYTES).select("page_id", "digest")
    shared = stored(long_.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1 and first_id is not null").drop("n"), "shared-payloads")
    return long_.join(shared, "digest").select("page_id", "digest", "first_id").distinct()


def _urn(page_id: int | None, digest: str, n: int) -> str:
    """The identifier of the n-th record of a page and payload; no two records have the same."""
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}:{n}>"


def _member(headers: list[str], body: bytes) -> bytes:
    """One gzip member; nothing in it depends on when or where it is written."""
    packer = zlib.compressobj(5, zlib.DEFLATED, 31)  # 31: a gzip header, whose time is 0
    lines = ["WARC/1.1", *headers, f"WARC-Date: {DATE}", f"WARC-Block-Digest: sha256:{hashlib.sha256(body).hexdigest()}", f"Content-Length: {len(body)}"]
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


def _record(page_id: int | None, n: int, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    headers = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(page_id, digest, n)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if url is not None:
        headers.append(f"WARC-Target-URI: {url.replace('%', '%25').replace(chr(13), '%0D').replace(chr(10), '%0A')}")
    if refers_to is not None:
        headers += [f"WARC-Refers-To: {_urn(refers_to, digest, 0)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return _member(headers, payload if refers_to is None else b"")


class _Roller:
    """Files of one shard, each under a temporary name of this attempt alone."""

    def __init__(self, folder: str, shard: int, roll_bytes: int):
        from pyarrow import fs

        self.store, self.path = fs.FileSystem.from_uri(folder)
        self.shard, self.roll_bytes, self.attempt = shard, roll_bytes, uuid.uuid4().hex
        self.n, self.out, self.done = 0, None, []

    def add(self, page_id: int | None, member: bytes) -> None:
        if self.out is None:
            self.row = [self.shard, f"part-{self.shard:06d}-{self.n:05d}.warc.gz", f".{self.attempt}-{self.n:05d}.tmp", 0, 0, hashlib.sha256(), page_id, page_id]
            self.out = self.store.open_output_stream(f"{self.path}/{self.row[2]}", compression=None)
            self.n += 1
            info = f"software: turnlake\r\nformat: WARC File Format 1.1\r\nfilename: {self.row[1]}\r\n".encode()
            self._write(_member(["WARC-Type: warcinfo", f"WARC-Record-ID: <urn:warcinfo:{self.row[1]}>", f"WARC-Filename: {self.row[1]}", "Content-Type: application/warc-fields"], info))
        self._write(member)
        self.row[3] += 1
        self.row[7] = page_id
        if self.row[4] >= self.roll_bytes:
            self.close()

    def _write(self, member: bytes) -> None:
        self.out.write(member)
        self.row[4] += len(member)
        self.row[5].update(member)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append([*self.row[:5], self.row[5].hexdigest(), *self.row[6:]])
            self.out = None


def _writer(folder: str, roll_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, page, roles, written = None, object(), {}, Counter()
        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns)]
            for i in range(batch.num_rows):
                shard, page_id, kind, url, payload, digest, first_id = (c[i].as_py() for c in columns)
                if roller is None or roller.shard != shard:
                    if roller is not None:
                        roller.close()
                        yield _file_rows(roller.done)
                    roller = _Roller(folder, shard, roll_bytes)
                if page_id != page:
                    page, roles, written = page_id, {}, Counter()
                if kind == 0:
                    roles[digest] = first_id
                    continue
                digest = hashlib.sha256(payload).hexdigest()
                refers_to = roles.get(digest)
                if refers_to == page_id and not written[digest]:  # of repeated rows, the first is the response
                    refers_to = None
                roller.add(page_id, _record(page_id, written[digest], url, payload, digest, refers_to))
                written[digest] += 1
        if roller is not None:
            roller.close()
            yield _file_rows(roller.done)

    return write


def _file_rows(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in FILES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)


def _commit(folder: str):
    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, temporary in zip(batch.column("file").to_pylist(), batch.column("temporary").to_pylist(), strict=True):
                if store.get_file_info(f"{path}/{temporary}").type != fs.FileType.NotFound:  # else an earlier attempt has moved it
                    store.move(f"{path}/{temporary}", f"{path}/{name}")
            yield batch

    return commit


class _Shards:
    """Ranges of page_id, and of those that are one id, or none, parts by digest: a cell's shards are numbered from its ``first`` on."""

    def __init__(self, edges: np.ndarray, first: np.ndarray, parts: np.ndarray):
        self.edges, self.first, self.parts = edges, first, parts

    def cells(self, page_id: pa.Array) -> np.ndarray:
        """0 for a null, then the ranges from each edge to the next."""
        known = page_id.fill_null(0).to_numpy(zero_copy_only=False)
        return np.where(page_id.is_null().to_numpy(zero_copy_only=False), 0, np.searchsorted(self.edges, known, "right"))

    def of(self, page_id: pa.Array, digest: list[str]) -> np.ndarray:
        cell = self.cells(page_id)
        part = np.array([int(d[:12], 16) for d in digest], np.int64) if len(digest) else np.zeros(0, np.int64)
        return self.first[cell] + part % self.parts[cell]


def _histogram(facts: DataFrame, edges: np.ndarray) -> np.ndarray:
    """Bytes of each cell: of rows without page_id, and of those between two edges."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, sums = _Shards(edges, edges, edges), np.zeros(len(edges) + 1)
        for batch in batches:
            sums += np.bincount(cells.cells(batch.column("page_id")), batch.column("n").to_numpy(), len(sums))
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used].astype(np.int64))], ["cell", "n"])

    out = np.zeros(len(edges) + 1)
    for row in facts.select("page_id", F.greatest("n", F.lit(1)).alias("n")).mapInArrow(in_turn("warc", count), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[row["cell"]] = row["n"]
    return out


def _shards(facts: DataFrame, shard_bytes: int) -> _Shards:
    """Shards of about ``shard_bytes``, by the rows alone and not by how they lie: cells of page_id are cut until none holds more or is a single id."""
    least, most = facts.agg(F.min("page_id"), F.max("page_id")).first()
    least, most = (0, 0) if least is None else (least, most)
    edges = np.unique([least + (most - least + 1) * i // CELLS for i in range(CELLS)]).astype(np.int64)
    while True:
        sums = _histogram(facts, edges)
        ends = [*edges[1:].tolist(), most + 1]
        heavy = [i for i, (a, b) in enumerate(zip(edges.tolist(), ends, strict=True)) if sums[i + 1] > shard_bytes and b - a > 1]
        if not heavy:
            break
        pieces = max(2, CELLS // len(heavy))
        more = [int(edges[i]) + (ends[i] - int(edges[i])) * k // pieces for i in heavy for k in range(pieces)]
        edges = np.unique(np.concatenate([edges, np.array(more, np.int64)]))
    parts = np.maximum(1, np.ceil(sums / shard_bytes)).astype(np.int64)
    first, number, filled = np.zeros(len(sums), np.int64), 0, 0.0
    for i, n in enumerate(sums.tolist()):
        if filled and (filled + n > shard_bytes or parts[i] > 1 or i == 1):  # a new shard; rows without id have their own
            number, filled = number + 1, 0.0
        first[i] = number
        filled += n
        if parts[i] > 1:
            number, filled = number + int(parts[i]), 0.0
    return _Shards(edges, first, parts)


def _placed(shared):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = shared.value.of(batch.column("page_id"), batch.column("digest").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), *batch.columns], ["shard", *batch.schema.names])

    return place


def write_warc(pages: DataFrame, folder: str, shard_bytes: int | None = None, roll_bytes: int | None = None) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) to ``folder``; returns the manifest, one row per file.

    Shards are ranges of page_id of about ``shard_bytes`` payload bytes each, by default some 4,096 of 8 MB to 1 GB; an id
    that holds more, and rows without one, are dealt to several by their payload's digest. The ranges follow from the rows
    alone, so the same rows give the same files on any cluster. A shard's rows are sorted, and a file, which a warcinfo
    record opens, is closed once its compressed size reaches ``roll_bytes`` (a quarter of a shard). Of rows with equal
    payloads of ``REVISIT_BYTES`` or more, that with the least page_id is a response and all others, those without an id
    too, are revisits that refer to it (of repeated rows, all but one); payloads that only rows without an id have are
    responses. A null html is an empty payload. Attempts write under names of their own; only files of the attempt that
    Spark counted are renamed, then the manifest is written. A lost executor leaves a hidden file at most.
    """
    spark = pages.sparkSession
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    facts = stored(rows.select("page_id", "digest", F.length("payload").cast("long").alias("n")), "payloads")
    total = facts.agg(F.sum("n")).first()[0] or 0
    shard_bytes = shard_bytes or min(max(LEAST_SHARD, total // SHARDS), MOST_SHARD)
    shards = _shards(facts, shard_bytes)
    count = int((shards.first + shards.parts).max())
    both = rows.withColumns({"kind": F.lit(1), "first_id": F.lit(None).cast("long")}).unionByName(
        revisits(facts).withColumns({"kind": F.lit(0), "url": F.lit(None).cast("string"), "payload": F.lit(None).cast("binary")})
    )
    both = both.select("page_id", "kind", "url", "payload", "digest", "first_id").mapInArrow(in_turn("warc", _placed(spark.sparkContext.broadcast(shards))), "shard int, page_id long, kind int, url string, payload binary, digest string, first_id long")
    dealt = both.repartitionById(count, F.col("shard")).sortWithinPartitions("shard", "page_id", "kind", "url", "digest")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    attempts = stored(dealt.mapInArrow(in_turn("warc", _writer(folder, roll_bytes or max(1, shard_bytes // 4))), FILES), "warc-attempts")
    manifest = attempts.repartition(max(1, count // 16)).mapInArrow(_commit(folder), FILES).drop("temporary")
    manifest.write.json(f"{folder}/manifest")
    return spark.read.schema(manifest.schema).json(f"{folder}/manifest")


def _records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record; the stream may hold any number of gzip members."""
    with gzip.GzipFile(fileobj=stream) as lines:
        while line := lines.readline():
            if not line.strip():
                continue
            headers = {}
            while (line := lines.readline().strip()):
                name, _, value = line.decode().partition(": ")
                headers[name] = value
            yield headers, lines.read(int(headers["Content-Length"]))


def _reader(folder: str):
    def number(urn: str | None) -> int | None:
        digits = (urn or "").removeprefix("<urn:page:").partition(":")[0]
        return int(digits) if digits else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows = []
                with store.open_input_stream(f"{path}/{name}", compression=None) as raw:
                    for n, (h, block) in enumerate(_records(raw)):
                        found = hashlib.sha256(block).hexdigest()
                        if f"sha256:{found}" != h["WARC-Block-Digest"]:
                            raise ValueError(f"{name}: record {n} does not match its digest")
                        if h["WARC-Type"] == "warcinfo":
                            continue
                        url = h.get("WARC-Target-URI")
                        url = url if url is None else url.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")
                        rows.append((number(h["WARC-Record-ID"]), url, int(h["WARC-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha256:"), h["WARC-Type"], number(h.get("WARC-Refers-To")), name, n))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                names = [x.split()[0] for x in RECORDS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)

    return read


def read_warc(manifest: DataFrame, folder: str) -> DataFrame:
    """A row per record, warcinfo aside, of the files that ``manifest`` names, a task for each; a block that does not match its digest is an error."""
    return manifest.select("file").repartition(max(1, manifest.count())).mapInArrow(in_turn("warc", _reader(folder)), RECORDS)


def op4_warc_archive(spark, sf_dir) -> DataFrame:
    folder = fresh_path(spark, "warc")
    manifest = write_warc(read_table(spark, sf_dir, "pages"), folder)
    return read_warc(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op4_warc_archive": op4_warc_archive}

ORACLE_SQL = {
    "op4_warc_archive": """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST) AS n FROM p),
r AS (SELECT *, payload_bytes >= 100 AND first_id IS NOT NULL AND n > 1 AS again FROM f)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first_id END AS refers_to
FROM r
"""
}
