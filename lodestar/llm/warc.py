"""Deterministic sharded WARC writer (operator 10).

Pages are range-sorted by url, page_id and content hash into shards; the bounds of the shards are quantiles of the keys of least
hash, so they depend on the data alone. Up to ``fan`` ranges are bounded by the driver, from a bounded sample; where there are more
shards, each range is parted further by its own sample, whose bounds stay distributed. A shard's task writes its records one after another, each a
gzip member of its own, and rolls to a new file before a record that would take the compressed file over ``roll`` bytes.
Every file starts with a warcinfo record; record headers, ids (name-based UUIDs), lengths and SHA-1 digests are made anew
from url and html. The same table gives the same bytes in every file, however it is partitioned and however often tasks run.

A task writes under a temporary name with its attempt and renames the finished file, so a task that is lost leaves no
half file under a final name, and one that is run again replaces a file by the same bytes. When all are done, tasks check the
files against their records and write the manifest's parts, about ``listed`` files each, under temporary names, and rename them; the driver
does the same with ``manifest.json``, which lists the parts and the totals: a folder without it isn't committed.

Defined results: a null or empty html is a record with an empty payload; a null or empty url is written as ``urn:page:<id>``,
and as ``urn:page:none`` without a page_id either; repeated rows are repeated records, with ids told apart by their place;
very long pages are one record, in a file of their own if need be; other columns are not written; an empty table gives a
manifest without files.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_right
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import cut, shared_dir


@dataclass(frozen=True)
class Config:
    shard: int = 16 << 20  #: characters of html in a shard, about
    roll: int = 4 << 20  #: compressed bytes of a file, at most, if it has more than one page
    fan: int = 1_000  #: ranges that the driver bounds
    sample: int = 64  #: keys a range or shard, about, that its bounds are taken from
    listed: int = 20_000  #: files in a part of the manifest, about
    level: int = 6
    date: str = "2024-01-01T00:00:00Z"
    name: str = "pages"
    software: str = "lodestar/1.0"


def _member(raw: bytes, level: int) -> bytes:
    """One gzip member without time or name, so equal bytes give equal members."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(raw) + z.flush()
    head = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff"
    return head + body + zlib.crc32(raw).to_bytes(4, "little") + (len(raw) & 0xFFFFFFFF).to_bytes(4, "little")


def digest(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def _record(kind: str, headers: list[tuple[str, str]], block: bytes, c: Config, identity: str) -> bytes:
    name = uuid.uuid5(uuid.NAMESPACE_URL, identity)
    lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", c.date), *headers]
    lines += [("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def uri(url: str | None, page_id) -> str:
    """The target: control characters and spaces are escaped, as they would end the header."""
    if not url:
        return f"urn:page:{'none' if page_id is None else page_id}"
    return "".join(ch if ch > " " and ch != "\x7f" else "".join(f"%{b:02X}" for b in ch.encode()) for ch in url)


def page_record(page_id, url: str | None, html: str | None, nth: int, c: Config) -> tuple[bytes, str]:
    """(the record's bytes, payload digest); nth counts equal pages before it."""
    payload = (html or "").encode()
    target = uri(url, page_id)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    sha = digest(payload)
    headers = [("WARC-Target-URI", target), ("WARC-Payload-Digest", sha), ("Content-Type", "application/http; msgtype=response")]
    return _record("response", headers, block, c, f"{target}\0{url or ''}\0{page_id}\0{sha}\0{nth}"), sha


def _info(file: str, c: Config) -> bytes:
    block = f"software: {c.software}\r\nformat: WARC File Format 1.1\r\n".encode()
    return _record("warcinfo", [("WARC-Filename", file), ("Content-Type", "application/warc-fields")], block, c, f"info\0{file}")


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path)


def _bounds(keys: DataFrame, n: int, c: Config) -> list[str]:
    """Inner bounds of up to ``n`` ranges of the keys."""
    if n < 2:
        return []
    sample = keys.select("key", F.xxhash64("key").alias("h")).orderBy("h", "key").limit(n * c.sample)
    found = sorted(r["key"] for r in sample.select("key").collect())
    at = [found[len(found) * i // n] for i in range(1, n)] if found else []
    return sorted(set(at))


def _place(bounds: list[str]):
    """The range of each key."""

    @F.arrow_udf("int")
    def place(key: pa.Array) -> pa.Array:
        return pa.array([bisect_right(bounds, k) for k in key.to_pylist()], pa.int32())

    return place


@F.arrow_udf(T.IntegerType())
def _place_in(key: pa.Array, bounds: pa.Array) -> pa.Array:
    """The range of each key among its own bounds."""
    held, out = (None, ()), []
    for i, k in enumerate(key.to_pylist()):
        own = bounds[i]
        if held[0] is None or not own.equals(held[0]):
            held = own, own.as_py() or ()
        out.append(bisect_right(held[1], k))
    return pa.array(out, pa.int32())


def _sharded(rows: DataFrame, c: Config) -> tuple[DataFrame, int]:
    """``rows`` with their shard, numbered in order of the keys, and how many shards there are."""
    total, n = rows.agg(F.sum(F.length("html")), F.count("*")).head()
    shards = max(1, -(-(total or 0) // c.shard))
    bounds = _bounds(rows, min(shards, c.fan), c)
    ranges = rows.withColumn("range", _place(bounds)("key"))
    if shards <= c.fan:
        return ranges.withColumnRenamed("range", "shard"), len(bounds) + 1
    # each range's own bounds, of the keys of least hash, are a row of a table; the driver knows how many they are alone
    inner = -(-shards // (len(bounds) + 1))
    share = min(1.0, shards * c.sample / max(1, n))
    sample = ranges.where(F.pmod(F.xxhash64("key"), F.lit(1 << 40)) < F.lit(int(share * (1 << 40)))).groupBy("range").agg(F.sort_array(F.collect_list("key")).alias("s"))
    size = F.size("s")
    picked = F.transform(F.sequence(F.lit(1), F.lit(inner - 1)), lambda i: F.element_at("s", F.floor(size * i / inner).cast("int") + 1))
    own = cut(sample.select("range", F.array_sort(F.array_distinct(picked)).alias("bounds")) if inner > 1 else sample.select("range", F.array().cast("array<string>").alias("bounds")))
    count = {r["range"]: r["n"] for r in own.select("range", (F.size("bounds") + 1).alias("n")).collect()}
    first, at = [], 0
    for r in range(len(bounds) + 1):
        first.append(at)
        at += count.get(r, 1)
    table = rows.sparkSession.createDataFrame(list(enumerate(first)), "range int, start int")
    placed = ranges.join(own, "range", "left").join(F.broadcast(table), "range")  # no more than ``fan`` rows
    return placed.withColumn("shard", F.col("start") + _place_in("key", "bounds")).drop("range", "bounds", "start"), at


SCHEMA = "page_id {0}, url string, file string, offset long, length long, payload_digest string"


def write(pages: DataFrame, path: str, config: Config = Config()) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as WARC files below ``path`` and return their index, a row a record.

    (page_id, url, file, offset, length, payload_digest): offset and length are those of the record's gzip member.
    """
    c, spark = config, pages.sparkSession
    kind = dict(pages.dtypes)["page_id"]
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    # the key is what is sorted by: url, then page_id, numbers in order of value
    number = F.when(F.col("page_id") < 0, F.lit("-")).otherwise(F.lpad(F.col("page_id").cast("string"), 20, "0")) if kind in ("bigint", "int") else F.col("page_id").cast("string")
    rows = rows.withColumn("key", F.concat_ws(" ", F.coalesce("url", F.lit("")), F.coalesce(number, F.lit(""))))
    rows, shards = _sharded(rows.withColumn("key", F.concat_ws(" ", "key", F.hex(F.xxhash64(F.coalesce("html", F.lit("")))))), c)
    home = path.rstrip("/")

    def run(batches):
        fs, root = _fs(home)
        task = TaskContext.get()
        attempt = f"{task.stageId()}-{task.partitionId()}-{task.attemptNumber()}" if task else "0"
        held, now, before, nth = None, None, None, 0

        def finish():
            out, _, name, index = held
            out.close()
            fs.move(f"{root}/_tmp/{name}.{attempt}", f"{root}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in index], t) for i, t in enumerate(types)], names)

        types = None
        names = ["page_id", "url", "file", "offset", "length", "payload_digest"]
        for batch in batches:
            types = [batch.schema.field("page_id").type, pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            for s, page_id, url, html in zip(*(batch.column(x).to_pylist() for x in ("shard", "page_id", "url", "html"))):
                nth = nth + 1 if (s, page_id, url or "", html or "") == before else 0
                before = (s, page_id, url or "", html or "")
                raw, sha = page_record(page_id, url, html, nth, c)
                member = _member(raw, c.level)
                if held is not None and (now[0] != s or (held[3] and held[1] + len(member) > c.roll)):
                    yield finish()
                    held = None
                if held is None:
                    now = (s, now[1] + 1 if now and now[0] == s else 0)
                    name = f"{c.name}-{s:07d}-{now[1]:05d}.warc.gz"
                    out = fs.open_output_stream(f"{root}/_tmp/{name}.{attempt}", compression=None)
                    head = _member(_info(name, c), c.level)
                    out.write(head)
                    held = [out, len(head), name, []]
                held[0].write(member)
                held[3].append((page_id, url, held[2], held[1], len(member), sha))
                held[1] += len(member)
        if held is not None:
            yield finish()

    fs, root = _fs(home)
    fs.create_dir(f"{root}/_tmp", recursive=True)
    placed = rows.repartitionById(shards, "shard")
    # null and empty count as equal, so that pages whose records are alike stand together and their places tell them apart
    ordered = placed.sortWithinPartitions("shard", "key", F.coalesce("url", F.lit("")), "page_id", F.coalesce("html", F.lit("")), "url", "html").select("shard", "page_id", "url", "html")
    index = ordered.mapInArrow(run, SCHEMA.format(kind))
    index.write.mode("overwrite").parquet(f"{home}/index")
    index = spark.read.schema(index.schema).parquet(f"{home}/index")
    _commit(index, home, c)
    return index


def _commit(index: DataFrame, home: str, c: Config) -> None:
    files = cut(index.groupBy("file").agg(F.count("*").alias("records"), F.max(F.col("offset") + F.col("length")).alias("bytes")))
    n = max(1, -(-files.count() // c.listed))

    def part(key: tuple, t: pa.Table) -> pa.Table:
        fs, root = _fs(home)
        t = t.select(["file", "records", "bytes"]).sort_by("file")
        for row in t.to_pylist():
            info = fs.get_file_info(f"{root}/{row['file']}")
            if info.size != row["bytes"]:
                raise OSError(f"{row['file']} has {info.size} bytes, its records end at {row['bytes']}")
        name = f"manifest-{key[0].as_py():05d}.json"
        task = TaskContext.get()
        temporary = f"{root}/_tmp/{name}.{task.stageId()}-{task.partitionId()}-{task.attemptNumber()}" if task else f"{root}/_tmp/{name}"
        with fs.open_output_stream(temporary, compression=None) as out:
            out.write(json.dumps(t.to_pylist(), indent=1).encode())
        fs.move(temporary, f"{root}/{name}")
        return pa.table([[name], [t.num_rows], [sum(t["records"].to_pylist())], [sum(t["bytes"].to_pylist())]], names=["part", "files", "records", "bytes"])

    fs, root = _fs(home)
    each = files.groupBy(F.pmod(F.xxhash64("file"), F.lit(n)).alias("part")).applyInArrow(part, "part string, files long, records long, bytes long")
    parts = sorted((r.asDict() for r in each.collect()), key=lambda r: r["part"])
    totals = {k: sum(p[k] for p in parts) for k in ("files", "records", "bytes")}
    text = json.dumps({"date": c.date, **totals, "parts": parts}, indent=1)
    with fs.open_output_stream(f"{root}/_tmp/manifest.json", compression=None) as out:
        out.write(text.encode())
    fs.move(f"{root}/_tmp/manifest.json", f"{root}/manifest.json")
    fs.delete_dir(f"{root}/_tmp")


def write_shared(pages: DataFrame, config: Config = Config()) -> DataFrame:
    """:func:`write` into a new folder in the shared one."""
    return write(pages, f"{shared_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}", config)
