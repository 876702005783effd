from __future__ import annotations

import gzip
import hashlib
import json
import base64
import uuid
from collections import Counter
from pathlib import Path

from lodestar.llm import warc as W


def parse(raw: bytes):
    """(headers, block) of each record."""
    out = []
    while raw:
        head, _, rest = raw.partition(b"\r\n\r\n")
        first, *lines = head.decode().split("\r\n")
        assert first == "WARC/1.1"
        h = dict(x.split(": ", 1) for x in lines)
        n = int(h["Content-Length"])
        assert rest[n : n + 4] == b"\r\n\r\n"
        out.append((h, rest[:n]))
        raw = rest[n + 4 :]
    return out


def sha(raw):
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def pages(spark, n=300):
    rows = [(i, f"https://e{i % 17}.example/{i}", f"<p>{i} größe</p>" * (1 + i * 37 % 200), 1) for i in range(n)]
    rows += [(None, None, None, 2), (5000, "", "", 2), (5001, "http://a b\r\nX: y", "<i>", 2), (None, "", None, 2), (5002, "http://long.example", "z" * 400_000, 2), rows[3], rows[3]]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string, shard int")


def listed_files(folder: Path):
    manifest = json.loads((folder / "manifest.json").read_text())
    files = [f for p in manifest["parts"] for f in json.loads((folder / p["part"]).read_text())]
    assert [manifest[k] for k in ("files", "records", "bytes")] == [len(files), sum(f["records"] for f in files), sum(f["bytes"] for f in files)]
    return files


def test_round_trip_and_commit(spark, tmp_path):
    rows, df = pages(spark)
    c = W.Config(shard=60_000, roll=8_000)
    index = W.write(df.repartition(5), str(tmp_path / "a"), c)
    got = Counter()
    listed = index.collect()
    files = listed_files(tmp_path / "a")
    assert {f["file"] for f in files} == {r.file for r in listed} == {p.name for p in (tmp_path / "a").glob("*.warc.gz")}
    assert not (tmp_path / "a/_tmp").exists() and len(files) > 3
    ids, last = set(), ""
    for f in sorted(files, key=lambda f: f["file"]):
        raw = (tmp_path / "a" / f["file"]).read_bytes()
        records = parse(gzip.decompress(raw))
        assert records[0][0]["WARC-Type"] == "warcinfo" and len(records) == f["records"] + 1
        assert len(raw) <= c.roll or f["records"] == 1 or len(raw) <= c.roll + 600
        for h, block in records[1:]:
            assert h["WARC-Block-Digest"] == sha(block)
            payload = block.partition(b"\r\n\r\n")[2]
            assert h["WARC-Payload-Digest"] == sha(payload)
            ids.add(h["WARC-Record-ID"])
            got[h["WARC-Target-URI"], payload.decode()] += 1
    assert got == Counter((W.uri(u, i), h or "") for i, u, h, _ in rows) and len(ids) == len(rows)
    for r in listed:
        raw = (tmp_path / "a" / r.file).read_bytes()[r.offset : r.offset + r.length]
        (h, _), = parse(gzip.decompress(raw))
        assert h["WARC-Payload-Digest"] == r.payload_digest and h["WARC-Target-URI"] == W.uri(r.url, r.page_id)
    del last


def test_same_bytes_in_any_partitioning(spark, tmp_path):
    _, df = pages(spark, 120)
    c = W.Config(shard=30_000, roll=8_000)
    for name, n in (("a", 1), ("b", 6)):
        W.write(df.repartition(n), str(tmp_path / name), c)
    a, b = ({p.name: p.read_bytes() for p in Path(tmp_path / x).glob("*.warc.gz")} for x in "ab")
    assert a == b and a


def test_files_are_in_order_of_url(spark, tmp_path):
    _, df = pages(spark, 200)
    rows = W.write(df, str(tmp_path / "a"), W.Config(shard=30_000, roll=8_000)).collect()
    urls = [r.url or "" for r in sorted(rows, key=lambda r: (r.file, r.offset))]
    assert urls == sorted(urls)


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert W.write(df, str(tmp_path / "a")).count() == 0
    manifest = json.loads((tmp_path / "a/manifest.json").read_text())
    assert manifest["files"] == 0 and manifest["parts"] == []


def contents(folder: Path):
    out = Counter()
    for p in folder.glob("*.warc.gz"):
        for h, block in parse(gzip.decompress(p.read_bytes()))[1:]:
            out[h["WARC-Target-URI"], block.partition(b"\r\n\r\n")[2].decode()] += 1
    return out


def test_more_shards_than_ranges(spark, tmp_path):
    rows, df = pages(spark)
    c = W.Config(shard=3_000, roll=8_000, fan=4, sample=32, listed=30)
    for name, n in (("a", 1), ("b", 6)):
        index = W.write(df.repartition(n), str(tmp_path / name), c)
    a, b = ({p.name: p.read_bytes() for p in Path(tmp_path / x).glob("*.warc.gz")} for x in "ab")
    assert a == b and len({name.split("-")[1] for name in a}) > 20
    assert contents(tmp_path / "a") == Counter((W.uri(u, i), h or "") for i, u, h, _ in rows)
    urls = [r.url or "" for r in sorted(index.collect(), key=lambda r: (r.file, r.offset))]
    assert urls == sorted(urls)
    assert len(listed_files(tmp_path / "a")) == len(a) and len(json.loads((tmp_path / "a/manifest.json").read_text())["parts"]) > 1


def test_page_ids_of_any_type_and_a_second_run(spark, tmp_path):
    rows = [("x1", "http://a", "<p>", 1), ("x1", "http://a", "<p>", 1), (None, "http://a", None, 1), ("", None, "", 1), ("x2", "http://b", "ü", 1)]
    df = spark.createDataFrame(rows, "page_id string, url string, html string, file int")
    first = sorted(map(tuple, W.write(df, str(tmp_path / "a")).collect()), key=str)
    bytes_ = {p.name: p.read_bytes() for p in (tmp_path / "a").glob("*.warc.gz")}
    assert sorted(map(tuple, W.write(df.repartition(3), str(tmp_path / "a")).collect()), key=str) == first  # over files that are there
    assert {p.name: p.read_bytes() for p in (tmp_path / "a").glob("*.warc.gz")} == bytes_ and len(first) == 5
    assert contents(tmp_path / "a") == Counter((W.uri(u, i), h or "") for i, u, h, _ in rows)


def test_against_a_plain_writer(spark, tmp_path):
    """One shard, written by a loop over all rows in order: names, rolls, headers and bytes."""
    rows, df = pages(spark, 150)
    c = W.Config(shard=1 << 40, roll=9_000)
    W.write(df.repartition(4), str(tmp_path / "a"), c)
    number = {i: h for i, h in enumerate(spark.createDataFrame([(i, r[2] or "") for i, r in enumerate(rows)], "i int, h string").selectExpr("i", "hex(xxhash64(h))").orderBy("i").toPandas().iloc[:, 1])}
    key = lambda k: (" ".join([rows[k][1] or "", "" if rows[k][0] is None else str(rows[k][0]).rjust(20, "0")]) + " " + number[k], rows[k][1] or "", rows[k][0] is not None, rows[k][0] or 0, rows[k][2] or "", rows[k][1] is not None, rows[k][2] is not None)
    files, seen = [], {}
    for k in sorted(range(len(rows)), key=key):
        page_id, url, html, _ = rows[k]
        nth = seen[page_id, url or "", html or ""] = seen.get((page_id, url or "", html or ""), -1) + 1
        payload = (html or "").encode()
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + b"\r\n\r\n" + payload
        target = W.uri(url, page_id)
        name = uuid.uuid5(uuid.NAMESPACE_URL, f"{target}\0{url or ''}\0{page_id}\0{sha(payload)}\0{nth}")
        head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Date: {c.date}\r\nWARC-Target-URI: {target}\r\nWARC-Payload-Digest: {sha(payload)}\r\n"
        head += f"Content-Type: application/http; msgtype=response\r\nWARC-Block-Digest: {sha(block)}\r\nContent-Length: {len(block)}\r\n\r\n"
        member = W._member(head.encode() + block + b"\r\n\r\n", c.level)
        assert gzip.decompress(member) == head.encode() + block + b"\r\n\r\n"
        if not files or (files[-1][1] and len(files[-1][0]) + len(member) > c.roll):
            file = f"{c.name}-{0:07d}-{len(files):05d}.warc.gz"
            files.append([W._member(W._info(file, c), c.level), 0, file])
        files[-1][0] += member
        files[-1][1] += 1
    got = {p.name: p.read_bytes() for p in (tmp_path / "a").glob("*.warc.gz")}
    assert got == {name: raw for raw, _, name in files} and len(got) > 3
