"""Archives written and read back, and damaged ones."""

import gzip
import random

from pyspark.sql import functions as F

from seqlake.llm import warc as W

SCHEMA = "page_id long, url string, html string, row int, kept boolean, key string, first int, salt int, block string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, True, "k", 2, 3, "b") for r in rows], SCHEMA).repartition(3)


def texts(n=60):
    rng = random.Random(4)
    make = lambda k: "".join(rng.choice("ab é\r\n<>日") for _ in range(k))
    out = [(1, "http://a/\r\nX-Page-Id: 5", None), (2, None, ""), (3, "u", ""), (4, "u", "x" * 70_000), (5, "u", make(30_000)), (6, "u", "x" * 70_000)]
    nasty = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    out += [(7, "u", nasty), (8, "u", nasty * 400), (9, "u", "WARC/1.1\r\n" * 3), (None, "u", "no id"), (None, "u", "no id"), (10, "u", "no id"), (11, "u", "twice"), (11, "u", "twice")]
    out += [(20 + k, f"http://s{k % 3}/é", make(rng.randint(0, 9_000))) for k in range(n)]
    return out + [(200 + k, "u", "hot") for k in range(300)]


def want(rows):
    top, seen = {}, set()
    for d, _, t in rows:
        top[t or ""] = max(top.get(t or "", -1), -1 if d is None else d)
    out = []
    for d, _, t in rows:
        first = (-1 if d is None else d) == top[t or ""] and (t or "") not in seen
        seen |= {t or ""} if first else set()
        payload = (t or "").encode()
        out.append((d, len(payload), W.base32_sha1(payload), "response" if first else "revisit", None if first else top[t or ""]))
    return sorted(map(str, out))


def test_round_trip(spark, tmp_path):
    rows = texts()
    for k, sizes in enumerate(((8192, 2048), (37, 11), (10**9, 10**9))):
        path = f"file://{tmp_path}/{k}"
        W.write_warc(pages(spark, rows), path, segment_bytes=sizes[0], chunk_bytes=sizes[1])
        out = W.read_pages(spark, path).collect()
        assert all(r.whole for r in out)
        assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in out) == want(rows)
        found = W.read_payloads(spark, path).where("type = 'response'").collect()
        assert sorted(bytes(r.payload) for r in found) == sorted({(t or "").encode() for _, _, t in rows})
    assert W.read_records(spark, f"file://{tmp_path}/1").where("type = 'continuation' AND number > 100").count() > 0


def test_archives_are_plain_warc(spark, tmp_path):
    """A walk over the bytes by Content-Length alone meets every record; none holds the opening line in its block."""
    W.write_warc(pages(spark, texts(5)), f"file://{tmp_path}/w")
    n = 0
    for file in (tmp_path / "w").glob("*.gz"):
        data, at = gzip.decompress(file.read_bytes()), 0
        while at < len(data):
            assert data.startswith(W.OPENING, at)
            headers, start, length = W.parsed(data[at + len(W.OPENING):])
            block = data[at + len(W.OPENING) + start:][:length]
            assert W.OPENING not in block
            at += len(W.OPENING) + start + length
            assert data[at:at + 4] == b"\r\n\r\n"
            at, n = at + 4, n + 1
    assert n == W.read_records(spark, f"file://{tmp_path}/w").count()


def test_foreign_and_damaged_archives(spark, tmp_path):
    """Blocks that hold opening lines, lost, repeated and short segments, wrong digests and framing, dangling revisits."""
    inner = W.OPENING + b"WARC-Type: response\r\nContent-Length: 2\r\n\r\nxx\r\n\r\n"
    http = lambda body, head=b"": b"HTTP/1.1 200 OK\r\n" + head + b"\r\n" + body
    rec = lambda i, kind, block, *more: W.record([("WARC-Type", kind), ("WARC-Record-ID", i), *more], block) + b"\r\n"
    cont = lambda i, origin, n, block, total=None: rec(i, "continuation", block, ("WARC-Segment-Origin-ID", origin), ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", total))
    one = ("WARC-Segment-Number", 1)
    data = rec("a", "response", http(inner * 3)) + rec("i", "warcinfo", b"software: x") + cont("c3", "b", 3, b"c", len(http(b"abc"))) + rec("b", "response", http(b"a"), one) + cont("c2", "b", 2, b"b")
    data += rec("lost", "response", http(b"a"), one) + cont("l3", "lost", 3, b"c", len(http(b"abc"))) + rec("first", "response", http(b"a"), one)
    data += rec("short", "response", http(b"a"), one) + cont("s2", "short", 2, b"b", 999) + rec("wrong", "response", http(b"a"), ("WARC-Payload-Digest", "sha1:AAAA"))
    data += rec("broken", "response", http(b"5\r\nab", b"Transfer-Encoding: chunked\r\n")) + rec("ok", "response", http(b"2;x=1\r\nab\r\n0\r\n\r\n", b"transfer-encoding: gzip, Chunked\r\n"))
    data += rec("none", "revisit", b"", ("WARC-Refers-To", "missing")) + rec("cut", "response", http(b"abc"))[:-7]
    (tmp_path / "f.warc.gz").write_bytes(gzip.compress(data[:200]) + gzip.compress(data[200:]))
    got = {r.record_id: (r.payload and bytes(r.payload), r.whole) for r in W.read_payloads(spark, f"file://{tmp_path}/f.warc.gz").collect()}
    assert got.pop("i") == (None, True)
    assert got == {
        "a": (inner * 3, True), "b": (b"abc", True), "lost": (b"ac", False), "first": (b"a", False), "short": (b"ab", False), "wrong": (b"a", False),
        "broken": (None, False), "ok": (b"ab", True), "none": (None, True), "cut": (b"", False) if got["cut"][0] == b"" else (b"abc"[: len(got["cut"][0])], False),
    }
    end = {r.record_type: r for r in W.read_pages(spark, f"file://{tmp_path}/f.warc.gz").where(F.col("payload_bytes").isNull()).collect()}
    assert not end["revisit"].whole and not end["response"].whole


def test_empty_table(spark, tmp_path):
    W.write_warc(pages(spark, texts(1)).where("false"), f"file://{tmp_path}/e")
    assert W.read_pages(spark, f"file://{tmp_path}/e").count() == 0
