import base64
import hashlib
import io
import random

from tallyglass.llm import warc as W

SF = "/root/testdata/sf0.01"


class Mem(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def expected(rows, least=0):
    first, n = {}, {}
    for i, _, h in rows:
        p = (h or "").encode()
        n[p] = n.get(p, 0) + 1
        if i is not None:
            first[p] = min(first.get(p, i), i)
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        refer = first.get(p) if n[p] > 1 and len(p) >= least and i != first.get(p) else None
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if refer is None else "revisit", refer))
    return sorted(out, key=str)


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted((tuple(r) for r in W.op4_warc(spark, SF).collect()), key=str) == expected(rows)


def test_edges(spark, tmp_path):
    rows = [(1, "u\r\nWARC/1.1", "<p>é"), (2, None, "<p>é"), (3, "http://ü/ x", None), (4, "v", ""), (None, "w", "z" * 300_000), (6, "", "z" * 300_000), (7, "r", "same"), (7, "r", "same"), (8, "r", "same")]
    pages = spark.createDataFrame([(*r, 5, "x") for r in rows], "page_id long, url string, html string, size int, sha string")
    for least in (0, 5):
        manifest = W.write_archives(pages, f"file://{tmp_path}/a{least}", archive_bytes=100, revisit_bytes=least)
        got = W.read_archives(manifest).collect()
        assert {r.kind for r in got} == {"record"}
        mine = sorted(((int(r.record_id) if r.record_id else None, r.payload_bytes, r.payload_digest, r.record_type, int(r.refers_to) if r.refers_to else None) for r in got), key=str)
        assert mine == expected(rows, least)
        bodies = {r.record_id: bytes(r.payload) for r in got if r.record_type == "response"}
        assert bodies["1"] == "<p>é".encode() and bodies["7"] == b"same"
    assert W.read_archives(W.write_archives(pages.limit(0), f"file://{tmp_path}/none")).count() == 0


def test_salvage():
    rng = random.Random(2)
    payloads = [bytes(rng.randrange(256) for _ in range(rng.randrange(3000))) for _ in range(20)]
    raw = [W.record_bytes(str(i), "http://x/", p, W.payload_digest(p), None) for i, p in enumerate(payloads)]
    for pack in (W._member, lambda r: r):
        parts = [pack(r) for r in raw]
        starts = [sum(map(len, parts[:i])) for i in range(21)]
        data = bytearray(b"".join(parts))
        for i in (3, 4, 11):
            data[starts[i] + len(parts[i]) // 2] ^= 0xFF
        junk = b"junk" * 10
        data[starts[15] : starts[15]] = junk
        data = data[:-5]
        found = list(W.salvage(Mem(bytes(data))))
        good = [x[3]["id"] for x in found if x[0] == "record"]
        assert good == [str(i) for i in range(20) if i not in (3, 4, 11, 19)]
        assert all(x[3]["payload"] == payloads[int(x[3]["id"])] for x in found if x[0] == "record")
        gaps = [(x[1], x[2]) for x in found if x[0] == "gap"]
        assert (starts[3], starts[5]) in gaps and (starts[11], starts[12]) in gaps and (starts[15], starts[15] + len(junk)) in gaps
        edges = sorted((x[1], x[2]) for x in found)
        assert edges[0][0] == 0 and edges[-1][1] == len(data) and all(a[1] <= b[0] for a, b in zip(edges, edges[1:], strict=False))
    assert list(W.salvage(Mem(b""))) == [] and [x[0] for x in W.salvage(Mem(b"nothing here"))] == ["gap"]


def test_several_records_in_one_member():
    payloads = [b"one", b"", b"three" * 50, b"four", b"five"]
    raw = [bytearray(W.record_bytes(str(i), "http://x/", p, W.payload_digest(p), None)) for i, p in enumerate(payloads)]
    whole = W._member(b"".join(raw))
    found = list(W.salvage(Mem(whole)))
    assert [(x[0], x[1], x[2], x[3]["id"], x[3]["payload"]) for x in found] == [("record", 0, len(whole), str(i), p) for i, p in enumerate(payloads)]
    raw[2][-20] ^= 0xFF
    hurt = W._member(b"".join(raw) + b"WARC/1.1\r\nbroken: yes\r\n\r\n") + W._member(bytes(raw[4]))
    found = list(W.salvage(Mem(hurt)))
    assert [x[3]["id"] for x in found if x[0] == "record"] == ["0", "1", "3", "4", "4"]
    gaps = [x for x in found if x[0] == "gap"]
    lo = len(raw[0]) + len(raw[1])
    assert len(gaps) == 2 and gaps[0][3].endswith(f"(bytes {lo} to {lo + len(raw[2])} of the member)") and "headers missing" in gaps[1][3]
    alone = W._member(bytes(raw[2]))
    assert [(x[0], x[1], x[2]) for x in W.salvage(Mem(alone + W._member(bytes(raw[0]))))][0] == ("gap", 0, len(alone))
