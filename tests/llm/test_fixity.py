import hashlib

from pyspark.sql import functions as F

from retainly.llm import fixity

from .helpers import SMALL, frame

def by_seven():
    return F.floor(F.col("page_id") / 7)

SCHEMA = "page_id bigint, url string, html string, note string"


def pages(n=60):
    return [(i, f"http://h/{i}", "<p>" + "x" * (i * 37 % 5000) + "é" * (i % 3), "n") for i in range(n)] + [(n, None, None, None), (None, "u", "h", "")]


def plain(rows):
    """file, page_id -> (offset, length, digest) by laying the files out in order."""
    made, at = {}, {}
    for p, url, html, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        file = None if p is None else p // 7
        body = (html or "").encode()
        record = (f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{'' if p is None else p}>\r\nWARC-Target-URI: {url or ''}\r\n"
                  f"Content-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n").encode() + body + b"\r\n\r\n"
        made[file, p] = (at.get(file, 0), len(record), hashlib.sha256(record).hexdigest())
        at[file] = at.get(file, 0) + len(record)
    return made


def test_records_lie_where_the_files_have_them(spark, tmp_path):
    rows = pages()
    found = fixity.records(frame(spark, rows, SCHEMA), by_seven())
    want = plain(rows)
    assert {(r.file, r.page_id): (r.offset, r.length, r.digest) for r in found.collect()} == want
    fixity.write(frame(spark, [r for r in rows if r[0] is not None], SCHEMA), by_seven(), str(tmp_path / "warc"))
    for k in range(9):
        files = [f for f in (tmp_path / "warc" / f"file={k}").iterdir() if f.name.startswith("part-")]
        data = b"".join(f.read_bytes() for f in files)
        assert len(files) == 1
        for (file, _), (offset, length, digest) in want.items():
            if file == k:
                assert hashlib.sha256(data[offset : offset + length]).hexdigest() == digest


def test_audit_finds_what_differs_and_nothing_else(spark):
    found = fixity.records(frame(spark, pages(), SCHEMA), by_seven())
    ours = [tuple(r) for r in found.collect() if r.page_id is not None]
    theirs = [r for r in ours if r[1] not in (3, 50)]
    theirs = [(*r[:4], "0" * 64) if r[1] in (10, 11, 59) else r for r in theirs] + [(99, 700, 0, 5, "a" * 64), (2, 701, 10**6, 5, "b" * 64)]
    schema = "file bigint, page_id bigint, offset bigint, length bigint, digest string"
    got = {(r.page_id, r.status) for r in fixity.audit(frame(spark, ours, schema), frame(spark, theirs, schema)).collect()}
    assert got == {(3, "missing"), (50, "missing"), (10, "corrupt"), (11, "corrupt"), (59, "corrupt"), (700, "extra"), (701, "extra")}
    assert fixity.audit(found, found).count() == 0
    assert fixity.audit(found, found.limit(0)).count() == found.count() and fixity.audit(found.limit(0), found.limit(0)).count() == 0


def test_damage_by_rule_is_found_whole(spark):
    table = spark.read.parquet(f"{SMALL}/pages.parquet")
    file = F.floor(F.col("page_id") / 16)
    ours = fixity.records(table, file)
    got = {(r.page_id, r.status) for r in fixity.audit(ours, fixity.damaged(ours, table, file)).collect()}
    ids = [r.page_id for r in table.collect()]
    assert got == {(i, "missing") for i in ids if i % 211 == 7} | {(i, "corrupt") for i in ids if i % 97 == 5}
