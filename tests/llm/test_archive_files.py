"""Records rebuilt from the archive, and read from files."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from trigrid.llm import warc
from trigrid.llm.common import Workspace

LONG = "a very long page é\r\n\r\n" * 150_000
ROWS = [(1, "http://a", LONG), (2, None, LONG), (3, "u", "x\r\n\r\ny"), (3, "u", "x\r\n\r\ny"), (4, "u\r\n\r\nv", "z" * 1200), (5, "u", "z" * 1200), (5, "u", "z" * 1200), (6, "u", None), (None, "u", "z" * 1200)]


def test_records_and_files(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumns({"header": F.lit("clash"), "record": F.lit(1)})
    ws = Workspace(spark)
    warc.write_archive(pages, ws)
    want = []
    for i, _, html in ROWS:
        raw = (html or "").encode()
        refers = {1: 2, 4: 5}.get(i)
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if refers else "response", refers))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    got = warc.read_archive(ws)
    assert sorted(map(tuple, got.select(columns).collect()), key=repr) == sorted(want, key=repr)
    warc.export_warc(ws, ws.path("files"))
    back = warc.import_warc(spark, ws.path("files"))
    assert sorted(bytes(r.record) for r in back.collect()) == sorted(bytes(r.record) for r in warc.records(ws).collect())
    assert sorted(map(tuple, warc.resolved(warc.parse(back), ws).select(columns).collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("harm", ["shorter", "other"])
def test_harmed_records_fail(spark, harm):
    ws = Workspace(spark)
    warc.write_archive(spark.createDataFrame([(1, "u", "abc")], "page_id long, url string, html string"), ws)
    record = F.expr("substring(record, 1, octet_length(record) - 1)")
    if harm == "other":
        record = F.concat(record, F.lit(b"X"))
    with pytest.raises(Exception, match="not as long|match its payload"):
        warc.parse(warc.records(ws).select(record.alias("record"))).collect()
