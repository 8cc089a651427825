"""Archives against a plain rule over all rows, their bytes against Python's gzip, and what is left after a broken run."""

import base64
import gzip
import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestone.llm.warc import archived, read_archives, uri, warc_sql, write_archives

SCHEMA = "page_id long, url string, html string"
PAGES = [(i, f"http://a.example/{i}", f"<p>{i % 7}</p>" * (i % 5)) for i in range(60)]
AWKWARD = [(100, None, None), (101, "http://b/\r\nX: y", ""), (102, "http://b/ü ö", "日本\r\n\r\nWARC/1.1"), (103, "u", "x" * 300_000), (5, "http://again", PAGES[5][2]), (5, "http://again", PAGES[5][2]), (5, "other text", "other"), (None, "no id", "<p>1</p>"), (None, "no id", "alone"), (None, "no id", "alone")]


def by_rule(rows, least=0):
    """Of equal payloads the smallest page first, null last."""
    first, out = {}, []
    for page, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (html or "").encode()
        sha = base64.b32encode(hashlib.sha1(data).digest()).decode()
        seen = len(data) >= least and data in first
        out.append((page, len(data), sha, "revisit" if seen else "response", first[data] if seen else None))
        first.setdefault(data, page)
    return sorted(out, key=repr)


def told(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


@pytest.mark.parametrize("least", [0, 10])
def test_read_back_equals_rule(spark, least):
    pages = spark.createDataFrame(PAGES + AWKWARD, SCHEMA).repartition(5)
    assert told(archived(pages, revisit_from=least)) == by_rule(PAGES + AWKWARD, least)


def files(folder):
    return {p.name: p.read_bytes() for p in Path(folder).iterdir() if p.name.endswith(".warc.gz")}


def test_same_bytes_however_rows_are_dealt(spark, tmp_path):
    pages = spark.createDataFrame(PAGES + AWKWARD, SCHEMA)
    for name, df in (("a", pages.repartition(7)), ("b", pages.orderBy(F.col("html").desc()).coalesce(1))):
        write_archives(df, f"file://{tmp_path}/{name}", shards=3, roll_bytes=2000)
    a, b = files(tmp_path / "a"), files(tmp_path / "b")
    assert a == b and len(a) > 3
    whole = b"".join(gzip.decompress(a[k]) for k in sorted(a))
    assert whole.count(b"\r\nWARC-Record-ID: ") == len(PAGES + AWKWARD) == len({x.split(b"\r\n")[0] for x in whole.split(b"WARC-Record-ID: ")[1:]})
    at = [int(x.split(b"\r\n")[0]) for x in whole.split(b"\r\nPage: ")[1:]]
    assert at == sorted(at)
    back = read_archives(spark, f"file://{tmp_path}/a")
    assert {(r["page_id"], bytes(r["payload"]).decode()) for r in back.where("record_type = 'response'").collect()} <= {(p, h or "") for p, _, h in PAGES + AWKWARD}


def test_reader_sees_only_what_the_manifest_names(spark, tmp_path):
    folder = f"file://{tmp_path}/x"
    write_archives(spark.createDataFrame(PAGES, SCHEMA), folder, shards=2)
    (tmp_path / "x" / "pages-000009-00000.warc.gz").write_bytes(b"left by a task that died")
    (tmp_path / "x" / ".half").write_bytes(b"half a file")
    assert told(read_archives(spark, folder)) == by_rule(PAGES)
    write_archives(spark.createDataFrame(PAGES[:9], SCHEMA), folder, shards=2)
    assert told(read_archives(spark, folder)) == by_rule(PAGES[:9])


def test_damage_is_an_error(spark, tmp_path):
    folder = tmp_path / "y"
    write_archives(spark.createDataFrame(PAGES, SCHEMA), f"file://{folder}", shards=2)
    name, data = next(iter(files(folder).items()))
    (folder / f".{name}.crc").unlink(missing_ok=True)
    (folder / name).write_bytes(data[: len(data) // 2])
    with pytest.raises(Exception, match="ends within a record|incorrect|records"):
        read_archives(spark, f"file://{folder}").collect()


def test_empty_table_and_clashing_columns(spark):
    assert archived(spark.createDataFrame([], SCHEMA)).count() == 0
    clashing = spark.createDataFrame([(1, "u", "h", 2, "d", b"p")], SCHEMA + ", shard int, digest string, payload binary")
    assert told(archived(clashing)) == by_rule([(1, "u", "h")])


def test_no_url_ends_a_line():
    assert uri("http://b/\r\nX: y") == "http://b/%0D%0AX:%20y" and uri(None) == "about:invalid"


def test_sql_gives_the_same(spark):
    import duckdb

    data = "/root/testdata/sf0.001"
    if not Path(data).exists():
        pytest.skip("needs the driver's tables")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{data}/pages.parquet' UNION ALL SELECT page_id + 1000, url, html FROM '{data}/pages.parquet' WHERE page_id % 3 = 0")
    pages = spark.read.parquet(f"{data}/pages.parquet")
    both = pages.unionByName(pages.where("page_id % 3 = 0").withColumn("page_id", F.col("page_id") + 1000))
    assert sorted(map(repr, con.execute(warc_sql()).fetchall())) == sorted(map(repr, told(archived(both))))
