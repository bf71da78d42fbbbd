import base64
import gzip
import hashlib

import pytest

from plumbline.llm import warc
from plumbline.llm.common import files
from plumbline.session import work_path


def pages(spark):
    rows = [
        (5, "http://a/5", "<p>same</p>"),
        (3, "http://a/3\r\nX: y", "<p>same</p>"),
        (9, None, "<p>same</p>"),
        (None, "http://a/null", "<p>same</p>"),
        (1, "http://ä/1", None),
        (2, "http://a/2", ""),
        (2, "http://a/2", ""),
        (4, "http://a/4", "ü\r\n\r\n" * 50_000),
        (None, None, "only null ids"),
        (7, "http://a/7", "x" * 3),
        (7, "http://a/7", "x" * 3),
    ]
    return spark.createDataFrame([(*r, "z") for r in rows], "page_id bigint, url string, html string, sha1 string")


def want(rows, smallest):
    out = []
    for key, _, html, _ in rows:
        data = (html or "").encode()
        same = [k for k, _, h, _ in rows if (h or "").encode() == data and k is not None]
        first = min(same) if same and len(data) >= smallest else None
        other = first is not None and key != first
        out.append((str(key), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if other else "response", str(first if other else None)))
    return sorted(out)


@pytest.mark.parametrize("smallest", [0, 5])
@pytest.mark.parametrize("range_bytes", [64, 1 << 20])
def test_round_trip(spark, smallest, range_bytes):
    df = pages(spark)
    rows = [tuple(r) for r in df.collect()]
    index = warc.write_archives(df, work_path(spark, "warc"), smallest=smallest)
    assert index.count() == len(rows)
    got = warc.read_records(index, payloads=True, gap=10, range_bytes=range_bytes).collect()
    found = sorted((str(r["id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in got)
    assert found == want(rows, smallest)
    for r in got:
        assert (r["payload"] is None) == (r["record_type"] == "revisit")
        if r["payload"] is not None:
            assert len(r["payload"]) == r["payload_bytes"]


def test_a_selection_reads_only_its_records(spark):
    index = warc.write_archives(pages(spark).coalesce(1), work_path(spark, "warc"))
    some = warc.read_records(index.where("id in (4, 7)")).collect()
    assert sorted(r["id"] for r in some) == [4, 7, 7]


def test_members_are_plain_gzip_and_damage_is_an_error(spark):
    index = warc.write_archives(pages(spark).where("page_id = 4").coalesce(1), work_path(spark, "warc"))
    row = index.first()
    fs, name = files(row["path"])
    with fs.open_input_file(name) as file:
        data = file.read()
    text = gzip.decompress(data[row["offset"] : row["offset"] + row["length"]])
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and text.endswith(b"\r\n\r\n")
    with fs.open_output_stream(name, compression=None) as out:
        out.write(warc.record("4", "http://a/4", b"other", row["digest"], 5, None).ljust(len(data), b"\0")[: len(data)])
    with pytest.raises(Exception, match="damaged|Error"):
        warc.read_records(index).collect()


def test_empty_table(spark):
    assert warc.round_trip(pages(spark).limit(0)).count() == 0
