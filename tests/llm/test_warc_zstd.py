import base64
import hashlib
import os
import struct

import pytest
import zstandard

from ordergate.llm import warc_zstd as W
from ordergate.llm.common import new_folder, new_path


def rows():
    big = "<p>" + "é" * 200_000
    return [(1, "http://a/ b\r\nX: y", "<html>one</html>"), (2, None, "<html>one</html>"), (9, "http://c/ü", "<html>one</html>"),
            (3, "u", None), (4, "u", ""), (5, "u", big), (6, "u", "\r\n\r\nWARC/1.1"), (None, "u", "no id"), (7, "u", "x"), (7, "u", "x")]


def test_round_trip(spark):
    df = spark.createDataFrame(rows(), "page_id bigint, url string, html string").selectExpr("*", "'x' AS digest", "'y' AS payload").repartition(3)
    folder = new_path(spark, "test-warc")
    manifest = W.write_archives(df, folder, archive_bytes=300).collect()
    assert sum(m.records for m in manifest) == len(rows()) and len(manifest) > 3
    got = W.read_archives(spark, folder).collect()
    assert len(got) == len(rows())
    payloads = {i: (t or "").encode() for i, _, t in rows()}
    for r in got:
        own = payloads[r.page_id]
        assert r.payload_bytes == len(own)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(own).digest()).decode()
        keep = {1: 9, 2: 9, 3: 4}.get(r.page_id)
        assert (r.record_type, r.refers_to) == (("revisit", keep) if keep else ("response", None))
        assert r.payload == (None if keep else own)
    assert all("\r" not in (r.url or "") for r in got)
    again = W.write_archives(df, folder, archive_bytes=300).collect()      # a repeated run replaces its files
    assert sorted(again) == sorted(manifest) and W.read_archives(spark, folder).count() == len(rows())
    assert W.archive_round_trip(df.limit(0)).collect() == []


def test_smaller_payloads_are_all_responses(spark):
    df = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "bbbb"), (4, "u", "bbbb")], "page_id bigint, url string, html string")
    folder = new_path(spark, "test-warc")
    W.write_archives(df, folder, least_bytes=3)
    assert {r.page_id: r.record_type for r in W.read_archives(spark, folder).collect()} == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def archive(records, dictionary=b"", compressed=False):
    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    coder = zstandard.ZstdCompressor(dict_data=d, write_checksum=True)
    head = zstandard.compress(dictionary) if compressed else dictionary
    return struct.pack("<II", W.DICTIONARY_MAGIC, len(head)) + head + b"".join(coder.compress(r) for r in records)


@pytest.mark.parametrize("compressed", [False, True])
@pytest.mark.parametrize("trained", [False, True])
def test_dictionary_of_the_leading_frame(compressed, trained):
    samples = [f"<html><body class='page'><p>text {i} {i * i}</p></body></html>".encode() * 20 for i in range(300)]
    dictionary = W.train(samples) if trained else b"plain sample bytes " * 20
    made = [W.record(i, "http://x/", s) for i, s in enumerate(samples[:50])]
    got = list(W.read_archive(archive(made, dictionary, compressed)))
    assert [b.partition(b"\r\n\r\n")[2] for _, b in got] == samples[:50]


def test_damage_is_found():
    good = W.record(1, "http://x/", b"payload")
    whole = archive([good, good])
    assert len(list(W.read_archive(whole))) == 2
    cases = {"cut": whole[:-3], "frame": whole + b"junk1234", "skippable": whole[:6], "length": archive([good.replace(b"payload", b"payloads")]),
             "digest": archive([good.replace(b"payload", b"PAYLOAD")]), "header": archive([good.replace(b"WARC-Date", b"X-Date")]),
             "version": archive([b"HTTP" + good[4:]]), "checksum": whole[:-2] + bytes([whole[-2] ^ 255]) + whole[-1:]}
    for name, data in cases.items():
        with pytest.raises(ValueError, match="file at byte"):
            list(W.read_archive(data, "file"))
            pytest.fail(name)
    assert list(W.read_archive(b"")) == []


def test_unfinished_attempts_are_not_read(spark):
    df = spark.createDataFrame([(1, "u", "a")], "page_id bigint, url string, html string")
    folder = new_folder(spark, new_path(spark, "test-warc"))
    W.write_archives(df, folder)
    with open(os.path.join(folder.removeprefix("file://"), "_attempt-99-0"), "wb") as f:
        f.write(b"half an archive")
    assert W.read_archives(spark, folder).count() == 1
