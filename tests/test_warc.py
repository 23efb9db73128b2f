"""The archive source on hand-made archives."""

import gzip
import os
import pickle
import random
import re

import pytest

from inputs import warc_record, write_archive
from gleanery.plans.job import read_records
from gleanery.sources import warc
from gleanery.sources.files import list_archives, spark_path
from gleanery.sources.warc import WarcReader, read_payload


def rows(spark, directory, **options):
    found = read_records(spark, str(directory), **options).collect()
    return sorted(((os.path.basename(r.archive), r.record_offset, r.record_position, r.name,
                    None if r.payload is None else bytes(r.payload)) for r in found
                   if r.error is None), key=lambda r: r[:3])


def errors(spark, directory):
    return {os.path.basename(r.archive): r.error
            for r in read_records(spark, str(directory)).where("error is not null").collect()}


def test_only_direct_gz_files(tmp_path):
    for name in ("b.gz", "a.warc.gz", ".hidden.gz", "_x.gz", "no.warc", "c.GZ"):
        (tmp_path / name).write_bytes(b"")
    (tmp_path / "sub.gz").mkdir()
    (tmp_path / "sub.gz" / "inner.gz").write_bytes(b"")
    assert [os.path.basename(p) for p, _ in list_archives(f"{tmp_path}/")] == [
        "_x.gz", "a.warc.gz", "b.gz"]
    assert list_archives(str(tmp_path / "b.gz")) == [(f"{tmp_path}/b.gz", 0)]


def test_paths_mean_the_same_to_spark(tmp_path):
    assert spark_path("/a/b") == spark_path("/a/./b") == "file:/a/b"
    assert spark_path("s3://bucket/a") == "s3://bucket/a"
    assert spark_path("file:///a") == "file:///a" and spark_path("file:/a") == "file:/a"
    (tmp_path / "x.gz").write_bytes(b"")
    for path in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}"):
        assert [size for _, size in list_archives(path)] == [0]


def test_response_records_and_bodies(spark, tmp_path):
    write_archive(tmp_path / "a.gz", [
        warc_record("warcinfo", None, b"software: x", "application/warc-fields"),
        warc_record("response", "http://x/1", b"one\r\n\r\ntwo"),
        warc_record("request", "http://x/1", b""),
        warc_record("response", "dns:x", b"raw\r\n\r\nkept", "text/dns", http=None),
        warc_record("response", None, b"nameless"),
        warc_record("response", "http://x/2", b"", http=b"HTTP/1.1 204 No Content\r\n"),
        warc_record("response", "http://x/2p", b"<p>one</p>\n\n<p>two</p>", http=None,
                    content_type="application/http"),
        warc_record("response", "http://x/3", b"lf", http=b"HTTP/1.1 200 OK\nA: b\n\n"),
        b"WARC/1.0\nwarc-type: Response\nWARC-Target-URI: http://x/\n  folded\n"
        b"junk line\nContent-Length: 3\n\nabc\n\n"])
    assert [r[3:] for r in rows(spark, tmp_path)] == [
        ("http://x/1", b"one\r\n\r\ntwo"), ("dns:x", b"raw\r\n\r\nkept"), (None, b"nameless"),
        ("http://x/2", b"HTTP/1.1 204 No Content\r\n"),
        ("http://x/2p", b"<p>one</p>\n\n<p>two</p>"), ("http://x/3", b"lf"), ("http://x/ folded", b"abc")]
    assert errors(spark, tmp_path) == {}
    notes = read_records(spark, str(tmp_path)).where("note is not null").collect()
    assert [(r.name, r.note) for r in notes] == [
        ("http://x/2", "HTTP header block without an end")]


def test_long_header_lines(spark, tmp_path):
    """Longer than any buffer; a name is kept whole."""
    long, uri = b"X-Long: " + b"z" * (3 << 20), "http://x/" + "u" * (2 << 20) + "/end"
    write_archive(tmp_path / "a.gz", [
        warc_record("response", "http://x/1", b"one").replace(b"WARC-Type", long + b"\r\nWARC-Type"),
        warc_record("response", uri, b"two")])
    assert [r[3:] for r in rows(spark, tmp_path)] == [("http://x/1", b"one"), (uri, b"two")]
    assert errors(spark, tmp_path) == {}


def test_bounds_of_headers_are_told(tmp_path, monkeypatch):
    """A line beyond the bound ends the archive, a long HTTP block leaves a note."""
    monkeypatch.setattr(warc, "MAX_LINE", 100_000)
    monkeypatch.setattr(warc, "MAX_HEAD", 100_000)
    path = str(tmp_path / "a.gz")
    head = b"HTTP/1.1 200 OK\r\nX: " + os.urandom(200_000).replace(b"\n", b"") + b"\r\n\r\n"
    write_archive(path, [warc_record("response", "http://x/1", b"one", http=head),
                         warc_record("response", "http://x/" + "u" * 900_000, b"two"),
                         warc_record("response", "http://x/3", b"three")])
    reader = WarcReader({"path": path})
    found = [r for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()]
    assert [r["name"] for r in found] == ["http://x/1", None]
    assert found[0]["payload"] == head + b"one"
    assert re.fullmatch("HTTP header block without an end in its first [0-9]+ bytes",
                        found[0]["note"])
    assert found[1]["error"] == "ArchiveError: header line of more than 100000 bytes"


def test_pieces_of_payloads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "PIECE_BYTES", 100_000)
    bodies = [b"", b"abc", os.urandom(350_000), b"x" * 100_000]
    for name, single in (("a.gz", False), ("b.gz", True)):
        write_archive(tmp_path / name, [
            warc_record("response", f"http://x/{i}", b) for i, b in enumerate(bodies)],
            single_member=single)
    places = read_records(spark, str(tmp_path), max_payload_bytes=10).select(
        "archive", "record_offset", "record_position", "name").coalesce(1) \
        .sortWithinPartitions("archive", "record_offset", "record_position")
    pieces = places.mapInArrow(warc.read_pieces, (
        "archive string, record_offset bigint, record_position bigint, name string, piece int,"
        " payload binary")).orderBy("archive", "name", "piece").collect()
    for archive in {r.archive for r in pieces}:
        for i, body in enumerate(bodies):
            own = [r for r in pieces if r.archive == archive and r.name == f"http://x/{i}"]
            assert b"".join(bytes(r.payload) for r in own) == body
            assert [r.piece for r in own] == list(range(len(own)))
            assert all(len(r.payload) <= 100_000 for r in own) and own


def test_places_in_one_member_are_one_pass(tmp_path, monkeypatch):
    path = str(tmp_path / "a.gz")
    write_archive(path, [warc_record("response", f"http://x/{i}", b"%d" % i) for i in range(50)],
                  single_member=True)
    reader = WarcReader({"path": path})
    found = [r for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()]
    opened, members = [], warc.Members
    monkeypatch.setattr(warc, "Members", lambda *a: opened.append(a) or members(*a))
    payloads = warc.Payloads()
    for r in found:
        size, pieces = payloads.open(path, r["record_offset"], r["record_position"])
        assert (size, b"".join(pieces)) == (len(r["payload"]), r["payload"])
    assert len(opened) == 1
    # Backwards, and without reading what was opened.
    payloads.open(path, found[9]["record_offset"], found[9]["record_position"])
    assert b"".join(payloads.open(path, found[3]["record_offset"],
                                  found[3]["record_position"])[1]) == b"3"


def test_bad_archives_stop_alone(spark, tmp_path):
    good = warc_record("response", "http://x/1", b"one")
    write_archive(tmp_path / "cut.gz", [good, good], tail=gzip.compress(good)[:-30])
    write_archive(tmp_path / "garbage.gz", [good], tail=b"not gzip")
    write_archive(tmp_path / "crc.gz", [good], tail=gzip.compress(good)[:-8] + b"\1" * 8)
    write_archive(tmp_path / "padded.gz", [good], tail=b"\0" * 600)
    write_archive(tmp_path / "header.gz", [good, b"no header\r\n\r\n"])
    write_archive(tmp_path / "length.gz", [good.replace(b"Content-Length: ", b"Content-Length: -")])
    write_archive(tmp_path / "short.gz", [good[:-20]])
    (tmp_path / "plain.gz").write_bytes(good)
    (tmp_path / "empty.gz").write_bytes(b"")
    assert set(errors(spark, tmp_path)) == {
        "cut.gz", "garbage.gz", "crc.gz", "header.gz", "length.gz", "short.gz", "plain.gz"}
    counts = {}
    for archive, *_ in rows(spark, tmp_path):
        counts[archive] = counts.get(archive, 0) + 1
    assert counts["cut.gz"] == 2
    assert counts["garbage.gz"] == counts["padded.gz"] == counts["header.gz"] == 1
    assert "empty.gz" not in counts and "plain.gz" not in counts


@pytest.mark.parametrize("layout", ["members", "single", "blocks"])
def test_split_reading_covers_every_record_once(tmp_path, layout):
    """Without Spark: the ranges of an archive add up to the whole."""
    rng = random.Random(5)
    records = [warc_record("response", f"http://x/{i}", rng.randbytes(rng.randrange(3000)))
               for i in range(80)]
    path = str(tmp_path / "a.gz")
    if layout == "blocks":  # members that do not line up with records
        data = b"".join(records)
        with open(path, "wb") as f:
            for at in range(0, len(data), 5000):
                f.write(gzip.compress(data[at:at + 5000]))
            f.write(gzip.compress(b""))
    else:
        write_archive(path, records, single_member=layout == "single")

    def read(**options):
        reader = WarcReader({"path": path, **options})
        return [row for part in reader.partitions() for batch in reader.read(part)
                for row in batch.to_pylist()]

    whole = read()
    assert [r["name"] for r in whole] == [f"http://x/{i}" for i in range(80)]
    assert len({(r["record_offset"], r["record_position"]) for r in whole}) == 80
    split = read(split_bytes="7000")
    assert split == whole
    for r in whole[::9]:
        assert read_payload(path, r["record_offset"], r["record_position"]) == r["payload"]
    small = read(max_payload_bytes="1000")
    assert [r["payload_size"] for r in small] == [len(r["payload"]) for r in whole]
    assert all(r["error"] is None and (r["payload"] is None) == (r["payload_size"] > 1000)
               for r in small)


def test_partitions_are_small(tmp_path):
    for i in range(50):
        write_archive(tmp_path / f"{i}.gz", [warc_record("response", "http://x", b"x")])
    parts = WarcReader({"path": str(tmp_path)}).partitions()
    assert len(parts) == 1
    parts = WarcReader({"path": str(tmp_path), "parallelism": "5"}).partitions()
    assert 5 <= len(parts) <= 7
    assert sum(len(p.value) for p in parts) == 50
    assert len(pickle.dumps(parts[0])) < 200 * len(parts[0].value)
