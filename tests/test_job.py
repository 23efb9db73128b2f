import glob
import gzip
import json
import os
import re
import tempfile
import zipfile
from datetime import datetime
from types import SimpleNamespace

import pytest

from inputs import warc_record, write_archive
from gleanery.plans import job
from gleanery.plans.job import read_records, search_archives


def response(uri, body, **kw):
    return warc_record("response", uri, body, **kw)


@pytest.fixture
def dirs(tmp_path):
    for name in ("in", "defs", "out"):
        (tmp_path / name).mkdir()
    return tmp_path


def define(dirs, **patterns):
    for name, pattern in patterns.items():
        (dirs / "defs" / f"{name}.txt").write_text(pattern)


def run(spark, dirs, **kw):
    out = tempfile.mkdtemp(dir=dirs / "out")
    return search_archives(spark, str(dirs / "in"), str(dirs / "defs"), out, **kw)


def exported(result, definition):
    """Entries of all zips of a definition, none of which may repeat."""
    found = {}
    for path in glob.glob(f"{result.run_dir}/exports/export={definition}_results.zip/*.zip"):
        with zipfile.ZipFile(path) as z:
            assert not set(found) & set(z.namelist())
            found |= {n: z.read(n) for n in z.namelist()}
    return found


def problems(result):
    return [json.loads(line) for p in glob.glob(f"{result.run_dir}/problems/*.json")
            for line in open(p)]


def report_text(result, definition):
    parts = sorted(glob.glob(f"{result.run_dir}/reports/report={definition}_results.txt/**/part-*",
                             recursive=True),
                   key=lambda p: (os.path.dirname(p), p))
    return "".join(open(p, encoding="utf-8", newline="").read() for p in parts)


def test_end_to_end(spark, dirs):
    define(dirs, foo="foo[a-z]*", digits=r"\d+", nothing="zzz", bad="[unclosed")
    (dirs / "defs" / "skip.md").write_text("foo")
    write_archive(dirs / "in" / "a.warc.gz", [
        warc_record("warcinfo", None, b"foo", "application/warc-fields"),
        warc_record("request", "http://x/foo", b"foo"),
        response("http://www.x.com/a?b", b"Foo foobar Foo 12"),
        response("http://x/foo", b"\x00foo"),
        response(None, b"foo 7")])
    write_archive(dirs / "in" / "b.warc.gz", [
        response("http://www.x.com/a?b", b"foo other"),
        warc_record("metadata", "http://x/m", b"foo")])
    write_archive(dirs / "in" / "none.warc.gz", [warc_record("warcinfo", None, b"foo")])
    write_archive(dirs / "in" / "cut.warc.gz", [response("http://x/foo1", b"none"),
                                                response("http://x/foo2", b"none")],
                  tail=gzip.compress(response("http://x/foo3", b"x" * 999))[:40])
    (dirs / "in" / "empty.gz").write_bytes(b"")
    result = run(spark, dirs, extract=True)

    rows = {(os.path.basename(r.archive), r.name, r.definition):
            (r.name_matches, r.content_matches) for r in result.matches.collect()}
    assert rows == {
        ("a.warc.gz", "http://www.x.com/a?b", "foo"): ([], ["Foo", "foobar", "Foo"]),
        ("a.warc.gz", "http://www.x.com/a?b", "digits"): ([], ["12"]),
        ("a.warc.gz", "http://x/foo", "foo"): (["foo"], []),
        ("a.warc.gz", None, "foo"): ([], ["foo"]),
        ("a.warc.gz", None, "digits"): ([], ["7"]),
        ("b.warc.gz", "http://www.x.com/a?b", "foo"): ([], ["foo"]),
        ("cut.warc.gz", "http://x/foo1", "foo"): (["foo"], []),
        ("cut.warc.gz", "http://x/foo1", "digits"): (["1"], []),
        ("cut.warc.gz", "http://x/foo2", "foo"): (["foo"], []),
        ("cut.warc.gz", "http://x/foo2", "digits"): (["2"], []),
    }
    total = result.summary.first()
    # a cut archive, a bad definition, and a nameless record for two definitions
    assert (total.archives, total.records_read, total.errors, total.warnings) == (5, 6, 4, 2)
    assert total.elapsed.endswith(" seconds")

    text = report_text(result, "foo")
    head, block = text.split("_" * 67 + "\n\n")[:2]
    assert head.startswith("[foo_results.txt]\n[Created: ")
    assert head.endswith("]\n\n[Regex used]\nfoo[a-z]*\n\n")
    assert block == (
        f"[Archive: {dirs}/in/a.warc.gz]\n[File: http://www.x.com/a?b]\n\n"
        "[Matches found in file contents: 3 (1 duplicates omitted)]\n"
        '[Match #1 in file contents]\n\n"Foo"\n\n[Match #2 in file contents]\n\n"foobar"\n\n')
    assert text.count("[File: ") == 6 and text.endswith("_\n\n")
    assert report_text(result, "nothing").endswith("zzz\n\n" + "_" * 67 + "\n\n")

    assert exported(result, "foo") == {
        "x.comab": b"Foo foobar Foo 12", "xfoo": b"\x00foo", "xfoo1": b"none", "xfoo2": b"none"}
    assert not glob.glob(f"{result.run_dir}/_staging*")
    assert {os.path.basename(r["subject"]) for r in problems(result) if r["severity"] == "warning"} == {
        "none.warc.gz", "empty.gz"}


def test_splits_equal_whole(spark, dirs, monkeypatch):
    define(dirs, word="w[0-9]+", any=r"\w{3,}")
    inner = b"".join(gzip.compress(response(f"http://inner/{i}", os.urandom(3000)))
                     for i in range(60))
    records = []
    for i in range(60):
        records.append(response(f"http://x/w{i}", b"w%d " % i + os.urandom(200).hex().encode()))
        if i == 30:
            records.append(response("http://x/nested", inner, content_type="application/http"))
        if i % 7 == 0:
            records.append(warc_record("request", f"http://x/w{i}", b"w"))
    # level 0 stores the nested archive as it is, which fools a split inside it
    write_archive(dirs / "in" / "many.warc.gz", records, level=0)
    write_archive(dirs / "in" / "one.warc.gz", records, single_member=True)
    write_archive(dirs / "in" / "cut.warc.gz", records[:40], tail=b"garbage" * 50)
    whole = run(spark, dirs, split_bytes=0, search_binary=True)
    expected = sorted(map(str, whole.matches.collect()))
    readings = []
    stage = job._stage
    monkeypatch.setattr(job, "_stage", lambda *a, **k: (readings.append(1), stage(*a, **k)))
    split = run(spark, dirs, split_bytes=2000, search_binary=True)
    assert 1 < len(readings) <= 3, "every misled split is put right in the next reading or two"
    misled = sum(gzip.decompress(p.read_bytes()).count(b"http://inner/") > 50
                 for p in (dirs / "in").glob("many*"))
    assert misled == 1 and (dirs / "in" / "many.warc.gz").stat().st_size > 90 * 2000
    assert expected and sorted(map(str, split.matches.collect())) == expected
    assert split.summary.first().records_read == whole.summary.first().records_read
    assert split.summary.first().errors == whole.summary.first().errors == 1

    def records_of(**options):
        rows = read_records(spark, str(dirs / "in"), **options).where("error is null")
        return sorted((r.archive, r.record_offset, r.record_position, r.name, bytes(r.payload))
                      for r in rows.collect())

    assert records_of(split_bytes=2000) == records_of()


def test_sharded_zip_and_table_export(spark, dirs):
    define(dirs, w="w[0-9]+")
    write_archive(dirs / "in" / "a.gz", [response(f"http://x/w{i}", b"w" * 100)
                                         for i in range(30)])
    result = run(spark, dirs, extract=True, zip_bytes=500)
    assert len(glob.glob(f"{result.run_dir}/exports/export=w_results.zip/part-*.zip")) > 3
    assert exported(result, "w") == {f"xw{i}": b"w" * 100 for i in range(30)}
    result = run(spark, dirs, extract=True, extract_format="table")
    table = spark.read.parquet(f"{result.run_dir}/exports")
    assert table.where("definition = 'w'").count() == 30


@pytest.mark.parametrize("extract_format", ["zip", "table"])
def test_nothing_matches(spark, dirs, extract_format):
    define(dirs, none="zzz")
    write_archive(dirs / "in" / "a.gz", [response("http://x", b"x")])
    result = run(spark, dirs, extract=True, extract_format=extract_format)
    assert result.matches.count() == 0
    assert report_text(result, "none").startswith("[none_results.txt]\n")
    total = result.summary.first()
    assert (total.records_read, total.errors, total.warnings) == (1, 0, 0)


@pytest.mark.parametrize("extract_format", ["zip", "table"])
def test_payload_size_changes_nothing(spark, dirs, extract_format):
    """Payloads too large for a row give the same matches, exports and totals."""
    define(dirs, w=r"w\w+", tail="the end")
    records = [response("http://x/w1", b"x" * 5000 + "é w2 the end".encode() + b"\xff"),
               response("http://x/w1", b"w3 the end"),
               response("http://x/w4", b"\0" + b"w5" * 2000),
               response(None, b"w6" * 2000), response("http://x/none", b"y" * 5000)]
    write_archive(dirs / "in" / "a.gz", records)
    write_archive(dirs / "in" / "b.gz", records[::-1], single_member=True)

    def found(result):
        return sorted(map(str, result.matches.collect()))

    def export(result):
        if extract_format == "zip":
            return exported(result, "w"), exported(result, "tail")
        rows = spark.read.parquet(f"{result.run_dir}/exports").collect()
        return sorted((r.definition, r.entry_name, r.piece, bytes(r.payload)) for r in rows)

    for binary in (False, True):
        how = dict(extract=True, extract_format=extract_format, search_binary=binary)
        plain, small = run(spark, dirs, **how), run(spark, dirs, max_payload_bytes=1000, **how)
        assert found(plain) and found(small) == found(plain)
        assert export(small) == export(plain) and export(plain)
        # Only the nameless record cannot be exported.
        assert small.summary.drop("elapsed", "elapsed_seconds").first() == \
            plain.summary.drop("elapsed", "elapsed_seconds").first()
        assert plain.summary.first().errors == 2


def test_payloads_are_in_no_exchange(spark, dirs, monkeypatch):
    define(dirs, w="w[0-9]+")
    write_archive(dirs / "in" / "a.gz", [response(f"http://x/w{i}", b"w1") for i in range(9)])
    plans, dealt = [], job._dealt
    monkeypatch.setattr(job, "_dealt", lambda *a: plans.append(dealt(*a)) or plans[-1])
    stage = job._stage

    def staged(records, definitions, path, **how):
        stage(records, definitions, path, **how)
        assert "payload" not in spark.read.parquet(path).columns

    monkeypatch.setattr(job, "_stage", staged)
    run(spark, dirs, extract=True)
    text = plans[0]._jdf.queryExecution().executedPlan().toString()
    assert len(plans) == 1 and "payload#" not in text and "record_position" in text


def test_entries_that_cannot_be_written_are_named(spark, dirs):
    define(dirs, w="w[0-9]+")
    write_archive(dirs / "in" / "a.gz", [
        response("http://x/w1", b"1"), response("http://x/w2" + "y" * 70_000, b"2"),
        response("http://x/w3", b"3")])
    result = run(spark, dirs, extract=True)
    assert exported(result, "w") == {"xw1": b"1", "xw3": b"3"}
    failed = [p for p in problems(result) if p["severity"] == "error"]
    assert len(failed) == result.summary.first().errors == 1
    assert failed[0]["subject"] == "export=w_results.zip/part-00000.zip"
    assert "xw2" in failed[0]["message"]
    left = glob.glob(f"{result.run_dir}/exports/export=*/*")
    assert [os.path.basename(p) for p in left] == ["part-00000.zip"]


def test_failed_attempts_leave_no_file(spark, tmp_path):
    register = job.register
    register(spark)
    rows = spark.createDataFrame([("e/part.zip", "n", str(tmp_path / "missing.gz"), 0, 0)], (
        "file string, entry_name string, archive string, record_offset bigint,"
        " record_position bigint"))
    with pytest.raises(Exception, match="missing.gz"):
        rows.write.format("zip").mode("append").save(str(tmp_path / "out"))
    assert [p for p in (tmp_path / "out").rglob("*") if p.is_file()] == []


def test_http_block_without_an_end_is_kept_and_reported(spark, dirs):
    define(dirs, p="<p>|HTTP")
    body = b"<p>one</p>\n\n<p>two</p>"
    write_archive(dirs / "in" / "a.gz", [
        response("http://x/1", body, http=None, content_type="application/http"),
        response("http://x/2", b"<p>", http=b"HTTP/1.1 200 OK\r\nA: b\r\n")])
    result = run(spark, dirs, extract=True)
    assert {r.name: len(r.content_matches) for r in result.matches.collect()} == {
        "http://x/1": 2, "http://x/2": 2}
    assert exported(result, "p")["x1"] == body
    warnings = [p["message"] for p in problems(result) if p["severity"] == "warning"]
    assert len(warnings) == result.summary.first().warnings == 1
    assert warnings[0].startswith("HTTP header block without an end at ")


def test_local_folders_are_refused_on_a_cluster(tmp_path):
    def session(master):
        return SimpleNamespace(sparkContext=SimpleNamespace(master=master))

    for master in ("local-cluster[2,1,1024]", "spark://h:7077", "yarn"):
        with pytest.raises(ValueError, match="shared_files"):
            job.require_shared(session(master), str(tmp_path))
        job.require_shared(session(master), "hdfs://a/b")
    job.require_shared(session("local[4]"), str(tmp_path))
    job.require_shared(session("local"), str(tmp_path))


def test_report_order(spark, dirs):
    """Archives by name, records as stored, over several parts."""
    define(dirs, w="w[0-9]+", x="x")
    for archive in "cab":
        write_archive(dirs / "in" / f"{archive}.gz", [
            response(f"http://{archive}/{i}", b"w3 w1 w2 w1") for i in range(200)])
    result = run(spark, dirs)
    parts = glob.glob(f"{result.run_dir}/reports/report=w_results.txt/part-*")
    assert len(parts) > 1
    text = report_text(result, "w")
    assert re.findall(r"\[File: http://(.*)\]", text) == [
        f"{archive}/{i}" for archive in "abc" for i in range(200)]
    assert text.count('"w3"\n\n[Match #2 in file contents]\n\n"w1"') == 600
    assert text.count("[Matches found in file contents: 4 (1 duplicates omitted)]") == 600
    assert re.fullmatch(r"results_\d\d-\d\d-\d\d_\d\d_\d\d_\d\d",
                        os.path.basename(result.run_dir))


def test_run_directories_are_fresh(tmp_path):
    now = datetime(2024, 3, 1, 12, 5, 9)
    made = job.new_run_dir(f"{tmp_path}/", now)
    assert made == f"{tmp_path}/results_03-01-24_12_05_09" and os.path.isdir(made)
    with pytest.raises(FileExistsError):
        job.new_run_dir(str(tmp_path), now)
    with pytest.raises(FileNotFoundError):
        job.new_run_dir(f"{tmp_path}/missing", now)


def test_redistribute_and_shared_staging(spark, dirs):
    define(dirs, w="w[0-9]+")
    write_archive(dirs / "in" / "a.gz", [response(f"http://x/w{i}", b"w1") for i in range(20)],
                  single_member=True)
    result = run(spark, dirs, redistribute=3)
    assert result.matches.count() == 20
    shared = spark.conf.get("spark.checkpoint.dir")
    assert job._staging_dir(spark, result.run_dir).startswith(f"{shared}/_staging_")
    assert not glob.glob(f"{shared}/_staging_*")


def test_places_of_definitions():
    places, n = job._place([("a", 10), ("b", 1000), ("c", 20), ("d", 0), ("e", 95)], 100, 4)
    assert places == {"a": (1, 0), "b": (10, 1), "c": (1, 11), "d": (1, 11), "e": (1, 12)}
    assert n == 13
    places, n = job._place([(str(i), 10) for i in range(8)], 1000, 4)
    assert n == 4 and {first for _, first in places.values()} == {0, 1, 2, 3}
    assert job._place([], 100, 4) == ({}, 0)


def test_fails_before_scanning(spark, dirs):
    define(dirs, bad="(")
    write_archive(dirs / "in" / "a.gz", [response("http://x", b"x")])
    with pytest.raises(ValueError, match="no valid definitions.*bad"):
        run(spark, dirs)
    define(dirs, good="x")
    with pytest.raises(FileNotFoundError):
        search_archives(spark, str(dirs / "in"), str(dirs / "defs"), str(dirs / "missing"))
    with pytest.raises(ValueError, match="no .gz archives"):
        search_archives(spark, str(dirs / "out"), str(dirs / "defs"), str(dirs / "out"))
    with pytest.raises(FileNotFoundError):
        search_archives(spark, str(dirs / "nowhere"), str(dirs / "defs"), str(dirs / "out"))
    assert not [p for d in (dirs / "out").iterdir() for p in d.iterdir()]


def test_type_filter_reaches_the_source(spark, dirs):
    write_archive(dirs / "in" / "a.gz", [response("http://x", b"x"),
                                         warc_record("request", "http://x", b"y")], tail=b"??")
    everything = read_records(spark, str(dirs / "in"), record_types="all")
    assert everything.count() == 3
    requests = everything.where("warc_type = 'request'")
    assert [bytes(r.payload) for r in requests.collect()] == [b"y"]
    assert "= request" not in requests._jdf.queryExecution().executedPlan().toString()
    names = read_records(spark, str(dirs / "in"), payload="false")
    assert [(r.name, r.payload) for r in names.where("error is null").collect()] == [
        ("http://x", None)]
    raw = read_records(spark, str(dirs / "in"), http_headers="true").where("error is null")
    assert bytes(raw.first().payload).startswith(b"HTTP/1.1 200 OK\r\n")


def _merged(result):
    """Matches by record and definition, of all chunks in order."""
    found = {}
    for r in sorted(result.matches.collect(), key=lambda r: r.chunk):
        held = found.setdefault((os.path.basename(r.archive), r.record_offset, r.name, r.definition),
                                ([], []))
        held[0].extend(r.name_matches)
        held[1].extend(r.content_matches)
    return found


def test_chunks_and_windows_change_nothing(spark, dirs):
    """Few matches to a chunk, payloads in rows or in windows: one result."""
    define(dirs, any="", word="[a-z]+", line="(?m)^.*$", twice=r"(\w)\1", none="zzz")
    write_archive(dirs / "in" / "a.warc.gz", [
        response("http://x/1", b"Foo foobar Foo 12\nbook \xc3\xa9\xff book\n" * 30),
        response("http://x/2", b"\x00 binary aa"), response("http://x/3", b""),
        response(None, b"nameless aa bb aa")])
    write_archive(dirs / "in" / "b.warc.gz", [response("http://x/1", b"aa other " * 40)],
                  single_member=True)
    plain = run(spark, dirs, extract=True)
    assert {r.chunk for r in plain.matches.collect()} == {0}
    for how in (dict(chunk_matches=2), dict(max_payload_bytes=20, window=7),
                dict(chunk_matches=3, max_payload_bytes=20, window=50)):
        other = run(spark, dirs, extract=True, **how)
        assert _merged(other) == _merged(plain)
        for definition in ("any", "word", "line", "twice", "none"):
            texts = [re.sub(r"\[Created: .*\]", "", report_text(r, definition))
                     for r in (plain, other)]
            assert texts[0] == texts[1]
            assert exported(plain, definition) == exported(other, definition)
        assert other.summary.select("records_read", "errors", "warnings").collect() == \
            plain.summary.select("records_read", "errors", "warnings").collect()


def test_dialects_of_the_job(spark, dirs):
    define(dirs, mail="[a-z]+@[a-z]+", word=r"\w+")
    write_archive(dirs / "in" / "a.warc.gz", [response("http://x/1", "ab@cd é1".encode()),
                                              response("http://x/2", b"long@text " * 50)])
    python, auto = run(spark, dirs, dialect="python"), run(spark, dirs)
    assert _merged(python) == _merged(auto)
    native = run(spark, dirs, dialect="native")
    assert _merged(native) == _merged(auto)
    refused = run(spark, dirs, dialect="native", max_payload_bytes=100, extract=True)
    assert {name for _, _, name, _ in _merged(refused)} == {"http://x/1"}
    errors = [p["message"] for p in problems(refused) if p["severity"] == "error"]
    assert len(errors) == 1 and "native dialect" in errors[0]
    with pytest.raises(ValueError, match="dialect"):
        run(spark, dirs, dialect="java")


def test_appending_equals_one_run(spark, dirs):
    """Two runs over a growing directory give what one over all gives."""
    define(dirs, word="[a-z]+", digits="[0-9]+", none="zzz", bad="[")
    archives = {
        "a.warc.gz": [response("http://x/1", b"Foo 12 foo"), response(None, b"nameless")],
        "b.warc.gz": [response("http://x/2", b"bar 7")],
        "c.warc.gz": [response("http://x/1", b"other Foo"), response("http://x/3", b"new 3")],
        "d.warc.gz": [warc_record("warcinfo", None, b"foo")]}

    def write(*names):
        for name in names:
            write_archive(dirs / "in" / name, archives[name])

    def state(result):
        texts = [re.sub(r"\[Created: .*\]", "", report_text(result, d))
                 for d in ("word", "digits", "none")]
        told = sorted((p["severity"], os.path.basename(p["subject"])) for path in glob.glob(
            f"{result.run_dir}/problems/**/*.json", recursive=True)
            for p in map(json.loads, open(path)))
        return (_merged(result), texts, [exported(result, d) for d in ("word", "digits")], told,
                result.summary.select("archives", "records_read", "errors", "warnings").collect())

    write("a.warc.gz", "b.warc.gz")
    first = run(spark, dirs, extract=True)
    before = state(first)
    write("c.warc.gz")
    second = run(spark, dirs, extract=True, append_to=first.run_dir)
    assert second.run_dir == first.run_dir and state(second) != before
    # What a run that did not finish has left counts for nothing.
    os.makedirs(f"{first.run_dir}/reports/report=word_results.txt/run=00003")
    open(f"{first.run_dir}/reports/report=word_results.txt/run=00003/part-0", "w").write("half")
    write("d.warc.gz")
    third = run(spark, dirs, extract=True, append_to=first.run_dir)
    nothing = run(spark, dirs, extract=True, append_to=first.run_dir)
    whole = run(spark, dirs, extract=True)
    assert state(third) == state(nothing) == state(whole)


def test_appending_refuses_what_is_not_the_same(spark, dirs):
    define(dirs, word="[a-z]+")
    write_archive(dirs / "in" / "a.warc.gz", [response("http://x/1", b"foo")])
    first = run(spark, dirs)
    write_archive(dirs / "in" / "a.warc.gz", [response("http://x/1", b"something else")])
    again = run(spark, dirs, append_to=first.run_dir)
    assert again.summary.first().errors == 1 and again.matches.count() == 1
    define(dirs, more="x")
    with pytest.raises(ValueError, match="definitions"):
        run(spark, dirs, append_to=first.run_dir)
    with pytest.raises(ValueError, match="no finished run"):
        run(spark, dirs, append_to=str(dirs / "out"))


def test_zips_are_unzipped_where_they_lie(spark, tmp_path, monkeypatch):
    """Only paths come in, and batches of bounded size go out."""
    import archive_fixture
    import pyarrow as pa
    monkeypatch.setattr(archive_fixture, "UNZIP_ROWS", 4)
    folder = tmp_path / "export=calls_results.zip"
    folder.mkdir()
    entries = {f"e{i}": bytes([i]) * i for i in range(10)}
    with zipfile.ZipFile(folder / "part-00000.zip", "w") as z:
        for name, data in entries.items():
            z.writestr(name, data)
    with zipfile.ZipFile(folder / "part-00001.zip", "w"):
        pass
    paths = pa.RecordBatch.from_pydict({"path": [f"file:{folder}/part-0000{i}.zip" for i in (0, 1)]})
    batches = list(archive_fixture.unzip([paths]))
    assert max(b.num_rows for b in batches) == 4
    rows = [tuple(r.values()) for b in batches for r in b.to_pylist()]
    assert rows == [("calls", name, data) for name, data in entries.items()]
