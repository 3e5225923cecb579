"""Files in, files out, and the incremental streams."""

import json

import pytest

from lectern.operators import course
from lectern.sources import readers, writers
from lectern.streaming import incremental
from test_operators import NOTE, NSCHEMA


def test_read_transcript_folder(spark, tmp_path):
    folder = tmp_path / "vid"
    folder.mkdir()
    (folder / "01_P1.txt").write_text("[00:05] a\nplain\n[08:45] b\n", encoding="utf-8")
    (folder / "02_P2.txt").write_text("[00:22] c", encoding="utf-8")
    (folder / "summary.txt").write_text("[00:01] no", encoding="utf-8")
    got = sorted((r["page"], r["ts_sec"], r["text"]) for r in readers.read_transcripts(spark, f"{tmp_path}/*/*.txt").collect())
    assert got == [(1, 5, " a"), (1, 525, " b"), (2, 22, " c")]


def test_read_notes_flags_broken_bytes(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"\xef\xbb\xbfok")
    (tmp_path / "b.md").write_bytes(b"\xff\xfe")
    got = {r["path"].rsplit("/", 1)[1]: (r["text"], r["error"]) for r in readers.read_notes(spark, str(tmp_path)).collect()}
    assert got == {"a.md": ("ok", ""), "b.md": (None, "not UTF-8")}


def test_read_glossary_forms(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"map": {"全线": "权限（x）", "art component": "@Component", "": "x", "bad": {"hits": 1}}}), encoding="utf-8")
    got = {(r["category"], r["wrong"], r["correct"]) for r in readers.read_glossary(spark, f"{tmp_path}/g.json").filter("wrong <> ''").collect()}
    assert got == {("通用", "全线", "权限（x）"), ("编程", "art component", "@Component")}


def test_write_partitions_keeps_untouched_pages(spark, tmp_path):
    path = str(tmp_path / "m")
    writers.write_partitions(spark.createDataFrame([("v", 1, "a"), ("v", 2, "b")], "video_id string, page int, file string"), path)
    writers.write_partitions(spark.createDataFrame([("v", 2, "c")], "video_id string, page int, file string"), path)
    assert sorted(r["file"] for r in spark.read.parquet(path).collect()) == ["a", "c"]


def test_write_chunks_and_lines(spark, tmp_path):
    chunks = spark.createDataFrame([(7, 1, 3, "abc")], "doc_id long, chunk_no int, chars long, text string")
    writers.write_chunks(chunks, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).first()["file"] == "7.chunk-01.txt"
    lines = spark.createDataFrame([("d", 2, "b"), ("d", 1, "a")], "doc string, n int, line string")
    assert writers.report_documents(lines, "doc", ["n"]).first()["text"] == "a\nb"
    writers.write_report_lines(lines, str(tmp_path / "l"), "doc", ["n"])
    assert spark.read.parquet(str(tmp_path / "l")).count() == 2


def test_marks_stream_latest_wins(spark, tmp_path):
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    schema = "event_id long, course_id long, idx int, ts timestamp, state string, note string, gate_errors int, reason string"

    def push(data):
        spark.sql("SELECT * FROM VALUES " + data + " AS v(event_id, course_id, idx, ts, state, note, gate_errors, reason)").selectExpr(
            "CAST(event_id AS LONG) AS event_id", "CAST(course_id AS LONG) AS course_id", "idx", "CAST(ts AS TIMESTAMP) AS ts", "state", "note", "gate_errors", "reason"
        ).coalesce(1).write.mode("append").parquet(src)
        incremental.marks_stream(spark, src, schema, out, ck, availableNow=True).awaitTermination(120)

    push("(1, 1, 1, '2026-01-01 00:00:00', 'done', 'n', 0, ''), (2, 1, 2, '2026-01-01 00:00:00', 'failed', 'n', 0, ' ')")
    push("(3, 1, 1, '2026-01-02 00:00:00', 'failed', 'n', 0, 'why'), (4, 1, 1, '2025-01-01 00:00:00', 'pending', 'n', 0, '')")
    got = {(r["course_id"], r["idx"]): r["state"] for r in incremental.marks_snapshot(spark, out).collect()}
    assert got == {(1, 1): "failed"}


def test_scope_and_names(spark):
    items = spark.createDataFrame([(1, i, f"t{i % 2}") for i in range(1, 5)], "course_id int, idx int, title string")
    scopes = spark.createDataFrame([(1, "first", 9, None, None)], "course_id int, mode string, first int, lo int, hi int")
    assert course.select_scope(items, scopes).count() == 4
    reserved = spark.createDataFrame([(1, "001-T1.md"), (1, "001-t1-001-1.md")], "course_id int, name string")
    got = {r["idx"]: r["name"] for r in course.assign_unique_names(items, reserved).collect()}
    assert got == {1: "001-t1-001-2.md", 2: "002-t0.md", 3: "003-t1.md", 4: "004-t0.md"}


def test_gray_picture_files(spark, tmp_path):
    from lectern.sources import readers

    for name, content in {"7/3.pgm": b"P5 2 2 255\n" + bytes([0, 10, 32, 255]), "7/4.pgm": b"P5\n# a comment\n2\t# b\n 1\n255\n" + b"\x0a\x20",
                          "7/5.pgm": b"P6 1 1 255\n\x00", "7/6.pgm": b"P5 2 2 65535\n" + bytes(8), "8/1.pgm": b"P5 2 2 255\n\x01",
                          "8/x.pgm": b"P5 1 1 255\n\x00", "8/3.txt": b"P5 1 1 255\n\x00"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    got = {(r.video_id, r.t): (r.w, r.h, bytes(r.px)) for r in readers.read_binary_frames(spark, str(tmp_path)).collect()}
    assert got == {(7, 3): (2, 2, bytes([0, 10, 32, 255])), (7, 4): (2, 1, b"\x0a\x20")}
    wrong = {(r.video_id, r.t): r.error for r in readers.gray_errors(readers.gray_files(spark, str(tmp_path))).collect()}
    assert wrong == {(7, 5): "no gray picture header", (7, 6): "not 8 bits per pixel", (8, 1): "pixels missing"}
    odd = spark.createDataFrame([(1, 1, None), (1, 2, b""), (1, 3, b"P5 0 5 255\n")], "video_id long, t int, content binary")
    assert [r.error for r in readers.gray_errors(odd).orderBy("t").collect()] == ["no gray picture header", "no gray picture header", "no pixels"]
    assert readers.decode_gray(odd).count() == 0


def test_readers_keep_the_old_version_until_the_pointer_moves(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    one, two = (spark.createDataFrame([(i, v)], "i int, v string") for i, v in ((1, "old"), (2, "new")))
    with pytest.raises(FileNotFoundError):
        writers.published(spark, root)
    writers.publish(one, root)
    reading = writers.published(spark, root)
    with monkeypatch.context() as m:
        m.setattr(writers, "_point", lambda *a: (_ for _ in ()).throw(RuntimeError("driver lost")))
        with pytest.raises(RuntimeError):
            writers.publish(two, root)
    assert [tuple(r) for r in writers.published(spark, root).collect()] == [(1, "old")]
    writers.publish(two, root)
    assert [tuple(r) for r in writers.published(spark, root).collect()] == [(2, "new")]
    assert [tuple(r) for r in reading.collect()] == [(1, "old")]  # a reader that began before goes on


def test_published_partitions_are_replaced_together(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "p")

    def rows(text, *keys):
        return spark.createDataFrame([(v, p, text) for v, p in keys], "video_id long, page int, text string")

    def seen():
        return sorted((r.video_id, r.page, r.text) for r in writers.published_partitions(spark, root).collect())

    writers.publish_partitions(rows("a", (1, 1), (1, 2), (2, 1)), root)
    with monkeypatch.context() as m:
        m.setattr(writers, "_point", lambda *a: (_ for _ in ()).throw(RuntimeError("driver lost")))
        with pytest.raises(RuntimeError):
            writers.publish_partitions(rows("lost", (1, 1)), root)
    assert seen() == [(1, 1, "a"), (1, 2, "a"), (2, 1, "a")]
    writers.publish_partitions(rows("b", (1, 2), (3, 1)), root)
    assert seen() == [(1, 1, "a"), (1, 2, "b"), (2, 1, "a"), (3, 1, "b")]


def test_gate_stream_equals_batch(spark, tmp_path):
    """A-B-A, another template, a note that stays, restarts, a static side, and snapshots instead of old batches."""
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    base = spark.createDataFrame([(1, 1, "n/1-a.md", None, "lecture", "bilibili", "BV1", "zh", None, NOTE)], NSCHEMA)

    def change(column, value):
        return base.selectExpr(*[f"{value} AS {column}" if c == column else c for c in base.columns])

    broken, other = change("text", "'# broken'"), change("template", "'v4'")
    still = broken.selectExpr(*["2L AS note_id" if c == "note_id" else c for c in broken.columns])
    transcripts = spark.createDataFrame([(1, 1, "[00:01] hello")], "video_id long, page int, text string")
    batch = {name: incremental.note_verdicts(df, transcripts).collect()[0] for name, df in (("base", base), ("broken", broken), ("still", still))}
    assert not batch["broken"].ok and batch["base"].sha != batch["broken"].sha
    for n, (step, name) in enumerate([(base.union(still), "base"), (broken, "broken"), (base.union(still), "base"), (other, "base"), (other, "base")]):
        step.coalesce(1).write.mode("append").parquet(src)
        incremental.gate_stream(spark, src, NSCHEMA, out, ck, transcripts=transcripts, snapshot_every=2, availableNow=True).awaitTermination(180)
        got = {r.note_id: r for r in incremental.latest_verdicts(spark, out).collect()}
        assert all(getattr(got[1], c) == getattr(batch[name], c) for c in ("sha", "errors", "warnings", "ok", "first_errors"))
        assert got[1].template == ("v4" if n > 2 else "") and got[2].sha == batch["still"].sha
    assert spark.read.option("basePath", out).parquet(out).groupBy("note_id").count().orderBy("note_id").collect() == [(1, 4), (2, 1)]
    assert int(writers.current_version(spark, f"{out}-snapshot")) >= 3
