import json

import pytest
from pyspark.sql import functions as F

from cloakframe.operators import audit
from cloakframe.operators import dictionary as dic
from cloakframe.session import materialize
from cloakframe.sources import audit_log, corpus, dictionary_store
from cloakframe.streaming.audit_stream import ingest_audit, live_totals, read_audit_stream
from cloakframe.streaming.mask_stream import mask_batch, mask_stream, read_stream_dictionary

from .test_policy_risk_audit import _log


def _entries(spark):
    rows = [(1, "rate", "parameter", "f"), (2, "rate", "parameter", "f"), (1, "go", "function", "")]
    return dic.build_dictionary(spark.createDataFrame(rows, "doc_id long, name string, kind string, scope string"))


def test_files_become_rows(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.py").write_text("x = 1\ny = 2\n")
    (tmp_path / "sub" / "b.hpp").write_bytes(b"int a; // \xff\n")
    (tmp_path / "c.txt").write_text("no")
    rows = {r.path.split("/")[-1]: r for r in corpus.read_files(spark, str(tmp_path)).collect()}
    assert {k: r.language for k, r in rows.items()} == {"a.py": "python", "b.hpp": "cpp"}
    assert rows["a.py"].text == "x = 1\ny = 2\n" and "�" in rows["b.hpp"].text


def test_masked_tables_are_never_replaced(spark, texts, tmp_path):
    corpus.write_masked(texts("a"), str(tmp_path / "out"), "docs")
    assert spark.read.parquet(str(tmp_path / "out")).columns == ["source_doc_id", "text", "source"]
    with pytest.raises(Exception, match="already exists"):
        corpus.write_masked(texts("b"), str(tmp_path / "out"), "docs")


def test_dictionary_as_parquet_and_json(spark, tmp_path):
    entries = _entries(spark)
    dictionary_store.write_dictionary(entries, str(tmp_path / "p"))
    back = dictionary_store.read_dictionary(spark, str(tmp_path / "p"))
    assert back.exceptAll(entries).isEmpty() and back.count() == 2
    files = spark.createDataFrame([("gv_001", "b.py"), ("gv_001", "a.py")], "token string, file string")
    dictionary_store.export_json_map(entries, str(tmp_path / "j"), files)
    rows = {r.token: r for r in dictionary_store.read_json_maps(spark, str(tmp_path / "j")).collect()}
    assert rows["gv_001"].files == ["a.py", "b.py"] and rows["gf_001"].files == []
    assert (rows["gv_001"].original, rows["gv_001"].scope, rows["gv_001"].seq) == ("rate", "f", 1)


def test_foreign_json_map_with_missing_fields(spark, tmp_path):
    data = {
        "version": "1.0",
        "symbols": {"gv_007": {"original": "x", "kind": "variable"}},
        "warnings": [{"type": "t", "symbol": "x", "line": 3, "file": "f", "detail": ""}],
        "original_comments": {"[gk_001]": "# c"},
    }
    (tmp_path / "m.json").write_text(json.dumps(data, indent=2))
    row = dictionary_store.read_json_maps(spark, str(tmp_path)).head()
    assert (row.token, row.seq, row.scope, row.files, row.prefix) == ("gv_007", 7, "", [], "gv")
    assert dictionary_store.read_json_warnings(spark, str(tmp_path)).head().line == 3
    assert dictionary_store.read_json_comments(spark, str(tmp_path)).head().original == "# c"
    header = dictionary_store.read_json_headers(spark, str(tmp_path)).head()
    assert (header.version, header.created, header.files) == ("1.0", "", [])


def test_encryption(spark, tmp_path):
    entries = _entries(spark)
    stored = dictionary_store.encrypt_dictionary(entries, "right")
    stored.write.parquet(str(tmp_path / "e"))
    stored = spark.read.parquet(str(tmp_path / "e"))
    assert b"rate" not in b"".join(bytes(r.secret) for r in stored.collect())
    assert dictionary_store.decrypt_dictionary(stored, "right").exceptAll(entries).isEmpty()
    with pytest.raises(ValueError, match="wrong passphrase"):
        dictionary_store.decrypt_dictionary(stored, "wrong")
    with pytest.raises(ValueError, match="too short"):
        dictionary_store.decrypt_dictionary(stored.withColumn("salt", F.lit(bytearray(b"x"))), "right")
    damaged = stored.withColumn("secret", F.when(F.col("token") == "gv_001", F.lit(bytearray(40))).otherwise(F.col("secret")))
    with pytest.raises(Exception, match="decryption failed"):
        dictionary_store.decrypt_dictionary(damaged, "right").collect()


def test_stored_maps(spark, tmp_path):
    for name in ("m1.json", "m2.ghost", "note.txt"):
        (tmp_path / name).write_text("12345")
    rows = [tuple(r) for r in dictionary_store.stored_maps(spark, str(tmp_path)).collect()]
    assert rows == [("m2.ghost", 5, True), ("m1.json", 5, False)]


def test_audit_log_skips_malformed_lines(spark, tmp_path):
    path = str(tmp_path / "log")
    audit_log.append_entries(_log(spark), path)
    audit_log.append_entries(_log(spark), path)
    (tmp_path / "log" / "log_date=2024-01-01" / "x.json").write_text('{"action": "hide"\n\nnot json\n')
    assert audit_log.read_entries(spark, path).count() == 6
    assert {r[0] for r in audit_log.read_malformed(spark, path).collect()} == {'{"action": "hide"', "not json"}
    assert tuple(audit.totals(audit_log.read_entries(spark, path)).head()) == (4, 2, 28)


def test_audit_stream(spark, tmp_path):
    path = str(tmp_path / "log")
    audit_log.append_entries(_log(spark), path)
    (tmp_path / "log" / "log_date=2024-01-01" / "x.json").write_text("not json\n")

    def run():
        entries = read_audit_stream(spark, f"{path}/*")
        for q in ingest_audit(entries, str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "state")):
            q.awaitTermination()

    run()
    run()
    audit_log.append_entries(_log(spark), path)
    run()
    assert spark.read.parquet(str(tmp_path / "good")).count() == 6
    assert [r.value for r in spark.read.text(str(tmp_path / "bad")).collect()] == ["not json"]


def test_late_entries_are_dropped(spark, tmp_path):
    source, out, state = (str(tmp_path / p) for p in ("events", "out", "state"))
    schema = "ts timestamp, action string"
    for stamps in (
        ["2024-01-01 10:00:00", "2024-01-05 10:00:00"],
        ["2024-01-05 11:00:00"],
        ["2024-01-01 11:00:00", "2024-01-05 12:00:00"],
        ["2024-01-09 00:00:00"],
    ):
        spark.createDataFrame([(s, "hide") for s in stamps], "ts string, action string").select(
            F.col("ts").cast("timestamp"), "action"
        ).coalesce(1).write.mode("append").json(source)
        counted = live_totals(spark.readStream.schema(schema).json(source), "ts", "action")
        counted.writeStream.outputMode("append").format("parquet").option("path", out).option(
            "checkpointLocation", state
        ).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema("window_start timestamp, action string, n long").parquet(out).collect()
    assert {(str(r.window_start)[:10], r.n) for r in rows} == {("2024-01-01", 1), ("2024-01-05", 3)}


def test_mask_stream_extends_the_dictionary_once(spark, texts, tmp_path):
    schema = "doc_id long, text string"
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "beta alpha")], schema).coalesce(1).write.mode("append").parquet(source)
    paths = [str(tmp_path / p) for p in ("dict", "out", "state")]

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        mask_stream(stream, *paths).awaitTermination()

    run()
    spark.createDataFrame([(2, "gamma alpha"), (3, "beta")], schema).coalesce(1).write.mode("append").parquet(source)
    run()
    run()
    entries = {(r.token, r.original) for r in read_stream_dictionary(spark, paths[0]).collect()}
    assert entries == {("gv_001", "alpha"), ("gv_002", "beta"), ("gv_003", "gamma")}
    out = {r.doc_id: r.text for r in spark.read.parquet(paths[1]).collect()}
    assert out == {1: "gv_002 gv_001", 2: "gv_003 gv_001", 3: "gv_002"}
    # The same batch again changes nothing.
    mask_batch(spark.createDataFrame([(2, "gamma alpha"), (3, "beta")], schema), 1, paths[0], paths[1])
    assert {(r.token, r.original) for r in read_stream_dictionary(spark, paths[0]).collect()} == entries
    assert {r.doc_id: r.text for r in spark.read.parquet(paths[1]).collect()} == out


def test_json_lines_have_no_limit(spark, tmp_path):
    """More than 100,000 entries, with files and the header, in and out."""
    entries = spark.range(100_500).selectExpr(
        "format_string('gv_%03d', id + 1) token", "'gv' prefix", "id + 1 seq", "concat('name ', id) original",
        "'variable' kind", "'' scope", "id % 7 n_docs",
    )
    files = entries.selectExpr("token", "concat('f', seq % 3, '.py') file")
    path = str(tmp_path / "lines")
    dictionary_store.write_json_lines(entries, path, files)
    back, back_files, header = dictionary_store.read_json_lines(spark, path)
    assert back.columns == entries.columns and header.first()["version"] == "1.0"
    assert back.count() == 100_500 and back.exceptAll(entries).isEmpty()
    assert back_files.count() == 100_500 and back_files.exceptAll(files).isEmpty()


_KEY_SCRIPT = """
import sys
from cloakframe.session import local_session, materialize
from cloakframe.sources import dictionary_store as store

spark = local_session(2)
entries = spark.createDataFrame([("gv_001", "gv", 1, "rate", "variable", "", 2)], "token string, prefix string, seq long, original string, kind string, scope string, n_docs long")
sealed = store.encrypt_dictionary(entries, "open sesame")
stored = materialize(sealed, "encrypted")
key = store._data_key(stored, "open sesame")
opened = store.decrypt_dictionary(stored, "open sesame")
assert opened.exceptAll(entries).isEmpty()
opened.collect()
with open(sys.argv[1], "w") as out:
    out.write("\\n".join(df._jdf.queryExecution().toString() for df in (sealed, opened)))
print("KEYS", key.hex(), store.derive_key("open sesame", bytes(stored.first()["salt"])).hex())
spark.stop()
"""


def test_no_key_in_plans_or_event_log(tmp_path):
    """Neither the text of a plan nor the event log of a run holds a key or the passphrase, in any spelling."""
    import base64
    import os
    import subprocess
    import sys

    (tmp_path / "events").mkdir()
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    log = {"enabled": "true", "dir": f"file://{tmp_path}/events", "compress": "false"}
    submit = " ".join(f"--conf spark.eventLog.{k}={v}" for k, v in log.items()) + " pyspark-shell"
    done = subprocess.run(
        [sys.executable, "-c", _KEY_SCRIPT, str(tmp_path / "plans")],
        env={**os.environ, "PYTHONPATH": home, "PYSPARK_SUBMIT_ARGS": submit}, capture_output=True, text=True, timeout=300, check=True,
    )
    keys = next(line for line in done.stdout.splitlines() if line.startswith("KEYS")).split()[1:]
    logs = [f for f in (tmp_path / "events").rglob("*") if f.is_file() and not f.name.endswith(".crc")]
    texts = [(tmp_path / "plans").read_text(), *(f.read_bytes().decode("utf-8", "replace") for f in logs)]
    assert any("aesEncrypt" in t for t in texts[1:]) and "aesEncrypt" in texts[0]
    for secret in map(bytes.fromhex, keys):
        spelled = " ".join(f"{x:02X}" for x in secret)
        forms = [secret.hex(), secret.hex().upper(), spelled, base64.b64encode(secret).decode(), str(list(secret))[1:-1], "open sesame"]
        assert not any(form in text for form in forms for text in texts)


def test_new_passphrase_keeps_the_entries(spark):
    entries = _entries(spark)
    stored = materialize(dictionary_store.encrypt_dictionary(entries, "old"), "encrypted")
    again = dictionary_store.rewrap(stored, "old", "new")
    assert again.select("secret").exceptAll(stored.select("secret")).isEmpty()
    assert dictionary_store.decrypt_dictionary(again, "new").exceptAll(entries).isEmpty()
    with pytest.raises(ValueError):
        dictionary_store.decrypt_dictionary(again, "old")


def test_newest_entries_leave_old_days_unread(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = spark.range(300).selectExpr(
        "timestamp'2024-01-01' + make_interval(0, 0, 0, cast(id div 10 as int), cast(id % 10 as int)) timestamp", "'hide' action", "concat('u', id) user"
    )
    audit_log.append_entries(rows.coalesce(1), log)
    newest = audit_log.recent_entries(spark, log, 25)
    assert [r.user for r in newest.collect()] == [f"u{i}" for i in range(299, 274, -1)]
    days = {f.split("log_date=")[1][:10] for f in newest.inputFiles()}
    assert days == {"2024-01-28", "2024-01-29", "2024-01-30"}
    assert audit_log.recent_entries(spark, log, 1000).count() == 300
    (tmp_path / "empty").mkdir()
    assert audit_log.recent_entries(spark, str(tmp_path / "empty"), 5).collect() == []


def test_many_batches_read_few_folders(spark, tmp_path):
    """Snapshots bound what a batch reads; replays change nothing; every batch restores to its input."""
    from cloakframe.operators.unmask import unmask
    from cloakframe.streaming import mask_stream as ms

    paths = [str(tmp_path / p) for p in ("dict", "out")]
    texts = {n: f"word{n % 4} fresh{n} gv_{n + 1:03d} and gv_1000000000000 gf_002" for n in range(9)}

    def frame(n):
        return spark.createDataFrame([(n, texts[n])], "doc_id long, text string").coalesce(1)

    for n in range(9):
        mask_batch(frame(n), n, *paths, compact_every=3)
        state = ms.state_behind(spark, paths[0], n)
        assert len(state.entry_folders()) <= 3 and state.snapshot == (n + 1) // 3 * 3 - 1
    entries = {(r.token, r.original, r.batch_id) for r in read_stream_dictionary(spark, paths[0]).collect()}
    assert len({t for t, _, _ in entries}) == len({o for _, o, _ in entries}) == len(entries)
    for n in (2, 4, 8):  # a batch that made a snapshot, one in between, the last one
        mask_batch(frame(n), n, *paths, compact_every=3)
        assert {(r.token, r.original, r.batch_id) for r in ms.state_behind(spark, paths[0], 8).entries(spark).collect()} == entries
    masked = spark.read.parquet(paths[1])
    back = unmask(masked, read_stream_dictionary(spark, paths[0]).select("token", "original"))
    assert {r.doc_id: r.text for r in back.collect()} == texts


def test_later_look_alikes_in_code(spark, tmp_path):
    from cloakframe.operators.unmask import unmask

    paths = [str(tmp_path / p) for p in ("dict", "out")]
    texts = ["def work(first):\n    return first\n", "x = gv_001 + gf_001 + gv_999\n"]
    for n, text in enumerate(texts):
        mask_batch(spark.createDataFrame([(n, text)], "doc_id long, text string"), n, *paths, "python")
    back = unmask(spark.read.parquet(paths[1]), read_stream_dictionary(spark, paths[0]).select("token", "original"))
    assert {r.doc_id: r.text for r in back.collect()} == dict(enumerate(texts))
