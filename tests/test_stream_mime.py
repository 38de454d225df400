"""Streams equal batch runs (several small files per stream); MIME and .eml parsing."""

import os
from datetime import timedelta

from pyspark.sql import functions as F

from mailsift.operators import criteria as C
from mailsift.operators import maintain as M
from mailsift.operators.ingest import build_postings
from mailsift.schema import CHANGES, MESSAGES
from mailsift.session import new_scratch_path, scratch_dir
from mailsift.sources.adapters import mail_changes, mail_conv
from mailsift.sources.mime import parse_mime, read_eml
from mailsift.streaming.stream import (compact_state, dedup_sessions, read_state, stage_files, stream_changes, stream_dedup,
                                      stream_dedup_sessions, stream_index, stream_state)
from tests.conftest import SF001


def rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_stream_index_equals_batch(spark):
    msgs = mail_conv(spark, SF001).select(*MESSAGES.fieldNames())
    src = stage_files(msgs.repartition(5), new_scratch_path(spark, "msgs"))
    sink = stream_index(spark, src, MESSAGES, new_scratch_path(spark, "sink"), max_files=1)
    cols = ["mailbox_id", "field", "term", "uid"]
    assert rows(spark.read.parquet(sink), cols) == rows(build_postings(msgs), cols)


def test_stream_state_equals_batch_fold_and_restarts(spark):
    ch = mail_changes(spark, SF001).select(*CHANGES.fieldNames())
    src = stage_files(ch.repartition(5), new_scratch_path(spark, "chg"))
    root, ckpt = new_scratch_path(spark, "state"), new_scratch_path(spark, "ckpt")
    stream_state(spark, src, CHANGES, root, ckpt, max_files=1)
    cols = ["mailbox_id", "uid", "flags"]
    want = rows(M.live_flags(M.fold_changes(ch)).select(cols), cols)
    assert rows(M.live_flags(read_state(spark, root)).select(cols), cols) == want
    # compaction keeps the answer; a restart on the same checkpoint finds nothing new
    compact_state(spark, root)
    stream_state(spark, src, CHANGES, root, ckpt, max_files=1)
    assert rows(M.live_flags(read_state(spark, root)).select(cols), cols) == want


def test_streamed_changes_can_be_searched_after_each_micro_batch(spark):
    ch = mail_changes(spark, SF001).select(*CHANGES.fieldNames()) \
        .withColumn("body", F.when(F.col("op") == "add", F.concat(F.lit("note k"), F.col("uid").cast("string"))))
    src, root, ckpt = (new_scratch_path(spark, n) for n in ("log", "log-index", "ckpt"))
    parts = [ch.where(F.col("seq") % 3 == k) for k in (1, 0, 2)]
    for k, part in enumerate(parts):
        part.write.mode("append").parquet(src)
        ix = stream_changes(spark, src, CHANGES, root, ckpt).index()
        seen = ch.where(F.col("seq") % 3 == 1) if k == 0 else ch.where(F.col("seq") % 3 < 2) if k == 1 else ch
        want = rows(M.live_flags(M.fold_changes(seen)), ["mailbox_id", "uid"])
        assert rows(ix.search(None, [C.body_contains("note")]), ["mailbox_id", "uid"]) == want and want


def test_stream_dedup(spark):
    adds = mail_changes(spark, SF001).where(F.col("op") == "add").select(*CHANGES.fieldNames())
    src = stage_files(adds.unionByName(adds).repartition(4), new_scratch_path(spark, "adds"))
    sink = stream_dedup(spark, src, CHANGES, new_scratch_path(spark, "dedup"), max_files=1)
    got = rows(spark.read.parquet(sink), ["mailbox_id", "uid"])
    assert got == sorted(set(rows(adds, ["mailbox_id", "uid"])))


RAW = (b"From: Ann <ann@example.org>\r\nSubject: =?utf-8?q?Caf=C3=A9?= news\r\n"
       b"To: team: bob@example.org, Cid <cid@example.org>;\r\n"
       b"MIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=\"XX\"\r\n\r\n"
       b"--XX\r\nContent-Type: text/plain; charset=iso-8859-1\r\n"
       b"Content-Transfer-Encoding: quoted-printable\r\n\r\nCaf=E9 cr=E8me\r\n"
       b"--XX\r\nContent-Type: text/html; charset=bogus-charset\r\n\r\n<b>bold</b> \xff\r\n"
       b"--XX\r\nContent-Type: image/png\r\nContent-Transfer-Encoding: base64\r\n\r\niVBORw0KGgo=\r\n"
       b"--XX--\r\n")


def test_parse_mime_parts_and_charsets(spark):
    df = spark.createDataFrame([("m", 7, bytearray(RAW))], "mailbox_id string, uid long, raw binary")
    r = parse_mime(df).first()
    assert r.n_text_parts == 2
    assert r.body == "Café crème\n<b>bold</b> �"
    assert [h.name for h in r.headers][:3] == ["From", "Subject", "To"]
    # the parsed message indexes like any other: group members are whole terms
    p = build_postings(parse_mime(df).withColumn("internal_date", F.lit(None).cast("timestamp_ntz")))
    to_terms = {x.term for x in p.where(F.col("field") == "TO").collect()}
    assert {"BOB@EXAMPLE.ORG", "CID <CID@EXAMPLE.ORG>"} <= to_terms
    body_terms = {x.term for x in p.where(F.col("field") == "BODY").collect()}
    assert {"CAFÉ", "CRÈME", "BOLD"} <= body_terms


def test_read_eml_files(spark):
    folder = os.path.join(scratch_dir(spark), "eml-box", "box1")
    os.makedirs(folder, exist_ok=True)
    for uid in (1, 2):
        with open(os.path.join(folder, f"{uid}.eml"), "wb") as fh:
            fh.write(RAW)
    got = parse_mime(read_eml(spark, os.path.dirname(folder))).select("mailbox_id", "uid", "n_text_parts")
    assert rows(got, ["mailbox_id", "uid", "n_text_parts"]) == [("box1", 1, 2), ("box1", 2, 2)]


def test_stream_eml_files_equals_batch(spark):
    from mailsift.streaming.stream import stream_eml_index
    root = os.path.join(scratch_dir(spark), "eml-stream")
    for box, uids in (("boxa", (1, 2, 3)), ("boxb", (7,))):
        os.makedirs(os.path.join(root, box), exist_ok=True)
        for uid in uids:
            with open(os.path.join(root, box, f"{uid}.eml"), "wb") as fh:
                fh.write(RAW.replace(b"Caf=E9", b"Caf=E9 n" + str(uid).encode()))
    sink = stream_eml_index(spark, root, new_scratch_path(spark, "eml-sink"), max_files=2)
    batch = build_postings(parse_mime(read_eml(spark, root))
                           .withColumn("internal_date", F.lit(None).cast("timestamp_ntz")))
    cols = ["mailbox_id", "field", "term", "uid"]
    got = rows(spark.read.parquet(sink), cols)
    assert got == rows(batch, cols) and ("boxb", "BODY", "N7", 7) in got


def test_stream_dedup_within_watermark(spark):
    """Repeats that arrive within the watermark delay are dropped (state purged behind it)."""
    adds = mail_changes(spark, SF001).where(F.col("op") == "add").select(*CHANGES.fieldNames())
    src = stage_files(adds.unionByName(adds).repartition(4), new_scratch_path(spark, "adds-wm"))
    sink = stream_dedup(spark, src, CHANGES, new_scratch_path(spark, "dedup-wm"),
                        max_files=4, event_time="ts", delay="3650 days")
    got = rows(spark.read.parquet(sink), ["mailbox_id", "uid"])
    assert got == sorted(set(rows(adds, ["mailbox_id", "uid"])))


def test_sessions_forget_quiet_keys(spark):
    log = mail_changes(spark, SF001).where("op = 'add'").select(*CHANGES.fieldNames())
    # few keys and a log in order of time, a file for each stretch; neighbours swap places inside a file
    log = log.withColumn("uid", F.col("uid") % 3).repartitionByRange(6, "ts").sortWithinPartitions(F.col("ts").desc())
    src = stage_files(log, new_scratch_path(spark, "in-sessions"))
    adds = spark.read.schema(CHANGES).parquet(src)
    want, last = {}, {}
    for r in sorted(adds.collect(), key=lambda r: (r.ts, r.seq)):
        key = r.mailbox_id, r.uid
        if key not in last or r.ts > last[key][0] + timedelta(hours=48):
            last[key] = r.ts, r.seq
            want[r.seq] = 0
        else:
            last[key] = r.ts, last[key][1]
        want[last[key][1]] += 1
    table = dedup_sessions(adds, "ts", "48 hours", "1 hour")
    assert {r.seq: r.n_adds for r in table.collect()} == want

    sink = stream_dedup_sessions(spark, src, CHANGES, new_scratch_path(spark, "out-closed"), "ts", "48 hours", "1 hour")
    closed = {r.seq: r.n_adds for r in spark.read.parquet(sink).collect()}
    newest = max(t for t, _ in last.values())
    open_now = {seq for t, seq in last.values() if t + timedelta(hours=48) > newest - timedelta(hours=1)}
    assert closed == {s: n for s, n in want.items() if s not in open_now}
    assert 0 < len(closed) < len(want)

    # one file after the other, in order of time: closed keys leave the state
    ordered, sink = new_scratch_path(spark, "in-ordered"), new_scratch_path(spark, "out-ordered")
    cuts = adds.selectExpr("inline(transform(approx_percentile(ts, array(0.25, 0.5, 0.75)), t -> struct(t)))").collect()
    edges = [None, *(c[0] for c in cuts), None]
    for lo, hi in zip(edges, edges[1:]):
        part = adds.where((F.lit(True) if lo is None else F.col("ts") > F.lit(lo)) & (F.lit(True) if hi is None else F.col("ts") <= F.lit(hi)))
        part.coalesce(1).write.mode("append").parquet(ordered)
    stream = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(ordered)
    q = (dedup_sessions(stream, "ts", "48 hours", "1 hour").writeStream.format("parquet").outputMode("append").option("path", sink)
         .option("checkpointLocation", new_scratch_path(spark, "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    states = [s for p in q.recentProgress for s in p["stateOperators"]]
    assert len(q.recentProgress) >= 4 and sum(s["numRowsDroppedByWatermark"] for s in states) == 0
    assert {r.seq: r.n_adds for r in spark.read.parquet(sink).collect()} == closed
    assert states[-1]["numRowsTotal"] == len(open_now)
