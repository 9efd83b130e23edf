"""Logs: files in blocks, growing files that are cut off and started anew, and events by a table function."""

import json
import random
import re
import time

import pytest

HEADER = r"^\[Log\]\d+"


def entries_of(data: bytes, header=HEADER):
    """By the rule, over a whole file: (header, text) of each entry."""
    out = []
    lines = data.decode("utf-8", errors="replace").removesuffix("\n").split("\n") if data else []
    for line in (x.removesuffix("\r") for x in lines):
        if re.match(header, line):
            out.append([line, []])
        elif not out:
            out.append([None, [line]])
        else:
            out[-1][1].append(line)
    return [(h, "\n".join(t)) for h, t in out]


@pytest.mark.parametrize("block", [64, 1000, 1 << 20])
def test_log_in_blocks_equals_the_whole_file(spark, tmp_path, block):
    from ledgerline.sources.files import read_log

    random.seed(block)
    files = {"a": b"", "b": b"[Log]1", "c": b"\n\n[Log]9 x\r\n", "d": b"lost \xff line\n\xe4\xb8[Log]3\n[Log]4\nno end"}
    files["e"] = b"".join(random.choice([b"[Log]%d\n" % i, b"line %d\n" % i, b"\r\n", b" [Log] inside\n", b"x" * 150 + b"\n", "é日".encode() + b"\n"]) for i in range(300))
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = read_log(spark, f"file://{tmp_path}", HEADER).collect()
        blocks = spark.read.option("lineSep", "\n").text(f"file://{tmp_path}/e").rdd.getNumPartitions()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert blocks > 50 or block > 64
    for name, data in files.items():
        own = sorted((r["entry"], r["header"], r["text"]) for r in rows if r["file"].endswith(f"/{name}"))
        assert [o[1:] for o in own] == entries_of(data) and [o[0] for o in own] == list(range(1, len(own) + 1))


def follow(spark, folder, **options):
    """Everything that a run of the stream gives, from where the last run left it."""
    from ledgerline.sources.tail import LogTail

    spark.dataSource.register(LogTail)
    stream = spark.readStream.format("log_tail").options(path=f"{folder}/logs", memory=f"{folder}/memory", header=r"\[Log\]\d+", **options).load()
    out = []
    query = stream.writeStream.option("checkpointLocation", f"file://{folder}/state").trigger(availableNow=True).foreachBatch(lambda df, _: out.extend((r["file"].rpartition("/")[2], r["header"], r["text"]) for r in df.collect())).start()
    query.awaitTermination()
    return sorted(out, key=str)


def test_tail_grows_restarts_and_begins_anew(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    assert follow(spark, tmp_path, idle="1000") == []
    a, b = logs / "a.log", logs / "b.log"
    a.write_bytes(b"early line\n[Log]1 x\none\ntwo\n[Log]2\nhal")
    (logs / "other.txt").write_bytes(b"[Log]1\n[Log]2\n")
    assert follow(spark, tmp_path, idle="1000") == [("a.log", "[Log]1 x", "one\ntwo"), ("a.log", None, "early line")]
    assert follow(spark, tmp_path, idle="1000") == []  # a restart repeats nothing
    with a.open("ab") as f:
        f.write(b"f \xff\r\n[Log]3\n[Log]4\n")
    b.write_bytes(b"[Log]7\nb\n[Log]8\n")
    assert follow(spark, tmp_path, idle="1000") == [("a.log", "[Log]2", "half �"), ("a.log", "[Log]3", ""), ("b.log", "[Log]7", "b")]
    # Started anew, shorter and longer than what was given.
    a.write_bytes(b"[Log]5\nnew\n[Log]6\n")
    b.write_bytes(b"[Log]9\n" + b"long\n" * 100 + b"[Log]10\n")
    assert follow(spark, tmp_path, idle="1000") == [("a.log", "[Log]5", "new"), ("b.log", "[Log]9", "\n".join(["long"] * 100))]
    # Quiet files give their last entry, finished or not; what follows without a header is an entry without one.
    with a.open("ab") as f:
        f.write(b"tail")
    time.sleep(0.1)
    assert follow(spark, tmp_path, idle="0.05") == [("a.log", "[Log]6", "tail"), ("b.log", "[Log]10", "")]
    with b.open("ab") as f:
        f.write(b"more\n[Log]11\n")
    assert follow(spark, tmp_path, idle="1000") == [("b.log", None, "more")]
    b.unlink()
    assert follow(spark, tmp_path, idle="1000") == []


@pytest.mark.parametrize("split", [7, 50, 10_000])
def test_tail_splits_ranges_and_finds_headers_across_blocks(spark, tmp_path, split):
    random.seed(split)
    logs = tmp_path / "logs"
    logs.mkdir()
    data = b"".join(random.choice([b"[Log]%d\n" % i, b"line %d\n" % i, b"\n", b"x" * random.randrange(60) + b"\n"]) for i in range(200)) + b"[Log]1\n" + b"long line\n" * 20_000
    (logs / "a.log").write_bytes(data if split > 7 else data[:4000])
    got = follow(spark, tmp_path, idle="0", split=str(split if split > 50 else split * 10))
    assert got == sorted((("a.log", *e) for e in entries_of(data if split > 7 else data[:4000])), key=str)


def test_table_function_gives_what_the_columns_give(spark):
    from pyspark.sql import functions as F

    from ledgerline.functions.event_tables import log_events
    from ledgerline.operators.log_events import routed

    gre = lambda *m: {"greToClientEvent": {"greToClientMessages": list(m)}}
    client = "ClientToMatchServiceMessageType_ClientToGREMessage"
    texts = [
        None, "", "no value", "[Manifest] x", '{"a": 1} rest', "{broken", "[1, 2]", '["x"]',
        json.dumps({"matchGameRoomStateChangedEvent": {"gameRoomInfo": {"finalMatchResult": {"x": 1}}}}),
        json.dumps({"matchGameRoomStateChangedEvent": "x"}),
        json.dumps({"payload": json.dumps({"PackCards": "1,2", "GrpIds": [1]})}),
        json.dumps({"request": {"Payload": {"GrpIds": [1], "DraftId": "d"}}}),
        json.dumps({"GrpIds": [1]}), json.dumps({"Deck": {}, "EventName": "e"}), json.dumps({"Deck": 1, "EventName": "e"}),
        json.dumps(gre({"type": "GREMessageType_ConnectResp"}, 5, {"type": "GREMessageType_SubmitDeckReq"}, {"x": 1}, {"type": "GREMessageType_PayCostsReq"})),
        json.dumps(gre({"type": "GREMessageType_GameStateMessage", "gameStateMessage": {"gameInfo": {"stage": "GameStage_GameOver"}}}, {"type": "GREMessageType_QueuedGameStateMessage", "queuedGameStateMessage": {"gameStage": "GameOver"}}, {"type": "GREMessageType_GameStateMessage"})),
        json.dumps({"clientToMatchServiceMessageType": client, "payload": json.dumps({"type": "ClientMessageType_SubmitDeckResp"})}),
        json.dumps({"clientToMatchServiceMessageType": client, "payload": {"payload": {"type": "ClientMessageType_SelectNResp", "ids": [1]}}}),
        json.dumps({"clientToMatchServiceMessageType": client, "payload": {"type": "other"}}), json.dumps({"clientToMatchServiceMessageType": "x", "payload": {"type": "other"}}),
        json.dumps({"payload": {"payload": {"payload": {"payload": {"PackCards": "1"}}}}}), json.dumps({"payload": {"payload": {"payload": {"payload": {"payload": {"PackCards": "1"}}}}}}),
    ]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(texts)], "file string, entry long, text string")
    want = routed(df).select("entry", "part", "type", "message_type", F.to_json("body").alias("body"))
    plain = lambda d: sorted((r["entry"], r["part"], r["type"], r["message_type"] or "", json.dumps(json.loads(r["body"]), sort_keys=True)) for r in d.collect())
    got = plain(log_events(df))
    assert got == plain(want) and len(got) > 15


def test_short_logs_share_tasks(tmp_path):
    from ledgerline.sources.tail import FILES, TailReader

    for i in range(2 * FILES + 1):
        (tmp_path / f"{i:04}.log").write_bytes(b"[Log]1\none\n[Log]2\n")
    reader = TailReader({"path": str(tmp_path), "header": r"\[Log\]\d+"})
    tasks = reader.partitions({}, reader.latestOffset())
    assert [len(t.ranges) for t in tasks] == [FILES, FILES, 1]
    assert [row[1:] for t in tasks for row in reader.read(t)] == [(0, "[Log]1", "one")] * (2 * FILES + 1)


def test_logs_are_written_whole_and_in_order(spark, tmp_path):
    from ledgerline.sources.tail import write_logs

    rows = [(k, i, None if i == 3 else f"{k} {i}\nx") for i in (2, 0, 3, 1) for k in ("a", "b", None)]
    write_logs(spark.createDataFrame(rows, "log string, at long, value string"), str(tmp_path), "log", "at", "value", "x.txt")
    found = {str(p.relative_to(tmp_path)): p.read_text() for p in tmp_path.rglob("*") if p.is_file()}
    text = lambda k: "".join(f"{k} {i}\nx\n" for i in range(3)) + "\n"
    assert found == {"log=a/x.txt": text("a"), "log=b/x.txt": text("b"), "log=__HIVE_DEFAULT_PARTITION__/x.txt": text(None)}
