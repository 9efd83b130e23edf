"""JSONL, decklists, shapes, text functions and streams."""

import json

import pytest
from pyspark.sql import functions as F


def test_jsonl_quarantine_and_line_numbers(spark, tmp_path):
    from ledgerline.sources import files as S

    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n[1]\n{"a": 2} x\n{"a": 3}{"b": 4}\nnope\n{"a": 5}\n')
    good, bad = S.read_jsonl(spark, f"file://{tmp_path}/a.jsonl", "quarantine")
    assert sorted(r["line"] for r in good.collect()) == [1, 7]
    assert sorted(r["line"] for r in bad.collect()) == [3, 4, 5, 6]
    with pytest.raises(Exception, match="not a JSON object"):
        S.read_jsonl(spark, f"file://{tmp_path}/a.jsonl")[0].select("record").collect()


def test_jsonl_is_written_with_sorted_keys_and_nulls(spark, tmp_path):
    from ledgerline.sources.files import write_jsonl

    write_jsonl(spark.createDataFrame([(2, None, "x")], "b int, c string, a string"), f"file://{tmp_path}/out")
    assert spark.read.text(f"file://{tmp_path}/out").first()[0] == '{"a":"x","b":2,"c":null}'


def test_decklists(spark):
    from ledgerline.sources.files import read_decklists

    lines = spark.createDataFrame([("f", "4 Fire Bolt # main"), ("f", "Gate"), ("f", "# note"), ("f", "")], "file string, value string")
    assert sorted((r["count"], r["name"]) for r in read_decklists(lines).collect()) == [(1, "Gate"), (4, "Fire Bolt")]


def test_bytes_are_decoded(spark):
    from ledgerline.sources.files import decode_bytes

    rows = [(b"plain \xc3\xa9", "plain é"), (b"\xef\xbb\xbfmark", "mark"), ("wide é".encode("utf-16"), "wide é"), (b"latin \xe9", "latin é")]
    df = spark.createDataFrame([(bytearray(b), t) for b, t in rows], "b binary, want string")
    assert [r["got"] for r in df.select(decode_bytes(F.col("b")).alias("got")).collect()] == [t for _, t in rows]


def test_shapes_are_normalised_and_results_folded(spark):
    from ledgerline.operators import normalize as N
    from ledgerline.sources.files import parsed

    select = {"type": "T", "minCount": 1, "maxCount": 1, "option": [{"index": 0, "type": "A", "label": "a"}]}
    lines = [
        {"sequence": 0, "player": 1, "observation": {"select": select}, "selected": [0]},
        {"sequence": 1, "player": 0, "observation": {"select": select}, "selected": 0},
        {"result": {"winner": 0}},
        {"sequence": 5, "matchId": "m", "seat": 2, "observation": {"select": select}, "select": [0]},
        {"sequenceNumber": 3.0, "playerIndex": True, "select": select, "selectedIndices": [], "source": "search"},
        {"other": 1},
    ]
    df = spark.createDataFrame([("f", i, json.dumps(x)) for i, x in enumerate(lines)], "file string, line long, value string")
    out = {r["line"]: r for r in N.fold_result(N.normalize(df.withColumn("record", parsed(F.col("value"))))).collect()}
    assert [out[k]["shape"] for k in (0, 1, 3, 4, 5)] == ["self_play", "self_play", "arena", "canonical", "unknown"] and 2 not in out
    assert out[1]["terminal"] and out[1]["reward"] == 1.0 and out[1]["selectedIndices"] == [0] and out[0]["terminal"] is None
    assert (out[3]["source"], out[3]["gameId"], out[3]["playerIndex"], out[3]["captureConfidence"]) == ("arena_human", "m", 2, "mirror")
    assert (out[4]["sequenceNumber"], out[4]["playerIndex"], out[4]["source"], out[4]["captureConfidence"]) == (3, None, "search", "partial")


def test_text_functions(spark):
    from ledgerline.functions import text as T

    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(T.canonical_text(F.lit(" a  instance=3 id=9 b 123e4567-e89b-12d3-a456-426614174000 "))) == "a b"
    assert one(T.text_records(F.lit("a<br/>b @P <i>c</i>\n\n d  e"))) == ["a", "b", "c", "d e"]
    assert one(T.parse_timestamp(F.lit("7/4/2026 1:02:03 PM"))) in ("2026-07-04T13:02:03", "7/4/2026 1:02:03 PM")
    assert one(T.parse_timestamp(F.lit("2026-07-04 13:02:03: rest"))) == "2026-07-04T13:02:03"
    assert one(T.mana_value(F.lit("X3UU"))) == 5 and one(T.mana_value(F.lit(""))) is None
    assert one(T.color_letters(F.lit("3,2"))) == "UB"
    assert one(T.clean_title(F.lit("  F|re §Bolt 2R "))) == "FIre Bolt"
    value = 2166136261
    for c in "né日":
        value = (value ^ ord(c)) * 16777619 % 2**32
    assert one(T.pseudonym(F.lit("né日"))) == f"id_{value:08x}"
    vector = one(T.hash_features(F.lit("a b a"), 8))
    assert sum(x * x for x in vector) == pytest.approx(1)
