"""Token operators against the libraries that they must equal."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

P = pytest.importorskip("public_tokenizers")
PIECES, BYTES = P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string"
PARTS = [" ", "  ", "a", "B", "▁", "\n", "\t", "é", "日", "😀", "<0x41>", "</s>", "<unk>", "<s>", "<|endoftext|>", "23", "'s", ".", "\x00", "\xa0", "\x1c", "\x85", " the", " world", "\r\n"]


def texts(n=400):
    random.seed(5)
    return ["".join(random.choices(PARTS, k=random.randint(0, 25))) for _ in range(n)] + ["", " ", "▁", "a ", " a", "x" * 5000, "word " * 3000]


def rows(spark):
    own = [(i, t) for i, t in enumerate(texts())] + [(None, "no id"), (7, "again"), (9999, None), (9999, None)]
    return own, spark.createDataFrame(own, SCHEMA)


@pytest.fixture(scope="module")
def sp():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def hf():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTES)


def as_key(r):
    return sorted(map(str, r))


def test_counts_equal_the_library(spark, sp):
    from ledgerline.llm.token_counts import token_counts, whole_tokens

    own, df = rows(spark)
    got = token_counts(df.selectExpr("*", "1 as n_tokens", "'x' as n_bytes"), PIECES, limit=20).collect()
    want = [(i, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 20) for i, t in own]
    assert as_key(map(tuple, got)) == as_key(want)
    assert len(whole_tokens(PIECES)) > 10_000
    assert token_counts(df.limit(0), PIECES).count() == 0


def test_a_small_memo_changes_nothing(sp):
    from ledgerline.llm.token_counts import Counts, whole_tokens

    counts = Counts(PIECES, whole_tokens(PIECES), memo=3)
    assert all(counts.of(t) == len(sp.encode(t)) for t in texts())


def test_pieces_equal_the_library_and_cover_the_bytes(spark, sp):
    from ledgerline.llm.pieces import decode_pieces, encode_pieces, piece_digests

    own, df = rows(spark)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in own:
        ids = sp.encode(t or "") + [2]
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids)), len((t or "").encode())))
    got = piece_digests(df, PIECES).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes").collect()
    assert as_key(map(tuple, got)) == as_key(want)
    encoded = encode_pieces(df.where("doc_id < 300"), PIECES)
    back = {r["doc_id"]: r["text"] for r in decode_pieces(encoded, PIECES).collect()}
    for r in encoded.collect():
        text = dict(own[:300])[r["doc_id"]]
        if r["doc_id"] != 7:
            assert r["ids"] == sp.encode(text) + [2]
            assert back[r["doc_id"]] == sp.decode(r["ids"])
            assert not r["ends"] or (r["ends"][-1] == len(text.encode()) and r["ends"] == sorted(r["ends"]))


def test_any_ids_decode_as_the_library_does(sp):
    from ledgerline.llm.pieces import Codec

    random.seed(1)
    codec = Codec(PIECES)
    pool = [0, 1, 2, *range(3, 259), *map(sp.piece_to_id, ("▁the", "▁", "a", "▁▁", "é")), *range(300, 320)]
    for _ in range(5000):
        ids = random.choices(pool, k=random.randint(0, 6))
        assert codec.decode(ids) == sp.decode(ids)


def test_compiled_maps_are_unpacked_and_matched_longest_first():
    import sentencepiece

    from ledgerline.llm.pieces import Normaliser, model_spec  # noqa: F401
    from sentencepiece import sentencepiece_model_pb2 as proto

    maker = getattr(sentencepiece, "SentencePieceNormalizer", None)
    if maker is None:
        pytest.skip("this sentencepiece has no normaliser")
    theirs = maker(rule_name="nmt_nfkc", add_dummy_prefix=False, escape_whitespaces=False, remove_extra_whitespaces=False)
    spec = proto.ModelProto()
    spec.ParseFromString(theirs.serialized_model_proto())
    ours = Normaliser(spec.normalizer_spec.precompiled_charsmap)
    assert len(ours.rules) > 1000
    for text in ["ﬁne ½ Ａ　Ｂ", "été", "①②", "plain", "가각", "a\tb", "Ω ㎏"]:
        norm, origin = ours(text)
        assert norm == theirs.normalize(text)
        if origin is not None:
            assert len(origin) == len(norm.encode()) + 1 and origin[-1] == len(text.encode()) and (np.diff(origin) >= 0).all()


def test_shards_are_read_back_and_found_by_key(spark, hf, tmp_path):
    from ledgerline.llm.id_shards import fetch_ids, read_ids, write_ids

    own, df = rows(spark)
    path = f"file://{tmp_path}/ids"
    assert write_ids(df.repartition(5), BYTES, path).agg({"n_docs": "sum"}).first()[0] == len(own)
    got = read_ids(df, path).collect()
    want = {}
    for i, t in own:
        ids = hf.encode(t or "", add_special_tokens=False).ids + [2]
        want.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    have = {}
    for r in got:
        have.setdefault(r["doc_id"], []).append((r["n_tokens"], r["ids_crc32"]))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    in_order = sorted(got, key=lambda r: r["start"])
    keys = [-1 if r["doc_id"] is None else r["doc_id"] for r in in_order]
    assert keys == sorted(keys)
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(in_order, in_order[1:], strict=False))
    many = spark.range(400).selectExpr("5L as doc_id", "concat('word ', id % 3) as text", "id as shard", "'x' as row")  # one key, more than one shard
    write_ids(many.repartition(4), BYTES, f"file://{tmp_path}/many")
    assert read_ids(many, f"file://{tmp_path}/many").selectExpr("sum(n_tokens)", "max(start)").collect() == [(1200, 1197)]
    assert fetch_ids(many, f"file://{tmp_path}/many").count() == 400
    asked = spark.createDataFrame([(3,), (9999,), (123456,), (None,)], "doc_id long")
    found = fetch_ids(asked, path).collect()
    assert sorted(r["doc_id"] for r in found) == [3, 9999, 9999]
    assert next(r["ids"] for r in found if r["doc_id"] == 3) == hf.encode(own[3][1], add_special_tokens=False).ids + [2]


def test_perfect_hash_is_minimal_and_refuses_strangers():
    from ledgerline.llm.id_shards import KeyIndex

    keys = np.unique(np.random.default_rng(1).integers(-(2**62), 2**62, 5000))
    twice = np.sort(np.concatenate([keys, keys[::7]]))
    places = np.arange(len(twice))
    index = KeyIndex.from_bytes(KeyIndex(twice, places % 9, places * 3, places + 1).to_bytes())
    assert sorted(index.hash.slots(keys).tolist()) == list(range(len(keys)))
    which, entry = index.find(keys)
    assert (np.sort(keys[which]) == twice).all() and (twice[index.row[entry] // 3] == keys[which]).all()
    assert (index.rows[entry] == index.row[entry] // 3 + 1).all() and (index.shard[entry] == index.row[entry] // 3 % 9).all()
    strange = np.setdiff1d(np.arange(3000), keys)
    assert not len(index.find(strange)[0])
    none = np.zeros(0, np.int64)
    assert not len(KeyIndex.from_bytes(KeyIndex(none, none, none, none).to_bytes()).find(strange)[0])


def test_empty_tables(spark, tmp_path):
    from ledgerline.llm.id_shards import read_ids, write_ids
    from ledgerline.llm.packing import pack, token_pieces
    from ledgerline.llm.pieces import piece_digests

    none = spark.createDataFrame([], SCHEMA)
    assert piece_digests(none, PIECES).count() == 0
    assert pack(token_pieces(none, BYTES)).count() == 0
    write_ids(none, BYTES, f"file://{tmp_path}/none")
    assert read_ids(none, f"file://{tmp_path}/none").count() == 0


def test_packing_fills_sequences_without_gaps(spark, hf):
    from ledgerline.llm.packing import best_fit, pack, token_pieces

    own, df = rows(spark)
    pieces = pack(token_pieces(df.select("*"), BYTES, size=64), size=64, open_bins=16, batch_bins=8).collect()
    ids = {}
    for i, t in own:
        ids.setdefault(i, []).append(hf.encode(t or "", add_special_tokens=False).ids + [0])
    assert sum(r["length"] for r in pieces) == sum(len(x) for v in ids.values() for x in v)
    for r in pieces:
        crcs = [zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for x in ids[r["doc_id"]]]
        assert r["ids_crc32"] in crcs and 0 < r["length"] <= 64 and (r["piece"] == 0 or r["length"] == 64)
    by = {}
    for r in pieces:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own_pieces in by.values():
        at = 0
        for offset, length in sorted(own_pieces):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r["length"] for r in pieces)
    assert len(by) <= 1.1 * -(-total // 64)
    bins, offsets = best_fit([40, 30, 24, 34, 10], 64, 2)
    assert bins == [0, 1, 0, 1, 2] and offsets == [0, 0, 40, 30, 0]


def plain_best_fit(lengths, size, open_bins):
    """The rule by lists: the fullest open bin with room; the fullest of all closes; of equally full ones the last touched."""
    open_, out, new = [], [], 0
    for n in lengths:
        room = [(free, -k) for k, (_, free) in enumerate(open_) if free >= n]
        if room:
            chosen, free = open_.pop(-min(room)[1])
        else:
            chosen, free, new = new, size, new + 1
        out.append((chosen, size - free))
        open_.append((chosen, free - n))
        open_ = [x for x in open_ if x[1]]
        if len(open_) > open_bins:
            least = min(free for _, free in open_)
            mine = open_[-1]
            if mine[1] == least:
                open_.pop()
            else:
                open_.pop(max(k for k, x in enumerate(open_) if x[1] == least))
    return out


def least_bins(lengths, size):
    """The optimum by trying every place of every piece."""
    best = len(lengths)

    def place(k, frees):
        nonlocal best
        if len(frees) >= best:
            return
        if k == len(lengths):
            best = len(frees)
            return
        for free in sorted(set(frees)):
            if free >= lengths[k]:
                rest = list(frees)
                rest[rest.index(free)] -= lengths[k]
                place(k + 1, rest)
        place(k + 1, [*frees, size - lengths[k]])

    place(0, [])
    return best


def test_best_fit_equals_its_rule_and_nears_the_optimum():
    from ledgerline.llm.packing import arrival, best_fit

    random.seed(6)
    for open_bins in (1, 2, 5, 100):
        lengths = [random.choice([1, 5, 17, 30, 40, 63, 64, random.randint(1, 64)]) for _ in range(400)]
        assert list(zip(*best_fit(lengths, 64, open_bins), strict=True)) == plain_best_fit(lengths, 64, open_bins)
    for _ in range(40):
        lengths = np.array([random.randint(3, 40) for _ in range(9)])
        order = arrival(np.array([random.getrandbits(40) for _ in lengths]), lengths, 4096)
        bins, _ = best_fit(lengths[order].tolist(), 64, 4096)
        assert max(bins) + 1 <= least_bins(sorted(lengths.tolist(), reverse=True), 64) + 1


def test_repeated_rows_are_dealt_apart(spark):
    from pyspark.sql import functions as F

    from ledgerline.llm.packing import pack

    same = spark.range(4000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(0).alias("piece"), *(F.lit(x).cast("long").alias(c) for c, x in (("start", 0), ("length", 30), ("ids_crc32", 5))))
    out = pack(same, size=64, open_bins=16, batch_bins=200).selectExpr("shiftright(sequence_id, 32) as batch").groupBy("batch").count().collect()
    assert sum(r["count"] for r in out) == 4000 and len(out) >= 9 and max(r["count"] for r in out) < 1000


def test_memo_in_one_call_equals_the_library(hf):
    from ledgerline.llm import byte_bpe

    own = texts() + ["word " * 9000 + "end", "é\x85 b\xa0 c <|endoftext|> d", " lead"]
    for memo, group in ((50, 1 << 20), (1 << 18, 300)):
        size, byte_bpe.GROUP = byte_bpe.GROUP, group
        try:
            got = [x.tolist() for x in byte_bpe.PartIds(BYTES, memo).of_many([*own, None], 2)]
        finally:
            byte_bpe.GROUP = size
        assert got == [hf.encode(t, add_special_tokens=False).ids + [2] for t in [*own, ""]]


def test_words_marks_and_line_ends_are_remembered_apart(hf):
    from ledgerline.llm import byte_bpe

    random.seed(6)
    ink = ["word", "Other", "x's", "'ll", "'", "12", "(", ")", "-", ".", "é", "日本", "😀", "<|endoftext|>"]
    space = ["", "", " ", "  ", "\n", "\n\n", "\r\n", "\t ", "\x1c", "\x85", "\xa0", "\u2003", "\u3000"]
    own = ["".join(random.choice(ink) + random.choice(space) for _ in range(random.randint(0, 12))) for _ in range(3000)]
    ids = byte_bpe.PartIds(BYTES)
    assert [x.tolist() for x in ids.of_many(own, 2)] == [hf.encode(t, add_special_tokens=False).ids + [2] for t in own]
    few, words = byte_bpe.PartIds(BYTES), [f" {a}{b}" for a in ("one", "two", "three") for b in "abcdefgh"]
    list(few.of_many(["".join(w + m for w in words) for m in (",", ".", "!", ".\nThe", ")\n")], 2))
    assert len(few) <= len(words) + 7  # not a part for each word and mark


def test_forgetting_drops_vocabularies_and_tables(hf):
    import gc
    import weakref

    import public_tokenizers

    from ledgerline.llm import common
    from ledgerline.llm.byte_bpe import part_ids, tokenizer

    class Watched(common.Rolling):
        pass

    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = part_ids(path)
    assert part_ids(path) is ids
    text = "some words that are encoded"
    want, held = ids.of(text, 2).tolist(), weakref.ref(ids)
    at = np.array([0])
    hashed = Watched(np.arange(200, dtype=np.uint8)).at(at, at + 50).tolist()
    assert len(common.Rolling._up) > 1
    del ids
    common.forget()
    gc.collect()
    assert held() is None and len(common.Rolling._up) == 1 and not hasattr(tokenizer, "cache_info")
    assert part_ids(path).of(text, 2).tolist() == want
    assert Watched(np.arange(200, dtype=np.uint8)).at(at, at + 50).tolist() == hashed


def test_arrow_slices_keep_every_row():
    from ledgerline.llm.common import text_slices

    column = pa.array(["a" * 50, "", "b", "c" * 200, "d"])
    parts = list(text_slices(column, most=60))
    assert [x for _, p in parts for x in p.to_pylist()] == column.to_pylist()
    assert [f for f, _ in parts] == [sum(len(p) for _, p in parts[:k]) for k in range(len(parts))]
