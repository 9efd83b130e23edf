"""Search, quality, media, dedup, joins and scores against brute force, round trips and held-out rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

SCHEMA = "doc_id long, text string"


def as_key(rows):
    return sorted(map(str, rows))


# ---- search


def test_nearest_finds_most_and_measures_exactly(spark):
    from ledgerline.llm.nearest import nearest

    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 16)).round(3)
    x[50:90] = x[0]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(900, None), (901, [0.0] * 16), (902, [None] + [1.0] * 15), (903, [float("nan")] * 16), (904, [float("inf")] * 16), (905, []), (None, [1.0] * 16), (906, [1.0, 2.0])]
    df = spark.createDataFrame(rows + bad + [rows[10]], "vec_id long, embedding array<double>")
    from pyspark.sql import functions as F

    got = nearest(df.selectExpr("*", "1 as dim", "'x' as vec"), F.col("vec_id") % 20 == 0, chunk=50).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["query_id"]].append(r)
    assert set(by) == set(range(0, 400, 20))
    hits = 0
    for q, own in by.items():
        own.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 11))
        assert [(r["score"], r["vec_id"]) for r in own] == sorted((r["score"], r["vec_id"]) for r in own)
        gap = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        assert all(r["score"] == gap[r["vec_id"]] and r["vec_id"] != q for r in own)
        gap[q] = np.inf
        hits += len(set(np.lexsort((np.arange(400), gap))[:10].tolist()) & {r["vec_id"] for r in own})
    assert hits / (10 * len(by)) >= 0.9
    assert nearest(df.limit(0), F.lit(True)).count() == 0
    two = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1])], "vec_id long, embedding array<double>")
    assert [tuple(r)[:3] for r in nearest(two, F.col("vec_id") == 0).collect()] == [(0, 1, 1)]


@pytest.mark.parametrize("size", [1, 2, 8, 20, 60])
def test_nearest_answers_whole_small_tables(spark, size):
    from pyspark.sql import functions as F

    from ledgerline.llm.nearest import nearest

    x = np.random.default_rng(size).normal(size=(size, 64)).round(3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(500, [1.0, 2.0])], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in nearest(df, F.col("vec_id") % 4 == 0).collect())
    want = []
    for q in range(0, size, 4):
        gap = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        near = [i for i in np.lexsort((np.arange(size), gap)).tolist() if i != q][:10]
        want += [(q, rank, i, float(gap[i])) for rank, i in enumerate(near, 1)]
    assert len(got) == len(want)  # all candidates, if fewer than ten; ten otherwise
    assert size > 10 or got == want  # fewer than ten candidates: all of them


# ---- quality


def test_quality_learns_and_leaves_held_out_rows_alone(spark):
    from ledgerline.llm import quality

    random.seed(1)
    good = lambda: " ".join(random.choices(["river", "stone", "light", "walking", "under", "morning"], k=40))
    junk = lambda: " ".join(random.choices(["xx##", "b$$$", "!!!", "zz%%"], k=40))
    rows = [(i, good() if i % 3 else junk()) for i in range(400)]
    docs = spark.createDataFrame(rows + [(1000, None), (1001, ""), (1002, "  "), (None, good()), (5, "again")], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(400)] + [(None, 1, 0), (3, None, 0), (4000, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.quality_scores(docs, labels).collect()
    assert len(out) == 405 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out)
    held = [r for r in out if r["doc_id"] is not None and r["doc_id"] < 400 and r["held_out"] and r["doc_id"] != 5]
    assert {r["doc_id"] for r in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2 and i != 5}
    assert np.mean([r["predicted"] == int(r["doc_id"] % 3 > 0) for r in held]) > 0.95
    # Labels of held-out rows change nothing.
    turned = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 4 = 2 then 1 - quality else quality end as quality", "toxic")
    again = quality.quality_scores(docs, turned).collect()
    assert as_key(map(tuple, out)) == as_key(map(tuple, again))
    assert {r["score"] for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(docs.limit(0), labels).count() == 0


def plain_train(examples, epochs=5, rate=0.4):
    """The same descent written out number by number, on a dict of vectors."""
    from ledgerline.llm.quality import BACK, BUCKETS, DIM

    rng = np.random.default_rng(0)
    start = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    vectors, layer, bias, done = {}, [[0.0, 0.0] for _ in range(DIM)], [0.0, 0.0], 0
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            label, features = examples[i]
            now, total = rate * (1 - done / (epochs * len(examples))), sum(features.values())
            done += 1
            own = {f: vectors.setdefault(f, start[f].tolist()) for f in features}
            mean = [sum(c / total * own[f][d] for f, c in features.items()) for d in range(DIM)]
            z = [sum(mean[d] * layer[d][k] for d in range(DIM)) + bias[k] for k in (0, 1)]
            p = [np.exp(x - max(z)) for x in z]
            p = [x / sum(p) - (k == label) for k, x in enumerate(p)]
            back = [sum(layer[d][k] * p[k] for k in (0, 1)) for d in range(DIM)]
            for d in range(DIM):
                for k in (0, 1):
                    layer[d][k] -= now * mean[d] * p[k]
            for k in (0, 1):
                bias[k] -= 0.1 * now * p[k]
            for f, c in features.items():
                for d in range(DIM):
                    vectors[f][d] -= now * BACK * c / total * back[d]
    return start, vectors, layer, bias


def plain_features(text):
    """Counts of hashed words, n-grams and pairs of a text, one by one."""
    from ledgerline.llm.quality import BUCKETS, SAME

    words, found = text.split(), collections.Counter()
    for w in words:
        marked = f"<{w}>".encode()
        for gram in [marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)] + [marked]:
            found[zlib.crc32(gram) % (BUCKETS - 1) + 1] += 1
    h = lambda w: zlib.crc32(w.encode()) << 32 | zlib.crc32(w.encode()[::-1])
    for x, y in zip(words, words[1:], strict=False):
        both = (h(x) * 0x9E3779B97F4A7C15 ^ h(y) * 0xC2B2AE3D27D4EB4F) & (1 << 64) - 1
        both = (both ^ both >> 29) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
        found[SAME if x == y else (both >> 33) % (BUCKETS - 1) + 1] += 1
    return found


def test_scores_equal_a_plain_trainer(spark):
    from ledgerline.llm import quality

    random.seed(4)
    rows = [(i, " ".join(random.choices(["river", "stone", "stone", "xx##", "b$$$", "é"], k=random.randint(0, 12)))) for i in range(60)]
    labels = {i: i % 2 for i in range(50)}
    learned = [i for i in labels if zlib.crc32(str(i).encode()) % 4 != 2]
    start, vectors, layer, bias = plain_train([(labels[i], plain_features(dict(rows)[i])) for i in learned])
    got = quality.quality_scores(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(i, q, 0) for i, q in labels.items()], "doc_id long, quality int, toxic int")).collect()
    for r in got:
        features = plain_features(dict(rows)[r["doc_id"]])
        total = max(1, sum(features.values()))
        z = bias[1] - bias[0] + sum(c / total * sum(v * (layer[d][1] - layer[d][0]) for d, v in enumerate(vectors.get(f, start[f]))) for f, c in features.items())
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)


def test_the_sample_is_bounded_in_rows_and_features(spark, monkeypatch):
    from ledgerline.llm import quality

    seen = []
    monkeypatch.setattr(quality, "train", lambda examples: seen.extend(examples))
    docs = spark.createDataFrame([(1, f"copy {i % 5}") for i in range(300)] + [(2, " ".join(f"w{i}x" for i in range(6000))), (3, "three")], SCHEMA)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, 0), (4, 1)], "doc_id long, label int")
    quality.fit(docs, labels)
    assert sorted(x[0] for x in seen) == [0, 0, 1] and max(len(x[1]) for x in seen) == quality.FEATURES


def test_projected_scores_equal_averaged_vectors():
    from ledgerline.llm import quality

    model = quality.train([(1, *quality.text_features("good words here")), (0, *quality.text_features("b$$ b$$ c##"))], epochs=3)
    for text in ["good words", "b$$ b$$", "a", "new words b$$ and more more more"]:
        buckets, counts = quality.text_features(text)
        z = (counts / counts.sum()) @ model.vectors[buckets] @ model.layer
        assert quality.Words(model.scores(), memo=2).logit(text) == pytest.approx(z[1] - z[0], abs=1e-5)


# ---- media


def test_expansion_tables_and_round_trips(spark):
    from ledgerline.llm import telephony as T

    assert (T.MU_TABLE[0xFF], T.MU_TABLE[0x7F], T.MU_TABLE[0x00], T.MU_TABLE[0x80]) == (0, 0, -32124, 32124)
    assert (T.A_TABLE[0xD5], T.A_TABLE[0x55], T.A_TABLE[0xAA], T.A_TABLE[0x2A]) == (8, -8, 32256, -32256)
    wavy = (8000 * np.sin(np.arange(3000) / 20)).astype(np.int16)
    coded = T.adpcm_encode(wavy, 256)
    back = T.adpcm_decode(coded, 256)[: len(wavy)]
    assert np.abs(back.astype(int) - wavy).mean() < 200
    # one block at a time gives the same
    assert (np.concatenate([T.adpcm_decode(coded[i : i + 256], 256) for i in range(0, len(coded), 256)])[: len(wavy)] == back).all()
    for form, data in ((T.MU_LAW, b"abc"), (T.A_LAW, b""), (T.PCM, b"abcd"), (T.ADPCM, coded)):
        assert T.unwave(T.wave(data, form, block=256 if form == T.ADPCM else 1))[3] == data
    assert len(T.resample(wavy, 8000, 12000)) == (len(wavy) - 1) * 3 // 2 + 1 and (T.resample(wavy, 8000, 8000) == wavy).all()
    assert (T.resample(wavy, 8000, 16000)[::2] == wavy).all()
    media = spark.createDataFrame([(1, T.wave(coded, T.ADPCM, block=256)), (2, None)], "id int, media binary")
    out = {r["id"]: r["media"] for r in T.decode_media(media, 8000).collect()}
    assert out[2] is None and T.unwave(bytes(out[1]))[3][: 2 * len(wavy)] == back.astype("<i2").tobytes()


def heard(data):
    """(stored form, feature) of a payload, sample by sample from the rules."""
    from ledgerline.llm.telephony import INDEX_MOVES, STEPS

    form, samples = zlib.crc32(data) % 3, []
    for start in range(0, len(data), 64):
        if form == 2:
            value, index = 0, 0
            samples.append(0)
            for code in (c for x in data[start : start + 64] for c in (x & 15, x >> 4)):
                step = int(STEPS[index])
                move = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value - move if code & 8 else value + move))
                index = max(0, min(88, index + int(INDEX_MOVES[code])))
                samples.append(value)
            continue
        for x in data[start : start + 64]:
            if form == 0:
                x ^= 255
                size = ((((x & 15) << 3) + 132) << (x >> 4 & 7)) - 132
                samples.append(-size if x & 128 else size)
            else:
                x ^= 0x55
                size = ((x & 15) << 4) + 8 if not x >> 4 & 7 else ((x & 15) << 4) + 264 << ((x >> 4 & 7) - 1)
                samples.append(size if x & 128 else -size)
    sound = []
    for k in range((len(samples) - 1) * 2000 // 8000 + 1):
        left, part = divmod(k * 8000, 2000)
        right = samples[min(left + 1, len(samples) - 1)]
        sound.append(samples[left] + (right - samples[left]) * part // 2000)
    turns = sum((x < 0) != (y < 0) for x, y in zip(sound, sound[1:], strict=False))
    n = len(sound)
    text = f"{n}:{sum(map(abs, sound)) // n}:{max(map(abs, sound))}:{turns}:{sum(x * x for x in sound) * 1000 // (n << 30)}"
    body = b"".join(b"\0" * 4 + data[i : i + 64] for i in range(0, len(data), 64)) if form == 2 else data
    code, bits, block, speed = ((7, 8, 1, 8000), (6, 8, 1, 8000), (17, 4, 68, 4000))[form]
    fmt = b"fmt " + (16 + 2).to_bytes(4, "little") + b"".join(v.to_bytes(w, "little") for v, w in ((code, 2), (1, 2), (8000, 4), (speed, 4), (block, 2), (bits, 2), (0, 2)))
    chunk = b"WAVE" + fmt + b"data" + len(body).to_bytes(4, "little") + body
    return b"RIFF" + len(chunk).to_bytes(4, "little") + chunk, text


def test_stored_media_hold_the_payload(spark):
    from ledgerline.llm import telephony as T

    own = [(1, "abc"), (2, ""), (3, None), (4, "x" * 64), (5, "é" * 5000), (1, "abc"), (None, "q")] + [(10 + i, f"text {i} " * i) for i in range(12)]
    got = T.stored_text_media(spark.createDataFrame(own, SCHEMA).selectExpr("*", "'x' as media", "1 as n_bytes")).collect()
    want = []
    for i, t in own:
        data = (t or "").encode()
        data += b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
        media, text = heard(data)
        want.append((i, len((t or "").encode()), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(media), hashlib.sha256(media).hexdigest(), text))
    assert as_key(map(tuple, got)) == as_key(want)
    assert T.stored_text_media(spark.createDataFrame([], SCHEMA)).count() == 0
    broken = spark.createDataFrame([(1, b"RIFF"), (2, None), (3, b"no sound at all")], "id int, media binary")
    assert [r["media"] for r in T.decode_media(broken).collect()] == [None] * 3
    none = T.media_digests(broken.selectExpr("id as doc_id", "0L as n_bytes", "media", "media as pcm")).collect()
    assert all(r["payload_bytes"] is None and r["feature"] is None for r in none)


def test_long_sounds_in_pieces_are_the_same(monkeypatch):
    from ledgerline.llm import telephony as T

    sound = np.random.default_rng(3).integers(-30000, 30000, 5000).astype(np.int16)
    whole = [T.resample(sound, 8000, r) for r in (2000, 12000)], T.feature(sound)
    monkeypatch.setattr(T, "PIECE", 7)
    assert all((a == b).all() for a, b in zip(whole[0], [T.resample(sound, 8000, r) for r in (2000, 12000)], strict=True)) and T.feature(sound) == whole[1]


def test_lower_rates_by_means_count_every_sample(spark, monkeypatch):
    from ledgerline.llm import telephony as T

    sound = np.random.default_rng(5).integers(-32768, 32767, 1001).astype(np.int16)
    for piece in (1 << 20, 7):
        monkeypatch.setattr(T, "PIECE", piece)
        for n, rate in [(0, 2000), (1, 2000), (2, 2000), (63, 2000), (64, 2000), (1001, 3000), (1001, 7999)]:
            x, want = sound[:n].tolist(), []
            for k in range(-(-n * rate // 8000)):
                low, high = k * 8000, min((k + 1) * 8000, n * rate)
                want.append(sum(v * max(0, min(high, (i + 1) * rate) - max(low, i * rate)) for i, v in enumerate(x)) // (high - low))
            assert T.mean_resample(sound[:n], 8000, rate).tolist() == want
        assert (T.mean_resample(sound, 8000, 12000) == T.resample(sound, 8000, 12000)).all()
    monkeypatch.undo()
    own = [(1, "abc"), (2, ""), (3, None), (5, "é" * 5000), (1, "abc"), (6, "long " * 250_000)]
    got = T.stored_text_media(spark.createDataFrame(own, SCHEMA), T.mean_resample).collect()
    want = []
    for i, text in own:
        media = T.coded(T.payload(text))
        form, rate, block, data = T.unwave(media)
        want.append((i, hashlib.sha256(media).hexdigest(), T.feature(T.mean_resample(T.expand(form, block, data), rate, 2000))))
    assert as_key((r["doc_id"], r["media_sha256"], r["feature"]) for r in got) == as_key(want)


# ---- repeated bytes


def brute_repeats(own, size):
    data = [(i, (t or "").encode()) for i, t in own]
    seen = collections.Counter(b[p : p + size] for _, b in data for p in range(len(b) - size + 1))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1):
            if seen[b[p : p + size]] > 1:
                gone[p : p + size] = b"\1" * size
        rest = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), len(b) - len(rest), sum(1 for p in range(len(b)) if gone[p] and not (p and gone[p - 1])), hashlib.sha256(rest).hexdigest()))
    return out


@pytest.mark.parametrize(("size", "span"), [(12, 5), (10, 1), (12, 12)])
def test_repeats_equal_brute_force(spark, size, span):
    from ledgerline.llm.repeats import without_repeats

    random.seed(3)
    own = [(i, "".join(random.choices("abé", k=random.randint(0, 60)))) for i in range(120)]
    own += [(900, None), (None, "a" * 29), (901, "x" * 50), (902, ""), (902, ""), (903, "abcdefghijklmnopqrstuvwxyz"), (903, "abcdefghijklmnopqrstuvwxyz"), (904, "ab" * 13)]
    df = spark.createDataFrame(own, SCHEMA).selectExpr("*", "1 as start", "2 as key")
    assert as_key(map(tuple, without_repeats(df, size, span).drop("kept").collect())) == as_key(brute_repeats(own, size))


def test_repeats_of_production_size(spark):
    from ledgerline.llm.repeats import without_repeats

    random.seed(4)
    word = lambda n: "".join(random.choices("abcdefghij ", k=n))
    shared = word(700)
    own = [(1, word(900) + shared + word(300)), (2, word(50) + shared[:450]), (3, word(2000)), (4, word(399)), (5, shared[250:660] + word(10)), (6, "z" * 1500)]
    out = without_repeats(spark.createDataFrame(own, SCHEMA))
    assert as_key(map(tuple, out.drop("kept").collect())) == as_key(brute_repeats(own, 400))
    assert without_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_runs_that_a_text_repeats_are_one_row(spark):
    from ledgerline.llm.repeats import runs, without_repeats

    texts = ["Is onhe. " * 3000, "head " + "Is onhe. " * 2000 + "tail", "z" * 20_000]
    rows = runs(spark.createDataFrame(list(enumerate(texts)), "key long, text string"))
    assert rows.count() < 60 and rows.where("reach > windows").select("key").distinct().count() == 3

    random.seed(5)
    word = lambda n: "".join(random.choices("abé ", k=n))
    own = [(i, word(random.randint(0, 20)) + random.choice(["ab ", "é", "abé ab ", word(9)]) * random.randint(0, 30) + word(random.randint(0, 20))) for i in range(80)]
    own += [(200, ("ab " * 9 + word(30)) * 3), (201, "xy" * 12), (202, "qrs" * 7 + "!"), (202, "qrs" * 7 + "!"), (203, "0123456789ab" * 2)]
    for size, span in ((12, 5), (12, 12), (10, 1)):
        out = without_repeats(spark.createDataFrame(own, SCHEMA), size, span)
        assert as_key(map(tuple, out.drop("kept").collect())) == as_key(brute_repeats(own, size))


# ---- shingle join


def test_rows_that_repeat_thousands_of_times_meet_once(spark):
    from ledgerline.llm.shingle_join import one_of_each, shingle_join

    words = [f"w{i}" for i in range(60)]
    near = " ".join([*words[:58], "x", "y"])
    rows = [(7, " ".join(words))] * 5000 + [(3, near)] * 5000 + [(9, " ".join(f"z{i}" for i in range(60)))]
    df = spark.createDataFrame(rows, SCHEMA)
    got = shingle_join(df).groupBy("doc_id", "n_shingles", "component_id").count().collect()
    assert {tuple(r) for r in got} == {(7, 56, 3, 5000), (3, 56, 3, 5000), (9, 56, 9, 1)}
    assert sorted(r["doc_id"] for r in one_of_each(df).collect()) == [3, 9]



def brute_components(own):
    sets = []
    for _, t in own:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset()))
    parent = list(range(len(own)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(own)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for k, (i, _) in enumerate(own):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return [(i, len(sets[k]), i if not sets[k] else least.get(root(k))) for k, (i, _) in enumerate(own)]


def near_copies(groups=12, n=160):
    random.seed(9)
    own = []
    vocabulary = ["".join(random.choices("abcdefg", k=4)) for _ in range(300)]
    line = " ".join(random.choices(vocabulary, k=14))
    for g in range(groups):
        base = random.choices(vocabulary, k=random.randint(8, 90))
        for _ in range(n // groups):
            w = list(base)
            for _ in range(random.randint(0, 3)):
                w[random.randrange(len(w))] = random.choice(vocabulary)
            own.append((len(own), random.choice(["{} {}", "{}\n", "{}"]).format(" ".join(w), line)))
    return own


def test_components_equal_brute_force(spark):
    from ledgerline.llm.shingle_join import one_of_each, shingle_join

    own = near_copies() + [(500, None), (501, ""), (502, "\t \n"), (503, "One two"), (504, "oNE\ttwo"), (505, "one two three"), (400, "one two"), (None, "ONE TWO"), (None, "alone here"), (506, "É b c d e"), (507, "é b c d e")]
    df = spark.createDataFrame(own, SCHEMA).selectExpr("*", "1 as n", "2 as sig", "3 as key")
    want = brute_components(own)
    assert as_key(map(tuple, shingle_join(df).collect())) == as_key(want)
    stays = one_of_each(df).select("doc_id", "text").collect()
    comps = collections.Counter(c for _, n, c in want if n and c is not None)
    assert len([r for r in stays if (r["text"] or "").split()]) == len(comps) + 1  # and the one without an id
    assert len(stays) == len(comps) + 1 + 3
    assert shingle_join(df.limit(0)).count() == 0 and one_of_each(df.limit(0)).count() == 0


def test_large_groups_are_divided_and_lose_no_pair(spark, monkeypatch):
    from ledgerline.llm import shingle_join as S

    monkeypatch.setattr(S, "GROUP", 5)
    monkeypatch.setattr(S, "LARGE", 3)
    random.seed(12)
    base = [f"w{i}" for i in range(60)]
    own = []
    for i in range(70):  # many near copies of one text, of which many are no links of each other
        w = list(base)
        for k in random.sample(range(60), random.randint(0, 5)):
            w[k] = random.choice(["x", "y", "z"])
        own.append((i, " ".join(w)))
    df = spark.createDataFrame(own, SCHEMA)
    assert as_key(map(tuple, S.shingle_join(df).collect())) == as_key(brute_components(own))
    sets = S.shingle_sets(pa.array([t for _, t in own]))
    nodes = spark.createDataFrame([(S.signature(s), len(s), bytearray(S.histogram(s))) for s in sets], "sig long, n int, bins binary").dropDuplicates(["sig"])
    docs = S.keyed(df)
    nodes = nodes.join(S.survey(docs).where("sig is not null").groupBy("sig").agg({"key": "min"}).withColumnRenamed("min(key)", "key"), "sig")
    live = spark.createDataFrame([(int(h), S.signature(s), len(s), p) for s in sets for p, h in enumerate(s.view(np.int64)[: S.prefix_length(len(s))].tolist())], "hash long, sig long, n int, pos int").dropDuplicates(["hash", "sig"])
    alone = spark.createDataFrame([], "sig long, comp long")
    got = {(r["a"], r["b"]) for r in S.across(S.apart(live, alone), nodes, docs).collect()}
    by = {S.signature(s): s for s in sets}
    want = set()
    for x in by:
        for y in by:
            both = len(np.intersect1d(by[x], by[y]))
            if (len(by[x]), x) < (len(by[y]), y) and both >= S.needed(len(by[x]), len(by[y])):
                want.add((x, y))
    assert want and want <= got and len(got) < 1.2 * len(want) + 5


def test_shingles_of_the_same_nodes_meet_once(spark):
    from ledgerline.llm import shingle_join as S

    random.seed(15)
    passage = " ".join(f"p{i}" for i in range(80))
    own = [(i, " ".join(f"{random.randrange(10**9)}" for _ in range(40)) + " " + passage + f" {i}") for i in range(30)]
    own += [(100 + i, f"{t} more{i % 2}") for i, t in own[:6]] + [(200 + i, t) for i, t in own[:3]]
    df = spark.createDataFrame(own, SCHEMA).repartition(3)
    none = spark.createDataFrame([], "hash long, seen long")
    sets = {S.signature(s): s for s in S.shingle_sets(pa.array([t for _, t in own]))}
    by = collections.defaultdict(set)
    for sig, s in sets.items():
        for h in s.view(np.int64)[: S.prefix_length(len(s))].tolist():
            by[h].add(sig)
    groups = collections.Counter(frozenset(x) for x in by.values() if len(x) > 1)
    got = S.meetings(S.prefixes(S.keyed(df), none)).collect()
    assert len(got) == sum(map(len, groups)) < sum(len(x) * k for x, k in groups.items()) / 2
    met = collections.defaultdict(set)
    for r in got:
        met[r["hash"]].add(r["sig"])
        same = [h for h, x in by.items() if x == by[r["hash"]]]
        assert r["times"] == len(same) and r["n"] == len(sets[r["sig"]])
        assert r["pos"] == min(sets[r["sig"]].view(np.int64).tolist().index(h) for h in same)
    assert {frozenset(x) for x in met.values()} == set(groups)
    assert as_key(map(tuple, S.shingle_join(df).collect())) == as_key(brute_components(own))


def test_links_of_a_long_path_are_one_component(spark):
    from ledgerline.llm import shingle_join as S

    rows = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (200, 201), (201, 202), (202, 200)]
    random.seed(3)
    random.shuffle(rows)
    got = S.components(spark.createDataFrame(rows, "a long, b long")).collect()
    assert len(got) == len({r["sig"] for r in got})
    assert {r["sig"]: r["comp"] for r in got} == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, **dict.fromkeys((200, 201, 202), 200)}


def test_histograms_bound_what_sets_share(spark):
    from ledgerline.llm import shingle_join as S

    rng = np.random.default_rng(7)
    every = rng.integers(0, 1 << 64, 9000, dtype=np.uint64)
    sets = [np.unique(every[a:b]) for a, b in ((0, 100), (50, 500), (0, 3000), (1000, 9000), (2990, 3010), (0, 1))]
    assert [len(S.histogram(s)) for s in sets] == [256, 256, 2048, 4096, 256, 256]
    rows = [(i, j, bytearray(S.histogram(sets[i])), bytearray(S.histogram(sets[j]))) for i in range(6) for j in range(6)]
    for r in spark.createDataFrame(rows, "i int, j int, x binary, y binary").select("i", "j", S.bins_in_common("x", "y").alias("bound")).collect():
        both = len(np.intersect1d(sets[r["i"]], sets[r["j"]]))
        assert both <= r["bound"] <= max(2**60, 0) and (r["i"] != r["j"] or r["bound"] == both or r["bound"] > 2**50)


def test_parities_bound_what_sets_do_not_share():
    from ledgerline.llm import shingle_join as S

    rng = np.random.default_rng(8)
    every = rng.integers(0, 1 << 64, 90_000, dtype=np.uint64)
    sets = [np.unique(every[a:b]) for a, b in ((0, 1), (0, 64), (0, 100), (10, 110), (50, 500), (0, 600), (80, 600), (1000, 90_000))]
    marks = [S.parities(s) for s in sets]
    assert [8 * len(x) for x in marks] == [64, 64, 128, 128, 512, 1024, 1024, S.LONGEST]
    i, j = (x.ravel() for x in np.meshgrid(np.arange(8), np.arange(8)))
    for a, b, least in zip(i, j, S.least_apart(marks, i, j).tolist(), strict=True):
        apart = len(np.setxor1d(sets[a], sets[b]))
        assert least <= apart and (apart - least) % 2 == 0 and (a != b or least == 0)
    assert S.least_apart([marks[2], None], np.array([0, 1]), np.array([1, 0])).tolist() == [0, 0]


def test_pairs_of_small_groups_that_cannot_be_links_stay_in_their_task(spark):
    from ledgerline.llm import shingle_join as S

    random.seed(16)
    common = [f"c{i}" for i in range(5)]
    own = [(i, " ".join([*common, *(f"{random.randrange(10**9)}" for _ in range(60))])) for i in range(40)]
    own.append((40, own[0][1].rsplit(" ", 1)[0] + " y"))
    docs = S.keyed(spark.createDataFrame(own, SCHEMA))
    sets = {S.signature(s): s for s in S.shingle_sets(pa.array([t for _, t in own]))}
    shared = int(np.array([min(set.intersection(*(set(s.tolist()) for s in sets.values())))], np.uint64).view(np.int64)[0])
    live = spark.createDataFrame([(shared, sig, len(s), 0) for sig, s in sets.items()], "hash long, sig long, n int, pos int")
    nodes = S.survey(docs).where("n > 0").select("sig", "key", "marks")
    met = S.apart(live, spark.createDataFrame([], "sig long, comp long"))
    got = S.across(met.join(nodes.select("sig", "marks"), "sig"), nodes, docs).collect()
    first, last = (S.signature(S.shingle_sets(pa.array([own[k][1]]))[0]) for k in (0, 40))
    assert [{r["a"], r["b"]} for r in got] == [{first, last}]
    assert as_key(map(tuple, S.shingle_join(docs).collect())) == as_key(brute_components(own))


def test_rows_without_a_partner_stay_behind_and_no_pair_is_lost(spark):
    from ledgerline.llm import shingle_join as S

    rng = np.random.default_rng(17)
    rows = [(h, 1000 * h + k, int(n := rng.integers(8, 60)), int(rng.integers(0, S.prefix_length(int(n)))), 1000 * h + k) for h in range(150) for k in range(1 + h % 6)]
    columns = ["hash", "sig", "n", "pos", "comp"]
    left = {tuple(r) for r in S.partnered(spark.createDataFrame(rows, "hash long, sig long, n int, pos int, comp long")).select(columns).collect()}

    def pairs(own):
        hashes, sig, n, pos, comp = (np.array(x, np.int64) for x in zip(*own, strict=True))
        return S.met_pairs(hashes, np.zeros(len(own), np.int64), np.full(len(own), 2), sig, n, pos, comp, [None] * len(own), [None] * len(own)).tolist()

    want = pairs(rows)
    assert want and pairs(sorted(left)) == want and len(left) < 0.7 * len(rows)


def test_frequent_shingles_come_last():
    from ledgerline.llm.shingle_join import needed, prefix_length, rare_first

    own = np.array([1, 5, 9, 12], np.uint64)
    assert rare_first(own, np.array([5, 9], np.uint64), np.array([1, 0])).tolist() == [1, 12, 9, 5]
    assert prefix_length(4) == 2 and needed(4, 4) == 4 and needed(7, 7) == 6


# ---- scores


def test_scores_equal_counting(spark):
    from ledgerline.llm.lm_scores import BACKOFF, lm_scores

    random.seed(2)
    own = [(i, " ".join(random.choices(["a", "b", "c", "D", "e"], k=random.randint(0, 12)))) for i in range(40)] + [(90, None), (90, " "), (None, "a B"), (91, "zzz"), (1, "a b c"), (1, "a b c")]
    docs = [(t or "").lower().split() for _, t in own]
    count = [collections.Counter(tuple(d[j : j + k]) for d in docs for j in range(len(d) - k + 1)) for k in (1, 2, 3)]
    total = sum(map(len, docs))
    want = []
    for (i, _), d in zip(own, docs, strict=True):
        mine = [collections.Counter(tuple(d[j : j + k]) for j in range(len(d) - k + 1)) for k in (1, 2, 3)]
        c = lambda *g: count[len(g) - 1][g] - mine[len(g) - 1][g]
        score = 0.0
        for j, w in enumerate(d):
            if j >= 2 and c(*d[j - 2 : j + 1]):
                score += np.log(c(*d[j - 2 : j + 1]) / c(*d[j - 2 : j]))
            elif j >= 1 and c(d[j - 1], w):
                score += np.log(c(d[j - 1], w) / c(d[j - 1]) * (BACKOFF if j >= 2 else 1))
            else:
                score += np.log(max(c(w), 0.5) / max(total - len(d), 1) * BACKOFF ** min(j, 2))
        want.append((i, len(d), float(round(score, 6)), float(round(score / len(d), 6)) if d else None))
    got = [(r["doc_id"], r["n_words"], round(r["log_score"], 6), None if r["mean_log_score"] is None else round(r["mean_log_score"], 6)) for r in lm_scores(spark.createDataFrame(own, SCHEMA)).collect()]
    norm = lambda rows: as_key(tuple(0.0 if x == 0 and isinstance(x, float) else x for x in r) for r in rows)
    assert norm(got) == norm(want)
    assert lm_scores(spark.createDataFrame([], SCHEMA)).count() == 0


def test_blocks_round_trip():
    from ledgerline.llm.lm_scores import pack_answer, pack_block, unpack_answer, unpack_block

    rng = np.random.default_rng(0)
    for n in (0, 1, 5000):
        hashes = np.unique(rng.integers(0, 1 << 48, n).astype(np.uint64))
        counts = rng.choice([1, 1, 1, 2, 300, 1 << 40], len(hashes))
        a, b = unpack_block(pack_block(hashes, counts))
        assert (a == hashes).all() and (b == counts).all()
        some = counts * rng.integers(0, 2, len(hashes))
        assert (unpack_answer(pack_answer(some), len(hashes)) == some).all()


def test_grams_that_differ_in_low_or_high_bits_stay_apart():
    from ledgerline.llm.common import MIX_1, MIX_2
    from ledgerline.llm.lm_scores import EMPTY, STEP, cuts, grams, pack_block, table_of, unpack_block

    def word_of(h):
        """The word hash whose 1-gram is h: mixed() undone."""
        for shift, factor in ((31, MIX_2), (27, MIX_1), (30, 1)):
            x = h
            for _ in range(64 // shift):
                x = h ^ x >> shift
            h = x * pow(factor, -1, 1 << 64) % (1 << 64)
        return (h - 1) * pow(STEP, -1, 1 << 64) % (1 << 64)

    want = [0x123456789ABC0000, 0x123456789ABC0001, 0x123456789ABCFFFF, 0x923456789ABC0000, (1 << 64) - 1]
    words, bounds = np.array([word_of(h) for h in [*want, 0, EMPTY]], np.uint64), np.arange(8)
    assert grams(words, bounds, 1).tolist() == [*want, EMPTY + 1, EMPTY + 1]
    hashes, counts = table_of(words, bounds)
    assert dict(zip(hashes.tolist(), counts.tolist(), strict=True)) == {EMPTY: 7, EMPTY + 1: 2} | dict.fromkeys(want, 1)
    at = cuts(hashes, 3)
    assert at[0] == 0 and at[-1] == len(hashes)
    for a, b in zip(at, at[1:], strict=False):
        assert [x.tolist() for x in unpack_block(pack_block(hashes[a:b], counts[a:b]))] == [hashes[a:b].tolist(), counts[a:b].tolist()]


def test_kept_texts_leave_in_small_batches():
    import hashlib

    import pyarrow as pa

    from ledgerline.llm.repeats import kept_slices

    texts = [chr(97 + i % 26) * 100_000 for i in range(40)] + ["", "é" * 900_000, "end"]
    runs = [[{"start": i, "windows": 2}] if i % 2 and i < 40 else None for i in range(len(texts))]
    own = pa.array([{"doc_id": i} for i in range(len(texts))])
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), own, pa.array(texts), pa.array(runs, pa.list_(pa.struct([("start", pa.int32()), ("windows", pa.int32())])))], ["key", "own", "text", "runs"])
    made = list(kept_slices(batch, 400))
    assert len(made) > 4 and all(m.num_rows == 1 or sum(m["n_bytes"].to_pylist()) <= 1 << 20 for m in made)
    rows = [r for m in made for r in m.to_pylist()]
    assert [r["own"]["doc_id"] for r in rows] == list(range(len(texts)))
    for i, (r, text) in enumerate(zip(rows, texts, strict=True)):
        left = text if not runs[i] else text[:i] + text[i + 401 :]
        assert r["kept"] == left.encode() and r["kept_sha256"] == hashlib.sha256(left.encode()).hexdigest()
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(text.encode()), 401 if runs[i] else 0, 1 if runs[i] else 0)


def test_training_reads_features_where_arrow_holds_them(spark, monkeypatch):
    import pyarrow as pa

    from ledgerline.llm import quality

    seen, train = [], quality.train
    monkeypatch.setattr(quality, "train", lambda examples: seen.extend(examples) or train(examples))
    docs = spark.createDataFrame([(i, f"some words {i} of a text") for i in range(8)], "doc_id long, text string")
    quality.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, label int"))
    assert [x[0] for x in seen] == [i % 2 for i in range(8)]
    assert all(isinstance(a.base.obj if isinstance(a.base, memoryview) else a.base, pa.Buffer) and len(a) for _, *both in seen for a in both)


# ---- pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    random.seed(8)
    vocabulary = ["".join(random.choices("abcdefghijklmnop", k=6)) for _ in range(400)]
    good = lambda n: " ".join(random.choices(vocabulary, k=n))
    junk = lambda n: " ".join(random.choices(["x###", "y%%%", "z$$$"], k=n))
    passage = good(90)
    rows = [(i, good(120) if i % 4 else junk(80), "en", "s", 1) for i in range(160)]
    rows += [(200 + i, good(60) + " " + passage + " " + good(60), "en", "s", 1) for i in range(3)]
    copy = good(150)
    rows += [(300, copy, "en", "s", 1), (301, copy, "fr", "t", 1), (302, copy + " end", None, None, None), (303, None, None, None, None), (304, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    one = corpus_pipeline.keep_good(spark, docs, str(tmp_path)).cache()
    assert one.columns == docs.columns and not {r["doc_id"] for r in one.collect()} & set(range(0, 160, 4))
    assert {i for i in range(160) if i % 4} <= {r["doc_id"] for r in one.collect()}
    two = corpus_pipeline.keep_one_of_near_copies(spark, one, str(tmp_path)).cache()
    assert {r["doc_id"] for r in one.collect()} - {r["doc_id"] for r in two.collect()} == {301, 302}
    three = corpus_pipeline.drop_repeats(spark, two, str(tmp_path)).cache()
    assert three.columns == docs.columns
    left = {r["doc_id"]: r["text"] for r in three.collect()}
    assert all(passage[5:-5] not in left[i] for i in (200, 201, 202)) and left[300] == copy
    assert all(r["n_chars"] == len(r["text"]) for r in three.collect())
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in out.collect()} == set(left)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "suffix-array dedup", "best-fit packing"]


def test_every_operator_has_its_query():
    from ledgerline.llm.queries import queries

    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in queries()) == list(range(1, 11))


def test_key_filter_never_misses(spark):
    from ledgerline.llm.common import key_bits, may_hold

    keys = spark.range(0, 1000, 7).selectExpr("xxhash64(id) as key")
    marked = may_hold(spark.range(1000).selectExpr("id", "xxhash64(id) as key"), key_bits(keys)).collect()
    assert len(marked) == 1000 and all(r["held_"] for r in marked if r["id"] % 7 == 0)
    assert sum(r["held_"] for r in marked) < 160


def test_windows_of_bytes_hash_alike():
    from ledgerline.llm.common import Rolling
    from ledgerline.llm.repeats import sliding_least

    data = np.frombuffer(b"abcabcabc", np.uint8)
    with np.errstate(over="ignore"):
        r = Rolling(data)
        w = r.windows(3)
        assert w[0] == w[3] == w[6] and len({*w.tolist()}) == 3
        assert r.at(np.array([0]), np.array([6]))[0] == r.at(np.array([3]), np.array([9]))[0]
    values = np.array([5, 3, 8, 1, 9, 2, 7], np.uint64)
    assert sliding_least(values, 3).tolist() == [min(values[i : i + 3]) for i in range(5)]
    assert pa.array(["x"]).to_pylist() == ["x"]
