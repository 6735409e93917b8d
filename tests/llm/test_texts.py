"""Text operators against brute force, the libraries themselves, exact round trips and held-out accuracy."""

import hashlib
import io
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pricemesh.llm import fmindex, langid, pieces, planes, queries, toxicity

ODD = ["", " ", "  ", "a ", " a", "a\n\nb \n c", "x▁y", "▁", " ▁ a", "日本語 テスト", "👩‍👩‍👧 ﬁ ½", "\x00a\x00", "<s> </s> <unk>", "İstanbul ΣΑΣ",
       "<|endoftext|> x<|startoftext|>y", "e\u0301 ́a", "don't 's 123 ٣", "x\x1cy\x85z　w", "­​", "a" + " " * 40 + "b"]


def brute_windows(texts, items, window):
    out = []
    for t in texts:
        w = fmindex.words_of(t)
        hit, found = [0] * len(w), set()
        for k, x in items:
            v = fmindex.words_of(x)
            n = min(window, len(v))
            for s in range(len(v) - n + 1 if n else 0):
                for i in range(len(w) - n + 1):
                    if w[i : i + n] == v[s : s + n]:
                        found.add(str(k))
                        hit[i : i + n] = [1] * n
        out.append((len(w), sum(hit), sorted(found)))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_fm_index_finds_what_brute_force_finds(seed):
    r = random.Random(seed)
    words = "abcde"[: r.randint(1, 5)] + "xyz"[: r.randint(0, 3)]
    texts = [r.choice([None, "", " .", *[" ".join(r.choice(words) for _ in range(r.choice([1, 5, 60]))) for _ in range(6)]]) for _ in range(r.randint(0, 8))]
    items = [(i, " ".join(r.choice("abcde") for _ in range(r.randint(0, 6)))) for i in range(6)] + [(99, None)]
    window = r.randint(1, 5)
    hits = fmindex.scan_shard(texts, fmindex.Phrases.of(items, window))
    got = [(int(n), sum(e - b for b, e in s), sorted(set(i))) for n, s, i in zip(hits.words, hits.spans, hits.items)]
    assert got == brute_windows(texts, items, window)


def test_decontamination_query_equals_brute_force(spark, folder):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    joined = [(k, v, b" " + b" ".join(fmindex.words_of(v)) + b" ") for k, v in docs.items()]
    want = {}
    for k, v, text in joined:
        w = fmindex.words_of(v)
        close = [x for x in items if any(b" " + b" ".join(fmindex.words_of(x[1])[s : s + 13]) + b" " in text for s in range(max(1, len(fmindex.words_of(x[1])) - 12)))]
        n, hit, found = brute_windows([v], close, 13)[0]
        want[k] = (n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0 and 20 * hit >= n)
        assert n == len(w)
    got = {r[0]: tuple(r)[1:6] for r in queries.op2_decontamination(spark, folder).collect()}
    assert got == want


def test_contamination_of_odd_tables(spark):
    bench = spark.createDataFrame([(1, "one two three"), (2, None), (1, "")], "item_id long, text string")
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (None, "ONE, two; three!", None), (2, "four " * 3000 + "one two three", "n_words")], "doc_id long, text string, n_words string")
    got = sorted((tuple(r[:3]) for r in fmindex.find_contamination(docs, "doc_id", "text", bench).collect()), key=repr)
    assert got == sorted([(1, 0, 0), (2, 0, 0), (None, 3, 3), (2, 3003, 3)], key=repr)
    assert fmindex.drop_contaminated(docs, "text", bench).count() == 3
    assert fmindex.find_contamination(docs.limit(0), "doc_id", "text", bench.limit(0)).count() == 0


def test_pieces_equal_the_library_and_cover_the_original():
    coder = pieces.PieceEncoder(public_tokenizers.path("piece_bpe_32k.model"))
    r = random.Random(2)
    parts = [" ", "  ", "\n", "a", "b", "the", "▁", "é", "中", "\t", "x1"]
    texts = ODD + ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(400)]
    for t, ids, (got, begins, ends) in zip(texts, coder.library.encode(texts, add_bos=True, add_eos=True), coder.encode(texts)):
        raw = t.encode()
        assert got.tolist() == ids
        assert (begins <= ends).all() and (ends[:-1] <= begins[1:]).all() and ends[-1] == len(raw)
        for i, b, e in zip(ids[1:-1], begins[1:-1], ends[1:-1]):
            if not coder.library.is_byte(i):
                shown = raw[b:e].decode().replace(" ", "▁")
                assert coder.library.id_to_piece(i) in (shown, "▁" + shown)
    assert coder.decode([x[0] for x in coder.encode(texts)]) == coder.library.decode(coder.library.encode(texts))


def double_array(keys: dict[bytes, bytes]) -> bytes:
    """A compiled character map for a few keys: units are placed greedily, values point into the pool."""
    pool, values = b"", {}
    for k, v in keys.items():
        values[k], pool = len(pool), pool + v + b"\x00"
    units, used = {0: 0}, {0}

    def place(node: int, prefix: bytes) -> None:
        nexts = sorted({k[len(prefix)] for k in keys if k.startswith(prefix) and len(k) > len(prefix)})
        leaf = prefix in keys
        base = next(b for b in range(1, 1 << 12) if all((node ^ b ^ c) not in used for c in nexts + [0] * leaf))
        units[node] |= base << 10 | (leaf << 8)
        for c in nexts + [0] * leaf:
            used.add(node ^ base ^ c)
        if leaf:
            units[node ^ base] = values[prefix] | 0x80000000
        for c in nexts:
            units[node ^ base ^ c] = c
        for c in nexts:
            place(node ^ base ^ c, prefix + bytes([c]))

    place(0, b"")
    flat = [units.get(k, 0) for k in range(max(units) + 256)]
    return struct.pack("<I", 4 * len(flat)) + struct.pack(f"<{len(flat)}I", *flat) + pool


def test_character_map_takes_the_longest_prefix_and_keeps_places():
    keys = {"ﬁ".encode(): b"fi", b"ab": b"X", b"abc": b"Y", b"\t": b" "}
    cmap = pieces.CharMap(double_array(keys))
    assert cmap.longest(b"abcd", 0) == (3, b"Y") and cmap.longest(b"abx", 0) == (2, b"X") and cmap.longest(b"xa", 0) is None
    out, align = pieces.Normalizer(cmap, True, False).normalise("ﬁ abc\tz")
    assert out == b" fi Y z" and align.tolist() == [0, 0, 0, 3, 4, 7, 8, 9]
    out, align = pieces.Normalizer(cmap, True, True).normalise("  ab \t z ")
    assert out == b" X z" and align.tolist() == [2, 2, 4, 7, 8]


def test_sentencepiece_query_equals_the_library(spark, folder):
    library = pieces.PieceEncoder(public_tokenizers.path("piece_bpe_32k.model")).library
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in queries.op6_sentencepiece(spark, folder).collect()}
    for d in docs:
        ids = library.encode(d["text"] or "", add_bos=True, add_eos=True)
        r = got[d["doc_id"]]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
        assert r["covered_bytes"] == len((d["text"] or "").encode())
    odd = spark.createDataFrame([(1, None, "x"), (None, "", "y"), (1, "b " * 100_000, "z")], "doc_id long, text string, ids string")
    assert sorted(len(r["ids"]) for r in pieces.encode_pieces(odd, "doc_id", "text", public_tokenizers.path("piece_bpe_32k.model")).collect())[:2] == [8, 8]
    assert pieces.encode_pieces(odd.limit(0), "doc_id", "text", public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_word_encoder_equals_the_library():
    coder = planes.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    assert coder.by_word
    texts = ODD + ["Erer, ha. BLÄH!! ñandú *** und&&& l'été", "q" * 5000]
    for t, got, want in zip(texts, coder.encode(texts), coder.tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert got.tolist() == want.ids, t


@pytest.mark.parametrize("kind", ["bit", "byte"])
@pytest.mark.parametrize("block", [8, 1000])
def test_planes_round_trip(kind, block):
    class Source(io.BytesIO):
        def size(self):
            return len(self.getvalue())

        def close(self):
            pass

    r = np.random.default_rng(1)
    parts = [r.integers(0, top, n).astype("<u4") for top, n in ((1, 3), (50_000, 1001), (2**32, 17), (5, 0), (300, 8))]
    sink = Source()
    writer = planes.PlaneWriter(sink, kind, block)
    for p in parts:
        writer.append(p)
    writer.close()
    reader, at = planes.PlaneReader(sink), 0
    for p in parts:
        assert reader.read(at, len(p)).tolist() == p.tolist()
        at += len(p)
    with pytest.raises(ValueError):
        planes.PlaneWriter(Source(), "nibble")


def test_token_files_equal_the_library(spark, folder):
    coder = planes.WordEncoder(public_tokenizers.path("word_bpe_49k.json")).tokenizer
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect())
    want, start = {}, 0
    for (i, _), e in zip(docs, coder.encode_batch([t or "" for _, t in docs], add_special_tokens=False)):
        ids = np.array([*e.ids, 1], "<u4")
        want[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert {r[0]: tuple(r)[1:] for r in queries.op8_token_files(spark, folder).collect()} == want
    odd = spark.createDataFrame([(5, None), (5, ""), (None, "a b"), (7, "c")], "id long, text string")
    encode = planes.library_encoder(public_tokenizers.path("word_bpe_49k.json"))
    got = sorted((r["start"], r["n_tokens"]) for r in planes.read_planes(planes.write_planes(odd, "id", "text", encode, 1)).collect())
    assert got == [(0, 3), (3, 1), (4, 1), (5, 2)]
    assert planes.read_planes(planes.write_planes(odd.limit(0), "id", "text", encode, 1)).count() == 0


def test_languages_of_held_out_documents(spark, folder):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    held = [r for r in queries.op4_language(spark, folder).collect() if r["held_out"]]
    assert all(0 <= r["score"] <= 1 for r in held) and held
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_languages_of_odd_texts(spark):
    model = langid.fit(["the and of to", "der die und das", "the of and"], ["en", "de", "en"])
    assert model.predict([None, "", "12 ??", "\x00", "½ ²", "Ⅷ", "①", "〇", "١٢ _"])[0] == [langid.UNKNOWN] * 9
    assert model.predict(["½ the", "ª", "ー"])[0] == ["en"] * 3 or all(x != langid.UNKNOWN for x in model.predict(["½ the", "ª", "ー"])[0])
    assert model.predict(["und das der", "of the " * 50_000])[0] == ["de", "en"]
    assert langid.fit([], []).predict(["x"])[0] == [langid.UNKNOWN]
    assert langid.fit(["x y"], ["xx"]).predict(["und"])[0] == ["xx"]
    docs = spark.createDataFrame([(1, "the of", "a"), (1, None, None), (None, "9", "b")], "doc_id long, text string, score string")
    assert sorted((r["lang_pred"] for r in langid.identify(docs, "doc_id", "text", model).collect())) == ["en", "und", "und"]
    assert langid.keep_known(docs, "text", model).columns == docs.columns and langid.keep_known(docs, "text", model).count() == 1
    assert langid.train(docs.limit(0).withColumn("lang", F.lit("x")), "text", "lang").languages == []
    one, two = (set(langid.places([x], (1, 2), 18)[0].tolist()) for x in ("ab", "abab"))
    assert len(one) == 3 and len(two) == 4 and one < two  # a, b, ab; ba is new
    empty = langid.identify(docs.limit(0), "doc_id", "text", model)
    assert empty.count() == 0 and empty.columns == ["doc_id", "lang_pred", "score"]


def plain_ridge(texts, languages, config):
    """One-versus-rest kernel ridge regression on exact n-gram sets, with every text a landmark: outputs for any texts."""
    def grams(t):
        t = t.lower()
        return {t[i : i + n] for n in config.orders for i in range(len(t) - n + 1)}

    sets, known = [grams(t) for t in texts], sorted(set(languages))
    kernel = lambda a, b: np.array([[len(x & y) / max(len(x) * len(y), 1) ** 0.5 for y in b] for x in a])
    label = np.array([known.index(x) for x in languages])
    weight = 1.0 / np.bincount(label)[label]
    weight /= weight.sum()
    k = kernel(sets, sets)
    values, vectors = np.linalg.eigh(k)
    good = values > 1e-6 * values.max()
    x = k @ vectors[:, good] / np.sqrt(values[good])
    mean, target = weight @ x, np.eye(len(known))[label]
    normal = (x - mean).T @ (weight[:, None] * (x - mean))
    normal += config.ridge * np.trace(normal) / len(normal) * np.eye(len(normal))
    w = np.linalg.solve(normal, (x - mean).T @ (weight[:, None] * (target - weight @ target)))
    return lambda more: kernel([grams(t) for t in more], sets) @ (vectors[:, good] / np.sqrt(values[good])) @ w + weight @ target - mean @ w


def test_languages_equal_a_plain_kernel_ridge(spark, folder):
    docs = [(r["text"][:2000], r["lang"]) for r in spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect() if r["text"] and r["lang"]]
    train, rest = docs[:60], [t for t, _ in docs[60:160]]
    config = langid.LanguageConfig(landmarks_per_language=1000, bits=26)  # so many places that n-grams do not meet
    got = langid.fit(*map(list, zip(*train)), config).outputs(rest)
    want = plain_ridge(*zip(*train), config)(rest)
    assert np.abs(got - want).max() < 1e-3 and (got.argmax(axis=1) == want.argmax(axis=1)).all()


def test_copies_make_no_landmarks(spark):
    rows = [("the same early text", "en")] * 300 + [(f"words {i} and others of the {i * 7} kind", "en") for i in range(60)] + [(f"wörter {i} und andere der {i * 7} art", "de") for i in range(60)]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"), "text", "lang", langid.LanguageConfig(landmarks_per_language=40))
    assert model.predict(["others of the kind", "andere der art"])[0] == ["en", "de"]


def plain_toxicity(model, text):
    """The model's score by naive sets of n-grams."""
    weight = dict(zip(model.hashes.tolist(), model.weights.tolist()))
    folded = toxicity.fold(text)
    found = {int(h) for _, hs in toxicity.gram_hashes([folded], model.orders) for h in hs}
    return 1 / (1 + np.exp(-np.clip(model.bias + sum(weight.get(h, 0.0) for h in found), -40, 40)))


def test_toxicity_scores_equal_naive_sets(spark, folder):
    model = queries.toxicity_model(spark, folder)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in queries.op10_toxicity(spark, folder).collect():
        assert r["score"] == pytest.approx(plain_toxicity(model, texts[r["doc_id"]]), abs=1e-9)
        assert r["predicted"] == (r["score"] >= 0.3)


def test_toxicity_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in queries.op10_toxicity(spark, folder).collect() if r["held_out"] and r["doc_id"] in labels]
    hit = sum(r["predicted"] == 1 and labels[r["doc_id"]] == 1 for r in rows)
    assert hit >= 0.85 * sum(labels[r["doc_id"]] == 1 for r in rows)
    assert hit >= 0.9 * sum(r["predicted"] == 1 for r in rows)


def test_toxicity_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, "you vile toad " * 3, "a"), (2, None, None), (None, "", "b"), (2, "fine words", "c")], "doc_id long, text string, score string")
    texts = ["you vile toad", "vile toads here", "a vile toad", "vile toad again"] + ["plain good words", "more good words", "good words again", "plain words"]
    model = toxicity.fit(texts, np.array([1] * 4 + [0] * 4), 0.5)
    score = {r[0]: r[1] for r in toxicity.score_toxicity(docs.filter("text <> ''"), "doc_id", "text", model).collect()}
    assert score[1] > 0.5 > score[2] and 0 <= min(score.values())
    assert toxicity.drop_toxic(docs, "text", model, 0.5).columns == docs.columns
    assert toxicity.score_toxicity(docs, "doc_id", "text", model).count() == 4
    assert toxicity.score_toxicity(docs.limit(0), "doc_id", "text", model).count() == 0
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    constant = toxicity.train(docs, labels, "doc_id", "text", "toxic")
    assert max(constant.score(["x", None])) < 1e-15
    assert max(toxicity.fit(["a", "b"], np.array([k, k]), float(k)).score(["a"])[0] for k in (0, 1)) < 1e-15
    both = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, None)], "doc_id long, toxic int")
    again = spark.createDataFrame([(1, "you vile toad"), (1, "z"), (2, "fine words"), (2, None)] * 3, "doc_id long, text string")
    twice = [toxicity.train(again, both, "doc_id", "text", "toxic", toxicity.ToxicityConfig(least_df=1)) for _ in range(2)]
    assert twice[0].learned and twice[0].score(["you vile toad"])[0] > 0.5 > twice[0].score(["fine words"])[0]
    assert twice[0].score(["x vile words " * 100_000]) == twice[1].score(["x vile words " * 100_000])
    # An n-gram never reaches from one text into the next.
    grams = {int(h[k]) for n, h in toxicity.gram_hashes([toxicity.fold("ab")], (4,)) for k in range(len(h))}
    assert len(grams) == 1 and len(toxicity.ToxicityModel((4,), np.array(sorted(grams), np.uint64), np.ones(1), 0.0).present([" a", "b "])[0]) == 0
