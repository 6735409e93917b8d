"""Layout, archive, link and pipeline operators against brute force, SQL and exact round trips."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import corpus_pipeline
from pricemesh.llm import fmindex, jaccard, neardup_vectors, pieces, queries, shards, urlfilter, warc
from pricemesh.llm.common import written

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def groups(ids, linked):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in linked:
        p, q = root(a), root(b)
        up[max(p, q)] = min(p, q)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("name", ["op1_url_filter", "op5_warc"])
def test_same_rows_as_sql(spark, folder, name):
    df = queries.registered()[name](spark, folder)
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{folder}/pages.parquet'")
    cur = con.execute(queries.oracle()[name])
    names = [d[0] for d in cur.description]
    key = lambda r: tuple(map(repr, r))
    assert sorted((tuple(r) for r in df.select(*names).collect()), key=key) == sorted(cur.fetchall(), key=key)


def test_urls(spark):
    rows = [(1, "http://a.example.net/en/x?q#f"), (2, "HTTP://A.EXAMPLE.NET/EN/x"), (3, None), (4, "nothing"), (5, "x://b.org/fr/"), (5, "x://notorg/fr/"), (6, "http://example.com"), (7, "a://b://net/"), (8, "http://example.com/de/" + "z" * 100_000), (None, "http://net/"), (9, "http://" + "a." * 100_000 + "net/x"), (10, "http://.net/"), (11, "http://net./")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, rule string")
    got = {(r["page_id"], r["host"]): (r["path"][:8], r["rule"], r["verdict"]) for r in urlfilter.judge_urls(df, "page_id", "url", queries.RULES).collect()}
    assert got == {
        (1, "a.example.net"): ("/en/x", "example.net/en/", "allow"), (2, "a.example.net"): ("/EN/x", "net/", "block"), (3, ""): ("", None, "allow"), (4, ""): ("", None, "allow"),
        (5, "b.org"): ("/fr/", "org/fr/", "allow"), (5, "notorg"): ("/fr/", None, "allow"), (6, "example.com"): ("", None, "allow"), (7, "b:"): ("//net/", None, "allow"),
        (8, "example.com"): ("/de/zzzz", "example.com/de/", "block"), (None, "net"): ("/", "net/", "block"),
        (9, "a." * 100_000 + "net"): ("/x", "net/", "block"), (10, ".net"): ("/", "net/", "block"), (11, "net."): ("/", None, "allow"),
    }
    assert urlfilter.judge_urls(df, "page_id", "url", [], "block").filter("verdict = 'block'").count() == len(rows)
    assert urlfilter.judge_urls(df.limit(0), "page_id", "url", queries.RULES).count() == 0


def test_equal_digests_are_told_apart_by_their_strings(tmp_path, monkeypatch):
    monkeypatch.setattr(urlfilter.xxhash, "xxh64_intdigest", lambda b: len(b))
    path = tmp_path / "rules"
    path.write_bytes(urlfilter.digest_file([urlfilter.Rule(h, "/", "block") for h in ("aa", "bb", "cc")]))
    array = urlfilter.DigestArray(str(path))
    assert [array.stored(int(k)) if k >= 0 else None for k in array.find([b"bb\0/", b"dd\0/", b"aa\0/"])] == [b"bb\0/", None, b"aa\0/"]


def least_capacity(sizes, n):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, used, at = (low + high) // 2, 1, 0
        for s in sizes:
            used, at = (used + 1, s) if at + s > mid else (used, at + s)
        low, high = (low, mid) if used <= n else (mid + 1, high)
    return low


@pytest.mark.parametrize("seed", range(4))
def test_shards_are_minimax(spark, seed, monkeypatch):
    monkeypatch.setattr(shards, "BLOCKS", [4, 64, 1 << 16, 8][seed])
    r = random.Random(seed)
    rows = [(i, f"g{r.randint(0, 40):02d}" if r.random() < 0.7 else "g07", r.randint(1, 50)) for i in range(300)]
    layout = shards.minimax_shards(spark.createDataFrame(rows, "id long, g string, size long"), "id", F.col("g"), F.col("size"), 7)
    got = layout.rows.collect()
    totals = {}
    for _, g, s in rows:
        totals[g] = totals.get(g, 0) + s
    size = {k: sum(x["size"] for x in got if x["shard"] == k) for k in range(7)}
    assert max(size.values()) <= layout.capacity == least_capacity([totals[g] for g in sorted(totals)], 7)
    group = {i: g for i, g, _ in rows}
    assert len({(group[x["id"]], x["shard"]) for x in got}) == len(totals) and len(got) == 300
    for k in size:
        assert sorted(x["slot"] for x in got if x["shard"] == k) == list(range(sum(x["shard"] == k for x in got)))


def test_sharding_query(spark, folder):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = queries.op3_sharding(spark, folder).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    where = {}
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), None) and 0 <= r["shard"] < 24
        assert where.setdefault(raw, r["shard"]) == r["shard"]
    odd = spark.createDataFrame([(None, "a"), (None, "a"), (1, "b")], "id long, g string")
    assert shards.minimax_shards(odd, "id", F.col("g"), F.lit(1), 24).rows.count() == 3
    assert shards.minimax_shards(odd.limit(0), "id", F.col("g"), F.lit(1), 24).rows.count() == 0


def test_archives_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 3000)
    rows = [(1, "u\r\nX: 1", "x" * 1000), (2, None, "x" * 1000), (3, "c", "x" * 999), (4, "d", "x" * 999), (5, "e", None), (6, "f", ""), (7, "g", "é" * 500), (9, "h", "é" * 500), (9, "h", "é" * 500), (10, "i", "WARC/1.1\r\n\r\n" * 900)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(2)
    index = warc.write_archives(df, "page_id", "url", "html")
    got = sorted(((r["id"], r["kind"], r["refers_to"], r["payload_bytes"], r["payload_digest"], bytes(r["payload"]).decode() if r["payload"] is not None else None) for r in warc.read_archives(index).collect()), key=repr)
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        first = {1: 2, 7: 9}.get(i)
        want.append((i, "revisit" if first else "response", first, len(raw), hashlib.sha1(raw).hexdigest(), None if first else html or ""))
    assert got == sorted(want, key=repr)
    assert warc.read_archives(warc.write_archives(df.limit(0), "page_id", "url", "html")).count() == 0


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_jaccard(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    linked = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if x and y and 100 * len(x & y) >= 80 * len(x | y)]
    root = groups([i for i, _ in rows], linked)
    return sorted((i, len(s), root[i]) for i, s in sets)


def near_texts(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    base = [[r.choice(words) for _ in range(r.choice([3, 5, 8, 9, 12, 30, 60, 120]))] for _ in range(10)]
    rows = [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "a"), (1004, "A"), (1005, "a b c"), (1006, "a b d")]
    for i in range(350):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
            k = r.randrange(len(w))
            w[k : k + r.randint(0, 1)] = [] if r.random() < 0.3 and len(w) > 1 else [r.choice(words) + str(r.randrange(50))]
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("config", [jaccard.JaccardConfig(), jaccard.JaccardConfig(long_list=4, count_bits=12)])
def test_jaccard_loses_no_link(spark, config):
    rows = near_texts(3)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_shingles int").repartition(3)
    assert sorted(tuple(r) for r in jaccard.jaccard_groups(df, "doc_id", "text", config).collect()) == brute_jaccard(rows)


def test_jaccard_query_and_odd_rows(spark, folder):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op7_jaccard(spark, folder).collect()) == brute_jaccard(docs)
    long = " ".join(f"v{i}" for i in range(30_000))
    odd = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (None, "a b c d e f"), (5, long), (4, long + " end"), (None, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in jaccard.jaccard_groups(odd, "doc_id", "text").collect()), key=repr)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (2, 2, 1), (None, 2, 1), (5, 29_996, 4), (4, 29_997, 4), (None, 0, None)], key=repr)
    assert sorted((r["doc_id"] for r in jaccard.one_of_each(odd, "doc_id", "text").collect()), key=repr) == sorted([1, 4, None, None], key=repr)
    assert jaccard.jaccard_groups(odd.limit(0), "doc_id", "text").count() == 0


def test_vectors(spark):
    r = np.random.default_rng(0)
    base = r.normal(size=(20, 8))
    rows = [(7, None), (8, [0.0] * 8), (9, [float("nan")] * 8), (10, [1.0, None]), (11, []), (12, [1.0, 2.0]), (13, [2.0, 4.0]), (14, [1e300, 2e300])]
    rows += [(100 + i, [float(x) for x in base[r.integers(20)] + r.normal(size=8) * r.choice([0, 0.1, 0.3])]) for i in range(250)]
    unit = {i: neardup_vectors.unit_rows([v])[0][0] if v and neardup_vectors.unit_rows([v])[1][0] else None for i, v in rows}
    linked = [(a, b) for a in unit for b in unit if a < b and unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9]
    root = groups(list(unit), linked)
    want = sorted((i, sum(i in p for p in linked), root[i], root[i] == i) for i in unit)
    df = spark.createDataFrame([(*x, "x") for x in rows], "vec_id long, embedding array<double>, kept string")
    exact = neardup_vectors.CellConfig(block=16, rows_per_cell=20, probes=None)
    assert sorted(tuple(x) for x in neardup_vectors.near_vectors(df, "vec_id", "embedding", exact).collect()) == want
    assert sorted(tuple(x) for x in neardup_vectors.near_vectors(df, "vec_id", "embedding").collect()) == want
    found = neardup_vectors.near_vectors(df, "vec_id", "embedding", neardup_vectors.CellConfig(block=16, rows_per_cell=20, probes=3)).collect()
    assert 0.9 * sum(x[1] for x in want) <= sum(x["n_links"] for x in found) <= sum(x[1] for x in want)  # the lossy option
    assert neardup_vectors.near_vectors(df.limit(0), "vec_id", "embedding").count() == 0


def test_vectors_that_share_an_id_or_have_none(spark):
    rows = [(2, [0.0, 1.0]), (2, [1.0, 0.01]), (5, [1.0, 0.0]), (6, [1.0, 0.0]), (None, [1.0, 0.0]), (None, [-1.0, 0.0]), (None, None), (9, [-1.0, 0.0]), (9, [-1.0, 0.0]), (None, [0.0, -1.0])]
    df = spark.createDataFrame([(*x, i) for i, x in enumerate(rows)], "vec_id long, embedding array<float>, copies int")
    want = [(2, 0, 2, True), (2, 3, 2, True), (5, 3, 2, False), (6, 3, 2, False), (None, 3, 2, False), (None, 2, 9, False), (None, 0, None, True), (9, 2, 9, True), (9, 2, 9, True), (None, 0, None, True)]
    for config in (neardup_vectors.CellConfig(), neardup_vectors.CellConfig(block=2, rows_per_cell=2)):
        assert sorted(map(repr, map(tuple, neardup_vectors.near_vectors(df, "vec_id", "embedding", config).collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("size", [1, 2, 5, 32])
def test_every_block_pair_is_met_once(size):
    pairs = neardup_vectors._Pairs("file:///nowhere", 1, size, *[np.zeros(0)] * 4, neardup_vectors.CellConfig())
    met = []
    pairs.cells = lambda block: block
    pairs.apart = lambda a, b: met.append((min(a, b), max(a, b))) or True
    for low in range(size):
        for begin in range(0, size // 2 + 1, neardup_vectors.STRIP):
            list(pairs.strip(low, begin))
    assert sorted(met) == [(a, b) for a in range(size) for b in range(a, size)]


def test_vector_query_recall(spark):
    folder = "/root/testdata/sf0.1"
    x, _ = neardup_vectors.unit_rows([r["embedding"] for r in spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()])
    links = int((x @ x.T >= 0.9).sum()) - len(x)
    assert sum(r["n_links"] for r in queries.op9_vectors(spark, folder).collect()) == links


def test_vector_query_finds_every_planted_pair(spark, tmp_path):
    r = np.random.default_rng(5)
    a, b = r.normal(size=(2, 20_000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    cos = r.uniform(0.9005, 0.92, size=(len(a), 1))
    x = np.concatenate([a, cos * a + np.sqrt(1 - cos**2) * b])
    at = r.permutation(len(x))  # the first of the vectors has number at[0]
    kind = pa.list_(pa.float64())
    pq.write_table(pa.table({"vec_id": at, "embedding": pa.array(list(x), kind)}), tmp_path / "embeddings.parquet")
    got = {v["vec_id"]: tuple(v)[1:] for v in queries.op9_vectors(spark, str(tmp_path)).collect()}
    want = {}
    for p, q in at.reshape(2, -1).T.tolist():
        want[p], want[q] = ((1, min(p, q), k == min(p, q)) for k in (p, q))
    assert got == want


@pytest.mark.parametrize("case", ["no label", "null labels", "labels of the held-out fold", "one class", "labels of unknown documents"])
def test_no_document_is_toxic_where_nothing_is_learned(spark, folder, tmp_path, case):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    rows = {
        "no label": labels.limit(0),
        "null labels": labels.withColumn("toxic", F.lit(None).cast("int")),
        "labels of the held-out fold": labels.filter(queries.fold(4) == 2),
        "one class": labels.withColumn("toxic", F.lit(1)),
        "labels of unknown documents": labels.withColumn("doc_id", -1 - F.col("doc_id")).withColumn("toxic", (F.col("doc_id") % 2 == 0).cast("int")),
    }[case]
    rows.write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, docs.collect()))
    found = queries.op10_toxicity(spark, str(tmp_path)).collect()
    assert len(found) == docs.count() and all(r["predicted"] == (r["score"] >= 0.3) == 0 for r in found)


@pytest.mark.parametrize("lang", ["cast(null as string)", "if(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, 'en', null)"])
def test_only_texts_without_a_letter_go_where_no_language_is_learned(spark, folder, lang):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("lang", F.expr(lang))
    odd = docs.limit(4).withColumn("text", F.element_at(F.array(F.lit("12 ??"), F.lit(""), F.lit(None), F.lit("é 1")), (F.row_number().over(Window.orderBy("doc_id"))).cast("int")))
    every = docs.unionByName(odd)
    kept = corpus_pipeline.keep_languages(spark, every, folder)
    want = [r for r in every.collect() if any(c.isalpha() for c in r["text"] or "")]
    assert len(want) > docs.count() and sorted(map(repr, kept.collect())) == sorted(map(repr, want))


def test_pipeline_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "language", "jaccard", "decontamination", "sentencepiece"]
    left = {r["doc_id"] for r in docs.collect()}
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, folder)
        assert now.columns == docs.columns
        kept = {r["doc_id"] for r in now.select("doc_id").collect()}
        assert kept <= left
        if name == "jaccard":
            want = brute_jaccard([(r["doc_id"], r["text"]) for r in docs.filter(F.col("doc_id").isin(sorted(left))).collect()])
            assert kept == {c for _, _, c in want}
        left = kept
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()} == left
    assert {r["doc_id"] for r in queries.op2_decontamination(spark, folder).filter("contaminated").collect()}.isdisjoint(left)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0


def covered(text, items, window=13):
    """Words of a text, and how many of them lie in a window of the benchmark."""
    w = fmindex.words_of(text)
    hit = [0] * len(w)
    for n, known in items.items():
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in known:
                hit[i : i + n] = [1] * n
    return len(w), sum(hit)


def test_pipeline_stages_keep_exactly_the_rows_of_a_plain_version(spark, folder):
    now = spark.read.parquet(f"{folder}/documents.parquet")
    model = queries.toxicity_model(spark, folder)
    windows = {}
    for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        v = fmindex.words_of(r["text"])
        n = min(13, len(v))
        windows.setdefault(n, set()).update(tuple(v[i : i + n]) for i in range(len(v) - n + 1) if n)
    windows.pop(0, None)

    def clean(text):
        n, hit = covered(text, windows)
        return not (hit > 0 and 20 * hit >= n)

    def first_of_each(rows):
        first = {c for _, _, c in brute_jaccard([(r["doc_id"], r["text"]) for r in rows])}
        return [r for r in rows if r["doc_id"] in first]

    plain = {
        "toxicity": lambda rows: [r for r in rows if model.score([r["text"]])[0] < queries.TOXICITY.threshold],
        "language": lambda rows: [r for r in rows if any(c.isalpha() for c in r["text"] or "")],
        "jaccard": first_of_each,
        "decontamination": lambda rows: [r for r in rows if clean(r["text"])],
    }
    counts = [now.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = now.collect()
        now = written(stage(spark, now, folder), name)
        assert sorted(map(repr, now.collect())) == sorted(map(repr, plain[name](rows))), name
        counts.append(now.count())
    assert counts[-1] > 0
    library = pieces.PieceEncoder(public_tokenizers.path("piece_bpe_32k.model")).library
    got = {r["doc_id"]: r for r in corpus_pipeline.encode(spark, now, folder).collect()}
    rows = now.collect()
    assert sorted(got) == sorted(r["doc_id"] for r in rows)
    for r in rows:
        text = r["text"] or ""
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert got[r["doc_id"]]["n_tokens"] == len(ids) and np.frombuffer(got[r["doc_id"]]["ids"], "<u4").tolist() == ids
        if "▁" not in text:  # else a piece does not tell blanks from this sign
            ends = np.cumsum([1 if library.is_byte(i) else len(library.id_to_piece(i).replace("▁", " ").encode()) for i in ids[1:-1]])
            ends = np.maximum(ends - 1, 0).tolist()  # the blank put in front
            assert list(got[r["doc_id"]]["begins"]) == [0, *([0] + ends)[:-1][: len(ends)], *ends[-1:]] and list(got[r["doc_id"]]["ends"]) == [0, *ends, *ends[-1:]]
