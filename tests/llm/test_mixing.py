"""Curriculum, conversation repair and tokenizer alignment against SQL and brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from pricemesh.llm import alignment, conversations, curriculum, jaccard, pieces, planes, queries
from pricemesh.llm.common import span_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---------------------------------------------------------------- curriculum

def test_mix_equals_sql(spark, folder):
    df = queries.op11_curriculum(spark, folder)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    cur = con.execute(queries.oracle()["op11_curriculum"])
    names = [d[0] for d in cur.description]
    key = lambda r: tuple(map(repr, r))
    got = sorted((tuple(r) for r in df.select(*names).collect()), key=key)
    assert got == sorted(cur.fetchall(), key=key)
    again = sorted((tuple(r) for r in queries.op11_curriculum(spark, folder).select(*names).collect()), key=key)
    assert again == got


def plain_targets(sizes, weights, share=1.5, repeats=2):
    """Shares by weight, stopped at the most repeats, the excess shared again."""
    total, full = sum(sizes), set()
    while True:
        held = sum(repeats * sizes[k] for k in full)
        left = sum(w for k, w in enumerate(weights) if k not in full)
        level = (share * total - held) / left if left else 0
        more = {k for k, w in enumerate(weights) if k not in full and w * level > repeats * sizes[k]}
        if not more:
            return [repeats * s if k in full else w * level for k, (s, w) in enumerate(zip(sizes, weights))]
        full |= more


def area(knots, t):
    total = 0
    for (a, v), (b, w) in zip(knots, knots[1:]):
        end = min(b, t)
        if end > a:
            total += (end - a) * (v + v + (w - v) * (end - a) / (b - a)) / 2
    return total


ODD = [(0.0, 0.0), (0.25, 4.0), (0.5, 0.0), (0.75, 0.0), (1.0, 2.0)]


@pytest.mark.parametrize("seed", range(3))
def test_mix_of_odd_rows(spark, seed):
    r = random.Random(seed)
    rows = [(None, None, "a b"), (None, None, "a b"), (1, "s", None), (1, "s", ""), (2, "s", " \t"), (3, "z", "w " * 30_000), (3, "z", "w " * 30_000), (4, "é", "a b c"), (5, "", "x y z")]
    rows += [(10 + i, r.choice(["s", "z", "hot", "hot", "hot", None]), "w " * r.choice([0, 1, 5, 200])) for i in range(200)]
    df = spark.createDataFrame([(*x, 1, "x") for x in rows], "id long, source string, text string, size int, key string").repartition(3)
    config = curriculum.MixConfig(schedules=(ODD, ((0.0, 1.0), (1.0, 1.0))), share=[1.5, 0.3, 2.0][seed])
    out = curriculum.mix(df, "id", "source", "text", config)
    got = out.collect()
    size = lambda t: len(WORD.findall(t or ""))
    assert sorted((repr(x["id"]), repr(x["source"]), x["size"]) for x in got) == sorted((repr(i), repr(s), size(t)) for i, s, t in rows)
    names = sorted({s for _, s, _ in rows if s is not None}) + [None]
    sizes = [sum(size(t) for _, s, t in rows if s == n) for n in names]
    schedules = [config.schedules[k % 2] for k in range(len(names))]
    targets = plain_targets(sizes, [area(k, 1) for k in schedules], config.share)
    place = -1.0
    for x in got:
        k = names.index(x["source"])
        assert x["source_size"] == sizes[k] and x["target"] == pytest.approx(targets[k], rel=1e-12)
        assert x["taken"] == sum(p["words"] for p in x["placements"]) <= 2 * x["size"]
        assert (x["position"] is None) == (x["taken"] == 0)
        place, before = (x["position"] if x["position"] is not None else -1.0), place
        assert place >= before
    for k, n in enumerate(names):
        mine = [x for x in got if x["source"] == n]
        assert sum(x["taken"] for x in mine) == min(round(targets[k]), 2 * sizes[k])
        # Words due before each placement are the words that the schedule has run up by then.
        due = 0
        for p in sorted((p for x in mine for p in x["placements"]), key=lambda p: p["position"]):
            goal = min(round(targets[k]), 2 * sizes[k])
            assert area(schedules[k], p["position"]) / area(schedules[k], 1) * goal == pytest.approx(due, abs=1e-6 * goal)
            due += p["words"]
    order = [x["position"] for x in curriculum.training_order(out, "id").collect()]
    assert order == sorted(order) and len(order) == sum(len(x["placements"]) for x in got)


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, source string, text string")
    assert curriculum.mix(df, "doc_id", "source", "text").collect() == []
    empty = spark.createDataFrame([(1, "a", None), (2, None, " ")], df.schema)
    assert [(r["target"], r["taken"], r["position"]) for r in curriculum.mix(empty, "doc_id", "source", "text").collect()] == [(0.0, 0, None)] * 2
    for bad in ({"share": 3.0}, {"schedules": ()}, {"schedules": (((0.0, 0.0), (1.0, 0.0)),)}, {"schedules": (((0.0, 1.0), (0.5, 1.0)),)}):
        with pytest.raises(ValueError):
            curriculum.mix(df, "doc_id", "source", "text", curriculum.MixConfig(**bad))


# ---------------------------------------------------------------- conversations

def every_repair(codes):
    """The least (cost, audit) of all edit sequences."""
    best = [3 * len(codes), "D" * len(codes)]

    def go(j, roles, audit, cost):
        if cost > best[0] or not re.fullmatch(r"s?(ua)*u?", roles):
            return
        if j == len(codes) and re.fullmatch(r"(s?(ua)+)?", roles):
            best[:] = min(best, [cost, audit])
        if j < len(codes):
            c, more = codes[j], codes[j].isupper()
            go(j + 1, roles, audit + "D", cost + 3)
            if c != "d":
                go(j + 1, roles + c.lower(), audit + "K", cost + more)
                for x in "ua":
                    go(j + 1, roles + x, audit + "R", cost + 2 + more)
        for x in "ua":
            go(j, roles + x, audit + "I", cost + 2)

    go(0, "", "", 0)
    return tuple(best)


def test_agenda_finds_the_least_repair():
    for n in range(4):
        for codes in itertools.product("suaxSUd", repeat=n):
            assert conversations.repair("".join(codes)) == every_repair("".join(codes))
    r = random.Random(0)
    for _ in range(300):
        codes = "".join(r.choice("suaxSUAXd") for _ in range(r.randint(4, 7)))
        assert conversations.repair(codes) == every_repair(codes)


def test_stretches_join_to_the_whole():
    r = random.Random(1)
    for _ in range(200):
        codes = "".join(r.choice("suaxSUAXd") for _ in range(r.randint(0, 40)))
        a, b = sorted(r.randint(0, len(codes)) for _ in range(2))
        parts = [conversations._stretch(c) for c in (codes[:a], codes[a:b], codes[b:])]
        assert conversations._goal(conversations.join_spans(parts[0], conversations.join_spans(*parts[1:]))) == conversations.repair(codes)
    assert conversations.repair("ua" * 400)[0] == 0 and conversations.repair("ua" * 200 + "d" + "u" * 300) == (3 + 2 * 150, "K" * 400 + "D" + "KR" * 150)


def plain_conversations(rows):
    """The contract in plain Python: {conv: (gaps, blank, duplicate, truncated, illegal, cost, audit, digest)}."""
    talks = {}
    space = lambda v: " " if v is None else str(v)
    for conv, turn, role, text in rows:
        now = talks.setdefault(conv, [])
        role, text = space(role), space(text)
        k = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        now += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    out = {}
    for conv, now in talks.items():
        message = lambda x: hashlib.sha256(f"{len(x[1])}:{x[1]}:{x[2]}".encode()).digest()
        now.sort(key=lambda x: (x[0] is not None, x[0] or 0, message(x)))
        seen, counts, codes = set(), [0, 0, 0], ""
        for _, role, text in now:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            code = role[:1] if role[:1] in ("s", "u", "a") else "x"
            codes += "d" if fault in (0, 1) else code.upper() if fault == 2 else code
        turns = [t for t, _, _ in now if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(now, now[1:]))
        cost, audit = conversations.repair(codes)
        lines = "\n".join(f"{role}:{text}" for role, text, _ in conversations.repaired(audit, iter([x[1:] for x in now])))
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest())
    return out


def test_conversation_query(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r)[1:] for r in queries.op12_conversations(spark, folder).collect()}
    assert got == plain_conversations(rows)


@pytest.mark.parametrize("seed", range(2))
def test_conversations_of_odd_rows(spark, seed):
    r = random.Random(seed)
    texts = [None, "", " \t", "Yes.", "No", "Why? ", "é…", "z" * 50_000 + "!", "Yes."]
    rows = [(r.choice([None, 1, 2, 3, 4, 5, 6]), r.choice([None, *range(12)]), r.choice(["user", "assistant", "system", "tool", None, ""]), r.choice(texts)) for _ in range(250)]
    rows += [(7, t, "user" if t % 2 == 0 else "assistant", f"m{t % 700}.") for t in range(900)]  # one conversation over many stretches and partitions
    rows += [(8, 5, "user", "same.")] * 40 + [(100 + i, 0, "user", "x.") for i in range(60)]
    df = spark.createDataFrame([(*x, "x") for x in rows], "conv_id long, turn long, role string, text string, audit string").repartition(3)
    damaged = conversations.damage(df, "conv_id", "turn", "role", "text")
    want = plain_conversations(rows)
    repairs = conversations.summarise(damaged)
    got = {x["conv_id"]: tuple(x)[1:] for x in repairs.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit").collect()}
    assert got == {k: v[:-1] for k, v in want.items()}
    digests = {x["conv_id"]: x["repaired_sha256"] for x in conversations.transcripts(damaged, repairs).collect()}
    assert digests == {k: v[-1] for k, v in want.items()}
    lines = {}
    for x in conversations.repaired_messages(damaged, repairs).orderBy("conv_id", "place").collect():
        lines.setdefault(x["conv_id"], []).append(f"{x['role']}:{x['text']}")
        assert (x["edit"] == "I") <= (x["text"] == "")
    for k, v in want.items():
        assert hashlib.sha256("\n".join(lines.get(k, [])).encode()).hexdigest() == v[-1]
    assert conversations.summarise(damaged.limit(0)).collect() == []
    assert conversations.transcripts(damaged.limit(0), conversations.summarise(damaged.limit(0))).collect() == []


# ---------------------------------------------------------------- alignment

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain_alignment(texts):
    """The contract in plain Python: rows (n_a, n_b, n_groups, n_links, n_best, count_sum, groups)."""
    a_coder = Tokenizer.from_file(A_PATH)
    a_coder.encode_special_tokens = True
    b_coder = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    byte_of = alignment.BYTE_OF
    rows, links = [], []
    for t in texts:
        ids_a = a_coder.encode(" " + t, add_special_tokens=False).ids if t else []
        ids_b = b_coder.encode(t) if t else []
        bytes_a = [bytes(byte_of[c] for c in a_coder.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if b_coder.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b_coder.id_to_piece(i)) for i in ids_b)]
        if not t or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + t).encode():
            rows.append((0, 0, 0, ""))
            links.append([])
            continue
        ends_a, ends_b = (list(itertools.accumulate(map(len, x))) for x in (bytes_a, bytes_b))
        both = sorted(set(ends_a) & set(ends_b))
        links.append([(ids_a[ends_a.index(e)], ids_b[ends_b.index(e)]) for e in both])
        groups, i, j = [], 0, 0
        for e in both:
            x, y = i, j
            i, j = ends_a.index(e) + 1, ends_b.index(e) + 1
            groups.append(",".join(map(str, ids_a[x:i])) + "|" + ",".join(map(str, ids_b[y:j])))
        rows.append((len(ids_a), len(ids_b), len(groups), ";".join(groups)))
    counts = Counter(p for x in links for p in x)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return [(a, b, g, len(x), sum(counts[p] == best[p[1]] for p in x), sum(counts[p] for p in x), s) for (a, b, g, s), x in zip(rows, links)]


def test_alignment_query(spark, folder):
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted((i, *r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[0] else "") for (i, _), r in zip(docs, plain_alignment([t for _, t in docs])))
    assert sorted(map(tuple, queries.op13_alignment(spark, folder).collect())) == want


THUE = ["a"]
for _ in range(10):
    THUE.append(THUE[-1] + THUE[-1].translate({97: 98, 98: 97}))
TWINS = (THUE[-1], THUE[-1].translate({97: 98, 98: 97}))  # words with equal polynomial hashes
ODD_TEXTS = [
    None, "", " ", "a", "  two  blanks ", "tab\there\nline\r\n", "meta ▁ symbol", "<|endoftext|> <s> </s> <unk> <0x41>", "é́ ½ ² Ⅷ 〇 日本語 テキスト", "no break space 　 x  y \u0085 z",
    "don't we'll I'M 1234 12.5e-3", "emoji 👩‍👩‍👧 ok", "nul \x00 byte \x1c sep \x7f del", " ".join(TWINS), TWINS[0], TWINS[1], "aa" * 30_000, "x " * 40_000, "same text", "same text", "Ça va? «Oui», d'accord…", "﻿bom", " private",
]


@pytest.mark.parametrize("pairs", [alignment.SLICE_PAIRS, 400])
def test_alignment_of_odd_rows(spark, pairs, monkeypatch):
    r = random.Random(2)
    texts = ODD_TEXTS + ["".join(r.choice("ab c.é ▁\n '日") for _ in range(r.randint(1, 60))) for _ in range(150)]
    rows = [(r.choice([None, k, 3]), t) for k, t in enumerate(texts)]
    df = spark.createDataFrame([(*x, 1, "x") for x in rows], "part long, text string, n int, codes string").repartition(3)
    out = alignment.align_tokens(df, "part", "text", A_PATH, B_PATH, slice_pairs=pairs)
    got = sorted((tuple(x)[:7] + (x["groups"], x["groups_sha256"]) for x in out.collect()), key=repr)
    want = sorted(((i, *x, hashlib.sha256(x[-1].encode()).hexdigest() if x[0] else "") for (i, _), x in zip(rows, plain_alignment(texts))), key=repr)
    assert got == want
    assert alignment.align_tokens(df.limit(0), "part", "text", A_PATH, B_PATH).count() == 0


def test_overlapping_tokens_expand_within_their_group():
    a_starts, a_ends, b_starts, b_ends = (np.array(x) for x in ([0, 2, 5], [2, 5, 6], [0, 3, 5], [3, 5, 6]))
    assert list(zip(*map(list, alignment.overlaps(a_starts, a_ends, b_starts, b_ends)))) == [(0, 0), (1, 0), (1, 1), (2, 2)]
    order, group = alignment.coalesce(np.concatenate([a_starts, b_starts]), np.concatenate([a_ends, b_ends]), np.repeat([0, 1], 3))
    assert order.tolist() == [0, 3, 1, 4, 2, 5] and group.tolist() == [0, 0, 0, 0, 1, 1]


# ---------------------------------------------------------------- words with equal hashes

def test_equal_hashes_do_not_mix_words(spark):
    data = np.frombuffer(" ".join(TWINS).encode(), dtype=np.uint8)
    begin, end = np.array([0, len(TWINS[0]) + 1]), np.array([len(TWINS[0]), len(data)])
    assert len(set(span_hashes(data, begin, end).tolist())) == 1  # else this test tests nothing
    library = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    coder = pieces.PieceEncoder(B_PATH, cached=1 << 12)
    word = planes.WordEncoder(public_tokenizers.path("word_bpe_49k.json"), cached=1 << 12)
    for texts in ([" ".join(TWINS)], list(TWINS), [TWINS[1]], [TWINS[0]], ["q" + str(k) for k in range(3000)], [TWINS[1], "x", TWINS[0]]):
        assert [f[0].tolist() for f in coder.encode(texts)] == library.encode(texts, add_bos=True, add_eos=True)
        assert [f.tolist() for f in word.encode(texts)] == [word.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        for k in (0, 1):
            assert all((x[0] == y[0]).all() for x, y in zip(coder.encode(texts, spans=False), coder.encode(texts)))
    sets = jaccard.shingle_sets([TWINS[0], TWINS[1], " ".join(TWINS)])
    assert sets[0].tolist() != sets[1].tolist()
    df = spark.createDataFrame([(1, TWINS[0]), (2, TWINS[1]), (3, TWINS[0])], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.jaccard_groups(df, "doc_id", "text").collect())) == [(1, 1, 1), (2, 1, 2), (3, 1, 1)]


def test_second_lanes_tell_shingles_apart():
    u, v = (np.array(x, dtype=np.uint64) for x in ([[5, 1], [5, 2], [7, 7]], [[5, 2], [5, 3], [7, 7]]))
    assert jaccard.common(u, v) == 2 and jaccard._sorted(np.concatenate([v, u])).tolist() == [[5, 1], [5, 2], [5, 3], [7, 7]]
