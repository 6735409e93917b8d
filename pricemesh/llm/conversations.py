"""Repair of conversation structure by a lightest-derivation agenda.

Roles must read ``(system? (user assistant)+)?``.  Faulty rows and wrong orders are
mended by edits with costs: keep a row, change its role, delete it, insert an empty
one.  The cheapest repair is the lightest derivation in a weighted hypergraph:

* an edit item (row or gap, state before, state after) has its cost as an axiom;
* a prefix item (state at the start, rows done, state now) follows from a shorter
  prefix and an edit, its weight being (cost, audit): costs add up, audits join;
* a span item of neighbouring stretches follows from the span items of both.

The agenda pops items by (cost, rows done, audit).  A derived item never precedes
its antecedents there, as it costs more or ends later, so every item is final when
it is first popped.  Of one item's derivations at one cost no audit continues
another (they have one letter per row, and each insertion more would cost more), so
the lesser audit stays the lesser whatever follows: the weights are monotone.

How it scales: rows without their texts are range-sorted by (conversation, turn);
a conversation that spans partitions is solved stretch by stretch and its span items
are joined in a tree.  Texts are shuffled once, to the audits that say what becomes
of them, and stream past: no conversation is ever held in memory.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricemesh.llm.common import partitions, written

# States: nothing yet, after a system row, after a user row, after a whole exchange.
START, SYSTEM, USER, DONE = range(4)
MOVES = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": DONE}, DONE: {"u": USER}}
GOALS = (START, DONE)
NAMES = {"u": "user", "a": "assistant"}
DELETE, RELABEL, INSERT, CUT = 3, 2, 2, 1  # costs; CUT is added where a truncated row stays
STRETCH = 256                              # rows solved by one agenda
FAN_IN = 32                                # neighbouring stretches joined per round
WHITE = " \t\n\x0b\x0c\r"

Spans = dict[tuple[int, int], tuple[int, str]]


def edits_of(code: str) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, letter) of all edits of one row.

    Its code is the first letter of its role, a capital where the text is cut
    short, ``x`` for other roles and ``d`` for rows that must go.
    """
    out = [(q, q, DELETE, "D") for q in MOVES]
    if code != "d":
        extra = CUT if code.isupper() else 0
        for q, moves in MOVES.items():
            for letter, r in moves.items():
                if letter == code.lower():
                    out.append((q, r, extra, "K"))
                elif letter in NAMES:
                    out.append((q, r, RELABEL + extra, "R"))
    return out


INSERTIONS = [(q, r, INSERT, "I") for q, moves in MOVES.items() for letter, r in moves.items() if letter in NAMES]


def solve(codes: str, starts: tuple[int, ...]) -> Spans:
    """Lightest (cost, audit) of every span item (state at the start, state at the end) over all rows of ``codes``."""
    n = len(codes)
    agenda: list[tuple] = [(0, 0, "", q, q) for q in starts]
    for j in range(n + 1):
        # Axioms end nowhere (-1), so they are final before any prefix of their cost.
        agenda += [(c, -1, letter, j, j, q, r) for q, r, c, letter in INSERTIONS]
        if j < n:
            agenda += [(c, -1, letter, j, j + 1, q, r) for q, r, c, letter in edits_of(codes[j])]
    heapq.heapify(agenda)
    final: dict[tuple[int, int], dict[int, tuple[int, str]]] = defaultdict(dict)
    edits: dict[tuple[int, int], list[tuple]] = defaultdict(list)
    goal: Spans = {}
    while agenda:
        item = heapq.heappop(agenda)
        if len(item) == 7:
            cost, _, letter, j, end, q, r = item
            edits[j, q].append((end, r, cost, letter))
            for start, (c, audit) in final[j, q].items():
                heapq.heappush(agenda, (c + cost, end, audit + letter, start, r))
            continue
        cost, j, audit, start, q = item
        if start in final[j, q]:
            continue
        final[j, q][start] = (cost, audit)
        if j == n:
            goal[start, q] = (cost, audit)
            if len(starts) == 1 and q in GOALS:  # the goal item of a whole conversation
                break
        for end, r, c, letter in edits[j, q]:
            heapq.heappush(agenda, (cost + c, end, audit + letter, start, r))
    return goal


def join_spans(left: Spans, right: Spans) -> Spans:
    """Lightest span items over two neighbouring stretches."""
    out: Spans = {}
    for (q, r), (c, a) in left.items():
        for (s, t), (d, b) in right.items():
            if r == s and ((q, t) not in out or (c + d, a + b) < out[q, t]):
                out[q, t] = (c + d, a + b)
    return out


@lru_cache(maxsize=20_000)
def _whole(codes: str) -> tuple[int, str]:
    return min(w for (_, q), w in solve(codes, (START,)).items() if q in GOALS)


@lru_cache(maxsize=200)
def _stretch(codes: str) -> Spans:
    return solve(codes, tuple(MOVES))


def repair(codes: str) -> tuple[int, str]:
    """Cost and audit of the cheapest repair, the least audit among equals."""
    if len(codes) <= STRETCH:
        return _whole(codes)
    return _goal(_solved(codes))


def _solved(codes: str) -> Spans:
    found = [_stretch(codes[k : k + STRETCH]) for k in range(0, len(codes), STRETCH)] or [_stretch("")]
    while len(found) > 1:
        found = [join_spans(*found[k : k + 2]) if k + 1 < len(found) else found[k] for k in range(0, len(found), 2)]
    return found[0]


def _goal(spans: Spans) -> tuple[int, str]:
    return min(w for (p, q), w in spans.items() if p == START and q in GOALS)


def repaired(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(role, text, edit) of every row that the repaired conversation has; ``rows`` are the (role, text) before."""
    state = START
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit == "K":
            letter = role[:1]
        else:
            letter = "a" if state == USER else "u"
            role = NAMES[letter]
        state = MOVES[state][letter]
        yield role, text, edit


# ---------------------------------------------------------------- tables

def damage(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, kinds: int = 20) -> DataFrame:
    """conv_id, turn, role, text and copies of every row after a reproducible damage.

    By crc32 of ``conv:turn`` modulo ``kinds``: 0 drops the row (copies 0), 1 empties
    its text, 2 takes out its full stops, exclamation and question marks, 3 repeats it
    (copies 2), 4 makes it the user's.  Null roles, texts and parts of the key are one
    space; a null turn stays null in ``turn``.
    """
    part = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    key = F.crc32(F.concat(part(conv_col), F.lit(":"), part(turn_col)).cast("binary")) % kinds
    text = F.when(key == 1, "").when(key == 2, F.regexp_replace(part(text_col), "[.!?]", "")).otherwise(part(text_col))
    return df.select(
        F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
        F.when(key == 4, "user").otherwise(part(role_col)).alias("role"), text.alias("text"),
        F.when(key == 0, 0).when(key == 3, 2).otherwise(1).alias("copies"),
    )


def _message() -> Column:
    """Digest of role and text, told apart by the role's length."""
    return F.unhex(F.sha2(F.concat_ws(":", F.length("role"), F.col("role"), F.col("text")).cast("binary"), 256))


def _marked(rows: DataFrame) -> DataFrame:
    """One small line per (conversation, turn, message): what the agenda has to know, without the text."""
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    small = rows.select(
        "conv_id", "turn", _message().alias("message"), F.substring("role", 1, 1).alias("initial"), "copies",
        (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"),
    )
    lines = small.groupBy("conv_id", "turn", "message").agg(F.sum("copies").alias("copies"), F.first("initial").alias("initial"), F.first("blank").alias("blank"), F.first("cut").alias("cut"))
    lines = written(lines, "talk-lines")
    # The first turn of a message; nulls come first, and dropped rows were never seen.
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))
    first = lines.filter("copies > 0").groupBy("conv_id", "message").agg(F.min(turn).alias("first"), F.count("*").alias("n")).filter("n > 1").select(F.col("conv_id").alias("c"), F.col("message").alias("m"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("message") == F.col("m"))
    again = F.col("first").isNotNull() & (turn > F.col("first"))
    return lines.join(first, same, "left").select("conv_id", "turn", "message", "copies", "initial", "blank", "cut", again.alias("again"))


FOUND = "part int, whole boolean, n long, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long, codes string, spans array<struct<q:int,r:int,cost:long,audit:string>>"
SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
PAIRS = {"su", "ua", "au"}


class _Stretch:
    """What neighbouring stretches of a conversation have to know of each other."""

    def __init__(self, n=0, blank=0, duplicate=0, truncated=0, illegal=0, first=None, last=None, low=None, high=None, turns=0, codes="", spans=None):
        self.n, self.blank, self.duplicate, self.truncated, self.illegal = n, blank, duplicate, truncated, illegal
        self.first, self.last, self.low, self.high, self.turns = first, last, low, high, turns
        self.codes, self.spans = codes, spans

    def add(self, line: dict, codes: list[str]) -> None:
        n, initial = line["copies"], line["initial"]
        if not n:
            return
        if self.n:
            self.illegal += self.last + initial not in PAIRS
        self.illegal += n - 1
        self.first, self.last = initial if self.first is None else self.first, initial
        if line["turn"] is not None:
            self.turns += line["turn"] != self.high
            self.low, self.high = line["turn"] if self.low is None else self.low, line["turn"]
        self.n += n
        fresh = not line["blank"] and not line["again"]
        self.blank += n if line["blank"] else 0
        self.duplicate += 0 if line["blank"] else n - fresh
        self.truncated += fresh and line["cut"]
        code = initial if initial in ("s", "u", "a") else "x"
        codes.append((code.upper() if line["cut"] else code) + "d" * (n - 1) if fresh else "d" * n)

    def follow(self, other: _Stretch) -> None:
        if self.n and other.n:
            self.illegal += self.last + other.first not in PAIRS
        self.turns += other.turns - (other.low is not None and other.low == self.high)
        self.first, self.last = other.first if self.first is None else self.first, self.last if other.last is None else other.last
        self.low, self.high = other.low if self.low is None else self.low, self.high if other.high is None else other.high
        for name in ("n", "blank", "duplicate", "truncated", "illegal"):
            setattr(self, name, getattr(self, name) + getattr(other, name))
        self.spans = join_spans(self.spans, other.spans)

    def row(self) -> dict:
        out = {k: v for k, v in vars(self).items() if k not in ("spans", "codes")}
        out["codes"] = None if self.spans is not None else self.codes
        out["spans"] = None if self.spans is None else [{"q": q, "r": r, "cost": c, "audit": a} for (q, r), (c, a) in self.spans.items()]
        return out

    @staticmethod
    def of(row: dict) -> _Stretch:
        out = _Stretch(**{k: row[k] for k in ("n", "blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "turns")})
        out.spans = {(s["q"], s["r"]): (s["cost"], s["audit"]) for s in row["spans"]}
        return out


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[bool, dict]]:
    """All lines, each with whether it begins another key than the line before."""
    before: object = _runs
    for batch in batches:
        for line in batch.to_pylist():
            yield before is _runs or line[key] != before, line
            before = line[key]


def _batches(rows: Iterator[dict], schema: pa.Schema, most: int = 2000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _arrow(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def summarise(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, the four fault counts, cost and audit of every conversation in ``rows`` (see ``damage`` for its columns).

    Rows count in the order of their turns, null turns first; among equal turns the
    order is that of a digest of role and text.  The first fault of a row counts:
    blank (nothing but ASCII white space), duplicate (role and text seen earlier in
    the conversation), truncated (its last other character is no full stop, exclamation or
    question mark).  Blank and duplicate rows must go.  A conversation none of whose
    rows is left (copies 0) has zeros and an empty audit; a null conv_id is a
    conversation of its own; roles that begin with none of s, u and a must change or
    go.  An empty table gives an empty result.  ``copies`` rows in a row count as that many.
    """
    spark = rows.sparkSession
    kind = rows.schema["conv_id"].dataType.simpleString()
    found, result = f"conv_id {kind}, {FOUND}", f"conv_id {kind}, {SUMMARY}"
    found_arrow, result_arrow = _arrow(spark, found), _arrow(spark, result)
    width = partitions(spark)

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One line per conversation and partition; only those at the partition's edges may go on elsewhere."""
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def every() -> Iterator[dict]:
            row, now, codes = None, None, []
            for fresh, line in _runs(batches, "conv_id"):
                if fresh:
                    if row is not None:
                        yield done(row, now, codes)
                    row, now, codes = {"conv_id": line["conv_id"], "part": part, "whole": row is not None}, _Stretch(), []
                now.add(line, codes)
            if row is not None:
                yield done(row | {"whole": False}, now, codes)

        def done(row: dict, now: _Stretch, codes: list[str]) -> dict:
            now.codes = "".join(codes)
            if not row["whole"]:
                now.spans = _solved(now.codes)
            return row | now.row()

        yield from _batches(every(), found_arrow)

    order = ["conv_id", "turn", "message"]
    lines = _marked(rows).repartitionByRange(width, *order).sortWithinPartitions(*order)
    parts = written(lines.drop("message").mapInArrow(stretches, found), "talk-stretches")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def every() -> Iterator[dict]:
            row, now = None, None
            for batch in batches:
                for line in batch.to_pylist():
                    if row is not None and (line["conv_id"], line["block"]) == (row["conv_id"], row["part"]):
                        now.follow(_Stretch.of(line))
                        continue
                    if row is not None:
                        yield row | now.row()
                    row, now = {"conv_id": line["conv_id"], "part": line["block"], "whole": False}, _Stretch.of(line)
            if row is not None:
                yield row | now.row()

        yield from _batches(every(), found_arrow)

    open_parts, span = parts.filter("not whole"), 1
    while span < width:  # at most two lines per partition, joined by neighbours
        block = open_parts.withColumn("block", F.expr(f"part div {FAN_IN}").cast("int"))
        open_parts = written(block.repartition(width, "conv_id", "block").sortWithinPartitions("conv_id", "block", "part").mapInArrow(joined, found), "talk-open")
        span *= FAN_IN

    def closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                cost, audit = repair(r["codes"]) if r["spans"] is None else _goal({(s["q"], s["r"]): (s["cost"], s["audit"]) for s in r["spans"]})
                gaps = 0 if r["low"] is None else r["high"] - r["low"] + 1 - r["turns"]
                out.append({k: r[k] for k in ("conv_id", "blank", "duplicate", "truncated", "illegal")} | {"gaps": gaps, "cost": cost, "audit": audit})
            yield pa.RecordBatch.from_pylist(out, result_arrow)

    every = parts.filter("whole").unionByName(open_parts)
    return written(every.mapInArrow(closed, result), "talk-repairs")


def _streamed(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """Each conversation's audit, then its rows in order, in one partition."""
    head = repairs.select("conv_id", F.lit(0).alias("line"), "audit", *[F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("message", "binary"), ("role", "string"), ("text", "string"), ("copies", "int"))])
    body = rows.filter("copies > 0").select("conv_id", F.lit(1).alias("line"), F.lit(None).cast("string").alias("audit"), "turn", _message().alias("message"), "role", "text", "copies")
    both = head.unionByName(body).repartition(partitions(rows.sparkSession), "conv_id")
    return both.sortWithinPartitions("conv_id", "line", "turn", "message").select("conv_id", "audit", "role", "text", "copies")


def _talks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[tuple[str, str, str]]]]:
    """(conversation, its repaired rows) one after another; the rows are read as they are asked for."""
    lines = (line for batch in batches for k in range(0, batch.num_rows, 256) for line in batch.slice(k, 256).to_pylist())
    head = next(lines, None)
    while head is not None:
        after: list[dict | None] = [None]

        def body() -> Iterator[tuple[str, str]]:
            for line in lines:
                if line["audit"] is not None:
                    after[0] = line
                    return
                for _ in range(line["copies"]):
                    yield line["role"], line["text"]

        rows = body()
        yield head["conv_id"], repaired(head["audit"], rows)
        for _ in rows:  # to the next audit
            pass
        head = after[0]


def transcripts(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 (lowercase hex) of the repaired ``role:text`` lines, joined by line feeds.

    A digest of one conversation has to be taken in order, so its rows pass one task,
    a few at a time; nothing is held but the audit.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    out = f"conv_id {kind}, repaired_sha256 string"
    schema = _arrow(rows.sparkSession, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def every() -> Iterator[dict]:
            for conv, messages in _talks(batches):
                digest = hashlib.sha256()
                for k, (role, text, _) in enumerate(messages):
                    digest.update(f"{chr(10) if k else ''}{role}:{text}".encode())
                yield {"conv_id": conv, "repaired_sha256": digest.hexdigest()}

        yield from _batches(every(), schema)

    return _streamed(rows, repairs).mapInArrow(run, out)


def repaired_messages(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """conv_id, place, role, text and edit (K kept, R other role, I inserted) of every row after the repair."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    out = f"conv_id {kind}, place long, role string, text string, edit string"
    schema = _arrow(rows.sparkSession, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = ({"conv_id": conv, "place": k, "role": role, "text": text, "edit": edit} for conv, messages in _talks(batches) for k, (role, text, edit) in enumerate(messages))
        yield from _batches(every, schema, 256)

    return _streamed(rows, repairs).mapInArrow(run, out)
