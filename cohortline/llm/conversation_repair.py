"""Conversation structure repair: least edits that give role order ``(s?(ua)+)?``.

A conversation is its rows by turn (nulls first; rows of one turn by role and the
SHA-256 of their text).  Each row's first fault counts: *blank* (no word character), *duplicate* (role and
text seen earlier in the conversation), *truncated* (its last character, blanks aside, is not ``.``, ``!`` or ``?``).
Edits are Keep (0), Rerole to user or assistant (2), Delete (3; required for blank and
duplicate rows), Insert an empty user or assistant row anywhere (2); a truncated row that stays adds 1.  Of the
cheapest edit sequences the one whose initials are least in ASCII order is applied.

*Search.*  Depth-first branch and bound over (row, role state) with an explicit stack.  The
suffix lower bound is the cost of the remaining rows by role state, found backwards
without regard to the initials; the incumbent is the best (cost, audit) so far; a table per
node keeps its best (cost, audit) prefix and drops every worse one, which is safe because two equally
dear prefixes of a node are never prefixes of each other.  The search ends when the stack holds
nothing that could beat the incumbent.

*At scale.*  Equal rows of a turn are counted before any shuffle, duplicates are found by a
join on digests, and the rows are range-sorted, so a conversation of any length spreads over
partitions.  It is searched in blocks of bounded size, each for every role state it may
begin and end in; a pass over the blocks' answers alone (a few strings a block) picks the
best chain.  Only the digest reads a conversation in one task, as a stream, because SHA-256 is sequential.

Null roles and texts are one space (so never a valid role, and blank); an empty role has no initial and is not
valid either; a null conversation id is a conversation, a null turn comes first and leaves no gap; repeated rows
are duplicates; an empty table gives an empty result; other columns never enter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.llm.tables import written

KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
BLANKS = " \t\n\x0b\f\r"
BLOCK_ROWS = 1024
BLOCK_CHARS = 4 << 20
BLOCK_COPIES = 1 << 16

# role states: nothing yet, after the system row, after a user row, after an assistant row
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
END = 9                               # goal: a valid end of the conversation
_GOALS = {END: (START, ASSISTANT), **{q: (q,) for q in STATES}}
_NEXT = (USER, USER, ASSISTANT, USER)  # state after the only role that may follow a user-or-assistant insert
_NAME = {USER: "user", ASSISTANT: "assistant"}
_FOR = {USER: "u", ASSISTANT: "a"}
_LEGAL = {"su", "ua", "au"}
_INF = 1 << 60

OK, BLANK, DUPLICATE, TRUNCATED = range(4)


def options(q: int, initial: str, fault: int, copies: int) -> list[tuple[str, int, int]]:
    """(initials, cost, next state) of the edits that use up a row; its further copies are duplicates and go."""
    more, tail = DELETE * (copies - 1), "D" * (copies - 1)
    out = [("D" + tail, DELETE + more, q)]
    if fault in (OK, TRUNCATED):
        more += CUT * (fault == TRUNCATED)
        to = _NEXT[q]
        if initial == "s" and q == START:
            out.append(("K" + tail, KEEP + more, SYSTEM))
        elif initial == _FOR[to]:
            out.append(("K" + tail, KEEP + more, to))
        if initial != _FOR[to]:
            out.append(("R" + tail, REROLE + more, to))
    return out


def suffix_bounds(rows: list[tuple[str, int, int]], goal: int) -> list[list[int]]:
    """Least cost from every (row, role state) to the goal."""
    def with_inserts(b: list[int]) -> list[int]:
        for _ in range(2):
            b = [min(b[q], INSERT + b[_NEXT[q]]) for q in STATES]
        return b

    bounds = [with_inserts([0 if q in _GOALS[goal] else _INF for q in STATES])]
    for row in reversed(rows):
        after = bounds[-1]
        bounds.append(with_inserts([min(c + after[to] for _, c, to in options(q, *row)) for q in STATES]))
    return bounds[::-1]


def search(rows: list[tuple[str, int, int]], entry: int, goal: int) -> tuple[int, str] | None:
    """Least (cost, audit) of editing ``rows`` (initial, fault, copies) from role state ``entry`` to ``goal``."""
    bound, n = suffix_bounds(rows, goal), len(rows)
    if bound[0][entry] >= _INF:
        return None
    best: tuple[int, str] | None = None
    table = {(0, entry): (0, "")}
    stack = [(0, entry, 0, "")]
    while stack:
        i, q, cost, audit = stack.pop()
        if best is not None:
            least = cost + bound[i][q]
            if least > best[0] or (least == best[0] and audit > best[1][:len(audit)]):
                continue
        if table[i, q] != (cost, audit):
            continue                                     # a better prefix has reached this node since
        if i == n and q in _GOALS[goal] and (best is None or (cost, audit) < best):
            best = (cost, audit)
        children = [("I", INSERT, _NEXT[q], i)]
        if i < n:
            children += [(a, c, to, i + 1) for a, c, to in options(q, *rows[i])]
        ranked = []
        for a, c, to, j in children:
            prefix = (cost + c, audit + a)
            if bound[j][to] < _INF and ((j, to) not in table or prefix < table[j, to]):
                ranked.append((prefix[0] + bound[j][to], prefix[1], j, to, prefix[0]))
        for _, a, j, to, c in sorted(ranked, reverse=True):   # the most promising is taken next
            table[j, to] = (c, a)
            stack.append((j, to, c, a))
    return best


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults planted by the CRC-32 of ``conv_id:turn``: dropped, emptied, without sentence marks,
    repeated (``n`` is 2) or made user rows."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    kind = F.crc32(key.cast("binary")) % 20
    return (conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"), kind.alias("_kind"))
            .where("_kind <> 0")
            .select("conv_id", "turn", F.when(F.col("_kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                    F.when(F.col("_kind") == 1, F.lit("")).when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
                    F.when(F.col("_kind") == 3, 2).otherwise(1).cast("bigint").alias("n")))


def _key() -> Column:
    """The conversation as text that is never null."""
    return F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n")).alias("_c")


_ANSWER = pa.struct([("entry", pa.int32()), ("goal", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
_BLOCK = pa.schema([("_c", pa.string()), ("part", pa.int32()), ("block", pa.int32()), ("roles", pa.list_(pa.string())),
                    ("texts", pa.list_(pa.string())), ("faults", pa.list_(pa.int32())), ("copies", pa.list_(pa.int64())),
                    *((c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")), ("first", pa.string()), ("last", pa.string()),
                    ("answers", pa.list_(_ANSWER))])
_BLOCKS = ("_c string, part int, block int, roles array<string>, texts array<string>, faults array<int>, copies array<bigint>, "
           "blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string, "
           "answers array<struct<entry:int,goal:int,cost:bigint,audit:string>>")


def _block(key: str, part: int, number: int, held: list[tuple], entries, goals) -> dict:
    roles, texts, faults, copies = (list(x) for x in zip(*held))
    rows = [(r[:1], f, n) for r, f, n in zip(roles, faults, copies)]
    answers = [{"entry": e, "goal": g, "cost": hit[0], "audit": hit[1]} for e in entries for g in goals if (hit := search(rows, e, g))]
    return {"_c": key, "part": part, "block": number, "roles": roles, "texts": texts, "faults": faults, "copies": copies,
            "blank": sum(n for f, n in zip(faults, copies) if f == BLANK),
            "duplicate": sum(n if f == DUPLICATE else n - 1 for f, n in zip(faults, copies) if f != BLANK),
            "truncated": sum(f == TRUNCATED for f in faults),
            "illegal": sum(copies) - len(copies) + sum(a[:1] + b[:1] not in _LEGAL for a, b in zip(roles, roles[1:])),
            "first": roles[0][:1], "last": roles[-1][:1], "answers": answers}


def _blocks(block_rows: int):
    """Blocks of the sorted rows, each of one conversation, with the best edits for every
    role state it may begin and end in (a conversation can only be cut at the partition's ends)."""
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, out = TaskContext.get().partitionId(), 0, []
        key, entries, held, chars, copies, first_run = None, (START,), [], 0, 0, True

        def close(goals):
            nonlocal number, held, chars, copies
            out.append(_block(key, part, number, held, entries, goals))
            number, held, chars, copies = number + 1, [], 0, 0

        for b in batches:
            for c, role, text, n, blank, seen, cut in zip(*(b.column(i).to_pylist() for i in range(b.num_columns))):
                if c != key:
                    if held:
                        close((END,))
                    entries = STATES if first_run else (START,)
                    key, first_run = c, False
                elif len(held) >= block_rows or chars + len(text) > BLOCK_CHARS or copies + n > BLOCK_COPIES:
                    close(STATES)
                    entries = STATES
                held.append((role, text, BLANK if blank else DUPLICATE if seen else TRUNCATED if cut else OK, n))
                chars, copies = chars + len(text) + len(role), copies + n
            if out:
                yield pa.RecordBatch.from_pylist(out, _BLOCK)
                out.clear()
        if held:
            close((END, *STATES))          # the next partition may go on with this conversation
        if out:
            yield pa.RecordBatch.from_pylist(out, _BLOCK)
    return blocks


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best answer of every block: chains over the blocks of each conversation, at most one
    per role state.  What all chains share is final and leaves at once."""
    names = ["part", "block", "entry", "cost", "audit"]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
    out: list[tuple] = []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    def settled(ends: dict):
        out.extend(min((cost, "".join(p[4] for p in path), path) for q, (cost, path) in ends.items() if q in (START, ASSISTANT))[2])

    key, live, last = None, {}, {}
    for b in batches:
        for c, part, block, answers in zip(*(b.column(i).to_pylist() for i in range(b.num_columns))):
            if c != key:
                if key is not None:
                    settled(last)
                key, live = c, {START: (0, [])}
            reached: dict[int, list] = {}
            for a in answers:
                if a["entry"] in live and a["goal"] != END:
                    cost, path = live[a["entry"]]
                    reached.setdefault(a["goal"], []).append((cost + a["cost"], [*path, (part, block, a["entry"], a["cost"], a["audit"])]))
            ended = [(live[a["entry"]], a) for a in answers if a["goal"] == END and a["entry"] in live]
            nxt = {q: min(xs, key=lambda x: (x[0], "".join(p[4] for p in x[1]))) for q, xs in reached.items()}
            if ended:      # this block may be the last: its valid ends as one
                xs = [(cost + a["cost"], [*path, (part, block, a["entry"], a["cost"], a["audit"])]) for (cost, path), a in ended]
                last = {START: min(xs, key=lambda x: (x[0], "".join(p[4] for p in x[1])))}
            else:
                last = nxt
            live = nxt
            while len(live) and not ended and all(path for _, path in live.values()) and len({path[0] for _, path in live.values()}) == 1:
                out.append(next(iter(live.values()))[1][0])
                live = {q: (cost, path[1:]) for q, (cost, path) in live.items()}
                last = live
        if out:
            yield batch()
            out = []
    if key is not None:
        settled(last)
    if out:
        yield batch()


def edited_rows(entry: int, audit: str, roles: list[str], texts: list[str], copies: list[int]) -> list[tuple[str, str, str, int]]:
    """(edit, role, text, index of the row or -1) of every row that stands after the edits of one block."""
    out, q, at = [], entry, 0
    i = 0
    while i < len(audit):
        a = audit[i]
        i += 1
        if a == "I":
            q = _NEXT[q]
            out.append((a, _NAME[q], "", -1))
            continue
        if a == "K":
            q = SYSTEM if roles[at][:1] == "s" else _NEXT[q]
            out.append((a, roles[at], texts[at], at))
        elif a == "R":
            q = _NEXT[q]
            out.append((a, _NAME[q], texts[at], at))
        i += copies[at] - 1                    # its copies' deletions follow at once
        at += 1
    return out


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from its blocks in order, read as a stream."""
    names = ["_c", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    out: list[tuple] = []

    def batch():
        cols = list(zip(*out))
        kinds = [pa.string(), *[pa.int64()] * 5, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    key = None
    for b in batches:
        for r in b.to_pylist():
            if r["_c"] != key:
                if key is not None:
                    out.append((key, *sums, "".join(audit), sha.hexdigest()))
                key, sums, audit, sha, before, begun = r["_c"], [0] * 5, [], hashlib.sha256(), None, False
            for k, name in enumerate(("blank", "duplicate", "truncated", "illegal", "cost")):
                sums[k] += r[name]
            if before is not None:
                sums[3] += before + r["first"] not in _LEGAL
            before = r["last"]
            audit.append(r["audit"])
            for _, role, text, _ in edited_rows(r["entry"], r["audit"], r["roles"], r["texts"], r["copies"]):
                sha.update(f"{chr(10) * begun}{role}:{text}".encode("utf-8", "surrogatepass"))
                begun = True
        if out:
            yield batch()
            out = []
    if key is not None:
        out.append((key, *sums, "".join(audit), sha.hexdigest()))
        yield batch()


def repaired_blocks(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows ``(conv_id, turn, role, text, n)`` (``n`` equal copies) as blocks of conversations in
    order, each with its counts of faults and the edits chosen for it."""
    # equal rows of a turn are counted first: no key holds them all
    equal = written(rows.groupBy(_key(), "turn", "role", "text").agg(F.sum("n").alias("n"))
                    .withColumn("_d", F.sha2(F.col("text").cast("binary"), 256)), "repair-rows")
    when = F.struct(F.col("turn").isNotNull().alias("k"), F.col("turn"))
    again = (equal.groupBy("_c", "role", "_d").agg(F.min(when).alias("_first"), F.count(F.lit(1)).alias("_turns"))
             .where("_turns > 1").drop("_turns"))
    trimmed = F.rtrim(F.col("text"), F.lit(BLANKS))
    marked = equal.join(again, ["_c", "role", "_d"], "left").select(
        "_c", "turn", "role", "_d", "text", "n", (trimmed == "").alias("_blank"),
        F.coalesce(when > F.col("_first"), F.lit(False)).alias("_seen"), (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("_cut"))
    order = ["_c", "turn", "role", "_d"]
    sorted_rows = marked.repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = written(sorted_rows.select("_c", "role", "text", "n", "_blank", "_seen", "_cut").mapInArrow(_blocks(block_rows), _BLOCKS), "repair-blocks")
    chosen = (blocks.select("_c", "part", "block", "answers").repartition("_c").sortWithinPartitions("_c", "part", "block")
              .mapInArrow(_chain, "part int, block int, entry int, cost bigint, audit string"))
    return blocks.drop("answers").join(chosen, ["part", "block"])


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The repaired conversations: ``(conv, part, block, place, edit, role, text)``, in order by the first four
    (``conv`` is the id as text after ``c``, or ``n`` for null)."""
    schema = "conv string, part int, block int, place int, edit string, role string, text string"

    def turns(batches):
        for b in batches:
            for r in b.to_pylist():
                rows = edited_rows(r["entry"], r["audit"], r["roles"], r["texts"], r["copies"])
                cols = [[r["_c"]] * len(rows), [r["part"]] * len(rows), [r["block"]] * len(rows), list(range(len(rows))),
                        *([x[k] for x in rows] for k in range(3))]
                kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)],
                                                 names=["conv", "part", "block", "place", "edit", "role", "text"])
    return repaired_blocks(rows).mapInArrow(turns, schema)


def repair_report(conversations: DataFrame, rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per conversation of ``conversations``: gaps, faults, cost, audit and digest of its repaired ``rows``."""
    ids = conversations.select("conv_id").distinct().select("conv_id", _key())
    turns = rows.select(_key(), "turn").distinct().groupBy("_c").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    blocks = repaired_blocks(rows, block_rows).repartition("_c").sortWithinPartitions("_c", "part", "block")
    found = blocks.mapInArrow(_digests, "_c string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
                                        "audit string, repaired_sha256 string")
    out = ids.join(turns, "_c", "left").join(found, "_c", "left")
    zero = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select("conv_id", *[F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c) for c in zero],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
