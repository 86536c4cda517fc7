"""Conversation structure repair by lazy weighted determinisation.

A conversation is right when the initials of its roles read ``(s?(ua)+)?``. Edits: K keeps a row, R
gives it the role that is due (3), D deletes it (4; a must for blank and repeated rows), I inserts an
empty row of the role due (3). A truncated row that stays costs 3 more. The cheapest edits are wanted,
and among those of equal cost the least string of letters.

The edits are arcs of a weighted automaton with four states (start, after s, after u, after a), which
is nondeterministic. It is determinised lazily: what is known of a suffix is the vector of its costs
from each state, and two suffixes whose vectors differ by a constant have the same future, so the
vector less its minimum is a state of the deterministic automaton. These states and their transitions
by kind of row are made when first met and cached in a table; there are few, as costs of states
differ by a few edits at most. A conversation is scanned from its last row to its first with one look
into the table a row, which gives the cost. The trace then goes back over the scanned states, from the
first row to the last, along arcs that are tight (the cost of the arc is the difference of the two
ends); it takes the least letter that is tight, which gives the least of the cheapest strings.

1. Faults are found by built-in functions; repeats by a window over narrow rows (hashes for texts).
2. Narrow rows are dealt by conversation and sorted; a task streams them and holds some bytes a row of
   the conversation it is in.
3. The answer of a conversation goes ahead of its rows into a second shuffle, and the repaired text is
   hashed as the rows pass, without ever holding a conversation. Both steps take one conversation in
   one task, for the audit and the hash of a conversation are each one value over its rows in order.

Order within a conversation is by turn, nulls first; rows of one turn by role, then by a fingerprint
of the text, and repeated rows stand side by side. Null roles and texts are one space: such a row is
blank. Null conv_ids form a conversation of their own. Roles count by their first character. Texts
are compared by 128 bits. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import stages as st

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: states: start, after s, after u, after a; the state that follows the role due in each
DUE = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
INITIALS = "sua"
FINE, BLANK, DUPLICATE, CUT = range(4)
SPACES = " \t\n\x0b\x0c\r"
COLUMNS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


# -- the automaton -------------------------------------------------------------------------------
def _arcs(q: int, initial: int, fault: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the ways over one row, by letter."""
    arcs = [("D", DELETE, q)]
    if fault in (FINE, CUT):
        more = TRUNCATED if fault == CUT else 0
        if initial == 0 and q == 0:
            arcs.append(("K", KEEP + more, 1))
        elif initial < 3 and initial + 1 == DUE[q]:
            arcs.append(("K", KEEP + more, DUE[q]))
        arcs.append(("R", REROLE + more, DUE[q]))
    return arcs


#: by row (4 * initial + fault) and state
ARCS = [[_arcs(q, row >> 2, row & 3) for q in range(4)] for row in range(16)]


def _inserted(w: list[int]) -> list[int]:
    """Costs when rows may be inserted first: after two the states repeat."""
    return [min(w[q], INSERT + w[DUE[q]], 2 * INSERT + w[DUE[DUE[q]]]) for q in range(4)]


class Automaton:
    """Deterministic states (normalised cost vectors) and their transitions, made when first met."""

    def __init__(self) -> None:
        self.vectors: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        self.table: list[list[tuple[int, int] | None]] = []
        far = 1 << 40
        self.last = self._state(_inserted([0, far, far, 0]))[0]

    def _state(self, costs: list[int]) -> tuple[int, int]:
        """(state, what was taken off all costs)."""
        least = min(costs)
        vector = tuple(c - least for c in costs)
        if vector not in self.number:
            self.number[vector] = len(self.vectors)
            self.vectors.append(vector)
            self.table.append([None] * 16)
        return self.number[vector], least

    def step(self, state: int, row: int) -> tuple[int, int]:
        """(state before the row, weight), by the table."""
        found = self.table[state][row]
        if found is None:
            after = self.vectors[state]
            found = self._state(_inserted([min(c + after[to] for _, c, to in ARCS[row][q]) for q in range(4)]))
            self.table[state][row] = found
        return found

    def repair(self, rows: bytearray) -> tuple[int, str]:
        """(cost, audit) of a conversation, whose rows are 4 * initial + fault each. What is held of
        each row is its kind, its state, its weight and its letter: some bytes."""
        states, weights, total, state = array("H", [self.last]), array("H"), 0, self.last
        for row in reversed(rows):
            state, weight = self.step(state, row)
            states.append(state)
            weights.append(weight)
            total += weight
        n = len(rows)
        letters, q, i = bytearray(), 0, 0
        cost = total + self.vectors[state][0]
        while True:
            here = self.vectors[states[n - i]]
            tight = []
            if i < n:
                there, weight = self.vectors[states[n - i - 1]], weights[n - i - 1]
                tight = [(letter, to) for letter, c, to in ARCS[rows[i]][q] if here[q] + weight == c + there[to]]
            elif q in (0, 3):
                return cost, letters.decode()
            if here[q] == INSERT + here[DUE[q]]:
                tight.append(("I", DUE[q]))
            letter, q = min(tight)
            letters += letter.encode()
            i += letter != "I"


# -- the two passes ------------------------------------------------------------------------------
def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An answer for each run of rows (conv, turn, initial, fault, lost) of one conversation."""
    automaton = Automaton()
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    open_, conv, rows, turns = False, None, bytearray(), []

    def answer() -> tuple:
        kinds = Counter(rows)
        count = [sum(n for x, n in kinds.items() if x & 3 == kind) for kind in (BLANK, DUPLICATE, CUT)]
        pairs = Counter(zip(rows, islice(rows, 1, None), strict=False))
        illegal = sum(n for (a, b), n in pairs.items() if (a >> 2, b >> 2) not in {(0, 1), (1, 2), (2, 1)})
        gaps = turns[1] - turns[0] + 1 - turns[2] if turns else 0
        return conv, gaps, *count, illegal, *automaton.repair(rows)

    def table(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True))
        kinds = [pa.string(), *[pa.int64()] * 6, pa.string()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["conv", *names])

    for batch in batches:
        out = []
        for own, turn, initial, fault, lost in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not open_ or own != conv:
                if open_:
                    out.append(answer())
                open_, conv, rows, turns = True, own, bytearray(), []
            if lost:
                continue
            rows.append(initial << 2 | fault)
            if turn is not None:
                turns = [turn, turn, 1] if not turns else [turns[0], turn, turns[2] + (turn != turns[1])]
        if out:
            yield table(out)
    if open_:
        yield table([answer()])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The answers, each with the hash of the repaired rows that follow it. Rows (conv, head, role,
    text, *answer); a head comes before the rows of its conversation."""
    head: tuple | None = None
    q = at = n = 0
    digest = hashlib.sha256()

    def put(role: str, text: str) -> None:
        nonlocal n
        digest.update(f"{chr(10) if n else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        n += 1

    def inserts() -> None:
        nonlocal q, at
        while audit[at : at + 1] == "I":
            q = DUE[q]
            put(ROLE[q], "")
            at += 1

    for batch in batches:
        out = []
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[1]:
                if head is not None:
                    inserts()
                    out.append((*head, digest.hexdigest()))
                head, audit = (row[0], *row[4:]), row[-1]
                q = at = n = 0
                digest = hashlib.sha256()
                continue
            inserts()
            letter = audit[at]
            at += 1
            if letter != "D":
                kept = letter == "K"
                q = 1 if kept and row[2][:1] == "s" else DUE[q]
                put(row[2] if kept else ROLE[q], row[3])
        if out:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), KINDS, strict=True)], names=NAMES)
    if head is not None:
        inserts()
        yield pa.record_batch([pa.array([c], k) for c, k in zip((*head, digest.hexdigest()), KINDS, strict=True)], names=NAMES)


NAMES = ["conv", *[c.split()[0] for c in COLUMNS.split(", ")], "repaired_sha256"]
KINDS = [pa.string(), *[pa.int64()] * 6, pa.string(), pa.string()]


def structure_repair(rows: DataFrame, lost: Column | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each
    conversation of rows (conv_id, turn, role, text). Rows that are ``lost`` only stand for their
    conversation: one without any other row has zeros, no edits and the hash of nothing."""
    n = st.tasks(rows.sparkSession)
    plain = rows.select(
        F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), (F.lit(False) if lost is None else lost).alias("lost"),
    )
    plain = plain.withColumn("h", F.xxhash64("text"))
    ends = F.rtrim("text", F.lit(SPACES))
    place = F.row_number().over(Window.partitionBy("conv", "lost", "role", "h", "h2").orderBy(F.col("turn").asc_nulls_first()))
    narrow = plain.select("conv", "turn", "role", "h", F.xxhash64(F.lit(1), F.reverse("text")).alias("h2"), "lost", (ends == "").alias("blank"), (~F.substring(ends, -1, 1).isin(".", "!", "?")).alias("cut"))
    fault = F.when(F.col("blank"), BLANK).when(place > 1, DUPLICATE).when(F.col("cut"), CUT).otherwise(FINE)
    initial = F.coalesce(*(F.when(F.substring("role", 1, 1) == c, i) for i, c in enumerate(INITIALS)), F.lit(3))
    narrow = narrow.select("conv", "turn", "role", "h", fault.cast("int").alias("fault"), initial.cast("int").alias("initial"), "lost")
    order = [F.col("turn").asc_nulls_first(), "role", "h"]
    narrow = narrow.repartition(n, "conv").sortWithinPartitions("conv", "lost", *order, F.col("fault") == DUPLICATE)
    answers = narrow.select("conv", "turn", "initial", "fault", "lost").mapInArrow(_answers, f"conv string, {COLUMNS}")
    heads = answers.select("conv", F.lit(True).alias("head"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("long").alias("h"), F.lit(None).cast("string").alias("text"), *NAMES[1:-1])
    texts = plain.where("NOT lost").select("conv", F.lit(False).alias("head"), "turn", "role", "h", "text", *(F.lit(None).cast("string" if c == "audit" else "long").alias(c) for c in NAMES[1:-1]))
    both = heads.union(texts).repartition(n, "conv").sortWithinPartitions("conv", F.desc("head"), *order)
    out = both.select("conv", "head", "role", "text", *NAMES[1:-1]).mapInArrow(_hashes, f"conv string, {COLUMNS}, repaired_sha256 string")
    return out.select(F.col("conv").cast(rows.schema["conv_id"].dataType).alias("conv_id"), *NAMES[1:])


def damaged(rows: DataFrame) -> tuple[DataFrame, Column]:
    """Rows (conv_id, turn, role, text) damaged by crc32(conv_id:turn) % 20, and which are lost: 0
    drops a row, 1 empties its text, 2 takes its marks away, 3 repeats it, 4 makes it the user's."""
    space = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    hit = rows.select("conv_id", "turn", F.coalesce(F.col("role"), space).alias("role"), F.coalesce(F.col("text"), space).alias("text"), (F.crc32(key.cast("binary")) % 20).cast("int").alias("hit"))
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.expr("CASE WHEN hit = 3 THEN array(1, 2) ELSE array(1) END"))
    out = hit.select("conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "hit", times.alias("times"))
    return out.drop("times"), F.col("hit") == 0


# -- the same in SQL -----------------------------------------------------------------------------
def _add(v: str, cost: str, letters: str) -> str:
    """A value (nine digits of cost, then the letters) with an edit before it."""
    return f"(lpad(CAST(CAST(substr({v}, 1, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || '{letters}' || substr({v}, 10))"


def _over_row(q: int) -> str:
    keep = {0: f"WHEN i = 's' THEN {_add('v1', '3 * cut', 'K')} WHEN i = 'u' THEN {_add('v2', '3 * cut', 'K')}", 2: f"WHEN i = 'a' THEN {_add('v3', '3 * cut', 'K')}"}
    own = keep.get(q, f"WHEN i = 'u' THEN {_add('v2', '3 * cut', 'K')}")
    due = f"v{DUE[q]}"
    return f"CASE WHEN forced THEN {_add(f'v{q}', '4', 'D')} ELSE least({_add(f'v{q}', '4', 'D')}, {_add(due, '3 + 3 * cut', 'R')}, CASE {own} ELSE '~' END) END AS w{q}"


def _crc_table() -> str:
    sql = "SELECT range AS n, range AS v FROM range(256)"
    for _ in range(8):
        sql = f"SELECT n, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END AS v FROM ({sql}) x"
    return sql


ORACLE = rf"""WITH RECURSIVE tab AS ({_crc_table()}),
k AS (SELECT DISTINCT coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
crc(key, idx, v) AS (SELECT key, 1, CAST(4294967295 AS BIGINT) FROM k UNION ALL SELECT key, idx + 1, xor(tab.v, crc.v // 256) FROM crc JOIN tab ON tab.n = xor(crc.v % 256, ascii(substr(key, idx, 1))) WHERE idx <= length(key)),
hit AS (SELECT key, xor(v, 4294967295) % 20 AS hit FROM crc WHERE idx = length(key) + 1),
d AS (SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role, CASE WHEN hit = 1 THEN '' WHEN hit = 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text, hit
  FROM conversations JOIN hit ON hit.key = coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') WHERE hit <> 0),
rep AS (SELECT conv_id, turn, role, text FROM d UNION ALL SELECT conv_id, turn, role, text FROM d WHERE hit = 3),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS again FROM rep),
f AS (SELECT *, substr(role, 1, 1) AS i, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS ends FROM n),
r AS (SELECT *, CASE WHEN ends = '' THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN substr(ends, length(ends), 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM f),
x AS (SELECT conv_id, pos, role, text, i, fault IN ('blank', 'duplicate') AS forced, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS cut FROM r),
size AS (SELECT conv_id, count(*) AS rows_n FROM x GROUP BY 1),
dp(conv_id, pos, v0, v1, v2, v3) AS (SELECT conv_id, rows_n + 1, '000000000', '000000006II', '000000003I', '000000000' FROM size
  UNION ALL SELECT conv_id, pos, least(w0, {_add('w2', '3', 'I')}, {_add('w3', '6', 'II')}), least(w1, {_add('w2', '3', 'I')}, {_add('w3', '6', 'II')}), least(w2, {_add('w3', '3', 'I')}), least(w3, {_add('w2', '3', 'I')})
  FROM (SELECT x.conv_id, x.pos, {', '.join(_over_row(q) for q in range(4))} FROM dp JOIN x ON x.conv_id = dp.conv_id AND x.pos = dp.pos - 1) y),
best AS (SELECT conv_id, CAST(substr(v0, 1, 9) AS BIGINT) AS cost, substr(v0, 10) AS audit FROM dp WHERE pos = 1),
walk(conv_id, audit, idx, pos, q, built) AS (SELECT conv_id, audit, 1, 1, 0, '' FROM best
  UNION ALL SELECT w.conv_id, w.audit, w.idx + 1, CASE WHEN l = 'I' THEN w.pos ELSE w.pos + 1 END, CASE WHEN l = 'D' THEN q WHEN l = 'K' AND x.i = 's' THEN 1 WHEN q = 2 THEN 3 ELSE 2 END,
    built || CASE WHEN l = 'D' THEN '' ELSE CASE WHEN built = '' THEN '' ELSE chr(10) END || CASE WHEN l = 'K' THEN x.role WHEN q = 2 THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN l = 'I' THEN '' ELSE x.text END END
  FROM (SELECT *, substr(audit, idx, 1) AS l FROM walk WHERE idx <= length(audit)) w LEFT JOIN x ON x.conv_id = w.conv_id AND x.pos = w.pos),
done AS (SELECT conv_id, sha256(built) AS h FROM walk WHERE idx = length(audit) + 1),
ill AS (SELECT a.conv_id, count(*) AS illegal FROM x a JOIN x b ON a.conv_id = b.conv_id AND b.pos = a.pos + 1 WHERE a.i || b.i NOT IN ('su', 'ua', 'au') GROUP BY 1),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated FROM r GROUP BY 1)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal,
  CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN g ON g.conv_id = o.conv_id LEFT JOIN ill ON ill.conv_id = o.conv_id LEFT JOIN best ON best.conv_id = o.conv_id LEFT JOIN done ON done.conv_id = o.conv_id"""
