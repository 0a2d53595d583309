"""Cheapest edits that give a conversation the shape: system at most once in front, then user and assistant by turns.

Rows get a fault first (blank, duplicate, truncated), by joins and aggregates. Sorted rows
are then cut into segments of bounded length, also inside one long conversation. For
each state a segment may begin and end in, a depth-first branch-and-bound search finds its
cheapest edits, and the segments of a conversation are chained by what they cost, so only
a few numbers of each segment meet in one task.

States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. Edits: K keep,
R give another role, D delete, I insert an empty turn. Inserted turns are written down
with the row that follows them, those at the end with the last row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage, table
from .registry import query

SEGMENT = 128  # rows of a segment
DELETE, CHANGE, INSERT, CUT_SHORT = 4, 3, 3, 3  # what edits cost; CUT_SHORT for a truncated row that stays
ROLES = {"u": "user", "a": "assistant"}
#: State after a turn with this initial, where it may stand.
AFTER = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
#: The state after the user or assistant turn that may be put there.
ADDED = [2, 2, 3, 2]
#: Inserts that finish a conversation in each state.
CLOSING = ["", "II", "I", ""]
NEVER = 1 << 60


@lru_cache(maxsize=None)  # nine codes, four states
def row_edits(code: str, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, state after) of a row. A code is the initial of its role (x: none of s, u, a),
    a capital if the row is truncated, or - if it has to go."""
    edits = [("D", DELETE, state)]
    if code != "-":
        short = CUT_SHORT if code.isupper() else 0
        after = AFTER[state].get(code.lower())
        if after is not None:
            edits.append(("K", short, after))
        edits.append(("R", CHANGE + short, ADDED[state]))
    return edits


def suffix_bounds(codes: str, goal: int) -> list[list[int]]:
    """bounds[i][state]: what rows i and later cost at least, if after system and after assistant were the same state."""
    ends = {1, 3} if goal in (1, 3) else {goal}
    bounds = [[0 if state in ends else NEVER for state in range(4)]]
    for code in reversed(codes):
        later = bounds[-1]
        here = [min(cost + later[after] for _, cost, after in row_edits(code, state)) for state in range(4)]
        for _ in range(2):  # two inserts lead to every state that inserts can reach
            here = [min(here[s], INSERT + here[ADDED[s]]) for s in range(4)]
        here[1] = here[3] = min(here[1], here[3])
        bounds.append(here)
    return bounds[::-1]


def cheapest_edits(codes: str, start: int, goal: int) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits from one state to another, the ASCII-least of equal ones; None if there are none.

    Depth first with an explicit stack, the most promising edit on top. A node is left if
    its bound can't beat the best found so far, in cost or, costs being equal, in the
    letters so far; or if its place and state were reached by a prefix as good. Of two
    different prefixes of equal cost at a node neither begins the other, as more inserts cost more, so
    what follows can't turn their order round.
    """
    bounds, last = suffix_bounds(codes, goal), len(codes)
    best: tuple[int, str] | None = None
    reached: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, start, 0, "")]
    while stack:
        at, state, cost, audit = stack.pop()
        least = cost + bounds[at][state]
        if least >= NEVER or best and (least > best[0] or least == best[0] and audit > best[1][: len(audit)]):
            continue
        earlier = reached.get((at, state))
        if earlier and earlier <= (cost, audit):
            continue
        reached[at, state] = (cost, audit)
        if at == last:
            if state == goal and (best is None or (cost, audit) < best):
                best = (cost, audit)
            continue
        nodes = [(at + 1, after, cost + more, audit + edit) for edit, more, after in row_edits(codes[at], state)]
        nodes.append((at, ADDED[state], cost + INSERT, audit + "I"))
        nodes.sort(key=lambda n: (n[2] + bounds[n[0]][n[1]], n[3]), reverse=True)
        stack.extend(nodes)
    return best


@lru_cache(maxsize=20_000)
def segment_table(codes: str, starts: tuple[int, ...]) -> dict[tuple[int, int], tuple[int, str]]:
    """The cheapest edits of a segment for each (start, end) that can be reached."""
    found = {(s, g): cheapest_edits(codes, s, g) for s in starts for g in range(4)}
    return {k: v for k, v in found.items() if v is not None}


def with_roles(audit: str, codes: str, state: int) -> list[str]:
    """The edits of each row of a segment, the initial of the new role behind every R and I: ``IuK``, ``D``, ``Ra``."""
    out, now, at = [], "", 0
    for edit in audit:
        if edit in "IR":
            state = ADDED[state]
            now += edit + "  ua"[state]
        else:
            now += edit
            if edit == "K":
                state = AFTER[state][codes[at].lower()]
        if edit != "I":
            out.append(now)
            now, at = "", at + 1
    return out + [now] if now else out


def key_of(column: str) -> Column:
    """A key that is never null."""
    return F.when(F.col(column).isNull(), F.lit("~")).otherwise(F.concat(F.lit("="), F.col(column).cast("string")))


def find_faults(turns: DataFrame, key: str = "conv_id", copies: Column | None = None) -> DataFrame:
    """(_key, key, turn, role, text, copy, fault, code): every row and the first of its faults.

    ``blank``: no character but white space. ``duplicate``: role and text came earlier in the
    conversation. ``truncated``: the last character but white space isn't one of ``.!?``.
    Null roles and texts count as one blank, so such a text is blank. ``copies`` says how
    often a row counts. Equal rows of a turn are folded while they are counted.
    """
    rows = turns.select(
        key_of(key).alias("_key"), F.col(key).alias("_id"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
        (F.lit(1) if copies is None else copies).alias("_n"),
    )
    folded = rows.groupBy("_key", "_id", "turn", "role", "text").agg(F.sum("_n").cast("int").alias("_n"))
    place = F.struct(F.col("turn").isNotNull().alias("given"), F.coalesce("turn", F.lit(0)).alias("turn"))
    first = folded.groupBy("_key", "role", "text").agg(F.min(place).alias("_first"))
    each = folded.join(first, ["_key", "role", "text"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    again = (F.col("copy") > 1) | (place != F.col("_first"))
    fault = F.when(~F.col("text").rlike("[^\\x20\\x09-\\x0D]"), "blank").when(again, "duplicate")
    fault = fault.when(~F.col("text").rlike("[.!?][\\x20\\x09-\\x0D]*\\z"), "truncated")
    initial = F.substring("role", 1, 1)
    code = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    code = F.when(F.col("fault").isin("blank", "duplicate"), "-").when(F.col("fault") == "truncated", F.upper(code)).otherwise(code)
    each = each.withColumn("fault", fault).withColumn("code", code)
    return each.select("_key", F.col("_id").alias(key), "turn", "role", "text", "copy", "fault", "code")


def plan_repairs(turns: DataFrame, key: str = "conv_id", copies: Column | None = None) -> DataFrame:
    """(_key, key, part, place, turn, role, text, fault, edits): the rows of every conversation in order, with their edits.

    ``turns`` has key, turn, role and text. Rows go by turn (nulls first), then role and
    text; (part, place) orders those of a conversation. ``edits`` are the letters of
    ``with_roles``; the last row also has the inserts that come after it. Null keys make one
    conversation. Blank and repeated rows are deleted, role names count by their initial, and
    very long texts stay as they are. Other columns are ignored; an empty table gives an empty one.
    """
    order = ["_key", F.asc_nulls_first("turn"), "role", "text", "copy"]
    rows = find_faults(turns, key, copies)
    # the ranges are told apart by the beginnings of role and text, as the driver samples them
    rows = rows.repartitionByRange("_key", F.asc_nulls_first("turn"), F.substring("role", 1, 16), F.substring("text", 1, 16))
    rows = cut_lineage(rows.withColumn("part", F.spark_partition_id()))
    rows = cut_lineage(rows.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy(*order)).cast("long")))
    segment = F.floor((F.col("place") - 1) / SEGMENT).alias("segment")
    one = F.struct("place", "code")
    segments = rows.groupBy("_key", "part", segment).agg(F.sort_array(F.collect_list(one)).alias("_rows"))  # at most SEGMENT of them
    segments = segments.select(
        "_key", "part", "segment", F.col("_rows")[0]["place"].alias("first"), F.array_join(F.transform("_rows", lambda r: r["code"]), "").alias("codes")
    )
    edits = chain_segments(cut_lineage(segments))
    edits = edits.select("_key", "part", F.posexplode("edits").alias("_i", "edits"), "first").withColumn("place", F.col("first") + F.col("_i"))
    return rows.join(edits.select("_key", "part", "place", "edits"), ["_key", "part", "place"]).select(
        "_key", key, "part", "place", "turn", "role", "text", "fault", "edits"
    )


def chain_segments(segments: DataFrame) -> DataFrame:
    """(_key, part, first, edits): for each segment the edits of its rows, cheapest for the whole conversation.

    Segments are searched where they lie, then those of a conversation pass one task, which keeps
    for every state the cheapest way to get there and where each segment of it began.
    """

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            costs, orders, audits = [], [], []
            for codes, alone in zip(batch["codes"], batch["alone"]):
                found = segment_table(codes, (0,) if alone else (0, 1, 2, 3))
                ranks = {a: n for n, a in enumerate(sorted({a for _, a in found.values()}))}
                costs.append([found[s, g][0] if (s, g) in found else -1 for s in range(4) for g in range(4)])
                orders.append([ranks[found[s, g][1]] if (s, g) in found else -1 for s in range(4) for g in range(4)])
                audits.append([found[s, g][1] if (s, g) in found else None for s in range(4) for g in range(4)])
            yield batch.assign(costs=costs, orders=orders, audits=audits)

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, ways, back, rows = None, {}, [], []

        def done() -> pd.DataFrame:
            finish = min(ways, key=lambda s: (ways[s][0] + INSERT * len(CLOSING[s]), ways[s][1]))
            ends, state = [], finish
            for step in reversed(back):
                ends.append((step[state], state))
                state = step[state]
            out = []
            for n, ((part, first, codes, audits), (start, end)) in enumerate(zip(rows, reversed(ends))):
                edits = with_roles(audits[4 * start + end], codes, start)
                if n == len(rows) - 1:
                    state = end
                    for _ in CLOSING[end]:
                        state = ADDED[state]
                        edits[-1] += "I" + "  ua"[state]
                out.append((current, part, first, edits))
            return pd.DataFrame(out, columns=["_key", "part", "first", "edits"])

        for batch in batches:
            for key, part, first, codes, _, costs, orders, audits in batch.itertuples(index=False, name=None):
                if key != current:
                    if rows:
                        yield done()
                    current, ways, back, rows = key, {0: (0, 0)}, [], []
                reached = {}
                for state, (cost, rank) in ways.items():
                    for goal in range(4):
                        more = costs[4 * state + goal]
                        if more >= 0:
                            way = (cost + more, (rank, orders[4 * state + goal]), state)
                            if goal not in reached or way < reached[goal]:
                                reached[goal] = way
                ranks = {r: n for n, r in enumerate(sorted(w[1] for w in reached.values()))}
                ways = {g: (cost, ranks[r]) for g, (cost, r, _) in reached.items()}
                back.append({g: w[2] for g, w in reached.items()})
                rows.append((part, first, codes, audits))
        if rows:
            yield done()

    counted = segments.groupBy("_key").agg((F.count("*") == 1).alias("alone"))
    columns = ["_key", "part", "first", "codes", "alone"]
    tasks = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the rows are few bytes but much work: a stated number of tasks isn't made smaller
    given = segments.join(counted, "_key").select(*columns).repartition(tasks, "_key", "part", "first")
    kinds = "_key string, part int, first long, codes string, alone boolean, costs array<long>, orders array<int>, audits array<string>"
    searched = given.mapInPandas(search, kinds).repartition("_key").sortWithinPartitions("_key", "part", "first")
    return searched.mapInPandas(chain, "_key string, part int, first long, edits array<string>")


def repaired_turns(planned: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, part, place, step, role, text): the turns after the edits; (part, place, step) orders those of a conversation."""
    parts = F.regexp_extract_all("edits", F.lit("([IR][ua]|K)"), F.lit(1))
    steps = planned.select(key, "part", "place", "role", "text", F.posexplode(parts).alias("step", "_edit"))
    role = F.when(F.col("_edit") == "K", F.col("role")).when(F.col("_edit").endswith("u"), "user").otherwise("assistant")
    text = F.when(F.col("_edit").startswith("I"), "").otherwise(F.col("text"))
    return steps.select(key, "part", "place", "step", role.alias("role"), text.alias("text"))


class Report:
    """What is told of a conversation while its rows pass by."""

    LEGAL = {"su", "ua", "au"}

    def __init__(self):
        self.sha, self.lines, self.audit = hashlib.sha256(), 0, []
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = self.cost = self.turns = 0
        self.least = self.most = self.before = None

    def line(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
        self.lines += 1

    def add(self, turn: int | None, role: str, text: str, fault: str | None, edits: str) -> None:
        if turn is not None and turn != self.most:
            self.least, self.most, self.turns = turn if self.least is None else self.least, turn, self.turns + 1
        if self.before is not None and self.before + role[:1] not in self.LEGAL:
            self.illegal += 1
        self.before = role[:1]
        if fault:
            self.faults[fault] += 1
        short = CUT_SHORT if fault == "truncated" else 0
        for edit, new in zip(edits, edits[1:] + " "):
            if edit not in "KRDI":
                continue
            self.audit.append(edit)
            self.cost += {"K": short, "R": CHANGE + short, "D": DELETE, "I": INSERT}[edit]
            if edit == "K":
                self.line(role, text)
            elif edit != "D":
                self.line(ROLES[new], "" if edit == "I" else text)

    def row(self) -> tuple:
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()


NUMBERS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def repair_reports(planned: DataFrame) -> DataFrame:
    """(_key, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of what ``plan_repairs`` gives.

    A hash is a chain, so the rows of a conversation pass one task, which holds a batch of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, report = None, None

        def passed(done: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*[(k, *r.row()) for k, r in done]))
            kinds = [pa.string(), *[pa.int64()] * len(NUMBERS), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["_key", *NUMBERS, "audit", "repaired_sha256"])

        for batch in batches:
            done = []
            for key, *row in zip(*[batch[c].to_pylist() for c in ("_key", "turn", "role", "text", "fault", "edits")]):
                if key != current:
                    if report:
                        done.append((current, report))
                    current, report = key, Report()
                report.add(*row)
            if done:
                yield passed(done)
        if report:
            yield passed([(current, report)])

    in_order = planned.repartition("_key").sortWithinPartitions("_key", "part", "place").select("_key", "turn", "role", "text", "fault", "edits")
    kinds = ", ".join(f"{n} long" for n in NUMBERS)
    return in_order.mapInArrow(run, f"_key string, {kinds}, audit string, repaired_sha256 string")


def damaged(turns: DataFrame) -> tuple[DataFrame, Column]:
    """The rows after the damage that op13 is defined on, and how often each one counts."""
    said = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    kind = F.col("_kind")
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    rows = turns.withColumn("_kind", F.crc32(said.cast("binary")) % 20).where(kind != 0)
    rows = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"), "_kind")
    return rows, F.when(kind == 3, 2).otherwise(1)


#: CRC-32 is worked out bit by bit, the cheapest edits by a table over rows and states.
OP13_SQL = r"""
WITH RECURSIVE given AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, '~') AS k,
        list_reduce([4294967295::BIGINT] || list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT),
            lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))) AS crc
    FROM conversations
), kinds AS (
    SELECT *, xor(crc, 4294967295) % 20 AS kind FROM given
), damaged AS (
    SELECT k, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM kinds, generate_series(1, CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged
), faulty AS (
    SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
        WHEN row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 THEN 'duplicate'
        WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' END AS fault,
        CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'x' END AS initial,
        lag(role[1]) OVER (PARTITION BY k ORDER BY i) || role[1] AS two
    FROM placed
), ins(q, n, q1) AS (
    VALUES (0, 0, 0), (0, 1, 2), (0, 2, 3), (1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 0, 2), (2, 1, 3), (2, 2, 2), (3, 0, 3), (3, 1, 2), (3, 2, 3)
), edit(q1, initial, letter, paid, q2) AS (
    VALUES (0, 's', 'K', 0, 1), (0, 'u', 'K', 0, 2), (1, 'u', 'K', 0, 2), (2, 'a', 'K', 0, 3), (3, 'u', 'K', 0, 2),
        (0, '', 'R', 3, 2), (1, '', 'R', 3, 2), (2, '', 'R', 3, 3), (3, '', 'R', 3, 2), (0, '', 'D', 4, 0), (1, '', 'D', 4, 1), (2, '', 'D', 4, 2), (3, '', 'D', 4, 3)
), best AS (
    SELECT k, 0::BIGINT AS i, 0 AS q, 0::BIGINT AS cost, '' AS audit FROM (SELECT DISTINCT k FROM faulty)
    UNION ALL
    SELECT k, i + 1, q2, min(w).cost, min(w).audit
    FROM (
        SELECT b.k, b.i, e.q2, {'cost': b.cost + 3 * n + paid + CASE WHEN letter <> 'D' AND fault = 'truncated' THEN 3 ELSE 0 END, 'audit': audit || repeat('I', n) || letter} AS w
        FROM best b JOIN faulty f ON f.k = b.k AND f.i = b.i + 1 JOIN ins USING (q)
        JOIN edit e ON e.q1 = ins.q1 AND (e.initial = '' OR e.initial = f.initial) AND (letter = 'D' OR fault IS NULL OR fault = 'truncated')
    )
    GROUP BY k, i, q2
), chosen AS (
    SELECT k, min({'cost': cost + 3 * length(closing), 'audit': audit || closing}) AS w
    FROM best JOIN (VALUES (0, ''), (1, 'II'), (2, 'I'), (3, '')) AS c(q, closing) USING (q) JOIN (SELECT k, max(i) AS i FROM faulty GROUP BY k) USING (k, i)
    GROUP BY k
), letters AS (
    SELECT k, p, audit[p] AS letter, length(replace(audit[:p - 1], 'I', '')) + 1 AS i, length(replace(audit[:p], 'D', '')) AS step
    FROM (SELECT k, w.audit AS audit, unnest(generate_series(1, length(w.audit))) AS p FROM chosen)
), kept AS (
    SELECT l.k, step, letter, role, text, (step + bool_or(letter = 'K' AND step = 1 AND role[1] = 's') OVER (PARTITION BY l.k)::INTEGER) % 2 AS odd
    FROM letters l LEFT JOIN faulty f ON f.k = l.k AND f.i = l.i WHERE letter <> 'D'
), repaired AS (
    SELECT k, string_agg(CASE WHEN letter = 'K' THEN role WHEN odd = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE letter WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY step) AS lines
    FROM kept GROUP BY k
), told AS (
    SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal
    FROM faulty GROUP BY k
)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
    coalesce(illegal, 0)::BIGINT AS illegal, coalesce(w.cost, 0)::BIGINT AS cost, coalesce(w.audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, k FROM given) LEFT JOIN told USING (k) LEFT JOIN chosen USING (k) LEFT JOIN repaired USING (k)
"""


@query("op13_repair", OP13_SQL)
def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations: their faults, the cheapest repair and a hash of the repaired turns."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows, copies = damaged(turns)
    reports = repair_reports(plan_repairs(rows, "conv_id", copies))
    every = turns.select(key_of("conv_id").alias("_key"), "conv_id").distinct()
    nothing = hashlib.sha256().hexdigest()
    return every.join(reports, "_key", "left").select(
        "conv_id", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in NUMBERS],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
    )

