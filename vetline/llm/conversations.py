"""Conversation structure repair.

Messages are ordered by a range shuffle and numbered, so that one conversation,
however large, lies in many blocks of at most ``BLOCK`` rows. Every row is a
symbol: the class of its role initial and its fault. The cheapest edits that
give system?, (user, assistant)+ are a shortest path over the four states of
that pattern:

* equal consecutive symbols are runs; a run moves the states' costs by a power of
  its symbol's min-plus transition, multiplied from cached binary powers;
* a block is the product of its runs, a conversation the product of its blocks,
  so each block learns the costs behind it, and then the state it starts in;
* inside a block costs are known at the ends of runs, from where the rows of a
  run are unrolled and the least edit among the cheapest is taken.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vetline.llm.common import stored, table
from vetline.session import ship_package

BLOCK_BITS = 12
SPACE = " \t\n\x0b\f\r"
FINAL_MARKS = ".!?"

# Fixed values of the contract: what edits cost.
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5

# States: nothing yet, behind system, behind user, behind assistant. Role classes:
# s, u, a, any other. The state that a class leads to; -1 where it may not stand.
SYSTEM, USER, ASSISTANT, OTHER = range(4)
NEXT = [[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]]
# Which of user and assistant an inserted or re-roled message is, by state.
WANTED = [USER, USER, ASSISTANT, USER]
LEGAL_PAIRS = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
INITIALS, ROLES = "sua", {USER: "user", ASSISTANT: "assistant"}
SOUND, TRUNCATED, DOOMED = range(3)  # fault kinds of a symbol: class * 3 + kind
FAR = 1 << 58


# ---- min-plus steps -----------------------------------------------------------

def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus product of 4x4 steps, or of a step and a cost vector."""
    if b.ndim == 1:
        return np.minimum((a + b[None, :]).min(axis=1), FAR)
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), FAR)


def _inserts() -> np.ndarray:
    once = np.full((4, 4), FAR)
    for s in range(4):
        once[s, s] = 0
        once[s, NEXT[s][WANTED[s]]] = INSERT
    return times(once, times(once, once))


INSERTS = _inserts()
END = INSERTS[:, [0, 3]].min(axis=1)  # cost from a state to a whole pattern


def step(symbol: int) -> np.ndarray:
    """Any inserts, then one edit of a row with this symbol."""
    cls, kind = divmod(symbol, 3)
    row = np.full((4, 4), FAR)
    for s in range(4):
        row[s, s] = DELETE
        if kind != DOOMED:
            extra = CUT_OFF if kind == TRUNCATED else 0
            to = NEXT[s][WANTED[s]]
            row[s, to] = min(row[s, to], REROLE + extra)
            if NEXT[s][cls] >= 0:
                row[s, NEXT[s][cls]] = min(row[s, NEXT[s][cls]], KEEP + extra)
    return times(INSERTS, row)


_POWERS: dict[int, list[np.ndarray]] = {}


def powers(symbol: int, count: int) -> Iterator[np.ndarray]:
    """The cached binary powers whose product is the symbol's step ``count`` times."""
    known = _POWERS.setdefault(symbol, [])
    bit = 0
    while count >> bit:
        if len(known) <= bit:
            known.append(times(known[-1], known[-1]) if known else step(symbol))
        if count >> bit & 1:
            yield known[bit]
        bit += 1


def runs_of(symbols: list[int]) -> list[tuple[int, int, int]]:
    """(symbol, begin, end) of each stretch of equal symbols."""
    runs, begin = [], 0
    for i in range(1, len(symbols) + 1):
        if i == len(symbols) or symbols[i] != symbols[begin]:
            runs.append((symbols[begin], begin, i))
            begin = i
    return runs


def block_step(symbols: list[int]) -> np.ndarray:
    """The step of a whole block, run by run."""
    whole = None
    for symbol, begin, end in reversed(runs_of(symbols)):
        for power in powers(symbol, end - begin):
            whole = power if whole is None else times(power, whole)
    return whole


def costs(symbols: list[int], right: np.ndarray) -> list[list[int]]:
    """Cost before each row, and behind the last, for every state."""
    found: list[list[int]] = [[]] * len(symbols) + [right.tolist()]
    for symbol, begin, end in reversed(runs_of(symbols)):
        at = right
        for i in range(end - 1, begin, -1):  # inside the run, from its end
            at = times(step_of(symbol), at)
            found[i] = at.tolist()
        for power in powers(symbol, end - begin):
            right = times(power, right)
        found[begin] = right.tolist()
    return found


def step_of(symbol: int) -> np.ndarray:
    return next(powers(symbol, 1))


def unrolled(symbols: list[int], right: np.ndarray, state: int) -> tuple[list[tuple[str, str, int]], int]:
    """Per row: roles inserted before it (initials), its edit, and the class it
    leaves as; and the state behind the block. Among edits of equal cost the
    one with the least initial goes first: D, I, K, R."""
    cost, out = costs(symbols, right), []
    for i, symbol in enumerate(symbols):
        cls, kind = divmod(symbol, 3)
        extra = CUT_OFF if kind == TRUNCATED else 0
        before = ""
        while True:
            left, wanted = cost[i][state], WANTED[state]
            to = NEXT[state][wanted]
            if DELETE + cost[i + 1][state] == left:
                out.append((before, "D", cls))
                break
            if INSERT + cost[i][to] == left:
                before += INITIALS[wanted]
                state = to
                continue
            kept = NEXT[state][cls]
            if kind != DOOMED and kept >= 0 and KEEP + extra + cost[i + 1][kept] == left:
                out.append((before, "K", cls))
                state = kept
            else:
                out.append((before, "R", wanted))
                state = to
            break
    return out, state


def closing(state: int) -> str:
    """Initials of the roles inserted behind the last row."""
    out = ""
    while END[state]:
        out += INITIALS[WANTED[state]]
        state = NEXT[state][WANTED[state]]
    return out


# ---- rows ---------------------------------------------------------------------

def conversation_key(conv_id: Column) -> Column:
    """A string that tells all ids, null included, apart."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit("-"))


def damaged(messages: DataFrame) -> DataFrame:
    """The contract's damage, by ``crc32(conv_id:turn) % 20``; nulls count as one
    space. Returns ``conv`` (see :func:`conversation_key`), turn, role, text."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    kind = F.crc32(F.concat(shown[0], F.lit(":"), shown[1]).cast("binary")) % 20
    rows = messages.select(conversation_key(F.col("conv_id")).alias("conv"), "turn", shown[2].alias("role"),
                           shown[3].alias("text"), kind.alias("kind")).filter("kind <> 0")
    return rows.select(
        "conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", FINAL_MARKS, ""))
        .otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    ).drop("copy")


def numbered(messages: DataFrame) -> DataFrame:
    """``conv``, turn, role, text (no nulls but turn) plus ``mid``, which rises
    along each conversation by turn (nulls first), role and text, and ``block``,
    at most ``2 ** BLOCK_BITS`` consecutive rows. A range shuffle spreads even
    one huge conversation; the stored table fixes the numbers."""
    order = ["conv", "turn", "role", "text"]
    ordered = messages.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    kept = stored(ordered.withColumn("mid", F.monotonically_increasing_id()), "messages")
    return kept.withColumn("block", F.shiftright("mid", BLOCK_BITS))


def symbols(rows: DataFrame) -> DataFrame:
    """``conv``, ``block``, ``mid``, ``fault`` (blank, duplicate, truncated or
    null; the first that holds) and ``symbol``.

    Who repeats an earlier row is found by the smallest row of each digest,
    aggregated before the shuffle, and joined back on the row number: neither
    step gathers a conversation or the copies of a text."""
    told = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    bare = F.rtrim("text", F.lit(SPACE))
    slim = rows.select("conv", "block", "mid", told.alias("told"), F.substring("role", 1, 1).alias("initial"),
                       (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(*FINAL_MARKS)).alias("cut"))
    first = slim.groupBy("conv", "told").agg(F.min("mid").alias("mid")).select("mid", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("cut"), "truncated")
    cls = F.when(F.col("initial") == "s", SYSTEM).when(F.col("initial") == "u", USER).when(
        F.col("initial") == "a", ASSISTANT).otherwise(OTHER)
    kind = F.when(F.col("fault") == "truncated", TRUNCATED).when(F.col("fault").isNull(), SOUND).otherwise(DOOMED)
    marked = slim.join(first, "mid", "left").withColumn("fault", fault)
    return stored(marked.select("conv", "block", "mid", "fault", (cls * 3 + kind).cast("int").alias("symbol")), "symbols")


def _segments(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[dict[str, list]]:
    """Columns of each conversation's part of a block, from rows in that order.
    What is held is one part, at most a block."""
    held: dict[str, list] = {n: [] for n in names}
    at = None
    for batch in batches:
        columns = {n: batch.column(n).to_pylist() for n in names}
        keys = list(zip(columns["conv"], columns["block"]))
        begin = 0
        for i in range(len(keys) + 1):
            if i == len(keys) or keys[i] != at:
                for n in names:
                    held[n].extend(columns[n][begin:i])
                begin = i
                if i < len(keys):
                    if held["conv"]:
                        yield held
                    held, at = {n: [] for n in names}, keys[i]
    if held["conv"]:
        yield held


def _by_segment(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv", "block").sortWithinPartitions("conv", "block", "mid")


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_TEXT, _LONG, _INT, _FLAG = pa.string(), pa.int64(), pa.int32(), pa.bool_()


def segment_steps(marks: DataFrame) -> DataFrame:
    """One row per conversation and block: ``steps`` (its 4x4 step, row by row),
    the classes of its first and last row, and illegal pairs inside."""
    schema = pa.schema([("conv", _TEXT), ("block", _LONG), ("steps", pa.list_(_LONG)), ("first", _INT), ("last", _INT), ("illegal", _LONG)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for part in _segments(batches, ["conv", "block", "symbol"]):
                classes = [s // 3 for s in part["symbol"]]
                wrong = sum(p not in LEGAL_PAIRS for p in zip(classes, classes[1:]))
                yield (part["conv"][0], part["block"][0], block_step(part["symbol"]).ravel().tolist(),
                       classes[0], classes[-1], wrong)
        return _batches(rows(), schema)

    return _by_segment(marks.select("conv", "block", "mid", "symbol")).mapInArrow(
        run, "conv string, block long, steps array<long>, first int, last int, illegal long")


def _costs_behind(group: pd.DataFrame) -> pd.DataFrame:
    """Costs behind each block of one conversation, and its totals on the first."""
    group = group.sort_values("block")
    at, behind = END, []
    for steps in reversed(group["steps"].tolist()):
        behind.append(at.tolist())
        at = times(np.array(steps).reshape(4, 4), at)
    edges = sum(p not in LEGAL_PAIRS for p in zip(group["last"].tolist(), group["first"].tolist()[1:]))
    head = np.arange(len(group)) == 0
    return pd.DataFrame({"conv": group["conv"], "block": group["block"], "behind": behind[::-1],
                         "ends": np.arange(len(group)) == len(group) - 1, "cost": np.where(head, at[0], 0),
                         "illegal": group["illegal"] + np.where(head, edges, 0)})


def _states_at(group: pd.DataFrame) -> pd.DataFrame:
    """The state each block of one conversation starts in."""
    group = group.sort_values("block")
    state, starts = 0, []
    for leads in group["leads"].tolist():
        starts.append(state)
        state = int(leads[state])
    return pd.DataFrame({"conv": group["conv"], "block": group["block"], "state": starts})


def plans(marks: DataFrame) -> DataFrame:
    """One row per conversation and block: ``behind`` (costs behind it), ``state``
    (where it starts), ``ends`` (the last block), ``cost`` and ``illegal`` (their
    sums over blocks are the conversation's). Conversations in one block need no
    further look; of others one short row per block meets."""
    steps = stored(segment_steps(marks), "steps")
    split = steps.groupBy("conv").count().filter("count > 1").select("conv")
    end = F.array(*[F.lit(int(c)) for c in END])
    alone = steps.join(split, "conv", "left_anti").select(
        "conv", "block", end.cast("array<long>").alias("behind"), F.lit(True).alias("ends"),
        F.array_min(F.zip_with(F.slice("steps", 1, 4), end, lambda a, b: a + b)).alias("cost"), "illegal",
        F.lit(0).alias("state"))
    several = stored(steps.join(split, "conv").groupBy("conv").applyInPandas(
        _costs_behind, "conv string, block long, behind array<long>, ends boolean, cost long, illegal long"), "behind")
    schema = pa.schema([("conv", _TEXT), ("block", _LONG), ("leads", pa.list_(_INT))])

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(((p["conv"][0], p["block"][0], [
            unrolled(p["symbol"], np.array(p["behind"][0]), s)[1] for s in range(4)])
            for p in _segments(batches, ["conv", "block", "symbol", "behind"])), schema)

    told = marks.select("conv", "block", "mid", "symbol").join(several.select("conv", "block", "behind"), ["conv", "block"])
    leads = _by_segment(told).mapInArrow(lead, "conv string, block long, leads array<int>")
    starts = leads.groupBy("conv").applyInPandas(_states_at, "conv string, block long, state int")
    return stored(alone.unionByName(several.join(starts, ["conv", "block"])), "plans")


def edits(marks: DataFrame, planned: DataFrame) -> DataFrame:
    """One row per message: ``mid``, ``before`` (initials of roles inserted before
    it), ``edit`` (D, K or R), ``role_to`` (the role of a re-roled message) and
    ``behind`` (initials of roles inserted behind a conversation's last)."""
    schema = pa.schema([("mid", _LONG), ("before", _TEXT), ("edit", _TEXT), ("role_to", _TEXT), ("behind", _TEXT)])
    names = ["conv", "block", "mid", "symbol", "behind", "state", "ends"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for p in _segments(batches, names):
                made, state = unrolled(p["symbol"], np.array(p["behind"][0]), p["state"][0])
                last = len(made) - 1
                for i, (mid, (before, edit, cls)) in enumerate(zip(p["mid"], made)):
                    yield (mid, before, edit, ROLES[cls] if edit == "R" else None,
                           closing(state) if i == last and p["ends"][0] else "")
        return _batches(rows(), schema)

    told = marks.select("conv", "block", "mid", "symbol").join(
        planned.select("conv", "block", "behind", "state", "ends"), ["conv", "block"])
    return _by_segment(told).mapInArrow(run, "mid long, before string, edit string, role_to string, behind string")


def repaired_rows(rows: DataFrame, made: DataFrame) -> DataFrame:
    """The repaired messages: ``conv``, ``mid``, ``at`` (place among the messages
    that come from one row), role and text; ``mid`` and ``at`` order them."""
    inserted = lambda c: F.transform(F.split(c, ""), lambda i: F.struct(
        F.when(i == "u", "user").when(i == "a", "assistant").alias("role"), F.lit("").alias("text")))
    own = F.struct(F.coalesce("role_to", "role").alias("role"), F.col("text").alias("text"))
    listed = F.filter(F.concat(inserted(F.col("before")), F.when(F.col("edit") != "D", F.array(own)).otherwise(F.array().cast(
        "array<struct<role:string,text:string>>")), inserted(F.col("behind"))), lambda m: m["role"].isNotNull())
    return rows.join(made, "mid").select("conv", "mid", F.posexplode(listed).alias("at", "message")).select(
        "conv", "mid", "at", "message.role", "message.text")


def digests(rows: DataFrame, made: DataFrame) -> DataFrame:
    """``conv``, ``audit`` and ``repaired_sha256``.

    A digest of one text is sequential by definition, so a conversation's rows
    pass one task in order (sorted by Spark, which spills) and only the running
    digest and the audit are held; all other steps work on blocks."""
    schema = pa.schema([("conv", _TEXT), ("audit", _TEXT), ("repaired_sha256", _TEXT)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lines():
            at, audit, digest, glue = None, [], None, ""
            for batch in batches:
                for conv, before, edit, role, text, behind in zip(*(batch.column(n).to_pylist() for n in (
                        "conv", "before", "edit", "role", "text", "behind"))):
                    if conv != at:
                        if at is not None:
                            yield at, "".join(audit), digest.hexdigest()
                        at, audit, digest, glue = conv, [], hashlib.sha256(), ""
                    own = [] if edit == "D" else [(role, text)]
                    for r, t in [*((ROLES[INITIALS.index(i)], "") for i in before), *own,
                                 *((ROLES[INITIALS.index(i)], "") for i in behind)]:
                        digest.update(f"{glue}{r}:{t}".encode())
                        glue = "\n"
                    audit.append("I" * len(before) + edit + "I" * len(behind))
            if at is not None:
                yield at, "".join(audit), digest.hexdigest()
        return _batches(lines(), schema)

    joined = rows.join(made, "mid").select("conv", "mid", "before", "edit", F.coalesce("role_to", "role").alias("role"),
                                           "text", "behind")
    ordered = joined.repartition("conv").sortWithinPartitions("conv", "mid")
    return ordered.mapInArrow(run, "conv string, audit string, repaired_sha256 string")


def repair(messages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``messages`` (``conv``, turn, role, text) to their numbered rows, symbols,
    plans and edits. Rows that repeat each other are duplicates; a null turn comes
    first; an empty table gives empty tables."""
    ship_package(messages.sparkSession)
    rows = numbered(messages)
    marks = symbols(rows)
    planned = plans(marks)
    return rows, marks, planned, stored(edits(marks, planned), "edits")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = table(spark, sf_dir, "conversations")
    rows, marks, planned, made = repair(damaged(messages))
    kinds = [F.count_if(F.col("fault") == k).alias(k) for k in ("blank", "duplicate", "truncated")]
    turns = rows.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    told = (marks.groupBy("conv").agg(*kinds)
            .join(planned.groupBy("conv").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost")), "conv")
            .join(turns, "conv").join(digests(rows, made), "conv"))
    every = messages.select("conv_id").distinct().withColumn("conv", conversation_key(F.col("conv_id")))
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in (
        "gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(told, "conv", "left").select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


# The same by recursion row by row: costs from the last row to the first, then
# the edits from the first to the last; crc32 bit by bit.
OP13_SQL = r"""
WITH RECURSIVE told AS (
  SELECT conv_id, coalesce('=' || conv_id::VARCHAR, '-') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
  FROM conversations
), hurt AS (
  SELECT conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM (SELECT *, (4294967295 - list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(8 * length(k)),
        lambda b: CASE WHEN b % 8 = 0 THEN ord(substr(k, (b // 8 + 1)::INT, 1))::BIGINT ELSE 0::BIGINT END)),
      lambda c, b: CASE WHEN xor(c, b) % 2 = 1 THEN xor(xor(c, b) >> 1, 3988292384::BIGINT) ELSE xor(c, b) >> 1 END)) % 20 AS kind
    FROM told)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, left(role, 1) AS cls
  FROM hurt
), rows_ AS MATERIALIZED (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
    count(*) OVER (PARTITION BY conv) AS n,
    lag(cls) OVER (PARTITION BY conv ORDER BY i) || cls AS pair
  FROM placed
), marked AS MATERIALIZED (
  SELECT conv, i, n, role, text, cls, coalesce(fault IN ('blank', 'duplicate'), false) AS doomed, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS e FROM rows_
), back AS (
  SELECT DISTINCT conv, n + 1 AS i, [0, 10, 5, 0] AS v FROM marked
  UNION ALL
  SELECT conv, i, [least(r[1], 5 + r[3], 10 + r[4]), least(r[2], 5 + r[3], 10 + r[4]), least(r[3], 5 + r[4]), least(r[4], 5 + r[3], 10 + r[4])]
  FROM (SELECT m.conv, m.i, [
      least(2 + v[1], CASE WHEN NOT doomed THEN 1 + e + v[3] END, CASE WHEN NOT doomed AND cls = 's' THEN e + v[2] WHEN NOT doomed AND cls = 'u' THEN e + v[3] END),
      least(2 + v[2], CASE WHEN NOT doomed THEN 1 + e + v[3] END, CASE WHEN NOT doomed AND cls = 'u' THEN e + v[3] END),
      least(2 + v[3], CASE WHEN NOT doomed THEN 1 + e + v[4] END, CASE WHEN NOT doomed AND cls = 'a' THEN e + v[4] END),
      least(2 + v[4], CASE WHEN NOT doomed THEN 1 + e + v[3] END, CASE WHEN NOT doomed AND cls = 'u' THEN e + v[3] END)] AS r
    FROM back b JOIN marked m ON m.conv = b.conv AND m.i = b.i - 1)
), costs AS MATERIALIZED (SELECT * FROM back), walk AS (
  SELECT DISTINCT conv, 1::BIGINT AS i, n, 1 AS s, '' AS audit, []::VARCHAR[] AS lines FROM marked
  UNION ALL
  SELECT conv, CASE WHEN edit = 'I' THEN i ELSE i + 1 END, n,
    CASE edit WHEN 'D' THEN s WHEN 'K' THEN CASE cls WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END ELSE t END,
    audit || edit,
    CASE edit WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text)
      WHEN 'R' THEN list_append(lines, wanted || ':' || text) ELSE list_append(lines, wanted || ':') END
  FROM (
    SELECT w.*, m.role, m.text, m.cls, CASE WHEN s = 3 THEN 4 ELSE 3 END AS t, CASE WHEN s = 3 THEN 'assistant' ELSE 'user' END AS wanted,
      CASE WHEN 2 + x.v[s] = c.v[s] THEN 'D'
        WHEN c.v[s] = 5 + c.v[CASE WHEN s = 3 THEN 4 ELSE 3 END] THEN 'I'
        WHEN NOT m.doomed AND (m.cls = 's' AND s = 1 AND m.e + x.v[2] = c.v[s] OR m.cls = 'u' AND s <> 3 AND m.e + x.v[3] = c.v[s]
          OR m.cls = 'a' AND s = 3 AND m.e + x.v[4] = c.v[s]) THEN 'K'
        WHEN m.i IS NOT NULL THEN 'R' END AS edit
    FROM walk w JOIN costs c ON c.conv = w.conv AND c.i = w.i
    LEFT JOIN costs x ON x.conv = w.conv AND x.i = w.i + 1
    LEFT JOIN marked m ON m.conv = w.conv AND m.i = w.i)
  WHERE edit IS NOT NULL
), ended AS (
  SELECT conv, audit, lines FROM walk WHERE i = n + 1 AND s IN (1, 4)
  QUALIFY row_number() OVER (PARTITION BY conv ORDER BY length(audit)) = 1
), stats AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows_ GROUP BY conv
)
SELECT t.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(c.v[1], 0)::BIGINT AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, conv FROM told) t
LEFT JOIN stats USING (conv) LEFT JOIN ended USING (conv) LEFT JOIN costs c ON c.conv = t.conv AND c.i = 1
"""
