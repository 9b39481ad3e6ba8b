"""Repair of conversation structure: the cheapest edits that make a row sequence follow a grammar.

A sound conversation is an optional system row and then pairs of a user and an assistant row,
or nothing at all. Rows are kept, given another role, deleted, and empty rows are
inserted; blank and repeated rows must go, and a truncated row costs extra if it stays. The repair is a
weighted parse. A nonterminal stands for two states of the pattern's automaton and
derives the rows that lead from the one to the other; its rules in Chomsky normal form are

    [p q] -> [p r] [r q]        [p q] -> one edited row        (and insertions, below)

A cell of the chart holds, for a span of rows and every nonterminal, the least (cost, audit), the
audit being the edits' initials in order. Insertions cover no rows, so each cell is closed under
them: the cheapest insertions between every two states, on either side. Spans are combined bottom-up by
length. Equal cost never goes with an audit that begins another audit of the same cell (what one has more
could only be insertions, and they cost), so the least audit of two spans is that of their least ones.

A cell depends on its rows' symbols alone (nine of them), so spans of up to ``SPAN`` rows, all
split points tried, are parsed once a task and remembered. As nonterminals concatenate associatively,
longer spans need one split point: equal spans double. One shuffle ranges all rows by conversation
and turn, so a conversation that holds a third of all rows is parsed by a third of the tasks, in
fragments, and fragments are joined in order; the rows streamed there hold no text. Only the digest of
the repaired text takes a conversation through one task, as a stream that remembers one audit.

Null role and text count as one space. Rows go by turn (nulls first), then role, then the sha256 of the text.
A null conv_id is a conversation as well. A role's initial is its first character; roles that start with
another than s, u or a cannot stay.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routescope.llm.tables import saved
from routescope.session import ship_package

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
STEPS = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}  # start, after system, after user, after assistant
ENDS = (0, 3)
SPAN = 8
SALTS = 16

SPACES = r"\x20\x09-\x0D"


# The chart ---------------------------------------------------------------------------------

Cell = dict[tuple[int, int], tuple[int, str]]


def _least(cell: Cell, key: tuple[int, int], entry: tuple[int, str]) -> None:
    if key not in cell or entry < cell[key]:
        cell[key] = entry


def joined(left: Cell, right: Cell) -> Cell:
    """[p q] -> [p r] [r q]"""
    out: Cell = {}
    for (p, r), (cost, audit) in left.items():
        for (s, q), (more, rest) in right.items():
            if r == s:
                _least(out, (p, q), (cost + more, audit + rest))
    return out


def _insertions() -> Cell:
    """The cheapest insertions from state to state, none among them."""
    closure: Cell = {(p, p): (0, "") for p in STEPS}
    for p, steps in STEPS.items():
        for role, q in steps.items():
            if role in ROLES:
                _least(closure, (p, q), (INSERT, "I"))
    while (wider := joined(closure, closure)) != closure:
        closure = wider
    return closure


INSERTIONS = _insertions()


@lru_cache(maxsize=1 << 16)
def chart(symbols: str) -> Cell:
    """The cell of a span of one to ``SPAN`` rows, from those of all shorter spans within it.

    Symbols: ``d`` must go; else the role's initial or ``x``, in upper case if truncated."""
    if len(symbols) == 1:
        row: Cell = {(p, p): (DELETE, "D") for p in STEPS}
        if symbols != "d":
            extra, role = TRUNCATED * symbols.isupper(), symbols.lower()
            for p, steps in STEPS.items():
                for kind, q in steps.items():
                    if kind == role:
                        _least(row, (p, q), (extra, "K"))
                    if kind in ROLES:
                        _least(row, (p, q), (extra + REROLE, "R"))
        return joined(joined(INSERTIONS, row), INSERTIONS)
    out: Cell = {}
    for cut in range(1, len(symbols)):
        for key, entry in joined(chart(symbols[:cut]), chart(symbols[cut:])).items():
            _least(out, key, entry)
    return out


class Parse:
    """The cell of a growing sequence: parsed spans, each at least twice as long as the next."""

    def __init__(self):
        self.spans: list[tuple[int, Cell]] = []
        self.open = ""

    def feed(self, symbol: str) -> None:
        self.open += symbol
        if len(self.open) == SPAN:
            self._shut()

    def _shut(self) -> None:
        if self.open:
            self.spans.append((1, chart(self.open)))
            self.open = ""
        while len(self.spans) > 1 and self.spans[-1][0] == self.spans[-2][0]:
            (n, right), (_, left) = self.spans.pop(), self.spans.pop()
            self.spans.append((2 * n, joined(left, right)))

    def cell(self) -> Cell:
        self._shut()
        out = INSERTIONS
        for _, span in reversed(self.spans):
            out = joined(span, out)
        return out


def cheapest(from_start: Cell) -> tuple[int, str]:
    """The least (cost, audit) that ends in a final state."""
    return min(entry for (p, q), entry in from_start.items() if p == 0 and q in ENDS)


# Rows --------------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy) after the damage that a hash of conversation and turn decides."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(name) % 20).alias("h"))
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("h") == 4, "user").otherwise(F.col("role"))
    left = rows.where("h <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("h") == 3, 2).otherwise(1).alias("n"))
    return numbered(left, F.sum("n"))


def numbered(rows: DataFrame, n: Column | None = None) -> DataFrame:
    """(conv_id, turn, role, text, copy): equal rows are counted and numbered, so that each has a place of its own."""
    counted = rows.groupBy("conv_id", "turn", "role", "text").agg((F.count("*") if n is None else n).alias("n"))
    return counted.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("copy"))


ORDER = ["conv_id", "later", "role", "digest", "copy"]  # of rows; ``later`` puts null turns first


def _ordered(rows: DataFrame) -> DataFrame:
    later = F.struct(F.col("turn").isNotNull().alias("set"), "turn")
    return rows.withColumns({"later": later, "digest": F.unhex(F.sha2("text", 256))})


def faults(rows: DataFrame) -> DataFrame:
    """Adds ``fault``: blank, duplicate, truncated or null, the first that a row has.

    ``copy`` tells rows apart that are equal in all else. Of the rows with one role and text the first by turn is no
    duplicate; only roles and texts seen more than once are looked up, their rows spread by turn."""
    rows = _ordered(rows)
    at = F.struct("later", "copy")
    seen = rows.groupBy("conv_id", "role", "digest").agg(F.count("*").alias("n"), F.min(at).alias("first")).where("n > 1")
    seen = seen.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("t"), "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("z"))
    salt = F.pmod(F.xxhash64("later", "copy"), F.lit(SALTS))
    keyed = rows.withColumns({"salt": salt, "blank": ~F.col("text").rlike(f"[^{SPACES}]")})
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("t")) & (F.col("salt") == F.col("z"))
    found = keyed.join(seen, same, "left")
    fault = (
        F.when(F.col("blank"), "blank")
        .when(F.coalesce(at != F.col("first"), F.lit(False)), "duplicate")
        .when(~F.col("text").rlike(f"[.!?][{SPACES}]*\\z"), "truncated"))
    return found.withColumn("fault", fault).select("conv_id", "turn", "role", "text", "copy", "later", "digest", "fault")


def _initial() -> Column:
    return F.substring("role", 1, 1)


def _symbol() -> Column:
    kind = F.when(_initial().isin("s", "u", "a"), _initial()).otherwise("x")
    return F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", F.upper(kind)).otherwise(kind)


FRAGMENT = "conv_id bigint, part int, illegal bigint, first string, last string, p array<int>, q array<int>, cost array<bigint>, audit array<string>"


def fragments(marked: DataFrame) -> DataFrame:
    """One row for each conversation and task: its cell, the initials at its ends, and the illegal neighbours within."""
    thin = marked.select(*ORDER, _symbol().alias("symbol"), _initial().alias("initial"))
    laid = thin.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).select("conv_id", "symbol", "initial")

    def run(batches):
        part = TaskContext.get().partitionId()

        def ended(s):
            cell = list(s["parse"].cell().items())
            return {"conv_id": s["conv"], "part": part, "illegal": s["illegal"], "first": s["first"], "last": s["last"], "p": [p for (p, _), _ in cell],
                    "q": [q for (_, q), _ in cell], "cost": [c for _, (c, _) in cell], "audit": [a for _, (_, a) in cell]}

        state = None
        for batch in batches:
            done = []
            for conv, symbol, initial in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                if state is None or state["conv"] != conv:
                    if state is not None:
                        done.append(ended(state))
                    state = {"conv": conv, "parse": Parse(), "illegal": 0, "first": initial, "last": None}
                if state["last"] is not None and state["last"] + initial not in ("su", "ua", "au"):
                    state["illegal"] += 1
                state["parse"].feed(symbol)
                state["last"] = initial
            yield _batch(done, FRAGMENT)
        if state is not None:
            yield _batch([ended(state)], FRAGMENT)

    ship_package(marked.sparkSession)
    return laid.mapInArrow(run, FRAGMENT)


_KINDS = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<int>": pa.list_(pa.int32()),
          "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


def _batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[name] for r in rows], _KINDS[kind]) for name, kind in fields], [name for name, _ in fields])


PARSED = "conv_id bigint, illegal bigint, cost bigint, audit string"


def parsed(pieces: DataFrame) -> DataFrame:
    """(conv_id, illegal, cost, audit) of each conversation, from its fragments in order."""
    laid = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part")

    def run(batches):
        def ended(s):
            cost, audit = cheapest(s["cell"])
            return {"conv_id": s["conv"], "illegal": s["illegal"], "cost": cost, "audit": audit}

        state = None
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if state is None or state["conv"] != r["conv_id"]:
                    if state is not None:
                        done.append(ended(state))
                    state = {"conv": r["conv_id"], "cell": {k: e for k, e in INSERTIONS.items() if k[0] == 0}, "illegal": 0, "last": None}
                state["illegal"] += r["illegal"] + (state["last"] is not None and state["last"] + r["first"] not in ("su", "ua", "au"))
                state["last"] = r["last"]
                state["cell"] = joined(state["cell"], dict(zip(zip(r["p"], r["q"]), zip(r["cost"], r["audit"]))))
            yield _batch(done, PARSED)
        if state is not None:
            yield _batch([ended(state)], PARSED)

    ship_package(pieces.sparkSession)
    return laid.mapInArrow(run, PARSED)


class Writer:
    """Applies an audit to rows fed in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def _given(self, text: str) -> tuple[str, str]:
        role = next(r for r in STEPS[self.state] if r in ROLES)
        self.state = STEPS[self.state][role]
        return ROLES[role], text

    def inserted(self) -> list[tuple[str, str]]:
        """The rows to insert before the next one fed, or at the end."""
        out = []
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            out.append(self._given(""))
        return out

    def feed(self, role: str, text: str) -> list[tuple[str, str]]:
        out = self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = STEPS[self.state][role[0]]
            out.append((role, text))
        elif edit == "R":
            out.append(self._given(text))
        return out


REPAIRED = "conv_id bigint, piece bigint, role string, text string"


def repaired(marked: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, piece, role, text): the rows of each repaired conversation, numbered, in order within partitions."""
    kept = marked.select("conv_id", F.lit(1).alias("tag"), *ORDER[1:], "text", F.lit(None).cast("string").alias("audit"))
    heads = audits.select("conv_id", F.lit(0).alias("tag"), *[F.lit(None).cast(kept.schema[c].dataType).alias(c) for c in (*ORDER[1:], "text")], "audit")
    laid = kept.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "tag", *ORDER[1:]).select("conv_id", "tag", "role", "text", "audit")

    def run(batches):
        conv, writer, n = None, None, 0
        for batch in batches:
            out = []

            def put(rows):
                nonlocal n
                for role, text in rows:
                    out.append({"conv_id": conv, "piece": n, "role": role, "text": text})
                    n += 1

            for c, tag, role, text, audit in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                if tag == 0:
                    if writer is not None:
                        put(writer.inserted())
                    conv, writer, n = c, Writer(audit), 0
                else:
                    put(writer.feed(role, text))
            yield _batch(out, REPAIRED)
        if writer is not None:
            yield _batch([{"conv_id": conv, "piece": n + i, "role": r, "text": t} for i, (r, t) in enumerate(writer.inserted())], REPAIRED)

    ship_package(marked.sparkSession)
    return laid.mapInArrow(run, REPAIRED)


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of repaired rows as they stream by in order; only conversations with rows."""

    schema = "conv_id bigint, repaired_sha256 string"

    def run(batches):
        state = None
        for batch in batches:
            done = []
            for conv, piece, role, text in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if piece == 0:
                    if state is not None:
                        done.append({"conv_id": state[0], "repaired_sha256": state[1].hexdigest()})
                    state = (conv, hashlib.sha256())
                state[1].update((("\n" if piece else "") + f"{role}:{text}").encode())
            yield _batch(done, schema)
        if state is not None:
            yield _batch([{"conv_id": state[0], "repaired_sha256": state[1].hexdigest()}], schema)

    return rows.mapInArrow(run, schema)


def counts(marked: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated)."""
    kinds = ("blank", "duplicate", "truncated")
    turns = marked.groupBy("conv_id", "turn").agg(*[F.count_if(F.col("fault") == k).alias(k) for k in kinds])
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
    return turns.groupBy("conv_id").agg(gaps.cast("bigint").alias("gaps"), *[F.sum(k).cast("bigint").alias(k) for k in kinds])


def report(conversations: DataFrame, marked: DataFrame) -> DataFrame:
    """A row for every conversation of ``conversations``, from the marked rows that are left of it."""
    marked = saved(marked, "marked")
    audits = saved(parsed(fragments(marked)), "audits")
    written = digests(repaired(marked, audits.select("conv_id", "audit")))
    out = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    for facts in (counts(marked), audits, written):
        out = out.alias("o").join(facts.withColumnRenamed("conv_id", "c"), F.col("o.conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def twin() -> str:
    """The contract's query in SQL: states of the automaton carried row by row, each the least of (cost, audit)."""
    crc = """xor(4294967295, list_reduce(list_transform(range(1, len(k) + 1), lambda i: CAST(ascii(k[i]) AS BIGINT)), lambda c, b:
      list_reduce(range(8), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)), CAST(4294967295 AS BIGINT)))"""
    # entries are texts, cost in ten digits before the audit, so that the least text is the least entry
    add = lambda e, cost, letter: f"lpad(CAST(CAST(left({e}, 10) AS BIGINT) + ({cost}) AS VARCHAR), 10, '0') || substr({e}, 11) || '{letter}'"
    none = "'9000000000'"
    extra = f"CASE WHEN fault = 'truncated' THEN {TRUNCATED} ELSE 0 END"
    stays = "coalesce(fault, '') NOT IN ('blank', 'duplicate')"

    def arrive(q):
        ways = [add(f"e{q}", DELETE, "D")]
        for p, steps in STEPS.items():
            for role, to in steps.items():
                if to == q:
                    ways.append(f"CASE WHEN {stays} AND left(role, 1) = '{role}' THEN {add(f'e{p}', extra, 'K')} ELSE {none} END")
                    if role in ROLES:
                        ways.append(f"CASE WHEN {stays} THEN {add(f'e{p}', f'{extra} + {REROLE}', 'R')} ELSE {none} END")
        return f"least({', '.join(ways)})"

    def insert(q, source):
        ways = [add(f"{source}{p}", cost, letters) for (p, to), (cost, letters) in INSERTIONS.items() if to == q]
        return f"least({', '.join(ways)}) AS e{q}"

    inserted = ", ".join(insert(q, "r") for q in STEPS)
    begun = {q: INSERTIONS.get((0, q), (9000000000, "")) for q in STEPS}
    start = ", ".join(f"'{cost:010d}{letters}' AS e{q}" for q, (cost, letters) in begun.items())
    return f"""WITH RECURSIVE given AS MATERIALIZED (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS h
  FROM (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations)),
hurt AS (SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
  FROM given JOIN (SELECT unnest([0, 1]) AS copy) ON copy = 0 OR h = 3 WHERE h <> 0),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos FROM hurt),
marked AS MATERIALIZED (SELECT *, CASE WHEN NOT regexp_matches(text, '[^{SPACES}]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][{SPACES}]*$') THEN 'truncated' END AS fault,
  left(lag(role) OVER (PARTITION BY conv_id ORDER BY pos), 1) || left(role, 1) AS pair, count(*) OVER (PARTITION BY conv_id) AS n FROM placed),
start AS (SELECT {start}),
walk AS (SELECT m.conv_id, CAST(0 AS BIGINT) AS pos, s.* FROM (SELECT DISTINCT conv_id FROM marked) m CROSS JOIN start s
  UNION ALL SELECT conv_id, pos, {inserted} FROM (
    SELECT m.conv_id, m.pos, {', '.join(f"{arrive(q)} AS r{q}" for q in STEPS)} FROM walk w JOIN marked m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.pos = w.pos + 1)),
best AS MATERIALIZED (SELECT w.conv_id, least(w.e0, w.e3) AS e FROM walk w JOIN (SELECT conv_id, max(pos) AS pos FROM marked GROUP BY conv_id) m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.pos = w.pos),
letters AS (SELECT conv_id, substr(e, 11) AS audit, unnest(range(1, len(e) - 9)) AS i FROM best),
edits AS (SELECT conv_id, i, audit[i] AS edit, CASE WHEN audit[i] <> 'I' THEN len(replace(audit[1:i], 'I', '')) END AS pos,
  len(replace(audit[1:i], 'D', '')) AS out_pos, len(replace(audit, 'D', '')) AS outs FROM letters),
written AS (SELECT e.conv_id, sha256(string_agg(CASE WHEN e.edit = 'K' THEN m.role WHEN (e.outs - e.out_pos) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e.edit = 'I' THEN '' ELSE m.text END, chr(10) ORDER BY e.i)) AS sha
  FROM edits e LEFT JOIN marked m ON m.conv_id IS NOT DISTINCT FROM e.conv_id AND m.pos = e.pos WHERE e.edit <> 'D' GROUP BY e.conv_id),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY conv_id)
SELECT o.conv_id, CAST(coalesce(f.gaps, 0) AS BIGINT) AS gaps, coalesce(f.blank, 0) AS blank, coalesce(f.duplicate, 0) AS duplicate, coalesce(f.truncated, 0) AS truncated, coalesce(f.illegal, 0) AS illegal,
  CAST(coalesce(left(b.e, 10), '0') AS BIGINT) AS cost, coalesce(substr(b.e, 11), '') AS audit, coalesce(w.sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN written w ON w.conv_id IS NOT DISTINCT FROM o.conv_id"""
