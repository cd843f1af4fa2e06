"""Conversation structure repair: faults of every row, then least-cost edits under the role grammar.

Rows are numbered in slices (:mod:`quire.plans.scan`), so a conversation that
holds a third of all rows is read by many tasks.  Only conversations that lie in
several slices need the slice maps of :mod:`quire.llm.roles`: one small row a slice,
put together per conversation, which tells each slice the stack top it begins
and ends with.  Then every slice is repaired on its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scan import CHUNK, key_name, number_rows
from .common import pick, short_batches
from .roles import CUT_OFF, DELETE, FINE, GONE, INSERT, KEEP, REROLE, ROLES, TRUNCATED, Repair

#: White space, what ends a sentence.
SPACE, STOP = r"\x20\x09-\x0D", r"[.!?]"
KEY = key_name(["conv_id"])
EDIT_COST = {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}


def _rows(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """The four columns, role and text as strings with one space for null."""
    rows = pick(conversations, conv_id=conv, turn=turn, role=role, text=text)
    return rows.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text")})


def damage(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows harmed by the CRC-32 of ``conv_id:turn`` modulo 20 (null: one space): 0 drops the row, 1 empties
    its text, 2 removes ``.!?`` from it, 3 repeats the row, 4 makes it the user's."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    harm = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    rows = _rows(conversations, conv, turn, role, text).withColumn("h", harm)
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("h") == 0, 0).when(F.col("h") == 3, 2).otherwise(1)))
    new_text = F.when(F.col("h") == 1, F.lit("")).when(F.col("h") == 2, F.regexp_replace("text", STOP, "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("h") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                       new_text.alias("text"), copies.alias("c"))
    return rows.drop("c")


def faults(rows: DataFrame) -> DataFrame:
    """Numbered rows of ``(conv_id, turn, role, text)`` with ``number, initial, before`` (initial of the
    row before, null at the first) and ``fault``: blank, duplicate, truncated or null, the first that holds."""
    alike = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    rows = rows.withColumns({"alike": alike, "initial": F.substring("role", 1, 1)})
    rows = number_rows(rows, ["conv_id"], ["turn", "role", "alike"], prev={"before": F.col("initial")})
    first = rows.groupBy(KEY, "alike").agg(F.min("number").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    rows = rows.join(first, [KEY, "alike"], "left")
    fault = (F.when(~F.col("text").rlike(rf"[^{SPACE}]"), F.lit("blank")).when(F.col("number") > F.col("first"), F.lit("duplicate"))
             .when(~F.col("text").rlike(rf"{STOP}[{SPACE}]*\z"), F.lit("truncated")))
    return rows.withColumn("fault", fault).drop("alike", "first")


def _by_slice(df: DataFrame) -> DataFrame:
    """Rows of a slice in one task, in order.  Dealt by a hash: Spark leaves out a repartition by columns that a join
    below it has dealt by already, and adaptive execution may then read that join's shuffle another way."""
    return df.repartition(F.xxhash64(KEY, CHUNK)).sortWithinPartitions(KEY, CHUNK, "number")


def _slices(batches, columns: list[str]) -> Iterator[tuple[tuple, dict[str, list]]]:
    """``((key, chunk), columns of its rows)`` of batches sorted by key, chunk and number."""
    at, held = None, {c: [] for c in columns}
    for batch in batches:
        values = {c: batch.column(c).to_pylist() for c in columns}
        ids = list(zip(batch.column(KEY).to_pylist(), batch.column(CHUNK).to_pylist()))
        begin = 0
        for i in range(1, len(ids) + 1):
            if i < len(ids) and ids[i] == ids[begin]:
                continue
            if ids[begin] != at:
                if at is not None:
                    yield at, held
                at, held = ids[begin], {c: [] for c in columns}
            for c in columns:
                held[c] += values[c][begin:i]
            begin = i
    if at is not None:
        yield at, held


def _classes(rows: dict[str, list]) -> list[tuple[str, int]]:
    kinds = {"blank": GONE, "duplicate": GONE, "truncated": CUT_OFF, None: FINE}
    return [(i if i in ROLES else "", kinds[f]) for i, f in zip(rows["initial"], rows["fault"])]


def _maps(batches):
    repair = Repair()
    for (key, chunk), rows in _slices(batches, ["initial", "fault"]):
        cost, rank = repair.slice_map(_classes(rows))
        yield pa.RecordBatch.from_pylist([{KEY: key, CHUNK: chunk, "cost": cost, "rank": rank}])


def _chain(maps: pa.Table) -> pa.Table:
    maps = maps.sort_by(CHUNK)
    ways = Repair().chain(zip(maps["cost"].to_pylist(), maps["rank"].to_pylist()))
    n = len(ways)
    return pa.table({KEY: maps[KEY], CHUNK: maps[CHUNK], "entry": pa.array([w[0] for w in ways], pa.int32()),
                     "leave": pa.array([w[1] for w in ways], pa.int32()), "last": pa.array([i == n - 1 for i in range(n)], pa.bool_())})


def repair(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per edit: ``conv_id, number, part, turn, role, text, fault, illegal, edit, cost``, by number and part in order.

    The rows of a conversation, by turn (nulls first; ties by role, then by a digest of role and
    text), are kept (``K``), given another role (``R``), deleted (``D``; always if blank or a
    duplicate of an earlier row), or have empty rows inserted around them (``I``, ``number`` of
    the row they stand before, or of the last one), so that the role initials left are
    ``(s?(ua)+)?``.  The edits have the least cost, and of those the least audit in ASCII order.
    ``role`` and ``text`` are those after the edit, ``cost`` is the edit's, with that of an
    undeleted truncated row; ``illegal`` marks a row whose initial may not follow the one before.

    * null role or text: one space (no initial of the grammar; blank); an empty role has no initial;
    * null conv_id: these rows are one conversation; null turn: before all others;
    * repeated rows: all but the first are duplicates; texts of any length are read whole;
    * empty table: no rows.  Columns not named are ignored.
    """
    spark = conversations.sparkSession
    short_batches(spark)
    rows = faults(_rows(conversations, conv, turn, role, text))
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}

    # conversations in several slices: the tops that each slice begins and ends with
    parts = rows.groupBy(KEY, CHUNK).agg(F.lit(1).alias("one"))
    several = parts.groupBy(KEY).agg(F.count("*").alias("n")).filter("n > 1").select(KEY)
    narrow = rows.select(KEY, CHUNK, "number", "initial", "fault").join(several, KEY, "left_semi")
    maps = _by_slice(narrow).mapInArrow(
        _maps, f"{KEY} string, {CHUNK} bigint, cost array<array<bigint>>, rank array<array<bigint>>")
    chosen = maps.groupBy(KEY).applyInArrow(_chain, f"{KEY} string, {CHUNK} bigint, entry int, leave int, last boolean")

    carried = ["number", "turn", "role", "text", "initial", "before", "fault", "conv_id", "entry", "leave", "last"]
    names = ["conv_id", "number", "part", "turn", "role", "text", "fault", "illegal", "edit", "cost"]
    types = f"{KEY} string, {CHUNK} bigint, conv_id {kind['conv_id']}, number bigint, part int, turn {kind['turn']}, role string, text string, " \
            "fault string, illegal boolean, edit string, cost bigint"

    def edit(batches):
        repairs = Repair()
        for batch_of in _slices(batches, carried):
            (key, chunk), r = batch_of
            entry, last = r["entry"][0] or 0, r["last"][0] is not False
            edits, closing = repairs.trace(_classes(r), entry, r["leave"][0], last)
            out = {n: [] for n in names}

            def put(*values):
                for n, v in zip(names, values):
                    out[n].append(v)

            for i, (letter, inserted, given) in enumerate(edits):
                where = r["conv_id"][i], r["number"][i]
                for k, t in enumerate(inserted):
                    put(*where, k, None, ROLES[t], "", None, None, "I", INSERT)
                pair = None if r["before"][i] is None else (r["before"][i], r["initial"][i])
                illegal = pair is not None and pair not in {("s", "u"), ("u", "a"), ("a", "u")}
                late = TRUNCATED if r["fault"][i] == "truncated" and letter != "D" else 0
                put(*where, len(inserted), r["turn"][i], ROLES[given] if given else r["role"][i], r["text"][i], r["fault"][i],
                    illegal, letter, EDIT_COST[letter] + late)
            for k, t in enumerate(closing):
                put(r["conv_id"][-1], r["number"][-1], len(edits[-1][1]) + 1 + k, None, ROLES[t], "", None, None, "I", INSERT)
            n = len(out["edit"])
            yield from pa.table({KEY: [key] * n, CHUNK: [chunk] * n, **out}, schema=schema).to_batches(512)

    from pyspark.sql.pandas.types import to_arrow_schema

    wanted = rows.select(KEY, CHUNK, *[c for c in carried if c in rows.columns]).join(chosen, [KEY, CHUNK], "left")
    schema = to_arrow_schema(spark.createDataFrame([], types).schema)
    return _by_slice(wanted).mapInArrow(edit, types)


def with_digest(conversations: DataFrame, edits: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row per ``conv_id`` of ``conversations`` with the counts, cost, audit and digest of its ``edits``.

    A digest of a text must see it in order, so each conversation is streamed through one task
    in sorted order; the task holds one batch and the audit, not the texts.
    """
    found_type = f"{KEY} string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, " \
                 "repaired_sha256 string"

    def total(batches):
        at, sums = None, None

        def row():
            gaps = sums["high"] - sums["low"] + 1 - sums["turns"] if sums["turns"] else 0
            return pa.RecordBatch.from_pylist([{KEY: at, "gaps": gaps, **{c: sums[c] for c in ("blank", "duplicate", "truncated", "illegal", "cost")},
                                                "audit": sums["audit"].decode(), "repaired_sha256": sums["sha"].hexdigest()}])

        for batch in batches:
            for key, turn, role, text, fault, illegal, edit, cost in zip(*[batch.column(c).to_pylist() for c in (
                    KEY, "turn", "role", "text", "fault", "illegal", "edit", "cost")]):
                if sums is None or key != at:
                    if sums is not None:
                        yield row()
                    at, sums = key, {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "turns": 0, "low": None, "high": None,
                                     "audit": bytearray(), "sha": hashlib.sha256(), "rows": 0}
                sums["audit"] += edit.encode()
                sums["cost"] += cost
                if edit != "D":
                    sums["sha"].update((("\n" if sums["rows"] else "") + f"{role}:{text}").encode())
                    sums["rows"] += 1
                if edit == "I":
                    continue
                sums["illegal"] += illegal
                if fault is not None:
                    sums[fault] += 1
                if turn is not None and turn != sums["high"]:  # rows come by turn
                    sums["turns"] += 1
                    sums["low"] = turn if sums["low"] is None else sums["low"]
                    sums["high"] = turn
        if sums is not None:
            yield row()

    ordered = edits.repartition(KEY).sortWithinPartitions(KEY, CHUNK, "number", "part")
    found = ordered.select(KEY, F.col("turn").cast("bigint").alias("turn"), "role", "text", "fault", "illegal", "edit", "cost").mapInArrow(total, found_type)
    ids = pick(conversations, conv_id=conv).distinct().withColumn(KEY, _key(F.col("conv_id")))
    out = ids.join(found, KEY, "left")
    zero = {c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return out.select("conv_id", *zero.values(), F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _key(conv: Column) -> Column:
    """As :func:`quire.plans.scan.with_key` has it."""
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


#: Plain dynamic programme over rows and the last role; CRC-32 by its table, which a rule makes.
REPAIR_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b:
           CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                 list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT) AS b
          FROM conversations),
harm AS (SELECT conv_id, turn, role, text,
                xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 20 AS h FROM keyed, crc),
damaged AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
                   CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM harm),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text)) AS i FROM damaged),
marked AS (SELECT *, left(role, 1) AS ini, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
                  CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                       WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                       WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' END AS fault FROM numbered),
sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                count(*) FILTER (before IS NOT NULL AND before || '-' || ini NOT IN ('s-u', 'u-a', 'a-u')) AS illegal, count(*) AS n
         FROM marked GROUP BY conv_id),
ins(p, q, k, made) AS (VALUES ('0', '0', 0, []), ('0', 'u', 1, ['user:']), ('0', 'a', 2, ['user:', 'assistant:']), ('s', 's', 0, []), ('s', 'u', 1, ['user:']),
  ('s', 'a', 2, ['user:', 'assistant:']), ('u', 'u', 0, []), ('u', 'a', 1, ['assistant:']), ('a', 'a', 0, []), ('a', 'u', 1, ['user:'])),
go(p, t, q) AS (VALUES ('0', 's', 's'), ('0', 'u', 'u'), ('s', 'u', 'u'), ('a', 'u', 'u'), ('u', 'a', 'a')),
act(letter, t, cost) AS (VALUES ('K', '', 0), ('R', 'u', 1), ('R', 'a', 1), ('D', '', 2)),
dp AS (
  SELECT conv_id, 0::BIGINT AS i, '0' AS st, 0 AS cost, '' AS audit, []::VARCHAR[] AS made FROM sums
  UNION ALL
  SELECT conv_id, i, st, cost, audit, made FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, st ORDER BY cost, audit) AS rn FROM (
      SELECT dp.conv_id, m.i, CASE WHEN letter = 'D' THEN ins.q ELSE go.q END AS st,
             dp.cost + 5 * ins.k + act.cost + CASE WHEN letter <> 'D' AND m.fault = 'truncated' THEN 5 ELSE 0 END AS cost,
             dp.audit || repeat('I', ins.k) || letter AS audit,
             list_concat(dp.made, ins.made, CASE letter WHEN 'D' THEN [] WHEN 'K' THEN [m.role || ':' || m.text]
                                                 ELSE [CASE act.t WHEN 'u' THEN 'user:' ELSE 'assistant:' END || m.text] END) AS made
      FROM dp JOIN marked m ON m.conv_id IS NOT DISTINCT FROM dp.conv_id AND m.i = dp.i + 1 JOIN ins ON ins.p = dp.st CROSS JOIN act
      LEFT JOIN go ON go.p = ins.q AND go.t = CASE WHEN letter = 'K' THEN m.ini ELSE act.t END
      WHERE letter = 'D' OR (go.q IS NOT NULL AND coalesce(m.fault, '') NOT IN ('blank', 'duplicate'))))
  WHERE rn = 1),
ends(st, k, made) AS (VALUES ('0', 0, []), ('a', 0, []), ('u', 1, ['assistant:']), ('s', 2, ['user:', 'assistant:'])),
best AS (SELECT dp.conv_id, dp.cost + 5 * k AS cost, audit || repeat('I', k) AS audit, list_concat(dp.made, ends.made) AS made
         FROM dp JOIN sums ON sums.conv_id IS NOT DISTINCT FROM dp.conv_id AND sums.n = dp.i JOIN ends ON ends.st = dp.st
         QUALIFY row_number() OVER (PARTITION BY dp.conv_id ORDER BY dp.cost + 5 * k, audit || repeat('I', k)) = 1)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(made, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
"""
