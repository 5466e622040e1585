"""Repair of the structure of conversations by a fold in Spark SQL.

Windows over a conversation's turns derive their faults; the turns are collected in order; aggregate() then carries, for each
state that the kept roles can be in, the cheapest (cost, audit) so far, chosen by least(). No Python runs on the executors.

States: 'none' nothing kept yet, 'system' only the opening system turn, 'user' a user turn is last, 'reply' an assistant turn
is last. An audit is written as pairs of an edit (D delete, I insert, K keep, R rerole) and the role that it leaves (u, a, s; - for
none); roles follow from the edits, so pairs compare as edits alone do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SPACE = " \t\n\x0b\x0c\r"
STATES = ("none", "system", "user", "reply")
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: A cost that no repair has: the state can't be reached.
NEVER = 1 << 40
#: Turns folded with audits of their own before these are put behind those of the turns before: a fold copies its audits at each turn.
RUN = 256


def faults(turns: DataFrame, present: Column | None = None) -> DataFrame:
    """Each turn with pos (1, 2, ... in its conversation) and its first fault: blank, duplicate, truncated, or null.

    Order: turn (null first), then role, then text. illegal: the role before and this one can't follow another. new_turn: the
    first row of its turn. Rows where `present` does not hold are kept apart and have their own numbers.
    """
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.lit(True) if present is None else F.coalesce(present, F.lit(False))).alias("present")
    ).repartition("conv_id")
    line = Window.partitionBy("conv_id", "present").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("pos", F.row_number().over(line)).withColumn("initial", F.substring("role", 1, 1))
    pair = F.concat(F.lag("initial").over(line), "initial")
    rows = rows.withColumns({
        "illegal": F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)),
        "new_turn": F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(line)),
        "seen": F.row_number().over(Window.partitionBy("conv_id", "present", "role", "text").orderBy("pos")) > 1,
        "told": F.rtrim("text", F.lit(SPACE)),
    })
    fault = F.when(F.col("told") == "", "blank").when(F.col("seen"), "duplicate").when(~F.substring("told", -1, 1).isin(".", "!", "?"), "truncated")
    return rows.select("conv_id", "turn", "role", "text", "present", "pos", "initial", "illegal", "new_turn", fault.alias("fault"))


def _after(way: Column, cost, audit) -> Column:
    """A way, one edit longer."""
    return F.struct((way["cost"] + cost).alias("cost"), way["rank"].alias("rank"), F.concat(way["audit"], audit).alias("audit"))


def _with_inserts(now: Column) -> dict[str, Column]:
    """The ways after what may be inserted at this place. Longer rounds of inserts come back to a state at a higher cost."""
    none, system, user, reply = (now[s] for s in STATES)
    two = lambda w: _after(w, 2 * INSERT, F.lit("IuIa"))
    one = lambda w, r: _after(w, INSERT, F.lit(f"I{r}"))
    return {"none": none, "system": system, "user": F.least(user, one(none, "u"), one(system, "u"), one(reply, "u")), "reply": F.least(reply, one(user, "a"), two(none), two(system))}


def _step(now: Column, row: Column) -> Column:
    """One turn more: deleted, kept where its role fits, or given the role that fits."""
    at = _with_inserts(now)
    forced, late = row["forced"], row["truncated"].cast("long") * TRUNCATED
    gone = {s: _after(w, F.lit(DELETE), F.lit("D-")) for s, w in at.items()}

    def as_role(way: Column, role: str) -> Column:
        kept = row["initial"] == role
        return F.when(~forced, _after(way, late + F.when(kept, F.lit(0)).otherwise(F.lit(REROLE)), F.when(kept, F.lit(f"K{role}")).otherwise(F.lit(f"R{role}"))))

    return F.struct(
        gone["none"].alias("none"),
        F.least(gone["system"], F.when(~forced & (row["initial"] == "s"), _after(at["none"], late, F.lit("Ks")))).alias("system"),
        F.least(gone["user"], *(as_role(at[s], "u") for s in ("none", "system", "reply"))).alias("user"),
        F.least(gone["reply"], as_role(at["user"], "a")).alias("reply"),
    )


def _way(cost: Column, rank: Column, audit: Column) -> Column:
    return F.struct(cost.cast("long").alias("cost"), rank.cast("int").alias("rank"), audit.alias("audit"))


def _run(now: Column, rows: Column) -> Column:
    """RUN turns more. Inside a run a way has the rank of the audit that it goes on from, and its own edits; audits of as many turns are never the beginning of another, so the rank decides as the audit would."""
    before = F.array(*(now[s]["audit"] for s in STATES))
    rank = lambda s: F.size(F.filter(before, lambda a: a < now[s]["audit"]))
    start = F.struct(*(_way(now[s]["cost"], rank(s), F.lit("")).alias(s) for s in STATES))
    whole = lambda w: _way(w["cost"], F.lit(0), F.concat(F.element_at(F.array_sort(before), w["rank"] + 1), w["audit"]))
    return F.aggregate(rows, start, _step, lambda end: F.struct(*(whole(end[s]).alias(s) for s in STATES)))


def cheapest(turns: Column) -> Column:
    """(cost, rank, audit) of the cheapest edits of an array of turns (initial, forced, truncated); of equal ones the audit that is least."""
    runs = F.when(F.size(turns) > 0, F.sequence(F.lit(0), F.floor((F.size(turns) - 1) / RUN).cast("int"))).otherwise(F.array().cast("array<int>"))
    start = F.struct(*(_way(F.lit(0 if s == "none" else NEVER), F.lit(0), F.lit("")).alias(s) for s in STATES))
    end = lambda now: F.least(now["none"], _with_inserts(now)["reply"])
    return F.aggregate(runs, start, lambda now, i: _run(now, F.slice(turns, i * RUN + 1, RUN)), end)


def _role(letter: Column) -> Column:
    return F.when(letter == "u", "user").otherwise("assistant")


def _repaired(audit: Column, turns: Column) -> Column:
    """What the edits make of the turns: (role, text) in order. Inserts before a turn go with it; those after the last stand alone."""

    def lines(edits: Column, row: Column) -> Column:
        last, role = F.substring(edits, -2, 1), F.substring(edits, -1, 1)
        added = F.transform(F.regexp_extract_all(edits, F.lit("I(.)"), F.lit(1)), lambda r: F.struct(_role(r).alias("role"), F.lit("").alias("text")))
        own = F.filter(F.array(F.struct(F.when(last == "K", row["role"]).otherwise(_role(role)).alias("role"), row["text"].alias("text"))), lambda _: last.isin("K", "R"))
        return F.concat(added, own)

    return F.flatten(F.zip_with(F.regexp_extract_all(audit, F.lit("(?:I.)*[DKR].|(?:I.)+"), F.lit(0)), turns, lines))


def repair(turns: DataFrame, present: Column | None = None) -> DataFrame:
    """A row a conversation of (conv_id, turn, role, text): its faults, the cheapest edits that mend it, and repaired, an array of (role, text).

    A mended conversation has the roles `(system? (user assistant)+)?`, by initials. Keeping a turn costs 0, another role 2,
    deleting 3 (blank and duplicate turns must go), an empty turn put in 2; a truncated turn that stays adds 1. Ties go to the
    audit that is least in ASCII.

    Null roles and texts are one space, so they are blank or of no known role; null turns come first and leave no gap; a
    null conv_id is a conversation too. Rows of one turn go by role and text; rows that repeat are duplicates. Turns not
    `present` are left out, but their conversation is returned: without any turn it has zeros, '' and an empty array. Texts are
    read whole; those of one conversation must fit a cell, as the repaired conversation does. Extra columns are left behind
    whatever their names; an empty table has no rows. Gaps too wide for a long are the largest long.
    """
    rows = faults(turns, present)
    here = F.col("present")
    count = lambda c: F.count_if(here & c).alias
    turn = F.when(here, F.col("turn").cast("decimal(38,0)"))
    gaps = F.max(turn) - F.min(turn) + 1 - F.count_if(here & F.col("new_turn"))
    row = F.struct("pos", "initial", F.col("fault").isin("blank", "duplicate").alias("forced"), (F.col("fault") == "truncated").alias("truncated"), "role", "text")
    whole = F.struct(*(F.coalesce(row[c], F.lit(False)).alias(c) if c in ("forced", "truncated") else row[c].alias(c) for c in ("pos", "initial", "forced", "truncated", "role", "text")))
    held = rows.groupBy("conv_id").agg(
        F.least(F.coalesce(gaps, F.lit(0).cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long").alias("gaps"),
        *(count(F.col("fault") == f)(f) for f in ("blank", "duplicate", "truncated")),
        count(F.col("illegal"))("illegal"),
        F.sort_array(F.collect_list(F.when(here, whole))).alias("turns"),
    )
    best = held.withColumn("best", cheapest(F.transform("turns", lambda t: F.struct(t["initial"].alias("initial"), t["forced"].alias("forced"), t["truncated"].alias("truncated")))))
    return best.select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", F.col("best.cost").alias("cost"), F.regexp_replace("best.audit", "(.).", "$1").alias("audit"), _repaired(F.col("best.audit"), F.col("turns")).alias("repaired")
    )


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with faults put in by the hash of conv_id and turn; a turn that is dropped stays as a row that is not present."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), (F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20).alias("fault"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("fault") != 0).alias("present"), F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by the hash of its turns and repaired."""
    found = repair(damaged(common.table(spark, sf_dir, "conversations")), F.col("present"))
    lines = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return found.withColumn("repaired_sha256", F.sha2(lines, 256)).drop("repaired")


#: Written apart from the fold: all ways go on a turn a round, each with the text it has made so far, and DuckDB's least() chooses.
_SQL = """
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT) AS bytes FROM conversations
), hashed AS (
  SELECT *, xor(list_reduce(bytes, lambda a, b: list_reduce(range(8), lambda x, _: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(a, b)), 4294967295::BIGINT), 4294967295) % 20 AS f FROM raw
), damaged AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT * FROM hashed UNION ALL SELECT * FROM hashed WHERE f = 3) WHERE f <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS told FROM damaged
), judged AS (
  SELECT conv_id, turn, role, text, pos, role[1] AS r, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY pos) AS before,
    CASE WHEN told = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate' WHEN told[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM placed
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pos > 1 AND before || r NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n FROM judged GROUP BY conv_id
), fold AS (
  SELECT conv_id, 0::BIGINT AS pos, {'c': 0, 'a': '', 't': ''} AS e, {'c': 1000000000, 'a': '', 't': ''} AS s, {'c': 2, 'a': 'I', 't': 'user:' || chr(10)} AS u, {'c': 4, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:' || chr(10)} AS w
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, pos, e, s, least(u, {'c': e.c + 2, 'a': e.a || 'I', 't': e.t || 'user:' || chr(10)}, {'c': s.c + 2, 'a': s.a || 'I', 't': s.t || 'user:' || chr(10)}, {'c': w.c + 2, 'a': w.a || 'I', 't': w.t || 'user:' || chr(10)}) AS u,
    least(w, {'c': u.c + 2, 'a': u.a || 'I', 't': u.t || 'assistant:' || chr(10)}, {'c': e.c + 4, 'a': e.a || 'II', 't': e.t || 'user:' || chr(10) || 'assistant:' || chr(10)},
      {'c': s.c + 4, 'a': s.a || 'II', 't': s.t || 'user:' || chr(10) || 'assistant:' || chr(10)}) AS w
  FROM (
    SELECT f.conv_id, j.pos, {'c': e.c + 3, 'a': e.a || 'D', 't': e.t} AS e,
      least({'c': s.c + 3, 'a': s.a || 'D', 't': s.t}, {'c': e.c + k + CASE WHEN r = 's' THEN 0 ELSE 1000000000 END, 'a': e.a || 'K', 't': e.t || role || ':' || text || chr(10)}) AS s,
      least({'c': u.c + 3, 'a': u.a || 'D', 't': u.t}, {'c': e.c + k + ku, 'a': e.a || au, 't': e.t || tu}, {'c': s.c + k + ku, 'a': s.a || au, 't': s.t || tu}, {'c': w.c + k + ku, 'a': w.a || au, 't': w.t || tu}) AS u,
      least({'c': w.c + 3, 'a': w.a || 'D', 't': w.t}, {'c': u.c + k + ka, 'a': u.a || aa, 't': u.t || ta}) AS w
    FROM fold f JOIN (
      SELECT *, CASE fault WHEN '' THEN 0 WHEN 'truncated' THEN 1 ELSE 1000000000 END AS k, CASE WHEN r = 'u' THEN 0 ELSE 2 END AS ku, CASE WHEN r = 'a' THEN 0 ELSE 2 END AS ka,
        CASE WHEN r = 'u' THEN 'K' ELSE 'R' END AS au, CASE WHEN r = 'a' THEN 'K' ELSE 'R' END AS aa,
        CASE WHEN r = 'u' THEN role ELSE 'user' END || ':' || text || chr(10) AS tu, CASE WHEN r = 'a' THEN role ELSE 'assistant' END || ':' || text || chr(10) AS ta FROM judged
    ) j ON f.conv_id IS NOT DISTINCT FROM j.conv_id AND j.pos = f.pos + 1
  )
), ended AS (
  SELECT conv_id, least({'c': e.c, 'a': e.a, 't': e.t}, {'c': w.c, 'a': w.a, 't': w.t}) AS best FROM fold QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) = 1
)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  best.c::BIGINT AS cost, best.a AS audit, sha256(left(best.t, greatest(length(best.t) - 1, 0))) AS repaired_sha256
FROM ended e LEFT JOIN counted c ON e.conv_id IS NOT DISTINCT FROM c.conv_id"""
ORACLE = {"op12_conversation_repair": _SQL}
