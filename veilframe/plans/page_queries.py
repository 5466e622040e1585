"""Queries over characters on pages, and their SQL. A conversation is set as a document: a turn is a page, and its text is laid out line by line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import events, page_text, pages
from ..sources import gates
from ..sources.shared import bucketed, cut
from . import lifecycle

T = gates.read


def set_pages(spark: SparkSession, d: str) -> DataFrame:
    """characters of every whole text: lines 14 apart, characters 6 wide; two lines a block; each 23rd small and raised, some w as a ligature. Turns are dealt out before they are characters, so no character is."""
    turns = T(spark, d, "conversations").select("conv_id", "turn", "text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), "conv_id", "turn")
    lines = turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "t"))
    c = lines.select("doc_id", "page", "line", F.posexplode(F.split("t", "")).alias("col", "ch")).filter("ch <> ''")
    c = c.withColumns({"idx": F.col("line").cast("long") * 1_000_000 + F.col("col"), "raised": (F.col("col") % 23 == 7) & ~F.col("ch").rlike(r"\s")})
    x, y, h = F.col("col") * 6.0, F.col("line") * 14.0 - F.when(F.col("raised"), 4.0).otherwise(0.0), F.when(F.col("raised"), 5.0).otherwise(10.0)
    return c.select(
        "doc_id", "page", "idx", F.floor(F.col("line") / 2).cast("int").alias("block"), "line", F.when((F.col("ch") == "w") & (F.col("col") % 5 == 0), 0xFB01).otherwise(F.ascii("ch")).alias("code"), x.alias("ox"), y.alias("oy"),
        F.array(x, y - h, x + 6, y - h, x, y, x + 6, y).alias("quad"), F.lit(1.0).alias("dx"), F.lit(0.0).alias("dy"),
    )


def page_texts(spark, d):
    """Every page's text and where it was joined."""
    t = page_text.texts(page_text.points(set_pages(spark, d), dealt=True))
    joins = F.flatten(F.transform("blocks", lambda b: b["joins"]))
    return t.select("doc_id", "page", "text", F.size("blocks").alias("blocks"), F.array_join(joins.cast("array<string>"), ",").alias("joins"), F.array_join(F.col("breaks").cast("array<string>"), ",").alias("breaks"), F.array_join(F.col("line_breaks").cast("array<string>"), ",").alias("line_breaks"))


#: Long words, and runs of two words about a place where lines may meet.
WORDS = "[a-z]{4,} ?[a-z]{5,}"


def _spans(texts: DataFrame) -> DataFrame:
    """Places of WORDS in page texts, of each kind in turn."""
    cut = texts.select("doc_id", "page", F.split("text", WORDS, -1).alias("between"), F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)).alias("found"))
    each = cut.select("doc_id", "page", F.posexplode("found").alias("i", "match"), "between", "found")
    size = lambda xs, n: F.aggregate(F.slice(xs, F.lit(1), n), F.lit(0), lambda a, x: a + F.length(x))
    start = size("between", F.col("i") + 1) + size("found", F.col("i"))
    kind = F.element_at(F.array(F.lit("term"), F.lit("email"), F.lit("phone")), F.col("i") % 3 + 1)
    return each.select("doc_id", "page", F.col("i").alias("span_id"), kind.alias("kind"), start.alias("start"), (start + F.length("match")).alias("end"))


def page_places(spark, d):
    """Spans of the page texts with the characters and outlines they stand on."""
    mapped = spark.table(bucketed(page_text.points(set_pages(spark, d), dealt=True), page_text.PAGE))
    found = page_text.places(_spans(page_text.texts(mapped)), mapped)
    return found.select("doc_id", "page", "span_id", "text", "raw", F.size("quads").alias("n_quads"), F.array_join(F.flatten("quads").cast("array<int>").cast("array<string>"), ",").alias("quads"))


def page_blocks(spark, d):
    """Why places of the page texts can't be redacted: the reading without replacement text spells some otherwise, and images of fine or coarse pixels lie under some pages."""
    ordinary = set_pages(spark, d)
    mapped = spark.table(bucketed(page_text.points(ordinary, dealt=True), page_text.PAGE))
    found = cut(page_text.places(_spans(page_text.texts(mapped)), mapped)).withColumn("match_id", F.concat_ws("-", "doc_id", "page", "span_id"))
    outlines = found.select("match_id", "doc_id", "page", F.explode("quads").alias("quad"))
    ignoring = ordinary.withColumn("code", F.when(F.col("idx") % 31 == 5, 63).otherwise(F.col("code")))
    lain = T(spark, d, "conversations").filter(F.replace("text", F.lit("\n"), F.lit("")) != "").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page")).distinct()  # pages with characters
    images = lain.filter("doc_id % 3 < 2").select("doc_id", "page", F.array(*[F.lit(v) for v in (600.0, 0.0, 0.0, 280.0, 0.0, 0.0)]).alias("transform"), F.when(F.col("doc_id") % 3 == 0, 600).otherwise(50).alias("columns"), F.lit(280).alias("rows"))
    return pages.blocked(outlines, found.select("match_id", F.col("raw").alias("text")), ordinary, ignoring, images)


_SET = """lines AS (
  SELECT conv_id AS doc_id, turn AS page, unnest(range(len(ls)))::INT AS line, unnest(ls) AS t FROM (SELECT conv_id, turn, string_split(coalesce(text, ''), chr(10)) AS ls FROM conversations)
), cols AS (
  SELECT doc_id, page, line, unnest(range(length(t)))::INT AS col, unnest(string_split(t, '')) AS ch FROM lines WHERE t <> ''
), chars AS (
  SELECT doc_id, page, line::BIGINT * 1000000 + col AS idx, line // 2 AS block, line, col * 6.0::DOUBLE AS x, ch, CASE WHEN ch = 'w' AND col % 5 = 0 THEN 64257 ELSE ascii(ch) END AS code,
    col % 23 = 7 AND NOT regexp_matches(ch, '\\s') AS raised, NOT regexp_matches(ch, '\\s') AS solid FROM cols
)"""
#: The rules of a line said the plain way: medians by list, stretches by recursion-free comparison of neighbours.
_MAP = f"""{_SET}, sized AS (
  SELECT *, CASE WHEN raised THEN 5.0 ELSE 10.0 END AS h, line * 14.0 - CASE WHEN raised THEN 4.0 ELSE 0.0 END AS oy FROM chars
), heights AS (
  SELECT doc_id, page, line, list(h ORDER BY h)[count(*) // 2 + 1] AS mid FROM sized WHERE solid GROUP BY ALL
), bases AS (
  SELECT s.doc_id, s.page, s.line, list(oy ORDER BY oy)[count(*) // 2 + 1] AS base, count(*) AS n FROM sized s JOIN heights USING (doc_id, page, line) WHERE solid AND h > 0.9 * mid GROUP BY ALL
), judged AS (
  SELECT s.*, coalesce(solid AND n >= 3 AND h <= 0.9 * mid AND abs(oy - base) >= 0.15 * mid, false) AS off FROM sized s LEFT JOIN heights USING (doc_id, page, line) LEFT JOIN bases USING (doc_id, page, line)
), islands AS (
  SELECT *, count(*) FILTER (solid AND NOT off) OVER (PARTITION BY doc_id, page, line ORDER BY idx) AS island, lag(solid AND NOT off) OVER w AS kept_before, lead(solid AND NOT off) OVER w AS kept_after, lag(idx) OVER w AS before, lead(idx) OVER w AS after
  FROM judged WINDOW w AS (PARTITION BY doc_id, page, line ORDER BY idx)
), runs AS (
  SELECT doc_id, page, line, island, min(idx) AS first, max(idx) AS last, count(*) <= 4 AND bool_or(coalesce(kept_before, false) OR coalesce(kept_after, false)) AS goes, bool_and(before IS NOT NULL) AND bool_and(after IS NOT NULL) AS inside FROM islands WHERE off GROUP BY ALL
), left_ AS (
  SELECT i.*, coalesce(goes AND idx BETWEEN first AND last, false) AS leaves, coalesce(goes AND inside AND idx = first, false) AS spaced FROM islands i LEFT JOIN runs USING (doc_id, page, line, island)
), due AS (
  SELECT *, count(*) FILTER (spaced) OVER p AS due, count(*) FILTER (leaves) OVER p AS stretch, CASE WHEN code = 64257 THEN 'fi' ELSE ch END AS points FROM left_ WINDOW p AS (PARTITION BY doc_id, page ORDER BY idx)
), told AS (
  SELECT *, coalesce(regexp_matches(lag(points) OVER p, '\\S$') AND regexp_matches(points, '^\\S'), false) AS open, lag(block) OVER p IS DISTINCT FROM block AS b, lag(line) OVER p IS DISTINCT FROM line AS l, lag(due) OVER p IS DISTINCT FROM due AS s
  FROM due WHERE NOT leaves WINDOW p AS (PARTITION BY doc_id, page ORDER BY idx)
), joined AS (
  SELECT *, CASE WHEN open AND b THEN 'block' WHEN open AND l THEN 'line' WHEN open AND s AND NOT l THEN 'space' END AS j FROM told
), mapped AS (
  SELECT *, (sum(length(points) + (j IS NOT NULL)::INT) OVER (PARTITION BY doc_id, page ORDER BY idx) - length(points))::INT AS start FROM joined
), text_ AS (
  SELECT doc_id, page, string_agg(CASE WHEN j IS NULL THEN '' ELSE ' ' END || points, '' ORDER BY idx) AS text FROM mapped GROUP BY ALL
)"""
_PAGE_TEXTS = f"""WITH {_MAP}, blocks_ AS (
  SELECT doc_id, page, block, min(start) AS from_, string_agg((start - 1)::VARCHAR, ',' ORDER BY start) FILTER (j = 'line') AS _, list(start - 1 ORDER BY start) FILTER (j = 'line') AS js FROM mapped GROUP BY ALL
), per AS (
  SELECT doc_id, page, count(*)::INT AS blocks, coalesce(string_agg(array_to_string(list_transform(js, lambda x: x - from_), ','), ',' ORDER BY block) FILTER (js IS NOT NULL), '') AS joins FROM blocks_ GROUP BY ALL
), ats AS (
  SELECT doc_id, page, coalesce(string_agg((start - 1)::VARCHAR, ',' ORDER BY start) FILTER (j IN ('block', 'line')), '') AS breaks, coalesce(string_agg((start - 1)::VARCHAR, ',' ORDER BY start) FILTER (j = 'line'), '') AS line_breaks FROM mapped GROUP BY ALL
)
SELECT doc_id, page, text, blocks, joins, breaks, line_breaks FROM text_ JOIN per USING (doc_id, page) JOIN ats USING (doc_id, page)"""
_PAGE_PLACES = f"""WITH {_MAP}, cut AS (
  SELECT doc_id, page, unnest(range(len(found)))::INT AS i, found, string_split_regex(text, '{WORDS}') AS between_ FROM (SELECT *, regexp_extract_all(text, '{WORDS}') AS found FROM text_)
), spans AS (
  SELECT doc_id, page, i, ['term', 'email', 'phone'][i % 3 + 1] AS kind, start, start + length(found[i + 1]) AS end_ FROM (SELECT *, (coalesce(list_sum(list_transform(between_[1:i+1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(found[1:i], lambda x: length(x))), 0))::INT AS start FROM cut)
), met AS (
  SELECT s.i, s.kind, s.start AS a, s.end_ AS z, m.*, regexp_matches(coalesce(lag(points) OVER (PARTITION BY s.doc_id, s.page, s.i ORDER BY idx), ''), '[-‐-―−]$') AS dash
  FROM spans s JOIN mapped m ON s.doc_id = m.doc_id AND s.page = m.page AND s.start < m.start + length(points) AND s.end_ > m.start - (j IS NOT NULL)::INT
), shown AS (
  SELECT *, CASE WHEN z > start THEN substr(points, greatest(a - start, 0) + 1, least(z - start, length(points)) - greatest(a - start, 0)) ELSE '' END AS own,
    CASE WHEN j IS NOT NULL AND start - 1 BETWEEN a AND z - 1 AND kind <> 'email' AND NOT (kind = 'term' AND j = 'line' AND dash) THEN ' ' ELSE '' END AS gap FROM met
), runs_ AS (
  SELECT doc_id, page, i, line, stretch, min(idx) AS first, min(x) AS x0, max(x) + 6 AS x1, arg_min(oy - h, idx) AS ul, arg_max(oy - h, idx) AS ur, arg_min(oy, idx) AS ll, arg_max(oy, idx) AS lr FROM shown WHERE own <> '' GROUP BY ALL
), outlines AS (
  SELECT doc_id, page, i, count(*)::INT AS n_quads, string_agg(concat_ws(',', x0::INT, ul::INT, x1::INT, ur::INT, x0::INT, ll::INT, x1::INT, lr::INT), ',' ORDER BY first) AS quads FROM runs_ GROUP BY ALL
)
SELECT doc_id, page, i AS span_id, string_agg(gap || own, '' ORDER BY idx) AS text, string_agg(gap || CASE WHEN own = '' THEN '' ELSE chr(code) END, '' ORDER BY idx) AS raw, any_value(n_quads) AS n_quads, any_value(quads) AS quads
FROM shown LEFT JOIN outlines USING (doc_id, page, i) GROUP BY doc_id, page, i"""

def conversation_page_terms(spark, d):
    """Terms over the turns of conversations, each a page: on a page, and over a break, part by part."""
    pages = T(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text")
    found = lifecycle.page_terms(pages, [(str(i), t) for i, t in enumerate(("the", "that of", "und der", "est le", "in the"))])
    return found.groupBy("term", "part", F.array_join("notes", ",").alias("notes")).agg(F.count("*").alias("n"))


_PAGE_BLOCKS = f"""{_PAGE_PLACES[: _PAGE_PLACES.rindex("SELECT doc_id, page, i AS span_id")].rstrip()}, replaced AS (
  SELECT doc_id, page, i, bool_or(idx % 31 = 5 AND own <> '' AND code <> 63) AS replaced FROM shown GROUP BY ALL
), pixel AS (
  SELECT doc_id, page, i, x0 - 1 AS px0, x1 + 1 AS px1, ul - 2.5 AS py0, ll + 2.5 AS py1, CASE doc_id % 3 WHEN 0 THEN 600 ELSE 50 END AS n FROM runs_ WHERE doc_id % 3 < 2
), region AS (
  SELECT *, greatest(0, floor(px0 / 600 * n + 0.001)) AS c0, least(n, ceil(px1 / 600 * n - 0.001)) AS c1, greatest(0, floor(py0 + 0.001)) AS r0, least(280, ceil(py1 - 0.001)) AS r1 FROM pixel
), reach AS (
  SELECT doc_id, page, i, bool_or(c0 < c1 AND r0 < r1 AND sqrt(greatest(0, px0 - c0 * 600 / n, c1 * 600 / n - px1) ** 2 + greatest(0, py0 - r0, r1 - py1) ** 2) > 1) AS over_ FROM region GROUP BY ALL
)
SELECT doc_id || '-' || page || '-' || i AS match_id, CASE WHEN replaced THEN 'replacement-text' WHEN over_ THEN 'image-overreach' END AS blocked FROM replaced LEFT JOIN reach USING (doc_id, page, i)"""


#: Sentences that name a licence, and its identifier.
NAMED = {"Apache License, Version 2.0": "Apache-2.0", "MIT License": "MIT", "GNU General Public License, version 3": "GPL-3.0", "CC BY-NC 4.0": "CC-BY-NC-4.0"}
ALLOWED = ["Apache-2.0", "MIT", "GPL-2.0 WITH Classpath"]


def licence_expressions(spark, d):
    """The licence lines of documents as expressions, by doc_id in several forms, and what each comes to."""
    docs = T(spark, d, "documents").filter("text is not null")
    lines = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?:[Ll]icensed|Released) under (?:the )?([^\n]+?)\.(?:\n|$)"), F.lit(1))).alias("n", "name"))
    form = F.when(F.col("doc_id") % 4 == 0, F.format_string("%s OR GPL-3.0", "id")).when(F.col("doc_id") % 4 == 1, F.format_string("(%s AND CC0) OR (MIT AND GPL-2.0 WITH Classpath)", "id")).when(F.col("doc_id") % 4 == 2, F.format_string("%s AND (MIT", "id")).otherwise(F.format_string("%s AND MIT", "id"))
    written = lines.withColumn("id", F.try_element_at(F.create_map(*[F.lit(x) for p in NAMED.items() for x in p]), F.col("name"))).filter("id is not null")
    return written.select("doc_id", "n", form.alias("expression")).withColumn("allowed", events.licence_verdict(F.col("expression"), ALLOWED))


def plan_reads(spark, d):
    """What each view of the table is shown, by the answers that its user's other events gave."""
    e = T(spark, d, "events").select(F.col("user_id").alias("user"), F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)").alias("ts_ms"), F.col("event_id"), F.col("event_type"))
    reads = e.filter("event_type = 'view'").select("user", "ts_ms", "event_id")
    answer = F.when(F.col("event_type") == "purchase", "paid").when(F.col("event_type") == "error", "unknown").otherwise("free")
    answers = e.filter("event_type <> 'view'").select("user", "ts_ms", (F.col("event_id") * 37 % 5000).alias("took_ms"), answer.alias("answer"))
    return events.plan_at(reads, answers, 24 * 3_600_000)


_EXPRESSIONS = f"""WITH lines AS (
  SELECT doc_id, unnest(range(len(f)))::INT AS n, unnest(f) AS name FROM (SELECT doc_id, regexp_extract_all(text, '(?:[Ll]icensed|Released) under (?:the )?([^\n]+?)\\.(?:\n|$)', 1) AS f FROM documents)
), ids AS (
  SELECT doc_id, n, CASE name {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NAMED.items())} END AS id FROM lines
)
SELECT doc_id, n, CASE doc_id % 4 WHEN 0 THEN id || ' OR GPL-3.0' WHEN 1 THEN '(' || id || ' AND CC0) OR (MIT AND GPL-2.0 WITH Classpath)' WHEN 2 THEN id || ' AND (MIT' ELSE id || ' AND MIT' END AS expression,
  CASE doc_id % 4 WHEN 1 THEN true WHEN 2 THEN NULL ELSE id IN ('Apache-2.0', 'MIT') END AS allowed FROM ids WHERE id IS NOT NULL"""
_READS = """WITH e AS (SELECT user_id AS u, epoch_us(ts) // 1000 AS t, event_id, event_type FROM events),
  c AS (SELECT u, t + least(event_id * 37 % 5000, 4000) AS t, CASE WHEN event_id * 37 % 5000 > 4000 THEN 'unknown' WHEN event_type = 'purchase' THEN 'paid' WHEN event_type = 'error' THEN 'unknown' ELSE 'free' END AS answer FROM e WHERE event_type <> 'view'),
  a AS (SELECT u, t, max(answer) AS answer FROM c GROUP BY 1, 2), p AS (SELECT DISTINCT u, t FROM c WHERE answer = 'paid'), s AS (SELECT u, t, max(answer) AS answer FROM c WHERE answer <> 'unknown' GROUP BY 1, 2),
  r AS (SELECT * FROM e WHERE event_type = 'view'),
  x AS (SELECT r.u, r.t, r.event_id, a.t AS at_, a.answer FROM r ASOF LEFT JOIN a ON r.u = a.u AND r.t >= a.t),
  y AS (SELECT x.*, p.t AS paid FROM x ASOF LEFT JOIN p ON x.u = p.u AND x.t >= p.t), z AS (SELECT y.*, s.answer AS said FROM y ASOF LEFT JOIN s ON y.u = s.u AND y.t >= s.t)
  SELECT u AS user, t AS ts_ms, event_id, CASE WHEN answer = 'unknown' AND said = 'paid' AND t - paid <= 86400000 THEN 'paid' ELSE coalesce(answer, 'unknown') END AS shown, coalesce(t - at_ > 300000, true) AS asks FROM z"""

QUERIES = {f.__name__: f for f in (page_texts, page_places, page_blocks, conversation_page_terms, licence_expressions, plan_reads)}
ORACLE = {"page_texts": _PAGE_TEXTS, "page_places": _PAGE_PLACES, "page_blocks": _PAGE_BLOCKS, "licence_expressions": _EXPRESSIONS, "plan_reads": _READS}
