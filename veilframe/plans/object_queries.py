"""Queries over objects, marked spans and rasters, and their SQL. Line items are references between objects, pages' tags mark spans, vectors are small rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import objects
from ..sources import gates

T = gates.read

#: (role, key, role of what stands there).
RULES = [("page", "Font", "font"), ("page", "XObject", "drawing"), ("font", "Next", "glyph"), ("glyph", "Next", "glyph"), ("drawing", "Next", "drawing"), ("drawing", "Font", "font")]


def _objects(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """References, rules, roots and objects: a document an order key modulo 40; orders refer to parts, parts to suppliers, suppliers to parts of the next key."""
    li = T(spark, d, "lineitem").select((F.col("l_orderkey") % 40).alias("doc_id"), F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_returnflag").alias("r"))
    name = lambda kind, n: F.concat(F.lit(kind), n.cast("string"))
    refs = li.select("doc_id", name("o", F.col("o")).alias("src"), F.when(F.col("r") == "A", "Font").when(F.col("r") == "N", "XObject").otherwise("Annots").alias("key"), name("p", F.col("p")).alias("dst"))
    refs = refs.unionByName(li.select("doc_id", name("p", F.col("p")).alias("src"), F.when(F.col("p") % 7 == 0, "Parent").otherwise("Next").alias("key"), name("s", F.col("s")).alias("dst")))
    refs = refs.unionByName(li.filter("s % 3 = 0").select("doc_id", name("s", F.col("s")).alias("src"), F.lit("Next").alias("key"), name("p", F.col("p") + 1).alias("dst")))
    refs = objects.kept(refs)
    roots = li.filter("o % 3 = 1").select("doc_id", name("o", F.col("o")).alias("obj"), F.lit("page").alias("role")).distinct()
    every = refs.select("doc_id", F.col("src").alias("obj")).union(refs.select("doc_id", "dst")).distinct()
    kinds = every.select("doc_id", "obj", F.when(F.col("obj").startswith("s"), "form").when(F.col("obj").endswith("3"), "procedure").otherwise("other").alias("kind"), (F.col("obj").endswith("7") & F.col("obj").contains("11")).alias("shows_text"))
    return refs, spark.createDataFrame(RULES, "role string, key string, becomes string"), roots, kinds


def objects_by_role(spark, d):
    """How many objects each document reaches in each role, and how many of their keys are stray."""
    refs, rules, roots, _ = _objects(spark, d)
    reached = objects.walk(refs, rules, roots)
    stray = objects.strays(refs, rules, reached).groupBy("doc_id", "role").agg(F.count("*").alias("stray_keys"))
    return reached.groupBy("doc_id", "role").agg(F.count("*").alias("objects")).join(stray, ["doc_id", "role"], "left").na.fill(0, ["stray_keys"])


def glyph_verdicts(spark, d):
    """Whether what glyphs draw shows text or is shared, a document."""
    refs, rules, roots, kinds = _objects(spark, d)
    return objects.glyph_rule(objects.walk(refs, rules, roots), kinds)


def objects_left_out(spark, d):
    """Objects that no page reaches, by document and kind."""
    refs, rules, roots, kinds = _objects(spark, d)
    return objects.unreached(kinds, objects.walk(refs, rules, roots)).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


#: Tags that hold nothing.
VOID = ("br", "hr", "img", "input", "link", "meta")
#: Tags whose end may be left out: they mark nothing.
OPEN = ("p", "b", "html", "body")
TOKEN, TAG = "(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>|[^<]+", "^</?([A-Za-z][A-Za-z0-9]*)"
#: Tags whose whole element is one token.
RAW = ("script", "style")


def marked_spans(spark, d):
    """The tags of every whole page as spans: which are described, hold a named character, or show plain text."""
    each = T(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(TOKEN), F.lit(0))).alias("pos", "token"))
    tag = F.lower(F.regexp_extract("token", TAG, 1))
    kind = (
        F.when(~F.col("token").startswith("<"), F.when(F.col("token").rlike("&[a-z]+;"), "name").when(F.col("token").rlike(r"[^\x20\x09-\x0D]"), "text").otherwise("other"))
        .when((F.col("tag") == "") | F.col("tag").isin(*RAW, *VOID, *OPEN), "other").when(F.col("token").startswith("</"), "end").otherwise("begin")
    )
    return objects.marked_spans(each.withColumn("tag", tag).select("page_id", "pos", kind.alias("kind"), "tag", F.col("token").rlike(" (title|alt|class|lang|href)=").alias("described")), ["page_id"])


def blank_targets(spark, d):
    """Slanted targets over rasters of 8 by 8 pixels, each a vector; a pixel shows where its component is over 1.5 times the vector's mean size."""
    v = T(spark, d, "embeddings").filter("size(embedding) = 64")
    size = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.abs(x)) / 64
    dark = F.transform("embedding", lambda x: F.abs(x.cast("double")) > 1.5 * F.col("size"))
    cells = v.select("vec_id", "embedding", size.alias("size")).select("vec_id", F.posexplode(dark).alias("i", "dark")).filter("dark")
    cells = cells.select("vec_id", F.lit(1).alias("image"), F.floor(F.col("i") / 8).alias("row"), (F.col("i") % 8).cast("long").alias("col"))
    w = F.row_number().over(objects.Window.partitionBy("vec_id", "row").orderBy("col"))
    runs = cells.withColumn("g", F.col("col") - w).groupBy("vec_id", "image", "row", "g").agg(F.min("col").alias("first"), F.max("col").alias("last")).drop("g")
    k = F.col("vec_id")
    images = v.select("vec_id", F.lit(1).alias("image"), F.array(*[F.lit(x) for x in (80.0, 0.0, 0.0, 80.0)], (k % 5 * 1.0), F.lit(3.0)).alias("transform"), F.lit(8).alias("columns"), F.lit(8).alias("rows"))
    x, y, u = k % 40 + 0.13, k % 37 + 3.29, k % 4 * 3.1
    quad = F.array(x, y, x + 31.7, y + u, x - u, y + 17.3, x + 31.7 - u, y + 17.3 + u)
    targets = v.select("vec_id", F.concat_ws("-", F.lit("t"), k).alias("target_id"), quad.alias("quad"))
    return objects.blank_pixels(targets, images, runs, ["vec_id"])


_WALK = f"""WITH RECURSIVE li AS (
  SELECT l_orderkey % 40 AS doc_id, l_orderkey AS o, l_partkey AS p, l_suppkey AS s, l_returnflag AS r FROM lineitem
), refs AS (
  SELECT DISTINCT * FROM (SELECT doc_id, 'o' || o AS src, CASE r WHEN 'A' THEN 'Font' WHEN 'N' THEN 'XObject' ELSE 'Annots' END AS key, 'p' || p AS dst FROM li UNION ALL SELECT doc_id, 'p' || p, CASE WHEN p % 7 = 0 THEN 'Parent' ELSE 'Next' END, 's' || s FROM li
    UNION ALL SELECT doc_id, 's' || s, 'Next', 'p' || (p + 1) FROM li WHERE s % 3 = 0)
), rules(role, key, becomes) AS (
  VALUES {", ".join(str(r) for r in RULES)}
), reached AS (
  SELECT DISTINCT doc_id, 'o' || o AS obj, 'page' AS role FROM li WHERE o % 3 = 1
  UNION SELECT w.doc_id, f.dst, u.becomes FROM reached w JOIN refs f ON w.doc_id = f.doc_id AND w.obj = f.src JOIN rules u ON u.role = w.role AND u.key = f.key
), kinds AS (
  SELECT *, CASE WHEN obj LIKE 's%' THEN 'form' WHEN obj LIKE '%3' THEN 'procedure' ELSE 'other' END AS kind, obj LIKE '%7' AND obj LIKE '%11%' AS shows_text FROM (SELECT doc_id, src AS obj FROM refs UNION SELECT doc_id, dst FROM refs)
)"""
_SPANS = f"""WITH tokens AS (
  SELECT page_id, unnest(range(len(ts)))::INT AS pos, unnest(ts) AS token FROM (SELECT page_id, regexp_extract_all(html, '{TOKEN}') AS ts FROM pages)
), tagged AS (
  SELECT *, lower(regexp_extract(token, '{TAG}', 1)) AS tag FROM tokens
), kinds AS (
  SELECT *, CASE WHEN token NOT LIKE '<%' THEN CASE WHEN regexp_matches(token, '&[a-z]+;') THEN 'name' WHEN regexp_matches(token, '[^\\x20\\x09-\\x0D]') THEN 'text' ELSE 'other' END WHEN tag = '' OR tag IN {(*RAW, *VOID, *OPEN)} THEN 'other' WHEN token LIKE '</%' THEN 'end' ELSE 'begin' END AS kind FROM tagged
), deep AS (
  SELECT *, sum(CASE kind WHEN 'begin' THEN 1 WHEN 'end' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) AS depth FROM kinds
), pairs AS (
  SELECT b.page_id, b.pos AS start, b.tag, regexp_matches(b.token, ' (title|alt|class|lang|href)=') AS describes, min(e.pos) AS end_ FROM deep b LEFT JOIN deep e ON e.page_id = b.page_id AND e.kind = 'end' AND e.pos > b.pos AND e.depth = b.depth - 1 WHERE b.kind = 'begin' GROUP BY ALL
), bad AS (
  SELECT DISTINCT page_id FROM (SELECT page_id FROM deep WHERE depth < 0 UNION ALL SELECT p.page_id FROM pairs p LEFT JOIN kinds k ON k.page_id = p.page_id AND k.pos = p.end_ WHERE k.tag IS DISTINCT FROM p.tag)
)
SELECT p.page_id, start, end_ AS "end", tag, describes, unsure, names, shows_text FROM (
  SELECT p.page_id, start, end_, p.tag, describes, p.page_id IN (SELECT page_id FROM bad) AS unsure, CASE WHEN end_ IS NOT NULL THEN count(*) FILTER (k.kind = 'name')::INT END AS names, CASE WHEN end_ IS NOT NULL THEN count(*) FILTER (k.kind = 'text') > 0 END AS shows_text
  FROM pairs p LEFT JOIN kinds k ON k.page_id = p.page_id AND k.pos > p.start AND k.pos < p.end_ GROUP BY p.page_id, start, end_, p.tag, describes) p"""
_BLANK = """WITH v AS (
  SELECT vec_id, embedding, list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))) / 64 AS size FROM embeddings WHERE len(embedding) = 64
), px AS (
  SELECT vec_id, abs(x::DOUBLE) > 1.5 * size AS dark, i % 8 AS col, i // 8 AS row FROM (SELECT vec_id, size, unnest(embedding) AS x, unnest(range(64)) AS i FROM v)
), at_ AS (
  SELECT vec_id, dark, (col + 0.5) / 8 * 80 + vec_id % 5 AS x, (row + 0.5) / 8 * 80 + 3 AS y, vec_id % 40 + 0.13::DOUBLE AS a, vec_id % 37 + 3.29::DOUBLE AS b, (vec_id % 4) * 3.1::DOUBLE AS u FROM px
), inside AS (
  SELECT *, 31.7 * (y - b) - u * (x - a) >= 0 AND -u * (y - b - u) - 17.3 * (x - a - 31.7) >= 0 AND -31.7 * (y - b - 17.3 - u) + u * (x - a - 31.7 + u) >= 0 AND u * (y - b - 17.3) + 17.3 * (x - a + u) >= 0 AS held FROM at_
)
SELECT 't-' || vec_id AS target_id, NOT bool_or(dark AND held) AS blank FROM inside GROUP BY vec_id"""

QUERIES = {f.__name__: f for f in (objects_by_role, glyph_verdicts, objects_left_out, marked_spans, blank_targets)}
ORACLE = {
    "objects_by_role": f"{_WALK} SELECT doc_id, role, count(*) AS objects, coalesce(any_value(n), 0)::BIGINT AS stray_keys FROM reached LEFT JOIN (SELECT w.doc_id, w.role, count(*) AS n FROM reached w JOIN (SELECT DISTINCT doc_id, src, key FROM refs) f ON w.doc_id = f.doc_id AND w.obj = f.src WHERE NOT EXISTS (SELECT 1 FROM rules u WHERE u.role = w.role AND u.key = f.key) GROUP BY 1, 2) USING (doc_id, role) GROUP BY doc_id, role",
    "glyph_verdicts": f"{_WALK} SELECT doc_id, CASE WHEN bool_or(obj IN (SELECT obj FROM reached w WHERE w.doc_id = k.doc_id AND role = 'glyph') AND shows_text) THEN 'text' WHEN bool_or(kind IN ('form', 'picture', 'pattern', 'procedure') AND obj IN (SELECT obj FROM reached w WHERE w.doc_id = k.doc_id AND role = 'glyph') AND obj IN (SELECT obj FROM reached w WHERE w.doc_id = k.doc_id AND role <> 'glyph')) THEN 'shared' ELSE 'clean' END AS verdict FROM kinds k GROUP BY doc_id",
    "objects_left_out": f"{_WALK} SELECT doc_id, kind, count(*) AS n FROM kinds WHERE (doc_id, obj) NOT IN (SELECT doc_id, obj FROM reached) GROUP BY 1, 2",
    "marked_spans": _SPANS,
    "blank_targets": _BLANK,
}
