"""A document's objects, marked spans and rasters as tables: reachability by role, what glyphs draw, spans by depth, blank pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import bucketed

STATE = ["doc_id", "obj", "role"]
#: Roles in one whole number.
WORD = 62


def kept(refs: DataFrame) -> DataFrame:
    """Distinct refs (doc_id, src, key, dst) as a table bucketed by (doc_id, src): dealt out once, whatever walks over them."""
    dealt = refs.select("doc_id", "src", "key", "dst").repartition("doc_id", "src").distinct()
    return refs.sparkSession.table(bucketed(dealt, ["doc_id", "src"]))


def walk(refs: DataFrame, rules: DataFrame, roots: DataFrame) -> DataFrame:
    """(doc_id, obj, role): every object that roots (doc_id, obj, role) reach over refs (doc_id, src, key, dst), in each role in which it is reached.

    rules (role, key, becomes), few and collected: a role's allowed keys, and the role that what stands there is reached in. An
    object's roles are bits of whole numbers. Rounds of joins over the bits that the last round has newly set, until there are
    none. What is reached is added to a table bucketed by object, so with refs as of kept() a round shuffles only what its new
    bits refer to: each state of an object is looked at, moved and written once.
    """
    spark, allowed = refs.sparkSession, rules.select("role", "key", "becomes").distinct().collect()
    roles = sorted({r.role for r in allowed} | {r.becomes for r in allowed} | {r.role for r in roots.select("role").distinct().collect()}, key=str)
    bits = [f"_bits{w}" for w in range(-(-len(roles) // WORD) or 1)]
    bit = {role: (f"_bits{i // WORD}", 1 << i % WORD) for i, role in enumerate(roles)}
    has = lambda role: F.col(bit[role][0]).bitwiseAND(F.lit(bit[role][1])) != 0
    gather = [F.bit_or(b).alias(b) for b in bits]

    def given(b: str, pairs: list[tuple]) -> Column:
        """The bits of word b whose conditions hold; pairs: (condition, role)."""
        word = F.lit(0).cast("long")
        for holds, role in pairs:
            if bit[role][0] == b:
                word = word.bitwiseOR(F.when(holds, F.lit(bit[role][1]).cast("long")).otherwise(F.lit(0).cast("long")))
        return word.alias(b)

    first = roots.select("doc_id", "obj", *(given(b, [(F.col("role").eqNullSafe(F.lit(r)), r) for r in roles]) for b in bits)).groupBy("doc_id", "obj").agg(*gather)
    table, n = bucketed(first.withColumn("_round", F.lit(0)), ["doc_id", "obj"]), 0
    leads = [(has(r.role) & (F.col("key") == r.key), r.becomes) for r in allowed]
    edges = refs.select(F.col("doc_id"), F.col("src").alias("obj"), "key", "dst")
    while not (new := spark.table(table).filter(F.col("_round") == n)).isEmpty():
        n += 1
        met = new.drop("_round").join(edges, ["doc_id", "obj"]).select("doc_id", F.col("dst").alias("obj"), *(given(b, leads) for b in bits))
        met = met.filter(" or ".join(f"{b} <> 0" for b in bits)).groupBy("doc_id", "obj").agg(*gather)
        seen = spark.table(table).groupBy("doc_id", "obj").agg(*(F.bit_or(b).alias(f"_seen{b}") for b in bits))
        fresh = met.join(seen, ["doc_id", "obj"], "left").select("doc_id", "obj", *(F.col(b).bitwiseAND(F.bitwise_not(F.coalesce(f"_seen{b}", F.lit(0).cast("long")))).alias(b) for b in bits))
        bucketed(fresh.filter(" or ".join(f"{b} <> 0" for b in bits)).withColumn("_round", F.lit(n)), ["doc_id", "obj"], table)
    of = spark.table(table).groupBy("doc_id", "obj").agg(*gather)
    return of.select("doc_id", "obj", F.explode(F.filter(F.array(*[F.when(has(r), F.struct(F.lit(r).cast("string").alias("role"))) for r in roles]), lambda r: r.isNotNull())).alias("_r")).select("doc_id", "obj", "_r.role") if roles else roots.select(*STATE)


def strays(refs: DataFrame, rules: DataFrame, reached: DataFrame) -> DataFrame:
    """(doc_id, obj, role, key): keys that a reached object holds and none of its roles' rules allows in that role."""
    held = reached.join(refs.select("doc_id", F.col("src").alias("obj"), "key").distinct(), ["doc_id", "obj"])
    return held.join(F.broadcast(rules.select("role", "key")), ["role", "key"], "left_anti").select(*STATE, "key")


def unreached(objects: DataFrame, reached: DataFrame) -> DataFrame:
    """Objects (doc_id, obj, ...) that nothing reaches: what a rewrite leaves out."""
    return objects.join(reached.select("doc_id", "obj").distinct(), ["doc_id", "obj"], "left_anti")


def glyph_rule(reached: DataFrame, objects: DataFrame, below: str = "glyph", kinds: tuple[str, ...] = ("form", "picture", "pattern", "procedure")) -> DataFrame:
    """(doc_id, verdict) of every document with objects: 'text' if a drawing below a glyph shows text, 'shared' if one is also reached in another role, else 'clean'. objects: (doc_id, obj, kind, shows_text); only drawings (kinds) count as shared. Sides are sets of (doc_id, obj), compared by one aggregate an object."""
    sides = reached.groupBy("doc_id", "obj").agg(F.bool_or(F.col("role") == below).alias("_below"), F.bool_or(F.col("role") != below).alias("_other"))
    o = objects.join(sides, ["doc_id", "obj"], "left")
    under = F.coalesce("_below", F.lit(False))
    each = o.groupBy("doc_id").agg(F.bool_or(under & F.coalesce("shows_text", F.lit(False))).alias("_text"), F.bool_or(under & F.coalesce("_other", F.lit(False)) & F.col("kind").isin(*kinds)).alias("_shared"))
    return each.select("doc_id", F.when(F.col("_text"), "text").when(F.col("_shared"), "shared").otherwise("clean").alias("verdict"))


def marked_spans(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, end, tag, describes, names, shows_text, unsure): the spans that 'begin' and 'end' tokens mark, by place.

    tokens: (keys, pos, kind, tag, described): kind is begin, end, text, name or other. A begin and its end stand at the same depth,
    with no other of that depth between, so within a depth they take turns. describes: the begin itself is described; names and
    shows_text count what lies inside, by differences of running counts. A stream whose ends don't match its begins (one too
    many, one too few, or of another tag) is unsure as a whole.
    """
    upto = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    is_ = lambda k: F.col("kind") == k
    t = tokens.withColumns({"_depth": F.sum(F.when(is_("begin"), 1).when(is_("end"), -1).otherwise(0)).over(upto), "_names": F.count_if(is_("name")).over(upto), "_texts": F.count_if(is_("text")).over(upto)})
    t = t.filter(is_("begin") | is_("end")).withColumn("_level", F.col("_depth") + is_("end").cast("int"))
    level = Window.partitionBy(*keys, "_level").orderBy("pos")
    after = lambda c: F.lead(c).over(level)
    t = t.withColumns({"_kind": after("kind"), "_tag": after("tag"), "end": after("pos"), "names": (after("_names") - F.col("_names")).cast("int"), "shows_text": after("_texts") > F.col("_texts")})
    whole = Window.partitionBy(*keys)
    fits = F.when(is_("begin"), (F.col("_kind") == "end") & F.col("_tag").eqNullSafe(F.col("tag"))).otherwise(F.col("_depth") >= 0)
    t = t.withColumn("unsure", ~F.bool_and(F.coalesce(fits, F.lit(False))).over(whole))
    return t.filter(is_("begin")).select(*keys, F.col("pos").alias("start"), "end", "tag", F.coalesce("described", F.lit(False)).alias("describes"), "names", "shows_text", "unsure")


def _pixel(transform: Column, x: Column, y: Column, columns: Column, rows: Column) -> tuple[Column, Column]:
    """A place of the page in an image's pixels; null where the image has no place."""
    a, b, c, d, e, f = (F.element_at(transform, i) for i in range(1, 7))
    det = a * d - b * c
    return F.try_divide((x - e) * d - (y - f) * c, det) * columns, F.try_divide((y - f) * a - (x - e) * b, det) * rows


def blank_pixels(targets: DataFrame, images: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """(target_id, blank): is every pixel of the page's images that is centred inside a target's quad blank? An image without a place counts as not blank; a target that meets no image is blank.

    targets: (keys, target_id, quad); images: (keys, image, transform, columns, rows); runs: (keys, image, row, first, last): the
    pixels that are not blank, run by run. A convex quad covers one stretch of each row of pixels, found from where its sides
    cross the row's middle; stretches and runs meet by image and row, never pixel by pixel.
    """
    t = targets.join(images, keys)
    corner = lambda i: (F.element_at("quad", 2 * i + 1), F.element_at("quad", 2 * i + 2))
    for i in range(4):
        x, y = _pixel(F.col("transform"), *corner(i), F.col("columns"), F.col("rows"))
        t = t.withColumn(f"_x{i}", x).withColumn(f"_y{i}", y)
    ys = [F.col(f"_y{i}") for i in range(4)]
    placed = F.coalesce(F.greatest(*(F.abs(f"_{c}{i}") for c in "xy" for i in range(4))) < 1e9, F.lit(False))
    t = t.withColumns({"_placed": placed, "_top": F.greatest(F.lit(0), F.ceil(F.least(*ys) - 0.5)).cast("long"), "_low": F.least(F.col("rows") - 1, F.floor(F.greatest(*ys) - 0.5)).cast("long")})
    lost = t.filter("not _placed").select("target_id").distinct().withColumn("_lost", F.lit(True))
    t = t.filter("_placed and _top <= _low").withColumn("row", F.explode(F.sequence("_top", "_low"))).withColumn("_at", F.col("row") + 0.5)
    crossings = []
    for i, j in ((0, 1), (1, 3), (3, 2), (2, 0)):
        xa, ya, xb, yb = (F.col(f"_{c}{k}") for k in (i, j) for c in "xy")
        crossings.append(F.when((F.least(ya, yb) <= F.col("_at")) & (F.greatest(ya, yb) >= F.col("_at")), xa + F.coalesce(F.try_divide(F.col("_at") - ya, yb - ya), F.lit(0.0)) * (xb - xa)))
    t = t.withColumns({"_from": F.ceil(F.least(*crossings) - 0.5).cast("long"), "_to": F.floor(F.greatest(*crossings) - 0.5).cast("long")})
    hit = t.filter("_from <= _to").select(*keys, "image", "row", "target_id", "_from", "_to").join(runs, [*keys, "image", "row"]).filter("first <= _to and last >= _from").select("target_id").distinct().withColumn("_hit", F.lit(True))
    return targets.select("target_id").distinct().join(hit, "target_id", "left").join(lost, "target_id", "left").select("target_id", (F.col("_hit").isNull() & F.col("_lost").isNull()).alias("blank"))
