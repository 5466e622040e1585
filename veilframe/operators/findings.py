"""What a page holds beside its text, as plan stages over characters and drawings: a stage a finding, joined by page at the end.

Shares of a page are counted over the middles of GRID by GRID cells, so what overlaps counts once; every test of a place against an
outline is spatial.inside().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codes
from ..functions import geometry as g
from ..sources.shared import bucketed
from . import spatial

# Thresholds of page readings, and the findings in display order.
GRID, PICTURE_SHARE, TEXT_SHARE, FEW_CHARS, BARE_SHARE, COVER_SHARE, LEAST_CONTRAST = 64, 0.05, 0.05, 40, 0.5, 0.8, 1.1
UNREADABLE_RUN, MACHINE_RUN, PAST = 3, 3, 1.0
FINDINGS = ("covered-text", "hidden-text", "scanned", "drawn-only", "unreadable-text", "bare-picture", "off-page-picture", "marked-descriptions", "machine-read-text", "off-page-content", "blank")
PAGE = ["doc_id", "page"]
#: Places along each side of a character's box that are looked at for covers.
SIDE = 5


def kind_of(code: Column) -> Column:
    """'counts' for letters and numbers, 'goes-on' for marks and format characters, 'unmapped', 'blank' or 'other'. Plain letters and digits are known by their codes, without a pattern."""
    c = codes.character(code)
    plain = code.between(48, 57) | code.between(65, 90) | code.between(97, 122)
    return F.when(plain, "counts").when((c == "�") | c.rlike(r"[\p{Co}\p{Cs}]"), "unmapped").when(c.rlike(r"[\p{L}\p{N}]"), "counts").when(c.rlike(r"[\p{M}\p{Cf}]"), "goes-on").when(codes.space(code) | c.rlike(r"\p{Cc}"), "blank").otherwise("other")


def glyphs(characters: DataFrame, drawings: DataFrame) -> DataFrame:
    """Characters with kind, centre (x, y), box, and what draws them: ord and contrast of the last glyph of the idx, and whether it is shown or invisible (neither where nothing draws them)."""
    drawn = drawings.filter("kind = 'glyph'").groupBy(*PAGE, "idx").agg(F.max_by(F.struct("ord", "visible", "alpha", "contrast"), "ord").alias("_g"))
    b, (x, y) = g.bounds(F.col("quad")), g.centre(F.col("quad"))
    c = characters.select(*PAGE, "idx", "line", kind_of(F.col("code")).alias("kind"), (x / 4).alias("x"), (y / 4).alias("y"), *(v.alias(k) for k, v in b.items()))
    lit = F.coalesce(F.col("_g.visible"), F.lit(True)) & (F.coalesce(F.col("_g.alpha"), F.lit(1.0)) > 0)
    has = F.col("_g").isNotNull()
    return c.join(drawn, [*PAGE, "idx"], "left").select(*c.columns, F.col("_g.ord").alias("ord"), F.col("_g.contrast").alias("contrast"), (has & lit).alias("shown"), (has & ~lit).alias("invisible"))


def runs(rows: DataFrame, same: Column) -> DataFrame:
    """(doc_id, page, same, n): stretches of neighbours on a line that are alike in `same` (null: no stretch). Marks and format characters (kind goes-on) neither count nor part a stretch."""
    page = Window.partitionBy(*PAGE).orderBy("idx")
    r = rows.withColumn("same", same).filter("kind <> 'goes-on'")
    changes = [~F.col(c).eqNullSafe(F.lag(c).over(page)) for c in ("same", "line")]
    r = r.withColumn("_new", F.col("same").isNull() | changes[0] | changes[1])
    r = r.withColumn("_run", F.count_if("_new").over(page.rowsBetween(Window.unboundedPreceding, 0)))
    return r.filter("same is not null").groupBy(*PAGE, "_run", "same").agg(F.count("*").alias("n")).select(*PAGE, "same", "n")


def pictures(sheets: DataFrame, images: DataFrame) -> DataFrame:
    """(doc_id, page, quad, at, x, y): the cells of each image that takes PICTURE_SHARE of its page. Images alike in outline are one."""
    with_images = sheets.join(images.select(*PAGE).distinct(), PAGE, "left_semi")
    cells = with_images.select(*PAGE, "width", "height", F.explode(F.sequence(F.lit(0), F.lit(GRID * GRID - 1))).alias("at"))
    cells = cells.select(*PAGE, "at", ((F.col("at") % GRID + 0.5) / GRID * F.col("width")).alias("x"), ((F.floor(F.col("at") / GRID) + 0.5) / GRID * F.col("height")).alias("y"))
    held = spatial.inside(cells, images.select(*PAGE, "quad").distinct(), PAGE)
    return held.withColumn("_n", F.count("*").over(Window.partitionBy(*PAGE, "quad"))).filter(F.col("_n") >= PICTURE_SHARE * GRID * GRID).drop("_n")


def bare(drawn: DataFrame, pictured: DataFrame, images: DataFrame) -> DataFrame:
    """(doc_id, page, share): of pages with pictures that neither lines of words nor machine-read text go with, the share that such pictures take."""
    drawn = drawn.join(images.select(*PAGE).distinct(), PAGE, "left_semi")
    told = ~F.col("kind").isin("unmapped", "blank")
    lines = drawn.groupBy(*PAGE, "line").agg(F.bool_or(F.col("kind") == "counts").alias("_words"), F.bool_and(F.col("shown") | ~told).alias("_seen"), *(f(k).alias(k) for k, f in (("x0", F.min), ("y0", F.min), ("x1", F.max), ("y1", F.max))))
    boxes = lines.filter("_words and _seen").select(*PAGE, F.array("x0", "y0", "x1", "y0", "x0", "y1", "x1", "y1").alias("quad"))
    written = spatial.inside(pictured.select(*PAGE, "at", "x", "y").distinct(), boxes, PAGE).select(*PAGE, "at").distinct().withColumn("_written", F.lit(True))
    plain = pictured.join(written, [*PAGE, "at"], "left").groupBy(*PAGE, "quad").agg(F.count("_written").alias("_w"), F.count("*").alias("_n")).filter(F.col("_w") < TEXT_SHARE * F.col("_n"))
    unseen = drawn.filter("invisible and kind = 'counts'").select(*PAGE, "idx", "x", "y")
    alone = spatial.inside(unseen, pictured.select(*PAGE, "quad").distinct(), PAGE).groupBy(*PAGE, "idx").agg(F.count("*").alias("_in"), F.first("quad").alias("quad")).filter("_in = 1")
    read = runs(drawn.select(*PAGE, "idx", "line", "kind").join(alone.select(*PAGE, "idx", "quad"), [*PAGE, "idx"], "left"), F.col("quad")).filter(F.col("n") >= MACHINE_RUN).select(*PAGE, F.col("same").alias("quad")).distinct()
    left = pictured.join(plain.select(*PAGE, "quad"), [*PAGE, "quad"], "left_semi").join(read, [*PAGE, "quad"], "left_anti")
    return left.groupBy(*PAGE).agg((F.count_distinct("at") / float(GRID * GRID)).alias("share"))


def concealed(drawn: DataFrame, drawings: DataFrame) -> DataFrame:
    """(doc_id, page, idx, concealment, over): characters that a reader does not see, and those drawn invisible over an image (concealment null, over true)."""
    covers = drawings.filter("kind = 'cover' and opaque").select(*PAGE, F.col("ord").alias("_later"), "quad")
    boxes = drawn.filter("ord is not null").join(covers.select(*PAGE).distinct(), PAGE, "left_semi").select(*PAGE, "idx", "ord", "x0", "y0", "x1", "y1")
    met = spatial.places_inside(boxes, covers, PAGE, SIDE).filter("_later > ord")
    under = met.groupBy(*PAGE, "idx").agg((F.bit_count(F.bit_or("_mask")) >= COVER_SHARE * SIDE * SIDE).alias("_under"))
    over = spatial.inside(drawn.filter("invisible").select(*PAGE, "idx", "x", "y"), drawings.filter("kind = 'image'").select(*PAGE, "quad").distinct(), PAGE).select(*PAGE, "idx").distinct().withColumn("_over", F.lit(True))
    c = drawn.filter("ord is not null").join(under, [*PAGE, "idx"], "left").join(over, [*PAGE, "idx"], "left").select("*", F.coalesce("_over", F.lit(False)).alias("over"))
    faint = F.col("shown") & F.coalesce(F.col("contrast") < LEAST_CONTRAST, F.lit(False))
    why = F.when(F.col("_under"), "covered").when(faint | F.col("invisible") & ~F.col("over"), "hidden")
    return c.withColumn("concealment", why).filter("concealment is not null or over").select(*PAGE, "idx", "concealment", "over")


def findings(sheets: DataFrame, characters: DataFrame, drawings: DataFrame) -> DataFrame:
    """(doc_id, page, findings) of every page of sheets (doc_id, page, width, height), in display order. A page without characters or drawings is blank.

    Every finding looks at the characters with what draws them: they are matched once, into a table that lies by page, so no
    stage that reads it numbers, matches or shuffles them again. The table stays for the lazy result.
    """
    drawn = characters.sparkSession.table(bucketed(glyphs(characters, drawings), PAGE))
    images = drawings.filter("kind = 'image'")
    bare_ = bare(drawn, pictures(sheets, images), images).select(*PAGE, F.col("share").alias("bare"))
    unseen = concealed(drawn, drawings).groupBy(*PAGE).agg(F.bool_or(F.coalesce(F.col("concealment") == "covered", F.lit(False))).alias("covered"), F.bool_or(F.coalesce(F.col("concealment") == "hidden", F.lit(False))).alias("hidden"), F.bool_or("over").alias("machine"))
    unmapped = runs(drawn, F.when(F.col("kind") == "unmapped", True)).groupBy(*PAGE).agg((F.max("n") >= UNREADABLE_RUN).alias("unmapped"))
    size = sheets.select(*PAGE, F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height"))
    outside = (F.col("x1") <= 0) | (F.col("y1") <= 0) | (F.col("x0") >= F.col("width")) | (F.col("y0") >= F.col("height"))
    past = (F.col("x0") < -PAST) | (F.col("y0") < -PAST) | (F.col("x1") > F.col("width") + PAST) | (F.col("y1") > F.col("height") + PAST)
    chars = drawn.join(size, PAGE).groupBy(*PAGE).agg(F.count_if(~F.col("kind").isin("unmapped", "blank")).alias("readable"), F.bool_or(outside).alias("off_chars"))
    b = g.bounds(F.col("quad"))
    is_ = lambda *kinds: F.col("kind").isin(*kinds)
    marks = drawings.select(*PAGE, "kind", "contrast", *(v.alias(k) for k, v in b.items())).join(size, PAGE).groupBy(*PAGE).agg(
        F.count_if(is_("glyph")).alias("glyphs"), F.count_if(is_("image")).alias("images"), F.count_if(is_("path", "cover") & (F.coalesce("contrast", F.lit(LEAST_CONTRAST)) >= LEAST_CONTRAST)).alias("paths"),
        F.bool_or(is_("image") & past).alias("off_picture"), F.bool_or(is_("path", "cover") & outside).alias("off_paths"), F.bool_or(is_("description")).alias("described"),
    )
    t = size
    for part in (chars, marks, bare_, unseen, unmapped):
        t = t.join(part, PAGE, "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    scanned = (n("readable") < FEW_CHARS) & (n("bare") >= BARE_SHARE)
    blank = (n("glyphs") == 0) & (n("images") == 0) & (n("paths") == 0)
    holds = (
        yes("covered"), yes("hidden"), scanned, (n("glyphs") == 0) & ~scanned & ~blank, yes("unmapped") | (n("glyphs") > 0) & (n("readable") == 0), F.col("bare").isNotNull() & ~scanned,
        yes("off_picture"), yes("described"), yes("machine"), yes("off_paths") | yes("off_chars"), blank,
    )
    return t.select(*PAGE, F.array_compact(F.array(*(F.when(h, name) for name, h in zip(FINDINGS, holds, strict=True)))).alias("findings"))
