"""URL filter by rules, and by a ratio of character language models where no rule fits.

URLs that a rule allows or blocks teach two Markov models of variable order: a symbol is told from up to ORDER symbols before
it, as far back as that context stands for at least SHARE of all symbols learned; probabilities are smoothed by Witten and Bell's
rule, each order going on from the shorter one. A URL's score is the difference of its log-likelihoods a symbol; the threshold is
calibrated on rule-judged URLs that the models were not taught. Built-in expressions alone: counts are grouped, models are
tables of a bounded size (at most 1 / SHARE contexts an order), scoring is lookups in the broadcast tables.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Longest context; least share of all symbols that a context stands for; bins of a score's unit in calibration, and the largest score told apart.
ORDER, SHARE, BINS, FAR = 3, 1 / 2048, 256, 8
#: Symbols: printable ASCII, and one each for other characters, for what stands before a URL and for its end.
OTHER, START, END = "\x01", "\x02", "\x03"
ALPHABET = [chr(c) for c in range(0x21, 0x7F)] + [OTHER, END]


class Rule(NamedTuple):
    allow: bool
    host: str
    path: str


#: The rules of the query.
RULES = [Rule(False, "net", "/"), Rule(True, "example.net", "/en/"), Rule(False, "example.com", "/de/"), Rule(True, "org", "/fr/")]


def host_of(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z lowered; '' without one."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), upper, upper.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; '' without a host's ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _longest(rules: list[Rule], host: Column, path: Column, value) -> Column:
    out = F.lit(None)
    for r in sorted(rules, key=lambda r: len(r.host + r.path)):
        out = F.when(((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path), F.lit(value(r))).otherwise(out)
    return out


def judged(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """(page_id, url, host, path, rule, allow) of every page; rule and allow are those of the longest rule that fits, or null."""
    parsed = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    at = F.col("host"), F.col("path")
    return parsed.select("*", _longest(rules, *at, lambda r: r.host + r.path).cast("string").alias("rule"), _longest(rules, *at, lambda r: r.allow).cast("boolean").alias("allow"))


def grams(url: Column) -> Column:
    """Each symbol of a URL behind the ORDER symbols before it; a null URL is empty."""
    symbols = F.regexp_replace(F.coalesce(url, F.lit("")), r"[^\x21-\x7E]", OTHER)
    return F.regexp_extract_all(F.concat(F.lit(START * ORDER), symbols, F.lit(END)), F.lit(rf"(?s)(?=(.{{{ORDER + 1}}}))"), F.lit(1))


class Model(NamedTuple):
    """entries (gram, gain): log-probability of a gram's last symbol after the others, accepted less rejected. contexts (context, gain): what a symbol never seen after this context adds to its gain after the shorter one."""

    entries: DataFrame
    contexts: DataFrame


def _told(n: Column, total: Column, kinds: Column, shorter: Column) -> Column:
    """Witten and Bell: seen counts, and as much weight as there are kinds of symbols for the shorter context."""
    return F.when(total > 0, (n + kinds * shorter) / (total + kinds)).otherwise(shorter)


def fit(spark: SparkSession, labelled: DataFrame) -> Model:
    """Both models of (url, allow). Without accepted or without rejected URLs that side is even over the alphabet. Repeated URLs count each; null URLs are empty ones."""
    one = labelled.select(F.explode(grams(F.col("url"))).alias("gram"), "allow").groupBy("gram").agg(F.count_if("allow").alias("yes"), F.count_if(~F.col("allow")).alias("no"))
    each = one.select(F.explode(F.array(*(F.substring("gram", -k - 1, k + 1) for k in range(ORDER + 1)))).alias("gram"), "yes", "no").groupBy("gram").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    counted = common.cut(spark, each.select("gram", F.expr("left(gram, length(gram) - 1)").alias("context"), "yes", "no"), "url-grams")
    kinds = counted.groupBy("context").agg(F.sum("yes").alias("n_yes"), F.sum("no").alias("n_no"), F.count_if(F.col("yes") > 0).alias("k_yes"), F.count_if(F.col("no") > 0).alias("k_no"))
    whole = counted.filter("context = ''").agg(F.sum(F.col("yes") + F.col("no"))).first()[0] or 0
    kinds = kinds.filter((F.col("n_yes") + F.col("n_no") >= SHARE * whole) | (F.col("context") == ""))
    symbols = spark.range(1).select(F.explode(F.array(*(F.lit(c) for c in ALPHABET))).alias("gram"))
    known = symbols.join(F.broadcast(counted.filter("context = ''").drop("context")), "gram", "left").select("gram", F.lit("").alias("context"), F.coalesce("yes", F.lit(0)).alias("yes"), F.coalesce("no", F.lit(0)).alias("no"))
    even = F.lit(1 / len(ALPHABET))
    levels, shorter, first = [], None, kinds.filter("context = ''").first()
    for k in range(ORDER + 1):
        if k == 0:
            rows = known.withColumns({c: F.lit(first[c] if first else 0) for c in kinds.columns[1:]} | {"p": even, "q": even})
        else:
            rows = counted.filter(F.length("context") == k).join(F.broadcast(kinds.filter(F.length("context") == k)), "context")
            rows = rows.join(F.broadcast(shorter.select(F.col("gram").alias("end"), F.col("p_yes").alias("p"), F.col("p_no").alias("q"))), F.substring("gram", -k, k) == F.col("end"))
        shorter = rows.select("gram", _told(*(F.col(c) for c in ("yes", "n_yes", "k_yes", "p"))).alias("p_yes"), _told(*(F.col(c) for c in ("no", "n_no", "k_no", "q"))).alias("p_no"))
        shorter = common.cut(spark, shorter, f"url-order-{k}")
        levels.append(shorter.select("gram", (F.ln("p_yes") - F.ln("p_no")).alias("gain")))
    entries = levels[0]
    for level in levels[1:]:
        entries = entries.unionByName(level)
    unseen = lambda n, k: F.when(F.col(n) > 0, F.ln(F.col(k) / (F.col(n) + F.col(k)))).otherwise(F.lit(0.0))
    contexts = kinds.filter("context <> ''").select("context", (unseen("n_yes", "k_yes") - unseen("n_no", "k_no")).alias("gain"))
    return Model(common.cut(spark, entries, "url-entries"), common.cut(spark, contexts, "url-contexts"))


def score(rows: DataFrame, model: Model, url: str = "url") -> DataFrame:
    """The rows with score: the log-likelihood of the URL as accepted less as rejected, divided by its symbols. Repeated rows stay; the url goes."""
    key, = common.fresh(rows, "_row")
    kept = [c for c in rows.columns if c != url]
    at = rows.withColumn(key, F.monotonically_increasing_id()).select(key, *kept, F.explode(grams(F.col(url))).alias("_gram"))
    for k in range(1, ORDER + 2):
        part = model.entries.select(F.col("gram").alias(f"_g{k}"), F.col("gain").alias(f"_v{k}"))
        at = at.join(F.broadcast(part), F.substring("_gram", -k, k) == F.col(f"_g{k}"), "left")
        if k > 1:
            part = model.contexts.select(F.col("context").alias(f"_c{k}"), F.col("gain").alias(f"_b{k}"))
            at = at.join(F.broadcast(part), F.substring("_gram", ORDER + 2 - k, k - 1) == F.col(f"_c{k}"), "left")
    gain = F.col("_v1")
    for k in range(2, ORDER + 2):
        gain = F.coalesce(F.col(f"_v{k}"), F.coalesce(F.col(f"_b{k}"), F.lit(0.0)) + gain)
    return at.groupBy(key, *kept).agg(F.round(F.avg(gain), 9).alias("score")).drop(key)


def threshold(scored: DataFrame) -> float:
    """The score that parts (allow, score) best: the least mean of both error rates; of equal ones the nearest to 0, then the smaller. Between two filled bins it lies in the middle; without scores it is 0."""
    step = F.floor(F.greatest(F.least("score", F.lit(float(FAR))), F.lit(float(-FAR))) * BINS)
    bins = scored.select(step.cast("int").alias("bin"), "allow").groupBy("bin").agg(F.count_if("allow").alias("yes"), F.count_if(~F.col("allow")).alias("no"))
    bins = bins.withColumn("_all", F.lit(0))  # at most 2 * FAR * BINS + 1 rows
    upto, all_ = Window.partitionBy("_all").orderBy("bin"), Window.partitionBy("_all")
    rate = lambda n, of: F.when(of > 0, n / of).otherwise(0.0)
    tried = bins.withColumns({
        "at": (F.coalesce(F.lag("bin").over(upto) + 1, "bin") + F.col("bin")) / (2.0 * BINS),
        "wrong": rate(F.sum("yes").over(upto) - F.col("yes"), F.sum("yes").over(all_)) + rate(F.sum("no").over(all_) - F.sum("no").over(upto) + F.col("no"), F.sum("no").over(all_)),
        "none": rate(F.sum("yes").over(all_), F.sum("yes").over(all_)), "last": F.max("bin").over(all_),
    })
    above = tried.filter("bin = last").select(((F.col("last") + 1) / float(BINS)).alias("at"), F.col("none").alias("wrong"))
    best = tried.select("at", "wrong").unionByName(above).orderBy(F.round("wrong", 9), F.abs("at"), "at").first()
    return float(best["at"]) if best is not None else 0.0


def held_out(url: Column) -> Column:
    """Is a URL left for calibration? 3 in 16, by its hash."""
    return F.substring(F.md5(F.coalesce(url, F.lit(""))), 1, 1).isin("0", "1", "2")


def filtered(spark: SparkSession, pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """(page_id, host, path, rule, score, verdict) of every row of pages (page_id, url); score is null where a rule decides.

    Null URLs and those without :// have neither host nor path and are judged by the models like others (null as empty); very
    long URLs are read whole; the longest rule wins; repeated rows stay; other columns are left behind; an empty table has no
    rows. A score at the threshold is allowed.
    """
    known = judged(pages, rules)
    labelled = known.filter("rule is not null")
    model = fit(spark, labelled.filter(~held_out(F.col("url"))).select("url", "allow"))
    least = threshold(score(labelled.filter(held_out(F.col("url"))).select("url", "allow"), model))
    rest = score(known.filter("rule is null").select("page_id", "url", "host", "path", "rule"), model)
    verdict = lambda allowed: F.when(allowed, "allow").otherwise("block").alias("verdict")
    ruled = labelled.select("page_id", "host", "path", "rule", F.lit(None).cast("double").alias("score"), verdict(F.col("allow")))
    return ruled.unionByName(rest.select("page_id", "host", "path", "rule", "score", verdict(F.col("score") >= least)))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    return filtered(spark, common.table(spark, sf_dir, "pages"), RULES).drop("score")


def _lookups() -> str:
    joins, gain = "", "v1.gain"
    for k in range(1, ORDER + 2):
        joins += f" LEFT JOIN entries v{k} ON v{k}.gram = right(g.gram, {k})"
        if k > 1:
            joins += f" LEFT JOIN contexts b{k} ON b{k}.context = g.gram[{ORDER + 2 - k}:{ORDER}]"
            gain = f"coalesce(v{k}.gain, coalesce(b{k}.gain, 0) + {gain})"
    return f"SELECT g.r, round(avg({gain}), 9) AS score FROM grams g{joins} GROUP BY g.r"


def _levels() -> str:
    out = []
    for k in range(ORDER + 1):
        rows = "(SELECT a.gram, '' AS context, coalesce(c.yes, 0) AS yes, coalesce(c.no, 0) AS no FROM alphabet a LEFT JOIN (SELECT * FROM counted WHERE context = '') c USING (gram))" if k == 0 else f"(SELECT * FROM counted WHERE length(context) = {k})"
        shorter = f"(SELECT 1.0::DOUBLE / {len(ALPHABET)} AS p, 1.0::DOUBLE / {len(ALPHABET)} AS q) s" if k == 0 else f"level{k - 1} s"
        on = "true" if k == 0 else f"s.gram = right(c.gram, {k})"
        p = "CASE WHEN coalesce(x.n_{0}, 0) > 0 THEN (c.{0} + x.k_{0} * s.{1}) / (x.n_{0} + x.k_{0})::DOUBLE ELSE s.{1} END AS {1}"
        out.append(f"level{k} AS (SELECT c.gram, {p.format('yes', 'p')}, {p.format('no', 'q')} FROM {rows} c {'LEFT ' if k == 0 else ''}JOIN kinds x ON x.context = c.context JOIN {shorter} ON {on})")
    return ", ".join(out)


#: The same models by SQL: lists of grams unnested, orders one after another.
_SQL = f"""
WITH parsed AS (
  SELECT row_number() OVER () AS r, page_id, coalesce(url, '') AS url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), rules AS (
  SELECT * FROM (VALUES {", ".join(f"({r.allow}, '{r.host}', '{r.path}')" for r in RULES)}) t(allow, rule_host, rule_path)
), known AS (
  SELECT p.*, rule_host || rule_path AS rule, allow, left(md5(url), 1) IN ('0', '1', '2') AS held
  FROM parsed p LEFT JOIN rules t ON ('.' || host) LIKE ('%.' || rule_host) AND starts_with(path, rule_path) QUALIFY row_number() OVER (PARTITION BY r ORDER BY length(rule_host || rule_path) DESC NULLS LAST) = 1
), padded AS (
  SELECT r, repeat(chr(2), {ORDER}) || regexp_replace(url, '[^\\x21-\\x7E]', chr(1), 'g') || chr(3) AS s FROM known
), grams AS (
  SELECT r, unnest(list_transform(range(1, length(s) - {ORDER} + 1), lambda i: substr(s, i, {ORDER + 1}))) AS gram FROM padded
), seen AS (
  SELECT g.gram, count(*) FILTER (k.allow) AS yes, count(*) FILTER (NOT k.allow) AS no FROM grams g JOIN known k USING (r) WHERE k.rule IS NOT NULL AND NOT k.held GROUP BY g.gram
), counted AS (
  SELECT right(s.gram, k) AS gram, right(s.gram, k)[:-2] AS context, sum(yes) AS yes, sum(no) AS no FROM seen s, range(1, {ORDER + 2}) t(k) GROUP BY ALL
), kinds AS (
  SELECT context, sum(yes) AS n_yes, sum(no) AS n_no, count(*) FILTER (yes > 0) AS k_yes, count(*) FILTER (no > 0) AS k_no FROM counted GROUP BY context
  HAVING context = '' OR sum(yes) + sum(no) >= {SHARE!r}::DOUBLE * (SELECT sum(yes) + sum(no) FROM counted WHERE context = '')
), alphabet AS (
  SELECT chr(c::INTEGER) AS gram FROM range(33, 127) t(c) UNION ALL VALUES (chr(1)), (chr(3))
), {_levels()}, entries AS (
  {" UNION ALL ".join(f"SELECT gram, ln(p) - ln(q) AS gain FROM level{k}" for k in range(ORDER + 1))}
), contexts AS (
  SELECT context, CASE WHEN n_yes > 0 THEN ln(k_yes / (n_yes + k_yes)::DOUBLE) ELSE 0 END - CASE WHEN n_no > 0 THEN ln(k_no / (n_no + k_no)::DOUBLE) ELSE 0 END AS gain FROM kinds WHERE context <> ''
), scored AS (
  {_lookups()}
), bins AS (
  SELECT floor(greatest(least(score, {FAR}), -{FAR}) * {BINS})::INTEGER AS bin, count(*) FILTER (allow) AS yes, count(*) FILTER (NOT allow) AS no FROM scored JOIN known USING (r) WHERE rule IS NOT NULL AND held GROUP BY 1
), sides AS (
  SELECT b.bin, (SELECT max(c.bin) FROM bins c WHERE c.bin < b.bin) AS before, coalesce((SELECT sum(yes) FROM bins c WHERE c.bin < b.bin), 0) AS lost, (SELECT sum(no) FROM bins c WHERE c.bin >= b.bin) AS passed, sum(yes) OVER () AS n, sum(no) OVER () AS m FROM bins b
), tried AS (
  SELECT (coalesce(before + 1, bin) + bin) / {2.0 * BINS!r}::DOUBLE AS edge, CASE WHEN n > 0 THEN lost / n::DOUBLE ELSE 0 END + CASE WHEN m > 0 THEN passed / m::DOUBLE ELSE 0 END AS wrong FROM sides
  UNION ALL SELECT (max(bin) + 1) / {float(BINS)!r}::DOUBLE, CASE WHEN max(n) > 0 THEN 1 ELSE 0 END FROM sides HAVING count(*) > 0
), chosen AS (
  SELECT coalesce((SELECT edge FROM tried ORDER BY round(wrong, 9), abs(edge), edge LIMIT 1), 0) AS least
)
SELECT page_id, host, path, rule, CASE WHEN coalesce(allow, score >= least) THEN 'allow' ELSE 'block' END AS verdict FROM known JOIN scored USING (r), chosen"""
ORACLE = {"op11_url_filter": _SQL}
