"""URL filtering by host rules and a path-template tree learned from labelled urls.

Each host's paths form a tree of segments, which grows a level at a time.  Segments that look variable (numbers, hex,
long mixtures) become a wildcard at once; where a node has many rare literal children, those do too.  Labelled literal
siblings whose shares of bad urls do not differ statistically from all of theirs merge into one branch; of those that
do, the ones above, and the ones below, merge where they agree among themselves.  Siblings without a label have nothing
that tells them apart, and merge with each other but never with labelled ones.  A template is rejected if the smoothed
share of bad among its labelled urls is high; one without a labelled url is allowed.

Every step is a grouping of distinct generalised paths with their counts, so no host meets in one task.  A path that
stands alone under its node is finished at once, so the number of steps is the depth to which paths are shared.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.store import dropped, stored

MANY_CHILDREN, RARE = 20, 3.0
#: Standard errors from which branches differ; low, as a wrong merge costs more than two branches for one.
Z = 1.0
SMOOTHING, REJECT_FROM = 4.0, 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; empty without ``://``."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.regexp_replace(_rest(url), r"^[^/?#]*", ""), r"^[^?#]*", 0)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def matching_rule(rules: list[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls; a rule is ``host/path`` with a verdict."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> Column:
    """The path's segments, variable-looking ones as wildcards."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.transform(
        parts,
        lambda x: F.when(x.rlike(r"^\d+(\.\w{1,5})?$"), "{n}")
        .when(x.rlike(r"^[0-9a-fA-F-]{8,}$"), "{h}")
        .when((F.length(x) > 40) | x.rlike(r"\d.*\d.*\d.*\d"), "{x}")
        .otherwise(x),
    )


def _level(paths: DataFrame, d: int) -> DataFrame:
    """Extends each path's template by its d-th segment (from 0), generalised among its siblings."""
    here = paths.withColumn("seg", F.get("segs", F.lit(d)))
    sums = [F.sum(c).alias(c) for c in ("n", "bad", "good")]
    kids = here.where("seg is not null").groupBy("host", "template", "seg").agg(*sums).withColumn("known", F.col("bad") + F.col("good"))
    literal = ~F.col("seg").startswith("{")
    rate = lambda bad, known: (bad + 0.5) / (known + 1)
    nodes = kids.where(literal).groupBy("host", "template").agg(F.count("*").alias("k"), F.sum("n").alias("kn"), rate(F.sum("bad"), F.sum("known")).alias("all"), F.sum("known").alias("all_known"))

    def differs(share: Column, pool: Column, n: Column, pool_n: Column) -> Column:
        return (share - pool) / F.sqrt(pool * (1 - pool) * (1 / n + 1 / pool_n))

    kids = kids.join(nodes, ["host", "template"], "left").withColumn("share", rate(F.col("bad"), F.col("known")))
    z = differs(F.col("share"), F.col("all"), F.col("known"), F.col("all_known"))
    side = F.when(F.col("known") == 0, "none").when(z > Z, "above").when(z < -Z, "below").otherwise("alike")
    kids = kids.withColumn("side", side)
    sides = kids.where(literal).groupBy("host", "template", "side").agg(F.count("*").alias("sk"), F.sum("known").alias("sn"), rate(F.sum("bad"), F.sum("known")).alias("pool"))
    kids = kids.join(sides, ["host", "template", "side"], "left")
    own = F.abs(differs(F.col("share"), F.col("pool"), F.col("known"), F.col("sn"))) <= Z
    alike = (F.col("sk") >= 2) & ((F.col("side") == "none") | own)
    many = (F.col("k") >= MANY_CHILDREN) & (F.col("kn") < RARE * F.col("k"))
    token = F.when(~literal, F.col("seg")).when(many, "{any}").when(alike, F.concat(F.lit("{"), "side", F.lit("}"))).otherwise(F.col("seg"))
    kids = kids.select("host", "template", "seg", token.alias("token"))
    grown = here.join(kids, ["host", "template", "seg"], "left")
    template = F.when(F.col("token").isNull(), F.col("template")).otherwise(F.concat_ws("/", "template", "token"))
    return grown.select("host", "segs", "n", "bad", "good", template.alias("template"))


def _grown(paths: DataFrame) -> DataFrame:
    """All paths with their templates, level by level; ``paths`` has host, segs, n, bad and good."""
    paths, done, d = stored(paths.withColumn("template", F.lit("")), "paths"), [], 0
    while True:
        last = paths
        alone = paths.groupBy("host", "template").agg(F.count("*").alias("mates"))
        paths = paths.join(alone, ["host", "template"]).withColumn("left", F.greatest(F.size("segs") - d, F.lit(0)))
        rest = F.array_join(F.slice("segs", F.lit(d + 1), F.col("left")), "/")
        whole = F.when(F.col("left") > 0, F.concat_ws("/", "template", rest)).otherwise(F.col("template"))
        ends = (F.col("mates") == 1) | (F.col("left") == 0)
        paths = stored(paths.select("host", "segs", "n", "bad", "good", F.when(ends, whole).otherwise(F.col("template")).alias("template"), ends.alias("ends")), "paths")
        dropped(last)
        done.append(paths.where("ends").drop("ends"))
        paths = paths.where("not ends").drop("ends")
        if paths.isEmpty():
            return reduce(DataFrame.unionAll, done)
        paths, d = stored(_level(paths, d), "paths"), d + 1


def judge(pages: DataFrame, rules: list[tuple[str, str]], labels: Column | None = None, url: str = "url") -> DataFrame:
    """Adds host, path, rule, template, purity (smoothed share of bad) and verdict (``allow`` or ``block``).

    A rule's verdict stands; else the template's.  ``labels`` (true: bad, false: good, null: unlabelled) defaults to
    the rules' verdicts, so what rules say of some urls of a template decides the rest.  A template without a labelled
    url has no purity and is allowed.  A null url, or one without ``://``, has empty host and path.  Rows are judged
    one by one, so repeats agree; an empty table gives an empty one.  Input columns with the names of added ones are
    replaced.
    """
    added = ["host", "path", "rule", "template", "purity", "verdict"]
    keep = [c for c in pages.columns if c not in added]
    text = F.coalesce(F.col(f"`{url}`"), F.lit(""))
    rows = pages.select(*[F.col(f"`{c}`") for c in keep], host_of(text).alias("host"), path_of(text).alias("path"), *([labels.alias("__bad__")] if labels is not None else []))
    rule, verdict = matching_rule(rules, F.col("host"), F.col("path"))
    rows = rows.withColumn("rule", rule).withColumn("__said__", verdict).withColumn("__segs__", segments(F.col("path")))
    bad = F.col("__bad__") if labels is not None else F.col("__said__") == "block"
    count = [F.count("*").alias("n"), F.count(F.when(bad, 1)).alias("bad"), F.count(F.when(~bad, 1)).alias("good")]
    paths = stored(_grown(rows.groupBy("host", F.col("__segs__").alias("segs")).agg(*count)), "templates")
    total = paths.agg(F.sum("bad").alias("bad"), F.sum(F.col("bad") + F.col("good")).alias("known")).first()
    prior = (total["bad"] or 0) / max(total["known"] or 0, 1)
    templates = paths.groupBy("host", "template").agg(F.sum("bad").alias("b"), F.sum("good").alias("g"))
    known = F.col("b") + F.col("g")
    purity = F.when(known > 0, (F.col("b") + SMOOTHING * prior) / (known + SMOOTHING))
    judged = paths.select("host", "segs", "template").join(templates.select("host", "template", purity.alias("purity")), ["host", "template"])
    judged = judged.select(F.col("host").alias("__host__"), F.col("segs").alias("__own__"), "template", "purity")
    found = rows.join(judged, (F.col("host") == F.col("__host__")) & (F.col("__segs__") == F.col("__own__")))
    learned = F.when(F.coalesce(F.col("purity") >= REJECT_FROM, F.lit(False)), "block").otherwise("allow")
    return found.select(*[F.col(f"`{c}`") for c in keep], "host", "path", "rule", "template", "purity", F.coalesce("__said__", learned).alias("verdict"))
