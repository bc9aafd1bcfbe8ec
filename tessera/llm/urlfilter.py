"""URL filter: host and path rules, and a tree of path templates judged by smoothed labelled purity.

All of it is DataFrame expressions, aggregations and joins. Pages decided by a rule are the labels. Each
path becomes a shape (digits and ids turned into classes), and shapes are counted by host, which leaves a table
of templates and not of pages. From the root down, branches that are too rare and too varied to be names are generalised to
`*`, and branches of a parent whose pages spread over the next segment much as those of all siblings with the same commonest
next segment, and whose labels do not contradict theirs, are merged into `+` and that segment. A template is rejected
when its purity, the smoothed share of its pages known to be blocked, reaches a cut chosen on labels held out of the purity in turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, written

#: (rule, verdict): host and path of each rule as one string; the path begins at the first slash.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Folds of labels that are held out in turn to choose the cut, of which these are the limits in hundredths; without a blocked label it is UNSURE.
FOLDS, LOWEST, HIGHEST, UNSURE = 4, 55, 99, 75


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased. Path: then up to ? # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits the host or a parent domain of it and begins the path; else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        at = rule.index("/") if "/" in rule else len(rule)
        fits = ((host == rule[:at]) | F.endswith(host, F.lit("." + rule[:at]))) & F.startswith(path, F.lit(rule[at:]))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def shape(path: Column) -> Column:
    """Array of all path segments, with numbers, dates and ids turned into classes; empty segments count as none."""
    raw = F.filter(F.split(path, "/"), lambda s: s != "")

    def of(s: Column) -> Column:
        stem, end = F.regexp_extract(s, r"\A(.*?)(\.[A-Za-z]{2,5})?\z", 1), F.regexp_extract(s, r"\A(.*?)(\.[A-Za-z]{2,5})?\z", 2)
        kind = (
            F.when(stem.rlike(r"\A[0-9]+\z"), "<n>")
            .when(stem.rlike(r"\A[0-9]{4}-[0-9]{2}(-[0-9]{2})?\z"), "<date>")
            .when(stem.rlike(r"\A[0-9a-fA-F-]{16,}\z"), "<id>")
            .otherwise(stem)
        )
        return F.concat(kind, end)

    return F.transform(raw, of)


def _joined(template: Column, segments: Column) -> Column:
    return F.when(F.size(segments) == 0, template).otherwise(F.concat(template, F.lit("/"), F.array_join(segments, "/")))


def templates(
    counts: DataFrame, heavy: float = 0.05, alike: float = 0.05, doubt: float = 20.0, apart: float = 0.25, z: float = 3.0
) -> DataFrame:
    """counts(host, shape, n, blocked, allowed, and others) -> the same rows with `template`, the path in the generalised tree.

    A round first takes the segments that all shapes below a node share, then judges the branches. A branch with under
    `heavy` of its node's pages is light. The light branches of a node become `*` when two of their pages fall into the same
    branch with a probability of at most `alike`; `doubt` pairs that do so half the time are added, so that a few
    pages prove nothing. Both are shares and do not depend on the size of the table. A node with one shape is finished at once. Rounds
    go on until no branch is left: as many as the most branchings on one path, whatever its depth, and the later ones over what is still open.
    """
    node, branch, kin = ["host", "template"], ["host", "template", "seg"], ["host", "template", "mode"]
    t = counts.withColumn("template", F.lit("")).withColumn("rest", F.col("shape"))
    done = before = None
    while True:
        ends = t.groupBy(*node).agg(F.min("rest").alias("low"), F.max("rest").alias("high"), F.sum("n").alias("tn"))
        same = F.zip_with("low", "high", lambda a, b: a.eqNullSafe(b))
        differ = F.array_position(same, False)
        shared = F.when(differ == 0, F.size("low")).otherwise(differ - 1).cast("int")
        ends = ends.select(*node, "tn", F.slice("low", 1, shared).alias("stem"), shared.alias("shared"))
        t = t.join(ends, node).withColumn("template", _joined(F.col("template"), F.col("stem"))).withColumn(
            "rest", F.expr("slice(rest, shared + 1, greatest(size(rest) - shared, 0))")
        ).drop("stem", "shared")
        t = written(t.withColumn("seg", F.get("rest", F.lit(0))).withColumn("next", F.coalesce(F.get("rest", F.lit(1)), F.lit(""))), "stems", after=before)
        whole = t.where("seg is null").select(*counts.columns, "template")
        done = whole if done is None else done.unionByName(whole)
        inner = t.where("seg is not null")
        if not inner.limit(1).count():
            return done
        steps = inner.groupBy(*branch, "next").agg(F.sum("n").alias("sn"), F.sum("blocked").alias("sb"), F.sum("allowed").alias("sa"), F.max("tn").alias("tn"))
        branches = steps.groupBy(*branch).agg(
            F.sum("sn").alias("bn"), F.sum("sb").alias("bb"), F.sum("sa").alias("ba"), F.max(F.struct("sn", "next"))["next"].alias("mode"),
            (F.sum("sn") < heavy * F.max("tn")).alias("light"),
        )
        n, light = F.col("bn").cast("double"), F.col("light")
        pairs = lambda x: x * (x - 1) / 2
        varied = branches.groupBy(*node).agg(F.sum(F.when(light, n)).alias("ln"), F.sum(F.when(light, pairs(n))).alias("meet"))
        varied = varied.select(*node, ((F.col("meet") + doubt / 2) / (pairs(F.col("ln")) + doubt) <= alike).alias("varied"))
        # Siblings of one commonest next segment are pooled; far is the total variation distance of a branch from its pool.
        pools = branches.groupBy(*kin).agg(
            F.count(F.lit(1)).alias("like"), F.sum("bn").alias("pn"), F.sum("bb").alias("pb"), F.sum("ba").alias("pa")
        )
        known = steps.drop("tn").join(branches, branch)
        pooled = known.groupBy(*kin, "next").agg(F.sum("sn").alias("qn"))
        both = known.join(pooled, [*kin, "next"]).join(pools, kin)
        share, pool = F.col("sn") / F.col("bn"), F.col("qn") / F.col("pn")
        judged = both.groupBy(*branch, "mode", "light", "bb", "ba", "like", "pb", "pa").agg((0.5 * (F.sum(F.abs(share - pool)) + 1 - F.sum(pool))).alias("far"))
        labels, all_labels = F.col("bb") + F.col("ba"), F.col("pb") + F.col("pa")
        p = F.try_divide(F.col("pb"), all_labels)
        gap = F.abs(F.try_divide(F.col("bb"), labels) - p)
        agrees = (labels == 0) | (gap <= z * F.sqrt(p * (1 - p) / labels) + 0.5 / labels)
        judged = judged.join(varied, node).select(
            *branch,
            F.when(light & F.coalesce("varied", F.lit(False)), "*")
            .when((F.col("like") > 1) & (F.col("far") <= apart) & agrees, F.concat(F.lit("+"), F.col("mode")))
            .otherwise(F.col("seg")).alias("node"),
        )
        t = inner.join(judged, branch).select(
            *counts.columns, F.concat_ws("/", "template", "node").alias("template"), F.expr("slice(rest, 2, greatest(size(rest) - 1, 0))").alias("rest")
        )
        t = before = written(t, "templates")


def purity(blocked: Column, allowed: Column, n: Column, prior: float, weight: float, unknown: float) -> Column:
    """Blocked pages over labelled ones, with `weight` pages and `unknown` of each page without a label counted as the prior, so that
    a few labels do not speak for many pages."""
    doubt = weight + unknown * (n - blocked - allowed)
    return (blocked + doubt * prior) / (blocked + allowed + doubt)


def choose_cut(judged: DataFrame, beta: float = 0.5) -> dict:
    """judged(purity, blocked, allowed), labels held out of the purity -> the cut with the best F, and its precision and recall.

    F weighs precision over recall. Cuts are whole hundredths from LOWEST to HIGHEST; of equal ones the highest holds, and UNSURE
    where no held-out page would be blocked by any. At most HIGHEST - LOWEST + 2 rows reach the driver.
    """
    step = F.least(F.floor(F.col("purity") * 100 + 1e-9), F.lit(HIGHEST)).cast("int")
    sums = judged.groupBy(F.when(step >= LOWEST, step).otherwise(LOWEST - 1).alias("step")).agg(F.sum("blocked").alias("b"), F.sum("allowed").alias("a")).collect()
    blocked, best = sum(r.b for r in sums), {"cut": UNSURE / 100, "f": 0.0, "precision": None, "recall": None}
    for c in range(HIGHEST, LOWEST - 1, -1):
        hits, wrong = (sum(r[k] for r in sums if r.step >= c) for k in "ba")
        if hits:
            precision, recall = hits / (hits + wrong), hits / blocked
            f = (1 + beta**2) * precision * recall / (beta**2 * precision + recall)
            if f > best["f"]:
                best = {"cut": c / 100, "f": f, "precision": precision, "recall": recall}
    return best


def template_tree(pages: DataFrame, rules, id_col: str, url_col: str, cut: float | None, prior: float, weight: float, unknown: float, **options):
    """(rows, found, choice): the pages with host, path, r and shape; (host, shape, n, template, purity); and the cut with its figures."""
    url = F.col(url_col).cast("string")
    host, path = host_and_path(url)
    rows = pages.select(F.col(id_col).alias("page_id"), url.alias("url")).select("page_id", "url", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("r", ruled(F.col("host"), F.col("path"), rules)).withColumn("shape", shape(F.col("path")))
    fold = F.pmod(F.xxhash64("url", F.lit(29)), F.lit(FOLDS))
    of = lambda v, when=F.lit(True): F.sum(F.when((F.col("r.verdict") == v) & when, 1).otherwise(0))
    folds = [(f"b{k}", f"a{k}") for k in range(FOLDS)]
    held = [of(v, fold == k).alias(name) for k, pair in enumerate(folds) for v, name in zip(("block", "allow"), pair)]
    counts = rows.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), of("block").alias("blocked"), of("allow").alias("allowed"), *held)
    tree = written(templates(written(counts, "shapes"), **options), "tree")
    sums = ("n", "blocked", "allowed", *(x for pair in folds for x in pair))
    judged = written(tree.groupBy("host", "template").agg(*[F.sum(x).alias(x) for x in sums]), "sums")
    choice = {"cut": cut}
    if cut is None:
        # Pages of the fold that is held out count as pages without a label.
        each = F.explode(F.array(*[F.struct(F.col(b).alias("b"), F.col(a).alias("a")) for b, a in folds])).alias("held")
        out = judged.select("n", "blocked", "allowed", each).where("held.b + held.a > 0")
        apart = purity(F.col("blocked") - F.col("held.b"), F.col("allowed") - F.col("held.a"), F.col("n"), prior, weight, unknown)
        choice = choose_cut(out.select(apart.alias("purity"), F.col("held.b").alias("blocked"), F.col("held.a").alias("allowed")))
    judged = judged.select("host", "template", purity(F.col("blocked"), F.col("allowed"), F.col("n"), prior, weight, unknown).alias("purity"))
    found = tree.select("host", "shape", "n", "template").join(judged, ["host", "template"]).select("host", "shape", "n", "template", "purity")
    return rows, written(found, "purity"), choice


def judge_pages(
    pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", cut: float | None = None, prior: float = 0.5, weight: float = 4.0,
    unknown: float = 0.25, **options,
) -> DataFrame:
    """Every page -> page_id, host, path, rule, verdict, template, purity, cut.

    verdict is the rule's where one fits, else `block` where the template's purity reaches the cut and `allow`
    where it doesn't; cut None chooses it by choose_cut(). A template without labelled pages has the prior as its
    purity. Null urls and those without :// have an empty host and path, no rule, and the root template. Paths are judged whole,
    however long and deep. Rules of equal length that fit the same page do not occur, as both begin the same host and path. Of segments that are equally common
    the last in order is the commonest. Ids may be null or repeated: each row is judged by itself. Other columns are ignored. No pages give no rows.
    """
    rows, found, choice = template_tree(pages, rules, id_col, url_col, cut, prior, weight, unknown, **options)
    judged = join_hot(rows, found, ["host", "shape"], "n")
    method = F.when(F.col("purity") >= choice["cut"], "block").otherwise("allow")
    return judged.select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce(F.col("r.verdict"), method).alias("verdict"), "template", "purity",
        F.lit(choice["cut"]).alias("cut"),
    )
