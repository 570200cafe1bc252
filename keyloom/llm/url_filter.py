"""URL filters: host and path rules, and for all other URLs a path-template tree per host.

Paths come down to templates from branching to branching: segments of a variable form (numbers, hex strings, dates) and
segments of nodes with too many different children become wildcards; sibling branches that lead to the same forms of next
segments and whose labelled pages agree are merged; what all paths below a node share is taken at one go, so that the rounds
go with the branchings along a path and not with its depth, of which there is no limit. A template is rejected when its labelled pages, smoothed towards the share
over all hosts, are nearly all blocked. Labels are the verdicts of the rules. The tree is a table of (host, path form)
counts, reduced before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import Scratch

#: Forms of variable segments, first that fits; the file ending stays part of the form.
FORMS = [
    (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "{date}"),
    (r"^[0-9]+$", "{n}"),
    (r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$", "{uuid}"),
    (r"^(?=.*[0-9])[0-9a-fA-F]{8,}$", "{hex}"),
    (r"^[0-9]+\.[A-Za-z0-9]+$", "{n}.x"),
    (r"^(?=.*[0-9])[A-Za-z]+[-_]?[0-9]+$", "{word-n}"),
]
WILD, WORD, END = "*", "{word}", "{end}"
KINDS = [*(form for _, form in FORMS), WORD, END]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From there up to `?`, `#` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule (host/path-prefix) that fits; rules are few, a chain of conditions without a join."""
    chain = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        on, _, under = rule.partition("/")
        chain = F.when(((host == on) | host.endswith("." + on)) & path.startswith("/" + under), rule).otherwise(chain)
    return chain


def form_of(segment: Column) -> Column:
    out = F.lit(WORD)
    for pattern, form in reversed(FORMS):
        out = F.when(segment.rlike(pattern), form).otherwise(out)
    return F.when(segment.isNull(), END).otherwise(out)


def path_form() -> Column:
    """The segments of `path`, those of a variable form by that form."""
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    return F.transform(segments, lambda s: F.when(form_of(s) == WORD, s).otherwise(form_of(s)))


def _similar(a: Column, b: Column, least: float, apart: float) -> Column:
    """Branches with like next forms (cosine) and, having labels on both sides or on none, like shares of blocked pages."""
    dot = lambda v, w: F.aggregate(F.zip_with(v, w, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    share = F.try_divide(a["blocked"] + b["blocked"], a["told"] + b["told"])
    spread = F.sqrt(share * (1 - share) * (F.try_divide(F.lit(1.0), a["told"]) + F.try_divide(F.lit(1.0), b["told"]))) + 1e-9
    rates = F.abs(F.try_divide(a["blocked"], a["told"]) - F.try_divide(b["blocked"], b["told"]))
    alike = F.when((a["told"] > 0) & (b["told"] > 0), rates <= apart * spread).otherwise(a["told"] == b["told"])
    return (dot(a["next"], b["next"]) >= least * F.sqrt(dot(a["next"], a["next"])) * F.sqrt(dot(b["next"], b["next"])) - 1e-9) & alike


def _on_to_branching(nodes: DataFrame) -> DataFrame:
    """Templates longer by the segments that all forms of their node share from there on; by all of a lone form."""
    at = F.size("template")
    rest = F.slice("form", at + 1, F.greatest(F.size("form") - at, F.lit(0)))
    span = nodes.groupBy("host", "template").agg(F.min(rest).alias("low"), F.max(rest).alias("high"))
    parts = F.array_position(F.zip_with("low", "high", lambda x, y: x.eqNullSafe(y)), F.lit(False)).cast("int")
    shared = F.when(parts == 0, F.col("low")).otherwise(F.slice("low", 1, F.greatest(parts - 1, F.lit(0))))
    moved = nodes.join(span.select("host", "template", shared.alias("shared")), ["host", "template"])
    return moved.withColumn("template", F.concat("template", "shared")).select(nodes.columns)


def template_tree(
    urls: DataFrame, scratch: Scratch, most_children: int = 20, least: float = 0.9, apart: float = 2.0, pseudo: float = 4.0, purity: float = 0.9
) -> DataFrame:
    """host, form, template, told, blocked, reject of every (host, path form) of urls (host, path, blocks: null if untold).

    reject: (blocked + pseudo * share over all) / (told + pseudo) >= purity.
    """
    nodes = scratch.write(
        urls.withColumn("form", path_form())
        .groupBy("host", "form")
        .agg(F.count("*").alias("n"), F.count("blocks").alias("told"), F.coalesce(F.sum(F.col("blocks").cast("long")), F.lit(0)).alias("blocked"))
        .withColumn("template", F.array().cast("array<string>"))
    )
    while True:
        nodes = scratch.write(_on_to_branching(nodes))
        level = F.size("template")
        open_ = nodes.where(F.size("form") > level)
        if open_.isEmpty():
            break
        here, beyond = F.get("form", level), F.get("form", level + 1)
        kind = F.when(beyond.isNull(), END).when(F.lit(beyond).isin(KINDS), beyond).otherwise(WORD)
        following = F.array(*(F.sum(F.when(kind == k, F.col("n")).otherwise(0)).cast("double") for k in KINDS))
        branches = open_.groupBy("host", "template", here.alias("segment")).agg(following.alias("next"), F.sum("told").alias("told"), F.sum("blocked").alias("blocked"))
        wide = branches.groupBy("host", "template").agg(F.count("*").alias("children"))
        few = branches.join(wide.where(F.col("children") <= most_children), ["host", "template"])
        # most_children at most
        siblings = few.groupBy("host", "template").agg(F.array_sort(F.collect_list(F.struct("segment", "next", "told", "blocked"))).alias("all"))
        merged = siblings.select("host", "template", F.explode("all").alias("own"), "all").select(
            "host", "template", F.col("own.segment").alias("segment"), F.filter("all", lambda b: _similar(b, F.col("own"), least, apart))[0]["segment"].alias("to")
        )
        step = open_.withColumn("segment", here).join(merged, ["host", "template", "segment"], "left")
        step = step.withColumn("template", F.concat("template", F.array(F.coalesce("to", F.lit(WILD))))).select(nodes.columns)
        nodes = scratch.write(nodes.where(F.size("form") <= level).unionByName(step))
    total = nodes.agg(F.sum("blocked").alias("b"), F.sum("told").alias("t")).collect()[0]  # one row
    share = (total.b or 0) / (total.t or 1)
    counts = nodes.groupBy("host", "template").agg(F.sum("told").alias("told"), F.sum("blocked").alias("blocked"))
    judged = counts.withColumn("reject", (F.col("blocked") + pseudo * share) / (F.col("told") + pseudo) >= purity)
    return nodes.select("host", "form", "template").join(judged, ["host", "template"]).withColumn("template", F.concat(F.lit("/"), F.array_join("template", "/")))


def url_filter(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", **how) -> DataFrame:
    """page_id, host, path, rule, verdict, template: a row for each row of pages; rules: ("host/path", "allow" or "block").

    A rule fits its host and its subdomains where the path starts with the rule's; the longest wins and its verdict holds.
    Else the verdict is the template's: block if rejected. A null url, or one without `://`, has an empty host and path,
    no rule, and its verdict is that of the empty host's root. Of similar branches the first by name gives the merged one's
    name. Repeated rows count as often as they are there. An empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    block = [r for r, verdict in rules if verdict == "block"]
    url = F.col(f"`{url_col}`").cast("string")
    split = pages.select(F.col(f"`{id_col}`").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    ruled = split.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    told = scratch.write(ruled.withColumn("blocks", F.col("rule").isin(block) if block else F.when(F.col("rule").isNotNull(), False)))
    tree = template_tree(told, scratch, **how)
    found = told.withColumn("form", path_form()).join(tree.select("host", "form", "template", "reject"), ["host", "form"], "left")
    verdict = F.when(F.coalesce("blocks", "reject", F.lit(False)), "block").otherwise("allow")
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template")
