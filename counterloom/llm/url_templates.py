"""URL filters by a tree of path templates per host, and by explicit rules.

A path becomes segments; a segment with digits becomes its shape (``/fr/825.html``
has the segments ``fr`` and ``#.html``). The tree of a host is built from the top:

1. A node's children that are many (over ``MAX_CHILDREN``) are variable: those
   with less than ``RARE`` of the node's pages become one wildcard ``*``.
2. Branches that are left are merged when they are statistically alike: labelled
   on both sides, bad shares that a two-proportion test does not tell apart, and
   similar mixes of segment classes below. They become one branch ``(a|b)``.

A template's purity is the bad share of its labelled pages, smoothed by two
pseudo-pages, one of each kind; templates purer than ``PURITY`` are rejected. A
template without labels of its own borrows from templates of any host that begin
like it: of its beginnings, the longest that has labels counts, smoothed alike.
Where not even its first segment is known, its purity is a half and it is accepted.
In ``judge_urls`` the labelled pages are those that a rule fits.

Pages are counted by host and shape before the tree is built, so a frequent host
costs no more than its distinct shapes, and all steps are joins and aggregates by
(host, node); only the at most ``MAX_CHILDREN + 1 / RARE`` branches of one node meet
in one row. Segments beyond ``DEPTH`` are one segment.

Defined cases: a null url, or one without ``://``, has empty host and path and is
judged like any other. Repeated rows are judged alike. Only the named columns are read.
"""

from math import sqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from counterloom.llm.ship import ship
from counterloom.shared import settle

DEPTH = 6
MAX_CHILDREN = 16
RARE = 0.05
PURITY = 0.7
Z = 1.96
MIX = 0.25

BLOCK, ALLOW = "block", "allow"
RULES = (
    (BLOCK, "net/"),
    (ALLOW, "example.net/en/"),
    (BLOCK, "example.com/de/"),
    (ALLOW, "org/fr/"),
)

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CLASSES = ("none", "number", "mixed", "word", "wild")


def host_of(url: Column) -> Column:
    host = F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit(""))
    return F.translate(host, _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest rule that fits (``host/path``), as ``verdict, rule``; else null."""
    kind = "struct<verdict:string,rule:string>"
    found = []
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, slash, rest = rule.partition("/")
        inside = (host == name) | host.endswith("." + name)
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        found.append(F.when(inside & path.startswith(slash + rest), value))
    return F.coalesce(*found, F.lit(None).cast(kind)).cast(kind)


def shape_of(path: Column, depth: int = DEPTH) -> Column:
    """Segments of a path, digits as ``#``; what is beyond ``depth`` is one segment."""
    plain = F.regexp_replace(path, r"\d+", "#")
    segments = F.slice(F.split(plain, "/"), 2, 1 << 30)
    tail = F.array_join(F.slice(segments, depth, 1 << 30), "/")
    return F.when(F.size(segments) > depth, F.concat(F.slice(segments, 1, depth - 1), F.array(tail))).otherwise(
        segments
    )


def full_of(shape: Column) -> Column:
    """A slash before every segment, so that no two shapes of a path are one key."""
    return F.array_join(F.transform(shape, lambda segment: F.concat(F.lit("/"), segment)), "")


def _class_of(segment: Column) -> Column:
    return (
        F.when(segment.isNull(), "none")
        .when(segment == "*", "wild")
        .when(segment == "#", "number")
        .when(segment.contains("#"), "mixed")
        .otherwise("word")
    )


def alike(a: dict, b: dict) -> bool:
    """Whether two branches (labelled, bad, pages by class below) may be one."""
    if not a["labelled"] or not b["labelled"]:
        return False
    share = (a["bad"] + b["bad"] + 1) / (a["labelled"] + b["labelled"] + 2)
    spread = sqrt(share * (1 - share) * (1 / a["labelled"] + 1 / b["labelled"]))
    gap = abs(a["bad"] / a["labelled"] - b["bad"] / b["labelled"])
    mixes = [[x["below"][c] / max(1, sum(x["below"])) for c in range(len(_CLASSES))] for x in (a, b)]
    return gap <= Z * spread and sum(abs(p - q) for p, q in zip(*mixes)) / 2 <= MIX


def merged_names(branches: list[dict]) -> dict[str, str]:
    """New names of the branches that were merged; the frequent ones gather the others."""
    pools: list[dict] = []
    for branch in sorted(branches, key=lambda b: (-b["pages"], b["segment"])):
        pool = next((p for p in pools if alike(p, branch)), None)
        if pool is None:
            pools.append(branch | {"names": [branch["segment"]]})
        else:
            pool["names"].append(branch["segment"])
            pool["labelled"] += branch["labelled"]
            pool["bad"] += branch["bad"]
            pool["below"] = [x + y for x, y in zip(pool["below"], branch["below"])]
    joint = [sorted(pool["names"]) for pool in pools if len(pool["names"]) > 1]
    return {name: f"({'|'.join(names)})" for names in joint for name in names}


_NAMES = T.ArrayType(
    T.StructType([T.StructField("segment", T.StringType()), T.StructField("joint", T.StringType())])
)


def _merged(branches: pa.Array) -> pa.Array:
    rows = [
        [{"segment": k, "joint": v} for k, v in merged_names(row).items()]
        for row in branches.to_pylist()
    ]
    kind = pa.list_(pa.struct([("segment", pa.string()), ("joint", pa.string())]))
    return pa.array(rows, kind)


def _named(tree: DataFrame, level: int) -> DataFrame:
    """One level of the tree: wildcards, then merged branches; ``node`` grows by a segment."""
    here = tree.withColumn("segment", F.get("shape", F.lit(level)))
    keys = ["host", "node"]
    children = here.filter(F.col("segment").isNotNull()).groupBy(*keys, "segment").agg(
        F.sum("pages").alias("pages")
    )
    crowded = (
        children.groupBy(*keys)
        .agg(F.count("*").alias("n"), F.sum("pages").alias("total"))
        .filter(F.col("n") > MAX_CHILDREN)
        .select(*keys, "total")
    )
    rare = children.join(crowded, keys).filter(F.col("pages") < RARE * F.col("total"))
    rare = rare.select(*keys, "segment", F.lit(True).alias("rare"))
    here = here.join(rare, [*keys, "segment"], "left").withColumn(
        "segment", F.when(F.col("rare"), "*").otherwise(F.col("segment"))
    )
    below = _class_of(F.get("shape", F.lit(level + 1)))
    counts = [F.sum(F.when(below == c, F.col("pages")).otherwise(0)).alias(c) for c in _CLASSES]
    stats = here.filter(F.col("segment").isNotNull()).groupBy(*keys, "segment")
    stats = stats.agg(*[F.sum(c).alias(c) for c in ("pages", "labelled", "bad")], *counts)
    branch = F.struct("segment", "pages", "labelled", "bad", F.array(*_CLASSES).alias("below"))
    # At most MAX_CHILDREN + 1 / RARE branches of a node are left here.
    joined = stats.groupBy(*keys).agg(F.collect_list(branch).alias("branches"))
    joined = joined.filter(F.size("branches") > 1)
    names = F.inline(F.arrow_udf(_merged, _NAMES)("branches"))
    joint = joined.select(*keys, names)
    here = here.join(joint, [*keys, "segment"], "left")
    step = F.coalesce("joint", "segment")
    node = F.when(step.isNull(), F.col("node")).otherwise(F.concat("node", F.lit("/"), step))
    return here.select(
        "host", "shape", "full", "pages", "labelled", "bad", node.alias("node")
    )


def _beginnings(nodes: DataFrame) -> DataFrame:
    """``nodes`` with each beginning of the template, a segment or longer."""
    parts = F.split("node", "/")
    lengths = F.sequence(F.lit(1), F.size(parts) - 1)
    spread = nodes.filter(F.col("node") != "").withColumn("segments", F.explode(lengths))
    beginning = F.array_join(F.slice(parts, 1, F.col("segments") + 1), "/")
    return spread.withColumn("beginning", beginning)


def _purities(tree: DataFrame) -> DataFrame:
    """``host, node, purity`` of every template."""
    nodes = tree.groupBy("host", "node").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    nodes = settle(nodes, "templates")
    share = (F.col("bad") + 1) / (F.col("labelled") + 2)
    known = (
        _beginnings(nodes.filter("labelled > 0"))
        .groupBy("beginning")
        .agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
        .select("beginning", share.alias("share"))
    )
    borrowed = (
        _beginnings(nodes.filter("labelled = 0").select("host", "node"))
        .join(known, "beginning")
        .groupBy("host", "node")
        .agg(F.max_by("share", "segments").alias("borrowed"))
    )
    purity = F.when(F.col("labelled") > 0, share).otherwise(F.coalesce("borrowed", F.lit(0.5)))
    return nodes.join(borrowed, ["host", "node"], "left").select("host", "node", purity.alias("purity"))


def path_templates(labelled: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``host, full, template, purity``: the template of every shape of every host.

    ``labelled``: ``host, path, bad`` (1, 0 or null without a label), a row per page;
    ``full`` is the shape with a ``/`` before every segment.
    """
    ship(labelled.sparkSession)
    shaped = labelled.select("host", shape_of(F.col("path"), depth).alias("shape"), "bad")
    tree = shaped.groupBy("host", full_of(F.col("shape")).alias("full"), "shape").agg(
        F.count("*").alias("pages"),
        F.count("bad").alias("labelled"),
        F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"),
    )
    tree = settle(tree.withColumn("node", F.lit("")), "shapes")
    deepest = tree.agg(F.coalesce(F.max(F.size("shape")), F.lit(0)).alias("n")).first().n
    for level in range(deepest):
        tree = settle(_named(tree, level), "tree")
    purest = settle(_purities(tree), "purities")
    return tree.join(purest, ["host", "node"]).select(
        "host", "full", F.col("node").alias("template"), "purity"
    )


def judge_urls(
    pages: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    rules: tuple[tuple[str, str], ...] = RULES,
    purity: float = PURITY,
    depth: int = DEPTH,
) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, purity`` of every page."""
    named = pages.select(
        F.col(page_id).alias("page_id"),
        host_of(F.col(url)).alias("host"),
        path_of(F.col(url)).alias("path"),
    )
    ruled = named.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    bad = F.when(F.col("fit").isNotNull(), (F.col("fit.verdict") == BLOCK).cast("int"))
    templates = path_templates(ruled.select("host", "path", bad.alias("bad")), depth)
    full = full_of(shape_of(F.col("path"), depth))
    learnt = F.when(F.col("purity") > purity, BLOCK).otherwise(ALLOW)
    return (
        ruled.withColumn("full", full)
        .join(templates, ["host", "full"])
        .select(
            "page_id",
            "host",
            "path",
            F.col("fit.rule").alias("rule"),
            F.coalesce("fit.verdict", learnt).alias("verdict"),
            "template",
            "purity",
        )
    )
