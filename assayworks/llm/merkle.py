"""Merkle manifest of a dataset: a tree per group, a tree over their roots, and proofs climbed by recursive SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayworks.llm.common import written
from assayworks.operators.ranges import stretched
from assayworks.session import discard

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Tree number of the tree over the groups' roots; groups count from 0.
TOP = -1


def _hashed(parts: Column) -> Column:
    """The digest (binary) of digests standing one after the other, each read as hexadecimal text."""
    return F.unhex(F.sha2(F.lower(F.hex(parts)), 256))


def _text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def leaf_digest(values: list[Column]) -> Column:
    """The digest (binary) of a row's values: ``-`` for a null, else byte count, colon and value."""
    named = [F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string"))) for v in values]
    return F.unhex(F.sha2(F.concat(*named), 256))


def _numbered(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``df`` with ``place`` (from 0) and ``n``: each row's position in its key's order, and the key's rows.

    ``order`` must tell all rows of a key apart. Range partitioning cuts the order into stretches; rows
    are counted inside each, and one row per key and stretch carries the counts before.
    """
    staged = stretched(df, [(key, True), *[(c, True) for c in order]])
    counts = staged.groupBy(key, "_stretch").agg(F.count("*").alias("here"))
    upto = Window.partitionBy(key).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        key, "_stretch", F.coalesce(F.sum("here").over(upto), F.lit(0)).alias("earlier"), F.sum("here").over(Window.partitionBy(key)).alias("n"))
    near = F.row_number().over(Window.partitionBy(key, "_stretch").orderBy(*order)) - 1
    return staged.withColumn("near", near).join(counts, [key, "_stretch"]).withColumn("place", F.col("earlier") + F.col("near")).drop(
        "near", "earlier", "_stretch")


def _up(n: Column, arity: int) -> Column:
    return F.floor((n + (arity - 1)) / arity).cast("long")


def _climbed(nodes: DataFrame, arity: int) -> tuple[DataFrame, DataFrame]:
    """All levels over ``nodes`` (tree, place, n, digest), each written.

    First the rows (tree, level, place, before, after): for each node with a parent, its siblings on
    either side; the parent is (tree, level + 1, place div arity). Then the roots (tree, level, digest).
    """
    links = roots = None
    level, here = 0, nodes.withColumn("level", F.lit(0))
    while True:
        top = here.where("n = 1").select("tree", "level", "digest")
        roots = top if roots is None else roots.unionByName(top)
        if here.where("n > 1").isEmpty() and links is not None:
            return links, roots
        runs = written(
            here.where("n > 1").groupBy("tree", "n", F.expr(f"place div {arity}").alias("run"))
            .agg(F.array_sort(F.collect_list(F.struct("place", "digest"))).alias("members")), f"merkle-level-{level}")
        digests = F.transform("members", lambda m: m["digest"])
        each = runs.select("tree", "members.place", digests.alias("digests"), F.posexplode("members.place").alias("at", "own"))
        size = F.size("digests")
        siblings = each.select(
            "tree", F.lit(level).alias("level"), F.col("own").alias("place"),
            _joined(F.slice("digests", F.lit(1), F.col("at"))).alias("before"),
            _joined(F.slice("digests", F.col("at") + 2, size)).alias("after"))
        links = siblings if links is None else links.unionByName(siblings)
        level += 1
        here = runs.select("tree", F.col("run").alias("place"), _up(F.col("n"), arity).alias("n"), _hashed(_joined(digests)).alias("digest"),
                           F.lit(level).alias("level"))


def _joined(digests: Column) -> Column:
    return F.aggregate(digests, F.lit(b""), lambda a, d: F.concat(a, d))


CLIMB = """
    WITH RECURSIVE climb(start_tree, start_run, tree, level, place, done, folds, proof) AS (
        SELECT tree, run, tree, 0, run, done, folds, unhex('') FROM {starts}
        UNION ALL
        SELECT c.start_tree, c.start_run, n.up_tree, n.up_level, n.up_place, n.up_done,
               transform(c.folds, f -> unhex(sha2(lower(hex(concat(n.before, f, n.after))), 256))),
               concat(c.proof, n.before, n.after)
        FROM climb c JOIN {nodes} n ON c.tree = n.tree AND c.level = n.level AND c.place = n.place)
    SELECT start_tree AS tree, start_run AS run, folds, proof FROM climb WHERE done"""


def _ascend(starts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Folds and proofs at the root, for every run of leaves; the recursion's limit on rows is lifted meanwhile."""
    spark, limit = starts.sparkSession, "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        return written(spark.sql(CLIMB, starts=starts, nodes=nodes), "merkle-climb")
    finally:
        spark.conf.set(limit, before)


def manifest(docs: DataFrame, tampered: Callable[[str], Column] | None = None, arity: int = 8) -> DataFrame:
    """The digests, proofs and verification of every document row.

    ``docs`` has doc_id, source, lang, n_chars and text; other columns are not read. ``tampered`` gives
    a field's value after tampering (by default nothing is changed). A leaf is the digest of the row's
    fields. In each language leaves stand by doc_id (null first; then by digest; equal rows in any
    order) and every ``arity`` nodes get a parent, a last one alone as well, while more than one is
    left; the languages' roots, null first, then bytewise, make the tree over them. Columns: doc_id,
    leaf, subroot, root, proof (the siblings' digests from the leaf up, as one binary), folded_root
    (climbed from the tampered leaf with the original siblings) and verified. An empty table gives no
    rows. Runs jobs when called.

    Built levels are rows that hold a node's siblings and its parent's name. One recursive query takes
    every run of leaves from parent to parent: it folds the run's own digest and those of its tampered
    leaves, which share all siblings above the run, and appends these siblings.
    """
    kept = tampered or F.col
    changed = leaf_digest([kept(c) for c in FIELDS])
    leaves = docs.select(
        "doc_id", F.when(F.col("lang").isNull(), "-").otherwise(F.concat(F.lit(":"), "lang")).alias("tree_name"),
        leaf_digest([F.col(c) for c in FIELDS]).alias("leaf"), changed.alias("tampered"),
        F.monotonically_increasing_id().alias("tie"))
    leaves = written(_numbered(leaves, "tree_name", ["doc_id", "leaf", "tie"]), "merkle-leaves")
    names = leaves.groupBy("tree_name").agg(F.max("n").alias("n_leaves")).withColumn("one", F.lit(0))
    trees = written(_numbered(names, "one", ["tree_name"]).select(
        "tree_name", F.col("place").cast("long").alias("tree"), F.col("n").alias("n_trees")), "merkle-trees")

    member = F.struct("place", "doc_id", "leaf", F.when(F.col("tampered") != F.col("leaf"), F.col("tampered")).alias("tampered"))
    runs = (
        leaves.groupBy("tree_name", "n", F.expr(f"place div {arity}").alias("run")).agg(F.array_sort(F.collect_list(member)).alias("members"))
        .join(trees, "tree_name")
        .select("tree", "run", _up(F.col("n"), arity).alias("n_runs"), "members")
    )
    own = F.transform("members", lambda m: m["leaf"])
    # A language's only leaf is its root; else a run of leaves has a digest of its own.
    lone = (F.col("n_runs") == 1) & (F.size("members") == 1)
    runs = written(runs.withColumn("digest", F.when(lone, F.col("members")[0]["leaf"]).otherwise(_hashed(_joined(own)))), "merkle-runs")

    links, subroots = _climbed(runs.select("tree", F.col("run").alias("place"), F.col("n_runs").alias("n"), "digest"), arity)
    subroots = written(subroots, "merkle-subroots")
    n_trees = trees.agg(F.coalesce(F.max("n_trees"), F.lit(0))).first()[0]
    heads = subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(n_trees).cast("long").alias("n"), "digest")
    top_links, top = _climbed(heads, arity)
    # One row each; a table without rows has neither.
    root = top.first()
    end = (TOP, root["level"]) if n_trees > 1 else (0, subroots.first()["level"]) if n_trees else (TOP, 0)

    inner, above = (
        t.select("tree", "level", "place", "before", "after", F.col("tree").alias("up_tree"), (F.col("level") + 1).alias("up_level"),
                 F.expr(f"place div {arity}").alias("up_place")) for t in (links, top_links))
    # The root of a language's tree is a node of the tree over the roots: it goes on from there.
    heights = subroots.select(F.col("tree").alias("place"), F.col("level").alias("height"))
    joints = above.where("level = 0").join(heights, "place").select(
        F.col("place").alias("tree"), F.col("height").alias("level"), F.lit(0).cast("long").alias("place"),
        "before", "after", "up_tree", "up_level", "up_place")
    up_done = (F.col("up_tree") == end[0]) & (F.col("up_level") == end[1])
    nodes = written(inner.unionByName(joints).unionByName(above.where("level > 0")).withColumn("up_done", up_done), "merkle-nodes")

    changed = F.filter("members", lambda m: m["tampered"].isNotNull())
    turned = F.transform(changed, lambda m: F.when(lone, m["tampered"]).otherwise(_hashed(_joined(F.transform(
        "members", lambda x: F.when(x["place"] == m["place"], m["tampered"]).otherwise(x["leaf"]))))))
    done = F.lit(n_trees == 1) & (F.col("n_runs") == 1)
    climbed = _ascend(runs.select("tree", "run", F.concat(F.array("digest"), turned).alias("folds"), done.alias("done")), nodes)
    for table in (leaves, trees, nodes):
        discard(table)

    m = F.col("member")
    others = F.transform(F.filter("members", lambda x: x["place"] != F.col("member")["place"]), lambda x: x["leaf"])
    # Fold 0 is the original's; the tampered leaves' folds follow in order.
    nth = F.when(m["tampered"].isNull(), 0).otherwise(F.size(F.filter(
        "members", lambda x: x["tampered"].isNotNull() & (x["place"] <= F.col("member")["place"]))))
    rows = runs.join(climbed, ["tree", "run"]).join(subroots.select("tree", F.col("digest").alias("head")), "tree")
    rows = rows.withColumn("member", F.explode("members")).withColumn("folded", F.get("folds", nth))
    whole = F.lit(bytes(root["digest"]) if root else None).cast("binary")
    return rows.select(
        m["doc_id"].alias("doc_id"), _text(m["leaf"]).alias("leaf"), _text(F.col("head")).alias("subroot"), _text(whole).alias("root"),
        F.concat(_joined(others), "proof").alias("proof"), _text(F.col("folded")).alias("folded_root"),
        (F.col("folded") == whole).alias("verified"))
