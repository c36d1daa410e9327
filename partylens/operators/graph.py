"""Graph analytics over (src, dst) edges: closures by iterated joins, cut points, ranks, cover.

The graphs meant here are dependency graphs of systems. Loops run until nothing changes, however long the
paths are, and each round's result is checkpointed, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partylens.storage import cut

FLIPPED = ("reads", "writes", "joins-on")


def dependencies(edges: DataFrame) -> DataFrame:
    """Interactions (from_id, to_id, type) as dependencies: who reads, writes or joins on something depends on it."""
    flip = F.col("type").isin(*FLIPPED)
    return edges.select(F.when(flip, F.col("to_id")).otherwise(F.col("from_id")).alias("src"), F.when(flip, F.col("from_id")).otherwise(F.col("to_id")).alias("dst"), "type")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): least node of each undirected component, labels jumping to their label's label."""
    both = cut(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    now = nodes.select("id", F.col("id").alias("component"))
    while True:
        near = both.join(now, both["src"] == now["id"]).groupBy(F.col("dst").alias("id")).agg(F.min("component").alias("c"))
        better = now.join(near, "id", "left").select("id", F.least("component", F.coalesce("c", "component")).alias("component"))
        jump = better.select(F.col("id").alias("component"), F.col("component").alias("up"))
        after = cut(better.join(jump, "component").select("id", F.least("component", "up").alias("component")))
        same = after.join(now.withColumnRenamed("component", "old"), "id").filter("component <> old").isEmpty()
        now = after
        if same:
            return now


def reachable(edges: DataFrame) -> DataFrame:
    """(src, dst, hops): the transitive closure with least hops. Paths double with each round, so rounds are logarithmic."""
    total = cut(edges.select("src", "dst").distinct().withColumn("hops", F.lit(1)))
    size = None
    while True:
        onward = total.select("src", F.col("dst").alias("via"), F.col("hops").alias("a")).join(total.select(F.col("src").alias("via"), "dst", F.col("hops").alias("b")), "via").select("src", "dst", (F.col("a") + F.col("b")).alias("hops"))
        after = cut(total.unionByName(onward).groupBy("src", "dst").agg(F.min("hops").alias("hops")))
        told = after.agg(F.count("*").alias("n"), F.sum("hops").alias("hops")).first()
        if (told["n"], told["hops"]) == size:
            return after
        total, size = after, (told["n"], told["hops"])


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, scc): the least node that is reachable both ways, or the node itself."""
    reach = reachable(edges).select("src", "dst")
    mutual = reach.join(reach.select(F.col("src").alias("dst"), F.col("dst").alias("src")), ["src", "dst"]).groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("m"))
    return nodes.select("id").join(mutual, "id", "left").select("id", F.least(F.col("id"), F.coalesce("m", "id")).alias("scc"))


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, level): longest path to the node in the condensation; a cycle is one level."""
    scc = strong_components(nodes, edges)
    a, b = scc.select(F.col("id").alias("src"), F.col("scc").alias("a")), scc.select(F.col("id").alias("dst"), F.col("scc").alias("b"))
    dag = cut(edges.join(a, "src").join(b, "dst").filter("a <> b").select("a", "b").distinct())
    now = cut(scc.select(F.col("scc").alias("a")).distinct().withColumn("level", F.lit(0)))
    while True:
        below = dag.join(now, "a").groupBy(F.col("b").alias("a")).agg(F.max(F.col("level") + 1).alias("l"))
        after = cut(now.join(below, "a", "left").select("a", F.greatest("level", F.coalesce("l", F.lit(0))).alias("level")))
        same = after.join(now.withColumnRenamed("level", "old"), "a").filter("level <> old").isEmpty()
        now = after
        if same:
            return scc.join(now, scc["scc"] == now["a"]).select("id", "level")


def cut_points(nodes: DataFrame, edges: DataFrame, most: int = 2000) -> DataFrame:
    """Nodes whose removal leaves more components. One labelling serves all removals: (removed, id) pairs.

    Quadratic in the nodes, so refused for more than ``most`` of them.
    """
    if nodes.count() > most:
        raise ValueError(f"cut points are for graphs of at most {most} nodes")
    gone = nodes.select(F.col("id").alias("removed"))
    pairs = gone.crossJoin(nodes.select("id")).filter("removed <> id")
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    wide = gone.crossJoin(both).filter("removed <> src and removed <> dst")
    key = F.struct("removed", "id")
    parts = components(pairs.select(key.alias("id")), wide.select(F.struct("removed", F.col("src").alias("id")).alias("src"), F.struct("removed", F.col("dst").alias("id")).alias("dst")))
    left = parts.groupBy(F.col("id.removed").alias("id")).agg(F.countDistinct("component").alias("left"))
    whole = components(nodes, edges)
    alone = nodes.join(both, nodes["id"] == both["src"], "left_anti").select("id", F.lit(1).alias("alone"))
    n = whole.agg(F.countDistinct("component").alias("n"))
    return left.join(alone, "id", "left").crossJoin(n).filter(F.col("left") > F.col("n") - F.coalesce("alone", F.lit(0))).select("id", (F.col("left") - F.col("n") + 1).alias("parts"))


def load_bearing(edges: DataFrame) -> DataFrame:
    """Entities by weighted use (writes 3, joins-on 2, reads 1), and whether other weights (2, 1, 1) rank them alike."""
    weight = lambda w, j, r: F.sum(F.when(F.col("type") == "writes", w).when(F.col("type") == "joins-on", j).when(F.col("type") == "reads", r).otherwise(0))
    s = edges.groupBy(F.col("to_id").alias("id")).agg(weight(3, 2, 1).alias("score"), weight(2, 1, 1).alias("other"))
    ranked = s.withColumn("rank", F.rank().over(Window.orderBy(F.desc("score")))).withColumn("other_rank", F.rank().over(Window.orderBy(F.desc("other"))))
    return ranked.select("id", "score", "rank", (F.col("rank") == F.col("other_rank")).alias("stable"))


def roots(derived: DataFrame) -> DataFrame:
    """(id, root) of (id, parent) chains of any length; a null parent is a root, a cycle has none.

    Each round doubles how far a pointer reaches, so chains of n take about log2(n) rounds; what moves for longer
    than that is on a cycle.
    """
    now = cut(derived.select("id", F.coalesce("parent", "id").alias("up"), F.col("parent").isNull().alias("done")))
    rounds = 1 + max(1, now.count()).bit_length()
    for _ in range(rounds):
        if now.filter("not done").isEmpty():
            break
        above = now.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("done").alias("at_root"))
        met = now.join(above, "up", "left")
        # a parent that isn't listed is a root
        now = cut(met.select("id", F.when(F.col("done") | F.col("next").isNull(), F.col("up")).otherwise(F.col("next")).alias("up"), (F.col("done") | F.col("next").isNull() | F.col("at_root")).alias("done")))
    return now.filter("done").select("id", F.col("up").alias("root"))


def bridges(nodes: DataFrame, edges: DataFrame, most: int = 2000) -> DataFrame:
    """(a, b) undirected edges whose removal parts their ends. All removals are labelled at once; refused for over ``most`` edges."""
    pairs = cut(edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).filter("a <> b").distinct())
    if pairs.count() > most:
        raise ValueError(f"bridges are for graphs of at most {most} edges")
    gone = pairs.select(F.struct("a", "b").alias("removed"))
    at = lambda c: F.struct("removed", F.col(c).alias("id"))
    left = gone.crossJoin(pairs).filter((F.col("removed.a") != F.col("a")) | (F.col("removed.b") != F.col("b")))
    parts = components(gone.crossJoin(nodes.select("id")).select(at("id").alias("id")), left.select(at("a").alias("src"), at("b").alias("dst")))
    ends = parts.select("id.removed", F.col("id.id").alias("node"), "component")
    one, two = ends.filter("node = removed.a"), ends.filter("node = removed.b").select("removed", F.col("component").alias("other"))
    return one.join(two, "removed").filter("component <> other").select("removed.a", "removed.b")


def order_sensitivity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, observed, conservative, moved): levels by observed edges alone and with structural ones, of (src, dst, runtime_status)."""
    seen = levels(nodes, edges.filter("runtime_status = 'observed'").select("src", "dst")).withColumnRenamed("level", "observed")
    every = levels(nodes, edges.select("src", "dst")).withColumnRenamed("level", "conservative")
    return seen.join(every, "id").select("id", "observed", "conservative", (F.col("observed") != F.col("conservative")).alias("moved"))


def verdict_mismatches(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, problem) of nodes (id, verdict, critical) and dependencies (src needs dst): what to settle before verdicts are carried out."""
    reach = reachable(edges).select("src", "dst")
    kept = nodes.filter("verdict = 'KEEP'").select(F.col("id").alias("src"))
    needed = reach.join(kept, "src").select(F.col("dst").alias("id")).distinct()
    critical = nodes.filter("critical").select(F.col("id").alias("goal"))
    paths = reach.select(F.col("src").alias("goal"), F.col("dst").alias("id")).union(reach.select(F.col("dst"), F.col("src"))).join(critical, "goal").select("id").union(critical.select("goal")).distinct()
    told = lambda df, what: df.select("id", F.lit(what).alias("problem"))
    parts = [
        told(nodes.filter("verdict = 'DROP'").join(needed, "id", "left_semi"), "dropped, yet needed by what is kept"),
        told(nodes.filter("verdict = 'KEEP'").join(paths, "id", "left_anti"), "kept without a path to anything critical"),
        told(nodes.filter("verdict = 'DEFER'").join(needed, "id", "left_semi"), "deferred, yet needed by what is kept"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def cover(offers: DataFrame, most: int = 100_000) -> DataFrame:
    """(step, key): a greedy cover of all items of (key, item): most uncovered first, then the least key.

    A round is one aggregate; only the items that are covered by now come to the driver, so the universe of items
    must be small (``most``), not the offers.
    """
    offers = cut(offers.select("key", "item").distinct())
    if offers.select("item").distinct().limit(most + 1).count() > most:
        raise ValueError(f"a cover is for at most {most} items")
    chosen, left = [], offers
    while True:
        best = left.groupBy("key").agg(F.count("*").alias("n"), F.collect_set("item").alias("items")).orderBy(F.desc("n"), "key").first()
        if best is None:
            break
        chosen.append((len(chosen) + 1, best["key"]))
        left = cut(left.filter(~F.col("item").isin(list(best["items"]))))
    kind = offers.schema["key"].dataType.simpleString()
    return offers.sparkSession.createDataFrame(chosen, f"step int, key {kind}")


def greedy_cover(required: set[str], offers: dict[str, set[str]]) -> list[str]:
    """A heuristic set cover: most uncovered first, then by name. Small sets, on the driver."""
    chosen, missing = [], set(required)
    while missing:
        best = max(sorted(offers), key=lambda k: len(offers[k] & missing), default=None)
        if best is None or not offers[best] & missing:
            break
        chosen.append(best)
        missing -= offers[best]
    return chosen
