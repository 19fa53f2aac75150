"""The concept graph (GRA-*, JOI-02 to JOI-06): edges from notes, windows, neighbourhoods, communities, maps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.numbers import overlap
from ..store import written

MENTION_PAIRS, MAX_CLAIMS, WINDOW_NODES, WINDOW_EDGES, RANK_POOL, PAIR_POOL = 8, 20, 500, 2000, 4000, 8000
#: Words of the graph itself that no claim may use.
SYSTEM_WORDS = ("mentions", "co-mentions", "related", "references")


def link(notes: DataFrame, most: int = 40) -> DataFrame:
    """GRA-01: (memory_id, entity, pos): the concepts of each note, once each, in the order they come."""
    return notes.select(F.col("id").alias("memory_id"), F.posexplode(X.concepts(F.col("content"), most)).alias("pos", "entity"))


def valid_claims(payload: Column, most: int = MAX_CLAIMS) -> Column:
    """JSN-02: claims (source, target, word) of a JSON text: three parts that are there, two different ends, no system word."""
    rows = F.coalesce(F.from_json(payload, "struct<beziehungen:array<struct<quelle:string,ziel:string,wort:string>>>")["beziehungen"], F.array().cast("array<struct<quelle:string,ziel:string,wort:string>>"))
    clean = F.transform(rows, lambda c: F.struct(F.substring(F.lower(F.trim(c["quelle"])), 1, 80).alias("source"), F.substring(F.lower(F.trim(c["ziel"])), 1, 80).alias("target"), F.substring(F.trim(c["wort"]), 1, 40).alias("word")))
    return F.slice(F.filter(clean, lambda c: (c["source"] != "") & (c["target"] != "") & (c["word"] != "") & (c["source"] != c["target"]) & ~F.lower(c["word"]).isin(*SYSTEM_WORDS)), 1, most)


def edges_of_notes(notes: DataFrame, linked: DataFrame, claims: DataFrame | None = None, first: int = MENTION_PAIRS) -> DataFrame:
    """GRA-02: edges (source, target, relation, memory_id) of each note: its title mentions its concepts, its first concepts go together, its claims.

    ``linked``: (memory_id, entity, pos). Pairs are taken among the first ``first`` concepts, so a note has a bounded number.
    """
    title = notes.select(F.col("id").alias("memory_id"), F.lower(F.trim("title")).alias("source"))
    mention = linked.join(title, "memory_id").where("source <> entity").select("source", F.col("entity").alias("target"), F.lit("mentions").alias("relation"), "memory_id")
    head = linked.where(F.col("pos") < first)
    a, b = head.select("memory_id", F.col("entity").alias("source"), F.col("pos").alias("p")), head.select("memory_id", F.col("entity").alias("target"), F.col("pos").alias("r"))
    together = a.join(b, "memory_id").where("p < r").select("source", "target", F.lit("co-mentions").alias("relation"), "memory_id")
    out = mention.unionByName(together)
    if claims is not None:
        out = out.unionByName(claims.select("source", "target", F.col("word").alias("relation"), "memory_id"))
    return out.distinct()


def orphans(entities: DataFrame, linked: DataFrame, edges: DataFrame) -> DataFrame:
    """GRA-02: entities without a note and without an edge."""
    used = linked.select(F.col("entity")).unionAll(edges.select(F.col("source"))).unionAll(edges.select("target")).distinct()
    return entities.join(used, "entity", "left_anti")


def typed_relation(source: Column, target: Column, word: Column) -> Column:
    """GRA-21: normalised ends and a word of 40 characters, ``related`` if there is none."""
    name = lambda c: F.substring(F.lower(F.trim(c)), 1, 80)
    said = F.substring(F.trim(F.coalesce(word, F.lit(""))), 1, 40)
    return F.struct(name(source).alias("source"), name(target).alias("target"), F.when(said == "", "related").otherwise(said).alias("relation"))


def degrees(edges: DataFrame) -> DataFrame:
    """SET-01: edges at each node, both ends counted."""
    return edges.select(F.col("source").alias("node")).unionAll(edges.select("target")).groupBy("node").agg(F.count("*").alias("degree"))


def importance(mentions: DataFrame, edges: DataFrame) -> DataFrame:
    """AGG-03, JOI-05: (entity, mentions, degree, importance): notes that carry a concept plus its edges."""
    carried = mentions.groupBy("entity").agg(F.count("*").alias("mentions"))
    degree = degrees(edges).select(F.col("node").alias("entity"), "degree")
    out = carried.join(degree, "entity", "full_outer").fillna(0, ["mentions", "degree"])
    return out.withColumn("importance", F.col("mentions") + F.col("degree"))


def coverage(mentions: DataFrame, notes: DataFrame) -> DataFrame:
    """AGG-04, JOI-02: live notes, those that carry a concept, and the share in percent."""
    live = notes.where("deleted_at IS NULL").select("id")
    have = mentions.select(F.col("memory_id").alias("id")).distinct().join(live, "id", "left_semi").agg(F.count("*").alias("covered"))
    return have.crossJoin(live.agg(F.count("*").alias("notes"))).withColumn("percent", F.when(F.col("notes") > 0, F.round(100 * F.col("covered") / F.col("notes"), 2)).otherwise(0.0))


def pairs_ranked(edges: DataFrame, mentions: DataFrame, most: int = WINDOW_EDGES) -> DataFrame:
    """GRA-05, JOI-06: edges by pair evidence, then by the carriers of both ends, then by name; the first ``most``."""
    pair = edges.groupBy("source", "target").agg(F.count("*").alias("evidence"))
    carriers = mentions.groupBy("entity").agg(F.count("*").alias("n"))
    out = pair.join(carriers.select(F.col("entity").alias("source"), F.col("n").alias("ns")), "source", "left").join(carriers.select(F.col("entity").alias("target"), F.col("n").alias("nt")), "target", "left")
    out = out.select("source", "target", "evidence", (F.coalesce("ns", F.lit(0)) + F.coalesce("nt", F.lit(0))).alias("carriers"))
    return out.orderBy(F.desc("evidence"), F.desc("carriers"), "source", "target").limit(most)


def khop(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """GRA-03, GRA-17: (node, distance) within ``depth`` undirected steps of the nodes of ``start`` (node).

    One join per step; each step only goes on from nodes that are new, so a node is reached once.
    """
    both = edges.select(F.col("source").alias("u"), F.col("target").alias("v")).unionAll(edges.select(F.col("target").alias("u"), F.col("source").alias("v"))).distinct()
    seen = start.select("node", F.lit(0).alias("distance")).distinct()
    for step in range(1, depth + 1):
        last = seen.where(F.col("distance") == step - 1)
        new = both.join(last.select(F.col("node").alias("u")), "u").select(F.col("v").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        seen = written(seen.unionByName(new.select("node", F.lit(step).alias("distance")))) if step < depth else seen.unionByName(new.select("node", F.lit(step).alias("distance")))
    return seen


def subgraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """GRA-03: the edges whose two ends are among ``nodes`` (node)."""
    return edges.join(nodes.select(F.col("node").alias("source")), "source", "left_semi").join(nodes.select(F.col("node").alias("target")), "target", "left_semi")


def window(ranked: DataFrame, pairs: DataFrame, nodes: int = WINDOW_NODES, depth: int = 2, rank_pool: int = RANK_POOL, pair_pool: int = PAIR_POOL) -> DataFrame:
    """GRA-04: (entity, seed): seeds in the order of importance take their strongest neighbours until ``nodes`` are drawn.

    The pools bound what the greedy step sees, whatever the graph's size, so it runs in one task over both.
    """
    pool = ranked.orderBy(F.desc("importance"), "entity").limit(rank_pool).select(F.lit("n").alias("kind"), F.col("entity").cast("string").alias("a"), F.lit(None).cast("string").alias("b"), F.col("importance").cast("double").alias("w"))
    strong = pairs.orderBy(F.desc("evidence"), "source", "target").limit(pair_pool).select(F.lit("p").alias("kind"), F.col("source").cast("string").alias("a"), F.col("target").cast("string").alias("b"), F.col("evidence").cast("double").alias("w"))

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        order = rows[rows.kind == "n"].sort_values(["w", "a"], ascending=[False, True]).a.tolist()
        near: dict[str, list[tuple[float, str]]] = {}
        for p in rows[rows.kind == "p"].itertuples():
            near.setdefault(p.a, []).append((-p.w, p.b))
            near.setdefault(p.b, []).append((-p.w, p.a))
        drawn: dict[str, str] = {}
        for seed in order:
            if len(drawn) >= nodes:
                break
            if seed in drawn:
                continue
            drawn[seed] = seed
            front = [seed]
            for _ in range(depth):
                following = []
                for u in front:
                    for _, v in sorted(near.get(u, ())):
                        if v not in drawn and len(drawn) < nodes:
                            drawn[v] = seed
                            following.append(v)
                front = following
        return pd.DataFrame({"entity": list(drawn), "seed": list(drawn.values())})

    return pool.unionByName(strong).groupBy(F.lit(1).alias("all")).applyInPandas(lambda rows: draw(rows), "entity string, seed string")


def balance(edges: DataFrame, drawn: DataFrame) -> DataFrame:
    """GRA-06: edges inside a drawn window, with one end outside, and fully outside."""
    ends = edges.join(drawn.select(F.col("entity").alias("source"), F.lit(1).alias("s")), "source", "left").join(drawn.select(F.col("entity").alias("target"), F.lit(1).alias("t")), "target", "left")
    n = F.coalesce("s", F.lit(0)) + F.coalesce("t", F.lit(0))
    return ends.agg(F.count_if(n == 2).alias("shown"), F.count_if(n == 1).alias("dropped"), F.count_if(n == 0).alias("outside"))


def cluster_weights(mention_edges: DataFrame, claim_edges: DataFrame) -> DataFrame:
    """GRA-07: (a, b, w): a mention weighs 1, a claim 2; both directions summed."""
    rows = mention_edges.select("source", "target", F.lit(1.0).alias("w")).unionByName(claim_edges.select("source", "target", F.lit(2.0).alias("w")))
    return rows.where("source <> target").groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.sum("w").alias("w"))


def pair_weights(pairs: DataFrame, claimed: Column) -> DataFrame:
    """GRA-07 over pairs (source, target) that are mention edges, and claims too where ``claimed`` (of the pair alone) holds.

    Gives what :func:`cluster_weights` gives for the distinct pairs, by one grouping; repeated pairs count once.
    """
    w = F.when(claimed, 3.0).otherwise(1.0)
    one_way, other_way = F.max(F.when(F.col("source") < F.col("target"), w)), F.max(F.when(F.col("source") > F.col("target"), w))
    rows = pairs.where("source <> target").groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"))
    return rows.agg((F.coalesce(one_way, F.lit(0.0)) + F.coalesce(other_way, F.lit(0.0))).alias("w"))


def modularity(weights: DataFrame, partition: DataFrame) -> DataFrame:
    """GRA-09: Q of (node, community) over edges (a, b, w): edges are read once and summed by the communities of their ends."""
    p = partition.select("node", "community")
    ends = weights.join(p.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(p.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b")
    ends = written(ends.groupBy("ca", "cb").agg(F.sum("w").alias("w")))
    total = ends.agg(F.sum("w").alias("m"))
    inside = ends.where("ca = cb").groupBy(F.col("ca").alias("c")).agg(F.sum("w").alias("inside"))
    degree = ends.select(F.col("ca").alias("c"), "w").unionAll(ends.select("cb", "w")).groupBy("c").agg(F.sum("w").alias("k"))
    each = degree.join(inside, "c", "left").crossJoin(F.broadcast(total)).fillna(0.0, ["inside"])
    return each.agg(F.coalesce(F.sum(F.col("inside") / F.col("m") - (F.col("k") / (2 * F.col("m"))) * (F.col("k") / (2 * F.col("m")))), F.lit(0.0)).alias("q"))


def _louvain(edges: list[tuple[str, str, float]], levels: int = 12, sweeps: int = 200) -> dict[str, int]:
    """Modularity communities with nodes in sorted order; a move needs a gain above the best so far."""
    names = sorted({x for a, b, _ in edges for x in (a, b)})
    at = {n: i for i, n in enumerate(names)}
    graph: list[dict[int, float]] = [{} for _ in names]
    for a, b, w in edges:
        i, j = at[a], at[b]
        graph[i][j] = graph[i].get(j, 0.0) + w
        if i != j:
            graph[j][i] = graph[j].get(i, 0.0) + w
    member = list(range(len(names)))
    loops = [0.0] * len(graph)
    for _ in range(levels):
        degree = [sum(n.values()) + loops[i] for i, n in enumerate(graph)]
        twice = sum(degree)
        if twice <= 0:
            break
        home = list(range(len(graph)))
        total = degree[:]
        for _ in range(sweeps):
            moved = False
            for i, near in enumerate(graph):
                to: dict[int, float] = {}
                for j, w in near.items():
                    to[home[j]] = to.get(home[j], 0.0) + w
                total[home[i]] -= degree[i]
                best, gain = home[i], to.get(home[i], 0.0) - total[home[i]] * degree[i] / twice
                for c in sorted(to):
                    g = to[c] - total[c] * degree[i] / twice
                    if g > gain + 1e-12:
                        best, gain = c, g
                total[best] += degree[i]
                moved |= best != home[i]
                home[i] = best
            if not moved:
                break
        numbers = {c: k for k, c in enumerate(sorted(set(home)))}
        if len(numbers) == len(graph):
            break
        member = [numbers[home[m]] for m in member]
        folded: list[dict[int, float]] = [{} for _ in numbers]
        inner = [0.0] * len(numbers)
        for i, near in enumerate(graph):
            ci = numbers[home[i]]
            inner[ci] += loops[i]
            for j, w in near.items():
                cj = numbers[home[j]]
                if ci == cj:
                    inner[ci] += w
                else:
                    folded[ci][cj] = folded[ci].get(cj, 0.0) + w
        graph, loops = folded, inner
    return {n: member[i] for i, n in enumerate(names)}


def communities(weights: DataFrame, most: int = WINDOW_NODES * WINDOW_NODES) -> DataFrame:
    """GRA-08: (node, community, size): Louvain over a drawn window of the graph, which the window's bound keeps small.

    Sequential by nature, so it is one task; :func:`propagate` is the form for whole graphs. More than ``most`` edges are an
    error. Communities are numbered by size, then by their first node.
    """
    if weights.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} edges: take a window of the graph, or propagate")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        part = _louvain([(str(a), str(b), float(w)) for a, b, w in rows[["a", "b", "w"]].itertuples(index=False)])
        groups: dict[int, list[str]] = {}
        for node, c in part.items():
            groups.setdefault(c, []).append(node)
        order = sorted(groups.values(), key=lambda g: (-len(g), min(g)))
        return pd.DataFrame([(node, i, len(g)) for i, g in enumerate(order) for node in sorted(g)], columns=["node", "community", "size"])

    flat = weights.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), "w")
    return flat.groupBy(F.lit(1).alias("all")).applyInPandas(lambda rows: run(rows), "node string, community int, size int")


def _near_lists(weights: DataFrame) -> DataFrame:
    """(v, u, w): for each node lists of the nodes around it and their weights; a node of many edges has several rows."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("u"), "w"), F.struct(F.col("b").alias("v"), F.col("a").alias("u"), "w")))
    rows = weights.select(ends.alias("e")).select("e.*").where("v IS NOT NULL").repartition("v").sortWithinPartitions("v")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, v = batch.num_rows, batch.column("v")
            if n:
                new = pc.not_equal(v.slice(1), v.slice(0, n - 1)).to_numpy(zero_copy_only=False)
                at = np.concatenate([[0], np.flatnonzero(new) + 1, [n]]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([v.take(pa.array(at[:-1])), *[pa.ListArray.from_arrays(pa.array(at), batch.column(c)) for c in ("u", "w")]], ["v", "u", "w"])

    return rows.mapInArrow(lambda b: lists(b), f"v {kinds['v']}, u array<{kinds['u']}>, w array<{kinds['w']}>")


def propagate(weights: DataFrame, rounds: int = 10) -> DataFrame:
    """GRA-08 for whole graphs: weighted label propagation by joins; each node takes the label with most weight around it (ties: the smallest).

    A round joins each node's label with its lists of neighbours and shuffles one vote for each direction of an edge, by the
    node it is for; votes are summed and decided there, so a node has as many votes as neighbours at most.
    """
    near = written(_near_lists(weights))
    label = near.select(F.col("v").alias("node")).distinct().withColumn("label", F.col("node"))
    for _ in range(rounds):
        own = label.select(F.col("node").alias("u"), "label", F.lit(0.5).cast("double").alias("w"))
        met = near.join(label.hint("shuffle_hash").withColumnRenamed("node", "v"), "v")
        votes = met.select("label", F.explode(F.arrays_zip("u", "w")).alias("e")).select("e.u", "label", F.col("e.w").cast("double").alias("w"))
        votes = votes.unionByName(own).repartition("u")
        label = written(votes.groupBy("u", "label").agg(F.sum("w").alias("w")).groupBy("u").agg(F.min_by("label", F.struct(-F.col("w"), "label")).alias("label")).withColumnRenamed("u", "node"))
    return label.withColumnRenamed("label", "community")


def cluster_names(partition: DataFrame, labelled: DataFrame) -> DataFrame:
    """GRA-10: (community, size, name): the labelled member (node, label, degree) with the highest degree names it."""
    rows = partition.join(labelled, "node", "left")
    name = F.min_by("label", F.when(F.col("label").isNotNull(), F.struct(-F.col("degree"), F.col("node"))))
    return rows.groupBy("community").agg(F.count("*").alias("size"), name.alias("name"))


def purity(partition: DataFrame, types: DataFrame) -> DataFrame:
    """GRA-10: (community, purity): share of the most frequent type (node, type) of each community."""
    n = partition.join(types, "node").groupBy("community", "type").agg(F.count("*").alias("n"))
    return n.groupBy("community").agg((F.max("n") / F.sum("n")).alias("purity"))


def cluster_order(partition: DataFrame) -> DataFrame:
    """AGG-21, GRA-11: number of clusters, median size, share of the largest in percent, and whether it is under a tenth."""
    sizes = partition.groupBy("community").agg(F.count("*").alias("n"))
    out = sizes.agg(F.count("*").alias("clusters"), F.median("n").alias("median"), F.max("n").alias("largest"), F.sum("n").alias("nodes"))
    return out.withColumn("largest_percent", F.round(100 * F.col("largest") / F.col("nodes"), 2)).withColumn("balanced", F.col("largest") / F.col("nodes") <= 0.1)


def cluster_picture(partition: DataFrame, shown: int = 8) -> DataFrame:
    """GRA-22: (community, size, key): the largest clusters keep a key of their own, the others are neutral."""
    sizes = partition.groupBy("community").agg(F.count("*").alias("size"))
    rank = F.row_number().over(Window.orderBy(F.desc("size"), "community"))
    top = sizes.orderBy(F.desc("size"), "community").limit(shown).select("community", rank.alias("r"))
    return sizes.join(F.broadcast(top), "community", "left").select("community", "size", F.when(F.col("r").isNotNull(), F.concat(F.lit("c"), "r")).otherwise("neutral").alias("key"))


def note_edges(notes: DataFrame, low: int = 2, high: int = 140) -> DataFrame:
    """GRA-12: similarity edges (a, b, strength): notes that share tags or title words which ``low`` to ``high`` notes have.

    strength = max(0.9 * tag overlap, 0.6 * title overlap) above 0.24, or 0.3 if there is a tag in common and the titles
    overlap by more than 0.15.
    """
    words = F.array_distinct(F.filter(F.split(F.lower("title"), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 2))
    rows = notes.select("id", F.array_distinct("tags").alias("tags"), words.alias("words"))
    each = rows.select("id", F.explode(F.concat(F.transform("tags", lambda t: F.concat(F.lit("t:"), t)), F.transform("words", lambda w: F.concat(F.lit("w:"), w)))).alias("k"))
    held = each.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n").between(low, high)).select("k")
    each = each.join(held, "k")
    a, b = each.select(F.col("id").alias("a"), "k"), each.select(F.col("id").alias("b"), "k")
    pairs = a.join(b, "k").where("a < b").select("a", "b").distinct()
    both = pairs.join(rows.select(F.col("id").alias("a"), F.col("tags").alias("ta"), F.col("words").alias("wa")), "a").join(rows.select(F.col("id").alias("b"), F.col("tags").alias("tb"), F.col("words").alias("wb")), "b")
    both = both.select("a", "b", overlap(F.col("ta"), F.col("tb")).alias("tag"), overlap(F.col("wa"), F.col("wb")).alias("title"))
    strength = F.greatest(0.9 * F.col("tag"), 0.6 * F.col("title"))
    return both.select("a", "b", F.when(strength > 0.24, strength).when((F.col("tag") > 0) & (F.col("title") > 0.15), F.lit(0.3)).alias("strength")).where("strength IS NOT NULL")


def merged_edges(edges: DataFrame) -> DataFrame:
    """GRA-12: real pairs merged: (a, b, evidence, relations, valid_from, valid_to); an open end stays open."""
    rows = edges.groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"))
    return rows.agg(
        F.count("*").alias("evidence"),
        F.array_join(F.array_sort(F.collect_set("relation")), ",").alias("relations"),
        F.when(F.count("valid_from") == F.count("*"), F.min("valid_from")).alias("valid_from"),
        F.when(F.count("valid_to") == F.count("*"), F.max("valid_to")).alias("valid_to"),
    )


def concept_network(mentions: DataFrame, edges: DataFrame, visible: DataFrame) -> DataFrame:
    """GRA-13: edges among concepts that at least two visible notes (id) carry."""
    carriers = mentions.join(visible.select(F.col("id").alias("memory_id")), "memory_id", "left_semi").groupBy("entity").agg(F.count("*").alias("n")).where("n >= 2")
    nodes = carriers.select(F.col("entity").alias("node"))
    return subgraph(edges, nodes)


def hierarchy(notes: DataFrame, mentions: DataFrame) -> DataFrame:
    """GRA-14: (id, path): root, type, the first concept by name or else the rarest tag, note."""
    concept = mentions.groupBy("memory_id").agg(F.min("entity").alias("concept")).withColumnRenamed("memory_id", "id")
    each = notes.select("id", F.explode(F.array_distinct("tags")).alias("tag"))
    rare = each.join(each.groupBy("tag").agg(F.count("*").alias("n")), "tag").groupBy("id").agg(F.min(F.struct("n", "tag"))["tag"].alias("tag"))
    rows = notes.select("id", "type").join(concept, "id", "left").join(rare, "id", "left")
    return rows.select("id", F.concat_ws("/", F.lit("root"), "type", F.coalesce("concept", "tag", F.lit("-")), "id").alias("path"))


def fold_tree(counts: dict[str, int], rows: int) -> set[str]:
    """GRA-15: branches to fold, the largest first, so that what is left fits in ``rows`` rows."""
    folded: set[str] = set()
    shown = sum(counts.values()) + len(counts)
    for name, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        if shown <= rows:
            break
        folded.add(name)
        shown -= n
    return folded


def semantic_map(chunks: DataFrame, most: int = 2000) -> DataFrame:
    """GRA-16: (id, x, y, share_x, share_y): two principal components of the mean vectors in the most frequent model.

    The first ``most`` notes by id are drawn; the map is a picture of a bounded size. Each axis points to the side where
    its largest loading is positive; coordinates are scaled by 90 times the square root of their number.
    """
    model = chunks.groupBy("model").agg(F.countDistinct("memory_id").alias("n")).orderBy(F.desc("n"), "model").limit(1).select("model")
    rows = chunks.join(F.broadcast(model), "model", "left_semi").select("memory_id", F.posexplode("embedding").alias("i", "v"))
    mean = rows.groupBy("memory_id", "i").agg(F.avg(F.col("v").cast("double")).alias("v")).groupBy("memory_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("c"))
    few = mean.orderBy("memory_id").limit(most)

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("memory_id")
        m = np.stack(batch.c.to_numpy())
        m = m - m.mean(axis=0)
        _, s, v = np.linalg.svd(m, full_matrices=False)
        axes = v[:2] * np.sign(v[:2][np.arange(min(2, len(v))), np.abs(v[:2]).argmax(axis=1)])[:, None]
        at = m @ axes.T
        spread = np.abs(at).max() or 1.0
        at = at / spread * 90 * np.sqrt(len(m))
        share = s**2 / max((s**2).sum(), 1e-30)
        return pd.DataFrame({"id": batch.memory_id, "x": at[:, 0], "y": at[:, 1] if at.shape[1] > 1 else 0.0, "share_x": share[0], "share_y": share[1] if len(share) > 1 else 0.0})

    return few.groupBy(F.lit(1).alias("all")).applyInPandas(lambda rows: run(rows), "id string, x double, y double, share_x double, share_y double")


def edge_visible(a_active: Column, b_active: Column, valid_from: Column, valid_to: Column, at_ms: int) -> Column:
    """FLT-03: both ends active and the edge's own window open."""
    return a_active & b_active & (valid_from.isNull() | (valid_from <= at_ms)) & (valid_to.isNull() | (valid_to > at_ms))


def focus_quadrant(edges: DataFrame, focus: str) -> DataFrame:
    """GRA-18: neighbours of a focus by direction: in, out or both."""
    rows = edges.where((F.col("source") == focus) | (F.col("target") == focus)).select(F.when(F.col("source") == focus, F.col("target")).otherwise(F.col("source")).alias("node"), F.when(F.col("source") == focus, "out").otherwise("in").alias("side"))
    return rows.groupBy("node").agg(F.when(F.count_if(F.col("side") == "in") == 0, "out").when(F.count_if(F.col("side") == "out") == 0, "in").otherwise("both").alias("side"))


def review_lens(notes: DataFrame, edges: DataFrame, contradicted: DataFrame) -> DataFrame:
    """GRA-18: (id, lens): contradicted, superseded, isolated or settled; the first that holds."""
    linked = edges.select(F.col("a").alias("id")).unionAll(edges.select("b")).distinct().withColumn("linked", F.lit(True))
    bad = contradicted.select("id").distinct().withColumn("bad", F.lit(True))
    rows = notes.select("id", "superseded_by").join(linked, "id", "left").join(bad, "id", "left")
    return rows.select("id", F.when(F.col("bad"), "contradicted").when(F.col("superseded_by").isNotNull(), "superseded").when(F.col("linked").isNull(), "isolated").otherwise("settled").alias("lens"))


def node_size(degree: Column) -> Column:
    """GRA-19."""
    return F.least(F.lit(26.0), 4 + 1.6 * F.sqrt(degree))


def edge_band(strength: Column) -> Column:
    """GRA-19: thickness bands."""
    return F.when(strength >= 0.75, "thick").when(strength >= 0.45, "medium").otherwise("thin")


def entity_notes(mentions: DataFrame) -> DataFrame:
    """GRA-20: (entity, notes): the notes of each concept, sorted."""
    return mentions.groupBy("entity").agg(F.array_sort(F.collect_set("memory_id")).alias("notes"))


def totals(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """AGG-05: concepts and relations of the whole graph."""
    return entities.agg(F.count("*").alias("nodes")).crossJoin(relations.agg(F.count("*").alias("edges")))


def tally(edges: DataFrame) -> DataFrame:
    """GRA-23: real and similarity edges (real: a boolean)."""
    return edges.agg(F.count_if("real").alias("real"), F.count_if(~F.col("real")).alias("similar"))


def carried_only(mentions: DataFrame, folded: list[str]) -> DataFrame:
    """FLT-12: notes that hang under exactly one concept, and that one is folded."""
    n = mentions.groupBy("memory_id").agg(F.countDistinct("entity").alias("n"), F.max("entity").alias("entity"))
    return n.where((F.col("n") == 1) & F.col("entity").isin(folded)).select(F.col("memory_id").alias("id"))


def with_connections(notes: DataFrame, edges: DataFrame) -> DataFrame:
    """FLT-13: (connected, isolated) counts."""
    ends = edges.select(F.col("a").alias("id")).unionAll(edges.select("b")).distinct()
    rows = notes.select("id").join(ends.withColumn("c", F.lit(1)), "id", "left")
    return rows.agg(F.count("c").alias("connected"), F.count_if(F.col("c").isNull()).alias("isolated"))

