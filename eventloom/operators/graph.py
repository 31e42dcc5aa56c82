"""Event graphs and lineage: edges, differences, reachability, paths, orderings.

Loops run over levels of a graph, each level one join, written to the shared folder to cut lineage.
nodes: (id, ...); edges: (edge_seq, from, to, kind, weight, ...).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import pieces, stage
from .chain import folded_hash

#: Levels after which a loop raises an error: no result is cut without a word.
MAX_LEVELS = 1_000_000
#: Levels after which what was found so far is written as one table again.
COMPACT = 16
#: Levels that are taken one by one before paths without branches are shortened.
SHALLOW = 8


def _levels(depth: int | None, first: int = 1) -> Iterator[int]:
    """Numbers of levels: up to `depth`, or until the caller has no more to do."""
    for level in itertools.count(first):
        if depth is not None and level - first >= depth:
            return
        if depth is None and level - first >= MAX_LEVELS:
            raise RuntimeError(f"more than {MAX_LEVELS} levels")
        yield level


def _with(found: DataFrame, level: DataFrame, number: int, tag: str) -> DataFrame:
    both = found.unionByName(level)
    return stage(both, tag) if number % COMPACT == 0 else both


def event_edges(events: DataFrame) -> DataFrame:
    """(session_id, from, to) from an event to each event that names it as parent and isn't earlier."""
    p = events.select("session_id", F.col("event_id").alias("from"), F.col("sequence").alias("__at"))
    c = events.filter("parent_event_id IS NOT NULL").select("session_id", F.col("parent_event_id").alias("from"), F.col("event_id").alias("to"), F.col("sequence").alias("to_sequence"))
    return c.join(p, ["session_id", "from"]).filter(F.col("__at") <= F.col("to_sequence")).drop("__at")


def span_edges(spans: DataFrame) -> DataFrame:
    p = spans.select("trace_id", F.col("span_id").alias("from"))
    c = spans.filter("parent_span_id IS NOT NULL").select("trace_id", F.col("parent_span_id").alias("from"), F.col("span_id").alias("to"))
    return c.join(p, ["trace_id", "from"])


def build_graph(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    nodes = events.select(F.col("event_id").alias("id"), "session_id", F.col("kind").alias("name"), "source", (F.col("duration_ns") / 1e6).alias("duration_ms"), "utc_timestamp", "sequence")
    return nodes, event_edges(events)


def graph_diff(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """(key, change): added, removed, or of another duration (null against a value counts)."""
    x, y = (d.select(F.col(key), F.col("duration_ms").alias(n), F.lit(True).alias(f"has{n}")) for d, n in ((a, "__a"), (b, "__b")))
    change = F.when(F.col("has__a").isNull(), "added").when(F.col("has__b").isNull(), "removed").when(~F.col("__a").eqNullSafe(F.col("__b")), "changed")
    return x.join(y, key, "full_outer").select(key, change.alias("change")).filter("change IS NOT NULL")


def set_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one side has, with `change`."""
    return b.subtract(a).withColumn("change", F.lit("added")).unionByName(a.subtract(b).withColumn("change", F.lit("removed")))


def follow_chain(edges: DataFrame, starts: DataFrame, depth: int | None = None) -> DataFrame:
    """(start, step, id): from each start, the first child (by to_sequence) again and again, up to a node seen before.

    Pointers are doubled: a round appends to every chain as much as it has, by a table of the nodes so
    many steps on, and squares that table; a chain of n nodes takes log2(n) rounds."""
    jump = stage(edges.groupBy("from").agg(F.min_by("to", F.struct("to_sequence", "to")).alias("to")).select(F.col("from").alias("u"), F.col("to").alias("v")), "jump")
    out = stage(starts.select(F.col("id").alias("start"), F.lit(0).cast("long").alias("step"), "id").distinct(), "chain")
    span = 1
    while depth is None or span <= depth:
        new = out.join(jump, F.col("id") == F.col("u")).select("start", (F.col("step") + span).alias("step"), F.col("v").alias("id"))
        new = new if depth is None else new.filter(F.col("step") <= depth)
        first = new.groupBy("start", "id").agg(F.min("step").alias("step")).join(out.select("start", "id"), ["start", "id"], "left_anti")
        level = stage(first.select("start", "step", "id"), "chain")
        if level.isEmpty():
            break
        if span > MAX_LEVELS:
            raise RuntimeError(f"more than {MAX_LEVELS} steps")
        out, span = out.unionByName(level), 2 * span
        far = jump.select(F.col("u").alias("w"), F.col("v").alias("u"))
        jump = stage(far.join(jump, "u").select(F.col("w").alias("u"), "v"), "jump")
    return out


def _heads(links: DataFrame) -> DataFrame:
    """(id, head, pos) of the nodes that follow others on unary paths given by links (u, v): the path's first node
    and how many steps the node is after it.  Pointers are doubled; a cycle is cut before its smallest node."""
    back = stage(links.select(F.col("v").alias("id"), F.col("u").alias("head"), F.lit(1).cast("long").alias("pos"), F.least("u", "v").alias("low")), "heads")
    for _ in range(back.count().bit_length() + 1):
        on = back.select(F.col("id").alias("head"), F.col("head").alias("__head"), F.col("pos").alias("__pos"), F.col("low").alias("__low"))
        far = back.join(on, "head", "left")
        moved = F.col("__head").isNotNull()
        back = stage(far.select("id", F.coalesce("__head", "head").alias("head"), (F.col("pos") + F.coalesce("__pos", F.lit(0))).alias("pos"), F.least("low", "__low").alias("low"), moved.alias("moved")), "heads")
        if back.filter("moved").isEmpty():
            return back.select("id", "head", "pos")
        back = back.drop("moved")
    round_ = back.join(back.select(F.col("id").alias("head")), "head", "left_semi").select(F.col("low").alias("v")).distinct()
    return _heads(stage(links.join(round_, "v", "left_anti").select("u", "v"), "links"))


def _deep(e: DataFrame, level: DataFrame, hops: int) -> DataFrame:
    """(start, id, hops) of what is reached from a level (start, u) of nodes so many hops away, over edges (u, v).

    Unary paths count as one step: a path is entered at its head only, so the distance of its head gives those
    of all its nodes.  Distances of heads are improved until none changes."""
    one_out = e.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("u")
    one_in = e.groupBy("v").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("v")
    links = stage(e.filter("u != v").join(one_out, "u", "left_semi").join(one_in, "v", "left_semi").select("u", "v"), "links")
    after = _heads(links)
    nodes = e.select(F.col("u").alias("id")).union(e.select("v")).distinct()
    place = stage(nodes.join(after, "id", "left").select("id", F.coalesce("head", "id").alias("head"), F.coalesce("pos", F.lit(0)).cast("long").alias("pos")), "paths-of")
    size = place.groupBy("head").agg((F.max("pos") + 1).alias("size"))
    # an edge that joins two paths leaves the last node of one and enters the first of the other
    inner = after.select(F.col("id").alias("v"))
    joins = e.join(inner, "v", "left_anti").join(place.withColumnRenamed("id", "u"), "u").select("head", F.col("v").alias("to"))
    joins = stage(joins.join(size, "head"), "path-edges")
    at = stage(level.join(place, F.col("u") == F.col("id")).select("start", "head", "pos"), "deep")
    rest = at.join(place.select("head", "id", F.col("pos").alias("__pos")), "head").filter("__pos > pos").select("start", "id", (F.col("__pos") - F.col("pos") + hops).alias("hops"))
    new = at.join(joins, "head").groupBy("start", F.col("to").alias("head")).agg(F.min(F.col("size") - F.col("pos") + hops).alias("hops"))
    new = stage(new, "deep")
    known = new
    for _ in _levels(None):
        step = new.join(joins, "head").groupBy("start", F.col("to").alias("head")).agg(F.min(F.col("hops") + F.col("size")).alias("hops"))
        better = step.join(known.select("start", "head", F.col("hops").alias("__had")), ["start", "head"], "left").filter("__had IS NULL OR hops < __had")
        new = stage(better.select("start", "head", "hops"), "deep")
        if new.isEmpty():
            break
        known = stage(known.unionByName(new).groupBy("start", "head").agg(F.min("hops").alias("hops")), "deep")
    entered = known.join(place, "head").select("start", "id", (F.col("hops") + F.col("pos")).alias("hops"))
    return rest.unionByName(entered).groupBy("start", "id").agg(F.min("hops").cast("int").alias("hops"))


def reach(edges: DataFrame, starts: DataFrame, depth: int | None = None, back: bool = False) -> DataFrame:
    """(start, id, hops) of all that each start reaches by one edge or more; itself only on a cycle.

    What is near comes level by level; beyond SHALLOW levels, paths without branches count as one step."""
    e = stage(edges.select(F.col("to" if back else "from").alias("u"), F.col("from" if back else "to").alias("v")).distinct(), "reach-edges")
    level = starts.select(F.col("id").alias("start"), F.col("id").alias("u")).distinct()
    out = None
    for hops in _levels(depth):
        if depth is None and hops > SHALLOW:
            far = _deep(e, level, hops - 1).join(out.select("start", "id"), ["start", "id"], "left_anti")
            return stage(out.unionByName(far.select("start", "id", "hops")), "reach")
        nxt = level.join(e, "u").select("start", F.col("v").alias("u")).distinct()
        if out is not None:
            nxt = nxt.join(out.select("start", F.col("id").alias("u")), ["start", "u"], "left_anti")
        level = stage(nxt.select("start", "u"), "reach")
        new = level.select("start", F.col("u").alias("id"), F.lit(hops).alias("hops"))
        if level.isEmpty():
            return new if out is None else out
        out = new if out is None else _with(out, new, hops, "reach")
    return out


def ancestors(edges: DataFrame, starts: DataFrame) -> DataFrame:
    return reach(edges, starts, back=True)


def descendants(edges: DataFrame, starts: DataFrame) -> DataFrame:
    return reach(edges, starts)


def trace_lineage(edges: DataFrame, pairs: DataFrame, depth: int | None = None) -> DataFrame:
    """(source, target, path, edge_seqs, weight): a path of fewest edges; of several, that whose edges
    were entered first.  A pair of equal ends has the path of one node.

    A search back from the targets tells how far each node is from them; from a node the path goes on by the
    first edge to one that is nearer by one.  These pointers are followed from the sources by doubling, so
    no path travels through a search; it is put together at the end."""
    wanted = stage(pairs.select("source", "target").distinct(), "lineage-pairs")
    ends = wanted.filter("source != target").select(F.col("target").alias("id")).distinct()
    back = reach(edges, ends, depth, back=True).filter("id != start").select(F.col("start").alias("target"), "id", F.col("hops").alias("left"))
    near = stage(ends.select(F.col("id").alias("target"), "id", F.lit(0).alias("left")).unionByName(back), "lineage-near")
    e = edges.groupBy("from", "to").agg(F.min("edge_seq").alias("edge_seq"), F.min_by("weight", "edge_seq").alias("weight"))
    here, there = near.select("target", F.col("id").alias("from"), "left"), near.select("target", F.col("id").alias("to"), (F.col("left") + 1).alias("left"))
    on = e.join(there, "to").join(here, ["target", "from", "left"])
    first = on.groupBy("target", "from").agg(F.min_by(F.struct("to", "edge_seq", "weight"), "edge_seq").alias("e")).select("target", "from", "e.*")
    first = stage(first, "lineage-next")
    node = lambda c: F.struct(F.col("target").alias("target"), F.col(c).alias("id"))
    starts = wanted.filter("source != target").join(near.select("target", F.col("id").alias("source")), ["target", "source"], "left_semi").select(node("source").alias("id"))
    chain = follow_chain(first.select(node("from").alias("from"), node("to").alias("to"), F.col("edge_seq").alias("to_sequence")), starts)
    steps = chain.join(first.select(node("from").alias("id"), "edge_seq", "weight"), "id", "left")
    rows = steps.groupBy("start").agg(F.sort_array(F.collect_list(F.struct("step", F.col("id.id").alias("node"), "edge_seq", "weight"))).alias("s"))
    edge = F.filter("s", lambda x: x["edge_seq"].isNotNull())
    weight = F.aggregate(edge, F.lit(0.0), lambda w, x: w + x["weight"]).alias("weight")
    found = rows.select(F.col("start.id").alias("source"), F.col("start.target").alias("target"), F.col("s.node").alias("path"), edge["edge_seq"].alias("edge_seqs"), weight)
    same = wanted.filter("source = target").select("source", "target", F.array("source").alias("path"), F.array().cast("array<long>").alias("edge_seqs"), F.lit(0.0).alias("weight"))
    return found.unionByName(same)


def causal_influence(lineage: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, target, path_length, confidence, edge_kinds): kinds of the path's edges, in its order."""
    n = F.size("path")
    ends = lineage.select("source", "target", n.cast("long").alias("path_length"), (1 / (1 + 0.15 * n)).alias("confidence"))
    each = lineage.select("source", "target", F.posexplode("edge_seqs").alias("at", "edge_seq"))
    known = each.join(edges.select("edge_seq", "kind"), "edge_seq").groupBy("source", "target").agg(F.sort_array(F.collect_list(F.struct("at", "kind"))).alias("k"))
    kinds = F.coalesce(F.col("k.kind"), F.array().cast("array<string>")).alias("edge_kinds")
    return ends.join(known, ["source", "target"], "left").select(*ends.columns, kinds)


def get_node(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes of some ids; of a node added several times one row."""
    return nodes.join(ids.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])


def out_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges that leave some nodes, parallel ones all."""
    return edges.join(ids.select(F.col("id").alias("from")).distinct(), "from", "left_semi")


def in_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return edges.join(ids.select(F.col("id").alias("to")).distinct(), "to", "left_semi")


def degree(edges: DataFrame, by: str) -> DataFrame:
    return edges.groupBy(F.col(by).alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def _ends(nodes: DataFrame, edges: DataFrame, side: str) -> DataFrame:
    """Nodes that are at no edge's `side`: ids meet in partitions of bounded size and are counted there, unsorted."""
    at = edges.select(F.col(side).alias("id"), F.lit(False).alias("__own")).filter("id IS NOT NULL")
    met = nodes.select("id", F.lit(True).alias("__own")).unionByName(at)
    return met.repartition(pieces(edges), "id").groupBy("id").agg(F.every("__own").alias("__own")).filter("__own").select("id")


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return _ends(nodes, edges, "to")


def leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return _ends(nodes, edges, "from")


def all_paths(edges: DataFrame, pairs: DataFrame, max_depth: int) -> DataFrame:
    """(source, target, path) of simple paths of at most max_depth nodes; parallel edges repeat them.

    A pass back from the targets tells how many edges each node is away from them; a path is only carried on
    to nodes from which its target can be reached in the steps that are left.  Each target has its own edges
    that lead to it, and paths meet those alone: a node with many edges, most of them to elsewhere, costs nothing."""
    level = stage(pairs.select("source", "target", F.array("source").alias("path")), "paths")
    done = level.filter("source = target")
    level = level.filter("source != target")
    ends = level.select(F.col("target").alias("id")).distinct()
    near = ends.select(F.col("id").alias("target"), F.col("id").alias("to"), F.lit(0).alias("left"))
    if max_depth > 2:
        back = reach(edges, ends, max_depth - 2, back=True).filter("id != start")
        near = near.unionByName(back.select(F.col("start").alias("target"), F.col("id").alias("to"), F.col("hops").alias("left")))
    on = stage(near.join(edges.select("from", "to"), "to").select("target", "from", "to", "left"), "paths-on")
    for step in range(1, max_depth):
        nxt = level.withColumn("from", F.element_at("path", -1)).join(on, ["target", "from"])
        alive = nxt.filter(~F.array_contains("path", F.col("to"))).filter(F.col("left") <= max_depth - 1 - step)
        level = stage(alive.select("source", "target", F.concat("path", F.array("to")).alias("path")), "paths")
        done = done.unionByName(level.filter(F.element_at("path", -1) == F.col("target")))
        level = level.filter(F.element_at("path", -1) != F.col("target"))
        if level.isEmpty():
            break
    return done


def subgraph(edges: DataFrame, starts: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """Nodes within depth hops of the starts, and the edges that leave nodes nearer than depth."""
    zero = starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("hops"))
    near = zero.unionByName(reach(edges, starts, depth)).groupBy("start", "id").agg(F.min("hops").alias("hops")) if depth > 0 else zero
    near = stage(near, "subgraph")
    return near, near.filter(F.col("hops") < depth).join(edges, F.col("id") == F.col("from")).drop("id", "hops")


def topological_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, level): nodes whose predecessors all have lower levels; those on or after a cycle are left out."""
    own = stage(nodes.select("id").distinct(), "topo-nodes")
    e = stage(edges.select("from", "to").distinct(), "topo-edges")
    need = stage(e.groupBy(F.col("to").alias("id")).agg(F.count(F.lit(1)).alias("need")).join(own, "id", "left_semi"), "topo-degrees")
    free = stage(own.join(need, "id", "left_anti").select("id", F.lit(0).alias("level")), "topo")
    out, partial = free, None  # partial: nodes some of whose predecessors have levels
    for level in _levels(None):
        got = free.join(e, F.col("id") == F.col("from")).groupBy(F.col("to").alias("id")).agg(F.count(F.lit(1)).alias("got"))
        if partial is not None:
            got = got.unionByName(partial).groupBy("id").agg(F.sum("got").alias("got"))
        met = stage(got.join(need, "id"), "topo-met")
        partial = met.filter("got < need").select("id", "got")
        free = met.filter("got = need").select("id", F.lit(level).alias("level"))
        if free.isEmpty():
            return out
        out = _with(out, free, level, "topo")
    return out


def graph_signature(nodes: DataFrame, edges: DataFrame, by: str) -> DataFrame:
    """(by, signature): first 16 hex digits of a hash over sorted node ids and edges in their order."""
    keys = nodes.select(F.col(by).alias("by")).distinct()
    zero, none = F.lit(0).cast("long"), F.lit("")
    ids = nodes.select(F.col(by).alias("by"), F.lit(0).alias("part"), zero.alias("edge_seq"), F.col("id").alias("a"), none.alias("b"), F.col("id").alias("text")).distinct()
    bar = keys.select("by", F.lit(1).alias("part"), zero.alias("edge_seq"), none.alias("a"), none.alias("b"), F.lit("|").alias("text"))
    own = edges.select(F.col(by).alias("by"), F.lit(2).alias("part"), "edge_seq", F.col("from").alias("a"), F.col("to").alias("b"), F.concat("from", F.lit(">"), "to").alias("text"))
    rows = ids.unionByName(bar).unionByName(own.join(keys, "by", "left_semi"))
    return folded_hash(rows, "by", "part", ["edge_seq", "a", "b"], ",").select(F.col("by").alias(by), F.substring("hash", 1, 16).alias("signature"))


def edges_to_events(edges: DataFrame, session_id: str) -> DataFrame:
    payload = F.to_json(F.struct("from", "to", "kind", "weight"))
    return edges.select(F.concat(F.lit("prov-"), F.col("from"), F.lit("-"), F.col("to")).alias("event_id"), F.lit(session_id).alias("session_id"), F.lit(0).cast("long").alias("sequence"), F.concat(F.lit("provenance."), F.col("kind")).alias("kind"), payload.alias("payload"), F.lit("").alias("current_hash"))


def graph_size(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.agg(F.countDistinct("id").alias("nodes")).join(F.broadcast(edges.agg(F.count(F.lit(1)).alias("edges"))))  # one row each
