"""Paths over the segment graph and the rail graph, as rounds of joins over a whole frontier.

All pairs advance together: a round joins the frontier to the links, keeps the best value
per (pair, node) and cuts the lineage in the shared checkpoint folder. The driver only sees
the size of the next frontier.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ballast.functions.geo import haversine_m, segment_id
from ballast.functions.text import norm_compact
from ballast.operators.aggregates import edge_cover, pair_edges
from ballast.operators.joins import refine, to_edges
from ballast.operators.sequence_tools import beside, running_total
from ballast.session import cut_lineage

EPSILON_M = 1e-9


def rows_on_paths(tree: DataFrame, ends: DataFrame, key: str) -> DataFrame:
    """The rows of trees (key, node, pred, n and more; roots have no pred) that lie between the roots and the ends (key, node).

    By doubling: each round adds the ancestors twice as far away, so paths of n links take log2(n) rounds.
    """
    own = cut_lineage(tree.join(ends.select(key).distinct(), key, "left_semi"))
    jump = own.filter(F.col("pred").isNotNull()).select(key, "node", "pred")
    marked = cut_lineage(ends.select(key, "node"))
    most, reach = own.agg(F.max("n")).first()[0] or 0, 1
    while reach <= most:
        further = marked.join(jump, [key, "node"]).select(key, F.col("pred").alias("node"))
        marked = cut_lineage(marked.unionByName(further))
        reach *= 2
        if reach <= most:
            onward = jump.select(key, F.col("node").alias("pred"), F.col("pred").alias("_to"))
            jump = cut_lineage(jump.join(onward, [key, "pred"]).select(key, "node", F.col("_to").alias("pred")))
    return own.join(marked, [key, "node"])


#: Rounds after which the rows of all rounds so far are written as one table.
ROUNDS_A_TABLE = 8


def relax_paths(pairs: DataFrame, starts: DataFrame, links: DataFrame, exits: DataFrame,
                max_rounds: int | None = None) -> DataFrame:
    """Cheapest path of each pair: pair, total, node (the exit taken), n (its place on the path, from 0) and tag, a row for its start and each link.

    pairs: pair, goal_lat, goal_lon, cap (greatest total allowed) and w_max (links must be
    shorter; NULL for any). starts: pair, node, g, tag. links: u, v, w, v_lat, v_lon, tag.
    exits: pair, node, exit_w. Partial paths that cannot end within the cap, or within the
    best total found so far, are dropped. Equal totals take fewer links, then the first tag at the last link that differs.

    A node's state is its total, its number of links and the link it was reached by. A round writes the nodes that
    it improves, no others; paths are read off the links at the end.
    """
    state = F.struct("g", "n", "tag", "pred")
    delta = cut_lineage(starts.select("pair", "node", "g", F.lit(0).alias("n"), "tag", F.lit(None).cast(starts.schema["node"].dataType).alias("pred")))
    rounds = [delta]
    for number in count(1) if max_rounds is None else range(1, max_rounds + 1):
        known = reduce(DataFrame.unionByName, rounds)
        if len(rounds) > ROUNDS_A_TABLE:
            # The last word on a node is its least state: a round adds none that is not less.
            rounds = [cut_lineage(known.groupBy("pair", "node").agg(F.min(state).alias("s")).select("pair", "node", "s.*"))]
            known = rounds[0]
        ends = known.join(exits, ["pair", "node"]).groupBy("pair").agg(F.min(F.col("g") + F.col("exit_w")).alias("_done"))
        frontier = delta.join(ends, "pair", "left").join(pairs, "pair").filter(F.col("_done").isNull() | (F.col("g") < F.col("_done")))
        ahead = frontier.select(
            "pair", F.col("node").alias("u"), F.col("g").alias("_g"), F.col("n").alias("_n"), "_done", "goal_lat", "goal_lon", "cap", "w_max",
        ).join(links, "u").filter(F.col("w_max").isNull() | (F.col("w") < F.col("w_max")))
        remaining = haversine_m(F.col("v_lat"), F.col("v_lon"), F.col("goal_lat"), F.col("goal_lon"))
        ahead = ahead.withColumn("_reach", F.col("_g") + F.col("w")).filter(F.col("_reach") + remaining <= F.col("cap"))
        ahead = ahead.filter(F.col("_done").isNull() | (F.col("_reach") <= F.col("_done")))
        best = ahead.groupBy("pair", F.col("v").alias("node")).agg(
            F.min(F.struct(F.col("_reach").alias("g"), (F.col("_n") + 1).alias("n"), F.col("tag"), F.col("u").alias("pred"))).alias("b"))
        held = known.groupBy("pair", "node").agg(F.min(state).alias("s"))
        met = best.join(held, ["pair", "node"], "left")
        better = F.col("s").isNull() | (F.col("b.g") < F.col("s.g") - EPSILON_M) | (
            (F.col("b.g") <= F.col("s.g")) & (F.struct("b.g", "b.n", "b.tag") < F.struct("s.g", "s.n", "s.tag")))
        delta = cut_lineage(met.filter(better).select("pair", "node", "b.*"))
        if delta.isEmpty():
            break
        rounds.append(delta)
    tree = cut_lineage(reduce(DataFrame.unionByName, rounds).groupBy("pair", "node").agg(F.min(state).alias("s")).select("pair", "node", "s.*"))
    done = tree.join(exits, ["pair", "node"]).select("pair", "node", "n", (F.col("g") + F.col("exit_w")).alias("total"))
    best = done.groupBy("pair").agg(F.min(F.struct("total", "n", "node")).alias("b")).select("pair", "b.total", "b.node")
    best = cut_lineage(best)
    path = rows_on_paths(tree, best, "pair").select("pair", "n", "tag")
    return path.join(best, "pair").select("pair", "total", "node", "n", "tag")


def segment_lengths(segments: DataFrame, coords: DataFrame) -> DataFrame:
    """Segments whose ends both have coordinates, with length (at least a metre) and end points."""
    at = coords.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select("cluster_id", "lat", "lon")
    both = segments.select("a", "b", "segment").join(at.toDF("a", "a_lat", "a_lon"), "a").join(at.toDF("b", "b_lat", "b_lon"), "b")
    metres = haversine_m(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    return both.withColumn("w", F.greatest(metres, F.lit(1.0)))


def refinement_paths(segments: DataFrame, coords: DataFrame, alpha: float = 1.3, slack_m: float = 3000.0,
                     min_m: float = 8000.0) -> DataFrame:
    """Express segments replaced by the shortest chain of strictly shorter ones: segment, pos, link."""
    sized = cut_lineage(segment_lengths(segments, coords))
    links = sized.select(F.col("a").alias("u"), F.col("b").alias("v"), "w", F.col("b_lat").alias("v_lat"),
                         F.col("b_lon").alias("v_lon"), F.col("segment").alias("tag"))
    links = links.unionByName(sized.select(F.col("b").alias("u"), F.col("a").alias("v"), "w", F.col("a_lat").alias("v_lat"),
                                           F.col("a_lon").alias("v_lon"), F.col("segment").alias("tag")))
    long_ones = sized.filter(F.col("w") >= min_m)
    pairs = long_ones.select(F.col("segment").alias("pair"), F.col("b_lat").alias("goal_lat"), F.col("b_lon").alias("goal_lon"),
                             (F.col("w") * alpha + slack_m).alias("cap"), F.col("w").alias("w_max"))
    starts = long_ones.select(F.col("segment").alias("pair"), F.col("a").alias("node"), F.lit(0.0).alias("g"), F.lit(None).cast("string").alias("tag"))
    exits = long_ones.select(F.col("segment").alias("pair"), F.col("b").alias("node"), F.lit(0.0).alias("exit_w"))
    found = cut_lineage(relax_paths(pairs, starts, links, exits))
    chains = found.groupBy("pair").agg(F.max("n").alias("last")).filter("last >= 2").select("pair")
    return found.filter("n > 0").join(chains, "pair", "left_semi").select(F.col("pair").alias("segment"), (F.col("n") - 1).alias("pos"), F.col("tag").alias("link"))


def expand_leaves(paths: DataFrame, lengths: DataFrame) -> DataFrame:
    """Refinement down to segments that have none themselves, with length shares adding up to one."""
    parts = paths.select(F.col("segment").alias("link"), F.col("pos").alias("_pos"), F.col("link").alias("_part"))
    state = cut_lineage(paths.select(F.col("segment").alias("coarse"), "link", F.array("pos").alias("trail"), F.lit(True).alias("open")))
    while True:
        opened = state.filter("open").join(parts, "link", "left")
        deeper = opened.select(
            "coarse", F.coalesce("_part", "link").alias("link"),
            F.when(F.col("_part").isNotNull(), F.concat("trail", F.array("_pos"))).otherwise(F.col("trail")).alias("trail"),
            F.col("_part").isNotNull().alias("open"),
        )
        state = cut_lineage(state.filter(~F.col("open")).unionByName(deeper))
        if state.filter("open").isEmpty():
            break
    sized = state.join(lengths.select(F.col("segment").alias("link"), "w"), "link")
    whole = Window.partitionBy("coarse")
    order = F.row_number().over(whole.orderBy("trail")) - 1
    return sized.select("coarse", F.col("link").alias("fine"), (F.col("w") / F.sum("w").over(whole)).alias("fraction"),
                        order.cast("int").alias("ord"))


def leaf_graph(refinement: DataFrame, segment_edges: DataFrame) -> DataFrame:
    """Directed links u, v between clusters joined by a drawn or a leaf segment."""
    names = segment_edges.select("segment").union(refinement.select("fine")).distinct()
    ends = F.split("segment", r"\|")
    pairs = names.select(ends[0].alias("u"), ends[1].alias("v")).filter(F.col("u") != F.col("v"))
    return pairs.union(pairs.select("v", "u")).distinct()


def bfs_paths(pairs: DataFrame, graph: DataFrame, max_hops: int | None = None) -> DataFrame:
    """Path with fewest links per pair of clusters: pair_id, pos, segment; equal ones take the lower predecessor."""
    goals = cut_lineage(pairs.select("pair_id", "a", "b").filter(F.col("a") != F.col("b")))
    links = cut_lineage(graph)
    node = goals.schema["a"].dataType
    frontier = cut_lineage(goals.select(F.col("a").alias("start"), F.col("a").alias("node")).distinct().select(
        "start", "node", F.lit(None).cast(node).alias("pred"), F.lit(0).alias("n")))
    seen = frontier
    for hop in count(1) if max_hops is None else range(1, max_hops + 1):
        # starts with every goal reached stop growing
        open_goals = goals.join(seen.select(F.col("start").alias("a"), F.col("node").alias("b")), ["a", "b"], "left_anti")
        growing = frontier.join(open_goals.select(F.col("a").alias("start")).distinct(), "start", "left_semi")
        step = growing.select("start", F.col("node").alias("u")).join(links, "u").groupBy("start", F.col("v").alias("node")).agg(F.min("u").alias("pred"))
        frontier = cut_lineage(step.join(seen, ["start", "node"], "left_anti").withColumn("n", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if hop % ROUNDS_A_TABLE == 0:
            seen = cut_lineage(seen)
    reached = goals.join(seen.select(F.col("start").alias("a"), F.col("node").alias("b")), ["a", "b"])
    trees = seen.select(F.col("start").alias("a"), "node", "pred", "n").join(reached.select("a", "pair_id"), "a")
    path = rows_on_paths(trees, reached.select("pair_id", F.col("b").alias("node")), "pair_id").filter("n > 0")
    return path.select("pair_id", (F.col("n") - 1).alias("pos"), segment_id(F.col("pred"), F.col("node")).alias("segment"))


def chain_edges(chains: DataFrame, refinement: DataFrame, segment_edges: DataFrame,
                max_hops: int | None = None) -> dict[str, DataFrame]:
    """Edges under chains of clusters (chain_id, pos, cluster), and the pairs no edge is known for.

    Pairs map over their refinement; only those that find no edge are bridged over the leaf graph.
    """
    paired = beside(chains, ["chain_id"], ["pos"], ["cluster"])
    links = paired.filter(F.col("next_cluster").isNotNull() & (F.col("cluster") != F.col("next_cluster"))).select(
        "chain_id", F.col("cluster").alias("a"), F.col("next_cluster").alias("b"),
        segment_id(F.col("cluster"), F.col("next_cluster")).alias("segment"))
    links = cut_lineage(links)
    direct = pair_edges(links.select("segment").distinct(), refinement, segment_edges)
    missing = links.join(direct, "segment", "left_anti")
    bridge_pairs = missing.select(F.concat_ws(">", "a", "b").alias("pair_id"), "a", "b").distinct()
    paths = bfs_paths(bridge_pairs, leaf_graph(refinement, segment_edges), max_hops)
    bridged = to_edges(paths, segment_edges).select("pair_id", "edge").distinct()
    over = missing.withColumn("pair_id", F.concat_ws(">", "a", "b"))
    edges = links.join(direct, "segment").select("chain_id", "edge").union(over.join(bridged, "pair_id").select("chain_id", "edge"))
    unmapped = over.join(bridged, "pair_id", "left_anti").select("chain_id", "segment")
    return {"edges": edges.distinct(), "unmapped": unmapped.distinct()}


def expand_by_path(pairs: DataFrame, paths: DataFrame, dictionary: DataFrame, refinement: DataFrame,
                   segment_edges: DataFrame) -> DataFrame:
    """Fine segments between two observed stops of a train: head, cluster, next_cluster, fine, fraction, ord.

    A pair with a refinement or an edge of its own keeps it. Another one follows the train's
    planned path (head, pos, name) between the first places of both ends, skipping unknown
    names, each link weighing the same; without such a path it stays one segment.
    """
    key = ["head", "cluster", "next_cluster"]
    wanted = pairs.select(*key).distinct().withColumn("segment", segment_id(F.col("cluster"), F.col("next_cluster")))
    known = refinement.select(F.col("coarse").alias("segment")).union(segment_edges.select("segment")).distinct()
    open_pairs = wanted.join(known, "segment", "left_anti")
    names = dictionary.select("name_key", F.col("cluster_id").alias("at"))
    places = paths.withColumn("name_key", norm_compact(F.col("name"))).join(names, "name_key").select("head", "pos", "at")
    ends = open_pairs.join(places, "head").groupBy(*key, "segment").agg(
        F.min(F.when(F.col("at") == F.col("cluster"), F.col("pos"))).alias("p"),
        F.min(F.when(F.col("at") == F.col("next_cluster"), F.col("pos"))).alias("q"),
    ).filter(F.col("p").isNotNull() & F.col("q").isNotNull())
    lo, hi = F.least("p", "q"), F.greatest("p", "q")
    inside = ends.join(places, "head").filter(F.col("pos").between(lo, hi))
    steps = beside(inside, key, ["pos"], ["at"])
    moves = steps.filter(F.col("next_at").isNotNull() & (F.col("at") != F.col("next_at")))
    counted = moves.groupBy(*key).agg(F.count("*").alias("n_links")).filter(F.col("n_links") >= 2)
    walked = moves.join(counted, key).withColumn("_link", segment_id(F.col("at"), F.col("next_at")))
    parts = refine(walked.select(*key, "pos", "n_links", "_link"), refinement, on="_link")
    expanded = parts.select(*key, "fine", (F.col("fraction") / F.col("n_links")).alias("fraction"),
                            F.struct(F.col("pos").cast("int").alias("step"), F.col("ord").cast("int").alias("part")).alias("_place"))
    along = Window.partitionBy(*key).orderBy("_place")
    expanded = expanded.select(*key, "fine", "fraction", (F.row_number().over(along) - 1).alias("ord"))
    rest = refine(wanted.join(expanded.select(*key).distinct(), key, "left_anti"), refinement)
    return expanded.unionByName(rest.select(*key, "fine", "fraction", F.col("ord").cast("int").alias("ord")))


def rail_links(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """Ways cut at junctions and missing nodes: link_id, pos, node_id, lat, lon, at_m.

    A way holds at most a few thousand nodes by the rules of its source, so its order is
    handled per way.
    """
    listed = ways.select("way_id", F.size("nodes").alias("_n"), F.posexplode("nodes").alias("seq", "node_id"))
    rim = (F.col("seq") == 0) | (F.col("seq") == F.col("_n") - 1)
    degree = listed.groupBy("node_id").agg(F.sum(F.when(rim, 1).otherwise(2)).alias("_deg"))
    placed = listed.join(degree, "node_id").join(nodes.select("node_id", "lat", "lon"), "node_id", "left")
    along = Window.partitionBy("way_id").orderBy("seq")
    so_far = along.rowsBetween(Window.unboundedPreceding, -1)
    junction, gap = F.col("_deg") != 2, F.col("lat").isNull()
    # a junction ends one link and starts the next; a missing node ends one without
    cuts = placed.withColumn("_cut", (junction | gap).cast("int"))
    cuts = cuts.withColumn("_part", F.coalesce(F.sum("_cut").over(so_far), F.lit(0)))
    inner = cuts.filter(~gap).select("way_id", "_part", "seq", "node_id", "lat", "lon")
    restart = cuts.filter(junction & ~gap & (F.col("seq") < F.col("_n") - 1)).select(
        "way_id", (F.col("_part") + 1).alias("_part"), "seq", "node_id", "lat", "lon")
    pieces = inner.unionByName(restart)
    piece = Window.partitionBy("way_id", "_part").orderBy("seq")
    step = haversine_m(F.lag("lat").over(piece), F.lag("lon").over(piece), F.col("lat"), F.col("lon"))
    sized = pieces.withColumn("_step", F.coalesce(step, F.lit(0.0))).withColumn("_count", F.count("*").over(Window.partitionBy("way_id", "_part")))
    return sized.filter(F.col("_count") > 1).select(
        F.concat_ws(":", "way_id", "_part").alias("link_id"), (F.row_number().over(piece) - 1).alias("pos"),
        "node_id", "lat", "lon", F.sum("_step").over(piece).alias("at_m"))


def link_ends(link_nodes: DataFrame) -> DataFrame:
    """First and last node of each link and its length."""
    first = F.min_by(F.struct("node_id", "lat", "lon"), "pos").alias("f")
    last = F.max_by(F.struct("node_id", "lat", "lon", "at_m"), "pos").alias("l")
    return link_nodes.groupBy("link_id").agg(first, last).select(
        "link_id", F.col("f.node_id").alias("a"), F.col("l.node_id").alias("b"), F.col("l.at_m").alias("length_m"),
        F.col("f.lat").alias("a_lat"), F.col("f.lon").alias("a_lon"), F.col("l.lat").alias("b_lat"), F.col("l.lon").alias("b_lon"))


def route_pairs(pairs: DataFrame, link_nodes: DataFrame, snap: DataFrame, clusters: DataFrame,
                factor: float = 2.2, slack_m: float = 2000.0) -> DataFrame:
    """Track route of each cluster pair (segment, a, b) between snapped nodes: segment, pos, node_id."""
    nodes = cut_lineage(link_nodes)
    ends = cut_lineage(link_ends(nodes))
    at = clusters.filter(F.col("lat").isNotNull()).select("cluster_id", "lat", "lon")
    spot = snap.select("cluster_id", "node_id").join(at, "cluster_id")
    wanted = pairs.select("segment", "a", "b").join(spot.toDF("a", "na", "a_lat", "a_lon"), "a").join(spot.toDF("b", "nb", "b_lat", "b_lon"), "b")
    wanted = wanted.filter(F.col("na") != F.col("nb"))
    # a node inside a link hangs on its ends; a junction belongs to its first link
    hold = nodes.groupBy("node_id").agg(F.min(F.struct("link_id", "pos", "at_m", "lat", "lon")).alias("h")).select("node_id", "h.*")
    hold = hold.join(ends.select("link_id", "a", "b", "length_m"), "link_id")
    stub = hold.select("node_id", "lat", "lon", F.explode(F.array(
        F.struct(F.col("a").alias("end"), F.col("at_m").alias("w"), F.concat(F.lit("<"), "link_id", F.lit("@"), "pos").alias("tag")),
        F.struct(F.col("b").alias("end"), (F.col("length_m") - F.col("at_m")).alias("w"), F.concat(F.lit(">"), "link_id", F.lit("@"), "pos").alias("tag")),
    )).alias("s")).select("node_id", "lat", "lon", "s.end", "s.w", "s.tag")
    goal_at = nodes.select(F.col("node_id").alias("nb"), F.col("lat").alias("goal_lat"), F.col("lon").alias("goal_lon")).dropDuplicates(["nb"])
    direct = haversine_m(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    framed = wanted.join(goal_at, "nb").select(F.col("segment").alias("pair"), "na", "nb", "goal_lat", "goal_lon",
                                               (direct * factor + slack_m).alias("cap"), F.lit(None).cast("double").alias("w_max"))
    framed = cut_lineage(framed)
    onto = framed.join(stub.select(F.col("node_id").alias("na"), F.col("end").alias("node"), F.col("w").alias("g"), "tag"), "na")
    starts = onto.groupBy("pair", "node").agg(F.min(F.struct("g", "tag")).alias("s")).select("pair", "node", "s.g", "s.tag")
    exits = framed.join(stub.select(F.col("node_id").alias("nb"), F.col("end").alias("node"), F.col("w").alias("exit_w"), F.col("tag").alias("exit_tag")), "nb")
    best_exit = exits.groupBy("pair", "node").agg(F.min(F.struct("exit_w", "exit_tag")).alias("e")).select("pair", "node", "e.exit_w", "e.exit_tag")
    links = ends.select(F.col("a").alias("u"), F.col("b").alias("v"), F.col("length_m").alias("w"), F.col("b_lat").alias("v_lat"),
                        F.col("b_lon").alias("v_lon"), F.concat(F.lit("+"), "link_id").alias("tag"))
    links = links.unionByName(ends.select(F.col("b").alias("u"), F.col("a").alias("v"), F.col("length_m").alias("w"), F.col("a_lat").alias("v_lat"),
                                          F.col("a_lon").alias("v_lon"), F.concat(F.lit("-"), "link_id").alias("tag")))
    bare = framed.select("pair", "goal_lat", "goal_lon", "cap", "w_max")
    found = relax_paths(bare, starts, links, best_exit.select("pair", "node", "exit_w")).join(framed.select("pair", "cap"), "pair")
    found = cut_lineage(found.filter(F.col("total") <= F.col("cap")))
    leave = found.groupBy("pair", "node").agg((F.max("n") + 1).alias("step")).join(best_exit.select("pair", "node", "exit_tag"), ["pair", "node"])
    tagged = found.select("pair", F.col("n").alias("step"), "tag").unionByName(leave.select("pair", "step", F.concat(F.lit("!"), "exit_tag").alias("tag")))
    # read the nodes of each step off its link: whole, from a start stub, or towards an exit stub
    leaving = F.startswith(F.col("tag"), F.lit("!"))
    bare_tag = F.regexp_replace("tag", "^!", "")
    kind = F.substring(bare_tag, 1, 1)
    parsed = tagged.select("pair", "step", leaving.alias("leaving"), kind.alias("kind"),
                           F.split(F.expr("substring(regexp_replace(tag, '^!', ''), 2)"), "@").alias("x"))
    parsed = parsed.select("pair", "step", "leaving", "kind", F.col("x")[0].alias("link_id"), F.get(F.col("x"), 1).cast("int").alias("cut"))
    walked = parsed.join(nodes.select("link_id", "pos", "node_id"), "link_id")
    part = F.when(F.col("kind") == "<", F.col("pos") <= F.col("cut")).when(F.col("kind") == ">", F.col("pos") >= F.col("cut")).otherwise(F.lit(True))
    backwards = F.when(F.col("kind") == "-", F.lit(True)).when(F.col("kind") == "+", F.lit(False)).otherwise((F.col("kind") == "<") != F.col("leaving"))
    rows = walked.filter(part).withColumn("_i", F.when(backwards, -F.col("pos")).otherwise(F.col("pos")))
    fresh = beside(rows.select("pair", "step", "_i", "node_id"), ["pair"], ["step", "_i"], ["node_id"], forward=False)
    fresh = fresh.filter(F.col("prev_node_id").isNull() | (F.col("prev_node_id") != F.col("node_id")))
    numbered = running_total(fresh, ["pair"], ["step", "_i"], F.lit(1), None, "_n")
    return numbered.select(F.col("pair").alias("segment"), (F.col("_n") - 1).cast("int").alias("pos"), "node_id")


def _chain_positions(arcs: DataFrame) -> DataFrame:
    """For arcs (src, dst, nsrc, ndst): the last arc of their chain (tsrc, tdst) and steps to it.

    Pointer doubling: each round every unfinished arc jumps to where its target had jumped, so
    a chain of n arcs takes log2(n) rounds. Arcs still unfinished then lie on closed loops,
    which are opened at their lowest node and run once more.
    """
    def double(start: DataFrame) -> DataFrame:
        state, rounds, size = cut_lineage(start), 0, start.count()
        while True:
            open_arcs = state.filter(~F.col("done"))
            if rounds > size.bit_length() or open_arcs.isEmpty():
                return state
            target = state.select(F.col("src").alias("psrc"), F.col("dst").alias("pdst"), F.col("psrc").alias("_s"), F.col("pdst").alias("_d"),
                                  F.col("steps").alias("_n"), F.col("done").alias("_done"), F.col("low").alias("_low"))
            jumped = open_arcs.join(target, ["psrc", "pdst"]).select(
                "src", "dst", F.col("_s").alias("psrc"), F.col("_d").alias("pdst"), (F.col("steps") + F.col("_n")).alias("steps"),
                F.col("_done").alias("done"), F.least("low", "_low").alias("low"))
            state, rounds = cut_lineage(state.filter("done").unionByName(jumped)), rounds + 1

    last = F.col("ndst").isNull()
    start = arcs.select("src", "dst", F.when(last, F.col("src")).otherwise(F.col("nsrc")).alias("psrc"),
                        F.when(last, F.col("dst")).otherwise(F.col("ndst")).alias("pdst"),
                        F.when(last, 0).otherwise(1).cast("bigint").alias("steps"), last.alias("done"), F.least("src", "dst").alias("low"))
    ranked = double(start)
    loops = ranked.filter(~F.col("done")).select("src", "dst", "low")
    if loops.isEmpty():
        return ranked
    cut = F.col("dst") == F.col("low")
    again = loops.join(arcs.select("src", "dst", "nsrc", "ndst"), ["src", "dst"]).select(
        "src", "dst", F.when(cut, F.col("src")).otherwise(F.col("nsrc")).alias("psrc"), F.when(cut, F.col("dst")).otherwise(F.col("ndst")).alias("pdst"),
        F.when(cut, 0).otherwise(1).cast("bigint").alias("steps"), cut.alias("done"), "low")
    return ranked.filter("done").unionByName(double(again))


def dissolve(node_paths: DataFrame) -> dict[str, DataFrame]:
    """Drawn edges: longest stretches of track that exactly the same segments run over.

    node_paths: segment, pos, node_id. Returns edge, pos, node_id and edge, segment.
    """
    cover = cut_lineage(edge_cover(node_paths))
    both = F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("to")), F.struct(F.col("v").alias("node"), F.col("u").alias("to"))))
    incident = cover.select(both.alias("x"), "segment").select("x.*", "segment")
    # inside a stretch a node has two neighbours and each segment at it uses both
    used = incident.groupBy("node", "segment").agg(F.count("*").alias("_c")).groupBy("node").agg(F.min("_c").alias("_c"))
    arcs = incident.select(F.col("node").alias("src"), F.col("to").alias("dst")).distinct()
    degree = arcs.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("_d"))
    inner = degree.join(used, "node").filter((F.col("_d") == 2) & (F.col("_c") == 2)).select("node")
    onward = arcs.join(inner.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("src").alias("dst"), F.col("dst").alias("ndst"))
    nexts = arcs.join(onward, "dst").filter(F.col("ndst") != F.col("src")).select("src", "dst", F.col("dst").alias("nsrc"), "ndst")
    linked = cut_lineage(arcs.join(nexts, ["src", "dst"], "left"))
    ranked = cut_lineage(_chain_positions(linked))
    # of the two directions keep the one running from the lower end to the higher one
    reverse = ranked.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("psrc").alias("rsrc"), F.col("pdst").alias("rdst"),
                            F.col("steps").alias("before"))
    run = ranked.join(reverse, ["src", "dst"])
    lower = (F.col("pdst") > F.col("rdst")) | ((F.col("pdst") == F.col("rdst")) & (F.col("psrc") > F.col("rsrc")))
    kept = run.filter(lower)
    ends = kept.select("psrc", "pdst", "rsrc", "rdst").distinct()
    base = F.concat(F.lit("E"), F.least("pdst", "rdst"), F.lit("-"), F.greatest("pdst", "rdst"))
    order = Window.partitionBy("_base").orderBy(F.least("psrc", "rsrc"), F.greatest("psrc", "rsrc"))
    named = ends.withColumn("_base", base).withColumn("_no", F.row_number().over(order))
    edge = F.when(F.col("_no") == 1, F.col("_base")).otherwise(F.concat("_base", F.lit("-"), "_no"))
    named = named.select("psrc", "pdst", "rsrc", "rdst", edge.alias("edge"))
    placed = cut_lineage(kept.join(named, ["psrc", "pdst", "rsrc", "rdst"]).select("edge", "src", "dst", "before", "steps"))
    heads = placed.select("edge", F.col("before").cast("int").alias("pos"), F.col("src").alias("node_id"))
    tails = placed.filter(F.col("steps") == 0).select("edge", (F.col("before") + 1).cast("int").alias("pos"), F.col("dst").alias("node_id"))
    sample = placed.filter(F.col("before") == 0).select("edge", F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"))
    return {"geometry": heads.unionByName(tails), "coverage": cover.join(sample, ["u", "v"]).select("edge", "segment")}
