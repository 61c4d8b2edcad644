"""Centrality and communities of weighted graphs, by rounds of joins and aggregations.

A graph is a table of undirected edges (a, b, weight), as ``retrieval.cooccurrence`` gives it. Every round is written to the checkpoint folder and the one
before it removed, so plans stay as long as one round. A vertex of many edges is no hot key: its edges are cut into parts of about
``PART`` edges by the hash of their other ends, and its row is repeated for each part; sums are combined before they are shuffled.

Defined results: edges with a null end, without a positive weight or from a vertex to itself are left out; edges given twice, or in both
directions, add up; a vertex without edges is not known; an empty graph gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.durable import BROADCAST_KEYS, durable, forget, small

#: Edges of one vertex that are joined in one task, about.
PART = 10_000
#: Gains below this are none.
LEAST_GAIN = 1e-12
#: Vertices and communities that are compared in one task, about, memberships that these have, and contexts of a vertex that are added up at once.
VERTICES, COMMUNITIES, MEMBERS, AT_ONCE = 8192, 16_384, 1 << 20, 256
_NEAR = pa.schema([("v", pa.int64()), ("c", pa.int64()), ("near", pa.float64())])


def both_ways(edges: DataFrame) -> DataFrame:
    """(v, u, w): every edge from both of its ends."""
    good = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b AND weight > 0").select("a", "b", F.col("weight").cast("double").alias("w"))
    return good.select(F.col("a").alias("v"), F.col("b").alias("u"), "w").unionByName(good.select(F.col("b").alias("v"), F.col("a").alias("u"), "w")).groupBy("v", "u").agg(F.sum("w").alias("w"))


def _cut(links: DataFrame, end: str) -> tuple[DataFrame, DataFrame]:
    """``links`` with ``part``, that of the edges at ``end`` which a link is in, and (x, parts) of the vertices of more than one part."""
    many = durable(links.groupBy(F.col(end).alias("x")).agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")).where("parts > 1"))
    other = "u" if end == "v" else "v"
    joined = links.join(many, links[end] == many["x"], "left").withColumn("part", F.pmod(F.xxhash64(other), F.coalesce("parts", F.lit(1))).cast("int")).drop("x", "parts")
    return joined, many


def _spread(values: DataFrame, vertex: str, many: DataFrame) -> DataFrame:
    """``values`` with ``part``: each row once for every part of its vertex."""
    joined = values.join(many, values[vertex] == many["x"], "left")
    return joined.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("x", "parts")


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 50, tolerance: float = 1e-9) -> DataFrame:
    """(entity, rank): the stationary shares of a walk that follows edges by their weights with probability ``damping`` and else begins anew
    anywhere. Stops after ``rounds``, or when all shares together move by less than ``tolerance``. Ranks sum to 1."""
    links = durable(both_ways(edges))
    strength = links.groupBy("v").agg(F.sum("w").alias("strength"))
    n = strength.count()
    shares, many = _cut(links.join(strength, "v").select("v", "u", (F.col("w") / F.col("strength")).alias("share")), "v")
    shares = durable(shares)
    now = durable(strength.select("v", F.lit(1.0 / max(n, 1)).alias("rank")))
    for _ in range(rounds if n else 0):
        flow = shares.join(_spread(now, "v", many), ["v", "part"]).groupBy(F.col("u").alias("v")).agg(F.sum(F.col("rank") * F.col("share")).alias("flow"))
        after = durable(now.join(flow, "v", "left").select("v", ((1 - damping) / n + damping * F.coalesce("flow", F.lit(0.0))).alias("rank"), F.col("rank").alias("before")))
        forget(now)
        now = after
        if now.agg(F.sum(F.abs(F.col("rank") - F.col("before")))).first()[0] < tolerance:
            break
    forget(links, shares)
    return now.select(F.col("v").alias("entity"), "rank")


def memberships(mentions: DataFrame, context: str, entity: str) -> DataFrame:
    """(v, u, size): each entity once for every context it is named in, with the number of that context's entities. Rows with a null, and contexts of one
    entity, which link nothing, are left out."""
    own = durable(mentions.select(F.col(entity).alias("v"), F.col(context).alias("u")).where("v IS NOT NULL AND u IS NOT NULL").distinct())
    sizes = durable(own.groupBy("u").agg(F.count("*").alias("size")).where("size > 1"))
    return own.join(small(sizes), "u").select("v", "u", "size")


def pagerank_of_contexts(mentions: DataFrame, context: str, entity: str, damping: float = 0.85, rounds: int = 50, tolerance: float = 1e-9) -> DataFrame:
    """``pagerank`` of the edges that ``retrieval.cooccurrence`` gives, without making them: what flows between two entities flows through their contexts. An
    entity gets what all members of its contexts put in, less what it has put in itself, so that a round takes as many steps as there are memberships, not pairs."""
    links = durable(memberships(mentions, context, entity))
    strength = durable(links.groupBy("v").agg(F.sum(F.col("size") - 1).alias("strength"), F.count("*").alias("degree")))
    n = strength.count()
    (out, of_many), (back, in_many) = _cut(links.select("v", "u"), "v"), _cut(links.select("v", "u"), "u")
    out, back = durable(out), durable(back)
    now = durable(strength.select("*", F.lit(1.0 / max(n, 1)).alias("rank")))
    for _ in range(rounds if n else 0):
        share = now.select("v", (F.col("rank") / F.col("strength")).alias("share"))
        held = durable(out.join(small(_spread(share, "v", of_many)), ["v", "part"]).groupBy("u").agg(F.sum("share").alias("held")))
        flow = back.join(small(_spread(held, "u", in_many)), ["u", "part"]).groupBy("v").agg(F.sum("held").alias("flow"))
        own = F.col("degree") * F.col("rank") / F.col("strength")
        after = durable(now.join(flow, "v").select("v", "strength", "degree", ((1 - damping) / n + damping * (F.col("flow") - own)).alias("rank"), F.col("rank").alias("before")))
        forget(now, held)
        now = after
        if now.agg(F.sum(F.abs(F.col("rank") - F.col("before")))).first()[0] < tolerance:
            break
    forget(links, out, back)
    return now.select(F.col("v").alias("entity"), "rank")


def modularity(edges: DataFrame, groups: DataFrame) -> float:
    """Of a grouping (entity, community) of the vertices: the share of weight inside communities less what chance would put there."""
    links = both_ways(edges)
    own = links.join(groups.select(F.col("entity").alias("v"), F.col("community").alias("cv")), "v").join(groups.select(F.col("entity").alias("u"), F.col("community").alias("cu")), "u")
    return _modularity(own.select("cv", "cu", "w"))


def _modularity(pairs: DataFrame) -> float:
    per = pairs.groupBy("cv").agg(F.sum("w").alias("total"), F.sum(F.when(F.col("cv") == F.col("cu"), F.col("w")).otherwise(0.0)).alias("inside"))
    sums = per.agg(F.sum("total").alias("m"), F.sum("inside").alias("inside"), F.sum(F.col("total") * F.col("total")).alias("squares")).first()
    return sums.inside / sums.m - sums.squares / sums.m**2 if sums.m else 0.0


def _moved(links: DataFrame, many: DataFrame, rounds: int, seed: int) -> DataFrame:
    """(v, c): communities of the vertices of ``links`` (v, u, w, part; loops are a vertex's own weight) by rounds in which about half of them may
    move, each to the community of its neighbours that gains most; those of the best round."""
    m = links.agg(F.sum("w")).first()[0]
    strength = durable(links.groupBy("v").agg(F.sum("w").alias("k")))
    now = durable(strength.select("v", F.col("v").alias("c")))
    best, score, still = now, None, 0
    for turn in range(rounds):
        # what each vertex has to each community next to it, and to its own
        beside = links.where("v <> u").join(_spread(now.select(F.col("v").alias("u"), "c"), "u", many), ["u", "part"]).groupBy("v", "c").agg(F.sum("w").alias("near"))
        beside = beside.unionByName(now.withColumn("near", F.lit(0.0))).groupBy("v", "c").agg(F.sum("near").alias("near"))
        total = now.join(strength, "v").groupBy("c").agg(F.sum("k").alias("total"))
        own = now.join(strength, "v").select("v", F.col("c").alias("own"), "k")
        gains = beside.join(own, "v").join(total, "c")
        rest = F.col("total") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)
        gains = gains.select("v", "c", "own", (F.col("near") - F.col("k") * rest / F.lit(m)).alias("gain"))
        # rounded, so that the order of sums does not decide between equal gains
        picked = gains.groupBy("v", "own").agg(F.min(F.struct((-F.round("gain", 9)).alias("loss"), "c")).alias("best"), F.max(F.when(F.col("c") == F.col("own"), F.round("gain", 9))).alias("stay"))
        may = (F.pmod(F.xxhash64("v", F.lit(seed), F.lit(turn // 2)), F.lit(2)) == turn % 2) & (-F.col("best.loss") > F.col("stay") + LEAST_GAIN)
        after = durable(picked.select("v", F.when(may, F.col("best.c")).otherwise(F.col("own")).alias("c"), may.alias("moves")))
        still = 0 if after.where("moves").limit(1).count() else still + 1
        pairs = links.join(after.select("v", F.col("c").alias("cv")), "v").join(after.select(F.col("v").alias("u"), F.col("c").alias("cu")), "u")
        q = _modularity(pairs.select("cv", "cu", "w"))
        if now is not best:
            forget(now)
        now = after.select("v", "c")
        now._durable = after._durable
        if score is None or q > score + LEAST_GAIN:
            if best is not now:
                forget(best)
            best, score = now, q
        if still == 2:
            break
    return best


def communities(edges: DataFrame, rounds: int = 20, levels: int = 8, seed: int = 1) -> DataFrame:
    """(entity, community): groups with more weight inside than chance would put there. Vertices move between communities while modularity gains, then each community
    becomes a vertex, and so on until nothing moves or ``levels`` are done. A community is named by its least entity."""
    links = durable(both_ways(edges))
    now = durable(links.select("v").distinct().select(F.col("v").alias("entity"), F.col("v").alias("c")))
    if now.isEmpty():
        return now.select("entity", F.col("c").alias("community"))
    for level in range(levels):
        cut, many = _cut(links, "u")
        cut = durable(cut)
        found = _moved(cut, many, rounds, seed + level)
        before = now.select("c").distinct().count()
        now = durable(now.join(found.select(F.col("v").alias("c"), F.col("c").alias("to")), "c").select("entity", F.col("to").alias("c")))
        if now.select("c").distinct().count() == before:
            break
        names = found.select("v", "c")
        links = durable(links.join(names.withColumnRenamed("c", "cv"), "v").join(names.select(F.col("v").alias("u"), F.col("c").alias("cu")), "u").groupBy(F.col("cv").alias("v"), F.col("cu").alias("u")).agg(F.sum("w").alias("w")))
    least = now.groupBy("c").agg(F.min("entity").alias("community"))
    return now.join(least, "c").select("entity", "community")


def _numbered(values: DataFrame, name: str, number: str) -> DataFrame:
    """The distinct values with numbers in the values' order."""
    return durable(values.select(name).distinct().orderBy(name).select(F.monotonically_increasing_id().alias(number), name))


def _best_beside(m: float):
    """For each vertex of a block of vertices, and a block of communities: what the vertex has to the community of the block that it would gain most by, and to its own
    if that is there. Rows of ``place`` null say the vertices' own communities, strengths and squares, and the communities' strengths."""

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        def split(rows: pa.Table, *values: str):
            info, rest = rows.filter(pc.is_null(rows["place"])), rows.filter(pc.is_valid(rows["place"]))
            ids = info["id"].to_numpy()
            order = np.argsort(ids)
            lists = rest["ids"].combine_chunks()
            ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
            flat = np.searchsorted(ids[order], lists.flatten().to_numpy(zero_copy_only=False))
            return ids[order], [info[v].to_numpy()[order] for v in values], rest["place"].to_numpy(), ends, flat, rest["ns"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)

        if not left.num_rows or not right.num_rows:
            return pa.table({"v": [], "c": [], "near": []}, schema=_NEAR)
        vs, (own, k, square), lplace, lends, lrow, ln = split(left, "own", "strength", "square")
        cs, (total,), rplace, rends, rcol, rn = split(right, "strength")
        # places that both blocks have members in, by vertex
        places, where = np.unique(np.concatenate([lplace, rplace]), return_inverse=True)
        begin, end = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
        begin[where[len(lplace) :]], end[where[len(lplace) :]] = np.concatenate([[0], rends[:-1]]) if len(rends) else rends, rends
        lwhere = np.repeat(where[: len(lplace)], np.diff(lends, prepend=0))
        order = np.argsort(lrow, kind="stable")
        lrow, lwhere, ln = lrow[order], lwhere[order], ln[order]
        edges = np.searchsorted(lrow, np.arange(len(vs) + 1))
        home = np.searchsorted(cs, own)
        at_home = (home < len(cs)) & (cs[np.minimum(home, len(cs) - 1)] == own)
        v_out, c_out, near_out = [], [], []
        for i in range(len(vs)):
            near = np.zeros(len(cs))
            for j in range(edges[i], edges[i + 1], AT_ONCE):
                some = slice(j, min(j + AT_ONCE, edges[i + 1]))
                spans = [(b, e, n) for b, e, n in zip(begin[lwhere[some]].tolist(), end[lwhere[some]].tolist(), ln[some].tolist(), strict=True) if e > b]
                if spans:
                    near += np.bincount(np.concatenate([rcol[b:e] for b, e, _ in spans]), np.concatenate([rn[b:e] if n == 1 else n * rn[b:e] for b, e, n in spans]), len(cs))
            if at_home[i]:
                v_out.append(vs[i]), c_out.append(own[i]), near_out.append(near[home[i]] - square[i])
                near[home[i]] = 0.0
            beside = np.flatnonzero(near)
            if len(beside):
                gain = near[beside] - k[i] * total[beside] / m
                close = np.flatnonzero(gain >= gain.max() - 2e-9)
                pick = beside[close[np.argmax(np.round(gain[close], 9))]]
                v_out.append(vs[i]), c_out.append(cs[pick]), near_out.append(near[pick])
        return pa.table({"v": v_out, "c": c_out, "near": near_out}, schema=_NEAR)

    return best


def _blocks(count: int, members: int, most: int) -> int:
    return max(1, math.ceil(count / most), math.ceil(members / MEMBERS))


def _beside(drawn: DataFrame, parts: DataFrame, held: DataFrame, total: DataFrame, m: float, mine: int, theirs: int) -> DataFrame:
    """(v, c, near): of the vertices ``drawn`` (v, own, k, square), from their memberships ``parts`` (v, x, n) and those of all communities, ``held`` (c, x, n). Vertices are dealt
    into ``mine`` and communities into ``theirs`` blocks, and each two blocks meet in a task that hands on two rows for each vertex at most, so that no pair is stored or shuffled."""
    asked = parts.join(drawn.select("v"), "v", "left_semi")

    def dealt(members: DataFrame, info: DataFrame, blocks: int, copies: int, group) -> DataFrame:
        block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")
        lists = members.groupBy(block, F.col("x").alias("place")).agg(F.collect_list("id").alias("ids"), F.collect_list(F.col("n").cast("int")).alias("ns"))
        rows = lists.unionByName(info.select(block, "*"), allowMissingColumns=True).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        return rows.withColumn("g", group(F.col("block"), F.col("copy"))).drop("block", "copy").repartition(2 * mine * theirs, "g")

    left = dealt(asked.withColumnRenamed("v", "id"), drawn.select(F.col("v").alias("id"), "own", F.col("k").alias("strength"), F.col("square").cast("double").alias("square")), mine, theirs, lambda b, c: b * theirs + c)
    right = dealt(held.withColumnRenamed("c", "id"), total.select(F.col("c").alias("id"), F.col("total").alias("strength")), theirs, mine, lambda b, c: c * theirs + b)
    return left.groupBy("g").cogroup(right.groupBy("g")).applyInArrow(_best_beside(m), "v long, c long, near double")


def _moved_through(parts: DataFrame, strength: DataFrame, names: DataFrame, m: float, rounds: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The same moves as ``_moved``, of vertices with memberships ``parts`` (v, x, n) and (v, k): (v, c), and the communities' memberships (c, x, n). A vertex has to a community what
    both put into their contexts, multiplied and added up."""
    square = parts.groupBy("v").agg(F.sum(F.col("n") * F.col("n")).alias("square"))
    vertices = durable(strength.join(square, "v").join(names, "v"))
    now, held = durable(vertices.select("v", F.col("v").alias("c"))), parts.withColumnRenamed("v", "c")
    total = durable(strength.select(F.col("v").alias("c"), F.col("k").alias("total")))
    n, rows = vertices.count(), parts.count()
    count, members, best, score, still = n, rows, None, None, 0
    tasks = parts.sparkSession.sparkContext.defaultParallelism
    for turn in range(rounds):
        half = F.pmod(F.xxhash64("name", F.lit(seed), F.lit(turn // 2)), F.lit(2)) == turn % 2
        drawn = vertices.where(half).join(now, "v").select("v", F.col("c").alias("own"), "k", "square")
        theirs = _blocks(count, members, COMMUNITIES)
        mine = max(_blocks(n // 2, rows // 2, VERTICES), min(n // 64, tasks // theirs))
        beside = _beside(drawn, parts, held, total, m, mine, theirs)
        gains = beside.join(drawn, "v").join(total, "c")
        rest = F.col("total") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)
        gains = gains.select("v", "c", "own", (F.col("near") - F.col("k") * rest / F.lit(m)).alias("gain"))
        picked = gains.groupBy("v", "own").agg(F.min(F.struct((-F.round("gain", 9)).alias("loss"), "c")).alias("best"), F.max(F.when(F.col("c") == F.col("own"), F.round("gain", 9))).alias("stay"))
        moves = picked.where(-F.col("best.loss") > F.col("stay") + LEAST_GAIN).select("v", F.col("best.c").alias("to"))
        after = durable(now.join(moves, "v", "left").select("v", F.coalesce("to", "c").alias("c"), F.col("to").isNotNull().cast("int").alias("moved")))
        if best is None or now is not best[0]:
            forget(now, held)
        forget(total)
        now = after.select("v", "c")
        now._durable = after._durable
        total = durable(after.join(strength, "v").groupBy("c").agg(F.sum("k").alias("total"), F.sum("moved").alias("moved")))
        held = durable(parts.join(F.broadcast(now) if n <= BROADCAST_KEYS else now, "v").groupBy("c", "x").agg(F.sum("n").alias("n")))
        sums = total.agg(F.sum(F.col("total") * F.col("total")).alias("squares"), F.sum("moved").alias("moved"), F.count("*").alias("count")).first()
        per = held.agg(F.sum((F.col("n") * (F.col("n") - 1)).cast("double")).alias("inside"), F.count("*").alias("members")).first()
        count, members, still = sums["count"], per.members, 0 if sums.moved else still + 1
        q = per.inside / m - sums.squares / m**2
        if best is None or q > score + LEAST_GAIN:
            if best is not None:
                forget(*best)
            best, score = (now, held), q
        if still == 2:
            break
    forget(vertices, total)
    return best


def communities_of_contexts(mentions: DataFrame, context: str, entity: str, rounds: int = 20, levels: int = 8, seed: int = 1) -> DataFrame:
    """``communities`` of the edges that ``retrieval.cooccurrence`` gives, by the same moves, without making them. As long as all vertices are communities, every two that share a
    context are still compared, in blocks in memory; what is shuffled and written goes by memberships."""
    own = durable(memberships(mentions, context, entity))
    names, places = _numbered(own, "v", "id"), _numbered(own, "u", "x")
    parts = durable(own.join(small(names), "v").join(small(places), "u").select(F.col("id").alias("v"), "x", F.lit(1).cast("long").alias("n"), "size"))
    strength = durable(parts.groupBy("v").agg(F.sum(F.col("size") - 1).cast("double").alias("k")))
    m = strength.agg(F.sum("k")).first()[0]
    named = names.select(F.col("id").alias("v"), F.col("v").alias("name"))
    now, parts = durable(strength.select(F.col("v").alias("entity"), F.col("v").alias("c"))), parts.drop("size")
    count = now.count()
    for level in range(levels if count else 0):
        found, held = _moved_through(parts, strength, named, m, rounds, seed + level)
        after = durable(now.join(found.select(F.col("v").alias("c"), F.col("c").alias("to")), "c").select("entity", F.col("to").alias("c")))
        forget(now)
        now, before = after, count
        count = now.select("c").distinct().count()
        if count == before:
            break
        parts = held.select(F.col("c").alias("v"), "x", "n")
        strength = durable(found.join(strength, "v").groupBy(F.col("c").alias("v")).agg(F.sum("k").alias("k")))
    least = now.groupBy("c").agg(F.min("entity").alias("least"))
    of = lambda column, name: names.select(F.col("id").alias(column), F.col("v").alias(name))
    return now.join(least, "c").join(of("entity", "_name"), "entity").join(of("least", "community"), "least").select(F.col("_name").alias("entity"), "community")
