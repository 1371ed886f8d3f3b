"""Communities on weighted graphs: modularity moves, connected parts and contraction, level after level.

All variants (resolutions, blend weights) run together: ``variant`` is a key of every join and aggregate. A connected part of a
variant rests by itself, when none of its nodes gains by a move. Parts of at most LOCAL_EDGES edges run their rounds inside a task,
larger ones by joins that look at the active nodes only; both follow one rule on whole-number weights and give the same labels.
Cells are numbered in the order of their ids once; names come back at the end.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import bucketed, cut
from . import moving

#: Edges (both directions) of a connected part that a task may hold, in 8 bytes each.
LOCAL_EDGES = 1 << 25
#: Star edges, left of a graph by its tasks, that one task may join; nodes whose stars a task holds at once; links that it adds at once.
STARS, HELD_NODES, LINKS = 1 << 23, 1 << 21, 1 << 20
#: Parts from so many edges on get a task each, as far as TASKS go.
OWN_TASK, TASKS = 1 << 16, 4096
#: Weights count in units of 2 ** -UNIT.
UNIT = 24
#: Times that the levels run; every further time starts from the communities of the one before.
STEPS = 2


def modularity(edges: DataFrame, labels: DataFrame, by: list[str] | None = None, gamma: float = 1.0) -> DataFrame:
    """Weighted modularity of a symmetric edge table (both directions stored); fewer than two labels give 0."""
    keys = by or []
    a = labels.select(*keys, F.col("cell_id").alias("src"), F.col("label").alias("la"))
    b = labels.select(*keys, F.col("cell_id").alias("dst"), F.col("label").alias("lb"))
    shared = [c for c in keys if c in edges.columns]
    tagged = edges.join(a, [*shared, "src"]).join(b, [*keys, "dst"])
    per = tagged.groupBy(*keys, F.col("la").alias("label")).agg(
        F.sum("weight").alias("tot"), F.sum(F.when(F.col("la") == F.col("lb"), F.col("weight")).otherwise(0.0)).alias("inside"))
    whole = F.sum("tot")
    out = per.groupBy(*keys).agg(
        (F.sum("inside") / whole - gamma * F.sum(F.col("tot") * F.col("tot")) / (whole * whole)).alias("_q"), F.count(F.lit(1)).alias("n_labels"))
    return out.select(*keys, "n_labels", F.when(F.col("n_labels") < 2, F.lit(0.0)).otherwise(F.col("_q")).alias("modularity"))


def communities(edges: DataFrame, variants: DataFrame, seed: int = 42) -> DataFrame:
    """Modularity communities (resolution ``gamma``) per variant as (variant, cell_id, label).

    ``edges``: (variant, src, dst, weight), symmetric, or (src, dst, weight) that all variants share. ``variants``: (variant, gamma).
    Nodes move to the neighbouring community that gains most, communities are cut into connected parts and contracted, and so on
    until no node moves; STEPS times. A connected part stops by itself and is not touched by the others, but for the total weight of
    its variant in the modularity. Labels are numbered by size, largest first.
    """
    keys = ["variant"] if "variant" in edges.columns else []
    whole = F.round(F.col("weight").cast("double") * float(1 << UNIT)).cast("long")
    graph = cut(edges.select(*keys, "src", "dst", whole.alias("w")))
    scale = graph.groupBy(*keys).agg(F.sum("w").alias("m2"))
    scale = (scale.join(variants, "variant") if keys else scale.crossJoin(variants)).select("variant", "m2", F.col("gamma").cast("double").alias("gamma"))
    facts = {r.variant: (r.m2, r.gamma) for r in scale.collect()}  # one row per variant
    names, graph = _numbered(graph, keys, seed)
    graph = _parts(graph)
    rows = cut(_rows(graph, keys))
    sizes = cut(rows.groupBy(*keys, "part").agg(F.sum(F.size("dst")).alias("n")))
    every = F.explode(F.array(*[F.lit(v) for v in facts])) if facts else F.lit(None).cast("string")
    spread = lambda df: df if keys else df.withColumn("variant", every)
    large = cut(sizes.filter(F.col("n") > LOCAL_EDGES).select("part"))
    if large.isEmpty():
        found = _settled(spread(rows), spread(sizes), facts, seed, range(STEPS))
    else:
        fits = lambda df: df.join(F.broadcast(large), "part", "left_anti")
        done = _settled(spread(fits(rows)), spread(fits(sizes)), facts, seed, range(STEPS))
        # nodes of different variants have different numbers, still in the order of their ids
        number, some = F.create_map(*[F.lit(x) for p in enumerate(facts) for x in p[::-1]])[F.col("variant")], F.lit(len(facts)).cast("long")
        apart = lambda c: F.col(c) * some + number
        graph = spread(graph.join(F.broadcast(large), "part", "left_semi"))
        graph = cut(graph.select("variant", apart("part").alias("part"), apart("src").alias("src"), apart("dst").alias("dst"), "w", "mark"))
        raw = None
        for step in range(STEPS):
            raw = _levels(graph, raw, facts, seed, step)
        found = done.unionByName(raw.select("variant", *[F.expr(f"{c} div {len(facts)}").alias(c) for c in ("cell_id", "raw")]))
    labels = number_by_size(cut(found)).withColumnRenamed("cell_id", "node")
    return labels.join(names.drop("variant"), "node").select("variant", "cell_id", "label")


def _numbered(graph: DataFrame, keys: list[str], seed: int) -> tuple[DataFrame, DataFrame]:
    """(names, edges): cells with a number (``node``) in the order of variant and id, and ``graph`` with numbers, and the hash of src's id."""
    cells = graph.select(*keys, F.col("src").alias("cell_id")).distinct().orderBy(*keys, "cell_id")
    names = cut(cells.select(*keys, "cell_id", F.monotonically_increasing_id().alias("node")))
    end = lambda c: names.select(*keys, F.col("cell_id").alias(c), F.col("node").alias(f"n_{c}"))
    src = end("src").withColumn("mark", F.xxhash64(F.lit(seed), "src"))
    both = graph.join(src, [*keys, "src"]).join(end("dst"), [*keys, "dst"])
    return names, cut(both.select(*keys, F.col("n_src").alias("src"), F.col("n_dst").alias("dst"), "w", "mark"))


def _parts(graph: DataFrame) -> DataFrame:
    """``graph`` with ``part``, the smallest node of each edge's connected part; nodes that are no numbers are named with their variant."""
    kind = graph.schema["src"].dataType.simpleString()
    name = (lambda c: F.col(c)) if kind == "bigint" else (lambda c: F.concat_ws("\u0001", "variant", c))
    links = graph.select(name("src").alias("src"), name("dst").alias("dst"))
    stars = cut(links.filter("src < dst").mapInArrow(lambda batches: _stars(batches, HELD_NODES), f"src {kind}, dst {kind}"))
    if stars.count() <= STARS:
        found = cut(stars.coalesce(1).mapInArrow(lambda batches: _stars(batches, None), f"src {kind}, dst {kind}")).select(F.col("src").alias("_node"), F.col("dst").alias("part"))
        least = F.coalesce("part", name("src")).alias("part")  # the smallest node of a part and nodes without links have no star
        return cut(graph.join(found, name("src") == F.col("_node"), "left").select(*[F.col(c) for c in graph.columns], least))
    both = stars.unionByName(stars.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    parts = connected_components(both, links.select(F.col("src").alias("cell_id")).distinct())
    return cut(graph.join(parts.select(F.col("cell_id").alias("_node"), F.col("component").alias("part")), name("src") == F.col("_node")).drop("_node"))


def _stars(batches, most: int | None):
    """Replace a task's links by links to the smallest node of each of their connected parts: fewer rows, same parts.

    Stars of more than ``most`` nodes leave the task and are not joined with the links that follow.
    """
    held, size, stars = [], 0, None

    def joined():
        tables = [pa.Table.from_batches(held), *([stars] if stars is not None else [])]
        ends = [pa.chunked_array([c for t in tables for c in t.column(i).chunks], tables[0].column(i).type) for i in (0, 1)]
        found = pa.chunked_array([c for end in ends for c in end.chunks], ends[0].type).unique()
        found = found.take(pc.array_sort_indices(found))
        a, b = (pc.index_in(end, value_set=found).to_numpy() for end in ends)
        least = np.arange(len(found))
        while True:
            low = least.copy()
            np.minimum.at(low, a, least[b])
            np.minimum.at(low, b, least[a])
            np.minimum.at(low, least, low)  # a part follows its best member
            low = low[low]
            if (low == least).all():
                break
            least = low
        rest = np.flatnonzero(least != np.arange(len(found)))
        return pa.table({"src": found.take(pa.array(rest)), "dst": found.take(pa.array(least[rest]))})

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size > LINKS:
            stars, held, size = joined(), [], 0
            if most is not None and len(stars) > most:
                yield from stars.to_batches()
                stars = None
    if held:
        stars = joined()
    if stars is not None:
        yield from stars.to_batches()


def _rows(graph: DataFrame, keys: list[str]) -> DataFrame:
    """One row per node of ``graph``: the far ends and weights of its edges as lists."""
    lists = F.collect_list(F.struct("dst", "w"))
    return graph.groupBy(*keys, "part", "src").agg(F.first("mark").alias("mark"), lists.alias("_e")).select(
        *keys, "part", "src", "mark", F.col("_e.dst").alias("dst"), F.col("_e.w").alias("w"))


def _settled(rows: DataFrame, sizes: DataFrame, facts: dict, seed: int, steps: range, level: int = 0) -> DataFrame:
    """(variant, cell_id, raw): the communities of parts that fit into a task, named by their smallest node.

    ``rows`` of one part and variant meet in a task, in order; parts of OWN_TASK edges have a task to themselves, the largest first.
    """
    spark = rows.sparkSession
    big = sizes.filter(F.col("n") >= OWN_TASK).orderBy(F.desc("n"), "variant", "part").limit(TASKS).collect()
    tasks = max(len(big), int(spark.conf.get("spark.sql.shuffle.partitions")))
    plan = spark.createDataFrame([(r.variant, r.part, i) for i, r in enumerate(big)], "variant string, part long, own int")
    task = F.coalesce("own", F.pmod(F.xxhash64("variant", "part"), F.lit(tasks)).cast("int"))
    dealt = rows.join(F.broadcast(plan), ["variant", "part"], "left").select("variant", "part", "src", "mark", "dst", "w", task.alias("task"))

    def run(batches):
        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            variant, part = batch.column("variant").dictionary_encode(), batch.column("part").to_numpy()
            code = variant.indices.to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (part[1:] != part[:-1]))))
            for lo, hi in zip(starts, [*starts[1:], len(part)]):
                key = variant.dictionary[int(code[lo])].as_py(), int(part[lo])
                if held and key != last:
                    yield settled(last, held)
                last = key
                held.append([_copied(batch.column(c).slice(lo, hi - lo)) for c in ("src", "mark", "dst", "w")])
        if held:
            yield settled(last, held)

    def settled(key, held):
        m2, gamma = facts[key[0]]
        ids, mark = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        degree = np.concatenate([h[2][0] for h in held])
        far, weight = [], []
        kind = np.int32 if max(h[3][1].max(initial=0) for h in held) < 1 << 31 else np.int64
        while held:  # piece by piece, so that edges are not held twice
            _, _, (_, b), (_, w) = held.pop(0)
            far.append(np.searchsorted(ids, b).astype(np.int32))
            weight.append(w.astype(kind))
        far, weight = np.concatenate(far), np.concatenate(weight)
        starts, own = np.concatenate(([0], np.cumsum(degree))), np.repeat(np.arange(len(ids), dtype=np.int32), degree)
        same, loop = own == far, np.zeros(len(ids), np.int64)
        if same.any():
            np.add.at(loop, own[same], weight[same])
            starts = np.concatenate(([0], np.cumsum(np.bincount(own[~same], minlength=len(ids)))))
            far, weight = far[~same], weight[~same]
        del own, same
        raw = moving.settle_rows(starts, far, weight, loop, mark, gamma, m2, seed, steps, level)
        return pa.RecordBatch.from_pydict({"variant": pa.array([key[0]] * len(ids), pa.string()), "cell_id": ids, "raw": ids[raw]})

    sorted_ = dealt.repartitionById(tasks, F.col("task")).sortWithinPartitions("variant", "part", "src").drop("task")
    return sorted_.mapInArrow(run, "variant string, cell_id long, raw long")


def _copied(column):
    """The numbers of a column, of a list column their counts and all of them, apart from Spark's batch."""
    if not pa.types.is_list(column.type):
        return column.to_numpy().copy()
    return column.value_lengths().to_numpy().astype(np.int64), column.flatten().to_numpy().copy()


def _levels(graph: DataFrame, start: DataFrame | None, facts: dict, seed: int, step: int) -> DataFrame:
    """(variant, cell_id, raw) of large parts: levels by joins until what is left of a part fits into a task or rests."""
    names = graph.select("variant", F.col("src").alias("cell_id")).distinct().withColumn("node", F.col("cell_id"))
    if start is not None:
        start = start.select("variant", F.col("cell_id").alias("node"), F.col("raw").alias("comm"))
    final = None
    for level in count():
        label = _connected(graph, _moved(graph, start, facts, seed, step, level))
        names = cut(names.join(label, ["variant", "node"]).select("variant", "cell_id", F.col("comm").alias("node")))
        sizes = label.join(graph.select("variant", "part", F.col("src").alias("node")).distinct(), ["variant", "node"]).groupBy("variant", "part").agg(
            F.count(F.lit(1)).alias("nodes"), F.countDistinct("comm").alias("comms"))
        going = cut(sizes.filter("comms < nodes").select("variant", "part"))
        if going.isEmpty():
            kept = names.select("variant", "cell_id", F.col("node").alias("raw"))
            return kept if final is None else _renamed(names, final)
        graph = cut(_contract(graph.join(F.broadcast(going), ["variant", "part"], "left_semi"), label))
        load = graph.groupBy("variant", "part").agg(F.count(F.lit(1)).alias("n"))
        small = cut(load.filter(F.col("n") <= LOCAL_EDGES))
        fits = graph.join(F.broadcast(small), ["variant", "part"], "left_semi")
        rest = _settled(_rows(fits, ["variant"]), small, facts, seed, range(step, step + 1), level + 1)
        final = cut(rest if final is None else final.unionByName(rest))
        graph = cut(graph.join(F.broadcast(small), ["variant", "part"], "left_anti"))
        start = None
        if graph.isEmpty():
            return _renamed(names, final)


def _renamed(names: DataFrame, final: DataFrame) -> DataFrame:
    to = final.select("variant", F.col("cell_id").alias("node"), "raw")
    return cut(names.join(to, ["variant", "node"], "left").select("variant", "cell_id", F.coalesce("raw", "node").alias("raw")))


def number_by_size(members: DataFrame) -> DataFrame:
    """Replace raw community ids by 0, 1, ... in order of size, then of smallest member."""
    size = members.groupBy("variant", "raw").agg(F.count(F.lit(1)).alias("n"), F.min("cell_id").alias("first"))
    rank = F.row_number().over(W.partitionBy("variant").orderBy(F.col("n").desc(), "first")) - 1
    return members.join(size.select("variant", "raw", rank.cast("string").alias("label")), ["variant", "raw"]).select("variant", "cell_id", "label")


def _totals(state: DataFrame) -> DataFrame:
    """``state`` with the total degree of each node's community."""
    return state.join(state.groupBy("variant", "comm").agg(F.sum("k").alias("tot")), ["variant", "comm"])


def _moved(graph: DataFrame, start: DataFrame | None, facts: dict, seed: int, step: int, level: int) -> DataFrame:
    """(variant, node, comm) after moves until no node gains by one: the rounds of ``moving.move`` as joins.

    The edges are laid out by (variant, src) once; a round reads the edges of its active nodes, sends them to their far ends'
    communities and back, and writes the state of the nodes. Each part keeps its own share of movers; one row per part and round
    reaches the driver.
    """
    laid = graph.filter("src <> dst").select("variant", "part", "src", "dst", "w")
    with bucketed(laid, "variant", "src") as table:
        return _rounds(graph, table, start, facts, seed, step, level)


def _rounds(graph: DataFrame, table: DataFrame, start: DataFrame | None, facts: dict, seed: int, step: int, level: int) -> DataFrame:
    spark = graph.sparkSession
    nodes = graph.groupBy("variant", "part", F.col("src").alias("node")).agg(F.sum("w").alias("k"), F.first("mark").alias("mark"))
    state = nodes.withColumn("comm", F.col("node")) if start is None else nodes.join(start, ["variant", "node"])
    if start is None:
        state = state.withColumn("cmark", F.col("mark"))
    else:
        name = nodes.select("variant", F.col("node").alias("comm"), F.col("mark").alias("cmark"))
        state = state.join(name, ["variant", "comm"])
    columns = ["variant", "part", "node", "k", "mark", "comm", "cmark", "tot"]
    state = cut(_totals(state).select(*columns))
    scale = spark.createDataFrame([(v, m2, g) for v, (m2, g) in facts.items()], "variant string, m2 long, gamma double")
    at = lambda r: (r.variant, r.part)
    going = {at(r): {"complete": True, "halvings": 0} for r in state.select("variant", "part").distinct().collect()}
    active = state.select("variant", "part", "node")
    for number in count():
        wants = cut(_wishes(table, state, active, scale))
        factor, shift = moving.turn_of(seed, step, level, number)
        keyed = wants.withColumn("key", (F.lit(factor).cast("long") * F.pmod("mark", F.lit(moving.PRIME).cast("long")) + F.lit(shift).cast("long")) % F.lit(moving.PRIME).cast("long"))
        found = {at(r): r.least for r in keyed.groupBy("variant", "part").agg(F.min(F.struct("key", "node")).alias("least")).collect()}
        rest = [p for p in going if p not in found]
        for p in rest:  # nobody among the active nodes wants to move: look at all once more, or be done
            if going[p]["complete"]:
                del going[p]
            else:
                going[p]["complete"] = True
        if not going:
            return state.select("variant", "node", "comm")
        plan = spark.createDataFrame([(*p, moving.share_of(going[p]["halvings"]), found[p].node) for p in found],
                                     "variant string, part long, share long, first long")
        movers = cut(keyed.join(F.broadcast(plan), ["variant", "part"]).filter((F.col("key") < F.col("share")) | (F.col("node") == F.col("first"))).select(
            "variant", "part", "node", "k", F.col("comm").alias("old"), F.col("to").alias("new"), F.col("to_mark").alias("new_mark")))
        accepted = []
        for p, (moves, inside, squares) in _effects(table, state, movers).items():
            m2, gamma = facts[p[0]]
            going[p]["complete"] = False
            if moves == 1 or moving.rises(m2, gamma, inside, squares):
                accepted.append(p)
                going[p]["halvings"] = max(0, going[p]["halvings"] - 1)
            else:
                going[p]["halvings"] += 1
        again = spark.createDataFrame([p for p in going if going[p]["complete"]], "variant string, part long")
        active = wants.select("variant", "part", "node").unionByName(
            state.join(F.broadcast(again), ["variant", "part"], "left_semi").select("variant", "part", "node"))
        if accepted:
            took = spark.createDataFrame(accepted, "variant string, part long")
            movers = cut(movers.join(F.broadcast(took), ["variant", "part"], "left_semi"))
            near = table.join(movers.select("variant", F.col("node").alias("src")), ["variant", "src"]).select("variant", "part", F.col("dst").alias("node"))
            active = active.unionByName(near).distinct()
            changed = state.join(movers.select("variant", "node", "new", "new_mark"), ["variant", "node"], "left")
            state = cut(_totals(changed.select("variant", "part", "node", "k", "mark", F.coalesce("new", "comm").alias("comm"),
                                               F.coalesce("new_mark", "cmark").alias("cmark"))).select(*columns))
        active = cut(active)


def _wishes(table: DataFrame, state: DataFrame, active: DataFrame, scale: DataFrame) -> DataFrame:
    """The active nodes that gain by a move: (variant, part, node, k, mark, comm, to, to_mark)."""
    own = state.join(active.select("variant", "node"), ["variant", "node"], "left_semi")
    far = state.select("variant", F.col("node").alias("dst"), F.col("comm").alias("to"), F.col("cmark").alias("to_mark"), "tot")
    near = table.join(own.select("variant", F.col("node").alias("src")), ["variant", "src"]).join(far, ["variant", "dst"])
    options = near.select("variant", F.col("src").alias("node"), "to", "to_mark", "tot", "w").unionByName(
        own.select("variant", "node", F.col("comm").alias("to"), F.col("cmark").alias("to_mark"), "tot", F.lit(0).cast("long").alias("w")))
    summed = options.groupBy("variant", "node", "to").agg(F.max("to_mark").alias("to_mark"), F.max("tot").alias("tot"), F.sum("w").alias("w"))
    tried = summed.join(own.select("variant", "part", "node", "k", "mark", "comm"), ["variant", "node"]).join(F.broadcast(scale), "variant")
    here, real = F.col("to") == F.col("comm"), lambda c: F.col(c).cast("double")
    rest = (F.col("tot") - F.when(here, F.col("k")).otherwise(F.lit(0).cast("long"))).cast("double")
    gain = real("w") - F.col("gamma") * real("k") * rest / real("m2")
    best = tried.withColumn("gain", gain).withColumn("here", here.cast("int")).groupBy("variant", "part", "node").agg(
        F.max("k").alias("k"), F.max("mark").alias("mark"), F.max("comm").alias("comm"), F.max(F.when(F.col("here") == 1, F.col("gain"))).alias("stay"),
        F.max(F.struct("gain", "here", "to_mark", "to")).alias("b"))
    return best.filter((F.col("b.gain") - F.col("stay")) > moving.LEAST_GAIN * real("k")).select(
        "variant", "part", "node", "k", "mark", "comm", F.col("b.to").alias("to"), F.col("b.to_mark").alias("to_mark"))


def _effects(table: DataFrame, state: DataFrame, movers: DataFrame) -> dict:
    """Per part: how many nodes move, and what this changes in the weight inside communities and in the sum of their squared totals."""
    end = movers.select("variant", F.col("node").alias("dst"), F.col("new").alias("dst_new"))
    far = state.select("variant", F.col("node").alias("dst"), F.col("comm").alias("dst_old"))
    touched = table.join(movers.select("variant", F.col("node").alias("src"), "old", "new"), ["variant", "src"]).join(far, ["variant", "dst"]).join(
        end, ["variant", "dst"], "left")
    after = F.col("new") == F.coalesce("dst_new", "dst_old")
    change = after.cast("long") - (F.col("old") == F.col("dst_old")).cast("long")
    inside = touched.groupBy("variant", "part").agg(F.sum(F.col("w") * change * F.when(F.col("dst_new").isNull(), F.lit(2)).otherwise(F.lit(1))).alias("inside"))
    delta = movers.select("variant", "part", F.explode(F.array(F.struct(F.col("old").alias("comm"), (-F.col("k")).alias("d")),
                                                               F.struct(F.col("new").alias("comm"), F.col("k").alias("d")))).alias("e")).groupBy(
        "variant", "part", F.col("e.comm").alias("comm")).agg(F.sum("e.d").alias("d"))
    total = state.join(delta.select("variant", "comm"), ["variant", "comm"], "left_semi").groupBy("variant", "comm").agg(F.max("tot").alias("tot"))
    # two factors below 2 ** 63 as decimals: their product is exact
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    square = exact("d") * (F.lit(2).cast("decimal(1,0)") * exact("tot") + exact("d")).cast("decimal(19,0)")
    squares = delta.join(total, ["variant", "comm"]).groupBy("variant", "part").agg(F.sum(square.cast("decimal(38,0)")).alias("squares"))
    moves = movers.groupBy("variant", "part").agg(F.count(F.lit(1)).alias("moves"))
    rows = moves.join(inside, ["variant", "part"]).join(squares, ["variant", "part"]).collect()  # one row per large part
    return {(r.variant, r.part): (r.moves, int(r.inside), int(r.squares)) for r in rows}


def _connected(graph: DataFrame, moved: DataFrame) -> DataFrame:
    """(variant, node, comm): each community cut into its connected parts, named by their smallest node."""
    moved = cut(moved)
    side = lambda c: moved.select("variant", F.col("node").alias(c), F.col("comm").alias(f"c_{c}"))
    inside = graph.filter("src <> dst").join(side("src"), ["variant", "src"]).join(side("dst"), ["variant", "dst"]).filter("c_src = c_dst")
    found = connected_components(inside.select("src", "dst"), moved.select(F.col("node").alias("cell_id")))  # a node has one variant
    named = moved.select("variant", "node").join(found, moved.node == found.cell_id)
    return cut(named.select("variant", "node", F.col("component").alias("comm")))


def _contract(graph: DataFrame, label: DataFrame) -> DataFrame:
    a = label.select("variant", F.col("node").alias("src"), F.col("comm").alias("ca"))
    b = label.select("variant", F.col("node").alias("dst"), F.col("comm").alias("cb"))
    mark = graph.select("variant", F.col("src").alias("ca"), "mark").distinct()
    joined = graph.drop("mark").join(a, ["variant", "src"]).join(b, ["variant", "dst"]).groupBy("variant", "part", "ca", "cb").agg(F.sum("w").alias("w"))
    return joined.join(mark, ["variant", "ca"]).select("variant", "part", F.col("ca").alias("src"), F.col("cb").alias("dst"), "w", "mark")


def detect_communities(edges: DataFrame, resolution: float = 0.6, seed: int = 42) -> DataFrame:
    """One resolution: (cell_id, label)."""
    spark = edges.sparkSession
    variants = spark.createDataFrame([("one", float(resolution))], "variant string, gamma double")
    return communities(edges.select("src", "dst", "weight"), variants, seed).select("cell_id", "label")


def connected_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(cell_id, component): smallest id reachable; min-label exchange plus pointer jumping, so rounds grow with log(diameter)."""
    links = cut(edges.select("src", "dst").filter("src <> dst"))
    state = cut(nodes.select("cell_id", F.col("cell_id").alias("component")))
    while True:
        label = state.select(F.col("cell_id").alias("dst"), F.col("component").alias("c"))
        seen = links.join(label, "dst").groupBy(F.col("src").alias("cell_id")).agg(F.min("c").alias("c"))
        hooked = state.join(seen, "cell_id", "left").select("cell_id", F.col("component").alias("old"), F.least("component", F.coalesce("c", "component")).alias("component"))
        root = hooked.groupBy(F.col("old").alias("r")).agg(F.min("component").alias("to"))  # a component follows its best member
        pulled = hooked.join(root, hooked.component == root.r, "left").select("cell_id", "old", F.least("component", F.coalesce("to", "component")).alias("component"))
        state = cut(pulled)
        if state.filter("old <> component").isEmpty():
            break
    return state.select("cell_id", "component")


def refine_domains(labels: DataFrame, graph: DataFrame, min_cells: int = 30) -> DataFrame:
    """Cells of small within-domain fragments take the most common other label among their spatial neighbours.

    Labels are read before the round, so the result does not depend on visiting order; ties go to the smaller label.
    Domains of a single cell and cells without foreign neighbours stay.
    """
    base = cut(labels.select("cell_id", "label"))
    a = base.select(F.col("cell_id").alias("src"), F.col("label").alias("la"))
    b = base.select(F.col("cell_id").alias("dst"), F.col("label").alias("lb"))
    tagged = cut(graph.select("src", "dst").join(a, "src").join(b, "dst"))
    parts = connected_components(tagged.filter("la = lb"), base)
    size = parts.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    domain = base.groupBy("label").agg(F.count(F.lit(1)).alias("nd"))
    small = parts.join(size, "component").join(base, "cell_id").join(domain, "label").filter(
        (F.col("n") < min_cells) & (F.col("nd") >= 2)).select("cell_id")
    votes = tagged.filter("la <> lb").join(small, tagged.src == small.cell_id, "left_semi").groupBy(F.col("src").alias("cell_id"), "lb").agg(
        F.count(F.lit(1)).alias("n"))
    choice = votes.groupBy("cell_id").agg(F.min_by("lb", F.struct(-F.col("n"), "lb")).alias("to"))
    return base.join(choice, "cell_id", "left").select("cell_id", F.coalesce("to", "label").alias("label"))


def lineage_levels(names: list[str], most: int = 12) -> list[str]:
    """The variants of a lineage table: all, or beyond ``most`` every so-manyth with the last."""
    if len(names) <= most:
        return names
    some = names[::max(1, len(names) // most)]
    return some if some[-1] == names[-1] else [*some, names[-1]]


def lineage(assignments: DataFrame, order: list[str]) -> DataFrame:
    """Overlaps between consecutive variants: cells, share of the parent and of the child cluster."""
    spark = assignments.sparkSession
    steps = spark.createDataFrame(list(zip(order, order[1:])), "variant string, next string")
    a = assignments.join(steps, "variant")
    b = assignments.select(F.col("variant").alias("next"), "cell_id", F.col("label").alias("child"))
    n = a.join(b, ["next", "cell_id"]).groupBy("variant", "next", F.col("label").alias("parent"), "child").agg(F.count(F.lit(1)).alias("n"))
    parent, child = W.partitionBy("variant", "parent"), W.partitionBy("variant", "child")
    return n.withColumn("share_of_parent", F.col("n") / F.sum("n").over(parent)).withColumn("share_of_child", F.col("n") / F.sum("n").over(child))
