"""Graph operators over an edge table (src, dst, kind): src uses dst. All are relational fixpoints.

Every round joins a frontier with the edges and leaves out what is known; rounds are written to the reliable checkpoint
folder, so neither lineage nor a lost executor makes them costly. No result is collected to the driver; only counts are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.plans.session import cut

#: Groups of edge kinds. Carrier edges pass impact on, reference edges for one step.
CARRIER_KINDS = (
    "include", "execute_script", "event_script", "dlg_script", "uses_conversation", "contains", "inventory", "tag_based_script", "module_event", "spawns",
)
REFERENCE_KINDS = (
    "name_ref", "companion", "template", "tag_ref", "quest_ref", "key_tag", "transition_tag", "speaker_tag", "conversation_ref", "module_area", "hak",
    "2da_ref", "literal_match",
)
#: Thresholds of the impact levels.
LEVELS = ("None", "Low", "Medium", "High", "Critical")
CRITICAL_AREAS, CRITICAL_SCRIPTS, HIGH_AREAS, HIGH_SCRIPTS, MEDIUM_AREAS, MEDIUM_TOTAL = 10, 25, 3, 8, 1, 3


def node_type(node: Column) -> Column:
    """area, script, blueprint, conversation ... by the prefix of a node id."""
    p = F.substring_index(node, ":", 1)
    names = {"bp": "blueprint", "dlg": "conversation", "inst": "instance", "var": "variable", "set": "setting"}
    out = p
    for k, v in names.items():
        out = F.when(p == k, v).otherwise(out)
    return out


def fixpoint(start: DataFrame, step: Callable[[DataFrame], DataFrame], key: list[str], rounds: int | None = None) -> DataFrame:
    """``start`` and all that ``step(frontier)`` adds, one row per ``key``: the row of the earliest round (least, if several).

    Ends when a round adds nothing, or after ``rounds``.
    """
    known = frontier = cut(start)
    n = 0
    while (rounds is None or n < rounds) and not frontier.isEmpty():
        n += 1
        new = step(frontier).join(known.select(*key), key, "left_anti")
        rest = [c for c in known.columns if c not in key]
        new = new.groupBy(*key).agg(F.min(F.struct(*rest)).alias("r")).select(*key, "r.*") if rest else new.select(*key).distinct()
        frontier = cut(new.select(*known.columns))
        known = cut(known.unionByName(frontier)) if n % 4 == 0 else known.unionByName(frontier)
    return known


def reachable(edges: DataFrame, roots: DataFrame, avoid: Column | None = None) -> DataFrame:
    """(node, depth): what ``roots`` (node) lead to, in how few steps. Nodes for which ``avoid`` holds (a condition on
    ``node``) are reached but not left. Cycles and self edges do no harm; roots without edges are reached at depth 0."""
    e = cut(edges.where("src <> dst").select("src", "dst").distinct())

    def step(frontier: DataFrame) -> DataFrame:
        go = frontier if avoid is None else frontier.where(~avoid)
        return go.join(e, go["node"] == e["src"]).select(e["dst"].alias("node"), (F.col("depth") + 1).alias("depth"))

    return fixpoint(roots.select("node").distinct().withColumn("depth", F.lit(0)), step, ["node"])


def paths(edges: DataFrame, roots: DataFrame, longest: int = 12) -> DataFrame:
    """(node, depth, path): one shortest path, least in text, from a root to each node, of at most ``longest`` steps."""
    e = cut(edges.where("src <> dst").select("src", "dst").distinct())

    def step(frontier: DataFrame) -> DataFrame:
        return frontier.join(e, frontier["node"] == e["src"]).select(e["dst"].alias("node"), (F.col("depth") + 1).alias("depth"), F.concat_ws(" > ", "path", e["dst"]).alias("path"))

    start = roots.select("node").distinct().select("node", F.lit(0).alias("depth"), F.col("node").alias("path"))
    return fixpoint(start, step, ["node"], longest)


def closure(edges: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """(start, node): every node that each start leads to in one step or more; semi-naive, safe with cycles.

    The result is as large as the relation it states; give ``starts`` (node) to keep to those of interest.
    """
    e = cut(edges.select("src", "dst").distinct())
    first = e if starts is None else e.join(starts.select(F.col("node").alias("src")).distinct(), "src", "left_semi")

    def step(frontier: DataFrame) -> DataFrame:
        return frontier.join(e, frontier["node"] == e["src"]).select("start", e["dst"].alias("node")).distinct()

    return fixpoint(first.select(F.col("src").alias("start"), F.col("dst").alias("node")), step, ["start", "node"])


def impact(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node, how): what is affected if ``start`` (node) changes, walking edges backwards.

    Carrier edges count any number of steps, reference edges one step from the start; ``template`` edges from placed copies
    (inst:) are how='placed' and never walked; a name_ref from a file that also holds typed links doesn't count for scripts,
    blueprints and conversations. how is 'carrier' or 'reference', by the first step. 'soft' are variables that ``start`` or an
    affected node sets (var_set, from variable to setter), what reads them (var_read) and what runs that, where no walk leads; a
    placed copy may be soft as well, in a second row.
    """
    back = cut(edges.where("src <> dst").select("src", "dst", "kind").distinct())
    s = starts.select(F.col("node").alias("start")).distinct()
    first = s.join(back, s["start"] == back["dst"]).select("start", F.col("src").alias("node"), "kind")
    typed = (F.col("kind") == "name_ref") & node_type(F.col("node")).isin("area", "blueprint", "conversation", "module", "instance") & node_type(F.col("start")).isin("script", "blueprint", "conversation")
    how = F.when(F.col("kind").isin(*CARRIER_KINDS), "carrier").when((F.col("kind") == "template") & F.col("node").startswith("inst:"), "placed").when(
        F.col("kind").isin(*REFERENCE_KINDS) & (F.col("kind") != "template") & ~typed, "reference"
    )
    seeds = first.withColumn("how", how).where("how IS NOT NULL").groupBy("start", "node").agg(F.min("how").alias("how"))
    carrier = cut(back.where(F.col("kind").isin(*CARRIER_KINDS)).select("src", "dst").distinct())

    def step(frontier: DataFrame) -> DataFrame:
        go = frontier.where("how <> 'placed'")
        return go.join(carrier, go["node"] == carrier["dst"]).where("src <> start").select("start", carrier["src"].alias("node"), "how")

    hard = fixpoint(seeds, step, ["start", "node"])
    setters = back.where("kind = 'var_set'").select("src", "dst").distinct()
    if setters.isEmpty():
        return hard
    walked = cut(hard.where("how <> 'placed'").select("start", "node").unionByName(s.select("start", F.col("start").alias("node"))))
    passed = cut(back.where((F.col("kind") == "var_read") | F.col("kind").isin(*CARRIER_KINDS)).select("src", "dst").distinct())

    def onward(frontier: DataFrame, by: DataFrame) -> DataFrame:
        return frontier.join(by, frontier["node"] == by["dst"]).select("start", by["src"].alias("node")).distinct().join(walked, ["start", "node"], "left_anti")

    soft = fixpoint(onward(walked, setters), lambda frontier: onward(frontier, passed), ["start", "node"])
    return hard.unionByName(soft.withColumn("how", F.lit("soft")))


def judge(affected: DataFrame, starts: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """(start, level, total, areas, scripts, quests, placed): the impact level of every start (node), 'None' if nothing depends.

    With ``live`` (node), an area, script, blueprint or conversation that isn't live and affects nothing live, softly or not, has
    'None' too; its counts stay. Soft nodes raise the level to 'Low' and aren't counted.
    """
    t = node_type(F.col("node"))
    listed = (F.col("how") != "placed") & ~t.isin("tag", "variable")
    real = listed & (F.col("how") != "soft")
    if live is None:
        affected = affected.withColumn("live", F.lit(None).cast("boolean"))
    else:
        live = live.select("node", F.lit(True).alias("live")).distinct()
        affected = affected.join(live, "node", "left")
    counts = affected.groupBy("start").agg(
        F.count_if(listed & (F.col("how") == "soft")).alias("soft"), F.count_if(listed & F.col("live")).alias("used"),
        F.count_if(real).alias("total"), F.count_if(real & (t == "area")).alias("areas"), F.count_if(real & (t == "script")).alias("scripts"),
        F.count_if(real & (t == "quest")).alias("quests"), F.count_if(F.col("how") == "placed").alias("placed"), F.count_if(real & (t == "module")).alias("module"),
    )
    s = starts.select(F.col("node").alias("start")).distinct().join(counts, "start", "left").na.fill(0)
    dead = F.lit(False)
    if live is not None:
        s = s.join(live.withColumnRenamed("node", "start"), "start", "left")
        dead = node_type(F.col("start")).isin("area", "script", "blueprint", "conversation") & F.col("live").isNull() & (F.col("used") == 0)
    level = (
        F.when(dead | ((F.col("total") == 0) & (F.col("placed") == 0) & (F.col("soft") == 0)), "None")
        .when((F.col("module") > 0) | (F.col("areas") >= CRITICAL_AREAS) | (F.col("scripts") >= CRITICAL_SCRIPTS), "Critical")
        .when((F.col("quests") > 0) | (F.col("areas") >= HIGH_AREAS) | (F.col("scripts") >= HIGH_SCRIPTS), "High")
        .when((F.col("areas") >= MEDIUM_AREAS) | (F.col("total") >= MEDIUM_TOTAL), "Medium")
        .otherwise("Low")
    )
    return s.select("start", level.alias("level"), "total", "areas", "scripts", "quests", "placed")


def breadcrumbs(edges: DataFrame, kinds: tuple[str, ...], most: int = 10) -> DataFrame:
    """(node, depth, trail): for each node that something holds, its holders from the outermost in, joined by " > ".

    Of several holders (src of an edge of ``kinds``) the least counts. A trail ends after ``most`` steps or where it would repeat.
    """
    held = edges.where(F.col("kind").isin(*kinds)).where("src <> dst")
    up = cut(held.groupBy(F.col("dst").alias("at")).agg(F.min("src").alias("holder")))
    trail = up.select(F.col("at").alias("node"), F.col("holder").alias("top"), F.array("holder", "at").alias("path"))
    for _ in range(most - 1):
        grown = trail.join(up, trail["top"] == up["at"], "left")
        more = F.col("holder").isNotNull() & ~F.array_contains("path", F.coalesce("holder", F.lit("")))
        trail = cut(grown.select("node", F.when(more, F.col("holder")).alias("top"), F.when(more, F.array_prepend("path", F.col("holder"))).otherwise(F.col("path")).alias("path")))
        if trail.where("top IS NOT NULL").isEmpty():
            break
    return trail.select("node", (F.size("path") - 1).alias("depth"), F.array_join("path", " > ").alias("trail"))


def first_edges(edges: DataFrame, depths: DataFrame) -> DataFrame:
    """(node, src, kind): the edge by which each node is met first: from the src of least depth, then least kind, then least src.

    ``depths``: (node, depth) of what is met at all."""
    d = depths.select(F.col("node").alias("src"), "depth").distinct()
    e = edges.where("src <> dst").select("src", "dst", "kind").distinct().join(d, "src")
    return e.groupBy(F.col("dst").alias("node")).agg(F.min(F.struct("depth", "kind", "src")).alias("m")).select("node", "m.src", "m.kind")


def longest_chain(edges: DataFrame) -> DataFrame:
    """(node, depth): the most steps that lead on from each node. Nodes on one cycle count as a single node, so that chains end;
    there is no limit to their length, a round is one step."""
    e = cut(edges.where("src <> dst").select("src", "dst").distinct())
    loops = cut(strong_components(e))
    a, b = loops.select(F.col("node").alias("src"), F.col("component").alias("cs")), loops.select(F.col("node").alias("dst"), F.col("component").alias("cd"))
    inner = e.join(a, "src", "left").join(b, "dst", "left").select(F.coalesce("cs", "src").alias("src"), F.coalesce("cd", "dst").alias("dst"))
    inner = cut(inner.where("src <> dst").distinct())
    every = cut(e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct())
    of = every.join(loops, "node", "left").select("node", F.coalesce("component", "node").alias("c"))
    ends = cut(of.select(F.col("c").alias("node")).distinct())
    depth, n = ends.withColumn("depth", F.lit(0)), 0
    while not (ends := cut(ends.join(inner, ends["node"] == inner["dst"]).select(inner["src"].alias("node")).distinct())).isEmpty():
        n += 1
        depth = depth.unionByName(ends.withColumn("depth", F.lit(n)))
        if n % 16 == 0:
            depth = cut(depth.groupBy("node").agg(F.max("depth").alias("depth")))
    return of.join(depth.groupBy("node").agg(F.max("depth").alias("depth")), F.col("c") == depth["node"]).select(of["node"], "depth")


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): nodes on cycles, with the least node of their strongly connected component; self edges count.

    Nodes without a way in or out are trimmed first. Then every node takes the least node that leads to it as its colour; the
    nodes of a colour that lead back to its owner are a component, and the rest goes round again.
    """
    e = cut(edges.select("src", "dst").distinct())
    alone = e.where("src = dst").select(F.col("src").alias("node"))
    e = cut(e.where("src <> dst"))
    found = None
    while True:
        while True:  # trim
            before = e.count()
            ins, outs = e.select(F.col("dst").alias("src")).distinct(), e.select(F.col("src").alias("dst")).distinct()
            e = cut(e.join(ins, "src", "left_semi").join(outs, "dst", "left_semi").select("src", "dst"))
            if e.count() == before:
                break
        if before == 0:
            break
        colour = cut(e.select(F.col("src").alias("node")).distinct().withColumn("c", F.col("node")))
        while True:
            sent = e.join(colour, e["src"] == colour["node"]).groupBy("dst").agg(F.min("c").alias("m"))
            new = cut(colour.join(sent, colour["node"] == sent["dst"], "left").select("node", F.least("c", F.coalesce("m", "c")).alias("c")))
            changed = new.withColumnRenamed("c", "n").join(colour, "node").where("n <> c").isEmpty()
            colour = new
            if changed:
                break
        a, b = colour.withColumnRenamed("node", "src").withColumnRenamed("c", "cs"), colour.withColumnRenamed("node", "dst").withColumnRenamed("c", "cd")
        inner = cut(e.join(a, "src").join(b, "dst").where("cs = cd").select("src", "dst", F.col("cs").alias("c")))

        def step(frontier: DataFrame, inner: DataFrame = inner) -> DataFrame:
            return frontier.join(inner, (frontier["node"] == inner["dst"]) & (frontier["component"] == inner["c"])).select(inner["src"].alias("node"), "component")

        owners = colour.where("node = c").select("node", F.col("c").alias("component"))
        group = cut(fixpoint(owners, step, ["node", "component"]))
        cyclic = group.join(group.groupBy("component").agg(F.count("*").alias("n")).where("n > 1"), "component").select("node", "component")
        found = cyclic if found is None else found.unionByName(cyclic)
        gone = group.select("node")
        e = cut(e.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
    alone = alone.withColumn("component", F.col("node"))
    if found is None:
        return alone
    found = cut(found)
    return found.unionByName(alone.join(found, "node", "left_anti"))


def spread_status(status: DataFrame, edges: DataFrame, from_status: str, over: str, to_status: str) -> DataFrame:
    """(node, status): ``over`` becomes ``to_status`` where any user (src of an edge to the node) has ``from_status``, until
    nothing changes; ``to_status`` itself spreads if it equals ``from_status``."""
    e = cut(edges.where("src <> dst").select("src", "dst").distinct())
    s = cut(status.select("node", "status"))
    open_ = s.where(F.col("status") == over).select("node")

    def step(frontier: DataFrame) -> DataFrame:
        hit = frontier.join(e, frontier["node"] == e["src"]).select(e["dst"].alias("node")).distinct()
        return hit.join(open_, "node", "left_semi")

    seen = fixpoint(s.where(F.col("status") == from_status).select("node"), step, ["node"]) if from_status == to_status else step(s.where(F.col("status") == from_status).select("node"))
    hit = seen.select("node", F.lit(True).alias("hit"))
    return s.join(hit, "node", "left").select("node", F.when(F.col("hit") & (F.col("status") == over), to_status).otherwise(F.col("status")).alias("status"))


def layout(links: DataFrame) -> DataFrame:
    """(node, root, x, y): places of linked nodes relative to the least node of their component, along fewest links; of several ways
    the least place counts. ``links``: src, dst, dx, dy (where dst lies from src); they hold in both directions."""
    both = cut(links.select("src", "dst", "dx", "dy").unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), (-F.col("dx")).alias("dx"), (-F.col("dy")).alias("dy"))).distinct())
    from loomdex.operators.components import components

    start = components(both, "src", "dst").where("node = root").select("node", "root", F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"))

    def step(frontier: DataFrame) -> DataFrame:
        return frontier.join(both, frontier["node"] == both["src"]).select(both["dst"].alias("node"), "root", (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"))

    return fixpoint(start, step, ["node"])
