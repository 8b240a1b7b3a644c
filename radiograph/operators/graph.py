"""The dependency graph: assembly, propagation, best-path traversal, metrics and blind spots."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import bare_name, clean_id
from ..plans import lineage
from ..plans.lineage import cut, small
from ..schema import DYNAMIC, EDGE_TYPES, ORM_CALL, STATIC_SQL, STRUCTURAL, UNRESOLVED_ID, UNRESOLVED_NAME


def propagation(edges: DataFrame) -> DataFrame:
    """prop(u, v, c4, type, seq): what a change of u reaches directly.

    All edges are reversed but the structural ones. Of parallel edges the most confident counts (the first on a tie),
    at the position of the first. What is aggregated are numbers of fixed width, the type as its place among EDGE_TYPES
    (others are `unknown`), so that Spark hashes instead of sorting all edges by two texts.
    """
    return _collapsed(_ends(edges))


def _ends(edges: DataFrame) -> DataFrame:
    structural = F.col("type") == STRUCTURAL
    return edges.select(
        F.when(structural, F.col("source")).otherwise(F.col("target")).alias("u"), F.when(structural, F.col("target")).otherwise(F.col("source")).alias("v"), "c4", "type", "seq",
    )


def _collapsed(ends: DataFrame) -> DataFrame:
    order = F.expr("cast(c4 as decimal(10,0)) * 10000000000000000000 - seq")
    code = F.array_position(F.array(*map(F.lit, EDGE_TYPES)), F.col("type")).cast("int")
    best = ends.groupBy("u", "v").agg(F.max("c4").alias("c4"), F.max_by(code, order).alias("code"), F.min("seq").alias("seq"))
    return best.select("u", "v", "c4", F.element_at(F.array(F.lit("unknown"), *map(F.lit, EDGE_TYPES)), F.col("code") + 1).alias("type"), "seq")


def blast_radius(prop: DataFrame, roots: DataFrame, max_depth: int = 2, least_c4: int = 0) -> DataFrame:
    """(root, node, c4, depth, types, path) for each node that roots(root) reach within max_depth hops.

    The confidence of a path is the product of its edges', rounded to ten-thousandths at each hop; of all paths to a
    node the most confident counts, then the shortest, then the first found. Layers are joined one after the other and
    a node goes on only where it beats what earlier layers found; each layer is written. No path meets a node twice.
    The collapsed edges are written once and read by each layer. For a single hop they are not: there the roots filter the
    edges before parallel ones are collapsed, as they are grouping keys of propagation().
    """
    kind = "array<string>"
    layer = roots.select("root", F.col("root").alias("node"), F.lit(10000).cast("long").alias("c4"), F.array("root").alias("path"), F.array().cast("array<long>").alias("seqs"), F.array().cast(kind).alias("types"))
    best, found = None, None
    step = prop.withColumnRenamed("c4", "w4").withColumnRenamed("type", "step")
    if max_depth > 1:
        step = cut(step)
    else:
        step = step.join(small(cut(roots.select(F.col("root").alias("u")).distinct())), "u", "left_semi")
    for depth in range(1, max_depth + 1):
        c4 = F.expr("(c4 * w4 + 5000) div 10000")
        ahead = layer if depth == 1 else small(layer)
        reached = ahead.join(step, F.col("node") == F.col("u")).where(~F.array_contains("path", F.col("v")))
        reached = reached.select("root", F.col("v").alias("node"), c4.cast("long").alias("c4"), F.concat("path", F.array("v")).alias("path"), F.concat("seqs", F.array("seq")).alias("seqs"), F.concat("types", F.array("step")).alias("types"))
        reached = reached.where(F.col("c4") >= least_c4)
        # The first in order of (-c4, seqs): a minimum, so that it is combined before the shuffle.
        layer = reached.groupBy("root", "node").agg(F.min(F.struct((-F.col("c4")).alias("m"), "seqs", "path", "types")).alias("b"))
        layer = layer.select("root", "node", (-F.col("b.m")).alias("c4"), "b.path", "b.seqs", "b.types")
        if best is not None:
            layer = layer.join(best, ["root", "node"], "left").where("before is null or c4 > before").drop("before")
        layer = cut(layer)
        if max_depth == 1:  # a node has one row
            return layer.select("root", "node", "c4", F.lit(1).alias("depth"), "types", "path")
        here = layer.withColumn("depth", F.lit(depth))
        found = here if found is None else found.unionByName(here)
        if depth < max_depth:
            best = found.groupBy("root", "node").agg(F.max("c4").alias("before"))
    top = F.min(F.struct((-F.col("c4")).alias("m"), "depth", "seqs", "types", "path")).alias("b")
    out = found.groupBy("root", "node").agg(top)
    return out.select("root", "node", (-F.col("b.m")).alias("c4"), "b.depth", "b.types", "b.path")


def reached_parts(edges: DataFrame, roots: DataFrame, max_depth: int = 2, least_c4: int = 0) -> Iterator[tuple[DataFrame, Callable[[str], Column]]]:
    """blast_radius() of edges in parts by node, each with the condition that a column holds one of its nodes.

    For what all nodes reach at once: no table of all collapsed edges is written or shuffled. A hop takes the edges whose
    kinds of nodes lead on from the hop before, in passes by the node reached, so that a part can be reduced before the next
    is made. Of a hop that isn't the last one each pass is written.
    """
    ends, kind = _ends(edges), "array<string>"
    pairs = lineage.kind_pairs(ends, "u", "v")
    every = None if pairs is not None else edges.count()
    first = [r["k"] for r in roots.select(lineage.kind_of("root").alias("k")).distinct().limit(lineage.KINDS + 1).collect()]
    kinds = set(first) if pairs is not None and len(first) <= lineage.KINDS else None if pairs is None else {a for a, _ in pairs}
    layer = cut(roots.select("root", F.col("root").alias("node"), F.lit(10000).cast("long").alias("c4"), F.array("root").alias("path"), F.array().cast("array<long>").alias("seqs"), F.array().cast(kind).alias("types")).distinct())
    found = None
    for depth in range(1, max_depth + 1):
        links, rows, ahead = ends, every, layer
        if pairs is not None:
            met = {x for x in pairs if x[0] in kinds and x[0] is not None and x[1] is not None}
            starts, kinds, rows = {a for a, _ in met}, {b for _, b in met}, sum(pairs[x] for x in met)
            links = ends.where(F.concat(lineage.kind_of("u"), F.lit("\n"), lineage.kind_of("v")).isin([f"{a}\n{b}" for a, b in sorted(met)]))
            ahead = layer.where(lineage.kind_of("node").isin(sorted(starts)))
        ahead, passes, layers = small(ahead), max(1, -(-rows // lineage.PASS_ROWS)), []
        for i in range(passes):
            mine = lambda node, i=i, passes=passes: lineage.part_of(node, passes, i)
            # Dealt by their beginning, edges are collapsed and joined without another shuffle.
            step = _collapsed(links.where(mine("v")).repartition("u")).withColumnRenamed("c4", "w4").withColumnRenamed("type", "step")
            reached = ahead.join(step, F.col("node") == F.col("u")).where(~F.array_contains("path", F.col("v")))
            reached = reached.select("root", F.col("v").alias("node"), F.expr("(c4 * w4 + 5000) div 10000").cast("long").alias("c4"), F.concat("path", F.array("v")).alias("path"), F.concat("seqs", F.array("seq")).alias("seqs"), F.concat("types", F.array("step")).alias("types"))
            reached = reached.where(F.col("c4") >= least_c4).withColumn("depth", F.lit(depth))
            before = None if found is None else found.where(mine("node"))
            both = reached if before is None else reached.unionByName(before)
            top = F.min(F.struct((-F.col("c4")).alias("m"), "depth", "seqs", "types", "path")).alias("b")
            best = both.groupBy("root", "node").agg(top).select("root", "node", (-F.col("b.m")).alias("c4"), "b.path", "b.seqs", "b.types", "b.depth")
            if depth == max_depth:
                yield best.select("root", "node", "c4", "depth", "types", "path"), mine
            else:
                layers.append(cut(best.where(F.col("depth") == depth)))
        if depth < max_depth:
            layer = layers[0]
            for more in layers[1:]:
                layer = layer.unionByName(more)
            found = layer if found is None else found.unionByName(layer)
            layer = layer.drop("depth")


def resolve_targets(nodes: DataFrame, wanted: DataFrame, single_pass: bool = False) -> DataFrame:
    """(target, id): the node that each wanted(target) means, in this order of ways, the first node by seq within a way.

    Its id; `table:` and the lower-case name; a name, id or id without `table:` in any case; what follows any dot of
    such an id. Each node enters all its keys in one pass, each target two. With `single_pass`, as in the second dialect,
    the third way and the fourth are one: what follows a dot may come before a later node's name.
    """
    clean = clean_id(F.col("id"))
    key = lambda exact, way, value: F.struct(F.lit(exact).alias("exact"), F.lit(way).alias("way"), value.alias("k"))
    dotted = F.split(clean, r"\.")
    ends = F.transform(F.sequence(F.lit(2), F.greatest(F.size(dotted), F.lit(2))), lambda i: key(False, 4, F.array_join(F.slice(dotted, i, F.size(dotted)), ".")))
    keys = F.array(
        key(True, 1, F.col("id")), key(False, 2, F.when(F.col("id").startswith("table:"), F.substring("id", 7, 1 << 30))),
        key(False, 3, F.lower("name")), key(False, 3, F.lower("id")), key(False, 3, clean),
    )
    entered = nodes.select("id", "seq", F.explode(F.concat(keys, F.when(F.size(dotted) > 1, ends).otherwise(F.array().cast("array<struct<exact:boolean,way:int,k:string>>")))).alias("e")).select("id", "seq", "e.*").where("k <> ''")
    asked = wanted.select("target").distinct()
    pairs = asked.select("target", F.explode(F.array(F.struct(F.lit(True).alias("exact"), F.col("target").alias("k")), F.struct(F.lit(False).alias("exact"), F.lower("target").alias("k")))).alias("e")).select("target", "e.*")
    way = F.least("way", F.lit(3)).alias("way") if single_pass else F.col("way")
    best = entered.join(pairs, ["exact", "k"]).groupBy("target").agg(F.min(F.struct(way, "seq", "id")).alias("b")).select("target", "b.id")
    return asked.join(best, "target", "left")


def metrics(edges: DataFrame, places: int = 4) -> DataFrame:
    """Cross-layer metrics in one row; the dynamic ratio is in ten-thousandths, rounded to so many places."""
    is_type = lambda t: F.col("type") == t
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    access = is_type(STATIC_SQL) | is_type(ORM_CALL)
    one = edges.agg(
        F.count("*").alias("total_edges"), count(is_type(DYNAMIC)).alias("dynamic"), count(access).alias("resolved"),
        F.count_distinct(F.when(access, F.col("target"))).alias("tables_touched"), F.count_distinct(F.when(access, F.col("source"))).alias("functions_accessing"),
    )
    calls = F.col("dynamic") + F.col("resolved")
    unit = 10**places
    ratio4 = F.coalesce(F.expr(f"(dynamic * {2 * unit} + dynamic + resolved) div nullif(2 * (dynamic + resolved), 0) * {10000 // unit}"), F.lit(0)).cast("long")
    return one.select("total_edges", "dynamic", calls.alias("access_calls"), ratio4.alias("dynamic_ratio_c4"), (ratio4 > 4000).alias("warning"), "tables_touched", "functions_accessing")


def blind_spots(nodes: DataFrame, edges: DataFrame, most: int = 10) -> DataFrame:
    """(kind, severity, n, examples): what the graph cannot show; never empty."""
    dynamic = edges.where(F.col("type") == DYNAMIC)
    first = dynamic.groupBy("source").agg(F.min("seq").alias("seq")).orderBy("seq", "source").limit(most).agg(F.sort_array(F.collect_list(F.struct("seq", "source"))).alias("x"))
    calls = dynamic.agg(F.count("*").alias("n"))
    severity = F.when(F.col("n") > 5, "high").when(F.col("n") > 0, "medium").otherwise("info")
    one = calls.crossJoin(first).select(F.lit("dynamic_unresolved_sql").alias("kind"), severity.alias("severity"), "n", F.array_join("x.source", ",").alias("examples"))
    two = calls.select(F.lit("cross_service_boundary").alias("kind"), F.lit("medium").alias("severity"), F.lit(0).cast("long").alias("n"), F.lit("").alias("examples"))
    missing = unreferenced(nodes, edges)
    top = missing.orderBy("name").limit(most).agg(F.sort_array(F.collect_list("name")).alias("x"))
    three = missing.agg(F.count("*").alias("n")).crossJoin(top).where("n > 0").select(F.lit("unreferenced_tables").alias("kind"), F.lit("low").alias("severity"), "n", F.array_join("x", ",").alias("examples"))
    return one.unionByName(two).unionByName(three)


def unreferenced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name): tables and views, by lower-case name, that no code edge touches by clean id."""
    touched = edges.where(F.col("type").isin(STATIC_SQL, ORM_CALL)).select(clean_id(F.col("target")).alias("name")).distinct()
    return nodes.where(F.col("type").isin("table", "view")).select(F.lower("name").alias("name")).distinct().join(touched, "name", "left_anti")


def reconciled(code_edges: DataFrame, tables: DataFrame) -> DataFrame:
    """code_edges with their targets resolved to tables(id, name, seq): a bare name to its first table, a qualified one to itself."""
    by_name = tables.groupBy(F.lower("name").alias("key")).agg(F.min(F.struct("seq", "id")).alias("b")).select("key", "b.id", F.lit(1).alias("rank"))
    by_id = tables.groupBy(clean_id(F.col("id")).alias("key")).agg(F.max(F.struct("seq", "id")).alias("b")).select("key", "b.id", F.lit(0).alias("rank"))
    lookup = by_name.unionByName(by_id).groupBy("key").agg(F.min(F.struct("rank", "id")).alias("b")).select("key", F.col("b.id").alias("resolved"))
    return code_edges.withColumn("key", clean_id(F.col("target"))).join(lookup, "key", "left").withColumn("target", F.coalesce("resolved", "target")).drop("key", "resolved")


def assembled_graph(database_nodes: DataFrame, database_edges: DataFrame, code_nodes: DataFrame, code_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of both layers; nodes(seq, id, type, name, source_system), edges(seq, source, target, type, c4).

    Code edges find the tables they name; a table that is unknown then becomes a node inferred from code, and the
    unresolved sink is added where an edge asks for it. Of nodes with one id the code's counts.
    """
    tables = database_nodes.where(F.col("type").isin("table", "view", "partition"))
    found = reconciled(code_edges, tables).select(*code_edges.columns)
    columns = ["seq", "id", "type", "name", "source_system"]
    layers = database_nodes.select(*columns, F.lit(0).alias("layer")).unionByName(code_nodes.select(*columns, F.lit(1).alias("layer")))
    known = layers.groupBy("id").agg(F.max_by(F.struct("type", "name", "source_system"), F.struct("layer", "seq")).alias("b"), F.min("seq").alias("seq")).select("seq", "id", "b.*")
    asked = found.where(F.col("target").startswith("table:")).groupBy(F.col("target").alias("id")).agg(F.min("seq").alias("seq"))
    unknown = asked.join(known.select("id"), "id", "left_anti")
    sink = F.col("id") == UNRESOLVED_ID
    name = F.when(sink, UNRESOLVED_NAME).otherwise(bare_name(F.col("id")))
    inferred = unknown.select("seq", "id", F.lit("table").alias("type"), name.alias("name"), F.when(sink, "unresolved").otherwise("code_inferred").alias("source_system"))
    edges = database_edges.unionByName(found.select(*database_edges.columns))
    return known.unionByName(inferred), edges


def registered_graph(catalog: DataFrame, code: DataFrame, edges: DataFrame) -> DataFrame:
    """(seq, id, type, name, source_system) of the second dialect's graph: of nodes with one id the first counts, the catalog's before the code's; each table that an edge points at is registered."""
    columns = ["seq", "id", "type", "name", "source_system"]
    asked = edges.where(F.col("target").startswith("table:")).select("seq", F.col("target").alias("id"), F.lit("table").alias("type"), F.replace("target", F.lit("table:"), F.lit("")).alias("name"), F.lit("inferred_from_code").alias("source_system"))
    layers = [rows.select(*columns, F.lit(i).alias("layer")) for i, rows in enumerate((catalog, code, asked))]
    first = F.min(F.struct("layer", "seq", "type", "name", "source_system")).alias("b")
    return layers[0].unionByName(layers[1]).unionByName(layers[2]).groupBy("id").agg(first).select("b.seq", "id", "b.type", "b.name", "b.source_system")


def endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with the types and names of both ends; an end that is no node is `unknown` and bears its id."""
    own = nodes.select(F.col("id").alias("_id"), F.col("type").alias("_type"), F.col("name").alias("_name"))
    out = edges
    for end in ("source", "target"):
        out = out.join(own, F.col(end) == F.col("_id"), "left")
        out = out.withColumn(f"{end}_type", F.coalesce("_type", F.lit("unknown"))).withColumn(f"{end}_name", F.coalesce("_name", end)).drop("_id", "_type", "_name")
    return out


def distinct_blind_spots(spots: DataFrame) -> DataFrame:
    """Blind spots of several results, spots(root, seq, kind, severity, message): each message once, as it first came."""
    return spots.groupBy("message").agg(F.min(F.struct("seq", "root", "kind", "severity")).alias("b"), F.count("*").alias("n")).select("message", "b.root", "b.kind", "b.severity", "n")


def named_ends(reached: DataFrame, nodes: DataFrame, edges: DataFrame, mine: Callable[[str], Column] | None = None) -> DataFrame:
    """(root, node, type, name, c4, depth, listed) of a blast radius in the second dialect, which knows no tiers.

    A node that isn't known is a file or a table, by the end at which the first edge that has it names it. listed is
    where a result shows it: functions, files or tables; partitions count in the total only. `mine` is the condition of a
    part of reached_parts().
    """
    ends = [edges.select(F.col(c).alias("node"), "seq", F.lit(kind).alias("kind")) for c, kind in (("source", "file"), ("target", "table"))]
    if mine is not None:
        nodes, ends = nodes.where(mine("id")), [e.where(mine("node")) for e in ends]
    told = small(cut(reached.select("node").distinct().join(nodes.select(F.col("id").alias("node")), "node", "left_anti")))
    kinds = [r["k"] for r in told.select(lineage.kind_of("node").alias("k")).distinct().limit(lineage.KINDS + 1).collect()]
    if len(kinds) <= lineage.KINDS:
        ends = [e.where(lineage.kind_of("node").isin(kinds)) for e in ends]
    first = ends[0].unionByName(ends[1]).join(told, "node", "left_semi").groupBy("node").agg(F.min(F.struct("seq", "kind"))["kind"].alias("kind"))
    out = reached.join(nodes.select(F.col("id").alias("node"), "type", "name"), "node", "left").join(first, "node", "left")
    kind = F.coalesce("type", "kind")
    listed = F.when(kind == "function", "functions").when(kind == "file", "files").when(kind.isin("table", "view"), "tables")
    return out.select("root", "node", kind.alias("type"), F.coalesce("name", "node").alias("name"), "c4", F.col("depth").cast("long").alias("depth"), listed.alias("listed"))


def tree_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(nodes, edges, dynamic, dynamic_tenths): the counts of an overview, with the share of unresolved calls among all edges in tenths of a per cent."""
    one = edges.agg(F.count("*").alias("edges"), F.coalesce(F.sum((F.col("type") == DYNAMIC).cast("long")), F.lit(0)).alias("dynamic"))
    tenths = F.coalesce(F.expr("(dynamic * 2000 + edges) div nullif(2 * edges, 0)"), F.lit(0)).cast("long")
    return nodes.agg(F.count("*").alias("nodes")).crossJoin(one).select("nodes", "edges", "dynamic", tenths.alias("dynamic_tenths"))
