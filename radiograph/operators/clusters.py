"""Which tables belong together: co-occurrence and prefix projections, communities, and measures of a partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import bare_name
from ..plans.lineage import cut
from ..plans.numbering import numbered


def cooccurrence(touches: DataFrame) -> DataFrame:
    """(a, b, w), a < b: in how many groups two items stand together; touches(group, item).

    The pairs of a group are its items' join with themselves; groups are orders or functions, which touch few items.
    """
    t = touches.distinct()
    return t.alias("x").join(t.alias("y"), (F.col("x.group") == F.col("y.group")) & (F.col("x.item") < F.col("y.item"))).groupBy(F.col("x.item").alias("a"), F.col("y.item").alias("b")).agg(F.count("*").alias("w"))


def degrees(pairs: DataFrame) -> DataFrame:
    """(node, degree): weighted."""
    return pairs.select(F.explode(F.array("a", "b")).alias("node"), "w").groupBy("node").agg(F.sum("w").alias("degree"))


def communities(pairs: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, community): local moves for modularity, all nodes of one half at a time, the halves by turns, until neither moves.

    A round moves each node of a half (by hash of node and round) to the neighbouring community with the largest gain
    if that is positive. Ties go to the smallest community. Communities bear the name of a member. As the nodes of a half
    move together, a few may go on trading places; the rounds end after `most_rounds` in any case.
    """
    both = cut(pairs.select(F.col("a").alias("node"), F.col("b").alias("other"), F.col("w").cast("double").alias("w")).union(pairs.select("b", "a", F.col("w").cast("double"))))
    degree = cut(both.groupBy("node").agg(F.sum("w").alias("k")))
    total = degree.agg(F.sum("k")).first()[0] or 1.0
    of, idle = degree.select("node", F.col("node").alias("community"), "k"), 0
    for turn in range(most_rounds):
        sizes = of.groupBy("community").agg(F.sum("k").alias("size"))
        links = both.join(of.select(F.col("node").alias("other"), "community"), "other").groupBy("node", "community").agg(F.sum("w").alias("w"))
        own = of.select("node", F.col("community").alias("now"), "k")
        gains = links.join(own, "node").join(sizes, "community")
        gain = F.col("w") - F.col("k") * (F.col("size") - F.when(F.col("community") == F.col("now"), F.col("k")).otherwise(0.0)) / F.lit(float(total))
        stay = gains.where("community = now").select("node", gain.alias("g0"))
        best = gains.where(F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(2)) == 0).groupBy("node").agg(F.min(F.struct((-F.round(gain, 9)).alias("g"), "community")).alias("b"))
        move = best.join(stay, "node", "left").where(-F.col("b.g") > F.coalesce(F.round("g0", 9), F.lit(0.0)) + 1e-9).select("node", F.col("b.community").alias("to"))
        of = cut(of.join(move, "node", "left").select("node", F.coalesce("to", "community").alias("community"), "k", F.col("to").isNotNull().alias("moved")))
        idle = 0 if of.where("moved").limit(1).count() else idle + 1
        of = of.drop("moved")
        if idle == 4:  # four random halves in a row
            break
    return of.select("node", "community")


#: Words that say nothing about what a table belongs to. Fixed values.
DULL_WORDS = ("model", "data", "item", "items", "type", "types", "table", "info", "custom", "base", "assigned", "entry", "entries", "record", "records")


def clustered_tables(nodes: DataFrame) -> DataFrame:
    """(id, name): what is clustered: tables, and whatever bears a table's id (views, partitions, the unresolved sink)."""
    return nodes.where((F.col("type") == "table") | F.col("id").startswith("table:")).select("id", bare_name(F.col("id")).alias("name"))


def relatedness(tables: DataFrame, edges: DataFrame, with_code: bool = True, with_prefix: bool = True, code_c4: int = 5000, prefix_c4: int = 9200) -> DataFrame:
    """(a, b, w), a < b: how much two of tables(id, name) belong together, in ten-thousandths, all reasons summed.

    Edges between them count with their confidence; each function or file that touches both, and a common first word of
    three letters or more before an underscore, with a weight of its own.
    """
    ids = tables.select("id")
    ends = edges.join(ids.select(F.col("id").alias("source"), F.lit(True).alias("s")), "source", "left").join(ids.select(F.col("id").alias("target"), F.lit(True).alias("t")), "target", "left")
    pair = [F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")]
    out = ends.where("s and t and source <> target").select(*pair, F.col("c4").alias("w"))
    if with_code:
        touches = ends.where("s is distinct from t").select(F.when(F.col("s"), F.col("target")).otherwise(F.col("source")).alias("group"), F.when(F.col("s"), F.col("source")).otherwise(F.col("target")).alias("item"))
        out = out.union(cooccurrence(touches).select("a", "b", F.col("w") * code_c4))
    if with_prefix:
        prefix = F.split("name", "_")[0]
        named = tables.where(F.col("name").contains("_") & (F.length(prefix) >= 3)).select(prefix.alias("group"), F.col("id").alias("item"))
        out = out.union(cooccurrence(named).select("a", "b", F.col("w") * prefix_c4))
    return out.groupBy("a", "b").agg(F.sum("w").alias("w"))


def cluster_labels(members: DataFrame) -> DataFrame:
    """(community, label) of members(community, name, hub): a title from the words that stand most often in the names.

    Words are parts of three letters or more; ties go to the word that comes first, name by name. The most common first
    word leads if it is among the three most common of all; another one of four letters or more follows. Counts are
    taken word by word, so that no community is gathered.
    """
    words = F.filter(F.split(F.lower("name"), "[_\\W]+"), lambda w: F.length(w) >= 3)
    each = members.select("community", "name", F.posexplode(words).alias("place", "word"))
    order = F.min(F.struct("name", "place"))
    counts = each.groupBy("community", "word").agg(F.count("*").alias("n"), order.alias("at"), F.sum((F.col("place") == 0).cast("long")).alias("firsts"), F.min(F.when(F.col("place") == 0, F.col("name"))).alias("first_at"))
    rank = lambda n, *at: F.row_number().over(Window.partitionBy("community").orderBy(F.desc(n), *at))
    top = counts.where(~F.col("word").isin(*DULL_WORDS)).withColumn("rank", rank("n", "at")).where("rank <= 3").groupBy("community").agg(F.sort_array(F.collect_list(F.struct("rank", "word"))).alias("x"))
    prefix = counts.where("firsts > 0").withColumn("rank", rank("firsts", "first_at", "word")).where("rank = 1").select("community", F.col("word").alias("prefix"))
    base = members.groupBy("community").agg(F.count("*").alias("size"), F.min("name").alias("name"), F.min("hub").alias("hub"))
    rows = base.join(top, "community", "left").join(prefix, "community", "left").withColumn("top", F.coalesce(F.transform("x", lambda x: x["word"]), F.array().cast("array<string>")))
    capital = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))
    rows = rows.withColumn("primary", capital(F.when(F.array_contains("top", F.col("prefix")), F.col("prefix")).otherwise(F.coalesce(F.get("top", 0), F.col("hub")))))
    second = F.get(F.filter("top", lambda w: (capital(w) != F.col("primary")) & (F.length(w) >= 4)), 0)
    title = F.concat("primary", F.coalesce(F.concat(F.lit(" & "), capital(second)), F.lit("")), F.lit(" Domain"))
    return rows.select("community", F.when(F.col("size") == 1, F.concat(capital(F.col("name")), F.lit(" Module"))).otherwise(title).alias("label"))


def described(tables: DataFrame, pairs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clusters, isolated) of tables(id, name), their relatedness and labels(node, community).

    clusters(place, community, label, hub, size, density_c4, inner_weight), by size, then community; isolated(name): tables without relations.
    """
    related = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    isolated = tables.join(related, "id", "left_anti").select("name")
    held = cut(labels.join(related.withColumnRenamed("id", "node"), "node", "left_semi"))
    sizes = density(pairs, held)
    inner = pairs.join(held.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(held.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b").where("ca = cb")
    hubs = held.join(degrees(inner.select("a", "b", "w")), "node", "left").groupBy("community").agg(F.min(F.struct((-F.coalesce("degree", F.lit(0))).alias("d"), "node"))["node"].alias("id"))
    hubs = hubs.join(tables, "id").select("community", F.col("name").alias("hub"))
    named = held.join(tables.withColumnRenamed("id", "node"), "node").join(hubs, "community").select("community", "name", "hub")
    rows = sizes.drop("hub").join(hubs, "community").join(cluster_labels(named), "community")
    rows = numbered(rows.select("community", "label", "hub", "size", "density_c4", "inner_weight"), F.desc("size"), "community")
    return rows.select("place", "community", "label", "hub", "size", "density_c4", "inner_weight"), isolated


def cluster_catalog(nodes: DataFrame, edges: DataFrame, with_code: bool = True, with_prefix: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clusters, isolated, modularity) of the tables of a graph; see described()."""
    tables = clustered_tables(nodes)
    pairs = cut(relatedness(tables, edges, with_code, with_prefix))
    labels = communities(pairs)
    clusters, isolated = described(tables, pairs, labels)
    return clusters, isolated, modularity(pairs, labels)


def density(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """(community, size, inner_pairs, inner_weight, density_c4, hub): hub is the member with the largest degree, then the smallest name."""
    inner = pairs.join(labels.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(labels.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b")
    inside = inner.where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.count("*").alias("inner_pairs"), F.sum("w").alias("inner_weight"))
    members = labels.join(degrees(pairs), "node", "left").groupBy("community").agg(F.count("*").alias("size"), F.min(F.struct((-F.coalesce("degree", F.lit(0))).alias("d"), "node")).alias("h"))
    out = members.join(inside, "community", "left").select("community", "size", F.coalesce("inner_pairs", F.lit(0)).alias("inner_pairs"), F.coalesce("inner_weight", F.lit(0)).alias("inner_weight"), F.col("h.node").alias("hub"))
    full = F.expr("case when size < 2 then 10000 else (inner_pairs * 2 * 10000) div (size * (size - 1)) end")
    return out.withColumn("density_c4", full.cast("long"))


def modularity(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """(q): the modularity of a partition, rounded to six places; 0 without edges."""
    both = pairs.join(labels.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(labels.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b")
    inner = both.where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.sum("w").alias("inner"))
    total = degrees(pairs).join(labels, "node").groupBy("community").agg(F.sum("degree").alias("d")).join(inner, "community", "left")
    m = pairs.agg(F.sum("w").alias("m"))
    return total.crossJoin(m).agg(F.round(F.coalesce(F.sum(F.coalesce("inner", F.lit(0)) / F.col("m") - (F.col("d") / (2 * F.col("m"))) * (F.col("d") / (2 * F.col("m")))), F.lit(0.0)), 6).alias("q"))


def adjusted_rand_index(rows: DataFrame) -> DataFrame:
    """(ari) of rows(t, p), two labels of the same things; 1 for fewer than two, rounded to six places."""
    cells = rows.groupBy("t", "p").agg(F.count("*").alias("n"))
    comb = lambda c: F.coalesce(F.sum(F.expr(f"{c} * ({c} - 1) / 2.0").cast("double")), F.lit(0.0))
    sums = cells.agg(comb("n").alias("both"), F.sum("n").alias("total"))
    a = cells.groupBy("t").agg(F.sum("n").alias("n")).agg(comb("n").alias("a"))
    b = cells.groupBy("p").agg(F.sum("n").alias("n")).agg(comb("n").alias("b"))
    return sums.crossJoin(a).crossJoin(b).select(F.round(F.expr(
        "case when coalesce(total, 0) < 2 or (a + b) / 2 = a * b / (total * (total - 1) / 2.0) then 1.0 else (both - a * b / (total * (total - 1) / 2.0)) / ((a + b) / 2 - a * b / (total * (total - 1) / 2.0)) end"
    ).cast("double"), 6).alias("ari"))
