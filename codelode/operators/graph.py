"""The import graph of files: degrees, coupling, neighbourhoods, cycles, calls and layers.

Edges are a DataFrame (src, dst). Every operator keeps to equi joins; nothing pairs all files with all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.session import cut

# Folders that name a layer.
LAYERS = (
    "controllers", "routes", "services", "models", "middleware", "utils", "helpers", "config", "lib", "core", "api", "handlers", "repositories",
    "domain", "infrastructure", "presentation", "application",
)

#: Hops that one written step of the search for components takes.
HOPS_AT_ONCE = 6


def edges(imports: DataFrame) -> DataFrame:
    """JOI5: the different resolved edges, without self edges."""
    return imports.where("src is not null and dst is not null and src <> dst").select("src", "dst").distinct()


def degrees(edge: DataFrame) -> DataFrame:
    """AGG4, JOI5: (file, fan_out, fan_in) of every file with an edge."""
    ends = edge.select(F.col("src").alias("file"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edge.select("dst", F.lit(0), F.lit(1)))
    return ends.groupBy("file").agg(F.sum("o").cast("long").alias("fan_out"), F.sum("i").cast("long").alias("fan_in"))


def god_files(edge: DataFrame, chunks: DataFrame, least: int = 5) -> DataFrame:
    """AGG5: files with at least so many outgoing edges, their chunks and total complexity.

    chunks has one row for each id with file_path and cyclomatic_complexity.
    """
    out = edge.groupBy("src").agg(F.count("*").alias("outgoing")).where(F.col("outgoing") >= least)
    sizes = chunks.groupBy("file_path").agg(F.count("*").alias("chunks"), F.sum("cyclomatic_complexity").cast("long").alias("complexity"))
    return out.join(sizes, out.src == sizes.file_path, "left").select(F.col("src").alias("file_path"), "outgoing", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("complexity", F.lit(0)).alias("complexity"))


def coupling(edge: DataFrame, most_shared: int = 1000) -> DataFrame:
    """JOI6-7: (a, b, shared, score), a < b, score = 0.3 [a to b] + 0.3 [b to a] + 0.4 Jaccard, to 3 places.

    Only files that have outgoing edges, and pairs with a score above 0. Candidate pairs come from an
    inverted index on the shared target and from direct edges. A target that more than ``most_shared``
    files import would pair them all in one task; its files are spread over salted blocks, so the work
    divides, and no pair is dropped.
    """
    sizes = edge.groupBy("src").agg(F.count("*").alias("n"))
    importers = edge.groupBy("dst").agg(F.count("*").alias("importers"))
    salts = F.greatest(F.ceil(F.col("importers") / most_shared), F.lit(1)).cast("int")
    dealt = edge.join(importers, "dst").withColumn("salts", salts).withColumn("salt", F.pmod(F.xxhash64("src"), F.col("salts")).cast("int"))
    left = dealt.select("dst", F.col("src").alias("a"), "salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("other"))
    right = dealt.select("dst", F.col("src").alias("b"), F.col("salt").alias("other"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    both = left.join(right, ["dst", "salt", "other"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    has_out = sizes.select(F.col("src").alias("dst"))
    direct = edge.join(has_out, "dst", "left_semi").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).groupBy("a", "b").agg(F.count("*").alias("direct"))
    pairs = both.join(direct, ["a", "b"], "full_outer").na.fill(0, ["shared", "direct"])
    pairs = pairs.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b")
    union = F.col("na") + F.col("nb") - F.col("shared")
    score = F.round(F.least(F.lit(1.0), 0.3 * F.col("direct") + 0.4 * F.col("shared") / union), 3)
    return pairs.select("a", "b", "shared", score.alias("score")).where("score > 0")


def coupling_of(edge: DataFrame, a: str, b: str) -> DataFrame:
    """GRV11: the coupling of two files alone; no row if it is 0."""
    two = edge.where(F.col("src").isin(a, b))
    return coupling(two).where((F.col("a") == min(a, b)) & (F.col("b") == max(a, b)))


def neighbours(edge: DataFrame, seeds: DataFrame, depth: int = 2, by: tuple[str, ...] = ()) -> DataFrame:
    """JOI2: files within so many undirected hops of the seeds (column file), without the seeds, with their distance.

    ``by`` names further columns of the seeds, each value of which has seeds and neighbours of its own.
    """
    key = [*by, "file"]
    around = edge.unionAll(edge.select(F.col("dst"), F.col("src"))).toDF("file", "next").distinct()
    reached = seeds.select(*key).distinct().withColumn("hops", F.lit(0))
    front = reached.select(*key)
    for hop in range(1, depth + 1):
        front = front.join(around, "file").select(*by, F.col("next").alias("file")).distinct().join(reached.select(*key), key, "left_anti")
        reached = reached.unionAll(front.withColumn("hops", F.lit(hop)))
    return reached.where("hops > 0").select(*key, F.col("hops").cast("long").alias("hops"))


def file_calls(edge: DataFrame, chunks: DataFrame) -> DataFrame:
    """JOI3: for each edge the number of chunk pairs it stands for, from counts by file, never the pairs."""
    sizes = chunks.where("file_path is not null").groupBy("file_path").agg(F.count("*").alias("n"))
    found = edge.join(sizes.toDF("src", "a"), "src").join(sizes.toDF("dst", "b"), "dst")
    return found.select("src", "dst", (F.col("a") * F.col("b")).alias("calls"))


def cycles(edge: DataFrame, longest: int = 4) -> DataFrame:
    """GRV1: the different simple cycles of 2 to ``longest`` files, each as its path from its smallest file.

    Paths grow from their smallest file over larger ones only, so each cycle is met once, and only over
    edges that can lie on a cycle: those whose ends have edges in both directions.
    """
    live = edge
    for _ in range(2):
        live = live.join(live.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(live.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
    live = cut(live.select("src", "dst"))
    step = live.select(F.col("src").alias("at"), F.col("dst").alias("to"))
    paths = live.where("src < dst").select(F.col("src").alias("first"), F.col("dst").alias("at"), F.array("src", "dst").alias("path"))
    found: list[DataFrame] = []
    for length in range(2, longest + 1):
        grown = paths.join(step, "at")
        found.append(grown.where("to = first").select(F.array_join("path", " > ").alias("cycle"), F.lit(length).cast("long").alias("length")))
        if length < longest:
            paths = grown.where("to > first").where(~F.array_contains("path", F.col("to"))).select("first", F.col("to").alias("at"), F.concat("path", F.array("to")).alias("path"))
    return reduce(DataFrame.unionAll, found)


def components(edge: DataFrame) -> DataFrame:
    """GRV1: (file, component, files, edges) of every file that lies on a cycle, however long it is.

    A component holds the files that reach one another and is named by its smallest; files and edges are
    its size. Each round gives every file the smallest file that reaches it and the smallest that it
    reaches, by joins repeated until nothing changes. Where the two are equal they name the component; an
    edge whose ends differ in either lies on no cycle. The rest goes into the next round, and the
    smallest file left settles its component in each.
    """
    live, done = edge.select("src", "dst"), []
    while True:
        for _ in range(2):
            live = live.join(live.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(live.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        live = cut(live.select("src", "dst"))
        if live.isEmpty():
            break
        # ahead: from the edge's source to its target; the other way round for what a file reaches; every file also keeps its own
        both = live.select(F.col("src").alias("file"), F.lit(True).alias("ahead"), F.col("dst").alias("to")).unionAll(live.select("dst", F.lit(False), "src"))
        ways = F.explode(F.array(F.lit(True), F.lit(False))).alias("ahead")
        files = live.select(F.explode(F.array("src", "dst")).alias("file")).distinct().select("file", ways)
        step = cut(both.unionAll(files.select("file", "ahead", "file")))
        named = files.withColumn("least", F.col("file"))
        while True:
            seen = named.withColumn("before", F.col("least"))
            for _ in range(HOPS_AT_ONCE):
                told = seen.join(step, ["file", "ahead"]).select(F.col("to").alias("at"), "ahead", "least", F.when(F.col("to") == F.col("file"), F.col("before")).alias("before"))
                seen = told.groupBy(F.col("at").alias("file"), "ahead").agg(F.min("least").alias("least"), F.max("before").alias("before"))
            seen = cut(seen)
            named = seen.select("file", "ahead", "least")
            if seen.where("least < before").isEmpty():
                break
        least = lambda ahead: F.min(F.when(F.col("ahead") == ahead, F.col("least")))
        ends = cut(named.groupBy("file").agg(least(True).alias("reached_by"), least(False).alias("reaches")))
        done.append(ends.where("reached_by = reaches").select("file", F.col("reaches").alias("component")))
        same = live.join(ends.toDF("src", "a", "b"), "src").join(ends.toDF("dst", "c", "d"), "dst")
        live = same.where("a = c and b = d and a <> b").select("src", "dst")
    if not done:
        return edge.sparkSession.createDataFrame([], "file string, component string, files long, edges long")
    # a file alone has no edge inside
    member = reduce(DataFrame.unionAll, done)
    inner = edge.join(member.toDF("src", "component"), "src").join(member.toDF("dst", "other"), "dst").where("component = other")
    edges_in = inner.groupBy("component").agg(F.count("*").alias("edges"))
    sizes = member.groupBy("component").agg(F.count("*").alias("files"))
    return member.join(sizes, "component").join(edges_in, "component").select("file", "component", "files", "edges")


def layer_of(path: Column, layers: list[str] = LAYERS) -> Column:
    """JOI9: the last of the layers whose folder is in the path; null if none is."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    found = F.lit(None).cast("string")
    for layer in layers:
        found = F.when(slashed.contains(f"/{layer}/"), F.lit(layer)).otherwise(found)
    return found


def layer_violations(edge: DataFrame, allowed: list[tuple[str, str]], layers: list[str] = LAYERS) -> DataFrame:
    """JOI8: edges between two layers that no rule allows; without rules there are none."""
    rules = F.array(*(F.lit(f"{a}->{b}") for a, b in allowed)) if allowed else F.array().cast("array<string>")
    named = edge.select("src", "dst", layer_of(F.col("src"), layers).alias("from_layer"), layer_of(F.col("dst"), layers).alias("to_layer"))
    crossing = named.where("from_layer is not null and to_layer is not null and from_layer <> to_layer")
    return crossing.where(~F.array_contains(rules, F.concat_ws("->", "from_layer", "to_layer")) & F.lit(bool(allowed)))


def pattern_label(cycle_count: Column, god_count: Column, violations: Column) -> Column:
    """RUL12: a word for the architecture."""
    return F.when((violations == 0) & (god_count == 0), "Clean Modular").when(god_count >= 3, "Monolith").when(cycle_count >= 2, "Spaghetti").otherwise("Layered")
