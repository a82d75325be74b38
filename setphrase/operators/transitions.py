"""Transition graphs from phrase contexts: word graphs (Markov) and prefix trees, pruning, reachability, extension.

An edge table is (direction, src array<string>, dst array<string>, freq, prob). Nodes of a word
graph are arrays of one word; nodes of a tree are paths from <PHRASE>.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from setphrase.functions import tokens as T
from setphrase.functions.lineage import cut
from setphrase.operators import context

ROOT = "<PHRASE>"


def counts(ctx: DataFrame, tree: bool = True, min_word_prob: float = 0.1, variant_of: DataFrame | None = None, exclude_var: bool = False) -> DataFrame:
    """(direction, src, dst, freq). Words that too few contexts hold become numbered slots; pre contexts are read backwards."""
    chosen = context.selected_words(ctx, variant_of, min_word_prob).groupBy("direction").agg(F.collect_set("word").alias("chosen"))
    rows = context.normalised_words(ctx, variant_of).join(chosen, "direction", "left")
    words = F.when(F.col("direction") == "pre", F.reverse("words")).otherwise(F.col("words"))
    rows = rows.withColumn("path", F.concat(F.array(F.lit(ROOT)), T.slots_numbered(words, F.coalesce("chosen", F.array().cast("array<string>")))))
    if exclude_var:
        first = F.array_min(F.filter(F.transform("path", lambda w, i: F.when(w.startswith("<VAR"), i)), lambda i: i.isNotNull()))
        rows = rows.withColumn("path", F.when(first.isNotNull(), F.slice("path", F.lit(1), first)).otherwise(F.col("path")))
    steps = rows.where(F.size("path") > 1).select("direction", "path", "freq", F.explode(F.sequence(F.lit(1), F.size("path") - 1)).alias("i"))
    if tree:
        src, dst = F.slice("path", F.lit(1), F.col("i")), F.slice("path", F.lit(1), F.col("i") + 1)
    else:
        src, dst = F.array(F.get("path", F.col("i") - 1)), F.array(F.get("path", F.col("i")))
    return steps.select("direction", src.alias("src"), dst.alias("dst"), "freq").groupBy("direction", "src", "dst").agg(F.sum("freq").alias("freq"))


def shares(edges: DataFrame) -> DataFrame:
    """Edges with prob: the share of all that leaves the source."""
    return edges.withColumn("prob", F.col("freq") / F.sum("freq").over(Window.partitionBy("direction", "src")))


def pruned_words(edges: DataFrame, min_prob: float = 0.01) -> DataFrame:
    return edges.where(F.col("prob") >= min_prob)


def pruned_tree(edges: DataFrame, min_prob: float = 0.1) -> DataFrame:
    """Edges all of whose edges from the root on are likely enough: one join with the prefixes, no recursion."""
    path = edges.select("direction", F.col("dst").alias("node"), F.explode(F.transform(F.sequence(F.lit(2), F.size("dst")), lambda n: F.slice("dst", F.lit(1), n))).alias("dst"))
    weak = path.join(edges.where(F.col("prob") < min_prob).select("direction", "dst"), ["direction", "dst"]).select("direction", F.col("node").alias("dst")).distinct()
    return edges.join(weak, ["direction", "dst"], "left_anti").select(*edges.columns)


def reachable(edges: DataFrame, start: str = ROOT, depth: int | None = None) -> DataFrame:
    """(direction, node): nodes that can be reached from the start, in at most ``depth`` steps if given; every round joins only what is new, until nothing is."""
    edges = cut(edges.select("direction", "src", "dst"))
    seen = cut(edges.select("direction").distinct().withColumn("node", F.array(F.lit(start))))
    new = seen
    for step in count():
        if step == depth:
            break
        onward = edges.join(new.withColumnRenamed("node", "src"), ["direction", "src"]).select("direction", F.col("dst").alias("node")).distinct()
        new = cut(onward.join(seen, ["direction", "node"], "left_anti"))
        if new.isEmpty():
            break
        seen = cut(seen.unionByName(new))
    return seen


def pruned(edges: DataFrame, min_prob: float = 0.1, tree: bool = True, depth: int | None = None) -> DataFrame:
    """Likely edges whose source can be reached from the phrase."""
    if tree:
        return pruned_tree(edges, min_prob)
    kept = cut(pruned_words(edges, min_prob))
    return kept.join(reachable(kept, depth=depth).withColumnRenamed("node", "src"), ["direction", "src"], "left_semi").select(*edges.columns)


def probabilities(ctx: DataFrame, min_prob: float = 0.1, min_word_prob: float = 0.1, variant_of: DataFrame | None = None, tree: bool = True, exclude_var: bool = False) -> DataFrame:
    return pruned(shares(counts(ctx, tree, min_word_prob, variant_of, exclude_var)), min_prob, tree)


def extensions(edges: DataFrame, min_split_prob: float = 0.1, min_extend_prob: float = 0.9, depth: int | None = None) -> DataFrame:
    """(direction, path, prob, kind) of a word graph: likely continuations of the phrase.

    Paths whose probability from the phrase stays at least min_split_prob, without slots, steps
    to the same word or words met more than twice. A path at min_extend_prob is "main" and takes
    its parent's place; a less likely one is "split" and takes the place of a split parent.
    No path has a word three times, so rounds end; ``depth`` ends them before.
    """
    edges = cut(edges.select("direction", "src", "dst", "prob"))
    step = edges.where(F.size("dst") == 1).select("direction", F.col("src")[0].alias("a"), F.col("dst")[0].alias("b"), "prob").where(~F.col("b").contains("<VAR-"))
    paths = cut(edges.select("direction").distinct().select("direction", F.array(F.lit(ROOT)).alias("path"), F.lit(1.0).alias("p"), F.lit(True).alias("main")))
    every, new = paths, paths
    for step_ in count():
        if step_ == depth:
            break
        tail = new.withColumn("a", F.element_at("path", -1)).join(step, ["direction", "a"]).where("a <> b")
        grown = tail.select("direction", F.concat("path", F.array("b")).alias("path"), (F.col("p") * F.col("prob")).alias("p"))
        grown = grown.where((F.col("p") >= min_split_prob) & (F.size(F.filter("path", lambda w: w == F.element_at("path", -1))) <= 2))
        new = cut(grown.withColumn("main", F.col("p") >= min_extend_prob))
        if new.isEmpty():
            break
        every = every.unionByName(new)
    parents = every.where(F.size("path") > 1).select("direction", F.slice("path", F.lit(1), F.size("path") - 1).alias("path"), F.col("main").alias("by_main"))
    covered = parents.groupBy("direction", "path").agg(F.max("by_main").alias("by_main"))
    left = every.join(covered, ["direction", "path"], "left")
    # a main path goes if a main one continues it, a split path if any does
    kept = left.where(F.col("by_main").isNull() | (F.col("main") & ~F.col("by_main")))
    return kept.select("direction", "path", F.col("p").alias("prob"), F.when(F.col("main"), "main").otherwise("split").alias("kind"))


def extended_phrases(phrase: str, ext: DataFrame) -> DataFrame:
    """(kind, phrase): the main phrase, and a phrase for each split path on either side of it."""
    words = F.slice("path", F.lit(2), F.greatest(F.size("path") - 1, F.lit(0)))
    mains = ext.where("kind = 'main'").groupBy().pivot("direction", ["pre", "post"]).agg(F.max_by("path", F.size("path")))
    side = lambda c, back: F.coalesce(F.array_join(F.reverse(F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0)))) if back else F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0))), " "), F.lit(""))
    main = mains.select(F.trim(F.concat_ws(" ", side(F.col("pre"), True), F.lit(phrase), side(F.col("post"), False))).alias("main"), F.greatest(F.coalesce(F.size("post"), F.lit(1)), F.lit(1)).alias("done"))
    splits = ext.where("kind = 'split'").join(F.broadcast(main))  # one row
    before = F.trim(F.concat_ws(" ", F.array_join(F.reverse(words), " "), F.col("main")))
    after = F.trim(F.concat_ws(" ", F.col("main"), F.array_join(F.slice("path", F.col("done") + 1, F.greatest(F.size("path") - F.col("done"), F.lit(0))), " ")))
    found = splits.where("direction = 'pre' or size(path) > done").select(F.lit("split").alias("kind"), F.when(F.col("direction") == "pre", before).otherwise(after).alias("phrase"))
    return main.select(F.lit("main").alias("kind"), F.col("main").alias("phrase")).unionByName(found)


def extend_phrase(phrase: str, ctx: DataFrame, variant_of: DataFrame | None = None, min_prob: float = 0.1, min_word_prob: float = 0.1) -> DataFrame:
    """From contexts of a phrase to its extensions."""
    edges = probabilities(ctx.where(F.col("phrase") == phrase), min_prob, min_word_prob, variant_of, tree=False)
    return extended_phrases(phrase, extensions(edges))


def dot(edges: DataFrame, phrase: str, direction: str, exclude_var: bool = False, depth: int | None = None) -> DataFrame:
    """(line_no, line): Graphviz text of what can be reached in one direction; arrows of pre graphs point at the phrase."""
    own = cut(edges.where(F.col("direction") == direction))
    if exclude_var:
        own = own.where(~F.element_at("src", -1).startswith("<VAR"))
    own = own.join(reachable(own, depth=depth).withColumnRenamed("node", "src"), ["direction", "src"], "left_semi")
    name = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.array_join(F.transform(c, lambda w: F.when(w == ROOT, F.lit(phrase)).otherwise(w)), " "), '"', "'"), F.lit('"'))
    a, b = (name(F.col("dst")), name(F.col("src"))) if direction == "pre" else (name(F.col("src")), name(F.col("dst")))
    lines = own.select(F.concat(F.lit("  "), a, F.lit(" -> "), b, F.lit(' [label="'), F.format_number("prob", 2), F.lit('"];')).alias("line"))
    numbered = lines.withColumn("line_no", F.row_number().over(Window.orderBy("line")))
    return numbered.select("line_no", "line").unionByName(edges.sparkSession.createDataFrame([(0, "digraph {"), (1 << 30, "}")], "line_no int, line string"))
