"""Questions answered from facts, many at once: roots by a gram index, bounded neighbourhoods, evidence, answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import question_intent, search_term
from factloom.operators.answers import policies
from factloom.plans import kept, top_per_key

#: Length of the grams by which terms meet names.
GRAM = 3
#: Of the entities that a term finds, how many are kept and how many are started from; lines of an answer.
FOUND, STARTS, LINES = 10, 5, 12


def _grams(text: Column, n: int, distinct: bool = True) -> Column:
    """The distinct substrings of n characters, or all in their order; none of a shorter text."""
    last = F.length(text) - n + 1
    grams = F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(last > 0, F.array_distinct(grams) if distinct else grams)


def find_roots(terms: DataFrame, entities: DataFrame, limit: int = FOUND) -> DataFrame:
    """question, stable_key, place: for terms(question, term) the first `limit` entities by name and key whose name,
    qualified name or attributes hold the term, whatever the case; % and _ in it count as nothing.

    A term is known by its rarest gram of three characters, where that stands in it, its length and how it begins. A
    text gives the pieces of itself that are cut so around its own grams, and a piece meets the term that it equals: no
    text meets a term that it lacks, however common their grams. Terms of fewer characters are grams themselves, and an
    empty one finds the first entities of all. Equal terms are sought once.
    """
    plain = F.lower(F.regexp_replace("term", "[%_]", ""))
    asked = kept(terms.select("question", plain.alias("term")).where("term is not null"))
    distinct = asked.select("term").distinct()
    texts = [F.lower(F.col(c)) for c in ("name", "qualified_name", "attributes") if c in entities.columns]
    held = entities.select("stable_key", "name", F.array_distinct(F.array_compact(F.array(*texts))).alias("_texts"))
    sizes = [r["n"] for r in distinct.select(F.least(F.length("term"), F.lit(GRAM)).alias("n")).distinct().collect()]  # at most four
    matched = None
    for n in filter(None, sizes):
        own = distinct.where(F.length("term") == n if n < GRAM else F.length("term") >= GRAM).select("term", F.explode(_grams(F.col("term"), n)).alias("gram"))
        grams = held.select(F.explode("_texts").alias("text")).select(F.explode(_grams(F.col("text"), n)).alias("gram"))
        counted = own.join(grams.groupBy("gram").agg(F.count("*").alias("c")), "gram", "left")
        # a term with a gram that no text has is found nowhere: its count is 0, and the gram meets nothing
        rarest = counted.groupBy("term").agg(F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "gram")).alias("g")).select("term", F.col("g.gram").alias("gram"))
        cuts = kept(rarest.select("gram", F.expr("locate(gram, term)").alias("at"), F.length("term").alias("size"), F.substring("term", 1, n).alias("head")).distinct())
        longest = cuts.agg(F.max("size")).first()[0] or 0
        # of a text no more goes along with a gram than the longest term may reach to either side
        i, left = F.col("i") + 1, F.greatest(F.lit(1), F.col("i") + 2 - longest)
        placed = held.select("stable_key", "name", F.explode("_texts").alias("text")).select("stable_key", "name", "text", F.posexplode(_grams(F.col("text"), n, False)).alias("i", "gram"))
        placed = placed.select("stable_key", "name", "gram", i.alias("i"), left.alias("left"), F.substring(F.col("text"), left, F.lit(2 * longest)).alias("around"))
        start = F.col("i") - F.col("at") + 1
        piece = F.substring(F.col("around"), start - F.col("left") + 1, F.col("size"))
        met = placed.join(cuts, "gram").where((start >= 1) & F.startswith(piece, F.col("head")) & (F.length(piece) == F.col("size")))
        near = met.select(piece.alias("term"), "stable_key", "name").join(distinct, "term").distinct()
        matched = near if matched is None else matched.union(near)
    if 0 in sizes:
        first = held.orderBy("name", "stable_key").limit(limit).select(F.lit("").alias("term"), "stable_key", "name")
        matched = first if matched is None else matched.union(first)
    if matched is None:
        matched = held.select(F.lit("").alias("term"), "stable_key", "name").where(F.lit(False))
    order = [F.col("name"), F.col("stable_key")]
    best = top_per_key(matched, ["term"], order, limit)
    best = best.withColumn("place", F.row_number().over(Window.partitionBy("term").orderBy(*order)))
    return asked.join(best, "term").select("question", "stable_key", "place")


def neighbourhoods(starts: DataFrame, asks: DataFrame, entities: DataFrame, relationships: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes(question, stable_key, depth), limits(question, truncated)) of the walks from starts(question, stable_key)
    along asks(question, direction, kinds, max_depth, max_nodes); without kinds along all.

    The walks go on together, a level at a time. A level takes a question's new neighbours in order of key as long as its
    max_nodes lasts; one that is full is truncated and stops. Of a node's neighbours along one direction and some kinds
    only the first max_nodes + 1 by key can matter to a question: it holds max_nodes at most, so either there is room for
    all others or one of these is over. So they are cut, once for all questions at the node, before questions meet them,
    and a hub gives a question no more rows than that.
    """
    asks = kept(asks)
    known = entities.select("stable_key").distinct()
    bounds = asks.agg(F.max("max_depth"), F.max("max_nodes")).first()
    deepest, widest = bounds[0] or 0, bounds[1] or 0
    ways = kept(asks.where("max_depth > 0").select("direction", "kinds").distinct().withColumn("way", F.monotonically_increasing_id()))
    walking = kept(asks.join(ways, ["direction", "kinds"]).select("question", "way", "max_depth"))
    used, any_kind = ways.agg(F.array_distinct(F.flatten(F.collect_set("kinds"))), F.count_if(F.size("kinds") == 0)).first()  # the kinds of edges
    if not any_kind:
        relationships = relationships.where(F.col("kind").isin(*used))
    edges = relationships.select("kind", F.col("source_key").alias("_from"), F.col("target_key").alias("stable_key"), F.lit("incoming").alias("_not"))
    edges = edges.union(relationships.select("kind", "target_key", "source_key", F.lit("outgoing")))
    empty = starts.select("question", "stable_key", F.lit(0).alias("depth")).where(F.lit(False))

    def admitted(new: DataFrame, before: DataFrame, depth: int) -> DataFrame:
        """What of new(question, stable_key) still fits, and a row beyond it where more would: that has `over`."""
        held = before.groupBy("question").agg(F.count("*").alias("_held"))
        first = top_per_key(new, ["question"], [F.col("stable_key")], widest + 1)
        n = F.row_number().over(Window.partitionBy("question").orderBy("stable_key"))
        first = first.withColumn("_n", n).join(held, "question", "left").join(asks.select("question", "max_nodes"), "question")
        room = F.col("max_nodes") - F.coalesce("_held", F.lit(0))
        return first.where(F.col("_n") <= room + 1).select("question", "stable_key", F.lit(depth).alias("depth"), (F.col("_n") > room).alias("over"))

    level = kept(admitted(starts.select("question", "stable_key").distinct().join(known, "stable_key", "left_semi"), empty, 0))
    nodes, full = level.where("not over").drop("over"), level.where("over").select("question")
    for depth in range(1, deepest + 1):
        frontier = level.where("not over").select("question", F.col("stable_key").alias("_from")).join(full, "question", "left_anti")
        frontier = kept(frontier.join(walking.where(F.col("max_depth") >= depth), "question").select("question", "way", "_from"))
        near = frontier.select("way", "_from").distinct().join(edges, "_from").join(ways, "way")
        near = near.where((F.col("direction") != F.col("_not")) & ((F.size("kinds") == 0) | F.array_contains("kinds", F.col("kind"))))
        near = near.select("way", "_from", "stable_key").distinct().join(known, "stable_key", "left_semi").select("way", "_from", "stable_key")
        step = frontier.join(top_per_key(near, ["way", "_from"], [F.col("stable_key")], widest + 1), ["way", "_from"])
        fresh = step.select("question", "stable_key").distinct().join(nodes, ["question", "stable_key"], "left_anti")
        level = kept(admitted(fresh.select("question", "stable_key"), nodes, depth))
        if level.isEmpty():
            break
        nodes = nodes.union(level.where("not over").drop("over"))
        full = full.union(level.where("over").select("question"))
    limits = asks.select("question").join(full.distinct().withColumn("truncated", F.lit(True)), "question", "left")
    return nodes, limits.select("question", F.coalesce("truncated", F.lit(False)).alias("truncated"))


def ask(questions: DataFrame, entities: DataFrame, relationships: DataFrame, places: DataFrame, semantic: DataFrame | None = None) -> DataFrame:
    """question, intent, answer, citations, confidence, truncated, degraded (reasons) of questions(question, text).

    places: stable_key, path, start_line of the entities' sources. semantic: question, id, similarity, the k best chunks
    of each question; None where no chunks are embedded. An intent that walks starts at the first entities that the
    search term finds; what it reaches is the answer's evidence, then come the chunks. Confidence is high with cited
    sources, medium with cited chunks only, else low. An empty question has no intent and is answered as one that nothing matches.
    """
    routed = kept(questions.select("question", question_intent(F.col("text")).alias("intent"), search_term(F.col("text")).alias("term")))
    walking = routed.join(F.broadcast(policies(questions.sparkSession)), "intent")  # eight rows
    roots = kept(find_roots(walking.select("question", "term"), entities))
    asks = walking.join(roots.select("question").distinct(), "question", "left_semi").select("question", "direction", "kinds", "max_depth", "max_nodes")
    nodes, limits = neighbourhoods(roots.where(F.col("place") <= STARTS), asks, entities, relationships)
    nodes = kept(nodes)
    cited = nodes.join(places.select("stable_key", "path", "start_line"), "stable_key").select("question", F.lit("structural").alias("kind"), F.lit(0.0).alias("_less"), "path", "start_line", F.col("stable_key").alias("source"))
    if semantic is not None:
        near = top_per_key(semantic.select("question", "id", "similarity"), ["question"], [F.desc("similarity"), F.col("id")], 6)
        cited = cited.union(near.select("question", F.lit("semantic"), -F.col("similarity"), F.lit(None).cast("string"), F.lit(None).cast("int"), "id"))
    # 'structural' comes after 'semantic' in order, so the order is reversed; a question's references are bounded by its walk
    n = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("kind"), "_less", "path", "start_line", "source"))
    cited = kept(cited.select("question", "kind", "source", n.alias("n")))
    first = cited.where("kind = 'structural'").groupBy("question", F.col("source").alias("stable_key")).agg(F.min("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("question").orderBy("depth", "stable_key"))
    named = nodes.withColumn("place", place).where(F.col("place") <= LINES)
    label = F.coalesce("qualified_name", "name") if "qualified_name" in entities.columns else F.col("name")
    named = named.join(entities.select("stable_key", F.concat_ws(" ", "kind", label).alias("_label")), "stable_key").join(first, ["question", "stable_key"], "left")
    line = F.concat(F.lit("- "), "_label", F.coalesce(F.concat(F.lit(" [E"), "n", F.lit("]")), F.lit("")))
    lines = named.groupBy("question").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n").alias("_lines"))
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("n"))))
    ids = cited.groupBy("question").agg(of("structural").alias("_s"), of("semantic").alias("_c"))
    all_ = routed.join(lines, "question", "left").join(ids, "question", "left").join(limits, "question", "left")
    none = F.array().cast("array<int>")
    known = F.col("_lines").isNotNull()
    chunks = F.when(~known, F.col("_c"))
    citations = F.coalesce(F.when(known, F.col("_s")), chunks, none)
    marked = F.array_join(F.transform(chunks, lambda i: F.concat(F.lit("[E"), i, F.lit("]"))), ", ")
    answer = (
        F.when(known, F.concat(F.lit("Confirmed structural evidence:\n"), "_lines"))
        .when(F.size(chunks) > 0, F.concat(F.lit("Semantic evidence was found, but natural-language synthesis is unavailable. Review "), marked, F.lit(".")))
        .otherwise("No supported canonical or semantic evidence matched this question.")
    )
    sure = F.when(F.size(citations) == 0, "low").when(known, "high").otherwise("medium")
    lost = F.when(~known & F.col("intent").isNotNull() & (F.col("intent") != "semantic_unknown"), F.concat(F.lit("No canonical entity matched "), "term"))
    reasons = F.array_compact(F.array(lost, F.lit("Semantic projection is unavailable" if semantic is None else None).cast("string")))
    return all_.select("question", "intent", answer.alias("answer"), F.transform(citations, lambda i: F.concat(F.lit("E"), i)).alias("citations"), sure.alias("confidence"), F.coalesce("truncated", F.lit(False)).alias("truncated"), reasons.alias("degraded"))
