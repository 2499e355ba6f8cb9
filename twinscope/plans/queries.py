"""The operators applied to the tables, under the names that the driver runs."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinscope.functions import metrics, sketches
from twinscope.functions.imports import import_findings
from twinscope.functions.text import word_shingles
from twinscope.operators import asymmetry, blocks, calls, evaluate, families, graph, pairs, report, tables, units
from twinscope.operators.index import BandIndex
from twinscope.operators.storage import cut, folder
from twinscope.sources import corpus

SHOUTING, TABLE = "!!", "|"


#: Rows of an Arrow batch, where a session has Spark's default of 10 000: whole texts and their sets are held several times over.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of word shingles; documents of fewer than three words have the empty set."""
    return pairs.text_sets(table(spark, sf_dir, "documents"))


def document_blocks(spark: SparkSession, sf_dir: str, *carried: str) -> blocks.Blocks:
    """The distinct sets of word shingles in blocks, with what is `carried`: simhash, lang, signature."""
    docs = table(spark, sf_dir, "documents")
    return blocks.in_blocks(pairs.carrying_sets(docs, carried), docs.count())


def document_pairs(spark: SparkSession, sf_dir: str, threshold: float = 0.4, *carried: str) -> DataFrame:
    return pairs.near_pairs(document_blocks(spark, sf_dir, *carried), threshold, carried)


def with_copies(sets: blocks.Blocks, found: DataFrame) -> DataFrame:
    """The class pairs `found` with `pairs` (of documents) and `positives` (those of one language), and a row for the copies of each class, of null a and b.

    Copies are counted, never paired: a class is its number of members of each language.
    """
    pairs_of = lambda m: F.expr(f"{m} * ({m} - 1) div 2")
    inside = sets.table().where("members > 1").select(pairs_of("members").alias("pairs"), F.aggregate("tally", F.lit(0).cast("long"), lambda s, m: s + F.floor(m * (m - 1) / 2).cast("long")).alias("positives"))
    return found.withColumn("pairs", F.col("members_a") * F.col("members_b")).unionByName(inside, allowMissingColumns=True)


def shingle_counts(spark, sf_dir):
    return document_sets(spark, sf_dir).select(F.col("key").alias("doc_id"), F.size("items").cast("long").alias("n_shingles"))


def jaccard_pairs(spark, sf_dir):
    return document_pairs(spark, sf_dir).withColumn("similarity", F.round("similarity", 6)).select("a", "b", "n_a", "n_b", "shared", "similarity", "members_a", "members_b")


def shingle_classes(spark, sf_dir):
    """The class of each document; all documents of fewer than three words are one class."""
    return pairs.class_members(document_sets(spark, sf_dir)).withColumnRenamed("key", "doc_id")


def pair_metrics(spark, sf_dir):
    found = document_pairs(spark, sf_dir, 0.4, "simhash")
    return found.select("a", "b", *[F.round(c, 6).alias(m) for m, c in metrics.of_pairs().items()])


def pair_residual(spark, sf_dir):
    """How many items only one set of a pair holds, and how many both do."""
    only = lambda n: (F.col(n) - F.col("shared")).cast("long")
    return document_pairs(spark, sf_dir).select("a", "b", only("n_a").alias("only_a"), only("n_b").alias("only_b"), F.col("shared").cast("long").alias("shared"))


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, signature of documents (doc_id, text)."""
    return sketches.signatures(sketches.text_hashes(docs).withColumn("hashes", sketches.high_halves(F.col("hashes"))), "doc_id")


def minhash_signature(spark, sf_dir):
    """Of documents of fewer than three words the largest number throughout."""
    return signed(table(spark, sf_dir, "documents")).select("doc_id", F.array_join(F.col("signature").cast("array<string>"), ",").alias("signature"))


def minhash_estimate(spark, sf_dir):
    """Share of equal slots of the signatures of each pair."""
    return document_pairs(spark, sf_dir, 0.4, "signature").select("a", "b", F.round(F.col("agree") / sketches.HASHES, 6).alias("estimate"))


def lsh_candidates(spark, sf_dir):
    return pairs.lsh_pairs(pairs.hashed_classes(table(spark, sf_dir, "documents")))


def twin_pairs(spark, sf_dir):
    """Pairs of representatives of equal sets; shingle_classes has the members of each."""
    docs = table(spark, sf_dir, "documents")
    reps = cut(pairs.set_classes(pairs.text_sets(docs)))
    found = pairs.twin_pairs(reps, hashed=pairs.standing_hashes(reps, docs))
    return found.select("a", "b", F.round("similarity", 6).alias("similarity"))


def simhash_hamming(spark, sf_dir):
    return document_pairs(spark, sf_dir, 0.4, "simhash").select("a", "b", F.col("hamming").cast("long").alias("hamming"), F.round(metrics.of_pairs()[metrics.SIMHASH], 6).alias("similarity"))


def document_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return families.families_of_sets(document_sets(spark, sf_dir), many=table(spark, sf_dir, "documents").count())


def twin_families(spark, sf_dir):
    """Documents of fewer than three words are a family, since empty sets have similarity 1."""
    return document_families(spark, sf_dir).select(F.col("node").alias("doc_id"), "family")


def largest_family(spark, sf_dir):
    found = document_families(spark, sf_dir)
    return graph.twin_family(found).select(F.col("node").alias("doc_id"), "family", "size")


def metric_families(spark, sf_dir):
    """Families under each metric, of all pairs that reach its threshold by the metric itself."""
    return families.families_by_metric(document_sets(spark, sf_dir), document_blocks(spark, sf_dir, "simhash"), evaluate.DEFAULT_THRESHOLDS)


def tag_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as units whose structure is their sequence of opening tags."""
    pages = table(spark, sf_dir, "pages")
    tags = F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), F.lit(1))
    return pages.select(
        F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("family"), F.col("page_id").alias("unit_id"), F.array_join(tags, ">").alias("root_key"), F.size(tags).alias("n_nodes"),
        F.col("url").alias("file"), F.lit(1).alias("start_line"), F.lit("page").alias("name"), tags.alias("tags"),
    )


def family_consensus(spark, sf_dir):
    return families.consensus(tag_units(spark, sf_dir)).select("family", "n_units", "n_groups", "consensus", "divergent")


def label_divergence(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("lines", F.split("text", "\n"))
    rows = docs.select(F.concat_ws("/", "source", F.size("lines").cast("string")).alias("family"), F.col("doc_id").alias("unit_id"), F.posexplode("lines").alias("pre", "label"))
    return families.label_divergence(rows.withColumn("kind", F.lit("LITERAL_STR"))).drop("kind")


def tree_trigrams(spark, sf_dir):
    """Of pages as trees whose pre-order is their sequence of opening tags."""
    tags = tag_units(spark, sf_dir).select(F.col("unit_id").alias("page_id"), F.transform("tags", lambda t: F.struct(t.alias("kind"))).alias("nodes"))
    return units.trigram_shingles(tags, "page_id").groupBy("page_id").agg(F.count("*").alias("n_trigrams"))


def page_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return units.build_units(pages.select(F.col("page_id").cast("string").alias("file"), F.col("html").alias("text"), F.lit("html").alias("language")))


def tree_subtrees(spark, sf_dir):
    found = page_units(spark, sf_dir).select("unit_id", "nodes")
    return units.subtree_shingles(found).groupBy("unit_id").agg(F.count("*").alias("n_shingles"))


def page_families(spark, sf_dir):
    return families.twin_families(page_units(spark, sf_dir), 0.8)


def import_path_scan(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    text = F.concat_ws("\n", F.lit("first line"), F.concat(F.lit('  import "'), "url", F.lit('"')), F.concat(F.lit("use "), F.regexp_replace("url", "[^A-Za-z0-9.]", ".")))
    found = import_findings(pages.select(F.col("page_id").alias("file"), text.alias("text")), markers=("blog", "en", "fr", "example", "v[0-9]+"))
    return found.select(F.col("file").alias("page_id"), F.col("start_line").cast("long").alias("start_line"), "import_path", "marker")


def sort_asymmetry(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("has_sort", F.char_length("text") % 2 == 0)
    rows = pairs.text_sets(docs, beside=("lang", "has_sort")).select(F.col("key").alias("unit"), F.col("key").alias("file"), "lang", "has_sort", F.col("items").alias("identifiers"))
    return asymmetry.asymmetric(rows, "lang", many=docs.count()).select(F.col("unit").alias("doc_id"), "n_similar")


def placed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: a folder for each source, or one for each document with names that recur."""
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", F.lit("/corpus"), "source", F.format_string("%012d.txt", "doc_id")).alias("file"), F.concat_ws("/", F.lit("/corpus"), "source").alias("dir"), F.col("lang").alias("language"))


def sibling_pool(spark, sf_dir):
    return corpus.siblings(placed_documents(spark, sf_dir))


def basename_pool(spark, sf_dir):
    """Files of several depths, some in a folder that is passed over."""
    docs = table(spark, sf_dir, "documents")
    part = lambda name, c: F.when(c, F.lit(name))
    folder = F.concat_ws("/", F.lit("/corpus"), "source", part("deep", F.col("doc_id") % 3 > 0), part("deeper", F.col("doc_id") % 3 > 1), part("vendor", F.col("doc_id") % 11 == 0), F.col("doc_id").cast("string"))
    files = docs.select(F.concat_ws("/", folder, F.concat((F.col("doc_id") % 7).cast("string"), F.lit(".txt"))).alias("file"), folder.alias("dir"), "source")
    roots = files.select("file", F.concat_ws("/", F.lit("/corpus"), "source").alias("root"))
    return corpus.cross_file_siblings(files.select("file", "dir"), roots)


def findings_topk(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = docs.select(
        F.concat(F.lit("/corpus/"), "source").alias("file"), F.col("doc_id").alias("start_line"), F.col("doc_id").alias("end_line"), F.col("lang").alias("category"), F.concat(F.col("n_chars").cast("string"), F.lit(" characters")).alias("rationale"),
        F.when(F.col("text").contains(TABLE), F.lit("table")).alias("shape"), F.lit(0.5).alias("confidence"), F.when(F.col("text").contains(SHOUTING), F.lit("shouting")).alias("marker"), F.lit(0).alias("detector_order"),
    )
    return report.warnings(found)


def nation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's customers buy most from another nation's suppliers: an edge to that nation."""
    t = lambda name: table(spark, sf_dir, name)
    sold = t("lineitem").select("l_orderkey", "l_suppkey", "l_quantity").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    sold = sold.join(t("customer").select("c_custkey", F.col("c_nationkey").alias("src")), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier").select("s_suppkey", F.col("s_nationkey").alias("dst")), F.col("l_suppkey") == F.col("s_suppkey"))
    return sold.where("src <> dst").groupBy("src", "dst").agg(F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


def call_edges(spark, sf_dir):
    targets = nation_edges(spark, sf_dir).join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("dst"), F.col("n_name").alias("label")), "dst").select(F.col("src").alias("unit_id"), "label")
    named = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("unit_id"), F.col("n_name").alias("name"))
    return calls.call_edges(targets, named)


def external_targets(spark, sf_dir):
    targets = nation_edges(spark, sf_dir).join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("dst"), F.col("n_name").alias("label")), "dst").select(F.col("src").alias("unit_id"), "label")
    named = table(spark, sf_dir, "nation").where("n_regionkey <> 0").select(F.col("n_nationkey").alias("unit_id"), F.col("n_name").alias("name"))
    return calls.external_targets(targets, named).select("unit_id", "label")


def reachable(spark, sf_dir):
    best = nation_edges(spark, sf_dir).groupBy("src").agg(F.max_by("dst", F.struct("quantity", "dst")).alias("dst"))
    starts = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("start"))
    return graph.reach(best, starts, paths=False).where("node <> start").select("start", "node", F.col("hops").cast("long").alias("hops"))


def neighbour_names(spark, sf_dir):
    best = nation_edges(spark, sf_dir).groupBy("src").agg(F.max_by("dst", F.struct("quantity", "dst")).alias("dst"))
    named = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("unit_id"), F.col("n_name").alias("name"))
    return calls.neighbours(best, named).select("unit_id", F.array_join("callers", ",").alias("callers"), F.array_join("callees", ",").alias("callees"))


def surface_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with shouting or a table bar, as findings: a case is a document, its file the source."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select(F.col("doc_id").alias("case_id"), F.col("source").alias("file"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "line"))
    return lines.where(F.col("line").contains(SHOUTING) | F.col("line").contains(TABLE)).select("case_id", "file", (F.col("at") + 1).alias("start_line"), (F.col("at") + 1).alias("end_line"))


def truth_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bad documents, each with two truth entries: the first three lines and the next three."""
    bad = table(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("case_id")).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), F.col("source").alias("file")), "case_id")
    return bad.select("case_id", "file", F.explode(F.array(F.lit(1), F.lit(4))).alias("start_line")).withColumn("end_line", F.col("start_line") + 2)


def matched_cases(spark, sf_dir):
    """Findings on the lines of documents against truth entries, greedily one to one."""
    counted = evaluate.match_cases(surface_findings(spark, sf_dir), truth_entries(spark, sf_dir))
    return counted.select(*[F.col(c).cast("long").alias(c) for c in counted.columns])


def eval_recall_fp(spark, sf_dir):
    cases = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id"), "doc_id").select(F.col("doc_id").alias("case_id"), (F.col("quality") == 1).alias("is_control"), F.lit("core").alias("tier"))
    counted = evaluate.match_cases(surface_findings(spark, sf_dir), truth_entries(spark, sf_dir)).select("case_id", "matched", "false_positives")
    rows = cases.join(counted, "case_id", "left").fillna(0, ["matched", "false_positives"])
    return evaluate.layer_stats(rows, "surface", 40.0, 0.15).withColumn("recall_pct", F.round("recall_pct", 6)).withColumn("fp_per_control", F.round("fp_per_control", 6))


def metric_values(spark: SparkSession, sf_dir: str, lows: dict[str, float], least: dict[str, float] | None = None) -> DataFrame:
    """metric, case_id, value, pairs, positives, negatives of all pairs of different sets that reach the low of some metric, by each metric.

    A case is a pair of classes and stands for all pairs of their documents; those of one language are positive.
    The copies of each class are cases without id, of value 1; copies of different languages aren't negatives. With
    `least` of each metric only the values from there on.
    """
    sets = document_blocks(spark, sf_dir, "simhash", "lang")
    counted = with_copies(sets, pairs.reached(blocks.pairs_of(sets, lows, ("simhash", "lang")), lows))
    copies = F.col("a").isNull()
    told = F.array(*[F.struct(F.lit(m).alias("metric"), F.when(copies, 1.0).otherwise(c).alias("value"), F.lit((least or {}).get(m, 0.0)).alias("least")) for m, c in metrics.of_pairs().items()])
    case, negatives = F.when(~copies, F.concat_ws("-", "a", "b")), F.when(copies, 0).otherwise(F.col("pairs") - F.col("positives"))
    cases = counted.select(case.alias("case_id"), "pairs", "positives", negatives.alias("negatives"), F.explode(told).alias("x"))
    # rounding takes most of the time, so what lies too low goes before it
    return cases.where("x.value >= x.least - 1e-5").select("x.metric", "case_id", F.round("x.value", 6).alias("value"), "pairs", "positives", "negatives")


def verdict(metric: str, value):
    """flag at the metric's threshold, escalate from below it, else ignore."""
    return F.when(value >= evaluate.DEFAULT_THRESHOLDS[metric], "flag").when(value >= evaluate.ESCALATED[metric], "escalate").otherwise("ignore")


def metric_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """metric_values of all pairs that some metric escalates, with each metric's verdict: flag at its threshold, escalate from below it, else ignore."""
    told = F.coalesce(*[F.when(F.col("metric") == m, verdict(m, F.col("value"))) for m in evaluate.DEFAULT_THRESHOLDS])
    return metric_values(spark, sf_dir, evaluate.ESCALATED).withColumn("verdict", told)


def verdict_tally(spark, sf_dir):
    """Pairs of documents, copies included; those of two languages are controls."""
    told = metric_verdicts(spark, sf_dir).select("metric", "verdict", F.explode(F.array(F.struct(F.lit(False).alias("is_control"), F.col("positives").alias("n")), F.struct(F.lit(True).alias("is_control"), (F.col("pairs") - F.col("positives")).alias("n")))).alias("x"))
    return evaluate.verdict_tally(told.select("metric", "verdict", "x.*").where("n > 0"), "n")


def verdict_changes(spark, sf_dir):
    """evaluate.verdict_changes of metric_verdicts, each in its pair's row, so that no case is looked up by its name."""
    sets = document_blocks(spark, sf_dir, "simhash")
    found = pairs.reached(blocks.pairs_of(sets, evaluate.ESCALATED, ("simhash",)), evaluate.ESCALATED)
    told = {m: verdict(m, F.round(c, 6)) for m, c in metrics.of_pairs().items()}
    others = F.array(*[F.struct(F.lit(m).alias("metric"), now.alias("now")) for m, now in told.items() if m != "jaccard"])
    rows = found.select("a", "b", told["jaccard"].alias("was"), F.explode(others).alias("x")).where("was <> x.now")
    return rows.select("x.metric", F.concat_ws("-", "a", "b").alias("case_id"), "was", "x.now")


def best_threshold(spark, sf_dir):
    """The threshold of the sweep that keeps most pairs of one language and none of two, copies aside."""
    return evaluate.best_threshold(threshold_sweep(spark, sf_dir))


#: From where the thresholds of each metric are swept, in hundredths; below 0.78 fingerprints meet by chance.
SWEPT = {m: 78 if m == metrics.SIMHASH else 20 for m in evaluate.DEFAULT_THRESHOLDS}


def best_setting(spark, sf_dir):
    """Of each metric the threshold that keeps most pairs of one language, then has most a tenth below it, with no pair of two languages kept, copies aside."""
    # overlap is never below the other set metrics, so its pairs hold theirs
    values = metric_values(spark, sf_dir, {"overlap": 0.2, metrics.SIMHASH: 0.78}, {m: low / 100 for m, low in SWEPT.items()})
    return evaluate.best_setting(evaluate.settings(values, SWEPT)).select("metric", "threshold", *[F.col(c).cast("long").alias(c) for c in ("flags", "escalations", "unknown_fp")])


def threshold_sweep(spark, sf_dir):
    """Pairs of documents, copies included, that reach each threshold, how many of them are of one language, and how many of the others are copies."""
    sets = document_blocks(spark, sf_dir, "lang")
    counted = with_copies(sets, pairs.near_pairs(sets, 0.2, ("lang",)))
    known = F.when(F.col("a").isNull(), F.col("pairs") - F.col("positives")).otherwise(0)
    swept = evaluate.sweep(counted.select(F.coalesce("similarity", F.lit(1.0)).alias("similarity"), "pairs", "positives", known.alias("known")))
    return swept.select([F.col(c).cast("long").alias(c) for c in swept.columns])


def floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """metric_floors of all pairs of distinct sets of each twin family, however far apart; a family of copies only has its own set."""
    sets, names = document_blocks(spark, sf_dir, "simhash"), [*evaluate.DEFAULT_THRESHOLDS]
    family = graph.components(blocks.forest_of(sets, {"jaccard": families.THRESHOLD}))
    copies = sets.table().where("members > 1").select("rep").join(family, F.col("rep") == F.col("node"), "left_anti").select(F.col("rep").alias("family"), *[F.lit(1.0).alias(m) for m in names])
    return evaluate.metric_floors(blocks.family_floors(sets, family).select("family", *names).unionByName(copies), "family")


def metric_floor(spark, sf_dir):
    return floors(spark, sf_dir).select("family", "metric", F.round("floor", 6).alias("floor"), F.round("margin", 6).alias("margin"))


def metric_rescue(spark, sf_dir):
    return evaluate.rescued(floors(spark, sf_dir), "family").select("family", "metric", F.round("margin", 6).alias("margin"))


#: Documents come in so many generations, by their ids.
GENERATIONS = 3


def generation_of(key: str, most: int):
    return (F.col(key) * GENERATIONS / (most + 1)).cast("int")


def growing_index(spark, sf_dir):
    """lsh_candidates, from an index to which the documents are added in generations: each is signed once, and only new ones look for partners."""
    docs = table(spark, sf_dir, "documents")
    most = docs.agg(F.max("doc_id")).first()[0] or 0
    index = BandIndex(spark, folder(spark, "bands"))
    found = []
    for g in range(GENERATIONS):
        hashed = sketches.text_hashes(docs.where(generation_of("doc_id", most) == g))  # Spark moves no filter below the hashing
        found.append(cut(index.add(hashed.select(F.col("doc_id").alias("key"), sketches.high_halves(F.col("hashes")).alias("hashes")), g)))
    return reduce(DataFrame.unionByName, found)


def growing_families(spark, sf_dir):
    """twin_families, by components to which the pairs are added in generations, each with the later of its two documents."""
    docs = table(spark, sf_dir, "documents")
    most = docs.agg(F.max("doc_id")).first()[0] or 0
    found = cut(blocks.forest_of(document_blocks(spark, sf_dir), {"jaccard": families.THRESHOLD}, GENERATIONS, most))
    labels = graph.components(found.where("part = 0"))
    for g in range(1, GENERATIONS):
        labels = cut(graph.merge_components(labels, found.where(F.col("part") == g))[0])
    return families.placed(pairs.class_members(document_sets(spark, sf_dir)), labels).select(F.col("node").alias("doc_id"), "family")


def nested_tags(spark, sf_dir):
    """How many nodes of one kind lie inside nodes of another, of each page's tree."""
    rows = units.nodes(page_units(spark, sf_dir).select(F.col("file").cast("long").alias("page_id"), "nodes"), "page_id")
    counted = []
    for outer, inner in (("NAV", "LINK"), ("NAV", "LI"), ("ARTICLE", "P"), ("ARTICLE", "H1"), ("LI", "A")):
        held = units.inside(rows.where(F.col("kind").isin(outer, inner)), F.col("kind") == outer, "page_id").where(F.col("kind") == inner)
        counted.append(held.groupBy("page_id").agg(F.count("*").alias("n"), F.min("label").alias("first_label")).select("page_id", F.lit(outer).alias("outer_kind"), F.lit(inner).alias("inner_kind"), "n", "first_label"))
    return reduce(DataFrame.unionByName, counted)


def tree_kinds(spark, sf_dir):
    """How many nodes of some kinds each page's tree has, by the table function of SQL."""
    tables.register_tables(spark)
    counted = spark.sql("SELECT p.page_id, n.kind, count(*) AS n FROM {pages} p, LATERAL tree_nodes(p.html, 'html') n GROUP BY p.page_id, n.kind", pages=table(spark, sf_dir, "pages"))
    return counted.where(F.col("kind").isin("NAV", "UL", "LI", "ARTICLE", "H1", "P", "LINK", "BR", "FOOTER"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        shingle_counts, jaccard_pairs, shingle_classes, pair_metrics, pair_residual, minhash_signature, minhash_estimate, lsh_candidates, twin_pairs, simhash_hamming, twin_families, largest_family,
        metric_families, family_consensus, label_divergence, tree_trigrams, tree_subtrees, page_families, import_path_scan, sort_asymmetry, sibling_pool, basename_pool, findings_topk, call_edges,
        external_targets, reachable, neighbour_names, matched_cases, eval_recall_fp, threshold_sweep, best_threshold, best_setting, verdict_tally, verdict_changes, metric_floor, metric_rescue, growing_index,
        growing_families, nested_tags, tree_kinds,
    )
}
