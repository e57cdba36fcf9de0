"""Queries of the reference's operators over the project's tables."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeloom.functions import parse
from citeloom.functions import text as T
from citeloom.operators import cost, evaluate, graph, jobs, keywords, models, network, numbering, prompts, recommend, tfidf, users
from citeloom.operators.references import number_key
from citeloom.plans.core_sql import SQL  # noqa: F401
from citeloom.session import cut_lineage, shared_folder, short_shuffles, spread
from citeloom.sources import providers
from citeloom.sources.catalog import table
from citeloom.streaming import enrich

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# text ------------------------------------------------------------------------------------------------------------


@query
def clean_tokens(spark: SparkSession, d: str) -> DataFrame:
    words = F.filter(F.split(T.clean_text(F.col("text")), r"\s+"), lambda w: F.length(w) >= 2)
    return spread(table(spark, d, "documents", "doc_id", "text")).select("doc_id", words.alias("w")).select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))


def _papers(spark: SparkSession, d: str) -> DataFrame:
    """One row per paper: the last loaded title and abstract by (loaded_at, title, abstract)."""
    rows = table(spark, d, "titleabs", "paper_id", "title", "abstract", "loaded_at").select(number_key("paper_id").alias("paper"), "title", "abstract", "loaded_at").where("paper is not null")
    last = F.max(F.struct("loaded_at", "title", "abstract")).alias("s")
    return rows.groupBy("paper").agg(last).select("paper", "s.title", "s.abstract")


def _documents(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    docs = table(spark, d, "documents", "doc_id", "text")
    return tfidf.token_lists(docs, "doc_id", "text"), docs.count()


@query
def tfidf_vocab(spark: SparkSession, d: str) -> DataFrame:
    lists, n = _documents(spark, d)
    return tfidf.vocabulary(lists, n)


@query
def tfidf_top3(spark: SparkSession, d: str) -> DataFrame:
    lists, n = _documents(spark, d)
    return tfidf.top_terms(lists, "doc_id", n)


@query
def tfidf_paper_keywords(spark: SparkSession, d: str) -> DataFrame:
    papers = _papers(spark, d).select("paper", T.title_and_abstract(F.col("title"), F.col("abstract")).alias("text"))
    return tfidf.keywords(cut_lineage(papers), "paper", "text")


@query
def title_abstract_split(spark: SparkSession, d: str) -> DataFrame:
    both = T.labelled_text(F.col("title"), F.col("abstract"))
    return _papers(spark, d).select("paper", F.coalesce("title", F.lit("")).alias("title"), F.length(F.coalesce("abstract", F.lit(""))).cast("long").alias("n_abstract_chars"), F.length(both).cast("long").alias("n_labelled_chars"))


@query
def strip_abstract_marker(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", F.concat(F.lit("Abstract "), F.col("text")).alias("t"))
    return docs.select("doc_id", F.length("t").cast("long").alias("n_before"), F.length(T.strip_marker(F.col("t"))).cast("long").alias("n_after"))


@query
def prompt_truncate(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "text").where("text is not null")
    return docs.select("doc_id", F.length(T.truncate(F.col("text"))).cast("long").alias("prompt_chars"), (F.length("text") > 2000).alias("was_cut"))


def _listed(spark: SparkSession, d: str) -> DataFrame:
    """The list of categories as one text, in one row."""
    names = table(spark, d, "labelidx2category", "label_idx", "category", "description")
    return names.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("label_idx", F.concat("category", F.lit(": "), F.coalesce("description", F.lit("no description"))).alias("t")))), lambda x: x["t"]), "\n").alias("listed"))


@query
def topic_prompts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "topic_prediction_results", "node_index", "title", "abstract", "citation_context").distinct().join(F.broadcast(_listed(spark, d)))
    return rows.select("node_index", F.length(T.topic_prompt(F.col("title"), F.col("abstract"), F.col("listed"), F.col("citation_context"))).cast("long").alias("n_chars"))


# users and interactions --------------------------------------------------------------------------------------------


def _extracted(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "llm_extraction_results", "node_idx", "domain", "task", "method")


def _keywords(spark: SparkSession, d: str) -> DataFrame:
    return keywords.field_keywords(_extracted(spark, d))


def _authors(spark: SparkSession, d: str) -> DataFrame:
    """Author rows of the papers that have keywords."""
    known = _keywords(spark, d).select(F.col("item_id").alias("node_idx")).distinct()
    return users.author_rows(table(spark, d, "author_data_openalex", "node_idx", "authors")).join(known, "node_idx", "left_semi")


def _user_pairs(spark: SparkSession, d: str) -> DataFrame:
    authors = cut_lineage(_authors(spark, d))
    return users.interactions(authors, users.registry(authors))


@query
def author_coverage(spark: SparkSession, d: str) -> DataFrame:
    return users.coverage(table(spark, d, "author_data_openalex", "node_idx", "authors"))


@query
def user_registry(spark: SparkSession, d: str) -> DataFrame:
    return users.registry(_authors(spark, d))


@query
def user_interactions(spark: SparkSession, d: str) -> DataFrame:
    return _user_pairs(spark, d)


@query
def user_top5_keywords(spark: SparkSession, d: str) -> DataFrame:
    return users.top_keywords(_user_pairs(spark, d), keywords.first_positions(_extracted(spark, d)))


@query
def user_paper_counts(spark: SparkSession, d: str) -> DataFrame:
    return _user_pairs(spark, d).groupBy("user_id").agg(F.sum("n").alias("total_papers"))


@query
def heavy_users(spark: SparkSession, d: str) -> DataFrame:
    return users.heavy_users(table(spark, d, "final_user_interactions", "user_id"), 5)


@query
def interaction_stats(spark: SparkSession, d: str) -> DataFrame:
    return users.interaction_stats(table(spark, d, "final_user_interactions", "user_id"))


@query
def id_cardinality(spark: SparkSession, d: str) -> DataFrame:
    return numbering.cardinalities(table(spark, d, "final_user_interactions", "user_id", "item_id"), "user_id", "item_id")


@query
def dense_reindex(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "final_user_interactions", "item_id", "created_at").where("item_id is not null")
    first = rows.groupBy("item_id").agg(F.min("created_at").alias("at"))
    return numbering.dense_ids(first, ["at", "item_id"], "item_no").select("item_id", "item_no")


@query
def interaction_keywords(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "final_user_interactions", "keywords")
    return rows.select(F.explode(parse.keyword_list(F.col("keywords"))).alias("keyword")).groupBy("keyword").agg(F.count(F.lit(1)).alias("n"))


# joins ---------------------------------------------------------------------------------------------------------------


def _node_map(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nodeidx2paperid", "node_idx", "paper_id").select("node_idx", number_key("paper_id").alias("paper")).distinct()


@query
def semi_join_sample(spark: SparkSession, d: str) -> DataFrame:
    papers = _papers(spark, d).select("paper", F.length("title").cast("long").alias("n_title_chars"))
    return papers.join(_node_map(spark, d), "paper", "left_semi")


@query
def anti_join_resume(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "llm_extraction_results", "node_idx", "status").where("status = 'success'")
    return enrich.pending(_node_map(spark, d).select("node_idx").distinct(), done, "node_idx")


@query
def node_paper_text(spark: SparkSession, d: str) -> DataFrame:
    papers = _papers(spark, d).select("paper", F.length(F.concat_ws(" ", "title", "abstract")).cast("long").alias("n_chars")).where("n_chars > 0")
    return _node_map(spark, d).join(papers, "paper").select("node_idx", "paper", "n_chars")


@query
def left_join_default(spark: SparkSession, d: str) -> DataFrame:
    titles = _papers(spark, d).select("paper", "title")
    return _node_map(spark, d).join(titles, "paper", "left").select("node_idx", "paper", F.coalesce("title", F.lit("Title Not Found")).alias("title"))


def _lookups(spark: SparkSession, d: str) -> DataFrame:
    return users.first_and_last(table(spark, d, "final_user_interactions", "item_id", "paper_id", "created_at"), "item_id", "paper_id", ["created_at"])


@query
def first_match_lookup(spark: SparkSession, d: str) -> DataFrame:
    return _lookups(spark, d).select("item_id", F.col("first_value").alias("paper_id"))


@query
def item_titles(spark: SparkSession, d: str) -> DataFrame:
    """Each item's first paper and that paper's title."""
    first = _lookups(spark, d).select("item_id", number_key("first_value").alias("paper"))
    return first.join(_papers(spark, d).select("paper", "title"), "paper", "left").select("item_id", "paper", F.coalesce("title", F.lit("Title Not Found")).alias("title"))


@query
def last_match_lookup(spark: SparkSession, d: str) -> DataFrame:
    return _lookups(spark, d).select("item_id", F.col("last_value").alias("paper_id"))


@query
def user_names(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "final_user_interactions", "user_id").where("user_id is not null").distinct()
    known = table(spark, d, "final_user_profiles", "user_id", "author_name").groupBy("user_id").agg(F.min(F.trim("author_name")).alias("name"))
    return asked.join(known, "user_id", "left").select("user_id", F.coalesce("name", F.lit("Unknown User")).alias("name"))


@query
def authors_short(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "author_data_openalex", "node_idx", "authors").where("node_idx is not null").distinct()
    short = T.shortened_list(F.filter("authors", lambda a: F.trim(a) != ""))
    return rows.select("node_idx", F.coalesce(short, F.lit("Unknown Authors")).alias("authors_str"))


# labels and graph ------------------------------------------------------------------------------------------------------


@query
def label_histogram(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.label_histogram(table(spark, d, "topic_prediction_results", "true_label_idx"), "true_label_idx")


@query
def distinct_labels(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.label_summary(table(spark, d, "embeddings", "label"), "label")


def _edges(spark: SparkSession, d: str, flag: str | None = None) -> DataFrame:
    """Part to next part of the same order, by (line number, part). The tables hold no citations; with a return flag, its lines make a
    graph of their own, thin enough to have isolated parts."""
    rows = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")
    if flag:
        rows = rows.where(F.col("l_returnflag") == flag)
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    return rows.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst")).where("dst is not null")


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part", "p_partkey").select(F.col("p_partkey").alias("idx"))


def _part_labels(spark: SparkSession, d: str) -> DataFrame:
    """Brands in order are the labels; the larger parts are unlabelled."""
    parts = table(spark, d, "part", "p_partkey", "p_brand", "p_size")
    brands = numbering.dense_ids(parts.select("p_brand").distinct(), ["p_brand"], "label_idx")
    return parts.where("p_size <= 25").join(brands, "p_brand").select(F.col("p_partkey").alias("idx"), "label_idx")


@query
def edge_dedup(spark: SparkSession, d: str) -> DataFrame:
    return graph.edges_with_multiplicity(_edges(spark, d))


@query
def graph_degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(_parts(spark, d), graph.simple_edges(_edges(spark, d)))


@query
def graph_counts(spark: SparkSession, d: str) -> DataFrame:
    return graph.graph_counts(_parts(spark, d), _edges(spark, d))


@query
def neighbor_union_cap50(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbours(_edges(spark, d), 50)


@query
def neighbor_label_distribution(spark: SparkSession, d: str) -> DataFrame:
    return graph.label_distribution(graph.neighbours(_edges(spark, d), 50), _part_labels(spark, d))


@query
def citation_context(spark: SparkSession, d: str) -> DataFrame:
    parts = _parts(spark, d)
    asked = parts.unionAll(parts.agg(F.max("idx").alias("m")).select(F.explode(F.sequence(F.col("m") + 1, F.col("m") + 5)).alias("idx")))
    return graph.citation_context(asked, parts, _edges(spark, d, "R"), _part_labels(spark, d))


@query
def forest_fire_sample(spark: SparkSession, d: str) -> DataFrame:
    parts = _parts(spark, d)
    return graph.forest_fire(parts, _edges(spark, d), target=max(1, parts.count() // 10))


# keywords --------------------------------------------------------------------------------------------------------------


@query
def keyword_vocab(spark: SparkSession, d: str) -> DataFrame:
    return keywords.vocabulary(_keywords(spark, d))


@query
def weighted_keyword_bag(spark: SparkSession, d: str) -> DataFrame:
    rows = cut_lineage(_keywords(spark, d))
    return keywords.weighted_bags(rows, keywords.vocabulary(rows))


@query
def keyword_overlap(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "final_user_interactions", "user_id", "item_id").where("user_id is not null and item_id is not null").distinct()
    pool = table(spark, d, "final_user_profiles", "user_id", "top_keywords").select("user_id", F.explode("top_keywords").alias("keyword")).select("user_id", T.keyword_form(F.col("keyword")).alias("keyword"))
    return keywords.overlap(cut_lineage(pairs), pool, _keywords(spark, d))


# evaluation and cost -----------------------------------------------------------------------------------------------------


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.scored(table(spark, d, "topic_prediction_results", "node_index", "true_label_idx", "topk_candidates"))


@query
def topk_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.accuracy(_scored(spark, d))


@query
def top3_miss_confusion(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.miss_confusion(_scored(spark, d))


@query
def per_class_miss_rate(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.per_class(_scored(spark, d))


@query
def miss_examples(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.miss_examples(_scored(spark, d))


@query
def llm_cost_summary(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "llm_extraction_results", "input_tokens", "output_tokens", "status").where("status = 'success'")
    return cost.cost_summary(calls, 16000)


@query
def cost_report(spark: SparkSession, d: str) -> DataFrame:
    return cost.report_lines(llm_cost_summary(spark, d))


@query
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "llm_extraction_results", "status").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# scoring -----------------------------------------------------------------------------------------------------------------


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and as queries those whose id is divisible by 100."""
    rows = table(spark, d, "embeddings", "vec_id", "embedding").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return rows, rows.where("id % 100 = 0")


@query
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    rows, asked = _vectors(spark, d)
    return recommend.vector_topk(rows, asked).withColumnRenamed("item_id", "vec_id")


@query
def dot_sigmoid_score(spark: SparkSession, d: str) -> DataFrame:
    rows, asked = _vectors(spark, d)
    return recommend.dot_scores(asked, rows)


def _bags(spark: SparkSession, d: str) -> DataFrame:
    rows = _keywords(spark, d)
    weight = F.when(F.col("field") == "domain", 2).otherwise(1)
    return rows.groupBy("item_id", "keyword").agg(F.sum(weight).alias("weight"))


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    """Keyword profiles of the users whose id is divisible by 100."""
    rows = table(spark, d, "final_user_profiles", "user_id", "top_keywords").where("user_id % 100 = 0")
    return rows.select(F.col("user_id").alias("query_id"), F.explode("top_keywords").alias("keyword")).select("query_id", T.keyword_form(F.col("keyword")).alias("keyword")).where("keyword <> ''").distinct().withColumn("weight", F.lit(1.0))


def _seen(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "final_user_interactions", "user_id", "item_id").where("user_id is not null and item_id is not null").select(F.col("user_id").alias("query_id"), "item_id").distinct()


@query
def prompt_recommend(spark: SparkSession, d: str) -> DataFrame:
    return recommend.bag_ranking(_profiles(spark, d), _bags(spark, d), None)


@query
def recommend_topk_unseen(spark: SparkSession, d: str) -> DataFrame:
    return recommend.bag_ranking(_profiles(spark, d), _bags(spark, d), _seen(spark, d)).withColumnRenamed("query_id", "user_id")


@query
def recommend_bottomk(spark: SparkSession, d: str) -> DataFrame:
    return recommend.bag_ranking(_profiles(spark, d), _bags(spark, d), _seen(spark, d), ascending=True).withColumnRenamed("query_id", "user_id")


def _shown(spark: SparkSession, d: str, ranking: DataFrame) -> DataFrame:
    titles = _node_map(spark, d).join(_papers(spark, d).select("paper", "title"), "paper").where("title is not null").groupBy(F.col("node_idx").alias("item_id")).agg(F.min("title").alias("title"))
    authors = authors_short(spark, d).groupBy(F.col("node_idx").alias("item_id")).agg(F.min("authors_str").alias("authors_str"))
    pool = _profiles(spark, d).select(F.col("query_id").alias("user_id"), "keyword")
    return prompts.decorated(ranking, "user_id", titles, authors, pool, _keywords(spark, d).select("item_id", "keyword"))


@query
def recommend_shown(spark: SparkSession, d: str) -> DataFrame:
    return _shown(spark, d, cut_lineage(recommend_topk_unseen(spark, d)))


@query
def recommend_bottom_shown(spark: SparkSession, d: str) -> DataFrame:
    return _shown(spark, d, cut_lineage(recommend_bottomk(spark, d)))


def _prompts(spark: SparkSession, d: str) -> DataFrame:
    """Titles of the predictions whose node is divisible by 100 stand for prompts."""
    return table(spark, d, "topic_prediction_results", "node_index", "title").where("node_index % 100 = 0").groupBy(F.col("node_index").alias("prompt_id")).agg(F.min("title").alias("text"))


@query
def prompt_keywords(spark: SparkSession, d: str) -> DataFrame:
    return prompts.prompt_keywords(_prompts(spark, d))


@query
def prompt_ranking(spark: SparkSession, d: str) -> DataFrame:
    return prompts.rank_prompts(prompts.prompt_keywords(_prompts(spark, d)), _bags(spark, d))


@query
def negative_samples(spark: SparkSession, d: str) -> DataFrame:
    return recommend.negative_samples(table(spark, d, "final_user_interactions", "user_id", "item_id"))


@query
def training_negatives(spark: SparkSession, d: str) -> DataFrame:
    return recommend.training_negatives(table(spark, d, "final_user_interactions", "user_id", "item_id"))


@query
def mf_recommend(spark: SparkSession, d: str) -> DataFrame:
    seen = cut_lineage(table(spark, d, "final_user_interactions", "user_id", "item_id").where("user_id is not null and item_id is not null").groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("n")))
    model, people, items = models.factorise(seen, rank=64, iterations=30)
    asked = seen.select("user_id").where("user_id % 100 = 0").distinct()
    return models.recommend_factors(model, people, items, asked, seen.select("user_id", "item_id"))


def _network(spark: SparkSession, d: str, weighted: bool, epochs: int, dropout: float) -> DataFrame:
    """Train on all positives with four negatives each, then rank all items for the users whose id is divisible by 100."""
    with short_shuffles(spark):
        vocab = cut_lineage(keywords.vocabulary(_keywords(spark, d)))
        bags = cut_lineage(keywords.weighted_bags(_keywords(spark, d), vocab))
        seen = cut_lineage(table(spark, d, "final_user_interactions", "user_id", "item_id").join(bags.select("item_id").distinct(), "item_id", "left_semi").where("user_id is not null").select("user_id", "item_id").distinct())
        people = cut_lineage(numbering.dense_ids(seen.select("user_id").distinct(), ["user_id"], "u"))
        items = cut_lineage(numbering.dense_ids(seen.select("item_id").distinct(), ["item_id"], "number"))
        net = network.Network.new(people.count(), vocab.count())
        lists = cut_lineage(network.bag_lists(bags, net, weighted))
        rows = recommend.training_numbers(seen.join(people, "user_id").join(items, "item_id"), items.count())
        net = network.train(network.packed(rows, lists.join(items, "item_id"), net), net, epochs, dropout=dropout)
    ranked = network.recommend(net, people.where("user_id % 100 = 0"), lists, seen.withColumnRenamed("user_id", "query_id"))
    return ranked.withColumnRenamed("query_id", "user_id")


@query
def content_recommend(spark: SparkSession, d: str) -> DataFrame:
    return _network(spark, d, True, 15, 0.3)


@query
def content_flat_recommend(spark: SparkSession, d: str) -> DataFrame:
    return _network(spark, d, False, 10, 0.2)


# parsing, providers, streams -----------------------------------------------------------------------------------------------


@query
def parse_llm_json(spark: SparkSession, d: str) -> DataFrame:
    bodies = _extracted(spark, d).where("node_idx is not null").distinct().select("node_idx", F.to_json(F.struct("domain", "task", "method")).alias("body"))
    rows = parse.keyword_object(bodies, "body")
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("terms")) for f in ("domain", "task", "method")])).alias("s")
    return rows.select("node_idx", each).select("node_idx", "s.field", F.explode("s.terms").alias("value")).where("value is not null")


@query
def parse_usage(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "llm_extraction_results", "node_idx", "input_tokens", "output_tokens").distinct()
    bodies = rows.select("node_idx", F.to_json(F.struct(F.struct(F.col("input_tokens").alias("prompt_tokens"), F.col("output_tokens").alias("completion_tokens")).alias("usage"))).alias("body"))
    return parse.usage(bodies, "body").drop("body")


@query
def parse_works_json(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "author_data_openalex", "paper_id", "authors").distinct()
    authorships = F.transform("authors", lambda a: F.struct(F.struct(a.alias("display_name")).alias("author")))
    bodies = rows.select(F.to_json(F.struct(F.struct(F.col("paper_id").alias("mag")).alias("ids"), authorships.alias("authorships"))).alias("body"))
    return parse.works(bodies, "body").select("paper_id", F.explode("authors").alias("author"))


@query
def enrich_with_status(spark: SparkSession, d: str) -> DataFrame:
    requests = _papers(spark, d).select(F.col("paper").alias("node_idx"), T.truncate(T.title_and_abstract(F.col("title"), F.col("abstract"))).alias("text"))
    return providers.call_all(requests, providers.offline_keywords).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query
def id_batches(spark: SparkSession, d: str) -> DataFrame:
    return providers.joined_ids(table(spark, d, "nodeidx2paperid", "paper_id"))


def _job(spark: SparkSession, d: str, fatal: str | None = None, **how) -> jobs.JobResult:
    """Keyword extraction for the nodes without a successful result, by a provider that fails at times."""
    papers = _papers(spark, d).select("paper", T.truncate(T.title_and_abstract(F.col("title"), F.col("abstract"))).alias("text"))
    done = table(spark, d, "llm_extraction_results", "node_idx", "status").where("status = 'success'")
    return jobs.keyword_job(_node_map(spark, d).join(papers, "paper"), done, providers.unreliable(providers.offline_lengths, fatal), **how)


@query
def enrichment_job(spark: SparkSession, d: str) -> DataFrame:
    return jobs.by_status(_job(spark, d, policy=providers.CallPolicy(attempts=2)))


@query
def enrichment_costing(spark: SparkSession, d: str) -> DataFrame:
    return _job(spark, d, policy=providers.CallPolicy(attempts=2), project_size=16000, limit=100).costs


@query
def enrich_until_fatal(spark: SparkSession, d: str) -> DataFrame:
    policy = providers.CallPolicy(tasks=1, at_once=1, attempts=2)
    return jobs.by_status(_job(spark, d, "77", policy=policy)).where("status <> 'missing'").select("node_idx", "status")


def _classified(spark: SparkSession, d: str) -> DataFrame:
    """Three candidates for every node, from its title, abstract and citation context; abstracts that hold ERROR are skipped."""
    rows = table(spark, d, "topic_prediction_results", "node_index", "title", "abstract", "citation_context").where("not contains(coalesce(abstract, ''), 'ERROR')").distinct()
    prompt = T.topic_prompt(F.col("title"), F.col("abstract"), F.col("listed"), F.col("citation_context"))
    requests = rows.join(F.broadcast(_listed(spark, d))).groupBy(F.col("node_index").alias("node_idx")).agg(F.min(prompt).alias("text"))
    labels = table(spark, d, "labelidx2category", "label_idx").agg(F.max("label_idx") + 1).first()[0]
    return parse.candidate_list(providers.call_all(requests, providers.offline_label(int(labels))), "body")


@query
def classify_evaluate(spark: SparkSession, d: str) -> DataFrame:
    truth = table(spark, d, "topic_prediction_results", "node_index", "true_label_idx").groupBy("node_index").agg(F.min("true_label_idx").alias("true_label_idx"))
    answers = _classified(spark, d).select(F.col("node_idx").alias("node_index"), F.col("candidates").alias("topk_candidates"))
    return evaluate.accuracy(evaluate.scored(truth.join(answers, "node_index")))


@query
def classify_offline(spark: SparkSession, d: str) -> DataFrame:
    answers = _classified(spark, d)
    return answers.select("node_idx", F.posexplode("candidates").alias("pos", "c")).select("node_idx", (F.col("pos") + 1).cast("long").alias("rk"), "c.label_idx")


@query
def incremental_foreachbatch(spark: SparkSession, d: str) -> DataFrame:
    schema = spark.read.parquet(f"{d}/documents.parquet").schema
    home = f"{shared_folder(spark)}/incremental-{zlib.crc32(d.encode()):x}"
    enrich.run_incrementally(spark, f"{d}/documents.parquet", schema, f"{home}/out", f"{home}/state", lambda batch: batch.select("doc_id", F.size(F.split(T.clean_text(F.col("text")), r"\s+")).alias("n_words")))
    return spark.read.parquet(f"{home}/out").select("doc_id", "batch_id")
