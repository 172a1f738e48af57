"""Queries of the relational, report, sampling, text and scalar operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galewright.evolve.variation import RATES
from galewright.functions import scalar as X
from galewright.operators import corpus as C
from galewright.operators import metrics as M
from galewright.operators import relational as R
from galewright.operators import sampling as P
from galewright.plans.series import events, r
from galewright.session import table


def _genomes(spark, d):
    g = table(spark, d, "cnn_genome").withColumn("err", F.col("best_validation_error").cast("double"))
    return g.where("deleted_at IS NULL")


def _edges(spark, d):
    return table(spark, d, "cnn_edge").distinct()


def innovation_merge(spark, d):
    """The edges of two genomes of each search, merged by innovation number: the first and the last genome id."""
    e = _edges(spark, d).where("genome_id IS NOT NULL AND exact_id IS NOT NULL").groupBy("exact_id", "genome_id", "innovation_number").agg(F.max("filter_x").alias("weight"))
    ends = e.groupBy("exact_id").agg(F.min("genome_id").alias("g1"), F.max("genome_id").alias("g2")).where("g1 < g2")
    a = e.join(ends.select("exact_id", F.col("g1").alias("genome_id")), ["exact_id", "genome_id"])
    b = e.join(ends.select("exact_id", F.col("g2").alias("genome_id")), ["exact_id", "genome_id"])
    return R.merge_by_key(a, b, ["exact_id", "innovation_number"], ["weight"])


def innovation_crossover(spark, d):
    m = innovation_merge(spark, d)
    w = F.when(F.col("origin") == "both", F.col("weight_1") + 0.5 * (F.col("weight_1") - F.col("weight_2"))).otherwise(F.coalesce("weight_1", "weight_2"))
    return m.select("exact_id", "innovation_number", "origin", r(w.cast("double")).alias("weight"))


def outpaced_orders(spark, d):
    """Orders of more than four times the price of other orders of the same customer, with their number."""
    o = table(spark, d, "orders").groupBy("o_custkey", F.round("o_totalprice", 2).alias("price")).agg(F.min("o_orderkey").alias("o_orderkey"))
    return R.outpaced(o, "o_custkey", "o_orderkey", "price").select("o_custkey", "o_orderkey", "n_cheaper")


def orphans_anti(spark, d):
    big = table(spark, d, "orders").where("o_totalprice > 250000").select(F.col("o_orderkey").alias("l_orderkey"))
    return R.without_partner(table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"), big, ["l_orderkey"])


def keep_semi(spark, d):
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return R.with_partner(table(spark, d, "customer").select("c_custkey", "c_name"), urgent, ["c_custkey"])


def never_urgent(spark, d):
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return R.without_partner(table(spark, d, "customer").select("c_custkey", "c_name"), urgent, ["c_custkey"])


def lookup_join(spark, d):
    s = table(spark, d, "exact_search").where("deleted_at IS NULL").select(F.col("id").alias("exact_id"), "search_name").distinct()
    return _genomes(spark, d).select("id", "exact_id").distinct().join(s, "exact_id").select("id", "exact_id", "search_name")


def group_left_join(spark, d):
    e = _edges(spark, d).groupBy("genome_id").agg(F.count("*").alias("n_edges"), F.sum(F.col("filter_x") * F.col("filter_y")).alias("n_weights"))
    g = _genomes(spark, d).select(F.col("id").alias("genome_id")).distinct()
    return g.join(e, "genome_id", "left").select("genome_id", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), F.coalesce("n_weights", F.lit(0)).alias("n_weights"))


def top1_lateral(spark, d):
    g = _genomes(spark, d).where("err IS NOT NULL AND NOT isnan(err) AND exact_id IS NOT NULL")
    best = g.groupBy("exact_id").agg(F.min_by(F.struct("id", "err"), F.struct("err", "id")).alias("b"))
    s = table(spark, d, "exact_search").where("deleted_at IS NULL").select("id").distinct()
    return s.join(best, s["id"] == best["exact_id"], "left").select(s["id"].alias("search_id"), F.col("b.id").alias("genome_id"), r("b.err").alias("err"))


def top_k_per_group(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return R.top_rows(o, "o_custkey", [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", F.col("place").cast("bigint").alias("place"))


def dedup_best(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_extendedprice", "l_orderkey", "l_linenumber")
    best = R.best_per_key(li.withColumn("first", F.col("l_orderkey") * 10 + F.col("l_linenumber")), ["l_suppkey", "l_partkey"], "l_extendedprice", "first")
    return best.select("l_suppkey", "l_partkey", r("l_extendedprice", 2).alias("price"), "first")


def bounded_population(spark, d):
    g = _genomes(spark, d).where("exact_id IS NOT NULL").select("exact_id", "batch_size", "best_epoch", "err", "id").groupBy("exact_id", "batch_size", "best_epoch", "err", "id").count().drop("count")
    x = g.withColumn("structure", F.concat_ws("_", "batch_size", "best_epoch"))
    p = R.bounded_population(x, "exact_id", "structure", "err", "id", 10)
    return p.select("exact_id", "structure", r("err").alias("err"), "id", F.col("place").cast("bigint").alias("place"))


def rank_islands(spark, d):
    g = _genomes(spark, d).where("err IS NOT NULL AND NOT isnan(err) AND exact_id IS NOT NULL")
    return R.rank_groups(g, "exact_id", "err").select("exact_id", r("best").alias("best"), "place")


def best_global(spark, d):
    g = _genomes(spark, d).where("err IS NOT NULL AND NOT isnan(err)").select("id", "err").distinct()
    return g.orderBy("err", "id").limit(1).select("id", r("err").alias("err"))


def worst_per_island(spark, d):
    g = _genomes(spark, d).where("err IS NOT NULL AND NOT isnan(err) AND exact_id IS NOT NULL")
    return g.groupBy("exact_id").agg(F.max_by("id", F.struct("err", "id")).alias("worst_id"), F.min_by("id", F.struct("err", "id")).alias("best_id"), r(F.max("err") / F.min("err"), 4).alias("ratio"))


def structural_hash(spark, d):
    n = table(spark, d, "cnn_node").distinct().where("NOT disabled AND genome_id IS NOT NULL").groupBy("genome_id").agg(F.sum("innovation_number").alias("n"))
    e = _edges(spark, d).where("NOT disabled AND forward_visited AND reverse_visited AND genome_id IS NOT NULL")
    e = e.groupBy("genome_id").agg(F.sum(F.when(F.col("edge_type") == 0, F.col("innovation_number"))).alias("c"), F.sum(F.when(F.col("edge_type") == 1, F.col("innovation_number"))).alias("p"))
    return n.join(e, "genome_id", "left").select("genome_id", X.structural_hash(F.col("n"), F.col("c"), F.col("p")).alias("hash"))


def enabled_counts(spark, d):
    n = table(spark, d, "cnn_node").distinct()
    return n.groupBy("node_type").agg(F.count_if(~F.col("disabled")).alias("n_enabled"), F.count("*").alias("n_all"))


def reachable_edges(spark, d):
    e = _edges(spark, d)
    live = ~F.col("disabled") & F.col("forward_visited") & F.col("reverse_visited")
    return e.groupBy("edge_type").agg(F.count_if(live).alias("n_reachable"), F.sum(F.when(live, F.col("filter_x") * F.col("filter_y"))).alias("n_weights"))


def finite_errors(spark, d):
    g = table(spark, d, "cnn_genome").withColumn("err", F.col("best_validation_error").cast("double"))
    return g.where(F.col("err").isNotNull() & ~F.isnan("err") & (F.abs("err") < 1e6)).groupBy("exact_id").agg(F.count("*").alias("n"))


def running_searches(spark, d):
    return table(spark, d, "exact_search").where("genomes_generated < max_genomes AND deleted_at IS NULL").select("id", "search_name", (F.col("max_genomes") - F.col("genomes_generated")).alias("left_over")).distinct()


def cond_counts(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy("l_returnflag").agg(F.count_if(F.col("l_linestatus") == "O").alias("n_open"), F.count_if(F.col("l_discount") > 0.05).alias("n_cheap"), r(F.sum(F.col("l_quantity") * F.col("l_tax")), 2).alias("sum_product"))


def agg24(spark, d):
    values = ["best_validation_error", "training_error", "test_error", "best_validation_predictions", "training_predictions", "test_predictions", "training_error + best_validation_error", "training_predictions + best_validation_predictions"]
    g = table(spark, d, "cnn_genome").where("NOT isnan(best_validation_error) AND NOT isnan(training_error) AND deleted_at IS NULL AND best_validation_error < 1000")
    for c in values[:3]:
        g = g.withColumn(c, F.col(c).cast("double"))
    out = R.reported_range(g, values)
    return out.select(*[r(F.col(c).cast("double"), 4).alias(c) for c in out.columns])


def order_limit(spark, d):
    return table(spark, d, "part").orderBy((F.col("p_retailprice") * F.col("p_size")).desc(), "p_partkey").limit(25).select("p_partkey", "p_name")


def not_in_keep(spark, d):
    keep = table(spark, d, "cnn_genome").where("best_validation_error <= 0.5 AND id IS NOT NULL").select("id")
    return R.without_partner(table(spark, d, "cnn_genome").select("id", "exact_id").distinct(), keep, ["id"])


def range_computed(spark, d):
    return table(spark, d, "orders").where("o_totalprice BETWEEN 100000 AND 200000").select("o_orderkey", r(F.col("o_totalprice") / 1000).alias("thousands"))


def is_null_flag(spark, d):
    return table(spark, d, "cnn_genome").groupBy("exact_id").agg(F.count_if(F.col("test_error").isNull()).alias("n_untested"), F.count("*").alias("n"))


def update_set(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return R.update_where(o, F.col("o_orderstatus") == "P", {"o_totalprice": F.col("o_totalprice") * 2}).select("o_orderkey", r("o_totalprice", 2).alias("o_totalprice"))


def upsert_rows(spark, d):
    s = table(spark, d, "supplier")
    new = s.where("s_suppkey % 3 = 0").withColumn("s_acctbal", F.lit(0.0))
    return R.upsert(s, new, ["s_suppkey"]).select("s_suppkey", r("s_acctbal", 2).alias("s_acctbal"))


def agreeing_results(spark, d):
    """Pairs of results of one work unit (part and supplier) that agree: the same text, or prices less than 100 apart. All pairs count."""
    text = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    return R.agreeing_pairs(table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"], "l_extendedprice", text, 100.0)


def best_flags(spark, d):
    x = table(spark, d, "exact_search").where("deleted_at IS NULL").distinct().withColumn("bucket", F.floor(F.col("id") / 20).cast("bigint"))
    return R.best_flags(x, ["genomes_generated", "population_size"], "bucket").select("id", "bucket", "best_genomes_generated", "best_population_size")


def bucket_averages(spark, d):
    x = table(spark, d, "exact_search").where("deleted_at IS NULL").distinct()
    return x.groupBy(F.floor(F.col("id") / 20).cast("bigint").alias("bucket")).agg(r(F.avg("genomes_generated")).alias("avg_generated"), r(F.avg("inserted_genomes")).alias("avg_inserted"))


def run_report(spark, d):
    x = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    t = M.track(x, ["c_mktsegment", "o_orderpriority"], ["o_totalprice", "c_acctbal"], "o_totalprice")
    return t.select("c_mktsegment", "o_orderpriority", r("min_o_totalprice", 2).alias("min_price"), r("avg_o_totalprice", 2).alias("avg_price"), r("max_o_totalprice", 2).alias("max_price"), r("sd_o_totalprice", 2).alias("sd_price"), r("corr_c_acctbal").alias("corr_balance"))


def zscore_rank(spark, d):
    x = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    g = x.groupBy("c_mktsegment", "o_orderpriority").agg(F.avg("o_totalprice").alias("avg_price"))
    z = M.deviation_ranks(g, "c_mktsegment", "o_orderpriority", "avg_price")
    return z.select("o_orderpriority", r("mean_z").alias("mean_z"), "place")


def species_distance(spark, d):
    """Excess, disjoint and union of the innovation lists of genomes that follow each other within a search."""
    g = _edges(spark, d).where("genome_id IS NOT NULL AND exact_id IS NOT NULL").groupBy("exact_id", "genome_id").agg(F.array_sort(F.collect_set("innovation_number")).alias("a"))
    p = g.withColumn("b", F.lag("a").over(Window.partitionBy("exact_id").orderBy("genome_id"))).where("b IS NOT NULL")
    x = R.set_distance(p, "a", "b")
    return x.select("exact_id", "genome_id", F.col("excess").cast("bigint").alias("excess"), F.col("disjoint").cast("bigint").alias("disjoint"), F.col("n_union").cast("bigint").alias("n_union"))


def fitness_share(spark, d):
    p = table(spark, d, "part").select("p_brand", "p_partkey", F.col("p_size").cast("double").alias("pos"), "p_retailprice")
    return R.shared_fitness(p, "p_brand", "p_partkey", "pos", "p_retailprice", 3.0).select("p_partkey", "n_near", r("share").alias("share"))


def share_outliers(spark, d):
    p = table(spark, d, "part").select("p_brand", "p_partkey", (F.col("p_size") * F.col("p_size")).cast("double").alias("pos"), F.pow("p_size", F.lit(12.0)).alias("fitness"))
    return R.share_outliers(R.shared_fitness(p, "p_brand", "p_partkey", "pos", "fitness", 3.0), "p_brand").select("p_partkey", r(F.col("share") / 1e12).alias("share"))


def set_operations(spark, d):
    a = table(spark, d, "events").where("event_type = 'click'").select("user_id").distinct()
    b = table(spark, d, "events").where("event_type = 'purchase' AND value > 60").select("user_id").distinct()
    parts = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.exceptAll(b)}
    out = None
    for k, x in parts.items():
        x = x.select(F.lit(k).alias("op"), "user_id")
        out = x if out is None else out.unionByName(x)
    return out


def transfer_names(spark, d):
    """Input columns of two searches matched by name: kept, new and removed ones."""
    old = table(spark, d, "nation").where("n_regionkey IN (0, 1, 2)").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("place"))
    new = table(spark, d, "nation").where("n_regionkey IN (1, 2, 3)").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("place"))
    m = R.merge_by_key(old, new, ["name"], ["place"])
    return m.select("name", F.when(F.col("origin") == "both", "kept").when(F.col("origin") == "first", "removed").otherwise("new").alias("fate"))


# Sampling


def sample_uniform(spark, d):
    return P.uniform_sample(table(spark, d, "events").select("event_id", "user_id"), "event_id", 300, 7)


def sample_weighted(spark, d):
    return P.weighted_sample(table(spark, d, "events").select("event_id", "value"), "event_id", F.pow(F.abs("value") + 1e-8, 0.6), 300, 7).select("event_id")


def sample_stratified(spark, d):
    return P.stratified_sample(table(spark, d, "events").select("event_id", "event_type"), "event_type", "event_id", 20, 7)


def sample_permutation(spark, d):
    return P.permuted(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 11)


def sample_mutations(spark, d):
    rates = [(name, rate) for name, rate in RATES.items() if rate]
    c = P.choose_by_rates(F.col("o_orderkey"), 5, rates)
    return table(spark, d, "orders").groupBy(c.alias("op")).agg(F.count("*").alias("n"))


def sample_normal(spark, d):
    z, _ = P.normal_pair(F.col("o_orderkey"), 3, 10.0, 2.0)
    return table(spark, d, "orders").select("o_orderkey", r(z).alias("z"))


def sample_gumbel(spark, d):
    return table(spark, d, "orders").select("o_orderkey", r(P.gumbel(F.col("o_orderkey"), 9)).alias("g"))


def _state(spark, d):
    """Orders as episodes: their price is the error, their number the generation from which they are there."""
    o = table(spark, d, "orders").groupBy(F.col("o_orderkey").alias("episode_id")).agg((F.max("o_totalprice") / 100000).alias("mse"))
    return o.withColumn("available_from", F.col("episode_id") / 100)


def priority_values(spark, d):
    p = P.priority(F.col("mse"), F.lit(200), F.col("available_from"))
    return _state(spark, d).select("episode_id", r(p).alias("priority"))


def priority_update(spark, d):
    elite = spark.range(1).select(F.lit(0.25).alias("best"), F.lit(0.5).alias("avg"))
    return P.updated_priorities(_state(spark, d), 200, elite, 50).select("episode_id", r("mse", 9).alias("mse"))


def priority_topn(spark, d):
    p = P.priority(F.col("mse"), F.lit(200), F.col("available_from"))
    return P.weighted_sample(_state(spark, d), "episode_id", F.pow(p, 0.6), 40, 3).select("episode_id")


def priority_log(spark, d):
    """One row per generation with two columns for each of three episodes."""
    o = table(spark, d, "orders").groupBy(F.length("o_orderpriority").alias("k")).agg((F.avg("o_totalprice") / 100000).alias("mse"))
    o = o.select(F.when(F.col("k") < 7, 1).when(F.col("k") < 9, 2).otherwise(3).alias("episode_id"), "mse").groupBy("episode_id").agg(F.max("mse").alias("mse"))
    s = o.withColumn("available_from", F.col("episode_id")).select("episode_id", "mse", "available_from", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("generation"))
    s = s.withColumn("priority", P.priority(F.col("mse"), F.col("generation"), F.col("available_from")))
    wide = s.groupBy("generation").pivot("episode_id", [1, 2, 3]).agg(F.first("mse").alias("mse"), F.first("priority").alias("priority"))
    return wide.select("generation", *[r(F.col(f"{k}_{c}")).alias(f"episode_{k}_{c}") for k in (1, 2, 3) for c in ("mse", "priority")])


def elite_statistics(spark, d):
    g = _genomes(spark, d).where("err IS NOT NULL AND NOT isnan(err) AND exact_id IS NOT NULL").select("exact_id", "id", "err").distinct()
    top = R.top_rows(g, "exact_id", [F.col("err"), F.col("id")], 5)
    return top.groupBy("exact_id").agg(r(F.min("err")).alias("best"), r(F.avg("err"), 5).alias("avg"), r(F.max("err")).alias("worst"), F.count("*").alias("n"))


# Text


def _tokens(spark, d):
    return C.tokens(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


def text_tokens(spark, d):
    return _tokens(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_tokens"))


def text_vocabulary(spark, d):
    return C.vocabulary(_tokens(spark, d))


def text_frequencies(spark, d):
    return C.word_frequencies(C.vocabulary(_tokens(spark, d))).select("token", "n", r("frequency", 9).alias("frequency"))


def text_next_tokens(spark, d):
    t = _tokens(spark, d)
    x = C.next_tokens(C.encode_words(t, C.vocabulary(t)), "doc_id", 2)
    return x.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "x", "y")


def text_chunks(spark, d):
    t = _tokens(spark, d)
    c = C.chunks(C.encode_words(t, C.vocabulary(t)), "doc_id", 64)
    return c.select("doc_id", F.col("chunk").cast("bigint").alias("chunk"), F.col("ids")[0].alias("first_id"), F.col("ids")[63].alias("last_id"), F.size("ids").cast("bigint").alias("n"))


def text_clean(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length(C.clean_spaces(F.col("text"))).cast("bigint").alias("n"))


# Scalars


def activations(spark, d):
    x = (F.col("l_quantity") - 25) / 10
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", x.alias("x"))
    c = F.col("x")
    return li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", r(X.sigmoid(c)).alias("sigmoid"), r(X.sigmoid_slope(X.sigmoid(c))).alias("sigmoid_slope"), r(F.tanh(c)).alias("tanh"),
        r(X.tanh_slope(F.tanh(c))).alias("tanh_slope"), r(X.swish(c)).alias("swish"), r(X.swish_slope(c)).alias("swish_slope"), r(X.leaky_relu(c)).alias("leaky"), r(X.clamped_relu(c * 4)).alias("clamped"),
        r(X.bound(c * 6)).alias("bound"), r(X.inverse(c)).alias("inverse"), r(F.sin(c)).alias("sin"), r(F.cos(c)).alias("cos"))


def array_functions(spark, d):
    """Of whole vectors. The product of 64 small numbers is too small to be rounded to decimals."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    s = X.softmax(F.col("v"))
    return e.select("vec_id", r(X.norm(F.col("v"))).alias("norm"), (X.product(F.col("v")) + 0.0).alias("product"), r(s[0]).alias("p0"), X.argmax(F.col("v")).cast("bigint").alias("argmax"), r(F.array_max(X.keep_top(s, 3))).alias("top3"))


def clamped_moments(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list((F.col("value") - 50) / 3.7)).alias("v"))
    return e.select("user_id", X.clamped_mean_sd(F.col("v")).alias("m")).select("user_id", r("m.mu", 9).alias("mu"), r("m.sigma", 9).alias("sigma"))


def label_text(spark, d):
    n = table(spark, d, "exact_search").select("search_name").distinct()
    return n.select("search_name", X.run_label(F.concat(F.col("search_name"), F.lit("_norec"))).alias("label"), X.file_stem(F.concat(F.lit("runs/"), F.col("search_name"), F.lit(".csv"))).alias("stem"))


QUERIES = {f.__name__: f for f in (
    innovation_merge, innovation_crossover, outpaced_orders, orphans_anti, keep_semi, never_urgent, lookup_join, group_left_join, top1_lateral, top_k_per_group, dedup_best,
    bounded_population, rank_islands, best_global, worst_per_island, structural_hash, enabled_counts, reachable_edges, finite_errors, running_searches, cond_counts, agg24, order_limit, not_in_keep,
    range_computed, is_null_flag, update_set, upsert_rows, agreeing_results, best_flags, bucket_averages, run_report, zscore_rank, species_distance, fitness_share, share_outliers, set_operations,
    transfer_names, sample_uniform, sample_weighted, sample_stratified, sample_permutation, sample_mutations, sample_normal, sample_gumbel, priority_values, priority_update, priority_topn, priority_log, elite_statistics,
    text_tokens, text_vocabulary, text_frequencies, text_next_tokens, text_chunks, text_clean, activations, array_functions, clamped_moments, label_text,
)}

_G = "g AS (SELECT *, best_validation_error::DOUBLE AS err FROM cnn_genome WHERE deleted_at IS NULL)"
_OK = "err IS NOT NULL AND NOT isnan(err)"
_ED = "ed AS (SELECT DISTINCT * FROM cnn_edge)"
_MERGE = f"""WITH {_ED}, e AS (SELECT exact_id, genome_id, innovation_number, max(filter_x) AS weight FROM ed WHERE genome_id IS NOT NULL AND exact_id IS NOT NULL GROUP BY ALL),
k AS (SELECT exact_id, min(genome_id) AS g1, max(genome_id) AS g2 FROM e GROUP BY exact_id HAVING min(genome_id) < max(genome_id)),
a AS (SELECT e.* FROM e JOIN k ON e.exact_id = k.exact_id AND genome_id = g1), b AS (SELECT e.* FROM e JOIN k ON e.exact_id = k.exact_id AND genome_id = g2),
m AS (SELECT coalesce(a.exact_id, b.exact_id) AS exact_id, coalesce(a.innovation_number, b.innovation_number) AS innovation_number, a.weight AS weight_1, b.weight AS weight_2,
CASE WHEN a.exact_id IS NULL THEN 'second' WHEN b.exact_id IS NULL THEN 'first' ELSE 'both' END AS origin FROM a FULL OUTER JOIN b ON a.exact_id = b.exact_id AND a.innovation_number = b.innovation_number)"""
_ORD = "SELECT o_custkey, round(o_totalprice, 2) AS price, min(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL"
_BIG = "SELECT o_orderkey FROM orders WHERE o_totalprice > 250000"
_URG = "SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'"
_SH = "SELECT a.p_brand, a.p_partkey, count(*) AS n_near, any_value({f}) / count(*) AS share FROM part a JOIN part b ON a.p_brand = b.p_brand AND abs({p} - {q}) <= 3 GROUP BY a.p_brand, a.p_partkey"
_ST = "st AS (SELECT o_orderkey AS episode_id, max(o_totalprice) / 100000 AS mse FROM orders GROUP BY o_orderkey)"
_PR = "exp(-0.01::DOUBLE * ({g} - episode_id / 100)) / (mse + 1e-8)"
_TK = r"""tk AS (SELECT doc_id, unnest(list_concat(list_filter(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '^ +| +$', '', 'g'), ' +', ' ', 'g'), ' '), lambda x: x <> ''), ['<eos>'])) AS token,
generate_subscripts(list_concat(list_filter(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '^ +| +$', '', 'g'), ' +', ' ', 'g'), ' '), lambda x: x <> ''), ['<eos>']), 1) - 1 AS pos FROM documents)"""
_VO = f"{_TK}, vo AS (SELECT token, count(*) AS n, row_number() OVER (ORDER BY token) - 1 AS word_id FROM tk GROUP BY token)"
_u = P.hash_unit_sql
_RG = ["best_validation_error::DOUBLE", "training_error::DOUBLE", "test_error::DOUBLE", "best_validation_predictions", "training_predictions", "test_predictions", "training_error::DOUBLE + best_validation_error::DOUBLE", "training_predictions + best_validation_predictions"]

ORACLES = {
    "innovation_merge": f"{_MERGE} SELECT * FROM m",
    "innovation_crossover": f"{_MERGE} SELECT exact_id, innovation_number, origin, round(CAST(CASE WHEN origin = 'both' THEN weight_1 + 0.5::DOUBLE * (weight_1 - weight_2) ELSE coalesce(weight_1, weight_2) END AS DOUBLE), 6) AS weight FROM m",
    "outpaced_orders": f"SELECT a.o_custkey, a.o_orderkey, count(*) AS n_cheaper FROM ({_ORD}) a JOIN ({_ORD}) b ON a.o_custkey = b.o_custkey AND a.price > 4 * b.price GROUP BY ALL",
    "orphans_anti": f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN ({_BIG})",
    "keep_semi": f"SELECT c_custkey, c_name FROM customer WHERE c_custkey IN ({_URG})",
    "never_urgent": f"SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM ({_URG}) WHERE o_custkey = c.c_custkey)",
    "lookup_join": f"WITH {_G} SELECT DISTINCT g.id, g.exact_id, s.search_name FROM g JOIN exact_search s ON s.id = g.exact_id WHERE s.deleted_at IS NULL",
    "group_left_join": f"WITH {_G}, {_ED} SELECT k.id AS genome_id, count(ed.genome_id) AS n_edges, CAST(coalesce(sum(filter_x * filter_y), 0) AS BIGINT) AS n_weights FROM (SELECT DISTINCT id FROM g) k LEFT JOIN ed ON ed.genome_id = k.id GROUP BY k.id",
    "top1_lateral": f"""WITH {_G}, b AS (SELECT exact_id, id, err, row_number() OVER (PARTITION BY exact_id ORDER BY err, id) AS k FROM g WHERE {_OK} AND exact_id IS NOT NULL)
    SELECT s.id AS search_id, b.id AS genome_id, round(b.err, 6) AS err FROM (SELECT DISTINCT id FROM exact_search WHERE deleted_at IS NULL) s LEFT JOIN b ON b.exact_id = s.id AND k = 1""",
    "top_k_per_group": "SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 3",
    "dedup_best": """SELECT l_suppkey, l_partkey, round(l_extendedprice, 2) AS price, first FROM (SELECT *, l_orderkey * 10 + l_linenumber AS first, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_extendedprice, l_orderkey * 10 + l_linenumber) AS k FROM lineitem) WHERE k = 1""",
    "bounded_population": f"""WITH {_G}, x AS (SELECT DISTINCT exact_id, concat(batch_size, '_', best_epoch) AS structure, err, id FROM g WHERE exact_id IS NOT NULL AND {_OK} AND abs(err) < 'infinity'::DOUBLE),
    y AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY exact_id, structure ORDER BY err, id) AS k FROM x) WHERE k = 1), z AS (SELECT exact_id, structure, err, id, row_number() OVER (PARTITION BY exact_id ORDER BY err, id) AS place FROM y)
    SELECT exact_id, structure, round(err, 6) AS err, id, place FROM z WHERE place <= 10""",
    "rank_islands": f"WITH {_G}, b AS (SELECT exact_id, min(err) AS best FROM g WHERE {_OK} AND exact_id IS NOT NULL GROUP BY exact_id) SELECT exact_id, round(best, 6) AS best, row_number() OVER (ORDER BY b.best DESC, exact_id) AS place FROM b",
    "best_global": f"WITH {_G} SELECT id, round(err, 6) AS err FROM (SELECT id, err FROM g WHERE {_OK} ORDER BY err, id LIMIT 1)",
    "worst_per_island": f"""WITH {_G}, x AS (SELECT exact_id, id, err, row_number() OVER (PARTITION BY exact_id ORDER BY err, id) AS a, row_number() OVER (PARTITION BY exact_id ORDER BY err DESC, id DESC) AS z FROM g WHERE {_OK} AND exact_id IS NOT NULL)
    SELECT exact_id, max(id) FILTER (z = 1) AS worst_id, max(id) FILTER (a = 1) AS best_id, round(max(err) / min(err), 4) AS ratio FROM x GROUP BY exact_id""",
    "structural_hash": f"""WITH {_ED}, n AS (SELECT genome_id, sum(innovation_number) AS n FROM (SELECT DISTINCT * FROM cnn_node) WHERE NOT disabled AND genome_id IS NOT NULL GROUP BY genome_id),
    e AS (SELECT genome_id, sum(innovation_number) FILTER (edge_type = 0) AS c, sum(innovation_number) FILTER (edge_type = 1) AS p FROM ed WHERE NOT disabled AND forward_visited AND reverse_visited GROUP BY genome_id)
    SELECT n.genome_id, concat(coalesce(n, 0), '_', coalesce(c, 0), '_', coalesce(p, 0)) AS hash FROM n LEFT JOIN e USING (genome_id)""",
    "enabled_counts": "SELECT node_type, count(*) FILTER (NOT disabled) AS n_enabled, count(*) AS n_all FROM (SELECT DISTINCT * FROM cnn_node) GROUP BY node_type",
    "reachable_edges": f"WITH {_ED} SELECT edge_type, count(*) FILTER (NOT disabled AND forward_visited AND reverse_visited) AS n_reachable, CAST(sum(filter_x * filter_y) FILTER (NOT disabled AND forward_visited AND reverse_visited) AS BIGINT) AS n_weights FROM ed GROUP BY edge_type",
    "finite_errors": "SELECT exact_id, count(*) AS n FROM cnn_genome WHERE best_validation_error IS NOT NULL AND NOT isnan(best_validation_error) AND abs(best_validation_error) < 1e6 GROUP BY exact_id",
    "running_searches": "SELECT DISTINCT id, search_name, max_genomes - genomes_generated AS left_over FROM exact_search WHERE genomes_generated < max_genomes AND deleted_at IS NULL",
    "cond_counts": "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'O') AS n_open, count(*) FILTER (l_discount > 0.05) AS n_cheap, round(sum(l_quantity * l_tax), 2) AS sum_product FROM lineitem GROUP BY l_returnflag",
    "agg24": "SELECT " + ", ".join(f"round({f}({v})::DOUBLE, 4) AS {f}_{i}" for i, v in enumerate(_RG) for f in ("min", "avg", "max")) + " FROM cnn_genome WHERE NOT isnan(best_validation_error) AND NOT isnan(training_error) AND deleted_at IS NULL AND best_validation_error < 1000",
    "order_limit": "SELECT p_partkey, p_name FROM part ORDER BY p_retailprice * p_size DESC, p_partkey LIMIT 25",
    "not_in_keep": "SELECT DISTINCT id, exact_id FROM cnn_genome WHERE id NOT IN (SELECT id FROM cnn_genome WHERE best_validation_error <= 0.5 AND id IS NOT NULL)",
    "range_computed": "SELECT o_orderkey, round(o_totalprice / 1000, 6) AS thousands FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000",
    "is_null_flag": "SELECT exact_id, count(*) FILTER (test_error IS NULL) AS n_untested, count(*) AS n FROM cnn_genome GROUP BY exact_id",
    "update_set": "SELECT o_orderkey, round(CASE WHEN o_orderstatus = 'P' THEN o_totalprice * 2 ELSE o_totalprice END, 2) AS o_totalprice FROM orders",
    "upsert_rows": "SELECT s_suppkey, round(CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE s_acctbal END, 2) AS s_acctbal FROM supplier",
    "agreeing_results": """WITH x AS (SELECT row_number() OVER () AS k, l_extendedprice AS p, l_partkey, l_suppkey, (l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS content FROM lineitem)
    SELECT a.l_partkey, a.l_suppkey, count(*) FILTER (a.content IS NOT DISTINCT FROM b.content OR isfinite(a.p) AND isfinite(b.p) AND abs(a.p - b.p) < 100) AS n_agree, count(*) AS n_compared
    FROM x a JOIN x b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey AND a.k < b.k GROUP BY ALL""",
    "best_flags": """WITH x AS (SELECT DISTINCT * FROM exact_search WHERE deleted_at IS NULL) SELECT id, id // 20 AS bucket, genomes_generated = min(genomes_generated) OVER (PARTITION BY id // 20) AS best_genomes_generated,
    population_size = min(population_size) OVER (PARTITION BY id // 20) AS best_population_size FROM x""",
    "bucket_averages": "SELECT id // 20 AS bucket, round(avg(genomes_generated), 6) AS avg_generated, round(avg(inserted_genomes), 6) AS avg_inserted FROM (SELECT DISTINCT * FROM exact_search WHERE deleted_at IS NULL) GROUP BY ALL",
    "run_report": """SELECT c_mktsegment, o_orderpriority, round(min(o_totalprice), 2) AS min_price, round(avg(o_totalprice), 2) AS avg_price, round(max(o_totalprice), 2) AS max_price, round(stddev_samp(o_totalprice), 2) AS sd_price,
    round(corr(c_acctbal, o_totalprice), 6) AS corr_balance FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""",
    "zscore_rank": """WITH g AS (SELECT c_mktsegment, o_orderpriority, avg(o_totalprice) AS a FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL), z AS (SELECT o_orderpriority, (a - avg(a) OVER w) / stddev_samp(a) OVER w AS z FROM g WINDOW w AS (PARTITION BY c_mktsegment)),
    m AS (SELECT o_orderpriority, avg(z) AS m FROM z GROUP BY o_orderpriority) SELECT o_orderpriority, round(m, 6) AS mean_z, rank() OVER (ORDER BY round(m, 9)) AS place FROM m""",
    "species_distance": f"""WITH {_ED}, l AS (SELECT exact_id, genome_id, list_sort(list_distinct(list(innovation_number))) AS a FROM ed WHERE genome_id IS NOT NULL AND exact_id IS NOT NULL GROUP BY ALL),
    p AS (SELECT *, lag(a) OVER (PARTITION BY exact_id ORDER BY genome_id) AS b FROM l), q AS (SELECT exact_id, genome_id, list_filter(a, lambda x: NOT list_contains(b, x)) AS oa, list_filter(b, lambda x: NOT list_contains(a, x)) AS ob, a, b FROM p WHERE b IS NOT NULL),
    s AS (SELECT exact_id, genome_id, len(list_filter(oa, lambda x: x > list_max(b))) + len(list_filter(ob, lambda x: x > list_max(a))) AS excess, len(oa) + len(ob) AS alone, len(list_distinct(list_concat(a, b))) AS n_union FROM q)
    SELECT exact_id, genome_id, excess, alone - excess AS disjoint, n_union FROM s""",
    "fitness_share": "SELECT p_partkey, n_near, round(share, 6) AS share FROM (" + _SH.format(p="a.p_size", q="b.p_size", f="a.p_retailprice") + ")",
    "share_outliers": "WITH s AS (" + _SH.format(p="a.p_size * a.p_size", q="b.p_size * b.p_size", f="pow(a.p_size, 12.0::DOUBLE)") + "), l AS (SELECT *, avg(share) OVER w + 3 * sqrt(sum(share * share) OVER w / nullif(count(*) OVER w - 1, 0)) AS lim FROM s WINDOW w AS (PARTITION BY p_brand)) SELECT p_partkey, round(share / 1e12, 6) AS share FROM l WHERE l.share > lim",
    "set_operations": """WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click'), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND value > 60)
    SELECT 'union' AS op, user_id FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect', user_id FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'except', user_id FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""",
    "transfer_names": "SELECT n_name AS name, CASE WHEN n_regionkey IN (1, 2) THEN 'kept' WHEN n_regionkey = 0 THEN 'removed' ELSE 'new' END AS fate FROM nation WHERE n_regionkey IN (0, 1, 2, 3)",
    "sample_uniform": f"SELECT event_id, user_id FROM events ORDER BY {_u('event_id', 7)}, event_id LIMIT 300",
    "sample_weighted": f"SELECT event_id FROM events ORDER BY -ln({_u('event_id', 7)}) / pow(abs(value) + 1e-8, 0.6), event_id LIMIT 300",
    "sample_stratified": f"SELECT event_id, event_type FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY {_u('event_id', 7)}, event_id) AS k FROM events) WHERE k <= 20",
    "sample_permutation": f"SELECT o_orderkey, row_number() OVER (ORDER BY {_u('o_orderkey', 11)}, o_orderkey) - 1 AS place FROM orders",
    "sample_mutations": f"""SELECT ['clone', 'add_edge', 'add_recurrent_edge', 'enable_edge', 'disable_edge', 'add_node', 'enable_node', 'disable_node', 'split_node', 'merge_node'][CAST(floor({_u('o_orderkey', 5)} * 10.0::DOUBLE) AS INT) + 1] AS op,
    count(*) AS n FROM orders GROUP BY op""",
    "sample_normal": f"SELECT o_orderkey, round(10 + 2 * sqrt(-2 * ln({_u('o_orderkey', 3)})) * cos(2 * pi() * {_u('o_orderkey', 7922)}), 6) AS z FROM orders",
    "sample_gumbel": f"SELECT o_orderkey, round(-ln(-ln({_u('o_orderkey', 9)})), 6) AS g FROM orders",
    "priority_values": f"WITH {_ST} SELECT episode_id, round({_PR.format(g=200)}, 6) AS priority FROM st",
    "priority_update": f"WITH {_ST} SELECT episode_id, round(CASE WHEN episode_id = 200 THEN 0.25::DOUBLE WHEN episode_id >= 150 AND episode_id < 200 THEN 0.7::DOUBLE * mse + 0.3::DOUBLE * 0.5 ELSE mse END, 9) AS mse FROM st",
    "priority_topn": f"WITH {_ST} SELECT episode_id FROM st ORDER BY -ln({_u('episode_id', 3)}) / pow({_PR.format(g=200)}, 0.6), episode_id LIMIT 40",
    "priority_log": """WITH a AS (SELECT length(o_orderpriority) AS k, avg(o_totalprice) / 100000 AS mse FROM orders GROUP BY ALL), st AS (SELECT CASE WHEN k < 7 THEN 1 WHEN k < 9 THEN 2 ELSE 3 END AS episode_id, max(mse) AS mse FROM a GROUP BY ALL),
    x AS (SELECT *, CAST(g AS INT) AS generation FROM st, (SELECT unnest(range(0, 5)) AS g)) SELECT generation, """
    + ", ".join(f"round(max(mse) FILTER (episode_id = {k}), 6) AS episode_{k}_mse, round(max(exp(-0.01::DOUBLE * (generation - episode_id)) / (mse + 1e-8)) FILTER (episode_id = {k}), 6) AS episode_{k}_priority" for k in (1, 2, 3)) + " FROM x GROUP BY generation",
    "elite_statistics": f"""WITH {_G}, x AS (SELECT DISTINCT exact_id, id, err FROM g WHERE {_OK} AND exact_id IS NOT NULL), y AS (SELECT *, row_number() OVER (PARTITION BY exact_id ORDER BY err, id) AS k FROM x)
    SELECT exact_id, round(min(err), 6) AS best, round(avg(err), 5) AS avg, round(max(err), 6) AS worst, count(*) AS n FROM y WHERE k <= 5 GROUP BY exact_id""",
    "text_tokens": f"WITH {_TK} SELECT doc_id, count(*) AS n_tokens FROM tk GROUP BY doc_id",
    "text_vocabulary": f"WITH {_VO} SELECT token, word_id, n FROM vo",
    "text_frequencies": f"WITH {_VO} SELECT token, n, round(n / (SELECT sum(n) FROM vo), 9) AS frequency FROM vo",
    "text_next_tokens": f"WITH {_VO}, x AS (SELECT doc_id, pos, word_id AS x, lead(word_id, 2) OVER (PARTITION BY doc_id ORDER BY pos) AS y FROM tk JOIN vo USING (token)) SELECT * FROM x WHERE y IS NOT NULL",
    "text_chunks": f"""WITH {_VO}, x AS (SELECT doc_id, pos // 64 AS chunk, pos % 64 AS k, word_id FROM tk JOIN vo USING (token)) SELECT doc_id, chunk, max(word_id) FILTER (k = 0) AS first_id, coalesce(max(word_id) FILTER (k = 63), -1) AS last_id, 64 AS n FROM x GROUP BY doc_id, chunk""",
    "text_clean": "SELECT doc_id, length(regexp_replace(regexp_replace(text, '^ +| +$', '', 'g'), ' +', ' ', 'g')) AS n FROM documents",
    "activations": """WITH x AS (SELECT *, (l_quantity - 25) / 10 AS x, 1 / (1 + exp(-(l_quantity - 25) / 10)) AS s FROM lineitem) SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(s, 6) AS sigmoid, round(s * (1 - s), 6) AS sigmoid_slope,
    round(2 / (1 + exp(-2 * x)) - 1, 6) AS tanh, round(1 - (2 / (1 + exp(-2 * x)) - 1) ** 2, 6) AS tanh_slope, round(x * s, 6) AS swish, round(s + x * s * (1 - s), 6) AS swish_slope, round(greatest(0.01::DOUBLE * x, x), 6) AS leaky,
    round(CASE WHEN x * 4 <= 0 THEN x * 4 * 0.005::DOUBLE WHEN x * 4 > 5.5 THEN 5.5 ELSE x * 4 END, 6) AS clamped, round(least(greatest(x * 6, -10), 10), 6) AS bound, round(1 / nullif(x, 0), 6) AS inverse, round(sin(x), 6) AS sin, round(cos(x), 6) AS cos FROM x""",
    "array_functions": """WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS v FROM embeddings), e AS (SELECT vec_id, v, list_transform(v, lambda a: exp(a)) AS e FROM x), s AS (SELECT *, list_transform(e, lambda a: a / list_sum(e)) AS s FROM e)
    SELECT vec_id, round(sqrt(list_sum(list_transform(v, lambda a: a * a))), 6) AS norm, list_product(v) AS product, round(s[1], 6) AS p0, list_position(v, list_max(v)) - 1 AS argmax, round(list_max(s) / list_sum(list_reverse_sort(s)[1:3]), 6) AS top3 FROM s""",
    "clamped_moments": """WITH x AS (SELECT user_id, (value - 50) / 3.7::DOUBLE AS v FROM events), m AS (SELECT user_id, avg(least(greatest(v, -10), 10)) AS mu FROM x GROUP BY user_id)
    SELECT user_id, round(any_value(mu), 9) AS mu, round(sqrt(sum((v - mu) ** 2) / (count(*) - 1)), 9) AS sigma FROM x JOIN m USING (user_id) GROUP BY user_id""",
    "label_text": "SELECT DISTINCT search_name, replace(replace(concat(search_name, '_norec'), '_norec', ''), '_', '+') AS label, search_name AS stem FROM exact_search",
}
