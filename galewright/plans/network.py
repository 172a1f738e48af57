"""Queries of cells, networks, evolution and images."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galewright import online
from galewright.functions.cells import run_cell
from galewright.nn.genome import HIDDEN, INPUT, OUTPUT, Edge, Genome, Node
from galewright.nn.training import Optimizer
from galewright.operators import images as I
from galewright.operators import series as S
from galewright.operators.sampling import hash_unit
from galewright.plans.series import EPISODE, _EP, events, r
from galewright.session import table
from galewright.spec import UPDATES, RunConfig, SeriesSpec

# Fixed weights of the cells that queries run.
WEIGHTS = {
    "simple": [0.1], "mgu": [0.5, -0.3, 0.1, 0.8, 0.4, -0.1], "gru": [0.4, 0.3, -0.1, 0.6, -0.2, 0.05, 0.9, 0.5, 0.0], "ugrnn": [0.7, 0.2, 0.1, 0.3, -0.4, 0.0],
    "delta": [0.1, -0.2, 0.3, 0.5, 0.0, -0.1], "jordan": [-0.2], "elman": [0.3], "tanh": [0.2], "sin": [0.4], "cos": [-0.1], "sigmoid": [0.2], "sum": [0.05], "linear": [-0.3], "multiply": [0.6], "inverse": [1.5],
    "enarc": [0.7, 0.3, 0.9, -0.4, 0.8, 0.5, -0.6, 0.4, 0.3, -0.2], "enas": [0.6, -0.2, 0.5, 0.7, -0.3, 0.9, 0.4, -0.5, 0.8, 0.2], "random_dag": [0.8, 0.4, 0.3, -0.6, 0.5, 0.7, -0.2, 0.9, 0.1, 0.6],
    "online_lstm": [0.2, -0.1, 0.05, 0.4, 0.3, 0.0, -0.2, 0.5, 0.1, 0.7, -0.05], "lstm": [0.3, 0.1, 0.0, 0.5, -0.2, 0.1, 0.2, 0.4, 0.0, 0.9, 0.05],
}


def _episode_arrays(spark: SparkSession, d: str) -> DataFrame:
    e = S.episodes(events(spark, d), "user_id", "t", EPISODE)
    return e.groupBy("episode_id").agg(F.array_sort(F.collect_list(F.struct("step", (F.col("value") / 100).alias("x")))).alias("a")).select("episode_id", F.col("a.x").alias("xs"))


def _cell(name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        ys = _episode_arrays(spark, d).select("episode_id", run_cell(name, WEIGHTS[name], F.col("xs")).alias("ys"))
        return ys.select("episode_id", r(F.element_at("ys", -1)).alias("last_y"), r(F.aggregate("ys", F.lit(0.0), lambda a, y: a + y), 5).alias("sum_y"))

    return run


def _training(spark: SparkSession, d: str):
    """A small forecasting task: next value of a user from value and its logarithm, in episodes."""
    e = events(spark, d).withColumn("log_value", F.log1p(F.abs("value")))
    spec = SeriesSpec(("value", "log_value"), ("value",), offset=1, length=EPISODE)
    return online.prepare_episodes(e, "user_id", "t", spec), spec


def _network() -> Genome:
    """Two inputs, a tanh cell with a delayed connection to itself, a linear output that also sees the first input two steps late."""
    nodes = [Node(1, INPUT, "linear", 0.0, "value", True, [0.1]), Node(2, INPUT, "linear", 0.0, "log_value", True, [-0.2]), Node(3, HIDDEN, "simple", 0.5, None, True, [0.05]), Node(4, OUTPUT, "linear", 1.0, "value", True, [0.3])]
    edges = [Edge(1, 1, 3, 0, 0.7), Edge(2, 2, 3, 0, -0.4), Edge(3, 3, 3, 1, 0.5), Edge(4, 3, 4, 0, 0.9), Edge(5, 1, 4, 2, -0.6), Edge(6, 2, 4, 0, 5.0, False)]
    return Genome(nodes, edges)


def network_forward(spark: SparkSession, d: str) -> DataFrame:
    """Predictions of a fixed network over all episodes, in Arrow batches."""
    data, spec = _training(spark, d)
    p = online.score(spark, _network(), data, spec)
    return p.groupBy("episode_id").agg(r(F.sum("predicted"), 5).alias("sum_predicted"), r(F.max(F.when(F.col("step") == spec.length - 1, F.col("predicted")))).alias("last_predicted"), r(F.avg((F.col("predicted") - F.col("expected")) ** 2)).alias("mse"))


def train_small(spark: SparkSession, d: str) -> DataFrame:
    """Three architectures trained together on all episodes; every fifth by hash validates."""
    data, spec = _training(spark, d)
    jobs = [{"job": k, "cell": c, "hidden": 2, "layers": 1, "seed": 1} for k, c in enumerate(("simple", "gru", "mgu"))]
    out = online.train_grid(spark, data.withColumn("held", hash_unit(F.col("episode_id"), 5) < 0.2), spec, jobs, iterations=3)
    return out.select("job", "cell", "n_training", "n_validation", r("train_mse").alias("train_mse"), r("validation_mse").alias("validation_mse"), r("validation_mae").alias("validation_mae"))


def kfold_sweep(spark: SparkSession, d: str) -> DataFrame:
    data, spec = _training(spark, d)
    out = online.kfold_sweep(spark, data, spec, cells=["simple", "ugrnn"], folds=3, iterations=1)
    return out.select("cell", "fold", "repeat", r("train_mse").alias("train_mse"), r("test_mse").alias("test_mse"), r("test_mae").alias("test_mae"))


def evolve_small(spark: SparkSession, d: str) -> DataFrame:
    """An online run on two islands over all episodes: as many generations as they give."""
    data, spec = _training(spark, d)
    config = RunConfig(islands=2, island_size=3, generated=2, generations=sys.maxsize, iterations=1, training_episodes=10, validation_episodes=2, seed=3)
    log = online.OnlineRun(spark, data, spec, config, batch=5).run()
    return log.select("generation", "test_episode", r("best_validation_mse").alias("best_validation_mse"), r("naive_mse").alias("naive_mse"), r("model_mse").alias("model_mse"))


# Images: vectors of 64 numbers as pictures of 8 by 8.


def _pixels(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("k", "v"))
    return e.select("vec_id", "label", F.floor(F.col("k") / 8).cast("int").alias("y"), (F.col("k") % 8).alias("x"), F.col("v").cast("double").alias("v"))


def image_channel_stats(spark, d):
    p = _pixels(spark, d).withColumn("channel", F.col("x") % 2)
    return I.channel_statistics(p, "vec_id", "channel", "v").select(F.col("channel").cast("bigint").alias("channel"), r("mean", 5).alias("mean"), r("sd", 5).alias("sd"))


def image_convolution(spark, d):
    """Valid 3 by 3 convolution of each picture in a Pandas function over whole batches; the sum of its outputs and the greatest one."""
    w = np.arange(9, dtype=float).reshape(3, 3) / 10

    def run(batches):
        for b in batches:
            if len(b):
                y = I.convolve(np.stack(b["embedding"].to_list()).astype(float).reshape(-1, 8, 8), w)
                yield pd.DataFrame({"vec_id": b["vec_id"], "total": y.sum((1, 2)), "top": y.max((1, 2))})

    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return e.mapInPandas(run, "vec_id long, total double, top double").select("vec_id", r("total", 4).alias("total"), r("top", 4).alias("top"))


def image_pooling(spark, d):
    """Pools of uneven size by expressions: rows 0-2, 3-5, 6-7 and the same columns."""
    p = _pixels(spark, d)
    pool = lambda c: F.least(F.floor(F.col(c) / 3), F.lit(2)).cast("bigint")
    return p.groupBy("vec_id", pool("y").alias("py"), pool("x").alias("px")).agg(r(F.max("v")).alias("top"))


def image_heat_map(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.lit(8).alias("h"), F.lit(8).alias("w"), F.col("embedding")[0].cast("double").alias("score"))
    win = I.windows(e, "h", "w", 4, 2)
    return I.heat_map(win, "vec_id", "y", "x", "score", 4).select("vec_id", "py", "px", r("heat", 5).alias("heat"), "overlap")


def image_heat_top(spark, d):
    return image_heat_map(spark, d).groupBy("vec_id").agg(F.max("heat").alias("top_heat"))


def image_crop(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") * 37 % 200).alias("y"), (F.col("s_suppkey") * 91 % 300).alias("x"))
    box = I.crop_box(F.col("y"), F.col("x"), 32, F.lit(200), F.lit(300))
    return s.select("s_suppkey", *[b.cast("bigint").alias(n) for b, n in zip(box, ("top", "left", "bottom", "right"))])


def image_subimages(spark, d):
    pics = table(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") % 4 + 1).alias("ny"), (F.col("n_regionkey") + 1).alias("nx"))
    asked = spark.range(0, 120).select("id")
    return I.locate_subimages(pics, "n_nationkey", "ny", "nx", asked, "id").select("id", "n_nationkey", F.col("sub_y").cast("bigint").alias("sub_y"), F.col("sub_x").cast("bigint").alias("sub_x"))


def image_classification(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", (F.col("label") % 10).cast("int").alias("label"), F.posexplode(F.slice("embedding", 1, 10)).alias("k", "score"))
    c = I.classified(e.withColumn("score", F.col("score").cast("double")), "vec_id", "k", "score", "label")
    return c.select("vec_id", "label", "predicted", "correct", r("loss", 5).alias("loss"))


def image_class_sizes(spark, d):
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"))


def image_operations(spark, d):
    e = table(spark, d, "cnn_edge").distinct().where("genome_id IS NOT NULL AND NOT disabled AND edge_type = 0").select("genome_id", "output_node_innovation_number", "filter_x", "filter_y")
    n = table(spark, d, "cnn_node").distinct().where("genome_id IS NOT NULL").select("genome_id", F.col("innovation_number").alias("output_node_innovation_number"), "size_x", "size_y")
    cost = I.operations_estimate(F.col("filter_y"), F.col("filter_x"), F.col("size_y"), F.col("size_x"))
    return e.join(n, ["genome_id", "output_node_innovation_number"]).groupBy("genome_id").agg(F.sum(cost).alias("operations"))


def _step_query(method: str):
    """Two steps of a method from weights and gradients that orders give: one weight per customer segment and priority, gradients scaled to a norm between
    0.05 and 1 per segment."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        cell = o.groupBy("c_mktsegment", "o_orderpriority").agg((F.avg("o_totalprice") / 100_000).alias("w"), ((F.avg("c_acctbal") - 4_500) / 1_000).alias("g1"), ((F.stddev_samp("c_acctbal") - 3_000) / 1_000).alias("g2"))
        lists = cell.groupBy("c_mktsegment").agg(F.array_sort(F.collect_list(F.struct("o_orderpriority", "w", "g1", "g2"))).alias("r"))  # a genome's weights

        def steps(batches):
            for b in batches:
                for segment, rows in zip(b["c_mktsegment"], b["r"]):
                    rows = [r.asDict() if hasattr(r, "asDict") else dict(r) for r in rows]
                    get = lambda c, rows=rows: np.array([r[c] for r in rows], float)
                    opt, w = Optimizer(method, rate=0.1), get("w")
                    for g in ("g1", "g2"):
                        w = opt.step(w, get(g))
                    yield pd.DataFrame({"c_mktsegment": segment, "o_orderpriority": [r["o_orderpriority"] for r in rows], "weight": w})

        out = lists.mapInPandas(steps, "c_mktsegment string, o_orderpriority string, weight double")
        return out.select("c_mktsegment", "o_orderpriority", r("weight", 5).alias("weight"))

    return run


def _step_sql(method: str) -> str:
    first = {
        "vanilla": ("-0.1 * a", "-0.1 * b"), "momentum": ("-0.1 * a", "0.9 * (-0.1 * a) - 0.1 * b"),
        "nesterov": ("1.9 * (-0.1 * a)", "1.9 * (0.9 * (-0.1 * a) - 0.1 * b) - 0.9 * (-0.1 * a)"),
        "adagrad": ("-0.1 * a / (abs(a) + 1e-8)", "-0.1 * b / (sqrt(a * a + b * b) + 1e-8)"),
        "rmsprop": ("-0.1 * a / (sqrt(0.1 * a * a) + 1e-8)", "-0.1 * b / (sqrt(0.9 * 0.1 * a * a + 0.1 * b * b) + 1e-8)"),
        "adam": ("-0.1 * (0.1 * a) / (sqrt(0.01 * a * a) + 1e-8)", "-0.1 * (0.09 * a + 0.1 * b) / (sqrt(0.0099 * a * a + 0.01 * b * b) + 1e-8)"),
        "adam-bias": ("-0.1 * a / (abs(a) + 1e-8)", "-0.1 * ((0.09 * a + 0.1 * b) / 0.19) / (sqrt((0.0099 * a * a + 0.01 * b * b) / 0.0199) + 1e-8)"),
    }
    one, two = first[method]
    scale = "g{k} * CASE WHEN n{k} > 1 THEN 1 / n{k} WHEN n{k} > 0 AND n{k} < 0.05 THEN 0.05 / n{k} ELSE 1 END"
    return f"""WITH c AS (SELECT c_mktsegment, o_orderpriority, avg(o_totalprice) / 100000 AS w, (avg(c_acctbal) - 4500) / 1000 AS g1, (stddev_samp(c_acctbal) - 3000) / 1000 AS g2 FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
    n AS (SELECT *, sqrt(sum(g1 * g1) OVER s) AS n1, sqrt(sum(g2 * g2) OVER s) AS n2 FROM c WINDOW s AS (PARTITION BY c_mktsegment)), x AS (SELECT c_mktsegment, o_orderpriority, w, {scale.format(k=1)} AS a, {scale.format(k=2)} AS b FROM n)
    SELECT c_mktsegment, o_orderpriority, round(least(greatest(least(greatest(w + {one}, -10), 10) + {two}, -10), 10), 5) AS weight FROM x"""


QUERIES = {f"cell_{c}": _cell(c) for c in WEIGHTS} | {f"step_{m.replace('-', '_')}": _step_query(m) for m in UPDATES} | {f.__name__: f for f in (
    network_forward, train_small, kfold_sweep, evolve_small, image_channel_stats, image_convolution, image_pooling, image_heat_map, image_heat_top, image_crop, image_subimages, image_classification, image_class_sizes, image_operations,
)}

_SIG = "(1 / (1 + exp(-({0}))))"
_TANH = "(2 / (1 + exp(-2 * ({0}))) - 1)"


# The searched cells node by node, written out: each is named and made of the ones before it.
GRAPH_SQL = {
    "enarc": (["tanh n0", "tanh n1", "leaky n1", "leaky n2", "swish n3", "swish n1", "tanh n3", "swish n3"], "n4 + n5 + n6 + n7 + n8"),
    "enas": (["tanh n0", "tanh n0", "leaky n0", "leaky n1", "sigmoid n4", "swish n2", "tanh n4", "swish n3"], "n5 + n6 + n7 + n8"),
    "random_dag": (["tanh 0", "tanh 0", "leaky 0", "leaky 0", "sigmoid n1 + n1", "swish n1", "tanh 0"], "n2 + n3 + n4 + n5 + n6 + n7"),
}


def _graph_sql(name: str, w: list[str]) -> str:
    """The recursion with one column per inner node, by lateral joins."""
    act = {"tanh": _TANH, "sigmoid": _SIG, "leaky": "greatest(0.01::DOUBLE * ({0}), ({0}))", "swish": "(({0}) * " + _SIG + ")"}
    nodes, out = GRAPH_SQL[name]
    laterals = f", LATERAL (SELECT {_TANH.format(f'{w[0]} * p.x + {w[1]} * rec.h')} AS n0) l0"
    for k, node in enumerate(nodes):
        kind, total = node.split(" ", 1)
        laterals += f", LATERAL (SELECT {act[kind].format(f'{w[k + 2]} * ({total})')} AS n{k + 1}) l{k + 1}"
    return f"""WITH RECURSIVE {_EP}, p AS (SELECT episode_id, step, value / 100 AS x FROM ep),
    rec(episode_id, step, h) AS (SELECT episode_id, CAST(-1 AS BIGINT), 0::DOUBLE FROM (SELECT DISTINCT episode_id FROM p)
    UNION ALL SELECT rec.episode_id, rec.step + 1, {out} FROM rec JOIN p ON p.episode_id = rec.episode_id AND p.step = rec.step + 1{laterals})
    SELECT episode_id, round(max(h) FILTER (step = 19), 6) AS last_y, round(sum(h), 5) AS sum_y FROM rec GROUP BY episode_id"""


def _cell_sql(name: str) -> str:
    w = [f"({float(v)}::DOUBLE)" for v in WEIGHTS[name]]
    sig, tanh = _SIG.format, _TANH.format
    c = "c"
    plain = {"sin": "sin({0})", "cos": "cos({0})", "sigmoid": _SIG, "inverse": "(1 / ({0}))"} | dict.fromkeys(("simple", "jordan", "elman", "tanh"), _TANH) | dict.fromkeys(("sum", "linear", "multiply"), "({0})")
    if name in plain:
        y = plain[name].format(f"x + {w[0]}")
    elif name in GRAPH_SQL:
        return _graph_sql(name, w)
    elif name == "gru":
        z, q = sig(f"{w[2]} + {w[1]} * h + {w[0]} * x"), sig(f"{w[5]} + {w[3]} * x + {w[4]} * h")
        y = f"{z} * h + (1 - {z}) * " + tanh(f"{w[8]} + {w[6]} * x + {w[7]} * {q} * h")
    elif name == "ugrnn":
        g = sig(f"{w[3]} * x + {w[4]} * h + {w[5]}")
        y = f"{g} * h + (1 - {g}) * " + tanh(f"{w[0]} * x + {w[1]} * h + {w[2]}")
    elif name == "mgu":
        f = sig(f"{w[2]} + {w[1]} * h + {w[0]} * x")
        y = f"(1 - {f}) * h + {f} * " + tanh(f"{w[5]} + {w[3]} * x + {w[4]} * {f} * h")
    elif name == "delta":
        inner = tanh(f"{w[3]} * h * x * ({w[0]} + 2) + {w[3]} * h * ({w[1]} + 1) + x * ({w[2]} + 1) + {w[5]}")
        q = sig(f"x + {w[4]}")
        y = tanh(f"{inner} * (1 - {q}) + {q} * h")
    else:
        o, i, f = (sig(f"{w[k]} * x + {w[k + 1]} * c + {w[k + 2]}" + (" + 1" if k == 6 else "")) for k in (0, 3, 6))
        c = f"{f} * c + {i} * " + tanh(f"{w[9]} * x + {w[10]}")
        y = f"{o} * ({c})"
    return f"""WITH RECURSIVE {_EP}, p AS (SELECT episode_id, step, value / 100 AS x FROM ep),
    rec(episode_id, step, h, c) AS (SELECT episode_id, CAST(-1 AS BIGINT), 0::DOUBLE, 0::DOUBLE FROM (SELECT DISTINCT episode_id FROM p)
    UNION ALL SELECT rec.episode_id, rec.step + 1, {y}, {c} FROM rec JOIN p ON p.episode_id = rec.episode_id AND p.step = rec.step + 1)
    SELECT episode_id, round(max(h) FILTER (step = 19), 6) AS last_y, round(sum(h), 5) AS sum_y FROM rec GROUP BY episode_id"""


_PX = "px AS (SELECT vec_id, label, (k - 1) // 8 AS y, (k - 1) % 8 AS x, embedding[k]::DOUBLE AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS k))"
_HEAT = """hm AS (SELECT vec_id, y + dy AS py, x + dx AS px, sum(s) AS heat, count(*) AS overlap FROM (SELECT vec_id, embedding[1]::DOUBLE AS s FROM embeddings), (SELECT unnest([0, 2, 4]) AS y), (SELECT unnest([0, 2, 4]) AS x),
(SELECT unnest(range(0, 4)) AS dy), (SELECT unnest(range(0, 4)) AS dx) GROUP BY ALL), hn AS (SELECT vec_id, py, px, round(heat / max(overlap) OVER (PARTITION BY vec_id), 5) AS heat, overlap FROM hm)"""

ORACLES = {f"cell_{c}": _cell_sql(c) for c in WEIGHTS} | {f"step_{m.replace('-', '_')}": _step_sql(m) for m in UPDATES} | {
    "network_forward": """WITH RECURSIVE l AS (SELECT *, ln(1 + abs(value)) AS lg, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t FROM events), b AS (SELECT min(value) AS lo, max(value) AS hi, min(lg) AS llo, max(lg) AS lhi FROM l),
    n AS (SELECT user_id, t, (value - lo) / (hi - lo) AS v, (lg - llo) / (lhi - llo) AS g, lead((value - lo) / (hi - lo)) OVER (PARTITION BY user_id ORDER BY t) AS y FROM l, b), q AS (SELECT * FROM n WHERE y IS NOT NULL),
    sl AS (SELECT user_id, (max(t) + 1) // 20 AS k FROM q GROUP BY user_id), st AS (SELECT user_id, k, coalesce(sum(k) OVER (ORDER BY user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM sl),
    p AS (SELECT CAST(f + t // 20 AS BIGINT) AS episode_id, t % 20 AS step, v + 0.1::DOUBLE AS a, g - 0.2::DOUBLE AS b, y, lag(v + 0.1::DOUBLE, 2) OVER (PARTITION BY user_id, t // 20 ORDER BY t) AS late FROM q JOIN st USING (user_id) WHERE t // 20 < k),
    rec(episode_id, step, h, o, y) AS (SELECT DISTINCT episode_id, CAST(-1 AS BIGINT), 0::DOUBLE, 0::DOUBLE, 0::DOUBLE FROM p UNION ALL
    SELECT rec.episode_id, rec.step + 1, z.h, 0.9::DOUBLE * z.h - 0.6::DOUBLE * coalesce(late, 0) + 0.3::DOUBLE, p.y FROM rec JOIN p ON p.episode_id = rec.episode_id AND p.step = rec.step + 1, LATERAL (SELECT """ + _TANH.format("0.7::DOUBLE * a - 0.4::DOUBLE * b + 0.5::DOUBLE * rec.h + 0.05::DOUBLE") + """ AS h) z)
    SELECT episode_id, round(sum(o), 5) AS sum_predicted, round(max(o) FILTER (step = 19), 6) AS last_predicted, round(avg((o - y) ** 2), 6) AS mse FROM rec WHERE step >= 0 GROUP BY episode_id""",
    "image_channel_stats": f"""WITH {_PX}, m AS (SELECT x % 2 AS channel, avg(v) AS mean FROM px GROUP BY ALL), d AS (SELECT x % 2 AS channel, vec_id, any_value(mean) AS mean, avg((v - mean) ** 2) AS q FROM px JOIN m ON m.channel = x % 2 GROUP BY ALL)
    SELECT channel, round(any_value(mean), 5) AS mean, round(sqrt(avg(q)), 5) AS sd FROM d GROUP BY channel""",
    "image_convolution": f"""WITH {_PX}, c AS (SELECT a.vec_id, a.y, a.x, sum(b.v * ((b.y - a.y) * 3 + b.x - a.x) / 10) AS o FROM px a JOIN px b ON a.vec_id = b.vec_id AND b.y - a.y BETWEEN 0 AND 2 AND b.x - a.x BETWEEN 0 AND 2 WHERE a.y <= 5 AND a.x <= 5 GROUP BY ALL)
    SELECT vec_id, round(sum(o), 4) AS total, round(max(o), 4) AS top FROM c GROUP BY vec_id""",
    "image_pooling": f"WITH {_PX} SELECT vec_id, least(y // 3, 2) AS py, least(x // 3, 2) AS px, round(max(v), 6) AS top FROM px GROUP BY ALL",
    "image_heat_map": f"WITH {_HEAT} SELECT * FROM hn",
    "image_heat_top": f"WITH {_HEAT} SELECT vec_id, max(heat) AS top_heat FROM hn GROUP BY vec_id",
    "image_crop": """WITH s AS (SELECT s_suppkey, s_suppkey * 37 % 200 AS y, s_suppkey * 91 % 300 AS x FROM supplier), b AS (SELECT s_suppkey, greatest(least(y - 32, 136), 0) AS top, greatest(least(x - 32, 236), 0) AS "left" FROM s)
    SELECT s_suppkey, top, "left", least(top + 64, 200) AS bottom, least("left" + 64, 300) AS "right" FROM b""",
    "image_subimages": """WITH p AS (SELECT n_nationkey, n_nationkey % 4 + 1 AS ny, n_regionkey + 1 AS nx FROM nation), q AS (SELECT *, sum(ny * nx) OVER (ORDER BY n_nationkey) AS z FROM p)
    SELECT CAST(id AS BIGINT) AS id, n_nationkey, CAST((id - (z - ny * nx)) // nx AS BIGINT) AS sub_y, CAST((id - (z - ny * nx)) % nx AS BIGINT) AS sub_x FROM (SELECT unnest(range(0, 120)) AS id), q WHERE id >= z - ny * nx AND id < z""",
    "image_classification": """WITH x AS (SELECT vec_id, label % 10 AS label, k - 1 AS k, embedding[k]::DOUBLE AS s FROM embeddings, (SELECT unnest(range(1, 11)) AS k)), p AS (SELECT vec_id, k FROM (SELECT vec_id, k, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, k) AS i FROM x) WHERE i = 1)
    SELECT x.vec_id, any_value(x.label) AS label, CAST(any_value(p.k) AS INT) AS predicted, any_value(p.k) = any_value(x.label) AS correct, round(ln(sum(exp(s))) - max(s) FILTER (x.k = x.label), 5) AS loss FROM x JOIN p ON p.vec_id = x.vec_id GROUP BY x.vec_id""",
    "image_class_sizes": "SELECT label, count(*) AS n FROM embeddings GROUP BY label",
    "image_operations": """SELECT e.genome_id, CAST(sum(filter_y * filter_x * size_y * size_x) AS BIGINT) AS operations FROM (SELECT DISTINCT * FROM cnn_edge) e JOIN (SELECT DISTINCT * FROM cnn_node) n ON n.genome_id = e.genome_id AND n.innovation_number = e.output_node_innovation_number
    WHERE NOT e.disabled AND edge_type = 0 GROUP BY e.genome_id""",
}
