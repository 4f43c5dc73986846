"""Neighbours, layouts, clusters, examples, losses, training."""

from __future__ import annotations

from pyspark.sql import functions as F

from gistmill.dims import STOP_WORDS
from gistmill.operators import clusters as cl
from gistmill.operators import contrastive as cn
from gistmill.operators import neighbours as nb
from gistmill.operators.train import train_head
from gistmill.plans import workflows as wf
from gistmill.registry import tables as t
from gistmill.registry.tables import sql_draw
from gistmill.session import written

EPS, MIN_SAMPLES, MIN_CLUSTER, K = 1.205, 10, 10, 15
N_EXAMPLES = 2000


def q_profile(spark, sf):
    out = nb.pairwise_cosine(t.embeddings(spark, sf))
    return out.select("id", "others", t.r6("mean_sim"), t.r6("min_sim"), t.r6("max_sim"), "close")


def knn(spark, sf):
    return nb.knn_graph(t.embeddings(spark, sf), K)


def q_knn(spark, sf):
    return knn(spark, sf).select("id", "rank", "nbr", t.r6("dist"))


def q_fuzzy(spark, sf):
    return nb.fuzzy_graph(knn(spark, sf), K).select("a", "b", t.r6("weight"))


def q_layout(spark, sf):
    out = nb.spectral_layout(nb.fuzzy_graph(knn(spark, sf), K), 2)
    return out.select("id", t.r6(F.get("coords", F.lit(0)), "x"), t.r6(F.get("coords", F.lit(1)), "y"))


def split_vectors(df):
    return df.withColumn("split", F.when(F.col("vec_id") % 5 == 0, "test").otherwise("train"))


def q_project(spark, sf):
    return wf.project_2d(split_vectors(t.embeddings(spark, sf)), "graph").select("vec_id", "label", "split", t.r6("x"), t.r6("y"))


def flat_knn(spark, sf):
    return nb.knn_graph(t.embeddings(spark, sf), MIN_SAMPLES, "euclidean")


def q_core(spark, sf):
    return cl.core_distance(flat_knn(spark, sf), MIN_SAMPLES).select("id", t.r6("core"))


def q_reach(spark, sf):
    g = flat_knn(spark, sf).persist()
    return cl.mutual_reachability(g, cl.core_distance(g, MIN_SAMPLES)).select("id", "nbr", t.r6("reach"))


def clustered(df):
    core = cl.core_distance(nb.knn_graph(df, MIN_SAMPLES, "euclidean"), MIN_SAMPLES)
    return cl.density_clusters(df, EPS, core, MIN_CLUSTER, "euclidean")


def q_clusters(spark, sf):
    return clustered(t.embeddings(spark, sf))


def q_assign(spark, sf):
    df = split_vectors(t.embeddings(spark, sf))
    train = df.filter("split = 'train'")
    named = train.join(clustered(train).withColumnRenamed("id", "vec_id"), "vec_id")
    out = cl.assign_topics(df.filter("split = 'test'"), named, EPS, "euclidean")
    return out.select("id", "nbr", t.r6("dist"), "topic")


def q_probability(spark, sf):
    e = t.embeddings(spark, sf).withColumnRenamed("label", "topic")
    return cl.topic_probability(e, e).select("id", "best_topic", t.r6("topic_probability"))


def q_kmeans(spark, sf):
    return cl.kmeans(t.embeddings(spark, sf)).select("vec_id", "cluster")


def q_quality(spark, sf):
    return cl.embedding_quality(t.embeddings(spark, sf)).select(t.r6("silhouette"), "n_dimensions", "n_samples")


def simcse(spark, sf):
    return cn.simcse_pairs(t.embeddings(spark, sf), N_EXAMPLES, "vec_id")


def pairs(spark, sf):
    return cn.cosine_pairs(t.embeddings(spark, sf), N_EXAMPLES, "vec_id")


def triplets(spark, sf):
    return cn.mine_triplets(t.embeddings(spark, sf), N_EXAMPLES)


def q_triplet_loss(spark, sf):
    return cn.triplet_loss(triplets(spark, sf), t.embeddings(spark, sf)).select(t.r6("loss"), "examples")


def q_ranking_loss(spark, sf):
    positives = pairs(spark, sf).filter("target = 1.0")
    return cn.ranking_loss(positives, t.embeddings(spark, sf)).select(t.r6("loss"), "examples")


def q_cosine_loss(spark, sf):
    return cn.cosine_loss(pairs(spark, sf), t.embeddings(spark, sf)).select(t.r6("loss"), "examples")


def q_train(spark, sf):
    e = t.embeddings(spark, sf)
    head = train_head(triplets(spark, sf), e, "triplet", epochs=8, lr=1e-3)
    out = head.transform(e)
    return out.select("vec_id", F.posexplode("embedding").alias("d", "x")).select("vec_id", "d", t.r6("x"))


def q_compare(spark, sf):
    out = wf.compare_approaches(t.embeddings(spark, sf), N_EXAMPLES, epochs=8, lr=1e-3)
    return out.select("approach", "examples", t.r6("first_loss"), t.r6("last_loss"), t.r6("davies_bouldin"))


def q_workflow(spark, sf):
    v = t.doc_vectors(spark, sf)
    # Written, as the fit reads the vectors many times.
    docs = written(v.select("doc_id", "text", "split", F.col("broad_label_id").alias("label"), "embedding"), "vectors")
    out = wf.topics_to_scores(
        docs, stop=STOP_WORDS, metric="euclidean", k_neighbours=K, min_samples=MIN_SAMPLES, core_quantile=0.3, ngram_range=(1, 1)
    )
    return out.select("split", "total", "after_outliers", "after_unmapped", "samples", t.r6("macro_f1"), t.r6("weighted_f1"))


QUERIES = {
    "pairwise_cosine": q_profile,
    "knn_graph": q_knn,
    "fuzzy_graph": q_fuzzy,
    "spectral_layout": q_layout,
    "project_2d": q_project,
    "simcse_pairs": simcse,
    "cosine_pairs": pairs,
    "mine_triplets": triplets,
    "triplet_loss": q_triplet_loss,
    "ranking_loss": q_ranking_loss,
    "cosine_loss": q_cosine_loss,
    "train_head": q_train,
    "compare_approaches": q_compare,
    "kmeans": q_kmeans,
    "core_distance": q_core,
    "mutual_reachability": q_reach,
    "density_clusters": q_clusters,
    "assign_topics": q_assign,
    "topic_probability": q_probability,
    "embedding_quality": q_quality,
    "topics_to_scores": q_workflow,
}

UNIT = (
    "unit",
    "select vec_id as id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) as v from "
    "(select vec_id, label, embedding::double[] as e from embeddings)",
)


def flat(where: str = "true"):
    return ("unit", f"select vec_id as id, label, embedding::double[] as v from embeddings where {where}")


def knn_views(k: int, metric: str) -> list[tuple[str, str]]:
    d = "1 - list_dot_product(a.v, b.v)" if metric == "cosine" else "list_distance(a.v, b.v)"
    return [
        ("dist", f"select a.id, b.id as nbr, {d} as dist from unit a join unit b on a.id <> b.id"),
        (
            "knn",
            "select * from (select *, cast(row_number() over (partition by id order by dist, nbr) as int) as rank from dist) "
            f"where rank <= {k}",
        ),
    ]


CORE = ("core", f"select id, max(dist) as core from knn group by id having count(*) = {MIN_SAMPLES}")
CLUSTER = [
    ("cp", f"select id from core where core <= {EPS}"),
    ("link", f"select id as u, nbr as v from dist where dist <= {EPS} and id in (select id from cp) and nbr in (select id from cp)"),
    ("walk", "select id, id as root from cp union select l.v, w.root from walk w join link l on l.u = w.id"),
    ("comp", "select id, min(root) as c from walk group by id"),
    (
        "big",
        "select c, cast(row_number() over (order by n desc, c) - 1 as int) as topic from "
        f"(select c, count(*) as n from comp group by c having count(*) >= {MIN_CLUSTER})",
    ),
    ("clu", "select unit.id, coalesce(topic, -1) as topic from unit left join comp using (id) left join big using (c)"),
]

INDEX = (
    "ix",
    "select label, id, row_number() over (partition by label order by md5('42:' || id), id) - 1 as pos, "
    "count(*) over (partition by label) as members from unit",
)
TRIPLETS = [
    (
        "anc",
        f"select *, (pos + {sql_draw(43, 'id')} % (members - 1) + 1) % members as at from ix where members >= 2 order by id limit {N_EXAMPLES}",
    ),
    ("pos_t", "select a.id, b.id as p_id from anc a join ix b on a.label = b.label and a.at = b.pos"),
    (
        "neg_t",
        "select id, first(nbr order by d, nbr) as n_id from (select a.id, b.id as nbr, 1 - list_dot_product(u.v, b.v) as d "
        "from anc a join unit u on u.id = a.id join unit b on b.label <> a.label) group by id",
    ),
    ("tri", "select id as a_id, p_id, n_id from pos_t join neg_t using (id)"),
]
HALF = N_EXAMPLES // 2
PAIRS = [
    ("lab2", "select *, row_number() over (order by label) - 1 as li, count(*) over () as k from (select distinct label, members from ix where members >= 2)"),
    ("lab1", "select *, row_number() over (order by label) - 1 as li, count(*) over () as k from (select distinct label, members from ix)"),
    (
        "pp",
        f"select i, label, members, {sql_draw(44, 'i')} % members as f, {sql_draw(45, 'i')} % (members - 1) + 1 as s from "
        f"(select unnest(range({HALF})) as i) join lab2 on li = {sql_draw(43, 'i')} % k",
    ),
    (
        "pos_p",
        "select i as pair_id, a.id as a_id, b.id as b_id, 1.0::double as target from pp join ix a on a.label = pp.label and a.pos = f "
        "join ix b on b.label = pp.label and b.pos = (f + s) % pp.members",
    ),
    (
        "nn",
        f"select i, x.label as l1, x.members as m1, y.label as l2, y.members as m2 from (select unnest(range({HALF})) as i) "
        f"join lab1 x on x.li = {sql_draw(46, 'i')} % x.k "
        f"join lab1 y on y.li = ({sql_draw(46, 'i')} % y.k + {sql_draw(47, 'i')} % (y.k - 1) + 1) % y.k",
    ),
    (
        "neg_p",
        f"select i + {HALF} as pair_id, a.id as a_id, b.id as b_id, 0.0::double as target from nn join ix a on a.label = l1 and "
        f"a.pos = {sql_draw(48, 'i')} % m1 join ix b on b.label = l2 and b.pos = {sql_draw(49, 'i')} % m2",
    ),
    ("prs", "select * from pos_p union all select * from neg_p"),
]

COS = "list_dot_product({0}.v, {1}.v)"


def chain(views, body, recursive=False):
    return f"with {'recursive ' if recursive else ''}" + ",\n".join(f"{n} as ({b})" for n, b in views) + "\n" + body


FUZZY = [
    ("rho", "select id, list(dist order by rank) as ds, coalesce(min(dist) filter (dist > 0), 0) as rho from knn group by id"),
    ("ex", "select id, rho, list_transform(ds, lambda d: greatest(d - rho, 0)) as x from rho"),
    (
        "half",
        "select id, x, 0 as it, 0.0::double as lo, 1e300::double as hi, 1.0::double as mid from ex union all "
        "select id, x, it + 1, case when big then lo else mid end, case when big then mid else hi end, "
        "case when big then (lo + mid) / 2 when hi = 1e300 then mid * 2 else (mid + hi) / 2 end from "
        f"(select *, list_sum(list_transform(x, lambda d: exp(-d / mid))) > log2({K}) as big from half where it < 40)",
    ),
    ("sig", "select id, greatest(mid, 1e-9) as sigma from half where it = 40"),
    (
        "dir",
        "select least(id, nbr) as a, greatest(id, nbr) as b, exp(-greatest(dist - rho, 0) / sigma) as w from knn "
        "join rho using (id) join sig using (id)",
    ),
]

ORACLE = {
    "pairwise_cosine": chain(
        [UNIT],
        "select id, count(*) as others, round(avg(s), 6) + 0.0 as mean_sim, round(min(s), 6) + 0.0 as min_sim, round(max(s), 6) + 0.0 as max_sim, "
        "count(*) filter (s >= 0.3) as close from (select a.id, list_dot_product(a.v, b.v) as s "
        "from unit a join unit b on a.id <> b.id) group by id",
    ),
    "knn_graph": chain([UNIT, *knn_views(K, "cosine")], "select id, rank, nbr, round(dist, 6) + 0.0 as dist from knn"),
    "fuzzy_graph": chain(
        [UNIT, *knn_views(K, "cosine"), *FUZZY],
        "select a, b, round(sum(w) - case when count(*) = 2 then min(w) * max(w) else 0 end, 6) + 0.0 as weight from dir group by a, b",
        True,
    ),
    "simcse_pairs": chain(
        [UNIT, ("r", "select id, row_number() over (order by md5('42:' || id), id) - 1 as pos, count(*) over () as n from unit")],
        f"select id as a_id, id as b_id from r where n >= {N_EXAMPLES} and pos < {N_EXAMPLES} union all "
        f"select r.id, r.id from r join (select {sql_draw(43, 'i')} % n as p from "
        f"(select unnest(range(n)) as i, n from (select distinct n from r where n < {N_EXAMPLES}))) on p = pos",
    ),
    "cosine_pairs": chain([UNIT, INDEX, *PAIRS], "select * from prs"),
    "mine_triplets": chain([UNIT, INDEX, *TRIPLETS], "select * from tri"),
    "triplet_loss": chain(
        [UNIT, INDEX, *TRIPLETS],
        "select round(avg(greatest(0, " + COS.format("a", "n") + " - " + COS.format("a", "p") + " + 0.2)), 6) + 0.0 as loss, "
        "count(*) as examples from tri join unit a on a.id = a_id join unit p on p.id = p_id join unit n on n.id = n_id",
    ),
    "ranking_loss": chain(
        [UNIT, INDEX, *PAIRS],
        "select round(avg(l), 6) + 0.0 as loss, count(*) as examples from (select x.pair_id, ln(sum(exp(20 * "
        + COS.format("a", "b")
        + "))) - max(case when x.pair_id = y.pair_id then 20 * "
        + COS.format("a", "b")
        + " end) as l from pos_p x join pos_p y on x.pair_id // 32 = y.pair_id // 32 "
        "join unit a on a.id = x.a_id join unit b on b.id = y.b_id group by x.pair_id)",
    ),
    "cosine_loss": chain(
        [UNIT, INDEX, *PAIRS],
        "select round(avg((c - target) * (c - target)), 6) + 0.0 as loss, count(*) as examples from (select target, "
        + COS.format("a", "b")
        + " as c from prs join unit a on a.id = a_id join unit b on b.id = b_id)",
    ),
    "core_distance": chain([flat(), *knn_views(MIN_SAMPLES, "euclidean"), CORE], "select id, round(core, 6) + 0.0 as core from core"),
    "mutual_reachability": chain(
        [flat(), *knn_views(MIN_SAMPLES, "euclidean"), CORE],
        "select k.id, nbr, round(greatest(a.core, b.core, dist), 6) + 0.0 as reach from knn k join core a on a.id = k.id join core b on b.id = nbr",
    ),
    "density_clusters": chain([flat(), *knn_views(MIN_SAMPLES, "euclidean"), CORE, *CLUSTER], "select id, topic from clu", True),
    "assign_topics": chain(
        [flat("vec_id % 5 <> 0"), *knn_views(MIN_SAMPLES, "euclidean"), CORE, *CLUSTER]
        + [
            ("fresh", "select vec_id as id, embedding::double[] as v from embeddings where vec_id % 5 = 0"),
            (
                "near",
                "select f.id, u.id as nbr, c.topic, list_distance(f.v, u.v) as dist from fresh f "
                "join unit u on true join clu c on c.id = u.id and c.topic <> -1",
            ),
        ],
        "select f.id, n.nbr, round(n.dist, 6) + 0.0 as dist, coalesce(case when n.dist <= "
        f"{EPS} then n.topic end, -1) as topic from fresh f left join "
        "(select * from (select *, row_number() over (partition by id order by dist, nbr) as r from near) where r = 1) n on n.id = f.id",
        True,
    ),
    "topic_probability": chain(
        [
            UNIT,
            ("ed", "select label, generate_subscripts(embedding, 1) as d, unnest(embedding)::double as x from embeddings"),
            ("cent", "select label, list(m order by d) as c from (select label, d, avg(x) as m from ed group by all) group by label"),
            ("cu", "select label as topic, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) as c from cent"),
            ("sim", "select id, topic, greatest(list_dot_product(v, c), 0) as s from unit cross join cu"),
        ],
        "select id, cast(first(topic order by s desc, topic) as int) as best_topic, "
        "round(coalesce(max(s) / nullif(sum(s), 0), 0), 6) + 0.0 as topic_probability from sim group by id",
    ),
}
