"""The four workflows: corpus to variants, vectors to 2-D and scores, topics to names and F1, document labels."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill.dims import BROAD, STOP_WORDS
from gistmill.functions.text import terms
from gistmill.functions.vectors import as_double
from gistmill.operators.clean import build_variants, prepare_corpus
from gistmill.operators.clusters import assign_topics, core_distance, density_clusters, topic_probability
from gistmill.operators.contrastive import cosine_pairs, mine_triplets, simcse_pairs
from gistmill.operators.evaluate import davies_bouldin, evaluate_topic_predictions
from gistmill.operators.features import pca, pca_or_skip
from gistmill.operators.labelling import category_profiles, keyword_labeller, keyword_replies, label_topics
from gistmill.operators.neighbours import as_points, fuzzy_graph, knn_graph, layout_transform, nearest, spectral_layout
from gistmill.operators.relational import join_doc_labels, label_id_of_name
from gistmill.operators.topics import ctfidf, reduce_topics, topic_info, topic_term_counts
from gistmill.operators.train import train_head
from gistmill.session import cut_lineage, written
from gistmill.sources.writers import write_variants


def store_variants(posts: DataFrame, path: str, stop: Sequence[str] = STOP_WORDS, lemmas: DataFrame | None = None) -> None:
    """Raw posts to the three stored variants, partitioned by variant and split."""
    write_variants(build_variants(prepare_corpus(posts), stop, lemmas), path)


def project_2d(
    df: DataFrame,
    method: str = "graph",
    id_col: str = "vec_id",
    vec: str = "embedding",
    k_neighbours: int = 15,
    tolerance: float = 1e-8,
) -> DataFrame:
    """Adds x, y. Fitted on split = 'train', applied to every split; without a split column all rows are train."""
    tagged = df if "split" in df.columns else df.withColumn("split", F.lit("train"))
    train = F.col("split") == "train"
    if method == "pca":
        flat = pca(tagged, 2, fit_on=train, col=vec, out="xy")
    elif method == "graph":
        small = pca_or_skip(tagged, 50, fit_on=train, col=vec, out="_low").persist()
        fitted = small.filter(train)
        knn = knn_graph(fitted, k_neighbours, "euclidean", id_col, "_low")
        layout = spectral_layout(fuzzy_graph(knn, k_neighbours), 2, tolerance)
        pts = as_points(fitted, id_col, "_low", "euclidean")
        fresh = as_points(small.filter(~train), id_col, "_low", "euclidean")
        placed = layout_transform(layout, nearest(fresh, pts, k_neighbours, "euclidean"), 2)
        coords = layout.unionByName(placed).select(F.col("id").alias(id_col), F.col("coords").alias("xy"))
        flat = small.join(coords, id_col).drop("_low")
    else:
        raise ValueError("method must be 'graph' or 'pca'")
    xy = flat.withColumn("x", F.get("xy", F.lit(0))).withColumn("y", F.get("xy", F.lit(1)))
    return xy.select(*df.columns, "x", "y")


def compare_approaches(
    df: DataFrame,
    n: int = 2000,
    batch_size: int = 32,
    epochs: int = 2,
    lr: float = 1e-5,
    method: str = "pca",
    id_col: str = "vec_id",
) -> DataFrame:
    """approach, examples, first_loss, last_loss, davies_bouldin for triplet, simcse and cosine training."""
    makers: dict[str, Callable[[], DataFrame]] = {
        "triplet": lambda: mine_triplets(df, n, id_col),
        "simcse": lambda: simcse_pairs(df, n, id_col),
        "cosine": lambda: cosine_pairs(df, n, id_col),
    }
    out = None
    for name, make in makers.items():
        examples = make().persist()
        head = train_head(examples, df, name, epochs, batch_size, lr, id_col=id_col)
        flat = project_2d(head.transform(df), method, id_col)
        score = davies_bouldin(flat.withColumn("embedding", F.array("x", "y")))
        row = score.select(
            F.lit(name).alias("approach"),
            F.lit(examples.count()).cast("long").alias("examples"),
            F.lit(head.losses[0]).alias("first_loss"),
            F.lit(head.losses[-1]).alias("last_loss"),
            "davies_bouldin",
        )
        out = row if out is None else out.unionByName(row)
    return out


def fit_topics(
    docs: DataFrame,
    core_quantile: float = 0.5,
    k_neighbours: int = 15,
    min_samples: int = 10,
    min_cluster_size: int = 10,
    nr_topics: int = 20,
    metric: str = "cosine",
    stop: Sequence[str] = STOP_WORDS,
    ngram_range: tuple[int, int] = (1, 2),
    eps: float | None = None,
    reduce_to: int | None = 5,
    tolerance: float = 1e-4,
) -> tuple[DataFrame, DataFrame, float]:
    """(documents with topic and ``place``, class-based term weights, eps) from doc_id, text, embedding.

    ``place`` is where a document is clustered: its coordinates in a layout of the neighbour graph with ``reduce_to`` dimensions, to a residual of
    ``tolerance``, with straight distances; the vector itself, with ``metric``, if ``reduce_to`` is None. eps is a distance between places.
    """
    knn = cut_lineage(knn_graph(docs, max(k_neighbours, min_samples), metric, "doc_id"))
    if reduce_to is None:
        placed, space = docs.withColumn("place", as_double(F.col("embedding"))), metric
    else:
        graph = fuzzy_graph(knn.filter(F.col("rank") <= k_neighbours), k_neighbours)
        layout = spectral_layout(graph, reduce_to, tolerance).select(F.col("id").alias("doc_id"), F.col("coords").alias("place"))
        placed, space = cut_lineage(docs.join(layout, "doc_id")), "euclidean"
        knn = cut_lineage(knn_graph(placed, min_samples, space, "doc_id", "place"))
    core = core_distance(knn, min_samples)
    if eps is None:
        eps = float(core.agg(F.percentile("core", F.lit(core_quantile))).first()[0])
    found = density_clusters(placed, eps, core, min_cluster_size, space, "doc_id", "place")
    tagged = placed.join(found.withColumnRenamed("id", "doc_id"), "doc_id").withColumn(
        "terms", terms(F.col("text"), stop, ngram_range)
    )
    tagged = cut_lineage(tagged)
    merged = cut_lineage(reduce_topics(tagged, ctfidf(topic_term_counts(tagged)), nr_topics))
    return merged, written(ctfidf(topic_term_counts(merged)), "weights"), eps


def place_new(new: DataFrame, fitted: DataFrame, k_neighbours: int = 15, metric: str = "cosine", reduce_to: int | None = 5) -> DataFrame:
    """``new`` with ``place``: the mean of its nearest fitted documents' places, nearer ones counting more, or the vector itself."""
    if reduce_to is None:
        return new.withColumn("place", as_double(F.col("embedding")))
    hits = nearest(as_points(new, "doc_id", "embedding", metric), as_points(fitted, "doc_id", "embedding", metric), k_neighbours, metric)
    known = fitted.select(F.col("doc_id").alias("id"), F.col("place").alias("coords"))
    return new.join(layout_transform(known, hits, reduce_to).select(F.col("id").alias("doc_id"), F.col("coords").alias("place")), "doc_id")


def topics_to_scores(
    docs: DataFrame, split: Column | None = None, fn=None, prompt: str = "default", stop: Sequence[str] = STOP_WORDS, **fit
) -> DataFrame:
    """split, attrition and F1 of topic names against the broad label, on train and test.

    ``docs`` holds doc_id, text, embedding, label (broad id) and split. Topic names come from ``fn`` over the
    prompts, or from the keyword labeller learnt on the train split.
    """
    train, test = docs.filter(F.col("split") == "train"), docs.filter(F.col("split") == "test")
    fitted, weights, eps = fit_topics(train, stop=stop, **fit)
    info = topic_info(fitted, weights)
    if fn is None:
        named = docs.sparkSession.createDataFrame(
            [(i, n) for i, n, _ in BROAD], "label int, category string"
        )
        learnt = fitted.join(F.broadcast(named), "label")
        labels = label_topics(info, [prompt], replies=keyword_replies(keyword_labeller(weights, category_profiles(learnt))))
    else:
        labels = label_topics(info, [prompt], fn=fn)
    metric, reduce_to = fit.get("metric", "cosine"), fit.get("reduce_to", 5)
    fresh = place_new(test, fitted, fit.get("k_neighbours", 15), metric, reduce_to)
    space = metric if reduce_to is None else "euclidean"
    placed = assign_topics(fresh, fitted, eps, space, "doc_id", "place").select(F.col("id").alias("doc_id"), "topic")
    cols = ["doc_id", "embedding", "label", "split", "topic"]
    everyone = fitted.select(*cols).unionByName(test.join(placed, "doc_id").select(*cols))
    prob = topic_probability(everyone, fitted, "doc_id").select(F.col("id").alias("doc_id"), "topic_probability")
    scored = label_id_of_name(join_doc_labels(everyone.join(prob, "doc_id", "left"), labels))
    return evaluate_topic_predictions(scored, "split")
