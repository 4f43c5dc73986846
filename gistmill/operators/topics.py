"""Topic words, topic similarity and merging, topic tables, coherence."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistmill.dims import OUTLIER
from gistmill.functions import text as tx
from gistmill.functions import vectors as vx
from gistmill.functions.draws import global_rank
from gistmill.functions.joins import SENT_BYTES, bounded_join, checked_join, group_join, spread_join
from gistmill.operators.evaluate import centroids
from gistmill.operators.features import pca
from gistmill.operators.neighbours import DIGITS
from gistmill.session import cut_lineage, written


def topic_term_counts(
    df: DataFrame, min_df: int | float = 1, max_df: int | float = 1.0, topic: str = "topic"
) -> DataFrame:
    """topic, term, tf over all documents of a topic (needs ``terms``).

    As in class-based weighting a topic counts as one document for min_df and max_df.
    """
    # Stated here rather than left to join inference, so that every reader of the counts has the same plan to reuse.
    each = df.filter(F.col(topic).isNotNull()).select(topic, F.explode("terms").alias("term"))
    counts = each.groupBy(topic, "term").agg(F.count(F.lit(1)).alias("tf"))
    if min_df == 1 and max_df == 1.0:
        return counts
    n = F.col("_n")
    banded = with_topic_share(counts, topic).filter(
        (F.col("_df") >= (F.lit(min_df) if isinstance(min_df, int) else min_df * n))
        & (F.col("_df") <= (F.lit(max_df) if isinstance(max_df, int) else max_df * n))
    )
    return banded.drop("_df", "_n")


def with_topic_share(counts: DataFrame, topic: str = "topic") -> DataFrame:
    """Adds _df, the topics that hold the term, and _n, all topics."""
    total = counts.select(topic).distinct().agg(F.count(F.lit(1)).alias("_n")).withColumn("_k", F.lit(1))
    spread = F.count(F.lit(1)).over(Window.partitionBy("term"))
    # One row.
    return counts.withColumn("_df", spread).withColumn("_k", F.lit(1)).join(F.broadcast(total), "_k").drop("_k")


def ctfidf(counts: DataFrame, topic: str = "topic", by: Sequence[str] = ()) -> DataFrame:
    """topic, term, tf, weight = (tf / words of the topic) * ln(1 + A / f).

    The counts are written, so that documents are tokenised and counted once; the topics' sizes are then read from two columns.
    """
    by, counts = list(by), written(counts, "counts")
    size = counts.groupBy(*by, topic).agg(F.sum("tf").alias("_words"))
    size = size.withColumn("_a", F.floor(F.avg("_words").over(Window.partitionBy(*by))))
    total = F.sum("tf").over(Window.partitionBy(*by, "term"))
    joined = group_join(counts.withColumn("_f", total), size, [*by, topic], "term")
    weight = F.col("tf") / F.col("_words") * F.log(1 + F.col("_a") / F.col("_f"))
    return joined.select(*by, topic, "term", "tf", weight.alias("weight"))


def topic_words(weights: DataFrame, n: int = 10, outliers: bool = True, topic: str = "topic", by: Sequence[str] = ()) -> DataFrame:
    """topic, rank, term, weight: best n terms; ties by term."""
    w = weights if outliers else weights.filter(F.col(topic) != OUTLIER)
    order = Window.partitionBy(*by, topic).orderBy(F.desc("weight"), "term")
    ranked = w.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    return ranked.select(*by, topic, "rank", "term", "weight")


def topic_barchart_data(weights: DataFrame, n: int = 5) -> DataFrame:
    return topic_words(weights, n, outliers=False)


def unit_weights(weights: DataFrame, topic: str = "topic") -> DataFrame:
    """topic, term, u: weights scaled to unit length per topic. The weights are read twice: write costly ones before."""
    # Added up before the shuffle, so that a topic with most of the terms is no hot group.
    length = weights.groupBy(topic).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_l"))
    return group_join(weights, length, [topic], "term").select(topic, "term", F.coalesce(F.try_divide("weight", "_l"), F.lit(0.0)).alias("u"))


def similar_topics(weights: DataFrame) -> DataFrame:
    """a, b, similarity (a < b) of topics that share a term, outliers apart; others are 0.

    Topics, not documents, meet on a term: at most topics^2 rows per term, added up before they are moved.
    """
    u = unit_weights(weights.filter(F.col("topic") != OUTLIER))
    left = u.select(F.col("topic").alias("a"), "term", F.col("u").alias("ua"))
    right = u.select(F.col("topic").alias("b"), "term", F.col("u").alias("ub"))
    return left.join(right, "term").filter("a < b").groupBy("a", "b").agg(F.sum(F.col("ua") * F.col("ub")).alias("similarity"))


def topic_similarity(weights: DataFrame) -> DataFrame:
    """a, b, similarity (a < b) between all topics' term weights, outliers apart; topic pairs without a common term are 0."""
    weights = written(weights.select("topic", "term", "weight"), "weights")
    topics = weights.filter(F.col("topic") != OUTLIER).select("topic").distinct().withColumn("_i", F.row_number().over(Window.orderBy("topic")))
    later = topics.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy())).filter("_i < _n")
    grid = later.select(F.col("topic").alias("a"), F.explode(F.sequence(F.col("_i") + 1, F.col("_n").cast("int"))).alias("_i"))
    grid = grid.join(topics.select(F.col("topic").alias("b"), "_i"), "_i").select("a", "b")
    met = similar_topics(weights)
    return grid.join(met, ["a", "b"], "left").select("a", "b", F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


class AverageLinks:
    """Average-link merging by chains of nearest neighbours, on sums of similarities between groups; pairs without a row are 0.

    A group's row holds the group or topic at the other end, under the name it had, and the sum of the similarities: names are brought up to date
    when the row is read, so a merge only puts two rows together. Averages are sums over products of sizes, never averages of averages.
    """

    def __init__(self, topics: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: np.ndarray):
        """topics: sorted; a, b: their positions in pairs."""
        self.n = len(topics)
        self.parent = np.arange(2 * self.n)
        self.size = np.ones(2 * self.n, dtype=np.int64)
        self.least = np.concatenate([np.arange(self.n), np.zeros(self.n, dtype=np.int64)])
        ends, others = np.concatenate([a, b]), np.concatenate([b, a])
        order = np.argsort(ends, kind="stable")
        cuts = np.searchsorted(ends[order], np.arange(1, self.n))
        self.rows = dict(enumerate(zip(np.split(others[order], cuts), np.split(np.concatenate([similarity, similarity])[order], cuts), strict=True)))

    def roots(self, names: np.ndarray) -> np.ndarray:
        found = self.parent[names]
        while (found != (up := self.parent[found])).any():
            found = up
        self.parent[names] = found
        return found

    def nearest(self, group: int, before: int | None) -> tuple[int | None, float]:
        """The most similar other group, on ties the one before in the chain, then the one with the least topic; None if no pair has a row."""
        names, sums = self.rows[group]
        names, at = np.unique(self.roots(names), return_inverse=True)
        sums = np.bincount(at, sums, len(names))
        other = names != group
        names, sums = names[other], sums[other]
        self.rows[group] = names, sums
        mean = sums / (self.size[group] * self.size[names])
        if not len(names) or mean.max() <= 0:
            return None, 0.0
        ties = names[mean == mean.max()]
        return (before if before in ties else int(ties[self.least[ties].argmin()])), float(mean.max())

    def merges(self) -> list[tuple[float, int, int]]:
        """(similarity, least topic of the one, of the other) of all merges of groups that share a term, as the chains find them."""
        done, chain, made = [], [], self.n
        waiting = list(range(self.n - 1, -1, -1))
        while chain or waiting:
            if not chain:
                tip = waiting.pop()
                if self.parent[tip] != tip:
                    continue
                chain = [tip]
            tip, before = chain[-1], chain[-2] if len(chain) > 1 else None
            other, similarity = self.nearest(tip, before)
            if other is None:  # nothing is similar to this group; whatever led here has been merged
                chain.pop()
            elif other != before:
                chain.append(other)
            else:
                del chain[-2:]
                x, y = sorted((int(self.least[tip]), int(self.least[before])))
                done.append((similarity, x, y))
                (n1, s1), (n2, s2) = self.rows.pop(tip), self.rows.pop(before)
                self.rows[made] = np.concatenate([n1, n2]), np.concatenate([s1, s2])
                self.parent[[tip, before]] = made
                self.size[made], self.least[made] = self.size[tip] + self.size[before], x
                if not chain:
                    chain = [made]
                made += 1
        return done


def merge_topics(similarity: DataFrame, n: int, topics: DataFrame | None = None) -> dict[int, int]:
    """Average-link merging down to ``n`` groups: topic -> group, groups numbered by their smallest topic.

    similarity: a, b, similarity of pairs, others are 0; topics (topic): those that may be in no pair. Spark makes the pairs; the driver holds 24 bytes
    for each pair of topics that share a term and builds the whole tree from them, which is cut by undoing its least similar merges. Groups that share no
    term are merged last, in the order of their least topics.
    """
    pairs = similarity.select("a", "b", "similarity").where("similarity > 0").toArrow()
    a, b, s = (pairs.column(c).to_numpy() for c in ("a", "b", "similarity"))
    named = similarity.select(F.explode(F.array("a", "b")).alias("topic")) if topics is None else topics.select("topic")
    every = np.sort(named.distinct().toArrow().column("topic").to_numpy())
    merges = AverageLinks(every, np.searchsorted(every, a), np.searchsorted(every, b), s).merges()
    merges.sort(key=lambda e: (-e[0], e[1], e[2]))
    parent = list(range(len(every)))

    def find(t: int) -> int:
        while parent[t] != t:
            parent[t] = parent[parent[t]]
            t = parent[t]
        return t

    wanted = max(0, len(every) - max(1, n))
    for _, x, y in merges[:wanted]:
        x, y = sorted((find(x), find(y)))
        parent[y] = x
    if wanted > len(merges):
        rest = sorted({find(t) for t in range(len(every))})
        for y in rest[1 : wanted - len(merges) + 1]:
            parent[y] = rest[0]
    return {int(t): int(every[find(i)]) for i, t in enumerate(every)}


def reduce_topics(docs: DataFrame, weights: DataFrame, nr_topics: int = 20) -> DataFrame:
    """Documents with merged topics, numbered again by size (ties by old number); -1 stays and counts as one topic."""
    weights = written(weights.select("topic", "term", "weight"), "weights")
    has_outliers = bool(docs.filter(F.col("topic") == OUTLIER).limit(1).collect())
    topics = weights.filter(F.col("topic") != OUTLIER).select("topic").distinct()
    merged = merge_topics(similar_topics(weights), max(1, nr_topics - has_outliers), topics)
    spark = docs.sparkSession
    mapping = spark.createDataFrame(list(merged.items()) or [(0, 0)], "topic int, _g int")
    moved = docs.join(F.broadcast(mapping), "topic", "left").withColumn("_g", F.coalesce("_g", "topic"))
    sizes = moved.filter(F.col("_g") != OUTLIER).groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    number = global_rank(sizes, F.desc("_n"), F.col("_g"), out="_t").select("_g", "_t")
    out = moved.join(number, "_g", "left")
    rest = [c for c in docs.columns if c != "topic"]
    return out.select(*rest, F.coalesce("_t", F.lit(OUTLIER)).cast("int").alias("topic"))


def representative_docs(docs: DataFrame, n: int = 3, id_col: str = "doc_id", vec: str = "embedding", keep: Sequence[str] = ()) -> DataFrame:
    """topic, rank, doc_id, similarity and the columns ``keep``: documents nearest to their topic's mean vector."""
    cent = centroids(docs, "topic", vec).select("topic", "centroid")
    # A few centroids are sent, so that no text is moved.
    scored = checked_join(docs, cent, ["topic"], id_col).select(
        "topic", id_col, *keep, vx.cosine(vx.as_double(F.col(vec)), F.col("centroid")).alias("similarity")
    )
    order = Window.partitionBy("topic").orderBy(F.desc("similarity"), id_col)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def topic_info(docs: DataFrame, weights: DataFrame, n_words: int = 10, n_docs: int = 3, id_col: str = "doc_id") -> DataFrame:
    """topic, count, name, representation, representative_docs."""
    counts = docs.groupBy("topic").agg(F.count(F.lit(1)).alias("count"))
    best = topic_words(weights, n_words).groupBy("topic").agg(F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("_w"))
    best = best.select("topic", F.col("_w.term").alias("representation"))
    # Texts go through the ranking, which Spark trims to n rows a topic before it moves them.
    reps = representative_docs(docs, n_docs, id_col, keep=["text"])
    reps = reps.groupBy("topic").agg(F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("_d"))
    reps = reps.select("topic", F.col("_d.text").alias("representative_docs"))
    out = counts.join(best, "topic", "left").join(reps, "topic", "left")
    name = F.concat_ws("_", F.col("topic").cast("string"), F.array_join(F.slice("representation", 1, 4), "_"))
    return out.select("topic", "count", name.alias("name"), "representation", "representative_docs")


def topic_map_data(docs: DataFrame, vec: str = "embedding") -> DataFrame:
    """topic, size, x, y: topic centres on two principal axes, outliers apart."""
    # The fit reads the centroids several times, and documents may be costly.
    cent = cut_lineage(centroids(docs.filter(F.col("topic") != OUTLIER), "topic", vec))
    flat = pca(cent, 2, col="centroid", out="xy")
    return flat.select("topic", "size", F.get("xy", F.lit(0)).alias("x"), F.get("xy", F.lit(1)).alias("y"))


SPANS = "array<struct<lo: bigint, hi: bigint>>"


def _spans_in_row(split: DataFrame, terms: DataFrame, window: int) -> DataFrame:
    """doc_id, term, spans; words are looked up where their document is, all documents of a batch together."""
    held = split.sparkSession.sparkContext.broadcast(terms.toArrow())
    kind = split.schema["doc_id"].dataType.simpleString()

    def look_up(batches):
        names = held.value.column("term").combine_chunks()
        for batch in batches:
            lists = batch.column("w")
            n = pc.list_value_length(lists).to_numpy().astype(np.int64)
            begin, last = np.cumsum(n) - n, np.maximum(n - window + 1, 1)
            ids = pc.index_in(lists.flatten(), value_set=names)
            at = np.flatnonzero(ids.is_valid().to_numpy(zero_copy_only=False))
            term = ids.drop_null().to_numpy().astype(np.int64)
            row = np.searchsorted(begin, at, side="right") - 1
            at = at - begin[row]
            order = np.lexsort((at, term, row))
            row, term, at = row[order], term[order], at[order]
            new = np.ones(len(at), dtype=bool)
            new[1:] = (row[1:] != row[:-1]) | (term[1:] != term[:-1])
            cut = new.copy()
            cut[1:] |= at[1:] - at[:-1] > window
            starts = np.flatnonzero(cut)
            ends = np.append(starts[1:], len(at))[: len(starts)] - 1
            lo, hi = np.maximum(at[starts] - window + 1, 0), np.minimum(at[ends], last[row[ends]] - 1)
            heads = np.flatnonzero(new)
            # The last row has the windows of the batch and no term.
            bounds = np.concatenate([np.searchsorted(starts, heads), [len(starts), len(starts) + 1]]).astype(np.int32)
            lo, hi = np.append(lo, 0), np.append(hi, last.sum())
            spans = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays([pa.array(lo), pa.array(hi)], ["lo", "hi"]))
            doc = pa.concat_arrays([batch.column("doc_id").take(pa.array(row[heads])), pa.nulls(1, batch.column("doc_id").type)])
            named = pa.concat_arrays([names.take(pa.array(term[heads])), pa.nulls(1, names.type)])
            yield pa.RecordBatch.from_arrays([doc, named, spans], ["doc_id", "term", "spans"])

    return split.mapInArrow(look_up, f"doc_id {kind}, term string, spans {SPANS}")


def _spans_by_join(split: DataFrame, terms: DataFrame, window: int) -> DataFrame:
    """As _spans_in_row, for more terms than can be sent to the tasks."""
    last = F.greatest(F.size("w") - window + 1, F.lit(1))
    places = split.select("doc_id", last.alias("last"), F.posexplode("w").alias("at", "term"))
    found = spread_join(places, terms, ["term"], "doc_id").groupBy("doc_id", "term").agg(F.max("last").alias("last"), F.sort_array(F.collect_list("at")).alias("p"))
    p, far = F.col("p"), F.lit(window)
    starts = F.filter(p, lambda x, i: (i == 0) | (x - F.get(p, i - 1) > far))
    ends = F.filter(p, lambda x, i: (i == F.size(p) - 1) | (F.get(p, i + 1) - x > far))
    spans = F.zip_with(starts, ends, lambda x, y: F.struct(F.greatest(x - far + 1, F.lit(0)).alias("lo"), F.least(y, F.col("last") - 1).alias("hi")))
    every = split.agg(F.sum(last).alias("n")).select(F.lit(None).alias("doc_id"), F.lit(None).cast("string").alias("term"), F.array(F.struct(F.lit(0).alias("lo"), F.col("n").alias("hi"))).cast(SPANS).alias("spans"))
    return found.select("doc_id", "term", spans.cast(SPANS).alias("spans")).union(every)


def window_counts(docs: DataFrame, words: DataFrame, window: int = 110) -> tuple[DataFrame, DataFrame, int]:
    """Boolean sliding windows that hold a word (term, n), both of two words of one topic (topic, a, b, n, a < b), and windows in all.

    words: (topic, term). A word at position p is seen by the windows that start in (p - window, p]: the positions of a word in a document become a
    few intervals of starts, whose lengths count windows and whose overlaps with another word's intervals count pairs. Nothing is done window by window.
    """
    terms = words.select("term").distinct()
    size = terms.agg(F.sum(F.octet_length("term") + 16).alias("n")).first()["n"] or 0
    split = docs.select("doc_id", tx.words(F.col("text")).alias("w")).where(F.size("w") > 0)
    found = cut_lineage(_spans_in_row(split, terms, window) if size <= SENT_BYTES else _spans_by_join(split, terms, window))
    # A row without a term holds the windows of a batch or of all documents.
    total = found.where("term is null").select(F.explode("spans").alias("x")).agg(F.sum("x.hi").alias("n")).first()["n"] or 0
    found = found.where("term is not null")
    single = found.groupBy("term").agg(F.sum(F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["hi"] - x["lo"] + 1)).alias("n"))
    # A document's words of one topic: as many as a topic has, at most.
    own = bounded_join(found, words.select("term", "topic").distinct(), ["term"], "doc_id")
    own = own.groupBy("doc_id", "topic").agg(F.sort_array(F.collect_list(F.struct("term", "spans"))).alias("e")).where(F.size("e") > 1)

    def overlap(x: Column, y: Column) -> Column:
        zero = F.lit(0).cast("long")
        return F.aggregate(x, zero, lambda s, i: s + F.aggregate(y, zero, lambda r, j: r + F.greatest(F.least(i["hi"], j["hi"]) - F.greatest(i["lo"], j["lo"]) + 1, zero)))

    one = own.select("topic", "e", F.posexplode("e").alias("i", "x"))
    both = one.select("topic", F.col("x"), F.explode(F.slice("e", F.col("i") + 2, F.size("e"))).alias("y"))
    both = both.select("topic", F.col("x.term").alias("a"), F.col("y.term").alias("b"), overlap(F.col("x.spans"), F.col("y.spans")).alias("n"))
    return single, both.groupBy("topic", "a", "b").agg(F.sum("n").alias("n")), total


def coherence_cv(docs: DataFrame, topic_word_table: DataFrame, window: int = 110, by: Sequence[str] = ()) -> DataFrame:
    """topic, coherence per topic of the table (topic, rank, term); words that no document holds are left out."""
    eps = 1e-12
    group = [*by, "topic"]
    words = cut_lineage(topic_word_table.filter(F.col("topic") != OUTLIER).select(*group, "term"))
    single, pairs, total = window_counts(docs, words, window)
    known = words.join(single, "term")
    left = known.select(*group, F.col("term").alias("i"), F.col("n").alias("ni"))
    right = known.select(*group, F.col("term").alias("j"), F.col("n").alias("nj"))
    # A topic's own top words meet each other: n x n rows per topic.
    cell = left.join(right, group).withColumn("a", F.least("i", "j")).withColumn("b", F.greatest("i", "j"))
    cell = cell.join(pairs, ["topic", "a", "b"], "left").withColumn("n", F.when(F.col("i") == F.col("j"), F.col("ni")).otherwise(F.coalesce("n", F.lit(0))))
    p, all_windows = F.col("n") / float(max(total, 1)), F.lit(float(max(total, 1)))
    pmi = F.log((p + eps) / (F.col("ni") / all_windows * (F.col("nj") / all_windows)))
    cell = cell.select(*group, "i", "j", (pmi / -F.log(p + eps)).alias("v"))
    cell = cell.withColumn("s", F.sum("v").over(Window.partitionBy(*group, "j")))
    per = cell.groupBy(*group, "i").agg(
        F.sum(F.col("v") * F.col("s")).alias("d"),
        F.sum(F.col("v") * F.col("v")).alias("vv"),
        F.sum(F.col("s") * F.col("s")).alias("ss"),
    )
    cos = F.coalesce(F.try_divide("d", F.sqrt(F.col("vv")) * F.sqrt(F.col("ss"))), F.lit(0.0))
    return per.groupBy(*group).agg(F.avg(cos).alias("coherence"))


def _front(weights: DataFrame, n: int) -> DataFrame:
    """Rows of ``weights`` (combo, topic, term, weight) that may be among their group's ``n`` heaviest: those no lighter than the n-th of their batch. Ties stay."""

    def run(batches):
        for batch in batches:
            w, keys = batch.column("weight").to_numpy(), [batch.column(c).to_numpy(zero_copy_only=False) for c in ("combo", "topic")]
            order = np.lexsort((-w, *keys))
            w, keys = w[order], [key[order] for key in keys]
            new = np.ones(len(w), dtype=bool)
            new[1:] = (keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1])
            first = np.flatnonzero(new)
            if len(first):
                sizes = np.diff(np.append(first, len(w)))
                least = np.repeat(w[first + np.minimum(sizes, n) - 1], sizes)
                yield batch.take(pa.array(order[~(w < least)]))

    return weights.mapInArrow(run, weights.schema)


def sweep_vectorizer(
    docs: DataFrame,
    stop: Sequence[str] = (),
    ngram_ranges: Sequence[tuple[int, int]] = ((1, 1), (1, 2)),
    min_dfs: Sequence[int] = (1, 5),
    max_dfs: Sequence[float] = (1.0, 0.95),
    n_words: int = 10,
) -> DataFrame:
    """combo, max_n, min_df, max_df, coherence, best: mean coherence of the topics for each setting.

    The settings are a column: documents are counted once with the longest n-grams, each setting filters
    the topic-term table, and windows are counted once for the words of all settings together.
    """
    longest = max(hi for _, hi in ngram_ranges)
    lowest = min(lo for lo, _ in ngram_ranges)
    grams = docs.withColumn("terms", tx.terms(F.col("text"), stop, (lowest, longest)))
    counts = with_topic_share(topic_term_counts(grams)).withColumn("_len", F.size(F.split("term", " ")))
    # A setting keeps a term in all topics or in none, so the term's total is the same in each.
    counts = written(counts.withColumn("_f", F.sum("tf").over(Window.partitionBy("term"))), "counts")
    grid = [(lo, hi, a, b) for lo, hi in ngram_ranges for a in min_dfs for b in max_dfs]
    fits = [F.col("_len").between(lo, hi) & (F.col("_df") >= a) & (F.col("_df") <= b * F.col("_n")) for lo, hi, a, b in grid]
    size = counts.groupBy("topic").agg(*[F.sum(F.when(fit, F.col("tf"))).alias(f"s{i}") for i, fit in enumerate(fits)])
    size = size.select("topic", F.posexplode(F.array(*[f"s{i}" for i in range(len(grid))])).alias("combo", "_words")).where("_words is not null")
    size = size.withColumn("_a", F.floor(F.avg("_words").over(Window.partitionBy("combo"))))
    chosen = counts.select("topic", "term", "tf", "_f", F.explode(F.array_compact(F.array(*[F.when(fit, F.lit(i)) for i, fit in enumerate(fits)]))).alias("combo"))
    weight = F.col("tf") / F.col("_words") * F.log(1 + F.col("_a") / F.col("_f"))
    weighed = group_join(chosen, size, ["topic", "combo"], "term").select("combo", "topic", "term", weight.alias("weight")).filter(F.col("topic") != OUTLIER)
    best = cut_lineage(topic_words(_front(weighed, n_words), n_words, by=["combo"]))
    score = coherence_cv(docs, best, by=["combo"]).groupBy("combo").agg(F.avg("coherence").alias("coherence"))
    setting = docs.sparkSession.createDataFrame(
        [(i, hi, a, b) for i, (_, hi, a, b) in enumerate(grid)], "combo int, max_n int, min_df int, max_df double"
    )
    out = setting.join(score, "combo", "left")
    first = Window.orderBy(F.desc_nulls_last(F.round("coherence", DIGITS)), "combo")
    return out.withColumn("best", F.row_number().over(first) == 1)
