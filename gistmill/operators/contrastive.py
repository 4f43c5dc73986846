"""Example pairs and triplets, and the losses over them. All draws are md5 numbers, so examples repeat exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistmill.functions import vectors as vx
from gistmill.functions.draws import draw, hash_rank
from gistmill.operators.neighbours import as_points, hardest_negative
from gistmill.operators.relational import hash_sample, label_index

RANKING_SCALE = 20.0


def simcse_pairs(df: DataFrame, n: int, id_col: str = "doc_id", seed: int = 42) -> DataFrame:
    """a_id, b_id: n rows, each paired with itself; a corpus smaller than n is drawn from with replacement."""
    have = df.select(id_col).limit(n).count()
    if have == n:
        picked = hash_sample(df.select(id_col), n, id_col, seed)
    else:
        ranks = hash_rank(df.select(id_col), None, id_col, seed)
        draws = df.sparkSession.range(have).select((draw(seed + 1, "id") % have).alias("pos"))
        picked = draws.join(ranks, "pos")
    return picked.select(F.col(id_col).alias("a_id"), F.col(id_col).alias("b_id"))


def _numbered_labels(index: DataFrame, least: int) -> DataFrame:
    """label, members, li, labels: labels holding enough rows, numbered from 0."""
    sizes = index.filter(F.col("pos") == 0).select("label", "members").filter(F.col("members") >= least)
    every = Window.orderBy("label")
    return sizes.withColumn("li", F.row_number().over(every) - 1).withColumn(
        "labels", F.count(F.lit(1)).over(Window.partitionBy())
    )


def _pick(draws: DataFrame, labels: DataFrame, turn: Column, prefix: str) -> DataFrame:
    """Attach label and members for the label number ``turn`` (a large draw, taken modulo the label count)."""
    few = labels.select(
        F.col("label").alias(f"{prefix}_label"), F.col("members").alias(f"{prefix}_members"), F.col("li").alias("_li")
    )
    return draws.withColumn("_li", turn).join(few, "_li").drop("_li")


def cosine_pairs(df: DataFrame, n: int, id_col: str = "doc_id", label_col: str = "label", seed: int = 42) -> DataFrame:
    """pair_id, a_id, b_id, target: n // 2 pairs of one label (1.0) and n // 2 pairs of two labels (0.0).

    Labels are drawn uniformly, then members by number, so a large label costs no more than a small one.
    """
    half = n // 2
    index = label_index(df.select(F.col(label_col).alias("label"), id_col), "label", id_col, seed).persist()
    spark = df.sparkSession
    ids = index.select("label", "pos", F.col(id_col).alias("m_id"))

    def member(rows: DataFrame, label: str, pos: Column, out: str) -> DataFrame:
        keyed = ids.select(F.col("label").alias(label), F.col("pos").alias("_p"), F.col("m_id").alias(out))
        return rows.withColumn("_p", pos).join(keyed, [label, "_p"]).drop("_p")

    two = _numbered_labels(index, 2)
    n_two, n_all = two.count(), index.filter(F.col("pos") == 0).count()
    pos = neg = None
    if n_two:
        pos = _pick(spark.range(half), two, draw(seed + 1, "id") % n_two, "p")
        first = draw(seed + 2, "id") % F.col("p_members")
        step = draw(seed + 3, "id") % (F.col("p_members") - 1) + 1
        pos = member(pos, "p_label", first, "a_id")
        pos = member(pos, "p_label", (first + step) % F.col("p_members"), "b_id")
        pos = pos.select(F.col("id").alias("pair_id"), "a_id", "b_id", F.lit(1.0).alias("target"))
    if n_all > 1:
        one = _numbered_labels(index, 1)
        turn = draw(seed + 4, "id") % n_all
        neg = _pick(spark.range(half), one, turn, "p")
        neg = _pick(neg, one, (turn + draw(seed + 5, "id") % (n_all - 1) + 1) % n_all, "q")
        neg = member(neg, "p_label", draw(seed + 6, "id") % F.col("p_members"), "a_id")
        neg = member(neg, "q_label", draw(seed + 7, "id") % F.col("q_members"), "b_id")
        neg = neg.select((F.col("id") + half).alias("pair_id"), "a_id", "b_id", F.lit(0.0).alias("target"))
    parts = [p for p in (pos, neg) if p is not None]
    if not parts:
        raise ValueError("no label holds two rows and there is only one label")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def mine_triplets(
    df: DataFrame,
    n: int,
    id_col: str = "vec_id",
    label_col: str = "label",
    vec: str = "embedding",
    seed: int = 42,
    **sizes,
) -> DataFrame:
    """a_id, p_id, n_id for the first n rows (by id) whose label holds two or more.

    The positive is another row of the label by draw, the negative the most similar row of any other label.
    """
    base = as_points(df, id_col, vec, "cosine", F.col(label_col).alias("label"))
    index = label_index(base.select("label", "id"), "label", "id", seed).persist()
    anchors = index.filter(F.col("members") >= 2).orderBy("id").limit(n)
    at = (F.col("pos") + draw(seed + 1, "id") % (F.col("members") - 1) + 1) % F.col("members")
    wanted = anchors.select("id", "label", at.alias("pos"))
    positives = wanted.join(index.select("label", "pos", F.col("id").alias("p_id")), ["label", "pos"]).select("id", "p_id")
    negatives = hardest_negative(base.join(anchors.select("id"), "id", "left_semi"), base, **sizes)
    return positives.join(negatives, "id").select(F.col("id").alias("a_id"), "p_id", F.col("nbr").alias("n_id"))


def with_vectors(
    examples: DataFrame, vectors: DataFrame, *cols: str, id_col: str = "vec_id", vec: str = "embedding"
) -> DataFrame:
    """Adds a_v, b_v, ... for the id columns named. Examples are few, vectors many: Spark may send the examples."""
    out = examples
    for c in cols:
        side = vectors.select(F.col(id_col).alias(f"{c}_id"), vx.as_double(F.col(vec)).alias(f"{c}_v"))
        out = out.join(side, f"{c}_id")
    return out


def triplet_loss(triplets: DataFrame, vectors: DataFrame, margin: float = 0.2, **kw) -> DataFrame:
    t = with_vectors(triplets, vectors, "a", "p", "n", **kw)
    gap = (1 - vx.cosine(F.col("a_v"), F.col("p_v"))) - (1 - vx.cosine(F.col("a_v"), F.col("n_v"))) + margin
    return t.agg(F.avg(F.greatest(gap, F.lit(0.0))).alias("loss"), F.count(F.lit(1)).alias("examples"))


def cosine_loss(pairs: DataFrame, vectors: DataFrame, **kw) -> DataFrame:
    t = with_vectors(pairs, vectors, "a", "b", **kw)
    miss = vx.cosine(F.col("a_v"), F.col("b_v")) - F.col("target")
    return t.agg(F.avg(miss * miss).alias("loss"), F.count(F.lit(1)).alias("examples"))


def ranking_loss(pairs: DataFrame, vectors: DataFrame, batch: int = 32, **kw) -> DataFrame:
    """Cross-entropy of each pair's own partner against all partners of its batch. Pairs are numbered by ``pair_id``."""
    t = with_vectors(pairs, vectors, "a", "b", **kw).withColumn("_b", F.floor(F.col("pair_id") / batch))
    left = t.select("_b", "pair_id", vx.l2_normalize(F.col("a_v")).alias("a"))
    right = t.select("_b", F.col("pair_id").alias("other"), vx.l2_normalize(F.col("b_v")).alias("b"))
    # At most batch x batch scores per batch, by construction of the batch number.
    s = left.join(right, "_b").withColumn("s", RANKING_SCALE * vx.dot(F.col("a"), F.col("b")))
    per = s.groupBy("pair_id").agg(
        F.log(F.sum(F.exp("s"))).alias("lse"), F.max(F.when(F.col("other") == F.col("pair_id"), F.col("s"))).alias("own")
    )
    return per.agg(F.avg(F.col("lse") - F.col("own")).alias("loss"), F.count(F.lit(1)).alias("examples"))
