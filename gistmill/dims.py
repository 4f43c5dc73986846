"""Category dimension, word list and prompt names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Label id, fine category, broad category id.
FINE = [
    (0, "alt.atheism", 5),
    (1, "comp.graphics", 1),
    (2, "comp.os.ms-windows.misc", 1),
    (3, "comp.sys.ibm.pc.hardware", 1),
    (4, "comp.sys.mac.hardware", 1),
    (5, "comp.windows.x", 1),
    (6, "misc.forsale", 7),
    (7, "rec.autos", 3),
    (8, "rec.motorcycles", 3),
    (9, "rec.sport.baseball", 4),
    (10, "rec.sport.hockey", 4),
    (11, "sci.crypt", 2),
    (12, "sci.electronics", 2),
    (13, "sci.med", 2),
    (14, "sci.space", 2),
    (15, "soc.religion.christian", 5),
    (16, "talk.politics.guns", 6),
    (17, "talk.politics.mideast", 6),
    (18, "talk.politics.misc", 6),
    (19, "talk.religion.misc", 5),
]

# Broad category id, name, short name.
BROAD = [
    (1, "Computers & Technology", "Computers & Technology"),
    (2, "Science & Engineering", "Science & Engineering"),
    (3, "Recreation (Vehicles & Hobbies)", "Recreation"),
    (4, "Sports", "Sports"),
    (5, "Religion", "Religion"),
    (6, "Politics & Society", "Politics & Society"),
    (7, "Marketplace / Miscellaneous", "Marketplace"),
]

# Common English function words.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
herself it its itself they them their theirs themselves what which who whom this that these those am is are
was were be been being have has had having do does did doing a an the and but if or because as until while of
at by for with about against between into through during before after above below to from up down in out on
off over under again further then once here there when where why how all any both each few more most other
some such no nor not only own same so than too very s t can will just don should now d ll m o re ve y ain
aren couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn
""".split()

OUTLIER = -1
MAX_CATEGORIES = 4096


def fine_dim(spark: SparkSession) -> DataFrame:
    """label_id, label, broad_label_id: 20 rows."""
    return spark.createDataFrame(FINE, "label_id int, label string, broad_label_id int")


def broad_dim(spark: SparkSession) -> DataFrame:
    """broad_label_id, name, short_name: 7 rows."""
    return spark.createDataFrame(BROAD, "broad_label_id int, name string, short_name string")
