"""Bounded samples of labelled training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint


def is_held_out(id_col: str = "doc_id"):
    """Whether a row is kept out of training: crc32 of its id as text is divisible by 5 (a null id counts as kept out)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, most_bytes: int = 64 << 20, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[tuple[str, int, int]], list[int]]:
    """(text, label, fold) of at most ``per_class`` training rows of each class, picked by a hash of the id, texts whole.

    Only labels 0 and 1 of rows that aren't held out count; an id labelled both ways, or without a text, doesn't count. Of
    rows that share an id one counts, that of the least text. A class takes rows in the order of the hash as long as all
    their texts have ``most_bytes`` at most; no text is cut. fold is 0 or 1 by another hash. The sample is the same for any
    partitioning. Also returned: how many training rows each class has in all.
    """
    own = labels.select(F.col(id_col).cast("long").alias("i"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~is_held_out("i"))
    own = checkpoint(own.groupBy("i").agg(F.min("y").alias("y"), F.max("y").alias("y2")).where("y = y2").select("i", "y"))
    counts = dict(own.groupBy("y").count().collect())
    picked = None
    for y in (0, 1):
        few = own.where(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(per_class)
        picked = few if picked is None else picked.unionByName(few)
    texts = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    one = texts.join(F.broadcast(picked), "i").groupBy("i", "y").agg(F.min("t").alias("t"))  # 2 * per_class rows at most
    so_far = F.sum(F.octet_length("t")).over(Window.partitionBy("y").orderBy(F.xxhash64("i"), "i"))
    found = one.withColumn("so_far", so_far).where(F.col("so_far") <= most_bytes).select("i", "t", "y", F.pmod(F.xxhash64("i", F.lit("fold")), F.lit(2)).cast("int").alias("fold")).collect()
    return [(r.t, r.y, r.fold) for r in sorted(found, key=lambda r: r.i)], [counts.get(0, 0), counts.get(1, 0)]
