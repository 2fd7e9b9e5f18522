import os
import random
from urllib.parse import urlparse

from pointloom.llm import perplexity as P
from pointloom.llm.common import checkpoint


def test_what_is_kept_between_stages_is_small(spark):
    """Grams of batches are many times the documents' number: in the shared folder each may take some bytes only."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(4000)]
    rows = [(i, " ".join(rng.choices(words, k=200)), "en") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    checkpoint(spark.range(0))
    folder = urlparse(spark.sparkContext._jsc.sc().getCheckpointDir().get()).path
    held = lambda: sum(os.path.getsize(f"{d}/{x}") for d, _, names in os.walk(folder) for x in names)
    before = held()
    assert P.quality_rules(docs, batch_bytes=1 << 17).count() == len(rows)
    taken = held() - before
    assert 0 < taken < 3 * sum(len(t) for _, t, _ in rows), taken
