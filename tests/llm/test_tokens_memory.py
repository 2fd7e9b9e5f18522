import gc
import weakref

import pyarrow as pa

from pointloom.llm.tokens import WordEncoder, default_path


def test_a_worker_keeps_one_vocabulary_and_no_memos():
    """A worker runs many tasks, each with an encoder of its own: nothing may wait for the garbage collection."""
    path = default_path("word_bpe_49k.json")
    gc.disable()
    try:
        first = WordEncoder(path)
        ids, _ = first.encode(pa.array(["Plain words, 1984! naïve", "漢字 and more"]))
        assert len(ids) and first.words and first.pieces
        gone = [weakref.ref(x) for x in (first, first.words, first.pieces)]
        full = first.full
        del first
        assert [x() for x in gone] == [None] * 3
        assert WordEncoder(path).full is full
    finally:
        gc.enable()
