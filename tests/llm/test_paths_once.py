import random
from collections import Counter

import numpy as np
import pyarrow as pa

from loomgraph.llm import common, substring_dedup


def test_a_path_is_sent_for_its_smallest_anchor_only():
    rng = random.Random(3)
    text = " ".join(f"w{rng.randrange(1000)}" for _ in range(400))
    w = common.Words(pa.array([text], pa.large_string()))
    at, _ = substring_dedup.anchors(w, 20, w.sums())
    docs = next(substring_dedup._pack([pa.record_batch([pa.array([7]), pa.array([text])], ["id", "text"])]))
    lists = [pa.array([x.tolist()], kind) for x, kind in ((at.astype(np.int32), pa.list_(pa.int32())), (np.ones(len(at), bool), pa.list_(pa.bool_())))]
    rows = pa.record_batch([docs.column(0), docs.column(1), *lists], ["id", "packed", "at", "many"])
    sent = Counter(r["at"] for b in substring_dedup._cut(20)([rows]) for r in b.to_pylist())
    assert sent == {i: 1 for i in range(381)}
