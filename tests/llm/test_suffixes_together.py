import numpy as np
import pyarrow as pa

from loomgraph.llm import substring_dedup


def test_suffixes_are_packed_without_loss():
    m, n, copies = 20, 400, 10
    text = " ".join(f"w{j}" for j in range(n))
    docs = next(substring_dedup._pack([pa.record_batch([pa.array(range(copies)), pa.array([text] * copies)], ["id", "text"])]))
    at, ends = range(0, 100, 3), range(m + 1, n + 1, 2)
    ints = pa.list_(pa.int32())
    lists = [pa.array([list(x)] * copies, ints) for x in (at, [n] * len(at), ends)]
    rows = pa.record_batch([docs.column(0), docs.column(1), *lists, pa.nulls(copies, ints)], ["id", "packed", "at", "to", "ends", "named"])
    expected = {(i, a): sum(e > a + m for e in ends) for i in range(copies) for a in at}
    seen = set()
    for most in (8 << 20, 20_000, 1):
        packed = list(substring_dedup._suffixes(m, most)([rows]))
        parts = [x for b in packed for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        parts.sort(key=lambda x: x[0])
        by_near = pa.record_batch([pa.array([x for x, _ in parts]), pa.array([x for _, x in parts])], ["near", "packed"])
        for fan in (64, 2):
            got = list(substring_dedup._in_order([by_near], fan))
            assert {(i, a): len(suffix) // 12 for _, suffix, i, a in got} == expected and len(got) == len(expected)
            for _, suffix, _, a in got:
                assert a + m + np.frombuffer(suffix, np.uint32).reshape(-1, 3)[:, 2].sum() == ends[-1]
            nodes = [x[0] for x in got]
            assert sum(x != y for x, y in zip(nodes, nodes[1:])) == len(set(nodes)) - 1  # a node's suffixes are together
            assert all(x[1] <= y[1] for x, y in zip(got, got[1:]) if x[0] == y[0])
            seen.add(frozenset(got))
        if most == 8 << 20:
            assert sum(len(x) for _, x in parts) < sum(len(x[1]) for x in got) / 10
    assert len(seen) == 1
    assert len({(a, node, suffix) for node, suffix, _, a in got}) == len(at)  # copies have equal ones
