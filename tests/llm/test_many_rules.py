import numpy as np

from loomgraph.llm import quality_rules


def test_as_many_rules_as_kinds_of_low_quality():
    x = np.vstack([np.repeat(np.eye(20), 60, 0), np.zeros((1200, 20))])
    bad = np.arange(2400) < 1200
    order = np.random.default_rng(3).permutation(2400)
    rules = quality_rules.learn(x[order], bad[order], [f"s{j}" for j in range(20)])
    assert {n for r in rules for n, over, _ in r.conditions if over} == {f"s{j}" for j in range(20)}
