"""Matrices of many genes at a time."""

import numpy as np
import pandas as pd

from strandflow.operators.identifiability import stacks


def test_matrices_of_one_shape_are_a_stack():
    rnd = np.random.default_rng(1)
    want, rows = {}, []
    for k in range(60):
        a = rnd.random((1 + k % 3, 1 + k % 2))
        want[f"g{k}"] = a
        rows += [("1", f"g{k}", f"P{i}", f"t{j}", a[i, j]) for i in rnd.permutation(len(a)) for j in range(a.shape[1])]
    found = list(stacks(pd.DataFrame(rows, columns=["chrom", "gene", "region", "isoform", "value"])))
    assert len(found) == 6 and sum(len(k) for k, _ in found) == 60
    for keys, a in found:
        for name, x in zip(keys["gene"], a, strict=True):
            assert np.array_equal(x, want[name])
