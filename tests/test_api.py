from __future__ import annotations

import logging

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from tomolith import api as E
from tomolith.plans import catalog
from tomolith.plans.timing import Timer


def test_a_users_own_proximal_operator(spark):
    class Halve:
        def apply(self, v, t):
            return v * 0.5

    b = E.DataContainer.from_array(spark, np.array([4.0, -2.0]))
    assert E.proxapply(Halve(), b, 1.0).allclose(b * 0.5)
    combined = E.CombinedProximal(Halve(), E.ProximalIdentity())
    x = E.concatenate(b, b)
    assert np.allclose(combined.apply(x, 1.0).to_array().ravel(), [2, -1, 4, -2])


def test_names():
    for name in ("DataContainer", "SiddonsMethod", "CGLS", "phantoms", "EDF", "FISTA", "bestCommon", "Huber"):
        assert name in E.__all__
    with Timer("test", "nothing") as t:
        pass
    assert t.seconds >= 0
    E.set_level("off")
    assert not logging.getLogger("tomolith.x").isEnabledFor(logging.CRITICAL)
    E.set_level("info")


@pytest.mark.parametrize("name", ["ew_sub_vectors", "norms", "pnorm_l2", "assign_slice", "adjoint", "op_block_col", "fd_central_adjoint", "dict_apply", "dft_1d", "f_emission", "prox_mixed_l21", "cgne", "cgls", "sinogram_joseph", "trajectory_circle", "subset_rotational"])
def test_sql_agrees(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("customer", "supplier", "part", "orders", "lineitem", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = catalog.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(tuple(map(float, r)) for r in df.select(*cols).collect())
    want = sorted(tuple(map(float, r)) for r in con.sql(catalog.oracle_sql()[name]).select(*cols).fetchall())
    assert np.allclose(got, want, atol=1e-6)


def test_entry(spark):
    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())
