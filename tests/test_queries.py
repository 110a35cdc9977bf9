"""Every query with an oracle against DuckDB on the smallest tables; the others for rows and determinism."""

import os

import duckdb
import numpy as np
import pytest
from test_kernels import direct_surface

from isohyet.operators.kernels import emd
from isohyet.plans import inputs
from isohyet.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10]
    return round(float(v), 4) + 0.0 if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else str(v)


def rows_of(rows, columns):
    return sorted([tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in rows], key=str)


# The smallest tables have series of under two cycles, which have no seasonal decomposition.
@pytest.mark.parametrize("name", sorted(set(ORACLE_SQL) - {"stl_sum"}))
def test_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = con.sql(ORACLE_SQL[name])
    columns, wanted = got.columns, got.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert rows_of([tuple(r) for r in df.collect()], df.columns) == rows_of(wanted, columns)


SMALL = ["pettitt_prewhitened", "ridge_weights", "monte_carlo_interval", "multi_site_shuffle", "emd_components", "stl_robust_residual", "mode_significance", "dynamic_lag_coefficient", "thiessen_mean"]


@pytest.mark.parametrize("name", SMALL)
def test_repeats(spark, name):
    df = QUERIES[name](spark, SF)
    first = sorted(map(str, df.collect()))
    assert first == sorted(map(str, QUERIES[name](spark, SF).repartition(3).collect()))
    assert first or name == "stl_robust_residual"


@pytest.mark.parametrize("name", ["weather_generator", "generated_months", "multi_site_shuffle", "downscaling_perceptron"])
def test_every_station(spark, name):
    assert QUERIES[name](spark, SF).select("station").distinct().count() == 25


def test_every_station_has_lines(spark):
    assert QUERIES["swat_lines"](spark, SF).count() == 25 * 5 * 1096


@pytest.mark.parametrize("name", ["emd2d_grid", "bemd_grid"])
def test_whole_grid_is_decomposed(spark, monkeypatch, name):
    sf = "/root/testdata/sf0.1"
    z = inputs.grid(spark, sf).toPandas().pivot_table(index="y", columns="x", values="value").to_numpy()
    z = np.where(np.isfinite(z), z, np.nanmean(z))
    monkeypatch.setattr(emd, "_surface", direct_surface)
    wanted = emd.emd2d(z, radial=name == "bemd_grid")
    got = QUERIES[name](spark, sf).toPandas().sort_values(["component", "y", "x"])["value"].to_numpy().reshape(wanted.shape)
    assert len(got) > 1 and np.allclose(got, wanted, atol=1e-3)


def test_climatology_is_not_broadcast(spark):
    """It grows with the suppliers, however small Spark takes it for."""
    plan = QUERIES["climatology_anomaly"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
    assert os.path.isdir(SF)
