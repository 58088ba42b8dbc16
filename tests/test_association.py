"""Chi-square and phi_K against their definitions."""

import math

import numpy as np
import pytest

from tallyframe.operators import association


def test_normal_grid_sums_to_one_and_matches_its_limits():
    for rho in (0.0, 0.3, 0.9, 0.999, 1.0):
        table = association._normal_table(rho, 4, 7)
        assert table.shape == (4, 7)
        assert table.sum() == pytest.approx(1.0, abs=3e-6)
    cdf = lambda v: 0.5 * (1 + math.erf(v / math.sqrt(2)))
    edges = np.linspace(-5, 5, 5)
    margins = np.diff([cdf(e) for e in edges])
    np.testing.assert_allclose(
        association._normal_table(0.0, 4, 4), np.outer(margins, margins), atol=1e-9)
    # A quadrant of the plane has the closed form 1/4 + asin(rho) / (2 pi).
    quadrant = association._normal_table(0.6, 2, 2)[1, 1]
    assert quadrant == pytest.approx(0.25 + math.asin(0.6) / (2 * math.pi), abs=1e-6)


@pytest.mark.parametrize("rho", [0.2, 0.5, 0.8, 0.95])
def test_phi_k_returns_the_correlation_it_was_made_from(rho):
    nx, ny, n = 6, 8, 100_000
    independent = association._normal_table(0.0, nx, ny)

    def distance(r):
        return ((association._normal_table(r, nx, ny) - independent) ** 2 / independent).sum()

    pedestal, largest = (nx - 1) * (ny - 1), n * min(nx - 1, ny - 1)
    chi2 = pedestal + (largest - pedestal) * distance(rho) / distance(1.0)
    assert association.phi_k(chi2, n, nx, ny) == pytest.approx(rho, abs=1e-6)


def test_phi_k_limits():
    assert association.phi_k(3.0, 100, 4, 4) == 0.0
    assert association.phi_k(1e9, 100, 4, 4) == 1.0
    assert math.isnan(association.phi_k(3.0, 100, 1, 4))


def test_chi_square_by_hand(spark):
    rows = [("a", 0.0)] * 30 + [("a", 1.0)] * 10 + [("b", 0.0)] * 5 + [("b", 1.0)] * 15
    df = spark.createDataFrame(rows + [(None, 0.5), ("a", None)], "c string, t double")
    got = association.association(df, "t", ["c"], ["t"], bins=2).first()
    observed = np.array([[30, 10], [5, 15]])
    expected = np.outer(observed.sum(1), observed.sum(0)) / 60
    chi2 = ((observed - expected) ** 2 / expected).sum()
    assert got["total"] == 60 and got["nx"] == 2 and got["ny"] == 2
    assert got["chi2"] == pytest.approx(chi2, rel=1e-9)
    assert got["cramers_v"] == pytest.approx(math.sqrt(chi2 / 60), rel=1e-9)
    assert 0 < got["phi_k"] < 1


def test_a_copy_of_the_target_is_fully_associated(spark):
    df = spark.createDataFrame([(str(i % 5), float(i % 5)) for i in range(200)], "c string, t double")
    assert association.association(df, "t", ["c"], ["t"], bins=5).first()["phi_k"] == 1.0
