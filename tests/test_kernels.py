"""Small matrices and kernels against known values and closed forms."""

import numpy as np
import pytest

from terrafield.functions import kernels as K


def test_symmat_values():
    assert K.symmat([1]).tolist() == [[1]]
    assert K.symmat([1, 2, 3]).tolist() == [[1, 3], [3, 2]]
    assert K.symmat([1, 2, 3, 4, 5, 6]).tolist() == [[1, 4, 5], [4, 2, 6], [5, 6, 3]]
    with pytest.raises(ValueError, match="length of coords incompatible with a symetric matrix"):
        K.symmat([1, 2, 3, 4, 5])


def test_expmat_values():
    want = np.array([[47859.7700011562, 55641.9937959158, 62462.1209161336], [55641.9937959158, 64689.8331149192, 72618.8933675331], [62462.1209161336, 72618.8933675331, 81519.8962286822]])
    assert np.allclose(K.expmat([1, 2, 3, 4, 5, 6]), want, rtol=1e-12)
    assert np.allclose(K.expmat([1, 2, 3, 4, 5, 6], eps=0), want - 1e-4 * np.eye(3), rtol=1e-12)


def test_derivative_values():
    d = K.derivative_chol_expmat([1, 2, 3, 3, 2, 4])
    assert d.shape == (3, 3, 6)
    assert np.allclose(d.mean((1, 2)), [8.5554350147, -0.0108160777, 0.0003808579], rtol=1e-4)
    assert np.allclose(d.mean((0, 2)), [2.343741568, 3.071973047, 3.129285180], rtol=1e-4)
    f = K.derivative_field_wrt_scale([1, 2, 3], [1, 2, 3, 3, 2, 4])
    assert f.shape == (1, 3, 6)
    assert f.mean() == pytest.approx(0.312839647, rel=1e-4)
    assert np.allclose(f.mean((0, 2)), [0.261804197, 0.335998026, 0.340716718], rtol=1e-4)


def test_two_by_two_exponential_is_expmat():
    rng = np.random.default_rng(0)
    for a, c, b in [*rng.normal(size=(20, 3)), (1.0, 1.0, 0.0)]:
        assert np.allclose(K.expm2_np(a, c, b), K.expmat([a, c, b], eps=0))


def test_iso_and_aniso_agree_when_stationary():
    h = np.random.default_rng(1).normal(size=(30, 2))
    one = np.full((30, 1), -1.3)
    three = np.tile([-1.3, -1.3, 0.0], (30, 1))
    for nu in (0.5, 1.5):
        assert np.allclose(K.covariance(h, one, one, nu), K.covariance(h, three, three, nu))
    r1, r2 = np.exp(-4.0), np.exp(-2.0)
    assert (r1 * r2) ** 0.25 * ((r1 + r2) / 2) ** -0.5 == pytest.approx(0.80502, abs=1e-5)
    z = np.zeros((1, 2))
    assert K.covariance(z, np.full((1, 1), -4.0), np.full((1, 1), -2.0), 1.5, "2d")[0] == pytest.approx(K.covariance(z, np.array([[-4.0, -4, 0]]), np.array([[-2.0, -2, 0]]), 1.5)[0])
    assert K.covariance(z, np.array([[-4.0, -4, 0]]), np.array([[-2.0, -2, 0]]), 1.5)[0] == pytest.approx(0.64805, abs=1e-5)


def test_smoothness_is_checked():
    with pytest.raises(ValueError):
        K.matern(np.ones(1), 1.0)
