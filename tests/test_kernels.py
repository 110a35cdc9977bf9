"""Closed forms, invariants and properties of the numpy kernels."""

import math
import time

import numpy as np
import pytest

from isohyet.operators.kernels import bayes, emd, filters, ranks, regress, special, weather


@pytest.mark.parametrize("options", [{}, {"fixe": 10}, {"fixe_h": 5}, {"stop": "rilling"}, {"extrema": "parabol"}, {"kind": "akima"}, {"kind": "linear"}, {"max_imf": 1}])
def test_modes_add_up(options):
    t = np.linspace(0, 2 * np.pi, 400)
    s = np.sin(20 * t * (1 + 0.2 * t)) + t**2 + np.sin(13 * t)
    modes = emd.emd(s, t, **options)
    assert len(modes) >= 2 and np.allclose(modes.sum(0), s, atol=1e-9)


def test_mode_separates_tones():
    t = np.linspace(0, 10, 1000)
    fast = np.sin(2 * np.pi * 5 * t)
    modes = emd.emd(fast + 2 * np.sin(2 * np.pi * 0.5 * t))
    assert np.corrcoef(modes[0][100:-100], fast[100:-100])[0, 1] > 0.99
    f = emd.instantaneous_frequency(modes[0], t)
    assert np.median(f[100:-100]) == pytest.approx(5, rel=0.02)


@pytest.mark.parametrize("s", [np.zeros(50), np.ones(50), np.arange(50.0), np.array([1.0, 2.0]), np.array([])])
def test_modes_of_flat_series(s):
    if len(s):
        assert np.allclose(emd.emd(s).sum(0), s)


def test_ceemdan_adds_up():
    t = np.linspace(0, 2 * np.pi, 300)
    s = 3 * np.sin(4 * t) + 4 * np.cos(9 * t) + np.sin(8.11 * t + 1.2)
    assert np.allclose(emd.ceemdan(s, trials=8).sum(0), s)
    assert np.array_equal(emd.ceemdan(s, trials=4, seed=3), emd.ceemdan(s, trials=4, seed=3))


def test_splines():
    x = np.linspace(0, 10, 11)
    cubic = lambda v: v**3 - 2 * v + 1
    at = np.linspace(0, 10, 77)
    assert np.allclose(emd.cubic(x, cubic(x), at), cubic(at))
    assert np.allclose(emd.akima(x, 2 * x + 1, at), 2 * at + 1)
    assert np.allclose(emd.pade6(np.sin(at), at[1] - at[0]), np.cos(at), atol=1e-3)
    assert np.allclose(emd.filter6(np.full(40, 3.0), 0.4), 3.0)


def test_image_modes_add_up():
    y, x = np.mgrid[0:20, 0:24]
    z = np.sin(x) * np.cos(y) + 0.1 * x
    for radial in (False, True):
        assert np.allclose(emd.emd2d(z, 2, radial=radial).sum(0), z)


def direct_surface(z, points, radial):
    """Through every local extremum of the image and of its mirrors, by one dense system."""
    h, w = z.shape
    known = {(int(a), int(b)): z[i, j] for i, j in points for a in (i, -i, 2 * h - 2 - i) for b in (j, -j, 2 * w - 2 - j)}
    c, v = np.array(list(known)) / max(h, w), np.array(list(known.values()))
    kernel = (lambda r: r**3) if radial else (lambda r: r * r * np.log(np.where(r > 0, r, 1)))
    rows = lambda at: np.c_[kernel(np.hypot(*(at[:, None] - c).transpose(2, 0, 1))), np.ones(len(at)), at]
    flat = np.c_[np.ones(len(c)), c]
    coef = np.linalg.solve(np.r_[rows(c), np.c_[flat.T, np.zeros((3, 3))]], np.r_[v, np.zeros(3)])
    return (rows(np.argwhere(np.ones_like(z)) / max(h, w)) @ coef).reshape(h, w)


@pytest.mark.parametrize("radial", [False, True])
def test_image_modes_use_every_extremum(radial):
    z = np.random.default_rng(3).random((62, 62))
    found = emd._surface_extrema(z)
    assert min(map(len, found)) > 400
    scaled = (z - z.min()) / (z.max() - z.min())
    mode = scaled - sum(direct_surface(scaled, p, radial) for p in found) / 2
    assert np.allclose(emd.emd2d(z, 1, passes=1, radial=radial)[0], mode * (z.max() - z.min()), atol=1e-4)


@pytest.mark.parametrize("radial", [False, True])
@pytest.mark.parametrize("shape", [(61, 23), (9, 40), (40, 7)])
def test_surface_by_convolution(monkeypatch, radial, shape):
    """On large images the sum over knots is one convolution: the same values."""
    r = np.random.default_rng(7)
    z, points = r.random(shape), np.argwhere(r.random(shape) < 0.1)
    monkeypatch.setattr(emd, "MAX_SUMMED", 10**12)
    summed = emd._surface(z, points, radial)
    monkeypatch.setattr(emd, "MAX_SUMMED", 0)
    assert np.allclose(emd._surface(z, points, radial), summed, atol=1e-8)


@pytest.mark.parametrize("radial", [False, True])
def test_flat_surface_through_many_extrema(monkeypatch, radial):
    """Extrema on a plane need no weights: nothing to iterate on but rounding."""
    z = np.full((1600, 40), 0.1)
    points = np.array([(y, x) for y in range(24, 1600, 25) for x in (20, 39)])
    z[points[:, 0], points[:, 1]] = 0.7
    monkeypatch.setattr(emd, "MAX_DENSE", 400)
    assert np.allclose(emd._surface(z, points, radial), 0.7, atol=1e-12)


@pytest.mark.parametrize("radial", [False, True])
def test_surface_without_a_matrix(monkeypatch, radial):
    z = np.random.default_rng(4).random((30, 26))
    points = emd._surface_extrema(z)[0]
    monkeypatch.setattr(emd, "MAX_DENSE", 100)
    assert np.allclose(emd._surface(z, points, radial), direct_surface(z, points, radial), atol=1e-5)


def test_stl():
    n = np.arange(180)
    y = 0.1 * n + 3 * np.sin(2 * np.pi * n / 12)
    t, s, r = filters.stl(y, 12, 13, 121)
    assert np.allclose(t + s + r, y) and np.abs(r).max() < 0.3 and np.corrcoef(s, np.sin(2 * np.pi * n / 12))[0, 1] > 0.99
    assert filters.interpolated(np.array([1, np.nan, 3.0]), 0.5).tolist() == [1, 2, 3] and filters.interpolated(np.array([1, np.nan, 3.0])) is None


def test_filter_against_plain_loop():
    rng = np.random.default_rng(0)
    y = rng.normal(size=60)
    y[[7, 8, 30]] = np.nan
    lag = np.r_[0.0, np.nan_to_num(y[:-1])]
    got = filters.forward_filter(y, lag)
    m, c, s, nu, x = np.zeros(7), np.eye(7), 0.04, 5.0, lag.copy()
    g = np.zeros((7, 7))
    g[0, 0] = g[0, 1] = g[1, 1] = g[2, 2] = 1
    for j, h in enumerate((1, 2)):
        w = 2 * np.pi * h / (365.25 / 16)
        g[3 + 2 * j : 5 + 2 * j, 3 + 2 * j : 5 + 2 * j] = [[np.cos(w), np.sin(w)], [-np.sin(w), np.cos(w)]]
    for t in range(60):
        a, r = g @ m, g @ c @ g.T
        for lo, hi in ((0, 2), (2, 3), (3, 7)):
            r[lo:hi, lo:hi] /= 0.98
        nu *= 0.98
        f = np.array([1, 0, x[t], 1, 0, 1, 0])
        q = f @ r @ f + s
        k = r @ f / q
        if np.isnan(y[t]):
            m, c = a, r
            if t < 59:
                x[t + 1] = f @ a
        else:
            e = y[t] - f @ a
            z = (nu + e * e / q) / (nu + 1)
            m, c, nu, s = a + k * e, z * (r - np.outer(k, k) * q), nu + 1, z * s
        assert np.allclose(got["m"][t + 1], m) and np.allclose(got["C"][t + 1], c) and got["nu"][t + 1] == pytest.approx(nu)


def test_special_functions():
    assert special.t_two_sided(2.228138851986274, 10) == pytest.approx(0.05, abs=1e-9)
    assert special.gammainc(2, 3) == pytest.approx(1 - 4 * math.exp(-3))
    assert filters.student_ppf(0.975, 10) == pytest.approx(2.228138851986274)
    assert special.normal_ppf(np.array([0.975]))[0] == pytest.approx(1.959963984540054)


def test_bayes():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(150, 4))
    y = 1 + 2 * x[:, 0] - x[:, 2] + rng.normal(0, 0.5, 150)
    post = bayes.enumerate_models(x, y)
    visits, walk = bayes.mc3(x, y, 4000, seed=2)
    assert sum(post.values()) == pytest.approx(1) and sum(visits.values()) == pytest.approx(1)
    assert max(post, key=post.get) == max(visits, key=visits.get) == (1, 0, 1, 0)
    share = lambda p, i: sum(v for m, v in p.items() if m[i])
    assert all(abs(share(post, i) - share(visits, i)) < 0.1 for i in range(4))
    assert bayes.diagnose(walk, 4)["ess"].shape == (4,)
    b, c = bayes.averaged_coefficients(x, y)
    assert b == pytest.approx(1, abs=0.2) and np.allclose(c, [2, 0, -1, 0], atol=0.2)
    w = bayes.least_variance(np.column_stack([rng.normal(0, 1, 500), rng.normal(0, 3, 500)]))
    assert w.sum() == pytest.approx(1) and w[0] > 0.8
    low, high = bayes.prediction_interval(lambda v: math.exp(-v * v / 2) / math.sqrt(2 * math.pi), 0, 0.95, 10)
    assert (low, high) == pytest.approx((-1.95996, 1.95996), abs=1e-4)
    draws = bayes.predictive_draws(x, y, x[:3], 4000)
    assert np.allclose(draws.mean(1), 1 + 2 * x[:3, 0] - x[:3, 2], atol=0.3)


@pytest.fixture
def station():
    rng = np.random.default_rng(5)
    years = 5
    rain = np.where(rng.random((years, 365)) < 0.3, rng.gamma(0.8, 6, (years, 365)) + 0.2, 0.0)
    wave = np.sin(np.arange(365) / 58)
    return {"PRE": rain, "MAXTEM": 20 + 8 * wave + rng.normal(0, 2, (years, 365)), "MINTEM": 10 + 8 * wave + rng.normal(0, 2, (years, 365)), "RHU": np.clip(0.6 + rng.normal(0, 0.1, (years, 365)), 0, 1), "RS": 15 + rng.normal(0, 2, (years, 365)), "WIN": rng.weibull(2, (years, 365)) * 3}


def test_occurrence(station):
    _, p = weather.occurrence(station["PRE"])
    assert p.shape == (4, 365) and np.allclose(p[0] + p[1], 1) and np.allclose(p[2] + p[3], 1)
    assert p[0].mean() == pytest.approx(0.7, abs=0.05)


def test_generator(station):
    model = weather.fit(station)
    targets = {"PRE": np.full(36, 60.0), "MAXTEM": np.full(36, 22.0)}
    rules = {"PRE": ("sum", "scaling"), "MAXTEM": ("mean", "translation")}
    a, b = (weather.generate(model, targets, 3, rules, 7) for _ in range(2))
    assert all(np.array_equal(a[k], b[k]) for k in a)
    assert (a["MINTEM"] <= a["MAXTEM"]).all() and (a["PRE"] >= 0).all() and a["RHU"].max() <= 0.95 and (a["WIN"] > 0).all()


@pytest.mark.parametrize("name", sorted(weather.FAMILIES))
def test_distribution_draws_refit(name):
    rng = np.random.default_rng(3)
    x = rng.gamma(2.0, 3.0, 4000)
    p = [float(v) for v in weather.FAMILIES[name][0](x)]
    assert all(np.isfinite(p))
    d = weather.positive_draws(rng, name, p, 4000)
    assert (d > 0).all() and d.mean() == pytest.approx(x.mean(), rel=0.25)


def test_monthly_correction_meets_target():
    rng = np.random.default_rng(0)
    days, target = rng.random(730), rng.random(24) * 10
    month = np.tile(np.repeat(np.arange(12), weather.MONTHS), 2) + 12 * np.repeat([0, 1], 365)
    for how, corrector in (("sum", "scaling"), ("mean", "scaling"), ("mean", "translation")):
        out = weather.correct(days, target, how, corrector)
        total = np.bincount(month, out)
        assert np.allclose(total if how == "sum" else total / np.bincount(month), target)


def test_shuffle_keeps_margins_and_moves_correlation():
    obs = np.arange(90.0).reshape(15, 6)
    gen = np.random.default_rng(0).random((15, 6))
    out, _ = weather.multi_site(obs, gen)
    assert np.array_equal(np.sort(out, 0), np.sort(gen, 0)) and weather.spearman(out).min() > 0.9
    filled, _ = weather.multi_site(obs, np.where(gen < 0.3, 0.0, gen), fill=True)
    assert np.isfinite(filled).all() and (filled >= 0).all()


def test_regressions():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 5))
    y = 2 * x[:, 0] - x[:, 2] + rng.normal(0, 0.1, 200)
    assert regress.forward_selection(x, y, 2) == [0, 2]
    p = regress.Perceptron((32, 16), 100).fit(x, y)
    assert ((p.predict(x)[:, 0] - y) ** 2).mean() < 0.1 * y.var()
    t = regress.BoostedTrees(25).fit(x, y)
    shap = t.shap(x[:40])
    assert np.ptp(t.predict(x[:40]) - shap.sum(1)) < 1e-9 and np.abs(shap).mean(0).argmax() == 0


def test_white_noise_check_by_its_formulas():
    rng = np.random.default_rng(3)
    modes = np.array([rng.normal(0, 1, 200), np.sin(np.arange(200) / 5), 0.1 * np.sin(np.arange(200) / 20)])
    periods = []
    for m in modes:
        peaks = sum(m[i] > m[i - 1] and m[i] > m[i + 1] and m[i] >= 0 for i in range(1, 199))
        periods.append(200 / peaks if peaks else 200)
    energy = [math.log(sum(v * v for v in m) / 200) for m in modes]
    k = 1.959963984540054
    upper = [-math.log(t) + k * math.sqrt(2 / 200) * math.exp(math.log(t) / 2) for t in periods]
    lower = [-math.log(t) - k * math.sqrt(2 / 200) * math.exp(math.log(t) / 2) for t in periods]
    assert emd.white_noise_check(modes, "apriori") == {i + 1: int(not lower[i] <= e <= upper[i]) for i, e in enumerate(energy)}
    for r in (1, 2, 3):
        up = -math.log(periods[r - 1]) + k * math.sqrt(2 / 200) * math.exp(math.log(periods[r - 1])) / 2
        assert emd.white_noise_check(modes, "aposteriori", r) == {i + 1: int(e + up - energy[r - 1] > upper[i]) for i, e in enumerate(energy)}


def test_modes_of_white_noise_are_seldom_significant():
    flags = []
    for k in range(25):
        s = np.random.default_rng(k).normal(0, 1, 512)
        flags += list(emd.white_noise_check(emd.emd(s, max_imf=4)[:4]).values())
    assert np.mean(flags) < 0.15


def test_ceemdan_by_its_steps():
    t = np.linspace(0, 6, 120)
    s = 3 * np.sin(4 * t) + np.cos(19 * t) + t
    got = emd.ceemdan(s, trials=3, seed=5, max_imf=2)
    x, noises = s / np.std(s), []
    for k in range(3):
        parts = emd.emd(np.random.default_rng((5, k)).normal(0, 1, 120))
        noises.append([p / np.std(parts[0]) for p in parts])
    first = sum(emd.emd(x + 0.005 * n[0], max_imf=1)[0] for n in noises) / 3
    rest = x - first
    local = sum(emd.emd(rest + 0.005 * np.std(rest) * n[1], max_imf=1)[-1] for n in noises) / 3
    assert np.allclose(got, np.array([first, rest - local, local]) * np.std(s))


def test_ridge_on_normalised_columns():
    rng = np.random.default_rng(1)
    x = rng.normal(0, [1, 100, 0.01], (43, 3))
    y = x @ [1, 0.02, 50] + 3 + rng.normal(0, 0.5, 43)
    penalties = np.logspace(-5, 2, 200)

    def fit(a, b, penalty):  # normal equations
        norm = np.linalg.norm(a - a.mean(0), axis=0)
        z = (a - a.mean(0)) / norm
        c = np.linalg.solve(z.T @ z + penalty * np.eye(3), z.T @ (b - b.mean())) / norm
        return b.mean() - a.mean(0) @ c, c

    def error(penalty):
        out, at = [], 0
        for k in range(10):
            size = 43 // 10 + (k < 43 % 10)
            held = np.arange(43)[at : at + size]
            b, c = fit(np.delete(x, held, 0), np.delete(y, held), penalty)
            out.append(np.mean((x[held] @ c + b - y[held]) ** 2))
            at += size
        return np.mean(out)

    b, c = fit(x, y, min(penalties, key=error))
    got = bayes.ridge_cv(x, y)
    assert got[0] == pytest.approx(b) and got[1] == pytest.approx(c)


def test_least_variance_centres_errors():
    rng = np.random.default_rng(2)
    e = rng.normal([5, -3, 0], [1, 2, 3], (300, 3))
    inverse = np.linalg.inv(np.cov(e.T))
    assert bayes.least_variance(e) == pytest.approx(inverse.sum(1) / inverse.sum())


def test_mirrors_stay_outside_at_both_ends():
    """A series read backwards has its envelopes backwards."""
    for k in range(20):
        s = np.cumsum(np.random.default_rng(k).normal(0, 1, 60))
        a, b = emd.envelopes(np.arange(60.0), s), emd.envelopes(np.arange(60.0), s[::-1])
        if a is not None:
            assert np.allclose(a[0], b[0][::-1]) and np.allclose(a[1], b[1][::-1])


# Statistics of all pairs.
def test_earlier_counts():
    r = np.random.default_rng(1)
    for n in range(40):
        x = r.integers(0, 8, n).astype(float) if n % 2 else r.normal(size=n)
        below, above = ranks.earlier(ranks.ranks(x))
        assert below.tolist() == [int((x[:i] < x[i]).sum()) for i in range(n)] and above.tolist() == [int((x[:i] > x[i]).sum()) for i in range(n)]


@pytest.mark.parametrize("kind", ["noise", "few values", "mostly zero", "line", "constant"])
def test_slopes_are_selected(monkeypatch, kind):
    """As the sorted slopes of all pairs have them, though few are listed."""
    monkeypatch.setattr(ranks, "_LISTED", 400)
    monkeypatch.setattr(ranks, "_DRAWN", 300)
    r = np.random.default_rng(2)
    for n in range(60, 130, 3):
        x = {"noise": r.normal(size=n), "few values": r.integers(0, 3, n).astype(float), "mostly zero": np.round(r.gamma(0.3, 2, n), 1) * (r.random(n) < 0.4), "line": np.arange(n) * 0.1 + r.normal(size=n) * 0.01, "constant": np.full(n, 3.0)}[kind]
        slopes = np.sort(ranks.all_slopes(x))
        assert ranks.sen_slope(x) == pytest.approx(np.median(slopes), abs=1e-9)
        for k in (0, len(slopes) // 5, len(slopes) - 1):
            assert ranks.kth_slope(x, k) == pytest.approx(slopes[k], abs=1e-9)
        low, high = np.quantile(slopes, [0.3, 0.6]) + 1e-7
        assert np.sort(ranks.slopes_between(x, low, high)) == pytest.approx(slopes[(slopes > low) & (slopes < high)])


def test_long_series_take_seconds():
    """20,000 steps: 2 * 10^8 pairs. S by a plain count of each value against all later ones."""
    x = np.round(np.random.default_rng(3).gamma(2, 3, 20_000), 2) + np.arange(20_000) * 1e-4
    began = time.perf_counter()
    s, slope, uf = ranks.trend_sum(x), ranks.sen_slope(x), ranks.sequential(x)[0]
    assert time.perf_counter() - began < 10
    assert s == sum(int(np.sign(x[k + 1 :] - v).sum()) for k, v in enumerate(x))
    near = 1e-9
    at = lambda t: sum(int(((x[k + 1 :] - v) / np.arange(1, len(x) - k) < t).sum()) for k, v in enumerate(x))
    half = len(x) * (len(x) - 1) // 4
    assert at(slope - near) <= half <= at(slope + near) and len(uf) == len(x)


def test_prewhitened_lines_and_short_series():
    assert ranks.prewhitened(np.arange(30) * 0.5).tolist() == pytest.approx((np.arange(1, 30) * 0.5).tolist())
    assert np.isnan(ranks.sen_slope(np.array([1.0]))) and ranks.trend_sum(np.zeros(0)) == 0 and ranks.sequential(np.array([2.0]))[0].tolist() == [0.0]
