"""Carrying-capacity classes and water balance as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Land-use codes that have a class; the first five share one model.
FIRST_FIVE, SIXTH, TENTH = (1, 2, 3, 4, 5), 6, 10


def _known(*bands: Column) -> Column:
    ok = F.lit(True)
    for b in bands:
        ok = ok & b.isNotNull() & ~F.isnan(b.cast("double"))
    return ok


def capacity_class(ac: Column, npp: Column, use: Column, p: Column, et: Column, future_p: Column, ad_p: Column) -> Column:
    """1 unsuitable, 2 at risk, 3 suitable, by seven bands. Code 1-5 is at risk when the future balance exceeds the past one; 6 and 10 when it is below."""
    net, past = future_p - ad_p, p - et
    rate = F.when(use.isin(*FIRST_FIVE), 0.0002 * future_p + 0.78).when(use == SIXTH, -1.23 + 2.59 * (1 - F.exp(-0.008 * net))).otherwise(0.93 + 1.38 * F.exp(-0.005 * net))
    balance = future_p - npp * rate
    cut = F.when(use.isin(*FIRST_FIVE), 400).when(use == SIXTH, 315).otherwise(175)
    slow = ac > F.when(use.isin(*FIRST_FIVE), 0.05).when(use == SIXTH, 0.16).otherwise(0.6)
    unsuited = (balance + ad_p < 0) & (net < cut) & (balance < past) & slow
    risk = F.when(use.isin(*FIRST_FIVE), balance > past).otherwise(balance < past) & slow
    known = _known(ac, use, p, et, future_p) & use.isin(*FIRST_FIVE, SIXTH, TENTH)
    out = F.when(net < 175, 1).when(F.coalesce(unsuited, F.lit(False)), 1).when(F.coalesce(risk, F.lit(False)), 2).otherwise(3)
    return F.when(known, out)


def capacity_class_by_response(ac: Column, npp: Column, use: Column, future_p: Column) -> Column:
    """The four-band variant: a polynomial of the balance is the expected autocorrelation. Its constants are as published, 10e-5 meaning 1e-4."""
    five = use.isin(*FIRST_FIVE)
    rate = F.when(five, 0.0004 * future_p + 0.75).when(use == SIXTH, -0.10 + 1.51 * (1 - F.exp(-0.006 * future_p))).otherwise(0.95 + 1.41 * F.exp(-0.005 * future_p))
    b = future_p - npp * rate
    expected = F.when(five, 0.1880 + 1.4952e-4 * b + 6.1648e-6 * b * b).when(use == SIXTH, 0.3874 - 0.0003 * b).otherwise(0.0003 + 5.7250e-7 * b - 1.9083e-8 * b * b)
    unsuited = F.when(five, future_p < 400).when(use == SIXTH, (future_p < 315) | (future_p >= 400)).otherwise((future_p < 175) | (future_p >= 315))
    slow = ac > F.when(five, 0.3).when(use == SIXTH, 0.4).otherwise(0.5)
    known = _known(ac, npp, use, future_p) & use.isin(*FIRST_FIVE, SIXTH, TENTH)
    return F.when(known, F.when((future_p < 175) | unsuited, 1).when(slow & (expected > ac), 2).otherwise(3))


def capacity_class_by_rain(ac: Column, use: Column, p: Column, et: Column, future_p: Column, ad_p: Column) -> Column:
    """The four-class variant: 1 dry and at risk, 2 dry, 3 at risk, 4 neither; at risk means less rain than before and a slow recovery."""
    net = future_p - ad_p
    dry = net < F.when(use.isin(*FIRST_FIVE), 400).when(use == SIXTH, 315).otherwise(175)
    risk = (p >= future_p) & (ac > F.when(use.isin(*FIRST_FIVE), 0.429).when(use == SIXTH, 0.489).otherwise(0.437))
    known = _known(ac, use, p, et, future_p) & use.isin(*FIRST_FIVE, SIXTH, TENTH)
    return F.when(known, F.when(net < 175, 1).when(dry & risk, 1).when(dry, 2).when(risk, 3).otherwise(4))


def budyko_residual(n: Column, p: Column, r: Column, et0: Column) -> Column:
    """Water balance P - R minus the Choudhury-Budyko evaporation for n."""
    return p - r - p * et0 / F.pow(F.pow(p, n) + F.pow(et0, n), 1 / n)


def budyko_n(p: Column, r: Column, et0: Column, steps: int = 60) -> Column:
    """n of the Choudhury-Budyko curve through (P, R, ET0), by bisection in (0.05, 50); null outside the curve's range."""
    # Evaporation rises with n from 0 to min(P, ET0), so one sign tells which half to keep.
    start = F.struct(F.lit(0.05).alias("a"), F.lit(50.0).alias("b"))
    half = lambda s: (s["a"] + s["b"]) / 2
    step = lambda s, _: F.when(budyko_residual(half(s), p, r, et0) > 0, F.struct(half(s).alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), half(s).alias("b")))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, half)
    return F.when((p > 0) & (et0 > 0) & (r > 0) & (p - r < F.least(p, et0)) & (p > r), found)


def elasticities(n: Column, p: Column, et0: Column) -> dict[str, Column]:
    """Elasticities of runoff to P, ET0 and n, in the dryness ET0 / P."""
    phi = F.try_divide(et0, p)
    base = 1 + phi + n * phi * phi
    return {"ep": (1 + 2 * phi + 3 * n * phi * phi) / base, "ee": -(phi + 2 * n * phi * phi) / base, "en": n * phi * phi / base}


def contributions(old: dict[str, Column], new: dict[str, Column], e: dict[str, Column]) -> dict[str, Column]:
    """Shares of the runoff change that P, ET0 and n explain; old and new hold p, r, et0, n."""
    dr = new["r"] - old["r"]
    share = lambda x, k: F.try_divide(e[k] * (new[x] - old[x]) * old["r"], old[x] * dr)
    return {"c_p": share("p", "ep"), "c_et0": share("et0", "ee"), "c_n": share("n", "en")}
