"""Scalar functions of hit features, as column expressions that stay in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def radius(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def theta(x: Column, y: Column, z: Column) -> Column:
    """Polar angle; null where all coordinates are 0."""
    return F.acos(F.try_divide(z, radius(x, y, z)))


def eta_of_theta(t: Column) -> Column:
    return F.when(t > 0, -F.log(F.tan(t / 2)))


def eta(x: Column, y: Column, z: Column) -> Column:
    """Pseudorapidity with guards against a vanishing z and a vanishing angle."""
    return -F.signum(z) * F.log(F.sqrt(x * x + y * y) / F.abs(z + 1e-3) / 2 + 1e-3)


def phi(x: Column, y: Column) -> Column:
    return F.atan2(y, x)


def delta_phi(a: Column, b: Column) -> Column:
    """Difference of angles, wrapped into (-pi, pi]."""
    d = a - b
    return F.when(d > math.pi, d - 2 * math.pi).when(d <= -math.pi, d + 2 * math.pi).otherwise(d)


def delta_r_squared(eta_a: Column, phi_a: Column, eta_b: Column, phi_b: Column) -> Column:
    d = delta_phi(phi_a, phi_b)
    return (eta_a - eta_b) * (eta_a - eta_b) + d * d


def pid_class(pdg: Column, charge: Column) -> Column:
    """Particle class; the rules of the fixed code table win over the charge rule."""
    a = F.abs(pdg)
    return F.when(pdg == 0, "amb").when(pdg == 22, "gamma").when(a == 13, "muon").when(a == 11, "elec").when(charge != 0, "chad").otherwise("nhad")


def energy_weight(e: Column) -> Column:
    """0 up to 0.5, rising to 1 at 10."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (e - 0.5) / 9.5))


def huber(x: Column, d: float) -> Column:
    return F.when(F.abs(x) <= d, x * x).otherwise(d * d + 2 * d * (F.abs(x) - d))


def pinball(x: Column, tau: float) -> Column:
    return F.greatest(tau * x, (tau - 1) * x)


def soft_clip(x: Column, start: float) -> Column:
    """x up to start, logarithmic from there."""
    return F.when(x > start, start + F.log(F.greatest(x, F.lit(start)) - start + 1)).otherwise(x)


def bounded_scale(x: Column, most: float) -> Column:
    """exp-like scale: x = 0 gives 1, bounded by 1/most and most on either side."""
    up = 1 + (most - 1) * (2 / (1 + F.exp(-x)) - 1)
    down = 1 / (1 + (most - 1) * (2 / (1 + F.exp(x)) - 1))
    return F.when(x >= 0, up).otherwise(down)


def modulated(x: Column, d: Column, t: float, inverse: bool = False) -> Column:
    """x, switched smoothly off (or on) where d passes t."""
    sign = 1 if inverse else -1
    return 0.5 * (1 + sign * F.tanh(10 / (t + 1e-2) * (d - t))) * x


def response_scale(x: Column) -> Column:
    return F.when(x <= 3, x).otherwise(3 + F.log(F.greatest(x, F.lit(3.0))) - math.log(3))


def threshold_mask(x: Column, t: float, invert: bool = False) -> Column:
    below, above = (1, 0) if invert else (0, 1)
    return F.when(x < t, below).otherwise(above)


def charge_strength(beta: Column, spectator: Column, q_min: float) -> Column:
    """Condensation charge: grows with beta, vanishes for spectators."""
    a = F.atanh(beta / 1.01)
    return (a * a + q_min) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - spectator))
