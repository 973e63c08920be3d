"""Closed forms of chlorine chemistry and pipe hydraulics, as column builders."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

GAS = 8.314  # J/(mol K)


def arrhenius(celsius: Column, activation_j: float, reference: float = 20.0) -> Column:
    """Rate multiplier at a temperature against the reference."""
    return F.exp(F.lit(-activation_j / GAS) * (1 / (celsius + 273.15) - 1 / (reference + 273.15)))


def viscosity(celsius: Column) -> Column:
    """Kinematic viscosity of water, m2/s."""
    return F.lit(497e-6) / F.pow(celsius + 42.5, F.lit(1.5))


def viscosity_ratio(celsius: Column, reference: float = 20.0) -> Column:
    """Viscosity against that at the reference temperature."""
    return viscosity(celsius) / viscosity(F.lit(reference))


def bulk_scale(celsius: Column, er: float, toc: Column, toc_reference: float) -> Column:
    """Multiplier of a bulk rate: by temperature (er: activation energy over the gas constant, K) and organic carbon; unknown ones count as the reference."""
    return F.coalesce(arrhenius(celsius, er * GAS), F.lit(1.0)) * F.coalesce(toc / toc_reference, F.lit(1.0))


def wall_scale(celsius: Column, er: float, mode: Column) -> Column:
    """Multiplier of a wall rate: by temperature, or 1 where mass transfer alone governs it or the temperature is unknown."""
    return F.when(celsius.isNull() | (mode == "mass_transfer_only"), 1.0).otherwise(arrhenius(celsius, er * GAS))


def hazen_williams_equivalent(diameter: Column, roughness: Column, velocity: Column, nu: Column) -> Column:
    """Hazen-Williams C that gives a pipe's Darcy-Weisbach headloss at a velocity (Swamee-Jain friction). Metres, m/s, m2/s."""
    reynolds = velocity * diameter / nu
    friction = 0.25 / F.pow(F.log10(roughness / (3.7 * diameter) + 5.74 / F.pow(reynolds, F.lit(0.9))), F.lit(2.0))
    flow = velocity * math.pi * diameter * diameter / 4
    return F.pow(10.67 * F.pow(flow, F.lit(1.852)) * 2 * 9.81 * diameter / (F.pow(diameter, F.lit(4.8704)) * friction * velocity * velocity), F.lit(1 / 1.852))


def hour_encoding(hour: Column) -> list[Column]:
    """Sine and cosine of an hour's place in the day."""
    return [F.sin(2 * math.pi * hour / 24), F.cos(2 * math.pi * hour / 24)]


def seasonal(day: Column, mean: float, amplitude: float, peak_day: float) -> Column:
    """Yearly cosine, rounded to halves (ties to even)."""
    return F.bround((mean + amplitude * F.cos(2 * math.pi * (day - peak_day) / 365.0)) * 2) / 2


def decay(start: Column, hours: Column, rate: Column, order: Column, limit: Column) -> Column:
    """Concentration after some hours: order 0, 1, 2, or -1 for first order towards a limit. Never negative."""
    free = F.when(order == 0, start - rate * hours).when(order == 1, start * F.exp(-rate * hours)).when(order == 2, start / (1 + start * rate * hours)).when(order == -1, limit + (start - limit) * F.exp(-rate * hours))
    return F.greatest(free, F.lit(0.0))


def roughness_factor(c: Column, gamma: float) -> Column:
    return F.pow(F.lit(2.0), -gamma * (c - 130) / 30)


def warming(age_h: Column, plant: Column, soil: Column, tau_h: float) -> Column:
    """Water temperature on its way from the plant's to the soil's."""
    return soil + (plant - soil) * F.exp(-age_h / tau_h)


def norm_cdf(x: Column) -> Column:
    """Normal distribution function by a five-term polynomial (error under 1e-7)."""
    z = F.abs(x)
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(x >= 0, 1 - tail).otherwise(tail)
