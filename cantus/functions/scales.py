"""Frequency scales as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

A4 = 440.0
# The mel scale's factor and corner frequency.
MEL_FACTOR, MEL_CORNER = 1127.01048, 700.0
# Edges and centres of the critical bands in Hz.
BARK = (20, 100, 200, 300, 400, 510, 630, 770, 920, 1080, 1270, 1480, 1720, 2000, 2320, 2700, 3150, 3700, 4400, 5300, 6400, 7700, 9500, 12000, 15500)
BARK_DOUBLE = (20, 50, 100, 150, 200, 250, 300, 350, 400, 450, 510, 570, 630, 700, 770, 840, 920, 1000, 1080, 1170, 1270, 1370, 1480, 1600, 1720, 1850, 2000, 2150, 2320, 2500, 2700, 2900, 3150, 3400, 3700, 4000, 4400, 4800, 5300, 5800, 6400, 7000, 7700, 8500, 9500, 10500, 12000, 13500, 15500)


def hz2mel(f: Column) -> Column:
    return F.lit(MEL_FACTOR) * F.ln(f / MEL_CORNER + 1)


def mel2hz(m: Column) -> Column:
    return F.lit(MEL_CORNER) * (F.exp(m / MEL_FACTOR) - 1)


def hz2midi(f: Column, fref: float = A4) -> Column:
    return F.log2(f / fref) * 12 + 69


def midi2hz(m: Column, fref: float = A4) -> Column:
    return F.pow(F.lit(2.0), (m - 69) / 12) * fref


def wrap_to_pi(p: Column) -> Column:
    """The angle in [-pi, pi)."""
    turn = 2 * math.pi
    shifted = p + math.pi
    return shifted - F.floor(shifted / turn) * turn - math.pi


def decibel(power_ratio: Column) -> Column:
    return F.log10(power_ratio) * 20
