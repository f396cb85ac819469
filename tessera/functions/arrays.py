"""Array kernels of one record as Catalyst expressions: no Python, no shuffle, inside whole-stage plans where Spark allows.

Coordinates are flat arrays (x1, y1, z1, x2, ...) in Angstrom. Null arrays give null; empty arrays give the stated value.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pauling electronegativities, isotope masses (amu) and covalent radii (Angstrom) by atomic number.
ELECTRONEGATIVITY = {1: 2.20, 6: 2.55, 7: 3.04, 8: 3.44, 9: 3.98}
ISOTOPE_MASS = {1: 1.00782503, 6: 12.0, 7: 14.0030740, 8: 15.9949146, 9: 18.9984032}
COVALENT_RADIUS = {1: 0.31, 6: 0.76, 7: 0.71, 8: 0.66, 9: 0.57}
# Bond criterion, e Angstrom in debye, GHz amu Angstrom^2, Angstrom in bohr.
BOND_SCALE, DEBYE, ROTATIONAL, BOHR = 1.15, 4.80320, 505.379009, 1.8897261


def bind(value: Column, body) -> Column:
    """body(value) with the value evaluated once per row, however often the body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def points(flat: Column) -> Column:
    """Flat coordinates as ARRAY<STRUCT<x, y, z>>; a rest of one or two numbers is left out, an empty array stays empty."""
    n = F.floor(F.size(flat) / 3).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    pick = lambda i, k: F.get(flat, i * 3 + k)
    return F.when(flat.isNotNull(), F.transform(at, lambda i: F.struct(pick(i, 0).alias("x"), pick(i, 1).alias("y"), pick(i, 2).alias("z"))))


def lookup(table: dict[int, float], z: Column) -> Column:
    """Tabulated value of an atomic number, null if it is not in the table."""
    case = F.when(F.lit(False), F.lit(0.0))
    for number, value in table.items():
        case = case.when(z == number, F.lit(value))
    return case


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def mean(values: Column) -> Column:
    return F.try_divide(total(values), F.size(values))


def norm(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def weighted_norm(weights: Column, flat: Column) -> Column:
    """|sum of w_i R_i|."""
    pairs = F.zip_with(weights, points(flat), lambda w, p: F.struct(w.alias("w"), p.alias("p")))
    return bind(pairs, lambda e: norm(*[total(F.transform(e, _component(k))) for k in "xyz"]))


def _component(axis: str):
    return lambda e: e["w"] * e["p"][axis]


def _axis(axis: str):
    return lambda p: p[axis]


def centroid_offset(flat: Column) -> Column:
    """Distance of the mean position from the origin."""
    return norm(*[mean(F.transform(points(flat), _axis(k))) for k in "xyz"])


def radius_of_gyration(flat: Column) -> Column:
    p = points(flat)
    squares = []
    for k in "xyz":
        v = F.transform(p, _axis(k))
        squares.append(mean(F.transform(v, lambda a: a * a)) - mean(v) * mean(v))
    return F.when(flat.isNotNull(), F.sqrt(F.greatest(squares[0] + squares[1] + squares[2], F.lit(0.0))))


def point_charge_dipole(q: Column, flat: Column) -> Column:
    """|sum of q_i R_i| in debye."""
    return weighted_norm(q, flat) * DEBYE


def charge_features(q: Column, flat: Column) -> dict[str, Column]:
    size = F.transform(q, lambda v: F.abs(v))
    return {"charge_dipole_d": point_charge_dipole(q, flat), "max_abs_charge": F.array_max(size), "charge_separation": total(size) / 2}


def electronegativity_dipole(z: Column, flat: Column) -> Column:
    """|sum of (chi_i - mean chi) R_i|."""
    chi = F.transform(z, lambda v: lookup(ELECTRONEGATIVITY, v))
    charges = bind(F.struct(chi.alias("c"), mean(chi).alias("m")), lambda s: F.transform(s["c"], lambda v: v - s["m"]))
    return weighted_norm(charges, flat)


def heteroatom_offset(z: Column, flat: Column) -> Column:
    """Distance of the centroid of N, O and F from the centroid; 0 without them."""
    both = F.zip_with(z, points(flat), lambda a, p: F.struct(a.alias("a"), p.alias("p")))
    hetero = F.transform(F.filter(both, lambda e: e["a"].isin(7, 8, 9)), lambda e: e["p"])
    gaps = [mean(F.transform(hetero, _axis(k))) - mean(F.transform(points(flat), _axis(k))) for k in "xyz"]
    return F.when(F.size(hetero) == 0, 0.0).otherwise(norm(*gaps))


def frequency_features(freqs: Column) -> dict[str, Column]:
    return {
        "freq_lowest": F.array_min(freqs),
        "freq_highest": F.array_max(freqs),
        "freq_mean": mean(freqs),
        "n_modes_above_2800": F.size(F.filter(freqs, lambda v: v > 2800)),
        "n_modes_below_500": F.size(F.filter(freqs, lambda v: v < 500)),
    }


def vibrational_modes(n: Column, linear: Column) -> Column:
    return F.when(linear, 3 * n - 5).otherwise(3 * n - 6)


def clean_frequencies(freqs: Column, n: Column) -> Column:
    """The first half of a list that has exactly twice the expected length (3n - 6 tested before 3n - 5), else the list."""
    size = F.size(freqs)
    return (
        F.when(size == 2 * (3 * n - 6), F.slice(freqs, 1, F.greatest(3 * n - 6, F.lit(0))))
        .when(size == 2 * (3 * n - 5), F.slice(freqs, 1, F.greatest(3 * n - 5, F.lit(0))))
        .otherwise(freqs)
    )


def is_linear(freqs: Column, n: Column) -> Column:
    return F.size(freqs) == 3 * n - 5


def moment_of_constant(constant: Column) -> Column:
    """Moment of inertia (amu Angstrom^2) of a rotational constant (GHz); 0 for 0, as linear molecules store it."""
    return F.when(constant > 0, F.lit(ROTATIONAL) / constant).otherwise(0.0)


def inertia_moments(z: Column, flat: Column) -> Column:
    """ARRAY of the three principal moments of inertia (amu Angstrom^2), rising: the roots of the tensor's cubic, in closed form."""
    atoms = F.zip_with(z, points(flat), lambda v, p: F.struct(lookup(ISOTOPE_MASS, v).alias("m"), p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z")))

    def of(a: Column) -> Column:
        def moment(*axes: str):
            def term(e: Column) -> Column:
                out = e["m"]
                for axis in axes:
                    out = out * e[axis]
                return out

            return total(F.transform(a, term))

        m = moment()
        first = {k: moment(k) for k in "xyz"}
        second = {j + k: moment(j, k) - F.try_divide(first[j] * first[k], m) for j, k in ("xx", "yy", "zz", "xy", "xz", "yz")}
        return F.struct(*[c.alias(n) for n, c in second.items()])

    def roots(s: Column) -> Column:
        a, b, c = s["yy"] + s["zz"], s["xx"] + s["zz"], s["xx"] + s["yy"]
        q = (a + b + c) / 3
        p = F.sqrt(((a - q) * (a - q) + (b - q) * (b - q) + (c - q) * (c - q) + 2 * (s["xy"] * s["xy"] + s["xz"] * s["xz"] + s["yz"] * s["yz"])) / 6)
        u, v, w = a - q, b - q, c - q
        det = u * (v * w - s["yz"] * s["yz"]) - s["xy"] * (s["xy"] * w + s["yz"] * s["xz"]) - s["xz"] * (s["xy"] * s["yz"] + v * s["xz"])
        r = F.greatest(F.least(F.try_divide(det, 2 * p * p * p), F.lit(1.0)), F.lit(-1.0))
        return F.when(p < 1e-12, F.array(q, q, q)).otherwise(bind(F.struct(q.alias("q"), p.alias("p"), (F.acos(r) / 3).alias("t")), lambda e: F.array_sort(F.transform(F.array(F.lit(0.0), F.lit(2 * math.pi / 3), F.lit(4 * math.pi / 3)), lambda turn: F.greatest(e["q"] + 2 * e["p"] * F.cos(e["t"] + turn), F.lit(0.0))))))

    return F.when(z.isNotNull() & flat.isNotNull(), bind(bind(atoms, of), roots))


def bonds(z: Column, flat: Column, scale: float = BOND_SCALE) -> Column:
    """ARRAY<STRUCT<i, j, d>> of pairs i < j (from 0) nearer than scale x (r_i + r_j); atoms without a radius never bond."""
    atoms = F.zip_with(z, points(flat), lambda v, p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z"), lookup(COVALENT_RADIUS, v).alias("r")))

    def pairs(a: Column) -> Column:
        n = F.size(a)

        def near(i: Column) -> Column:
            return bind(
                F.get(a, i),
                lambda p: F.filter(
                    F.transform(
                        F.slice(a, i + 2, n),
                        lambda q, k: F.struct(
                            i.alias("i"),
                            (i + 1 + k).alias("j"),
                            norm(p["x"] - q["x"], p["y"] - q["y"], p["z"] - q["z"]).alias("d"),
                            (scale * (p["r"] + q["r"])).alias("limit"),
                        ),
                    ),
                    lambda e: e["d"] < e["limit"],
                ),
            )

        first = F.when(n > 1, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>"))
        return F.transform(F.flatten(F.transform(first, near)), lambda e: F.struct(e["i"].alias("i"), e["j"].alias("j"), e["d"].alias("d")))

    return F.when(z.isNotNull() & flat.isNotNull(), bind(atoms, pairs))


def coulomb_matrix(z: Column, flat: Column) -> Column:
    """Rows of the Coulomb matrix: z^2.4 / 2 on the diagonal, z_i z_j / d (bohr) off it."""
    atoms = F.zip_with(z, points(flat), lambda v, p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z"), v.cast("double").alias("n")))

    def entry(p: Column, i: Column, q: Column, j: Column) -> Column:
        away = norm(p["x"] - q["x"], p["y"] - q["y"], p["z"] - q["z"]) * BOHR
        return F.when(i == j, 0.5 * F.pow(p["n"], F.lit(2.4))).otherwise(F.try_divide(p["n"] * q["n"], away))

    return bind(atoms, lambda a: F.transform(a, lambda p, i: F.transform(a, lambda q, j: entry(p, i, q, j))))


def padded_coordinates(flat: Column, atoms: int = 29) -> Column:
    """Raw coordinates filled up with zeros: the negative control of invariance tests."""
    return F.slice(F.concat(flat, F.array_repeat(F.lit(0.0), 3 * atoms)), 1, 3 * atoms)
