"""Surroundings of the atoms of many molecules at once, as sums over a table of atom pairs (NumPy, used inside Arrow batches).

A batch is flat: z (atoms,), r (atoms, 3) and the first atom of each molecule. All ordered pairs of atoms of one molecule
make one table, sorted by the first atom; neighbour counts, radial sums and potentials are group-bys of that table. Linear
systems and walks along bonds are stacked over molecules with equally many atoms.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from tessera.functions.arrays import BOHR, BOND_SCALE, DEBYE
from tessera.operators import molecule_kernels as k

#: Molecules that one pair table holds (about 300 pairs each).
CHUNK = 400


@dataclass
class Pairs:
    """Ordered pairs (i, j) of different atoms of one molecule, sorted by i."""

    i: np.ndarray
    j: np.ndarray
    d: np.ndarray
    unit: np.ndarray

    def only(self, mask: np.ndarray) -> Pairs:
        return Pairs(self.i[mask], self.j[mask], self.d[mask], self.unit[mask])


def pair_table(r: np.ndarray, first: np.ndarray) -> Pairs:
    size = np.diff(first)
    squares = size * size
    mol = np.repeat(np.arange(len(size)), squares)
    at = np.arange(len(mol)) - np.repeat(np.cumsum(squares) - squares, squares)
    i, j = at // np.maximum(size[mol], 1) + first[mol], at % np.maximum(size[mol], 1) + first[mol]
    i, j = i[i != j], j[i != j]
    away = r[j] - r[i]
    d = np.sqrt((away * away).sum(1))
    return Pairs(i, j, d, away / np.where(d > 0, d, 1.0)[:, None])


def tally(at: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Sums of weights (or counts) at each of n places; 2-D weights column by column."""
    if weights is not None and weights.ndim == 2:
        return np.stack([np.bincount(at, weights[:, c], n) for c in range(weights.shape[1])], 1)
    return np.bincount(at, weights, n).astype(float)


def stacks(first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(molecules, their atoms as a matrix) for each number of atoms."""
    size = np.diff(first)
    for n in np.unique(size[size > 0]):
        mols = np.flatnonzero(size == n)
        yield mols, first[mols][:, None] + np.arange(n)


def _walks(first: np.ndarray, bond: Pairs, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Atoms by element that are exactly two and exactly three bonds away."""
    two, three = np.zeros((len(e), 5)), np.zeros((len(e), 5))
    start = np.repeat(first[:-1], np.diff(first))
    mol = np.repeat(np.arange(len(first) - 1), np.diff(first))
    of_bond = mol[bond.i]
    by_mol = np.searchsorted(of_bond, np.arange(len(first)))
    for mols, atoms in stacks(first):
        n = atoms.shape[1]
        rows = np.concatenate([np.arange(by_mol[m], by_mol[m + 1]) for m in mols])
        slot = np.searchsorted(mols, of_bond[rows])
        joined = np.zeros((len(mols), n, n), np.float32)
        joined[slot, bond.i[rows] - start[bond.i[rows]], bond.j[rows] - start[bond.j[rows]]] = 1
        near = (joined > 0) | np.eye(n, dtype=bool)
        second = (joined @ joined > 0) & ~near
        third = (second.astype(np.float32) @ joined > 0) & ~near & ~second
        kind = np.eye(5, dtype=np.float32)[e[atoms]]
        two[atoms.ravel()] = (second.astype(np.float32) @ kind).reshape(-1, 5)
        three[atoms.ravel()] = (third.astype(np.float32) @ kind).reshape(-1, 5)
    return two, three


def _rings(z: np.ndarray, first: np.ndarray, bond: Pairs) -> np.ndarray:
    """Smallest ring of heavy atoms through each atom; only molecules with at least as many heavy bonds as heavy atoms are searched."""
    out = np.zeros(len(z), int)
    mol = np.repeat(np.arange(len(first) - 1), np.diff(first))
    heavy = z > 1
    inside = heavy[bond.i] & heavy[bond.j] & (bond.i < bond.j)
    n_bonds = np.bincount(mol[bond.i[inside]], minlength=len(first) - 1)
    # a molecule in several parts may close a ring with fewer bonds than atoms, three bonds being the least
    for m in np.flatnonzero(n_bonds >= 3):
        lo, hi = first[m], first[m + 1]
        a, b = np.searchsorted(bond.i, [lo, hi])
        joined = np.zeros((hi - lo, hi - lo), bool)
        joined[bond.i[a:b] - lo, bond.j[a:b] - lo] = True
        if k.ring_count(joined):
            out[lo:hi] = k.smallest_rings(joined, heavy[lo:hi])
    return out


def _corners(r: np.ndarray, bond: Pairs, degree: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(height over the plane of three neighbours, mean cosine, smallest cosine) of each atom's bonds, 0 where there is none."""
    n = len(r)
    height, mean, least = np.zeros(n), np.zeros(n), np.zeros(n)
    begin = np.cumsum(degree) - degree
    for arms in np.unique(degree[degree > 1]):
        atoms = np.flatnonzero(degree == arms)
        rows = begin[atoms][:, None] + np.arange(arms)
        unit = bond.unit[rows]
        a, b = np.triu_indices(arms, 1)
        cosine = (unit[:, a] * unit[:, b]).sum(-1)
        mean[atoms], least[atoms] = cosine.mean(1), cosine.min(1)
        if arms == 3:
            corner = r[bond.j[rows]]
            volume = np.abs(np.linalg.det(corner - r[atoms][:, None]))  # of the spat of the three arms
            area = np.linalg.norm(np.cross(corner[:, 1] - corner[:, 0], corner[:, 2] - corner[:, 0]), axis=1)
            height[atoms] = np.where(area > 1e-12, volume / np.maximum(area, 1e-12), 0.0)
    return height, mean, least


def _electrostatics(e: np.ndarray, r: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(equilibrated charges, potential of the other atoms' charges), solved for all molecules of one size together."""
    q, potential = np.zeros(len(e)), np.zeros(len(e))
    for _, atoms in stacks(first):
        n = atoms.shape[1]
        if n == 1:
            continue
        at = r[atoms]
        shield = k.COULOMB / 2 / k.QEQ_J[e[atoms]]
        square = ((at[:, :, None] - at[:, None]) ** 2).sum(-1)
        law = k.COULOMB / np.sqrt(square + (shield[:, :, None] + shield[:, None]) ** 2)
        pulls = np.stack([k.QEQ_CHI[e[atoms]], np.ones(atoms.shape)], -1)
        answer = np.linalg.solve(law, pulls)
        level = answer.sum(1)
        charge = (level[:, :1] / level[:, 1:]) * answer[..., 1] - answer[..., 0]
        law[:, np.arange(n), np.arange(n)] = 0
        q[atoms.ravel()] = charge.ravel()
        potential[atoms.ravel()] = (law @ charge[..., None]).ravel()
    return q, potential


@dataclass
class Surroundings:
    """Values by atom (element, x, q), by molecule (groups, qeq, rdf) and by directed bond."""

    element: np.ndarray
    x: np.ndarray
    q: np.ndarray
    groups: np.ndarray
    qeq: np.ndarray
    rdf: np.ndarray
    bond: Pairs


def surroundings(z: np.ndarray, r: np.ndarray, first: np.ndarray) -> Surroundings:
    """ATOM_FEATURES of every atom and the blocks GROUPS, QEQ and RDF of every molecule of a flat batch."""
    z, r, first = np.asarray(z, int), np.asarray(r, float), np.asarray(first, int)
    n, m, e = len(z), len(first) - 1, k.places(z)
    mol = np.repeat(np.arange(m), np.diff(first))
    pair = pair_table(r, first)
    radius = k._RADIUS[e]
    bond = pair.only(pair.d < BOND_SCALE * (radius[pair.i] + radius[pair.j]))
    degree = np.bincount(bond.i, minlength=n)
    columns: dict[str, np.ndarray] = {f"is_{s}": e == a for a, s in enumerate(k.SYMBOLS)}
    columns["degree"] = degree
    beside = tally(bond.i * 5 + e[bond.j], 5 * n).reshape(n, 5)
    two, three = _walks(first, bond, e)
    for name, block in (("bonded", beside), ("shell2", two), ("shell3", three)):
        columns |= {f"{name}_{s}": block[:, a] for a, s in enumerate(k.SYMBOLS)}
    small, large = np.minimum(z[bond.i], z[bond.j]), np.maximum(z[bond.i], z[bond.j])
    for name, (a, b), low, high in k.BOND_ORDERS:
        columns[f"bond_{name}"] = tally(bond.i[(small == a) & (large == b) & (bond.d >= low) & (bond.d < high)], n)
    ring = _rings(z, first, bond)
    height, mean, least = _corners(r, bond, degree)
    pull = k._CHI[e[bond.j]] - k._CHI[e[bond.i]]
    columns |= {"smallest_ring": ring, "pyramid_height": height, "angle_cos_mean": mean, "angle_cos_min": least}
    columns["bond_vector_asymmetry"] = np.sqrt((tally(bond.i, n, bond.unit) ** 2).sum(1))
    columns["local_bond_dipole"] = np.sqrt((tally(bond.i, n, pull[:, None] * bond.unit) ** 2).sum(1))

    near = pair.only(pair.d < k.CUTOFF)
    fade = (1 + np.cos(near.d * (np.pi / k.CUTOFF))) / 2
    cell, kinds = near.i * 5 + e[near.j], mol[near.i] * 25 + e[near.i] * 5 + e[near.j]
    rdf = np.zeros((m, 25, len(k.RADIAL_CENTRES)))
    for c, centre in enumerate(k.RADIAL_CENTRES):
        weight = fade * np.exp(-0.5 * ((near.d - centre) / k.RADIAL_WIDTH) ** 2)
        sums = tally(cell, 5 * n, weight).reshape(n, 5)
        columns |= {f"radial_{s}_{centre:.2f}": sums[:, a] for a, s in enumerate(k.SYMBOLS)}
        rdf[:, :, c] = tally(kinds, 25 * m, weight).reshape(m, 25)
    for centre in k.MOMENT_CENTRES:
        weight = fade * np.exp(-0.5 * ((near.d - centre) / k.MOMENT_WIDTH) ** 2)
        size = np.sqrt((tally(cell, 5 * n, weight[:, None] * near.unit) ** 2).sum(1)).reshape(n, 5)
        columns |= {f"moment_{s}_{centre:.2f}": size[:, a] for a, s in enumerate(k.SYMBOLS)}

    q, potential = _electrostatics(e, r, first)
    columns |= {"qeq_charge": q, "qeq_potential": potential}
    columns["nuclear_potential"] = tally(pair.i, n, np.divide(z[pair.j], pair.d, out=np.zeros(len(pair.d)), where=pair.d > 0))
    ends = tally(bond.i[(z[bond.j] == 8) & (degree[bond.j] == 1)], n)
    columns |= {"ammonium_N": (z == 7) & (degree == 4), "terminal_O_neighbours": ends}
    counts = np.maximum(np.diff(first), 1)[:, None]
    columns["centroid_distance"] = np.sqrt(((r - (tally(mol, m, r) / counts)[mol]) ** 2).sum(1))
    x = np.stack([np.asarray(columns[name], float) for name in k.ATOM_FEATURES], 1)

    dipole = np.sqrt((tally(mol, m, q[:, None] * r) ** 2).sum(1)) * DEBYE
    largest = np.zeros(m)
    np.maximum.at(largest, mol, np.abs(q))
    pairs = [a * 5 + b for a, b in k.PAIRS]
    return Surroundings(
        e, x, q, _groups(z, degree, ring, height, ends, mol, m), np.stack([dipole, largest, tally(mol, m, np.abs(q)) / 2], 1), rdf[:, pairs].reshape(m, -1), bond
    )


def _groups(z: np.ndarray, degree: np.ndarray, ring: np.ndarray, height: np.ndarray, ends: np.ndarray, mol: np.ndarray, m: int) -> np.ndarray:
    """Atoms of each named kind per molecule: a kind is a condition on atoms, its value how many atoms meet it."""
    kinds: dict[str, np.ndarray] = {f"atoms_{s}{d}": (z == number) & (degree == d) for s, number in (("C", 6), ("N", 7), ("O", 8)) for d in (1, 2, 3, 4)}
    kinds |= {f"ring{size}_atoms": ring == size for size in (3, 4, 5, 6)} | {"ring7plus_atoms": ring >= 7}
    kinds["n_ammonium"] = kinds["atoms_N4"]
    kinds["n_carboxylate"] = kinds["atoms_C3"] & (ends >= 2)
    kinds["n_nitro_like"] = (z == 7) & (ends >= 2)
    kinds["n_N3_planar"], kinds["n_N3_pyramidal"] = (kinds["atoms_N3"] & side for side in (height < k.PLANAR_N, height >= k.PLANAR_N))
    values = {name: np.bincount(mol[mask], minlength=m).astype(float) for name, mask in kinds.items()}
    values["zwitterion"] = np.minimum(values["n_ammonium"], 1) * np.minimum(values["n_carboxylate"], 1)
    return np.stack([values[name] for name in k.GROUPS], 1)


def one(z: np.ndarray, r: np.ndarray) -> Surroundings:
    return surroundings(z, r, np.array([0, len(z)]))


# descriptors of a flat batch, one row a molecule


def compositions(z: np.ndarray, r: np.ndarray, first: np.ndarray) -> np.ndarray:
    m = len(first) - 1
    mol = np.repeat(np.arange(m), np.diff(first))
    return tally(mol * 5 + k.places(z), 5 * m).reshape(m, 5)


def coulomb_spectra(z: np.ndarray, r: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Eigenvalues of Coulomb matrices by falling size (to 8 decimals, then by value), filled up with zeros."""
    out = np.zeros((len(first) - 1, max(k.MAX_ATOMS, int(np.diff(first).max(initial=0)))))
    for mols, atoms in stacks(first):
        n = atoms.shape[1]
        charge, at = np.asarray(z, float)[atoms], np.asarray(r, float)[atoms]
        d = np.sqrt(((at[:, :, None] - at[:, None]) ** 2).sum(-1)) * BOHR
        matrix = np.divide(charge[:, :, None] * charge[:, None], d, out=np.zeros_like(d), where=d > 0)
        matrix[:, np.arange(n), np.arange(n)] = 0.5 * charge**2.4
        values = np.linalg.eigvalsh(matrix)
        order = np.lexsort((-values, -np.abs(values).round(8)), axis=-1)
        out[mols, :n] = np.take_along_axis(values, order, 1)
    return out


def _whole(atoms_first: np.ndarray, z: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gyration values, largest distances, principal moments of inertia) of every molecule."""
    m = len(atoms_first) - 1
    shape, far, turn = np.zeros((m, 4)), np.zeros(m), np.zeros((m, 3))
    mass = k._MASS[k.places(z)]
    for mols, atoms in stacks(atoms_first):
        at, w = r[atoms], mass[atoms][..., None]
        x = at - at.mean(1, keepdims=True)
        spread = np.maximum(np.linalg.eigvalsh(np.swapaxes(x, 1, 2) @ x / atoms.shape[1])[:, ::-1], 0)
        shape[mols] = np.c_[np.sqrt((x * x).sum((1, 2)) / atoms.shape[1]), spread]
        far[mols] = np.sqrt(((at[:, :, None] - at[:, None]) ** 2).sum(-1)).max((1, 2))
        y = at - (w * at).sum(1, keepdims=True) / w.sum(1, keepdims=True)
        tensor = (w * y * y).sum((1, 2))[:, None, None] * np.eye(3) - np.swapaxes(w * y, 1, 2) @ y
        turn[mols] = np.maximum(np.linalg.eigvalsh(tensor), 0)
    return shape, far, turn


def _parts(first: np.ndarray, bond: Pairs) -> np.ndarray:
    """Connected parts of every molecule: each atom takes the smallest name among its neighbours until none changes."""
    name = np.arange(first[-1])
    while len(bond.i):
        seen = name.copy()
        np.minimum.at(seen, bond.i, name[bond.j])
        seen = np.minimum(seen, seen[seen])
        if (seen == name).all():
            break
        name = seen
    mol = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return np.bincount(mol[name == np.arange(len(name))], minlength=len(first) - 1)


def engineered_rows(z: np.ndarray, r: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The values of ENGINEERED of every molecule."""
    z, r, first = np.asarray(z, int), np.asarray(r, float), np.asarray(first, int)
    m, e = len(first) - 1, k.places(z)
    size = np.maximum(np.diff(first), 1)
    mol = np.repeat(np.arange(m), np.diff(first))
    shape, far, turn = _whole(first, z, r)
    pair = pair_table(r, first)
    radius = k._RADIUS[e]
    every = pair.only(pair.d < BOND_SCALE * (radius[pair.i] + radius[pair.j]))
    bond = every.only(every.i < every.j)
    of = mol[bond.i]
    pull = k._CHI[e[bond.j]] - k._CHI[e[bond.i]]
    centre = tally(mol, m, r) / size[:, None]
    hetero = np.isin(z, (7, 8, 9))
    some = np.bincount(mol[hetero], minlength=m)
    away = tally(mol[hetero], m, r[hetero]) / np.maximum(some, 1)[:, None] - centre
    chi = k._CHI[e]
    lean = chi - (tally(mol, m, chi) / size)[mol]
    length = lambda v: np.sqrt((v * v).sum(1))
    low, high = np.minimum(e[bond.i], e[bond.j]), np.maximum(e[bond.i], e[bond.j])
    kinds = tally(of * 25 + low * 5 + high, 25 * m).reshape(m, 25)[:, [a * 5 + b for a, b in k.PAIRS]]
    small, large = np.minimum(z[bond.i], z[bond.j]), np.maximum(z[bond.i], z[bond.j])
    orders = [tally(of[(small == a) & (large == b) & (bond.d >= lo) & (bond.d < hi)], m) for _, (a, b), lo, hi in k.BOND_ORDERS]
    rings = np.bincount(of, minlength=m) - np.diff(first) + _parts(first, every)
    return np.column_stack(
        [shape, far, np.where(some > 0, length(away), 0.0), tally(of, m, np.abs(pull)), length(tally(of, m, pull[:, None] * bond.unit)), length(tally(mol, m, lean[:, None] * r)), kinds, *orders, rings, turn]
    )


def _block(name: str):
    return lambda z, r, first: getattr(surroundings(z, r, first), name)


#: Descriptors by name for flat batches; coordinates have no better way than one by one.
BATCHED = {"composition": compositions, "cm_spectrum": coulomb_spectra, "engineered": engineered_rows, "groups": _block("groups"), "qeq": _block("qeq"), "rdf": _block("rdf")}


def described(name: str, mols: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """(molecules, values) of one descriptor, CHUNK molecules at a time."""
    if name not in BATCHED:
        return np.stack([k.DESCRIPTORS[name][0](*m) for m in mols])
    out = []
    for start in range(0, len(mols), CHUNK):
        part = mols[start : start + CHUNK]
        first = np.r_[0, np.cumsum([len(z) for z, _ in part])]
        out.append(BATCHED[name](np.concatenate([z for z, _ in part]), np.concatenate([r for _, r in part]), first))
    return np.concatenate(out)
