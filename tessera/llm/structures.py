"""Tokens of a molecule's geometry, and the exact test of whether two molecules are alike (NumPy, for use in tasks)."""

from __future__ import annotations

import itertools
import math

import numpy as np

#: Two molecules are alike if 2 m / (n_a + n_b) reaches SHARE, with distances equal to within TOLERANCE (Angstrom).
SHARE, TOLERANCE = 0.75, 0.15
#: Width of the distance bins in tokens, and in tokens of two atoms; both come in two offsets.
BIN, PAIR_BIN = 0.2, 2 * TOLERANCE
#: Atoms of a token, and of the subsets it grows from.
ATOMS, ANCHOR = 5, 4
#: Subsets to grow from, and tokens, that a molecule is meant to keep of each offset.
ANCHORS, TOKENS = 32, 60
#: Up to so many atoms, tokens of pairs are added; up to TINY there are no others.
PAIRS, TINY = 10, 6
MARKS = 6

_MIX = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.arange(1, MARKS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
_ALL = (1 << 64) - 1


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _limit(wanted: float, of: int) -> np.uint64:
    """The hash below which a share of wanted / of all hashes lies; a molecule with more subsets keeps a part of what one with
    fewer keeps, so two molecules agree on the subsets that both have."""
    return np.uint64(_ALL if wanted >= of else int(_ALL * (wanted / of)))


def _distances(pos: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((pos[..., :, None, :] - pos[..., None, :, :]) ** 2).sum(-1), 0.0))


def _pair_hashes(element: np.ndarray, dist: np.ndarray, width: float, offset: int) -> np.ndarray:
    """(molecules, n, n) hashes of two elements and their binned distance; 0 on the diagonal."""
    low = np.minimum(element[:, :, None], element[:, None, :]).astype(np.uint64)
    high = np.maximum(element[:, :, None], element[:, None, :]).astype(np.uint64)
    step = np.minimum(np.floor(dist / width + offset / 2), 65535).astype(np.uint64)
    hashes = _mix((((low << np.uint64(7)) + high << np.uint64(16)) + step << np.uint64(1)) * _MIX + np.uint64(offset + 1))
    n = element.shape[1]
    hashes[:, np.arange(n), np.arange(n)] = 0
    return hashes


_SUBSETS: dict[tuple[int, int], np.ndarray] = {}


def _subsets(n: int, size: int) -> np.ndarray:
    if (n, size) not in _SUBSETS:
        _SUBSETS[n, size] = np.array(list(itertools.combinations(range(n), size)), np.int64).reshape(-1, size)
    return _SUBSETS[n, size]


def _grown(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(molecule, token) of the kept subsets of ATOMS atoms.

    A subset's hash is the mixed sum of its pairs' hashes, so the order of atoms, rotation, reflection and translation do
    not change it. Subsets of ANCHOR atoms below a limit are kept, grown by every other atom, and thinned again.
    """
    n = hashes.shape[1]
    base = _subsets(n, ANCHOR)
    total = np.zeros((len(hashes), len(base)), np.uint64)
    for a, b in itertools.combinations(range(ANCHOR), 2):
        total += hashes[:, base[:, a], base[:, b]]
    mol, at = np.nonzero(_mix(total) <= _limit(ANCHORS, len(base)))
    total, atoms = total[mol, at], base[at]
    inside = np.zeros((len(mol), n), bool)
    np.put_along_axis(inside, atoms, True, 1)
    kept = min(ANCHORS, len(base))
    for size in range(ANCHOR, ATOMS):
        grown = total[:, None] + _to_members(hashes, mol, atoms)
        keep = ~inside & (_mix(grown) <= _limit(TOKENS, kept * (n - size)))
        row, atom = np.nonzero(keep)
        # one subset is reached from several smaller ones
        total, mol = grown[row, atom], mol[row]
        _, first = np.unique(np.stack([mol.astype(np.uint64), total]), axis=1, return_index=True)
        mol, total, row, atom = mol[first], total[first], row[first], atom[first]
        atoms = np.concatenate([atoms[row], atom[:, None]], 1)
        inside = inside[row]
        inside[np.arange(len(row)), atom] = True
        kept = min(TOKENS, kept * (n - size))
    return mol, _mix(total + np.uint64(ATOMS))


def _to_members(hashes: np.ndarray, mol: np.ndarray, atoms: np.ndarray) -> np.ndarray:
    """For each subset and atom, the sum of the atom's pair hashes with the subset's members."""
    out = hashes[mol, atoms[:, 0]]
    for k in range(1, atoms.shape[1]):
        out = out + hashes[mol, atoms[:, k]]
    return out


def _small_tokens(element: np.ndarray, dist: np.ndarray) -> np.ndarray:
    """Tokens of one small molecule: its atom if it is one, else all pairs of atoms in both offsets (wide bins)."""
    n = len(element)
    if n == 1:
        return _mix(element.astype(np.uint64) + np.uint64(11))
    size = min(2, n)
    sets = _subsets(n, size)
    out = []
    for offset in (0, 1):
        hashes = _pair_hashes(element[None], dist[None], PAIR_BIN, offset)[0]
        total = np.zeros(len(sets), np.uint64)
        for a, b in itertools.combinations(range(size), 2):
            total += hashes[sets[:, a], sets[:, b]]
        out.append(_mix(total + np.uint64(100 + size)))
    return np.concatenate(out)


def tokens(elements: list[np.ndarray], positions: list[np.ndarray]) -> list[np.ndarray]:
    """The distinct tokens of each molecule; molecules with equally many atoms are treated together.

    All atoms take part alike. A token is a subset of ATOMS atoms, told by elements and binned distances, in two
    offsets of the bins; of a molecule's subsets a hashed part is kept, the same in every molecule that has the subset.
    """
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(elements)
    makes: dict[int, list[int]] = {}
    for k, e in enumerate(elements):
        makes.setdefault(len(e), []).append(k)
    for n, members in makes.items():
        step = max(1, 400_000 // max(1, math.comb(n, ANCHOR)))
        for start in range(0, len(members), step):
            part = members[start : start + step]
            e = np.stack([elements[k] for k in part])
            dist = _distances(np.stack([positions[k] for k in part]))
            parts: list[list[np.ndarray]] = [[] for _ in part]
            for offset in (0, 1) if n > TINY else ():
                mol, token = _grown(_pair_hashes(e, dist, BIN, offset))
                cuts = np.searchsorted(mol, np.arange(1, len(part)))
                for m, found in enumerate(np.split(token, cuts)):
                    parts[m].append(found)
            for m, k in enumerate(part):
                if n <= PAIRS:
                    parts[m].append(_small_tokens(e[m], dist[m]))
                out[k] = np.unique(np.concatenate(parts[m])) if parts[m] else out[k]
    return out


def pair_keys(some: np.ndarray, all_: np.ndarray) -> np.ndarray:
    """A key of each two different tokens of which the first is one of some, in either order the same; each once."""
    a, b = (x.ravel() for x in np.meshgrid(some, all_, indexing="ij"))
    a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
    return np.unique(_mix(a * _MIX + _mix(b + np.uint64(13))))


def marks(own: np.ndarray) -> np.ndarray:
    """MARKS min-hashes of a token set."""
    h = own[None, :] * _MIX + _SEEDS[:, None]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return own[np.argmin(h ^ (h >> np.uint64(29)), 1)] ^ _SEEDS


def wanted_overlap(n_atoms: int) -> int:
    """Tokens that a molecule must share with another for the pair to be tested.

    Alike molecules share at least a quarter of their subsets of five, some fifteen of the kept tokens in each offset, less
    those with a distance beside a bin's edge.
    """
    return 1 if n_atoms <= PAIRS else 2


# the exact test


def alike(e_a: np.ndarray, d_a: np.ndarray, e_b: np.ndarray, d_b: np.ndarray) -> bool:
    """Whether enough atoms can be paired one to one, elements equal and all distances among them equal to within TOLERANCE.

    Pairs of atoms are nodes, compatible pairs are joined; a matching is a clique. Nodes with too few compatible atoms are
    dropped until none is left to drop, then cliques of the wanted size are searched exactly, branch and bound.
    """
    n_a, n_b = len(e_a), len(e_b)
    need = math.ceil(SHARE * (n_a + n_b) / 2 - 1e-9)
    if need == 0 or min(n_a, n_b) < need:
        return False
    same = e_a[:, None] == e_b[None, :]
    i, j = np.nonzero(same)
    if same.any(1).sum() < need or same.any(0).sum() < need:
        return False
    fits = np.abs(d_a[np.ix_(i, i)] - d_b[np.ix_(j, j)]) <= TOLERANCE + 1e-7
    fits &= (i[:, None] != i[None, :]) & (j[:, None] != j[None, :])
    while True:
        rows = np.zeros((len(i), n_a), np.float32)
        columns = np.zeros((len(i), n_b), np.float32)
        rows[np.arange(len(i)), i] = 1
        columns[np.arange(len(i)), j] = 1
        joined = fits.astype(np.float32)
        reach = np.minimum((joined @ rows > 0).sum(1), (joined @ columns > 0).sum(1))
        keep = reach >= need - 1
        if keep.all():
            break
        i, j, fits = i[keep], j[keep], fits[np.ix_(keep, keep)]
        if len(set(i.tolist())) < need or len(set(j.tolist())) < need:
            return False
    return _has_clique(i, j, fits, need)


def _has_clique(i: np.ndarray, j: np.ndarray, fits: np.ndarray, need: int) -> bool:
    packed = np.packbits(fits, axis=1, bitorder="little")
    joined = [int.from_bytes(row.tobytes(), "little") for row in packed]
    rows: dict[int, int] = {}
    for node, atom in enumerate(i.tolist()):
        rows[atom] = rows.get(atom, 0) | 1 << node

    def search(open_: int, missing: int, left: list[int]) -> bool:
        if missing == 0:
            return True
        live = [row for row in left if row & open_]
        if len(live) < missing:
            return False
        live.sort(key=lambda row: (row & open_).bit_count())
        # either the atom with the fewest partners is matched, or it is not
        first, rest = live[0], live[1:]
        choices = first & open_
        while choices:
            bit = choices & -choices
            if search(open_ & joined[bit.bit_length() - 1], missing - 1, rest):
                return True
            choices ^= bit
        return search(open_ & ~first, missing, rest)

    return search((1 << len(joined)) - 1, need, list(rows.values()))
