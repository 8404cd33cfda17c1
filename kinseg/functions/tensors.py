"""Copy-number model: prior, gametes, inheritance, joint transitions of a trio.

States are copy numbers 0 to 4; a joint state is 25 father + 5 mother + offspring.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

N = 5
#: State prior, haplotype imbalance, and the error rate of transmission tables.
PRIOR = (1e-4, 1e-4, 9.6e-4, 1e-4, 1e-4)
A, B = 0.0009, 0.0009
#: How a parent with copies (before, after) at two neighbouring windows
#: carries them on two haplotypes, "a1a2 b1b2", with a weight; b is the rare share.
HAPLOTYPES = {
    (0, 0): (("00 00", "1"),),
    (0, 1): (("00 01", "1"),),
    (0, 2): (("00 02", "b"), ("01 01", "1-b")),
    (0, 3): (("00 03", "b"), ("01 02", "1-b")),
    (0, 4): (("01 03", ".5"), ("02 02", ".5")),
    (1, 1): (("00 11", "1"),),
    (1, 2): (("00 12", "b"), ("01 11", "1-b")),
    (1, 3): (("00 13", "b"), ("02 11", "1-b")),
    (1, 4): (("03 11", ".5"), ("02 12", ".5")),
    (2, 2): (("11 11", "1-b"), ("00 22", "b")),
    (2, 3): (("11 12", "1-b"), ("00 23", "b")),
    (2, 4): (("11 13", ".5-b/2"), ("12 12", ".5-b/2"), ("02 22", "b")),
    (3, 3): (("00 33", "b"), ("11 22", "1-b")),
    (3, 4): (("11 23", ".5"), ("12 22", ".5")),
    (4, 4): (("22 22", ".5"), ("11 33", ".5")),
}


def gametes(copies: int, a: float = A) -> np.ndarray:
    """Probability that a parent hands on 0..4 copies: mostly from the balanced pair of haplotypes, with share a from the lopsided one."""
    pairs = {0: [(0, 0, 1.0)], 1: [(0, 1, 1.0)], 2: [(1, 1, 1 - a), (0, 2, a)], 3: [(1, 2, 1 - a), (0, 3, a)], 4: [(1, 3, 0.5), (2, 2, 0.5)]}
    out = np.zeros(N)
    for one, two, weight in pairs[copies]:
        out[one] += weight / 2
        out[two] += weight / 2
    return out


def mendelian(a: float = A) -> np.ndarray:
    """[father, mother, offspring]: offspring copies from two gametes, capped at 4."""
    out = np.zeros((N, N, N))
    for f in range(N):
        for m in range(N):
            for i, p in enumerate(gametes(f, a)):
                for j, q in enumerate(gametes(m, a)):
                    out[f, m, min(4, i + j)] += p * q
    return out


def inheritance(error: float = 1e-4, a: float = A) -> np.ndarray:
    """mendelian() with an error rate, shared by the outcomes that vanish as a goes to 0.

    A third is written .333 for impossible outcomes and .3333 for those of order a (fixed values).
    """
    base, limit = mendelian(a), mendelian(0.0)
    out = base * (1 - error)
    for f in range(N):
        for m in range(N):
            rare = limit[f, m] == 0
            n = int(rare.sum())
            for o in np.flatnonzero(rare):
                out[f, m, o] += error * ((0.333 if base[f, m, o] == 0 else 0.3333) if n == 3 else 1 / n)
    return out


def possible(a: float = A) -> np.ndarray:
    """[father, mother, offspring]: whether inheritance can explain the copies."""
    return mendelian(a) > 0


def stay_or_move(p: float) -> np.ndarray:
    """One sample's transitions between copy numbers."""
    return np.full((N, N), p) + np.eye(N) * (1 - 5 * p)


def transmission(b: float = B) -> np.ndarray:
    """[f1, f2, m1, m2, o1, o2]: offspring copies at two windows from one haplotype of each parent."""
    weight = {"1": 1.0, "b": b, "1-b": 1 - b, ".5": 0.5, ".5-b/2": 0.5 - b / 2}
    rows = []
    for (before, after), splits in HAPLOTYPES.items():
        for text, w in splits:
            one, two = (tuple(map(int, h)) for h in text.split())
            rows.append((before, after, one, two, weight[w]))
            if before != after:
                rows.append((after, before, one[::-1], two[::-1], weight[w]))
    out = np.zeros((N,) * 6)
    for f1, f2, *fh, fw in rows:
        for m1, m2, *mh, mw in rows:
            for x in fh:
                for y in mh:
                    out[f1, f2, m1, m2, min(4, x[0] + y[0]), min(4, x[1] + y[1])] += fw * mw / 4
    return out


@lru_cache(maxsize=8)
def joint_transition(p: float = 1e-5, a: float = A, b: float = B) -> np.ndarray:
    """125 x 125 log transitions, not normalised.

    Where inheritance explains both windows and some haplotypes do, the parents
    move and transmit; otherwise all three move alone, or (both windows explained
    differently) the parents move and each window is inherited by itself.
    """
    move, hand, ok, table = stay_or_move(p), transmission(b), possible(a), inheritance(1e-4, a)
    # Axes: f1 m1 o1 f2 m2 o2.
    hand = hand.transpose(0, 2, 4, 1, 3, 5)
    parents = move[:, None, None, :, None, None] * move[None, :, None, None, :, None]
    alone = parents * move[None, None, :, None, None, :]
    before, after = ok[..., None, None, None], ok[None, None, None]
    split = parents * table[..., None, None, None] * table[None, None, None]
    both = before & after & (hand != 0)
    none = (~before & ~after) | (hand == 0)
    with np.errstate(divide="ignore"):
        out = np.log(np.where(both, parents * hand, np.where(none, alone, split)))
    return out.reshape(125, 125)


@lru_cache(maxsize=8)
def start_scores(error: float = 1e-4, a: float = A) -> np.ndarray:
    """125 log scores of the first window: priors of the three samples and inheritance."""
    prior = np.log(PRIOR)
    joint = prior[:, None, None] + prior[None, :, None] + prior[None, None, :] + np.log(inheritance(error, a))
    return joint.reshape(125)


def viterbi(emission: np.ndarray, transition: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Best joint state per window from (windows, 125) log emissions; ties go to the smaller state."""
    steps = len(emission)
    back = np.zeros((steps, 125), np.uint8)
    score = start + emission[0]
    for t in range(1, steps):
        reach = score[:, None] + transition
        back[t] = reach.argmax(axis=0)
        score = reach[back[t], np.arange(125)] + emission[t]
    path = np.empty(steps, np.int64)
    path[-1] = int(score.argmax())
    for t in range(steps - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path
