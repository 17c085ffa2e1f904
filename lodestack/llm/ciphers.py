"""Substitution ciphers learned by expectation-maximisation against letter bigrams.

The signs of a garbled source stand for letters nobody has written down.  What is
counted is how often two signs follow one another; what is hidden are the letters.
A sign pair (a, b) has the probability ``sum P(l, m) P(a | l) P(b | m)`` over the
letter pairs of the language; each round spreads the counts over the letters that
may be meant and counts anew which sign each letter is written with.  Signs that
are known (ASCII, a space at the ends of a run) are letters that write themselves.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np

Pairs = dict[tuple[str, str], int]
#: What the initial meaning of a sign is worth, in counts.
TRUST = 2.0
#: What a letter other than the suggested one has to gain on each half of the runs, in nats.
CHANGE_GAIN = 3.0
ROUNDS, BLIND_ROUNDS, STARTS = 12, 60, 24
#: A cipher without a page is believed if its held-out runs gain so much a sign, in nats.
BLIND_GAIN = 1.0


@dataclass
class Cipher:
    """``table``: letter by sign; ``changed``: signs whose letter isn't the one it began with."""

    table: dict[str, str]
    likelihood: float = 0.0
    changed: dict[str, str] = field(default_factory=dict)


def _joint(language, letters: list[str]) -> np.ndarray:
    """Joint probabilities of letter pairs; letters are looked up in the language's alphabet."""
    sym = language.sym[[ord(c) for c in letters]]
    return language.share[sym][:, None] * np.exp(language.table[np.ix_(sym, sym)].astype(float))


def decipher(pairs: Pairs, known: set[str], letters: list[str], language, init: dict[str, str] | None = None, trust: float = TRUST, rounds: int = ROUNDS, seed: int = 0) -> Cipher:
    """One run of expectation-maximisation; with ``init`` from there, else from a random start.

    ``known`` symbols write themselves; all other symbols of ``pairs`` are signs for
    one of ``letters``.
    """
    symbols = sorted({s for p in pairs for s in p})
    signs = [s for s in symbols if s not in known]
    fixed = [s for s in symbols if s in known]
    if not signs or not letters:
        return Cipher({})
    states = letters + fixed
    joint = _joint(language, states)
    at = {s: k for k, s in enumerate(signs + fixed)}
    count = np.zeros((len(at), len(at)))
    for (a, b), n in pairs.items():
        count[at[a], at[b]] += n
    write = np.zeros((len(at), len(states)))  # P(symbol | state)
    write[len(signs) :, len(letters) :] = np.eye(len(fixed))
    prior = np.full((len(signs), len(letters)), 0.01)
    place = {c: k for k, c in enumerate(letters)}
    if init is not None:
        for k, s in enumerate(signs):
            if init.get(s) in place:
                prior[k, place[init[s]]] += trust
        soft = prior / prior.sum(0, keepdims=True)
    else:
        rng = np.random.default_rng(seed)
        # frequent signs begin nearer to frequent letters, the rest is chance
        seen = count.sum(0)[: len(signs)] + count.sum(1)[: len(signs)]
        share = language.share[language.sym[[ord(c) for c in letters]]]
        near = np.exp(-np.abs(np.log(seen / seen.sum() + 1e-9)[:, None] - np.log(share / share.sum() + 1e-9)[None, :]))
        soft = near * rng.gamma(0.5, 1.0, near.shape) + 1e-6
        soft /= soft.sum(0, keepdims=True)
    write[: len(signs), : len(letters)] = soft
    likelihood = -np.inf
    for _ in range(rounds):
        both = write @ joint @ write.T
        likelihood = float((count * np.log(both + 1e-300)).sum())
        share = count / (both + 1e-300)
        spread = write * (share @ (write @ joint.T) + share.T @ (write @ joint))
        new = spread[: len(signs), : len(letters)] + prior
        write[: len(signs), : len(letters)] = new / new.sum(0, keepdims=True)
    weight = new / new.sum(1, keepdims=True)
    table = {s: letters[int(weight[k].argmax())] for k, s in enumerate(signs)}
    changed = {s: t for s, t in table.items() if init is not None and init.get(s) not in (None, t)}
    return Cipher(table, likelihood, changed)


def cost(pairs: Pairs, table: dict[str, str], language) -> float:
    """Log probability of the pairs as the table reads them."""
    total = 0.0
    for (a, b), n in pairs.items():
        x, y = table.get(a, a), table.get(b, b)
        if len(x) == len(y) == 1:
            total += n * float(language.table[language.sym[ord(x)], language.sym[ord(y)]])
    return total


def learn(halves: tuple[Pairs, Pairs], init: dict[str, str], known: set[str], letters: list[str], language) -> Cipher:
    """A source whose page suggests ``init``: re-estimated, sign by sign where the runs speak against it.

    Each half of the runs is deciphered by itself.  A sign gets another letter if
    both halves give it the same and both read better by ``CHANGE_GAIN`` with it;
    the rest stays as suggested, as a rare sign says little.
    """
    fits = [decipher(h, known, letters, language, init) for h in halves]
    table, changed = dict(init), {}
    for s in sorted(fits[0].changed.keys() & fits[1].changed.keys()):
        t = fits[0].changed[s]
        if fits[1].changed[s] != t:
            continue
        own = [{p: n for p, n in h.items() if s in p} for h in halves]
        if all(cost(h, table | {s: t}, language) - cost(h, table, language) >= CHANGE_GAIN for h in own):
            table[s] = changed[s] = t
    return Cipher(table, sum(f.likelihood for f in fits), changed)


def break_open(halves: tuple[Pairs, Pairs], known: set[str], alphabets: list[list[str]], language) -> Cipher | None:
    """A source no page explains: the best of many random starts over each alphabet.

    None unless the runs held out are read better by ``BLIND_GAIN`` a sign.
    """
    first, second = halves
    best: tuple[float, list[str], Cipher] | None = None
    for letters in alphabets:
        for seed in range(STARTS):
            found = decipher(first, known, letters, language, None, 0.0, BLIND_ROUNDS, seed)
            rated = cost(first, found.table, language)
            if found.table and (best is None or rated > best[0]):
                best = rated, letters, found
    if best is None:
        return None
    signs = sum(n * ((a not in known) + (b not in known)) / 2 for (a, b), n in second.items())
    gain = cost(second, best[2].table, language) - cost(second, {}, language)
    if not signs or gain < BLIND_GAIN * signs:
        return None
    everything = Counter(first)
    everything.update(second)
    whole = decipher(dict(everything), known, best[1], language, best[2].table, TRUST, ROUNDS)
    return Cipher(with_capitals(whole.table, dict(everything)), whole.likelihood)


def with_capitals(table: dict[str, str], pairs: Pairs) -> dict[str, str]:
    """Of several signs for one letter, those that mostly begin a word are its capitals."""
    begins: Counter[str] = Counter()
    seen: Counter[str] = Counter()
    for (a, b), n in pairs.items():
        seen[b] += n
        begins[b] += n * (not a.isalpha() and a not in table)
    of: dict[str, list[str]] = {}
    for s, t in table.items():
        of.setdefault(t, []).append(s)
    out = dict(table)
    for t, signs in of.items():
        if len(signs) > 1:
            for s in signs:
                if seen[s] and begins[s] >= 0.8 * seen[s]:
                    out[s] = t.upper()
    return out
