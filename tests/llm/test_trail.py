"""op9's prediction of tokens along a text against a plain walk, a token at a time."""

import math

import numpy as np
import pytest

from tickforge.llm import lm


def plain_walk(texts, known, model, literal, own):
    """log2 of each token, and (bit, states, outcome) of each time that a bit is asked."""
    out, asked = [], []
    for k, words in enumerate(texts):
        followed = [0] * (max(words) + 1)
        for p, w in zip(words, words[1:]):
            followed[p] += known.best[p] == known.hashes[w]
        seen, after, pair = {}, {}, {}
        history = [[] for _ in lm.BITS]  # (place, word before, outcome) of each time that the bit was asked
        refined = [[[0, 0] for _ in range(4)] for _ in lm.BITS]
        for t, w in enumerate(words):
            p = words[t - 1] if t else None
            a = pair.get((p, words[t - 2])) if t > 1 else None
            b = after.get(p) if t else None
            often = (known.often[p] - (followed[p] if own else 0)) if t else 0
            told = often > 0 and not any(c is not None and known.hashes[c[0]] == known.best[p] for c in (a, b))
            level = lambda c: min(4, int(math.log2(known.counts[c] + 1)) // 4)
            far = lambda s: 0 if t - s < 8 else 1 if t - s < 64 else 2
            x, share, found = 0.0, 1.0, False
            for j in range(4):
                if j == 0 and a is not None:
                    right, state = a[0] == w, level(a[0]) * 3 + far(a[1])
                elif j == 1 and b is not None and (a is None or b[0] != a[0]):
                    right, state = b[0] == w, level(b[0]) * 3 + far(b[1])
                elif j == 2 and told:
                    right, state = known.best[p] == known.hashes[w], (min(3, often) - 1) * 5 + min(4, int(math.log2(max(1, known.counts[p]) / often)) if known.counts[p] > often else 0)
                elif j == 3 and t:
                    right, state = w in seen, min(15, int(math.log2(t)))
                else:
                    continue
                h = history[j]
                last = sum(1 << (k_ - 1) for k_ in (1, 2, 3) if any(s == t - k_ and y for s, _, y in h))
                n, yes = sum(q == p for _, q, _ in h), sum(q == p and y for _, q, y in h)
                word = 0 if n == 0 else 1 + (min(n, 3) - 1) * 3 + (0 if yes == 0 else 2 if yes == n else 1)
                evidence = min(n, 3)
                n, yes = len(h), sum(y for _, _, y in h)
                whole = 0 if n == 0 else 1 + 7 * (n >= 8) + 6 * yes // n
                z = model.weights[j, evidence, 4] + sum(model.weights[j, evidence, c] * model.odds[j][c][s] for c, s in enumerate((last, word, state, whole)))
                r = refined[j][sum(z > e for e in lm.EDGES)]
                chance = (lm.KEEP / (1 + math.exp(-max(-9, min(9, z)))) + r[1]) / (lm.KEEP + r[0])
                if not found:  # where a bit before was right, this one isn't asked
                    asked.append((j, (last, word, state, whole), bool(right)))
                    h.append((t, p, bool(right)))
                    r[0] += 1
                    r[1] += bool(right)
                    x += share * chance * (right if j < 3 else seen.get(w, 0) / t)
                    share *= 1 - chance
                    found = right and j < 3
            if not found:
                x += share * 2.0 ** max(literal[k][t], -900)
            out.append(math.log2(x) + (0 if found else min(0, literal[k][t] + 900)))
            if t:
                after[p] = (w, t)
            if t > 1:
                pair[p, words[t - 2]] = (w, t)
            seen[w] = seen.get(w, 0) + 1
    return out, asked


@pytest.mark.parametrize("own", [False, True])
def test_trail_is_the_plain_walk(own):
    rng = np.random.default_rng(6)
    kinds = 12
    known = lm.Known(rng.integers(0, 1 << 32, kinds, dtype="u8").astype("u4"), rng.integers(0, 3000, kinds), None, rng.integers(0, 9, kinds))
    known.best = known.hashes[rng.integers(0, kinds, kinds)]
    model = lm.Chances([[rng.normal(0, 1, s) for s in lm.STATES] for _ in lm.BITS], rng.normal(0.3, 0.2, (4, lm.EVIDENCE, 5)))
    texts = [rng.choice(kinds, n, p=np.arange(1, kinds + 1) / (kinds * (kinds + 1) / 2)).tolist() for n in (1, 2, 3, 40, 300, 1)] + [[3] * 30, [1, 2] * 20]
    literal = [rng.uniform(-12, -2, len(x)) for x in texts]
    literal[3][5] = -1500.0
    want, asked = plain_walk(texts, known, model, literal, own)
    flat = np.concatenate(texts).astype("u4")
    begins = np.cumsum([0, *map(len, texts[:-1])])
    trail = lm.Trail(flat, begins, known, own)
    tally = np.zeros((2, 4, lm.CELLS), "i8")
    for j, states, right in asked:
        cell = ((states[0] * 10 + states[1]) * 16 + states[2]) * 16 + states[3]
        tally[0, j, cell] += 1
        tally[1, j, cell] += right
    for j in range(4):
        assert (trail.cells(j) == tally[:, j]).all()
    assert len({j for j, _, _ in asked}) == 4
    got = trail.log2(np.concatenate(literal), model)
    assert np.allclose(got, want, atol=1e-9)


def test_chances_learn_what_the_cells_say():
    rng = np.random.default_rng(2)
    total = np.zeros((2, 4, lm.CELLS), "i8")
    total[0] = rng.poisson(0.2, (4, lm.CELLS))
    word = np.unravel_index(np.arange(lm.CELLS), lm.STATES)[1]
    truth = 1 / (1 + np.exp(-(word - 5) / 2))
    total[1] = rng.binomial(total[0], truth)
    model = lm.learn_chances(total)
    z = sum(model.weights[0, 3, k] * model.odds[0][k][0 if k != 1 else 9] for k in range(4)) + model.weights[0, 3, 4]
    assert abs(1 / (1 + math.exp(-z)) - 1 / (1 + math.exp(-2))) < 0.1
