"""op9 against a plain version: features in simple Python, the risk over one matrix, its minimum by damped Newton steps."""

import re
import string
import zlib

import numpy as np

from tessera.llm import quality


def plain_features(text):
    raw = (text or "").encode()
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    n, k, m = len(raw), max(len(words), 1), max(len(lines), 1)
    of = lambda chars: sum(raw.count(c.encode()) for c in chars)
    upper, lower, digit, high = of(string.ascii_uppercase), of(string.ascii_lowercase), of(string.digits), sum(b >= 128 for b in raw)
    letters, odd, cry = max(upper + lower + high, 1), of("#$%&*+/<=>@\\^_`{|}~"), of("!?")
    triples = {tuple(words[i : i + 3]) for i in range(len(words) - 2)}
    longest = max((len(w) for w in words), default=0)
    return [
        np.log(1 + n), np.log(1 + len(words)), n / k, longest / (longest + 30), upper / letters, digit / max(n, 1), of(".,;:") / k, cry / k, odd / k, of("\"'()-[]") / k,
        high / max(n, 1), sum(b < 32 for b in raw) / k, len(set(words)) / k**0.9, len(triples) / max(len(words) - 2, 1), len(set(lines)) / m, np.log(1 + n / m), float(not words),
        (odd / k) ** 0.5, (cry / k) ** 0.5, (digit / max(n, 1)) ** 0.5,
    ]


def plain_weights(p, u, prior, ridge=2e-4):
    """The least of prior * (mean over p of -f) + mean over u of log(1 + e^f), its part beyond p never below 0; without a prior, of telling p from u."""
    sigmoid = lambda f: 1 / (1 + np.exp(-f))

    def look(w):
        f, g = u @ w, p @ w
        s, t = sigmoid(f), sigmoid(g)
        if prior is None:
            value = np.logaddexp(0, f).mean() + np.logaddexp(0, -g).mean()
            slope = u.T @ s / len(u) - p.T @ (1 - t) / len(p)
            curve = (u.T * (s * (1 - s))) @ u / len(u) + (p.T * (t * (1 - t))) @ p / len(p)
            rest = 0.0
        else:
            value, rest = np.logaddexp(0, f).mean() - prior * g.mean(), np.logaddexp(0, f).mean() - prior * np.logaddexp(0, g).mean()
            slope, curve = u.T @ s / len(u) - prior * p.mean(axis=0), (u.T * (s * (1 - s))) @ u / len(u)
        return value + ridge / 2 * w @ w, rest, slope + ridge * w, curve + ridge * np.eye(len(w))

    w = np.zeros(p.shape[1])
    w[0] = 0 if prior is None else np.log(prior / (1 - prior))
    for _ in range(200):
        value, _, slope, curve = look(w)
        step, length = np.linalg.solve(curve, slope), 1.0
        while length > 1e-4:
            new, rest, _, _ = look(w - length * step)
            if new <= value and rest >= 0:
                break
            length /= 2
        else:
            break
        w = w - length * step
        if value - new < 1e-10:
            break
    return w


def plain_scores(docs, positive):
    x = np.array([plain_features(t) for _, t in docs])
    mean, spread, rng = x.mean(axis=0), x.std(axis=0) + 1e-3, np.random.default_rng(3)
    turn, shift = rng.normal(size=(x.shape[1], 128)) / np.sqrt(x.shape[1]), rng.uniform(0, 2 * np.pi, 128)
    z = np.clip((x - mean) / spread, -6, 6)
    u = np.hstack([np.ones((len(z), 1)), z, np.cos(z @ turn + shift) * np.sqrt(2 / 128)])
    at = {i: n for n, (i, _) in enumerate(docs)}
    p = u[[at[i] for i in sorted(positive)]]
    held = rng.random(len(p)) < 1 / 3
    score = lambda w, rows: 1 / (1 + np.exp(-rows @ w))
    w = plain_weights(p[~held], u, None)
    bins = [np.minimum((score(w, rows) * 1000).astype(int), 999) for rows in (u, p[held])]
    above_u, above_p = (np.array([(b >= i).mean() for i in range(1000)]) for b in bins)
    room = 1.01 * sum(np.sqrt(np.log(40) / (2 * len(b))) for b in bins) / np.maximum(above_p, 1e-9)
    best = np.argmin(above_u / np.maximum(above_p, 1e-9) + room)
    prior = float(np.clip(above_u[best] / max(above_p[best], 1e-9), 0.02, 0.98))
    return score(plain_weights(p, u, prior), u), prior


def test_features_are_those_of_a_plain_reading():
    for text in (None, "", " \n\t", "One two, two three!\nOne two\n\n№1 é — \"q\" (x) #tag 12\x0b3", "a " * 500 + "b" * 90):
        assert np.allclose(quality.features(text), plain_features(text))


def test_query_matches_the_plain_version(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").orderBy("doc_id").collect()]
    labels = spark.read.parquet(f"{d}/labels.parquet").collect()
    learned = lambda i: zlib.crc32(str(i).encode()) % 5 != 0
    want, prior = plain_scores(docs, {r.doc_id for r in labels if r.quality == 1 and learned(r.doc_id)})
    got = {r.doc_id: r for r in quality.op9_quality(spark, d).collect()}
    assert 0.02 < prior < 0.98 and len(got) == len(docs) and re.fullmatch(r"0\.\d+", f"{prior:.3f}")
    apart = [abs(got[i].score - s) for (i, _), s in zip(docs, want)]
    assert np.mean(apart) < 0.01 and np.max(apart) < 0.08
    assert all(got[i].predicted == int(s >= 0.3) for (i, _), s in zip(docs, want) if abs(s - 0.3) > 0.08)
    assert all(got[i].held_out == (not learned(i)) for i, _ in docs)
