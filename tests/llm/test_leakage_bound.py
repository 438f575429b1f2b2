"""The threshold of the leakage search rests on no sample."""

import numpy as np

from evidara.llm import leakage


def test_threshold_holds_for_any_words_beside_a_run():
    rng = np.random.default_rng(2)
    basis = np.linalg.qr(rng.standard_normal((leakage.DIMS, leakage.RANK)))[0].astype(np.float32)
    idf = rng.uniform(1, 9, leakage.DIMS).astype(np.float32)
    text = " ".join(f"w{k}" for k in range(17))
    items = leakage.Items([(1, text, None)], idf, basis)
    low, ids = items.threshold(idf, basis, 0.0005), leakage.terms(leakage.words(text))
    for k in range(len(ids) - leakage.RUN + 1):
        r = (idf[ids[k : k + leakage.RUN]][:, None] * basis[ids[k : k + leakage.RUN]]).sum(axis=0)
        beside = rng.integers(0, leakage.DIMS, (20_000, 2))
        v = r + (idf[beside][..., None] * basis[beside]).sum(axis=1)
        near = (v @ items.latent.T).max(axis=1) / np.linalg.norm(v, axis=1)
        assert near.min() >= low > -1.1
