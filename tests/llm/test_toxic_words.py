"""Features of all tokens at once against those of one token after the other."""

import numpy as np

from permuta.llm import toxicity


def test_features_of_many_tokens_equal_those_of_each_and_the_kernel_sees_no_filling(monkeypatch):
    model = toxicity.Model(["^idiot$", "^scum", "^worthless$", "^ñandú"])
    rng = np.random.default_rng(1)
    letters = list("idiotscumwrhlesñandú-_*.ß界")
    tokens = ["", "!!!", "_", "idiot", "i.d.i.o.t", "id_iot", "worthless", "worthles" * 5, "x" * 22, "x" * 23, "idiots" * 9, "scum", "ñandúes"]
    tokens += ["".join(rng.choice(letters, rng.integers(1, 40))) for _ in range(3000)]
    wanted = np.array([model.features(toxicity.windows(x)).max(axis=0) for x in tokens])
    widths, plain = [], toxicity.kernel
    monkeypatch.setattr(toxicity, "kernel", lambda s, t: widths.append((t > 0).all()) or plain(s, t))
    monkeypatch.setattr(toxicity, "TOKENS", 1000)
    short = [x for x in tokens if len(toxicity.windows(x)) == 1]
    assert np.array_equal(model.token_features(short), wanted[[len(toxicity.windows(x)) == 1 for x in tokens]])
    assert all(widths) and (wanted > 0).any()
    assert np.array_equal(model.token_features(tokens), wanted)
    assert model.token_features([]).shape == (0, 4) and model.token_features([""]).shape == (1, 4)
