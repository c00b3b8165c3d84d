import ctypes

import numpy as np

from rosterline.llm import common, decontamination as D, lm_scoring as L


def test_texts_read_together_have_their_own_words():
    texts = ["One, two!", None, "", "ΑΣ", "Σ b", "--", "x " * D.TOGETHER, "c\n", "\ud800d 𝒳y. z", " e"]
    found = list(D.words_of_texts(texts, 1 << 14))
    assert len(found) == len(texts)
    for text, words in zip(texts, found):
        alone = D.Words.of(text, 1 << 14)
        assert words.features.tolist() == alone.features.tolist() and D._all(words) == D._all(alone)


def test_scores_are_those_of_each_words_softmax():
    net = L.Network()
    lexicon = L.Lexicon({"a": (0, 0, -1.0), "b": (1, 1, -2.0)}, [-3.0] * net.classes, net)
    texts = [["a", "b", "zz"], [], ["q"], ["a"] * 5]
    rows, classes, logs, counts = lexicon.tokens(texts)
    assert counts.tolist() == [3, 0, 1, 5] and (classes >= 0).sum() == 9 and len(rows) == 9 + net.reach * 5
    for scale in (1, 300):  # far-apart logits too
        layers = [w.astype(np.float64) * (scale if k == 3 else 1) for k, w in enumerate(net.layers(net.start()))]
        table, w1, b1, w2, b2 = layers
        got = L.conditional_logs([w.astype(np.float32) for w in layers], rows, classes, logs, net)
        for at in np.flatnonzero(classes >= 0):
            x = np.concatenate([table[rows[at + d]] for d in range(-net.reach, net.reach + 1) if d])
            z = np.maximum(x @ w1 + b1, 0) @ w2 + b2
            want = z[classes[at]] - z.max() - np.log(np.exp(z - z.max()).sum()) + logs[at]
            assert abs(got[at] - want) < 1e-3 * scale


def test_a_task_takes_one_blas_thread():
    common._set_one_blas_thread()
    with open("/proc/self/maps") as maps:
        paths = {line.split(maxsplit=5)[5].strip() for line in maps if "openblas" in line}
    for path in paths:
        library = ctypes.CDLL(path)
        if hasattr(library, "scipy_openblas_get_num_threads64_"):
            assert library.scipy_openblas_get_num_threads64_() == 1
