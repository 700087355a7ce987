"""Forward-backward over pieces of long texts."""

import numpy as np
import pytest

from touchline.llm import toxicity


@pytest.mark.parametrize("piece", [1, 3, 64])
def test_pieces_give_what_one_pass_gives(monkeypatch, piece):
    """Texts of none to 700 tokens with evidence, with gaps, against a pass in log space; steps do not grow with the longest text alone."""
    monkeypatch.setattr(toxicity, "PIECE", piece)
    rng = np.random.default_rng(2)
    count = np.array([0, 1, 700, 3, 64, 65, 0, 128])
    first = np.r_[0, np.cumsum(count)]
    n, none = int(count.sum()), np.zeros(0, np.int64)
    gap, tail, node = rng.integers(0, 4, n) * rng.integers(0, 2, n), rng.integers(0, 3, len(count)), rng.normal(-2, 6, n)
    bias, edge = -3.0, np.array([[0.0, -1.0], [0.5, 2.0]])
    steps = []
    real = toxicity._Lanes.__init__
    monkeypatch.setattr(toxicity._Lanes, "__init__", lambda self, *args: (real(self, *args), steps.append(len(self.steps)))[0])
    log_z, p, expected = toxicity.forward_backward(toxicity.Chains(first, gap, tail, none, none, np.zeros(0), none), node, bias, edge, slopes=True)
    assert sum(steps) <= 2 * piece + -(-700 // piece)
    for d in range(len(count)):
        own = []  # weights of label 1 of all tokens; where those with evidence are
        at = []
        for i in range(first[d], first[d + 1]):
            own += [bias] * int(gap[i])
            at.append(len(own))
            own.append(node[i])
        own += [bias] * int(tail[d])
        ahead = [np.array([0.0, -np.inf])]
        for w in own:
            ahead.append(np.logaddexp.reduce(ahead[-1][:, None] + edge + np.array([0.0, w]), axis=0))
        behind = [np.zeros(2)]
        for w in own[::-1]:
            behind.insert(0, np.logaddexp.reduce(edge + np.array([0.0, w]) + behind[0], axis=1))
        whole = np.logaddexp.reduce(ahead[-1])
        assert np.isclose(log_z[d], whole)
        one = np.exp([a[1] + b[1] - whole for a, b in zip(ahead[1:], behind[1:], strict=True)])
        assert np.allclose(p[first[d] : first[d + 1]], one[at] if at else [])
        assert np.isclose(expected[d, 0], one.sum() - one[at].sum() if len(one) else 0.0, atol=1e-7)
        pairs = sum((np.exp(a[:, None] + edge + np.array([0.0, w]) + b - whole) for a, w, b in zip(ahead[:-1], own, behind[1:], strict=True)), np.zeros((2, 2)))
        assert np.allclose(expected[d, 1:], pairs.ravel()[1:], atol=1e-7)
