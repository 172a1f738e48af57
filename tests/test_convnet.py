import numpy as np

from galewright.nn.convnet import CONV, HIDDEN, POOL, Link, Map, cross_convnets, evaluate, mutate_convnet, run, seed_convnet, train_pictures


def net(rng):
    g = seed_convnet(1, 6, 6, 2)
    g.maps.append(Map(10, HIDDEN, 0.3, 8, 4))
    g.maps.append(Map(11, HIDDEN, 0.6, 3, 2))
    g.links += [Link(20, 1, 10, CONV), Link(21, 10, 11, POOL), Link(22, 11, 2, CONV), Link(23, 11, 3, CONV), Link(24, 1, 11, POOL)]
    g.initialize(rng)
    return g


def test_gradients_equal_differences():
    rng = np.random.default_rng(1)
    g = net(rng)
    x, labels = rng.normal(size=(5, 1, 6, 6)), np.array([0, 1, 1, 0, 1])
    loss = lambda: run(g, x, labels, True, np.random.default_rng(9))[0]
    _, _, grads, _ = run(g, x, labels, True, np.random.default_rng(9))
    for k in g.links:
        w = k.weights
        at = np.unravel_index(w.size // 2, w.shape)
        sides = []
        for s in (1e-5, -1e-5):
            k.weights = w.copy()
            k.weights[at] += s
            sides.append(loss())
        k.weights = w
        assert abs((sides[0] - sides[1]) / 2e-5 - grads["link", k.innovation][at]) < 1e-4, k.innovation
    for m in g.maps:
        if m.kind == HIDDEN:
            sides = []
            for s in (1e-5, -1e-5):
                m.gamma += s
                sides.append(loss())
                m.gamma -= s
            assert abs((sides[0] - sides[1]) / 2e-5 - grads["map", m.innovation][0]) < 1e-4


def test_training_and_search():
    rng = np.random.default_rng(2)
    labels = rng.integers(0, 2, 80)
    x = rng.normal(0, 0.3, (80, 1, 6, 6))
    x[labels == 1, 0, 1:4, 1:4] += 1
    g = net(rng)
    g.hyper.batch = 10
    before = evaluate(g, x, labels)[0]
    log = train_pictures(g, x, labels, x, labels, 6)
    assert g.error < before and g.correct > 60 and len(log) == 6
    counters, ops = [30, 40], set()
    for _ in range(25):
        child = g.copy()
        ops.add(mutate_convnet(child, rng, counters))
        evaluate(child, x[:4], labels[:4])
        both = cross_convnets(g, child, rng)
        assert np.isfinite(evaluate(both, x[:4], labels[:4])[0])
    assert len(ops - {None}) >= 4
