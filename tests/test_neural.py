import numpy as np
import pytest

from loomtide.operators import neural
from loomtide.operators.neural import Layer, Network


@pytest.mark.parametrize("kind", ["rnn", "gru", "lstm"])
def test_gradients_of_recurrent_layers(kind):
    check(Network.chain([Layer(kind, 2, 3), Layer("dense", 3, 2, "tanh")], seed=3), np.random.default_rng(1).normal(size=(4, 10)), "squares")


@pytest.mark.parametrize("activation", sorted(neural.ACTIVATIONS))
def test_gradients_of_activations(activation):
    check(Network.of([3, 4, 2], [activation, "linear"], seed=2), np.random.default_rng(2).normal(size=(5, 3)), "squares")


@pytest.mark.parametrize("loss", ["squares", "softmax_log", "log"])
def test_gradients_of_losses(loss):
    layers = [Layer("linear", 3, 4), Layer("linear_softmax", 4, 2), Layer("softmax", 2, 2)] if loss == "log" else [Layer("dense", 3, 2, "sigmoid")]
    check(Network.chain(layers, seed=4, weights="he_uniform"), np.random.default_rng(3).normal(size=(5, 3)), loss)


def check(net, x, loss):
    t = np.eye(2)[np.arange(len(x)) % 2]
    value, grad = net.gradient(x, t, loss)
    assert value == pytest.approx(float(neural.LOSSES[loss][0](net.output(x), t).sum()))
    for i in range(len(grad)):
        probe = np.zeros(len(grad))
        probe[i] = 1e-6
        net.step(-probe)
        up = net.gradient(x, t, loss)[0]
        net.step(2 * probe)
        down = net.gradient(x, t, loss)[0]
        net.step(-probe)
        assert grad[i] == pytest.approx((up - down) / 2e-6, abs=1e-4)


def test_a_forward_pass_by_hand():
    net = Network.of([2, 1], ["sigmoid"])
    net.layers[0].parameters["w"][:] = [[1.0], [-2.0]]
    net.layers[0].parameters["b"][:] = 0.5
    assert net.output(np.array([[1.0, 1.0]]))[0, 0] == pytest.approx(1 / (1 + np.exp(0.5)))


def test_dropout_first_weights_and_judging_losses():
    layer = Layer("dropout", 4, 4, keep=0.5)
    x = np.ones((1000, 4))
    assert (layer.forward(x)[0] == x).all()
    dropped = layer.forward(x, np.random.default_rng(1))[0]
    assert set(np.unique(dropped)) == {0.0, 2.0} and abs(dropped.mean() - 1) < 0.1
    rng = np.random.default_rng(1)
    for rule, variance in (("xavier", 2 / 700), ("he", 2 / 400), ("lecun", 1 / 400), ("fanout", 1 / 300)):
        for shape in ("uniform", "gaussian"):
            assert np.var(neural.initial(f"{rule}_{shape}", 400, 300, rng)) == pytest.approx(variance, rel=0.05)
    a, t = np.array([[0.2, 0.8], [0.9, 0.1]]), np.array([[0, 1], [0, 1]])
    assert neural.LOSSES["argmax"][0](a, t).ravel().tolist() == [0.0, 1.0] and neural.LOSSES["binary"][0](a, t).sum() == 2
    with pytest.raises(ValueError):
        Network.of([2, 2], ["linear"]).gradient(a, t, "argmax")


@pytest.mark.parametrize("optimise", ["gradient", "momentum", "nesterov", "rmsprop"])
def test_training_on_spark(spark, optimise):
    rows = [(float(a), float(b), float(a != b)) for a in (0, 1) for b in (0, 1) for _ in range(5)]
    df = spark.createDataFrame(rows, "a double, b double, y double").repartition(3)
    net = Network.of([2, 8, 1], ["tanh", "linear"], seed=5)
    losses = neural.learn(df, ["a", "b"], ["y"], net, rounds=6, rate=0.002 if optimise == "rmsprop" else 0.05, optimise=optimise)
    assert losses[-1] < losses[0]
    assert neural.judge(df, ["a", "b"], ["y"], net, "squares", "mean") < losses[0]
    assert neural.predict(df, ["a", "b"], net).where("size(prediction) = 1").count() == len(rows)
