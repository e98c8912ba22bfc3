"""OnnxScorer end to end: a tiny mixture head written as ONNX protobuf bytes by hand (the
``onnx`` package is not available), scored through ``mapInArrow``."""

import os
import struct
import tempfile

import numpy as np
import pytest

ort = pytest.importorskip("onnxruntime")


def _varint(n):
    out = bytearray()
    while True:
        b = n & 0x7F
        n >>= 7
        if n:
            out.append(b | 0x80)
        else:
            out.append(b)
            return bytes(out)


def _key(field, wire):
    return _varint((field << 3) | wire)


def _bytes(field, data):
    return _key(field, 2) + _varint(len(data)) + data


def _str(field, s):
    return _bytes(field, s.encode())


def _int(field, v):
    return _key(field, 0) + _varint(v)


def _value_info(name, dims):
    shape = b"".join(_bytes(1, _str(2, d) if isinstance(d, str) else _int(1, d)) for d in dims)
    tensor = _int(1, 1) + _bytes(2, shape)            # elem_type FLOAT, shape
    return _str(1, name) + _bytes(2, _bytes(1, tensor))


def _tensor(name, arr):
    arr = np.asarray(arr, dtype=np.float32)
    dims = b"".join(_int(1, d) for d in arr.shape)
    data = _bytes(4, struct.pack(f"<{arr.size}f", *arr.ravel()))
    return dims + _int(2, 1) + data + _str(8, name)


def _node(op, inputs, outputs, name):
    return b"".join(_str(1, i) for i in inputs) + b"".join(_str(2, o) for o in outputs) + _str(3, name) + _str(4, op)


def build_model(w_w, w_mu, w_s, sets=1):
    nodes = [_node("MatMul", ["target", "Ww"], ["zw"], "n1"), _node("Softmax", ["zw"], ["weight"], "n2"),
             _node("MatMul", ["target", "Wm"], ["mu"], "n3"),
             _node("MatMul", ["target", "Ws"], ["zs"], "n4"), _node("Exp", ["zs"], ["sigma"], "n5")]
    graph = b"".join(_bytes(1, n) for n in nodes) + _str(2, "mixture_head")
    graph += b"".join(_bytes(5, _tensor(n, w)) for n, w in (("Ww", w_w), ("Wm", w_mu), ("Ws", w_s)))
    graph += _bytes(11, _value_info("waveform", [sets, "S", "T", 3])) + _bytes(11, _value_info("sta", [sets, "S", 4]))
    graph += _bytes(11, _value_info("target", [sets, "N", 4]))
    for o in ("weight", "sigma", "mu"):
        graph += _bytes(12, _value_info(o, [sets, "N", 5]))
    opset = _str(1, "") + _int(2, 17)
    return _int(1, 8) + _str(2, "quakeframe-test") + _bytes(7, graph) + _bytes(8, opset)


@pytest.mark.parametrize("sets", [1, "B"])  # a model for single sets, and one for batches
def test_onnx_scorer_through_map_in_arrow(spark, sets):
    from quakeframe.operators.scoring import OnnxScorer, score

    rng = np.random.default_rng(0)
    w_w, w_mu, w_s = (rng.normal(size=(4, 5)) * 0.01 for _ in range(3))
    path = os.path.join(tempfile.mkdtemp(prefix="qf-onnx-"), f"head-{sets}.onnx")
    with open(path, "wb") as f:
        f.write(build_model(w_w, w_mu, w_s, sets))
    wave = [[[0.0, 1.0, 0.0]] * 4] * 2
    rows = [(1, wave, [[24.0, 121.0, 0.1, 300.0], [0.0, 0.0, 0.0, 0.0]],
             [(0, 24.0, 121.0, 0.1, 300.0), (1, 25.0, 120.5, 0.2, 250.0)]),
            (2, wave, [[23.0, 121.0, 0.1, 300.0], [0.0, 0.0, 0.0, 0.0]], [(2, 23.0, 120.0, 0.3, 200.0)])]
    df = spark.createDataFrame(rows, "k long, waveform array<array<array<float>>>, station array<array<double>>, "
                                     "targets array<struct<slot:int, lat:double, lon:double, elev:double, vs30:double>>")
    out = sorted(score(df.coalesce(1), [OnnxScorer(path, "onnx")], ["k"]).collect(), key=lambda r: r.target.slot)
    assert [(r.k, r.target.slot) for r in out] == [(1, 0), (1, 1), (2, 2)]
    t = np.array([[24.0, 121.0, 0.1, 300.0], [25.0, 120.5, 0.2, 250.0], [23.0, 120.0, 0.3, 200.0]])
    z = t @ w_w
    w = np.exp(z - z.max(axis=1, keepdims=True))
    w /= w.sum(axis=1, keepdims=True)
    want = (w * (t @ w_mu)).sum(axis=1)
    got = np.array([r.predict for r in out])
    assert np.allclose(got, want, rtol=1e-4, atol=1e-4)
    assert all(abs(sum(c.weight for c in r.mixture) - 1) < 1e-5 for r in out)
