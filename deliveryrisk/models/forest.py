"""Forests packed for tasks, scored by the tree ensemble of ONNX Runtime where it is installed.

Flat numpy descents visit every tree with several passes over a batch; the runtime
walks each row down each tree in compiled code. Thresholds and path lengths stay
64-bit floats and are added in the order of the trees, so both ways give the same sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

import numpy as np

try:
    import onnxruntime
except ImportError:  # the descent in numpy gives the same scores
    onnxruntime = None

# Sessions that a worker keeps.
MOST_SESSIONS = 32
DOUBLE, BYTES = 11, 2
_SESSIONS: dict[bytes, object] = {}


# --- the wire format of an ONNX model: fields by number ---


def _varint(n: int) -> bytes:
    out = bytearray()
    while True:
        n, low = n >> 7, n & 127
        out.append(low | 128 if n else low)
        if not n:
            return bytes(out)


def _field(number: int, body: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(body)) + body


def _number(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def _attribute(name: str, kind: int, body: bytes) -> bytes:
    return _field(5, _field(1, name.encode()) + body + _number(20, kind))


def _ints(name: str, values: Iterable[int]) -> bytes:
    return _attribute(name, 7, _field(8, b"".join(map(_varint, values))))


def _tensor(name: str, values: np.ndarray, kind: int) -> bytes:
    return _attribute(name, 4, _field(5, _number(1, len(values)) + _number(2, kind) + _field(9, values.tobytes())))


def _matrix(name: str, width: int) -> bytes:
    shape = _field(1, _field(2, b"n")) + _field(1, _number(1, width))
    return _field(1, name.encode()) + _field(2, _field(1, _number(1, DOUBLE) + _field(2, shape)))


def model_of(trees: Sequence[tuple], width: int) -> bytes:
    """A model that adds up the path lengths of all trees; each has a split."""
    feature, threshold, leaves, roots = [], [], [], []
    ways: dict[str, list[int]] = {"nodes_truenodeids": [], "nodes_trueleafs": [], "nodes_falsenodeids": [], "nodes_falseleafs": []}
    n_leaves = 0
    for features, thresholds, left, right, depth in trees:
        inner = features >= 0
        # splits and leaves are numbered apart
        at = np.where(inner, np.cumsum(inner) - 1 + len(feature), np.cumsum(~inner) - 1 + n_leaves)
        roots.append(int(at[0]))
        for side, child in (("true", left[inner]), ("false", right[inner])):
            ways[f"nodes_{side}nodeids"] += at[child].tolist()
            ways[f"nodes_{side}leafs"] += (~inner)[child].astype(int).tolist()
        feature += features[inner].tolist()
        threshold.append(thresholds[inner])
        leaves.append(depth[~inner])
        n_leaves += len(leaves[-1])
    node = _field(1, b"x") + _field(2, b"y") + _field(4, b"TreeEnsemble") + _field(7, b"ai.onnx.ml")
    node += _ints("tree_roots", roots) + _ints("nodes_featureids", feature) + b"".join(_ints(k, v) for k, v in ways.items())
    node += _tensor("nodes_splits", np.concatenate(threshold).astype(np.float64), DOUBLE)
    # mode 0: at most the threshold goes left, anything else right
    node += _tensor("nodes_modes", np.zeros(len(feature), dtype=np.uint8), BYTES)
    node += _ints("leaf_targetids", [0] * n_leaves) + _tensor("leaf_weights", np.concatenate(leaves).astype(np.float64), DOUBLE)
    node += b"".join(_attribute(k, 2, _number(3, v)) for k, v in (("n_targets", 1), ("aggregate_function", 1), ("post_transform", 0)))
    graph = _field(1, node) + _field(2, b"forest") + _field(11, _matrix("x", width)) + _field(12, _matrix("y", 1))
    versions = _field(8, _field(1, b"") + _number(2, 21)) + _field(8, _field(1, b"ai.onnx.ml") + _number(2, 5))
    return _number(1, 10) + _field(7, graph) + versions


def session(model: bytes):
    """The worker's session of a model."""
    found = _SESSIONS.get(model)
    if found is None:
        if len(_SESSIONS) >= MOST_SESSIONS:
            _SESSIONS.clear()
        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = options.inter_op_num_threads = 1
        options.enable_cpu_mem_arena = False
        found = _SESSIONS[model] = onnxruntime.InferenceSession(model, options, providers=["CPUExecutionProvider"])
    return found


@dataclass(frozen=True)
class Forest:
    """Trees as flat arrays, and the same as a model; trees without a split add their depth."""

    trees: tuple[tuple, ...]
    model: bytes | None
    flat: float

    @classmethod
    def of(cls, trees: Sequence[tuple], width: int) -> Forest:
        split = [t for t in trees if t[0][0] >= 0]
        flat = float(sum(t[4][0] for t in trees if t[0][0] < 0))
        return cls(tuple(trees), model_of(split, width) if split and onnxruntime is not None else None, flat)

    def path_lengths(self, x: np.ndarray, walk: Callable[[np.ndarray, Sequence[tuple]], np.ndarray]) -> np.ndarray:
        """Mean path length of each row over all trees; ``walk`` descends where there is no model."""
        if self.model is None or onnxruntime is None or not len(x):
            return walk(x, self.trees)
        total = session(self.model).run(None, {"x": np.ascontiguousarray(x, dtype=np.float64)})[0][:, 0]
        return (total + self.flat) / len(self.trees)
