"""The classifier's forward pass against plain loops, and workers that have no copy of the package."""

import math
import os
import subprocess
import sys

import numpy as np

from tidemark.llm import quality_model

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain_score(model, bag):
    """Gated attention over the passages of one text, one number at a time."""
    p = model.weights
    hidden, energies = [], []
    for passage in bag:
        x = [min(max((v - c) / s, -5), 5) for v, c, s in zip(passage, model.center, model.scale)]
        h = [math.tanh(sum(x[i] * p["W"][i][j] for i in range(len(x))) + p["b"][j]) for j in range(len(p["b"]))]
        gated = 0.0
        for j in range(len(p["w"])):
            tangent = math.tanh(sum(h[i] * p["V"][i][j] for i in range(len(h))))
            gate = 1 / (1 + math.exp(-sum(h[i] * p["U"][i][j] for i in range(len(h)))))
            gated += tangent * gate * p["w"][j]
        hidden.append(h)
        energies.append(gated)
    total = sum(math.exp(e) for e in energies)
    weights = [math.exp(e) / total for e in energies]
    pooled = [sum(a * h[j] for a, h in zip(weights, hidden)) for j in range(len(hidden[0]))]
    return 1 / (1 + math.exp(-(sum(z * c for z, c in zip(pooled, p["c"])) + p["d"][0])))


def test_scores_are_those_of_plain_loops():
    rng = np.random.default_rng(5)
    model = quality_model.Model(7, rng)
    model.center, model.scale = rng.normal(size=7), rng.uniform(0.5, 2, 7)
    model.weights["d"] = np.array([0.3])
    bags = [rng.normal(size=(n, 7)) for n in (1, 4, 9, 2)]
    found = model.score(np.concatenate(bags), np.array([len(bag) for bag in bags]))
    assert np.allclose(found, [plain_score(model, bag) for bag in bags], atol=1e-12)


SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from tidemark.session import build_session
from tidemark.llm import quality_model
spark = build_session("outside", {{"spark.master": "local[2]", "spark.ui.enabled": "false",
    "spark.driver.host": "127.0.0.1", "spark.checkpoint.dir": {folder!r}, "spark.sql.shuffle.partitions": "2"}})
docs = spark.createDataFrame([(i, "plain words of a text " * (i % 3 + 1)) for i in range(20)], "doc_id long, text string")
labels = docs.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS label")
print("rows", quality_model.score(docs, quality_model.learn(docs, labels)).count())
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    """Started from another folder, only the driver's own path has the package."""
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = SCRIPT.format(root=ROOT, folder=str(tmp_path / "shared"))
    done = subprocess.run(
        [sys.executable, "-c", script], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=300
    )
    assert "rows 20" in done.stdout, done.stderr[-2000:]
