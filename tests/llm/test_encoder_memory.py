"""What an encoder holds in a task."""

from __future__ import annotations

import os
import subprocess
import sys

import pyarrow as pa

from quillspark.llm import encoders

HERE = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_the_library_is_opened_only_for_texts_that_need_it():
    code = "import sys, public_tokenizers as p; from quillspark.llm.encoders import encoder; import pyarrow as pa; e = encoder(p.path('byte_bpe_50k.json')); e.encode(pa.array(['a b', '  c', None])); print('tokenizers' in sys.modules)"
    found = subprocess.run([sys.executable, "-c", code], cwd=HERE, env={**os.environ, "PYTHONPATH": os.pathsep.join(sys.path)}, capture_output=True, text=True, check=True)
    assert found.stdout.split() == ["False"]


def test_texts_come_in_runs_of_four_megabytes():
    texts = pa.array(["x" * 1000] * 10_000 + ["y" * (5 << 20), "z"])
    runs = list(encoders.slices(texts))
    assert sum(map(len, runs)) == len(texts)
    assert all(len(r) == 1 or sum(len(t.as_py()) for t in r) <= 4 << 20 for r in runs)
