"""Nearest neighbours where Python workers cannot import the package."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_from_another_folder(tmp_path):
    # the driver finds the package by a path that workers do not inherit
    code = (f"import sys; sys.path.insert(0, {ROOT!r})\n"
            "from custlens.session import get_spark\n"
            "from custlens.llm import ann\n"
            "s = get_spark('t', cpus=2, shuffle_partitions=2)\n"
            "df = s.createDataFrame([(i, [float(i % 7), 1.0, float(i)]) for i in range(40)], 'vec_id long, embedding array<double>')\n"
            "print('rows', ann.nearest(df, k=2, is_query=df.vec_id % 10 == 0, vector_col='embedding').count())")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "rows 8" in got.stdout, got.stderr[-2000:]
