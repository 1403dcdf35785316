"""The library in sessions that this machine did not prepare."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _python(code, tmp_path, **env):
    keep = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_CONF_DIR")}
    return subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=keep | env, capture_output=True, text=True, timeout=180)


def test_checkpoint_without_the_setting(tmp_path):
    conf = tmp_path / "conf"
    conf.mkdir()
    code = ("from custlens.session import get_spark, cut_lineage, checkpoint_dir\n"
            "s = get_spark('t', cpus=2, shuffle_partitions=2)\n"
            "assert not s.conf.get('spark.checkpoint.dir', None)\n"
            "assert cut_lineage(s.range(5)).count() == 5\n"
            "first = checkpoint_dir(s); assert first and checkpoint_dir(s) == first; print('fine')")
    got = _python(code, tmp_path, SPARK_CONF_DIR=str(conf), PYTHONPATH=ROOT)
    assert "fine" in got.stdout, got.stderr[-2000:]


def test_entry_without_an_optional_library(tmp_path):
    code = ("import sys; sys.modules['xxhash'] = None\n"
            "import __spark_entry__ as e\n"
            "names = set(e.queries()); assert not any(n.startswith('op1_') for n in names); assert 'kmeans_segments' in names\n"
            "assert set(e.oracle_sql()) <= names; print('fine')")
    got = _python(code, tmp_path, PYTHONPATH=ROOT)
    assert "fine" in got.stdout, got.stderr[-2000:]
