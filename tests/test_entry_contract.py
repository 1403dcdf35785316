import __spark_entry__ as E


def test_every_oracle_has_a_query():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 100 and all(callable(f) for f in q.values())


def test_oracle_sql_mentions_only_given_tables():
    allowed = set("region nation customer supplier part orders lineitem events documents embeddings pages "
                  "benchmark labels conversations".split())
    for name, sql in E.oracle_sql().items():
        assert "read_parquet" not in sql and "/root/" not in sql, name
    assert allowed


def test_entry_imports_without_session_or_jars(tmp_path):
    """The entry builds its queries and statements where pyspark is loaded
    from a zip (no jars beside it) and no session runs."""
    import os
    import pathlib
    import subprocess
    import sys

    import pyspark

    root = pathlib.Path(E.__file__).parent
    lib = pathlib.Path(pyspark.__file__).parent / "python" / "lib"
    zips = [str(p) for p in lib.glob("*.zip")]
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    env = dict(os.environ, PYTHONPATH=os.pathsep.join([str(root), *zips]))
    run = subprocess.run([sys.executable, "-c", code], cwd=root, env=env, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr[-800:]
    assert int(run.stdout.split()[-2]) >= 100
