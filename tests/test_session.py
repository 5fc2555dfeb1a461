from undula import session


class Conf:
    def get(self, key, default=None):
        return default


class Fake:
    """A session without a shared folder."""

    conf = Conf()

    class sparkContext:
        applicationId = "app-1"
        master = "local[1]"

        class _jsc:
            @staticmethod
            def hadoopConfiguration():
                return Conf()

        @staticmethod
        def getConf():
            return Conf()


def test_own_folder_only_where_none_is_set():
    first = session.staging_root(Fake())
    assert first == session.staging_root(Fake()) and "undula-staging-" in first


def test_shared_folder_is_used(spark):
    want = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if want:
        assert session.staging_root(spark) == want.rstrip("/")
    df = spark.range(5)
    assert sorted(r.id for r in session.stage(df).collect()) == list(range(5))


def test_workers_find_the_package_from_any_folder(tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    code = f"""
import sys; sys.path.insert(0, {str(root)!r})
from undula.operators.encode import encode_windows
from undula.session import build_session
s = build_session(master='local[1]')
df = s.createDataFrame([(1, [[0.0, 1.0, 2.0]])], 'id int, x array<array<float>>')
assert encode_windows(df, 1.0).first().n_events == 2
"""
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr[-2000:]
