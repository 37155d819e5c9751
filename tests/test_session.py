"""Where queries write: only below the folder that the session names."""
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import os, sys; sys.path.insert(0, {root!r})
from recset import plans
from recset.session import build, cut, share, shared_dir
s = build('local[2]', **{{{name!r}: {folder!r}, 'spark.ui.enabled': 'false', 'spark.sql.shuffle.partitions': '2'}})
assert shared_dir(s).startswith({folder!r}), shared_dir(s)
assert cut(s.range(5)).count() == share(s.range(5)).count() == 5
plans.load_all()
for k in ('src_visits_csv', 'transition_pairs', 'st_transitions'):
    assert plans.QUERIES[k](s, '/root/testdata/sf0.001').count() >= 0
assert not s.sparkContext._jvm.java.io.File({tmp!r}).list(), os.listdir({tmp!r})
"""


def run(name, folder, cwd):
    tmp = cwd / "tmp"
    tmp.mkdir()
    code = CODE.format(root=ROOT, name=name, folder=str(folder), tmp=str(tmp))
    env = {**os.environ, "TMPDIR": str(tmp), "SPARK_LOCAL_DIRS": str(cwd / "local")}
    done = subprocess.run([sys.executable, "-c", code], cwd=cwd, timeout=170, capture_output=True, text=True, env=env)
    assert done.returncode == 0, done.stderr[-2000:]


def test_shared_folder_is_read_from_the_session(tmp_path):
    folder = tmp_path / "shared"
    run("spark.checkpoint.dir", folder, tmp_path)
    assert any(p.name.startswith("recset-") for p in folder.iterdir())


def test_no_local_temporary_folder_in_the_library():
    for base, _, names in os.walk(os.path.join(ROOT, "recset")):
        if os.path.basename(base) == "llm":
            continue
        for n in names:
            if n.endswith(".py"):
                with open(os.path.join(base, n)) as f:
                    assert "tempfile" not in f.read(), n


def test_a_folder_of_one_machine_is_refused_on_a_cluster():
    from types import SimpleNamespace

    import pytest

    from recset.session import shared_dir

    def session(master, **conf):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda path: None)
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, *d: conf.get(k, *d)))

    own, common = {"spark.sql.warehouse.dir": "file:/tmp/x"}, {"spark.sql.warehouse.dir": "hdfs://n/x"}
    assert shared_dir(session("local[2]", **own)).startswith("file:/tmp/x")
    assert shared_dir(session("yarn", **common)).startswith("hdfs://n/x")
    assert shared_dir(session("yarn", **own, **{"spark.checkpoint.dir": "hdfs://n/y"})) == "hdfs://n/y"
    with pytest.raises(ValueError):
        shared_dir(session("spark://h:7077", **own))
