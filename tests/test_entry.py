import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAYS = "import __spark_entry__ as e; print('NAMES', *sorted(e.queries())); print('SQL', *sorted(e.oracle_sql()))"


def test_without_the_corpus_operators(tmp_path):
    """The core queries are there when the optional part is deleted, also when an empty folder of it is left."""
    for leftover in (False, True):
        home = tmp_path / str(leftover)
        shutil.copytree(f"{REPO}/lattica", home / "lattica", ignore=lambda d, names: [n for n in names if n in ("llm", "__pycache__")])
        shutil.copy(f"{REPO}/__spark_entry__.py", home)
        if leftover:
            (home / "lattica/llm/__pycache__").mkdir(parents=True)
            # a pipeline that is left without its operators is left out too
            (home / "corpus_pipeline.py").write_text("from lattica.llm import contract\n")
        env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
        out = subprocess.run([sys.executable, "-c", SAYS], cwd=home, env=env, capture_output=True, text=True, timeout=120)
        assert out.returncode == 0, out.stderr
        names, sql = (line.split()[1:] for line in out.stdout.splitlines() if line.startswith(("NAMES", "SQL")))
        assert len(names) > 70 and set(names) == set(sql) and "pipeline" not in names
