"""Code that runs in tasks must not need the package on the executors."""

import subprocess
import sys

from pyspark import cloudpickle

from sheaf.operators.catalog import flatten
from sheaf.sources.filetree import FileTreeReader


def test_task_code_travels_by_value(tmp_path):
    blob = tmp_path / "blob"
    blob.write_bytes(cloudpickle.dumps((flatten, FileTreeReader(str(tmp_path), 2))))
    script = (
        "import pickle; f, r = pickle.load(open('blob', 'rb')); "
        "print(f('x = 1')[0]['kind'], sum(b.num_rows for p in r.partitions() for b in r.read(p)))"
    )
    out = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True, timeout=60)
    assert out.stdout.split() == ["Assign", "1"], out.stderr
