"""What runs in Python workers must not need the package to be installed there."""

import subprocess
import sys

import pytest
from pyspark import cloudpickle

from hearthline.operators import views


@pytest.mark.parametrize(
    "work",
    [
        views._outcomes(1, 10),
        views._carry(1, 10),
        views._accept(1),
    ],
)
def test_worker_code_travels_by_value(work, tmp_path):
    path = tmp_path / "work"
    path.write_bytes(cloudpickle.dumps(work))
    load = f"import pickle; pickle.load(open({str(path)!r}, 'rb'))"
    subprocess.run([sys.executable, "-c", load], cwd="/", check=True)
