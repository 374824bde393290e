"""What is sent to executors has no need of an installed copy of the package."""

import subprocess
import sys

import numpy as np
from pyspark import cloudpickle

from tessera.functions import text
from tessera.operators import contents, quotes, search, vector_index


def test_functions_load_where_the_package_is_missing(tmp_path):
    functions = [text.nfkc.func, text.unescape.func, quotes._closest.func, contents.entries, search._scorer(None, 3), vector_index._assigner(None, 2), vector_index._scorer(None, 3)]
    for k, f in enumerate(functions):
        (tmp_path / str(k)).write_bytes(cloudpickle.dumps(f))
    load = f"import pickle, sys; fs = [pickle.load(open('{tmp_path}/' + str(k), 'rb')) for k in range({len(functions)})]; assert not any(m.startswith('tessera') for m in sys.modules)"
    subprocess.run([sys.executable, "-c", load], cwd=tmp_path, check=True)
    assert quotes.similarity("abc", "abc") == 1.0 and np.isfinite(vector_index.nearest(np.ones((1, 2)), np.ones((3, 2)), 1)).all()
