"""Executors need no package of this repository: functions come by value."""

import pickletools
import subprocess
import sys

import numpy as np
import pytest
from pyspark import cloudpickle

from buildlens.llm import alike, codes, language, quality, simhash, substring, suffixarray, threshold, tokens, toxicity
from buildlens.llm.common import words

SAMPLES = {
    "stretches": (substring.anchors, ([b"a", b"b"] * 60,)),
    "shingles": (alike.shingles, ("a b c d e f g",)),
    "bands": (alike.band_keys, (np.arange(9, dtype=np.uint64),)),
    "fingerprint": (simhash.fingerprint, ("a b c d",)),
    "sentences": (toxicity.sentences, ("a b. c",)),
    "repeats": (suffixarray.maximal_repeats, ([b"abcabcabc" * 9, b"xabcabcabc" * 9], 50)),
    "cuts": (codes.cuts, (64, 16)),
    "odd": (tokens._odd, (" a",)),
    "words": (words, ("a b",)),
    "classifier": (language.Classifier, ({"a": b"abc"},)),
    "lists": (threshold.SortedLists, (np.arange(3), np.ones((3, 2), np.int64))),
    "bounds": (codes.Bounds, ([np.ones((3, 2), np.int64)],)),
    "bucket": (alike.Bucket, ([1, 2], [5, 5], [1, 2], [b"a" * 8, b"b" * 8])),
}


@pytest.mark.parametrize("name", list(SAMPLES))
def test_functions_run_without_this_package(name, tmp_path):
    function, given = SAMPLES[name]
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    data = cloudpickle.dumps((function, given))
    cloudpickle.unregister_pickle_by_value(sys.modules[__name__])
    assert not any("buildlens" in str(a) and o.name == "GLOBAL" for o, a, _ in pickletools.genops(data))
    (tmp_path / "f").write_bytes(data)
    code = ("import pickle; f, given = pickle.load(open('f', 'rb')); f(*given); "
            "import sys; assert not any(m.startswith('buildlens') for m in sys.modules)")
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120,
                          env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""})
    assert done.returncode == 0, done.stderr[-800:]


def test_quality_needs_no_python(odd):
    plan = quality.clean_lines(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
