"""What a batch of word differences takes of a worker's memory."""

import subprocess
import sys
from pathlib import Path

ROOT = str(Path(__file__).resolve().parents[1])


def test_batch_in_little_memory():
    """Of a batch of 4,000 pairs of 300 words a worker holds no object for each word."""
    code = f"""
import resource, sys
sys.path.insert(0, {ROOT!r})
import pyarrow as pa
from lexflow.operators import diff
old = pa.array([" ".join(str(n * k % 977) for k in range(300)) for n in range(4_000)])
new = pa.array([" ".join(str(n * k % 977) for k in range(20, 300)) for n in range(4_000)])
if hasattr(diff, "pd"):
    old, new = old.to_pandas(), new.to_pandas()
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
diff.word_diff = lambda a, b: [("eq", w) for w in a.split()] + [("ins", w) for w in b.split()]
out = diff._word_diffs(old, new)
print(len(out), (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    n, more = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()[-2:])
    assert n == 4_000 and more < 150, more
