"""What tasks leave in a Python worker, which Spark uses again for later stages."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parents[2]

MEASURE = """
import random, re, string
import pyarrow as pa
from hearthline.llm import packing
from hearthline.llm.workers import release, released

def mb():
    found = re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read())
    return sum(map(int, found)) / 1024
"""


def kept(work):
    """MB of a process of its own after each task."""
    run = [sys.executable, "-c", MEASURE + work]
    return [float(x) for x in subprocess.run(run, cwd=ROOT, check=True, capture_output=True, text=True).stdout.split()]


def test_packing_leaves_no_caches_of_words():
    after = kept("""
rng = random.Random(5)
words = ["".join(rng.choices(string.ascii_lowercase, k=9)) for _ in range(40_000)]
for _ in range(6):
    task = (len(ids) for ids in packing.WordEncoder(packing.default_tokenizer(), 100_000).texts(pa.array([" ".join(words)])))
    assert sum(released(task)) > len(words)
    del task
    print(mb())
""")
    assert after[-1] - after[1] < 12, after


def test_memory_of_arrow_is_given_back():
    before, after = kept("""
print(mb())
task = [pa.array([b"x" * 100_000]) for _ in range(1_000)]
del task
release()
print(mb())
""")
    assert after - before < 30, (before, after)


def test_what_the_last_task_left_goes_before_the_next():
    """An applyInArrow task ends without a release."""
    before, within = kept("""
print(mb())
left = [pa.array([b"x" * 100_000]) for _ in range(1_000)]
del left
next(released(iter([1])))
print(mb())
""")
    assert within - before < 30, (before, within)
