"""What a Python worker holds besides its rows."""

import subprocess
import sys
from pathlib import Path

import public_tokenizers

_RUN = r"""
import random, re, sys, threading, time
sys.path.insert(0, sys.argv[1])
import pyarrow as pa
from tallybook.llm import common, packing
held = lambda: int(re.search(r"RssAnon:\s+(\d+)", open("/proc/self/status").read())[1]) / 1024
rnd = random.Random(3)
stems = [f"{rnd.choice('bcdfg')}{rnd.choice('aeiou')}{i}" for i in range(40_000)]
text = lambda: " ".join(rnd.choice(stems) if rnd.random() < 0.5 else f"w{rnd.randrange(10**7)}" for _ in range(300))
size = getattr(common, "BATCH_BYTES", 16 << 20)
def batches():
    left = 24 << 20
    while left > 0:
        texts, n = [], 0
        while n < min(size, 24 << 20):
            texts.append(text())
            n += len(texts[-1])
        left -= n
        yield pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
start, peak = held(), [0]
def watch():
    while True:
        peak[0] = max(peak[0], held())
        time.sleep(0.02)
threading.Thread(target=watch, daemon=True).start()
pieces = sum(b.num_rows for b in packing._pieces(sys.argv[2], 0, 2048)(batches()))
assert pieces
print(peak[0] - start)
"""


def test_packing_worker_stays_small():
    """24 MB of text with very many different words: 465 MB above the start before, 240 after."""
    top = str(Path(__file__).resolve().parents[2])
    got = subprocess.run([sys.executable, "-c", _RUN, top, public_tokenizers.path("word_bpe_49k.json")], capture_output=True, text=True, timeout=300, check=True)
    assert float(got.stdout) < 340
