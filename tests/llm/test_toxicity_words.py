"""Words without the punctuation at their ends, in texts of long runs of it, against plain Python; and the time that such runs take."""

import random
import time

import numpy as np
import pyarrow as pa

from faultline.llm import tokens, toxicity


def stripped(text):
    marks = bytes(b for b in range(256) if toxicity._STRIP[b])
    return [x for w in text.encode().split() if (x := w.strip(marks))]


def test_ends_of_words():
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab-.!é \n\"'") for _ in range(rng.randrange(60))) for _ in range(300)] + ["", "---", "-" * 500 + "x" + "-" * 500]
    for t in texts:
        body, at = tokens.flat(pa.array([t]))
        starts, ends, _ = tokens.spans(body, at)
        lo, hi = toxicity.bare(body, starts, ends)
        assert [body[a:b].tobytes() for a, b in zip(lo, hi, strict=True) if a < b] == stripped(t)


def test_a_million_dashes_take_no_time():
    body, at = tokens.flat(pa.array(["word " * 300] * 500 + ["-" * 1_000_000 + " end"]))
    starts, ends, _ = tokens.spans(body, at)
    began = time.time()
    lo, hi = toxicity.bare(body, starts, ends)
    assert time.time() - began < 1 and int(np.count_nonzero(lo < hi)) == 500 * 300 + 1
