"""Long texts and many fields on a long page (third round, F22, F23, F26)."""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa

from pageloom.operators import spans


def runs(words: list[str], text: list[str], cursor: int, floor: float):
    """All runs, one by one."""
    best, wanted = None, set(text)
    for start in range(cursor, len(words)):
        for n in range(max(1, len(text) - 2), min(len(text) + 3, len(words) - start) + 1):
            own = {t for w in words[start : start + n] for t in w.split()}
            score = len(own & wanted) / max(len(own), len(wanted), 1)
            if score > (best[2] if best else 0) and score >= floor:
                best = (start, start + n, score)
    return best


def test_long_and_short_texts_take_the_best_of_all_runs():
    r = np.random.default_rng(5)
    for _ in range(150):
        words = [str(x) for x in r.choice(["a", "b", "c d", "", "e", "a b c", "f"], int(r.integers(1, 120)))]
        at, n = int(r.integers(0, len(words))), int(r.choice([1, 4, 12, 40]))
        text = " ".join(words[at : at + n]).split() + ["zz"] * int(r.integers(0, 2))
        for floor in (0.0, 0.7):
            assert spans.PageIndex(words).best(text, at // 2, floor) == (runs(words, text, at // 2, floor) if text else None)


def test_a_long_text_costs_its_six_lengths_not_every_length():
    words = [f"w{k * 7919 % 6000}" for k in range(20_000)]
    text = [w for k, w in enumerate(words) if k % 29 in range(11, 17)]
    begin = time.process_time()
    for _ in range(3):
        assert spans.PageIndex(words).best(text, 0, 0.2)[:2] == (3, 4141)
    assert time.process_time() - begin < 2.5  # 5 s with a step for each length up to the text's


def test_batches_without_words_or_fields():
    kinds = pa.list_(pa.struct([("field_no", pa.int32()), ("label", pa.string()), ("tokens", pa.list_(pa.string()))]))
    one = [{"field_no": 1, "label": "TITLE", "tokens": ["b"]}]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([None, ["a", "b"], []], pa.list_(pa.string())), pa.array([one, one, []], kinds)], ["page_num", "w", "fields"])
    run = spans.matched_in_order(0.7, "O")
    got = [r for b in run(iter([batch, batch.slice(1, 1), batch.slice(0, 0)])) for r in b.to_pylist()]
    assert [r["labels"] for r in got] == [[], ["O", "TITLE"], [], ["O", "TITLE"]]
    assert [[m["matched"] for m in r["matches"]] for r in got] == [[False], [True], [], [True]]
