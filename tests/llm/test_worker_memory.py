"""What Python workers keep between tasks: one operator's things at a time, with unchanged ids."""

import numpy as np
import public_tokenizers
import pyarrow as pa

from cashtrail.llm import common, packing, toxicity, word_ids


def test_a_worker_keeps_one_operator_at_a_time(monkeypatch):
    monkeypatch.setattr(common, "_held", {})
    made = toxicity.gauge(("bad",), ("fine",))
    assert toxicity.gauge(("bad",), ("fine",)) is made and len(common._held) == 1
    path = public_tokenizers.path(packing.VOCABULARY)
    encoder = packing.encoder(path)
    assert packing.encoder(path) is encoder and list(common._held.values()) == [encoder]
    memory = encoder.memory
    assert sum(x.nbytes for x in (memory.keys, memory.places, memory.start, memory.size, memory.whole, memory.ids)) < 20_000_000


def test_an_emptied_memory_gives_the_same_ids(monkeypatch):
    path = public_tokenizers.path(packing.VOCABULARY)
    texts = pa.array([f"Word{i} wörd{i * 7}, the {i}th; don't" for i in range(3_000)])
    want = list(word_ids.Encoder(path, 1)(texts))
    monkeypatch.setattr(word_ids, "POOL", 1_000)            # emptied before every chunk
    monkeypatch.setattr(word_ids, "CHUNK", 4_096)
    for a, b in zip(want, word_ids.Encoder(path, 1, 14)(texts), strict=True):
        assert np.array_equal(a, b)


def test_a_full_memory_doubles_before_it_forgets(monkeypatch):
    """Words that fill half as much again as the first slots are learned once."""
    path = public_tokenizers.path(packing.VOCABULARY)
    texts = pa.array([f"naïve{i}x other{i}y plain" for i in range(4_000)])
    want = list(word_ids.Encoder(path, 1)(texts))
    monkeypatch.setattr(word_ids, "CHUNK", 4_096)
    small = word_ids.Encoder(path, 1, 14)
    asked = []
    plain_ids = small.plain_ids
    small.plain_ids = lambda text: asked.append(text) or plain_ids(text)
    once = 0
    for _ in range(2):
        for a, b in zip(want, small(texts), strict=True):
            assert np.array_equal(a, b)
        once = once or len(asked)
    assert len(asked) == once and small.memory.bits == 15
