"""Python workers hand back unused memory before a task and after it."""

import numpy as np
import pyarrow as pa
import pytest

from whisperlake.llm import packing, store, tokens


def test_memory_goes_back_before_and_after(monkeypatch):
    seen = []
    monkeypatch.setattr(store, "give_back", lambda: seen.append("back"))
    run = store.tidy(lambda batches: (seen.append(b) or b for b in batches), lambda: seen.append("forget"))
    assert list(run(iter([1, 2]))) == [1, 2] and seen == ["back", 1, 2, "forget", "back"]


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_units_are_joined_once_for_each_piece(monkeypatch, file):
    """Nothing in the joining of ids is longer than the pieces of the texts are many."""
    e = tokens.Encoder(file)
    texts = [" ".join(["some", "words,", "again", "Again!", "é."] * 200), "", "words, words"]
    plain = [x.ids for x in e.as_it_is.encode_batch(texts, add_special_tokens=False)]
    seen, ragged = [], tokens.ragged
    monkeypatch.setattr(tokens, "ragged", lambda starts, lengths: seen.append(len(lengths)) or ragged(starts, lengths))
    got = e.encode(pa.array(texts, pa.large_string()))
    assert [x.tolist() for x in np.split(got.ids, got.starts[1:-1])] == plain
    assert max(seen) <= sum(len(t.split(" ")) for t in texts)


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_second_tokenizer_is_loaded_for_whole_texts_only(file):
    e = tokens.Encoder(file)
    e.encode(pa.array(["some words, again", ""], pa.large_string()))
    assert "as_it_is" not in vars(e)
    mark = next(iter(e.tokenizer.get_added_tokens_decoder().values())).content
    texts = [f"some {mark} words", "some words"]
    got = e.encode(pa.array(texts, pa.large_string()))
    assert "as_it_is" in vars(e)
    assert [x.tolist() for x in np.split(got.ids, got.starts[1:-1])] == [x.ids for x in tokens.Encoder(file).as_it_is.encode_batch(texts, add_special_tokens=False)]


def test_packing_encodes_some_megabytes_at_a_time(monkeypatch):
    """Ids, places and pieces of a slice are many times its text; they all stand in the worker at once."""
    class Task:
        get = staticmethod(lambda: Task)
        partitionId = staticmethod(lambda: 0)  # noqa: N815

    seen = []

    class Ones:
        encode = staticmethod(lambda texts: seen.append(texts.nbytes) or tokens.Ids(np.ones(len(texts), np.uint32), np.arange(len(texts) + 1)))

    monkeypatch.setattr(packing, "TaskContext", Task)
    monkeypatch.setattr(packing, "encoder", lambda file: Ones)
    text = "some words " * 10_000
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array([text] * 100)], names=["doc_id", "text"])
    rows = pa.Table.from_batches(packing._tokenise("", 2, 4096, 64)(iter([batch])))
    assert sorted(rows.column("doc_id").to_pylist()) == list(range(100))
    assert max(seen) <= 2 << 20
