"""Folders that all machines share, scopes of tables by thread, and ties of the mix."""

import json
import threading

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpusloom.llm import _store, curriculum_mix, piece_viterbi, token_index

BPE = public_tokenizers.path("byte_bpe_50k.json")


def test_shared_folder_has_a_scheme(spark):
    assert _store.shared_dir(spark).startswith("file:/")


@pytest.mark.parametrize("folder", ["s3a://bucket/x", "/tmp/x", "relative", "viewfs://store/x"])
def test_stores_that_tasks_cannot_reach(spark, folder):
    """A folder without a scheme would be each executor's own disk; other stores are refused before a job runs."""
    with pytest.raises(ValueError, match="shards can be written to"):
        token_index.write_shards(spark.createDataFrame([(1, "a")], "doc_id long, text string"), folder, BPE)


def test_file_folders(tmp_path):
    for folder in (f"file:{tmp_path}", f"file://{tmp_path}"):
        assert token_index._opened(folder)[1] == str(tmp_path)


def test_padding_in_a_tokenizer_file():
    """Ids don't depend on what shares a batch."""
    said = json.loads(open(BPE, encoding="utf-8").read())
    said["padding"] = {"strategy": "BatchLongest", "direction": "Right", "pad_to_multiple_of": None, "pad_id": 0, "pad_type_id": 0, "pad_token": "!"}
    texts = ["a  b", "a much  longer text with  double spaces"]
    got = [memoryview(x).cast("H").tolist() for x in token_index.Encoder(json.dumps(said)).encode(texts)]
    plain = Tokenizer.from_file(BPE)
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_scopes_of_two_threads(spark):
    """A thread's scope that ends deletes its own tables only."""
    held, done, kept = threading.Event(), threading.Event(), {}

    def long_job():
        with _store.scratch(spark):
            kept["long"] = _store.kept(spark.range(3), "long")
            held.set()
            done.wait(60)
            kept["rows"] = kept["long"].count()

    thread = threading.Thread(target=long_job)
    thread.start()
    assert held.wait(60)
    with _store.scratch(spark):
        mine = _store.kept(spark.range(5), "short")
        assert mine.count() == 5
    done.set()
    thread.join(60)
    assert kept["rows"] == 3
    with pytest.raises(Exception, match="(?i)path|exist|file"):
        spark.read.parquet(mine.kept_at).count()


def test_space_signs_come_back_as_spaces():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        pieces = piece_viterbi.loaded(f.read())
    ids = memoryview(pieces.encode("a▁b")).cast("i").tolist()
    assert pieces.decode(ids) == "a b"


def test_rows_of_one_id_are_ordered_by_text(spark):
    """Rows that share an id and a size: which is cut, and when each is met, doesn't follow the input's order."""
    rows = [(1, "a b c", "s", 1), (1, "d e f", "s", 2), (1, "g h i", "s", 3), (None, "x y z", "t", 4), (None, "u v w", "t", 5)]
    runs = []
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        df = spark.createDataFrame(order, "doc_id long, text string, source string, extra int").repartition(2)
        runs.append(sorted((tuple(r) for r in curriculum_mix.curriculum(df).collect()), key=repr))
    assert runs[0] == runs[1] == runs[2]
