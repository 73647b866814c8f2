"""Token counts against the sentencepiece library on whole texts."""

import random

import public_tokenizers as P
import pytest
import sentencepiece

from ledgerloom.llm import tokencounts
from ledgerloom.llm.queries import op12_distinct_piece_counts

PATH = P.path("piece_bpe_32k.model")


def odd_text(rng):
    alphabet = rng.choice(["abc ", "the and er in  ", "éüß \n\t.,", "0123456789 ", "中文字 テスト", "▁ a", "<s></s><unk> ", "\x00\x01  　x", "{}();\r\n  =", "😀👩‍🚀 🇩🇪"])
    return "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 120)))


def test_counts_equal_the_library(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    texts = [odd_text(rng) + rng.choice(["", " ", odd_text(rng)]) for _ in range(1500)]
    texts += [None, "", " ", "  ", "\n", "a", " a ", "▁", "▁▁ b", "word " * 3000, "x" * 5000, "  " * 4000, "same text", "same text"]
    ids = [*range(len(texts) - 2), None, 7]
    df = spark.createDataFrame([(i, t, "e", 1, 2) for i, t in zip(ids, texts)], "doc_id long, text string, words string, block int, size int")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    want = []
    for i, t in zip(ids, texts):
        n = len(library.encode(t or ""))
        want.append((i, len((t or "").encode()), n, n > 4096))
    for chars in (tokencounts.BLOCK_CHARS, 2000):  # many small blocks too
        monkeypatch.setattr(tokencounts, "BLOCK_CHARS", chars)
        got = op12_distinct_piece_counts(spark, str(tmp_path))
        assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert tokencounts.count_tokens(df.where("false"), PATH).count() == 0


def test_very_long_texts_are_cut_alike(spark, monkeypatch):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rng = random.Random(4)
    text = "  ".join(odd_text(rng) for _ in range(3000))
    model = tokencounts.PieceModel(PATH)
    whole = [x for part in model.parts(text) for x in part]
    monkeypatch.setattr(tokencounts, "CUT_CHARS", 50)
    assert [x for part in model.parts(text) for x in part] == whole
    big = spark.range(1).selectExpr("id AS doc_id", "concat(repeat('Some words of a long text, 1234. ', 700000), repeat('y', 100000)) AS text")
    r = tokencounts.count_tokens(big, PATH).collect()[0]
    one = len(library.encode("Some words of a long text, 1234. " * 2)) - len(library.encode("Some words of a long text, 1234. "))
    rest = len(library.encode("Some words of a long text, 1234. " + "y" * 100000))
    assert r["n_bytes"] == 33 * 700000 + 100000 and r["n_tokens"] == one * 699_999 + rest


def test_other_vocabularies_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(open(PATH, "rb").read())
    model.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "other.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        tokencounts.PieceModel(str(tmp_path / "other.model"))
