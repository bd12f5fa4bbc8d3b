"""BPE against the tokenizers library on words of every kind; files that ask for something else are refused."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from zastera.llm import triebpe
from zastera.llm.queries import tokenizer_path

ALPHABET = "aabcdeeehilnorstt  \n\t.,'0123ÁéžßñЖ中😀‍́  <|>"


def test_ids_and_texts_are_the_library_s():
    whole, own, rnd = Tokenizer.from_file(tokenizer_path()), triebpe.Bpe(Path(tokenizer_path()).read_text(encoding="utf-8")), random.Random(9)
    texts = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randrange(60))) for _ in range(3000)] + ["<|endoftext|>", "a<|endoftext|><|endoftext|> b", "it's I'll don't", "   x  ", "\r\n\r\n", "a" * 3000, "ab" * 2000]
    for t, ids in zip(texts, own.encode(texts), strict=True):
        want = whole.encode(t, add_special_tokens=False).ids
        assert ids == b"".join(x.to_bytes(4, "little") for x in want) and own.decode(ids) == whole.decode(want, skip_special_tokens=False)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (None, ""), (2, "x y"), (2, "x y")], "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    got = sorted((str(r["doc_id"]), r["n_tokens"]) for r in triebpe.digest(docs, tokenizer_path()).collect())
    assert got == [("1", 0), ("2", 2), ("2", 2), ("None", 0)] and triebpe.digest(docs.limit(0), tokenizer_path()).collect() == []


@pytest.mark.parametrize("change", [{"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"decoder": None}, {"model": {"type": "WordPiece"}}, {"added_tokens": [{"content": "x", "id": 1, "lstrip": True}]}])
def test_other_settings_are_refused(spark, tmp_path, change):
    (tmp_path / "t.json").write_text(json.dumps(json.loads(Path(tokenizer_path()).read_text(encoding="utf-8")) | change))
    with pytest.raises(ValueError, match=next(iter(change))):
        triebpe.digest(spark.createDataFrame([(1, "a")], "doc_id long, text string"), str(tmp_path / "t.json"))
