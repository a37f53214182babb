"""Packing of texts that hold an added token's string."""

import zlib

import numpy as np

from opsmetrics.llm import packing
from opsmetrics.llm.queries import tokenizer_file


# 10
def test_added_tokens_are_one_id(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_file())
    texts = ["it's <|endoftext|> 12 34", "<|endoftext|>", "a<|endoftext|><|endoftext|>b", "<|endoftext", "plain text", "a  b <|endoftext|>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in packing.pack_documents(docs, tokenizer_file()).collect()}
    for i, text in enumerate(texts):
        ids = whole.encode(text, add_special_tokens=False).ids + [0]
        assert got[i] == (len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())), text
    assert got[1][0] == 2
