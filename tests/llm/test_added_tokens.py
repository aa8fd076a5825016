"""The file's added tokens, against a fresh tokenizer of the library."""

import zlib

import numpy as np
from tokenizers import Tokenizer

from abacist.llm import byte_bpe, sos_packing, token_files
from abacist.llm.queries import tokenizer_file

TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|> y\n", "<|endoftext| >", "日本語 <|endoftext|>é don't", "plain text", ""]


def test_added_tokens_are_the_library(spark):
    path = tokenizer_file("byte_bpe_50k.json")
    fresh = Tokenizer.from_file(path)
    wanted = [fresh.encode(t, add_special_tokens=False).ids for t in TEXTS]
    assert wanted[0] == [64, 220, 50256, 275]
    assert [np.frombuffer(x, "<u4").tolist() for x in byte_bpe.ByteBpe(path).encode_all(TEXTS)] == wanted
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in token_files.read(token_files.write(docs, path, 2)).collect()}
    assert got == {i: (len(x) + 1, zlib.crc32(np.array([*x, 2], "<u4").tobytes())) for i, x in enumerate(wanted)}
    assert {r["doc_id"]: r["length"] for r in sos_packing.pieces(docs, path, 0, 256).collect()} == {i: len(x) + 1 for i, x in enumerate(wanted)}
