"""op1 and the packing stage against a tokenizer left at its defaults, on texts that quote the file's added token."""

import zlib

import numpy as np

TEXTS = [None, "", "plain words", "a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|> x", "<|endoftext", "Öl <|endoftext|>\n\n" * 700]


def test_added_tokens_get_their_own_ids(spark, tmp_path):
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    from plumbline.llm import queries

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert 50256 in tok.encode(TEXTS[3], add_special_tokens=False).ids
    for packed in (queries.queries()["op1_best_fit_packing"](spark, str(tmp_path)), corpus_pipeline.pack(spark, docs, str(tmp_path))):
        by_doc = {}
        for r in packed.collect():
            by_doc.setdefault(r.doc_id, []).append(r)
        assert len(by_doc) == len(TEXTS)
        for i, t in enumerate(TEXTS):
            ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
            assert sum(r.length for r in by_doc[i]) == len(ids)
            assert all(zlib.crc32(ids[r.start : r.start + r.length]) == r.ids_crc32 for r in by_doc[i])
