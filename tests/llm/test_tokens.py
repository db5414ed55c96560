import public_tokenizers
from tokenizers import Tokenizer

from quadrille.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_counts_equal_the_library(docs, odd):
    rows = [*odd, (50, "<|endoftext|>a<|endoftext|>", "en", "s"), (51, "it's  we'll\n\n x\x85y z 日本語 ١٢٣", "en", "s"), (52, "a\x00b" * 9, "en", "s"), (53, "é" * 5000, "en", "s")]
    lib = Tokenizer.from_file(PATH)
    want = sorted(((r[0] is not None, r[0] or 0, len((r[1] or "").encode()), len(lib.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows))
    for size in (64, tokens.CHUNK):
        got = tokens.token_counts(docs(rows), PATH, chunk_bytes=size).collect()
        assert sorted((r["id"] is not None, r["id"] or 0, r["n_bytes"], r["n_tokens"]) for r in got) == want


def test_empty(docs):
    assert tokens.token_counts(docs([]), PATH).count() == 0


def test_plain_range_agrees_with_the_splitter():
    lib = Tokenizer.from_file(PATH)
    for c in range(0x250):
        text = f"a{chr(c)} b{chr(c)}{chr(c)}1{chr(c)}.{chr(c)}  {chr(c)}"
        assert tokens._SPLIT.findall(text) == [text[a:z] for _, (a, z) in lib.pre_tokenizer.pre_tokenize_str(text)]
