import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from casegrid.llm import packing, token_files
from casegrid.llm.common import fresh_folder, give_back, trimmed
from casegrid.llm.queries import PACK_VOCAB, QUERIES, TOKEN_VOCAB, vocab_path
from casegrid.llm.vocab import Encoder, encoder

ODD = ["", "  ", "a  b", "a   b", " a", "a ", "a\n b", "a \nb", "x\n\n  y", "a\tb c", "<|endoftext|> a <|endoftext|>x",
       "abc  <|endoftext|> z", "<|startoftext|> q", "É è", "e\u0301 b", "it's 'Re x", "\x1c a\x1cb", "a\u00a0 b \u3000c",
       "日本 語", "q" * 5000]
EDGE = [(5, "b b"), (2, None), (None, "no id"), (9, ""), (5, "b b"), (5, "other"), (7, "word " * 30000), (8, "z" * 20000)]


def ids_of(vocab, text, end):
    return Tokenizer.from_file(vocab_path(vocab)).encode(text or "", add_special_tokens=False).ids + [end]


@pytest.mark.parametrize(("vocab", "style"), [(TOKEN_VOCAB, "byte"), (PACK_VOCAB, "word"), (TOKEN_VOCAB, "whole")])
def test_encoder_equals_the_library(vocab, style, texts):
    rnd = random.Random(3)
    many = ODD + ["".join(rnd.choice(" \n\tab'1.é \x1c\u3000") for _ in range(rnd.randint(0, 25))) for _ in range(500)]
    many += list(texts.values())[:60]
    tok = Tokenizer.from_file(vocab_path(vocab))
    want = [e.ids for e in tok.encode_batch(many, add_special_tokens=False)]
    enc = Encoder(vocab_path(vocab), style)
    for _ in range(2):  # words unknown, then remembered
        assert [np.frombuffer(b, "<u2").tolist() for b in enc.encode(many)] == want


def test_encoder_keeps_half_of_its_words(monkeypatch):
    monkeypatch.setattr("casegrid.llm.vocab.KEPT_WORDS", 4)
    enc = Encoder(vocab_path(TOKEN_VOCAB), "byte")
    first = enc.encode(["a bb cc dd ee ff"])
    assert enc.encode(["gg hh ii jj kk"]) and enc.encode(["a bb cc dd ee ff"]) == first


def test_other_operators_drop_the_encoder():
    """A Python worker that goes on to another operator keeps no words."""
    path = vocab_path(PACK_VOCAB)
    enc = encoder(path, "word", 4)
    assert list(trimmed(iter, keep_encoder=True)([1])) == [1] and encoder(path, "word", 4) is enc
    assert list(trimmed(lambda b: iter([encoder.cache_info().currsize]))([])) == [0]
    encoder(path, "word", 4)
    give_back()
    assert encoder.cache_info().currsize == 0


def test_packing_with_few_kept_words(docs_of):
    want, got = ([tuple(r) for r in packing.pack(docs_of(EDGE).coalesce(1), vocab_path(PACK_VOCAB), kept_words=k).collect()] for k in (None, 2))
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_op1_round_trip(spark, sf, texts):
    got = {r["doc_id"]: r for r in QUERIES["op1_token_files"](spark, sf).collect()}
    start = 0
    assert got.keys() == texts.keys()
    for doc in sorted(texts):
        ids = np.array(ids_of(TOKEN_VOCAB, texts[doc], 2), "<u4")
        assert (got[doc]["start"], got[doc]["n_tokens"], got[doc]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_folder_edge_rows(spark, docs_of, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_DOCS", 3)
    path = fresh_folder(spark, "t")
    token_files.write_tokens(docs_of(EDGE), path, vocab_path(TOKEN_VOCAB))
    rows = sorted(token_files.read_tokens(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, 2, 5, 5, 5, 7, 8, 9]
    assert rows[1]["n_tokens"] == rows[-1]["n_tokens"] == 1
    at = 0
    for r in rows:
        assert r["start"] == at and len(r["ids"]) == 4 * r["n_tokens"]
        at += r["n_tokens"]
    some = token_files.read_tokens(spark, path, [7, 2]).collect()
    assert {r["doc_id"] for r in some} == {2, 7}
    assert next(r["ids"] for r in some if r["doc_id"] == 7) == np.array(ids_of(TOKEN_VOCAB, EDGE[6][1], 2), "<u4").tobytes()
    blocks = spark.read.parquet(path + "/blocks")
    assert blocks.count() >= 3 and blocks.where("size(offsets) != size(doc_ids) + 1").count() == 0


def test_token_folder_of_no_rows(spark, docs_of):
    path = fresh_folder(spark, "t")
    token_files.write_tokens(docs_of([]), path, vocab_path(TOKEN_VOCAB))
    assert token_files.read_tokens(spark, path).count() == 0
    assert token_files.read_tokens(spark, path, []).count() == 0


def test_another_dictionary_is_refused(spark, docs_of):
    path = fresh_folder(spark, "t")
    token_files.write_tokens(docs_of([(1, "a")]), path, vocab_path(TOKEN_VOCAB))
    spark.read.parquet(path + "/dictionary").selectExpr("'00' dict_hash", "dictionary", "vocab", "width").write.parquet(path + "2/dictionary")
    with pytest.raises(ValueError, match="hash"):
        token_files.read_tokens(spark, path + "2")


def check_packing(rows, want, window=2048):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert by_doc.keys() == want.keys()
    for doc, pieces in by_doc.items():
        pieces.sort(key=lambda r: r["start"])
        raw = b"".join(bytes(p["ids"]) for p in pieces)
        assert raw == np.array(want[doc], "<u4").tobytes()
        at = 0
        for p in pieces:
            assert p["start"] == at and p["length"] == len(p["ids"]) // 4 > 0 and p["doc_tokens"] == len(want[doc])
            at += p["length"]
    pad = 0
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= window
        pad += 0 if at & (at - 1) == 0 else window - at
    return pad


def test_packing_loses_nothing(spark, texts, docs_of):
    rows = packing.pack(docs_of(list(texts.items())).repartition(5, "doc_id"), vocab_path(PACK_VOCAB), open_windows=4).collect()
    assert check_packing(rows, {d: ids_of(PACK_VOCAB, t, 1) for d, t in texts.items()}) == 0


def test_packing_edge_rows(spark, docs_of):
    rows = packing.pack(docs_of([(2, None), (None, "no id"), (9, ""), (7, "word " * 30000), (8, "z" * 20000)]), vocab_path(PACK_VOCAB)).collect()
    want = {2: None, None: "no id", 9: "", 7: "word " * 30000, 8: "z" * 20000}
    assert check_packing(rows, {d: ids_of(PACK_VOCAB, t, 1) for d, t in want.items()}) == 0
    assert packing.pack(docs_of([]), vocab_path(PACK_VOCAB)).count() == 0
    twice = packing.pack(docs_of([(1, "a b")] * 2), vocab_path(PACK_VOCAB)).collect()
    assert sorted((r["start"], r["length"]) for r in twice).count((0, 3)) >= 1 and sum(r["length"] for r in twice) == 6


def test_best_fit_prefers_the_tightest_window():
    p = packing.Packer(10, 2, 0)
    for doc, n in ((1, 6), (2, 9), (3, 1), (4, 4)):
        p.add(doc, 0, n, np.arange(n, dtype="<u4"))
    assert [[q[0] for q in w] for _, w in p.done] == [[2, 3], [1, 4]]
    for doc, n in ((5, 6), (6, 7), (7, 8)):
        p.add(doc, 0, n, np.arange(n, dtype="<u4"))
    # None fits 8: the fullest (7) is topped up with 3 and emitted; 5 stay open.
    assert [(q[0], len(q[3])) for q in p.done[-1][1]] == [(6, 7), (7, 3)]


def test_a_call_asks_for_each_distinct_word_once(monkeypatch):
    import public_tokenizers

    from casegrid.llm.vocab import Encoder, encoder

    for style, name, want in (("word", "word_bpe_49k.json", ["to", "be", "or", "not"]), ("byte", "byte_bpe_50k.json", ["be", "or", "not", "to", ""])):
        enc, asked = Encoder(str(public_tokenizers.path(name)), style), []
        known = enc._known
        monkeypatch.setattr(enc, "_known", lambda words, known=known, asked=asked: asked.extend(words) or known(words))
        texts = ["to be or not to be"] * 3 + ["", "to", "to  be"]
        assert enc.encode(texts) == enc._each(texts)
        assert sorted(asked) == sorted(want if style == "byte" else [*want, ""])
